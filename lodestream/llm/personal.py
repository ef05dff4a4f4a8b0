"""Personal information in free text, by a linear-chain conditional random field over word-shape features.

Trained here from a small labelled table (see ``labelled``); decoding is Viterbi in numpy, a batch of sentences at a
time. A token's part of the emission scores depends on the token alone for every place it can take in the window, so
it is worked out once per distinct token and gathered for the rest; pairs and triples of neighbouring shapes add theirs.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import labelled

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
_L = len(LABELS)
WINDOW = 4
_BUCKETS = 1 << 16
_DENSE = "぀-ヿ㐀-鿿々"
_TOKEN = re.compile(rf"[^\W\d_{_DENSE}]+|\d+|[{_DENSE}]|[^\w\s]|_")
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20}
_UNSEEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufe0f\ufeff]")
#: Sequences end here; a full stop in Latin text is no end, as in "St." or "No.".
_END = re.compile(r"[\n\r]+|(?<=[。！？!?])\s*")
#: Tokens of a window; longer sequences are read in windows that overlap, and a span is taken from the one window in whose
#: core it begins, at least _MARGIN tokens from the window's ends.
_LONGEST, _MARGIN = 240, 24

# Words that stand in addresses, before numbers of a kind, or in titles, by language.
_WORDS = {
    "street": "street st ave avenue lane drive road rd ct court blvd boulevard way place rue chemin impasse quai allée calle avenida plaza camino paseo rua travessa alameda largo praça straße strasse weg gasse platz allee ufer graben apt unit suite flat apto piso andar bât am",
    "phone": "call phone tel telefon telefone teléfono téléphone ring reach joignable appelez melden liguem llámenme mobile",
    "id": "id ssn social security number numéro sécurité sociale ausweisnummer cpf dni nif personal",
    "other": "order tracking part batch build version software firmware case ticket invoice vin serial vorgang teilenummer bestellung sendung pièce commande colis pieza pedido envío peça encomenda protocolo caso dossier meter",
    "title": "mr mrs ms dr herr frau madame monsieur señor señora senhor senhora sr sra contact attention regards name llamo appelle heiße nome soy sou bin",
}
# Words that open or close the names of places.
_PLACE_FIRST = set("port puerto porto villa vila santa san sankt saint são sao nava lagoa les bad lake mount monte fort new old north south east west".split())
_PLACE_LAST = set("bay point baja alta city town park beach island harbour hills valley springs county".split())
_WORD_KIND = {w: k for k, ws in _WORDS.items() for w in ws.split()}
_GIVEN = {g.lower() for g in labelled.GIVEN}
_ROAD_ZH, _HOUSE_ZH = set("路街巷道弄村里胡同"), set("号栋室单元座层幢院丁目番地楼")
_SURNAME = set(labelled.SURNAMES)


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 20)}"
    if len(token) == 1 and re.match(rf"[{_DENSE}]", token):
        return "kana" if token < "㐀" else "s" if token in _SURNAME else "road" if token in _ROAD_ZH else "house" if token in _HOUSE_ZH else "han"
    if token[0].isalpha():
        return ("X" if len(token) == 1 else "XX") if token.isupper() else ("Xx" if token[0].isupper() else "x" if len(token) == 1 else "xx")
    return token


def features(token: str) -> list[str]:
    """Features of a token by itself."""
    s, low = shape(token), token.lower()
    out = [f"s:{s}"]
    if s[0] == "d" and token.isdigit():
        out.append(f"d:{token[:2]}{len(token)}")
        out.append("long" if len(token) > 8 else "mid" if len(token) > 4 else "short")
    elif token[0].isalpha():
        out += [f"w:{low}", f"p:{low[:3]}", f"e:{low[-3:]}", f"e:{low[-4:]}", f"l:{min(len(low), 12)}"]
        if low in _GIVEN:
            out.append("given")
        if low in _WORD_KIND:
            out.append(f"k:{_WORD_KIND[low]}")
        if low.endswith(("straße", "strasse", "weg", "gasse", "allee", "platz")):
            out.append("k:street")
    else:
        out.append(f"w:{token}")
    return out


def tokenise(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token); full-width forms count as their narrow ones, a token after a space starts with one."""
    narrow = text.translate(_WIDE)
    if _UNSEEN.search(narrow):
        # characters without a look part no token: tokens of the text without them, at the places they have in it
        at = [i for i, c in enumerate(narrow) if not _UNSEEN.match(c)]
        shown = "".join(narrow[i] for i in at)
        return [(at[lo], at[hi - 1] + 1, t) for lo, hi, t in tokenise(shown)]
    return [(m.start(), m.end(), ("" if m.start() == 0 or not narrow[m.start() - 1].isspace() else " ") + m.group()) for m in _TOKEN.finditer(narrow)]


class Vocabulary:
    """Numbers for distinct tokens, their shapes and features; unknown features have number 0."""

    def __init__(self, known: dict[str, int] | None = None, shapes: dict[str, int] | None = None) -> None:
        self.known = known if known is not None else {}
        self.shapes = shapes if shapes is not None else {}
        self.fixed = known is not None
        self.number: dict[str, int] = {"": 0}
        self.feats: list[list[int]] = [[self._feature("edge")]]
        self.shape: list[int] = [self._shape("edge")]

    def _feature(self, f: str) -> int:
        return self.known.get(f, 0) if self.fixed else self.known.setdefault(f, len(self.known) + 1)

    def _shape(self, s: str) -> int:
        return self.shapes.get(s, 0) if self.fixed else self.shapes.setdefault(s, len(self.shapes) + 1)

    def __call__(self, token: str) -> int:
        bare = token.lstrip(" ")
        # a number is known by its length and first two digits
        key = token if not bare.isdigit() else token[: len(token) - len(bare)] + bare[:2] + "0" * (len(bare) - 2)
        n = self.number.get(key)
        if n is None:
            bare = key.lstrip(" ")
            fs = features(bare) + (["space"] if key != bare else [])
            n = self.number[key] = len(self.feats)
            self.feats.append([self._feature(f) for f in fs])
            self.shape.append(self._shape(shape(bare) + (" " if key != bare else "")))
        return n


class Model:
    """Weights: window[offset, feature, label], pair and triple[bucket, label], change[label, label], first, last[label]."""

    def __init__(self, known: dict[str, int], shape_numbers: dict[str, int], window: np.ndarray, shapes: np.ndarray, change: np.ndarray, first: np.ndarray) -> None:
        self.known, self.shape_numbers = known, shape_numbers
        self.window, self.shapes, self.change, self.first = window, shapes, change, first

    def parts(self) -> tuple:
        """What the model is made of, in types that any worker can read."""
        return self.known, self.shape_numbers, self.window, self.shapes, self.change, self.first


def _hashed(ids: np.ndarray, shape_of: np.ndarray) -> np.ndarray:
    """Buckets [.., 5] of the shapes (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2) of tokens [B, T]; edges pad."""
    p = shape_of[np.pad(ids, ((0, 0), (2, 2)))].astype(np.int64)
    n = ids.shape[-1]
    a, b, c, d, e = (p[..., i : i + n] for i in range(5))
    mix = lambda k, *xs: sum(x * m for x, m in zip(xs, (1, 211, 44521), strict=False)) * 5 + k
    return np.stack([mix(0, b, c), mix(1, c, d), mix(2, b, c, d), mix(3, a, b, c), mix(4, c, d, e)], -1) * 2654435761 % 2**32 % _BUCKETS


def _emission(ids: np.ndarray, by_token: np.ndarray, shape_of: np.ndarray, shape_weights: np.ndarray) -> np.ndarray:
    """[B, T, L] from token numbers [B, T] (0 pads) and scores by token [2W+1, V, L]."""
    wide = np.pad(ids, ((0, 0), (WINDOW, WINDOW)))
    n = ids.shape[1]
    out = np.zeros((*ids.shape, _L), np.float32)
    for o in range(2 * WINDOW + 1):
        out += by_token[o][wide[:, o : o + n]]
    buckets = _hashed(ids, shape_of)
    for k in range(buckets.shape[-1]):
        out += shape_weights[buckets[..., k]]
    return out


def _forbidden() -> np.ndarray:
    """-inf where an inside label would follow neither its begin nor itself."""
    bad = np.zeros((_L, _L), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            bad[:, j] = -1e4
            bad[j, j] = bad[j - 1, j] = 0
    return bad


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.25, seed: int = 1) -> Model:
    """Maximum likelihood by adaptive gradient steps over batches of equal-length-sorted sequences."""
    v = Vocabulary()
    data = []
    for text, spans in rows:
        toks = tokenise(text)
        tags = [0] * len(toks)
        for lo, hi, kind in spans:
            inside = [i for i, (s, e, _) in enumerate(toks) if s >= lo and e <= hi]
            for k, i in enumerate(inside):
                tags[i] = LABELS.index(("B-" if k == 0 else "I-") + kind)
        if toks:
            data.append(([v(t) for _, _, t in toks], tags))
    nf = len(v.known) + 1
    width = max(map(len, v.feats))
    table = np.array([f + [0] * (width - len(f)) for f in v.feats])
    shape_of = np.array(v.shape)
    window = np.zeros((2 * WINDOW + 1, nf, _L), np.float32)
    shapes = np.zeros((_BUCKETS, _L), np.float32)
    change, first = np.zeros((_L, _L), np.float32), np.zeros(_L, np.float32)
    first_bad = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)
    bad = _forbidden()
    squares = [np.full_like(w, 1e-6) for w in (window, shapes, change, first)]
    rng = np.random.default_rng(seed)
    data.sort(key=lambda x: len(x[0]))
    batches = [data[i : i + 64] for i in range(0, len(data), 64)]
    means = [np.zeros_like(w) for w in (window, shapes, change, first)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            batch = batches[k]
            t, b = max(len(x) for x, _ in batch), len(batch)
            ids, gold, live = np.zeros((b, t), int), np.zeros((b, t), int), np.zeros((b, t), bool)
            for i, (x, y) in enumerate(batch):
                ids[i, : len(x)], gold[i, : len(x)], live[i, : len(x)] = x, y, True
            seen = np.unique(np.append(ids, 0))  # a step reads and changes only the weights of the batch's tokens
            ids = np.searchsorted(seen, ids)
            emit = _emission(ids, window[:, table[seen]].sum(2), shape_of[seen], shapes).astype(np.float64)
            go = (change + bad).astype(np.float64)
            a = np.zeros((t, b, _L))
            a[0] = emit[:, 0] + first + first_bad
            for j in range(1, t):
                x = a[j - 1][:, :, None] + go
                m = x.max(1)
                a[j] = np.where(live[:, j, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + emit[:, j], a[j - 1])
            z = a[-1].max(1)
            z = z + np.log(np.exp(a[-1] - z[:, None]).sum(1))
            back = np.zeros((b, _L))
            grad_emit = np.zeros((b, t, _L))
            grad_change = np.zeros((_L, _L))
            for j in range(t - 1, -1, -1):
                here = live[:, j, None]
                grad_emit[:, j] = np.where(here, np.exp(a[j] + back - z[:, None]), 0)
                if j:
                    step = emit[:, j] + back
                    both = np.exp(a[j - 1][:, :, None] + go + step[:, None] - z[:, None, None]) * live[:, j, None, None]
                    grad_change += both.sum(0)
                    x = go + step[:, None]
                    m = x.max(2)
                    back = np.where(here, m + np.log(np.exp(x - m[:, :, None]).sum(2)), back)
            at = np.nonzero(live)
            grad_emit[at[0], at[1], gold[at]] -= 1
            nxt = live[:, 1:]
            np.add.at(grad_change, (gold[:, :-1][nxt], gold[:, 1:][nxt]), -1)
            grad_first = grad_emit[:, 0].sum(0)
            g = grad_emit[live].astype(np.float32)
            per_token = np.zeros((2 * WINDOW + 1, len(seen), _L), np.float32)
            wide = np.pad(ids, ((0, 0), (WINDOW, WINDOW)))
            for o in range(2 * WINDOW + 1):
                np.add.at(per_token[o], wide[:, o : o + t][live], g)
            used, at_used = np.unique(table[seen].reshape(-1), return_inverse=True)
            grad_window = np.zeros((2 * WINDOW + 1, len(used), _L), np.float32)
            for o in range(2 * WINDOW + 1):
                np.add.at(grad_window[o], at_used, np.repeat(per_token[o], width, 0))
            grad_window[:, used == 0] = 0
            buckets, at_bucket = np.unique(_hashed(ids, shape_of[seen])[live], return_inverse=True)
            at_bucket = at_bucket.reshape(len(g), -1)
            grad_shapes = np.zeros((len(buckets), _L), np.float32)
            for k2 in range(at_bucket.shape[1]):
                np.add.at(grad_shapes, at_bucket[:, k2], g)
            places = ((slice(None), used), (buckets,), (slice(None),), (slice(None),))
            for w, gr, sq, at in zip((window, shapes, change, first), (grad_window, grad_shapes, grad_change, grad_first), squares, places, strict=True):
                gr = gr / b + 2e-5 * w[at]
                sq[at] += gr * gr
                w[at] -= rate * gr / np.sqrt(sq[at])
        if epoch >= epochs // 2:  # the mean of the later epochs' weights depends less on the last batches
            for m, w in zip(means, (window, shapes, change, first), strict=True):
                m += w / (epochs - epochs // 2)
    window, shapes, change, first = means
    return Model(v.known, v.shapes, window, shapes, change + bad, first + first_bad)


class Recogniser:
    """A trained model ready to decode; keeps the scores of distinct tokens, within a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._fresh()

    def _fresh(self) -> None:
        self.vocabulary = Vocabulary(self.model.known, self.model.shape_numbers)
        self.scores = np.zeros((2 * WINDOW + 1, 0, _L), np.float32)

    def _by_token(self) -> tuple[np.ndarray, np.ndarray]:
        v, done = self.vocabulary, self.scores.shape[1]
        if len(v.feats) > done:
            grown = np.zeros((2 * WINDOW + 1, max(len(v.feats) + 1000, done * 2), _L), np.float32)
            if len(v.feats) > getattr(self, "filled", 0):
                grown[:, :done] = self.scores
                self.scores = grown
        begin = getattr(self, "filled", 0) if done else 0
        for i in range(begin, len(v.feats)):
            self.scores[:, i] = self.model.window[:, [f for f in v.feats[i] if f]].sum(1)
        self.filled = len(v.feats)
        return self.scores, np.array(v.shape)

    def decode(self, sequences: list[list[int]]) -> list[np.ndarray]:
        """Best label path of each sequence, by Viterbi over batches of like length."""
        by_token, shape_of = self._by_token()
        out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        begin = 0
        while begin < len(order):
            end, t = begin, 0
            while end < len(order) and (end - begin + 1) * max(t, len(sequences[order[end]])) <= 24_000:
                t = max(t, len(sequences[order[end]]))
                end += 1
            end = max(end, begin + 1)
            group = order[begin:end]
            t = len(sequences[group[-1]])
            ids = np.zeros((len(group), t), int)
            for r, i in enumerate(group):
                ids[r, : len(sequences[i])] = sequences[i]
            emit = _emission(ids, by_token, shape_of, self.model.shapes)
            best = emit[:, 0] + self.model.first
            came = np.zeros((t, len(group), _L), np.int8)
            keep = np.zeros((t, len(group), _L), np.float32)
            keep[0] = best
            for j in range(1, t):
                x = best[:, :, None] + self.model.change
                came[j] = x.argmax(1)
                best = x.max(1) + emit[:, j]
                keep[j] = best
            rows = np.arange(len(group))
            length = np.array([len(sequences[i]) for i in group])
            path = np.zeros((len(group), t), int)
            state = np.zeros(len(group), int)
            for j in range(t - 1, -1, -1):
                state = np.where(j == length - 1, keep[j].argmax(1), np.where(j < length - 1, came[min(j + 1, t - 1)][rows, state], 0))
                path[:, j] = state
            for r, i in enumerate(group):
                out[i] = path[r, : length[r]]
            begin = end
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, type) of each text, in order."""
        if len(self.vocabulary.number) > 200_000:
            self._fresh()
            self.filled = 0
        sequences, places = [], []
        for i, text in enumerate(texts):
            at = 0
            for stop in [m.end() for m in _END.finditer(text)] + [len(text)]:
                if stop > at:
                    toks = tokenise(text[at:stop])
                    step = _LONGEST - 2 * _MARGIN
                    starts = range(0, max(1, len(toks) - 2 * _MARGIN), step) if len(toks) > _LONGEST else (0,)
                    for k in starts if toks else ():
                        last = k == starts[-1]
                        part = toks[k:] if last else toks[k : k + _LONGEST]
                        sequences.append([self.vocabulary(t) for _, _, t in part])
                        core = (_MARGIN if k else 0, len(part) if last else step + _MARGIN)
                        places.append((i, [(s + at, e + at) for s, e, _ in part], core))
                    at = stop
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for (i, spots, (lo, hi)), path in zip(places, self.decode(sequences), strict=True):
            current = None
            for n, ((s, e), label) in enumerate(zip(spots, path, strict=True)):
                name = LABELS[label]
                if name[0] == "I" and current:
                    current[1] = e
                    continue
                self._keep(out[i], texts[i], current)
                current = [s, e, name[2:]] if name[0] == "B" and lo <= n < hi else None
            self._keep(out[i], texts[i], current)
        return out

    @staticmethod
    def _keep(out: list[tuple[int, int, str]], text: str, span: list | None) -> None:
        if span:
            lo, hi, kind = span
            while hi > lo and not (text[hi - 1].isalnum() or text[hi - 1] in ").]º"):
                hi -= 1
            if _plausible(text[lo:hi], kind) and not (out and lo < out[-1][1]):  # two windows may see one span differently
                out.append((lo, hi, kind))


def _plausible(span: str, kind: str) -> bool:
    """An exact check of what the field found: the least that a value of the kind holds."""
    s = span.translate(_WIDE)
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(re.search(r"@|[\[(]\s*at\s*[\])]|\sat\s", s, re.I)) and bool(re.search(r"\.|\sdot\s", s, re.I))
    if kind == "phone":
        return 7 <= digits <= 16
    if kind == "id_number":
        return 8 <= digits <= 20
    if kind == "street_address":
        return digits > 0 and any(c.isalpha() for c in s)
    dense = re.findall(rf"[{_DENSE}]", s)
    if digits or not dense:
        opening = re.match(r"(?i)(?:in|en|em|im|am|aus|bei|from|at|to|à)\s", s)
        words = s.lower().replace(",", " ").split()
        if not words or words[0] in _PLACE_FIRST or words[-1] in _PLACE_LAST:
            return False
        return not digits and not opening and len(re.findall(r"[^\W\d_]{2,}", s)) >= 2
    chinese = 2 <= len(dense) <= 4 and (dense[0] in _SURNAME or "".join(dense[:2]) in labelled.COMPOUND_SURNAMES)
    return len(dense) + s.count(" ") == len(s) and (chinese or 3 + (" " not in s) <= len(dense) <= 8)


def recogniser_model() -> Model:
    """The model, trained once a process from the labelled table."""
    cache = sys.modules.setdefault("_lodestream_cache", types.ModuleType("_lodestream_cache"))
    if not hasattr(cache, "personal"):
        cache.personal = train(labelled.labelled_table())
    return cache.personal


def personal_information(df: DataFrame, key: str, fields: tuple[str, ...], model: Model | None = None) -> DataFrame:
    """(key, field, redacted, found): each non-null, non-empty field with typed placeholders, and what was found.

    redacted is the field with every span replaced by [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] or [PERSON_NAME] and
    otherwise unchanged; found holds the spans as (start, end, type) in code points of the field as stored. Repeated
    rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast((model or recogniser_model()).parts())  # of bounded size: the table is fixed
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognise = Recogniser(Model(*shared.value))
        for b in batches:
            ids = b.column(0)
            for n, field in enumerate(fields, 1):
                texts = b.column(n).to_pylist()
                at = [i for i, t in enumerate(texts) if t]
                begin = 0
                while begin < len(at):
                    stop, size = begin, 0
                    while stop < len(at) and (stop == begin or size + len(texts[at[stop]]) <= 400_000):
                        size += len(texts[at[stop]])
                        stop += 1
                    part = at[begin:stop]
                    begin = stop
                    spans = recognise([texts[i] for i in part])
                    redacted = []
                    for i, s in zip(part, spans, strict=True):
                        out, last = [], 0
                        for lo, hi, t in s:
                            out += [texts[i][last:lo], f"[{t.upper()}]"]
                            last = hi
                        redacted.append("".join(out) + texts[i][last:])
                    found = [[{"start": lo, "end": hi, "type": t} for lo, hi, t in s] for s in spans]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(part)).cast(arrow), pa.array([field] * len(part)), pa.array(redacted, pa.string()), pa.array(found, found_type)],
                        ["k", "field", "redacted", "found"],
                    )

    picked = df.select(F.col(key).alias("k"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    schema = f"k {kind.simpleString()}, field string, redacted string, found array<struct<start:bigint,end:bigint,type:string>>"
    return picked.mapInArrow(run, schema).withColumnRenamed("k", key)
