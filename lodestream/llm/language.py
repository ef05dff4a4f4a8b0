"""Language of each document and of each segment of a mixed one, by compression.

A text is encoded with one zstandard raw-content dictionary per language; the language whose dictionary makes it
smallest wins, and a narrow margin is rejected. Dictionaries are filled from a bounded sample of labelled rows, whose
labels may be wrong: see build_dictionaries.
"""

from __future__ import annotations

import math
import re
import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .lookalike import LOOKALIKES

# Names by which the seven languages of the dictionaries are labelled, beside their two-letter codes.
NAMES = {
    "en": ("eng", "english", "englisch", "inglés", "anglais", "英语", "英文"),
    "zh": ("zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "普通话"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ja": ("jpn", "japanese", "日本語", "nihongo"),
}
#: What is in no language: links, addresses, handles, tags, codes of letters and digits, numbers, pictures.
_NEUTRAL = re.compile(
    r"https?://\S+|www\.\S+|[\w.+-]+\s?[@＠]\s?[\w-]+(?:\.[\w-]+)+|[@＠][\w.]+|[#＃][\w-]+|\bRT\b:?|[A-Za-z]*[0-9][A-Za-z0-9.:/+-]*|[\U0001f000-\U0001faff☀-➿️‍🏻-🏿]+|[​-‏­⁠﻿]"
)
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’)»]*(?:\s+|$)|[。！？]+[」』”’]*|\s+[/|]\s+|\n+|(?=\bRT [@＠]))")
_DRAWN_LIKE = dict(zip(map(ord, LOOKALIKES[::2]), LOOKALIKES[1::2], strict=True)) | {i: None for i in (0xAD, 0x200B, 0x200C, 0x2060, 0xFEFF)}
_NAME = re.compile(r"(?<=[\s,;:'’(])(?:[A-ZÀ-ÖØ-Þ][^\W\d_]*['’-]?)+(?![^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")


def label_language(label: F.Column) -> F.Column:
    """Two-letter code that a label names, or null; region, script, letter case, three-letter codes and names are fine."""
    known = {n: code for code, names in NAMES.items() for n in (code, *names)}
    base = F.lower(F.trim(label))
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(table, base), F.try_element_at(table, F.regexp_extract(base, r"^([a-z]{2,3})[-_]", 1)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; together they are the whole text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def plain(text: str) -> str:
    """Lower case, in one consistent form, without what is in no language: neutral strings and capitalised names.

    Which words are names is not known; every capitalised word after a lower-case one or a comma goes, unless
    the text is written in capitals.
    """
    s = _NEUTRAL.sub(" ", unicodedata.normalize("NFKC", text).translate(_DRAWN_LIKE)).strip()
    if sum(map(str.isupper, s)) < sum(map(str.islower, s)):
        s = s[:1] + _NAME.sub(" ", s[1:])
    return " ".join(s.lower().split())


def weight(text: str) -> int:
    """Letters, a Chinese or Japanese character counting as three: how much there is to tell a language by."""
    return len(_LETTER.findall(text)) + 2 * len(_DENSE.findall(text))


class Classifier:
    """One compressor a language over its raw-content dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 19) -> None:
        import zstandard as z

        self.languages = sorted(dictionaries)
        self.encode = []
        for code in self.languages:
            d = z.ZstdCompressionDict(dictionaries[code], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.encode.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.memo: dict[str, tuple[str, float, float]] = {}

    def sizes(self, text: str) -> list[int]:
        raw = text.encode()
        return [len(e(raw)) for e in self.encode]

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, confidence, margin): margin in bytes saved over the next language, for each byte of the text.

        A narrow win is looked into: what a language saves must not rest on one stretch, such as a name that a dictionary
        happens to hold, so what it still saves with the worst third of the words left out counts twice.
        """
        found = self.memo.get(text)
        if found is None:
            n = len(text.encode())
            saved = [float(n + 9 - s) for s in self.sizes(text)]
            if _margin(saved) < 0.35 * n:
                words = text.split(" ") if text.count(" ") > 1 else list(text)
                joint = " " if text.count(" ") > 1 else ""
                third = -(-len(words) // 3)
                rests = [joint.join(words[:i] + words[i + third :]) for i in range(0, len(words), third)]
                least = [min(x) for x in zip(*([len(r.encode()) + 9 - s for s in self.sizes(r)] for r in rests), strict=True)]
                saved = [(f + 2 * x) / 2 for f, x in zip(saved, least, strict=True)]
            best = max(saved)
            confidence = 1 / sum(math.exp(max(-40.0, (s - best) / 1.5)) for s in saved)
            found = self.languages[saved.index(best)], confidence, _margin(saved) / max(1, n)
            if len(self.memo) >= 20_000:  # bounded memory of texts met again
                self.memo.clear()
            self.memo[text] = found
        return found


def _margin(saved: list[float]) -> float:
    top = sorted(saved)
    return top[-1] - top[-2] if len(top) > 1 else top[-1]


def build_dictionaries(sample: Iterable[tuple[str, str, float]], size: int = 98_304) -> dict[str, bytes]:
    """{language: dictionary of at most ``size`` bytes} from (language, text, weight) rows, commonest sentences first.

    A sentence met several times goes to the language of most of its labels. One met less often is kept only where the
    dictionaries of the other half of the sample find it, and most of its text, in its text's label language.
    """
    labels: dict[str, dict[str, float]] = {}
    times: dict[str, int] = {}
    texts: list[tuple[str, list[str]]] = []
    for code, text, much in sample:
        kept = [s for lo, hi in sentences(text) if weight(s := plain(text[lo:hi])) >= 8]
        texts.append((code, kept))
        for s in kept:
            votes = labels.setdefault(s, {})
            votes[code] = votes.get(code, 0) + much
            times[s] = times.get(s, 0) + 1
    order = sorted(labels, key=lambda s: (-times[s], s))
    most = {s: max(sorted(v), key=v.get) for s, v in labels.items()}
    sure = {s for s, v in labels.items() if times[s] >= 4 and v[most[s]] >= 0.6 * sum(v.values())}

    def fill(chosen: Iterable[str]) -> dict[str, bytes]:
        data: dict[str, list[bytes]] = {}
        total: dict[str, int] = {}
        for s in chosen:
            raw, code = s.encode() + b"\n", most[s]
            if total.get(code, 0) + len(raw) <= size:
                data.setdefault(code, []).append(raw)
                total[code] = total.get(code, 0) + len(raw)
        # what lies at the end of a dictionary is cheapest to refer to
        return {code: b"".join(reversed(parts)) for code, parts in data.items()}

    first = fill(order)
    judges = [Classifier(h) for k in (0, 1) if len(h := fill(order[k::2])) > 1]
    if len(first) < 2 or len(judges) < 2:
        return first
    told = {}
    for i, s in enumerate(order):
        code, _, by = judges[1 - i % 2](s)
        told[s] = most[s] if s in sure else code if by >= 0.02 else None
    good = set(sure)
    for code, kept in texts:
        total: dict[str | None, int] = {}
        for s in kept:
            total[told[s]] = total.get(told[s], 0) + weight(s)
        if total.get(code, 0) > 0.5 * sum(total.values()):
            good.update(s for s in kept if told[s] == code == most[s])
    return fill(s for s in order if s in good) or first


def labelled_sample(rows: DataFrame, label: str, text: str, key: str, per_language: int = 1000) -> list[tuple[str, str, float]]:
    """(language, text, weight) of at most ``per_language`` rows of each label language, by a hash of their key.

    A bounded training sample; weight is the number of rows that a sampled one stands for.
    """
    d = rows.select(label_language(F.col(label)).alias("code"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    d = d.where(F.col("code").isNotNull() & (F.length("text") > 0))
    counts = {r.code: r["count"] for r in d.groupBy("code").count().collect()}  # one row a language
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h"))).where(F.col("n") <= per_language)
    # the hashes below which a language has a little more than its rows: what is shuffled does not grow with the tasks
    bounds = [(c, int(-(2**63) + 2**64 * min(1.0, (per_language + 12 * per_language**0.5 + 50) / n)) - 1) for c, n in counts.items()]
    few = [F.when(F.col("code") == c, F.col("h") <= F.lit(bound)) for c, bound in bounds]
    low = d.where(F.coalesce(*few)) if few else d
    chosen = low.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h"))).where(F.col("n") <= per_language)
    got = chosen.select("code", "text", "n").orderBy("code", "n").collect()
    if len(got) < sum(min(n, per_language) for n in counts.values()):  # keys so repeated that their hashes are no even spread
        got = first.select("code", "text", "n").orderBy("code", "n").collect()
    return [(r.code, r.text, max(1.0, counts[r.code] / per_language)) for r in got]


def segment(text: str, classify: Classifier, least: int = 8, margin: float = 0.02, other_margin: float = 0.08) -> list[tuple[int, int, str | None, float]]:
    """(start, end, language, confidence) of the stretches of a text, null language where none is told.

    A sentence with too few letters or a narrow margin goes with the sentence before it; one that would bring another
    language into the text needs ``other_margin``.
    """
    spans = sentences(text)
    told: list[tuple] = []
    for lo, hi in spans:
        s = plain(text[lo:hi])
        w = weight(s)
        if w < least:
            told.append((None, 0.0, w, 0.0))
            continue
        code, confidence, by = classify(s)
        told.append((code if by >= margin else None, confidence, w, by))
    share: dict[str, int] = {}
    for code, _, w, by in told:
        if code:
            share[code] = share.get(code, 0) + w
    main = max(sorted(share), key=share.get, default=None)
    told = [
        (code if code == main or by >= other_margin else None, c, w)
        for code, c, w, by in told
    ]
    if all(code is None for code, _, _ in told):
        s = plain(text)
        w = weight(s)
        if not w:
            return []
        code, confidence, by = classify(s)
        return [(0, len(text), code if by >= margin / 2 or confidence > 0.6 else None, confidence)]
    out: list[list] = []
    for (lo, hi), (code, confidence, w) in zip(spans, told, strict=True):
        if out and (code is None or code == out[-1][2]):
            out[-1][1] = hi
            if code is not None:
                out[-1][3] = max(out[-1][3], confidence)
        elif out and out[-1][2] is None:
            out[-1][1:4] = hi, code, confidence
        else:
            out.append([lo, hi, code, confidence])
    return [tuple(x) for x in out]


def language_segments(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """(key, segment, start, end, lang, confidence): the language of each segment of each text.

    dictionaries are of bounded size and travel with the tasks. A text in one language is one segment; lang is null where
    the margin is too narrow to tell. Null, empty and wordless texts have no segment; repeated rows repeat; an empty table
    gives an empty result; other columns are ignored.
    """
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = sys.modules.setdefault("_lodestream_cache", types.ModuleType("_lodestream_cache"))
        mark = hash(tuple(sorted(dictionaries.items())))
        if getattr(cache, "language_mark", None) != mark:
            cache.language, cache.language_mark = Classifier(dictionaries), mark
        for b in batches:
            rows = [(i, n, *s) for i, t in enumerate(b.column(1).to_pylist()) for n, s in enumerate(segment(t, cache.language))]
            if rows:
                i, n, lo, hi, code, confidence = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(i)).cast(arrow), pa.array(n, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(code, pa.string()), pa.array(confidence, pa.float64())],
                    ["k", "segment", "start", "stop", "lang", "confidence"],
                )

    picked = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = picked.mapInArrow(run, f"k {kind.simpleString()}, segment int, start bigint, stop bigint, lang string, confidence double")
    return out.withColumnsRenamed({"k": key, "stop": "end"})
