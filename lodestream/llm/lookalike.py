"""Visually identical text brought to one form, by SQL embedded in Arrow partitions.

DuckDB runs inside each Python task over the Arrow batch: invisible characters go by regular expression, width and
compatibility forms and look-alike letters by translate, ligatures by replace, accents by nfc_normalize. Only digests
leave the scan for the comparison; texts are not shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of other scripts that are drawn like a Latin letter, each followed by that letter.
LOOKALIKES = (
    "аaеeоoрpсcуyхxѕsіiјjԁdһhԛqԝwѵvӏlүy"  # Cyrillic small
    "АAВBЕEКKМMНHОOРPСCТTУYХXЅSІIЈJԚQԜWԌGҮYӀI"  # Cyrillic capital
    "οoνvιiυuαaρpϲcϳjκk"  # Greek small
    "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϹCͿJ"  # Greek capital
    "օoսuհhոnցgԼLՕOՍUՏS"  # Armenian
    "ɑaɡgıiʟLꞬG"  # Latin letters of special use
)
#: Code points without a look: format characters, joiners, fillers, variation selectors.
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]+"
)
#: Full-width forms of the ASCII signs, and the two commonest spaces beside the plain one.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000) + chr(0xA0)
_PICTURE = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
#: A joiner between pictures draws another picture; it is kept.
JOINED = rf"({_PICTURE}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]?)\x{{200D}}({_PICTURE})"
_KEPT_JOINER = chr(0xE000)  # private use: stands for a kept joiner while the others go


def compatibility_map() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to, ligatures) by rule from the character data: widths, fonts, compatibility forms and kinds of spaces."""
    single: dict[str, str] = {}
    ligatures = []
    for i in range(0xA0, 0x20000):
        c = chr(i)
        form = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            single[c] = " "
        elif form.startswith(("<wide>", "<narrow>", "<font>", "<compat>")):
            n = unicodedata.normalize("NFKC", c)
            if len(n) == 1:
                single[c] = n
            elif "LIGATURE" in unicodedata.name(c, "") and i < 0xFB07:
                ligatures.append((c, n))
    single["\t"] = " "
    pairs = iter(LOOKALIKES)
    drawn = dict(zip(pairs, pairs, strict=True))
    single = {c: drawn.get(n, n) for c, n in single.items()} | drawn
    return "".join(single), "".join(single.values()), ligatures


def character_class(characters: str) -> str:
    """A regular-expression class of the characters, by ranges of neighbours."""
    points = sorted(map(ord, characters))
    out, lo = [], points[0]
    for a, b in zip(points, [*points[1:], None], strict=True):
        if b != a + 1:
            out.append(f"\\x{{{lo:X}}}-\\x{{{a:X}}}")
            lo = b
    return f"[{''.join(out)}]"


def form_sql(column: str, marks: dict[str, str]) -> str:
    """The SQL expression of a column's consistent form. marks: the statement's constants, as SQL literals."""
    s = f"regexp_replace({column}, {marks['joined']}, '\\1{_KEPT_JOINER}\\2', 'g')"
    s = f"regexp_replace({s}, {marks['invisible']}, '', 'g')"
    # full-width forms are in most Chinese and Japanese texts; the long table is built only for texts that hold others
    s = f"translate({s}, {marks['wide']}, {marks['narrow']})"
    long = f"translate({s}, {marks['from']}, {marks['to']})"
    for a, b in compatibility_map()[2]:
        long = f"replace({long}, '{a}', '{b}')"
    s = f"nfc_normalize(CASE WHEN regexp_matches({s}, {marks['rare']}) THEN {long} ELSE {s} END)"
    return f"replace({s}, '{_KEPT_JOINER}', chr(8205))"


def _connection():
    """A DuckDB connection, one a process."""
    import types

    import duckdb

    cache = sys.modules.setdefault("_lodestream_cache", types.ModuleType("_lodestream_cache"))
    if not hasattr(cache, "duck"):
        cache.duck = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        cache.duck.execute("SET enable_progress_bar = false")
    return cache.duck


def consistent_forms(df: DataFrame, key: str, fields: tuple[str, ...], digests: bool = False) -> DataFrame:
    """(key, field, stored, form), a row for each non-null, non-empty text field of each row.

    With digests, stored and form are md5 digests (32 hex digits), for comparisons without moving text. Text that is only
    invisible has the empty form. Rows repeated in df are repeated here; empty tables give an empty result.
    """
    source, target, ligatures = compatibility_map()
    common = {c: n for c, n in zip(source, target, strict=True) if c in WIDE}
    rare = "".join(c for c in source if c not in common) + "".join(a for a, _ in ligatures)
    values = {"joined": JOINED, "invisible": INVISIBLE, "wide": "".join(common), "narrow": "".join(common.values()), "rare": character_class(rare), "from": source, "to": target}
    names = {k: "'" + v.replace("'", "''") + "'" for k, v in values.items()}
    wrap = (lambda x: f"md5({x})") if digests else (lambda x: x)
    sql = " UNION ALL ".join(
        f"SELECT k, '{f}' AS field, {wrap(f'f{i}')} AS stored, {wrap(form_sql(f'f{i}', names))} AS form FROM batch WHERE f{i} IS NOT NULL AND f{i} <> ''"
        for i, f in enumerate(fields)
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        duck = _connection()
        for b in batches:
            if b.num_rows:
                duck.register("batch", pa.Table.from_batches([b]))
                out = duck.execute(sql).to_arrow_table()
                duck.unregister("batch")
                yield from out.cast(wanted).to_batches(max_chunksize=4096)

    kind = df.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    wanted = pa.schema([("k", to_arrow_type(kind)), ("field", pa.string()), ("stored", pa.string()), ("form", pa.string())])
    picked = df.select(F.col(key).alias("k"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    return picked.mapInArrow(run, f"k {kind.simpleString()}, field string, stored string, form string").withColumnRenamed("k", key)


def lookalike_pairs(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: different keys whose field differs as stored and has the same form.

    Texts stored alike are no pair. The work follows the result: distinct spellings of a form are paired first, and only
    keys of paired spellings meet, so a form common to a third of the rows costs nothing beyond the pairs asked for.
    Null and empty fields are left out; rows repeated for a key count once.
    """
    # the digests are read by several joins: made once, kept in the shared folder
    forms = cut(consistent_forms(df, key, fields, digests=True).dropDuplicates([key, "field"]))
    spelt = forms.groupBy("field", "form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"))
    several = spelt.where("lo <> hi").select("field", "form")
    kept = forms.join(several, ["field", "form"], "left_semi")
    spellings = kept.select("field", "form", "stored").distinct()
    a, b = spellings.withColumnRenamed("stored", "a"), spellings.withColumnRenamed("stored", "b")
    pairs = a.join(b, ["field", "form"]).where("a < b")
    left = kept.select("field", F.col("form"), F.col("stored").alias("a"), F.col(key).alias("x"))
    right = kept.select("field", F.col("form"), F.col("stored").alias("b"), F.col(key).alias("y"))
    met = pairs.join(left, ["field", "form", "a"]).join(right, ["field", "form", "b"]).where("x <> y")
    return met.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
