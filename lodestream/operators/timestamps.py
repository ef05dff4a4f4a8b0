"""Mixed timestamp formats and zones to one UTC instant.

Every value is parsed, JVM-side, under each reading it admits. Which reading a source means is decided by
expectation-maximisation over the mixture of readings of that source: a value contributes likelihood under each
valid parse, the posterior chooses, and values whose best posterior stays below a threshold are marked ambiguous.
An all-numeric date is read both ways round wherever both are dates. A date order stated for the source counts as much as
all the source's numeric dates together, so a source that keeps to it is read by it, and one whose values contradict it
is not; a stated year-first order says nothing on the other two parts. "Eight bare digits are a date" is binding.

The E-step needs only (source, set of valid readings) counts, so the rows are pre-aggregated before any shuffle and
one source costs at most 2^readings rows, however many values it wrote.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Readings of a value. A bit of the validity mask each.
READINGS = ("year_first", "compact", "named_month", "month_day", "day_month", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns")

# Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
}
# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)(?:\[[A-Za-z0-9_/+-]+\])?"
_CLOCK = r"(上午|下午|午前|午後)?\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?"
_TIME = rf"{_CLOCK}\s*({_ZONE})?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
_SEP = r"(?:\s*T\s*|,?\s+(?:at\s+)?)"
#: pattern and replacement; fields: reading, three date parts, day half, hour, minute, second, fraction, am/pm, zone
_FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_SEP}{_TIME}$", "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日\s*{_TIME}$", "Y|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?\s*({_ZONE})?$", "C|$1|$2|$3||$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_SEP}{_TIME}$", "N|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){_SEP}{_TIME}$", "M|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?\.?[\s-]+{_MONTH}[\s-]+(\d{{4}}){_SEP}{_TIME}$", "M|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}\s+({_ZONE}\s+)?(\d{{4}})$", "M|$10|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{9,19})$", "E|$1|||||||||"),
)


def _fields(raw: Column) -> Column:
    """The value's fields by the first form that fits, or null; each form is one regular-expression pass."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    s = F.translate(raw, wide + "　  ", "".join(chr(0x21 + i) for i in range(94)) + "   ")
    s = F.regexp_replace(F.regexp_replace(s, r"[\p{Cf}]", ""), r"^\s+|\s+$", "")
    first, fifth = s.substr(1, 1), s.substr(5, 1)
    by = lambda *forms: F.coalesce(*(F.when(s.rlike(_FORMS[i][0]), F.regexp_replace(s, *_FORMS[i])) for i in forms))
    # two characters tell which forms can fit at all
    fitting = F.when(~first.between("0", "9"), by(4, 5, 6)).when(fifth.isin("-", "/", "."), by(0, 3, 5)).otherwise(by(1, 2, 3, 5, 7))
    return F.split(fitting, r"\|")


def readings(df: DataFrame, value: str, source: str, zones: DataFrame) -> DataFrame:
    """Adds ``valid`` (mask of READINGS), ``local`` (array by reading of local or UTC milliseconds) and ``shift`` kinds.

    zones: one row per source with ``time_zone`` and ``date_order``; sources without a row have neither. ``__order`` is
    the stated order.
    """
    f, n = F.col("__f"), F.col("__n")
    part = lambda i: F.nullif(f[i], F.lit(""))
    month = F.when(f[0] == "M", F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(f[2])).cast("int")).otherwise(n[2])
    half = F.lower(F.substring(F.coalesce(part(9), F.translate(f[4], "上下午前後", "ap")), 1, 1))
    hour = F.when((half == "p") & (n[5] < 12), n[5] + 12).when((half == "a") & (n[5] == 12), 0).otherwise(n[5])
    known = zones.select(
        F.col(source).alias("__src"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order")
    ).dropDuplicates(["__src"])  # at most one row a source, or the join would multiply values
    d = df.withColumn("__f", _fields(F.col(value)))
    d = d.withColumn("__n", F.transform("__f", lambda x: x.try_cast("int")))
    d = d.join(known, F.col(source) == F.col("__src"), "left").drop("__src")
    d = d.withColumns({"__kind": f[0], "__mon": month, "__hour": hour, "__zone": F.trim(part(10))})
    second = F.coalesce(n[7], F.lit(0))
    fraction = F.coalesce(F.rpad(part(8), 3, "0").substr(1, 3).cast("int"), F.lit(0))
    clock = ((F.col("__hour") * 60 + n[6]) * 60 + second) * 1000 + fraction
    d = d.withColumn("__clock", F.when((F.col("__hour") < 24) & (n[6] < 60) & (second < 60), clock.cast("bigint")))

    def local_ms(y: Column, m: Column, day: Column) -> Column:
        zero = F.lit(0)
        whole = F.try_make_timestamp_ntz(y, m, day, zero, zero, F.lit(0).cast("decimal(8,6)"))
        return F.unix_date(whole.cast("date")).cast("bigint") * 86400000 + F.col("__clock")

    digits = F.when(F.col("__kind") == "E", f[1].try_cast("decimal(20,0)"))
    lo, hi = 31536000000, 9999999999999  # 1971 to 2286: within it, the number of digits tells the unit

    def count(per_ms: int, times: int = 1) -> Column:
        ms = (F.floor(digits / per_ms) if per_ms > 1 else digits * times).cast("bigint")
        return F.when(ms.between(lo, hi), ms)

    numeric = F.col("__kind") == "N"
    d = d.withColumns(
        {
            "__stated": F.when(~numeric, local_ms(n[1], F.col("__mon"), n[3])),
            "__md": F.when(numeric, local_ms(n[3], n[1], n[2])),
            "__dm": F.when(numeric, local_ms(n[3], n[2], n[1])),
        }
    )
    stated = lambda kind: F.when(F.col("__kind") == kind, F.col("__stated"))
    d = d.withColumn(
        "__ms",
        F.array(stated("Y"), stated("C"), stated("M"), F.col("__md"), F.col("__dm"), count(1, 1000), count(1), count(1000), count(1000000)),
    )
    mask = F.lit(0)
    for i in range(len(READINGS)):
        mask = mask + F.when(F.col("__ms")[i].isNotNull(), 1 << i).otherwise(0)
    return d.withColumn("__mask", mask)


_ORDERS = {"MDY": READINGS.index("month_day"), "DMY": READINGS.index("day_month")}
#: Share of a source's numeric dates expected to be in neither order; a reading the source hardly uses loses to it.
STRAY = 0.02


def em_weights(counts: pd.DataFrame, order: str | None = None, rounds: int = 200, prior: float = 0.5) -> np.ndarray:
    """Mixture weights of the readings of one source from (mask, n) rows.

    prior: Dirichlet pseudo-count a reading; that of a stated order has the number of numeric dates added, and the order
    not stated has STRAY.
    """
    masks = counts["mask"].to_numpy(np.int64)
    n = counts["n"].to_numpy(float)
    can = ((masks[:, None] >> np.arange(len(READINGS))) & 1).astype(float)
    base = np.full(len(READINGS), prior)
    if order in _ORDERS:
        base[[i for o, i in _ORDERS.items() if o != order]] = STRAY
        base[_ORDERS[order]] += n[can[:, list(_ORDERS.values())].any(1)].sum()
    w = np.full(len(READINGS), 1 / len(READINGS))
    for _ in range(rounds):
        post = can * w
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        new = (post * n[:, None]).sum(0) + base
        new /= new.sum()
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def normalise_timestamps(
    df: DataFrame, value: str, source: str, zones: DataFrame, threshold: float = 0.9
) -> DataFrame:
    """df with ``utc_ms`` bigint, ``reading`` string, ``posterior`` double and ``status`` string added.

    posterior: share of the chosen instant in the likelihood of the value's valid readings and, for a numeric date, of the
    chance STRAY that the source's orders do not hold for it.
    status: ``resolved``, ``ambiguous`` (no instant of posterior >= threshold), ``no_zone`` (a wall time
    of a source without a known zone) or ``unresolved`` (null, blank, not a moment, an impossible date or time, a date
    without a time of day). utc_ms is null unless resolved. Repeated rows each get the same result; an empty table
    gives an empty one; columns of df are kept (names beginning with two underscores are reserved).
    A wall time that occurs twice is the earlier instant, a skipped one moves forward by the gap.
    """
    # parsed once: the mixture weights and the posteriors read the same readings
    r = cut(readings(df, value, source, zones))
    weights = (
        r.where(F.col("__mask") > 0)
        .groupBy(F.coalesce(F.col(source), F.lit("")).alias("__s"), F.col("__mask").alias("mask"))
        .agg(F.count("*").alias("n"), F.max("__order").alias("order"))
        .groupBy("__s")
        .applyInPandas(
            lambda p: pd.DataFrame({"__s": [p["__s"].iloc[0]], "__w": [em_weights(p, p["order"].iloc[0]).tolist()]}),
            T.StructType([T.StructField("__s", T.StringType()), T.StructField("__w", T.ArrayType(T.DoubleType()))]),
        )
    )
    r = r.withColumn("__s", F.coalesce(F.col(source), F.lit(""))).join(weights, "__s", "left")
    ms, w = F.col("__ms"), F.col("__w")
    like = [F.when(ms[i].isNotNull(), w[i]).otherwise(0.0) for i in range(len(READINGS))]
    r = r.withColumn("__l", F.array(*like))
    total = sum((F.col("__l")[i] for i in range(1, len(READINGS))), F.col("__l")[0])
    r = r.withColumns({"__best": F.array_max("__l"), "__total": total})
    r = r.withColumn("__i", F.array_position("__l", F.col("__best")).cast("int") - 1)
    md, dm = _ORDERS["MDY"], _ORDERS["DMY"]
    # both orders of the same day are one instant
    chosen_l = F.when(ms[md] == ms[dm], F.col("__l")[md] + F.col("__l")[dm]).otherwise(F.col("__best"))
    stray = F.when(ms[md].isNotNull() | ms[dm].isNotNull(), (w[md] + w[dm]) * STRAY).otherwise(0.0)
    posterior = F.when(F.col("__mask") > 0, chosen_l / (F.col("__total") + stray))
    chosen = F.when(F.col("__mask") > 0, F.get("__ms", F.col("__i")))
    zone = F.regexp_replace(F.col("__zone"), r"^(.*[^\]])\[.*\]$", "$1")
    offset = F.regexp_extract(zone, r"^([+-]\d{2}):?(\d{2})?$", 1)
    minutes = F.when(
        offset != "",
        F.when(zone.startswith("-"), -1).otherwise(1)
        * (F.abs(offset.try_cast("int")) * 60 + F.coalesce(F.nullif(F.regexp_extract(zone, r"^([+-]\d{2}):?(\d{2})?$", 2), F.lit("")).try_cast("int"), F.lit(0))),
    )
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    minutes = F.when(F.abs(minutes) <= 1080, minutes)
    minutes = F.coalesce(
        minutes,
        F.try_element_at(table, F.upper(zone)),
        # CST names two zones; the source's own zone says which
        F.when(F.upper(zone) == "CST", F.when(F.col("__tz").startswith("Asia/"), 480).otherwise(-360)),
    )
    named = F.when(zone.isNull(), F.col("__tz")).when(zone.contains("/"), zone)
    named = F.when(named.isin(sorted(zoneinfo.available_timezones())), named)
    r = r.withColumns({"__minutes": minutes, "__named": named, "__chosen": chosen, "posterior": posterior})
    chosen, minutes, named = F.col("__chosen"), F.col("__minutes"), F.col("__named")
    # wall-clock arithmetic on zone-free timestamps, so the session's own zone plays no part
    wall = F.timestamp_add("MILLISECOND", chosen, F.lit("1970-01-01").cast("timestamp_ntz"))
    r = r.withColumn("__at", F.when(named.isNotNull() & minutes.isNull(), F.convert_timezone(named, F.lit("UTC"), wall)))
    at = F.col("__at")
    by_zone = F.unix_date(at.cast("date")).cast("bigint") * 86400000 + ((F.hour(at) * 60 + F.minute(at)) * 60 + F.second(at)) * 1000 + chosen % 1000
    utc = F.when(F.col("__i") >= READINGS.index("epoch_s"), chosen).when(minutes.isNotNull(), chosen - minutes * 60000).otherwise(by_zone)
    r = r.withColumn("__utc", utc)
    status = (
        F.when(F.col("__mask") == 0, "unresolved")
        .when(F.col("posterior") < threshold, "ambiguous")
        .when(F.col("__utc").isNull(), F.when(F.col("__zone").isNull(), "no_zone").otherwise("unresolved"))
        .otherwise("resolved")
    )
    r = r.withColumn("status", status)
    names = F.array(*map(F.lit, READINGS))
    r = r.withColumns({"utc_ms": F.when(F.col("status") == "resolved", F.col("__utc")), "reading": F.when(F.col("__mask") > 0, F.get(names, F.col("__i")))})
    return r.select(*df.columns, "utc_ms", "reading", "posterior", "status")
