"""Social signals: normalised posts, search, sentiment, engagement, risk, keywords, threads, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that make a text negative, positive, or a complaint.
NEGATIVE = (
    "complaint", "refund", "after-sales", "after_sales", "quality issue", "delay", "safety issue", "abnormal", "scam", "fraud", "boycott",
    "投诉", "维权", "退款", "退货", "质量", "售后", "客服", "安全", "异常", "故障", "失控", "自燃", "刹车", "漏水", "虚假宣传", "欺诈", "骗", "差评", "避雷",
    "避坑", "踩坑", "翻车", "背刺", "割韭菜", "贬值", "续航虚标", "车机卡顿", "刹不住", "曝光", "召回", "赔偿", "违法", "处罚", "数据泄露", "隐私",
)
COMPLAINT = ("complaint", "blackcat", "refund", "after-sales", "after_sales", "quality", "黑猫", "投诉", "维权", "退款", "退货", "质量", "售后", "客服", "赔偿")
POSITIVE = ("good", "great", "resolved", "recommend", "满意", "解决", "推荐", "好评", "靠谱")
NEGATIVE_QUERIES = ("投诉", "质量", "售后", "退款", "维权")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, by one alternation."""
    return text.rlike("|".join(w.replace("-", r"\-") for w in words))


#: What the signals of a post are worked out from.
SIGNAL_COLUMNS = ("platform", "type", "title", "content", "sentiment", "engagement", "tags", "metadata")


def latest_posts(posts: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row a post: the latest ingested one. With ``columns`` only these (and id, ingested_at) are read and shuffled."""
    rest = [c for c in posts.columns if c not in ("id", "ingested_at") and (columns is None or c in columns)]
    newest = F.struct(F.col("ingested_at"), F.coalesce(F.col("engagement.views"), F.lit(-1)), F.coalesce(F.col("engagement.likes"), F.lit(-1)))
    last = F.max_by(F.struct("ingested_at", *rest), newest).alias("m")
    return posts.groupBy("id").agg(last).select("id", "m.*")


def signal_text() -> Column:
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    words = F.concat_ws(" ", F.coalesce(F.col("metadata.keywords"), F.array().cast("array<string>")))
    tags = F.concat_ws(" ", F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    return F.lower(F.concat_ws(" ", c("type"), c("platform"), c("title"), c("content"), tags, words))


def with_signals(posts: DataFrame) -> DataFrame:
    """Adds engagement_total, signal, sentiment_label and is_complaint; each is worked out once and reused."""
    e = lambda n: F.coalesce(F.col(f"engagement.{n}"), F.lit(0))
    stated = F.lower(F.coalesce(F.col("sentiment"), F.lit("unknown")))
    d = posts.withColumns({"signal": signal_text(), "engagement_total": e("likes") + e("comments") + e("shares") + e("views")})
    label = (
        F.when(stated.isin("negative", "neg", "负面"), "negative")
        .when(stated.isin("positive", "pos", "正面"), "positive")
        .when(stated.isin("neutral", "neu", "中性"), "neutral")
        .when(any_of(F.col("signal"), NEGATIVE), "negative")
        .when(any_of(F.col("signal"), POSITIVE), "positive")
        .otherwise("unknown")
    )
    return d.withColumns({"sentiment_label": label, "is_complaint": any_of(F.col("signal"), COMPLAINT)})


def matched_signals(signal: Column) -> Column:
    words = F.array(*map(F.lit, sorted({*NEGATIVE, *COMPLAINT})))
    return F.filter(words, lambda w: signal.contains(w))


def search(posts: DataFrame, query: str, aliases: dict[str, list[str]] | None = None, platforms: list[str] | None = None) -> DataFrame:
    """Posts that hold, for every word of the query, the word or one of its aliases (substring, any letter case)."""
    groups = []
    sets = [{k.lower(), *(a.lower() for a in v)} for k, v in (aliases or {}).items()]
    whole = query.strip().lower()
    if hit := next((s for s in sets if whole in s), None):
        groups = [hit]
    else:
        for w in whole.split():
            groups.append({w}.union(*(s for s in sets if w in s)))
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    hay = F.lower(F.concat_ws(" ", c("title"), c("content"), c("author"), c("platform"), F.concat_ws(" ", F.coalesce("tags", F.array().cast("array<string>"))), F.concat_ws(" ", F.coalesce(F.col("metadata.keywords"), F.array().cast("array<string>")))))
    d = posts.withColumn("__hay", hay)
    for g in groups:
        ok = F.lit(False)
        for w in sorted(g):
            ok = ok | F.col("__hay").contains(w)
        d = d.where(ok)
    if platforms:
        d = d.where(F.lower("platform").isin([p.lower() for p in platforms]))
    return d.drop("__hay")


def iso_day(published_at: Column) -> Column:
    """The date of a text that begins with one, year first; null else."""
    return F.try_to_date(F.regexp_extract(published_at, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def between(posts: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Posts from start to end, both included; a post without a date passes."""
    d = posts
    if start:
        d = d.where(F.col(day).isNull() | (F.col(day) >= F.lit(start).cast("date")))
    return d.where(F.col(day).isNull() | (F.col(day) <= F.lit(end).cast("date"))) if end else d


def latest_first(day: str, key: str) -> list[Column]:
    """Order of results: latest first, undated last, then by key."""
    return [F.desc_nulls_last(day), F.col(key).asc()]


def query_variants(query: str, n: int = 4) -> list[str]:
    base = query.strip()
    extra = [f"{base} {w}" for w in NEGATIVE_QUERIES if w not in base.lower()]
    return [base, *extra][: max(1, min(10, n))] if base else []


def risk(signals: DataFrame, by: str) -> DataFrame:
    """Per group: posts, shares and sums, a 0-100 score and the level its thresholds give."""
    negative = F.col("sentiment_label") == "negative"
    g = signals.groupBy(by).agg(
        F.count("*").alias("posts"),
        F.count_if(negative).alias("negative"),
        F.count_if("is_complaint").alias("complaints"),
        F.sum("engagement_total").alias("total_engagement"),
        F.coalesce(F.sum(F.when(negative, F.col("engagement_total"))), F.lit(0)).alias("negative_engagement"),
    )
    ratio = F.round(F.col("negative") / F.col("posts"), 4)
    g = g.withColumn("negative_ratio", ratio)
    n, c, e = F.col("negative_ratio"), F.col("complaints"), F.col("negative_engagement")
    some = (n > 0) | (c > 0) | (e > 0)
    heat = F.when(some, F.least(F.col("total_engagement") / 2000, F.lit(10.0))).otherwise(F.least(F.col("total_engagement") / 5000, F.lit(5.0)))
    score = F.least(F.lit(100), F.bround(n * 55 + F.least(c * 8, F.lit(25)) + F.least(e / 1000, F.lit(15.0)) + heat)).cast("bigint")
    level = (
        F.when((n >= 0.6) | (c >= 10) | (e >= 10000), "critical")
        .when((n >= 0.45) | (c >= 3) | (e >= 3000), "high")
        .when((n >= 0.25) | (c >= 1) | (e >= 800), "medium")
        .otherwise("low")
    )
    t = F.col("total_engagement")
    hot = F.when(t >= 100000, "critical").when(t >= 30000, "high").when(t >= 3000, "medium").otherwise("low")
    return g.withColumns({"score": score, "level": level, "heat_level": hot})


def keywords(posts: DataFrame, n: int = 20) -> DataFrame:
    """(keyword, posts): the commonest tags and metadata keywords, ties by keyword."""
    empty = F.array().cast("array<string>")
    words = F.filter(F.concat(F.coalesce("tags", empty), F.coalesce(F.col("metadata.keywords"), empty)), lambda w: F.length(F.trim(w)) > 0)
    return posts.select(F.explode(words).alias("keyword")).groupBy(F.trim("keyword").alias("keyword")).agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "keyword").limit(n)


def thread(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """(thread, id) of all posts that name a thread's id as thread, parent or metadata parent: three equi-joins, no OR-join."""
    t = ids.select(F.col("thread").alias("thread"))
    parts = [posts.select(F.col(c).alias("thread"), "id") for c in ("thread_id", "parent_id", "metadata.parent_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(t, "thread", "left_semi").distinct()


def page(df: DataFrame, order: list[Column], cursor: int, limit: int) -> DataFrame:
    """Rows ``cursor`` to ``cursor + limit`` of a total order."""
    return df.orderBy(*order).offset(cursor).limit(max(1, min(limit, 200)))


def risk_reasons(risks: DataFrame) -> Column:
    """The reasons behind a row of ``risk``, those that apply, in a fixed order."""
    some = (F.col("negative") > 0) | (F.col("complaints") > 0) | (F.col("negative_engagement") > 0)
    facts = (("negative_ratio", "negative_ratio"), ("total_engagement", "total_engagement"), ("complaint_count", "complaints"), ("negative_engagement", "negative_engagement"))
    said = [F.when(F.col(c) != 0, F.concat(F.lit(f"{n}="), F.col(c).cast("string"))) for n, c in facts]
    said.append(F.when((F.col("total_engagement") != 0) & ~some, F.lit("high_heat_without_negative_signal")))
    return F.array_compact(F.array(*said))


def report(signals: DataFrame, day: str, most_keywords: int = 20, most_posts: int = 5) -> DataFrame:
    """(section, name, position, value) of a set of posts with signals: counts by sentiment, platform and day, totals and
    risk, the commonest keywords and the posts of most engagement.

    The counts and totals come from one pass over grouping sets; keywords and posts are limited because they are top lists.
    """
    s = signals.withColumns({"__all": F.lit("all"), "platform": F.coalesce("platform", F.lit("unknown")), "__day": F.col(day).cast("string")})
    sets = s.groupingSets([["sentiment_label"], ["platform"], ["__day"]], "sentiment_label", "platform", "__day").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "sentiment").when(F.col("g") == 5, "platform").otherwise("day")
    name = F.coalesce("sentiment_label", "platform", "__day")
    none = F.lit(None).cast("bigint")
    counts = sets.where(name.isNotNull()).select(section.alias("section"), name.alias("name"), none.alias("position"), F.col("n").cast("double").alias("value"))
    r = risk(s, "__all")
    names = ("posts", "negative", "negative_ratio", "complaints", "total_engagement", "negative_engagement", "score")
    totals = r.select(F.explode(F.array(*(F.struct(F.lit("total").alias("section"), F.lit(n).alias("name"), none.alias("position"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    levels = r.select(F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.col(n).alias("name"), none.alias("position"), F.lit(None).cast("double").alias("value")) for n in ("level", "heat_level")))).alias("x")).select("x.*")
    words = _listed(keywords(s, most_keywords), "keyword", "keyword", F.col("posts"))
    posts = _listed(s.select("id", "engagement_total"), "post", "id", F.col("engagement_total"), most_posts)
    return counts.unionByName(totals).unionByName(levels).unionByName(words).unionByName(posts)


def _listed(rows: DataFrame, section: str, name: str, value: Column, most: int | None = None) -> DataFrame:
    """Rows as a numbered list, largest value first, ties by name; the limit goes before the numbering."""
    d = rows.select(F.col(name).alias("name"), value.cast("double").alias("value"))
    d = d.orderBy(F.desc("value"), "name").limit(most) if most else d
    struct = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "name")))
    d = d.agg(struct.alias("l")).select(F.posexplode("l").alias("position", "x"))
    return d.select(F.lit(section).alias("section"), "x.name", (F.col("position") + 1).cast("bigint").alias("position"), (-F.col("x.v")).alias("value"))


def snapshot(signals: DataFrame, day: str, most_complaints: int = 5) -> DataFrame:
    """``report`` with the keywords of negative or complaining posts and the latest such posts."""
    bad = signals.where((F.col("sentiment_label") == "negative") | F.col("is_complaint"))
    words = _listed(keywords(bad, 20), "negative_keyword", "keyword", F.col("posts"))
    latest = bad.select("id", F.unix_date(F.col(day)).alias("d")).orderBy(F.desc_nulls_last("d"), "id").limit(most_complaints)
    latest = latest.agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("d", F.lit(-1000000))).alias("v"), "id"))).alias("l")).select(F.posexplode("l").alias("position", "x"))
    posts = latest.select(F.lit("complaint").alias("section"), F.col("x.id").alias("name"), (F.col("position") + 1).cast("bigint").alias("position"), F.lit(None).cast("double").alias("value"))
    return report(signals, day).unionByName(words).unionByName(posts)


def author_platforms(signals: DataFrame) -> DataFrame:
    """(author_id, platform, sentiment_label, posts): the parts of an author's profile."""
    return signals.where("author_id IS NOT NULL").groupBy("author_id", F.coalesce("platform", F.lit("unknown")).alias("platform"), "sentiment_label").agg(F.count("*").alias("posts"))


def next_cursor(total: Column, cursor: Column, limit: int) -> tuple[Column, Column]:
    """(offset, next): the offset a cursor text means, 0 where it is no number, and the next cursor or null at the end.

    The limit is held to 1 to 200; 0 means 20.
    """
    many = max(1, min(limit or 20, 200))
    at = F.when(cursor.rlike(r"^\d+$"), cursor.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    after = F.least(at + many, total)
    return at, F.when(after < total, after.cast("string"))
