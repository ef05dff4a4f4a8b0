"""Memory, post and search records from JSON and JSON lines, with their fallback chains of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOOSE = {"multiLine": "false", "mode": "PERMISSIVE"}


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, ordinal) with the record as a variant; a line that holds a list or {records: [...]} is taken apart."""
    raw = spark.read.text(path, wholetext=False).select(F.col("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    v = raw.select(F.try_parse_json("value").alias("v"), "file", "line").where("v IS NOT NULL")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.records", "array<variant>"), F.array("v"))
    d = v.select("file", "line", F.posexplode(items).alias("at", "record"))
    return d.select("record", "file", F.struct("line", "at").alias("ordinal"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, ordinal) of whole-file JSON: a list, an object with memories, messages, items or records, or one record."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.input_file_name().alias("file"))
    lists = [F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.memories", "$.messages", "$.items", "$.records")]
    items = F.coalesce(*lists, F.array("v"))
    return raw.where("v IS NOT NULL").select("file", F.posexplode(items).alias("ordinal", "record")).select("record", "file", "ordinal")


def first_of(record: str, *paths: str) -> Column:
    """The first non-empty string among some paths of a variant."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(record, f"$.{p}", "string")), F.lit("")) for p in paths))


def memories(records: DataFrame) -> DataFrame:
    """(memory_id, title, content, record_type): text by field priority, else the messages as ``role: text`` lines."""
    said = F.try_variant_get("record", "$.messages", "array<struct<role:string,content:string>>")
    lines = F.array_join(F.transform(said, lambda m: F.concat(F.coalesce(m.role, F.lit("user")), F.lit(": "), F.trim(m.content))), "\n")
    content = F.coalesce(first_of("record", "content", "text", "summary", "memory", "value", "note"), F.nullif(lines, F.lit("")))
    d = records.select(first_of("record", "memory_id", "id").alias("memory_id"), first_of("record", "title", "name").alias("title"), content.alias("content"), first_of("record", "record_type", "type").alias("record_type"))
    return d.where("content IS NOT NULL").withColumn("title", F.coalesce("title", F.substring(F.substring_index("content", "\n", 1), 1, 120)))


def posts(records: DataFrame) -> DataFrame:
    """Posts by alias chains, one row a record key: id, else url, else a hash of who wrote what, where and when; first one wins."""
    n = lambda p: F.coalesce(F.try_variant_get("record", f"$.engagement.{p}", "bigint"), F.lit(0)).alias(p)
    d = records.select(
        "ordinal", first_of("record", "id", "post_id", "url").alias("id"), first_of("record", "url").alias("url"), first_of("record", "platform", "source").alias("platform"),
        first_of("record", "author", "user").alias("author"), first_of("record", "title").alias("title"), first_of("record", "content", "text", "summary").alias("content"),
        first_of("record", "published_at", "created_at").alias("published_at"), first_of("record", "thread_id").alias("thread_id"), first_of("record", "parent_id", "metadata.parent_id").alias("parent_id"),
        F.struct(n("likes"), n("comments"), n("shares"), n("views")).alias("engagement"), F.try_variant_get("record", "$.tags", "array<string>").alias("tags"),
    )
    key = F.coalesce("id", "url", F.sha2(F.concat_ws("|", "platform", "author", "published_at", F.substring("content", 1, 500)), 256))
    rest = [c for c in d.columns if c != "ordinal"]
    return d.groupBy(key.alias("record_key")).agg(F.min_by(F.struct(*rest), "ordinal").alias("r")).select("record_key", "r.*")


def search_results(responses: DataFrame) -> DataFrame:
    """(query, position, title, url, content, score) from (query, results); results without a score get 1 - i / (n + 1)."""
    d = responses.select("query", F.size("results").alias("n"), F.posexplode("results").alias("position", "r"))
    return d.select("query", "position", "r.title", "r.url", "r.content", F.coalesce(F.col("r.score"), 1 - F.col("position") / (F.col("n") + 1)).alias("score"))


def by_url(results: DataFrame, keep: str = "first") -> DataFrame:
    """One row a url at its first position, with the first or the last of its values."""
    rest = [c for c in results.columns if c not in ("url", "position")]
    pick = F.min_by if keep == "first" else F.max_by
    return results.groupBy("url").agg(F.min("position").alias("position"), pick(F.struct(*rest), "position").alias("r")).select("url", "position", "r.*")


def stitched(results: DataFrame) -> DataFrame:
    """(url, text): a url's distinct snippets in order of first appearance."""
    d = results.groupBy("url", "content").agg(F.min("position").alias("position"))
    return d.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x.content), "\n\n...\n\n").alias("text"))


def page_text(html: Column) -> Column:
    """The text of an HTML page, by expressions: scripts and styles out, blocks to lines, entities of the common kind back."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)<(?:/p|br|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" *\n[\s]*", "\n"))


def whole_number(text: Column) -> Column:
    """The whole number a text means, commas aside and fractions dropped; null where it is none."""
    return F.floor(F.abs(F.replace(text, F.lit(","), F.lit("")).try_cast("double"))).cast("bigint") * F.when(F.btrim(text).startswith("-"), -1).otherwise(1)


def vendor_posts(records: DataFrame, platform: str, kind: str = "social_post") -> DataFrame:
    """Scraped items of a vendor as posts, by its many field names; one row a url, else id, else a hash; first one wins."""
    nested = lambda leafs: [f"{o}.{x}" for o in ("author", "user") for x in leafs]
    text = first_of("record", "content", "text", "fullText", "description", "caption", "title", "desc", "body", "message")
    url = first_of("record", "url", "link", "postUrl", "shareUrl", "webpageUrl")
    own = first_of("record", "id", "postId", "tweetId", "noteId", "awemeId", "shortCode", "cid", "url")
    own = F.coalesce(own, F.substring(F.sha2(F.to_json("record"), 256), 1, 24))
    author = first_of("record", *nested(("nickname", "name", "username", "unique_id")), "authorName", "userName", "username", "nickname", "ownerUsername", "name", "author")
    author_id = first_of("record", *nested(("uid", "id", "secUid", "unique_id")), "authorId", "userId", "uid", "secUid", "ownerId", "username")
    number = lambda *ps: F.coalesce(*(whole_number(F.try_variant_get("record", f"$.{p}", "string")) for p in ps), F.lit(0).cast("bigint"))
    counts = {
        "likes": number("likes", "likeCount", "diggCount", "favorites", "favoriteCount"), "comments": number("comments", "commentCount", "replyCount"),
        "shares": number("shares", "shareCount", "reposts", "repostCount"), "views": number("views", "viewCount", "playCount", "videoViewCount"),
    }
    d = records.select(
        "ordinal", F.concat(F.lit(f"{platform}-"), own).alias("id"), own.alias("external_id"), F.lit(platform).alias("platform"), F.coalesce(first_of("record", "type"), F.lit(kind)).alias("type"),
        author.alias("author"), F.coalesce(author_id, author).alias("author_id"), first_of("record", "title", "headline").alias("title"), text.alias("content"),
        first_of("record", "published_at", "createdAt", "createTime", "create_time", "timestamp", "date", "time", "publishTime").alias("published_at"), first_of("record", "sentiment", "polarity").alias("sentiment"),
        F.struct(*(c.alias(n) for n, c in counts.items())).alias("engagement"), sum(counts.values(), F.lit(0)).alias("engagement_score"), url.alias("url"),
        F.coalesce(F.try_variant_get("record", "$.tags", "array<string>"), F.try_variant_get("record", "$.hashtags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )
    key = F.coalesce("url", "id")
    rest = [c for c in d.columns if c != "ordinal"]
    return d.groupBy(key.alias("k")).agg(F.min_by(F.struct(*rest), "ordinal").alias("r")).select("r.*")


def masked_url(url: Column) -> Column:
    """A connection address with its password as three stars."""
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/@]*):[^@/]*@", "$1:***@")
