"""Goldens, brute-force comparisons and edge cases of the core operators."""

import collections
import datetime as dt
import json
import math
import re
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import accounting, chunking, evaluation, graph, hierarchy, memory, retrieval, routing, social, timestamps
from lodestream.plans import registry
from lodestream.session import table
from lodestream.sources import files, records, sinks
from lodestream.streaming import events as streams

from conftest import DATA

ZONES = [("x", "America/New_York", "MDY"), ("n", "Europe/Berlin", "DMY"), ("w", "Asia/Shanghai", "YMD")]


def moments(spark, rows):
    z = spark.createDataFrame(ZONES, "platform string, time_zone string, date_order string")
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, platform string, published_at string")
    out = timestamps.normalise_timestamps(d, "published_at", "platform", z)
    return {r.id: (r.utc_ms, r.status) for r in out.collect()}


def utc(*a, zone="UTC", fold=0):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(zone), fold=fold).timestamp() * 1000)


def test_timestamps(spark):
    cases = [
        ("x", "2025-09-06T11:37:21Z", utc(2025, 9, 6, 11, 37, 21)),
        ("x", "03/01/2026 09:27", utc(2026, 3, 1, 9, 27, zone="America/New_York")),
        ("n", "03/01/2026 09:27", utc(2026, 1, 3, 9, 27, zone="Europe/Berlin")),
        ("n", "02.04.2026 20:01", utc(2026, 4, 2, 20, 1, zone="Europe/Berlin")),
        ("w", "2026年5月5日 下午12:53", utc(2026, 5, 5, 12, 53, zone="Asia/Shanghai")),
        ("w", "2026年6月3日 上午12:05", utc(2026, 6, 3, 0, 5, zone="Asia/Shanghai")),
        ("x", "2026-11-01T01:58:28", utc(2026, 11, 1, 1, 58, 28, zone="America/New_York")),  # twice: the earlier
        ("n", "2025-03-30T02:50:36.861", utc(2025, 3, 30, 1, 50, 36) + 861),  # skipped: moved by the gap
        ("w", "1756834294", 1756834294000),
        ("w", "1756834294731", 1756834294731),
        ("w", "1758609361444846", 1758609361444),
        ("x", "Fri Apr 03 01:29:01 +0800 2026", utc(2026, 4, 2, 17, 29, 1)),
        ("x", "Apr 26, 2026 4:25 AM EDT", utc(2026, 4, 26, 8, 25)),
        ("x", "2025-09-06 22:13:35+05:45", utc(2025, 9, 6, 16, 28, 35)),
        ("n", "2025-11-05T00:51:03+01:00[Europe/Berlin]", utc(2025, 11, 4, 23, 51, 3)),
        ("w", "2025-03-30 03:41:44 Europe/Berlin", utc(2025, 3, 30, 3, 41, 44, zone="Europe/Berlin")),
        ("w", "20250906T223839Z", utc(2025, 9, 6, 22, 38, 39)),
        ("w", "２０２６-０４-０５ ０３：３１：５７", utc(2026, 4, 5, 3, 31, 57, zone="Asia/Shanghai")),
        ("x", " 2025-09-03T12:12:03\n", utc(2025, 9, 3, 12, 12, 3, zone="America/New_York")),
        ("x", "20251208", None), ("x", "2025-09-03", None), ("x", "2025-02-30T10:00:00", None), ("x", "2026-04-12T25:61:00", None),
        ("x", "TBD", None), ("x", "", None), ("x", None, None), ("x", "0000-00-00 00:00:00", None), (None, "2025-09-03T12:12:03", None),
    ]
    got = moments(spark, [c[:2] for c in cases])
    for i, c in enumerate(cases):
        assert got[i][0] == c[2], (c, got[i])
    assert got[len(cases) - 1][1] == "no_zone"


def test_timestamps_em_learns_an_unstated_order(spark):
    rows = [("u", f"{d:02}/03/2026 10:00") for d in range(13, 29)] + [("u", "04/05/2026 10:00")]
    z = spark.createDataFrame([("u", "UTC", None)], "platform string, time_zone string, date_order string")
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, platform string, published_at string")
    out = {r.id: r for r in timestamps.normalise_timestamps(d, "published_at", "platform", z).collect()}
    assert out[16].reading == "day_month" and out[16].utc_ms == utc(2026, 5, 4, 10, 0)
    one = spark.createDataFrame([(0, "u", "04/05/2026 10:00")], "id int, platform string, published_at string")
    assert timestamps.normalise_timestamps(one, "published_at", "platform", z).first().status == "ambiguous"
    assert timestamps.normalise_timestamps(one.limit(0), "published_at", "platform", z).count() == 0


def test_timestamps_posterior_settles(spark):
    """What the statements leave open is settled by the posterior or marked: rows by source, with the reading or status wanted."""
    z = spark.createDataFrame([("keeps", "UTC", "DMY"), ("breaks", "UTC", "DMY"), ("mixes", "UTC", None), ("year", "UTC", "YMD")], "platform string, time_zone string, date_order string")
    month_first = [f"{m:02}/{d}/2026 10:00" for m in range(1, 5) for d in range(13, 28)]
    day_first = [f"{d}/{m:02}/2026 10:00" for m in range(1, 5) for d in range(13, 28)]
    rows = [("keeps", x) for x in day_first * 10] + [("keeps", "03/04/2026 10:00"), ("keeps", month_first[0]), ("keeps", "05/05/2026 10:00")]
    rows += [("breaks", x) for x in month_first * 10] + [("breaks", "03/04/2026 10:00")]
    rows += [("mixes", x) for x in month_first + day_first] + [("mixes", "03/04/2026 10:00"), ("mixes", "05/05/2026 10:00")]
    rows += [("year", x) for x in month_first] + [("year", "03/04/2026 10:00")] + [("none", x) for x in day_first] + [("none", "03/04/2026 10:00Z")]
    rows += [("mixes", "500000000"), ("mixes", "500000000000")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, platform string, published_at string")
    got = {(r.platform, r.published_at): r for r in timestamps.normalise_timestamps(d, "published_at", "platform", z).collect()}
    april, march = utc(2026, 4, 3, 10, 0), utc(2026, 3, 4, 10, 0)
    assert (got["keeps", "03/04/2026 10:00"].utc_ms, got["keeps", "05/05/2026 10:00"].status) == (april, "resolved")
    assert got["keeps", month_first[0]].status == "ambiguous"  # not the source's order, and no other
    assert got["breaks", "03/04/2026 10:00"].status == "ambiguous" and 0.3 < got["breaks", "03/04/2026 10:00"].posterior < 0.7
    assert got["breaks", month_first[0]].status == "resolved"
    assert got["mixes", "03/04/2026 10:00"].status == "ambiguous" and got["mixes", "05/05/2026 10:00"].status == "resolved"
    assert got["year", "03/04/2026 10:00"].utc_ms == march and got["none", "03/04/2026 10:00Z"].utc_ms == april
    assert (got["mixes", "500000000"].utc_ms, got["mixes", "500000000000"].utc_ms) == (500000000000, 500000000000)


def brute_tree(parents):
    out = {}
    for s in parents:
        x, d, seen = s, 0, []
        while parents.get(x) in parents and x not in seen:
            seen.append(x)
            x = parents[x]
            d += 1
        out[s] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, d)
    return out


def test_hierarchy_against_walk(spark):
    import random

    r = random.Random(3)
    parents = {f"n{i}": (f"n{r.randrange(400)}" if r.random() < 0.7 else None) for i in range(300)}
    parents |= {"a": "b", "b": "c", "c": "a", "d": "a", "e": "e", "chain0": None} | {f"chain{i}": f"chain{i - 1}" for i in range(1, 70)}
    parents["blank"] = " "
    rows = [(k, v, "extra") for k, v in parents.items()] + [("a", "b", "again"), (None, "a", "x")]
    d = spark.createDataFrame(rows, "id string, parent_id string, entry string")
    tree = hierarchy.hierarchy(d).cache()
    want = brute_tree({k: (v if v and v.strip() else None) for k, v in parents.items()})
    assert {x.id: (x.root, x.depth) for x in tree.collect()} == want
    got = {x.id: x for x in tree.collect()}
    assert got["chain0"].descendants == 69 and got["chain10"].descendants == 59 and got["a"].in_loop and not got["d"].in_loop
    paths = {x.id: x.path for x in hierarchy.paths(tree).collect()}
    assert paths["chain3"] == ["chain0", "chain1", "chain2", "chain3"]
    for k, (root, depth) in want.items():
        if depth >= 0:
            assert len(paths[k]) == depth + 1 and paths[k][0] == root
    below = {x.id for x in hierarchy.descendants(tree, spark.createDataFrame([("chain60",)], "id string")).collect()}
    assert below == {f"chain{i}" for i in range(61, 70)}


def below(parents):
    """All (ancestor, node) by walking up from every node, once around where there is a loop."""
    out = set()
    for x in parents:
        at, seen = parents[x], {x}
        while at in parents and at not in seen:
            seen.add(at)
            out.add((at, x))
            at = parents[at]
    return out


def test_descendants_of_every_post(spark):
    parents = {r.id: r.parent_id for r in table(spark, DATA, "bulk_mock_posts").select("id", "parent_id").collect()}
    got = [tuple(r) for r in registry.queries()["p4_descendants"](spark, DATA).select("ancestor", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == below(parents)
    parents = {"b": "c", "a": "b", "c": "a", "d": "b", "e": "d", "s": "s", "t": "s", "r": None, "u": "r", "v": "u"}
    d = spark.createDataFrame(list(parents.items()), "id string, parent_id string")
    got = [tuple(r) for r in hierarchy.descendants(hierarchy.hierarchy(d)).collect()]
    assert len(got) == len(set(got)) and set(got) == below(parents)


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "id string, parent_id string")
    assert hierarchy.hierarchy(empty).count() == 0
    one = hierarchy.hierarchy(spark.createDataFrame([("a", None)], "id string, parent_id string")).first()
    assert (one.root, one.depth, one.descendants) == ("a", 0, 0)


def test_hot_parent_links_in_groups(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT_CHILDREN", 5)
    d = spark.createDataFrame([("r", None)] + [(f"k{i}", "r") for i in range(200)] + [("g", "k7")], "id string, parent_id string")
    got = {x.id: x for x in hierarchy.hierarchy(d).collect()}
    assert got["r"].descendants == 201 and got["g"].depth == 2 and all(got[f"k{i}"].depth == 1 for i in range(200))


def test_rrf_value(spark):
    v = spark.createDataFrame([("q", "dense", 1), ("q", "shared", 2)], "query string, item string, rank int")
    k = spark.createDataFrame([("q", "shared", 1)], "query string, item string, rank int")
    r = retrieval.rank_fusion([v, k], "item").orderBy("rank").collect()
    assert [x.item for x in r] == ["shared", "dense"] and r[0].score == round(1 / 62 + 1 / 61, 6)


def test_authority_and_filter(spark):
    rows = [("q", "a", "handbook", "x", 10.0), ("q", "m", "misleading_archive.md", "x", 10.0), ("q", "d", "notes", "[deprecated] x", 10.0)]
    d = spark.createDataFrame(rows, "query string, id string, source string, content string, rerank_score double")
    d = d.withColumns({"score": F.lit(0.0), "keyword_score": F.lit(0.0), "source_status": retrieval.source_status(F.col("source"), F.lit(""), F.col("content"))})
    a = {x.id: x for x in retrieval.adjust_by_authority(d).collect()}
    assert (a["a"].score, a["m"].score, a["d"].score) == (10.0, 2.0, 6.0)
    assert {x.id for x in retrieval.relevant(d).collect()} == {"a", "d"}


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "pricing faq"), (4, "电池 battery")], "id int, text string")
    q = spark.createDataFrame([("a", "faq"), ("b", None), ("c", "电池")], "q string, t string")
    got = {(x.query, x.id) for x in retrieval.bm25(docs, "id", "text", q, "q", "t").collect()}
    assert got == {("a", 3), ("c", 4)}


def test_chunk_goldens():
    t = "Alpha sentence one. Beta sentence two. Gamma sentence three. Delta sentence four."
    assert [a for a, _ in chunking.split_spans(t, 35, 8)] == [0, 20, 39, 61]
    leaves = list(chunking.chunks_of('{"tags":["alpha","beta"]}', "json", 80, 10))
    assert [(x[0], x[4]) for x in leaves] == [("[0]: alpha", "$.tags[0]"), ("[1]: beta", "$.tags[1]")]
    posts = list(chunking.chunks_of('{"posts":[{"title":"First item title","content":"' + "word " * 80 + '"},{"title":"B","published":true}],"count":2}', "json", 80, 10))
    assert {x[4] for x in posts} == {"$.posts[0]", "$.posts[1]", "$.count"} and all(len(x[0]) <= 80 for x in posts)
    assert "published: true" in posts[-2][0] and posts[-1][0] == "count: 2" and all(x[0].startswith("title: First") for x in posts[:-2])
    han = "第一句话在这里。第二句话问什么？" + "连续文本" * 30
    spans = chunking.split_spans(han, 35, 8)
    assert len(spans) > 2 and all(b - a <= 35 for a, b in spans)


def test_short_json_fields_beside_a_long_one():
    fields = {f"field{i}": f"value {i} " + "x" * 60 for i in range(7)}
    for some in (1, 2, 3, 5, 7):
        record = dict(list(fields.items())[:some]) | {"body": "word " * 200}
        got = [x[0] for x in chunking.chunks_of('{"posts": [' + json.dumps(record) + "]}", "json", 400, 50)]
        assert all(any(f"{k}: {v}" in c for c in got) for k, v in record.items() if k != "body") and all(len(c) <= 400 for c in got)
        assert sum("body: word" in c for c in got) > 2


def test_markdown_chunks(spark):
    text = "# Product Guide\nintro text\n## Auth\nkeys and tokens here\n### Login\nuse the form\n## Billing\npay monthly"
    d = spark.createDataFrame([("k", text.replace("\n", "\r\n"), "md"), ("n", None, "md"), ("e", "", None)], "doc_key string, content string, file_type string")
    got = chunking.split_documents(d, 80, 10).collect()
    assert [x.heading_path for x in got] == [["Product Guide"], ["Product Guide", "Auth"], ["Product Guide", "Auth", "Login"], ["Product Guide", "Billing"]]
    assert all(text[x.char_start : x.char_end] == x.content for x in got) and got[1].line_start == 4
    with pytest.raises(ValueError):
        chunking.split_documents(d, 10, 10)


def test_metrics_golden(spark):
    r = spark.createDataFrame([("q", "runbook", 1), ("q", "faq", 2), ("q", "handbook", 3)], "query string, item string, rank int")
    e = spark.createDataFrame([("q", "handbook"), ("q", "faq")], "query string, item string")
    m = evaluation.case_metrics(r, e, 3).first()
    assert (m.hit, m.recall, m.precision, m.mrr) == (1.0, 1.0, 0.666667, 0.5)
    assert evaluation.case_metrics(r, e.limit(0), 3).count() == 0


def test_budget_fold(spark):
    d = spark.createDataFrame([("u", 1, 4.0), ("u", 2, 9.0), ("u", 3, 5.0)], "k string, o int, c double")
    x = accounting.admit(d, "k", "o", "c", 10.0).first()
    assert (x.admitted, x.spent) == (2, 9.0)


def test_graph_edges(spark):
    d = spark.createDataFrame([(1, "s", "t"), (2, "s", "t"), (3, "o", None)], "id int, source string, title string")
    assert [(x["from"], x["to"]) for x in graph.same_source_edges(d, "id", "source", 1).collect()] == [(1, 2)]
    assert [(x["from"], x["to"]) for x in graph.shared_value_edges(d, "id", "title", 0.8).collect()] == [(1, 2)]


def test_same_source_edges_of_all_pairs(spark):
    d = spark.createDataFrame([(i, "s" if i % 3 else "o") for i in range(40)] + [(99, None)], "id int, source string")
    want = {}
    for members in ([i for i in range(40) if i % 3], [i for i in range(40) if not i % 3]):
        want |= {(x, y): round(max(0.2, 1 - 0.15 * (k - 1)), 4) for n, x in enumerate(members) for k, y in enumerate(members[n + 1 :], 1)}
    got = graph.same_source_edges(d, "id", "source").collect()
    pairs = {(r["from"], r["to"]): r.weight for r in got if r["to"] is not None}
    assert len(pairs) == sum(r["to"] is not None for r in got) and all(w > 0.2 for w in pairs.values())
    # the pairs that are no rows follow from membership, and both together are all pairs
    members = collections.defaultdict(list)
    for r in got:
        if r["to"] is None:
            members[r.source].append((r.place, r["from"], r.weight))
    whole = {(x, y): pairs.get((x, y), w) for m in members.values() for n, (_, x, w) in enumerate(sorted(m)) for _, y, _ in sorted(m)[n + 1 :]}
    assert whole == want and set(pairs) <= set(whole)
    assert {(r["from"], r["to"]): r.weight for r in graph.same_source_edges(d, "id", "source", 2).collect()} == {k: w for k, w in want.items() if w >= 0.85}


def test_gate_takes_the_terms_of_the_seeds(spark):
    docs = spark.createDataFrame([(i, "common words here" if i else "common rare", "s") for i in range(30)] + [(90, "12 34", "s")], "id int, text string, source string")
    hits = spark.createDataFrame([("low", 1, 1), ("low", 2, 2), ("low", 3, 3), ("low", 0, 4), ("high", 0, 1), ("none", 90, 1)], "query string, id int, rank int")
    got = {r.query: r.informativeness for r in graph.seed_informativeness(hits, docs, "id", "text").collect()}

    def idf(df):
        return math.log(1 + (30 - df + 0.5) / (df + 0.5)) / math.log(31)

    assert got["low"] == pytest.approx((idf(30) + 2 * idf(29)) / 3) and got["high"] == pytest.approx((idf(30) + idf(1)) / 2) and got["none"] == 0
    signals = spark.createDataFrame([(q, 1.0, 0.25, v) for q, v in got.items()], "query string, specificity double, concentration double, informativeness double")
    gate = {r.query: (r.favourable, r.should_expand, r.confidence) for r in graph.expansion_gate(signals).collect()}
    assert gate == {"low": (1, False, 0.3), "high": (2, True, 1.0), "none": (1, False, 0.3)}


def test_adaptive_gate_of_every_case(spark):
    docs = {r.doc_id: f"{r.title or ''}\n{r.text or ''}" for r in table(spark, DATA, "documents").collect()}
    terms = {k: {w for w in (x.lower().strip("_-") for x in re.findall(X.GRAPH_TERM, v)) if len(w) >= 2} - set(X.STOPWORDS) for k, v in docs.items()}
    df = collections.Counter(t for v in terms.values() for t in v)
    n = max(df.values())
    seeds = collections.defaultdict(set)
    for r in registry.queries()["bm25_topk"](spark, DATA).where("rank <= 3").collect():
        seeds[r.query] |= terms[r.doc_id]
    want = {q: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) / math.log(n + 1) for t in v) / len(v) for q, v in seeds.items()}
    got = {r.query: r for r in registry.queries()["adaptive_gate"](spark, DATA).collect()}
    assert set(got) == set(want)
    for q, v in want.items():
        assert got[q].favourable == (got[q].specificity >= 0.3) + (got[q].concentration >= 0.5) + (v >= 0.3)


def test_social(spark):
    p = social.latest_posts(table(spark, DATA, "bulk_mock_posts"))
    assert p.count() == table(spark, DATA, "bulk_mock_posts").select("id").distinct().count()
    assert social.query_variants("退款慢") == ["退款慢", "退款慢 投诉", "退款慢 质量", "退款慢 售后"]


def test_memory_queue(spark):
    m = table(spark, DATA, "memories")
    up = memory.upsert(m, m.limit(0))
    some = memory.pending(up).limit(3)
    ids = [x.memory_id for x in some.collect()]
    again = memory.mark_indexed(up, up.where(F.col("memory_id").isin(ids)))
    assert again.where(F.col("memory_id").isin(ids)).select("index_status").distinct().collect()[0][0] == "indexed"


def test_state(spark):
    d = spark.createDataFrame([("t", 1, "append", "a"), ("t", 2, "override", "b"), ("t", 3, "append", "c")], "k string, o int, kind string, value string")
    assert routing.reduce_state(d, "k", "o").first().value == "b|c"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Guide\ntext\n## Part\nmore")
    (tmp_path / "b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "empty.txt").write_text("  ")
    scan = files.scan(spark, str(tmp_path)).cache()
    d = {x.source.rsplit("/", 1)[1]: x for x in files.documents(scan).collect()}
    assert d["a.md"].title == "Guide" and d["a.md"].headings == ["Guide", "Part"] and d["b.py"].language == "python" and "empty.txt" not in d
    prints = files.fingerprints(scan)
    assert files.changed(prints, prints).count() == 0 and files.changed(prints, prints.limit(0)).count() == 3


def test_records(spark, tmp_path):
    p = tmp_path / "posts.jsonl"
    p.write_text('{"post_id":"1","text":"hi","source":"x","engagement":{"likes":2}}\n{"post_id":"1","text":"again"}\n{"url":"u","summary":"s"}\n')
    got = {x.record_key: x for x in records.posts(records.json_lines(spark, str(p))).collect()}
    assert set(got) == {"1", "u"} and got["1"].content == "hi" and got["1"].engagement.likes == 2
    q = tmp_path / "m.json"
    q.write_text('{"memories":[{"id":"m1","messages":[{"role":"user","content":" a "},{"role":"assistant","content":"b"}]},{"id":"m2","note":"n"}]}')
    m = {x.memory_id: x.content for x in records.memories(records.json_documents(spark, str(q))).collect()}
    assert m == {"m1": "user: a\nassistant: b", "m2": "n"}
    out = str(tmp_path / "store")
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string")
    assert sinks.append_new(spark, rows, out, "id", dry_run=False).count() >= 0
    assert sinks.append_new(spark, rows, out, "id").count() == 0
    assert records.page_text(F.lit("<p>a&amp;b</p><script>x</script><br>c")) is not None


def test_search_results(spark):
    d = spark.sql("SELECT 'q' AS query, array(struct('t' AS title, 'u1' AS url, 'a' AS content, CAST(NULL AS double) AS score), struct('t' AS title, 'u1' AS url, 'b' AS content, 0.5D AS score), struct('t' AS title, 'u2' AS url, 'c' AS content, 0.1D AS score)) AS results")
    r = records.search_results(d)
    assert r.where("position = 0").first().score == 1.0
    assert {x.url: x.content for x in records.by_url(r, "last").collect()} == {"u1": "b", "u2": "c"}
    assert {x.url: x.text for x in records.stitched(r).collect()}["u1"] == "a\n\n...\n\nb"


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    table(spark, DATA, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(folder)
    s = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(folder)
    q = streams.daily_counts(s, "ts", "event_type").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(events) FROM days").first()[0] == table(spark, DATA, "events").count()
    pending = str(tmp_path / "pending")
    spark.createDataFrame([("a", "pending"), ("b", "indexed"), ("a", "pending")], "memory_id string, index_status string").write.parquet(pending)
    done = []
    st = spark.readStream.schema("memory_id string, index_status string").parquet(pending)
    q = streams.index_pending(st, lambda d: None, lambda d: done.extend(r.memory_id for r in d.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert done == ["a"]


def test_positions_span_partitions(spark):
    from lodestream.operators import ordering

    rows = [("hot", i, i % 3 == 0) for i in range(500)] + [("b", 1, True), (None, 5, True), (None, 4, True)]
    d = spark.createDataFrame(rows, "k string, o int, flag boolean")
    n = {(r.k, r.o): r.n for r in ordering.numbered(d, "k", "o").collect()}
    assert all(n["hot", i] == i + 1 for i in range(500)) and n["b", 1] == 1 and n[None, 4] == 1 and n[None, 5] == 2
    laid = ordering.laid(d, "k", "o")
    last = {(r.k, r.o): r.last for r in ordering.last_before(laid, "k", ("o",), F.when(F.col("flag"), F.col("o")), "last").collect()}
    assert last["hot", 0] is None and all(last["hot", i] == (i - 1) // 3 * 3 for i in range(1, 500))
    assert ordering.numbered(d.limit(0), "k", "o").count() == 0


def test_bm25_block_and_join_agree(spark, monkeypatch):
    docs, cases = table(spark, DATA, "documents"), table(spark, DATA, "rag_eval_cases")
    run = lambda: {(r.query, r.doc_id, r.score) for r in retrieval.bm25(docs, "doc_id", "text", cases, "id", "query").collect()}
    block = run()
    monkeypatch.setattr(retrieval, "MOST_CELLS", 0)
    assert block == run() and block


def test_vectors_in_blocks_and_joined_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id int, v array<double>")
    for metric in ("cosine", "ip", "l2"):
        want = retrieval.vector_top(v, "id", "v", v.where("id % 50 = 0"), metric, 5).collect()
        m = {i: np.array(x) for i, x in rows if x and len(x) == 4}

        def score(a, b, metric=metric):
            if metric == "l2":
                return -float(np.sqrt(((a - b) ** 2).sum()))
            return float(a @ b) / (1 if metric == "ip" else (np.linalg.norm(a) * np.linalg.norm(b) or 1))

        for q in (0, 50, 250):
            best = sorted(((-round(score(m[i], m[q]), 6), i) for i in m if i != q))[:5]
            assert [r.id for r in sorted(want, key=lambda r: r.rank) if r["query"] == q] == [i for _, i in best]
        monkeypatch.setattr(retrieval, "MOST_CELLS", 8)
        joined = retrieval.vector_top(v, "id", "v", v.where("id % 50 = 0"), metric, 5).collect()
        monkeypatch.undo()
        assert sorted(joined) == sorted(want)
    assert retrieval.vector_top(v, "id", "v", v.limit(0), "ip").count() == 0 and retrieval.vector_top(v.limit(0), "id", "v", v, "ip").count() == 0


def test_vendor_records(spark, tmp_path):
    items = [
        {"postId": "1", "text": "first", "likeCount": "1,204", "author": {"nickname": "Ann"}, "url": "u1", "hashtags": ["a"]},
        {"postId": "2", "caption": "again", "url": "u1"}, {"noteId": "7", "desc": "by id", "playCount": 3.9, "userName": "Bo"}, {"desc": "nothing else"},
    ]
    (tmp_path / "a.jsonl").write_text(json.dumps(items[:2]) + "\n" + json.dumps({"records": items[2:3]}) + "\n" + json.dumps(items[3]) + "\nnot json\n")
    got = {r.content: r for r in records.vendor_posts(records.json_lines(spark, str(tmp_path)), "x").collect()}
    assert set(got) == {"first", "by id", "nothing else"}
    assert (got["first"].id, got["first"].author, got["first"].engagement.likes, got["first"].tags) == ("x-1", "Ann", 1204, ["a"])
    assert (got["by id"].id, got["by id"].engagement_score, got["by id"].author_id) == ("x-7", 3, "Bo")
    assert len(got["nothing else"].external_id) == 24
    d = spark.createDataFrame([("mysql://u:secret@h/db", "-1,200.9"), ("plain", "x")], "u string, n string").select(records.masked_url(F.col("u")).alias("u"), records.whole_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in d] == [("mysql://u:***@h/db", -1200), ("plain", None)]


def test_usage_of_messages(spark):
    d = spark.createDataFrame([('{"usage_metadata": {"input_tokens": 0}, "response_metadata": {"usage": {"prompt_tokens": 7, "completion_tokens": 3}}}',), ('{"usage_metadata": {"total_tokens": 9}}',), ("{}",)], "j string")
    m = d.select(F.parse_json("j").alias("m"))
    assert [tuple(r) for r in m.select(*accounting.token_usage("m")).collect()] == [(7, 3, 10), (0, 0, 9), (0, 0, 0)]
    lists = spark.range(1).select(accounting.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))), accounting.list_difference(F.array(F.lit(1), F.lit(2), F.lit(2)), F.array(F.lit(1))), memory.kinds_of(F.array(F.lit(" A"), F.lit("a"), F.lit("")))).first()
    assert list(lists) == [["b", "a", "c"], [2, 2], ["a"]]


def test_means_with_latency(spark):
    cases = spark.createDataFrame([("a", 1.0, 1.0, 0.5, 1.0)], "query string, hit double, recall double, precision double, mrr double").withColumn("kind", F.lit("x"))
    asked = spark.createDataFrame([("a", "x", 10.0), ("b", "x", 30.0), ("c", "y", 20.0)], "query string, kind string, ms double")
    got = {r.kind: (r.asked, r.cases, r.hit, r.ms) for r in evaluation.with_latency(cases, asked, "kind").collect()}
    assert got == {"x": (2, 1, 1.0, 20.0), "y": (1, 0, None, 20.0), None: (3, 1, 1.0, 20.0)}
    judged = spark.createDataFrame([("r", 5.0, 2, 2), ("r", 3.0, 1, 2), ("s", 0.0, 0, 0)], "run string, mark double, grounded int, claims int")
    assert {r.run: (r.score, r.groundedness) for r in evaluation.judge_scores(judged, "run").collect()} == {"r": (0.8, 0.75), "s": (0.0, 1.0)}
