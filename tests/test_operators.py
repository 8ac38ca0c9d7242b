"""Rules of single operators on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunking as C
from sparkloom.operators import graph as G
from sparkloom.operators import joins as J
from sparkloom.operators import listing as L
from sparkloom.operators import memory as M
from sparkloom.operators import quality as Q
from sparkloom.operators import retrieval as R
from sparkloom.operators.usage import usage_report
from sparkloom.sources import files as S
from sparkloom.storage import stored

CALL = "id long, user_id string, model string, status string, prompt_tokens int, completion_tokens int, total_tokens int, cost_usd double"


def test_usage_report_golden(spark):
    rows = [(1, "member-1", "chat", "success", 10, 5, 15, 0.1), (2, "member-1", "glm", "failed", 4, 0, 4, 0.0), (3, "member-2", "chat", "success", 1, 1, 2, 0.0), (4, None, "chat", "success", 0, 0, 0, 0.0)]
    got = usage_report(spark.createDataFrame(rows, CALL)).collect()
    total = next(r for r in got if r.grouping == "total")
    assert (total.total_tokens, total.calls, total.failed_calls) == (21, 4, 1)
    assert {(r.user_id, r.total_tokens) for r in got if r.grouping == "user"} == {("member-1", 19), ("member-2", 2), (None, 0)}


def test_usage_report_of_nothing_has_totals(spark):
    got = usage_report(spark.createDataFrame([], CALL)).collect()
    assert [(r.grouping, r.total_tokens, r.calls) for r in got] == [("total", 0, 0)]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, rank int, source string, parent_id string")


def test_fusion_golden(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "c", 1), (1, 1, "a", 2)]
    got = R.fuse(spark.createDataFrame(rows, "query_id int, leg int, id string, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "c", "b"]
    both = R.fuse(spark.createDataFrame([(1, 0, "a", 1), (1, 1, "a", 1)], "query_id int, leg int, id string, rank int")).first()
    assert both.rrf_score == pytest.approx(2 / 61)
    with pytest.raises(ValueError):
        R.fuse(spark.createDataFrame(rows, "query_id int, leg int, id string, rank int"), k=0)


def test_collapse_golden(spark):
    got = R.collapse(hits(spark, [(1, "c1", 1, "s", "p1"), (1, "c2", 2, "s", "p1"), (1, "c3", 3, "s", "p2"), (1, "c4", 4, "s", "")])).orderBy("rank").collect()
    assert [(r.id, r.collapsed_siblings) for r in got] == [("c1", 1), ("c3", None), ("c4", None)]


@pytest.mark.parametrize(
    "sources, most, limit, over, kept, rest",
    [
        ("b" * 10 + "sss", 3, 6, 0, [0, 1, 2, 10, 11, 12], []),
        ("b" * 5, 3, 5, 3, [0, 1, 2, 3, 4], []),
        ("b" * 6 + "cdefghijklmn", 3, 5, 3, [0, 1, 2, 6, 7], [3, 4, 5]),
        ("abca", 1, 2, 5, [0, 1], []),
        ("b" * 9, 1, 3, 2, [0, 1, 2], [3, 4]),
    ],
)
def test_quota_golden(spark, sources, most, limit, over, kept, rest):
    got = R.quota(hits(spark, [(1, str(k), k + 1, s, "") for k, s in enumerate(sources)]), most, limit, over).orderBy("place").collect()
    assert [int(r.id) for r in got if r.role == "kept"] == kept
    assert [int(r.id) for r in got if r.role == "overflow"] == rest


def greedy(sources, most, limit, over):
    kept, skipped, seen = [], [], {}
    for k, s in enumerate(sources):
        if len(kept) == limit:
            break
        if seen.get(s, 0) < most:
            seen[s] = seen.get(s, 0) + 1
            kept.append(k)
        else:
            skipped.append(k)
    fill = limit - len(kept)
    return kept + skipped[:fill], skipped[fill:][:over]


def test_quota_against_greedy(spark):
    rng = random.Random(3)
    cases = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))) for _ in range(60)]
    df = hits(spark, [(q, str(k), k + 1, s, "") for q, c in enumerate(cases) for k, s in enumerate(c)])
    got = R.quota(df, 2, 6, 2).orderBy("query_id", "place").collect()
    for q, c in enumerate(cases):
        kept, rest = greedy(c, 2, 6, 2)
        assert [int(r.id) for r in got if r.query_id == q and r.role == "kept"] == kept, c
        assert [int(r.id) for r in got if r.query_id == q and r.role == "overflow"] == rest, c


def test_packing_against_letters():
    assert list(C.packed(["abc。", "de。"], 5, 0)) == ["abc。", "de。"]
    assert list(C.packed(["abcdefghij"], 4, 0)) == ["abcdefghij"]  # an oversize first sentence isn't cut
    assert list(C.packed(["a。", "bcdefghij"], 4, 0)) == ["a。", "bcde", "fghi", "j"]
    assert list(C.packed(["a。", "bcdefghij"], 4, 1)) == ["a。", "bcde", "efgh", "hij"]
    assert list(C.packed(["ab。", "cd。"], 4, 1)) == ["ab。", "。\ncd。"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "p", ["第一章 总则", "第一条 甲。" + "乙" * 30 + "。", "丙。", "第二条 丁。"])], "doc_id int, source_path string, paragraphs array<string>")
    rows = C.chunks(docs, 400, 0, 20).orderBy("chunk_index").collect()
    assert [r.section for r in rows] == ["第一条"] * (len(rows) - 1) + ["第二条"]
    assert len({r.id for r in rows}) == len(rows) and rows[-1].parent_text == "" and len({r.parent_id for r in rows}) == 2
    assert all(len(r.id) == 20 for r in rows)
    with pytest.raises(ValueError):
        C.chunks(docs, 10, 0, 20)


def native_chunks(docs, size, overlap, child):
    """The same by the column functions and windows: clauses, pieces of clauses, pieces of pieces."""
    order = Window.partitionBy("doc_id").orderBy("clause_no", "p")
    found = C.clauses(docs).select("doc_id", "clause_no", "section", F.posexplode(C.pieces(F.col("text"), size, 0)).alias("p", "parent"))
    parents = found.withColumn("parent_index", F.row_number().over(order) - 1)
    rows = parents.select("doc_id", "section", "parent", "parent_index", F.posexplode(C.pieces(F.col("parent"), child, overlap)).alias("c", "text"))
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "c")) - 1)


def test_chunks_against_column_functions(spark):
    rng = random.Random(12)
    lines = ["第一章 总则", "第十二条 甲。", " 第 3 条　短", "第条 空", "乙" * 50 + "。", "丙；丁！ ？戊", "a b. c;d", "。；", "\t", "", "第二节 " + "长" * 70, "第5条" + "字" * 130, "尾 \u2003", "x\x85第7条", "第8条 y\rz", "己。庚" * 30]
    rows = [(k, f"p{k}", [rng.choice(lines) for _ in range(rng.randint(0, 12))]) for k in range(120)] + [(200, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id int, source_path string, paragraphs array<string>")
    for size, overlap, child in ((40, 0, 15), (400, 5, 30)):
        want = {(r.doc_id, r.chunk_index): (r.section, r.text, "" if r.text == r.parent else r.parent) for r in native_chunks(docs, size, overlap, child).collect()}
        got = {(r.doc_id, r.chunk_index): (r.section, r.text, r.parent_text) for r in C.chunks(docs, size, overlap, child).collect()}
        assert len(want) > 300 and got == want
    assert "Exchange" not in C.chunks(docs, 40, 0, 15)._jdf.queryExecution().executedPlan().toString()


def test_batches_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(k % 7, k, "t" * rng.randint(0, 90), "s" * rng.randint(0, 20)) for k in range(300)] + [(9, 999, "z" * 5000, "s")]
    got = {(r.key, r.ord): (r.batch, r.ref) for r in C.batches(spark.createDataFrame(rows, "key int, ord int, t string, x string"), "key", "ord", "t", "x", most=6, most_chars=300).collect()}
    for key in {r[0] for r in rows}:
        batch, held = 0, []
        for _, at, t, x in sorted(r for r in rows if r[0] == key):
            cost = len(t) + len(x) + 8
            if held and (len(held) == 6 or sum(held) + cost > 300):
                batch, held = batch + 1, []
            held.append(cost)
            assert got[key, at] == (batch, f"c{len(held)}")


def test_sequence_ratio(spark):
    import difflib

    rng = random.Random(5)
    rows = [("".join(rng.choices("abcd 税", k=rng.randint(0, 30))), "".join(rng.choices("abcd 税", k=rng.randint(0, 30)))) for _ in range(200)] + [(None, "a"), ("", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r.r == difflib.SequenceMatcher(None, r.a or "", r.b or "").ratio() for r in got)


def test_cosine_against_a_loop(spark):
    import math

    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(300)] + [(900, None), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    length = lambda v: math.sqrt(sum(x * x for x in v))
    full = {k: v for k, v in rows if k is not None and v and length(v)}
    for block in (4096, 7):
        got = R.cosine_top_k(df.filter("id % 20 = 0").selectExpr("id AS query_id", "vector"), df, 9, block).collect()
        for q in (k for k in full if k % 20 == 0):
            want = sorted(full, key=lambda k: (-round(sum(x * y for x, y in zip(full[q], full[k])) / length(full[q]) / length(full[k]), 9), k))[:9]
            assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert R.cosine_top_k(df.limit(0).selectExpr("id AS query_id", "vector"), df, 3).count() == 0


def test_ranks_of_a_skewed_column(spark):
    df = spark.range(1000).selectExpr("id * id * id AS v", "id AS k").union(spark.range(200).selectExpr("1000000000000 + id AS v", "id + 1000 AS k"))
    got = sorted((r.v, r["rank"]) for r in C.ranks(df, "v").collect())
    assert [n for _, n in got] == list(range(1200))


def brute_memories(rows, threshold, candidates):
    import difflib

    out = []
    for _, kind, scope, key, content, importance, tags, request, at in sorted(rows, key=lambda r: r[8]):
        norm = "".join(c for c in (content or "").lower() if c.isalnum())
        group = [m for m in out if m["where"] == (kind, scope, key)]
        hit = None
        for m in sorted(group, key=lambda m: (-m["importance"], -m["ord"]))[:candidates]:
            if norm and m["key"] and (norm == m["key"] or difflib.SequenceMatcher(None, m["key"], norm).ratio() >= threshold):
                hit = m
                break
        if hit is None:
            out.append({"where": (kind, scope, key), "key": norm, "content": content, "importance": importance, "ord": at, "n": 0, "id": _})
        else:
            if len(content) > len(hit["content"]):
                hit["content"], hit["key"] = content, norm
            hit["importance"], hit["n"] = max(hit["importance"], importance), hit["n"] + 1
    return {m["id"]: (m["where"][2], m["content"], m["importance"], m["n"]) for m in out}


def test_memories_against_a_loop(spark):
    rng = random.Random(8)
    words = ["likes", "tea", "coffee", "short", "answers", "lives in", "Rome", "Oslo"]
    rows = [(k, "fact", "user", f"u{k % 5}", " ".join(rng.choices(words, k=rng.randint(0, 5))) + rng.choice(["", "!", "."]), rng.randint(1, 5), [], f"r{k}", k) for k in range(250)]
    schema = "id long, memory_type string, scope string, scope_key string, content string, importance int, tags array<string>, request_id string, ord long"
    for threshold, candidates in ((0.85, 200), (0.7, 3)):
        got = {r.id: (r.scope_key, r.content, r.importance, r.merge_count) for r in M.merged(spark.createDataFrame(rows, schema).repartition(6), threshold, candidates).collect()}
        assert got == brute_memories(rows, threshold, candidates)


def test_memories_merge(spark):
    schema = "id long, memory_type string, scope string, scope_key string, content string, importance int, tags array<string>, request_id string, ord long"
    rows = [(1, "fact", "user", "u", "Prefers short answers.", 3, ["style"], "req-a", 1), (2, "fact", "user", "u", "prefers SHORT answers", 5, ["tone"], "req-b", 2), (3, "fact", "user", "u", "Lives in Rome", 1, None, "req-c", 3)]
    got = {r.id: r for r in M.merged(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3} and (got[1].importance, got[1].tags, got[1].merge_count, got[1].requests) == (5, "style,tone", 1, '["req-a", "req-b"]')


def test_interleave(spark):
    rows = [(1, 0, 1, "v1"), (1, 0, 2, "v2"), (1, 1, 1, "b1"), (1, 1, 2, "v1")]
    got = R.interleave(spark.createDataFrame(rows, "query_id int, leg int, rank int, key string"), 3).orderBy("place").collect()
    assert [r.key for r in got] == ["v1", "b1", "v2"]


def test_degrees_golden(spark):
    got = Q.degree_summary(spark.createDataFrame([(k,) for k in range(1, 6)], "degree int"), hubs=(2, 4)).first()
    assert (got.p50, got.p90, got.mean, got.singleton_ratio, got.hub_2, got.hub_4) == (3, 5, 3.0, 0.2, 4, 2)


def test_ranked_neighbours_golden(spark):
    rows = [("s1", "a", 2), ("s2", "a", 2), ("s1", "b", 3), ("s1", None, 9), ("s1", "", 9), ("s1", "c", None)]
    got = G.ranked_neighbours(spark.createDataFrame(rows, "seed string, clause_id string, weight int"), "cites", 10).orderBy("rank").collect()
    assert [(r.clause_id, r.weight, r.seeds) for r in got] == [("a", 4, 2), ("b", 3, 1), ("c", 0, 1)]


def test_merged_metadata(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "o map<string,string>, n map<string,string>")
    assert df.select(J.merged_metadata(F.col("o"), F.col("n")).alias("m")).first().m == {"a": "1", "b": "3"}


def test_listing_rejects_unknown_filters(spark, sf):
    with pytest.raises(ValueError):
        L.LISTINGS["reviews"].matching(spark.range(1), colour="red")


def test_citation_quirk_is_kept(spark):
    got = spark.range(1).select(X.citations(F.lit("取得本法第三条和企业所得税法第二条")).alias("c")).first().c
    assert [(c.law, c.article) for c in got] == [("取得本法第三条和企业所得税法", 2)]


def test_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "1_a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one </w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "~$lock.docx").write_bytes(b"")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert S.discover(spark, str(tmp_path)).count() == 2
    got = {r.path.rsplit("/", 1)[1]: r for r in S.parsed(spark, str(tmp_path)).collect()}
    assert got["1_a.docx"].paragraphs == ["one", "x | y"] and got["bad.xlsx"].error


def test_snapshots(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","title":"t"}\n\n{"id":"2","metadata_payload":{"section":"s"}}\n')
    assert {(r.id, r.title, r.section) for r in S.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()} == {("1", "t", ""), ("2", "", "s")}
    (tmp_path / "e.jsonl").write_text('{"doc_id":"d","status":"ok"}\n{broken\n')
    assert S.read_entities(spark, str(tmp_path / "e.jsonl")).count() == 1
    (tmp_path / "s.jsonl").write_text("")
    with pytest.raises(ValueError):
        S.read_samples(spark, str(tmp_path / "s.jsonl"))


def test_streams(spark, sf, tmp_path):
    from sparkloom.streaming import rollups as T

    source = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(source))
    T.run_available(T.windowed_usage(T.event_stream(spark, str(source), 10), "1 day", late="90 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    stream = T.windowed_usage(T.event_stream(spark, str(source), 10), "1 day").writeStream.format("memory").queryName("usage").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    total = spark.sql("SELECT sum(calls) AS n FROM usage").first().n
    assert total == spark.read.parquet(f"{sf}/events.parquet").count()


def test_stream_sessions_requests_and_beats(spark, tmp_path):
    import datetime as dt
    import time

    from sparkloom.streaming import rollups as T

    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [(1, at(0), 7), (2, at(10), 7), (2, at(12), 7), (3, at(100), 7), (4, at(0), 8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, make, mode):
        stream = make(spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
        for _ in range(120):  # timers keep the last one busy, so its end isn't awaited
            time.sleep(0.5)
            if len(spark.sql(f"SELECT * FROM {name}").take(2)) == 2 or query.exception():
                break
        query.stop()
        return spark.sql(f"SELECT * FROM {name}").collect()

    got = run("user_sessions", lambda e: T.user_sessions(e, "30 minutes", "1 day"), "complete")
    assert sorted((r.user_id, r.start, r.calls) for r in got) == [(7, at(0), 3), (7, at(100), 1), (8, at(0), 1)]
    assert sorted(r.event_id for r in run("new_requests", lambda e: T.new_requests(e, "event_id", "1 day"), "append")) == [1, 2, 3, 4]
    beats = run("beats", lambda e: T.latest_beats(e.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("beat_at")), 3_600_000), "update")
    assert sorted((r.worker_id, r.beat_at, r.live) for r in beats) == [(7, at(100), True), (8, at(0), True)]
    requests = lambda e: e.select(F.col("event_id").alias("request_id"), "ts")
    replies = lambda e: e.select((F.col("event_id") - 1).alias("request_id"), F.col("ts").alias("answered_at"))
    pairs = run("answered", lambda e: T.answered(requests(e), replies(e), "20 minutes", "1 day"), "append")
    assert sorted((r.request_id, r.ts, r.answered_at) for r in pairs) == [(1, at(0), at(10)), (1, at(0), at(12))]


def test_endpoints_of_whole_documents_are_not_shuffled(spark):
    rows = [(k, str(k), "甲税法", "正文", "s", "", "", f"第{k + 1}条") for k in range(5)]
    clause_rows = G.clauses(spark.createDataFrame(rows, "ord long, id string, title string, content string, source string, parent_id string, parent_text string, section string"))
    texts = [(1, "见《甲税法》，另见《甲税法》。"), (1, "见《甲税法》。"), (2, "依《甲税法》第2条，见《乙规》。"), (3, "依《甲税法》第77条。")]
    out = G.endpoints(spark.createDataFrame(texts, "sample_id long, text string"), clause_rows)
    # the rows of whole documents come last: nothing gathers samples times clauses again
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    found = sorted((r["sample_id"], r["label"], r["clause_id"] or "") for r in out.collect())
    whole = [str(k) for k in range(5)]
    assert found == sorted([*((1, "《甲税法》", c) for c in whole), (2, "《甲税法》第2条", "1"), (2, "《乙规》", ""), (3, "《甲税法》第77条", ""), *((3, "《甲税法》", c) for c in whole)])


def test_endpoints_of_one_document_are_dealt_over_tasks(spark, monkeypatch):
    for name, value in {"SLICE": 20, "MOST_SLICES": 8, "BLOCK": 10, "PART_BLOCKS": 2, "WHOLE_ROWS": 400}.items():
        monkeypatch.setattr(G, name, value, raising=False)
    schema = "clause_id string, ord long, doc_id string, title string, article long"
    ids = [None, *map(str, range(60))]
    clause_rows = spark.createDataFrame([(c, k, "a", "甲税法", None) for k, c in enumerate(ids)] + [("b1", 100, "b", "乙税法", None), ("c1", 101, "c", "丙税法", None)], schema)
    texts = [(k, "见《甲税法》。") for k in range(300)] + [(1000, "见《丁规》，又见《乙税法》。"), (1001, "见《新甲税法》。")]
    out = G.endpoints(spark.createDataFrame(texts, "sample_id long, text string"), clause_rows)
    found = Counter((r["sample_id"], r["label"], r["clause_id"]) for r in out.collect())
    want = [(k, "《甲税法》", c) for k in range(300) for c in ids] + [(1001, "《新甲税法》", c) for c in ids]
    assert found == Counter([*want, (1000, "《丁规》", None), (1000, "《乙税法》", "b1")])
    # all ask for one document, yet no task makes most of the rows
    tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert max(r["count"] for r in tasks) < len(want) / 4
    blocks = G.endpoints(spark.createDataFrame(texts, "sample_id long, text string"), clause_rows, in_blocks=True)
    assert Counter((r["sample_id"], r["label"], c) for r in blocks.collect() for c in r["ids"]) == found
    assert blocks.agg(F.max(F.size("ids")).alias("n")).first()["n"] < 30


def test_review_chain_stores_no_roots_again(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    # 1 <- 2 <- ... <- 20; roots alone; one of an unknown source; a circle and what leads into it
    rows = [(1, None), *((k, k - 1) for k in range(2, 21)), *((k, None) for k in range(100, 200)), (300, 999), (400, 401), (401, 400), (402, 400)]
    found = {(r.id, r.root, r.depth) for r in J.review_chain(spark.createDataFrame(rows, "id long, source_review_id long")).collect()}
    assert found == {*((k, 1, k - 1) for k in range(1, 21)), *((k, k, 0) for k in range(100, 200)), (300, 300, 0)}
    assert max(df.count() for df in seen) < 30


def test_validated_entities_order_no_rows(spark):
    rows = [(1, 1, 1, k, "tax_type", f"name{n}") for k, n in enumerate([1, 1, 2, 3, 4, 1, 3, 4, 2])] + [(1, 1, 1, 20, "other?", "name1"), (1, 1, 1, 21, "tax_type", "x"), (1, 2, None, 1, "tax_type", "name1")]
    rows += [(2, 1, 1, 5, "tax_type", "same"), (2, 1, 1, 5, "tax_type", "same"), (None, 1, 1, None, "tax_type", "name1"), (None, 1, 1, 1, "tax_type", "name1")]
    answers = spark.createDataFrame(rows, "doc_id long, ref long, clause_id long, place long, type string, name string")
    out = Q.validated_entities(answers.filter("doc_id = 1"), most=3)
    assert "Window [" not in out._jdf.queryExecution().optimizedPlan().toString()
    verdicts = [(r.place, r.verdict) for r in out.filter("ref = 1").orderBy("place").collect()]
    assert verdicts == list(zip([*range(9), 20, 21], ["kept", "duplicates", "kept", "kept", "over_limit", "duplicates", "duplicates", "over_limit", "duplicates", "unknown_types", "invalid_names"]))
    rest = Q.validated_entities(answers.filter("doc_id IS NULL OR doc_id = 2"), most=3)
    assert sorted((r.doc_id or 0, r.verdict) for r in rest.collect()) == [(0, "duplicates"), (0, "kept"), (2, "duplicates"), (2, "kept")]


def test_audit_samples_take_both_kinds_in_one_pass(spark):
    mentions = spark.createDataFrame([(k, k % 3, "t", "abcd" if k % 2 else "zz") for k in range(40)], "ord long, clause_id long, type string, name string")
    out = Q.audit_samples(Q.audited_mentions(mentions, spark.createDataFrame([(0, "x abc"), (1, "y")], "clause_id long, text string")), 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted((r.kind, r.ord, r.degree) for r in out.collect()) == [("absent", 0, 20), ("absent", 1, 20), ("partial", 3, 20), ("partial", 9, 20)]
