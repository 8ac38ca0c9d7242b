"""Vector and text indexes, segmentation, similar statements, hub joins and selection, against plain searches and brute force."""

import difflib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, quality, retrieval, segmentation, similar, text_index, vector_index


@pytest.fixture(scope="module")
def crowded(spark):
    """Vectors in clusters, a third of all equal, some without a direction; queries among them and apart."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    rows = [(k, (middles[k % 12] + 0.5 * rng.normal(size=16)).tolist()) for k in range(600)] + [(1000 + k, [1.0] * 16) for k in range(300)]
    rows += [(2000, None), (2001, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = [(k, rows[k][1]) for k in range(0, 600, 7)] + [(5000, [1.0] * 16), (5001, None), (5002, [0.0] * 16), (5003, (-middles[0]).tolist())]
    return vectors, spark.createDataFrame(asked, "query_id long, vector array<double>")


def listed(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.id, round(r.score, 9)))
    return dict(out)


def test_vector_index_against_all_vectors(crowded):
    vectors, queries = crowded
    exact = listed(retrieval.cosine_top_k(queries, vectors, 10))
    index = vector_index.build(vectors, cell_rows=40)
    assert index.rows.count() == 900 and index.cells.agg(F.sum("n")).first()[0] == 900
    # the equal vectors' cell lies in parts of bounded size; ids tell them apart
    assert max(r["count"] for r in index.rows.groupBy("cell", "part").count().collect()) < 120
    probes = vector_index.probes_for(index, queries, 10)
    assert probes < len(index.centers)
    near = listed(vector_index.search(index, queries, 10, probes))
    shares = [len({i for i, _ in near.get(q, [])} & {i for i, _ in want}) / len(want) for q, want in exact.items()]
    assert sum(shares) / len(shares) >= 0.9
    assert listed(vector_index.search_exact(index, queries, 10, 1)) == exact
    assert listed(vector_index.search(index, queries, 10, len(index.centers))) == exact


def test_vector_index_in_small_blocks(crowded):
    """Queries of a cell in several blocks: the same result."""
    vectors, queries = crowded
    index = vector_index.build(vectors, cells=3, cell_rows=100)
    pairs = vector_index.nearest_cells(index, queries, 2).select("query_id", "vector", F.explode("cells").alias("cell"))
    one, many = (listed(vector_index.ranked(vector_index.looked_into(index, pairs, 5, block), 5)) for block in (1024, 4))
    assert one == many and len(one) == 88


def test_recall_on_the_given_vectors(spark):
    """Every row whose id is divisible by 20, against all rows."""
    from sparkloom.plans import retrieval as plans

    sf = "/root/testdata/sf0.01"
    found = plans.QUERIES["r06_ivf_top_k"](spark, sf).groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    exact = plans.QUERIES["r06_cosine_top_k"](spark, sf).groupBy("query_id").agg(F.collect_set("id").alias("want"))
    shares = [r[0] for r in exact.join(found, "query_id", "left").select(F.size(F.array_intersect("want", F.coalesce("ids", F.array().cast("array<bigint>")))) / F.size("want")).collect()]
    assert len(shares) == 25 and sum(shares) / len(shares) >= 0.9


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    index = vector_index.build(none)
    assert vector_index.search(index, asked, 3, 2).count() == 0
    index = vector_index.build(spark.createDataFrame([(7, [2.0, 0.0])], "id long, vector array<double>"))
    assert listed(vector_index.search_exact(index, asked, 3, 1)) == {1: [(7, 1.0)]} and vector_index.probes_for(index, asked, 3) == 1


def brute_bm25(docs, queries, top_k):
    tokens = lambda t: [w for w in t.lower().split() if w.isalnum()]
    toks = {i: tokens(f"{t} {c}") for i, _, t, c in docs}
    n, mean, out = len(docs), sum(map(len, toks.values())) / len(docs), {}
    df = Counter(w for ts in toks.values() for w in set(ts))
    for q, text in queries:
        scores = []
        for i, ts in toks.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for w in set(tokens(text)) if tf[w])
            if s > 0:
                scores.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(scores)[:top_k]]
    return {q: x for q, x in out.items() if x}


def test_block_index(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, i, rng.choice(["Ein", "Zwei"]), " ".join(rng.choices(words, weights, k=rng.choice([3, 8, 20, 60])))) for i in range(1500)] + [(9000, 9000, "", ""), (9001, 9001, "", "! ?")]
    queries = [(k, f"w{k % 6} w{rng.randrange(15, 60)}") for k in range(30)] + [(k, " ".join(rng.choices(words, k=5))) for k in range(50, 55)] + [(100, "w0 w1"), (101, "nothing"), (102, ""), (103, docs[5][3])]
    d, q = spark.createDataFrame(docs, "id long, ord long, title string, content string"), spark.createDataFrame(queries, "query_id long, query string")
    index = text_index.build(d, range_docs=8)
    assert max(r.n for r in index.blocks.select(F.size("postings").alias("n")).collect()) < 40
    want = brute_bm25(docs, queries, 10)
    plain = retrieval.bm25(q, d, 10)
    for first in (1, 16):
        found, figures = text_index.search(index, q, 10, first=first)
        got = {k: [i for i, _ in v] for k, v in listed(found).items()}
        assert got == want == {k: [i for i, _ in v] for k, v in listed(plain).items()}
        sums = figures.agg(F.sum("blocks"), F.sum("looked_into")).first()
        assert 0 < sums[1] < 0.8 * sums[0]  # blocks were left out
    empty, _ = text_index.search(text_index.build(d.limit(0)), q, 10)
    assert empty.count() == 0


def test_block_index_moves_no_postings(spark, monkeypatch):
    """Blocks are made where texts are read, and a range's blocks are what meets: nothing is dealt by term or by pairs of queries and documents."""
    plans, kept = [], text_index.stored
    monkeypatch.setattr(text_index, "stored", lambda df: plans.append((set(df.columns), df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString())) or kept(df))
    docs = spark.createDataFrame([(k, k, "T", f"w{k % 7} w{k % 5} v{k}") for k in range(200)], "id long, ord long, title string, content string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3 v17")], "query_id long, query string")
    found, _ = text_index.search(text_index.build(docs, range_docs=8), asked, 3, first=1)
    assert listed(found) == listed(retrieval.bm25(asked, docs, 3))
    (made,) = (plan for columns, _, plan in plans if "postings" in columns)
    assert "Exchange" not in made
    scored = [plan for columns, plan, _ in plans if columns == {"query_id", "id", "ord", "score"}]
    assert scored and all("FlatMapCoGroupsInArrow" in plan for plan in scored)


def test_block_index_of_repeated_documents(spark):
    """Documents that share id and ord, of one length and of several, are added up as in the plain search, whatever range they are in."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, i, "T", " ".join(rng.choices(words, k=rng.choice([2, 5, 30])))) for i in range(300)]
    docs += [(i, i, "T", " ".join(rng.choices(words, k=rng.choice([2, 9])))) for i in range(0, 300, 6) for _ in range(3)] + [(None, 900, "T", "w1 w2"), (None, 900, "T", "w1 w3 w4"), (12, 12, "T", docs[12][3])]
    d = spark.createDataFrame(docs, "id long, ord long, title string, content string")
    q = spark.createDataFrame([(k, " ".join(rng.choices(words, k=3))) for k in range(12)] + [(None, "w1 w2"), (90, "w1 w1")], "query_id long, query string")
    rows = lambda df: sorted((r.query_id or -1, r["rank"], r.id or -1, r.score) for r in df.collect())
    want = rows(retrieval.bm25(q, d, 5))
    for piece in (text_index.PIECE_WORDS, 100):
        index = text_index.build(d, range_docs=4, piece_words=piece)
        assert rows(text_index.search(index, q, 5, first=1)[0]) == want


def brute_paths(run, weights, alone):
    """All ways to cut a run; a character that begins no word stands alone."""
    if not run:
        yield 0.0, ()
    sizes = [n for n in range(1, len(run) + 1) if run[:n] in weights]
    for n in sizes or [1] * bool(run):
        for value, rest in brute_paths(run[n:], weights, alone):
            yield weights.get(run[:n], alone) + value, (run[:n], *rest)


def test_segmentation(spark):
    rng = random.Random(7)
    letters = "增值税专用发票"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    texts = [(k, "".join(rng.choices(letters, k=rng.randint(1, 9)))) for k in range(60)]
    table = spark.createDataFrame([*words.items(), ("税", 0), ("abc", 5), (None, 3)], "word string, freq long")
    total = sum(words.values())
    weights, alone = {w: math.log(f / total) for w, f in words.items()}, -math.log(total)
    got = {r.id: tuple(r.tokens) for r in segmentation.segmented(spark.createDataFrame(texts, "id long, text string"), table).collect()}
    for k, text in texts:
        paths = {p: v for v, p in brute_paths(text, weights, alone)}
        assert "".join(got[k]) == text and math.isclose(paths[got[k]], max(paths.values()), abs_tol=1e-9)


def test_segmentation_of_mixed_and_odd_texts(spark):
    table = spark.createDataFrame([("增值税", 9), ("增值", 2), ("税法", 3), ("税", 4)], "word string, freq long")
    rows = [(1, "《增值税法》第3条 ABC-12é"), (2, None), (3, " \n"), (4, "增" * 3000 + "税法"), (1, "税税")]
    got = defaultdict(list)
    for r in segmentation.segmented(spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS run", "2 AS row"), table).collect():
        got[r.id].append(r.tokens)
    assert sorted(got[1]) == sorted([["《", "增值税", "法", "》", "第", "3", "条", "abc", "-", "12é"], ["税", "税"]])
    assert got[2] == [[]] == got[3] and got[4][0] == ["增"] * 3000 + ["税法"]
    none = segmentation.segmented(spark.createDataFrame([(1, "税法x")], "id long, text string"), table.limit(0)).collect()
    assert [r.tokens for r in none] == [["税", "法", "x"]]


ENTRIES = "memory_type string, scope string, scope_key string, ord long, content string"


@pytest.mark.parametrize("ratio", [0.8, 0.95])
def test_similar_statements(spark, ratio):
    """All pairs whose ratio is large enough, whatever the lengths, and no others."""
    rng, rows = random.Random(11), []
    for k in range(160):
        base = "".join(rng.choices("abcdé字", k=rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 20, 60, 250])))
        rows.append(("fact", "user", rng.choice("xy"), len(rows), base))
        for _ in range(rng.randint(0, 2)):
            letters = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 8)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "Q"])
            rows.append(("fact", "user", rows[-1][2], len(rows), " ".join(["".join(letters), rng.choice(["", "!"])])))
    rows += [("fact", None, None, 900, "Null keys"), ("fact", None, None, 901, "null keys."), ("fact", "user", "x", 902, None), ("fact", "user", "x", 903, "?!")]
    known = similar.statements(spark.createDataFrame(rows, ENTRIES))
    mine = known.collect()
    want = set()
    for a, b in itertools.combinations(sorted(mine, key=lambda r: (r.ord, r.sid)), 2):
        if (a.memory_type, a.scope, a.scope_key) == (b.memory_type, b.scope, b.scope_key) and difflib.SequenceMatcher(None, a.key, b.key).ratio() >= ratio:
            want.add((a.sid, b.sid))
    assert {(r.first, r.second) for r in similar.similar(known, ratio).collect()} == want
    groups = {r.ord: r.group for r in similar.duplicate_statements(spark.createDataFrame(rows, ENTRIES), ratio).collect()}
    of = {r.sid: r.ord for r in mine}
    assert set(groups) == set(of.values()) and all(groups[of[a]] == groups[of[b]] for a, b in want) and groups[900] == 900 and 901 not in groups
    assert similar.duplicate_statements(spark.createDataFrame([], ENTRIES)).count() == 0


def test_hub_entities_are_met_in_parts(spark):
    """An entity with a third of all mentions: the same rows as without a split, and its mentions in many tasks."""
    rng = random.Random(3)
    rows = [(c, rng.randrange(60)) for c in range(400) for _ in range(3)] + [(c, 999) for c in range(400)] + [(c, 1000) for c in range(0, 400, 2)]
    mentions, seeds = spark.createDataFrame(rows, "clause_id long, entity_id long"), spark.createDataFrame([(c,) for c in range(0, 400, 20)], "seed long")
    for least, most in ((1, 5), (2, None), (3, 7)):
        split, plain = ({tuple(r) for r in graph.mentions_neighbours(mentions, seeds, least, most, heavy).collect()} for heavy in (25, 10**9))
        assert split == plain and split
    ends = spark.createDataFrame([(c // 50, c % 5, c) for c in range(400)], "sample long, endpoint long, clause_id long")
    split, plain = ({tuple(r) for r in graph.shared_entities(mentions, ends, heavy).collect()} for heavy in (5, 10**9))
    assert split == plain and split
    own = mentions.distinct()
    met = graph.met_by_entity(own.select(F.col("clause_id").alias("seed"), "entity_id").filter("seed % 20 = 0"), own, 25).filter("entity_id = 999")
    assert met.count() == 20 * 400
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) > 6 and max(r["count"] for r in tasks) < 4000


def test_neighbours_are_found_in_tasks_of_bounded_rows(spark, monkeypatch):
    """With few rows a task, seeds sent or not: the same rows, in as many tasks as the pairs need, whatever Spark would deal by bytes."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, *range(25)])) for _ in range(2500)]
    mentions, seeds = spark.createDataFrame(rows, "clause_id long, entity_id long"), spark.createDataFrame([(c,) for c in range(0, 300, 10)] + [(0,), (None,)], "seed long")
    own, chosen = set(rows), set(range(0, 300, 10))
    weights = Counter((a, b) for a, e in own if a in chosen for b, f in own if e == f and e is not None and b is not None)
    for sent in (True, False):
        if not sent:
            monkeypatch.setattr(graph, "small", lambda df: df)
        for apart in (True, False):
            want = sorted((a, b, n) for (a, b), n in weights.items() if n >= 2 and a != b and not (apart and b in chosen))
            found = graph.mentions_neighbours(mentions, seeds, 2, None, apart=apart, task_rows=1000)
            assert sorted(tuple(r) for r in found.collect()) == want
            best = [x for a in sorted(chosen) for x in sorted((x for x in want if x[0] == a), key=lambda x: (-x[2], x[1]))[:4]]
            assert sorted(tuple(r) for r in graph.mentions_neighbours(mentions, seeds, 2, 4, apart=apart, task_rows=1000).collect()) == sorted(best)
        pairs = sum(n for (a, b), n in weights.items())
        assert found.rdd.getNumPartitions() > pairs // 1000 > 4


@pytest.mark.parametrize("kind", ["long", "date"])
def test_exact_ranks_by_selection(spark, kind):
    """With few values ordered at a time, several passes; ties, nulls and null keys."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(10**6), rng.randrange(1000), 77])) for _ in range(6000)] + [("c", None), ("d", 5), ("d", 5), ("e", 1)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("v", F.expr("date_add(DATE'2000-01-01', cast(v as int))") if kind == "date" else F.col("v").cast(kind))
    shares = (0.0, 0.5, 0.9, 0.99, 1.0)
    got = {r.k: tuple(r[1:]) for r in quality.nearest_rank(df, "v", shares, ("k",), ordered=20, accuracy=100).collect()}
    by = defaultdict(list)
    for r in df.collect():
        if r.v is not None:
            by[r.k].append(r.v)
    at = lambda values, q: sorted(values)[min(len(values) - 1, round(q * (len(values) - 1)))]
    assert got == {k: tuple(at(v, q) for q in shares) for k, v in by.items()}
    every = [v for x in by.values() for v in x]
    assert tuple(quality.nearest_rank(df, "v", shares, ordered=20, accuracy=100).first()) == tuple(at(every, q) for q in shares)
    assert tuple(quality.nearest_rank(df.limit(0), "v", (0.5,)).first()) == (None,)


def test_longest_known_suffixes(spark):
    """The trie, the join by the lengths of known names, and all suffixes of each name."""
    rng = random.Random(8)
    index = {"".join(rng.choices("税法条例", k=rng.randint(1, 5))): f"doc:{k}" for k in range(40)}
    names = ["".join(rng.choices("税法条例x", k=rng.randint(0, 8))) for _ in range(200)] + [None]
    want = {n: next((index[n[i:]] for i in range(len(n)) if n[i:] in index), None) for n in names if n is not None}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame(list(index.items()), "name string, doc_id string")
    for most in (8 << 20, 0):
        got = graph.resolved(rows, table, most).collect()
        assert len(got) == len(names) and all(r.doc == want.get(r.name) for r in got)


def test_graph_leg_leaves_out_the_query_s_own_seeds(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(120)]
    mentions = [(rng.randrange(30), rng.randrange(12)) for _ in range(100)]
    seeds = [(q, s) for q in range(6) for s in rng.sample(range(30), rng.randint(1, 5))]
    per_seed, cap, least = 3, 7, 2
    cites, own = defaultdict(Counter), defaultdict(set)
    for a, b in edges:
        if a != b:
            cites[a][b] += 1
            cites[b][a] += 1
    for c, e in mentions:
        own[c].add(e)
    want = {}
    for q in range(6):
        mine = [s for k, s in seeds if k == q]
        sums, counts = Counter(), defaultdict(Counter)
        for s in mine:
            shared = {c: len(own[s] & own[c]) for c in range(30) if c != s and len(own[s] & own[c]) >= least}
            for kind, near in (("cites", cites[s]), ("mentions", shared)):
                for c, w in sorted(((c, w) for c, w in near.items() if c not in mine), key=lambda x: (-x[1], x[0]))[:per_seed]:
                    sums[c] += w
                    counts[c][kind] += 1
        order = sorted(sums, key=lambda c: (-sums[c], -max(counts[c].values()), "cites" not in counts[c], c))[:cap]
        want |= {(q, c): k for k, c in enumerate(order, 1)}
    df = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    got = graph.graph_leg(df(seeds, "query_id", "seed"), df(edges, "src", "dst"), df(mentions, "clause_id", "entity_id"), least, per_seed, cap).collect()
    assert {(r.query_id, r.id): r["rank"] for r in got} == want


def test_pages_by_cursor_and_by_offset(spark, tmp_path):
    """Every page equals the offset's, ties and nulls included, and takes a few files."""
    from sparkloom.sources import paged

    rng, path, order = random.Random(1), str(tmp_path / "t"), ("-v", "w", "id")
    rows = [(k, rng.choice([None, 1, 2, 3, 50]), rng.choice([None, "a", "b"])) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v int, w string")
    paged.write(df, path, order, rows_per_file=50, partitions=4)
    files = paged.manifest(spark, path).count()
    want = [tuple(r) for r in df.orderBy(F.desc("v"), "w", "id").collect()]
    for at in (0, 1, 49, 50, 333, 985, 1000, 2000):
        page, read = paged.at_offset(spark, path, order, at, 30)
        assert [tuple(r) for r in page.collect()] == want[at : at + 30] and len(read) <= 3 < files
        if 0 < at <= 1000:
            page, read = paged.after(spark, path, order, dict(zip(("id", "v", "w"), want[at - 1])), 30)
            assert [tuple(r) for r in page.collect()] == want[at : at + 30] and len(read) <= 3
    page, read = paged.after(spark, path, order, None, 30)
    assert [tuple(r) for r in page.collect()] == want[:30] and len(read) <= 2
    paged.write(df.limit(0), path, order)
    assert paged.after(spark, path, order, None, 5)[0].count() == 0 and paged.at_offset(spark, path, order, 3, 5)[0].count() == 0


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    rng = random.Random(9)
    docs = [(i, i, "t", " ".join(rng.choices(["a", "b", "c", "d", "e"], k=rng.randint(1, 9)))) for i in range(200)]
    queries = [(k, " ".join(rng.choices(["a", "b", "c", "zz"], k=3))) for k in range(20)]
    d, q = spark.createDataFrame(docs, "id long, ord long, title string, content string"), spark.createDataFrame(queries, "query_id long, query string")
    found = retrieval.bm25(q, d, 5)
    overlap = retrieval.keyword_overlap(q, d.withColumn("tags", F.array(F.lit("x"))), 0.2, 5)
    for rows in (found, overlap):
        assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {k: [i for i, _ in v] for k, v in listed(found).items()} == brute_bm25(docs, queries, 5)
    want = {}
    for k, text in queries:
        shares = [(-min(1.0, round(len(set(text.split()) & set(c.split())) / len(set(text.split())), 4)), str(i), i) for i, _, _, c in docs]
        want[k] = [i for s, _, i in sorted(shares)[:5] if s <= -0.2]
    assert {k: [i for i, _ in v] for k, v in listed(overlap).items()} == {k: v for k, v in want.items() if v}


def test_documents_of_one_id_are_added_up(spark):
    docs = [(1, 1, "t", "a b"), (1, 1, "t", "a c"), (2, 2, "t", "a"), (None, 3, "t", "b b")]
    d, q = spark.createDataFrame(docs, "id long, ord long, title string, content string"), spark.createDataFrame([(7, "a b")], "query_id long, query string")
    rows = {r.id: r.score for r in retrieval.bm25(q, d, 5).collect()}
    idf, part = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5)), lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2.75))
    assert rows == {1: pytest.approx(idf(2) * part(2, 3) + idf(2) * part(1, 3), abs=1e-4), 2: pytest.approx(idf(2) * part(1, 2), abs=1e-4), None: pytest.approx(idf(2) * part(2, 3), abs=1e-4)}
    overlap = retrieval.keyword_overlap(q, d.withColumn("tags", F.array(F.lit("x"))), 0.2, 5)
    assert {r.id: r.score for r in overlap.collect()} == {1: 1.0, 2: 0.5, None: 0.5}
