"""Further queries: fallback prices, reports, contexts, chains, endpoints and reachability."""

from pyspark.sql import functions as F

from sparkloom.operators import chunking as C
from sparkloom.operators import graph as G
from sparkloom.operators import listing as L
from sparkloom.operators import retrieval as R
from sparkloom.operators import similar as S
from sparkloom.operators.segmentation import segmented
from sparkloom.operators.usage import priced_twice
from sparkloom.plans import graph as PG
from sparkloom.plans import listing as PL
from sparkloom.plans import retrieval as PR
from sparkloom.plans.views import view
from sparkloom.sources import deltas, paged, tables
from sparkloom.storage import scratch, stored
from sparkloom.tables import table


def twice(s, d):
    calls = PL._named(view(s, d, "calls")).withColumn("requested_model", F.when(F.col("id") % 2 == 0, "house").otherwise("nothing"))
    return priced_twice(calls, view(s, d, "model_pool").filter("id < 0"), PL._fallback(s)).select("id", "model", "input_per_million")


def report(s, d):
    files = table(s, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, "damaged").alias("error"))
    return C.ingest_report(files, table(s, d, "documents").filter("doc_id % 9 <> 0").select("doc_id", "text"))


def samples(s, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("依《"), PG._title(k % 50 + 1), F.lit("》第"), (k % 45).cast("string"), F.lit("条，另见《"), PG._title(k % 20 + 1), F.lit("》。"))
    return table(s, d, "orders").filter("o_orderkey % 20 = 0").select(k.alias("sample_id"), text.alias("text"))


def reached(s, d):
    targets = PG.seeds(s, d).select("seed", (F.col("seed") + 1).alias("target"))
    return G.reachability(PG.mentions(s, d), PG.seeds(s, d), targets, s.range(1, 5).select(F.col("id").cast("int").alias("min_shared")), 10)


def merged_graph(s, d):
    """Nodes and edges merged twice into stored tables; the edges."""
    folder = scratch(s)
    nodes = {"Clause": table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))}
    rows = PG.edges(s, d).select("src", "dst")
    rows = rows.repartition(1 + rows.count() // deltas.TASK_ROWS, "src", "dst")
    edges = {"CITES": stored(rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("occurrences")))}
    for _ in range(2):
        deltas.merge_graph(s, folder, nodes, edges)
    return deltas.read(s, f"{folder}/edges/CITES")


def stored_table(s, rows, change):
    path = scratch(s)
    tables.replace(rows, path)
    change(path)
    return tables.read(s, path)


def counted(s, d):
    """Vectors of a stored table, and of one that isn't there, whose statistics say 7."""
    path, statistics = scratch(s), s.createDataFrame([(7,)], "n long")
    tables.replace(PR.vectors(s, d), path)
    return s.createDataFrame([(tables.count(s, path), tables.count(s, scratch(s), statistics))], "n long, missing long")


PAGE = ("-o_orderdate", "o_orderkey")


def deep_page(s, d):
    """Page 40 of the orders, newest first: the cursor behind page 39, then what comes after it."""
    path = scratch(s)
    paged.write(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), path, PAGE, rows_per_file=5000)
    last, _ = paged.at_offset(s, path, PAGE, 39 * 20 - 1, 1)
    return paged.after(s, path, PAGE, paged.cursor_of(last.first(), PAGE), 20)[0]


def pending(s, d):
    files, marker = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id"), scratch(s)
    for k in range(2):
        deltas.mark_done(files.filter(F.col("doc_id") % 3 == k), marker)
    return deltas.pending(files, marker)


def law_words(s, d):
    """A dictionary from `part`: the titles' words, as frequent as parts have them, and the general words of the texts."""
    titles = table(s, d, "part").select(PG._title(F.col("p_size")).alias("title"))
    general = F.array(*map(F.lit, ("税法", "实施条例", "条例", "依照", "参见", "本法")))
    named = titles.select(F.col("title").alias("word")).unionByName(titles.select(F.explode(general).alias("word")))
    return named.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def similar_statements(s, d):
    """Statements about parts: names of a brand's parts, of which some are written in two ways."""
    rows = table(s, d, "part")
    content = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_partkey") % 3 == 0, F.lit("!")).otherwise(""))
    return S.duplicate_statements(rows.select(F.lit("fact").alias("memory_type"), F.lit("user").alias("scope"), F.col("p_brand").alias("scope_key"), F.col("p_partkey").alias("ord"), content.alias("content")))


QUERIES = {
    "r02_segmented": lambda s, d: segmented(PG.chunks(s, d).select("id", F.concat("title", "content").alias("text")), law_words(s, d)).select("id", F.array_join("tokens", "|").alias("tokens")),
    "q06_similar_statements": similar_statements,
    "s14_vector_count": counted,
    "s16_merged_graph": merged_graph,
    "s17_pending": pending,
    "t01_deep_page": deep_page,
    "s19_deleted": lambda s, d: stored_table(s, table(s, d, "customer").select("c_custkey", "c_nationkey"), lambda path: tables.delete(table(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), path, ["c_nationkey"])),
    "j04_price_fallback": twice,
    "b13_ingest_report": report,
    "b12_embedded": lambda s, d: C.embedded(table(s, d, "part").select("p_partkey", F.col("p_name").alias("text")), lambda t: F.array(F.length(t).cast("double")), instruction="q: ").select("p_partkey", F.element_at("vector", 1).alias("v")),
    "r03_bm25_statistics": lambda s, d: R.bm25_statistics(PR.corpus(s, d)).select("term", "df", F.round("idf", 6).alias("idf")),
    "r15_contexts": lambda s, d: R.contexts(PR.prompts(s, d).withColumn("id", F.col("rank"))),
    "x28_review_links": lambda s, d: L.review_links(view(s, d, "reviews").select("request_id", F.when(F.col("status") == "pending", "needs_human_review").otherwise("completed").alias("status"), F.col("id").alias("review_id"), "source_review_id")),
    "g12_chain_counts": lambda s, d: G.chain_counts(PG.edges(s, d).select("src", "dst"), table(s, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("name"), F.col("l_partkey").alias("first"), (F.col("l_suppkey") * 7).alias("middle"), F.col("l_suppkey").alias("last"))),
    "g13_endpoints": lambda s, d: G.endpoints(samples(s, d), PG.clauses(s, d), in_blocks=True).select("sample_id", "label", F.explode("ids").alias("clause_id")),
    "a23_reachability": reached,
}
T50, T20 = (PG.TITLE.format(n=f"(o_orderkey % {m} + 1)") for m in (50, 20))
SEGMENTS = f"""WITH RECURSIVE {PG.CLAUSES}, tx AS (SELECT clause_id AS id, lower(title || text) AS text FROM c),
fw AS (SELECT {PG.TITLE.format(n='p_size')} AS word FROM part UNION ALL SELECT unnest(['税法', '实施条例', '条例', '依照', '参见', '本法']) FROM part),
dw AS (SELECT word, count(*) AS n FROM fw GROUP BY 1), dt AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM dw), dl AS (SELECT word, ln(CAST(n AS DOUBLE) / total) AS w FROM dw, dt),
rs AS (SELECT id, unnest(r) AS run, generate_subscripts(r, 1) AS place FROM (SELECT id, regexp_extract_all(text, '[一-鿕]+|[a-z0-9]+|\\S') AS r FROM tx)),
hr AS (SELECT DISTINCT run FROM rs WHERE regexp_matches(run, '^[一-鿕]')),
st AS (SELECT run, unnest(range(1, length(run) + 1)) AS start FROM hr),
sb AS (SELECT run, start, n, substring(run, start, n) AS word FROM st, (SELECT unnest(range(1, 17)) AS n) WHERE start + n - 1 <= length(run)),
ed AS (SELECT run, start, list({{'n': n, 'w': w}}) AS es FROM sb JOIN dl USING (word) GROUP BY 1, 2),
ea AS (SELECT st.run, st.start, coalesce(es, [{{'n': 1, 'w': -ln(total)}}]) AS es FROM st LEFT JOIN ed ON ed.run = st.run AND ed.start = st.start, dt),
dp AS (SELECT run, length(run) AS i, [0.0::DOUBLE] AS vals, CAST([] AS BIGINT[]) AS steps FROM hr
  UNION ALL SELECT run, i - 1, list_prepend(b.v, vals), list_prepend(b.n, steps)
  FROM (SELECT dp.run, i, vals, steps, list_sort(list_transform(es, lambda e: {{'v': e.w + vals[e.n], 'n': e.n}}), 'DESC')[1] AS b FROM dp JOIN ea ON ea.run = dp.run AND ea.start = dp.i)),
wk AS (SELECT run, steps, CAST(1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS ts FROM dp WHERE i = 0
  UNION ALL SELECT run, steps, pos + steps[pos], list_append(ts, substring(run, pos, steps[pos])) FROM wk WHERE pos <= length(run)),
cut AS (SELECT run, array_to_string(ts, '|') AS t FROM wk WHERE pos > length(run))
SELECT id, string_agg(coalesce(t, run), '|' ORDER BY place) AS tokens FROM rs LEFT JOIN cut USING (run) GROUP BY 1"""
ORACLES = {
    "r02_segmented": SEGMENTS,
    "s14_vector_count": "SELECT count(*) AS n, CAST(7 AS BIGINT) AS missing FROM embeddings",
    "s16_merged_graph": f"WITH {PG.EDGES} SELECT src, dst, count(*) AS occurrences FROM e WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part) GROUP BY 1, 2",
    "s17_pending": "SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, doc_id FROM documents WHERE doc_id % 3 = 2",
    "t01_deep_page": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 780",
    "s19_deleted": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "j04_price_fallback": f"""{PL.PRICED} , y AS (SELECT id, model, CASE WHEN id % 2 = 0 THEN 'house' ELSE 'nothing' END AS requested FROM c)
      SELECT y.id, y.model, coalesce(f.i, g.i) AS input_per_million FROM y LEFT JOIN f ON f.model = y.model LEFT JOIN f g ON g.model = y.requested""",
    "b13_ingest_report": """SELECT count(*) AS files, count(*) FILTER (doc_id % 9 = 0) AS failed, count(DISTINCT doc_id) FILTER (doc_id % 9 <> 0) AS documents, count(*) FILTER (doc_id % 9 <> 0) AS chunks,
      CAST(sum(length(text)) FILTER (doc_id % 9 <> 0) AS BIGINT) AS chars FROM documents""",
    "b12_embedded": "SELECT p_partkey, CAST(length(prompt) AS DOUBLE) AS v FROM (SELECT p_partkey, 'q: ' || p_name AS prompt FROM part)",
    "r03_bm25_statistics": f"""WITH t AS (SELECT unnest(list_distinct({PR.TOKENS.format("source || ' ' || text")})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
      SELECT term, count(*) AS df, round(ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term""",
    "r15_contexts": """SELECT conv_id AS query_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 = 2, turn) AS INTEGER) AS index, turn AS id, role AS title, turn % 3 = 2 AS supplementary FROM conversations""",
    "x28_review_links": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS review_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 5 END AS source_review_id FROM orders",
    "g12_chain_counts": f"""WITH {PG.EDGES}, p AS (SELECT l_orderkey AS name, l_partkey AS a, l_suppkey * 7 AS b, l_suppkey AS c FROM lineitem WHERE l_linenumber = 1),
      f AS (SELECT name, count(*) AS n FROM p JOIN e x ON x.src = a AND x.dst = b JOIN e y ON y.src = b AND y.dst = c GROUP BY 1) SELECT p.name, coalesce(n, 0) AS matches FROM p LEFT JOIN f USING (name)""",
    "g13_endpoints": f"""WITH {PG.CLAUSES}, q AS (SELECT o_orderkey AS sample_id, {T50} AS n1, o_orderkey % 45 AS a, {T20} AS n2 FROM orders WHERE o_orderkey % 20 = 0),
      r1 AS (SELECT sample_id, n1, a, arg_max(t.doc_id, length(t.title)) AS doc FROM q LEFT JOIN t ON ends_with(n1, t.title) GROUP BY ALL),
      ci AS (SELECT sample_id, n1, '《' || n1 || '》第' || CAST(a AS VARCHAR) || '条' AS label, art.clause_id FROM r1 LEFT JOIN art ON art.doc_id = r1.doc AND art.article = r1.a),
      nm AS (SELECT sample_id, n1 AS name FROM q UNION SELECT sample_id, n2 FROM q), nu AS (SELECT * FROM nm WHERE (sample_id, name) NOT IN (SELECT (sample_id, n1) FROM ci WHERE clause_id IS NOT NULL)),
      r2 AS (SELECT sample_id, name, arg_max(t.doc_id, length(t.title)) AS doc FROM nu LEFT JOIN t ON ends_with(name, t.title) GROUP BY ALL)
      SELECT sample_id, label, clause_id FROM ci UNION SELECT sample_id, '《' || name || '》', c.clause_id FROM r2 LEFT JOIN c ON c.doc_id = r2.doc""",
    "a23_reachability": f"""WITH {PG.NEAR}, h AS (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS k), x AS (SELECT w.*, k, CAST(row_number() OVER (PARTITION BY seed, k ORDER BY weight DESC, clause_id) AS INTEGER) AS r FROM w JOIN h ON weight >= k)
      SELECT seed, k AS min_shared, count(*) AS neighbours, min(CASE WHEN clause_id = seed + 1 THEN r END) AS rank, min(CASE WHEN clause_id = seed + 1 AND r <= 10 THEN r END) AS capped_rank FROM x GROUP BY 1, 2""",
}
