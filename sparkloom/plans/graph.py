"""The clause graph on a corpus made from `part` (a document for each size, a clause for each part) and on `lineitem` as edges."""

from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import quality as Q
from sparkloom.tables import table

LETTERS = "甲乙丙丁戊己庚辛壬癸"


def _name(n):
    return F.translate(n.cast("int").cast("string"), "0123456789", LETTERS)


def _title(n):
    return F.when(n % 10 == 0, F.concat(_name(n / 10), F.lit("税法实施条例"))).otherwise(F.concat(_name(n), F.lit("税法")))


def chunks(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("依照《"), _title(k * 7 % 50 + 1), F.lit("》第"), (k % 40).cast("string"), F.lit("条")))
        .when(k % 4 == 1, F.concat(F.lit("本法第"), (k % 30 + 1).cast("string"), F.lit("条")))
        .when(k % 4 == 2, F.concat(F.lit("参见《"), _title(k * 3 % 50 + 1), F.lit("》")))
        .otherwise(F.col("p_name"))
    )
    return table(s, d, "part").select(
        k.alias("ord"), k.cast("string").alias("id"), _title(size).alias("title"), text.alias("content"), F.concat(F.lit("s\\"), size.cast("string")).alias("source"),
        F.lit("").alias("parent_id"), F.lit("").alias("parent_text"), F.concat(F.lit("第"), (k % 40 + 1).cast("string"), F.lit("条")).alias("section"),
    )


def clauses(s, d):
    return G.clauses(chunks(s, d))


def edges(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst"))


def mentions(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("clause_id"), F.col("l_partkey").alias("entity_id"))


def seeds(s, d):
    return table(s, d, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("seed"))


def part_seeds(s, d):
    return table(s, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"))


def ends(s, d):
    """A sample for each hundred orders, ten endpoints of ten clauses each."""
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(F.floor(k / 100).alias("sample"), (k % 10).alias("endpoint"), k.alias("clause_id"))


def order_edges(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") - F.col("l_orderkey") % 400 + (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 400).alias("dst"))


def both_legs(s, d):
    m = G.ranked_neighbours(G.mentions_neighbours(mentions(s, d), seeds(s, d), 1, 50), "mentions", 100)
    c = G.ranked_neighbours(G.cites_neighbours(order_edges(s, d), seeds(s, d), 50), "cites", 100)
    return G.merged_neighbours([c.drop("rank"), m.drop("rank")], 50)


def audited(s, d):
    """Mentions of part names in the lines' clauses, some of an unknown clause."""
    rows = table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("clause_id"), F.col("l_returnflag").alias("type"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 13).cast("string")).alias("name"),
    )
    return Q.audited_mentions(rows, table(s, d, "part").select(F.col("p_partkey").alias("clause_id"), F.concat(F.lit("T1 "), "p_name").alias("text")))


def ledger(s, d):
    k = F.col("o_orderkey")
    cols = [(k % (i + 2)).alias(c) for i, c in enumerate(Q.COUNTERS)]
    return table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), *cols)


def items(s, d):
    k = F.col("doc_id")
    score = lambda v, e: F.struct(v.cast("double").alias("value"), e.alias("error"))
    plan = F.when(k % 3 == 0, F.array(F.lit("recall"), F.lit("faith"))).otherwise(F.array(F.lit("faith")))
    scores = F.create_map(F.lit("recall"), score(F.col("quality") / 2, F.lit("")), F.lit("faith"), score(F.when(k % 5 != 0, F.col("toxic") + 0.25), F.lit("judge failed")))
    errors = F.when(k % 7 == 0, F.create_map(F.lit("answer"), F.lit("no answer"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(s, d, "labels").select(k.alias("id"), F.when(k % 7 == 0, "failed").when(k % 11 == 0, "failed").otherwise("scored").alias("status"), plan.alias("plan"), scores.alias("scores"), errors.alias("errors"))


def answers(s, d):
    k = F.col("l_orderkey")
    return table(s, d, "lineitem").select(
        (k % 97).alias("doc_id"), (k % 3).alias("ref"), F.when(k % 3 != 2, k % 3).alias("clause_id"), ((k * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("place"),
        F.when(F.col("l_partkey") % 4 == 0, "other").otherwise("tax_type").alias("type"), F.when(F.col("l_partkey") % 9 == 0, "x").otherwise(F.concat(F.lit("name"), (F.col("l_suppkey") % 8).cast("string"))).alias("name"),
    )


QUERIES = {
    "g01_clauses": lambda s, d: clauses(s, d).select("clause_id", "doc_id", "title", "section", "article", "text"),
    "g02_articles": lambda s, d: G.articles(clauses(s, d)),
    "g03_cites": lambda s, d: G.cites(clauses(s, d)).select("src", "dst", "law", "article", "cross_doc", "outcome"),
    "g04_implements": lambda s, d: G.implements(clauses(s, d)),
    "g04_references": lambda s, d: G.references(clauses(s, d)),
    "a29_structure_stats": lambda s, d: G.structure_stats(clauses(s, d)),
    "q04_merged_edges": lambda s, d: G.merged_edges(edges(s, d).select("src", "dst", F.col("edge_id").alias("ord"), (F.col("edge_id") % 7).alias("attribute"))),
    "j13_edges_of_known_ends": lambda s, d: G.merged_edges(edges(s, d).select("src", "dst", F.col("edge_id").alias("ord")), table(s, d, "part").select(F.col("p_partkey").alias("clause_id"))),
    "g05_cites_neighbours": lambda s, d: G.cites_neighbours(edges(s, d), part_seeds(s, d), 5),
    "g06_mentions_neighbours": lambda s, d: G.mentions_neighbours(mentions(s, d), seeds(s, d), 1, 5),
    "g09_mentions_neighbours_uncapped": lambda s, d: G.mentions_neighbours(mentions(s, d), seeds(s, d), 2, None),
    "g07_ranked_neighbours": lambda s, d: G.ranked_neighbours(G.mentions_neighbours(mentions(s, d), seeds(s, d), 1, 5), "mentions", 30).drop("kinds"),
    "g08_merged_neighbours": lambda s, d: both_legs(s, d).withColumn("kinds", F.array_join("kinds", "+")),
    "j08_rehydrated": lambda s, d: G.rehydrated(both_legs(s, d).withColumn("clause_id", F.col("clause_id").cast("string")), chunks(s, d)).select("clause_id", "rank", "title"),
    "g10_paths_up_to_two": lambda s, d: G.paths_up_to_two(edges(s, d), table(s, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"))),
    "g11_shared_entities": lambda s, d: G.shared_entities(mentions(s, d), ends(s, d)),
    "a21_hop_coverage": lambda s, d: G.hop_coverage(ends(s, d), order_edges(s, d), mentions(s, d), 1),
    "a10_graph_counts": lambda s, d: Q.graph_counts({"Clause": table(s, d, "orders"), "Entity": table(s, d, "part")}, {"CITES": edges(s, d), "MENTIONS": mentions(s, d)}),
    "a11_type_counts": lambda s, d: Q.type_counts(table(s, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("entity_id"))),
    "a12_hub_entities": lambda s, d: Q.hub_entities(mentions(s, d)),
    "a13_degree_summary": lambda s, d: Q.degree_summary(mentions(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")), hubs=(5, 20, 40)).withColumn("mean", F.round("mean", 6)).withColumn("singleton_ratio", F.round("singleton_ratio", 6)),
    "a14_nearest_rank": lambda s, d: Q.nearest_rank(table(s, d, "lineitem"), "l_suppkey", (0.5, 0.9, 0.99), ("l_returnflag",)),
    "a15_extraction_ledger": lambda s, d: Q.extraction_ledger(ledger(s, d)).select("docs_total", "docs_ok", "docs_error", "refs_sent", "raw_entities", "discarded", F.round("discard_ratio", 6).alias("discard_ratio"), F.round("ref_loss", 6).alias("ref_loss")),
    "a17_mention_counts": lambda s, d: Q.mention_counts(mentions(s, d)),
    "a18_anchor_histogram": lambda s, d: Q.anchor_histogram(table(s, d, "orders").select(F.col("o_orderkey").alias("clause_id"), F.repeat(F.lit("a、"), (F.col("o_custkey") % 12).cast("int")).alias("text")), Q.mention_counts(mentions(s, d))),
    "a19_literal_audit": lambda s, d: Q.literal_audit(audited(s, d)).withColumn("absent_ratio", F.round("absent_ratio", 6)),
    "a19_audit_samples": lambda s, d: Q.audit_samples(audited(s, d)).select("ord", "kind", "name"),
    "j05_unmatched_mentions": lambda s, d: audited(s, d).agg(F.count_if(F.col("kind").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("mentions")),
    "a20_anchor_coverage": lambda s, d: Q.anchor_coverage(
        table(s, d, "orders").select(F.col("o_orderkey").alias("clause_id"), (F.col("o_custkey") % 30).alias("doc_id"), F.concat(F.repeat(F.lit("字"), (F.col("o_custkey") % 80).cast("int")), F.when(F.col("o_custkey") % 3 == 0, F.lit("同时废止")).otherwise("")).alias("text")),
        mentions(s, d).filter("entity_id % 3 = 0").select((F.col("clause_id") * 2).alias("clause_id")), s.range(5).select(F.col("id").alias("doc_id")),
    ).withColumn("coverage", F.round("coverage", 6)),
    "a22_target_ranks": lambda s, d: Q.target_ranks(table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("turn").alias("rank")), table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.lit(3).cast("bigint").alias("id")).distinct()),
    "a24_evaluation_means": lambda s, d: Q.evaluation_means(items(s, d), ("recall", "faith")).withColumn("reasons", F.array_join("reasons", "|")),
    "a25_evaluation_summary": lambda s, d: table(s, d, "events").filter("event_type <> 'error'").agg(F.round(F.avg("value"), 6).alias("latency"), F.count(F.lit(1)).alias("items")),
    "a26_arm_comparison": lambda s, d: Q.arm_comparison(table(s, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("group"), (F.col("l_partkey") % 3 == 0).alias("hit"), F.col("l_linenumber").alias("contexts"), (F.col("l_linenumber") % 2).alias("graph_contexts"))),
    "a27_run_counters": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("docs"), F.count_if(F.col("event_id") % 9 == 0).alias("truncated")),
    "x26_validated_entities": lambda s, d: Q.validated_entities(answers(s, d), most=3).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "q01_anchored_sets": lambda s, d: mentions(s, d).select("clause_id").intersect(table(s, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("clause_id"))),
}

TITLE = "CASE WHEN {n} % 10 = 0 THEN translate(CAST({n} // 10 AS VARCHAR), '0123456789', '甲乙丙丁戊己庚辛壬癸') || '税法实施条例' ELSE translate(CAST({n} AS VARCHAR), '0123456789', '甲乙丙丁戊己庚辛壬癸') || '税法' END"
CLAUSES = f"""c AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS clause_id, 'doc:s/' || CAST(p_size AS VARCHAR) AS doc_id, {TITLE.format(n='p_size')} AS title, '第' || CAST(p_partkey % 40 + 1 AS VARCHAR) || '条' AS section,
  p_partkey % 40 + 1 AS article, CASE p_partkey % 4 WHEN 0 THEN '依照《' || {TITLE.format(n='(p_partkey * 7 % 50 + 1)')} || '》第' || CAST(p_partkey % 40 AS VARCHAR) || '条'
  WHEN 1 THEN '本法第' || CAST(p_partkey % 30 + 1 AS VARCHAR) || '条' WHEN 2 THEN '参见《' || {TITLE.format(n='(p_partkey * 3 % 50 + 1)')} || '》' ELSE p_name END AS text FROM part),
art AS (SELECT doc_id, article, arg_min(clause_id, ord) AS clause_id FROM c GROUP BY 1, 2),
t AS (SELECT DISTINCT doc_id, title FROM c),
named AS (SELECT ord, doc_id, clause_id, {TITLE.format(n='(ord * 7 % 50 + 1)')} AS name, ord % 40 AS a FROM c WHERE ord % 4 = 0),
law AS (SELECT n.ord, arg_max(t.doc_id, length(t.title)) AS target FROM named n JOIN t ON ends_with(n.name, t.title) GROUP BY n.ord),
cites0 AS (SELECT n.clause_id AS src, n.doc_id AS own, '《' || n.name || '》' AS law, n.a AS article, law.target FROM named n LEFT JOIN law USING (ord)
  UNION ALL SELECT clause_id, doc_id, '本法', ord % 30 + 1, doc_id FROM c WHERE ord % 4 = 1),
cites AS (SELECT x.src, CASE WHEN art.clause_id <> x.src THEN art.clause_id END AS dst, x.law, x.article, x.target <> x.own AS cross_doc,
  CASE WHEN x.target IS NULL THEN 'unknown_law' WHEN art.clause_id IS NULL OR art.clause_id = x.src THEN 'unknown_clause' ELSE 'edge' END AS outcome
  FROM cites0 x LEFT JOIN art ON art.doc_id = x.target AND art.article = x.article),
impl AS (SELECT t.doc_id AS src, arg_max(u.doc_id, length(u.title)) AS dst FROM t JOIN t u ON ends_with(t.title, '实施条例') AND ends_with(left(t.title, -4), u.title) GROUP BY t.doc_id),
refs0 AS (SELECT doc_id, {TITLE.format(n='(ord * 7 % 50 + 1)')} AS name FROM c WHERE ord % 4 = 0 UNION ALL SELECT doc_id, {TITLE.format(n='(ord * 3 % 50 + 1)')} FROM c WHERE ord % 4 = 2),
refs1 AS (SELECT r.doc_id, r.name, arg_max(t.doc_id, length(t.title)) AS dst FROM refs0 r JOIN t ON ends_with(r.name, t.title) GROUP BY 1, 2),
refs AS (SELECT DISTINCT doc_id AS src, dst FROM refs1 WHERE dst <> doc_id)"""
EDGES = "e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem)"
MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS clause_id, l_partkey AS entity_id FROM lineitem)"
SEEDS = "s AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderkey % 20 = 0)"
NEAR = f"""{MENTIONS}, {SEEDS}, w AS (SELECT a.clause_id AS seed, b.clause_id, count(*) AS weight FROM m a JOIN m b USING (entity_id) WHERE a.clause_id IN (SELECT seed FROM s) AND b.clause_id NOT IN (SELECT seed FROM s) GROUP BY 1, 2)"""
TOP = "SELECT seed, clause_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, clause_id) AS r FROM {t}) WHERE r <= {k}"
LEGS = f"""{NEAR}, mt AS ({TOP.format(t='w', k=50)}), ma AS (SELECT clause_id, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT seed) AS seeds, 'mentions' AS kind FROM mt GROUP BY 1 ORDER BY weight DESC, seeds DESC, clause_id LIMIT 100),
oe AS (SELECT l_orderkey AS src, l_orderkey - l_orderkey % 400 + (l_orderkey * 3 + l_linenumber) % 400 AS dst FROM lineitem), ob AS (SELECT src AS seed, dst AS clause_id FROM oe UNION ALL SELECT dst, src FROM oe),
cw AS (SELECT seed, clause_id, count(*) AS weight FROM ob WHERE seed IN (SELECT seed FROM s) AND clause_id NOT IN (SELECT seed FROM s) GROUP BY 1, 2), ct AS ({TOP.format(t='cw', k=50)}),
ca AS (SELECT clause_id, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT seed) AS seeds, 'cites' AS kind FROM ct GROUP BY 1 ORDER BY weight DESC, seeds DESC, clause_id LIMIT 100),
u AS (SELECT clause_id, CAST(sum(weight) AS BIGINT) AS weight, max(seeds) AS seeds, string_agg(kind, '+' ORDER BY kind) AS kinds FROM (SELECT * FROM ma UNION ALL SELECT * FROM ca) GROUP BY 1),
legs AS (SELECT *, CAST(row_number() OVER (ORDER BY weight DESC, seeds DESC, CASE WHEN contains(kinds, 'cites') THEN 0 ELSE 1 END, clause_id) AS INTEGER) AS rank FROM u QUALIFY rank <= 50)"""
ENDS = "n AS (SELECT o_orderkey // 100 AS sample, o_orderkey % 10 AS endpoint, o_orderkey AS clause_id FROM orders)"
SHARED = f"""{MENTIONS}, {ENDS}, sh AS (SELECT a.sample, a.endpoint AS "left", b.endpoint AS "right", a.clause_id AS c1, b.clause_id AS c2, count(*) AS k FROM (SELECT * FROM n JOIN m USING (clause_id)) a JOIN (SELECT * FROM n JOIN m USING (clause_id)) b
  ON a.sample = b.sample AND a.entity_id = b.entity_id AND a.endpoint < b.endpoint GROUP BY ALL), shared AS (SELECT sample, "left", "right", max(k) AS shared FROM sh GROUP BY 1, 2, 3)"""
AUDIT = """x AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS type, 'T' || CAST(l_suppkey % 13 AS VARCHAR) AS name, l_linenumber = 7 AS lost, l_partkey FROM lineitem),
a AS (SELECT x.*, count(*) OVER (PARTITION BY type, name) AS degree, CASE WHEN lost THEN NULL WHEN contains(regexp_replace('T1 ' || p_name, '\\s+', '', 'g'), name) THEN 'exact'
  WHEN length(name) = 3 AND contains(regexp_replace('T1 ' || p_name, '\\s+', '', 'g'), name) THEN 'partial' ELSE 'absent' END AS kind FROM x JOIN part ON p_partkey = l_partkey)""".replace("\\\\", "\\")
KINDS = "count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'partial') AS partial, count(*) FILTER (kind = 'absent') AS absent, count(*) FILTER (kind IS NULL) AS unresolved, round(count(*) FILTER (kind = 'absent') / nullif(count(kind), 0), 6) AS absent_ratio"
RANK = "list_sort(list(v))[CAST(least(len(list(v)) - 1, round_even({q} * (len(list(v)) - 1), 0)) AS INTEGER) + 1]"
ORACLES = {
    "g01_clauses": f"WITH {CLAUSES} SELECT clause_id, doc_id, title, section, article, text FROM c",
    "g02_articles": f"WITH {CLAUSES} SELECT * FROM art",
    "g03_cites": f"WITH {CLAUSES} SELECT * FROM cites",
    "g04_implements": f"WITH {CLAUSES} SELECT * FROM impl WHERE src <> dst",
    "g04_references": f"WITH {CLAUSES} SELECT * FROM refs",
    "a29_structure_stats": f"""WITH {CLAUSES} SELECT 'clauses' AS measure, count(*) AS n FROM c UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM c UNION ALL SELECT 'citations', count(*) FROM cites WHERE outcome = 'edge'
      UNION ALL SELECT 'citations_cross_doc', count(*) FROM cites WHERE outcome = 'edge' AND cross_doc UNION ALL SELECT 'unresolved_law', count(*) FROM cites WHERE outcome = 'unknown_law'
      UNION ALL SELECT 'unresolved_clause', count(*) FROM cites WHERE outcome = 'unknown_clause' UNION ALL SELECT 'implements', count(*) FROM impl WHERE src <> dst UNION ALL SELECT 'references', count(*) FROM refs""",
    "q04_merged_edges": f"WITH {EDGES} SELECT src, dst, count(*) AS occurrences, arg_min(edge_id % 7, edge_id) AS attribute FROM e GROUP BY 1, 2",
    "j13_edges_of_known_ends": f"WITH {EDGES} SELECT src, dst, count(*) AS occurrences FROM e WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part) GROUP BY 1, 2",
    "g05_cites_neighbours": f"""WITH {EDGES}, b AS (SELECT src AS seed, dst AS clause_id FROM e UNION ALL SELECT dst, src FROM e), w AS (SELECT seed, clause_id, count(*) AS weight FROM b WHERE seed IN (SELECT p_partkey FROM part WHERE p_partkey % 20 = 0)
      AND clause_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 20 = 0) GROUP BY 1, 2) {TOP.format(t='w', k=5)}""",
    "g06_mentions_neighbours": f"WITH {NEAR} {TOP.format(t='w', k=5)}",
    "g09_mentions_neighbours_uncapped": f"WITH {NEAR} SELECT * FROM w WHERE weight >= 2",
    "g07_ranked_neighbours": f"""WITH {NEAR}, k AS ({TOP.format(t='w', k=5)}), g AS (SELECT clause_id, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT seed) AS seeds FROM k GROUP BY 1)
      SELECT *, CAST(row_number() OVER (ORDER BY weight DESC, seeds DESC, clause_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 30""",
    "g08_merged_neighbours": f"WITH {LEGS} SELECT * FROM legs",
    "j08_rehydrated": f"WITH {LEGS}, {CLAUSES} SELECT c.clause_id, legs.rank, c.title FROM legs JOIN c ON c.clause_id = CAST(legs.clause_id AS VARCHAR)",
    "g10_paths_up_to_two": f"""WITH {EDGES}, b AS (SELECT edge_id, src AS u, dst AS v FROM e UNION ALL SELECT edge_id, dst, src FROM e), i AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 = 0),
      p AS (SELECT u AS a, v AS b FROM b UNION ALL SELECT x.u, y.v FROM b x JOIN b y ON x.v = y.u AND x.edge_id <> y.edge_id) SELECT a, b, count(*) AS paths FROM p WHERE a < b AND a IN (SELECT id FROM i) AND b IN (SELECT id FROM i) GROUP BY 1, 2""",
    "g11_shared_entities": f"WITH {SHARED} SELECT * FROM shared",
    "a21_hop_coverage": f"""WITH {SHARED}, oe AS (SELECT l_orderkey AS src, l_orderkey - l_orderkey % 400 + (l_orderkey * 3 + l_linenumber) % 400 AS dst FROM lineitem), d AS (SELECT src, dst FROM oe UNION SELECT dst, src FROM oe),
      cited AS (SELECT DISTINCT x.sample, x.endpoint AS l, y.endpoint AS r FROM d JOIN n x ON x.clause_id = d.src JOIN n y ON y.clause_id = d.dst AND y.sample = x.sample WHERE x.endpoint < y.endpoint), k AS (SELECT DISTINCT sample, endpoint FROM n),
      p AS (SELECT cited.l IS NOT NULL AS c, coalesce(shared, 0) >= 1 AS m FROM k a JOIN k b ON a.sample = b.sample AND a.endpoint < b.endpoint LEFT JOIN cited ON cited.sample = a.sample AND cited.l = a.endpoint AND cited.r = b.endpoint
        LEFT JOIN shared ON shared.sample = a.sample AND shared."left" = a.endpoint AND shared."right" = b.endpoint)
      SELECT count(*) AS pairs, count(*) FILTER (c) AS by_cites, count(*) FILTER (m) AS by_mentions, count(*) FILTER (c OR m) AS linked, count(*) > 0 AND count(*) = count(*) FILTER (c OR m) AS complete FROM p""",
    "a10_graph_counts": "SELECT 'node' AS kind, 'Clause' AS name, count(*) AS n FROM orders UNION ALL SELECT 'node', 'Entity', count(*) FROM part UNION ALL SELECT 'edge', 'CITES', count(*) FROM lineitem UNION ALL SELECT 'edge', 'MENTIONS', count(*) FROM lineitem",
    "a11_type_counts": "SELECT l_returnflag AS type, count(*) AS entities, count(*) FILTER (n = 1) AS singletons FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "a12_hub_entities": "SELECT l_partkey AS entity_id, count(*) AS degree FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "a13_degree_summary": f"""WITH d AS (SELECT count(*) AS v FROM lineitem GROUP BY l_partkey) SELECT count(*) AS entities, count(*) FILTER (v = 1) AS singleton, max(v) AS largest, round(avg(v), 6) AS mean,
      count(*) FILTER (v >= 5) AS hub_5, count(*) FILTER (v >= 20) AS hub_20, count(*) FILTER (v >= 40) AS hub_40, round(count(*) FILTER (v = 1) / count(*), 6) AS singleton_ratio, {RANK.format(q=0.5)} AS p50, {RANK.format(q=0.9)} AS p90, {RANK.format(q=0.99)} AS p99 FROM d""",
    "a14_nearest_rank": f"SELECT l_returnflag, {RANK.format(q=0.5)} AS p50, {RANK.format(q=0.9)} AS p90, {RANK.format(q=0.99)} AS p99 FROM (SELECT l_returnflag, l_suppkey AS v FROM lineitem) GROUP BY 1",
    "a15_extraction_ledger": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1),
      x AS (SELECT o_orderstatus <> 'F' AS ok, o_orderkey AS k FROM l) SELECT count(*) AS docs_total, count(*) FILTER (ok) AS docs_ok, count(*) FILTER (NOT ok) AS docs_error, CAST(sum(k % 2) FILTER (ok) AS BIGINT) AS refs_sent,
      CAST(sum(k % 6) FILTER (ok) AS BIGINT) AS raw_entities, CAST(sum(k % 7 + k % 8 + k % 9 + k % 10) FILTER (ok) AS BIGINT) AS discarded, round(sum(k % 7 + k % 8 + k % 9 + k % 10) FILTER (ok) / sum(k % 6) FILTER (ok), 6) AS discard_ratio,
      round(sum(k % 4) FILTER (ok) / sum(k % 2) FILTER (ok), 6) AS ref_loss FROM x""",
    "a17_mention_counts": "SELECT l_orderkey AS clause_id, count(*) AS n FROM lineitem GROUP BY 1",
    "a18_anchor_histogram": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_custkey % 12 >= 8 AS many, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
      SELECT CASE WHEN many THEN 'enumeration' ELSE 'plain' END AS kind, CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS clauses FROM r GROUP BY 1, 2""",
    "a19_literal_audit": f"""WITH {AUDIT} SELECT 'all' AS "table", 'all' AS key, {KINDS} FROM a UNION ALL SELECT 'type', type, {KINDS} FROM a GROUP BY type
      UNION ALL SELECT 'degree', CASE WHEN degree >= 50 THEN '50+' WHEN degree >= 10 THEN '10-49' WHEN degree >= 4 THEN '4-9' WHEN degree >= 2 THEN '2-3' ELSE '1' END, {KINDS} FROM a GROUP BY 2""",
    "a19_audit_samples": f"WITH {AUDIT} (SELECT ord, kind, name FROM a WHERE kind = 'partial' ORDER BY ord LIMIT 5) UNION ALL (SELECT ord, kind, name FROM a WHERE kind = 'absent' ORDER BY ord LIMIT 5)",
    "j05_unmatched_mentions": "SELECT count(*) FILTER (l_linenumber = 7) AS unmatched, count(*) AS mentions FROM lineitem",
    "a20_anchor_coverage": """WITH i AS (SELECT DISTINCT l_orderkey * 2 AS c FROM lineitem WHERE l_partkey % 3 = 0), r AS (SELECT i.c IS NOT NULL AS a, o_custkey % 30 >= 5 AS ok, o_custkey % 80 + CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 0 END >= 40 AS long,
        o_custkey % 3 = 0 AS dull FROM orders LEFT JOIN i ON i.c = o_orderkey), l AS (SELECT unnest([{'layer': '1_all', 'k': true}, {'layer': '2_extracted', 'k': ok}, {'layer': '3_long', 'k': ok AND long}, {'layer': '4_substantial', 'k': ok AND long AND NOT dull},
        {'layer': '5_procedural', 'k': ok AND long AND dull}]) AS x, a FROM r), g AS (SELECT x.layer AS layer, count(*) FILTER (x.k) AS clauses, count(*) FILTER (x.k AND a) AS anchored FROM l GROUP BY 1
        UNION ALL SELECT '6_orphans', count(*), count(*) FROM i WHERE c NOT IN (SELECT o_orderkey FROM orders)) SELECT *, round(anchored / nullif(clauses, 0), 6) AS coverage FROM g""",
    "a22_target_ranks": "SELECT conv_id AS query_id, count(*) AS total, count(*) FILTER (turn = 3) AS hits, min(CASE WHEN turn = 3 THEN turn END) AS first_rank FROM conversations GROUP BY 1",
    "a24_evaluation_means": """WITH i AS (SELECT doc_id AS k, quality / 2.0 AS recall, CASE WHEN doc_id % 5 <> 0 THEN toxic + 0.25 END AS faith, NOT (doc_id % 7 = 0 OR doc_id % 11 = 0) AS ok FROM labels),
      r AS (SELECT 'recall' AS metric, CASE WHEN NOT ok THEN 'skipped' WHEN k % 3 <> 0 THEN 'skipped' ELSE 'scored' END AS state, CASE WHEN k % 7 = 0 THEN 'no answer' WHEN NOT ok THEN 'answer generation failed' WHEN k % 3 <> 0 THEN 'sample has no reference answer' END AS why, recall AS v FROM i
        UNION ALL SELECT 'faith', CASE WHEN NOT ok THEN 'skipped' WHEN faith IS NULL THEN 'errored' ELSE 'scored' END, CASE WHEN k % 7 = 0 THEN 'no answer' WHEN NOT ok THEN 'answer generation failed' WHEN faith IS NULL THEN 'judge failed' END, faith FROM i)
      SELECT metric, CAST(round(avg(v) FILTER (state = 'scored'), 4) AS DOUBLE) AS mean, count(*) FILTER (state = 'scored') AS scored, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'errored') AS errored, string_agg(DISTINCT why, '|' ORDER BY why) AS reasons FROM r GROUP BY 1""",
    "a25_evaluation_summary": "SELECT round(avg(value), 6) AS latency, count(*) AS items FROM events WHERE event_type <> 'error'",
    "a26_arm_comparison": """SELECT l_returnflag AS arm, l_linestatus AS "group", count(*) AS targets, count(*) FILTER (l_partkey % 3 = 0) AS hits, CAST(sum(l_linenumber) AS BIGINT) AS contexts, CAST(sum(l_linenumber % 2) AS BIGINT) AS graph_contexts
      FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""",
    "a27_run_counters": "SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS docs, count(*) FILTER (event_id % 9 = 0) AS truncated FROM events GROUP BY 1",
    "x26_validated_entities": """WITH l AS (SELECT l_orderkey % 97 AS d, l_orderkey % 3 AS ref, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS place, l_partkey % 4 = 0 AS bad_type, l_partkey % 9 = 0 AS bad_name, l_suppkey % 8 AS name FROM lineitem),
      f AS (SELECT d, ref, name, min(place) AS p FROM l WHERE NOT bad_type AND NOT bad_name GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY d, ref ORDER BY p) AS k FROM f)
      SELECT CASE WHEN l.ref = 2 THEN 'unknown_ref' WHEN bad_type THEN 'unknown_types' WHEN bad_name THEN 'invalid_names' WHEN k > 3 THEN 'over_limit' WHEN place > p THEN 'duplicates' ELSE 'kept' END AS verdict, count(*) AS n
      FROM l LEFT JOIN o ON o.d = l.d AND o.ref = l.ref AND o.name = l.name GROUP BY 1""",
    "q01_anchored_sets": "SELECT l_orderkey AS clause_id FROM lineitem INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0",
}
