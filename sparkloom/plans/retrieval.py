"""Retrieval on documents, embeddings and benchmark passages."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import retrieval as R
from sparkloom.operators import text_index as T
from sparkloom.operators import vector_index as V
from sparkloom.storage import stored
from sparkloom.tables import table


def corpus(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("title"), F.col("text").alias("content"))


def questions(s, d):
    """The query set: all benchmark passages, whole."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def hits(s, d):
    """Three legs of 50 ranked documents a query: BM25, cosine (by the vector of the query's number) and keyword overlap."""
    near = R.cosine_top_k(vectors(s, d).join(questions(s, d), F.col("id") == F.col("query_id"), "left_semi").select(F.col("id").alias("query_id"), "vector"), vectors(s, d), 50)
    legs = (R.bm25(questions(s, d), corpus(s, d), 50), near, R.keyword_overlap(questions(s, d), corpus(s, d).withColumn("tags", F.array(F.lit("t"))), 0.2, 50))
    rows = reduce(DataFrame.unionByName, (h.select("query_id", F.lit(k).alias("leg"), "id", "rank") for k, h in enumerate(legs)))
    return stored(rows.join(chunks(s, d).select("id", "source", "parent_id"), "id"))


#: Seeds of a query, neighbours of a seed, and what the graph adds to a query at most.
SEEDS, PER_SEED, GRAPH_CAP = 4, 5, 20


def document_edges(s, d):
    """A graph over documents: lines cite from their order's number to their part's, and an order mentions its suppliers."""
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def document_mentions(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("clause_id"), F.col("l_suppkey").alias("entity_id"))


def graph_hits(s, d):
    """Vector, BM25 and graph legs; the graph starts from the first documents of the other two, taken in turns."""
    near = R.cosine_top_k(vectors(s, d).join(questions(s, d), F.col("id") == F.col("query_id"), "left_semi").select(F.col("id").alias("query_id"), "vector"), vectors(s, d), 50)
    lexical = (near, R.bm25(questions(s, d), corpus(s, d), 50))
    known = corpus(s, d).select("id")
    rows = stored(reduce(DataFrame.unionByName, (h.select("query_id", F.lit(k).alias("leg"), "id", "rank") for k, h in enumerate(lexical))).join(known, "id", "left_semi"))
    seeds = R.interleave(rows.withColumn("key", F.col("id")), SEEDS).select("query_id", F.col("id").alias("seed"))
    reached = G.graph_leg(seeds, document_edges(s, d), document_mentions(s, d), 2, PER_SEED, GRAPH_CAP).withColumn("leg", F.lit(2))
    return stored(rows.unionByName(reached.select("id", "query_id", "leg", "rank")).join(known, "id", "left_semi"))


def chunks(s, d):
    """Documents as chunks; three share a parent, and every second one's parent has a text."""
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("ctx "), "content")).otherwise("")
    return corpus(s, d).select("id", "title", "content", F.col("title").alias("source"), F.concat(F.lit("p"), (F.col("id") / 3).cast("int").cast("string")).alias("parent_id"), text.alias("parent_text"))


TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[ \t\n\x0B\f\r]+'), lambda t: regexp_matches(t, '^[\p{{L}}\p{{M}}\p{{N}}]+$'))"
TOP = "SELECT {c}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {o}) AS INTEGER) AS rank FROM {t} QUALIFY rank <= {k}"
OVERLAP = r"""kq AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS ws FROM benchmark),
kw AS (SELECT query_id, len(ws) AS n, unnest(ws) AS w FROM kq),
kd AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(source || ' ' || text || ' t'), '[\p{L}\p{M}\p{N}\p{Pc}]+'))) AS w FROM documents),
kh AS (SELECT query_id, id, least(1.0, round(count(*) / any_value(n), 4)) AS score FROM kd JOIN kw USING (w) GROUP BY query_id, id HAVING score >= 0.2)"""
BM25 = f"""bt AS (SELECT doc_id AS id, {TOKENS.format("source || ' ' || text")} AS ts FROM documents),
bs AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM bt), bq AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark),
bp AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM bt) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
bf AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
bx AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bp JOIN bf USING (term) JOIN bq USING (term), bs GROUP BY 1, 2 HAVING score > 0)"""
COSINE = """cv AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cx AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 12) AS score FROM cv v, (SELECT * FROM cv WHERE {which}) q)"""
B_TOP, C_TOP, K_TOP = (lambda k, t=t, o=o: TOP.format(c="query_id, id, score", o=o, t=t, k=k) for t, o in (("bx", "round(score, 9) DESC, id"), ("cx", "score DESC, id"), ("kh", "score DESC, CAST(id AS VARCHAR)")))
HITS = f"""{OVERLAP}, {BM25}, {COSINE.format(which='id IN (SELECT item_id FROM benchmark)')}, legs AS (SELECT 0 AS leg, * FROM ({B_TOP(50)}) UNION ALL SELECT 1, * FROM ({C_TOP(50)}) UNION ALL SELECT 2, * FROM ({K_TOP(50)})),
hits AS (SELECT query_id, leg, id, rank, source, 'p' || CAST(id // 3 AS VARCHAR) AS parent_id FROM legs JOIN documents ON doc_id = id)"""
FUSED = f"""{HITS}, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, best, id) AS rank FROM (
  SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, min(rank) AS best, min(leg) AS leg, any_value(source) AS source, any_value(parent_id) AS parent_id FROM hits GROUP BY query_id, id))"""


def fused(s, d):
    h = hits(s, d)
    return R.fuse(h).join(h.select("query_id", "id", "source", "parent_id").distinct(), ["query_id", "id"])


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def near_queries(s, d):
    return vectors(s, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def ivf(s, d):
    """The approximate search, with as many probes as its tuning asks for."""
    index = V.build(vectors(s, d))
    return V.search(index, near_queries(s, d), 10, V.probes_for(index, near_queries(s, d), 10)).select("query_id", "id", "rank")


def prompts(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("title"), F.col("text").alias("content"))
    return rows.withColumn("supplementary", F.col("rank") % 3 == 2)


QUERIES = {
    "r01_keyword_overlap": lambda s, d: R.keyword_overlap(questions(s, d), corpus(s, d).withColumn("tags", F.array(F.lit("t"))), 0.2, 10),
    "r04_bm25": lambda s, d: R.bm25(questions(s, d), corpus(s, d), 10),
    "r04_bm25_blocks": lambda s, d: T.search(T.build(corpus(s, d)), questions(s, d), 10)[0],
    "r06_cosine_top_k": lambda s, d: R.cosine_top_k(near_queries(s, d), vectors(s, d), 10).select("query_id", "id", "rank"),
    "r06_ivf_top_k": ivf,
    "r06_ivf_exact": lambda s, d: V.search_exact(V.build(vectors(s, d)), near_queries(s, d), 10, 2).select("query_id", "id", "rank"),
    "r07_reciprocal_rank_fusion": lambda s, d: R.fuse(hits(s, d)).select("query_id", "id", "rank", "best", F.round("rrf_score", 9).alias("rrf_score")),
    "r08_collapse": lambda s, d: R.collapse(fused(s, d)).select("query_id", "id", "rank", "collapsed_siblings"),
    "r09_quota": lambda s, d: R.quota(fused(s, d), 3, 20, 3).select("query_id", "id", "role", "place"),
    "r09_quota_backfill": lambda s, d: R.quota(fused(s, d).withColumn("source", F.lit("one")), 3, 5, 2).select("query_id", "id", "role", "place"),
    "r11_expand": lambda s, d: R.expand(corpus(s, d).select("id", "content", F.when(F.col("id") % 2 == 0, F.concat(F.lit("ctx "), "content")).otherwise("").alias("parent_text"))).select("id", F.length("content").alias("n"), "matched_child_id", "matched_child_char_len", "expanded_to_parent"),
    "r12_hybrid": lambda s, d: R.hybrid(hits(s, d).select("query_id", "leg", "id", "rank"), chunks(s, d), questions(s, d), lambda q, t: F.length(t).cast("double"))
        .select("query_id", "id", "rank", "quota_overflow", "rerank_score", "expanded_to_parent", "matched_child_char_len", F.length("content").alias("n_chars")),
    "r12_graph_leg": lambda s, d: graph_hits(s, d).filter("leg = 2").select("query_id", "id", "rank"),
    "r12_hybrid_graph": lambda s, d: R.hybrid(graph_hits(s, d), chunks(s, d), questions(s, d), lambda q, t: F.length(t).cast("double"))
        .select("query_id", "id", "rank", "quota_overflow", "rerank_score", "expanded_to_parent", "matched_child_char_len", F.length("content").alias("n_chars")),
    "r14_prompt_budget": lambda s, d: R.within_budget(prompts(s, d), 600).select("query_id", F.col("rank").alias("turn"), "index", "size", "used"),
    "r16_refusals": lambda s, d: table(s, d, "part").select("p_partkey", R.refused(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("抱歉，检索到的法规片段不足，"), "p_name")).otherwise(F.col("p_name"))).alias("refused")),
    "r17_passes": lambda s, d: R.passes_summed(table(s, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.lit(0.25).alias("cost"), F.col("l_partkey").alias("latency_ms"), F.col("l_suppkey").alias("tokens"))),
    "r18_hop_hits": lambda s, d: R.hop_hits(
        table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("target"), F.lit("user").alias("title"), F.when(F.col("item_id") % 2 == 0, F.lit("1")).alias("section")),
        table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("title"), (F.col("turn") % 3).cast("string").alias("section"), F.col("turn").alias("rank")),
    ),
    "t07_interleave": lambda s, d: R.interleave(hits(s, d).withColumn("key", F.col("parent_id")), 12).select("query_id", "key", "place", "leg", "id"),
    "s12_upsert": lambda s, d: R.upserted(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("ord"), "p_name"), table(s, d, "part").filter("p_partkey % 4 = 0").select((F.col("p_partkey") + 2).alias("id"), F.lit(1).alias("ord"), F.lit("new").alias("p_name")), "id").select("id", "p_name"),
    "s13_point_lookup": lambda s, d: corpus(s, d).join(s.range(0, 50, 7).select("id"), "id", "left_semi").select("id", "title"),
}
RERANKED = """b AS (SELECT q.query_id, q.id, q.role, q.place, CAST(length(d.source || chr(10) || d.text) AS DOUBLE) AS rerank_score, length(d.text) AS n FROM quota q JOIN documents d ON d.doc_id = q.id),
      o AS (SELECT query_id, id, n, CAST(r AS INTEGER) AS rank, false AS quota_overflow, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS r FROM b WHERE role = 'kept') WHERE r <= 5
      UNION ALL SELECT query_id, id, n, 5 + place, true, NULL FROM b WHERE role = 'overflow')
      SELECT * EXCLUDE (n), id % 2 = 0 AS expanded_to_parent, CASE WHEN id % 2 = 0 THEN n END AS matched_child_char_len, n + CASE WHEN id % 2 = 0 THEN 4 ELSE 0 END AS n_chars FROM o"""
GRAPH = f"""{BM25}, {COSINE.format(which='id IN (SELECT item_id FROM benchmark)')}, two AS (SELECT * FROM (SELECT 0 AS leg, * FROM ({C_TOP(50)}) UNION ALL SELECT 1, * FROM ({B_TOP(50)})) WHERE id IN (SELECT doc_id FROM documents)),
turns AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank, leg) = 1),
seeds AS (SELECT query_id, id AS seed FROM turns QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, leg) <= {SEEDS}),
ce AS (SELECT l_orderkey AS seed, l_partkey AS clause_id FROM lineitem UNION ALL SELECT l_partkey, l_orderkey FROM lineitem), de AS (SELECT DISTINCT l_orderkey AS clause_id, l_suppkey AS entity_id FROM lineitem),
near AS (SELECT seed, clause_id, count(*) AS weight, 'cites' AS kind FROM ce WHERE seed IN (SELECT seed FROM seeds) AND seed <> clause_id GROUP BY 1, 2
  UNION ALL SELECT a.clause_id, b.clause_id, count(*), 'mentions' FROM de a JOIN de b USING (entity_id) WHERE a.clause_id IN (SELECT seed FROM seeds) AND a.clause_id <> b.clause_id GROUP BY 1, 2 HAVING count(*) >= 2),
reach AS (SELECT s.query_id, s.seed, n.clause_id, n.weight, n.kind FROM seeds s JOIN near n USING (seed) ANTI JOIN seeds x ON x.query_id = s.query_id AND x.seed = n.clause_id
  QUALIFY row_number() OVER (PARTITION BY s.query_id, s.seed, n.kind ORDER BY n.weight DESC, n.clause_id) <= {PER_SEED}),
kinds AS (SELECT query_id, clause_id, kind, sum(weight) AS weight, count(*) AS seeds FROM reach GROUP BY ALL),
leg AS (SELECT query_id, clause_id AS id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, max(seeds) DESC, max(CAST(kind = 'cites' AS INTEGER)) DESC, clause_id) AS INTEGER) AS rank FROM kinds GROUP BY 1, 2 QUALIFY rank <= {GRAPH_CAP}),
hits AS (SELECT query_id, leg, id, rank, source, 'p' || CAST(id // 3 AS VARCHAR) AS parent_id FROM (SELECT query_id, leg, id, rank FROM two UNION ALL SELECT query_id, 2, id, rank FROM leg) JOIN documents ON doc_id = id)"""
QUOTA = """, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 3 AS ok FROM {t}),
y AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS c, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS k,
  sum(CAST(ok AS INTEGER)) OVER (PARTITION BY query_id) AS total FROM x),
z AS (SELECT *, min(CASE WHEN ok AND c = {limit} THEN rank END) OVER (PARTITION BY query_id) AS cut FROM y),
w AS (SELECT *, CASE WHEN ok AND (total < {limit} OR rank <= cut) OR (NOT ok AND total < {limit} AND k <= {limit} - total) THEN 'kept'
  WHEN NOT ok AND ((total >= {limit} AND rank < cut) OR (total < {limit} AND k > {limit} - total)) THEN 'overflow' END AS role FROM z),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, role ORDER BY ok DESC, rank) AS INTEGER) AS place FROM w WHERE role IS NOT NULL),
quota AS (SELECT * FROM v WHERE role = 'kept' OR place <= {over})"""
COLLAPSED = """, collapsed AS (SELECT query_id, id, source, CASE WHEN n > 0 THEN n END AS collapsed_siblings, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY query_id, parent_id) - 1 AS n FROM fused) WHERE r = 1)"""
ORACLES = {
    "r01_keyword_overlap": f"WITH {OVERLAP} {K_TOP(10)}",
    "r04_bm25": f"WITH {BM25} SELECT query_id, id, round(score, 4) AS score, rank FROM ({B_TOP(10)})",
    "r04_bm25_blocks": f"WITH {BM25} SELECT query_id, id, round(score, 4) AS score, rank FROM ({B_TOP(10)})",
    "r06_cosine_top_k": f"WITH {COSINE.format(which='id % 20 = 0')} SELECT query_id, id, rank FROM ({C_TOP(10)})",
    "r06_ivf_exact": f"WITH {COSINE.format(which='id % 20 = 0')} SELECT query_id, id, rank FROM ({C_TOP(10)})",
    "r07_reciprocal_rank_fusion": f"WITH {FUSED} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, best, round(rrf_score, 9) AS rrf_score FROM fused",
    "r08_collapse": f"WITH {FUSED}{COLLAPSED} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, collapsed_siblings FROM collapsed",
    "r09_quota": f"WITH {FUSED}{QUOTA.format(t='fused', limit=20, over=3)} SELECT query_id, id, role, place FROM quota",
    "r09_quota_backfill": f"WITH {FUSED}{QUOTA.format(t='(SELECT * REPLACE (1 AS source) FROM fused)', limit=5, over=2)} SELECT query_id, id, role, place FROM quota",
    "r11_expand": """WITH x AS (SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 2 = 0 THEN 'ctx ' || text ELSE '' END AS parent FROM documents), y AS (SELECT *, coalesce(parent, '') <> '' AS has FROM x)
      SELECT id, length(CASE WHEN has THEN parent ELSE content END) AS n, CASE WHEN has THEN id END AS matched_child_id, CASE WHEN has THEN length(content) END AS matched_child_char_len, has AS expanded_to_parent FROM y""",
    "r12_hybrid": f"""WITH {FUSED}{COLLAPSED}{QUOTA.format(t='collapsed', limit=20, over=3)},
{RERANKED}""",
    "r12_graph_leg": f"WITH {GRAPH} SELECT query_id, id, rank FROM hits WHERE leg = 2",
    "r12_hybrid_graph": f"WITH {FUSED.replace(HITS, GRAPH)}{COLLAPSED}{QUOTA.format(t='collapsed', limit=20, over=3)}, {RERANKED}",
    "r14_prompt_budget": """WITH RECURSIVE r AS (SELECT conv_id AS query_id, turn, turn % 3 = 2 AS sup, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3 = 2, turn) AS index FROM conversations),
      b AS (SELECT *, length('[' || CAST(index AS VARCHAR) || '] ' || role || chr(10) || substring(text, 1, 2000)) AS size FROM r),
      g AS (SELECT query_id, index, turn, size, sup, size AS used, true AS taken, false AS stop FROM b WHERE index = 1
        UNION ALL SELECT b.query_id, b.index, b.turn, b.size, b.sup,
          CASE WHEN (g.stop AND b.sup = g.sup) OR g.used + b.size > 600 THEN g.used ELSE g.used + b.size END,
          NOT ((g.stop AND b.sup = g.sup) OR g.used + b.size > 600), (g.stop AND b.sup = g.sup) OR g.used + b.size > 600
        FROM g JOIN b ON b.query_id = g.query_id AND b.index = g.index + 1)
      SELECT query_id, turn, CAST(index AS INTEGER) AS index, CAST(size AS INTEGER) AS size, CAST(used AS BIGINT) AS used FROM g WHERE taken""",
    "r16_refusals": f"SELECT p_partkey, contains(answer, '{R.REFUSAL}') AS refused FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '抱歉，检索到的法规片段不足，' || p_name ELSE p_name END AS answer FROM part)",
    "r17_passes": "SELECT l_orderkey AS answer_id, sum(CAST(0.25 AS DOUBLE)) AS cost, CAST(sum(l_partkey) AS BIGINT) AS latency_ms, CAST(sum(l_suppkey) AS BIGINT) AS tokens, count(*) AS passes FROM lineitem GROUP BY 1",
    "r18_hop_hits": """SELECT b.item_id AS query_id, b.item_id AS target, min(CASE WHEN b.item_id % 2 <> 0 OR CAST(c.turn % 3 AS VARCHAR) = '1' THEN c.turn END) AS first_rank
      FROM benchmark b LEFT JOIN conversations c ON c.conv_id = b.item_id AND c.role = 'user' GROUP BY b.item_id""",
    "t07_interleave": f"""WITH {HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank, leg) AS f FROM hits)
      SELECT query_id, parent_id AS key, CAST(place AS INTEGER) AS place, leg, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, leg) AS place FROM f WHERE f = 1) WHERE place <= 12""",
    "s12_upsert": """SELECT id, arg_max(n, w) AS p_name FROM (SELECT p_partkey AS id, 0 AS w, p_name AS n FROM part UNION ALL SELECT p_partkey + 2, 1, 'new' FROM part WHERE p_partkey % 4 = 0) GROUP BY id""",
    "s13_point_lookup": "SELECT doc_id AS id, source AS title FROM documents WHERE doc_id < 50 AND doc_id % 7 = 0",
}
