"""Clause graph: clauses from a chunk snapshot, citations, document edges, neighbours over one and two hops.

Node and edge sets are plain tables; a hop is an equi-join. Orders of appearance are columns (`ord`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.storage import BROADCAST_BYTES, small, stored


def clauses(chunks: DataFrame) -> DataFrame:
    """clause_id, ord, doc_id, title, section, article, text, chunk_ids of chunks (ord, id, title, content, source, parent_id,
    parent_text, section): grouped by parent, else by id; the first chunk names it, the longest text counts."""
    rows = chunks.withColumn("clause_id", F.coalesce(F.nullif(F.trim("parent_id"), F.lit("")), F.col("id")))
    rows = rows.withColumn("doc_id", F.concat(F.lit("doc:"), F.replace(F.coalesce("source", F.lit("")), F.lit("\\"), F.lit("/"))))
    longest = lambda c: F.max(F.struct(F.length(c).alias("n"), (-F.col("ord")).alias("o"), F.col(c).alias("t")))["t"]
    first = lambda c: F.min(F.struct("ord", c))[c]
    out = rows.withColumn("parent_text", F.coalesce("parent_text", F.lit(""))).groupBy("clause_id").agg(
        F.min("ord").alias("ord"),
        first("doc_id").alias("doc_id"),
        first("title").alias("title"),
        first("section").alias("section"),
        F.coalesce(F.nullif(longest("parent_text"), F.lit("")), longest("content")).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("chunk_ids"),
    )
    return out.withColumn("article", X.section_article(F.col("section")))


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def articles(clause_rows: DataFrame) -> DataFrame:
    """doc_id, article, clause_id: the first clause of each article."""
    return first_by(clause_rows.filter("article IS NOT NULL"), ["doc_id", "article"], "ord").select("doc_id", "article", "clause_id")


def title_index(clause_rows: DataFrame) -> DataFrame:
    """name, doc_id: full and short names of the documents; of equal names the first document's counts."""
    docs = first_by(clause_rows, ["doc_id"], "ord").filter(F.coalesce("title", F.lit("")) != "").select("ord", "doc_id", "title")
    names = docs.select("ord", "doc_id", F.posexplode(F.array(X.normal_title(F.col("title")), X.short_title(F.col("title")))).alias("k", "name"))
    return first_by(names.filter("name <> ''"), ["name"], "ord").select("name", "doc_id")


def _index(clause_rows: DataFrame, index: DataFrame | None) -> DataFrame:
    return title_index(clause_rows) if index is None else index


class SuffixTrie:
    """Names read from their ends, as arcs (node, letter) to a node; a node where a name begins has that name's document."""

    def __init__(self, names: list[tuple[str, str]]):
        self.arcs: dict = {}
        self.docs: dict = {}
        for name, doc in names:
            node = 0
            for letter in reversed(name):
                node = self.arcs.setdefault((node, letter), len(self.arcs) + 1)
            self.docs[node] = doc

    def longest(self, text: str) -> str | None:
        """The document of the longest name that the text ends with."""
        node, found = 0, None
        for letter in reversed(text):
            node = self.arcs.get((node, letter))
            if node is None:
                break
            found = self.docs.get(node, found)
        return found


def resolved(names: DataFrame, index: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds doc (null if unknown) to rows with `name`: the longest known suffix of the name. An index of most_bytes at most becomes a
    trie of reversed names, which is sent to the tasks and walked once a distinct name; beyond, the suffixes of the lengths that known
    names have meet the index by equality."""
    index = stored(index)
    distinct = names.select("name").distinct().withColumn("n", X.normal_title(F.col("name"))).filter("n <> ''")
    size = index.agg(F.coalesce(F.sum(F.length("name") * 120 + F.length("doc_id") + 100), F.lit(0)).alias("b")).first()["b"]  # arcs are dictionary entries
    if size <= most_bytes:
        trie = SuffixTrie([(r["name"], r["doc_id"]) for r in index.select("name", "doc_id").collect()])
        walk = F.pandas_udf(lambda n: n.map(trie.longest), "string")
        best = distinct.select("name", walk("n").alias("doc")).filter("doc IS NOT NULL")
    else:
        lengths = index.select(F.length("name").alias("size")).distinct()
        ends = distinct.join(small(stored(lengths)), F.col("size") <= F.length("n")).withColumn("suffix", F.right("n", F.col("size")))
        found = ends.join(index.select(F.col("name").alias("suffix"), F.col("doc_id").alias("doc")), "suffix")
        best = found.groupBy("name").agg(F.max_by("doc", "size").alias("doc"))
    return names.join(best, "name", "left")


def cites(clause_rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """src, dst, place, law, article, paragraph, item, cross_doc, outcome (edge, unknown_law, unknown_clause) of every citation. A
    self-reference means the own document; an article that isn't there, or the clause itself, is an unknown clause."""
    found = clause_rows.select("clause_id", "doc_id", F.posexplode(X.citations(F.col("text"))).alias("place", "c"))
    found = found.select(F.col("clause_id").alias("src"), F.col("doc_id").alias("own"), "place", F.col("c.law").alias("name"), "c.article", "c.paragraph", "c.item")
    rows = resolved(found, _index(clause_rows, index)).withColumn("target", F.when(F.col("name").startswith("本"), F.col("own")).otherwise(F.col("doc")))
    where = articles(clause_rows).select(F.col("doc_id").alias("target"), "article", F.col("clause_id").alias("dst"))
    rows = rows.join(where, ["target", "article"], "left")
    outcome = F.when(F.col("target").isNull(), "unknown_law").when(F.col("dst").isNull() | (F.col("dst") == F.col("src")), "unknown_clause").otherwise("edge")
    return rows.select("src", F.when(outcome == "edge", F.col("dst")).alias("dst"), "place", F.col("name").alias("law"), "article", "paragraph", "item", (F.col("target") != F.col("own")).alias("cross_doc"), outcome.alias("outcome"))


def implements(clause_rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """src, dst: from a regulation's document to the law that it implements."""
    docs = first_by(clause_rows, ["doc_id"], "ord").select("doc_id", X.implemented_title(F.col("title")).alias("name")).filter("name IS NOT NULL")
    return resolved(docs, _index(clause_rows, index)).filter("doc IS NOT NULL AND doc <> doc_id").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst"))


def references(clause_rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """src, dst: distinct, from a document to another that it names in 《》."""
    named = clause_rows.select("doc_id", F.explode(X.title_references(F.col("text"))).alias("name"))
    return resolved(named, _index(clause_rows, index)).filter("doc IS NOT NULL AND doc <> doc_id").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst")).distinct()


def structure_stats(clause_rows: DataFrame) -> DataFrame:
    """measure, n. Citations are counted once, by outcome, and clauses once, by document; the figures are sums of these counts."""
    clause_rows = stored(clause_rows)
    index = stored(title_index(clause_rows))
    count, total = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    outcomes = stored(cites(clause_rows, index).groupBy("outcome", "cross_doc").agg(count))
    documents = stored(clause_rows.groupBy("doc_id").agg(count))
    parts = {
        "clauses": documents.agg(total), "documents": documents.agg(count), "citations": outcomes.filter("outcome = 'edge'").agg(total), "citations_cross_doc": outcomes.filter("outcome = 'edge' AND cross_doc").agg(total),
        "unresolved_law": outcomes.filter("outcome = 'unknown_law'").agg(total), "unresolved_clause": outcomes.filter("outcome = 'unknown_clause'").agg(total), "implements": implements(clause_rows, index).agg(count), "references": references(clause_rows, index).agg(count),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("measure"), "n") for name, df in parts.items()))


def merged_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge for each (src, dst): occurrences, and the first one's attributes (by ord); with nodes only edges of known ends."""
    attributes = [c for c in edges.columns if c not in ("src", "dst", "ord")]
    first = [F.min(F.struct("ord", c))[c].alias(c) for c in attributes]
    out = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("occurrences"), *first)
    if nodes is not None:
        for end in ("src", "dst"):
            out = out.join(nodes.select(F.col("clause_id").alias(end)), end, "left_semi")
    return out


def cites_neighbours(edges: DataFrame, seeds: DataFrame, per_seed: int | None, apart: bool = True) -> DataFrame:
    """seed, clause_id, weight: over citations in either direction, weight the number of edges; all seeds are left out (apart), or only
    the seed itself."""
    both = edges.select(F.col("src").alias("seed"), F.col("dst").alias("clause_id")).unionByName(edges.select(F.col("dst").alias("seed"), F.col("src").alias("clause_id")))
    rows = both.join(seeds.select("seed").distinct(), "seed", "left_semi").filter("seed <> clause_id")
    if apart:
        rows = rows.join(seeds.select(F.col("seed").alias("clause_id")).distinct(), "clause_id", "left_anti")
    return _capped(rows.groupBy("seed", "clause_id").agg(F.count(F.lit(1)).alias("weight")), per_seed)


#: An entity with more mentions than this is heavy: its mentions are dealt into parts of about this many.
HEAVY = 10_000


def met_by_entity(left: DataFrame, right: DataFrame, heavy: int = HEAVY, tasks: int | None = None) -> DataFrame:
    """left joined with right on entity_id, by a heavy/light split: an entity with more than `heavy` rows in right has them dealt into
    salted parts, and its rows in left go to each part; all other entities meet in one task. Columns of the two must differ but for it.
    tasks: into how many tasks the parts go, where the result is far larger than what Spark deals by."""
    degrees = right.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy)
    parts = small(stored(degrees.select("entity_id", F.ceil(F.col("_n") / heavy).cast("int").alias("_parts"))))
    dealt = lambda rows, salt: rows.join(parts, "entity_id", "left").withColumn("_salt", salt).drop("_parts")
    spread = F.when(F.col("_parts").isNull(), 0).otherwise(F.floor(F.rand(7) * F.col("_parts"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    # the salt is drawn and kept before the join, so that a part that is worked on again is the same
    sides = dealt(left, every), stored(dealt(right, spread))
    if tasks is not None:
        sides = tuple(rows.repartition(tasks, "entity_id", "_salt") for rows in sides)
    return sides[0].join(sides[1], ["entity_id", "_salt"]).drop("_salt")


#: Rows of mentions, and pairs of a seed and what it shares an entity with, that a task works on; and into how many parts a seed's go.
TASK_ROWS, SEED_PARTS = 500_000, 4


def mentions_neighbours(mentions: DataFrame, seeds: DataFrame, min_shared: int, per_seed: int | None, heavy: int = HEAVY, apart: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """seed, clause_id, weight: clauses that share min_shared distinct entities or more with a seed (mentions: clause_id, entity_id);
    all seeds are left out (apart), or only the seed itself.
    Only the seeds' mentions meet the others, so the join is as large as what the seeds touch; hub entities are met in salted parts.
    How many pairs come of it is counted before, and rows and pairs are dealt into as many tasks as hold task_rows each: they are narrow,
    so that Spark, which deals by bytes, would leave a task more of them the larger the tables are."""
    n = 1 + mentions.count() // task_rows
    own = mentions.select("clause_id", "entity_id").repartition(n, "clause_id", "entity_id").distinct()
    marks = stored(seeds.select(F.col("seed").alias("clause_id")).distinct().withColumn("_seed", F.lit(True)))
    known = small(marks)
    if known is marks:  # not sent to all tasks
        own, known = own.repartition(n, "clause_id"), marks.repartition(n, "clause_id")
    own = stored(own.join(known, "clause_id", "left").withColumn("_seed", F.col("_seed").isNotNull()))
    start = own.filter("_seed").select(F.col("clause_id").alias("seed"), "entity_id")
    others = (own.filter("NOT _seed") if apart else own).drop("_seed")
    # an entity's mentions are counted in parts, each within a task
    counts = own.repartition(n, "entity_id", F.pmod(F.xxhash64("clause_id"), F.lit(16))).groupBy("entity_id")
    counts = counts.agg(F.count_if("_seed").alias("a"), F.count_if(~F.col("_seed") if apart else F.lit(True)).alias("m"))
    pairs = counts.agg(F.sum(F.col("a").cast("double") * F.col("m")).alias("n")).first()["n"] or 0
    tasks = 1 + int(pairs // task_rows)
    part = F.pmod(F.xxhash64("clause_id"), F.lit(SEED_PARTS))
    rows = met_by_entity(start, others, heavy, max(n, tasks)).filter("seed <> clause_id").select("seed", "clause_id", part.alias("_part"))
    rows = rows.repartition(tasks, "seed", "_part").groupBy("seed", "_part", "clause_id").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= min_shared)
    if per_seed is None:
        return rows.drop("_part")
    # the best of each part, then of these
    return _capped(_capped(rows, per_seed, "_part").drop("_part").repartition(tasks, "seed"), per_seed)


def _capped(rows: DataFrame, per_seed: int | None, *within: str) -> DataFrame:
    if per_seed is None:
        return rows
    order = Window.partitionBy("seed", *within).orderBy(F.desc("weight"), "clause_id")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_seed).drop("_r")


def ranked_neighbours(rows: DataFrame, kind: str, cap: int) -> DataFrame:
    """clause_id, weight, seeds, kinds, rank over all seeds; null and empty ids dropped, a missing weight is 0."""
    clean = rows.filter(F.coalesce(F.col("clause_id").cast("string"), F.lit("")) != "")
    summed = clean.groupBy("clause_id").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("weight"), F.count_distinct("seed").alias("seeds")).withColumn("kinds", F.array(F.lit(kind)))
    return _ranked(summed, cap)


def _ranked(rows: DataFrame, cap: int) -> DataFrame:
    """The cap bounds what is ranked: the best `cap` rows are taken by a top-k before they are numbered."""
    keys = [F.desc("weight"), F.desc("seeds"), F.when(F.array_contains("kinds", "cites"), 0).otherwise(1), F.asc("clause_id")]
    best = rows.orderBy(*keys).limit(cap)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def merged_neighbours(legs: list[DataFrame], cap: int) -> DataFrame:
    """The legs' rows of a clause as one: weights added, kinds united, the larger number of seeds."""
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    one = rows.groupBy("clause_id").agg(F.sum("weight").alias("weight"), F.max("seeds").alias("seeds"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    return _ranked(one, cap)


def graph_leg(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, min_shared: int, per_seed: int, cap: int) -> DataFrame:
    """query_id, id, rank: what the graph reaches from each query's seeds (query_id, seed), over citations and shared entities: of each
    seed and kind the best per_seed that aren't seeds of the query, weights added, the best `cap` of each query.

    A seed's neighbours are found once, whatever the queries; since a query's own seeds have to be left out of them, so many more are
    taken for each."""
    seeds = stored(seeds.select("query_id", "seed").distinct())
    most = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    kinds = {"cites": cites_neighbours(edges, seeds, per_seed + most, apart=False), "mentions": mentions_neighbours(mentions, seeds, min_shared, per_seed + most, apart=False)}
    near = reduce(DataFrame.unionByName, (rows.select("seed", "clause_id", "weight", F.lit(kind).alias("kind")) for kind, rows in kinds.items()))
    near = near.filter(F.coalesce(F.col("clause_id").cast("string"), F.lit("")) != "")
    rows = seeds.join(near, "seed").join(seeds.select("query_id", F.col("seed").alias("clause_id")), ["query_id", "clause_id"], "left_anti")
    best = Window.partitionBy("query_id", "seed", "kind").orderBy(F.desc("weight"), "clause_id")
    rows = rows.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= per_seed)
    by_kind = rows.groupBy("query_id", "clause_id", "kind").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("seeds"))
    one = by_kind.groupBy("query_id", "clause_id").agg(F.sum("weight").alias("weight"), F.max("seeds").alias("seeds"), F.max(F.col("kind") == "cites").alias("cited"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), F.desc("seeds"), F.desc("cited"), "clause_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("query_id", F.col("clause_id").alias("id"), "rank")


def rehydrated(neighbours: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours with the first chunk of their clause; those without one are dropped."""
    rows = chunks.withColumn("clause_id", F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.col("id")))
    return neighbours.join(first_by(rows, ["clause_id"], "ord").select("clause_id", "id", "title", "content"), "clause_id")


def paths_up_to_two(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """a, b, paths: undirected paths of one or two different edges between ends (edges: edge_id, src, dst)."""
    both = edges.select("edge_id", F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select("edge_id", F.col("dst").alias("u"), F.col("src").alias("v")))
    a, b = ends.select(F.col("id").alias("a")), ends.select(F.col("id").alias("b"))
    from_a = both.join(a, both["u"] == a["a"]).select("a", "edge_id", F.col("v").alias("m"))
    one = from_a.join(b, from_a["m"] == b["b"]).select("a", "b")
    second = both.select(F.col("u").alias("m"), F.col("edge_id").alias("edge2"), F.col("v").alias("b"))
    two = from_a.join(second, "m").filter("edge_id <> edge2").join(b, "b", "left_semi").select("a", "b")
    return one.unionByName(two).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("paths"))


def shared_entities(mentions: DataFrame, ends: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """sample, left, right, shared: the most entities that a clause of one endpoint of a sample shares with one of another (ends: sample,
    endpoint, clause_id). Samples meet entities, and an entity that crowds a sample is met in salted parts."""
    rows = stored(ends.select("sample", "endpoint", "clause_id").join(mentions.select("clause_id", "entity_id").distinct(), "clause_id"))
    at = F.struct("sample", "entity_id").alias("entity_id")
    x = rows.select(at, F.col("endpoint").alias("left"), F.col("clause_id").alias("c1"))
    y = rows.select(at, F.col("endpoint").alias("right"), F.col("clause_id").alias("c2"))
    pairs = met_by_entity(x, y, heavy).filter("left < right")
    each = pairs.groupBy(F.col("entity_id.sample").alias("sample"), "left", "right", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("sample", "left", "right").agg(F.max("n").alias("shared"))


def endpoint_pairs(ends: DataFrame) -> DataFrame:
    """sample, left, right: the pairs of endpoints of each sample, which names a few."""
    names = ends.select("sample", "endpoint").distinct()
    return names.withColumnRenamed("endpoint", "left").join(names.withColumnRenamed("endpoint", "right"), "sample").filter("left < right")


def hop_coverage(ends: DataFrame, edges: DataFrame, mentions: DataFrame, min_shared: int) -> DataFrame:
    """One row: pairs of endpoints of a sample, how many are linked by citations, by mentions, by either, and whether all are."""
    direct = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = ends.select("sample", "endpoint", "clause_id")
    cited = (
        direct.join(e.select("sample", F.col("clause_id").alias("src"), F.col("endpoint").alias("left")), "src")
        .join(e.select("sample", F.col("clause_id").alias("dst"), F.col("endpoint").alias("right")), ["sample", "dst"])
        .filter("left < right").groupBy("sample", "left", "right").agg(F.count(F.lit(1)).alias("cites"))
    )
    keys = ["sample", "left", "right"]
    rows = endpoint_pairs(ends).join(cited, keys, "left").join(shared_entities(mentions, ends), keys, "left")
    rows = rows.select((F.coalesce("cites", F.lit(0)) > 0).alias("c"), (F.coalesce("shared", F.lit(0)) >= min_shared).alias("m"))
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("c").alias("by_cites"), F.count_if("m").alias("by_mentions"), F.count_if(F.col("c") | F.col("m")).alias("linked"),
        ((F.count(F.lit(1)) > 0) & (F.count_if(F.col("c") | F.col("m")) == F.count(F.lit(1)))).alias("complete"),
    )


def chain_counts(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """name, matches: paths of two edges whose ends carry the wanted labels (edges: src, dst; patterns: name, first, middle, last ids)."""
    one = edges.select(F.col("src").alias("first"), F.col("dst").alias("middle"))
    two = edges.select(F.col("src").alias("middle"), F.col("dst").alias("last"))
    found = patterns.join(one, ["first", "middle"]).join(two, ["middle", "last"]).groupBy("name").agg(F.count(F.lit(1)).alias("matches"))
    return patterns.select("name").join(found, "name", "left").select("name", F.coalesce("matches", F.lit(0)).alias("matches"))


#: Where samples ask for whole documents: samples of a slice and slices of a document, clauses of a block and blocks of a part, and rows
#: that a task makes of such.
SLICE, MOST_SLICES, BLOCK, PART_BLOCKS, WHOLE_ROWS = 2_000, 256, 1_000, 8, 20_000_000


def met_in_blocks(asked: DataFrame, members: DataFrame) -> DataFrame:
    """sample_id, label, ids: asked (sample_id, label, doc) joined with members (doc, clause_id; both distinct and stored) on doc, the
    clauses in arrays, for a result far larger than both.

    A document's clauses lie in arrays, some of which make a part, and its samples in slices; slice and part meet in one task, as many
    as make about WHOLE_ROWS. So what is shuffled is a sample once a part and an array once a slice, and no task has more than
    others whichever document is asked for."""
    a, m = (rows.groupBy("doc").agg(F.count(F.lit(1)).cast("double").alias(n)) for rows, n in ((asked, "a"), (members, "m")))
    sizes = stored(a.join(m, "doc"))
    total = sizes.agg(F.sum(F.col("a") * F.col("m")).alias("rows"), F.sum(F.col("a") + F.col("m")).alias("ends")).first()
    tasks = 1 + int(max((total["rows"] or 0) // WHOLE_ROWS, (total["ends"] or 0) // TASK_ROWS))
    slices, blocks = F.least(F.ceil(F.col("a") / SLICE), F.lit(MOST_SLICES)), F.ceil(F.col("m") / BLOCK)
    heavy = small(sizes.filter((F.col("a") > SLICE) | (F.col("m") > BLOCK)).select("doc", slices.alias("_slices"), blocks.alias("_blocks")))
    dealt = lambda rows: rows.join(heavy, "doc", "left").fillna(1, ["_slices", "_blocks"])
    part = lambda block: F.floor(block / PART_BLOCKS)
    left = dealt(asked).withColumn("_slice", F.pmod(F.xxhash64("sample_id", "label"), "_slices"))
    left = left.select("sample_id", "label", "doc", "_slice", F.explode(F.sequence(F.lit(0).cast("long"), part(F.col("_blocks") - 1))).alias("_part"))
    right = dealt(members).groupBy("doc", "_slices", F.pmod(F.xxhash64("clause_id"), "_blocks").alias("_block"))
    right = right.agg(F.collect_list("clause_id").alias("ids"), F.count_if(F.col("clause_id").isNull()).alias("nulls"))
    ids = F.when(F.col("nulls") > 0, F.array_append("ids", F.lit(None).cast("string"))).otherwise(F.col("ids"))
    right = right.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)).alias("_slice"), part(F.col("_block")).alias("_part"), ids.alias("ids"))
    keys = ["doc", "_slice", "_part"]
    left, right = (rows.repartition(tasks, *keys) for rows in (left, right))
    # the planner doesn't know how often arrays are repeated, and might send them to all tasks
    return left.join(right.hint("merge"), keys).select("sample_id", "label", "ids")


def endpoints(samples: DataFrame, clause_rows: DataFrame, in_blocks: bool = False) -> DataFrame:
    """sample_id, label, clause_id of what reference texts (sample_id, text) need: cited clauses, and all clauses of documents that are
    named without an article. What can't be resolved, self-references too, has a null clause_id; each label comes once.

    Labels are made distinct before they meet clauses: those of cited clauses end in 条 and those of documents in 》, so none is in both,
    and the rows, as many as samples times clauses of a document, needn't be shuffled. In blocks, a row has
    an array `ids` of some clauses of its label in place of clause_id: who makes rows of these last has no union between them and what
    reads them, so that rows that are only counted aren't built."""
    clause_rows = stored(clause_rows.select("clause_id", "ord", "doc_id", "title", "article"))
    index = stored(title_index(clause_rows))
    found = samples.select("sample_id", F.explode(X.citations(F.col("text"))).alias("c")).select("sample_id", F.col("c.law").alias("name"), "c.article").distinct()
    cited = resolved(found, index).withColumn("doc", F.when(~F.col("name").startswith("本"), F.col("doc")))
    where = articles(clause_rows).withColumnRenamed("doc_id", "doc")
    cited = cited.join(where, ["doc", "article"], "left").withColumn("label", F.concat("name", F.lit("第"), F.col("article").cast("string"), F.lit("条")))
    cited = stored(cited.select("sample_id", "label", "clause_id", "name"))
    covered = cited.filter("clause_id IS NOT NULL").select("sample_id", X.normal_title(F.col("name")).alias("name")).distinct()
    named = samples.select("sample_id", F.explode(X.title_references(F.col("text"))).alias("name")).distinct().join(covered, ["sample_id", "name"], "left_anti")
    whole = resolved(named, index).select("sample_id", F.concat(F.lit("《"), "name", F.lit("》")).alias("label"), "doc")
    whole = stored(whole.distinct())
    members = stored(clause_rows.select(F.col("doc_id").alias("doc"), "clause_id").distinct())
    met = met_in_blocks(whole.filter("doc IS NOT NULL"), members)
    unknown = whole.filter("doc IS NULL").select("sample_id", "label", F.lit(None).cast("string").alias("clause_id"))
    one = cited.select("sample_id", "label", "clause_id").distinct().unionByName(unknown)
    if in_blocks:
        return one.select("sample_id", "label", F.array("clause_id").alias("ids")).unionByName(met)
    return one.unionByName(met.select("sample_id", "label", F.explode("ids").alias("clause_id")))


def reachability(mentions: DataFrame, seeds: DataFrame, targets: DataFrame, thresholds: DataFrame, cap: int) -> DataFrame:
    """seed, min_shared, neighbours, capped_rank, rank: for each threshold (min_shared) how many clauses a seed reaches, and the rank of
    its target (seed, target) among all and, if within it, under the cap."""
    near = mentions_neighbours(mentions, seeds, 1, None).join(small(stored(thresholds)), F.col("weight") >= F.col("min_shared"))
    order = Window.partitionBy("seed", "min_shared").orderBy(F.desc("weight"), "clause_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).join(targets, "seed")
    rank = F.min(F.when(F.col("clause_id") == F.col("target"), F.col("rank")))
    out = ranked.groupBy("seed", "min_shared").agg(F.count(F.lit(1)).alias("neighbours"), rank.alias("rank"))
    return out.withColumn("capped_rank", F.when(F.col("rank") <= cap, F.col("rank")))
