"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents.

A source's documents are dealt into blocks by a keyed hash; a block is read in the order of another hash. The mix takes
whole passes over a source and then, for the rest of its quota, its first blocks in permuted order, the last one cut within.
What the mix takes of a block in one pass is a drawn block. The tree splits the drawn blocks of all sources among the output shards:
a node halves its shards and draws, without replacement, how many drawn blocks of each source go left, so that shards differ by one
block at most. A leaf's blocks are disjoint, and its rows are ordered by hash.

Rows are known by doc_id and a hash of all their columns. Rows that are equal in these stand as one with their number; how many of them
are in the part of the last pass is a number, too, so that they may be any share of all rows.

Cases: a null text has size 0; null is a source of its own, the last; empty documents are taken whole passes only; rows that
share a doc_id, or have none, are judged each; very long texts are taken whole; an empty table gives an empty result; further columns,
of any name, are kept by `mixed` and part of what knows a row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._base import documents, n_words_of, packed, small, stored, unpacked

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
DOCS_PER_BLOCK = 2000
SHARDS = 16
#: Equal rows that are listed together.
CUT = 4096
SEED = 7


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, n_docs, target of each source; one row a source. sizes: source, size, m (how many rows are so).

    With the sources sorted by max_passes * size / weight, those that reach their limit are a prefix; the share of a unit
    of weight follows from what the prefix leaves, so no rounds of resharing are needed.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    ranked = by.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", max_passes * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "i")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    total, weight_sum = F.sum("source_size").over(all_rows), F.sum("weight").over(all_rows)
    ranked = ranked.withColumn(
        "unit", (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / (weight_sum - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # the first source below its limit sets the unit for itself and all after it
    free = F.min(F.when(F.col("unit") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), "i", "unit"))).over(all_rows)
    target = F.least(F.col("most").cast("double"), F.coalesce(free["unit"] * F.col("weight"), F.col("most").cast("double")))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def _key(*parts: Column | str) -> Column:
    """15 hexadecimal digits of an MD5, as a number: equal in every engine and in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def before(rows: DataFrame, amount: str, name: str, tie: tuple) -> DataFrame:
    """Adds the sum of `amount` over the source's rows that come earlier by place (60 bits, spread evenly), then tie. Sums of 1024 bins
    of places come first, so that no task has all rows of a source."""
    rows = rows.withColumn("_bin", F.shiftright("place", 50))
    bins = rows.groupBy("source_key", "_bin").agg(F.sum(amount).alias("_sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy("source_key").orderBy("_bin"))), F.lit(0))).drop("_sum")
    own = F.sum(amount).over(earlier(Window.partitionBy("source_key", "_bin").orderBy("place", *tie)))
    return rows.join(bins, ["source_key", "_bin"]).withColumn(name, F.col("_base") + F.coalesce(own, F.lit(0))).drop("_bin", "_base")


def draw(sizes: DataFrame, docs_per_block: int = DOCS_PER_BLOCK, seed: int = SEED) -> DataFrame:
    """The groups of equal rows (doc_id, key, source, size, m) with block, ord, passes (of all rows) and extra (rows taken once more)."""
    goal = targets(sizes).withColumn("n_blocks", F.ceil(F.col("n_docs") / docs_per_block)).withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    doc = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "key")
    rows = rows.withColumn("block", _key(F.lit(f"{seed}b"), doc) % F.col("n_blocks")).withColumn("ord", _key(F.lit(f"{seed}o"), doc))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = rows.groupBy("source_key", "block").agg(F.sum(F.col("size") * F.col("m")).alias("block_size"), F.min("rest").alias("rest"))
    place = _key(F.lit(f"{seed}p"), F.col("source_key").cast("string"), F.col("block").cast("string"))
    blocks = before(stored(blocks.withColumn("place", place)), "block_size", "before", ("block",))
    blocks = blocks.withColumn("left", F.col("rest") - F.col("before")).select("source_key", "block", "left", "block_size")
    rows = rows.join(blocks, ["source_key", "block"])
    within = Window.partitionBy("source_key", "block").orderBy("ord", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.col("size") * F.col("m")).over(within), F.lit(0))
    # the row at the cut is in if half of it or more fits
    fit = F.floor((F.col("left") - upto) / F.col("size") + 0.5)
    some = F.when(F.col("left") >= F.col("block_size"), F.col("m")).when(F.col("left") > 0, F.greatest(F.lit(0), F.least(F.col("m"), fit))).otherwise(0)
    return rows.withColumn("extra", F.when((F.col("size") > 0) & (F.col("passes") < MAX_PASSES), some).otherwise(0).cast("long"))


def split(counts: dict, shards: int, seed: int = SEED) -> dict:
    """{shard: {source_key: blocks}}: the splitting tree. At each node the left half of the shards gets a multivariate
    hypergeometric draw, without replacement, of the node's blocks; the right half gets the others."""
    keys = sorted(counts)
    out: dict = {}

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = dict(zip(keys, map(int, have)))
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        rng = np.random.default_rng([seed, lo, hi])
        want = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, want, method="marginals") if total else have
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.array([counts[k] for k in keys], dtype=np.int64))
    return out


def shards_of(drawn: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source_key, block, pass, shard of the drawn blocks. The driver sees one count a source; the leaves' quotas go back as rows and
    meet the permuted blocks by their rank within the source."""
    spark = drawn.sparkSession
    counts = {r["source_key"]: r["n"] for r in drawn.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    tree = split(counts, shards, seed) if counts else {}
    quotas, upto = [], Counter()
    for shard in sorted(tree):
        for key, n in tree[shard].items():
            if n:
                quotas.append((key, shard, upto[key], upto[key] + n))
                upto[key] += n
    quota = spark.createDataFrame(pd.DataFrame(quotas, columns=["source_key", "shard", "lo", "hi"]), "source_key long, shard int, lo long, hi long")
    place = _key(F.lit(f"{seed}s"), F.col("source_key").cast("string"), F.col("block").cast("string"), F.col("pass").cast("string"))
    ranked = before(stored(drawn.withColumn("place", place).withColumn("_one", F.lit(1))), "_one", "r", ("block", "pass"))
    dealt = ranked.join(quota, "source_key").filter((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return dealt.select("source_key", "block", "pass", "shard")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of `row` (those that can't be hashed, as JSON)."""
    plain = ("map", "variant", "interval")
    kind = lambda f: any(k in f.dataType.simpleString() for k in plain)
    parts = [F.to_json(F.struct(F.col("row")[f.name])) if kind(f) else F.col("row")[f.name] for f in docs.schema]
    # a null is left out by the hash: its place is hashed as well
    return F.xxhash64(*parts, *(F.col("row")[f.name].isNull() for f in docs.schema))


def _keyed(docs: DataFrame) -> DataFrame:
    return packed(docs).select("row", F.col("row")["doc_id"].alias("doc_id"), row_key(docs).alias("key"))


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of a group's m equal rows, with its number i; large groups are cut first and their parts dealt anew."""
    numbered = lambda lo, hi: F.explode(F.sequence(lo, hi))
    few = rows.filter(F.col("m") <= CUT).withColumn("i", numbered(F.lit(0).cast("long"), F.col("m") - 1))
    cut = rows.filter(F.col("m") > CUT).withColumn("part", numbered(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CUT)))
    cut = cut.repartition("key", "part").withColumn("i", numbered(F.col("part") * CUT, F.least(F.col("m"), (F.col("part") + 1) * CUT) - 1))
    return few.unionByName(cut.drop("part"))


def _plan(docs: DataFrame, docs_per_block: int = DOCS_PER_BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, key, m, i and what `mix` says of each row."""
    sizes = _keyed(docs).select("doc_id", "key", F.col("row")["source"].alias("source"), n_words_of(F.coalesce(F.col("row")["text"], F.lit(""))).alias("size"))
    sizes = stored(sizes.groupBy("doc_id", "key", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    rows = stored(draw(sizes, docs_per_block, seed).select("doc_id", "key", "source", "source_key", "block", "size", "m", "source_size", "target", "ord", "passes", "extra"))
    most = F.max(F.col("passes") + (F.col("extra") > 0).cast("long")).alias("n")
    drawn = rows.groupBy("source_key", "block").agg(most).filter("n > 0")
    drawn = drawn.select("source_key", "block", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("pass"))
    dealt = shards_of(drawn, shards, seed).groupBy("source_key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    rows = _each(rows.join(dealt, ["source_key", "block"], "left"))
    rows = rows.withColumn("copies", F.col("passes") + (F.col("i") < F.col("extra")).cast("long"))
    own = F.coalesce(F.slice(F.transform("dealt", lambda x: x["shard"]), F.lit(1), F.col("copies").cast("int")), F.array().cast("array<int>"))
    return rows.select("doc_id", "key", "m", "i", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), own.alias("shards"), "ord")


def mix(docs: DataFrame, docs_per_block: int = DOCS_PER_BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, shards (each copy's; empty: not in the mix) and ord of every document."""
    return _plan(docs, docs_per_block, shards, seed).drop("key", "m", "i")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' rows, each as often as it is taken. A shard's rows lie in 64 pieces at most, each in the order of a
    hash of the document and the copy, which shuffles them."""
    plan = stored(_plan(docs, **options).filter(F.col("copies") > 0).select(F.col("doc_id").alias("of"), F.col("key").alias("k"), "m", "i", "shards", "ord"))
    rows, same = _keyed(docs), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k"))
    out = rows.join(plan.filter("m = 1"), same)
    again = stored(plan.filter("m > 1").select("of", "k").distinct())
    if not again.isEmpty():  # of rows that are equal one stands for all
        one = rows.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "key"])
        out = out.unionByName(one.join(plan.filter("m > 1"), same))
    out = out.select("row", "ord", "i", F.posexplode("shards").alias("copy", "shard")).withColumn("at", F.xxhash64("ord", "i", "copy"))
    out = out.repartition("shard", F.pmod(F.col("at"), F.lit(64))).sortWithinPartitions("shard", "at")
    return unpacked(out, docs.columns)


def query(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", F.array_join("shards", ",").alias("shards"))
