"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, triangle-inequality windows, recursion.

The distance of two sets is 1 - |x & y| / |x | y|, a metric. Equal sets are one point, taken once; r = 1 - threshold.

1. Regions. The first pivots are the one-shingle sets. A point is nearest to the pivots of its own shingles, which are equally
   near; a fixed order of the shingles says which region is its home. A point within r of x lacks at most a known number of x's
   shingles, so its home is among x's first |x| - ceil(threshold * |x|) + 1 pivots: x is replicated to those regions (its window),
   and any two points within r meet in one. The order: shingles by hash, those last that over MOST points have among the
   shingles looked at. A point looks at its first shingles by hash, a half more than its window; if too many of them come last, it
   looks further, until all windows are certain. So all regions but those of the last shingles hold MOST points at most, and only
   points nearly all of whose shingles are common (as in large groups of near copies) come to the others.
2. Balls. Each region has a pivot document, the one with the earliest place of the region's shingle (and thus the least of its own).
   Points within r of it are connected: a component counts as one from then on, and only pairs of different components are
   looked at. Pairs are narrowed by bounds that hold for every pair within r: sizes, places of the first common pivot, and the
   triangle inequality for BUCKETS further pivot sets that share out all shingles (the differences of the two points' intersections
   with them add up to the size of the symmetric difference at most). What is left is measured exactly.
3. Recursion. Regions of one component are done. Otherwise the region's points are counted by size and place, which tells how many
   pairs with a point outside the largest component the bounds leave; where they are few (MOST a point), they are listed. Other regions
   get further pivot documents (of different components), all distances to them are measured, and each point goes to the region of the
   nearest and to those that are farther by 2r at most (triangle inequality); pivots are done. A region that doesn't get smaller so has
   its pairs listed, within the window of the distances to its pivot.

Links between points that are connected anyway are not all listed: the result is components, and these are exact.

Cases: null and empty texts have the empty set, link with nothing and are their own component; texts of one or two words have
one shingle; equal texts, and repeated rows, share a component; the component is the smallest doc_id, null only if all its doc_ids are;
rows that share a doc_id but not the text are judged each by its own text; very long texts are taken whole; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _hashes as H
from sparkloom.llm._base import documents, dropped, packed, small, stored, text_of, unpacked
from sparkloom.llm.components import components, merged

N = 3
PERCENT = 90
MOST = 16
BUCKETS = 64
PIVOTS = 4
NO_ID = -(2**63)


def _sets(batches, n: int, at: int):
    """(rows, sets) for runs of texts of bounded size; the text is column `at`."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            texts = [t.as_py().encode() for t in batch.column(at)]
            for first, part in H.chunks(texts):
                yield batch.slice(first, len(part)), H.shingles(part, n)


def _lists(parts: list, kind=np.int64) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id, key, text: id and key (the text's hash) know a row also where doc_id is null or repeated."""
    kind = "string" if dict(docs.dtypes)["doc_id"] == "string" else "long"
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast(kind), F.lit(NO_ID).cast(kind)).alias("id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))


def window_of(n, percent: int):
    """The shingles of a set of n that a point within r can't all lack."""
    return n - (percent * n + 99) // 100 + 1


def signatures(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, id, key, n, k1, k2 (128-bit key of the set), shares (of the set by bucket), seen (its first shingles by hash)."""
    rows = keyed(docs)
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch, sets in _sets(batches, n, 3):
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets)), sizes)
            begins = np.cumsum(sizes) - sizes
            sums = np.zeros((2, len(sets)), np.uint64)
            full = sizes > 0
            for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                if full.any():
                    sums[k, full] = H.mix(np.add.reduceat(H.mix(flat ^ np.uint64(salt)), begins[full]) + sizes[full].astype(np.uint64))
            bucket = (H.mix(flat) >> np.uint64(7)).astype(np.int64) % BUCKETS
            shares = np.bincount(doc * BUCKETS + bucket, minlength=len(sets) * BUCKETS).astype(np.int32)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * BUCKETS
            upto = np.minimum(sizes, 3 * window_of(sizes, percent) // 2 + 4)
            keys = [pa.array(x.view(np.int64)) for x in sums]
            columns = [*batch.columns[:3], pa.array(sizes), *keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(shares)), _lists([s[:k] for s, k in zip(sets, upto)])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "key", "n", "k1", "k2", "shares", "seen"])

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, id {kinds['id']}, key long, n long, k1 long, k2 long, shares array<int>, seen array<long>")


def shingles_of(docs: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """p, n, seen: the first `upto` shingles, by hash, of the points wanted (stored: p, id, key, n, upto)."""

    def run(batches):
        for batch, sets in _sets(batches, n, 3):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([s[:k] for s, k in zip(sets, batch.column(2).to_pylist())])], ["p", "n", "seen"])

    rows = keyed(docs).drop("doc_id").join(small(wanted), ["id", "key"]).select("p", "n", "upto", "text")
    return rows.mapInArrow(run, "p long, n long, seen array<long>")


def _each(seen: DataFrame) -> DataFrame:
    return seen.select("p", F.posexplode("seen").alias("place", "s"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("k"))


def all_seen(docs: DataFrame, points: DataFrame, n: int, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(p, n, seen: the shingles that points look at; s: those of them that come last).

    Of longer looks only what is new is counted, and added to the counts of two or more from the first; a shingle that these lack
    counts as seen once before, which it may not have been: what comes last need only be the same for all."""
    seen = points.select("p", "n", "seen")
    counts = stored(_counted(_each(seen)).filter("k > 1"))
    last = stored(counts.filter(F.col("k") > most).select("s"))
    window = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    upto = F.when(2 * F.col("late") >= F.col("e"), F.col("n")).otherwise(F.least("n", window + 2 * F.col("late") + 4))
    added = None
    while True:
        late = _each(seen).join(small(last), "s").groupBy("p").agg(F.count(F.lit(1)).alias("late"))
        short = seen.select("p", F.size("seen").cast("long").alias("e")).join(late, "p").join(points.select("p", "id", "key", "n"), "p")
        short = stored(short.filter((F.col("e") - F.col("late") < window) & (F.col("e") < F.col("n"))).select("p", "id", "key", "n", upto.alias("upto"), "e"))
        if short.isEmpty():
            dropped(counts)
            return seen, last
        more = stored(shingles_of(docs, short.drop("e"), n).dropDuplicates(["p"]))
        seen = seen.join(small(stored(short.select("p"))), "p", "left_anti").unionByName(more)
        new = _counted(_each(more).join(small(short.select("p", "e")), "p").filter(F.col("place") >= F.col("e")))
        added = stored(new if added is None else added.unionByName(new).groupBy("s").agg(F.sum("k").alias("k")))
        total = added.join(counts.withColumnRenamed("k", "before"), "s", "left").filter(F.col("k") + F.coalesce("before", F.lit(1)) > most)
        last = stored(last.unionByName(total.select("s")).distinct())


def windows(seen: DataFrame, last: DataFrame, percent: int) -> DataFrame:
    """s, p, n, slack, late: the window of each point."""

    def run(batches):
        for batch in batches:
            for p, n, hashes, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                late = np.zeros(len(hashes), bool)
                if places.is_valid:
                    late[places.values.to_numpy()] = True
                order = np.argsort(late, kind="stable")[: window_of(n, percent)]
                slack = (100 - percent) * n - (100 + percent) * np.arange(len(order))
                columns = (hashes.values.to_numpy()[order], np.full(len(order), p), np.full(len(order), n), slack)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(late[order])], ["s", "p", "n", "slack", "late"])

    late = _each(seen).join(small(last), "s").groupBy("p").agg(F.collect_list("place").alias("late"))
    return seen.join(late, "p", "left").mapInArrow(_joined_batches(run), "s long, p long, n long, slack long, late boolean")


def _joined_batches(run):
    """run, its small batches put together."""

    def whole(batches):
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def may_link(x: str, y: str, percent: int) -> str:
    """Whether points x and y (n, slack) of a region may link. Their first common pivot is the region's: what stands before it isn't
    common, so that x has n - place common shingles at most, and slack = (100 - percent) * n - (100 + percent) * place bounds y's n."""
    n = f"({y}.n - {x}.n)"
    return f"{x}.slack >= {percent} * {n} AND {y}.slack >= -{percent} * {n} AND {percent} * greatest({x}.n, {y}.n) <= 100 * least({x}.n, {y}.n)"


def first_regions(docs: DataFrame, points: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """s, p, n, slack, pivot (p, n and slack), rest of the regions with several points that sizes and places allow to link. rest: whether that
    holds between this point and one that isn't the pivot."""
    seen, last = all_seen(docs, points, n, percent, most)
    rows = stored(windows(seen, last, percent))
    dropped(last)
    pivot, least = F.max(F.struct("slack", (-F.col("p")).alias("q"), "n")), F.min("n")
    fits = (F.col("slack") + F.col("pivot")["slack"] >= 0) & (F.col("slack") + percent * F.col("n") >= percent * F.col("least"))
    # at most MOST rows a shingle: counted where they meet, moved once
    own = Window.partitionBy("s")
    few = rows.filter("NOT late").drop("late").repartition("s").withColumn("pivot", pivot.over(own)).withColumn("least", least.over(own)).filter(fits)
    few = few.withColumn("k", F.count(F.lit(1)).over(own)).filter("k > 1")
    other = F.col("p") != -F.col("pivot")["q"]
    few = few.withColumn("top", F.max(F.when(other, F.col("slack"))).over(own)).withColumn("least", F.min(F.when(other, F.col("n"))).over(own))
    few = few.withColumn("rest", other & (F.col("slack") + F.col("top") >= 0) & (F.col("slack") + percent * F.col("n") >= percent * F.col("least")))
    few = few.withColumn("rest", F.col("rest") & (F.count_if("rest").over(own) > 1)).drop("k", "top")
    # any number of rows: reduced before the shuffle, and a join that Spark splits when skewed
    many = rows.filter("late").drop("late")
    many = many.join(many.groupBy("s").agg(pivot.alias("pivot"), least.alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "s").filter(fits)
    many = many.withColumn("rest", F.col("p") != -F.col("pivot")["q"])
    pivot = F.struct((-F.col("pivot")["q"]).alias("p"), F.col("pivot")["n"].alias("n"), F.col("pivot")["slack"].alias("slack"))
    regions = stored(few.unionByName(many).drop("least").withColumn("pivot", pivot))
    dropped(rows)
    return regions


def narrowed(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and shares by bucket allow a link (points: p, n, shares)."""
    x = points.select(F.col("p").alias("a"), F.col("n").alias("na"), F.col("shares").alias("ha"))
    y = points.select(F.col("p").alias("b"), F.col("n").alias("nb"), F.col("shares").alias("hb"))
    rows = pairs.join(x, "a").join(y, "b").filter(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")
    apart = F.aggregate(F.zip_with("ha", "hb", lambda u, v: F.abs(u - v)), F.lit(0), lambda s, d: s + d)
    # |x ^ y| <= n + m - 2c, and a link needs (100 + percent) * c >= percent * (n + m)
    return rows.filter((100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb"))).select("a", "b")


def measured(docs: DataFrame, points: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, d (the exact distance), link of the pairs (a, b), stored."""
    pairs = stored(pairs)
    wanted = pairs.select(F.col("a").alias("p")).union(pairs.select("b")).distinct()
    wanted = stored(wanted.join(points.select("p", "id", "key", "n", F.col("n").alias("upto")), "p"))
    sets = stored(shingles_of(docs, wanted, n))
    a, b = (sets.select(F.col("p").alias(k), F.col("seen").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb") - common).alias("u"))
    known = stored(rows.select("a", "b", (1 - F.col("c") / F.col("u")).alias("d"), (100 * F.col("c") >= percent * F.col("u")).alias("link")).distinct())
    dropped(sets, wanted, pairs)
    return known


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.drop("label").join(labels, "p", "left").withColumn("label", F.coalesce("label", "p"))


def open_cells(rows: DataFrame, percent: int) -> DataFrame:
    """s, n, slack, n2, slack2, inside2, pairs: by size and place, the points (rows: s, p, n, slack, inside) outside their region's largest
    component and those that may link with them; pairs: how many such pairs there are at most."""
    cells = stored(rows.groupBy("s", "inside", "n", "slack").agg(F.count(F.lit(1)).alias("c")))
    x, y = cells.filter("NOT inside").alias("x"), cells.alias("y")
    both = x.join(y, F.col("x.s") == F.col("y.s")).filter(may_link("x", "y", percent))
    columns = ["x.s", "x.n", "x.slack", F.col("y.n").alias("n2"), F.col("y.slack").alias("slack2"), F.col("y.inside").alias("inside2"), (F.col("x.c") * F.col("y.c")).alias("pairs")]
    return stored(both.select(*columns))


def listed(rows: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of these cells of points of different components (rows: s, p, n, slack, inside, label, d)."""
    r = 1 - percent / 100
    x = rows.filter("NOT inside").join(cells.drop("pairs"), ["s", "n", "slack"]).select("s", F.col("n2").alias("n"), F.col("slack2").alias("slack"), F.col("inside2").alias("inside"), *(F.col(c).alias(f"{c}1") for c in ("p", "label", "d")))
    pairs = x.join(rows, ["s", "n", "slack", "inside"]).filter("label <> label1 AND (inside OR p < p1)").filter(f"d IS NULL OR d1 IS NULL OR abs(d - d1) <= {r} + 1e-9")
    return pairs.select(*_pair("p", "p1")).distinct()


def split(rows: DataFrame, by_label: DataFrame, docs: DataFrame, points: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links found, the smaller regions) of regions dealt to PIVOTS pivots of different components each."""
    r = 1 - percent / 100
    ranked = by_label.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("c"), "label"))).filter(F.col("k") <= PIVOTS)
    pivots = stored(ranked.select("s", (-F.col("top")["q"]).alias("pivot")))
    star = stored(rows.join(pivots, "s").filter("p <> pivot").select("s", "p", "pivot"))
    known = measured(docs, points, star.select(*_pair("p", "pivot")).distinct(), n, percent)
    far = star.select("*", *_pair("p", "pivot")).join(known.select("a", "b", "d"), ["a", "b"]).select("s", "p", "pivot", "d")
    far = far.join(pivots.select("s", F.col("pivot").alias("p")), ["s", "p"], "left_anti")  # pivots are done
    far = far.withColumn("near", F.min("d").over(Window.partitionBy("s", "p"))).filter(F.col("d") <= F.col("near") + 2 * r + 1e-9)
    parts = rows.drop("d").join(far.drop("near"), ["s", "p"]).withColumn("s", F.xxhash64("s", "pivot")).drop("pivot")
    return known.filter("link").select("a", "b"), stored(parts)


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, key, n, k1, k2 of each row; k1, k2, p, label, and doc_id, id, key of its first row, of each class of equal sets)."""
    signed = stored(signatures(docs, n, percent))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "key"))
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(first.alias("f"), F.first("n").alias("n"))
    classes = stored(classes.select("k1", "k2", "n", "f.doc_id", "f.id", "f.key", F.monotonically_increasing_id().alias("p")))
    # a set so small that no other set is within r links with nothing
    points = classes.filter(100 * F.col("n") >= percent * (F.col("n") + 1)).select("p", "id", "key")
    looks = stored(signed.select("id", "key", "n", "shares", "seen").join(points, ["id", "key"]).dropDuplicates(["id", "key"]))
    whole, signed = signed, stored(signed.select("doc_id", "id", "key", "n", "k1", "k2"))
    dropped(whole)
    rows = first_regions(docs, looks, n, percent, most)
    points = stored(looks.drop("seen"))
    dropped(looks)
    star = rows.withColumn("own", F.struct("n", "slack")).filter(F.col("p") != F.col("pivot")["p"]).filter(may_link("own", "pivot", percent))
    near = measured(docs, points, narrowed(star.select(*_pair("p", "pivot.p")).distinct(), points, percent), n, percent)
    labels = merged(None, near.filter("link").select("a", "b"))
    rows = rows.filter("rest").drop("pivot", "rest").withColumn("d", F.lit(None).cast("double")).withColumn("was", F.lit(None).cast("long"))
    while True:
        rows = stored(labelled(rows, labels))
        by_label = rows.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("slack", (-F.col("p")).alias("q"))).alias("top"), F.max("was").alias("was"))
        by_label = stored(by_label)
        whole = by_label.groupBy("s").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("large"), F.max("was").alias("was")).filter("m > large.c")
        whole = stored(whole.select("s", "m", F.col("large")["label"].alias("inner"), "was"))
        if whole.isEmpty():
            break
        open_ = stored(rows.drop("was").join(whole.select("s", "inner"), "s").withColumn("inside", F.col("label") == F.col("inner")).drop("inner"))
        cells = open_cells(open_, percent)
        stalled = F.col("was").isNotNull() & (10 * F.col("m") > 9 * F.col("was"))
        few = cells.groupBy("s").agg(F.sum("pairs").alias("pairs")).join(whole, "s").select("s", "m", ((F.col("pairs") <= most * F.col("m")) | stalled).alias("lists"))
        few = stored(few)
        pairs = listed(open_, cells.join(few.filter("lists").select("s"), "s"), percent)
        links = measured(docs, points, narrowed(pairs, points, percent), n, percent).filter("link").select("a", "b")
        large = few.filter("NOT lists")
        if large.isEmpty():
            labels = merged(labels, links)
            break
        found, rows = split(open_.drop("inside").join(large.select("s", F.col("m").alias("was")), "s"), by_label.join(large, "s", "left_semi"), docs, points, n, percent)
        labels = merged(labels, links.unionByName(found))
    return signed, labelled(classes.drop("n"), labels)


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the rows, the classes with the first row of their component: of_null, of_id, of_key)."""
    signed, classes = joined(docs, n, percent)
    classes = stored(classes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "key"))
    return signed, classes.select("k1", "k2", "label").join(classes.groupBy("label").agg(first.alias("of")), "label").select("k1", "k2", "of")


def jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    signed, classes = _components(docs, n, percent)
    rows = signed.join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("of")["doc_id"]).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduped(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the first of their component (the smallest doc_id), once each, and those without words; rows unchanged."""
    signed, classes = _components(docs, n, percent)
    kept = signed.join(classes, ["k1", "k2"], "left").filter("n = 0 OR (id = of.id AND key = of.key)")
    kept = stored(kept.groupBy("id", "key").agg(F.count(F.lit(1)).alias("_rows"), F.max("n").alias("_n")))
    kept = kept.select(F.col("id").alias("_id"), F.col("key").alias("_key"), ((F.col("_rows") > 1) & (F.col("_n") > 0)).alias("_again"))
    id_ = keyed(docs).select("id").schema[0].dataType
    own, key = F.coalesce(F.col("row")["doc_id"].cast(id_), F.lit(NO_ID).cast(id_)), F.xxhash64(F.coalesce(F.col("row")["text"], F.lit("")))
    rows = packed(docs).withColumn("_id", own).withColumn("_key", key).join(kept, ["_id", "_key"])
    once = rows.filter("_again").dropDuplicates(["_id", "_key"])
    return unpacked(rows.filter("NOT _again").unionByName(once), docs.columns)


def query(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))


SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
        AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i WHERE 100 * c >= 90 * (n + m - c)),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s)"""
