"""An inverted-file index of vectors by cosine: k-means cells, every vector in the cell of its nearest centre, queries that look into
their nearest cells only.

Centres are fitted (Spark ML) on SAMPLE_ROWS vectors at most, the first by hash of the id, and are MOST_CELLS at most, so they can be
sent to all tasks. All vectors are indexed. A cell of more than CELL_ROWS vectors lies in several parts, and the queries that look into a
cell are cut into blocks of QUERY_BLOCK, so a task meets one part of a cell with one block of queries: a product of bounded size,
however the vectors or the queries crowd. What a query finds in a part is its best top_k there.

Null vectors, and those of length 0, have no direction and aren't indexed; as queries they find nothing. Scores are rounded to 12 places
and ties go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.retrieval import best_rows, cosine_top_k, norm, unit_rows
from sparkloom.storage import stored

SAMPLE_ROWS, MOST_CELLS, ROUNDS, SEED = 50_000, 4096, 10, 7
CELL_ROWS, QUERY_BLOCK = 4096, 1024
#: Queries on which the number of probes is tuned, and the recall that it has to reach there.
TUNED_ON, WANTED = 256, 0.97


@dataclass
class VectorIndex:
    """rows: cell, part, id, vector (stored); cells: cell, n, parts, radius (largest angle to the centre), one row a cell that isn't empty."""

    centers: np.ndarray
    rows: DataFrame
    cells: DataFrame


def directed(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vector").isNotNull() & (norm(F.col("vector")) > 0))


def fit_centers(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> np.ndarray:
    """Unit centres, as many as the root of the number of vectors if not stated; from a sample of sample_rows at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    wanted = min(MOST_CELLS, cells or max(1, round(rows.count() ** 0.5)))
    sample = stored(rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(array_to_vector("vector").alias("features")))
    found = sample.count()
    if not found:
        return np.zeros((0, 0))
    model = KMeans(k=max(2, min(wanted, found)), seed=seed, maxIter=ROUNDS, distanceMeasure="cosine").fit(sample) if found > 1 and wanted > 1 else None
    centers = np.array(model.clusterCenters() if model else [sample.first()["features"].toArray()])
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def _assigned(sent):
    def run(batches):
        for b in batches:
            if b.num_rows:
                near = unit_rows(b.column(1)) @ sent.value.T
                cell = near.argmax(axis=1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], ["id", "vector", "cell", "near"])

    return run


def build(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, seed: int = SEED) -> VectorIndex:
    """vectors: id, vector."""
    vectors = directed(vectors.select("id", "vector").filter("id IS NOT NULL"))
    kinds = dict(vectors.dtypes)
    centers = fit_centers(vectors, cells, sample_rows, seed)
    sent = vectors.sparkSession.sparkContext.broadcast(centers)
    rows = stored(vectors.mapInArrow(_assigned(sent), f"id {kinds['id']}, vector {kinds['vector']}, cell int, near double"))
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.acos(F.least(F.min("near"), F.lit(1.0))).alias("radius"))
    counts = stored(counts.withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int")))
    placed = rows.join(F.broadcast(counts.select("cell", "parts")), "cell")  # a row a cell: MOST_CELLS at most
    placed = placed.select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")
    return VectorIndex(centers, stored(placed.repartition("cell", "part").sortWithinPartitions("cell", "part")), counts)


def _cells_by_nearness(sent, most: int):
    """query_id, vector, cells (the nearest first), angles."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = np.clip(unit_rows(b.column(1)) @ sent.value.T, -1, 1)
                order = np.argsort(-near, axis=1, kind="stable")[:, :most]
                angles = np.arccos(np.take_along_axis(near, order, 1))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), order.shape[1]).cast(pa.list_(t)) for x, t in ((order.astype(np.int32), pa.int32()), (angles, pa.float64()))]
                yield pa.record_batch([b.column(0), b.column(1), *lists], ["query_id", "vector", "cells", "angles"])

    return run


def nearest_cells(index: VectorIndex, queries: DataFrame, most: int) -> DataFrame:
    queries = directed(queries.select("query_id", "vector"))
    kinds = dict(queries.dtypes)
    sent = queries.sparkSession.sparkContext.broadcast(index.centers)
    if not len(index.centers):
        return queries.select("query_id", "vector", F.array().cast("array<int>").alias("cells"), F.array().cast("array<double>").alias("angles"))
    return queries.mapInArrow(_cells_by_nearness(sent, most), f"query_id {kinds['query_id']}, vector {kinds['vector']}, cells array<int>, angles array<double>")


def _met(top_k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            names = (queries.schema.field("query_id").type, rows.schema.field("id").type)
            return pa.table({"query_id": pa.array([], names[0]), "id": pa.array([], names[1]), "score": pa.array([], pa.float64())})
        scores = np.round(unit_rows(queries.column("vector")) @ unit_rows(rows.column("vector")).T, 12)
        q, v = best_rows(scores, rows.column("id").combine_chunks(), top_k)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "id": rows.column("id").take(pa.array(v)), "score": pa.array(scores[q, v])})

    return run


def looked_into(index: VectorIndex, pairs: DataFrame, top_k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score: the best of each part of the cells that queries look into. pairs: query_id, vector, cell."""
    pairs = stored(pairs)
    grid = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(F.broadcast(index.cells), "cell")
    grid = stored(grid.select("cell", "parts", F.ceil(F.col("q") / block).cast("int").alias("blocks")))  # a row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(F.broadcast(grid), "cell").select("cell", "part", upto("blocks").alias("block"), "id", "vector")
    asked = pairs.join(F.broadcast(grid), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    asked = asked.select("cell", upto("parts").alias("part"), "block", "query_id", "vector")
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    both = rows.groupBy("cell", "part", "block").cogroup(asked.groupBy("cell", "part", "block"))
    return both.applyInArrow(_met(top_k), f"query_id {kinds[1]}, id {kinds[0]}, score double")


def ranked(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def search(index: VectorIndex, queries: DataFrame, top_k: int, probes: int) -> DataFrame:
    """query_id, id, score, rank: the best of the `probes` nearest cells."""
    pairs = nearest_cells(index, queries, probes).select("query_id", "vector", F.explode("cells").alias("cell"))
    return ranked(looked_into(index, pairs, top_k), top_k)


def search_exact(index: VectorIndex, queries: DataFrame, top_k: int, probes: int) -> DataFrame:
    """The same over all vectors: after the nearest cells, those too that may hold better ones. No vector of a cell is nearer to a query
    than the query's angle to the centre less the cell's radius; where that can't beat the query's last, the cell is left out."""
    near = stored(nearest_cells(index, queries, len(index.centers)))
    ranked_cells = near.select("query_id", "vector", F.posexplode(F.arrays_zip("cells", "angles")).alias("i", "x")).select("query_id", "vector", "i", F.col("x.cells").alias("cell"), F.col("x.angles").alias("angle"))
    first = stored(looked_into(index, ranked_cells.filter(F.col("i") < probes).select("query_id", "vector", "cell"), top_k))
    last = stored(ranked(first, top_k).filter(F.col("rank") == top_k).select(F.col("query_id").alias("of"), F.col("score").alias("least")))
    others = ranked_cells.filter(F.col("i") >= probes).join(F.broadcast(index.cells.select("cell", "radius")), "cell")
    others = others.join(last, F.col("query_id").eqNullSafe(F.col("of")), "left")
    bound = F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
    more = looked_into(index, others.filter(F.col("least").isNull() | (bound >= F.col("least") - 1e-9)).select("query_id", "vector", "cell"), top_k)
    return ranked(first.unionByName(more), top_k)


def recall_by_probes(index: VectorIndex, queries: DataFrame, top_k: int) -> list[float]:
    """For 1, 2, ... probes: the share of the exact top_k that lies in so many nearest cells. One exact search over all vectors."""
    near = stored(nearest_cells(index, queries, len(index.centers)).select("query_id", "cells"))
    exact = cosine_top_k(queries, index.rows.select("id", "vector"), top_k).select("query_id", "id")
    where = exact.join(index.rows.select("id", "cell"), "id").join(near, "query_id")
    at = where.groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell
    found = np.zeros(len(index.centers) + 1)
    for r in at:
        found[r["at"]] = r["n"]
    return list(np.cumsum(found)[1:] / max(1, found.sum()))


def probes_for(index: VectorIndex, queries: DataFrame, top_k: int, wanted: float = WANTED, tuned_on: int = TUNED_ON) -> int:
    """The fewest probes with which tuned_on of the queries (the first by hash) find the wanted share of their exact top_k."""
    some = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(tuned_on))
    curve = recall_by_probes(index, some, top_k)
    return next((k for k, share in enumerate(curve, 1) if share >= wanted), max(1, len(curve)))
