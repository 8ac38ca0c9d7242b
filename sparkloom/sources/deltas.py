"""Keyed tables that grow by batches: base files by bucket of the key, delta files of the batches since, merged when read.

A table is a folder of data folders and a log. Each log entry (a numbered JSON file) states the whole table: its keys, buckets and schema,
the base folder of each bucket, the delta folders in order, and a ledger: the last batch of each source of batches. An entry is written
beside its place and moved there only if nothing is there, so of two writers one has to read the other's entry and try again. What a
merge writes is the batch itself, whatever the size of the table; compaction rewrites the buckets that deltas touch, and only those.

A batch (source, number) that the ledger has is not merged again. Data and ledger change in one entry, so a batch takes effect once,
also where the job ends between two of its steps; folders that no entry names are nobody's and go with `vacuum`. The file system has to
move files without replacing others (HDFS and local folders do).

Keys may be null (equal to each other); of rows that repeat a key within a batch the last by `order` stays, else any.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from sparkloom.sources.tables import _files
from sparkloom.storage import small, stored

BUCKETS = 16
#: Parts of a bucket that tasks of a merge write apart, where there are rows for it.
PARTS = 8
#: Rows that a task of a merge or a read holds, where their number is known: rows are narrow, and Spark deals by bytes.
TASK_ROWS = 500_000
#: Deltas at which a merge compacts.
MOST_DELTAS = 20
TRIES = 100


def _entries(spark: SparkSession, path: str) -> list[int]:
    fs, where = _files(spark, f"{path}/log")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []


def state(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """What the newest log entry (or that of a number) says; None without a table."""
    found = _entries(spark, path)
    if not found:
        return None
    fs, where = _files(spark, f"{path}/log/{found[-1] if number is None else number:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, new: dict) -> bool:
    """Writes a log entry, unless there is one of its number."""
    jvm, target = spark._jvm, f"{path}/log/{new['number']:012d}.json"
    fs, beside = _files(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(json.dumps(new).encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(_files(spark, target)[1]), spark.sparkContext._gateway.new_array(rename, 0))
        return True
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def _changed(spark: SparkSession, path: str, change) -> dict:
    """Applies change (an entry to the next one; None: nothing to do) to the newest entry until it can be written."""
    for _ in range(TRIES):
        now = state(spark, path)
        new = change(now)
        if new is None:
            return now
        new["number"] = (now["number"] if now else 0) + 1
        if _commit(spark, path, new):
            return new
    raise RuntimeError(f"too many writers at {path}")


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _widened(old: StructType, new: StructType) -> StructType:
    return StructType([*old, *(f for f in new if f.name not in old.names)])


def _applied(now: dict | None, batch: tuple[str, int] | None) -> bool:
    return bool(now and batch and now["ledger"].get(batch[0], -1) >= batch[1])


def merge(rows: DataFrame, path: str, keys: list[str], batch: tuple[str, int] | None = None, order: str | None = None, gone: bool = False, buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS, at_most: int | None = None) -> bool:
    """Rows replace those of equal keys; gone: rows of these keys are deleted; at_most: how many rows there may be, if known. False: the
    ledger has the batch already."""
    spark = rows.sparkSession
    now = state(spark, path)
    if _applied(now, batch):
        return False
    buckets = now["buckets"] if now else buckets
    names = rows.columns
    # bucket and part follow from the keys, so rows are dealt once, for both their repeats and their files
    tasks = [] if at_most is None else [1 + at_most // TASK_ROWS]
    parts, dealt = max(1, 4 * tasks[0] // buckets) if tasks else PARTS, ("_bucket", "_part")
    rows = rows.withColumn("_bucket", _bucket(keys, buckets)).withColumn("_part", F.pmod(F.xxhash64(*keys, F.lit("part")), F.lit(parts)))
    rows = rows.repartition(*tasks, *dealt)
    if order:
        last = F.max_by(F.struct(*names), order).alias("_row")
        one = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), *dealt).agg(last).select("_row.*", "_bucket")
    else:
        one = rows.dropDuplicates([*keys, *dealt]).select(*names, "_bucket")
    folder = f"d{uuid.uuid4().hex}"
    one.select(*names, F.lit(gone).alias("_gone"), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")

    kinds = one.select(*names).schema

    def change(at: dict | None) -> dict | None:
        if _applied(at, batch):
            return None
        at = at or {"keys": keys, "buckets": buckets, "schema": {"type": "struct", "fields": []}, "base": {}, "deltas": [], "ledger": {}}
        schema = _widened(StructType.fromJson(at["schema"]), kinds)
        return at | {"schema": json.loads(schema.json()), "deltas": [*at["deltas"], folder], "ledger": at["ledger"] | ({batch[0]: batch[1]} if batch else {})}

    after = _changed(spark, path, change)
    if len(after["deltas"]) >= most_deltas:
        compact(spark, path)
    return folder in after["deltas"]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_entries(spark, path))


def _of(spark: SparkSession, path: str, now: dict, only: list[int] | None = None) -> DataFrame:
    """The rows of an entry, of some buckets only if these are stated."""
    schema, keys = StructType.fromJson(now["schema"]), now["keys"]
    wanted = range(now["buckets"]) if only is None else only
    folders = [f"{path}/{f}/_bucket={b}" for b, f in now["base"].items() if int(b) in wanted]
    base = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    if not now["deltas"]:
        return base
    wide = StructType([*schema]).add("_gone", BooleanType()).add("_bucket", IntegerType())
    parts = [spark.read.schema(wide).parquet(f"{path}/{d}").withColumn("_at", F.lit(k)) for k, d in enumerate(now["deltas"])]
    new = reduce(DataFrame.unionByName, parts)
    if only is not None:
        new = new.filter(F.col("_bucket").isin(list(only)))
    there = lambda rows: rows.filter("NOT _gone").select(*schema.names)
    if len(parts) > 1:
        # column by column: of numbers Spark sums this up by hashing, of whole rows by sorting
        values = [c for c in [*schema.names, "_gone"] if c not in keys]
        new = new.repartition(1 + new.count() // TASK_ROWS, *keys).groupBy(*keys).agg(*(F.max_by(c, "_at").alias(c) for c in values))
    if not folders:
        return there(new)
    new = stored(new)
    gone = new.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return base.join(small(gone), same, "left_anti").unionByName(there(new))


def read(spark: SparkSession, path: str) -> DataFrame:
    now = state(spark, path)
    if now is None:
        raise ValueError(f"no table at {path}")
    return _of(spark, path, now)


def known(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows whose keys the table has; keys: the rows' columns for the table's keys, in order. Only buckets of these keys are read."""
    spark = rows.sparkSession
    now = state(spark, path)
    if now is None:
        return rows.limit(0)
    kinds = {f.name: f.dataType for f in StructType.fromJson(now["schema"])}
    asked = stored(rows.select(*(F.col(k).cast(kinds[t]).alias(f"_k{i}") for i, (k, t) in enumerate(zip(keys, now["keys"])))).distinct())
    only = [r["b"] for r in asked.select(_bucket(asked.columns, now["buckets"]).alias("b")).distinct().collect()]  # buckets at most
    same = lambda left: reduce(lambda a, b: a & b, (left(i).eqNullSafe(F.col(f"_k{i}")) for i in range(len(keys))))
    there = _of(spark, path, now, only).select(*now["keys"]).join(small(asked), same(lambda i: F.col(now["keys"][i])), "left_semi")
    there = stored(there.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(now["keys"]))))
    return rows.join(small(there), same(lambda i: F.col(keys[i]).cast(kinds[now["keys"][i]])), "left_semi")


def delete(gone: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Deletes the rows of these keys; a table that doesn't exist has none."""
    now = state(gone.sparkSession, path)
    if now:
        merge(gone.select(*now["keys"]), path, now["keys"], batch, gone=True)


def compact(spark: SparkSession, path: str) -> None:
    """Writes the buckets that deltas touch anew; other writers' deltas that come meanwhile stay deltas."""
    now = state(spark, path)
    if not now or not now["deltas"]:
        return
    touched = set()
    for d in now["deltas"]:
        fs, where = _files(spark, f"{path}/{d}")
        touched |= {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if s.getPath().getName().startswith("_bucket=")}
    folder = f"c{uuid.uuid4().hex}"
    rows = _of(spark, path, now, sorted(touched)).withColumn("_bucket", _bucket(now["keys"], now["buckets"]))
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, where = _files(spark, f"{path}/{folder}")
    filled = {s.getPath().getName().split("=")[1] for s in fs.listStatus(where) if s.getPath().getName().startswith("_bucket=")}
    base = {b: f for b, f in now["base"].items() if int(b) not in touched} | {b: folder for b in filled}

    def change(at: dict) -> dict | None:
        if at["base"] != now["base"] or at["deltas"][: len(now["deltas"])] != now["deltas"]:
            return None  # somebody else has compacted
        return at | {"base": base, "deltas": at["deltas"][len(now["deltas"]) :]}

    _changed(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes older entries than the last `keep`, and folders that no entry left names. Not while others write."""
    numbers = _entries(spark, path)
    named = {"log"}
    for n in numbers[-keep:]:
        entry = state(spark, path, n)
        named |= {*entry["deltas"], *entry["base"].values()}
    fs, where = _files(spark, path)
    for s in fs.listStatus(where):
        if s.getPath().getName() not in named:
            fs.delete(s.getPath(), True)
    for n in numbers[:-keep]:
        fs.delete(_files(spark, f"{path}/log/{n:012d}.json")[1], False)


def _end(rows: DataFrame, end: str, kind: str):
    """An end of edges as an id's type; null where it can't be one."""
    return F.col(end) if dict(rows.dtypes)[end] == kind else F.col(end).cast("string").try_cast(kind)


def _ids(spark: SparkSession, path: str, kind: str, rows: DataFrame) -> DataFrame:
    """The ids of a node table, as kind, in the buckets of the edges' ends (src, dst)."""
    now = state(spark, path)
    key = StructType.fromJson(now["schema"])[now["keys"][0]]
    ends = F.explode(F.array(*(_end(rows, end, key.dataType.simpleString()) for end in ("src", "dst"))))
    only = [r["b"] for r in rows.select(ends.alias("end")).select(_bucket(["end"], now["buckets"]).alias("b")).distinct().collect()]  # buckets at most
    return _of(spark, path, now, only).select(F.col(key.name).cast(kind).alias("end"))


def merge_graph(spark: SparkSession, folder: str, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
    """Merges nodes (by id) and edges (by src, dst) into a table for each label and type; edges whose ends no node table has are left
    out. What is written follows the batch; of the nodes, the buckets of the edges' ends are read. Ends and ids are compared in the ids'
    type if all node tables have one, else as strings."""
    for label, rows in nodes.items():
        merge(rows, f"{folder}/nodes/{label}", ["id"], batch)
    fs, where = _files(spark, f"{folder}/nodes")
    paths = [f"{folder}/nodes/{s.getPath().getName()}" for s in fs.listStatus(where)] if fs.exists(where) else []
    paths = [p for p in paths if exists(spark, p)]
    kinds = {StructType.fromJson(state(spark, p)["schema"])["id"].dataType.simpleString() for p in paths}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    for name, rows in edges.items():
        rows = rows if hasattr(rows, "_stored_at") else stored(rows)
        most, there = rows.count(), [_ids(spark, p, kind, rows) for p in paths]
        there = small(stored(reduce(DataFrame.unionByName, there))) if there else spark.createDataFrame([], f"end {kind}")
        for end in ("src", "dst"):
            rows = rows.join(there, _end(rows, end, kind) == F.col("end"), "left_semi")
        merge(rows, f"{folder}/edges/{name}", ["src", "dst"], batch, at_most=most)


def stream_into(stream: DataFrame, path: str, keys: list[str], source: str, checkpoint: str, order: str | None = None):
    """Merges a stream's batches into the table, each once: a batch that comes again, after a crash between its merge and the stream's own
    note of it, is in the ledger. Takes what is there and stops; the query."""
    each = lambda rows, number: merge(rows, path, keys, (source, number), order)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_done(done: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Adds paths to a marker of work done, all or none of them; what is written follows the paths added."""
    merge(done.select("path"), path, ["path"], batch)


def pending(files: DataFrame, marker: str) -> DataFrame:
    """The files whose path no marker has."""
    spark = files.sparkSession
    return files.join(read(spark, marker).select("path"), "path", "left_anti") if exists(spark, marker) else files
