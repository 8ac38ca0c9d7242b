"""Keyed delta tables, streams that take effect once, and stateful operators on streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import joins
from sparkloom.sources import deltas
from sparkloom.streaming import stateful

ROWS = "id long, v string, ord long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def have(spark, path):
    return {(r.id, r.v) for r in deltas.read(spark, path).collect()}


def test_merges_against_a_dictionary(spark, tmp_path):
    """Batches of new, changed and deleted rows, with null keys and repeats, before and after compaction."""
    path, rng, want = str(tmp_path / "t"), random.Random(2), {}
    for number in range(7):
        rows = [(rng.choice([None, *range(40)]), f"b{number}r{k}", k) for k in range(25)]
        deltas.merge(spark.createDataFrame(rows, ROWS), path, ["id"], order="ord", most_deltas=4)
        want |= {r[0]: r[1] for r in rows}
        if number % 2:
            gone = [(rng.choice([None, *range(40)]),) for _ in range(5)]
            deltas.delete(spark.createDataFrame(gone, "id long"), path)
            for (k,) in gone:
                want.pop(k, None)
        assert have(spark, path) == set(want.items())
    deltas.compact(spark, path)
    assert have(spark, path) == set(want.items()) and not deltas.state(spark, path)["deltas"]
    deltas.vacuum(spark, path)
    deltas.merge(spark.createDataFrame([(1, "new", True)], "id long, v string, more boolean"), path, ["id"])
    assert have(spark, path) == set((want | {1: "new"}).items()) and "more" in deltas.read(spark, path).columns
    with pytest.raises(ValueError):
        deltas.read(spark, str(tmp_path / "none"))
    deltas.delete(spark.createDataFrame([(1,)], "id long"), str(tmp_path / "none"))
    assert not deltas.exists(spark, str(tmp_path / "none"))


def test_a_batch_writes_its_own_size(spark, tmp_path):
    path = str(tmp_path / "t")
    big = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("ord"))
    deltas.merge(big, path, ["id"])
    deltas.compact(spark, path)
    deltas.vacuum(spark, path, keep=1)
    whole = size(path)
    deltas.merge(big.filter("id < 500").withColumn("v", F.lit("x")), path, ["id"])
    assert size(path) - whole < 0.02 * whole
    deltas.merge(big.filter("id = 77").withColumn("v", F.lit("y")), path, ["id"])
    deltas.merge(big.filter("id = 77").withColumn("v", F.lit("z")), path, ["id"])
    assert deltas.read(spark, path).count() == 200_000 and deltas.read(spark, path).filter("id = 77").first().v == "z"
    found = deltas.known(spark.createDataFrame([(5,), (77,), (10**9,), (None,)], "k long"), path, ["k"])
    assert sorted(r.k for r in found.collect()) == [5, 77]


def test_compaction_touches_only_buckets_with_deltas(spark, tmp_path):
    path = str(tmp_path / "t")
    deltas.merge(spark.range(1000).select("id", F.lit("a").alias("v")), path, ["id"], buckets=8)
    deltas.compact(spark, path)
    before = deltas.state(spark, path)["base"]
    deltas.merge(spark.createDataFrame([(3, "b")], "id long, v string"), path, ["id"])
    deltas.compact(spark, path)
    after = deltas.state(spark, path)["base"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer's entry comes between: both batches are in the table; a compaction that was overtaken changes nothing."""
    path, plain = str(tmp_path / "t"), deltas._commit
    row = lambda k: spark.createDataFrame([(k, f"v{k}", 0)], ROWS)
    deltas.merge(row(0), path, ["id"])

    def overtaken(*args):
        monkeypatch.setattr(deltas, "_commit", plain)
        deltas.merge(row(1), path, ["id"])
        return plain(*args)

    monkeypatch.setattr(deltas, "_commit", overtaken)
    deltas.merge(row(2), path, ["id"])
    assert {k for k, _ in have(spark, path)} == {0, 1, 2}
    monkeypatch.setattr(deltas, "_commit", overtaken)
    deltas.compact(spark, path)
    assert {k for k, _ in have(spark, path)} == {0, 1, 2}

    def compacted(*args):
        monkeypatch.setattr(deltas, "_commit", plain)
        deltas.compact(spark, path)
        return plain(*args)

    deltas.merge(row(4), path, ["id"])
    monkeypatch.setattr(deltas, "_commit", compacted)
    deltas.compact(spark, path)
    assert {k for k, _ in have(spark, path)} == {0, 1, 2, 4}


def test_batches_of_a_ledger_take_effect_once(spark, tmp_path):
    path = str(tmp_path / "t")
    add = lambda n, v, source="s": deltas.merge(spark.createDataFrame([(1, v, 0)], ROWS), path, ["id"], (source, n))
    assert add(0, "a") and add(1, "b") and not add(1, "again") and not add(0, "old") and have(spark, path) == {(1, "b")}
    assert add(0, "other", "t") and have(spark, path) == {(1, "other")}
    deltas.compact(spark, path)
    assert not add(1, "again") and deltas.state(spark, path)["ledger"] == {"s": 1, "t": 0}


@pytest.mark.parametrize("where", ["before the entry", "after the entry"])
def test_a_stream_that_crashes(spark, tmp_path, monkeypatch, where):
    """Killed between writing a batch and the log entry, and between the entry and the stream's own note: effects come once."""
    source, path, note = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "note")
    spark.createDataFrame([(k, f"v{k}", 0) for k in range(10)], ROWS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(ROWS).parquet(source)
    plain = deltas._commit

    def crash(*args):
        if where == "after the entry":
            assert plain(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(deltas, "_commit", crash)
    with pytest.raises(Exception, match="killed"):
        deltas.stream_into(stream, path, ["id"], "files", note).awaitTermination()
    assert deltas.exists(spark, path) == (where == "after the entry")
    monkeypatch.setattr(deltas, "_commit", plain)
    deltas.stream_into(stream, path, ["id"], "files", note).awaitTermination()
    assert len(deltas.state(spark, path)["deltas"]) == 1 and len(have(spark, path)) == 10
    spark.createDataFrame([(3, "new", 1), (11, "v11", 1)], ROWS).coalesce(1).write.mode("append").parquet(source)
    deltas.stream_into(stream, path, ["id"], "files", note).awaitTermination()
    assert len(have(spark, path)) == 11 and (3, "new") in have(spark, path) and deltas.state(spark, path)["ledger"] == {"files": 1}


def played(spark, tmp_path, make, batches, schema):
    """Rows that a stateful stream tells, file by file; the state outlives a restart after each."""
    source, out, note = (str(tmp_path / n) for n in ("in", "out", "note"))
    told, seen = [], 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        write = lambda df, n: df.write.mode("append").parquet(out)
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", note).trigger(availableNow=True).start().awaitTermination()
        everything = sorted(map(tuple, spark.read.parquet(out).collect())) if os.path.exists(out) else []
        told.append([r for r in everything if r not in [x for t in told for x in t]])
        seen += len(rows)
    return told


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_breaker_on_a_stream_equals_the_batch(spark, tmp_path, state_store):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(8)}", k, rng.choices(["ok", "failed", "quota"], [5, 6, 0.3])[0]) for k in range(300)]
    told = played(spark, tmp_path, stateful.breaker, [rows[:7], rows[7:60], rows[60:61], rows[61:]], "key string, id long, outcome string")
    batch = {(r.key, r.opened_at) for r in joins.breaker(spark.createDataFrame(rows, "key string, id long, outcome string")).collect()}
    found = [(key, at) for t in told for key, at, _ in t]
    assert set(found) == batch and len(found) == len(batch) > 4
    outcome = {k: o for _, k, o in rows}
    assert all((why == "quota") == (outcome[at] == "quota") for t in told for _, at, why in t)


def test_beats_on_a_stream(spark, tmp_path, state_store):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    batches = [[(1, at(0)), (1, at(2)), (2, at(1))], [(2, at(9))], [(2, at(30))], [(1, at(31))]]
    told = played(spark, tmp_path, lambda s: stateful.beats(s, 600_000), batches, "worker_id long, beat_at timestamp")
    assert told[0] == [(1, at(2), True, 2), (2, at(1), True, 1)] and (2, at(9), True, 2) in told[1]
    everything = [r for t in told for r in t]
    assert everything.count((1, at(2), False, 2)) == 1  # silent for ten minutes by the watermark: told once
    assert (1, at(31), True, 1) in told[3]  # and forgotten: counted anew
    assert (2, at(30), True, 3) in everything or (2, at(30), True, 1) in everything


