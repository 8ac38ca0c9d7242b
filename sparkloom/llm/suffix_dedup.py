"""Suffix-array dedup of byte texts: a radix sort of suffixes, most significant digit first, no deeper than WINDOW bytes.

Suffixes that agree on WINDOW bytes form a group; each member but the first (smaller doc_id, then smaller start) repeats the
first, and its WINDOW bytes are removed. The digits of a suffix are read in an order of their own:

1. First digit: the suffix's anchor, the DIGIT-byte string with the least hash among those within its WINDOW bytes (leftmost of
   ties), and its place. It depends on the WINDOW bytes only, so equal suffixes have equal digits; and neighbouring suffixes
   share one anchor, so that one row stands for a run of some 35 suffixes. Second digit: all bytes of the run. The rows are sorted
   by both, dealt by range, so that no group, however large, meets in one task. Groups of one drop out. A run that equals an
   earlier row's is repeated as a whole. What is left undecided: the first row of each run, where several runs share an anchor
   (or may do so across a range's edge).
2. Only these runs go on, with their bytes. They are dealt by anchor, and the suffixes of the runs of an anchor are sorted by all
   WINDOW bytes where they lie: all but the first of equal ones are decided.
3. Anchors with more than HELD_RUNS runs are dealt in several parts (by a salt). Each part leaves the first of its equal suffixes:
   these are compared over all documents.

Bytes are compared by 128 bits of polynomial hashes. Texts travel compressed (zstandard).

Cases: a null text is the empty text; texts shorter than WINDOW have nothing removed; a null doc_id comes before all others; rows
that repeat a doc_id and its text count as one document, those with different texts (also of null doc_ids) as several, in the order
of the texts' hashes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _hashes as H
from sparkloom.llm._base import documents, stored, text_of

WINDOW = 100
DIGIT = 32
HELD_RUNS = 20_000
OTHER = H._values(2)
NO_ID = -(2**63)


def span(p: np.ndarray, lo, hi, down: np.ndarray) -> np.ndarray:
    return H.mix((p[hi] - p[lo]) * down[lo])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(data: np.ndarray, window: int = WINDOW, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the run's bytes, place) of a text's runs. place: first suffix << 16 | further suffixes << 8 | anchor's
    place after the first suffix."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    down = H.powers(n + 1)[1]
    p = H.prefix(data)
    g = H.mix((p[digit:] - p[:-digit]) * down[: n - digit + 1])
    ranked = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_least(ranked, window - digit + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    lo, hi = np.concatenate(([0], change)), np.concatenate((change - 1, [n - window]))
    at = anchor[lo]
    shape = ((hi - lo) << 8) | (at - lo)
    whole = H.mix(span(H.prefix(data, OTHER), lo, hi + window, down) + shape.astype(np.uint64))
    return g[at], whole, (lo << 16) | shape


def keyed(docs: DataFrame) -> DataFrame:
    """doc, key, text. A row is known by doc and key, the text's hash: a null or repeated doc_id may have several texts."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))


def run_rows(docs: DataFrame, window: int, digit: int) -> DataFrame:
    """doc, key, anchor, whole, place of all runs."""

    def make(batches):
        for batch in batches:
            ids, parts, size = [], [], 0
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = runs(np.frombuffer(text.as_py().encode(), np.uint8), window, digit)
                if len(found[2]):
                    ids.append(np.broadcast_to(np.array([[doc], [key]], np.int64), (2, len(found[2]))))
                    parts.append(found)
                    size += len(found[2])
                if size > 100_000:
                    yield pack(ids, parts)
                    ids, parts, size = [], [], 0
            if parts:
                yield pack(ids, parts)

    def pack(ids, parts):
        a, w, p = (np.concatenate([x[k] for x in parts]) for k in range(3))
        columns = (*np.concatenate(ids, axis=1), a.view(np.int64), w.view(np.int64), p)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "anchor", "whole", "place"])

    return keyed(docs).mapInArrow(make, "doc long, key long, anchor long, whole long, place long")


def first_passes(rows: DataFrame) -> DataFrame:
    """doc, key, place, open: repeated runs (open false), and runs whose suffixes are to be sorted further (open true)."""
    order = ["anchor", "whole", "doc", "key", "place"]

    def resolve(batches):
        last = None  # the row before: anchor, whole, doc, key, place
        waiting = None  # the only open candidate of the current anchor
        several = True  # whether the current anchor has several runs; the first anchor of a range may have
        for batch in batches:
            if not batch.num_rows:
                continue
            a, w, d, t, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            pa_, pw = last[:2] if last else (None,) * 2
            new_a = np.concatenate(([last is None or a[0] != pa_], a[1:] != a[:-1]))
            new_w = new_a | np.concatenate(([last is None or w[0] != pw], w[1:] != w[:-1]))
            same = np.concatenate(([last is not None and (a[0], w[0], d[0], t[0], p[0]) == last], (a[1:] == a[:-1]) & (w[1:] == w[:-1]) & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])))
            repeated = ~new_w & ~same
            group = np.cumsum(new_a)  # 0: goes on from the batch before
            firsts = np.flatnonzero(new_w)
            per = np.bincount(group[firsts], minlength=group[-1] + 1)
            many = per > 1
            out_d, out_t, out_p = [], [], []
            if per[0] and waiting is not None:
                many[0] = True
            many[0] |= several
            if waiting is not None and many[0] and per[0]:
                out_d.append([waiting[0]])
                out_t.append([waiting[1]])
                out_p.append([waiting[2]])
                waiting = None
            if last is None:
                many[group[0]] = True  # the range's first anchor
            lone = group[-1] if group[-1] > 0 else None
            chosen = firsts[many[group[firsts]]]
            out_d.append(d[chosen])
            out_t.append(t[chosen])
            out_p.append(p[chosen])
            if lone is not None:
                several = bool(many[lone])
                waiting = None
                if not several:
                    k = firsts[group[firsts] == lone][0]
                    waiting = (d[k], t[k], p[k])
            elif many[0]:
                several, waiting = True, None
            last = (a[-1], w[-1], d[-1], t[-1], p[-1])
            opened = [np.concatenate(x).astype(np.int64) for x in (out_d, out_t, out_p)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate((x[repeated], y))) for x, y in zip((d, t, p), opened)), pa.array(np.arange(repeated.sum() + len(opened[0])) >= repeated.sum())],
                ["doc", "key", "place", "open"],
            )
        if waiting is not None:  # the range's last anchor
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in waiting), pa.array([True])], ["doc", "key", "place", "open"])

    dealt = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(resolve, "doc long, key long, place long, open boolean")


def compressed(docs: DataFrame) -> DataFrame:
    """doc, key, z: the texts for a shuffle."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t.as_py().encode()) for t in batch.column(2)], pa.binary())], ["doc", "key", "z"])

    return keyed(docs).mapInArrow(run, "doc long, key long, z binary")


def open_runs(docs: DataFrame, opened: DataFrame, window: int, digit: int) -> DataFrame:
    """anchor, doc, key, place, bytes of the open runs."""
    places = opened.groupBy("doc", "key").agg(F.collect_set("place").alias("places"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for doc, key, z, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = unpack(z.as_py())
                place = where.values.to_numpy()
                lo, more, at = place >> 16, (place >> 8) & 255, place & 255
                data = np.frombuffer(raw, np.uint8)
                anchor = span(H.prefix(data), lo + at, lo + at + digit, H.powers(len(data) + 1)[1])
                parts = [raw[a:b] for a, b in zip(lo, lo + more + window)]
                columns = [pa.array(anchor.view(np.int64)), *(pa.array(np.full(len(place), x, np.int64)) for x in (doc, key)), pa.array(place), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc", "key", "place", "bytes"])

    return compressed(docs).join(places, ["doc", "key"]).select("doc", "key", "z", "places").mapInArrow(run, "anchor long, doc long, key long, place long, bytes binary")


def sorted_suffixes(rows: list, window: int, across: np.ndarray) -> pa.RecordBatch:
    """Repeated spans (w1 null) of runs that lie together; of runs in `across` also the first of equal suffixes, with their hashes."""
    doc, key, place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
    raw = b"".join(r[4] for r in rows)
    data, sizes = np.frombuffer(raw, np.uint8), np.array([len(r[4]) for r in rows])
    begins = np.cumsum(sizes) - sizes
    counts = ((place >> 8) & 255) + 1
    run = np.repeat(np.arange(len(rows)), counts)
    k = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, start, down = begins[run] + k, (place >> 16)[run] + k, H.powers(len(data) + 1)[1]
    w1, w2 = (span(H.prefix(data, v), at, at + window, down) for v in (H.VALUES, OTHER))
    order = np.lexsort((start, key[run], doc[run], w2, w1))
    again = np.zeros(len(run), bool)
    again[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
    # neighbouring repeated suffixes of a run as one span
    opens = again & np.concatenate(([True], ~again[:-1] | (run[1:] != run[:-1])))
    closes = again & np.concatenate((~again[1:] | (run[1:] != run[:-1]), [True]))
    left = ~again & across[run]
    docs, keys = (np.concatenate((x[run][opens], x[run][left])) for x in (doc, key))
    starts = np.concatenate((start[opens], start[left]))
    length = np.concatenate((start[closes] - start[opens] + window, np.full(left.sum(), window)))
    decided = np.arange(len(docs)) < opens.sum()
    hashes = [np.concatenate((np.zeros(opens.sum(), np.uint64), w[left])).view(np.int64) for w in (w1, w2)]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs), pa.array(keys), pa.array(starts), pa.array(length.astype(np.int64)), pa.array(hashes[0], mask=decided), pa.array(hashes[1], mask=decided)],
        ["doc", "key", "start", "length", "w1", "w2"],
    )


def second_pass(runs_left: DataFrame, window: int, held_runs: int = HELD_RUNS) -> DataFrame:
    """doc, key, start, length, w1, w2; w1 null: decided."""

    def resolve(batches):
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if not held or held[-1][:4] != row[:4]:  # a repeated row's runs lie next to each other and count once
                    held.append(row)
            k = len(held) - 1
            while k > 0 and held[k - 1][5:] == held[-1][5:] and held[k - 1][0] == held[-1][0]:
                k -= 1
            if k >= held_runs // 4:  # all but the last part, which may go on
                yield sorted_suffixes(held[:k], window, np.array([r[6] > 1 for r in held[:k]]))
                held = held[k:]
        if held:
            yield sorted_suffixes(held, window, np.array([r[6] > 1 for r in held]))

    many = runs_left.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > held_runs)
    rows = runs_left.join(many, "anchor", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / held_runs), F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "key", "place"), F.col("parts"))).select("anchor", "doc", "key", "place", "bytes", "part", "parts")
    dealt = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc", "key", "place")
    return dealt.mapInArrow(resolve, "doc long, key long, start long, length long, w1 long, w2 long")


def removed_spans(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT, held_runs: int = HELD_RUNS) -> DataFrame:
    """doc, key, spans: array of lo << 16 | length of repeated bytes (spans may overlap)."""
    passed = stored(first_passes(run_rows(docs, window, digit)))
    found = stored(second_pass(stored(open_runs(docs, passed.filter("open"), window, digit)), window, held_runs))
    last = found.filter("w1 IS NOT NULL").withColumn("at", F.struct("doc", "key", "start"))
    shared = last.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = last.join(shared.select("w1", "w2", "first"), ["w1", "w2"]).filter("at > first").select("doc", "key", "start", "length")
    again = again.unionByName(found.filter("w1 IS NULL").select("doc", "key", "start", "length"))
    whole = passed.filter("NOT open").select("doc", "key", F.expr(f"(place >> 16 << 16) + ((place >> 8) & 255) + {window}").alias("span"))
    spans = whole.unionByName(again.select("doc", "key", F.expr("(start << 16) + length").alias("span")))
    return spans.groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, digit: int = DIGIT, held_runs: int = HELD_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (of removed bytes), kept (the remaining bytes)."""
    rows = compressed(docs).join(removed_spans(docs, window, digit, held_runs), ["doc", "key"], "left").select("doc", "z", "spans")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
        pair = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pair, pa.binary()]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                batch = whole.slice(at, 256)
                for doc, z, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    raw = unpack(z.as_py())
                    kept, found = raw, []
                    if spans.is_valid:
                        x = spans.values.to_numpy()
                        lo = x >> 16
                        edge = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, lo + (x & 65535), -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                        found = [{"lo": int(a), "hi": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    out.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(found), found, kept))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary"
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir):
    rows = suffix_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5_number(b[i + 1 : i + 100]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 99)) AS i FROM d WHERE octet_length(b) >= 100)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
begins AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM again),
numbered AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begins),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, k),
edges AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS e FROM spans UNION ALL SELECT doc_id, 0, min(lo) FROM spans GROUP BY doc_id),
parts AS (SELECT doc_id, string_agg(hex(b[a + 1 : coalesce(e, octet_length(b))]), '' ORDER BY a) AS x FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN x IS NULL THEN b ELSE from_hex(x) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN parts USING (doc_id)"""
