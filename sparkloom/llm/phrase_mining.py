"""Phrase collocation mining by hashed buckets (PCY, DHP): phrases of 2 to MOST_WORDS words that recur in a language, by how they hold together.

Pass k over the texts counts phrases of k words exactly and, in BUCKETS hashed counters, those of k + 1 words. A bucket below min_count
can't hold a frequent phrase, so of the buckets only a bitmap is kept and sent to the tasks of the next pass. There, a phrase is counted
exactly if its bucket is frequent and both phrases within it that are a word shorter are (Apriori; of these, too, a bitmap of BUCKETS
bits is sent, so nothing that is sent grows with the data). Only phrases whose parts pass are put in the next buckets. Bitmaps let
phrases through that needn't be, never the reverse; frequent phrases are told by their exact counts, which are summed by the words
themselves. A task works on runs of texts as byte and hash arrays and sums within itself before anything is shuffled.

Within a task, phrases of equal 64-bit hashes count as equal; between tasks the words decide.

Cases: a null text is the empty text, a null lang is `und`; rows that repeat a doc_id count each; texts without words give nothing; ties
are broken down to the phrase, so that ranks are unique; very long texts are cut at the ends of pieces, which no phrase crosses; empty
table, empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _hashes as H
from sparkloom.llm._base import documents, dropped, small, stored

MIN_COUNT = 30
MOST_WORDS = 4
COVERED_PERCENT = 80
TOP = 2000
#: Counters of a pass: 4 bytes each in a task, a bit each in what is sent.
BUCKETS = 1 << 23
BLOCK = 1 << 16
#: Bytes of text that a task works on at once, and of distinct phrases that it holds.
RUN_BYTES = 1 << 20
HELD_BYTES = 24 << 20
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 9]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
SCHEMA = "lang string, phrase string, f long, block int, counts binary"


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


class Run:
    """The words of a run of texts of one language: data holds them with one space after each; phrases are known by first word and length."""

    def __init__(self, texts: list[bytes], lang: str):
        raw = H.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        ends = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int32)))
        #: whether a word and its successor are in one piece
        self.joined = ends[s[1:]] == ends[e[:-1]]
        inside[e] = True
        self.data = raw[inside]
        self.end = np.cumsum(e - s + 1) - 1
        self.start = self.end - (e - s)
        self.data[self.end] = 32
        p = H.prefix(self.data)
        self.word = H.mix(((p[self.end] - p[self.start]) * H.powers(len(self.data) + 1)[1][self.start]) ^ seed_of(lang))
        #: hash of the longest phrase looked at so far, by first word
        self.hash, self.k = self.word, 1

    def grow(self, first: np.ndarray) -> None:
        """Hashes of the phrases a word longer that begin at these words; elsewhere 0."""
        longer = np.zeros_like(self.word)
        longer[first] = H.mix(self.hash[first] * np.uint64(H.BASE) + self.word[first + self.k])
        self.hash, self.k = longer, self.k + 1

    def pairs(self, alive: np.ndarray) -> np.ndarray:
        """First words of the phrases of k + 1 words whose two parts of k words are alive."""
        both = alive[:-1] & alive[1:]
        return np.flatnonzero(both & self.joined if self.k == 1 else both)

    def phrases(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and joined bytes of the phrases of k words that begin at these words."""
        start = self.start[first]
        size = self.end[first + self.k - 1] - start
        ends = np.cumsum(size)
        return size, self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Bits:
    """A bitmap by hash."""

    def __init__(self, packed: bytes):
        self.packed = np.frombuffer(packed, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        b = (h & np.uint64(8 * len(self.packed) - 1)).astype(np.int64)
        return (self.packed[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


class Buckets:
    """Hashed counters; sent on in blocks, as high as min_count at most."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.counts = n, most, None

    def add(self, h: np.ndarray) -> None:
        if self.counts is None:
            self.counts = np.zeros(self.n, np.uint32)
        np.add.at(self.counts, (h & np.uint64(self.n - 1)).astype(np.int64), np.uint32(1))

    def blocks(self):
        if self.counts is not None:
            for k, part in enumerate(self.counts.reshape(-1, min(BLOCK, self.n))):
                if part.any():
                    raw = np.minimum(part, self.most).astype(np.uint32 if self.most > 255 else np.uint8)
                    yield pa.record_batch([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([bytes(pa.compress(raw.tobytes(), "zstd"))], pa.binary())], names=NAMES)


NAMES = ["lang", "phrase", "f", "block", "counts"]


class Counts:
    """Exact counts of one language's phrases: each run's distinct ones, summed when they take much room and at the end."""

    def __init__(self):
        self.runs, self.bytes = [], 0

    def add(self, run: Run, first: np.ndarray) -> None:
        h, at, n = np.unique(run.hash[first], return_index=True, return_counts=True)
        size, data = run.phrases(first[at])
        self.runs.append((h, n, size, data))
        self.bytes += len(data) + 24 * len(h)

    def summed(self) -> None:
        """One run of distinct hashes."""
        h, n, size, data = (np.concatenate(x) for x in zip(*self.runs))
        if len(self.runs) > 1:
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))[: len(h)]
            keep = order[new]
            n, start = np.add.reduceat(n[order], new) if len(new) else n, (np.cumsum(size) - size)[keep]
            h, size = h[keep], size[keep]
            ends = np.cumsum(size)
            data = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        self.runs, self.bytes = [(h, n, size, data)], len(data) + 24 * len(h)

    def batch(self, lang: str) -> pa.RecordBatch:
        self.summed()
        (h, n, size, data), self.runs, self.bytes = self.runs[0], [], 0
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        phrase = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pa.record_batch([pa.array([lang] * len(h), pa.string()), phrase, pa.array(n, pa.int64()), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary())], names=NAMES)


def parts(text: bytes, limit: int):
    """A text, or its parts of some `limit` bytes, cut behind the end of a piece."""
    at = 0
    while len(text) - at > limit and (end := PIECE_END.search(text, at + limit)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def runs(batches, limit: int):
    """(lang, texts) of at most some `limit` bytes from batches of lang and text."""
    waiting: dict = defaultdict(list)
    size: dict = defaultdict(int)
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            for part in parts(text or b"", limit):
                waiting[lang].append(part)
                size[lang] += len(part) + 1
                if size[lang] >= limit:
                    yield lang, waiting.pop(lang)
                    del size[lang]
        if sum(size.values()) >= 8 * limit:
            yield from waiting.items()
            waiting.clear()
            size.clear()
    yield from waiting.items()


def counting(k: int, bitmaps, most_words: int, min_count: int, buckets: int):
    """A mapInArrow function: pass k. bitmaps: broadcast {("exact", j): bytes of frequent phrases of j < k words, ("bucket", k): of
    frequent buckets}. Gives partial counts of phrases of k words (k = 1: of all words under the empty phrase as well) and of buckets."""

    def run(batches):
        bits = {key: Bits(packed) for key, packed in bitmaps.value.items()} if bitmaps else {}
        table, counts = Buckets(buckets, min_count), defaultdict(Counts)
        words: dict = defaultdict(int)
        for lang, texts in runs(batches, RUN_BYTES):
            r = Run(texts, lang)
            n = len(r.word)
            if not n:
                continue
            words[lang] += n
            first = np.arange(n)
            for j in range(1, k):
                alive = np.zeros(n, bool)
                alive[first] = bits["exact", j].has(r.hash[first])
                first = r.pairs(alive)
                r.grow(first)
            if k > 1:
                first = first[bits["bucket", k].has(r.hash[first])]
            if len(first):
                counts[lang].add(r, first)
            if k < most_words:
                alive = np.zeros(n, bool)
                alive[first] = True
                longer = r.pairs(alive)
                r.grow(longer)
                table.add(r.hash[longer])
            if sum(c.bytes for c in counts.values()) > HELD_BYTES:
                for of, c in counts.items():
                    c.summed()
                if sum(c.bytes for c in counts.values()) > HELD_BYTES / 2:
                    yield from (c.batch(of) for of, c in counts.items())
                    counts.clear()
        yield from (c.batch(of) for of, c in counts.items())
        if k == 1 and words:
            some = len(words)
            yield pa.record_batch([pa.array(list(words), pa.string()), pa.array([""] * some), pa.array(list(words.values()), pa.int64()), pa.nulls(some, pa.int32()), pa.nulls(some, pa.binary())], names=NAMES)
        yield from table.blocks()

    return run


def hashing(k: int, min_count: int, buckets: int):
    """A mapInArrow function: the buckets of given phrases of k words (lang, phrase), each as high as min_count."""

    def run(batches):
        table = Buckets(buckets, min_count)
        for lang, phrases in runs(batches, RUN_BYTES):
            r = Run(phrases, lang)
            for j in range(1, k):
                first = np.arange(len(r.word) - j)
                r.grow(first)
            table.add(np.repeat(r.hash[::k], min_count))
        yield from table.blocks()

    return run


def _packed(most: int, buckets: int):
    """A mapInArrow function: sums of the blocks' counters as bits, 1 from `most` on."""

    def run(batches):
        sums: dict = {}
        kind, width = (np.uint32, 4) if most > 255 else (np.uint8, 1)
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = np.frombuffer(pa.decompress(counts, min(BLOCK, buckets) * width, codec="zstd"), kind)
                have = sums.get(block)
                sums[block] = raw.astype(np.uint32) if have is None else np.minimum(have + raw, most)
        if sums:
            bits = [np.packbits(v >= most, bitorder="little").tobytes() for v in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    return run


def bitmap(blocks: DataFrame, min_count: int, buckets: int) -> bytes:
    """The bitmap of frequent buckets, of `buckets` bits; blocks: block, counts."""
    size = min(BLOCK, buckets) // 8
    spread = blocks.repartition(max(1, min(64, buckets // BLOCK)), "block")
    out = np.zeros(buckets // 8, np.uint8)
    for row in spread.mapInArrow(_packed(min_count, buckets), "block int, bits binary").collect():  # buckets / 8 bytes in all
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def frequent(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, buckets: int = BUCKETS) -> list[DataFrame]:
    """[words of each language, phrases of 1 word, of 2, ...]: stored tables lang, phrase, f of all phrases found min_count times or more."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found, known, sent = [], {}, None
    for k in range(1, most_words + 1):
        partial = stored(texts.mapInArrow(counting(k, sent, most_words, min_count, buckets), SCHEMA))
        sums = partial.filter(F.col("block").isNull()).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        own = stored(sums.filter((F.col("f") >= min_count) | (F.col("phrase") == "")))
        if k == 1:
            found.append(own.filter("phrase = ''").select("lang", F.col("f").alias("n")))
        found.append(own.filter("phrase <> ''"))
        if k < most_words:
            known["bucket", k + 1] = bitmap(partial.filter(F.col("block").isNotNull()).select("block", "counts"), min_count, buckets)
            exact = found[-1].select("lang", "phrase").mapInArrow(hashing(k, min_count, buckets), SCHEMA)
            known["exact", k] = bitmap(exact.select("block", "counts"), min_count, buckets)
            known.pop(("bucket", k), None)
            sent = context.broadcast(dict(known))
        dropped(partial)
    return found


def scored(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, k, a, l, r, score of the phrases of 2 words or more, by their lowest-scoring cut. found: frequent(...)[1:]."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    every = stored(every)
    rows = every.withColumn("k", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).filter("k > 1").withColumnRenamed("f", "a")
    cuts = rows.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(small(every).select("lang", F.col("phrase").alias(part), F.col("f").alias(n)), ["lang", part])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, top: int = TOP, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED_PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases."""
    totals, *found = frequent(docs, most_words, min_count, buckets)
    rows = stored(scored(found))
    # a phrase within a longer one that is about as frequent is also within one that is a word longer
    within = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    longer = rows.filter("k > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20, 0)")
    rows = rows.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered))
    # the first of each of 64 parts of a language, then of the language
    order = (F.desc("score"), F.desc("a"), "phrase")
    for part in (F.pmod(F.xxhash64("phrase"), F.lit(64)), F.lit(0)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, len(ws) AS m, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
o AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= m),
f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE a >= 30 AND k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, j, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, k, a, array_to_string(ws[q:q + m - 1], ' ') AS inner_phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS q FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase AND 100 * CAST(i.a AS HUGEINT) >= 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b ANTI JOIN d USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000"""
