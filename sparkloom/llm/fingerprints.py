"""Document fingerprints from prefix polynomial hashes.

H[i] = sum of c[j] * B**j over j < i, modulo two primes: two spans are equal if their differences of H, moved to one place, are.
The fingerprint of a text keeps its length, its whole hash, H at the multiples of a step (a power of two, GRID places at most) from
the front and from the back, and the SKETCH smallest hashes of its SPAN-character spans. Where both texts lie in a task, their
likeness comes from the H themselves: the longest common extensions from the front and from the back, by binary search, and the
sketches' share of common spans (for text that moved) give a number from 0 to 1: 1 for equal texts only. `likeness` does the same
for two stored fingerprints, on their common grid.

Neighbours are those of ascending doc_id, the last one's being the first. Documents are dealt by range, a range a task; the first
document of each range also goes to the range before, so that texts move once and no task sees all. A doc_id with many rows is cut
into ranges by its texts' hashes.

Cases: a null text is the empty text; all empty texts have one fingerprint; a null doc_id comes first; rows that repeat a doc_id
follow each other in the order of their texts' hashes; a lone document is its own neighbour; very long texts are taken whole; empty
table, empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import documents, text_of

PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 69_621)
GRID = 64
SPAN = 24
SKETCH = 32
MOST_RANGES = 100_000
LEAST = -(2**63)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, k: int) -> np.ndarray:
    """BASES[k]**i modulo PRIMES[k] for i < n; grown by doubling."""
    have = _POWERS.get(k, np.ones(1, np.int64))
    while len(have) < n:
        step = have[-1] * BASES[k] % PRIMES[k]
        have = np.concatenate((have, have * step % PRIMES[k]))
    if len(have) <= 1 << 22:
        _POWERS[k] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """H for both primes, shape (2, n + 1). Sums of 2**31 terms below 2**31 fit 63 bits."""
    out = np.zeros((2, len(points) + 1), np.int64)
    for k, p in enumerate(PRIMES):
        np.cumsum((points + 1) * powers(len(points), k) % p, out=out[k, 1:])
        out[k] %= p
    return out


def same_span(a: np.ndarray, b: np.ndarray, i: int, j: int, length: int) -> bool:
    """Whether the spans of this length from place i of one text and j of another are equal, by their H."""
    return all(
        (int(a[k, i + length]) - int(a[k, i])) * int(powers(j + 1, k)[j]) % p == (int(b[k, j + length]) - int(b[k, j])) * int(powers(i + 1, k)[i]) % p
        for k, p in enumerate(PRIMES)
    )


def longest_common_extension(a: np.ndarray, b: np.ndarray, i: int, j: int, back: bool = False) -> int:
    """Length of the longest common span from (back: up to) place i of one text and j of another, by binary search over their H."""
    lo, hi = 0, min(i, j) if back else min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if same_span(a, b, i - mid * back, j - mid * back, mid) else (lo, mid - 1)
    return lo


class Print:
    """A text's H, sketch and fingerprint."""

    def __init__(self, text: str):
        self.h = prefix_hashes(code_points(text))
        self.n = self.h.shape[1] - 1
        spans = span_of_length(self.h, min(SPAN, self.n)) if self.n else np.zeros(0, np.int64)
        self.sketch = least(_spread(spans), SKETCH)

    def text(self) -> str:
        """length:whole hash:step:front grid:back grid:sketch, in hexadecimal; the lists' items have 16, 16 and 8 digits."""
        h, n, step = self.h, self.n, 1
        while n // step > GRID:
            step *= 2
        inner = np.arange(step, n + 1, step)
        front = (h[0, inner] << 31) | h[1, inner]
        whole = (int(h[0, n]) << 31) | int(h[1, n])
        listed = [part.astype(kind).tobytes().hex() for part, kind in ((front, ">u8"), (suffix_hashes(h, inner), ">u8"), (self.sketch, ">u4"))]
        return ":".join([format(n, "x"), format(whole, "016x"), format(step, "x"), *listed])

    def like(self, other: Print) -> float:
        """0 to 1; 1 for equal texts only."""
        n, m = self.n, other.n
        if n == m and (n == 0 or (self.h[:, n] == other.h[:, m]).all()):
            return 1.0
        if not n or not m:
            return 0.0
        front = longest_common_extension(self.h, other.h, 0, 0)
        back = longest_common_extension(self.h, other.h, n, m, back=True)
        return _likeness(min(front + back, n, m) / max(n, m), self.sketch, other.sketch)


def _likeness(extended: float, x, y) -> float:
    x, y = set(x), set(y)
    smallest = sorted(x | y)[:SKETCH]
    spans = sum(v in x and v in y for v in smallest) / max(1, len(smallest))
    return min(max(extended, spans), 1 - 1e-9)


def suffix_hashes(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the suffixes of these lengths, independent of where they begin."""
    n = h.shape[1] - 1
    starts = n - lengths
    out = [(h[k, n] - h[k, starts]) % p * inverse_powers(n + 1, k)[starts] % p for k, p in enumerate(PRIMES)]
    return (out[0] << 31) | out[1]


def span_of_length(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of one length, of 31 bits: (H[i + length] - H[i]) * B**(n - i) for the first prime."""
    n = h.shape[1]
    p = PRIMES[0]
    moved = (h[0, length:] - h[0, : n - length]) % p * inverse_powers(n)[: n - length] % p
    return moved


def inverse_powers(n: int, k: int = 0) -> np.ndarray:
    """BASES[k]**-i modulo PRIMES[k] for i < n."""
    have = _POWERS.get(-1 - k, np.ones(1, np.int64))
    inverse, p = pow(BASES[k], -1, PRIMES[k]), PRIMES[k]
    while len(have) < n:
        step = int(have[-1]) * inverse % p
        have = np.concatenate((have, have * step % p))
    if len(have) <= 1 << 22:
        _POWERS[-1 - k] = have
    return have[:n]


def least(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest distinct values, without sorting all."""
    if len(values) > 8 * count:
        some = np.unique(np.partition(values, 8 * count - 1)[: 8 * count])
        if len(some) >= count:
            return some[:count]
    return np.unique(values)[:count]


def _spread(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling, so that the smallest are a fair sample."""
    return (x * 2_654_435_761 + 40_503) % 4_294_967_291


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints alone."""
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    n, m, step = int(a[0], 16), int(b[0], 16), max(int(a[2], 16), int(b[2], 16))
    if not n or not m:
        return 0.0
    lists = [[[x[i : i + w] for i in range(0, len(x), w)] for x, w in zip(f[3:], (16, 16, 8))] for f in (a, b)]

    def common(k: int) -> int:
        x, y = lists[0][k][step // int(a[2], 16) - 1 :: step // int(a[2], 16)], lists[1][k][step // int(b[2], 16) - 1 :: step // int(b[2], 16)]
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
        return lo * step

    return _likeness(min(common(0) + common(1), n, m) / max(n, m), lists[0][2], lists[1][2])


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the next text (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def range_bounds(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most n - 1 places (key, h) that cut the rows into ranges: quantiles of key, and equal parts of the hashes h for a key that
    has several of them."""
    if n < 2:
        return []
    found = Counter(int(b) for b in rows.stat.approxQuantile("key", [k / n for k in range(1, n)], min(0.01, 0.1 / n)))
    return sorted((key, LEAST + (2**64 // times) * k) for key, times in found.items() for k in range(times))


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds at or below (key, h); two levels, so that a row meets about 2 * sqrt(n) bounds."""
    if not bounds:
        return F.lit(0)
    here = F.struct(F.col("key"), F.col("h"))
    bound = lambda b: F.struct(F.lit(b[0]).cast("long").alias("key"), F.lit(b[1]).cast("long").alias("h"))
    at_or_below = lambda limits: F.size(F.filter(limits, lambda b: b <= here))
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    group = at_or_below(F.array(*(bound(g[0]) for g in groups)))
    inner = F.get(F.array(*(F.array(*map(bound, g)) for g in groups)), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * width + at_or_below(inner))


def with_next(docs: DataFrame, run, schema: str, per_range: int = 4000) -> DataFrame:
    """run(Arrow rows doc_id, text, range, halo) over each range's documents and the first of the range after it (halo 1). The bounds
    and the first row of each range are gathered, at most MOST_RANGES; beyond, ranges are larger."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("key"), F.xxhash64(text_of()).alias("h"))
    rows = rows.withColumn("range", range_of(range_bounds(rows, min(rows.count() // per_range + 1, MOST_RANGES))))
    firsts = rows.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("range").collect()
    n = max([0, *(f["range"] for f in firsts)]) + 1
    if firsts:
        before = [(f["first"]["key"], f["first"]["h"], firsts[k - 1]["range"]) for k, f in enumerate(firsts)]
        extra = spark.createDataFrame(before, "key long, h long, to int")
        copies = rows.join(F.broadcast(extra), ["key", "h"]).select("doc_id", "text", "key", "h", F.col("to").alias("range"), F.lit(1).alias("halo"))
        rows = rows.withColumn("halo", F.lit(0)).unionByName(copies)
    else:
        rows = rows.withColumn("halo", F.lit(0))
    return rows.repartitionById(n, "range").sortWithinPartitions("range", "halo", "key", "h").select("doc_id", "text", "range", "halo").mapInArrow(run, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the row that waits for its neighbour
        made: list = []

        def done():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in made], pa.int64() if kind == "bigint" else None)] + [pa.array([r[k] for r in made], t) for k, t in enumerate([pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], 1)],
                names,
            )
            made.clear()
            return out

        for batch in batches:
            for doc_id, text, bucket, halo in zip(*batch.columns):
                doc_id, text, bucket, halo = doc_id.as_py(), text.as_py(), bucket.as_py(), halo.as_py()
                print_ = Print(text)
                if held is not None and held[2] == bucket and not held[3]:
                    new = edited(held[1], text)
                    new_print = held[4] if new == held[1] else Print(new)
                    made.append((held[0], len(held[1]), new, held[4].text(), new_print.text(), held[4].like(new_print), held[4].like(print_)))
                held = (doc_id, text, bucket, halo, print_)
                if len(made) >= 256:
                    yield done()
        yield done()

    return with_next(docs, run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir):
    rows = fingerprints(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
