"""Statements of one (type, scope, key) that read nearly the same, over a whole table: safe q-gram filters, then the exact ratio.

The ratio of two normalised statements is 2 M / T, where T is the sum of their lengths and M what a sequence matcher finds in common. The
matched characters lie in blocks, and at least one unmatched character separates two blocks, so there are T - 2 M + 1 blocks at most, and
a block of m characters has m - q + 1 common q-grams. With a ratio of t or more, that makes at least

    t T / 2 - (q - 1) ((1 - t) T + 1)

common q-grams (with repetitions). So candidates share one of their first q-grams, in the order of their numbers over the whole table, the rarest first
(prefix filter), their lengths differ little (length filter: M can't pass the shorter one), and they have that many q-grams in common
(count filter). Q-grams of two characters are used from SHORT characters on; below, and up to where a partner may be longer, single
characters. Equal statements are found first, by equality, and take part once.

A sequence matcher isn't symmetric: the earlier statement (by ord) is its first text, as in a fold that keeps the earlier one.
"""

from __future__ import annotations

import difflib
import itertools
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import statement_key
from sparkloom.operators.components import components
from sparkloom.storage import small, stored

RATIO = 0.85
BY = ["memory_type", "scope", "scope_key"]


def needed(total: Column, q: int, ratio: float) -> Column:
    """Common q-grams that two statements of so many characters together have at least; rounded down against binary fractions."""
    return F.floor(ratio * total / 2 - (q - 1) * ((1 - ratio) * total + 1) + 1e-9)


def shortest(ratio: float) -> int:
    """The length from which bigrams are used: with any partner, at least one is needed in common."""
    n = 1
    while ratio * (t := n + n * ratio / (2 - ratio)) / 2 - ((1 - ratio) * t + 1) < 1:
        n += 1
    return n


def statements(entries: DataFrame) -> DataFrame:
    """The distinct statements of each (type, scope, key), stored: sid, key (normalised), ord (its first), n. Empty ones are left out."""
    keyed = entries.select(*BY, "ord", statement_key(F.col("content")).alias("key")).filter(F.coalesce("key", F.lit("")) != "")
    one = keyed.groupBy(*BY, "key").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    return stored(one.withColumn("sid", F.xxhash64(*BY, "key")))


def _grams(key: Column, q: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(key) - q + 1), lambda i: F.substring(key, i, F.lit(q)))


def _numbered(rows: DataFrame) -> DataFrame:
    """sid, gram, nth: a q-gram's occurrences within a statement are numbered."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")


def candidates(rows: DataFrame, q: int, ratio: float) -> DataFrame:
    """a, b (sids): pairs whose lengths fit and whose prefixes share a q-gram. rows: statements(...) that use q."""
    grams = rows.select(*BY, "sid", F.length("key").alias("len"), F.explode(_grams(F.col("key"), q)).alias("gram"))
    grams = stored(_numbered(grams))
    counts = stored(grams.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("df")))
    placed = grams.join(small(counts), ["gram", "nth"]).withColumn("at", F.row_number().over(Window.partitionBy("sid").orderBy("df", "gram", "nth")))
    least = needed(F.col("len") + F.ceil(F.col("len") * (ratio / (2 - ratio)) - 1e-9), q, ratio)
    prefix = placed.filter(F.col("at") <= F.col("len") - q + 1 - F.greatest(least, F.lit(1)) + 1)
    prefix = stored(prefix.select(*BY, "gram", "nth", "sid", "len"))
    other = prefix.withColumnsRenamed({"sid": "b", "len": "len_b"})
    both = prefix.withColumnsRenamed({"sid": "a", "len": "len_a"}).join(other, [*BY, "gram", "nth"])
    # the shorter of two comes first
    total = F.col("len_a") + F.col("len_b")
    order = (F.col("len_a") < F.col("len_b")) | ((F.col("len_a") == F.col("len_b")) & (F.col("a") < F.col("b")))
    fits = 2 * F.col("len_a") >= ratio * total - 1e-9
    return both.filter(order & fits).select("a", "b").distinct()


def checked_ratio(x: str, y: str, ratio: float) -> float:
    """The sequence matcher's ratio, or 0 where common characters or bigrams show that it is below `ratio`."""
    matcher, total = difflib.SequenceMatcher(None, x, y), len(x) + len(y)
    if matcher.quick_ratio() < ratio:
        return 0.0
    common = (Counter(map("".join, itertools.pairwise(x))) & Counter(map("".join, itertools.pairwise(y)))).total()
    if common < ratio * total / 2 - ((1 - ratio) * total + 1) - 1e-9:
        return 0.0
    return matcher.ratio()


def similar(known: DataFrame, ratio: float = RATIO) -> DataFrame:
    """first, second (sids, the earlier one first), ratio: all pairs of statements(...) whose ratio is `ratio` or more."""
    if not 0.8 <= ratio <= 1:
        raise ValueError("the ratio must be from 0.8 to 1")
    low = shortest(ratio)
    most = int(low * (2 - ratio) / ratio) + 1  # partners of shorter ones are no longer than this
    n = F.length("key")
    pairs = candidates(known.filter(n <= most), 1, ratio).unionByName(candidates(known.filter(n >= low), 2, ratio)).distinct()
    end = lambda c: known.select(F.col("sid").alias(c), F.col("key").alias(f"key_{c}"), F.col("ord").alias(f"ord_{c}"))
    pairs = pairs.join(end("a"), "a").join(end("b"), "b")
    swap = F.struct("ord_b", "b") < F.struct("ord_a", "a")
    side = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = pairs.select(side("a", "b", "first"), side("b", "a", "second"), side("key_a", "key_b", "x"), side("key_b", "key_a", "y"))
    ratios = F.pandas_udf(lambda a, b: pd.Series([checked_ratio(x, y, ratio) for x, y in zip(a, b)], dtype=float), "double")
    return stored(pairs.select("first", "second", ratios("x", "y").alias("ratio"))).filter(F.col("ratio") >= ratio)


def duplicate_statements(entries: DataFrame, ratio: float = RATIO) -> DataFrame:
    """memory_type, scope, scope_key, ord, n, group, links of every distinct statement (entries: these, ord, content): its first ord,
    how often it is there, the first ord of its group (statements linked by ratio, directly or through others) and its links."""
    known = statements(entries)
    links = stored(similar(known, ratio))
    group = components(links.select(F.col("first").alias("a"), F.col("second").alias("b")))
    ends = links.select(F.explode(F.array("first", "second")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    rows = known.join(group.select(F.col("id").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    first = rows.groupBy("label").agg(F.min("ord").alias("group"))
    return rows.join(first, "label").join(ends, "sid", "left").select(*BY, "ord", "n", "group", F.coalesce("links", F.lit(0)).alias("links"))
