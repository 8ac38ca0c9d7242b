"""Word segmentation of Chinese by a dictionary table: the word graph of a run of Han characters and its most probable path.

A text is a sequence of runs: of Han characters, of other letters and digits (a token each), and single other characters but white
space. Each distinct Han run is segmented once. Its word graph comes from a join of its substrings with the dictionary, so the
dictionary may be as large as a table; a substring is looked at only while its first two characters begin a word. A path's weight is
the sum of its words' log frequencies; at a place where no word begins the character stands alone, as frequent as one occurrence. The
best path is found from the end, ties going to the longer word.

Cases: a null or empty text has no tokens; words of the dictionary that aren't Han are never met; repeated words count with the sum of
their frequencies, those without a positive one don't count; an empty dictionary gives single characters; runs may be of any length.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import small, stored

HAN = r"[一-鿕]"
#: Runs of Han characters, of other letters and digits, and other visible characters.
RUNS = rf"{HAN}+|[\p{{L}}\p{{M}}\p{{N}}&&[^一-鿕]]+|\S"
LONGEST = 16


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), 0)


def dictionary(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, weight (log of its share of all frequencies; negative) of words (word, freq) up to `longest` characters, stored."""
    clean = words.filter(F.col("word").rlike(f"^{HAN}+$") & (F.col("freq") > 0) & (F.length("word") <= longest))
    by = stored(clean.groupBy("word").agg(F.sum("freq").cast("double").alias("freq")))
    total = by.agg(F.coalesce(F.sum("freq"), F.lit(1.0)).alias("total"))
    return stored(by.crossJoin(F.broadcast(total)).select("word", F.ln(F.col("freq") / F.col("total")).alias("weight"), (-F.ln("total")).alias("alone")))


def word_graph(found: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, start (from 1), n, weight: the words of the dictionary in each run (found: run)."""
    starts = found.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    ones = starts.select("run", "start", F.lit(1).alias("n"), F.substring(F.col("run"), F.col("start"), F.lit(1)).alias("word"))
    heads = small(stored(words.filter(F.length("word") > 1).groupBy(F.substring("word", 1, 2).alias("head")).agg(F.max(F.length("word")).alias("most"))))
    pairs = starts.withColumn("head", F.substring(F.col("run"), F.col("start"), F.lit(2))).join(heads, "head")
    most = F.least(F.col("most"), F.length("run") - F.col("start") + 1)
    longer = pairs.withColumn("n", F.explode(F.sequence(F.lit(2), most))).select("run", "start", "n", F.substring(F.col("run"), F.col("start"), F.col("n")).alias("word"))
    return ones.unionByName(longer).join(small(words), "word").select("run", "start", "n", "weight")


def best_path(n: int, edges: list[tuple[int, int, float]], alone: float) -> list[int]:
    """Lengths of the words on the best path through n characters; edges: start (from 1), length, weight."""
    at: dict = {}
    for start, size, weight in edges:
        at.setdefault(start - 1, []).append((size, weight))
    value, step = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        value[i], step[i] = max((weight + value[i + size], size) for size, weight in at.get(i, [(1, alone)]))
    out, i = [], 0
    while i < n:
        out.append(step[i])
        i += step[i]
    return out


def _paths(run: pd.Series, edges: pd.Series, alone: pd.Series) -> pd.Series:
    out = []
    for text, found, one in zip(run, edges, alone):
        cut, i = [], 0
        for size in best_path(len(text), [] if found is None else [(e["start"], e["n"], e["weight"]) for e in found], one):
            cut.append(text[i : i + size])
            i += size
        out.append(cut)
    return pd.Series(out, dtype=object)


def segmented_runs(found: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, tokens of distinct Han runs (found: run), stored; words: dictionary(...)."""
    graph = word_graph(found, words, longest).groupBy("run").agg(F.collect_list(F.struct("start", "n", "weight")).alias("edges"))
    alone = words.agg(F.coalesce(F.max("alone"), F.lit(math.log(1.0))).alias("alone"))
    rows = found.join(graph, "run", "left").crossJoin(F.broadcast(alone))
    paths = F.pandas_udf(_paths, "array<string>")
    return stored(rows.select("run", paths("run", "edges", "alone").alias("tokens")))


def segmented(texts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """id, tokens of texts (id, text); words: word, freq."""
    numbered = texts.select("id", "text", F.monotonically_increasing_id().alias("row"))
    split = stored(numbered.select("id", "row", F.posexplode(runs(F.col("text"))).alias("place", "run")))
    han = F.col("run").rlike(f"^{HAN}")
    known = segmented_runs(stored(split.filter(han).select("run").distinct()), dictionary(words, longest), longest)
    rows = split.join(known, "run", "left").select("id", "row", "place", F.coalesce("tokens", F.array("run")).alias("tokens"))
    lists = rows.groupBy("row", "id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    none = texts.filter(F.size(runs(F.col("text"))) == 0).select("id", F.array().cast("array<string>").alias("tokens"))
    return lists.select("id", "tokens").unionByName(none)
