"""Durable memories: statements merged with what is known, one key at a time and in order."""

from __future__ import annotations

import difflib
import json
from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import statement_key

CANDIDATES = 200
RATIO = 0.85


def merged(entries: DataFrame, threshold: float = RATIO, candidates: int = CANDIDATES) -> DataFrame:
    """The memories left when entries (id, memory_type, scope, scope_key, content, importance, tags, request_id, ord) arrive in order.

    An entry meets the `candidates` most important, then newest, memories of its (type, scope, scope_key); the first that reads the
    same, or whose ratio reaches the threshold, takes it in: the longer content, the larger importance, tags and requests united in
    order, merge_count one more. Order-dependent, so a key's entries are folded one after the other, in one task: a key is one user's or
    project's. The task reads them as a sorted stream and holds only the key's memories, not its entries.
    """
    by = ["memory_type", "scope", "scope_key"]
    keyed = entries.withColumn("key", statement_key(F.col("content"))).select(*by, "ord", "id", "content", "importance", "tags", "request_id", "key")

    def fold(known: list[dict], e: dict) -> None:
        """known: most important first, then newest."""
        match = None
        if e["key"]:
            for k, m in enumerate(known[:candidates]):
                if m["key"] and (m["key"] == e["key"] or (threshold > 0 and difflib.SequenceMatcher(None, m["key"], e["key"]).ratio() >= threshold)):
                    match = known.pop(k)
                    break
        tags, requests = [t for t in (e["tags"] if e["tags"] is not None else [])], [e["request_id"]]
        if match is None:
            match = {**e, "tags": tags, "requests": requests, "merge_count": 0}
        else:
            if len(e["content"]) > len(match["content"]):
                match["content"], match["key"] = e["content"], e["key"]
            match["importance"] = max(match["importance"], e["importance"])
            match["tags"] = list(dict.fromkeys(match["tags"] + tags))
            match["requests"] = list(dict.fromkeys(match["requests"] + requests))
            match["merge_count"] += 1
        insort(known, match, key=lambda m: (-m["importance"], -m["ord"]))

    names = ["id", "memory_type", "scope", "scope_key", "content", "importance", "tags", "merge_count", "requests"]

    def table(known: list[dict]) -> pd.DataFrame:
        rows = [{**m, "tags": ",".join(m["tags"]), "requests": json.dumps(m["requests"])} for m in known]
        return pd.DataFrame([{n: r[n] for n in names} for r in rows], columns=names)

    def run(batches):
        at, known = None, []
        for batch in batches:
            for e in batch.to_dict("records"):
                here = tuple(e[c] for c in by)
                if here != at:
                    if known:
                        yield table(known)
                    at, known = here, []
                fold(known, e)
        if known:
            yield table(known)

    schema = "id long, memory_type string, scope string, scope_key string, content string, importance int, tags string, merge_count int, requests string"
    return keyed.repartition(*by).sortWithinPartitions(*by, "ord").mapInPandas(run, schema)


def merged_exact(entries: DataFrame) -> DataFrame:
    """The same for equal statements only, without order or Python: a group's longest content (the first of equals), largest
    importance and number of merges. Statements are compared lower-cased, ASCII letters and digits only."""
    key = F.regexp_replace(F.lower("content"), "[^a-z0-9]+", "")
    best = F.max(F.struct(F.length("content").alias("n"), (-F.col("ord")).alias("o"), F.col("content").alias("c")))["c"]
    grouped = entries.withColumn("key", key).filter("key <> ''").groupBy("memory_type", "scope", "scope_key", "key")
    return grouped.agg(best.alias("content"), F.max("importance").alias("importance"), (F.count(F.lit(1)) - 1).alias("merge_count")).drop("key")


def from_payload(answers: DataFrame) -> DataFrame:
    """memory_type, scope, scope_key, content, importance of models' answers (user_id, project, payload JSON with preferences and
    facts): blank contents dropped, importance 3 if missing, the user's scope if there is a user, else the project's."""
    shape = "preferences array<struct<content:string,importance:int>>, facts array<struct<content:string,importance:int>>"
    rows = answers.withColumn("p", F.from_json("payload", shape))
    parts = [rows.select("user_id", "project", F.lit(kind).alias("memory_type"), F.explode(f"p.{name}").alias("x")) for kind, name in (("preference", "preferences"), ("fact", "facts"))]
    both = parts[0].unionByName(parts[1]).filter(F.trim(F.coalesce("x.content", F.lit(""))) != "")
    has = F.coalesce(F.col("user_id"), F.lit("")) != ""
    return both.select("memory_type", F.when(has, "user").otherwise("project").alias("scope"), F.when(has, F.col("user_id")).otherwise(F.col("project")).alias("scope_key"), F.trim("x.content").alias("content"), F.coalesce("x.importance", F.lit(3)).alias("importance"))
