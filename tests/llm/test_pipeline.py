"""The pipeline's stages, each on what its predecessor kept."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import jaccard_join, line_dedup, mixing, quality_rules
from sparkloom.llm._base import stored


def test_stages(spark, docs, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "bpe"]
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(stored(stage(spark, tables[-1], sf)))
        assert k == 4 or tables[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    assert ids[1] == sorted(r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect())
    assert ids[2] == ids[1]
    want = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(tables[1]).collect()}
    assert {r.doc_id: r.text for r in tables[2].collect()} == want
    parts = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(tables[2], 5, 80).collect()}
    assert ids[3] == sorted(d for d, c in parts.items() if d == c)
    copies = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect()}
    assert ids[4] == sorted(d for d, c in copies.items() for _ in range(c))
    assert ids[5] == ids[4]


def test_quality_stage_removes_recurring_lines(spark, sf):
    """Lines above the host's limit go from kept documents but the first kept one, also where the very first is rejected."""
    own = {k: " ".join(f"own{k}w{j}" for j in range(60)) for k in range(56)}
    line = "Read  our other stories here"
    rows = [(0, line, "en", "a", len(line))] + [(k, f"{own[k]}\n\n{line}", "en", "a", 0) for k in range(1, 55)]
    rows += [(55, f"{own[55]}\n{line}", "en", None, 7)]
    got = {r.doc_id: r for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf).collect()}
    assert sorted(got) == list(range(1, 56))
    assert got[1].text == rows[1][1] and got[55].text == rows[55][1] and got[55].n_chars == 7
    assert all(got[k].text == own[k] + "\n" and got[k].n_chars == len(own[k]) + 1 for k in range(2, 55))


def test_pipeline_of_nothing(spark, none, sf):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
    assert docs.count() == 0


def test_stages_of_odd_rows(spark, sf):
    """Null and repeated ids, nulls in every column, empty and very long texts, and further columns whose names the operators use."""
    words = lambda k, n: " ".join(f"k{k}w{j}" for j in range(n))
    rows = [(None, words(0, 60), None, None, None), (None, words(1, 60), "en", "s", 1), (2, words(2, 70), "en", None, 9), (2, words(2, 70), "en", None, 9), (3, None, None, "s", None), (4, "", "en", "s", 0), (5, words(5, 50_000), "en", "s", 7)]
    clash = "1 AS n, 'x' AS word, 0 AS label, 'y' AS rep, 2 AS spans, 3 AS size, 4 AS copies, 5 AS shard, 6 AS dropped, 7 AS kept_text, 8 AS p, 9 AS k1, 'z' AS line, 1 AS leaf, 2 AS `key`, 3 AS id, 4 AS s, 5 AS kept, 6 AS host, 7 AS target, 8 AS block"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *clash.split(", "))
    kept = {"quality_rules": [None, None, 2, 2, 5], "line_dedup": [None, None, 2, 2, 3, 4, 5], "near_duplicates": [None, None, 2, 3, 4, 5], "bpe": [None, None, 2, 2, 3, 4, 5]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert name == "bpe" or out.columns == df.columns
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda d: -1 if d is None else d)
        if name == "mixing":
            assert set(ids) <= {None, 2, 3, 4, 5} and 5 in ids
        else:
            assert ids == kept[name], name


def internal_names():
    """Every column name that the stages' modules give, taken from their code."""
    folder = Path(corpus_pipeline.__file__).parent / "sparkloom"
    code = "".join((folder / "llm" / f"{m}.py").read_text() for m in ("_base", "quality_rules", "line_dedup", "jaccard_join", "components", "mixing", "bpe")) + (folder / "operators/components.py").read_text()
    found = set(re.findall(r'(?:alias|withColumn|withColumnRenamed|col|select|drop|groupBy|agg)\("(\w+)"', code)) | set(re.findall(r'"(\w+)", F\.', code)) | set(re.findall(r'"(_\w+)"', code))
    return sorted({n for n in found if len(n) < 20} - {"doc_id", "text", "lang", "source", "n_chars"})


def test_names_of_the_stages_in_the_table(spark, sf):
    """Columns that are named as the stages' own come back with the user's values."""
    names = [n for n in internal_names() if n not in ("dropped", "kept_text")]
    assert {"_gone", "_of", "_host", "_again", "_kept", "_id", "_key", "row", "shards", "ord", "at", "copy", "key"} <= set(names)
    words = lambda k, n: " ".join(f"k{k}w{j}" for j in range(n))
    shared = "\nthis line is in all of these documents"
    rows = [(k, words(k % 55, 60 + k % 55) + shared, "en", f"s{k % 2}" if k > 60 else "s", 0) for k in range(70)] + [(None, words(99, 60), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names), F.lit(1).alias("a b.c`d"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}:{'null' if r.doc_id is None else r.doc_id}" for r in got for n in names), name
