"""Line dedup by a log-template tree: lines are parsed at a fixed depth by token count and leading tokens, variable fields are
generalised, and templates that recur across documents are dropped. Native expressions only.

Depth 1 is a line's token count, the next levels its first tokens; tokens with a digit are variable and read `<*>`. A leaf
holds several groups: its templates, the most widespread first, each join the first representative with which they agree in
MIN_ALIKE_PERCENT of all places or more (the differing places being variable fields), or become a representative themselves. A
template, or a group, found in MIN_DOCS documents or more recurs, and so does a line of over LONG_WORDS words found as it is
(but for white space) in two. Its lines go from all documents but the first (the smallest doc_id), so that no passage is lost.
Representatives are found REPS a leaf and round, then twice as many a round up to MOST_REPS, until what is left of a leaf can't recur.

Cases: a null text is the empty text; lines without a word never recur and stay; ties between representatives go to the smaller
hash; rows that repeat a doc_id count as one document and lose the lines at the same numbers; null doc_ids count as one document, whose
lines stay; very long texts and lines are taken whole; an empty table gives an empty result; further columns are ignored by the report
and kept by `deduped`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._base import WORD, documents, dropped, packed, stored, text_of, unpacked

DEPTH = 3
MIN_DOCS = 10
MIN_ALIKE_PERCENT = 70
LONG_WORDS = 50
MIN_DOCS_LONG = 2
#: Templates of a leaf that the first round resolves; each further one twice as many, up to the most. It doesn't change the groups.
REPS, MOST_REPS = 32, 512


def flat(line: Column) -> Column:
    """Single spaces between words, none around; most lines are so already."""
    odd = F.contains(line, F.lit("  ")) | line.rlike(r"[\x09\x0B-\x0D]")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """A flat line in lower case, tokens with a digit as <*>."""
    low = F.lower(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(low, r"[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(low)


def n_tokens(line: Column) -> Column:
    """Tokens of a flat line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf_of(line: Column, depth: int) -> Column:
    """Token count and leading tokens of a flat line; only the leading tokens are masked for it."""
    return F.xxhash64(n_tokens(line), masked(F.substring_index(line, " ", depth)))


def flat_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, line_no, line (flat), leaf of every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "raw")).filter(F.col("raw").rlike(WORD))
    lines = lines.select("doc_id", "line_no", flat(F.col("raw")).alias("line"))
    return lines.select("doc_id", "line_no", "line", leaf_of(F.col("line"), depth).alias("leaf"))


def parsed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, line_no, leaf, template, long (hashes) of every line with a word. long: of the line itself, null for a short one."""
    line = F.col("line")
    long = F.when(n_tokens(line) > LONG_WORDS, F.xxhash64(line))
    return flat_lines(docs, depth).select("doc_id", "line_no", "leaf", F.xxhash64(masked(line)).alias("template"), long.alias("long"))


def _agree(a: Column, b: Column, alike: int) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return 100 * same >= alike * F.size(a)


def grouped(forms: DataFrame, min_docs: int = MIN_DOCS, alike: int = MIN_ALIKE_PERCENT, reps: int = REPS) -> DataFrame:
    """leaf, template, first_doc, n_docs, rep of the forms of groups that may recur. forms: leaf, template, first_doc, n_docs, t (tokens).

    The widest `reps` forms left in a leaf agree with no earlier representative, so they are resolved among themselves, and all
    others meet the new representatives in their order: the groups are those of one form at a time. A round's table is what it leaves
    and what it has found; the latter alone is kept.
    """
    left, out, rounds = forms, None, []
    order = Window.partitionBy("leaf").orderBy(F.desc("n_docs"), "template")
    while True:
        live = left.groupBy("leaf").agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k")).filter((F.col("n") >= min_docs) & (F.col("k") > 1))
        top = left.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= reps).groupBy("leaf")
        top = top.agg(F.sort_array(F.collect_list(F.struct("at", "template", "t"))).alias("top")).join(live.select("leaf"), "leaf", "left_semi")
        first = F.slice("top", 1, 1)
        new = F.aggregate(
            F.slice("top", 2, reps), first, lambda acc, x: F.when(F.exists(acc, lambda r: _agree(r["t"], x["t"], alike)), acc).otherwise(F.concat(acc, F.array(x)))
        )
        met = left.join(top.select("leaf", new.alias("reps")), "leaf")
        hit = F.get(F.filter("reps", lambda r: (r["template"] == F.col("template")) | _agree(r["t"], F.col("t"), alike)), F.lit(0))["template"]
        met = stored(met.select("leaf", "template", "first_doc", "n_docs", "t", hit.alias("rep")))
        if met.isEmpty():
            break
        found = stored(met.filter(F.col("rep").isNotNull()).drop("t"))
        out = found if out is None else out.unionByName(found)
        left = stored(met.filter(F.col("rep").isNull()).drop("rep"))
        dropped(met, *rounds)
        rounds, reps = [left], max(reps, min(2 * reps, MOST_REPS))
    return met.drop("t") if out is None else out


def recurring(docs: DataFrame, places: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, alike: int = MIN_ALIKE_PERCENT) -> DataFrame:
    """leaf, template, first_doc of every line form to drop: recurring itself, or of a recurring group of its leaf. places: parsed(docs)."""
    each = places.select("doc_id", "leaf", "template").distinct()
    forms = stored(each.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")))
    exact = forms.filter(F.col("n_docs") >= min_docs).select("leaf", "template", "first_doc")
    # a leaf with one form has nothing to generalise
    leaves = stored(
        forms.groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("n_forms"), F.sum("n_docs").alias("n_docs"))
        .filter((F.col("n_forms") > 1) & (F.col("n_docs") >= min_docs))
        .select("leaf")
    )
    found = flat_lines(docs, depth).select("leaf", "line").join(leaves, "leaf").select("leaf", masked(F.col("line")).alias("m"))
    texts = found.distinct().select("leaf", F.xxhash64("m").alias("template"), F.split("m", " ").alias("t"))
    group = stored(grouped(stored(texts.join(forms, ["leaf", "template"])), min_docs, alike))
    # forms of a group may share documents: only these are counted
    maybe = group.groupBy("leaf", "rep").agg(F.sum("n_docs").alias("n"), F.min("first_doc").alias("first_doc")).filter(F.col("n") >= min_docs)
    maybe = stored(group.select("leaf", "template", "rep").join(maybe.drop("n"), ["leaf", "rep"]))
    within = each.join(maybe.select("leaf", "template", "rep"), ["leaf", "template"]).select("doc_id", "leaf", "rep").distinct()
    whole = within.groupBy("leaf", "rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("leaf", "rep")
    loose = maybe.join(whole, ["leaf", "rep"], "left_semi").select("leaf", "template", "first_doc")
    return exact.unionByName(loose).groupBy("leaf", "template").agg(F.min("first_doc").alias("first_doc"))


def recurring_long(places: DataFrame) -> DataFrame:
    """long, first_doc of the long lines that recur as they are. places: parsed(docs)."""
    each = places.filter(F.col("long").isNotNull()).select("doc_id", "long").distinct()
    long = each.groupBy("long").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return long.filter(F.col("n") >= MIN_DOCS_LONG).select("long", "first_doc")


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, dropped: the numbers of a document's lines that go."""
    places = stored(parsed(docs, options.get("depth", DEPTH)))
    forms = stored(recurring(docs, places, **options))
    hit = places.join(forms, ["leaf", "template"]).unionByName(places.join(recurring_long(places), "long"), allowMissingColumns=True)
    return hit.filter(F.col("doc_id") != F.col("first_doc")).groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))


def _with_kept(docs: DataFrame, **options) -> DataFrame:
    """row (the document's columns), gone (line numbers) and kept (text)."""
    gone = dropped_lines(docs, **options).select(F.col("doc_id").alias("of"), F.col("dropped").alias("gone"))
    text = F.col("row")["text"]
    out = packed(docs).join(gone, F.col("row")["doc_id"].eqNullSafe(F.col("of")), "left")
    kept = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return out.select("row", F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents with `dropped` (line numbers; empty if none) and `kept_text`, which replace columns of these names."""
    own = [c for c in docs.columns if c not in ("dropped", "kept_text")]
    return unpacked(_with_kept(docs, **options), [*own, "dropped", "kept_text"], dropped=F.col("gone"), kept_text=F.col("kept"))


def deduped(docs: DataFrame, **options) -> DataFrame:
    """The documents, without the dropped lines."""
    return unpacked(_with_kept(docs, **options), docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def query(spark, sf_dir):
    rows = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size(F.split(text_of(), "\n")).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(text_of("kept_text"), 256).alias("kept_sha256"),
    )
