"""Quality rules: surface counts of a text, and lines that recur across the documents of a host. Native expressions only.

Cases: a null text counts as empty, so it has no words and fails; a null host is the empty host; an empty table gives an empty
result; rows that repeat a doc_id count as one document and share the sum of their recurring words; null doc_ids count as one document,
which never has recurring words; very long texts are worked on in time proportional to their length (but for a sort); further columns
are ignored by the report and kept by `cleaned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._base import WORD, documents, dropped, n_words_of, packed, small, stored, text_of, unpacked, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A normalised line found in more documents of a host than this is boilerplate; its first document keeps it.
MAX_DOCS_PER_HOST = 50
#: A document that keeps fewer percent of its words is depleted.
MIN_KEPT_PERCENT = 30


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _after(values: Column) -> Column:
    """An array without its first element."""
    return F.slice(values, F.lit(2), F.size(values))


def surface(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated 3-word windows: windows are hashed, sorted with their places, and equal neighbours found; texts whose windows
    are all distinct skip the sort.
    """
    text = docs.select("doc_id", text_of().alias("text"))
    parts = text.select(
        "doc_id",
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        lines_with_words(F.col("text")).alias("lines"),
        words_of(F.col("text")).alias("words"),
    )
    # arrays meet their shifted copies as arguments: inside a lambda over them they would be worked out again for each element
    w = F.transform("words", lambda x: F.xxhash64(x))
    two = F.zip_with(w, _after(w), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(two, _after(_after(w)), lambda ab, c: F.xxhash64(ab, c))
    n = F.size("words")
    hashed = parts.select(
        "doc_id",
        "n_symbols",
        "word_chars",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.slice(windows, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("win"),
    )
    win = F.col("win")
    placed = hashed.withColumn(
        "placed",
        F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    p = F.col("placed")
    inside = lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)
    equal = F.zip_with(p, _after(p), lambda a, b: F.when(a["h"] == b["h"], F.concat(inside(a), inside(b))))
    covered = F.flatten(F.filter(equal, lambda x: x.isNotNull()))
    repeated = F.when(p.isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


def host_lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, line (hash of the normalised line), w: the lines with words of each document, and all the words in them, stored."""
    lines = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), F.explode(lines_with_words(text_of())).alias("x"))
    rows = lines.select("doc_id", "host", F.xxhash64(normal_line(F.col("x"))).alias("line"), n_words_of(F.col("x")).alias("w"))
    return stored(rows.groupBy("doc_id", "host", "line").agg(F.sum("w").alias("w")))


def common_lines(lines: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """host, line, first_doc of the lines that more than max_docs documents of the host have, stored. lines: host_lines(docs)."""
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return stored(counted.filter(F.col("n_docs") > max_docs).select("host", "line", "first_doc"))


def recurring_words(lines: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, n_recurring: words in lines that more than max_docs documents of the host have, save in the first of them."""
    found = lines.join(small(common), ["host", "line"]).filter(F.col("doc_id") != F.col("first_doc"))
    return found.groupBy("doc_id").agg(F.sum("w").alias("n_recurring"))


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """Counts, n_recurring, base_failed and kept for each document. Kept: passes the base rules and isn't depleted."""
    lines = host_lines(docs)
    return judged(docs, lines, common_lines(lines, max_docs), min_kept_percent)


def judged(docs: DataFrame, lines: DataFrame, common: DataFrame, min_kept_percent: int) -> DataFrame:
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_recurring")
    base_failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    depleted = (F.col("n_recurring") > 0) & ((left < MIN_WORDS) | (100 * left < min_kept_percent * n))
    return (
        surface(docs)
        .join(recurring_words(lines, common), "doc_id", "left")
        .withColumn("n_recurring", F.least(F.coalesce("n_recurring", F.lit(0)), n))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """The kept documents without the lines above the limit (in all documents of the host), save in the first kept document of each."""
    lines = host_lines(docs)
    common = common_lines(lines, max_docs)
    # stored before the filter, which would else be pushed into the counts and work their expressions out twice
    verdicts = stored(judged(docs, lines, common, min_kept_percent).select("doc_id", "kept"))
    kept = stored(verdicts.filter("kept").select(F.col("doc_id").alias("_of")).distinct())
    found = lines.join(small(common.select("host", "line")), ["host", "line"])
    found = stored(found.join(small(kept), F.col("doc_id").eqNullSafe(F.col("_of")), "left_semi").select("doc_id", "host", "line"))
    first = found.groupBy("host", "line").agg(F.min("doc_id").alias("first_doc"))
    gone = found.join(first, ["host", "line"]).filter(F.col("doc_id") != F.col("first_doc"))
    gone = stored(gone.groupBy(F.col("doc_id").alias("_of"), F.col("host").alias("_host")).agg(F.collect_set("line").alias("_gone")))
    dropped(lines, common, verdicts, found)
    of, text = F.col("row")["doc_id"], F.col("row")["text"]
    rows = packed(docs).join(small(kept), of.eqNullSafe(F.col("_of")), "left_semi")
    out = rows.join(small(gone), of.eqNullSafe(F.col("_of")) & (F.coalesce(F.col("row")["source"], F.lit("")) == F.col("_host")), "left")
    left = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains("_gone", F.xxhash64(normal_line(x)))))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n")))
    new = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("_kept")).cast("long")
    return unpacked(out, docs.columns, **new)


def query(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_recurring", "base_failed", "kept"
    )


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i+2] AS tri FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, host, unnest(lines) AS x FROM w)),
c AS (SELECT host, line, min(doc_id) AS first_doc FROM l GROUP BY host, line HAVING count(DISTINCT doc_id) > 50),
b AS (SELECT l.doc_id, sum(n) AS n FROM l JOIN c USING (host, line) WHERE l.doc_id <> first_doc GROUP BY l.doc_id),
s AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_recurring
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (n_recurring > 0 AND (n_words - n_recurring < 50 OR 100 * (n_words - n_recurring) < 30 * n_words)) AS kept FROM f"""
