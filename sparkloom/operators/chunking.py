"""From files to chunks: metadata of a file name, paragraphs, clauses, sentences, two levels of pieces with stable ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import NUMERAL
from sparkloom.storage import stored

# Fixed values.
ENDERS = "。！？；;"
CLAUSE = rf"(?U)^\s*(第\s*[{NUMERAL}]*\s*条)\s*.*$"
HEADING = rf"(?U)^\s*第\s*[{NUMERAL}]*\s*[章节]\s*.*$"
WHOLE = "全文"
FILE_NO = r"(?U)^\s*([0-9]{1,4})\s*[_\-．.、]?\s*(.*)$"


def file_metadata(name: Column) -> tuple[Column, Column]:
    """(title, file_no) of a file name: leading digits are its number, underscores are spaces."""
    base = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    number = F.regexp_extract(base, FILE_NO, 1)
    rest = F.regexp_extract(base, FILE_NO, 2)
    title = F.when((number != "") & (rest != ""), rest).otherwise(base)
    return F.trim(F.regexp_replace(F.trim(title), "_+", " ")), number


def document_type(title: Column) -> Column:
    """The first that fits, in this order."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(title, w))
    return (
        F.when(has("条例"), "条例")
        .when(has("法") & ~has("办法"), "法律")
        .when(has("办法", "规定", "细则"), "规章/办法")
        .when(has("通知", "公告"), "通知/公告")
        .when(has("批复", "答复", "意见"), "批复/答复")
        .otherwise("其他")
    )


def paragraphs(text: Column) -> Column:
    """Lines with trailing white space removed, blank ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def clauses(docs: DataFrame, key: str = "doc_id", lines: str = "paragraphs") -> DataFrame:
    """key, clause_no, section, text. A line with an article number, shorter than 120 letters, opens a clause; short chapter and
    section headings are left out; a clause's lines are joined by spaces."""
    rows = docs.select(key, F.posexplode(lines).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    rows = rows.filter((F.col("line") != "") & ~(F.rlike("line", F.lit(HEADING)) & (F.length("line") <= 60)))
    opens = F.rlike("line", F.lit(CLAUSE)) & (F.length("line") < 120)
    order = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("clause_no", F.sum(opens.cast("int")).over(order).cast("int"))
    label = F.when(opens, F.trim(F.regexp_extract("line", CLAUSE, 1)))
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    grouped = rows.groupBy(key, "clause_no").agg(
        F.coalesce(F.max(label), F.lit(WHOLE)).alias("section"), F.array_join(F.transform(listed, lambda x: x["line"]), " ").alias("text")
    )
    return grouped.filter(F.col("text") != "")


def sentences(text: Column) -> Column:
    """Split after an ender; an ender keeps its sentence, and further ones, white space between them dropped, join it."""
    found = F.regexp_extract_all(text, F.lit(rf"(?U)[^{ENDERS}]*[{ENDERS}](?:\s*[{ENDERS}])*|[^{ENDERS}]+$"), 0)
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), rf"(?U)(?<=[{ENDERS}])\s+(?=[{ENDERS}])", ""))
    return F.filter(tidy, lambda x: F.regexp_replace(x, f"[{ENDERS}]", "") != "")


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Sentences gathered, line by line, into pieces of `size` letters at most. The first sentence of an empty piece is taken
    whatever its length; a later one that is too long is cut every size - overlap letters. A full piece's last `overlap` letters
    open the next."""
    held = ""
    for part in parts:
        if held == "" or len(held) + 1 + len(part) <= size:
            held = f"{held}\n{part}".strip()
            continue
        yield held
        if len(part) <= size:
            held = f"{held[len(held) - overlap:] if overlap else ''}\n{part}".strip()
        else:
            cuts = range(0, len(part) - size, size - overlap)
            yield from (part[k : k + size] for k in cuts)
            held = part[cuts[-1] + size - overlap :]
    if held.strip():
        yield held


def pieces(text: Column, size: int, overlap: int) -> Column:
    """array<string>: the text itself if it fits, else its packed sentences."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(whole: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[t] if len(t) <= size else list(packed(list(p), size, overlap)) for t, p in zip(whole, parts)])

    return pack(text, sentences(text))


def chunk_id(path: Column, index: Column, head: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("#", path, index.cast("string"), F.substring(head, 1, 64))), 1, 20)


def stable_key(chunk: Column) -> Column:
    """A number from an id of 40 letters at most."""
    return F.conv(F.substring(F.sha1(F.substring(chunk, 1, 40)), 1, 15), 16, 10).cast("bigint")


def document_key(path: Column) -> Column:
    return F.concat(F.lit("doc:"), F.replace(path, F.lit("\\"), F.lit("/")))


#: White space as (?U)\s has it, for the same rules inside tasks.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRIP = re.compile(rf"^[{SPACES}]+|[{SPACES}]+$")
_ARTICLE = re.compile(rf"[{SPACES}]*(第[{SPACES}]*[{NUMERAL}]*[{SPACES}]*条)[^\n\r\x85\u2028\u2029]*\Z")
_CHAPTER = re.compile(rf"[{SPACES}]*第[{SPACES}]*[{NUMERAL}]*[{SPACES}]*[章节][^\n\r\x85\u2028\u2029]*\Z")
_SENTENCE = re.compile(rf"[^{ENDERS}]*[{ENDERS}](?:[{SPACES}]*[{ENDERS}])*|[^{ENDERS}]+\Z")
_BETWEEN = re.compile(rf"(?<=[{ENDERS}])[{SPACES}]+(?=[{ENDERS}])")


def _clauses(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(section, text) as `clauses` has them, for one document."""
    section, held = WHOLE, []
    for raw in lines:
        line = _STRIP.sub("", raw or "")
        if not line or (len(line) <= 60 and _CHAPTER.match(line)):
            continue
        opens = _ARTICLE.match(line) if len(line) < 120 else None
        if opens:
            if held:
                yield section, " ".join(held)
            section, held = opens[1].strip(" "), []
        held.append(line)
    if held:
        yield section, " ".join(held)


def _pieces(text: str, size: int, overlap: int) -> list[str]:
    """As `pieces` has them, for one text."""
    if len(text) <= size:
        return [text]
    parts = (_BETWEEN.sub("", _STRIP.sub("", x)) for x in _SENTENCE.findall(text))
    return list(packed([x for x in parts if x.strip(ENDERS)], size, overlap))


def chunks(docs: DataFrame, chunk_size: int, overlap: int, child_window: int, key: str = "doc_id", path: str = "source_path") -> DataFrame:
    """One row a child: parents partition a clause, children partition a parent with overlap. Ids depend on path, place and head.

    A document's row holds all its paragraphs: both levels are cut where it lies, in Arrow batches and without a shuffle."""
    if child_window > chunk_size:
        raise ValueError("child_window must not exceed chunk_size")
    if overlap >= child_window:
        raise ValueError("overlap must be smaller than size")
    names = ["_row", "section", "parent", "parent_index", "chunk_index", "text"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def cut(batches):
        for whole in batches:
            rows: list[tuple] = []
            for at, lines in enumerate(whole.column(2)):
                parents = ((section, p) for section, text in _clauses(lines.as_py() or []) for p in _pieces(text, chunk_size, 0))
                children = ((section, p, k, c) for k, (section, p) in enumerate(parents) for c in _pieces(p, child_window, overlap))
                rows += [(at, section, p, k, n, c) for n, (section, p, k, c) in enumerate(children)]
                if len(rows) > 5000:
                    yield made(whole, rows)
                    rows = []
            yield made(whole, rows)

    def made(whole, rows):
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([whole.column(0).take(columns[0]), whole.column(1).take(columns[0]), *columns[1:]], ["_key", "_path", *names[1:]])

    given = dict(docs.dtypes)
    rows = docs.select(F.col(key).alias("_key"), F.col(path).alias("_path"), "paragraphs")
    rows = rows.mapInArrow(cut, f"_key {given[key]}, _path {given[path]}, section string, parent string, parent_index int, chunk_index int, text string")
    return rows.select(
        F.col("_key").alias(key),
        chunk_id(F.col("_path"), F.col("chunk_index"), F.col("text")).alias("id"),
        "chunk_index",
        "section",
        "text",
        chunk_id(F.col("_path"), F.concat(F.lit("p"), F.col("parent_index").cast("string")), F.lit("")).alias("parent_id"),
        F.when(F.col("text") == F.col("parent"), "").otherwise(F.col("parent")).alias("parent_text"),
    )


def successors(docs: DataFrame, order: str, key: str) -> DataFrame:
    """key, next: each document and the one after it. Rows meet their successors by rank."""
    ranked = ranks(docs.select(order, key), order, key)
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("next"))
    return ranked.select("rank", key).join(after, "rank").select(key, "next")


def ranks(df: DataFrame, order: str, tie: str | None = None) -> DataFrame:
    """Adds rank (from 0) by an order column, then `tie` (else any), without sorting all rows in one task: rows are dealt by ranges of
    both, which Spark samples, so that many rows of one order lie in many ranges, and stored; counts of the ranges, then ranks within them."""
    by = [order, tie] if tie else [order]
    dealt = stored(df.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    return dealt.withColumn("inner", inner).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("inner")).drop("range", "inner", "before")


def batches(rows: DataFrame, key: str, order: str, text: str, section: str, most: int = 20, most_chars: int = 12_000) -> DataFrame:
    """Adds batch and ref (c1, c2, ...) within a key: at most `most` rows and `most_chars` letters a batch, one row at least."""
    schema = f"{key} {dict(rows.dtypes)[key]}, {order} {dict(rows.dtypes)[order]}, batch int, ref string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, n, size, out = 0, 0, 0, []
        for cost in pdf["cost"]:
            if n and (n >= most or size + cost > most_chars):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + cost
            out.append((batch, f"c{n}"))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "batch": [x[0] for x in out], "ref": [x[1] for x in out]})

    sized = rows.select(key, order, (F.length(text) + F.length(section) + 8).alias("cost"))
    return sized.groupBy(key).applyInPandas(fold, schema)


def embedded(rows: DataFrame, embed, text: str = "text", instruction: str = "") -> DataFrame:
    """Adds `vector`, an injected column function of the text; queries carry an instruction before it, documents none."""
    return rows.withColumn("vector", embed(F.concat(F.lit(instruction), F.col(text))))


def ingest_report(files: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """One row: files, failed (with an error), documents with chunks, chunks, letters."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    c = chunk_rows.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"))
    return f.crossJoin(F.broadcast(c))
