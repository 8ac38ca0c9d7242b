"""Files and snapshots as tables."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("docx", "pdf", "xlsx")
CHUNK_SCHEMA = "id string, title string, content string, tags array<string>, source string, parent_id string, parent_text string, metadata_payload struct<section:string,parent_id:string>"
ENTITY_SCHEMA = "doc_id string, status string, mentions array<struct<clause_id:string,type:string,name:string>>, stats map<string,bigint>"
SAMPLE_SCHEMA = "id string, question string, reference string, tags array<string>"


def discover(spark: SparkSession, folder: str, limit: int | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, length of the accepted files below a folder, without editors' lock files, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions) & ~name.startswith("~$")).orderBy("path")
    return kept if limit is None else kept.limit(limit)


def _word_lines(data: bytes) -> list[str]:
    """Paragraphs and table rows of a Word file in the order of its body; cells joined by ' | '."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    out = []
    for node in body:
        if node.tag == f"{w}p":
            out.append(text(node))
        elif node.tag == f"{w}tbl":
            out += [" | ".join(text(c).strip() for c in row.iter(f"{w}tc")) for row in node.iter(f"{w}tr")]
    return out


def _sheet_lines(data: bytes) -> list[str]:
    """A workbook's rows as texts, each sheet headed by its name; empty cells and rows dropped. The workbook's relationships say in which
    file a sheet is."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = [(s.get("name"), s.get(rel)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                target = r.get("Target")
                targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        out = []
        for k, (name, ref) in enumerate(sheets, 1):
            out.append(f"[Sheet: {name}]")
            for row in ElementTree.fromstring(z.read(targets.get(ref, f"xl/worksheets/sheet{k}.xml"))).iter(f"{m}row"):
                cells = []
                for c in row.iter(f"{m}c"):
                    v = c.find(f"{m}v")
                    value = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else ("" if v is None else v.text or "")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                cells = [c for c in cells if c.strip() and c.strip().lower() != "nan"]
                if cells:
                    out.append(" | ".join(cells))
    return out


def _pdf_lines(data: bytes) -> list[str]:
    try:
        import pypdf
    except ImportError as e:  # not installed everywhere
        raise RuntimeError("reading PDF files needs pypdf") from e
    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages]


READERS = {"docx": _word_lines, "xlsx": _sheet_lines, "pdf": _pdf_lines}


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """path, paragraphs (right-stripped, blanks dropped), error: each accepted file, read where it lies."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*EXTENSIONS) & ~name.startswith("~$")).select("path", "content")

    def read(batches):
        for pdf in batches:
            lines, errors = [], []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    lines.append([x.rstrip() for x in READERS[path.rsplit(".", 1)[1].lower()](bytes(data)) if x and x.strip()])
                    errors.append(None)
                except Exception as e:  # one damaged file doesn't end the run; it is reported
                    lines.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": pdf["path"], "paragraphs": lines, "error": errors})

    return files.mapInPandas(read, "path string, paragraphs array<string>, error string")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk snapshot; missing fields read as empty, blank lines are skipped."""
    rows = spark.read.schema(CHUNK_SCHEMA).json(path).filter("id IS NOT NULL")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content", "source", "parent_id", "parent_text")]
    return rows.select("id", *empty, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("metadata_payload.section", F.lit("")).alias("section"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    payload = F.struct(F.col("section"), F.col("parent_id")).alias("metadata_payload")
    chunks.select("id", "title", "content", "tags", "source", "parent_id", "parent_text", payload).write.mode("overwrite").json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """The entity snapshot; damaged lines are skipped."""
    return spark.read.schema(ENTITY_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("doc_id IS NOT NULL")


def append_entities(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples, one a line; blank lines are skipped. A damaged line is an error that names it, and so is a file without samples."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.input_file_name().alias("file"))
    rows = lines.filter(F.trim("line") != "").select("file", "at", F.from_json("line", SAMPLE_SCHEMA + ", _damaged string", {"columnNameOfCorruptRecord": "_damaged"}).alias("x"))
    lacking = F.col("x._damaged").isNotNull() | F.col("x.id").isNull() | F.col("x.question").isNull()
    bad = rows.filter(lacking).orderBy("file", "at").select("file", "at").first()
    if bad:
        raise ValueError(f"{bad['file']}, line {bad['at'] + 1}: no sample")
    rows = rows.select("x.*").drop("_damaged")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no samples")
    return rows


MOST_REPORT_ROWS = 100_000


def write_report(report: DataFrame, path: str) -> None:
    """A report as one indented JSON file in UTF-8: its only row's object, or the list of its rows (MOST_REPORT_ROWS at most). The file appears
    when it is whole."""
    spark = report.sparkSession
    rows = [json.loads(r[0]) for r in report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})).limit(MOST_REPORT_ROWS + 1).collect()]
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    data = json.dumps(rows[0] if len(rows) == 1 else rows, ensure_ascii=False, indent=2).encode()
    jvm = spark._jvm.org.apache.hadoop.fs
    target, part = jvm.Path(path), jvm.Path(f"{path}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def listed_documents(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Documents that a configuration lists (id, title, content, tags), numbered in their order."""
    rows = [(k, str(d["id"]), d.get("title", ""), d.get("content", ""), list(d.get("tags", []))) for k, d in enumerate(documents)]
    return spark.createDataFrame(rows, "ord long, id string, title string, content string, tags array<string>")
