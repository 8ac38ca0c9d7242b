"""Sources, sinks and stored tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.operators import joins as J
from sparkloom.operators import retrieval as R
from sparkloom.sources import files as S
from sparkloom.sources import deltas, relational, tables

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_sheets_follow_relationships(spark, tmp_path):
    sheet = "<worksheet {}><sheetData><row>{}</row><row><c><v></v></c></row></sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {M}><sheets><sheet name="First" r:id="r9"/><sheet name="Second" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r2" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {M}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(M, '<c t="s"><v>0</v></c><c><v>2</v></c>'))
        z.writestr("xl/worksheets/other.xml", sheet.format(M, '<c t="inlineStr"><is><t>in line</t></is></c><c><v>nan</v></c>'))
    (got,) = S.parsed(spark, str(tmp_path)).collect()
    assert got.error is None and got.paragraphs == ["[Sheet: First]", "in line", "[Sheet: Second]", "shared | 2"]


def test_pdf_pages_or_a_reported_error(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    (got,) = S.parsed(spark, str(tmp_path)).collect()
    assert got.paragraphs is None and got.error  # without pypdf, or with a damaged file, the run goes on


def test_snapshot_writers(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("1", "t", "text", ["x"], "s", "p", "parent", "sec")]
    chunks = spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, source string, parent_id string, parent_text string, section string")
    for _ in range(2):  # overwrites
        S.write_chunks(chunks, path)
    (got,) = S.read_chunks(spark, path).collect()
    assert (got.id, got.title, got.tags, got.section, got.parent_text) == ("1", "t", ["x"], "sec", "parent")
    entities = spark.createDataFrame([("d", "ok")], "doc_id string, status string")
    for _ in range(2):  # appends
        S.append_entities(entities, str(tmp_path / "entities"))
    assert S.read_entities(spark, str(tmp_path / "entities")).count() == 2


def test_samples_are_strict(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"id":"1","question":"q","tags":["a"]}\n\n{"id":"2","question":"r","reference":"é"}\n', encoding="utf-8")
    assert [(r.id, r.question, r.reference, r.tags) for r in S.read_samples(spark, str(path)).orderBy("id").collect()] == [("1", "q", None, ["a"]), ("2", "r", "é", None)]
    for bad in ("{broken", '{"id":"3"}', "[]"):
        path.write_text('{"id":"1","question":"q"}\n\n' + bad + "\n")
        with pytest.raises(ValueError, match="line 3"):
            S.read_samples(spark, str(path))


def test_report_is_one_indented_file(spark, tmp_path):
    path = tmp_path / "report.json"
    for n in (1, 2):
        S.write_report(spark.createDataFrame([(n, "税", None)], "n int, name string, none string"), str(path))
    text = path.read_text(encoding="utf-8")
    assert json.loads(text) == {"n": 2, "name": "税", "none": None} and text.startswith('{\n  "n": 2') and "税" in text
    S.write_report(spark.range(3), str(path))
    assert json.loads(path.read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]


def test_listed_documents(spark):
    got = S.listed_documents(spark, [{"id": 2, "title": "b"}, {"id": "1", "content": "c", "tags": ["t"]}]).orderBy("ord").collect()
    assert [(r.id, r.title, r.content, r.tags) for r in got] == [("2", "b", "", []), ("1", "", "c", ["t"])]


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.count(spark, path) == 0 and tables.count(spark, path, spark.createDataFrame([(7,)], "n long")) == 7
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, v string, ord long")
    tables.merge(df((1, "a", 0), (2, "b", 0), (None, "n", 0)), path, ["id"])
    for _ in range(2):  # run again: the same table
        tables.merge(df((2, "old", 1), (2, "new", 2), (3, "c", 0), (None, "m", 0)), path, ["id"], order="ord")
    have = lambda: {(r.id, r.v) for r in tables.read(spark, path).collect()}
    assert have() == {(1, "a"), (2, "new"), (3, "c"), (None, "m")} and len(tables.versions(spark, path)) == 2
    # an unfinished version isn't read
    (tmp_path / "t" / "v99").mkdir()
    assert have() == {(1, "a"), (2, "new"), (3, "c"), (None, "m")}
    tables.delete(df((1, None, None), (None, None, None)), path, ["id"])
    assert have() == {(2, "new"), (3, "c")} and tables.count(spark, path) == 2
    tables.reset(spark, path)
    assert not tables.exists(spark, path)
    tables.delete(df((1, None, None)), path, ["id"])
    with pytest.raises(ValueError):
        tables.read(spark, path)


def test_graph_is_merged(spark, tmp_path):
    folder = str(tmp_path / "g")
    nodes = {"Clause": spark.createDataFrame([("c1", "x"), ("c2", "y")], "id string, title string"), "Entity": spark.createDataFrame([("e1", "tax")], "id string, name string")}
    edges = {"CITES": spark.createDataFrame([("c1", "c2", 3), ("c1", "gone", 1)], "src string, dst string, occurrences int"), "MENTIONS": spark.createDataFrame([("c1", "e1", 1)], "src string, dst string, occurrences int")}
    for _ in range(2):
        deltas.merge_graph(spark, folder, nodes, edges)
    assert [tuple(r) for r in deltas.read(spark, f"{folder}/edges/CITES").collect()] == [("c1", "c2", 3)]
    assert deltas.read(spark, f"{folder}/edges/MENTIONS").count() == 1 and deltas.read(spark, f"{folder}/nodes/Clause").count() == 2


def test_graph_merges_deal_edges_once_and_read_without_sorting(spark, tmp_path, monkeypatch):
    """Repeated and unknown ends, nulls, ids of several types; edges that are stored already aren't stored again, and a bucket is written
    by several tasks."""
    folder, kept = str(tmp_path / "g"), []
    nodes = {"Clause": spark.range(2000).select("id", F.lit("x").alias("title"))}
    edges = spark.range(6000).select((F.col("id") % 2500).alias("src"), F.when(F.col("id") % 7 > 0, F.col("id") % 1900).alias("dst"), (F.col("id") % 5).cast("int").alias("n"))
    edges = storage.stored(edges.unionByName(edges))
    want = {(r.src, r.dst): r.n for r in edges.collect() if r.dst is not None and r.src < 2000}
    monkeypatch.setattr(deltas, "stored", lambda df: kept.append(df.columns) or storage.stored(df))
    for _ in range(2):
        deltas.merge_graph(spark, folder, nodes, {"CITES": edges})
    assert all("src" not in columns for columns in kept)
    found = deltas.read(spark, f"{folder}/edges/CITES")
    assert {(r.src, r.dst): r.n for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    deltas.merge_graph(spark, folder, {"Entity": spark.createDataFrame([("e1",)], "id string")}, {"MENTIONS": spark.createDataFrame([("5", "e1"), ("5", "e2"), (None, "e1"), ("e1", "1999")], "src string, dst string")})
    assert {tuple(r) for r in deltas.read(spark, f"{folder}/edges/MENTIONS").collect()} == {("5", "e1"), ("e1", "1999")}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        deltas.merge(edges.filter("dst IS NOT NULL"), str(tmp_path / "t"), ["src", "dst"], buckets=1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "t").glob("d*/_bucket=0/*.parquet"))) > 1 and deltas.read(spark, str(tmp_path / "t")).count() == len({(r.src, r.dst) for r in edges.filter("dst IS NOT NULL").collect()})


def test_resume_marker(spark, tmp_path):
    marker = str(tmp_path / "done")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert deltas.pending(files, marker).count() == 3
    deltas.mark_done(files.filter("path < 'b'"), marker)
    deltas.mark_done(files.filter("path < 'c'"), marker)
    assert [r.path for r in deltas.pending(files, marker).collect()] == ["c"]


def test_relational_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("K"), (F.col("id") % 3).alias("KIND"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    relational.write_table(rows, url, "T")
    got = relational.read_table(spark, url, "T", key="K", partitions=5, where="KIND = 1", columns=["K", "NAME"])
    assert got.rdd.getNumPartitions() == 5 and {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.filter("KIND = 1").select("K", "NAME").collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "KIND" in plan.split("PushedFilters")[1] and "ReadSchema: struct<K" in plan
    assert relational.read_table(spark, url, "T", where="KIND = 9", key="K").count() == 0 and relational.read_table(spark, url, "T").count() == 1000


def test_failing_legs_are_empty(spark):
    empty = spark.createDataFrame([], "query_id long, id long, rank int")
    fails = lambda: spark.range(3).select(F.col("id").alias("query_id"), F.raise_error(F.lit("down")).cast("long").alias("id"), F.lit(1).alias("rank"))
    assert R.leg(fails, empty).count() == 0 and R.leg(lambda: 1 / 0, empty).count() == 0
    assert R.leg(lambda: spark.range(2).selectExpr("id AS query_id", "id", "1 AS rank"), empty).count() == 2
    with pytest.raises(Exception, match="down"):
        R.leg(fails, empty, strict=True)


def test_review_chains_of_any_length(spark):
    rows = [(k, k - 1 if k else None) for k in range(41)] + [(100, 999), (200, 201), (201, 200), (202, 201), (300, 300)]
    got = {r.id: (r.root, r.depth) for r in J.review_chain(spark.createDataFrame(rows, "id long, source_review_id long")).collect()}
    assert got == {**{k: (0, k) for k in range(41)}, 100: (100, 0)}


def test_shared_folder(spark, tmp_path):
    """A cluster has to name the folder; only local sessions get a temporary one. Tables that are done with are deleted."""
    from types import SimpleNamespace

    from sparkloom import storage

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))

    assert storage.scratch(session("local[2]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.scratch(session(master))
    df = storage.stored(spark.range(10))
    assert df.count() == 10 and df._stored_at.startswith(spark.conf.get("spark.checkpoint.dir"))
    storage.dropped(df)
    fs, where = tables._files(spark, df._stored_at)
    assert not fs.exists(where)
    joined = lambda t: spark.range(9).join(storage.small(t), "id")._jdf.queryExecution().analyzed().toString()
    few = storage.stored(spark.range(5))
    assert "strategy=broadcast" in joined(few) and "strategy=broadcast" not in joined(storage.stored(spark.range(storage.BROADCAST_BYTES // 32 + 1)))


def test_two_writers_of_a_version(spark, tmp_path):
    """A number that another writer has claimed isn't written to; what is read is the newest that is finished."""
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)
    assert tables._claimed(spark, path) == 2
    tables.replace(spark.range(5), path)
    assert tables.versions(spark, path) == [1, 3] and tables.count(spark, path) == 5


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id long, vector string")
    assert R.missing_columns(df, {"id", "vector"}) == set() == R.missing_columns(df, set())
    with pytest.raises(ValueError, match=r"\['score', 'text'\]"):
        R.missing_columns(df, {"text", "id", "score"})
