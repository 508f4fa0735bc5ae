"""Many small packages: batches of Arrow hold the rows of many, and packages may go on from one batch to the next."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import styles
from lectern.sources import documents

SPACE = f'xmlns:w="{documents.W[1:-1]}"'
BODY = f"<w:document {SPACE}><w:p><w:r><w:t>one</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>"
TEXTS = "path string, part_name string, para_no int, run_no int, text string"
PROPERTIES = "path string, part_name string, para_no int, run_no int, math_run boolean, xml array<string>, drop array<string>"


@pytest.fixture
def tiny_batches(spark):
    """Two rows in a batch for Python, so that every package spans several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _parts(spark, n: int):
    rows = [(f"d{k}", at, name, bytearray(data.encode()), "ok") for k in range(n) for at, (name, data) in enumerate((("word/document.xml", BODY), ("docProps/app.xml", f"app {k}")))]
    return spark.createDataFrame(rows, "path string, part_no int, part_name string, part_bytes binary, status string").repartition(3)


def test_batches_hold_many_packages(monkeypatch):
    schema = pa.schema([("a", pa.int32())])
    monkeypatch.setattr(documents, "BATCH_ROWS", 100)
    monkeypatch.setattr(documents, "BATCH_BYTES", 1000)
    assert [b.num_rows for b in documents._batches((([(k,)], 1) for k in range(250)), schema)] == [100, 100, 50]
    assert [b.num_rows for b in documents._batches((([(k,)], 400) for k in range(7)), schema)] == [3, 3, 1]  # bytes end a batch too
    assert [b.num_rows for b in documents._batches([([(k,) for k in range(250)], 1), ([], 5)], schema)] == [100, 100, 50]


def test_assembly_streams_packages(spark, tiny_batches):
    parts = _parts(spark, 9)
    texts = spark.createDataFrame([(f"d{k}", "word/document.xml", 0, r, x) for k in range(8) for r, x in ((0, f"T{k}"), (1, None))] + [("none", "word/document.xml", 0, 0, "x")], TEXTS)
    more = spark.createDataFrame([(f"d{k}", "word/document.xml", 1, 0, False, [f"<w:i {SPACE}/>"], ["rStyle"]) for k in range(7)], PROPERTIES)
    made = documents.assemble_docx(parts, texts, properties=more)
    assert "MapInArrow" in _plan(made) and "FlatMapGroups" not in _plan(made)
    rows = {r["path"]: bytes(r["content"]) for r in made.collect()}
    assert sorted(rows) == [f"d{k}" for k in range(9)]
    for k in range(9):
        with zipfile.ZipFile(io.BytesIO(rows[f"d{k}"])) as z:
            assert z.namelist() == ["word/document.xml", "docProps/app.xml"] and z.read("docProps/app.xml") == f"app {k}".encode()
            want = BODY
            if k < 8:
                want = want.replace("<w:t>one</w:t>", f"<w:t>T{k}</w:t>").replace("<w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r>", "")
            if k < 7:
                want = want.replace("<w:r><w:t>three", "<w:r><w:rPr><w:i/></w:rPr><w:t>three")
            assert z.read("word/document.xml").decode() == want


def test_packages_are_opened_in_batches(spark, tiny_batches):
    made = documents.assemble_docx(_parts(spark, 5), spark.createDataFrame([], TEXTS)).unionByName(spark.createDataFrame([("bad", bytearray(b"no zip")), ("none", None)], "path string, content binary"))
    parts = documents.explode_docx_parts(made)
    assert "MapInArrow" in _plan(parts) and "MapInPandas" not in _plan(parts)
    got = {(r["path"], r["part_no"]): (r["part_name"], r["part_bytes"] and bytes(r["part_bytes"]), r["status"]) for r in parts.collect()}
    assert got == {(f"d{k}", 0): ("word/document.xml", BODY.encode(), "ok") for k in range(5)} | {(f"d{k}", 1): ("docProps/app.xml", f"app {k}".encode(), "ok") for k in range(5)} | {("bad", None): (None, b"no zip", "bad_package"), ("none", None): (None, None, "bad_package")}


def test_runs_come_in_batches(spark, tiny_batches):
    rows = [(f"d{k}", "word/document.xml", bytearray(BODY.encode() if k else b"<open>")) for k in range(5)] + [("none", "word/document.xml", None)]
    runs = documents.parse_docx_runs(spark.createDataFrame(rows, "path string, part_name string, part_bytes binary"))
    assert "MapInArrow" in _plan(runs) and "MapInPandas" not in _plan(runs)
    got = sorted((r["path"], r["para_no"], r["run_no"], r["text"], r["rpr"] == {"b": {}}, r["rstyle"]) for r in runs.collect())
    assert got == [(f"d{k}", *x, None) for k in range(1, 5) for x in ((0, 0, "one", False), (0, 1, "two", True), (1, 0, "three", False))]


def test_styles_come_in_batches(spark, tiny_batches):
    sheet = lambda k: f'<w:styles {SPACE}><w:style w:styleId="s{k}" w:type="paragraph"><w:name w:val="n"/><w:rPr><w:sz w:val="{k}"/><w:b/></w:rPr></w:style><w:style/></w:styles>'
    rows = [(f"d{k}", bytearray(sheet(k).encode() if k else b"<open>"), "replace_styles") for k in range(5)] + [("other", bytearray(b""), "copy")]
    found = documents.parse_docx_styles(spark.createDataFrame(rows, "path string, part_bytes binary, action string"))
    assert "MapInArrow" in _plan(found) and "MapInPandas" not in _plan(found)
    got = sorted((r["path"], r["style_id"], r["name"], r["style_type"], r["based_on"], r["direct_size"], r["rpr"], sorted(r["xml"])) for r in found.collect())
    assert got == [(f"d{k}", f"s{k}", "n", "paragraph", None, k, {"sz": {"val": str(k)}, "b": {}}, ["b", "sz"]) for k in range(1, 5)]


def test_segments_of_a_paragraph_in_one_row(spark):
    """What replies do to the segments of paragraphs, held against the operators that join them segment by segment."""
    runs = [(p, r, key, special, text) for p in range(3) for r, (key, special, text) in enumerate((("a", False, "one "), ("a", False, "two"), ("s", True, ""), ("b", False, "--"), ("c", False, "four")))] + [(9, 0, "a", False, "..")]
    table = spark.createDataFrame([("d", *x) for x in runs], "path string, para_no int, run_no int, style_key string, special boolean, text string")
    para = ["path", "para_no"]
    segments = styles.merge_adjacent_runs(table, para)
    listed = styles.segment_lists(segments, para)
    assert {r["para_no"]: r["text_for_model"] for r in listed.collect()} == {r["para_no"]: r["text_for_model"] for r in styles.build_model_text(segments, para).collect()}
    said = spark.createDataFrame([("d", 0, "ONE【SEG】<placeholder>【SEG】--【SEG】four"), ("d", 1, " 【SEG】x【SEG】y"), ("d", 2, "z")], "path string, para_no int, reply string")
    changes, stays = styles.segment_changes(F.col("segs"), F.col("reply"))
    got = {r["para_no"]: ([(list(x["runs"]), x["text"]) for x in r["changes"]], r["stays"]) for r in listed.join(said, para).select("para_no", changes.alias("changes"), stays.alias("stays")).collect()}
    assert got == {0: ([([0, 1], "ONE")], False), 1: ([([3], "y")], True), 2: ([([0, 1], "z")], True)}
    attached = styles.attach_segment_translations(segments, said, para).filter("not special")
    assert {(r["para_no"], r["first_run"], r["translated"]) for r in attached.filter("translated <> text").collect()} == {(p, x[0][0], x[1]) for p, (c, _) in got.items() for x in c}
