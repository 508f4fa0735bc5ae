"""Operators on small rows with results derived from their rules, and round trips."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.jobs import translate
from lectern.operators import graph, latex, markdown, memory, styles, texblocks, validate
from lectern.sources import documents


def one(spark, column, *values, names="x"):
    """Value of a column expression on one row."""
    row = {n: v for n, v in zip(names.split(), values)}
    schema = ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'array<boolean>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


def many(spark, column, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").orderBy("k").select(column).collect()]


def test_text_functions(spark):
    x = F.col("x")
    assert many(spark, T.strip(x), [" a\u3000", "\u0085b\t", "", None]) == ["a", "b", "", None]
    assert many(spark, T.is_meaningful(x), ["a", "第", "  ", "--", None]) == [True, True, False, False, False]
    assert many(spark, T.has_chinese(x), ["% 注释", "a % 注\n图", "plain", None]) == [False, True, False, False]
    assert many(spark, T.clean_reply(x), [' "`quoted`" ', None, "a'"]) == ["quoted", "", "a"]
    assert many(spark, T.newlines(x), ["a\r\nb\rc\n"]) == ["a\nb\nc\n"]
    assert many(spark, T.fix_keyword_spacing(x), ["Chapter\\ref x Table \\a"]) == ["Chapter \\ref x Table \\a"]
    assert many(spark, T.collapse_blank_lines(x), ["a\n\n\n\n\nb\n\n\nc"]) == ["a\n\n\nb\n\n\nc"]
    assert many(spark, T.direction_of(x), ["Chinese", "English"]) == ["zh-to-en", "en-to-zh"]
    assert many(spark, T.needs_space_mark(x), [" a", "a", "a "]) == [True, False, True]
    article = "\\documentclass[a4]{article}\n\\begin{document}"
    assert many(spark, T.convert_document_class(x, "en-to-zh", "FONTS"), [article]) == ["\\documentclass[a4]{ctexart}\nFONTS\\begin{document}"]
    assert many(spark, T.convert_document_class(x, "zh-to-en", "FONTS"), [article]) == [article]
    assert many(spark, T.infer_alignment(F.lit(None).cast("string"), x), ["left", "centerGroup", "odd", None]) == ["left", "center", "center", None]
    assert one(spark, T.split_by_placeholder(F.col("r"), F.col("s")), "a<placeholder>b<placeholder>c", [True, False, True], names="r s") == ["a", "<placeholder>", "bc"]
    assert one(spark, T.split_by_placeholder(F.col("r"), F.col("s")), "a", [True, True], names="r s") == ["a", ""]


RULES = [("", "blank"), ("\u3000", "blank"), ("```py", "fence"), ("    x", "indented"), ("\tx", "indented"), ("</div>", "tag"), ("<a>b", None), ("|---|---|", "table_rule"), ("---", "frontmatter_mark"), ("key: v", "key_value"), ("key: a | b", None), ("# head", None), ("| a: b |", None)]


def test_markdown_rules(spark):
    assert many(spark, markdown.rule(F.col("x")), [r[0] for r in RULES]) == [r[1] for r in RULES]


def test_fences_and_translations(spark):
    body = "a\n```\na\n  a\n```\n  a\n    a\nb"
    docs = spark.createDataFrame([(1, "---\nt: x\n---\n" + body), (2, "plain  \n"), (3, "")], "doc_id int, text string")
    split = markdown.split_frontmatter(docs)
    assert [r["front"] for r in split.orderBy("doc_id").collect()] == ["---\nt: x\n---\n", "", ""]
    table = markdown.classify(markdown.lines(split))
    translations = spark.createDataFrame([("a", "A"), ("plain", "P")], "text string, translated string")
    out = {r["doc_id"]: r["text"] for r in markdown.reassemble(markdown.apply_translations(table, translations)).collect()}
    assert out == {1: "A\n```\na\n  a\n```\n  A\n    A\nb", 2: "P\n", 3: ""}  # an indented line equal to a translated one is replaced


def test_memory(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"k1": {"text": "one", "timestamp": "2024-01-01T00:00:00"}, "k2": "two", "k3": "' + "x" * 50000 + '", "k5": "{x} y", "k6": "{\\"text\\": 1}", "k7": 5, "k8": {"timestamp": "t"}}')
    (tmp_path / "bad.json").write_text("no json")
    held = memory.from_json_maps(spark, str(tmp_path / "*.json"), "2024-02-01")
    assert {(r["cache_key"], r["text"], r["ts_raw"]) for r in held.collect()} == {("k1", "one", "2024-01-01T00:00:00"), ("k2", "two", "2024-02-01"), ("k5", "{x} y", "2024-02-01"), ("k6", '{"text": 1}', "2024-02-01"), ("k8", "", "t")}
    held = held.filter("cache_key in ('k1', 'k2')")
    fresh = spark.createDataFrame([("k1", "s", "new", "2024-03-01"), ("k4", "s" * 20001, "long", "2024-03-01")], "cache_key string, source string, text string, ts_raw string")
    merged = {r["cache_key"]: r["text"] for r in memory.merge(held, fresh).collect()}
    assert merged == {"k1": "new", "k2": "two"}
    assert {r["cache_key"] for r in memory.expire(held, "2024-02-15", 30).collect()} == {"k2"}
    assert [r["cache_key"] for r in memory.evict(held, 1).collect()] == ["k2"]
    empty = held.limit(0)
    assert memory.stats(memory.lookup(empty.select("cache_key"), held)).first()["hit_rate"] == 0.0
    assert memory.age_distribution(empty, "2024-01-01").count() == 0
    assert documents.write_memory(held, str(tmp_path / "v"), "1").endswith("version=1")


def test_replies(spark):
    refusal = "Sorry, I cannot do that." + " " * 25
    assert len(refusal) == 49
    assert many(spark, validate.is_refusal(F.col("x")), [refusal, refusal + " ", "fine", None, "对不起"]) == [True, False, False, False, True]
    tests = [("--", "x", "passthrough"), ("a", None, "error"), ("a", ' "` ', "empty"), ("a", " " * 60 + "sorry", "refusal"), ("a", "Here you are: You are a professional translation engine and so on", "echo"), ("a", "I can't", "refusal"), ("a", "CRITICAL RULES of this very long prompt that was echoed back", "echo"), ("a <placeholder>", "b", "mismatch"), ("a", "abc", "short"), ("a", "a long enough reply", "ok")]
    rows = spark.createDataFrame([(k, s, r) for k, (s, r, _) in enumerate(tests)], "k int, s string, r string").orderBy("k")
    assert [r[0] for r in rows.select(validate.status(F.col("s"), F.col("r"), least=10)).collect()] == [t[2] for t in tests]
    replies = [(1, 0, "src", "CRITICAL RULES are repeated in this long reply of the model"), (1, 1, "src", '"good"'), (2, 0, "src", "sorry"), (2, 1, "src", "good"), (3, 0, "src", None), (3, 1, "src", None), (4, 3, "src", "late"), (5, 0, "src", "  "), (5, 1, "src", "second"), (6, 0, "src", "")]
    got = {r["unit_id"]: (r["attempt"], r["status"], r["final_text"]) for r in validate.first_valid_attempt(spark.createDataFrame(replies, "unit_id int, attempt int, src string, reply string")).collect()}
    assert got == {1: (1, "ok", "good"), 2: (None, "refusal", "src"), 3: (None, "error", "src"), 5: (1, "ok", "second"), 6: (None, "empty", "src")}
    bodies = [(200, '{"choices": [{"message": {"content": " hi "}, "finish_reason": "length"}], "usage": {"total_tokens": 5}}'), (500, ""), (200, '{"error": {"m": 1}}'), (200, '{"choices": []}'), (200, "no json")]
    parsed = validate.parse_responses(spark.createDataFrame([(k, 0, c, b) for k, (c, b) in enumerate(bodies)], "unit_id int, attempt int, status_code int, body string")).orderBy("unit_id").collect()
    assert [(r["outcome"], r["reply"], r["truncated"], r["total_tokens"]) for r in parsed] == [("ok", "hi", True, 5), ("http_error", None, False, None), ("api_error", None, False, None), ("no_choices", None, False, None), ("no_choices", None, False, None)]


# -- LaTeX


def test_placeholder_numbers(spark):
    """One counter from 1 over all patterns, the last match of a pattern first; later spans may hold earlier placeholders."""
    text = "\\ref{a} \\cite[p]{b} \\ref{c} \\newcommand{\\x}{\\ref{d}} \\label{e}"
    docs = spark.createDataFrame([(1, text, "kept", "clash"), (2, "plain", "k", "c"), (3, None, "k", "c"), (4, "<REF_1> \\ref{z} <REF_9> <X_0>", "k", "c")], "doc_id int, text string, t string, m string")
    rows = {r["doc_id"]: r for r in latex.protect(docs).withColumn("back", latex.restore(F.col("text"), F.col("placeholders"))).collect()}
    assert rows[1]["text"] == "<REF_4> <CITE_1> <REF_3> <NEWCOMMAND_6> <LABEL_5>"
    assert [tuple(p) for p in rows[1]["placeholders"]] == [
        ("<CITE_1>", "\\cite[p]{b}"), ("<REF_2>", "\\ref{d}"), ("<REF_3>", "\\ref{c}"), ("<REF_4>", "\\ref{a}"), ("<LABEL_5>", "\\label{e}"), ("<NEWCOMMAND_6>", "\\newcommand{\\x}{<REF_2>}"),
    ]
    assert (rows[1]["back"], rows[1]["t"], rows[1]["m"]) == (text, "kept", "clash")
    assert (rows[2]["text"], list(rows[2]["placeholders"]), rows[2]["back"], rows[3]["text"], rows[3]["back"]) == ("plain", [], "plain", None, None)
    assert rows[4]["text"] == "<REF_1> <REF_1> <REF_9> <X_0>"  # what looks like a placeholder and is none stays, unless it names one


TEX = st.lists(st.sampled_from(["\\cite[p]{a}", "\\ref{x}", "text. ", "More text! ", "\n\n", "\n", "\\newcommand{\\y}{\\ref{z}}", "\\documentclass[a]{b}", "é第", " ", "{}", "\\label{q}", "word "]), max_size=25).map("".join)


@settings(max_examples=12, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(TEX, min_size=5, max_size=25))
def test_latex_properties(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    safe = graph.written(latex.protect(docs))
    packed = latex.pack_chunks(safe, 30).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text")))["text"].alias("chunks"))
    rows = safe.withColumn("back", latex.restore(F.col("text"), F.col("placeholders"))).join(packed, "doc_id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, names = texts[r["doc_id"]], [p["placeholder"] for p in r["placeholders"]]
        assert r["back"] == text
        assert [int(re.search(r"\d+", n)[0]) for n in names] == list(range(1, len(names) + 1))
        assert not any(x in r["text"] for x in ("\\cite", "\\ref", "\\label", "\\documentclass[a]{b}"))
        # chunks: all words in order; short but for single sentences
        chunks, words = r["chunks"], r["text"].split()
        assert " ".join(chunks).split() == words and (words or chunks == [""])
        assert all(len(c) < 32 or not re.search(r"[.!?]\s|\n\n", c) for c in chunks)


def test_style_protection_and_typed_lines(spark):
    docs = spark.createDataFrame([(1, "\\setlength{\\p}{2pt} [opt] 3.5cm")], "doc_id int, text string")
    row = latex.protect(docs, patterns=latex.STYLE_PATTERNS).withColumn("back", latex.restore(F.col("text"), F.col("placeholders"))).first()
    assert row["back"] == "\\setlength{\\p}{2pt} [opt] 3.5cm" and "<OPTION_" in row["text"] and "<LENGTH_" in row["text"]
    typed = one(spark, latex.parse_typed_lines(F.col("x")), "[comment] a b \nnoise\n[chinese_string] c")
    assert [tuple(t) for t in typed] == [("comment", "a b"), ("chinese_string", "c")]


CLS = "% head\n\\def\\a{x}\n\n% 注\n\\def\\b{第}\n\\newcommand{\\c}{\n  图~}\n\\newtheorem{t}{定理}\n\\setlength{\\p}{\n2pt}\n  \\foo\nplain\n"


def test_tex_blocks(spark):
    docs = spark.createDataFrame([(1, CLS), (2, None), (3, "")], "doc_id int, text string")
    blocks = texblocks.extract_tex_blocks(docs)
    got = [(r["start_line"], r["end_line"], r["block_type"]) for r in blocks.orderBy("start_line").collect()]
    assert got == [(1, 4, "def_block"), (5, 6, "command_definition"), (7, 7, "theorem_definition"), (8, 9, "format_command"), (10, 10, "single_command"), (11, 11, "text")]
    chinese = texblocks.filter_chinese_blocks(blocks)
    assert {r["start_line"] for r in chinese.collect()} == {1, 5, 7}
    groups = texblocks.pack_blocks(chinese, 60).orderBy("group_no").collect()
    assert [list(r["starts"]) for r in groups] == [[1], [5, 7]]
    lines = markdown.lines(docs.filter("doc_id = 1"), text_col="text")
    translated = blocks.select("doc_id", "start_line", "end_line", F.concat(F.lit("T:"), "content").alias("text")).filter("start_line = 5")
    out = markdown.reassemble(texblocks.rebuild_from_blocks(lines, translated)).first()["text"]
    assert out == CLS.replace("\\newcommand", "T:\\newcommand")


# -- files and styles


def test_files(spark):
    files = spark.createDataFrame([("d/m.tex", "\\input{ a } \\input{fig.v2} \\include{b.tex} \\usepackage[x]{p, q}\\documentclass{k}\\input{/z/r.sty}")], "path string, content string")
    listing = spark.createDataFrame([("d/a.tex",), ("d/p.sty",)], "path string")
    got = {(r["dst"], r["found"]) for r in graph.resolve_refs(graph.file_refs(files), listing).collect()}
    assert got == {("d/a.tex", True), ("d/fig.v2.tex", False), ("d/b.tex", False), ("/z/r.sty.tex", False)}
    got = {(r["kind"], r["dst"], r["found"]) for r in graph.resolve_refs(graph.style_refs(files), listing, "").collect()}
    assert got == {("package", "d/p.sty", True), ("package", "d/q.sty", False), ("class", "d/k.cls", False), ("input", "/z/r.sty", False)}
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 9), (3, 4)], "src int, dst int")
    assert {(r["node"], r["depth"]) for r in graph.closure(nodes.filter("node = 0"), edges, nodes).collect()} == {(0, 0), (1, 1), (2, 2)}
    both = graph.union_distinct_files(spark.createDataFrame([("m", 0)], "path string, pos int"), spark.createDataFrame([("a", 1), ("m", 2)], "path string, pos int"))
    assert {(r["path"], r["pos"]) for r in both.collect()} == {("m", 0), ("a", 1)}


def test_styles(spark):
    p = lambda **k: {t: {"val": v} for t, v in k.items()}
    rows = [("x", "base", None, p(sz="20", b="1")), ("x", "kid", "base", p(sz="30")), ("x", "loop", "loop", p(i="1")), ("x", "lost", "gone", None)]
    frame = spark.createDataFrame(rows, "path string, style_id string, based_on string, rpr map<string,map<string,string>>")
    chains = {r["style_id"]: r["chain"] for r in styles.style_listing(frame).collect()}
    assert chains == {"base": ["base"], "kid": ["kid", "base"], "loop": ["loop", "loop"], "lost": ["lost", "gone"]}
    resolved = {r["style_id"]: r["rpr"] for r in styles.resolve_styles(frame).collect()}
    assert resolved["kid"] == p(sz="30", b="1") and resolved["lost"] == {}
    runs = [("x", "part", "t", "base", "kid", p(u="2"), False), ("x", "part", " ", "base", "kid", None, False), ("x", "part", "m", "base", None, None, True)]
    done = styles.materialize_run_styles(spark.createDataFrame(runs, "path string, part_name string, text string, pstyle string, rstyle string, rpr map<string,map<string,string>>, math boolean"), styles.resolve_styles(frame))
    got = {r["text"]: (r["rpr"], r["rstyle"]) for r in done.collect()}
    assert got == {"t": (p(sz="30", b="1", u="2"), None), " ": (None, "kid"), "m": ({}, None)}
    report = styles.materialize_report(done).first()
    assert (report["found"], report["processed"], report["linked"], report["bold"]) == (3, 2, 1, 1)
    fonts = one(spark, styles.set_run_fonts(F.create_map().cast(styles.PROPS), "A", "B"), "x")
    assert fonts == {"rFonts": {"ascii": "A", "hAnsi": "A", "eastAsia": "B"}}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="kid"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Hello </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>world</w:t></w:r>
<w:bookmarkStart/><w:r><w:drawing/></w:r><w:hyperlink><w:r><w:t>li</w:t></w:r><w:r><w:t>nk</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="kid"><w:name w:val="Kid"/><w:basedOn w:val="base"/><w:rPr><w:sz w:val="24"/></w:rPr></w:style><w:style/></w:styles>'


def test_chunk_packing(spark):
    """Paragraphs stay together while they fit below the limit with the joiner; long ones are cut into sentences."""
    texts = ["aaa\n\nbbb", "a" * 14 + "\n\n" + "b" * 13, "a" * 14 + "\n\n" + "b" * 14, "One. " * 9, "a\n\n" + "Long one here. " * 3 + "\n\nz", "x" * 50, "", " \n \n "]
    want = [["aaa\n\nbbb"], ["a" * 14 + "\n\n" + "b" * 13], ["a" * 14, "b" * 14], ["One. One. One. One. One. One.", "One. One. One."], ["a", "Long one here. Long one here.", "Long one here.\n\nz"], ["x" * 50], [""], [""]]
    got: dict = {}
    for r in latex.pack_chunks(spark.createDataFrame(list(enumerate(texts)), "k int, x string"), 30, "k", "x").orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert list(got.values()) == want


@pytest.fixture
def packages(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("word/document.xml", DOCUMENT), ("word/styles.xml", STYLES), ("word/fontTable.xml", "<f/>"), ("word/bad.xml", "<open>"), ("other.bin", "x")):
            z.writestr(name, data)
    return spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"no zip"))], "path string, content binary")


def test_word_packages(spark, packages):
    parts = documents.explode_docx_parts(packages)
    assert {(r["part_name"], r["action"], r["status"]) for r in parts.collect()} == {
        ("word/document.xml", "process", "ok"), ("word/styles.xml", "replace_styles", "ok"), ("word/fontTable.xml", "replace_font_table", "ok"), ("word/bad.xml", "process", "ok"), ("other.bin", "copy", "ok"), (None, None, "bad_package"),
    }
    runs = documents.parse_docx_runs(parts.filter("action = 'process'"))
    got = [(r["para_no"], r["run_no"], r["kind"], r["text"], r["special"]) for r in runs.orderBy("para_no", "run_no").collect()]
    assert got == [(0, 0, "run", "Hello ", False), (0, 1, "run", "world", False), (0, 2, "run", "", True), (0, 3, "hyperlink", "li", False), (0, 4, "hyperlink", "nk", False), (1, 0, "run", "cell", False)]
    style = documents.parse_docx_styles(parts).collect()
    assert [(s["style_id"], s["based_on"], s["direct_size"]) for s in style] == [("kid", "base", 24)]
    keyed = runs.withColumn("style_key", styles.run_key())
    segments = styles.merge_adjacent_runs(keyed, ["path", "part_name", "para_no"])
    model = {r["para_no"]: r["text_for_model"] for r in styles.build_model_text(segments, ["path", "part_name", "para_no"]).collect()}
    assert model == {0: "Hello world【SEG】<placeholder>【SEG】link", 1: "cell"}
    texts = spark.createDataFrame([("a.docx", "word/document.xml", 1, 0, "Zelle ")], "path string, part_name string, para_no int, run_no int, text string")
    made = documents.assemble_docx(parts, texts).collect()
    assert len(made) == 1
    with zipfile.ZipFile(io.BytesIO(bytes(made[0]["content"]))) as z:
        assert z.namelist() == ["word/document.xml", "word/styles.xml", "word/fontTable.xml", "word/bad.xml", "other.bin"]
        assert "Zelle </" in z.read("word/document.xml").decode() and z.read("word/bad.xml") == b"<open>"


RICH = f"""<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<w:document {W} xmlns:w14="urn:fourteen" xmlns:mc="urn:mc" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" mc:Ignorable="w14"><w:body><w:p w14:id="1"><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">One </w:t></w:r><w:bookmarkStart w:id="0"/><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:tab/><w:t>three &amp; more</w:t></w:r><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath><w:hyperlink w:x="a&gt;b"><w:r><w:t>go</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t/><w:t> there</w:t></w:r></w:hyperlink><w:hyperlink><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p><w:p><w:r><w:pict><w:txbx><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbx></w:pict></w:r><w:r><w:t>after</w:t></w:r></w:p><w:p><w:r><w:t>--</w:t></w:r><w:r/></w:p></w:body></w:document>"""


def test_word_path(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("word/document.xml", RICH), ("word/glossary/document.xml", RICH.encode("utf-16") if False else RICH.replace("two", "TWO")), ("word/styles.xml", STYLES), ("word/fontTable.xml", "<f/>"), ("word/bad.xml", "<open>"), ("other.bin", b"\0\1")):
            z.writestr(name, data)
    packages = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"no zip"))], "path string, content binary")
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    same, kept, report = translate.translate_docx(packages, held, lambda x: x, "m", "d", "2024-01-01")
    rows = {r["path"]: r for r in same.collect()}
    assert (rows["b.docx"]["status"], bytes(rows["b.docx"]["content"])) == ("bad_package", b"no zip")
    with zipfile.ZipFile(io.BytesIO(bytes(rows["a.docx"]["content"]))) as z:
        assert z.read("word/document.xml").decode() == RICH and z.read("word/bad.xml") == b"<open>" and z.read("other.bin") == b"\0\1"
    assert report.first()["misses"] == 4 and kept.count() == 4

    def shout(texts):
        return texts.map(lambda t: T.SEGMENT.join(p if p == T.PLACEHOLDER else f"<{p}> " for p in t.split(T.SEGMENT)))

    made, _, _ = translate.translate_docx(packages, held, shout, "m", "d", "2024-01-01", font_table=b"<fonts/>", style_sheet=b"<styles/>")
    with zipfile.ZipFile(io.BytesIO(bytes(made.filter("status = 'ok'").first()["content"]))) as z:
        document = z.read("word/document.xml").decode()
        assert z.read("word/fontTable.xml") == b"<fonts/>" and z.read("word/styles.xml") == b"<styles/>" and "TWO" in z.read("word/glossary/document.xml").decode()
    want = RICH.replace('<w:t xml:space="preserve">One </w:t>', "<w:t>&lt;One &gt;</w:t>").replace("<w:t>two</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:tab/><w:t>three &amp; more</w:t></w:r>", '<w:t xml:space="preserve">&lt;twothree &amp; more&gt; </w:t></w:r>')
    want = want.replace("<w:t>go</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t/><w:t> there</w:t></w:r>", '<w:t xml:space="preserve">&lt;go there&gt; </w:t></w:r>').replace("<w:t>here</w:t>", "<w:t>&lt;here&gt;</w:t>")
    want = want.replace("<w:t>boxed</w:t>", "<w:t>&lt;boxed&gt;</w:t>").replace("<w:t>after</w:t>", "<w:t>&lt;after&gt;</w:t>")
    # the last part of a reply is stripped; one that was not last keeps its space
    want = want.replace("<w:t>&lt;One &gt;</w:t>", '<w:t xml:space="preserve">&lt;One &gt; </w:t>')
    assert document == want


def test_style_file_and_project_paths(spark):
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")

    def groups(texts):
        """Translates numbered blocks; drops the parting of one that holds `odd`, fails on `bad`."""
        def one(t):
            if "bad" in t:
                raise RuntimeError
            if not t.startswith("【块"):
                return "" if "empty" in t else t.replace("第", "No").strip()
            bodies = [re.sub("^【块\\d+】\\n", "", p) for p in t.split("\n\n【块")]
            bodies = [p.partition("\n")[2] if k else p for k, p in enumerate(bodies)]
            return ("" if "odd" in t else "---").join(p.replace("第", "Chapter").strip() for p in bodies)
        return texts.map(one)

    files = [("a", "\\def\\x{第\\y}\n% 注 kept\n\n\n\n\n\\newtheorem{t}{第}\nplain"), ("b", "\\def\\x{第 odd}\nplain 第\nempty 第"), ("c", "\\def\\x{第 bad}"), ("d", "nothing\n\n\n\n\nhere"), ("e", None), ("f", "")]
    out, report = translate.translate_style_files(spark.createDataFrame(files, "doc_id string, text string"), groups)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got["a"] == "\\def\\x{Chapter \\y}\n% 注 kept\n\n\n\\newtheorem{t}{Chapter}\nplain"
    assert got["b"] == "\\def\\x{No odd}\nplain No\nempty 第" and got["c"] == files[2][1] and got["d"] == files[3][1] and got["e"] is None and got["f"] == ""
    assert {r["doc_id"]: (r["blocks_found"], r["blocks_translated"]) for r in report.collect()} == {"a": (2, 2), "b": (3, 2), "c": (1, 0), "d": (0, 0), "e": (0, 0), "f": (0, 0)}

    listing = [("p/main.tex", "\\documentclass{article}\\documentclass{own}\\usepackage{deep}\n\n\\begin{document} Text of main. \\input{ch/one}"), ("p/ch/one.tex", "Text of one, \\input{two} here."), ("p/ch/two.tex", "Text of two, ends. \\include{/p/main}"), ("p/own.cls", "\\def\\x{第}"), ("p/deep.sty", None), ("p/pic.png", "bytes"), ("p/.git/x", "h"), ("p/main.log", "l"), ("p/alone.tex", "Not reached.")]
    frame = spark.createDataFrame(listing, "path string, text string")
    mains = spark.createDataFrame([("p/main.tex",), ("p/lost.tex",)], "path string")
    out, _, report = translate.translate_project(frame, mains, held, lambda x: x.str.replace("Text", "Satz").str.replace("第", "No"), "m", "en-to-zh", "2024-01-01", style_files=True, fonts="F")
    got = {r["path"]: (r["action"], r["text"]) for r in out.collect()}
    assert set(got) == {"p/main.tex", "p/ch/one.tex", "p/own.cls", "p/deep.sty", "p/pic.png", "p/alone.tex", "p/ch/two.tex"}
    assert got["p/main.tex"] == ("translate", "\\documentclass{ctexart}\\documentclass{own}\\usepackage{deep}\n\nF\\begin{document} Satz of main. \\input{ch/one}")
    assert got["p/ch/one.tex"] == ("translate", "Satz of one, \\input{two} here.") and got["p/own.cls"][0] == "translate" and got["p/pic.png"] == ("copy", "bytes") and got["p/alone.tex"][0] == "copy"
    assert [tuple(r) for r in report.select("project", "succeeded", "total", "ok").collect()] == [("p/main.tex", 4, 5, False)]


def test_attempts_and_failing_units(spark):
    """Failures stay with their unit, blank and echoing replies are asked for again, nothing is lost."""
    held = spark.createDataFrame([("k", "old", "2020-01-01")], "cache_key string, text string, ts_raw string")
    calls = spark.sparkContext.accumulator(0)

    def moody(texts):
        if len(texts) > 1 and any("poison" in t for t in texts):
            raise RuntimeError
        calls.add(len(texts))
        return texts.map(lambda t: None if "poison" in t else "" if "blank" in t else "Sorry, I cannot" if "refuse" in t else "CRITICAL RULES" if "echo" in t else f"T {t}")

    lines = ["fine one", "poison", "blank one", "refuse this", "echo this", "fine two", "--", "a <placeholder> b"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "fine one")], "doc_id int, text string")
    out, kept, report = translate.translate_markdown(docs, held, moody, "m", "d", "2024-01-01")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "\n".join(["T fine one", "poison", "blank one", "refuse this", "echo this", "T fine two", "--", "T a <placeholder> b"]), 2: None, 3: "", 4: "T fine one"}
    assert {r["text"] for r in kept.collect()} == {"T fine one", "T fine two", "T a <placeholder> b"}  # the expired entry has gone
    assert report.first()["misses"] == 8 and calls.value >= 3 * 3 + 4
    tex, _, report = translate.translate_latex(docs, held, moody, "m", "d", "2024-01-01")
    assert {r["doc_id"]: r["text"] for r in tex.collect()}[2] is None and report.count() == 4


def test_long_chains(spark):
    rows = [("x", f"s{k}", f"s{k + 1}" if k < 80 else None, {"sz": {"val": "9"}} if k == 80 else None) for k in range(81)]
    frame = spark.createDataFrame(rows, "path string, style_id string, based_on string, rpr map<string,map<string,string>>").filter("style_id in ('s0') or cast(substr(style_id, 2) as int) > 0").coalesce(1)
    deepest = styles.style_chain(frame).filter("style_id = 's0'").agg(F.max("depth")).first()[0]
    assert deepest == 80


def test_reading(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"a\r\nb\xffc\rd")
    assert documents.read_text_documents(spark, str(tmp_path / "a.md"), drop_bad_bytes=True).first()["text"] == "a\nbc\nd"
    (tmp_path / "b.md").write_bytes("é\r\n".encode())
    assert documents.read_text_documents(spark, str(tmp_path / "b.md")).first()["text"] == "é\n"
    known, others = graph.route_by_format(spark.createDataFrame([("x/A.TEX",), ("b.pdf",), ("noext",)], "path string"))
    assert [r["format"] for r in known.collect()] == ["tex"] and others.count() == 2


# -- whole paths


def test_paths(spark):
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    docs = spark.createDataFrame([(1, "# Head\n\n```\ncode\n```\n  text here\nkey: value"), (2, "# Head"), (3, "")], "doc_id int, text string")
    same, kept, report = translate.translate_markdown(docs, held, lambda x: x, "m", "d", "2024-01-01")
    assert {r["doc_id"]: r["text"] for r in same.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert report.first()["misses"] == 2 and kept.count() == 2

    def broken(_):
        raise RuntimeError("no calls expected")

    again, _, report = translate.translate_markdown(docs, kept, broken, "m", "d", "2024-01-02")
    assert report.first()["hit_rate"] == 100.0
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    failed, kept, _ = translate.translate_markdown(docs, held, broken, "m", "d", "2024-01-02")
    assert kept.count() == 0 and {r["doc_id"]: r["text"] for r in failed.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    tex = spark.createDataFrame([(1, "See \\cite{a} in the text.\n\nAnd \\newcommand{\\x}{\\ref{b}} more text"), (2, "")], "doc_id int, text string")
    out, _, report = translate.translate_latex(tex, held, lambda x: x, "m", "d", "2024-01-01")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in tex.collect()}
    assert {r["doc_id"]: (r["chunks"], r["placeholders"], list(r["failed"])) for r in report.collect()} == {1: (1, 3, []), 2: (1, 0, [])}
