"""Request logs, memory stores, styles written into packages, replies by number, placeholders by chunk, packing of long texts."""

from __future__ import annotations

import io
import json
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.jobs import translate
from lectern.jobs.requests import RequestLog
from lectern.operators import graph, latex, markdown, memory, styles, texblocks
from lectern.operators.hot import join_texts
from lectern.sources import documents, versions
from lectern.sources.memory_store import MemoryStore

HELD = "cache_key string, text string, ts_raw string"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def body(text: str, finish: str = "stop") -> str:
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": finish}], "usage": {"total_tokens": len(text)}})


@pytest.mark.parametrize("order", ["once", "late and twice", "one by one, backwards"])
def test_deliveries_in_any_order_end_in_the_same_documents(spark, tmp_path, order):
    log = RequestLog(spark, str(tmp_path / "log"), "m", "Translate.", kind="latex")
    docs = spark.createDataFrame([(1, "first line\nsecond line\n--"), (2, "third line\nlost line\nfirst line"), (3, None)], "doc_id int, text string")
    held = spark.createDataFrame([], HELD)
    key = {t: spark.range(1).select(T.cache_key(F.lit(t), "m", "d")).first()[0] for t in ("first line", "second line", "third line", "lost line")}
    answers = [(key["first line"], 0, 500, None), (key["first line"], 1, 200, body("Erste")), (key["second line"], 0, 200, body("Zwei", "length")), (key["second line"], 1, 200, '{"choices": []}'), (key["second line"], 2, 200, body("Zweite")),
               (key["third line"], 0, 200, '{"error": {"message": "quota"}}'), (key["third line"], 1, 200, body("CRITICAL RULES")), (key["third line"], 2, 200, "no json"), ("nobody", 0, 200, body("x")), (key["first line"], 7, 200, body("too late"))]
    schema = "unit_id string, attempt int, status_code int, body string"
    rounds = {"once": [answers], "late and twice": [answers[5:], answers[:5] + answers[5:7], answers], "one by one, backwards": [[a] for a in reversed(answers)]}[order]
    out, _, _ = translate.translate_markdown(docs, held, log, "m", "d", "2024-01-01")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {(r["unit_id"], r["attempt"]) for r in log.open_requests().collect()} == {(k, 0) for k in key.values()}
    for part in rounds:
        log.deliver(spark.createDataFrame(part, schema))
        out, kept, _ = translate.translate_markdown(docs, held, log, "m", "d", "2024-01-01")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Erste\nZweite\n--", 2: "third line\nlost line\nErste", 3: None}
    assert {r["text"] for r in kept.collect()} == {"Erste", "Zweite"}
    assert {(r["unit_id"], r["attempt"]) for r in log.open_requests().collect()} == {(key["lost line"], 0)}
    asked = log.requests().collect()
    assert len(asked) == len({(r["unit_id"], r["attempt"]) for r in asked})  # nothing is asked for twice
    if order == "late and twice":
        limits = {r["attempt"]: json.loads(r["request"])["max_tokens"] for r in asked if r["unit_id"] == key["second line"]}
        assert all(limits[a] in (22, 44) for a in limits)


def test_truncation_doubles_the_limit(spark, tmp_path):
    log = RequestLog(spark, str(tmp_path / "log"), "m", "Translate.", kind="latex")
    units = spark.createDataFrame([("k", "some text")], "cache_key string, text string")
    none = spark.createDataFrame([], "cache_key string, attempt int, status string")
    first = log.ask(units, none, 3).collect()
    assert json.loads(first[0]["request"])["max_tokens"] == 18 and log.ask(units, none, 3).count() == 0
    log.deliver(spark.createDataFrame([("k", 0, 200, body("so", "length"))], "unit_id string, attempt int, status_code int, body string"))
    tried = log.replies(units, 3)
    assert [(r["reply"], r["failure"]) for r in tried.collect()] == [(None, "truncated")]
    second = log.ask(units, tried.withColumn("status", F.col("failure")), 3).collect()
    assert [(r["attempt"], json.loads(r["request"])["max_tokens"]) for r in second] == [(1, 36)]


def test_style_files_from_a_log(spark, tmp_path):
    log = RequestLog(spark, str(tmp_path / "log"), "m", "Translate.", kind="group")
    files = spark.createDataFrame([("a", "\\def\\x{第}\nplain\n\\newtheorem{t}{定}")], "doc_id string, text string")
    out, report = translate.translate_style_files(files, log)
    assert out.first()["text"] == files.first()["text"] and report.first()["blocks_translated"] == 0
    for _ in range(5):
        replies = [(r["unit_id"], r["attempt"], 200, body("【块2】\n\\newtheorem{t}{Def}" if "【块" in json.loads(r["request"])["messages"][1]["content"] else "\\def\\x{Ch}")) for r in log.open_requests().collect()]
        if replies:
            log.deliver(spark.createDataFrame(replies, "unit_id string, attempt int, status_code int, body string"))
        out, report = translate.translate_style_files(files, log)
    assert out.first()["text"] == "\\def\\x{Ch}\nplain\n\\newtheorem{t}{Def}" and report.first()["blocks_translated"] == 2


# -- memory


def test_a_store_is_looked_up_in_place(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"), deltas=2)
    units = spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [(None, -1)], "cache_key string, n int")
    assert store.lookup(units).filter("stored is not null").count() == 0 and store.whole().count() == 0
    store.replace(spark.createDataFrame([(f"k{i}", f"old{i}", "2024-01-01") for i in range(20)] + [("k0", "older", "2020-01-01"), (None, "x", None)], HELD))
    want = {f"k{i}": f"old{i}" for i in range(20)}
    for n in range(5):  # merged every few parts
        fresh = [(f"k{i}", "s", "" if i == 3 else f"new{n}-{i}", "bad" if i == 4 else "2024-02-01") for i in range(n, n + 8)] + [("long", "s" * 20_001, "t", "2024-02-01")]
        store.append(spark.createDataFrame(fresh, "cache_key string, source string, text string, ts_raw string"))
        want |= {k: t or None for k, _, t, _ in fresh[:-1]}
        spark.createDataFrame([("k1", "broken", "2030-01-01")], HELD).write.parquet(versions.path_of(store.folder, f"broken{n}"))
        assert {r["cache_key"]: r["stored"] for r in store.lookup(units).collect() if r["cache_key"]} == {f"k{i}": want.get(f"k{i}") for i in range(40)}
        assert len(store.tables()) <= 3
    assert {r["cache_key"]: r["text"] or None for r in store.whole().collect()} == want
    live = {r["cache_key"] for r in store.lookup(units, "2024-02-15", 30).collect() if r["stored"]}
    assert live == {k for k, t in want.items() if t and t.startswith("new")}
    again = MemoryStore(spark, store.folder)
    assert again.whole().count() == len(want)
    store.merge("2024-02-15", 30)
    assert len(store.tables()) == 1 and {r["cache_key"] for r in store.whole().collect()} == {k for k, t in want.items() if not t or t.startswith("new")}


def test_lookups_deal_out_the_units_alone(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    store.replace(spark.createDataFrame([(f"k{i}", f"t{i}", "2024-01-01") for i in range(50)], HELD))
    store.append(spark.createDataFrame([("k1", "s", "n", "2024-01-02")], "cache_key string, source string, text string, ts_raw string"))
    units = spark.createDataFrame([(f"k{i}",) for i in range(60)], "cache_key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.lookup(units)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1, plan


def test_paths_with_a_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    docs = spark.createDataFrame([(1, "one line\ntwo lines")], "doc_id int, text string")
    out, kept, report = translate.translate_markdown(docs, store, lambda t: "T " + t, "m", "d", "2024-01-01")
    assert out.first()["text"] == "T one line\nT two lines" and kept is store and report.first()["misses"] == 2 and report.first()["entries"] == 0

    def never(_):
        raise RuntimeError

    out, _, report = translate.translate_markdown(docs, store, never, "m", "d", "2024-01-20")
    assert out.first()["text"] == "T one line\nT two lines" and report.first()["hit_rate"] == 100.0 and report.first()["entries"] == 2
    out, _, _ = translate.translate_markdown(docs, store, never, "m", "d", "2024-06-01")
    assert out.first()["text"] == "one line\ntwo lines"  # expired


def test_paths_keep_a_large_memory(spark):
    held = spark.range(12_000).selectExpr("cast(id as string) cache_key", "'t' text", "'2024-01-01' ts_raw")
    _, kept, report = translate.translate_with_memory(spark.createDataFrame([("a word",)], "text string"), held, lambda t: t, "m", "d", "2024-01-02")
    assert kept.count() == 12_001 and report.first()["entries"] == 12_000


def test_evict_is_exact(spark):
    rows = [(f"k{i:04}", "t", f"2024-01-{1 + i % 3:02}" if i % 7 else None) for i in range(500)]
    held = spark.createDataFrame(rows, HELD).repartition(7)
    ordered = [k for k, _, _ in sorted(rows, key=lambda r: ([-ord(c) for c in r[2] or ""] + [0] * (10 - len(r[2] or "")), r[0]))]
    for most in (0, 1, 143, 144, 400, 499, 500, 900):
        assert {r["cache_key"] for r in memory.evict(held, most).collect()} == set(ordered[:most]), most
    assert memory.evict(held.limit(0), 5).count() == 0


def test_newest_whole_version(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert documents.read_memory(spark, folder).count() == 0
    for name, text in (("b", "old"), ("a", "new")):
        documents.write_memory(spark.createDataFrame([("k", text, "t")], HELD), folder, name)
    spark.createDataFrame([("k", "half", "t")], HELD).write.parquet(f"{folder}/version=c")
    assert documents.read_memory(spark, folder).first()["text"] == "new"


# -- Word


def package(parts: dict) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def part_of(frame, name: str = "word/document.xml") -> str:
    with zipfile.ZipFile(io.BytesIO(bytes(frame.first()["content"]))) as z:
        return z.read(name).decode()


SHEET = f"""<w:styles {W} xmlns:w14="urn:fourteen"><w:style w:styleId="base" w:type="paragraph"><w:rPr><w:rFonts w:ascii="A &amp; B"/><w:sz w:val="20"/></w:rPr></w:style><w:style w:styleId="kid" w:type="paragraph"><w:basedOn w:val="base"/><w:rPr><w:sz w:val="24"/></w:rPr></w:style>
<w:style w:styleId="strong" w:type="character"><w:rPr><w:b/><w14:glow w14:rad="1"><w14:in/></w14:glow></w:rPr></w:style></w:styles>"""


def test_styles_are_written_into_runs(spark):
    given = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="kid"/></w:pPr><w:r><w:t>plain</w:t></w:r><w:r ><w:rPr><w:rStyle w:val="strong"/><w:sz w:val="9"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:rStyle w:val="strong"/></w:rPr><w:t>--</w:t></w:r>
<m:oMath><m:r><m:rPr><m:sty/></m:rPr><w:rPr><w:rStyle w:val="strong"/></w:rPr><m:t>x</m:t></m:r><m:r><m:t>y</m:t></m:r></m:oMath><w:r><w:rPr><w:rStyle w:val="strong"/></w:rPr><w:drawing/><w:t>with</w:t></w:r></w:p><w:p><w:r><w:rPr><w:rStyle w:val="none"/></w:rPr><w:t>lost</w:t></w:r><w:r><w:t>own</w:t></w:r></w:p></w:body></w:document>"""
    packages = spark.createDataFrame([("a", package({"word/document.xml": given, "word/styles.xml": SHEET}))], "path string, content binary")
    held = spark.createDataFrame([], HELD)
    para, glow = '<w:rFonts w:ascii="A &amp; B"/><w:sz w:val="24"/>', '<ns0:glow xmlns:ns0="urn:fourteen" ns0:rad="1"><ns0:in /></ns0:glow>'
    out, _, _ = translate.translate_docx(packages, held, lambda x: x, "m", "d", "2024-01-01", style_sheet=b"<new/>")
    got = re.sub(r" />", "/>", part_of(out)).replace(" xmlns:w14", " xmlns:ns0").replace("w14:", "ns0:")
    fonts = '<w:rFonts w:ascii="A &amp; B"/>'
    glow = glow.replace(" />", "/>")
    want = given.replace("<w:r><w:t>plain", f"<w:r><w:rPr>{para}</w:rPr><w:t>plain").replace('<w:rPr><w:rStyle w:val="strong"/><w:sz w:val="9"/></w:rPr>', f'<w:rPr>{fonts}<w:b/>{glow}<w:sz w:val="9"/></w:rPr>')
    want = want.replace('<w:rPr><w:rStyle w:val="strong"/></w:rPr><m:t>x', f"<w:rPr><w:b/>{glow}</w:rPr><m:t>x").replace('<w:rPr><w:rStyle w:val="strong"/></w:rPr><w:drawing/>', f'<w:rPr>{fonts}<w:b/><w:sz w:val="24"/>{glow}</w:rPr><w:drawing/>').replace('<w:rPr><w:rStyle w:val="none"/></w:rPr>', "<w:rPr></w:rPr>")
    order = lambda x: re.sub("<w:rPr>(.*?)</w:rPr>", lambda m: "<w:rPr>" + "".join(sorted(re.findall(r"<ns0:glow.*?</ns0:glow>|<w:[^>]*/>", m[1]))) + "</w:rPr>", x)
    assert order(got) == order(want) and part_of(out, "word/styles.xml") == "<new/>"
    same, _, _ = translate.translate_docx(packages, held, lambda x: x, "m", "d", "2024-01-01")
    assert part_of(same) == given
    forced, _, _ = translate.translate_docx(packages, held, lambda x: x, "m", "d", "2024-01-01", materialize=True, fonts=("L&N", "S"), languages=("en-US", "zh-CN"))
    assert part_of(forced).count('<w:rFonts w:ascii="L&amp;N" w:hAnsi="L&amp;N" w:eastAsia="S" w:hint="eastAsia"/>') == 7 and 'w:ascii="A' not in part_of(forced) and part_of(forced).count('<w:lang w:val="en-US" w:eastAsia="zh-CN"/>') == 7


def test_runs_of_other_styles_are_no_segment(spark):
    given = f'<w:document {W}><w:body><w:p><w:r><w:rPr><w:rStyle w:val="one"/></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:rStyle w:val="two"/></w:rPr><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    parts = documents.explode_docx_parts(spark.createDataFrame([("a", package({"word/document.xml": given}))], "path string, content binary"))
    keyed = documents.parse_docx_runs(parts).withColumn("style_key", styles.run_key())
    assert styles.merge_adjacent_runs(keyed, ["path", "part_name", "para_no"]).count() == 2


def test_blank_parts_of_a_reply_keep_the_source(spark):
    runs = "".join(f"<w:r><w:rPr><w:{x}/></w:rPr><w:t>{t}</w:t></w:r>" for x, t in (("b", "First words"), ("i", "Second words")))
    packages = spark.createDataFrame([(n, package({"word/document.xml": f"<w:document {W}><w:body><w:p>{runs}</w:p></w:body></w:document>"})) for n in "a"], "path string, content binary")
    held = spark.createDataFrame([], HELD)
    for reply, want, status in ((f"ALL OF IT{T.SEGMENT}", "<w:t>Second words</w:t>", "partial"), (f"ALL OF IT{T.SEGMENT} ", "<w:t>Second words</w:t>", "partial"), (f"ONE{T.SEGMENT}TWO", "<w:t>TWO</w:t>", "ok"), (f"A{T.SEGMENT}B{T.SEGMENT}C", "<w:t>First words</w:t>", "partial"), (None, "<w:t>First words</w:t>", "partial")):
        out, _, _ = translate.translate_docx(packages, held, lambda t: t.map(lambda _: reply), "m", "d", "2024-01-01")  # noqa: B023
        assert out.first()["status"] == status and want in part_of(out)


# -- LaTeX


def test_replies_by_number(spark):
    cases = [("【块1】\nA---B\n\n【块2】\nC", ["A---B", "C"]), ("【块2】\nC\n---\n【块 1】A", ["A", "C"]), ("【块1】\n\n【块1】x【块1】y", ["x", None]), ("【块3】z【块x】", [None, None]), ("no marks", [None, None]), ("", [None, None]), ("talk 【块2】\nC\n---", [None, "C"])]
    frame = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(cases)], "k int, r string")
    got = {r["k"]: list(r["p"]) for r in frame.select("k", T.numbered_parts(F.col("r"), F.lit(2)).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_blocks_with_dashes_and_missing_numbers(spark):
    asked = spark.sparkContext.accumulator(0)

    def reply(texts):
        def one(t):
            if "【块" not in t:
                asked.add(1)
                return t.replace("第", "Single")
            bodies = dict(re.findall(r"【块(\d+)】\n(.*?)(?=\n\n【块|\Z)", t, re.DOTALL))
            return "\n---\n".join(f"【块{k}】\n{b.replace('第', 'No')}" for k, b in sorted(bodies.items(), reverse=True) if "missing" not in b)
        return texts.map(one)

    files = spark.createDataFrame([("a", "\\def\\x{第---dash}\nplain\n\\newtheorem{t}{第 missing}\nother\n\\newtheorem{u}{第}")], "doc_id string, text string")
    out, report = translate.translate_style_files(files, reply)
    assert out.first()["text"] == "\\def\\x{No---dash}\nplain\n\\newtheorem{t}{Single missing}\nother\n\\newtheorem{u}{No}" and report.first()["blocks_translated"] == 3 and asked.value == 1


def made_texts(seed: int, bits: list[str], n: int, most: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(bits, k=rng.randrange(most))) for _ in range(n)]


def test_placeholders_by_chunk_come_back(spark):
    texts = [*made_texts(1, ["\\cite{a}", "\\ref{b}", "\\newcommand{\\x}{\\ref{n}}", "some words here", "\n\n", ". More", "<CITE_3>", "\\label{q}", " x" * 40], 200, 25), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = latex.pack_chunks(graph.written(latex.protect(docs)), 60, measure=latex.measured)
    local = latex.number_by_chunk(chunks).withColumn("back", latex.number_by_document(F.col("text"), F.col("held")))
    want = {(r["doc_id"], r["chunk_no"]): r["text"] for r in chunks.collect()}
    for r in local.collect():
        assert r["back"] == want[r["doc_id"], r["chunk_no"]]
        numbers = [int(x) for x in re.findall(r"<[A-Z]+_(\d+)>", r["text"])]
        assert sorted(set(numbers)) == list(range(1, len(set(numbers)) + 1))


def test_a_citation_at_the_top_changes_one_key(spark):
    paragraphs = [f"Paragraph {k} says \\cite{{c{k}}} and \\ref{{r{k}}}, " + "word " * 25 + "\\newcommand{\\x}{\\ref{n}}" for k in range(40)]
    docs = spark.createDataFrame([(1, "\n\n".join(paragraphs)), (2, "\n\n".join(["\\cite{new} " + paragraphs[0], *paragraphs[1:]]))], "doc_id int, text string")
    safe = graph.written(latex.protect(docs))
    keys = lambda chunks: {d: {r["text"] for r in chunks.filter(F.col("doc_id") == d).collect()} for d in (1, 2)}
    by_chunk = keys(latex.number_by_chunk(latex.pack_chunks(safe, 400, measure=latex.measured)))
    assert len(by_chunk[1] - by_chunk[2]) == 1 and len(by_chunk[1]) > 10
    plain = keys(latex.pack_chunks(safe, 400))
    assert len(plain[1] - plain[2]) > 10
    held = spark.createDataFrame([], HELD)
    out, _, report = translate.translate_latex(docs, held, lambda t: t, "m", "d", "2024-01-01", most=400, by_chunk=True)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()} and report.count() == 2


def plain_chunks(text: str, most: int) -> list[str]:
    """Packing as it is written down, one open chunk at a time."""
    out, cur = [], ""
    for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        if len(cur) + len(p) + 2 < most and len(p) <= most:
            cur = f"{cur}\n\n{p}" if cur else p
            continue
        out += [cur] if cur else []
        cur = ""
        if len(p) <= most:
            cur = p
            continue
        for s in re.split(r"(?<=[.!?])\s+", p):
            if cur and len(cur) + len(s) < most:
                cur += " " + s
            else:
                out += [cur] if cur else []
                cur = s
    return [*out, cur] if cur or not out else out


def test_chunks_as_written_down(spark):
    texts = made_texts(2, ["ab. ", "Word ", "long" * 6 + "! ", "\n\n", "\n \n", "x", "é? "], 400, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got: dict = {}
    for r in latex.pack_chunks(docs, 30).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {k: plain_chunks(t, 30) for k, t in enumerate(texts)}


def test_packing_takes_time_in_proportion(spark):
    took = []
    for n in (20_000, 80_000):
        docs = spark.createDataFrame([(1, "\n\n".join(f"Paragraph {k} with some words in it, and more." for k in range(n)))], "doc_id int, text string")
        latex.pack_chunks(docs).count()
        began = time.time()
        assert latex.pack_chunks(docs).agg(F.sum("n_chars")).first()[0] > 40 * n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 2
    blocks = spark.range(50_000).selectExpr("1 doc_id", "cast(id as int) start_line", "'\\\\def\\\\x{第}' content")
    groups = texblocks.pack_blocks(blocks)
    assert groups.selectExpr("sum(size(starts))").first()[0] == 50_000 and markdown.reassemble(groups, "group_no", "doc_id").count() == 1


def plain_chain(up: dict, style: str) -> list[str]:
    chain = [style]
    while up.get(chain[-1]) is not None:
        chain.append(up[chain[-1]])
        if chain[-1] in chain[:-1] or chain[-1] not in up:
            break
    return chain


def test_chains_with_circles_and_missing_styles(spark):
    rng, rows, want, props = random.Random(9), [], {}, {}
    for p in range(12):
        n = rng.randrange(1, 30)
        up = {f"s{k}": None if rng.random() < 0.15 else f"s{rng.randrange(n + 3)}" if p % 3 else f"s{max(0, k - 1 - rng.randrange(2))}" for k in range(n)}
        own = {s: {t: f"{s}{t}" for t in "abc" if rng.random() < 0.3} for s in up}
        rows += [(f"p{p}", s, u, {t: {"val": v} for t, v in own[s].items()}) for s, u in up.items()]
        for s in up:
            want[f"p{p}", s] = plain_chain(up, s)
            props[f"p{p}", s] = {t: v for a in reversed(want[f"p{p}", s]) for t, v in own.get(a, {}).items()}
    frame = spark.createDataFrame(rows + rows[:2], "path string, style_id string, based_on string, rpr map<string,map<string,string>>")
    got: dict = {}
    for r in styles.style_chain(frame).orderBy("depth").collect():
        got.setdefault((r["path"], r["style_id"]), []).append((r["depth"], r["ancestor"]))
    assert got == {k: list(enumerate(v)) for k, v in want.items()}
    resolved = {(r["path"], r["style_id"]): {t: v["val"] for t, v in r["rpr"].items()} for r in styles.resolve_styles(frame).collect()}
    for k, chain in want.items():
        assert resolved[k].keys() == props[k].keys()
        nearest = {t: next(f"{a}{t}" for a in chain if f"{a}{t}" == resolved[k][t] or (a in {s for p, s in want if p == k[0]} and t in dict(next(x[3] for x in rows if x[0] == k[0] and x[1] == a)))) for t in resolved[k]}
        assert nearest == resolved[k]
    assert styles.style_chain(frame.limit(0)).count() == 0 and styles.resolve_styles(frame.limit(0)).count() == 0


def test_ten_thousand_styles_in_a_chain(spark):
    frame = spark.range(10_000).selectExpr("'p' path", "concat('s', id) style_id", "if(id = 9999, null, concat('s', id + 1)) based_on", "if(id = 9999, map('sz', map('val', '9')), map()) rpr")
    frame = frame.withColumn("rpr", F.col("rpr").cast("map<string,map<string,string>>"))
    assert len(styles._jumps(styles._nodes(frame))) == 14
    assert styles.resolve_styles(frame).filter("style_id = 's0'").first()["rpr"] == {"sz": {"val": "9"}}


def test_hot_texts_are_joined_apart(spark):
    units = spark.createDataFrame([(k, f"t{k % 7 if k % 3 else 0}" if k % 11 else None) for k in range(300)], "doc_id int, k string")
    texts = spark.createDataFrame([(f"t{k}", f"T{k}") for k in range(5)], "k string, translated string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, units.join(texts, "k", how).select("doc_id", "k", "translated").collect()), key=str)
        for hot, sent in ((1, 1 << 20), (100, 1 << 20), (100, 0), (1, 0), (1000, 0)):
            assert sorted(map(tuple, join_texts(units, texts, "k", "doc_id", how, hot, sent).select("doc_id", "k", "translated").collect()), key=str) == want


def test_packages_stand_in_the_folder_of_the_main_file(spark):
    held = spark.createDataFrame([], HELD)
    files = [("p/main.tex", "\\documentclass{styles/foo} Text here \\input{ch/one}"), ("p/ch/one.tex", "Text there \\usepackage{baz}"), ("p/styles/foo.cls", "\\RequirePackage{bar} % 第"), ("p/bar.sty", "\\def\\x{第}"), ("p/baz.sty", "\\def\\y{第}"), ("p/styles/bar.sty", "\\def\\z{第}"), ("p/ch/baz.sty", "\\def\\w{第}")]
    out, _, report = translate.translate_project(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame([("p/main.tex",)], "path string"), held, lambda t: t.str.replace("第", "No"), "m", "zh-to-en", "2024-01-01", style_files=True)
    assert {r["path"] for r in out.collect() if r["action"] == "translate"} == {"p/main.tex", "p/ch/one.tex", "p/styles/foo.cls", "p/bar.sty", "p/baz.sty"} and report.first()["total"] == 5
