"""Reading documents and packages as tables, and writing documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions.text import newlines
from lectern.sources import versions

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
ElementTree.register_namespace("w", W[1:-1])
#: Rows of an Arrow batch that a task gives back, and bytes of packages or parts behind which one ends.
BATCH_ROWS, BATCH_BYTES = 8192, 16 << 20
PROPS = pa.map_(pa.string(), pa.map_(pa.string(), pa.string()))


def _batches(found: Iterable[tuple[list[tuple], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many packages or parts, given as (rows, bytes) each: a batch for each would cost more than its rows."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), schema.types)], schema=schema)

    held: list[tuple] = []
    size = 0
    for rows, n in found:
        held += rows
        size += n
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield from (batch(held[k : k + BATCH_ROWS]) for k in range(0, len(held), BATCH_ROWS))
            held, size = [], 0
    if held:
        yield batch(held)


def read_text_documents(spark: SparkSession, paths: str | list[str], drop_bad_bytes: bool = False) -> DataFrame:
    """(path, text): whole files as UTF-8 with line feeds. Bad bytes are dropped if asked for, else they raise an error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    if drop_bad_bytes:

        @F.pandas_udf("string")
        def decode(content: pd.Series) -> pd.Series:
            return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))

        text = decode("content")
    else:
        text = F.decode("content", "UTF-8")
    return files.select("path", newlines(text).alias("text"))


def write_documents(docs: DataFrame, path: str) -> None:
    """(path, format, text) as Parquet by format; the folder must be new, so that no half-written one is read."""
    docs.write.partitionBy("format").parquet(path)


def write_memory(memory: DataFrame, folder: str, version: str) -> str:
    """A memory as a new version below folder; the version that is read is never written to, and is named once it is whole."""
    path = f"{folder.rstrip('/')}/version={version}"
    memory.write.parquet(path)
    versions.tell_version(memory.sparkSession, folder, version)
    return path


def read_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The last version below folder that was written to its end; an empty memory where there is none."""
    found = versions.newest(spark, folder)
    return spark.createDataFrame([], "cache_key string, text string, ts_raw string") if found is None else found.select("cache_key", "text", "ts_raw")


def part_action(name):
    """What is done with a part of a package: replace_font_table, replace_styles, process or copy."""
    return F.when(name == "word/fontTable.xml", "replace_font_table").when(name == "word/styles.xml", "replace_styles").when(name.startswith("word/") & name.endswith(".xml"), "process").otherwise("copy")


def explode_docx_parts(packages: DataFrame) -> DataFrame:
    """(path, part_no, part_name, part_bytes, action, status) of packages (path, content).

    A package that can't be opened is one row with status `bad_package` and no part; its bytes stand in part_bytes.
    """

    schema = pa.schema([("path", pa.string()), ("part_no", pa.int32()), ("part_name", pa.string()), ("part_bytes", pa.binary()), ("status", pa.string())])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        for batch in batches:
            for path, content in zip(*(batch[c].to_pylist() for c in ("path", "content"))):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, k, i.filename, z.read(i), "ok") for k, i in enumerate(z.infolist())]
                except (zipfile.BadZipFile, TypeError, OSError, ValueError, NotImplementedError, RuntimeError):
                    rows = [(path, None, None, content, "bad_package")]
                yield rows, sum(len(r[3] or b"") for r in rows)

    parts = packages.select("path", "content").mapInArrow(lambda batches: _batches(opened(batches), schema), "path string, part_no int, part_name string, part_bytes binary, status string")
    return parts.withColumn("action", F.when(F.col("status") == "ok", part_action(F.col("part_name"))))


def _tag(name: str) -> str:
    """Name of a property: without its namespace if that is Word's own."""
    return name.removeprefix(W)


def _props(element) -> dict[str, dict[str, str]]:
    """Property tags with their attributes, names of these without their namespace."""
    if element is None:
        return {}
    return {_tag(c.tag): {k.rpartition("}")[2]: v for k, v in c.attrib.items()} for c in element}


def _whole_props(element) -> dict[str, str]:
    """Property tags with their whole elements, which declare the namespaces that they use."""
    out = {}
    for c in element if element is not None else ():
        c.tail = None
        out[_tag(c.tag)] = ElementTree.tostring(c, encoding="unicode")
    return out


#: Elements that the scan looks at, by a small number: names are compared once, when an element begins.
_P, _R, _T, _RPR, _PPR, _STYLE, _ALIGN, _LINK, _MATH_R, _MATH_T, _MATH_RPR, _FORMULA, _DRAWING, _FIELD = range(1, 15)
_CODES = {W[1:] + k: v for k, v in {"p": _P, "r": _R, "t": _T, "rPr": _RPR, "pPr": _PPR, "pStyle": _STYLE, "jc": _ALIGN, "hyperlink": _LINK, "drawing": _DRAWING, "object": _DRAWING, "fldChar": _FIELD, "instrText": _FIELD, "pict": _FIELD}.items()}
_CODES |= {M[1:] + k: v for k, v in {"r": _MATH_R, "t": _MATH_T, "rPr": _MATH_RPR, "oMath": _FORMULA, "oMathPara": _FORMULA}.items()}


@dataclass(slots=True)
class _Run:
    """A run or non-text node of a paragraph, with the places of its bytes and of those of its texts. A place is where an
    element begins and where the parser stood when it ended; _stop makes its end of that."""

    about: tuple
    run_no: int
    block: int
    kind: str
    math: bool
    depth: int
    start: int
    special: bool
    #: Where its paragraph begins, which has the prefix of Word's namespace.
    above: int
    stop: int = 0
    texts: list[tuple[int, int]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    rpr: dict = field(default_factory=dict)
    #: Where the properties stand, and each of them (tag, place); in a formula, where its own properties stand.
    held: tuple[int, int] | None = None
    props: list[tuple[str, int, int]] = field(default_factory=list)
    formula: tuple[int, int] | None = None


@dataclass(slots=True)
class _Paragraph:
    para_no: int
    depth: int
    start: int
    style: str | None = None
    align: str | None = None
    runs: int = 0
    maths: int = 0
    block: int = 0
    linked: bool = False
    run: _Run | None = None
    math: _Run | None = None


_TAG, _NAME = re.compile(rb"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""), re.compile(rb"<([^\s/>:]+:)?")


def _tag_stop(data: bytes, at: int) -> int:
    """Where the tag that starts at `at` ends; > in quotes doesn't end it."""
    return _TAG.match(data, at).end()


def _stop(data: bytes, begun: int, at: int) -> int:
    """Where the element that begun there ends; the parser stood behind an empty one, before the end tag of others."""
    first = _tag_stop(data, begun)
    return first if data[first - 2 : first] == b"/>" else _tag_stop(data, at)


def _prefix(data: bytes, at: int) -> bytes:
    """Prefix of the tag that starts at `at`, with its colon."""
    return _NAME.match(data, at)[1] or b""


def _scan(data: bytes) -> list[_Run]:
    """Runs of a part, paragraphs at any depth in document order; the numbers are those that texts are put back by.

    block changes with every child of a paragraph that isn't an ordinary run, so that runs on both sides of it never
    belong together. Children that hold no text of their own (bookmarks and the like) make no run. Runs inside a formula
    are of kind math_run and are counted for themselves.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    codes: list[int] = []
    open_: list[_Paragraph] = []
    done: list[_Run] = []
    count = 0
    in_text = False
    p = r = None  # the innermost paragraph that is open, and its open run or the run of a formula in it
    val, code_of = W[1:] + "val", _CODES.get

    def start(name: str, attrs: dict) -> None:
        nonlocal count, in_text, p, r
        code, depth = code_of(name, 0), len(codes)
        codes.append(code)
        if code == _P:
            p, r = _Paragraph(count, depth, parser.CurrentByteIndex), None
            open_.append(p)
            count += 1
            return
        if p is None:
            return
        if code >= _DRAWING:
            for other in open_:
                if other.run is not None and other.run.kind != "hyperlink":
                    other.run.special = True
        if r is None:
            level = depth - p.depth
            if level == 1:
                p.linked = code == _LINK
                p.block += code != _R
                if code == _R or code == _DRAWING or code == _FORMULA:
                    r = p.run = _Run((p.para_no, p.style, p.align), p.runs, p.block, "run" if code == _R else "non_text", code == _FORMULA, depth, parser.CurrentByteIndex, code != _R, p.start)
                    p.runs += 1
                    done.append(r)
            elif level == 2:
                if code == _R and p.linked:
                    r = p.run = _Run((p.para_no, p.style, p.align), p.runs, p.block, "hyperlink", False, depth, parser.CurrentByteIndex, False, p.start)
                    p.runs += 1
                    done.append(r)
                elif codes[-2] == _PPR:
                    if code == _STYLE:
                        p.style = attrs.get(val)
                    elif code == _ALIGN:
                        p.align = attrs.get(val)
            return
        if code == _MATH_R and p.math is None and r.math:
            r = p.math = _Run((p.para_no, p.style, p.align), p.maths, p.block, "math_run", True, depth, parser.CurrentByteIndex, True, p.start)
            p.maths += 1
            done.append(r)
            return
        level = depth - r.depth
        if level == 1:
            if code == (_T if p.math is None else _MATH_T):
                r.texts.append((parser.CurrentByteIndex, 0))
                in_text = True
            elif code == _RPR and r.held is None:
                r.held = (parser.CurrentByteIndex, 0)
            elif code == _MATH_RPR:
                r.formula = (parser.CurrentByteIndex, 0)
        elif level == 2 and codes[-2] == _RPR and not r.held[1]:
            tag = _tag("{" + name)
            r.rpr[tag] = {k.rpartition("}")[2]: v for k, v in attrs.items()}
            r.props.append((tag, parser.CurrentByteIndex, 0))

    def end(name: str) -> None:
        nonlocal in_text, p, r
        code = codes.pop()
        if p is None:
            return
        depth = len(codes)
        if depth == p.depth:
            open_.pop()
            p = open_[-1] if open_ else None
            r = p and (p.math or p.run)
        elif r is not None:
            level = depth - r.depth
            if level == 0:
                r.stop = parser.CurrentByteIndex
                if r is p.math:
                    p.math, r = None, p.run
                else:
                    p.run = r = None
            elif level == 1:
                if in_text:
                    r.texts[-1] = (r.texts[-1][0], parser.CurrentByteIndex)
                    in_text = False
                elif code == _RPR and not r.held[1]:
                    r.held = (r.held[0], parser.CurrentByteIndex)
                elif code == _MATH_RPR:
                    r.formula = (r.formula[0], parser.CurrentByteIndex)
            elif level == 2 and codes[-1] == _RPR and not r.held[1]:
                r.props[-1] = (*r.props[-1][:2], parser.CurrentByteIndex)
        elif p.linked and depth == p.depth + 1:
            p.linked = False

    def chars(text: str) -> None:
        if in_text and r is not None:
            r.text.append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.buffer_text = True
    parser.Parse(data, True)
    return done


def _utf8(data: bytes) -> bytes:
    """A part in UTF-8, whatever it was in; its declaration says so."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16")
        return re.sub(r"""(<\?xml[^>]*encoding=["'])[^"']*""", r"\g<1>UTF-8", text, count=1).encode()
    return data


RUN_COLUMNS = "para_no int, pstyle string, jc string, run_no int, block int, kind string, text string, special boolean, rstyle string, rpr map<string,map<string,string>>, math boolean, lettered boolean"


def parse_docx_runs(parts: DataFrame, formulas: bool = False) -> DataFrame:
    """Runs of parts (path, part_name, part_bytes), paragraphs at any depth, in order.

    kind is run, hyperlink (a run in one) or non_text (a formula, drawing or object); runs of one hyperlink share their
    block, and so do ordinary runs with nothing else between them. With `formulas` the runs inside formulas are rows too, of
    kind math_run and with numbers of their own. lettered: whether the run holds a letter or digit, be it special or not.
    A part that is no XML gives no rows.
    """
    string, whole, flag = pa.string(), pa.int32(), pa.bool_()
    kinds = [string, string, whole, string, string, whole, whole, string, string, flag, string, PROPS, flag, flag]
    columns = f"path string, part_name string, {RUN_COLUMNS}"
    schema = pa.schema(list(zip((c.split()[0] for c in columns.split(", ")), kinds)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        for batch in batches:
            for path, name, data in zip(*(batch[c].to_pylist() for c in ("path", "part_name", "part_bytes"))):
                try:
                    found = _scan(_utf8(data))
                except (expat.ExpatError, TypeError, UnicodeDecodeError):
                    continue
                rows = []
                for r in found:
                    if formulas or r.kind != "math_run":
                        text, rstyle = "".join(r.text), r.rpr.pop("rStyle", {}).get("val")
                        rows.append((path, name, *r.about, r.run_no, r.block, r.kind, "" if r.special else text, r.special, rstyle, [(k, list(v.items())) for k, v in r.rpr.items()], r.math, any(map(str.isalnum, text))))
                yield rows, len(data)

    return parts.select("path", "part_name", "part_bytes").mapInArrow(lambda batches: _batches(scanned(batches), schema), columns)


def parse_docx_styles(parts: DataFrame) -> DataFrame:
    """(path, style_id, name, style_type, based_on, direct_size, rpr, xml) of styles parts; styles without id are left out, and
    of several with one id the last counts. xml holds the properties as whole elements."""
    columns = "path string, style_id string, name string, style_type string, based_on string, direct_size int, rpr map<string,map<string,string>>, xml map<string,string>"
    string = pa.string()
    schema = pa.schema(list(zip((c.split()[0] for c in columns.split(", ")), [*[string] * 5, pa.int32(), PROPS, pa.map_(string, string)])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        for batch in batches:
            for path, data in zip(*(batch[c].to_pylist() for c in ("path", "part_bytes"))):
                try:
                    root = ElementTree.fromstring(data)
                except (ElementTree.ParseError, TypeError):
                    continue
                rows = []
                value = lambda s, tag: None if (x := s.find(W + tag)) is None else x.get(W + "val")
                for s in {s.get(W + "styleId"): s for s in root.iter(W + "style")}.values():
                    rpr = _props(s.find(W + "rPr"))
                    size = rpr.get("sz", {}).get("val", "")
                    if s.get(W + "styleId"):
                        props, whole = [(k, list(v.items())) for k, v in rpr.items()], list(_whole_props(s.find(W + "rPr")).items())
                        rows.append((path, s.get(W + "styleId"), value(s, "name"), s.get(W + "type"), value(s, "basedOn"), int(size) if size.isdigit() else None, props, whole))
                yield rows, len(data)

    return parts.filter("action = 'replace_styles'").select("path", "part_bytes").mapInArrow(lambda batches: _batches(read(batches), schema), columns)


def assemble_docx(parts: DataFrame, texts: DataFrame, font_table: bytes | None = None, styles: bytes | None = None, properties: DataFrame | None = None) -> DataFrame:
    """(path, content): packages with translated runs (path, part_name, para_no, run_no, text) put back; a run whose text is
    null goes, as its text stands in another one. font_table and styles replace those parts where they are given.

    properties: (path, part_name, para_no, run_no, math_run, xml, drop), elements that the properties of a run get before
    its own, and the tags of its own that go. Only the bytes of texts and properties change: all else in a part, its
    declarations included, stays as it is, and so does a part that can't be parsed. All parts of one package meet in a
    task: a package is one file.
    """
    data = F.col("part_bytes")
    for action, new in (("replace_font_table", font_table), ("replace_styles", styles)):
        if new is not None:
            data = F.when(part_action(F.col("part_name")) == action, F.lit(bytearray(new))).otherwise(data)
    columns = ["path", "kind", "part_no", "part_name", "part_bytes", "para_no", "run_no", "text", "math_run", "xml", "drop"]
    laid = parts.filter("status = 'ok'").select("path", F.lit(2).alias("kind"), "part_no", "part_name", data.alias("part_bytes"))
    laid = laid.unionByName(texts.select("path", "part_name", F.lit(0).alias("kind"), "para_no", "run_no", "text"), allowMissingColumns=True)
    if properties is None:
        laid = laid.withColumns({"math_run": F.lit(None).cast("boolean"), "xml": F.lit(None).cast("array<string>"), "drop": F.lit(None).cast("array<string>")})
    else:
        laid = laid.unionByName(properties.select("path", "part_name", F.lit(1).alias("kind"), "para_no", "run_no", "math_run", "xml", "drop"), allowMissingColumns=True)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        """Rows come by package, the changes of its parts before the parts, and a package may go on in the next batch."""
        at, out = object(), None
        for batch in batches:
            for path, kind, _, name, data, para_no, run_no, text, math_run, xml, drop in zip(*(batch[c].to_pylist() for c in columns)):
                if path != at:
                    if out is not None:
                        z.close()
                        yield [(at, out.getvalue())], out.tell()
                    at, out, changes = path, None, {}
                if kind == 2:
                    if out is None:
                        out = io.BytesIO()
                        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    z.writestr(name, with_changes(data, *changes[name]) if name in changes else data)
                    continue
                given, more = changes.setdefault(name, ({}, {}))
                if kind:
                    more[para_no, run_no, math_run] = (xml, drop)
                else:
                    given[para_no, run_no] = text
        if out is not None:
            z.close()
            yield [(at, out.getvalue())], out.tell()

    dealt = laid.select(columns).repartition("path").sortWithinPartitions("path", "kind", "part_no")
    return dealt.mapInArrow(lambda batches: _batches(built(batches), schema), "path string, content binary")


def with_changes(data: bytes, texts: dict[tuple[int, int], str | None], properties: dict[tuple[int, int, bool], tuple] | None = None) -> bytes:
    """A part with the texts of its runs, by (para_no, run_no), in place, and with more properties (elements, tags to drop) of
    runs by (para_no, run_no, in a formula); runs whose text is None are taken out."""
    data, properties = _utf8(data), properties or {}
    try:
        runs = _scan(data)
    except expat.ExpatError:
        return data
    edits: list[tuple[int, int, bytes]] = []
    for r in runs:
        formula = r.kind == "math_run"
        where = (r.about[0], r.run_no)
        if not formula and texts.get(where, "") is None:
            edits.append((r.start, _stop(data, r.start, r.stop), b""))
            continue
        if (*where, formula) in properties:
            edits += _properties(data, r, *properties[(*where, formula)])
        if formula or where not in texts or not r.texts:
            continue
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]", "", texts[where])
        tag = re.match(rb"<([^\s/>]+)", data[r.texts[0][0] :])[1]
        space = b' xml:space="preserve"' if text != text.strip(" ") else b""
        places = [(a, _stop(data, a, b)) for a, b in r.texts]
        edits.append((*places[0], b"<" + tag + space + b">" + escape(text).encode() + b"</" + tag + b">"))
        edits += [(a, b, b"") for a, b in places[1:]]
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [data[at:a], new]
        at = b
    return b"".join([*out, data[at:]])


def _properties(data: bytes, r: _Run, elements: list[str], drop: list[str]) -> list[tuple[int, int, bytes]]:
    """The change that gives a run these elements and takes those tags from it; none if it has neither."""
    own = [data[a : _stop(data, a, b)] for tag, a, b in r.props if tag not in drop]
    if not len(elements) and len(own) == len(r.props):
        return []
    more = [x.encode() for x in elements]
    prefix = _prefix(data, r.above)
    if prefix == b"w:":  # bound to Word's namespace here: no need to say so again
        more = [x.replace(f' xmlns:w="{W[1:-1]}"'.encode(), b"") for x in more]
    tag = prefix + b"rPr>"
    if r.held is not None:
        place = (r.held[0], _stop(data, *r.held))
    else:
        first = _tag_stop(data, r.start) if r.formula is None else _stop(data, *r.formula)
        place = (first, first)
    return [(*place, b"<" + tag + b"".join([*more, *own]) + b"</" + tag)]
