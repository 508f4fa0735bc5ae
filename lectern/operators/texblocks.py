"""Semantic blocks of LaTeX style files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.functions.text import has_chinese

GROUP_COST, COST_PER_CHAR = 2000, 1.5
#: Lines of a block that are laid out at once.
SPAN = 4096
# Commands by the type of block that they open.
_OPENERS = [
    (re.compile(r"\\(?:new|renew|provide)command"), "command_definition", True),
    (re.compile(r"\\(?:newtheorem|theoremstyle)"), "theorem_definition", False),
    (re.compile(r"\\(?:titleformat|captionsetup|setlength|setcounter)"), "format_command", True),
]
_DEF = "\\def\\"


def _quiet(line: str) -> bool:
    return not line.strip() or line.strip().startswith("%")


def blocks_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, type) of each block; blank lines and comments between blocks belong to none."""
    lines = text.split("\n")
    balance = [x.count("{") - x.count("}") for x in lines]
    at = 0
    while at < len(lines):
        line, last = lines[at], at
        if _quiet(line):
            at += 1
            continue
        if line.startswith(_DEF):
            kind = "def_block"
            for k in range(at + 1, len(lines)):
                if lines[k].startswith(_DEF):
                    last = k
                elif not _quiet(lines[k]):
                    break
        else:
            opener = next((o for o in _OPENERS if o[0].match(line)), None)
            kind = opener[1] if opener else "single_command" if line.strip().startswith("\\") else "text"
            if opener and opener[2]:
                depth = balance[at]
                while depth > 0 and last + 1 < len(lines):
                    last += 1
                    depth += balance[last]
        yield at, last, kind
        at = last + 1


def extract_tex_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_line, end_line, block_type, content); quiet lines inside a run of definitions stay in its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                for first, last, kind in blocks_of(text or ""):
                    for column, x in zip(out, (i, first, last, kind, "\n".join(lines[first : last + 1]))):
                        column.append(x)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "start_line", "end_line", "block_type", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start_line int, end_line int, block_type string, content string")


def filter_chinese_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(has_chinese(F.col("content")))


def pack_blocks(blocks: DataFrame, most: float = GROUP_COST, cost: float = COST_PER_CHAR) -> DataFrame:
    """(doc_id, group_no, starts, contents): blocks by start line; a new group opens when the cost would pass `most`.

    Lengths alone are handed to Python, to find the groups; blocks are cut by that once.
    """

    @F.pandas_udf("array<int>")
    def begins(lengths: pd.Series) -> pd.Series:
        return pd.Series([group_starts(x, most, cost) for x in lengths], dtype="object")

    ordered = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    laid = blocks.groupBy("doc_id").agg(ordered.alias("b")).withColumn("at", begins(F.transform("b", lambda x: F.length(x["content"]))))
    mine = lambda at, k: F.slice("b", at + 1, F.coalesce(F.get("at", k + 1), F.size("b")) - at)
    rows = laid.select("doc_id", F.posexplode(F.transform("at", mine)).alias("group_no", "g"))
    return rows.select("doc_id", "group_no", F.transform("g", lambda x: x["start_line"]).alias("starts"), F.transform("g", lambda x: x["content"]).alias("contents"))


def group_starts(lengths: np.ndarray, most: float, cost: float) -> list[int]:
    """First blocks of the groups of a file."""
    starts, total = [], 0.0
    for k, n in enumerate(lengths.tolist()):
        if not starts or total > 0 and total + n * cost > most:
            starts.append(k)
            total = 0.0
        total += n * cost
    return starts


def rebuild_from_blocks(lines: DataFrame, translated: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines under a translated block (doc_id, start_line, end_line, text) give way to its text.

    Blocks of a document don't overlap, so a line is under one at most. Blocks are laid out as the numbers of their lines,
    the text with the first alone, and joined by document and line: a document spans as many tasks as there are.
    """
    spans = F.sequence(F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.lit(SPAN).cast("long"))
    numbers = F.sequence("x.line_no", F.least(F.col("x.line_no") + (SPAN - 1), F.col("end_line").cast("long")))
    named = lambda x, first, text: F.struct(x.alias("line_no"), (x == first).alias("first"), F.when(x == first, text).alias("text"))
    cut = F.explode(F.transform(spans, lambda x: named(x, F.col("start_line"), F.col("text")))).alias("x")
    parts = translated.filter("end_line >= start_line").select("doc_id", "start_line", "end_line", cut)
    covered = parts.select("doc_id", F.explode(F.transform(numbers, lambda x: named(x, F.col("start_line"), F.col("x.text")))).alias("y")).select("doc_id", "y.*")
    placed = lines.join(covered, ["doc_id", "line_no"], "left").filter("first is null or first")
    return placed.select("doc_id", "line_no", F.when(F.col("first"), F.col("text")).otherwise(F.col("line")).alias("line"))
