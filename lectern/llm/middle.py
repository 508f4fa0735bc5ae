"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at the ends of units, and put in another order.

A text's units are words with the white space before them. Their ends are gathered in a compact array by one pass of a
regular expression; two of them are where the text is cut. Which two, and whether and how the parts change places, follows
from a digest of the seed and the document's id, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are cut, and of those the percent whose suffix comes first.
PERCENT, SUFFIX_FIRST = 50, 80
SEED = 42
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if no text without them can hold one across a mark's edge: then an output is read in one way only."""
    for a in marks:
        if not a or any(a != b and a in b for b in marks) or any(a.endswith(b[:k]) for b in marks for k in range(1, len(b)) if k < len(a)):
            raise ValueError(f"marks must not hold or overlap each other: {marks}")
    if len({*marks}) < 3:
        raise ValueError(f"three different marks are needed: {marks}")
    return marks


def cut_text(name: str, text: str, seed: int = SEED, percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text under the id `name`."""
    ends = array("I", (m.end() for m in UNIT.finditer(text)))
    ends.insert(0, 0)
    seeds = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    one, two, any_, order = (int(seeds[k : k + 8], 16) for k in range(0, 32, 8))
    n, (before, behind, between) = len(ends) - 1, marks
    if not text or any(m in text for m in marks) or any_ % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, f"{behind}{suffix}{before}{prefix}{between}{middle}"
    return n, "psm", a, b - a, f"{before}{prefix}{behind}{suffix}{between}{middle}"


def whole_text(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that an output was made from."""
    before, behind, between = marks
    if form == "plain":
        return output
    head, _, middle = output.partition(between)
    if form == "psm":
        prefix, _, suffix = head.removeprefix(before).partition(behind)
    else:
        suffix, _, prefix = head.removeprefix(behind).partition(before)
    return prefix + middle + suffix


def infill(
    docs: DataFrame, seed: int = SEED, percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    form is plain (the text stays), psm (prefix, suffix, middle) or spm (suffix, prefix, middle); lengths are code points
    and null for plain ones. Null texts count as empty and are plain, as are texts that hold a mark. A null id is hashed
    as an empty one; rows of one id share their seeds, whatever their texts. Other columns of docs are left out.
    """
    marks = _checked(tuple(marks))

    @F.pandas_udf(PARTS)
    def cut(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [cut_text(name, text, seed, percent, suffix_first, marks) for name, text in zip(names, texts)]
        made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    none = F.lit("")
    cells = cut(F.coalesce(F.col(id_col).cast("string"), none), F.coalesce(F.col(text_col), none))
    return docs.select(F.col(id_col).alias("doc_id"), cells.alias("cells")).select("doc_id", "cells.*")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The texts that outputs were made from."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([whole_text(o, f, marks) for o, f in zip(outputs, forms)], dtype="object")

    return back(output, form)


def sha256(text: Column) -> Column:
    """Digest of each text in UTF-8, lowercase hex."""

    @F.pandas_udf("string")
    def hexes(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts], dtype="object")

    return hexes(text)


def digest(made: DataFrame) -> DataFrame:
    """Outputs and the texts restored from them as digests."""
    output, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(output).alias("output_sha256"), sha256(restored(output, form)).alias("restored_sha256"))
