"""Column functions shared by all paths: white space, classes of characters, keys and small repairs of replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrases of a refusal, of an echoed prompt, and keywords that lose their space in replies.
REFUSALS = [
    "抱歉", "对不起", "无法处理", "不能", "无法翻译", "无法完成", "不支持", "无法提供",
    "sorry", "i cannot", "i can't", "unable to", "i'm unable", "cannot assist", "can't assist", "cannot help", "can't help", "i apologize",
]
KEYWORDS = ["Chapter", "Section", "Figure", "Table", "Definition", "Theorem", "Lemma", "Example"]
PLACEHOLDER = "<placeholder>"
SEGMENT = "【SEG】"


def newlines(text: Column) -> Column:
    """Line ends of any system as one line feed."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without white space at both ends, whatever kind Unicode knows."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_meaningful(text: Column) -> Column:
    """Holds a letter or digit; null and blank texts don't."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def has_chinese(text: Column) -> Column:
    """Holds a CJK ideograph outside comments that run from % to the end of a line."""
    return F.coalesce(F.regexp_replace(text, r"(?m)%.*$", "").rlike("[一-鿿]"), F.lit(False))


def cache_key(text: Column, model: str, direction: str) -> Column:
    """Key of a text in a translation memory; null for a null text."""
    return F.md5(F.concat(text, F.lit(f"|{model}|{direction}")))


def direction_of(source: Column) -> Column:
    return F.when(source == "Chinese", "zh-to-en").otherwise("en-to-zh")


def clean_reply(text: Column) -> Column:
    """Stripped, then without spaces, quotes and backticks at both ends; empty for null."""
    return F.coalesce(F.regexp_replace(strip(text), "\\A[ \"'`]+|[ \"'`]+\\z", ""), F.lit(""))


def fix_keyword_spacing(text: Column) -> Column:
    """A space between a heading keyword and a command that follows it at once."""
    return F.regexp_replace(text, rf"({'|'.join(KEYWORDS)})(\\[a-zA-Z])", r"$1 $2")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{4,}", "\n\n\n")


def needs_space_mark(text: Column) -> Column:
    """Whether white space at an end must be marked to be kept."""
    return F.coalesce(text.startswith(" ") | text.endswith(" "), F.lit(False))


def convert_document_class(text: Column, direction: str, fonts: str = "") -> Column:
    """English to Chinese: the article class becomes ctexart, options kept; `fonts` goes before the document if xeCJK is absent."""
    if direction != "en-to-zh":
        return text
    named = F.regexp_replace(text, r"\\documentclass(\[.*?\])?\{article\}", r"\\documentclass$1{ctexart}")
    begin = r"\begin{document}"
    return F.when(named.contains("ctexart") & ~named.contains("xeCJK"), F.replace(named, F.lit(begin), F.lit(fonts + begin))).otherwise(named)


def number_blocks(blocks: Column) -> Column:
    """The blocks of a group as numbered sections of one request."""
    return F.array_join(F.transform(blocks, lambda x, i: F.concat(F.lit("【块"), i + 1, F.lit("】\n"), x)), "\n\n")


def numbered_parts(reply: Column, n: Column) -> Column:
    """The n parts of a reply by the numbers of its sections, null where a number is missing or its section blank.

    Sections may come in any order; of several with one number the first that isn't blank counts. A line of --- at the end
    of a section parts it from the next and is no part of it; any other --- is.
    """
    mark = r"【块\s*([0-9]+)】"
    ids = F.transform(F.regexp_extract_all(reply, F.lit(mark), F.lit(1)), lambda x: x.try_cast("int"))
    bodies = F.transform(F.slice(F.split(reply, mark, -1), F.lit(2), F.size(ids)), lambda x: strip(F.regexp_replace(x, r"\n[ \t]*---\s*\z", "")))
    found = F.filter(F.zip_with(ids, bodies, lambda i, x: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != "")
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.get(F.filter(found, lambda p: p["i"] == k), F.lit(0))["x"])


def split_by_placeholder(reply: Column, is_text: Column) -> Column:
    """Parts of a reply between placeholders, dealt in order to the text segments; what is left over joins the last one.

    is_text: array of booleans, one for each segment; other segments get the placeholder.
    """
    parts = F.split(reply, PLACEHOLDER, -1)
    wanted = F.aggregate(is_text, F.lit(0), lambda n, x: n + x.cast("int"))
    place = F.transform(is_text, lambda x, i: F.aggregate(F.slice(is_text, 1, i), F.lit(0), lambda n, y: n + y.cast("int")))

    def part(text: Column, k: Column) -> Column:
        own = F.when(k < F.size(parts), F.get(parts, k)).otherwise(F.lit(""))
        rest = F.when(F.size(parts) > wanted, F.concat(own, F.array_join(F.slice(parts, k + 2, F.greatest(F.size(parts) - k - 1, F.lit(0))), ""))).otherwise(own)
        return F.when(text, F.when(k == wanted - 1, rest).otherwise(own)).otherwise(F.lit(PLACEHOLDER))

    return F.zip_with(is_text, place, part)


def infer_alignment(own: Column, formula: Column) -> Column:
    """A paragraph's alignment, else the one that its formula implies, else null."""
    return F.coalesce(own, F.when(formula.isin("left", "right"), formula).when(formula.isNotNull(), "center"))
