"""Lines of Markdown documents: classification, units for translation, and putting translations back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import strip
from lectern.operators.hot import join_texts
from lectern.operators.scan import sum_before

# Marks and patterns of the lines that are protected.
FENCE = "```"
TAG = r"\A</?[a-zA-Z][^>]*>\z"
TABLE_RULE = r"\A\|\s*-+(\s*\|\s*-+)*\s*\|?\s*\z"
KEY_VALUE = r"\A[a-zA-Z_][a-zA-Z0-9_]*\s*:\s*[^|]*\z"
FRONT = r"(?s)\A(---\n.*?\n---\n)"


def split_frontmatter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `front` (the leading block between --- lines, kept verbatim, or empty) and `body` (the rest),
    in place of columns of these names; both are null for a null text."""
    front = F.regexp_extract(text_col, FRONT, 1)
    return docs.withColumn("front", front).withColumn("body", F.expr(f"substring({text_col}, length(front) + 1)"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(doc_id, line_no, line) of every line, empty ones included."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def rule(line: Column) -> Column:
    """The first rule that protects a line, or null for a line that is to be translated."""
    s = strip(line)
    return (
        F.when(s == "", "blank")
        .when(s.startswith(FENCE), "fence")
        .when(line.startswith("    ") | line.startswith("\t"), "indented")
        .when(s.rlike(TAG), "tag")
        .when(s.rlike(TABLE_RULE), "table_rule")
        .when(s == "---", "frontmatter_mark")
        .when(s.rlike(KEY_VALUE), "key_value")
    )


def code_fence_state(table: DataFrame) -> DataFrame:
    """Adds `fence` and `in_code`; a line that starts with a fence toggles and belongs to neither side."""
    marked = table.withColumn("fence", strip(F.col("line")).startswith(FENCE))
    counted = sum_before(marked, F.col("fence").cast("int"), "in_code")
    return counted.withColumn("in_code", (F.col("in_code") % 2 == 1) & ~F.col("fence"))


def classify(table: DataFrame) -> DataFrame:
    """Adds fence state, the protecting rule, the stripped line and its indent, and whether it is to be translated."""
    stripped = strip(F.col("line"))
    return (
        code_fence_state(table)
        .withColumn("rule", F.when(F.col("in_code"), "code").otherwise(rule(F.col("line"))))
        .withColumn("stripped", stripped)
        .withColumn("indent", F.length("line") - F.length(F.regexp_replace("line", r"(?U)\A\s+", "")))
        .withColumn("translatable", F.col("rule").isNull())
    )


def segments(table: DataFrame) -> DataFrame:
    """The lines to translate: (doc_id, line_no, stripped, line, indent)."""
    return classify(table).filter("translatable").select("doc_id", "line_no", "stripped", "line", "indent")


def dedupe_units(found: DataFrame) -> DataFrame:
    """(doc_id, text, first_line, n): distinct stripped texts of each document with their first line and number."""
    return found.groupBy("doc_id", F.col("stripped").alias("text")).agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"))


def apply_translations(classified: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines outside fences whose text is translatable somewhere in their document get the
    translation after as many spaces as they were indented by; all others stay.

    translations: (text, translated), one row for each text of the corpus. Blank lines and fenced ones never enter the
    joins; texts are joined by their digest, those of very many documents apart.
    """
    open_ = classified.filter(~F.col("fence") & ~F.col("in_code") & (F.col("stripped") != ""))
    units = dedupe_units(classified.filter("translatable")).select("doc_id", F.md5("text").alias("k"))
    known = join_texts(units, translations.select(F.md5("text").alias("k"), "translated"), "k", "doc_id")
    done = open_.withColumn("k", F.md5("stripped")).join(known, ["doc_id", "k"], "left")
    line = F.when(F.col("translated").isNotNull(), F.concat(F.repeat(F.lit(" "), F.col("indent")), "translated")).otherwise(F.col("line"))
    rest = classified.filter(F.col("fence") | F.col("in_code") | (F.col("stripped") == ""))
    return done.select("doc_id", "line_no", line.alias("line")).unionByName(rest.select("doc_id", "line_no", "line"))


def reassemble(parts: DataFrame, position: str = "line_no", text: str = "line", separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): parts of each document joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias("text"))


def replacement_report(classified: DataFrame, applied: DataFrame) -> DataFrame:
    """(doc_id, replaced, unchanged): lines that changed, and translatable ones that came back as they were."""
    both = classified.select("doc_id", "line_no", F.col("line").alias("old"), "translatable").join(applied, ["doc_id", "line_no"])
    return both.groupBy("doc_id").agg(F.count_if(F.col("old") != F.col("line")).alias("replaced"), F.count_if(F.col("translatable") & (F.col("old") == F.col("line"))).alias("unchanged"))
