"""Quotes and backticks at the ends of a line belong to Markdown; around replies of other paths they are a model's."""

from __future__ import annotations

from lectern.jobs import translate
from lectern.operators import validate
from lectern.functions import text as T
from pyspark.sql import functions as F


def test_markdown_keeps_quotes(spark):
    lines = ['the token. token = "0fab"', "use `x`", "'so it goes'", "plain "]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    out, kept, _ = translate.translate_markdown(docs, held, lambda t: "T:" + t, "m", "d", "2024-05-01")
    assert out.first()["text"] == "\n".join(f"T:{x.strip()}" for x in lines)
    assert {r["text"] for r in kept.collect()} == {f"T:{x.strip()}" for x in lines}


def test_other_replies_lose_them(spark):
    rows = spark.createDataFrame([(1, 0, "a", ' "b" '), (2, 0, "a", ' "" ')], "unit_id int, attempt int, src string, reply string")
    assert {r["unit_id"]: r["final_text"] for r in validate.first_valid_attempt(rows).collect()} == {1: "b", 2: "a"}
    assert {r["unit_id"]: r["final_text"] for r in validate.first_valid_attempt(rows, clean=T.strip).collect()} == {1: '"b"', 2: '""'}
    assert [r[0] for r in rows.select(validate.status(F.col("src"), F.lit(None).cast("string"), clean=T.strip)).collect()] == ["error", "error"]
