"""Running sums and rebuilt files of documents that span tasks, against a window over the whole document."""

from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

from lectern.operators import latex, markdown, scan, texblocks


def rows_of(table, *columns):
    return sorted((tuple(r[c] for c in columns) for r in table.collect()), key=repr)


def test_sum_before_is_the_window_over_the_document(spark):
    draw = random.Random(3)
    made = [(d, k, draw.choice([None, 0, 1, 5]), f"r{k}") for d in ["a", "b", None, ""] for k in draw.sample(range(200), 60)]
    made += [("a", None, 7, "no place"), ("short", 0, 2, "x"), ("zero", 150, None, "x"), ("zero", 190, 0, "y")]
    table = spark.createDataFrame(made, "doc_id string, line_no int, v int, note string")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    want = rows_of(table.withColumn("s", F.coalesce(F.sum("v").over(before), F.lit(0))), "doc_id", "line_no", "v", "note", "s")
    for block in (1, 3, 64, scan.BLOCK):
        got = scan.sum_before(table, F.col("v"), "s", block=block)
        assert got.columns == [*table.columns, "s"]
        assert rows_of(got, "doc_id", "line_no", "v", "note", "s") == want
    assert scan.sum_before(table.limit(0), F.col("v"), "s").count() == 0


def test_a_document_spans_tasks(spark):
    table = spark.range(0, 200_000, numPartitions=4).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"))
    summed = scan.sum_before(table, F.lit(1), "n", block=1000)
    assert summed.filter("n != line_no").count() == 0
    spread = summed.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 150_000
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_fences_and_spans_across_blocks(spark, monkeypatch):
    draw = random.Random(5)
    lines = [(d, k, draw.choice(["```", "  ```py", "text", "", "\\name{图}", "% 注", None])) for d in range(3) for k in range(90)]
    table = spark.createDataFrame(lines, "doc_id int, line_no int, line string")
    whole = rows_of(markdown.code_fence_state(table), "doc_id", "line_no", "fence", "in_code")
    spans = rows_of(latex.style_file_spans(table), "doc_id", "start", "stop", "text", "span_type")
    want, open_ = [], {}
    for d, k, line in lines:
        fence = None if line is None else line.strip().startswith("```")
        inside = bool(open_.get(d)) and (None if fence is None else not fence)
        want.append((d, k, fence, inside))
        open_[d] = bool(open_.get(d)) ^ bool(fence)
    assert whole == sorted(want, key=repr)
    at = {}
    for d, k, line in lines:
        if line == "% 注":
            assert (d, at.get(d, 0) + 2, at.get(d, 0) + 3, "注", "comment") in spans
        at[d] = at.get(d, 0) + (0 if line is None else len(line) + 1)
    monkeypatch.setattr(scan.sum_before, "__defaults__", ("doc_id", "line_no", 4))
    assert rows_of(markdown.code_fence_state(table), "doc_id", "line_no", "fence", "in_code") == whole
    assert rows_of(latex.style_file_spans(table), "doc_id", "start", "stop", "text", "span_type") == spans


def test_rebuild_from_blocks_of_any_length(spark, monkeypatch):
    draw = random.Random(8)
    lines = [(d, k, f"{d}.{k}") for d in range(3) for k in range(50)]
    blocks, want = [], []
    for d in range(3):
        k = 0
        while k < 50:
            n = draw.randint(1, 12)
            last = min(k + n, 50) - 1
            if d < 2 and draw.random() < 0.6:
                text = draw.choice([f"T{k}", "", "a\nb"])
                blocks.append((d, k, last, text))
                want.append((d, k, text))
            else:
                want += [(d, j, f"{d}.{j}") for j in range(k, last + 1)]
            k = last + 1
    blocks.append((2, 10, 9, "ends before it starts"))
    table = spark.createDataFrame(lines, "doc_id int, line_no int, line string")
    for span in (1, 5, texblocks.SPAN):
        monkeypatch.setattr(texblocks, "SPAN", span)
        for kind in ("int", "long"):
            got = texblocks.rebuild_from_blocks(table, spark.createDataFrame(blocks, f"doc_id int, start_line {kind}, end_line {kind}, text string"))
            assert rows_of(got, "doc_id", "line_no", "line") == sorted(want, key=repr)
    none = spark.createDataFrame([], "doc_id int, start_line int, end_line int, text string")
    assert texblocks.rebuild_from_blocks(table, none).count() == len(lines)
