"""Whole paths: units through the memory and a translator, and back into documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as T
from lectern.functions.text import cache_key, clean_reply, is_meaningful
from lectern.operators import graph, latex, markdown, memory, styles, texblocks, validate
from lectern.jobs.requests import RequestLog
from lectern.operators.graph import written
from lectern.operators.hot import join_texts
from lectern.sources import documents
from lectern.sources.memory_store import MemoryStore

#: A user's translator: texts in, as many texts out, in order; null for a failure. Or the log of requests that others send.
Translator = Callable[[pd.Series], pd.Series] | RequestLog
#: Units that a translator is called with at most.
BATCH = 256


def _send(texts: pd.Series, translate: Translator) -> list[str | None]:
    """Replies, null for the units that fail: a call that fails is made again in halves, down to single units."""
    try:
        replies = list(translate(texts))
        if len(replies) == len(texts):
            return replies
    except Exception:  # noqa: BLE001  a translator may fail in any way; the source is kept then
        pass
    if len(texts) < 2:
        return [None] * len(texts)
    half = len(texts) // 2
    return _send(texts.iloc[:half], translate) + _send(texts.iloc[half:], translate)


def translate_units(units: DataFrame, translate: Translator, concurrency: int | None = None, batch: int = BATCH) -> DataFrame:
    """units (cache_key, text) with `reply`; null where the translator failed. Blank texts come back as they are.

    Each distinct unit is sent once, `batch` at a time and `concurrency` tasks at once; the replies are written before
    anything is joined to them, so that no stage that runs again calls the translator again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield part.assign(reply=pd.Series(_send(part["text"], translate), index=part.index, dtype="object"))

    live = units.filter(is_meaningful(F.col("text"))).select("cache_key", "text").dropDuplicates(["cache_key"])
    live = live.repartition(concurrency) if concurrency else live
    sent = live.mapInPandas(run, "cache_key string, text string, reply string")
    rest = units.filter(~is_meaningful(F.col("text"))).select("cache_key", "text").dropDuplicates(["cache_key"])
    return written(sent.unionByName(rest.withColumn("reply", F.col("text"))))


def attempts(units: DataFrame, translate: Translator, judge: Callable[[DataFrame], DataFrame], most: int = validate.ATTEMPTS, concurrency: int | None = None) -> DataFrame:
    """(cache_key, text, attempt, reply, failure, status) of up to `most` attempts at each of the units (cache_key, text).

    judge adds `status` to (cache_key, text, reply); units whose status is not final are sent again. With a log of requests
    these are the attempts that it knows of, and those that follow are asked for there.
    """
    columns = ["cache_key", "text", "attempt", "reply", "failure", "status"]
    if isinstance(translate, RequestLog):
        known = written(translate.replies(units, most))
        got = written(judge(known).withColumn("status", F.coalesce("failure", "status")).select(columns))
        translate.ask(units, got, most)
        return got
    left, out = units, None
    for k in range(most):
        got = judge(translate_units(left, translate, concurrency)).withColumns({"attempt": F.lit(k), "failure": F.lit(None).cast("string")}).select(columns)
        out = got if out is None else out.unionByName(got)
        left = got.filter(~validate.is_final(F.col("status"))).select("cache_key", "text")
        if not left.limit(1).count():
            break
    return out


def translate_with_memory(
    units: DataFrame, held: DataFrame | MemoryStore, translate: Translator, model: str, direction: str, now: str, least: int = 0, concurrency: int | None = None, most: int = validate.ATTEMPTS,
    max_days: int | None = memory.MAX_DAYS, max_entries: int | None = None, clean: Callable[[Column], Column] = clean_reply,
) -> tuple[DataFrame, DataFrame | MemoryStore, DataFrame]:
    """(translations, memory, report) of distinct units (text); null texts are no units.

    The memory is aged first. translations: (text, translated, status): from the memory, or the first of `most` attempts
    that passes the checks, else the source. memory: with the new translations; report: hits, misses, total and hit rate,
    entries and bytes of the memory. A memory store is looked up in place, expired entries left out, and gets the new ones
    as a part; max_entries is for tables only. Units that a log of requests waits for have status `open` and their source.
    clean: what is done with a reply before it is checked and taken; lines of Markdown keep their quotes and backticks.
    """
    store = isinstance(held, MemoryStore)
    held = held if store else written(memory.aged(held, now, max_days, max_entries))
    keyed = written(units.select("text").filter("text is not null").distinct().withColumn("cache_key", cache_key(F.col("text"), model, direction)))
    looked = written(held.lookup(keyed, now, max_days)) if store else memory.lookup(keyed, held)
    missed = looked.filter("stored is null").select(keyed.columns) if store else memory.misses(keyed, held)
    judge = lambda got: got.withColumn("status", validate.status(F.col("text"), F.col("reply"), least=least, clean=clean))
    tried = attempts(missed, translate, judge, most, concurrency)
    best = validate.first_valid_attempt(tried.select(F.col("cache_key").alias("unit_id"), "attempt", F.col("text").alias("src"), "reply", "failure"), most, least, clean)
    fine = written(best.select(F.col("unit_id").alias("cache_key"), F.col("final_text").alias("new"), "status"))
    done = looked.join(fine, "cache_key", "left").select("text", F.coalesce("stored", "new", "text").alias("translated"), F.when(F.col("stored").isNotNull(), "stored").otherwise(F.coalesce("status", F.lit("open"))).alias("status"))
    fresh = fine.filter("status = 'ok'").join(keyed, "cache_key").select("cache_key", F.col("text").alias("source"), F.col("new").alias("text"), F.lit(now).alias("ts_raw"))
    if store:
        done, report = written(done), written(memory.stats(looked, held.whole()))
        held.append(fresh)
        return done, held, report
    return written(done), written(memory.merge(held, fresh)), memory.stats(looked, held)


def translate_markdown(docs: DataFrame, held: DataFrame, translate: Translator, model: str, direction: str, now: str, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (doc_id, text), memory, report): lines classified, distinct texts translated, documents put together.

    doc_id must be unique. A null text stays null. Of replies only white space is taken off, as quotes and backticks at the ends
    of a line are Markdown.
    """
    split = markdown.split_frontmatter(docs.select("doc_id", "text"))
    table = written(markdown.classify(markdown.lines(split)))
    done, kept, report = translate_with_memory(table.filter("translatable").select(F.col("stripped").alias("text")), held, translate, model, direction, now, clean=T.strip, **limits)
    bodies = markdown.reassemble(markdown.apply_translations(table, done))
    out = split.select("doc_id", "front").join(bodies, "doc_id", "left").select("doc_id", F.concat("front", F.coalesce("text", F.lit(""))).alias("text"))
    return out, kept, report


def translate_latex(
    docs: DataFrame, held: DataFrame, translate: Translator, model: str, direction: str, now: str, most: int = latex.CHUNK, fonts: str = "", by_chunk: bool = False, **limits
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (doc_id, text), memory, document report): spans protected, chunks translated, spans restored, the class of
    documents that become Chinese converted, with `fonts` before their beginning.

    doc_id must be unique. A null text stays null and has no chunks. by_chunk numbers placeholders chunk by chunk, so that a
    change elsewhere in a document leaves the keys of its other chunks in the memory alone.
    """
    safe = written(latex.protect(docs.select("doc_id", "text")))
    chunks = latex.pack_chunks(safe, most, measure=latex.measured if by_chunk else F.length)
    chunks = written(latex.number_by_chunk(chunks) if by_chunk else chunks)
    done, kept, _ = translate_with_memory(chunks.filter("text <> ''").select("text"), held, translate, model, direction, now, least=validate.SHORT, **limits)
    placed = written(join_texts(chunks.withColumn("k", F.md5("text")), done.select(F.md5("text").alias("k"), "translated", "status"), "k", "doc_id", "left"))
    line = F.coalesce("translated", "text")
    joined = markdown.reassemble(placed.withColumn("line", latex.number_by_document(line, F.col("held")) if by_chunk else line), "chunk_no", "line", "\n\n")
    whole = safe.select("doc_id", "placeholders", F.col("text").isNull().alias("none")).join(joined, "doc_id", "left")
    restored = T.convert_document_class(latex.restore(F.coalesce("text", F.lit("")), F.col("placeholders")), direction, fonts)
    out = whole.select("doc_id", F.when(~F.col("none"), restored).alias("text"))
    return out, kept, document_report(placed, safe, docs, out)


def translate_style_files(docs: DataFrame, translate: Translator, concurrency: int | None = None, most: int = validate.ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, text), report (doc_id, blocks_found, blocks_translated)) of style files (doc_id, text).

    Chinese blocks are sent in groups, numbered; a reply holds their translations under the same numbers, in any order, or
    else as many parts as blocks, parted by ---. Keywords get the space before a command back. A block takes the last
    attempt that has its number; blocks that no attempt has are sent one by one if the last one had a reply, and keep their
    source otherwise, as does a block with a blank reply. Files without Chinese blocks stay as they are; in others, more than
    two blank lines in a row become two.
    """
    blocks = written(texblocks.extract_tex_blocks(docs))
    chinese = written(texblocks.filter_chinese_blocks(blocks))
    groups = written(texblocks.pack_blocks(chinese).withColumn("text", T.number_blocks(F.col("contents"))).withColumn("cache_key", F.md5("text")))
    sizes = groups.select("cache_key", F.size("contents").alias("n")).dropDuplicates(["cache_key"])

    def dealt(n: Column) -> Column:
        """The parts of a reply by the numbers of their blocks, null where it has none."""
        by_place = F.filter(F.transform(F.split("reply", "---", -1), T.strip), lambda x: x != "")
        return F.when(F.col("reply").contains("【块"), T.numbered_parts(F.col("reply"), n)).when(F.size(by_place) == n, by_place).otherwise(F.array_repeat(F.lit(None).cast("string"), n))

    def judge(got: DataFrame) -> DataFrame:
        fits = F.when(F.col("reply").isNull(), "error").when(F.forall(dealt(F.col("n")), lambda x: x.isNotNull()), "ok").otherwise("mismatch")
        return got.join(sizes, "cache_key").withColumn("status", fits)

    tried = attempts(groups.select("cache_key", "text"), translate, judge, most, concurrency)
    judged = written(tried.join(sizes, "cache_key").withColumn("parts", F.transform(dealt(F.col("n")), T.fix_keyword_spacing)))
    waits = F.lit(isinstance(translate, RequestLog)) & (F.count("*") < most)  # for further attempts at the group
    last = judged.groupBy("cache_key").agg(F.max_by("status", "attempt").alias("status"), waits.alias("waits"))
    by_number = judged.select("cache_key", "attempt", F.posexplode("parts").alias("k", "part")).filter("part is not null").groupBy("cache_key", "k").agg(F.max_by("part", "attempt").alias("new"))
    placed = groups.select("doc_id", "cache_key", F.posexplode(F.arrays_zip(F.col("starts").alias("start_line"), F.col("contents").alias("text"))).alias("k", "x")).select("doc_id", "cache_key", "k", "x.*")
    placed = written(placed.join(by_number, ["cache_key", "k"], "left").join(last, "cache_key", "left"))
    whole = placed.filter("new is not null").select("doc_id", "start_line", "new")
    single = placed.filter("new is null and status = 'mismatch' and not waits").select("doc_id", "start_line", "text")
    single = written(single.withColumn("cache_key", F.md5("text")))
    alone = attempts(single.select("cache_key", "text").distinct(), translate, lambda got: got.withColumn("status", F.lit("ok")), 1, concurrency)
    alone = alone.select("cache_key", F.nullif(T.strip(F.col("reply")), F.lit("")).alias("new"))
    new = written(whole.unionByName(single.join(alone, "cache_key").filter("new is not null").select("doc_id", "start_line", "new")))
    translated = chinese.select("doc_id", "start_line", "end_line").join(new, ["doc_id", "start_line"]).select("doc_id", "start_line", "end_line", F.col("new").alias("text"))
    found = chinese.groupBy("doc_id").agg(F.count("*").alias("found"))
    lines = markdown.lines(docs.join(found.select("doc_id"), "doc_id", "left_semi"), text_col="text")
    rebuilt = markdown.reassemble(texblocks.rebuild_from_blocks(lines, translated)).select("doc_id", T.collapse_blank_lines(F.col("text")).alias("new"))
    out = docs.select("doc_id", "text").join(rebuilt, "doc_id", "left").select("doc_id", F.coalesce("new", "text").alias("text"))
    counts = docs.select("doc_id").join(found, "doc_id", "left").join(new.groupBy("doc_id").agg(F.count("*").alias("done")), "doc_id", "left")
    return out, counts.select("doc_id", F.coalesce("found", F.lit(0)).alias("blocks_found"), F.coalesce("done", F.lit(0)).alias("blocks_translated"))


def translate_project(
    files: DataFrame, mains: DataFrame, held: DataFrame, translate: Translator, model: str, direction: str, now: str, style_files: bool = False, fonts: str = "", **limits
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files (path, text, action), memory, report (project, succeeded, total, ok)) of projects with main files `mains` (path).

    files: (path, text) of all projects. Translated is what each main file reaches by input and include, and, if asked
    for, the classes and packages that it reaches; project files that are neither hidden nor products of a build are
    copied. Included files are sought beside the file that names them, classes and packages in the folder of the main
    file. A file that several projects reach is translated once. A translated file without a text has not succeeded.
    """
    listing = files.select(F.col("path").alias("node"))
    named = files.select("path", F.col("text").alias("content"))
    is_style = F.lower("path").rlike(r"\.(cls|sty)\z")

    roots = mains.select(F.col("path").alias("node")).join(listing, "node", "left_semi")
    edges = graph.resolve_refs(graph.file_refs(named.filter(~is_style)), files.select("path")).filter("found").select("src", "dst")
    tex = written(graph.closure(roots, edges, listing).select("root", F.col("node").alias("path")))
    known = written(tex.select("root", "path", F.lit("tex").alias("kind")))
    if style_files:
        sheets = graph.style_reach(tex.select("root", F.col("path").alias("node")), graph.style_refs(named), files.select("path"))
        sheets = sheets.withColumnRenamed("node", "path").join(tex, ["root", "path"], "left_anti").filter(is_style)
        known = known.unionByName(sheets.select("root", "path", F.lit("style").alias("kind")))
    chosen = written(files.join(known.select("path", "kind").distinct(), "path").select(F.col("path").alias("doc_id"), "text", "kind"))
    texts, kept, _ = translate_latex(chosen.filter("kind = 'tex'").select("doc_id", "text"), held, translate, model, direction, now, fonts=fonts, **limits)
    sheets, _ = translate_style_files(chosen.filter("kind = 'style'").select("doc_id", "text"), translate)
    done = written(texts.unionByName(sheets).select(F.col("doc_id").alias("path"), "text"))
    copied = graph.keep_project_files(files.join(done.select("path"), "path", "left_anti")).select("path", "text", F.lit("copy").alias("action"))
    out = done.select("path", "text", F.lit("translate").alias("action")).unionByName(copied)
    states = known.join(done.select("path", F.col("text").isNotNull().alias("ok")), "path").select(F.col("root").alias("project"), "ok")
    return out, kept, graph.project_report(states)


def translate_docx(
    packages: DataFrame, held: DataFrame, translate: Translator, model: str, direction: str, now: str, font_table: bytes | None = None, style_sheet: bytes | None = None,
    materialize: bool | None = None, fonts: tuple[str, str] | None = None, languages: tuple[str, str] | None = None, **limits,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages (path, content, status), memory, report) of Word packages (path, content).

    Neighbouring runs of equal properties, and all runs of a hyperlink, make a segment; the segments of a paragraph go to
    the translator as one text, with marks between and placeholders for drawings and formulas. Replies come back segment
    by segment into the first run of each, the others go; a segment whose part of the reply is missing or blank, and a
    paragraph whose reply has more parts than segments, keep their source.

    materialize writes what runs inherit from the package's own styles into the runs and takes their run styles off, so
    that another style sheet doesn't change their looks; that is done where a style sheet is given, unless asked otherwise.
    fonts and languages (Latin, East Asian) are set with it. status: ok, partial (a text that was to be translated kept its
    source) or bad_package (can't be opened, comes back as it is).
    """
    parts = written(documents.explode_docx_parts(packages))
    sheeted = style_sheet is not None if materialize is None else materialize
    every, properties = documents.parse_docx_runs(parts.filter("action = 'process'"), formulas=sheeted), None
    runs = every
    if sheeted:
        every, sheet = written(every), written(documents.parse_docx_styles(parts))
        runs = every.filter("kind <> 'math_run'")
        properties = styles.inherited_properties(every, styles.resolve_styles(sheet, "xml", "map<string,string>"), fonts, languages)
        plain = styles.materialize_run_styles(runs.filter("kind = 'run'"), styles.resolve_styles(sheet))
        runs = plain.select(runs.columns).unionByName(runs.filter("kind <> 'run'"))
    para = ["path", "part_name", "para_no"]
    keyed = runs.select(*para, "run_no", styles.run_key().alias("style_key"), "special", "text")
    asked = written(styles.segment_lists(styles.merge_adjacent_runs(keyed, para), para))
    done, kept, report = translate_with_memory(asked.select(F.col("text_for_model").alias("text")), held, translate, model, direction, now, **limits)
    replies = join_texts(asked.select(*para, "segs", F.md5("text_for_model").alias("k")), done.select(F.md5("text").alias("k"), F.col("translated").alias("reply"), "status"), "k", "path")
    fits = F.size(F.split("reply", T.SEGMENT, -1)) <= F.size("segs")
    changes, stays = styles.segment_changes(F.col("segs"), F.col("reply"))
    failed = ~fits | stays | ~F.col("status").isin("ok", "stored", "passthrough")
    placed = written(replies.select(*para, F.when(fits, changes).alias("changes"), failed.alias("failed")))
    each = placed.select(*para, F.explode("changes").alias("x"))
    texts = each.select(*para, F.posexplode("x.runs").alias("k", "run_no"), F.col("x.text").alias("text")).select(*para, "run_no", F.when(F.col("k") == 0, F.col("text")).alias("text"))
    made = documents.assemble_docx(parts, texts, font_table, style_sheet, properties)
    failed = placed.filter("failed").select("path").distinct().withColumn("failed", F.lit(True))
    made = made.join(failed, "path", "left").select("path", "content", F.when(F.col("failed"), "partial").otherwise("ok").alias("status"))
    bad = parts.filter("status <> 'ok'").select("path", F.col("part_bytes").alias("content"), "status")
    return made.unionByName(bad), kept, report


def document_report(chunks: DataFrame, safe: DataFrame, docs: DataFrame, out: DataFrame) -> DataFrame:
    """(doc_id, chunks, hits, hit_rate, failed, placeholders, ratio): failed lists the positions that kept their source.

    A document without a text has no chunks, no ratio and a rate of 0.
    """
    hit: Column = F.col("status") == "stored"
    failed = F.array_sort(F.collect_list(F.when(~F.col("status").isin("ok", "stored", "passthrough"), F.col("chunk_no"))))
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(hit).alias("hits"), failed.alias("failed"))
    sizes = docs.select("doc_id", F.length("text").alias("n_in")).join(out.select("doc_id", F.length("text").alias("n_out")), "doc_id")
    both = sizes.join(per, "doc_id", "left").join(safe.select("doc_id", F.coalesce(F.size("placeholders"), F.lit(0)).alias("placeholders")), "doc_id")
    rate = F.coalesce(F.round(100 * F.try_divide("hits", "chunks"), 1), F.lit(0.0))
    none = F.array().cast("array<int>")
    return both.select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("hits", F.lit(0)).alias("hits"), rate.alias("hit_rate"), F.coalesce("failed", none).alias("failed"), "placeholders", F.try_divide("n_out", "n_in").alias("ratio"))
