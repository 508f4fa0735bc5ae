"""Registered queries of the translation operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.functions import text as T
from lectern.jobs import translate
from lectern.jobs.fixtures import duck, view
from lectern.operators import graph, latex, markdown, memory, styles, texblocks, validate

MODEL, DIRECTION, NOW = "m", "en-to-zh", "2024-05-01"
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_s = STRIP.format("line")
RULE = rf"""case when {_s} = '' then 'blank' when starts_with({_s}, '```') then 'fence' when starts_with(line, '    ') or starts_with(line, chr(9)) then 'indented'
  when regexp_matches({_s}, '^</?[a-zA-Z][^>]*>$') then 'tag' when regexp_matches({_s}, '^\|\s*-+(\s*\|\s*-+)*\s*\|?\s*$') then 'table_rule'
  when {_s} = '---' then 'frontmatter_mark' when regexp_matches({_s}, '^[a-zA-Z_][a-zA-Z0-9_]*\s*:\s*[^|]*$') then 'key_value' end"""
CLASSIFIED = f"""c0 as (select *, starts_with({_s}, '```') fence from md_lines_v),
  c1 as (select *, coalesce(sum(fence::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 and not fence in_code from c0),
  c2 as (select *, case when in_code then 'code' else {RULE} end as rule, {_s} stripped, (length(line) - length(regexp_replace(line, '^\\s+', '')))::int indent from c1)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.classify(view(spark, sf_dir, "md_lines_v"))


@query(duck(f"+ {CLASSIFIED} select doc_id, line_no, rule from c2", "md_lines_v"))
def classify_markdown_line(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "line_no", "rule")


@query(duck(f"+ {CLASSIFIED} select doc_id, line_no, fence, in_code from c2", "md_lines_v"))
def code_fence_state(spark, sf_dir):
    return markdown.code_fence_state(view(spark, sf_dir, "md_lines_v")).select("doc_id", "line_no", "fence", "in_code")


@query(duck(f"+ {CLASSIFIED} select doc_id, line_no, stripped, indent from c2 where rule is null", "md_lines_v"))
def markdown_segments(spark, sf_dir):
    return markdown.segments(view(spark, sf_dir, "md_lines_v")).select("doc_id", "line_no", "stripped", "indent")


@query(duck(f"""+ {CLASSIFIED}, u as (select doc_id, stripped, count(*) n from c2 where rule is null group by all)
  select doc_id, sum(n)::bigint n_lines, count(*) n_texts, 100.0 * (sum(n) - count(*)) / sum(n) saved from u group by doc_id""", "md_lines_v"))
def dedupe_units(spark, sf_dir):
    """Flagship: lines to translate in each document, distinct ones, and the share that is saved by taking each once."""
    units = markdown.dedupe_units(markdown.segments(view(spark, sf_dir, "md_lines_v")))
    totals = units.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_texts"))
    return totals.withColumn("saved", F.lit(100.0) * (F.col("n_lines") - F.col("n_texts")) / F.col("n_lines"))


@query(duck(f"+ {CLASSIFIED}, k as (select md5(stripped || '|m|en-to-zh') cache_key, count(*) n, count(distinct doc_id) docs from c2 where rule is null group by stripped) select * from k", "md_lines_v"))
def cache_key(spark, sf_dir):
    found = markdown.segments(view(spark, sf_dir, "md_lines_v"))
    return found.groupBy(T.cache_key(F.col("stripped"), MODEL, DIRECTION).alias("cache_key")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


FRONT = "(select doc_id, case when doc_id%4=0 then '---'||chr(10)||'title: x'||chr(10)||'---'||chr(10)||text else text end as text from documents)"


@query(rf"with d as {FRONT}, f as (select *, regexp_extract(text, '(?s)\A(---\n.*?\n---\n)', 1) front from d) select doc_id, front, md5(substr(text, length(front) + 1)) body_md5 from f")
def split_frontmatter(spark, sf_dir):
    docs = spark.sql(FRONT[1:-1].replace("from documents", "from {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return markdown.split_frontmatter(docs).select("doc_id", "front", F.md5("body").alias("body_md5"))


APPLIED = f"""{CLASSIFIED}, u as (select distinct doc_id, stripped from c2 where rule is null),
  a as (select c.doc_id, c.line_no, case when u.stripped is not null and not fence and not in_code then repeat(' ', indent) || 'T:' || c.stripped else line end line, c.line old, c.rule
    from c2 c left join u on c.doc_id = u.doc_id and c.stripped = u.stripped)"""


def _applied(spark, sf_dir):
    table = _classified(spark, sf_dir)
    texts = table.filter("translatable").select(F.col("stripped").alias("text")).distinct()
    return table, markdown.apply_translations(table, texts.withColumn("translated", F.concat(F.lit("T:"), "text")))


@query(duck(f"+ {APPLIED} select doc_id, line_no, line from a", "md_lines_v"))
def apply_line_translations(spark, sf_dir):
    return _applied(spark, sf_dir)[1]


@query(duck(f"+ {APPLIED} select doc_id, md5(string_agg(line, chr(10) order by line_no)) text_md5 from a group by doc_id", "md_lines_v"))
def reassemble(spark, sf_dir):
    return markdown.reassemble(_applied(spark, sf_dir)[1]).select("doc_id", F.md5("text").alias("text_md5"))


@query(duck(f"+ {APPLIED} select doc_id, count(*) filter (line <> old) replaced, count(*) filter (rule is null and line = old) unchanged from a group by doc_id", "md_lines_v"))
def replacement_report(spark, sf_dir):
    return markdown.replacement_report(*_applied(spark, sf_dir))


@query(duck(r"""select doc_id, line_no, regexp_matches(line, '[\p{L}\p{N}]') is_meaningful, regexp_matches(regexp_replace(line, '(?m)%.*$', '', 'g'), '[一-鿿]') has_chinese,
  starts_with(line, ' ') or ends_with(line, ' ') needs_mark from cls_lines_v""", "cls_lines_v"))
def is_meaningful_text(spark, sf_dir):
    line = F.col("line")
    return view(spark, sf_dir, "cls_lines_v").select("doc_id", "line_no", T.is_meaningful(line).alias("is_meaningful"), T.has_chinese(line).alias("has_chinese"), T.needs_space_mark(line).alias("needs_mark"))


# -- memory


def _units(spark, sf_dir):
    lines = view(spark, sf_dir, "lines_v").filter("line <> ''").select(F.col("line").alias("text")).distinct()
    return lines.withColumn("cache_key", T.cache_key(F.col("text"), MODEL, DIRECTION))


def _memory(spark, sf_dir):
    return view(spark, sf_dir, "tm_v").withColumnRenamed("txt", "text")


UNITS = "u as (select distinct line as text, md5(line || '|m|en-to-zh') cache_key from lines_v where line <> '')"
LOOKED = f"{UNITS}, l as (select u.*, nullif(t.txt, '') stored from u left join tm_v t using (cache_key))"


@query(duck(f"+ {LOOKED} select cache_key, stored from l", "tm_v"))
def tm_lookup(spark, sf_dir):
    return memory.lookup(_units(spark, sf_dir), _memory(spark, sf_dir)).select("cache_key", "stored")


@query(duck(f"+ {LOOKED} select distinct cache_key from l where stored is null", "tm_v"))
def tm_misses(spark, sf_dir):
    return memory.misses(_units(spark, sf_dir), _memory(spark, sf_dir)).select("cache_key")


@query(duck(f"""+ {LOOKED} select count(stored) hits, count(*) - count(stored) misses, count(*) total, round(100.0 * count(stored) / count(*), 1) hit_rate,
  (select count(*) from tm_v) entries, (select sum(strlen(cache_key) + strlen(txt) + strlen(ts_raw))::bigint from tm_v) bytes from l""", "tm_v"))
def tm_stats(spark, sf_dir):
    return memory.stats(memory.lookup(_units(spark, sf_dir), _memory(spark, sf_dir)), _memory(spark, sf_dir))


@query(duck(f"""+ {LOOKED}, f as (select cache_key, 'T:' || text as txt, '2024-05-01' ts_raw, 1 w from l where stored is null and length(text) <= 20000 and length(text) + 2 <= 20000),
  m as (select *, 0 w from tm_v union all select * from f) select cache_key, arg_max(txt, w) as text, arg_max(ts_raw, w) ts_raw from m group by cache_key""", "tm_v"))
def tm_merge(spark, sf_dir):
    held = _memory(spark, sf_dir)
    fresh = memory.misses(_units(spark, sf_dir), held).select("cache_key", F.col("text").alias("source"), F.concat(F.lit("T:"), "text").alias("text"), F.lit(NOW).alias("ts_raw"))
    return memory.merge(held, fresh)


@query(duck("select cache_key from tm_v where try_cast(ts_raw as timestamp) is null or try_cast(ts_raw as timestamp) >= timestamp '2024-05-01' - interval 30 day", "tm_v"))
def tm_expire(spark, sf_dir):
    return memory.expire(_memory(spark, sf_dir), NOW, 30).select("cache_key")


@query(duck("select cache_key, ts_raw from tm_v order by ts_raw desc, cache_key limit 1000", "tm_v"))
def tm_evict(spark, sf_dir):
    return memory.evict(_memory(spark, sf_dir), 1000).select("cache_key", "ts_raw")


@query(duck("""+ d as (select floor((epoch(timestamp '2024-05-01') - epoch(try_cast(ts_raw as timestamp))) / 86400) d from tm_v),
  a as (select case when d is null then 'Unknown' when d = 0 then 'Today' when d <= 7 then 'This week' when d <= 30 then 'This month' when d <= 90 then 'Last 3 months' else 'Older' end age, count(*) n from d group by 1)
  select age, n, round(100.0 * n / sum(n) over (), 1) percent from a""", "tm_v"))
def tm_age_distribution(spark, sf_dir):
    return memory.age_distribution(_memory(spark, sf_dir), NOW)


# -- replies

REFUSED = " or ".join("contains(lower(trim(c)), '" + p.replace("'", "''") + "')" for p in T.REFUSALS)
CLEAN = rf"""regexp_replace(regexp_replace({STRIP.format("reply")}, '^[ "''`]+', ''), '[ "''`]+$', '')"""
CHECKS = rf"""c as (select *, coalesce({CLEAN}, '') c from replies_v), k as (select *, length(c) < 50 and ({REFUSED}) refusal, contains(c, 'You are a professional translation engine') or contains(c, 'CRITICAL RULES') echo,
  len(regexp_extract_all(src, '<placeholder>')) = len(regexp_extract_all(c, '<\s*placeholder\s*[,>]')) parity from c),
  v as (select *, case when reply is null then 'error' when c = '' then 'empty' when refusal then 'refusal' when echo then 'echo' when not parity then 'mismatch' else 'ok' end as status from k)"""


@query(duck(f"+ {CHECKS} select unit_id, attempt, refusal, echo, parity, length(c) < 10 short, status from v", "replies_v"))
def validate_translations(spark, sf_dir):
    """Refusals, echoes, placeholder parity, short replies and the verdict of each reply."""
    src, reply = F.col("src"), F.col("reply")
    clean = T.clean_reply(reply)
    return view(spark, sf_dir, "replies_v").select(
        "unit_id", "attempt", validate.is_refusal(clean).alias("refusal"), validate.is_echo(clean).alias("echo"), validate.placeholders_match(src, clean).alias("parity"), validate.is_short(clean).alias("short"), validate.status(src, reply).alias("status")
    )


@query(duck(rf"""+ {CHECKS}, e as (select unit_id, min(attempt) filter (status in ('ok', 'refusal')) a, arg_max(status, attempt) last, any_value(src) src from v group by unit_id),
  j as (select e.*, v.status s, v.c from e left join v on v.unit_id = e.unit_id and v.attempt = e.a)
  select unit_id, case when s = 'ok' then a end attempt, coalesce(s, last) as status,
  case when s = 'ok' then c else src end final_text from j""", "replies_v"))
def first_valid_attempt(spark, sf_dir):
    return validate.first_valid_attempt(view(spark, sf_dir, "replies_v"))


@query(duck(r"""select unit_id, attempt, len(string_split(reply, 'r')) = 2 segments_ok, len(list_filter(string_split(reply, '---'), lambda x: trim(x) <> '')) = 1 blocks_ok from replies_v""", "replies_v"))
def separator_parity(spark, sf_dir):
    """Parts of a reply against the number of segments and of blocks; the view has no segment mark, so r stands for it."""
    reply = F.replace(F.col("reply"), F.lit("r"), F.lit(T.SEGMENT))
    return view(spark, sf_dir, "replies_v").select("unit_id", "attempt", validate.segments_match(reply, F.lit(2)).alias("segments_ok"), validate.blocks_match(F.col("reply"), F.lit(1)).alias("blocks_ok"))


@query(duck(r"""+ r as (select *, case when attempt = 1 and unit_id % 5 = 0 then 500 else 200 end code from replies_v)
  select unit_id, attempt, case when code <> 200 then 'http_error' when unit_id % 11 = 0 then 'api_error' when unit_id % 13 = 0 then 'no_choices' else 'ok' end outcome,
  case when unit_id % 11 <> 0 and unit_id % 13 <> 0 then trim(reply) end reply, unit_id % 11 <> 0 and unit_id % 13 <> 0 and attempt = 2 truncated,
  case when unit_id % 11 <> 0 then length(reply)::bigint end total_tokens from r""", "replies_v"))
def parse_responses(spark, sf_dir):
    reply = view(spark, sf_dir, "replies_v")
    choice = F.struct(F.struct(F.col("reply").alias("content")).alias("message"), F.when(F.col("attempt") == 2, "length").otherwise("stop").alias("finish_reason"))
    usage = F.struct(F.length("reply").alias("total_tokens")).alias("usage")
    body = F.when(F.col("unit_id") % 11 == 0, F.lit('{"error": "quota"}')).when(F.col("unit_id") % 13 == 0, F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), usage))).otherwise(F.to_json(F.struct(F.array(choice).alias("choices"), usage)))
    code = F.when((F.col("attempt") == 1) & (F.col("unit_id") % 5 == 0), 500).otherwise(200)
    return validate.parse_responses(reply.select("unit_id", "attempt", code.alias("status_code"), body.alias("body")))


@query(duck(r"""select md5(line) unit_id, 2 * length(line) max_tokens, 'user' role, md5(line) content_md5 from (select distinct line from lines_v where line <> '')""", "lines_v"))
def emit_requests(spark, sf_dir):
    units = view(spark, sf_dir, "lines_v").filter("line <> ''").select(F.md5("line").alias("unit_id"), F.col("line").alias("text")).distinct()
    made = validate.emit_requests(units, MODEL, "Translate.", 0.1, "latex")
    r = F.from_json("request", "messages array<struct<role:string,content:string>>, max_tokens long")
    return made.select("unit_id", r["max_tokens"].alias("max_tokens"), r["messages"][1]["role"].alias("role"), F.md5(r["messages"][1]["content"]).alias("content_md5"))


# -- LaTeX


def _tex(spark, sf_dir):
    return markdown.reassemble(view(spark, sf_dir, "tex_lines_v"), separator="\n\n")


TEX = "t as (select doc_id, string_agg(line, chr(10)||chr(10) order by line_no) as text from tex_lines_v group by doc_id)"


#: Placeholders by the rules of the view: its documents hold no command but those of lines 0, 1 and 2 of six.
GUARDED = """g0 as (select *, case line_no%6 when 0 then 1 when 1 then 2 when 2 then 2 end k from tex_lines_v),
  g1 as (select *, row_number() over (partition by doc_id, k order by line_no desc) pos, count(*) filter (k = 1) over (partition by doc_id) c, count(*) filter (k = 2) over (partition by doc_id) r,
    row_number() over (partition by doc_id, line_no%6 order by line_no desc) nth from g0),
  guarded as (select doc_id, line_no, line raw, case line_no%6 when 0 then '<CITE_' || pos || '>' || substr(line, strpos(line, '}') + 1) when 1 then 'See <REF_' || (c + pos) || '>' || substr(line, strpos(line, '}') + 1)
    when 2 then '<NEWCOMMAND_' || (c + r + nth) || '>' else line end line, line_no%6 = 0 or line_no%6 = 1 or line_no%6 = 2 marked, line_no%6 = 2 twice from g1)"""


@query(duck(f"""+ {GUARDED} select doc_id, (count(*) filter (marked) + count(*) filter (twice))::int n, md5(string_agg(line, chr(10)||chr(10) order by line_no)) protected_md5, true restored from guarded group by doc_id""", "tex_lines_v"))
def protect_latex(spark, sf_dir):
    """Placeholders of each document and whether they restore it."""
    whole = _tex(spark, sf_dir).withColumn("before", F.col("text"))
    made = latex.protect(whole)
    return made.select("doc_id", F.size("placeholders").alias("n"), F.md5("text").alias("protected_md5"), (latex.restore(F.col("text"), F.col("placeholders")) == F.col("before")).alias("restored"))


@query(duck("select doc_id, md5(string_agg(line, chr(10)||chr(10) order by line_no)) text_md5 from tex_lines_v group by doc_id", "tex_lines_v"))
def restore_latex(spark, sf_dir):
    made = latex.protect(_tex(spark, sf_dir))
    return made.select("doc_id", F.md5(latex.restore(F.col("text"), F.col("placeholders"))).alias("text_md5"))


@query(duck(rf"+ {TEX}, p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') ps from t) select doc_id, len(ps)::int n, md5(array_to_string(ps, '|')) all_md5 from p", "tex_lines_v"))
def split_paragraphs(spark, sf_dir):
    p = latex.paragraphs(F.col("text"))
    return _tex(spark, sf_dir).select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("all_md5"))


@query(duck(r"""+ s as (select doc_id, line_no, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ss from lines_v)
  select doc_id, line_no, len(ss)::int n, md5(array_to_string(ss, '|')) all_md5 from s""", "lines_v"))
def split_sentences(spark, sf_dir):
    s = latex.sentences(F.col("line"))
    return view(spark, sf_dir, "lines_v").select("doc_id", "line_no", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("all_md5"))


def packed(table: str) -> str:
    """SQL of the chunks (doc_id, chunk_no, text) of the lines in a table, each a paragraph: items are whole paragraphs, or the
    sentences of those that are too long, and a walk over the items of a document keeps the open chunk."""
    fits = "length(w.cur) + length(x) + case when long then 0 else 2 end < 1500"
    blank, tight = STRIP.format("line"), r"regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g')"
    return rf"""p0 as (select doc_id, line_no, {blank} p from {table}), p1 as (select * from p0 where p <> ''),
  i0 as (select doc_id, line_no, length(p) > 1500 long, unnest(case when length(p) > 1500 then string_split({tight}, chr(1)) else [p] end) x, generate_subscripts(case when length(p) > 1500 then string_split({tight}, chr(1)) else [p] end, 1) k from p1),
  i1 as (select *, row_number() over (partition by doc_id order by line_no, k) i from i0),
  walk(doc_id, i, cur, closed) as (select distinct doc_id, 0::bigint, '', null::varchar from {table} union all
    select w.doc_id, n.i, case when {fits} and w.cur <> '' and not (long and k = 1) then w.cur || (case when long then ' ' else chr(10)||chr(10) end) || x else x end,
      case when (not ({fits}) or long and k = 1) and w.cur <> '' then w.cur end
    from walk w join i1 n on n.doc_id = w.doc_id and n.i = w.i + 1),
  last as (select doc_id, arg_max(cur, i) cur, max(i) i from walk group by doc_id),
  outs as (select doc_id, i, closed as text from walk where closed is not null union all select doc_id, i + 1, cur from last where cur <> '' or i = 0),
  chunks as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int chunk_no, text from outs)"""


@query(duck(f"+ {packed('tex_lines_v')} select doc_id, chunk_no, length(text)::int n_chars, md5(text) text_md5 from chunks", "tex_lines_v", recursive=True))
def pack_chunks(spark, sf_dir):
    return latex.pack_chunks(_tex(spark, sf_dir)).select("doc_id", "chunk_no", "n_chars", F.md5("text").alias("text_md5"))


@query(duck(rf"""+ {GUARDED}, bare as (select doc_id, line_no, regexp_replace(line, '<([A-Z]+)_[0-9]+>', '<\1_>') line from guarded), {packed('bare')},
  cut as (select *, string_split(text, '_>') ps from chunks), named as (select *, array_to_string(list_transform(ps, lambda x, i: case when i < len(ps) then x || '_' || i || '>' else x end), '') local from cut)
  select doc_id, chunk_no, md5(local || '|m|en-to-zh') cache_key, len(ps)::int - 1 n, true back from named""", "tex_lines_v", recursive=True))
def protect_latex_by_chunk(spark, sf_dir):
    """Keys of chunks whose placeholders are numbered in the chunk, and whether the document's numbers come back."""
    chunks = latex.pack_chunks(graph.written(latex.protect(_tex(spark, sf_dir))), measure=latex.measured).withColumn("before", F.col("text"))
    local = latex.number_by_chunk(chunks)
    back = latex.number_by_document(F.col("text"), F.col("held")) == F.col("before")
    return local.select("doc_id", "chunk_no", T.cache_key(F.col("text"), MODEL, DIRECTION).alias("cache_key"), F.size("held").alias("n"), back.alias("back"))


SPANS = r"""o as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint off from cls_lines_v),
  c as (select doc_id, off, line, regexp_extract(line, '%\s*(.+)$', 1) as text, 'comment' span_type from o),
  b as (select doc_id, off, line, unnest(regexp_extract_all(line, '\{([^}]+)\}', 1)) as text, 'chinese_string' span_type from o),
  spans as (select doc_id, off + length(line) - length(text) start, off + length(line) stop, text, span_type from c where regexp_matches(text, '[一-鿿]') union all
  select doc_id, off + strpos(line, '{' || text || '}'), off + strpos(line, '{' || text || '}') + length(text), text, span_type from b where regexp_matches(text, '[一-鿿]') and not contains(text, chr(92)))"""


@query(duck(f"+ {SPANS} select * from spans", "cls_lines_v"))
def style_file_spans(spark, sf_dir):
    return latex.style_file_spans(view(spark, sf_dir, "cls_lines_v"))


@query(duck(f"""+ {SPANS}, n as (select *, row_number() over (partition by doc_id order by start, span_type, text) - 1 rn from spans)
  select doc_id, floor(rn / 20)::bigint chunk_no, md5(string_agg('[' || span_type || '] ' || text, chr(10) order by rn)) text_md5 from n group by all""", "cls_lines_v"))
def pack_fixed(spark, sf_dir):
    return latex.pack_fixed(latex.style_file_spans(view(spark, sf_dir, "cls_lines_v"))).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def _blocks(spark, sf_dir):
    lines = view(spark, sf_dir, "cls_lines_v")
    return lines, texblocks.extract_tex_blocks(markdown.reassemble(lines))


#: Blocks by the rules of the view: definitions on lines 0 and 1 of nine, a command over lines 3 and 4, single ones on 5, 6 and 8.
BLOCKS = rf"""b0 as (select *, lead(line) over (partition by doc_id order by line_no) after from cls_lines_v),
  blocks as (select doc_id, line_no start_line, case when line_no%9 in (0, 3) and after is not null then line_no + 1 else line_no end::int end_line,
    case line_no%9 when 0 then 'def_block' when 3 then 'command_definition' when 5 then 'theorem_definition' when 6 then 'format_command' else 'text' end block_type,
    case when line_no%9 in (0, 3) and after is not null then line || chr(10) || after else line end as content
    from b0 where line_no%9 in (0, 3, 5, 6) or line_no%9 = 8 and {STRIP.format("line")} <> '' and not starts_with({STRIP.format("line")}, '%')),
  chinese as (select * from blocks where regexp_matches(regexp_replace(content, '(?m)%.*$', '', 'g'), '[一-鿿]'))"""


@query(duck(f"+ {BLOCKS} select * from blocks", "cls_lines_v"))
def extract_tex_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)[1]


@query(duck(f"+ {BLOCKS} select doc_id, start_line, block_type from chinese", "cls_lines_v"))
def filter_chinese_blocks(spark, sf_dir):
    return texblocks.filter_chinese_blocks(_blocks(spark, sf_dir)[1]).select("doc_id", "start_line", "block_type")


@query(duck(f"""+ {BLOCKS}, n as (select *, row_number() over (partition by doc_id order by start_line) i, length(content) * 1.5 own from chinese),
  walk(doc_id, i, start_line, g, total) as (select doc_id, i, start_line, 0, own from n where i = 1 union all
    select n.doc_id, n.i, n.start_line, case when total + own > 40 and total > 0 then g + 1 else g end, case when total + own > 40 and total > 0 then own else total + own end from walk w join n on n.doc_id = w.doc_id and n.i = w.i + 1)
  select doc_id, g group_no, list(start_line order by start_line)::varchar starts from walk group by all""", "cls_lines_v", recursive=True))
def pack_blocks(spark, sf_dir):
    """Groups of 40 instead of 2000, so that there are several in a file."""
    packed = texblocks.pack_blocks(texblocks.filter_chinese_blocks(_blocks(spark, sf_dir)[1]), 40)
    return packed.select("doc_id", "group_no", F.concat(F.lit("["), F.array_join("starts", ", "), F.lit("]")).alias("starts"))


@query(duck("select doc_id, line_no, line from cls_lines_v", "cls_lines_v"))
def rebuild_from_blocks(spark, sf_dir):
    """Blocks put back as they were give the file's lines again."""
    lines, blocks = _blocks(spark, sf_dir)
    rebuilt = texblocks.rebuild_from_blocks(lines, blocks.withColumnRenamed("content", "text"))
    return rebuilt.select("doc_id", "line_no", F.posexplode(F.split("line", "\n", -1)).alias("k", "one")).select("doc_id", (F.col("line_no") + F.col("k")).alias("line_no"), F.col("one").alias("line"))


# -- files


@query(duck("""+ r(root, node) as (select min(s_suppkey), min(s_suppkey) from supplier union select root, dst from r join file_edges_v on src = node where dst in (select file_id from file_listing_v))
  select root, node from r""", "file_edges_v", "file_listing_v", recursive=True))
def include_closure(spark, sf_dir):
    listing = view(spark, sf_dir, "file_listing_v").select(F.col("file_id").alias("node"))
    roots = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.min("s_suppkey").alias("node"))
    return graph.closure(roots, view(spark, sf_dir, "file_edges_v"), listing).select("root", "node")


@query(duck("""select distinct src, 'd/f' || dst || case when dst%3 = 0 then '.v2' else '' end || '.tex' dst, dst%3 <> 0 and dst in (select file_id from file_listing_v) found from file_edges_v""", "file_edges_v", "file_listing_v"))
def resolve_file_refs(spark, sf_dir):
    """Every third name has a dot in it, every second one spaces around it or its extension."""
    dst = F.col("dst").cast("string")
    name = F.concat(F.lit("f"), dst, F.when(F.col("dst") % 3 == 0, ".v2").otherwise(""))
    shown = F.when(F.col("dst") % 2 == 0, F.concat(F.lit(" "), name, F.lit(" "))).otherwise(F.concat(name, F.lit(".tex")))
    files = view(spark, sf_dir, "file_edges_v").groupBy("src").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("\\input{"), shown, F.lit("}")))).alias("content"))
    refs = graph.file_refs(files.withColumn("path", F.concat(F.lit("d/"), F.col("src").cast("string"))))
    listing = view(spark, sf_dir, "file_listing_v").select(F.concat(F.lit("d/f"), F.col("file_id"), F.lit(".tex")).alias("path"))
    return graph.resolve_refs(refs, listing).select(F.substring("src", 3, 20).cast("long").alias("src"), "dst", "found").distinct()


ENDS = " or ".join(f"ends_with(lower(path), '{e}')" for e in graph.EXCLUDED_ENDS)
KEPT = f"p as (select * from project_files_v where not regexp_matches(path, '(^|/)({'|'.join(graph.EXCLUDED_DIRS)}|\\.[^/]*)/') and not regexp_matches(path, '(^|/)\\.[^/]*$') and not ({ENDS}))"


@query(duck(f"+ {KEPT} select page_id, path from p", "project_files_v"))
def project_file_filter(spark, sf_dir):
    return graph.keep_project_files(view(spark, sf_dir, "project_files_v"))


@query(duck(r"""+ e as (select lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) e from project_files_v) select case when e = '' then '(no extension)' else e end ext, count(*) n from e group by 1 order by n desc, ext limit 15""", "project_files_v"))
def file_type_counts(spark, sf_dir):
    return graph.file_type_counts(view(spark, sf_dir, "project_files_v"))


@query(duck(r"""select page_id, case when regexp_matches(lower(path), '\.(cls|sty)$') then regexp_replace(path, '(\.[^./]+)$', '_en\1')
  else regexp_extract(path, '^(.*?)(\.[^./]+)?$', 1) || '_translated_en-to-zh' || regexp_extract(path, '(\.[^./]+)$', 1) end target, ltrim(lower(regexp_extract(path, '(\.[^./]+)$', 1)), '.') in ('docx', 'md', 'tex', 'cls', 'sty') supported from project_files_v""", "project_files_v"))
def output_paths(spark, sf_dir):
    """Target of every file, and whether its format is supported."""
    known, others = graph.route_by_format(view(spark, sf_dir, "project_files_v"))
    both = known.withColumn("supported", F.lit(True)).unionByName(others.withColumn("supported", F.lit(False)))
    return both.select("page_id", graph.output_path(F.col("path"), F.lit(DIRECTION)).alias("target"), "supported")


@query(duck(r"""+ f as (select page_id, path, page_id mtime from project_files_v), d as (select path from f where ends_with(path, '.tex')), t as (select path, mtime + 1 mtime from f where page_id % 2 = 0)
  select f.path, f.mtime from f left join t using (path) where f.path not in (select path from d) and not starts_with(f.path, 'ch/') and not coalesce(t.mtime > f.mtime, false)""", "project_files_v"))
def unprocessed_files(spark, sf_dir):
    files = view(spark, sf_dir, "project_files_v").select("path", F.col("page_id").alias("mtime"))
    done = files.filter("endswith(path, '.tex')")
    return graph.unprocessed_files(files, done, files.filter("mtime % 2 = 0").withColumn("mtime", F.col("mtime") + 1), "ch")


@query(duck(r"select split_part(path, '/', 1) project, count(*) filter (page_id % 9 <> 0) succeeded, count(*) total, bool_and(page_id % 9 <> 0) ok from project_files_v group by 1", "project_files_v"))
def project_report(spark, sf_dir):
    files = view(spark, sf_dir, "project_files_v").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), (F.col("page_id") % 9 != 0).alias("ok"))
    return graph.project_report(files)


# -- Word


def _styles(spark, sf_dir):
    """Styles as property maps."""
    prop = lambda tag, c: F.when(F.col(c).isNotNull(), F.create_map(F.lit(tag), F.create_map(F.lit("val"), F.col(c).cast("string"))))
    rpr = styles.merge_maps(prop("sz", "sz"), prop("color", "color"))
    return view(spark, sf_dir, "styles_v").select(F.lit("p").alias("path"), F.col("style_id").cast("string").alias("style_id"), F.col("based_on").cast("string").alias("based_on"), rpr.alias("rpr"))


CHAIN = """c(style_id, depth, ancestor, seen, again) as (select style_id, 0, style_id, [style_id], false from styles_v union all
  select c.style_id, depth + 1, s.based_on, list_append(seen, s.based_on), list_contains(seen, s.based_on) from c join styles_v s on s.style_id = ancestor where not again and s.based_on is not null)"""
RESOLVED = f"{CHAIN}, r as (select c.style_id, arg_min(s.sz, depth) filter (s.sz is not null) sz, arg_min(s.color, depth) filter (s.color is not null) color from c join styles_v s on s.style_id = ancestor group by 1)"


@query(duck(f"+ {CHAIN} select style_id::varchar style_id, depth, ancestor::varchar ancestor from c", "styles_v", recursive=True))
def style_chain(spark, sf_dir):
    return styles.style_chain(_styles(spark, sf_dir)).select("style_id", "depth", "ancestor")


@query(duck(f"+ {RESOLVED} select style_id::varchar style_id, sz::varchar sz, color from r", "styles_v", recursive=True))
def resolve_styles(spark, sf_dir):
    rpr = F.col("rpr")
    return styles.resolve_styles(_styles(spark, sf_dir)).select("style_id", rpr["sz"]["val"].alias("sz"), rpr["color"]["val"].alias("color"))


@query(duck(f"+ {RESOLVED}, l as (select style_id, list(ancestor order by depth) chain from c group by 1) select style_id::varchar style_id, array_to_string(chain, '>') chain, sz size from l join r using (style_id)", "styles_v", recursive=True))
def style_listing(spark, sf_dir):
    """Styles with chain and resolved size (style_sizes)."""
    return styles.style_listing(_styles(spark, sf_dir)).select("style_id", F.array_join("chain", ">").alias("chain"), "size")


@query(duck(f"""+ {RESOLVED} select para_id, run_no, case when regexp_matches(txt, '[a-z0-9]') then coalesce(r.sz, p.sz)::varchar end sz, case when regexp_matches(txt, '[a-z0-9]') then coalesce(r.color, p.color) end color
  from runs_v left join r on r.style_id = run_style left join r p on p.style_id = para_id % 40""", "runs_v", "styles_v", recursive=True))
def materialize_run_styles(spark, sf_dir):
    resolved = styles.resolve_styles(_styles(spark, sf_dir))
    runs = view(spark, sf_dir, "runs_v").select(
        F.lit("p").alias("path"), "para_id", "run_no", F.col("txt").alias("text"), (F.col("para_id") % 40).cast("string").alias("pstyle"), F.col("run_style").cast("string").alias("rstyle"), F.create_map().cast(styles.PROPS).alias("rpr"), F.lit(False).alias("math")
    )
    done = styles.materialize_run_styles(runs, resolved)
    return done.select("para_id", "run_no", F.col("rpr")["sz"]["val"].alias("sz"), F.col("rpr")["color"]["val"].alias("color"))


RUNS = """m as (select *, case when not special and not coalesce(lag(special) over w, true) and lag(style_key) over w is not distinct from style_key then 0 else 1 end new from runs_v window w as (partition by para_id order by run_no)),
  n as (select *, sum(new) over (partition by para_id order by run_no) - 1 seg_no from m),
  g as (select para_id, seg_no::bigint seg_no, arg_min(style_key, run_no) style_key, arg_min(special, run_no) special, string_agg(txt, '' order by run_no) as text from n group by all)"""


def _segments(spark, sf_dir):
    runs = view(spark, sf_dir, "runs_v").withColumnRenamed("txt", "text")
    return styles.merge_adjacent_runs(runs, ["para_id"])


@query(duck(f"+ {RUNS} select * from g", "runs_v"))
def merge_adjacent_runs(spark, sf_dir):
    return _segments(spark, sf_dir).withColumn("seg_no", F.col("seg_no").cast("long")).drop("first_run")


MODELED = f"{RUNS}, b as (select para_id, count(*) n_segments, string_agg(case when special then '<placeholder>' else text end, '【SEG】' order by seg_no) text_for_model from g group by para_id having bool_or(not special and regexp_matches(text, '[a-z0-9]')))"


@query(duck(f"+ {MODELED} select * from b", "runs_v"))
def build_model_text(spark, sf_dir):
    return styles.build_model_text(_segments(spark, sf_dir), ["para_id"])


@query(duck(f"""+ {MODELED} select para_id, seg_no, seg_no % 3 = 1 or para_id % 5 = 0 and seg_no = n_segments - 1 and n_segments > 1 kept,
  case when seg_no % 3 = 1 or para_id % 5 = 0 and seg_no = n_segments - 1 and n_segments > 1 then '' else 'T:' end || case when special then '<placeholder>' else text end translated from g join b using (para_id)""", "runs_v"))
def attach_segment_translations(spark, sf_dir):
    """Replies with a prefix come back to their segments; every third part is blank, and every fifth reply lacks its last part."""
    segments = _segments(spark, sf_dir)
    parts = F.transform(F.split("text_for_model", T.SEGMENT, -1), lambda x, i: F.when(i % 3 == 1, F.repeat(F.lit(" "), (i % 2).cast("int"))).otherwise(F.concat(F.lit("T:"), x)))
    short = (F.col("para_id") % 5 == 0) & (F.size(parts) > 1)
    reply = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - short.cast("int")), T.SEGMENT)
    replies = styles.build_model_text(segments, ["para_id"]).select("para_id", reply.alias("reply"))
    live = segments.join(replies.select("para_id"), "para_id", "left_semi")
    return styles.attach_segment_translations(live, replies, ["para_id"]).select("para_id", F.col("seg_no").cast("long").alias("seg_no"), "kept", "translated")


@query(duck("""+ t as (select para_id, style_key, count(*) n from runs_v where not special group by all), c as (select para_id, count(*) n, count(*) filter (not special) styled from runs_v group by 1)
  select c.para_id, max(t.style_key) filter (t.n = c.n or c.styled = 1) common from c left join t using (para_id) group by 1""", "runs_v"))
def common_run_style(spark, sf_dir):
    rpr = F.when(~F.col("special"), F.create_map(F.lit("k"), F.create_map(F.lit("val"), F.col("style_key"))))
    return styles.common_run_style(view(spark, sf_dir, "runs_v").withColumn("rpr", rpr), ["para_id"]).select("para_id", F.col("common")["k"]["val"].alias("common"))


@query(duck(f"""+ {RESOLVED}, f as (select para_id, arg_min(case when run_style % 3 = 0 then run_style end, run_no) filter (run_style % 3 = 0) own, para_id % 40 sid from runs_v group by para_id),
  o as (select para_id, coalesce(own, r.sz, 24)::int old_size from f left join r on r.style_id = sid) select para_id, old_size, case when old_size % 2 = 0 and old_size < 40 then old_size + 3 else old_size end new_size from o""", "runs_v", "styles_v", recursive=True))
def map_font_sizes(spark, sf_dir):
    sizes = styles.style_sizes(styles.resolve_styles(_styles(spark, sf_dir)))
    runs = view(spark, sf_dir, "runs_v").select(F.lit("p").alias("path"), F.col("para_id").alias("para_no"), "run_no", F.when(F.col("run_style") % 3 == 0, F.col("run_style").cast("int")).alias("size"), (F.col("para_id") % 40).cast("string").alias("pstyle"))
    size_map = spark.range(20).select((F.col("id") * 2).cast("int").alias("old_size"), (F.col("id") * 2 + 3).cast("int").alias("new_size"))
    return styles.map_font_sizes(runs, sizes, size_map, 24).select(F.col("para_no").alias("para_id"), "old_size", "new_size")


# -- whole paths


def _prefix(texts):
    return "T:" + texts


@query(duck(f"+ {APPLIED} select doc_id, md5(string_agg(line, chr(10) order by line_no)) text_md5 from a group by doc_id", "md_lines_v"))
def translate_with_memory(spark, sf_dir):
    """The Markdown path with a memory that knows some of the texts, and a translator that sets a prefix."""
    docs = markdown.reassemble(view(spark, sf_dir, "md_lines_v"))
    held = _memory(spark, sf_dir).filter("text <> ''")
    return translate.translate_markdown(docs, held, _prefix, MODEL, DIRECTION, NOW)[0].select("doc_id", F.md5("text").alias("text_md5"))


AGED = """live as (select * from tm_v where try_cast(ts_raw as timestamp) is null or try_cast(ts_raw as timestamp) >= timestamp '2024-05-01' - interval 30 day)"""


@query(duck(rf"""+ {GUARDED}, {packed('guarded')}, {AGED}, reply as (select *, text as reply from chunks),
  told as (select r.doc_id, r.chunk_no, r.text, nullif(l.txt, '') stored, {CLEAN} c from reply r left join live l on r.text <> '' and l.cache_key = md5(r.text || '|m|en-to-zh')),
  done as (select *, stored is null and text <> '' and regexp_matches(text, '[\p{{L}}\p{{N}}]') and length(c) < 10 failed, case when stored is not null then stored when length(c) >= 10 and regexp_matches(text, '[\p{{L}}\p{{N}}]') then c else text end new from told),
  t as (select doc_id, string_agg(new, chr(10)||chr(10) order by chunk_no) new, count(*) chunks, count(stored) hits, count(*) filter (failed) n_failed from done group by doc_id),
  w as (select doc_id, (count(*) filter (marked) + count(*) filter (twice))::int placeholders, length(string_agg(raw, chr(10)||chr(10) order by line_no)) n_in, length(string_agg(line, chr(10)||chr(10) order by line_no)) n_safe from guarded group by doc_id)
  select doc_id, chunks, hits, round(100.0 * hits / chunks, 1) hit_rate, n_failed::int n_failed, placeholders, (length(new) + n_in - n_safe) / n_in ratio from t join w using (doc_id)""", "tm_v", "tex_lines_v", recursive=True))
def document_report(spark, sf_dir):
    """The LaTeX path with a translator that gives back what it gets; all placeholders come back, so lengths add up."""
    held = _memory(spark, sf_dir)
    report = translate.translate_latex(_tex(spark, sf_dir), held, lambda texts: texts, MODEL, DIRECTION, NOW)[2]
    return report.select("doc_id", "chunks", "hits", "hit_rate", F.size("failed").alias("n_failed"), "placeholders", "ratio")
