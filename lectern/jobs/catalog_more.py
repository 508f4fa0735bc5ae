"""Further registered queries: single checks, scalar functions and sources, each over a whole table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.jobs import catalog as C, translate
from lectern.jobs.catalog import query
from lectern.jobs.fixtures import duck, view
from lectern.jobs.requests import RequestLog
from lectern.operators import graph, latex, markdown, memory, styles, validate
from lectern.sources import documents, versions
from lectern.sources.memory_store import MemoryStore

def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _quoted(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


#: Replies of 49 and 50 characters around each phrase of a refusal, and some without one, by the number of an event.
PHRASES = [*T.REFUSALS, "fine"]
PADDED = f"rpad(upper(p[(event_id % {len(PHRASES)} + 1)::int]), (49 + event_id // {len(PHRASES)} % 2)::int, '.')"


@query(f"with e as (select event_id, {_quoted(PHRASES)} p from events), r as (select event_id, {PADDED} reply from e) select event_id, length(reply) < 50 and event_id % {len(PHRASES)} < {len(T.REFUSALS)} refusal from r")
def detect_refusal(spark, sf_dir):
    phrase = F.upper(F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES) + 1).cast("int")))
    reply = F.rpad(phrase, (49 + F.floor(F.col("event_id") / len(PHRASES)) % 2).cast("int"), F.lit("."))
    return _events(spark, sf_dir).select("event_id", validate.is_refusal(reply).alias("refusal"))


SAID = ["You are a professional translation engine", "CRITICAL RULES", "you are a professional translation engine", "Output only the translated text", "a plain reply", ""]


@query("select event_id, event_id % 6 < 2 echo from events")
def detect_prompt_echo(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("event_id") % len(SAID) + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", validate.is_echo(F.concat(F.col("event_type"), F.lit(" "), said, F.lit(" "), F.col("event_type"))).alias("echo"))


MARKS = ["<placeholder>", "< placeholder >", "<placeholder,", "<  placeholder  ,", "<place holder>", "placeholder>"]


@query("select event_id, event_id % 4 = case when event_id % 6 < 4 then event_id // 4 % 4 else 0 end parity from events")
def placeholder_parity(spark, sf_dir):
    """Sources with none to three placeholders against replies with as many marks of six spellings, four of which count."""
    mark = F.element_at(F.array(*[F.lit(x) for x in MARKS]), (F.col("event_id") % len(MARKS) + 1).cast("int"))
    source = F.repeat(F.lit("a <placeholder> "), (F.col("event_id") % 4).cast("int"))
    reply = F.repeat(F.concat(F.lit("b "), mark, F.lit(" ")), (F.floor(F.col("event_id") / 4) % 4).cast("int"))
    return _events(spark, sf_dir).select("event_id", validate.placeholders_match(source, reply).alias("parity"))


@query("select event_id, event_id % 7 = 0 or event_id % 21 < 10 short from events")
def short_reply_check(spark, sf_dir):
    reply = F.when(F.col("event_id") % 7 != 0, F.repeat(F.lit("第"), (F.col("event_id") % 21).cast("int")))
    return _events(spark, sf_dir).select("event_id", validate.is_short(reply).alias("short"))


@query("select event_id, event_id % 5 = event_id // 5 % 5 blocks_ok from events")
def block_count_parity(spark, sf_dir):
    """Replies of none to four blocks, with blank ones between and at the ends, against a number of blocks."""
    reply = F.concat(F.lit(" ---\n"), F.repeat(F.lit("x\n---\n \t---"), (F.col("event_id") % 5).cast("int")))
    return _events(spark, sf_dir).select("event_id", validate.blocks_match(reply, (F.floor(F.col("event_id") / 5) % 5).cast("int")).alias("blocks_ok"))


@query("select doc_id, regexp_matches(regexp_replace(case when doc_id%3 = 0 then replace(text, ' ', ' % 注 ') when doc_id%3 = 1 then replace(text, '. ', ' 图 ') else text end, '(?m)%.*$', '', 'g'), '[一-鿿]') has_chinese from documents")
def has_chinese(spark, sf_dir):
    """Whole texts, with ideographs in comments or outside of them."""
    return _docs(spark, sf_dir, "case when doc_id%3 = 0 then replace(text, ' ', ' % 注 ') when doc_id%3 = 1 then replace(text, '. ', ' 图 ') else text end").select("doc_id", T.has_chinese(F.col("text")).alias("has_chinese"))


@query("select event_id, event_id % 4 in (1, 2) or event_id % 4 = 3 and event_id % 3 = 0 needs_mark from events")
def space_preserve_flag(spark, sf_dir):
    ends = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), "event_type")).when(F.col("event_id") % 4 == 2, F.concat("event_type", F.lit(" "))).when(F.col("event_id") % 4 == 3, F.when(F.col("event_id") % 3 == 0, " ").otherwise("\t")).otherwise(F.col("event_type"))
    return _events(spark, sf_dir).select("event_id", T.needs_space_mark(ends).alias("needs_mark"))


def _docs(spark, sf_dir, expression: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(expression).alias("text"))


@query(duck(f"select unit_id, attempt, {C.CLEAN} cleaned from replies_v", "replies_v"))
def clean_reply(spark, sf_dir):
    return view(spark, sf_dir, "replies_v").select("unit_id", "attempt", T.clean_reply(F.col("reply")).alias("cleaned"))


HEADED = "replace(text, chr(10), chr(10) || case doc_id%3 when 0 then 'Chapter' || chr(92) || 'ref{a} ' when 1 then 'Table ' else 'Lemma' || chr(92) || 'x ' end)"


@query(rf"select doc_id, md5(regexp_replace({HEADED}, '({'|'.join(T.KEYWORDS)})(\\[a-zA-Z])', '\1 \2', 'g')) fixed from documents")
def fix_keyword_spacing(spark, sf_dir):
    return _docs(spark, sf_dir, HEADED).select("doc_id", F.md5(T.fix_keyword_spacing(F.col("text"))).alias("fixed"))


SPREAD = "replace(text, chr(10), repeat(chr(10), cast(2 + doc_id%4 as int)))"


@query(rf"select doc_id, md5(regexp_replace({SPREAD}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) collapsed from documents")
def collapse_blank_lines(spark, sf_dir):
    return _docs(spark, sf_dir, SPREAD).select("doc_id", F.md5(T.collapse_blank_lines(F.col("text"))).alias("collapsed"))


@query("select doc_id, case when lang = 'en' then 'en-to-zh' else 'zh-to-en' end direction from documents")
def direction_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.direction_of(F.when(F.col("lang") == "en", "English").otherwise("Chinese")).alias("direction"))


ARTICLE = "case when doc_id%2=0 then chr(92)||'documentclass[11pt]{article}' else chr(92)||'documentclass{book}' end || chr(10) || chr(92)||'begin{document}' || chr(10) || text"


@query(rf"""with a as (select doc_id, regexp_replace({ARTICLE}, '\\documentclass(\[.*?\])?\{{article\}}', '\\documentclass\1{{ctexart}}', 'g') t from documents)
  select doc_id, md5(case when contains(t, 'ctexart') and not contains(t, 'xeCJK') then replace(t, chr(92)||'begin{{document}}', 'FONTS'||chr(92)||'begin{{document}}') else t end) converted from a""")
def convert_document_class(spark, sf_dir):
    return _docs(spark, sf_dir, ARTICLE).select("doc_id", F.md5(T.convert_document_class(F.col("text"), C.DIRECTION, "FONTS")).alias("converted"))


@query("select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: '【块' || i || '】' || chr(10) || x), chr(10) || chr(10))) prompt from documents")
def number_block_prompt(spark, sf_dir):
    return _docs(spark, sf_dir, "text").select("doc_id", F.md5(T.number_blocks(F.split("text", "\n", -1))).alias("prompt"))


TYPED = "replace(text, chr(10), chr(10) || case doc_id%3 when 0 then '[comment] ' when 1 then '[chinese_string] ' else '- ' end)"


@query(rf"""with t as (select doc_id, list_filter(string_split({TYPED}, chr(10)), lambda x: regexp_matches(x, '^\[(comment|chinese_string)\]\s*(.+)')) l from documents)
  select doc_id, len(l)::int n, md5(array_to_string(list_transform(l, lambda x: regexp_extract(x, '^\[(comment|chinese_string)\]', 1) || ':' || {C.STRIP.format("regexp_extract(x, '^\\[(comment|chinese_string)\\]\\s*(.+)', 2)")}), '|')) parsed from t""")
def parse_typed_lines(spark, sf_dir):
    typed = latex.parse_typed_lines(F.col("text"))
    return _docs(spark, sf_dir, TYPED).select("doc_id", F.size(typed).alias("n"), F.md5(F.array_join(F.transform(typed, lambda x: F.concat(x["span_type"], F.lit(":"), x["text"])), "|")).alias("parsed"))


DEALT = "replace(text, '. ', '<placeholder>')"


@query(f"with p as (select doc_id, string_split({DEALT}, '<placeholder>') p from documents) select doc_id, md5(p[1] || '|<placeholder>|' || coalesce(array_to_string(p[2:], ''), '')) dealt from p")
def split_by_placeholder(spark, sf_dir):
    dealt = T.split_by_placeholder(F.col("text"), F.array(F.lit(True), F.lit(False), F.lit(True)))
    return _docs(spark, sf_dir, DEALT).select("doc_id", F.md5(F.array_join(dealt, "|")).alias("dealt"))


@query("select p_partkey, case p_size % 4 when 0 then 'both' else case p_size % 5 when 0 then 'left' when 1 then 'center' when 2 then 'center' when 3 then 'right' end end jc from part")
def infer_alignment(spark, sf_dir):
    own = F.when(F.col("p_size") % 4 == 0, "both")
    formula = F.element_at(F.array(*[F.lit(x) for x in ("left", "center", "centerGroup", "right", None)]), (F.col("p_size") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.infer_alignment(own, formula).alias("jc"))


@query("select p_partkey, 'Serif' latin, case when p_size%3=0 then p_size::varchar end sz from part")
def set_run_fonts(spark, sf_dir):
    rpr = F.when(F.col("sz").isNotNull(), F.create_map(F.lit("sz"), F.create_map(F.lit("val"), F.col("sz").cast("string"))))
    fonts = styles.set_run_fonts(rpr, "Serif", "Song")
    return view(spark, sf_dir, "styles_v").select(F.col("style_id").alias("p_partkey"), fonts["rFonts"]["ascii"].alias("latin"), fonts["sz"]["val"].alias("sz"))


@query(duck(rf"""+ t as (select doc_id, string_agg(line, chr(10) order by line_no) t0 from cls_lines_v group by doc_id),
  a as (select *, regexp_replace(t0, '{latex.STYLE_PATTERNS[0][0]}', '<COMMAND>', 'g') t1 from t), b as (select *, regexp_replace(t1, '(?s){latex.STYLE_PATTERNS[1][0]}', '<ENVIRONMENT>', 'g') t2 from a), c as (select *, regexp_replace(t2, '{latex.STYLE_PATTERNS[2][0]}', '<OPTION>', 'g') t3 from b)
  select doc_id, (len(regexp_extract_all(t0, '{latex.STYLE_PATTERNS[0][0]}')) + len(regexp_extract_all(t1, '(?s){latex.STYLE_PATTERNS[1][0]}')) + len(regexp_extract_all(t2, '{latex.STYLE_PATTERNS[2][0]}')) + len(regexp_extract_all(t3, '{latex.STYLE_PATTERNS[3][0]}')))::int n, true restored from c""", "cls_lines_v"))
def protect_style_file(spark, sf_dir):
    """Placeholders of each style file, and whether they restore it."""
    docs = markdown.reassemble(view(spark, sf_dir, "cls_lines_v")).withColumn("before", F.col("text"))
    made = latex.protect(docs, patterns=latex.STYLE_PATTERNS)
    return made.select("doc_id", F.size("placeholders").alias("n"), (latex.restore(F.col("text"), F.col("placeholders")) == F.col("before")).alias("restored"))


@query(duck("""+ m as (select file_id::varchar path, file_id pos from file_listing_v), f as (select dst::varchar path, src + 1000000 pos from file_edges_v)
  select path, min(pos)::bigint pos from (select * from m union all select * from f) group by path""", "file_edges_v", "file_listing_v"))
def union_distinct_files(spark, sf_dir):
    main = view(spark, sf_dir, "file_listing_v").select(F.col("file_id").cast("string").alias("path"), F.col("file_id").alias("pos"))
    found = view(spark, sf_dir, "file_edges_v").select(F.col("dst").cast("string").alias("path"), (F.col("src") + 1000000).alias("pos"))
    return graph.union_distinct_files(main, found)


@query(duck("""+ r(root, node) as (select file_id, file_id from file_listing_v union select root, dst from r join file_edges_v on src = node where dst in (select file_id from file_listing_v))
  select root, node from r""", "file_edges_v", "file_listing_v", recursive=True))
def style_closure(spark, sf_dir):
    """What every file reaches, itself included."""
    listing = view(spark, sf_dir, "file_listing_v").select(F.col("file_id").alias("node"))
    return graph.closure(listing, view(spark, sf_dir, "file_edges_v"), listing).select("root", "node")


@query(duck("select distinct src, case when src % 2 = 0 then 'd/' else '' end || 'f' || dst || '.sty' dst, src % 2 = 0 and dst in (select file_id from file_listing_v) found from file_edges_v", "file_edges_v", "file_listing_v"))
def resolve_style_refs(spark, sf_dir):
    """Packages named by files in subfolders are those of the project's folder: d for half of the files, none for the others."""
    names = F.concat_ws(", ", F.collect_list(F.concat(F.lit("f"), F.col("dst"))))
    files = view(spark, sf_dir, "file_edges_v").groupBy("src").agg(names.alias("n")).select(F.concat(F.lit("d/sub"), F.col("src") % 3, F.lit("/"), "src").alias("path"), F.concat(F.lit("\\usepackage[x]{"), "n", F.lit("}")).alias("content"))
    listing = view(spark, sf_dir, "file_listing_v").select(F.concat(F.lit("d/f"), F.col("file_id"), F.lit(".sty")).alias("path"))
    src = F.regexp_extract("src", "([0-9]+)$", 1).cast("long")
    refs = graph.style_refs(files).withColumn("main", F.when(src % 2 == 0, "d/main.tex").otherwise("main.tex"))
    return graph.resolve_refs(refs, listing, "", "main").select(src.alias("src"), "dst", "found").distinct()


@query(duck("""+ r(node) as (select file_id from file_listing_v where file_id % 10 = 1 union select dst from r join file_edges_v on src = node where dst in (select file_id from file_listing_v)),
  p as (select node, 'd' root from r union all select file_id, 'e' from file_listing_v where file_id % 10 = 1) select root, node::bigint node from p""", "file_edges_v", "file_listing_v", recursive=True))
def style_reach(spark, sf_dir):
    """Packages that two projects reach from the same files in subfolders: those of d stand in its folder, e has none."""
    listing = view(spark, sf_dir, "file_listing_v")
    names = F.concat_ws(", ", F.collect_list(F.concat(F.lit("f"), F.col("dst"))))
    files = view(spark, sf_dir, "file_edges_v").groupBy("src").agg(names.alias("n")).select(F.concat(F.lit("d/f"), "src", F.lit(".sty")).alias("path"), F.concat(F.lit("\\RequirePackage{"), "n", F.lit("}")).alias("content"))
    paths = listing.select(F.concat(F.lit("d/f"), F.col("file_id"), F.lit(".sty")).alias("path"))
    firsts = listing.filter("file_id % 10 = 1").select(F.concat(F.lit("d/f"), F.col("file_id"), F.lit(".sty")).alias("node"))
    roots = firsts.withColumn("root", F.explode(F.array(F.lit("d/main.tex"), F.lit("e/main.tex"))))
    found = graph.style_reach(roots, graph.style_refs(files), paths)
    return found.select(F.substring("root", 1, 1).alias("root"), F.regexp_extract("node", "f([0-9]+)", 1).cast("long").alias("node"))


@query(duck(f"+ {C.RESOLVED} select style_id::varchar style_id, sz size from r where sz is not null", "styles_v", recursive=True))
def style_sizes(spark, sf_dir):
    return styles.style_sizes(styles.resolve_styles(C._styles(spark, sf_dir))).select("style_id", "size")


@query(duck("""select case when para_id % 2 = 0 then 'word/document.xml' else 'word/footnotes.xml' end part_name, count(*) found, count(*) filter (txt <> '') processed, count(*) filter (run_style % 2 = 0) linked,
  count(*) filter (txt <> '' and style_key = 'AF') bold from runs_v group by 1""", "runs_v"))
def materialize_report(spark, sf_dir):
    part = F.when(F.col("para_id") % 2 == 0, "word/document.xml").otherwise("word/footnotes.xml")
    rpr = F.when(F.col("style_key") == "AF", F.create_map(F.lit("b"), F.lit("1"))).otherwise(F.create_map(F.lit("i"), F.lit("1")))
    runs = view(spark, sf_dir, "runs_v").select(F.lit("p").alias("path"), part.alias("part_name"), F.col("txt").alias("text"), F.when(F.col("run_style") % 2 == 0, "s").alias("rstyle"), rpr.alias("rpr"))
    return styles.materialize_report(runs).drop("path")


@query(duck("select para_id, run_no, case run_style % 4 when 0 then case when special then 'non_text_node' else 'text_run_group' end when 1 then 'hyperlink' when 2 then 'non_text_node' end seg_type from runs_v", "runs_v"))
def classify_docx_child(spark, sf_dir):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("r", "hyperlink", "oMath", "bookmarkStart")]), (F.col("run_style") % 4 + 1).cast("int"))
    return view(spark, sf_dir, "runs_v").select("para_id", "run_no", styles.classify_child(tag, F.col("special")).alias("seg_type"))


@query(duck("select distinct md5(line || '|m|en-to-zh') cache_key, 'T:' || line reply from lines_v where line <> ''", "lines_v"))
def translate_units(spark, sf_dir):
    return translate.translate_units(C._units(spark, sf_dir), C._prefix).select("cache_key", "reply")


@query(duck("select cache_key, txt as text, case when substr(cache_key, 1, 1) < '4' then '2024-05-01' else ts_raw end ts_raw from tm_v where length(txt) < 50000", "tm_v"))
def read_translation_memory(spark, sf_dir):
    """The memory written as JSON objects of some hundred keys each, a quarter of them in the old layout, and read again."""
    held = C._memory(spark, sf_dir)
    groups = max(1, held.count() // 500)
    new = F.to_json(F.struct("text", F.col("ts_raw").alias("timestamp")))
    value = F.when(F.substring("cache_key", 1, 1) < "4", F.get_json_object(F.to_json(F.struct(F.to_json(F.struct("text")).alias("x"))), "$.x")).otherwise(new)
    entry = F.concat(F.lit('"'), "cache_key", F.lit('": '), F.when(F.substring("cache_key", 1, 1) < "4", F.regexp_extract(value, r'(?s)\A\{"text":(.*)\}\z', 1)).otherwise(value))
    maps = held.groupBy(F.pmod(F.xxhash64("cache_key"), F.lit(groups)).alias("g")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    path = graph.shared_folder(spark)
    maps.write.partitionBy("g").text(path)  # a file for each object
    return memory.from_json_maps(spark, path, C.NOW)


@query(duck("select cache_key, txt as text, ts_raw from tm_v", "tm_v"))
def write_translation_memory(spark, sf_dir):
    """The memory written as the second version, with a third one that was never finished, and the newest whole one read."""
    held, folder = C._memory(spark, sf_dir), graph.shared_folder(spark)
    documents.write_memory(held.filter("ts_raw = 'bad'"), folder, "1")
    documents.write_memory(held, folder, "2")
    held.limit(1).write.parquet(f"{folder}/version=3")
    return documents.read_memory(spark, folder)


STORED = """m as (select cache_key, case when substr(cache_key, 2, 1) >= '8' or length(txt) > 19998 then txt when txt = '' or substr(cache_key, 3, 1) = '0' then '' else 'N:' || txt end as text from tm_v)"""


@query(duck(f"+ {C.UNITS}, {STORED} select u.cache_key, nullif(m.text, '') stored from u left join m using (cache_key)", "tm_v"))
def tm_store_lookup(spark, sf_dir):
    """Lookups in a store: a base, a part that renews half of the keys and empties some, and a part that was never finished."""
    held, store = C._memory(spark, sf_dir), MemoryStore(spark, graph.shared_folder(spark))
    late = F.substring("cache_key", 2, 1) < "8"
    store.replace(held)
    new = F.when((F.col("text") == "") | (F.substring("cache_key", 3, 1) == "0"), "").otherwise(F.concat(F.lit("N:"), "text"))
    store.append(held.filter(late).select("cache_key", F.col("text").alias("source"), new.alias("text"), "ts_raw"))
    held.select("cache_key", F.lit("half").alias("text"), "ts_raw").write.parquet(versions.path_of(store.folder, "broken"))
    return store.lookup(C._units(spark, sf_dir)).select("cache_key", "stored")


#: What comes back to the attempts at a text, by digits of its digest: each failure, a truncated reply, good and bad ones.
ANSWER = """case when attempt = 0 then case substr(k, 1, 1) when '0' then 'http_error' when '1' then 'api_error' when '2' then 'no_choices' when '3' then 'truncated' when '4' then 'echo' when '5' then 'refusal' when '6' then 'lost' else 'ok' end
  when substr(k, 2, 1) < '8' then case substr(k, 2 + attempt, 1) when '0' then 'http_error' when '1' then 'truncated' when '2' then 'api_error' else 'ok' end else 'ok' end"""


@query(duck(rf"""+ u as (select distinct line as text, md5(line || '|m|en-to-zh') k from lines_v where line <> ''), a as (select text, k, unnest([0, 1, 2]) attempt from u), b as (select *, {ANSWER} outcome from a),
  f as (select k, text, min(attempt) filter (outcome in ('ok', 'refusal', 'lost')) won from b group by all), r as (select f.*, b.outcome from f left join b on b.k = f.k and b.attempt = f.won),
  n as (select *, regexp_matches(text, '[\p{{L}}\p{{N}}]') live from r), l as (select k, outcome last from b where attempt = 2)
  select k cache_key, case when not live then 'passthrough' when outcome = 'lost' then 'open' when outcome = 'ok' then 'ok' when outcome = 'refusal' then 'refusal' else last end as status,
    case when live and outcome = 'ok' then 'T' || won || ':' || text else text end translated, case when not live then 0 when outcome in ('ok', 'refusal') then won + 1 when outcome = 'lost' then 1 else 3 end asked from n join l using (k)""", "lines_v"))
def resumed_requests(spark, sf_dir):
    """A path of requests and responses run seven times: deliveries come late, twice and in parts, every outcome among them; some
    never come. Verdict and text of each unit at the end, and how many requests were made for it."""
    units = C._units(spark, sf_dir)
    log, held = RequestLog(spark, graph.shared_folder(spark), C.MODEL, "Translate."), spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    content = F.from_json("request", "messages array<struct<content:string>>")["messages"][1]["content"]
    said = F.when(F.col("outcome") == "echo", "CRITICAL RULES").when(F.col("outcome") == "refusal", "Sorry, I cannot").otherwise(F.concat(F.lit("T"), "attempt", F.lit(":"), content))
    choice = F.struct(F.struct(said.alias("content")).alias("message"), F.when(F.col("outcome") == "truncated", "length").otherwise("stop").alias("finish_reason"))
    body = F.when(F.col("outcome") == "api_error", F.lit('{"error": "quota"}')).when(F.col("outcome") == "no_choices", F.lit('{"choices": []}')).otherwise(F.to_json(F.struct(F.array(choice).alias("choices"))))
    code = F.when(F.col("outcome") == "http_error", 500).otherwise(200)
    for k in range(6):
        with graph.passing(spark):  # what stays of a run is in the log
            translate.translate_with_memory(units, held, log, C.MODEL, C.DIRECTION, C.NOW, clean=T.strip)
            answers = graph.written(log.open_requests().withColumn("k", F.col("unit_id")).withColumn("outcome", F.expr(ANSWER)).filter("outcome <> 'lost'").select("unit_id", "attempt", code.alias("status_code"), body.alias("body")))
            early = F.substring("unit_id", 5, 1) < "8"
            log.deliver(answers.filter(early).unionByName(answers.filter(early)) if k % 2 == 0 else answers)  # half of them wait for the next run
    asked = log.requests().groupBy(F.col("unit_id").alias("cache_key")).agg(F.count("*").cast("int").alias("asked"))
    done = translate.translate_with_memory(units, held, log, C.MODEL, C.DIRECTION, C.NOW, clean=T.strip)[0]
    keyed = done.withColumn("cache_key", T.cache_key(F.col("text"), C.MODEL, C.DIRECTION))
    return keyed.join(asked, "cache_key", "left").select("cache_key", "status", "translated", F.coalesce("asked", F.lit(0)).alias("asked"))


GROUPED = "select doc_id % greatest(1, (select count(*) // 50 from documents)) g, string_agg(replace(text, chr(10), case when doc_id % 2 = 0 then chr(13) || chr(10) else chr(10) end), chr(10) order by doc_id) || chr(10) as text from documents group by 1"


@query(f"with f as ({GROUPED}) select g::int g, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) text_md5 from f")
def read_text_documents(spark, sf_dir):
    """All documents in text files of some fifty each, half of them with other line ends, read as whole files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = max(1, docs.count() // 50)
    ends = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    path = graph.shared_folder(spark)
    docs.select((F.col("doc_id") % groups).alias("g"), "doc_id", ends.alias("value")).repartition("g").sortWithinPartitions("g", "doc_id").drop("doc_id").write.partitionBy("g").text(path)
    read = documents.read_text_documents(spark, f"{path}/g=*/*.txt")
    return read.select(F.regexp_extract("path", "/g=([0-9]+)/", 1).cast("int").alias("g"), F.md5("text").alias("text_md5"))


@query(duck("select page_id, ltrim(lower(regexp_extract(path, '(\\.[^./]+)$', 1)), '.') format from project_files_v where regexp_matches(lower(path), '\\.(docx|md|tex|cls|sty)$')", "project_files_v"))
def route_by_format(spark, sf_dir):
    """Files of the supported formats."""
    return graph.route_by_format(view(spark, sf_dir, "project_files_v"))[0].select("page_id", "format")


@query("select 'd' || doc_id path, case when doc_id % 2 = 0 then 'md' else 'tex' end format, md5(text) text_md5 from documents")
def write_documents(spark, sf_dir):
    """All documents written by format, and read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = graph.shared_folder(spark)
    documents.write_documents(docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, "md").otherwise("tex").alias("format"), "text"), path)
    return spark.read.parquet(path).select("path", F.col("format").cast("string").alias("format"), F.md5("text").alias("text_md5"))


def _packages(spark, sf_dir):
    """A Word package of each document, made by the library's own writer from a template of parts."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("<w:p><w:r><w:t>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</w:t></w:r></w:p>")))
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = F.concat(F.lit(f"<w:document {space}><w:body>"), F.array_join(lines, ""), F.lit("</w:body></w:document>"))
    sheet = F.concat(F.lit(f'<w:styles {space}><w:style w:styleId="s'), F.col("doc_id"), F.lit('" w:type="paragraph"><w:rPr><w:sz w:val="'), (F.col("doc_id") % 7 + 20), F.lit('"/></w:rPr></w:style></w:styles>'))
    part = lambda n, name, x: F.struct(F.lit(n).alias("part_no"), F.lit(name).alias("part_name"), x.cast("binary").alias("part_bytes"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(part(0, "word/document.xml", body), part(1, "word/styles.xml", sheet), part(2, "docProps/app.xml", F.col("source")))).alias("p"))
    none = spark.createDataFrame([], "path string, part_name string, para_no int, run_no int, text string")
    return documents.assemble_docx(docs.select("path", "p.*", F.lit("ok").alias("status")), none)


@query("select doc_id::varchar path, unnest(['word/document.xml', 'word/styles.xml', 'docProps/app.xml']) part_name, unnest(['process', 'replace_styles', 'copy']) action from documents")
def explode_docx_parts(spark, sf_dir):
    """Packages written from all documents (assemble_docx) and taken apart again."""
    return documents.explode_docx_parts(_packages(spark, sf_dir)).select("path", "part_name", "action")


@query("select doc_id::varchar path, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int para_no, unnest(string_split(text, chr(10))) as text from documents")
def parse_docx_runs(spark, sf_dir):
    parts = documents.explode_docx_parts(_packages(spark, sf_dir)).filter("action = 'process'")
    return documents.parse_docx_runs(parts).select("path", "para_no", "text")


@query("select doc_id::varchar path, 's' || doc_id style_id, (doc_id % 7 + 20)::int direct_size from documents")
def parse_docx_styles(spark, sf_dir):
    return documents.parse_docx_styles(documents.explode_docx_parts(_packages(spark, sf_dir))).select("path", "style_id", "direct_size")


@query("select doc_id::varchar path, md5(string_agg('T:' || line, chr(10) order by n)) text_md5 from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) n, unnest(string_split(text, chr(10))) line from documents) group by doc_id")
def assemble_docx(spark, sf_dir):
    """Runs translated by a prefix, put back into their packages, and read from these."""
    parts = documents.explode_docx_parts(_packages(spark, sf_dir))
    runs = documents.parse_docx_runs(parts.filter("action = 'process'"))
    made = documents.assemble_docx(parts, runs.select("path", "part_name", "para_no", "run_no", F.concat(F.lit("T:"), "text").alias("text")))
    again = documents.parse_docx_runs(documents.explode_docx_parts(made).filter("action = 'process'"))
    return markdown.reassemble(again, "para_no", "text", id_col="path").select("path", F.md5("text").alias("text_md5"))


# -- whole paths

RICH = """<w:p><w:pPr><w:pStyle w:val="s1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{a}</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{b}</w:t></w:r><w:bookmarkStart w:id="0"/>
<w:r><w:drawing/></w:r><w:hyperlink><w:r><w:rPr><w:i/></w:rPr><w:t xml:space="preserve">{c}</w:t></w:r></w:hyperlink></w:p>"""


def _rich_packages(spark, sf_dir):
    """A Word package of each document: a paragraph of each line, its words dealt out over two equal runs and a hyperlink."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    third = lambda x: F.floor(F.length(x) / 3).cast("int")
    cut = lambda x: {"a": F.substring(x, F.lit(1), third(x)), "b": F.substring(x, third(x) + 1, third(x)), "c": F.substring(x, 2 * third(x) + 1, F.length(x))}

    def paragraph(x):
        out, parts = [], cut(x)
        for k, bit in enumerate(re.split(r"\{([abc])\}", RICH)):
            out.append(safe(parts[bit]) if k % 2 else F.lit(bit))
        return F.concat(*out)

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="urn:fourteen" w14:Ignorable="w14"'
    body = F.concat(F.lit(f"<w:document {space}><w:body>"), F.array_join(F.transform(F.split("text", "\n", -1), paragraph), ""), F.lit("</w:body></w:document>"))
    part = lambda n, name, x: F.struct(F.lit(n).alias("part_no"), F.lit(name).alias("part_name"), x.cast("binary").alias("part_bytes"))
    named = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(part(0, "word/document.xml", body), part(1, "word/fontTable.xml", F.lit("<old/>")), part(2, "docProps/app.xml", F.col("source")))).alias("p"))
    none = spark.createDataFrame([], "path string, part_name string, para_no int, run_no int, text string")
    return documents.assemble_docx(named.select("path", "p.*", F.lit("ok").alias("status")), none)


def _marked(texts):
    """A translator of the Word path: a prefix before each segment, placeholders kept; the last part is blank where the length
    of the first can be divided by five."""

    def one(t):
        parts = t.split(T.SEGMENT)
        out = [p if p == T.PLACEHOLDER else f"T:{p}" for p in parts]
        return T.SEGMENT.join([*out[:-1], " "] if len(parts) > 1 and len(parts[0]) % 5 == 0 else out)

    return texts.map(one)


RICH_LINES = rf"""with l as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 n, unnest(string_split(text, chr(10))) line from documents),
  c as (select *, substr(line, 1, (2 * (length(line) // 3))::int) a, substr(line, (2 * (length(line) // 3) + 1)::int) c from l),
  t as (select *, regexp_matches(line, '[\p{{L}}\p{{N}}]') live, length(a) % 5 = 0 blank from c)"""


@query(rf"""{RICH_LINES},
  r as (select *, case when live then 'T:' || a else a end x, case when not live or blank then c else regexp_replace(regexp_replace('T:' || c, '\s+$', ''), '[ "''`]+$', '') end y from t)
  select doc_id::varchar path, n::int para_no, md5(x) run_md5, md5(y) link_md5, case when live then 1 else 2 end runs from r""")
def translate_docx(spark, sf_dir):
    """The Word path over packages of all documents: what stands in the runs and hyperlinks of each paragraph afterwards."""
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    made = translate.translate_docx(_rich_packages(spark, sf_dir), held, _marked, C.MODEL, C.DIRECTION, C.NOW, font_table=b"<new/>")[0]
    parts = documents.explode_docx_parts(made)
    runs = documents.parse_docx_runs(parts.filter("action = 'process'"))
    ordered = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & ~F.col("special"), F.struct("run_no", "text")))), lambda x: x["text"]), "")
    return runs.groupBy("path", "para_no").agg(F.md5(ordered("run")).alias("run_md5"), F.md5(ordered("hyperlink")).alias("link_md5"), F.count_if((F.col("kind") == "run") & ~F.col("special")).cast("int").alias("runs"))


@query(rf"""{RICH_LINES} select doc_id::varchar path, case when bool_or(live and blank and regexp_matches(c, '[\p{{L}}\p{{N}}]')) then 'partial' else 'ok' end as status,
  true declared, '<new/>' font_table, any_value(source) copied, 2 * count(*) kept from t group by doc_id""")
def docx_untouched_parts(spark, sf_dir):
    """What the Word path must leave alone: declarations of the root, copied parts, drawings and bookmarks; the new font table."""
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    made = graph.written(translate.translate_docx(_rich_packages(spark, sf_dir), held, _marked, C.MODEL, C.DIRECTION, C.NOW, font_table=b"<new/>")[0])
    parts = documents.explode_docx_parts(made).select("path", "part_name", F.decode("part_bytes", "UTF-8").alias("x")).join(made.select("path", "status"), "path")
    one = lambda name, value: F.max(F.when(F.col("part_name") == name, value))
    kept = F.regexp_count("x", F.lit("<w:drawing/>")) + F.regexp_count("x", F.lit('<w:bookmarkStart w:id="0"/>'))
    return parts.groupBy("path", "status").agg(
        one("word/document.xml", F.col("x").contains('xmlns:w14="urn:fourteen" w14:Ignorable="w14"')).alias("declared"), one("word/fontTable.xml", F.col("x")).alias("font_table"),
        one("docProps/app.xml", F.col("x")).alias("copied"), one("word/document.xml", kept.cast("long")).alias("kept"),
    )


SHEET = """<w:style w:styleId="s0" w:type="paragraph"><w:rPr><w:sz w:val="{size}"/><w:u w:val="single"/></w:rPr></w:style><w:style w:styleId="s1" w:type="paragraph"><w:basedOn w:val="s0"/><w:rPr><w:color w:val="c{id}"/></w:rPr></w:style>
<w:style w:styleId="r0" w:type="character"><w:rPr><w:i/><w:color w:val="d{id}"/></w:rPr></w:style><w:style w:styleId="r1" w:type="character"><w:basedOn w:val="r0"/><w:rPr><w:b/></w:rPr></w:style>"""
STYLED = """<w:p><w:pPr><w:pStyle w:val="s1"/></w:pPr><w:r><w:t xml:space="preserve">{a} x</w:t></w:r><w:r><w:rPr><w:rStyle w:val="r1"/><w:sz w:val="99"/></w:rPr><w:t xml:space="preserve">{b} y</w:t></w:r><w:r><w:rPr><w:rStyle w:val="r1"/></w:rPr><w:t>-</w:t></w:r>
<m:oMath><m:r><m:rPr/><m:t>z</m:t></m:r><m:r><w:rPr><w:rStyle w:val="r1"/></w:rPr><m:t>{c} q</m:t></m:r></m:oMath><w:hyperlink><w:r><w:rPr><w:rStyle w:val="r1"/></w:rPr><w:t>link</w:t></w:r></w:hyperlink></w:p>"""


def _styled_packages(spark, sf_dir):
    """A Word package of each document whose styles hold its id; a paragraph of each line, with runs that lean on them."""
    names = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def filled(template: str, values: dict):
        return F.concat(*[values[bit] if k % 2 else F.lit(bit) for k, bit in enumerate(re.split(r"\{(\w+)\}", template))])

    line = lambda x: filled(STYLED, {"a": safe(F.substring(x, 1, 9)), "b": safe(F.substring(x, 10, 9)), "c": safe(F.substring(x, 19, 9))})
    body = F.concat(F.lit(f"<w:document {names}><w:body>"), F.array_join(F.transform(F.split("text", "\n", -1), line), ""), F.lit("</w:body></w:document>"))
    sheet = F.concat(F.lit(f"<w:styles {names}>"), filled(SHEET, {"id": F.col("doc_id").cast("string"), "size": (F.col("doc_id") % 30 + 10).cast("string")}), F.lit("</w:styles>"))
    part = lambda n, name, x: F.struct(F.lit(n).alias("part_no"), F.lit(name).alias("part_name"), x.cast("binary").alias("part_bytes"))
    named = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(part(0, "word/document.xml", body), part(1, "word/styles.xml", sheet))).alias("p"))
    none = spark.createDataFrame([], "path string, part_name string, para_no int, run_no int, text string")
    return documents.assemble_docx(named.select("path", "p.*", F.lit("ok").alias("status")), none)


@query("""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 n, unnest(string_split(text, chr(10))) line from documents),
  r as (select *, unnest([{'run_no': 0, 'kind': 'run', 'rstyle': null, 'p': true, 'c': false, 'sz': null}, {'run_no': 1, 'kind': 'run', 'rstyle': null, 'p': true, 'c': true, 'sz': '99'}, {'run_no': 2, 'kind': 'run', 'rstyle': 'r1', 'p': false, 'c': false, 'sz': null},
    {'run_no': 0, 'kind': 'math_run', 'rstyle': null, 'p': false, 'c': false, 'sz': null}, {'run_no': 1, 'kind': 'math_run', 'rstyle': null, 'p': false, 'c': true, 'sz': null}, {'run_no': 4, 'kind': 'hyperlink', 'rstyle': 'r1', 'p': false, 'c': false, 'sz': null}], recursive := true) from l)
  select doc_id::varchar path, n::int para_no, run_no::int run_no, kind, rstyle, coalesce(sz, case when p then (doc_id % 30 + 10)::varchar end) size, case when c then 'd' || doc_id when p then 'c' || doc_id end color,
    c bold, case when p then 'single' end line, true same from r""")
def materialize_docx_styles(spark, sf_dir):
    """The Word path over styled packages with a translator that changes nothing: the properties of every run afterwards, and
    whether each package but for its run properties and style sheet is as it was."""
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    given = graph.written(_styled_packages(spark, sf_dir))
    made = graph.written(translate.translate_docx(given, held, lambda texts: texts, C.MODEL, C.DIRECTION, C.NOW, style_sheet=b"<new/>")[0])
    parts = documents.explode_docx_parts(made)
    rest = F.md5(F.regexp_replace(F.decode("part_bytes", "UTF-8"), "<w:rPr>.*?</w:rPr>", ""))
    old, new = (documents.explode_docx_parts(x).filter("part_no = 0").select("path", rest.alias(c)) for x, c in ((given, "old"), (made, "new")))
    same = old.join(new, "path").select("path", F.col("old").eqNullSafe(F.col("new")).alias("same"))
    runs = documents.parse_docx_runs(parts.filter("action = 'process'"), formulas=True).filter("kind <> 'non_text'")
    val = lambda tag: F.col("rpr")[tag]["val"]
    found = runs.select("path", "para_no", "run_no", "kind", "rstyle", val("sz").alias("size"), val("color").alias("color"), F.map_contains_key("rpr", "b").alias("bold"), val("u").alias("line"))
    return found.join(same, "path")


def _groups(texts):
    """A translator of style files: one ideograph becomes a keyword; numbered blocks come back parted by ---."""
    def one(t):
        blocks = re.split(r"(?:\A|\n\n)【块\d+】\n", t)
        return "---".join(b.replace("第", "Chapter") for b in (blocks[1:] or blocks))
    return texts.map(one)


@query(duck(rf"""+ {C.BLOCKS}, n as (select doc_id, start_line, end_line, regexp_replace({C.STRIP.format("replace(content, '第', 'Chapter')")}, '({'|'.join(T.KEYWORDS)})(\[a-zA-Z])', ' ', 'g') as new from chinese),
  l as (select c.doc_id, c.line_no, case when n.new is not null then n.new else c.line end line from cls_lines_v c left join n on n.doc_id = c.doc_id and n.start_line = c.line_no
    where not exists (select 1 from n m where m.doc_id = c.doc_id and c.line_no > m.start_line and c.line_no <= m.end_line)),
  t as (select doc_id, string_agg(line, chr(10) order by line_no) as text from l group by doc_id), f as (select doc_id, count(*) found from chinese group by 1)
  select doc_id, md5(case when found is null then text else regexp_replace(text, '
{{4,}}', chr(10)||chr(10)||chr(10), 'g') end) text_md5, coalesce(found, 0) blocks_found, coalesce(found, 0) blocks_translated from t left join f using (doc_id)""", "cls_lines_v"))
def translate_style_files(spark, sf_dir):
    """The style-file path over all files, with its report."""
    out, report = translate.translate_style_files(markdown.reassemble(view(spark, sf_dir, "cls_lines_v")), _groups)
    return out.join(report, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "blocks_found", "blocks_translated")


PROJECT = "select 'p/f' || s_suppkey || '.tex' path, s_name || ' is file number ' || s_suppkey || '.' t, s_suppkey k from supplier where s_suppkey%11 <> 7"


@query(duck(f"""+ f as ({PROJECT}), r(node) as (select min(k) from f union select dst from r join file_edges_v on src = node where dst in (select k from f)),
  e as (select src, string_agg(' ' || chr(92) || 'input{{f' || dst || '}}', '' order by dst) refs from file_edges_v group by src)
  select path, case when k in (select node from r) then 'translate' else 'copy' end as action, md5(case when k in (select node from r) then 'T:' else '' end || t || coalesce(refs, '')) text_md5 from f left join e on src = k""", "file_edges_v", recursive=True))
def translate_project(spark, sf_dir):
    """The project path: what the first file reaches is translated, all else is copied."""
    files = spark.sql(PROJECT.replace("supplier where", "{supplier} where"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    refs = F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: F.concat(F.lit(" \\input{f"), x.cast("string"), F.lit("}"))), "")
    edges = view(spark, sf_dir, "file_edges_v").groupBy(F.col("src").alias("k")).agg(refs.alias("refs"))
    files = files.join(edges, "k", "left").select("path", F.concat("t", F.coalesce("refs", F.lit(""))).alias("text"), "k")
    mains = files.orderBy("k").limit(1).select("path")
    held = spark.createDataFrame([], "cache_key string, text string, ts_raw string")
    out = translate.translate_project(files.select("path", "text"), mains, held, C._prefix, C.MODEL, C.DIRECTION, C.NOW)[0]
    return out.select("path", "action", F.md5("text").alias("text_md5"))
