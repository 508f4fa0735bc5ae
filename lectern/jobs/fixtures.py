"""Views over the given tables that hold what the operators work on; each text runs in Spark and in DuckDB alike.

The given documents are plain prose, so fences, tables, commands, styles and references are laid into them by rules on
line numbers and keys. Nothing is left out: each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES_SPARK = "select doc_id, pos line_no, col line from documents lateral view posexplode(split(text, chr(10), -1)) t as pos, col"
LINES_DUCK = "select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int line_no, unnest(string_split(text, chr(10))) line from documents"

#: Views by name, each may use those before it.
VIEWS = {
    "md_lines_v": """select doc_id, line_no, case line_no%23
        when 0 then '```' when 5 then '    '||line when 7 then '| --- | --- |' when 9 then '<div class="x">' when 11 then '---'
        when 13 then 'key: '||line when 15 then '  '||line when 17 then '' when 19 then '# '||line else line end line from lines_v""",
    "tex_lines_v": """select doc_id, line_no, case line_no%6
        when 0 then chr(92)||'cite[p]{k'||line_no||'} '||line when 1 then 'See '||chr(92)||'ref{s'||line_no||'}. '||line
        when 2 then chr(92)||'newcommand{'||chr(92)||'x}{'||chr(92)||'ref{n'||line_no||'}}' else line end line from lines_v""",
    "cls_lines_v": """select doc_id, line_no, case line_no%9
        when 0 then chr(92)||'def'||chr(92)||'a{第'||line_no||'章}' when 1 then chr(92)||'def'||chr(92)||'b{x}' when 2 then '% 注释 '||line_no
        when 3 then chr(92)||'newcommand{'||chr(92)||'c}{' when 4 then '  图~}' when 5 then chr(92)||'newtheorem{t}{定理}'
        when 6 then chr(92)||'setlength{'||chr(92)||'p}{2pt} % 缩进' when 7 then '' else line end line from lines_v""",
    "runs_v": """select l_orderkey para_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
        l_shipdate, l_quantity, l_extendedprice)-1 as int) run_no, l_returnflag||l_linestatus style_key, l_partkey%50 run_style,
        l_quantity > 45 special, case when l_quantity > 45 then '' else 'w'||l_suppkey||' ' end txt from lineitem""",
    "styles_v": """select p_partkey style_id, case when p_partkey=0 then null when p_partkey%97=0 then p_partkey
        else cast(floor(p_partkey/3) as int) end based_on, case when p_size%3=0 then p_size end sz,
        case when p_size%5=0 then p_brand end color from part""",
    "file_edges_v": """select s_suppkey src, 2*s_suppkey+1 dst from supplier where s_suppkey%3<>2 union all
        select s_suppkey, 2*s_suppkey+2 from supplier union all
        select s_suppkey, cast(floor(s_suppkey/4) as int) from supplier where s_suppkey%4=3""",
    "file_listing_v": "select s_suppkey file_id from supplier where s_suppkey%11<>7",
    "tm_v": """select md5(line||'|m|en-to-zh') cache_key, case when substr(md5(line),1,1)='0' then '' else 'T:'||line end txt,
        case when substr(md5(line),3,1)='0' then 'bad' else substr(cast(cast('2024-01-01' as timestamp) + (min(doc_id)%120) * interval '1' day
        as varchar(30)),1,10) end ts_raw from lines_v where substr(md5(line),2,1) < '8' group by line""",
    "replies_v": """select cast(floor(event_id/3) as bigint) unit_id, event_id%3 attempt,
        case when floor(event_id/3)%2=0 then 'a <placeholder> b' else 'plain text' end src,
        case event_id%7 when 0 then 'Sorry, I can'||chr(39)||'t help.' when 1 then 'CRITICAL RULES apply'
        when 2 then 'x < placeholder > y' when 3 then '"quoted reply"' when 4 then 'x <placeholder, y' when 5 then ''
        else 'a longer reply without any mark' end reply from events""",
    "project_files_v": """select page_id, case page_id%7 when 0 then 'build/a' when 1 then '.git/b' when 2 then 'ch/c' else 'd' end||page_id||
        case page_id%8 when 0 then '.tex' when 1 then '.AUX' when 2 then '.png' when 3 then '.synctex.gz' when 4 then '.bib'
        when 5 then '' when 6 then '.log' else '.cls' end path from pages""",
}
TABLES = {"lines_v": "documents", "runs_v": "lineitem", "styles_v": "part", "file_edges_v": "supplier", "file_listing_v": "supplier", "replies_v": "events", "project_files_v": "pages"}
ON_LINES = ("md_lines_v", "tex_lines_v", "cls_lines_v", "tm_v")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of sf_dir."""
    if name == "lines_v":
        return spark.sql(LINES_SPARK.replace("documents", "{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text, table = VIEWS[name].replace("{", "{{").replace("}", "}}"), TABLES.get(name, "lines_v")
    rows = view(spark, sf_dir, "lines_v") if name in ON_LINES else spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.replace(f"from {table}", f"from {{{table}}}"), **{table: rows})


def duck(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text of a query over views."""
    parts = []
    if any(n == "lines_v" or n in ON_LINES for n in names):
        parts.append(f"lines_v as ({LINES_DUCK})")
    parts += [f"{n} as ({VIEWS[n]})" for n in VIEWS if n in names]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"
