"""Styles of Word packages: inheritance, effective properties of runs, runs that belong together."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import PLACEHOLDER, SEGMENT, is_meaningful, strip
from lectern.operators.graph import written

PROPS = "map<string,map<string,string>>"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def merge_maps(over: Column, under: Column, kind: str = PROPS) -> Column:
    """Entries of both maps, those of `over` where both have a key; null counts as empty."""
    over, under = F.coalesce(over, F.create_map().cast(kind)), F.coalesce(under, F.create_map().cast(kind))
    return F.map_concat(over, F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)))


def map_key(props: Column) -> Column:
    """A map as text with its keys sorted, for comparison; null as an empty map."""
    inner = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    entries = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("{"), F.array_join(inner(e["value"]), ";"), F.lit("}")))
    return F.coalesce(F.array_join(F.array_sort(entries), ","), F.lit(""))


def run_key(kind: str = "kind", block: str = "block", rpr: str = "rpr", rstyle: str = "rstyle") -> Column:
    """Key by which neighbouring runs belong together: equal properties and run styles, nothing between; all runs of a hyperlink."""
    return F.when(F.col(kind) == "hyperlink", F.concat(F.lit("link:"), F.col(block))).otherwise(F.concat_ws(":", kind, block, F.coalesce(rstyle, F.lit("")), map_key(F.col(rpr))))


def _nodes(styles: DataFrame) -> DataFrame:
    """(path, node, up): every style with the one that it is based on, and every missing one that is named; ends have no up."""
    own = styles.groupBy("path", F.col("style_id").alias("node")).agg(F.min("based_on").alias("up"))  # an id is there once
    named = own.filter("up is not null").select("path", F.col("up").alias("node")).join(own, ["path", "node"], "left_anti").distinct()
    return written(own.unionByName(named.withColumn("up", F.lit(None).cast("string"))))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (path, node, far) of nodes (path, node, up): entry k has the ancestor 2^k steps up of all nodes that have one.

    Each round joins a table with itself, so a chain of n styles takes log n of them. Circles would never end: the last
    table then holds the nodes that lead into one, with a node of it.
    """
    most = nodes.count()
    found = [written(nodes.filter("up is not null").select("path", "node", F.col("up").alias("far")))]
    while True:
        last = found[-1]
        on = last.select("path", F.col("node").alias("far"), F.col("far").alias("farther"))
        step = written(last.join(on, ["path", "far"]).select("path", "node", F.col("farther").alias("far")))
        if not step.limit(1).count():
            return found
        found.append(step)
        if 1 << (len(found) - 1) > most:
            return found


def _reached(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(path, node, depth, ancestor): nodes at depth 0 and all their ancestors, where no chain is a circle."""
    out = nodes.select("path", "node", F.lit(0).alias("depth"), F.col("node").alias("ancestor"))
    for k, jump in enumerate(jumps):
        on = out.select("path", F.col("node").alias("far"), "depth", "ancestor")
        out = written(out.unionByName(jump.join(on, ["path", "far"]).select("path", "node", (F.col("depth") + (1 << k)).alias("depth"), "ancestor")))
    return out


def style_chain(styles: DataFrame) -> DataFrame:
    """(path, style_id, depth, ancestor): each style at depth 0, then its ancestors.

    An ancestor that is missing or stands in the chain already is listed once more as the last entry, so chains of any
    length end. styles: (path, style_id, based_on). A chain of n styles takes log n rounds; where styles stand in a circle,
    it is opened behind its smallest style, and what is found on the way there is put together again.
    """
    nodes = _nodes(styles)
    known = styles.select("path", F.col("style_id").alias("node")).distinct()
    own = nodes.filter("up = node").select("path", "node")  # styles based on themselves: a circle of one
    jumps = _jumps(nodes.withColumn("up", F.when(F.col("up") != F.col("node"), F.col("up"))))
    most = nodes.count()
    ring = None
    if 1 << (len(jumps) - 1) > most:
        ring = written(jumps[-1].select("path", F.col("far").alias("node")).distinct())
        circle = nodes.join(ring, ["path", "node"], "left_semi")
        least = circle.select("path", "node", F.col("node").alias("low"))
        for jump in jumps:  # the smallest of the next 2^k styles of a circle
            on = least.select("path", F.col("node").alias("far"), F.col("low").alias("lower"))
            least = written(least.join(jump, ["path", "node"]).join(on, ["path", "far"]).select("path", "node", F.least("low", "lower").alias("low")))
        steps = _jumps(circle.join(least, ["path", "node"]).withColumn("up", F.when(F.col("up") != F.col("low"), F.col("up"))).select("path", "node", "up"))
        away = _reached(circle, steps).groupBy("path", "node").agg(F.max("depth").alias("left"))  # steps to the last style before the smallest
        placed = written(least.join(away, ["path", "node"]))
        size = placed.groupBy("path", "low").agg((F.max("left") + 1).alias("size"))
        other = placed.select("path", "low", F.col("node").alias("ancestor"), F.col("left").alias("there"))
        around = placed.join(size, ["path", "low"]).join(other, ["path", "low"]).select("path", "node", F.pmod(F.col("left") - F.col("there"), F.col("size")).alias("depth"), "ancestor")
        around = written(around.unionByName(placed.join(size, ["path", "low"]).select("path", "node", F.col("size").alias("depth"), F.col("node").alias("ancestor"))))
        straight = nodes.join(ring.withColumn("in", F.lit(True)), ["path", "node"], "left").withColumn("up", F.when(F.col("in").isNull() & (F.col("up") != F.col("node")), F.col("up"))).select("path", "node", "up")
        jumps = _jumps(written(straight))
    out = _reached(nodes, jumps)
    if ring is not None:
        into = out.join(ring.withColumnRenamed("node", "ancestor"), ["path", "ancestor"], "left_semi").select("path", F.col("node").alias("style_id"), F.col("depth").alias("before"), F.col("ancestor").alias("node"))
        more = into.join(around.filter("depth > 0"), ["path", "node"]).select("path", F.col("style_id").alias("node"), (F.col("before") + F.col("depth")).cast("int").alias("depth"), "ancestor")
        out = out.unionByName(more)
    again = out.join(own.withColumnRenamed("node", "ancestor"), ["path", "ancestor"], "left_semi").select("path", "node", (F.col("depth") + 1).alias("depth"), "ancestor")
    return out.unionByName(again).join(known, ["path", "node"], "left_semi").select("path", F.col("node").alias("style_id"), "depth", "ancestor")


def resolve_styles(styles: DataFrame, rpr: str = "rpr", kind: str = PROPS) -> DataFrame:
    """(path, style_id, rpr): properties merged over the chain, those of the nearest style win, tag by tag.

    rpr names the map of properties by tag, of type `kind`. Each round merges the properties of 2^k styles up with those
    of the next 2^k, so a chain of n styles takes log n rounds; in a circle nothing new is found after one turn.
    """
    none = F.create_map().cast(kind)
    base = styles.dropDuplicates(["path", "style_id"]).select("path", "style_id", F.when(F.col("based_on") != F.col("style_id"), F.col("based_on")).alias("far"), F.coalesce(rpr, none).alias("rpr"))
    table, rounds = written(base), 0
    most = table.count()
    while 1 << rounds <= most and table.filter("far is not null").limit(1).count():
        on = table.select("path", F.col("style_id").alias("far"), F.col("far").alias("farther"), F.col("rpr").alias("under"))
        step = table.filter("far is not null").join(on, ["path", "far"], "left").select("path", "style_id", F.col("farther").alias("far"), merge_maps(F.col("rpr"), F.col("under"), kind).alias("rpr"))
        table, rounds = written(step.unionByName(table.filter("far is null"))), rounds + 1
    return table.select("path", "style_id", "rpr")


def style_sizes(resolved: DataFrame) -> DataFrame:
    """(path, style_id, size) of styles with a numeric size."""
    size = F.col("rpr")["sz"]["val"]
    return resolved.filter(size.rlike(r"\A[0-9]+\z")).select("path", "style_id", size.cast("int").alias("size"))


def style_listing(styles: DataFrame) -> DataFrame:
    """(path, style_id, chain, size) by id."""
    chain = F.array_sort(F.collect_list(F.struct("depth", "ancestor")))
    chains = style_chain(styles).groupBy("path", "style_id").agg(F.transform(chain, lambda x: x["ancestor"]).alias("chain"))
    return chains.join(style_sizes(resolve_styles(styles)), ["path", "style_id"], "left").orderBy("path", "style_id")


def materialize_run_styles(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    """runs with effective `rpr`: paragraph style, overlaid by run style, overlaid by their own; the run-style link goes.

    runs: (path, text, pstyle, rstyle, rpr, math). Runs without meaningful text stay as they are; formulas skip the
    paragraph's style.
    """
    para = resolved.select("path", F.col("style_id").alias("pstyle"), F.col("rpr").alias("p_rpr"))
    run = resolved.select("path", F.col("style_id").alias("rstyle"), F.col("rpr").alias("r_rpr"))
    joined = runs.join(para, ["path", "pstyle"], "left").join(run, ["path", "rstyle"], "left")
    under = merge_maps(F.col("r_rpr"), F.when(~F.col("math"), F.col("p_rpr")))
    own = F.map_filter(F.coalesce("rpr", F.create_map().cast(PROPS)), lambda k, _: k != "rStyle")
    live = is_meaningful(F.col("text"))
    return joined.select(*[c for c in runs.columns if c not in ("rpr", "rstyle")], F.when(live, F.lit(None)).otherwise(F.col("rstyle")).alias("rstyle"), F.when(live, merge_maps(own, under)).otherwise(F.col("rpr")).alias("rpr"))


def inherited_properties(runs: DataFrame, resolved: DataFrame, fonts: tuple[str, str] | None = None, languages: tuple[str, str] | None = None) -> DataFrame:
    """(path, part_name, para_no, run_no, math_run, xml, drop) of the runs whose own properties don't say all: elements that they
    inherit from run style and paragraph style, by tag, and the tags of their own that go, the run-style link among them.

    runs: as parsed, those in formulas included; resolved: (path, style_id, rpr) with whole elements by tag. Runs without a
    letter or digit and those of hyperlinks are left out; formulas skip the paragraph's style. fonts and languages, Latin
    and East Asian, go to all runs where they are given.
    """
    xml = "map<string,string>"
    para, own = (resolved.select("path", F.col("style_id").alias(c), F.col("rpr").alias(f"{c}_xml")) for c in ("pstyle", "rstyle"))
    live = runs.filter(F.col("lettered") & F.col("kind").isin("run", "math_run")).withColumn("math_run", F.col("kind") == "math_run")
    joined = live.join(para, ["path", "pstyle"], "left").join(own, ["path", "rstyle"], "left")
    under = merge_maps(F.col("rstyle_xml"), F.when(~F.col("math_run"), F.col("pstyle_xml")), xml)
    forced = {}
    if fonts:
        forced["rFonts"] = f'<w:rFonts xmlns:w="{WORD}" w:ascii={quoteattr(fonts[0])} w:hAnsi={quoteattr(fonts[0])} w:eastAsia={quoteattr(fonts[1])} w:hint="eastAsia"/>'
    if languages:
        forced["lang"] = f'<w:lang xmlns:w="{WORD}" w:val={quoteattr(languages[0])} w:eastAsia={quoteattr(languages[1])}/>'
    drop = F.array(*[F.lit(x) for x in ("rStyle", *forced)])
    missing = F.map_filter(under, lambda k, _: ~F.map_contains_key("rpr", k) & ~F.array_contains(drop, k))
    listed = F.concat(F.transform(F.array_sort(F.map_entries(missing)), lambda x: x["value"]), F.array(*[F.lit(x) for x in forced.values()]).cast("array<string>"))
    made = joined.select("path", "part_name", "para_no", "run_no", "math_run", listed.alias("xml"), drop.alias("drop"), "rstyle")
    return made.filter((F.size("xml") > 0) | F.col("rstyle").isNotNull()).drop("rstyle")


def number_segments(runs: DataFrame, para: list[str]) -> DataFrame:
    """runs with `seg_no`: neighbouring ordinary runs of one style_key share it; a special run (drawing, field, formula) is alone."""
    order = Window.partitionBy(*para).orderBy("run_no")
    same = (F.lag("style_key").over(order).eqNullSafe(F.col("style_key"))) & ~F.col("special") & ~F.coalesce(F.lag("special").over(order), F.lit(True))
    return runs.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("seg_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


def merge_adjacent_runs(runs: DataFrame, para: list[str]) -> DataFrame:
    """(para, seg_no, style_key, special, text, first_run, runs): neighbouring ordinary runs of one style_key as one segment, in order.

    runs: (para, run_no, style_key, special, text). A special run is a segment of its own.
    """
    texts = F.array_sort(F.collect_list(F.struct("run_no", "text")))
    return number_segments(runs, para).groupBy(*para, "seg_no").agg(
        F.min_by("style_key", "run_no").alias("style_key"), F.min_by("special", "run_no").alias("special"), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"), F.min("run_no").alias("first_run"),
        F.transform(texts, lambda x: x["run_no"]).alias("runs"),
    )


def segment_lists(segments: DataFrame, para: list[str]) -> DataFrame:
    """(para, segs, text_for_model): the segments (special, text, runs) of each paragraph in order, and its text as
    build_model_text makes it; paragraphs without meaningful text are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "special", "text", "runs")))
    listed = segments.groupBy(*para).agg(F.transform(ordered, lambda x: F.struct(x["special"].alias("special"), x["text"].alias("text"), x["runs"].alias("runs"))).alias("segs"))
    shown = F.transform("segs", lambda x: F.when(x["special"], PLACEHOLDER).otherwise(x["text"]))
    return listed.filter(F.exists("segs", lambda x: ~x["special"] & is_meaningful(x["text"]))).withColumn("text_for_model", F.array_join(shown, SEGMENT))


def segment_changes(segs: Column, reply: Column) -> tuple[Column, Column]:
    """What a reply changes in the segments of a paragraph, (runs, text) of those whose part is another text, and whether a
    text that was to be translated stays, as its part is missing or blank. Parts and segments are matched by place."""
    given = F.zip_with(segs, F.split(reply, SEGMENT, -1), lambda x, y: F.struct(x["special"].alias("special"), x["text"].alias("text"), x["runs"].alias("runs"), F.when(strip(y) != "", y).alias("part")))
    changed = F.filter(given, lambda x: ~x["special"] & F.coalesce(x["part"] != x["text"], F.lit(False)))
    stays = F.exists(given, lambda x: ~x["special"] & x["part"].isNull() & is_meaningful(x["text"]))
    return F.transform(changed, lambda x: F.struct(x["runs"].alias("runs"), x["part"].alias("text"))), stays


def build_model_text(segments: DataFrame, para: list[str]) -> DataFrame:
    """(para, n_segments, text_for_model): texts joined by the segment mark, special segments as placeholders; paragraphs
    without meaningful text are left out."""
    shown = F.when(F.col("special"), PLACEHOLDER).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", shown.alias("t"))))
    live = F.max(is_meaningful(F.col("text")) & ~F.col("special"))
    built = segments.groupBy(*para).agg(F.count("*").alias("n_segments"), F.array_join(F.transform(ordered, lambda x: x["t"]), SEGMENT).alias("text_for_model"), live.alias("live"))
    return built.filter("live").drop("live")


def attach_segment_translations(segments: DataFrame, replies: DataFrame, para: list[str]) -> DataFrame:
    """segments with `translated`, part i of the paragraph's reply, and `kept`: whether that part is missing or blank, so that
    the own text or placeholder stands in its place."""
    parts = replies.select(*para, F.posexplode(F.split("reply", SEGMENT, -1)).alias("seg_no", "part"))
    own = F.when(F.col("special"), PLACEHOLDER).otherwise(F.col("text"))
    given = F.when(strip(F.col("part")) != "", F.col("part"))
    return segments.join(parts, [*para, "seg_no"], "left").withColumn("translated", F.coalesce(given, own)).withColumn("kept", given.isNull()).drop("part")


def common_run_style(runs: DataFrame, group: list[str]) -> DataFrame:
    """(group, common): properties that all runs of a group have alike; those of the only run that has any; else null."""
    some = F.coalesce(F.size("rpr"), F.lit(0)) > 0
    counted = runs.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(some).alias("styled"))
    entry = runs.select(*group, F.explode("rpr").alias("tag", "attrs")).withColumn("k", map_key(F.create_map("tag", "attrs")))
    shared = entry.groupBy(*group, "tag", "k").agg(F.count("*").alias("times"), F.first("attrs").alias("attrs")).join(counted, group)
    shared = shared.filter((F.col("times") == F.col("n")) | (F.col("styled") == 1))
    made = shared.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("tag", "attrs"))).alias("common"))
    return counted.select(*group).join(made, group, "left")


def map_font_sizes(runs: DataFrame, sizes: DataFrame, size_map: DataFrame, default: int) -> DataFrame:
    """(path, para_no, old_size, new_size): size of a paragraph's first sized run, else of its style, else `default`,
    and what the map makes of it; sizes that it doesn't hold stay.

    runs: (path, para_no, run_no, size, pstyle); sizes: (path, style_id, size); size_map: (old_size, new_size).
    """
    first = runs.groupBy("path", "para_no").agg(F.min_by("size", F.when(F.col("size").isNotNull(), F.col("run_no"))).alias("own"), F.min_by("pstyle", "run_no").alias("style_id"))
    sized = first.join(sizes, ["path", "style_id"], "left").select("path", "para_no", F.coalesce("own", "size", F.lit(default)).alias("old_size"))
    return sized.join(size_map, "old_size", "left").select("path", "para_no", "old_size", F.coalesce("new_size", "old_size").alias("new_size"))


def set_run_fonts(rpr: Column, latin: str | None, asian: str | None) -> Column:
    """Properties with both fonts set; unchanged unless both names are given."""
    if not (latin and asian):
        return rpr
    font = F.create_map(*[F.lit(x) for x in ("ascii", latin, "hAnsi", latin, "eastAsia", asian)])
    return merge_maps(F.create_map(F.lit("rFonts"), font), rpr)


def materialize_report(runs: DataFrame) -> DataFrame:
    """(path, part_name, found, processed, linked, bold) of runs before materialisation (text, rstyle) and after (rpr)."""
    live = is_meaningful(F.col("text"))
    return runs.groupBy("path", "part_name").agg(
        F.count("*").alias("found"), F.count_if(live).alias("processed"), F.count_if(F.col("rstyle").isNotNull()).alias("linked"), F.count_if(live & F.map_contains_key("rpr", "b")).alias("bold")
    )


def classify_child(tag: Column, special: Column) -> Column:
    """Segment type of a paragraph's child (M10): null for one that is skipped."""
    formula = tag.isin("oMath", "oMathPara", "drawing", "object")
    return F.when(tag == "r", F.when(special, "non_text_node").otherwise("text_run_group")).when(formula, "non_text_node").when(tag == "hyperlink", "hyperlink")
