"""References between files: found in text, resolved against a listing, and followed to the end."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import strip

# References to classes, packages and style files.
CLASS = r"\\documentclass(?:\[.*?\])?\{([^}]+)\}"
PACKAGE = r"\\usepackage(?:\[.*?\])?\{([^}]+)\}"
REQUIRED = r"\\RequirePackage(?:\[.*?\])?\{([^}]+)\}"
STYLE_INPUT = r"\\input\{([^}]+\.(?:cls|sty))\}"
# What a project copy leaves out.
EXCLUDED_DIRS = ["__pycache__", "node_modules", "build", "dist", "__MACOSX"]
EXCLUDED_ENDS = [".aux", ".log", ".out", ".toc", ".synctex.gz", ".fdb_latexmk", ".fls", ".bbl", ".blg", ".bcf", ".run.xml", ".nav", ".snm", ".vrb", ".lof", ".lot", ".bak", ".swp", ".tmp", "~", ".xdv"]


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes at the end, with the shuffle files of its jobs: for steps whose tables nobody reads afterwards."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        gc.collect()
        spark._jvm.System.gc()  # shuffle files go once the driver has collected what they belong to


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that a loop's plan doesn't grow and nothing is worked out twice."""
    path = shared_folder(df.sparkSession)
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_refs(files: DataFrame) -> DataFrame:
    """(src, kind, raw) of input and include in files (path, content)."""
    hits = lambda kind: F.transform(F.regexp_extract_all("content", F.lit(rf"\\{kind}\{{([^}}]+)\}}"), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
    return files.select(F.col("path").alias("src"), F.explode(F.concat(hits("input"), hits("include"))).alias("x")).select("src", "x.*")


def style_refs(files: DataFrame) -> DataFrame:
    """(src, kind, raw) of classes and packages in files (path, content), lists split, with the extension of their kind."""

    def hits(pattern: str, kind: str, end: str) -> Column:
        names = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x: F.split(x, ",")))
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), F.concat(F.trim(x), F.lit(end)).alias("raw")))

    found = F.concat(hits(CLASS, "class", ".cls"), hits(PACKAGE, "package", ".sty"), hits(REQUIRED, "package", ".sty"), hits(STYLE_INPUT, "input", ""))
    return files.select(F.col("path").alias("src"), F.explode(found).alias("x")).select("src", "x.*")


def folder_of(path: Column) -> Column:
    """Folder of a path, with its slash; empty for a bare name."""
    return F.regexp_extract(path, r"\A(.*/)[^/]*\z", 1)


def resolve_refs(refs: DataFrame, listing: DataFrame, add: str = ".tex", root: str | None = None) -> DataFrame:
    """refs with `dst` (stripped, `add` appended unless it ends so, taken from a folder unless absolute) and `found` in listing (path).

    The folder is that of src, as for input and include; for classes and packages it is the project's: `root` names the
    column of refs that holds a file in it, whichever file refers to them.
    """
    raw = strip(F.col("raw"))
    named = F.when(raw.endswith(add), raw).otherwise(F.concat(raw, F.lit(add)))
    folder = folder_of(F.col(root or "src"))
    placed = refs.withColumn("dst", F.when(named.startswith("/"), named).otherwise(F.concat(folder, named)))
    known = listing.select(F.col("path").alias("dst"), F.lit(True).alias("found")).distinct()
    return placed.join(known, "dst", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def closure(roots: DataFrame, edges: DataFrame, listing: DataFrame) -> DataFrame:
    """(root, node, depth): what each root reaches over edges (src, dst) to nodes of listing (node), itself at depth 0.

    Breadth first: each round joins the frontier with the edges and drops what was reached, so cycles end. Each round
    is written to the shared folder.
    """
    edges = written(edges.join(listing.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    seen = frontier = written(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = written(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(frontier)


def style_reach(roots: DataFrame, refs: DataFrame, listing: DataFrame) -> DataFrame:
    """(root, node): the classes and packages of listing (path) that each root reaches over refs (src, kind, raw), its own folder
    being where they stand; roots: (root, node), the files of each to begin with, which are listed too.

    A name means another file under another root, so roots are followed each for itself, a step at a time: classes build on
    few others, and what is reached again is dropped.
    """
    refs = written(refs.select("src", "raw").distinct())
    seen = frontier = written(roots.select("root", "node").distinct())
    while True:
        named = frontier.join(refs, F.col("node") == F.col("src")).select("root", "src", "raw")
        step = resolve_refs(named, listing, "", "root").filter("found").select("root", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, ["root", "node"], "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)


def keep_project_files(files: DataFrame) -> DataFrame:
    """Files (path) outside excluded and hidden folders that are neither hidden nor products of a build."""
    parts = F.split("path", "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    bad = F.exists(folders, lambda x: x.isin(*EXCLUDED_DIRS) | x.startswith("."))
    product = F.lit(False)
    for end in EXCLUDED_ENDS:
        product = product | F.lower("path").endswith(end)
    return files.filter(~bad & ~name.startswith(".") & ~product)


def file_type_counts(files: DataFrame, most: int = 15) -> DataFrame:
    """(ext, n) of the most frequent extensions."""
    ext = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)\z", 1))
    return files.groupBy(F.when(ext == "", "(no extension)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(most)


def union_distinct_files(main: DataFrame, found: DataFrame) -> DataFrame:
    """(path, pos): files of both tables (path, pos), each at its first position."""
    return main.select("path", "pos").unionByName(found.select("path", "pos")).groupBy("path").agg(F.min("pos").alias("pos"))


def unprocessed_files(files: DataFrame, done: DataFrame, targets: DataFrame, output_dir: str) -> DataFrame:
    """Files (path, mtime) not done (path), outside the output folder, whose target (path, mtime) isn't newer."""
    newer = targets.select("path", F.col("mtime").alias("target_mtime"))
    left = files.join(done.select("path"), "path", "left_anti").filter(~F.col("path").startswith(output_dir.rstrip("/") + "/"))
    return left.join(newer, "path", "left").filter(F.coalesce(~(F.col("target_mtime") > F.col("mtime")), F.lit(True))).select("path", "mtime")


def output_path(path: Column, direction: Column) -> Column:
    """Where a translated file goes: <base>_translated_<direction><ext>; style files <base>_en<ext>."""
    base, ext = F.regexp_extract(path, r"\A(.*?)(\.[^./]+)?\z", 1), F.regexp_extract(path, r"(\.[^./]+)\z", 1)
    return F.when(F.lower(ext).isin(".cls", ".sty"), F.concat(base, F.lit("_en"), ext)).otherwise(F.concat(base, F.lit("_translated_"), direction, ext))


def route_by_format(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supported files with their `format`, the others)."""
    named = files.withColumn("format", F.ltrim(F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)), F.lit(".")))
    known = F.col("format").isin("docx", "md", "tex", "cls", "sty")
    return named.filter(known), named.filter(~known)


def project_report(files: DataFrame) -> DataFrame:
    """(project, succeeded, total, ok) of files (project, ok)."""
    return files.groupBy("project").agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"), F.every("ok").alias("ok"))
