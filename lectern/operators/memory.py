"""Translation memory: (cache_key, text, ts_raw), read, looked up, merged, aged and limited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.operators.graph import written

#: Entries with more characters on either side are not stored; stored ones of STORED or more are dropped at load.
ENTRY, STORED = 20_000, 50_000
#: Limits of a desktop memory; paths take the second alone, as the first would empty the memory of a corpus.
MAX_ENTRIES, MAX_DAYS = 10_000, 30


def from_json_maps(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Memory of JSON files key -> {text, timestamp} or key -> text; entries of the second kind are as old as `now`.

    What a value is, an object or a text, is told by its JSON type, so that texts may begin as they like. A missing text
    is empty, a missing time unreadable; values of other types are left out, as are files that hold no JSON object.
    """
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", "map<string,variant>")).alias("cache_key", "v"))
    kind, part = F.schema_of_variant("v"), lambda p: F.try_variant_get("v", p, "string")
    text = F.when(kind == "STRING", part("$")).when(kind.startswith("OBJECT"), F.coalesce(part("$.text"), F.lit("")))
    rows = entries.select("cache_key", text.alias("text"), F.when(kind == "STRING", F.lit(now)).otherwise(F.coalesce(part("$.timestamp"), F.lit(""))).alias("ts_raw"))
    return rows.filter(F.col("text").isNotNull() & (F.length("text") < STORED))


def aged(memory: DataFrame, now: str, days: int | None = MAX_DAYS, most: int | None = None) -> DataFrame:
    """The memory as a path takes it: expired entries go, then the oldest beyond `most`; None leaves a limit out."""
    kept = memory if days is None else expire(memory, now, days)
    return kept if most is None else evict(kept, most)


def lookup(units: DataFrame, memory: DataFrame) -> DataFrame:
    """units with `stored`: the text under their key, null where there is none or an empty one."""
    return units.join(memory.select("cache_key", F.nullif("text", F.lit("")).alias("stored")), "cache_key", "left")


def misses(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Units whose key has no usable text, each key once."""
    return units.join(memory.filter("text <> ''").select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def merge(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Memory with fresh entries (cache_key, source, text, ts_raw); the fresh win, over-long ones are left out."""
    new = fresh.filter((F.length("source") <= ENTRY) & (F.length("text") <= ENTRY)).select("cache_key", "text", "ts_raw", F.lit(1).alias("w"))
    both = memory.select("cache_key", "text", "ts_raw", F.lit(0).alias("w")).unionByName(new)
    return both.groupBy("cache_key").agg(F.max_by(F.struct("text", "ts_raw"), F.struct("w", "ts_raw", "text")).alias("e")).select("cache_key", "e.text", "e.ts_raw")


def _time(ts_raw: Column) -> Column:
    return F.try_to_timestamp(ts_raw)


def expire(memory: DataFrame, now: str, days: int = MAX_DAYS) -> DataFrame:
    """Entries that are not older than `days`; those with unreadable times stay."""
    return memory.filter(is_fresh(F.col("ts_raw"), now, days))


def is_fresh(ts_raw: Column, now: str, days: int) -> Column:
    """Whether a time is unreadable or at most so many days before now."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return _time(ts_raw).isNull() | (_time(ts_raw) >= cutoff)


def evict(memory: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The newest entries by the text of their time, null the oldest; ties by key. Keys are unique: repeats of the last one stay.

    Times and keys alone are dealt out by ranges and counted; the range in which `most` is reached gives the last key that
    stays, and what is kept is a filter on the memory, so no task ever takes more than one range.
    """
    time, order = F.coalesce("ts_raw", F.lit("")), [F.col("t").desc(), F.col("cache_key").asc()]
    laid = written(memory.select(time.alias("t"), "cache_key").repartitionByRange(*order).withColumn("p", F.spark_partition_id()))
    left = most
    for p, n in sorted(tuple(r) for r in laid.groupBy("p").count().collect()):  # a row for each range
        if left <= n:
            break
        left -= n
    else:
        return memory
    if left < 1:
        return memory.limit(0)
    last = laid.filter(F.col("p") == p).orderBy(*order).offset(left - 1).first()
    return memory.filter((time > last["t"]) | ((time == last["t"]) & (F.col("cache_key") <= last["cache_key"])))


def stats(looked_up: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """One row: hits, misses, total, hit_rate in percent; with a memory, its entries and the bytes of their keys, texts and times."""
    hit = F.col("stored").isNotNull()
    counts = looked_up.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count("*").alias("total"))
    rated = counts.withColumn("hit_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100 * F.col("hits") / F.col("total"), 1)))
    if memory is None:
        return rated
    width = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in ("cache_key", "text", "ts_raw")), F.lit(0))
    return rated.join(memory.agg(F.count("*").alias("entries"), F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("bytes")), F.lit(True))  # one row each


def age_distribution(memory: DataFrame, now: str) -> DataFrame:
    """(age, n, percent) by whole days since an entry's time; times to come count as this week, unreadable ones as unknown."""
    days = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(_time(F.col("ts_raw")))) / 86400)
    age = F.when(days.isNull(), "Unknown").when(days == 0, "Today").when(days <= 7, "This week").when(days <= 30, "This month").when(days <= 90, "Last 3 months").otherwise("Older")
    counts = memory.groupBy(age.alias("age")).agg(F.count("*").alias("n"))  # six rows at most
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(total, F.lit(True)).select("age", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))
