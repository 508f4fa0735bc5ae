"""SimHash fingerprints of documents and the search for all near ones, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.store import cut

BITS = 64
#: Hamming radius of the search, and the blocks that a fingerprint is cut into; all but `RADIUS` of them make a key.
RADIUS, BLOCKS = 3, 6
#: Tasks that the rows of one fingerprint are dealt out over.
SALTS = 8
#: Two votes are summed in one long: bit i in its lower half, bit i + 32 in its upper half.
_LANES = (1 << 32) | 1
_NO_ID = -(1 << 63)


def _votes(term: Column) -> tuple[Column, list[Column]]:
    """A term's weight and its weighted packed votes; long terms tell texts apart better than short ones."""
    weight = F.greatest(F.least(F.length(term), F.lit(15)) - 3, F.lit(1)).cast("long")
    weight = F.when(F.length(term) == 0, F.lit(0).cast("long")).otherwise(weight)
    return weight, [F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(_LANES)) * F.col("weight") for i in range(BITS // 2)]


def simhash(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fingerprint long) of each text that has a key: every occurrence of a term votes with its weight on all bits.

    A bit is set where the votes for it outweigh those against it; ties leave it unset, so texts without terms get 0.
    Rows of equal keys are taken together. Terms are the lower-cased words between white space.
    """
    terms = texts.select(*keys, F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+")).alias("term"))
    weight, votes = _votes(F.col("term"))
    weighed = terms.select(*keys, F.xxhash64("term").alias("hash"), weight.alias("weight"))
    sums = weighed.groupBy(*keys).agg(F.sum("weight").alias("all"), *[F.sum(v).alias(f"v{i}") for i, v in enumerate(votes)])
    bits = []
    for i in range(BITS // 2):
        for lane, at in ((F.col(f"v{i}").bitwiseAND(F.lit((1 << 32) - 1)), i), (F.shiftrightunsigned(f"v{i}", 32), i + 32)):
            bits.append(F.when(lane * 2 > F.col("all"), F.lit(1 << at if at < 63 else _NO_ID)).otherwise(F.lit(0).cast("long")))
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return sums.select(*keys, value.alias("fingerprint"))


def _block(value: Column, k: int, blocks: int) -> Column:
    low, high = BITS * k // blocks, BITS * (k + 1) // blocks
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _met(fingerprints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs a < b of distinct fingerprints (fingerprint, n) at most `radius` bits apart, with na and nb, each pair once.

    One table for each choice of blocks - radius blocks, keyed by them: two such fingerprints differ in at most radius
    blocks, so they agree on a key. A pair that agrees on several keys is taken from the first of their tables.
    """
    tables = list(combinations(range(blocks), blocks - radius))
    keyed = fingerprints.select(
        "fingerprint", "n",
        F.explode(F.array(*[F.struct(F.lit(t).alias("place"), F.xxhash64(F.lit(t), *[_block(F.col("fingerprint"), k, blocks) for k in chosen]).alias("key")) for t, chosen in enumerate(tables)])).alias("t"),
    ).select("fingerprint", "n", "t.*")
    one, two = (keyed.select("place", "key", F.col("fingerprint").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(tables))
    for t in range(len(tables) - 1, -1, -1):
        same = F.lit(True)
        for k in tables[t]:
            same = same & (_block(apart, k, blocks) == 0)
        first = F.when(same, F.lit(t)).otherwise(first)
    return one.join(two, ["place", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & (F.col("place") == first))


def near(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance) of all pairs of distinct fingerprints a < b (column `fingerprint`) at most `radius` bits apart."""
    pairs = _met(fingerprints.select("fingerprint").distinct().withColumn("n", F.lit(1)), radius, blocks)
    return pairs.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def near_counts(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, others): for distinct fingerprints (fingerprint, n), the sum of n over those within the radius, itself
    left out. Pairs are counted for both sides in the task that finds them; none is written."""
    sides = F.array(F.struct(F.col("a").alias("fingerprint"), F.col("nb").alias("m")), F.struct(F.col("b").alias("fingerprint"), F.col("na").alias("m")))
    return _met(fingerprints, radius, blocks).select(F.explode(sides).alias("s")).select("s.*").groupBy("fingerprint").agg(F.sum("m").alias("others"))


def following(docs: DataFrame) -> DataFrame:
    """(id, content, next_id, next_content) of distinct (id, content): the next one in ascending order, the first after the last.

    Ranges of ids are ordered each on its own; only the first row of each range is looked at across ranges.
    """
    ranged = cut(docs.select("id", "content").distinct().repartitionByRange("id", "content").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("id", "content")
    row = F.struct("id", "content")
    heads = ranged.groupBy("part").agg(F.min(row).alias("head"))  # as many rows as there are ranges
    over = Window.orderBy("part")
    ends = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    return ranged.withColumn("next", F.lead(row).over(here)).join(ends, "part").select("id", "content", F.coalesce("next", "after").alias("n")).select("id", "content", F.col("n.id").alias("next_id"), F.col("n.content").alias("next_content"))


def _likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    The edited text has its last quarter of code points replaced by the start of the next document's text. n_within
    counts the other rows whose fingerprint is within the radius, copies included. Null texts are empty; a null id
    comes before all others; rows of one id follow each other by a hash of their texts, and equal rows count as one
    in that order.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("content"), F.coalesce(text_col, F.lit("")).alias("text"))
    light = cut(texts.select("id", "content", F.length("text").cast("long").alias("n_chars")))
    order = cut(following(light))
    quarter = light.select("id", "content", F.floor(F.col("n_chars") / 4).cast("int").alias("quarter")).distinct()
    asked = order.join(quarter, ["id", "content"]).select(F.col("id").alias("of_id"), F.col("content").alias("of_content"), "quarter", F.col("next_id").alias("id"), F.col("next_content").alias("content"))
    starts = texts.join(asked, ["id", "content"]).select(F.col("of_id").alias("id"), F.col("of_content").alias("content"), F.substring("text", F.lit(1), F.col("quarter")).alias("start"))
    starts = starts.groupBy("id", "content").agg(F.first("start").alias("start"))
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    both = texts.join(starts, ["id", "content"]).select("id", "content", "text", F.concat(F.substring("text", F.lit(1), kept), "start").alias("edited"))
    digests = both.select("id", "content", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    versions = both.select("id", "content", F.explode(F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("t")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("t")))).alias("v")).select("id", "content", "v.*")
    prints = simhash(versions, ["id", "content", "changed"], "t")
    made = prints.groupBy("id", "content").agg(F.max(F.when(~F.col("changed"), F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("changed"), F.col("fingerprint"))).alias("edited_fingerprint"))
    # digests and fingerprints in one job, so that the texts are dealt out once
    made = cut(made.join(digests.dropDuplicates(["id", "content"]), ["id", "content"]))
    rows = light.join(made, ["id", "content"])
    held = cut(rows.groupBy("fingerprint").agg(F.count("*").alias("n")))
    counted = held.join(near_counts(held), "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_within"))
    # copies share their fingerprint, so its rows are dealt out over SALTS tasks
    counted = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "content"), F.lit(SALTS)).cast("int"))
    after = order.join(made.select(F.col("id").alias("next_id"), F.col("content").alias("next_content"), F.col("fingerprint").alias("after")), ["next_id", "next_content"]).select("id", "content", "after")
    out = rows.join(after, ["id", "content"]).join(counted, ["fingerprint", "salt"])
    shown = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", shown("fingerprint").alias("fingerprint"), shown("edited_fingerprint").alias("edited_fingerprint"),
        _likeness("fingerprint", "edited_fingerprint").alias("near_edited"), _likeness("fingerprint", "after").alias("near_next"), "n_within",
    )
