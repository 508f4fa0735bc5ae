"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm import grams
from lectern.llm.links import link
from lectern.llm.store import cut

U = np.uint64
#: Coordinates of a sketch, and those of a band. At a similarity of 0.85 all 16 bands miss once in 100,000 pairs.
COORDINATES, BAND = 64, 4
#: Bits of the odd sketch that spares pairs which can't be similar enough.
PARITIES = 512
#: Words of a shingle and least similarity in percent, where a caller gives none.
WORDS, PERCENT = 5, 80


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes; t is a power of two.

    Round by round every item is thrown into one of t bins with a value that grows with the round; a bin keeps its
    smallest value. After t rounds, round t + k throws all items into bin k, so every bin is filled after 2t rounds.
    It stops as soon as all bins are full, which for sets beyond t log t is after the first round or two.
    """
    shift = U(64 - t.bit_length() + 1)
    bins = np.arange(t, dtype=np.uint64) << shift
    out, empty = np.zeros(t, np.uint64), np.ones(t, np.bool_)
    for i in range(2 * t):
        thrown = grams.mix(items + U((i * 0xD6E8FEB86659FD93) & (2**64 - 1)))
        if i < t:
            thrown.sort()
            at = np.minimum(np.searchsorted(thrown, bins), len(thrown) - 1)
            least = thrown[at]
            fill = empty & (least >= bins) & (least >> shift == bins >> shift)
        else:
            fill = np.zeros(t, np.bool_)
            fill[i - t] = empty[i - t]
            least = np.full(t, thrown.min(), np.uint64)
        out[fill] = least[fill] + U(i)
        empty &= ~fill
        if not empty.any():
            break
    return out


def band_keys(sketched: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for each band of a sketch; bands of different places never share a key but by chance."""
    rows = sketched.reshape(-1, band)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(band):
        key = grams.mix(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _signature(items: np.ndarray) -> tuple[int, int]:
    if not len(items):
        return 0, 0
    return int(items.sum().view(np.int64)), int(grams.mix(items ^ U(0x5851F42D4C957F2D)).sum().view(np.int64))


def parities(items: np.ndarray) -> np.ndarray:
    """Odd sketch: for each of PARITIES classes of items, whether the set has an odd number of them."""
    odd = np.bincount((items >> U(13)).astype(np.int64) & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, content, n, s1, s2, bands, odd) of each row: set size, two sums that identify the set, band keys, odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys, odd = [], [], [], [], []
            for items in grams.shingle_sets(batch.column(2).to_pylist(), words):
                n.append(len(items))
                for out, x in zip((s1, s2), _signature(items)):
                    out.append(x)
                keys.append(band_keys(sketch(items)) if len(items) else np.empty(0, np.uint64))
                odd.append(parities(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), grams.list_array(keys, pa.int64()), grams.list_array(odd, pa.int64())],
                ["id", "content", "n", "s1", "s2", "bands", "odd"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, content long, n long, s1 long, s2 long, bands array<long>, odd array<long>")


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, items): the whole shingle set of each row, with the number of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(grams.shingle_sets(batch.column(0).to_pylist(), words))
            signs = [_signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), grams.list_array(sets, pa.int64())], ["n", "s1", "s2", "items"]
            )

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "n long, s1 long, s2 long, items array<long>").select(F.xxhash64("n", "s1", "s2").alias("cls"), "items")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, content, n_shingles, component_id, kept).

    Rows whose sets are equal form a class; classes whose sketches share a band are held against each other on their
    full sets, and linked at |A and B| * 100 >= percent * |A or B|. component_id is the smallest id that links lead to,
    the own id where there is none; kept marks it. `content` is a hash of the text, to tell rows of one id apart.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows without an id have component null
    and are kept. Repeated rows of an id with equal texts get equal results.
    """
    rows = cut(sketches(docs, words, id_col, text_col)).withColumn("cls", F.xxhash64("n", "s1", "s2"))
    real = rows.filter("n > 0 and id is not null")
    classes = cut(real.groupBy("cls").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    buckets = cut(classes.select(F.col("cls").alias("id"), F.explode("bands").alias("key")))
    shared = buckets.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = cut(buckets.join(shared, "key"))
    wanted = buckets.select("id").distinct().join(classes.select(F.col("cls").alias("id"), "low", "n"), "id")
    chosen = docs.select(F.col(id_col).alias("low"), F.col(text_col).alias("t")).join(wanted.select("low").distinct(), "low", "left_semi")
    sets = cut(_sets(chosen, words, "low", "t").join(wanted.select(F.col("id").alias("cls")), "cls", "left_semi").dropDuplicates(["cls"]))
    sized = sets.withColumn("n", F.size("items"))

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (sized.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("items").alias(f"i{c}")) for c in "ab")
        sizes = one.select("a", "na"), two.select("b", "nb")
        near = pairs.join(sizes[0], "a").join(sizes[1], "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        both = F.size(F.array_intersect("ia", "ib"))
        return near.join(one, "a").join(two, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")

    def bound(ids: DataFrame) -> tuple[DataFrame, object]:
        """Each item that only one of two sets has flips one parity, so the sets differ by as many items as parities at least."""
        held = classes.select(F.col("cls").alias("id"), F.col("n").alias("x"), F.col("odd").alias("y")).join(ids, "id", "left_semi")
        apart = lambda ya, yb: sum((F.bit_count(ya[k].bitwiseXOR(yb[k])) for k in range(PARITIES // 64)), F.lit(0))
        return held, lambda xa, ya, xb, yb: (100 + percent) * apart(ya, yb) <= (100 - percent) * (xa + xb)

    found = link(buckets.select("key", "id"), verify, bound)
    lows = found.join(classes.select(F.col("cls").alias("id"), "low"), "id")
    lead = lows.groupBy("component").agg(F.min("low").alias("lead"))
    placed = classes.select("cls", "low").join(lows.join(lead, "component").select(F.col("id").alias("cls"), "lead"), "cls", "left").select("cls", F.coalesce("lead", "low").alias("lead"))
    component = F.when(F.col("n") > 0, F.coalesce("lead", "id")).otherwise(F.col("id"))
    return rows.join(placed, "cls", "left").select(
        F.col("id").alias("doc_id"), "content", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, with all its columns; its repeated rows go as well."""
    keys = near_duplicates(docs, words, percent).filter("kept").select(F.col("doc_id").alias("id"), F.col("content").alias("kept_content")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = (F.regexp_replace(text, "[ \t-\r]", "") == "") | F.col("doc_id").isNull()
    mine = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("content"), blank.alias("blank"))
    kept = mine.join(keys, mine["doc_id"].eqNullSafe(keys["id"]) & (mine["content"] == keys["kept_content"]), "left_semi")
    # repeated rows of an id: the first stays, but blank ones and those without an id are nobody's copies
    once = Window.partitionBy("doc_id", "content").orderBy(F.lit(0))
    return kept.withColumn("k", F.when(~F.col("blank"), F.row_number().over(once)).otherwise(1)).filter("k = 1").select("row.*")
