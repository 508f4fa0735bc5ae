"""Spelling variant grouping: words that differ by one edit from a far more frequent word, and the form they lead to.

Words are counted over all texts. Every word of the vocabulary emits its whole neighbourhood: all distinct strings that one
deletion, replacement or insertion of a letter of the observed alphabet makes of it. Those that are words themselves are
its near words, found by a join on equal strings, so that no distance is ever worked out. Before the join a filter of
fixed size takes out most strings that are no word; it lets some of them through and never holds a word back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.store import cut, set_bits

#: Shortest word in code points, and occurrences that a word needs at least.
CHARS, LEAST = 6, 5
#: So many times as frequent is a form at least.
RATIO = 5
#: Letters of words: those of two alphabets' worth of code points, so that a neighbourhood stays bounded.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on; words of the vocabulary that a task takes; rows worked on at once.
HELD, SHARE, STEP = 200_000, 20_000, 2_048
#: Bits of the filter.
FILTER_BITS = 1 << 27
_BASE, _LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def run_counts(name: str, text: str, noise: int | None) -> Counter:
    """Words of a text, lower-cased, with their numbers; where noise is given, one letter goes from each run whose checksum
    with the document's name it divides."""
    runs = Counter(LETTERS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes: A-Z only
    if not noise:
        return runs
    out, base = Counter(), crc32(f"{name}:".encode())
    for run, n in runs.items():
        h = crc32(run.encode(), base)
        if h % noise == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, chars: int = CHARS, least: int = LEAST, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least `chars` code points that occur at least `least` times over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in run_counts(name or "", text.as_py() or "", noise).items():
                    if len(word) >= chars:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _codes(words: np.ndarray) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return words.astype(f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def _letters(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * _LETTER


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)


def _places(sums: np.ndarray, bits: int) -> np.ndarray:
    """Places in a filter of strings whose letters, weighted by powers, come to these sums."""
    h = sums ^ (sums >> np.uint64(31))
    return ((h * _LETTER) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def places(words: list[str], bits: int = FILTER_BITS) -> np.ndarray:
    """Place of each word in a filter of so many bits, a power of two."""
    out, laid = np.zeros(len(words), np.int64), np.array(words, object)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        out[at] = _places((_letters(_codes(laid[at])) * _powers(size)[:size]).sum(axis=1, dtype=np.uint64), bits)
    return out


def neighbourhood(words: np.ndarray, alphabet: np.ndarray, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, strings): the distinct strings that one edit makes of words of one length, kind by kind and place by place;
    with a filter, those that it lets through.

    Of a run of equal letters only the first is deleted, and nothing is inserted behind a letter equal to it: each string
    comes once.
    """
    codes, size = _codes(words), len(words[0])
    weights, width = _powers(size + 1), len(bits) * 8 if bits is not None else 0
    own = _letters(codes)
    left = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(own * weights[:size], axis=1, dtype=np.uint64)], axis=1)
    whole = left[:, -1]
    lower = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(own[:, 1:] * weights[: size - 1], axis=1, dtype=np.uint64)], axis=1)
    higher = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(own * weights[1 : size + 1], axis=1, dtype=np.uint64)], axis=1)
    marks = _letters(alphabet)

    def known(sums: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.ones(sums.shape, np.bool_)
        at = _places(sums, width)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.bool_)

    for k in range(size):  # deletions
        fresh = np.ones(len(words), np.bool_) if k == 0 else codes[:, k] != codes[:, k - 1]
        rows = np.flatnonzero(fresh & known(left[:, k] + lower[:, -1] - lower[:, k]))
        yield rows, [w[:k] + w[k + 1 :] for w in words[rows].tolist()]
    for k in range(size):  # replacements
        sums = (whole - own[:, k] * weights[k])[:, None] + marks * weights[k]
        rows, letters = np.nonzero((codes[:, k, None] != alphabet) & known(sums))
        yield rows, [w[:k] + chr(c) + w[k + 1 :] for w, c in zip(words[rows].tolist(), alphabet[letters].tolist())]
    for k in range(size + 1):  # insertions
        sums = (left[:, k] + higher[:, -1] - higher[:, k])[:, None] + marks * weights[k]
        fresh = np.ones((len(words), len(alphabet)), np.bool_) if k == 0 else codes[:, k - 1, None] != alphabet
        rows, letters = np.nonzero(fresh & known(sums))
        yield rows, [w[:k] + chr(c) + w[k:] for w, c in zip(words[rows].tolist(), alphabet[letters].tolist())]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): the words of a vocabulary (word, n) that differ by exactly one edit, both ways round."""
    spark = words.sparkSession
    letters = [r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r["c"]]  # as many as LETTERS has at most
    alphabet = np.array(sorted(map(ord, letters)), np.uint32)
    count = words.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // SHARE))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch.column(0).to_pylist()))], ["place"])

    shared = spark.sparkContext.broadcast(set_bits(words.select("word").mapInArrow(placed, "place long"), "place", FILTER_BITS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            laid = np.array(batch.column(0).to_pylist(), object)
            sizes = np.array([len(w) for w in laid])
            for size in np.unique(sizes):
                of_size = np.flatnonzero(sizes == size)
                for at in (of_size[k : k + STEP] for k in range(0, len(of_size), STEP)):
                    for rows, strings in neighbourhood(laid[at], alphabet, shared.value):
                        yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), batch.column(0).take(pa.array(at[rows])), batch.column(1).take(pa.array(at[rows]))], ["near", "word", "n"])

    dealt = words.select("word", "n").repartition(tasks, "word").mapInArrow(emit, "near string, word string, n long")
    return dealt.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last form that a word leads to. Forms must not lead in a circle.

    Each round joins every link with that of its end, so that the way ahead halves; rounds are written.
    """
    ends = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = cut(ends.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        ends = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return ends


def variants(
    docs: DataFrame, chars: int = CHARS, least: int = LEAST, ratio: int = RATIO, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    form is the near word of largest n, the smallest in code-point order among equals, if it is `ratio` times as frequent
    as the word, else null; root the last of the forms that follow from there, or the word itself. A form is more frequent
    than its word, so forms never lead in a circle. Null texts hold no words; a null id is named by an empty text (it only
    matters for noise). Rows of one id count as often as they come; other columns are left out. An empty table has no words.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = cut(vocabulary(docs, chars, least, noise, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rated = cut(
        words.join(found, "word", "left")
        .withColumn("fits", F.coalesce(-F.col("best.k") >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.k")).alias("form_n"))
    )
    ends = roots(rated.filter("form is not null"))
    return rated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
