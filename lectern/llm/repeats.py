"""Removal of passages that occur elsewhere, byte for byte, by a threshold-bounded suffix structure.

Every string of LENGTH bytes is a window. A window belongs to the smallest hash among its K-byte strings, its anchor,
so equal windows share their anchor. Neighbouring windows of one anchor form a segment. Where all segments of an anchor
have the same bytes, all their windows repeat; anchors of one segment have none that does. Only where segments of an
anchor differ are their bytes gathered: a Burrows-Wheeler transform over them is walked by backward extension, breadth
first, which yields the lengths of common prefixes in rising order and stops at LENGTH. What is left unset then starts
with the same LENGTH bytes as its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import grams
from lectern.llm.store import cut

LENGTH = 200
#: Bytes of an anchor. Shorter ones make fewer segments, longer ones fewer segments that share an anchor in vain.
K = 50
#: Bytes of the segments that one transform takes, and of an anchor's segments beyond which its windows are counted instead.
BATCH, LARGE = 1 << 20, 1 << 20
#: Tasks that the segments of one anchor are dealt out over where they are joined with it.
SALTS = 8
_NO_ID = -(1 << 63)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while done < w:
        step = min(done, w - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, first, last, anchor, digest) of all segments: starts of their first and last windows, digest of their bytes.

    Digests are compared only between segments of one anchor, which share K bytes or their hash.
    """
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    h = grams.Rolling(data).windows(k)
    least = _sliding_min(h, length - k + 1)[:n]
    inside = np.zeros(n, np.bool_)
    for a, b in zip(offsets, offsets[1:]):
        inside[a : max(a, b - length + 1)] = True
    new = inside.copy()
    # the next window has another anchor, or the same value at another place as the first one has dropped out
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    held, digest = memoryview(data.tobytes()), hashlib.blake2b
    digests = b"".join([digest(held[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (ends + length).tolist())])
    return np.searchsorted(offsets, first, side="right") - 1, first, ends, least[first], np.frombuffer(digests, np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes by their first `depth` symbols (below 512) at least, by doubling the sorted prefix.

    Only suffixes whose place is still shared are sorted again.
    """
    n = len(text)
    packed = np.zeros(n, np.uint64)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    for k in range(7):
        packed = (packed << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(packed, kind="stable")
    changed = np.concatenate([[True], packed[order][1:] != packed[order][:-1]])
    rank = np.zeros(n + 1, np.int64)  # the place of the first suffix of equal prefix, from 1; 0 is beyond the end
    rank[order] = np.maximum.accumulate(np.where(changed, np.arange(n), 0)) + 1
    done = 7
    while done < depth:
        alone = changed & np.concatenate([changed[1:], [True]])
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        at = order[places]
        key = rank[at] * (n + 2) + rank[np.minimum(at + done, n)]
        sub = np.argsort(key, kind="stable")
        at, key = at[sub], key[sub]
        order[places] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        changed[places] = fresh
        rank[at] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))] + 1
        done *= 2
    return order


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Marks the starts in `text` (symbols from 1, 0 parts strings and ends the text) whose next `length` symbols start elsewhere too.

    Breadth-first backward extension: from the interval of each string that has been reached, each symbol before it
    leads to the interval of a string one longer. The right end of a new interval gets its common prefix with what
    follows, which is the length so far; ends that are set already are not followed again. After `length` rounds the
    ends still unset have common prefixes of that length or more. Strings are never extended across a parting symbol.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the text ends with 0, which stands before its first symbol
    inverse = np.argsort(before, kind="stable")
    forth = np.empty(n, np.int64)  # where each symbol of the transform leads to
    forth[inverse] = np.arange(n)
    keys = before[inverse].astype(np.int64) * (n + 1) + inverse
    later = np.full(n, n, np.int64)  # the next place of the same symbol
    same = before[inverse][1:] == before[inverse][:-1]
    later[inverse[:-1][same]] = inverse[1:][same]
    unset = np.ones(n + 1, np.bool_)
    unset[0] = unset[n] = False
    # strings of one symbol; those of the parting symbol may only stand last
    counts = np.bincount(before, minlength=1)
    high = np.cumsum(counts)
    low = high - counts
    low, high = low[counts > 0], high[counts > 0]
    unset[high] = False
    for _ in range(1, length):
        if not len(low):
            break
        sizes = high - low
        total = np.cumsum(sizes)
        at = np.arange(total[-1]) + np.repeat(low - (total - sizes), sizes)
        last = later[at] >= np.repeat(high, sizes)
        last &= before[at] != 0
        at = at[last]
        origin = np.searchsorted(total, np.flatnonzero(last), side="right")
        ends = forth[at] + 1
        fresh = unset[ends]
        at, ends, origin = at[fresh], ends[fresh], origin[fresh]
        unset[ends] = False
        low, high = np.searchsorted(keys, before[at].astype(np.int64) * (n + 1) + low[origin]), ends
    lead = unset[:n]  # shares `length` symbols with the suffix before it in order
    twin = lead | unset[1:]
    out = np.zeros(n, np.bool_)
    out[order[twin]] = True
    room = np.flatnonzero(text == 0)[np.cumsum(np.concatenate([[0], (text == 0)[:-1]]))] - np.arange(n)
    return out & (room >= length)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("t"))


def _all_segments(named: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for data, offsets in grams.pieces([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]):
                text, first, last, anchor, c = segments(data, offsets, length, k)
                if len(text):
                    at = pa.array(text + done)
                    start = offsets[text]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(c), pa.array((first - start).astype(np.int32)), pa.array((last - start).astype(np.int32))],
                        ["id", "content", "a", "c", "s", "e"],
                    )
                done += len(offsets) - 1

    return named.mapInArrow(run, "id long, content long, a long, c long, s int, e int")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _by_transform(parts: DataFrame, length: int) -> DataFrame:
    """(id, content, s, e): first and last repeated windows in single segments, from (a, n, id, content, s, bytes) sorted by a."""
    names = ["id", "content", "s", "e"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text = np.concatenate([np.concatenate([np.frombuffer(r[5], np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)]) for r in rows])
        found = repeated_starts(text, length)
        out: list[list[int]] = [[], [], [], []]
        at = 0
        for _, n, i, content, s, part in rows:
            if n == 1:
                for a, b in zip(*_runs(found[at : at + len(part)])):
                    for column, x in zip(out, (i, content, s + int(a), s + int(b) - 1)):
                        column.append(x)
            at += len(part) + 1
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return parts.mapInArrow(run, "id long, content long, s int, e int")


def _by_count(parts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: their windows are counted by two hashes, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, i, content, s, part in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(part, np.uint8)
                one, two = grams.Rolling(data).windows(length), grams.Rolling(data[::-1]).windows(length)[::-1]
                m = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(np.ascontiguousarray(two).view(np.int64)), pa.array(np.full(m, n)), pa.array(np.full(m, i)), pa.array(np.full(m, content)), pa.array((s + np.arange(m)).astype(np.int32))],
                    ["w", "v", "n", "id", "content", "s"],
                )

    windows = parts.mapInArrow(run, "w long, v long, n long, id long, content long, s int")
    often = windows.groupBy("w", "v").agg(F.count("*").alias("times")).filter("times > 1").select("w", "v")
    return windows.filter("n = 1").join(often, ["w", "v"], "left_semi").select("id", "content", "s", F.col("s").alias("e"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, s, e): ranges of window starts, in bytes, whose windows start elsewhere too; ranges may touch or overlap."""
    named = _named(docs, id_col, text_col)
    found = cut(_all_segments(named, length, k).withColumn("salt", F.pmod(F.xxhash64("id", "content", "s"), F.lit(SALTS)).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    heads = found.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).filter("n > 1").select("a", (F.col("x") != F.col("y")).alias("mixed"), every)
    shared = cut(found.join(heads, ["a", "salt"]))
    whole = shared.filter("not mixed").select("id", "content", "s", "e")
    mixed = shared.filter("mixed")
    kinds = cut(mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "content", "s", "e")).alias("at")).select("a", "c", "n", "at.*"))
    twice = kinds.filter("n > 1").select("a", "c", every)
    whole = whole.union(mixed.join(twice, ["a", "c", "salt"], "left_semi").select("id", "content", "s", "e"))
    asked = kinds.groupBy("id", "content").agg(F.collect_list(F.struct("a", "n", "s", "e")).alias("asked"))
    texts = named.join(asked, ["id", "content"])
    bytes_of = F.col("t").cast("binary")
    parts = texts.select("id", "content", bytes_of.alias("t"), F.explode("asked").alias("p"))
    parts = cut(parts.select("p.a", "p.n", "id", "content", "p.s", F.substring("t", F.col("p.s") + 1, F.col("p.e") - F.col("p.s") + length).alias("part")).dropDuplicates(["a", "id", "content", "s"]))
    large = parts.groupBy("a").agg(F.sum(F.length("part")).alias("size")).filter(F.col("size") > LARGE).select("a")
    large = cut(large)
    few = parts.join(large, "a", "left_anti").repartition("a").sortWithinPartitions("a")
    many = parts.join(large, "a", "left_semi").select(*parts.columns)
    return whole.union(_by_transform(few.select(*parts.columns), length)).union(_by_count(many, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of its whole text as UTF-8.

    Each byte under a string of `length` bytes that also starts elsewhere, in this text or another, is removed; kept
    holds the remaining bytes. A null text is empty. Repeated rows are texts of their own, so that they repeat each other.
    """
    ranges = repeated_windows(docs, length, id_col=id_col, text_col=text_col)
    spans = ranges.groupBy("id", "content").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                steps = np.zeros(len(data) + 1, np.int32)
                for x in found or ():
                    steps[x["s"]] += 1
                    steps[x["e"] + length] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                kept = data[~gone].tobytes()
                for column, x in zip(out, (len(data), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    joined = _named(docs, id_col, text_col).join(spans, ["id", "content"], "left")
    shown = joined.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"), "t", "spans")
    return shown.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
