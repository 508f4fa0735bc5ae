"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a group.

A line is normalised to its words, A-Z lower-cased. Lines of equal words form a class. Two kinds of pigeonhole blocks
make candidates. Blocks of bits: classes whose 64-bit SimHashes differ in at most RADIUS bits. Those are few of the lines
that are alike enough, as a fifth of all words changed turns 13 of 64 bits in the mean. Blocks of words: edits of words
leave some runs of words untouched, so that two lines near each other share one of the first runs in a common order. Of
lines of up to 24 words as many runs are taken as this needs whatever the edits are, so that those whose near lines are
no longer than that stay out of the blocks of bits; of longer ones KEYS, of which made
pairs with a fifth of their words edited at random share one in more than nineteen cases of twenty. Of the pairs that meet
so, those whose SimHashes differ in at most FAR bits are candidates. Candidates are linked if the edit similarity of their word sequences (1 - edit distance in words / words of the longer line) is high enough. Of each
connected group the first occurrence stays. Lines of fewer than four words have exact copies only, those of four also lines of five: one edit is a fifth of five words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm import grams
from lectern.llm.links import PART, components
from lectern.llm.store import cut, long_batches

SIMILARITY = 0.8
#: Radius of the candidates by blocks of bits, and of those by blocks of words.
RADIUS, FAR = 3, 22
#: Words of a run: (words, shortest line, longest line). Where kinds overlap, lines of both lengths may be near each other.
RUNS = ((2, 4, 24), (3, 20, None))
#: Runs of the last kind that a line is found by. First come runs without short words, which are seldom those of unlike lines; words count as long from LONG bytes on.
KEYS, LONG = 10, 6
#: Longs of the odd sketch of a line.
ODD = 4
#: Ids of a block beyond which it is dealt out by parts; of a bucket up to which its pairs are looked at; rows gathered in a task.
FULL_BLOCK, SMALL_BUCKET, GATHER = 1 << 18, 32, 1 << 17
#: Bits of the filter that keeps most lines out of the second pass; of fixed size, and only ever lets too many pass.
FILTER_BITS = 1 << 26
_NO_ID = -(1 << 63)


def _line_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line, word hashes, ends, word lengths) of the non-blank lines of the texts, piece by piece; row counts from the first text."""
    done = 0
    for data, offsets in grams.pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        breaks = np.flatnonzero(data == 10) + 1
        bounds = np.unique(np.concatenate([offsets, breaks]))
        bounds = bounds if len(bounds) > 1 else np.array([0, 0])
        hashes, ends, sizes = grams.sized_words(data, bounds)
        row = np.searchsorted(offsets, bounds[:-1], side="right") - 1
        first = np.searchsorted(bounds, offsets[row])
        line = np.arange(len(bounds) - 1) - first
        counts = np.diff(np.concatenate([[0], ends]))
        solid = counts > 0
        yield row[solid] + done, line[solid], hashes, ends[solid], sizes
        done += len(offsets) - 1


def _line_hashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each sequence of words, by sums of words weighted with powers of their place."""
    starts = np.concatenate([[0], ends[:-1]])
    place = (np.arange(len(hashes)) - np.repeat(starts, np.diff(np.concatenate([[0], ends])))).astype(np.uint64)
    return grams.mix(np.add.reduceat(grams.mix(hashes + place * np.uint64(0xD6E8FEB86659FD93)), starts) + (ends - starts).astype(np.uint64))


def _simhashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Majority of each bit over the distinct words of each line, so that a word that fills a line doesn't decide alone."""
    at = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(np.concatenate([[0], ends])))
    keys = np.sort((at << np.uint64(40)) | (hashes >> np.uint64(24)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    stops = np.searchsorted(keys, np.arange(1, len(ends) + 1, dtype=np.uint64) << np.uint64(40))
    starts = np.concatenate([[0], stops[:-1]])
    voters, counts = grams.mix(keys & np.uint64((1 << 40) - 1)), stops - starts
    # bit 8 j + k of the voters is summed in byte j of plane k, which holds 255 voters; longer lines are counted bit by bit
    planes = [np.add.reduceat((voters >> np.uint64(k)) & np.uint64(0x0101010101010101), starts) for k in range(8)]
    sums = np.stack(planes, axis=1).view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).astype(np.int64)
    for line in np.flatnonzero(counts > 255):
        bits = np.unpackbits(voters[starts[line] : stops[line]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[line] = bits.sum(axis=0, dtype=np.int64).reshape(8, 8)
    return np.packbits((2 * sums > counts[:, None, None]).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def _odd(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Odd sketch of each line's words, ODD words of 64 bits: one edit of a word flips two bits at most."""
    starts = np.concatenate([[0], ends[:-1]])
    one = np.uint64(1) << ((hashes >> np.uint64(7)) & np.uint64(63))
    place = (hashes >> np.uint64(13)) & np.uint64(ODD - 1)
    return np.stack([np.bitwise_xor.reduceat(np.where(place == k, one, np.uint64(0)), starts) for k in range(ODD)], axis=1)


def runs_needed(n: np.ndarray, words: int, similarity: float = SIMILARITY) -> np.ndarray:
    """So many of its first runs in a common order must a line of n words be found by to share one with every line near it.

    An edit changes as many runs as a run has words, an inserted word one less: of two lines with k edits between them, d
    of them insertions, all but words * k - d runs of the shorter are in the longer.
    """
    longer = np.arange(0, 2 + int(1 / max(1 - similarity, 0.01)))
    edits_ = np.floor((n[:, None] + longer) * (1 - similarity) + 1e-9)
    return (words * edits_ - longer).max(axis=1).astype(np.int64) + 1


def found_by_runs(similarity: float = SIMILARITY) -> tuple[int, int]:
    """(least, most) words of the lines whose runs of the first kind bring them together with every line near them, so that
    blocks of bits can add nothing: neither such a line nor one near it is too long, and some run outlasts the edits."""
    words, low, high = RUNS[0]
    n = np.arange(low, int(high * similarity + 1e-9) + 1)
    lacks = np.flatnonzero(runs_needed(n, words, similarity) > n - words + 1)
    return low, int(n[lacks[0]] if len(lacks) else n[-1] + 1) - 1 if len(n) else low - 1


def run_keys(hashes: np.ndarray, ends: np.ndarray, sizes: np.ndarray, kinds: tuple = RUNS, most: int = KEYS, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): for each line, the first of its runs of words of each kind, those of longer shortest words first, then by
    hash: as many as needed of a kind for lines up to a length, `most` of one for all lengths."""
    short = np.uint64(LONG) - np.minimum(sizes, LONG).astype(np.uint64)
    counts = np.diff(np.concatenate([[0], ends]))
    at = np.repeat(np.arange(len(ends), dtype=np.uint64), counts)
    found = []
    for words, low, high in kinds:
        m = len(hashes) - words + 1
        if m < 1:
            continue
        fits = counts >= low if high is None else (counts >= low) & (counts <= high)
        start = np.flatnonzero((at[:m] == at[words - 1 :]) & fits[at[:m].astype(np.int64)])
        h, rank = np.full(len(start), words, np.uint64), np.zeros(len(start), np.uint64)
        for k in range(words):
            h = grams.mix(h + hashes[start + k])
            rank = np.maximum(rank, short[start + k])
        laid = np.sort((at[start] << np.uint64(40)) | (rank << np.uint64(37)) | (h >> np.uint64(27)))
        laid = laid[np.concatenate([[True], laid[1:] != laid[:-1]])] if len(laid) else laid
        line = laid >> np.uint64(40)
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
        begin = np.repeat(edge, np.diff(np.concatenate([edge, [len(line)]])))
        limit = most if high is None else runs_needed(counts[line.astype(np.int64)], words, similarity)
        laid = laid[np.arange(len(laid)) - begin < limit]
        found.append((laid >> np.uint64(40), grams.mix((laid & np.uint64((1 << 40) - 1)) + (np.uint64(words) << np.uint64(56)))))
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    line, keys = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(line, kind="stable")
    return keys[order], np.cumsum(np.bincount(line.astype(np.int64), minlength=len(ends)))


def differing(a: list, b: list) -> tuple[list, list]:
    """The two without what they begin and end with alike."""
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    high = 0
    while high < least - low and a[-1 - high] == b[-1 - high]:
        high += 1
    return a[low : len(a) - high], b[low : len(b) - high]


def edits(a: list, b: list, most: int) -> int:
    """Edit distance of two word sequences, or something above `most` if it is above; all places of a column at once, as bits."""
    a, b = differing(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) - len(a) > most:
        return len(b)
    places: dict = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, word in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(word, 0)
        level = ((same & up) + up ^ up) | same
        rise, fall = down | ~(level | up) & full, up & level
        score += 1 if rise & last else -1 if fall & last else 0
        if score - left > most:
            return score - left
        rise, fall = rise << 1 | 1, fall << 1
        steep = same | down
        up, down = (fall | ~(steep | rise)) & full, rise & steep & full
    return score


def common(a: list, b: list) -> int:
    """Words of the longest sequence that is in both, in order."""
    places: dict = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    full = open_ = (1 << len(a)) - 1
    for word in b:
        same = places.get(word)
        if same:
            same &= open_
            open_ = (open_ + same) | (open_ - same)
    return len(a) - (open_ & full).bit_count()


def near_in_words(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two lines (words joined by spaces) are alike enough.

    The distance is worked out where bounds leave it open: words that only one line has are edits, one each at least, and
    words that differ place by place are as many edits at most. Words outside the longest common sequence are edits, too:
    those of the longer line at least, those of both at most.
    """
    x, y = a.split(b" "), b.split(b" ")
    return _near(x, y, int(max(len(x), len(y)) * (1 - similarity) + 1e-9))


def _near(x: list[bytes], y: list[bytes], most: int) -> bool:
    if abs(len(x) - len(y)) > most:
        return False
    if len(x) == len(y) and sum(map(ne, x, y)) <= most:
        return True
    p, q = set(x), set(y)
    both = len(p & q)
    if len(p) - both > most or len(q) - both > most:
        return False
    x, y = differing(x, y)
    both = common(x, y)
    if max(len(x), len(y)) - both > most:
        return False
    if len(x) + len(y) - 2 * both <= most:
        return True
    return edits(x, y, most) <= most


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("t"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id, content, line, h, sim, n, runs) of every non-blank line: hashes of the text it stands in and of its words,
    SimHash, number of words, keys of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, line, hashes, ends, sizes in _line_words(batch.column(2).to_pylist()):
                if len(row):
                    at = pa.array(row)
                    keys, stops = run_keys(hashes, ends, sizes, similarity=similarity)
                    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(keys.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(_line_hashes(hashes, ends).view(np.int64)), pa.array(_simhashes(hashes, ends).view(np.int64)),
                         pa.array(np.diff(np.concatenate([[0], ends])).astype(np.int32)), runs],
                        ["id", "content", "line", "h", "sim", "n", "runs"],
                    )

    return _named(docs, id_col, text_col).mapInArrow(run, "id long, content long, line int, h long, sim long, n int, runs array<long>")


def _spellings(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """`wanted` with columns s, words, lower-cased and joined by spaces, of the line whose hash is its id, and odd0.., its odd sketch."""
    place = F.col("id").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    maps = wanted.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)  # FILTER_BITS bits reach the driver at most, however many lines there are
    for m in maps:
        part = np.frombuffer(bytes(m["bits"]), np.uint8)
        bits[(m["k"] - 1) * len(part) : m["k"] * len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            split: dict[int, list[bytes]] = {}
            for row, line, hashes, ends, _ in _line_words(texts):
                h = _line_hashes(hashes, ends) if len(ends) else np.empty(0, np.uint64)
                at = h & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                out = []
                for k in hit:
                    r = int(row[k])
                    if r not in split:
                        split = {r: texts[r].encode("utf-8", "surrogatepass").split(b"\n")}
                    out.append(b" ".join(split[r][line[k]].translate(low).split()))
                odd = _odd(hashes, ends)[hit].view(np.int64) if len(hit) else np.empty((0, ODD), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(out, pa.binary()), *[pa.array(odd[:, k].copy()) for k in range(ODD)]], ["id", "s", *[f"odd{k}" for k in range(ODD)]])

    lines = docs.select(F.col(text_col).alias("t")).mapInArrow(run, f"id long, s binary, {', '.join(f'odd{k} long' for k in range(ODD))}")
    return lines.join(wanted, "id").dropDuplicates(["id"])


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, stay): the lines of each text that stay, as an ascending list of line numbers from 0.

    Blank lines are in no list, as they are neither repeated nor unique; texts without a line that stays are missing.
    id is the smallest long where the document's is null. Rows of one id with equal texts count as one row.
    """
    lines = line_hashes(docs, id_col, text_col, similarity)
    first = F.min(F.struct("id", "content", "line", "sim", "n", "runs")).alias("at")
    classes = cut(lines.groupBy("h").agg(first).select(F.col("h").alias("id"), F.struct("at.id", "at.content", "at.line").alias("at"), *[f"at.{c}" for c in ("sim", "n", "runs")]))
    low, high = found_by_runs(similarity)
    with long_batches(docs.sparkSession):
        met = cut(near_buckets(classes.filter(~F.col("n").between(low, high)), radius).union(run_buckets(classes, similarity)))
    pairs, crowded = met.filter("key is null").select("a", "b").distinct(), met.filter("key is not null").select("key", F.col("a").alias("id"), "far").distinct()
    wanted = met.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    sims = cut(classes.select("id", "sim", "n").join(wanted, "id"))
    spelled = cut(_spellings(docs, sims, text_col))

    def verify(pairs: DataFrame) -> DataFrame:
        """SimHashes are near, and so are odd sketches: words in only one of two lines flip one parity each, and an edit of a word leaves two such words at most."""
        one, two = (spelled.select(*[F.col(c).alias(f"{c}_{z}") for c in spelled.columns]) for z in "ab")
        apart = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
        most = F.floor(F.greatest("n_a", "n_b") * F.lit(1 - similarity) + 1e-9)
        alike = (apart("sim") <= FAR) & (F.abs(F.col("n_a") - F.col("n_b")) <= most) & (sum((apart(f"odd{k}") for k in range(ODD)), F.lit(0)) <= 2 * most)
        near = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b")).filter(alike)
        return near.select("a", "b", "s_a", "s_b").mapInArrow(near_words, "a long, b long")

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [near_in_words(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    found = components(cut(verify(pairs).union(crowded_links(crowded, spelled, similarity))))
    grouped = classes.join(found, "id", "left").select(F.coalesce("component", "id").alias("group"), "at")
    stay = grouped.groupBy("group").agg(F.min("at").alias("at")).select("at.*")
    return stay.groupBy("id", "content").agg(F.array_sort(F.collect_list("line")).alias("stay"))


_MET = "a long, b long, key long, far int"


def _met(a: np.ndarray, b: np.ndarray | None = None, keys: np.ndarray | None = None, far: int = FAR) -> pa.RecordBatch:
    """Pairs a < b, or members a of large buckets with their keys and the radius within which they may be linked."""
    none = pa.nulls(len(a), pa.int64())
    low, high = (a, None) if b is None else (np.minimum(a, b), np.maximum(a, b))
    return pa.RecordBatch.from_arrays([pa.array(low), none if b is None else pa.array(high), none if keys is None else pa.array(keys), pa.array(np.full(len(a), far, np.int32))], ["a", "b", "key", "far"])


def _pairs(keys: np.ndarray, ids: np.ndarray, near: Callable, far: int) -> Iterator[pa.RecordBatch]:
    """What sorted keys bring together: pairs of small buckets that are near (positions, and how far apart), large buckets whole."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.repeat(np.diff(edge), np.diff(edge))
    large = size > SMALL_BUCKET
    if large.any():
        yield _met(ids[large], keys=keys[large], far=far)
    for d in range(1, min(SMALL_BUCKET, len(keys))):
        one = np.flatnonzero((keys[d:] == keys[:-d]) & ~large[d:])
        if not len(one):
            break
        one = near(one, d)
        yield _met(ids[one], ids[one + d], far=far)


def bucket_links(sims: np.ndarray, odd: np.ndarray, n: np.ndarray, words: Callable[[int], list[bytes]], part: np.ndarray | None, far: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what is alike in a bucket, as pairs of places; with `part`, what is alike in different parts.

    From each line on, links are followed to lines not reached yet, so that of a group of copies few pairs are looked at,
    and each at most once. What may be alike by SimHash, length and odd sketch is worked out for many lines at once.
    """
    size, out = len(n), []
    left, seen = np.ones(size, np.bool_), np.zeros(size, np.bool_)
    may = np.zeros((size, size), np.bool_)  # a bucket holds 2 * PART lines at most
    step = max(1, (1 << 18) // max(size, 1))
    most = np.floor(n * (1 - similarity) + 1e-9).astype(np.int64)

    def look(u: int) -> None:
        some = slice(u - u % step, u - u % step + step)
        fits = np.bitwise_count(sims[some, None] ^ sims) <= far
        fits &= np.abs(n[some, None] - n) <= np.maximum(most[some, None], most)
        if part is not None:
            fits &= part[some, None] != part
        a, b = np.nonzero(fits)
        apart = np.bitwise_count(odd[some][a] ^ odd[b]).sum(axis=1, dtype=np.int64)
        good = apart <= 2 * np.maximum(most[some][a], most[b])
        may[some][a[good], b[good]] = True
        seen[some] = True

    for start in range(size):
        edge = [start] if left[start] else []
        left[start] = False
        while edge:
            u = edge.pop()
            if len(out) + start + 1 >= size and not left.any():
                return out
            if not seen[u]:
                look(u)
            for v in np.flatnonzero(may[u] & left).tolist():
                if _near(words(u), words(v), int(max(most[u], most[v]))):
                    left[v] = False
                    edge.append(v)
                    out.append((u, v))
    return out


def crowded_links(crowded: DataFrame, spelled: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect what is alike in large buckets (key, id, far), from sketches and words (id, sim, n, odd0.., s).
    far is how many bits of the SimHashes may differ, as in small buckets of the same kind.

    A task takes a bucket of up to PART ids, or two parts of a larger one.
    """
    parts = F.ceil(F.col("m") / F.lit(PART)).cast("int")
    dealt = crowded.join(crowded.groupBy("key", "far").agg(F.count("*").alias("m")), ["key", "far"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "far")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ids, texts, split = rows["id"].to_numpy(), rows["s"].to_numpy(), {}
        across = rows["low"].iloc[0] != rows["high"].iloc[0]
        odd = np.column_stack([rows[f"odd{k}"].to_numpy() for k in range(ODD)]).view(np.uint64)

        def words(k: int) -> list[bytes]:
            if k not in split:
                split[k] = bytes(texts[k]).split(b" ")
            return split[k]

        found = bucket_links(rows["sim"].to_numpy().view(np.uint64), odd, rows["n"].to_numpy().astype(np.int64), words, rows["part"].to_numpy() if across else None, int(rows["far"].iloc[0]), similarity)
        return pd.DataFrame([(min(ids[u], ids[v]), max(ids[u], ids[v])) for u, v in found], columns=["a", "b"], dtype="int64")

    return dealt.join(spelled, "id").groupBy("key", "far", "low", "high").applyInPandas(solve, "a long, b long")


def run_buckets(classes: DataFrame, similarity: float = SIMILARITY, far: int = FAR) -> DataFrame:
    """(a, b, key): pairs a < b of ids (id, sim, n, runs) that share the key of a run and are near enough by SimHash and
    length; the ids of large buckets (a, key) all stay, and pass through a task one batch after the other.

    Most keys are those of one line only, so rows are short: the key's last 16 bits give way to the line's length.
    """
    length = (1 << 16) - 1

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, full = 0, None

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            twice = np.concatenate([rows[0, 1:] == rows[0, :-1], [False]])
            rows = rows[:, twice | np.concatenate([[False], twice[:-1]])]
            keys, ids, sims, n = rows

            def near(one: np.ndarray, d: int) -> np.ndarray:
                one = one[np.bitwise_count((sims[one] ^ sims[one + d]).view(np.uint64)) <= far]
                return one[np.abs(n[one] - n[one + d]) <= np.floor(np.maximum(n[one], n[one + d]) * (1 - similarity) + 1e-9)]

            yield from _pairs(keys, ids, near, far)

        for batch in batches:
            key, ids, sims = (c.to_numpy() for c in batch.columns)
            rows = np.stack([key >> 16, ids, sims, key & length])
            if full is not None:  # the bucket that has been found to be large goes on
                stop = int(np.searchsorted(rows[0], full, side="right"))
                yield _met(rows[1, :stop], keys=rows[0, :stop], far=far)
                rows = rows[:, stop:]
            if not rows.shape[1]:
                continue
            full = None
            held.append(rows)
            waiting += rows.shape[1]
            if waiting >= GATHER:
                rows = np.concatenate(held, axis=1)
                stop = int(np.searchsorted(rows[0], rows[0, -1]))  # the last bucket may go on in the next batch
                if stop:
                    yield from solve(rows[:, :stop])
                held, waiting = [rows[:, stop:]], rows.shape[1] - stop
                if waiting > SMALL_BUCKET:
                    yield _met(held[0][1], keys=held[0][0], far=far)
                    full, held, waiting = held[0][0, -1], [], 0
        if waiting:
            yield from solve(np.concatenate(held, axis=1))

    keyed = classes.select(F.explode("runs").alias("key"), "id", "sim", "n")
    keyed = keyed.select(F.col("key").bitwiseAND(F.lit(~length)).bitwiseOR(F.least("n", F.lit(length))).alias("key"), "id", "sim")
    keyed = keyed.repartition(F.shiftright("key", 16)).sortWithinPartitions("key")
    return keyed.mapInArrow(thin, _MET)


def near_buckets(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, key): pairs a < b of ids (id, sim) whose SimHashes differ in at most radius bits, and large buckets (a, key).

    Two SimHashes that differ in at most radius bits agree on one of radius + 1 blocks, and, as their other bits hold
    all that differs, on one of radius + 1 parts of those too. Blocks are what Spark deals out by; parts are grouped
    inside the task. A block that very many ids share makes a bucket of each of its parts instead, so no task gets it
    whole. The pairs of small buckets are looked at in the task; large buckets stay whole.
    """
    count = radius + 1
    low = [64 * k // count for k in range(count + 1)]
    widths = [64 - (low[t + 1] - low[t]) for t in range(count)]

    def rest(sim, t: int):  # the bits outside block t, moved together
        above = F.shiftrightunsigned(sim, low[t + 1]) if t + 1 < count else F.lit(0).cast("long")
        return sim.bitwiseAND(F.lit((1 << low[t]) - 1)).bitwiseOR(F.shiftleft(above, low[t]))

    def part(value, t: int, j: int):
        a, b = widths[t] * j // count, widths[t] * (j + 1) // count
        return F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1))

    sim = F.col("sim")
    block = lambda t: F.shiftrightunsigned(sim, low[t]).bitwiseAND(F.lit((1 << (low[t + 1] - low[t])) - 1))
    # the last six bits of a block's key say which block it is
    tables = F.array(*[F.xxhash64(block(t)).bitwiseAND(F.lit(~63)).bitwiseOR(F.lit(t)) for t in range(count)])
    laid = classes.select("id", "sim", F.explode(tables).alias("g"))
    # no more rows than blocks have values: 4 times 65,536 at the radius of 3
    full = F.broadcast(laid.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > FULL_BLOCK).select("g", F.lit(True).alias("full")))
    mine = F.col("g").bitwiseAND(F.lit(63))
    parts = F.array(*[F.struct(F.lit(j).alias("j"), sum((F.when(mine == t, part(rest(sim, t), t, j)).otherwise(F.lit(0)) for t in range(count)), F.lit(0)).alias("v")) for j in range(count)])
    dealt = laid.join(full, "g", "left")
    few = dealt.filter("full is null").select("id", "sim", "g")
    many = dealt.filter("full").select("id", "g", F.explode(parts).alias("x")).select("id", F.xxhash64("g", "x.j", "x.v").alias("g"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, sims, g = rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64)
            t = (g & np.uint64(63)).astype(np.int64)
            under, over = np.array(low[:-1], np.uint64)[t], np.array(low[1:], np.uint64)[t]
            above = np.where(over < 64, sims >> np.minimum(over, np.uint64(63)), np.uint64(0))
            others = (sims & ((np.uint64(1) << under) - np.uint64(1))) | (above << under)
            bits = np.uint64(len(ids).bit_length())  # keys give their last bits to the row, so that one sort of numbers does
            for k in range(count):
                a, b = (np.array([w * x // count for w in widths], np.uint64)[t] for x in (k, k + 1))
                value = (others >> a) & ((np.uint64(1) << (b - a)) - np.uint64(1))
                keys = grams.mix(grams.mix(value * np.uint64(count) + np.uint64(k)) + g)
                laid = np.sort(((keys >> bits) << bits) | np.arange(len(ids), dtype=np.uint64))
                order, own = (laid & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), (laid >> bits) << bits
                s = sims[order]
                yield from _pairs(own.view(np.int64), ids[order], lambda one, d: one[np.bitwise_count(s[one] ^ s[one + d]) <= radius], radius)  # noqa: B023

        waiting = 0
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            held.append(rows)
            waiting += rows.shape[1]
            if waiting >= GATHER:
                rows = np.concatenate(held, axis=1)
                stop = int(np.searchsorted(rows[2], rows[2, -1]))  # the last block may go on in the next batch
                if stop:
                    yield from solve(rows[:, :stop])
                held, waiting = [rows[:, stop:]], rows.shape[1] - stop
        if held:
            yield from solve(np.concatenate(held, axis=1))

    inside = few.repartition("g").sortWithinPartitions("g").mapInArrow(find, _MET)
    return inside.union(many.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("g").alias("key"), F.lit(radius).alias("far")))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay and all blank lines in `text_col`, other columns as they are.

    Null and blank texts stay as they are. A text none of whose lines stays is a copy line by line: its row goes.
    """
    stay = repeated_lines(docs, similarity, id_col=id_col, text_col=text_col)
    text = F.col(f"row.{text_col}")
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("content"))
    blank = lambda x: F.regexp_replace(x, "[ \t-\r]", "") == ""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, k: blank(x) | F.array_contains("stay", k)), "\n")
    nothing = F.coalesce(blank(text), F.lit(True))
    out = mine.join(stay, ["id", "content"], "left").filter(nothing | F.col("stay").isNotNull())
    return out.select(*[(F.when(nothing, text).otherwise(left) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, stay): lines of each document, blank ones included, and the numbers of those that stay."""
    mine = _named(docs, id_col, text_col).select("id", "content", F.coalesce(F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    out = mine.join(repeated_lines(docs, id_col=id_col, text_col=text_col), ["id", "content"], "left")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_lines", F.coalesce("stay", F.array().cast("array<int>")).alias("stay"))
