"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a leading mark, marks for spaces) and cut into marked words that no piece crosses. The distinct
words of a batch are sorted, which lays them out as the leaves of a trie; walking it depth-first keeps the forward
scores of the current path, so a prefix that many words share is scored once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Vocabulary file; a parameter of every entry point.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a task remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces with scores, as Viterbi needs them: every suffix of a piece, with the piece's score and id where it is one."""

    size: int
    suffixes: dict[str, tuple[float, int]]
    unknown: int
    unknown_score: float
    byte_ids: list[int] | None
    texts: list[bytes] = field(repr=False)
    crossing: bool = False

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  B ") != f"{MARK}{MARK}a{MARK}{MARK}B{MARK}":
            raise ValueError(f"{path}: only models that mark spaces and change nothing else are supported")
        return cls.of([(model.id_to_piece(i), model.get_score(i), "b" if model.is_byte(i) else "u" if model.is_unknown(i) else "c" if model.is_control(i) or model.is_unused(i) else "n") for i in range(model.get_piece_size())])

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> "Vocabulary":
        """From (piece, score, kind): n normal, b byte, u unknown, c control."""
        none = float("-inf")
        suffixes: dict[str, tuple[float, int]] = {}
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "n"]
        for p, s, i in normal:
            for k in range(1, len(p)):
                suffixes.setdefault(p[k:], (none, -1))
            suffixes[p] = (s, i)
        in_bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "b"}
        texts = [bytes([int(p[3:5], 16)]) if kind == "b" else b"" if kind == "c" else " ⁇ ".encode() if kind == "u" else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        return cls(
            len(pieces), suffixes, next((i for i, x in enumerate(pieces) if x[2] == "u"), 0), min((s for _, s, _ in normal), default=0.0) - UNKNOWN_PENALTY,
            [in_bytes[b] for b in range(256)] if len(in_bytes) == 256 else None, texts, any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in normal),
        )


def walk(words: Iterable[str], vocabulary: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    """(word, ids) of sorted distinct words: the segmentation of the highest score, the earliest start on ties."""
    get, lost = vocabulary.suffixes.get, vocabulary.unknown_score
    scores, starts, ids = [0.0], [0], [0]
    before = ""
    for word in words:
        shared = 0
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del scores[shared + 1 :], starts[shared + 1 :], ids[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            at = end - 1
            hit = get(word[at:end])
            if hit is None:
                best, start, piece = scores[at] + lost, at, -1
            else:
                best, start, piece = scores[at] + (hit[0] if hit[1] >= 0 else lost), at, hit[1]
                for at in range(end - 2, -1, -1):
                    hit = get(word[at:end])
                    if hit is None:
                        break
                    value = scores[at] + hit[0]
                    if value >= best and hit[1] >= 0:
                        best, start, piece = value, at, hit[1]
            scores.append(best)
            starts.append(start)
            ids.append(piece)
        out: list[int] = []
        end = len(word)
        while end:
            if ids[end] >= 0:
                out.append(ids[end])
            elif vocabulary.byte_ids is not None:
                out.extend(vocabulary.byte_ids[b] for b in reversed(word[starts[end] : end].encode("utf-8", "replace")))
            elif not (out and out[-1] == vocabulary.unknown):
                out.append(vocabulary.unknown)
            end = starts[end]
        out.reverse()
        yield word, out
        before = word


_RUNS = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def marked_words(text: str, vocabulary: Vocabulary) -> list[str]:
    """The marked words of a text in order; joined, they are the marked text. Empty strings between words don't matter."""
    if not text:
        return []
    if vocabulary.crossing:  # a piece may cross any boundary: the text is one word
        return [MARK + text.replace(" ", MARK)]
    laid = MARK + text.replace(" ", " " + MARK)
    if f"{MARK} {MARK}" in laid:
        return _RUNS.findall(MARK + text.replace(" ", MARK))
    return laid.replace("\n", " \n ").split(" ")


class Encoder:
    """Encodes texts batch by batch; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {"": b""}

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 in native order."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        known, cut = self.known, [marked_words(t or "", self.vocabulary) for t in texts]
        new = set().union(*cut) - known.keys()
        long: dict[str, bytes] = {}
        for word, ids in walk(sorted(new), self.vocabulary):
            (known if len(word) <= REMEMBERED_CHARS else long)[word] = np.array(ids, np.int32).tobytes()
        look = (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__
        return [b"".join(map(look, words)) for words in cut]


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """Text of a list of ids: pieces joined, byte pieces read as UTF-8 (bad bytes replaced), the leading mark taken off."""
    return b"".join(map(vocabulary.texts.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids of every whole text, and whether decoding them gives the text back.

    Null and empty texts have no ids and count as round trips. Texts with a literal mark (U+2581) come back with a
    space in its place, so their round_trip is false. The vocabulary is read by the driver and sent to the tasks: its
    size is that of the file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = encoder.batch(texts)
            values = np.frombuffer(b"".join(done), np.int32)
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in done], dtype=np.int32)]).astype(np.int32)
            listed = values.tolist()
            same = [decode_ids(listed[a:b], vocabulary) == (t or "") for t, a, b in zip(texts, at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(values)), pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids; null lists give an empty text. Ids outside the vocabulary raise an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("x")).mapInArrow(run, f"doc_id {kind}, text string")
