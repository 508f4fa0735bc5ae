"""The pipeline's stages, each against brute force on its own input, and run() against their composition."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import minhash, mixing, pieces, toxicity
from tests.llm.test_small import closed, distance, near_copy, normal, shingles, words

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(8)
    bases = [words(200 + k, 60) for k in range(40)]
    texts = ["\n".join(" ".join(b[a : a + 20]) for a in (0, 20, 40)) for b in bases]
    texts += [" ".join(near_copy(bases[k], [3])) for k in range(4)] + texts[:3] + [None, "", " \n"]
    texts += [t + " what an idiot you are stupid" for t in (" ".join(words(300 + k, 40)) for k in range(40))]
    rows = [(k, t, "en", f"s{min(2, k % 5)}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int("idiot" in (t or ""))) for k, t in enumerate(texts) if t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert rng is not None
    return path


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = []
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append([tuple(r) for r in frames[-1].collect()])
        frames.append(stage(spark, frames[-1], folder))
    outputs = [[tuple(r) for r in f.collect()] for f in frames[1:]]
    assert all(f.columns == NAMES for f in frames[1:-1])

    # toxicity: the rows that the model scores below the threshold, one text at a time
    score = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    assert Counter(outputs[0]) == Counter(r for r in inputs[0] if score(r[1]) < toxicity.THRESHOLD)
    assert not any("idiot" in (r[1] or "") for r in outputs[0]) and len(outputs[0]) == 50

    # lines: of every group of lines that edit similarity connects, the first occurrence stays
    first, places = {}, defaultdict(list)
    for r in sorted(inputs[1]):
        for k, line in enumerate((r[1] or "").split("\n")):
            if normal(line):
                first.setdefault(normal(line), (r[0], k))
                places[r[0]].append(k)
    pairs = [(first[a], first[b]) for a in first for b in first if first[a] < first[b] and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
    up = closed(first.values(), pairs)
    stay = {at for at in up if up[at] == at}
    left = {}
    for r in inputs[1]:
        lines = [x for k, x in enumerate((r[1] or "").split("\n")) if not normal(x) or (r[0], k) in stay]
        if r[1] is None or not r[1].strip() or any(normal(x) for x in lines):
            left[r[0]] = r[1] if r[1] is None or not r[1].strip() else "\n".join(lines)
    assert {r[0]: r[1] for r in outputs[1]} == left and len(left) < len(inputs[1])

    # near copies: one of each group of documents that brute force links
    sets = {r[0]: shingles(r[1], minhash.WORDS) for r in inputs[2]}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= minhash.PERCENT * len(sets[a] | sets[b])]
    up = closed(sets, pairs)
    assert Counter(outputs[2]) == Counter(r for r in inputs[2] if up[r[0]] == r[0])

    # mixing: documents drawn as often as the plan's budgets say
    tokens = Counter()
    for r in inputs[3]:
        tokens[r[3]] += len((r[1] or "").split())
    weights = {r["source"]: r["weight"] for r in mixing.plan(frames[3]).collect()}
    drawn = Counter()
    for r in outputs[3]:
        drawn[r[3]] += len((r[1] or "").split())
    longest = max(len((r[1] or "").split()) for r in inputs[3])
    assert set(outputs[3]) <= set(inputs[3])
    for s, w in weights.items():
        aim = round(w * sum(tokens.values()))
        assert abs(drawn[s] - aim) <= longest

    # encoding
    vocabulary = pieces.Vocabulary.load()
    for i, n, ids, fine in outputs[4]:
        text = next(r[1] for r in inputs[4] if r[0] == i)
        assert fine and n == len(ids) and pieces.decode_ids(list(ids), vocabulary) == (text or "")

    assert Counter((i, tuple(ids)) for i, _, ids, _ in outputs[4]) == Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if out.columns == NAMES else docs
