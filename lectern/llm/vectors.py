"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors form a class. Classes are laid into overlapping clusters around centroids that are fitted on a bounded
sample; clusters that hold more than a shard are split in the same way, level by level, so that there are as many clusters
as the classes need, unless a cluster is dense: then its vectors are so near each other that splits would part links. In each shard of a cluster a graph is built whose neighbour lists are pruned robustly, the lists of a vector
from all its shards are united, and every vector searches the shards of its clusters: greedily from the shard's medoid and
from its own place, then through everything within range. What is found is verified in double precision, counted, and
reduced to a forest before it leaves the task. Recall is audited against brute force on a sample of queries and on copies of
them that are planted at the threshold, so that there is something to find in any table; the search is widened if short,
and shards are compared exactly if it stays short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.llm.links import components
from lectern.llm.store import cut

LEAST = 0.95
#: Vectors that centroids are fitted on at most, vectors that a cluster aims at, and those that a shard holds at most.
SAMPLE, AIM, SHARD = 8192, 1200, 2048
#: Vectors of a cluster that its split is fitted on about, clusters that it is split into at most, vectors that one task assigns.
DRAW, FAN, TASK = 2048, 64, 50_000
#: Levels of splits at most: enough for 10^12 vectors.
LEVELS = 5
#: Share of linked pairs among those drawn from a cluster from which on it is dense.
DENSE = 0.02
#: Vectors drawn for the recall audit, the recall below which the search is widened, and that which must be reached at last.
AUDIT, RECALL, ENOUGH = 256, 0.97, 0.9
#: How far above the threshold copies are planted, as a share of what is between it and 1.
TURN = 0.02
#: (clusters of each vector, width of the beam), tried in turn.
WIDTHS = ((2, 32), (4, 64), (8, 128))
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: Vectors of a shard of which the nearest is where a query starts that isn't in the shard.
PIVOTS = 64
SEED = 7


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors, started from vectors spread over the sample."""
    c = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def pruned_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbour lists of unit vectors: from a vector's nearest candidates the nearest is taken again and again, and those
    that are closer to a taken one than to the vector, by the factor alpha, are left out. Edges are also followed back.
    What the medoid doesn't reach by them is joined by edges both ways to what it does reach."""
    n = len(x)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    s = x @ x.T
    np.fill_diagonal(s, -2)
    width = min(CANDIDATES, n - 1)
    near = np.argpartition(-s, width - 1, axis=1)[:, :width]
    rows = np.arange(n)
    near = near[rows[:, None], np.argsort(-s[rows[:, None], near], axis=1, kind="stable")]
    apart = 2 - 2 * s[rows[:, None], near]
    open_, taken = np.ones(near.shape, np.bool_), np.full((n, degree), -1)
    for k in range(degree):
        at = open_.argmax(1)
        some = open_[rows, at]
        if not some.any():
            break
        star = near[rows, at]
        taken[some, k] = star[some]
        between = 2 - 2 * s[star[:, None], near]
        open_ &= ~((alpha * alpha * between <= apart) & some[:, None])
        open_[rows, at] = False
    out, back = [t[t >= 0] for t in taken], [[] for _ in range(n)]
    for p, t in enumerate(out):
        for q in t:
            if len(back[q]) < degree:
                back[q].append(p)
    lists = [np.unique(np.concatenate([t, np.array(b, np.int64)])) for t, b in zip(out, back)]
    return _connected(lists, s, _medoid(x))


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def _connected(lists: list[np.ndarray], s: np.ndarray, start: int) -> list[np.ndarray]:
    """The lists with edges added, from the nearest vector that is reached to the one that isn't, until start reaches all."""
    n = len(lists)
    reached = np.zeros(n, np.bool_)
    to = np.full(n, -1)  # the nearest that is reached, and how near
    near = np.full(n, -np.inf)
    edge = [start]
    while True:
        grown = []
        reached[edge] = True
        while edge:
            grown += edge
            step = np.unique(np.concatenate([lists[k] for k in edge]))
            edge = step[~reached[step]].tolist()
            reached[edge] = True
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return lists
        sub = s[np.ix_(rest, grown)]
        best = sub.argmax(1)
        value = sub[np.arange(len(rest)), best]
        closer = value > near[rest]
        near[rest[closer]], to[rest[closer]] = value[closer], np.array(grown)[best[closer]]
        q = int(rest[near[rest].argmax()])
        lists[to[q]], lists[q] = np.append(lists[to[q]], q), np.append(lists[q], to[q])
        edge = [q]


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> np.ndarray:
    """Marks [query, vector] of those found within range, by greedy search and expansion of the range.

    lists: neighbours of each vector, padded with -1. Queries start at the medoid and at their own place in x, `own`;
    where that isn't given, at the nearest of a few vectors.
    """
    n, m = len(x), len(queries)
    found = np.zeros((m, n), np.bool_)
    start = _medoid(x)
    if own is None:
        pivots = np.random.default_rng(SEED).choice(n, min(n, PIVOTS), replace=False)
        own = pivots[(queries @ x[pivots].T).argmax(1)]
    for a in range(0, m, 256):
        q = queries[a : a + 256]
        b = len(q)
        rows = np.arange(b)
        seen = np.zeros((b, n + 1), np.bool_)
        seen[:, n] = True  # the padding counts as seen
        seen[:, start] = True
        ids, sims, done = np.full((b, beam), n), np.full((b, beam), -3.0, np.float32), np.ones((b, beam), np.bool_)
        ids[:, 0], sims[:, 0], done[:, 0] = start, q @ x[start], False
        hit = found[a : a + 256]
        hit[:, start] = sims[:, 0] >= least
        mine = own[a : a + 256]
        other = np.flatnonzero(mine != start)
        seen[other, mine[other]] = True
        ids[other, 1], sims[other, 1], done[other, 1] = mine[other], np.einsum("ij,ij->i", q[other], x[mine[other]]), False
        hit[other, mine[other]] |= sims[other, 1] >= least
        while True:
            rank = np.where(done, -4.0, sims)
            at = rank.argmax(1)
            live = np.flatnonzero(rank[rows, at] > -4)
            if not len(live):
                break
            done[live, at[live]] = True
            new = lists[ids[live, at[live]]]
            new = np.where(new < 0, n, new)
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            value = np.full(new.shape, -3.0, np.float32)
            r, c = np.nonzero(fresh)
            value[r, c] = np.einsum("ij,ij->i", q[live[r]], x[new[r, c]])
            hot = value[r, c] >= least
            hit[live[r[hot]], new[r[hot], c[hot]]] = True
            ids2, sims2 = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], value], 1)
            done2 = np.concatenate([done[live], ~fresh], 1)
            keep = np.argpartition(-sims2, beam - 1, axis=1)[:, :beam]
            k = np.arange(len(live))[:, None]
            ids[live], sims[live], done[live] = ids2[k, keep], sims2[k, keep], done2[k, keep]
        r, c = np.nonzero(hit)
        while len(r):  # all within range lead on, not only those of the beam
            new = lists[c]
            pairs = np.unique((r[:, None] * (n + 1) + np.where(new < 0, n, new)).ravel())
            r, c = pairs // (n + 1), pairs % (n + 1)
            fresh = ~seen[r, c]
            r, c = r[fresh], c[fresh]
            seen[r, c] = True
            value = np.concatenate([np.einsum("ij,ij->i", q[r[k : k + 32768]], x[c[k : k + 32768]]) for k in range(0, len(r), 32768)]) if len(r) else np.empty(0)
            r, c = r[value >= least], c[value >= least]
            hit[r, c] = True
    return found


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1)
    for k, one in enumerate(lists):
        out[k, : len(one)] = one
    return out


def _forest(found: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for each member of a component of a symmetric matrix that isn't its root."""
    n = len(found)
    left, out = np.ones(n, np.bool_), []
    for k in range(n):
        if not left[k]:
            continue
        left[k] = False
        edge = [k]
        while edge:
            reach = found[edge].any(0) & left
            left &= ~reach
            edge = np.flatnonzero(reach).tolist()
            out += [(v, k) for v in edge]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that can link: with an id, not empty, all components finite numbers, not all zero."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _search(classes: DataFrame, n: int, least: float, overlap: int, beam: int | None) -> tuple[DataFrame, DataFrame]:
    """(id, found): weight of the classes linked with each class; (a, b): edges that connect what is linked.

    Without a beam the shards that meet are compared exactly. Classes of weight 0, the planted ones, find and are no edges.
    """
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    middle = {d: centroids(_unit(x), max(1, min(len(x) // 8, -(-overlap * n * len(x) // max(len(sample), 1) // AIM)))) for d, x in by_size.items()}

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        for d in {len(v) for v in vectors}:
            at = [k for k, v in enumerate(vectors) if len(v) == d]
            if d not in middle:
                near = np.zeros((len(at), 1), np.int64)
            else:
                near = np.argsort(-(_unit(vectors.iloc[at]) @ middle[d].T), axis=1, kind="stable")[:, :overlap]
            for k, x in zip(at, near):
                out[k] = sorted(int(y) for y in x)
        return pd.Series(out)

    laid = cut(classes.withColumn("dim", F.size("v")).withColumn("clusters", nearest("v")))
    member = laid.withColumn("cluster", F.explode(F.transform("clusters", lambda x: x.cast("long")))).drop("clusters")
    level = 0
    while level < LEVELS:
        level += 1
        split = _split(member, least, overlap, level, classes.schema["id"].dataType.simpleString())
        if split is None:
            break
        member = split
    paths = member.groupBy("id").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))  # overlap for each level at most
    sizes = member.groupBy("dim", "cluster").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / F.lit(SHARD)).cast("int").alias("parts")
    member = member.join(paths, "id").join(sizes.select("dim", "cluster", parts), ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        lists = pruned_graph(_unit(rows["v"]).astype(np.float32))
        return pd.DataFrame({"id": ids, "near": [ids[x] for x in lists]})

    kind = classes.schema["id"].dataType.simpleString()
    graph = member.groupBy("dim", "cluster", "part").applyInPandas(build, f"id {kind}, near array<{kind}>")
    united = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a few lists of bounded length
    member = cut(member.join(united, "id"))
    # every two shards of a cluster meet once; a cluster of one shard meets itself
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = member.withColumn("other", other).select("*", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        cluster = rows["cluster"].iloc[0]
        exact = _unit(rows["v"])
        x = exact.astype(np.float32)
        ids, weight, part = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["part"].to_numpy()
        found = np.zeros((len(x), len(x)), np.bool_)
        sides = [np.flatnonzero(part == p) for p in sorted(set(part))]
        if beam is None:
            found |= x @ x.T >= np.float32(least - 1e-5)
            if len(sides) == 2:  # each of them meets itself elsewhere
                for side in sides:
                    found[np.ix_(side, side)] = False
        for index in sides if beam is not None else []:
            place = {v: k for k, v in enumerate(ids[index])}
            lists = _padded([np.array([place[y] for y in near if y in place], np.int64) for near in rows["near"].iloc[index]])
            asks = [s for s in sides if len(sides) == 1 or s is not index]
            for queries in asks:
                if len(index) and len(queries):
                    own = np.arange(len(index)) if queries is index else None
                    found[np.ix_(queries, index)] |= range_search(x[index], lists, x[queries], np.float32(least - 1e-5), beam, own)
        found |= found.T
        np.fill_diagonal(found, False)
        # two vectors may share several clusters: the first of them counts
        shared = [set(c) for c in rows["clusters"]]
        for before in sorted(set().union(*shared)):
            if before < cluster:
                has = np.array([before in s for s in shared])
                found[np.ix_(has, has)] = False
        r, c = np.nonzero(found)
        for k in range(0, len(r), 32768):
            a, b = r[k : k + 32768], c[k : k + 32768]
            found[a, b] = np.einsum("ij,ij->i", exact[a], exact[b]) >= least
        found &= found.T
        total = found @ weight
        links = [(ids[a], ids[b]) for a, b in _forest(found & (weight > 0) & (weight > 0)[:, None])]
        out = [(i, None, int(t)) for i, t in zip(ids, total) if t] + [(a, b, 0) for a, b in links]
        return pd.DataFrame(out, columns=["id", "to", "found"]).astype({"id": rows["id"].dtype, "to": "Int64", "found": "int64"})

    results = cut(met.groupBy("dim", "cluster", "one", "two").applyInPandas(search, f"id {kind}, to {kind}, found long"))
    return results.filter("to is null").groupBy("id").agg(F.sum("found").alias("found")), results.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))


def _split(member: DataFrame, least: float, overlap: int, level: int, kind: str) -> DataFrame | None:
    """member (id, v, n, dim, cluster) with the clusters beyond a shard split around centroids of their own, each vector in
    the nearest `overlap` of them; None where nothing is left to split. Dense clusters stay whole.

    Centroids stay in Spark: a row for each cluster that is split, next to the parts of its vectors, is all that a task gets.
    """
    sizes = member.groupBy("dim", "cluster").agg(F.count("*").alias("m")).filter(F.col("m") > SHARD)
    big = member.join(sizes, ["dim", "cluster"])
    drawn = big.filter(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < F.lit(1 << 30) / F.col("m") * DRAW)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(rows["v"])
        m = int(rows["m"].iloc[0])
        k = min(FAN, -(-overlap * m // AIM), len(x) // 8)
        linked = ((x @ x.T >= least).sum() - len(x)) / max(len(x) * (len(x) - 1), 1)
        found = [] if k < 2 * overlap or linked >= DENSE else [(rows["dim"].iloc[0], rows["cluster"].iloc[0], m, centroids(x, k).ravel().tolist())]
        return pd.DataFrame(found, columns=["dim", "cluster", "m", "middle"]).astype({"dim": "int32", "cluster": "int64", "m": "int64"})

    made = cut(drawn.groupBy("dim", "cluster").applyInPandas(fit, "dim int, cluster long, m long, middle array<double>"))
    if not made.limit(1).count():
        return None
    salts = F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(TASK))).cast("int")
    lead = made.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    mine = member.join(made.select("dim", "cluster", "m"), ["dim", "cluster"]).withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("m")
    base = 1 << (12 + 8 * level)  # numbers of one level are apart from those of all others

    def assign(rows: pd.DataFrame, middles: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(middles):
            return rows.assign(cluster=np.int64(0))[["id", "v", "n", "dim", "cluster"]].iloc[:0]
        c = np.array(middles["middle"].iloc[0]).reshape(-1, int(rows["dim"].iloc[0]))
        near = np.argsort(-(_unit(rows["v"]) @ c.T), axis=1, kind="stable")[:, :overlap]
        out = rows.loc[rows.index.repeat(near.shape[1])].copy()
        out["cluster"] = base + rows["cluster"].iloc[0] * FAN + near.ravel()
        return out[["id", "v", "n", "dim", "cluster"]]

    keys = ["dim", "cluster", "salt"]
    fresh = mine.groupBy(*keys).cogroup(lead.groupBy(*keys)).applyInPandas(assign, f"id {kind}, v array<double>, n long, dim int, cluster long")
    rest = member.join(made.select("dim", "cluster"), ["dim", "cluster"], "left_anti")
    return cut(rest.select("id", "v", "n", "dim", "cluster").union(fresh))


def planted(asked: pd.DataFrame, least: float, first: int) -> pd.DataFrame:
    """(id, v) of a copy of each vector asked for, turned in a random direction to a cosine just above `least`; ids go down
    from first."""
    rng, made = np.random.default_rng(SEED), []
    cosine = least + (1 - least) * TURN
    for v in asked["v"]:
        u = _unit([v])[0]
        w = rng.normal(size=len(u))
        w -= (w @ u) * u
        size = np.linalg.norm(w)
        made.append((cosine * u + np.sqrt(1 - cosine * cosine) * w / size if len(u) > 1 and size > 0 else u).tolist())
    return pd.DataFrame({"id": [first - k for k in range(len(made))], "v": made})


def audit(classes: DataFrame, found: DataFrame, least: float, asked: pd.DataFrame) -> tuple[int, int]:
    """(links found, links there are) of the vectors asked for, which are held against all classes by brute force.

    asked (id, v) is bounded, and sent to the tasks that hold all classes in blocks.
    """

    def run(batches):
        by_size = {d: (g["id"].to_numpy(), _unit(g["v"])) for d, g in asked.groupby(asked["v"].map(len))}
        for rows in batches:
            for d, g in rows.groupby(rows["v"].map(len)):
                if d in by_size:
                    ids, x = by_size[d]
                    near = (x @ _unit(g["v"]).T >= least) & (ids[:, None] != g["id"].to_numpy()[None, :])
                    yield pd.DataFrame({"id": ids, "real": near @ g["n"].to_numpy()})

    kind = classes.schema["id"].dataType.simpleString()
    real = classes.mapInPandas(run, f"id {kind}, real long").groupBy("id").agg(F.sum("real").alias("real"))
    row = real.join(found, "id", "left").agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("real"), F.lit(0))).first()
    return row[0], row[1]


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept, audited_recall).

    Two vectors are linked if the cosine in double precision is at least `least`; no pair below it is reported. Equal
    vectors are linked by class, whatever their number. Null, empty and zero vectors, and those with null or non-finite
    components, link with nothing; vectors of different lengths don't link. component_id is the smallest id that links
    lead to. Rows of one id are one vertex: each of them has the links of all. Ids are integers, of which the AUDIT below the
    smallest must exist in their type. A null id has component null and is kept. audited_recall is the share of the links of drawn vectors, and of
    copies of them planted at the threshold, that the search found; it is null only where no vector can link.
    """
    rows = usable(vectors, id_col, vector_col)
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n, first = classes.agg(F.count("*"), F.min("id")).first()
    asked = classes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(AUDIT).select("id", "v").toPandas()
    copies = planted(asked, least, int(first or 0) - 1)
    kind = classes.schema["id"].dataType.simpleString()
    laid = classes.union(vectors.sparkSession.createDataFrame(copies, f"id {kind}, v array<double>").select("v", "id", F.lit(0).cast("long")).coalesce(1))
    asked = pd.concat([asked, copies], ignore_index=True)
    got = real = 0
    found = edges = None
    for overlap, beam in [*WIDTHS, (WIDTHS[-1][0], None), (2 * WIDTHS[-1][0], None)]:
        found, edges = _search(laid, n, least, overlap, beam)
        got, real = audit(classes, found, least, asked)
        if got >= RECALL * real:
            break
    if got < ENOUGH * real:
        raise ValueError(f"the audit found {got} of {real} links")
    recall = got / real if real else None
    grouped = components(edges)
    placed = classes.select("id", "v", "n").join(found, "id", "left").join(grouped, "id", "left")
    per = placed.select("v", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    named = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("w"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return named.join(per, named["w"] == per["v"], "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall")
    )
