"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised; the exponent is bisected to meet a target
entropy or a repetition limit. The weights are realised by drawing whole permutations of a source's documents, one
block after another, until its budget of tokens is used up; the last permutation is cut where the budget ends, before or
after the document that it ends in, whichever is nearer the budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.store import cut as stored

#: Exponents tried at once; each round of the bisection narrows the bracket by this factor.
GRID = 32
ROUNDS = 6
#: Blocks of a permutation: a cut lies in one of them, so that no more than its rows are sorted in one task.
BLOCKS = 4096
SEED = 20240
#: Sources up to which their plan is sent to every task; beyond, it is joined, each source dealt out over SALTS tasks.
FEW_SOURCES, SALTS = 10_000, 64
NO_SOURCE = "(none)"


@dataclass
class Temperature:
    """Exponent found, with the entropy of the weights and the highest number of times that a source is repeated."""

    exponent: float
    entropy: float
    repetition: float
    sources: int
    tokens: int


def n_tokens(text: F.Column) -> F.Column:
    """Words between white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[F.Column]:
    """Source, tokens and place in the source's permutation of each row; a null source is one of its own."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), source, F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return [source.alias("source"), n_tokens(F.col(text_col)).alias("n_tokens"), place.alias("place")]


def solve(shares: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None) -> Temperature:
    """Exponent in [0, 1] for shares (source, tokens > 0).

    target_entropy is a share of the logarithm of the number of sources: the largest exponent whose weights reach it.
    max_repeats: the smallest exponent at which no source is drawn more often than that. With both, the larger of the
    two, so the limit holds. Sums over sources are Spark's; the driver gets one row a round.
    """
    total, sources, least = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*"), F.min("tokens")).first()
    if not sources:
        return Temperature(1.0, 0.0, 0.0, 0, 0)
    p = F.col("tokens") / F.lit(float(total))
    log_least = math.log(least / total)

    def at(exponents: list[float]) -> list[tuple[float, float]]:
        sums = [f for a in exponents for f in (F.sum(F.exp(a * F.log(p))), F.sum(F.exp(a * F.log(p)) * F.log(p)))]
        row = shares.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        out = []
        for k, a in enumerate(exponents):
            z, moment = row[2 * k], row[2 * k + 1]
            out.append((math.log(z) - a * moment / z, budget / total * math.exp((a - 1) * log_least) / z))
        return out

    def bisect(holds, rising: bool) -> float:
        """Border of the exponents at which `holds`: the largest if they lie below it, else the smallest."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            ok = [holds(*x) for x in at(grid)]
            if rising:
                k = next((k for k, x in enumerate(ok) if x), None)
                if k is None:
                    return high
                if k == 0:
                    return low
                low, high = grid[k - 1], grid[k]
            else:
                k = next((k for k in range(GRID, -1, -1) if ok[k]), None)
                if k is None:
                    return low
                if k == GRID:
                    return high
                low, high = grid[k], grid[k + 1]
        return high if rising else low

    exponent = 1.0 if target_entropy is None and max_repeats is None else 0.0
    if target_entropy is not None:
        aim = target_entropy * math.log(sources) if sources > 1 else 0.0
        exponent = max(exponent, bisect(lambda entropy, _: entropy >= aim - 1e-12, rising=False))
    if max_repeats is not None:
        exponent = max(exponent, bisect(lambda _, repeats: repeats <= max_repeats + 1e-12, rising=True))
    entropy, repeats = at([exponent])[0]
    return Temperature(exponent, entropy, repeats, sources, total)


def plan(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 2.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """(source, tokens, weight, epochs, cut, exponent): how often each source is drawn whole, and where the last draw ends.

    budget: tokens of the mixture, those of all documents by default. A document is in the cut draw if its place comes
    before `cut`; the document that the budget ends in counts if that is nearer the budget, or if its source had no draw else. Documents without tokens take part in whole draws only as their place says; sources without any
    token have weight 0 and one whole draw, as they cost nothing.
    """
    rows = stored(docs.select(*keyed(docs, id_col, text_col, source_col, seed)).groupBy("source", "place").agg(F.sum("n_tokens").alias("n")))
    block = (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * blocks / (1 << 32)).cast("int")
    tally = rows.groupBy("source", block.alias("block")).agg(F.sum("n").alias("n"))
    shares = stored(tally.groupBy("source").agg(F.sum("n").alias("tokens")))
    total = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = float(total) if budget is None else float(budget)
    found = solve(shares.filter("tokens > 0"), budget, target_entropy, max_repeats)
    if not found.tokens:
        return shares.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit("").alias("cut"), F.lit(found.exponent).alias("exponent"))
    raw = F.when(F.col("tokens") > 0, F.exp(found.exponent * F.log(F.col("tokens") / F.lit(float(total))))).otherwise(0.0)
    norm = shares.select(raw.alias("w")).agg(F.sum("w")).first()[0]
    weight = raw / F.lit(norm)
    drawn = shares.select("source", "tokens", weight.alias("weight"), F.round(weight * F.lit(budget)).alias("aim")).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.floor(F.col("aim") / F.col("tokens") + 1e-9)).otherwise(1).cast("long")
    )
    drawn = drawn.withColumn("rest", F.greatest(F.col("aim") - F.col("epochs") * F.col("tokens"), F.lit(0.0)))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        tally.withColumn("before", F.coalesce(F.sum("n").over(by_block), F.lit(0)))
        .join(drawn.select("source", "rest"), "source")
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        .groupBy("source", "rest").agg(F.max("block").alias("block"), F.max_by("before", "block").alias("before"))
    )
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        rows.withColumn("block", block)
        .join(edge, ["source", "block"])
        .withColumn("upto", F.col("before") + F.sum("n").over(by_place))
        .filter("upto > rest")
        .groupBy("source").agg(F.min(F.struct("place", "upto", "n")).alias("at"))
        .select("source", F.col("at.place").alias("place"), F.col("at.upto").alias("upto"), (F.col("at.upto") - F.col("at.n")).alias("under"))
    )
    nearer = (F.col("upto") - F.col("rest") < F.col("rest") - F.col("under")) | ((F.col("epochs") == 0) & (F.col("under") == 0) & (F.col("aim") > 0))
    cut = F.when(nearer, F.concat("place", F.lit("~"))).otherwise(F.col("place"))  # places are hexadecimal and of one length
    # a source whose rest covers all its documents has been drawn whole already, up to rounding: nothing is left to cut
    return stored(drawn.join(ends, "source", "left").select("source", "tokens", "weight", "epochs", F.coalesce(cut, F.lit("")).alias("cut"), F.lit(found.exponent).alias("exponent")))


def draws(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: list[str] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(row, epoch, block, place, weight) for each time that a document is drawn; row holds the columns `keep` of docs.

    Sorted by epoch, block and place, the draws are the training order: block permutations, each with all sources in proportion.
    Rows of the same id and source share their place, so they are drawn together.
    """
    keep = docs.columns if keep is None else keep
    source, _, place = keyed(docs, id_col, text_col, source_col, seed)
    laid = docs.select(F.struct(*keep).alias("row"), source, place)
    times = (F.col("epochs") + (F.col("place") < F.col("cut")).cast("long")).cast("int")
    if planned.count() <= FEW_SOURCES:
        joined = laid.join(F.broadcast(planned), "source")
    else:
        salted = planned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = laid.withColumn("salt", F.conv(F.substring("place", 9, 8), 16, 10).cast("long") % SALTS).join(salted, ["source", "salt"])
    drawn = joined.filter(times > 0).select("row", "place", F.explode(F.sequence(F.lit(1), times)).alias("epoch"), "weight")
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch"), F.col("place")))
    block = (F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long") * blocks / (1 << 32)).cast("int")
    return drawn.select("row", "epoch", block.alias("block"), mixed.alias("place"), "weight")


def mix(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 2.0, budget: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place, weight) of every draw of the mixture."""
    planned = plan(docs, target_entropy, max_repeats, budget)
    light = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.lit("").alias("text"))
    return draws(light, planned, keep=["doc_id", "source", "n_tokens"]).select("row.*", "epoch", "block", "place", "weight")


def mixed_documents(docs: DataFrame, target_entropy: float | None = 0.98, max_repeats: float | None = 2.0, budget: float | None = None) -> DataFrame:
    """The drawn documents with their columns, a row for each draw."""
    return draws(docs, plan(docs, target_entropy, max_repeats, budget)).select("row.*")
