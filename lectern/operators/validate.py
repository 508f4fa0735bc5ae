"""Checks of translator replies, and the choice of the attempt that counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import PLACEHOLDER, REFUSALS, SEGMENT, clean_reply, is_meaningful, strip

SHORT = 10
ATTEMPTS = 3
# Sentences of the prompt whose presence shows that it was echoed; a parameter of the checks.
ECHOES = ("You are a professional translation engine", "CRITICAL RULES")


def is_refusal(reply: Column) -> Column:
    """Fewer than 50 characters with one of the phrases of a refusal."""
    low = F.lower(strip(reply))
    hit = low.contains(REFUSALS[0])
    for phrase in REFUSALS[1:]:
        hit = hit | low.contains(phrase)
    return F.coalesce((F.length(reply) < 50) & hit, F.lit(False))


def is_echo(reply: Column, echoes: tuple[str, ...] = ECHOES) -> Column:
    hit = F.lit(False)
    for sentence in echoes:
        hit = hit | reply.contains(sentence)
    return F.coalesce(hit, F.lit(False))


def placeholders_match(source: Column, reply: Column) -> Column:
    """As many placeholders in the reply, sloppily written ones included, as in the source."""
    return F.regexp_count(source, F.lit(PLACEHOLDER)) == F.regexp_count(reply, F.lit(r"<\s*placeholder\s*[,>]"))


def segments_match(reply: Column, n: Column) -> Column:
    return F.size(F.split(reply, SEGMENT, -1)) == n


def blocks_match(reply: Column, n: Column) -> Column:
    return F.size(F.filter(F.split(reply, "---", -1), lambda x: strip(x) != "")) == n


def is_short(reply: Column, least: int = SHORT) -> Column:
    return F.coalesce(F.length(reply), F.lit(0)) < least


def status(source: Column, reply: Column, failed: Column | None = None, least: int = 0, echoes: tuple[str, ...] = ECHOES, clean: Callable[[Column], Column] = clean_reply) -> Column:
    """First verdict that applies to a reply once it is cleaned: passthrough, error, empty, refusal, echo, mismatch, short, ok.

    least: characters below which a reply is short; 0 leaves this check out. A null reply is an error. clean: what is done
    with a reply first.
    """
    failed = reply.isNull() if failed is None else failed | reply.isNull()
    clean = F.coalesce(clean(reply), F.lit(""))
    out = F.when(~is_meaningful(source), "passthrough").when(failed, "error").when(clean == "", "empty").when(is_refusal(clean), "refusal").when(is_echo(clean, echoes), "echo").when(~placeholders_match(source, clean), "mismatch")
    if least:
        out = out.when(is_short(clean, least), "short")
    return out.otherwise("ok")


def is_final(verdict: Column) -> Column:
    """Whether no further attempt follows a verdict."""
    return verdict.isin("ok", "refusal", "passthrough")


def first_valid_attempt(replies: DataFrame, most: int = ATTEMPTS, least: int = 0, clean: Callable[[Column], Column] = clean_reply) -> DataFrame:
    """(unit_id, attempt, status, final_text) of units with replies (unit_id, attempt from 0, src, reply).

    Attempts count in order: blank replies, echoes, mismatches, errors and short replies go on to the next; a refusal ends
    them with the source, as does passing all; the first valid reply wins. attempt is null where none did. Where replies
    have a column `failure`, what it names is the verdict.
    """
    verdict = status(F.col("src"), F.col("reply"), least=least, clean=clean)
    judged = replies.filter(F.col("attempt") < most).withColumn("status", F.coalesce("failure", verdict) if "failure" in replies.columns else verdict)
    chosen = F.min(F.when(is_final(F.col("status")), F.struct("attempt", "status", "reply"))).alias("c")
    last = F.max_by("status", "attempt").alias("last")
    best = judged.groupBy("unit_id").agg(chosen, last, F.first("src").alias("src"))
    won = F.coalesce(F.col("c.status") == "ok", F.lit(False))
    return best.select("unit_id", F.when(won, F.col("c.attempt")).alias("attempt"), F.coalesce("c.status", "last").alias("status"), F.when(won, clean(F.col("c.reply"))).otherwise(F.col("src")).alias("final_text"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(unit_id, attempt, outcome, reply, truncated, total_tokens) of (unit_id, attempt, status_code, body).

    outcome: http_error (not 200), api_error (an error object or no body), no_choices (none given, or a body that is no JSON), ok.
    """
    schema = "choices array<struct<message:struct<content:string>,finish_reason:string>>, error string, usage struct<total_tokens:long>"
    body = F.from_json("body", schema)
    first = F.get(F.col("b.choices"), F.lit(0))
    outcome = (
        F.when(F.col("status_code") != 200, "http_error").when(F.col("b.error").isNotNull() | F.col("b").isNull(), "api_error").when(first.isNull(), "no_choices").otherwise("ok")
    )
    return responses.withColumn("b", body).select(
        "unit_id", "attempt", outcome.alias("outcome"), strip(first["message"]["content"]).alias("reply"), F.coalesce(first["finish_reason"] == "length", F.lit(False)).alias("truncated"), F.col("b.usage.total_tokens").alias("total_tokens")
    )


def emit_requests(units: DataFrame, model: str, system: str, temperature: float, path: str, keep: list[str] | None = None) -> DataFrame:
    """(unit_id, request) with one chat request as JSON for each unit (unit_id, text), and the columns to keep.

    path sets the limit of tokens: latex two for each character, markdown and group 4096, block 2048, word none. Where
    units have a column `growth`, the limit is multiplied by it.
    """
    limit = {"latex": (2 * F.length("text")).cast("long"), "markdown": F.lit(4096).cast("long"), "group": F.lit(4096).cast("long"), "block": F.lit(2048).cast("long")}.get(path, F.lit(None).cast("long"))
    limit = limit * F.col("growth") if "growth" in units.columns else limit
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fields = [F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col("text"))).alias("messages"), F.lit(float(temperature)).alias("temperature"), limit.alias("max_tokens")]
    if path == "latex":
        fields.append(F.lit(0.9).alias("top_p"))
    return units.select("unit_id", F.to_json(F.struct(*fields)).alias("request"), *(keep or []))
