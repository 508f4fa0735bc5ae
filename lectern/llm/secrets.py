"""Secret scan with multipart credential linking.

Base findings come from three fixed patterns over each whole text. Beyond these, parts that are weak on their
own (account names, endpoints, mixed strings) are looked for in every text and reported only when a scope, wherever it
starts, also holds the parts that complete a credential: an access identifier, a secret and, for endpoints and
account names, both of them. A scope never leaves its text, so the intervals of scopes and parts are joined inside the
row, by one sweep over the parts in order: nothing is shuffled, and rows of one id never mix.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The patterns of the base findings, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
# Weak parts. They count only beside parts that complete them.
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:amazonaws|internal|local)\.?[a-z]*(?::[0-9]+)?"
ACCOUNT = r"(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})"
MIXED = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"
#: What a mixed string holds, each at least once.
MIXTURE = ("[A-Z]", "[a-z]", "[0-9]")

KINDS = ("assign", "access", "hex", "mixed", "endpoint", "account")
#: Code points of one scope: parts share one if their starts lie less than this apart.
SCOPE = 512

_FOUND = "array<struct<kind:int,start:int,stop:int>>"
Part = tuple[int, int, int]


def _scanner():
    assign, access = re.compile(ASSIGN), re.compile(ACCESS)
    hexa = re.compile(HEX[:-1] + "{%d,}" % HEX_LEAST)  # the same maximal runs, those that are long enough
    endpoint, account, mixed = re.compile(ENDPOINT), re.compile(ACCOUNT), re.compile(MIXED)
    mixture = [re.compile(x) for x in MIXTURE]

    def scan(text: str) -> tuple[list[Part], list[Part]]:
        found: list[Part] = []
        low = text.lower()
        if any(w in low for w in ("passw", "secret", "token", "api")):
            found += [(0, m.start(), m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(1, m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(2, m.start(), m.end()) for m in hexa.finditer(text)]
        weak = [(3, m.start(), m.end()) for m in mixed.finditer(text) if all(x.search(m[0]) for x in mixture)]
        # each filter is implied by its pattern
        if "://" in text or ".internal" in text or ".local" in text or ".amazonaws" in text:
            weak += [(4, m.start(), m.end()) for m in endpoint.finditer(text)]
        if "user" in low or "login" in low or "account" in low:
            weak += [(5, m.start(), m.end()) for m in account.finditer(text)]
        return found, weak

    return scan


def link_parts(found: list[Part], weak: list[Part], scope: int = SCOPE) -> list[Part]:
    """The weak parts of a text, (kind, start, stop), that complementary parts complete within a scope.

    A scope is any `scope` code points of the text, and holds the parts that start in it. A mixed string needs an access
    identifier; an endpoint needs an access identifier or account name, an account name an access identifier, both
    together with a secret (assignment, hex or mixed string).
    """
    if not weak:
        return []
    parts = sorted(found + weak, key=lambda p: p[1])
    starts = [p[1] for p in parts]
    upto = {n: [0, *accumulate(p[0] in kinds for p in parts)] for n, kinds in (("ident", (1,)), ("secret", (0, 2, 3)), ("account", (5,)))}
    fits: dict[int, list[int]] = {3: [], 4: [], 5: []}  # whether the scope that starts with a part completes a kind
    for at in starts:
        low, high = bisect_left(starts, at), bisect_left(starts, at + scope)
        ident, secret, account = (upto[n][high] > upto[n][low] for n in ("ident", "secret", "account"))
        fits[3].append(ident)
        fits[4].append(secret and (ident or account))
        fits[5].append(secret and ident)
    total = {k: [0, *accumulate(v)] for k, v in fits.items()}
    return [p for p in weak if total[p[0]][bisect_right(starts, p[1])] > total[p[0]][bisect_right(starts, p[1] - scope)]]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, linked) of each row: base findings and completed weak parts of its whole text.

    Both are arrays of (kind, start, stop) in code points, kinds as positions in KINDS, and empty for null, empty or
    clean texts. Each row stands for itself: ids may be null or repeated.
    """
    part = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner()
        laid = lambda parts: [{"kind": k, "start": a, "stop": b} for k, a, b in parts]
        for batch in batches:
            base, linked = [], []
            for text in batch.column(1).to_pylist():
                found, weak = scan(text or "")
                base.append(laid(found))
                linked.append(laid(link_parts(found, weak, scope)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, part), pa.array(linked, part)], ["id", "base", "linked"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, base {_FOUND}, linked {_FOUND}")


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["stop"]))),
            lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"]),
        ),
        ",",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The columns that the query returns, derived from what the scan found."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
