"""Chat formatting: conversations through a template into texts, with the spans that a model learns from.

A template is parsed into a tree of tuples, what is constant in it is worked out, and each node becomes a Python closure;
the closures of statements are generators, so a conversation runs through them row by row, whatever its length. The
language is a sandbox: {{ value }}, {% if %} {% elif %} {% else %} {% endif %}, {% set name = value %}, {% generation %}
{% endgeneration %} (what the model learns), {# notes #} and one {% for m in messages %} {% endfor %} with `loop` (index0,
index, first, last). Values are texts, numbers, true, false, none, names, fields of a row or of loop, and what and, or, not,
==, !=, <, <=, >, >=, in, +, ~, `a if b else c` and the filters of FILTERS make of them. Nothing is called or looked up
otherwise, and nothing repeats but the one loop, so a template ends and its output is bounded by its input.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns; texts that hold one are escaped.
CONTROLS = (OPEN, CLOSE)
CHATML = (
    "{% for m in messages %}" + OPEN + "{{ m.role | line | guard }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}" + CLOSE + "\n{% endfor %}"
    "{% if add_generation_prompt %}" + OPEN + "assistant\n{% endif %}"
)
#: Characters after which a conversation goes on in another row, and of the texts of one Arrow batch.
PART, BATCH = 1 << 22, 1 << 24
_BEGIN, _END = object(), object()  # of what the model learns, among the pieces of an output

# -- escapes


def _forms(controls: tuple[str, ...]) -> re.Pattern:
    """Control strings with any number of backslashes behind their first character."""
    first = {c[:1] for c in controls}
    if not controls or "" in first or "\\" in first or any(f in c[1:] for f in first for c in controls) or any(len(c) < 2 or c[1] == "\\" for c in controls):
        raise ValueError(f"control strings need two characters and may not hold the first of another behind their own: {controls}")
    return re.compile("|".join(f"{re.escape(c[0])}(?P<s{k}>\\\\*)(?={re.escape(c[1:])})" for k, c in enumerate(controls)))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """A text without control strings: each gets a backslash behind its first character, one that has some gets another."""
    return _forms(controls).sub(lambda m: m[0] + "\\", text)


def unescape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """The text that was escaped."""
    return _forms(controls).sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], text)


def one_line(text: str) -> str:
    """A text without line feeds, from which the text can be had back."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def shown(value) -> str:
    """A value as text; none is empty."""
    return value if isinstance(value, str) else "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


#: Filters by name; `guard` is added with the control strings of a template.
FILTERS: dict[str, Callable] = {"trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": lambda x: len(shown(x)), "line": lambda x: one_line(shown(x))}

# -- parsing

_TAG = re.compile(r"\{\{-?(?P<value>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-<>+~|.()\[\]=]))""", re.DOTALL)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: isinstance(b, str) and shown(a) in b}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Values:
    """Parser of the values in a tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if m is None:
                raise ValueError(f"not understood: {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        """The next token, if it is one of the signs or words wanted."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign!r} is missing")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or text in _WORDS:
            raise ValueError(f"a name is missing before {text!r}")
        self.at += 1
        return text

    def whole(self) -> tuple:
        made = self.choice()
        if self.at < len(self.tokens):
            raise ValueError(f"not understood: {self.tokens[self.at][1]!r}")
        return made

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return ("choice", condition, value, self.choice())
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = ("compare", sign, left, self.joined())
            elif self.take("not"):
                self.need("in")
                left = ("not", ("compare", "in", left, self.joined()))
            else:
                return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.take("+", "~"):
            left = ("join", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.part()
        while True:
            if self.take("|"):
                value = ("filter", self.name(), value)
            elif self.take("."):
                value = ("field", value, self.name())
            elif self.take("["):
                key = self.choice()
                self.need("]")
                if key[0] != "is" or not isinstance(key[1], str):
                    raise ValueError("a field is named by a text")
                value = ("field", value, key[1])
            else:
                return value

    def part(self) -> tuple:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if word := self.take("true", "false", "none"):
            return ("is", {"true": True, "false": False, "none": None}[word])
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind in ("text", "number"):
            self.at += 1
            return ("is", int(text) if kind == "number" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        return ("name", self.name())


def parse(template: str) -> list[tuple]:
    """The tree of a template: ("put", value), ("set", name, value), ("for", name, body), ("if", condition, body, rest), ("learn", body)."""
    bits, at = [], 0
    for m in _TAG.finditer(template):
        before = template[at : m.start()]
        bits.append(("text", before.rstrip() if m[0][2:3] == "-" else before))
        bits.append(("value", m["value"]) if m["value"] is not None else ("tag", m["tag"].strip()) if m["tag"] is not None else ("text", ""))
        at = m.end()
        if m[0][-3:-2] == "-":
            at += len(template[at:]) - len(template[at:].lstrip())
    bits.append(("text", template[at:]))
    bits.reverse()

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str, str]:
        """Nodes up to a tag that ends them, its first word and the rest of it."""
        made: list[tuple] = []
        while bits:
            kind, source = bits.pop()
            if kind == "text":
                made.append(("put", ("is", source)))
            elif kind == "value":
                made.append(("put", _Values(source).whole()))
            else:
                word, _, rest = source.partition(" ")
                if word in ends:
                    return made, word, rest
                made.append(tag(word, rest))
        if ends:
            raise ValueError(f"{ends[-1]} is missing")
        return made, "", ""

    def branches(condition: str) -> tuple:
        inside, word, rest = body(("elif", "else", "endif"))
        other = [branches(rest)] if word == "elif" else body(("endif",))[0] if word == "else" else []
        return ("if", _Values(condition).whole(), inside, other)

    def tag(word: str, rest: str) -> tuple:
        if word == "if":
            return branches(rest)
        if word == "generation":
            return ("learn", body(("endgeneration",))[0])
        values = _Values(rest)
        if word == "set":
            name = values.name()
            values.need("=")
            return ("set", name, values.whole())
        if word == "for":
            name = values.name()
            values.need("in")
            if values.whole() != ("name", "messages"):
                raise ValueError("a loop runs over messages")
            return ("for", name, body(("endfor",))[0])
        raise ValueError(f"unknown tag: {word!r}")

    return body(())[0]


# -- constants and closures


class Template:
    """A template as closures; `constants` are names with values known beforehand."""

    def __init__(self, source: str = CHATML, controls: tuple[str, ...] = CONTROLS, constants: dict | None = None):
        forms = _forms(controls)
        self.filters = FILTERS | {"guard": lambda x: forms.sub(lambda m: m[0] + "\\", shown(x))}
        tree = parse(source)
        self.known = {k: v for k, v in (constants or {}).items() if k not in self.named(tree)}
        self.loops = 0
        self.tree = self.fold_body(tree)
        self.steps = self.body(self.tree, frozenset())

    def named(self, nodes: list[tuple]) -> set[str]:
        """Names that a tree gives values to."""
        out = set()
        for node in nodes:
            out |= {node[1]} if node[0] in ("set", "for") else set()
            out |= {"loop"} if node[0] == "for" else set()
            for part in node[1:]:
                out |= self.named(part) if isinstance(part, list) else set()
        return out

    def fold(self, value: tuple) -> tuple:
        """A value with its constant parts worked out."""
        kind = value[0]
        if kind == "name" and value[1] in self.known:
            return ("is", self.known[value[1]])
        if kind in ("is", "name"):
            return value
        value = (kind, *(self.fold(x) if isinstance(x, tuple) else x for x in value[1:]))
        if kind in ("choice", "and", "or") and value[1][0] == "is":
            truth = bool(value[1][1])
            return (value[2] if truth else value[3]) if kind == "choice" else value[2] if truth == (kind == "and") else value[1]
        if all(x[0] == "is" for x in value[1:] if isinstance(x, tuple)):
            return ("is", self.closure(value, frozenset())({}))
        return value

    def fold_body(self, nodes: list[tuple]) -> list[tuple]:
        """Nodes with constants worked out: decided branches gone, texts side by side joined, empty ones left out."""
        out: list[tuple] = []
        for node in nodes:
            node = (node[0], *(self.fold_body(x) if isinstance(x, list) else self.fold(x) if isinstance(x, tuple) else x for x in node[1:]))
            if node[0] == "if" and node[1][0] == "is":
                found = node[2] if node[1][1] else node[3]
            else:
                found = [("put", ("is", shown(node[1][1])))] if node[0] == "put" and node[1][0] == "is" else [node]
            for new in found:
                if out and new[0] == out[-1][0] == "put" and new[1][0] == out[-1][1][0] == "is":
                    new = ("put", ("is", out.pop()[1][1] + new[1][1]))
                out.append(new)
        return [x for x in out if x != ("put", ("is", ""))]

    def closure(self, value: tuple, names: frozenset[str]) -> Callable:
        """A value as a function of the names that have values where it stands."""
        kind = value[0]
        if kind == "is":
            return lambda _, x=value[1]: x
        if kind == "name":
            if value[1] not in names:
                raise ValueError(f"{value[1]!r} has no value here")
            return operator.itemgetter(value[1])
        parts = [self.closure(x, names) for x in value[1:] if isinstance(x, tuple)]
        if kind == "field":
            whole, key = parts[0], value[2]
            return lambda s: x.get(key) if isinstance(x := whole(s), dict) else None
        if kind == "filter":
            if value[1] not in self.filters:
                raise ValueError(f"unknown filter: {value[1]!r}")
            return lambda s, f=self.filters[value[1]], x=parts[0]: f(x(s))
        if kind == "not":
            return lambda s, x=parts[0]: not x(s)
        if kind == "choice":
            test, yes, no = parts
            return lambda s: yes(s) if test(s) else no(s)
        left, right = parts
        if kind == "and":
            return lambda s: left(s) and right(s)
        if kind == "or":
            return lambda s: left(s) or right(s)
        if kind == "join":
            return lambda s: shown(left(s)) + shown(right(s))
        compare = _COMPARE[value[1]]

        def compared(s):
            a, b = left(s), right(s)
            return compare(a, b) if value[1] in ("==", "!=", "in") or isinstance(a, str) == isinstance(b, str) and a is not None and b is not None else False

        return compared

    def body(self, nodes: list[tuple], names: frozenset[str]) -> Callable:
        """Nodes as a generator of the pieces that they put out."""
        steps = []
        for node in nodes:
            steps.append(self.step(node, names))
            names = names | self.named([node]) if node[0] == "set" else names

        def run(scope: dict) -> Iterator:
            for step in steps:
                yield from step(scope)

        return run

    def step(self, node: tuple, names: frozenset[str]) -> Callable:
        kind = node[0]
        if kind == "put":
            value = self.closure(node[1], names)
            return lambda s: (shown(value(s)),)
        if kind == "set":
            value = self.closure(node[2], names)
            return lambda s: s.__setitem__(node[1], value(s)) or ()
        if kind == "if":
            test, yes, no = self.closure(node[1], names), self.body(node[2], names), self.body(node[3], names)
            return lambda s: yes(s) if test(s) else no(s)
        if kind == "learn":
            inside = self.body(node[1], names)

            def learn(scope: dict) -> Iterator:
                yield _BEGIN
                yield from inside(scope)
                yield _END

            return learn
        self.loops += 1
        if self.loops > 1:
            raise ValueError("a template has one loop")
        inside = self.body(node[2], names | {node[1], "loop"})

        def loop(scope: dict) -> Iterator:
            rows, scope = iter(scope["messages"]), dict(scope)
            row, k = next(rows, None), 0
            while row is not None:
                ahead = next(rows, None)
                scope[node[1]], scope["loop"] = row, {"index0": k, "index": k + 1, "first": not k, "last": ahead is None}
                yield from inside(scope)
                row, k = ahead, k + 1

        return loop

    def render(self, messages: Iterable[dict], part: int = PART) -> Iterator[tuple[str, list[dict]]]:
        """(text, spans) of a conversation, in parts of at least `part` characters but for the last.

        Spans (start, stop) are what the model learns, in code points of the whole text; no part ends inside one. Spans
        inside others count as part of these. An empty conversation without output has no part.
        """
        pieces, spans, at, begun, depth, size = [], [], 0, 0, 0, 0
        for piece in self.steps({"messages": messages}):
            if piece is _BEGIN:
                begun = at if not depth else begun
                depth += 1
            elif piece is _END:
                depth -= 1
                if not depth:
                    spans.append({"start": begun, "stop": at})
            else:
                pieces.append(piece)
                at += len(piece)
                size += len(piece)
            if size >= part and not depth:
                yield "".join(pieces), spans
                pieces, spans, size = [], [], 0
        if pieces:
            yield "".join(pieces), spans


# -- jobs


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the text at place `weight` of a row is what makes it heavy."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[weight] or "")
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(
    rows: DataFrame, template: str = CHATML, controls: tuple[str, ...] = CONTROLS, constants: dict | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART,
) -> DataFrame:
    """(conv_id, part_no, text, spans) of conversations whose rows are turns; spans (start, stop) in code points of the whole
    output are what the model learns.

    Turns of one number are taken by role, then text; null turns come first. Null roles and texts are empty. Rows without
    an id are one conversation. Rows that repeat count as often as they come. An empty table gives no rows; other columns
    are left out. A conversation is one text, so its rows pass through one task, sorted and row by row; an output of more
    than `part` characters goes on in further rows, so a conversation of any length is held in bounded memory.
    """
    made = (template, controls, {"add_generation_prompt": False} | (constants or {}))
    Template(*made)  # what is wrong with it shows here; tasks make their closures themselves
    kind = rows.schema[id_col].dataType.simpleString()
    order = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        compiled = Template(*made)

        def parts() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(_chain(first, batches)), key=lambda r: r[0]):
                for k, (text, spans) in enumerate(compiled.render(({"role": r[2], "text": r[3]} for r in turns), part)):
                    yield conv, k, text, spans

        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield from _batches(parts(), pa.schema([("conv_id", first.schema.field(0).type), ("part_no", pa.int32()), ("text", pa.string()), ("spans", span)]), 2)

    dealt = order.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, part_no int, text string, spans array<struct<start:long,stop:long>>")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def read_turns(parts: Iterable[tuple[str, list[dict]]], controls: tuple[str, ...] = CONTROLS) -> Iterator[tuple[str, str, str | None, int]]:
    """(role, text, learned, chars) of each turn of a conversation given as its parts (text, spans): what stands between the
    control strings, unescaped; what the model learns of it, null if nothing; code points of the turn with its marks."""
    held, base, spans = "", 0, []
    forms = _forms(controls)
    plain = lambda x: forms.sub(lambda m: m[0][:-1] if len(m[0]) > 1 else m[0], x)
    start, stop = controls[0], controls[1] + "\n"
    for more, found in parts:
        held += more
        spans += [(x["start"], x["stop"]) for x in found]
        at, k = 0, 0
        while (end := held.find(stop, at)) >= 0:
            if not held.startswith(start, at) or (line := held.find("\n", at, end)) < 0:
                raise ValueError(f"no turn begins at {base + at}")
            upto, learned = end + len(stop), None
            while k < len(spans) and spans[k][1] <= base + upto:
                learned = (learned or "") + plain(held[spans[k][0] - base : spans[k][1] - base])
                k += 1
            yield many_lines(plain(held[at + len(start) : line])), plain(held[line + 1 : end]), learned, upto - at
            at = upto
        held, base, spans = held[at:], base + at, spans[k:]


def read_back(parts: DataFrame, controls: tuple[str, ...] = CONTROLS, together: bool = False) -> DataFrame:
    """(conv_id, turn_no, role, text, learned, chars) of the turns in formatted conversations (conv_id, part_no, text, spans) of
    CHATML's form. together: parts of a conversation stand side by side and in order, as format_conversations leaves them."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def turns() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(_chain(first, batches)), key=lambda r: r[0]):
                for k, (role, text, learned, chars) in enumerate(read_turns(((r[1], r[2]) for r in rows), controls)):
                    yield conv, k, role, text, learned, chars

        schema = pa.schema([("conv_id", first.schema.field(0).type), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learned", pa.string()), ("chars", pa.int64())])
        yield from _batches(turns(), schema, 3)

    laid = parts if together else parts.repartition("conv_id").sortWithinPartitions("conv_id", "part_no")
    return laid.select("conv_id", "text", "spans").mapInArrow(run, f"conv_id {kind}, turn_no long, role string, text string, learned string, chars long")


def digest(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of turns read back, those of a conversation side by
    side and in order: digests of role, line feed, text and line feed of every turn, and of all that the model learns."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def sums() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(_chain(first, batches)), key=lambda r: r[0]):
                n = chars = loss = 0
                said, learns = hashlib.sha256(), hashlib.sha256()
                for _, role, text, learned, size in rows:
                    said.update(f"{role}\n{text}\n".encode())
                    learns.update((learned or "").encode())
                    n, loss, chars = n + 1, loss + len(learned or ""), chars + size
                yield conv, n, said.hexdigest(), loss, learns.hexdigest(), chars

        schema = pa.schema([("conv_id", first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        yield from _batches(sums(), schema, 2)

    return turns.select("conv_id", "role", "text", "learned", "chars").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
