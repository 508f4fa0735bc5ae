"""Fill-in-middle, chat formatting and spelling variants against plain versions, and their cases at the edge."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lectern.llm import chat, middle, spelling
from lectern.llm import html as pages_text

# -- fill in middle


def plain_infill(name: str, text: str) -> tuple:
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(tokens) == text
    seeds = hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h = [int(seeds[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**6), st.text(alphabet="ab <>PSM\n\t\x0b\u00a0é𝄞", max_size=60))
def test_cut_as_written_down_and_restored(name, text):
    made = middle.cut_text(str(name), text)
    assert made == plain_infill(str(name), text)
    assert middle.whole_text(made[4], made[1]) == text


def test_marks_that_could_be_misread_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "cc"), ("", "<S>", "<M>"), ("<P>", "x<P>", "<M>")):
        with pytest.raises(ValueError):
            middle._checked(marks)


def test_infill_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (None, "a b c"), (5, " \n\t "), (7, "x" * 300_000 + " y" * 200_000), (8, "has <M> in it")] + [(k, f"words of {k} here") for k in range(20, 60)]
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], "doc_id long, text string, form string, output string, n int")
    got = sorted(map(tuple, middle.infill(docs).collect()), key=str)
    assert got == sorted([(i, *plain_infill("" if i is None else str(i), t or "")) for i, t in rows], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for r in middle.digest(middle.infill(docs)).collect():
        assert r["restored_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r["doc_id"]}
    assert middle.infill(docs.limit(0)).count() == 0
    named = middle.infill(docs.selectExpr("concat('d', doc_id) key", "text body").filter("key is not null"), id_col="key", text_col="body")
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(rows) - 1


# -- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", chat.OPEN, ""]), st.lists(st.sampled_from([chat.OPEN, chat.CLOSE, "<\\|im_end|>", "<\\\\|im_start|>", "<|", "|im_end|>", "<", "\\", "\n", "a", "é𝄞"]), max_size=6).map("".join)), max_size=6), st.sampled_from([1, 20, 1000]))
def test_turns_come_back_and_the_mask_holds_the_replies(turns, part):
    parts = list(chat.Template(constants={"add_generation_prompt": False}).render(({"role": r, "text": t} for r, t in turns), part))
    back = list(chat.read_turns(iter(parts)))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [x for *_, x, _ in back if x is not None] == [t for r, t in turns if r == "assistant"]
    whole = "".join(t for t, _ in parts)
    assert sum(c for *_, c in back) == len(whole) == sum(len(chat.escape(chat.one_line(r))) + len(chat.escape(t)) + 24 for r, t in turns)
    assert [chat.unescape(whole[s["start"] : s["stop"]]) for _, spans in parts for s in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "<|im_end|>", "|im_end|>", "\\", "<|im_start|>", "im", "\n"]), max_size=10).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and chat.OPEN not in safe and chat.CLOSE not in safe
    assert chat.many_lines(chat.one_line(text)) == text and "\n" not in chat.one_line(text)


def rendered(source: str, rows=(("user", "hi"), ("assistant", "yo")), **constants) -> str:
    return "".join(t for t, _ in chat.Template(source, constants=constants).render({"role": r, "text": t} for r, t in rows))


def test_the_language():
    assert rendered("{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}{% if loop.last %}!{% elif loop.first %}?{% endif %}{% endfor %}") == "1USER?2ASSISTANT!"
    assert rendered("a {{- 'b' + \"\\n\" ~ 3 -}} c") == "ab\n3c"
    assert rendered("{% set x = 2 %}{{ x if x > 1 and not false else 'no' }}{# gone #}") == "2"
    assert rendered("{% for m in messages %}{{ m.text | length }}{{ m.missing }}{{ 'h' in m.text }}{{ 'h' not in m.text }}{% endfor %}") == "2truefalse2falsetrue"
    assert rendered("{{ bos }}{% if tools or none %}T{% else %}N{% endif %}", bos="<s>", tools=False) == "<s>N"
    assert rendered("{{ '1' < 2 }}{{ 1 <= 1 }}") == "falsetrue"


def test_constants_are_folded():
    made = chat.Template("{{ bos }}x{% if flag and 'a' == 'a' %}y{{ 'z' | upper }}{% else %}{{ 'never' }}{% endif %}{{ 'q' if flag else 'r' }}", constants={"bos": "<s>", "flag": True})
    assert made.tree == [("put", ("is", "<s>xyZq"))]
    assert [n[0] for n in chat.Template(chat.CHATML, constants={"add_generation_prompt": False}).tree] == ["for"]


@pytest.mark.parametrize("source", ["{{ unknown }}", "{{ m.text }}", "{{ 'a' | unknown }}", "{% for m in others %}{% endfor %}", "{% if true %}", "{% while true %}", "{{ f() }}", "{{ 'a' . }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{{ [1] }}", "{{ 'a' 'b' }}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(ValueError):
        chat.Template(source)


def test_fields_are_never_attributes():
    assert rendered("{% for m in messages %}{{ m.__class__ }}{{ m.text.__class__ }}{{ m.items }}{% endfor %}") == ""


def test_controls_that_could_be_misread_are_refused():
    for controls in ((), ("",), ("a",), ("aba",), ("ab", "ca"), ("\\x",), ("<\\x",)):
        with pytest.raises(ValueError):
            chat.escape("x", controls)


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, None, "system", ""), (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"),
            (4, 0, "user", "long " * 200_000), (4, 1, "assistant", f"{chat.CLOSE}\n{chat.OPEN}user\n" * 5_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, spans string, part_no int")
    made = chat.format_conversations(table, part=100_000)
    assert made.groupBy("conv_id").count().filter("conv_id = 4").first()["count"] > 1
    want: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    for turns in (chat.read_back(made, together=True), chat.read_back(made.repartition(3))):
        got: dict = {}
        for r in sorted(turns.collect(), key=lambda r: r["turn_no"]):
            got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert got == want
    for r in chat.digest(chat.read_back(made, together=True)).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.escape(a)) + len(chat.escape(b)) + 24 for a, b in turns)
    assert chat.digest(chat.read_back(chat.format_conversations(table.limit(0)), together=True)).count() == 0


# -- pages


def test_captions_belong_to_the_article(spark):
    body = "Some words of the article, with commas, and more of them. " * 5
    page = f"<html><body><nav><a href='x'>Menu</a></nav><main><p>{body}</p><figure><img src='a'><figcaption>Cap text</figcaption></figure><p>{body}</p></main><aside>Side</aside></body></html>"
    rows = [(1, "u", page), (2, "u", "<main><p>Short.</p><figure><figcaption>Only &amp; caption</figcaption></figure></main>"), (3, "u", None)]
    got = {r["page_id"]: r["text"] for r in pages_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"{body.strip()}\nCap text\n{body.strip()}" and "Only & caption" in got[2] and got[3] == ""


# -- spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs: list[tuple], noise: int | None, chars: int = 6, least: int = 5, ratio: int = 5) -> dict:
    counts: Counter = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if name is None else name}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= chars and n >= least}
    out, forms = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(found), words[best] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=7))
def test_the_whole_neighbourhood_once(word):
    alphabet = np.array(sorted(map(ord, "abé")), np.uint32)
    got = [s for _, strings in spelling.neighbourhood(np.array([word], object), alphabet) for s in strings]
    letters, n = "abé", len(word)
    want = {word[:k] + word[k + 1 :] for k in range(n)} | {word[:k] + c + word[k + 1 :] for k in range(n) for c in letters} | {word[:k] + c + word[k:] for k in range(n + 1) for c in letters}
    assert len(got) == len(set(got)) and set(got) == want - {word}


def test_the_filter_holds_no_word_back():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(4, 9))) for _ in range(400)})
    bits = np.zeros(1 << 13, np.uint8)
    at = spelling.places(words, 1 << 16)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    for size in {len(w) for w in words}:
        same = np.array([w for w in words if len(w) == size], object)
        pairs = {(same[r], s) for rows, strings in spelling.neighbourhood(same, alphabet, bits) for r, s in zip(rows, strings)}
        assert {(a, b) for a in same for b in words if near(a, b)} <= pairs
        loose = {(same[r], s) for rows, strings in spelling.neighbourhood(same, alphabet) for r, s in zip(rows, strings)}
        assert pairs <= loose and len(pairs) < len(loose) / 3


def test_variants_against_all_pairs(spark):
    rng, docs = np.random.default_rng(7), []
    base = ["".join(rng.choice(list("abcdéü"), rng.integers(5, 9))) for _ in range(60)]
    weights = 1 / np.arange(1, 61) ** 1.3
    for k in range(120):
        words = []
        for w in rng.choice(base, 60, p=weights / weights.sum()):
            if rng.random() < 0.25:
                at = rng.integers(len(w))
                w = [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "É" + w[at + 1 :]][rng.integers(3)]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((k, "-".join(words)))
    docs += [(500, None), (501, ""), (None, "abcdef " * 7), (502, "abcdef " * 40), (502, "abcdef " * 40), (503, "abcdeg " * 3 + "÷×÷×÷× " * 6), (504, "zzzzzzzz" * 20_000), (505, "aabbcc " * 5 + "aabbcd " * 30 + "aabbdd " * 200)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string")
    for noise in (None, 5):
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table, noise=noise).collect()}
        assert got == plain_variants(docs, noise)
        assert any(x[0] for x in got.values())
        assert noise or got["aabbcc"][:2] == ("aabbcd", "aabbdd")
    assert spelling.variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(table, ratio=1)


def test_long_chains_of_forms_end_at_their_roots(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("v", "w30")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links).collect()} == {f"w{k}": "w37" for k in range(37)} | {"v": "w37"}
