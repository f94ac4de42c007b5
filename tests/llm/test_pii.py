"""Patterns against plain regular expressions, disclosing terms on a small corpus, edge cases."""

import hashlib
import math
import random
import re
import time

import pytest
from gaugework.llm import pii
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    n = [int(c) for c in digits][::-1]
    return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


PIECES = st.lists(st.sampled_from([
    "a@b.co", "@", "x.y+z@", "@c.d", "1.2.3.4", "256.1.1.1", "00001.2.3.4.5.6.7.8", ".", "4111 1111 1111 1111", "4111-1111-1111-1111", "7",
    "+1 (555) 010-9999", "+", "+49 30 1234567", " ", "-", "\n", "é", "\U0001F600", "word", "..", "b@c..d@e.f",
]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_base_spans_equal_plain_expressions(pieces):
    text = "".join(pieces)
    assert pii.base_spans(text) == plain(text)


def test_very_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "@" * 300_000, "1." * 150_000, "+1" + " " * 300_000):
        pii.base_spans(text)


def corpus():
    rows = [(i, f"plain words number {chr(97 + i % 26)} of the corpus row {i}") for i in range(60)]
    rows += [(100 + i, f"{w} ask zanzibarian about ann@mail.org for {w} today") for i, w in enumerate(["red", "blue", "green", "grey"])]
    rows += [(200, "ann@mail.org wrote elsewhere\nand the zanzibarian answered"), (201, "a zanzibarian alone")]
    return rows


def by_hand(rows, options):
    """All spans of each document, from the definition: windows, contexts, shares, every pair of entity and term."""
    word = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
    near, mentioned, df = {}, {}, {}
    for k, text in rows:
        spans = plain(text)
        words = [(m.start(), m.end(), m[0].casefold()) for m in word.finditer(text)]
        for w in {w for _, _, w in words}:
            df.setdefault(w, set()).add(k)
        words = [w for w in words if all(w[1] <= s or w[0] >= e for s, e, _ in spans)]
        for start, end, kind in spans:
            value = text[start:end]
            names = [f"kind:{kind}"] + ([value.lower(), "owner:" + value.lower().split("@")[1]] if kind == "email" else [re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", value) + kind])
            around = [w for _, e, w in words if e <= start][-options.reach:] + [w for s, _, w in words if s >= end][:options.reach]
            for name in names:
                mentioned.setdefault(name, set()).add(k)
                for w in set(around):
                    if len(w) >= options.min_term and not w.isdigit():
                        near.setdefault((name, w), {}).setdefault(" ".join(around), set()).add(k)
    total, bad = len(rows), {}
    for (name, w), contexts in near.items():
        n = len(mentioned[name])
        both = min(sum(map(len, contexts.values())), len(df[w]), n)
        if len(contexts) >= options.support and n < total and math.log(both * total / (n * len(df[w]))) / math.log(total / n) >= options.generalise:
            for k in set().union(*contexts.values()):
                bad.setdefault(k, set()).add(w)
    out = []
    for k, text in rows:
        spans = plain(text)
        terms = [(m.start(), m.end(), "term") for m in word.finditer(text) if m[0].casefold() in bad.get(k, ()) and all(m.end() <= s or m.start() >= e for s, e, _ in spans)]
        out.append((k, ",".join(f"{x}:{s}:{e}" for s, e, x in sorted(spans + terms, key=lambda s: s[0]))))
    return sorted(out)


def drawn(seed):
    """Documents of common words, with addresses of few owners whose cue words stand near them."""
    draw, rows = random.Random(seed), []
    for i in range(120):
        words = [draw.choice("plain words of the corpus that say little about anyone at all".split()) for _ in range(30)]
        if i % 6 == 0:
            owner = draw.choice(["north.org", "south.net"])
            at = draw.randrange(30)
            words[at:at] = [draw.choice(["Northerner", "clerk"]) if owner == "north.org" else "southpaw", "wrote", f"u{draw.randrange(4)}@{owner}", "\n", "+1 555 010 9999" if i % 12 else "10.0.0.7"]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("limit", [0, 4_000_000])
@pytest.mark.parametrize("rows", [0, 1])
def test_spans_equal_the_definition(documents, limit, rows):
    rows = drawn(5) if rows else corpus()
    options = pii.PiiOptions(broadcast_chars=limit)
    got = sorted((r["doc_id"], r["spans"]) for r in pii.pii_report(documents(rows), options=options).collect())
    assert got == by_hand(rows, options) and any("term" in s for _, s in got)


def test_disclosing_terms(spark, documents):
    out = {r["k"]: r["found"] for r in pii.sanitise(documents(corpus())).collect()}
    spans = list(zip(out[100]["kinds"], out[100]["starts"], out[100]["ends"]))
    assert ("term", 8, 19) in spans and ("email", 26, 38) in spans
    assert "zanzibarian" not in out[100]["clean"] and "ann@" not in out[100]["clean"] and "[EMAIL]" in out[100]["clean"]
    # also on another line of a document that mentions the entity; elsewhere the word stays
    assert "zanzibarian" not in out[200]["clean"]
    assert out[201]["kinds"] == [] and out[201]["clean"] == "a zanzibarian alone"
    assert all(not out[i]["kinds"] for i in range(60))


def test_copies_prove_nothing(documents):
    rows = [(i, "ask zanzibarian about ann@mail.org today") for i in range(20)] + [(100 + i, f"row {i} text") for i in range(40)]
    assert all("term" not in r["found"]["kinds"] for r in pii.sanitise(documents(rows)).collect())


def test_secrets_and_the_word_that_gives_them_away(documents):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(4)]
    rows = [(i, f'{w} text {w} passkey = "{k}" and more {w}') for i, (w, k) in enumerate(zip("abcd", keys))]
    rows += [(10 + i, f"plain text {i} aaaaaaaaaaaaaaaaaaaa1111 and a very-long-compound-word-2020 and {'9' * 40}") for i in range(40)]
    got = {r["doc_id"]: r for r in pii.pii_report(documents(rows)).collect()}
    for i in range(4):
        assert got[i]["n_secret"] == 1 and "secret:20:60" in got[i]["spans"] and "term:9:16" in got[i]["spans"] and got[i]["private"]
        assert got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert not any(got[10 + i]["private"] for i in range(40))


def test_a_hundred_thousand_mentions_take_linear_time():
    took = []
    for n in (10_000, 100_000):
        text = " ".join(f"w{i % 50} a{i}@mail.org other" for i in range(n))
        start = time.perf_counter()
        for _ in pii.contexts(text, pii.PiiOptions()):
            pass
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0]


def test_edges(documents, edge_rows):
    rows = pii.pii_report(documents(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == none and r["spans"] == "" for r in rows)
    assert pii.pii_report(documents([])).collect() == []


def test_counts_and_digest(documents):
    text = "é ann@mail.org 10.0.0.1, 4111 1111 1111 1111 x +1 555 010 9999"
    row = pii.pii_report(documents([(1, text)])).collect()[0]
    base = ",".join(f"{k}:{s}:{e}" for s, e, k in plain(text))
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and row["spans"] == base
