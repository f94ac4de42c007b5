"""Chunks against a plain reading of the rule; shifts, collisions and edge cases."""

import hashlib
import random

from gaugework.llm import line_dedup
from pyspark.sql import functions as F


def chunk_starts(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) % 2147483647 for x in lines]
    r = [(v * 65599 + (h[i - 1] if i else 0)) % 2147483647 for i, v in enumerate(h)]
    return [0] + [i for i in range(1, len(r) - 1) if r[i] < r[i - 1] and r[i] < r[i + 1]]


def plain(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        starts = chunk_starts(lines) + [len(lines)]
        kept = []
        for a, b in zip(starts, starts[1:]):
            body = "\n".join(lines[a:b])
            if b - a >= 2 and body.strip() and body in seen:
                continue
            if b - a >= 2:
                seen.add(body)
            kept += lines[a:b]
        out[key] = "\n".join(kept)
    return out


def corpus():
    draw = random.Random(3)
    shared = [[f"shared {p} line {i}" for i in range(14)] for p in range(3)]
    rows = []
    for d in range(25):
        lines = [f"own {d} {i} {draw.random()}" for i in range(draw.randrange(6))]
        if d % 2:
            lines += shared[d % 3]
        lines += [f"tail {d} {i}" for i in range(draw.randrange(5))] + (["", "  ", "same"] * (d % 4))
        rows.append((d, "\n".join(lines)))
    return rows + [(90, rows[1][1]), (91, rows[1][1])]


def test_equals_a_plain_reading(documents):
    rows = corpus()
    want = plain(rows)
    got = line_dedup.deduplicated(documents(rows))
    assert got.columns[:-1] == documents(rows).columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert sum(len(t) for t in want.values()) < 0.6 * sum(len(t) for _, t in rows)


def test_an_insertion_moves_only_the_boundaries_beside_it():
    lines = [f"line {i} of a text" for i in range(60)]
    before = {tuple(lines[a:b]) for a, b in zip(chunk_starts(lines), chunk_starts(lines)[1:])}
    more = lines[:30] + ["an inserted line"] + lines[30:]
    after = {tuple(more[a:b]) for a, b in zip(chunk_starts(more), chunk_starts(more)[1:])}
    assert len(before - after) <= 3


def test_colliding_hashes_are_told_apart(spark, documents, monkeypatch):
    rows = [(i, f"first {i % 3}\nsecond {i % 3}") for i in range(9)]
    real = F.xxhash64
    # chunk hashes all collide; text marks stay
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long") if isinstance(c[0], str) and c[0] == "body" else real(*c))
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_chunks(documents(rows)).collect()}
    assert got == {i: rows[i][1] for i in range(3)}


def test_edges(documents, edge_rows):
    rows = line_dedup.removal_report(documents(edge_rows)).collect()
    assert len(rows) == len(edge_rows) and not any(r["n_removed_lines"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["kept_sha256"] is None and by[1]["n_lines"] == 0
    assert by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by[2]["n_lines"] == 1
    assert line_dedup.removal_report(documents([])).collect() == []
    kept = line_dedup.without_repeated_chunks(documents(edge_rows))
    assert kept.columns == documents([]).columns and kept.count() == len(edge_rows)


def test_null_keys_come_first_and_native_plan(documents):
    rows = [(5, f"{A}\n{B}"), (None, f"{A}\n{B}"), (7, f"{A}\n{B}")]
    out = line_dedup.without_repeated_chunks(documents(rows))
    assert [r["doc_id"] for r in out.collect()] == [None]
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))


def plain_whole(rows):
    """Every two neighbouring lines of eight words or more that occurred before go, and the empty lines between lines that go."""
    first, out = {}, {}
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        worded = [i for i, x in enumerate(lines) if x.strip()]
        for i, j in zip(worded, worded[1:]):
            pair = lines[i], lines[j]
            if len(" ".join(pair).split()) < line_dedup.PAIR_WORDS:
                continue
            origin = first.setdefault(pair, (key, i, j))
            if origin != (key, i, j):
                gone |= {j} if origin[0] == key and origin[2] == i else {i, j}
        order = sorted(gone)
        for a, b in zip(order, order[1:]):
            if not "".join(lines[a + 1:b]).strip():
                gone |= set(range(a, b))
        left = [x for i, x in enumerate(lines) if i not in gone]
        if not gone or "".join(left).strip():
            out[key] = "\n".join(left)
    return out


X, A, B, U, V = (f"{c} line of five words" for c in "xabuv")


def test_headings_braces_and_short_items_stay(documents):
    rows = [(1, "Introduction\n\nalpha beta gamma"), (2, "Introduction\n\ndelta epsilon"), (3, "f {\n  a\n}\n\n"), (4, "g {\n  b\n}\n\n"),
            (5, "- one\n- two\n- three"), (6, "- one\n- two\n- four")]
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(documents(rows)).collect()} == dict(rows)


def test_whole_repeats_go_with_both_ends(documents):
    draw = random.Random(5)
    shared = [[f"a short line {p} {i}" for i in range(2 + p % 3)] for p in range(9)]
    rows = corpus() + [
        (200 + d, "\n".join([f"head {d} {draw.random()}", *shared[d % 9], f"tail {d} {draw.random()}"])) for d in range(27)
    ] + [
        (300, "\n".join([X, X, X, X, "y"])), (301, f"{A}\n\n\n\n{B}\nc"), (302, f"{A}\n\n\n\n{B}\nc"), (303, f"{U}\n{V}\n{U}\n{V}\n{U}\n{V}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(documents(rows)).collect()}
    assert got == plain_whole(rows)
    assert all(got[200 + d].count("\n") == 1 for d in range(9, 27))  # two to four lines: nothing of the repeat stays
    assert got[300] == f"{X}\n{X}\ny" and got[302] == "c" and got[303] == f"{U}\n{V}"
    chunks = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_chunks(documents(rows)).collect()}
    assert sum(len(t) for t in got.values()) < sum(len(t) for t in chunks.values())


def test_whole_edges(documents, edge_rows):
    kept = line_dedup.without_repeated_lines(documents(edge_rows))
    assert kept.columns == documents([]).columns and kept.count() == len(edge_rows)
    assert line_dedup.without_repeated_lines(documents([])).collect() == []
    rows = [(5, f"{A}\n{B}"), (None, f"{A}\n{B}"), (7, f"{A}\n{B}")]
    out = line_dedup.without_repeated_lines(documents(rows))
    assert [r["doc_id"] for r in out.collect()] == [None]
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))
