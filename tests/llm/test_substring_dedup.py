import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gaugework.llm import substring_dedup as s


def plain(rows):
    """Per row: words, removed words and the digest of the rest, by counting every window."""
    words = [s.words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for p in range(i, i + 35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(7)
    own = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    passages = [own(n) for n in (34, 35, 36, 60, 150)]
    rows = []
    for i in range(60):
        words = own(draw.randrange(90))
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            a = draw.randrange(max(1, len(p) - 34))
            words += p[a:] + own(draw.randrange(20))
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[3][1]) for i in range(4)]  # exact copies
    near = rows[3][1].split() + own(100)
    for i in range(12):  # near copies, each with another word changed
        w = list(near)
        w[(i * 17) % len(w)] = f"changed{i}"
        rows.append((200 + i, " ".join(w)))
    rows.append((300, " ".join(["again"] * 90)))  # a window that overlaps itself
    rows.append((301, "a b c d e " * 12 + "x"))
    return rows


@pytest.mark.parametrize("hot, shard", [(4_000, 400_000), (4_000, 300), (2, 400_000), (1, 300)])
def test_equals_counting_every_window(documents, monkeypatch, hot, shard):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "SHARD_WORDS", shard)
    rows = corpus()
    got = sorted((tuple(r) for r in s.removal_report(documents(rows)).collect()), key=str)
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 1000


def test_index_counts_like_a_plain_search():
    draw = random.Random(2)
    rows = [[str(draw.randrange(3)).encode() for _ in range(draw.randrange(35, 60))] for _ in range(20)]
    for i in range(10):
        rows.append(rows[i][:40] if i % 2 else rows[i][3:])
    rows = [r for r in rows if len(r) >= 35]
    index = s.FmIndex(rows, np.ones(len(rows), np.int64))
    seen = Counter(tuple(r[i:i + 35]) for r in rows for i in range(len(r) - 34))
    got = {(q, i) for q, a, b in index.matches(np.arange(len(rows))) for i in range(a, b - 34)}
    assert got == {(q, i) for q, r in enumerate(rows) for i in range(len(r) - 34) if seen[tuple(r[i:i + 35])] > 1}


def test_wavelet_rank():
    symbols = np.array([3, 0, 2, 3, 1, 3, 0, 7], np.int64)
    tree = s.WaveletMatrix(symbols)
    for c in range(8):
        q = np.full(9, c)
        got = tree.rank(q, np.arange(9), tree.last_row(q))
        assert got.tolist() == [int((symbols[:i] == c).sum()) for i in range(9)]


def test_equal_windows_have_equal_anchors():
    draw = random.Random(1)
    passage = [f"p{draw.randrange(50)}".encode() for _ in range(80)]
    anchors = []
    for n in (0, 13, 200):
        words = [f"o{draw.randrange(50)}".encode() for _ in range(n)] + passage
        a, _, first, count = s.segments(words)
        of = np.repeat(a, count)
        assert len(of) == len(words) - 34 and (first == np.concatenate([[0], np.cumsum(count)[:-1]])).all()
        anchors.append(of[n:].tolist())
    assert anchors[0] == anchors[1] == anchors[2]


def test_edges(documents, edge_rows):
    got = sorted((tuple(r) for r in s.removal_report(documents(edge_rows)).collect()), key=str)
    assert got == plain([(r[0], r[1]) for r in edge_rows])
    assert s.removal_report(documents([])).collect() == []
    twice = [(1, " ".join(f"v{i}" for i in range(40)))] * 2 + [(None, " ".join(f"v{i}" for i in range(40)) + " x")]
    got = sorted((tuple(r) for r in s.removal_report(documents(twice)).collect()), key=str)
    assert got == plain(twice)
    kept = {r["k"]: r["text"] for r in s.without_repeats(documents([*twice, (5, None), (6, "short  one")])).collect()}
    assert kept[1] == "" and kept[5] is None and kept[6] == "short  one"
