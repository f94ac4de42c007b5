import random

import pytest
from gaugework.llm import mixing


def corpus(n=900):
    draw = random.Random(1)
    names = ["a", "b", "c", "d", "e", None]
    rows = []
    for i in range(n):
        source = "a" if draw.random() < 0.35 else draw.choice(names)
        size = min(400, int(draw.paretovariate(1.2) * 8))
        rows.append((i, " ".join(["w"] * size), "en", source))
    return rows


def test_targets():
    t = mixing.target_words({"a": 100, "b": 100, "c": 100, "d": 100, None: 100})
    assert t == pytest.approx({"a": 500 * 5 / 15, "b": 500 * 2 / 15, "c": 500 / 15, "d": 500 * 5 / 15, None: 500 * 2 / 15})
    # a stops at three times its size, the rest is shared by weight
    t = mixing.target_words({"a": 10, "b": 500, "c": 490})
    assert t == pytest.approx({"a": 30, "b": 970 * 2 / 3, "c": 970 / 3})
    assert mixing.target_words({"a": 0, "b": 0}) == {"a": 0, "b": 0} and mixing.target_words({}) == {}


@pytest.mark.parametrize("block, near", [(5_000, 0.01), (40, 0.05)])  # few documents are left for the last of many tiny blocks
def test_sources_come_near_their_targets(documents, block, near):
    docs = documents(corpus())
    out, fact = mixing.mixed(docs, block=block)
    rows = [(r["doc_id"], r["source"], r[fact]) for r in out.collect()]
    assert sorted(r[0] for r in rows) == list(range(900))
    for source in {r[1] for r in rows}:
        facts = [f for _, s, f in rows if s == source]
        assert sum(f["size"] for f in facts) == facts[0]["source_size"]
        assert abs(sum(f["taken"] for f in facts) - facts[0]["target"]) <= near * facts[0]["target"] + 2
        documents_wanted = facts[0]["target"] / facts[0]["source_size"] * len(facts)
        assert abs(sum(f["copies"] for f in facts) - documents_wanted) <= 0.1 * documents_wanted + 3
    assert all(f["taken"] <= 3 * f["size"] for _, _, f in rows)


def test_reruns_agree_whatever_the_partitions(documents):
    docs = documents(corpus(300))
    first = sorted(tuple(r) for r in mixing.mix_report(docs, "doc_id").collect())
    assert first == sorted(tuple(r) for r in mixing.mix_report(docs.repartition(7), "doc_id").collect())


def test_flight_keeps_both_totals():
    draw = random.Random(4)
    n = [1] * 500
    words = [draw.randrange(1, 300) for _ in n]
    x = [draw.random() for _ in n]
    want = sum(x), sum(a * b for a, b in zip(x, words))
    mixing.flight(x, n, words, draw)
    assert sum(0 < v < 1 for v in x) <= 3
    assert (sum(x), sum(a * b for a, b in zip(x, words))) == pytest.approx(want)


def test_inclusion_is_unbiased():
    words = [3, 50, 7, 7, 20, 11, 90, 4]
    totals = [0.0] * 8
    for seed in range(3000):
        x = [0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.5, 0.1]
        mixing.flight(x, [1] * 8, words, random.Random(seed))
        totals = [a + b for a, b in zip(totals, x)]
    assert [t / 3000 for t in totals] == pytest.approx([0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.5, 0.1], abs=0.03)


def test_edges(documents, edge_rows):
    docs = documents(edge_rows)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(edge_rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 6)} == {0} and {r["size"] for r in rows if r["doc_id"] == 3} == {60_000}
    twice = [r["taken"] for r in rows if r["doc_id"] == 4]
    assert twice[0] == twice[1]
    assert mixing.mix_report(documents([])).collect() == []
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copies1", "taken"]
    assert all(r["copies1"] >= 1 for r in out.collect())
