import random

import pytest
from gaugework.llm import decontaminate as d


def plain(rows, items, n=10):
    out = {}
    for key, text in rows:
        words = d.words_of(text)
        hit, ids = set(), set()
        for item, body in items:
            w = d.words_of(body)
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j:j + size] == w[i:i + size]:
                        hit |= set(range(j, j + size))
                        ids.add(str(item))
        out[key] = (len(words), len(hit), len(ids), d.items_digest(list(ids)), bool(hit))
    return out


def corpus():
    draw = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "it's", "ümlaut", "x1"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([3, 8, 9, 10, 14, 30]))) for i in range(12)] + [(50, ""), (51, "!!"), (52, None)]
    rows = [(i, text(draw.randrange(40))) for i in range(40)]
    rows += [(100 + i, f"{text(6)}! {items[i][1].upper()}, {text(7)}") for i in range(12)]
    return rows, items


@pytest.mark.parametrize("block", [64 << 20, 5_000])
def test_equals_a_plain_search(spark, documents, block):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.hit_report(d.contamination(documents(rows), bench, block_bytes=block)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == plain(rows, items)


def test_blocks_hold_every_window_once(spark):
    words = [f"w{i}" for i in range(200)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (3, " ".join(words[:11]))], "item_id long, text string")
    blocks = list(d.benchmark_blocks(bench, "item_id", "text", 10, 4_000))
    assert len(blocks) > 10
    seen = [w for b in blocks for size, known in d._windows(b, 10).items() for w, ids in known.items() for i in ids if i == "1"]
    assert sorted(seen) == sorted(" ".join(words[i:i + 10]).encode() for i in range(191))
    assert all(len(d._windows(b, 10).get(10, {})) <= 12 for b in blocks)


def test_clashing_names(spark, documents):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents([(1, "one two three"), (2, "four")]).withColumnRenamed("source", "_gw_hits").withColumnRenamed("copies", "_GW_Words")
    out = d.decontaminated(docs, bench)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [2]


def test_removal_of_documents_and_spans(spark, documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "Before: ONE two three four five, six seven eight nine ten eleven; after."), (2, "nothing of it"), (3, None)]
    docs = documents(rows)
    whole = d.decontaminated(docs, bench)
    assert whole.columns == docs.columns and sorted(r["doc_id"] for r in whole.collect()) == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in d.decontaminated(docs, bench, remove="spans").collect()}
    assert spans == {1: "Before: ; after.", 2: "nothing of it", 3: None}


def test_edges(spark, documents, edge_rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = d.hit_report(d.contamination(documents(edge_rows), empty)).collect()
    assert len(rows) == len(edge_rows) and not any(r["contaminated"] for r in rows)
    bench = spark.createDataFrame([(None, "same row twice"), (1, "same row twice"), (1, "same row twice")], "item_id long, text string")
    rows = d.hit_report(d.contamination(documents(edge_rows), bench)).collect()
    assert [(r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows if r["doc_id"] == 4] == [(3, 2, d.items_digest(["", "1"]))] * 2
    assert d.hit_report(d.contamination(documents([]), bench)).collect() == []
