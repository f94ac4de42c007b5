import random

import numpy as np
import pytest
import xxhash
from gaugework.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(fps):
    """Smallest key per component, by looking at all pairs."""
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_fingerprint(spark):
    for text in (None, "", "One", "One two THREE", "A b C d e f g a b c d", "é ü \U0001F600 x y z é ü", "w " * 40_000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert xxhash.xxh64_intdigest("a b c d", 42) == spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64


def fingerprints(n=400, seed=2):
    draw = random.Random(seed)
    fps = [draw.getrandbits(64) for _ in range(n)]
    for _ in range(250):  # chains and clusters of near ones
        v = draw.choice(fps)
        for b in draw.sample(range(64), draw.randrange(1, 6)):
            v ^= 1 << b
        fps.append(v)
    return sorted(set(fps))


@pytest.mark.parametrize("cell", [4096, 3, 2])
def test_links_connect_what_all_pairs_connect(spark, cell):
    fps = fingerprints()
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(nodes, cell)
    rows = edges.collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 4 for r in rows)
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    signed = {int(np.uint64(f).astype(np.int64)): f for f in fps}
    want = plain_components(signed)
    assert {k: root.get(k, k) for k in signed} == want


def test_embedding_never_exceeds_the_differing_bits(spark):
    fps = np.array(fingerprints(60), np.uint64)
    shape = simhash._embedded_array(fps)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int)
    lower = np.bitwise_count(shape[:, None] ^ shape[None, :]).astype(int)
    assert (lower <= d).all() and (lower[np.triu_indices(len(fps), 1)] > 0).any()
    nodes = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long")
    from pyspark.sql import functions as F

    got = {r[0] % 2**64: r[1] % 2**64 for r in nodes.select("fp", simhash.embedded(F.col("fp"))).collect()}
    assert got == dict(zip(fps.tolist(), shape.tolist()))


def test_a_cluster_writes_a_forest_not_its_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)}  # all within four bits
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    assert simhash.links(nodes).count() < 71 * len(fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    assert components.components(edges.limit(0)).collect() == []


def test_edges(documents, edge_rows):
    docs = documents(edge_rows)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(edge_rows)
    zero = {r["doc_id"]: r for r in rows if r["fingerprint"] == "0" * 16}
    assert sorted(zero) == [1, 2, 6] and {r["component_id"] for r in zero.values()} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert simhash.near_duplicates(documents([])).collect() == []
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 5, 7] and None in ids


def test_near_copies_link(documents):
    draw = random.Random(8)
    words = [f"w{draw.randrange(10**6)}" for _ in range(600)]
    near = words[:300] + ["changed"] + words[301:]
    rows = [(3, " ".join(words)), (9, " ".join(near).upper()), (11, " ".join(words)), (20, "something else entirely with words")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(rows)).collect()}
    want = plain_components({k: plain_fingerprint(t) for k, t in rows})
    assert got == want and got[11] == 3
