"""The trie against a plain one built from nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from gaugework.llm import prefix_trie
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    # names that the operator uses itself
    T.StructField("c", T.StringType()), T.StructField("p", T.LongType()), T.StructField("own", T.StringType()), T.StructField("last", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], TURNS)


def ordered(rows):
    """The turns (role, text) of each conversation."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            out.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in out.items()}


def plain(convs):
    """One tuple for each node, by walking the trie."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def sums(node):
        below = [sums(x) for x in children.get(node, [])]
        words = len(node[-1][1].split()) if node else 0
        return (sum(x[0] for x in below) or 1 if below else 1), sum(x[1] for x in below) + (len(members[node]) - 1) * words

    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, [])), *sums(node),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def result(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def many(seed, convs=120, words=("a", "b c", "d e f")):
    """Short conversations of few different turns: much is shared at any depth."""
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), r.choice(words)) for c in r.sample(range(-50, 900), convs) for t in range(r.randint(1, 6))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sketch_bits", [1 << 28, 1024])
def test_equals_a_plain_trie(spark, sketch_bits):
    """Also where the sketch takes several slices."""
    rows = many(1)
    assert result(prefix_trie.conversation_trie(frame(spark, rows), None, sketch_bits)) == plain(ordered(rows))


def forks_of(spark, ids):
    return spark.createDataFrame([(c, c - int(c - 20 * int(c / 20)), zlib.crc32(str(c).encode()) % 4) for c in ids], "c long, source long, h long")


def rebuilt(convs, forks):
    return {c: convs.get(source, [])[:h] + convs.get(c, [])[h:] for c, source, h in forks}


def test_borrowed_heads(spark):
    rows = many(2)
    forks = forks_of(spark, sorted({r[0] for r in rows}))
    want = plain(rebuilt(ordered(rows), [tuple(x) for x in forks.collect()]))
    assert result(prefix_trie.conversation_trie(frame(spark, rows), forks)) == want


def test_fork_without_any_turn(spark):
    rows = [(1, 0, "user", "x y"), (2, 0, "user", "x y")]
    forks = spark.createDataFrame([(1, 2, 5), (2, 9, 3), (7, 8, 1)], "c long, source long, h long")
    want = plain({1: [("user", "x y")], 2: [], 7: []})
    assert result(prefix_trie.conversation_trie(frame(spark, rows), forks)) == want


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most turns, its copy, and a copy that ends early."""
    long = [(t, "user" if t % 2 else "bot", f"w{t % 7} x") for t in range(3000)]
    rows = [(5, *x) for x in long] + [(8, *x) for x in long] + [(6, *x) for x in long[:1000]] + [(c, 0, "bot", "w0 x") for c in range(20, 60)]
    random.Random(3).shuffle(rows)
    got = prefix_trie.conversation_trie(frame(spark, rows))
    got = {(r["depth"], r["conv_id"]): r for r in got.collect()}
    assert len(got) == 3001
    top, end, short = got[(0, 5)], got[(3000, 5)], got[(1000, 5)]
    assert (top["n_convs"], top["n_leaves"], top["n_children"]) == (43, 1, 1)
    assert top["saved_tokens"] == 42 * 2 + 999 * 2 * 2 + 2000 * 2
    assert end["ends_sha256"] == hashlib.sha256(b"5,8").hexdigest() and short["ends_sha256"] == hashlib.sha256(b"6").hexdigest()
    assert short["n_convs"] == 3 and got[(1001, 5)]["n_convs"] == 2


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(2500) for t in range(3)]
    got = result(prefix_trie.conversation_trie(frame(spark, rows)))
    assert len(got) == 4 and [x[3] for x in got] == [2500] * 4
    assert got[3][7] == hashlib.sha256(",".join(map(str, range(2500))).encode()).hexdigest()


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "user", "a\x1cb \x0b c"), (2, None, "", None), (2, 1, "user", "x"), (2, 1, "user", "x"),
        (None, 0, "user", "lost"), (3, 5, "user", "b"), (3, 5, "user", "a"), (4, 0, "u", "ser:x"), (4, 1, "us", "er:x"), (-7, 0, "user", "w " * 40_000),
    ]
    got = result(prefix_trie.conversation_trie(frame(spark, rows)))
    want = plain(ordered(rows))
    assert [x[:6] + x[7:] for x in got] == [x[:6] + x[7:] for x in want]
    assert prefix_trie.conversation_trie(frame(spark, [])).collect() == []
    assert prefix_trie.conversation_trie(frame(spark, [(None, 0, "user", "x")])).collect() == []


def test_digests_tell_nodes_apart_and_name_parents(spark):
    rows = many(4)
    got = prefix_trie.conversation_trie(frame(spark, rows)).select("digest", "parent_digest").collect()
    nodes = [r["digest"] for r in got]
    assert len(set(nodes)) == len(nodes) and {r["parent_digest"] for r in got} - {None} <= set(nodes)
