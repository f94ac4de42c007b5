import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from gaugework.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def prose(draw, lines):
    return "\n".join(" ".join(f"{draw.choice('the of and to'.split())} w{draw.randrange(999)}" for _ in range(9)).capitalize() + "." for _ in range(lines))


def junk(draw, lines):
    return "\n".join(" | ".join(f"{draw.choice(['BUY', 'NOW', 'ITEM'])}{draw.randrange(99)}!!" for _ in range(12)) + " ###" for _ in range(lines))


def corpus():
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        rows.append((i, prose(draw, 5) if good else junk(draw, 4)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    rows += [(500, prose(draw, 2) + "\n" + junk(draw, 9)), (501, prose(draw, 9) + "\n" + junk(draw, 1)), (502, "too few words"),
             (503, "one two three four five six seven eight nine ten " * 6)]
    return rows, labels


def test_base_counts_and_verdicts(spark, documents):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in q.quality_report(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for key, text in rows:
        assert tuple(got[key])[1:7] == plain(text), key
    unseen = [i for i in range(160) if i % 2]
    assert all(got[i]["kept"] for i in unseen if i % 4)
    assert not any(got[i]["kept"] for i in range(0, 160, 4))
    assert not got[500]["kept"] and got[500]["content_share"] < 0.5 and got[501]["kept"]
    assert not got[502]["kept"] and got[503]["base_failed"]


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.normal(size=(6, q.N_FEATURES))
        field = q.LineField(rng.normal(size=q.N_FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
        e = x @ field.weights
        score = lambda y: field.first[y[0]] + sum(e[i] for i in range(6) if y[i]) + sum(field.change[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(product((0, 1), repeat=6), key=score)
        assert tuple(q.best_labels(x, field)) == best


def test_gradient_equals_differences():
    """Against the likelihood of all labellings; a wanted labelling of chance one is a plain one."""
    rng = np.random.default_rng(2)
    data, mask = rng.normal(size=(4, 5, q.N_FEATURES)), np.ones((4, 5), bool)
    mask[1, 3:] = False
    mask[2, 1:] = False
    data[~mask] = 0
    chosen, weight = rng.integers(0, 2, (4, 5)), np.array([0.2, 0.3, 0.1, 0.4])
    single = np.stack([(1 - chosen) * mask, chosen * mask], axis=2).astype(float)
    pair = np.zeros((4, 2, 2))
    for d in range(4):
        n = int(mask[d].sum())
        for a, b in zip(chosen[d, :n], chosen[d, 1:n]):
            pair[d, a, b] += 1

    def likelihood(theta):
        total = 0.0
        w, change, first = theta[:q.N_FEATURES], theta[q.N_FEATURES:-2].reshape(2, 2), theta[-2:]
        for d in range(4):
            n = int(mask[d].sum())
            e = data[d, :n] @ w
            s = {y: first[y[0]] + sum(e[i] for i in range(n) if y[i]) + sum(change[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=n)}
            total += weight[d] * (s[tuple(chosen[d, :n].tolist())] - np.logaddexp.reduce(list(s.values())))
        return total

    theta = rng.normal(size=q.N_FEATURES + 6) * 0.3
    got = q._gradient(theta, data, mask, (single, pair), weight)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert got[i] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-5, abs=1e-6)


def test_expected_labels_keep_the_shares():
    rng = np.random.default_rng(6)
    data, words, mask = rng.normal(size=(30, 8, q.N_FEATURES)), rng.integers(1, 20, (30, 8)).astype(float), np.ones((30, 8), bool)
    words /= words.sum(axis=1, keepdims=True)
    good = np.arange(30) % 2 == 0
    single, pair = q.expected_labels(rng.normal(size=q.N_FEATURES + 6), data, words, mask, good, q.QualityOptions())
    share = (single[:, :, 1] * words).sum(axis=1)
    assert (share[good] >= 0.7 - 1e-9).all() and (share[~good] <= 0.3 + 1e-9).all()
    assert np.allclose(single.sum(axis=2), 1) and np.allclose(pair.sum(axis=(1, 2)), 7)


def test_footer_lines_of_good_documents_are_marked(spark, documents):
    """No line label is given: good documents carry footers that read like the lines of bad ones, at the end of long texts too."""
    draw = random.Random(9)
    rows = [(i, prose(draw, 90 if i % 10 == 1 else 6) + "\n" + junk(draw, 1)) if i % 4 else (i, junk(draw, 5) + "\n" + prose(draw, 1)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    field = q.learn(documents(rows), labels)
    for i, text in rows[200:]:
        features, _, lines, _ = q.line_features(text)
        want = [1] * (len(lines) - 1) + [0] if i % 4 else [0] * 5 + [1]
        assert q.best_labels(features, field).tolist() == want
    got = q.judged(documents(rows[200:]).withColumnRenamed("source", "quality"), field).collect()
    assert all(0 < r["quality1"]["content_share"] < 1 and r["quality"] is None for r in got)
    assert all(r["quality1"]["boilerplate"] == ([6] if len(r["text"].split("\n")) == 7 else [90]) for r in got if r["doc_id"] % 4)


def test_stretches_come_from_anywhere():
    options = q.QualityOptions()
    x = np.arange(3200.0)[:, None] * np.ones(q.N_FEATURES)
    starts = {int(f[0, 0]) for mark in range(300) for f, _ in q.stretches(x, [1] * 3200, mark, options)}
    assert len(starts) > 80 and min(starts) == 0 and max(starts) == 3168


def test_edges(spark, documents, edge_rows):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.quality_report(documents(edge_rows), labels).collect()
    assert len(rows) == len(edge_rows)
    assert sorted(tuple(r)[1:7] for r in rows) == sorted(plain(r[1]) for r in edge_rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == {3}
    assert q.quality_report(documents([]), labels).collect() == []
