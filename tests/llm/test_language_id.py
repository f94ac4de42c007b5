import random
import zlib

import numpy as np
import pytest
from gaugework.llm import language_id as li

SYLLABLES = {"aa": "ka to mi ra ne su".split(), "bb": "sch ung ber ein ach lich".split(), "cc": "eau oux ment tion que lle".split()}


def sentence(draw, lang, n=12):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)).capitalize()


def corpus(n=240):
    draw = random.Random(6)
    return [(i, sentence(draw, lang), lang) for i, lang in ((i, draw.choice("aa aa bb cc".split())) for i in range(n))]


def test_held_out_accuracy_and_calibration(documents):
    rows = corpus()
    got = {r["doc_id"]: r for r in li.language_report(documents(rows)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(r["lang_pred"] == lang, r["score"]) for i, _, lang in rows if (r := got[i])["held_out"]]
    assert len(held) > 20 and np.mean([h for h, _ in held]) > 0.97
    assert all(0 <= s <= 1 for _, s in held)


def test_predictions_read_the_text_only(documents):
    rows = corpus()
    model = li.learn(documents(rows))
    docs = documents([(9_000, sentence(random.Random(1), "bb"), "aa", "x"), (None, sentence(random.Random(1), "bb"), None, None)])
    a, b = [r["verdict"] for r in li.predicted(docs, model).collect()]
    assert a == b and a["lang_pred"] == "bb"


def test_held_out_documents_teach_nothing(documents):
    rows = corpus()
    other = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "zz") for i, t, lang in rows]
    a = sorted(tuple(r) for r in li.language_report(documents(rows)).collect())
    b = sorted(tuple(r) for r in li.language_report(documents(other)).collect())
    assert a == b


def test_weights_are_sparse_and_frequencies_whole(documents):
    rows = corpus()
    model = li.learn(documents(rows))
    assert (model.weights == 0).mean() > 0.5 and model.languages == ("aa", "bb", "cc")
    df, total = li.document_frequencies(documents(rows).repartition(5), "text", 15)
    want = np.zeros(1 << 15, int)
    for _, t, _ in rows:
        want[li.buckets(t, 15)[0]] += 1
    assert total == len(rows) and (df == want).all()


def test_temperature_matches_confidence_to_accuracy():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 3000)
    logits = np.eye(3)[np.where(rng.random(3000) < 0.8, truth, (truth + 1) % 3)] * 12
    t = li.temperature(logits, truth)
    p = np.exp(logits / t)
    assert (p.max(axis=1) / p.sum(axis=1)).mean() == pytest.approx(0.8, abs=0.01)


def test_edges(documents, edge_rows):
    rows = corpus() + [(10_000 + i, *r[1:]) for i, r in enumerate(edge_rows)]
    got = {r["doc_id"]: r for r in li.language_report(documents(rows)).collect()}
    und = [i for i, r in enumerate(edge_rows) if not any(c.isalpha() for c in r[1] or "")]
    assert all((got[10_000 + i]["lang_pred"] == "und") == (i in und) for i in range(len(edge_rows)))
    assert all(got[10_000 + i]["score"] == 0 for i in und)
    assert li.language_report(documents([])).collect() == []
    alone = li.language_report(documents([(1, "text", None), (2, "more", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("und", 0.0)}


def test_filter_keeps_clean_documents(documents):
    docs = documents([*corpus(), (5_000, "12 34 --", "aa"), (5_001, None, "aa")])
    kept = li.in_known_language(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(240))
