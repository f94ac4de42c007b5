"""The pipeline over a small corpus with planted copies, passages and benchmark leaks, stage by stage."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from gaugework.llm import decontaminate, line_dedup, mixing
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
])
SYLLABLES = {"aa": "ka to mi ra ne su".split(), "bb": "sch ung ber ein ach lich".split()}


def prose(draw, lang, lines):
    word = lambda: "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 5)))
    return "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(lines))


def corpus():
    draw = random.Random(12)
    rows = [(i, prose(draw, lang, draw.randrange(3, 9)), lang) for i in range(160) for lang in [draw.choice(["aa", "bb"])]]
    passage = prose(draw, "aa", 9)
    items = [(i, prose(draw, "aa", 2).replace("\n", " ")) for i in range(4)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(6)]  # exact copies
    near = prose(draw, "bb", 40)
    words = near.split(" ")
    rows.append((2000, near, "bb"))
    for i in range(4):  # near copies: one word of many changed
        changed = list(words)
        changed[50 * (i + 1)] = "geändert" + str(i)
        rows.append((2001 + i, " ".join(changed).replace("\n", " "), "bb"))
    rows += [(3000 + i, prose(draw, "aa", 3) + "\n" + passage + "\n" + prose(draw, "aa", 2), "aa") for i in range(5)]
    rows += [(4000 + i, prose(draw, "aa", 4) + "\n" + text.upper() + "\n" + prose(draw, "aa", 3), "aa") for i, text in items]
    rows += [(5000, "1234 5678 --- 90", "aa"), (5001, "", "aa"), (5002, None, "aa")]
    sources = ["s1", "s1", "s2", "s3", None]
    return [(k, t, lang, sources[i % 5], None if t is None else len(t)) for i, (k, t, lang) in enumerate(rows)], items


def test_each_stage_and_the_whole(spark, tmp_path):
    rows, items = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}")
        before, docs = {r["doc_id"]: r for r in docs.collect()}, spark.read.parquet(f"{folder}/{name}")
        seen[name] = before, {r["doc_id"]: r for r in docs.collect()}
    # language: only what has no language goes
    before, after = seen["language_id"]
    assert set(before) - set(after) == {5000, 5001, 5002}
    # lines: later copies go, the passage stays once, all else is unchanged
    before, after = seen["line_dedup"]
    assert set(before) - set(after) == {1000 + i for i in range(6)}
    assert all(after[i]["text"] == before[i]["text"] for i in range(160))
    assert sum(len(after[3000 + i]["text"]) for i in range(1, 5)) < 0.75 * sum(len(before[3000 + i]["text"]) for i in range(1, 5))
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    # near copies: one of each component of five-word shingle sets with a similarity of 0.8 or more
    before, after = seen["near_duplicates"]
    sets = {}
    for k, r in before.items():
        words = r["text"].lower().split()
        sets[k] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    parent = {k: k for k in sets}
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {k for k in sets if find(k) == k} and not {2001, 2002, 2003, 2004} & set(after)
    # benchmark: the leaks go, nothing else
    before, after = seen["decontamination"]
    assert set(before) - set(after) == {4000 + i for i, _ in items}
    # mix: words near the targets, no document above three times
    before, after = seen["source_mix"]
    sizes = {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for source, target in mixing.target_words(sizes).items():
        taken = sum(r["taken"] for r in after.values() if r["source"] == source)
        assert abs(taken - target) < 0.02 * target + 5
    assert all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(r["text"].split()) for r in after.values())
    again = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {k: r["taken"] for k, r in after.items()}


def test_an_empty_corpus_passes(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mix"]
    assert corpus_pipeline.ORACLE_SQL is None and decontaminate.WINDOW == 10 and line_dedup.MIN_LINES == 2
