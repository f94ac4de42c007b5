"""Sources keep every row that fits."""

import csv
import io
import random

import pytest
from gaugework.sources import quoted_csv
from gaugework.sources.readers import bad_json_lines, read_csv, read_feedback_csv, read_table, sniff_separator


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_short_lines_are_filled_and_long_ones_skipped(spark, tmp_path):
    path = put(tmp_path, "a.csv", "id,val,note\n1,2,x\n3\n4,5,y,too many\n6,7,\n8,9,z,\n")
    assert rows(read_table(spark, path)) == [(1, 2, "x"), (3, None, None), (6, 7, None)]
    typed = read_table(spark, path, schema="id int, val int, note string")
    assert rows(typed) == [(1, 2, "x"), (3, None, None), (6, 7, None)]
    assert rows(typed.select("id")) == [(1,), (3,), (6,)]


def test_separator_is_judged_on_the_first_characters(spark, tmp_path):
    many = "a;b\n" + "1;2\n" * 70 + "1,2,3,4,5\n" * 200
    assert sniff_separator(spark, put(tmp_path, "b.csv", many)) == ","
    far = "a;b\n" + "1;2\n" * 1500 + "1,2,3,4,5\n" * 3000
    assert sniff_separator(spark, put(tmp_path, "c.csv", far)) == ";"


@pytest.mark.parametrize("name", ["a.json", "a.jsonl"])
def test_bad_json_lines_cost_only_themselves(spark, tmp_path, name):
    path = put(tmp_path, name, '{"a": 1, "b": "x"}\n{"a": 2, broken\n\n{"a": 3, "b": "z"}\n{"a": 4}\n')
    assert rows(read_table(spark, path).select("a", "b")) == [(1, "x"), (3, "z"), (4, None)]
    assert [r["line"] for r in bad_json_lines(spark, path).collect()] == ['{"a": 2, broken']


def test_json_documents(spark, tmp_path):
    assert rows(read_table(spark, put(tmp_path, "d.json", '\n[\n{"a": 1},\n{"a": 2}]'))) == [(1,), (2,)]
    assert rows(read_table(spark, put(tmp_path, "e.json", '{\n"a": 1\n}'))) == [(1,)]


def test_feedback_files(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    put(folder, "1.csv", "﻿feedback,note\ngood café �,\n\nsecond,two,three\n\"a \"\"quoted\"\" one\",x\nshort\n")
    put(folder, "2.csv", "feedback,note\nprice 5€ – naïve,y\n".encode("cp1252"))
    got = sorted(rows(read_feedback_csv(spark, str(folder))))
    assert got == sorted([("good café �", ""), ("", ""), ('a "quoted" one', "x"), ("short", ""), ("price 5€ – naïve", "y")])


def test_feedback_records_over_several_lines(spark, tmp_path):
    path = put(tmp_path, "g.csv", 'feedback,note\n"line one\nline two",a\nlast,b\n')
    assert rows(read_feedback_csv(spark, path)) == [("line one\nline two", "a"), ("last", "b")]


def test_quotes_separators_and_breaks_inside_fields(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'id,text,n\n1,"say ""hi, you"" now",5\r\n2,"two\r\nlines, ""here""\n",6\n\n3,5" pipe,7\n4,"a"b"c,8\n5,"",\n')
    want = [(1, 'say "hi, you" now', 5), (2, 'two\r\nlines, "here"\n', 6), (3, '5" pipe', 7), (4, 'ab"c', 8), (5, None, None)]
    assert rows(read_csv(spark, path)) == want
    assert rows(read_csv(spark, path, schema="id int, text string, n int")) == want


def test_types_need_all_rows(spark, tmp_path):
    lines = [f"{i},{i * 10**9},{i}.5,2020-01-0{i % 9 + 1},2020-01-01 10:00:00,true,x" for i in range(300)]
    path = put(tmp_path, "t.csv", "a,b,c,d,e,f,g\n" + "\n".join(lines) + "\n,,,,,,\n")
    assert [t for _, t in read_csv(spark, path).dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string"]
    late = put(tmp_path, "u.csv", "a\n" + "1\n" * 500 + "x\n")
    assert read_csv(spark, late).dtypes == [("a", "string")]


FIELDS = ["", "a", 'say "x"', "b,c", "two\nlines", '"', '""', "\n", "é€", 'x"y', ",", "\r\n", "a" * 40]


@pytest.mark.parametrize("seed", range(4))
def test_records_across_many_splits(spark, tmp_path, seed):
    """Splits of a few bytes: most records cross borders; the rows are those of one reader over the whole file."""
    draw = random.Random(seed)
    made = [[draw.choice(FIELDS) for _ in range(3)] for _ in range(150)]
    made[77][1] = "long\n\"quoted\"," * 60
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=draw.choice(["\n", "\r\n"])).writerows([["x", "y", "z"], *made])
    path = put(tmp_path, f"s{seed}.csv", out.getvalue().encode("utf-8-sig"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_feedback_csv(spark, path)
        assert df.rdd.getNumPartitions() > 40
        assert sorted(rows(df)) == sorted(map(tuple, made))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_state_functions_equal_a_plain_reader():
    draw = random.Random(7)
    for _ in range(3000):
        line = "".join(draw.choice(['"', ",", "a", "\r"]) for _ in range(draw.randint(0, 9)))
        for inside in (False, True):
            # a reader that sees the line, and then a mark line: the mark is a record of its own unless quotes are open
            text = ('"' if inside else "") + line + "\nmark"
            got = list(csv.reader(io.StringIO(text, newline="")))
            assert quoted_csv.inside_after(line.encode(), inside, b",") == (got[-1] != ["mark"]), (line, inside)


def test_very_long_fields_and_open_quotes(spark, tmp_path):
    long = "w " * 600_000
    path = put(tmp_path, "l.csv", f'feedback,note\n"{long}",x\nshort,"never closed\nlast line')
    assert rows(read_feedback_csv(spark, path)) == [(long, "x"), ("short", "never closed\nlast line")]
    assert rows(read_feedback_csv(spark, put(tmp_path, "e.csv", "feedback,note\n"))) == []
