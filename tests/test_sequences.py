"""Sequence diff: longest common subsequences, and the operations that follow from them."""

import json
import os
import random
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transhume.functions import sequences
from transhume.operators import rewrite
from transhume.sinks.reports import write_conversion_report, write_json
from workload import q_more

RANDOM = random.Random(3)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def checked(a, b, found):
    assert all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
    assert len(found) == longest(a, b)


LINES = st.lists(st.sampled_from("abcdef"), max_size=30)


@settings(max_examples=400, deadline=None)
@given(LINES, LINES)
def test_both_ways_find_a_longest_one(a, b):
    for solve in (sequences.matches, sequences.by_bisection, sequences.by_bits):
        checked(a, b, solve(a, b))


@pytest.mark.parametrize("kinds", [2, 5, 30, 1000])
def test_longest_on_edited_lists(kinds):
    for _ in range(40):
        a = [RANDOM.randrange(kinds) for _ in range(RANDOM.randint(0, 120))]
        b = [x for x in a if RANDOM.random() < 0.8]
        for _ in range(RANDOM.randint(0, 20)):
            b.insert(RANDOM.randint(0, len(b)), RANDOM.randrange(kinds))
        checked(a, b, sequences.matches(a, b))


def test_large_tables_are_halved(monkeypatch):
    monkeypatch.setattr(sequences, "TABLE_BITS", 50)
    for _ in range(60):
        a, b = (RANDOM.choices("ab", k=RANDOM.randint(0, 60)) for _ in range(2))
        checked(a, b, sequences.by_bits(a, b))


def test_time_follows_the_lines_where_they_are_unique():
    def seconds(n):
        a = list(range(n))
        b = [x for x in a if x % 10] + [-x for x in range(1, n // 10)]
        RANDOM.shuffle(b[: n // 100])
        start = time.perf_counter()
        found = sequences.matches(a, b)
        assert len(found) == n - n // 10
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 60 * max(seconds(20_000), 0.01)


def ops_of(df, **args):
    found = defaultdict(list)
    for row in rewrite.line_diff(df, **args).orderBy("path", "seq").collect():
        found[row["path"]].append((row["op"], row["line"]))
    return found


def edited(spark, texts):
    rows = [(f"p{i}", a, b, "") for i, (a, b) in enumerate(texts)]
    return spark.createDataFrame(rows, "path STRING, before STRING, body STRING, header STRING")


def test_the_lines_of_the_last_verdict(spark):
    df = edited(spark, [("k0\nx\nk1\nk2\ny\nk3", "x\nk0\nk1\nz\nk2\nk3\nk4")])
    ops = ops_of(df, sequence=True)["p0"]
    assert [line for op, line in ops if op == " "] in (["k0", "k1", "k2", "k3"], ["x", "k1", "k2", "k3"])


def test_operations_give_both_sides_back_and_keep_the_most(spark):
    texts = [("", ""), ("", "a"), ("a\n", ""), ("a\nb", "b\na"), ("same\nlines", "same\nlines")]
    for _ in range(60):
        a = RANDOM.choices("abcdefg", k=RANDOM.randint(0, 25))
        b = RANDOM.choices("abcdefg", k=RANDOM.randint(0, 25))
        texts.append(("\n".join(a), "\r\n".join(b)))
    df = edited(spark, texts)
    ops = ops_of(df, sequence=True, rules=())
    for i, (a, b) in enumerate(texts):
        mine = ops[f"p{i}"]
        left, right = a.splitlines(), b.splitlines()
        assert [line for op, line in mine if op != "+"] == left
        assert [line for op, line in mine if op != "-"] == right
        assert sum(op == " " for op, _ in mine) == longest(left, right)
        # a run of changes gives its removed lines first
        assert "+-" not in "".join(op for op, _ in mine)
    for n in (1, 4, 50):
        found = defaultdict(list)
        for row in rewrite.diff_head(df, n, sequence=True, rules=()).orderBy("path", "seq").collect():
            found[row["path"]].append((row["op"], row["line"]))
        assert {p: o[:n] for p, o in ops.items() if o} == dict(found)


def test_sources_that_line_up_are_not_sent_to_python(spark):
    df = edited(spark, [("a\nb\nc", "a\nx\nc"), ("a\nb", "b"), ("a", "a")])
    plain, matched = ops_of(df), ops_of(df, sequence=True)
    assert plain["p0"] == matched["p0"] and plain["p2"] == matched["p2"]
    assert matched["p1"] == [("-", "a"), (" ", "b")]
    flags = {r["path"]: r["aligned"] for r in rewrite.line_diff(df, sequence=True).collect()}
    assert flags == {"p0": True, "p1": False, "p2": True}


def test_report_holds_the_sequence_diff(spark, tmp_path):
    before, after = "k0\nx\nk1\nk2", "k0\nk1\nz\nk2\nk4"
    row = (("p", "k", True, before, after, ""),)
    df = spark.createDataFrame(list(row), "path STRING, converted_key STRING, uploaded BOOLEAN, before STRING, body STRING, header STRING")
    write_conversion_report(df, f"{tmp_path}/report")
    (text,) = [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()]
    saved = json.loads(text)
    assert saved["before_lines"] == before.split("\n") and saved["after_lines"] == after.split("\n")
    assert [d["op"] + d["line"] for d in saved["diffs"]] == [" k0", "-x", " k1", "+z", " k2", "+k4"]


def test_lists_of_a_batch_are_paired_as_one_by_one():
    import pyarrow as pa

    random_ = random.Random(9)
    lists = [None, [], ["a"], ["a", None, "b"]]
    for words in (3, 40, 4000):
        lists += [[f"w{random_.randrange(words)}" for _ in range(random_.randrange(60))] for _ in range(60)]
    a, b = lists[:], lists[1:] + lists[:1]
    for lines in lists[4:40]:  # edits that leave lines out and put new ones in
        a.append(lines)
        b.append([x for i, l in enumerate(lines) for x in ([] if i % 5 == 3 else [l]) + ([f"new {i}"] if i % 7 == 2 else [])])
    kind = pa.list_(pa.string())
    found = sequences.paired_lists(pa.array([["skipped"], *a], kind)[1:], pa.array([None, *b], kind)[1:])
    expected = [
        None if x is None or y is None else [{"l": l, "r": r} for l, r in sequences.paired(x, y)] for x, y in zip(a, b)
    ]
    assert found.to_pylist() == expected
    assert sequences.paired_lists(pa.array([], kind), pa.array([], kind)).to_pylist() == []


def sizes(folder, end):
    return [os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder) if name.endswith(end)]


def test_the_report_that_the_query_keeps_is_packed(spark, tmp_path, monkeypatch):
    random_ = random.Random(4)
    words = ["".join(random_.choices("abcdeinorst", k=random_.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(random_.choices(words, k=random_.randint(1, 900))) for _ in range(300)] + ["", None]
    docs = [(i, text, "en", "src") for i, text in enumerate(texts, 1)]
    schema = "doc_id LONG, text STRING, lang STRING, source STRING"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(q_more, "scratch_dir", lambda spark, label: f"{tmp_path}/{label}")
    found = defaultdict(list)
    for row in q_more.conv_sequence(spark, str(tmp_path)).orderBy("path", "seq").collect():
        found[row["path"]].append((row["op"], row["line"]))
    expected = {}
    for row in q_more.views.assets(spark, str(tmp_path)).where("content IS NOT NULL").collect():
        ops, run, added = [], [], []
        for i, word in enumerate(row["content"].split(" ")):
            line = f"{i}:" + "".join(c for c in word if "a" <= c <= "z")
            if i % 5 == 3:
                run.append(("-", line))
            else:
                ops, run, added = [*ops, *run, *added, (" ", line)], [], []
            if i % 7 == 2:
                added.append(("+", f"new {i}"))
        expected[row["path"]] = [*ops, *run, *added]
    assert dict(found) == expected
    kept, text = sum(sizes(f"{tmp_path}/sequence-report", "")), sum(len(text or "") for text in texts)
    assert kept < 3 * text, kept / text


def test_packed_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    rows = spark.range(2500).selectExpr("id", "if(id % 2 = 0, repeat('x', 50), null) AS x").coalesce(1)
    write_json(rows, f"{tmp_path}/plain")
    write_json(rows, f"{tmp_path}/packed", packed=True)
    assert len(sizes(f"{tmp_path}/plain", ".json")) == 1 and len(sizes(f"{tmp_path}/packed", ".json.gz")) == 3
    plain, packed = (sorted(r[0] for r in spark.read.text(f"{tmp_path}/{p}").collect()) for p in ("plain", "packed"))
    assert plain == packed and len(packed) == 2500


def test_lists_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name)
    df = edited(spark, [("a\nb", "b")])
    try:
        spark.conf.set(name, "64m")
        assert ops_of(df, sequence=True)["p0"] == [("-", "a"), (" ", "b")]
        assert int(spark.conf.get(name).rstrip("b")) == 4 << 20
        spark.conf.set(name, "1m")  # a smaller one stays
        rewrite.line_diff(df, sequence=True)
        assert spark.conf.get(name) in ("1m", f"{1 << 20}b")
    finally:
        spark.conf.set(name, given)


@pytest.mark.parametrize("rules", [(), None])
def test_operations_of_the_report_are_those_of_the_diff(spark, tmp_path, rules):
    texts = [(None, "a"), ("a", None), ("", ""), ("a", ""), ("", "\n"), ("same\r\nx", "same\nx"), ("display(a)\nb\x0bc", "print(a)\nb\u2028c")]
    for ends in ("\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n\r"):
        a, b = (RANDOM.choices("abcd", k=RANDOM.randint(1, 9)) for _ in range(2))
        texts += [(ends.join(a), "\n".join(b)), ("\n".join(a) + ends, ends.join(b) + ends)]
    df = edited(spark, texts)
    args = {} if rules is None else {"rules": rules}
    write_conversion_report(df.withColumn("converted_key", df["path"]), f"{tmp_path}/report", packed=True, **args)
    ops = ops_of(df, sequence=True, **args)
    schema = "path STRING, before_lines ARRAY<STRING>, after_lines ARRAY<STRING>, diffs ARRAY<STRUCT<op: STRING, line: STRING>>"
    for row in spark.read.schema(schema).json(f"{tmp_path}/report").collect():
        before, body = texts[int(row["path"][1:])]
        if before is None or body is None:
            assert row["diffs"] is None
            continue
        assert [(d["op"], d["line"]) for d in row["diffs"]] == ops.get(row["path"], [])
        assert (row["before_lines"], row["after_lines"]) == (before.splitlines(), body.splitlines())
