"""Scans by many rules give what one test a rule gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from transhume import values
from transhume.operators import rule_index, scan
from transhume.values import Rule

RANDOM = random.Random(77)
PARTS = ["an", "re", "é", "ti", ".", " ", "\n", "%sql", "spark.", "read", "日本", "x", "\U0001f600", "dbutils", "_"]


def text(n):
    return "".join(RANDOM.choice(PARTS) for _ in range(RANDOM.randrange(n)))


def many_rules(n):
    out = []
    for i in range(n):
        word = "".join(RANDOM.choice(PARTS[:4]) for _ in range(RANDOM.randrange(1, 5)))
        hints = RANDOM.choice([(), (word,), (word, "dbutils"), (word, "x")])
        pattern = rf"\b{word}\b" if len(hints) < 2 else rf"\b{word}\b|{hints[1]}"
        out.append(Rule(f"r{i}", pattern, hints, RANDOM.choice([None, f"issue {i}"]), RANDOM.choice([None, f"do {i}"])))
    return out


TEXTS = [None, "", "a", "abc", *[text(60) for _ in range(60)], text(4) + "read" * 50_000 + "reanti"]


@pytest.mark.parametrize("rules", [list(values.RULES), many_rules(60)], ids=["given", "many"])
def test_same_rows_as_one_test_a_rule(spark, rules):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, content STRING").repartition(3)
    found = rule_index.scan_rules(df, rules, issues="issues", suggestions="suggestions")
    plain = scan.pattern_scan(df, rules=rules)
    plain = scan.rule_messages(scan.rule_messages(plain, rules, "issue"), rules, "suggestion")
    assert found.columns == plain.columns or set(found.columns) == set(plain.columns)
    assert sorted(found.select(plain.columns).collect()) == sorted(plain.collect())


def test_literals(spark):
    literals = ["read", "re", "é", "dbutils", "日本", "absent", "readread", "nti\U0001f600"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, content STRING")
    assert sorted(rule_index.scan_literals(df, literals).collect()) == sorted(
        scan.literal_scan(df, literals=literals).collect()
    )


def test_no_rules_no_rows_clashing_names(spark):
    df = spark.createDataFrame([(1, "dbutils", "x")], "id INT, content STRING, issues STRING")
    assert rule_index.scan_rules(df, []).first()["detected_patterns"] == []
    assert rule_index.scan_literals(df, []).first()["literals"] == []
    assert rule_index.scan_rules(df.limit(0)).collect() == []
    row = rule_index.scan_rules(df.withColumnRenamed("content", "a b"), text_col="a b").first()
    assert row["detected_patterns"] == ["dbutils"] and row["issues"] == "x"


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "CHUNK", 7)
    index = rule_index.RuleIndex([["read"], ["日本日本"], ["spark.", "nothing"], ["xy"], []])
    assert index.always == [3, 4]
    texts = ["zz", "rea", "d", "xxread", None, "日本日本", "a spark. read", "日本日", "", "01234read", "0123456read"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = [r[0] for r in df.select(index.candidates(F.col("t"))).collect()]
    words = ["read", "日本日本", "spark."]
    assert found == [[*[i for i, w in enumerate(words) if w in (t or "")], 3, 4] for t in texts]


def test_two_thousand_rules_test_few(spark):
    words = [f"w{a}{b}{c}end" for a in "abcdefghijklm" for b in "abcdefghijklm" for c in "abcdefghijklm"][:2000]
    rules = [Rule(w, rf"\b{w}\b", (w,)) for w in words]
    texts = [" ".join(RANDOM.sample(words, 3)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "content STRING")
    index = rule_index.RuleIndex([r.hints for r in rules])
    left = df.select(F.avg(F.size(index.candidates(F.col("content"))))).first()[0]
    assert left < 100  # of 2,000
    rows = rule_index.scan_rules(df, rules).collect()
    assert all(r["detected_patterns"] == sorted(set(r["content"].split()), key=words.index) for r in rows)


def test_one_scan_no_exchange_no_python(spark, tmp_path):
    spark.createDataFrame([("a dbutils", 1)], "content STRING, n INT").write.parquet(f"{tmp_path}/t")
    df = rule_index.scan_rules(spark.read.parquet(f"{tmp_path}/t"), many_rules(300))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and "Exchange" not in plan
    assert "Python" not in plan


def test_rules_for_whole_words(spark):
    words = ["an", "ant", "ante", "re", "x", "read_1", "X"]
    hints = [(), ("an",), ("zz",), ("re", "zz"), ("x",), ("read",), ()]
    rules = [Rule(f"r{i}", rf"\b{w}\b", h) for i, (w, h) in enumerate(zip(words, hints))]
    rules += [Rule("more", r"\bant\b|\bx\b", ("ant", "x")), Rule("again", r"\bant\b", ())]
    texts = [*TEXTS, "an ant ante antes", "ante zz", "anté an\u0301 ant1 _an", "read_1,x.X", "re-ant\nx", "ant"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, content STRING")
    assert set(rule_index.whole_words(hints, [r.pattern for r in rules])) == {"an", "ant", "re", "x", "read_1", "X"}
    plain = scan.pattern_scan(df, rules=rules)
    assert sorted(rule_index.scan_rules(df, rules).collect()) == sorted(plain.collect())


def test_whole_words_are_left_to_one_regex(spark):
    rules = [Rule(w, rf"\b{w}\b", (w,)) for w in ("anread", "anreti", "tianre")]
    df = rule_index.scan_rules(spark.createDataFrame([("anread",)], "content STRING"), rules)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "contains(" not in plan.lower()
