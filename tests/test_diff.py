"""Line diff against plain Python."""

import difflib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from transhume.operators import rewrite
from transhume.values import Rewrite

RANDOM = random.Random(5)
WORDS = ["x", "display(a)", "display\n(b)", "dbutils.fs.ls('p')", "dbfs:/q", "", "y", "print(a)"]


def sources(n=120):
    return ["\n".join(RANDOM.choices(WORDS, k=RANDOM.randint(0, 12))) for _ in range(n)] + [""]


def converted(spark, items, language="SQL"):
    rows = [(f"p{i}", language, t) for i, t in enumerate(items)]
    df = spark.createDataFrame(rows, "path STRING, language STRING, content STRING")
    return rewrite.convert_assets(df, "lake")


def ops_by_path(df):
    found = defaultdict(list)
    for row in df.orderBy("path", "seq").collect():
        found[row["path"]].append((row["op"], row["line"]))
    return found


def test_diff_gives_both_sides_back(spark):
    for language in ("SQL", "PYTHON"):
        df = converted(spark, sources(), language).cache()
        ops = ops_by_path(rewrite.line_diff(df))
        for row in df.collect():
            mine = ops[row["path"]]
            assert [l for op, l in mine if op != "+"] == row["before"].splitlines()
            assert [l for op, l in mine if op != "-"] == row["after"].splitlines()
        df.unpersist()


def test_aligned_flag(spark):
    df = converted(spark, ["a\ndisplay(x)", "a\ndisplay\n(x)\nb\nc", "display\n(xdisplay\n(b\nc"])
    flags = {r["path"]: r["aligned"] for r in rewrite.line_diff(df).collect()}
    # In the last source the text of a match also occurs where it is no match; only matches are marked.
    assert flags == {"p0": True, "p1": True, "p2": True}
    ops = ops_by_path(rewrite.line_diff(df))
    assert ops["p1"] == [
        (" ", "a"), ("-", "display"), ("-", "(x)"), ("+", "print(x)"), (" ", "b"), (" ", "c"),
    ]
    assert ops["p2"][-1] == (" ", "c")


def test_same_operations_as_a_sequence_match(spark):
    """With distinct lines it is the diff a sequence matcher gives, also over joined lines."""
    items = []
    for i in range(80):
        pool = ["display(a)", "dbfs:/q", "k = 1", "m = 2", "display\n(z)", "dbutils.fs.ls\n\n("]
        picked = RANDOM.sample(pool, 5)
        items.append("\n".join(f"{line} # {i}.{j}" for j, line in enumerate(picked)))
    df = converted(spark, items).cache()
    ops = ops_by_path(rewrite.line_diff(df))
    assert rewrite.line_diff(df).where("NOT aligned").isEmpty()
    for row in df.collect():
        a, b = row["before"].splitlines(), row["after"].splitlines()
        wanted = []
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
            if tag == "equal":
                wanted += [(" ", line) for line in a[i1:i2]]
            else:
                wanted += [("-", line) for line in a[i1:i2]] + [("+", line) for line in b[j1:j2]]
        # Neighbouring runs of a changed and a joined line are one run to the matcher as well.
        assert ops[row["path"]] == wanted


def test_counts(spark):
    df = converted(spark, sources(), "SCALA").cache()
    for row in df.join(rewrite.diff_counts(df), "path").collect():
        before, after = Counter(row["before"].splitlines()), Counter(row["body"].splitlines())
        both = sum((before & after).values())
        assert row["kept"] == both
        assert row["removed"] == sum(before.values()) - both
        assert row["added"] == sum(after.values()) - both
        assert row["header_added"] == len(row["header"].splitlines())


def test_head_is_the_start_of_the_diff(spark):
    for language in ("PYTHON", "SQL"):
        df = converted(spark, sources(40), language).cache()
        whole = ops_by_path(rewrite.line_diff(df))
        for n in (1, 3, 7, 30):
            head = ops_by_path(rewrite.diff_head(df, n))
            assert {p: ops[:n] for p, ops in whole.items()} == dict(head)


def test_rules_see_earlier_results(spark):
    df = spark.createDataFrame([("dbfs:/dbfs/x",)], "content STRING")
    assert rewrite.rewrite(df, bucket="b").first()[0] == "dbfs:s3://b/x"
    own = [Rewrite("a", "b"), Rewrite("b+", "c")]
    df = spark.createDataFrame([("aab",)], "content STRING")
    assert rewrite.rewrite(df, rules=own).first()[0] == "c"


def test_defaults(spark):
    df = spark.createDataFrame(
        [(None, "n", None, None), ("", "", "scala", "x")],
        "path STRING, name STRING, language STRING, content STRING",
    )
    rows = {r["path"]: r for r in rewrite.convert_assets(df).collect()}
    assert set(rows) == {"n", "unnamed.py"}
    assert rows["n"]["language"] == "PYTHON" and "s3_list" in rows["n"]["after"]
    assert rows["unnamed.py"]["after"].endswith("\nx")
    tally = df.select((F.col("path") == "").alias("uploaded"))
    assert tuple(rewrite.conversion_tally(tally).first()) == (1, 2)
