"""United activity of clusters against a plain sweep."""

import random
from collections import defaultdict

import pytest

from transhume.operators import activity, cost

RANDOM = random.Random(41)
AS_OF, DAYS = 1_706_659_200, 30
BEGIN = AS_OF - DAYS * 86400
KIND = """ord BIGINT, cluster_id STRING, num_workers INT, autoscale STRUCT<min_workers: INT>,
    driver_node_type_id STRING, node_type_id STRING, start_time BIGINT, created_time BIGINT,
    terminated_time BIGINT, end_time BIGINT"""


def row(i, name, start, end, workers=1, kind="i3.large"):
    return (i, name, workers, None, None, kind, start, None, end, None)


def swept(rows):
    """Hours of each cluster by marking the ends of its intervals one after the other."""
    by_name = defaultdict(list)
    for r in rows:
        by_name[r[1] if r[1] is not None else ("row", r[0])].append(r)
    out = {}
    for name, listed in by_name.items():
        events, started = [], False
        for r in listed:
            start, end = r[6] or r[7] or None, r[8] or r[9] or None
            if start is None:
                continue
            started = True
            seconds = [x / 1000 if x is not None and x > 1e12 else x for x in (start, end)]
            a, b = max(seconds[0], BEGIN), seconds[1] if seconds[1] is not None else AS_OF
            if b > a:
                events += [(a, 1), (b, -1)]
        total, depth, since = 0.0, 0, 0
        for at, step in sorted(events, key=lambda e: (e[0], -e[1])):
            if depth == 0 and step == 1:
                since = at
            depth += step
            if depth == 0:
                total += at - since
        out[name] = total / 3600 if started else 24 * DAYS * 0.25
    return out


def random_rows(n, names):
    rows = []
    for i in range(n):
        start = RANDOM.choice([None, 0, BEGIN - 9000, *[BEGIN + RANDOM.randint(0, DAYS * 86400) for _ in range(9)]])
        end = None if start is None else RANDOM.choice([None, 0, start + RANDOM.randint(-5000, 400_000)])
        if RANDOM.random() < 0.5:
            start, end = (x * 1000 if x else x for x in (start, end))
        rows.append(row(i, RANDOM.choice(names), start, end))
    return rows


@pytest.mark.parametrize("rows", [random_rows(300, ["a", "b", "c", None]), random_rows(400, ["only"])], ids=["several", "one"])
def test_hours_are_those_of_a_sweep(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = activity.cluster_cost_once(df, AS_OF).collect()
    wanted = swept(rows)
    assert len(got) == len(wanted)
    for r in got:
        name = r["cluster_id"] if r["cluster_id"] is not None else ("row", r["ord"])
        assert r["hours"] == pytest.approx(wanted[name], abs=1e-6)
        assert r["dbu_hours"] == pytest.approx(16 * wanted[name], abs=1e-4)


def test_a_cluster_listed_twice_is_not_counted_twice(spark):
    rows = [row(i, f"c{i}", BEGIN + 1000 * i, BEGIN + 500_000 + 7 * i) for i in range(20)]
    once, twice = (spark.createDataFrame(r, KIND) for r in (rows, rows + [(100 + x[0], *x[1:]) for x in rows]))
    plain = {r["cluster_id"]: r["dbu_hours"] for r in cost.cluster_cost(once, AS_OF).collect()}
    for df, listed in ((once, 1), (twice, 2)):
        got = activity.cluster_cost_once(df, AS_OF).collect()
        assert {r["listed"] for r in got} == {listed}
        assert {r["cluster_id"]: pytest.approx(r["dbu_hours"]) for r in got} == plain


def test_last_listing_gives_the_nodes(spark):
    rows = [row(2, "c", AS_OF - 7200, AS_OF, 3, "m5.metal"), row(1, "c", AS_OF - 7200, AS_OF - 3600, 9, "i3.large")]
    (got,) = activity.cluster_cost_once(spark.createDataFrame(rows, KIND), AS_OF).collect()
    assert (got["workers"], got["worker_type"], got["hours"], got["ord"]) == (3, "m5.metal", 2.0, 2)


def test_islands(spark):
    rows = [row(0, "c", BEGIN + 10, BEGIN + 20), row(1, "c", BEGIN + 20, BEGIN + 30), row(2, "c", BEGIN + 12, BEGIN + 14), row(3, "c", BEGIN + 40, BEGIN + 50)]
    pieces = activity.intervals(spark.createDataFrame(rows, KIND), AS_OF)
    found = sorted((r["since"] - BEGIN, r["until"] - BEGIN) for r in activity.islands(pieces).collect())
    assert found == [(10, 30), (40, 50)]


def test_days_are_worked_on_apart(spark):
    rows = [row(i, "hot", BEGIN + i * 60, BEGIN + i * 60 + 90_000) for i in range(500)]
    pieces = activity.intervals(spark.createDataFrame(rows, KIND), AS_OF)
    assert pieces.select("day").distinct().count() >= 2
    (got,) = activity.united(pieces).collect()
    assert got["hours"] == pytest.approx((499 * 60 + 90_000) / 3600)


def test_empty(spark):
    assert activity.cluster_cost_once(spark.createDataFrame([], KIND), AS_OF).collect() == []
