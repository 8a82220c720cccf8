"""Chains of pages against a walk from page to page."""

import json
import random

import pytest

from transhume.sources import chains

RANDOM = random.Random(17)


def walked(pages):
    """pages: (listing, token, next).  The plain answer, by following the tokens."""
    out = {}
    by_token, given = {}, {}
    for listing, token, following in pages:
        key = (listing or "", token or "")
        given[key] = given.get(key, 0) + 1
        options = [x for x in (by_token.get(key), following or None) if x]
        by_token[key] = min(options) if options else None
    place = {}
    for listing in {k[0] for k in by_token}:
        at, n = (listing, ""), 0
        while at in by_token and at not in place:
            place[at], n = n, n + 1
            at = (listing, by_token[at])
    for key, following in by_token.items():
        ahead = (key[0], following)
        if key not in place:
            status = "unreached"
        elif following and ahead not in by_token:
            status = "next missing"
        elif following and place[ahead] <= place[key]:
            status = "loops"
        else:
            status = "ok"
        out[key] = (place.get(key), given[key], status)
        if following and ahead not in by_token:
            out[ahead] = (None, 0, "missing")
    return out


def found(spark, pages):
    df = spark.createDataFrame(pages, "listing STRING, token STRING, next STRING").repartition(3)
    rows = chains.page_chain(df).collect()
    out = {(r["listing"], r["token"]): (r["place"], r["given"], r["status"]) for r in rows}
    assert len(out) == len(rows)
    return out


def long_chain(n, listing="a"):
    return [(listing, f"t{i}" if i else None, f"t{i + 1}" if i + 1 < n else None) for i in range(n)]


CASES = {
    "one page": [("a", None, None)],
    "empty texts": [("a", "", "x"), ("a", "x", "")],
    "no first page": [("a", "x", "y"), ("a", "y", None)],
    "itself": [("a", None, "x"), ("a", "x", "x")],
    "back to the first": [("a", None, "x"), ("a", "x", None), ("b", "", "y"), ("b", "y", "z"), ("b", "z", "y")],
    "loop of its own": [("a", None, None), ("a", "x", "y"), ("a", "y", "x")],
    "two firsts": [("a", None, "x"), ("a", "", "y"), ("a", "x", None), ("a", "y", None)],
    "repeats": long_chain(5) + long_chain(5)[1:3],
    "no listing": [(None, None, "x"), ("", "x", None)],
    "same tokens in two listings": long_chain(4, "a") + long_chain(6, "b"),
    "long": long_chain(150),
    "cut": [p for p in long_chain(40) if p[1] != "t17"],
    "all name one": [("a", None, "t1"), *[("a", f"t{i}", "gone") for i in range(1, 30)]],
}


@pytest.mark.parametrize("name", list(CASES))
def test_chain_is_the_walked_one(spark, name):
    assert found(spark, CASES[name]) == walked(CASES[name])


def test_random_chains(spark):
    pages = []
    for listing in map(str, range(30)):
        n = RANDOM.randint(1, 9)
        tokens = [None, *[f"t{i}" for i in range(1, n)]]
        pages += [(listing, t, RANDOM.choice([None, "t1", "t2", "t3", "t5", "absent"])) for t in RANDOM.sample(tokens, RANDOM.randint(1, n))]
    assert found(spark, pages) == walked(pages)


def test_no_pages(spark):
    assert found(spark, []) == {}


def test_items_come_in_the_order_of_the_chain(spark, tmp_path):
    items = [{"name": f"t{i}"} for i in range(47)]
    pages, at, n = [], 0, 0
    while at < len(items):
        k = RANDOM.randint(0, 6)
        page = {"tables": items[at : at + k], "page_token": f"p{n}" if n else None, "next_page_token": "", "next_page": f"p{n + 1}"}
        pages.append(page)
        at, n = at + k, n + 1
    pages[-1]["next_page"] = None
    pages.append(pages[3])  # given twice
    RANDOM.shuffle(pages)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("".join(json.dumps(p) + "\n" for p in pages[i::3]))
    rows, chain = chains.read_chain(spark, str(tmp_path), "tables ARRAY<STRUCT<name: STRING>>")
    got = sorted((r["ord"], r["name"]) for r in rows.collect())
    assert got == [(i, x["name"]) for i, x in enumerate(items)]
    assert {r["status"] for r in chain.collect()} == {"ok"}
    assert [r["given"] for r in chain.where("given > 1").collect()] == [2]
