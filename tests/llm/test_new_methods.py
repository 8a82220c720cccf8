"""Clustering, language-model scores and the filter audit against plain versions, on small and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import AWKWARD, prose

from transhume.llm import audit, clustering, lm
from transhume.llm.queries import QUERIES

# --- clustering ---------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    sound = [
        (i, tuple(math.floor(1024 * float(np.float32(x))) for x in v))
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(sound, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in sound:
            mine[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(found) for x in zip(*found)) if found else c for found, c in zip(mine, centroids)]
    return [(i, *nearest(v)[::-1]) for i, v in sound], centroids


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (5, 64))
    return [(i, (centres[i % 5] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for i in range(n)]


AWKWARD_VECTORS = [
    (900, None),
    (901, []),
    (902, [1.0] * 63),
    (903, [1.0] * 65),
    (904, [None] * 64),
    (905, [float("nan")] + [1.0] * 63),
    (906, [float("inf")] + [1.0] * 63),
    (907, [-0.0] * 64),
    (907, [-0.0] * 64),  # repeated row
    (907, [0.5] * 64),  # repeated id
    (None, [0.25] * 64),
]


@pytest.mark.parametrize("rows", [vectors(1, 300) + AWKWARD_VECTORS, vectors(2, 5), [(1, [0.5] * 64)] * 20, AWKWARD_VECTORS[:7]])
def test_clusters_are_the_plain_ones(spark, rows):
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    df = df.withColumns({c: F.lit("x") for c in ("cells", "cluster", "distance", "n", "total")}).repartition(4)
    placed, centroids = clustering.cluster(df)
    got = Counter((r["vec_id"], r["cluster"], r["distance"]) for r in placed.collect())
    wanted, final = plain_clusters(rows)
    assert got == Counter(wanted)
    assert [tuple(c) for c in centroids.tolist()] == final
    for row in clustering.report(placed, centroids).collect():
        assert row["cluster_inertia"] == sum(d for _, c, d in wanted if c == row["cluster"])
        assert row["inertia"] == sum(d for _, _, d in wanted)
        text = ",".join(map(str, final[row["cluster"]]))
        assert row["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_never_exceed_distances_and_spare_measuring(spark):
    rows = clustering.kept(spark.createDataFrame(vectors(3, 400), "vec_id BIGINT, embedding ARRAY<FLOAT>"))
    cells = np.array([r["cells"] for r in rows.collect()])
    turn = clustering.rotation(rows)
    centroids = cells[:8]
    nearest = clustering.Nearest(centroids, turn)
    leading, rest = turn(cells.astype(float))
    exact = ((cells[:, None] - centroids[None]) ** 2).sum(2)
    assert (nearest.bounds(leading, rest) <= exact).all()
    found, distance, measured = nearest(cells, leading, rest)
    assert (found == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert measured < 0.7 * exact.size


def test_components_a_long_cannot_measure_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e30] + [0.0] * 63)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    with pytest.raises(Exception, match="does not fit a long"):
        clustering.cluster(df)


# --- language model -----------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def in_test(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_scores(rows):
    one, two = Counter(), Counter()
    for i, text in rows:
        if not in_test(i):
            found = words(text)
            one.update(found)
            two.update(zip([None, *found], found))
    total, mass = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)

    def mid(n):
        x = n.bit_length()
        return (2 ** (x - 1) + 2**x - 1) / 2 if n else 0.0

    out = []
    for i, text in rows:
        found = words(text)
        base = sum(math.log10((one[w] + 0.1) / mass) for w in found)
        score = 0.0
        for v, w in zip([None, *found], found):
            lone = min((mid(one[w]) + 0.1) / mass, 1.0)
            score += math.log10((min(mid(two[v, w]), mid(one[v])) + lm.PRIOR * lone) / (mid(one[v]) + lm.PRIOR))
        out.append((i, in_test(i), len(found), sum(one[w] > 0 for w in found), total, base, score))
    return out


def compared(rows, got, near):
    wanted = sorted(plain_scores(rows), key=repr)
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    for g, w in zip(got, wanted):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=near * g[2])


CORPUS = [(i, prose(i % 40, 50 + i)) for i in range(120)] + [(1000 + i, prose(7, 400) + f" only{i}") for i in range(20)]


@pytest.mark.parametrize("rows", [CORPUS, AWKWARD])
def test_scores_are_the_plain_ones(frame, rows):
    docs = frame(rows).withColumns({c: F.lit(1) for c in ("row", "n", "base", "score", "key", "word", "level")})
    got = lm.score(docs.repartition(3), lm.train(docs))
    # an entry taken for present moves the score of a token by some tenths, in about one of fifty
    compared(rows, got, 0.1)


def test_rare_words_come_by_join(frame):
    docs = frame(CORPUS)
    model = lm.train(docs, common=20)
    assert model.rare_below > 1 and len(model.common) <= 20
    compared(CORPUS, lm.score(docs, model), 0.1)


def test_rare_ngrams_come_by_join_where_the_filter_has_no_room(frame):
    docs = frame(CORPUS)
    model = lm.train(docs, most_words=1 << 10, common=20)
    assert model.least > 1 and len(model.bits) <= 1 << 10
    compared(CORPUS, lm.score(docs, model), 0.1)


def test_filter_never_loses_an_entry(frame):
    model = lm.train(frame(CORPUS))
    for batch in model.tables.toArrow().to_batches():
        for _, keys, levels in lm._grams(batch):
            assert (model.lookup(keys.view(np.uint64)) >= levels).all()


def test_missing_ngrams_are_rarely_taken_for_present(frame):
    model = lm.train(frame(CORPUS))
    absent = np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (model.lookup(absent) > 0).mean() < 0.06


def test_held_out_text_is_better_foreseen_than_by_single_words(spark):
    rows = [r for r in QUERIES["op12_bloom_lm"](spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_training_text(frame):
    (i,) = [i for i in range(100) if in_test(i)][:1]
    docs = frame([(i, "all held out")])
    (row,) = lm.score(docs, lm.train(docs)).collect()
    assert tuple(row)[:6] == (i, True, 4, 0, 0, 0.0) and row["score"] == 0.0


# --- filter audit -------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """rows: (doc_id, text, part)."""
    texts = {}
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""] = min(texts.get(text or "", i), i)
    labels = [r for r in labels if r[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > texts[t],
        }
        docs.append((part or "", {f for f, hit in fails.items() if hit}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                came = [d for d in mine if not d[1] & before]
                gone = [d for d in came if f in d[1]]
                out[part, order, step] = (
                    len(came) - len(gone),
                    len(gone),
                    sum(f in d[1] and bool(d[1] & before) for d in mine),
                    sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone),
                    sum(d[3] for d in gone),
                )
    share = Counter()
    for (part, order, step), row in out.items():
        share[part, order[step - 1]] += row[1]
    return {k: (*row, share[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


LABELS = [(0, 1, 0), (5, 1, None), (5, 0, 1), (6, None, 1), (13, 1, 1), (None, 1, 1), (4000, 1, 1)]


def sourced(rows):
    return [(i, t, [None, "", "a", "b"][n % 4]) for n, (i, t) in enumerate(rows)]


def audited(spark, tmp_path, rows, files):
    """The audit of rows that come a file each in the given order."""
    folder = tmp_path / "documents.parquet"
    step = -(-len(rows) // 6)
    for n in range(0, len(rows), step):
        part = spark.createDataFrame(rows[n : n + step], "doc_id BIGINT, text STRING, source STRING")
        part = part.withColumns({c: F.lit("x") for c in ("key", "mask", "n", "part", "named")})
        part.coalesce(1).write.mode("append").parquet(str(folder))
    labels = spark.createDataFrame(LABELS, "doc_id BIGINT, quality INT, toxic INT")
    got = audit.audit(spark, str(folder), labels, files=files).collect()
    keys = [(r["part"], r["filter_order"], r["step"]) for r in got]
    assert len(set(keys)) == len(keys)
    return {k: tuple(r)[3:] for k, r in zip(keys, got)}


COPIES = [(i, prose(i % 3, 220)) for i in range(40, 0, -1)] + [(i, prose(1, 220) + "#") for i in range(90, 80, -1)]


@pytest.mark.parametrize("files", [1, 2, 100])
@pytest.mark.parametrize("rows", [COPIES, list(reversed(COPIES)), AWKWARD], ids=["falling", "rising", "awkward"])
def test_audit_is_the_plain_one(spark, tmp_path, rows, files):
    rows = sourced(rows)
    assert audited(spark, tmp_path, rows, files) == plain_audit(rows, LABELS)


def test_smaller_ids_take_verdicts_back(spark, tmp_path):
    folder = tmp_path / "documents.parquet"
    for i in (9, 5, 7, 2):
        spark.createDataFrame([(i, "same", "p")], "doc_id BIGINT, text STRING, source STRING").coalesce(1).write.mode("append").parquet(str(folder))
    rows = audit.verdicts(spark, str(folder), files=1).collect()
    assert any(r["n"] < 0 for r in rows)
    total = Counter()
    for r in rows:
        total[r["doc_id"], bool(r["mask"] & audit.DUPLICATE)] += r["n"]
    assert {k for k, n in total.items() if n} == {(2, False), (5, True), (7, True), (9, True)}
    assert set(total.values()) <= {0, 1}


def test_null_ids_beside_very_large_ones(spark, tmp_path):
    big = (1 << 62) + 1
    rows = [(big, "same", "p"), (None, "same", "p"), (big + 1, "same", "p"), (None, "same", None)]
    assert audited(spark, tmp_path, rows, 1) == plain_audit(rows, LABELS)
