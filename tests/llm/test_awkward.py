"""Nulls, repeated rows, repeated ids, extra columns and ties, for each operator."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import AWKWARD, DISTINCT, LONG

import transhume.llm.encoding as encoding
from transhume.llm import debruijn, exact, jaccard, language, packing, secrets, sharding, token_counts, wavelet, winnow

BPE = encoding.default_path("byte_bpe_50k.json")
WORD = encoding.default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(frame):
    """The awkward rows with columns named like those the operators work with."""
    names = ["row", "t", "n", "at", "k", "_t", "_id", "_maybe", "doc", "slot", "kept", "part", "_row", "d", "i", "digest", "id"]
    return frame(AWKWARD).withColumns({c: F.lit(i) for i, c in enumerate(names)}).cache()


def test_sharding_places_all_but_null_ids(docs):
    rows = sharding.place(docs).collect()
    assert len(rows) == len(AWKWARD)
    for row in rows:
        assert (row["shard"] is None) == (row["doc_id"] is None)
    assert len({r["shard"] for r in rows if r["doc_id"] == 20}) == 1


def test_language_of_awkward_rows(docs):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2, 12)] == ["und"] * 4
    assert by_id[5]["lang_pred"] == "en" and 0 <= by_id[5]["score"] <= 1
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == sorted(i for i, t in AWKWARD if i is not None and t and re.search(r"[^\W\d_]", t))


def test_language_without_labels(frame):
    rows = frame(DISTINCT).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict(rows, language.fit(rows)).collect()} == {"und"}


def test_shards_hold_every_row(spark, docs, tmp_path):
    manifest = wavelet.write_shards(docs, f"file:{tmp_path}", BPE, shard_ids=500)
    rows = wavelet.read_documents(manifest).collect()
    encoder = encoding.Encoder(BPE).tokenizer
    wanted = []
    for i, text in AWKWARD:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        wanted.append((i, len(ids), zlib.crc32(raw)))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_crc32")) for r in rows) == Counter(wanted)
    rows = sorted(rows, key=lambda r: r["start"])
    starts, at = [], 0
    for row in rows:
        starts.append(at)
        at += row["n_tokens"]
    assert [r["start"] for r in rows] == starts
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_winnowing_of_awkward_rows(spark, docs):
    items = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (2, "one"), (3, None)], "item_id BIGINT, text STRING")
    rows = winnow.decontaminate(docs, items).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    hit = Counter(r["doc_id"] for r in rows if r["contaminated"])
    assert hit == Counter([3, 4, 5, 6, 7, 8, 9, 10, 19, None, 20])
    assert {tuple(r["items"]) for r in rows if r["doc_id"] == 5} == {("1",)}
    clean = winnow.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(AWKWARD) - sum(hit.values())


def test_jaccard_of_awkward_rows(docs):
    rows = jaccard.members(docs).collect()
    assert Counter(r["doc"] for r in rows) == Counter(i for i, _ in AWKWARD)
    # all texts that are LONG but for case and white space, and the one with a tail
    assert {r["component"] for r in rows if r["n"] in (56, 57)} == {5}
    assert {r["doc"]: r["component"] for r in rows if r["doc"] in (0, 1, 2)} == {0: 0, 1: 1, 2: 2}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and not any(ids[i] for i in (6, 7, 8, 9, 17, 19))
    assert all(ids[i] for i in (0, 1, 2, 3, 4, 10, 13))


def test_packing_of_awkward_rows(docs):
    rows = packing.pack(docs, BPE).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    sizes = Counter()
    tokenizer = encoding.Encoder(BPE).tokenizer
    for i, text in AWKWARD:
        sizes[i] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == sizes
    assert len(by_sequence) == -(-sum(sizes.values()) // packing.CAPACITY)


def test_secrets_of_awkward_rows(docs):
    rows = secrets.find_secrets(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    twice = [r for r in rows if r["spans"]]
    assert len(twice) == 2 and {r["doc_id"] for r in twice} == {20}
    assert {r["spans"] for r in twice} == {"assign:0:20,access:21:41,endpoint:42:61"}
    assert {r["base"] for r in twice} == {"assign:0:20,access:21:41"}


def test_debruijn_of_awkward_rows(docs):
    rows = debruijn.dedup(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in rows}
    assert removed[5, 60] == 0 and removed[6, 60] == 60 and removed[7, 60] == 60
    assert removed[9, 61] == 60 and removed[10, 120] == 60 and removed[17, 13] == 13
    assert removed[None, 60] == 0 and removed[20, 60] == 60 and removed[15, 20] == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["kept_sha256"] for r in rows if r["doc_id"] in (0, 1, 2, 6)} == {empty}


def test_token_counts_of_awkward_rows(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = token_counts.count_tokens(docs, WORD).collect()
    wanted = Counter(
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD
    )
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_exact_of_awkward_rows(docs):
    rows = exact.refine(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows}
    assert {(5, 5, 5), (6, 5, 5), (7, 5, 5), (None, 5, 5), (20, 5, 5), (20, 20, 2), (None, 0, 4), (1, 0, 4) , (13, 13, 1)} <= {
        g if g[1] != 2 else (g[0], 0, g[2]) for g in groups
    }
    kept = exact.dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[20] == 1 and ids[None] == 0 and ids[6] == 0 and ids[4] == 1 and ids[19] == 0


def test_exact_ties_and_lengths(frame):
    rows = exact.refine(frame([(3, "ab"), (2, "a b"), (1, "a  b"), (7, "b a"), (8, "ba")])).collect()
    verdict = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert verdict == {3: (1, 3, False), 2: (1, 3, False), 1: (1, 3, True), 7: (7, 2, True), 8: (7, 2, False)}



def test_pipeline_stages_keep_the_columns_of_awkward_rows(spark, docs, tables):
    import corpus_pipeline

    folder = tables([], [(1, " ".join(LONG.split()[20:35]))])
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder).cache()
        assert rows.columns == docs.columns, name
    left = Counter(r["doc_id"] for r in rows.collect())
    # LONG and all that holds it is in the benchmark; what has no letter is in no language
    assert not any(left[i] for i in (0, 1, 2, 5, 6, 7, 8, 9, 10, 12))
    assert all(left[i] == 1 for i in (3, 4, 11, 13, 14, 15, 16, 18)) and left[17] == left[19] == 0


def test_pipeline_on_empty_tables(spark, tables):
    import corpus_pipeline

    folder = tables([])
    rows = corpus_pipeline.run(spark, folder)
    assert rows.collect() == []
    assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(rows.columns)
