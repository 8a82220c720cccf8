"""The methods themselves against plain versions, and the queries that SQL can't express."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from texts import AWKWARD, LONG, prose

import transhume.llm.encoding as encoding
from transhume.llm import components, debruijn, jaccard, language, packing, shared, sharding, spans, token_counts, wavelet
from transhume.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BPE = encoding.default_path("byte_bpe_50k.json")
WORD = encoding.default_path("word_bpe_49k.json")

ODD = ["a", "b", "The", "'s", "'T", " ", "  ", "\n", "\n\n", "\t", "\x85", "\xa0", "　", "\x1c", "12", "!", "é",
       "é", "́", "İ", "Σ", "日本", "<|endoftext|>", "<|startoftext|>", ".", "​", "😀", "aaaa", "½"]
TEXTS = st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), min_size=1, max_size=8)


# Sharding ------------------------------------------------------------------------------------------


def slow_fill(shards, size):
    """Turn by turn: the whole preference list of each shard, searched from its start."""
    order = [[(o + j * s) % size for j in range(size)] for o, s in sharding.preferences(shards, size)]
    owner = {}
    while len(owner) < size:
        for i in range(len(shards)):
            free = next((slot for slot in order[i] if slot not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[slot] for slot in range(size)]


@pytest.mark.parametrize("n, size", [(1, 2), (3, 7), (5, 101), (16, 211), (7, 7)])
def test_fill_takes_turns(n, size):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.fill(shards, size) == slow_fill(shards, size)


def test_fill_is_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    before = sharding.fill(shards, 10_007)
    counts = Counter(before).values()
    assert max(counts) - min(counts) <= 1
    after = sharding.fill(shards[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after) if b != 19 and a != 19)
    assert moved < 0.05 * 10_007
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 11)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 12)


def test_placement_of_all_documents(spark):
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    import hashlib

    owner = sharding.fill(sorted(sharding.SHARDS))
    names = sorted(sharding.SHARDS)
    assert len(rows) == 1000
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])


def test_shards_on_disk(spark, frame, tmp_path):
    placed = sharding.place(frame([(i, "x") for i in range(50)]), shards=["a", "b"], size=11)
    sharding.write_shards(placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}


# Language ------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    rows = QUERIES["op2_language_mixture"](spark, SF)
    docs = shared.documents(spark, SF)
    held = rows.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(held) > 150
    for r in held:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert rows.count() == docs.count()


def slow_mixture(table, weight, rounds):
    share = np.ones(table.shape[1]) / table.shape[1]
    for _ in range(rounds):
        part = table * share
        share = (part / part.sum(1, keepdims=True) * weight[:, None]).sum(0) / weight.sum()
        share = np.maximum(share, 1e-9)
        share /= share.sum()
    return share


def test_mixture_of_each_document():
    rng = np.random.default_rng(1)
    table = rng.random((60, 3)).astype(np.float32)
    weight = rng.integers(1, 9, 60).astype(np.float32)
    bounds = np.array([0, 20, 20, 45, 60])
    share, _ = language.mixture(table, weight, bounds, np.ones((4, 3)))
    for i in (0, 2, 3):
        a, b = bounds[i], bounds[i + 1]
        assert np.allclose(share[i], slow_mixture(table[a:b], weight[a:b], language.ROUNDS), atol=1e-4)


def test_mixed_documents_have_two_languages(spark):
    docs = shared.documents(spark, SF)
    model = language.fit(docs)
    texts = {}
    for r in docs.where("length(text) > 2500").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], r["text"][:2500])
    rows = spark.createDataFrame([(0, texts["de"] + " " + texts["fr"][:1200]), (1, texts["de"])], "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r for r in language.predict(rows, model).collect()}
    assert found[0]["n_langs"] == 2 and found[0]["lang_pred"] == "de" and 0.5 < found[0]["score"] < 0.85
    assert found[1]["n_langs"] == 1 and found[1]["score"] > 0.95


def slow_trigrams(text):
    folded, out = [], []
    for b in text.encode():
        c = b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 0
        if c or not folded or folded[-1]:
            folded.append(c)
    for i in range(len(folded) - 2):
        three = folded[i : i + 3]
        if any(three):
            out.append(((three[0] << 16 | three[1] << 8 | three[2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    return out


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_trigrams_stay_within_their_text(texts):
    (_, _, data, bounds), = spans.slices(pa.array(texts)) if texts else ((0, 0, None, None),)
    buckets, edges = language.trigrams(data, bounds)
    assert [buckets[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [slow_trigrams(t) for t in texts]


# Tokens --------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_give_the_library_ids(texts):
    encoder = encoding.encoder(BPE)
    found = [ids.tolist() for ids in encoder.encode(pa.array([*texts, None]))]
    assert found == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_merging_counts_the_library_tokens(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    found = token_counts.merges(WORD).count_texts(pa.array([*texts, None])).tolist()
    assert found == [len(library.encode(t, add_special_tokens=False).ids) for t in [*texts, ""]]


def test_merging_of_long_words():
    from tokenizers import Tokenizer

    library, table = Tokenizer.from_file(WORD), token_counts.merges(WORD)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abehinorst", k=n)) for n in (255, 256, 257, 2000)] + ["a" * 3000]
    assert table.count_texts(pa.array(texts)).tolist() == [len(library.encode(t).ids) for t in texts]
    short = [t[:200] for t in texts]
    alone = [table.merge_long([table.vocab[c] for c in t[:-1]] + [table.vocab[t[-1] + "</w>"]]) for t in short]
    assert table.count_texts(pa.array(short)).tolist() == alone


def test_counts_of_all_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] for r in shared.documents(spark, "/root/testdata/sf0.001").collect()}
    for r in QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001").collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


# Wavelet matrix ------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=300), max_size=6), st.integers(0, 70_000))
def test_shard_answers(docs, other):
    ids = [np.array(d, np.uint32) for d in docs]
    shard = wavelet.Shard(wavelet.pack(list(range(len(ids))), ids))
    flat = [i for d in docs for i in d]
    assert shard.decode().tolist() == flat
    for token in {*flat[:3], other}:
        places = [i for i, x in enumerate(flat) if x == token]
        assert shard.occurrences(token) == places and shard.count(token) == len(places)
        half = len(flat) // 2
        assert shard.rank(token, half) == sum(p < half for p in places)
        with pytest.raises(IndexError):
            shard.select(token, len(places))
    for i in range(0, len(flat), 37):
        assert shard.access(i) == flat[i]


def test_shards_of_all_documents(spark):
    rows = sorted(QUERIES["op3_wavelet_matrix"](spark, "/root/testdata/sf0.001").collect())
    library, at = encoding.encoder(BPE).tokenizer, 0
    texts = shared.documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [t["doc_id"] for t in texts]
    for r, t in zip(rows, texts):
        ids = [*library.encode(t["text"], add_special_tokens=False).ids, 2]
        assert tuple(r)[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# Packing -------------------------------------------------------------------------------------------


def fewest(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j, room in enumerate(bins):
            if room >= items[i] and room not in bins[:j]:
                go(i + 1, [*bins[:j], room - items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_packing_is_as_small_as_can_be(items):
    fillings = packing.solve(Counter(items), 20)
    held = Counter()
    for filling, times in fillings:
        assert sum(filling) <= 20
        for x in filling:
            held[x] += times
    assert held == Counter(items)
    assert sum(n for _, n in fillings) == fewest(sorted(items, reverse=True), 20)


def test_packing_tries_fillings_of_equal_sum():
    """Beside 60, both (25, 15) and (14, 13, 13) fill 40 and neither holds the other; only the second leads to 3."""
    items = [60, 55, 50, 35, 25, 20, 15, 14, 13, 13]
    fillings = packing.solve(Counter(items), 100)
    assert sum(n for _, n in fillings) == 3
    assert Counter(x for filling, n in fillings for x in filling * n) == Counter(items)


@pytest.mark.parametrize("n", [60, 200])
def test_packing_finds_a_full_one_again(n):
    """Sequences of 1,024 cut at random places; best fit alone takes one more."""
    rng, items = random.Random({60: 1, 200: 2}[n]), []
    for _ in range(n):
        cuts = sorted(rng.sample(range(1, 1024), rng.choice([1, 2, 3])))
        items += [b - a for a, b in zip([0, *cuts], [*cuts, 1024])]
    assert sum(k for _, k in packing.best_fit(Counter(items), 1024)) == n + 1
    assert sum(k for _, k in packing.solve(Counter(items), 1024)) == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7), st.integers(20, 30))
def test_only_dominated_fillings_are_left_out(items, space):
    """Against all fillings and all ways to group one's pieces into another's."""
    counts = Counter(items)
    every = {tuple(sorted((x for i, x in enumerate(items) if m >> i & 1), reverse=True)) for m in range(1 << len(items))}
    every = {f for f in every if sum(f) <= space}

    def into(pieces, rooms):
        if not pieces:
            return True
        return any(
            r >= pieces[0] and into(pieces[1:], [*rooms[:i], r - pieces[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms)
        )

    wanted = {f for f in every if not any(g != f and into(f, list(g)) for g in every)}
    assert set(packing.completions(counts, space, space, iter(range(10**6)))) == wanted


@given(st.integers(1, 5000), st.integers(1, 64))
def test_cut(n, capacity):
    pieces = packing.cut(n, capacity)
    assert sum(k for _, k in pieces) == n and all(k == capacity for _, k in pieces[1:])
    assert [a for a, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1].tolist()]


def check_packed(rows, texts):
    """Pieces are those of the texts, sequences are gapless and as few as the lower bound or best fit."""
    library = encoding.encoder(BPE).tokenizer
    wanted, lengths = Counter(), []
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        for i, (a, n) in enumerate(packing.cut(len(ids))):
            wanted[key, i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
            lengths.append(n)
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in names) for r in rows) == wanted
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY
    assert len(by_sequence) <= sum(n for _, n in packing.best_fit(Counter(lengths), packing.CAPACITY))


def test_packing_of_all_documents(spark):
    rows = QUERIES["op6_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = shared.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    check_packed(rows, texts)


def test_sequences_hold_the_ids_of_their_pieces(spark, frame, tmp_path):
    library = encoding.encoder(BPE).tokenizer
    texts = [(i, t) for i, t in AWKWARD if i is not None and i < 20]
    packed = shared.written(packing.pack(frame(texts), BPE), "test-packed")
    packing.write_sequences(packed, f"{tmp_path}/out")
    out = {r["sequence_id"]: r["ids"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    found, places, pieces = defaultdict(dict), defaultdict(int), packed.collect()
    for r in pieces:
        ids = out[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids == r["ids"]
        found[r["doc_id"]][r["start"]] = ids
        places[r["sequence_id"]] += r["length"]
    assert {k: len(v) for k, v in out.items()} == places and max(places.values()) <= packing.CAPACITY
    for i, text in texts:
        whole = [x for _, ids in sorted(found[i].items()) for x in ids]
        assert whole == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    sums = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.digests(packed).collect()}
    assert sums == {(r["doc_id"], r["piece"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces}


def test_pieces_leave_python_in_small_batches(frame, monkeypatch):
    whole = sorted(map(tuple, packing.pack(frame(AWKWARD[3:16]), BPE).select("doc_id", "piece", "ids").collect()))
    monkeypatch.setattr(packing, "IDS_AT_ONCE", 1)
    assert sorted(map(tuple, packing.pack(frame(AWKWARD[3:16]), BPE).select("doc_id", "piece", "ids").collect())) == whole


# Compaction ----------------------------------------------------------------------------------------


def test_cleaned_texts(frame):
    texts = [(1, LONG), (2, "before\n" + LONG + "  after it"), (3, LONG), (4, None), (5, "two  words")]
    rows = {r["doc_id"]: r["text"] for r in debruijn.cleaned(frame(texts)).collect()}
    assert rows == {1: LONG, 2: "before after it", 3: "", 4: "", 5: "two words"}


# Links ---------------------------------------------------------------------------------------------


def plain_components(n, links):
    name = list(range(n))
    for _ in range(n):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return name


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(60, 90)]
    found = components.components(spark.createDataFrame(links, "u BIGINT, v BIGINT")).collect()
    name = plain_components(91, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r["node"], r["component"]) for r in found) == sorted((x, name[x]) for x in linked)


def test_a_large_group_of_near_copies(spark, frame):
    """A chain and a star of near copies, copies of one prefix, and a passage that others share."""
    rng = random.Random(4)
    base = prose(8, 120).split()
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [prose(100 + i, 30) + " " + LONG + " " + prose(200 + i, 25) for i in range(30)]
    chain = prose(9, 100).split()
    for i in range(12):
        texts.append(" ".join(chain[i * 6 :] + [f"end{i}x{j}" for j in range(i * 6)]))
    texts += ["a b", "a b", "b a", "", None]
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if shingles[i] and shingles[j] and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j])
    ]
    name = plain_components(len(texts), links)
    rows = jaccard.members(frame(list(enumerate(texts)))).collect()
    assert {r["doc"]: (r["n"], r["component"]) for r in rows} == {i: (len(s), name[i]) for i, s in enumerate(shingles)}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1, max_size=200), st.sets(st.integers(0, 500), min_size=1, max_size=200))
def test_parity_never_rules_out_too_much(a, b):
    x, y = (np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (a, b))
    assert jaccard.most_common(jaccard.parity(x), jaccard.parity(y), len(a) + len(b)) >= len(a & b)


# Pipeline ------------------------------------------------------------------------------------------


def test_pipeline_on_awkward_rows(spark, tables):
    import re

    import corpus_pipeline

    rows = [(i, t, "en") for i, t in AWKWARD if i is not None][:-1] + [(30, prose(40, 200) + " the end", "en")]
    item = " ".join(prose(40, 200).split()[50:70])
    folder = tables(rows, [(1, item)])
    packed = corpus_pipeline.run(spark, folder).collect()
    kept = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    first, exact = {}, []
    for i, t in sorted(kept, key=lambda r: (-len(r[1]), r[0])):
        if (n := re.sub(r"[\x20\x09-\x0D]+", "", t)) not in first:
            first[n] = i
            exact.append((i, t))

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    near = []
    for i, t in sorted(exact):
        if not any(100 * len(grams(t) & g) >= 75 * len(grams(t) | g) for _, _, g in near):
            near.append((i, t, grams(t)))
    clean = [(i, t) for i, t, _ in near if item not in t]
    assert len(clean) < len(near) < len(exact) < len(kept)
    check_packed(packed, clean)


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = shared.documents(spark, "/root/testdata/sf0.001")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "benchmark", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.join(docs.select(F.col("doc_id"), F.col("text").alias("was")), "doc_id").where("text <=> was").count() == out.count()
