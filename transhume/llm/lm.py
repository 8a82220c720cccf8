"""Language-model scores from a log-frequency Bloom filter.

The model counts words and pairs of words of the training texts.  A count c is held as its level,
1 + floor(log2 c): the filter contains the entries (n-gram, 1), (n-gram, 2) .. up to the level.  To read a
count back, the entries are probed one after the other until one is missing; the level of the last one found
stands for the middle of the counts that share it.  A probability is smoothed with a Dirichlet prior,

    p(w | v) = (C(v w) + PRIOR * p(w)) / (C(v) + PRIOR),    p(w) = (C(w) + ADD) / (N + ADD * (V + 1)),

and a text's score is the sum of log10 p over its words and its end; before the first word stands an end.
Beside that, the base score uses the exact counts of single words.

Counting: tasks combine what they see in COMBINED n-grams, deal it to segments by hash, each a row of packed
arrays, and each segment is added up and kept as one row.  Segments follow the size of the corpus, so none outgrows a task.

The filter: 1,024 parts by hash of the n-gram, all of one width, put together by Spark and sent to every
worker.  It has a width in proportion to its entries up to MOST_WORDS words of 64 bits (128 MB).  Where
more would be needed, the n-grams of the lowest levels stay out, and the filter begins at a higher level.
Places whose pair the filter doesn't have are then resolved by joins with the table of these rare n-grams,
so nothing is dropped at any size.  A missing entry is taken for present in about one of fifty cases.

Exact counts: the most frequent words (COMMON at most) are sent to every worker; the others of each text
are joined with the table of counts.

A null text is empty and has one token, the end.  A null id is in training, and held_out is false for it.
Every row gives a row, repeated ones too.  An empty table gives none.  Without a word of training N is 0;
base and score are then log10 of 0.1 / 0.1 a token, 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared, spans

ADD = 0.1
PRIOR = 8.0
#: Bits set for an entry, all in one word, and bits of the filter for each entry.
BITS_SET = 4
BITS = 10
PARTS = 1 << 10
#: 64-bit words of the whole filter at most: 128 MB.
MOST_WORDS = 1 << 24
#: Exact counts that are sent to every worker at most: 16 MB.
COMMON = 1 << 20
#: Bytes of text for each segment of counts.
SEGMENT_BYTES = 4 << 20
#: Bytes of text counted at once, and distinct n-grams that a task holds before it sends them.
AT_ONCE = 4 << 20
COMBINED = 1_500_000

END = np.uint64(0x51ED270B0A3F7C95)
COUNTS = "segment BIGINT, word_keys BINARY, word_counts BINARY, pair_keys BINARY, pair_counts BINARY"
TABLES = (
    "segment BIGINT, word_keys BINARY, word_counts BINARY, pair_keys BINARY, pair_levels BINARY, "
    "entries ARRAY<BIGINT>, words ARRAY<BIGINT>, tokens BIGINT"
)
PIECES = "part INT, bits BINARY"
SCORED = (
    "row BIGINT, doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base DOUBLE, score DOUBLE, "
    "rare_keys ARRAY<BIGINT>, rare_times ARRAY<BIGINT>, "
    "open ARRAY<STRUCT<pair: BIGINT, before: BIGINT, word: BIGINT, before_level: INT, word_level: INT>>"
)
LEVELS = 64


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def level(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n) of counts above 0."""
    return (np.frexp(n.astype(np.float64))[1]).astype(np.uint8)


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    x = levels.astype(np.float64)
    return np.where(levels > 0, (np.exp2(x - 1) + np.exp2(x) - 1) / 2, 0.0)


def tokens(hasher: spans.Hasher, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the words of all texts, an end after each text."""
    starts, ends, first = spans.words(data, bounds)
    hashes = np.insert(hasher(data, starts, ends), first[1:], END)
    return hashes, first + np.arange(len(first))


def pairs(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what stands before each token, the key of the two)."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[bounds[:-1]] = END
    return before, spans.mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes + np.uint64(1))


def _part(keys: np.ndarray) -> np.ndarray:
    return (spans.mixed(keys) >> np.uint64(54)).astype(np.int64)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


class _Sums:
    """Counts of n-grams of one kind, combined as they come."""

    def __init__(self):
        self.keys, self.n, self.more = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        self.more.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in self.more) > len(self.keys) // 2:
            self.combine()

    def combine(self) -> None:
        keys, n = zip((self.keys, self.n), *self.more)
        self.keys, self.n = _added(np.concatenate(keys), np.concatenate(n))
        self.more = []

    def dealt(self, fine: int) -> dict[int, tuple[bytes, bytes]]:
        """What there is as packed arrays by segment: a part of the filter, and a share of that."""
        self.combine()
        segment = _part(self.keys) * fine + (self.keys % np.uint64(fine)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        keys, n, segment = self.keys[order], self.n[order], segment[order]
        found, first = np.unique(segment, return_index=True)
        edges = np.append(first, len(segment)).tolist()
        self.__init__()
        return {s: (keys[a:b].tobytes(), n[a:b].tobytes()) for s, a, b in zip(found.tolist(), edges, edges[1:])}


def _counter(fine: int):
    def sent(words: _Sums, both: _Sums) -> pa.RecordBatch:
        one, two = words.dealt(fine), both.dealt(fine)
        segments = sorted({*one, *two})
        columns = [pa.array(segments, pa.int64())]
        for packed in (one, two):
            found = [packed.get(s, (b"", b"")) for s in segments]
            columns += [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "word_keys", "word_counts", "pair_keys", "pair_counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = spans.Hasher(fold=True)
        words, both = _Sums(), _Sums()
        for batch in batches:
            for _, _, data, bounds in spans.slices(batch.column(0), AT_ONCE):
                hashes, edges = tokens(hasher, data, bounds)
                words.add(hashes)
                both.add(pairs(hashes, edges)[1])
                if len(both.keys) > COMBINED:
                    yield sent(words, both)
        yield sent(words, both)

    return count


def _segment(rows: pa.Table) -> pa.Table:
    """One segment: its words with exact counts, its pairs with levels, and how many are on each level."""

    def whole(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

    words, counts = _added(whole("word_keys", np.uint64), whole("word_counts", np.int64))
    both, times = _added(whole("pair_keys", np.uint64), whole("pair_counts", np.int64))
    by_word = np.bincount(level(counts), minlength=LEVELS + 1)
    by_level = by_word + np.bincount(level(times), minlength=LEVELS + 1)
    return pa.table(
        {
            "segment": rows.column("segment")[:1].combine_chunks(),
            "word_keys": pa.array([words.tobytes()], pa.binary()),
            "word_counts": pa.array([counts.tobytes()], pa.binary()),
            "pair_keys": pa.array([both.tobytes()], pa.binary()),
            "pair_levels": pa.array([level(times).tobytes()], pa.binary()),
            "entries": pa.array([by_level.tolist()], pa.list_(pa.int64())),
            "words": pa.array([by_word.tolist()], pa.list_(pa.int64())),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
        }
    )


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segment, keys, levels) of the words and pairs of each segment."""
    names = ("segment", "word_keys", "word_counts", "pair_keys", "pair_levels")
    for segment, *raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
        words, counts, both = (np.frombuffer(x, "<i8") for x in raw[:3])
        yield segment, np.concatenate([words, both]), np.concatenate([level(counts), np.frombuffer(raw[3], np.uint8)])


def probes(keys: np.ndarray, step: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word within the part, mask of bits) of the entries (key, step)."""
    h = spans.mixed(keys + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    mask = np.zeros(len(keys), np.uint64)
    for i in range(BITS_SET):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return (h >> np.uint64(32)) % np.uint64(width), mask


def _filler(fine: int, least: int, width: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, keys, levels in _grams(batch):
                bits = np.zeros(width, np.uint64)
                keys, levels = keys.view(np.uint64)[levels >= least], levels[levels >= least]
                for step in range(least, int(levels.max(initial=0)) + 1):
                    at, mask = probes(keys[levels >= step], step, width)
                    np.bitwise_or.at(bits, at, mask)
                yield _piece([segment // fine], [bits])

    return fill


def _piece(parts: list[int], bits: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(parts, pa.int32()), pa.array([b.astype("<u8").tobytes() for b in bits], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "bits"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each part laid over each other, as they stream by."""
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bits = np.frombuffer(raw, "<u8")
            whole[part] = whole[part] | bits if part in whole else bits
    for part, bits in whole.items():
        yield _piece([part], [bits])


def _words(low: int, high: int):
    """The words whose count is in [low, high), with it."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")
                some = (counts >= low) & (counts < high)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some])], names=["key", "n"])

    return give


def _rare(least: int):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, levels in _grams(batch):
                some = levels < least
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(levels[some].astype(np.int32))], names=["key", "level"])

    return give


@dataclass
class Model:
    """What workers need: the filter, the common words, and the totals.  Its tables stay in the shared folder."""

    tables: DataFrame
    #: The filter holds n-grams from this level on; 1 means all.
    least: int
    width: int
    bits: np.ndarray
    common: np.ndarray
    counts: np.ndarray
    #: Words with a smaller count are not among the common ones; 1 means there are none.
    rare_below: int
    total: int
    distinct: int

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing until an entry is missing."""
        out = np.zeros(len(keys), np.uint8)
        base = _part(keys) * self.width
        alive = np.arange(len(keys))
        for step in range(self.least, LEVELS + 1):
            at, mask = probes(keys[alive], step, self.width)
            hit = self.bits[base[alive] + at.astype(np.int64)] & mask == mask
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = step
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """The count of each common word, 0 for all others."""
        if not len(self.common):
            return np.zeros(len(keys), np.int64)
        keys = spans.signed(keys)
        at = np.searchsorted(self.common, keys)
        at[at == len(self.common)] = 0
        return np.where(self.common[at] == keys, self.counts[at], 0)

    @property
    def mass(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def probability(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p of a word from the levels of the pair, of the word before, and of the word."""
        lone = np.minimum((middle(word) + ADD) / self.mass, 1.0)
        context = middle(before)
        return np.log10((np.minimum(middle(pair), context) + PRIOR * lone) / (context + PRIOR))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS, common: int = COMMON) -> Model:
    """The model of the texts that are not held out."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = _rows(docs, key, text).where(~held_out("doc_id")).select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fine = max(1, size // (PARTS * SEGMENT_BYTES))
    seen = rows.mapInArrow(spans.tidy(_counter(fine)), COUNTS)
    tables = shared.written(seen.groupBy("segment").applyInArrow(_segment, TABLES), "lm-counts")

    def by_level(column: str) -> np.ndarray:
        out = np.zeros(LEVELS + 1, np.int64)
        flat = tables.select(F.posexplode(column).alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
        for row in flat.collect():
            out[row["level"]] = row["n"]
        return out

    grams, words = by_level("entries"), by_level("words")
    steps = np.arange(LEVELS + 1)

    def width_from(least: int) -> int:
        entries = int((grams * np.maximum(steps - least + 1, 0)).sum())
        return -(-entries * BITS // (64 * PARTS)) or 1

    least = next((x for x in range(1, LEVELS + 1) if width_from(x) * PARTS <= most_words), LEVELS)
    width = width_from(least)
    pieces = tables.select("segment", "word_keys", "word_counts", "pair_keys", "pair_levels")
    pieces = pieces.mapInArrow(spans.tidy(_filler(fine, least, width)), PIECES)
    bits = np.zeros(PARTS * width, np.uint64)
    found = pieces.repartition("part").mapInArrow(spans.tidy(_unite), PIECES).toArrow()
    for part, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        bits[part * width : (part + 1) * width] = np.frombuffer(raw, "<u8")

    first = next(x for x in range(1, LEVELS + 2) if words[x:].sum() <= common)
    rare_below = 1 << (first - 1)
    high = 1 << 62
    known = tables.select("word_keys", "word_counts").mapInArrow(_words(rare_below, high), "key BIGINT, n BIGINT").toArrow()
    keys, counts = (known.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(keys)
    total = tables.agg(F.sum("tokens")).first()[0] or 0
    return Model(tables, least, width, bits, keys[order], counts[order], rare_below, int(total), int(words.sum()))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values; each has an end at least."""
    return np.add.reduceat(values, bounds[:-1])


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    edges = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), values if isinstance(values, pa.Array) else pa.array(values))


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        hasher = spans.Hasher(fold=True)
        for batch in batches:
            for lo, hi, data, bounds in spans.slices(batch.column(2)):
                n = hi - lo
                hashes, edges = tokens(hasher, data, bounds)
                owner = np.repeat(np.arange(n), np.diff(edges))
                words, place = np.unique(hashes, return_inverse=True)
                exact, lone = model.exact(words), model.lookup(words)
                base = np.log10((exact + ADD) / model.mass)[place]
                before, both = pairs(hashes, edges)
                distinct, at = np.unique(both, return_inverse=True)
                pair = model.lookup(distinct)[at]
                word = lone[place]
                previous = np.empty_like(word)
                previous[1:] = word[:-1]
                previous[edges[:-1]] = model.lookup(np.array([END]))[0]
                value = model.probability(pair, previous, word)
                # what the filter may lack for want of room is left to the joins
                left = np.flatnonzero(pair == 0) if model.least > 1 else np.zeros(0, np.int64)
                value[left] = 0.0
                rare = np.flatnonzero(exact[place] == 0) if model.rare_below > 1 else np.zeros(0, np.int64)
                # by text, then by word, each once with the times it occurs
                rare = rare[np.lexsort((place[rare], owner[rare]))]
                new = np.ones(len(rare), bool)
                new[1:] = (place[rare[1:]] != place[rare[:-1]]) | (owner[rare[1:]] != owner[rare[:-1]])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                rare = rare[first]
                open_ = pa.StructArray.from_arrays(
                    [
                        pa.array(spans.signed(both[left])),
                        pa.array(spans.signed(before[left])),
                        pa.array(spans.signed(hashes[left])),
                        pa.array(previous[left].astype(np.int32)),
                        pa.array(word[left].astype(np.int32)),
                    ],
                    names=["pair", "before", "word", "before_level", "word_level"],
                )
                columns = [
                    batch.column(0).slice(lo, n),
                    batch.column(1).slice(lo, n),
                    pa.array(np.diff(edges)),
                    pa.array(_sums((exact > 0)[place].astype(np.int64), edges)),
                    pa.array(_sums(base, edges)),
                    pa.array(_sums(value, edges)),
                    _lists(spans.signed(hashes[rare]), owner[rare], n),
                    _lists(times.astype(np.int64), owner[rare], n),
                    _lists(open_, owner[left], n),
                ]
                names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare_keys", "rare_times", "open"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return score


def _middle(levels: Column) -> Column:
    x = levels.cast("double")
    return F.when(levels > 0, (F.pow(2.0, x - 1) + F.pow(2.0, x) - 1) / 2).otherwise(0.0)


def _resolved(scored: DataFrame, model: Model) -> DataFrame:
    """(row, more): log10 p of the places left open, by joins with the n-grams the filter has no room for."""
    rare = model.tables.select("segment", "word_keys", "word_counts", "pair_keys", "pair_levels")
    rare = rare.mapInArrow(_rare(model.least), "key BIGINT, level INT")
    places = scored.select("row", F.explode("open").alias("o")).select("row", "o.*")
    for name in ("before", "word"):
        # what the filter knows needs no partner; it is dealt out evenly
        known = F.col(f"{name}_level") > 0
        places = places.withColumn(name, F.when(known, F.xxhash64("pair", F.lit(name))).otherwise(F.col(name)))
    for name in ("pair", "before", "word"):
        found = rare.select(F.col("key").alias(name), F.col("level").alias(f"{name}_found"))
        places = places.join(found, name, "left")
    levels = {
        "pair": F.coalesce("pair_found", F.lit(0)),
        **{c: F.greatest(f"{c}_level", F.coalesce(f"{c}_found", F.lit(0))) for c in ("before", "word")},
    }
    lone = F.least((_middle(levels["word"]) + ADD) / model.mass, F.lit(1.0))
    context = _middle(levels["before"])
    p = (F.least(_middle(levels["pair"]), context) + PRIOR * lone) / (context + PRIOR)
    return places.groupBy("row").agg(F.sum(F.log10(p)).alias("more"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    lean = Model(None, *(getattr(model, f) for f in list(Model.__dataclass_fields__)[1:]))
    sent = spark.sparkContext.broadcast(lean)
    rows = _rows(docs, key, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = shared.written(rows.mapInArrow(spans.tidy(_scorer(sent)), SCORED), "lm-scored")
    sent.destroy()
    out = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    if model.rare_below > 1:
        words = model.tables.select("word_keys", "word_counts").mapInArrow(_words(1, model.rare_below), "key BIGINT, n BIGINT")
        rare = scored.select("row", F.explode(F.arrays_zip("rare_keys", "rare_times")).alias("r"))
        rare = rare.select("row", F.col("r.rare_keys").alias("key"), F.col("r.rare_times").alias("times"))
        gain = F.col("times") * (F.log10(F.col("n") + ADD) - F.log10(F.lit(ADD)))
        more = rare.join(words, "key").groupBy("row").agg(F.sum(gain).alias("gain"), F.sum("times").alias("known"))
        out = out.join(more, "row", "left").withColumns(
            {"base": F.col("base") + F.coalesce("gain", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("known", F.lit(0))}
        )
    if model.least > 1:
        out = out.join(_resolved(scored, model), "row", "left")
        out = out.withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
