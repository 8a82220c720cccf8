"""Removal of long repeated spans by compaction of a De Bruijn graph over words.

Every 13 words in a row are an edge, between the nodes of its first and its last 12.  Only edges that start
in two documents or more matter.

Documents with the same words are found first, by a hash over all their windows in order: the path of a
copy is that of its first document from end to end, so a copy goes whole and only firsts enter the graph.

1. A window of 13 words has as its fingerprint the least hash of the 6-word runs in it, which neighbours
   mostly share.  The fingerprints of each document are joined up, and those in more than one document
   go into a bit set of limited size.
2. Windows with such a fingerprint become edges, with the place of each occurrence (document and word) and the
   edge that follows there.  Edges are grouped: their number, their source (the first document, and the first
   place in it), and whether one same edge always follows.
3. An edge and its follower compact where no path branches: the follower is always the same, both occur
   equally often, and their sources are neighbours.  Since each occurrence of the one then stands beside one
   of the other, a compacted path is a stretch of its source document, and wherever its first edge occurs
   all of it does.
4. The first edges of the paths are joined with their occurrences.  The last edge must occur at the matching
   place, which verifies the span by its coordinates.  Spans in other documents than the source are removed.

A word is removed if a window over it starts in a document with a smaller id as well; windows are those of
the input.  Hashes of words and windows have 64 bits.

A null text has no words.  A row without id has no order: it keeps all words and removes none elsewhere.
Rows that repeat an id don't remove each other's words, and each is judged by its own text.  A text of fewer
than 13 words is kept whole.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transhume.llm import shared, spans

WINDOW = 13
GRAM = 6
#: A place is 32 bits of the text's hash, then 31 bits for the number of the word.
WORD_BITS = 31
#: The largest filter: 2**22 words, about 100 MB where it is broadcast.
MOST_FILTER_WORDS = 1 << 22
#: No edge follows.
NONE = np.int64(np.iinfo(np.int64).min)

SEQUENCES = "doc BIGINT, t BIGINT, sequence BIGINT, words BIGINT"
PRINTS = "print BIGINT, doc BIGINT"
RUNS = "print BIGINT, doc BIGINT, place BIGINT, edges ARRAY<BIGINT>, next BIGINT"
ROWS = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, text STRING"


def windows(column: pa.Array, hasher: spans.Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each window, its first word, its hash, its fingerprint) of runs of texts."""
    for lo, hi, data, bounds in spans.slices(column):
        starts, ends, first = spans.words(data, bounds)
        hashes = hasher(data, starts, ends)
        if len(hashes) < WINDOW:
            continue
        owner = np.repeat(np.arange(hi - lo), np.diff(first))
        whole = spans.runs_of(hashes, WINDOW)
        grams = spans.runs_of(hashes, GRAM)
        two = np.minimum(grams[:-1], grams[1:])
        four = np.minimum(two[:-2], two[2:])
        least = np.minimum(four[:-4], four[4:])  # of WINDOW - GRAM + 1 = 8
        at = np.arange(len(whole))
        inside = owner[: len(whole)] == owner[at + WINDOW - 1]
        rows = owner[: len(whole)][inside]
        if len(rows):
            yield lo, rows, (at - first[owner[: len(whole)]])[inside], whole[inside], least[inside]


def _runs(rows: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Where a run of one fingerprint in one text begins."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (prints[1:] != prints[:-1])
    return np.flatnonzero(new)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with a window: a hash that depends on all its words in order, and their number."""
    hasher = spans.Hasher()
    for batch in batches:
        for lo, rows, words, whole, _ in windows(batch.column(2), hasher):
            at = _runs(rows, np.zeros(len(rows)))
            placed = spans.mixed(whole ^ spans.mixed(words.astype(np.uint64) + np.uint64(1)))
            sums = spans.mixed(np.add.reduceat(placed, at)) if len(at) else placed
            count = np.diff(np.append(at, len(rows))) + WINDOW - 1
            chosen = pa.array(lo + rows[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(spans.signed(sums)), pa.array(count)],
                names=["doc", "t", "sequence", "words"],
            )


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = spans.Hasher()
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for lo, rows, _, _, prints in windows(batch.column(2), hasher):
            at = _runs(rows, prints)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans.signed(prints[at])), pa.array(docs[lo + rows[at]])], names=["print", "doc"]
            )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = spans.Hasher()
    for batch in batches:
        docs, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, rows, words, whole, prints in windows(batch.column(2), hasher):
            at = _runs(rows, prints)
            ends = np.append(at[1:], len(rows))
            whole = np.where(spans.signed(whole) == NONE, 0, spans.signed(whole))
            after = np.append(whole[1:], NONE)
            after[:-1][rows[1:] != rows[:-1]] = NONE
            place = ((texts[lo + rows[at]] & 0x7FFFFFFF) << WORD_BITS) + words[at]
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(rows)), pa.int32()), pa.array(whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans.signed(prints[at])), pa.array(docs[lo + rows[at]]), pa.array(place), lists, pa.array(after[ends - 1])],
                names=["print", "doc", "place", "edges", "next"],
            )


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), shared.text_hash(text).alias("t"), F.col(text).alias("text"))


def _filter(hashes: DataFrame, key: str, label: str) -> tuple[DataFrame, int]:
    """A bit set with about 16 bits for each member, within its limits."""
    n, words = hashes.count(), shared.FILTER_WORDS
    while words < MOST_FILTER_WORDS and words * 4 < n:
        words *= 2
    return shared.written(shared.filter_of(hashes, key, words), label), words


def copies(rows: DataFrame) -> DataFrame:
    """(doc, t, words) of the documents whose words are those of a document with a smaller id."""
    found = shared.written(rows.where("doc is not null").mapInArrow(spans.tidy(_sequences), SEQUENCES), "debruijn-sequences")
    firsts = found.groupBy("sequence").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # a table of its own, so that Spark can split the join where one document has very many copies
    firsts = shared.written(firsts.select("sequence", "first"), "debruijn-firsts")
    later = found.join(firsts, "sequence").where("doc > first")
    return shared.written(later.select("doc", "t", "words"), "debruijn-copies")


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc, place, edges, next): runs of windows that may start in several documents."""
    known = rows.where("doc is not null")
    prints = known.mapInArrow(spans.tidy(_prints), PRINTS)
    several = prints.groupBy("print").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    several = shared.written(several.select("print"), "debruijn-prints")
    bits, words = _filter(several, "print", "debruijn-filter")
    runs = known.mapInArrow(spans.tidy(_edges), RUNS)
    return shared.written(shared.maybe_in(runs, F.col("print"), bits, words).drop("print"), "debruijn-runs")


def edges_of(runs: DataFrame) -> DataFrame:
    """(edge, doc, place, next) of every occurrence."""
    follow = F.concat(F.slice("edges", 2, F.size("edges")), F.array("next"))
    each = runs.select("doc", "place", F.posexplode(F.arrays_zip("edges", follow.alias("after"))).alias("i", "e"))
    return each.select(F.col("e.edges").alias("edge"), "doc", (F.col("place") + F.col("i")).alias("place"), F.col("e.after").alias("next"))


def paths(runs: DataFrame) -> DataFrame:
    """(first, last, doc, place, m): compacted paths of m edges with their source."""
    grouped = edges_of(runs).groupBy("edge").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("doc", "place")).alias("source"),
        F.max("doc").alias("other"),
        F.min("next").alias("next"),
        F.max("next").alias("next_too"),
    )
    repeated = grouped.where("source.doc < other").select(
        "edge", "n", "source.doc", "source.place", F.when(F.col("next") == F.col("next_too"), F.col("next")).alias("next")
    )
    along = Window.partitionBy("doc").orderBy("place")
    joined = (
        (F.lag("place").over(along) + 1 == F.col("place"))
        & (F.lag("next").over(along) == F.col("edge"))
        & (F.lag("n").over(along) == F.col("n"))
    )
    marked = repeated.withColumn("opens", F.when(joined, 0).otherwise(1))
    numbered = marked.withColumn("path", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    made = numbered.groupBy("doc", "path").agg(
        F.min("place").alias("place"),
        F.count(F.lit(1)).alias("m"),
        F.min_by("edge", "place").alias("first"),
        F.max_by("edge", "place").alias("last"),
    )
    return shared.written(made.select("first", "last", "doc", "place", "m"), "debruijn-paths")


def repeated_spans(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, place, words) of every span whose path has its source in a document with a smaller id."""
    ends = found.select(F.col("first").alias("edge")).unionByName(found.select(F.col("last").alias("edge")))
    bits, words = _filter(ends, "edge", "debruijn-ends")
    near = shared.written(shared.maybe_in(edges_of(runs).drop("next"), F.col("edge"), bits, words), "debruijn-near")
    named = found.select("first", "last", "m", F.col("doc").alias("source"))
    opened = near.join(named, near["edge"] == named["first"]).where("doc > source")
    opened = opened.select("doc", "place", "m", "last", (F.col("place") + F.col("m") - 1).alias("close"))
    closing = near.select(F.col("edge").alias("_e"), F.col("doc").alias("_d"), F.col("place").alias("_p"))
    agree = (F.col("last") == F.col("_e")) & (F.col("doc") == F.col("_d")) & (F.col("close") == F.col("_p"))
    verified = opened.join(closing, agree, "left_semi")
    return verified.select("doc", "place", (F.col("m") + WINDOW - 1).alias("words"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, texts = [], [], []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            words = (text.as_py() or "").encode().split()
            kept = words
            if found:
                steps = np.zeros(len(words) + 1, np.int64)
                for span in found:
                    steps[span["at"]] += 1
                    steps[span["at"] + span["words"]] -= 1
                kept = [w for w, covered in zip(words, np.cumsum(steps[:-1]).tolist()) if not covered]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"],
        )


def spans_by_document(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t, text, found): every row with the word spans to remove, null where there are none."""
    shared.small_batches(docs.sparkSession)
    rows = _rows(docs, key, text)
    later = copies(rows)
    runs = occurrences(shared.without(rows, later, {"doc": "doc", "t": "t"}))
    found = paths(runs)
    whole = later.select(
        "doc",
        F.shiftleft(F.col("t").bitwiseAND(F.lit(0x7FFFFFFF)), WORD_BITS).alias("place"),
        "words",
    )
    cut = repeated_spans(runs, found).unionByName(whole)
    part = F.shiftright("place", WORD_BITS)
    at = F.col("place").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    lists = cut.groupBy("doc", part.alias("part")).agg(F.collect_set(F.struct(at.alias("at"), "words")).alias("found"))
    lists = shared.written(lists.withColumnRenamed("doc", "_doc"), "debruijn-spans")
    shared.drop_table(runs)
    parted = rows.withColumn("_part", F.col("t").bitwiseAND(F.lit(0x7FFFFFFF)))
    bits = shared.written(shared.filter_of(lists.select(F.xxhash64("_doc", "part").alias("k")), "k"), "debruijn-hit")
    seen = shared.marked(parted, F.xxhash64("doc", "_part"), bits)
    hit = seen.where("_maybe")
    hit = hit.join(lists, (hit["doc"] == lists["_doc"]) & (hit["_part"] == lists["part"]), "left")
    hit = hit.select("doc", "t", "text", "found")
    return hit.unionByName(seen.where("not _maybe").select("doc", "t", "text", F.lit(None).cast(lists.schema["found"].dataType).alias("found")))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the words that stay, a blank between two)."""
    return spans_by_document(docs, key, text).select("doc", "text", "found").mapInArrow(spans.tidy(_cut), ROWS)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the cleaned text)."""
    digest = F.sha2("text", 256).alias("kept_sha256")
    return cleaned(docs, key, text).select("doc_id", "n_words", "n_removed", digest)
