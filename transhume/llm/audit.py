"""Audit of how filters interact, by a stream that takes earlier verdicts back.

Five filters fail a text: A too few words, B too few distinct words, C too many capitals, D a sign of
markup, E a smaller id has the identical text.  A to D are seen in the text alone.  E is not: whether a
document is the first of its text is open until all files are read.

All files are read as a stream, some at a time (available now).  For each text, known by a 128-bit hash, the
state holds the least id so far and where its rows count.  The state is keyed by buckets of the hash, as many
as keep TEXTS texts to a bucket, whatever the number of texts: a call for each text would cost milliseconds,
and a bucket larger than that would be written again too often.  A document with a larger id fails E for good.  One with a smaller id takes over: the stream gives out its verdict, takes that of the former least id
back (a row with n = -1) and gives it anew with E.  What the stream wrote so sums up to the right counts after
every batch, and a batch that runs twice is written once, as the stream's log of files says.

Copies within a slice of a task are compared before they are dealt out: one row of each text goes to the
state, the others are certain to fail E and go elsewhere.  So a text that a third of all documents have is a
row for each slice.  The state's store is the session's (spark.sql.streaming.stateStore.providerClass).

The counters are the sums of n for each part, set of failed filters and label; labels are joined once, on the
narrow rows of the verdicts.  From the 32 counters of a part follow all 120 orders of the filters.

Null texts are empty; all of them are identical.  A null part is the empty text.  A document without id is no
smaller and no larger than others: it doesn't fail E, nor does anything fail for it.  Repeated rows of one id
count as often as they occur, and fail E only if a smaller id has their text.  Labels that repeat an id count
as one that has quality 1, or toxic 1, if one of them has.  An empty table gives no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.llm import shared, spans

FILTERS = "ABCDE"
FEWEST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SIGNS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

#: Texts of a bucket, about.
TEXTS = 64

#: doc_id is 0 where named is false: a null among integers would make them floats on their way through pandas.
VERDICTS = "bucket BIGINT, text STRING, named BOOLEAN, doc_id BIGINT, part STRING, mask INT, n BIGINT"
DELTAS = "named BOOLEAN, doc_id BIGINT, part STRING, mask INT, n BIGINT"
STATE = "texts ARRAY<STRING>, least ARRAY<BIGINT>, parts ARRAY<STRING>, times ARRAY<BIGINT>"


def masks(hasher: spans.Hasher, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The failed ones of A to D for each text, a bit for each."""
    starts, ends, first = spans.words(data, bounds)
    words = np.diff(first)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), words)
    hashes = hasher(data, starts, ends)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    distinct = np.bincount(owner[order[fresh]].astype(np.int64), minlength=len(words))

    def counted(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    capitals = counted((data >= ord("A")) & (data <= ord("Z")))
    points = counted((data & 0xC0) != 0x80)
    signs = counted(np.isin(data, np.frombuffer(SIGNS, np.uint8)))
    failed = (words < FEWEST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, signs > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _judge(buckets: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, part) to verdicts: of each text the least id of a slice, open, and the others,
        settled.  What is settled needs no state: it has a bucket below 0, one for each slice."""
        hasher = spans.Hasher()
        context = TaskContext.get()
        settled = -1 - ((context.partitionId() if context else 0) << 32)
        for batch in batches:
            for lo, hi, data, bounds in spans.slices(batch.column(1)):
                settled -= 1
                found = masks(hasher, data, bounds)
                raw = memoryview(data)
                edges = bounds.tolist()
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                parts = batch.column(2).slice(lo, hi - lo).to_pylist()
                texts = [hashlib.blake2b(raw[a:b], digest_size=16).hexdigest() for a, b in zip(edges, edges[1:])]
                least: dict[str, int] = {}
                for text, i in zip(texts, ids):
                    if i is not None and (text not in least or i < least[text]):
                        least[text] = i
                rows: dict[tuple, int] = {}
                for text, mask, i, part in zip(texts, found.tolist(), ids, parts):
                    if i is None:
                        row = (settled, "", False, 0, part, mask)
                    elif i == least[text]:
                        row = (int(text[:15], 16) % buckets, text, True, i, part, mask)
                    else:
                        row = (settled, "", True, i, part, mask | DUPLICATE)
                    rows[row] = rows.get(row, 0) + 1
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int32())
                arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                arrays.append(pa.array(list(rows.values()), pa.int64()))
                names = ["bucket", "text", "named", "doc_id", "part", "mask", "n"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return judge


def _retract(bucket: tuple[int], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The verdicts of the texts of a bucket in one batch: a smaller id takes back what the former least id
    of its text got."""
    columns = ["named", "doc_id", "part", "mask", "n"]
    if bucket[0] < 0:
        for frame in frames:
            yield frame[columns]
        return
    known: dict[str, tuple[int, dict[str, int]]] = {}
    if state.exists:
        for text, i, part, n in zip(*state.get):
            known.setdefault(text, (i, {}))[1][part] = n
    out: list[tuple] = []
    changed = False
    for frame in frames:
        for text, i, part, mask, n in zip(*(frame[c].tolist() for c in ("text", "doc_id", "part", "mask", "n"))):
            least, counts = known.get(text, (i, {}))
            if i > least:
                out.append((True, i, part, mask | DUPLICATE, n))
                continue
            if i < least:
                for was, k in counts.items():
                    out += [(True, least, was, mask, -k), (True, least, was, mask | DUPLICATE, k)]
                counts = {}
            out.append((True, i, part, mask, n))
            known[text] = i, {**counts, part: counts.get(part, 0) + n}
            changed = True
    if changed:
        flat = [(text, i, part, n) for text, (i, counts) in known.items() for part, n in counts.items()]
        state.update(tuple(list(c) for c in zip(*flat)))
    yield pd.DataFrame(out, columns=columns)


def verdicts(
    spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", part: str = "source", files: int | None = None
) -> DataFrame:
    """(doc_id, part, mask, n) rows whose n sum up to how often each document fails that set of filters.

    files: how many a batch takes, by default four for each core of the cluster, 8 at least."""
    shared.small_batches(spark)
    files = files or max(8, 4 * spark.sparkContext.defaultParallelism)
    still = spark.read.parquet(path)
    # a stream reads folders; as a pattern the path may also be a single file
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    rows = stream.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    open_ = rows.mapInArrow(spans.tidy(_judge(1 + still.count() // TEXTS)), VERDICTS)
    given = open_.groupBy("bucket").applyInPandasWithState(_retract, DELTAS, STATE, "append", "NoTimeout")
    out, log = shared.folder(spark, "audit-verdicts"), shared.folder(spark, "audit-stream")
    run = given.writeStream.format("parquet").option("checkpointLocation", log).outputMode("append")
    run.trigger(availableNow=True).start(out).awaitTermination()
    shared.remove(spark, log)
    return spark.read.schema(DELTAS).parquet(out).select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "part", "mask", "n")


def counters(deltas: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and how many of them
    are labelled good or toxic."""

    def one(name: str) -> Column:
        return F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)

    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id"))
    known = known.agg(one("quality"), one("toxic"))
    named = deltas.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    rows = named.select("part", "mask", "n", "quality", "toxic").unionByName(
        deltas.where("doc_id IS NULL").select("part", "mask", "n"), allowMissingColumns=True
    )
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counters of the parts."""
    places: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            places.setdefault((before, bit), []).append(("".join(order), step))
            before |= bit
    spark = counts.sparkSession
    kind = "before INT, bit INT, orders BIGINT, places ARRAY<STRUCT<filter_order: STRING, step: INT>>"
    # 80 rows, whatever the input: what was applied before, and the filter of this step
    steps = spark.createDataFrame([(a, b, len(found), found) for (a, b), found in places.items()], kind)
    pairs = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in places])
    each = counts.select("*", F.explode(pairs).alias("s")).select(*counts.columns, "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    came = F.col("mask").bitwiseAND(F.col("before")) == 0

    def total(value: str, hit: Column) -> Column:
        return F.sum(F.when(hit, F.col(value)).otherwise(0)).cast("long")

    sums = each.groupBy("part", "before", "bit").agg(
        total("n", came & ~fails).alias("kept"),
        total("n", came & fails).alias("removed"),
        total("n", ~came & fails).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", came & fails).alias("good_lost"),
        total("toxic", came & fails).alias("toxic_lost"),
    )
    sums = sums.join(F.broadcast(steps), ["before", "bit"])
    share = sums.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    rows = sums.join(share, ["part", "bit"]).select("*", F.explode("places").alias("p"))
    return rows.select(
        "part", "p.filter_order", "p.step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", files: int | None = None) -> DataFrame:
    """All orders of the filters over the documents of a folder, for each part."""
    deltas = verdicts(spark, path, key, text, part, files)
    counts = shared.written(counters(deltas, labels, key), "audit-counters")
    shared.drop_table(deltas)
    return orders(counts)
