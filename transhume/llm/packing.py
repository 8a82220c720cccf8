"""Best-fit packing of documents into token sequences by bin completion.

A document is its ids and an end id.  Only one longer than a sequence is cut, into full pieces and one
shorter piece in front.  How the pieces fill sequences depends on their lengths alone, so the search
runs on the count of pieces of each length, of which there are as many as a sequence has tokens:

* Best fit decreasing over the counts gives the first incumbent.
* Bin completion takes the largest length left, enumerates the fillings of the space beside it that no
  other filling dominates, tries them from the least waste up, each as often as the counts allow and
  then less often, and goes back where the waste so far leaves no better packing possible.  It ends at
  the lower bound, when all is tried, or after NODES steps or LOOKS times as many fillings enumerated,
  and keeps the best packing seen, which always places every piece.

The fillings go back to the pieces as a small table (at most a few rows for each length and filling): a
piece's number among those of its length, counted per task and added up, tells its sequence and place.

Each piece keeps its ids, and sequences() joins those of a sequence end to end.  The pieces with their ids
are written once, where they are cut.

A null text is empty and is one piece with the end id.  Repeated rows are packed once each.  An empty
table gives no row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from transhume.llm import encoding, shared, spans

CAPACITY = 1024
END = 2
#: Steps of the search beyond the first packing, and fillings enumerated for each of them on average.
NODES = 2000
LOOKS = 50
#: Ids that go from Python to Spark at once, or those of one longer text.
IDS_AT_ONCE = 1 << 20
#: Pieces of text remembered by a worker, which holds the ids of a batch besides.
REMEMBERED = 800_000

PIECES = (
    "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, part INT, number BIGINT, ids ARRAY<INT>"
)

#: A filling: lengths in descending order, and how many sequences are filled so.
Filling = tuple[tuple[int, ...], int]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best fit decreasing, many pieces at a time."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    closed: dict[tuple[int, ...], int] = defaultdict(int)

    def put(left: int, filling: tuple[int, ...], times: int) -> None:
        if left == 0:
            closed[filling] += times
        else:
            room[left][filling] = room[left].get(filling, 0) + times

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        for left in sorted(room):
            while left >= length and todo and room.get(left):
                filling, times = room[left].popitem()
                fit = left // length
                full = min(times, todo // fit)
                rest = times - full
                if full:
                    put(left - fit * length, filling + (length,) * fit, full)
                    todo -= full * fit
                if rest and todo:
                    put(left - todo * length, filling + (length,) * todo, 1)
                    rest, todo = rest - 1, 0
                if rest:
                    put(left, filling, rest)
            if not room.get(left):
                room.pop(left, None)
            if not todo:
                break
        fit = capacity // length
        if todo >= fit:
            put(capacity - fit * length, (length,) * fit, todo // fit)
        if todo % fit:
            put(capacity - (todo % fit) * length, (length,) * (todo % fit), 1)
    out = dict(closed)
    for fillings in room.values():
        for filling, times in fillings.items():
            out[filling] = out.get(filling, 0) + times
    return list(out.items())


def _sums(lengths: list[int], counts: dict[int, int], space: int) -> list[int]:
    """For each place in `lengths`, the sums up to `space` of it and those behind it, as bits."""
    inside = (1 << space + 1) - 1
    sums = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        bits, todo, step = sums[i + 1], min(counts[lengths[i]], space // lengths[i]), 1
        while todo:
            step = min(step, todo)
            bits |= bits << step * lengths[i] & inside
            todo -= step
            step *= 2
        sums[i] = bits
    return sums


def dominated(taken: tuple[int, ...], counts: dict[int, int], space: int, there: int) -> bool:
    """Whether the pieces can be grouped into those of another filling of `space`.

    If so, one step towards it does it: some pieces, or none, make way for one spare piece that is as
    large as they are together and still fits.  there: the lengths of `counts` up to `space`, as bits.
    """
    room = space - sum(taken)
    spare = there
    for x in set(taken):
        if counts[x] <= taken.count(x):
            spare &= ~(1 << x)
    sums, low = 1, 0
    for x in [*sorted(set(taken)), space]:
        # sums of pieces under x, each with what there is room for: a spare piece up to x may be one
        wide, reach = sums, 0
        while reach < room:
            step = min(reach + 1, room - reach)
            wide |= wide << step
            reach += step
        if wide & spare & ((1 << x + 1) - (1 << low + 1)):
            return True
        for _ in range(taken.count(x)):
            sums |= sums << x
        low = x
    return False


def completions(counts: dict[int, int], space: int, slack: int, look: Iterator) -> Iterator[tuple[int, ...]]:
    """Fillings of `space` from the lengths left that no other dominates and that leave at most `slack`,
    the fullest first, of equal sums those with larger pieces first.

    One at a time, each costs an item of `look`, dominated ones too; it ends with them.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= space), reverse=True)
    sums = _sums(lengths, counts, space)
    there = sum(1 << x for x in lengths)

    def extend(at: int, left: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield taken
            return
        for i in range(at, len(lengths)):
            if not sums[i] >> left & 1:
                return
            length = lengths[i]
            for k in range(min(counts[length], left // length), 0, -1):
                if sums[i + 1] >> left - k * length & 1:
                    yield from extend(i + 1, left - k * length, taken + (length,) * k)

    for total in range(space, max(space - slack, 0) - 1, -1):
        if sums[0] >> total & 1:
            for taken in extend(0, total, ()):
                if next(look, None) is None:
                    return
                if not dominated(taken, counts, space, there):
                    yield taken


def _choices(
    left: dict[int, int], capacity: int, slack: int, last: tuple[int, ...], look: Iterator
) -> Iterator[Filling]:
    """Fillings with the largest length left, each as often as can be, then each less often.

    Those of one largest length are taken in the order of completions(), so none before `last` or like it.
    A dominating filling comes earlier in that order: the packing that is first in it has no dominated one,
    and so is never left out.
    """
    largest = max(left)
    beside = {x: k - (x == largest) for x, k in left.items()}
    again = []
    for taken in completions(beside, capacity - largest, slack, look):
        filling = (largest, *taken)
        if last and last[0] == largest and (sum(filling), filling) >= (sum(last), last):
            continue
        most = min(left[x] // filling.count(x) for x in set(filling))
        if gap := capacity - sum(filling):
            most = min(most, slack // gap)
        yield filling, most
        if most > 1:
            again.append((filling, most))
    for filling, most in again:
        for times in range(most - 1, 0, -1):
            yield filling, times


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """Fillings that hold every piece, in as few sequences as the search finds."""
    counts = {length: n for length, n in counts.items() if n}
    total = sum(length * n for length, n in counts.items())
    # pieces over half a sequence never share one
    bound = max(-(-total // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    if used == bound:
        return best
    look = iter(range(LOOKS * nodes))

    def spare(waste: int) -> int:
        """What may still be wasted in a packing better than the best."""
        return (used - 1) * capacity - total - waste

    steps = 0
    # depth first: (counts left, fillings so far, sequences so far, waste so far, what to try)
    stack = [(counts, (), 0, 0, _choices(counts, capacity, spare(0), (), look))]
    while stack and steps < nodes and used > bound:
        left, chosen, n, waste, tries = stack[-1]
        filling, times = next(tries, ((), 0))
        if not times:
            stack.pop()
            continue
        steps += 1
        waste += (capacity - sum(filling)) * times
        if spare(waste) < 0:
            continue  # nothing below this wastes little enough to be better
        n, chosen = n + times, (*chosen, (filling, times))
        left = {x: m for x, k in left.items() if (m := k - times * filling.count(x))}
        if not left:
            best, used = list(chosen), n
            continue
        if steps % 16 == 1:
            rest = best_fit(left, capacity)
            if (m := n + sum(k for _, k in rest)) < used:
                best, used = [*chosen, *rest], m
        if spare(waste) >= 0:
            stack.append((left, chosen, n, waste, _choices(left, capacity, spare(waste), filling, look)))
    return best


def places(fillings: list[Filling]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, first sequence, pieces of the length in a sequence, offset): the pieces of
    a length numbered first to end - 1 go into sequences one after the other."""
    seen: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            k = filling.count(length)
            rows.append((length, seen[length], seen[length] + k * times, sequence, k, offset))
            seen[length] += k * times
            offset += k * length
        sequence += times
    return rows


def _cutter(tokenizer: str, capacity: int, forget: bool = False):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoding.encoder(tokenizer, **(encoding.LEAN if forget else {"remembered": REMEMBERED, "fast": False}))
        at_once = IDS_AT_ONCE // 4 if forget else IDS_AT_ONCE
        seen = [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "part", "number", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def made(rows: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            # the pieces of a text follow each other, and so do their ids
            ends = np.cumsum([0, *(row[3] for row in rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([*columns, ids], names=names)

        for batch in batches:
            rows, held, size = [], [], 0
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype(np.int32)
                for i, (at, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((key, i, at, n, part, seen[n]))
                    seen[n] += 1
                held.append(ids)
                size += len(ids)
                if size >= at_once:
                    yield made(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield made(rows, held)
        if forget:
            del encoder
            encoding.release(tokenizer)

    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    nodes: int = NODES,
    forget: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    With ``forget`` workers work on smaller slices, remember fewer pieces and don't keep the encoder after a
    task, for jobs whose other stages need the memory."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = shared.written(source.mapInArrow(spans.tidy(_cutter(tokenizer, capacity, forget)), PIECES), "packing-pieces")
    # only the last join reads the ids
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shared.written(
        parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-parts"
    )
    # as many rows as a sequence has tokens, at most
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.createDataFrame(
        places(solve(counts, capacity, nodes)),
        "_length BIGINT, first BIGINT, end BIGINT, sequence BIGINT, k BIGINT, at BIGINT",
    )
    numbered = pieces.join(parts.drop("n"), ["length", "part"]).withColumn(
        "number", F.col("number") + F.col("base")
    )
    inside = (F.col("length") == F.col("_length")) & (F.col("number") >= F.col("first"))
    placed = numbered.join(F.broadcast(table), inside & (F.col("number") < F.col("end")))
    index = F.col("number") - F.col("first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("sequence") + F.floor(index / F.col("k"))).alias("sequence_id"),
        (F.col("at") + index % F.col("k") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, at most as many as it holds, from the rows of pack()."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    return packed.groupBy("sequence_id").agg(parts).select("sequence_id", F.flatten("parts.ids").alias("ids"))


def write_sequences(packed: DataFrame, path: str) -> None:
    """The sequences as a table of Parquet files."""
    sequences(packed).write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_pylist()
        sums = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
        yield batch.append_column("ids_crc32", sums)


def digests(packed: DataFrame) -> DataFrame:
    """The rows of pack() and ids_crc32, of the ids as 32-bit little-endian numbers."""
    shared.small_batches(packed.sparkSession)
    schema = StructType([*packed.schema.fields, StructField("ids_crc32", LongType())])
    return packed.mapInArrow(spans.tidy(_digests), schema)
