"""Token ids as wavelet matrices, one compressed file per shard.

Documents are dealt to tasks by ranges of doc_id and encoded in that order.  A shard holds the ids of
some documents as bit planes over the shard's own alphabet, highest bit first: each plane keeps, of
the ids in the order the plane before left them, one bit, and then moves the ids with bit 0 before
those with bit 1, in order.  With a running count of the ones per block of 512 bits, one file answers which
id stands at a place (access), how often an id occurs before a place (rank), and where its k-th
occurrence is (select), by steps through the planes.

File: magic, length of the header, header (JSON), then the sections it names, each at its offset:
doc_ids and bounds (int64), alphabet (uint32), and bits (uint8) and counts (uint32) of each plane.

A null text is empty and has the end id alone.  Documents with a null id come first.  Rows that repeat
an id keep their own entries, ordered by a hash of the text.  An empty table gives no file and no row.
A file is written beside its place and moved there, so a task that is lost or runs twice leaves one
whole file with the same bytes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transhume import storage
from transhume.llm import encoding, shared, spans

MAGIC = b"WVMX0001"
BLOCK = 512
END = 2
#: Ids in a shard, but for a longer document; bounds the memory of a task.
SHARD_IDS = 1 << 21

#: Files that a task reads back, one after the other.
FILES_AT_ONCE = 4

NO_ID = np.iinfo(np.int64).min
MANIFEST = "part INT, k INT, path STRING, n_docs BIGINT, n_ids BIGINT"
ROWS = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"


def planes_of(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """One packed bit plane per bit, highest first."""
    out = []
    symbols, other = symbols.copy(), np.empty_like(symbols)
    for level in range(depth - 1, -1, -1):
        one = (symbols & symbols.dtype.type(1 << level)) != 0
        out.append(np.packbits(one, bitorder="little"))
        zeros = len(symbols) - int(np.count_nonzero(one))
        np.compress(~one, symbols, out=other[:zeros])
        np.compress(one, symbols, out=other[zeros:])
        symbols, other = other, symbols
    return out


def ones_before(plane: np.ndarray) -> np.ndarray:
    """The ones before each block of the plane, and all of them at the end."""
    padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(plane)] = plane
    per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The file of a shard."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    alphabet = np.flatnonzero(np.bincount(flat, minlength=1)).astype(np.uint32) if len(flat) else flat
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    depth = max(1, int(max(len(alphabet) - 1, 0)).bit_length())
    symbols = number[flat].astype(np.uint16 if depth <= 16 else np.uint32)
    planes = planes_of(symbols, depth)
    sections = {
        "doc_ids": np.array([NO_ID if d is None else d for d in doc_ids], "<i8"),
        "bounds": np.cumsum([0, *map(len, ids)]).astype("<i8"),
        "alphabet": alphabet.astype("<u4"),
    }
    for level, plane in enumerate(planes):
        sections[f"bits{level}"] = plane
        sections[f"counts{level}"] = ones_before(plane).astype("<u4")
    table, at = {}, 0
    for name, values in sections.items():
        table[name] = (at, len(values), values.dtype.str)
        at += values.nbytes
    header = json.dumps({"n": len(flat), "depth": depth, "sections": table}).encode()
    body = b"".join(x.tobytes() for x in sections.values())
    return MAGIC + len(header).to_bytes(8, "little") + header + body


class Shard:
    """Reads one file: access, rank, select, counts and occurrences without unpacking it."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16 : 16 + size])
        self.n, self.depth = head["n"], head["depth"]

        def section(name: str) -> np.ndarray:
            at, count, kind = head["sections"][name]
            return np.frombuffer(data, kind, count, 16 + size + at)

        self.doc_ids, self.bounds = section("doc_ids"), section("bounds")
        self.alphabet = section("alphabet")
        self.bits = [section(f"bits{k}") for k in range(self.depth)]
        self.counts = [section(f"counts{k}") for k in range(self.depth)]
        self.zeros = [self.n - int(c[-1]) for c in self.counts]

    def _bit(self, level: int, i: int) -> int:
        return int(self.bits[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        some = self.bits[level][block * (BLOCK // 8) : (i >> 3) + 1]
        count = int(self.counts[level][block])
        if i % BLOCK == 0:
            return count
        whole = (i % BLOCK) >> 3
        count += int(np.bitwise_count(some[:whole]).sum())
        if i & 7:
            count += (int(some[whole]) & ((1 << (i & 7)) - 1)).bit_count()
        return count

    def _step(self, level: int, i: int, bit: int) -> int:
        ones = self._ones(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for level in range(self.depth):
            bit = self._bit(level, i)
            symbol = symbol << 1 | bit
            i = self._step(level, i, bit)
        return int(self.alphabet[symbol])

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.depth):
            bit = symbol >> (self.depth - 1 - level) & 1
            lo, hi = self._step(level, lo, bit), self._step(level, hi, bit)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in places lo to hi, hi left out."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        first, last = self._range(symbol, lo, self.n if hi is None else hi)
        return last - first

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _place(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th (from 0) bit of that value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            seen = self._ones(level, mid + 1)
            seen = seen if bit else mid + 1 - seen
            lo, hi = (mid + 1, hi) if seen <= k else (lo, mid)
        return lo

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(symbol, 0, 0)[0] + k
        for level in range(self.depth - 1, -1, -1):
            bit = symbol >> (self.depth - 1 - level) & 1
            at = self._place(level, at - self.zeros[level] if bit else at, bit)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each plane takes its ids back to where they stood."""
        symbols = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth - 1, -1, -1):
            one = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            zeros, value = self.zeros[level], symbols.dtype.type(1 << (self.depth - 1 - level))
            before = np.empty_like(symbols)
            if zeros:
                np.place(before, ~one, symbols[:zeros])
            if zeros < self.n:
                np.place(before, one, symbols[zeros:] | value)
            symbols = before
        return self.alphabet[symbols] if self.n else np.zeros(0, np.uint32)


def _writer(tokenizer: str, target: str, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoding.encoder(tokenizer)
        done: list[tuple] = []
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal doc_ids, ids, size
            path = f"{target}/part-{part:06d}-{len(done):06d}.wvm"
            store, plain = storage.open_root(path)
            content = pack(doc_ids, ids)
            storage.put(store, plain, lambda out: out.write(content))
            done.append((part, len(done), path, len(ids), size))
            doc_ids, ids, size = [], [], 0

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, found in zip(keys, encoder.encode(batch.column(1))):
                doc_ids.append(key)
                ids.append(np.append(found, np.uint32(END)))
                size += len(found) + 1
                if size >= shard_ids:
                    flush()
        if ids:
            flush()
        names = ["part", "k", "path", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return write


def write_shards(
    docs: DataFrame,
    target: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Writes the files below `target` and returns their manifest, in ascending order of the key."""
    # ids that repeat are told apart by their text, so that no id has to fit one task
    shared.small_batches(docs.sparkSession)
    ordered = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).withColumn("_t", shared.text_hash("text"))
    dealt = ordered.repartitionByRange("doc_id", "_t").sortWithinPartitions("doc_id", "_t")
    made = dealt.select("doc_id", "text").mapInArrow(spans.tidy(_writer(tokenizer, target, shard_ids)), MANIFEST)
    return shared.written(made, "wavelet-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Each file with the ids of all files before it: a sum over parts, then one within each part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return manifest.withColumn("inner", inner).join(parts, "part").select(
        "path", (F.col("base") + F.col("inner")).alias("start")
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, plain = storage.open_root(path)
            with store.open_input_file(plain) as file:
                shard = Shard(file.read())
            ids = shard.decode().astype("<u4")
            bounds = shard.bounds.tolist()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            keys = [None if d == NO_ID else d for d in shard.doc_ids.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(start + shard.bounds[:-1], pa.int64()),
                    pa.array(np.diff(shard.bounds), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    files = shared.written(with_starts(manifest), "wavelet-starts")
    # rows of the manifest are small but stand for much work: the number of tasks follows the files
    tasks = max(1, -(-files.count() // FILES_AT_ONCE))
    return files.repartition(tasks, "path").mapInArrow(spans.tidy(_read), ROWS)
