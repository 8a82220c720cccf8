"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut before each run of ASCII white space; no pre-token crosses such a place, so a text has as
many tokens as its pieces.  Pieces are hashed by array operations, and those a worker has not met are
normalised and split into pre-tokens by the library's own rules.  The merging is done here: all new
pre-tokens lie end to end in one array of symbols, and in each round every pre-token applies its pair of
lowest rank, wherever it occurs in it and for all of them at once, until none has a pair left.  What
survives is counted.  A pre-token longer than LONG symbols, where a round for each rank would cost
too much, is merged alone with a queue of its pairs, to the same result.

A null text is empty and has 0 bytes and 0 tokens.  Rows are counted one by one: repeats stay.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transhume.llm import encoding, shared, spans

LIMIT = 2048
LONG = 256
#: Pieces whose count a worker remembers, 12 bytes each.
REMEMBERED = 2_000_000
NEVER = np.iinfo(np.int32).max

ROWS = "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT"


class Merges:
    """The merge table of a tokenizer file, for arrays of symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = vocab
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        # of a pair listed twice the last rank counts
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = np.ones(len(keys), bool)
        keep[1:] = keys[order][1:] != keys[order][:-1]
        order = order[keep]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.hasher = spans.Hasher()
        self.forget()

    def forget(self) -> None:
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, -1 where it is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many symbols survive in each sequence; no sequence is empty."""
        counts = sizes.astype(np.int64)
        rows = np.arange(len(sizes))
        while len(rows):
            owner = np.repeat(np.arange(len(rows)), counts[rows])
            place = np.full(len(symbols), -1)
            place[:-1] = self.find(symbols[:-1], symbols[1:])
            place[:-1][owner[1:] != owner[:-1]] = -1
            rank = np.where(place >= 0, self.ranks[place], NEVER)
            starts = np.cumsum(counts[rows]) - counts[rows]
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == lowest[owner]) & (rank < NEVER)
            # where the pair overlaps itself, every second one from the left
            at = np.arange(len(symbols))
            opens = hit.copy()
            opens[1:] &= ~hit[:-1]
            since = at - np.maximum.accumulate(np.where(opens, at, 0))
            hit &= since % 2 == 0
            symbols = np.where(hit, self.made[place], symbols)
            stays = np.ones(len(symbols), bool)
            stays[1:] = ~hit[:-1]
            active = (lowest < NEVER)[owner]
            counts[rows] -= np.bincount(owner[hit], minlength=len(rows))
            symbols = symbols[stays & active]
            rows = rows[lowest < NEVER]
        return counts

    def merge_long(self, symbols: list[int]) -> int:
        """The same for one long sequence, with a queue of its pairs."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            rights = [after[i] for i in lefts]
            found = self.find(
                np.array([symbols[i] for i in lefts]), np.array([symbols[j] for j in rights])
            )
            for i, j, at in zip(lefts, rights, found.tolist()):
                if at >= 0:
                    pair = (int(self.ranks[at]), i, symbols[i], symbols[j], int(self.made[at]))
                    heapq.heappush(queue, pair)

        offer(list(range(n - 1)))
        alive = n
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            alive -= 1
            near = [x for x in (before[i], i) if x >= 0 and after[x] < n]
            if near:
                offer(near)
        return alive

    def count_pretokens(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, which is written in the alphabet of bytes."""
        vocab, suffix = self.vocab, self.suffix
        out = np.zeros(len(pretokens), np.int64)
        short, symbols, sizes = [], [], []
        for i, word in enumerate(pretokens):
            found = [vocab.get(c) for c in word[:-1]] + [vocab.get(word[-1] + suffix)]
            known = [x for x in found if x is not None]
            if len(known) > LONG:
                out[i] = self.merge_long(known)
            elif known:
                short.append(i)
                symbols += known
                sizes.append(len(known))
        if short:
            out[short] = self.merge(np.array(symbols, np.int32), np.array(sizes))
        return out

    def count_pieces(self, found: list[str]) -> np.ndarray:
        """Tokens of each piece: they are normalised and split in one text, a blank apart.  Those with
        white space inside, which normalising could merge, are normalised alone."""
        stripped = [x.lstrip("\t\n\x0b\x0c\r ") for x in found]
        plain = [len(x.split()) == 1 and not x[-1].isspace() and not x[0].isspace() for x in stripped]
        normal = iter(self.normalizer.normalize_str(" ".join(x for x, y in zip(stripped, plain) if y)).split(" "))
        parts = [next(normal) if y else self.normalizer.normalize_str(x) for x, y in zip(stripped, plain)]
        ends = np.cumsum([len(x) + 1 for x in parts])
        split = self.splitter.pre_tokenize_str(" ".join(parts))
        words = [word for word, _ in split]
        owner = np.searchsorted(ends, [a for _, (a, _) in split], side="right")
        distinct: dict[str, int] = {}
        number = [distinct.setdefault(word, len(distinct)) for word in words]
        counts = self.count_pretokens(list(distinct))
        weights = counts[number] if number else np.zeros(0)
        return np.bincount(owner.astype(np.int64), weights, len(found)).astype(np.int32)

    def count_run(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        starts, ends, first = encoding.pieces(data, bounds)
        if not len(starts):
            return np.zeros(len(bounds) - 1, np.int64)
        hashes = self.hasher(data, starts, ends)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        inside = place < len(self.known)
        old[inside] = self.known[place[inside]] == distinct[inside]
        new = np.flatnonzero(~old)
        if len(new):
            raw = data.tobytes()
            texts = [raw[starts[i] : ends[i]].decode() for i in at[new]]
            counts = self.count_pieces(texts)
            where = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, where, distinct[new])
            self.count = np.insert(self.count, where, counts)
        each = self.count[np.searchsorted(self.known, distinct)][inverse]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[first])

    def count_texts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; strings of added tokens count as one each."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        filled = pc.fill_null(column, "")
        marked = np.zeros(len(filled), bool)
        for token in self.added:
            marked |= pc.match_substring(filled, token).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(marked), "", filled) if marked.any() else filled
        out = np.zeros(len(filled), np.int64)
        for lo, hi, data, bounds in spans.slices(rest, encoding.AT_ONCE):
            out[lo:hi] = self.count_run(data, bounds)
        mark = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        for row in np.flatnonzero(marked).tolist():
            between = mark.split(filled[row].as_py())
            out[row] = len(between) - 1 + self.count_texts(pa.array(between, filled.type)).sum()
        return out


def merges(path: str) -> Merges:
    """The merge table of this Python process: a worker keeps it for its later tasks."""
    kept = sys.modules.setdefault("_kept_merges", types.ModuleType("_kept_merges"))
    if path not in vars(kept):
        vars(kept)[path] = Merges(path)
    return vars(kept)[path]


def _counter(tokenizer: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(tokenizer)
        for batch in batches:
            text = batch.column(1)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            tokens = pa.array(table.count_texts(text), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, tokens], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return count


def count_tokens(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    shared.small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = source.mapInArrow(spans.tidy(_counter(tokenizer)), ROWS)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
