"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

A byte-level tokenizer never lets a token cross the start of a run of white space, so the ids of a
text are those of its pieces, each a run of white space and what follows up to the next run.  Pieces
repeat a lot: they are hashed by array operations, the library encodes those not met before, and the
ids of all texts are gathered with numpy.  A text that holds the string of an added token goes to the
library whole.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from transhume.llm import spans

#: Pieces remembered by a Python worker: about 60 bytes each.
REMEMBERED = 1_500_000
#: Bytes of texts worked on at once, and new pieces the library gets at once: it keeps much of each token.
AT_ONCE = 4 << 20
#: Both for jobs whose other stages need the memory.
LEAN = {"at_once": 1 << 18, "remembered": 200_000, "fast": False}
NEW_AT_ONCE = 30_000

#: White space beyond ASCII, as the tokenizer's pattern takes it.
WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): pieces of all texts, and the number of each text's first piece."""
    blank = spans.BLANKS[data]
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    at = np.flatnonzero(cut)
    # no cut after white space beyond ASCII: the run has begun before
    odd = at[(at > 2) & (data[at - 1] >= 0x80)]
    if len(odd):
        three = (data[odd - 3].astype(np.int64) << 16) | (data[odd - 2].astype(np.int64) << 8) | data[odd - 1]
        codes = [int.from_bytes(c.encode(), "big") for c in WIDE]
        wide = np.isin(three, [c for c in codes if c > 0xFFFF])
        wide |= np.isin(three & 0xFFFF, [c for c in codes if c <= 0xFFFF])
        cut[odd[wide]] = False
    odd = at[(at == 2) & (data[at - 1] >= 0x80)]
    if len(odd) and bytes(data[:2]).decode(errors="replace") in WIDE:
        cut[2] = False
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, bounds)


class Encoder:
    """Encodes columns of texts with one tokenizer file."""

    def __init__(self, path: str, at_once: int = AT_ONCE, remembered: int = REMEMBERED, fast: bool = True):
        self.at_once, self.remembered, self.fast = at_once, remembered, fast
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a token of a byte-level vocabulary has as many characters as it stands for bytes
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[number] = len(token)
        self.hasher = spans.Hasher()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order
        self.first = np.zeros(0, np.int64)  # where the ids of each begin
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def encode_pieces(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each): in one text those that start a run of white space and
        don't end in one, the others one by one."""
        texts = [x.decode() for x in found]
        inside = np.array([not x[-1].isspace() and x[0] in " \t\n\x0b\x0c\r" for x in texts], bool)
        run = [x for x, y in zip(texts, inside) if y]
        batch = self.tokenizer.encode_batch_fast if self.fast else self.tokenizer.encode_batch
        (whole,) = batch(["".join(run)], add_special_tokens=False)
        ids = np.array(whole.ids, np.uint32)
        ends = np.cumsum(np.array([len(x) for x, y in zip(found, inside) if y], np.int64))
        closed = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        alone = [x for x, y in zip(texts, inside) if not y]
        other = [e.ids for e in batch(alone, add_special_tokens=False)]
        size = np.zeros(len(found), np.int64)
        size[inside] = np.diff(closed, prepend=0)
        size[~inside] = [len(x) for x in other]
        out = np.empty(int(size.sum()), np.uint32)
        from_run = np.repeat(inside, size)
        out[from_run] = ids
        out[~from_run] = [i for x in other for i in x]
        return out, size

    def learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        parts = []
        for i in range(0, len(hashes), NEW_AT_ONCE):
            some = zip(starts[i : i + NEW_AT_ONCE].tolist(), ends[i : i + NEW_AT_ONCE].tolist())
            parts.append(self.encode_pieces([raw[a:b] for a, b in some]))
        ids, size = (np.concatenate(x) for x in zip(*parts))
        first = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.size = np.insert(self.size, at, size.astype(np.int32))
        self.ids = np.concatenate([self.ids, ids])

    def encode_run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each text's ids)."""
        starts, ends, first = pieces(data, bounds)
        hashes = self.hasher(data, starts, ends)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        for again in (False, True):
            place = np.searchsorted(self.known, distinct)
            place[place == len(self.known)] = 0
            fresh = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
            if again or not fresh.any():
                break
            if len(self.known) + int(fresh.sum()) > self.remembered:
                self.forget()
                fresh[:] = True
            self.learn(data, distinct[fresh], starts[at[fresh]], ends[at[fresh]])
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        begin, size = self.first[place][inverse], self.size[place][inverse].astype(np.int64)
        close = np.cumsum(size)
        ids = self.ids[np.repeat(begin - close + size, size) + np.arange(int(close[-1]))]
        return ids, np.concatenate([[0], close])[first]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        filled = pc.fill_null(column, "")
        marked = np.zeros(len(column), bool)
        for token in self.added:
            marked |= pc.match_substring(filled, token).to_numpy(zero_copy_only=False)
        rest = pc.if_else(pa.array(marked), "", filled) if marked.any() else filled
        for lo, hi, data, bounds in spans.slices(rest, self.at_once):
            ids, at = self.encode_run(data, bounds)
            at = at.tolist()
            for row in range(lo, hi):
                if marked[row]:
                    text = filled[row].as_py()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[at[row - lo] : at[row - lo + 1]]


def encoder(path: str, **sizes: int) -> Encoder:
    """The encoder of this Python process: a worker keeps it for its later tasks."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if path not in vars(kept):
        vars(kept)[path] = Encoder(path, **sizes)
    return vars(kept)[path]


def release(path: str) -> None:
    """Let go of this process's encoder."""
    vars(sys.modules.get("_kept_encoders", types.ModuleType("none"))).pop(path, None)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
