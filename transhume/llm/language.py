"""Language identification by mixture inference.

The model holds, for each learned language, the likelihood of character trigrams.  A document is taken as
a mixture: expectation-maximisation finds the share of each language in its trigrams, starting from all of
them alike.  The languages are then ordered by share, and of the sets made of the first, the first two
and so on, each fitted again, the one with the highest penalised likelihood is chosen: a further language
has to explain the text better by PENALTY times the logarithm of its length.  The document's language is the
one with the largest share in the chosen set, and that share is the score.

Counts for the model are partial sums of tasks, added by Spark; the model itself has a fixed largest size
(TRIGRAMS buckets for each language).  It may be fitted on a bounded sample: of each language about
FIT_ROWS labelled documents, taken by a hash of the id over the whole table, all of them if there are fewer.

A text that is null or has no letter is `und` with score 0.  Every row of the input gives one row, repeated
ids too.  Without labelled rows there is nothing to learn, and every text is `und`.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared, spans

TRIGRAMS = 1 << 16
FIT_ROWS = 4000
#: Weight of a further language per unit of log length; trigrams overlap, so three times one half.
PENALTY = 1.5
ROUNDS = 12
SMOOTH = 0.5
#: A document whose largest share is smaller has no language.
LEAST_SHARE = 0.3
UND = "und"
#: A document of many trigrams is worked on with those of others up to this many characters.
AT_ONCE = 1 << 18

LETTER = re.compile(r"[^\W\d_]")
COUNTS = "lang STRING, bucket INT, n BIGINT"
ROWS = "doc_id BIGINT, lang_pred STRING, score DOUBLE, n_langs INT, row BIGINT"


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def _fold() -> np.ndarray:
    """Bytes as classes: letters without case, all else but bytes beyond ASCII as one blank."""
    table = np.zeros(256, np.uint8)
    for b in range(ord("a"), ord("z") + 1):
        table[b] = b
        table[b - 32] = b
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds) of the trigrams of bytes of all texts.  Runs of blanks count as one, and a
    trigram lies within a text and holds a letter."""
    folded = _fold()[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    keep[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    folded = folded[keep].astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # trigrams that would run on into the next text
        late = at[1:-1] - back
        inside[late[(late >= 0) & (late < len(code))]] = False
    inside &= (folded[:-2] | folded[1:-1] | folded[2:]) != 0
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside].astype(np.uint16), ends[np.minimum(at, len(code))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in batch.column(1).unique().to_pylist():
            chosen = batch.column(0).filter(pc.equal(batch.column(1), lang))
            table = totals.setdefault(lang, np.zeros(TRIGRAMS, np.int64))
            for _, _, data, bounds in spans.slices(chosen, AT_ONCE):
                table += np.bincount(trigrams(data, bounds)[0], minlength=TRIGRAMS)
    for lang, table in totals.items():
        seen = np.flatnonzero(table)
        columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(table[seen])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


class Model:
    """Log likelihood of each trigram bucket in each language."""

    def __init__(self, counts: pa.Table):
        named = counts.column("lang").combine_chunks().dictionary_encode()
        found = named.dictionary.to_pylist()
        self.langs = sorted(found)
        table = np.zeros((len(found), TRIGRAMS))
        place = np.array([self.langs.index(lang) for lang in found], np.int64)
        row = place[named.indices.to_numpy()] if found else np.zeros(0, np.int64)
        table[row, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
        table += SMOOTH
        self.likelihood = (table / table.sum(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """The model from about `rows` labelled documents of each language that are not held out."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = named.where(F.col("lang").isNotNull() & ~F.coalesce(held_out("id"), F.lit(False)))
    sizes = labelled.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    share = F.xxhash64(F.lit(2), F.col("id")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(1 << 30)
    # as many rows as there are languages
    sample = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("name")).where(share * F.col("n") < rows)
    shared.small_batches(docs.sparkSession)
    parts = sample.select("text", "lang").mapInArrow(spans.tidy(_count), COUNTS)
    return Model(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; an empty run gives 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def mixture(table: np.ndarray, weight: np.ndarray, bounds: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each document by expectation-maximisation.

    table: likelihood of each distinct trigram of a document in each language; weight: how often it
    occurs; bounds: of the documents; allowed: the languages each document may use."""
    share = allowed / allowed.sum(1, keepdims=True)
    size = np.diff(bounds)
    total = np.maximum(_sums(weight, bounds), 1)[:, None]
    for _ in range(rounds):
        part = table * np.repeat(share, size, axis=0).astype(np.float32)
        whole = part.sum(1)
        share = _sums(part * (weight / whole)[:, None], bounds).astype(np.float64) / total
        share = np.where(allowed > 0, np.maximum(share, 1e-9), 0)
        share /= share.sum(1, keepdims=True)
    whole = (table * np.repeat(share, size, axis=0).astype(np.float32)).sum(1)
    return share, _sums(weight * np.log(np.maximum(whole, 1e-30)), bounds)


def identify(model: Model, buckets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, languages in the set) of each document."""
    n_docs, k = len(bounds) - 1, len(model.langs)
    owner = np.repeat(np.arange(n_docs, dtype=np.uint32), np.diff(bounds))
    keys = np.sort(owner << np.uint32(16) | buckets)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(keys))).astype(np.float32)
    keys = keys[at]
    edges = np.searchsorted(keys >> np.uint32(16), np.arange(n_docs + 1))
    table = model.likelihood.T[keys & np.uint32(0xFFFF)]
    share, _ = mixture(table, weight, edges, np.ones((n_docs, k)))
    order = np.argsort(-share, axis=1, kind="stable")
    length = np.log(np.maximum(np.diff(bounds), 2))
    best = np.full(n_docs, -np.inf)
    chosen, score, count = order[:, 0].copy(), np.zeros(n_docs), np.ones(n_docs, np.int32)
    allowed = np.zeros((n_docs, k))
    rows = np.arange(n_docs)
    open_ = np.ones(n_docs, bool)  # larger sets are tried while the last one paid
    for size in range(1, k + 1):
        allowed[rows, order[:, size - 1]] = 1
        some = np.flatnonzero(open_)
        if not len(some):
            break
        inside = np.repeat(open_, np.diff(edges))
        sub = np.concatenate([[0], np.cumsum(np.diff(edges)[some])])
        fitted, gain = mixture(table[inside], weight[inside], sub, allowed[some], ROUNDS if size > 1 else 1)
        value = gain - PENALTY * (size - 1) * length[some]
        better = value > best[some]
        hit = some[better]
        best[hit] = value[better]
        chosen[hit] = fitted[better].argmax(1)
        score[hit] = fitted[better].max(1)
        count[hit] = size
        open_[some[~better]] = False
    return chosen, score, count


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            langs: list[str] = []
            scores: list[float] = []
            counts: list[int] = []
            for lo, hi, data, bounds in spans.slices(texts, AT_ONCE):
                # the owner of a trigram has 16 bits
                for a in range(lo, hi, 1 << 15):
                    b = min(hi, a + (1 << 15))
                    part = bounds[a - lo : b - lo + 1]
                    buckets, edges = trigrams(data[part[0] : part[-1]], part - part[0])
                    if model.langs:
                        chosen, score, count = identify(model, buckets, edges)
                    for i in range(b - a):
                        text = texts[a + i].as_py()
                        known = text is not None and model.langs and LETTER.search(text)
                        langs.append(model.langs[chosen[i]] if known else UND)
                        scores.append(min(max(float(score[i]), 0.0), 1.0) if known else 0.0)
                        counts.append(int(count[i]) if known else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), batch.column(2)],
                names=["doc_id", "lang_pred", "score", "n_langs", "row"],
            )

    return predict


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_langs and row (a hash of the text) of every document."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), shared.text_hash(text).alias("row"))
    return rows.mapInArrow(spans.tidy(_predictor(model)), ROWS)


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in a known language that makes up at least that share, as they came."""
    rejected = predict(docs, model, key, text).where((F.col("lang_pred") == UND) | (F.col("score") < least))
    rows = shared.packed(docs, id=F.col(key).cast("long"), t=shared.text_hash(text))
    return shared.without(rows, rejected, {"id": "doc_id", "t": "row"}).select("row.*")
