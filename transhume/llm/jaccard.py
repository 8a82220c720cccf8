"""N-gram Jaccard join by grouped prefixes.

A document is the set of its 5-word shingles.  Two documents link when their sets have a Jaccard
similarity of at least 0.75, and the join finds the components of these links.

1. Each set gets its size and a 64-bit identity; documents with one set are one member from here on.  The
   same pass counts shingles in BUCKETS buckets by hash, over all documents.
2. Shingles are ordered by the count of their bucket, rare ones first.  Sets that link share one of the
   first n - ceil(0.75 n) + 1 (the prefix).  Members with the same prefix and size form one group.
3. Groups that share a prefix shingle are candidate pairs, unless their sizes or the places of the shingle
   rule out the similarity.  At first each group is paired only with the first and the one before it
   under each shingle, in order of size, and members of a group with its first.  These pairs are
   verified, by parity bits that rule out most and then on the whole texts, and the links found join most of what belongs together.
   In one more round each member is paired with two neighbours in other components.
4. All other candidate pairs whose members are not in one component yet are then expanded to members,
   cut down by a short parity within the join, and verified.  Pairs inside a component can't change it, so every link that matters is found, and a group
   of thousands of near copies never turns into all its pairs.

No group is collected anywhere: shingles and pairs are dealt out by joins, which Spark splits where a
key is hot.  The bucket counts (8 MB) are the only thing the driver holds.

A text that is null or has no words has an empty set and is alone, under its own id.  Rows that repeat an id
are members by their text; a component's name is the least id in it, null only if it has no other.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transhume.llm import shared, spans
from transhume.llm.components import components, extended

SHINGLE = 5
#: Similarity in percent.
LEAST = 75
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Buckets whose counts travel as one value.
CHUNK = 1 << 12
#: Rounds in which each member is compared with two others at most, before all candidates left are.
TURNS = 1
#: Words of 64 bits of the short parity that is compared within joins.
SHORT = 8
#: Tokens before a shared one that are looked at to tell whether the pair has met already.
BACK = 4

SHAPES = "is_doc BOOLEAN, doc BIGINT, t BIGINT, n BIGINT, member BIGINT, chunk INT, loads BINARY"
PREFIXES = (
    "member BIGINT, n BIGINT, grp BIGINT, parity BINARY, short ARRAY<BIGINT>, tokens ARRAY<BIGINT>"
)


def sets(column: pa.Array, hasher: spans.Hasher) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in order of the hash."""
    for lo, hi, data, bounds in spans.slices(column):
        starts, ends, first = spans.words(data, bounds)
        hashes = hasher(data, starts, ends)
        shingles = spans.runs_of(hashes, SHINGLE)
        edges = first.tolist()
        for row in range(hi - lo):
            a, b = edges[row], edges[row + 1]
            if b - a >= SHINGLE:
                found = np.sort(shingles[a : b - SHINGLE + 1])
                fresh = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found[fresh]
            elif b > a:  # fewer words: the whole sequence, apart from all sequences of other lengths
                yield spans.mixed(spans.runs_of(hashes[a:b], b - a) ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def identity(found: np.ndarray) -> int:
    """64 bits that depend on the set alone."""
    total = np.add.reduce(spans.mixed(found ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)
    return int(spans.mixed(np.array([total + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = spans.Hasher(fold=True)
    loads = np.zeros(BUCKETS, np.int64)
    names = ["is_doc", "doc", "t", "n", "member", "chunk", "loads"]
    for batch in batches:
        n, member, fresh, size = [], [], [], 0
        for found in sets(batch.column(2), hasher):
            n.append(len(found))
            member.append(identity(found))
            fresh.append((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            size += len(found)
            if size > BUCKETS:
                loads += np.bincount(np.concatenate(fresh), minlength=BUCKETS)
                fresh, size = [], 0
        if size:
            loads += np.bincount(np.concatenate(fresh), minlength=BUCKETS)
        rows = len(n)
        empty = pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())
        columns = [pa.array([True] * rows, pa.bool_()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(member, pa.int64()), *empty]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    yield _chunks(enumerate(loads.reshape(-1, CHUNK)), names)


def _chunks(parts: Iterator[tuple[int, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Counts of buckets that are not all zero, a row for each chunk."""
    found = [(chunk, loads.astype("<u8").tobytes()) for chunk, loads in parts if loads.any()]
    columns = [pa.array([False] * len(found), pa.bool_()), *[pa.nulls(len(found), pa.int64())] * 4]
    columns += [pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _add_loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk, as the rows stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, loads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(chunk, np.zeros(CHUNK, np.uint64))
            total[chunk] += np.frombuffer(loads, "<u8")
    chunks = list(total)
    sums = [total[c].astype("<u8").tobytes() for c in chunks]
    yield pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int32()), pa.array(sums, pa.binary())], names=["chunk", "loads"]
    )


def bucket_ranks(shapes: DataFrame) -> np.ndarray:
    """The rank of each bucket, the least filled first.  8 MB, whatever the input."""
    parts = shapes.where("not is_doc").select("chunk", "loads")
    kind = "chunk INT, loads BINARY"
    # first within sixteenths of the tasks, then all: no task adds up a whole chunk alone
    some = parts.withColumn("salt", F.pmod(F.xxhash64("loads"), F.lit(16)))
    some = some.repartition("chunk", "salt").select("chunk", "loads").mapInArrow(spans.tidy(_add_loads), kind)
    whole = some.repartition("chunk").mapInArrow(spans.tidy(_add_loads), kind)
    load = np.zeros(BUCKETS, np.uint64)
    for row in whole.collect():
        load[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["loads"], "<u8")
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(load, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return rank


def parity(found: np.ndarray) -> bytes:
    """A bit for every few shingles: whether an odd number of them falls there.

    It has at least two bits for each shingle, and a power of two of them, so that the half of a
    longer one is had by laying its halves over each other."""
    size = max(64, 1 << int(2 * len(found) - 1).bit_length())
    place = (spans.mixed(found) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=size).astype(np.uint8) & 1).tobytes()


def short_parity(found: np.ndarray) -> np.ndarray:
    """The same in SHORT words, whatever the size of the set."""
    place = (spans.mixed(found) & np.uint64(64 * SHORT - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * SHORT).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def most_common(a: bytes, b: bytes, sizes: int) -> int:
    """No fewer than the shingles two sets have in common: where their parities differ, some shingle
    is in one of them alone."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (sizes - int(np.bitwise_count(x ^ y).sum())) // 2


def _prefixes(rank: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = spans.Hasher(fold=True)
        shift = np.uint64(64 - BUCKET_BITS)
        low = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
        for batch in batches:
            member, n, grp, bits, short, tokens, ends = [], [], [], [], [], [], [0]
            for found in sets(batch.column(0), hasher):
                if not len(found):
                    continue
                # the bucket gives way to its rank: another order of the same tokens
                ordered = np.sort(rank[(found >> shift).view(np.int64)] << shift | found & low)
                prefix = ordered[: len(found) - -(-LEAST * len(found) // 100) + 1]
                member.append(identity(found))
                n.append(len(found))
                bits.append(parity(found))
                short.append(short_parity(found).tolist())
                grp.append(identity(prefix ^ np.uint64(len(found))))
                tokens.append(prefix)
                ends.append(ends[-1] + len(prefix))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spans.signed(flat)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(member, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(grp, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(short, pa.list_(pa.int64())),
                    lists,
                ],
                names=["member", "n", "grp", "parity", "short", "tokens"],
            )

    return make


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), shared.text_hash(text).alias("t"), F.col(text).alias("text"))


def _fits(n: str, at: str, other_n: str, other_at: str) -> Column:
    """Whether sizes and places of a shared token leave room for the similarity."""
    a, b, i, j = F.col(n), F.col(other_n), F.col(at), F.col(other_at)
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * LEAST
    most = F.least(i, j) + 1 + F.least(a - 1 - i, b - 1 - j)
    return sizes & (most * (100 + LEAST) >= (a + b) * LEAST)


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x <> y").distinct()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = spans.Hasher(fold=True)
    for batch in batches:
        x, y = (batch.column(i).to_numpy() for i in (0, 1))
        known: dict[int, np.ndarray] = {}
        for members, texts in ((x, batch.column(2)), (y, batch.column(3))):
            distinct, at = np.unique(members, return_index=True)
            known.update(zip(distinct.tolist(), sets(texts.take(pa.array(at)), hasher)))
        links = []
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = known[i], known[j]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            links.append(100 * both >= LEAST * (len(a) + len(b) - both))
        mask = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"]
        )


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y, n, m, a, b = (batch.column(i).to_pylist() for i in range(6))
        keep = [
            (100 + LEAST) * most_common(p, q, i + j) >= LEAST * (i + j) for i, j, p, q in zip(n, m, a, b)
        ]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["x", "y"]
        )


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose parities leave room for the similarity; no pair that links is lost."""
    for side in ("x", "y"):
        named = marks.select(
            F.col("member").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"parity_{side}")
        )
        pairs = pairs.join(named, side)
    wanted = pairs.select("x", "y", "n_x", "n_y", "parity_x", "parity_y")
    return shared.written(wanted.mapInArrow(spans.tidy(_possible), "x BIGINT, y BIGINT"), "jaccard-possible")


def verify(pairs: DataFrame, marks: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of members that link: first by parity, then by the whole texts of one document of each."""
    pairs = possible(pairs, marks)
    involved = pairs.select(F.col("x").alias("member")).unionByName(pairs.select(F.col("y").alias("member"))).distinct()
    chosen = shared.written(involved.join(reps, "member").select("member", "doc", "t"), "jaccard-involved")
    bits = shared.filter_of(chosen.select(F.xxhash64("doc", "t").alias("k")), "k")
    near = shared.maybe_in(rows, F.xxhash64("doc", "t"), bits)
    same = near["doc"].eqNullSafe(chosen["doc"]) & (near["t"] == chosen["t"])
    texts = near.join(chosen, same).select("member", "text").dropDuplicates(["member"])
    texts = shared.written(texts, "jaccard-texts")
    # the one in more pairs last, so that its rows come together
    left = pairs.join(texts.withColumnsRenamed({"member": "y", "text": "text_y"}), "y")
    both = left.join(texts.withColumnsRenamed({"member": "x", "text": "text_x"}), "x")
    found = both.select("x", "y", "text_x", "text_y").mapInArrow(spans.tidy(_linked), "u BIGINT, v BIGINT")
    out = shared.written(found, "jaccard-links")
    shared.drop_table(texts)
    return out


def _open_lists(lists: DataFrame, in_group: DataFrame, heads: DataFrame, marks: DataFrame, part: DataFrame) -> DataFrame:
    """The members under each shared token that the links so far leave in several components, with the
    component most of them are in, and the tokens of that kind that come before in the member's order."""
    placed = in_group.select("grp", "member").join(part, F.col("member") == F.col("node"), "left")
    placed = placed.select("grp", "member", F.coalesce("component", "member").alias("component"))
    # what a group's members are in, with how many of them
    in_parts = placed.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("k"))
    # a group is a list of its own, as its members share their first token
    several = heads.where("k > 1").select("grp")
    tokens = lists.select("token", "grp").join(in_parts, "grp").select("token", "component", "k")
    own = in_parts.join(several, "grp").select(F.col("grp").alias("token"), "component", "k")
    per_token = tokens.unionByName(own).groupBy("token", "component").agg(F.sum("k").alias("k")).groupBy("token")
    mixed = per_token.agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "k").alias("main"))
    mixed = shared.written(mixed.where("parts > 1").select("token", "main"), "jaccard-mixed")
    words = [F.col("short")[i].alias(f"p{i}") for i in range(SHORT)]
    # a group has as many rows here as its prefix has tokens at most
    order = Window.partitionBy("grp").orderBy("at")
    before = F.array_compact(F.array(*[F.lag("token", i + 1).over(order) for i in range(BACK)]))
    open_ = lists.select("token", "grp", "n", "at").join(mixed, "token").withColumn("back", before)
    open_ = open_.join(placed, "grp").select("token", "grp", "n", "at", "back", "main", "member", "component")
    alike = placed.join(several, "grp").join(mixed.withColumnRenamed("token", "grp"), "grp")
    alike = alike.join(in_group, ["grp", "member"]).select(
        F.col("grp").alias("token"), F.lit(None).cast("long").alias("grp"), "n", F.lit(0).alias("at"),
        F.array().cast("array<bigint>").alias("back"), "main", "member", "component",
    )
    found = open_.unionByName(alike).join(marks.select("member", *words), "member")
    return shared.written(found, "jaccard-open")


def _room() -> Column:
    """Whether the short parities leave room: where they differ, some shingle is in one set alone."""
    words = [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"_p{i}"))) for i in range(SHORT)]
    both = F.col("n") + F.col("_n")
    return (both - sum(words, F.lit(0))) * (100 + LEAST) >= both * (2 * LEAST)


def _some_pairs(opened: DataFrame, turn: int) -> DataFrame:
    """Two candidates at most for each member: neighbours under some token, in an order of this turn."""
    order = Window.partitionBy("token").orderBy(F.xxhash64("member", F.lit(turn)))
    names = ["n", "at", "member", "component", *[f"p{i}" for i in range(SHORT)]]
    seen = opened.select("token", *names, *[F.lag(c).over(order).alias(f"_{c}") for c in names])
    near = seen.where((F.col("component") != F.col("_component")) & _fits("n", "at", "_n", "_at") & _room())
    lot = F.xxhash64("token", F.lit(turn))
    two = near.groupBy("member").agg(
        F.min_by("_member", lot).alias("a"), F.max_by("_member", lot).alias("b")
    )
    return _pairs(two, "member", "a").unionByName(_pairs(two, "member", "b")).distinct()


def _all_pairs(opened: DataFrame) -> DataFrame:
    """Every candidate pair of members in different components.

    A pair that shares one of the tokens just before has met under that one, and members of one group meet
    under the group: so of a run of shared tokens the first alone gives the pair.  The first token that
    two members share has none before it, and no pair is lost."""
    a, b = opened.where("component <> main"), opened
    names = ["grp", "back", "n", "at", "member", "component", *[f"p{i}" for i in range(SHORT)]]
    b = b.select("token", *[F.col(c).alias(f"_{c}") for c in names])
    apart = (F.col("component") != F.col("_component")) & (
        (F.col("_component") == F.col("main")) | (F.col("member") < F.col("_member"))
    )
    new = F.coalesce(F.col("grp") != F.col("_grp"), F.lit(True)) & ~F.arrays_overlap("back", "_back")
    met = a.join(b, (a["token"] == b["token"]) & apart & new & _fits("n", "at", "_n", "_at") & _room())
    return _pairs(met, "member", "_member")


def members(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t, n, component, cluster) of every row; component is the least doc that links reach, and
    cluster tells components apart even where ids repeat."""
    shared.small_batches(docs.sparkSession)
    rows = _rows(docs, key, text)
    shapes = shared.written(rows.mapInArrow(spans.tidy(_shapes), SHAPES), "jaccard-shapes")
    rank = bucket_ranks(shapes)

    full = shapes.where("is_doc and n > 0").select("doc", "t", "n", "member")
    reps = full.groupBy("member").agg(F.min(F.struct("doc", "t")).alias("r"), F.min("doc").alias("least"))
    reps = shared.written(reps.select("member", "r.doc", "r.t", "least"), "jaccard-reps")
    bits = shared.filter_of(reps.select(F.xxhash64("doc", "t").alias("k")), "k")
    chosen = shared.maybe_in(rows, F.xxhash64("doc", "t"), bits).select("text")
    prefixes = shared.written(chosen.mapInArrow(spans.tidy(_prefixes(rank)), PREFIXES), "jaccard-prefixes")

    in_group = shared.written(prefixes.groupBy("grp", "member").agg(F.any_value("n").alias("n")), "jaccard-groups")
    sizes = in_group.groupBy("grp").agg(F.min("member").alias("head"), F.count(F.lit(1)).alias("k"))
    heads = shared.written(sizes, "jaccard-heads")
    groups = prefixes.groupBy("grp", "n").agg(F.any_value("tokens").alias("tokens"))
    posted = groups.select("grp", "n", F.posexplode("tokens").alias("at", "token"))
    order = Window.partitionBy("token").orderBy("n", "grp")
    seen = posted.select(
        "*",
        *[F.first(c).over(order).alias(f"first_{c}") for c in ("grp", "n", "at")],
        *[F.lag(c).over(order).alias(f"last_{c}") for c in ("grp", "n", "at")],
        F.lead("grp").over(order).alias("next_grp"),
    )
    shared_tokens = F.col("last_grp").isNotNull() | F.col("next_grp").isNotNull()
    lists = shared.written(seen.where(shared_tokens).drop("next_grp"), "jaccard-lists")
    marks = shared.written(
        prefixes.groupBy("member").agg(
            *[F.any_value(c).alias(c) for c in ("n", "parity", "short")]
        ),
        "jaccard-marks",
    )
    shared.drop_table(prefixes)

    near = [
        _pairs(lists.where(_fits("n", "at", f"{w}_n", f"{w}_at")), "grp", f"{w}_grp") for w in ("first", "last")
    ]
    near = near[0].unionByName(near[1]).distinct()
    for side in ("x", "y"):
        named = heads.select(F.col("grp").alias(side), F.col("head").alias(f"head_{side}"))
        near = near.join(named, side)
    inside = in_group.join(heads.where("k > 1"), "grp").where("member <> head")
    tried = _pairs(near, "head_x", "head_y").unionByName(_pairs(inside, "member", "head")).distinct()
    tried = shared.written(tried, "jaccard-tried")
    part = shared.written(components(verify(tried, marks, reps, rows)), "jaccard-parts")
    for turn in range(TURNS):
        pairs = _some_pairs(_open_lists(lists, in_group, heads, marks, part), turn)
        pairs = shared.written(pairs.join(tried, ["x", "y"], "left_anti"), "jaccard-pairs")
        tried = tried.unionByName(pairs)
        part = extended(part, verify(pairs, marks, reps, rows))
    rest = _all_pairs(_open_lists(lists, in_group, heads, marks, part))
    rest = shared.written(rest.join(tried, ["x", "y"], "left_anti"), "jaccard-rest")
    final = extended(part, verify(rest, marks, reps, rows))

    named = reps.select("member", "least").join(final, F.col("member") == F.col("node"), "left")
    named = named.select("member", "least", F.coalesce("component", "member").alias("c"))
    ids = named.groupBy("c").agg(F.min("least").alias("component"))
    ids = named.join(ids, "c").select("member", "component", F.col("c").alias("cluster"))
    linked = full.join(shared.written(ids, "jaccard-ids"), "member")
    empty = shapes.where("is_doc and n = 0").withColumns(
        {"component": F.col("doc"), "cluster": F.xxhash64(F.lit(0), "doc", "t")}
    )
    names = ["doc", "t", "n", "component", "cluster"]
    return linked.select(*names).unionByName(empty.select(*names))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the least id, with the columns it came with.

    Documents without words are not linked and all stay."""
    found = shared.written(members(docs, key, text), "jaccard-members")
    heads = found.where("n > 0").groupBy("cluster").agg(
        F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "t")).alias("head")
    )
    heads = shared.written(heads, "jaccard-heads")
    apart = ~(F.col("doc").eqNullSafe(F.col("head.doc")) & (F.col("t") == F.col("head.t")))
    gone = found.where("n > 0").join(heads, "cluster").where(apart).select("doc", "t")
    rows = shared.packed(docs, id=F.col(key).cast("long"), t=shared.text_hash(text))
    return shared.without(rows, gone, {"id": "doc", "t": "t"}).select("row.*")
