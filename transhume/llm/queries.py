"""The queries of the operators, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.llm import (
    audit,
    clustering,
    debruijn,
    encoding,
    exact,
    jaccard,
    language,
    lm,
    packing,
    secrets,
    shared,
    sharding,
    token_counts,
    wavelet,
    winnow,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


#: The matches of each kind with their places, then the links; the patterns are those of the operator.
SECRETS_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), kinds(kind, number, least) AS (VALUES "
    + ", ".join(f"('{k}', {i}, {v[2]})" for i, (k, v) in enumerate(secrets.KINDS.items()))
    + "), lists AS ("
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, string_split_regex(text, '{quoted}') AS b,
        regexp_extract_all(text, '{quoted}', 0) AS w, regexp_extract_all(text, '{quoted}', {group}) AS m FROM d"""
        for kind, quoted, group in (
            (k, v[0].replace("'", "''"), v[1]) for k, v in secrets.KINDS.items()
        )
    )
    + f"""), each AS (
        SELECT doc_id, kind, i, length(b[i]) AS gap, w[i] AS word, length(m[i]) AS measured
        FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM lists)
    ), placed AS (
        SELECT *, sum(gap + length(word)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each
    ), part AS (
        SELECT doc_id, kind, number, CAST(stop - length(word) AS BIGINT) AS a, CAST(stop AS BIGINT) AS z
        FROM placed JOIN kinds USING (kind)
        WHERE measured >= least AND (kind <> 'key' OR (regexp_matches(word, '[0-9]')
              AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]')))
    ), strong AS (SELECT * FROM part WHERE number < 3), weak AS (
        SELECT * FROM part p WHERE number >= 3 AND NOT EXISTS (
            SELECT 1 FROM strong s WHERE s.doc_id = p.doc_id AND s.a < p.z AND s.z > p.a)
    ), every AS (SELECT * FROM strong UNION ALL SELECT * FROM weak), linked AS (
        SELECT w.*,
               EXISTS (SELECT 1 FROM every e WHERE e.doc_id = w.doc_id AND e.kind IN ('access', 'ident')
                       AND e.a < w.z + {secrets.SCOPE} AND e.z > w.a - {secrets.SCOPE}) AS by_id,
               EXISTS (SELECT 1 FROM every e WHERE e.doc_id = w.doc_id AND e.kind IN ('assign', 'hex', 'key')
                       AND e.a < w.z + {secrets.SCOPE} AND e.z > w.a - {secrets.SCOPE}) AS by_secret
        FROM weak w
    ), found AS (
        SELECT * FROM strong UNION ALL SELECT doc_id, kind, number, a, z FROM linked
        WHERE CASE kind WHEN 'key' THEN by_id WHEN 'ident' THEN by_secret ELSE by_id AND by_secret END
    ), marks AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
               count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) FILTER (number < 3) AS base,
               string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) AS spans
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM d LEFT JOIN marks USING (doc_id)"""
)


#: Ten rounds, each from the centroids of the one before.
CLUSTERING_SQL = (
    f"""WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id,
               list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) = {clustering.DIM}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIM}
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v
        FROM (SELECT sha256('{clustering.SEED}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {clustering.CLUSTERS})
    )"""
    + "".join(
        f""", a{i} AS MATERIALIZED (
        SELECT r, best % {clustering.CLUSTERS} AS c, best // {clustering.CLUSTERS} AS d FROM (
            SELECT k.r, min(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {clustering.CLUSTERS} + c.c) AS best
            FROM kept k, c{i} c GROUP BY k.r)
    ), c{i + 1} AS MATERIALIZED (
        SELECT c, coalesce(m, v) AS v FROM c{i} LEFT JOIN (
            SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY i) AS m
            FROM (SELECT a.c, i, sum(v[i]) AS s, count(*) AS n
                  FROM a{i} a JOIN kept USING (r), generate_series(1, {clustering.DIM}) t(i) GROUP BY a.c, i)
            GROUP BY c) USING (c)
    )"""
        for i in range(clustering.ROUNDS + 1)
    )
    + f"""
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
           CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(e.v, ',')) AS centroid_sha256
    FROM a{clustering.ROUNDS} a JOIN kept USING (r) JOIN c{clustering.ROUNDS} e ON e.c = a.c"""
)

AUDIT_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
        FROM documents
    ), m AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
        FROM d
    ), l AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id
    ), k AS (
        SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
    ), f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ), s AS (
        SELECT filter_order, step, 1 << (strpos('ABCDE', filter_order[step]) - 1) AS bit,
               CAST(coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''),
                    lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (strpos('ABCDE', x) - 1) END)), 0) AS INTEGER) AS before
        FROM o, generate_series(1, 5) t(step)
    ), r AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
               sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept,
               sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
               sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
               sum(n) FILTER (mask = bit) AS unique_fails,
               sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
               sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
        FROM k, s GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
           CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
    FROM r
"""


@query("op1_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, by its id."""
    docs = shared.documents(spark, sf_dir).select("doc_id")
    return sharding.place(docs).select("doc_id", "slot", "shard")


@query("op2_language_mixture")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that are not held out."""
    docs = shared.documents(spark, sf_dir)
    model = language.fit(docs)
    rows = language.predict(docs, model)
    held = F.coalesce(language.held_out("doc_id"), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_langs")


@query("op3_wavelet_matrix")
def wavelet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the shard files."""
    manifest = wavelet.write_shards(
        shared.documents(spark, sf_dir),
        shared.folder(spark, "wavelet"),
        encoding.default_path("byte_bpe_50k.json"),
    )
    return wavelet.read_documents(manifest)


@query(
    "op4_winnowing",
    r"""
    WITH dw AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), iw AS (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), win AS (
        SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
              FROM iw WHERE len(w) > 0)
    ), dg AS (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
    ), hit AS (
        SELECT DISTINCT dg.* FROM dg JOIN (SELECT DISTINCT n, g FROM win) USING (n, g)
    ), covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id
    ), listed AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (n, g))
        GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def winnowing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document stands in the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = winnow.decontaminate(shared.documents(spark, sf_dir), items)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op5_grouped_prefix_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
              FROM d WHERE len(w) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), l AS (
        SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * k >= 75 * (nx.n + ny.n - k)
    ), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, c) AS (
        SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
    ), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
    """,
)
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and the least document that links reach."""
    rows = jaccard.members(shared.documents(spark, sf_dir))
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


@query("op6_best_fit_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there, and a digest of its ids."""
    rows = packing.pack(shared.documents(spark, sf_dir), encoding.default_path("byte_bpe_50k.json"))
    rows = packing.digests(rows)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_linked_secrets", SECRETS_SQL)
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and what is linked to them."""
    rows = secrets.find_secrets(shared.documents(spark, sf_dir))
    base = F.sha2("base", 256).alias("base_sha256")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", base, "spans")


@query(
    "op8_debruijn_compaction",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
    ), first AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
    gone AS (
        SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 12)))) AS p
        FROM win JOIN first USING (g) WHERE doc_id > first GROUP BY doc_id
    ), left_over AS (
        SELECT doc_id, w, coalesce(p, []) AS p FROM d LEFT JOIN gone USING (doc_id)
    ), word AS (
        SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)
    ), gone_word AS (SELECT doc_id, unnest(p) AS i FROM gone),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
        FROM word ANTI JOIN gone_word USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(p) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM left_over LEFT JOIN kept USING (doc_id)
    """,
)
def debruijn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, without the spans that smaller ids have as well."""
    return debruijn.dedup(shared.documents(spark, sf_dir))


@query("op9_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(
        shared.documents(spark, sf_dir), encoding.default_path("word_bpe_49k.json")
    )


@query(
    "op10_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
           sha256(norm) AS text_sha256
    FROM d
    """,
)
def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stands for each, after refinement."""
    docs = shared.documents(spark, sf_dir)
    digest = F.sha2(exact.normalised("text"), 256)
    return exact.refine(docs.withColumn("text_sha256", digest), keep=["text_sha256"])


@query("op11_rotated_clustering", CLUSTERING_SQL)
def clustering_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds."""
    return clustering.report(*clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


@query("op12_bloom_lm")
def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, by a model of those that are not held out."""
    docs = shared.documents(spark, sf_dir)
    return lm.score(docs, lm.train(docs))


@query("op13_filter_audit", AUDIT_SQL)
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in every order of the five."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))
