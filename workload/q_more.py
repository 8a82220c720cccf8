"""Sequence diff, page chains, differing rows, facets and united activity, on data derived from the given
tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.operators import activity, facets, rule_index, search_index
from transhume.plans import differences, incremental, reports
from transhume.session import scratch_dir
from transhume.sinks import reports as sinks
from transhume.sources import chains
from transhume.values import Rule
from workload import views
from workload.q_fields import OWNER
from workload.q_scan import analysis
from workload.registry import query
from workload.views import ASSETS, SCAN, TABLES, UNITS, with_


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one numbered word a line, and the same with lines left out and put in."""
    lines = "transform(split(regexp_replace(content, '[^a-z ]', ''), ' ', -1), (w, i) -> concat(i, ':', w))"
    # what is null is left out as the lines are joined
    after = r"""transform(ls, (l, i) -> if(i % 7 = 2, if(i % 5 = 3, concat('new ', i), concat(l, '\n', 'new ', i)),
        if(i % 5 = 3, null, l)))"""
    rows = views.assets(spark, sf_dir).select("path", F.expr(lines).alias("ls"))
    return rows.select(
        "path",
        F.col("path").alias("converted_key"),
        F.lit("").alias("header"),
        F.array_join("ls", "\n").alias("before"),
        F.array_join(F.expr(after), "\n").alias("body"),
    )


@query(
    "conv_sequence",
    with_(ASSETS)
    + r"""ls AS (SELECT path, i - 1 AS i, (i - 1) || ':' || regexp_replace(w[i], '[^a-z]', '', 'g') AS line
      FROM (SELECT path, w, unnest(generate_series(1, len(w))) AS i
        FROM (SELECT path, string_split(content, ' ') AS w FROM assets_v))),
    runs AS (SELECT *, sum(CASE WHEN i % 5 <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS run FROM ls),
    ops AS (SELECT path, run, CASE WHEN i % 5 = 3 THEN 1 ELSE 0 END AS rank, i,
        CASE WHEN i % 5 = 3 THEN '-' ELSE ' ' END AS op, line FROM runs
      UNION ALL SELECT path, run, 2, i, '+', 'new ' || i FROM runs WHERE i % 7 = 2)
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY run, rank, i) - 1 AS INTEGER) AS seq, op, line
    FROM ops""".replace("ls AS", ", ls AS", 1),
)
def conv_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diff of edited sources, read back from the report that was written."""
    path = scratch_dir(spark, "sequence-report")
    sinks.write_conversion_report(edited(spark, sf_dir), path, packed=True, rules=())
    report = spark.read.schema("path STRING, diffs ARRAY<STRUCT<op: STRING, line: STRING>>").json(path)
    return report.select("path", F.posexplode("diffs").alias("seq", "d")).select("path", "seq", "d.*")


PAGES = """listed AS (
SELECT catalog || '.' || schema AS listing, name, ord,
  row_number() OVER (PARTITION BY catalog, schema ORDER BY ord) - 1 AS r,
  count(*) OVER (PARTITION BY catalog, schema) AS total, min(ord) OVER (PARTITION BY catalog, schema) % 5 AS fault
FROM tables_v)"""


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three tables, a chain for each schema.  Of every five chains with three pages and more, one
    lacks its second page, one runs back into it, and one has its first page twice."""
    from pyspark.sql import Window

    one = Window.partitionBy("catalog", "schema")
    rows = views.tables(spark, sf_dir).select(
        F.concat_ws(".", "catalog", "schema").alias("listing"),
        F.struct("name").alias("item"),
        "ord",
        (F.row_number().over(one.orderBy("ord")) - 1).alias("r"),
        F.count(F.lit(1)).over(one).alias("total"),
        (F.min("ord").over(one) % 5).alias("fault"),
    )
    page = F.floor(F.col("r") / 3)
    last = F.floor((F.col("total") - 1) / 3)
    token = F.when(F.col("page") > 0, F.concat("listing", F.lit("#"), F.col("page").cast("string")))
    follows = F.concat("listing", F.lit("#"), (F.col("page") + 1).cast("string"))
    back = F.concat("listing", F.lit("#1"))
    pages = rows.groupBy("listing", page.alias("page"), last.alias("last"), "fault").agg(
        F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("sorted")
    )
    pages = pages.where(~((F.col("fault") == 1) & (F.col("last") >= 2) & (F.col("page") == 1)))
    following = F.when(F.col("page") < F.col("last"), follows).when(
        (F.col("fault") == 2) & (F.col("last") >= 2), back
    )
    times = F.when((F.col("fault") == 3) & (F.col("page") == 0), 2).otherwise(1)
    pages = pages.withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    return pages.select(
        "listing",
        F.col("sorted.item").alias("tables"),
        token.alias("page_token"),
        F.when(F.col("fault") != 4, following).alias("next_page_token"),
        F.when(F.col("fault") == 4, following).alias("next_page"),
    )


@query(
    "src_page_chain",
    with_(TABLES, PAGES)
    + """, p AS (SELECT listing, r // 3 AS page, (total - 1) // 3 AS last, fault,
        string_agg(name, ',' ORDER BY ord) AS names, min(r) AS first_r FROM listed GROUP BY ALL),
    q AS (SELECT *, CASE WHEN last >= 2 THEN fault ELSE 0 END AS f FROM p),
    s AS (SELECT *, CASE WHEN f = 1 AND page = 1 THEN 'missing' WHEN f = 1 AND page = 0 THEN 'next missing'
        WHEN f = 1 THEN 'unreached' WHEN f = 2 AND page = last THEN 'loops' ELSE 'ok' END AS status FROM q)
    SELECT listing, CASE WHEN page = 0 THEN '' ELSE listing || '#' || page END AS token, status,
      CASE WHEN status NOT IN ('missing', 'unreached') THEN page::BIGINT END AS place,
      CASE WHEN status = 'missing' THEN 0 WHEN fault = 3 AND page = 0 THEN 2 ELSE 1 END::BIGINT AS given,
      CASE WHEN status NOT IN ('missing', 'unreached') THEN names END AS names,
      CASE WHEN status NOT IN ('missing', 'unreached') THEN
        CAST(sum(CASE WHEN status NOT IN ('missing', 'unreached') THEN len(string_split(names, ',')) ELSE 0 END)
          OVER (ORDER BY listing, page) - len(string_split(names, ',')) AS BIGINT) END AS first_ord
    FROM s""",
)
def src_page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's place and state, with the tables on it in order."""
    root = scratch_dir(spark, "chained-pages")
    saved_pages(spark, sf_dir).write.json(root)
    items, chain = chains.read_chain(spark, root, "tables ARRAY<STRUCT<name: STRING>>", "listing")
    names = items.groupBy("listing", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",").alias("names"),
        F.min("ord").alias("first_ord"),
    )
    rows = chain.join(names, ["listing", "place"], "left")
    return rows.select("listing", "token", "status", "place", "given", "names", "first_ord")


@query(
    "job_differences",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' ELSE 'changed' END AS kind,
      1::BIGINT AS n_source, CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 71 = 0 THEN 2 ELSE 1 END::BIGINT AS n_copy
    FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 71 = 0
    UNION ALL SELECT -o_orderkey - 1, 'added', 0, 1 FROM orders WHERE o_orderkey % 83 = 0""",
)
def job_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with orders left out, changed, written twice and made up."""
    source = views.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    made_up = source.where(key % 83 == 0).withColumn("o_orderkey", -key - 1)
    twice = source.where((key % 71 == 0) & (key % 97 != 0))
    price = F.when(key % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    copy = source.where(key % 97 != 0).withColumn("o_totalprice", price).unionByName(twice).unionByName(made_up)
    path = scratch_dir(spark, "differing")
    copy.write.parquet(path)
    return differences.differing_rows(source, spark.read.schema(source.schema).parquet(path), ["o_orderkey"])


def facet_sql(name: str, others: str) -> str:
    return f"""SELECT '{name}' AS facet, {name} AS value, count(*) FILTER ({others}) AS n, count(*) AS n_all
      FROM analysis WHERE {name} IS NOT NULL GROUP BY {name}"""


@query(
    "agg_facet_counts",
    with_(ASSETS, SCAN)
    + facet_sql("language", "complexity = 'simple' AND risk = 'red'")
    + " UNION ALL " + facet_sql("complexity", "language = 'PYTHON' AND risk = 'red'")
    + " UNION ALL " + facet_sql("risk", "language = 'PYTHON' AND complexity = 'simple'")
    + " UNION ALL " + facet_sql("owner", "language = 'PYTHON' AND complexity = 'simple' AND risk = 'red'"),
)
def agg_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["language", "complexity", "risk", "owner"]
    chosen = {"language": "PYTHON", "complexity": "simple", "risk": "red", "owner": "All"}
    return facets.facet_counts(analysis(spark, sf_dir), names, chosen)


def repeated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for each user, listed once for each kind of event and every half of the month."""
    events = views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    half = F.floor(F.col("t") / (15 * 86400000))
    spans = events.groupBy("user_id", "event_type", half.alias("half")).agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.min("event_id").alias("ord")
    )
    user = F.col("user_id")
    return spans.select(
        "ord",
        F.concat(F.lit("u"), user.cast("string")).alias("cluster_id"),
        (user % 5).cast("int").alias("num_workers"),
        F.lit(None).cast("struct<min_workers: int>").alias("autoscale"),
        F.lit("").alias("driver_node_type_id"),
        views.case("ord % 3", n0="'i3.large'", n1="'i3.xlarge'", n2="'m5.metal'").alias("node_type_id"),
        F.when(user % 9 != 0, F.col("a")).alias("start_time"),
        F.lit(None).cast("long").alias("created_time"),
        F.col("b").alias("terminated_time"),
        F.lit(None).cast("long").alias("end_time"),
    )


@query(
    "cost_activity",
    f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS t FROM events),
    s AS (SELECT user_id, event_type, t // 1296000000 AS half, min(t) / 1000.0::DOUBLE AS a, max(t) / 1000.0::DOUBLE AS b,
      min(event_id) AS ord FROM e GROUP BY user_id, event_type, t // 1296000000),
    w AS (SELECT user_id, greatest(a, {views.AS_OF - 30 * 86400}) AS a, b FROM s WHERE user_id % 9 <> 0),
    o AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
      FROM w WHERE b > a),
    h AS (SELECT user_id, sum(greatest(b - greatest(a, coalesce(m, a)), 0)) / 3600.0 AS hours FROM o GROUP BY user_id),
    l AS (SELECT user_id, count(*) AS listed, max(ord) AS ord FROM s GROUP BY user_id),
    n AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'i3.large' WHEN 1 THEN 'i3.xlarge' ELSE 'm5.metal' END AS node FROM l),
    c AS (SELECT ord, 'u' || user_id AS cluster_id, listed, CAST(user_id % 5 AS INTEGER) AS workers, node,
      CASE WHEN user_id % 9 = 0 THEN 180.0 ELSE coalesce(hours, 0) END::DOUBLE AS hours
      FROM n LEFT JOIN h USING (user_id))
    SELECT ord, cluster_id, listed, workers, round(hours, 4) AS hours,
      round({UNITS.format("node")} * (1 + workers) * hours, 4) AS dbu_hours FROM c""",
)
def cost_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of clusters whose listings overlap, each hour once."""
    rows = activity.cluster_cost_once(repeated_clusters(spark, sf_dir), views.AS_OF)
    return rows.select(
        "ord", "cluster_id", "listed", "workers", F.round("hours", 4).alias("hours"), F.round("dbu_hours", 4).alias("dbu_hours")
    )


# The parts that the words of the wide rule set are made of.
PARTS = ("an", "at", "ed", "en", "er", "in", "is", "nd", "on", "or", "ou", "re", "th", "ti")
WORDS = [a + b + c for a in PARTS for b in PARTS for c in PARTS]
WIDE_RULES = [
    Rule(word, rf"\b{word}\b", (word,), issue=f"has {word}" if i % 3 == 0 else None)
    for i, word in enumerate(WORDS)
]


@query(
    "scan_many_rules",
    with_(ASSETS)
    + f""", parts AS (SELECT unnest({list(PARTS)}) AS p),
    words AS (SELECT a.p || b.p || c.p AS word,
        row_number() OVER (ORDER BY a.p, b.p, c.p) - 1 AS i FROM parts a, parts b, parts c),
    found AS (SELECT path, unnest(list_distinct(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'))) AS word
      FROM assets_v),
    hits AS (SELECT path, string_agg(word, '|' ORDER BY i) AS detected,
        coalesce(string_agg('has ' || word, '|' ORDER BY i) FILTER (WHERE i % 3 = 0), '') AS issues
      FROM found JOIN words USING (word) GROUP BY path)
    SELECT path, coalesce(detected, '') AS detected, coalesce(issues, '') AS issues
    FROM assets_v LEFT JOIN hits USING (path)""",
)
def scan_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,744 rules in one scan."""
    rows = rule_index.scan_rules(views.assets(spark, sf_dir), WIDE_RULES, issues="issues")
    return rows.select(
        "path",
        F.array_join("detected_patterns", "|").alias("detected"),
        F.array_join("issues", "|").alias("issues"),
    )


@query(
    "job_analyze_again",
    with_(
        ASSETS,
        """first_run AS (SELECT DISTINCT content FROM assets_v),
        edited AS (SELECT * REPLACE (content || CASE WHEN ord % 4 = 1 THEN 'display(spark.read)' || chr(10)
            ELSE '' END AS content) FROM assets_v)""",
        SCAN.replace("FROM assets_v)", "FROM edited)", 1),
    )
    + """SELECT path, language, complexity, issues, suggestions, detected, risk, summary, loc,
      (SELECT count(*) FROM (SELECT DISTINCT content FROM edited EXCEPT SELECT content FROM first_run)) AS n_scanned
    FROM analysis""",
)
def job_analyze_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources analysed, a quarter of them changed, and all analysed again from the stored results."""
    store = scratch_dir(spark, "results")
    rows = views.assets(spark, sf_dir)
    incremental.add_results(rows, store)
    more = F.when(F.col("ord") % 4 == 1, F.lit("display(spark.read)\n")).otherwise(F.lit(""))
    rows = rows.withColumn("content", F.concat("content", more))
    n_scanned = incremental.add_results(rows, store)
    return incremental.analyze(rows, store).select(
        "path",
        "language",
        "complexity",
        F.array_join("issues", ", ").alias("issues"),
        F.array_join("suggestions", ", ").alias("suggestions"),
        F.array_join("detected_patterns", "|").alias("detected"),
        "risk",
        "summary",
        "loc",
        F.lit(n_scanned).cast("long").alias("n_scanned"),
    )


# Longer than a run, a run, shorter than one, in the other case, absent.
SEARCHES = ("/users/src1", "rc1", "7", "OWNER_F", "src1/17", "absent text")


@query(
    "flt_search_index",
    with_(ASSETS)
    + f""", fields AS (SELECT path, split_part(path, '/', -1) AS name, {OWNER} AS owner FROM assets_v),
    texts AS (SELECT unnest({list(SEARCHES)}) AS text)
    SELECT text, path, owner FROM texts JOIN fields ON contains(lower(path), lower(text))
      OR contains(lower(name), lower(text)) OR contains(lower(owner), lower(text))""",
)
def flt_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches by one stored index."""
    rows = reports.report_fields(views.assets(spark, sf_dir)).select("path", "name", "owner")
    path = scratch_dir(spark, "search-index")
    search_index.build(rows, path)
    found = [search_index.search(spark, path, text, rows.schema).withColumn("text", F.lit(text)) for text in SEARCHES]
    return reduce(DataFrame.unionByName, found).select("text", "path", "owner")
