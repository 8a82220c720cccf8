"""Secret scans with multipart credential linking.

Strong kinds are reported wherever they stand: assigned secrets, access identifiers, long hex strings.
Weak kinds say little alone: a named id, a long mixed key, an endpoint.  They are reported only where their
complements stand within SCOPE characters: a key next to an identifier, a named id next to a secret, an
endpoint next to both an identifier and a secret.  Parts and weak candidates meet in an interval join:
each is dealt to the stretches of SCOPE characters it touches, and a semi join compares those of one
document and stretch, so no pairs come out, and a stretch holds only as many parts as fit in it.

Places count code points, end exclusive.  They follow from the lengths of the matches and of the text between
them, added up over the matches of a document.  All of it is DataFrame expressions.  Texts are read once;
only the matches move.

A null text is empty.  A document is known by doc_id and text: rows that repeat both get the same result
each, and rows that repeat only the id their own.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transhume.llm import shared

SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_OWNERS = "|".join(_any_case(w) for w in ("client", "account", "user", "app", "key"))
_SET = r"""["']?\x20*[:=]\x20*["']?"""

#: kind -> (pattern, group that is measured, least length of it).  The first three are strong.
KINDS = {
    "assign": (f"({_NAMES}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
    "ident": (f"({_OWNERS})_?{_any_case('id')}{_SET}([A-Za-z0-9_.-]+)", 2, 6),
    "key": ("[A-Za-z0-9+/]{32,}", 0, 32),
    "endpoint": (r"[a-z]+://[^\x00-\x20" + "\"'<>]+", 0, 8),
}
STRONG = ("assign", "access", "hex")
IDENTIFIERS = ("access", "ident")
SECRETS = ("assign", "hex", "key")
#: A document without any of these has nothing to report.
TELLING = ("assign", "access", "hex", "ident", "key")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc"), shared.text_hash(text).alias("t"), content.alias("text"))


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t, kind, start, end) of all matches that are long enough, as a table."""
    some = F.lit(False)
    for kind in sorted(TELLING, key=lambda k: k != "access"):
        pattern = KINDS[kind][0]
        some = some | (F.col("text").contains("AKIA") if kind == "access" else F.col("text").rlike(pattern))
    rows = _rows(docs, key, text).where(some)
    found = []
    for kind, (pattern, group, _) in KINDS.items():
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        measured = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
        between = F.split("text", pattern, -1)
        lengths = F.transform(
            F.arrays_zip(between.alias("b"), whole.alias("w"), measured.alias("m")),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                F.char_length(x["b"]).cast("long").alias("gap"),
                F.char_length(x["w"]).cast("long").alias("size"),
                F.char_length(x["m"]).alias("least"),
                # a weak key mixes digits and both cases
                (F.lit(kind != "key") | (x["w"].rlike("[0-9]") & x["w"].rlike("[a-z]") & x["w"].rlike("[A-Z]"))).alias("mixed"),
            ),
        )
        found.append(lengths)
    exploded = rows.dropDuplicates(["doc", "t"]).select("doc", "t", F.explode(F.array(*found)).alias("list"))
    each = exploded.select("doc", "t", F.posexplode("list").alias("i", "p")).select("doc", "t", "i", "p.*")
    each = each.where(F.col("size").isNotNull())
    order = Window.partitionBy("doc", "t", "kind").orderBy("i")
    ends = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])]), F.col("kind"))
    placed = each.withColumn("end", ends).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.where((F.col("least") >= least) & F.col("mixed"))
    return shared.written(placed.select("doc", "t", "kind", "start", "end"), "secrets-parts")


def _stretches(df: DataFrame, margin: int) -> DataFrame:
    first = F.floor((F.col("start") - margin) / F.lit(SCOPE))
    last = F.floor((F.col("end") + margin) / F.lit(SCOPE))
    return df.withColumn("stretch", F.explode(F.sequence(first, last)))


def near(rows: DataFrame, others: DataFrame, margin: int, how: str = "left_semi") -> DataFrame:
    """The rows with one of the others within that many characters in the same document; or, with
    left_anti, those without."""
    names = rows.columns
    wide = _stretches(rows, margin)
    part = _stretches(others, 0).select(*[F.col(c).alias(f"_{c}") for c in ("doc", "t", "start", "end", "stretch")])
    same = wide["doc"].eqNullSafe(part["_doc"]) & (wide["t"] == part["_t"]) & (wide["stretch"] == part["_stretch"])
    # with margin 0, those that overlap
    close = (F.col("_start") < F.col("end") + F.lit(margin)) & (F.col("_end") > F.col("start") - F.lit(margin))
    met = wide.join(part, same & close, "left_semi").select(*names).distinct()
    if how == "left_semi":
        return met
    left = [rows[c].eqNullSafe(met[c]) for c in names]
    return rows.join(met, left, "left_anti")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t, kind, start, end) of everything reported, as a table."""
    found = parts(docs, key, text)
    strong = found.where(F.col("kind").isin(*STRONG))
    weak = shared.written(near(found.where(~F.col("kind").isin(*STRONG)), strong, 0, "left_anti"), "secrets-weak")
    every = strong.unionByName(weak)
    ids = every.where(F.col("kind").isin(*IDENTIFIERS))
    secrets = every.where(F.col("kind").isin(*SECRETS))
    keys = near(weak.where("kind = 'key'"), ids, SCOPE)
    named = near(weak.where("kind = 'ident'"), secrets, SCOPE)
    points = near(near(weak.where("kind = 'endpoint'"), ids, SCOPE), secrets, SCOPE)
    return shared.written(strong.unionByName(keys).unionByName(named).unionByName(points), "secrets-found")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of KINDS."""
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base (strong spans) and spans (all)."""
    found = scan(docs, key, text)
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    span = F.struct("start", number.alias("number"), "end", "kind")
    strong = F.col("kind").isin(*STRONG)
    marks = found.groupBy("doc", "t").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in STRONG],
        _listed(F.collect_list(F.when(strong, span))).alias("base"),
        _listed(F.collect_list(span)).alias("spans"),
    )
    marks = shared.written(marks, "secrets-marks")
    rows = docs.select(F.col(key).alias("_doc"), shared.text_hash(text).alias("_t"))
    joined = rows.join(marks, rows["_doc"].eqNullSafe(marks["doc"]) & (rows["_t"] == marks["t"]), "left")
    return joined.select(
        F.col("_doc").alias(key),
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in STRONG],
        F.coalesce("base", F.lit("")).alias("base"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
