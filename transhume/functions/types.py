"""Column metadata given as JSON of varying shape: names, rendered types, nullability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transhume.functions.scalars import bind
from transhume.schemas import COLUMN_LIST

# Where the parts of a column entry are looked for, in this order.
NAME_KEYS = ("name", "column_name", "field", "col_name")
TYPE_KEYS = ("type", "data_type", "dtype", "type_name", "dataType")
FIELD_NAME_KEYS = ("name", "field")
FIELD_TYPE_KEYS = ("type", "data_type", "dtype")

# Levels rendered by one expression each; what is nested deeper is read token by token.
DEPTH = 3

TOKEN = r'[{}\[\],:]|"(?:[^"\\]|\\.)*+"|[^{}\[\],:"\s]+'
# A value that has been read: its rendering as a type, its text, whether it is given (not JSON null) and
# an object, its rendering as a field, and as the fields of a struct where it is a list of objects.
VALUE = "struct<r: string, s: string, g: boolean, o: boolean, fr: string, fields: string>"
# An object or list still open: its members, and the key that waits for its value.
FRAME = f"struct<obj: boolean, key: string, vals: map<string,{VALUE}>, items: array<{VALUE}>, raw: string>"
BROKEN = "\0"  # a list of fields that holds something else as well
STATE = f"struct<stack: array<{FRAME}>, done: {VALUE}>"


def member(value: Column, key: str) -> Column:
    """A member as VARIANT; null when it is missing or JSON null."""
    found = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(~F.is_variant_null(found), found)


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; only its outermost level is looked at."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def scalar_kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ..; meant for scalars, as it walks through whole objects."""
    return F.schema_of_variant(value)


def members(value: Column) -> Column:
    """An object as a map from key to VARIANT, null for anything else.

    Several keys are looked up in each object, which a map serves faster than a path each.
    """
    return F.try_variant_get(value, "$", "map<string,variant>")


def given(found: Column) -> Column:
    return F.when(~F.is_variant_null(found), found)


def first_given(m: Column, *keys: str) -> Column:
    return F.coalesce(*[given(m[key]) for key in keys])


def first_text(m: Column, *keys: str) -> Column:
    texts = [F.try_variant_get(m[key], "$", "string") for key in keys]
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])


def render_type(value: Column, depth: int = DEPTH) -> Column:
    """A SQL-like type text for a VARIANT type description.

    Order: missing, plain text, decimal, struct with fields, array, nested type, JSON text.
    Expressions cannot recurse, so the first ``depth`` levels are unrolled, which is fast for what
    is nearly always met, and an object below them is folded over its tokens, however deep it is.
    """
    return bind(value, lambda v: rendered(v, depth))


def rendered(value: Column, depth: int) -> Column:
    text = F.try_variant_get(value, "$", "string")
    # Only a boolean reads true or false without quotes, and only texts are quoted in JSON.
    plain = F.when(
        text.isin("true", "false") & (scalar_kind(value) == "BOOLEAN"), F.initcap(text)
    ).otherwise(text)
    plain = F.coalesce(plain, F.lit("string"))
    if depth == 0:
        return F.when(is_object(value), folded(value)).otherwise(
            F.when(value.isNull() | F.is_variant_null(value), F.lit("string")).otherwise(plain)
        )
    of_object = bind(members(value), lambda m: F.when(m.isNotNull(), render_object(m, text, depth)))
    return F.when(value.isNull() | F.is_variant_null(value), F.lit("string")).otherwise(
        F.coalesce(of_object, plain)
    )


def inner_types(m: Column, fields: Column) -> Column:
    """What a type description holds, as (prefix, type): its fields, or its one inner type.

    One list for both keeps the unrolled expression from doubling at every level.
    """

    def field(f: Column) -> Column:
        name = F.coalesce(first_text(f, *FIELD_NAME_KEYS), F.lit("None"))
        return F.struct(
            F.concat(name, F.lit(":")).alias("prefix"),
            first_given(f, *FIELD_TYPE_KEYS).alias("type"),
        )

    one = F.struct(
        F.lit("").alias("prefix"),
        F.coalesce(m["elementType"], given(m["type"])).alias("type"),
    )
    return F.coalesce(F.transform(fields, field), F.array(one))


def render_object(m: Column, text: Column, depth: int) -> Column:
    precision, scale = first_text(m, "precision"), first_text(m, "scale")
    decimal = F.concat(F.lit("decimal("), precision, F.lit(","), scale, F.lit(")"))
    fields = F.try_variant_get(m["fields"], "$", "array<map<string,variant>>")
    inner = F.transform(
        inner_types(m, fields),
        lambda i: F.concat(i["prefix"], render_type(i["type"], depth - 1)),
    )
    has_fields, has_element = fields.isNotNull(), m["elementType"].isNotNull()
    opening = F.when(has_fields, "struct<").when(has_element, "array<").otherwise("")
    closing = F.when(has_fields | has_element, ">").otherwise("")
    return (
        F.when(
            first_text(m, "type").isin("decimal", "numeric"),
            F.coalesce(decimal, F.lit("decimal")),
        )
        .when(F.exists(fields, F.isnull), F.lit("string"))
        .when(
            has_fields | has_element | given(m["type"]).isNotNull(),
            F.concat(opening, F.array_join(inner, ", "), closing),
        )
        .otherwise(text)
    )


def folded(value: Column) -> Column:
    """The rendering of a nested object, read in one pass over the tokens of its JSON text."""
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), F.lit(0))
    start = F.struct(
        F.array().cast(f"array<{FRAME}>").alias("stack"), F.lit(None).cast(VALUE).alias("done")
    )
    return F.aggregate(tokens, start.cast(STATE), next_token, lambda state: state["done"]["r"])


def next_token(state: Column, token: Column) -> Column:
    stack = state["stack"]
    opened = F.struct(
        (token == "{").alias("obj"),
        F.lit(None).cast("string").alias("key"),
        F.create_map().cast(f"map<string,{VALUE}>").alias("vals"),
        F.array().cast(f"array<{VALUE}>").alias("items"),
        token.alias("raw"),
    )
    pushed = with_stack(F.concat(stack, F.array(opened.cast(FRAME))))
    top = F.try_element_at(stack, F.lit(-1))
    below = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))

    def put_back(frame: Column) -> Column:
        return with_stack(F.concat(below, F.array(frame.cast(FRAME))))

    def changed(frame: Column, **parts: Column) -> Column:
        names = ("obj", "key", "vals", "items")
        kept = [parts.get(name, frame[name]).alias(name) for name in names]
        return F.struct(*kept, F.concat(frame["raw"], token).alias("raw"))

    text = F.try_variant_get(F.try_parse_json(token), "$", "string")
    is_key = top["obj"] & top["key"].isNull()
    return (
        F.when(token.isin("{", "["), pushed)
        .when(token.isin("}", "]"), bind(top, lambda frame: closed(frame, below, token)))
        .when(token.isin(",", ":"), put_back(changed(top)))
        .when(is_key, put_back(changed(top, key=text)))
        .otherwise(with_stack(F.concat(below, F.array(added(top, scalar(token, text), token)))))
    ).cast(STATE)


def with_stack(stack: Column, done: Column | None = None) -> Column:
    nothing = F.lit(None).cast(VALUE)
    last = nothing if done is None else done
    return F.struct(stack.alias("stack"), last.alias("done")).cast(STATE)


def read_value(r: Column, s: Column, g: Column, o: Column, fr: Column, fields: Column) -> Column:
    parts = {"r": r, "s": s, "g": g, "o": o, "fr": fr, "fields": fields}
    return F.struct(*[part.alias(name) for name, part in parts.items()]).cast(VALUE)


def scalar(token: Column, text: Column) -> Column:
    nothing = F.lit(None).cast("string")
    shown = F.when(token.isin("true", "false"), F.initcap(token)).otherwise(text)
    shown = F.coalesce(shown, F.lit("string"))
    return read_value(shown, text, token != "null", F.lit(False), nothing, nothing)


def added(frame: Column, value: Column, raw: Column) -> Column:
    """The open object or list with one more value."""
    more = F.map_concat(frame["vals"], F.create_map(F.coalesce(frame["key"], F.lit("")), value))
    return F.struct(
        frame["obj"].alias("obj"),
        F.lit(None).cast("string").alias("key"),
        F.when(frame["obj"], more).otherwise(frame["vals"]).alias("vals"),
        F.when(frame["obj"], frame["items"])
        .otherwise(F.concat(frame["items"], F.array(value)))
        .alias("items"),
        F.concat(frame["raw"], raw).alias("raw"),
    ).cast(FRAME)


def closed(frame: Column, below: Column, token: Column) -> Column:
    """The state after an object or list ends: its value goes to what holds it."""
    raw = F.concat(frame["raw"], token)
    value = F.when(frame["obj"], object_value(frame["vals"], raw)).otherwise(
        list_value(frame["items"], raw)
    )
    parent = F.try_element_at(below, F.lit(-1))
    outer = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    held = with_stack(F.concat(outer, F.array(added(parent, value, raw))))
    return F.when(F.size(below) == 0, with_stack(below, value)).otherwise(held)


def list_value(items: Column, raw: Column) -> Column:
    nothing = F.lit(None).cast("string")
    fields = F.transform(items, lambda v: F.coalesce(v["fr"], F.lit("None:string")))
    of_objects = F.forall(items, lambda v: v["o"])
    joined = F.when(of_objects, F.array_join(fields, ", ")).otherwise(F.lit(BROKEN))
    return read_value(raw, raw, F.lit(True), F.lit(False), nothing, joined)


def object_value(m: Column, raw: Column) -> Column:
    """The same rules as render_object, over members that have been rendered."""

    def text_of(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k))["s"], F.lit("")) for k in keys])

    def given_of(*keys: str) -> Column:
        found = [F.try_element_at(m, F.lit(k)) for k in keys]
        return F.coalesce(*[F.when(v["g"], v) for v in found])

    fields = F.try_element_at(m, F.lit("fields"))["fields"]
    element = F.try_element_at(m, F.lit("elementType"))
    nested = given_of("type")
    one = F.coalesce(element, nested)["r"]
    decimal = F.concat(
        F.lit("decimal("), text_of("precision"), F.lit(","), text_of("scale"), F.lit(")")
    )
    shown = (
        F.when(
            text_of("type").isin("decimal", "numeric"), F.coalesce(decimal, F.lit("decimal"))
        )
        .when(fields == BROKEN, F.lit("string"))
        .when(fields.isNotNull(), F.concat(F.lit("struct<"), fields, F.lit(">")))
        .when(element.isNotNull(), F.concat(F.lit("array<"), one, F.lit(">")))
        .when(nested.isNotNull(), one)
        .otherwise(raw)
    )
    name = F.coalesce(text_of(*FIELD_NAME_KEYS), F.lit("None"))
    kind = F.coalesce(given_of(*FIELD_TYPE_KEYS)["r"], F.lit("string"))
    field = F.concat(name, F.lit(":"), kind)
    return read_value(
        shown, raw, F.lit(True), F.lit(True), field, F.lit(None).cast("string")
    )


def truthy(value: Column) -> Column:
    """Truth of a VARIANT by its kind: null, false, zero, and what is empty are false.

    Any text but the empty one is true, "0" and "false" too.
    """
    kind = scalar_kind(value)
    of_scalar = (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )
    n_members = F.size(members(value))
    n_items = F.size(F.try_variant_get(value, "$", "array<variant>"))
    sized = F.when(n_members >= 0, n_members > 0).when(n_items >= 0, n_items > 0)
    return F.coalesce(sized, of_scalar, F.lit(False))


def nullable_flag(m: Column) -> Column:
    flag = F.lit(True)
    of_type = given(F.try_variant_get(m["type"], "$.nullable", "variant"))
    flag = F.when(of_type.isNotNull(), truthy(of_type)).otherwise(flag)
    for key in ("is_nullable", "nullable"):
        flag = F.when(m[key].isNotNull(), truthy(m[key])).otherwise(flag)
    return flag


def column_entry(entry: Column, depth: int = DEPTH) -> Column:
    """One entry, an object or a ``name type ..`` text, as (name, type, nullable)."""

    def from_object(m: Column) -> Column:
        schema = F.when(is_object(m["schema"]), m["schema"])
        raw_type = F.coalesce(first_given(m, *TYPE_KEYS), schema)
        return F.struct(
            first_text(m, *NAME_KEYS).alias("name"),
            render_type(raw_type, depth).alias("type"),
            nullable_flag(m).alias("nullable"),
        )

    text = F.coalesce(F.try_variant_get(entry, "$", "string"), F.lit("None"))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ", 2)
    from_text = F.struct(
        F.get(words, F.lit(0)).alias("name"),
        F.coalesce(F.get(words, F.lit(1)), F.lit("string")).alias("type"),
        F.lit(True).alias("nullable"),
    )
    return bind(
        members(entry), lambda m: F.when(m.isNotNull(), from_object(m)).otherwise(from_text)
    )


def column_entries(entries: Column, depth: int = DEPTH) -> Column:
    """An ARRAY<VARIANT> of column entries as a typed array; blank texts are no entries."""
    empty = F.array().cast(COLUMN_LIST)

    def not_blank(entry: Column) -> Column:
        text = F.trim(F.try_variant_get(entry, "$", "string"))
        return is_object(entry) | F.coalesce(text != "", F.lit(True))

    typed = F.transform(F.filter(entries, not_blank), lambda entry: column_entry(entry, depth))
    return F.coalesce(typed, empty)
