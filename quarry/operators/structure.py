"""Structure jobs: narrowest integer types, JSON flattening / lookup / deep merge, and
chains of table functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import reliable_checkpoint

# Integer types from narrowest to widest with their ranges.
INT_TYPES = [("tinyint", -(2 ** 7), 2 ** 7 - 1), ("smallint", -(2 ** 15), 2 ** 15 - 1),
             ("int", -(2 ** 31), 2 ** 31 - 1), ("bigint", -(2 ** 63), 2 ** 63 - 1)]
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def narrow_type_expr(lo: Column, hi: Column) -> Column:
    expr = None
    for name, a, b in INT_TYPES:
        cond = (lo >= a) & (hi <= b)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("bigint")


def type_report(df: DataFrame) -> DataFrame:
    """One min/max pass over every integral column → (column, min, max, narrow_type)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGRAL)]
    stats = df.agg(*[F.struct(F.min(c).cast("bigint").alias("lo"), F.max(c).cast("bigint").alias("hi"))
                     .alias(c) for c in cols])
    tall = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.lo").alias("min_value"),
                 F.col(f"{c}.hi").alias("max_value")) for c in cols])).alias("s")).select("s.*")
    return tall.withColumn("narrow_type", narrow_type_expr(F.col("min_value"), F.col("max_value")))


def shrink_types(df: DataFrame, persist: bool = True) -> DataFrame:
    """Cast integral columns to the narrowest type holding their range (values unchanged)."""
    report = {r["column_name"]: r["narrow_type"] for r in type_report(df).collect()}  # ≤ #cols
    out = df.select([F.col(f.name).cast(report[f.name]).alias(f.name) if f.name in report
                     else F.col(f.name) for f in df.schema.fields])
    return out.persist() if persist else out


def infer_json_schema(df: DataFrame, col: str) -> T.StructType:
    """Schema of a JSON text column: one aggregate over the whole column, merged in the JVM."""
    ddl = df.agg(F.schema_of_variant_agg(F.try_parse_json(col))).first()[0] or "OBJECT<>"
    kind = T._parse_datatype_string(_as_ddl(ddl)) if ddl.startswith("OBJECT") and ddl != "OBJECT<>" else T.StructType()
    return kind if isinstance(kind, T.StructType) else T.StructType()


def _as_ddl(variant_schema: str) -> str:
    """A variant's schema text as DDL: objects are structs, what has no type of its own is text."""
    return variant_schema.replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")


def _leaves(schema: T.StructType, parts: tuple[str, ...] = ()):
    """Paths of the leaves, as tuples of names: a name may hold dots itself."""
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, (*parts, f.name))
        else:
            yield (*parts, f.name)


def flatten_json(df: DataFrame, col: str, keep: list[str], sep: str = ".",
                 schema: T.StructType | None = None) -> DataFrame:
    """Parse a JSON text column and emit one column per leaf, named by its joined path."""
    schema = schema or infer_json_schema(df, col)
    parsed = df.select(*keep, F.from_json(col, schema).alias("__j"))
    at = lambda parts: reduce(lambda c, name: c.getField(name), parts, F.col("__j"))
    return parsed.select(*keep, *[at(parts).alias(sep.join(parts)) for parts in _leaves(schema)])


def json_get(col: str, path: str, type_name: str, default=None) -> Column:
    """Value at a dotted path, or ``default`` when absent or not convertible."""
    v = F.try_variant_get(F.try_parse_json(F.col(col)), "$." + path, type_name)
    return F.coalesce(v, F.lit(default).cast(type_name)) if default is not None else v


def path_text(parts: Column) -> Column:
    """Path parts joined by dots; a dot or backslash inside a part is preceded by a backslash."""
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"([.\\])", r"\\$1")), ".")


def json_entries(df: DataFrame, key: str, col: str) -> DataFrame:
    """``(key, parts, value, is_object)`` of a JSON text column, to any depth: one row for every
    value that is no object, and one with ``is_object`` for every empty object. A null or
    unparsable document is an empty object with a null value.

    The text is parsed once to a variant, and whether a value is an object is asked of the
    variant, never of its text. Each round explodes the objects of the round before; the rounds
    are as many as the deepest document has levels, and only what is still an object goes on.
    """
    v = F.try_parse_json(F.col(col))
    level = df.select(F.col(key).alias("k"), F.array().cast("array<string>").alias("parts"), v.alias("v"))
    done = None
    while True:
        kind = F.schema_of_variant("v")
        tagged = reliable_checkpoint(level.select("k", "parts", "v", F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False)).alias("nested"),
                                                  (F.col("v").isNull() | (kind == "OBJECT<>")).alias("is_object")))
        ends = tagged.filter(~F.col("nested")).select("k", "parts", F.when(F.col("is_object"), F.when(F.col("v").isNotNull(), "{}")).otherwise(
            _variant_text(F.col("v"))).alias("value"), "is_object")
        done = ends if done is None else done.union(ends)
        deeper = tagged.filter("nested")
        if deeper.isEmpty():
            return done.withColumnRenamed("k", key)
        members = deeper.select("k", "parts", F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("name", "member"))
        level = members.select("k", F.concat("parts", F.array("name")).alias("parts"), F.col("member").alias("v"))


def _variant_text(v: Column) -> Column:
    """Strings as they are, other values as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _above(parts: Column) -> Column:
    """All proper prefixes of a path."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, 1, i - 1))


def deep_merge(base: DataFrame, override: DataFrame, key: str, col: str) -> DataFrame:
    """Deep merge of two JSON records per key to any depth, as ``(key, path, value, origin)``: one
    row per value that is no object, and per object that stays empty (value ``{}``).

    Objects merge member by member; anywhere else the override wins, whatever the two sides hold.
    A null document merges as an empty object, and a record that is empty or null on both sides
    has one row, with an empty path. ``path`` joins the members' names by dots, and a dot inside a
    name is preceded by a backslash, so it never collides with a nested path.
    """
    sides = [json_entries(d, key, col).select(F.col(key).alias("k"), "parts", "value", "is_object").withColumn("origin", F.lit(o))
             for d, o in ((base, "base"), (override, "override"))]
    a, b = (reliable_checkpoint(s) for s in sides)
    above = lambda d: d.filter(F.size("parts") > 0).select("k", F.explode(_above(F.col("parts"))).alias("parts")).distinct()
    inner_a, inner_b = above(a), above(b)
    # base values below a place where the override holds no object
    under = (a.filter(F.size("parts") > 0).select("k", "parts", F.explode(_above(F.col("parts"))).alias("at"))
             .join(b.filter(~F.col("is_object")).select("k", F.col("parts").alias("at")), ["k", "at"], "left_semi").select("k", "parts"))
    # base values where the override has an entry, or an object with members
    kept = (a.join(b.select("k", "parts"), ["k", "parts"], "left_anti").join(inner_b, ["k", "parts"], "left_anti")
            .join(under, ["k", "parts"], "left_anti"))
    # an empty object of the override is nothing new where the base has an object with members
    added = b.filter(~F.col("is_object")).union(b.filter("is_object").join(inner_a, ["k", "parts"], "left_anti").select(b.columns))
    return kept.select("k", "parts", "value", "origin").union(added.select("k", "parts", "value", "origin")).select(
        F.col("k").alias(key), path_text(F.col("parts")).alias("path"), "value", "origin")


def chain(df: DataFrame, steps) -> DataFrame:
    """Apply ``[(func, kwargs), ...]`` in order, each step a DataFrame → DataFrame function."""
    return reduce(lambda d, step: d.transform(step[0], **(step[1] if len(step) > 1 else {})), steps, df)
