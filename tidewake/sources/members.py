"""Member lists: CSV and JSON exports, extra handles, placeholders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.schema import MEMBERS

COUNTS = ("followers_count", "friends_count", "statuses_count", "favourites_count", "listed_count")


def _empty(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _member(get, meta) -> list[Column]:
    """The member columns from accessors of a row's fields and of its metadata paths."""
    flags = {"default_profile": "$.legacy.default_profile", "default_profile_image": "$.legacy.default_profile_image"}
    return [
        F.coalesce(get("id"), F.lit("")).alias("member_id"),
        F.coalesce(get("screen_name"), F.lit("")).alias("screen_name"),
        _empty(get("name")).alias("name"),
        _empty(get("description")).alias("description"),
        tx.cell_time(get("created_at")).alias("created_at"),
        *[tx.cell_count(get(c)).alias(c) for c in COUNTS],
        _empty(get("location")).alias("location"),
        tx.cell_flag(get("is_blue_verified")).alias("is_blue_verified"),
        tx.cell_flag(get("protected")).alias("protected"),
        *[tx.cell_maybe_flag(meta(p)).alias(c) for c, p in flags.items()],
        _empty(meta("$.profile_description_language")).alias("profile_description_language"),
    ]


def members_csv(spark: SparkSession, path: str) -> DataFrame:
    """A member CSV export; nested figures come from its ``metadata`` column of JSON text."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    get = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    meta = lambda p: F.when(F.try_parse_json(get("metadata")).isNotNull(), F.try_variant_get(F.try_parse_json(get("metadata")), p, "string"))
    return rows.select(*_member(get, meta))


def _list_at(document: Column, keys: tuple[str, ...], what: str) -> Column:
    """The top-level list of a JSON document, or the first list under one of ``keys``."""
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    found = F.when(is_list(document), document)
    for k in keys:
        inner = F.try_variant_get(document, f"$.{k}", "variant")
        found = F.coalesce(found, F.when(is_list(inner), inner))
    return F.coalesce(found, F.raise_error(F.lit(f"unexpected shape of {what}")).cast("variant"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))


def _exploded(df: DataFrame, column: str) -> DataFrame:
    """``(pos, value)`` of the elements of a variant that is a list, through a view of its own name."""
    name = f"exploded_{uuid.uuid4().hex}"
    df.createTempView(name)
    out = df.sparkSession.sql(f"select x.pos, x.value from {name}, lateral variant_explode({column}) as x")
    df.sparkSession.catalog.dropTempView(name)
    return out


def members_json(spark: SparkSession, path: str) -> DataFrame:
    """A member JSON export: a list, or a list under users, members, items or data. Items
    that aren't objects are left out; another shape is an error."""
    items = _documents(spark, path).select(_list_at(F.col("v"), ("users", "members", "items", "data"), "a member export").alias("items"))
    rows = _exploded(items, "items").withColumnRenamed("value", "item").where(F.schema_of_variant("item").startswith("OBJECT"))
    get = lambda c: F.try_variant_get("item", f"$.{c}", "string")
    meta = lambda p: F.try_variant_get("item", "$.metadata" + p[1:], "string")
    return rows.select(*_member(get, meta))


def read_members(spark: SparkSession, path: str, extra: DataFrame | None = None) -> DataFrame:
    """A member export by its suffix, with placeholders for the ``extra`` handles it lacks."""
    name = path.lower()
    if name.endswith(".csv"):
        rows = members_csv(spark, path)
    elif name.endswith(".json"):
        rows = members_json(spark, path)
    else:
        raise ValueError(f"not a member export: {path}")
    return with_placeholders(rows, extra) if extra is not None else rows


def extra_handles(spark: SparkSession, path: str) -> DataFrame:
    """``(value, at)``: raw handles of a text, JSON or CSV file, with their order."""
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".json"):
        items = _documents(spark, path).select(_list_at(F.col("v"), ("handles", "members", "accounts", "urls"), "a handle list").alias("items"))
        return _exploded(items, "items").select(F.col("value").cast("string").alias("value"), F.col("pos").cast("bigint").alias("at"))
    if name.endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        if not rows.columns:
            return spark.createDataFrame([], "value string, at bigint")
        rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
        column = next((c for c in ("screen_name", "handle", "username", "url") if c in rows.columns), rows.columns[0])
        return rows.select(F.col(f"`{column}`").alias("value"), F.monotonically_increasing_id().alias("at"))
    if name.endswith(".txt") or "." not in name:
        return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    raise ValueError(f"not a handle list: {path}")


def handles(values: DataFrame) -> DataFrame:
    """``(handle)``: cleaned, one spelling per case-blind handle: the first by ``at``, where there
    is such a column, else the smallest."""
    at = F.col("at") if "at" in values.columns else F.lit(0)
    clean = values.select(tx.clean_handle(F.col("value")).alias("handle"), at.alias("at")).where("handle is not null")
    return clean.groupBy(F.lower("handle").alias("folded")).agg(F.min(F.struct("at", "handle")).alias("h")).select("h.handle")


def with_placeholders(members: DataFrame, values: DataFrame) -> DataFrame:
    """``members`` and, for each handle that it lacks in any spelling, a row with the
    handle as its id, zero counts and nothing known."""
    lacking = handles(values).join(members.select(F.lower("screen_name").alias("__f")).distinct(), F.lower("handle") == F.col("__f"), "left_anti")
    known = {"member_id": F.col("handle"), "screen_name": F.col("handle"), "is_blue_verified": F.lit(False), "protected": F.lit(False)} | {c: F.lit(0) for c in COUNTS}
    types = {f.name: f.dataType for f in members.schema.fields}
    rows = lacking.select(*[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in members.columns])
    return members.unionByName(rows)


def members_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The member table of a clean batch."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if not rows.columns:
        return spark.createDataFrame([], MEMBERS)
    out = []
    for f in MEMBERS.fields:
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kind == "timestamp":
            c = tx.cell_time(c)
        elif kind == "bigint":
            c = tx.cell_count(c)
        elif kind == "boolean":
            c = tx.cell_maybe_flag(c) if f.nullable else tx.cell_flag(c)
        else:
            c = _empty(c) if f.nullable else F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return rows.select(*out)
