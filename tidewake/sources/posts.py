"""Posts: export bundles of nested JSON, and the clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.schema import POSTS

#: Where the parts of a raw post lie.
AUTHOR = "$.core.user_results.result.core"
BOOST = "$.legacy.retweeted_status_result"
NOTE = "$.note_tweet.note_tweet_results.result"


#: Row ids of a bundle's rows start at its place among the bundles times this.
ROWS_OF_BUNDLE = 1 << 40


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, post variant)``: the rows of every bundle's first table named tweets, in order.

    Each bundle without such a table, or whose tables or rows are no list, is an error;
    a table without rows is empty. A bundle is one JSON document, so one task parses it; many
    bundles (a folder or a pattern) are many tasks and come in order of their names.
    """
    docs = spark.read.text(path, wholetext=True)
    names = sorted(docs.inputFiles())
    at = F.array_position(F.array(*map(F.lit, names)), F.input_file_name()) - 1 if len(names) > 1 else F.lit(0)
    docs = docs.select(F.greatest(at, F.lit(0)).cast("bigint").alias("bundle"), F.input_file_name().alias("file"), F.parse_json("value").alias("v"))
    fail = lambda why, kind: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("file"))).cast(kind)
    many, one = "array<variant>", "variant"
    docs = docs.withColumn("tables", F.coalesce(F.try_variant_get("v", "$.data.data", many), fail("not an export bundle", many)))
    posts = F.filter("tables", lambda t: F.coalesce(F.try_variant_get(t, "$.tableName", "string") == "tweets", F.lit(False)))
    docs = docs.select("bundle", "file", F.coalesce(F.get(posts, F.lit(0)), fail("no table of posts", one)).alias("t"))
    rows = F.when(F.try_variant_get("t", "$.rows", one).isNull(), F.array().cast(many)).otherwise(F.coalesce(F.try_variant_get("t", "$.rows", many), fail("the table of posts is no list", many)))
    return docs.select("bundle", F.posexplode(rows).alias("pos", "post")).select((F.col("bundle") * F.lit(ROWS_OF_BUNDLE) + F.col("pos")).alias("row_id"), "post")


def _string(v: Column, path: str) -> Column:
    """The string at a path; what is there but no string counts as missing."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _filled(v: Column) -> Column:
    """Whether a value is there and neither empty, false, zero nor null."""
    text = F.to_json(v)
    return F.coalesce(~text.isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))


def _present(v: Column, path: str) -> Column:
    return _filled(F.try_variant_get(v, path, "variant"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text(v: Column) -> Column:
    note = _string(v, f"{NOTE}.text")
    return F.coalesce(F.when(F.trim(note) != "", note), _string(v, "$.legacy.full_text"), F.lit(""))


def _entities(v: Column, kind: str, field: str) -> Column:
    """Values of a list of tags or mentions: the long post's list if it is a list, even an
    empty one, else the ordinary one; entries without a value are left out."""
    of = lambda p: F.try_variant_get(v, p, "array<variant>")
    entries = F.coalesce(of(f"{NOTE}.entity_set.{kind}"), of(f"$.legacy.entities.{kind}"), F.array().cast("array<variant>"))
    return F.filter(F.transform(entries, lambda e: F.try_variant_get(e, f"$.{field}", "string")), lambda t: t.isNotNull() & (t != ""))


def normalised_posts(rows: DataFrame) -> DataFrame:
    """The post table of raw rows ``(row_id, post)``; rows without an author are left out.

    Content is the amplified post's where there is one (unwrapped, if wrapped), else
    the row's own; its author falls back to the handle of ``RT @handle:`` and then to the
    row's author, its id to ``legacy.id_str`` and then to the row's own.
    """
    p = F.col("post")
    is_boost = _present(p, BOOST)
    result = F.try_variant_get(p, f"{BOOST}.result", "variant")
    wrapped = F.try_variant_get(p, f"{BOOST}.result.tweet", "variant")
    content = F.when(is_boost & _is_object(wrapped), wrapped).when(is_boost & _is_object(result), result).otherwise(p)
    base = rows.select("row_id", "post", content.alias("content"), is_boost.alias("is_retweet"))
    c, own = F.col("content"), F.coalesce(F.try_variant_get(p, "$.rest_id", "string"), F.lit(""))
    name = lambda v, k: _string(v, f"{AUTHOR}.{k}")
    blank = lambda x: F.nullif(x, F.lit(""))
    cut = base.where(F.coalesce(name(p, "screen_name") != "", F.lit(False))).select(
        "row_id",
        own.alias("tweet_id"),
        name(p, "screen_name").alias("author_handle"),
        name(p, "name").alias("author_name"),
        tx.post_time(F.try_variant_get(p, "$.legacy.created_at", "string")).alias("posted_at"),
        tx.client_label(_string(p, "$.source")).alias("source_client"),
        _text(p).alias("text"),
        "is_retweet",
        (_present(p, "$.legacy.is_quote_status") | _present(p, "$.quoted_status_result")).alias("is_quote"),
        F.coalesce(blank(_string(c, "$.rest_id")), blank(_string(c, "$.legacy.id_str")), own).alias("content_tweet_id"),
        name(c, "screen_name").alias("content_screen_name"),
        name(c, "name").alias("content_author_name"),
        tx.post_time(F.try_variant_get(c, "$.legacy.created_at", "string")).alias("content_created_at"),
        _text(c).alias("content_text"),
        _entities(c, "hashtags", "text").alias("hashtags_raw"),
        _entities(c, "user_mentions", "screen_name").alias("mentions_raw"),
    )
    out = {
        "canonical_text": tx.canonical_text("text"),
        "content_canonical_text": tx.canonical_text("content_text"),
        "hashtags": tx.normalize_tokens("hashtags_raw"),
        "mentions": tx.normalize_tokens("mentions_raw"),
        "content_author_handle": F.coalesce(blank(F.col("content_screen_name")), tx.amplified_handle(F.col("text")), F.col("author_handle")),
    }
    return cut.select("row_id", *[out[n].alias(n) if n in out else F.col(n) for n in POSTS.names])


def posts_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The post table of a clean batch; lists are JSON text in their cells."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if not rows.columns:
        return spark.createDataFrame([], POSTS).withColumn("row_id", F.lit(0).cast("bigint"))
    out = []
    for f in POSTS.fields:
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kind == "timestamp":
            c = tx.cell_time(c)
        elif kind == "boolean":
            c = tx.cell_flag(c)
        elif kind.startswith("array"):
            c = F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
        else:
            c = F.nullif(F.trim(c), F.lit("")) if f.nullable else F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return rows.select(F.monotonically_increasing_id().alias("row_id"), *out)
