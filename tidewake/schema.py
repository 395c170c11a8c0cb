"""Schemas of the input tables."""

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    """``name type`` per word pair; a trailing ``?`` marks a nullable column."""
    kinds = {"s": T.StringType(), "n": T.LongType(), "t": T.TimestampType(), "b": T.BooleanType(), "l": T.ArrayType(T.StringType())}
    out = []
    for item in spec.split():
        name, kind = item.rstrip("?").split(":")
        out.append(T.StructField(name, kinds[kind], item.endswith("?")))
    return T.StructType(out)


MEMBERS = _fields(
    "member_id:s screen_name:s name:s? description:s? created_at:t? followers_count:n friends_count:n statuses_count:n favourites_count:n listed_count:n "
    "location:s? is_blue_verified:b protected:b default_profile:b? default_profile_image:b? profile_description_language:s?"
)
POSTS = _fields(
    "tweet_id:s author_handle:s author_name:s? posted_at:t? source_client:s? text:s canonical_text:s is_retweet:b is_quote:b content_tweet_id:s "
    "content_author_handle:s content_author_name:s? content_created_at:t? content_text:s content_canonical_text:s hashtags_raw:l hashtags:l mentions_raw:l mentions:l"
)
