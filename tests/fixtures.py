"""Small invented posts and members."""

import datetime as dt

from tidewake.schema import MEMBERS, POSTS

BASE = dt.datetime(2026, 4, 15, 20, 0)


def post(row_id, author, content_id=None, content_author=None, minute=0, *, boost=True, quote=False, client="Web", tags=(), mentions=(), created=0):
    """An amplification of ``content_id``, or an original with ``boost=False``."""
    at = None if minute is None else BASE + dt.timedelta(minutes=minute)
    own = f"t{row_id}"
    return {
        "row_id": row_id, "tweet_id": own, "author_handle": author, "author_name": None, "posted_at": at, "source_client": client, "text": "x", "canonical_text": "x",
        "is_retweet": boost, "is_quote": quote, "content_tweet_id": content_id if boost else own, "content_author_handle": content_author if boost else author,
        "content_author_name": None, "content_created_at": BASE + dt.timedelta(minutes=created), "content_text": "x", "content_canonical_text": "x", "hashtags_raw": list(tags),
        "hashtags": [t.lower() for t in tags], "mentions_raw": list(mentions), "mentions": [m.lower() for m in mentions],
    }


def posts(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_id", T.LongType()), *POSTS.fields])
    for f in schema.fields:
        f.nullable = True
    return spark.createDataFrame([[r[n] for n in schema.names] for r in rows], schema)


def member(handle, **over):
    row = {
        "member_id": "m-" + handle, "screen_name": handle, "name": handle, "description": None, "created_at": dt.datetime(2024, 1, 1), "followers_count": 100,
        "friends_count": 50, "statuses_count": 10, "favourites_count": 0, "listed_count": 1, "location": None, "is_blue_verified": False, "protected": False,
        "default_profile": True, "default_profile_image": False, "profile_description_language": None,
    }
    return row | over


def members(spark, rows):
    return spark.createDataFrame([[r[n] for n in MEMBERS.names] for r in rows], MEMBERS)


CREW = [
    *[post(10 * c + i, h, f"o{c}", "source", i + 1) for c in range(1, 4) for i, h in enumerate(("crew_a", "crew_b", "crew_c"))],
    *[post(100 + c, "outsider", f"o{c}", "source", 120) for c in range(1, 4)],
    post(200, "crew_a", "o9", "other", 500),
]
