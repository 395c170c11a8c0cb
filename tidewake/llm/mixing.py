"""Sources combined to target shares of a total size in tokens.

Sainte-Laguë apportionment hands out blocks of equal token size by highest quotients:
first to the sources, then each source's blocks to its shards. Inside a shard a
seeded order of the documents is the line on which the blocks lie; going round the
line again repeats documents, at most as often as the source allows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.session import Stage

#: Public byte-level BPE ranks; a parameter of ``token_counts``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Blocks that a mix is made of, about.
BLOCKS = 4000
#: Documents of a shard, about, and the most shards there are: bounds what the driver
#: apportions (shards times sources) and what one window sorts.
SHARD_DOCUMENTS = 20_000
MOST_SHARDS = 16_384
#: Quotas up to which they are sent to the tasks; beyond, Spark picks the join.
SENT_QUOTAS = 100_000


def token_counts(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the number of tokens of the whole text (null or '': 0)."""
    keep = [c for c in df.columns if c != text]
    if out in keep:
        raise ValueError(f"column exists: {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        if pattern is None:
            import public_tokenizers

            split = public_tokenizers.PATTERN
        else:
            split = pattern
        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, out])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.LongType())])
    return df.select(*keep, text).mapInArrow(run, schema)


def one_spelling(source: Column) -> Column:
    """Spellings of a source that differ in case, outer blanks, hyphens or inner blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients vote / (2k + 1); nobody gets more than their cap.

    Equal quotients go to the larger vote, then to the earlier place. If all caps are
    reached, seats stay empty. Whole rounds are handed out at once by Webster's
    rounding, so that the heap only settles the last seats.
    """
    caps = caps or [seats] * len(votes)
    given = [0] * len(votes)
    # a divisor so large that rounding gives too few seats, found by halving
    live = [i for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    if live and seats > 10 * len(live):
        lo, hi = 0.0, 2 * max(votes[i] for i in live)
        rounds = lambda d: {i: min(caps[i], math.floor(votes[i] / d + 0.5)) for i in live}
        for _ in range(60):
            mid = (lo + hi) / 2
            if mid == 0 or sum(rounds(mid).values()) > seats - len(live):
                lo = mid
            else:
                hi = mid
        for i, k in rounds(hi).items():
            given[i] = k
    heap = [(-votes[i] / (2 * given[i] + 1), -votes[i], i) for i in live if given[i] < caps[i]]
    heapq.heapify(heap)
    left = seats - sum(given)
    while left > 0 and heap:
        _, _, i = heapq.heappop(heap)
        given[i] += 1
        left -= 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), -votes[i], i))
    return given


def largest_total(targets: list[tuple[float, int, int]]) -> float:
    """Most tokens of a mix whose sources (share, tokens there are, repeats) keep their
    shares; a source without documents leaves its share to the others in proportion."""
    there = [(s, a * r) for s, a, r in targets if s > 0 and a * r > 0]
    whole = sum(s for s, _ in there)
    return min((reach * whole / s for s, reach in there), default=0.0)


def mix(
    docs: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, tokenizer: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)`` for targets ``(mix_id, source, target_share, max_repeats)``.

    ``chosen``: ``(mix_id, source, <doc id>, tokens, copies)``, one row per mix and document
    that is in it, ``copies`` at most the source's repeats. ``report``: per mix and target
    ``(mix_id, source, target_share, max_repeats, documents, available_tokens, quota_tokens,
    used_tokens, actual_share)``.

    Without ``total_tokens`` a mix is as large as its shares allow; with it, sources at
    their cap stay short and the report says so. Repeated targets count once. Targets
    without documents get nothing and leave their share to the others; documents of no
    target (or a null source) are in no mix. Empty tables give empty results. A
    document is taken whole, so a shard misses its quota by half a document at most.
    """
    stage = Stage(docs.sparkSession)
    sized = stage.cut(
        token_counts(docs.select(F.col(doc_id).alias("doc"), one_spelling(F.col(source)).alias("source"), F.col(text).alias("text")), "text", "tokens", tokenizer).where(
            "source is not null"
        )
    )
    shards = min(MOST_SHARDS, max(1, math.ceil(sized.count() / SHARD_DOCUMENTS)))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int"))
    stats = sized.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    wanted = targets.select("mix_id", one_spelling(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    wanted = wanted.where("mix_id is not null and source is not null").distinct()
    table = wanted.join(stats, "source", "left").collect()  # targets times shards
    quotas = []
    for mix_id in sorted({r["mix_id"] for r in table}):
        rows = [r for r in table if r["mix_id"] == mix_id]
        sources = sorted({(r["source"], r["share"] or 0.0, max(0, r["repeats"] or 0)) for r in rows})
        there = [{r["shard"]: r["tokens"] or 0 for r in rows if r["source"] == s and r["shard"] is not None} for s, _, _ in sources]
        have = [sum(x.values()) for x in there]
        total = total_tokens if total_tokens is not None else largest_total([(s, a, r) for (_, s, r), a in zip(sources, have)])
        block = max(1, math.floor(total / BLOCKS))
        caps = [math.ceil(a * r / block) for (_, _, r), a in zip(sources, have)]
        blocks = sainte_lague([s for _, s, _ in sources], math.floor(total / block), caps)
        for (name, share, repeats), parts, n in zip(sources, there, blocks):
            keys = sorted(parts)
            split = sainte_lague([float(parts[k]) for k in keys], n, [math.ceil(parts[k] * repeats / block) for k in keys])
            for k, b in zip(keys, split):
                quotas.append((mix_id, name, k, share, repeats, parts[k], b * block))
            if not keys:
                quotas.append((mix_id, name, None, share, repeats, 0, 0))
    spark = docs.sparkSession
    quota = spark.createDataFrame(quotas, "mix_id string, source string, shard int, share double, repeats int, have bigint, quota bigint")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc", F.lit(seed)), "doc", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("start", F.sum("tokens").over(line) - F.col("tokens"))
    # a document is in a round if its middle lies before the quota's end
    rounds = F.ceil((F.col("quota") - F.col("start") - F.col("tokens") / 2) / F.greatest(F.col("have"), F.lit(1)))
    due = quota.where("quota > 0")
    chosen = (
        placed.join(F.broadcast(due) if len(quotas) <= SENT_QUOTAS else due, ["source", "shard"])
        .withColumn("copies", F.least(F.greatest(rounds, F.lit(0)), F.col("repeats")).cast("int"))
        .where("copies > 0")
        .select("mix_id", "source", "doc", "tokens", "copies")
    )
    chosen = stage.cut(chosen)
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    whole = used.groupBy("mix_id").agg(F.sum("used_tokens").alias("mix_tokens"))
    documents = stats.groupBy("source").agg(F.sum("documents").alias("documents"))
    report = (
        quota.groupBy("mix_id", "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"))
        .agg(F.sum("have").alias("available_tokens"), F.sum("quota").alias("quota_tokens"))
        .join(documents, "source", "left")
        .join(used, ["mix_id", "source"], "left")
        .join(whole, "mix_id", "left")
        .select(
            "mix_id", "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), "available_tokens", "quota_tokens",
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return chosen.withColumnRenamed("doc", doc_id), report
