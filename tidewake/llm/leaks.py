"""Evaluation passages inside training documents.

Rare n-gram seeds join documents to test items: of every run of words of a passage
the rarest n-grams that some document holds are its seeds. Documents and items whose
seeds meet more often than by chance, or as a whole run would, are aligned word by word
(Smith-Waterman), which scores whole, partial, paraphrased and edited copies and gives
the longest run of consecutive shared words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.words import words
from tidewake.session import Stage

#: Words of an n-gram, and n-grams of every run that are seeds. Of a passage with three words
#: in ten replaced next to no 5-gram is left, but a third of the 3-grams.
SEED_WORDS = 3
SEEDS = 3
#: Item n-grams up to which the set of their hashes is sent to the tasks (8 bytes each);
#: with more, documents' n-grams are joined with them instead.
SENT_GRAMS = 2_000_000
#: Characters of all passages up to which their words are sent along.
SENT_TEXT = 50_000_000
#: Pairs of a document and an item up to which they are sent to the documents' tasks, so
#: that no text moves; with more, documents are shuffled to them.
SENT_PAIRS = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the alignment tables that are worked on side by side.
CELLS = 16_000
#: Offsets beyond those of a pair's seeds that an alignment may shift to.
SHIFT = 16


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes (wrapping) of the n-grams of a sequence of word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.int64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _grams(df: DataFrame, id_col: str, text_col: str, n: int, among: np.ndarray | None = None, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """``(<id>, pos, gram, fresh)``: word n-grams of each text, of those in ``among`` if given;
    ``fresh`` marks the first of its kind in the text."""
    known = {w: _word_hash(w) for w in vocabulary} if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[np.ndarray] = []
            grams: list[np.ndarray] = []
            fresh: list[np.ndarray] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = words(text)
                if len(tokens) < n:
                    continue
                if known is not None:
                    hashes = np.array([known.get(w, 0) for w in tokens], np.uint64)
                else:
                    hashes = np.array([_word_hash(w) for w in tokens], np.uint64)
                g = gram_hashes(hashes, n)
                p = np.arange(len(g), dtype=np.int32)
                if among is not None:
                    hit = among[np.minimum(np.searchsorted(among, g), len(among) - 1)] == g
                    g, p = g[hit], p[hit]
                counts[i] = len(g)
                grams.append(g)
                at.append(p)
                new = np.zeros(len(g), bool)
                new[np.unique(g, return_index=True)[1]] = True
                fresh.append(new)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.concatenate(at) if at else np.empty(0, np.int32)),
                    pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64)),
                    pa.array(np.concatenate(fresh) if fresh else np.empty(0, bool)),
                ],
                [id_col, "pos", "gram", "fresh"],
            )

    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("pos", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("fresh", T.BooleanType())]
    )
    return df.select(id_col, text_col).mapInArrow(run, schema)


def seed_hits(stage: Stage, docs: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(item grams ``(item, ipos, gram)``, occurrences ``(doc, dpos, gram, fresh)`` of those in all documents)."""
    item_grams = stage.cut(_grams(items, "item", "passage", n)).select("item", F.col("pos").alias("ipos"), "gram")
    text = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    if text <= SENT_TEXT and item_grams.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS:
        among = np.array(sorted(r[0] for r in item_grams.select("gram").distinct().collect()), np.int64)
        vocabulary = frozenset(w for r in items.select("passage").collect() for w in words(r[0]))
        if not len(among):
            hits = docs.select("doc", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("gram"), F.lit(True).alias("fresh")).limit(0)
        else:
            hits = _grams(docs, "doc", "text", n, among, vocabulary)
    else:
        hits = _grams(docs, "doc", "text", n).join(item_grams.select("gram").distinct(), "gram", "left_semi").select("doc", "pos", "gram", "fresh")
    return item_grams, stage.cut(hits.select("doc", F.col("pos").alias("dpos"), "gram", "fresh"))


def rare_seeds(item_grams: DataFrame, hits: DataFrame, run: int, n: int, seeds: int = SEEDS) -> DataFrame:
    """``(item, ipos, gram, pairs)``: of every ``run`` consecutive words of an item, the ``seeds``
    n-grams that make the fewest ``pairs`` of a document and an item, of those that any
    document holds. Any copy of such a run holds its seeds, one after the other."""
    spread = hits.where("fresh").groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    among = item_grams.select("gram", "item").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("items"))
    chance = spread.join(among, "gram").select("gram", (F.col("docs") * F.col("items")).alias("pairs"))
    ranked = item_grams.join(chance, "gram", "left").select("item", "ipos", F.when(F.col("pairs") > 0, F.struct("pairs", "ipos", "gram")).alias("g"))
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, run - n)
    frame = ranked.select("item", F.slice(F.array_sort(F.collect_list("g").over(ahead)), 1, seeds).alias("g"), F.count(F.lit(1)).over(ahead).alias("k"))
    rarest = frame.where(F.col("k") == run - n + 1).select("item", F.explode("g").alias("g"))
    return rarest.select("item", "g.ipos", "g.gram", "g.pairs").distinct()


def candidates(hits: DataFrame, seeds: DataFrame, all_pairs: int, run: int, n: int, per_run: int = SEEDS) -> DataFrame:
    """``(doc, item, low, high)``: pairs to be aligned, with the range of offsets to align along.

    A pair is one if its seeds, as often as documents and items hold them, would meet by
    chance in less than one of ``all_pairs`` documents and items, or if seeds meet at one offset
    as often as in a whole run, so that no run is missed however common its words. The range
    holds every such offset and that of the rarest seeds.
    """
    rarity = F.when(F.col("fresh"), F.log(F.lit(float(max(all_pairs, 1))) / F.col("pairs"))).otherwise(0.0)
    met = hits.join(seeds, "gram").select("doc", "item", (F.col("dpos") - F.col("ipos")).alias("offset"), rarity.alias("rarity"))
    along = met.groupBy("doc", "item", "offset").agg(F.count(F.lit(1)).alias("n"), F.sum("rarity").alias("rarity"))
    whole = min(per_run, run - n + 1)
    as_run = F.when(F.col("n") >= whole, F.col("offset"))
    best = F.max(F.struct("rarity", "n", "offset")).alias("best")
    pairs = along.groupBy("doc", "item").agg(best, F.max("n").alias("n"), F.sum("rarity").alias("rarity"), F.min(as_run).alias("low"), F.max(as_run).alias("high"))
    kept = (F.col("rarity") >= math.log(max(all_pairs, 1))) | (F.col("n") >= whole)
    return pairs.where(kept).select("doc", "item", F.least("low", "best.offset").alias("low"), F.greatest("high", "best.offset").alias("high"))


def align_many(pairs: list[tuple[np.ndarray, np.ndarray, int, int]], detail: bool) -> np.ndarray:
    """Smith-Waterman over word numbers for many (document, item, low, high) at once, along
    the offsets ``low`` to ``high`` of document to item: rows of (points, item start, item
    end, doc end, longest common run). Ends are exclusive and, like the start, only filled
    in with ``detail``. Pairs of like size are worked on side by side.
    """
    out = np.zeros((len(pairs), 5), np.int64)
    width = [high - low + 1 for _, _, low, high in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (width[i], len(pairs[i][1])))
    at = 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and (len(group) + 1) * width[order[at + len(group)]] <= CELLS:
            group.append(order[at + len(group)])
        at += len(group)
        w, length = width[group[-1]], max(len(pairs[i][1]) for i in group)
        kind = np.int16 if MATCH * length + w < 30_000 else np.int32
        # row i of an item meets the document's words i + low, ..., i + high: a window that slides along
        docs, items = np.full((len(group), length + w), -2, np.int32), np.full((len(group), length), -1, np.int32)
        for g, i in enumerate(group):
            doc, item, low, _ = pairs[i]
            part = doc[max(low, 0) : max(low + length + w, 0)]
            docs[g, max(-low, 0) : max(-low, 0) + len(part)] = part[: max(0, length + w - max(-low, 0))]
            items[g, : len(item)] = item
        ramp = np.arange(w, dtype=kind) * kind(-GAP)
        above, run = np.zeros((len(group), w + 1), kind), np.zeros((len(group), w), kind)
        first = np.zeros((len(group), w + 1), np.int32)
        best, longest = np.zeros((len(group), 4), np.int64), np.zeros(len(group), np.int64)
        rows, place = np.arange(len(group)), np.broadcast_to(np.arange(w, dtype=np.int32), run.shape)
        for i in range(length):
            same = docs[:, i : i + w] == items[:, i : i + 1]
            run += kind(1)
            run *= same
            np.maximum(longest, run.max(1), out=longest)
            diagonal = above[:, :-1] + np.where(same, kind(MATCH), kind(MISMATCH))
            down = above[:, 1:] + kind(GAP)
            row = np.maximum(np.maximum(diagonal, down), kind(0)) + ramp
            slid = np.maximum.accumulate(row, axis=1)
            if detail:
                came = np.where(diagonal >= down, np.where(above[:, :-1] > 0, first[:, :-1], i), first[:, 1:])
                start = np.where(row == ramp, i + 1, came)
                lead = np.maximum.accumulate(np.where(row == slid, place, 0), axis=1)
                first[:, :-1] = np.take_along_axis(start, lead, 1)
            above[:, :-1] = slid - ramp
            top = above.argmax(1)
            points = above[rows, top].astype(np.int64)
            better = points > best[:, 0]
            if better.any():
                best[better, 0] = points[better]
                if detail:
                    lows = np.array([pairs[g][2] for g in group])
                    best[better] = np.stack([points, first[rows, top], np.full(len(group), i + 1), lows + i + top + 1], 1)[better]
        out[group, :4] = best
        out[group, 4] = longest
    return out


def align(doc: list[str], item: list[str]) -> tuple[int, int, int, int, int]:
    """``align_many`` for one document and item in words, along all offsets."""
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item], np.int32)
    b = np.array([ids.get(w, -2) for w in doc], np.int32)
    return tuple(map(int, align_many([(b, a, -len(a), len(b))], True)[0]))


def leaked(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = 12, seed_words: int = SEED_WORDS, seeds: int = SEEDS
) -> DataFrame:
    """``(<doc id>, <item id>, points, score, item_start, item_end, doc_end, longest_run)``.

    One row for every document and item whose best alignment earns the ``points`` of
    ``run`` words in a row, edited or not, and so for every document that holds ``run``
    consecutive words of a passage. ``score`` is the points over the best possible ones,
    so 1 is the whole passage; paraphrased and edited copies score between. Words are
    runs of letters and digits; case and accents don't count. Null texts and passages
    hold no words; passages under ``run`` words have no seeds. Texts are read whole;
    repeated rows of an id are read as one more text of it and the best row counts.
    """
    stage = Stage(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(passage).alias("passage"))
    item_grams, hits = seed_hits(stage, docs, items, seed_words)
    rare = stage.cut(rare_seeds(item_grams, hits, run, seed_words, seeds))
    pairs = stage.cut(candidates(hits, rare, docs.count() * items.count(), run, seed_words, seeds))
    columns = ("doc", "item", "low", "high", "text", "passage")
    if pairs.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS:
        rows = docs.join(F.broadcast(pairs), "doc").join(items, "item").select(*columns)
    else:
        rows = pairs.join(items, "item").join(docs, "doc").select(*columns)

    def run_align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: dict[str, tuple[dict[str, int], np.ndarray]] = {}
        for batch in batches:
            todo, starts, last = [], [], (None, [])
            for low, high, t, p in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                if p not in passages:
                    ids: dict[str, int] = {}
                    passages[p] = (ids, np.array([ids.setdefault(w, len(ids)) for w in words(p)], np.int32))
                ids, item = passages[p]
                if t != last[0]:  # a document's pairs stand together
                    last = (t, words(t))
                at = max(0, low - SHIFT)
                part = last[1][at : high + SHIFT + len(item) + 1]
                todo.append((np.array([ids.get(w, -2) for w in part], np.int32), item, low - SHIFT - at, high + SHIFT - at))
                starts.append(at)
            fit = np.flatnonzero(align_many(todo, False)[:, 0] >= MATCH * run) if todo else np.empty(0, np.int64)
            found = align_many([todo[i] for i in fit], True)
            whole = np.array([len(todo[i][1]) for i in fit], float)
            moved = np.array([starts[i] for i in fit], np.int64)
            values = [found[:, 1], found[:, 2], found[:, 3] + moved, found[:, 4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(fit)), batch.column(1).take(pa.array(fit)), pa.array(found[:, 0]).cast(pa.int32()), pa.array(found[:, 0] / (MATCH * np.maximum(whole, 1))),
                 *[pa.array(v).cast(pa.int32()) for v in values]],
                ["doc", "item", "points", "score", "item_start", "item_end", "doc_end", "longest_run"],
            )

    types = rows.schema
    whole = ("item_start", "item_end", "doc_end", "longest_run")
    schema = T.StructType([types["doc"], types["item"], T.StructField("points", T.IntegerType()), T.StructField("score", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in whole]])
    best = rows.mapInArrow(run_align, schema).groupBy("doc", "item").agg(F.max(F.struct("longest_run", "points", "score", "item_start", "item_end", "doc_end")).alias("r"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "r.points", "r.score", *[f"r.{c}" for c in whole])
