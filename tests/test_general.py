import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.operators.asof import latest_not_newer
from tidewake.operators.entity_features import by_entity, cumulative_store, widen, window_features, write_store
from tidewake.operators.nested import POST, BadJson, Shape, flat_tables, parse_triples, shaped, shaped_rows
from tidewake.operators.ranking import numbered
from tidewake.operators.snapshot_diff import SnapshotStore, merge_sorted, snapshot_changes


# ---------------------------------------------------------------- snapshots
def brute_changes(rows):
    best = {}
    for s, k, o, v, w in rows:
        if s is None:
            continue
        key = (s, k)
        rank = tuple((x is not None, x) for x in (o, v, w))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (v, w))
    snaps = sorted({s for s, *_ in rows if s is not None})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old = {k: x[1] for (s, k), x in best.items() if s == a}
        new = {k: x[1] for (s, k), x in best.items() if s == b}
        for k in old.keys() | new.keys():
            if k not in new:
                out.add((a, b, k, "removed", ""))
            elif k not in old:
                out.add((a, b, k, "added", ""))
            elif old[k] != new[k]:
                out.add((a, b, k, "changed", ",".join(n for n, x, y in zip(("v", "w"), old[k], new[k]) if x != y)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_changes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [None, "", "hot", *[f"k{i}" for i in range(20)]]
    rows = [(rng.choice([1, 5, 9, 10, None]), rng.choice(keys), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for _ in range(160)]
    rows += [(5, "hot", i % 7, 1, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "snap int, key string, at int, v int, w string").withColumn("s", F.lit("clash")).withColumn("k", F.lit(1))
    got = snapshot_changes(df, "snap", "key", ["v", "w"], "at", ranges=3).withColumn("changed_fields", F.array_join("changed_fields", ","))
    assert {tuple(r) for r in got.collect()} == brute_changes(rows)


def test_changes_of_nothing_and_of_one_snapshot(spark):
    df = spark.createDataFrame([], "snap int, key string, at int, v int")
    assert snapshot_changes(df, "snap", "key", ["v"], "at").count() == 0
    df = spark.createDataFrame([(1, "a", 1, 1)], "snap int, key string, at int, v int")
    assert snapshot_changes(df, "snap", "key", ["v"], "at").count() == 0


def test_store_takes_later_snapshots(spark, tmp_path):
    rows = [(s, f"k{k:03d}", 1, (k * s) % 5, None if k % 7 else float("nan")) for s in (1, 2, 3) for k in range(s * 10, 300)]
    df = spark.createDataFrame(rows, "snap int, key string, at int, v int, w double")
    path = "file://" + str(tmp_path / "store")
    SnapshotStore.create(df.where("snap < 3"), path, "snap", "key", ["v", "w"], "at", ranges=4)
    store = SnapshotStore.open(spark, path)
    assert len(store.bounds) == 3
    store.add(df.where("snap = 3"))
    got = {tuple(r) for r in store.changes().withColumn("changed_fields", F.array_join("changed_fields", ",")).collect()}
    same = lambda x: None if x is None or x != x else x
    assert got == brute_changes([(*r[:4], same(r[4])) for r in rows])


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_streamed_merge_at_any_batch_size(size):
    rng = random.Random(size)
    sides = [{k: rng.choice([None, 1.0, float("nan")]) for k in [None, *range(40)] if rng.random() < 0.7} for _ in range(2)]
    tables = [pa.table({"k": pa.array(list(d), pa.int64()), "v0": pa.array(list(d.values()), pa.float64())}) for d in sides]
    parts = [iter([t.slice(i, size) for i in range(0, t.num_rows, size)]) for t in tables]
    got = {(k, kind, tuple(f)) for keys, kinds, fields in merge_sorted(*parts, ("v",)) for k, kind, f in zip(keys.to_pylist(), kinds, fields)}
    old, new = ({k: str(v) for k, v in d.items()} for d in sides)
    want = {(k, "removed", ()) for k in old.keys() - new.keys()} | {(k, "added", ()) for k in new.keys() - old.keys()} | {(k, "changed", ("v",)) for k in old.keys() & new.keys() if old[k] != new[k]}
    assert got == want


# ---------------------------------------------------------------- nested records
def tree_triples(o, path=()):
    if isinstance(o, dict):
        yield path, "object", None
        for k, v in o.items():
            yield from tree_triples(v, (*path, k))
    elif isinstance(o, list):
        yield path, "array", None
        for i, v in enumerate(o):
            yield from tree_triples(v, (*path, i))
    else:
        yield path, type(o).__name__, o


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(json_values, st.booleans())
def test_triples_equal_the_tree(value, tight):
    text = json.dumps(value, separators=(",", ":") if tight else None, ensure_ascii=tight, indent=None if tight else 1)
    want = [(p, {"NoneType": "null"}.get(k, k)) for p, k, _ in tree_triples(value)]
    assert [(p, k) for p, k, _ in parse_triples(text)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.eE+-truefalsnN\\ u\n', max_size=14))
def test_accepts_what_json_accepts(text):
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    try:
        parse_triples(text)
        assert good
    except BadJson:
        assert not good


def test_repeated_keys_and_depth():
    assert [t for t in parse_triples('{"a": {"b": 1}, "a": [2]}') if t[1] == "int"] == [(("a", 0), "int", "2")]
    deep = 50_000
    assert len(parse_triples("[" * deep + "]" * deep)) == deep


def raw(ident, author, tags=None, note=None, **more):
    o = {"rest_id": ident, "core": {"user_results": {"result": {"core": {"screen_name": author}}}}, "legacy": {"entities": {"hashtags": tags}}} | more
    if note is not None:
        o["note_tweet"] = {"note_tweet_results": {"result": {"entity_set": {"hashtags": note}}}}
    return o


def test_posts_in_posts(spark):
    inner = raw(77, "in", [{"text": "a"}, {"text": ""}, {}, {"text": "b"}])
    legacy = {"legacy": {"id_str": "88", "entities": {}}, "core": {"user_results": {"result": {"legacy": {"screen_name": "old"}}}}, "rest_id": None}
    top = raw("1", "out", [{"text": "kept out"}], note=[], quoted={"x": [{"y": inner}, legacy]})
    rows = [(1, json.dumps(top)), (2, None), (3, ""), (4, "{broken"), (5, "[]"), (6, json.dumps([raw("9", "", [])])), (7, json.dumps(raw("5", "z", "no list")))]
    df = spark.createDataFrame(rows, "id bigint, doc string").withColumn("post_id", F.lit("clash"))
    rows = shaped_rows(df, "id", "doc", POST, "post_id", "hashtag").select("id", "post_id", "parent_post_id", "author_handle", "pos", "hashtag")
    got = {tuple(r) for r in rows.collect()}
    assert got == {(1, "1", "", "out", -1, ""), (1, "77", "1", "in", 0, "a"), (1, "77", "1", "in", 1, "b"), (1, "88", "1", "old", -1, ""), (7, "5", "", "z", -1, "")}
    assert shaped_rows(df.limit(0), "id", "doc", POST, "post_id", "hashtag").count() == 0
    assert shaped([], POST) == []


def test_objects_of_another_shape():
    order = Shape(fields={"no": (("no",), ("meta", "number"))}, kinds={"no": ("int", "str")}, items=((("lines",), "sku"),))
    doc = {"no": 7, "lines": [{"sku": "a", "sub": {"meta": {"number": "8"}, "lines": [{"sku": "b"}, {"sku": None}]}}, {"no": ""}]}
    got = [(f["no"], above, items) for f, above, _, items in shaped(parse_triples(json.dumps(doc)), order)]
    assert got == [("7", None, ["a"]), ("8", (), ["b"])]


def test_flat_tables(spark):
    doc = {"id": 1, "who": {"name": "x"}, "items": [{"n": 1, "tags": ["p", "q"]}, {"n": 2, "tags": []}]}
    tables = flat_tables(spark.createDataFrame([("r", json.dumps(doc)), ("s", None)], "rid string, doc string"), "rid", "doc")
    assert set(tables) == {"$", "$.items.[]", "$.items.[].tags.[]"} or len(tables) == 3
    items = next(t for g, t in tables.items() if g.count("[]") == 1)
    assert sorted((r["rid"], r["ordinals"], r["parent_ordinals"], r["n"]) for r in items.collect()) == [("r", [0], [], "1"), ("r", [1], [], "2")]
    tags = next(t for g, t in tables.items() if g.count("[]") == 2)
    assert sorted((r["ordinals"], r["parent_ordinals"], r["value"]) for r in tags.collect()) == [([0, 0], [0], "p"), ([0, 1], [0], "q")]


# ---------------------------------------------------------------- entity features
def test_windows_against_brute_force(spark):
    rng = random.Random(2)
    day = dt.datetime(2030, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), None if rng.random() < 0.1 else day + dt.timedelta(days=rng.randrange(40), hours=rng.randrange(24)), rng.choice([None, 1, -2, 5])) for _ in range(300)]
    store = cumulative_store(spark.createDataFrame(rows, "e string, k string, t timestamp, v int"), "e", "k", "t", "v")
    as_of = max(r[2] for r in rows if r[2]).date()
    got = {(r["entity"], r["kind"]): r.asDict() for r in window_features(store, as_of, {"7d": 7}).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == key]
        recent = [r for r in mine if r[2] and r[2].date() > as_of - dt.timedelta(days=7)]
        g = got[key]
        assert (g["count"], g["total"], g["count_7d"], g["total_7d"]) == (len(mine), sum(r[3] or 0 for r in mine), len(recent), sum(r[3] or 0 for r in recent))
        assert g["last_at"] == max((r[2] for r in mine if r[2]), default=None)
    wide = widen(window_features(store, as_of, {}), ["x", "y", "never"], ["count"])
    assert wide.columns == ["entity", "x_count", "y_count", "never_count"] and wide.count() == 3
    none = window_features(store.limit(0), None, {"7d": 7})
    assert none.count() == 0


# ---------------------------------------------------------------- helpers
def test_asof(spark):
    left = spark.createDataFrame([(150,), (250,), (50,), (None,)], "e int")
    right = spark.createDataFrame([(100,), (200,)], "m int")
    got = {r["e"]: r["m"] for r in latest_not_newer(left, "e", right, "m", fallback_newest=True).collect()}
    assert got == {150: 100, 250: 200, 50: 200, None: None}
    assert {r["e"]: r["m"] for r in latest_not_newer(left, "e", right, "m").collect()}[50] is None


@pytest.mark.parametrize("by", [None, ["g"]])
def test_asof_against_brute_force(spark, by):
    rng = random.Random(9)
    left = [(rng.choice("xy"), rng.choice([None, *range(50)]), i) for i in range(80)]
    right = [(rng.choice("xyz"), rng.choice([None, *range(0, 60, 3)])) for _ in range(25)]
    names = "g string, e int, i int"
    l_df, r_df = spark.createDataFrame(left, names), spark.createDataFrame(right, "g string, m int")
    got = {r["i"]: r["m"] for r in latest_not_newer(l_df, "e", r_df if by else r_df.drop("g"), "m", by).collect()}
    for g, e, i in left:
        fits = [m for h, m in right if m is not None and e is not None and m <= e and (not by or g == h)]
        assert got[i] == max(fits, default=None)
    assert latest_not_newer(l_df.limit(0), "e", r_df if by else r_df.drop("g"), "m", by).count() == 0


def test_numbered(spark):
    df = spark.range(0, 5000).repartition(7).withColumn("x", F.col("id") % 13)
    got = numbered(df, [F.desc("x"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert [(r["x"], r["id"]) for r in got] == sorted(((r["x"], r["id"]) for r in got), key=lambda p: (-p[0], p[1]))
    assert numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_entity_features_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    day = dt.datetime(2026, 1, 1)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), day + dt.timedelta(days=rng.randrange(40), hours=rng.randrange(24)) if rng.random() < 0.9 else None, rng.choice([None, 1, 5]))
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "e string, k string, t timestamp, v int").repartition(3)
    store = write_store(cumulative_store(df, "e", "k", "t", "v"), str(tmp_path / "store"))
    for end in (dt.date(2026, 1, 20), dt.date(2026, 2, 20)):
        got = {(r["entity"], r["kind"]): r for r in window_features(store, end, {"7d": 7, "28d": 28}).collect()}
        want = {}
        for e, k in {(r[0], r[1]) for r in rows}:
            mine = [r for r in rows if r[:2] == (e, k) and (r[2] is None or r[2].date() <= end)]
            last = max((r[2] for r in mine if r[2]), default=None)
            inside = {n: [r for r in mine if r[2] and (end - r[2].date()).days < n] for n in (7, 28)}
            if mine:
                want[e, k] = (len(mine), sum(r[3] or 0 for r in mine), last, (end - last.date()).days if last else None, *[f(x) for x in inside.values() for f in (len, lambda x: sum(r[3] or 0 for r in x))])
        assert {k: (r["count"], r["total"], r["last_at"], r["recency_days"], r["count_7d"], r["total_7d"], r["count_28d"], r["total_28d"]) for k, r in got.items()} == want
    listed = {r["entity"]: [t["kind"] for t in r["types"]] for r in by_entity(window_features(store, end, {"7d": 7}), {"7d": 7}).collect()}
    assert listed == {e: ["x", "y", "z"] for e in ("a", "b", None)}
