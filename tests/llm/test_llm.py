import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.llm import components, density_peaks, leaks, look, mixing, quality, set_pairs
from tidewake.llm.words import words


# ---------------------------------------------------------------- look
def brute_look(text):
    hidden, blank = look._classes()
    alike = look._alike()
    out = [" " if ord(c) in blank else look._compatible(c).translate(alike) for c in text if ord(c) not in hidden]
    return unicodedata.normalize("NFC", "".join(out))


def forms(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "x int, t string").withColumn("value", F.lit("clash")).withColumn("look", F.lit(1))
    return {r["x"]: r["t_look"] for r in look.consistent_text(df, ["t"]).collect()}


def test_forms(spark):
    pairs = {"ﬁne ｔｅｘｔ": "fine text", "é": "é", "a b": "a b", "a​b­": "ab", "раурal": "paypal", "νόμος": "vόμος".replace("ό", "ó"), "": "", "﻿": "", "l1O0 É": "l1O0 É"}
    got = forms(spark, [*pairs, None, "ｘ" * 50_000])
    assert [got[i] for i in range(len(pairs))][:5] == list(pairs.values())[:5]
    assert got[4] == "paypal" and got[6] == got[7] == "" and got[8] == "l1O0 É" and got[9] is None and got[10] == "x" * 50_000
    with pytest.raises(ValueError):
        look.consistent_text(spark.createDataFrame([("a", "b")], "t string, t_look string"), ["t"])


def test_forms_of_every_changed_character(spark):
    letters, single, several = look.replacements()
    values = ["x" + c + "́y" for c in [*letters, *list(single)[::7], *list(several)[::5]]]
    got = forms(spark, values)
    assert [got[i] for i in range(len(values))] == [brute_look(v) for v in values]


def test_look_alikes(spark):
    rows = [(5, "cafe", ["Tag", None, "Τag"]), (3, "саfe", None), (9, "cafe", []), (7, "Cafe", ["tag"]), (8, None, ["Tаg"]), (2, "", ["x"]), (4, "​", ["x"])]
    df = spark.createDataFrame(rows, "id bigint, t string, h array<string>")
    keys = look.look_keys(df, "id", ["t"], ["h"])
    got = {tuple(r) for r in look.look_alikes(keys.where("field_name = 't'")).collect()}
    assert got == {("t", "5", 0, "3"), ("t", "9", 0, "3"), ("t", "4", 0, "2")}
    ref = look.look_keys(spark.createDataFrame([(1, "Tag")], "r bigint, v string"), "r", ["v"])
    assert {tuple(r) for r in look.look_like(keys.where("field_name = 'h'"), ref).collect()} == {("h", "5", 2, "1"), ("h", "8", 0, "1")}
    assert look.look_keys(df.limit(0), "id", ["t"], ["h"]).count() == 0


# ---------------------------------------------------------------- pairs
def brute_pairs(sets, threshold, least):
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        s = len(sets[a] & sets[b])
        if s >= least and s / len(sets[a] | sets[b]) >= threshold:
            out[(a, b)] = s
    return out


@pytest.mark.parametrize("threshold,limit", [(0.5, 20_000), (0.7, 6)])
def test_pairs_against_brute_force(spark, monkeypatch, threshold, limit):
    monkeypatch.setattr(set_pairs, "ARRAY_LIMIT", limit)
    rng = random.Random(1)
    sets = {f"r{i:03}": set(rng.sample(range(60), rng.randrange(1, 14))) for i in range(150)}
    for i in range(60):  # near copies and copies
        base = sorted(sets[f"r{i:03}"])
        sets[f"s{i:03}"] = set(base[: max(1, len(base) - i % 3)])
    sets |= {f"hot{i}": {1, 2, 3, 100 + i} for i in range(50)}
    rows = [(r, f"v{x}", "clash") for r, s in sets.items() for x in s] + [("r000", None, ""), (None, "v1", ""), ("r001", f"v{min(sets['r001'])}", "")]
    df = spark.createDataFrame(rows, "who string, what string, rec string")
    pairs, members = set_pairs.similar_sets(df, "who", "what", threshold, 3, node_size=6)
    got = {tuple(sorted((r["record_a"], r["record_b"]))) for r in set_pairs.expanded(pairs, members, 3).collect()}
    want = brute_pairs(sets, threshold, 3)
    assert got == set(want)
    reps = {r["record"]: r["rep"] for r in members.collect()}
    assert len(reps) == len(sets) and all(sets[r] == sets[p] for r, p in reps.items())
    assert {(r["rec_a"], r["rec_b"]): r["shared"] for r in pairs.collect()} == {k: v for k, v in want.items() if reps[k[0]] == k[0] and reps[k[1]] == k[1] and reps[k[0]] != reps[k[1]]}


def test_no_pairs(spark):
    df = spark.createDataFrame([("a", "x")], "who string, what string")
    for d in (df, df.limit(0)):
        pairs, members = set_pairs.similar_sets(d, "who", "what")
        assert pairs.count() == 0 and members.count() == d.count()


# ---------------------------------------------------------------- groups
def brute_groups(pairs, records):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    for r in records:
        find(r)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}") for _ in range(50)]
    pairs += [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("hub", f"l{i:02}") for i in range(40)] + [("n01", None), (None, "solo"), (None, None), ("me", "me"), ("hub", "l01")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("record", F.lit("clash"))
    nodes = spark.createDataFrame([("other",), ("c03",)], "r string")
    got = {r["record"]: r["group"] for r in components.connected_groups(df, "a", "b", nodes, "r").collect()}
    assert got == brute_groups(pairs, ["other", "c03"])


def test_no_groups(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components.connected_groups(df, "a", "b").count() == 0


# ---------------------------------------------------------------- clusters
def blobs(spark, seed=0, sizes=(120, 90, 60)):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        centre = np.array([6.0 * (k == j) for j in range(3)] + [3.0 * k, -2.0 * k])
        rows += [(f"b{k}-{i:03}", *map(float, centre + rng.normal(0, 0.5, 5))) for i in range(n)]
    return rows


def test_clusters_of_blobs_in_small_blocks(spark):
    rows = [*blobs(spark), ("out", 6.0, 60.0, 0.0, 0.0, 0.0), ("b0-000x", *blobs(spark)[0][1:]), ("gap", None, 0.0, float("nan"), 0.0, 0.0), blobs(spark)[3]]
    df = spark.createDataFrame(rows, "h string, f0 double, f1 double, f2 double, f3 double, f4 double").withColumn("vec", F.lit(1))
    vectors = density_peaks.scaled_vectors(df, "h", [f"f{i}" for i in range(5)], [])
    for block in (40, 10_000):
        got = {r["record"]: r["cluster"] for r in density_peaks.density_clusters(vectors, block=block).collect()}
        assert len(got) == len({r[0] for r in rows})
        for k in range(3):
            assert len({c for h, c in got.items() if h.startswith(f"b{k}")}) == 1
        assert len({got[f"b{k}-001"] for k in range(3)}) == 3
    top = density_peaks.describe(density_peaks.density_clusters(vectors)).orderBy("cluster_id").collect()
    assert [r["cluster_size"] for r in top][:3] and sum(r["cluster_size"] for r in top) == len({r[0] for r in rows}) and top[0]["typical_records"].count("|") == 4


def test_few_records(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0)], "h string, f double")
    got = density_peaks.density_clusters(density_peaks.scaled_vectors(df, "h", ["f"], ["f"])).collect()
    assert {(r["record"], r["cluster"]) for r in got} == {("a", "a"), ("b", "a")}
    assert density_peaks.density_clusters(density_peaks.scaled_vectors(df.limit(0), "h", ["f"], [])).count() == 0


def test_equal_points_are_one_weighted_point(spark):
    rows = [("p%03d" % i, 1.0, 1.0) for i in range(300)] + [("q%d" % i, 5.0 + i / 50, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "h string, x double, y double")
    got = {r["record"]: r["cluster"] for r in density_peaks.density_clusters(density_peaks.scaled_vectors(df, "h", ["x", "y"], []), block=16).collect()}
    assert len(got) == 340 and len({got["p%03d" % i] for i in range(300)}) == 1


# ---------------------------------------------------------------- leaks
def brute_run(a, b):
    best = 0
    for i, j in itertools.product(range(len(a)), range(len(b))):
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        best = max(best, k)
    return best


def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (leaks.MATCH if x == y else leaks.MISMATCH), h[i - 1][j] + leaks.GAP, h[i][j - 1] + leaks.GAP)
    return max(map(max, h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12))
def test_alignment_against_brute_force(doc, item):
    score, start, end, doc_end, run = leaks.align(doc, item)
    assert score == brute_score(item, doc) and run == brute_run(item, doc)
    if score:
        assert 0 <= start < end <= len(item) and item[end - 1] == doc[doc_end - 1] and item[start] in doc


def test_words():
    assert words("ΟΔΌΣ οδός Straße x_y ½ a1") == ["οδοσ", "οδοσ", "strasse", "x", "y", "1", "2", "a1"]
    assert words(None) == words("") == []


@pytest.mark.parametrize("sent", [10**6, 0])
def test_leaks_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT_GRAMS", sent)
    monkeypatch.setattr(leaks, "SENT_PAIRS", sent)
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "short passage")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            w = items[rng.randrange(12)][1].split()
            n = rng.randrange(9, 16)
            at = rng.randrange(max(1, len(w) - n))
            text[10:10] = [x.upper() for x in w[at : at + n]]
        docs.append((d, ", ".join(text)))
    docs += [(100, None), (101, ""), (1, docs[3][1]), (102, " ".join(["x"] * 30_000) + " " + items[0][1])]
    got = leaks.leaked(spark.createDataFrame(docs, "doc bigint, text string").withColumn("item", F.lit(1)), "doc", "text", spark.createDataFrame(items, "id int, p string"), "id", "p")
    found = {(r["doc"], r["id"]) for r in got.where("longest_run >= 12").collect()}
    want = {(d, i) for d, t in docs for i, p in items if t and p and d != 102 and brute_run(words(p), words(t)) >= 12}
    if len(items[0][1].split()) >= 12:
        want.add((102, 0))
    assert found == want and len(want) > 5
    best = got.groupBy("doc", "id").count().where("count > 1").count()
    assert best == 0


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "d bigint, t string")
    items = spark.createDataFrame([(1, "a b c")], "i bigint, p string")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        assert leaks.leaked(d, "d", "t", i, "i", "p").count() == 0


# ---------------------------------------------------------------- mixing
@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 10), st.integers(0, 200)), min_size=1, max_size=6), st.integers(0, 400))
def test_apportionment_against_one_by_one(parties, seats):
    votes, caps = [p[0] for p in parties], [p[1] for p in parties]
    given_ = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if votes[i] > 0 and given_[i] < caps[i]]
        if not free:
            break
        given_[max(free, key=lambda i: (votes[i] / (2 * given_[i] + 1), votes[i], -i))] += 1
    got = mixing.sainte_lague(votes, seats, caps)
    assert sum(got) == sum(given_) and all(g <= c for g, c in zip(got, caps))
    spread = [abs(a - b) for a, b in zip(got, given_)]
    assert max(spread) <= 1  # equal quotients may fall to another


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["Big", "big ", "BIG", "small-one", "mid", None]) if i > 9 else "small one", "word " * rng.randrange(1, 30)) for i in range(600)]
    docs += [(900, "mid", None), (901, "mid", ""), (902, "untargeted", "x y z")]
    targets = [("m", "big", 0.5, 2), ("m", "small_one", 0.3, 4), ("m", "mid", 0.2, 1), ("n", "big", 0.5, 1), ("n", "none", 0.5, 9), ("m", "big", 0.5, 2), ("z", "none", 1.0, 1), ("z", "big", 0.0, 1)]
    df = spark.createDataFrame(docs, "id bigint, src string, body string").withColumn("tokens", F.lit("clash"))
    chosen, report = mixing.mix(df, "id", "src", "body", spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int"))
    rep = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert len(rep) == 7
    for s, share in (("big", 0.5), ("small_one", 0.3), ("mid", 0.2)):
        assert abs(rep[("m", s)]["actual_share"] - share) < 0.02
    assert rep[("n", "big")]["actual_share"] == 1.0 and rep[("n", "none")]["used_tokens"] == 0 and rep[("z", "big")]["used_tokens"] == 0
    rows = chosen.collect()
    limits = {(t[0], t[1]): t[3] for t in targets}
    assert all(1 <= r["copies"] <= limits[(r["mix_id"], r["source"])] for r in rows)
    assert len({(r["mix_id"], r["id"]) for r in rows}) == len(rows)
    used = {}
    for r in rows:
        used[(r["mix_id"], r["source"])] = used.get((r["mix_id"], r["source"]), 0) + r["tokens"] * r["copies"]
    assert all(used.get(k, 0) == r["used_tokens"] for k, r in rep.items())
    again = {tuple(r) for r in mixing.mix(df, "id", "src", "body", spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int"))[0].collect()}
    assert again == {tuple(r) for r in rows}
    few, rep2 = mixing.mix(df, "id", "src", "body", spark.createDataFrame(targets[:3], "mix_id string, source string, target_share double, max_repeats int"), total_tokens=10**7)
    assert {r["source"]: r["used_tokens"] == r["available_tokens"] * r["max_repeats"] for r in rep2.collect()} == {"big": True, "small_one": True, "mid": True}


def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([], "id bigint, src string, body string"), spark.createDataFrame([("m", "a", 1.0, 2)], "mix_id string, source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, "id", "src", "body", targets)
    assert chosen.count() == 0 and report.first()["used_tokens"] == 0
    chosen, report = mixing.mix(docs, "id", "src", "body", targets.limit(0))
    assert chosen.count() == report.count() == 0


# ---------------------------------------------------------------- quality
COMMON = "the of and to in a that is was for it with as on by at from this και το η ο να του της".split()
PROSE = "When the council opened a new road, people near the harbour asked for more time. It was slow work, but the editor wrote about it with some care and the paper stayed open."
KINDS = {
    "prose": (PROSE, False),
    "wrapped": ("\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), False),
    "word a line": ("\n".join(PROSE.split()), False),
    "quoted": ("\n".join("> " + PROSE[i : i + 50] for i in range(0, len(PROSE), 50)), False),
    "greeklish": ("To symvoylio exetase to schedio prin apo to mesimeri, gia na kalypsei tis anagkes tis periochis. Symfona me ton dimo, i meleti den itan pliri.", False),
    "capitals": (PROSE.upper(), False),
    "tagged": (PROSE + " #Road #Harbour", False),
    "bars": ("\n".join(f"name{i} | {i * 37} | {i}% | the road" for i in range(12)), True),
    "commas": ("\n".join(f"name{i},{i * 37},,{i}%,no" for i in range(12)), True),
    "blanks": ("\n".join(f"name{i}   {i * 37}   open" for i in range(12)), True),
    "bullets": ("\n".join(f"- the way from {w} to the {w}" for w in "road harbour paper editor council library".split()), True),
    "bare list": ("\n".join(f"the {w} of the harbour" for w in "road harbour paper editor council library".split()), True),
    "inline list": ("Anna Bell, Carl Dow, Eve Fox, Gil Hay, Ida Joy, Kim Lee, Max Nye, Ola Poe, Ray Sun", True),
    "log": ("\n".join(f"2031-04-16T17:{i:02}:00Z INFO export={i * 99} rows={i} ms=5" for i in range(10)), True),
    "tags": (" ".join(f"#Tag{i}" for i in range(40)), True),
    "salad": (" ".join("harbour council library engineer regional useful patience traffic momentum village station worker".split() * 6), True),
    "keys": ("dyn lg cfdkltlffj dnjjryacbc yqsn lkecggly xtznmywmym wjf wvvkrsqad zyfxghb dsjhfg mcnktzll", True),
    "base64": ("p234oEY0Y9XEp9g9q3gOlDSMeDe86c2NWRp7IiAE778cqQTNufPvilOykdJ8ZDlKz8fX9PF2aYNJxiDTXD517aTGLs2", True),
    "repeated": ("The council opened the road and the paper was slow. " * 12, True),
    "pattern": ("no" * 200, True),
    "emoji": ("🌊⚓🚢\n💬🔥\n" * 10, True),
    "menu": ("\n".join(["Show more", "Reply", "Home | Posts | Lists", "Share  Reply  Report"] * 6), True),
    "mostly table": (PROSE[:80] + "\n" + "\n".join(f"name{i};{i * 37};{i}%;open" for i in range(30)), True),
    "mostly prose": (PROSE * 1 + " " + PROSE.replace("road", "bridge").replace("harbour", "river").replace("council", "union") + "\na;1;2\nb;3;4", False),
    "empty": ("", False),
    "missing": (None, False),
}


@pytest.mark.parametrize("kind", KINDS)
def test_kinds_of_text(kind):
    text, junk = KINDS[kind]
    stats = quality.text_statistics(text, frozenset(COMMON))
    assert (stats["not_prose_share"] > 0.5) == junk, stats
    assert all(np.isfinite(v) for v in stats.values())


def test_statistics_table(spark):
    rows = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "a " * 100_000)]
    df = spark.createDataFrame(rows, "d bigint, t string").withColumn("words", F.lit("clash"))
    got = quality.quality(df, "d", "t", COMMON).collect()
    assert len(got) == 5 and got[0] == got[1] and got[2]["words"] == 0 and got[4]["words"] == 100_000
    assert got[0]["punctuated_line_share"] == 1 and 0 < got[0]["common_word_share"] < 1
    assert quality.quality(df.limit(0), "d", "t", COMMON).count() == 0


def test_period_and_alignment():
    text = "\n".join(("    " if i % 2 else "") + f"key{i} : {i} : x" for i in range(16))
    stats = quality.text_statistics(text, frozenset(COMMON))
    assert stats["indent_period"] > 0.8 and stats["delimiter_alignment"] > 0.9


@pytest.mark.parametrize("copies", [1, 5])
def test_edited_copies_are_found(spark, copies):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(2500)]
    weight = [1 / (i + 3) for i in range(len(vocabulary))]
    said = lambda n: rng.choices(vocabulary, weight, k=n)
    items = [(i, said(60)) for i in range(60)]
    docs, planted = [(d, " ".join(said(120))) for d in range(1500)], {}
    for rate in (0.1, 0.2, 0.3):
        for i, w in items:
            for _ in range(copies):
                at = rng.randrange(20)
                part = [rng.choice(vocabulary) if rng.random() < rate else x for x in w[at : at + 40]]
                planted[len(docs), i] = rate
                docs.append((len(docs), " ".join(said(50) + part + said(30))))
    got = leaks.leaked(spark.createDataFrame(docs, "d bigint, t string"), "d", "t", spark.createDataFrame([(i, " ".join(w)) for i, w in items], "i int, p string"), "i", "p").collect()
    found = {(r["d"], r["i"]): r for r in got}
    for rate in (0.1, 0.2, 0.3):
        mine = [k for k, v in planted.items() if v == rate]
        assert sum(k in found for k in mine) >= 0.9 * len(mine), rate
    assert all(r["points"] >= 24 and 0 < r["score"] <= 1 for r in got)
    assert len(set(found) - set(planted)) <= 0.05 * len(planted)


def _brute_pairs(sets, threshold, least):
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= least and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_values_that_all_records_share_make_no_square(spark, monkeypatch):
    rng = random.Random(6)
    sets = {f"r{i:03d}": {"hot1", "hot2"} | {f"v{rng.randrange(3000)}" for _ in range(10)} for i in range(600)}
    for i in range(0, 60, 2):
        sets[f"r{i + 1:03d}"] = set(sorted(sets[f"r{i:03d}"])[:-2]) | {f"w{i}"}
    sets["r500"] = set(sets["r010"])
    rows = spark.createDataFrame([(r, v) for r, s in sets.items() for v in s], "r string, v string")
    seen, whole = [], set_pairs._verified
    monkeypatch.setattr(set_pairs, "_verified", lambda found, *rest: seen.append(found.count()) or whole(found, *rest))
    pairs, members = set_pairs.similar_sets(rows, "r", "v", 0.5, 3)
    want = _brute_pairs(sets, 0.5, 3)
    assert {(r["record_a"], r["record_b"]) for r in set_pairs.expanded(pairs, members, 3).collect()} == want and len(want) > 30
    assert seen[0] < 0.1 * 600 * 599 / 2
    links = {r["record"]: r["links"] for r in set_pairs.linked_classes(pairs, members, 3).collect()}
    assert links == {r: sum(r in p for p in want) for r in sets}


def test_many_records_alike_are_compared_where_they_are(spark):
    rng = random.Random(7)
    core = [f"c{i}" for i in range(30)]
    sets = {f"r{i:03d}": set(rng.sample(core, 26)) | {f"x{i}"} for i in range(120)}
    rows = spark.createDataFrame([(r, v) for r, s in sets.items() for v in s], "r string, v string")
    pairs, members = set_pairs.similar_sets(rows, "r", "v", 0.5, 3)
    assert {(r["record_a"], r["record_b"]) for r in set_pairs.expanded(pairs, members, 3).collect()} == _brute_pairs(sets, 0.5, 3)
