"""Look-alikes, written down by hand from what the characters look like."""

import pytest

from tidewake.llm import look

SAME = {
    "ϲat": "cat", "Ϲat": "Cat", "ᎪᏟᎬ": "ACE", "ꓮꓲꓣ": "AIR", "ⲟⲣ": "op", "ᴏᴄ": "oc", "ѵ": "v", "non‑stop": "non-stop", "−5": "-5", "re‐do": "re-do",
    "𐐬x": "ox", "ｆｕｌｌ": "full", "ﬁne": "fine", "café": "café", "a b": "a b", "a​b": "ab", "a　b": "a b", "Αθήνα": "Aθήva", "раураl": "paypal", "𝐛𝐨𝐥𝐝": "bold",
    "\U0001ee00": "ا", "ⅣⅨ": "IVIX", "a⁦b⁩": "ab",
}
APART = [("Cat", "cat"), ("cafe", "café"), ("l1I", "lII"), ("O0", "OO"), ("a–b", "a-b"), ("①", "1"), ("x²", "x2"), ("З", "3")]


@pytest.fixture(scope="module")
def forms(spark):
    values = sorted({v for p in [*SAME.items(), *APART] for v in p})
    rows = look.consistent_text(spark.createDataFrame([(v,) for v in values], "v string"), ["v"]).collect()
    return {r["v"]: r["v_look"] for r in rows}


@pytest.mark.parametrize("given", SAME)
def test_same_look(forms, given):
    assert forms[given] == forms[SAME[given]]


@pytest.mark.parametrize("pair", APART, ids=str)
def test_other_look(forms, pair):
    assert forms[pair[0]] != forms[pair[1]]
