"""Scalar functions and section numbers against worked examples."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lineweave.functions import numbering as N
from lineweave.functions import text as X


def _column(spark, texts, made):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r["v"] for r in df.withColumn("v", made).orderBy("n").collect()]


def _normal(t):
    t = t.replace("\r\n", "\n").translate(str.maketrans({**dict.fromkeys(X.TO_SPACE, " "), **dict.fromkeys(X.REMOVED, ""), **dict.fromkeys(X.TILDES, "〜"), **dict.fromkeys(X.MINUSES, "−"), **dict.fromkeys(X.LONG_MARKS, "ー")}))
    t = unicodedata.normalize("NFKC", t).replace("\t", "  ")
    return "".join(c for c in t if c.isprintable()).rstrip()


def test_normalized(spark):
    texts = ["a~b\tc  ", "x\r\ny\rz", "①ﬁ ㋐ Ⓐ", "a​b﻿", "‐–—", "ñ ñ", "", "\x00a\x07", "日本　語", "tab\t", "é́"]
    assert _column(spark, texts, X.normalized(F.col("text"))) == [_normal(t) for t in texts]
    assert _column(spark, [None], X.normalized(F.col("text"))) == [None]


@pytest.mark.parametrize(
    ("made", "cases"),
    [
        (X.therefore, {"now, therefore": True, "now  therefore": True, "now therefore": False, "now,therefore": False, None: False}),
        (X.list_ish, {"floor": True, "or": False, "a, ": True, "this and  ": True, "x": False, None: False}),
        (X.whereas, {" WHEREAS it": True, "where": False, None: False}),
        (X.colon_ish, {"a:": True, "a: ": True, "": False, "a": False, None: False}),
        (X.punctuated, {"a.": True, "a": False, None: True}),
        (X.all_capital, {"ABC 1": 1, "Abc": 0, None: -1}),
        (X.horizontal_line, {"---": True, "* * *": True, "--": False, "-=-": False, "abc": False, None: False}),
        (X.page_like1, {"page 3": True, "Page 3": False, "PAGE": True}),
        (X.page_like2, {"1/2": True, "- 3 -": True, "1-2": False}),
        (X.space_emphasis, {"A  B  C": True, "AB": False}),
        (X.parenthesis_emphasis, {"1. (abcdefgh)": True, "(a) long text here": False, "plain": False, None: False}),
        (X.space_separated, {"a b c": 0.4, "": 0.0, None: 0.0}),
    ],
)
def test_lexical(spark, made, cases):
    assert _column(spark, list(cases), made(F.col("text"))) == list(cases.values())


def test_pairs(spark):
    rows = [("a__ ", " __b", "xaby", "zabw"), ("a", "__b", "a", "b"), (None, "x", "", "ab"), ("kitten", "sitting", "kitten", "sitting")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, a string, b string, c string, d string")
    got = df.select("n", X.mask_continuation(F.col("a"), F.col("b")).alias("m"), X.common_bigram(F.col("c"), F.col("d")).alias("g"), X.longest_common_substring(F.col("c"), F.col("d")).alias("l"), X.edit_share(F.col("a"), F.col("b")).alias("e")).orderBy("n").collect()
    assert [r["m"] for r in got] == [True, False, False, False]
    assert [r["g"] for r in got] == [True, False, False, True]
    assert [r["l"] for r in got] == ["ab", "", "", "itt"]
    assert got[3]["e"] == pytest.approx(3 / 7)


def _shown(found):
    return [(c["kind"], c["bullet"] if c["num"] is None else c["num"]) for c in found]


def test_candidates_en(spark):
    cases = {
        "1. Term": [("arabic", 1)], "(a) x": [("alph_lower", 1)], "i) x": [("alph_lower", 9), ("roman_lower", 1)], "iv. x": [("roman_lower", 4)], "X. y": [("alph_upper", 24)],
        "1.2. z": [("arabic_multilevel", 2)], "1.2.3) z": [("arabic_multilevel", 3)], "ARTICLE 5": [("roman_lower", 0), ("roman_upper", 0), ("arabic", 5)],
        "Section II": [("alph_upper", 9), ("roman_lower", 0), ("roman_upper", 2)], "- item": [("bullet_point", "-")], "() x": [("roman_lower", 0), ("roman_upper", 0)], "plain": [],
        "§3": [("roman_lower", 0), ("roman_upper", 0), ("arabic", 3)], "": [], None: [],
    }
    assert [_shown(x) for x in _column(spark, list(cases), N.candidates("text"))] == list(cases.values())


def test_candidates_ja(spark):
    cases = {"一．": [], "弐拾五: ": ("kansuji", 25), "拾五)": ("kansuji", 15), "弐拾)": ("kansuji", 20), "二〇)": ("kansuji", 20), "第五条": ("kansuji", 5), "第 3 章": ("arabic", 3), "【ア】": ("katakana", 0), "(い)": ("hiragana", 1), "①": ("kakoimoji", 0), "㉑": ("kakoimoji", 20)}
    for (t, want), found in zip(cases.items(), _column(spark, list(cases), N.candidates("text", "ja")), strict=True):
        assert not _shown(found) if want == [] else want in _shown(found), t
    assert not any(k == "kansuji" for k, _ in _shown(_column(spark, ["〇)"], N.candidates("text", "ja"))[0]))


def test_automaton(spark):
    lines = ["1. A", "text", "(a) b", "(b) c", "2. D", "7. E", "- x", "- y", "3. F"]
    listing, states = N.NumberedList(), []
    for found in _column(spark, lines, N.candidates("text")):
        states.append(listing.push([(c["kind"], c["num"], c["bullet"]) for c in found])[0])
    assert states == [2, 0, 2, 1, 3, 4, 2, 1, 3]


def test_body_indent(spark):
    cases = {"  (a) body": 6, "1. body": 3, "    body": 4, "- body": 2, "ARTICLE 5  Scope": 11, "body": 0, "1.2. x": 5}
    assert _column(spark, list(cases), N.body_indent(F.col("text"))) == list(cases.values())
