"""Text normalisation and the lexical functions, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Which characters become which before NFKC.
REMOVED = "​﻿"
TO_SPACE = "\r\n"
TILDES = "~˜˷̴̰̃∼～〜"
MINUSES = "˗֊‐‑‒–⁃⁻₋−"
LONG_MARKS = "﹣－ｰ—―─━ー"

_FROM = TO_SPACE + TILDES + MINUSES + LONG_MARKS + REMOVED
_TO = "  " + "〜" * len(TILDES) + "−" * len(MINUSES) + "ー" * len(LONG_MARKS)


def translated(text: Column) -> Column:
    """CRLF to LF, then the table above: characters without a partner are removed."""
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), _FROM, _TO)


def _nfkc(text: Column) -> Column:
    """The part of the normalisation that needs Python."""

    # made here, as workers import this module and have no session
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).replace("\t", "  ") if c.isprintable()).rstrip())

    return run(text)


def normalized(text: Column) -> Column:
    """Translation, NFKC, tabs to two spaces, characters that do not print dropped, trailing white space dropped.

    ASCII text stays in the JVM (NFKC leaves it alone); only other text goes to Python, in Arrow batches.
    """
    t = translated(text)
    plain = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\t"), F.lit("  ")), "[\\x00-\\x1F\\x7F]", ""), " +$", "")
    # the wave dash that replaces ~ is its own NFKC form
    return F.when(t.rlike("^[\\x00-\\x7F〜]*$"), plain).otherwise(_nfkc(F.when(~t.rlike("^[\\x00-\\x7F〜]*$"), t)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def whereas(t: Column) -> Column:
    return F.coalesce(F.lower(F.trim(t)).startswith("whereas"), F.lit(False))


def colon_ish(t: Column, marks: str = "-;:,") -> Column:
    """The last character is one of the marks; false for empty text and for none."""
    return F.coalesce(F.right(F.trim(t), F.lit(1)).isin(*marks), F.lit(False))


def punctuated(t: Column, marks: str = ".") -> Column:
    """Ends with a full stop; true where there is no text."""
    return F.coalesce(F.right(F.trim(t), F.lit(1)).isin(*marks), F.lit(True))


def list_ish(t: Column) -> Column:
    """Ends with a comma, a semicolon, `and` or `or`, which need not be words, after at least one character."""
    return F.coalesce(t.rlike("(?i)(?<!^)(?:,|;|and|or) *$"), F.lit(False))


def therefore(t: Column) -> Column:
    return F.coalesce(F.trim(t).rlike("(?i)^now[ ,]+ therefore"), F.lit(False))


def all_capital(t: Column) -> Column:
    """1 or 0; -1 where there is no text."""
    return F.coalesce((F.upper(t) == t).cast("int"), F.lit(-1))


def mask_continuation(a: Column, b: Column) -> Column:
    return F.coalesce(F.endswith(F.trim(a), F.lit("__")) & F.startswith(F.trim(b), F.lit("__")), F.lit(False))


def space_separated(t: Column) -> Column:
    """Blanks inside the trimmed text over the length of the whole; 0 for none."""
    inside = F.trim(t)
    return F.coalesce((F.length(inside) - F.length(F.replace(inside, F.lit(" "), F.lit("")))) / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def horizontal_line(t: Column) -> Column:
    """At least three characters, all the same mark of a set, blanks aside."""
    inside = F.trim(t)
    return F.coalesce((F.length(inside) >= 3) & inside.rlike("^([*\\-=#%_+])(?:\\1| )*$"), F.lit(False))


def page_like1(t: Column) -> Column:
    return F.coalesce(t.rlike("page [1-9]|PAGE"), F.lit(False))


def page_like2(t: Column) -> Column:
    return F.coalesce(t.rlike("[0-9]/[1-9]|- ?[0-9]+ ?-"), F.lit(False))


def bigrams(t: Column) -> Column:
    """All substrings of two characters; none for shorter texts. Linear in the text: it is cut into characters once."""
    c = F.split(t, "")
    n = F.length(t) - 1
    return F.when(n >= 1, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))


#: Characters at the heads of two texts in which a common bigram is looked for first.
HEAD = 64


def common_bigram(a: Column, b: Column) -> Column:
    """Whether the longest common substring has two characters or more. Most pairs show it in their heads; the others are compared whole."""
    heads = F.arrays_overlap(bigrams(F.left(a, F.lit(HEAD))), bigrams(F.left(b, F.lit(HEAD))))
    return F.coalesce(F.when(heads, F.lit(True)).when((F.length(a) > HEAD) | (F.length(b) > HEAD), F.arrays_overlap(bigrams(a), bigrams(b))), F.lit(False))


def first_longest(x: str, y: str) -> str:
    """The first of the longest substrings of x that y has; quadratic in time, linear in memory."""
    best, end, before = 0, 0, [0] * (len(y) + 1)
    for i, c in enumerate(x):
        now = [0] * (len(y) + 1)
        for j, d in enumerate(y):
            if c == d:
                now[j + 1] = before[j] + 1
                if now[j + 1] > best:
                    best, end = now[j + 1], i + 1
        before = now
    return x[end - best : end]


def longest_common_substring(a: Column, b: Column) -> Column:
    """first_longest of two columns; null if one is null."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else first_longest(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return run(a, b)


def distance_of(x: str, y: str, most: int | None = None) -> int:
    """Edit distance, a column of the table at a time as the bits of two integers (Myers 1999, Hyyrö 2003). Beyond `most`, some number beyond it."""
    if len(x) > len(y):
        x, y = y, x
    lo, hi = 0, len(x)
    while lo < hi and x[lo] == y[lo]:
        lo += 1
    cut = len(y) - hi
    while hi > lo and x[hi - 1] == y[hi + cut - 1]:
        hi -= 1
    x, y = x[lo:hi], y[lo : hi + cut]
    m = len(x)
    if not m:
        return len(y)
    places: dict[str, list[int]] = {}
    for k, c in enumerate(x):
        places.setdefault(c, []).append(k)
    bits = {}
    for c, at in places.items():
        own = bytearray(m // 8 + 1)
        for k in at:
            own[k >> 3] |= 1 << (k & 7)
        bits[c] = int.from_bytes(own, "little")
    whole, top = (1 << m) - 1, m - 1
    up, down, score, left = whole, 0, m, len(y)
    for c in y:
        eq = bits.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | (whole & ~(d0 | up))
        hn = d0 & up
        score += (hp >> top) - (hn >> top)
        left -= 1
        if most is not None and score - left > most:
            return score - left
        hp = (hp << 1) | 1
        up = ((hn << 1) | (whole & ~(d0 | hp))) & whole
        down = d0 & hp & whole
    return score


#: Calls of numpy for each 64 characters of a column of the table: as many pairs at least make them worth while.
CALLS = 17


def _beside(pairs: list[tuple[str, str]], words: int) -> list[int]:
    """Edit distances of pairs whose shorter texts take as many words of 64 bits, longest longer text first: a column of all tables at a time."""
    count = len(pairs)
    code = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    short, long = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    own = lambda n: np.repeat(np.arange(count, dtype=np.int64), n) << 21
    known, at = np.unique(own(short) | code(x for x, _ in pairs), return_inverse=True)
    place = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
    bits = np.zeros((words, len(known) + 1), np.uint64)  # the last column: characters that the shorter text has not
    np.bitwise_or.at(bits, (place >> 6, at), np.uint64(1) << (place & 63).astype(np.uint64))
    sought = own(long) | code(y for _, y in pairs)
    found = np.minimum(np.searchsorted(known, sought), len(known) - 1)
    found = np.where(known[found] == sought, found, len(known))
    begins = np.cumsum(long) - long
    last = ((short - 1) & 63).astype(np.uint64)
    up, down, score = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64), short.copy()
    one, top = np.uint64(1), np.uint64(63)
    active = np.searchsorted(-long, -np.arange(long[0]), side="left")  # pairs that have a column j
    for j, n in enumerate(active.tolist()):
        eqs = bits[:, found[begins[:n] + j]]
        plus, minus = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for w in range(words):
            pv, mv, eq = up[w, :n], down[w, :n], eqs[w]
            xv = eq | mv
            eq |= minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            if w == words - 1:
                score[:n] += ((ph >> last[:n]) & one).astype(np.int64) - ((mh >> last[:n]) & one).astype(np.int64)
            after = ph >> top, mh >> top
            ph = (ph << one) | plus
            up[w, :n] = (mh << one) | minus | ~(xv | ph)
            down[w, :n] = ph & xv
            plus, minus = after
    return score.tolist()


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Edit distances of pairs of texts. Pairs of about a length are worked on together, those that have too few like them one by one."""
    out = [0] * len(pairs)
    groups: dict[int, list[int]] = {}
    ordered = [(x, y) if len(x) <= len(y) else (y, x) for x, y in pairs]
    for k, (x, y) in enumerate(ordered):
        if x and x != y:
            groups.setdefault((len(x) + 63) // 64, []).append(k)
        elif not x:
            out[k] = len(y)
    for words, members in groups.items():
        members.sort(key=lambda k: -len(ordered[k][1]))
        least = CALLS * words
        # columns that few pairs have are not worth a call either
        far = 2 * len(ordered[members[min(least, len(members) - 1)]][1])
        cut = next((i for i, k in enumerate(members) if len(ordered[k][1]) <= far), len(members)) if len(members) > least else len(members)
        for k in members[:cut]:
            out[k] = distance_of(*ordered[k])
        if cut < len(members):
            for k, d in zip(members[cut:], _beside([ordered[k] for k in members[cut:]], words), strict=True):
                out[k] = d
    return out


#: Bytes of text and pairs that are worked on at once.
PAIR_BYTES, PAIR_ROWS = 8 << 20, 20_000


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in characters; null if one is null. In Python, on the bits of integers: a cell of the table is a bit of 64, where the JVM's function takes a step for each."""

    # made here, as workers import this module and have no session
    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        there = pc.and_(pc.is_valid(x), pc.is_valid(y))
        rows = np.flatnonzero(there.to_numpy(zero_copy_only=False))
        sizes = np.cumsum(pc.fill_null(pc.add(pc.binary_length(x), pc.binary_length(y)), 0).to_numpy(zero_copy_only=False)[rows].astype(np.int64))
        out, lo = np.zeros(len(x), np.int32), 0
        while lo < len(rows):
            hi = min(lo + PAIR_ROWS, max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PAIR_BYTES, "right"))))
            own = pa.array(rows[lo:hi])
            out[rows[lo:hi]] = distances(list(zip(x.take(own).to_pylist(), y.take(own).to_pylist(), strict=True)))
            lo = hi
        return pa.array(out, pa.int32(), mask=~there.to_numpy(zero_copy_only=False))

    return run(a, b)


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the length of the longer text."""
    return edit_distance(a, b) / F.greatest(F.length(a), F.length(b))


def space_emphasis(t: Column) -> Column:
    return F.coalesce(t.rlike("^(?:[^ ] +)+[^ ]$"), F.lit(False))


#: Bracketed spans (fixed values).
BRACKETS = r"<[^>]+>|\([^\)]+\)|\[[^\]]+\]|【[^】]+】|〔[^〕]+〕"


def parenthesis_emphasis(t: Column) -> Column:
    """The first bracketed span is longer than half the text."""
    return F.coalesce(F.length(F.regexp_extract(F.trim(t), BRACKETS, 0)) * 2 > F.length(F.trim(t)), F.lit(False))
