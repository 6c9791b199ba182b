"""The training-data operators against brute-force forms, exact round trips and held-out accuracy, and their odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineweave.llm import ann, langid, licenses, maxent, mixing, pieces, simhash, syncmers, toxicity, warc

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def _docs(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, ["en", "fr"][k % 2], f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


ODD = [None, "", "   ", "x", "a" * 50000, "word " * 20000, "same text here", "same text here", "éà ü", "\x00\x1f", "▁▁ a  b\n\tc", "𝒜 💥"]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [*range(len(ODD) - 2), 3, None]
    return _docs(spark, ODD, ids).withColumn("block", F.lit(1)).withColumn("ids", F.lit("x"))


def test_odd_inputs_keep_rows(spark, odd):
    empty = odd.limit(0)
    for rows in (odd, empty):
        n = rows.count()
        assert pieces.encoded(rows).count() == n
        assert simhash.simhash_components(rows).count() == n
        assert licenses.licenses(rows).count() == n
        assert syncmers.edited(rows).count() == n
        assert maxent.scored(rows).count() == n
        mixed = mixing.mixed(rows)
        assert mixed.count() == n and len(set(mixed.columns)) == len(mixed.columns)
        labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
        assert toxicity.scored(rows, toxicity.learn(rows, labels)).count() == n
        assert langid.predict(rows, langid.learn(rows)).count() == n
        assert toxicity.without_toxic(rows, labels).columns == rows.columns
        assert langid.identified(rows).columns == rows.columns and simhash.one_of_each(rows).columns == rows.columns


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    rng = random.Random(3)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("ab c▁é\nthe1") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [_prose(rng, 50) for _ in range(50)]
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    rows = pieces.encoded(_docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == library.encode(texts)
    assert [r["round_trip"] for r in rows] == ["▁" not in t for t in texts]
    back = pieces.decoded(pieces.encoded(_docs(spark, ["a  b\n", None])).select("doc_id", "ids")).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["a  b\n", None]


def test_language_held_out(spark):
    rng = random.Random(5)
    words = {"en": ["the", "thing", "with", "and", "that"], "de": ["der", "nicht", "und", "schön", "über"], "fr": ["le", "été", "avec", "et", "où"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(400))]
    rows += [(400, None, "en"), (401, "12 -", "de"), (402, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.learn(df)).collect()
    held = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] >= 400) and all(0 <= r["lang_score"] <= 1 for r in got)


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    bad = ["grobnak", "vilefink", "scumzor"]
    rows, labels = [], []
    for k in range(600):
        toxic = rng.random() < 0.3
        text = ". ".join(_prose(rng, 12) for _ in range(4))
        if toxic:
            w = rng.choice(bad)
            at = rng.randrange(1, len(w))
            text += f". You are a {rng.choice([w, w.upper(), w[:at] + '-' + w[at:], w[:at] + '*' + w[at:]])}"
        else:
            text += ". You are a friend"
        rows.append((k, text))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, toxicity.learn(docs, marks)).collect()}
    held = [(got[k] >= 0.5, bool(t)) for k, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_neighbours_against_all(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[10:60] = v[9]  # copies of a query's neighbour: ties go to smaller ids
    rows = [(k, v[k].tolist()) for k in range(700)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0]), (50, v[50].tolist()), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got: dict[int, list] = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 700, 50))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        want = sorted(range(700), key=lambda k: (-round(s[k], 12), k))[:5]
        hits += len({k for k, _ in found} & set(want))
        assert all(abs(score - s[k]) < 1e-12 for k, score in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [k for k, _ in got[50]] == [9, 10, 11, 12, 13]
    assert ann.neighbours(df.limit(0)).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(8)
    index = ann.MultiIndex(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    index.deal(np.ones(63, np.int64), 8)
    x = rng.normal(size=8)
    d = (ann.distances(x[None, :4], index.first)[0][:, None] + ann.distances(x[None, 4:], index.second)[0]).ravel()
    assert [d[c] for c in index.walk(x, 10**9)] == sorted(d)


def test_mixing_lags_less_than_a_block(spark):
    own = mixing.quotas({"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}, 40)
    assert sum(own.values()) == 40
    took = {r["key"]: r["slots"] for r in mixing.schedule(spark, own).collect()}
    assert sorted(s for x in took.values() for s in x) == list(range(40))
    for key, slots in took.items():
        for t in range(1, 41):
            assert abs(sum(s < t for s in slots) - own[key] * t / 40) < 1, (key, t)
    rng = random.Random(9)
    docs = _docs(spark, [_prose(rng, rng.randint(1, 60)) for _ in range(90)])
    rows = mixing.mixed(docs, block_chars=200, period=10).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for some in by.values():
        some.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        start = 0
        for r in some:
            assert (r["start"], r["block"]) == (start, start // 200)
            start += len(r["text"])
    with pytest.raises(ValueError, match="no weight"):
        mixing.mixed(docs, {"src0": 1.0})


def test_arc_versions():
    one, two = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\n</p>", b"plain"
    for version in (1, 2):
        data = warc.arc_head(version, "x.arc", "20010203040506")
        for url, body, kind in (("http://a.b/c d", one, "text/html"), ("dns:a.b", two, "text/dns")):
            data += warc.arc_line(version, url, body, "20010203040506", "1.2.3.4", kind) + body + b"\n"
        records = list(warc.parse_arc(data))
        assert [r.version for r in records] == [version] * 3 and [r.body for r in records[1:]] == [one, two]
        made = [warc.convert(r, f"x:{r.offset}") for r in records]
        assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource"]
        assert made[1].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and made[1].headers["WARC-IP-Address"] == "1.2.3.4"
        assert made[1].headers["WARC-Payload-Digest"] == "sha1:" + warc.sha1(b"<p>\r\n\r\n</p>")
        stream = b"".join(bytes(m) + warc.END for m in made)
        for size in (1, 7, 10**6):
            back = list(warc.parse_warc(stream[k : k + size] for k in range(0, len(stream), size)))
            assert [(b.headers, b.block) for b in back] == [(m.headers, m.block) for m in made]
        with pytest.raises(ValueError, match="declares"):
            list(warc.parse_arc(data[:-3]))


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", None, "", "<p>a</p>", "x\r\n\r\ny\r\n\r\n", "\r\n\r\n", "é" * 5000, "<p>a</p>", "\r\n"]
    ids = [7, 1, 2, 3, 4, 5, 6, 3, None]
    df = spark.createDataFrame([(i, f"http://x/{k}" if k else None, h) for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((tuple(r) for r in warc.archived(df, str(tmp_path / "w")).collect()), key=repr)
    want = []
    for i, h in zip(ids, html, strict=True):
        data = (h or "").encode()
        least = min((x for x, y in zip(ids, html, strict=True) if (y or "").encode() == data and x is not None), default=None)
        again = least is not None and least != i
        want.append((i, len(data), warc.sha1(data), "revisit" if again else "response", least if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archived(df.limit(0), str(tmp_path / "e")).count() == 0
    assert {r["record_type"] for r in warc.archived(df, str(tmp_path / "m"), min_bytes=10**6).collect()} == {"response"}


def _long(*values):
    """Spark's xxhash64 of longs: each is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _fingerprint(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(syncmers.WORD, lower)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    runs = [_long(a, b) for a, b in zip(words, words[1:], strict=False)]
    found = set()
    for i in range(len(runs) - 3):
        four = runs[i : i + 4]
        if min(four) in (four[0], four[3]):
            h = _long(four[0], four[2], four[3])
            found.add(h - (h // 2**31) * 2**31 if h >= 0 else -(-h % 2**31))
    if not found and words:
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(int(w & (1 << 64) - 1).to_bytes(8, "little"), seed)
        h = seed - (1 << 64) if seed >> 63 else seed
        found = {h % 2**31 if h >= 0 else -(-h % 2**31)}
    return sorted(found)[: syncmers.KEPT]


def _alike(a, b):
    both = sorted({*a, *b})[: syncmers.KEPT]
    return 1.0 if not both else len(set(both) & set(a) & set(b)) / len(both)


def test_syncmers_against_brute_force(spark):
    rng = random.Random(10)
    texts = [_prose(rng, rng.randint(0, 200)) for _ in range(40)] + [None, "", "one two", "É " * 30, "x" * 500]
    ids = rng.sample(range(1000), len(texts))
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    after = {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}
    show = lambda f: "".join(f"{x & 0xFFFFFFFF:08x}" for x in f)
    for r in syncmers.edited(_docs(spark, texts, ids)).collect():
        k = ids.index(r["doc_id"])
        text, following = texts[k] or "", texts[after[k]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, other, changed = _fingerprint(text), _fingerprint(following), _fingerprint(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(own), show(changed))
        assert r["near_edited"] == pytest.approx(_alike(own, changed)) and r["near_next"] == pytest.approx(_alike(own, other))


def test_syncmers_repeated_ids(spark):
    rows = syncmers.edited(_docs(spark, ["a b c d e f g h", "b b b b", "b b b b", "c c c c c c c c", None], [1, 2, 2, 2, None])).collect()
    assert len(rows) == 5 and {r["near_next"] for r in rows if r["doc_id"] is None} == {0.0}
    first = min(["b b b b", "c c c c c c c c"], key=lambda t: hashlib.md5(t.encode()).digest())
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["edited_sha256"] == hashlib.sha256(("a b c d e f g h"[:12] + first[:3]).encode()).hexdigest()


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(11)
    core = _prose(rng, 80)
    df = spark.createDataFrame([(core,), (f"{_prose(rng, 9)} {core} {_prose(rng, 5)}",)], "text string")
    a, b = (r["anchors"] for r in syncmers.with_anchors(df, "text", "anchors").collect())
    there = {x["hash"]: x["position"] for x in b}
    assert len(a) > 20 and all(there[x["hash"]] == x["position"] + 9 for x in a)


def test_language_model_counts(spark):
    rng = random.Random(12)
    texts = [_prose(rng, rng.randint(0, 80)) for _ in range(120)] + [None, "", "NEW Alpha1 x"]
    rows = {r["doc_id"]: r for r in maxent.scored(_docs(spark, texts)).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    learn = [k for k in tokens if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in learn for w in tokens[k])
    n, v = c.total(), len(c)
    for k, ws in tokens.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k not in learn, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-9)
        assert r["score"] < 0


def test_language_model_learns_order(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(300):
        at, out = rng.randrange(12), []
        for _ in range(40):
            out.append(WORDS[at])
            at = (at + rng.choice([1, 1, 1, 5])) % 12
        texts.append(" ".join(out))
    rows = maxent.scored(_docs(spark, texts)).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.7 * sum(r["base_score"] for r in rows)


def test_model_is_a_distribution():
    """Over a tiny vocabulary the probabilities of all words, the rest and one unknown word sum to one."""
    common = [(k + 1, 50 - k) for k in range(20)]
    m = maxent.vocabulary(common, sum(n for _, n in common) + 30, 26)
    rng = np.random.default_rng(1)
    m.weights[:] = rng.normal(size=m.weights.shape)
    one, two = np.array([3]), np.array([5])
    inside = np.zeros(len(m.of))
    for k in range(maxent.CLASSES):
        members = np.flatnonzero(m.of[:-1] == k)
        if len(members):
            x = rng.random(len(members))
            inside[members] = x / x.sum()
    p = np.exp(m.classes(one, two))[0]
    used = np.unique(m.of[:-1])
    assert p.sum() == pytest.approx(1, abs=1e-5)
    assert sum(p[m.of[w]] * inside[w] for w in range(len(m.of) - 1)) == pytest.approx(p[used].sum(), abs=1e-5)
    rest_known = m.known - len(m.hashes)
    counts = [5] * rest_known
    z = m.rest_tokens + 0.5 * (rest_known + 1)
    assert (sum(c + 0.5 for c in counts) + 0.5) / z == pytest.approx(1)


def _simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(25):
        base = _prose(rng, 120).split()
        for _ in range(rng.randint(1, 5)):
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
    texts += [None, "", " ", texts[0], texts[0].upper()]
    fps = [_simhash(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    rows = {r["doc_id"]: r for r in simhash.simhash_components(_docs(spark, texts)).collect()}
    assert [rows[k]["fp"] & (1 << 64) - 1 for k in range(len(texts))] == fps
    assert [rows[k]["component_id"] for k in range(len(texts))] == root


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(15)
    a = rng.integers(0, 1 << 63, 2000, np.uint64)
    b = a ^ (rng.integers(0, 1 << 63, 2000, np.uint64) & rng.integers(0, 1 << 63, 2000, np.uint64) & rng.integers(0, 1 << 63, 2000, np.uint64) & rng.integers(0, 1 << 63, 2000, np.uint64))
    assert (simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b)) <= np.bitwise_count(a ^ b)).all()
    for n in (1, 10**6, 10**12):
        g = simhash.groups_for(n)
        masks = simhash.masks(g)
        near = a ^ np.uint64(0b1000000010000000100000001)
        assert all(any((int(x) & m) == (int(y) & m) for m in masks) for x, y in zip(simhash.popcounts(a[:50]), simhash.popcounts(near[:50]), strict=True))


def test_licenses_against_brute_force(spark):
    import re

    rng = random.Random(16)
    bits = ["under the MIT license", "Under-The mit License", "Apache License, Version 2.0", "CC BY-NC", "cc by nc nd 4.0", "words", "é under", "GPL version 3", "under the mit licensed", "SPDX-License-Identifier: BSD-3-Clause"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, "", "cc by nc cc by nc"]
    for r in licenses.licenses(_docs(spark, texts)).collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        at = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE}
        every = sorted(k for x in at.values() for k in x)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(every), every[0] if every else None, every[-1] if every else None)
        assert r["base_labels"] == ",".join(sorted(x for x, k in at.items() if k))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules():
    assert sum(len(some) for _, some in licenses.rules()) > 200
    label = lambda t: licenses.scan(t.encode())[5]
    assert label("Licensed under CC BY-NC-SA 4.0") == "cc-by-nc,cc-by-nc-sa"
    assert label("SPDX-License-Identifier: GPL-3.0-or-later") == "gpl-3"
    assert label("This program is licensed under the GNU General Public License, version 2") == "gpl-2"
    assert label("nothing about it") == ""
