"""Operator 7, toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the gapped letter triples that both hold, the products of their weights (DECAY for
each letter skipped), and is normalised. Marks between letters are no letters, so `id-i.ot` is `idiot`; single letters
in a row are one word, so `i d i o t` is as well; an inserted letter leaves most triples as they are. The machine is
trained on labelled sentences, a sentence being the kernel map of its worst word under the machine fitted so far (a latent
support vector machine). A linear function of kernels with landmarks is one weight for each triple, so a text is scored
by table look-ups over its bytes; a document's score is that of its worst word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, give_back, id_crc, prepare, slices, table

#: Labelled documents that the model is fitted on at most, and the bytes of their texts (toxic, clean).
TOXIC, CLEAN, TOXIC_BYTES, CLEAN_BYTES = 2000, 4000, 4 << 20, 8 << 20
LANDMARKS, DECAY, COST, MILD = 320, 0.6, 20.0, 3000
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2))
SPACE = 31
FLOOR = -2.0  # the decision of a text without words

_LATIN1 = {0x9F: "s", 0xA6: "a", 0xA7: "c", 0xB0: "d", 0xB1: "n", 0xB0 - 0x20: "d"} | {0xA0 + k: "a" for k in range(6)} | {0xA8 + k: "e" for k in range(4)} | {0xAC + k: "i" for k in range(4)} | {0xB2 + k: "o" for k in range(5)} | {0xB8: "o"} | {0xB9 + k: "u" for k in range(4)} | {0xBD: "y", 0xBF: "y"}


def _classes() -> np.ndarray:
    """Byte -> 1 to 26 for letters (accents dropped, digits that stand for letters too), SPACE, or 0 for what is skipped."""
    c = np.zeros(256, np.uint8)
    for b in range(128):
        ch = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a"}.get(chr(b), chr(b).lower())
        c[b] = ord(ch) - 96 if "a" <= ch <= "z" else SPACE if b in b" \t\n\v\f\r" else 0
    for b in range(128, 192):  # the second byte of a Latin-1 letter; other scripts get some letter each
        ch = _LATIN1.get(b, _LATIN1.get(b + 32))
        c[b] = ord(ch) - 96 if ch else 1 + b % 26
    return c


CLASS = _classes()
TO_LETTERS = bytes(32 if x == SPACE else 96 + x if x else 0 for x in CLASS.tolist())
SKIPPED = bytes(b for b in range(256) if CLASS[b] == 0)
SENTENCE = re.compile(rb"[.!?]\s+|[\r\n]+")
SPACED = re.compile(rb"(?:(?<= )|^)[a-z](?: [a-z])+(?= |$)")


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all rows with a space before each row; word of each letter (a space belongs to the word after it); row of each word."""
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    c = np.full(n + rows, SPACE, np.uint8)
    c[np.arange(n) + row + 1] = CLASS[data]
    at = np.zeros(n + rows, np.int32)
    at[np.arange(n) + row + 1] = row
    at[offsets[:-1] + np.arange(rows)] = np.arange(rows)
    keep = c != 0
    c, at = c[keep], at[keep]
    space = np.flatnonzero(c == SPACE)
    single = np.diff(np.r_[space, len(c)]) == 2
    if both := np.flatnonzero(single[1:] & single[:-1] & (at[space[1:]] == at[space[:-1]])).tolist():
        keep = np.ones(len(c), bool)
        keep[space[1:][both]] = False  # single letters in a row are one word
        c, at = c[keep], at[keep]
    space = c == SPACE
    return c, np.cumsum(space, dtype=np.int32) - 1, at[space]


def triples(c: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(code, word, weight) of the gapped triples inside words, for each pair of gaps."""
    x = c.astype(np.int32)
    for g, h in GAPS:
        n = len(x) - g - h
        if n <= 0:
            continue
        inside = word[:n] == word[g + h :]
        yield ((x[:n] << 10) | (x[g : g + n] << 5) | x[g + h :])[inside], word[:n][inside], DECAY ** (g + h - 2)


def lengths(word: np.ndarray, words: int) -> np.ndarray:
    """Root of the kernel of each word with itself, counting each of its triples once; 1 for a word without any."""
    size = np.bincount(word, minlength=words)
    own = sum(DECAY ** (2 * (g + h - 2)) * np.maximum(size - g - h, 0) for g, h in GAPS)
    return np.sqrt(np.maximum(own, 1.0))


@dataclass
class ToxicityModel:
    """decision of a word = weights over its triples / its length + bias; probability of a text = sigmoid(slope * worst + shift)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << 15))
    bias: float = FLOOR
    slope: float = 0.0
    shift: float = 0.0

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(decision, row) of every word."""
        c, word, row = stream(data, offsets)
        total = np.zeros(len(row))
        for code, at, weight in triples(c, word):
            total += weight * np.bincount(at, weights=self.weights[code], minlength=len(row))
        return total / lengths(word, len(row)) + self.bias, row

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, FLOOR)
        decision, row = self.words(data, offsets)
        np.maximum.at(out, row, decision)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words)])


def _maps(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The explicit, normalised feature vectors of a few words, and the row of each triple: triples of theirs (and a row of zeros) x words."""
    c, word, row = stream(*_packed(words))
    found = list(triples(c, word))
    codes = np.unique(np.concatenate([code for code, _, _ in found]))
    place = np.full(1 << 15, len(codes), np.int32)
    place[codes] = np.arange(len(codes))
    out = np.zeros((len(codes) + 1, len(words)), np.float32)
    for code, at, weight in found:
        np.add.at(out, (place[code], row[at]), weight)
    out /= np.maximum(np.linalg.norm(out, axis=0), 1e-9)
    return out, place


def _decisions(model: ToxicityModel, words: list[str], most: int = 20000) -> np.ndarray:
    """The decision of each word, some at a time."""
    return np.concatenate([model.worst(*_packed(words[k : k + most])) for k in range(0, len(words), most)]) if words else np.zeros(0)


def _kernels(words: list[str], by_code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark (columns of by_code)."""
    marks = by_code.shape[1]
    out = np.zeros((len(words), marks))
    for k in range(0, len(words), 2000):
        c, word, row = stream(*_packed(words[k : k + 2000]))
        part = np.zeros((len(row), marks))
        for code, at, weight in triples(c, word):
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                part[at[first]] += weight * np.add.reduceat(by_code[place[code]], first, axis=0)
        out[k + row] = part / lengths(word, len(row))[:, None]
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows; the last weight is the bias."""
    x = np.c_[z, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(np.eye(len(w)) / cost + a.T @ x[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _tested(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """G statistic of a among a + b against share p; 0 where the share is smaller."""
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (n * p)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - p))), 0))
    return np.where(a > n * p, g, 0)


def _parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, word) of the parts of words: the whole, and any 4 to 6 letters of it with its start marked. Codes are exact but for the whole's."""
    data, offsets = _packed(words)
    c = np.insert(data & 31, offsets[:-1], 27).astype(np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(offsets) + 1)
    code, owner = [np.array([xxhash.xxh64_intdigest(w.encode()) >> 2 for w in words], np.int64)], [np.arange(len(words), dtype=np.int32)]
    for n in (4, 5, 6):
        m = len(c) - n + 1
        if m > 0:
            inside = word[:m] == word[n - 1 :]
            code.append((sum(c[k : k + m] << 5 * (n - 1 - k) for k in range(n)) | np.int64(n) << 32)[inside])
            owner.append(word[:m][inside])
    return np.concatenate(code), np.concatenate(owner)


def _rows_of(starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The places starts[k] to starts[k + 1] of each k of some, one after another."""
    size = starts[some + 1] - starts[some]
    return np.arange(size.sum()) + np.repeat(starts[some] - (np.cumsum(size) - size), size)


def telling_words(words: list[str], toxic_docs: list[np.ndarray], clean: np.ndarray) -> list[int]:
    """Words (as places in words) of toxic documents that hold a part which clean ones hardly hold, most documents first.

    toxic_docs: the distinct words of each toxic document; clean: how many clean documents hold a word. A part must be in
    more toxic documents than chance explains, given how many parts are tried, by words that no better part accounts for;
    so what merely stands beside an insult is not taken for one. A word may be in a few clean documents too.
    """
    bad_docs = np.bincount(np.concatenate(toxic_docs), minlength=len(words))
    own = np.flatnonzero(bad_docs)
    code, owner = _parts([words[k] for k in own])
    order = np.argsort(owner, kind="stable")
    code, starts = code[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(own)))]
    place = np.full(len(words), -1)
    place[own] = np.arange(len(own))
    # a first pass over hashed parts tells which may be in more than 3 documents, so that the rest are never held
    rough, mask, each = np.zeros(1 << 22, np.int32), (1 << 22) - 1, []
    mixed = lambda x: (x * 0x9E3779B1 >> 7) & mask
    for ws in toxic_docs:
        rough[np.unique(mixed(code[_rows_of(starts, place[ws])]))] += 1
    for ws in toxic_docs:
        x = np.unique(code[_rows_of(starts, place[ws])])
        each.append(x[rough[mixed(x)] > 3])
    names, a = np.unique(np.concatenate(each), return_counts=True)
    names, a = names[a > 3], a[a > 3].astype(float)
    del each, rough
    if not len(names):
        return []
    b, held = np.zeros(len(names)), np.flatnonzero(clean)
    for k in range(0, len(held), 10000):
        some = held[k : k + 10000]
        x, o = _parts([words[i] for i in some])
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        pair = np.unique((o.astype(np.int64) * len(names) + at)[names[at] == x])
        np.add.at(b, pair % len(names), clean[some[pair // len(names)]])
    share = bad_docs.sum() / (bad_docs.sum() + clean.sum())
    bar = 2 * np.log(max(2, len(names))) + 2
    g = _tested(a, b, share)
    pure = np.flatnonzero((g > bar) & (b * share <= 0.02 * a))
    pure = pure[np.lexsort((names[pure], -g[pure]))]
    fine = clean[own] * share <= 0.005 * bad_docs[own]
    owner = np.sort(owner)
    of = {p: sorted({int(k) for k in owner[code == names[p]] if fine[k]}) for p in pure.tolist()}
    where: dict[int, set[int]] = {k: set() for ks in of.values() for k in ks}
    for d, ws in enumerate(toxic_docs):
        for k in place[ws].tolist():
            if k in where:
                where[k].add(d)
    bad: dict[int, None] = {}
    for p in pure.tolist():
        left = [k for k in of[p] if k not in bad]
        n = len(set().union(*(where[k] for k in left)))
        if n and _tested(np.array([n], float), b[p : p + 1], share)[0] > bar and b[p] * share <= 0.02 * n:
            bad |= dict.fromkeys(left)
    return [int(own[k]) for k in sorted(bad, key=lambda k: (-len(where[k]), words[own[k]]))]


class _Sentences:
    """Labelled sentences as their words, numbered by first appearance; one that both kinds hold is a clean one.

    clean, toxic: words of all sentences one after another, and where each sentence starts; docs: distinct words of each
    toxic document. A document of which under half the sentences are new among its kind is a copy and counts no more.
    """

    def __init__(self, texts: pa.Array, toxic: list[int]) -> None:
        number: dict[str, int] = {}
        self.flat, self.starts = (array("i"), array("i")), (array("q", [0]), array("q", [0]))
        self.docs: list[np.ndarray] = []
        clean_docs, seen = array("i"), (set(), set())
        for k in np.argsort(np.array(toxic), kind="stable").tolist():
            y = toxic[k]
            own = {xxhash.xxh64_intdigest(x): x for x in (s.translate(TO_LETTERS, SKIPPED) for s in SENTENCE.split(texts[k].as_py().encode()))}
            fresh = sum(h not in seen[y] for h in own)
            new = [x for h, x in own.items() if h not in seen[0]]  # an insult may stand in many documents word for word
            seen[y].update(own)
            if 2 * fresh <= len(own):
                continue
            words: set[int] = set()
            for x in new:
                ids = {number.setdefault(w, len(number)) for w in SPACED.sub(lambda m: m[0].replace(b" ", b""), x).decode("ascii").split() if len(w) > 2}
                if ids:
                    words |= ids
                    self.flat[y].extend(sorted(ids))
                    self.starts[y].append(len(self.flat[y]))
            if y and words:
                self.docs.append(np.array(sorted(words), np.int32))
            elif words:
                clean_docs.extend(words)
        self.words = list(number)
        self.clean_docs = np.bincount(np.array(clean_docs, np.int64), minlength=len(number))

    def witnesses(self, y: int, decision: np.ndarray) -> np.ndarray:
        """The worst words of the sentences of one kind, each once; ties: the word seen first."""
        flat, starts = np.asarray(self.flat[y]), np.asarray(self.starts[y])
        if len(starts) < 2:
            return np.zeros(0, np.int64)
        worst = np.maximum.reduceat(decision[flat], starts[:-1])
        hit = np.flatnonzero(decision[flat] == np.repeat(worst, np.diff(starts)))
        first = hit[np.searchsorted(hit, starts[:-1])]
        return np.unique(flat[first])


def fit(texts: pa.Array, toxic: list[int], rounds: int = 6) -> ToxicityModel:
    """Learn from labelled documents, whose sentences bear their label; a sentence that both kinds hold is a clean one.

    Which sentences of a toxic document are toxic is not labelled: those that hold a telling word are. Each round, every
    toxic and every clean sentence is the kernel map of its worst word, and the machine is fitted on them all: equal maps
    count once, so that repeated sentences weigh nothing, both labels weigh the same, and of the clean sentences those are
    held that were within the margin in some round (the others' loss is zero), MILD more a round at most. Clean sentences whose worst word is a telling one are taken for mislabelled. It ends
    when no worst word changes any more, or after some rounds. No toxic or no clean sentence: every text has the share of
    label 1.
    """
    model = ToxicityModel(shift=float(np.log((sum(toxic) + 1) / (len(toxic) - sum(toxic) + 1)) if toxic else -2))
    s = _Sentences(texts, toxic)
    if not s.docs or not s.clean_docs.any() or not (bad := telling_words(s.words, s.docs, s.clean_docs)):
        return model
    words = s.words
    good = np.setdiff1d(np.flatnonzero(s.clean_docs), bad)
    often = good[np.lexsort((good, -s.clean_docs[good]))]
    spread = np.random.default_rng(7).permutation(often)
    telling = np.zeros(len(words), bool)
    telling[bad] = True
    # the first decision of a word is its mean kernel with the telling words
    m, place = _maps([words[k] for k in bad[:LANDMARKS]])
    model.weights, model.bias = m.mean(axis=1)[place], 0.0
    decision, mild, known = _decisions(model, words), np.zeros(0, np.int64), None
    for _ in range(rounds):
        clean, ill = (s.witnesses(y, np.where(telling == y, decision, -np.inf)) for y in (0, 1))
        clean, ill = clean[~telling[clean]], ill[telling[ill]]
        now = np.r_[ill, -1 - clean]
        if known is not None and np.array_equal(known, now):
            break
        known = now
        clean = clean[np.argsort(-decision[clean], kind="stable")[:MILD]]
        mild = np.unique(np.r_[mild, clean if not len(mild) else clean[decision[clean] > -1]])
        hard = mild[np.argsort(-decision[mild], kind="stable")[: LANDMARKS // 4]]
        marks = dict.fromkeys([*bad[: LANDMARKS // 2], *hard.tolist(), *spread.tolist()])
        m, place = _maps([words[k] for k in list(marks)[:LANDMARKS]])
        values, vectors = np.linalg.eigh((m.T @ m).astype(np.float64))
        some = values > 1e-6 * values.max()
        root = vectors[:, some] / np.sqrt(values[some])
        z = _kernels([words[k] for k in np.r_[ill, mild]], m, place) @ root
        y = np.r_[np.ones(len(ill)), -np.ones(len(mild))]
        w = _svm(z, y, np.r_[np.full(len(ill), 2000 / len(ill)), np.full(len(mild), 2000 / len(mild))])
        model.weights, model.bias = (m @ (root @ w[:-1]))[place], float(w[-1])
        decision = _decisions(model, words)
    # the threshold lies between the worst clean word and the mildest bad one; the slope is a logistic regression's
    middle = min(0.35, max(0.0, (float(decision[good].max(initial=0.0)) + float(decision[bad].min())) / 2))
    del s, words
    y = np.array(toxic)
    x = np.concatenate([model.worst(d, o) for _, _, d, o in slices(texts)]) - middle
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight, slope = np.where(y == 1, 1 / n1, 1 / n0) * len(y) / 2, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        step = ((weight * x * (p - t)).sum() + 0.01 * slope) / ((weight * x * x * p * (1 - p)).sum() + 0.01)
        slope = max(0.5, slope - step)
        if abs(step) < 1e-6:
            break
    model.slope, model.shift = slope, -slope * middle
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, list[int]]:
    """At most about TOXIC and CLEAN labelled documents (remainder not 0), chosen by a hash of the id, whole texts.

    Of these, in the order of a hash, as many as have TOXIC_BYTES and CLEAN_BYTES of text at most. Null ids, texts and
    labels are left out; several labels of an id count as their largest. Only the two counts, the sizes of the sampled rows
    and the texts chosen come to the driver; the sampled labels are broadcast, their number being bounded.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(id_crc() % 5 != 0).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC / max(1, counts.get(1, 0)))).otherwise(min(1.0, CLEAN / max(1, counts.get(0, 0))))
    chosen = known.where(unit < share).select(F.col("doc_id").alias("labelled_id"), "toxic")
    few = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = cut(few.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "toxic", "text", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("bytes")))
    sizes, ends = rows.select("h", "toxic", "bytes").orderBy("h").toArrow().to_pydict(), {}
    held = {0: 0, 1: 0}
    for h, toxic, size in zip(*sizes.values(), strict=True):
        held[toxic] += size
        if held[toxic] > (TOXIC_BYTES if toxic else CLEAN_BYTES):
            ends.setdefault(toxic, h)
    if ends:
        rows = rows.where(F.coalesce(*[F.when(F.col("toxic") == y, F.col("h") < h) for y, h in ends.items()], F.lit(True)))
    found = rows.select("text", "toxic", "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    texts = found.column("text")
    return texts.chunk(0) if texts.num_chunks else pa.array([], pa.string()), found.column("toxic").to_pylist()


def scored(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """docs with the column `name`: the probability of label 1, from the whole text alone; null and empty texts too.

    If docs has a column called so, it keeps its name, and the new one gets underscores before its.
    """
    held, kept, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns, free_name(docs, name)
    text = next(k for k, c in enumerate(kept) if c == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            worst = np.full(b.num_rows, FLOOR)
            for lo, hi, data, offsets in slices(b.column(text)):
                worst[lo:hi] = model.worst(data, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(worst))], [*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double")


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of a bounded sample, fitted on the driver, which gives the memory back afterwards."""
    model = fit(*sample(docs, labels))
    give_back()
    return model


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = scored(docs, learn(docs, table(spark, sf_dir, "labels")), "score")
    return found.select("doc_id", (F.coalesce(id_crc() % 5, F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5; the columns stay as they are, whatever they are called besides doc_id and text."""
    prepare(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[n if n in ("doc_id", "text") else f"c{k}__{n}" for k, n in enumerate(names)])
    return scored(plain, learn(plain, labels)).where("toxicity < 0.5").select(*plain.columns).toDF(*names)
