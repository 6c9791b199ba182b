"""Operator 8, LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

Documents are packed once into blocks: token sequences over a block's own dictionary of 64-bit word hashes. Counts of all
training tokens come from one exchange of the dictionaries, dealt by hash, and go back to the blocks that asked. The
commonest words are the model's vocabulary, in CLASSES classes; the rest is one class, inside which a word has its
smoothed count. The class weights are trained by gradient updates: every round, blocks send what the model expects of
each feature and class, and the sums move the weights. A word inside its class is weighed by the class before it.
"""

from __future__ import annotations

import secrets
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, id_crc, prepare, shared_dir, table, texts_of

#: Bytes of text in a block, dictionary entries in a shard, and tasks that send sums in a round at most.
BLOCK_BYTES, SHARD_ENTRIES, TASKS = 8 << 20, 1 << 20, 1024
#: Least share of the tokens that a word of the vocabulary has, classes with that of the rest.
LEAST_SHARE, CLASSES = 2e-5, 64
#: Words of the vocabulary and buckets of word pairs: GROWTH times the cube root of the training tokens, and LEAST_SIZE at least.
GROWTH, LEAST_SIZE = 16, 4096
ROUNDS, STEP, PRIOR = 5, 0.6, 4.0
SLICES = 16
END = xxhash.xxh64_intdigest(b"\n")  # no word has a line feed
#: Contexts that are scored at once.
CHUNK = 1 << 13


def size_for(tokens: int, growth: float = GROWTH) -> int:
    """Words of the vocabulary, and buckets of pairs, for so many training tokens; a quarter as many buckets are for words as features."""
    return max(LEAST_SIZE, int(growth * tokens ** (1 / 3)))



def _packed(x: np.ndarray) -> bytes:
    """An array of numbers, the first bytes of all before the second ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


BLOCKS = "block long, ids binary, nulls binary, train binary, offsets binary, tokens binary, hashes binary, trained binary, entries long, train_tokens long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> blocks: token numbers by falling frequency, the words' hashes, and their counts in training documents."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def close() -> pa.RecordBatch:
        seq = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        counts = np.bincount(seq, minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        learn = np.array(train, bool)
        tokens = number[seq]
        trained = np.bincount(tokens[np.repeat(learn, np.diff(np.r_[0, ends]))], minlength=len(order)).astype(np.uint32)
        hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[order]
        row = [secrets.randbits(62), _packed(np.array([i or 0 for i in ids], np.int64)), _packed(np.array([i is None for i in ids], np.uint8)), _packed(learn.view(np.uint8)), _packed(ends.astype(np.int64)), _packed(tokens), _packed(hashes), _packed(trained), len(words), int(trained.sum())]
        kinds = [pa.int64(), *[pa.binary()] * 7, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    def new() -> tuple[dict, list, list, list]:
        own: dict = defaultdict()
        own.default_factory = own.__len__
        return own, [], [], []

    words, parts, ids, train = new()
    size = 0
    for b in batches:
        for text, i, learn in zip(texts_of(b.column("text")), b.column("doc_id").to_pylist(), b.column("train").to_pylist(), strict=True):
            parts.append(np.fromiter(map(words.__getitem__, [*text.translate(LOWER).split(), None]), np.uint32))
            ids.append(i)
            train.append(bool(learn))
            size += len(text) + 8
            if size >= BLOCK_BYTES:
                yield close()
                words, parts, ids, train = new()
                size = 0
    if parts:
        yield close()


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: equal ranges of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def counted(blocks: DataFrame, shards: int, least: int) -> DataFrame:
    """(block, shard, counts, known, common_hashes, common_counts): for each block's words, in the order of their hashes, their counts in all training documents.

    Dictionaries are dealt by shard; a word is in a block's dictionary once, so a common word meets once for each block.
    known: words with a count and common words (count >= least) are told on the shard's first row.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw, trained in zip(b.column("block").to_pylist(), b.column("hashes").to_pylist(), b.column("trained").to_pylist(), strict=True):
                h, n = _unpacked(raw, np.uint64), _unpacked(trained, np.uint32)
                order = np.argsort(h)
                h, n = h[order], n[order]
                at = np.searchsorted(_shard(h, shards), np.arange(shards + 1))
                some = np.flatnonzero(np.diff(at)).tolist()
                columns = [[block] * len(some), some, [h[at[s] : at[s + 1]].tobytes() for s in some], [_packed(n[at[s] : at[s + 1]]) for s in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "shard", "hashes", "trained"])

    def answer(group: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        sizes = [len(x) for x in h]
        distinct, at = np.unique(np.concatenate(h), return_inverse=True)
        n = np.concatenate([_unpacked(x, np.uint32) for x in group["trained"].to_pylist()])
        total = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
        many = np.flatnonzero(total >= least)
        ends = np.cumsum(sizes)
        rows = len(sizes)
        first = lambda x: [x] + [None] * (rows - 1)
        return pa.table({
            "block": group["block"], "shard": group["shard"], "counts": pa.array([_packed(total[at[e - s : e]]) for s, e in zip(sizes, ends, strict=True)], pa.binary()),
            "known": pa.array(first(int((total > 0).sum())), pa.int64()), "common_hashes": pa.array(first(distinct[many].view(np.int64).tolist()), pa.list_(pa.int64())), "common_counts": pa.array(first(total[many].tolist()), pa.list_(pa.int64())),
        })

    asked = blocks.select("block", "hashes", "trained").mapInArrow(ask, "block long, shard int, hashes binary, trained binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard int, counts binary, known long, common_hashes array<long>, common_counts array<long>")


@dataclass
class Model:
    """hashes (sorted) and numbers of the vocabulary; of: class of each number; weights: features x classes; inside: class before x number, log10."""

    hashes: np.ndarray
    numbers: np.ndarray
    of: np.ndarray
    weights: np.ndarray
    inside: np.ndarray
    tokens: int = 0
    known: int = 0
    rest_tokens: int = 0
    pairs: int = LEAST_SIZE

    @property
    def words(self) -> int:
        """Buckets of words as features; the first three quarters are the commonest words' own."""
        return self.pairs // 4

    @property
    def rows(self) -> int:
        """Rows of the weights: the bias, words before, skipped-to words, pairs."""
        return 1 + 2 * self.words + self.pairs

    @property
    def start(self) -> int:
        return len(self.of) - 1

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word: 1, 2, ... in the vocabulary, 0 for the rest."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def contexts(self, w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token and the one before that; `start` at a document's beginning."""
        starts = np.r_[0, ends[:-1]]
        one, two = np.r_[self.start, w[:-1]], np.r_[self.start, self.start, w[:-2]][: len(w)]
        one[starts] = two[starts] = self.start
        second = starts + 1
        second = second[second < ends]
        two[second] = self.start
        return one, two

    def features(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the weights: the word before, the skipped-to word, the pair; besides the bias in row 0."""
        exact = self.words * 3 // 4
        bucket = lambda w: np.where(w < exact, w, exact + w % (self.words - exact))
        pair = ((two * 40503 + one) * 2654435761 >> 8) % self.pairs
        return 1 + bucket(one), 1 + self.words + bucket(two), 1 + 2 * self.words + pair

    def _centred(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What the features of each context give each class, less the largest."""
        a, b, c = self.features(one, two)
        z = self.weights[a]
        for x in (self.weights[b], self.weights[c], self.weights[0]):
            z += x
        z -= z.max(axis=1, keepdims=True)
        return z

    def classes(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the classes in each context."""
        z = self._centred(one, two)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def shares(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Probabilities of the classes in each context."""
        z = self._centred(one, two)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z


def _unique(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts (word before, word before that) and which each token has."""
    code, at = np.unique(two.astype(np.int64) << 32 | one, return_inverse=True)
    return code & 0xFFFFFFFF, code >> 32, at


def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, sorted first so that each row is summed at once."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
    out[rows[order][first]] += np.add.reduceat(values[order], first, axis=0)


def vocabulary(common: list[tuple[int, int]], tokens: int, known: int, growth: float = GROWTH) -> Model:
    """The untrained model over the commonest words (ties: smaller hash); classes share the vocabulary's root counts evenly."""
    top = sorted(common, key=lambda x: (-x[1], x[0] & (1 << 64) - 1))[: size_for(tokens, growth) - 1]
    counts = np.array([n for _, n in top], np.float64)
    share = np.cumsum(np.sqrt(counts)) / max(np.sqrt(counts).sum(), 1)
    of = np.r_[0, 1 + np.minimum((share * (CLASSES - 1)).astype(np.int64), CLASSES - 2), 0]
    hashes = np.array([h & (1 << 64) - 1 for h, _ in top], np.uint64)
    order = np.argsort(hashes)
    return Model(hashes[order], 1 + order, of, np.zeros((1 + 2 * (size_for(tokens, growth) // 4) + size_for(tokens, growth), CLASSES), np.float32), np.zeros((CLASSES, len(of)), np.float32), tokens, known, tokens - int(counts.sum()), size_for(tokens, growth))


def _sums(blocks: DataFrame, model: Model, observed: bool) -> np.ndarray:
    """Over all training tokens: what the model expects of each feature and class, or, if `observed`, what there is, and then the pairs of class and next word."""
    held = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total = np.zeros((m.rows, CLASSES))
        pairs = np.zeros((CLASSES, len(m.of)))
        for b in batches:
            for tokens, hashes, train, offsets in zip(*(b.column(c).to_pylist() for c in ("tokens", "hashes", "train", "offsets")), strict=True):
                w, ends = m.place(_unpacked(hashes, np.uint64))[_unpacked(tokens, np.uint32)], _unpacked(offsets, np.int64)
                one, two = m.contexts(w, ends)
                learn = np.repeat(_unpacked(train, np.uint8) > 0, np.diff(np.r_[0, ends]))
                w, one, two = w[learn], one[learn], two[learn]
                if not len(w):
                    continue
                u1, u2, at = _unique(one, two)
                step, times = 1 << 16 if observed else CHUNK, np.bincount(at, minlength=len(u1)).astype(np.float32)
                for lo in range(0, len(u1), step):
                    s = slice(lo, lo + step)
                    if observed:
                        here = (at >= s.start) & (at < s.stop)
                        own = np.bincount((at[here] - lo) * CLASSES + m.of[w[here]], minlength=len(u1[s]) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
                    else:
                        own = m.shares(u1[s], u2[s])
                        own *= times[s, None]
                    for rows in m.features(u1[s], u2[s]):
                        _scatter(total, rows, own)
                    total[0] += own.sum(axis=0)
                if observed:
                    pairs += np.bincount(m.of[one] * len(m.of) + w, minlength=pairs.size).reshape(pairs.shape)
        flat = np.concatenate([total.ravel(), pairs.ravel()] if observed else [total.ravel()]).astype(np.float32)
        if flat.any():
            parts = np.array_split(flat, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slice", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total: np.ndarray | float = 0.0
        for x in group["sums"].to_pylist():
            total = total + np.frombuffer(zstandard.decompress(x), np.float32).astype(np.float64)
        return pa.table({"slice": group["slice"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    few = blocks.select("tokens", "hashes", "train", "offsets").coalesce(TASKS)
    rows = few.mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()
    size = model.rows * CLASSES + (CLASSES * len(model.of) if observed else 0)
    return np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(size)


def trained(blocks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Gradient updates of the class weights, each scaled by what is there and expected; the words inside classes in closed form."""
    sums = _sums(blocks, model, True)
    there, pairs = sums[: model.rows * CLASSES].reshape(-1, CLASSES), sums[model.rows * CLASSES :].reshape(CLASSES, -1)
    if there.any():
        bias = np.log(there[0] + 0.5)
        model.weights[0] = bias - bias.max()
    # P(word | class, class before) = (pairs + PRIOR * P(word | class)) / (their sum in the class + PRIOR)
    whole = pairs.sum(axis=0) + 0.5
    share = whole / np.bincount(model.of, weights=whole, minlength=CLASSES)[model.of]
    by_class = np.stack([np.bincount(model.of, weights=p, minlength=CLASSES) for p in pairs])
    model.inside = np.log10((pairs + PRIOR * share) / (by_class[:, model.of] + PRIOR)).astype(np.float32)
    for _ in range(rounds if there.any() else 0):
        expected = _sums(blocks, model, False).reshape(-1, CLASSES)
        gradient = there - expected
        model.weights += (STEP * 2 * gradient / (there + expected + PRIOR)).astype(np.float32)
    return model


def scored(docs: DataFrame, growth: float = GROWTH, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    Null and empty texts are one end token. A null id is trained on. Repeated rows count as often as they are there. If
    nothing is trained on, every token is unknown. The vocabulary and the feature buckets grow as the cube root of the
    training tokens, times `growth`; `rounds` are the gradient updates. Empty input: empty result. Other columns are ignored. Words are told
    apart by 64-bit hashes. Blocks, counts and answers are written to the shared folder and read from there.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    crc = F.coalesce(id_crc() % 5, F.lit(0))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", (crc != 1).alias("train"))
    given.mapInArrow(_blocks, BLOCKS).write.parquet(f"{base}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{base}/blocks")
    size = blocks.agg(F.sum("entries").alias("entries"), F.sum("train_tokens").alias("tokens")).first()
    entries, tokens = int(size["entries"] or 0), int(size["tokens"] or 0)
    counted(blocks, max(8, -(-entries // SHARD_ENTRIES)), max(2, int(LEAST_SHARE * tokens))).write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    known = counts.agg(F.sum("known")).first()[0] or 0
    # words with LEAST_SHARE of the tokens: 1 / LEAST_SHARE at most
    common = counts.where("known IS NOT NULL").select(F.explode(F.arrays_zip("common_hashes", "common_counts")).alias("x")).select("x.*").collect()
    model = trained(blocks, vocabulary([(r["common_hashes"], r["common_counts"]) for r in common], tokens, int(known), growth), rounds)
    held = spark.sparkContext.broadcast(model)
    answers = counts.groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        rest_known = m.known - len(m.hashes)
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in ("ids", "nulls", "train", "offsets", "tokens", "hashes", "answers")}
                tokens, hashes, ends = _unpacked(r["tokens"], np.uint32), _unpacked(r["hashes"], np.uint64), _unpacked(r["offsets"], np.int64)
                count = np.empty(len(hashes), np.int64)
                count[np.argsort(hashes)] = np.concatenate([_unpacked(x["counts"], np.int64) for x in r["answers"]])
                number = m.place(hashes)
                w = number[tokens]
                one, two = m.contexts(w, ends)
                u1, u2, at = _unique(one, two)
                own, score = m.of[w], np.empty(len(w))
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(0, len(u1) + CHUNK, CHUNK))
                for j, lo in enumerate(range(0, len(u1), CHUNK)):
                    p, here = m.classes(u1[lo : lo + CHUNK], u2[lo : lo + CHUNK]), order[edges[j] : edges[j + 1]]
                    score[here] = p[at[here] - lo, own[here]] / np.log(10)
                rare = np.log10((count + 0.5) / (m.rest_tokens + 0.5 * (rest_known + 1)))
                score += np.where(w > 0, m.inside[m.of[one], w], rare[tokens])
                plain = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.known + 1)))[tokens]
                starts = np.r_[0, ends[:-1]]
                sums = [np.add.reduceat(x, starts) for x in ((count > 0)[tokens].astype(np.int64), plain, score)]
                ids = pa.array(_unpacked(r["ids"], np.int64), mask=_unpacked(r["nulls"], np.uint8) > 0)
                columns = [ids, pa.array(_unpacked(r["train"], np.uint8) == 0), pa.array(np.diff(np.r_[0, ends])), pa.array(sums[0]), pa.array(np.full(len(ends), m.tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = blocks.join(answers, blocks["block"] == answers["of"]).select("ids", "nulls", "train", "offsets", "tokens", "hashes", "answers")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every document."""
    return scored(table(spark, sf_dir, "documents"))
