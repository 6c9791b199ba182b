"""Operator 1, SentencePiece encoding and decoding: a forward pass over the trie of distinct marked words.

White space is marked and words are cut before marks. A batch's distinct words are sorted, so that going through them in
order is a depth-first walk of their trie: the forward states of a prefix are kept while words share it. A state is the
last piece of the best segmentation of its prefix. In a unigram model the best is the largest sum of scores (Viterbi), the
longer last piece of equals; sums here are in double precision and begin at each word, those of the model's own library
are in single precision and go on, so only segmentations whose sums are equal but for rounding can differ from its. In
a BPE model it is the one that the merges give, which a last piece can end if merging it with the piece before it, alone,
leaves both whole. That holds for one piece at each prefix, so ids are those of the model's own library.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, prepare, slices, table

#: The model file; its path is a parameter of the functions below.
MODEL = os.environ.get("LINEWEAVE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and pairs that a worker remembers at most; beyond, it starts anew.
REMEMBERED = 400_000
UNKNOWN = -1


class Pieces:
    """A SentencePiece model of kind BPE or unigram, read from the bytes of its file; encodes and decodes."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(k) for k in range(n)]
        self.bpe = _kind(model) == 2
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.ids = {self.names[k]: k for k in plain}
        self.scores = {self.names[k]: sp.get_score(k) for k in plain}
        self.byte_ids = {int(self.names[k][1:-1], 16): k for k in range(n) if sp.is_byte(k)}
        self.unknown = sp.unk_id()
        #: every end of a piece: the id if it is a piece itself, or UNKNOWN
        self.ends = {p[k:]: UNKNOWN for p in self.ids for k in range(len(p))} | self.ids
        self.sizes = [len(name) for name in self.names]
        raw = {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.raw = [raw.get(k, b"" if sp.is_control(k) else " ⁇ ".encode() if k == self.unknown else name.replace(MARK, " ").encode()) for k, name in enumerate(self.names)]
        #: what a character without a piece costs a unigram segmentation
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, word: str) -> list[str]:
        """BPE of a word: the adjacent pair that makes the best-scored piece is merged, the leftmost of equals, until none is left."""
        part, n, scores = list(word), len(word), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (s := scores.get(new := part[a] + part[b])) is not None:
                heap.append((-s, a, b, new)) if not heap else heapq.heappush(heap, (-s, a, b, new))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, new = heapq.heappop(heap)
            if not part[a] or not part[b] or after[a] != b or len(part[a]) + len(part[b]) != len(new):
                continue
            part[a], part[b] = new, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in part if p]

    def stand(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces side by side (UNKNOWN on the left: the right one alone)."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        names = [self.names[k] for k in (left, right) if k != UNKNOWN]
        known = self.pairs[left * len(self.names) + right] = self.merged("".join(names)) == names
        return known

    def spell(self, parts: list[str]) -> tuple[int, ...]:
        """Ids of pieces; a character without one gives its bytes, or the unknown id in a model without bytes."""
        out: list[int] = []
        for p in parts:
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def walk(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, ids) of sorted distinct words, states being reused over common prefixes."""
        ends, sizes, scores, bpe, pairs, n = self.ends, self.sizes, self.scores, self.bpe, self.pairs, len(self.names)
        last: list[int] = [UNKNOWN]  # of each prefix: its last piece; UNKNOWN for a character without one, with which nothing merges
        best = [0.0]
        previous = ""
        for word in words:
            if bpe and word.startswith(MARK + MARK):  # runs of marks share one score and are merged from the left
                yield word, self.spell(self.merged(word))
                continue
            keep, most = 0, min(len(previous), len(word))
            while keep < most and previous[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], best[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                own, score, k = UNKNOWN, best[i - 1] + self.penalty, i - 1
                while k >= 0 and (piece := ends.get(word[k:i])) is not None:
                    if piece >= 0:
                        if not bpe:
                            if (new := best[k] + scores[word[k:i]]) >= score or own == UNKNOWN:
                                own, score = piece, new
                        else:
                            known = pairs.get(last[k] * n + piece)
                            if known is None:
                                known = self.stand(last[k], piece)
                            if known:
                                own, score = piece, 0.0
                                break
                    k -= 1
                last.append(own)
                best.append(score)
            out, i = [], len(word)
            while i:
                own = last[i]
                if own >= 0:
                    out.append(own)
                    i -= sizes[own]
                else:
                    i -= 1
                    out += self.spell([word[i]])[::-1]
            yield word, tuple(out[::-1])
            previous = word

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and the offsets of each text."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*split)
        new = sorted(distinct.difference(self.words))
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = sorted(distinct)
        self.words.update(self.walk(new))
        place = {w: k for k, w in enumerate(distinct)}
        own = [self.words[w] for w in place]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((k for w in own for k in w), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        at = np.fromiter((place[w] for ws in split for w in ws), np.int64, sum(map(len, split)))
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.cumsum([0, *map(len, split)])
        bounds = np.r_[0, ends][words] if len(ends) else np.zeros(len(texts) + 1, np.int64)
        if self.byte_ids:
            return out, bounds
        # a run of characters without a piece is one unknown id, across words also
        first = np.zeros(len(out) + 1, bool)
        first[bounds] = True
        kept = first[:-1] | (out != self.unknown) | np.r_[True, out[:-1] != self.unknown][: len(out)]
        return out[kept], np.r_[0, np.cumsum(kept)][bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, bytes are joined, and the first mark goes."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _kind(model: bytes) -> int:
    """The model type that the file states: 1 unigram, 2 BPE, ..."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    if m.normalizer_spec.name not in ("identity", "") or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models that leave texts as they are, but for a mark before them, are supported")
    return m.trainer_spec.model_type


_loaded: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """One Pieces for each model in a process, so that a worker keeps what it has learned from one task to the next."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; some hundred kilobytes, so that it can be sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs(text, ...) with ids array<int>, n_ids int and round_trip boolean, whether the decoded ids are the text.

    Null text: null ids, null n_ids, null round_trip; empty text: no ids, true. A text with the mark itself decodes to
    spaces (round_trip false), as do bytes that are no UTF-8. Rows and other columns stay as they are; columns that are
    already called like the new ones keep their names, and the new ones get underscores before theirs.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent, names = spark.sparkContext.broadcast(model_bytes(model)), docs.columns
    plain = docs.toDF(*[n if n == "text" else f"c{k}" for k, n in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(sent.value)
        for b in batches:
            column = b.column("text")
            for lo, hi, _, _ in slices(column):
                part = b.slice(lo, hi - lo)
                texts = part.column("text").to_pylist() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else [None] * (hi - lo)
                ids, offsets = p.encode([t or "" for t in texts])
                same = [None if t is None else p.decode(ids[a:z]) == t for t, a, z in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=null)
                sizes = pa.array(np.diff(offsets).astype(np.int32), mask=np.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, sizes, pa.array(same, pa.bool_())], [*part.schema.names, "new_ids", "new_n", "new_same"])

    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
    done = plain.mapInArrow(run, f"{schema}, new_ids array<int>, new_n int, new_same boolean")
    taken = {n.lower() for n in names}
    new = []
    for n in ("ids", "n_ids", "round_trip"):
        while n in taken:
            n = f"_{n}"
        new.append(n)
    return done.toDF(*names, *new)


def decoded(tokens: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """tokens with a column decoded (underscores before it if there is one): the text of the ids, null where these are null. Ids out of range: IndexError."""
    spark, new = tokens.sparkSession, free_name(tokens, "decoded")
    prepare(spark)
    sent = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(sent.value)
        for b in batches:
            texts = [None if x is None else p.decode(np.array(x, np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, new])

    return tokens.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes) + f", `{new}` string")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return encoded(docs).select("doc_id", "n_ids", "ids", "round_trip")
