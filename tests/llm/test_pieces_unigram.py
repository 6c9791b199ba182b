"""Viterbi for unigram models: against the model's own library and against all segmentations."""

import random

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from lineweave.llm import pieces

TEXTS = ["abab baa", "  aab  ", "zz", "a zz zza", "abcabcabc", "c", "", " ", "ab c\nab", "xyzzy a x y", "bbbbbbbbbbbb aaaaaaaaaaaaaa", "é💥é a"]


def _model(vocabulary, seed, with_bytes=False):
    """A unigram model of these pieces; nothing is trained. Scores are random 64ths, so that sums are exact and ties many."""
    rng, m = random.Random(seed), proto.ModelProto()
    kinds = proto.ModelProto.SentencePiece
    m.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    for k in range(256 if with_bytes else 0):
        m.pieces.add(piece=f"<0x{k:02X}>", score=0, type=kinds.BYTE)
    for v in vocabulary:
        m.pieces.add(piece=v, score=-rng.randint(64, 768) / 64, type=kinds.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, with_bytes
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    return m.SerializeToString()


def _vocabulary(seed):
    rng = random.Random(seed)
    made = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "b", "c"}
    return sorted(made | {pieces.MARK + x for x in sorted(made)[::3]} | {pieces.MARK} if seed % 3 else made)


def _random_texts(seed):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice("abcz ") for _ in range(rng.randint(1, 40))) for _ in range(60)]


def _ids(p, texts):
    flat, bounds = p.encode(texts)
    return [flat[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def test_unigram_is_the_librarys():
    for seed in range(12):
        for with_bytes in (False, True):
            model = _model(_vocabulary(seed), seed, with_bytes)
            library, p = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
            assert not p.bpe
            texts = _random_texts(seed)
            assert _ids(p, texts) == [library.encode(t) for t in texts], (seed, with_bytes)


def test_unigram_is_the_best_of_all_segmentations():
    for seed in (1, 2, 4):
        p = pieces.Pieces(_model(_vocabulary(seed), seed))

        def ways(word, p=p):
            """The score of every segmentation."""
            if not word:
                yield 0.0
            for k in range(1, len(word) + 1):
                if (own := p.scores.get(word[:k], p.penalty if k == 1 else None)) is not None:
                    yield from (own + rest for rest in ways(word[k:]))

        rng = random.Random(seed)
        words = sorted({pieces.MARK + "".join(rng.choice("abcz") for _ in range(rng.randint(1, 9))) for _ in range(80)})
        for word, ids in p.walk(words):
            got = sum(p.penalty if k == p.unknown else p.scores[p.names[k]] for k in ids)
            assert abs(got - max(ways(word))) < 1e-6, word


def test_decoded_beside_a_column_of_its_name(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = pieces.decoded(pieces.encoded(rows).selectExpr("ids", "text AS decoded")).first()
    assert (got["decoded"], got["_decoded"]) == ("a b", "a b")
