"""The transducer against the library, for models built here piece by piece."""

import random

import pytest

from lociform.llm import sentence_pieces as pieces

sp = pytest.importorskip("sentencepiece")
MARK = pieces.MARK


def model(kind, scored, users=(), with_bytes=False, charsmap=b"", trims=False, prefix=True):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    spec = m.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.precompiled_charsmap = "own", prefix, trims, True, charsmap
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, with_bytes
    own = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    own += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    own += [(p, 0.0, 4) for p in users] + [(p, s, 1) for p, s in scored]
    for text, score, type_ in own:
        p = m.pieces.add()
        p.piece, p.score, p.type = text, score, type_
    return m.SerializeToString()


def nfkc():
    return sp.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()


def charsmap():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(nfkc())
    return m.normalizer_spec.precompiled_charsmap


def compare(raw, texts):
    lib, own = sp.SentencePieceProcessor(model_proto=raw), pieces.Transducer(raw)
    for t in texts:
        assert own.encode(t) == lib.encode(t), repr(t)


def texts(parts, n=600, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def merges(seed, letters="abc", n=40):
    """A BPE vocabulary in which every piece is made of two others."""
    rnd = random.Random(seed)
    have = [*letters, MARK]
    while len(have) < n:
        p = rnd.choice(have) + rnd.choice(have)
        if p not in have and MARK not in p[1:] and len(p) < 7:
            have.append(p)
    made = [p for p in have if len(p) > 1]
    return [(p, -float(i)) for i, p in enumerate(made)] + [(p, -float(len(made) + i)) for i, p in enumerate([*letters, MARK])]


PARTS = ["a", "b", "c", "ab", "ca", " ", "  ", "x", "é", "\n"]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("with_bytes", [False, True])
def test_bpe_models(seed, with_bytes):
    compare(model(2, merges(seed), with_bytes=with_bytes), texts(PARTS))
    compare(model(2, merges(seed), with_bytes=with_bytes, prefix=False), texts(PARTS))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("with_bytes", [False, True])
def test_unigram_models(seed, with_bytes):
    rnd = random.Random(seed)
    scored = [(p, -round(rnd.uniform(1, 9), 3)) for p, _ in merges(seed)]
    compare(model(1, scored, with_bytes=with_bytes), texts(PARTS))
    compare(model(1, scored, with_bytes=with_bytes, trims=True), texts(PARTS))


def test_pieces_of_the_user():
    users = ["abca", "bc", "<tag>"]
    scored = [x for x in merges(1) if x[0] not in users]
    for kind in (1, 2):
        raw = model(kind, scored, users=users, with_bytes=True)
        compare(raw, texts([*PARTS, "<tag>", "abca", "bc"]))


def test_normaliser_with_a_character_map():
    blob = charsmap()
    rules = pieces.character_map(blob)
    assert rules["Ａ"] == "A" and rules["ﬁ"] == "fi" and len(rules) > 3000
    parts = [*PARTS, "Ａ", "ﬁ", "①", "é", " ", "　", "ｶﾞ", "A"]
    scored = [*merges(2), ("f", -3.0), ("i", -3.5), ("A", -2.0), ("1", -2.0)]
    for trims in (False, True):
        for kind in (1, 2):
            compare(model(kind, scored, with_bytes=True, charsmap=blob, trims=trims), texts(parts))


def test_pieces_without_single_characters():
    raw = model(2, [("ab", -1.0), ("bc", -2.0)], with_bytes=True)
    compare(raw, ["abc", "bcab", "a", "", "cab", "abab bc"])


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Transducer(model(3, [("a", -1.0)]))


def test_tables_stay_bounded():
    t = pieces.Transducer(pieces.read_model(pieces.MODEL))
    was, pieces.KEPT_BYTES = pieces.KEPT_BYTES, 10_000
    try:
        for i in range(500):
            t.encode(f"word{i} and " + "y" * 2000)
            assert t.kept <= 10_000 and all(len(w) <= pieces.LONG for w in t.words)
    finally:
        pieces.KEPT_BYTES = was
