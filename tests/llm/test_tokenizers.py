import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from xtalspark.llm import pieces, token_counts

from .conftest import prose

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "'r", "'ve", "'l", "'ll", "'d", "e", "l", "the", "Z", "é", "漢字", "٣", "12", "½", "!", "...", "　", "\x85", "\x1c", "\0", "😀", "<|endoftext|>", "<|endo", "'T", "ʼ", "Ⅷ", "𝒳"]


def mixtures(n, parts=PARTS, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BPE)


def test_token_counts_equal_the_library(counter):
    texts = mixtures(3000) + [prose(500, 3), "", "'", "'r", "a" * 3000, "=" * 5000, "ab" * 4000, "\n" * 999 + "x", " " * 5000]
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_state_maps_compose_like_a_sequential_run(counter):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 11, 1000).astype(np.uint8)
    state, starts = token_counts.FRESH, np.zeros(1001, bool)
    for i, k in enumerate(codes):
        out = counter.splitter.out[k, state]
        starts[i] |= bool(out & 1)
        if out & 2:
            starts[i - 1] = True
        state = counter.splitter.to[k, state]
    assert (counter.splitter.starts(codes) == starts[:1000]).all()


def test_transducer_states_can_be_made_anew(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    words = prose(50, 8).split()
    want = [len(Tokenizer.from_file(BPE).encode(w, add_special_tokens=False).ids) for w in words]
    assert [counter.pieces.tokens_of(w.encode()) for w in words] == want


@pytest.fixture(scope="module")
def model():
    return pieces.Model(MODEL)


@pytest.fixture(scope="module")
def library():
    """The library's unigram search over the same pieces. Pieces of only white
    space have scores that swamp its single precision; they can win in neither."""
    spec = pb.ModelProto()
    with open(MODEL, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        p.score = max(p.score, -40000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def encoded(model, text):
    return list(itertools.chain.from_iterable(model.encode(text)))


def test_pieces_equal_the_library(model, library):
    texts = mixtures(1500, [" ", "  ", "\n", "a", "the", "tion", "é", "漢字", "😀", "▁", "x", "Z", "<0x41>", "\t", "ing", "00"], 2)
    texts += [w for w in prose(2000, 4).split()]
    assert [encoded(model, t) for t in texts] == [library.encode(t) for t in texts]


def test_decoding_gives_texts_back(model, library):
    for t in mixtures(500, PARTS, 5) + ["", " ", "  a ", prose(300, 1)]:
        ids = encoded(model, t)
        assert model.decode(ids) == t
    assert model.decode(encoded(model, "a▁b")) == "a b"


def test_double_array_holds_exactly_its_words():
    rng = random.Random(0)
    words = sorted({bytes(rng.choice(b"abc\xff\0") for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    trie = pieces.DoubleArray([(w, i) for i, w in enumerate(words)])
    for probe in words + [bytes(rng.choice(b"abcd\xff\0") for _ in range(8)) for _ in range(300)]:
        want = [(n, words.index(probe[:n])) for n in range(1, len(probe) + 1) if probe[:n] in words]
        assert list(trie.prefixes(probe, 0)) == want


def test_decode_operator(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "é\n😀")], "doc_id int, text string")
    back = pieces.decode(pieces.encode(df, MODEL), MODEL, out="again").collect()
    assert {r["doc_id"]: r["again"] for r in back} == {1: "two words", 2: "", 3: "é\n😀"}
