import hashlib
import random

import numpy as np
import pytest

from xtalspark.llm import suffix_dedup as sd

from .conftest import SCHEMA, prose, rows


def brute(docs):
    """Every window of 100 bytes in order of (doc, start); the first of equals stays."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(5)
    passage = prose(60, 7)
    texts = [prose(200, i) for i in range(20)] + [prose(200, 3), None, "", "ab" * 300, "ab" * 120 + "é" * 80, "q" * 99, "q" * 100, "q" * 101]
    texts += [f"{prose(rng.randrange(60), i)} {passage} {prose(rng.randrange(60), i + 1)}" for i in range(100, 130)]
    texts += [texts[0][: rng.randrange(50, 900)] + "#" + texts[1][rng.randrange(300) :] for _ in range(12)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("hot", [1000, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    docs = corpus()
    df = spark.createDataFrame(rows(docs.values()), SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.report(df).collect()}
    assert got == brute(docs)


def test_difference_cover_leads_every_pair_into_it():
    inside, shift = sd.difference_cover()
    for a in range(sd.PERIOD):
        for b in range(sd.PERIOD):
            assert shift[a, b] < sd.PERIOD and inside[(a + shift[a, b]) % sd.PERIOD] and inside[(b + shift[a, b]) % sd.PERIOD]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_suffix_order(alphabet):
    rng = random.Random(1)
    part = bytes(rng.choice(alphabet) for _ in range(150))
    data = part + bytes(rng.choice(alphabet) for _ in range(60)) + part * 3
    at = np.random.default_rng(0).permutation(len(data) - 99)
    done = sd.sort_suffixes(data, at)
    assert sorted(done) == sorted(at)
    heads = [data[p : p + 100] for p in done]
    assert heads == sorted(heads)
    classes = sd.repeats(data, at)
    names = {}
    for p, c in zip(at, classes):
        assert names.setdefault(data[p : p + 100], c) == c
    assert len(set(classes)) == len(names)


def test_equal_strings_share_a_bucket_across_chunks(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 256)
    texts = [prose(300, 1).encode(), b"", b"z" * 99, (prose(80, 2) + prose(300, 1)).encode()]
    bucket, by = {}, {}
    for which, b, first, last in sd.text_runs(texts):
        for w, x, f, e in zip(which.tolist(), b.tolist(), first.tolist(), last.tolist()):
            for i in range(f, e + 1):
                assert (w, i) not in bucket
                bucket[w, i] = x
    for (w, i), x in bucket.items():
        assert by.setdefault(texts[w][i : i + 100], x) == x
    assert len(bucket) == sum(max(0, len(t) - 99) for t in texts)


def test_remove_cuts_whole_characters(spark):
    passage = "é" + prose(30, 11) + "é"
    df = spark.createDataFrame(rows(["start " + passage, "x" + passage + " end"]), SCHEMA)
    out = {r["doc_id"]: r["text"] for r in sd.remove(df).collect()}
    assert out[0] == "start " + passage and out[1].startswith("x") and out[1].endswith(" end") and len(out[1]) < 8
