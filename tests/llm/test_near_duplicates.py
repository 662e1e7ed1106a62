import numpy as np
import pytest

from xtalspark.llm import near_duplicates as nd

from .conftest import SCHEMA, prose, rows


def brute(docs, threshold=nd.THRESHOLD):
    """Smallest member of each component of pairs at or above the threshold."""
    u = {i: nd.units(nd.words_of(t)) for i, t in docs.items()}
    lead = {i: i for i in docs}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    keys = sorted(docs)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if nd.weighted_jaccard(u[a], u[b]) >= threshold:
                x, y = find(a), find(b)
                lead[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def changed(text, every, seed):
    w = text.split()
    for i in range(seed % every, len(w), every):
        w[i] = f"new{seed}{i}"
    return " ".join(w)


def test_equals_brute_force(spark):
    base = [prose(200, i, [f"w{k}" for k in range(400)]) for i in range(6)]
    texts = list(base) + [base[0], base[0], None, "", "one two", "one two", "!!!"]
    texts += [changed(base[1], 100, s) for s in range(40)]  # a hub with many near copies
    texts += [changed(base[2], k, 3) for k in (8, 15, 30, 60, 90, 200)]
    texts += [base[3] + " " + prose(n, 9) for n in (5, 20, 40, 80)]
    docs = dict(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows(texts), SCHEMA).repartition(4)).collect()}
    assert got == brute(docs)


def edited(text, places, tag):
    w = text.split()
    for i in places:
        w[i] = f"{tag}x{i}"
    return " ".join(w)


def hub_with_variants(n_variants=40, n_pairs=12):
    """A hub, variants of it, and pairs (A, B): A is near the hub, B near A alone."""
    hub = prose(304, 77, [f"w{k}" for k in range(4000)])
    texts = [hub] + [edited(hub, [5 + 6 * (s % 48)], f"v{s}") for s in range(n_variants)]
    for s in range(n_pairs):
        a = edited(hub, [10 + s], f"a{s}")
        texts += [a, edited(a, [60 + s + 30 * k for k in range(6)], f"b{s}")]
    return texts


@pytest.mark.parametrize("block_rows", [512, 7])
def test_links_of_settled_members_are_found(spark, monkeypatch, block_rows):
    monkeypatch.setattr(nd, "BLOCK_ROWS", block_rows, raising=False)
    texts = hub_with_variants()
    u = [nd.units(nd.words_of(t)) for t in texts]
    for b in range(42, len(texts), 2):
        assert nd.weighted_jaccard(u[b], u[b - 1]) >= nd.THRESHOLD > nd.weighted_jaccard(u[b], u[0])
    docs = dict(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows(texts), SCHEMA).repartition(4)).collect()}
    assert got == brute(docs)


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for share in (0.2, 0.5, 0.8):
        n = int(len(a) * share)
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        same = np.mean([(nd.dart_signature(a, 2048) == nd.dart_signature(b, 2048)).mean()])
        assert abs(same - nd.weighted_jaccard(a, b)) < 0.05


def test_counts_are_weights():
    a, b = nd.units(nd.words_of("x " * 10)), nd.units(nd.words_of("x " * 20))
    assert nd.weighted_jaccard(a, b) == pytest.approx(6 / 16)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["v"]: r["label"] for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
