"""MinHash near-duplicates by DartMinHash.

A document is the weighted set of its runs of SHINGLE words, a run's weight
being its count. Every unit of weight gets darts whose ranks are a Poisson
process drawn from hashes of the unit, so equal units of two documents have
equal darts; darts beyond a document's horizon, which falls with its weight, are
never thrown. Each dart falls on one of SLOTS coordinates, and the earliest on
each is the signature: two documents agree on a coordinate with the probability
of their weighted Jaccard similarity. Signatures are cut into bands and joined.

Documents of the same words are one representative. In each bucket the document
most often met in buckets leads, and each document is compared exactly, by
weighted Jaccard similarity, with the best of its leaders. Then any two members of a
bucket that are not yet of one component are compared exactly, in blocks of
bounded size: a pair is left out only if it is of one component, its sizes
forbid the threshold or it meets in another bucket. Classes are the connected
components of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .decontaminate import run_hashes, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Rows and units of a block of a bucket, about; they bound a group's memory.
BLOCK_ROWS, BLOCK_UNITS = 512, 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: spreads every bit over all."""
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def units(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the units of weight: (run of words, its n-th occurrence).

    A text of fewer words than a shingle is one run; one of none has no unit.
    """
    if not words:
        return np.zeros(0, np.uint64)
    runs = np.sort(run_hashes(word_hashes(words), min(shingle, len(words))))
    at = np.arange(len(runs))
    first = np.maximum.accumulate(np.where(np.append(True, runs[1:] != runs[:-1]), at, 0))
    return np.sort(mix(runs + (at - first).astype(np.uint64) * _A))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of units; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def dart_signature(u: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Identity of the earliest dart on each coordinate."""
    horizon = slots * (math.log(slots) + 3) / len(u)
    while True:
        ranks, at, names = [], [], []
        live, rank, n = u, np.zeros(len(u)), 0
        while len(live):
            n += 1
            h = mix(live + np.uint64(n * int(_A) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> _S11).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank < horizon
            live, rank, h = live[hit], rank[hit], h[hit]
            name = mix(h ^ _A)
            ranks.append(rank)
            names.append(name)
            at.append((name % np.uint64(slots)).astype(np.intp))
        order = np.argsort(np.concatenate(ranks), kind="stable")[::-1]
        where = np.concatenate(at)[order]
        out, filled = np.zeros(slots, np.uint64), np.zeros(slots, bool)
        out[where] = np.concatenate(names)[order]
        filled[where] = True
        if filled.all():
            return out
        horizon *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _C
    for i in range(rows.shape[1]):
        key = mix(key * _A + rows[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, bands): digest of the words, keys of the bands; both are
    null for texts without words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bands = [], []
            for t in batch.column(1).to_pylist():
                w = words_of(t)
                digests.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None)
                bands.append(band_keys(dart_signature(units(w))) if w else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[key, "digest", "bands"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, digest binary, bands array<bigint>")


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Append linked to rows (a, b, text_a, text_b), leaving the texts out."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            texts = (t for at in range(0, len(batch), 256) for t in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in (2, 3))))
            for ta, tb in texts:
                if tb not in held:
                    if len(held) >= 8:
                        held.clear()
                    held[tb] = units(words_of(tb))
                out.append(weighted_jaccard(units(words_of(ta)), held[tb]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest member of each vertex's component, from links (a, b).

    Smallest labels spread over the links and labels are looked up at labels,
    so the rounds are about the logarithm of a component's width. Each round
    is stored; hot vertices are grouped minima and joins that Spark can split.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("v") == F.col("a")).select("v", F.least("label", "near").alias("next"), "label")
        spread = stored(spread, "labels")
        over = spread.select(F.col("v").alias("u"), F.col("next").alias("over"))
        jumped = spread.join(over, F.col("next") == F.col("u"), "left").select("v", F.least("next", F.coalesce("over", "next")).alias("new"), "label")
        jumped = stored(jumped, "labels")
        done = jumped.filter("new <> label").isEmpty()
        labels = jumped.select("v", F.col("new").alias("label"))
        if done:
            return labels


def cross_links(group: pa.Table, bands: int = BANDS, threshold: float = THRESHOLD) -> list[tuple]:
    """Linked pairs (a, b), a < b, of different labels among the rows (bucket, i, j,
    doc, block, label, bands, units) of one block pair of a bucket.

    All pairs of two blocks, or of one if i = j, are compared, except those of one
    label, those whose sizes forbid the threshold and those that meet in an
    earlier band too. Links merge labels, so that a class is not linked over and over.
    """
    bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    units_of = [np.frombuffer(x, np.uint64) for x in group.column("units").to_pylist()]
    size = np.array([len(u) for u in units_of])
    order = np.argsort(size, kind="stable")
    size = size[order]
    docs = group.column("doc").to_numpy()[order]
    block = group.column("block").to_numpy()[order]
    label = np.unique(group.column("label").to_numpy()[order], return_inverse=True)[1]
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)[order]
    ids = np.unique(np.concatenate([units_of[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    starts = np.append(0, np.cumsum(size))
    mark = np.zeros(int(ids.max()) + 1, np.int64)
    at_band = int(np.argmax(keys[0] == bucket))
    found = []
    for r in range(len(docs) - 1):
        end = int(np.searchsorted(-(size[r] / size), -threshold, "right"))
        wanted = label[r + 1 : end] != label[r]
        if i != j:
            wanted &= block[r + 1 : end] != block[r]
        if wanted.any():
            wanted &= ~(keys[r + 1 : end, :at_band] == keys[r, :at_band]).any(axis=1)
        at = r + 1 + np.flatnonzero(wanted)
        if not len(at):
            continue
        mark[ids[starts[r] : starts[r + 1]]] = 1
        lo, hi = at[0], at[-1] + 1
        shared = np.add.reduceat(mark[ids[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])[at - lo]
        mark[ids[starts[r] : starts[r + 1]]] = 0
        for c in at[shared / (size[r] + size[at] - shared) >= threshold]:
            if label[c] != label[r]:
                found.append((min(docs[r], docs[c]), max(docs[r], docs[c])))
                label[label == label[c]] = label[r]
    return found


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members (bucket, doc) of a bucket that have different labels.

    Large buckets are dealt into blocks by hash, of bounded rows and units, and each
    pair of blocks is a group of its own. Only links come out.
    """
    kind = members.schema["doc"].dataType.simpleString()
    of = labels.select(F.col("v").alias("__v"), "label")
    told = members.join(of, F.col("doc") == F.col("__v"), "left").select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    told = stored(told, "labelled")
    mixed = told.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("k"))
    told = stored(told.join(mixed, F.col("bucket") == F.col("k"), "left_semi"), "mixed")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                packed = [units(words_of(t)) for t in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array([len(u) for u in packed], pa.int64()), pa.array([u.tobytes() for u in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["d", "weight", "units"])

    need = told.select(F.col("doc").alias("n")).distinct()
    loads = texts.join(need, F.col("d") == F.col("n"), "left_semi").select("d", "t").mapInArrow(load, f"d {kind}, weight bigint, units binary")
    loads = stored(loads.join(reps.select("rep", "bands"), F.col("d") == F.col("rep")).select("d", "weight", "units", "bands"), "units")
    weighed = stored(told.join(loads.select("d", "weight"), F.col("doc") == F.col("d")).drop("d"), "weighed")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("weight") / BLOCK_UNITS)).cast("int")
    sizes = stored(weighed.groupBy("bucket").agg(parts.alias("parts")).withColumnRenamed("bucket", "k"), "parts")
    dealt = weighed.join(sizes, F.col("bucket") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    other = dealt.select("bucket", "doc", "label", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = other.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "block", "label")
    rows = pair.join(loads, F.col("doc") == F.col("d")).select("bucket", "i", "j", "doc", "block", "label", "bands", "units")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = cross_links(pa.Table.from_batches(held), threshold=threshold)
                held.clear()
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(3).type), pa.array(b, batch.column(3).type)], names=["a", "b"])

        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy() for c in range(3)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                group = tuple(c[lo] for c in cols)
                if group != last:
                    yield from flush()
                    last = group
                held.append(batch.slice(lo, hi - lo))
        yield from flush()

    return stored(rows.mapInArrow(run, f"a {kind}, b {kind}"), "across")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: key, class_id (the smallest key of its class).

    Null and wordless texts are each a class alone; a null key has the class
    null. Rows with equal words, repeated rows with them, are of one class.
    An empty table gives none. Keys are numbers or strings, and are taken to name one text.
    """
    docs = docs.select(key, text)
    all_rows = stored(signatures(docs, key, text), "signatures")
    told = all_rows.filter(F.col("digest").isNotNull() & F.col(key).isNotNull())
    first = told.groupBy("digest").agg(F.min(F.struct(F.col(key).alias("rep"), "bands")).alias("s"))
    reps = stored(first.select("digest", "s.rep", "s.bands"), "representatives")
    spots = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"))
    sizes = stored(spots.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("bucket", "k"), "buckets")
    members = stored(spots.join(sizes, F.col("bucket") == F.col("k")).select("bucket", "doc", "size"), "members")
    met = members.groupBy("doc").agg(F.sum("size").alias("met")).withColumnRenamed("doc", "d")
    members = stored(members.join(stored(met, "met"), F.col("doc") == F.col("d")).select("bucket", "doc", "met"), "members")
    wanted = members.select("doc").distinct()
    texts = docs.join(wanted, docs[key] == wanted["doc"], "left_semi").select(F.col(key).alias("d"), F.col(text).alias("t"))
    texts = stored(texts.dropDuplicates(["d"]), "texts")
    if members.isEmpty():
        label = reps.select("digest", F.col("rep").alias("class_id"))
    else:
        # A document first meets the best of its leaders only.
        lead = members.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("less"), "doc")).alias("s"))
        lead = stored(lead.select(F.col("bucket").alias("k"), F.col("s.doc").alias("leader"), F.col("s.less").alias("less")), "leaders")
        led = members.join(lead, F.col("bucket") == F.col("k")).filter(F.col("doc") != F.col("leader"))
        best = led.groupBy("doc").agg(F.min(F.struct("less", "leader")).alias("s")).select("doc", F.col("s.leader").alias("leader"))
        pairs = best.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
        with_a = pairs.join(texts, F.col("a") == F.col("d")).select("a", "b", F.col("t").alias("text_a"))
        with_b = with_a.join(texts, F.col("b") == F.col("d")).select("a", "b", "text_a", F.col("t").alias("text_b"))
        links = stored(similar(with_b, threshold), "compared").filter("linked").select("a", "b")
        links = links.union(_across(members.select("bucket", "doc"), components(links), texts, reps, threshold))
        of = components(links)
        label = reps.join(of, F.col("rep") == F.col("v"), "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
    label = stored(label.withColumnRenamed("digest", "g"), "classes")
    return all_rows.join(label, F.col("digest") == F.col("g"), "left").select(key, F.when(F.col(key).isNotNull(), F.coalesce("class_id", F.col(key))).alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows, one for each class: that of the smallest key. Rows with a null
    key stay; of repeated rows of a kept key one stays."""
    cols = docs.columns
    kept = stored(classes(docs, key, text, threshold).filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("__kept")).distinct(), "kept")
    chosen = docs.join(kept, F.col(key) == F.col("__kept"), "left_semi").dropDuplicates([key])
    return chosen.unionByName(docs.filter(F.col(key).isNull())).select(*cols)
