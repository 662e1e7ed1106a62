"""Suffix-array deduplication of repeated byte strings, block by block.

Removes each byte that a string of LENGTH bytes covers which also starts earlier
(in a smaller key, or earlier in the same document).

1. Suffixes fall into buckets by the smallest hash of GRAM bytes in their first
   LENGTH bytes (its place is the anchor). Equal strings have equal anchors, so
   only buckets of two suffixes or more can repeat one. Texts are hashed once; runs of
   neighbouring suffixes with one anchor stay together, are stored and counted by anchor.
2. The runs of such buckets are cut out of their texts and dealt by bucket.
   A task sorts a block of a few whole buckets at a time: suffixes are sorted
   by their first PERIOD bytes, and longer ties are resolved by the ranks of a
   difference-cover sample, computed for the block beforehand. Of equal runs only
   the earliest is sorted. For any two suffixes a
   shift below PERIOD leads both into the sample. Neighbours in the order that
   share LENGTH bytes are repeats; the earliest of them stays.
3. Buckets of more than HOT runs are not brought together: equal runs are
   found by a grouped minimum over their digests, and the different runs that are left
   are bucketed anew by a longer anchor (REFINED), up to whole strings.

Copies of whole texts are found by their digest beforehand and skip 2 and 3.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, utf8

LENGTH = 100
GRAM = 32
PERIOD = 32
HOT = 1000
#: Anchor lengths of the buckets into which too large ones are dealt; the last is LENGTH.
REFINED = (64, 96, 100)
#: Bytes that are hashed, and suffixes that are sorted, at once.
CHUNK = 1 << 20
BLOCK = 1 << 20
#: Pieces that are cut at once.
CUTS = 50_000

_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]
_ODD = [np.uint64(x) for x in _ODD]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, last): runs of suffixes of one anchor, as positions in data.

    data holds texts end to end, ends their ends. Only suffixes of length bytes or
    more within their text are in runs.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none
    h, step, i = _letters()[data], 1, 0
    while step < gram:
        more = min(step, gram - step)
        h = h[:-more] * _ODD[i] + h[more:]
        step, i = step + more, i + 1
    h = _mix(h)
    span = length - gram + 1
    low, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        later = low[step:] < low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    n = len(at)
    starts = np.append(0, ends[:-1])
    valid = np.zeros(n + 1, np.int8)
    inside = ends - starts >= length
    np.add.at(valid, starts[inside], 1)
    np.add.at(valid, ends[inside] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    text = np.zeros(n + 1, bool)
    text[starts[inside]] = True
    new = valid & np.append(True, (at[1:] != at[:-1]) | ~valid[:-1]) | valid & text[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return h[at[first]], first, stop


def text_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, first, last) of texts, positions within each text.

    Long texts are read in chunks that overlap; a run may be cut in two there.
    """
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        ends = np.cumsum([len(g[2]) for g in group])
        bucket, first, last = anchor_runs(np.frombuffer(b"".join(g[2] for g in group), np.uint8), ends)
        which = np.searchsorted(ends, first, side="right")
        move = np.array([g[1] for g in group]) - np.append(0, ends[:-1])
        return np.array([g[0] for g in group])[which], bucket, first + move[which], last + move[which]

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            part = t[at : at + CHUNK + LENGTH - 1]
            if len(part) >= LENGTH:
                group.append((i, at, part))
                held += len(part)
            if held >= CHUNK:
                yield flush()
                group, held = [], 0
    if group:
        yield flush()


@cache
def difference_cover(period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """(inside, shift): residues of the cover, found greedily; shift[a, b] leads
    both a and b into it."""
    cover = [0, 1]
    while True:
        known = {(a - b) % period for a in cover for b in cover}
        if len(known) == period:
            break
        cover.append(max(range(period), key=lambda c: len(known | {(c - a) % period for a in cover} | {(a - c) % period for a in cover})))
    inside = np.zeros(period, bool)
    inside[cover] = True
    shift = np.zeros((period, period), np.int32)
    for a in range(period):
        for b in range(period):
            shift[a, b] = next(d for d in range(period) if inside[(a + d) % period] and inside[(b + d) % period])
    return inside, shift


def _words(data: bytes, pad: int) -> np.ndarray:
    """The big-endian 8-byte word at each position, zeros after the end."""
    raw = np.frombuffer(data + bytes(pad + 8), np.uint8)
    out = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | raw[i : i + len(out)]
    return out


def _rank(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): at sorted by depth bytes at least; group ids ascend with the order.

    After the first word only ties are sorted on, by one key of 64 bits: the
    number of the tied group and as many further bytes as there is room for.
    """
    order = np.argsort(words[at])
    key = words[at[order]]
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    d = 8
    while d < depth:
        same = group[1:] == group[:-1]
        tied = np.append(False, same) | np.append(same, False)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        number = np.cumsum(np.append(0, np.diff(group[where]) != 0)).astype(np.uint64)
        room = (64 - max(1, int(number[-1]).bit_length())) // 8
        key = number << np.uint64(8 * room) | words[at[order[where]] + d] >> np.uint64(64 - 8 * room)
        sub = np.argsort(key)
        order[where] = order[where[sub]]
        key = key[sub]
        split = np.zeros(len(at), np.int64)
        split[where[1:]] = (number[1:] == number[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
        d += room
    return order, group


def sort_suffixes(data: bytes, at: np.ndarray, depth: int = LENGTH, period: int = PERIOD) -> np.ndarray:
    """The positions at, sorted by the suffixes of data that start there; suffixes
    of depth equal bytes may come in any order among themselves."""
    inside, shift = difference_cover(period)
    words = _words(data, depth + 2 * period)
    n = len(data) + period
    sample = np.flatnonzero(np.resize(inside, n))
    wanted = np.zeros(n + period, bool)  # sample positions that any suffix may be led to
    wanted[at] = True
    reach = np.cumsum(wanted.astype(np.int32))
    sample = sample[reach[sample] - np.where(sample >= period, reach[np.maximum(sample - period, 0)], 0) > 0]
    order, group = _rank(words, sample, depth)
    rank = np.zeros(n + period, np.int32)
    rank[sample[order]] = group
    order, group = _rank(words, at, period)
    at = at[order]
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, len(at)))
    start, size = start[size > 1], size[size > 1]
    while len(start):  # each tied group is split by its middle one, all groups at once
        where = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        of = np.repeat(np.arange(len(start)), size)
        mine, pivot = at[where], at[start + size // 2][of]
        d = shift[mine % period, pivot % period]
        side = np.sign(rank[mine + d] - rank[pivot + d]).astype(np.int8)
        sub = np.lexsort((side, of))
        at[where] = mine[sub]
        side = side[sub]
        cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (side[1:] != side[:-1])))
        length = np.diff(np.append(cut, len(of)))
        keep = (length > 1) & (side[cut] != 0)
        start, size = where[cut[keep]], length[keep]
    return at


def repeats(data: bytes, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of each position of at: equal for equal strings of length bytes."""
    order = np.argsort(at)
    done = sort_suffixes(data, at[order], length)
    words = _words(data, length)
    same = np.ones(max(len(done) - 1, 0), bool)
    for d in [*range(0, length - 7, 8), length - 8]:
        w = words[done + d]
        same &= w[1:] == w[:-1]
    group = np.cumsum(np.append(0, ~same))
    out = np.empty(len(at), np.int64)
    out[order[np.searchsorted(at[order], done)]] = group
    return out


def _spans(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts by key."""
    order = np.lexsort((starts, keys))
    k, s = keys[order], starts[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1)) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1 if len(first) else first
    return k[first], s[first], s[last]


def block_repeats(keys: np.ndarray, firsts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) runs of suffixes that repeat an earlier one, among pieces
    of texts: piece i begins at firsts[i] of text keys[i] and holds len - LENGTH + 1 suffixes."""
    counts = np.array([len(p) - LENGTH + 1 for p in pieces])
    offsets = np.cumsum([0, *(len(p) for p in pieces)])[:-1]
    of = np.repeat(np.arange(len(pieces)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    group = repeats(b"".join(pieces), offsets[of] + inner)
    key, start = keys[of], firsts[of] + inner
    order = np.lexsort((start, key, group))
    g, k, s = group[order], key[order], start[order]
    head = np.append(True, g[1:] != g[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    again = (k != k[lead]) | (s != s[lead])
    return _spans(k[again], s[again])


def distinct_repeats(keys: np.ndarray, firsts: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What block_repeats gives, sorting the suffixes of the earliest of equal
    pieces only: all of a later one repeat that one."""
    codes: dict[bytes, int] = {}
    code = np.fromiter((codes.setdefault(p, len(codes)) for p in pieces), np.int64, len(pieces))
    order = np.lexsort((firsts, keys, code))
    head = np.append(True, code[order][1:] != code[order][:-1])
    lead = order[head]
    of = lead[np.cumsum(head) - 1]
    # A row that comes twice has its pieces twice: the same place is no repeat.
    later = order[(keys[order] != keys[of]) | (firsts[order] != firsts[of])]
    k, a, b = block_repeats(keys[lead], firsts[lead], [pieces[i] for i in lead.tolist()])
    ends = firsts[later] + np.fromiter((len(pieces[i]) for i in later.tolist()), np.int64, len(later)) - LENGTH
    return np.append(k, keys[later]), np.append(a, firsts[later]), np.append(b, ends)


def _release(spark: SparkSession) -> None:
    """Let the driver drop references to finished shuffles, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes_of(column) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _runs(docs: DataFrame) -> DataFrame:
    """(bucket, key, first, n) of each run in docs (key, data); it holds n + 1 suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for which, bucket, first, last in text_runs(_bytes_of(batch.column(1))):
                arrays = [bucket.view(np.int64), keys[which], first.astype(np.int32), (last - first).astype(np.int16)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["bucket", "key", "first", "n"])

    return stored(docs.mapInArrow(run, "bucket bigint, key bigint, first int, n smallint"), "runs")


def _counted(runs: DataFrame) -> DataFrame:
    counts = runs.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(counts.select(F.col("bucket").alias("b"), (F.col("n") > HOT).alias("hot")), "repeated-buckets")


def _places(runs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, places): the runs of repeated buckets by text. A place is a number of
    64 bits: the first suffix, the number of further ones and whether the bucket is hot."""
    place = F.shiftleft(F.col("first").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("n").cast("bigint"), 1))
    joined = runs.select("bucket", "key", place.alias("place")).join(buckets, F.col("bucket") == F.col("b"))
    marked = joined.select("key", F.struct("bucket", F.col("place").bitwiseOR(F.col("hot").cast("bigint")).alias("place")).alias("p"))
    return marked.groupBy("key").agg(F.collect_list("p").alias("places"))


def _copies(docs: DataFrame) -> DataFrame:
    """(key, first, last): texts of LENGTH bytes or more that a smaller key has too."""
    ids = docs.select("key", F.unhex(F.sha2("data", 256)).alias("sha"), F.octet_length("data").alias("n")).filter(F.col("n") >= LENGTH)
    first = stored(ids.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most").select(F.col("sha").alias("s"), "least"), "copied")
    return stored(ids.join(first, F.col("sha") == F.col("s")).filter("key <> least").select("key", F.lit(0).alias("first"), (F.col("n") - LENGTH).alias("last")), "copies")


def _pieces(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Runs of repeated buckets cut out of their texts.

    Hot runs have the digest of the piece as kind, and the piece itself only with
    the first of its kind in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, texts, lists = batch.column(0).to_numpy(zero_copy_only=False), _bytes_of(batch.column(1)), batch.column(2)
            which = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            buckets, at = lists.flatten().flatten()
            at = at.to_numpy()
            firsts, counts, hot = at >> 32, (at & 0xFFFFFFFF) >> 1, (at & 1).astype(bool)
            for lo in range(0, len(at), CUTS):
                here = slice(lo, lo + CUTS)
                w, f, n = which[here], firsts[here], counts[here]
                found = [texts[i][a:b] for i, a, b in zip(w.tolist(), f.tolist(), (f + n + LENGTH).tolist())]
                kinds: list[bytes | None] = [None] * len(found)
                for i in np.flatnonzero(hot[here]).tolist():
                    kinds[i] = hashlib.blake2b(found[i], digest_size=16).digest()
                    if len(seen) > 200_000:
                        seen.clear()
                    if kinds[i] in seen:
                        found[i] = None
                    seen.add(kinds[i])
                arrays = [buckets.slice(lo, CUTS), pa.array(keys[w]), pa.array(f.astype(np.int32)), pa.array((f + n).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.binary()), pa.array(kinds, pa.binary())], names=["bucket", "key", "first", "last", "piece", "kind"])

    joined = docs.join(places, docs["key"] == places["k"]).select("key", "data", "places")
    schema = "bucket bigint, key bigint, first int, last int, piece binary, kind binary"
    return stored(joined.mapInArrow(run, schema), "pieces")


def _cold(pieces: DataFrame) -> DataFrame:
    """Repeats within cold buckets; a task holds one block of whole buckets at a time."""

    def block(rows: list) -> pa.RecordBatch:
        keys, firsts, found = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
        k, a, b = distinct_repeats(keys, firsts.astype(np.int64), found.tolist())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            size = np.cumsum(np.fromiter(map(len, cols[3]), np.int64, len(batch)))
            start = 0
            heads = np.flatnonzero(np.append(cols[0][0] != last, cols[0][1:] != cols[0][:-1]))
            for head in heads.tolist():  # where a bucket begins a full block may end
                done = held + (size[head - 1] if head else 0) - (size[start - 1] if start else 0)
                if done >= BLOCK:
                    rows.append([c[start:head] for c in cols])
                    yield block(rows)
                    rows, held, start = [], 0, head
            rows.append([c[start:] for c in cols])
            held += int(size[-1] - (size[start - 1] if start else 0))
            last = cols[0][-1]
        if rows:
            yield block(rows)

    cold = pieces.filter("kind is null").select("bucket", "key", "first", "piece")
    n = max(int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cold.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key bigint, first int, last int")


def _refined(pieces: DataFrame, gram: int) -> DataFrame:
    """Runs of the suffixes in pieces (key, first, piece) by anchors of gram bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(batch), 4096):
                texts = _bytes_of(batch.column(2).slice(at, 4096))
                ends = np.cumsum([len(t) for t in texts])
                bucket, first, last = anchor_runs(np.frombuffer(b"".join(texts), np.uint8), ends, gram=gram)
                which = np.searchsorted(ends, first, side="right")
                inner = first - np.append(0, ends[:-1])[which]
                found = [texts[w][i : i + n + LENGTH] for w, i, n in zip(which.tolist(), inner.tolist(), (last - first).tolist())]
                kinds = [hashlib.blake2b(t, digest_size=16).digest() for t in found]
                start = (firsts[at + which] + inner).astype(np.int32)
                arrays = [bucket.view(np.int64), keys[at + which], start, start + (last - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(found, pa.binary()), pa.array(kinds, pa.binary())], names=["bucket", "key", "first", "last", "piece", "kind"])

    return pieces.mapInArrow(run, "bucket bigint, key bigint, first int, last int, piece binary, kind binary")


def _hot(pieces: DataFrame, grams: tuple[int, ...] = REFINED) -> DataFrame:
    """Repeats within hot buckets, by grouped minima of digests and longer anchors."""
    hot = pieces.filter("kind is not null")
    least = hot.groupBy("kind").agg(F.min(F.struct("key", "first")).alias("least"), F.max("piece").alias("piece"), F.count("*").alias("n"))
    least = stored(least.select(F.col("kind").alias("k"), "least", "piece", "n"), "hot-runs")
    later = hot.join(least.filter("n > 1").select("k", "least"), F.col("kind") == F.col("k")).filter(F.struct("key", "first") != F.col("least")).select("key", "first", "last")
    if not grams or least.isEmpty():
        return later
    runs = stored(_refined(least.select("least.key", "least.first", "piece"), grams[0]), "refined")
    counts = runs.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    counts = stored(counts.select(F.col("bucket").alias("b"), (F.col("n") > HOT).alias("hot")), "repeated-buckets")
    again = runs.join(counts, F.col("bucket") == F.col("b")).select("bucket", "key", "first", "last", "piece", F.when(F.col("hot"), F.col("kind")).alias("kind"))
    return later.unionByName(_cold(again)).unionByName(_hot(again, grams[1:]))


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): for each key with repeats the runs (first, last) of starts of
    repeated strings, in no order; they may overlap."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("bigint").alias("key"), utf8(F.col(text)).alias("data")).filter("key is not null")
    copies = _copies(slim)
    runs = _runs(slim)
    buckets = _counted(runs)
    _release(spark)
    copied = copies.select(F.col("key").alias("c"))
    places = _places(runs, buckets).join(copied, F.col("key") == F.col("c"), "left_anti")
    places = stored(places.select(F.col("key").alias("k"), "places"), "places")
    discard(runs, buckets)
    _release(spark)
    pieces = _pieces(slim, places)
    discard(places)
    _release(spark)
    found = _cold(pieces).unionByName(_hot(pieces)).unionByName(copies)
    spans = stored(found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeats")
    _release(spark)
    return spans


def _cut(docs: DataFrame, key: str, text: str, make) -> DataFrame:
    spans = find_repeats(docs, key, text)
    spans = spans.select(F.col("key").alias("__k"), F.col("spans").alias("__spans"))
    return make(docs.join(spans, F.col(key) == F.col("__k"), "left").drop("__k"))


def removed_runs(n: int, spans) -> list[tuple[int, int]]:
    """Maximal removed byte runs (start, end) of a text of n bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"] + LENGTH) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, runs.

    Null is empty; texts under LENGTH bytes lose nothing. Repeated rows of a key
    are one text and lose the same. Rows with a null key are left whole, and
    nothing is compared with them. Keys are integers that name one text each.
    """
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for data, spans in zip(_bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                runs = removed_runs(len(data), spans)
                row = len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(data, runs)).hexdigest(), [{"start": a, "end": b} for a, b in runs]
                for col, v in zip(rows, row):
                    col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])

    schema = f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, runs array<struct<start:int,end:int>>"
    return _cut(docs, key, text, lambda j: j.select(key, utf8(F.col(text)), "__spans").mapInArrow(run, schema))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeats cut out of text; bytes of characters that are cut
    through go with them. Null texts stay null; every row and column stays."""

    @F.pandas_udf("string")
    def kept(data: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for d, s in zip(data, spans):
            out.append(None if d is None else _kept(bytes(d), removed_runs(len(d), None if s is None else list(s))).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    cols = docs.columns

    def make(joined: DataFrame) -> DataFrame:
        new = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept(F.col(text).cast("binary"), "__spans"))
        return joined.withColumn(text, new).select(*cols)

    return _cut(docs, key, text, make)
