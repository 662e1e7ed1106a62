"""Benchmark decontamination by winnowing.

Texts are sequences of lower-cased words. Of the hashes of all runs of K words
in each span of W consecutive runs the smallest is kept as a fingerprint (the
rightmost of equals), so two texts that share K + W - 1 words share one.
Documents' fingerprints are joined with the benchmark's, and each hit is
extended: the windows of LENGTH = K + W - 1 words around it are compared with
the benchmark's windows by a 128-bit digest of their text. Items with fewer words than
LENGTH are one window each, of their own length; as they can be shorter than
what winnowing guarantees, they are looked up at every position.

The benchmark is held in blocks of at most BLOCK_WORDS words, each with its
fingerprints and windows in one broadcast of bounded size. There is one pass
over the documents for each block, so a benchmark of any size is compared
whole; the usual one fits one block. Of several passes each is written out, and its
broadcast dropped, before the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

K, W = 5, 6
LENGTH = K + W - 1
BLOCK_WORDS = 2_000_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; characters beyond ASCII are letters."""
    return WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))


_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same on every machine."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : i + len(out)]
    return out ^ (out >> np.uint64(32))


def winnow(runs: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the smallest hash of each span of w, the rightmost of equals."""
    if len(runs) == 0:
        return np.zeros(0, np.int64)
    if len(runs) < w:
        return np.array([len(runs) - 1 - int(np.argmin(runs[::-1]))])
    spans = np.lib.stride_tricks.sliding_window_view(runs, w)[:, ::-1]
    return np.unique(np.arange(len(spans)) + w - 1 - np.argmin(spans, axis=1))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class Block:
    """What a pass over the documents needs of a part of the benchmark."""

    def __init__(self, items: list[list[bytes]]) -> None:
        prints, short_prints = [], {}
        self.windows: set[bytes] = set()
        self.short: dict[int, set[bytes]] = {}
        for words in items:
            h = word_hashes(words)
            if len(words) >= LENGTH:
                runs = run_hashes(h, K)
                prints.append(runs[winnow(runs)])
                self.windows.update(digest(words[i : i + LENGTH]) for i in range(len(words) - LENGTH + 1))
            elif words:
                self.short.setdefault(len(words), set()).add(digest(words))
                short_prints.setdefault(len(words), set()).add(int(run_hashes(h, len(words))[0]))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.short_prints = {n: np.array(sorted(s), np.uint64) for n, s in short_prints.items()}

    def find(self, words: list[bytes]) -> list[tuple[int, int, bytes]]:
        """(first word, number of words, digest) of each window in a document."""
        if len(words) == 0:
            return []
        h, out = word_hashes(words), []
        if len(words) >= LENGTH and len(self.prints):
            runs = run_hashes(h, K)
            kept = winnow(runs)
            joined = kept[_within(runs[kept], self.prints)]
            tried: set[int] = set()
            for at in joined.tolist():  # extend each hit to the windows that hold it
                tried.update(range(max(0, at - W + 1), min(at, len(words) - LENGTH) + 1))
            for i in sorted(tried):
                if (d := digest(words[i : i + LENGTH])) in self.windows:
                    out.append((i, LENGTH, d))
        for n, prints in self.short_prints.items():
            runs = run_hashes(h, n)
            for i in np.flatnonzero(_within(runs, prints)).tolist():
                if (d := digest(words[i : i + n])) in self.short[n]:
                    out.append((i, n, d))
        return out


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


_HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("window", T.BinaryType())]))


def _blocks(benchmark: DataFrame, text: str) -> tuple[int, Iterator[list[str]]]:
    """The number of blocks, most often one, and the texts of each: few enough words."""
    sized = benchmark.select(F.col(text).alias("t"), (F.length(F.coalesce(F.col(text), F.lit(""))) + 1).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = 1 + total // (2 * BLOCK_WORDS)  # a word and its gap have 2 characters or more

    def texts() -> Iterator[list[str]]:
        for b in range(n_blocks):
            part = sized if n_blocks == 1 else sized.filter(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == b)
            yield [r[0] for r in part.select("t").filter(F.col("t").isNotNull()).distinct().toLocalIterator()]

    return n_blocks, texts()


def find_windows(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", n_words: str = "n_words", hits: str = "hits") -> DataFrame:
    """Append n_words (long) and hits, an array of (first, n, window), to df's rows:
    the windows of benchmark texts that occur in the text, at each place.
    Columns of df with these names are replaced.
    """
    spark = df.sparkSession
    out = df.drop(n_words, hits)
    kept = out.columns
    parts = []
    n_blocks, blocks = _blocks(benchmark, item_text)
    for i, texts in enumerate(blocks):
        block = spark.sparkContext.broadcast(Block([words_of(t) for t in texts]))
        names = [n_words] * (not i) + [f"{hits}:{i}"]
        kinds = [T.LongType()] * (not i) + [_HITS]
        schema = T.StructType([*out.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

        def run(batches: Iterator[pa.RecordBatch], block=block, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, found = [], []
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    words = words_of(t)
                    counts.append(len(words))
                    found.append([{"first": a, "n": n, "window": d} for a, n, d in block.value.find(words)])
                lists = pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("window", pa.binary())])))
                arrays = [*batch.columns] + [pa.array(counts, pa.int64())] * (len(names) > 1) + [lists]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

        out = out.mapInArrow(run, schema)
        if n_blocks > 1:
            out = stored(out, "block")
            block.unpersist()
        parts.append(f"`{hits}:{i}`")
    return out.select(*(f"`{c}`" for c in kept), f"`{n_words}`", F.concat(*parts).alias(hits))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item."""
    kind = dict(benchmark.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                n = min(len(w), LENGTH)
                found = {digest(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
                ids += [i] * len(found)
                windows += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(windows, pa.binary())], names=[item, "window"])

    return benchmark.select(item, text).mapInArrow(run, f"`{item}` {kind}, window binary")


def spans(hits):
    """Merged (first, end) runs of hit words, from a column of hits."""
    ordered = F.array_sort(F.transform(hits, lambda x: F.struct(x["first"].alias("first"), (x["first"] + x["n"]).alias("end"))))
    start = F.array().cast("array<struct<first:int,end:int>>")

    def add(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["first"] <= last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, start, add)


def report(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of df: key, n_words, n_hit, spans (merged hit runs of
    words), items (sorted ids, as strings, of items with occurring windows).

    Null and empty texts have no words; items without words match nothing; equal
    items are all named. An empty benchmark leaves every document clean. Rows
    that share a key share their items.
    """
    found = find_windows(df.select(key, text), benchmark, text, item_text).drop(text)
    found = stored(found.withColumn("spans", spans(F.col("hits"))), "windows")
    pairs = found.filter(F.size("hits") > 0).select(key, F.explode(F.array_distinct(F.transform("hits", lambda x: x["window"]))).alias("window")).distinct()
    of = item_windows(benchmark, item, item_text)
    items = pairs.join(of, "window").select(F.col(key).alias("__key"), F.col(item).cast("string").alias("__i")).distinct()
    lists = items.groupBy("__key").agg(F.array_sort(F.collect_set("__i")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    joined = found.join(lists, found[key].eqNullSafe(lists["__key"]), "left")
    return joined.select(key, "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", share: float = 0.0) -> DataFrame:
    """df's rows whose hit words are at most `share` of their words."""
    cols = df.columns
    found = find_windows(df, benchmark, text, item_text, "__n_words", "__hits")
    n_hit = F.aggregate(spans(F.col("__hits")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return found.filter(n_hit <= share * F.col("__n_words")).select(*(f"`{c}`" for c in cols))
