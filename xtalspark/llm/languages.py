"""Language identification of web pages by Bayesian evidence fusion.

posterior(language) is proportional to
    P(text | language) * P(declared markup language | language) * P(language | host)
where the text's part comes from a naive Bayes model of character trigrams, the
declaration's from a confusion table, and the host's prior is smoothed
hierarchically: global counts back up address suffixes, which back up hosts.
All counts are grouped aggregations over all pages, of soft text posteriors; a
page's own share is taken out of its host's counts before they judge it.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Rows of labelled text at most, in expectation, that fit the trigram model.
TRAIN_ROWS = 20_000
#: Hash bins of trigrams; with the languages this bounds the model's size.
BINS = 1 << 16
#: Languages at most; a sample of more labels is refused.
MAX_LANGUAGES = 200
#: Trigrams a text may count for at most: neighbours in a text are not independent.
EFFECTIVE_TRIGRAMS = 40
#: Pseudo-counts with which an upper level backs up a lower one.
BACKING = 5.0

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^<>]*>?", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def page_text(page: str | None) -> str:
    """Text of a page without markup, scripts, styles and comments."""
    return _html.unescape(_DROP.sub(" ", page or ""))


def declared_language(page: str | None) -> str:
    found = _DECLARED.search(page or "")
    return found[1].lower() if found else ""


def trigram_bins(text: str) -> np.ndarray:
    """Bins of the trigrams of a lower-cased text; digits and marks are one class."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes < 97) | (codes > 122) & (codes < 192), np.uint64(32), codes)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BINS


class Model:
    """languages and log P(bin | language), of fixed size at most."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()

    def log_likelihood(self, text: str) -> np.ndarray:
        """Zero where a text has no trigram: it then says nothing."""
        bins = trigram_bins(text)
        if len(bins) == 0:
            return np.zeros(len(self.languages))
        return self.table[bins].mean(axis=0, dtype=np.float64) * min(len(bins), EFFECTIVE_TRIGRAMS)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit the trigram model on a bounded, seeded sample of labelled rows.

    Rows without a label or text are left out; if none is left, the model has no
    languages. The driver receives counts by (bin, language), at most
    BINS * MAX_LANGUAGES numbers, as Arrow columns.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    share = min(1.0, rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    top = sample.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES + 1).collect()
    if len(top) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in the sample")
    languages = sorted(r[0] for r in top)
    if not languages:
        return Model([], np.zeros((0, BINS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[x] = counts.get(x, 0) + np.bincount(trigram_bins(t), minlength=BINS)
        for x, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at, pa.int64()), pa.array(c[at].astype(np.int64))], names=["lang", "bin", "n"])

    parts = sample.filter(F.col(lang).isin(languages)).select(text, lang).mapInArrow(run, "lang string, bin bigint, n bigint")
    counts = np.zeros((len(languages), BINS))
    at = {x: i for i, x in enumerate(languages)}
    found = parts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[[at[x] for x in found["lang"].to_pylist()], found["bin"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def evidence(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, suffix, declared, n_chars, ll): what each page says, ll by language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("host", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            source = batch.column(2).to_pylist()
            texts = [page_text(p) for p in source]
            scores = [m.log_likelihood(t).tolist() for t in texts]
            arrays = [batch.column(0), batch.column(1), pa.array([declared_language(p) for p in source], pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "host", "declared", "n_chars", "ll"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    out = pages.select(key, host.alias("host"), html).mapInArrow(run, schema)
    return out.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))


def _normalised(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    top = F.array_max(logs)
    w = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, by: list[str], n: int, out: str) -> DataFrame:
    """Sums of the soft counts p by group, as an array."""
    cells = [F.sum(F.get("p", F.lit(i))) for i in range(n)]
    return rows.groupBy(*by).agg(F.array(*cells).alias(out))


def identify(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: key, lang, confidence, text_lang, declared, host, suffix, n_chars.

    A page without text is judged by its declaration, suffix and host alone; one
    without an address shares the host ''. Ties go to the language first in
    order. Repeated rows count as pages of their own. An empty table gives none.
    Under a model without languages lang, confidence and text_lang are null.
    """
    names, n = model.languages, len(model.languages)
    if not names:
        said = evidence(pages, model, key, url, html)
        return said.select(key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", "suffix", "n_chars")
    seen = stored(evidence(pages, model, key, url, html).withColumn("p", _normalised(F.col("ll"))), "languages")
    # Suffixes and declarations are parts of the address and the markup; each
    # table of them is stored and joined by key, split by Spark where it is hot.
    zero = F.array(*[F.lit(0.0)] * n)
    totals = _sums(seen, [], n, "all").first()[0]
    sums = np.array([x or 0.0 for x in totals])
    prior = (sums + 1.0) / (sums.sum() + n)
    flat = F.array(*(F.lit(float(x)) for x in prior))

    def backed(counts: Column, above: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, q: (F.greatest(c, F.lit(0.0)) + BACKING * q) / (total + BACKING))

    suffixes = _sums(seen, ["suffix"], n, "c").select("suffix", backed(F.col("c"), flat).alias("suffix_prior"))
    hosts = stored(_sums(seen, ["host", "suffix"], n, "host_counts").join(suffixes, "suffix").select(F.col("host").alias("__host"), "host_counts", "suffix_prior"), "hosts")
    declared = _sums(seen.filter("declared <> ''"), ["declared"], n, "declared_counts").select(F.col("declared").alias("__declared"), "declared_counts")
    declared = stored(declared, "declared")
    of = _sums(seen.filter("declared <> ''"), [], n, "all").first()[0]
    of_total = F.array(*(F.lit(float(x or 0.0)) for x in of))
    kinds = max(1, declared.count())
    joined = seen.join(hosts, seen["host"] == hosts["__host"]).join(declared, seen["declared"] == declared["__declared"], "left")
    others = F.zip_with("host_counts", "p", lambda c, x: c - x)
    host_prior = backed(others, F.col("suffix_prior"))
    told = F.zip_with(F.coalesce("declared_counts", zero), F.col("p"), lambda c, x: F.greatest(c - x, F.lit(0.0)) + 1.0)
    told = F.zip_with(told, of_total, lambda c, t: F.log(c / (t + float(kinds))))
    told = F.when(F.col("declared_counts").isNull(), zero).otherwise(told)
    logs = F.zip_with(F.zip_with("ll", told, lambda a, b: a + b), F.transform(host_prior, lambda x: F.log(x)), lambda a, b: a + b)
    post = joined.withColumn("post", _normalised(logs))
    label = lambda c: F.get(F.array(*map(F.lit, names)), (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    said = F.when(F.col("n_chars") > 0, label(F.col("p")))
    return post.select(key, label(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("confidence"), said.alias("text_lang"), "declared", "host", "suffix", "n_chars")


if not math.log2(BINS).is_integer():
    raise ValueError("BINS must be a power of two")
