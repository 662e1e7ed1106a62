"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from xtalspark.llm import decontaminate, licenses, near_duplicates, pieces, quality, shards, suffix_dedup, token_counts

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def bench(spark, texts=("alpha beta",)):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "item_id int, text string")


SAME_ROWS = {
    "quality": lambda s, d: quality.score(d),
    "licenses": lambda s, d: licenses.scan(d),
    "shards": lambda s, d: shards.interleave(d, 4),
    "tokens": lambda s, d: token_counts.count_tokens(d, BPE),
    "pieces": lambda s, d: pieces.encode(d, MODEL, check=True),
    "classes": lambda s, d: near_duplicates.classes(d),
    "suffix": lambda s, d: suffix_dedup.report(d),
    "removed": lambda s, d: suffix_dedup.remove(d),
    "decontaminate": lambda s, d: decontaminate.report(d, bench(s)),
}


@pytest.mark.parametrize("name", SAME_ROWS)
def test_every_row_stays(spark, edge_docs, no_docs, name):
    f = SAME_ROWS[name]
    got = f(spark, edge_docs)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in edge_docs.collect())
    none = f(spark, no_docs)
    assert none.schema == got.schema and none.count() == 0


KEPT_COLUMNS = {
    "quality": lambda s, d: quality.keep_good(d),
    "near": lambda s, d: near_duplicates.keep_one(d),
    "suffix": lambda s, d: suffix_dedup.remove(d),
    "decontaminate": lambda s, d: decontaminate.drop_contaminated(d, bench(s)),
}


@pytest.mark.parametrize("name", KEPT_COLUMNS)
def test_stages_keep_columns(spark, edge_docs, no_docs, name):
    got = KEPT_COLUMNS[name](spark, edge_docs)
    assert got.dtypes == edge_docs.dtypes
    other = {(r["doc_id"], r["m"], r["hits"], r["kept"], r["ids"]) for r in edge_docs.collect()}
    assert {(r["doc_id"], r["m"], r["hits"], r["kept"], r["ids"]) for r in got.collect()} <= other
    assert KEPT_COLUMNS[name](spark, no_docs).count() == 0


def test_null_and_empty_are_zero(spark, edge_docs):
    blank = F.col("text").isNull() | (F.col("text") == "")
    q = quality.score(edge_docs).filter(blank)
    assert {tuple(r) for r in q.select("m.n_words", "m.word_chars", "m.n_symbols", "m.n_repeat_words", "kept").collect()} == {(0, 0, 0, 0, False)}
    assert {r[0] for r in token_counts.count_tokens(edge_docs, BPE).filter(blank).select("n_tokens").collect()} == {0}
    assert {tuple(r) for r in pieces.encode(edge_docs, MODEL, check=True).filter(blank).select(F.size("ids"), "round_trip").collect()} == {(0, True)}


def test_repeated_rows_share_results(spark, edge_docs):
    got = {tuple(r) for r in suffix_dedup.report(edge_docs).filter("doc_id = 4").select("n_removed", "n_spans", "kept_sha256").collect()}
    assert len(got) == 1 and next(iter(got))[0] == 0
    cls = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(edge_docs).filter("doc_id is not null").collect()}
    assert cls[5] == cls[4] == 4 and cls[0] == 0 and cls[1] == 1
    assert near_duplicates.keep_one(edge_docs).filter("doc_id = 4").count() == 1
