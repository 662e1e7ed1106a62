"""Sharding, decontamination, quality, licences, languages, archives against plain Python."""

import gzip
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from xtalspark.llm import decontaminate, languages, licenses, quality, queries, shards, warc

from .conftest import SCHEMA, prose, rows

DATA = "/root/testdata/sf0.001"


def test_shards_hold_the_mixture(spark):
    data = [(i, "big" if i % 3 else f"s{i % 7}" if i % 2 else None) for i in range(1001)]
    df = spark.createDataFrame(data, "doc_id bigint, source string")
    got = shards.interleave(df, 8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1001))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    total = Counter(r["source"] for r in got)
    for s in range(8):
        for source, n in Counter(r["source"] for r in got if r["shard"] == s).items():
            assert abs(n - total[source] / 8) <= 2
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shards.interleave(df.repartition(5), 8).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def brute_windows(text, items):
    w = decontaminate.words_of(text)
    hit, found = set(), set()
    for k, t in items.items():
        b = decontaminate.words_of(t)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    few = ["aa", "bb", "cc"]
    items = {i: prose(30, i, few if i % 2 else None) for i in range(8)} | {20: "Short Item", 21: "", 22: None, 23: "same same", 24: prose(10, 77), 25: prose(9, 78)}
    texts = [prose(60, 100 + i, few if i % 2 else None) for i in range(10)]
    texts += [prose(20, 5) + " " + " ".join(items[k].split()[3:n]) + "! " + prose(9, 6) for k, n in ((0, 13), (0, 12), (2, 25), (4, 30))]
    texts += ["short ITEM", "a short, item b", "same same same", items[24].upper(), items[25], None, "", items[0] + " " + items[0]]
    docs = dict(enumerate(texts))
    bench = spark.createDataFrame(list(items.items()), "item_id int, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.report(spark.createDataFrame(rows(texts), SCHEMA), bench).collect()}
    assert got == {i: brute_windows(t, items) for i, t in docs.items()}
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(spark.createDataFrame(rows(texts), SCHEMA), bench).collect()}
    assert clean == {i for i, t in docs.items() if not brute_windows(t, items)[1]}


def test_winnowing_keeps_one_in_every_span():
    h = decontaminate.run_hashes(decontaminate.word_hashes(decontaminate.words_of(prose(400, 2))), 5)
    kept = set(decontaminate.winnow(h).tolist())
    assert all(kept & set(range(i, i + decontaminate.W)) for i in range(len(h) - decontaminate.W + 1))
    assert len(kept) < len(h) / 2


def test_repeated_words_equal_brute_force(spark):
    texts = [prose(n, n, ["a", "b"]) for n in (3, 4, 5, 9, 30, 200)] + ["x " * 7, "a b c d e f a b c d e", None, "", prose(500, 1)]
    want = []
    for t in texts:
        w = (t or "").split()
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        want.append(len({j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}))
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert [r[0] for r in quality.measures(df).orderBy("doc_id").select("m.n_repeat_words").collect()] == want


def test_quality_plan_has_no_python(spark):
    plan = quality.keep_good(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_labelled_texts_are_judged_as_labelled(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    j = quality.score(docs).join(labels, "doc_id").filter(~quality.base_failed(F.col("m")))
    wrong = j.filter(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.02 * j.count()


def test_licences(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = [mit, "intro words here\n\n" + "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)), "Released  under THE mit license!", "Released under no license", None, "", "text\nLicensed under the Apache License, Version 2.0.\nmore", mit.replace("Software", "Program")]
    got = {r["doc_id"]: {h["license"] for h in r["license_hits"]} for r in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got[0] == {"mit"} and got[2] == {"mit-statement"} and got[6] == {"apache-2.0-statement"} and not got[3] | got[4] | got[5]

    def dice(a, b):
        a, b = set(licenses.bigrams(a)), set(licenses.bigrams(b))
        return 2 * len(a & b) / (len(a) + len(b))

    assert ("mit" in got[7]) == (dice(texts[7], mit) >= licenses.THRESHOLD)


def test_language_model_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = languages.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1 and length(text) > 40").collect()
    right = sum(model.languages[int(model.log_likelihood(r["text"]).argmax())] == r["lang"] for r in held)
    assert right >= 0.95 * len(held)


def test_evidence_fuses(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = languages.fit(docs)
    fr = next(r["text"] for r in docs.filter("lang = 'fr' and length(text) > 200").limit(1).collect())
    data = [(i, f"http://a.example.fr/{i}", f'<html lang="fr"><p>{fr}</p>') for i in range(30)]
    data += [(100, "http://a.example.fr/x", None), (101, None, ""), (None, "no address", "<p>"), (102, "http://b.fr/", '<html lang="fr"></html>'), (103, "http://u@a.example.fr:80/", "<!-- " * 50 + fr)]
    got = {r["page_id"]: r for r in languages.identify(spark.createDataFrame(data, "page_id bigint, url string, html string"), model).collect()}
    assert len(got) == len(data) and got[0]["lang"] == "fr" and got[0]["host"] == "a.example.fr" and got[0]["suffix"] == "fr"
    assert got[100]["lang"] == "fr" and got[100]["text_lang"] is None and got[102]["lang"] == "fr"
    assert languages.identify(spark.createDataFrame([], "page_id bigint, url string, html string"), model).count() == 0


def test_page_text_drops_markup():
    assert languages.page_text("<style>x</style>a<script>b</script><!-- c -->d<p>&amp;") .split() == ["a", "d", "&"]
    assert languages.declared_language('<HTML class=x LANG=pt-BR>') == "pt"


def test_more_labels_than_the_model_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, f"text {x}", x) for i, x in enumerate("abc")], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 labels"):
        languages.fit(docs)


def test_declaration_after_a_long_preamble():
    assert languages.declared_language("<!-- " + "x " * 50_000 + '--><html lang="fr">') == "fr"


def pages(spark):
    html = [None, "", "same", "same", "é" * 1000, "same", "\x1f\x8b\x08" * 40, "WARC/1.1\r\n\r\n" * 5, "x" * 300_000]
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i else None, h) for i, h in enumerate(html)] + [(None, None, "odd")], "page_id bigint, url string, html string")


@pytest.mark.parametrize("split", [64, 1000, 1 << 24])
def test_archives_read_back_whole_at_any_split(spark, split):
    df = pages(spark)
    manifest = warc.archive(df)
    got = warc.read(manifest, split=split).select("*", warc.page_of(F.col("record_id")).alias("page_id"), warc.page_of(F.col("refers_to")).alias("of")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 10 and set(by) == {*range(9), None}
    groups = defaultdict(list)
    for r in df.collect():
        if r["page_id"] is not None:
            groups[r["html"] or ""].append(r["page_id"])
    for html, ids in groups.items():
        for i in ids:
            r, top = by[i], max(ids)
            assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.payload_digest(html.encode())
            assert (r["record_type"], r["of"]) == (("response", None) if i == top else ("revisit", top))
            assert bytes(r["content"]) == (html.encode() if i == top else b"")


def test_records_with_very_long_headers_are_read(tmp_path):
    rec = warc.record(1, "http://a/" + "a" * (80 << 20), b"body", warc.payload_digest(b"body"), "response", None)
    assert len(rec) > warc.BLOCK // 16
    (tmp_path / "a.warc.gz").write_bytes(rec)
    found = list(warc.scan_range(f"file://{tmp_path}/a.warc.gz", len(rec), 0, len(rec)))
    assert len(found) == 1 and found[0][2] == b"body"


def test_archives_are_gzip_members_and_junk_is_passed_over(spark, tmp_path):
    rec = warc.record(1, "http://a/", b"body", warc.payload_digest(b"body"), "response", None)
    assert gzip.decompress(rec).startswith(b"WARC/1.1\r\nWARC-Type: response")
    junk = b"\x1f\x8b\x08junk" + gzip.compress(b"no header here") + rec + b"\x1f\x8b" + rec
    (tmp_path / "a.warc.gz").write_bytes(junk)
    found = [x for a in range(0, len(junk), 50) for x in warc.scan_range(f"file://{tmp_path}/a.warc.gz", len(junk), a, min(a + 50, len(junk)))]
    assert len(found) == 2 and all(x[2] == b"body" for x in found)
    assert warc.read(spark.createDataFrame([], "path string, n_bytes bigint")).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "b" * 9), (4, "u", "b" * 9)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.revisits(df, least_bytes=5).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = cp.quality_rules(spark, docs, DATA)
    assert good.columns == docs.columns and not any(labels.get(r["doc_id"]) == 0 for r in good.collect())
    last = cp.run(spark, DATA)
    kept = {r["doc_id"]: r for r in last.collect()}
    assert set(docs.columns) <= set(last.columns) and 0 < len(kept) <= good.count() and all(r["round_trip"] for r in kept.values())
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    seen = set()
    for r in kept.values():
        data = r["text"].encode()
        own = {data[p : p + 100] for p in range(len(data) - 99)}
        assert not own & seen
        seen |= own
    assert queries.QUERIES["op9_near_duplicates"](spark, DATA).count() == docs.count()
