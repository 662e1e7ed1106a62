"""Licence windows, fused evidence, HTTP archives, long pieces and the pipeline's chain against plain Python."""

import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from xtalspark.llm import decontaminate, languages, licenses, near_duplicates, pieces, suffix_dedup, token_counts, warc
from xtalspark.llm.common import discard, stored

from .conftest import SCHEMA, prose, rows

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
PAGES = "page_id bigint, url string, html string"


# -- licences


def brute_licenses(text):
    w = licenses.words(text or "")
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = {}
    for name, template in licenses.TEMPLATES.items():
        g = set(licenses.bigrams(template))
        b = len(g)
        need, most = licenses.bounds(b)
        at = [i for i, x in enumerate(grams) if x in g]
        best = 0.0
        for i in at:
            if i and grams[i - 1] in g:
                continue
            inside = [j for j in at if i <= j < i + most]
            full = max((j for j in inside if j < i + b), default=None)
            for j in inside:
                if j == full or j + 1 == len(grams) or grams[j + 1] not in g:
                    best = max(best, 2.0 * len(set(grams[i : j + 1]) & g) / (b + j - i + 1))
        if best >= licenses.THRESHOLD:
            out[name] = best
    return out


def license_texts():
    t = licenses.TEMPLATES
    rng = random.Random(3)

    def worn(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(["foo", "of", "the", "software"])
        return " ".join(w)

    texts = [f"{prose(40, 1)} {x} {prose(40, 2)}" for x in t.values()]
    texts += [f"{prose(5, i)} {worn(x, len(x.split()) // 10)}\n\n{prose(5, i)}" for i, x in enumerate(t.values())]
    texts += [t["mit"] * 3, "Great tool. Released under the MIT License. See the docs.", "x " + " ".join(t.values()), None, "", "of the", "the software " * 400, prose(3000, 9) + t["isc"]]
    return texts


def test_license_windows_equal_brute_force(spark):
    texts = license_texts()
    got = {r["doc_id"]: {h["license"]: h["dice"] for h in r["license_hits"]} for r in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    for i, text in enumerate(texts):
        want = brute_licenses(text)
        assert got[i].keys() == want.keys() and all(math.isclose(got[i][k], v) for k, v in want.items()), text
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[i].get(name) == 1.0 or name in got[i]


def test_paragraphs_and_inner_statements_are_found(spark):
    mit = licenses.TEMPLATES["mit"]
    broken = mit.replace(": The above", ":\n\n  The above").replace(". THE SOFTWARE", ".\n\nTHE SOFTWARE")
    header = licenses.TEMPLATES["apache-2.0-header"].replace(" You may obtain", "\n# \n#  You may obtain").replace(" Unless", "\n# \n# Unless")
    texts = [f"Copyright (c) 1999 A. Person\n\n{broken}\n\n{prose(400, 4)}", f"# {header}\nimport os\n" + prose(100, 5), "A tool. Released under the MIT License, see there."]
    got = [{h["license"] for h in r["license_hits"]} for r in licenses.scan(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()]
    assert "mit" in got[0] and "apache-2.0-header" in got[1] and got[2] == {"mit-statement"}


# -- languages


def brute_posterior(data, model):
    """The fusion of the module's docstring, page by page."""
    names, n = model.languages, len(model.languages)

    def soft(logs):
        w = np.exp(np.array(logs) - np.max(logs))
        return w / w.sum()

    def backed(c, q):
        return (np.maximum(c, 0) + languages.BACKING * q) / (c.sum() + languages.BACKING)

    seen = []
    for page, url, html in data:
        host = ""
        if url and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower()
        text = languages.page_text(html)
        ll = model.log_likelihood(text)
        seen.append((page, host, host.rpartition(".")[2], languages.declared_language(html), len(text), ll, soft(ll)))
    every = sum(s[6] for s in seen)
    prior = (every + 1) / (every.sum() + n)
    by = [defaultdict(lambda: np.zeros(n)) for _ in range(3)]
    for s in seen:
        by[0][s[2]] += s[6]
        by[1][s[1]] += s[6]
        if s[3]:
            by[2][s[3]] += s[6]
    told = sum(by[2].values()) if by[2] else np.zeros(n)
    out = []
    for page, host, suffix, declared, size, ll, p in seen:
        logs = ll + np.log(backed(by[1][host] - p, backed(by[0][suffix], prior)))
        if declared:
            logs = logs + np.log((np.maximum(by[2][declared] - p, 0) + 1) / (told + max(1, len(by[2]))))
        post = soft(logs)
        out.append((page, names[int(post.argmax())], round(float(post.max()), 5), names[int(p.argmax())] if size else None, declared, host, suffix, size))
    return out


def web(n=40):
    rng = random.Random(8)
    said = {"en": "the cat and the dog are in the house of the king", "fr": "le chat et le chien sont dans la maison du roi", "de": "die katze und der hund sind in dem haus des herrn"}
    data = []
    for i in range(n):
        x = rng.choice(list(said))
        words = " ".join(rng.choice(said[x].split()) for _ in range(rng.choice([0, 1, 3, 30])))
        lang = rng.choice(["", "", f' lang="{x}"', ' lang="en"'])
        data.append((i, f"http://{rng.choice(['a', 'b.c', 'user@d'])}.{rng.choice([x, 'org'])}:80/{i}", f"<html{lang}><p>{words}</p></html>"))
    return data + [(100, None, None), (101, "", ""), (None, "no address", "<p>"), (0, *data[0][1:]), (102, "http://x.fr", "é" * 20_000)]


def test_posteriors_equal_the_plain_computation(spark):
    texts = [("en", "the cat and the dog are in the house of the king"), ("fr", "le chat et le chien sont dans la maison du roi"), ("de", "die katze und der hund sind in dem haus des herrn")]
    model = languages.fit(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts * 3)] + [(99, None, "en"), (98, "x", None)], "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    data = web()
    df = spark.createDataFrame([(*r, "c") for r in data], PAGES + ", p string").withColumnRenamed("p", "ll")
    got = languages.identify(df, model).collect()
    key = lambda r: str(r)
    got = sorted(((r["page_id"], r["lang"], round(r["confidence"], 5), r["text_lang"], r["declared"], r["host"], r["suffix"], r["n_chars"]) for r in got), key=key)
    want = sorted(brute_posterior(data, model), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert abs(a[2] - b[2]) < 1e-4 and a[3:] == b[3:] and (a[:2] == b[:2] or a[2] < 0.51), (a, b)


def test_no_labelled_text_gives_no_language(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = languages.fit(empty)
    got = languages.identify(spark.createDataFrame(web(3), PAGES), model).collect()
    assert len(got) == 8 and {(r["lang"], r["confidence"], r["text_lang"]) for r in got} == {(None, None, None)}
    full = languages.fit(spark.createDataFrame([(1, "a text", "en")], "doc_id bigint, text string, lang string"))
    assert languages.identify(spark.createDataFrame([], PAGES), full).schema == languages.identify(spark.createDataFrame([], PAGES), model).schema


# -- archives


def member(fields, content):
    head = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + f"Content-Length: {len(content)}\r\n\r\n".encode()
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head + content + b"\r\n\r\n") + c.flush()


def manifest(spark, tmp_path, data):
    (tmp_path / "x.warc.gz").write_bytes(data)
    return spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data), 1)], "path string, n_bytes bigint, n_records bigint")


def test_http_responses_are_read(spark, tmp_path):
    http = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://a/"}
    plain, body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", b"<p>body</p>"
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>b\r\n7;x=1\r\nody</p>\r\n0\r\n\r\n"
    sha1 = "sha1:" + warc.payload_digest(body)
    hexed = "sha256:" + hashlib.sha256(body).hexdigest()
    data = member({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n")
    data += member(http | {"WARC-Payload-Digest": sha1}, plain + body) + member(http | {"WARC-Payload-Digest": hexed}, chunks) + member(http | {"WARC-Payload-Digest": "odd:zzz"}, plain + body)
    data += member({"WARC-Type": "request", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n")
    got = warc.read(manifest(spark, tmp_path, data), split=40).orderBy("offset").collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "response", "response", "response", "request"]
    assert {(bytes(r["content"]), r["payload_bytes"]) for r in got[1:4]} == {(body, len(body))} and bytes(got[0]["content"]) == b"software: x\r\n"
    wrong = member(http | {"WARC-Payload-Digest": sha1}, plain + b"other")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(manifest(spark, tmp_path, wrong)).collect()


def test_cut_members_and_lost_records_are_told(spark, tmp_path):
    rec = warc.record(1, "http://a/", b"body" * 999, warc.payload_digest(b"body" * 999), "response", None)
    with pytest.raises(Exception, match="cut off"):
        warc.read(manifest(spark, tmp_path, rec + rec[:-20])).collect()
    one = manifest(spark, tmp_path, rec + rec)
    assert warc.missing(one, warc.read(one)).first()["n_read"] == 2
    df = spark.createDataFrame([(i, None, f"page {i % 3}") for i in range(9)], PAGES)
    made = warc.archive(df)
    assert warc.missing(made, warc.read(made)).count() == 0
    none = spark.createDataFrame([], PAGES)
    assert warc.round_trip(spark, none).count() == 0


def test_pages_of_any_kind_come_back(spark):
    data = [(0, None, None), (1, "u", ""), (2, "u", "x" * 400_000), (3, "u", "same"), (3, "u", "same"), (4, "u", "same"), (None, None, None)]
    df = spark.createDataFrame([(*r, "c", "d") for r in data], PAGES + ", payload string, record_type string")
    got = warc.round_trip(spark, df).select(warc.page_of(F.col("record_id")).alias("id"), "record_type", "payload_bytes").collect()
    assert sorted((str(r["id"]), r["payload_bytes"]) for r in got) == sorted((str(i), len(h or "")) for i, _, h in data)
    assert base64.b32decode(warc.payload_digest(b"x")) == hashlib.sha1(b"x").digest()


# -- tokens and pieces


def test_one_endless_word_keeps_few_states():
    c = token_counts.Counter(BPE)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = random.Random(4)
    for text in ("".join(rng.choice("abcde") for _ in range(60_000)), "x" * 30_000, "é" * 5000):
        before = len(c.pieces.last)
        assert int(c.count([text])[0]) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(c.pieces.last) - before < 2000


def test_units_searched_together_are_searched_right():
    m = pieces.Model(MODEL)
    rng = random.Random(5)
    units = ["".join(rng.choice("abcdeéß漢😀\x00\t▁the") for _ in range(rng.choice([1, 2, 5, 12, 60]))) for _ in range(800)]
    ids, size = m.best_of([u.encode() for u in units])
    cuts = np.split(ids, np.cumsum(size)[:-1])
    assert all(a.tolist() == m.best(u) for a, u in zip(cuts, units))


def test_texts_cut_into_parts_have_the_same_ids(monkeypatch):
    m = pieces.Model(MODEL)
    texts = [prose(3000, 6), " ".join("ab  c\n" for _ in range(900)), "a▁b " * 500, "z" * 3000, "", " "]
    whole, total, same = m.encode_all(texts)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    monkeypatch.setattr(pieces, "MAX_UNITS", 3)
    again = pieces.Model(MODEL).encode_all(texts)
    assert all((a == b).all() for a, b in zip((whole, total, same), again))
    assert same.tolist() == [m.decode(x.tolist()) == t for x, t in zip(np.split(whole, np.cumsum(total)[:-1]), texts)] and not same[2]


def test_long_texts_against_the_library():
    """The library adds single-precision scores over a whole text: on long ones a few ids differ, their number does not run away."""
    import sentencepiece

    m = pieces.Model(MODEL)
    spec = sentencepiece.sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    text = prose(4000, 7)
    mine, theirs = m.encode_all([text])[0].tolist(), library.encode(text)
    assert m.decode(mine) == text and abs(len(mine) - len(theirs)) <= 0.01 * len(theirs)


def test_negative_ids_are_refused(spark):
    with pytest.raises(Exception, match="0 or more"):
        pieces.decode(spark.createDataFrame([([5, -1],)], "ids array<int>"), MODEL).collect()


# -- others


def test_equal_pieces_are_sorted_once():
    rng = random.Random(6)
    base = [bytes(rng.choice(b"ab") for _ in range(140)) for _ in range(4)]
    parts = [base[rng.randrange(4)] for _ in range(30)]
    keys, firsts = np.array([rng.randrange(8) for _ in parts]), np.array([1000 * i for i in range(30)])
    parts, keys, firsts = parts + parts[:5], np.append(keys, keys[:5]), np.append(firsts, firsts[:5])  # repeated rows

    def starts(found):
        return {(k, s) for k, a, b in zip(*(x.tolist() for x in found)) for s in range(a, b + 1)}

    assert starts(suffix_dedup.distinct_repeats(keys, firsts, parts)) == starts(suffix_dedup.block_repeats(keys, firsts, parts))


def test_benchmarks_of_many_blocks_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    items = {i: prose(25, 50 + i) for i in range(6)}
    bench = spark.createDataFrame(list(items.items()), "item_id int, text string")
    docs = spark.createDataFrame(rows([items[3], prose(30, 99), prose(9, 1) + " " + items[5]]), SCHEMA)
    got = {r["doc_id"]: r["items"] for r in decontaminate.report(docs, bench).collect()}
    assert got == {0: ["3"], 1: [], 2: ["5"]}


def test_scratch_tables_are_dropped(spark):
    import os

    df = stored(spark.range(5), "tmp")
    path = df.scratch_path.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 5
    discard(df)
    assert not os.path.exists(path)


def test_the_pipeline_stands_odd_tables(spark, edge_docs, no_docs, tmp_path):
    import corpus_pipeline as cp

    bench = spark.createDataFrame([(1, prose(40, 1)), (None, None)], "item_id int, text string")
    for name, docs in (("odd", edge_docs), ("none", no_docs)):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in cp.STAGES[:-1]:
            after = f(spark, now, d)
            assert after.columns == docs.columns, stage
            after.write.parquet(f"{d}/{stage}")
            now = spark.read.parquet(f"{d}/{stage}")
        last = cp.STAGES[-1][1](spark, now, d)
        assert last.count() == now.count() == cp.run(spark, d).count()
        assert name == "odd" or last.count() == 0


def test_near_duplicates_take_names_as_keys(spark):
    texts = [prose(200, 1), prose(200, 1) + " end", prose(200, 2), None]
    df = spark.createDataFrame([(f"name-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(df).collect()}
    assert got == {"name-0": "name-0", "name-1": "name-0", "name-2": "name-2", "name-3": "name-3"}
