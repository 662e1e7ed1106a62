"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, languages, licenses, near_duplicates, pieces, quality, shards, suffix_dedup, token_counts, warc
from .common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m, bad = F.col("m"), quality.base_failed(F.col("m"))
    return scored.select(
        "doc_id",
        *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        bad.alias("base_failed"),
        (F.col("kept") & ~bad).alias("kept"),
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

_OP6 = rf"""
with w as (
  select doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls
  from documents),
g as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, k) > 1),
c as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from r) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) in ({_STOPS})))::double as n_stop,
    greatest(len(ws), 1)::double as nw, greatest(len(ls), 1)::double as nl,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t-\r]*[-*•]')))::double as n_bullet,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$')))::double as n_dots
  from w left join c on w.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and word_chars / nw between 2 and 15 and n_symbols / nw <= 0.3 and n_stop / nw >= 0.02
    and n_dup_lines / nl <= 0.5 and n_bullet / nl <= 0.9 and n_dots / nl <= 0.3 as kept
from m
"""


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.col("license_hits")
    return found.select(
        "doc_id",
        F.array_join(F.transform(h, lambda x: x["license"]), ",").alias("licenses"),
        F.size(h).cast("long").alias("n_licenses"),
        F.coalesce(F.array_max(F.transform(h, lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def _op7_sql() -> str:
    def row(name: str, text: str) -> str:
        grams = licenses.bigrams(text)
        return "('{}', {}, {}, {}, [{}])".format(name, len(grams), *licenses.bounds(len(grams)), ", ".join(f"'{g}'" for g in grams))

    rows = ", ".join(row(k, t) for k, t in sorted(licenses.TEMPLATES.items()))
    return rf"""
with t(license, b, need, most, gs) as (values {rows}),
g as (select license, b, need, most, unnest(gs) as g from t),
d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
x as (select doc_id, i, w[i] || ' ' || w[i + 1] as g from (select doc_id, w, unnest(range(1, len(w))) as i from d)),
h as (select doc_id, license, b, need, most, i, x.g from x join g on x.g = g.g),
r as (select *, row_number() over o as k, coalesce(lag(i) over o <> i - 1, true) as opens, coalesce(lead(i) over o <> i + 1, true) as closes, lead(i) over o as nxt
  from h window o as (partition by doc_id, license order by i)),
p as (select s.doc_id, s.license, s.b, s.i as lo, e.i as hi from r s join r e on s.doc_id = e.doc_id and s.license = e.license
  where s.opens and e.i >= s.i and e.i - s.i < s.most and e.k - s.k + 1 >= s.need
    and (e.closes or (e.i - s.i < s.b and coalesce(e.nxt - s.i >= s.b, true)))),
q as (select p.doc_id, p.license, p.lo, p.hi, 2.0::double * count(distinct h.g) / (any_value(p.b) + p.hi - p.lo + 1) as dice
  from p join h on h.doc_id = p.doc_id and h.license = p.license and h.i between p.lo and p.hi group by p.doc_id, p.license, p.lo, p.hi),
m as (select doc_id, license, max(dice) as dice from q where dice >= {licenses.THRESHOLD} group by doc_id, license),
a as (select doc_id, string_agg(license, ',' order by license) as licenses, count(*) as n, max(dice) as dice from m group by doc_id)
select d.doc_id, coalesce(licenses, '') as licenses, coalesce(n, 0)::bigint as n_licenses, coalesce(dice, 0.0)::double as best_dice from d left join a on d.doc_id = a.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    slim = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shards.interleave(slim, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_OP3 = f"""
with h as (
  select doc_id, source, coalesce(text, '') as text, md5('17:' || coalesce(doc_id::varchar, '')) as h,
    ('0x' || md5('17/' || coalesce(source, ''))[1:13])::bigint / 4503599627370496.0::double as u from documents),
r as (select *, (row_number() over (partition by source order by h, doc_id) - 1 + u) / count(*) over (partition by source) as pl from h),
g as (select *, row_number() over (order by pl, source, h, doc_id) - 1 as g, count(*) over () as n from r),
s as (select *, g * 8 // n as shard from g),
bytes as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b from h)
select s.doc_id, (strlen(text) + 1)::bigint as size,
  xor(list_reduce(b, lambda a, x: xor(a >> 8, ({_crc_table()}::bigint[])[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295::bigint)::bigint as text_crc32,
  'rows' as law, shard::int as shard, (g - (shard * n + 7) // 8)::bigint as slot, null::int as grown_shard, source
from s join bytes on s.doc_id = bytes.doc_id
"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, vocabulary("piece_bpe_32k.model"), check=True)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return coded.select("doc_id", size.alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), "round_trip", "ids")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "pages"), languages.fit(table(spark, sf_dir, "documents")))


_WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP4 = f"""
with d as (select doc_id, {_WORDS4} as w from documents),
b as (select item_id, {_WORDS4} as w from benchmark),
n as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
g as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from n)),
s as (select distinct n from n),
x as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, s where len(w) >= n)),
h as (select doc_id, item_id, i, x.n from x join g on x.n = g.n and x.g = g.g),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as items from (select distinct doc_id, item_id::varchar as k from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


_B32 = " || ".join(
    f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || d[{i + 1}:{i + 10}])::bigint >> {35 - 5 * k}) & 31)::int + 1]" for i in range(0, 40, 10) for k in range(8)
)
_OP8 = f"""
with p as (select page_id, sha1(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, n as payload_bytes, {_B32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to from p
"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents")).drop("runs")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scans": op7_license_scans,
    "op8_warc": op8_warc,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_counts": op10_token_counts,
}
ORACLES = {"op3_sharding": _OP3, "op4_decontamination": _OP4, "op6_quality_rules": _OP6, "op7_license_scans": _op7_sql(), "op8_warc": _OP8}
