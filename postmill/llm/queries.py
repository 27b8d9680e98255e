"""Registered queries of the operators over the given tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    bpe,
    decontamination,
    fill_in_middle,
    language_model,
    near_dedup,
    personal_data,
    prefix_trie,
    sharding,
    substring_dedup,
    toxicity,
    url_filter,
    warc,
    winnowing,
)
from postmill.llm.common import remainder, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return bpe.code_texts(docs).select(
        "doc_id",
        F.floor(F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        (remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op5_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign(rows, sharding.EIGHT)
    placed = sharding.assign(placed, sharding.grown(sharding.EIGHT, 8), shard="grown_shard")
    return sharding.number(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


_SQL_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
# The given pages hold no canonical links and no refreshes, so their edges lead to normal
# forms alone; a test on a small fixture covers the others.
ORACLES["op5_redirect_filter"] = rf"""
WITH p AS (
  SELECT page_id, url, coalesce({_SQL_HOST}, '') AS host, coalesce({_SQL_PATH}, '') AS path,
    regexp_replace({_SQL_HOST}, '^(www|m)\.', '') || regexp_replace({_SQL_PATH}, '(\.html?|/+)$', '') || '?' ||
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)://[^?#]*\?([^#]*)', 1),
      '(^|&)({url_filter.TRACKING})(=[^&]*)?(&|$)', '\4', 'g'), '^&+', '') AS form
  FROM pages
), rules(kind, h, p) AS (
  VALUES {', '.join(str(r) for r in url_filter.RULES)}
), ruled AS (
  SELECT page_id, first(h || rules.p ORDER BY length(h || rules.p) DESC) AS rule,
    first(kind ORDER BY length(h || rules.p) DESC) AS kind
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
  GROUP BY page_id
), classes AS (
  SELECT form, bool_or(kind = 'allow') AS allowed, bool_or(kind = 'block') AS blocked
  FROM p JOIN ruled USING (page_id) GROUP BY form
)
SELECT page_id, host, path, rule,
  coalesce(kind, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled USING (page_id) LEFT JOIN classes USING (form)
"""



def _captures(pages: DataFrame) -> DataFrame:
    """A crawl that the pages stand for: one full response each, and one not-modified revisit
    whose validators and time follow from a hash of the url."""
    kind = F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1), 16, 10).cast("int")
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    at = F.col("page_id") * 60
    modified = F.concat(F.lit("day "), F.floor(at / 86400).cast("string"))
    base = pages.select("page_id", "url", kind.alias("kind"), digest.alias("digest"), tag.alias("tag"), at.alias("at"), modified.alias("modified"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("length"))
    headers = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for pair in pairs for x in pair))
    responses = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("record_type"), "url", F.col("at").alias("captured"),
        F.col("tag").alias("etag"), F.col("modified").alias("last_modified"), "digest",
        headers(("content-type", "text/html"), ("content-length", F.col("length")), ("cache-control", "max-age=60"), ("etag", F.col("tag"))).alias("headers"),
    )
    etag = (
        F.when(F.col("kind") < 6, F.col("tag")).when(F.col("kind") < 9, F.concat(F.lit("W/"), F.col("tag")))
        .when(F.col("kind") < 11, F.lit('"other"'))
    )
    revisits = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), "url",
        (F.col("at") + F.when(F.col("kind") == 15, -30).otherwise(3600)).alias("captured"),
        etag.alias("etag"), F.when(F.col("kind") < 14, F.col("modified")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        headers(("content-type", "text/plain"), ("content-length", "0"), ("cache-control", "max-age=120"), ("x-cache", F.col("kind").cast("string"))).alias("headers"),
    )
    return responses.union(revisits)


@query
def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve(_captures(table(spark, sf_dir, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(
        "record_id", "canonical", "base_id", "status", "digest", F.array_join(entries, "\n").alias("headers")
    )


_SQL_FORM = rf"""regexp_replace({_SQL_HOST}, '^(www|m)\.', '') || regexp_replace({_SQL_PATH}, '(\.html?|/+)$', '') || '?' ||
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)://[^?#]*\?([^#]*)', 1),
      '(^|&)({url_filter.TRACKING})(=[^&]*)?(&|$)', '\4', 'g'), '^&+', '')"""
ORACLES["op6_revisits"] = rf"""
WITH p AS (
  SELECT page_id, {_SQL_FORM} AS canonical, page_id * 60 AS seen, sha256(coalesce(html, '')) AS digest,
    CAST('0x' || substr(md5(coalesce(url, '')), 1, 1) AS INT) AS kind, 'day ' || (page_id * 60 // 86400) AS modified,
    CAST(strlen(coalesce(html, '')) AS VARCHAR) AS length
  FROM pages
), v AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, kind, seen + CASE WHEN kind = 15 THEN -30 ELSE 3600 END AS seen,
    CASE WHEN kind < 9 THEN substr(digest, 1, 16) WHEN kind < 11 THEN 'other' END AS tag,
    CASE WHEN kind < 14 THEN modified END AS modified
  FROM p
), m AS (
  SELECT v.*, b.page_id * 2 AS base_id, b.digest, b.length,
    CASE WHEN b.page_id IS NULL THEN 'no earlier response'
      WHEN v.tag IS NOT NULL THEN CASE WHEN v.tag = substr(b.digest, 1, 16) THEN 'resolved' ELSE 'validator mismatch' END
      WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = b.modified THEN 'resolved' ELSE 'validator mismatch' END
      ELSE 'no validator' END AS status
  FROM v ASOF LEFT JOIN p b ON v.canonical = b.canonical AND v.seen > b.seen
)
SELECT record_id, canonical, base_id, status, CASE WHEN status = 'resolved' THEN digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || length || chr(10) ||
    'content-type: text/html' || chr(10) || 'etag: "' || substr(digest, 1, 16) || '"' || chr(10) || 'x-cache: ' || kind END AS headers
FROM m
"""


@query
def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


@query
def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), remainder(5) != 1)
    return scored.select(
        "doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    found = personal_data.detect(docs, personal_data.fit(docs))
    kinds = F.array(*map(F.lit, personal_data.KINDS))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(personal_data.KINDS)),
        F.sha2(listed(F.col("found.base")), 256).alias("base_sha256"),
        listed(F.col("found.spans")).alias("spans"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_in_middle.transform(docs).select("doc_id", "fim.*")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("text")).alias("output_sha256"),
        digest(fill_in_middle.restore(F.col("text"), F.col("form"))).alias("restored_sha256"),
    )


ORACLES["op11_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 AS plain,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS spm
  FROM units
), parts AS (
  SELECT doc_id, t, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


# crc32 by bits: one list_reduce over the bytes, one over the eight shifts of each.
_SQL_CRC32 = (
    "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), "
    "lambda crc, byte: list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, byte)), "
    "4294967295), 4294967295)"
)
ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, role_text, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role_text)) AS pos
  FROM (SELECT conv_id, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS role_text,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_SQL_CRC32} % 4 AS h, list({{'t': role_text, 'w': words}} ORDER BY pos) AS own
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns
  FROM c LEFT JOIN c b ON b.conv_id = c.base
), p AS (
  SELECT conv_id, len(turns) AS ended, d.depth, list_transform(turns[1:d.depth], lambda x: x.t) AS path, turns[d.depth].w AS words
  FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS depth) d
), n AS (
  SELECT md5(CAST(path AS VARCHAR)) AS id, any_value(path) AS path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(any_value(words), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended = depth), '')) AS ends_sha256
  FROM p GROUP BY path
), m AS (
  SELECT n.*, CASE WHEN depth > 0 THEN md5(CAST(path[1:depth - 1] AS VARCHAR)) END AS up,
  FROM n
), k AS (SELECT up, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up
), w AS (
  SELECT m.*, coalesce(k.n_children, 0) AS n_children FROM m LEFT JOIN k ON k.up = m.id
), ups AS (
  SELECT md5(CAST(path[1:a.d] AS VARCHAR)) AS id, (n_convs - 1) * words AS saved, n_children = 0 AS leaf
  FROM w, LATERAL (SELECT unnest(range(w.depth + 1)) AS d) a
), s AS (
  SELECT id, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM ups GROUP BY id
)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (id) LEFT JOIN w q ON q.id = w.up
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeats(docs)
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


ORACLES["op13_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM d WHERE len(words) >= 20
), n AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(array_to_string(words[pos:pos + 19], ' ')) ORDER BY doc_id, pos) AS place FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM n WHERE place > 1
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone.pos IS NULL) AS n_kept, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) LEFT JOIN gone USING (doc_id, pos)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
