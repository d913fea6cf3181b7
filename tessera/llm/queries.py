"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from . import decontamination, kneser_ney, licenses, merkle, packing, preference, quality_gbt, quality_rules, secrets, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    ids = F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated", "n_near", F.size("near_items").cast("long").alias("n_near_items"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbt.score(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with planted faults: some bodies have flipped letters, some records are gone."""
    bad = F.pmod("page_id", F.lit(97)) == 13
    gone = F.coalesce(F.pmod("page_id", F.lit(389)) == 7, F.lit(False))
    held = materialise(merkle.archive(table(spark, sf_dir, "pages"), copy=F.when(bad, F.replace("html", F.lit("e"), F.lit("E"))).otherwise(F.col("html"))), "manifest")
    replica = held.where(~gone).select("offset", "length", F.col("copy_digest").alias("digest"))
    return merkle.report(held.drop("copy_digest"), replica)


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.compared(preference.sampled(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return preference.formatted(pairs, shared="shared").select("conv_id", "segment", F.col("whole").alias("n_prefix"), "prompt", "chosen", shown("chosen_spans"), "rejected", shown("rejected_spans"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.fit_and_score(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    of = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"), of(3))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted).select(*columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
    || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10) || {body} || chr(13) || chr(10) || chr(13) || chr(10)"""

OP4_SQL = f"""
WITH told AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b, md5(coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '')) AS h,
    CASE WHEN page_id % 97 = 13 THEN replace(coalesce(html, ''), 'e', 'E') ELSE coalesce(html, '') END AS held
  FROM pages
), recs AS (
  SELECT page_id, {_RECORD.format(body="b")} AS rec, {_RECORD.format(body="held")} AS copy FROM told
), folded AS (
  SELECT page_id, sha256(rec) AS digest, strlen(rec) AS length, sha256(copy) AS copy_digest, count(*) AS copies FROM recs GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(length * copies) OVER (ORDER BY page_id NULLS FIRST, digest, copy_digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM folded
)
SELECT page_id, copies::BIGINT AS copies, "offset", length::BIGINT AS length, digest,
  CASE WHEN page_id % 389 = 7 THEN NULL ELSE copy_digest END AS replica_digest,
  CASE WHEN page_id % 389 = 7 THEN 'missing' WHEN digest <> copy_digest THEN 'corrupt' ELSE 'ok' END AS status
FROM placed
"""

#: The prefix is that of the whole conversation; only what is shown is paged.
OP9_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS n
  FROM told WHERE k = 1
), j AS (
  SELECT conv_id, i, r, x FROM c WHERE i < n
  UNION ALL
  SELECT a.conv_id, a.n, b.r, b.x FROM c a JOIN c b ON b.conv_id = xor(a.conv_id, 1) AND b.i = b.n WHERE a.i = a.n
), d AS (
  SELECT conv_id, coalesce(min(c.i) FILTER (j.r IS NULL OR c.r <> j.r OR c.x <> j.x), max(c.i) + 1) AS p
  FROM c LEFT JOIN j USING (conv_id, i) GROUP BY 1
), sides AS (
  SELECT 'c' AS side, conv_id, i, r, x FROM c UNION ALL SELECT 'j', conv_id, i, r, x FROM j
), shown AS (
  SELECT side, conv_id, i // {preference.SEGMENT} AS segment, i, r, i < p AS shared, '<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) AS t,
    length(r) + 5 AS head
  FROM sides JOIN d USING (conv_id)
), placed AS (
  SELECT *, sum(length(t)) OVER (PARTITION BY side, conv_id, segment, shared ORDER BY i) AS e FROM shown
), text AS (
  SELECT side, conv_id, segment, coalesce(string_agg(t, '' ORDER BY i) FILTER (shared), '') AS prompt,
    coalesce(string_agg(t, '' ORDER BY i) FILTER (NOT shared), '') AS body,
    coalesce(string_agg((e - length(t) + head)::BIGINT || ':' || e::BIGINT, ',' ORDER BY i) FILTER (NOT shared AND r = 'assistant'), '') AS spans
  FROM placed GROUP BY ALL
)
SELECT conv_id, a.segment, p AS n_prefix, a.prompt, a.body AS chosen, a.spans AS chosen_spans,
  coalesce(b.body, '') AS rejected, coalesce(b.spans, '') AS rejected_spans
FROM d JOIN text a USING (conv_id) LEFT JOIN text b ON b.side = 'j' AND b.conv_id = a.conv_id AND b.segment = a.segment
WHERE a.side = 'c'
"""

#: Lower-cased (A-Z) words of the kind that op1 and op2 take.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w, row_number() OVER () AS row_id FROM documents),
i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[k : k + 12] AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sized AS (SELECT DISTINCT len(t) AS n FROM win),
pos AS (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS at0 FROM d),
firsts AS (SELECT DISTINCT t[1] AS f FROM win),
cand AS (SELECT row_id, at0, n, w[at0 : at0 + n - 1] AS t FROM pos JOIN firsts ON w[at0] = f CROSS JOIN sized),
hits AS (SELECT DISTINCT row_id, at0, n, item_id FROM cand JOIN win USING (t) WHERE len(t) = n),
cover AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(at0, at0 + n)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT row_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT row_id, item_id FROM hits) GROUP BY 1),
terms AS (SELECT DISTINCT unnest(t) AS term FROM win),
posted AS (SELECT row_id, at0, w[at0] AS term FROM pos JOIN terms ON w[at0] = term),
freq AS (SELECT term, count(*) AS f FROM posted GROUP BY 1),
wide AS (SELECT t, term, f FROM (SELECT DISTINCT t, unnest(t) AS term FROM win) LEFT JOIN freq USING (term)),
rare AS (SELECT t, arg_min(term, (f, term)) AS term, len(t) - 1 + {decontamination.SLOP} AS reach, count(*) AS m FROM wide GROUP BY t HAVING count(f) = count(*)),
places AS (SELECT row_id, at0, t, m, reach FROM rare JOIN posted USING (term)),
near AS (
  SELECT p.row_id, p.t FROM places p JOIN wide USING (t) JOIN posted o ON o.row_id = p.row_id AND o.term = wide.term AND o.at0 BETWEEN p.at0 - p.reach AND p.at0 + p.reach
  GROUP BY p.row_id, p.t, p.at0, p.m HAVING count(DISTINCT o.term) = p.m
),
close AS (SELECT row_id, count(DISTINCT t) AS n_near, count(DISTINCT item_id) AS n_near_items FROM near JOIN win USING (t) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN cover USING (row_id) LEFT JOIN ids USING (row_id) LEFT JOIN close USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_merkle_audit": OP4_SQL, "op9_preference": OP9_SQL}
