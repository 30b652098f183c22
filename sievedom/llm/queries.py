"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html_main, licenses, lm, merkle, mixing, negatives, ngram_join, packing, pii, quality, secrets, tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_docs(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "whole", "extra")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir)).drop("row_id").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_docs(spark, sf_dir)).drop("row_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_docs(spark, sf_dir)).drop("row_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_docs(spark, sf_dir))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *[c for c in out.columns if c not in first and c != "row_id"])


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_docs(spark, sf_dir))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to n_chars where 7 divides the CRC of the id."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return merkle.merkle_manifest(_docs(spark, sf_dir), claims={"n_chars": tampered})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_docs(spark, sf_dir))


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 counts: sizes of documents and sources, which stay below a source's target only by its cap."""
    m = mixing.mix_sources(_docs(spark, sf_dir))
    return m.select("doc_id", "size", "source_size", (F.col("target") <= 3 * F.col("source_size") + 0.5).alias("under_cap"), (F.col("taken") <= 3 * F.col("size")).alias("under_epochs"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7."""
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op8."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5 that a regular expression alone can say."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


QUERIES = {"op1_mix": op1_mix, "op2_exact_dedup": op2_exact_dedup, "op3_licenses": op3_licenses, "op4_ngram_join": op4_ngram_join, "op5_pii": op5_pii, "op6_main_text": op6_main_text, "op7_quality": op7_quality, "op8_secrets": op8_secrets, "op9_lm": op9_lm, "op10_pack": op10_pack}
QUERIES |= {f.__name__: f for f in (op11_merkle, op12_hard_negatives, op13_token_counts)}
QUERIES |= {f.__name__: f for f in (mix_sizes, quality_base, license_base, secret_base, pii_base)}

ORACLES = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
""",
    "op11_merkle": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, crc32 % 7 = 0 AND n_chars IS NOT NULL AS bad,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS e
  FROM (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda y: [ascii(y), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
      lambda y, z: CASE WHEN z >= 0 THEN xor(y, z) ELSE xor(y >> 1, (y & 1) * 3988292384) END)) AS crc32 FROM documents)
),
x AS (SELECT r, doc_id, lang, sha256(a || b || e) AS leaf, CASE WHEN bad THEN sha256(a || c || e) END AS claim FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM x),
t AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
),
subs AS (SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n
),
whole AS (SELECT h AS root, lvl AS top FROM u WHERE n = 1),
q AS (SELECT p.*, subs.subroot, subs.height, subs.pos AS place, root, top FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, whole),
steps AS (
  SELECT r, lvl, xor(pos >> lvl, 1) AS at, (pos >> lvl) & 1 AS side, false AS over, q.lang FROM (SELECT *, unnest(range(height)) AS lvl FROM q) AS q
  UNION ALL SELECT r, height + lvl, xor(place >> lvl, 1), (place >> lvl) & 1, true, NULL FROM (SELECT *, unnest(range(top)) AS lvl FROM q)
),
path AS (
  SELECT r, steps.lvl, side, t.h FROM steps LEFT JOIN t ON steps.lang IS NOT DISTINCT FROM t.lang AND steps.lvl = t.lvl AND steps.at = t.pos WHERE NOT over
  UNION ALL SELECT s.r, s.lvl, side, u.h FROM steps s JOIN q ON s.r = q.r LEFT JOIN u ON s.lvl - q.height = u.lvl AND s.at = u.pos WHERE over
),
proof AS (SELECT r, string_agg(h, '' ORDER BY lvl) AS s FROM path GROUP BY r),
f AS (
  SELECT r, 0::BIGINT AS lvl, claim AS h FROM q WHERE claim IS NOT NULL
  UNION ALL SELECT f.r, f.lvl + 1, sha256(CASE WHEN path.h IS NULL THEN f.h WHEN side = 1 THEN path.h || f.h ELSE f.h || path.h END) FROM f JOIN path ON f.r = path.r AND f.lvl = path.lvl
),
folded AS (SELECT r, arg_max(h, lvl) AS h FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(s, '')) AS proof_sha256, coalesce(folded.h, root) AS folded_root, folded.h IS NULL OR folded.h = root AS verified
FROM q LEFT JOIN proof USING (r) LEFT JOIN folded USING (r)
""",
    "op12_hard_negatives": r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM documents_v
),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""".replace("documents_v", "embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"),
    "mix_sizes": r"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
SELECT doc_id, size, (sum(size) OVER (PARTITION BY source))::BIGINT AS source_size, true AS under_cap, true AS under_epochs FROM n
""",
    "quality_base": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
inside AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM again) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN inside USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
""",
    "license_base": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT r, i - 1 AS place, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl'
    WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label FROM p
),
f AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN f USING (r)
""",
    "secret_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM d
""",
    "pii_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR try_cast(y AS INTEGER) > 255)) = 0))::BIGINT AS n_ip,
len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM d
""",
}
