"""The ten operators as queries over the given tables, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, exactdedup, hilbert, jaccard, langid, mixing, pii, quality, secrets, spelling, tokenfiles, warc, whitening
from tessera.llm.common import repeated, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = quality.judge(table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return repeated(mixture, F.col("copies")).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), 24).drop("cell")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.predict(rows, model, ["doc_id", "held_out"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"), 8)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the range of ids is the history that is indexed, the newer half is admitted against it."""
    return exactdedup.dedup(table(spark, sf_dir, "documents"))


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)),
hit AS (SELECT r, i, n, win FROM dw WHERE (n, win) IN (SELECT (n, win) FROM bw)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM (SELECT DISTINCT r, n, win FROM hit) JOIN bw USING (n, win)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

ORACLES["op3_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {SPACE_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS letter_words, coalesce(list_max(map_values(list_histogram(w))), 0) AS common,
    len(regexp_extract_all(text, '(?:^|\n)[\x20\t]*[-*•]\x20')) AS bullets, len(regexp_extract_all(text, '(?:\.\.\.|…)[\x20\t\r]*(?:\n|\z)')) AS ellipses
  FROM d LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars / greatest(n_words, 1) < 1.5 OR word_chars / greatest(n_words, 1) > 25.0
    OR n_symbols > 0.3 * n_words OR n_dup_lines > 0.5 * n_lines OR letters < 0.4 * word_chars
    OR letter_words < 0.5 * n_words OR common > 0.3 * n_words OR (n_lines >= 3 AND (bullets > 0.9 * n_lines OR ellipses > 0.5 * n_lines))) AS kept
FROM j
"""

ORACLES["op4_mixing"] = r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS w,
    (CAST(('0x' || md5(CAST(d.doc_id AS VARCHAR) || ':17')[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d LEFT JOIN l USING (doc_id)),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS sw FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / sw AS fill FROM s),
o AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(sw) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM c),
g AS (SELECT *, lft * sw / lw >= cap AS isfull FROM o),
t AS (SELECT source, source_size, CASE WHEN isfull THEN cap ELSE least(cap, (SELECT arg_min(lft / lw, fill) FROM g WHERE NOT isfull) * sw) END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS ep FROM t),
p AS (
  SELECT doc_id, d.size, source_size, target, ep, target - ep * source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0 AS mid
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (ep + CASE WHEN mid <= rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""

ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""

#: Words by their checksum (CRC-32 over the bytes of UTF-8, by its polynomial), near pairs by what is left without one code point,
#: chains of forms by recursion.
ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT d, w, count(*) AS k FROM runs WHERE length(w) >= 6 GROUP BY ALL),
h AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(d || ':' || w, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM own, crc),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gap AS (SELECT word, n, length(word) AS l, i, w1 || '_' || w2 AS hole, w1 || w2 AS less FROM (SELECT word, n, i, word[:i] AS w1, word[i + 2:] AS w2 FROM (SELECT *, unnest(range(length(word))) AS i FROM v))),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gap a JOIN gap b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gap g JOIN v ON g.less = v.word
  UNION SELECT v.word, g.word, g.n FROM gap g JOIN v ON g.less = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS cur FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.cur WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, cur FROM walk JOIN f ON f.word = walk.cur WHERE f.form IS NULL)
SELECT f.word, form, ends.cur AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends ON ends.word = f.word
"""

ORACLES["op13_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_language_id": op9_language_id,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
}
