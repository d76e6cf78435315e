"""The queries op1 to op13 and their SQL: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import exact_dedup, filter_audit, langid, media, mixing, ngram_join, packing, pii, quality, sharding, spelling, suffix_dedup, url_filter
from lumenforge.sources.tables import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its id: bad if of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), labels)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), key="op9")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_media, op4_ngram_join, op5_langid, op6_mixing, op7_url_filter, op8_sharding, op9_pii, op10_exact_dedup, op11_filter_audit, op12_quality, op13_spelling)}

_MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|mix') AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, encode(source))),
free AS (
  SELECT lvl FROM levels WHERE cap::DOUBLE / w > lvl ORDER BY cap::DOUBLE / w, source IS NULL, encode(source) LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap::DOUBLE / w <= lvl THEN cap::DOUBLE ELSE (SELECT lvl FROM free) * w END AS target
  FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows),
cut AS (
  SELECT p.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM cut
"""

_URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
bare AS (
  SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS b FROM urls),
parts AS (
  SELECT *, string_split(b, '.') AS l,
         CASE WHEN len(string_split(b, '.')) >= 2 AND regexp_matches(b, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN 2 ELSE 1 END AS d
  FROM bare),
named AS (
  SELECT page_id, host, path, array_to_string(l[greatest(len(l) - d + 1, 1):], '.') AS suffix,
         CASE WHEN regexp_matches(b, '^[0-9]+(\.[0-9]+){3}$') THEN b ELSE array_to_string(l[greatest(len(l) - d, 1):], '.') END AS domain
  FROM parts),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND ((quality = 0 OR toxic = 1) IS NOT NULL) GROUP BY doc_id),
h AS (SELECT suffix, domain, host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM named JOIN marks ON page_id = doc_id GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
w AS (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS m0 FROM s),
sums AS (
  SELECT 'suffix' AS lv, count(*)::DOUBLE AS g, sum(n) AS t, sum(k) AS k, sum(n * n) AS t2, sum(k * k / n) AS kp FROM s
  UNION ALL SELECT 'domain', count(*), sum(n), sum(k), sum(n * n), sum(k * k / n) FROM d
  UNION ALL SELECT 'host', count(*), sum(n), sum(k), sum(n * n), sum(k * k / n) FROM h),
ms AS (
  SELECT lv, g, t, CASE WHEN g > 1 AND t > g THEN (kp - k * k / t) / (g - 1) END AS msb,
         CASE WHEN g > 1 AND t > g THEN (k - kp) / (t - g) END AS msw, CASE WHEN g > 1 THEN (t - t2 / t) / (g - 1) END AS n0 FROM sums),
conc AS (
  SELECT lv, 1 / least(greatest(CASE WHEN msb + (n0 - 1) * msw > 0 THEN (msb - msw) / (msb + (n0 - 1) * msw) ELSE 0.1 END, 0.02), 0.98) - 1 AS c FROM ms),
hosts AS (SELECT DISTINCT host, domain, suffix FROM named),
c AS (SELECT (SELECT c FROM conc WHERE lv = 'suffix') AS cs, (SELECT c FROM conc WHERE lv = 'domain') AS cd, (SELECT c FROM conc WHERE lv = 'host') AS ch, m0 FROM w),
post AS (
  SELECT hosts.host, coalesce(h.n, 0) AS n, coalesce(h.k, 0) AS k, coalesce(h.n, 0) + ch AS strength,
         (coalesce(h.k, 0) + ch * (coalesce(d.k, 0) + cd * (coalesce(s.k, 0) + cs * m0) / (coalesce(s.n, 0) + cs)) / (coalesce(d.n, 0) + cd)) / (coalesce(h.n, 0) + ch) AS mean
  FROM hosts LEFT JOIN s USING (suffix) LEFT JOIN d USING (suffix, domain) LEFT JOIN h USING (suffix, domain, host) CROSS JOIN c),
ruled AS (
  SELECT named.*, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN mean - 1.64 * sqrt(mean * (1 - mean) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       n::BIGINT AS n_labelled, k::BIGINT AS n_bad
FROM ruled JOIN post USING (host)
"""

_EXACT_SQL = """
WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW g AS (PARTITION BY norm)
"""

_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM d),
kinds AS MATERIALIZED (
  SELECT part, fails, len(list_filter(fails, lambda x: x)) AS failed, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda i: chr(64 + i)), '') AS filter_order, i AS step, o[i] AS own, o[1:i - 1] AS earlier FROM orders, letters),
met AS (
  SELECT part, filter_order, step, own, n, g, x, failed, fails[own] AS hit, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone FROM kinds, steps),
done AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND hit THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN x ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM done
"""

_SPELLING_SQL = r"""
WITH RECURSIVE
crc AS (SELECT [list_reduce([i] || range(8)::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) FOR i IN range(256)] AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY id, run),
digits AS (SELECT id, run, n, [(strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 FOR i IN range(len(x) // 2)]::BIGINT[] AS b FROM kinds),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || b, lambda c, y: xor(t[xor(c, y) % 256 + 1], c // 256))) AS h FROM digits, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
ranked AS (SELECT a, b, n AS m, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words ON word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) = 1),
forms AS MATERIALIZED (
  SELECT word, CASE WHEN m >= 2 * n THEN b END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN ranked ON a = word),
walk AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, w.root FROM walk w JOIN forms f ON f.form = w.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN walk USING (word)
"""

ORACLES = {"op11_filter_audit": _AUDIT_SQL, "op13_spelling": _SPELLING_SQL, "op6_mixing": _MIX_SQL, "op7_url_filter": _URL_SQL, "op10_exact_dedup": _EXACT_SQL}
