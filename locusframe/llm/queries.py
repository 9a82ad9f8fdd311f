"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import ann, collocations, decontaminate, html_extract, lang_id, lexical, lm_score, mixing, quality, quality_rules, simhash, toxicity, warc
from locusframe.llm.common import cut, fold, table


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = lang_id.fit(docs.where("not held_out").select("doc_id", "text", "lang"))
    found = lang_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix by weights 3, 1, 2 takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.components(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside remainder 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = quality.fit(cut(quality.sample(docs, labels)))
    found = quality.score(docs, model)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    model = toxicity.fit(docs.where("not held_out"), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    found = toxicity.score(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned outside remainder 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return lm_score.score(docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand inside a 10-word window of a benchmark item."""
    found = decontaminate.digest(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.where(F.col("id") % 20 == 0), k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture record of the pages, revisits resolved to the responses they stand for."""
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    head = [F.col("merged_headers")[h].alias("h_" + h.replace("-", "_")) for h in ("date", "etag", "expires", "cache-control", "content-length", "content-type")]
    return found.select("record_id", "url_key", "ts", "state", "response_id", "response_ts", "merged_digest", *head)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2 000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether the fixed rules and the trees keep it."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    found = quality_rules.judge(docs.select("doc_id", "text"), model)
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.col("rule_score").alias("score"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lang_id": op1_lang_id,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_lm_score": op6_lm_score,
    "op7_decontamination": op7_decontamination,
    "op8_ann": op8_ann,
    "op9_warc": op9_warc,
    "op10_html_extract": op10_html_extract,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_lexical_search": op13_lexical_search,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES: dict[str, str] = {
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s+9], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
m AS (SELECT doc_id, p, dp.n, item_id FROM dp JOIN iw ON dp.n = iw.n AND array_to_string(dp.w[p:p+dp.n-1], ' ') = iw.k),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
""",
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
f AS (SELECT lang, k, g, count(*) AS c FROM (
        SELECT lang, k, array_to_string(w[s:s+k-1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k))
      GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
d AS (SELECT lang, k, g AS phrase, c AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND c >= 10),
cut AS (SELECT lang, phrase, a, k, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j+1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM d)),
sc AS (SELECT c.lang, c.phrase, c.a, c.j, fx.c AS l, fy.c AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(fx.c AS HUGEINT) * fy.c) AS BIGINT) AS score
       FROM cut c JOIN f fx ON c.lang = fx.lang AND fx.k = c.j AND fx.g = c.x JOIN f fy ON c.lang = fy.lang AND fy.k = c.k - c.j AND fy.g = c.y),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM d WHERE k = 3) GROUP BY lang, g)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n.n, score
FROM b JOIN n ON b.lang = n.lang LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.g
WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
    "op13_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(len(w)) AS HUGEINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS t FROM benchmark),
tf AS (SELECT k, t, count(*) AS f FROM (SELECT k, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY k, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * CAST((SELECT n FROM s) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY t),
m AS (SELECT k, doc_id, CAST(50 + (50 * len(w) * s.n) // s.l AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, m.k, m.doc_id, CAST(sum(w.w * ((1000000000 * f) // (1000 * f + 20 * m.m))) AS BIGINT) AS score
      FROM q JOIN tf ON q.t = tf.t JOIN w ON w.t = q.t JOIN m ON m.k = tf.k GROUP BY item_id, m.k, m.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id AS i, url, coalesce(html, '') AS html, 1704067200 + (page_id * 7919) % 2592000 AS t0, page_id % 5 AS kind,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         regexp_replace(trim(url), '#.*', '') AS bare
  FROM pages WHERE page_id IS NOT NULL),
u AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS base,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|ref|sessionid|phpsessid)(=.*)?$'))), '&') AS q
  FROM p),
h AS (
  SELECT *, regexp_replace(base, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//', '') AS rest FROM u),
k AS (
  SELECT *, CASE WHEN url IS NOT NULL AND regexp_extract(rest, '^([^/]*)', 1) <> ''
           AND NOT (rest = base AND regexp_matches(rest, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT regexp_matches(rest, '^[^/:]+:[0-9]+(/|$)')) THEN
         regexp_replace(lower(regexp_extract(rest, '^([^/]*)', 1)), '^www\\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/]*(.*)', 1), '/index\\.html?$', '/'), '/+$', '')
         || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_key,
         CASE WHEN kind = 1 THEN 'W/' || tag WHEN kind = 2 THEN '"another"' WHEN kind >= 3 THEN NULL ELSE tag END AS seen,
         CASE WHEN kind = 4 THEN t0 - 90000 ELSE t0 - 86400 END AS since
  FROM h),
full_ AS (
  SELECT 'response-' || i AS record_id, url_key, t0 AS ts, tag AS etag, t0 - 86400 AS lm, sha1(html) AS digest, length(html) AS n FROM k),
rev AS (
  SELECT 'revisit-' || i AS record_id, url_key, t0 + 3600 AS ts, seen AS etag, since AS lm, t0 + 3600 AS h_date, 'max-age=600' AS h_cc,
         t0 + 7200 AS h_exp FROM k
  UNION ALL
  SELECT 'early-' || i, url_key, t0 - 60, NULL, NULL, t0 - 60, NULL, NULL FROM k),
j AS (
  SELECT v.*, f.record_id AS r_id, f.ts AS r_ts, f.etag AS r_tag, f.lm AS r_lm, f.digest AS r_digest, f.n AS r_n,
         row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS rn
  FROM rev v LEFT JOIN full_ f ON v.url_key = f.url_key AND f.ts <= v.ts),
s AS (
  SELECT *, CASE WHEN url_key IS NULL THEN 'no_url' WHEN r_id IS NULL THEN 'no_response'
         WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r_tag THEN 'resolved' ELSE 'mismatch' END
         WHEN lm IS NOT NULL THEN CASE WHEN lm >= r_lm THEN 'resolved' ELSE 'mismatch' END
         ELSE 'unchecked' END AS state
  FROM j WHERE rn = 1)
SELECT record_id, url_key, ts, 'response' AS state, record_id AS response_id, ts AS response_ts, digest AS merged_digest,
       CAST(ts AS VARCHAR) AS h_date, etag AS h_etag, CAST(NULL AS VARCHAR) AS h_expires, 'max-age=60' AS h_cache_control,
       CAST(n AS VARCHAR) AS h_content_length, 'text/html' AS h_content_type
FROM full_
UNION ALL
SELECT record_id, url_key, ts, state, CASE WHEN ok THEN r_id END, CASE WHEN ok THEN r_ts END, CASE WHEN ok THEN r_digest END,
       CAST(h_date AS VARCHAR), CASE WHEN ok THEN coalesce(etag, r_tag) ELSE etag END, CAST(h_exp AS VARCHAR),
       CASE WHEN ok THEN coalesce(h_cc, 'max-age=60') ELSE h_cc END, CASE WHEN ok THEN CAST(r_n AS VARCHAR) ELSE '0' END,
       CASE WHEN ok THEN 'text/html' END
FROM (SELECT *, state IN ('resolved', 'unchecked') AS ok FROM s)
""",
}
