"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, lexical_search, mixing, near_dup, packing, periodic, pii, piece_codes, quality_classifier, quality_rules, token_store, url_filter
from .tokens import byte_bpe_path

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the URL query: host, path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Listed labels of the URL query: names of sites for advertising, gambling, pharmacy and adult spam, blocked under
#: every domain where no rule fits. A parameter of the query, chosen by what the names say.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def pii_key(spark: SparkSession) -> bytes:
    """The secret key of surrogates: the session's setting skeinrank.pii.key.

    Without it a random one is drawn and set, so that one session's surrogates agree and nobody else can tell them from guessed values; those of
    two sessions then differ.
    """
    key = spark.conf.get("skeinrank.pii.key", "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("skeinrank.pii.key", key)
    return key.encode()[:64]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(_table(spark, sf_dir, "documents"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"), byte_bpe_path(), end_id=2)


def op5_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe_path(), end_id=0, length=1024)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_table(spark, sf_dir, "documents"), near_dup.NearDup(shingle=3, percent=85))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    labels = spark.createDataFrame([(x,) for x in LISTED_LABELS], "label string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules, labels)


def op8_html_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(_table(spark, sf_dir, "documents"), pii_key(spark))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.planted(_table(spark, sf_dir, "documents")), least=12))


def op12_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes.digests(piece_codes.encode(_table(spark, sf_dir, "documents"), piece_codes.piece_model_path()))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), lexical_search.Lexical(k=50))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_source_mixing, op2_adaptive_ann, op3_quality_rules, op4_token_codes, op5_tree_packing, op6_near_duplicates, op7_url_cascade, op8_html_labeller, op9_pii_surrogates, op10_pu_quality, op11_periodic_runs, op12_piece_codes, op13_dual_tree_search, pipeline)}

_OP1 = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS total FROM s GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * total AS cap FROM per),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS k FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
l AS (SELECT arg_min(level, k) AS level FROM (SELECT k, (1.5 * (SELECT sum(total) FROM per)::DOUBLE - held) / open AS level, cap / weight AS r FROM c) WHERE level < r),
t AS (SELECT source AS t_source, total, least(cap, weight * coalesce((SELECT level FROM l), 1e300)) AS target FROM w),
r AS (SELECT s.*, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0 END AS rate FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.t_source),
u AS (SELECT r.*, rate - floor(rate) AS f, seed, ('0x' || substr(md5(seed || '|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(source, '~') || '|' || h), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM r, range(17, 33) x(seed)),
m AS (SELECT source AS m_source, seed, abs(floor(any_value(rate)) * any_value(total) + sum(CASE WHEN u < f THEN size ELSE 0 END) - any_value(target)) AS miss FROM u GROUP BY source, seed),
b AS (SELECT m_source, seed AS b_seed, row_number() OVER (PARTITION BY m_source ORDER BY miss, seed) AS k FROM m)
SELECT doc_id, size, total AS source_size, round(target, 6) AS target, (size * (floor(rate) + CASE WHEN u < f THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.m_source AND u.seed = b.b_seed AND b.k = 1
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, m.component_id = n.doc_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id
"""

_OP7 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, u.host, u.path, m.rule,
  coalesce(m.v, CASE WHEN list_has_any(string_split(u.host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""

_OP13 = r"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, t, len(t)::BIGINT AS own FROM (SELECT doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents) WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(own)::BIGINT AS total FROM s),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM s) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), g),
p AS (SELECT f.r, s.doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * own * docs) // total)) AS part FROM f JOIN s ON f.r = s.r, g),
c AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * part)::BIGINT AS score FROM i JOIN w ON i.term = w.term JOIN p ON p.term = w.term GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {"op1_source_mixing": _OP1, "op6_near_duplicates": _OP6, "op7_url_cascade": _OP7, "op13_dual_tree_search": _OP13}
