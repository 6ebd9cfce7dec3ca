"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fim, langid, lm, mixing, neardup, negatives, repeats, secrets, tokens, topk, urls, warc
from .common import only, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(spell(of(*base)).cast("binary"), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.decide(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.round_trip(table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def url_rules(spark: SparkSession) -> DataFrame:
    # The listed hosts and paths with their verdicts.
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), url_rules(spark))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5)
    judged = langid.identify(only(docs, "doc_id", "text"), docs.where(~held))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = only(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    other = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", other)
    return negatives.mine(vectors, vectors.where("vec_id % 50 = 0"))


_ALL = (op1_token_counts, op2_secret_scans, op3_mix_sources, op4_warc, op5_class_lm, op6_top_k, op7_decontaminate, op8_url_filter, op9_jaccard_join, op10_language_id)
QUERIES = {f.__name__: f for f in (*_ALL, op11_fill_in_middle, op12_substring_dedup, op13_hard_negatives)}

_WORD = r"[^\x20\x09-\x0D]+"
_DRAW = "(('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
_HEX = "('0x' || substr(h, {}, 8))::BIGINT"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _matches(k: int, rule: secrets.Rule) -> str:
    """For each text the gaps before, the whole and the measured part of every match; the engine has no case folding of ASCII alone, so both cases are spelt."""
    pattern = rule.pattern
    if rule.fold:
        names, rest = pattern[1:].split(")", 1)
        pattern = "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names) + ")" + rest
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT r, {k} AS k, '{rule.kind}' AS kind, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {rule.group}) AS measured, {rule.least} AS least FROM d"


ORACLES = {
    "op2_secret_scans": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k, rule) for k, rule in enumerate(secrets.RULES))}),
u AS (SELECT *, unnest(range(1, len(found) + 1))::INT AS i FROM m),
s AS (SELECT r, k, kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(found[i]) AS n FROM u WHERE length(measured[i]) >= least),
j AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
h AS (SELECT *, md5(array_to_string(s, chr(10))) AS h FROM g),
n AS (SELECT h, any_value(s) AS s, len(any_value(s)) AS size, count(*) AS copies, min(doc_id) AS least FROM h GROUP BY h),
i AS (SELECT h, size, unnest(s) AS shingle FROM n),
p AS (SELECT a.h AS a, b.h AS b FROM i a JOIN i b ON a.shingle = b.shingle AND a.h <> b.h GROUP BY ALL HAVING count(*) >= 0.8 * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
reach AS (SELECT h AS a, h AS b FROM n UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT reach.a AS h, min(n.least) AS class_id FROM reach JOIN n ON reach.b = n.h GROUP BY reach.a),
l AS (SELECT a AS h, count(*) AS links FROM p GROUP BY a)
SELECT doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, copies::BIGINT AS n_copies FROM h JOIN n USING (h) JOIN c USING (h) LEFT JOIN l USING (h)
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM w WHERE len(w) = 0""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS d FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(d, i::INT + 1, 1)) - 1), 4)), 'string_agg', '') AS bits FROM h),
g AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(range(5), lambda j: substr(bits, (5 * i + j)::INT + 1, 1)::INT), lambda a, x: 2 * a + x) + 1, 1)), 'string_agg', '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM m""",
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op3_mix_sources": f"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
c AS (SELECT *, sum(2 * source_size) OVER w AS cut, sum(weight) OVER w AS gone, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER w AS nth
      FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS wanted, sum(weight) AS weights FROM s),
levels AS (SELECT 0 AS nth, wanted / weights AS level FROM t UNION ALL SELECT nth, (wanted - cut::DOUBLE) / (weights - gone) FROM c, t WHERE weights > gone),
chosen AS (SELECT level FROM levels l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.nth > l.nth AND l.level * c.weight > 2 * c.source_size) ORDER BY nth LIMIT 1),
r AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM s),
m AS (SELECT doc_id, size, d.source, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate, {_DRAW} AS number FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
turns AS (SELECT source, i / {mixing.TURNS}.0::DOUBLE AS turn, abs((floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN number + turn - floor(number + turn) < rate - floor(rate) THEN size ELSE 0 END))::DOUBLE - any_value(target)) AS missed FROM m, range({mixing.TURNS}) t(i) GROUP BY source, i),
best AS (SELECT source, turn FROM turns QUALIFY row_number() OVER (PARTITION BY source ORDER BY missed, turn) = 1)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN number + turn - floor(number + turn) < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM m JOIN best ON m.source IS NOT DISTINCT FROM best.source""",
    "op11_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '(?s)[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, {_HEX.format(1)} % (len(u) + 1) AS a, {_HEX.format(9)} % (len(u) + 1) AS b,
      t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_HEX.format(17)} % 100 >= 90 AS plain, {_HEX.format(25)} % 100 < 20 AS spm FROM u),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM i),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, l.gone, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: l.gone IS NULL OR NOT list_contains(l.gone, x[2])), lambda x: x[1]), ' ') AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON b.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3""",
    "op8_url_filter": f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN ('.' || host).ends_with('.example.net') AND path.starts_with('/en/') THEN 'example.net/en/'
                     WHEN ('.' || host).ends_with('.example.com') AND path.starts_with('/de/') THEN 'example.com/de/'
                     WHEN ('.' || host).ends_with('.org') AND path.starts_with('/fr/') THEN 'org/fr/'
                     WHEN ('.' || host).ends_with('.net') AND path.starts_with('/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
