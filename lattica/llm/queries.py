"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, licenses, line_dedup, mixing, neardup, quality, secrets, spelling, token_counts, toxicity, warc


#: What conversation -7 says: both control strings and the escape.
_TRAP = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", neardup.fingerprint_hex(found.fp).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.rollup(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.score(table(spark, sf_dir, "documents")).select("doc_id", *counts, "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("gone").alias("n_gone"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("gone_lines"), F.sha2("text", 256).alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(_TRAP)
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.round_trip(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (op1_source_mixing, op2_license_scan, op3_warc_bundles, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_token_counts, op7_secret_scan, op8_quality_rules, op9_line_dedup, op10_toxicity, op11_spelling_variants, op12_chat_formatting, op13_centroid_clustering)
}

_LIST = ", ".join(f"({i}, '{label}', {tokens}, {need})" for i, (label, tokens, need) in enumerate(licenses.as_sets(licenses.TEMPLATES)))
_STARTS = {p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(" "))) for p in licenses.PHRASES}
_LICENSES = (
    r"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
b AS (SELECT doc_id, len(w) AS n_words, """
    + ", ".join(f"[i - 1 FOR i IN range(1, len(w) + 1) IF {hit}] AS p{k}" for k, hit in enumerate(_STARTS.values()))
    + r""" FROM w),
c AS (SELECT doc_id, n_words, """
    + "list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS p, "
    + "list_filter(["
    + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values()))
    + r"""], lambda x: x IS NOT NULL) AS base FROM b),
l AS (SELECT doc_id, block, list_distinct(string_split_regex(line, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS block FROM d)),
tt(template, label, tokens, need) AS (VALUES """
    + _LIST
    + """),
m AS (SELECT doc_id, block, label, len(list_intersect(s, tokens)) / len(tokens) AS c FROM l, tt WHERE len(list_intersect(s, tokens)) >= need),
a AS (SELECT doc_id, list_distinct(list(label)) AS more, max(c) AS best, count(DISTINCT block) AS n_blocks FROM m GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, []::VARCHAR[])))), ',') AS labels, CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM c LEFT JOIN a USING (doc_id)"""
)

_WARC = """WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact FROM k"""

_M = quality.MEASURES
_EDGE = "min(coalesce(pow(" + str(quality._GAMMA) + "::DOUBLE, bin - {1}), 0)) FILTER (1000 * upto >= q{0} * total)"
_QUALITY = (
    r"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
v AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN v USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_ratio, word_chars / greatest(n_words, 1) AS word_length, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio FROM c),
q(measure, q0, q1) AS (VALUES """
    + ", ".join(f"('{k}', {'NULL' if low is None else low}, {high})" for k, (low, high) in _M.items())
    + """),
u AS ("""
    + " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS x FROM m WHERE NOT base_failed" for k in _M)
    + f"""),
b AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / ln({quality._GAMMA}::DOUBLE)) END AS bin, count(*) AS n FROM u GROUP BY ALL),
own AS (SELECT lang, source, measure, bin, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM b),
every AS (SELECT measure, bin, sum(n) OVER (PARTITION BY measure ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY measure) AS total FROM (SELECT measure, bin, sum(n) AS n FROM b GROUP BY ALL)),
o AS (SELECT lang, source, measure, {_EDGE.format(0, 1)} AS lo, {_EDGE.format(1, 0)} AS hi, max(total) AS total FROM own JOIN q USING (measure) GROUP BY ALL),
e AS (SELECT measure, {_EDGE.format(0, 1)} AS e_lo, {_EDGE.format(1, 0)} AS e_hi FROM every JOIN q USING (measure) GROUP BY ALL),
f AS (SELECT lang, source, measure, (total * lo + {quality.PRIOR} * e_lo) / (total + {quality.PRIOR}) AS lo, (total * hi + {quality.PRIOR} * e_hi) / (total + {quality.PRIOR}) AS hi FROM o JOIN e USING (measure))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed"""
    + "".join(f" AND {k} <= {k}_.hi" + (f" AND {k} >= {k}_.lo" if low is not None else "") for k, (low, _) in _M.items())
    + ", false) AS kept FROM m"
    + "".join(f" LEFT JOIN f {k}_ ON {k}_.measure = '{k}' AND {k}_.lang IS NOT DISTINCT FROM m.lang AND {k}_.source IS NOT DISTINCT FROM m.source" for k in _M)
)

_SPELLING = f"""WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[a-z\u00C0-\u00FF]+')) AS run FROM d) WHERE length(run) >= {spelling.LENGTH} GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END)) AS b FROM runs),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda e, z: xor(e >> 1, 3988292384::BIGINT * (e & 1))))), 4294967295::BIGINT) AS h FROM bytes),
typed AS (SELECT CASE WHEN h % {spelling.DELETED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(n) >= {spelling.OCCURRENCES}),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
once AS (SELECT DISTINCT word, n, short FROM cut),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b USING (i, short) WHERE a.word <> b.word AND length(a.word) = length(b.word)
 UNION ALL SELECT v.word, once.word, once.n FROM once JOIN v ON v.word = once.short UNION ALL SELECT once.word, v.word, v.n FROM once JOIN v ON v.word = once.short),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS most FROM near GROUP BY word),
j AS MATERIALIZED (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.FORM} * v.n THEN other END AS form, CASE WHEN most >= {spelling.FORM} * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS reached, 1 AS step FROM j WHERE form IS NOT NULL UNION ALL SELECT chain.word, j.form, step + 1 FROM chain JOIN j ON j.word = chain.reached WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM j LEFT JOIN ends USING (word)"""

_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_TRAP}'), (-7, 1, 'assistant', '{_TRAP}')),
e AS (SELECT *, {len(chat.HEAD + chat.ROLE_END + chat.END) + 2} + length(replace(replace(replace(replace(role, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>'), ':', '\\:')) + length(replace(replace(replace(text, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_D = centroids.DIMENSIONS


def _assigned(k: int) -> str:
    """The vectors with their nearest centroid of c<k>, and the centroids that follow."""
    d = f"list_sum([(q[i] - m[i]) * (q[i] - m[i]) FOR i IN range(1, {_D + 1})])::BIGINT"
    return f"""a{k} AS MATERIALIZED (SELECT q, weight, min(({d}, c.cluster)) AS best FROM v, c{k} c GROUP BY ALL),
s{k} AS (SELECT best[2] AS cluster, i, floor(sum(q[i] * weight)::DOUBLE / sum(weight))::BIGINT AS x FROM a{k}, range(1, {_D + 1}) t(i) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.m, c.m) AS m FROM c{k} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS m FROM s{k} GROUP BY cluster) n USING (cluster))"""


_CENTROIDS = f"""WITH kept AS MATERIALIZED (SELECT vec_id, [floor({centroids.STEPS} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {_D} AND len(embedding) = {_D}),
v AS MATERIALIZED (SELECT q, count(*) AS weight FROM kept GROUP BY q),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster, q AS m FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), q) <= {centroids.CENTROIDS}),
{", ".join(map(_assigned, range(centroids.ROUNDS + 1)))},
r AS (SELECT q, best[2] AS cluster, best[1] AS distance, weight FROM a{centroids.ROUNDS}),
i AS (SELECT cluster, sum(distance * weight)::BIGINT AS cluster_inertia FROM r GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM i)::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN r USING (q) JOIN i USING (cluster) JOIN c{centroids.ROUNDS} USING (cluster)"""

ORACLES: dict[str, str] = {"op13_centroid_clustering": _CENTROIDS, "op12_chat_formatting": _CHAT, "op11_spelling_variants": _SPELLING, "op2_license_scan": _LICENSES, "op3_warc_bundles": _WARC, "op8_quality_rules": _QUALITY}
