"""Queries of the operators with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tremora.llm import (
    alignment, chat, decontaminate, embedding_dedup, language_id, line_dedup, lm_scoring, near_dedup, packing, runs, sharding, token_codes,
    url_rules)
from tremora.llm.common import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept_lines")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_apart(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp ON id = e.vec_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(t) >= 2
    THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) WHEN len(t) = 1 THEN t ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, coalesce(len(g), 0)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS h FROM s),
f AS (SELECT h, count(*) AS many FROM x GROUP BY h),
p AS (SELECT doc_id, h, n, row_number() OVER (PARTITION BY doc_id ORDER BY many, h) AS rk FROM x JOIN f USING (h) JOIN n USING (doc_id)),
pre AS MATERIALIZED (SELECT * FROM p WHERE rk <= n - ceil(0.8 * n) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.h = b.h AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
inter AS (SELECT a, b, len(list_intersect(sa.g, sb.g)) AS i, len(sa.g) AS na, len(sb.g) AS nb
  FROM cand JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b),
one AS (SELECT a, b FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
links AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, n AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN n USING (doc_id) JOIN comp ON id = d.doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), n=2)


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 20 + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted, _ = stage(chat.format_chat(rows.unionByName(own)), "chat")
    return chat.digests(formatted)


@query("op9_token_codes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.read_tokens(*token_codes.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op10_url_filters", r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rule, said) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
m AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said FROM p JOIN r
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES, "page_id")


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    out = alignment.align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    return alignment.rate(out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"))


#: Unsigned CRC-32 in SQL: a table of remainders by recursion, then one step a byte.
CRC = """
step(b, k, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8)"""


def crc(text: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


def with_periods(df: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents repeat a stretch of their words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    df = df.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    w = F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")
    df = df.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("n", F.size("w"))
    df = df.withColumn("from", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - from) div (3 + g % 8)"))
    return df.select("doc_id", F.expr(
        "IF(n > 0, array_join(transform(w, (x, i) -> IF(i < from, x, w[int(from + (i - from) % p)])), ' '), text) AS text"))


@query("op12_periodic_runs", rf"""
WITH RECURSIVE {CRC},
k AS (SELECT doc_id, {crc("coalesce(doc_id::VARCHAR, '')")}::BIGINT AS h,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents, crc_table),
v AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM k),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND doc_id IS NOT NULL THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
    ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w FROM v),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e FROM
    (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g),
long AS MATERIALIZED (SELECT * FROM island WHERE e - s >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long m WHERE m.doc_id = l.doc_id AND m.q < l.q AND m.s <= l.s AND m.e >= l.e)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
r AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM run GROUP BY doc_id),
top AS (SELECT doc_id, s, e - s AS l, q FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.doc_id = a.doc_id AND
    ((b.e - b.s) * a.q > (a.e - a.s) * b.q OR ((b.e - b.s) * a.q = (a.e - a.s) * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.word_runs(with_periods(table(spark, sf_dir, "documents")))
    top = F.expr("aggregate(slice(runs, 2, greatest(size(runs), 1)), runs[0], (t, x) -> IF(x.length * t.period > t.length * x.period, x, t))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.withColumn("top", F.when(F.size("runs") > 0, top))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def draw(kind: str, node: str) -> str:
    """SQL of minus the logarithm of a number drawn by kind, node and key."""
    return f"(-ln((('0x' || substr(md5('{kind}:' || {node} || ':' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496))"


@query("op13_sharding", f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, coalesce('k' || doc_id, 'null') AS k, coalesce(strlen(text), 0) + 16 AS size, {crc("coalesce(text, '')")}::BIGINT AS text_crc32
  FROM documents, crc_table),
keys AS MATERIALIZED (SELECT DISTINCT k FROM d),
region AS MATERIALIZED (SELECT k, arg_min(r, {draw("region", "r")}) AS region, min({draw("region", "r")} / 8) AS time FROM keys, range(5) t(r) GROUP BY k),
rack AS (SELECT k, time, arg_min(q, {draw("rack", "q")}) AS rack FROM (SELECT k, time, 2 * region + j AS q FROM region, range(2) t(j)) GROUP BY k, time),
shard AS MATERIALIZED (SELECT k, time, arg_min(s, {draw("shard", "s")}) AS shard FROM (SELECT k, time, 4 * rack + j AS s FROM rack, range(4) t(j)) GROUP BY k, time),
-- shard 40 is the first of rack 10, the first of region 5: later than its region's time by a draw for each level that another child leads
grown AS (SELECT k, {draw("region", "5")} / 8 + CASE WHEN {draw("rack", "10")} <= {draw("rack", "11")} THEN 0 ELSE {draw("later-rack", "10")} / 4 END
  + CASE WHEN {draw("shard", "40")} <= least({draw("shard", "41")}, {draw("shard", "42")}, {draw("shard", "43")}) THEN 0 ELSE {draw("later-shard", "40")} END AS time
  FROM keys)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CASE WHEN grown.time < shard.time THEN 40 ELSE shard END::INT AS grown_shard
FROM d JOIN shard USING (k) JOIN grown USING (k)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
