"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, itq, langid, mixing, pages, secrets, simhash, suffix

RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"), ["doc_id"])
    of = F.col("findings")
    count = lambda kind: F.size(F.filter(of, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS), _sha(secrets.joined(of, secrets.KINDS[:3])).alias("base_sha256"), secrets.joined(of, secrets.KINDS).alias("spans"))


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_secrets that SQL can express: what the rules find."""
    return op2_secrets(spark, sf_dir).drop("n_model", "spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"), simhash.EXACT).select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), "finish")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    filters = langid.learn(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.identify(docs.withColumn("held_out", held), filters, ["doc_id", "held_out"])


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_chat(chat.canonical_turns(chat.conversations_to_records(rows.unionByName(own)), "record")).select("conv_id", "formatted", "loss")
    made = made.withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _sha(turns).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), _sha(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    made = bpe.encode(_read(spark, sf_dir, "documents"), "text", path, pattern, ["doc_id"])
    made = made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("offsets", 256).alias("offsets_sha256"), "ids")
    back = bpe.decode(made, "ids", path, pattern, ["doc_id", "n_tokens", "ids_sha256", "offsets_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_sha256")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_secrets, op3_simhash, op4_mixing, op5_suffix, op6_language, op7_chat, op8_bpe, op9_pages, op10_vectors, secret_rules)}


#: DuckDB's SQL for the queries that it can express; the others are tested against brute force.
SQL = {
    "op1_nearest": """
WITH v AS (SELECT vec_id, embedding::FLOAT[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
""",
    "secret_rules": """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT n, 0 AS i, 'assign' AS kind, regexp_extract_all(t, '%(assign)s') AS ms, string_split_regex(t, '%(assign)s') AS ps FROM d
  UNION ALL SELECT n, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT n, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d),
u AS (SELECT n, i, kind, unnest(ms) AS m, unnest(ps[1 : len(ms)]) AS before, unnest(range(len(ms))) AS k FROM f),
p AS (SELECT n, i, kind, m, sum(length(before) + length(m)) OVER (PARTITION BY n, i ORDER BY k) AS z FROM u),
x AS (SELECT n, i, kind, (z - length(m))::BIGINT AS a, z::BIGINT AS z FROM p WHERE CASE i WHEN 0 THEN length(regexp_extract(m, '%(assign)s', 2)) >= 6 WHEN 1 THEN length(m) >= 20 ELSE length(m) >= 24 END),
g AS (SELECT n, count(*) FILTER (i = 0) AS n_assign, count(*) FILTER (i = 1) AS n_access, count(*) FILTER (i = 2) AS n_hex, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, i) AS spans FROM x GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (n)
""" % {"assign": """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""},
    "op4_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place, coalesce('=' || source, 'null') AS source_key FROM documents),
s AS (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, (sum(source_size) OVER ())::BIGINT AS total, source_size * 2 AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source_key) AS rank,
    (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / w, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (ORDER BY cap / w, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
f AS (SELECT *, min(CASE WHEN level * w <= cap THEN rank END) OVER () AS first FROM l),
c AS (SELECT *, max(CASE WHEN rank = first THEN level END) OVER () AS common FROM f),
t AS (SELECT source_key, source_size, CASE WHEN first IS NULL OR rank < first THEN cap::DOUBLE ELSE common * w END AS target FROM c),
q AS (SELECT row_number() OVER () AS n, sized.*, source_size, target,
    sum(size) OVER (PARTITION BY sized.source_key ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized JOIN t ON sized.source_key = t.source_key),
items AS (SELECT q.*, pass, (upto + pass * source_size)::DOUBLE / target AS time FROM q, range(2) r(pass) WHERE size > 0 AND target > 0),
e AS (SELECT n, size, sum(size) OVER (ORDER BY time, source_key, pass, place, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM items),
b AS (SELECT floor(1.5 * sum(size))::BIGINT AS budget FROM sized),
k AS (SELECT n, sum(greatest(0, least(size, budget - (upto - size)))) AS taken FROM e, b GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN size > 0 AND target > 0 THEN upto::DOUBLE / target END AS finish FROM q LEFT JOIN k USING (n)
""",
    "op5_suffix": """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT n, unnest(range(0, greatest(octet_length(b) - 49, 0))) AS p FROM d WHERE doc_id IS NOT NULL),
g AS (SELECT n, doc_id, p, b[p + 1 : p + 50] AS s FROM places JOIN d USING (n)),
late AS (SELECT n, p FROM (SELECT n, p, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE doc_id > first),
runs AS (SELECT n, p, sum(fresh) OVER (PARTITION BY n ORDER BY p) AS run FROM (SELECT n, p, CASE WHEN p <= lag(p) OVER (PARTITION BY n ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM late)),
gone AS (SELECT n, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY n, run),
ends AS (SELECT n, a, z FROM gone UNION ALL SELECT n, octet_length(b), octet_length(b) FROM d),
pieces AS (SELECT n, a, coalesce(lag(z) OVER (PARTITION BY n ORDER BY a, z), 0) AS last FROM ends),
kept AS (SELECT n, sha256(unhex(string_agg(hex(b[last + 1 : a]), '' ORDER BY a, last))) AS kept_sha256 FROM pieces JOIN d USING (n) GROUP BY n)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d JOIN kept USING (n) LEFT JOIN (SELECT n, sum(z - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY n) USING (n)
""",
    "op7_chat": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 15 + length(text) + length(regexp_replace(text, '[^#<\\]', '', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op10_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS component FROM v UNION SELECT p.b, r.component FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(component) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id)::BIGINT AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
""",
}
