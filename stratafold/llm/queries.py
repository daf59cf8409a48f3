"""The registered queries of the operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import chat, collocations, jaccard_join, mixing, near, packing, quality, repair, repair_sql, sharding, spots, suffix, token_files, topk
from stratafold.llm.common import stored, table
from stratafold.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    files = stored(token_files.write_token_files(table(spark, folder, "documents"), shared_path(spark, "tokens"), end_id=2), "manifest")
    return token_files.read_documents(token_files.with_starts(files))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), packing.Limits(tokens=1024, segments=64, loss_tokens=1024), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_tokens", "padded_to")


@query("op2_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    whole = "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    vector = F.expr(f"CASE WHEN {whole} THEN transform(embedding, x -> floor(256 * CAST(x AS DOUBLE))) END")
    return topk.top_k(table(spark, folder, "embeddings"), "vec_id", vector, F.col("vec_id") % 50 == 0, 5)


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    shards = sharding.write_shards(docs, shared_path(spark, "shards"), shards=8, seed=7)
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_mixing", """
WITH d AS (
  SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z,
         [3, 1, 2][CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY source),
l AS (
  SELECT *, sum(z) OVER () * 1.5 AS t, sum(w) OVER () AS tw,
         coalesce(sum(2 * z) OVER (ORDER BY z / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cz,
         coalesce(sum(w) OVER (ORDER BY z / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM s),
c AS (SELECT *, 2 * z * (tw - cw) <= w * (t - cz) AS capped FROM l),
g AS (
  SELECT source, z, CASE WHEN capped THEN 2.0 * z ELSE
         w * (t - coalesce(sum(2 * z) FILTER (capped) OVER (), 0)) / (tw - coalesce(sum(w) FILTER (capped) OVER (), 0)) END AS target FROM c),
q AS (SELECT source, z, CAST(target AS DOUBLE) AS target, CAST(floor(target) AS BIGINT) AS f FROM g),
r AS (
  SELECT d.doc_id, d.size, q.z, q.target, CASE WHEN q.z = 0 THEN 0 ELSE q.f // q.z END AS passes, CASE WHEN q.z = 0 THEN 0 ELSE q.f % q.z END AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mix = mixing.mixed(docs, F.array("source"), mixing.word_count(F.col("text")), weights=[3, 1, 2], share=1.5, most=2, seed=11)
    return mix.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


#: A conversation of control strings.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


@query("op7_chat", f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ODD_TEXT}'),
t AS (SELECT conv_id, turn, role AS r, coalesce(role, '') AS role, text AS x, coalesce(text, '') AS text FROM c),
e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '<\\\\*\\|')) + len(regexp_extract_all(text, '<\\\\*\\|'))
         + len(regexp_extract_all(role, '[\\\\\\n]')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    log = chat.events_of_turns(rows.unionByName(odd))
    made = stored(chat.rendered(chat.messages(log)), "chats")
    turns = chat.turns_of(F.col("formatted"))
    read = made.select("conv_id", "formatted", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op9_spots")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return spots.edited_fingerprints(table(spark, folder, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.judged(docs, table(spark, folder, "labels"), seed=3)
    return found.select("doc_id", F.col("_quality_weight").alias("weight"), F.col("_quality_grams").alias("n_grams"),
                        F.col("_quality_key").alias("gumbel_key"), F.col("_quality_kept").alias("kept"))


@query("op6_near")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"), n=4, percent=80)


@query("op4_suffix")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix.without_earlier(docs, span=50)
    return found.select("doc_id", F.col("_dedup_bytes").alias("n_bytes"), F.col("_dedup_removed").alias("n_removed"), F.col("_dedup_spans").alias("n_spans"),
                        F.sha2("_dedup_kept", 256).alias("kept_sha256"))


@query("op11_jaccard_join")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"), n=3, percent=90)


@query("op12_collocations", r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS m FROM w),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(list_slice(ws, i, i + m - 1), ' '))) AS phrase FROM s),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND n >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.m, k.phrase, k.a, k.ws, l.n AS l, r.n AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (l.n + r.n) AS BIGINT) AS score, k.k
  FROM k JOIN f l ON l.lang = k.lang AND l.m = k.k AND l.phrase = array_to_string(k.ws[:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.m = k.m - k.k AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, ws, unnest(range(2, m)) AS size FROM c),
j AS (SELECT lang, a, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(list_slice(ws, i, i + size - 1), ' '))) AS phrase FROM i),
h AS (SELECT lang, phrase, max(a) AS around FROM j GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE around IS NULL OR 100 * around < 80 * b.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, total.n, o.score FROM o JOIN total ON total.lang = o.lang WHERE o.rank <= 2000
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))


@query("op13_repair", repair_sql.statement())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return repair.repair(rows, repair.damaged(rows))
