"""The queries of this subpackage and, where SQL can tell, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import ann, chat, fill_middle, lm_score, minhash, mixing, packing, quality, secrets, simhash, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.sentence_token_counts(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_chat")
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.prefix_examples(turns))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_prefix_forest")
def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_cell_source").alias("source"), F.col("_cell_lang").alias("lang"), F.col("_cell_topic").alias("topic"),
        F.col("_tokens").alias("tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"),
        F.col("_copies").alias("copies"), F.col("_sampled").alias("sampled"))


@query("op9_context_tree")
def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "doc_id", F.col("_toxic_held_out").alias("held_out"), F.col("_toxic_score").alias("score"), F.col("_toxic_predicted").alias("predicted"),
        F.col("_toxic_spans").alias("spans"))


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", F.col("_n_assign").alias("n_assign"), F.col("_n_access").alias("n_access"), F.col("_n_hex").alias("n_hex"),
        F.col("_base_sha256").alias("base_sha256"), F.col("_spans").alias("spans"), F.col("_n_learned").alias("n_learned"))


FILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, x, length(x) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x
              WHEN 'psm' THEN '<P>' || substr(x, 1, a) || '<S>' || substr(x, b + 1) || '<M>' || substr(x, a + 1, b - a)
              ELSE '<S>' || substr(x, b + 1) || '<P>' || substr(x, 1, a) || '<M>' || substr(x, a + 1, b - a) END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM f
"""


@query("op11_fill_middle", FILL_SQL)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


COPIES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
x AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id
"""


@query("op12_circulant_minhash", COPIES_SQL)
def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def codes_sql(rounds: int) -> str:
    """The rounds written out; lists of 64 components fall into 8 parts of 8."""
    steps = [r"""
WITH base AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * 8 + 1:p * 8 + 8] AS q FROM base, range(8) t(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM parts QUALIFY e < 16)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT x.vec_id, x.p, any_value(x.q) AS q,
                min(struct_pack(d := list_sum(list_transform(range(1, 9), lambda i: (x.q[i] - c.q[i]) * (x.q[i] - c.q[i]))), e := c.e)) AS m
         FROM parts x JOIN c{i} c ON c.p = x.p GROUP BY x.vec_id, x.p)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (SELECT p, m.e AS e, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS w FROM a{i}, range(1, 9) t(i) GROUP BY ALL),
c{i + 1} AS (SELECT c.p, c.e, coalesce(n.q, c.q) AS q FROM c{i} c
             LEFT JOIN (SELECT p, e, list(w ORDER BY i) AS q FROM u{i} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)""")
    steps.append(f"""
k AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN base ON base.vec_id = f.vec_id, k""")
    return ",".join(steps[:-1]) + "," + steps[-1]


@query("op13_hadamard_codes", codes_sql(6))
def op13_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
