"""Registered queries of this package: thin wrappers with production parameters.

``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame`` over whole tables;
``ORACLES`` holds the equivalent DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import compress, with_label_error
from .common import doc_part
from .decontam import contaminated
from .katz import katz
from .langid import identify
from .line_dedup import dedup_lines
from .negatives import mine_negatives
from .packing import pack_documents
from .pii import KINDS, find_personal_data, spelled
from .sharding import shard_by_bytes
from .simhash import simhash_components
from .topk import exact_topk
from .toxicity import score_toxicity
from .url_cascade import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_part(7) == 2
    model = katz(_table(spark, sf_dir, "documents"), ~held_out)
    return model.scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                               F.lit(model.constants["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_part(4) == 2
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 describe the base spans; ``spans`` also has what the method adds."""
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    short = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat(short, "added")).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_part(4) == 2
    found = identify(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


URL_RULES = "VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')"


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS r(rule, verdict)")
    return judge_urls(_table(spark, sf_dir, "pages"), rules, default="allow")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return (with_label_error(made.rows).withColumn("codebooks_sha256", F.lit(made.sha256()))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label,
                          positives=5, negatives=10, low=30, high=90, scale=256)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_katz, op3_toxicity, op4_pii, op5_simhash, op6_packing, op7_sharding, op8_topk,
                                   op9_decontamination, op10_language, op11_urls, op12_codes, op13_negatives, pipeline)}

#: A-Z to a-z only, as the operators do; and the white space they know.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"
_KEY = _LOWER.format(f"trim(line, {_SPACE})")

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round as a step of its own: assign parts to the nearest entries, then move the entries."""
    wide = f"(len(v) // {parts})"
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p, v[p * {wide} + 1 : (p + 1) * {wide}] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, (dense_rank() OVER (ORDER BY vec_id) - 1) AS e, x AS c FROM cut
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT vec_id, p, x, min(d * {entries} + e) AS best FROM (
  SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM cut JOIN book{r} USING (p)) GROUP BY vec_id, p, x)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
  SELECT p, e, list(s ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s
    FROM near{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY p, e) m USING (p, e))""")
    return f"""WITH {','.join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id),
spelt AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM book{rounds}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), spelt"""


ORACLES = {
    "op1_line_dedup": f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
common AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
marked AS (SELECT k.*, c.first IS NOT NULL AND c.first <> doc_id AS lost FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op9_decontamination": f"""
WITH dw AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM bw, unnest(range(1, len(w) - 3)) u(i)),
ds AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) u(i)),
sizes AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, n::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n AS containment
FROM ds JOIN bs USING (s) JOIN sizes ON sizes.id = bs.id GROUP BY ds.id, bs.id, n HAVING count(*) >= 0.8 * n""",
    "op11_urls": f"""
WITH r AS (SELECT split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp, rule, verdict
           FROM ({URL_RULES}) t(rule, verdict)),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
host AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
urls AS (SELECT page_id, {_LOWER.format("h")} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
         row_number() OVER () AS row FROM host),
fits AS (SELECT u.row, r.rule, r.verdict FROM urls u JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)
         QUALIFY row_number() OVER (PARTITION BY u.row ORDER BY length(r.rule) DESC, length(r.rh) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (row)""",
    "op12_codes": _codes_sql(),
    "op13_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}
