"""Queries by name, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.detect import hash_score

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = WITH + sql if "WITH RECURSIVE" not in sql else sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, counts as long: what both engines agree on."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records with stand-in scores: t and v are missing for every seventh and fifth document, a for every fourth."""
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    some = lambda salt, n: F.when(F.pmod(i, F.lit(n)) != 0, hash_score(i, salt))
    return d.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", F.col("source").alias("category"), F.coalesce("toxic", F.pmod(i, F.lit(2)).cast("int")).cast("int").alias("y"),
        some("t", 7).alias("t"), some("v", 5).alias("v"), some("a", 4).alias("a"), F.element_at(F.array(F.lit("pdf"), F.lit("web"), F.lit("image")), (F.pmod(i, F.lit(3)) + 1).cast("int")).alias("domain"),
        F.sha2("text", 256).alias("sha256"),
    )


#: The same in SQL, before every query's own.
WITH = """WITH scored AS (
  SELECT d.doc_id, d.text, d.lang, d.source AS category, coalesce(l.toxic, (d.doc_id % 2)::INTEGER) AS y,
    CASE WHEN d.doc_id % 7 <> 0 THEN (('0x' || substr(md5('t' || d.doc_id), 1, 8))::BIGINT % 1001) / 1000::DOUBLE END AS t,
    CASE WHEN d.doc_id % 5 <> 0 THEN (('0x' || substr(md5('v' || d.doc_id), 1, 8))::BIGINT % 1001) / 1000::DOUBLE END AS v,
    CASE WHEN d.doc_id % 4 <> 0 THEN (('0x' || substr(md5('a' || d.doc_id), 1, 8))::BIGINT % 1001) / 1000::DOUBLE END AS a,
    ['pdf', 'web', 'image'][(d.doc_id % 3)::INTEGER + 1] AS domain, sha256(d.text) AS sha256
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), risked AS (
  SELECT *, CASE WHEN t IS NULL AND v IS NULL THEN NULL ELSE greatest(0, least(1, 1 - (1 - coalesce(t, 0)) * (1 - coalesce(v, 0)))) END AS fused FROM scored
), assessed AS (
  SELECT *, least(1, fused + 0.5 * (1 - coalesce(a, 1)) * fused * (1 - fused)) AS risk FROM risked
), decided AS (
  SELECT *, CASE WHEN fused IS NULL THEN 'SANITIZE' WHEN risk < 0.3 THEN 'ACCEPT' WHEN risk >= 0.7 THEN 'REJECT' ELSE 'SANITIZE' END AS action, CASE WHEN fused IS NULL THEN NULL ELSE risk END AS r FROM assessed
) """


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import TrustConfig
    from ..functions.trust import assess

    out = scored(spark, sf_dir).withColumn("x", assess(TrustConfig(), "domain", "t", "v", F.col("a")))
    return out.select("*", F.col("x.fused").alias("fused"), F.col("x.risk").alias("r"), F.col("x.decision").alias("action")).drop("x")
