"""The two cohorts the registered queries run on, as SQL text shared by Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINE_SQL = """
SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS rid,
       l_quantity AS qty, l_extendedprice AS price,
       CASE WHEN l_orderkey % 25 = 0 OR (l_quantity > 45 AND l_orderkey % 5 = 0)
            THEN NULL ELSE l_tax * 100 END AS rate,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS closed,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
       l_returnflag AS rflag, p_type AS ptype, c_mktsegment AS segment,
       CASE WHEN l_extendedprice * (1 - l_discount) > 92000 THEN 1 ELSE 0 END AS outcome,
       round(0.8 * l_extendedprice / 105000 + 0.2 * l_quantity / 50, 3) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
"""

DOC_SQL = """
SELECT d.doc_id AS rid, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words,
       d.lang, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

LINE_NUMERIC = ["qty", "price", "rate"]
LINE_CATEGORICAL = ["rflag", "closed", "urgent", "ptype", "segment"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cohort(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in tables}
    for name in tables:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **frames)


def line_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir, LINE_SQL, ["lineitem", "orders", "part", "customer"])


def doc_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohort(spark, sf_dir, DOC_SQL, ["documents", "labels"])
