"""Derived views that stand in for annotation tables, built with whole-number arithmetic so that any engine gets the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CLASSES = {"click": "SINE/Alu", "view": "LINE/L1", "purchase": "DNA/hAT-Charlie", "signup": "LTR/ERVL", "error": "Simple_repeat"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored interval annotations: 1-based closed query ranges, percentages in thousandths."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.lit("Unknown")
    for event, name in CLASSES.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    start = 1 + (F.col("event_id") * 7919 + F.col("user_id") * 104729) % 20000
    sstart = 1 + (F.col("event_id") * 37) % 400
    return e.select(
        F.col("event_id").alias("hit_id"),
        F.concat(F.lit("chr"), F.col("user_id")).alias("query_name"),
        start.alias("query_start"),
        (start + 19 + (F.col("event_id") * 31) % 280).alias("query_end"),
        (180 + (F.col("event_id") * 6421) % 2200).alias("score"),
        ((F.col("event_id") * 17) % 350).alias("div_permille"),
        ((F.col("event_id") * 29) % 120).alias("del_permille"),
        ((F.col("event_id") * 43) % 90).alias("ins_permille"),
        F.when((F.col("event_id") * 13) % 7 < 3, "C").otherwise("+").alias("orientation"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("event_id") * 11) % 5).alias("subj_name"),
        kind.alias("subj_type"),
        sstart.alias("subj_start"),
        (sstart + 19 + (F.col("event_id") * 31) % 280).alias("subj_end"),
        ((F.col("event_id") * 53) % 500).alias("subj_remaining"),
        (F.col("event_id") % 9 * 5 + 35).alias("stage"),
    )


HITS = """hits AS (SELECT event_id AS hit_id, 'chr' || user_id AS query_name, 1 + (event_id * 7919 + user_id * 104729) % 20000 AS query_start,
  1 + (event_id * 7919 + user_id * 104729) % 20000 + 19 + (event_id * 31) % 280 AS query_end, 180 + (event_id * 6421) % 2200 AS score,
  (event_id * 17) % 350 AS div_permille, (event_id * 29) % 120 AS del_permille, (event_id * 43) % 90 AS ins_permille,
  CASE WHEN (event_id * 13) % 7 < 3 THEN 'C' ELSE '+' END AS orientation, event_type || '_' || ((event_id * 11) % 5) AS subj_name,
  CASE event_type WHEN 'click' THEN 'SINE/Alu' WHEN 'view' THEN 'LINE/L1' WHEN 'purchase' THEN 'DNA/hAT-Charlie' WHEN 'signup' THEN 'LTR/ERVL' WHEN 'error' THEN 'Simple_repeat' ELSE 'Unknown' END AS subj_type,
  1 + (event_id * 37) % 400 AS subj_start, 1 + (event_id * 37) % 400 + 19 + (event_id * 31) % 280 AS subj_end, (event_id * 53) % 500 AS subj_remaining,
  event_id % 9 * 5 + 35 AS stage FROM events)"""

#: Sequences: the documents as letters.
SEQUENCES = "seqs AS (SELECT doc_id AS seq_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sequence FROM documents)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("sequence"))


#: Families: parts with a clade that is a nation or a region of the tree.
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("DF"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("accession"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("repeat_type"),
        F.col("p_brand").alias("repeat_subtype"),
        (F.col("p_partkey") % 3 == 0).alias("is_uncurated"),
        F.concat(F.lit("n"), F.col("p_partkey") % 25).alias("clade"),
        (35 + F.col("p_partkey") % 12 * 5).alias("stage"),
        F.col("p_size").cast("long").alias("length"),
    )


FAMILIES = """families AS (SELECT 'DF' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS accession, p_name AS name, p_type AS repeat_type, p_brand AS repeat_subtype,
  p_partkey % 3 = 0 AS is_uncurated, 'n' || (p_partkey % 25) AS clade, 35 + p_partkey % 12 * 5 AS stage, CAST(p_size AS BIGINT) AS length FROM part)"""


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tax_id, parent_id, name): root, regions, nations."""
    root = spark.range(1).select(F.lit("root").alias("tax_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("name"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("tax_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("tax_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return root.unionByName(r).unionByName(n)


TAXA = """taxa AS (SELECT 'root' AS tax_id, NULL AS parent_id, 'root' AS name UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"""
