"""Chains of hits: candidates, best partners, components, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.interval import by_position


def ranked(hits: DataFrame, order: list[Column] | None = None) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_name").orderBy(*(order or by_position()))))


def candidates(hits: DataFrame, ahead: int = 21, most_gap: int = 15_000) -> DataFrame:
    """Pairs of hits of one family and strand on one sequence: the second at most `ahead` ranks and `most_gap` bases on."""
    r = ranked(hits)
    steps = r.withColumn("__t", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).withColumn("__t", F.col("rank") + F.col("__t"))
    right = r.select(F.col("query_name").alias("__q"), F.col("rank").alias("__r"), F.col("hit_id").alias("partner_id"), F.col("query_start").alias("p_start"), F.col("subj_name").alias("p_name"), F.col("orientation").alias("p_orientation"), F.col("score").alias("p_score"), F.col("div_permille").alias("p_div"))
    both = steps.join(right, (F.col("query_name") == F.col("__q")) & (F.col("__t") == F.col("__r")))
    gap = F.col("p_start") - F.col("query_end") - 1
    return both.where((gap <= most_gap) & (F.col("subj_name") == F.col("p_name")) & (F.col("orientation") == F.col("p_orientation"))).select("query_name", "hit_id", "partner_id", (F.col("p_score") - F.greatest(gap, F.lit(0)) - F.abs(F.col("div_permille") - F.col("p_div"))).alias("pair_score"), gap.alias("gap"))


def best_partners(pairs: DataFrame, mutual: bool = True) -> DataFrame:
    """Of each hit's candidates the one of best pair score; with `mutual`, only if the hit is that one's best too."""
    right = Window.partitionBy("hit_id").orderBy(F.desc("pair_score"), "partner_id")
    left = Window.partitionBy("partner_id").orderBy(F.desc("pair_score"), "hit_id")
    found = pairs.withColumn("__a", F.row_number().over(right)).withColumn("__b", F.row_number().over(left)).where("__a = 1")
    return (found.where("__b = 1") if mutual else found).drop("__a", "__b")


def components(edges: DataFrame, a: str = "hit_id", b: str = "partner_id") -> DataFrame:
    """(id, component): the least id that edges lead to; minimum labels with pointer jumping, checkpointed each round."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select("v", "u")).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("m"))
        new = labels.join(near, F.col("id") == F.col("u")).select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("__n"), F.col("component").alias("__c"))
        new = new.join(jump, F.col("component") == F.col("__n"), "left").select("id", F.least("component", F.coalesce("__c", "component")).alias("component"), "old").checkpoint()
        labels = new.select("id", "component")
        if not new.where("component <> old").limit(1).count():
            return labels


def numbered(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """hits with chain: the number of the chain by first appearance on the sequence; a hit in no chain is one of its own."""
    joined = hits.join(labels.withColumnRenamed("id", "hit_id"), "hit_id", "left").withColumn("component", F.coalesce("component", "hit_id"))
    first = F.min(F.struct("query_start", F.col("hit_id"))).over(Window.partitionBy("query_name", "component"))
    return joined.withColumn("__f", first).withColumn("chain", F.dense_rank().over(Window.partitionBy("query_name").orderBy("__f"))).drop("__f")


def epochs(rows: DataFrame, key: str, order: list, id_col: str) -> DataFrame:
    """rows with epoch and new_id: ids start anew where one falls below 3 by more than 50; dense numbers by first place."""
    w = Window.partitionBy(key).orderBy(*order)
    last = F.lag(id_col).over(w)
    reset = ((F.col(id_col) < last - 50) & (F.col(id_col) < 3)).cast("long")
    rows = rows.withColumn("__r", F.coalesce(reset, F.lit(0))).withColumn("epoch", F.sum("__r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__f", F.min("__n").over(Window.partitionBy(key, "epoch", id_col)))
    return rows.withColumn("new_id", F.dense_rank().over(Window.partitionBy(key).orderBy("__f")).cast("long")).drop("__r", "__n", "__f")


def between(hits: DataFrame, ahead: int = 5) -> DataFrame:
    """For each hit and the one `ahead` ranks on: uncovered bases between them and the highest divergence in between."""
    r = ranked(hits)
    order = Window.partitionBy("query_name").orderBy("rank")
    inside = order.rowsBetween(1, ahead - 1)
    far = F.lead("query_start", ahead).over(order)
    found = r.withColumn("__f", far).withColumn("most_div", F.max("div_permille").over(inside)).withColumn("covered", F.sum(F.col("query_end") - F.col("query_start") + 1).over(inside))
    return found.where(F.col("__f").isNotNull()).select("hit_id", F.greatest(F.lit(0), F.col("__f") - F.col("query_end") - 1 - F.col("covered")).cast("long").alias("uncovered"), "most_div")


def interleaved(spans: DataFrame) -> DataFrame:
    """Pairs of spans (key, id, lo, hi) of one key with a.lo < b.lo < a.hi < b.hi."""
    a, b = spans.alias("a"), spans.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.lo") < F.col("b.lo")) & (F.col("b.lo") < F.col("a.hi")) & (F.col("a.hi") < F.col("b.hi"))
    return a.join(b, on).select(F.col("a.key").alias("key"), F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))


def carried_back(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """rows with the last value that is not null of their key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def rejoined(hits: DataFrame, most_gap: int = 1) -> DataFrame:
    """hits with piece: runs of neighbours of one family and strand at most `most_gap` bases apart."""
    w = Window.partitionBy("query_name", "subj_name", "orientation").orderBy("query_start", "hit_id")
    fresh = F.coalesce(F.col("query_start") - F.lag("query_end").over(w) > most_gap, F.lit(True)).cast("long")
    return hits.withColumn("__f", fresh).withColumn("piece", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")
