"""Interval operators over hits: coverage, overlap, islands, containment, neighbours.

All take the columns query_name, query_start, query_end (1-based, closed) and hit_id as the last key of every order.
A sequence with very many hits is one window partition of a few numbers a row; overlap joins are dealt by bins of the
query, so they spread whatever the number of hits on a sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = 1000


def by_position() -> list[Column]:
    return [F.col("query_start"), F.desc("query_end"), F.col("hit_id")]


def furthest_before(partition: str = "query_name") -> Column:
    """The furthest end of all earlier hits of the sequence."""
    return F.max("query_end").over(Window.partitionBy(partition).orderBy(*by_position()).rowsBetween(Window.unboundedPreceding, -1))


def newly_covered(hits: DataFrame) -> DataFrame:
    """hits with new_bp: the part of each beyond all earlier ones; 0 if contained."""
    before = F.greatest(F.col("query_start") - 1, F.coalesce(furthest_before(), F.lit(0)))
    return hits.withColumn("new_bp", F.greatest(F.lit(0), F.col("query_end") - before).cast("long"))


def truncated(hits: DataFrame) -> DataFrame:
    """Disjoint ranges for masking: contained hits go, others begin after the furthest earlier end."""
    before = F.coalesce(furthest_before(), F.lit(0))
    return hits.withColumn("__b", before).where(F.col("query_end") > F.col("__b")).withColumn("query_start", F.greatest("query_start", F.col("__b") + 1)).drop("__b")


def overlap_flag(hits: DataFrame) -> DataFrame:
    """hits with overlap '*' where the previous or next hit overlaps, scores higher and is of the same stage."""
    order = Window.partitionBy("query_name").orderBy(*by_position())
    prev, nxt = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    left = (prev("query_end") >= F.col("query_start")) & (prev("score") > F.col("score")) & (prev("stage") == F.col("stage"))
    right = (nxt("query_start") <= F.col("query_end")) & (nxt("score") > F.col("score")) & (nxt("stage") == F.col("stage"))
    return hits.withColumn("overlap", F.when(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)), "*"))


def charged(hits: DataFrame) -> DataFrame:
    """hits that no earlier one contains, with charged_bp: an overlap with the previous hit counts for the less diverged of the two."""
    kept = hits.withColumn("__b", F.coalesce(furthest_before(), F.lit(0))).where(F.col("query_end") > F.col("__b")).drop("__b")
    order = Window.partitionBy("query_name").orderBy(*by_position())
    over_prev = F.greatest(F.lit(0), F.lag("query_end").over(order) - F.col("query_start") + 1)
    over_next = F.greatest(F.lit(0), F.col("query_end") - F.lead("query_start").over(order) + 1)
    lose_prev = F.when(F.lag("div_permille").over(order) <= F.col("div_permille"), over_prev).otherwise(0)
    lose_next = F.when(F.lead("div_permille").over(order) < F.col("div_permille"), over_next).otherwise(0)
    length = F.col("query_end") - F.col("query_start") + 1
    return kept.withColumn("charged_bp", F.greatest(F.lit(0), length - F.coalesce(lose_prev, F.lit(0)) - F.coalesce(lose_next, F.lit(0))).cast("long"))


def gaps(hits: DataFrame) -> DataFrame:
    """(query_name, gap_start, gap_end): stretches between hits that none covers."""
    before = F.coalesce(furthest_before(), F.lit(0))
    found = hits.withColumn("__b", before).where((F.col("__b") > 0) & (F.col("query_start") > F.col("__b") + 1))
    return found.select("query_name", (F.col("__b") + 1).alias("gap_start"), (F.col("query_start") - 1).alias("gap_end"))


def islands(hits: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("query_name",)) -> DataFrame:
    """hits with island: numbers, from 1, of runs of hits that overlap or lie at most `gap` apart."""
    order = Window.partitionBy(*keys).orderBy(*by_position())
    before = F.max("query_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("query_start") > before + gap, F.lit(True)).cast("long")
    return hits.withColumn("__f", fresh).withColumn("island", F.sum("__f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("query_name",), bin_width: int = BIN) -> DataFrame:
    """Pairs of rows (l_*, r_*) of both sides whose ranges overlap, by an equi-join on bins; each pair meets once, in the first bin that both touch."""

    def binned(df: DataFrame, p: str) -> DataFrame:
        df = df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
        return df.withColumn(f"{p}_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_query_start") / bin_width), F.floor(F.col(f"{p}_query_end") / bin_width))))

    a, b = binned(left, "l"), binned(right, "r")
    on = F.col("l_bin") == F.col("r_bin")
    for k in keys:
        on &= F.col(f"l_{k}") == F.col(f"r_{k}")
    first = F.floor(F.greatest("l_query_start", "r_query_start") / bin_width)
    hit = (F.col("l_query_start") <= F.col("r_query_end")) & (F.col("l_query_end") >= F.col("r_query_start"))
    both = a.join(b, on).where(hit & (F.col("l_bin") == first)).drop("l_bin", "r_bin")
    return both.withColumn("overlap_bp", F.least("l_query_end", "r_query_end") - F.greatest("l_query_start", "r_query_start") + 1)


def covered_left(left: DataFrame, right: DataFrame, permille: int = 900) -> DataFrame:
    """Every left row with the right rows that cover at least so many thousandths of it, or with none."""
    pairs = overlap_pairs(left, right).where(F.col("overlap_bp") * 1000 >= permille * (F.col("l_query_end") - F.col("l_query_start") + 1))
    found = pairs.select(F.col("l_hit_id").alias("hit_id"), F.col("r_hit_id").alias("cover_id"), "overlap_bp")
    return left.join(found, "hit_id", "left").select("hit_id", "query_name", "cover_id", F.coalesce("overlap_bp", F.lit(0)).cast("long").alias("overlap_bp"))


def not_contained(hits: DataFrame) -> DataFrame:
    """hits without those that lie inside another of the same sequence and score less."""
    inside = overlap_pairs(hits, hits).where((F.col("l_query_start") >= F.col("r_query_start")) & (F.col("l_query_end") < F.col("r_query_end")) & (F.col("l_score") < F.col("r_score")))
    return hits.join(inside.select(F.col("l_hit_id").alias("hit_id")).distinct(), "hit_id", "left_anti")


def contained_within(hits: DataFrame, back: int = 9) -> DataFrame:
    """hits without those that one of the `back` hits before, of the same stage, contains."""
    order = Window.partitionBy("query_name").orderBy(*by_position())
    ranked = hits.withColumn("__s", F.collect_list(F.struct("stage", "query_start", "query_end")).over(order.rowsBetween(-back, -1)))
    held = F.exists("__s", lambda x: (x["stage"] == F.col("stage")) & (x["query_start"] <= F.col("query_start")) & (x["query_end"] >= F.col("query_end")))
    return ranked.where(~held).drop("__s")


def nearest(hits: DataFrame, of_type: str, most_gap: int = 50) -> DataFrame:
    """Each hit of another type with the closest earlier hit of a type that ends at most `most_gap` before it (or overlaps)."""
    order = Window.partitionBy("query_name").orderBy("query_start", "hit_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("subj_type") == of_type, F.struct("query_end", "hit_id"))).over(order)
    found = hits.withColumn("__l", last).where(F.col("subj_type") != of_type)
    gap = F.col("query_start") - F.col("__l.query_end") - 1
    return found.where(gap <= most_gap).select("hit_id", F.col("__l.hit_id").alias("tail_id"), gap.alias("gap"))


def blunted(hits: DataFrame) -> DataFrame:
    """hits whose start is moved behind the previous hit's end; those that vanish go."""
    order = Window.partitionBy("query_name").orderBy(*by_position())
    start = F.greatest("query_start", F.coalesce(F.lag("query_end").over(order) + 1, F.col("query_start")))
    return hits.withColumn("__s", start).where(F.col("__s") <= F.col("query_end")).withColumn("query_start", F.col("__s")).drop("__s")


def beyond_kept(hits: DataFrame) -> DataFrame:
    """hits that end beyond the last kept one: the kept ones are those that raise the running maximum of ends."""
    return hits.withColumn("__b", furthest_before()).where(F.col("__b").isNull() | (F.col("query_end") > F.col("__b"))).drop("__b")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One of hits alike in range, score and divergence: the one of least id."""
    same = Window.partitionBy("query_name", "query_start", "query_end", "score", "div_permille").orderBy("hit_id")
    return hits.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")


def edge_effects(hits: DataFrame) -> DataFrame:
    """hits without those that the next or previous hit at the same start or end outscores by the same family."""
    a = Window.partitionBy("query_name", "subj_name", "query_start").orderBy(F.desc("score"), "hit_id")
    b = Window.partitionBy("query_name", "subj_name", "query_end").orderBy(F.desc("score"), "hit_id")
    return hits.withColumn("__a", F.row_number().over(a)).withColumn("__b", F.row_number().over(b)).where("__a = 1 and __b = 1").drop("__a", "__b")
