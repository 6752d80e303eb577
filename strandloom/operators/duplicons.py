"""Segmental duplications: seeds on one line clustered, widened over repeats, and grouped to ranges for realignment.

seeds: query_name, query_start, query_end, query_remaining, orientation, subj_name, subj_start, subj_end, subj_remaining,
score, div, hit_id (unique). repeats: query_name, query_start, query_end, hit_id.

Rows that repeat are seeds each; null names are a name; a seed with a null score, or with a null place, is no seed; empty
tables give no rows, and without repeats clusters reach as far as their consensus does. Other columns are passed over.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators import folds, interval
from strandloom.operators.excision import running

# Least score, bases inserted between seeds, consensus bases they may share, bases of a block that isn't repetitive
LEAST_SCORE, MOST_INSERTED, MOST_SHARED, BLOCK = 300, 7000, 30, 300

PLACES = ["query_name", "query_start", "query_end", "query_remaining", "orientation", "subj_name", "subj_start", "subj_end", "subj_remaining"]


def kept_seeds(hits: DataFrame, most_div: float | None = None) -> DataFrame:
    """Hits that score enough and, if asked, are less diverged than most_div percent."""
    placed = F.lit(True)
    for c in PLACES[1:4] + PLACES[6:]:
        placed &= F.col(c).isNotNull()
    found = hits.where((F.col("score") >= LEAST_SCORE) & placed)
    return found if most_div is None else found.where(F.col("div") < most_div)


ABSORBED = ["query_start", "query_end", "reach", "begins", "place", "hit_id"]


def _absorb(t: dict[str, list], state: Any) -> tuple[dict[str, list], Any]:
    """Each seed of a slice to the first open cluster that takes it, or to one of its own.

    A cluster is open while a seed may begin in reach of its last seed's end; its first seed sets the reach and the consensus
    place that all later seeds must lie behind. state: the open clusters, as lists of id, end, reach and place.
    """
    opened = [list(c) for c in zip(*state, strict=True)] if state else []
    out = []
    for start, end, reach, begins, place, seed in zip(*(t[c] for c in ABSORBED), strict=True):
        opened = [c for c in opened if start - c[1] <= c[2]]
        at = next((c for c in opened if begins - c[3] > -MOST_SHARED), None)
        if at is None:
            opened.append([seed, end, reach, place])
            out.append(seed)
        else:
            at[1] = end
            out.append(at[0])
    return {"hit_id": t["hit_id"], "cluster": out}, [list(x) for x in zip(*opened, strict=True)] or None


def clustered(seeds: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """(hit_id, cluster): seeds with the first seed of their cluster; a fold over slices of each family's seeds on a sequence."""
    turned = F.col("orientation") == "C"
    rows = seeds.select(
        F.to_json(F.struct("query_name", "subj_name", "orientation")).alias("family"), "query_start", "query_end", F.col("hit_id").cast("long").alias("hit_id"),
        (F.when(turned, F.col("subj_start")).otherwise(F.col("subj_remaining")) + MOST_INSERTED).alias("reach"),
        F.when(turned, -F.col("subj_end")).otherwise(F.col("subj_start")).alias("begins"), F.when(turned, -F.col("subj_start")).otherwise(F.col("subj_end")).alias("place"),
    )
    rows = rows.select("family", "hit_id", *[F.col(c).cast("long").alias(c) for c in ("query_start", "query_end", "reach", "begins", "place")])
    placed = folds.numbered_rows(rows, interval.by_position(), "family")
    return folds.fold(folds.in_slices(placed, 0, slice_rows), _absorb, "hit_id long, cluster long", None, "family", ABSORBED)


def clusters(seeds: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """A row for each cluster, with hit_id and places of its first seed but the query's end of its last, and n_seeds."""
    last = F.struct("query_start", -F.col("query_end"), "hit_id")
    both = seeds.select("hit_id", *PLACES).join(clustered(seeds, slice_rows).withColumnRenamed("hit_id", "__id"), F.col("hit_id") == F.col("__id"))
    tail = both.groupBy(F.col("cluster").alias("__c")).agg(F.max_by(F.struct("query_end", "query_remaining"), last).alias("__last"), F.count(F.lit(1)).alias("n_seeds"))
    heads = both.where("hit_id = cluster").drop("__id", "cluster").join(tail, F.col("hit_id") == F.col("__c"))
    return heads.withColumns({"query_end": F.col("__last.query_end"), "query_remaining": F.col("__last.query_remaining")}).drop("__c", "__last")


def following(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with a value of the next row of their sequence, by slices with a row of the next one each."""
    placed = folds.in_slices(folds.numbered_rows(rows, interval.by_position()), 1)
    after = F.lead(value).over(Window.partitionBy("query_name", "slice").orderBy("rank"))
    return placed.withColumn(out, after).where("own").drop("own", "slice", "rank")


def unique_blocks(repeats: DataFrame) -> DataFrame:
    """(query_name, block_start, block_end): from the end of each repeat to the start of the next, if bases lie between."""
    found = following(repeats.select("query_name", "query_start", "query_end", "hit_id"), "query_start", "block_end")
    return found.where("block_end - query_end > 1").select("query_name", F.col("query_end").alias("block_start"), "block_end")


def _block(rows: DataFrame, blocks: DataFrame, at: Column, mark: Column, out: str) -> DataFrame:
    """rows with the block of largest mark that is not beyond `at`: an as-of join over bins."""
    names = rows.columns
    entry = F.struct(mark.alias("mark"), "block_start", "block_end")
    marks = blocks.select("query_name", mark.alias("__at"), F.lit(0).alias("__side"), entry.alias("__e"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names if c != "query_name"])
    asked = rows.withColumns({"__at": at, "__side": F.lit(1), "__e": F.lit(None).cast(marks.schema["__e"].dataType)})
    found = running(marks.unionByName(asked), "query_name", "__at", [F.col("__at"), F.col("__side")], F.col("__e"), F.max, out)
    return found.where("__side = 1").select(*names, out)


def _in_block(b: str, lo: Column, hi: Column) -> Column:
    """Whether the block holds more than BLOCK bases of a range, one of its ends inside."""
    start, end = F.col(f"{b}.block_start"), F.col(f"{b}.block_end")
    return F.coalesce((F.least(end, hi) - F.greatest(start, lo) + 1 > BLOCK) & ~((start < lo) & (end > hi)), F.lit(False))


def widened(found: DataFrame, repeats: DataFrame) -> DataFrame:
    """clusters with range_start, range_end, is_orphan: as far as the consensus reaches, up to the first block without repeats.

    Blocks of more than BLOCK bases end a range where it enters them; a block around the whole flank ends none. An orphan
    can't be widened.
    """
    turned = F.col("orientation") == "C"
    qs, qe = F.col("query_start").cast("long"), F.col("query_end").cast("long")
    before, behind = F.when(turned, F.col("subj_remaining")).otherwise(F.col("subj_start")), F.when(turned, F.col("subj_start")).otherwise(F.col("subj_remaining"))
    rows = found.withColumns({"__lo": F.greatest(qs - before + 1, F.lit(1)), "__hi": qe + F.least(behind, F.col("query_remaining"))})
    wide = unique_blocks(repeats).where(F.col("block_end") - F.col("block_start") >= BLOCK).select("query_name", F.col("block_start").cast("long").alias("block_start"), F.col("block_end").cast("long").alias("block_end"))
    # blocks are apart: the nearest with enough bases on that side of the end is the only one that can end the range
    rows = _block(rows, wide, qs - BLOCK, F.col("block_start"), "__left")
    rows = _block(rows, wide, -(qe + BLOCK), -F.col("block_end"), "__right")
    left = F.least(qs, F.when(_in_block("__left", F.col("__lo"), qs), F.col("__left.block_end")).otherwise(F.col("__lo")))
    right = F.greatest(qe, F.when(_in_block("__right", qe, F.col("__hi")), F.col("__right.block_start")).otherwise(F.col("__hi")))
    rows = rows.withColumns({"range_start": left, "range_end": right}).drop("__lo", "__hi", "__left", "__right")
    return rows.withColumn("is_orphan", (F.col("range_start") == qs) & (F.col("range_end") == qe))


def ranges(wide: DataFrame) -> DataFrame:
    """(query_name, range_start, range_end, subj_name, n_clusters, n_seeds): ranges to align anew, a row for each consensus.

    A range is a run of widened clusters each of which begins before the one before it ends; an orphan inside counts with
    the first such range.
    """
    grown = wide.where("not is_orphan").select("query_name", "subj_name", "n_seeds", "hit_id", F.col("range_start").alias("query_start"), F.col("range_end").alias("query_end"))
    # `last`: the next one begins behind this one's end
    rows = following(grown, "query_start", "__next").withColumn("last", F.coalesce(F.col("__next") > F.col("query_end"), F.lit(True)).cast("long")).drop("__next")
    rows = running(rows, "query_name", "query_start", interval.by_position(), F.col("last"), F.sum, "__sum").withColumn("no", F.col("__sum") - F.col("last")).drop("__sum", "last")
    spans = rows.groupBy("query_name", "no").agg(F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end")).checkpoint()
    orphans = wide.where("is_orphan").select("query_name", "subj_name", "n_seeds", "hit_id", "query_start", "query_end")
    inside = interval.overlap_pairs(orphans, spans).where("l_query_start >= r_query_start and l_query_end <= r_query_end")
    inside = inside.groupBy("l_hit_id").agg(F.first("l_query_name").alias("query_name"), F.first("l_subj_name").alias("subj_name"), F.first("l_n_seeds").alias("n_seeds"), F.min("r_no").alias("no"))
    members = rows.select("query_name", "no", "subj_name", "n_seeds").unionByName(inside.select("query_name", "no", "subj_name", "n_seeds"))
    counted = members.groupBy(F.col("query_name").alias("__q"), F.col("no").alias("__n"), "subj_name").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_seeds").alias("n_seeds"))
    both = spans.join(counted, F.col("query_name").eqNullSafe(F.col("__q")) & (F.col("no") == F.col("__n")))
    return both.select("query_name", F.col("query_start").alias("range_start"), F.col("query_end").alias("range_end"), "subj_name", "n_clusters", "n_seeds")
