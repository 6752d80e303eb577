"""Cutting ranges out of sequences, and the way back: a ledger of what was cut, and coordinates lifted over it.

A cut range leaves one letter. ledger(): the cut ranges with the place of that letter and the bases removed up to it, a map
that is linear between cuts. Positions meet it by as-of joins, in bins of the sequence, so that no sequence is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = 1 << 14


def running(rows: DataFrame, key: str, at: str, order: list[Column], value: Column, how, out: str) -> DataFrame:
    """rows with the sum or maximum (how) of value over all rows up to each in its key's order, which begins with `at`: within a bin, and over the bins before."""
    held = rows.withColumn("__bin", F.floor(F.col(at) / BIN)).withColumn("__v", value)
    bins = held.groupBy(F.col(key).alias("__k"), F.col("__bin").alias("__b")).agg(how("__v").alias("__t"))
    bins = bins.withColumn("__before", how("__t").over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    own = how("__v").over(Window.partitionBy(key, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("__own", own).join(bins, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bin") == F.col("__b")))
    summed = F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0)) if how is F.sum else F.greatest("__before", "__own")
    return held.withColumn(out, summed).drop("__bin", "__v", "__k", "__b", "__before", "__own")


def ledger(cuts: DataFrame) -> DataFrame:
    """(query_name, cut_from, cut_to, letter_at, removed): disjoint ranges that are cut, the place of the letter left, bases removed up to it."""
    found = running(cuts.select("query_name", F.col("query_start").alias("cut_from"), F.col("query_end").alias("cut_to")), "query_name", "cut_from", [F.col("cut_from")], F.col("cut_to") - F.col("cut_from"), F.sum, "removed")
    return found.withColumn("letter_at", F.col("cut_to") - F.col("removed"))


def last_cut(places: DataFrame, cuts: DataFrame, at: str, cut_at: str) -> DataFrame:
    """places (query_name, at, ...) with `cut`: the last row of the ledger whose cut_at is not beyond; an as-of join."""
    entry = F.struct(F.col(cut_at).alias("cut_at"), "cut_from", "cut_to", "letter_at", "removed")
    names = places.columns
    marks = cuts.select("query_name", F.col(cut_at).cast("long").alias("__at"), F.lit(0).alias("__side"), entry.alias("__c"), *[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in names if c != "query_name"])
    asked = places.withColumns({"__at": F.col(at).cast("long"), "__side": F.lit(1), "__c": F.lit(None).cast(marks.schema["__c"].dataType)})
    # entries grow along the sequence, so the last is the largest
    found = running(marks.unionByName(asked), "query_name", "__at", [F.col("__at"), F.col("__side")], F.col("__c"), F.max, "cut")
    return found.where("__side = 1").select(*names, "cut")


def both_ends(hits: DataFrame, cuts: DataFrame, cut_at: str, place: Column, starts: str, ends: str) -> DataFrame:
    """hits with both ends of their query range mapped; place: of `at` and `cut`."""
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("query_start").alias("at")), F.struct(F.lit("e").alias("side"), F.col("query_end").alias("at")))
    asked = hits.select("query_name", "hit_id", F.inline(sides))
    mapped = last_cut(asked, cuts, "at", cut_at).select("hit_id", "side", place.alias("to"))
    found = mapped.groupBy(F.col("hit_id").alias("__id")).agg(F.max(F.when(F.col("side") == "s", F.col("to"))).alias(starts), F.max(F.when(F.col("side") == "e", F.col("to"))).alias(ends))
    return hits.join(found, F.col("hit_id") == F.col("__id")).drop("__id")


def to_cut(hits: DataFrame, cuts: DataFrame) -> DataFrame:
    """hits with cut_start, cut_end: their places on the cut sequence; what lies in a cut range is at its letter. hit_id is unique."""
    c = F.col("cut")
    inside = c.isNotNull() & (F.col("at") <= c.cut_to)
    return both_ends(hits, cuts, "cut_from", F.when(inside, c.letter_at).otherwise(F.col("at") - F.coalesce(c.removed, F.lit(0))), "cut_start", "cut_end")


def lifted(hits: DataFrame, cuts: DataFrame) -> DataFrame:
    """hits on the cut sequence with full_start, full_end: their places on the whole one; a letter left stands for the last base of its range. hit_id is unique."""
    return both_ends(hits, cuts, "letter_at", F.col("at") + F.coalesce(F.col("cut").removed, F.lit(0)), "full_start", "full_end")


def fragments(hits: DataFrame, cuts: DataFrame, start: str = "full_start", end: str = "full_end") -> DataFrame:
    """hits with fragment, frag_start, frag_end: what is left of each between the cut ranges that begin inside it.

    A hit that is a cut range, or that holds no base before or behind one that begins inside, stays whole; behind the last
    cut range a fragment is left only if that doesn't begin with the hit. hit_id is unique.
    """
    lo, hi = F.col(start), F.col(end)
    bins = hits.select("query_name", "hit_id", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))).alias("bin"))
    marks = cuts.select(F.col("query_name").alias("__q"), "cut_from", "cut_to", F.floor(F.col("cut_from") / BIN).alias("__b"))
    met = bins.join(marks, (F.col("query_name") == F.col("__q")) & (F.col("bin") == F.col("__b")) & (F.col("cut_from") >= F.col("lo")) & (F.col("cut_from") <= F.col("hi")))
    met = met.where(~((F.col("cut_from") == F.col("lo")) & (F.col("cut_to") == F.col("hi"))))
    along = Window.partitionBy("hit_id").orderBy("cut_from")
    met = met.withColumns({"from": F.coalesce(F.lag("cut_to").over(along) + 1, F.col("lo")), "last": F.lead("cut_from").over(along).isNull()})
    inner = F.struct(F.col("from").alias("frag_start"), (F.col("cut_from") - 1).alias("frag_end"))
    behind = F.struct((F.col("cut_to") + 1).alias("frag_start"), F.col("hi").alias("frag_end"))
    parts = F.array(F.when(F.col("from") <= F.col("cut_from") - 1, inner), F.when(F.col("last") & (F.col("cut_from") > F.col("lo")) & (F.col("cut_to") < F.col("hi")), behind))
    found = met.select(F.col("hit_id").alias("__id"), F.inline(F.array_compact(parts)))
    found = found.withColumn("fragment", F.row_number().over(Window.partitionBy("__id").orderBy("frag_start")))
    both = hits.join(found, F.col("hit_id") == F.col("__id"), "left").drop("__id")
    return both.withColumns({"fragment": F.coalesce("fragment", F.lit(1)), "frag_start": F.coalesce("frag_start", lo), "frag_end": F.coalesce("frag_end", hi)})
