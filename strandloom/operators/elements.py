"""Operators on repeat elements: ages, inserts, inversions, edges, names and coordinates of consensi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.interval import by_position, overlap_pairs

#: Divergence (thousandths) below which an element of a class is younger than a split of species, and above which older.
SPLITS = {"SINE/Alu": (60, 120), "LINE/L1": (80, 160), "LTR/ERVL": (100, 200)}
# Families of one frame, the chain's start above which they are moved, and what is subtracted
FRAMES = [
    ("^MLT2A", 270, -108),
    ("^MLT2B[12]$", 265, -47),
    ("^MLT2B5$", 415, 162),
    ("^MLT2B5$", 180, 116),
    ("^MLT2C1$", 220, -166),
    ("^MLT2C2$", 275, -95),
    ("^MLT2D$", 225, -146),
    ("^MLT2E$", 520, 65),
    ("^MLT2F$", 550, 100),
]


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def aged(hits: DataFrame) -> DataFrame:
    """(hit_id, age): X younger than the split by a quarter, 0 older by a quarter, ? between or unknown."""
    low = lookup({k: v[0] for k, v in SPLITS.items()}, F.col("subj_type"))
    high = lookup({k: v[1] for k, v in SPLITS.items()}, F.col("subj_type"))
    d = F.col("div_permille")
    return hits.select("hit_id", F.when(d * 4 < low * 3, "X").when(d * 4 > high * 5, "0").otherwise("?").alias("age"))


def joined_by_class(hits: DataFrame, least: int = 33) -> DataFrame:
    """hits with run: hits of one class and strand of which each overlaps what is before by more than `least` bases, or lies inside."""
    w = Window.partitionBy("query_name", "subj_type", "orientation").orderBy(*by_position())
    before = F.max("query_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = (before - F.col("query_start") + 1 > least) | (before >= F.col("query_end"))
    return hits.withColumn("__f", F.coalesce((~goes_on).cast("long"), F.lit(1))).withColumn("run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def inserts(hits: DataFrame, edge: int = 5) -> DataFrame:
    """(hit_id, n_inserts, first_at, last_at): foreign elements inside each one, away from its edges."""
    h = hits.select("hit_id", "query_name", "query_start", "query_end", "subj_name")
    p = overlap_pairs(h, h).where((F.col("r_query_start") > F.col("l_query_start") + edge) & (F.col("r_query_end") < F.col("l_query_end") - edge) & (F.col("l_subj_name") != F.col("r_subj_name")))
    return p.groupBy(F.col("l_hit_id").alias("hit_id")).agg(F.count(F.lit(1)).alias("n_inserts"), F.min("r_query_start").alias("first_at"), F.max("r_query_end").alias("last_at"))


def inversions(hits: DataFrame, ahead: int = 5, most_gap: int = 20) -> DataFrame:
    """Pairs of LINE elements on opposite strands, at most `ahead` ranks and `most_gap` bases apart, whose consensus gap is allowed."""
    r = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_name").orderBy(*by_position()))).where("subj_type like 'LINE%'")
    steps = r.withColumn("__t", F.explode(F.array(*map(F.lit, range(1, ahead + 1))))).withColumn("__t", F.col("rank") + F.col("__t"))
    o = r.select(*[F.col(c).alias(f"o_{c}") for c in ("hit_id", "query_name", "rank", "query_start", "orientation", "subj_start", "subj_name", "div_permille")])
    both = steps.join(o, (F.col("query_name") == F.col("o_query_name")) & (F.col("__t") == F.col("o_rank")) & (F.col("orientation") != F.col("o_orientation")))
    gap = F.greatest(F.lit(0), F.col("o_query_start") - F.col("query_end") - 1)
    allowed = 175 - 2 * F.abs(F.col("div_permille") - F.col("o_div_permille")) - 5 * gap + F.when(F.col("subj_name") == F.col("o_subj_name"), 50).otherwise(0)
    return both.where((gap <= most_gap) & (F.abs(F.col("o_subj_start") - F.col("subj_end")) <= allowed)).select("hit_id", F.col("o_hit_id").alias("partner_id"), gap.alias("gap"))


def once_in_tandem(hits: DataFrame, most_gap: int = 30, slack: int = 15) -> DataFrame:
    """hits without repeats of the one before: same name and strand, close by, all consensus edges alike; SINEs stay."""
    w = Window.partitionBy("query_name", "subj_name", "orientation").orderBy("query_start", "hit_id")
    prev = lambda c: F.lag(c).over(w)
    same = ~F.col("subj_type").like("SINE%") & (F.col("query_start") - prev("query_end") < most_gap) & (F.abs(F.col("subj_start") - prev("subj_start")) <= slack) & (F.abs(F.col("subj_end") - prev("subj_end")) <= slack)
    return hits.withColumn("__s", F.coalesce(same, F.lit(False))).where(~F.col("__s")).drop("__s")


def trimmed_edges(hits: DataFrame, known: int = 4) -> DataFrame:
    """hits whose end gives way to the next one where that begins at its consensus' end and they overlap; ranges never turn."""
    w = Window.partitionBy("query_name").orderBy(*by_position())
    nxt = lambda c: F.lead(c).over(w)
    give = (nxt("query_start") <= F.col("query_end")) & (nxt("subj_start") <= known) & (nxt("query_start") > F.col("query_start"))
    return hits.withColumn("query_end", F.when(F.coalesce(give, F.lit(False)), nxt("query_start") - 1).otherwise(F.col("query_end")))


def anchored(hits: DataFrame, shifts: DataFrame, chain_begin: Column | None = None) -> DataFrame:
    """hits with consensus coordinates in the common frame of their family.

    `shifts` has (name, shift) for families with a place on a longer scaffold, one row a name, and is joined; the families of
    FRAMES are moved by where their chain begins (by default the hit itself). Others stay.
    """
    begin = F.col("subj_start") if chain_begin is None else chain_begin
    moved = F.lit(0)
    for pattern, above, less in reversed(FRAMES):
        moved = F.when(F.col("subj_name").rlike(pattern) & (begin > above), -less).otherwise(moved)
    named = shifts.select(F.col("name").alias("__name"), F.col("shift").alias("__s"))
    both = hits.join(named, F.col("subj_name") == F.col("__name"), "left").withColumn("__m", F.coalesce("__s", moved).cast("long"))
    return both.withColumns({"subj_start": F.col("subj_start") + F.col("__m"), "subj_end": F.col("subj_end") + F.col("__m")}).drop("__name", "__s", "__m")


def ambiguous(hits: DataFrame, group: list[str], generic: Column, points: int = 10, most: int = 10) -> DataFrame:
    """(group, n_close, name): the best-scoring name, or the generic one where more than `most` others come within `points` of it."""
    best = F.max("score").over(Window.partitionBy(*group))
    close = hits.withColumn("__b", best).withColumn("__g", generic).where(F.col("score") >= F.col("__b") - points)
    g = close.groupBy(*group).agg((F.count(F.lit(1)) - 1).alias("n_close"), F.max_by("subj_name", F.struct("score", "hit_id")).alias("b"), F.max_by("__g", F.struct("score", "hit_id")).alias("t"))
    return g.select(*group, "n_close", F.when(F.col("n_close") > most, F.col("t")).otherwise(F.col("b")).alias("name"))


def without_lone_fragments(hits: DataFrame, linked: Column) -> DataFrame:
    """hits without those of less than 10 bases that belong to no chain."""
    return hits.where(linked | (F.col("query_end") - F.col("query_start") + 1 >= 10))


def without_fragments(hits: DataFrame, simple: bool = True) -> DataFrame:
    """hits without those of at most 10 bases, or 5 for simple repeats; with `simple` off, without simple and low-complexity ones."""
    step = F.col("query_end") - F.col("query_start")
    kept = hits.where(~(((~F.col("subj_type").contains("Simple")) & (step < 10)) | (step < 5)))
    return kept if simple else kept.where(~F.col("subj_type").rlike("Low_complexity|Simple_repeat"))


def full_length_alu(name: Column, begin: Column, end: Column, left: Column) -> Column:
    """Whether an element is whole but for its tail: an Alu by its ends' places, any other by what is missing."""
    return (name.rlike("^Alu") & (begin < 70) & (end > 185)) | ((begin < 6) & (left < 5))


def full_length(family: Column, begin: Column, left: Column) -> Column:
    """Whether an element, by name#class, is whole enough to be cut out: no LINEs; SINEs may lack 19 bases of their tail; no small RNAs' kin."""
    whole = ((begin < 6) & (left < 5) & ~family.contains("LINE")) | (family.contains("SINE") & (begin < 6) & (left < 20))
    return whole & ~family.rlike(r"^BC[12]\S+SINE")


def display_names(name: Column) -> Column:
    """LINE names without the marks of their parts."""
    return F.regexp_replace(F.regexp_replace(name, "_(orf2|3end|5end|5endX|3endX)$", ""), "_strong$", "")


def translated_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """hits with the new number of their id; ids: (old_id, new_id), one row each."""
    return hits.join(ids, F.col("subj_name") == F.col("old_id")).drop("old_id")
