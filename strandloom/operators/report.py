"""Grouped reports over hits and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.graph_groups import GRAPH_GROUPS
from strandloom.operators.interval import newly_covered

#: Classes that are not interspersed repeats.
OTHER_CLASSES = ("Simple_repeat", "Low_complexity", "Satellite", "snRNA", "rRNA", "tRNA")
#: Super-classes by pattern; a class may answer to several.
SUPER = {
    "SINE": r"SINE",
    "LINE": r"^LINE",
    "PLE": r"^PLE",
    "LINECR1": r"/CR1$|/L2$|/Rex-Babar$",
    "LINEI": r"/R1$|/LOA$|/I$|/Jockey$",
    "LINERTE": r"/RTE|/Bov-B",
    "LINER2": r"/NeSL|/R[24]|/Dong",
    "LTR": r"^LTR",
    "LTRERV": r"ERV|ERVL-MaLR",
    "LTRBEL": r"Pao$",
    "LTRGYP": r"DIRS$|Gypsy$",
    "DNA": r"^DNA",
    "DNATC1": r"/TcMar|/Stowaway",
    "DNAHAT": r"/[hH]AT|Tam3$",
    "DNAPIG": r"/T2$|/PiggyBac",
    "DNAH": r"Harbing|Tourist",
    "DNAP": r"/P$|/Mirage|/Transib",
    "OTHER": r"^Unknown|^Composite|^Other",
    "RC": r"^RC/",
    "RNA": r"RNA$",
    "SATEL": r"Satel",
    "SIMPLE": r"Simple",
    "LOWCOMP": r"^Low",
}


def length() -> Column:
    return F.col("query_end") - F.col("query_start") + 1


def sure(subj_type: Column) -> Column:
    """A class without the question mark of a doubtful one."""
    return F.regexp_replace(subj_type, r"\?$", "")


def class_coverage(hits: DataFrame, is_head: Column | None = None) -> DataFrame:
    """(subj_type, n_hits, bp): elements and newly covered bases of each class; is_head: whether a hit is its element's first fragment."""
    head = F.lit(True) if is_head is None else is_head
    each = newly_covered(hits.withColumn("__head", head)).withColumn("subj_type", sure(F.col("subj_type")))
    return each.groupBy("subj_type").agg(F.count_if("__head").alias("n_hits"), F.sum("new_bp").alias("bp"))


def super_classes(hits: DataFrame, is_head: Column | None = None) -> DataFrame:
    """As class_coverage() by patterns that may overlap; what none takes is OTHER."""
    head = F.lit(True) if is_head is None else is_head
    each = newly_covered(hits.withColumn("__head", head)).withColumn("__t", sure(F.col("subj_type")))
    own = F.filter(F.array(*[F.when(F.col("__t").rlike(p), n) for n, p in SUPER.items()]), lambda x: x.isNotNull())
    each = each.withColumn("super", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("OTHER")))))
    return each.groupBy("super").agg(F.count_if("__head").alias("n_hits"), F.sum("new_bp").alias("bp"))


def composition(seqs: DataFrame) -> DataFrame:
    """(seq_id, length, xn_length, subt_length, gc_length): all, without long runs of N or X, without ambiguous letters, G and C."""
    s = F.col("sequence")
    return seqs.select(
        "seq_id",
        F.length(s).cast("long").alias("length"),
        F.length(F.regexp_replace(s, "[XN]{20,}", "")).cast("long").alias("xn_length"),
        F.length(F.translate(s, "XNRYMK", "")).cast("long").alias("subt_length"),
        (F.length(s) - F.length(F.translate(s, "GC", ""))).cast("long").alias("gc_length"),
    )


def rolled_up(hits: DataFrame) -> DataFrame:
    """(type, subtype, n_elements, bp) with subtotals by type and a total: an id counts once."""
    parts = F.split("subj_type", "/")
    rows = newly_covered(hits).withColumn("type", parts[0]).withColumn("subtype", F.coalesce(F.get(parts, F.lit(1)), F.lit("-")))
    return rows.rollup("type", "subtype").agg(F.count_distinct("subj_name").alias("n_elements"), F.sum("new_bp").alias("bp"))


def weighted_divergence(hits: DataFrame) -> DataFrame:
    """(subj_type, subj_name, bp, weighted): bases, and divergence (at most 700 thousandths) times bases."""
    return hits.groupBy("subj_type", "subj_name").agg(F.sum(length()).alias("bp"), F.sum(F.least(F.col("div_permille"), F.lit(700)) * length()).alias("weighted"))


def divergence_histogram(hits: DataFrame, classes: list[str], most: int = 70) -> DataFrame:
    """A row for each whole percent of divergence from 0 on, a column of bases for each class."""
    bins = hits.withColumn("div", F.floor(F.col("div_permille") / 10).cast("long")).groupBy("div").pivot("subj_type", classes).agg(F.sum(length()))
    spine = hits.sparkSession.range(most + 1).withColumnRenamed("id", "div")
    return spine.join(bins, "div", "left").select("div", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c.replace("/", "_").replace("-", "_").lower()) for c in classes])


def graph_group(subj_type: Column) -> Column:
    """The group of a class in graphs: question marks out, then by the table of names."""
    name = F.translate(subj_type, "?", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GRAPH_GROUPS.items() for x in kv]), name), name)


def landscape(hits: DataFrame, most: int = 50, least_hits: int = 1) -> DataFrame:
    """(grp, div, bp): bases by graph group and whole percent, groups of enough hits only."""
    g = hits.withColumn("grp", graph_group(F.col("subj_type"))).withColumn("div", F.floor(F.col("div_permille") / 10).cast("long"))
    bins = g.groupBy("grp", "div").agg(F.sum(length()).alias("bp"), F.count(F.lit(1)).alias("__n"))  # before the window: a row a group and percent
    enough = F.sum("__n").over(Window.partitionBy("grp")) >= least_hits
    return bins.withColumn("__e", enough).where(F.col("__e") & (F.col("div") <= most)).select("grp", "div", "bp")


def block_records(hits: DataFrame, keys: tuple[str, ...] = ("query_name", "subj_name")) -> DataFrame:
    """One record for all fragments of a chain: outer range, block sizes and starts (0-based), mean divergence."""
    frag = F.array_sort(F.collect_list(F.struct("query_start", "query_end", "hit_id")))
    g = hits.groupBy(*keys).agg(frag.alias("f"), F.min("query_start").alias("lo"), F.max("query_end").alias("hi"), F.sum("div_permille").alias("d"), F.count(F.lit(1)).alias("n"))
    joined = lambda c: F.array_join(F.transform("f", c), ",")
    return g.select(*keys, (F.col("lo") - 1).alias("chrom_start"), F.col("hi").alias("chrom_end"), F.col("n").alias("block_count"), F.least(F.lit(1000), F.expr("d div n")).cast("long").alias("score"), joined(lambda x: (x["query_end"] - x["query_start"] + 1).cast("string")).alias("block_sizes"), joined(lambda x: (x["query_start"] - F.col("lo")).cast("string")).alias("block_starts"))


def widths(hits: DataFrame, columns: list[str]) -> DataFrame:
    return hits.agg(*[F.max(F.length(F.col(c).cast("string"))).cast("long").alias(f"w_{c}") for c in columns])


def seed_clusters(hits: DataFrame, most_gap: int = 7000) -> DataFrame:
    """(query_name, subj_name, cluster, lo, hi, n, seeds): runs of seeds of one family at most `most_gap` apart."""
    w = Window.partitionBy("query_name", "subj_name").orderBy("query_start", "hit_id")
    before = F.max("query_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("query_start") - before > most_gap, F.lit(True)).cast("long")
    rows = hits.withColumn("__f", fresh).withColumn("cluster", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("query_name", "subj_name", "cluster").agg(F.min("query_start").alias("lo"), F.max("query_end").alias("hi"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("hit_id")), lambda x: x.cast("string")), ",").alias("seeds"))
