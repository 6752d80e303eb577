"""Families and the tree of taxa: lineages, filters, names, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.scalar import sanitized, soundex


def lineages(taxa: DataFrame) -> DataFrame:
    """(tax_id, ancestor, depth, path): every taxon with each of its ancestors and itself, by recursive SQL."""
    taxa.createOrReplaceTempView("strandloom_taxa")
    return taxa.sparkSession.sql("""
WITH RECURSIVE up(tax_id, ancestor, depth, path) AS (
  SELECT tax_id, tax_id, 0, name FROM strandloom_taxa
  UNION ALL
  SELECT up.tax_id, t.parent_id, up.depth + 1, concat(p.name, ';', up.path) FROM up JOIN strandloom_taxa t ON t.tax_id = up.ancestor JOIN strandloom_taxa p ON p.tax_id = t.parent_id
) SELECT tax_id, ancestor, depth, path FROM up""")


def full_paths(taxa: DataFrame) -> DataFrame:
    """(tax_id, depth, path): the whole lineage of each taxon from the root."""
    lin = lineages(taxa)
    top = lin.groupBy("tax_id").agg(F.max("depth").alias("depth"), F.max_by("path", "depth").alias("path"))
    return top


def is_a(taxa: DataFrame, ancestor: str) -> DataFrame:
    """The taxa at or below one."""
    return lineages(taxa).where(F.col("ancestor") == ancestor).select("tax_id")


def curated(accession: Column) -> Column:
    """Not DR and nine digits."""
    return ~accession.rlike("^DR[0-9]{9}$")


def filtered(families: DataFrame, stage: int | None = None, type_prefix: str | None = None, name_prefix: str | None = None, only_curated: bool | None = None) -> DataFrame:
    """families that pass all given filters."""
    if stage is not None:
        families = families.where(F.col("stage") == stage)
    if type_prefix:
        families = families.where(F.lower("repeat_type").startswith(type_prefix.lower()))
    if name_prefix:
        families = families.where(F.lower("name").startswith(name_prefix.lower()))
    if only_curated is not None:
        families = families.where(~F.col("is_uncurated") if only_curated else F.col("is_uncurated"))
    return families


def in_lineage(families: DataFrame, taxa: DataFrame, tax_id: str, ancestors: bool = True, descendants: bool = True) -> DataFrame:
    """Families of a taxon and, as asked for, of those above and below it, each once with its role."""
    lin = lineages(taxa)
    above = lin.where(F.col("tax_id") == tax_id).select(F.col("ancestor").alias("clade"), F.when(F.col("depth") == 0, "own").otherwise("ancestor").alias("role"))
    below = lin.where((F.col("ancestor") == tax_id) & (F.col("depth") > 0)).select(F.col("tax_id").alias("clade"), F.lit("descendant").alias("role"))
    wanted = above if ancestors else above.where("role = 'own'")
    wanted = wanted.unionByName(below) if descendants else wanted
    return families.join(F.broadcast(wanted), "clade")  # the tree's part is far smaller than the families


def lineage_totals(families: DataFrame, taxa: DataFrame, tax_id: str) -> DataFrame:
    """(role, n): families by the least role they have, each counted once."""
    return in_lineage(families, taxa, tax_id).groupBy("accession").agg(F.min("role").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def resolve_names(taxa: DataFrame, term: str) -> DataFrame:
    """(tax_id, name, match): exact names, then sanitised ones, parts of names, and names that sound alike."""
    name, t = F.lower("name"), F.lit(term.lower())
    kind = F.when(name == t, 1).when(F.lower(sanitized(F.col("name"))) == F.lower(sanitized(F.lit(term))), 2).when(name.contains(t), 3).when(soundex(F.lower("name")) == soundex(F.lower(F.lit(term))), 4)
    return taxa.select("tax_id", "name", kind.alias("match")).where("match is not null")


def appended(families: DataFrame, new: DataFrame) -> DataFrame:
    """families and the new ones whose accession isn't there, of new ones with one accession the first by name."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy("accession").orderBy("name"))).where("__r = 1").drop("__r")
    return families.unionByName(first.join(families, "accession", "left_anti"))
