"""Writers of annotation formats: each gives a DataFrame of lines (`line`), to be written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.sequence import wrapped


def strand_fields() -> list[Column]:
    """Subject start, end and rest in the order of the strand: turned and the rest first on the minus strand."""
    rest = F.concat(F.lit("("), F.col("subj_remaining"), F.lit(")"))
    minus = F.col("orientation") == "C"
    return [F.when(minus, rest).otherwise(F.col("subj_start").cast("string")), F.col("subj_end").cast("string"), F.when(minus, F.col("subj_start").cast("string")).otherwise(rest)]


def percent(c: str) -> Column:
    return F.format_string("%4.1f", F.col(c) / 10)


def out_table(hits: DataFrame) -> DataFrame:
    """The annotation table; columns are as wide as their longest value, found by one aggregate."""
    fields = {
        "score": F.col("score").cast("string"), "div": percent("div_permille"), "del": percent("del_permille"), "ins": percent("ins_permille"),
        "query": F.col("query_name"), "begin": F.col("query_start").cast("string"), "end": F.col("query_end").cast("string"), "left": F.lit("(0)"),
        "strand": F.col("orientation"), "name": F.col("subj_name"), "type": F.col("subj_type"),
    }
    fields |= dict(zip(("sa", "sb", "sc"), strand_fields(), strict=True)) | {"id": F.col("hit_id").cast("string")}
    rows = hits.select("hit_id", "query_name", "query_start", *[v.alias(f"f_{k}") for k, v in fields.items()])
    widths = rows.agg(*[F.max(F.length(f"f_{k}")).alias(k) for k in fields]).first().asDict()
    line = F.concat_ws(" ", *[F.lpad(f"f_{k}", widths[k] or 1, " ") if k not in ("query", "name", "type") else F.rpad(f"f_{k}", widths[k] or 1, " ") for k in fields])
    return rows.select("hit_id", line.alias("line"))


def native_lines(hits: DataFrame) -> DataFrame:
    """Aligner-like lines: name#class, no column widths."""
    minus = F.when(F.col("orientation") == "C", "C")
    return hits.select("hit_id", F.concat_ws(" ", "score", percent("div_permille"), percent("del_permille"), percent("ins_permille"), "query_name", "query_start", "query_end", F.lit("(0)"), minus, F.concat("subj_name", F.lit("#"), "subj_type"), *strand_fields(), F.concat(F.lit("m_b1s"), "stage", F.lit("i"), "hit_id")).alias("line"))


def _letters(s: Column) -> Column:
    return F.length(F.replace(s, F.lit("-"), F.lit("")))


def alignment_rows(query: str = "query_string", subj: str = "subj_string", width: int = 50) -> Column:
    """Rows of an alignment: the query forward, marks of what differs, the subject turned on the minus strand; places count letters."""
    pieces = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / width) - 1), lambda k: F.substr(F.col(s), (k * width + 1).cast("int"), F.lit(width)))).otherwise(F.array())
    q, d = pieces(query), pieces(subj)
    minus = F.col("orientation") == "C"
    changed = lambda a, b: (F.array_sort(F.array(a, b)) == F.array(F.lit("A"), F.lit("G"))) | (F.array_sort(F.array(a, b)) == F.array(F.lit("C"), F.lit("T")))
    mark = lambda a, b: F.when(a == b, " ").when((a == "-") | (b == "-"), "-").when(changed(a, b), "i").otherwise("v")

    def row(k: Column, a: Column) -> Column:
        b = F.get(d, k.cast("int"))
        before = lambda parts: F.aggregate(F.slice(parts, F.lit(1), k.cast("int")), F.lit(0), lambda n, x: n + _letters(x))
        q0 = F.col("query_start") + before(q)
        s0 = F.when(minus, F.col("subj_end") - before(d)).otherwise(F.col("subj_start") + before(d))
        s1 = F.when(minus, s0 - _letters(b) + 1).otherwise(s0 + _letters(b) - 1)
        head = F.greatest(F.length("query_name"), F.length("subj_name")) + 14
        marks = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), mark), "")
        place = lambda sign, name, at: F.concat(F.rpad(F.concat(sign, name), head - 12, " "), F.lpad(at.cast("string"), 11, " "), F.lit(" "))
        return F.concat_ws("\n", F.concat(place(F.lit("  "), F.col("query_name"), q0), a, F.lit(" "), q0 + _letters(a) - 1), F.concat(F.repeat(F.lit(" "), head), marks), F.concat(place(F.when(minus, "C ").otherwise("  "), F.col("subj_name"), s0), b, F.lit(" "), s1), F.lit(""))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(q) - 1), lambda k: row(k, F.get(q, k.cast("int")))), "\n")


def alignment_records(hits: DataFrame) -> DataFrame:
    """Records of hits with their alignments: a native line, the rows, and what is known of the pair (matrix, kimura, transitions, transversions)."""
    lines = native_lines(hits).withColumnRenamed("hit_id", "__id")
    pair = F.concat_ws("\n", F.concat(F.lit("Matrix = "), "matrix"), F.concat(F.lit("Kimura (with divCpGMod) = "), F.format_string("%.2f", "kimura")), F.concat(F.lit("Transitions / transversions = ("), "transitions", F.lit("/"), "transversions", F.lit(")")), F.lit("Gap_init rate = 0.00"))
    return hits.join(lines, F.col("hit_id") == F.col("__id")).select("hit_id", F.concat_ws("\n", "line", F.lit(""), F.when((F.length("query_string") > 0) & (F.length("subj_string") > 0), alignment_rows()), pair, F.lit("")).alias("line"))


def _sign() -> Column:
    return F.when(F.col("orientation") == "C", "-").otherwise("+")


def match_lines(hits: DataFrame) -> DataFrame:
    """Lines of the plain match format: name#class, always with a strand, then a star where a better hit overlaps (`overlap`)."""
    mark = F.when(F.col("overlap"), "*").otherwise("")
    return hits.select("hit_id", F.concat_ws(" ", "score", percent("div_permille"), percent("del_permille"), percent("ins_permille"), "query_name", "query_start", "query_end", F.lit("(0)"), "orientation", F.concat("subj_name", F.lit("#"), "subj_type"), *strand_fields(), mark).alias("line"))


def motif_lines(hits: DataFrame, source: str = "strandloom") -> DataFrame:
    """Motif homologies of an ACeDB file, the subject's end before its start on both strands."""
    return hits.select("hit_id", F.concat_ws(" ", F.concat(F.lit('Motif_homol "'), "subj_name", F.lit(f'" "{source}"')), percent("div_permille"), "query_start", "query_end", _sign(), "subj_end", "subj_start").alias("line"))


def polymorphic(hits: DataFrame) -> DataFrame:
    """The simple repeats likely to differ between individuals: below 10 percent of differences and gaps; for out_table()."""
    return hits.where((F.col("subj_type") == "Simple_repeat") & (F.col("div_permille") + F.col("del_permille") + F.col("ins_permille") < 100))


def gff2(hits: DataFrame, source: str = "strandloom") -> DataFrame:
    """Similarities with their motif as target, for duplicated segments."""
    target = F.concat(F.lit('Target "Motif:'), "subj_name", F.lit('" '), "subj_start", F.lit(" "), "subj_end")
    return hits.select("hit_id", F.concat_ws("\t", "query_name", F.lit(source), F.lit("similarity"), "query_start", "query_end", "score", _sign(), F.lit("."), target).alias("line"))


def gff3(hits: DataFrame) -> DataFrame:
    """Features, after a region line for each sequence (rank 0)."""
    body = hits.select("query_name", F.lit(1).alias("rank"), "query_start", F.concat_ws("\t", "query_name", F.lit("strandloom"), F.lit("dispersed_repeat"), "query_start", "query_end", "score", F.when(F.col("orientation") == "C", "-").otherwise("+"), F.lit("."), F.concat(F.lit("Target="), "subj_name", F.lit(" "), "subj_start", F.lit(" "), "subj_end")).alias("line"))
    heads = hits.groupBy("query_name").agg(F.max("query_end").alias("n")).select("query_name", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("query_start"), F.concat(F.lit("##sequence-region "), "query_name", F.lit(" 1 "), "n").alias("line"))
    return heads.unionByName(body)


def bed(hits: DataFrame) -> DataFrame:
    """0-based half-open rows (chrom, start, stop, family, size, strand, class, subclass, diverge, linkage_id)."""
    parts = F.split("subj_type", "/")
    return hits.select(F.col("query_name").alias("chrom"), (F.col("query_start") - 1).alias("start"), F.col("query_end").alias("stop"), F.col("subj_name").alias("family"), (F.col("query_end") - F.col("query_start") + 1).alias("size"), F.when(F.col("orientation") == "C", "-").otherwise("+").alias("strand"), parts[0].alias("class"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("subclass"), F.coalesce(F.col("div_permille") / 10, F.lit(-1.0)).alias("diverge"), F.col("hit_id").alias("linkage_id"))


def write_bed(hits: DataFrame, path: str, split_by: str | None = None, least_hits: int = 1) -> None:
    """BED files, in folders by family, class or the like, groups of too few hits left out."""
    rows = bed(hits)
    if split_by:
        rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(split_by))).where(F.col("__n") >= least_hits).drop("__n")
        rows.sortWithinPartitions("chrom", "start").write.partitionBy(split_by).option("sep", "\t").csv(path)
    else:
        rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.option("sep", "\t").csv(path)


def fasta(seqs: DataFrame, width: int = 50) -> DataFrame:
    return seqs.select("seq_id", F.concat(F.lit(">"), "seq_id", F.lit("\n"), wrapped(F.col("sequence"), width)).alias("line"))


def family_fasta(families: DataFrame) -> DataFrame:
    """Headers of accession, name and class."""
    return families.select("accession", F.concat(F.lit(">"), "accession", F.lit(" "), "name", F.lit("#"), "repeat_type", F.lit("/"), "repeat_subtype").alias("line"))


def family_embl(families: DataFrame) -> DataFrame:
    lines = [F.concat(F.lit("ID   "), "accession", F.lit("; "), "length", F.lit(" BP.")), F.concat(F.lit("DE   "), "name"), F.concat(F.lit("CC   Type: "), "repeat_type"), F.concat(F.lit("CC   SubType: "), "repeat_subtype"), F.lit("//")]
    return families.select("accession", F.concat_ws("\n", *lines).alias("line"))


def summary_table(coverage: DataFrame, total: int) -> DataFrame:
    """Lines of a class table: (subj_type, n_hits, bp) with the share of the total."""
    return coverage.select("subj_type", F.concat(F.rpad("subj_type", 20, " "), F.lpad(F.format_number("n_hits", 0), 10, " "), F.lpad(F.format_number("bp", 0), 14, " "), F.lit(" bp "), F.lpad(F.format_string("%.2f", 100 * F.col("bp") / total), 7, " "), F.lit(" %")).alias("line"))
