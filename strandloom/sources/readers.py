"""Readers of annotation formats: each gives a typed DataFrame, by built-in text reading and column expressions.

Formats whose records span lines are read with a record separator, so that a file splits between records; gzip is
read by its extension. Hit reports with alignments are read a file at a time in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

HIT_SCHEMA = (
    "score double, pct_diverge double, pct_delete double, pct_insert double, query_name string, query_start long, query_end long, query_remaining long,"
    " orientation string, subj_name string, subj_type string, subj_start long, subj_end long, subj_remaining long, id string, lineage_id string, overlap string"
)


def fasta(spark: SparkSession, path: str, max_id: int = 50, clean: bool = True) -> DataFrame:
    """(seq_id, description, sequence): records of FASTA; `clean` upper-cases letters and blanks what can't be printed.

    A record without an id is named UnnamedSeq; an id longer than max_id is an error when its row is used.
    """
    raw = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r$", "")
    body = F.when(F.locate("\n", F.col("value")) > 0, F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 2)).otherwise("")
    seq = F.regexp_replace(body, r"\s+", "")
    seq = F.upper(F.regexp_replace(seq, r"[^\x21-\x7E]", "")) if clean else seq
    name = F.regexp_extract(head, r"^\s*(\S+)", 1)
    named = F.when(name == "", F.lit("UnnamedSeq")).otherwise(name)
    checked = F.when(F.length(named) > max_id, F.raise_error(F.concat(F.lit("id too long: "), named))).otherwise(named)
    rows = raw.where(F.trim("value") != "")
    return rows.select(checked.alias("seq_id"), F.regexp_extract(head, r"^\s*\S+\s+(.*)$", 1).alias("description"), seq.alias("sequence"))


def parse_hit(line: str) -> tuple | None:
    """One line of any of the hit layouts, or None: 14 fields or so, class apart or joined by #, strand C with turned ends."""
    if not re.match(r"\s*\d+(\.\d+)?\s+\d+(\.\d+)?\s", line):
        return None
    f = line.split()
    if len(f) < 11 or not f[5].isdigit():
        return None
    star = f[-1] == "*"
    f = f[:-1] if star else f
    score, div, dele, ins, query, qs, qe, left = f[:8]
    rest = f[8:]
    strand = "C" if rest[0] in ("C", "-") else "+"
    rest = rest[1:] if rest[0] in ("C", "+", "-") else rest
    name, rest = rest[0], rest[1:]
    kind = None
    if "#" in name:
        name, kind = name.split("#", 1)
    elif rest and not re.fullmatch(r"\(?-?\d+\)?", rest[0]):
        kind, rest = rest[0], rest[1:]
    a, b, c = (int(x.strip("()")) for x in rest[:3])
    start, end, remaining = (c, b, a) if rest[0].startswith("(") else (a, b, c) if rest[2].startswith("(") else (min(a, b), max(a, b), c)
    more = rest[3:]
    lineage = more[0] if more and re.match(r"[mc]_b\d+s\d+i\d+|\[", more[0]) else None
    ident = more[1] if lineage and len(more) > 1 else more[0] if more and not lineage else None
    return (float(score), float(div), float(dele), float(ins), query, int(qs), int(qe), int(left.strip("()")), strand, name, kind, start, end, remaining, ident, lineage, "*" if star else None)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a report, one a line; headers and alignments are passed over, and what follows a score histogram."""

    names = [c.strip().split()[0] for c in HIT_SCHEMA.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for text in pdf["value"] for line in text.split("Score histogram:")[0].splitlines() if (r := parse_hit(line))]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(run, HIT_SCHEMA)


def hits_from_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Hits of lines that are rows already."""
    names = [c.strip().split()[0] for c in HIT_SCHEMA.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([r for line in pdf[column] if (r := parse_hit(line))], columns=names)

    return lines.select(column).mapInPandas(run, HIT_SCHEMA)


BLAST_SCHEMA = "score double, perc_sub double, perc_query_gap double, perc_db_gap double, qseqid string, qstart long, qend long, qlen long, sstrand string, sseqid string, sstart long, send long, slen long, kdiv double, cpg_kdiv double, transi int, transv int, cpg_sites int, qseq string, sseq string"


def blast_tab(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignments of 18 or 20 fields; on the minus strand the subject's ends are turned."""
    raw = spark.read.schema(BLAST_SCHEMA).option("sep", "\t").option("comment", "#").csv(path)
    minus = F.col("sstrand") == "minus"
    return raw.select(
        "score", F.col("perc_sub").alias("pct_diverge"), F.col("perc_db_gap").alias("pct_delete"), F.col("perc_query_gap").alias("pct_insert"),
        F.col("qseqid").alias("query_name"), F.col("qstart").alias("query_start"), F.col("qend").alias("query_end"), (F.col("qlen") - F.col("qend")).alias("query_remaining"),
        F.when(minus, "C").otherwise("+").alias("orientation"), F.substring_index("sseqid", "#", 1).alias("subj_name"), F.when(F.col("sseqid").contains("#"), F.regexp_extract("sseqid", "#(.*)$", 1)).alias("subj_type"),
        F.least("sstart", "send").alias("subj_start"), F.greatest("sstart", "send").alias("subj_end"), (F.col("slen") - F.greatest("sstart", "send")).alias("subj_remaining"), F.col("qseq").alias("query_string"), F.col("sseq").alias("subj_string"),
    )


def tandem(spark: SparkSession, path: str) -> DataFrame:
    """Tandem repeats of a `.dat` report: a Sequence: line, then lines of 15 fields."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["value"]:
                name = ""
                for line in text.splitlines():
                    f = line.split()
                    if line.startswith("Sequence:"):
                        name = f[1] if len(f) > 1 else ""
                    elif len(f) >= 15 and f[0].isdigit():
                        rows.append((name, int(f[0]), int(f[1]), int(f[2]), float(f[3]), int(f[4]), int(f[5]), int(f[6]), int(f[7]), f[13]))
            yield pd.DataFrame(rows, columns=["query_name", "query_start", "query_end", "period", "copy_number", "consensus_size", "pct_match", "pct_indel", "score", "consensus"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "query_name string, query_start long, query_end long, period int, copy_number double, consensus_size int, pct_match int, pct_indel int, score long, consensus string")


def embl(spark: SparkSession, path: str) -> DataFrame:
    """Families of a tagged flat file: (accession, name, description, keywords, repeat_type, length, consensus)."""
    raw = spark.read.text(path, lineSep="//\n").where(F.trim("value") != "")
    tag = lambda t: F.array_join(F.transform(F.regexp_extract_all("value", F.lit(f"(?m)^{t}   (.*)$"), F.lit(1)), lambda x: F.trim(x)), " ")
    first = lambda t: F.regexp_extract("value", f"(?m)^{t}   ([^;\\s]+)", 1)
    sub = lambda k: F.regexp_extract("value", f"(?m)^CC\\s+{k}:\\s*(.*)$", 1)
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ[^\n]*\n(.*)$", 1), r"[\s\d/]+", "")
    return raw.select(first("AC").alias("accession"), first("ID").alias("name"), tag("DE").alias("description"), F.split(F.regexp_replace(tag("KW"), r"\.$", ""), r"\s*;\s*").alias("keywords"), F.concat_ws("/", sub("Type"), F.nullif(sub("SubType"), F.lit(""))).alias("repeat_type"), F.length(seq).cast("long").alias("length"), F.upper(seq).alias("consensus"))


def hmm(spark: SparkSession, path: str) -> DataFrame:
    """Headers of profile models: (name, accession, description, length, max_length, thresholds)."""
    raw = spark.read.text(path, lineSep="//\n").where(F.trim("value") != "")
    tag = lambda t: F.regexp_extract("value", f"(?m)^{t}\\s+(.*?)\\s*$", 1)
    return raw.select(tag("NAME").alias("name"), tag("ACC").alias("accession"), tag("DESC").alias("description"), tag("LENG").try_cast("int").alias("length"), tag("MAXL").try_cast("int").alias("max_length"), F.regexp_extract_all("value", F.lit(r"(?m)^TH\s+(.*)$"), F.lit(1)).alias("thresholds"))


def matrix(text: str):
    """A scoring matrix: comments, a FREQS line or a quarter for each base, a row of letters, rows of scores with or without their letter."""
    from strandloom.functions.alignment import Matrix

    freqs, letters, score, row = {}, [], {}, 0
    for line in text.splitlines():
        f = line.split("#")[0].split()
        if not f:
            continue
        if f[0] == "FREQS":
            freqs = {a: float(b) for a, b in zip(f[1::2], f[2::2], strict=True)}
        elif not letters:
            letters = f
        else:
            own = letters[row]
            if not re.fullmatch(r"-?\d+", f[0]):
                own, f = f[0], f[1:]
            score |= {(own, b): int(v) for b, v in zip(letters, f, strict=True)}
            row += 1
    return Matrix(score, freqs or dict.fromkeys("ACGT", 0.25))


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, tax_id) of a JSON object of names."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,long>")).alias("name", "tax_id"))


def genome_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_name string, length long").option("sep", "\t").csv(path)


def qualities(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, values): records of base qualities."""
    raw = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    body = F.substr("value", F.length(F.substring_index("value", "\n", 1)) + 2)
    return raw.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("seq_id"), F.transform(F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " "), lambda x: x.cast("int")).alias("values"))


def report_totals(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a report's `## key: value` header lines."""
    return spark.read.text(path).where(F.col("value").rlike("^## [^:]+:")).select(F.regexp_extract("value", "^## ([^:]+):", 1).alias("key"), F.trim(F.regexp_extract("value", "^## [^:]+:(.*)$", 1)).alias("value"))
