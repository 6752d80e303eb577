"""Operators over sequences: batching, masking, extraction, k-mers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.scalar import revcomp
from strandloom.operators.interval import truncated

FRAGMENT, OVERLAP = 60_000, 2_000


def fragments(seqs: DataFrame, fragment: int = FRAGMENT, overlap: int = OVERLAP, length_col: str = "length") -> DataFrame:
    """(seq_id, frag_no, start_pos, end_pos, is_last): long sequences in equal pieces that overlap; the rest goes to the last."""
    n = F.col(length_col)
    pieces = F.when(n > fragment, F.ceil((n - overlap) / (fragment - overlap))).otherwise(1).cast("long")
    rows = seqs.withColumn("__d", pieces).withColumn("__step", F.expr(f"({length_col} - {overlap}) div __d"))
    rows = rows.withColumn("frag_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__d") - 1)))
    last = F.col("frag_no") == F.col("__d") - 1
    start = F.when(F.col("__d") == 1, 0).otherwise(F.col("frag_no") * F.col("__step"))
    end = F.when(last, n).otherwise((F.col("frag_no") + 1) * F.col("__step") + overlap)
    return rows.select("seq_id", "frag_no", (start + 1).cast("long").alias("start_pos"), end.cast("long").alias("end_pos"), last.alias("is_last"))


def batches(frags: DataFrame, size: int, order: list[str]) -> DataFrame:
    """frags with batch_num: consecutive ones until `size` bases are reached, by the running total of lengths."""
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(F.col("end_pos") - F.col("start_pos") + 1).over(w), F.lit(0))
    return frags.withColumn("batch_num", F.floor(total / size).cast("long"))


def lifted(frag_hits: DataFrame, frags: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Hits of fragments in coordinates of their sequence, without those that lie wholly in the half of an overlap that is the neighbour's."""
    f = frags.select("seq_id", "frag_no", F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"), "is_last")
    rows = frag_hits.join(f, ["seq_id", "frag_no"])
    half = overlap // 2
    rows = rows.withColumn("query_start", F.col("query_start") + F.col("__s") - 1).withColumn("query_end", F.col("query_end") + F.col("__s") - 1)
    low = F.when(F.col("frag_no") == 0, F.lit(1)).otherwise(F.col("__s") + half)
    high = F.when(F.col("is_last"), F.col("__e")).otherwise(F.col("__e") - half)
    return rows.where((F.col("query_end") >= low) & (F.col("query_start") <= high)).drop("__s", "__e", "is_last")


def masked(seqs: DataFrame, hits: DataFrame, style: str = "N") -> DataFrame:
    """(seq_id, masked): sequences whose hit ranges are N, X or lower-case; query_name of hits is the seq_id as text.

    A sequence's disjoint ranges meet it in one array; the new text is built once from pieces, not range by range.
    """
    ranges = truncated(hits).groupBy("query_name").agg(F.array_sort(F.collect_list(F.struct(F.col("query_start").alias("s"), F.col("query_end").alias("e")))).alias("r"))
    both = seqs.join(ranges, seqs["seq_id"].cast("string") == F.col("query_name"), "left")
    seq, n = F.col("sequence"), F.length("sequence")

    def piece(x, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("r", i - 1)["e"])
        clear = F.substr(seq, (before + 1).cast("int"), F.greatest(F.lit(0), F.least(x["s"] - 1, n) - before).cast("int"))
        inside = F.substr(seq, x["s"].cast("int"), F.greatest(F.lit(0), x["e"] - x["s"] + 1).cast("int"))
        return F.concat(clear, F.lower(inside) if style == "lower" else F.repeat(F.lit(style), F.length(inside)))

    tail = F.substr(seq, (F.element_at("r", -1)["e"] + 1).cast("int"), n)
    done = F.concat(F.array_join(F.transform("r", piece), ""), tail)
    return both.select("seq_id", F.when(F.col("r").isNull(), seq).otherwise(done).alias("masked"))


def extracted(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """(hit_id, seq_id, region): the hits' parts of their sequences, reverse-complemented on the minus strand."""
    both = hits.join(seqs, F.col("query_name") == seqs["seq_id"].cast("string"))
    part = F.substr("sequence", F.col("query_start").cast("int"), (F.col("query_end") - F.col("query_start") + 1).cast("int"))
    return both.select("hit_id", "seq_id", F.when(F.col("orientation") == "C", revcomp(part)).otherwise(part).alias("region"))


def kmer_hits(seqs: DataFrame, pattern: list[int], seeds: DataFrame) -> DataFrame:
    """(seq_id, n): places whose letters at the pattern's offsets are one of the seeds (column `seed`); a sequence's equal places are counted before they meet the seeds."""
    span = max(pattern) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds, ns = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = Counter(map("".join, zip(*(text[o : len(text) - span + 1 + o] for o in pattern), strict=True)))
                ids += [i] * len(found)
                seeds += found.keys()
                ns += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(seeds, pa.string()), pa.array(ns, pa.int64())], ["seq_id", "seed", "n"])

    long = seqs.where(F.length("sequence") >= span).select("seq_id", "sequence")
    each = long.mapInArrow(counted, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, seed string, n long")
    return each.join(seeds, "seed", "left_semi").groupBy("seq_id").agg(F.sum("n").alias("n"))


def substring_checked(seqs: DataFrame, offset: int, length: int) -> DataFrame:
    """(seq_id, part): letters from a 0-based offset; sequences that are too short are refused, as rows of `ok` false."""
    ok = F.length("sequence") >= offset + length
    return seqs.select("seq_id", ok.alias("ok"), F.when(ok, F.substring("sequence", offset + 1, length)).alias("part"))


def wrapped(sequence, width: int = 50):
    """A FASTA body: lines of `width` letters."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n")
