"""Ordered folds over sequences of any length, dealt in slices.

A sequence's rows are numbered and cut into slices, so that one sequence is many groups. A fold passes a small state from
slice to slice. All slices run at once with the state that a sequence begins with; then those whose state turns out to be
another one run again with that, until none is left. Most folds forget: a few slices run a second time, and the result is
that of one pass over the whole sequence whatever the slices' size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a slice, and bases of a bin in which rows are numbered.
SLICE_ROWS, BIN_BASES = 4096, 1 << 17


def order_of_hits() -> list[Column]:
    return [F.col("query_start"), F.desc("query_end"), F.desc("score"), F.col("hit_id")]


def numbered_rows(rows: DataFrame, order: list[Column] | None = None, key: str = "query_name", at: str = "query_start", out: str = "rank", width: int = BIN_BASES) -> DataFrame:
    """rows with their number on the sequence, from 1. Counted by bin and added up over bins, so that no task has a whole sequence; the order begins with `at`, and `width` is a bin's."""
    binned = rows.withColumn("__bin", F.floor(F.col(at) / width))
    so_far = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(F.col(key).alias("__k"), F.col("__bin").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    bins = bins.withColumn("__before", F.coalesce(F.sum("__n").over(so_far), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(key, "__bin").orderBy(*(order or order_of_hits())))
    placed = binned.withColumn("__own", own).join(bins, F.col(key).eqNullSafe(F.col("__k")) & F.col("__bin").eqNullSafe(F.col("__b")))
    return placed.withColumn(out, F.col("__before") + F.col("__own")).drop("__bin", "__k", "__b", "__before", "__own")


def in_slices(rows: DataFrame, halo: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Numbered rows with their slice; the first `halo` rows of a slice stand at the end of the slice before too, as not `own`."""
    if halo > slice_rows:
        raise ValueError("a slice must hold its halo")
    number = F.floor((F.col("rank") - 1) / slice_rows)
    copies = F.when((number > 0) & ((F.col("rank") - 1) % slice_rows < halo), F.array(number, number - 1)).otherwise(F.array(number))
    return rows.withColumn("slice", F.explode(copies)).withColumn("own", F.col("slice") == number)


def values(column: pa.ChunkedArray) -> list:
    """A column as plain values."""
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if number and not column.null_count else column.to_pylist()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal for neighbours of equal value."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole groups of rows of equal keys from a partition that is sorted by them: tables of many groups, with the row at which each begins, and the number of rows."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        last = held[-1].slice(held[-1].num_rows - 1) if held else t.slice(0, 1)
        both = pa.concat_tables([last, t]).select(keys)
        at = np.flatnonzero(np.logical_or.reduce([np.diff(_codes(c)) != 0 for c in both.columns]))
        if not len(at):
            held.append(t)
            continue
        n = sum(x.num_rows for x in held)
        yield pa.concat_tables([*held, t.slice(0, at[-1])]), [0, *(at + n).tolist()]
        held = [t.slice(at[-1])]
    if held:
        yield pa.concat_tables(held), [0, sum(x.num_rows for x in held)]


def fold(rows: DataFrame, step: Callable[[Any, Any], tuple[Any, Any]], schema: str, first: Any = None, key: str = "query_name", plain: list[str] | None = None) -> DataFrame:
    """What step() returns for all slices, in order of each sequence.

    rows: with the key and slice. step(rows of a slice, state) gives (rows as schema says, state for the slice after it);
    states are what JSON holds, equal ones are one state. A slice without rows hands on its state.

    step gets and gives a table; with `plain` it gets lists of these columns, by `rank`, and gives a list for each column of
    schema, which costs little where sequences are many and short. One call of Python runs all slices of a partition.
    """
    begin = json.dumps(first)
    kind = rows.schema[key].dataType.simpleString()
    whole = f"__key {kind}, __slice long, __given string, __state string, __rows array<struct<{', '.join(f'{n}: {t}' for n, t in (x.strip().split(' ', 1) for x in schema.split(', ')))}>>"
    out_types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, [key, "slice"]):
            heads = t.take(pa.array(at[:-1]))
            given, states, ends, found = heads.column("__given").to_pylist(), [], [0], []
            lists = {c: values(t.column(c)) for c in plain or []}
            t = t.drop_columns(["__given"])
            gathered: dict[str, list] = {c: [] for c in out_types.names}
            for a, b, g in zip(at[:-1], at[1:], given, strict=True):
                if plain:
                    out, state = step({c: v[a:b] for c, v in lists.items()}, json.loads(g))
                    for c, v in gathered.items():
                        v += out[c]
                    n = len(out[out_types.names[0]])
                else:
                    out, state = step(t.slice(a, b - a), json.loads(g))
                    found.append(out.select(out_types.names).cast(out_types))
                    n = out.num_rows
                ends.append(ends[-1] + n)
                states.append(json.dumps(state))
            made = pa.table([pa.array(v, f.type) for v, f in zip(gathered.values(), out_types, strict=True)], out_types) if plain else pa.concat_tables(found)
            struct = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in made.columns], fields=list(out_types))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(heads.column(key).chunks), heads.column("slice").cast(pa.int64()).combine_chunks(), pa.array(given, pa.string()), pa.array(states, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["__key", "__slice", "__given", "__state", "__rows"])

    def ran(given: DataFrame) -> DataFrame:
        return given.repartition(key, "slice").sortWithinPartitions(key, "slice", *(["rank"] if plain else [])).mapInArrow(run, whole)

    rows = rows.checkpoint()
    done = ran(rows.withColumn("__given", F.lit(begin))).checkpoint()
    # what follows another slice may have to run again; a sequence of one slice never does
    long = done.where("__slice > 0").select(F.col("__key").alias("__l")).distinct()
    while True:
        before = F.coalesce(F.lag("__state").over(Window.partitionBy("__key").orderBy("__slice")), F.lit(begin))
        states = done.select("__key", "__slice", "__given", "__state").join(long, F.col("__key").eqNullSafe(F.col("__l")), "left_semi")
        wrong = states.select("__key", "__slice", "__given", before.alias("__before")).where("__before <> __given").select("__key", "__slice", F.col("__before").alias("__given")).checkpoint()
        if wrong.isEmpty():
            return done.select(F.inline("__rows"))
        same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("slice") == F.col("__slice"))
        again = ran(rows.join(wrong, same).drop("__key", "__slice"))
        kept = done.join(wrong.select(F.col("__key").alias("__k"), F.col("__slice").alias("__s")), F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__slice") == F.col("__s")), "left_anti")
        done = kept.unionByName(again).checkpoint()
