"""Order-dependent filters: hits are kept or dropped one after another, best first.

Hits of different overlap islands never meet, so a group is one island of one sequence, not the whole sequence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from math import inf, nan

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.folds import runs, values
from strandloom.operators.interval import islands


#: Islands of a sequence that lie in one partition at least.
ISLANDS = 512


def per_island(hits: DataFrame, fold: Callable[[dict[str, list]], tuple], needs: list[str], changes: tuple[str, ...] = (), gap: int = 0) -> DataFrame:
    """fold over each island of several hits. An island of one hit stays.

    fold gets lists of the columns that it needs, and gives the places of those that stay, then for each column of `changes`
    their values. Islands are many and small, so a partition's run in one call, without a frame for each.
    """
    names = hits.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["query_name", "island"]):
            lists = {c: values(t.column(c)) for c in needs}
            kept: list[int] = []
            new: dict[str, list] = {c: [] for c in changes}
            for a, b in zip(at, at[1:]):
                if b - a == 1:
                    kept.append(a)
                    for c, v in new.items():
                        v.append(lists[c][a])
                    continue
                stay, *given = fold({c: v[a:b] for c, v in lists.items()})
                kept += [a + k for k in stay]
                for v, more in zip(new.values(), given, strict=True):
                    v += more
            out = t.select(names).take(pa.array(kept, pa.int64()))
            for c, v in new.items():
                out = out.set_column(names.index(c), out.schema.field(c), pa.array(v, out.schema.field(c).type))
            yield from out.to_batches()

    dealt = islands(hits, gap).withColumn("__g", F.floor(F.col("island") / ISLANDS))
    return dealt.repartition("query_name", "__g").sortWithinPartitions("query_name", "island").mapInArrow(run, hits.schema)


class Kept:
    """Ranges that stay, by bins of the query, so that a hit meets those near it and no others."""

    WIDTH = 1024

    def __init__(self, start: list[int], end: list[int]):
        self.start, self.end = start, end
        self.bins: defaultdict[int, list[int]] = defaultdict(list)

    def of(self, i: int) -> range:
        return range(self.start[i] // self.WIDTH, self.end[i] // self.WIDTH + 1)

    def add(self, i: int) -> None:
        for b in self.of(i):
            self.bins[b].append(i)

    def overlapping(self, i: int) -> Iterator[int]:
        """Those that share a base with range i; one that lies in several bins may come more than once."""
        return (k for b in self.of(i) for k in self.bins.get(b, ()) if self.start[k] <= self.end[i] and self.end[k] >= self.start[i])


def half_even_percent(part: int, whole: int) -> int:
    """100 * part / whole to the nearest whole number, halves to the even one."""
    n, rest = divmod(100 * part, whole)
    return n + (2 * rest > whole or (2 * rest == whole and n % 2 == 1))


def best_first(numbers: list) -> list:
    """Numbers turned round, so that the largest is the least; a missing one comes last."""
    return [inf if x is None or x != x else -x for x in numbers]


#: Columns that ranked() needs.
RANKED = ["hit_id", "query_start", "query_end", "score"]


def ranked(t: dict[str, list]) -> tuple[list[int], list[int], list[int]]:
    """(rows by score descending, then the shorter one, then start and id; starts; ends)."""
    start, end = t["query_start"], t["query_end"]
    key = list(zip(best_first(t["score"]), [e - s for s, e in zip(start, end, strict=True)], start, t["hit_id"], strict=True))
    return sorted(range(len(key)), key=key.__getitem__), start, end


def mask_level(hits: DataFrame, value: int) -> DataFrame:
    """Keep a hit if, for each kept one that ranks before it and overlaps it, more than 100 - value percent of it lie outside.

    Ranks: score descending, then the shorter one, then start and id. From 101 on all hits stay.
    """
    if value >= 101:
        return hits

    def fold(t: dict[str, list]) -> tuple[list[int]]:
        order, start, end = ranked(t)
        kept, near = [], Kept(start, end)
        for i in order:
            length = end[i] - start[i] + 1
            if all(half_even_percent(length - (min(end[i], end[k]) - max(start[i], start[k]) + 1), length) > 100 - value for k in near.overlapping(i)):
                kept.append(i)
                near.add(i)
        return (kept,)

    return per_island(hits, fold, RANKED)


def tail_level(hits: DataFrame, value: int) -> DataFrame:
    """As mask_level(), but a hit counts by both its tails beyond a kept one together, and an exact tie with the limit stays."""
    if value >= 101:
        return hits

    def fold(t: dict[str, list]) -> tuple[list[int]]:
        order, start, end = ranked(t)
        kept, near = [], Kept(start, end)
        for i in order:
            length = end[i] - start[i] + 1
            if all(100 * (max(0, start[k] - start[i]) + max(0, end[i] - end[k])) >= (100 - value) * length for k in near.overlapping(i)):
                kept.append(i)
                near.add(i)
        return (kept,)

    return per_island(hits, fold, RANKED)


def arrival_level(hits: DataFrame, value: int) -> DataFrame:
    """Hits in order of start and id: of two that overlap by `value` percent of either, the one of lower score goes."""

    def fold(t: dict[str, list]) -> tuple[list[int]]:
        start, end, score = t["query_start"], t["query_end"], [nan if x is None else x for x in t["score"]]
        key = list(zip(start, t["hit_id"], strict=True))
        kept: list[int] = []
        live: list[int] = []  # of the kept ones those that reach as far as this one begins
        gone = set()
        for i in sorted(range(len(key)), key=key.__getitem__):
            live = [k for k in live if end[k] >= start[i]]
            drop = False
            for k in list(live):
                shared = min(end[i], end[k]) - start[i] + 1
                shorter = min(end[i] - start[i], end[k] - start[k]) + 1
                if shared > 0 and 100 * shared >= value * shorter:
                    if score[k] >= score[i]:
                        drop = True
                        break
                    live.remove(k)
                    gone.add(k)
            if not drop:
                live.append(i)
                kept.append(i)
        return ([k for k in kept if k not in gone],)

    return per_island(hits, fold, RANKED)


#: What decides which of two overlapping hits wins, as numbers that are small for winners; without a divergence a hit comes last.
MODES = {
    "score": lambda t: best_first(t["score"]),
    "length": lambda t: [s - e for s, e in zip(t["query_start"], t["query_end"], strict=True)],
    "divergence": lambda t: [1010 if kind in NO_DIVERGENCE or d is None else d for d, kind in zip(t["div_permille"], t["subj_type"], strict=True)],
}
#: Columns that a mode needs beside ranges and ids.
MODE_NEEDS = {"score": ["score"], "length": [], "divergence": ["div_permille", "subj_type"]}
#: Classes whose divergence isn't measured.
NO_DIVERGENCE = ("Simple_repeat", "Low_complexity")


def resolve_overlaps(hits: DataFrame, mode: str = "score") -> DataFrame:
    """Disjoint hits: of two that overlap the winner keeps its range; the other is dropped if either holds the other, else trimmed."""
    rank = MODES[mode]

    def fold(t: dict[str, list]) -> tuple[list[int], list[int], list[int]]:
        start, end = t["query_start"], t["query_end"]
        key = list(zip(rank(t), start, t["hit_id"], strict=True))
        starts: list[int] = []  # of the kept ranges, which are disjoint, in order of place
        ends: list[int] = []
        kept, new = [], ([], [])
        for i in sorted(range(len(key)), key=key.__getitem__):
            s, e = start[i], end[i]
            a, b = bisect_left(ends, s), bisect_right(starts, e)  # kept ranges a to b - 1 overlap this one
            if any(s <= starts[k] and ends[k] <= e or starts[k] <= s and e <= ends[k] for k in range(a, min(b, a + 3))):
                continue  # of more than two, one lies inside
            for k in range(a, b):
                s, e = (ends[k] + 1, e) if starts[k] < s else (s, starts[k] - 1)
            if s > e:
                continue
            at = bisect_left(starts, s)
            starts.insert(at, s)
            ends.insert(at, e)
            kept.append(i)
            new[0].append(s)
            new[1].append(e)
        return kept, *new

    return per_island(hits, fold, ["hit_id", "query_start", "query_end", *MODE_NEEDS[mode]], ("query_start", "query_end"))


def excise(hits: DataFrame) -> DataFrame:
    """Hits of disjoint ranges with the places they have once each is cut down to one letter: (…, cut_start, removed_before)."""
    order = Window.partitionBy("query_name").orderBy("query_start", "hit_id").rowsBetween(Window.unboundedPreceding, -1)
    removed = F.coalesce(F.sum(F.col("query_end") - F.col("query_start")).over(order), F.lit(0))
    return hits.withColumn("removed_before", removed.cast("long")).withColumn("cut_start", F.col("query_start") - F.col("removed_before"))


def merge_chains(hits: DataFrame, least_overlap: int = 33) -> DataFrame:
    """Neighbours of one family and strand that overlap by more than `least_overlap`, or touch, become one hit.

    The merged hit has the outer range, the best score, and the divergence weighted by length, an overlap counting for
    the less diverged part. A null name is a name.
    """

    def fold(t: dict[str, list]) -> tuple[list[int], list, list, list]:
        start, end, score, div = t["query_start"], t["query_end"], t["score"], t["div_permille"]
        order = list(zip(start, t["hit_id"], strict=True))
        families: defaultdict[tuple, list[int]] = defaultdict(list)
        for i in sorted(range(len(order)), key=order.__getitem__):
            families[t["subj_name"][i], t["orientation"][i]].append(i)
        kept: list[int] = []
        for members in families.values():
            held = None  # the first of those that are one by now; it has their values
            for i in members:
                shared = end[held] - start[i] + 1 if held is not None else -1
                if held is not None and (shared > least_overlap or shared == 0 or end[i] <= end[held]):
                    a, b = (div[held], end[held] - start[held] + 1), (div[i], end[i] - start[i] + 1)
                    less, more = (a, b) if a[0] <= b[0] else (b, a)
                    rest = max(0, more[1] - max(0, min(shared, more[1])))
                    div[held] = (less[0] * less[1] + more[0] * rest) // max(1, less[1] + rest)
                    end[held], score[held] = max(end[held], end[i]), max(score[held], score[i])
                else:
                    held = i
                    kept.append(i)
        return kept, *([v[i] for i in kept] for v in (end, score, div))

    return per_island(hits, fold, [*RANKED, "div_permille", "subj_name", "orientation"], ("query_end", "score", "div_permille"), gap=1)
