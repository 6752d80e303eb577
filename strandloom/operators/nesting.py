"""Elements inside elements: hits split where others were inserted, and links that cross undone.

Both are sweeps along a sequence with a stack of what is still open, as folds over slices.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators import folds

#: Fixed value: bases from an edge, or between inserts, that count as none.
NEAR = 5
VALUES = ["hit_id", "query_start", "query_end", "subj_start", "subj_end", "subj_remaining"]


def opened(row: dict) -> dict:
    """A hit whose inserts are being gathered."""
    return {c: row[c] for c in [*VALUES, "subj_name", "stage", "orientation"]} | {"first": row["subj_start"], "last": row["subj_end"], "seen": 0, "before": None, "inserts": []}


def meets(hit: dict, row: dict) -> bool:
    """Takes in the next row of the sequence; False if it ends beyond the hit, which then gets no more inserts."""
    if row["query_end"] > hit["query_end"]:
        return False
    hit["seen"] += 1
    plus, start, end = hit["orientation"] != "C", row["query_start"], row["query_end"]
    if (hit["subj_name"] in row["subj_name"] and hit["stage"] == row["stage"]) or start < hit["query_start"]:
        return True
    if hit["seen"] == 1 and start <= hit["query_start"] + NEAR:
        side, by = ("subj_start", start - hit["query_start"]) if plus else ("subj_end", hit["query_start"] - start)
        hit[side] += by
        hit["query_start"] = end + 1
        return True
    inserts = hit["inserts"]
    if end >= hit["query_end"] - NEAR:
        while inserts and start - 1 < inserts[-1][1]:
            inserts.pop()
        side, by = ("subj_end", end - hit["query_end"]) if plus else ("subj_start", hit["query_end"] - end)
        hit[side] += by
        hit["query_end"] = start - 1
    elif hit["before"] is not None and end < hit["before"]:
        return True
    elif hit["before"] is not None and start < hit["before"] + NEAR and inserts:
        inserts[-1][1] = end
    else:
        inserts.append([start, end])
    hit["before"] = end
    return True


def pieces(hit: dict) -> list[dict]:
    """The hit, or what its inserts leave of it; consensus ranges by each piece's share of the query."""
    inserts = hit["inserts"]
    if not inserts:
        return [{c: hit[c] for c in VALUES} | {"piece": 1}]
    own = hit["query_end"] - hit["query_start"] + 1 - sum(b - min(a, hit["query_end"]) for a, b in inserts)
    rate = (hit["subj_end"] - hit["subj_start"] + 1) / own if own else 0.0
    edges = [hit["query_start"], *(x for a, b in inserts for x in (a - 1, b + 1)), hit["query_end"]]
    whole, out, plus = hit["subj_end"] + hit["subj_remaining"], [], hit["orientation"] != "C"
    low, high = hit["first"], hit["last"]
    for k, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
        piece = {c: hit[c] for c in VALUES} | {"query_start": a, "query_end": b, "piece": k + 1}
        size, inner = int((b - a) * rate), k < len(inserts)
        if plus:
            piece["subj_start"] = low
            if inner:
                high = low + size
                piece |= {"subj_end": high, "subj_remaining": whole - high}
            low = high + 1
        else:
            piece["subj_end"] = high
            if inner:
                piece["subj_remaining"] = whole - high
                low = high - size
                piece["subj_start"] = low
            high = low - 1
        out.append(piece)
    return out


def split_at_inserts(hits: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """The pieces (hit_id, piece, ranges) that inserts leave of each hit.

    Inserts of a hit are those that follow it within its range, up to the first that ends beyond: not hits of its name (or
    one that holds its name) and stage. The first one trims the start if it begins within NEAR bases of it, one that ends
    within NEAR bases of the end trims that; inserts inside the last one don't count, and near ones are one. Only what lies
    on a sequence behind one another is looked at, so a nest of any depth is told in one sweep; open hits are as many as
    the nest is deep. Where inserts leave no base of the query, pieces get no share of the consensus. A hit without inserts is one piece; nulls in ranges are not allowed; rows that repeat hold one another.
    """
    counts = hits.groupBy(F.col("query_name").alias("__q")).agg(F.count(F.lit(1)).alias("rows"))
    placed = folds.in_slices(folds.numbered_rows(hits), 0, slice_rows).join(counts, F.col("query_name").eqNullSafe(F.col("__q")))
    needed = [*VALUES, "subj_name", "stage", "orientation"]

    def step(t: pa.Table, still: list[dict]) -> tuple[pa.Table, list[dict]]:
        t, out = t.sort_by("rank"), []
        for row in t.select(needed).to_pylist():
            kept = []
            for hit in still:
                if meets(hit, row):
                    kept.append(hit)
                else:
                    out += pieces(hit)
            still = [*kept, opened(row)]
        if t.column("rank")[-1].as_py() == t.column("rows")[0].as_py():
            out += [p for hit in still for p in pieces(hit)]
            still = []
        return pa.table({c: pa.array([r[c] for r in out], pa.int32() if c == "piece" else t.schema.field(c).type) for c in [*VALUES, "piece"]}), still

    kinds = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in VALUES)
    return folds.fold(placed.select("query_name", "slice", "rank", "rows", *needed), step, f"{kinds}, piece int", [])


def untangled(links: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """links (query_name, i, j, ...: from one rank of a sequence to a later one) but those that cross one that begins before.

    A hit is the left end of one link at most, and the right end of one. Links that stay nest or lie apart.
    """
    sliced = links.withColumn("slice", F.floor((F.col("i") - 1) / slice_rows))
    names = links.columns

    def step(t: pa.Table, ends: list[int]) -> tuple[pa.Table, list[int]]:
        t = t.sort_by("i")
        kept = []
        for k, (i, j) in enumerate(zip(t.column("i").to_pylist(), t.column("j").to_pylist(), strict=True)):
            while ends and ends[-1] <= i:  # ends of open links fall from the bottom up
                ends.pop()
            if not ends or ends[-1] >= j:
                ends.append(j)
                kept.append(k)
        return t.take(pa.array(kept, pa.int64())).select(names), [x for x in ends if x > (t.column("slice")[0].as_py() + 1) * slice_rows]

    return folds.fold(sliced, step, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields), [])
