"""Poly-A tails attached to the elements that they end.

A simple repeat of A behind the 3' end of a forward SINE or LINE, or of T ahead of a turned one, is part of it: the element
takes its range and counts as complete to the end of its consensus. Looked at, one step out at a time, are the REACH hits
before and after the tail that are left by then; a match before it goes first. Where the element is linked onwards it is
joined only if the tail lies between two short-spaced pieces of one cut element, which then become one.

hits: query_name, query_start, query_end, score, orientation, subj_name, subj_start, subj_end, subj_remaining, hit_id (unique),
left_id, right_id (linked hits or null). Names carry no class. Null places or names match nothing; rows that repeat are
hits each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators import folds

# Hits looked at on each side; bases apart, consensus bases that may lack by family, bases beyond it; of cut pieces
REACH, APART, LACK_ALU, LACK_OTHER, BEYOND, CUT_APART, CUT_PIECE = 4, 4, 32, 25, 30, 5, 40
# Fixed patterns of names
ALU, FORWARD, TURNED = re.compile(r"Alu|FLAM"), re.compile(r"FR?AM$|L1|SVA$"), re.compile(r"FR?AM$|L1")
TAIL_A, TAIL_T = re.compile(r"\(A\)n$|\(.A{3,6}\)|A-rich"), re.compile(r"\(T\)n$|\(T{3,6}.\)|T-rich")

#: No more than REACH - 1 rows ahead of a hit that is left can be gone already.
HALO = 2 * REACH
FIELDS = ["hit_id", "query_start", "query_end", "score", "orientation", "subj_name", "subj_start", "subj_end", "subj_remaining", "left_id", "right_id"]
PLACES = ["query_start", "query_end", "subj_start", "subj_end", "subj_remaining"]
SCHEMA = "tail_id long, hit_id long, piece_id long, query_start long, query_end long, rank long"


def _ends(e: dict, tail: dict, others: re.Pattern) -> bool:
    """Whether an element is at its end and the tail not much longer than what lacks."""
    lack = LACK_ALU if ALU.match(e["subj_name"]) else LACK_OTHER if others.match(e["subj_name"]) else -1
    return e["subj_remaining"] <= lack and tail["query_end"] - tail["query_start"] < e["subj_remaining"] + BEYOND


def _piece(e: dict, other: dict | None, link: str, apart: int | None) -> bool:
    """Whether the hit on the other side of the tail is the linked, short rest of the element."""
    return other is not None and e[link] == other["hit_id"] and other["score"] == e["score"] and apart < CUT_APART and other["subj_end"] - other["subj_start"] < CUT_PIECE


def attach(tail: dict, before: list[dict], behind: list[dict]) -> tuple[dict, dict | None, int, int] | None:
    """The element that a tail ends, the other piece of it if it was cut, and its range; or None."""
    if tail["subj_name"] is None:
        return None
    a, t = TAIL_A.match(tail["subj_name"]), TAIL_T.match(tail["subj_name"])
    if not (a or t):
        return None
    for k in range(REACH):
        prev, nxt = (side[k] if k < len(side) else None for side in (before, behind))
        if a and prev is not None and prev["orientation"] != "C" and tail["query_start"] - prev["query_end"] < APART and _ends(prev, tail, FORWARD):
            if prev["right_id"] is None:
                return prev, None, prev["query_start"], max(prev["query_end"], tail["query_end"])
            cut = _piece(prev, nxt, "right_id", nxt and nxt["query_start"] - tail["query_end"])
            return (prev, nxt, prev["query_start"], nxt["query_end"]) if cut else None
        if t and nxt is not None and nxt["orientation"] == "C" and nxt["query_start"] - tail["query_end"] < APART and _ends(nxt, tail, TURNED):
            if nxt["left_id"] is None:
                return nxt, None, tail["query_start"], nxt["query_end"]
            if _piece(nxt, prev, "left_id", prev and prev["query_end"] - tail["query_start"]):
                return nxt, prev, prev["query_start"], nxt["query_end"]
    return None


def _step(t: pa.Table, state: Any) -> tuple[pa.Table, Any]:
    t = t.sort_by("rank")
    rows, own, ranks = t.select(FIELDS).to_pylist(), t.column("own").to_pylist(), t.column("rank").to_pylist()
    last, gone = state or [[], []]
    gone, out = set(gone), []
    for k, row in enumerate(rows):
        if not own[k] or row["hit_id"] in gone:
            continue
        behind = [x for x in rows[k + 1 : k + 1 + HALO] if x["hit_id"] not in gone][:REACH]
        found = attach(row, last[::-1], behind)
        if found is not None:
            e, piece, start, end = found
            away = {e["hit_id"]} | ({piece["hit_id"]} if piece else set())
            last = [x for x in last if x["hit_id"] not in away]
            gone |= away
            out.append((row["hit_id"], e["hit_id"], piece and piece["hit_id"], start, end, ranks[k]))
            # the element stands where its tail stood, linked as its outer pieces were
            links = {} if piece is None else {"right_id": piece["right_id"]} if e["orientation"] != "C" else {"left_id": piece["left_id"]}
            row = e | {"query_start": start, "query_end": end, "subj_end": e["subj_end"] + e["subj_remaining"], "subj_remaining": 0} | links
        last = [*last, row][-REACH:]
    ahead = {x["hit_id"] for x, o in zip(rows, own, strict=True) if not o}
    columns = list(zip(*out, strict=True)) or [()] * 6
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}), [last, sorted(gone & ahead)]


def attachments(hits: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """(tail_id, hit_id, piece_id, query_start, query_end, rank): tails with the element that each ends, the other piece, if it was cut, and the range they have together; rank: the tail's place on its sequence."""
    known = F.col("subj_name").isNotNull()
    for c in PLACES:
        known &= F.col(c).isNotNull()
    rows = hits.where(known).select("query_name", F.col("score").cast("double").alias("score"), "orientation", "subj_name", *[F.col(c).cast("long").alias(c) for c in [*PLACES, "hit_id", "left_id", "right_id"]])
    placed = folds.in_slices(folds.numbered_rows(rows), HALO, slice_rows)
    return folds.fold(placed, _step, SCHEMA)


def with_tails(hits: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """hits with tails and cut pieces in their elements, and n_tails: whose ranges are widened, whose consensus is complete.

    Of an element with several tails the range that the last one leaves counts; links are those of the table given.
    """
    found = attachments(hits, slice_rows).checkpoint()
    grown = found.groupBy(F.col("hit_id").alias("__e")).agg(F.max_by("query_start", "rank").alias("__s"), F.max_by("query_end", "rank").alias("__t"), F.count(F.lit(1)).alias("n_tails"))
    away = found.select(F.explode(F.array_compact(F.array("tail_id", "piece_id"))).alias("__gone"))
    left = hits.join(away, F.col("hit_id") == F.col("__gone"), "left_anti").join(grown, F.col("hit_id") == F.col("__e"), "left")
    ended = F.col("__e").isNotNull()
    return left.withColumns({
        "query_start": F.when(ended, F.col("__s")).otherwise(F.col("query_start")), "query_end": F.when(ended, F.col("__t")).otherwise(F.col("query_end")),
        "subj_end": F.when(ended, F.col("subj_end") + F.col("subj_remaining")).otherwise(F.col("subj_end")), "subj_remaining": F.when(ended, 0).otherwise(F.col("subj_remaining")),
        "n_tails": F.coalesce("n_tails", F.lit(0)),
    }).drop("__e", "__s", "__t")
