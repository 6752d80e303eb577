"""Joining pieces of LINEs, SINEs, LTRs and other elements to chains.

Going along a sequence, each hit may be linked to one of the next AHEAD hits of its class. It looks ahead until

- a hit is met that is already the right end of a link from before it (links may nest, not cross);
- the bases of gaps of 100 and more on the way, times the number of these gaps, exceed 10,000;
- something much more diverged than itself lies between (not for SINEs, short pieces, or ahead of an internal part).

Hits that something much more diverged than they are lies before don't count, unless short or internal. Of the others the
one of best pair score is linked, the nearest of equals; but not one for which a hit in between fits it as well or better.
Simple repeats, low complexity and DNA transposons link nothing here, and the first two count for no divergence.

What lies between two hits comes from sums and counts along a slice of the sequence, all pairs' scores and rivals from
windows inside it; only the choice of partners, which depends on earlier choices, is a fold over slices.

hits: as for pair scores, with `div` (percent), `masked` and `query_remaining`. Null scores count as no fit; rows that
repeat are hits each; an empty table gives no links; hits without links are chains of their own.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import scalar as S
from strandloom.operators import folds, pair_scores as P
from strandloom.operators.chain import components

# Elements ahead, bases of a gap, bases times gaps, bases of a piece that is not short
AHEAD, LEAST_GAP, MOST_GAPS, SHORT = 21, 100, 10_000, 50
SIDES = P.SIDES | {"query_remaining": "query_remaining", "rank": "rank", "gap_bp": "gap_bp", "gap_n": "gap_n"} | {c: c for c in ("internal", "stem", "plain", "alu_stem", "generic_stem", "ltr_stem", "ltr_first", "ltr_second")}


def plain(kind: Column) -> Column:
    """Whether a class is neither simple repeats nor low complexity."""
    return ~kind.rlike("(?i)^simple|low")


def fits(distance: Column, class_distance: str, between: bool) -> Column:
    """The pair score by class. `between`: as for hits in between, where LINEs go by all elements and Alus as SINEs."""
    line = P.line_score(distance if between else F.col(class_distance), F.col("kin"))
    ltr = P.ltr_score(F.col("ltr_names"), (F.col("l_internal"), F.col("r_internal")))
    # SINEs differ from others in the stem of Alus
    other = P.generic_score(right_stem=F.col("r_alu_stem" if between else "r_generic_stem"))
    return F.when(F.col("l_type").contains("LINE"), line).when(F.col("l_type").contains("LTR"), ltr).otherwise(other)


def with_keys(hits: DataFrame) -> DataFrame:
    """hits with what goes by their family's name alone."""
    name, sine = F.col("subj_name"), F.col("subj_type").contains("SINE")
    first, second = P.ltr_sides(name)
    return hits.withColumns({
        "internal": S.is_internal(name), "stem": P.line_stem(name), "plain": P.line_plain(name), "alu_stem": P.stem(name, sine),
        "generic_stem": P.stem(name, sine & ~F.col("subj_type").contains("Alu")), "ltr_stem": P.ltr_stem(name), "ltr_first": first, "ltr_second": second,
    })


def candidates(hits: DataFrame, allowed: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """(query_name, slice, i, j, score, hit_id, partner_id): links that may be made, by the hits' ranks on the sequence."""
    placed = folds.in_slices(folds.numbered_rows(with_keys(hits)), AHEAD, slice_rows)
    along = Window.partitionBy("query_name", "slice").orderBy("rank")
    gap = -S.query_overlap(F.lag("query_start").over(along), F.lag("query_end").over(along), F.col("query_start"), F.col("query_end"))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("__gap", F.when(gap >= LEAST_GAP, gap))
    placed = placed.withColumns({
        "gap_bp": F.coalesce(F.sum("__gap").over(so_far), F.lit(0)), "gap_n": F.count("__gap").over(so_far),
    })
    # what goes by the hits between is told inside a row, so that only narrow rows of pairs are sorted
    upto = lambda i: F.array_max(F.transform(F.slice("ahead", 1, i), lambda y: F.when(y["r_plain_class"], y["r_div"])))
    ahead = F.collect_list(F.struct(*[F.col(c).alias(f"r_{k}") for k, c in SIDES.items()], plain(F.col("subj_type")).alias("r_plain_class"))).over(along.rowsBetween(1, AHEAD))
    left = placed.withColumn("ahead", ahead).where(~F.col("subj_type").rlike("(?i)^simple|low|dna"))
    left = left.withColumn("ahead", F.transform("ahead", lambda x, i: x.withField("most_div", F.coalesce(upto(i), F.lit(0.0)))))
    beyond = lambda x: ~((x["r_gap_bp"] - F.col("gap_bp")) * (x["r_gap_n"] - F.col("gap_n")) <= MOST_GAPS)
    bars = lambda x: ~x["r_internal"] & ~F.col("subj_type").contains("SINE") & (F.col("subj_end") - F.col("subj_start") > SHORT) & S.too_diverged(x["most_div"], F.col("div"))
    left = left.withColumn("stop", F.array_min(F.transform(F.filter("ahead", lambda x: beyond(x) | bars(x)), lambda x: x["r_rank"])))
    # the place among those of the class tells how many of the class lie from one to the other
    in_class = F.posexplode(F.filter("ahead", lambda x: x["r_type"] == F.col("subj_type"))).alias("__at", "__r")
    pairs = left.select("query_name", "slice", "own", "stop", *[F.col(c).alias(f"l_{k}") for k, c in SIDES.items()], in_class)
    pairs = pairs.select("*", "__r.*").withColumn("class_distance", F.col("__at") + 1).drop("__r", "__at")
    of = lambda kind, what: F.when(F.col("l_type").contains(kind), what)
    distance = F.col("r_rank") - F.col("l_rank")
    pairs = pairs.withColumns({
        "ltr_names": of("LTR", P.ltr_names_fit(*((F.col(f"{x}_ltr_first"), F.col(f"{x}_ltr_second")) for x in "lr"), F.col("r_ltr_stem"))), "kin": of("LINE", F.col("l_plain").startswith(F.col("r_stem"))),
        "distance": distance, "ltr_distance": distance,
    })
    pairs = P.line_names_fit(pairs, allowed)
    # each score through a generator: one projection of both would be too much code for one method, and filters would work them out again
    pairs = pairs.withColumn("as_rival", F.explode(F.array(fits(F.col("distance"), "ltr_distance", True)))).withColumn("ltr_distance", F.col("class_distance"))
    diverged = (F.col("r_subj_end") - F.col("r_subj_start") > SHORT) & S.too_diverged(F.col("most_div"), F.col("r_div"))
    able = F.col("own") & (F.col("stop").isNull() | (F.col("r_rank") < F.col("stop"))) & ~(~F.col("r_internal") & diverged)
    pairs = pairs.withColumn("score", F.explode(F.array(F.when(able, fits(F.col("distance"), "class_distance", False)))))
    later = Window.partitionBy("query_name", "slice", "r_rank").orderBy(F.desc("l_rank")).rowsBetween(Window.unboundedPreceding, -1)
    found = pairs.select("query_name", "slice", "l_rank", "r_rank", "l_id", "r_id", "as_rival", "score").withColumn("best_rival", F.max("as_rival").over(later))
    found = found.where((F.col("score") > 0) & (F.col("best_rival").isNull() | (F.col("best_rival") < F.col("score"))))
    return found.select("query_name", "slice", F.col("l_rank").alias("i"), F.col("r_rank").alias("j"), "score", F.col("l_id").alias("hit_id"), F.col("r_id").alias("partner_id"))


def links(found: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """(query_name, hit_id, partner_id, pair_score): of candidates those that are made, from left to right."""

    def step(t: dict[str, list], taken: list[int]) -> tuple[dict[str, list], list[int]]:
        by_left = defaultdict(list)
        for k, (i, j, score) in enumerate(zip(t["i"], t["j"], t["score"], strict=True)):
            by_left[i].append((j, score, k))
        held, made = set(taken), []
        for i in sorted(by_left):
            held = {x for x in held if x > i}
            stop = min(held, default=None)
            able = [(-score, j, k) for j, score, k in by_left[i] if stop is None or j < stop]
            if able:
                _, j, k = min(able)
                held.add(j)
                made.append(k)
        end = (t["slice"][0] + 1) * slice_rows
        return {to: [t[c][k] for k in made] for to, c in zip(names, ("query_name", "hit_id", "partner_id", "score"), strict=True)}, sorted(x for x in held if x > end)

    names = ["query_name", "hit_id", "partner_id", "pair_score"]
    kinds = {c: found.schema[c].dataType.simpleString() for c in names[:3]}
    columns = [c for c in found.columns if c != "rank"]
    return folds.fold(found.withColumn("rank", F.col("i")), step, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pair_score double", [], plain=columns)


def joined_links(hits: DataFrame, allowed: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    return links(candidates(hits, allowed, slice_rows), slice_rows)


def joined_chains(hits: DataFrame, allowed: DataFrame, slice_rows: int = folds.SLICE_ROWS) -> DataFrame:
    """hits with chain: the least hit_id of the chain."""
    found = components(joined_links(hits, allowed, slice_rows)).withColumnsRenamed({"id": "__id", "component": "__c"})
    return hits.join(found, F.col("hit_id") == F.col("__id"), "left").withColumn("chain", F.coalesce("__c", "hit_id")).drop("__id", "__c")


def with_heads(hits: DataFrame, made: DataFrame) -> DataFrame:
    """hits with is_head: whether nothing is linked to it from its left, so that it stands for its element in counts."""
    rights = made.select(F.col("partner_id").alias("__p"), F.lit(True).alias("__linked"))
    return hits.join(rights, F.col("hit_id") == F.col("__p"), "left").withColumn("is_head", F.col("__linked").isNull()).drop("__p", "__linked")


# Bases of the query that pieces share, or lie apart, to be one; bases of the consensus; percent that a merge may lose
LEAST_SHARED, MOST_APART, MOST_CONSENSUS, MOST_SHARED, MOST_LOST = 33, 10, 100, 20, 50
PIECE = ["query_start", "query_end", "hit_id", "subj_start", "subj_end", "subj_remaining", "subj_name", "orientation", "stage", "score", "div", "del", "ins"]


def shares(a: dict, b: dict) -> tuple[int, int]:
    """Bases of the query and of the consensus that a piece and the next one share; negative: bases between."""
    query = min(a["query_end"], b["query_end"]) - max(a["query_start"], b["query_start"]) + 1
    return query, (b["subj_end"] - a["subj_start"] if a["orientation"] == "C" else a["subj_end"] - b["subj_start"]) + 1


def joint_levels(a: dict, b: dict) -> dict[str, float]:
    """Divergence, deletions and insertions (percent, two decimals) of two pieces as one.

    What they share of the query counts for the less diverged; if that is little, consensus bases that both have are an
    insertion, and those that neither has a deletion.
    """
    query, consensus = shares(a, b)
    less, more = (a, b) if a["div"] <= b["div"] else (b, a)
    size = lambda x: x["query_end"] - x["query_start"] + 1
    sums = {c: size(less) * less[c] + (size(more) - query) * more[c] for c in ("div", "del", "ins")}
    if query <= MOST_APART:
        step = (consensus - query) * 100
        sums["ins" if step > 0 else "del"] += abs(step)
    whole = max(1, size(a) + size(b) - query)
    return {c: float(f"{v / whole:.2f}") for c, v in sums.items()}


def one_piece(a: dict, b: dict) -> dict:
    """Two pieces as one: the outer range, the better one's score and name; the consensus of both, unless that is over twice the query."""
    out = a | joint_levels(a, b) | {"query_start": min(a["query_start"], b["query_start"]), "query_end": max(a["query_end"], b["query_end"])}
    low, high = min(a["subj_start"], b["subj_start"]), max(a["subj_end"], b["subj_end"])
    better = b if a["score"] < b["score"] else a
    if high - low + 1 > 2 * (out["query_end"] - out["query_start"] + 1):
        out |= {c: better[c] for c in ("subj_start", "subj_end", "subj_remaining")}
    else:
        out |= {"subj_start": low, "subj_end": high, "subj_remaining": (b if a["subj_end"] < b["subj_end"] else a)["subj_remaining"]}
    return out | {"score": better["score"], "subj_name": better["subj_name"], "n_pieces": a["n_pieces"] + b["n_pieces"]}


def merges(a: dict, b: dict) -> bool:
    query, consensus = shares(a, b)
    if -query > MOST_APART:
        return False
    if a["query_end"] - b["query_start"] + 1 > LEAST_SHARED:
        return True
    near = a["stage"] == b["stage"] and consensus >= -MOST_CONSENSUS and (consensus <= MOST_SHARED or (query > 0 and consensus - query <= MOST_SHARED))
    return near and joint_levels(a, b)["del"] <= MOST_LOST


def merged_pieces(hits: DataFrame, made: DataFrame) -> DataFrame:
    """Hits after linked neighbours that overlap or nearly touch have become one: the columns of PIECE, and n_pieces.

    Goes along each chain; a merged hit meets the next piece as it is then, and keeps the first one's hit_id. hits: with
    `del` and `ins` in percent. Chains are elements, of few pieces; hits outside chains stay as they are.
    """
    found = components(made).withColumnsRenamed({"id": "__id", "component": "__c"})
    linked = hits.join(found, F.col("hit_id") == F.col("__id"), "left")
    order = F.struct(F.col("query_start").alias("__a"), (-F.col("query_end")).alias("__b"), (-F.col("score")).alias("__s"), F.col("hit_id").alias("__i"), *PIECE)
    chains = linked.where("__c is not null").groupBy("__c").agg(F.sort_array(F.collect_list(order)).alias("pieces"))
    fields = {c: hits.schema[c].dataType.simpleString() for c in PIECE} | {"div": "double", "del": "double", "ins": "double", "n_pieces": "int"}

    def run(batches):
        for batch in batches:
            out = []
            for pieces in batch.column(0).to_pylist():
                held = None
                for p in pieces:
                    p = {c: p[c] for c in PIECE} | {"n_pieces": 1}
                    if held and merges(held, p):
                        held = one_piece(held, p)
                        continue
                    out += [held] if held else []
                    held = p
                out.append(held)
            kinds = batch.schema.field(0).type.value_type
            of = lambda c: pa.int32() if c == "n_pieces" else kinds.field(c).type  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], of(c)) for c in fields], list(fields))

    single = linked.where("__c is null").select(*PIECE, F.lit(1).cast("int").alias("n_pieces"))
    return chains.select("pieces").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in fields.items())).unionByName(single)
