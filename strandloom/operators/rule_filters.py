"""Rules by which hits of each search class go, are cut at their start, or take over the hit before them.

hits: sorted as order_of_hits(); subj_name, subj_type, orientation, query and subject ranges with what remains, score, and
div, del and ins in percent; `kind` tells the search class. A rule's number is that of RULES. What a row alone, or with
the next row, decides is an expression; what depends on whether the row before was kept is a fold over slices.

The row before counts only if it is of the same sequence and kind and was not the last to go. Hits of the classes that cut
out (simple, alu, cut1, cut2, alumask) also go where the last hit that stayed reaches as far as they do.

The state of the walk (cut2 keeps a body in mind) begins anew with each sequence. Families are compared by their name, classes by their type. Nulls in what a rule needs make it not apply; rows that repeat
are hits each; an empty table stays empty; kinds other than those of KINDS go by the rules for all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import scalar as S
from strandloom.operators import folds

KINDS = ["cut2", "mirs", "sines", "longlib", "l1", "simple", "alu", "cut1", "alumask", "other"]
RULES = {
    1: "a buffer sequence", 2: "too diverged", 3: "a 3' end within what was cut", 4: "a body taken over by its 3' end", 5: "a 3' end that overlaps", 6: "a 3' end alone",
    7: "a body not extended yet", 8: "neither body nor 3' end", 9: "less than 75 % alike", 10: "the MIR or L2 before is better", 11: "the MIR or L2 after is better", 12: "a poor MER91",
    13: "MLT2 in a Ricksha", 14: "MER3 in a MER33", 15: "a B4 before a better B1", 16: "a B4 before a better B1, seen from it", 17: "a weak RSINE1", 18: "a weak ORR1 inside", 19: "an old RatSatRep1",
    20: "a weak score", 21: "a stretch that matches by chance", 22: "not a simple repeat to cut", 23: "poly-A or satellite", 24: "not a whole Alu", 25: "an RNA kept in", 26: "not a whole element",
    27: "an RNA", 28: "within the last that stayed",
}

# Family pattern, least and most consensus place (neither included), least score that is kept (None: any goes)
LONG = [("L1MC3_3end", 1310, 1400, None), ("L1MC4_3end", 1325, 1475, None), ("^Lx9", 1860, 1940, None), ("^L1_Mur2$", 825, 932, 301), ("L1MCa_5end", 1880, 1980, 301), ("^L1_Mur3$", 835, 905, 301)]
L1 = [
    ("^HAL1$", 900, 1350, 375), ("^HAL1b$", 695, 910, 350), ("L1M4_orf2", 700, 1340, 375), ("L1MC3_3end", 1275, 1430, 350), ("L1MC4_3end", 1260, 1490, 400), ("L1MC4_5end", 850, 1340, 415),
    ("L1MCa_5end", 1855, 1995, 350), ("L1M4b_5end", 2800, 3350, 400), ("L1M4b_5end", 2180, 2300, 400), ("L1MDa_5end", 2420, 2505, 350), ("L1ME4a_3end", 475, 725, 350), ("L1MEb_5end", 620, 800, 350), ("L1MEc_5end", 2100, 2500, 360),
]
RODENT_INSIDE = [("^ORR1A1-int", 530, 680, None), ("^ORR1A3-int", 594, 911, None), ("^ORR1B1-int", 584, 861, None)]
RODENT = [
    ("^RLTR21", 1090, 1365, 351), ("^RMER12$", 750, 1025, 351), ("^RMER17A$", 205, 460, 310), ("^RMER17A2$", 290, 495, 310), ("^RMER17B$", 840, 940, 310), ("^RMER17B$", 250, 445, 310), ("^RMER17C$", 80, 250, 310),
    ("^RMER17D$", 245, 501, 310), ("^RMER17D2$", 255, 526, 310), ("^RNLTR15A$", 1440, 1550, 310), ("^RNLTR15A2$", 1310, 1420, 310),
]
PRIMATE = [("^LTR66", 380, 470, None), ("^MER45R", 310, 400, 275)]
OTHER = [("PRIMA4-int", 475, 575, 300), ("^LTR39-int$", 3900, 3990, 300), ("^LTR38-int$", 1350, 1450, 300)]
# Bases of a LINE's body before its 3' end
BODY = {"primates": 3144, "other": 4384}
CUTS = ["simple", "alu", "cut1", "cut2", "alumask"]


def listed(rules: list[tuple[str, int, int, int | None]]) -> Column:
    """Whether a row's family, place and score are in such a list."""
    one = lambda p, a, b, s: F.col("subj_name").rlike(p) & (F.col("subj_start") > a) & (F.col("subj_end") < b) & (F.lit(True) if s is None else F.col("score") < s)
    return reduce(lambda x, y: x | y, (one(*r) for r in rules))


def first_of(*cases: tuple[Column, int | None]) -> Column:
    """The number of the first case that holds."""
    found = F.when(cases[0][0], F.lit(cases[0][1]).cast("int"))
    for holds, number in cases[1:]:
        found = found.when(holds, F.lit(number).cast("int"))
    return found


def decided(hits: DataFrame, clade: str = "other", most_div: float | None = None, hmm: bool = False, no_rna: bool = False) -> DataFrame:
    """hits of a slice (with lag and lead) with rule numbers.

    skip: the row goes before anything else; own: it goes by itself; with_prev: it goes given the row before; prev: given
    it, that one goes; instead: it goes unless `prev` holds; last: it goes after all; moves: its start may be moved.
    """
    along = Window.partitionBy("key", "slice").orderBy("rank")
    before, after = (lambda c: F.lag(c).over(along)), (lambda c: F.lead(c).over(along))
    h = hits.withColumns({f"{x}_{c}": f(c) for x, f in (("p", before), ("n", after)) for c in ("subj_name", "subj_type", "query_start", "query_end", "score", "subj_start")})
    c, name, whole = F.col, F.col("subj_name"), F.concat_ws("#", "subj_name", "subj_type")
    kind = lambda k: c("kind") == k
    score, begin, end, left, start, stop = c("score"), c("subj_start"), c("subj_end"), c("subj_remaining"), c("query_start"), c("query_end")
    div = S.rebased(c("div"), c("ins"))
    later, further = start - c("p_query_start"), stop - c("p_query_end")
    # old SINEs and LINEs beside others
    old = kind("mirs") & name.rlike("(?i)^L2a|^L2b|^L3|^MIR") & (c("p_query_end") > start + 33) & (c("p_subj_type") != c("subj_type"))
    worse = (further <= 30) & ((c("p_score") >= 1.05 * score) | ((further < later) & (c("p_score") >= 0.83 * score)))
    better = (later <= 30) & ((score >= 1.05 * c("p_score")) | ((further > later) & (score >= 0.83 * c("p_score"))))
    # SINEs and what they are taken for
    sines, mlt, mer3 = kind("sines"), name.rlike("^MLT2B"), (name == "MER3") & (begin > 30) & (end < 125)
    rodent, primate = F.lit(clade == "rodents"), F.lit(clade == "primates")
    b1 = rodent & sines & name.rlike("^B1") & c("p_subj_name").rlike("^B4") & (start < c("p_query_end") - 50) & (score > 1.5 * c("p_score")) & (c("p_subj_start") >= 80)
    b4 = name.rlike("^B4") & c("n_subj_name").rlike("^B1") & (c("n_query_start") < stop - 50) & (c("n_score") > 1.5 * score) & (begin >= 80)
    of_rodents = first_of(
        (b4, 16), (whole.contains("SINE") & (begin <= 100), None), (name.rlike("^ORR1.*-int") & (c("overlap") == "*"), None),
        ((name == "RatSatRep1") & (begin > 1150) & (end < 1750) & (div > 16), 19), (score < 225, 20), ((score <= 350) & listed(RODENT), 21),
    )
    of_rodents = F.coalesce(
        of_rodents, F.when(~F.coalesce(b4, F.lit(False)) & whole.contains("SINE") & (begin <= 100) & (name == "RSINE1") & (begin > 50) & (score < 225), 17),
        F.when(~(whole.contains("SINE") & (begin <= 100)) & name.rlike("^ORR1.*-int") & (c("overlap") == "*") & listed(RODENT_INSIDE), 18),
    )
    simple = ~whole.rlike(r"AAAAA|\(A\)n|Satellite")
    kept = S.simple_repeat_kept(name, div, c("del") + c("ins"), score)
    alu = (name.rlike("^Alu") & (begin < 70) & (end > 185)) | ((begin < 6) & (left < 5))
    entire = ((begin < 6) & (left < 5) & ~whole.contains("LINE")) | (whole.contains("SINE") & (begin < 6) & (left < 20))
    rna = F.lit(no_rna) & (whole.rlike("RNA$") | name.rlike("^7SL"))
    own = first_of(
        (kind("mirs") & ~F.coalesce(old, F.lit(False)) & F.lit(not hmm) & name.contains("MER91") & (score < 200), 12),
        (sines & mlt & c("n_subj_name").rlike("^Ricksha") & (stop > c("n_query_start") + 50) & (score < c("n_score")), 13),
        (sines & mer3 & (c("n_subj_name") == "MER33") & (c("orientation") == "+") & (c("n_query_start") - start < 20), 14),
        (F.lit(not hmm) & kind("longlib") & listed(LONG), 21), (F.lit(not hmm) & kind("l1") & (score < 425) & listed(L1), 21),
        (kind("simple") & ~simple, 23), (kind("simple") & ~kept, 22), (kind("alu") & ~alu, 24),
        (kind("cut1") & ~entire, 26), (kind("cut1") & (rna | whole.rlike(r"^BC[12]\S+SINE")), 25),
        (~c("kind").isin(*KINDS[:-1]) & F.lit(not hmm) & listed(OTHER), 21),
    )
    with_prev = first_of(
        (old & worse, 10),
        (sines & mlt & c("p_subj_name").rlike("^Ricksha") & (start < c("p_query_end") - 50) & (score < c("p_score")), 13),
        (sines & mer3 & (c("p_subj_name") == "MER33") & (c("orientation") == "C") & (further < 20), 14),
    )
    return h.withColumns({
        "skip": first_of((name.rlike("buffer$") | c("subj_type").rlike("^buffer"), 1), (F.lit(most_div is not None) & (div > F.lit(most_div or 0.0)), 2)),
        "own": own, "with_prev": with_prev, "prev": first_of((old & ~F.coalesce(worse, F.lit(False)) & better, 11), (b1, 15)),
        "instead": F.when(sines & rodent, of_rodents).when(sines & primate & listed(PRIMATE), 21), "last": first_of((F.lit(no_rna) & whole.rlike("RNA$"), 27)),
        "moves": F.coalesce((kind("simple") & simple) | kind("alu") | (kind("cut1") & entire), F.lit(False)), "rebased": div, "gaps": c("del") + c("ins"),
    })


FIELDS = ["hit_id", "query_start", "score", "div", "subj_name", "subj_start", "subj_end", "subj_remaining"]


class Walk:
    """The state of a sequence's walk: plain values that JSON holds."""

    def __init__(self, state: dict | None):
        self.s = state or {"before": None, "gone": False, "stayed": None, "orf2": "", "utr": False, "cut": False, "begin": None, "line": None}

    def merged(self, row: dict, before: dict) -> None:
        """Takes over the start and, where better, the score of the row before."""
        if before["score"] > row["score"]:
            row["score"], row["div"] = before["score"], before["div"]
        row["query_start"] = before["query_start"]

    def cut2(self, row: dict, before: dict | None, clade: str, in_fragments: bool) -> tuple[int | None, int | None]:
        """(rule by which the row goes, rule by which the row before goes): whole LINE ends and bodies stay, and come together."""
        s, back = self.s, row["orientation"] == "C"
        name, begin, left = row["subj_name"], row["subj_start"], row["subj_remaining"]
        start, after = row["query_start"], row["query_remaining"]
        if not row["rebased"] + row["gaps"] < 25:
            s["cut"] = False
            return 9, None
        if name.endswith("_3end") and left < 20:
            if before and before["query_end"] > start + 20:
                s["utr"] = False if before["query_end"] >= row["query_end"] or s["cut"] else s["utr"]
                if before["query_end"] >= row["query_end"] or s["cut"]:
                    s["cut"] = False
                    return 3, None
                if s["orf2"] and not back:
                    self.merged(row, before)
                    row |= {"subj_name": name + "extended", "subj_start": s["begin"], "subj_end": row["subj_end"] + BODY["primates" if s["orf2"] == "L1P_orf2" else "other"]}
                    s |= {"cut": True, "utr": False}
                    return None, 4
                s |= {"cut": False, "begin": None, "orf2": ""}
                return 5, None
            young = not back and any(x in name for x in ("L1Hs", "L1Rn", "L1Md"))
            free = not in_fragments or (start > 50 and not back) or (after > 50 and back)
            if (begin > 150 or young) and free:
                if before and before["query_end"] >= row["query_end"] and (not back or s["cut"]):
                    row["query_start"] = before["query_end"] + 1
                s |= {"cut": True, "utr": False}
                return None, None
            s |= {"cut": False, "utr": s["utr"] or back}
            return 6, None
        if "_orf2" in name and begin > 100 and left < 20 and (not in_fragments or start > 50):
            joins = before and s["utr"] and before["query_end"] > start and back and (not in_fragments or after > 50)
            if joins:
                self.merged(row, before)
                row |= {"subj_name": s["line"]["name"] + "extended", "subj_remaining": s["line"]["left"], "subj_end": s["line"]["end"] + BODY["primates" if clade == "primates" else "other"]}
                s |= {"cut": True, "orf2": ""}
            else:
                s |= {"cut": False, "begin": begin, "orf2": s["orf2"] if back else name}
            s["utr"] = False
            return (None if joins else 7), None
        s |= {"utr": False, "orf2": "", "cut": False}
        return 8, None

    def take(self, row: dict, clade: str, in_fragments: bool) -> list[tuple[dict, int | None]]:
        """The row and its rule, and the row before where it goes now."""
        s, out = self.s, []
        if row["skip"] is not None:
            s |= {"gone": True, "before": None}
            return [(row, row["skip"])]
        before = None if s["gone"] else s["before"]
        line = {"name": row["subj_name"], "left": row["subj_remaining"], "end": row["subj_end"]}
        # in the order in which rules apply: the last to go tells whether the row counts as the one before the next
        if row["kind"] == "cut2":
            rule, taken = self.cut2(row, before, clade, in_fragments)
        else:
            if before and row["moves"] and before["query_end"] >= row["query_start"]:
                row["query_start"] = before["query_end"] + 1
            rule = row["own"] if row["own"] is not None else row["with_prev"] if before else None
            taken = row["prev"] if before else None
            if taken is None and rule is None:
                rule = row["instead"]
        last = rule is not None and taken is None
        if taken is not None:
            out.append((before, taken))
        if row["last"] is not None:
            rule, last = rule if rule is not None else row["last"], True
        if not last and row["kind"] in CUTS and s["stayed"] is not None and s["stayed"] >= row["query_end"]:
            rule, last = rule if rule is not None else 28, True
        out.append((row, rule))
        s |= {"before": {c: row[c] for c in ("hit_id", "query_start", "query_end", "score", "div")}, "gone": last, "line": line, "stayed": s["stayed"] if last else row["query_end"]}
        return out


def class_filtered(hits: DataFrame, clade: str = "other", in_fragments: bool = False, slice_rows: int = folds.SLICE_ROWS, **options) -> DataFrame:
    """(hit_id, rule, and the values of a row after all changes) of every hit; rule is null for those that stay."""
    keyed = hits.withColumn("key", F.concat_ws("\t", "kind", "query_name"))
    placed = folds.in_slices(folds.numbered_rows(keyed, key="key"), 0, slice_rows)
    # neighbours across slices: the first row of a slice is seen by the slice before, and the last by the slice after
    near = F.when((F.col("rank") - 1) % slice_rows == 0, F.array(F.col("slice"), F.col("slice") - 1)).when(F.col("rank") % slice_rows == 0, F.array(F.col("slice"), F.col("slice") + 1)).otherwise(F.array("slice"))
    if slice_rows == 1:
        raise ValueError("a slice must hold two rows")
    placed = placed.withColumn("__own", F.col("slice")).withColumn("slice", F.explode(near)).where("slice >= 0")
    rows = decided(placed, clade, **options).where(F.col("slice") == F.col("__own"))
    needed = ["kind", "orientation", "query_end", "query_remaining", "rebased", "gaps", "moves", "skip", "own", "with_prev", "prev", "instead", "last"]

    def step(t: dict[str, list], state: dict | None) -> tuple[dict[str, list], dict]:
        walk, out = Walk(state), []
        for row in zip(*t.values(), strict=True):
            out += walk.take(dict(zip(t, row, strict=True)), clade, in_fragments)
        return {c: [r.get(c) for r, _ in out] for c in FIELDS} | {"rule": [x for _, x in out]}, walk.s

    kinds = {c: hits.schema[c].dataType.simpleString() for c in FIELDS}
    found = folds.fold(rows.select("key", "slice", "rank", *FIELDS, *needed), step, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", rule int", None, "key", [*FIELDS, *needed])
    # a row may be met twice: as itself, and where the row after it made it go
    own = F.struct(F.col("subj_name").isNull().alias("later"), *FIELDS[1:])
    return found.groupBy("hit_id").agg(F.min("rule").alias("rule"), F.min(own).alias("x")).select("hit_id", "rule", *[F.col(f"x.{c}").alias(c) for c in FIELDS[1:]])
