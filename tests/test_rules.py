"""Rules with values worked out by hand from their definitions, and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.functions.graph_groups import GRAPH_GROUPS
from strandloom.operators import elements as E, greedy, report


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_names(spark):
    s = lambda x: S.soundex(F.lit(x))
    assert one(spark, s("Wright"), s("Robert"), s("Ashcraft"), s("Tymczak"), s("Pfister"), s("Honeyman"), s("a"), s("1b c")) == ("W623", "R163", "A261", "T522", "P236", "H555", "a000", "1200")
    assert one(spark, S.sanitized(F.lit("a , _b/c (d)<e>'f?"))) == ("a_b/c_def?",)
    b = lambda x: S.accession_bin(F.lit(x))
    assert one(spark, b("DF000123456"), b("DR0001234"), b("DF000123456789"), b("MIR3"), b("DF12")) == ("Families/DF/00/01/23", "Families/Aux/dr", "Families/DF/00/01/23", "Families/Aux/mi", "Families/Aux/df")


def test_coordinates_and_thresholds(spark):
    begin, end = S.translated(F.lit(5), F.lit(120), F.lit(11), F.lit(110), F.lit(201), F.lit(250))
    assert one(spark, begin, end) == (201, 250)
    begin, end = S.translated(F.lit(31), F.lit(60), F.lit(11), F.lit(110), F.lit(201), F.lit(250))
    assert one(spark, begin, end) == (211, 225)
    assert one(spark, S.hmm_threshold(F.lit(-9.0), F.lit(0.7), F.lit(300)))[0] == pytest.approx(-9 - __import__("math").log(0.02 / (3000 / 300)) / 0.7)
    assert one(spark, S.too_diverged(F.lit(25.0), F.lit(12.0)), S.too_diverged(F.lit(15.0), F.lit(6.0)), S.too_diverged(F.lit(30.0), F.lit(16.0))) == (True, False, False)


def test_filters(spark):
    drop = lambda n, a, b, s: S.pre_mask_drop(F.lit(n), F.lit(a), F.lit(b), F.lit(s))
    assert one(spark, drop("SVA_A", 855, 1269, 900), drop("SVA_A", 854, 1269, 900), drop("SVA_A", 1263, 1371, 900), drop("LAVA_B", 1, 2, 499), drop("LAVA_B", 1, 2, 500), drop("AluY", 900, 1000, 1)) == (True, False, True, True, False, False)
    keep = lambda n, d, g, s: S.simple_repeat_kept(F.lit(n), F.lit(float(d)), F.lit(float(g)), F.lit(s))
    # (CA)n: length 2, complexity 1, so at most 13 percent
    assert one(spark, keep("(CA)n", 10, 4.5, 200), keep("(CA)n", 10, 4.6, 200), keep("(GA)n", 4, 2, 200), keep("(GA)n", 4, 1, 200), keep("(GA)n", 20, 0, 1201), keep("(A)n", 0, 0, 9000)) == (True, False, False, True, True, False)


def test_super_classes_and_groups(spark):
    rows = [(k, "q", 100 * k + 1, 100 * k + 50, t) for k, t in enumerate(["SINE/Alu?", "LINE/L2", "LTR/ERVL-MaLR", "DNA/hAT-Charlie", "rRNA", "Simple_repeat", "Unknown", "Retroposon/SVA", "LINE/RTE-BovB"])]
    h = spark.createDataFrame([(*r, k % 9) for k, r in enumerate(rows)], "hit_id long, query_name string, query_start long, query_end long, subj_type string, div_permille long")
    got = {r["super"]: (r["n_hits"], r["bp"]) for r in report.super_classes(h).collect()}
    assert got == {"SINE": (1, 50), "LINE": (2, 100), "LINECR1": (1, 50), "LINERTE": (1, 50), "LTR": (1, 50), "LTRERV": (1, 50), "DNA": (1, 50), "DNAHAT": (1, 50), "RNA": (1, 50), "SIMPLE": (1, 50), "OTHER": (2, 100)}
    heads = {r["subj_type"]: (r["n_hits"], r["bp"]) for r in report.class_coverage(h, F.col("hit_id") > 0).collect()}
    assert heads["SINE/Alu"] == (0, 50) and heads["LINE/L2"] == (1, 50)
    assert len(GRAPH_GROUPS) == 136
    groups = {r["grp"] for r in report.landscape(h).collect()}
    assert groups == {"SINE/Alu", "LINE/L2", "LTR/ERVL", "DNA/hAT", "Structural_RNA", "Simple_repeat", "Unknown", "Retroposon/SVA", "LINE/RTE"}


def brute_resolve(rows, key):
    """Every winner against all that come after it."""
    rows = [list(r) for r in sorted(rows, key=lambda r: (key(r), r[1], r[0]))]
    alive = [True] * len(rows)
    for i, (_, a, b, *_) in enumerate(rows):
        if not alive[i]:
            continue
        a, b = rows[i][1:3]
        for j in range(i + 1, len(rows)):
            c, d = rows[j][1:3]
            shared = min(b, d) - max(a, c) + 1
            if alive[j] and shared > 0:
                if shared in (b - a + 1, d - c + 1):
                    alive[j] = False
                elif a < c:
                    rows[j][1] += shared
                else:
                    rows[j][2] -= shared
    return sorted((r[0], r[1], r[2]) for r, x in zip(rows, alive) if x)


@pytest.mark.parametrize("mode", ["score", "length", "divergence"])
def test_resolved_overlaps(spark, mode):
    r = random.Random(17)
    rows = [(k, s, s + r.randrange(1, 80), r.randrange(200, 260), r.randrange(300), r.choice(["SINE/Alu", "Simple_repeat"])) for k in range(300) for s in [r.randrange(1, 3000)]]
    rows += [(300, 5010, 5090, 100, 10, "SINE/Alu"), (301, 5010, 5050, 900, 1, "SINE/Alu")]
    h = spark.createDataFrame([(i, "q", s, e, sc, d, t) for i, s, e, sc, d, t in rows], "hit_id long, query_name string, query_start long, query_end long, score long, div_permille long, subj_type string")
    key = {"score": lambda r: -r[3], "length": lambda r: r[1] - r[2], "divergence": lambda r: 1010 if r[5] == "Simple_repeat" else r[4]}[mode]
    got = sorted((x["hit_id"], x["query_start"], x["query_end"]) for x in greedy.resolve_overlaps(h, mode).collect())
    assert got == brute_resolve(rows, key)


def test_whole_elements_and_fragments(spark):
    alu = lambda n, a, b, r: E.full_length_alu(F.lit(n), F.lit(a), F.lit(b), F.lit(r))
    assert one(spark, alu("AluY", 69, 186, 99), alu("AluY", 69, 185, 99), alu("FLAM", 5, 90, 4), alu("B1", 69, 186, 99)) == (True, False, True, False)
    cut = lambda n, a, r: E.full_length(F.lit(n), F.lit(a), F.lit(r))
    assert one(spark, cut("MER5A#DNA/hAT", 5, 4), cut("MER5A#DNA/hAT", 5, 5), cut("L1#LINE/L1", 1, 0), cut("B2#SINE/B2", 5, 19), cut("B2#SINE/B2", 6, 0), cut("BC1_MM#SINE", 1, 0)) == (True, False, False, True, False, False)
    rows = [(1, 9, "DNA"), (1, 10, "DNA"), (1, 11, "DNA"), (1, 6, "Simple_repeat"), (1, 5, "Simple_repeat"), (1, 50, "Low_complexity")]
    h = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "hit_id int, query_start int, query_end int, subj_type string")
    ids = lambda d: sorted(r.hit_id for r in d.collect())
    assert ids(E.without_lone_fragments(h, F.lit(False))) == [1, 2, 5] and ids(E.without_lone_fragments(h, F.col("hit_id") == 0)) == [0, 1, 2, 5]
    assert ids(E.without_fragments(h)) == [2, 3, 5] and ids(E.without_fragments(h, simple=False)) == [2]


def test_frames_and_names(spark):
    rows = [("MLT2A2", 270, 0), ("MLT2A2", 271, 108), ("MLT2B5", 180, 0), ("MLT2B5", 181, -116), ("MLT2B5", 416, -162), ("MLT2B12", 999, 0), ("MLT2F", 551, -100), ("L1M1", 10, 300), (None, 10, 0)]
    h = spark.createDataFrame([(k, n, s, s + 5) for k, (n, s, _) in enumerate(rows)], "hit_id int, subj_name string, subj_start long, subj_end long")
    shifts = spark.createDataFrame([("L1M1", 300)], "name string, shift long")
    found = {r.hit_id: r.subj_start for r in E.anchored(h, shifts).collect()}
    assert found == {k: s + m for k, (_, s, m) in enumerate(rows)}
    close = spark.createDataFrame([(1, k, f"Alu{k}", 90 + k) for k in range(12)] + [(2, k, f"Alu{k}", 89 + k) for k in range(12)], "g int, hit_id int, subj_name string, score int")
    assert sorted(tuple(r) for r in E.ambiguous(close, ["g"], F.lit("Alu")).collect()) == [(1, 10, "Alu11"), (2, 10, "Alu11")]
    assert sorted(tuple(r) for r in E.ambiguous(close, ["g"], F.lit("Alu"), points=11).collect()) == [(1, 11, "Alu"), (2, 11, "Alu")]
