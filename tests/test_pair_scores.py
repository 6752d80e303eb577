"""Pair scores, name rules and gapped distances with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment as A, scalar as S
from strandloom.operators import pair_scores as P

HIT = dict(id=1, name="MIR3", type="SINE/MIR", orientation="+", query_start=1, query_end=100, subj_start=1, subj_end=100, subj_remaining=50, score=300, stage=40, masked=True, div=10.0)


def score(spark, column, left=None, right=None, distance=1, ltr_distance=1):
    r = HIT | dict(id=2, query_start=105, query_end=200, subj_start=101, subj_end=196)
    values = {f"l_{k}": v for k, v in (HIT | (left or {})).items()} | {f"r_{k}": v for k, v in (r | (right or {})).items()} | {"distance": distance, "ltr_distance": ltr_distance}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_generic_and_sine(spark):
    assert score(spark, P.generic_score()) == 1
    assert score(spark, P.generic_score(), right=dict(orientation="C")) == 0
    # another stage: like stems, and the consensus gap of 0 is in reach
    assert score(spark, P.generic_score(), right=dict(stage=45)) == 0.5
    # 1.5 * 2500 * (10 - 5) / 10 * (15 - 3) / 15 = 1500
    far = dict(stage=45, div=15.0, subj_end=1700)
    assert [score(spark, P.generic_score(), right=far | dict(subj_start=s), distance=3) for s in (1600, 1601)] == [0.5, 0]
    assert score(spark, P.generic_score(), right=dict(stage=45, name="L2a")) == 0
    # the stem of AluSx1 is AluSx, of any other family the name without its last letter
    alu = lambda a, b: [score(spark, f(), left=dict(name=a), right=dict(name=b, stage=45)) for f in (P.sine_score, P.generic_score)]
    assert alu("AluSx3", "AluSx1") == [0.5, 0] and alu("MIR3b", "MIR3a") == [0.5, 0.5]
    assert score(spark, P.refined_sine_score(), distance=2) == 600 / 2 / 5
    assert score(spark, P.refined_sine_score(), right=dict(name="MIR")) == 0


def test_ltr(spark):
    fit = lambda a, b, t="LTR/ERVL-MaLR", u=None: score(spark, P.ltr_names_fit(), dict(name=a, type=t), dict(name=b, type=u or t))
    assert [fit("MLT1A", "MLT1B"), fit("THE1B", "MSTA"), fit("MSTA", "THE1B"), fit("MLT1A", "THE1B"), fit("MER21A", "MER21B", "LTR/ERVL"), fit("MER21A", "LTR33", "LTR/ERVL"), fit("MER21A", "MER21A", "LTR/ERVL", "LTR/ERV1")] == [1, 0.5, 0.5, 0, 1, 0.5, 0]
    names = ["HERVL-int", "LTR33", "MLT1-int", "MER4_I", "MER4_I_a", "IAPLTR1", "LTR5-int", "ETnERV2", "THE1B"]
    assert spark.range(1).select(*[S.is_internal(F.lit(n)).alias(f"c{k}") for k, n in enumerate(names)]).first()[:] == (True, False, True, True, True, False, True, True, False)
    ltr = dict(name="MER21A", type="LTR/ERVL")
    assert score(spark, P.ltr_score(), ltr, ltr, 2) == 1.5
    # too little is missing at the open ends, so it is a pair within reach only; then one that isn't masked
    assert score(spark, P.ltr_score(), ltr | dict(subj_remaining=9), ltr, 2) == 1
    assert score(spark, P.ltr_score(), ltr | dict(subj_remaining=9, masked=False), ltr, 2) == 0
    # overlap by 12 bases of the query
    assert score(spark, P.ltr_score(), ltr | dict(masked=False), ltr | dict(query_start=88), 4) == 0.5
    # an internal part beside an LTR, both whole at their inner ends
    inside = dict(name="HERVL-int", type="LTR/ERVL")
    assert [score(spark, P.ltr_score(), inside | dict(subj_remaining=n), ltr | dict(subj_start=33), d) for n, d in ((33, 2), (34, 2), (33, 3))] == [1.5, 0, 0]


def test_other_pairs(spark):
    minus = dict(orientation="C", subj_start=300, subj_end=400)
    assert score(spark, P.transposons_fit(), minus, dict(orientation="C", subj_start=150, subj_end=250)) is True
    assert score(spark, P.transposons_fit()) is False
    assert [score(spark, P.congruous(), right=dict(subj_start=s)) for s in (7104, 7105)] == [True, False]
    found = spark.createDataFrame([("a", "a", 1, 9), ("a", "b", 1, 9), ("b", "a", 1, 9), ("a", "c", 1, 9), ("a", "c", 3, 9), ("d", "a", 1, 9), ("a", "e", 1, 9)], "l_name string, r_name string, r_query_start int, r_query_end int")
    found = found.withColumns({"l_query_start": F.lit(1), "l_query_end": F.lit(9)})
    allowed = spark.createDataFrame([("a", "b", 0), ("a", "c", 7), ("a", "d", -1)], "name_a string, name_b string, threshold int")
    rows = {(x.l_name, x.r_name, x.r_query_start): x.names_fit for x in P.line_names_fit(found, allowed).collect()}
    assert rows == {("a", "a", 1): True, ("a", "b", 1): True, ("b", "a", 1): True, ("a", "c", 1): True, ("a", "c", 3): False, ("d", "a", 1): False, ("a", "e", 1): False}


def test_pairs_meet_once(spark):
    rows = [(k, "chr1", "L1" if k % 2 else "LTR1", "LINE/L1" if k % 2 else "LTR/ERV1", 10 * k, 10 * k + 5) for k in range(5)]
    hits = spark.createDataFrame(rows, "hit_id long, query_name string, subj_name string, subj_type string, query_start long, query_end long")
    rest = {c: F.lit(1) for c in ("orientation", "subj_start", "subj_end", "subj_remaining", "score", "stage", "masked", "div")}
    found = sorted((x.l_id, x.r_id, x.distance, x.ltr_distance) for x in P.pairs(hits.withColumns(rest), 2).collect())
    assert found == [(0, 1, 1, 0), (0, 2, 2, 1), (1, 2, 1, 1), (1, 3, 2, 1), (2, 3, 1, 0), (2, 4, 2, 1), (3, 4, 1, 1)]
    assert P.pairs(hits.withColumns(rest).where("false"), 2).count() == 0


def test_tandem(spark):
    kept = [S.tandem_kept(F.lit(c), F.lit(s), y) for c, s, y in ((4.0, 50, True), (4.1, 20, True), (4.1, 19, True), (5.0, 50, False), (5.5, 50, False))]
    bits = [S.tandem_bits(F.lit(50), F.lit(p), y) for p, y in ((1, True), (8, False))]
    assert spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(kept + bits)]).first()[:] == (False, True, False, False, True, int((50 * 0.41 - math.log(8.51)) / math.log(2)), None)


def test_gapped_distance(spark):
    q, s = "ACGTACGT-ACA--", "ACGTGCTTAAC-C-"
    # 14 columns: 3 gaps, 1 column of gaps alone, a transition, a transversion and 8 equal letters
    w, p, t, same = 25 / 28, 1 / 14, 1 / 14, 8 / 14
    value = 100 * (0.75 * w * math.log(w) - w / 2 * math.log((same - p) * math.sqrt(same + p - t)))
    d, gaps = A.kimura_gapped(q, s)
    assert (d.percent, d.transitions, d.transversions, d.bases, gaps) == (pytest.approx(value), 1, 1, 10, 3)
    assert A.kimura_gapped("--", "AC")[0].percent == 10_000
    row = spark.range(1).select(A.kimura_gapped_column(F.lit(q), F.lit(s)).alias("k")).select("k.*").first()
    assert row.percent == pytest.approx(value) and row.gaps == 3
