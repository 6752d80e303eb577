"""Folds over slices, chains of pieces, rules of classes, nested inserts and cut sequences, with cases worked out by hand."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators import excision, folds, joining, nesting, rule_filters as R
from strandloom.operators import pair_scores as P

LINE = dict(subj_name="L1PA3", subj_type="LINE/L1", orientation="+", query_name="q", subj_remaining=2000, score=500, stage=40, masked=True, div=10.0, query_remaining=10_000)


def hits(spark, rows):
    return spark.createDataFrame([LINE | {"hit_id": k + 1} | r for k, r in enumerate(rows)])


def along(*places, **more):
    """Rows of one element whose pieces follow one another on the query and the consensus."""
    return [dict(query_start=a, query_end=b, subj_start=a, subj_end=b) | more for a, b in places]


# folds
@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_a_fold_is_that_of_the_whole_sequence(spark, slice_rows):
    r = random.Random(1)
    rows = [(k, f"q{k % 3}", r.randrange(500_000), r.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, v long").withColumns({"query_end": F.col("query_start"), "score": F.lit(1)})

    def step(t, held):
        # forgets at 0, so that slices settle; otherwise hands on
        t, out = t.sort_by("rank"), []
        for v in t.column("v").to_pylist():
            held = 0 if v == 0 else held * 3 % 1009 + v
            out.append(held)
        return pa.table({"hit_id": t.column("hit_id"), "got": pa.array(out, pa.int64())}), held

    placed = folds.in_slices(folds.numbered_rows(df), 0, slice_rows)
    got = {x["hit_id"]: x["got"] for x in folds.fold(placed, step, "hit_id long, got long", 0).collect()}
    want = {}
    for q in range(3):
        held = 0
        for k, _, _, v in sorted((x for x in rows if x[1] == f"q{q}"), key=lambda x: (x[2], x[0])):
            held = want[k] = 0 if v == 0 else held * 3 % 1009 + v
    assert got == want
    ranks = {x["hit_id"]: x["rank"] for x in folds.numbered_rows(df).collect()}
    assert all(ranks[k] == sorted((y[2], y[0]) for y in rows if y[1] == q).index((a, k)) + 1 for k, q, a, _ in rows)
    assert folds.fold(placed.limit(0), step, "hit_id long, got long", 0).collect() == []


# chains
def linked(spark, rows, allowed=(), **options):
    table = spark.createDataFrame(list(allowed), "name_a string, name_b string, threshold long")
    return sorted((x["hit_id"], x["partner_id"]) for x in joining.joined_links(hits(spark, rows), table, **options).collect())


def test_pieces_are_joined(spark):
    line = along((1, 200), (251, 400), (431, 600))
    assert linked(spark, line) == [(1, 2), (2, 3)]
    assert linked(spark, [line[0], line[1] | dict(orientation="C"), line[2]]) == [(1, 3)]
    # an element in between of another class: joined over it, but not if it is much older
    other = dict(query_start=205, query_end=245, subj_start=1, subj_end=41, subj_name="MIR", subj_type="SINE/MIR")
    assert linked(spark, [line[0], other, line[1]]) == [(1, 3)]
    old = dict(query_start=601, query_end=640, subj_start=1, subj_end=41, subj_name="MIR", subj_type="SINE/MIR", div=35.0)
    far = along((1, 200), (651, 800))
    assert linked(spark, [far[0], old | dict(div=12.0), far[1]]) == [(1, 3)] and linked(spark, [far[0], old, far[1]]) == []
    # simple repeats don't count for age, and link nothing
    assert linked(spark, [far[0], old | dict(subj_type="Simple_repeat", subj_name="(A)n"), far[1]]) == [(1, 3)]


def test_gaps_end_the_search(spark):
    far = along((1, 200), (9_001, 9_200))
    near = [far[0], far[1] | dict(subj_start=251, subj_end=450)]
    assert linked(spark, near) == [(1, 2)]
    # 10,001 bases in one gap
    beyond = dict(query_start=10_202, query_end=10_400, subj_start=251, subj_end=450)
    assert linked(spark, [far[0], beyond]) == [] and linked(spark, [far[0], beyond | dict(query_start=10_201)]) == [(1, 2)]


def test_links_nest(spark):
    # the inner pair of the same class is nearer to the last piece, so the outer one gives way
    inner = dict(query_start=210, query_end=300, subj_start=201, subj_end=290)
    rows = [*along((1, 200)), inner, dict(query_start=310, query_end=500, subj_start=291, subj_end=480)]
    assert linked(spark, rows) == [(1, 2), (2, 3)]


def test_line_score(spark):
    base = {f"l_{k}": v for k, v in dict(name="L1PA3", orientation="+", query_start=1, query_end=200, subj_start=1, subj_end=200, subj_remaining=2000, div=10.0).items()}
    base |= {f"r_{k}": v for k, v in dict(name="L1PA3", orientation="+", query_start=251, query_end=400, subj_start=251, subj_end=400, subj_remaining=1800, div=10.0, query_remaining=500).items()} | {"names_fit": True}

    def score(**more):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (base | more).items()])
        return row.select(P.line_score(F.lit(1))).first()[0]

    # a gap of 50 in both: the consensus is not shared, so 1 / (-50 + -50)
    assert score() == pytest.approx(1 + 1 / 100)
    assert score(names_fit=False) == pytest.approx(0.5 + 1 / 100)
    assert score(names_fit=False, r_name="L2a") == 0
    assert score(r_orientation="C") == 0
    # the consensus gap must be at most 1.2 * 2000 / 1.4
    assert [score(names_fit=True, r_name="x", r_subj_start=s, r_subj_end=s + 149) > 0 for s in (1915, 1916)] == [True, False]
    # a 3' end isn't before a 5' end
    assert score(l_name="L1PA3_3end", r_name="L1PA3_5end") == pytest.approx(0.5 + 1 / 100)


def test_chains_do_not_change_with_slices(spark):
    from strandloom.plans import joining_queries as Q

    h = Q.pieces(spark, "/root/testdata/sf0.001")
    h = h.withColumn("query_name", F.concat(F.lit("s"), F.col("hit_id") % 3)).withColumn("query_start", F.col("query_start") * 2).withColumn("query_end", F.col("query_start") + 150).checkpoint()
    rows = lambda n: {tuple(x) for x in joining.joined_links(h, Q.allowed(spark), n).collect()}
    whole = rows(4096)
    assert rows(21) == whole and len(whole) > 30
    assert len({x[1] for x in whole}) == len(whole) == len({x[2] for x in whole})


# rules
def ruled(spark, rows, **options):
    base = dict(query_name="q", orientation="+", query_remaining=500, score=300, div=5.0, ins=0.0, overlap=None, subj_start=200, subj_end=400, subj_remaining=5)
    df = spark.createDataFrame([base | {"hit_id": k + 1} | r for k, r in enumerate(rows)], "hit_id long, kind string, query_name string, query_start long, query_end long, query_remaining long, orientation string, subj_name string, subj_type string, subj_start long, subj_end long, subj_remaining long, score long, div double, del double, ins double, overlap string")
    df = df.fillna({"del": 0.0})
    return {x["hit_id"]: x for x in R.class_filtered(df, **options).collect()}


def test_rules_by_class(spark):
    at = lambda a, b, name, kind, **more: dict(query_start=a, query_end=b, subj_name=name.split("#")[0], subj_type=name.split("#")[1], kind=kind, **more)
    got = ruled(spark, [at(1, 100, "MIR#SINE/MIR", "mirs", score=400), at(50, 110, "L2a#LINE/L2", "mirs"), at(60, 120, "MIR#SINE/MIR", "mirs", score=200)])
    assert [got[k]["rule"] for k in (1, 2, 3)] == [None, 10, None]  # the third has no row before it that counts
    got = ruled(spark, [at(1, 100, "B4A#SINE/B4", "sines", score=300), at(20, 160, "B1_Mm#SINE/Alu", "sines", score=600)], clade="rodents")
    assert [got[k]["rule"] for k in (1, 2)] == [16, None]  # it goes as soon as it is met
    assert [x["rule"] for x in ruled(spark, [at(1, 100, "B4A#SINE/B4", "sines"), at(20, 160, "B1_Mm#SINE/Alu", "sines", score=600)]).values()] == [None, None]
    got = ruled(spark, [at(1, 300, "AluY#SINE/Alu", "alu", subj_start=1, subj_end=300), at(100, 290, "AluSx#SINE/Alu", "alu", subj_start=1, subj_end=290), at(250, 420, "AluJb#SINE/Alu", "alu", subj_start=1, subj_end=300)])
    assert [got[k]["rule"] for k in (1, 2, 3)] == [None, 28, None] and got[2]["query_start"] == 301 and got[3]["query_start"] == 250
    got = ruled(spark, [at(1, 100, "U6#snRNA", "other")], no_rna=True)
    assert got[1]["rule"] == 27
    assert ruled(spark, [at(1, 100, "MIR#buffer", "mirs")])[1]["rule"] == 1
    assert ruled(spark, [at(1, 100, "MIR#SINE/MIR", "mirs", div=30.0)], most_div=25.0)[1]["rule"] == 2
    assert ruled(spark, []) == {}


def test_bodies_of_lines(spark):
    end = dict(kind="cut2", subj_name="L1PA2_3end", subj_type="LINE/L1")
    body = dict(kind="cut2", subj_name="L1P_orf2", subj_type="LINE/L1")
    # backwards, a short 3' end is kept in mind and taken over by its body
    got = ruled(spark, [end | dict(query_start=10, query_end=300, orientation="C", subj_start=100), body | dict(query_start=250, query_end=900, orientation="C")], clade="primates")
    assert [got[k]["rule"] for k in (1, 2)] == [6, 7]
    # the first went, so it isn't the row before the second; a whole end before both is
    assert ruled(spark, [end | dict(query_start=10, query_end=300, subj_start=151)])[1]["rule"] is None
    assert ruled(spark, [end | dict(query_start=10, query_end=300, div=26.0)])[1]["rule"] == 9
    assert ruled(spark, [body | dict(subj_name="HAL1", query_start=1, query_end=50)])[1]["rule"] == 8
    chain = [end | dict(query_start=10, query_end=300, subj_start=160, score=900), end | dict(query_start=200, query_end=290, subj_start=160), end | dict(query_start=400, query_end=500, subj_start=160)]
    got = ruled(spark, chain)
    assert [got[k]["rule"] for k in (1, 2, 3)] == [None, 3, None]


def test_rules_do_not_change_with_slices(spark):
    from strandloom.plans import rule_queries as Q

    h = Q.ruled(spark, "/root/testdata/sf0.001").withColumn("query_name", F.lit("one")).checkpoint()
    rows = lambda n: sorted(map(str, R.class_filtered(h, clade="rodents", slice_rows=n).collect()))
    assert rows(40) == rows(4096)


# nests
def split(spark, rows, **options):
    found = nesting.split_at_inserts(hits(spark, rows), **options).collect()
    return {k: sorted((x["piece"], x["query_start"], x["query_end"], x["subj_start"], x["subj_end"], x["subj_remaining"]) for x in found if x["hit_id"] == k) for k in {x["hit_id"] for x in found}}


def test_inserts_split(spark):
    outer = dict(query_start=1, query_end=1000, subj_start=1, subj_end=800, subj_remaining=200)
    inside = lambda a, b, **more: dict(query_start=a, query_end=b, subj_name="AluY", subj_type="SINE/Alu", subj_start=1, subj_end=b - a + 1, subj_remaining=0) | more
    # 1000 - (600 - 401) = 801 bases of the query for 800 of the consensus; 399 * 800 / 801 = 398
    for n in (1, 2, 4096):
        assert split(spark, [outer, inside(401, 600)], slice_rows=n)[1] == [(1, 1, 400, 1, 399, 601), (2, 601, 1000, 400, 800, 200)]
    assert split(spark, [outer | dict(orientation="C"), inside(401, 600)])[1] == [(1, 1, 400, 402, 800, 200), (2, 601, 1000, 1, 401, 200)]
    # near ones are one, one inside the last counts for nothing, one that ends beyond ends the search
    assert [x[1:3] for x in split(spark, [outer, inside(401, 500), inside(420, 450), inside(504, 600), inside(900, 1200), inside(950, 980)])[1]] == [(1, 400), (601, 1000)]
    # at the edges only the range is trimmed
    assert split(spark, [outer, inside(4, 100)])[1] == [(1, 101, 1000, 4, 800, 200)]
    assert split(spark, [outer, inside(900, 996)])[1] == [(1, 1, 899, 1, 796, 200)]
    # hits of its own family and stage don't count
    assert split(spark, [outer, inside(401, 600, subj_name="L1PA3")])[1] == [(1, 1, 1000, 1, 800, 200)]
    assert split(spark, [outer, inside(401, 600, subj_name="L1PA3", stage=45)])[1][0][:3] == (1, 1, 400)


def test_crossing_links_go(spark):
    links = lambda pairs: spark.createDataFrame([("q", i, j) for i, j in pairs], "query_name string, i long, j long")
    for n in (1, 3, 100):
        got = {(x["i"], x["j"]) for x in nesting.untangled(links([(1, 9), (2, 5), (3, 6), (4, 12), (5, 8), (9, 11), (10, 13)]), n).collect()}
        assert got == {(1, 9), (2, 5), (5, 8), (9, 11)}


# cuts
def test_cut_and_lift(spark, monkeypatch):
    monkeypatch.setattr(excision, "BIN", 50)
    r = random.Random(3)
    cuts, at = [], 1
    while at < 1500:
        a = at + r.randrange(1, 40)
        b = a + r.randrange(30)
        cuts.append((a, b))
        at = b + r.randrange(1, 60)
    places = sorted(r.sample(range(1, 1600), 200))
    df = spark.createDataFrame([("q", a, b) for a, b in cuts] + [("r", 5, 9)], "query_name string, query_start long, query_end long")
    led = excision.ledger(df).checkpoint()
    # the sequence as its letters' places, with a letter for each range
    letters, skip = [], {p for a, b in cuts for p in range(a, b)}
    letters = [p for p in range(1, 1700) if p not in skip]  # of a range its last place stands for the letter
    there = {p: k + 1 for k, p in enumerate(letters)}
    end_of = {p: b for a, b in cuts for p in range(a, b + 1)}
    h = spark.createDataFrame([("q", k, p, p + 40) for k, p in enumerate(places)] + [("none", 999, 3, 8)], "query_name string, hit_id long, query_start long, query_end long")
    got = {x["hit_id"]: x for x in excision.to_cut(h, led).collect()}
    assert len(got) == 201 and (got[999]["cut_start"], got[999]["cut_end"]) == (3, 8)
    for k, p in enumerate(places):
        assert (got[k]["cut_start"], got[k]["cut_end"]) == tuple(there[end_of.get(x, x)] for x in (p, p + 40))
    back = excision.lifted(excision.to_cut(h, led).select("query_name", "hit_id", F.col("cut_start").alias("query_start"), F.col("cut_end").alias("query_end")), led)
    back = {x["hit_id"]: x for x in back.collect()}
    assert all((back[k]["full_start"], back[k]["full_end"]) == tuple(end_of.get(x, x) for x in (p, p + 40)) for k, p in enumerate(places))


def test_fragments(spark):
    cuts = excision.ledger(spark.createDataFrame([("q", 10, 19), ("q", 30, 39), ("q", 60, 69)], "query_name string, query_start long, query_end long"))
    h = spark.createDataFrame([("q", 1, 1, 50), ("q", 2, 10, 25), ("q", 3, 30, 39), ("q", 4, 40, 50), ("q", 5, 25, 39), ("q", 6, 5, 65)], "query_name string, hit_id long, full_start long, full_end long")
    got = {}
    for x in excision.fragments(h, cuts).collect():
        got.setdefault(x["hit_id"], []).append((x["frag_start"], x["frag_end"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 9), (20, 29), (40, 50)], 2: [(10, 25)], 3: [(30, 39)], 4: [(40, 50)], 5: [(25, 29)], 6: [(5, 9), (20, 29), (40, 59)]}


def test_linked_pieces_merge(spark):
    base = LINE | {"del": 2.0, "ins": 1.0, "n_pieces": 1, "subj_remaining": 100, "hit_id": 1}
    a = base | dict(query_start=1, query_end=100, subj_start=1, subj_end=100)
    b = base | dict(query_start=106, query_end=205, subj_start=126, subj_end=225, div=20.0, score=700, subj_name="L1PA4", subj_remaining=75, hit_id=2)
    # 5 bases apart on the query, 25 on the consensus: 20 more are deleted, of 205 in all
    assert joining.shares(a, b) == (-5, -25)
    assert joining.merges(a, b) and joining.joint_levels(a, b) == {"div": 15.12, "del": 11.76, "ins": 1.0}
    one = joining.one_piece(a, b)
    assert [one[c] for c in ("query_start", "query_end", "subj_start", "subj_end", "subj_remaining", "score", "subj_name", "n_pieces", "hit_id")] == [1, 205, 1, 225, 75, 700, "L1PA4", 2, 1]
    # too far apart, on the query and on the consensus; of another stage
    assert not joining.merges(a, b | dict(query_start=112, query_end=211))
    assert not joining.merges(a, b | dict(subj_start=202, subj_end=301)) and joining.merges(a, b | dict(subj_start=201, subj_end=300))
    assert not joining.merges(a, b | dict(stage=45))
    # 34 shared bases merge whatever the consensus; 33 don't
    assert joining.merges(a, b | dict(query_start=67, query_end=166, stage=45)) and not joining.merges(a, b | dict(query_start=68, query_end=167, stage=45))
    # a consensus of over twice the query: that of the better one
    far = joining.one_piece(a, b | dict(query_start=60, subj_start=900, subj_end=999))
    assert (far["subj_start"], far["subj_end"]) == (900, 999)
    rows = [{k: v for k, v in r.items() if k != "n_pieces"} | {"hit_id": k + 1, "query_remaining": 9} for k, r in enumerate([a, b, b | dict(query_start=211, query_end=300, subj_start=231, subj_end=320), b | dict(query_start=900, query_end=950)])]
    made = spark.createDataFrame([("q", 1, 2, 1.0), ("q", 2, 3, 1.0)], "query_name string, hit_id long, partner_id long, pair_score double")
    got = {x["hit_id"]: x for x in joining.merged_pieces(spark.createDataFrame(rows), made).collect()}
    assert {k: (x["query_start"], x["query_end"], x["n_pieces"]) for k, x in got.items()} == {1: (1, 300, 3), 4: (900, 950, 1)}
