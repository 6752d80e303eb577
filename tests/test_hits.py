"""Interval and greedy operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import chain, greedy, interval, report, sequence

SCHEMA = "hit_id long, query_name string, query_start long, query_end long, score long, div_permille long, subj_name string, orientation string, subj_type string, stage long"


def rows(n, seed=1, names=3, span=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randint(1, span)
        out.append((i, f"q{r.randrange(names)}", s, s + r.randint(5, 60), r.randint(1, 40), r.randint(0, 300), f"f{r.randrange(3)}", r.choice("+C"), r.choice(["SINE/Alu", "LINE/L1"]), r.choice([35, 40])))
    return out


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame(rows(150), SCHEMA)


def test_new_bases_are_the_union(hits):
    got = {r["query_name"]: r["n"] for r in interval.newly_covered(hits).groupBy("query_name").agg({"new_bp": "sum"}).withColumnRenamed("sum(new_bp)", "n").collect()}
    want = {}
    for r in rows(150):
        want.setdefault(r[1], set()).update(range(r[2], r[3] + 1))
    assert got == {k: len(v) for k, v in want.items()}


def test_truncated_ranges_are_disjoint(hits):
    seen = {}
    for r in interval.truncated(hits).collect():
        own = set(range(r["query_start"], r["query_end"] + 1))
        assert own and not own & seen.setdefault(r["query_name"], set())
        seen[r["query_name"]] |= own


def test_overlap_pairs_across_bins(hits):
    h = hits.select("hit_id", "query_name", "query_start", "query_end")
    got = {(r["l_hit_id"], r["r_hit_id"]) for r in interval.overlap_pairs(h, h, bin_width=7).collect()}
    d = rows(150)
    assert got == {(a[0], b[0]) for a in d for b in d if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]}


def greedy_reference(d, value):
    kept = []
    for r in sorted(d, key=lambda r: (r[1], -r[4], r[3] - r[2], r[2], r[0])):
        n = r[3] - r[2] + 1
        if all(greedy.half_even_percent(n - (min(r[3], k[3]) - max(r[2], k[2]) + 1), n) > 100 - value for k in kept if k[1] == r[1] and k[2] <= r[3] and k[3] >= r[2]):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("value", [30, 80, 98])
def test_mask_level(hits, value):
    got = {r["hit_id"] for r in greedy.mask_level(hits, value).collect()}
    assert got == greedy_reference(rows(150), value)
    assert greedy.mask_level(hits, 101) is hits


def test_mask_level_worked_example(spark):
    d = [(0, "s", 1005, 2604, 14859), (1, "s", 1, 1000, 9105), (2, "s", 907, 1103, 1819), (3, "s", 1100, 1200, 300)]
    df = spark.createDataFrame([(*r, 0, "f", "+", "LINE/L1", 35) for r in d], SCHEMA)
    assert {r["hit_id"] for r in greedy.mask_level(df, 98).collect()} == {0, 1, 2}
    assert {r["hit_id"] for r in greedy.mask_level(df, 30).collect()} == {0, 1}


@pytest.mark.parametrize("mode", list(greedy.MODES))
def test_resolved_hits_are_disjoint(hits, mode):
    seen = {}
    for r in greedy.resolve_overlaps(hits, mode).collect():
        own = set(range(r["query_start"], r["query_end"] + 1))
        assert own and not own & seen.setdefault(r["query_name"], set())
        seen[r["query_name"]] |= own


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (4, 20)]
    got = {r["id"]: r["component"] for r in chain.components(spark.createDataFrame(edges, "hit_id long, partner_id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 21: 1, 22: 1, 10: 10, 11: 10}


def test_empty_hits(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert greedy.mask_level(none, 80).count() == 0 and interval.gaps(none).count() == 0 and report.class_coverage(none).count() == 0


def test_masking_masks_the_union(spark):
    seqs = spark.createDataFrame([(7, "ACGT" * 20), (8, "A" * 30)], "seq_id long, sequence string")
    h = spark.createDataFrame([(0, "7", 5, 10), (1, "7", 8, 12), (2, "7", 70, 200)], "hit_id long, query_name string, query_start long, query_end long")
    got = {r["seq_id"]: r["masked"] for r in sequence.masked(seqs, h).collect()}
    assert got[8] == "A" * 30 and got[7] == ("ACGT" * 20)[:4] + "N" * 8 + ("ACGT" * 20)[12:69] + "N" * 11


def test_fragments_cover_every_base(spark):
    seqs = spark.createDataFrame([(1, 130_001), (2, 60_000), (3, 5)], "seq_id long, length long")
    got = {}
    for r in sequence.fragments(seqs).orderBy("seq_id", "frag_no").collect():
        got.setdefault(r["seq_id"], []).append((r["start_pos"], r["end_pos"]))
    assert got[2] == [(1, 60_000)] and got[3] == [(1, 5)]
    assert got[1][0][0] == 1 and got[1][-1][1] == 130_001
    assert all(a[1] - b[0] + 1 == 2000 for a, b in zip(got[1], got[1][1:]))


def test_tail_level_on_a_long_island(spark):
    import random

    r = random.Random(4)
    rows = [(k, "q", a := r.randrange(1, 20_000), a + r.randrange(3000), r.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, query_end long, score long")
    for value in (30, 80):
        kept = []
        for k, _, a, b, _ in sorted(rows, key=lambda x: (-x[4], x[3] - x[2], x[2], x[0])):
            if all(100 * (max(0, c - a) + max(0, b - d)) >= (100 - value) * (b - a + 1) for _, c, d in kept if c <= b and d >= a):
                kept.append((k, a, b))
        assert {x["hit_id"] for x in greedy.tail_level(df, value).collect()} == {k for k, _, _ in kept}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_islands_of_many_sequences_share_a_call(spark):
    """No frame for each sequence, and the same rows where a batch ends within an island."""
    r = random.Random(5)
    rows = [(k, f"q{k % 40}", s, s + r.randrange(10, 60), r.randrange(100), r.randrange(300), f"f{k % 2}", "+") for k in range(800) for s in [r.randrange(1, 900)]]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, query_end long, score long, div_permille long, subj_name string, orientation string").withColumn("subj_type", F.lit("LINE/L1"))
    ways = {"mask": lambda h: greedy.mask_level(h, 80), "tail": lambda h: greedy.tail_level(h, 80), "arrival": lambda h: greedy.arrival_level(h, 80), "merge": greedy.merge_chains} | {m: lambda h, m=m: greedy.resolve_overlaps(h, m) for m in greedy.MODES}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    try:
        for way in ways.values():
            assert "FlatMapGroupsInPandas" not in plan_of(way(df))
            whole = sorted(map(tuple, way(df).collect()))
            spark.conf.set(key, 3)
            assert sorted(map(tuple, way(df).collect())) == whole
            spark.conf.set(key, held)
    finally:
        spark.conf.set(key, held)


def test_a_null_family_is_merged_and_kept(spark):
    rows = [(1, "q", 1, 100, 10, 50, None, "+"), (2, "q", 50, 150, 20, 50, None, "+"), (3, "q", 90, 200, 30, 50, "f", "+")]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, query_end long, score long, div_permille long, subj_name string, orientation string")
    assert sorted((x.hit_id, x.query_start, x.query_end, x.score) for x in greedy.merge_chains(df).collect()) == [(1, 1, 150, 20), (3, 90, 200, 30)]
