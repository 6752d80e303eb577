"""What must not grow faster than the input: groups, ranges, widths of what is dealt; and the results beside it."""

import random
from collections import Counter

import pyarrow as pa

from strandloom.operators import folds, joining, pair_scores as P, sequence
from strandloom.plans import joining_queries, sequence_queries
from strandloom.sources.reports import RANGES, ReportReader

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_slices_of_many_sequences_share_a_call(spark):
    """As lists and as tables, and where batches end within a slice."""
    r = random.Random(3)
    rows = [(k, f"q{k % 30}" if k % 30 else None, r.randrange(300_000), k % 7) for k in range(400)]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, v long").selectExpr("*", "query_start AS query_end", "1 AS score")
    placed = folds.in_slices(folds.numbered_rows(df), 0, 9)

    def plain(t, held):
        out = []
        for v in t["v"]:
            held = 0 if v == 0 else held + v
            out.append(held)
        return {"hit_id": t["hit_id"], "got": out}, held

    def table(t, held):
        out, held = plain(t.sort_by("rank").to_pydict(), held)
        return pa.table(out), held

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 4)
    try:
        got = [sorted(map(tuple, folds.fold(placed, step, "hit_id long, got long", 0, plain=c).collect())) for step, c in ((plain, ["hit_id", "v"]), (table, None))]
    finally:
        spark.conf.set(key, before)
    want = []
    for q in {x[1] for x in rows}:
        held = 0
        for k, _, _, v in sorted((x for x in rows if x[1] == q), key=lambda x: (x[2], x[0])):
            held = 0 if v == 0 else held + v
            want.append((k, held))
    assert got == [sorted(want)] * 2


def test_pairs_are_not_dealt_by_names(spark):
    plan = plan_of(joining.candidates(joining_queries.pieces(spark, SF), joining_queries.allowed(spark)))[1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("l_name" in line for line in dealt) and "l_rank" not in "".join(line for line in plan.splitlines() if "Window [max(CASE" in line)


def test_ranges_of_a_report_are_bounded(tmp_path):
    place = tmp_path / "report"
    with open(place, "wb") as f:
        f.truncate(64 << 20)
    parts = ReportReader({"path": str(place), "range_bytes": "64"}).partitions()
    assert len(parts) <= RANGES + 1 and parts[0].start == 0 and parts[-1].end == 64 << 20 and all(a.end == b.start for a, b in zip(parts, parts[1:]))


def test_of_equal_ranges_the_better_hit_comes_first(spark):
    rows = [(1, "q", 10, 90, 5), (2, "q", 10, 90, 9), (3, "q", 100, 190, 7)]
    df = spark.createDataFrame(rows, "hit_id long, query_name string, query_start long, query_end long, score long").selectExpr("*", "'LINE/L1' AS subj_type")
    found = P.pairs(df, 1, {"id": "hit_id"}, folds.order_of_hits())
    assert sorted((x.l_id, x.r_id) for x in found.collect()) == [(1, 3), (2, 1)]


def test_grams_meet_before_they_are_dealt(spark):
    logical = plan_of(sequence_queries.contaminant_passages(spark, SF))[0]
    assert logical[logical.index("Join") :].count("Aggregate") == 1


def test_places_are_counted_within_a_sequence(spark):
    texts = ["THEN" * 30, "\U0001f600ANéTT" * 5, "AB", None, "A\x00NTHT"]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")
    found = sequence.kmer_hits(seqs, [0, 1, 3], spark.createDataFrame([("THN",), ("ANT",), ("A\x00T",)], "seed string"))
    assert "Generate" not in plan_of(found)[0]
    want = {}
    for i, s in enumerate(texts):
        n = sum(v for g, v in Counter(s[k] + s[k + 1] + s[k + 3] for k in range(len(s or "") - 3)).items() if g in ("THN", "ANT", "A\x00T")) if s else 0
        want |= {i: n} if n else {}
    assert {x.seq_id: x.n for x in found.collect()} == want


def test_streams_are_not_held_by_the_driver(spark):
    from strandloom.plans import format_queries

    found = format_queries.stream_sessions(spark, SF)
    assert "LocalTableScan" not in plan_of(found)[1] and "FileScan parquet" in plan_of(found)[1]
