"""Reports with alignments, read in ranges of any size."""

import gzip

from pyspark.sql import functions as F

from strandloom.sources import reports, writers

TEXT = """Assumed background gc level in scoring matrix is 43 %

  253 28.70 0.00 2.00 seq 969 978 (23931) L2#LINE/L2 457 465 (680) m_b1s2i3

  seq                   969 ACGT-ACGTA 977
                               i -
  L2#LINE/L2            457 ACATTACG-A 465

Matrix = some/where/25p43g.matrix
Kimura (with divCpGMod) = 16.31
CpG sites = 12, Kimura (unadjusted) = 21.50
Transitions / transversions = 1.50 (3/2)
Gap_init rate = 0.10 (1 / 10), avg. gap size = 1.00 (1 / 1)

  238 26.55 23.13 0.00 chr1 11 18 (30) C M#LTR/ERVK (2) 574 567

C chr1                   18 AACC 15
  M#LTR/ERVK            567 AACN 570

C chr1                   14 GRTT 11
  M#LTR/ERVK            571 GATT 574

Gap_init rate = 0.00 (0 / 8)

  100 1.00 0.00 2.00 seq 9 10 (2) + Alu SINE/Alu 4 5 (6) 3
  101 1.00 0.00 2.00 seq 19 20 (2) + Alu SINE/Alu 4 5 (6) 4
"""
AFTER = "Score histogram:\n  900 1.00 0.00 2.00 seq 9 10 (2) + Alu SINE/Alu 4 5 (6) 3\n"


def found(spark, path, *width):
    return sorted(tuple(r.asDict()[c] for c in ("score", "subj_start", "query_string", "subj_string", "matrix", "kimura", "kimura_raw", "cpg_sites", "transitions", "transversions")) for r in reports.alignments(spark, str(path), *width).collect())


WANT = sorted([
    (253.0, 457, "ACGT-ACGTA", "ACATTACG-A", "25p43g.matrix", 16.31, 21.5, 12, 3, 2),
    (238.0, 567, "AAYCGGTT", "AATCNGTT", None, None, None, None, None, None),
    (100.0, 4, *[None] * 8), (101.0, 4, *[None] * 8),
])


def test_any_range_gives_the_same_records(spark, tmp_path):
    p = tmp_path / "r.align"
    p.write_text(TEXT + AFTER)
    for width in (1 << 20, len(TEXT) // 16, 29):
        assert found(spark, p, width) == WANT
    with gzip.open(tmp_path / "r.gz", "wt") as f:
        f.write(TEXT)
    assert found(spark, tmp_path / "r.gz", 29) == WANT
    # a folder stands for its files, an empty one gives nothing
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "none.align").write_text("")
    assert found(spark, tmp_path / "empty") == []
    assert len(found(spark, tmp_path, 100)) == 2 * len(WANT)


def test_every_start_of_a_range_is_a_border(tmp_path):
    # records of all two-range cuts, without a session
    p = tmp_path / "r.align"
    p.write_text(TEXT)
    whole = [r.values("f") for r in reports.ReportReader.records(reports.Range(str(p), 0, None))]
    size = len(TEXT.encode())
    for cut in range(1, size):
        parts = [reports.Range(str(p), 0, cut), reports.Range(str(p), cut, size)]
        assert [r.values("f") for part in parts for r in reports.ReportReader.records(part)] == whole, cut


def test_rendered_records_read_back(spark, tmp_path):
    rows = [
        (1, 300, "q1", 5, "+", "AluY", "SINE/Alu", 10, "ACGT-" * 25 + "TTA", "AC-TA" * 25 + "TCA"),
        (2, 400, "q2", 900, "C", "L1", "LINE/L1", 7, "AC", "-C"),
        (3, 500, "q2", 990, "C", "L1", "LINE/L1", 8, "", ""),
        (4, 600, "q3", 1, "+", "L1", "LINE/L1", 8, None, None),
    ]
    df = spark.createDataFrame(rows, "hit_id long, score long, query_name string, query_start long, orientation string, subj_name string, subj_type string, subj_start long, query_string string, subj_string string")
    df = df.withColumns({c: F.lit(10) for c in ("div_permille", "del_permille", "ins_permille", "stage", "subj_remaining")})
    df = df.withColumns({"query_end": F.col("query_start") + 103, "subj_end": F.col("subj_start") + 102, "matrix": F.lit("m"), "kimura": F.lit(1.25), "transitions": F.lit(4), "transversions": F.lit(5)})
    text = {r["hit_id"]: r["line"] for r in writers.alignment_records(df).collect()}
    lines = text[1].splitlines()
    # 128 columns in rows of 50, 50 and 28; places count letters
    assert [x.split()[-1] for x in lines if x.startswith("  q1")] == ["44", "84", "107"] and [x.split()[1] for x in lines if x.startswith("  AluY")] == ["10", "50", "90"]
    assert lines[3][lines[2].index("ACGT") :] == "  - -" * 10
    assert lines[11][lines[10].index("ACGT") :] == "  - -" * 5 + " i "
    back = [x.split() for x in text[2].splitlines() if x.startswith("C ")]
    assert back == [["C", "L1", "109", "-C", "109"]]
    writers.alignment_records(df).select("line").write.text(str(tmp_path / "o"))
    for width in (1 << 20, 64):
        got = {r["lineage_id"]: (r["query_string"], r["subj_string"], r["matrix"], r["kimura"]) for r in reports.alignments(spark, str(tmp_path / "o"), width).collect()}
        assert got == {f"m_b1s10i{r[0]}": (r[8] or "", r[9] or "", "m", 1.25) for r in rows}
