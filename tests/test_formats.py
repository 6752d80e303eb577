"""Readers and writers on small files."""

import gzip

from pyspark.sql import functions as F

from strandloom.functions import scalar as S
from strandloom.sources import readers, writers


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first one\nacgt\nAC\n>two\nNNNN\n>\nGG\n")
    got = {r["seq_id"]: (r["description"], r["sequence"]) for r in readers.fasta(spark, str(p)).collect()}
    assert got == {"one": ("first one", "ACGTAC"), "two": ("", "NNNN"), "UnnamedSeq": ("", "GG")}
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">x\nAC\n")
    assert readers.fasta(spark, str(tmp_path / "b.fa.gz")).first()["sequence"] == "AC"


def test_hit_layouts():
    f = readers.parse_hit
    plus = f("  253 28.7  0.0  2.0  seq  969 1069 (23931) + L2-1 LINE/L2 457 555 (680) 3 *")
    minus = f("  253 28.7  0.0  2.0  seq  969 1069 (23931) C L2-1 LINE/L2 (680) 555 457 3")
    assert plus[8:] == ("+", "L2-1", "LINE/L2", 457, 555, 680, "3", None, "*")
    assert minus[8:] == ("C", "L2-1", "LINE/L2", 457, 555, 680, "3", None, None)
    joined = f("238 26.55 23.13 0.00 chr1 4162976 4163088 (191308883) C M#LTR/ERVK (2) 574 428 m_b3s501i17")
    assert joined[8:] == ("C", "M", "LTR/ERVK", 428, 574, 2, None, "m_b3s501i17", None)
    assert f("   SW  perc perc perc") is None and f("") is None


def test_hits_file(spark, tmp_path):
    (tmp_path / "r.out").write_text("   SW  perc\n\n 253 28.7 0.0 2.0 seq 969 1069 (23931) + L2-1 LINE/L2 457 555 (680) 3\nScore histogram:\n 100 1.0 0.0 2.0 seq 9 10 (2) + L2-1 LINE/L2 4 5 (6) 3\n")
    assert readers.hits(spark, str(tmp_path / "r.out")).count() == 1


def test_blast_tab(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("\t".join(map(str, [300, 10.0, 1.0, 2.0, "q", 5, 60, 100, "minus", "s#LINE/L1", 90, 40, 120, 9.0, 8.0, 3, 2, 1])) + "\n")
    r = readers.blast_tab(spark, str(tmp_path / "t.tsv")).first()
    assert (r["orientation"], r["subj_name"], r["subj_type"], r["subj_start"], r["subj_end"], r["subj_remaining"], r["query_remaining"]) == ("C", "s", "LINE/L1", 40, 90, 30, 40)


def test_tandem_and_embl_and_hmm(spark, tmp_path):
    (tmp_path / "t.dat").write_text("Sequence: s1 x\n\nParameters: 2\n\n10 40 2 15.5 2 100 0 62 50 50 0 0 1.0 CA CACACA\n")
    assert readers.tandem(spark, str(tmp_path / "t.dat")).first()["consensus"] == "CA"
    (tmp_path / "l.embl").write_text("ID   AluX; SV 4\nAC   DF000000001;\nDE   An Alu\nCC   Type: SINE\nCC   SubType: Alu\nSQ   Sequence 6 BP;\n     acgtac 6\n//\n")
    r = readers.embl(spark, str(tmp_path / "l.embl")).first()
    assert (r["name"], r["accession"], r["repeat_type"], r["consensus"], r["length"]) == ("AluX", "DF000000001", "SINE/Alu", "ACGTAC", 6)
    (tmp_path / "m.hmm").write_text("HMMER3/f\nNAME  M1\nACC   DF1\nLENG  90\nMAXL  150\nTH    TaxId:1; TaxName:x\n//\n")
    assert readers.hmm(spark, str(tmp_path / "m.hmm")).first()["length"] == 90


def test_fasta_wraps_and_reads_back(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT" * 30), ("b", "AC")], "seq_id string, sequence string")
    writers.fasta(seqs).select("line").coalesce(1).write.text(str(tmp_path / "o"))
    got = {r["seq_id"]: r["sequence"] for r in readers.fasta(spark, str(tmp_path / "o")).collect()}
    assert got == {"a": "ACGT" * 30, "b": "AC"}


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTRYSW", "Tymczak", "Ashcraft")], "s string, a string, b string")
    r = df.select(S.revcomp(F.col("s")).alias("rc"), S.revcomp(S.revcomp(F.col("s"))).alias("same"), S.soundex(F.col("a")).alias("a"), S.soundex(F.col("b")).alias("b"), S.unit_complexity(F.lit("ACGT")).alias("c"), S.gc_label(F.lit(43)).alias("g")).first()
    assert r["rc"] == "WSRYACGT" and r["same"] == "ACGTRYSW" and r["a"] == "T522" and r["b"] == "A261"
    assert abs(r["c"] - 4) < 1e-9 and r["g"] == "43g"
