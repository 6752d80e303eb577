"""Sequence queries over whole texts against plain Python."""

import re

import pytest

from strandloom.functions import alignment as A, scalar as S
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def letters(spark):
    """Of each document the letters of its sequence."""
    lower = {c: c - 32 for c in range(97, 123)}
    return {r["doc_id"]: r["text"].translate(lower) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_reverse_complements_of_whole_sequences(spark, letters):
    for name, to in (("rc", S.COMPLEMENT), ("legacy_rc", S.LEGACY_COMPLEMENT)):
        want = {i: s.translate(str.maketrans(S.LETTERS, to))[::-1] for i, s in letters.items()}
        assert {r["seq_id"]: r[name] for r in rows(spark, "reverse_complements")} == want
    assert max(map(len, letters.values())) > 200


def test_pairs_of_whole_texts(spark):
    dna = {r["item_id"]: "".join("ACGT"[(ord(c) - 65) % 4] for c in re.sub("[^A-Za-z]", "", r["text"]).upper()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pairs = {i: (q[: len(dna[i + 1])], dna[i + 1][: len(q)]) for i, q in dna.items() if i + 1 in dna}
    assert max(len(q) for q, _ in pairs.values()) > 60
    assert {r["item_id"]: r["caf"] for r in rows(spark, "pair_encoding")} == {i: A.caf_encode(*p) for i, p in pairs.items()}
    got = {r["item_id"]: r for r in rows(spark, "pair_divergence")}
    assert got.keys() == pairs.keys()
    for i, p in pairs.items():
        want = A.kimura(*p)
        assert (got[i]["transversions"], got[i]["bases"], got[i]["cpg_sites"]) == (want.transversions, want.bases, want.cpg_sites)
        assert got[i]["percent"] == pytest.approx(want.percent) and got[i]["transitions"] == pytest.approx(want.transitions)


def test_batch_gc_of_all_fragments(spark, letters):
    from strandloom.plans import sequence_queries

    want = {}
    for r in sequence_queries._batches(spark, SF).collect():
        piece = letters[r["seq_id"]][r["start_pos"] - 1 : r["end_pos"]]
        gc, bp = want.get((r["part"], r["batch_num"]), (0, 0))
        want[r["part"], r["batch_num"]] = gc + piece.count("G") + piece.count("C"), bp + len(piece)
    assert {(r["part"], r["batch_num"]): (r["gc"], r["bp"]) for r in rows(spark, "batch_gc")} == want
    assert {(r["part"], r["batch_num"]): r["bp"] for r in rows(spark, "sequence_batches")} == {k: bp for k, (_, bp) in want.items()}
