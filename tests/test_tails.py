"""Poly-A tails, by cases worked out by hand and by slices of several sizes."""

import random

import pytest

from strandloom.operators import tails

ALU = dict(query_name="q", subj_name="AluY", orientation="+", query_start=100, query_end=380, subj_start=1, subj_end=280, subj_remaining=31, score=2000)
TAIL = dict(query_name="q", subj_name="(A)n", orientation="+", query_start=383, query_end=440, subj_start=1, subj_end=50, subj_remaining=0, score=200)
TURNED = ALU | dict(orientation="C", query_start=500, query_end=780)
AHEAD = TAIL | dict(subj_name="(T)n", query_start=450, query_end=497)


def hits(spark, rows):
    schema = "query_name string, query_start long, query_end long, score long, orientation string, subj_name string, subj_start long, subj_end long, subj_remaining long, hit_id long, left_id long, right_id long"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(({"hit_id": k + 1, "left_id": None, "right_id": None} | r)[n] for n in names) for k, r in enumerate(rows)], schema)


def got(spark, *rows, slice_rows=1000):
    return sorted(tuple(x)[:5] for x in tails.attachments(hits(spark, rows), slice_rows).collect())


def made(*rows):
    """As got(), by the plain function over one list each side."""
    rows = [{"hit_id": k + 1, "left_id": None, "right_id": None} | r for k, r in enumerate(rows)]
    tail = next(r for r in rows if r["subj_name"][0] in "(AT" and r["subj_name"] != "AluY")
    at = rows.index(tail)
    found = tails.attach(tail, rows[:at][::-1], rows[at + 1 :])
    return found and (found[0]["hit_id"], found[1] and found[1]["hit_id"], *found[2:])


def test_tails_before_and_behind():
    assert made(ALU, TAIL) == (1, None, 100, 440) and made(AHEAD, TURNED) == (2, None, 450, 780)
    # 3 bases apart, not 4
    assert made(ALU, TAIL | dict(query_start=384)) is None and made(AHEAD | dict(query_end=496), TURNED) is None
    # 32 bases of an Alu may lack, 25 of others; a tail reaches less than 30 beyond them
    assert made(ALU | dict(subj_remaining=33), TAIL) is None and made(ALU | dict(subj_remaining=32), TAIL) is not None
    assert made(ALU | dict(subj_name="L1PA3", subj_remaining=26), TAIL | dict(query_end=430)) is None and made(ALU | dict(subj_name="L1PA3", subj_remaining=25), TAIL | dict(query_end=430)) is not None
    assert made(ALU, TAIL | dict(query_end=443)) is not None and made(ALU, TAIL | dict(query_end=444)) is None
    # names and strands
    for name, fits in (("(CAAA)n", True), ("(CAA)n", False), ("A-rich", True), ("(T)n", False), ("(CA)n", False)):
        assert (made(ALU, TAIL | dict(subj_name=name)) is not None) == fits, name
    assert made(ALU | dict(orientation="C"), TAIL) is None and made(ALU | dict(subj_name="MIR3"), TAIL) is None
    # SVA only forward
    assert made(ALU | dict(subj_name="SVA", subj_remaining=20), TAIL | dict(query_end=420)) is not None and made(AHEAD, TURNED | dict(subj_name="SVA", subj_remaining=20)) is None
    # four hits back, not five
    other = ALU | dict(subj_name="MIR3", query_start=200, query_end=300)
    assert made(ALU, *[other] * 3, TAIL) == (1, None, 100, 440) and made(ALU, *[other] * 4, TAIL) is None


def test_pieces_cut_by_their_tail():
    piece = ALU | dict(query_start=442, query_end=475, subj_start=281, subj_end=311, subj_remaining=0)
    assert made(ALU | dict(right_id=3), TAIL, piece) == (1, 3, 100, 475)
    # of another score, too long, too far, not the hit beside: linked onwards, so no tail
    for change in (dict(score=1999), dict(subj_end=321), dict(query_start=445)):
        assert made(ALU | dict(right_id=3), TAIL, piece | change) is None
    assert made(ALU | dict(right_id=9), TAIL, piece) is None
    back = piece | dict(orientation="C", query_start=420, query_end=448)
    assert made(back, AHEAD, TURNED | dict(left_id=1)) == (3, 1, 420, 780)


def test_elements_take_their_tails(spark):
    more = TAIL | dict(query_start=441, query_end=465)
    rows = {x["hit_id"]: x for x in tails.with_tails(hits(spark, [ALU, TAIL, more, AHEAD | dict(query_start=470), TURNED, TURNED | dict(query_name="r")])).collect()}
    assert sorted(rows) == [1, 5, 6]
    # a second tail, within 30 bases of the end
    assert [rows[1][c] for c in ("query_start", "query_end", "subj_end", "subj_remaining", "n_tails")] == [100, 465, 311, 0, 2]
    assert [rows[5][c] for c in ("query_start", "query_end", "subj_end", "subj_remaining", "n_tails")] == [470, 780, 311, 0, 1]
    assert rows[6]["n_tails"] == 0
    assert got(spark, ALU | dict(subj_name=None), TAIL | dict(query_end=None)) == [] and tails.with_tails(hits(spark, [ALU]).limit(0)).collect() == []


def test_slices_do_not_matter(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        start, kind = r.randrange(1, 3000), r.choice([ALU, TAIL, TURNED, AHEAD])
        rows.append(kind | dict(query_start=start, query_end=start + r.randrange(15, 80), subj_remaining=r.randrange(35), subj_end=r.randrange(2, 40), score=r.choice([200, 300])))
    for k in range(0, 290, 4):
        rows[k]["right_id"], rows[k + 3]["left_id"] = k + 4, k + 1
    whole = got(spark, *rows)
    assert len(whole) > 20
    assert got(spark, *rows, slice_rows=9) == whole == got(spark, *rows, slice_rows=50)
