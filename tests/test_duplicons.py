"""Duplicons: seeds clustered, widened and grouped, by hand-worked cases and a plain walk."""

import random

import pytest

from strandloom.operators import duplicons as D

SEED = dict(query_name="q", query_remaining=50_000, orientation="+", subj_name="D1", subj_start=1, subj_end=100, subj_remaining=2000, score=500, div=5.0)


def seeds(spark, rows):
    return spark.createDataFrame([SEED | {"hit_id": k + 1} | r for k, r in enumerate(rows)])


def repeats(spark, rows):
    return spark.createDataFrame([("q", a, b, k) for k, (a, b) in enumerate(rows)], "query_name string, query_start long, query_end long, hit_id long")


def of(df):
    return {x["hit_id"]: x["cluster"] for x in df.collect()}


def test_seeds_cluster_along_the_consensus(spark):
    one = dict(query_start=1000, query_end=1100)
    # 30 bases of the consensus shared are too many, 29 are not; the place is that of the first seed
    later = [dict(query_start=1200, query_end=1300, subj_start=s, subj_end=s + 100) for s in (70, 71)]
    assert of(D.clustered(seeds(spark, [one, later[0]]))) == {1: 1, 2: 2} and of(D.clustered(seeds(spark, [one, later[1]]))) == {1: 1, 2: 1}
    # reach: what the consensus lacks and 7,000
    far = [dict(query_start=q, query_end=q + 50, subj_start=200, subj_end=250) for q in (10_100, 10_101)]
    assert of(D.clustered(seeds(spark, [one, far[0]]))) == {1: 1, 2: 1} and of(D.clustered(seeds(spark, [one, far[1]]))) == {1: 1, 2: 2}
    # turned, the consensus runs back; other strands and names are other families
    back = dict(orientation="C", subj_start=500, subj_end=600)
    behind = dict(query_start=1200, query_end=1300)
    assert of(D.clustered(seeds(spark, [one | back, behind | back | dict(subj_start=400, subj_end=480)]))) == {1: 1, 2: 1}
    assert of(D.clustered(seeds(spark, [one | back, behind | back | dict(subj_start=600, subj_end=700)]))) == {1: 1, 2: 2}
    assert of(D.clustered(seeds(spark, [one, behind | dict(subj_start=200, subj_name=None), behind | back]))) == {1: 1, 2: 2, 3: 3}
    # repeated rows are seeds each, null scores none
    assert of(D.clustered(seeds(spark, [one, one]))) == {1: 1, 2: 2}
    assert D.kept_seeds(seeds(spark, [one, one | dict(score=299), one | dict(div=10.0), one | dict(score=None)]), 10).count() == 1
    assert D.ranges(D.widened(D.clusters(seeds(spark, [one]).limit(0)), repeats(spark, [(1, 2)]).limit(0)).checkpoint()).collect() == []


@pytest.mark.parametrize("slice_rows", [5, 1000])
def test_clusters_are_those_of_a_plain_walk(spark, slice_rows):
    r = random.Random(slice_rows)
    rows = []
    for _ in range(250):
        a, s, c = r.randrange(1, 300_000), r.randrange(1, 900), r.random() < 0.4
        rows.append(dict(query_start=a, query_end=a + r.randrange(20, 200), subj_start=s, subj_end=s + r.randrange(20, 200), subj_remaining=r.randrange(900), orientation="C" if c else "+", subj_name=r.choice(["D1", "D2"])))
    want = {}
    left = sorted(({"hit_id": k + 1} | x for k, x in enumerate(rows)), key=lambda x: (x["query_start"], -x["query_end"], x["hit_id"]))
    while left:
        head, rest, end = left[0], [], left[0]["query_end"]
        want[head["hit_id"]] = head["hit_id"]
        turned = head["orientation"] == "C"
        for x in left[1:]:
            shared = x["subj_end"] - head["subj_start"] if turned else head["subj_end"] - x["subj_start"]
            same = x["orientation"] == head["orientation"] and x["subj_name"] == head["subj_name"]
            if same and shared < 30 and x["query_start"] - end <= (head["subj_start"] if turned else head["subj_remaining"]) + 7000:
                want[x["hit_id"]], end = head["hit_id"], x["query_end"]
            else:
                rest.append(x)
        left = rest
    assert of(D.clustered(seeds(spark, rows), slice_rows)) == want
    assert len(set(want.values())) < len(want)


def bounds(spark, rows, reps):
    wide = D.widened(D.clusters(seeds(spark, rows)), repeats(spark, reps))
    return {x["hit_id"]: (x["range_start"], x["range_end"], x["is_orphan"]) for x in wide.collect()}


def test_ranges_end_at_blocks_without_repeats(spark):
    seed = dict(query_start=5000, query_end=5100, subj_start=1000, subj_end=1100, subj_remaining=1000)
    # no repeats: as far as the consensus reaches, not beyond the sequence
    assert bounds(spark, [seed], []) == {1: (4001, 6100, False)}
    assert bounds(spark, [seed | dict(query_remaining=300)], []) == {1: (4001, 5400, False)}
    # a block counts with both its ends: 4,400 to 4,700 holds 301 bases, 4,401 to 4,700 holds 300
    assert bounds(spark, [seed], [(4300, 4400), (4700, 5000)]) == {1: (4700, 6100, False)}
    assert bounds(spark, [seed], [(4300, 4401), (4700, 5000)]) == {1: (4001, 6100, False)}
    # on the right the first of two
    assert bounds(spark, [seed], [(5000, 5200), (5501, 5550), (5900, 6000)]) == {1: (4001, 5200, False)}
    # both blocks beside the seed: an orphan; a block around a whole flank ends nothing
    assert bounds(spark, [seed], [(4100, 4200), (5000, 5100), (5600, 5700)]) == {1: (5000, 5100, True)}
    assert bounds(spark, [seed], [(3000, 3900), (5200, 5300)]) == {1: (4001, 6100, False)}


def test_ranges_group_clusters_and_take_orphans(spark):
    at = lambda a, b, o, name="D1", k=0: ("q", name, 1, k, a, b, a, b, o)
    rows = [at(100, 900, False), at(500, 600, False, "D2", 1), at(600, 800, False, "D1", 2), at(801, 950, False, "D3", 3), at(650, 700, True, "D4", 4), at(940, 960, True, "D5", 5)]
    wide = spark.createDataFrame(rows, "query_name string, subj_name string, n_seeds long, hit_id long, query_start long, query_end long, range_start long, range_end long, is_orphan boolean")
    got = sorted(tuple(x) for x in D.ranges(wide).collect())
    # a run ends where a cluster begins behind the one before it, though an earlier one reaches further
    assert got == [("q", 100, 900, "D1", 2, 2), ("q", 100, 900, "D2", 1, 1), ("q", 100, 900, "D4", 1, 1), ("q", 801, 950, "D3", 1, 1)]
