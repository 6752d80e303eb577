"""Filter interaction audit: what each filter removes in every order of the filters.

Five filters judge a text; a failure is a bit of its mask:

A: fewer than 200 words; B: 100 * distinct words < 50 * words; C: 100 * letters A-Z > 3 * code points; D: it holds one of
`#$%&*|`; E: its text is that of a smaller doc_id, whatever else happens to that document.

Documents are counted by part and mask, so that all that follows is as small as the masks are few: 32 a part. Each cell is
unpivoted against the steps of all orders; a running bit-or over the steps before tells which failures came earlier;
conditional sums give each step's numbers, and a total over a filter's rows in all orders gives its Shapley sum.

Defined cases: a null text is empty; a null lang is the part ''; texts are compared by 128 bits of their digest; a null
doc_id is larger than all others, and rows that share an id are no copies of one another, only of smaller ids; labels that
share a doc_id count together (1 if any is 1), null or missing labels are not 1; other columns don't matter; an empty table
of documents gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import leaves_no_memory, slices, stored
from strandloom.llm.words import Words, text_bytes

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SLICE_BYTES = 1 << 20
CAPITAL, SPECIAL, POINT = (np.zeros(256, bool) for _ in range(3))
CAPITAL[ord("A") : ord("Z") + 1] = True
SPECIAL[list(b"#$%&*|")] = True
POINT[:] = (np.arange(256) & 0xC0) != 0x80


def text_masks(texts: pa.Array) -> np.ndarray:
    """The bits of A to D for each text."""
    data, at = text_bytes(texts)
    per_text = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[data])])[at])
    words = Words.of(texts)
    n = np.diff(words.borders)
    code, distinct = words.encoded()
    key = np.sort(words.owner() * np.int64(max(1, len(distinct))) + code)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    kinds = np.bincount(key[new] // max(1, len(distinct)), minlength=len(n))
    fails = [n < 200, 100 * kinds < 50 * n, 100 * per_text(CAPITAL) > 3 * per_text(POINT), per_text(SPECIAL) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, d1, d2: the text's digest, n) of all documents; rows that are equal in all are one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, SLICE_BYTES):
            texts = batch.column(2)
            digest = np.frombuffer(b"".join(hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts.to_pylist()), np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(text_masks(texts).astype(np.int32)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "d1", "d2"])

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, mask int, d1 long, d2 long")
    return rows.groupBy("doc_id", "part", "mask", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of A to E, n, good, toxic): documents, those of quality 1 and toxic ones, by part and mask."""
    rows = stored(judged(docs), "judged")
    is_one = lambda c: F.coalesce(F.max(F.coalesce(F.col(c) == 1, F.lit(False))), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(is_one("quality"), is_one("toxic"))
    known = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    no = F.lit(None).cast("boolean")
    known = known.unionByName(rows.where("doc_id is null").withColumns({"quality": no, "toxic": no})).fillna(False, ["quality", "toxic"])
    # of each text in each group: how many, the least id, and how many rows have that
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    groups = known.groupBy("d1", "d2", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), least.alias("least"))
    first = F.min(F.struct("least.none", "least.doc_id")).over(Window.partitionBy("d1", "d2"))
    groups = groups.withColumn("own", F.when(F.struct("least.none", "least.doc_id").eqNullSafe(first), F.col("least.n")).otherwise(0))
    sides = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    split = groups.select("part", "quality", "toxic", F.inline(sides)).where("n > 0")
    if_ = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), if_("quality").alias("good"), if_("toxic").alias("toxic"))


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step; found: cells()."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    long = found.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    long = long.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    bit = F.expr(f"shiftleft(1, instr('{filters}', letter) - 1)")
    long = long.withColumn("bit", bit).withColumn("fail", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fail").over(before), F.lit(0)))
    gone, late = (F.col("fail") != 0) & (F.col("earlier") == 0), (F.col("fail") != 0) & (F.col("earlier") != 0)
    total = lambda what, n="n": F.sum(F.when(what, F.col(n)).otherwise(0))
    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total((F.col("fail") == 0) & (F.col("earlier") == 0)).alias("kept"), total(gone).alias("removed"), total(late).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(gone, "good").alias("good_lost"), total(gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return steps.withColumn("shapley", shapley).drop("letter")


def audit_sql() -> str:
    tests = {
        "A": "len(ws) < 200", "B": "100 * len(list_distinct(ws)) < 50 * len(ws)", "C": "100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t)",
        "D": "regexp_matches(t, '[#$%&*|]')", "E": "doc_id > min(doc_id) OVER (PARTITION BY t)",
    }
    fails = ", ".join(f"({test}) AS {name}" for name, test in tests.items())
    sums = ", ".join(f"CAST(count(*) FILTER ({what}) AS BIGINT) AS {name}" for name, what in {
        "kept": "NOT f AND NOT earlier", "removed": "f AND NOT earlier", "redundant": "f AND earlier", "unique_fails": "f AND fails = 1",
        "good_lost": "f AND NOT earlier AND quality = 1", "toxic_lost": "f AND NOT earlier AND toxic = 1",
    }.items())
    return f"""
WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, {fails} FROM d),
u AS (SELECT part, quality, toxic, {{'A': A, 'B': B, 'C': C, 'D': D, 'E': E}} AS s, A::INT + B::INT + C::INT + D::INT + E::INT AS fails FROM m LEFT JOIN labels USING (doc_id)),
g AS (SELECT part, quality, toxic, s, fails, filter_order, unnest(range(1, 6)) AS step FROM u, o),
k AS (SELECT part, quality, toxic, fails, filter_order, step, filter_order[step] AS letter, map_extract(map(['A', 'B', 'C', 'D', 'E'], [s.A, s.B, s.C, s.D, s.E]), filter_order[step])[1] AS f,
  list_bool_or(list_transform(string_split(filter_order[:step - 1], ''), lambda y: CASE y WHEN 'A' THEN s.A WHEN 'B' THEN s.B WHEN 'C' THEN s.C WHEN 'D' THEN s.D WHEN 'E' THEN s.E ELSE false END)) AS earlier FROM g),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, {sums} FROM (SELECT * REPLACE (coalesce(earlier, false) AS earlier) FROM k) GROUP BY ALL)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
