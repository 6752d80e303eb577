"""Substring dedup: words in passages that came before are removed, found by difference-cover anchors.

A window is WINDOW words in a row of one document. The word at place p of a document is in the cover if p mod PERIOD is in
COVER, a set whose differences are all residues modulo PERIOD. So for two places i and j of any two documents there is a
k < PERIOD for which i + k and j + k both are in the cover. Hence two equal windows share an anchor: the ANCHOR = WINDOW -
PERIOD + 1 words from such a place on. Anchors are hashed at cover places only (3 of 7 words), and all other words are
never compared with anything unless an anchor beside them repeats.

Texts lie in slices (some MB of texts, or one long text), each a row of compressed bytes. Five steps, each of which moves a
few bytes a word:

1. Each slice sends its distinct anchor hashes to buckets by hash (twice, if they repeat inside the slice).
2. A bucket answers each slice with those that stand in more than one place. Both know a hash by 32 bits; two anchors that
   share them are a needless candidate and no more.
3. A slice extends each such anchor to the windows that hold it, and names every window by 80 bits of its words' hashes and
   the number of its bucket. Of equal windows in the slice all but the first are to be removed; the first goes to its bucket.
4. A bucket answers with the windows that are not the first of their name.
5. A slice removes the words that those windows and its own later ones cover.

So of a passage that comes a million times, a slice sends one anchor and one window; no task holds all places of a key,
and no pairs are made. Buckets and slices grow with the input up to fixed bounds. Steps 3 and 5 both work out the slice's
windows: that costs less than to keep them.

Defined cases: windows are judged on the input, so what is removed still counts as earlier. Earlier is the smaller doc_id,
or the smaller place in the same document; ids of null come after all others and are one id; of rows that share an id none
is before the other but by place, so equal rows get equal results. Ids may be of any type that can be ordered. A null text
has no words; texts of fewer than WINDOW words lose nothing; other columns of the input don't matter; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import clip, leaves_no_memory, stored, string_bytes
from strandloom.llm.near_dedup import scramble
from strandloom.llm.words import Words, text_bytes

WINDOW, PERIOD, COVER = 20, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text of a slice, and bytes of text whose anchors a bucket has: least and most, and into how many the input is cut in between.
SLICE, SLICES = (4 << 20, 32 << 20), 1 << 12
BUCKET, BUCKETS = (4 << 20, 256 << 20), 1 << 9
U = np.uint64
BASE = 0x9E3779B97F4A7C15

class Hashed:
    """The words of a slice, with sums by which the hash of any run of words is told in one step.

    A run's hash is the sum of its words' hashes times powers of an odd number, modulo 2^64; two independent ones name a window.
    """

    def __init__(self, texts: pa.Array):
        import xxhash

        self.words = words = Words.of(texts)
        code, distinct = words.encoded()
        raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct.to_pylist())), U).reshape(-1, 2)
        power = np.full(len(words), BASE, U)
        inverse = np.full(len(words), pow(BASE, -1, 1 << 64), U)
        if len(words):
            power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        power = np.multiply.accumulate(power)
        self.sums = []
        for k in (0, 1):
            sums = np.zeros(len(words) + 1, U)
            np.cumsum(raw[code, k] * power, out=sums[1:])
            self.sums.append(sums)
        sizes = np.diff(words.borders)
        self.owner = words.owner()
        self.place = np.arange(len(words)) - words.borders[:-1][self.owner]
        self.left = sizes[self.owner] - self.place  # words up to the text's end
        self.long = sizes[self.owner] >= WINDOW

    def run(self, at: np.ndarray, size: int, k: int = 0) -> np.ndarray:
        return scramble((self.sums[k][at + size] - self.sums[k][at]) * self.inverse[at])

    def anchors(self) -> np.ndarray:
        """Words at which an anchor starts."""
        return np.flatnonzero(self.long & (self.left >= ANCHOR) & np.isin(self.place % PERIOD, COVER))


def with_doubles(x: np.ndarray) -> np.ndarray:
    """Distinct values, and once more those that repeat."""
    x, n = np.unique(x, return_counts=True)
    return np.concatenate([x, x[n > 1]])


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(order by bucket, the buckets that have values, each one's span in that order)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return order, bucket[start].astype(np.int32), list(zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True)) if len(start) else []


def sliced(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """(slice, ids, sizes, data): the texts of each slice, as one compressed value."""
    import zstandard

    kind = docs.schema["doc_id"].dataType.simpleString()

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 28

        def flush():
            t = pa.Table.from_batches(held)
            data, at = text_bytes(combined(t, "text"))
            ids = combined(t, "doc_id")
            packed = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(at).tobytes()], pa.binary()), pa.array([packed], pa.binary())], ["slice", "ids", "sizes", "data"])

        for batch in batches:
            ends, at = np.cumsum(string_bytes(batch.select(["text"])) + 64), 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                end = max(at + (not held), int(np.searchsorted(ends, before + slice_bytes - size, side="right")))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(ends[end - 1]) - before
                if end < batch.num_rows:
                    yield flush()
                    held, size, number = [], 0, number + 1
                at = end
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"slice long, ids array<{kind}>, sizes binary, data binary")


def texts_of(sizes: bytes, data: bytes) -> pa.Array:
    import zstandard

    at = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(at[-1])))))


def anchors(slices: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, hashes): each slice's distinct anchors, 32 bits each."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "data")), strict=True):
                x = Hashed(texts_of(sizes, data))
                h = with_doubles(x.run(x.anchors(), ANCHOR))
                order, which, spans = by_bucket((h >> U(32)) % U(buckets))
                h = h[order].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(which), number)), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "slice", "hashes"])

    return slices.select("slice", "sizes", "data").mapInArrow(run, "bucket int, slice long, hashes binary")


def repeated(t: pa.Table) -> pa.Table:
    """Of each slice's hashes in a bucket those that stand in more than one place."""
    parts = [np.frombuffer(x, "<u4") for x in t.column("hashes").to_pylist()]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    found = []
    for x in parts:
        i = np.searchsorted(twice, x)
        x = x[twice[np.minimum(i, len(twice) - 1)] == x] if len(twice) else x[:0]
        found.append(np.unique(x).tobytes())
    return pa.table([t.column("slice"), pa.array(found, pa.binary())], ["slice", "found"]).filter(pa.array([bool(x) for x in found], pa.bool_()))


def ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids of any type, nulls last."""
    return pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def not_first(name: list[np.ndarray], rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each window has an earlier one of its name: of smaller rank of id, or equal rank and smaller place."""
    order = np.lexsort((place, rank, *name))
    rank, place = rank[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([n[order][1:] != n[order][:-1] for n in name], axis=0)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = (rank != rank[first]) | (place != place[first])
    return out


def combined(t: pa.Table, column: str) -> pa.Array:
    x = t.column(column).combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


class Windows:
    """The windows of a slice that hold a repeated anchor. found: the repeated anchors, as bytes or None."""

    def __init__(self, x: Hashed, ids: pa.Array, found: list[bytes | None]):
        at = x.anchors()
        at = at[np.isin(x.run(at, ANCHOR).astype("<u4"), joined(found, "<u4"))]
        mark = np.zeros(len(x.words), bool)
        for k in range(PERIOD):
            mark[at[x.place[at] >= k] - k] = True
        self.at = at = np.flatnonzero(mark & (x.left >= WINDOW))
        self.name, self.more = x.run(at, WINDOW, 0), x.run(at, WINDOW, 1)
        self.later = not_first([self.name, self.more], ranks(ids)[x.owner[at]], x.place[at])


def joined(parts: list[bytes | None], kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in parts if x)])


def first_windows(slices: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, names, more, ids, doc, place): of each name in a slice the first window, and the ids of the row's documents."""
    kind = slices.schema["ids"].dataType.elementType.simpleString()

    def run(key, own: pa.Table, found: pa.Table) -> pa.Table:
        x = Hashed(texts_of(own.column("sizes")[0].as_py(), own.column("data")[0].as_py()))
        ids = combined(own, "ids").flatten()
        w = Windows(x, ids, found.column("found").to_pylist())
        first = np.flatnonzero(~w.later)
        order, which, spans = by_bucket((w.more[first] >> U(20)) % U(buckets))
        first = first[order]
        at, name, more = w.at[first], w.name[first], w.more[first].astype("<u2")
        doc, place = x.owner[at].astype("<i4"), x.place[at].astype("<i4")
        docs = [np.unique(doc[a:b]) for a, b in spans]
        of = lambda v: pa.array([v[a:b].tobytes() for a, b in spans], pa.binary())
        rows = {
            "bucket": pa.array(which), "slice": pa.array(np.full(len(which), key[0].as_py())), "names": of(name), "more": of(more),
            "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, docs)]), pa.int32()), ids.take(pa.array(np.concatenate([np.empty(0, np.int64), *docs]).astype(np.int64)))), "doc": of(doc), "place": of(place),
        }
        return pa.table(rows)

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, f"bucket int, slice long, names binary, more binary, ids array<{kind}>, doc binary, place binary")


def later_windows(t: pa.Table) -> pa.Table:
    """Of each slice's windows in a bucket those that are not the first of their name."""
    parts = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
    names, more, doc, place = (parts(c, k) for c, k in (("names", U), ("more", "<u2"), ("doc", "<i4"), ("place", "<i4")))
    rank = np.split(ranks(pa.concat_arrays([c.flatten() for c in t.column("ids").chunks])), np.cumsum([len(x) for c in t.column("ids").chunks for x in c])[:-1])
    rank = [r[np.unique(d, return_inverse=True)[1]] for r, d in zip(rank, doc, strict=True)]
    later = not_first([np.concatenate(names), np.concatenate(more)], np.concatenate(rank), np.concatenate(place))
    mine = np.split(later, np.cumsum([len(x) for x in doc])[:-1])
    out = {"slice": t.column("slice"), **{c: pa.array([x[m].tobytes() for x, m in zip(v, mine, strict=True)], pa.binary()) for c, v in (("doc", doc), ("place", place))}}
    return pa.table(out).filter(pa.array([bool(m.any()) for m in mine], pa.bool_()))


def edges(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of words inside; a text's border ends a run."""
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    cuts = np.unique(borders[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    return np.sort(np.concatenate([np.flatnonzero(step > 0), cuts])), np.sort(np.concatenate([np.flatnonzero(step < 0), cuts]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, removed: spans of words from 0 as (first, n), kept: the words left, joined by spaces) of every row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slice_bytes, buckets = clip(total / SLICES, *SLICE), -(-total // clip(total / BUCKETS, *BUCKET)) or 1
    slices = stored(sliced(docs, slice_bytes), "slices")
    answers = anchors(slices, buckets).groupBy("bucket").applyInArrow(repeated, "slice long, found binary")
    later = first_windows(slices, answers, buckets).groupBy("bucket").applyInArrow(later_windows, "slice long, doc binary, place binary")
    both = answers.withColumns({c: F.lit(None).cast("binary") for c in ("doc", "place")}).unionByName(later.withColumn("found", F.lit(None).cast("binary")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key, own: pa.Table, found: pa.Table) -> pa.Table:
        x = Hashed(texts_of(own.column("sizes")[0].as_py(), own.column("data")[0].as_py()))
        words, ids = x.words, combined(own, "ids").flatten()
        w = Windows(x, ids, found.column("found").to_pylist())
        doc, place = (joined(found.column(c).to_pylist(), "<i4") for c in ("doc", "place"))
        at = np.concatenate([w.at[w.later], words.borders[doc] + place])
        step = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
        gone = np.cumsum(step[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        start, end = edges(gone, words.borders)
        span = pa.StructArray.from_arrays([pa.array(x.place[start]), pa.array(end - start)], ["first", "n"])
        out = {
            "doc_id": ids,
            "n_words": pa.array(np.diff(words.borders)),
            "n_removed": pa.array(np.diff(upto[words.borders])),
            "removed": pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.borders), pa.int32()), span),
            "kept": words.joined(~gone).cast(pa.string()),
        }
        return pa.table(out)

    return slices.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, n_words long, n_removed long, removed array<struct<first: long, n: long>>, kept string")


def remove_repeats_sql() -> str:
    return """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, ws FROM w WHERE len(ws) >= 20),
n AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') AS words FROM s),
e AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) > 1 AS later FROM n),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word, len(ws) AS n FROM w),
c AS (SELECT p.doc_id, p.pos, p.word, coalesce(bool_or(e.later) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN e ON p.doc_id = e.doc_id AND p.pos = e.pos),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""
