"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Shingles are WORDS words in a row, of words of digits, a-z (after lower-casing A-Z) and characters beyond ASCII; a text
of fewer words is one shingle. A shingle's weight is the number of times it comes. Each is the source of a Poisson process
whose rate is its weight: arrivals come at exponential steps, each at one of REGISTERS registers, which keeps the
earliest; a process ends when its next arrival is later than all registers of its text (early termination). Two texts
agree in a register with the probability Jaccard similarity of their weighted shingles. BANDS bands of ROWS registers
give the candidates: a pair of similarity 0.8 is missed with probability (1 - 0.8^3)^16, about 1 in 100,000.

A pair is linked if its probability Jaccard similarity is SIMILARITY or more, either with shingles weighted by their
counts or with all weights 1 (then it is the Jaccard similarity of the distinct shingles); both are verified exactly.
For that a text with repeated shingles is sketched twice, by either weights, and stands in the buckets of both sketches;
without repeats both sketches are the same.

Classes. Texts with the same words are one node from the start, so copies never meet as pairs; a node's name is 64 bits of
its words' digest, and where 64 more bits tell texts of one name apart, they get names of their own. In each bucket of a
band every node is compared with one hub, the least node. Then all nodes of a bucket that are not yet of one component
are compared: in buckets of at most CHUNK nodes pair by pair, in larger ones block by block. For that the nodes outside a
bucket's largest component are dealt into blocks, and so are those inside; each block of the former meets all other
blocks of its bucket, and one task counts the shared shingles of two blocks at once. So every two nodes that meet in a
band are compared or known to be of one component. Components come from links by minimum labels with pointer jumping, in
checkpointed rounds. No bucket, chunk or component is held by one task or the driver; joins by bucket deal both sides anew,
so that adaptive execution splits a bucket that is much larger than others.

Defined cases: texts without words are alike only if equal, null counts as empty; rows that repeat belong to one
class; the class id is the least doc_id of the class (null only if all are); ids may be of any type that can be ordered; other columns of the input don't matter
to classes(), and deduplicate() keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandloom.llm.common import cut, leaves_no_memory, may_hold, packed, slices, stored

WORDS, SIMILARITY = 5, (4, 5)
REGISTERS, BANDS, ROWS = 48, 16, 3
CHUNK = 16
#: Nodes and shingles of a block, about; columns of a dense table of shingles; bands that are settled at a time (each turn finds fewer components).
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 512, 400_000, 4096
TURNS = (range(4), range(4, BANDS))
#: Bytes of text that are worked at once: their shingles' arrays take some twenty times as much.
SLICE_BYTES = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each shingle, its hash) in texts' order, and a digest of each text's words."""
    import xxhash

    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(texts, SEPARATORS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    words, owner = words.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U, len(distinct))
    h = table[words.indices.to_numpy()] if len(owner) else np.empty(0, U)
    borders = np.searchsorted(owner, np.arange(len(texts) + 1))
    raw = h.tobytes()
    digests = [hashlib.md5(raw[8 * a : 8 * b]).digest() if b > a else b"" for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
    sizes = np.diff(borders)
    first = np.flatnonzero(owner[: max(0, len(owner) - WORDS + 1)] == owner[WORDS - 1 :]) if len(owner) >= WORDS else np.empty(0, np.int64)
    code = np.zeros(len(first), U)
    for k in range(WORDS):
        code = scramble(code * U(0x9E3779B97F4A7C15) + h[first + k])
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    few = np.array([int.from_bytes(digests[i][8:], "little") for i in short], U)
    of = np.concatenate([owner[first], short]) if len(first) else short
    code = np.concatenate([code, few])
    order = np.argsort(of, kind="stable")
    return of[order].astype(np.int64), code[order], digests


def distinct_shingles(of: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count), by text and hash."""
    order = np.lexsort((code, of))
    of, code = of[order], code[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return of[at], code[at], np.diff(np.append(at, len(of)))


def sketch(n: int, of: np.ndarray, code: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (the hash of the shingle that arrived first) of n texts; 0 for texts without shingles."""
    earliest = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, U)
    limit = np.full(n, np.inf)
    time = np.zeros(len(of))
    alive = np.arange(len(of))
    step = 0
    while len(alive):
        step += 1
        bits = scramble(code[alive] + U(step * 0xD1342543DE82EF95 % (1 << 64)))
        time[alive] += -np.log(((bits >> U(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[alive]
        alive = alive[time[alive] < limit[of[alive]]]
        register = of[alive] * registers + (scramble(code[alive] ^ U(step * 0xA0761D6478BD642F % (1 << 64))) % U(registers)).astype(np.int64)
        np.minimum.at(earliest, register, time[alive])
        won = time[alive] == earliest[register]
        who[register[won]] = code[alive[won]]
        limit = earliest.reshape(n, registers).max(axis=1)
        alive = alive[time[alive] < limit[of[alive]]]
    return who.reshape(n, registers)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(registers), BANDS), U)
    for b in range(BANDS):
        for r in range(ROWS):
            out[:, b] = scramble(out[:, b] * U(0x9E3779B97F4A7C15) + registers[:, b * ROWS + r])
    return out.view(np.int64)


def names_of(digests: list[bytes], texts: pa.Array, bits: int = 64) -> list[pa.Array]:
    """Each text's name and the 64 bits that check it, from its words' digest, or its own text where it has no words."""
    whole = [d or hashlib.md5(b"\0" + (texts[i].as_py() or "").encode()).digest() for i, d in enumerate(digests)]
    both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0] >> (64 - bits) if bits < 64 else both[:, 0]), pa.array(both[:, 1])]


def shared_names(rows: DataFrame) -> DataFrame | None:
    """The names that texts of different words have: none but for an accident of the digest."""
    found = cut(rows.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select(F.col("node").alias("__shared")))
    return found if found.limit(1).count() else None


def told_apart(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Rows whose texts of different words have different names, without the column `check`."""
    if shared is not None:
        own = F.when(F.col("__shared").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))
        rows = rows.join(shared, F.col("node") == F.col("__shared"), "left").withColumn("node", own).drop("__shared")
    return rows.drop("check")


def sketched(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, node, check, even, band values b0..; null without words) of every row.

    `even` tells the sketch with equal weights, which comes after the other where a text repeats shingles; bands in
    which both sketches agree are null there.
    """
    names = [f"b{k}" for k in range(BANDS)]

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, SLICE_BYTES):
            n = batch.num_rows
            of, code, digests = shingles(batch.column(1))
            of, code, count = distinct_shingles(of, code)
            bands = band_hashes(sketch(n, of, code, count.astype(float)))
            again = np.unique(of[count > 1])
            empty = np.array([not d for d in digests], bool)
            node, check = names_of(digests, batch.column(1), bits)
            blank = np.repeat(empty[:, None], BANDS, axis=1)
            if len(again):
                own = np.isin(of, again)
                even = band_hashes(sketch(len(again), np.searchsorted(again, of[own]), code[own], np.ones(int(own.sum()))))
                bands, blank = np.concatenate([bands, even]), np.concatenate([blank, even == bands[again]])
            rows = pa.array(np.concatenate([np.arange(n), again]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), node.take(rows), check.take(rows), pa.array(np.arange(len(rows)) >= n), *(pa.array(bands[:, k], mask=blank[:, k]) for k in range(BANDS))], ["doc_id", "node", "check", "even", *names]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, check long, even boolean, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame, wanted: DataFrame, shared: DataFrame | None, bits: int = 64) -> DataFrame:
    """(node, sorted distinct shingle hashes as bytes, their counts as bytes: none if all are 1) of the wanted nodes, from the texts of their least doc_id."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, SLICE_BYTES):
            of, code, digests = shingles(batch.column(0))
            of, code, count = distinct_shingles(of, code)
            at = np.searchsorted(of, np.arange(batch.num_rows + 1))
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            counts = [count[a:b].astype("<u4").tobytes() if b > a and count[a:b].max() > 1 else b"" for a, b in spans]
            yield pa.RecordBatch.from_arrays([*names_of(digests, batch.column(0), bits), pa.array([code[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(counts, pa.binary())], ["node", "check", "sh", "ct"])

    able = may_hold(docs.select("doc_id", "text"), F.col("doc_id"), wanted.where("id is not null"), "id", "__may")  # the join on nodes follows
    texts = able.where(F.col("doc_id").isNull() | F.col("__may")).select("text")
    found = told_apart(texts.mapInArrow(run, "node long, check long, sh binary, ct binary"), shared)
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def weights_of(ct: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ct, "<u4").astype(np.float64) if ct else np.ones(n)


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes and their weights: the sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    a, b = wx[i], wy[j]
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    upto = np.searchsorted(ratio, ratio, side="right")  # where y_j / y_i is the lesser
    low, high = np.concatenate([[0.0], np.cumsum(a)])[upto], b.sum() - np.concatenate([[0.0], np.cumsum(b)])[upto]
    alone = wx.sum() - a.sum() + (wy.sum() - b.sum()) / ratio
    return float((a / (low + high / ratio + alone)).sum())


def alike(x: np.ndarray, cx: bytes, y: np.ndarray, cy: bytes) -> bool:
    """Whether one of both similarities is large enough."""
    shared = len(x) + len(y) - len(np.union1d(x, y))
    if SIMILARITY[1] * shared >= SIMILARITY[0] * (len(x) + len(y) - shared):
        return True
    return bool(cx or cy) and shared > 0 and reaches(probability_jaccard(x, weights_of(cx, len(x)), y, weights_of(cy, len(y))))


def reaches(similarity: float) -> bool:
    return similarity >= SIMILARITY[0] / SIMILARITY[1] - 1e-12


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles are alike enough."""
    pairs = stored(pairs, "pairs")
    sets = may_hold(sets, F.col("node"), pairs.select("a").union(pairs.select("b")), "a", "__may").where("__may")  # the joins are exact
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa"), F.col("ct").alias("ca")), "a").join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sb"), F.col("ct").alias("cb")), "b")

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            each = zip(*(batch.column(c).to_pylist() for c in ("sa", "ca", "sb", "cb")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([alike(np.frombuffer(x, U), cx, np.frombuffer(y, U), cy) for x, cx, y, cy in each], pa.bool_()))

    return both.select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the links: comp is the least node that links lead to."""
    links = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        new = cut(new.join(jump, F.col("comp") == F.col("__n"), "left").select("node", F.least("comp", F.coalesce("__c", F.col("comp"))).alias("comp"), "old"))
        changed = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def joined(comps: DataFrame, new: DataFrame) -> DataFrame:
    """components() of comps and new links."""
    if not new.limit(1).count():
        return comps
    return components(new.union(comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))))


def shared_counts(of: np.ndarray, code: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The number of hashes that each row of left shares with each of right; of, code: row and hash, n rows.

    With weights of all (row, hash) also the weight that the shared ones have in the row of left, and in that of right.
    """
    _, column, held = np.unique(code, return_inverse=True, return_counts=True)
    common = held[column] > 1
    of, column = of[common], column[common]
    weight = None if weight is None else weight[common]
    # columns that the same rows hold are one, with a size
    mark = np.zeros(len(held), U)
    np.add.at(mark, column, scramble(np.arange(1, n + 1, dtype=U))[of])
    _, group, size = np.unique(mark, return_inverse=True, return_counts=True)
    cells, inverse = np.unique(group[column] * np.int64(n) + of, return_inverse=True)  # by column, then row
    column, of = cells // n, cells % n
    heavy = None if weight is None else np.bincount(inverse, weights=weight, minlength=len(cells)).astype(np.float32)
    out = np.zeros((3 if heavy is not None else 1, len(left), len(right)), np.float32)
    for at in range(0, len(size), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        width = min(COLUMNS, len(size) - at)
        dense = np.zeros((n, width), np.float32)
        dense[of[a:b], column[a:b] - at] = 1
        of_right = np.ascontiguousarray(dense[right].T)
        out[0] += (dense[left] * size[at : at + COLUMNS].astype(np.float32)) @ of_right
        if heavy is not None:
            full = np.zeros((n, width), np.float32)
            full[of[a:b], column[a:b] - at] = heavy[a:b]
            out[1] += full[left] @ of_right
            out[2] += dense[left] @ full[right].T
    return (out[0], out[1], out[2]) if heavy is not None else (out[0], None, None)


def linked(table: pa.Table) -> pa.Table:
    """Links (a, b) between the two sides of a block pair, as many as join its components; side 2 stands on both."""
    node, comp, side = (table.column(c).to_numpy() for c in ("node", "comp", "side"))
    codes, counts = [np.frombuffer(x, U) for x in table.column("sh").to_pylist()], table.column("ct").to_pylist()
    sizes = np.array([len(x) for x in codes], np.int64)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        weights = [weights_of(c, k) for c, k in zip(counts, sizes, strict=True)] if any(counts) else None
        shared, in_left, in_right = shared_counts(np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes), len(codes), left, right, None if weights is None else np.concatenate(weights))
        sure = SIMILARITY[1] * shared >= SIMILARITY[0] * (sizes[left][:, None] + sizes[right][None, :] - shared)
        able = np.zeros_like(sure)
        if weights is not None:
            # the share of either text's weight that is shared is no less than their probability Jaccard similarity
            total = np.array([w.sum() for w in weights])
            least = SIMILARITY[0] / SIMILARITY[1] - 1e-5
            able = ~sure & (in_left >= least * total[left][:, None]) & (in_right >= least * total[right][None, :])
        group = np.unique(comp, return_inverse=True)[1]

        def link(x: int, y: int) -> None:
            out.append((int(node[x]), int(node[y])))
            group[group == group[y]] = group[x]

        for k, x in enumerate(left):
            found = right[sure[k]]
            tops, at = np.unique(group[found], return_index=True)
            for top, y in zip(tops, found[at], strict=True):
                if top != group[x]:
                    link(x, y)
            for y in right[able[k]]:
                if group[y] != group[x] and (counts[x] or counts[y]) and reaches(probability_jaccard(codes[x], weights[x], codes[y], weights[y])):
                    link(x, y)
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def block_links(members: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the components of each bucket's nodes; every two nodes of different components are compared."""
    placed = members.join(comps, "node", "left").select("node", "band", "h", F.coalesce("comp", "node").alias("comp"))
    placed = placed.join(sets.select("node", "size"), "node")
    each = placed.groupBy("band", "h", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    buckets = each.groupBy("band", "h").agg(F.max(F.struct("c", "comp", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("main.c < c")
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK_NODES, s / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("band", "h", F.col("main.comp").alias("main"), parts(F.col("main.c"), F.col("main.s")).alias("inner"), parts(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("outer"))
    rows = placed.join(cut(buckets), ["band", "h"]).withColumn("inside", F.col("comp") == F.col("main"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    row = lambda inside, i, j, side: F.struct(F.lit(inside).alias("inside"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    p = F.col("p")
    of_inner = F.transform(up_to("outer"), lambda k: row(True, k, p, F.lit(1)))
    to_inner = F.transform(up_to("inner"), lambda k: row(True, p, k, F.lit(0)))
    to_outer = F.transform(up_to("outer"), lambda k: row(False, F.least(p, k), F.greatest(p, k), F.when(p == k, 2).when(p < k, 0).otherwise(1)))
    copies = F.when(F.col("inside"), of_inner).otherwise(F.concat(to_inner, to_outer))
    rows = cut(rows.select("node", "comp", "band", "h", F.explode(copies).alias("x")).select("node", "comp", "band", "h", "x.*"))
    rows = rows.join(sets.select("node", "sh", "ct"), "node")
    return rows.groupBy("band", "h", "inside", "i", "j").applyInArrow(linked, "a long, b long")


def link_classes(docs: DataFrame, rows: DataFrame, shared: DataFrame | None, bits: int = 64) -> DataFrame:
    """(node, comp) of the nodes that are linked to others; rows: sketched() with names told apart."""
    names = [f"b{k}" for k in range(BANDS)]
    nodes = rows.groupBy("node", "even").agg(F.min("doc_id").alias("id"), *(F.first(n).alias(n) for n in names))
    each = nodes.select("node", "id", F.posexplode(F.array(*names)).alias("band", "h")).where("h is not null")
    counts = each.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    counts = stored(counts, "buckets")  # so that both sides are dealt for the join, and Spark can split a bucket of many nodes
    members = stored(each.join(counts, ["band", "h"]), "members")  # of buckets with more than one node
    wanted = stored(members.select("node", "id").distinct(), "candidates")
    sets = stored(shingle_sets(docs, wanted, shared, bits).withColumn("size", F.length("sh") / 8), "shingles")
    links = stored(verified(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), sets), "links")
    comps = components(links)
    placed = members.where(F.col("n") <= CHUNK).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = placed.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "h")
    placed = cut(placed.join(open_, ["band", "h"]).select("node", "comp", "band", "h"))
    left, right = placed.alias("x"), placed.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h"))
    pairs = left.join(right, same & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    comps = joined(comps, stored(verified(pairs, sets), "links"))
    for bands in TURNS:
        comps = joined(comps, stored(block_links(members.where((F.col("n") > CHUNK) & F.col("band").isin(*bands)), comps, sets), "links"))
    return comps


def classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, node, class_id) of every row of docs. `bits`: of a node's name, before names are told apart."""
    return with_classes(docs, bits)[0]


def with_classes(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """classes(), and shared_names()."""
    found = stored(sketched(docs, bits), "sketches")
    shared = shared_names(found)
    rows = told_apart(found, shared)
    comps = link_classes(docs, rows, shared, bits)
    rows = rows.where("not even").select("doc_id", "node")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("id")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = cut(nodes)
    least = nodes.groupBy(F.col("comp").alias("__c")).agg(F.min("id").alias("class_id"))
    of_node = nodes.join(least, F.col("comp") == F.col("__c")).select(F.col("node").alias("__n"), "class_id")
    return rows.join(of_node, F.col("node") == F.col("__n")).select("doc_id", "node", "class_id"), shared


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class the one of least doc_id (of rows that repeat, one)."""
    docs, restored = packed(docs, ["doc_id", "text"])
    found, shared = with_classes(docs)
    found = stored(found, "classes")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "class_id").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    # several rows may have a class's least id: then the least node of them stays
    kept = stored(kept.select(F.col("doc_id").alias("__i"), F.col("node").alias("__k"), "n"), "kept")

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, SLICE_BYTES):
            digests = shingles(batch.column("text"))[2]
            yield pa.RecordBatch.from_arrays([*batch.columns, *names_of(digests, batch.column("text"))], [*names, "__node", "__check"])

    names = docs.columns
    of_id = found.groupBy(F.col("doc_id").alias("__i")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("k"))
    doubtful = stored(of_id.where((F.col("n") > 1) | (F.col("k") == 0)).select("__i"), "doubtful")  # ids that may go, or of several rows
    flagged = may_hold(docs, F.col("doc_id"), doubtful.where("__i is not null"), "__i", "__may")
    unsure = F.col("doc_id").isNull() | F.col("__may")
    keyed = flagged.where(unsure).select(*names).mapInArrow(run, StructType([*docs.schema.fields, StructField("__node", LongType()), StructField("__check", LongType())]))
    if shared is not None:
        own = F.when(F.col("__shared").isNull(), F.col("__node")).otherwise(F.xxhash64("__node", "__check"))
        keyed = keyed.join(shared, F.col("__node") == F.col("__shared"), "left").withColumn("__node", own).drop("__shared")
    if kept.where("n > 1").limit(1).count():
        keyed = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", "__node").orderBy("doc_id"))).where("__r = 1").drop("__r")
    on = F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__node") == F.col("__k"))
    return restored(flagged.where(~unsure).select(*names).unionByName(keyed.join(kept, on, "left_semi").select(*names)))
