"""Mixing sources to target weights by fixed-length blocks.

The words of each source, document after document, are packed into blocks of a fixed number of words. For each output
shard the driver draws how many of its slots each source gets: a multinomial draw with probabilities in proportion to
what the source still lacks, cut at that; the last shard takes what is left, so that the totals meet the targets. The
j-th slot of a source with N blocks takes block P(j mod N), P being the pseudorandom permutation of [0, N) for the
source and the epoch j div N; so a block comes once an epoch. A source's last slot takes the first words of its block
only, as many as meet the target to a word. Slots and blocks are joined by source and block number: mixed_parts() has
the mix itself, part for part, and everything else is made of it.

A source's words are ordered by hash buckets of its rows, and each row's place is the sum of two running totals, in
its bucket and over the buckets' totals, so that a source with a third of all rows is no task of its own.

Targets. Sources in order of code points, null last, have the weights 5, 2, 1, repeating, and share all words; a target
stops at `cap` times its source's size, and the excess is shared again by weight until no target is above.

Bound: the driver holds one row per source and MOST_COUNTS drawn counts, and refuses more than MOST_SOURCES.
Defined cases: a null or empty text has no words and is taken 0 times; a null source is a source; rows that repeat
take part each; no words at all make every target 0; other columns of the input don't matter to mix(), and
mixed_documents() keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import clip, cut, leaves_no_memory, n_words, packed, slices

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 1 << 14, 20240607
MOST_SOURCES, MOST_COUNTS, BUCKET_ROWS, MOST_BUCKETS, RANGE_SLOTS = 100_000, 400_000, 1000, 1 << 20, 1 << 18
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Shares of the sum of sizes by weight, none above cap times its size."""
    total, n = float(sum(sizes)), len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    fixed: set[int] = set()
    while True:
        free = [i for i in range(n) if i not in fixed]
        left = total - sum(cap * sizes[i] for i in fixed)
        whole = sum(weight[i] for i in free)
        share = {i: left * weight[i] / whole for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in fixed else share[i] for i in range(n)]
        fixed |= over


def draw(wanted: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: rows are shards, and columns sum to `wanted`."""
    rng = np.random.default_rng(seed)
    left = np.array(wanted, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        if s == shards - 1:
            out[s] = left
            break
        slots = int(left.sum()) // (shards - s)
        while slots > 0:
            lack = left - out[s]
            got = np.minimum(rng.multinomial(slots, lack / lack.sum()), lack)
            out[s] += got
            slots -= int(got.sum())
        left = left - out[s]
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64's finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rounds(n: int, key: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """(bits of a half, their mask, keys) of the Feistel network over [0, n)."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    keys = scramble(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    return np.uint64(half), np.uint64((1 << half) - 1), keys


def permute(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of `at` under the key's permutation of [0, n): a Feistel network of four rounds, walked until it falls below n."""
    if n <= 1:
        return np.zeros(len(at), np.int64)
    half, mask, keys = rounds(n, key)
    x = at.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (scramble(right + k) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def place_of(value: int, n: int, key: int) -> int:
    """The place that permute() sends to `value`."""
    if n <= 1:
        return 0
    half, mask, keys = rounds(n, key)
    x = np.array([value], np.uint64)
    while True:
        left, right = x >> half, x & mask
        for k in keys[::-1]:
            left, right = right ^ (scramble(left + k) & mask), left
        x = (left << half) | right
        if x[0] < n:
            return int(x[0])


def key_of(seed: int, sid: int, epoch: int) -> int:
    return seed * 1_000_003 + sid * 101 + epoch


def slots_for(wanted: int, size: int, sid: int, seed: int, block_words: int) -> tuple[int, int]:
    """(slots, words of the last one) that make up `wanted` words of a source of `size` words."""
    if not size or not wanted:
        return 0, 0
    blocks = -(-size // block_words)
    epochs, rest = divmod(wanted, size)
    short = size - (blocks - 1) * block_words  # words of the last block
    at = place_of(blocks - 1, blocks, key_of(seed, sid, epochs))
    words = lambda m: m * block_words - (block_words - short) * (m > at)  # noqa: E731  in the epoch's first m slots
    if not rest:
        last = place_of(blocks - 1, blocks, key_of(seed, sid, epochs - 1)) == blocks - 1
        return epochs * blocks, short if last else block_words
    m = -(-rest // block_words)
    m += words(m) < rest
    return epochs * blocks + m, rest - words(m - 1)


def plan(docs: DataFrame, weights=WEIGHTS, cap=CAP, block_words=BLOCK_WORDS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(rows with their words' places, slots with their blocks)."""
    spark = docs.sparkSession
    base = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("__h")))
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: weights for so many can't be set one by one")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, weights, cap) if found else []
    blocks = [-(-s // block_words) for s in sizes]
    ends = [slots_for(min(round(t), int(cap * s)), s, i, seed, block_words) for i, (t, s) in enumerate(zip(goal, sizes, strict=True))]
    wanted = [n for n, _ in ends]
    shards = clip(sum(wanted) / SHARD_SLOTS, 1, max(1, MOST_COUNTS // max(1, len(found))))
    drawn = draw(wanted, shards, seed) if found else np.zeros((1, 0), np.int64)
    first = np.cumsum(drawn, axis=0) - drawn
    ranges = [(i, s, int(first[s, i]), int(drawn[s, i])) for s in range(len(drawn)) for i in range(len(found)) if drawn[s, i]]
    of_source = spark.createDataFrame([(i, r["source"], r["size"], goal[i], blocks[i], *ends[i]) for i, r in enumerate(found)], "sid int, __source string, source_size long, target double, blocks long, slots long, last_words long")
    each = spark.createDataFrame(ranges, "sid int, shard int, first long, n long")
    each = each.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE_SLOTS).cast("long"))))
    each = each.join(F.broadcast(of_source), "sid")  # a row a source, MOST_SOURCES at most
    each = each.select("sid", "shard", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(RANGE_SLOTS).cast("long"), F.col("n") - F.col("at")).alias("n"), "source_size", "blocks", "slots", "last_words")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sid, shard, at, count, size, n, slots, last = (c[0].as_py() for c in batch.columns)
            j = np.arange(at, at + count)
            block = np.empty(count, np.int64)
            for epoch in range(at // n, (at + count - 1) // n + 1):
                own = j // n == epoch
                block[own] = permute(j[own] % n, n, key_of(seed, sid, epoch))
            words = np.where(j == slots - 1, last, np.where(block == n - 1, size - (n - 1) * block_words, block_words))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(count, sid, np.int32)), pa.array(np.full(count, shard, np.int32)), pa.array(j), pa.array(j // n), pa.array(block), pa.array(words)], ["sid", "shard", "slot", "epoch", "block", "words"])

    tasks = clip(sum(wanted) / RANGE_SLOTS, 1, 1 << 16)
    slots = each.repartition(tasks).mapInArrow(place, "sid int, shard int, slot long, epoch long, block long, words long")
    rows = base.join(F.broadcast(of_source.drop("blocks", "slots", "last_words")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    buckets = clip(sum(r["n"] for r in found) / BUCKET_ROWS, 1, MOST_BUCKETS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "__h"), F.lit(buckets)).cast("int"))
    totals = rows.groupBy(F.col("sid").alias("__s"), F.col("bucket").alias("__b")).agg(F.sum("size").alias("__n"))
    over = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__s", "__b", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "__h")
    rows = rows.withColumn("rid", F.row_number().over(within)).withColumn("__end", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, (F.col("sid") == F.col("__s")) & (F.col("bucket") == F.col("__b")))
    rows = rows.withColumn("first_word", F.col("__before") + F.col("__end") - F.col("size")).drop("__s", "__b", "__before", "__end")
    return rows, slots


def mixed_parts(rows: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: rows' columns with (shard, slot, epoch, block, at, start, words) for each part of a block that a slot takes.

    `at` is the part's place in the block, `start` in its row; of a row that no slot takes, one line with null slots and
    0 words stays.
    """
    last = F.col("first_word") + F.col("size") - 1
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first_word") / block_words), F.floor(last / block_words)))
    parts = rows.select("*", F.explode_outer(numbers).alias("block"))
    start = F.greatest(F.col("block") * block_words, F.col("first_word"))
    end = F.least((F.col("block") + 1) * block_words, last + 1)
    parts = parts.withColumn("at", start - F.col("block") * block_words).withColumn("start", start - F.col("first_word")).withColumn("__held", F.coalesce(end - start, F.lit(0)))
    index = slots.select(F.col("sid").alias("__s"), F.col("block").alias("__b"), "shard", "slot", "epoch", F.col("words").alias("__words"))
    # the estimated size of what a plan like that of the slots makes is far too small: no broadcast
    joined = parts.join(index.hint("merge"), (F.col("sid") == F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    taken = F.when(F.col("slot").isNotNull(), F.greatest(F.least(F.col("__held"), F.col("__words") - F.col("at")), F.lit(0))).otherwise(0)
    return joined.withColumn("words", taken).drop("__s", "__b", "__held", "__words")


def mix(docs: DataFrame, weights=WEIGHTS, cap=CAP, block_words=BLOCK_WORDS, seed=SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) of every row: how many of its words the mix takes, and into which shards."""
    parts = mixed_parts(*plan(docs, weights, cap, block_words, seed), block_words)
    keys = ["sid", "bucket", "rid", "doc_id", "source", "size", "source_size", "target"]
    taken = parts.groupBy(*keys).agg(F.sum("words").cast("long").alias("taken"), F.array_sort(F.collect_set(F.when(F.col("words") > 0, F.col("shard")))).alias("shards"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap=CAP, block_words=BLOCK_WORDS, seed=SEED) -> DataFrame:
    """The mix as documents: in the columns of docs, a row for each document and epoch in which blocks of it are taken.

    A row's text is the document's words that the epoch takes, with the white space between them; spans that don't
    touch are joined by a line end. A document that an epoch takes whole keeps its text as it is. n_chars follows.
    """
    docs, restored = packed(docs, ["doc_id", "text", "source", "n_chars"])
    rows, slots = plan(docs, weights, cap, block_words, seed)
    # rows of one key are numbered alike on both sides; those that agree in id, text and source may stand for one another
    key = F.xxhash64("doc_id", "__h", "source").alias("__key")
    number = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id", "__h", "source"))
    numbered = rows.select("sid", "bucket", "rid", "size", "first_word", "doc_id", "source", "__h", key).withColumn("__d", number)
    parts = mixed_parts(numbered.select("sid", "bucket", "rid", "size", "first_word", F.col("__key").alias("__k"), "__d"), slots, block_words).where("words > 0")
    own = parts.groupBy("__k", "__d").agg(F.sort_array(F.collect_list(F.struct("epoch", "start", "words"))).alias("__spans"))
    keyed = docs.withColumn("__h", F.xxhash64("text")).select("*", key).withColumn("__no", number)
    # texts are shuffled once: the join is by the window's key, and the number is compared after it
    both = keyed.join(own.hint("merge"), (F.col("__key") == F.col("__k")) & (F.col("__no") - F.col("__d") == 0)).select(*docs.columns, "__spans")
    names = docs.columns

    @leaves_no_memory
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows, out = [], []
            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)):
                raw = text.encode()
                words = [m.span() for m in WORD_BYTES.finditer(raw)]
                runs: dict[int, list[list[int]]] = {}
                for s in own:
                    of_epoch = runs.setdefault(s["epoch"], [])
                    if of_epoch and of_epoch[-1][1] == s["start"]:
                        of_epoch[-1][1] += s["words"]
                    else:
                        of_epoch.append([s["start"], s["start"] + s["words"]])
                for spans in runs.values():
                    rows.append(i)
                    out.append(text if spans == [[0, len(words)]] else "\n".join(raw[words[a][0] : words[b - 1][1]].decode() for a, b in spans))
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            new = {"text": out, "n_chars": [len(x) for x in out]}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kept.schema.field(c).type) if c in new else kept.column(c) for c in names], schema=kept.schema)

    return restored(both.mapInArrow(build, docs.schema))
