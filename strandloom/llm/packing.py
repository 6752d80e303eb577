"""Packing by shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most `capacity` ids. The histogram of piece lengths has at most `capacity` bins,
whatever the corpus, so the driver packs it: lengths are placed longest first, each into the packs with the most room
(the shortest), all pieces of one length and all packs of one pattern at once; a pattern's count is split where the
pieces don't suffice for all its packs. The patterns are then joined back to the pieces by rank: the r-th piece of a
length fills the r-th place that the patterns have for that length. Ranks are counted in two steps (within buckets of
a length, then over the buckets' totals), so a length that a third of all pieces have is no task of its own.

Defined cases: a null or empty text is the end id alone; rows that repeat are packed each; an empty table gives no
sequences; other columns of the pieces are kept by pack(), whose own columns sequence_id and offset replace any of those
names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import clip, cut, slices, stored
from strandloom.llm.tokens import encoding

CAPACITY = 2048
#: Pieces of a bucket in which ranks are counted (of one length; they carry their ids), and the most buckets.
BUCKET_PIECES, MOST_BUCKETS = 500, 1 << 16

PIECE_SCHEMA = "start long, length long, ids binary, doc_tokens long"


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Full pieces, then the rest."""
    return [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: (id, start, length, ids as little-endian unsigned 32-bit integers, doc_tokens), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(tokenizer) as enc:
            for batch in slices(batches, 2000):
                flat, ends = enc.batch(batch.column(1))
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    at, n = 0, int(b - a) + 1
                    for k in piece_lengths(n, capacity):
                        rows.append(i)
                        starts.append(at)
                        lengths.append(k)
                        ids.append(own[4 * at : 4 * (at + k)])
                        totals.append(n)
                        at += k
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], [id_col, "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {PIECE_SCHEMA}")


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(how many packs, their piece lengths in order)] for a histogram length -> pieces, shortest pack first."""
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room
    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, p in packs.items() if p), default=0)
            if room < length:
                n, pattern, each = None, (), capacity // length
                # new packs: as many pieces each as fit, then one with the rest
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        put(packs, done, capacity - k * length, n, (length,) * k)
                left = 0
                continue
            n, pattern = packs[room].pop()
            k = min(room // length, -(-left // n))  # pieces for each of these packs, as even as may be
            used = min(n, left // k) if k else 0
            if n > used:
                packs[room].append((n - used, pattern))
            put(packs, done, room - k * length, used, pattern + (length,) * k)
            left -= used * k
            if used < n and left and left < k:
                n, pattern = packs[room].pop()
                if n > 1:
                    packs[room].append((n - 1, pattern))
                put(packs, done, room - left * length, 1, pattern + (length,) * left)
                left = 0
    return done + [p for room in sorted(packs) for p in packs[room]]


def put(packs: dict, done: list, room: int, n: int, pattern: tuple[int, ...]) -> None:
    if n:
        (packs[room] if room else done).append((n, pattern))


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces of that length in a pack, offset of the first of them)."""
    out, ranks, sequence = [], defaultdict(int), 0
    for n, pattern in patterns:
        at = 0
        for length in dict.fromkeys(pattern):
            k = pattern.count(length)
            out.append((length, ranks[length], ranks[length] + n * k - 1, sequence, k, at))
            ranks[length] += n * k
            at += k * length
        sequence += n
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset. `order`: columns that tell pieces apart; ties among equal rows don't matter.

    The pieces are read twice: for the histogram and for the ranks. Cut costly lineage before.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = pieces.groupBy(F.col(length_col).alias("l")).count().collect()  # at most `capacity` rows
    patterns = pack_histogram({int(r["l"]): r["count"] for r in counts}, capacity)
    table = places(patterns)
    buckets = clip(sum(r["count"] for r in counts) / BUCKET_PIECES, 1, MOST_BUCKETS)
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    each = keyed.groupBy(F.col(length_col).alias("__l"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("__l", "__b", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    within = Window.partitionBy(length_col, "__bucket").orderBy(*order)
    ranked = keyed.withColumn("__r", F.row_number().over(within) - 1)
    ranked = ranked.join(before, (F.col(length_col) == F.col("__l")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.col("__before") + F.col("__r"))
    by_length: dict[int, list] = defaultdict(list)
    for length, *rest in table:
        by_length[length].append(tuple(rest))
    schema = "__length long, __places array<struct<first:long,last:long,sequence:long,k:long,at:long>>"
    # a row for each length, `capacity` at most; patterns are at most as many as lengths and splits
    lookup = spark.createDataFrame([(k, v) for k, v in by_length.items()], schema)
    found = ranked.join(F.broadcast(lookup), F.col(length_col) == F.col("__length"))
    hit = F.element_at(F.filter("__places", lambda p: (p["first"] <= F.col("__rank")) & (p["last"] >= F.col("__rank"))), 1)
    found = found.withColumn("__p", hit).withColumn("__d", F.col("__rank") - F.col("__p.first"))
    found = found.withColumn("sequence_id", F.col("__p.sequence") + F.floor(F.col("__d") / F.col("__p.k"))).withColumn("offset", F.col("__p.at") + F.pmod(F.col("__d"), F.col("__p.k")) * F.col(length_col))
    return found.select(*pieces.columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The digest of all packed pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(cut(digest), ["doc_id", "start", "ids_crc32"], capacity)


def packed_ids(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """All packed pieces with their token ids: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    `ids` holds little-endian unsigned 32-bit integers; the pieces of a sequence_id in order of offset are the sequence.
    """
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity).withColumn("__crc", F.crc32("ids")), "pieces")
    return pack(pieces, ["doc_id", "start", "__crc"], capacity).drop("__crc")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids) of packed_ids(): a row a sequence, which has `capacity` ids at most."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("__p"))
    joined = F.aggregate("__p", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    return held.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("__p.doc_id").alias("doc_ids"))
