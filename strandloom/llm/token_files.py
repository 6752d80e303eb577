"""Token-ID files: a shared zstandard dictionary, one frame per document, and an offset index per block.

Format. A block is one binary value: the magic `TID1`, a little-endian unsigned 32-bit number of documents n, the 32
bytes of the dictionary's SHA-256, n + 1 unsigned 64-bit offsets of the frames, n unsigned 64-bit counts of ids before
each document of the block, and the frames. A frame is one document's ids as little-endian unsigned 32-bit integers,
compressed alone with the shared dictionary, so that any short document is read without its neighbours. Blocks are
rows of a Parquet table (`bucket`, `block`, `first_id`, `last_id`, `n_docs`, `n_ids`, `ids_before` in the bucket, `doc_ids`, `image`), because any
store that Spark writes to takes that; a second table holds the dictionary and the totals of ids of each bucket.

Documents lie in ascending id order: buckets are ranges of ids between quantiles of the id column (never of texts),
and a bucket's blocks follow one another. The dictionary is trained on at most SAMPLE_DOCS documents with the least
hash of their id, of each at most SAMPLE_CHARS characters; every document is written whole.

Defined cases: a null or empty text is a document of the end id alone; null ids come first; rows that repeat are
written each, side by side; an empty table gives no blocks; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.common import clip, new_path, slices
from strandloom.llm.tokens import encoding

MAGIC = b"TID1"
#: Bounds of the sample that the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1000, 8192, 64 << 10
#: A block ends at this many bytes of frames or documents.
BLOCK_BYTES, BLOCK_DOCS = 128 << 10, 4096
#: Documents of a bucket, and the most buckets.
BUCKET_DOCS, MOST_BUCKETS = 4000, 1 << 16
BLOCK_SCHEMA = "bucket int, block int, first_id long, last_id long, n_docs int, n_ids long, ids_before long, doc_ids array<long>, image binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from the bounded sample; empty where the sample is too small for one."""
    import zstandard

    some = docs.where(F.col(text_col) != "")
    chosen = some.select(id_col, F.xxhash64(id_col).alias("__h")).orderBy("__h", id_col).limit(SAMPLE_DOCS).select(id_col).distinct()  # ids alone are sorted
    rows = some.join(F.broadcast(chosen), id_col, "left_semi").select(F.substring(text_col, 1, SAMPLE_CHARS).alias("__t")).limit(SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: r["__t"])  # the same dictionary whatever the order of rows
    with encoding(tokenizer) as enc:
        flat, borders = enc.batch(pa.array([r["__t"] for r in rows], pa.string())) if rows else (np.empty(0, "<u4"), np.zeros(1, int))
    samples = [np.append(flat[a:b], np.uint32(end_id)).astype("<u4").tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
    if len(samples) < 8:
        return b""
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(max(size, 256), samples).as_bytes()
    except zstandard.ZstdError:  # samples too few or too alike
        return b""


def codec(dictionary: bytes):
    import zstandard

    own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=1, **own), zstandard.ZstdDecompressor(**own)


def block_image(dict_hash: bytes, frames: list[bytes], counts: list[int]) -> bytes:
    ends = np.cumsum([0, *map(len, frames)]).astype("<u8")
    before = (np.cumsum([0, *counts])[:-1]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<I", len(frames)), dict_hash, ends.tobytes(), before.tobytes(), *frames])


def read_image(image: bytes, dict_hash: bytes, decompressor, which: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number in the block, ids before it in the block, ids) of all documents or of those asked for."""
    if image[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    (n,) = struct.unpack_from("<I", image, 4)
    if image[8:40] != dict_hash:
        raise ValueError("the block was written with another dictionary")
    ends = np.frombuffer(image, "<u8", n + 1, 40)
    before = np.frombuffer(image, "<u8", n, 40 + 8 * (n + 1))
    base = 40 + 8 * (2 * n + 1)
    for i in range(n) if which is None else which:
        frame = image[base + int(ends[i]) : base + int(ends[i + 1])]
        yield i, int(before[i]), np.frombuffer(decompressor.decompress(frame), "<u4")


def bucket_borders(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that split the documents into even ranges: at most MOST_BUCKETS, from the id column alone."""
    n = docs.count()
    buckets = clip(n / BUCKET_DOCS, 1, MOST_BUCKETS)
    if buckets == 1:
        return []
    at = [k / buckets for k in range(1, buckets)]
    found = docs.select(F.percentile_approx(id_col, at, max(10_000, 10 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode, compress and write all documents in ascending order of id; gives the folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    dict_hash = hashlib.sha256(dictionary).digest()
    borders = bucket_borders(docs, id_col)
    cuts = np.array(borders, np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = codec(dictionary)[0].compress
        with encoding(tokenizer) as enc:
            for batch in slices(batches, 2000):
                flat, ends = enc.batch(batch.column(1))
                out, counts = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    ids = np.empty(b - a + 1, "<u4")
                    ids[:-1] = flat[a:b]
                    ids[-1] = end_id
                    out.append(compress(ids.tobytes()))
                    counts.append(len(ids))
                own = batch.column(0).to_numpy(zero_copy_only=False)
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                bucket = np.where(null, 0, np.searchsorted(cuts, np.where(null, 0, own).astype(np.int64), side="right"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket, pa.int32()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())], ["id", "bucket", "n_ids", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        state = {"bucket": None, "block": 0, "bytes": 0, "ids": 0}

        def flush():
            ids, counts, out = ([x[k] for x in held] for k in range(3))
            real = [i for i in ids if i is not None]
            row = [state["bucket"], state["block"], real[0] if real else None, real[-1] if real else None, len(ids), sum(counts), state["ids"], ids, block_image(dict_hash, out, counts)]
            held.clear()
            state["bytes"] = 0
            state["ids"] += sum(counts)
            state["block"] += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["bucket", "block", "first_id", "last_id", "n_docs", "n_ids", "ids_before", "doc_ids", "image"])

        for batch in slices(batches, 2000):
            for i, bucket, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (bucket != state["bucket"] or state["bytes"] >= BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield flush()
                if bucket != state["bucket"]:
                    state |= {"bucket": bucket, "block": 0, "ids": 0}
                held.append((i, n, frame))
                state["bytes"] += len(frame)
        if held:
            yield flush()

    framed = docs.mapInArrow(frames, "id long, bucket int, n_ids long, frame binary")
    # a bucket is a partition: hashed, several would meet in one task
    sorted_ = framed.repartitionById(len(borders) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "n_ids", "frame")
    sorted_.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = sorted((r["bucket"], r["n"]) for r in written.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())
    meta = [(dictionary, dict_hash.hex(), tokenizer, end_id, [b for b, _ in totals], [n for _, n in totals])]
    spark.createDataFrame(meta, "dictionary binary, dict_hash string, tokenizer string, end_id int, buckets array<int>, totals array<long>").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files, all or of the documents asked for; `start` counts the ids of all documents before."""
    meta = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, dict_hash = bytes(meta["dictionary"]), bytes.fromhex(meta["dict_hash"])
    if hashlib.sha256(dictionary).digest() != dict_hash:
        raise ValueError("the dictionary is damaged")
    base = dict(zip(meta["buckets"], np.cumsum([0, *meta["totals"]])[:-1].tolist(), strict=False))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    if doc_ids is not None:
        any_of = [F.col("first_id").isNull() | ((F.col("first_id") <= i) & (F.col("last_id") >= i)) for i in doc_ids]
        blocks = blocks.where(F.array_max(F.array(*any_of)) if any_of else F.lit(False))
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = codec(dictionary)[1]
        for batch in slices(batches, 1):
            bucket, before, ids, image = (batch.column(k)[0].as_py() for k in range(4))
            which = None if wanted is None else [i for i, x in enumerate(ids) if x in wanted]
            found = list(read_image(image, dict_hash, decompressor, which))
            if found:
                at = base[bucket] + before
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i, _, _ in found], pa.int64()), pa.array([at + b for _, b, _ in found], pa.int64()), pa.array([len(x) for _, _, x in found], pa.int64()), pa.array([x.tobytes() for _, _, x in found], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.select("bucket", "ids_before", "doc_ids", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
