"""Embedding whitening from exact whole-number sums.

A component c becomes x = floor(scale * c) + shift. With n vectors and the sums S, y = n * x - S is centred and whole, so
the covariance of x is the sum of y y' over n^3, exactly. Large shifts cost no digit of it.

Digit-slice GEMM: y is split into limbs of 16 bits with digits from -2^15 to 2^15 - 1. Products of limbs are at most 2^30,
so the sums over 2^22 rows are whole numbers that a double holds, and one matrix product of all limbs of a batch is exact
whatever the order of additions. Each task recombines its limb products to big integers; these go to Spark's sums as
digits of 40 bits, and so merge exactly in any order and tree. Only the finished d x d matrix comes to the driver, where it
is decomposed; its size is that of the vectors, not of the table.

Defined cases: vectors that are null, or hold null or not finite entries, take no part and give no rows; vectors of
different lengths, or entries whose x needs more than 63 bits, are refused with an error; repeated rows and ids count each;
an empty table or vectors of no entries give no rows; directions without variance are whitened to 0, and then the
identity's error is 1; the sign of a component is that for which its entry of largest size is positive; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import leaves_no_memory
from strandloom.llm.topk import matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb, rows after which sums of limb products are taken out of doubles, bits and number of the digits that merge.
LIMB, FLUSH, DIGIT, DIGITS = 16, 1 << 22, 40, 6
DIGIT_COLUMNS = [f"v{k}" for k in range(DIGITS)]


def whole(v: pa.Array, scale: float, shift: int) -> np.ndarray:
    x = np.floor(scale * matrix(v))
    if len(x) and float(np.abs(x).max(initial=0)) >= 2.0**62:
        raise OverflowError("components too large for whole numbers of 64 bits")
    return x.astype(np.int64) + shift


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, in Python's integers where 64 bits don't do."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Limbs of y from the lowest, each with digits from -2^(LIMB-1) up, as doubles."""
    half, out = 1 << (LIMB - 1), []
    while y.any() or not out:
        digit = ((y + half) & (2 * half - 1)) - half
        out.append(digit.astype(np.float64))
        y = (y - digit) >> LIMB
    return out


class Products:
    """The exact sum of y y' over rows that come in batches."""

    def __init__(self, d: int):
        self.d, self.rows, self.total = d, 0, np.zeros((d, d), object)
        self.held: dict[int, np.ndarray] = {}

    def add(self, y: np.ndarray) -> None:
        parts = limbs(y)
        stacked = np.concatenate(parts, axis=1)
        k = len(parts)
        if self.rows + len(y) > FLUSH:
            self.flush()
        self.rows += len(y)
        product = stacked.T @ stacked
        self.held[k] = self.held[k] + product if k in self.held else product

    def flush(self) -> np.ndarray:
        d = self.d
        for k, product in self.held.items():
            for i in range(k):
                for j in range(k):
                    whole_ = product[i * d : (i + 1) * d, j * d : (j + 1) * d].astype(np.int64).astype(object)
                    self.total = self.total + whole_ * (1 << (LIMB * (i + j)))
        self.held, self.rows = {}, 0
        return self.total


def digits(value: int) -> list[int]:
    """Signed digits of DIGIT bits from the lowest; the last takes what is left."""
    out, half = [], 1 << (DIGIT - 1)
    for _ in range(DIGITS - 1):
        d = ((value + half) & (2 * half - 1)) - half
        out.append(d)
        value = (value - d) >> DIGIT
    return [*out, value]


def undigits(row) -> int:
    return sum(int(row[c]) << (DIGIT * k) for k, c in enumerate(DIGIT_COLUMNS))


ENTRY = "i int, j int, n long, " + ", ".join(f"{c} long" for c in DIGIT_COLUMNS)


def entries(found: dict[tuple[int, int], int], n: int) -> pa.RecordBatch:
    keys = list(found)
    columns = list(zip(*(digits(int(found[k])) for k in keys), strict=True)) if keys else [()] * DIGITS
    arrays = [pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([n] * len(keys), pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, ["i", "j", "n", *DIGIT_COLUMNS])


def merged(parts: DataFrame) -> list:
    """Sums of all parts' entries: rows (i, j, n, digits), as many as a matrix has entries."""
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", *DIGIT_COLUMNS))).collect()


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))


def column_sums(rows: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """(n, S)."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole(batch.column(0), scale, shift)
                n += len(x)
                own = x.sum(axis=0).astype(object) if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object).sum(axis=0)
                if total is not None and len(total) != len(own):
                    raise ValueError("vectors differ in length")
                total = own if total is None else total + own
        if total is not None:
            yield entries({(0, j): v for j, v in enumerate(total)}, n)

    found = sorted(merged(rows.select("v").mapInArrow(run, ENTRY)), key=lambda r: r["j"])
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors differ in length")
    return (found[0]["n"] if found else 0), [undigits(r) for r in found]


def scatter(rows: DataFrame, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """The sum of y y' over all rows, in whole numbers."""
    d = len(sums)

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Products(d)
        for batch in batches:
            if batch.num_rows:
                held.add(centred(whole(batch.column(0), scale, shift), n, sums))
        total = held.flush()
        yield entries({(i, j): total[i, j] for i in range(d) for j in range(i + 1) if total[i, j]}, 1)

    out = np.zeros((d, d), object)
    for r in merged(rows.select("v").mapInArrow(run, ENTRY)):
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = undigits(r)
    return out


def rounded(numerator: int, denominator: int) -> float:
    """The quotient as the nearest double."""
    return numerator / denominator


def components(total: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns, shares of the trace) of the first k components."""
    cube = n**3
    v = np.array([[rounded(int(x), cube) for x in row] for row in total], np.float64)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    top = np.abs(vector).argmax(axis=0)
    vector = vector * np.where(vector[top, np.arange(len(top))] < 0, -1.0, 1.0)
    trace = rounded(int(np.trace(total)), cube)
    value = np.where(value > np.finfo(float).eps * len(value) * max(value[0], 0.0), value, 0.0)
    return value[:k], vector[:, :k], (value / trace if trace > 0 else np.zeros(len(value)))[:k]


def whiten(vectors: DataFrame, components_: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, whitened array, n, deviation decimal, explained array, identity_error) of each usable row."""
    rows = usable_rows(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n long, deviation decimal(38,0), whitened array<double>"
    n, sums = column_sums(rows, scale, shift)
    explained, error = [], 0.0
    if n:
        value, vector, explained = components(scatter(rows, n, sums, scale, shift), n, components_)
        into = vector / np.where(value > 0, np.sqrt(np.where(value > 0, value, 1.0)), np.inf)  # columns without variance become 0
        explained = explained.tolist()

    def project(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = centred(whole(v, scale, shift), n, sums)
        return y, (y / n).astype(np.float64) @ into

    if n:
        error = identity_error(rows, project, n, len(explained))

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, w = project(batch.column(1))
                big = float(np.abs(y.astype(np.float64)).max()) ** 2 * y.shape[1] >= 2.0**62
                deviation = (y.astype(object) ** 2).sum(axis=1) if big else (y * y).sum(axis=1)
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(w), n)), pa.array([int(x) for x in deviation], pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], [id_col, "n", "deviation", "whitened"]
                )

    doubles = F.array(*(F.lit(float(x)) for x in explained)).cast("array<double>")
    return (rows if n else rows.limit(0)).mapInArrow(run, schema).withColumns({"explained": doubles, "identity_error": F.lit(float(error))})


def identity_error(rows: DataFrame, project, n: int, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = project(batch.column(0))[1]
                product += w.T @ w
                total += w.sum(axis=0)
        i, j = np.tril_indices(k)
        i, j, v = np.append(i, np.arange(k)), np.append(j, np.full(k, -1)), np.append(product[np.tril_indices(k)], total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)], ["i", "j", "v"])

    found = rows.select("v").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r["i"]: r["v"] / n for r in found if r["j"] < 0}
    return max(abs(r["v"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in found if r["j"] >= 0)


def long_form(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "x")
    rows = whitened.select(id_col, "n", "deviation", "identity_error", each)
    return rows.select(id_col, (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
