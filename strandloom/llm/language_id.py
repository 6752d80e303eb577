"""Language identification in two levels: the family first, then the language within it.

A text is lower-cased and described by the square roots of the shares of its hashed byte bigrams and trigrams. Linear
support vector machines (squared hinge loss, dual coordinate descent) tell each family from the others; the family of
the largest margin wins. Within it, one machine for each pair of its languages votes; the language with most votes
wins, ties going to the larger sum of margins and then to the name.

Learning. The machines learn from at most PER_LANGUAGE rows of each language, and SAMPLE_ROWS in all, those with the least
hash of their id and text, whole texts, held-out rows excluded, rows that repeat once: what the driver holds is SAMPLE_ROWS vectors of 2^BITS floats (131 MB).
Only rows whose hash is low enough for their language's count are ranked, so a language with a third of all rows is no
large task. Families are a table of codes; a code that it lacks is a family of its own.

Defined cases: a null text, or one without a letter, is `und` with score 0; if nothing can be learned, all texts are;
one learned language is predicted for every text with letters, with score 1; rows that repeat are predicted each; rows
without an id are of no known fold, so none of them is learned from; of more than MOST_LANGUAGES labels those of most rows
are learned, the first by name of equals;
other columns of the input don't matter to predict(), and keep_identified() keeps them, with the predicted language in
the column `lang` where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import crc32_text, leaves_no_memory, release, slices

#: Bounds of the learning sample, and the most languages it may have.
PER_LANGUAGE, SAMPLE_ROWS, MOST_LANGUAGES = 500, 8000, 200
BITS = 12
LETTER = re.compile(r"[^\W\d_]")
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(re.split(r"[-_]", lang.lower())[0], lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams; of Euclidean length 1."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    shift = np.uint32(32 - BITS)
    counts = np.bincount((two * np.uint32(2654435761)) >> shift, minlength=1 << BITS) + np.bincount((three * np.uint32(2246822519)) >> shift, minlength=1 << BITS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """The places and values of a vector that aren't 0."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpacked(raw: bytes, out: np.ndarray) -> None:
    n = len(raw) // 6
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last is the bias, whose column of ones x has) of an L2-loss linear SVM, by dual coordinate descent.

    y: -1 or 1 for each row of x; rows with 0 take no part.
    """
    rows = np.flatnonzero(y)
    share = {v: c * len(rows) / (2 * max(1, int((y == v).sum()))) for v in (-1.0, 1.0)}  # both classes weigh alike
    diagonal = np.array([0.5 / share[v] if v else 0.0 for v in y])
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64) + diagonal
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(rows):
            g = y[i] * (w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                most = max(most, abs(g))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * margin, -30.0, 30.0)))


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, np.ndarray] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        """x: a row for each text, whose last column is 1."""
        known = sorted(set(langs))
        model = cls()
        for lang in known:
            model.families.setdefault(family_of(lang), []).append(lang)
        label = np.array(langs, object)
        own = np.array([family_of(v) for v in langs], object)
        if len(model.families) > 1:
            model.of_family = {f: svm(x, np.where(own == f, 1.0, -1.0)) for f in model.families}
        for inside in model.families.values():
            for a, b in combinations(inside, 2):
                model.of_pair[a, b] = svm(x, np.where(label == a, 1.0, np.where(label == b, -1.0, 0.0)))
        return model

    def margins(self, x: np.ndarray, machines: dict) -> dict:
        """The margins of all rows by machine: one product of matrices."""
        if not machines:
            return {}
        w = np.stack(list(machines.values())).astype(np.float32)
        return dict(zip(machines, (x @ w[:, :-1].T + w[:, -1]).T.astype(np.float64), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if t is not None and self.families and LETTER.search(t)]
        if not able:
            return langs, scores
        x = np.stack([features(texts[i]) for i in able])
        names = sorted(self.families)
        family, score = np.zeros(len(able), np.int64), np.ones(len(able))
        if self.of_family:
            of_family = self.margins(x, self.of_family)
            each = np.stack([of_family[f] for f in names])
            family = each.argmax(axis=0)  # the first name where margins tie
            score = chance(each.max(axis=0))
        of_pair = self.margins(x, self.of_pair)
        for k, name in enumerate(names):
            rows, inside = np.flatnonzero(family == k), sorted(self.families[name])
            votes, sums, worst = np.zeros((len(inside), len(rows))), np.zeros((len(inside), len(rows))), np.full((len(inside), len(rows)), np.inf)
            for a, b in combinations(range(len(inside)), 2):
                m = of_pair[inside[a], inside[b]][rows]
                votes[a] += m >= 0
                votes[b] += m < 0
                for at, own in ((a, m), (b, -m)):
                    sums[at] += own
                    worst[at] = np.minimum(worst[at], own)
            best = np.lexsort((-np.arange(len(inside))[:, None] * np.ones(len(rows)), sums, votes), axis=0)[-1] if len(rows) else []
            for j, (row, top) in enumerate(zip(rows, best, strict=True)):
                langs[able[row]] = inside[top]
                scores[able[row]] = score[row] * (chance(worst[top, j]) if len(inside) > 1 else 1.0)
        return langs, scores


def fit(docs: DataFrame, folds: int | None = 5, held_out: int = 0) -> Model:
    """A model from the bounded sample of labelled rows; rows of the held-out fold take no part."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    if folds:
        rows = rows.where(F.col("doc_id").isNotNull() & (crc32_text(F.col("doc_id")) % folds != held_out))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    each = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("kinds"))
    counts = {r["lang"]: r["kinds"] for r in each.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    most = min(PER_LANGUAGE, SAMPLE_ROWS // max(1, len(counts)))
    # the share of the hashes' range that holds a few more than `most` of a language's rows
    spark = docs.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, (2 * most + 100) / max(1, n))) for lang, n in counts.items()], "__lang string, __share double")
    low = (F.shiftright("h", 32) / float(1 << 32) + 0.5) <= F.col("__share")
    near = rows.select("lang", "h").join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(low).select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("lang", "h").collect()
    if not chosen:
        return Model()
    # SAMPLE_ROWS rows at most
    picked = F.broadcast(spark.createDataFrame([(r["lang"], r["h"]) for r in chosen], "lang string, h long"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(features(t)) for t in batch.column(2).to_pylist()], pa.binary())], ["lang", "h", "x"])

    # rows that repeat have one hash and one text
    described = rows.join(picked, ["lang", "h"], "left_semi").select("lang", "h", "text").mapInArrow(describe, "lang string, h long, x binary")
    sample = described.groupBy("lang", "h").agg(F.first("x").alias("x")).collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the same model whatever the order of rows
    x = np.zeros((len(sample), (1 << BITS) + 1), np.float32)
    x[:, -1] = 1
    for row, r in zip(x, sample, strict=True):
        unpacked(r["x"], row)
    labels = [r["lang"] for r in sample]
    del sample
    model = Model.fit(x, labels)
    del x
    release()  # the driver goes on
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, without a shuffle."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language the model can tell, with it as their `lang`; `und` goes."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            langs = pa.array(model.predict(batch.column("text").to_pylist())[0], pa.string())
            if "lang" in batch.schema.names:
                at = batch.schema.get_field_index("lang")
                batch = batch.set_column(at, batch.schema.field(at), langs.cast(batch.schema.field(at).type))
            yield batch.filter(pc.not_equal(langs, "und"))

    return docs.mapInArrow(run, docs.schema)
