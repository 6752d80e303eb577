"""Language-model scores of texts: add-one unigram words, and the marginal likelihood over a subword lattice.

Words. Training texts' words are counted (in numpy per Arrow batch, then by a shuffle on the word), with the number of
all texts' words, so that every word of the corpus has a row. The table grows with the corpus and stays distributed.

Lattice. The pieces of an existing vocabulary and their scores weight all segmentations of a word: forward recursion
in log space gives a word's marginal probability. A word is made so: a first piece (those that begin with the mark of a
word's begin share 1), and after each piece the word ends with one probability or goes on with any piece (all pieces share
1), so the probabilities of all words sum to 1 at most (less by byte sequences that are no text). The vocabulary's own
scores are log probabilities, or for a table of merges ranks, taken as Zipf's law; one step of expectation maximisation
over all training words (each distinct word once, weighted by its count) fits first pieces, others and the end to the
corpus. Characters without a piece take their bytes' pieces; U+0000 counts as U+FFFD. A text's model is a row of words and
an end: each step ends with the share of ends among training tokens, else it is a word, with its lattice probability;
pieces don't cross words, so the product over words is the text's marginal exactly.

Texts. Words of at least a threshold of counts, at most FREQUENT of them, are known to every task and summed where the
text is read; of a text's other words each distinct one is joined to the table by the word, and the sums are added.

Defined cases: a null or empty text is the end alone; without training texts all counts are 0; rows that repeat are
scored each; words of any length are scored whole; other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import crc32_text, leaves_no_memory, slices, stored
from strandloom.llm.tokens import tokenizer_path

#: Most words that every task knows; pieces longer than this many characters are not used.
FREQUENT, LONGEST = 1 << 17, 16
#: Cells (words times characters) of the arrays of one recursion.
CELLS = 120_000
MARK = "▁"
CODE = 1 << 21


class Lattice:
    """Pieces as a trie in sorted arrays, and the recursions over batches of words."""

    def __init__(self, pieces: list[str], of_byte: dict[int, int], scores: np.ndarray, fitted: np.ndarray | None = None):
        """scores: the vocabulary's own log weights; fitted: log probabilities of first pieces, of others, and of a word's end."""
        self.pieces, self.bytes = pieces, of_byte
        self.opens = np.array([p.startswith(MARK) for p in pieces])
        if fitted is None:
            first = np.where(self.opens, scores, -np.inf)
            fitted = np.concatenate([first - log_sum(first), scores - log_sum(scores), [math.log(0.5)]])
        self.first, self.rest, self.stop = fitted[: len(pieces)], fitted[len(pieces) : -1], float(fitted[-1])
        self.go = math.log1p(-math.exp(self.stop))
        nodes: dict[tuple[int, str], int] = {}
        self.terminal = [-1]
        for i, piece in enumerate(self.pieces):
            at = 0
            for ch in piece:
                nxt = nodes.get((at, ch))
                if nxt is None:
                    nxt = nodes[at, ch] = len(self.terminal)
                    self.terminal.append(-1)
                at = nxt
            self.terminal[at] = i
        keys = np.array([at * CODE + ord(ch) for at, ch in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()), np.int32)[order]
        self.terminal = np.array(self.terminal, np.int32)
        self.single = {p for p in self.pieces if len(p) == 1}

    def edges(self, text: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece that begins at each cell of the padded texts (-1: none)."""
        n, width = text.shape
        out = []
        cells = np.arange(n * width)
        state = np.zeros(n * width, np.int64)
        flat = text.ravel()
        for length in range(1, LONGEST + 1):
            at = cells + length - 1
            inside = (cells % width) + length <= width
            cells, state, at = cells[inside], state[inside], at[inside]
            key = state * CODE + flat[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (self.keys[k] == key) & (flat[at] > 0)
            cells, state = cells[good], self.next[k[good]].astype(np.int64)
            piece = np.full(n * width, -1, np.int32)
            piece[cells] = self.terminal[state]
            out.append(piece.reshape(n, width))
            if not len(cells):
                break
        return out

    def byte_scores(self, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of characters that are no piece, from their bytes' pieces."""
        out = np.full(text.shape, -np.inf)
        lack = (first < 0) & (text > 0)
        if lack.any():
            codes, where = np.unique(text[lack], return_inverse=True)
            out[lack] = np.array([sum(self.rest[self.bytes[b]] + self.go for b in chr(c).encode()) for c in codes])[where]
        return out

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, padded code points with the mark in front) of words of like lengths."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            room = max(1, CELLS // int(lengths[order[min(len(order) - 1, at + 200)]]))
            rows = order[at : at + room]
            width = int(lengths[rows].max())
            while len(rows) > 1 and len(rows) * width > 2 * CELLS:
                rows = rows[: len(rows) // 2]
                width = int(lengths[rows].max())
            text = "".join((MARK + words[i].replace("\0", "\ufffd")).ljust(width, "\0") for i in rows)
            yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(rows), width)
            at += len(rows)

    def forward(self, text: np.ndarray, pieces: list[np.ndarray], scores: list[np.ndarray]) -> np.ndarray:
        n, width = text.shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for t in range(1, width + 1):
            terms = np.stack([alpha[:, t - k] + scores[k - 1][:, t - k] for k in range(1, min(t, len(scores)) + 1)])
            alpha[:, t] = log_sum(terms)
        return alpha

    def scores_of(self, text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        pieces = self.edges(text)
        scores = [np.where(p >= 0, self.rest[p] + self.go, -np.inf) for p in pieces]
        for own, p in zip(scores, pieces, strict=True):
            own[:, 0] = np.where(p[:, 0] >= 0, self.first[p[:, 0]], -np.inf)
        spare = self.byte_scores(text, pieces[0])
        scores[0] = np.maximum(scores[0], spare)
        return pieces, scores

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word over all segmentations."""
        out = np.empty(len(words))
        for rows, text in self.batches(words):
            alpha = self.forward(text, *self.scores_of(text))
            out[rows] = alpha[np.arange(len(rows)), (text > 0).sum(axis=1)] + self.stop
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, as first ones and as others, over all segmentations of the words, each taken `counts` times."""
        total = np.zeros((2, len(self.pieces)))
        for rows, text in self.batches(words):
            pieces, scores = self.scores_of(text)
            n, width = text.shape
            alpha = self.forward(text, pieces, scores)
            ends = (text > 0).sum(axis=1)
            beta = np.full((n, width + 1), -np.inf)
            beta[np.arange(n), ends] = 0
            for t in range(width - 1, -1, -1):
                terms = np.stack([beta[:, t + k] + scores[k - 1][:, t] for k in range(1, min(width - t, len(scores)) + 1)])
                beta[:, t] = np.where(t == ends, 0.0, log_sum(terms)) if (t == ends).any() else log_sum(terms)
            whole = alpha[np.arange(n), ends]
            weight = counts[rows].astype(float)
            for k, p in enumerate(pieces, 1):
                cut = slice(0, width - k + 1)
                has = p[:, cut] >= 0
                if has.any():
                    share = np.exp(alpha[:, cut] + scores[k - 1][:, cut] + beta[:, k:] - whole[:, None]) * weight[:, None]
                    inner = np.broadcast_to(np.arange(share.shape[1]) > 0, share.shape)
                    for which, own in enumerate((has & ~inner, has & inner)):
                        total[which] += np.bincount(p[:, cut][own], weights=share[own], minlength=len(self.pieces))
            lack = (pieces[0] < 0) & (text > 0)
            if lack.any():
                share = (np.exp(alpha[:, :-1] + scores[0] + beta[:, 1:] - whole[:, None]) * weight[:, None])[lack]
                for c, s in zip(text[lack], share, strict=True):
                    for b in chr(c).encode():
                        total[1, self.bytes[b]] += s
        return total


def log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe).sum(axis=0)) + safe


def pieces_of(vocabulary: str) -> tuple[list[str], dict[int, int], np.ndarray]:
    """(pieces, piece number of each byte, log probabilities from the vocabulary's own scores)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
    pieces, scores, of_byte = [], [], {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            of_byte[int(piece[3:5], 16)] = len(pieces)
            piece = f"\0{piece}"  # not reached from text
        elif len(piece) > LONGEST:
            continue
        pieces.append(piece)
        scores.append(sp.get_score(i))
    for b in range(256):
        if b not in of_byte:
            of_byte[b] = len(pieces)
            pieces.append(f"\0<{b}>")
            scores.append(min(scores))
    s = np.array(scores, float)
    if s.max() - s.min() > 1000:  # ranks of merges
        s = -np.log(1.0 + np.argsort(np.argsort(-s, kind="stable"), kind="stable"))
    return pieces, of_byte, s - math.log(np.exp(s).sum())


@lru_cache(maxsize=2)
def lattice(vocabulary: str, fitted: bytes | None) -> Lattice:
    return Lattice(*pieces_of(vocabulary), None if fitted is None else np.frombuffer(fitted))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(distinct words and their numbers in all texts, text of each word)."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), owner[full.to_numpy(zero_copy_only=False)]


def gathered(batches: Iterator[pa.RecordBatch], most: int = 24 << 20) -> Iterator[pa.Table]:
    """Batches in groups of some bytes, so that a word's counts meet early."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def word_table(docs: DataFrame, is_training: Column) -> DataFrame:
    """(word, c, seen): each word of all texts with its training and its total count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words, owner = split_words(batch["text"].combine_chunks())
            training = batch["t"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            codes = words.indices.to_numpy()
            n = len(words.dictionary)
            seen, c = np.bincount(codes, minlength=n), np.bincount(codes[training[owner]], minlength=n)
            for at in range(0, n, 100_000):
                yield pa.RecordBatch.from_arrays([words.dictionary.slice(at, 100_000).cast(pa.string()), pa.array(c[at : at + 100_000].astype(np.int64)), pa.array(seen[at : at + 100_000].astype(np.int64))], ["word", "c", "seen"])

    each = docs.select("text", is_training.alias("t")).mapInArrow(run, "word string, c long, seen long")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit_pieces(words: DataFrame, vocabulary: str) -> bytes:
    """Lattice's log probabilities after one step of expectation maximisation over all training words."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary, None)
        total = np.zeros((2, len(own.pieces)))
        for batch in slices(batches, 50_000):
            total += own.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        held = np.flatnonzero(total.any(axis=0))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[0, held]), pa.array(total[1, held])], ["piece", "n_first", "n_rest"])

    counts = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n_first double, n_rest double").groupBy("piece").agg(F.sum("n_first").alias("f"), F.sum("n_rest").alias("r")).collect()  # a row a piece
    n = np.zeros((2, len(lattice(vocabulary, None).pieces)))
    for r in counts:
        n[:, r["piece"]] = round(r["f"], 3), round(r["r"], 3)  # sums in any order give the same scores
    return fitted(lattice(vocabulary, None), n).tobytes()


def fitted(start: Lattice, n: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts, smoothed by half a count for each piece, spread as the vocabulary's own scores."""
    size = len(start.pieces)
    first, rest = n[0] + 0.5 * np.exp(start.first) * start.opens.sum(), n[1] + 0.5 * np.exp(start.rest) * size
    with np.errstate(divide="ignore"):
        return np.concatenate([np.log(first / first.sum()), np.log(rest / rest.sum()), [math.log((n[0].sum() + 1) / (n.sum() + 2))]])


def score_words(words: DataFrame, vocabulary: str, log_p: bytes) -> DataFrame:
    """words with `lp`, the log10 of each word's marginal probability."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary, log_p)
        for batch in slices(batches, 50_000):
            lp = own.log_marginals(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(lp)], ["word", "c", "seen", "lp"])

    return words.select("word", "c", "seen").mapInArrow(run, "word string, c long, seen long, lp double")


def threshold(words: DataFrame, most: int = FREQUENT) -> int:
    """The least count that no more than `most` words reach."""
    bins = words.groupBy(F.floor(F.log2("seen") * 16).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("least")).collect()  # some hundred rows
    found, reached = 0, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        found += r["n"]
        if found > most:
            break
        reached = r["least"]
    return reached if reached is not None else 1 << 62


def score(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row for each row of docs: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    out = crc32_text(F.col("doc_id")) % folds == held_out
    docs = docs.select("doc_id", "text", out.alias("held_out"))
    counted = stored(word_table(docs, ~F.col("held_out")), "words")
    words = stored(score_words(counted, vocabulary, fit_pieces(counted, vocabulary)), "word-scores")
    ends = docs.where(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    end_share = (ends + 1) / (n + 2)
    at_least = threshold(words)
    frequent = words.where(F.col("seen") >= at_least).orderBy("word").collect()  # at most FREQUENT rows
    index = {r["word"]: i for i, r in enumerate(frequent)}
    known = np.array([r["c"] > 0 for r in frequent], np.int64)
    base = np.log10(np.array([r["c"] for r in frequent], float) + 1)
    lp = np.array([r["lp"] for r in frequent], float)
    shared = docs.sparkSession.sparkContext.broadcast((index, known, base, lp))

    @leaves_no_memory
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, base, lp = shared.value
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 3000):
            rows = batch.num_rows
            words, owner = split_words(batch.column(1))
            codes = words.indices.to_numpy()
            place = np.fromiter((index.get(w, -1) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words.dictionary))
            at = place[codes]
            common = at >= 0
            of, own = owner[common], at[common]
            total = np.bincount(owner, minlength=rows)
            add = lambda x: np.bincount(of, weights=x[own], minlength=rows).astype(np.float64)  # noqa: B023, E731
            rare, times = np.unique(owner[~common].astype(np.int64) << 32 | codes[~common].astype(np.int64), return_counts=True)
            borders = np.searchsorted(rare >> 32, np.arange(rows + 1)).astype(np.int32)
            texts = words.dictionary.take(pa.array(rare & 0xFFFFFFFF)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(rows)), batch.column(0), batch.column(2), pa.array(total.astype(np.int64) + 1), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(lp)),
                    pa.ListArray.from_arrays(pa.array(borders), texts), pa.ListArray.from_arrays(pa.array(borders), pa.array(times.astype(np.int64))),
                ],
                ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rare", "times"],
            )
            uid += rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    read_docs = stored(docs.select("doc_id", "text", "held_out").mapInArrow(read, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lp double, rare array<string>, times array<long>"), "texts")
    rare = read_docs.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rest = words.where(F.col("seen") < at_least).select("word", F.log10(F.col("c") + 1).alias("b"), F.col("lp").alias("l"), "c")
    added = rare.join(rest, "word").groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * F.col("b")).alias("b2"), F.sum(F.col("times") * F.col("l")).alias("l2"))
    both = read_docs.drop("rare", "times").join(added, "uid", "left")
    value = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    n_words = F.col("n_tokens") - 1
    return both.select(
        "doc_id", "held_out", "n_tokens",
        (value("n_known", "k2") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (value("base", "b2") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (value("lp", "l2") + n_words * math.log10(1 - end_share) + math.log10(end_share)).alias("score"),
    )
