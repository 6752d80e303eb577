"""Token counts of texts by rank-synchronous array merging.

Distinct pre-tokens of a batch lie in one flat numpy array of symbols. In each round every pre-token finds the pair of
lowest rank among its neighbours and merges all places of that pair at once; places that overlap (as in `aaa`) are
taken from the left. A pair that a merge creates always ranks after that merge, so merging all places of one rank at
once gives what merging one by one gives. A pre-token that has no pair in the table leaves the array. The symbols that
are left are the tokens.

Defined cases: a null or empty text has 0 tokens; special strings inside a text are one token each, as the library
takes them by default; rows that repeat are counted each; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandloom.llm.common import leaves_no_memory, slices
from strandloom.llm.tokens import JOINED, LETTERS, PLAIN, RUNS, Cache, is_byte_level, load, spec, split_chunks, tokenizer_path

FAR = np.iinfo(np.int32).max


class RankMerges:
    """The merges of a byte-level BPE as arrays: pair of symbols -> rank and merged symbol."""

    def __init__(self, name_or_path: str):
        model = spec(name_or_path)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte = np.array([vocab[LETTERS[b]] for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], FAR)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each symbol) that are left of the words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_s, done_o = [], []
        while len(symbols):
            rank = np.full(len(symbols), FAR, np.int32)
            same = owner[:-1] == owner[1:]
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(least == FAR, sizes)
            if over.any():
                done_s.append(symbols[over])
                done_o.append(owner[over])
                stay = ~over
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                sizes, least = sizes[least != FAR], least[least != FAR]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of places that touch one another, every second one from the left
            run = np.concatenate([[True], np.diff(hit) != 1])
            first = np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(hit))))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_s:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(done_s), np.concatenate(done_o)

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(self.merge(words)[1], minlength=len(words))

    def ids(self, words: list[bytes]) -> list[list[int]]:
        symbols, owner = self.merge(words)
        order = np.argsort(owner, kind="stable")
        borders = np.searchsorted(owner[order], np.arange(len(words) + 1))
        flat = symbols[order].tolist()
        return [flat[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


class Counter:
    """Counts of texts; one per Python worker."""

    def __init__(self, name_or_path: str):
        self.tokenizer = load(name_or_path)
        self.merges = RankMerges(name_or_path)
        self.cache = Cache()
        self.special = [t["content"] for t in spec(name_or_path).get("added_tokens", [])]

    def pre_tokens(self, text: str) -> tuple[int, list[bytes]]:
        """Number of special strings, and the bytes of the pre-tokens between them."""
        if PLAIN.match(text[1:] if text[:1] == " " else text):
            return 0, [text.encode()]
        parts, n = [text], 0
        for s in self.special:
            cut = [p.split(s) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [x for c in cut for x in c]
        back = UNLETTERED
        return n, [bytes(map(back.__getitem__, word)) for p in parts if p for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(p)]

    def count_all(self, chunks: list[str]) -> list[int]:
        n, words = [], []
        owners = []
        for i, chunk in enumerate(chunks):
            text = chunk[1:] if chunk[:1] == JOINED else " " + chunk
            special, own = self.pre_tokens(text)
            n.append(special)
            words += own
            owners += [i] * len(own)
        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
        counts = self.merges.counts(list(distinct)) if distinct else np.empty(0, int)
        out = np.array(n, np.int64)
        if words:
            np.add.at(out, owners, counts[[distinct[w] for w in words]])
        return out.tolist()

    def batch(self, texts: pa.Array) -> np.ndarray:
        odd, borders, codes, unique, n_unique = split_chunks(texts)
        counts = np.array(self.cache.many(unique, self.count_all), np.int64)[codes]
        totals = np.concatenate([[0], np.cumsum(counts)])
        out = totals[borders[1:]] - totals[borders[:-1]]
        for i, text in odd.items():  # whole texts, cut at white-space runs
            parts = [JOINED + p for p in RUNS.findall(text)]
            out[i] = sum(self.cache.many(list(dict.fromkeys(parts)), self.count_all, parts))
        return out


UNLETTERED = {letter: b for b, letter in LETTERS.items()}


@lru_cache(maxsize=2)
def counter(name_or_path: str) -> Counter:
    return Counter(name_or_path)


def count_batch(name_or_path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text. Tokenizers that aren't byte-level BPE are asked text by text."""
    if is_byte_level(name_or_path):
        return counter(name_or_path).batch(texts)
    own = pc.fill_null(texts, "").to_pylist()
    if name_or_path.endswith(".model"):
        return np.array([len(x) for x in piece_model(name_or_path).encode(own, num_threads=1)], np.int64)
    return np.array([len(e.ids) for e in load(name_or_path).encode_batch_fast(own, add_special_tokens=False)], np.int64)


@lru_cache(maxsize=2)
def piece_model(name_or_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name_or_path))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs, without a shuffle."""

    @leaves_no_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches, 3000):
                n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(count_batch(tokenizer, batch.column(1)), pa.int64())], [id_col, "n_bytes", "n_tokens"])
        finally:
            if is_byte_level(tokenizer):
                counter(tokenizer).cache.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
