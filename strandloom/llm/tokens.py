"""Token ids of texts, as the tokenizers library gives them, with a cache of words per Python worker.

A byte-level BPE never joins across the border between a non-space and the white space after it: no pre-token spans
that border, and none looks back across it. A text is therefore cut at single blanks into chunks, each chunk is
encoded once by the library and kept, and a text's ids are its chunks' ids in a row. Texts in which a blank follows
other white space are cut at white-space runs instead. Tokenizers of another build are given whole texts.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm.common import release

#: Unicode white space, as the library's pattern for pre-tokens takes it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters alone: one pre-token, whatever the version of Unicode.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: For RE2. Texts that chunks can't be cut from at blanks; marks after a letter and before white space; a line's end.
SPACE_RE2 = re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", SPACE)
ODD_RE2 = f"\\x01|[{SPACE_RE2}] "
MARKS_RE2 = f"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!]+)([ \\n]|$)"
LINE_RE2 = f"([^{SPACE_RE2}])\\n([^{SPACE_RE2}])"
#: Begins a chunk that no blank stands before.
JOINED = "\x01"
#: Entries and bytes of the keys of each of the two generations of a task's cache; longer chunks aren't kept.
GENERATION, GENERATION_BYTES, LONGEST_KEPT = 80_000, 4 << 20, 256


def tokenizer_path(name_or_path: str) -> str:
    """A file of the public vocabularies by name, or any path as it is."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@lru_cache(maxsize=4)
def load(name_or_path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name_or_path))


def spec(name_or_path: str) -> dict:
    """The vocabulary file; large, so it isn't kept."""
    with open(tokenizer_path(name_or_path), encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def is_byte_level(name_or_path: str) -> bool:
    """Whether chunks may be encoded one by one."""
    if not name_or_path.endswith(".json"):
        return False
    s = spec(name_or_path)
    pre = s.get("pre_tokenizer") or {}
    return (
        s["model"]["type"] == "BPE"
        and not s["model"].get("dropout")
        and not s["model"].get("ignore_merges")
        and not s.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(PLAIN.match(t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(f"[{SPACE}]", t["content"]) for t in s.get("added_tokens", []))
    )


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


LETTERS = byte_letters()


class Cache:
    """Chunks' values for the length of a task. It forgets what was not asked for in the last generation of new entries."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.bytes = 0

    def keep(self, values: dict) -> None:
        """Add values, and begin a generation when this one is full."""
        for chunk, value in values.items():
            if len(chunk) <= LONGEST_KEPT:
                self.new[chunk] = value
                self.bytes += len(chunk)
        if len(self.new) >= GENERATION or self.bytes >= GENERATION_BYTES:
            self.old, self.new, self.bytes = self.new, {}, 0

    def all(self, chunks: list[str], make) -> list:
        found = list(map(self.new.get, chunks))
        added = {}
        for i, value in enumerate(found):
            if value is None:
                chunk = chunks[i]
                value = added.get(chunk)
                if value is None:
                    value = self.old.get(chunk)
                if value is None:
                    value = make(chunk)
                added[chunk] = found[i] = value
        self.keep(added)
        return found

    def many(self, chunks: list[str], make_all, wanted: list[str] | None = None) -> list:
        """As all(), but what is missing is made in one call. With `wanted`, a value for each of those."""
        found = {c: self.new.get(c) for c in chunks}
        missing = [c for c, v in found.items() if v is None]
        for c in missing:
            found[c] = self.old.get(c)
        missing_still = [c for c in missing if found[c] is None]
        if missing_still:
            found.update(zip(missing_still, make_all(missing_still), strict=True))
        self.keep({c: found[c] for c in missing})
        return [found[c] for c in (chunks if wanted is None else wanted)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, name_or_path: str):
        self.tokenizer = load(name_or_path)
        self.tokenize = self.tokenizer.model.tokenize
        self.by_chunk = is_byte_level(name_or_path)
        self.cache = Cache()

    def library(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that begins and ends at a border of pre-tokens. Other white space inside it is such a border too."""
        blank, body = ("", chunk[1:]) if chunk[:1] == JOINED else (" ", chunk)
        if PLAIN.match(body):
            mapped = body if body.isascii() else body.encode().decode("latin-1").translate(LETTERS)
            return array("I", [t.id for t in self.tokenize("Ġ" + mapped if blank else mapped)]).tobytes()
        return b"".join([self.library(x) for x in RUNS.findall(blank + body)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one border more than texts). Null counts as empty.

        Each distinct chunk of the batch is looked up once; numpy puts the ids in their places.
        """
        odd, borders, codes, unique, n = split_chunks(texts, every_odd=not self.by_chunk)
        ids = self.cache.all(unique, self.chunk)
        for i, text in odd.items():
            ids[n + i] = self.library(text)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        blob = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        return blob[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])], ends[borders]


def split_chunks(texts: pa.Array, every_odd: bool = False) -> tuple[dict[int, str], np.ndarray, np.ndarray, list[str], int]:
    """Texts cut into chunks whose ids, in a row, are the text's.

    Gives: the texts that can't be cut so, by row, which get one empty chunk; where each text's chunks begin; the number
    of each chunk in the list of distinct ones; that list; and how many of it are not first chunks (then one a row).
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.ones(len(texts), bool) if every_odd else pc.match_substring_regex(texts, ODD_RE2).to_numpy(zero_copy_only=False)
    whole = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(odd)}
    if whole:
        texts = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
    texts = pc.replace_substring_regex(texts, MARKS_RE2, f"\\1 {JOINED}\\2\\3")
    texts = pc.replace_substring_regex(texts, LINE_RE2, f"\\1 {JOINED}\n {JOINED}\\2")
    chunks = pc.split_pattern(texts, " ")
    borders = chunks.offsets.to_numpy()
    words = chunks.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
    borders = borders - borders[0]
    codes = words.indices.to_numpy().astype(np.int64)
    unique = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    first = [JOINED + unique[c] for c in codes[borders[:-1]]]
    codes[borders[:-1]] = len(unique) + np.arange(len(first))
    return whole, borders, codes, unique + first, len(unique)


def pack(ids: list[int]) -> bytes:
    """Ids as bytes; array("I") is 32 bits wide and little-endian on the machines that Spark runs on."""
    return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(name_or_path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(name_or_path)


@contextlib.contextmanager
def encoding(name_or_path: str) -> Iterator[Encoder]:
    """A worker's encoder for the length of a task; its cache ends with the task."""
    own = encoder(name_or_path)
    try:
        yield own
    finally:
        own.cache.clear()
        release()
