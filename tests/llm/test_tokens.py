"""Token operators against the library."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from strandloom.llm import packing, token_counts, token_files
from strandloom.llm.tokens import encoder, load

NAME = "byte_bpe_50k.json"
ALPHABET = st.sampled_from([*"aab'stthe .,\n\t\r\x0b\x1c\x85\xa0　é中1²३", "<|endoftext|>", " the", ", ", ".\n", "\x01", "ab,", "!! ", "aaaaaaa"])


def ids(text):
    return load(NAME).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=20).map("".join), max_size=5))
def test_chunks_give_the_library_s_ids(texts):
    flat, ends = encoder(NAME).batch(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ids(t) for t in texts]
    assert token_counts.count_batch(NAME, pa.array(texts, pa.string())).tolist() == [len(ids(t)) for t in texts]


def test_merges_give_the_library_s_ids():
    words = ["hello", " thonre", "aaaaaaaaaaa", "ababababab", "x"]
    assert token_counts.RankMerges(NAME).ids([w.encode() for w in words]) == [ids(w) for w in words]


def test_other_tokenizers():
    import sentencepiece

    texts = pa.array(["Hello there", "", None, "éa"])
    from strandloom.llm.tokens import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert token_counts.count_batch("piece_bpe_32k.model", texts).tolist() == [len(sp.encode(t or "")) for t in texts.to_pylist()]
    t = load("word_bpe_49k.json")
    assert token_counts.count_batch("word_bpe_49k.json", texts).tolist() == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts.to_pylist()]


def test_counts(odd, odd_rows, none):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(ids(t))) for i, t, *_ in odd_rows)
    assert token_counts.count_tokens(none).count() == 0


def test_files_round_trip(spark, odd, odd_rows, none):
    path = token_files.write_token_files(odd)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_token_files(spark, path).collect()))
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
    keys = [-1 if g[1] is None else g[1] for g in got]
    assert keys == sorted(keys)
    want = sorted((str(i), np.array([*ids(t), 0], "<u4").tobytes()) for i, t, *_ in odd_rows)
    assert sorted((str(g[1]), g[3]) for g in got) == want
    one = token_files.read_token_files(spark, path, [9]).collect()
    assert len(one) == 2 and {r["doc_id"] for r in one} == {9}
    assert token_files.read_token_files(spark, token_files.write_token_files(none)).count() == 0


def test_files_use_a_dictionary(spark):
    from tests.llm.conftest import frame

    docs = frame(spark, [(i, f"document number {i} says the same thing again and again {i % 7}" * 3, "en", "a") for i in range(300)])
    path = token_files.write_token_files(docs)
    assert len(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]) > 0
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_token_files(spark, path).collect()}
    assert all(got[i] == np.array([*ids(f"document number {i} says the same thing again and again {i % 7}" * 3), 0], "<u4").tobytes() for i in range(300))


def test_histogram_packing():
    import random
    from collections import Counter

    r = random.Random(3)
    h = Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(20_000))
    patterns = packing.pack_histogram(dict(h))
    placed = Counter()
    for n, p in patterns:
        assert n > 0 and sum(p) <= 2048
        for x in p:
            placed[x] += n
    assert placed == h
    assert sum(k * v for k, v in h.items()) / (2048 * sum(n for n, _ in patterns)) > 0.99
    assert packing.pack_histogram({}) == []


def test_packing(odd, odd_rows, none):
    rows = packing.pack_documents(odd).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and sorted(at) == list(range(len(at)))
    want = []
    for i, t, *_ in odd_rows:
        x, a = [*ids(t), 1], 0
        for n in packing.piece_lengths(len(x)):
            want.append((str(i), a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()), len(x)))
            a += n
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)
    assert packing.pack_documents(none).count() == 0
