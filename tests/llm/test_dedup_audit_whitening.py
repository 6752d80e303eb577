"""Substring dedup, filter audit and whitening against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from strandloom.llm import filter_audit, substring_dedup, whitening
from strandloom.llm.words import Words
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# words
def test_words_of_texts():
    texts = [None, "", " \n ", "a", " a  bb\tccc ", "ends", "starts", "é 中文　x \x1c", "\x0b\x0c.", "x" * 5000]
    for own in (pa.array(texts), pa.array(["zz zz", *texts]).slice(1)):
        w = Words.of(own)
        code, distinct = w.encoded()
        got = [[distinct[int(c)].as_py().decode() for c in code[a:b]] for a, b in zip(w.borders[:-1], w.borders[1:], strict=True)]
        assert got == [WORD.findall(t or "") for t in texts]
        assert w.joined(np.ones(len(w), bool)).to_pylist() == [" ".join(x) for x in got]
        kept = np.arange(len(w)) % 3 != 1
        want, k = [], 0
        for x in got:
            want.append(" ".join(y for i, y in enumerate(x, k) if i % 3 != 1))
            k += len(x)
        assert w.joined(kept).to_pylist() == want
    assert len(Words.of(pa.array([], pa.string()))) == 0


# substring dedup
def brute_dedup(rows):
    """rows: (id, text); the contract, window by window."""
    key = lambda i: (i is None, i if i is not None else 0)
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            first[x] = min(first.get(x, (key(i), k)), (key(i), k))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (key(i), k):
                gone.update(range(k, k + 20))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), tuple(sorted(gone))))
    return out


def as_brute(rows):
    spans = lambda x: tuple(k for s in x for k in range(s["first"], s["first"] + s["n"]))
    return [(x["doc_id"], x["n_words"], x["n_removed"], x["kept"], spans(x["removed"])) for x in rows]


def passages(seed, n=120):
    """Documents of few words, with passages that many share, at all distances modulo the period."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    shared = [[word() for _ in range(k)] for k in (19, 20, 21, 26, 27, 40, 70, 200)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(60))]
        for _ in range(r.randrange(4)):
            p = r.choice(shared)
            a = r.randrange(max(1, len(p) - 20))
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a : a + r.randrange(18, 60)]
        if r.random() < 0.1:
            w += ["again"] * r.randrange(18, 50)
        rows.append((i * 7 % n, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n + k, rows[3][1]) for k in range(40)]  # a large group of copies
    return rows


@pytest.mark.parametrize("slice_bytes", [300, 5000, 1 << 20])
def test_dedup_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring_dedup, "SLICE", (slice_bytes, slice_bytes))
    monkeypatch.setattr(substring_dedup, "BUCKET", (2000, 2000))
    rows = passages(slice_bytes)
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)
    got = as_brute(substring_dedup.remove_repeats(docs).collect())
    assert sorted(got) == sorted(brute_dedup(rows)) and sum(x[2] for x in got) > 500


def test_dedup_of_odd_rows(spark, odd, odd_rows, none):
    got = as_brute(substring_dedup.remove_repeats(odd).collect())
    assert sorted(map(str, got)) == sorted(map(str, brute_dedup([(i, t) for i, t, *_ in odd_rows])))
    assert substring_dedup.remove_repeats(none).collect() == []
    # ids that repeat, null and text ids; columns named as those of the result
    t = " ".join(f"a{k}" for k in range(30))
    rows = [("b", t), ("a", "x " + t), (None, t + " y"), (None, "z z " + t), ("b", t), ("c", " ".join(t.split()[:19]))]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id string, text string, slice int, removed int")
    key = {"a": 0, "b": 1, "c": 2, None: None}
    want = [(i, *x[1:]) for (i, _), x in zip(rows, brute_dedup([(key[i], x) for i, x in rows]), strict=True)]
    assert sorted(map(str, as_brute(substring_dedup.remove_repeats(docs).collect()))) == sorted(map(str, want))


def test_cover_has_all_differences():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))
    assert substring_dedup.ANCHOR + p - 1 == substring_dedup.WINDOW


# filter audit
def brute_masks(rows):
    """rows: (id, text, lang); (lang, letters that fail) of each."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        copy = t in least and (i is None or least[t] < i)
        out.append((lang or "", {n for n, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if f}))
    return out


def brute_audit(rows, good, toxic):
    found = brute_masks(rows)
    steps, shapley = {}, Counter()
    for part in {p for p, _ in found}:
        own = [(f, i) for (p, f), (i, *_) in zip(found, rows, strict=True) if p == part]
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                before = set(order[:k])
                gone = [i for f, i in own if letter in f and not f & before]
                shapley[part, letter] += len(gone)
                steps[part, order, k + 1] = (
                    sum(not f & before and letter not in f for f, _ in own), len(gone), sum(letter in f and bool(f & before) for f, _ in own),
                    sum(f == {letter} for f, _ in own), sum(i in good for i in gone), sum(i in toxic for i in gone),
                )
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in steps.items()}


def audited(spark, docs, labels):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.audit(filter_audit.cells(docs, labels)).select(*names).collect()
    assert len(rows) == len({r[:3] for r in rows})
    return {tuple(r) for r in rows}


LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def test_audit_against_brute_force(spark, odd, odd_rows, none):
    r = random.Random(8)
    words = ["The", "CAPS", "a", "b$", "c", *[f"w{k}" for k in range(300)]]
    text = lambda: " ".join(r.choice(words[: r.choice((3, 6, 300))]) for _ in range(r.choice((0, 5, 199, 200, 201, 600))))
    texts = [text() for _ in range(60)] + ["É" * 33 + "A", "É" * 32 + "A", " ".join(f"v{k % 100}" for k in range(200)), " ".join(f"v{k % 99}" for k in range(200))]
    rows = [(i * 11 % 191, r.choice(texts), r.choice(["en", "fr", None, ""]), "a") for i in range(150)]
    marks = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x", 1) for i in range(0, 191, 2)] + [(None, 1, 1, "x", 1)]
    good, toxic = ({m[0] for m in marks if m[k] == 1 and m[0] is not None} for k in (1, 2))
    labels = spark.createDataFrame(marks, LABELS)
    assert audited(spark, frame(spark, rows).repartition(7), labels) == brute_audit([x[:3] for x in rows], good, toxic)
    doubled = spark.createDataFrame([*marks, (9, 0, 1, "x", 1), (9, 1, 0, "x", 1)], LABELS)
    assert audited(spark, odd, doubled) == brute_audit([x[:3] for x in odd_rows], good | {9}, toxic | {9})
    assert audited(spark, odd, labels.limit(0)) == brute_audit([x[:3] for x in odd_rows], set(), set())
    assert audited(spark, none, labels) == set()


# whitening
SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("n", StringType()), StructField("v", IntegerType()), StructField("whitened", IntegerType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)


def exact(rows):
    """(x, sums, covariance as fractions) of the rows that take part."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x, strict=True)]
    y = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    cov = [[Fraction(sum(row[i] * row[j] for row in y), n**3) for j in range(d)] for i in range(d)]
    return x, s, y, cov


def test_whitening_against_fractions(spark):
    r = np.random.default_rng(4)
    basis = r.normal(size=(40, 40)) * np.geomspace(20, 0.05, 40)
    good = [(int(i), v.tolist()) for i, v in enumerate(r.normal(size=(300, 40)) @ basis)]
    odd = [(900, None), (901, [1.0] * 39 + [None]), (902, [float("nan")] * 40), (903, [float("inf")] * 40)]
    good += [good[5], (None, good[7][1])]
    rows = whitening.long_form(whitening.whiten(vectors(spark, good + odd).repartition(5))).collect()
    x, s, y, cov = exact(good)
    assert len(rows) == len(good) * 32 and {q["n"] for q in rows} == {len(good)}
    value, vector = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    value, vector = value[::-1], vector[:, ::-1]
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(40)])
    want = (np.array(y, float) / len(good)) @ vector[:, :32] / np.sqrt(value[:32])
    by_id = defaultdict(list)
    for q in rows:
        by_id[q["vec_id"]].append(q)
    for (i, _), row, w in zip(good, y, want, strict=True):
        own = sorted(by_id[i], key=lambda q: q["component"])[:: 2 if i == 5 else 1]
        assert [q["component"] for q in own] == list(range(1, 33)) and {int(q["deviation"]) for q in own} == {sum(a * a for a in row)}
        assert [q["whitened"] for q in own] == pytest.approx(w.tolist(), rel=1e-6, abs=1e-7)
        assert [q["explained"] for q in own] == pytest.approx((value[:32] / value.sum()).tolist(), rel=1e-9)
    assert max(q["identity_error"] for q in rows) < 1e-9


def test_digit_slices_are_exact():
    r = np.random.default_rng(5)
    for most in (1, 1 << 15, 1 << 31, 1 << 61):
        y = r.integers(-most, most, size=(50, 4), endpoint=True)
        parts = whitening.limbs(y)
        assert (sum(p.astype(np.int64).astype(object) << (16 * k) for k, p in enumerate(parts)) == y.astype(object)).all()
        held = whitening.Products(4)
        for k in range(0, 50, 7):
            held.add(y[k : k + 7])
        assert (held.flush() == y.astype(object).T @ y.astype(object)).all()
    big = y.astype(object) * (1 << 30)
    held = whitening.Products(4)
    held.add(big)
    assert (held.flush() == big.T @ big).all()
    for v in (0, 1, -1, (1 << 200) + 12345, -(1 << 210) - 1):
        assert sum(d << (40 * k) for k, d in enumerate(whitening.digits(v))) == v


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    flat = whitening.long_form(whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])]))).collect()
    assert sorted((q["vec_id"], q["component"], abs(q["whitened"]), q["explained"], q["identity_error"]) for q in flat) == [(1, 1, 1.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 1.0), (2, 1, 1.0, 1.0, 1.0), (2, 2, 0.0, 0.0, 1.0)]
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25])])).collect()
    assert len(one) == 1 and one[0]["whitened"] == [0.0, 0.0] and int(one[0]["deviation"]) == 0
    large = whitening.whiten(vectors(spark, [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [5e14, 4.0])])).collect()
    x = {1: 64 * 10**15, 2: -64 * 10**15, 3: 32 * 10**15}
    second, total = {1: 64, 2: 128, 3: 256}, sum(x.values())
    assert {q["vec_id"]: int(q["deviation"]) for q in large} == {k: (3 * x[k] - total) ** 2 + (3 * second[k] - 448) ** 2 for k in x}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_kept_text_digest(spark):
    from strandloom.llm import queries

    found = {r["doc_id"]: r for r in queries.op11_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i, n, gone, kept, _ in brute_dedup(rows):
        assert tuple(found[i]) == (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
