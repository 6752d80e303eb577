"""Mixing, near duplicates, languages, licenses, scores and fingerprints against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import fingerprints, language_id, license_scan, lm_scoring, mixing, near_dedup
from tests.llm.conftest import frame


# mixing
def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([300 * 5 / 8, 75, 37.5])
    got = mixing.targets([10, 1000, 1000])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 5]) == pytest.approx([0, 5])


def test_permutation():
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 99)) == list(range(n))
    assert not (mixing.permute(np.arange(1000), 1000, 1) == mixing.permute(np.arange(1000), 1000, 2)).all()


def test_places_and_slots():
    for n in (1, 2, 3, 64, 1000):
        image = mixing.permute(np.arange(n), n, 5)
        assert all(mixing.place_of(int(image[k]), n, 5) == k for k in range(0, n, 7))
    for size in (1, 5, 63, 64, 65, 640, 1000):
        n = -(-size // 64)
        of = lambda b: size - (n - 1) * 64 if b == n - 1 else 64  # noqa: B023, E731
        for wanted in sorted({0, 1, size // 3, size - 1, size, size + 1, 2 * size - 7, 3 * size}):
            if wanted < 0:
                continue
            slots, last = mixing.slots_for(wanted, size, 4, 77, 64)
            blocks = [int(mixing.permute(np.array([j % n]), n, mixing.key_of(77, 4, j // n))[0]) for j in range(slots)]
            assert sum(map(of, blocks[:-1])) + last == wanted and (not slots or 0 < last <= of(blocks[-1]))


def brute_mix(rows, sizes):
    """Words taken of each row: blocks are filled, slots drawn and blocks joined in plain Python, from the operator's places of words."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["sid"]].append(r)
    taken = Counter()
    for sid, own in by_source.items():
        own.sort(key=lambda r: r["first_word"])
        words = [(r["bucket"], r["rid"]) for r in own for _ in range(r["size"])]
        assert [r["first_word"] for r in own] == [sum(x["size"] for x in own[:k]) for k in range(len(own))]
        blocks = [words[k : k + 64] for k in range(0, len(words), 64)]
        slots, last = mixing.slots_for(min(round(own[0]["target"]), 3 * len(words)), len(words), sid, mixing.SEED, 64)
        for j in range(slots):
            block = blocks[int(mixing.permute(np.array([j % len(blocks)]), len(blocks), mixing.key_of(mixing.SEED, sid, j // len(blocks)))[0])]
            taken.update((sid, *w) for w in (block[:last] if j == slots - 1 else block))
    return taken


def test_mix_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    r = random.Random(3)
    docs = frame(spark, [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(300))), "en", f"s{min(i % 9, 4)}") for i in range(150)])
    rows, slots = mixing.plan(docs)
    held = rows.collect()
    want = brute_mix(held, None)
    parts = mixing.mixed_parts(*mixing.plan(docs)).collect()
    got = Counter()
    for x in parts:
        got[x["sid"], x["bucket"], x["rid"]] += x["words"]
    assert +got == +want
    # the draw is seen: each slot is once in the mix, in the shard that it was drawn for
    placed = {(x["sid"], x["slot"]): x["shard"] for x in slots.collect()}
    assert {(x["sid"], x["slot"]): x["shard"] for x in parts if x["words"]} == placed and len(set(placed.values())) > 4
    mixed = mixing.mix(docs).collect()
    assert {s for x in mixed for s in x["shards"]} == set(placed.values())
    for source in {x["source"] for x in mixed}:
        own = [x for x in mixed if x["source"] == source]
        assert sum(x["taken"] for x in own) == round(own[0]["target"])


def test_mix_meets_small_targets(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j", "en", "x"), (2, "k l", "en", "y"), (3, " ".join("w" * 300), "en", "z")])
    got = {x["source"]: x for x in mixing.mix(docs).collect()}
    assert all(x["taken"] == round(x["target"]) for x in got.values())
    narrow = docs.withColumn("n_chars", docs["n_chars"].cast("int"))
    assert mixing.mixed_documents(narrow).schema == narrow.schema and mixing.mixed_documents(narrow).count() > 0


def test_draws_meet_the_wanted_sums():
    d = mixing.draw([1000, 10, 0, 500], 16, 3)
    assert d.sum(axis=0).tolist() == [1000, 10, 0, 500] and (d >= 0).all() and len(set(d[:, 0])) > 1


def test_mix(spark, odd, odd_rows, none):
    r = random.Random(2)
    docs = frame(spark, [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(400))), "en", f"s{i % 4}") for i in range(200)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 200 and all(x["taken"] <= 3 * x["size"] for x in rows)
    for s in {x["source"] for x in rows}:
        own = [x for x in rows if x["source"] == s]
        assert sum(x["size"] for x in own) == own[0]["source_size"]
        assert sum(x["taken"] for x in own) == round(own[0]["target"])
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    got = mixing.mix(odd).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(x["doc_id"]), x["size"]) for x in got) == sorted((str(i), count(t)) for i, t, *_ in odd_rows)
    assert mixing.mix(none).count() == 0


def test_mixed_documents_hold_the_taken_words(spark, odd, none):
    taken = Counter()
    for x in mixing.mix(odd).collect():
        taken[x["doc_id"]] += x["taken"]
    made = mixing.mixed_documents(odd)
    assert made.columns == odd.columns
    got = Counter()
    for x in made.collect():
        got[x["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", x["text"]))
        assert x["n_chars"] == len(x["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_documents(none).count() == 0


# near duplicates
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {text or ""}


def brute_classes(rows):
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [sets(r[1]) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            n = len(s[a] & s[b])
            if 5 * n >= 4 * (len(s[a]) + len(s[b]) - n):
                parent[top(a)] = top(b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r[0])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(rows))]


def near_rows():
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randrange(60, 200))]
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w), "en", "a"))
    base = [r.choice(vocab) for _ in range(150)]
    for _ in range(60):  # one large group of near copies
        w = list(base)
        w[r.randrange(150)] = r.choice(vocab)
        w[r.randrange(150)] = r.choice(vocab)
        rows.append((len(rows), " ".join(w), "en", "a"))
    rows += [(len(rows) + k, "exactly the same words in every one of these", "en", "a") for k in range(20)]
    return rows


def test_near_classes(spark):
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows)).collect()}
    want = dict(zip([r[0] for r in rows], brute_classes(rows)))
    assert got == want
    kept = near_dedup.deduplicate(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_classes_of_large_buckets(spark):
    """Pairs that are linked to no other, in buckets of many more nodes than a chunk."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    edited = lambda w, at: [f"e{r.randrange(10**9)}" if k in at else x for k, x in enumerate(w)]
    apart = lambda n: [4 + 8 * k for k in r.sample(range(24), n)]
    rows = []
    for _ in range(200):
        at = apart(6)
        both = edited(base, at[:2])
        rows += [(len(rows) + k, " ".join(edited(both, at[2 + 2 * k : 4 + 2 * k])), "en", "a") for k in range(2)]
    want = brute_classes(rows)
    assert len(set(want)) > 190
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == dict(zip([x[0] for x in rows], want))


def test_near_classes_of_repeated_passages(spark):
    """Texts with the same distinct shingles, some of which come far more often in one."""
    r = random.Random(13)
    w = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    rows = []
    for _ in range(6):
        own, line = w(300), w(10)
        rows += [(len(rows) + k, " ".join([own, *[line] * n]), "en", "a") for k, n in enumerate((1000, 10))]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, *_ in rows}


def test_near_classes_by_either_weights(spark):
    """Pairs of which one similarity alone is large enough; brute force over both."""
    r = random.Random(14)
    w = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    rows = []
    for _ in range(8):
        line, a, b = w(12), w(40), w(40)
        rows += [(len(rows) + k, " ".join([x, *[line] * 40]), "en", "a") for k, x in enumerate((a, b))]  # alike by counts
        own, line = w(80), w(30)
        rows += [(len(rows) + k, " ".join([own, *[line] * n]), "en", "a") for k, n in enumerate((60, 1))]  # alike by distinct shingles

    def brute(x, y):
        x, y = (Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in (x, y))
        both = [k for k in x if k in y]
        weighted = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in both)
        return len(both) / len({*x, *y}), weighted

    got = {q["doc_id"]: q["class_id"] for q in near_dedup.classes(frame(spark, rows)).collect()}
    for i in range(0, len(rows), 2):
        even, weighted = brute(rows[i][1], rows[i + 1][1])
        assert (even < 0.8 <= weighted) if i % 4 == 0 else (weighted < 0.8 <= even)
    assert got == {i: i - i % 2 for i, *_ in rows}


def test_probability_jaccard_and_its_bound():
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(2))
        wx, wy = (r.integers(1, 6, len(v)).astype(float) for v in (x, y))
        a, b = dict(zip(x.tolist(), wx)), dict(zip(y.tolist(), wy))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
        assert near_dedup.probability_jaccard(x, wx, y, wy) == pytest.approx(want)
        assert want <= min(sum(a[i] for i in a if i in b) / wx.sum(), sum(b[i] for i in a if i in b) / wy.sum()) + 1e-9


def test_near_classes_where_names_are_shared(spark):
    """Names of 4 bits: texts of different words that have one name are told apart by the other half of the digest."""
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows), bits=4).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_classes(rows)))


def test_shared_counts():
    r = np.random.default_rng(3)
    sets_ = [np.unique(r.integers(0, 90, r.integers(1, 60)).astype(np.uint64)) for _ in range(40)] + [np.arange(10_000, 20_000, dtype=np.uint64)] * 2 + [np.arange(9_000, 15_000, 2, dtype=np.uint64)]
    left, right = np.arange(0, 43, 2), np.arange(1, 43, 2)
    of, code = np.repeat(np.arange(43), [len(x) for x in sets_]), np.concatenate(sets_)
    got = near_dedup.shared_counts(of, code, 43, left, right)[0]
    assert got.tolist() == [[len(np.intersect1d(sets_[a], sets_[b])) for b in right] for a in left]
    weight = r.integers(1, 9, len(code)).astype(float)
    own = {(int(i), int(c)): w for i, c, w in zip(of, code, weight)}
    again, in_left, in_right = near_dedup.shared_counts(of, code, 43, left, right, weight)
    assert (again == got).all()
    for m, pick in ((in_left, 0), (in_right, 1)):
        assert m.tolist() == [[sum(own[(int((a, b)[pick]), int(c))] for c in np.intersect1d(sets_[a], sets_[b])) for b in right] for a in left]


def test_near_classes_of_odd_rows(odd, odd_rows, none):
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.classes(odd).collect())
    assert got == sorted((str(r[0]), str(c)) for r, c in zip(odd_rows, brute_classes(odd_rows)))
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(map(str, brute_classes(odd_rows))))
    assert near_dedup.deduplicate(none).count() == 0


def test_sketch_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
    wa, wb = r.integers(1, 5, len(a)).astype(float), r.integers(1, 5, len(a)).astype(float)
    true = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(len(a)))
    of = np.zeros(len(a), np.int64)
    m = 4096
    x, y = near_dedup.sketch(1, of, a, wa, m), near_dedup.sketch(1, of, a, wb, m)
    assert abs((x == y).mean() - true) < 0.04


# languages
def test_languages(spark, odd, none):
    r = random.Random(4)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["der", "und", "ung", "sch"], "fr": ["les", "eau", "que", "é"], "es": ["los", "ción", "que", "ñ"]}
    rows = [(i, " ".join(r.choice(parts[v]) + r.choice(parts[v]) for _ in range(20)), v, "a") for i in range(400) for v in [list(parts)[i % 4]]]
    docs = frame(spark, rows)
    model = language_id.fit(docs)
    assert set(model.families) == {"germanic", "romance"} and len(model.of_pair) == 2
    held = [(i, v) for i, _, v, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.predict(docs, model).collect()}
    assert np.mean([got[i][0] == v for i, v in held]) > 0.95 and all(0 <= s <= 1 for _, s in got.values())
    by = [(x["doc_id"], x["lang_pred"], x["score"]) for x in language_id.predict(odd, model).collect()]
    assert {i for i, v, _ in by if v == "und"} == {1, 2, 3, 4} and len(by) == odd.count()
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert sorted((str(x["doc_id"]), x["lang"]) for x in kept.collect()) == sorted((str(i), v) for i, v, _ in by if v != "und")
    empty = language_id.fit(none)
    assert {x["lang_pred"] for x in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_predictions_are_those_of_each_machine(spark):
    """The matrix form against the definition, text by text."""
    r = random.Random(11)
    parts = {"en": ["the", "and", "ing"], "de": ["der", "und", "sch"], "nl": ["het", "een", "ij"], "fr": ["les", "eau", "que"], "es": ["los", "cion", "ñ"], "it": ["gli", "zione", "che"]}
    langs = [list(parts)[i % 6] for i in range(240)]
    texts = ["".join(r.choice(parts[v]) + r.choice(["", " "]) for _ in range(15)) for v in langs]
    model = language_id.Model.fit(np.stack([np.append(language_id.features(t), np.float32(1)) for t in texts]), langs)
    x = language_id.features(texts[0])
    back = np.zeros_like(x)
    language_id.unpacked(language_id.packed(x), back)
    assert (back == x).all()
    got, scores = model.predict([*texts, None, "12 ."])
    assert got[-2:] == ["und", "und"] and list(scores[-2:]) == [0, 0]
    for t, lang, score in zip(texts, got, scores):
        x = language_id.features(t)
        margin = lambda w: float(w[:-1] @ x + w[-1])  # noqa: B023, E731
        family = max(sorted(model.families), key=lambda f: margin(model.of_family[f]))  # noqa: B023
        duels = {v: [margin(w) * (1 if v == a else -1) for (a, b), w in model.of_pair.items() if v in (a, b)] for v in model.families[family]}
        best = max(sorted(duels), key=lambda v: (sum(m >= 0 for m in duels[v]), sum(duels[v])))
        chance = lambda m: 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * m))))
        assert lang == best and score == pytest.approx(chance(margin(model.of_family[family])) * (chance(min(duels[best])) if duels[best] else 1), abs=1e-4)


# licenses
def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in places}))


def test_licenses(spark, odd, odd_rows, none):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "MIT License mit license MIT-LICENSE", "cc by cc by cc", "CC BY-NC 4.0 licensed under cc by nc 4.0", "GNU General Public License",
        "gnu general x public license", "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files", "all rights reserved", "mİt license",
    ]
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(texts)]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in got) == sorted((str(i), a, b, str(c), str(d), e) for i, t, *_ in rows for a, b, c, d, e in [brute_base(t)])
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[106] == "mit" and labels[107] == "all-rights-reserved" and labels[100] == "apache,apache-2.0" and labels[105] == ""
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan(none).count() == 0
    assert not any("k" in t for t in [*license_scan.BASE, *license_scan.SENTENCES])


# language model
def test_licenses_in_a_row(spark):
    docs = frame(spark, [(n, " ".join(["x", *["all rights reserved"] * n, "y"]), "en", "a") for n in range(6)])
    got = {x["doc_id"]: (x["labels"], x["score"], x["n_base"]) for x in license_scan.scan(docs).collect()}
    assert got == {n: ("all-rights-reserved", 1.0, 0) if n else ("", 0.0, 0) for n in range(6)}


def test_scores(odd, odd_rows, none):
    got = lm_scoring.score(odd).collect()
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, *_ in odd_rows]
    words = [(t or "").encode().lower().split() for _, t, *_ in odd_rows]
    c, ends = Counter(), sum(train)
    for a, w in zip(train, words):
        if a:
            c.update(w)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((str(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 6)) for (i, *_), w in zip(odd_rows, words))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score(none).count() == 0


def segmentations(lat, s, i=0):
    """All ways to make s[i:] of pieces: tuples of piece numbers; characters that are no piece take their bytes' pieces."""
    at = {p: k for k, p in enumerate(lat.pieces)}
    if i == len(s):
        yield ()
        return
    if s[i] not in at:
        for rest in segmentations(lat, s, i + 1):
            yield (*(lat.bytes[b] for b in s[i].encode()), *rest)
    for j in range(i + 1, len(s) + 1):
        if s[i:j] in at:
            for rest in segmentations(lat, s, j):
                yield (at[s[i:j]], *rest)


def chance_of(lat, pieces):
    return math.exp(lat.first[pieces[0]] + sum(lat.go + lat.rest[p] for p in pieces[1:]) + lat.stop)


def small_lattice():
    pieces = [lm_scoring.MARK, "a", "b", "ab", "ba", lm_scoring.MARK + "a", lm_scoring.MARK + "ba"] + [f"\0<{b}>" for b in range(256)]
    return lm_scoring.Lattice(pieces, {b: 7 + b for b in range(256)}, np.log(np.arange(1, len(pieces) + 1) ** -1.3))


def test_lattice_sums_all_segmentations():
    lat = lm_scoring.lattice("piece_bpe_32k.model", None)
    words = ["the", "thonre", "é中x", "a"]
    for own in (lat, small_lattice()):
        assert own.log_marginals(words) == pytest.approx([math.log(sum(chance_of(own, s) for s in segmentations(own, lm_scoring.MARK + w))) for w in words])
    assert np.isfinite(lat.log_marginals(["x" * 5000, "𝔘\0"])).all()
    assert np.exp(lat.first).sum() == pytest.approx(1) and np.exp(lat.rest).sum() == pytest.approx(1) and math.exp(lat.go) + math.exp(lat.stop) == pytest.approx(1)


def test_expected_counts_and_the_fit():
    lat = small_lattice()
    words, counts = ["ab", "bab", "aé", "b"], np.array([3, 1, 2, 5])
    want = np.zeros((2, len(lat.pieces)))
    for w, c in zip(words, counts):
        each = list(segmentations(lat, lm_scoring.MARK + w))
        p = np.array([chance_of(lat, s) for s in each])
        for s, share in zip(each, c * p / p.sum()):
            want[0, s[0]] += share
            for k in s[1:]:
                want[1, k] += share
    got = lat.expected(words, counts)
    assert got == pytest.approx(want)
    fit = lm_scoring.Lattice(lat.pieces, lat.bytes, lat.rest, lm_scoring.fitted(lat, got))
    assert np.exp(fit.first).sum() == pytest.approx(1) and np.exp(fit.rest).sum() == pytest.approx(1)
    assert (fit.log_marginals(words) * counts).sum() > (lat.log_marginals(words) * counts).sum()
    # words of a and b alone, by length: their sums never pass 1
    total = sum(math.exp(v) for n in range(9) for v in fit.log_marginals(["".join("ab"[k >> i & 1] for i in range(n)) for k in range(1 << n)]))
    assert 0.3 < total <= 1


def test_scores_are_sums_over_words(odd, odd_rows):
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, *_ in odd_rows]
    words = [(t or "").encode().lower().replace(b"\x1c", b"\x1c").split() for _, t, *_ in odd_rows]
    c = Counter(x.decode() for a, w in zip(train, words) if a for x in w)
    start = lm_scoring.lattice("piece_bpe_32k.model", None)
    lat = lm_scoring.Lattice(start.pieces, start.bytes, start.rest, lm_scoring.fitted(start, np.round(start.expected(list(c), np.array(list(c.values()))), 3)))
    share = (sum(train) + 1) / (sum(c.values()) + sum(train) + 2)
    want = sorted((str(i), round((lat.log_marginals([x.decode() for x in w]).sum() + len(w) * math.log(1 - share) + math.log(share)) / math.log(10), 4)) for (i, *_), w in zip(odd_rows, words))
    got = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in lm_scoring.score(odd).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-3)


# fingerprints
def brute_anchors(text):
    import xxhash

    def h64(data, seed=42):
        v = xxhash.xxh64_intdigest(data, seed)
        return v - 2**64 if v >= 2**63 else v

    def long2(a, b):
        return h64(b.to_bytes(8, "little", signed=True), h64(a.to_bytes(8, "little", signed=True)) % 2**64)

    w = [h64(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if len(w) < 5:
        return None
    s = [long2(a, b) for a, b in zip(w, w[1:])]
    out = {}
    for i in range(len(s) - 3):
        if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2]):
            h = long2(long2(s[i], s[i + 3]), s[i + 1]) & ((1 << 40) - 1)
            out.setdefault(h, i)
    return sorted(h << 22 | p for h, p in out.items())[:32]


def test_fingerprints(spark, odd, odd_rows, none):
    got = fingerprints.compare_with_next(odd).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        want.append((str(i), n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    marks = {r["doc_id"]: r["fingerprint"] for r in got}
    for i, t, *_ in odd_rows:
        if i not in (9, 10) and (own := brute_anchors(t or "")) is not None:
            assert marks[i] == "".join(f"{v:016x}" for v in own)
    by = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[7] == by[8] and len(by[10]) == 1
    assert fingerprints.compare_with_next(none).count() == 0
    assert fingerprints.compare_with_next(odd.where("doc_id = 6")).first()["near_next"] == 1.0


def test_fingerprints_see_shared_passages(spark):
    r = random.Random(6)
    w = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    a, b = w(400), w(400)
    df = spark.createDataFrame([(" ".join(a), " ".join(["new", *a]), " ".join(b))], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.anchors(df, c, f"k{c}")
    df = fingerprints.likeness(fingerprints.likeness(fingerprints.likeness(df, "ka", "ka", "same"), "ka", "kb", "near"), "ka", "kc", "far")
    x = df.first()
    assert x["same"] == 1 and x["near"] > 0.9 and x["far"] < 0.1


def test_likeness_of_passages_in_long_texts(spark):
    r = random.Random(9)
    w = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    shared = w(300)
    texts = [" ".join([*w(4000), *shared, *w(5700)]), " ".join([*w(9000), *shared, *w(700)])]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    for c in "ab":
        df = fingerprints.anchors(df, c, f"k{c}")
    x = fingerprints.likeness(df, "ka", "kb", "near").first()
    ka, kb = ({v >> 22 for v in x[k]} for k in ("ka", "kb"))
    both = ka & kb
    assert len(ka) > 4000 and len(both) > 100
    assert x["near"] == pytest.approx(len(both) / len(ka | kb))
    rows = fingerprints.compare_with_next(frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert {q["doc_id"]: q["anchors"] for q in rows} == {0: x["ka"], 1: x["kb"]} and all(q["near_next"] == x["near"] for q in rows)


def test_anchors_of_short_texts(spark):
    rows = [(" ".join(f"x{k}n{n}y{i}" for i in range(n)), n) for n in range(1, 9) for k in range(20)]
    df = fingerprints.anchors(spark.createDataFrame([*rows, ("", 0)], "t string, n int"), "t", "k")
    found = df.collect()
    assert all((len(x["k"]) > 0) == (x["n"] > 0) for x in found)
    assert len({tuple(x["k"]) for x in found}) == len(found)
