"""The pipeline's stages and run(): defined cases, what each keeps, and token ids against the library."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import language_id, mixing, near_dedup, packing
from strandloom.llm.tokens import load
from tests.llm.conftest import frame

STAGE = dict(corpus_pipeline.STAGES)


def corpus(n=60):
    r = random.Random(21)
    words = {"en": ["the", "and", "thing", "nation"], "de": ["der", "und", "rung", "schon"], "fr": ["les", "beau", "quel", "ete"]}
    text = lambda v, k: " ".join(r.choice(words[v]) + str(r.randrange(50)) + r.choice(words[v]) for _ in range(k))
    rows = [(i, text(v, r.randrange(20, 120)), v, f"s{i % 3}") for i in range(n) for v in [list(words)[i % 3]]]
    rows += [(n + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)]  # copies
    return rows + [(n + 10, None, "en", "s0"), (n + 11, "...", None, None)]


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none, odd.unionByName(odd), odd.withColumns({"lang": odd["source"], "source": odd["lang"]})):
            got = stage(spark, docs, "")
            assert got.schema == docs.schema, name
            assert (got.count() > 0) == (docs.count() > 0), name
    assert STAGE["pack_sequences"](spark, none, "").count() == 0
    assert {x["doc_id"] for x in STAGE["pack_sequences"](spark, odd, "").collect()} == {x["doc_id"] for x in odd.collect()}


def test_stages_against_their_operators(spark):
    docs = frame(spark, corpus())
    one = STAGE["identify_languages"](spark, docs, "")
    told = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert {x["doc_id"]: x["lang"] for x in one.collect()} == {i: v for i, v in told.items() if v != "und"}
    two = STAGE["drop_near_duplicates"](spark, one, "")
    assert sorted(x["doc_id"] for x in two.collect()) == sorted({x["class_id"] for x in near_dedup.classes(one).collect()}) == list(range(60))
    three = STAGE["mix_sources"](spark, two, "")
    taken = {x["doc_id"]: x["taken"] for x in mixing.mix(two).collect()}
    got = Counter()
    for x in three.collect():
        got[x["doc_id"]] += len(x["text"].split())
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_run_gives_whole_sequences(spark, tmp_path):
    docs = frame(spark, corpus())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    rows = packed.collect()
    # the texts again, stage by stage
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    tokenizer = load("byte_bpe_50k.json")
    want = Counter()
    for x in docs.collect():
        want[x["doc_id"], np.array([*tokenizer.encode(x["text"], add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces = {}
    for x in rows:
        assert len(x["ids"]) == 4 * x["length"]
        pieces.setdefault((x["doc_id"], x["doc_tokens"]), []).append((x["start"], bytes(x["ids"])))
    assert sum(x["length"] for x in rows) == sum(len(t) // 4 * n for (_, t), n in want.items())
    if all(len(t) <= 4 * packing.CAPACITY for _, t in want):
        assert Counter((x["doc_id"], bytes(x["ids"])) for x in rows) == want
    made = {x["sequence_id"]: x for x in packing.sequences(packed).collect()}
    for sequence in {x["sequence_id"] for x in rows}:
        own = sorted((x for x in rows if x["sequence_id"] == sequence), key=lambda x: x["offset"])
        assert [x["offset"] for x in own] == [sum(y["length"] for y in own[:k]) for k in range(len(own))]
        assert made[sequence]["n_tokens"] == sum(x["length"] for x in own) <= packing.CAPACITY
        assert bytes(made[sequence]["ids"]) == b"".join(bytes(x["ids"]) for x in own) and made[sequence]["doc_ids"] == [x["doc_id"] for x in own]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pieces_with_clashing_names(spark):
    pieces = spark.createDataFrame([(1, 5, "a", "b"), (2, 7, "c", "d")], "i int, length int, offset string, sequence_id string")
    got = packing.pack(pieces, ["i"], 16)
    assert got.columns == ["i", "length", "sequence_id", "offset"] and got.count() == 2


def test_columns_named_as_the_operators_own(spark, odd):
    names = ["__h", "__key", "__no", "__node", "__check", "__i", "__may", "__rest", "__p"]
    clashing = odd
    for k, name in enumerate(names):
        clashing = clashing.withColumn(name, F.lit(k))
    for stage in (near_dedup.deduplicate, mixing.mixed_documents):
        made = stage(clashing)
        assert made.columns == clashing.columns
        rows = made.collect()
        assert rows and all([r[n] for n in names] == list(range(len(names))) for r in rows)
        plain = stage(odd).collect()
        assert sorted(str(r[: len(odd.columns)]) for r in rows) == sorted(str(tuple(r)) for r in plain)


def test_ids_of_other_types(spark, odd):
    texts = odd.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    name = lambda i: None if i is None else f"d{i:04d}"
    want = sorted((str(name(r["doc_id"])), str(name(r["class_id"]))) for r in near_dedup.classes(odd).collect())
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dedup.classes(texts).collect()) == want
    assert sorted(str(r["doc_id"]) for r in near_dedup.deduplicate(texts).collect()) == sorted(str(name(r["doc_id"])) for r in near_dedup.deduplicate(odd).collect())


def test_languages_of_repeated_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text", "lang").limit(100)
    many = docs.crossJoin(spark.range(20)).drop("id")
    told = lambda learned: {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(learned)).collect()}
    assert len(told(many)) > 2
    assert len(told(many.withColumn("doc_id", F.lit(1)))) > 2
    assert told(many.withColumn("doc_id", F.lit(None).cast("long"))) == {"und"}
    # more languages than can be learned: those of most rows
    labelled = docs.withColumn("lang", F.when(F.col("lang") == "en", "en").otherwise(F.concat(F.lit("x"), F.col("doc_id"))))
    lots = labelled.unionByName(spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of a"), F.col("id")).alias("text"), F.concat(F.lit("y"), F.col("id")).alias("lang")))
    assert "en" in told(lots)
