"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text's words are hashed; a k-mer is WORDS words in a row, and its inner substrings are the pairs of words in a row. A
k-mer is an anchor (a closed syncmer) if the least of its inner substrings' hashes is the first or the last one. That
depends on the k-mer alone, so a passage has the same anchors wherever it stands. An anchor is one number: 40 bits of
the k-mer's hash and 22 bits of its place, the word it begins at. All anchors of a text are kept (of one that comes more
than once, the first place). A fingerprint is a short form for display and for equality: the KEPT anchors of least hash,
written as 16 hexadecimal digits each. No likeness goes by it.

Likeness of two texts: of all their anchors together, the share that both have at places that agree, that is, whose
shift differs from the median shift by SLACK words at most.

The edited text of a document takes half of the next one, by ascending id. Documents are dealt into ranges of ids
between quantiles of the id column, and each range gets a copy of the first row of the range after it, so that a
range's last row sees its next one and no task has to hold the table.

Defined cases: a null text is empty; a text that has words and no closed syncmer has one anchor, of all its words, and one
without words has none; equal anchors are alike 1; null ids come first, repeated ids are ordered by text; a table
of one row is its own next; other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import clip

WORDS, KEPT, SLACK = 5, 32, 24
PLACE_BITS, HASH_MASK = 22, (1 << 40) - 1
WORD = r"([^\x20\x09-\x0D]+)"
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1000, 16384
NULL_ID = -(1 << 63)


def anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with all anchors of a text, an ascending array of numbers."""
    pair = lambda a, b: F.xxhash64(a, b)
    coded = lambda h, p: F.shiftleft(h.bitwiseAND(F.lit(HASH_MASK)), PLACE_BITS).bitwiseOR(F.least(p, F.lit((1 << PLACE_BITS) - 1)).cast("long"))
    df = df.withColumn("__w", F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(1)), lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("__w") - 1, F.lit(0))
    df = df.withColumn("__s", F.zip_with(F.slice("__w", F.lit(1), n), F.slice("__w", F.lit(2), n), pair))
    last = WORDS - 2  # inner substrings of a k-mer are numbered 0 to last
    rest = F.greatest(F.size("__s") - last, F.lit(0))
    ends = F.zip_with(F.slice("__s", F.lit(1), rest), F.slice("__s", F.lit(1 + last), rest), lambda a, b: F.struct(F.least(a, b).alias("e"), pair(a, b).alias("h")))
    middle = F.zip_with(F.slice("__s", F.lit(2), rest), F.slice("__s", F.lit(3), rest), lambda a, b: F.struct(F.least(a, b).alias("m"), a.alias("a")))
    # the k-mer's words are those of its first, its second and its last inner substring; h is of the outer two, a is the second
    marked = F.zip_with(ends, middle, lambda x, y: F.when(x["e"] <= y["m"], pair(x["h"], y["a"])))
    placed = F.filter(F.transform(marked, coded), lambda x: x.isNotNull())
    whole = F.array(coded(F.xxhash64("__w"), F.lit(0)))
    df = df.withColumn("__v", F.sort_array(F.when(F.size(placed) > 0, placed).when(F.size("__w") > 0, whole).otherwise(F.slice(whole, 1, 0))))
    hash_of = lambda v: F.shiftright(v, PLACE_BITS)
    fresh = F.filter("__v", lambda v, i: (i == 0) | (hash_of(v) != hash_of(F.get("__v", i - 1))))
    return df.withColumn(out, fresh).drop("__w", "__s", "__v")


def written(kept: Column) -> Column:
    """The fingerprint: the anchors of least hash."""
    return F.array_join(F.transform(F.slice(kept, 1, KEPT), lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def read(fingerprint: Column) -> Column:
    """The anchors of a written fingerprint."""
    n = F.floor(F.length(fingerprint) / 16).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substr(fingerprint, (i - 1) * 16 + 1, F.lit(16)), 16, 10).cast("long"))
    return F.slice(each, F.lit(1), n)


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of the anchors in the array columns a and b, in a sort of both together."""
    mask = F.lit((1 << PLACE_BITS) - 1)
    # hash, a bit that tells b from a, place
    marked = lambda c, bit: F.transform(c, lambda v: F.shiftleft(F.shiftright(v, PLACE_BITS), PLACE_BITS + 1).bitwiseOR(F.lit(bit << PLACE_BITS)).bitwiseOR(v.bitwiseAND(mask)))
    hash_of = lambda v: F.shiftright(v, PLACE_BITS + 1)
    df = df.withColumn("__z", F.sort_array(F.concat(marked(a, 0), marked(b, 1))))
    n = F.greatest(F.size("__z") - 1, F.lit(0))
    shifts = F.zip_with(F.slice("__z", F.lit(1), n), F.slice("__z", F.lit(2), n), lambda x, y: F.when(hash_of(x) == hash_of(y), x.bitwiseAND(mask) - y.bitwiseAND(mask)))
    df = df.withColumn("__d", F.sort_array(F.filter(shifts, lambda d: d.isNotNull())))
    df = df.withColumn("__m", F.get("__d", F.floor((F.size("__d") - 1) / 2).cast("int")))
    agree = F.size(F.filter("__d", lambda d: F.abs(d - F.col("__m")) <= SLACK))
    union = F.size("__z") - F.size("__d")
    value = F.when(F.col(a) == F.col(b), F.lit(1.0)).when(union > 0, agree / union).otherwise(F.lit(0.0))
    return df.withColumn(out, value).drop("__z", "__d", "__m")


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column as a string; no shuffle."""
    filled = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    return anchors(filled, "__text", "__k").withColumn(out, written(F.col("__k"))).drop("__text", "__k")


def with_sentinels(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, part, sentinel): rows dealt to ranges of ids, and at each range's end the first row of the next."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("key"))
    n = docs.count()
    ranges = clip(n / RANGE_ROWS, 1, MOST_RANGES)
    at = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(docs.select(F.percentile_approx("key", at, 100 * ranges).alias("q")).first()["q"] or [])) if at else []
    part = F.lit(0)
    if cuts:  # a binary search
        table = F.array(*[F.lit(c).cast("long") for c in cuts])
        steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
        part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, s: F.when(F.get(table, found + s - 1) <= F.col("key"), found + s).otherwise(found))
    keyed = docs.withColumn("part", part)
    firsts = sorted((r["part"], r["key"]) for r in keyed.groupBy("part").agg(F.min("key").alias("key")).collect())  # a row a range
    if not firsts:
        return keyed.withColumn("sentinel", F.lit(0))
    before = [(firsts[i - 1][0], key) for i, (_, key) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(before, "to int, head long"))
    same = Window.partitionBy("key").orderBy("text")
    copies = docs.join(heads, F.col("key") == F.col("head")).withColumn("__r", F.row_number().over(same)).where("__r = 1")
    return keyed.withColumn("sentinel", F.lit(0)).unionByName(copies.select("doc_id", "text", "key", F.col("to").alias("part"), F.lit(1).alias("sentinel")))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, anchors, edited_anchors)."""
    order = Window.partitionBy("part").orderBy("sentinel", "key", "text")
    rows = anchors(with_sentinels(docs).repartition("part"), "text", "own")  # anchors are as large as texts, so they come after the shuffle
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next", F.lead("own").over(order)).where("sentinel = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half)))
    rows = anchors(rows.select("doc_id", "n_chars", "own", "next", "edited_text"), "edited_text", "edited")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("edited")).alias("edited_fingerprint"), "own", "edited", "next")
    rows = likeness(likeness(rows, "own", "edited", "near_edited"), "own", "next", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.col("own").alias("anchors"), F.col("edited").alias("edited_anchors"))
