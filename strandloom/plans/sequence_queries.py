"""Queries over sequences, families, taxa and ordered records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.functions import alignment as A, scalar as S
from strandloom.operators import report, sequence, taxonomy
from strandloom.plans.views import FAMILIES, HITS, SEQUENCES, TAXA, families, hits, sequences, table, taxa

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {SEQUENCES} SELECT seq_id, length(sequence) AS length, length(regexp_replace(sequence, '[XN]{{20,}}', '', 'g')) AS xn_length, length(translate(sequence, 'XNRYMK', '')) AS subt_length, length(sequence) - length(translate(sequence, 'GC', '')) AS gc_length FROM seqs")
def base_composition(spark, sf_dir):
    return report.composition(sequences(spark, sf_dir))


FRAG = 5000, 200
FRAGMENTS = f"""frags AS (SELECT seq_id, n AS frag_no, CASE WHEN d = 1 THEN 0 ELSE n * step END + 1 AS start_pos, CASE WHEN n = d - 1 THEN l ELSE (n + 1) * step + {FRAG[1]} END AS end_pos, n = d - 1 AS is_last
FROM (SELECT *, (l - {FRAG[1]}) // d AS step, unnest(range(d)) AS n FROM (SELECT seq_id, l, CASE WHEN l > {FRAG[0]} THEN CAST(ceil((l - {FRAG[1]}) / {FRAG[0] - FRAG[1]}.0) AS BIGINT) ELSE 1 END AS d FROM (SELECT doc_id AS seq_id, n_chars AS l FROM documents))))"""


def _fragments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("n_chars").alias("length"))
    return sequence.fragments(docs, *FRAG)


@query(f"WITH {FRAGMENTS} SELECT * FROM frags")
def sequence_fragments(spark, sf_dir):
    return _fragments(spark, sf_dir)


BATCHES = f"""{FRAGMENTS}, batched AS (SELECT *, seq_id % 8 AS part, CAST(floor(coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY seq_id % 8 ORDER BY seq_id, frag_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 75000) AS BIGINT) AS batch_num FROM frags)"""


def _batches(spark, sf_dir):
    return sequence.batches(_fragments(spark, sf_dir).withColumn("part", F.col("seq_id") % 8), 75_000, ["seq_id", "frag_no"])


@query(f"WITH {BATCHES} SELECT part, batch_num, count(*) AS n, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS bp FROM batched GROUP BY 1, 2")
def sequence_batches(spark, sf_dir):
    return _batches(spark, sf_dir).groupBy("part", "batch_num").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("bp"))


@query(f"WITH {BATCHES}, {SEQUENCES} SELECT part, batch_num, CAST(sum(length(piece) - length(translate(piece, 'GC', ''))) AS BIGINT) AS gc, CAST(sum(length(piece)) AS BIGINT) AS bp FROM (SELECT part, batch_num, substring(sequence, start_pos, end_pos - start_pos + 1) AS piece FROM batched JOIN seqs USING (seq_id)) GROUP BY 1, 2")
def batch_gc(spark, sf_dir):
    # of all fragments, each over its own range
    part = F.substr("sequence", F.col("start_pos").cast("int"), (F.col("end_pos") - F.col("start_pos") + 1).cast("int"))
    pieces = _batches(spark, sf_dir).join(sequences(spark, sf_dir), "seq_id").select("part", "batch_num", part.alias("piece"))
    n = F.length("piece").cast("long")
    return pieces.groupBy("part", "batch_num").agg(F.sum(n - F.length(F.translate("piece", "GC", ""))).alias("gc"), F.sum(n).alias("bp"))


@query(f"""WITH {FRAGMENTS}, fh AS (SELECT event_id AS hit_id, seq_id, frag_no, 1 + event_id % 900 AS s, 40 + event_id % 900 AS e, start_pos, end_pos, is_last FROM events JOIN frags ON user_id = seq_id)
SELECT hit_id, seq_id, frag_no, s + start_pos - 1 AS query_start, e + start_pos - 1 AS query_end FROM fh WHERE e + start_pos - 1 >= CASE WHEN frag_no = 0 THEN 1 ELSE start_pos + 100 END AND s + start_pos - 1 <= CASE WHEN is_last THEN end_pos ELSE end_pos - 100 END""")
def lifted_hits(spark, sf_dir):
    frags = _fragments(spark, sf_dir)
    fh = table(spark, sf_dir, "events").join(frags, F.col("user_id") == F.col("seq_id")).select(F.col("event_id").alias("hit_id"), "seq_id", "frag_no", (1 + F.col("event_id") % 900).alias("query_start"), (40 + F.col("event_id") % 900).alias("query_end"))
    return sequence.lifted(fh, frags, FRAG[1]).select("hit_id", "seq_id", "frag_no", "query_start", "query_end")


DOC_HITS = "dh AS (SELECT event_id AS hit_id, user_id AS seq_id, 1 + (event_id * 7919) % 900 AS s, 1 + (event_id * 7919) % 900 + 19 + event_id % 40 AS e, CASE WHEN event_id % 3 = 0 THEN 'C' ELSE '+' END AS orientation FROM events)"


def _doc_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = 1 + (F.col("event_id") * 7919) % 900
    return e.select(F.col("event_id").alias("hit_id"), F.col("user_id").cast("string").alias("query_name"), s.alias("query_start"), (s + 19 + F.col("event_id") % 40).alias("query_end"), F.when(F.col("event_id") % 3 == 0, "C").otherwise("+").alias("orientation"))


MASKED = f"""WITH {SEQUENCES}, {DOC_HITS}, letters AS (SELECT seq_id, unnest(range(1, length(sequence) + 1)) AS p, sequence FROM seqs), hit AS (SELECT DISTINCT l.seq_id, p FROM letters l JOIN dh ON dh.seq_id = l.seq_id AND p BETWEEN s AND e)
SELECT l.seq_id, string_agg(CASE WHEN hit.p IS NOT NULL THEN {{inside}} ELSE sequence[l.p] END, '' ORDER BY l.p) AS masked FROM letters l LEFT JOIN hit ON hit.seq_id = l.seq_id AND hit.p = l.p GROUP BY 1"""


@query(MASKED.format(inside="'N'"))
def masked_n(spark, sf_dir):
    return sequence.masked(sequences(spark, sf_dir), _doc_hits(spark, sf_dir), "N")


@query(MASKED.format(inside="lower(sequence[l.p])"))
def masked_lower(spark, sf_dir):
    return sequence.masked(sequences(spark, sf_dir), _doc_hits(spark, sf_dir), "lower")


@query(f"WITH {SEQUENCES}, {DOC_HITS} SELECT hit_id, seq_id, CASE WHEN orientation = 'C' THEN reverse(translate(r, '{S.LETTERS + S.LETTERS.lower()}', '{S.COMPLEMENT + S.COMPLEMENT.lower()}')) ELSE r END AS region FROM (SELECT *, substr(sequence, s, e - s + 1) AS r FROM dh JOIN seqs USING (seq_id))")
def hit_regions(spark, sf_dir):
    return sequence.extracted(sequences(spark, sf_dir), _doc_hits(spark, sf_dir))


@query(f"WITH {SEQUENCES}, k AS (SELECT seq_id, sequence, unnest(range(1, greatest(1, length(sequence) - 3))) AS p FROM seqs WHERE length(sequence) >= 5) SELECT seq_id, count(*) AS n FROM k WHERE sequence[p] || sequence[p + 1] || sequence[p + 4] IN ('THN', 'ANT', 'REE') GROUP BY 1")
def seed_pattern_hits(spark, sf_dir):
    seeds = spark.createDataFrame([("THN",), ("ANT",), ("REE",)], "seed string")
    return sequence.kmer_hits(sequences(spark, sf_dir), [0, 1, 4], F.broadcast(seeds))


@query(f"WITH {SEQUENCES} SELECT seq_id, length(sequence) >= 140 AS ok, CASE WHEN length(sequence) >= 140 THEN substr(sequence, 101, 40) END AS part FROM seqs")
def substring_checked(spark, sf_dir):
    return sequence.substring_checked(sequences(spark, sf_dir), 100, 40)


@query(f"WITH {SEQUENCES} SELECT seq_id, regexp_replace(sequence, '[^A-Z]', ' ', 'g') AS clean, length(sequence) - length(translate(sequence, 'GC', '')) AS gc FROM seqs")
def cleaned_letters(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.regexp_replace("sequence", "[^A-Z]", " ").alias("clean"), (F.length("sequence") - F.length(F.translate("sequence", "GC", ""))).cast("long").alias("gc"))


@query(f"WITH {SEQUENCES} SELECT seq_id, reverse(translate(p, '{S.LETTERS}', '{S.COMPLEMENT}')) AS rc, reverse(translate(p, '{S.LETTERS}', '{S.LEGACY_COMPLEMENT}')) AS legacy_rc FROM (SELECT seq_id, translate(sequence, 'abcdefghijklmnopqrstuvwxyz', '') AS p FROM seqs)")
def reverse_complements(spark, sf_dir):
    p = F.translate("sequence", "abcdefghijklmnopqrstuvwxyz", "")
    return sequences(spark, sf_dir).select("seq_id", S.revcomp(p).alias("rc"), S.revcomp(p, legacy=True).alias("legacy_rc"))


# passages of the benchmark inside documents: a contaminant search by equal words in a row
@query("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT item_id, w, unnest(range(len(w) - 7)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, item_id, count(*) AS n FROM dg JOIN bg USING (g) GROUP BY 1, 2""")
def contaminant_passages(spark, sf_dir):
    def grams(df, key):
        w = df.select(key, F.split("text", " ").alias("w")).where(F.size("w") >= 8)
        at = w.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - 7)).alias("i"))
        return at.select(key, F.array_join(F.slice("w", F.col("i"), F.lit(8)), " ").alias("g"))

    # what the benchmark doesn't hold goes before anything is dealt
    met = grams(table(spark, sf_dir, "documents"), "doc_id").join(grams(table(spark, sf_dir, "benchmark"), "item_id").distinct(), "g").distinct()
    return met.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


# families and taxa
LINEAGE = f"{TAXA}, up(tax_id, ancestor, depth, path) AS (SELECT tax_id, tax_id, 0, name FROM taxa UNION ALL SELECT up.tax_id, t.parent_id, up.depth + 1, p.name || ';' || up.path FROM up JOIN taxa t ON t.tax_id = up.ancestor JOIN taxa p ON p.tax_id = t.parent_id)"
ROLES = f"{LINEAGE}, roles AS (SELECT ancestor AS clade, CASE depth WHEN 0 THEN 'own' ELSE 'ancestor' END AS role FROM up WHERE tax_id = 'r1' UNION ALL SELECT tax_id, 'descendant' FROM up WHERE ancestor = 'r1' AND depth > 0)"


@query(f"WITH RECURSIVE {LINEAGE} SELECT tax_id, max(depth) AS depth, arg_max(path, depth) AS path FROM up GROUP BY 1")
def lineage_paths(spark, sf_dir):
    return taxonomy.full_paths(taxa(spark, sf_dir))


@query(f"WITH RECURSIVE {LINEAGE} SELECT tax_id FROM up WHERE ancestor = 'r2'")
def is_a(spark, sf_dir):
    return taxonomy.is_a(taxa(spark, sf_dir), "r2")


@query(f"WITH RECURSIVE {ROLES}, {FAMILIES} SELECT accession, name, role FROM families JOIN roles USING (clade) WHERE NOT is_uncurated AND stage = 45")
def family_query(spark, sf_dir):
    found = taxonomy.in_lineage(taxonomy.filtered(families(spark, sf_dir), stage=45, only_curated=True), taxa(spark, sf_dir), "r1")
    return found.select("accession", "name", "role")


@query(f"WITH RECURSIVE {ROLES}, {FAMILIES} SELECT role, count(*) AS n FROM (SELECT accession, min(role) AS role FROM families JOIN roles USING (clade) GROUP BY 1) GROUP BY 1")
def lineage_totals(spark, sf_dir):
    return taxonomy.lineage_totals(families(spark, sf_dir), taxa(spark, sf_dir), "r1")


@query(f"WITH {FAMILIES} SELECT accession, regexp_matches(accession, '^DR[0-9]{{9}}$') = false AS curated, 'Families/' || CASE WHEN accession[1:2] IN ('DF', 'DR') THEN accession[1:2] || '/' || accession[3:4] || '/' || accession[5:6] || '/' || accession[7:8] ELSE 'Aux/' || lower(accession[1:2]) END AS bin FROM (SELECT * FROM families UNION ALL SELECT * REPLACE ('MIR' || accession AS accession) FROM families)")
def accession_bins(spark, sf_dir):
    both = families(spark, sf_dir)
    both = both.unionByName(both.withColumn("accession", F.concat(F.lit("MIR"), "accession")))
    return both.select("accession", taxonomy.curated(F.col("accession")).alias("curated"), S.accession_bin(F.col("accession")).alias("bin"))


@query(f"WITH {FAMILIES} SELECT accession, name FROM families WHERE lower(repeat_type) LIKE 'e%' AND is_uncurated")
def family_filters(spark, sf_dir):
    return taxonomy.filtered(families(spark, sf_dir), type_prefix="E", only_curated=False).select("accession", "name")


@query(f"WITH {FAMILIES} SELECT count(*) AS n, count(*) FILTER (is_uncurated) AS n_uncurated, count(DISTINCT clade) AS n_clades, max(length) AS longest FROM families")
def database_counts(spark, sf_dir):
    return families(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_uncurated").alias("n_uncurated"), F.count_distinct("clade").alias("n_clades"), F.max("length").alias("longest"))


@query(f"WITH {TAXA} SELECT tax_id, name, 3 AS match FROM taxa WHERE contains(lower(name), 'n_1') AND lower(name) <> 'n_1'")
def name_parts(spark, sf_dir):
    return taxonomy.resolve_names(taxa(spark, sf_dir), "N_1").where("match = 3")


@query(f"WITH {FAMILIES} SELECT accession, name FROM families UNION ALL SELECT 'DX' || substr(accession, 3), name FROM families WHERE stage = 40")
def append_families(spark, sf_dir):
    f = families(spark, sf_dir)
    new = f.where("stage = 40").withColumn("accession", F.concat(F.lit("DX"), F.substr("accession", F.lit(3)))).unionByName(f.where("stage = 45"))
    return taxonomy.appended(f, new).select("accession", "name")


@query(f"WITH {FAMILIES} SELECT clade, stage, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp FROM families GROUP BY 1, 2")
def stage_libraries(spark, sf_dir):
    return families(spark, sf_dir).groupBy("clade", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bp"))


# ordered records
@query("SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, CAST(row_number() OVER w AS INTEGER) AS place, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def ordered_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), F.row_number().over(w).alias("place"), last.alias("last_user"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages")
def page_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def labelled_totals(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {SEQUENCES} SELECT seq_id, length(sequence) - length(translate(sequence, 'ACGT', '')) AS known FROM seqs WHERE length(sequence) - length(translate(sequence, 'ACGT', '')) >= 15")
def searchable_sequences(spark, sf_dir):
    # what is left to search: sequences of at least 15 letters that are bases (fixed value)
    known = F.length("sequence") - F.length(F.translate("sequence", "ACGT", ""))
    return sequences(spark, sf_dir).select("seq_id", known.cast("long").alias("known")).where("known >= 15")


# alignments: pairs of benchmark texts as letters of DNA, without gaps, so that a pair ends where its shorter text does
def _pairs(spark, sf_dir):
    dna = lambda c: F.translate(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("j"), dna("text").alias("s"))
    both = b.select("item_id", dna("text").alias("q")).join(nxt, F.col("item_id") == F.col("j"))
    n = F.least(F.length("q"), F.length("s"))
    return both.select("item_id", F.substr("q", F.lit(1), n).alias("q"), F.substr("s", F.lit(1), n).alias("s"))


@query(None)
def pair_divergence(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", A.kimura_column(F.col("q"), F.col("s")).alias("k")).select("item_id", "k.*")


GAPPED = """t AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGT-C') AS q FROM benchmark),
p AS (SELECT a.item_id, left(a.q, CAST(least(length(a.q), length(b.q)) AS BIGINT)) AS q, left(translate(b.q, 'T', '-'), CAST(least(length(a.q), length(b.q)) AS BIGINT)) AS s FROM t a JOIN t b ON b.item_id = a.item_id + 1),
n AS (SELECT item_id, length(q) AS n, count(*) FILTER ((x = '-') <> (y = '-')) AS gaps, count(*) FILTER (x <> '-' AND y <> '-') AS bases, count(*) FILTER (x || y IN ('AG', 'GA', 'CT', 'TC')) AS ti,
  count(*) FILTER (x || y IN ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG')) AS tv FROM (SELECT item_id, q, unnest(string_split(q, '')) AS x, unnest(string_split(s, '')) AS y FROM p) GROUP BY 1, q),
v AS (SELECT *, (2e0 * n - gaps) / (2 * n) AS w, (bases - ti - tv) / CAST(n AS DOUBLE) AS same, ti / CAST(n AS DOUBLE) AS pp, tv / CAST(n AS DOUBLE) AS qq FROM n)"""


@query(f"WITH {GAPPED} SELECT item_id, CAST(gaps AS INTEGER) AS gaps, CAST(bases AS INTEGER) AS bases, round(100 * (0.75e0 * w * ln(w) - w / 2 * CASE WHEN same + pp > qq AND same > pp THEN ln((same - pp) * sqrt(same + pp - qq)) ELSE 1 END), 6) AS percent FROM v WHERE bases > 0")
def pair_gapped_divergence(spark, sf_dir):
    letters = lambda c: F.translate(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGT-C")
    b = table(spark, sf_dir, "benchmark").select("item_id", letters("text").alias("q"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.translate("q", "T", "-").alias("s")), "item_id")
    n = F.least(F.length("q"), F.length("s"))
    k = A.kimura_gapped_column(F.substr("q", F.lit(1), n), F.substr("s", F.lit(1), n))
    return both.select("item_id", k.alias("k")).where("k.bases > 0").select("item_id", "k.gaps", "k.bases", F.round("k.percent", 6).alias("percent"))


@query(None)
def pair_encoding(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", A.caf_column(F.col("q"), F.col("s")).alias("caf"))


@query(f"WITH {HITS} SELECT hit_id, score || ' ' || query_name || ' ' || query_start || '-' || query_end AS line FROM hits")
def hit_lines(spark, sf_dir):
    return hits(spark, sf_dir).select("hit_id", F.concat("score", F.lit(" "), "query_name", F.lit(" "), "query_start", F.lit("-"), "query_end").alias("line"))
