"""Queries that write formats and read them again, and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators import report
from strandloom.plans.views import FAMILIES, HITS, families, hits, sequences
from strandloom.sources import readers, reports, writers
from strandloom.streaming import windows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


FIELDS = ["score", "query_name", "query_start", "query_end", "orientation", "subj_name", "subj_type", "subj_start", "subj_end", "subj_remaining"]
BACK = f"WITH {HITS} SELECT CAST(hit_id AS VARCHAR) AS id, CAST(score AS DOUBLE) AS score, query_name, query_start, query_end, orientation, subj_name, subj_type, subj_start, subj_end, subj_remaining FROM hits"


@query(BACK)
def out_round_trip(spark, sf_dir):
    return readers.hits_from_lines(writers.out_table(hits(spark, sf_dir))).select("id", *FIELDS)


@query(BACK.replace("CAST(hit_id AS VARCHAR) AS id", "'m_b1s' || stage || 'i' || hit_id AS lineage_id"))
def native_round_trip(spark, sf_dir):
    return readers.hits_from_lines(writers.native_lines(hits(spark, sf_dir))).select("lineage_id", *FIELDS)


LETTERS = lambda key: f"translate(substr(repeat(md5({key}), 10), 1, query_end - query_start + 1), '0123456789abcdef', 'ACGTACGTACGT-ACG')"
PAIR = {"query_string": LETTERS("CAST(hit_id AS {0})"), "subj_string": LETTERS("'s' || hit_id"), "matrix": "'25p' || (35 + hit_id % 5 * 2) || 'g.matrix'", "transitions": "CAST(hit_id % 40 AS INT)", "transversions": "CAST(hit_id % 23 AS INT)"}


@query(f"WITH {HITS} SELECT 'm_b1s' || stage || 'i' || hit_id AS lineage_id, {', '.join(FIELDS).replace('score', 'CAST(score AS DOUBLE) AS score')}, div_permille / 100 AS kimura, {', '.join(f'{v} AS {k}' for k, v in PAIR.items()).format('VARCHAR')} FROM hits")
def alignment_round_trip(spark, sf_dir):
    """All hits with alignments made from hashes, written as a report and read in byte ranges."""
    h = hits(spark, sf_dir).withColumns({k: F.expr(v.format("STRING")) for k, v in PAIR.items()}).withColumn("kimura", F.col("div_permille") / 100)
    place = windows.checkpoint_path(spark, f"report_{uuid.uuid4().hex}")
    writers.alignment_records(h).select("line").write.text(place)
    return reports.alignments(spark, place, 1 << 16).select("lineage_id", *FIELDS, "kimura", *PAIR)


PERCENT = "format('{{:4.1f}}', {0} / 10.0)"
SIGN = "CASE WHEN orientation = 'C' THEN '-' ELSE '+' END"
REST = "CASE WHEN orientation = 'C' THEN '(' || subj_remaining || ') ' || subj_end || ' ' || subj_start ELSE subj_start || ' ' || subj_end || ' (' || subj_remaining || ')' END"


@query(f"""WITH {HITS} SELECT hit_id, score || ' ' || {PERCENT.format('div_permille')} || ' ' || {PERCENT.format('del_permille')} || ' ' || {PERCENT.format('ins_permille')} || ' ' || query_name || ' ' || query_start || ' ' || query_end || ' (0) '
|| orientation || ' ' || subj_name || '#' || subj_type || ' ' || {REST} || CASE WHEN score % 5 = 0 THEN ' *' ELSE ' ' END AS line FROM hits""")
def match_lines(spark, sf_dir):
    return writers.match_lines(hits(spark, sf_dir).withColumn("overlap", F.col("score") % 5 == 0))


@query(f"""WITH {HITS} SELECT hit_id, 'Motif_homol "' || subj_name || '" "strandloom" ' || {PERCENT.format('div_permille')} || ' ' || query_start || ' ' || query_end || ' ' || {SIGN} || ' ' || subj_end || ' ' || subj_start AS line FROM hits""")
def motif_lines(spark, sf_dir):
    return writers.motif_lines(hits(spark, sf_dir))


@query(f"""WITH {HITS} SELECT hit_id, query_name || chr(9) || 'strandloom' || chr(9) || 'similarity' || chr(9) || query_start || chr(9) || query_end || chr(9) || score || chr(9) || {SIGN} || chr(9) || '.' || chr(9) || 'Target "Motif:' || subj_name || '" ' || subj_start || ' ' || subj_end AS line FROM hits""")
def gff2_lines(spark, sf_dir):
    return writers.gff2(hits(spark, sf_dir))


@query(f"WITH {HITS} SELECT CAST(hit_id AS VARCHAR) AS id, query_name, query_start, query_end FROM hits WHERE subj_type = 'Simple_repeat' AND div_permille + del_permille + ins_permille < 100")
def polymorphic_repeats(spark, sf_dir):
    return readers.hits_from_lines(writers.out_table(writers.polymorphic(hits(spark, sf_dir)))).select("id", "query_name", "query_start", "query_end")


@query(f"""WITH {HITS} SELECT query_name || chr(9) || 'strandloom' || chr(9) || 'dispersed_repeat' || chr(9) || query_start || chr(9) || query_end || chr(9) || score || chr(9) || CASE WHEN orientation = 'C' THEN '-' ELSE '+' END || chr(9) || '.' || chr(9) || 'Target=' || subj_name || ' ' || subj_start || ' ' || subj_end AS line FROM hits
UNION ALL SELECT '##sequence-region ' || query_name || ' 1 ' || max(query_end) FROM hits GROUP BY query_name""")
def gff3_lines(spark, sf_dir):
    return writers.gff3(hits(spark, sf_dir)).select("line")


@query(f"WITH {HITS} SELECT query_name AS chrom, query_start - 1 AS start, query_end AS stop, subj_name AS family, query_end - query_start + 1 AS size, CASE WHEN orientation = 'C' THEN '-' ELSE '+' END AS strand, string_split(subj_type, '/')[1] AS class, coalesce(string_split(subj_type, '/')[2], '') AS subclass, div_permille / 10 AS diverge, hit_id AS linkage_id FROM hits")
def bed_rows(spark, sf_dir):
    return writers.bed(hits(spark, sf_dir))


@query(f"WITH {FAMILIES} SELECT accession, '>' || accession || ' ' || name || '#' || repeat_type || '/' || repeat_subtype AS line FROM families")
def family_fasta(spark, sf_dir):
    return writers.family_fasta(families(spark, sf_dir))


@query(f"WITH {FAMILIES} SELECT accession, 'ID   ' || accession || '; ' || length || ' BP.' || chr(10) || 'DE   ' || name || chr(10) || 'CC   Type: ' || repeat_type || chr(10) || 'CC   SubType: ' || repeat_subtype || chr(10) || '//' AS line FROM families")
def family_embl(spark, sf_dir):
    return writers.family_embl(families(spark, sf_dir))


@query(None)
def summary_lines(spark, sf_dir):
    return writers.summary_table(report.class_coverage(hits(spark, sf_dir)), 3_000_000)


@query(None)
def fasta_lines(spark, sf_dir):
    return writers.fasta(sequences(spark, sf_dir).withColumn("sequence", F.regexp_replace("sequence", "[^A-Z]", "N")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return windows.run_once(windows.tumbling(windows.event_stream(spark, sf_dir)))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return windows.run_once(windows.sliding(windows.event_stream(spark, sf_dir)))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    return windows.run_once(windows.sessions(windows.event_stream(spark, sf_dir)))


@query(f"""WITH {HITS} SELECT query_name, CAST(sum(f) AS BIGINT) AS n_clusters, count(*) AS n_hits, min(query_start) AS lo, max(query_end) AS hi FROM (SELECT *, CASE WHEN query_start <= max(query_end) OVER (PARTITION BY query_name ORDER BY query_start, query_end DESC, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM hits) GROUP BY 1""")
def stream_clusters(spark, sf_dir):
    e = windows.event_stream(spark, sf_dir)
    start = 1 + (F.col("event_id") * 7919 + F.col("user_id") * 104729) % 20000
    found = e.select(F.concat(F.lit("chr"), F.col("user_id")).alias("query_name"), start.alias("query_start"), (start + 19 + (F.col("event_id") * 31) % 280).alias("query_end"))
    return windows.run_once(windows.clustered(found), "update")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    return windows.run_once(windows.first_seen(windows.event_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")
