"""Hit reports with alignments as a data source: files of any size read in byte ranges, records that span many lines.

A record begins with a hit line and belongs to the range in which that line begins; its reader goes on beyond the range
until the next one begins. So a file is read by many tasks without a shuffle, and a range's reader keeps one record.
Compressed files (.gz) are one range each. Paths may be of any file system that pyarrow opens; a folder stands for its files.

Lines that no layout knows are passed over; an empty file gives no rows; a hit line without an alignment up to the next hit
line has null strings; a complemented query is turned back, and its subject with it.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.sources.readers import HIT_SCHEMA, parse_hit

#: Ranges of a scan, but for those of the most bytes; bytes of a range; rows and letters of a batch.
RANGES, RANGE_BYTES, BATCH_ROWS, BATCH_LETTERS = 64, 64 << 20, 1000, 4 << 20
STOP = b"Score histogram:"
#: Letters and their complements
TURNED = str.maketrans("ACGTYRMKHBVD", "TGCARYKMDVBH")

ALIGNED = "query_string string, subj_string string, matrix string, kimura double, kimura_raw double, cpg_sites int, transitions int, transversions int"
SCHEMA = f"{HIT_SCHEMA}, {ALIGNED}, file string, at long"
_TYPES = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])

_ROW = re.compile(r"^(C?)\s+(\S+)\s+\d+\s+(\S+)\s+\d+\s*$")
_MARKS = {
    "matrix": re.compile(r"^Matrix\s*=\s*(\S+)"),
    "kimura": re.compile(r"^Kimura.*=\s*(\S+)"),
    "cpg": re.compile(r"^CpG sites\s*=\s*(\d+),\s*Kimura \(unadjusted\)\s*=\s*([\d.]+)"),
    "changes": re.compile(r"Transitions.*\((\d+)\s*/\s*(\d+)\)"),
}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there; Hadoop's spellings of schemes are understood."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None


class Record:
    """One hit, from its line to the end of its alignment."""

    def __init__(self, hit: tuple, at: int) -> None:
        self.hit, self.at, self.rows, self.turned, self.done, self.marks = hit, at, ([], []), False, False, {}
        self.n_rows = self.letters = 0

    def add(self, line: str) -> None:
        if self.done:
            return
        if "Gap_init rate" in line:
            self.done = True
        elif (m := _ROW.match(line)) is not None:
            # query and subject in turn
            side = self.n_rows % 2
            self.turned |= side == 0 and m[1] == "C"
            self.rows[side].append(m[3])
            self.n_rows += 1
            self.letters += len(m[3])
        else:
            self.marks |= {k: m.groups() for k, p in _MARKS.items() if (m := p.search(line)) is not None}

    def values(self, file: str) -> tuple:
        query, subj = ("".join(r) for r in self.rows)
        if self.turned:
            query, subj = query[::-1].translate(TURNED), subj[::-1].translate(TURNED)
        g = self.marks.get
        cpg, raw = g("cpg", (None, None))
        changes = g("changes", (None, None))
        number = lambda x, kind: None if x is None else kind(x)
        matrix = re.split(r"[\\/]", g("matrix")[0])[-1] if g("matrix") else None
        aligned = (query, subj, matrix, number(g("kimura", (None,))[0], float), number(raw, float), number(cpg, int), *(number(c, int) for c in changes))
        return *self.hit, *(aligned if self.done else (None,) * len(aligned)), file, self.at


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in the range, and on beyond it, each with its place in the file."""
    system, name = located(part.file)
    if name.endswith(".gz"):
        stream = gzip.open(system.open_input_file(name))
    else:
        stream = io.BufferedReader(system.open_input_file(name), 1 << 20)
    with stream:
        at = 0
        if part.start:
            # the line that began before the range is the range before's
            stream.seek(part.start - 1)
            at = part.start - 1 + len(stream.readline())
        for line in stream:
            yield at, line
            at += len(line)


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width, self.stops = options["path"], int(options.get("range_bytes", RANGE_BYTES)), options.get("stops", "false") == "true"

    def partitions(self) -> list[Range]:
        system, name = located(self.path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
        head = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        parts = []
        # small ranges of a large report would be more tasks than work
        width = max(self.width, min(RANGE_BYTES, sum(i.size for i in infos if i.is_file) // RANGES))
        for i in infos:
            if not i.is_file or i.base_name.startswith(("_", ".")):
                continue
            if i.base_name.endswith(".gz"):
                parts.append(Range(head + i.path, 0, None))
            else:
                parts += [Range(head + i.path, a, min(a + width, i.size)) for a in range(0, i.size, width)]
        return parts

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            # Spark's own partition where there is none
            return
        held: list[tuple] = []
        letters = 0
        for r in self.stop(part) if self.stops else self.records(part):
            held.append(r.values(part.file))
            letters += r.letters
            if len(held) >= BATCH_ROWS or letters >= BATCH_LETTERS:
                yield self.batch(held)
                held, letters = [], 0
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    @staticmethod
    def stop(part: Range) -> Iterator[Record]:
        """The first line of the range, if any, from which on a report holds no more hits."""
        for at, line in lines_of(part):
            if part.end is not None and at >= part.end:
                return
            if line.startswith(STOP):
                yield Record((None,) * len(HIT_SCHEMA.split(",")), at)
                return

    @staticmethod
    def records(part: Range) -> Iterator[Record]:
        held = None
        for at, raw in lines_of(part):
            beyond = part.end is not None and at >= part.end
            if raw.startswith(STOP) or (beyond and held is None):
                break
            line = raw.decode("utf-8", "replace")
            hit = parse_hit(line)
            if hit is None:
                if held is not None:
                    held.add(line)
                # the rest, up to the next hit, is nobody's
                if not (beyond and held.done):
                    continue
            if held is not None:
                yield held
                held = None
            if beyond:
                break
            held = Record(hit, at)
        if held is not None:
            yield held


class ReportSource(DataSource):
    """format("hit_report"): options path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "hit_report"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:
        return ReportReader(dict(self.options))


def alignments(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Hits of reports with their alignments, the file and the place in it; what follows a score histogram is none.

    Where a histogram begins is asked first, by a scan that parses nothing, so that ranges behind it are known to be; that
    is a row for each file with one, which goes to every task. Ranges grow with the report, from range_bytes on.
    """
    spark.dataSource.register(ReportSource)
    read = spark.read.format("hit_report").option("range_bytes", range_bytes)
    stops = read.option("stops", "true").load(path).groupBy(F.col("file").alias("__f")).agg(F.min("at").alias("__stop"))
    rows = spark.read.format("hit_report").option("range_bytes", range_bytes).load(path)
    return rows.join(F.broadcast(stops), F.col("file") == F.col("__f"), "left").where("__stop is null or at < __stop").drop("__f", "__stop")
