"""Raw CSV files: listing, routing by header, cleaning, reading with explicit schemas."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.functions.values import strip
from undercroft.schemas import CHANNEL_HEADER, JOURNAL_HEADER, KIND_MARKERS, OBJECT_HEADER

CORRUPT = "_corrupt_record"
#: Where a row stands in its upload: file, place of its block in the file, place in the block.
POSITION = "_position"
_HEADERS = {"objects": OBJECT_HEADER, "channels": CHANNEL_HEADER, "journal": JOURNAL_HEADER}
_YEAR = re.compile(r"(?<!\d)(\d{4})(?!\d)")


@dataclass(frozen=True)
class LandingFile:
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def year(self) -> int | None:
        found = _YEAR.search(self.name)
        return int(found.group(1)) if found else None


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[LandingFile]:
    """Non-empty files of a folder: a listing only, no file is opened."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    found = [LandingFile(r["path"], r["length"]) for r in listing.collect() if r["length"] > 0]
    return sorted(found, key=lambda f: f.path)


def journal_files(files: Iterable[LandingFile], years: Sequence[int] | None = None) -> list[LandingFile]:
    """Yearly journals: files named by a year (which leaves the example file out), of the wanted years."""
    return [f for f in files if f.year is not None and (years is None or f.year in years)]


def clean_header(names: Iterable[str]) -> list[str]:
    return [n.replace("﻿", "").strip().strip('"').strip() for n in names]


def detect_kind(header: Iterable[str]) -> str:
    """objects | channels | journal, by the columns a file must have."""
    fields = set(clean_header(header))
    for kind, needed in KIND_MARKERS.items():
        if needed <= fields:
            return kind
    raise ValueError(f"unknown CSV format, columns: {sorted(fields)}")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of a partition that holds one whole file; the rest is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def header_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.csv") -> dict[str, str]:
    """First line of every non-empty file, by path, in one job: files or a folder with everything below it.

    While the probe is planned, a file is one partition of its own, whatever its size, and its task stops after the
    first rows; what comes to the driver is a line for each file.
    """
    reader = spark.read.option("encoding", "UTF-8")
    if isinstance(paths, str):
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    lines = reader.text(paths if isinstance(paths, str) else list(paths))
    found = lines.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(
        _first_lines, "path string, value string")
    wide = {"spark.sql.files.maxPartitionBytes": "1024g", "spark.sql.files.openCostInBytes": "1024g"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for key, value in wide.items():
            spark.conf.set(key, value)
        return {unquote(r["path"]): r["value"] for r in found.collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def read_headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by the column names in their first line: one job for all files, which are parsed once per distinct line."""
    by_line: dict[str, list[str]] = {}
    for path, line in sorted(header_lines(spark, paths).items()):
        by_line.setdefault(line, []).append(path)
    headers: dict[tuple[str, ...], list[str]] = {}
    for line, group in by_line.items():
        names = clean_header(next(csv.reader([line]), []))
        if not any(names):
            raise ValueError(f"CSV without a header: {group[0]}")
        headers.setdefault(tuple(names), []).extend(group)
    return headers


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file; only its first rows are read."""
    headers = read_headers(spark, [path])
    if not headers:
        raise ValueError(f"CSV without a header: {path}")
    return list(next(iter(headers)))


def read_text_rows(spark: SparkSession, paths: Sequence[str], header: Sequence[str], trim: bool = False) -> DataFrame:
    """All columns as text under the given header, plus the line itself where a row does not fit it (else empty).

    Types are never inferred: a single odd value would otherwise change a whole column.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, CORRUPT]])
    reader = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A row is judged by all of its fields, whichever of them a query reads.
        .option("columnPruning", "false")
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
    )
    if trim:
        reader = reader.option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
    rows = reader.csv(list(paths)).withColumns({
        "_file": F.col("_metadata.file_name"),
        # Inside a block rows are numbered in the order of its lines.
        POSITION: F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                           F.monotonically_increasing_id().alias("line")),
    })
    # The malformed line, or an empty text. The first field is read along because Spark refuses queries on raw files
    # that need the malformed line alone.
    rows = rows.withColumn(CORRUPT, F.concat_ws("", CORRUPT, F.substring(f"`{header[0]}`", 1, 0)))
    if trim:
        rows = rows.withColumns({n: strip(F.col(f"`{n}`")) for n in header})
    return rows


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT) == "").drop(CORRUPT)


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows that do not fit their header, with the file and the original line."""
    return rows.filter(F.col(CORRUPT) != "").select("_file", F.col(CORRUPT).alias("line"))


def renamed(rows: DataFrame, kind: str) -> DataFrame:
    """Journal's own column names -> ours; an optional column that is absent becomes NULL."""
    names = _HEADERS[kind]
    keep = [
        (F.col(f"`{raw}`") if raw in rows.columns else F.lit(None).cast("string")).alias(ours)
        for raw, ours in names.items()
    ]
    return rows.select(*keep, *[c for c in ("_file", POSITION) if c in rows.columns])


def with_year(rows: DataFrame) -> DataFrame:
    """Adds the year of the file a row came from."""
    return rows.withColumn(
        "year", F.nullif(F.regexp_extract("_file", r"(?<!\d)(\d{4})(?!\d)", 1), F.lit("")).try_cast("int")
    )


def read_with_rejects(
    spark: SparkSession, paths: Sequence[str], kind: str | None = None, trim: bool = False
) -> tuple[str, DataFrame, DataFrame]:
    """(kind, text rows, rejected lines) of files that share one kind; files with other column orders are read apart."""
    headers = read_headers(spark, paths)
    kinds = {kind or detect_kind(h) for h in headers}
    if len(kinds) != 1:
        raise ValueError(f"files of several kinds: {sorted(kinds)}" if kinds else "no files to read")
    resolved = kinds.pop()
    return resolved, *read_group(spark, headers, resolved, trim)


def read_group(
    spark: SparkSession, headers: dict[tuple[str, ...], list[str]], kind: str, trim: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(text rows, rejected lines) of files of one kind whose headers are known: one scan for each column order."""
    good: DataFrame | None = None
    bad: DataFrame | None = None
    for header, group in headers.items():
        read = read_text_rows(spark, group, header, trim)
        rows, rejects = renamed(good_rows(read), kind), quarantine(read)
        good = rows if good is None else good.unionByName(rows)
        bad = rejects if bad is None else bad.unionByName(rejects)
    return with_year(good), bad


def read_kind(
    spark: SparkSession, paths: Sequence[str], kind: str | None = None, trim: bool = False
) -> tuple[str, DataFrame]:
    """(kind, text rows) alone."""
    return read_with_rejects(spark, paths, kind, trim)[:2]


Routed = dict[str, dict[tuple[str, ...], list[str]]]


def route_headers(headers: dict[tuple[str, ...], list[str]]) -> Routed:
    """Kind -> header -> paths; a header of no known kind is an error that names one of its files."""
    routed: Routed = {}
    for header, group in headers.items():
        try:
            kind = detect_kind(header)
        except ValueError as error:
            raise ValueError(f"{error} ({group[0]})") from error
        routed.setdefault(kind, {})[header] = group
    return routed


def route_folder(spark: SparkSession, folder: str) -> Routed:
    """Everything in a landing folder by kind and header, from one job over the files' first lines."""
    return route_headers(read_headers(spark, folder))


def route_files(spark: SparkSession, files: Iterable[LandingFile]) -> dict[str, list[str]]:
    """Landing files by kind; one job over all headers."""
    paths = [f.path for f in files]
    if not paths:
        return {}
    return {kind: sorted(p for group in headers.values() for p in group)
            for kind, headers in route_headers(read_headers(spark, paths)).items()}
