"""File sources: listing (S2 input), header probe and grouped CSV scan (S1),
asset discovery (S6).

The listing is a distributed ``binaryFile`` scan with the ``content`` column
pruned, so only file metadata is read. Header detection reads the first line of
each file on the executors (``mapInPandas`` over the listing). Spark's CSV reader
matches header names by position, so files are read once per distinct header and
combined by name.
"""

from __future__ import annotations

import csv
import functools
import io
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.sources import fs

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("length", T.LongType()),
])

CORRUPT_COL = "_corrupt_record"
SOURCE_PATH, SOURCE_MTIME = "_source_path", "_source_mtime"


def list_files(spark: SparkSession, root: str | list[str], glob: str = "*.csv",
               recursive: bool = True) -> DataFrame:
    """(path, mtime, length) of every matching file under ``root`` (one
    folder or a list of existing folders).

    ``binaryFile`` without selecting ``content`` never opens the files. Names
    starting with ``_`` or ``.`` are skipped by Spark's file index.
    """
    roots = [root] if isinstance(root, str) else list(root)
    if not roots or (isinstance(root, str) and not fs.exists(spark, root)):
        return spark.createDataFrame([], LISTING_SCHEMA)
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .option("pathGlobFilter", glob)
            .load(roots)
            .select(F.col("path"), F.col("modificationTime").alias("mtime"),
                    F.col("length")))


def _first_line(path: str, encoding: str) -> str | None:
    """The whole first line, however long; None for an empty file."""
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(fs.python_uri(path))
    parts: list[bytes] = []
    # Compression follows the extension (.gz, .bz2, .zst …), as in Spark's reader.
    with filesystem.open_input_stream(inner, compression="detect") as f:
        while chunk := f.read(65536):
            parts.append(chunk)
            if b"\n" in chunk:
                break
    if not parts:
        return None
    text = b"".join(parts).decode("utf-8-sig" if encoding.lower() == "utf-8" else encoding, errors="replace")
    return text.split("\n", 1)[0].rstrip("\r")


def _option(options: dict | None, *names: str, default: str) -> str:
    """A reader option under any of its names, as Spark reads it."""
    low = {k.lower(): v for k, v in (options or {}).items()}
    return str(next((low[n] for n in names if n in low), default))


def _parse_header(line: str | None, sep: str = ",", quote: str = '"') -> list[str] | None:
    """The fields of a header line, spaces around them dropped."""
    if line is None:
        return None
    if len(sep) > 1 or not quote:
        return [c.strip() for c in line.split(sep)]
    row = next(csv.reader(io.StringIO(line), delimiter=sep, quotechar=quote, skipinitialspace=True), [])
    return [c.strip() for c in row]


def _probe_batches(batches, sep: str, quote: str, encoding: str):
    import pyarrow as pa

    for pdf in batches:
        heads, unread = [], []
        for p in pdf["path"]:
            head, missed = None, False
            try:
                head = _parse_header(_first_line(p, encoding), sep, quote)
            except FileNotFoundError:
                pass  # gone since it was listed: not read, and not committed
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError):
                missed = True  # a file system that Python cannot reach
            heads.append(head)
            unread.append(missed)
        yield pd.DataFrame({"path": pdf["path"], "columns": heads, "unread": unread})


def probe_headers(listing: DataFrame, options: dict | None = None) -> DataFrame:
    """(path, columns array<string>, unread) for each listed file; read on
    executors with the reader's own separator, quote and encoding. Empty files
    get a null header and are left out of the scan; ``unread`` marks files on a
    file system Python cannot reach (see ``spark_headers``). A file that may
    not be read fails the run before anything is written."""
    from lakeloom.session import ship_package

    ship_package(listing.sparkSession)  # the workers import this module
    probe = functools.partial(_probe_batches, sep=_option(options, "sep", "delimiter", default=","),
                              quote=_option(options, "quote", default='"'),
                              encoding=_option(options, "encoding", "charset", default="utf-8"))
    return listing.select("path").mapInPandas(probe, "path string, columns array<string>, unread boolean")


def spark_headers(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """(path, columns) from the first line of each file, read by Spark itself.

    The fallback for files the Python probe cannot open (e.g. a file system
    without a Python client). It scans the files' first splits: the first
    line of a file is the row with the smallest id in the split starting at
    offset 0.
    """
    src = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = (spark.read.text(paths)
             .select(src.alias("path"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("i"), "value")
             .where(F.col("start") == 0))
    first = lines.groupBy("path").agg(F.min_by("value", "i").alias("line"))
    line = F.regexp_replace(F.regexp_replace("line", "^\ufeff", ""), "\r$", "")
    sep, q = re.escape(_option(options, "sep", "delimiter", default=",")), re.escape(_option(options, "quote", default='"'))
    # A separator outside quotes: an even number of quotes follows.
    fields = F.transform(F.split(line, f"{sep}(?=(?:[^{q}]*{q}[^{q}]*{q})*[^{q}]*$)"),
                         lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), f"^{q}(.*){q}$", "$1"), q + q, q)))
    return first.select("path", fields.alias("columns"))


def header_groups(listing: DataFrame, options: dict | None = None) -> list[tuple[tuple[str, ...], list[str]]]:
    """Group the listed files by header, in first-modified order (then path).

    One row per file reaches the driver (the file list of one batch is bounded
    and is there already); no task gathers paths. Files the Python probe could
    not open are probed by Spark (``spark_headers``).
    """
    # One row per file, used twice below: kept so first lines are read once.
    probe = probe_headers(listing, options).persist()
    try:
        unread = [r["path"] for r in probe.where("unread").select("path").collect()]
        heads = probe.where(~F.col("unread")).select("path", "columns")
        if unread:
            heads = heads.unionByName(spark_headers(listing.sparkSession, unread, options))
        rows = heads.where(F.col("columns").isNotNull()).join(listing.select("path", "mtime"), "path") \
            .select(F.unix_micros("mtime").alias("at"), "path", "columns").collect()
    finally:
        probe.unpersist()
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["path"])):
        groups.setdefault(tuple(r["columns"]), []).append(r["path"])
    return list(groups.items())


def field_names(header: tuple[str, ...]) -> list[str]:
    """Usable names for the fields of one header: an empty name becomes
    ``_c<i>``, one that differs from an earlier name only by case gets a suffix
    (Spark's columns do not differ by case)."""
    out, seen = [], set()
    for i, c in enumerate(header):
        name, k = c or f"_c{i}", 2
        while name.lower() in seen:
            name, k = f"{c or f'_c{i}'}_{k}", k + 1
        seen.add(name.lower())
        out.append(name)
    return out


def read_csv_group(spark: SparkSession, columns: tuple[str, ...], paths: list[str],
                   options: dict | None = None) -> DataFrame:
    """Read files that share one header; every column is a string.

    The header was read from every file of the group, and rows of a file that
    has changed since are dropped (``listed_versions_only``), so fields go by
    position. Lines with the wrong number of fields keep their text in
    ``_corrupt_record``.
    """
    schema = T.StructType([T.StructField(f"_f{i}", T.StringType()) for i in range(len(columns))]
                          + [T.StructField(CORRUPT_COL, T.StringType())])
    reader = (spark.read.schema(schema)
              .option("header", "true")
              .option("enforceSchema", "true")
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT_COL))
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    df = reader.csv(paths)
    # Where each row came from, in the listing's form: Spark reports the file
    # path URL-encoded; a literal "+" is protected before decoding.
    src = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    reserved = {CORRUPT_COL, SOURCE_PATH, SOURCE_MTIME}
    named = [F.col(f"_f{i}").alias(c) for i, c in enumerate(field_names(columns)) if c.lower() not in reserved]
    return df.select(*named, F.col(CORRUPT_COL), src.alias(SOURCE_PATH),
                     F.col("_metadata.file_modification_time").alias(SOURCE_MTIME))


def header_families(headers: list[tuple[str, ...]], known: list[tuple[str, list[str]]] | None = None,
                    bound: float = 0.5) -> list[str]:
    """A5: the family of each header: files whose headers are alike make one
    table, others a table of their own.

    Two headers are compatible if they share ``bound`` or more of their columns
    (Jaccard, names that differ by case are one). A header joins the known
    family (name, columns) it is most like, the earlier one of two; families
    never merge. The others are grouped by compatibility, directly or through
    each other, and get the next free names ``f0``, ``f1``, ... in the order
    given. Compatible headers share one of the rarest columns of each (prefix
    filter), so only those that do are compared. The number of distinct headers
    is bounded by the files of a batch.
    """
    sets = [frozenset(c.lower() for c in field_names(h)) for h in headers]
    old = [(name, frozenset(c.lower() for c in cols)) for name, cols in known or []]
    count = Counter(c for s in [*sets, *(s for _, s in old)] for c in s)

    def prefix(s: frozenset) -> list[str]:
        need = math.ceil(bound * len(s) - 1e-9)  # columns a compatible header shares at least
        return sorted(s, key=lambda c: (count[c], c))[:len(s) - max(need, 1) + 1]

    def alike(a: frozenset, b: frozenset) -> float:
        return len(a & b) / len(a | b) if a | b else 1.0

    by_old, by_new = defaultdict(list), defaultdict(list)
    for k, (_, s) in enumerate(old):
        for c in prefix(s):
            by_old[c].append(k)
    out: list[str | None] = []
    for s in sets:
        best = max(({k for c in prefix(s) for k in by_old[c]}), key=lambda k: (alike(s, old[k][1]), -k), default=None)
        out.append(old[best][0] if best is not None and alike(s, old[best][1]) >= bound else None)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, s in enumerate(sets):
        if out[i] is not None:
            continue
        for j in sorted({j for c in prefix(s) for j in by_new[c]}):
            if find(i) != find(j) and alike(s, sets[j]) >= bound:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for c in prefix(s):
            by_new[c].append(i)
    taken, names = {name for name, _ in old}, {}
    for i in range(len(sets)):
        if out[i] is None and find(i) not in names:
            n = len(taken)
            while f"f{n}" in taken:
                n += 1
            names[find(i)] = f"f{n}"
            taken.add(f"f{n}")
    return [f if f is not None else names[find(i)] for i, f in enumerate(out)]


def merge_columns(groups: list[tuple[tuple[str, ...], list[str]]], base: list[str] | None = None,
                  reserved: tuple[str, ...] = ()) -> list[str]:
    """A5: union of column names, known ones first, new ones in arrival order.
    Names are one if they differ by case only; ``reserved`` names are left out."""
    out = list(base or [])
    seen = {c.lower() for c in out} | {c.lower() for c in reserved}
    for cols, _ in groups:
        for c in field_names(cols):
            if c.lower() not in seen:
                seen.add(c.lower())
                out.append(c)
    return out


def csv_scan(spark: SparkSession, groups: list[tuple[tuple[str, ...], list[str]]],
             columns: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """One read per header group, combined by name (missing → null).

    The result has ``columns`` (or the merged header order) plus
    ``_corrupt_record``, ``_source_path`` and ``_source_mtime`` (the file
    and the change time each row was read from).
    """
    order = list(columns) if columns is not None else merge_columns(groups)
    frames = [read_csv_group(spark, cols, paths, options) for cols, paths in groups]
    if not frames:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in order]
                              + [T.StructField(CORRUPT_COL, T.StringType()),
                                 T.StructField(SOURCE_PATH, T.StringType()),
                                 T.StructField(SOURCE_MTIME, T.TimestampType())])
        return spark.createDataFrame([], schema)
    df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c)
                       for c in order], CORRUPT_COL, SOURCE_PATH, SOURCE_MTIME)


def listed_versions_only(rows: DataFrame, files: DataFrame,
                         known_size: tuple[int, int] | None = None) -> DataFrame:
    """Keep rows read from the listed version of their file.

    ``files`` is the run's (path, mtime) list, bounded by the run's file cap.
    It is broadcast after a size check, or directly when ``known_size``
    (rows, bytes) is given and within bounds. A file rewritten after it was
    listed contributes no rows now and is left for the next run.
    """
    from lakeloom.operators.lookups import bounded_broadcast, broadcast_known

    seen = files.select(F.col("path").alias(SOURCE_PATH), F.col("mtime").alias(SOURCE_MTIME))
    small = broadcast_known(seen, *known_size) if known_size else bounded_broadcast(seen)
    return rows.join(small, [SOURCE_PATH, SOURCE_MTIME], "left_semi")


def scan_csv_folder(spark: SparkSession, root: str, options: dict | None = None) -> DataFrame:
    """S1 over everything under ``root`` (no manifest)."""
    return csv_scan(spark, header_groups(list_files(spark, root)), options=options).drop(
        SOURCE_PATH, SOURCE_MTIME)


# ---------------------------------------------------------------------------
# S6 asset discovery
# ---------------------------------------------------------------------------

def discover_assets(spark: SparkSession, sql_root: str | None = None,
                    mapper_root: str | None = None) -> DataFrame:
    """List SQL assets (recursive) and mappers (top level only), skipping readmes.

    SQL assets follow ``<project>/<entity>_sql.csv``; mappers
    ``<project_snake>_mapper_config.csv``. Returns (kind, project, entity, path).
    """
    parts = []
    if sql_root:
        sql = (list_files(spark, sql_root, glob="*", recursive=True)
               .withColumn("name", F.element_at(F.split("path", "/"), -1))
               .where(F.lower("name") != "readme.md")
               .select(
                   F.lit("sql_asset").alias("kind"),
                   F.element_at(F.split("path", "/"), -2).alias("project"),
                   F.regexp_extract("name", r"^(.*)_sql\.csv$", 1).alias("entity"),
                   "path"))
        parts.append(sql)
    if mapper_root:
        # Spark's file index always descends; keep direct children only.
        depth = len(fs.qualify(spark, mapper_root).split("/")) + 1
        mappers = (list_files(spark, mapper_root, glob="*", recursive=True)
                   .withColumn("name", F.element_at(F.split("path", "/"), -1))
                   .where((F.lower("name") != "readme.md")
                          & (F.size(F.split("path", "/")) == depth))
                   .select(
                       F.lit("mapper").alias("kind"),
                       F.regexp_extract("name", r"^(.*)_mapper_config\.csv$", 1).alias("project"),
                       F.lit(None).cast("string").alias("entity"),
                       "path"))
        parts.append(mappers)
    if not parts:
        raise ValueError("give sql_root, mapper_root or both")
    return functools.reduce(DataFrame.unionByName, parts)
