"""File arrival → queryable table (the main path).

``ingest`` = list → anti-join the manifest → probe headers → read by header
group → stamp → partitioned write → commit, chunk by chunk until nothing is
left. Per chunk: small actions on metadata and one data pass.
"""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.stamps import stamp_upload_time
from lakeloom.operators.profiles import profile_rows, profiled, without_helpers
from lakeloom.sinks.tables import PARTITION_TYPES, batch_folder, register_table, write_partitioned
from lakeloom.sources import files as src_files
from lakeloom.sources import fs
from lakeloom.sources import manifest as mf
from lakeloom.sources.lease import Lease

# Names the stamp owns: a source column of such a name is replaced by it.
RESERVED = ("upload_time", *PARTITION_TYPES, src_files.CORRUPT_COL, src_files.SOURCE_PATH, src_files.SOURCE_MTIME)


class SimulatedCrash(RuntimeError):
    """Raised by ``stop_after`` to test recovery between write and commit."""


@dataclass
class IngestResult:
    """``batch_id`` and ``run_ts`` are the last batch's; ``files`` counts all."""

    ctx: str
    batch_id: int | None
    run_ts: str | None
    files: int
    columns: list[str] = field(default_factory=list)
    retried: bool = False
    batches: list[int] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)


def ingest(spark: SparkSession, ctx: str, src: str, dst: str, state_dir: str,
           run_ts: dt.datetime | str | None = None, layout: str = "ymd", fmt: str = "csv",
           max_files: int = 10_000, glob: str = "*.csv", csv_options: dict | None = None,
           rejects_dir: str | None = None, stop_after: str | None = None,
           lease_seconds: float = 600.0, lease_wait: float = 7200.0, on_written=None,
           families: float | None = None) -> IngestResult:
    """Ingest every file under ``src`` that is new or modified since the last commit.

    Files are taken in batches of at most ``max_files`` (oldest first), so the
    path list on the driver stays bounded; the call returns when none is left.
    An open intent (crash after write, before commit) is retried first with its
    own batch id, run time and file list, less the files that have gone since.
    ``rejects_dir`` keeps malformed lines at the cost of a second pass over the
    batch's files.

    One run per context and state folder at a time: the call waits up to
    ``lease_wait`` seconds for the lease, which passes to it when the holder is
    done or has not renewed it for ``lease_seconds``. A run that lost its lease
    raises ``Fenced`` instead of committing. ``on_written`` is called between a
    batch's write and its commit.

    With ``families`` (a similarity, say 0.5) files of unlike headers make
    tables of their own (A5, ``files.header_families``): family f goes to
    ``<dst>/f`` with its own columns. Without it all files make one table.
    """
    out, last = [], None
    with Lease(spark, state_dir, ctx, lease_seconds, lease_wait) as lease:
        while last is None or last.retried or last.files >= max_files:
            last = _ingest_batch(spark, ctx, src, dst, state_dir, run_ts, layout, fmt, max_files, glob,
                                 csv_options, rejects_dir, stop_after, not out, lease, on_written, families)
            out.append(last)
    taken = [r for r in out if r.files] or out[-1:]
    return IngestResult(ctx, taken[-1].batch_id, taken[-1].run_ts, sum(r.files for r in out),
                        next((r.columns for r in reversed(out) if r.columns), []),
                        any(r.retried for r in out), [r.batch_id for r in out if r.files],
                        functools.reduce(lambda a, b: a | b, [r.families for r in out]))


def _ingest_batch(spark, ctx, src, dst, state_dir, run_ts, layout, fmt, max_files, glob, csv_options,
                  rejects_dir, stop_after, first, lease, on_written, families) -> IngestResult:
    lease.check()
    manifest = mf.read_manifest(spark, state_dir)
    pending, last_batch = mf.batch_state(manifest, ctx)
    retried = pending is not None
    if retried:
        run_ts_sql, batch_id = mf.clock_of(pending[0])
        chosen = mf.existing(spark, mf.intent_files(manifest, ctx, batch_id))
    else:
        run_ts_sql, batch_id = mf.next_clock(last_batch, run_ts)
        candidates = mf.new_files(src_files.list_files(spark, src, glob), manifest, ctx)
        chosen = mf.collect_files(candidates.orderBy("mtime", "path").limit(max_files))
    if retried and layout == "ymd_batch":
        # The retry rewrites the batch; whatever the first try left goes, also
        # if no row is left to write.
        roots = [""] if families is None else [f"/{n}" for n in fs.list_names(spark, dst) if not n.startswith(("_", "."))]
        for f in roots:
            fs.delete(spark, f"{dst.rstrip('/')}{f}/{batch_folder(run_ts_sql, batch_id)}")
            if rejects_dir:
                fs.delete(spark, f"{rejects_dir.rstrip('/')}{f}/batch_id={batch_id}")
    if not chosen:
        if retried:
            mf.append(mf.commit_rows(spark, mf.file_frame(spark, []), ctx, batch_id, run_ts_sql, lease.token), state_dir)
        elif first:
            mf.commit_empty_run(spark, state_dir, ctx, batch_id, run_ts_sql, lease.token)
        return IngestResult(ctx, batch_id, run_ts_sql, 0, retried=retried)
    file_df = mf.file_frame(spark, chosen)

    # Headers and the plan are checked before the intent is written: input that
    # cannot be read must not leave an intent that fails for ever.
    groups = src_files.header_groups(file_df, csv_options)
    size = (len(chosen), sum(len(r[0]) + 24 for r in chosen))  # known on the driver
    tables = [("", ctx, groups)]
    if families is not None:
        names = src_files.header_families([h for h, _ in groups], mf.known_families(spark, state_dir, ctx), families)
        tables = [(f"/{f}", f"{ctx}/{f}", [g for g, n in zip(groups, names) if n == f]) for f in dict.fromkeys(names)]
    plans = []
    for folder, name, some in tables:
        known = mf.last_columns(spark, state_dir, name)
        columns = src_files.merge_columns(some, known, RESERVED)
        raw = src_files.listed_versions_only(src_files.csv_scan(spark, some, columns, csv_options), file_df, size)
        rows = raw.drop(src_files.CORRUPT_COL, src_files.SOURCE_PATH, src_files.SOURCE_MTIME)
        stamped = stamp_upload_time(rows, run_ts_sql, batch_id if layout == "ymd_batch" else None)
        plans.append((folder, name, known, columns, raw, stamped))
    lease.check()
    if not retried:
        mf.append(mf.manifest_rows(file_df, ctx, batch_id, run_ts_sql, mf.INTENT, lease.token), state_dir)
    for folder, name, _, columns, raw, stamped in plans:
        if rejects_dir:
            # Spark refuses a raw CSV query that reads only the corrupt-record
            # column, so the parsed fields travel with the line.
            (raw.where(F.col(src_files.CORRUPT_COL).isNotNull())
             .select(F.col(src_files.CORRUPT_COL).alias("line"),
                     *[F.col(f"`{c}`") for c in columns],
                     F.lit(batch_id).cast("bigint").alias("batch_id"))
             .write.partitionBy("batch_id").mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").parquet(f"{rejects_dir}{folder}"))
        seen = Observation(f"profile-{batch_id}{folder}")
        noted, metrics = profiled(stamped, columns if fmt == "csv" else [])
        if metrics:  # the types' evidence is collected by the write itself
            stamped = without_helpers(noted.observe(seen, *metrics))
        write_partitioned(stamped, f"{dst}{folder}", layout=layout, fmt=fmt)
        if metrics:
            mf.record_profile(spark, state_dir, profile_rows(seen.get, columns, name, batch_id))
    if stop_after == "write":
        raise SimulatedCrash(f"stopped after writing batch {batch_id}")
    if on_written:
        on_written()
    # Commit only files still at their listed version; one rewritten during
    # the run is read again, whole, by the next run. Only the folders of the
    # batch's files are listed again.
    folders = sorted({r[0].rsplit("/", 1)[0] for r in chosen})
    now = src_files.list_files(spark, [f for f in folders if fs.exists(spark, f)], "*", recursive=False)
    unchanged = file_df.join(now, ["path", "mtime", "length"], "left_semi")
    lease.check()
    mf.append(mf.commit_rows(spark, unchanged, ctx, batch_id, run_ts_sql, lease.token), state_dir)
    for _, name, known, columns, _, _ in plans:
        if columns != known:
            mf.record_columns(spark, state_dir, name, batch_id, columns)
    if families is None:
        return IngestResult(ctx, batch_id, run_ts_sql, len(chosen), plans[0][3], retried)
    return IngestResult(ctx, batch_id, run_ts_sql, len(chosen), retried=retried, families={p[0][1:]: p[3] for p in plans})


def ingest_and_register(spark: SparkSession, ctx: str, src: str, dst: str, state_dir: str,
                        database: str, table: str, db_location: str | None = None,
                        **kw) -> IngestResult:
    """Ingest, then (only on success) register or refresh the catalog table.

    ``db_location`` places a new database under a shared folder. With
    ``families`` every family f is a table ``<table>_f``.
    """
    res = ingest(spark, ctx, src, dst, state_dir, **kw)
    parts = {"": res.columns or mf.last_columns(spark, state_dir, ctx)}
    if kw.get("families") is not None:
        parts = dict(mf.known_families(spark, state_dir, ctx))
    for f, cols in parts.items():
        if cols:
            name = f"{ctx}/{f}" if f else ctx
            register_table(spark, database, f"{table}_{f}" if f else table, f"{dst}/{f}" if f else dst, cols,
                           layout=kw.get("layout", "ymd"), fmt=kw.get("fmt", "csv"),
                           db_location=db_location, batches=None if f else res.batches,
                           types=mf.column_types(spark, state_dir, ctx, name) if kw.get("fmt", "csv") == "csv" else None)
    return res


def read_increment(spark: SparkSession, ctx: str, src: str, state_dir: str,
                   glob: str = "*.csv", csv_options: dict | None = None, max_files: int = 10_000) -> DataFrame:
    """S2 alone: the rows of the files not yet committed for ``ctx`` (no write).
    More than ``max_files`` of them raise, since their paths go through the
    driver; ``ingest`` takes any number, in batches."""
    manifest = mf.read_manifest(spark, state_dir)
    found = mf.new_files(src_files.list_files(spark, src, glob), manifest, ctx).limit(max_files + 1)
    new = mf.file_frame(spark, mf.collect_files(found))
    if new.count() > max_files:
        raise ValueError(f"over {max_files} new files; use ingest, or raise max_files")
    groups = src_files.header_groups(new, csv_options)
    return src_files.csv_scan(spark, groups, options=csv_options).drop(
        src_files.CORRUPT_COL, src_files.SOURCE_PATH, src_files.SOURCE_MTIME)
