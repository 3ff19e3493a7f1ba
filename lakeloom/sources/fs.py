"""Small file-system actions on the cluster file system (Hadoop FileSystem API).

Used for metadata-only work: existence checks, renames and deletes of whole
files or folders. No row data passes through these helpers.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hpath


def qualify(spark: SparkSession, path: str) -> str:
    """The fully qualified form Spark prints for ``path`` (e.g. ``file:/x``)."""
    fs, p = _fs_and_path(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.delete(p, recursive))


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p = _fs_and_path(spark, src)
    _, q = _fs_and_path(spark, dst)
    return bool(fs.rename(p, q))


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, whole or not at all; False if it exists.

    The text is written beside it and renamed without overwriting, which is one
    step of the file system: of two callers one wins.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs, tmp = target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
        context.rename(fs.makeQualified(tmp), fs.makeQualified(target),
                       gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except Py4JJavaError as e:
        fs.delete(tmp, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over an earlier one."""
    fs, p = _fs_and_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the direct children of ``folder``, files and folders."""
    fs, p = _fs_and_path(spark, folder)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def list_data_files(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Direct children of ``folder`` that are files (not ``_``/``.`` markers)."""
    fs, p = _fs_and_path(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isFile() and not name.startswith(("_", ".")) and name.endswith(suffix):
            out.append(st.getPath().toString())
    return sorted(out)


def file_sizes(spark: SparkSession, folder: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the data files directly under ``folder``."""
    fs, p = _fs_and_path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted((st.getPath().toString(), int(st.getLen())) for st in fs.listStatus(p)
                  if st.isFile() and not st.getPath().getName().startswith(("_", "."))
                  and st.getPath().getName().endswith(suffix))


# ---------------------------------------------------------------------------
# Many small files, written and read by the tasks
# ---------------------------------------------------------------------------

def python_uri(path: str) -> str:
    """A Hadoop path's URI as Arrow spells it."""
    # Hadoop prints local files as file:/x; Arrow wants file:///x.
    if path.startswith("file:/") and not path.startswith("file:///"):
        return "file:///" + path[len("file:/"):].lstrip("/")
    if path.startswith("s3a://") or path.startswith("s3n://"):
        return "s3://" + path.split("://", 1)[1]
    return path


def open_root(root: str):
    """(file system, folder) of a qualified folder, for Python."""
    from pyarrow import fs as pafs

    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(python_uri(root))


def python_reaches(spark: SparkSession, root: str) -> bool:
    """Whether Python has a client for the file system of ``root``."""
    import pyarrow as pa

    try:
        open_root(qualify(spark, root))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return False


def _spelled(path: str) -> str:
    # Control characters, as Spark spells them in a folder's name.
    return re.sub(r"[\x01-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", path)


def _put_batches(batches: Iterable, root: str) -> Iterator:
    import pyarrow as pa

    filesystem, base = open_root(root)
    made: set[str] = set()
    out = tmp = target = None

    def close() -> None:
        out.close()
        filesystem.move(tmp, target)  # whole or not at all, also when two tries of a task meet

    for b in batches:
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            path = f"{base}/{_spelled(path)}"
            if path != target:
                if out:
                    close()
                folder, name = path.rsplit("/", 1)
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made = made if len(made) < 10_000 else set()
                    made.add(folder)
                target, tmp = path, f"{folder}/_{uuid.uuid4().hex}.tmp"
                out = filesystem.open_output_stream(tmp)
            out.write(text)
    if out:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["done"])


def put_files(files: DataFrame, root: str) -> None:
    """Write ``files`` (path below ``root``, text): each task writes its own
    files, in place, so nothing is renamed or listed by the driver. Rows of one
    path are one file. A file of that name is replaced."""
    import functools

    from lakeloom.session import ship_package

    spark = files.sparkSession
    ship_package(spark)  # the workers import this module
    rows = files.select(files.columns[0], files[files.columns[1]].cast("binary"))
    rows.mapInArrow(functools.partial(_put_batches, root=qualify(spark, root)), "done int").write.format("noop").mode("overwrite").save()


def _get_batches(batches: Iterable, root: str) -> Iterator:
    import pyarrow as pa
    from pyarrow import fs as pafs

    filesystem, base = open_root(root)

    def read(folder: str, name: str) -> list[bytes]:
        try:
            with filesystem.open_input_stream(f"{folder}/{name}") as f:
                return [f.read()]
        except FileNotFoundError:
            pass
        found = filesystem.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        texts = []
        for x in sorted(found, key=lambda x: x.path):
            if x.type == pafs.FileType.File and not os.path.basename(x.path).startswith(("_", ".")):
                with filesystem.open_input_stream(x.path) as f:
                    texts.append(f.read())
        return texts

    for b in batches:
        for i, (folder, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            texts = read(f"{base}/{_spelled(folder)}", name)
            if texts:
                one = b.slice(i, 1)
                rows = [pa.array([one.column(k)[0].as_py()] * len(texts), one.schema.field(k).type) for k in range(2, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=[*b.schema.names[2:], "text"])


def get_files(wanted: DataFrame, root: str) -> DataFrame:
    """The texts of ``wanted`` (folder below ``root``, name, other columns): the
    other columns and ``text``. Where the folder has no file of that name, all
    files in it are read; where there is none, no row is given."""
    import functools

    from lakeloom.session import ship_package

    spark = wanted.sparkSession
    ship_package(spark)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[2:]]
    named = wanted.toDF("_folder", "_name", *wanted.columns[2:])
    return named.mapInArrow(functools.partial(_get_batches, root=qualify(spark, root)), ", ".join([*kept, "text string"]))
