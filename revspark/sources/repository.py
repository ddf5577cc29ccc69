"""Whole repositories as a data source: plain files and the members of zip and tar archives, read in splits.

``spark.read.format("repository").load(folder)`` gives one row per file, wherever it stands:

    archive    the archive's path below the folder (null: a plain file)
    file_path  the member's name, or the plain file's path below the folder
    extension  lower-cased, with its dot ("" without one)
    size       bytes
    code       its text as UTF-8 (bad bytes replaced); null above ``max_bytes`` (64 MB) and where it cannot be read
    error      why it cannot be read; an archive that cannot be opened is one row with no file_path and extension ""

A zip or plain tar archive is cut by offset into splits of ``split_bytes`` (32 MB); a task reads the directory (zip) or
walks the headers, seeking over the contents (tar), and opens only the members that begin in its split. Compressed tars
have no such offsets and are one split each. Plain files are put together up to a split's size. The driver lists
paths and sizes and opens nothing. Filters on archive, file_path and extension (=, IN, their negations, LIKE 'x%' and
'%x') and the option ``prefix`` (of file_path; errors of whole archives stay) go to the reader: archives and files that
fail get no task, and members that fail are not inflated.

Files are opened with Arrow's file systems, so a folder may be local (shared) or on any of them; a task holds one member.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, Not, StringEndsWith, StringStartsWith

from revspark.functions.lookups import LANGUAGE_BY_EXTENSION, detect_language
from revspark.session import local_fs_path

SPLIT_BYTES = 32 << 20
MAX_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
ARCHIVE_BYTES = 64 << 20
TEMP = "._tmp-"
SCHEMA = "archive string, file_path string, extension string, size long, code string, error string"
ARROW = pa.schema([("archive", pa.string()), ("file_path", pa.string()), ("extension", pa.string()), ("size", pa.int64()),
                   ("code", pa.string()), ("error", pa.string())])
SPLITTABLE = {".zip": "zip", ".tar": "tar"}
STREAMED = (".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    local = local_fs_path(path)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), "/" + local.strip("/")
    file_system, root = pafs.FileSystem.from_uri(path)
    return file_system, root.rstrip("/")


def extension_of(path: str) -> str:
    """The last extension of the lower-cased path, as :func:`detect_language` takes it."""
    low = path.lower()
    return low[low.rindex("."):] if "." in low else ""


@dataclass
class Split(InputPartition):
    kind: str            # plain, zip, tar or stream
    names: list          # paths below the folder: plain files, or one archive
    begin: int = 0
    end: int = 0


def _holds(test, row: dict) -> bool:
    """Whether a filter is true (a null never is) for the columns of a row."""
    if isinstance(test, Not):
        return row[test.child.attribute[0]] is not None and not _holds(test.child, row)
    value = row[test.attribute[0]]
    if value is None:
        return False
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, StringEndsWith):
        return value.endswith(test.value)
    return value == test.value


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.prefix = options.get("prefix", "")
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = isinstance(inner, (EqualTo, In, StringStartsWith, StringEndsWith)) and \
                inner.attribute in (("archive",), ("file_path",), ("extension",))
            if known and None not in (inner.value if isinstance(inner, In) else (inner.value,)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, archive, path, only=None) -> bool:
        row = {"archive": archive, "file_path": path, "extension": extension_of(path or "")}
        if path is not None and not path.startswith(self.prefix):
            return False
        tests = self.tests if only is None else [t for t in self.tests if (t.child if isinstance(t, Not) else t).attribute == (only,)]
        return all(_holds(t, row) for t in tests)

    def partitions(self):
        file_system, root = open_folder(self.path)
        splits, group, held = [], [], 0
        for info in sorted(file_system.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            name = info.path[len(root) + 1:]
            if not info.is_file or posixpath.basename(name).startswith(TEMP):
                continue
            kind = "stream" if name.lower().endswith(STREAMED) else SPLITTABLE.get(extension_of(name))
            if kind is None:
                if self._wanted(None, name):
                    if group and held + info.size > self.split_bytes:
                        splits.append(Split("plain", group))
                        group, held = [], 0
                    group.append(name)
                    held += info.size + 4096  # opening a file costs about as much as reading some
            elif self._wanted(name, None, "archive"):
                step = self.split_bytes if kind != "stream" else max(info.size, 1)
                splits += [Split(kind, [name], k, k + step) for k in range(0, max(info.size, 1), step)]
        return splits + ([Split("plain", group)] if group else []) or [Split("plain", [])]

    def read(self, split):
        rows, held = [], 0
        for row in self._rows(split):
            rows.append(row)
            held += len(row[4] or "")
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types, strict=True)], schema=ARROW)

    def _row(self, archive, path, size, load):
        """The row of a file whose bytes ``load()`` gives."""
        head = (archive, path, extension_of(path), size)
        if size > self.max_bytes:
            return (*head, None, f"larger than {self.max_bytes} bytes")
        try:
            return (*head, load().decode("utf-8", "replace"), None)
        except Exception as e:  # noqa: BLE001 - what one file holds must not end the job
            return (*head, None, f"{type(e).__name__}: {e}")

    def _rows(self, split):
        file_system, root = open_folder(self.path)
        if split.kind == "plain":
            for name in split.names:
                with file_system.open_input_file(f"{root}/{name}") as f:
                    yield self._row(None, name, f.size(), f.read)
            return
        name = split.names[0]
        try:
            if split.kind == "stream":
                with file_system.open_input_stream(f"{root}/{name}", compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                    yield from self._tar(name, t, split)
            else:
                with file_system.open_input_file(f"{root}/{name}") as f:
                    if split.kind == "tar":
                        with tarfile.open(fileobj=f, mode="r:") as t:
                            yield from self._tar(name, t, split)
                    else:
                        with zipfile.ZipFile(f) as z:
                            yield from self._zip(name, z, split)
        except (tarfile.TarError, zipfile.BadZipFile, EOFError) as e:
            # a directory that cannot be read is told once, not once a split
            if (split.begin == 0 or split.kind != "zip") and self._wanted(name, None):
                yield (name, None, "", None, None, f"{type(e).__name__}: {e}")

    def _zip(self, name, z, split):
        for m in z.infolist():
            if split.begin <= m.header_offset < split.end and not m.is_dir() and self._wanted(name, m.filename):
                yield self._row(name, m.filename, m.file_size, lambda m=m: z.read(m))

    def _tar(self, name, t, split):
        for m in t:
            if split.kind == "tar" and m.offset >= split.end:
                return
            t.members = []  # tarfile would keep every header it has seen
            if m.isfile() and (split.kind != "tar" or m.offset >= split.begin) and self._wanted(name, m.name):
                yield self._row(name, m.name, m.size, lambda m=m: t.extractfile(m).read())


class RepositorySource(DataSource):
    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RepositoryReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """The data source's rows. Turns on filter pushdown into Python data sources for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").options(**options).load(path)


def read_repository(spark: SparkSession, path: str, languages: list[str] | None = None, prefix: str = "", **options) -> DataFrame:
    """``files(review_id, archive, file_path, language, size, code)`` as :func:`read_files` gives them, of the given languages
    and below the given path only, with ``error``: rows that could not be read have one, and neither code nor language.

    Files whose extension belongs to another language are not opened; the language of a file without a known extension
    follows from its text.
    """
    rows = read_archives(spark, path, prefix=prefix, **options)
    if languages is not None:
        rows = rows.where(~F.col("extension").isin([e for e, lang in LANGUAGE_BY_EXTENSION if lang not in languages]))
    files = rows.select(
        F.xxhash64("archive", "file_path").alias("review_id"), "archive", "file_path",
        F.when(F.col("error").isNull(), detect_language(F.col("file_path"), F.col("code"))).alias("language"), "size", "code", "error")
    return files if languages is None else files.where(F.col("language").isin(languages) | F.col("error").isNotNull())


def write_archives(files: DataFrame, path: str, kind: str = "zip", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write ``files(file_path, code)`` (null code: empty) as archives of about ``archive_bytes`` of text each, ``kind`` zip,
    tar or tar.gz; a task writes its rows in order, streaming. Returns the number of files written.

    An archive gets its name, which follows from the task, once it is whole, so that a task that is run again
    replaces what it left.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        file_system, root = open_folder(path)
        file_system.create_dir(root, recursive=True)
        done, out = 0, None

        def close():
            archive, stream, temp, target, _ = out
            archive.close()
            stream.close()
            file_system.move(temp, target)

        for b in batches:
            for name, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (code or "").encode()
                if out is not None and out[4] + len(data) > archive_bytes:
                    close()
                    out, done = None, done + 1
                if out is None:
                    label = f"part-{part:06d}-{done:06d}.{kind}"
                    temp = f"{root}/{TEMP}{TaskContext.get().taskAttemptId()}-{label}"
                    stream = file_system.open_output_stream(temp, compression=None)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else \
                        tarfile.open(fileobj=stream, mode="w|gz" if kind == "tar.gz" else "w|")
                    out = [archive, stream, temp, f"{root}/{label}", 0]
                if kind == "zip":
                    out[0].writestr(name, data)
                else:
                    member = tarfile.TarInfo(name)
                    member.size = len(data)
                    out[0].addfile(member, io.BytesIO(data))
                out[4] += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
        if out is not None:
            close()

    return files.select("file_path", "code").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
