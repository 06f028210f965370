"""A data source of one file for each document: rendered texts written, read back, and files rewritten in place.

``rendered`` is a Spark data source in Python (``register`` makes it known)::

    render(docs, "html").select(...).write.format("rendered").option("format", "html").mode("overwrite").save(path)
    spark.read.format("rendered").load(path)          # name, format, mime, body

File systems are those of ``pyarrow.fs`` (local, HDFS, S3, GCS), met in the
tasks.  Each task writes to an attempt folder of its own below ``_attempts``;
the driver renames the folders of the tasks that ended well, one rename a task,
and removes the others, so a failed task or job leaves nothing.  ``overwrite``
first moves what was there to ``_backup`` (option ``backup``, on by default), and
removes it if the option is off.

A name becomes a file name by percent escapes, so every name comes back as it
was, null and empty ones too; a name that repeats in a task gets ``~2`` and so on.
Escaped names may have 200 bytes; a longer one fails the write.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..kernel.markdown import format_text
from ..operators.staging import stage
from .text import FILES, file_type

SCHEMA = "name string, format string, mime string, body string"
_NULL, _EMPTY, LONGEST = "%0", "%", 200


def file_name(name: str | None) -> str:
    if not name:
        return _EMPTY if name is not None else _NULL
    out = quote(name, safe="").replace("~", "%7E").replace(".", "%2E").replace("_", "%5F")
    if len(out) > LONGEST:
        raise ValueError(f"the name {name[:40]!r}... makes a file name of over {LONGEST} bytes")
    return out


def name_of(file: str) -> str | None:
    stem = file.rpartition(".")[0].partition("~")[0]
    return None if stem == _NULL else "" if stem == _EMPTY else unquote(stem)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_below(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    """Files below a folder in the order of their paths; none in folders that begin with an underscore or a dot."""
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in posixpath.relpath(p, root).split("/"))
    return sorted((f for f in found if f.is_file and not hidden(f.path)), key=lambda f: f.path)


def _extension(fmt: str) -> str:
    from ..operators import render  # noqa: F401  (registers the formats; planning runs in a process of its own)

    if fmt not in FILES:
        raise ValueError(f"unknown format {fmt!r}; known: {sorted(FILES)}")
    return FILES[fmt][0]


@dataclass
class Files(InputPartition):
    paths: list[str]


class RenderedReader(DataSourceReader):
    """Tasks of about ``split`` bytes of files each; a large file is read whole."""

    def __init__(self, options: dict[str, str]):
        from ..operators import render  # noqa: F401  (registers the formats)

        self.path, self.split = options["path"], int(options.get("split", 32 << 20))
        self.types = {ext: (fmt, mime) for fmt, (ext, mime) in FILES.items()}

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.path)
        out, size = [Files([])], 0
        for f in files_below(fs, root):
            if out[-1].paths and size + f.size > self.split:
                out, size = [*out, Files([])], 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path) as s:
                body = s.read().decode("utf-8")
            fmt, mime = self.types.get(path.rpartition(".")[2].lower()) or file_type(path)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name_of(posixpath.basename(path)), fmt, mime, body)], names=["name", "format", "mime", "body"])


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    files: int


class RenderedWriter(DataSourceArrowWriter):
    def __init__(self, schema, options: dict[str, str], overwrite: bool):
        missing = {"name", "body"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rendered needs the columns name and body; missing: {sorted(missing)}")
        self.extension = options.get("extension") or _extension(options.get("format", "html"))
        self.path, self.overwrite = options["path"], overwrite
        self.backup = options.get("backup", "true").lower() == "true"
        self.run = uuid.uuid4().hex

    @property
    def attempts(self) -> str:
        return posixpath.join(file_system(self.path)[1], "_attempts", self.run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = file_system(self.path)
        folder, seen, files = posixpath.join(self.attempts, uuid.uuid4().hex), {}, 0
        for b in iterator:
            if b.num_rows and not files:
                fs.create_dir(folder, recursive=True)
            for name, body in zip(b.column("name"), b.column("body"), strict=True):
                stem = file_name(None if name.as_py() is None else str(name.as_py()))
                seen[stem] = again = seen.get(stem, 0) + 1
                with fs.open_output_stream(posixpath.join(folder, f"{stem}{f'~{again}' if again > 1 else ''}.{self.extension}")) as s:
                    s.write((body.as_py() or "").encode())
                files += 1
        return Written(folder if files else None, files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            there = [f for f in fs.get_file_info(pafs.FileSelector(root)) if posixpath.basename(f.path)[:1] not in "_."]
            kept = posixpath.join(root, "_backup", self.run)
            if there and self.backup:
                fs.create_dir(kept, recursive=True)
            for f in there:
                if self.backup:
                    fs.move(f.path, posixpath.join(kept, posixpath.basename(f.path)))
                elif f.is_file:
                    fs.delete_file(f.path)
                else:
                    fs.delete_dir(f.path)
        for k, m in enumerate(m for m in messages if m is not None and m.folder):
            fs.move(m.folder, posixpath.join(root, f"part-{k:05d}-{self.run}"))
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(file_system(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self.attempts).type != pafs.FileType.NotFound:
            fs.delete_dir(self.attempts)
        above = posixpath.dirname(self.attempts)
        if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


class Rendered(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rendered"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RenderedReader:
        return RenderedReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RenderedWriter:
        return RenderedWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Rendered)


def write_documents(docs: DataFrame, path: str, fmt: str | None = None, *, id_col: str = "doc_id", mode: str = "overwrite", backup: bool = True, **options) -> None:
    """Render documents and write one file for each; without ``fmt``, the path's extension names the format."""
    from ..operators.render import render

    if fmt is None:
        fmt = file_type(path)[0]
        if fmt is None:
            raise ValueError(f"no format known for {path!r}")
    register(docs.sparkSession)
    bodies = render(docs, fmt, id_col=id_col, **options).select(F.col(id_col).cast("string").alias("name"), "body")
    bodies.write.format("rendered").option("extension", _extension(fmt)).option("backup", str(backup).lower()).mode(mode).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, format, mime, body) of the files that :func:`write_documents` wrote."""
    register(spark)
    return spark.read.format("rendered").load(path)


# --- in place -------------------------------------------------------------------------


def rewrite_files(spark: SparkSession, path: str, *, width: int = 80, cjk_spacing: bool = False, backup: str | None = ".bak") -> DataFrame:
    """Format the Markdown files below ``path`` in place; (path, changed) of each, when all is done.

    Two jobs, each safe to repeat.  The first writes the new text of every file
    that changes beside it, under a name of this run, and stages what it did.  The
    second copies the old file to its name and ``backup`` (unless that is None) and
    moves the new one into its place; where a task runs again, what is in place
    stays.  If the first job fails, no file has changed and the new ones are removed.
    """
    fs, root = file_system(path)
    names = [f.path for f in files_below(fs, root) if posixpath.splitext(f.path)[1] in (".md", ".markdown")]
    run = f".{uuid.uuid4().hex}.new"
    held = spark.createDataFrame([(p,) for p in names], "path string")
    held = held.repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)))

    def put(batches):
        fs, _ = file_system(path)
        for b in batches:
            changed = []
            for p in b.column(0).to_pylist():
                with fs.open_input_stream(p) as s:
                    old = s.read().decode("utf-8")
                new = format_text(old.removeprefix("\ufeff"), width, cjk_spacing)
                changed.append(new != old)
                if new != old:
                    with fs.open_output_stream(p + run) as s:
                        s.write(new.encode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(changed, pa.bool_())], names=["path", "changed"])

    def swap(batches):
        fs, _ = file_system(path)
        for b in batches:
            for p in b.column(0).to_pylist():
                if fs.get_file_info(p + run).is_file:  # else an earlier try of this task has moved it
                    if backup:
                        fs.copy_file(p, p + backup)
                    fs.move(p + run, p)
            yield b

    try:
        made = stage(held.mapInArrow(put, "path string, changed boolean"))
    except Exception:
        for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if f.path.endswith(run):
                fs.delete_file(f.path)
        raise
    return stage(made.where("changed").mapInArrow(swap, "path string, changed boolean").union(made.where("not changed")))
