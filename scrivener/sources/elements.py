"""Stored dumps of page elements as a data source: only the pages that are asked for are read.

A dump is one file for each document, ``<name>.elements``. Its first line is an index, {"doc_id", "pages": [[page, begin,
bytes], ...]}, with begins counted from the end of that line; then each page's elements follow as one JSON array. A task reads
the index and seeks to its pages. Broken indexes, pages and elements become rows with an ``error``, so no file ends a job.

    register(spark)
    spark.read.format("element_dumps").load(path).filter("page_num = 3 and error is null")
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

FORMAT, SUFFIX = "element_dumps", ".elements"
_S, _D = T.StringType(), T.DoubleType()
BOX = ("x0", "y0", "x1", "y1")
SCHEMA = T.StructType(
    [T.StructField("path", _S), T.StructField("doc_id", T.LongType()), T.StructField("page_num", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("text", _S)]
    + [T.StructField(c, _D) for c in (*BOX, "font_size")] + [T.StructField("font_name", _S), T.StructField("error", _S)]
)
#: Bytes of dumps that one task reads; a larger dump is shared between tasks by ranges of its pages.
TASK_BYTES = 32 << 20


@dataclass
class Share(InputPartition):
    """Files, each with the share of its pages: (path, which, of how many)."""

    files: tuple[tuple[str, int, int], ...]


def _open_folder(path: str):
    """File system and path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}


class ElementReader(DataSourceReader):
    def __init__(self, path: str, pages: str | None, task_bytes: int) -> None:
        self.path, self.task_bytes = path, task_bytes
        self.tests: list[tuple[str, object]] = []
        if pages:  # "3" or "2-5", both ends included
            first, _, last = pages.partition("-")
            self.tests += [("GreaterThanOrEqual", int(first)), ("LessThanOrEqual", int(last or first))]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests of the page number decide what is read; Spark applies all others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page_num",):
                self.tests.append((type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _wanted(self, page: int) -> bool:
        by_name = {k.__name__: t for k, t in _TESTS.items()}
        return all(by_name[name](page, value) for name, value in self.tests)

    def partitions(self) -> Sequence[Share]:
        from pyarrow import fs

        system, folder = _open_folder(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.is_file and i.path.endswith(SUFFIX)]
        shares, now, held = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.size > self.task_bytes:
                of = -(-info.size // self.task_bytes)
                shares += [Share(((info.path, k, of),)) for k in range(of)]
                continue
            if held + info.size > self.task_bytes and now:
                shares.append(Share(tuple(now)))
                now, held = [], 0
            now.append((info.path, 0, 1))
            held += info.size
        return [*shares, Share(tuple(now))] if now or not shares else shares

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = _open_folder(self.path)
        for path, which, of in partition.files:
            reject = lambda doc, page, e, path=path: (path, doc, page, None, None, *[None] * 6, f"{type(e).__name__}: {e}")
            try:
                file = system.open_input_file(path)
            except OSError as e:
                if which == 0:
                    yield reject(None, None, e)
                continue
            with file:
                try:
                    head, begin = _first_line(file)
                    index = json.loads(head)
                    doc, pages = int(index["doc_id"]), [(int(p), int(at), int(size)) for p, at, size in index["pages"]]
                except (ValueError, KeyError, TypeError) as e:
                    if which == 0:  # told once, however many tasks share the file
                        yield reject(None, None, e)
                    continue
                own = pages[len(pages) * which // of : len(pages) * (which + 1) // of]
                for page, at, size in own:
                    if not self._wanted(page):
                        continue
                    try:
                        elements = json.loads(file.read_at(size, begin + at))
                        rows = [(path, doc, page, n, *_element(e), None) for n, e in enumerate(elements)]
                    except (ValueError, KeyError, TypeError, OSError) as e:
                        yield reject(doc, page, e)
                        continue
                    yield from rows


def _first_line(file) -> tuple[bytes, int]:
    """The first line and where the next begins."""
    head = b""
    while b"\n" not in head:
        more = file.read(1 << 16)
        if not more:
            raise ValueError("no index line")
        head += more
    line = head.split(b"\n", 1)[0]
    return line, len(line) + 1


def _element(e: dict) -> tuple:
    x0, y0, x1, y1 = map(float, e["bbox"])
    size = e.get("font_size")
    return str(e["text"]), x0, y0, x1, y1, None if size is None else float(size), e.get("font_name")


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class ElementWriter(DataSourceWriter):
    """Rows that come document by document become dumps; they get their names when the whole job has succeeded."""

    def __init__(self, path: str, overwrite: bool, columns: list[str]) -> None:
        self.path, self.overwrite, self.columns, self.job = path, overwrite, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, folder = _open_folder(self.path)
        aside = f"{folder}/_aside-{self.job}"
        system.create_dir(aside, recursive=True)
        files, doc, pages = [], None, {}

        def close() -> None:
            if doc is None:
                return
            index, body, at = [], [], 0
            for page, elements in sorted(pages.items()):
                text = json.dumps(elements).encode() + b"\n"
                index.append([page, at, len(text)])
                body.append(text)
                at += len(text)
            name = f"{aside}/{doc}-{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                out.write(json.dumps({"doc_id": doc, "pages": index}).encode() + b"\n" + b"".join(body))
            files.append((name, f"{folder}/{doc}{SUFFIX}"))

        for row in iterator:
            r = dict(zip(self.columns, row, strict=True))
            if r["doc_id"] != doc:
                close()
                doc, pages = r["doc_id"], {}
            pages.setdefault(r["page_num"], []).append({"text": r["text"], "bbox": [r[c] for c in BOX], "font_size": r.get("font_size"), "font_name": r.get("font_name")})
        close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open_folder(self.path)
        for message in messages:
            for aside, name in message.files if message else ():
                system.move(aside, name)
        self._clear(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open_folder(self.path))

    def _clear(self, system, folder: str) -> None:
        from pyarrow import fs

        aside = f"{folder}/_aside-{self.job}"
        if system.get_file_info(aside).type != fs.FileType.NotFound:
            system.delete_dir(aside)


class ElementDumps(DataSource):
    """Options: path; pages (``3`` or ``2-5``); taskBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ElementReader:
        return ElementReader(self.options["path"], self.options.get("pages"), int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ElementWriter:
        return ElementWriter(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, which must hand filters down to sources in Python."""
    spark.dataSource.register(ElementDumps)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_dumps(elements: DataFrame, path: str, order: Sequence[str] = ("y0", "x0")) -> None:
    """Dumps of elements (doc_id, page_num, text, x0, y0, x1, y1, perhaps font_size and font_name), one for each document.

    Documents are dealt by id, and a task holds one document's elements at a time. Rows without an id or a page are left out.
    """
    register(elements.sparkSession)
    columns = ["doc_id", "page_num", "text", *BOX, *[c for c in ("font_size", "font_name") if c in elements.columns]]
    rows = elements.filter("doc_id is not null and page_num is not null").select(*columns)
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "page_num", *order).write.format(FORMAT).mode("append").save(path)


def read_dumps(spark: SparkSession, path: str, pages: str | None = None) -> DataFrame:
    """Elements of the dumps below ``path``, of some pages alone if they are told: SCHEMA without its rejects."""
    return _read(spark, path, pages).filter("error is null").drop("error", "path")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, page_num, error of what can't be read."""
    return _read(spark, path, None).filter(F.col("error").isNotNull()).select("path", "doc_id", "page_num", "error")


def _read(spark: SparkSession, path: str, pages: str | None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT)
    return (reader.option("pages", pages) if pages else reader).load(path)
