"""A data source that reads chosen parts of Word packages by their central directories.

Which parts are read is an option of the source, not a pushed filter: with
Spark 4.1.2 a union of two pushed filters of one relation came back empty,
probably because a Python relation keeps one set of them.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.sources import docx
from folioscope.sources.files import open_store

FORMAT = "folioscope_packages"
SCHEMA = "path string, part string, bytes bigint, content binary"

#: Bytes of packages that a task reads, and of content that a batch holds; a larger part is a batch of its own.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


@dataclass
class _Some(InputPartition):
    paths: list


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, task_bytes: int, names: list[str]):
        self.path, self.suffix, self.task_bytes = path, suffix, task_bytes
        # a star stands for any characters
        self.names = "|".join(".*".join(map(re.escape, name.split("*"))) for name in names)

    def partitions(self):
        from pyarrow.fs import FileSelector

        store, base = open_store(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(self.suffix))
        tasks, held = [], self.task_bytes
        for path, size in files:
            if held >= self.task_bytes:
                tasks.append([])
                held = 0
            tasks[-1].append(path)
            held += size + 65536  # a small file costs its opening
        return [_Some(paths) for paths in tasks] or [_Some([])]

    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())])
        store, _ = open_store(self.path)
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for path in partition.paths:
            with store.open_input_file(path) as file:
                try:
                    package = zipfile.ZipFile(file)
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is too short to have a directory
                    continue
                if not {docx.CONTENT_TYPES, docx.MAIN} <= set(package.namelist()):
                    continue
                for info in package.infolist():
                    if not info.is_dir() and re.fullmatch(self.names, info.filename, re.DOTALL):
                        rows.append((path, info.filename, info.file_size, package.read(info)))
                        held += info.file_size
                        if held >= BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()


class Packages(DataSource):
    """Reader of (path, part, bytes, content): option ``path``, ``names`` (a JSON list), ``suffix`` (.docx) and ``task_bytes``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("suffix", ".docx"), int(self.options.get("task_bytes", TASK_BYTES)), json.loads(self.options.get("names", '["*"]')))


def parts(spark: SparkSession, path: str, *names: str, suffix: str = ".docx", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, part, bytes, content) of the named parts of the packages below a folder, of all where none is named.

    A star in a name stands for any characters.  No other part is read.  Files
    that are no package have no rows; a part that is broken fails the read, if
    it is read.
    """
    spark.dataSource.register(Packages)
    return spark.read.format(FORMAT).option("names", json.dumps(names or ["*"])).option("suffix", suffix).option("task_bytes", str(task_bytes)).load(path)


def main_parts(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, part, xml) of the main parts; bytes that are no UTF-8 become U+FFFD."""
    return parts(spark, path, docx.MAIN, **options).select("path", "part", F.make_valid_utf8(F.col("content").cast("string")).alias("xml"))


def part_facts(found: DataFrame, kinds=None) -> DataFrame:
    """The facts of parts (path, part, content) that hold paragraphs, as ``docx.facts`` has them for whole packages; null content has none; of ``kinds`` alone, if given."""
    wanted = None if kinds is None else frozenset(kinds)

    def read(batches):
        for batch in batches:
            for piece in docx.slices(batch, "content"):
                rows = []
                for path, part, content in zip(*(piece.column(c).to_pylist() for c in ("path", "part", "content"))):
                    if content is not None:
                        root = ElementTree.parse(io.BytesIO(content)).getroot()
                        rows += [(path, kind, part, *rest) for kind, *rest in docx._part_rows(root, part, part == docx.MAIN, wanted)]
                    if len(rows) >= docx.SLICE_FACTS:
                        yield docx.fact_batch(rows)
                        rows = []
                if rows:
                    yield docx.fact_batch(rows)

    return found.select("path", "part", "content").mapInArrow(read, docx.FACTS)


def header_paragraphs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Paragraphs of headers and footers, with their part, in its order; no other part is read."""
    facts = part_facts(parts(spark, path, "word/header*.xml", "word/footer*.xml", **options), ["part_paragraph", "cell_paragraph"])
    return facts.select("path", "part", "place", "source_ref", "text", F.col("attrs")["style"].alias("style"))


# Kinds of visible objects, the marks of each in a part, and the place in the main part that stands for them.
VISIBLE_OBJECTS = {
    "text_box": (["txbxContent", "<v:textbox", "wps:txbx"], "textbox[1]"),
    "footnote": (["w:footnoteReference"], "footnoteReference[1]"),
    "image": (["pic:pic", "<a:blip"], "drawing[1]"),
}


def visible_objects(xml_parts: DataFrame) -> DataFrame:
    """(path, part, content_id, object_type, source_ref): kinds of visible objects in parts (path, part, xml), one row a kind and part."""
    found = [
        F.when(
            F.coalesce(*[F.when(F.contains(F.col("xml"), F.lit(m)), True) for m in marks], F.lit(False)),
            F.struct(F.lit(f"u_{kind.replace('_', '')}_001").alias("content_id"), F.lit(kind).alias("object_type"), F.concat("part", F.lit(f":{place}")).alias("source_ref")),
        )
        for kind, (marks, place) in VISIBLE_OBJECTS.items()
    ]
    return xml_parts.select("path", "part", F.explode(F.array_compact(F.array(*found))).alias("o")).select("path", "part", "o.*")
