"""A data source that writes one file a row, such as canonical JSON or YAML documents, and keeps all of them or none.

Register with :func:`register`, or write through :func:`write_files`.  Every
task writes into a staging folder of its own attempt; the commit moves the
folders of the tasks that count to ``part-<task>-<job>`` and leaves a manifest,
an abort removes the staging folder.  So the driver does one move a task, never
one a file, and a lost executor or a second attempt leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "folioscope_files"
#: Files of a task are listed in this file of its folder: name, size and hash of each.
INDEX = "_index.jsonl"


def open_store(path: str):
    """(file system, path) of a folder that pyarrow knows: local, or of a scheme such as hdfs, s3 or gs."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path.rstrip("/"))


def as_json(text: str) -> bytes:
    """Canonical JSON: sorted keys, two blanks a level, non-ASCII as it is, a line end at the end."""
    return (json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def as_yaml(text: str) -> bytes:
    """The JSON text's value as YAML in block style, keys in their own order, non-ASCII as it is."""
    import yaml  # of the cluster's Python; a clear error where it is not installed

    return yaml.safe_dump(json.loads(text), allow_unicode=True, sort_keys=False).encode()


FORMS = {"json": as_json, "yaml": as_yaml, "bytes": lambda content: content if isinstance(content, bytes) else content.encode()}


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, how many files and bytes, and the hash of its index, which holds the hash of each file."""

    task: int
    folder: str
    files: int
    size: int
    index_hash: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, form: str, overwrite: bool):
        if form not in FORMS:
            raise ValueError(f"form must be one of {sorted(FORMS)}, not {form!r}")
        self.path, self.form, self.overwrite, self.job = path, form, overwrite, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = open_store(self.path)
        folder = f"{self._staging(base)}/task-{context.partitionId()}-{context.taskAttemptId()}"
        encode, index, names, made, size = FORMS[self.form], [], set(), set(), 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name of a file below the folder")
                if name in names:
                    raise ValueError(f"several rows are named {name!r}")
                names.add(name)
                try:
                    data = b"" if content is None else encode(content)
                except ValueError as error:
                    raise ValueError(f"content of {name!r} is no JSON: {error}") from error
                target = f"{folder}/{name}"
                if (inside := target.rpartition("/")[0]) not in made:
                    store.create_dir(inside, recursive=True)
                    made.add(inside)
                with store.open_output_stream(target, compression=None) as out:
                    out.write(data)
                size += len(data)
                index.append(json.dumps({"name": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}, ensure_ascii=False))
        listing = "".join(line + "\n" for line in sorted(index)).encode()
        if index:
            with store.open_output_stream(f"{folder}/{INDEX}", compression=None) as out:
                out.write(listing)
        return Written(context.partitionId(), folder, len(index), size, hashlib.sha256(listing).hexdigest())

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        old = [f.path for f in store.get_file_info(FileSelector(base)) if f.base_name.startswith(("part-", "_manifest"))] if self.overwrite else []
        parts = []
        for m in sorted((m for m in messages if m is not None and m.files), key=lambda m: m.task):
            part = f"part-{m.task:05d}-{self.job}"
            store.move(m.folder, f"{base}/{part}")
            parts.append({"part": part, "files": m.files, "bytes": m.size, "index_sha256": m.index_hash})
        manifest = json.dumps({"form": self.form, "parts": parts}, indent=2, sort_keys=True) + "\n"
        with store.open_output_stream(f"{base}/_manifest-{self.job}.json", compression=None) as out:
            out.write(manifest.encode())
        for path in old:  # what is overwritten goes once the new files stand
            store.delete_dir(path) if store.get_file_info(path).type.name == "Directory" else store.delete_file(path)
        self._clear(store, base)

    def abort(self, messages):
        self._clear(*open_store(self.path))

    def _clear(self, store, base):
        if store.get_file_info(self._staging(base)).type.name == "Directory":
            store.delete_dir(self._staging(base))


class Files(DataSource):
    """Writer of (name, content): option ``path``, and ``form`` json, yaml (content is JSON text) or bytes."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "name string, content string"

    def writer(self, schema, overwrite):
        if {"name", "content"} - set(schema.names):
            raise ValueError("rows must have the columns name and content")
        return _Writer(self.options["path"], self.options.get("form", "json"), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Files)


def write_files(rows: DataFrame, path: str, form: str = "json", overwrite: bool = False, name: str = "name", content: str = "content", dealt: bool = False) -> None:
    """Writes each row as the file ``name``: canonical JSON or YAML of the JSON text ``content``, or its bytes.

    Rows are dealt by name, so that equal names meet in one task and fail the
    write, which then leaves nothing; so do null and unsafe names and content
    that is no JSON.  Null content is an empty file; no rows are a manifest
    without parts.  Without ``overwrite`` files are added to those that stand;
    with it, those of earlier writes go after the commit.  ``dealt`` says that
    equal names are in one partition already, which saves the shuffle.
    """
    register(rows.sparkSession)
    named = rows.select(F.col(name).alias("name"), F.col(content).alias("content"))
    (named if dealt else named.repartition("name")).write.format(FORMAT).option("form", form).mode("overwrite" if overwrite else "append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that were written: what stands in committed parts, without indexes and manifests.

    Spark passes over files without a byte, which null content has; the indexes list them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"/part-\d+-[0-9a-f]{32}/(.+)$", 1)
    return found.select(name.alias("name"), "content").filter((F.col("name") != "") & (F.col("name") != INDEX))
