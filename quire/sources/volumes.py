"""A sink that writes one file per volume, under a given name, and shows all of them or none.

Rows are (name, seq, body): lines of the file ``name`` in order of ``seq``.  Tasks write into a folder of the run beside
the target; a commit moves the files of the tasks that Spark has taken into place, an abort removes the folder, and a
task that is run again writes files of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from quire.sources.versions import _open


@dataclass
class _Files(WriterCommitMessage):
    made: list[tuple[str, str]]


class VolumeWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"_run-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> _Files:
        """Rows of a file come one after another; a name that turns up again would be a second file, which is refused."""
        files, root = _open(self.path)
        folder, made, out, name = f"{root}/{self.run}/{uuid.uuid4().hex}", [], None, None
        files.create_dir(folder, recursive=True)
        seen: set[str] = set()
        try:
            for row in rows:
                if row["name"] != name:
                    if out is not None:
                        out.close()
                    name = row["name"]
                    if name in seen or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"not a name of one volume: {name}")
                    seen.add(name)
                    made.append((f"{folder}/{name}", name))
                    out = files.open_output_stream(made[-1][0])
                out.write((row["body"] or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return _Files(made)

    def commit(self, messages: list[_Files | None]) -> None:
        files, root = _open(self.path)
        for message in messages:
            for made, name in message.made if message else []:
                files.move(made, f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[_Files | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


class Volumes(DataSource):
    """``df.write.format("volumes").save(path)``; files of the same names are replaced, others stay."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return "name string, seq long, body string"

    def writer(self, schema: StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options["path"])


def write_volume_files(pages: DataFrame, path: str) -> None:
    """Pages (doc_id, vol_idx, name, page_no, body), one file a volume; ``path`` must be one that executors see too.

    A volume's pages meet in one task, which reads them in order and holds one row at a time.
    """
    pages.sparkSession.dataSource.register(Volumes)
    rows = pages.repartition("doc_id", "vol_idx").sortWithinPartitions("doc_id", "vol_idx", "page_no")
    rows.select("name", F.col("page_no").cast("long").alias("seq"), "body").write.format("volumes").mode("append").save(path)
