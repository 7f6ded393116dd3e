"""Replacing a table as a whole: versions aside each other, and one small file that names the current one.

Writing never touches what is current.  When a version is complete, the file is replaced by a rename, which a file system
does in one step, so whoever reads at any time sees the old version or the new one.  A version stays until two newer
ones exist, so that readers that have just looked it up can finish.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def replace(df: DataFrame, path: str, form: str = "json") -> str:
    """Write ``df`` as the new current version of the table at ``path``; returns the version's name."""
    files, root = _open(path)
    files.create_dir(root, recursive=True)
    before = _named(files, root)
    name = f"v-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{path}/{name}")
    aside = f"{root}/{POINTER}.{name}"
    with files.open_output_stream(aside) as out:
        out.write("\n".join([name, *before[:2]]).encode())
    files.move(aside, f"{root}/{POINTER}")
    for old in before[2:]:
        if files.get_file_info(f"{root}/{old}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{old}")
    return name


def _named(files: fs.FileSystem, root: str) -> list[str]:
    """The current version's name and those before it."""
    if files.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{root}/{POINTER}") as f:
        return f.read().decode().split("\n")


def current(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """The current version; an empty table where none was written."""
    names = _named(*_open(path))
    return spark.read.schema(schema).format(form).load(f"{path}/{names[0]}") if names else spark.createDataFrame([], schema)
