"""Files of one result each, written where the rows are."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.session import durable


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path (local without a scheme); Spark's names of the S3 scheme are known."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_files(rows: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Write content (binary or string) as <folder>/<name>, whole or not at all; returns (file, bytes) once all are written.

    A name that comes twice raises: files of equal names would replace each other.
    """
    named = durable(rows.select(name.alias("name"), content.cast("binary").alias("content")), "files-to-write")  # what comes before runs once
    twice = named.groupBy("name").count().where("count > 1").orderBy("name").limit(5).collect()
    if twice:
        raise ValueError(f"more than one file of the names {', '.join(r['name'] for r in twice)}")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder)
        made: set[str] = set()
        for batch in batches:
            for file, data in zip(batch["name"], batch["content"], strict=True):
                path = f"{root}/{file}"
                parent, last = path.rsplit("/", 1)
                if parent not in made:  # a folder is made only for something
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                temporary = f"{parent}/.{last}.{uuid.uuid4().hex}"
                with store.open_output_stream(temporary) as f:
                    f.write(data)
                store.move(temporary, path)
            yield pd.DataFrame({"file": [f"{folder}/{n}" for n in batch["name"]], "bytes": [len(c) for c in batch["content"]]})

    return durable(named.mapInPandas(write, "file string, bytes long"), "written-files")


def file_stem(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
