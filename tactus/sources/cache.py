"""A content-addressed cache: files are kept under their SHA-256, verified whenever they are asked for.

A file that is there and has its digest is taken as it is. A spoiled one is removed and fetched again. What is fetched goes to a
temporary name in the same folder, is digested on its way, and is moved to its place only if the digest is the expected one; the
temporary file never stays. All of it runs in tasks, a file at a time in pieces, so that no file is held whole, and tasks that
fetch the same file at once leave one whole copy.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.session import durable
from tactus.sources.store import store_of

#: Bytes that are copied at once.
PIECE = 4 << 20
CACHED = "name string, sha256 string, path string, status string, told string"
#: What became of a file: taken from the cache, fetched, fetched in place of a spoiled one, not what was expected, not to be had.
KEPT, FETCHED, REPLACED, REJECTED, MISSING = "kept", "fetched", "replaced", "rejected", "missing"


def place_of(folder: str, sha256: str) -> str:
    return f"{folder}/{sha256[:2]}/{sha256}"


def digest_of(uri: str) -> str | None:
    """SHA-256 of a file, None where there is none."""
    store, path = store_of(uri)
    if store.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    sha = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            sha.update(piece)
    return sha.hexdigest()


def obtain(sha256: str, source: str | None, folder: str) -> tuple[str | None, str, str | None]:
    """(path, status, what is told of a failure) of one file."""
    place = place_of(folder, sha256)
    there = digest_of(place)
    if there == sha256:
        return place, KEPT, None
    store, path = store_of(place)
    if there is not None:
        store.delete_file(path)
    if source is None:
        return None, MISSING, "not in the cache, and without a source"
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    try:
        sha, (origin, at) = hashlib.sha256(), store_of(source)
        with origin.open_input_stream(at) as f, store.open_output_stream(temporary) as out:
            while piece := f.read(PIECE):
                sha.update(piece)
                out.write(piece)
        if sha.hexdigest() != sha256:
            return None, REJECTED, f"{source} has the digest {sha.hexdigest()}"
        store.move(temporary, path)
    except (OSError, pa.ArrowException) as e:
        return None, MISSING, f"{source}: {type(e).__name__}"
    finally:
        if store.get_file_info(temporary).type == pyarrow.fs.FileType.File:
            store.delete_file(temporary)
    return place, FETCHED if there is None else REPLACED, None


def cached(wanted: DataFrame, folder: str, strict: bool = True, most_named: int = 20) -> DataFrame:
    """wanted (name, sha256, source) -> CACHED: the files in the cache, fetched where needed; source may be null (take it from the cache alone).

    With strict, files that can't be had raise a ValueError that names the first of them; else their path is null and their status says why.
    Each digest is fetched once, however many names it has. Null digests raise.
    """
    if not wanted.where("sha256 is null").isEmpty():
        raise ValueError("a file without a digest can't be verified")
    one = wanted.groupBy(F.lower("sha256").alias("sha256")).agg(F.min("source").alias("source"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(sha, *obtain(sha, None if source is None or source != source else source, folder)) for sha, source in zip(batch["sha256"], batch["source"], strict=True)]
            yield pd.DataFrame(rows, columns=["sha256", "path", "status", "told"], dtype=object)

    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = durable(one.repartition(tasks, "sha256").mapInPandas(fetch, "sha256 string, path string, status string, told string"), "cached-files")
    out = wanted.select("name", F.lower("sha256").alias("sha256")).join(done, "sha256").select("name", "sha256", "path", "status", "told")
    if strict:
        failed = out.where("path is null").orderBy("name").limit(most_named).collect()
        if failed:
            raise ValueError("; ".join(f"{r['name']} {r['status']}: {r['told']}" for r in failed))
    return out
