"""Helpers the corpus operators share: the folder for written tables, word hashing, documents in order."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; a cluster ships it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under spark.checkpoint.dir, which every executor can reach.

    Only a session that has no such setting (tests on one machine) gets a temporary folder of its own.
    """
    importable(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-plumeledger-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there and its size is known."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder that shared_dir() gave, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, write) -> str:
    """Let write(stream) make the file under a name of its own, then move it to its place: a task that is run again leaves one whole file."""
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, f"{root}/{name}")
    return f"{root}/{name}"


def with_columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


class WordHashes(dict):
    """Word to 64-bit hash; keeps at most `limit` words, the others are hashed each time.

    Workers live on from stage to stage with what they keep; frequent words are seen early, so more words would add memory and save no time.
    """

    def __init__(self, limit: int = 1 << 16):
        self.limit = limit

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def shingles(h: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the row of each. h: the rows' word hashes, end to end.

    A row of fewer words, but not none, gives its whole sequence as one shingle.
    """
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    n = len(h) - k + 1
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        x = np.zeros(n, np.uint64)
        for i in range(k):
            x = mix(x + h[i : i + n] + np.uint64(i + 1))
        ok = np.arange(n) + k <= ends[rows[:n]]
        out, own = x[ok], rows[:n][ok]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        starts = ends - lengths
        more = []
        for r in short:
            x = np.zeros(1, np.uint64)
            for i in range(lengths[r]):
                x = mix(x + h[starts[r] + i : starts[r] + i + 1] + np.uint64(i + 1))
            more.append(mix(x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lengths[r]))[0])
        out, own = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([own, short])
    return out, own


def in_blocks(batches, rows: int):
    """Arrow batches cut to `rows` rows at most. At the end Arrow's unused memory goes back to the machine: the worker waits for other stages' tasks."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    b = None
    pa.default_memory_pool().release_unused()


def by_bytes(batch, column: str, most: int):
    """The batch cut into runs of rows whose texts in the column have about `most` bytes at most; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def parts_for(df: DataFrame, rows_each: int, n: int) -> int:
    """Partitions so that each has about rows_each of n rows, one at least."""
    return max(1, -(-n // rows_each))
