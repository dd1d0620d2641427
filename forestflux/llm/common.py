"""What the operators of this subpackage share: the shared folder, written tables, and word and hash kernels on numpy."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that any operator here ships to every task.
MAX_BROADCAST_BYTES = 64 << 20

#: The six ASCII blanks that end a word: space and \t \n \v \f \r.
BLANKS = (32, 9, 10, 11, 12, 13)


# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="forestflux-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_scratch: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path under the shared folder, within the innermost scratch folder if one is open."""
    return "/".join([shared_root(spark), *_scratch, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder for all that is written meanwhile, deleted at the end; what comes out of it must be written elsewhere before."""
    _scratch.append(f"scratch-{uuid.uuid4().hex}")
    path = "/".join([shared_root(spark), *_scratch])
    try:
        yield
    finally:
        _scratch.pop()
        _delete(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write go as soon as it ends
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table that table() returned, once nothing will read it again."""
    _delete(df.sparkSession, df._written_to)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which go once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_path(uri: str) -> str | None:
    """The local path of a file: URI or plain path, else None."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file by way of a name of its own, so that a repeated or lost task never leaves half a file."""
    path = local_path(uri)
    tag = uuid.uuid4().hex
    if path is not None:
        folder, base = os.path.split(path)
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.{base}.{tag}"
        with open(own, "wb") as out:
            out.write(data)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder, _, base = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{base}.{tag}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, path)


def partitions_for(df: DataFrame, total_bytes: int, per_task: int) -> int:
    """Tasks for total_bytes at per_task each, and no fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-int(total_bytes) // per_task))


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, over all rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


# ---------------------------------------------------------------- numpy kernels

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; n is rounded up, so few tables are kept."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(_MULTIPLIER, size), _powers(_INVERSE, size)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on uint64."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of symbols[start:end], equal for equal contents wherever they stand."""
    up, down = powers(len(symbols) + 1)
    total = np.empty(len(symbols) + 1, np.uint64)
    total[0] = 0
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out)


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k symbols in a row; symbols may be bytes or 64-bit word hashes."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return range_hashes(symbols, at, at + k)


@lru_cache(maxsize=2)
def blank_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(BLANKS)] = True
    return out


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and where each starts (with the total length last)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.empty(0, np.uint8)
    return data, starts


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs whose sizes sum to at most `most`, one row at least."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, end
        at = end


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > ends[:-1]
    last = np.append(first[1:], True)
    return starts[first], ends[last]


def batch_texts(column) -> list[bytes]:
    """The UTF-8 texts of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]
