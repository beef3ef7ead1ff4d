"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="tillkit-"), "tillkit_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Only a local master gets a folder of
    its own when the setting is absent; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tillkit-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of the shared store for all that is ``staged`` within, deleted at the end.

    What was computed from it must be written elsewhere before.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.remove(path)
        remove(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder (or the ``scratch`` one) and read it back.

    Cuts the lineage: what is read twice is computed once, and a lost executor
    costs no more than the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> list:
    """Two 64-bit hashes that stand for a whole text (null: a key of its own)."""
    return [F.xxhash64(F.col(text)).alias("t1"),
            F.xxhash64(F.lit(7), F.col(text), F.lit(11)).alias("t2")]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, each made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=U64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled:filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
        filled += step
    return out


class Powers:
    """Powers of the base and of its inverse, kept as long as any text needs."""

    def __init__(self) -> None:
        self.up = self.down = powers(BASE, 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, n), powers(BASE_INVERSE, n)
        return self.up, self.down


def prefix_hash(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * base**i; one longer than ``values``."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values.astype(U64) * up[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever those values stand."""
    return (prefix[end] - prefix[start]) * down[start]


def blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes sum to about ``most``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield slice(start, len(sizes))


def flat_utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after the other, and where each starts."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), at


def release() -> None:
    """Give memory that a finished task no longer needs back to the system, as
    Spark keeps idle Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
