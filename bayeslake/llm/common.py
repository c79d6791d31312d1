"""Helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Code points that count as white space between words and at the ends of lines.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that Python
    workers import it wherever they were started."""
    sc = spark.sparkContext
    if getattr(sc, "_bayeslake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="bayeslake-pkg-"), "bayeslake_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._bayeslake_shipped = True


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is
    cut, every later use sees the same rows, and a lost executor costs only
    the tasks that it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that do not clash with any column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def text_key(text, *, salt: int = 0):
    """128-bit fingerprint of a text as two longs (a struct)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(salt + 1), t).alias("h2"))


def bound(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column that is computed once per row. A plain column
    would be copied into every place that uses it, filters and lambdas
    included; the generator is a border that the optimizer does not move
    expressions across."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^31 as compressed planes of bytes: small ones cost little."""
    planes = np.ascontiguousarray(np.asarray(values, "<i4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<i4").ravel()


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
