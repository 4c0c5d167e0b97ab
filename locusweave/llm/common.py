"""What several operators share: shared-folder tables, worker import path, byte-level words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds at most (one longer document is a block of its own).
BLOCK_BYTES = 2_000_000
#: Keys with over one row in so many are joined by broadcast (there are no more than so many of them).
SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_path(spark: SparkSession) -> None:
    """Let Python workers of a local run import this package; a cluster gets it by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one of a local session."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="locusweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lw-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, counted: DataFrame, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right (one row per key at most) where few keys may hold most of left's rows. counted is a written
    table that has left's keys as often as left: keys of over 1 / SHARE of its rows, SHARE at most, are joined with
    their rows of right by broadcast, all others by the plan that Spark chooses."""
    per = counted.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(64, (counted.count() if total is None else total) // SHARE))
    hot = [r[0] for r in per.where(F.col(key).isNotNull()).collect()]
    if not hot:
        return left.join(right, key, how)
    common = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(common).join(F.broadcast(right.where(common)), key, how).unionByName(left.where(~common).join(right.where(~common), key, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def crc_mod(column: str, n: int):
    """crc32(id as text) mod n, by which the queries choose rows to learn from."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


# ---------------------------------------------------------------- byte-level words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of a block of documents.

    data: lower-cased bytes; start, end: of each word; first: index of each document's first word,
    with one more entry for the end; hashes(): 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.data = _LOWER[data]
        n = len(data)
        inside = ~separators[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        power, inverse = _power(n + 1)
        if not hasattr(self, "sums"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        return self.sums, inverse

    def hashes(self) -> np.ndarray:
        sums, inverse = self._sums()
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def prefix_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have at least so many bytes, and the hashes of their first bytes (unlike those of whole words)."""
        sums, inverse = self._sums()
        at = np.flatnonzero(self.end - self.start >= length)
        start = self.start[at]
        return at, mix(((sums[start + length] - sums[start]) * inverse[start]) ^ np.uint64(0xA5A5A5A5 + length))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into blocks: (first row, end row, bytes, offsets of the documents). Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a function made once per task; what it yields are columns by name."""
    worker_path(df.sparkSession)
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for out in each(batch):
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def in_process_threads() -> None:
    """Keep libraries inside a task to its own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
