"""Shared parts of the training-data operators: tables, written intermediate results and word batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that one vectorised step works on at most, unless a single document has more.
WORDS_AT_ONCE = 300_000
#: Rows that an Arrow batch between the JVM and a Python worker has at most.
ROWS_IN_BATCH = 1_000

_own_dir: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or a temporary one where none is set, in local mode only."""
    global _own_dir
    if set_dir := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder, which cuts the lineage and outlives executors.

    It is deleted at the end of the scratch() around it, or else when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    if not _left:
        atexit.register(_clear)
    _left.append(out)
    if _scopes:
        _scopes[-1].append(out)
    return out


_left: list[DataFrame] = []
_scopes: list[list[DataFrame]] = []


def _clear() -> None:
    for table in [*_left]:
        if table.sparkSession.sparkContext._jsc is not None:
            discarded(table)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables written within, which nothing may read afterwards, but for those that kept() names."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            discarded(table)


def kept(table: DataFrame) -> DataFrame:
    """Leaves a written table to the surrounding scope."""
    _scopes[-1][:] = [t for t in _scopes[-1] if t is not table]
    if len(_scopes) > 1:
        _scopes[-2].append(table)
    return table


def discarded(table: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark, path = table.sparkSession, table._tessera_path
    _left[:] = [t for t in _left if t is not table]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as texts can be long; the session's own lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_IN_BATCH:
        spark.conf.set(key, str(ROWS_IN_BATCH))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: (out for batch in batches for out in step(batch)), schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def word_runs(texts: list[bytes | None]) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first row, row after the last, words of each row) for runs of rows with WORDS_AT_ONCE words or a single row."""
    first, held, words = 0, 0, []
    for row, text in enumerate(texts):
        own = text.split() if text else []
        if words and held + len(own) > WORDS_AT_ONCE:
            yield first, row, words
            first, held, words = row, 0, []
        words.append(own)
        held += len(own)
    if words:
        yield first, len(texts), words


def word_hashes(words: list[list[bytes]]) -> np.ndarray:
    """The XXH64 of each word of all lists."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for own in words for w in own), np.uint64, sum(map(len, words)))


def list_rows(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(length of each list, 0 for null; each field of all structs in the lists as one array)."""
    sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    structs = lists.flatten()
    return sizes, {f.name: structs.field(f.name).to_numpy(zero_copy_only=False) for f in structs.type}


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, so that order and low bits of the values look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHashes:
    """Polynomial hashes modulo 2**64 of any range of a sequence of word hashes, from one prefix sum."""

    def __init__(self, symbols: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(symbols)
        self.down = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(base, n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        own = np.full(max(n, 1024), base, np.uint64)
        own[0] = 1
        _powers[base] = np.multiply.accumulate(own)
    return _powers[base][:n]


def hex64(column) -> F.Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
