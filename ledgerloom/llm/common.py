"""What the operators of this package share: the shared scratch folder, staged tables, bounded slices and word hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir, ship, staged  # noqa: F401 - for the operators of this package too

#: A word, for the regular expressions of Spark and of DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one slice of a batch holds at most, unless a single document is longer.
SLICE_BYTES = 2 << 20
#: Rows of a small side up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A whole input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows (it is counted; pass a staged table), else unchanged, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key from which a join keeps that key out of the shuffle.
HOT_ROWS = 50_000


def joined(rows: DataFrame, of: DataFrame, on, how: str = "left") -> DataFrame:
    """rows joined with a staged table `of` of one row a key, which has a column `copies`, the rows of its key; on(rows, of) is the condition.

    A few keys are broadcast. Of many, only those of HOT_ROWS rows or more are, whose number is the rows over that at
    most; the others shuffle, so no task gets more than HOT_ROWS rows of one key.
    """
    if of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        b = F.broadcast(of)
        return rows.join(b, on(rows, b), how)
    hot, rest = F.broadcast(of.filter(F.col("copies") >= HOT_ROWS)), of.filter(F.col("copies") < HOT_ROWS)
    return rows.join(hot, on(rows, hot), "inner").unionByName((left := rows.join(hot, on(rows, hot), "left_anti")).join(rest, on(left, rest), how))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, compared as Spark resolves names."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def quoted(names) -> list[Column]:
    """Columns by their exact names, whatever signs these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain_names(df: DataFrame):
    """df with names that mapInArrow() takes (it fails on dots), and what gives a frame its names back, new columns behind them."""
    names = df.columns
    safe = [n if re.fullmatch(r"\w+", n) else f"__column{i}" for i, n in enumerate(names)]
    return (df, lambda out: out) if safe == names else (df.toDF(*safe), lambda out: out.toDF(*names, *out.columns[len(names) :]))


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % m


def fs_of(uri: str):
    """A pyarrow file system and the path in it, for Python on executors."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(use_mmap=True), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that a repeated or doubled task leaves one whole file."""
    fs, path = fs_of(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def get(uri: str) -> pa.Buffer:
    """The bytes of a file; mapped, not read, where the file system is local."""
    fs, path = fs_of(uri)
    f = fs.open_input_file(path)
    return f.read_buffer()


def exists(uri: str) -> bool:
    from pyarrow.fs import FileType

    fs, path = fs_of(uri)
    return fs.get_file_info(path).type == FileType.File


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives memory that Python and Arrow no longer use back to the system: workers stay for later tasks of any kind."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def roomy() -> None:
    """Lets the C library keep what arrays free, for functions that allocate large ones all the time; release() at their end gives it back."""
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES, give_back: bool = True) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold at most so many bytes of text, or one row. Unless told not to, memory is given back after each."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                if give_back:
                    release()
                start, total = i, 0
            total += n
        yield batch.slice(start)
        if give_back:
            release()


def grouped(batches, keys: list[str]):
    """Tables of the rows of one key each, from rows that come sorted by these integer columns."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([col(b, x).to_numpy() for x in keys], axis=1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
            now = tuple(k[a].tolist())
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)
    release()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascending(a: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting (np.unique() may hash first, which is far slower on long arrays)."""
    s = np.sort(a)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run starts, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
