"""Helpers that the training-data operators share: inputs, shared storage and numpy text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Arrow batches are cut again to about this many bytes of text, so a kernel's arrays stay small.
CHUNK_BYTES = 1 << 20
#: Rows (and so the largest texts) that one Arrow batch may hold.
BATCH_ROWS = 256

#: A key with more than one part in HOT of all rows is joined by broadcast.
HOT = 4096

_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch: a text may be a million times longer than the usual one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-terralith-"))
    return _LOCAL[0]


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terralith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: never a broadcast."""
    return left.join(right.hint("merge"), on, how)


def joined_by_key(rows: DataFrame, keys: DataFrame, key: str | list[str], total: int, parts: int | None = None) -> DataFrame:
    """rows with the columns of keys (one row a key; m: how many of the total rows hold it).

    A key is hot if it holds more than one part in HOT of all rows, so there are HOT such keys at most. Their
    rows stay where they are and meet a broadcast; only the rest is shuffled.
    """
    names = [key] if isinstance(key, str) else key
    limit = max(1, total // (parts or HOT))
    hot = keys.where(F.col("m") > limit)
    marked = rows.join(F.broadcast(hot.select(*names, F.lit(True).alias("__hot"))), names, "left")
    cold = merged(marked.where("__hot IS NULL").drop("__hot"), keys.where(F.col("m") <= limit), names)
    return cold.unionByName(rows.join(F.broadcast(hot), names))


def streamed_sha256(pieces: DataFrame, key: str, order: str, sep: str) -> DataFrame:
    """key, sha256 of each key's pieces (a column of that name), joined by sep in order.

    A task reads its keys' pieces one after the other, sorted, and holds the state of one digest only.
    """

    def digest(batches):
        import hashlib

        import pyarrow as pa

        kind, now, state = None, None, None
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), ([], [])
            kind = batch.schema.field(0).type
            for k, piece in zip(keys, batch.column(1).to_pylist(), strict=True):
                if state is not None and k == now:
                    state.update(sep.encode())
                else:
                    if state is not None:
                        done[0].append(now)
                        done[1].append(state.hexdigest())
                    now, state = k, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.string())], [key, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], [key, "sha256"])

    rows = pieces.select(key, order, "piece").repartition(key).sortWithinPartitions(key, order).select(key, "piece")
    return rows.mapInArrow(digest, f"{key} {pieces.schema[key].dataType.simpleString()}, sha256 string")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, though body's own lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- numpy kernels


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about limit bytes each; a longer text is a range by itself."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_NEAR = 64


def _letters(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte at its place in a word, without any structure a text could exploit."""
    return mix(mix(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)) + codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_TABLE = _letters(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text; their first bytes, ends, and each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    text = _LOWER[data] if lower else data
    solid = ~_SPACE[text]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    where = np.flatnonzero(solid)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    begins = np.searchsorted(where, starts)
    lengths = np.diff(np.append(begins, len(where)))
    inside = np.arange(len(where)) - np.repeat(begins, lengths)
    value = _TABLE[text[where] + 256 * np.minimum(inside, _NEAR - 1)]
    far = np.flatnonzero(inside >= _NEAR)
    if len(far):
        value[far] = _letters(text[where[far]], inside[far])
    hashed = mix(np.add.reduceat(value, begins) ^ lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashed, starts, starts + lengths, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words; fewer words make one run, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k])
    return out
