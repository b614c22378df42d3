"""What the operators share: the scratch folder, written tables, Arrow helpers.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``
(shared by driver and executors). Where it is unset, a session in one process (as in tests) gets a temporary
folder; on a cluster that is an error, as other machines could not read it.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="quadlake-"))
    return f"{base.rstrip('/')}/quadlake"


#: Rows in an Arrow batch while tables are written: whole texts in batches of Spark's 10,000 rows take
#: much of a worker's memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read again: cuts the lineage,
    and the copy outlives any executor. Python workers get batches of at most ``BATCH_ROWS`` rows meanwhile."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH)
    try:
        if not 0 < int(rows) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadlake_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables behind ``written`` frames that nothing reads any more."""
    for df in frames:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quadlake_path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


#: Bits of a bitmap of hashed ids: at most MAP_BITS / 64 rows are broadcast.
MAP_BITS = 1 << 24


def _word(c: str) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(c), F.lit(MAP_BITS)), 6).cast("int")


def _bit(c: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{c}`), 64L) as int))")


def bitmap(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap (_word, _bits) of hashed ids, of a size that does not depend on their number."""
    return ids.groupBy(_word(column).alias("_word")).agg(F.bit_or(_bit(column)).alias("_bits"))


def flagged(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` with a column ``_flag``: false only if its long ``column`` is in no row of the bitmap ``ids``. The
    bitmap is broadcast; what it flags is to be joined, and the other rows need no shuffle."""
    return df.join(F.broadcast(ids), _word(column) == F.col("_word"), "left").withColumn("_flag", F.coalesce(F.col("_bits").bitwiseAND(_bit(column)) != 0, F.lit(False))).drop("_word", "_bits")


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary Arrow column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def tidy() -> None:
    """Give memory that is free back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage, upon which they give most of their free heap back to the system. A heap
    grows with the garbage of all that a session ran before, and does not shrink of itself. A process that a JVM starts is for a
    moment seen with all of its memory, and Hadoop's local file system without native code runs chmod for each file it writes."""
    n = 2 * spark.sparkContext.defaultParallelism  # tasks go to all executors that are free
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("collected")).write.format("noop").mode("overwrite").save()


def slices(batch: pa.RecordBatch, rows: int = 512):
    """Small parts of a batch: what is held as Python objects at a time stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    tidy()


_zstd = pa.Codec("zstd", compression_level=1)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _zstd.compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return _zstd.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def bytewise(x: np.ndarray, kind: str) -> bytes:
    """A column byte by byte, as that compresses well."""
    return np.ascontiguousarray(x.astype(kind).view("<u1").reshape(len(x), -1).T).tobytes()


def whole(raw: bytes, n: int, at: int, kind: str) -> np.ndarray:
    """The column of ``n`` numbers that ``bytewise`` wrote at ``at``."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "<u1", width * n, at).reshape(width, n).T).view(kind).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over a uint64 array."""
    with np.errstate(over="ignore"):
        part = x >> np.uint64(30)
        x = np.bitwise_xor(x, part, out=part)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        part = x >> np.uint64(27)
        x ^= part
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=part)
        return x


#: Odd base of the polynomial hashes, its inverse modulo 2**64, and a random value for each byte.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``: ``out[i]`` covers the bytes before ``i``."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        each = _BYTES.take(data)
        each *= up[: len(data)]
        np.cumsum(each, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hashes."""
    _, down = _power_tables(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all spans of ``width`` bytes, in order of their places."""
    _, down = _power_tables(len(sums))
    with np.errstate(over="ignore"):
        h = sums[width:] - sums[:-width]
        h *= down[: len(h)]
        h += np.uint64(width)
        return mix(h)
