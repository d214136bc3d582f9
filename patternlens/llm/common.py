"""What the training-data operators share: written tables, text buffers, hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship

#: Bytes of a word separator: blank and \t \n \v \f \r; everything else belongs to words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: Text that a Python worker looks at in one go.
SLICE_BYTES = 1 << 19

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local-mode session without that setting gets a folder of its own; elsewhere a
    missing setting is an error, as a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="patternlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/patternlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Removes a table of :func:`stash` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written to the shared folder; frames that read them are of no use then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/patternlens/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver's garbage is collected, which a driver with little to do puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back(spark)


def give_back(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM has freed outside its heap back to the system; False where the JVM cannot.

    Plans, compilers and hundreds of threads leave it in the allocator's pools, which keep it otherwise.
    """
    jvm = spark.sparkContext._jvm
    try:
        # by reflection on the interface, as the server's own class is not open to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> Iterator[None]:
    """While it is open, jobs read and hand Python workers batches of at most so many rows or bytes.

    For jobs that run inside it, not for frames it returns: Spark reads the settings as it plans.
    """
    ship(spark)
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(min(rows, 4096))}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross rows. Offsets start at 0."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


#: Powers that a worker keeps; longer texts have theirs computed when they come.
KEPT_POWERS = 1 << 21
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        if size <= KEPT_POWERS:
            _POWERS.clear()
        up, down = np.empty(size, _U), np.empty(size, _U)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up[0] = down[0] = 1
            done = 1
            while done < size:
                up[done : 2 * done] = up[:done] * _U(pow(_BASE, done, 1 << 64))
                down[done : 2 * done] = down[:done] * _U(pow(inverse, done, 1 << 64))
                done *= 2
        if size > KEPT_POWERS:
            return up, down
        _POWERS[size] = up, down
    return _POWERS[size]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, alike wherever the same bytes stand."""
    if len(start) == 0:
        return np.zeros(0, _U)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, _U)
        sums[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(_BASE))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
