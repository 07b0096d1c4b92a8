"""What the operators share: the shared folder, and vectorised views of Arrow text.

Workers never see Python strings where bytes will do: an Arrow string column is one
buffer plus offsets, so words, hashes and windows are found with numpy over the buffer.
"""

from __future__ import annotations

import contextlib
import gc
import io
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a worker: what a core's caches hold with the temporaries, which take
#: 8 to 40 times this.
SLICE_BYTES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own only where none is set and all
    runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as Parquet in the shared folder, read again. A lost executor
    costs the tasks that it ran, never what was written before."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    released(spark)
    return spark.read.schema(df.schema).parquet(at)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more, which else
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What reaches a worker at once, where the session has not set it. Long texts would make
#: batches of Spark's standard 10,000 rows too large.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def in_arrow(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow over batches of bounded size; for DataFrame.transform."""
    key, standard, ours = ARROW_BYTES
    if df.sparkSession.conf.get(key, standard) == standard:
        df.sparkSession.conf.set(key, ours)
    return df.mapInArrow(work, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Steps of a plan that pass on the rows of a file, or some of them, each once.
BY_ROW = {"Project", "Filter", "ColumnarToRow", "FileScan"}
SLASHES = "^([^/]*:)?/+"


def _rows_of_files(df: DataFrame) -> bool:
    """Whether df's rows are those of Parquet files, at most picked among: then a row's file and
    its place there name it. Told from the plan that explain() shows; what isn't understood says
    no."""
    if "_metadata" in df.columns:
        return False
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        df.explain()
    steps = [re.sub(r"^[\s:+-]*(\*\(\d+\) )?", "", x) for x in shown.getvalue().splitlines()[1:] if x.strip()]
    return bool(steps) and all(x.split(" ")[0] in BY_ROW for x in steps) and steps[-1].startswith("FileScan parquet")


def with_uid(df: DataFrame, *cols: str | Column) -> DataFrame:
    """The named columns and uid, which tells equal rows apart and is a row's own whenever it is
    read: how a table is split hangs on the cores alive, so no count of rows or parts does for
    that. Rows of Parquet files have their file's number (by name) and their place in it; any
    other frame is written once with numbers. The files' names are as many as the driver lists
    anyway."""
    if not _rows_of_files(df):
        return written(df.select(F.monotonically_increasing_id().alias("uid"), *cols), "numbered")
    # file:/ and file:/// are one
    paths = sorted({re.sub(SLASHES, r"\1/", p) for p in df.inputFiles()})
    place = F.col("_metadata.row_index")
    if len(paths) == 1:
        return df.select(place.alias("uid"), *cols)
    numbers = df.sparkSession.createDataFrame(list(enumerate(paths)), "number long, path string")
    rows = df.select(F.struct(*cols).alias("cols"), F.regexp_replace("_metadata.file_path", SLASHES, "$1/").alias("path"), place.alias("place"))
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("a file that was not listed: "), "path")).cast("long"))
    return rows.join(F.broadcast(numbers), "path", "left").select((F.shiftleft(number, 40) + F.col("place")).alias("uid"), "cols.*")


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and n + 1 offsets. Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most so many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def separators(pattern: bytes) -> np.ndarray:
    """A table of 256 flags from the bytes that part words."""
    lut = np.zeros(256, bool)
    lut[list(pattern)] = True
    return lut


WHITE = separators(b" \t\n\x0b\x0c\r")
#: Everything below 0x80 but 0-9 and a-z, for text whose A-Z are lowered.
NOT_ALNUM = separators(bytes(i for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and each row's range of them (n + 1 offsets).
    No word crosses a row's end."""
    inside = ~lut[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_RANDOM = np.random.default_rng(20240229)
BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(which: str, n: int) -> np.ndarray:
    """BASE (or its inverse) to the power of 0 ... n - 1, modulo 2 ** 64."""
    if len(_powers[which]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), BASE if which == "up" else UNBASE, np.uint64)
        step[0] = 1
        _powers[which] = np.multiply.accumulate(step)
    return _powers[which][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def long_hash(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs without nulls."""
    out: np.ndarray | np.uint64 = np.uint64(42)
    for x in columns:
        x = x * _XX[1]
        h = (out + _XX[4] + np.uint64(8)) ^ (x << np.uint64(31) | x >> np.uint64(33)) * _XX[0]
        h = (h << np.uint64(27) | h >> np.uint64(37)) * _XX[0] + _XX[3]
        h = (h ^ h >> np.uint64(33)) * _XX[1]
        h = (h ^ h >> np.uint64(29)) * _XX[2]
        out = h ^ h >> np.uint64(32)
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of the bytes' codes times powers of BASE."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers("up", len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers("down", len(sums))[starts])


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + h[i : i + n]
    return mixed(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its count, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(counts)
    keep = counts > 0
    s, c, e = starts[keep], counts[keep], ends[keep]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
