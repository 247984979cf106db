"""What several operators share: the shared folder, and text as byte arrays inside tasks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 18


#: Bytes of a batch that goes to a Python worker, where the session has Spark's own default of 64 MB.
BATCH_BYTES = 8 << 20


def light_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session from now on, unless it has set a size itself.

    What a task makes of a batch of texts is several times its size, and an executor runs
    several tasks; small batches cost next to nothing.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/accessmine/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_ids(docs: DataFrame) -> bool:
    """Has every row a doc_id, and one of its own? Only the ids are read and shuffled."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").isEmpty()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs, stored with a number for each row (the numbers hold, as they are read back)."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def steps(bounds: np.ndarray, most: int = STEP_BYTES):
    """Ranges of rows with at most so many bytes together, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---- hashes of words, by prefix sums: the cost is a few numpy passes over the bytes ----
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[begin:end] for many spans."""
    up, down = _power(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def words_of(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE, folded: np.ndarray = _LOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the first word of each text (with the end).

    Words are stretches of bytes that ``between`` doesn't mark; ``folded`` has each byte's lower case.
    """
    space = between[data]
    inside = ~space
    before = np.concatenate([[True], space[:-1]])
    after = np.concatenate([space[1:], [True]])
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    before[cut] = True
    after[cut - 1] = True
    begin, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return span_hashes(_BYTES[folded[data]], begin, end), np.searchsorted(begin, bounds)


def shingle_sets(texts: pa.Array, size: int):
    """For each text the distinct shingles of so many words, as sorted 64-bit hashes.

    A text with fewer words has one shingle, of all of them; one without words has none.
    """
    data, bounds = utf8(texts)
    for i, j in steps(bounds):
        own = bounds[i : j + 1] - bounds[i]
        words, first = words_of(data[bounds[i] : bounds[j]], own)
        with np.errstate(over="ignore"):
            runs = words.copy()
            for k in range(1, size):
                runs = runs[:-1] if len(runs) else runs
                runs = mixed(runs * np.uint64(0xD6E8FEB86659FD93) + words[k:][: len(runs)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                whole = words[a : a + 1].copy()
                for k in range(a + 1, b):
                    whole = mixed(whole * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1])
                yield mixed(whole + np.uint64(b - a))
            else:
                yield words[:0]


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrow lists of longs from arrays of unsigned or signed 64-bit values."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
