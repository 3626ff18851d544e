"""What the operators share: the folder for written tables, word splitting, vectorised hashing, Arrow column access."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Row numbers of a bitmap, as a power of two: what Spark's bitmap_construct_agg holds.
BLOCK_BITS = 15
#: Rows of a table that one task groups and joins in many rounds; above, each round shuffles.
TOGETHER = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that `written` made and nothing will read again."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split("://")[-1].lstrip("/").removeprefix("file:") in folder:
            path.getFileSystem(conf).delete(path, True)


def together(df: DataFrame, rows: int) -> DataFrame:
    """df, which has `rows` rows, in one partition if these are few: what groups or joins it then needs no shuffle.

    A round over some thousand rows else is a task for each shuffle partition and step, most of them empty, and each leaves its
    share of garbage and metrics in the driver.
    """
    return df.coalesce(1) if rows <= TOGETHER else df


def released(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that its heap shrinks to what is used, and broadcasts and shuffles that nothing refers to go."""
    gc.collect()
    spark._jvm.System.gc()


def remainder_is(column: Column, modulus: int, value: int) -> Column:
    """crc32(column as text) mod modulus = value; false where the column is null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == value, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then split at the contracts' white space; bytes.lower() and bytes.split() do exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(a: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (shift, multiply, shift): every input bit reaches every output bit."""
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0x9E3779B97F4A7C15)
    a = a ^ (a >> np.uint64(29))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence that goes on with one more item."""
    return mix(left * np.uint64(0xA24BAED4963EE407) + right)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` items; shorter input gives one hash for the whole of it, empty input none."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    out = words[: len(words) - width + 1]
    for k in range(1, width):
        out = joined(out, words[k : len(words) - width + 1 + k])
    return mix(out + np.uint64(width))


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """One text at a time, so that no list of all of a batch's texts is held."""
    for x in column:
        yield x.as_py()


def by_position(docs: DataFrame) -> DataFrame:
    """docs with the names c0, c1, ...: the one step in which names that differ in letter case only can't be ambiguous."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place_of(docs: DataFrame, name: str) -> str:
    """The name in `by_position(docs)` of the first column of exactly this name."""
    if name not in docs.columns:
        raise ValueError(f"there is no column {name!r}; there are {docs.columns}")
    return f"c{docs.columns.index(name)}"


def picked(docs: DataFrame, **names: str) -> DataFrame:
    """picked(docs, new="old", ...): these columns, by exact name, under their new names. Other columns of any name don't matter."""
    return by_position(docs).select(*[F.col(place_of(docs, old)).alias(new) for new, old in names.items()])


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """All columns as c0, c1, ... and `row`, a number for each row, written once.

    A row number isn't the same when it is computed again (after a shuffle, by AQE, with fewer executors); read back it is.
    """
    return written(by_position(docs).withColumn("row", F.monotonically_increasing_id()), label)


def named_again(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of rows under the names that docs has."""
    return rows.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def staying(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows whose number is in stays (column row; with a column copy, once for each different copy). Rows aren't moved.

    The numbers of a block of 2 ** `BLOCK_BITS` are the bits of a bitmap, one for each copy, and these are broadcast: a bit or little
    more for each row, 2 MB for 15 million. A join by row would shuffle all texts.
    """
    size, block = 1 << BLOCK_BITS, F.shiftrightunsigned("row", BLOCK_BITS)
    keys = ["of", *(c for c in stays.columns if c == "copy")]
    bits = stays.withColumn("of", block).groupBy(*keys).agg(F.bitmap_construct_agg(F.col("row") % size).alias("bits")).select("of", "bits")
    byte = f"cast(conv(hex(substring(bits, cast(row % {size} div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.join(F.broadcast(bits), block == F.col("of")).filter(f"shiftright({byte}, cast(row % 8 as int)) % 2 = 1").drop("of", "bits")


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences, and counts, byte plane by byte plane."""
    planes = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(planes, 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel()


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, each once, with the sums of their counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first)
