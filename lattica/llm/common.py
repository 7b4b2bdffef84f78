"""Shared pieces: the session's shared folder, staged tables, word hashing over Arrow buffers, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: 64-bit odd multipliers of the word and shingle hashes (fixed values).
P_BYTE = 0x9E3779B97F4A7C15
P_MIX1 = 0xBF58476D1CE4E5B9
P_MIX2 = 0x94D049BB133111EB
P_SEQ = 0xD6E8FEB86659FD93
#: Bytes hashed in one numpy step; keeps temporaries near 50 MB whatever the batch.
CHUNK = 1 << 20
#: Bytes up to which words are hashed in numpy steps of eight.
LONG = 64
#: The lowest 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

_tables: dict[str, np.ndarray] = {}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
    return f"{found.rstrip('/')}/lattica-{app}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _uri(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under a name of its own and renames it, so that repeated tasks do no harm."""
    fs, path = _uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).data if array.size else b"")
    fs.move(own, f"{path}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """A read-only memory map of a saved array."""
    fs, path = _uri(folder)
    size = fs.get_file_info(f"{path}/{name}").size
    if not size:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with tempfile.NamedTemporaryFile(prefix="lattica-map-") as local, fs.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 24):
            local.write(block)
        local.flush()
        return np.memmap(local.name, dtype, "r")  # the mapping outlives the name


def lean(run):
    """run(batches) that gives free memory back to the system at its end: workers stay for later tasks, beside other workers."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id, buckets: int, remainder: int):
    """crc32(doc_id as text) mod buckets = remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % buckets == remainder


def hash_fraction(*cols):
    """A uniform number in [0, 1) from a hash of cols, the same on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(P_MIX1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(P_MIX2)
    h ^= h >> np.uint64(31)
    return h


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    if "lower" not in _tables:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _tables["lower"], _tables["space"] = lower, space
    return _tables["lower"], _tables["space"]


def _long_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=len(word))


def hash_words(data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z lower-cased if fold: (64-bit hashes, start of each word).

    A word is taken eight bytes at a time, each mixed into the last one's hash; words of more than LONG bytes are hashed
    by XXH3. Neither is linear in the bytes, so words built from each other by patterns stay apart.
    """
    lower, space = _byte_tables()
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # cut where white space is, else take the whole long word
            blank = np.flatnonzero(space[data[at:end]])
            while not len(blank) and end < n:
                more = min(n, end + CHUNK)
                blank = np.flatnonzero(space[data[end:more]]) + (end - at)
                end = more
            if len(blank):
                end = at + int(blank[-1]) + 1
        part = data[at:end]
        word = np.zeros(len(part) + 2, dtype=np.int8)
        word[1:-1] = ~space[part]
        edge = np.diff(word)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            low = np.zeros(len(part) + 8, np.uint8)
            low[: len(part)] = lower[part] if fold else part
            eight = np.ndarray((len(part) + 1,), "<u8", low.data, strides=(1,))
            size = last - first
            h = mix(size.astype(np.uint64) * np.uint64(P_BYTE))
            some, done = np.flatnonzero(size <= LONG), 0
            while len(some):
                left = np.minimum(size[some] - done, 8)
                h[some] = mix((h[some] ^ (eight[first[some] + done] & _MASKS[left])) + np.uint64(P_SEQ))
                done += 8
                some = some[size[some] > done]
            for i in np.flatnonzero(size > LONG).tolist():
                h[i] = _long_word(low[first[i] : last[i]].tobytes())
            hashes.append(h)
            starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1) of a binary or string Arrow column, without copying; nulls are empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, most: int = 4 * CHUNK):
    """Splits a column into runs of rows of at most `most` bytes (one row at least): yields (first row, bytes, offsets)."""
    data, off = buffers(col)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def joined(data: np.ndarray, off: np.ndarray, byte: int) -> np.ndarray:
    """The texts at off, with one byte after each."""
    return np.insert(data, off[1:], byte)


def doc_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts at off, each text on its own: (hashes, offsets of n+1 into them)."""
    n = len(off) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    h, first = hash_words(joined(data, off, 32))
    return h, np.searchsorted(first, off + np.arange(n + 1)).astype(np.int64)


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (u, v): returns (node, component), component the smallest node reachable.

    Alternating large-star and small-star; each round is one staged table. A node with very many
    neighbours is pre-aggregated by min() and meets its neighbours in a join that AQE can split.
    Nodes without edges, and loops, give no row. Rounds are logarithmic in the longest path.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = stage(big, name)
        low = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        met = big.join(low, F.col("u") == F.col("x"))
        e = stage(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), name)
