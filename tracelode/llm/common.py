"""Helpers shared by the operators on training text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Temporary arrays in a task are made for about this many bytes of text at a time.
PIECE_BYTES = 1 << 20
#: Of a batch of rows, about this many bytes of text become Python objects at a time.
SLICE_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; a null text is empty, a lone surrogate keeps its three bytes."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, newline, vertical tab, form feed and return.

    Those six are what `bytes.split` takes as white space; wider characters never are.
    """
    return utf8(text).split()


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copying, into stretches of about `limit` bytes of their column `text`; rows
    can be of any length, so a batch of many rows has no bound of its own. Empty batches are left out."""
    for batch in batches:
        if "text" not in batch.schema.names:
            if batch.num_rows:
                yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def map_batches(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]],
    schema: pa.Schema,
    ddl: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """`mapInArrow` with state made once per task: `start()` gives the function for a stretch of rows
    with about `limit` bytes of text, which yields column dicts."""

    def run(batches):
        work = start()
        for batch in text_slices(batches, limit):
            for columns in work(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=schema)
        work = batch = columns = None
        give_back()

    return df.mapInArrow(run, ddl)


def keep_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows of `df` for which the function that `start()` makes in a task gives true; all columns stay."""

    def run(batches):
        good = start()
        for batch in text_slices(batches):
            yield batch.filter(pa.array(good(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of `texts` of about `limit` bytes, one text at least."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def word_pieces(texts: list[list[bytes]], limit: int = 200_000) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of about `limit` words."""
    at = n = 0
    for i, text in enumerate(texts):
        if n and n + len(text) > limit:
            yield at, i
            at, n = i, 0
        n += len(text)
    if at < len(texts):
        yield at, len(texts)


class Ids(dict):
    """Numbers for words in order of first sight; the task's state, emptied when `full`."""

    def __init__(self, limit: int = 600_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    @property
    def full(self) -> bool:
        return len(self) > self.limit

    def since(self, n: int) -> list[bytes]:
        """Words numbered from `n` on."""
        if n == len(self):
            return []
        import itertools

        return list(itertools.islice(self, n, None)) if n < len(self) // 2 else list(
            itertools.islice(reversed(self), len(self) - n)
        )[::-1]


_MIX = np.random.default_rng(20_240_229).integers(1, 2**63, size=(64, 256), dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word: the sum of a random number for each (place, byte) pair, places
    beyond 64 turned by their round, then mixed with the length."""
    if not words:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    buf = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(words), np.uint64)
    if len(buf):
        place = np.arange(len(buf)) - np.repeat(starts, sizes)
        term = _MIX[place & 63, buf]
        if sizes.max() > 64:
            far = place > 63
            term[far] = mix(term[far] + (place[far] >> 6).astype(np.uint64) * U64(0xA0761D6478BD642F))
        some = sizes > 0
        out[some] = np.add.reduceat(term, starts[some])
    return mix(out + sizes.astype(np.uint64))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def give_back() -> None:
    """Return freed memory to the system; a worker process outlives its task and would keep it beside the next ones."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the folder all executors share and read it back."""
    from tracelode.session import write_table

    return write_table(df, name)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `shared_table`."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
