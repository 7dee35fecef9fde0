"""Helpers shared by the corpus operators: input columns, block slicing, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.sources.tables import table

#: Bytes of text that one numpy block holds; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only these columns go on, so extra columns of
    any name cannot clash. A null text counts as empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(id_col: str, m: int):
    """crc32(id as text) mod m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole texts of about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets_of(batch.column(batch.schema.get_field_index(text_col)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _layout(arr: pa.Array):
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    return (np.int64, 8) if wide else (np.int32, 4)


def offsets_of(arr: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a null-free string array into its value buffer."""
    kind, width = _layout(arr)
    return np.frombuffer(arr.buffers()[1], kind, len(arr) + 1, arr.offset * width).astype(np.int64)


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the concatenated UTF-8 bytes of a null-free string array
    and the n + 1 starts of its texts in them."""
    off = offsets_of(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
               + np.uint64(seed)) | np.uint64(1)


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n - 1) mod 2**64 (or of its inverse), kept per worker."""
    base = _BASE_INV if inverse else _BASE
    have = _POWERS.get(int(inverse))
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 64)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(inverse)] = have
    return have[:n]


class RollingHash:
    """Substring hashes of a byte block from prefix sums of byte values times
    powers of an odd base modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])

    def raw(self, start, end) -> np.ndarray:
        """Hash of [start, end): position-free, not yet finalised."""
        n = len(self.sums)
        return (self.sums[end] - self.sums[start]) * powers(n, inverse=True)[start]


def write_read(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it
    back: the lineage is cut and the rows survive lost executors."""
    from trellis.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
