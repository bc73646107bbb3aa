"""What several operators share: bounded slices of text, words, files in the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argweave.operators.lineage import run_folder

#: Bytes of text that a task works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the decimal text of `key`, modulo `n`; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def unused_prefix(df: DataFrame) -> str:
    """Underscores with which no column of `df` begins, for columns that a caller adds and takes away again."""
    prefix = "_"
    while any(name.startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix


def store(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back, so that a lost executor costs a read and no new run."""
    path = f"{run_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One text for each combination of keys, the one of lowest digest, so that repeated keys give the same on each run."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def within(sample: DataFrame, size: Column, limit: int) -> DataFrame:
    """The rows of a bounded `sample` (with doc_id), in order of the digest of doc_id, that fit in `limit` units of
    `size` together; one that would not fit is passed over whole. For fits alone: what the driver gets stays bounded."""
    kept = store(sample, "sample")
    keys = [n for n in kept.columns if n != "text"]
    rows = kept.select(*keys, F.coalesce(size, F.lit(0)).cast("long").alias("size")).orderBy(F.xxhash64("doc_id"), *keys).collect()  # a row per sampled text
    chosen, held = [], 0
    for row in rows:
        if held + row["size"] <= limit:
            held += row["size"]
            chosen.append(tuple(row)[:-1])
    return kept if len(chosen) == len(rows) else kept.join(sample.sparkSession.createDataFrame(chosen, kept.select(*keys).schema), keys)


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as one array with buffers of its own (some kernels read a slice's neighbours); NULL is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, "").take(pa.array(np.arange(len(column)))).cast(pa.large_string())


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold at most `limit` bytes together, or one longer text. No row is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for row, n in enumerate(size):
            if held and held + n > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += n
        yield batch.slice(start)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs of other than ASCII white space): the distinct ones, their numbers in text order, and the n + 1
    places where each text's words begin."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.values.dictionary_encode() if len(lists) else pa.array([], pa.large_string()).dictionary_encode()
    distinct, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if blank >= 0:  # white space at either end leaves an empty piece
        real = ids != blank
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        ids = ids[real]
    return distinct, ids, ends


def owners(ends: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of `values` between the places in `ends`."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends[1:]] - total[ends[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def in_turn(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each row of equally long columns; order matters."""
    key = mix(parts[0].astype(np.uint64))
    for part in parts[1:]:
        key = mix(key * np.uint64(3) + part.astype(np.uint64))
    return key


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    put = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = put[1:] == put[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def in_windows(ids: np.ndarray, ends: np.ndarray, n: int = 3) -> np.ndarray:
    """True for each word inside a window of `n` words that its text holds twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < n:
        return covered
    text = owners(ends)
    last = len(ids) - n + 1
    whole = text[:last] == text[n - 1 :]
    start = np.flatnonzero(whole)
    twice = start[repeated(in_turn([text[start], *(ids[start + k] for k in range(n))]))]
    for k in range(n):
        covered[twice + k] = True
    return covered


def crc32_of(key: object) -> int:
    return zlib.crc32(str(key).encode())


# Files of an index in the shared folder. Spark names it by URI; on a local or mounted file system tasks map the
# files in place, on any other they map a copy that is deleted right after it is opened.


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Write `data` under a name of its own and move it into place, so that a repeated task leaves one whole file."""
    path = _local(uri)
    if path is None:
        from pyarrow.fs import FileSystem

        system, path = FileSystem.from_uri(uri)
        with system.open_output_stream(path) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as out:
        out.write(data)
    os.replace(name, path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(uri)
    with system.open_input_stream(path) as source, tempfile.NamedTemporaryFile() as copy:
        shutil.copyfileobj(source, copy)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)

