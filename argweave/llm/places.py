"""Rows of a table told by where they stand: the file and the place in it, so that rows can be chosen or left out in the
pass that reads them and no text travels through a shuffle.

Chosen places are written as one sorted list for each 2^20 places of a file; a task maps the lists of the files that it
reads and of no others. Lists are as long as what is chosen in one file, never as long as the table's choice.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import _local, map_file, put_file, store, text_slices, texts_of
from argweave.operators.lineage import run_folder

PIECE_BITS = 20


def placed(docs: DataFrame, prefix: str) -> DataFrame:
    """`docs` with `<prefix>file`, a hash of the file that a row comes from, and `<prefix>row`, its number there. Rows
    that do not come straight from Parquet files are written to the shared folder first."""
    try:
        meta = docs.metadataColumn("_metadata")
        found = docs.select("*", F.xxhash64(meta["file_path"]).alias(f"{prefix}file"), meta["row_index"].alias(f"{prefix}row"))
        found.schema  # noqa: B018 - resolves the columns now
        return found
    except AnalysisException:
        docs = store(docs, "placed")
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(meta["file_path"]).alias(f"{prefix}file"), meta["row_index"].alias(f"{prefix}row"))


def _name(folder: str, file: int, piece: int) -> str:
    return f"{folder}/{int(file) & (2**64 - 1):016x}-{int(piece)}"


def write_places(places: DataFrame) -> str:
    """Write the places (file, row, and any further numbers as columns) in lists sorted by row; returns their folder."""
    spark = places.sparkSession
    folder = f"{run_folder(spark)}/places"
    names = ["file", "row", *(n for n in places.columns if n not in ("file", "row"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            table = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            unit = np.stack([table[:, 0], table[:, 1] >> PIECE_BITS], axis=1)
            cuts = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(table)), cuts):
                if not len(part):
                    continue
                own = tuple(unit[part[0]])
                if held and own != last:
                    put_file(_name(folder, *last), np.concatenate(held).astype("<i8").tobytes())
                    held = []
                last = own
                held.append(table[part, 1:])
        if held:
            put_file(_name(folder, *last), np.concatenate(held).astype("<i8").tobytes())
        return iter(())

    rows = places.select(*(F.col(n).cast("long") for n in names)).withColumn("piece", F.shiftright("row", PIECE_BITS))
    rows = rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "row").drop("piece")
    rows.mapInArrow(run, "file long").write.format("noop").mode("overwrite").save()
    return folder


def _listed(uri: str, width: int) -> np.ndarray:
    path = _local(uri)
    if path is not None:
        found = os.path.exists(path)
    else:
        from pyarrow.fs import FileSystem, FileType

        system, path = FileSystem.from_uri(uri)
        found = system.get_file_info(path).type == FileType.File
    return map_file(uri).view("<i8").reshape(-1, width) if found else np.zeros((0, width), "<i8")


def listed(folder: str, file: np.ndarray, row: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists in `folder` that belong to the given places: positions in `row`, and the entries'
    `width` numbers, the first of which is the row. A place may have several entries."""
    at, entries = [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
    piece = row >> PIECE_BITS
    for f in np.unique(file):
        for p in np.unique(piece[file == f]):
            own = np.flatnonzero((file == f) & (piece == p))
            table = _listed(_name(folder, f, p), width)
            rows = np.ascontiguousarray(table[:, 0])
            a, b = np.searchsorted(rows, row[own], "left"), np.searchsorted(rows, row[own], "right")
            n = b - a
            at.append(np.repeat(own, n))
            entries.append(table[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(at), np.concatenate(entries)


def filtered(docs: DataFrame, places: DataFrame, keep: bool, prefix: str = "_", text: str = "text") -> DataFrame:
    """The rows of `docs`, a result of `placed`, whose place is among `places` (file, row), or is not if `keep` is
    False. One pass over the rows; nothing but places is shuffled."""
    folder = write_places(places.select("file", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            own = np.zeros(part.num_rows, bool)
            own[listed(folder, part.column(f"{prefix}file").to_numpy(), part.column(f"{prefix}row").to_numpy())[0]] = True
            yield part.filter(pa.array(own if keep else ~own))

    return docs.mapInArrow(run, docs.schema)


def routed(docs: DataFrame, routes: DataFrame, values: Callable[[pa.Array], dict[str, pa.Array]], kinds: str, prefix: str = "_") -> DataFrame:
    """One row for each of the `routes` (file, row and further numbers) with those numbers and what `values` makes of the
    text at that place. `kinds` are the types of those values. Texts do not leave the pass that reads them."""
    numbers = [n for n in routes.columns if n not in ("file", "row")]
    folder = write_places(routes.select("file", "row", *numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            at, entries = listed(folder, part.column(f"{prefix}file").to_numpy(), part.column(f"{prefix}row").to_numpy(), len(numbers) + 1)
            if not len(at):
                continue
            rows, back = np.unique(at, return_inverse=True)
            made = values(texts_of(part.column("text").take(pa.array(rows))))
            columns = {n: pa.array(np.ascontiguousarray(entries[:, k + 1])) for k, n in enumerate(numbers)}
            columns |= {n: v.take(pa.array(back)) for n, v in made.items()}
            yield pa.RecordBatch.from_pydict(columns)

    columns = "".join(f"{n} long, " for n in numbers)
    return docs.select(f"{prefix}file", f"{prefix}row", "text").mapInArrow(run, columns + kinds)
