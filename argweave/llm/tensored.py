"""MinHash near-duplicates by tensored banding: full sets of word four-grams decide.

Two collections of `groups` groups of `rows` minima each are computed, 2 * groups * rows in all. `tensoring` chooses the
numbers such that two texts agree in a group of either collection with the chance of a recall; with similarity s that is
(1 - (1 - s^rows)^groups)^2. Each pair of any two groups, also of one collection, is the key of a table of 2 * rows minima, so
two texts share a table as soon as they agree in any two groups. At a similarity of 0.8 they fail to in 3 of a million cases,
where pairs across the collections alone would fail in 750: a component needs all the links that hold it together, so with a
recall of 0.999 for each a chain of a thousand texts would mostly be broken.

Texts with the same set are one class, told by a 128-bit digest. 1. One pass over the texts: set size, digest, group keys,
minima. 2. Group keys that two classes share; only groups that are left are paired to table keys, as a shared table is
two shared groups. 3. In each table bucket every class is held against the bucket's least class only: near copies by the
thousand are linked in a linear number of comparisons. 4. Only buckets that still hold two components go on. There classes
of different components meet in pairs, each pair in the first table that it shares; a large bucket is dealt into blocks,
and each pair of blocks is a unit of work. 5. In 3 and 4 a pair whose minima agree in less than `AGREE` of all places is
passed over (at the least similarity that is a chance of 3 in a million); all others are confirmed on full
sets of 64-bit hashes, which are made from the texts again where classes are needed. 6. Connected components.

Only A-Z are lowered. Words are runs of other than ASCII white space; a text of one to three words is one shingle. NULL
texts and texts without words have no shingles and are components of their own. Every row is a document, also if its doc_id
occurs again; a NULL doc_id is never the least of a component that has others. Empty tables give no rows; other columns
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import in_turn, store, text_slices, texts_of, unused_prefix
from argweave.llm.jaccard import components, digests, shingles
from argweave.llm.places import placed, routed

WORDS, PERCENT, RECALL, AGREE = 4, 80, 0.999, 0.55
BLOCK = 512


def tensoring(similarity: float, recall: float, most: int = 72) -> tuple[int, int]:
    """The most selective (groups, rows) of two collections with at most `most` minima for this recall at `similarity`."""
    for rows in range(8, 0, -1):
        groups = math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - similarity**rows))
        if 2 * groups * rows <= most:
            return groups, rows
    raise ValueError("More minima are needed for this recall.")


def sets_of(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return shingles(pc.ascii_lower(texts), words)


def minima(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The `n` 32-bit minima of each text that has shingles."""
    factors = np.random.default_rng(20250213).integers(1, 2**64, (n, 2), np.uint64) | np.uint64(1)
    starts = places[:-1][np.diff(places) > 0]
    out = np.zeros((len(starts), n), np.uint32)
    for k in range(n if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(((keys * factors[k, 0] + factors[k, 1]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def group_keys(signs: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """A 64-bit key of each group of the first collection, then of the second."""
    parts = signs.reshape(len(signs), 2 * groups, rows)
    return np.stack([in_turn([np.full(len(signs), g, np.uint64), *(parts[:, g, k] for k in range(rows))]) for g in range(2 * groups)], axis=1)


def _spread(values: list, places: np.ndarray) -> list:
    """The values of texts that have shingles, and None for the others."""
    found = iter(values)
    return [next(found) if n else None for n in np.diff(places)]


def signed(docs: DataFrame, groups: int, rows: int, p: str) -> DataFrame:
    """(doc_id, file, row, n, digest, keys, signs); the last three are NULL for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets, places = sets_of(texts_of(part.column("text")))
            signs = minima(sets, places, 2 * groups * rows)
            keys = group_keys(signs, groups, rows).view(np.int64)
            columns = [pa.array(np.diff(places)), pa.array(digests(sets, places), pa.binary())]
            columns += [pa.array(_spread(list(keys), places), pa.list_(pa.int64())), pa.array(_spread([s.tobytes() for s in signs], places), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", f"{p}file", f"{p}row")), *columns], names=["doc_id", "file", "row", "n", "digest", "keys", "signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, file long, row long, n long, digest binary, keys array<long>, signs binary"
    return docs.select("doc_id", f"{p}file", f"{p}row", "text").mapInArrow(run, kinds)


def buckets(classes: DataFrame, groups: int) -> DataFrame:
    """(id, place, key) of every class in every table bucket (key; `place` is the number of the table) with company."""
    single = classes.select("id", F.posexplode("keys").alias("g", "key"))
    shared = store(single.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "shared")
    left = single.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("g", "key")).alias("left"))
    pairs = left.select("id", "left", F.explode("left").alias("a")).select("id", "a", F.explode(F.filter("left", lambda x: x["g"] > F.col("a.g"))).alias("b"))
    tables = pairs.select("id", (F.col("a.g") * 2 * groups + F.col("b.g")).cast("int").alias("place"), F.xxhash64("a.key", "b.key").alias("key"))
    tables = store(tables, "tables")
    crowd = tables.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    return store(tables.join(store(crowd, "crowd"), "key"), "met")


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each unit of a partition that is sorted by the columns `names`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
        cuts = np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and tuple(code[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(code[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _signs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint32).reshape(rows.num_rows, -1)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _similar(sets: list[np.ndarray], k: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of `others` with 100 * shared >= percent * union."""
    good = []
    for j in others:
        a, b = (sets[k], sets[j]) if len(sets[k]) < len(sets[j]) else (sets[j], sets[k])
        if 100 * len(a) < percent * len(b):
            continue
        at = np.searchsorted(b, a)
        shared = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            good.append(j)
    return np.array(good, np.int64)


def _dealt(df: DataFrame, names: list[str]) -> DataFrame:
    return df.repartition(*names).sortWithinPartitions(*names)


def _values(groups: int, rows: int):
    def values(texts: pa.Array) -> dict[str, pa.Array]:
        sets, places = sets_of(texts)
        signs = _spread([s.tobytes() for s in minima(sets, places, 2 * groups * rows)], places)
        blobs = [sets[a:b].astype("<u8").tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
        return {"signs": pa.array(signs, pa.binary()), "sets": pa.array(blobs, pa.binary())}

    return values


STAR = ["head", "part"]


def _stars(met: DataFrame, classes: DataFrame, docs: DataFrame, groups: int, rows: int, p: str, percent: int) -> DataFrame:
    """(a, b): links between classes and the least class of a bucket that they are in."""
    spokes = store(met.where("id != head").select("head", "id").distinct(), "spokes")
    hubs = spokes.groupBy("head").agg(F.count("*").alias("size")).select("head", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    hubs = store(hubs, "hubs")
    dealt = spokes.join(hubs, "head").select("head", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id")
    dealt = dealt.unionByName(hubs.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("id")))
    known = classes.select("id", "file", "row", "signs")

    def near(rows_: pa.Table) -> tuple[int, np.ndarray]:
        ids, signs = _column(rows_, "id"), _signs(rows_)
        hub = int(np.flatnonzero(ids == _column(rows_, "head")[0])[0])
        alike = (signs == signs[hub]).mean(axis=1) >= AGREE
        alike[hub] = False
        return hub, np.flatnonzero(alike)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _grouped(batches, STAR):
            hub, others = near(unit)
            if len(others):
                yield from unit.select([*STAR, "id", "file", "row"]).take(pa.array([hub, *others])).combine_chunks().to_batches()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _grouped(batches, STAR):
            hub, others = near(unit)
            ids, sets = _column(unit, "id"), [np.frombuffer(b, "<u8") for b in unit.column("sets").to_pylist()]
            good = _similar(sets, hub, others, percent)
            if len(good):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), ids[hub])), pa.array(ids[good])], names=["a", "b"])

    routes = _dealt(dealt.join(known, "id").select(*STAR, "id", "file", "row", "signs"), STAR).mapInArrow(wanted, "head long, part int, id long, file long, row long")
    ready = routed(docs, store(routes, "routes"), _values(groups, rows), "signs binary, sets binary", p)
    return _dealt(ready, STAR).mapInArrow(confirmed, "a long, b long")


CROSS = ["key", "p", "q"]


def _crosses(met: DataFrame, classes: DataFrame, heads: DataFrame, docs: DataFrame, groups: int, rows: int, p: str, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each unit's links between classes of different components (id, head)."""
    met = met.select("id", "place", "key").join(heads, "id", "left").select("id", "place", "key", F.coalesce("head", "id").alias("comp"))
    met = store(met, "with_components")
    mixed = met.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    mixed = store(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
    open_ = met.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    units = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("block", "other").cast("int").alias("p"), F.greatest("block", "other").cast("int").alias("q"), "id", "place", "comp", "block")
    units = units.join(classes.select("id", "file", "row", "signs"), "id")

    def pairs(unit: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """For each class the later classes of other components that it shares no earlier table with."""
        signs, comp, block = _signs(unit), _column(unit, "comp"), _column(unit, "block")
        place = int(_column(unit, "place")[0])
        two = _column(unit, "p")[0] != _column(unit, "q")[0]
        parts = signs.reshape(len(signs), 2 * groups, rows)
        other = place % (2 * groups)
        for k in range(len(signs) - 1):
            rest = k + 1 + np.flatnonzero((comp[k + 1 :] != comp[k]) & ((block[k + 1 :] != block[k]) if two else True))
            if not len(rest):
                continue
            same = parts[rest] == parts[k]
            shared = same.all(axis=2)
            # The first table is that of the first two groups that are shared.
            met_before = shared[:, :other].sum(axis=1) > 1
            rest = rest[~met_before & (same.mean(axis=(1, 2)) >= AGREE)]
            if len(rest):
                yield k, rest

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _grouped(batches, CROSS):
            keep = np.zeros(unit.num_rows, bool)
            for k, others in pairs(unit):
                keep[k] = True
                keep[others] = True
            if keep.any():
                yield from unit.drop_columns(["signs"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _grouped(batches, CROSS):
            ids, sets = _column(unit, "id"), [np.frombuffer(b, "<u8") for b in unit.column("sets").to_pylist()]
            root = np.arange(len(ids))
            for k, others in pairs(unit):
                good = _similar(sets, k, others[root[others] != root[k]], percent)
                if len(good):
                    root[np.isin(root, root[np.append(good, k)])] = root[k]
            hit = np.flatnonzero(root != np.arange(len(ids)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]])], names=["a", "b"])

    kinds = "key long, p int, q int, id long, place int, comp long, block int, file long, row long"
    order = [*CROSS, "id", "place", "comp", "block", "file", "row", "signs"]
    routes = store(_dealt(units.select(*order), CROSS).mapInArrow(wanted, kinds), "routes")
    ready = routed(docs, routes, _values(groups, rows), "signs binary, sets binary", p)
    return _dealt(ready, CROSS).mapInArrow(confirmed, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) and kept, one row per row of `docs`."""
    groups, rows = tensoring(percent / 100, recall)
    docs = docs.select("doc_id", "text")
    p = unused_prefix(docs)
    docs = placed(docs, p)
    sign = store(signed(docs, groups, rows, p), "signed")
    first = F.min(F.struct("file", "row")).alias("first")
    classes = sign.where("digest is not null").groupBy("digest").agg(F.count("*").alias("members"), F.min("doc_id").alias("least_id"), first, F.first("keys").alias("keys"), F.first("signs").alias("signs"))
    classes = store(classes.select("digest", "members", "least_id", "first.*", "keys", "signs").withColumn("id", F.monotonically_increasing_id()), "classes")
    met = buckets(classes.select("id", "keys"), groups)
    stars = store(_stars(met, classes, docs, groups, rows, p, percent), "stars")
    heads = components(stars)
    crosses = _crosses(met, classes, heads, docs, groups, rows, p, percent)
    edges = heads.select(F.col("id").alias("a"), F.col("head").alias("b")).unionByName(crosses)
    heads = components(edges)
    known = store(classes.select("digest", "id", "members", "least_id").join(heads, "id", "left").withColumn("head", F.coalesce("head", "id")), "heads")
    least = store(known.groupBy("head").agg(F.min("least_id").alias("component_id"), F.sum("members").alias("all")).where(F.col("all") > 1), "least")
    linked = store(known.join(least, "head").select(F.col("digest").alias("k"), "component_id", F.lit(True).alias("linked")), "linked")
    # Rows without shingles are spread; a hash is no digest of theirs.
    key = F.coalesce("digest", F.xxhash64("file", "row").cast("string").cast("binary"))
    found = sign.select("doc_id", "n", key.alias("k")).join(linked, "k", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
