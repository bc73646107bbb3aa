"""N-gram Jaccard join: MinHash bands find candidates, full sets of word five-grams decide.

Texts with the same set of shingles are one class, told by a 128-bit digest of the sorted set, so copies never meet in
pairs. Each class has `BANDS` band keys of `ROWS` minima each; the two numbers are chosen by `banding` for a recall of
`RECALL` at the similarity that is asked for. Classes that share a band key are candidates, and a pair counts in the
first band that it shares only, so it is verified once and no pair is ever written.

1. One pass over the texts: (doc_id, place, digest, band keys), stored. 2. One row per digest. 3. Band keys with two classes or
more. A bucket of over `BLOCK` classes is dealt into blocks by digest, and each pair of blocks is a unit of work, so a
unit stays small however large the bucket. 4. From the band keys alone, each unit tells which of its classes have a
pair to be verified there. 5. Only for these classes one text each is read again, where it stands, for the full sets of
64-bit shingle hashes; no text is ever shuffled. 6. Each unit verifies its pairs and gives, per class, the documents linked, and a spanning forest of its links.
7. Groups are the connected components of all forests, found by rounds of stars over stored edge tables.

Words are runs of other than ASCII white space, taken as they are. A text of one to four words is one shingle. NULL texts
and texts without words have no shingles: they link to nothing and are groups of their own. Repeated rows, and several
texts under one doc_id, are copies or near-copies like any others. Empty tables give no rows; other columns, whatever they
are called, take no part and stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import in_turn, store, sums, text_slices, texts_of, unused_prefix, words_of
from argweave.llm.places import filtered, placed, routed

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
BLOCK = 512


def banding(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """The most selective (bands, rows) with at most `most` minima that finds a pair at `similarity` with chance `recall`."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("More minima are needed for this recall.")


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, and the places where each text's begin."""
    distinct, ids, ends = words_of(texts)
    names = np.fromiter((xxhash.xxh64_intdigest(x) for x in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))
    words = names[ids]
    count = np.diff(ends)
    several = np.where(count >= n, count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), several)
    at = np.repeat(ends[:-1], several) + np.arange(len(text)) - np.repeat(np.cumsum(several) - several, several)
    keys = in_turn([words[at + k] for k in range(n)]) if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < n))
    alone = [xxhash.xxh64_intdigest(words[ends[k] : ends[k + 1]].tobytes()) for k in few]
    text, keys = np.concatenate([text, few]), np.concatenate([keys, np.array(alone, np.uint64)])
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    text, keys = text[fresh], keys[fresh]
    return keys, np.searchsorted(text, np.arange(len(count) + 1))


def digests(keys: np.ndarray, places: np.ndarray) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(keys[a:b].tobytes()) if b > a else None for a, b in zip(places[:-1], places[1:], strict=True)]


def band_keys(keys: np.ndarray, places: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 32-bit key for each band of each text that has shingles."""
    chance = np.random.default_rng(20240607)
    factors = chance.integers(1, 2**64, (bands * rows, 2), np.uint64) | np.uint64(1)
    starts = places[:-1][np.diff(places) > 0]
    out = np.zeros((len(starts), bands), np.uint32)
    if not len(starts):
        return out
    for band in range(bands):
        minima = []
        for k in range(band * rows, (band + 1) * rows):
            minima.append(np.minimum.reduceat(((keys * factors[k, 0] + factors[k, 1]) >> np.uint64(32)).astype(np.uint32), starts))
        out[:, band] = (in_turn(minima) >> np.uint64(32)).astype(np.uint32)
    return out


def signed(docs: DataFrame, bands: int, rows: int, p: str) -> DataFrame:
    """(doc_id, file, row, digest, keys) of `placed` documents; digest and keys are NULL for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            keys, places = shingles(texts_of(part.column("text")))
            found = iter(band_keys(keys, places, bands, rows).view(np.int32))
            digest = digests(keys, places)
            own = [next(found) if d is not None else None for d in digest]
            columns = [*(part.column(c) for c in ("doc_id", f"{p}file", f"{p}row")), pa.array(digest, pa.binary()), pa.array(own, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "row", "digest", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", f"{p}file", f"{p}row", "text").mapInArrow(run, f"doc_id {kind}, file long, row long, digest binary, keys array<int>")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each unit (band, key, p, q), of a partition that is sorted by unit."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("band", "key", "p", "q")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            unit = tuple(int(c[a]) for c in code)
            if held and unit != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = unit
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _partners(band: int, keys: np.ndarray, block: np.ndarray, p: int, q: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each class, the later classes of its unit that it meets in `band` first; across blocks if there are two."""
    for k in range(len(keys) - 1):
        met = ~(keys[k + 1 :, :band] == keys[k, :band]).any(axis=1)
        if p != q:
            met &= block[k + 1 :] != block[k]
        if met.any():
            yield k, k + 1 + np.flatnonzero(met)


def _keys_of(rows: pa.Table) -> np.ndarray:
    return rows.column("keys").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def units(classes: DataFrame) -> DataFrame:
    """(band, key, p, q, id, block, keys): every class in every unit where it has company."""
    in_bands = classes.select("id", F.posexplode("keys").alias("band", "key"))
    crowd = store(in_bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "crowd")
    met = in_bands.join(crowd, ["band", "key"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = store(met.select("id", "band", "key", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "met")
    met = met.join(classes.select("id", "keys"), "id")
    dealt = met.select("band", "key", "id", "keys", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("band", "key", F.least("block", "other").cast("int").alias("p"), F.greatest("block", "other").cast("int").alias("q"), "id", "block", "keys")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q")


def needed(met: DataFrame) -> DataFrame:
    """(band, key, p, q, id, block, keys) of the classes with a pair to be verified in that unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, p, q), rows in _by_unit(batches):
            keep = np.zeros(rows.num_rows, bool)
            for k, others in _partners(band, _keys_of(rows), rows.column("block").to_numpy(), p, q):
                keep[k] = True
                keep[others] = True
            yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return _dealt(met).mapInArrow(run, met.schema)


def _verify(sets: list[np.ndarray], pairs: Iterator[tuple[int, np.ndarray]], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each class the partners at or above the similarity: |A n B| >= s (|A| + |B|) / (1 + s)."""
    size = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(size)))
    own = np.zeros(len(values), bool)
    for k, others in pairs:
        others = others[np.minimum(size[others], size[k]) >= similarity * np.maximum(size[others], size[k]) - 1e-9]
        if not len(others):
            continue
        mine = code[ends[k] : ends[k + 1]]
        own[mine] = True
        if len(others) < 8:
            shared = np.array([np.count_nonzero(own[code[ends[j] : ends[j + 1]]]) for j in others])
        else:
            shared = sums(own[code], ends)[others]
        own[mine] = False
        good = shared >= similarity * (size[others] + size[k] - shared) - 1e-9
        if good.any():
            yield k, others[good]


def verified(ready: DataFrame, similarity: float) -> DataFrame:
    """(id, other, links, classes): for each class of a unit its linked documents and classes there, and one
    class that it hangs on in the unit's forest (NULL at a root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, p, q), rows in _by_unit(batches):
            sets = [np.frombuffer(b, "<u8") for b in rows.column("shingles").to_pylist()]
            members = rows.column("members").to_numpy()
            root = np.arange(len(sets))
            links, classes = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for k, others in _verify(sets, _partners(band, _keys_of(rows), rows.column("block").to_numpy(), p, q), similarity):
                links[k] += members[others].sum()
                classes[k] += len(others)
                links[others] += members[k]
                classes[others] += 1
                joined = np.unique(root[np.append(others, k)])
                root[np.isin(root, joined)] = joined[0]
            hit = np.flatnonzero(classes)
            if len(hit):
                ids = rows.column("id").to_numpy()
                other = pa.array(ids[root[hit]], mask=root[hit] == hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), other, pa.array(links[hit]), pa.array(classes[hit])], names=["id", "other", "links", "classes"])

    return _dealt(ready).mapInArrow(run, "id long, other long, links long, classes long")


def components(edges: DataFrame) -> DataFrame:
    """(id, head): for each end of an edge (a, b) the least id of its component. Each round links every node's
    larger neighbours to its least one, then every node's neighbours to the least of all, until nothing changes; edge
    tables are stored, their number of rows never grows, and rounds go with the logarithm of the longest path."""
    edges = store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).alias("mark")
    before = edges.select(mark).head()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store(large.where("a != b").distinct(), "large")
        floor = store(large.groupBy("a").agg(F.min("b").alias("m")), "floor")
        small = large.join(floor, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = store(small.where("a != b").distinct(), "edges")
        after = edges.select(mark).head()
        if after == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("head"))
        before = after


def linked(docs: DataFrame, p: str, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Of documents that `placed` has given places with the prefix `p`: stored rows (doc_id, file, row, digest, keys), and
    (digest, head, members, least_id, links, classes) of every class that has copies or links: `head` names its group,
    `links` counts the linked documents of other classes, `classes` those classes."""
    bands, rows = banding(similarity, recall)
    sign = store(signed(docs, bands, rows, p), "signed")
    first = F.min(F.struct("file", "row")).alias("first")
    classes = sign.where("digest is not null").groupBy("digest").agg(F.count("*").alias("members"), F.first("keys").alias("keys"), F.min("doc_id").alias("least_id"), first)
    classes = store(classes.select("digest", "members", "keys", "least_id", "first.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    want = store(needed(units(classes.select("id", "keys"))), "needed")
    who = want.select("id").distinct().join(classes.select("id", "members", "file", "row"), "id")

    def sets(texts: pa.Array) -> dict[str, pa.Array]:
        keys, places = shingles(texts)
        return {"shingles": pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(places[:-1], places[1:], strict=True)], pa.binary())}

    known = store(routed(docs, who, sets, "shingles binary", p), "sets")
    found = store(verified(want.join(known, "id"), similarity), "found")
    head = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    out = classes.select("id", "digest", "members", "least_id").join(counts, "id", "left").join(head, "id", "left")
    out = out.where("members > 1 or classes > 0")
    zero = F.lit(0).cast("long")
    out = out.select(
        "digest", F.coalesce("head", "id").alias("head"), "members", "least_id", F.coalesce("links", zero).alias("links"), F.coalesce("classes", zero).alias("classes")
    )
    return sign, store(out, "groups")


def _apart(digest: str) -> Column:
    """A join key that no digest equals where there is none, and that spreads such rows."""
    return F.coalesce(F.col(digest), F.xxhash64("doc_id").cast("string").cast("binary"))


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its group), links (other documents at or above the
    similarity, copies included) and linked_texts (the classes of other texts among them)."""
    docs = docs.select("doc_id", "text")
    p = unused_prefix(docs)
    sign, found = linked(placed(docs, p), p, similarity, recall)
    least = found.groupBy("head").agg(F.min("least_id").alias("class_id"))
    links = (F.col("members") - 1 + F.col("links")).alias("links")
    found = store(found.join(store(least, "least"), "head").select(F.col("digest").alias("k"), "class_id", links, F.col("classes").alias("linked_texts")), "links")
    zero = F.lit(0).cast("long")
    rows = sign.select("doc_id", _apart("digest").alias("k")).join(found, "k", "left")
    return rows.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", zero).alias("links"), F.coalesce("linked_texts", zero).alias("linked_texts")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`docs` with one row of each group: that of the least doc_id (NULL last), of its several texts the least digest, and
    of equal rows the first place. The rows that go are told by their places in the pass that reads the documents."""
    p = unused_prefix(docs)
    rows = placed(docs, p)
    sign, found = linked(rows, p, similarity, recall)
    rank = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "digest")
    best = found.groupBy("head").agg(F.min(rank).alias("best")).select("head", F.col("best.least_id").alias("best_id"), F.col("best.digest").alias("best_digest"))
    found = found.select("digest", "head").join(store(best, "best"), "head").select("digest", "best_id", (F.col("digest") == F.col("best_digest")).alias("best"))
    grouped = store(sign.select("doc_id", "file", "row", "digest").join(store(found, "decided"), "digest"), "grouped")
    stays = grouped.where(F.col("best") & F.col("doc_id").eqNullSafe(F.col("best_id"))).groupBy("digest").agg(F.min(F.struct("file", "row")).alias("first"))
    goes = grouped.select("file", "row").join(stays.select("first.*"), ["file", "row"], "left_anti")
    return filtered(rows, goes, False, p).select(*docs.columns)
