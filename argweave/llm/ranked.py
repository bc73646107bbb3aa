"""Ranked lexical search: the best documents for each item, found through range maxima over posting lists.

Documents are cut into shards. For the terms of the items a shard holds one posting list each, ordered by document, and
over each list a sparse table of range maxima: entry (j, p) names the posting of the highest impact among the 2^j from p
on, so the best posting of any range is the better of two entries. A search keeps intervals of documents with a bound: the
sum of every term's range maximum there. The intervals with the highest bounds are taken first, each is split at the
document that has the highest single impact in it, that document is scored in full, and its two sides get bounds of their
own. What cannot reach the k-th score found so far is dropped: a lower bound, or an equal one where no smaller doc_id is
left. Intervals are taken in growing batches, as one numpy call serves many.

1. Items are numbered and go in blocks; one task writes the terms of a block to the shared folder. 2. One pass over the
texts writes packed postings of those terms by slice, and counts. 3. Document frequencies give the weights, one file.
4. A pass over the packed postings searches shard by shard; what an item has found in a task so far carries on as the
least score wanted. 5. The best of all tasks per item, in two steps, so that no task gets all of an item's candidates.

Items and documents without terms, NULL texts among them, give no rows; empty tables give no rows. Each row of the items is
an item of its own, also if its id or text occurs again, and each row of the documents is a document. Equal scores go by
doc_id, NULL last. A term's weight and impact are as `weigh` and `impacts` say. Other columns take no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argweave.llm.common import map_file, owners, put_file, store, text_slices, texts_of, words_of
from argweave.operators.lineage import run_folder
from argweave.operators.skew import number_rows

K = 20
#: Items that are searched in one pass over the documents.
BLOCK = 4096
#: Postings that a shard gathers from consecutive slices; one slice may hold more.
SHARD = 1_000_000
#: Cells (intervals times terms) that a search works on at a time.
CELLS = 1 << 20
#: Parts of an item's candidates in the first of the last two steps.
SALT = 64


def _table() -> np.ndarray:
    """What each byte becomes: A-Z lower case, other letters and digits and all bytes beyond ASCII themselves, the rest a space."""
    out = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        out[byte] = ord(chr(byte).lower()) if chr(byte).isalnum() else 0x20
    return out


def plain(texts: pa.Array) -> pa.Array:
    """The texts with a space for every byte that is in no term, and A-Z in lower case."""
    _, offsets, data = texts.buffers()
    bytes_ = _table()[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(bytes_)])


def weigh(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """The length part m of each document: 75 + 25 n N div L."""
    if len(n) and 25 * int(n.max()) * count >= 2**63:
        return np.array([75 + 25 * int(x) * count // total for x in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * count // max(total, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


class Shard:
    """Posting lists of `terms` terms over documents 0..n-1 and their range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        order = np.argsort(term.astype(np.int64) * docs + doc, kind="stable")
        self.docs = docs
        self.term, self.doc, self.impact = term[order].astype(np.int64), doc[order].astype(np.int64), impact[order]
        self.key = self.term * docs + self.doc
        longest = int(np.bincount(self.term, minlength=1).max()) if len(self.term) else 0
        levels = [np.arange(len(self.term), dtype=np.int32)]
        while 2 ** len(levels) <= longest:
            low = levels[-1]
            high = low[np.minimum(np.arange(len(low)) + 2 ** (len(levels) - 1), len(low) - 1)]
            levels.append(np.where(self.impact[high] > self.impact[low], high, low))
        self.best = np.stack(levels)
        self.level = np.zeros(longest + 2, np.int64)
        for j in range(1, len(levels)):
            self.level[2**j :] = j

    def range_maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range of postings a..b-1 of one list its best posting (any if empty) and impact (0 if empty)."""
        full = b > a
        j = self.level[np.where(full, b - a, 1)]
        last = len(self.doc) - 1
        x = self.best[j, np.minimum(a, last)]
        y = self.best[j, np.clip(b - (1 << j), 0, last)]
        at = np.where(self.impact[y] > self.impact[x], y, x)
        return at, np.where(full, self.impact[at], 0)

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that are among the k best here with a score of at least `floor`; ties to the smaller document."""
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.doc) or not len(terms):
            return docs, scores
        base, times = terms.astype(np.int64)[None, :] * self.docs, repeats.astype(np.int64)[None, :]
        wide = max(1, CELLS // len(terms))
        for start in range(0, self.docs, wide):  # so that the intervals of one search stay within CELLS
            stop = min(start + wide, self.docs)
            lo, hi = np.array([start]), np.array([stop])
            a, b = (np.searchsorted(self.key, base + x[:, None]) for x in (lo, hi))
            bound, split = self._bounded(a, b, times)
            batch = 4
            while len(lo):
                least, tie = (scores[-1], docs[-1]) if len(docs) == k else (floor, self.docs)
                live = (bound > least) | ((bound == least) & (lo < tie) & (bound > 0))
                lo, hi, a, b, bound, split = (x[live] for x in (lo, hi, a, b, bound, split))
                if not len(lo):
                    break
                first = np.argpartition(-bound, batch - 1)[:batch] if len(bound) > batch else np.arange(len(bound))
                rest = np.ones(len(bound), bool)
                rest[first] = False
                d, from_, to = split[first], a[first], b[first]
                mid = np.searchsorted(self.key, base + d[:, None])
                hit = (mid < to) & (self.key[np.minimum(mid, len(self.key) - 1)] == base + d[:, None])
                got = (np.where(hit, self.impact[np.minimum(mid, len(self.key) - 1)], 0) * times).sum(1)
                docs, scores = np.append(docs, d), np.append(scores, got)
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                new_lo, new_hi = np.concatenate([lo[first], d + 1]), np.concatenate([d, hi[first]])
                new_a, new_b = np.concatenate([from_, mid + hit]), np.concatenate([mid, to])
                new_bound, new_split = self._bounded(new_a, new_b, times)
                lo, hi, a, b = (np.concatenate([x[rest], y]) for x, y in ((lo, new_lo), (hi, new_hi), (a, new_a), (b, new_b)))
                bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
                batch = min(2 * batch, max(4, wide))
        good = (scores >= floor) & (scores > 0)
        return docs[good], scores[good]

    def _bounded(self, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the bound, and the document with the highest impact."""
        at, most = self.range_maxima(a, b)
        most = most * times
        top = most.argmax(1)
        return most.sum(1), self.doc[at[np.arange(len(at)), top]]


def _packed(values: np.ndarray) -> bytes:
    """Numbers of at least 0 in the narrowest type, compressed."""
    most = int(values.max(initial=0))
    kind = np.min_scalar_type(most)
    return kind.char.encode() + len(values).to_bytes(8, "little") + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(chr(data[0])), int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], n * kind.itemsize, "zstd", asbytes=True), kind)


def _write_items(items: DataFrame, block: int, folder: str) -> None:
    """One file for a block: its distinct terms, and per item the numbers of its terms and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("number", pa.int64()), ("text", pa.string())]))
        distinct, ids, ends = words_of(plain(texts_of(rows.column("text"))))
        keys, repeats = np.unique(owners(ends) * max(len(distinct), 1) + ids, return_counts=True)
        item, term = keys // max(len(distinct), 1), keys % max(len(distinct), 1)
        value = (distinct.to_pylist(), rows.column("number").to_numpy(), np.searchsorted(item, np.arange(rows.num_rows + 1)), term, repeats)
        put_file(f"{folder}/items", pickle.dumps(value))
        return iter(())

    one = items.where(F.col("block") == block).select("number", F.col("text").cast("string").alias("text")).repartition(1)
    one.mapInArrow(run, "number long").write.format("noop").mode("overwrite").save()


def _posted(docs: DataFrame, folder: str) -> DataFrame:
    """Per slice of the documents: doc_ids, term counts, postings (term, document, tf) of the block's terms, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(pickle.loads(map_file(f"{folder}/items").tobytes())[0], pa.large_string())
        for part in text_slices(batches):
            distinct, ids, ends = words_of(plain(texts_of(part.column("text"))))
            n = np.diff(ends)
            known = pc.fill_null(pc.index_in(distinct, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[ids] if len(ids) else np.zeros(0, np.int64)
            hit = term >= 0
            key, tf = np.unique(term[hit] * part.num_rows + owners(ends)[hit], return_counts=True)
            packed = [_packed(x) for x in (n, np.bincount(key // part.num_rows, minlength=len(wanted)), key % part.num_rows, tf)]
            row = {"docs": [part.column("doc_id").to_pylist()], "some": [int((n > 0).sum())], "total": [int(n.sum())], "size": [len(key)]} | {c: [x] for c, x in zip(("n", "df", "doc", "tf"), packed, strict=True)}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("docs", pa.list_(_arrow(docs, "doc_id"))), *((c, pa.int64()) for c in ("some", "total", "size")), *((c, pa.binary()) for c in ("n", "df", "doc", "tf"))])
    return docs.select("doc_id", "text").mapInArrow(run, f"docs array<{kind}>, some long, total long, size long, n binary, df binary, doc binary, tf binary")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _write_weights(posted: DataFrame, count: int, folder: str) -> None:
    """One file with every term's weight; document frequencies are summed in each task before they are shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("df").to_pylist():
                own = _unpacked(data).astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {t: d for batch in batches for t, d in zip(*(batch.column(c).to_pylist() for c in ("term", "df")), strict=True)}
        terms = len(pickle.loads(map_file(f"{folder}/items").tobytes())[0])
        put_file(f"{folder}/weights", np.array([weigh(found.get(t, 0), count) for t in range(terms)], "<i8").tobytes())
        return iter(())

    sums = posted.select("df").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    sums.repartition(1).mapInArrow(write, "term long").write.format("noop").mode("overwrite").save()


def _found(posted: DataFrame, count: int, total: int, folder: str, k: int, kind: str, arrow: pa.DataType) -> DataFrame:
    """(number, doc_id, score): what each task finds for each item."""

    def shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[tuple[list, Shard]]:
        held: list[tuple] = []
        size = 0

        def whole() -> tuple[list, Shard]:
            ids = [x for h in held for x in h[0]]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            n = np.concatenate([h[1] for h in held])
            term = np.concatenate([h[2] for h in held])
            doc = np.concatenate([h[3].astype(np.int64) + f for h, f in zip(held, first[:-1], strict=True)])
            tf = np.concatenate([h[4] for h in held])
            impact = weight[term] * impacts(tf, lengths(n, count, total)[doc])
            return [ids[i] for i in order], Shard(term, place[doc], impact, len(weight), len(ids))

        for batch in batches:
            for row in batch.to_pylist():
                df = _unpacked(row["df"]).astype(np.int64)
                held.append((row["docs"], _unpacked(row["n"]), np.repeat(np.arange(len(df)), df), _unpacked(row["doc"]), _unpacked(row["tf"])))
                size += len(held[-1][3])
                if size >= SHARD:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, numbers, ends, terms, repeats = pickle.loads(map_file(f"{folder}/items").tobytes())
        weight = map_file(f"{folder}/weights").view("<i8")
        best: list[list[tuple]] = [[] for _ in numbers]
        for ids, shard in shards(batches, weight):
            for item, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                own = best[item]
                docs, scores = shard.search(terms[x:y], repeats[x:y], k, own[-1][0] if len(own) == k else 0)
                own += [(int(s), ids[d]) for d, s in zip(docs, scores, strict=True)]
                own.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
                del own[k:]
        rows = [(int(numbers[i]), d, s) for i, own in enumerate(best) for s, d in own]
        if rows:
            number, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(doc, arrow), pa.array(score, pa.int64())], names=["number", "doc_id", "score"])

    return posted.select("docs", "n", "df", "doc", "tf").mapInArrow(run, f"number long, doc_id {kind}, score long")


def top_k(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each row of `items` (item_id, text)."""
    spark = docs.sparkSession
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    items = number_rows(items.select("item_id", "text"), [], ["item_id", "text"], "number")
    items = store(items.withColumn("block", F.floor(F.col("number") / block).cast("long")), "items")
    last = items.agg(F.max("block")).head()[0]
    found = []
    for number in range(0 if last is None else last + 1):
        folder = f"{run_folder(spark)}/block"
        _write_items(items, number, folder)
        posted = store(_posted(docs, folder), "posted")
        count, total, size = posted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("some", "total", "size"))).head()
        if not total:
            continue
        _write_weights(posted, count, folder)
        # Packed postings are small, and much work: tasks are cut by postings and not by bytes.
        posted = posted.repartition(max(1, math.ceil(size / (2 * SHARD))))
        found.append(store(_found(posted, count, total, folder, k, kind, _arrow(docs, "doc_id")), "found"))
    if not found:
        none = F.lit(None)
        return items.where(F.lit(False)).select("item_id", none.cast("int").alias("rank"), none.cast(kind).alias("doc_id"), none.cast("long").alias("score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("number", "salt").orderBy(*order))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k)
    return rows.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
