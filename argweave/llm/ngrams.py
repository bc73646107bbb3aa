"""Language-model scoring with an Elias-Fano trie of words, pairs and triples.

The trie lies in the shared folder as files that tasks memory-map. Level 1 has the words, as 62-bit hashes in rising
order (an Elias-Fano sequence per shard; a word's number is its rank), and the rising sums of their counts. Level 2 has
the successors of each word: rising pointers (one per context, Elias-Fano), and the successors' numbers, each context's
run raised by the last value of the run before it so that the whole level rises (Elias-Fano), with the smoothed
probability of each pair, its log10 in steps of 1 / `STEP` as 16 bits. A pair is found by a successor search relative
to its context: pointer, raise, then the value within the run. Level 3 has the successors of each pair in the same form;
its contexts are the places of the pairs in their shard of level 2. It keeps c / (c(u v) + MU3) of each triple, and of
each pair the weight MU3 / (c(u v) + MU3) that the level below gets.

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = (c(v w) + MU p(w)) / (c(v) + MU)
    p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3)

A text is its words and one end; its first word follows an end, and is scored by that alone. Later words follow two
tokens. All pairs and triples of the training texts are kept, so the probabilities of a context sum to one, the rest
being that of all unknown words. Words are told apart by their hashes: two words of one hash, of which 2^62 values make
a chance below 10^-6 at a million words, would count as one.

Work is shuffled as packed arrays, one row per task and shard, summed before they are sent. Level 1 is dealt by hash.
Level 2 is dealt by where a pair stands in the running sum of word counts, which gives every shard the same mass of
pairs and splits a context that is heavier than a shard by its successors; a triple goes to the shard of its pair.
Shards grow in number with the text; a task looks only into those that its words ask for and holds `OPEN` files of a
level at most.

A-Z are lower-cased. NULL text is empty: one token, the end. Rows are scored one by one, so doc_ids may repeat or be
NULL. Without training rows N and V are 0 and every token is unknown. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import map_file, put_file, run_folder, sums, text_slices, texts_of, words_of
from argweave.llm.eliasfano import EliasFano, encode

MU, MU3, STEP = 50.0, 5.0, 2000
#: Files of a level that a task holds open.
OPEN = 256
#: Bytes of text for each shard of a level.
SHARD_BYTES = 16 << 20
#: Bytes of text that a task scores at once.
SCORE_BYTES = 4 << 20
#: Tokens whose pairs a task counts together before it sends them.
GATHER = 2_500_000
END = np.uint64(xxhash.xxh64_intdigest(b"") & (2**62 - 1))


def hashes(words: pa.Array) -> np.ndarray:
    """62-bit hashes; the end has that of the empty string, which is no word."""
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words)) & np.uint64(2**62 - 1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (rising), each token's place among them, and where each text's tokens begin; with the ends."""
    distinct, ids, ends = words_of(pc.ascii_lower(texts))
    names, place = np.unique(np.append(hashes(distinct), END), return_inverse=True)
    after = ends[1:] + np.arange(len(ends) - 1)
    out = np.empty(len(ids) + len(after), np.int64)
    inner = np.ones(len(out), bool)
    inner[after] = False
    out[inner] = place[ids]
    out[after] = place[-1]
    return names, out, np.concatenate(([0], after + 1))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """One row for each shard of rising keys; keys as differences, so that the shuffle's compression finds them small."""
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(keys)] if len(keys) else [0]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step = np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8")
        width = max(1, -(-int(step[1:].max(initial=0)).bit_length() // 8))  # bytes of a difference
        rest = step[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        rows.append((int(shard[a]), int(step[0]), width, rest, _counts(counts[a:b])))
    names = ["shard", "first", "width", "steps", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; 0 stands for one that is not below 256, which follows at the end in eight."""
    wide = counts[counts > 255].astype("<i8")
    return np.where(counts > 255, 0, counts).astype(np.uint8).tobytes() + wide.tobytes()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    rest = np.frombuffer(row["steps"], np.uint8).reshape(-1, row["width"])
    step = np.zeros((len(rest) + 1, 8), np.uint8)
    step[1:, : row["width"]] = rest
    keys = step.view("<u8").ravel()
    keys[0] = row["first"]
    counts = np.frombuffer(row["counts"], np.uint8, len(keys)).astype(np.int64)
    counts[counts == 0] = np.frombuffer(row["counts"][len(keys) :], "<i8")
    return keys.cumsum(dtype=np.uint64), counts


PACKED = "shard int, first long, width int, steps binary, counts binary"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The summed keys of each shard of a partition that is sorted by shard."""
    last, keys, counts, size = None, [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if last is not None and row["shard"] != last:
                yield (last, *summed(np.concatenate(keys), np.concatenate(counts)))
                keys, counts, size = [], [], 0
            last = row["shard"]
            k, c = _unpacked(row)
            keys.append(k)
            counts.append(c)
            size += len(k)
            if len(keys) > 64 and size > 4_000_000:
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [c], len(k) // 2
    if last is not None:
        yield (last, *summed(np.concatenate(keys), np.concatenate(counts)))


@dataclass
class Shape:
    """What tasks need to find their way in the files: for each shard of level 1 the words and tokens before it."""

    folder: str
    shards: int
    words: np.ndarray
    tokens: np.ndarray

    @property
    def v(self) -> int:
        return int(self.words[-1])

    @property
    def n(self) -> int:
        return int(self.tokens[-1])


def _hash_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rising in the key, so that ranks within shards are ranks of the whole after adding what stands before."""
    return (keys >> np.uint64(30)).astype(np.int64) * shards >> 32


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each run of a rising array."""
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)] if len(shard) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[a]), int(a), int(b)


class Level:
    """The files of a level, of which the `OPEN` asked for last stay open."""

    name = ""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.files: dict[int, tuple | None] = {}

    def shard(self, s: int) -> tuple | None:
        if s not in self.files:
            while len(self.files) >= OPEN:
                self.files.pop(next(iter(self.files)))
            data = map_file(f"{self.shape.folder}/{self.name}-{s}")
            self.files[s] = self.read(data) if len(data) else None
        return self.files[s]

    def read(self, data: np.ndarray) -> tuple:
        raise NotImplementedError


class Level1(Level):
    """Words, their numbers and their counts."""

    name = "words"

    def read(self, data: np.ndarray) -> tuple[EliasFano, EliasFano]:
        words = EliasFano(data)
        return words, EliasFano(data[words.size :])

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rising hashes: number (-1: unknown), count, and the tokens of all words before it."""
        number, count, before = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for s, a, b in _runs(_hash_shard(keys, self.shape.shards)):
            if self.shape.words[s] == self.shape.words[s + 1]:
                continue
            words, totals = self.shard(s)
            place = words.find(keys[a:b])
            known = np.flatnonzero(place >= 0)
            at = place[known]
            low = totals.access(at).astype(np.int64)
            number[a + known] = self.shape.words[s] + at
            count[a + known] = totals.access(at + 1).astype(np.int64) - low
            before[a + known] = self.shape.tokens[s] + low
        return number, count, before


def _pair_shard(before: np.ndarray, count: np.ndarray, second: np.ndarray, shape: Shape) -> np.ndarray:
    """The shard of a pair: where it stands in the running sum of counts, successors being spread evenly over their context."""
    place = before + (count * (second / max(1, shape.v))).astype(np.int64)
    return (place * (shape.shards / max(1, shape.n))).astype(np.int64).clip(0, shape.shards - 1)


class Level2(Level):
    """Pairs and their probabilities."""

    name = "pairs"

    def read(self, data: np.ndarray) -> tuple:
        contexts = EliasFano(data[8:])
        at = 8 + contexts.size
        pointers = EliasFano(data[at:])
        at += pointers.size
        successors = EliasFano(data[at:])
        at += successors.size
        return int(data[:8].view("<u8")[0]), contexts, pointers, successors, data[at:].view("<u2")

    def look(self, context: np.ndarray, second: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(second | context) of rising pairs, NaN where there is no such pair, and their places in their shards (-1)."""
        out, places = np.full(len(context), np.nan), np.full(len(context), -1, np.int64)
        for s, a, b in _runs(shard):
            found = self.shard(s)
            if found is None:
                continue
            first, contexts, pointers, successors, values = found
            fresh = np.concatenate(([True], context[a + 1 : b] != context[a : b - 1]))
            own, turn = context[a:b][fresh], fresh.cumsum() - 1
            inside = own >= first
            slot = np.full(len(own), -1, np.int64)
            slot[inside] = contexts.find((own[inside] - first).astype(np.uint64))
            real = np.flatnonzero(slot >= 0)
            start = pointers.access(slot[real]).astype(np.int64)
            raised = np.zeros(len(real), np.uint64)
            later = start > 0
            raised[later] = successors.access(start[later] - 1) + np.uint64(1)
            raise_of, start_of, end_of = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            raise_of[real], start_of[real] = raised, start
            end_of[real] = pointers.access(slot[real] + 1).astype(np.int64)
            ask = np.flatnonzero(slot[turn] >= 0)
            place = successors.find(raise_of[turn[ask]] + second[a:b][ask].astype(np.uint64))
            good = (place >= start_of[turn[ask]]) & (place < end_of[turn[ask]])
            out[a + ask[good]] = values[place[good]] / -STEP
            places[a + ask[good]] = place[good]
        return out, places


class Level3(Level):
    """Triples: what a pair's successors have of their own, and what the pair leaves to the level below."""

    name = "triples"

    def read(self, data: np.ndarray) -> tuple:
        pointers = EliasFano(data)
        at = pointers.size
        successors = EliasFano(data[at:])
        at += successors.size
        rest = data[at:].view("<u2")
        return pointers, successors, rest[: pointers.n - 1], rest[pointers.n - 1 :]

    def weights(self, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 of the weight that rising pairs leave to the level below."""
        out = np.zeros(len(place))
        for s, a, b in _runs(shard):
            found = self.shard(s)
            if found is not None:
                out[a:b] = found[2][place[a:b]] / -STEP
        return out

    def look(self, shard: np.ndarray, place: np.ndarray, third: np.ndarray) -> np.ndarray:
        """log10 of the own part of rising triples, NaN where there is none."""
        out = np.full(len(place), np.nan)
        for s, a, b in _runs(shard):
            found = self.shard(s)
            if found is None:
                continue
            pointers, successors, _, values = found
            fresh = np.concatenate(([True], place[a + 1 : b] != place[a : b - 1]))
            own, turn = place[a:b][fresh], fresh.cumsum() - 1
            start, end = pointers.access(own).astype(np.int64), pointers.access(own + 1).astype(np.int64)
            raised = np.zeros(len(own), np.uint64)
            later = start > 0
            raised[later] = successors.access(start[later] - 1) + np.uint64(1)
            at = successors.find(raised[turn] + third[a:b].astype(np.uint64))
            good = np.flatnonzero((at >= start[turn]) & (at < end[turn]))
            out[a + good] = values[at[good]] / -STEP
        return out


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for part in text_slices(batches):
        yield tokens_of(texts_of(part.column("text")))


@dataclass
class Pairs:
    """The distinct pairs of some texts, rising, and which of them each token ends."""

    first: np.ndarray
    second: np.ndarray
    of: np.ndarray
    later: np.ndarray  # tokens that are not the first of their text

    @staticmethod
    def read(sequence: np.ndarray, ends: np.ndarray, width: int) -> Pairs:
        context = np.empty_like(sequence)
        context[1:] = sequence[:-1]
        context[ends[:-1]] = sequence[ends[1:] - 1]  # a text's last token is an end, and its first follows one
        code = context * width + sequence
        order = np.argsort(code)
        code = code[order]
        fresh = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
        of = np.empty(len(code), np.int64)
        of[order] = fresh.cumsum() - 1
        later = np.ones(len(code), bool)
        later[ends[:-1]] = False
        return Pairs(*np.divmod(code[fresh], max(1, width)), of, np.flatnonzero(later))


def base_log(count: np.ndarray, shape: Shape) -> np.ndarray:
    return np.log10((count + 0.5) / (shape.n + 0.5 * (shape.v + 1)))


def train(docs: DataFrame, usable: Column) -> Shape:
    """Write both levels from the texts where `usable` holds."""
    spark = docs.sparkSession
    texts = docs.where(usable).select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    shards = max(4, -(-size // SHARD_BYTES))
    folder = run_folder(spark)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for names, tokens, _ in _counts_of(batches):
            keys, counts = summed(np.append(keys, names), np.append(counts, np.bincount(tokens, minlength=len(names))))
            if len(keys) > GATHER:
                yield _packed(keys, counts, _hash_shard(keys, shards))
                keys, counts = keys[:0], counts[:0]
        real = counts > 0
        yield _packed(keys[real], counts[real], _hash_shard(keys[real], shards))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in _by_shard(batches):
            put_file(f"{folder}/words-{s}", encode(keys) + encode(np.concatenate(([0], counts.cumsum())).astype(np.uint64)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shards, "shard").sortWithinPartitions("shard")

    parts = dealt(texts.mapInArrow(count_words, PACKED)).mapInArrow(write_words, "shard int, words long, tokens long").collect()  # a row per shard
    words, tokens = np.zeros(shards + 1, np.int64), np.zeros(shards + 1, np.int64)
    for row in parts:
        words[row.shard + 1], tokens[row.shard + 1] = row.words, row.tokens
    shape = Shape(folder, shards, words.cumsum(), tokens.cumsum())
    if shape.v >= 2**32:
        raise ValueError("More than 2^32 distinct words.")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Level1(shape)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def send() -> pa.RecordBatch:
            first = (keys >> np.uint64(32)).astype(np.int64)
            own, turn = np.unique(first, return_inverse=True)
            return _packed(keys, counts, _pair_shard(*_place_of(own, turn), (keys & np.uint64(2**32 - 1)).astype(np.int64), shape))

        places: dict[str, np.ndarray] = {"id": np.zeros(0, np.int64), "before": np.zeros(0, np.int64), "count": np.zeros(0, np.int64)}

        def _place_of(own: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(places["id"], own)
            return places["before"][at][turn], places["count"][at][turn]

        for names, sequence, ends in _counts_of(batches):
            number, count, before = level.look(names)
            known = np.unique(np.append(places["id"], number), return_index=True)
            places = {"id": known[0], "before": np.append(places["before"], before)[known[1]], "count": np.append(places["count"], count)[known[1]]}
            ids = number[sequence]
            context = np.empty_like(ids)
            context[1:] = ids[:-1]
            context[ends[:-1]] = ids[ends[1:] - 1]  # a text's last token is an end, and its first follows one
            fresh = np.sort((context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
            cut = np.flatnonzero(np.concatenate(([True], fresh[1:] != fresh[:-1])))
            keys, counts = summed(np.append(keys, fresh[cut]), np.append(counts, np.diff(np.append(cut, len(fresh)))))
            if len(keys) > GATHER:
                yield send()
                keys, counts = keys[:0], counts[:0]
                places = {n: x[:0] for n, x in places.items()}
        if len(keys):
            yield send()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Numbers(shape)
        for s, keys, counts in _by_shard(batches):
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)
            own, start = np.unique(first, return_index=True)
            runs = np.diff(np.append(start, len(keys)))
            last = second[np.append(start[1:], len(keys)) - 1]
            raised = np.concatenate(([0], np.cumsum(last[:-1] + 1)))
            of_context, of_second = level.counts(own), level.counts_any(second)
            p = (counts + MU * 10 ** base_log(of_second, shape)) / (np.repeat(of_context, runs) + MU)
            values = np.clip(np.rint(-STEP * np.log10(p)), 0, 65535).astype("<u2")
            parts = (encode((own - own[0]).astype(np.uint64)), encode(np.append(start, len(keys)).astype(np.uint64)), encode((second + np.repeat(raised, runs)).astype(np.uint64)))
            put_file(f"{folder}/pairs-{s}", b"".join((np.uint64(own[0]).tobytes(), *parts, values.tobytes())))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "pairs": [len(keys)]})

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level1, level2 = Level1(shape), Level2(shape)
        for names, sequence, ends in _counts_of(batches):
            number, count, before = level1.look(names)
            pairs = Pairs.read(sequence, ends, len(names))
            f, g = pairs.first, pairs.second
            shard = _pair_shard(before[f], count[f], number[g], shape)
            place = level2.look(number[f], number[g], shard)[1]
            code = np.sort(pairs.of[pairs.later - 1] * len(names) + sequence[pairs.later])
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            pair, third = np.divmod(code[cut], max(1, len(names)))
            keys = place[pair].astype(np.uint64) << np.uint64(32) | number[third].astype(np.uint64)
            yield _packed(keys, np.diff(np.append(cut, len(code))), shard[pair])

    def write_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level2 = Level2(shape)
        for s, keys, counts in _by_shard(batches):
            pairs = level2.shard(s)[3].n
            place, third = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.uint64)
            start = np.searchsorted(place, np.arange(pairs + 1))
            last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
            raised = np.concatenate(([0], np.cumsum(third[last[:-1]] + np.uint64(1)))).astype(np.uint64)
            total = np.bincount(place, counts, pairs)
            weights, values = MU3 / (total + MU3), counts / (total[place] + MU3)
            steps = [np.clip(np.rint(-STEP * np.log10(x)), 0, 65535).astype("<u2").tobytes() for x in (weights, values)]
            put_file(f"{folder}/triples-{s}", b"".join((encode(start.astype(np.uint64)), encode(third + np.repeat(raised, np.diff(last, prepend=-1))), *steps)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "triples": [len(keys)]})

    for name, count, write in (("pairs", count_pairs, write_pairs), ("triples", count_triples, write_triples)):
        have = {row.shard for row in dealt(texts.mapInArrow(count, PACKED)).mapInArrow(write, f"shard int, {name} long").collect()}  # a row per shard
        for s in set(range(shards)) - have:
            put_file(f"{folder}/{name}-{s}", b"")
    return shape


class Numbers:
    """Counts of words by their numbers."""

    def __init__(self, shape: Shape):
        self.level = Level1(shape)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of rising numbers."""
        shape, out = self.level.shape, np.zeros(len(numbers), np.int64)
        for s, a, b in _runs(np.searchsorted(shape.words, numbers, "right") - 1):
            totals = self.level.shard(s)[1]
            at = numbers[a:b] - shape.words[s]
            out[a:b] = (totals.access(at + 1) - totals.access(at)).astype(np.int64)
        return out

    def counts_any(self, numbers: np.ndarray) -> np.ndarray:
        own, turn = np.unique(numbers, return_inverse=True)
        return self.counts(own)[turn]


def score(docs: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level1, level2, level3 = Level1(shape), Level2(shape), Level3(shape)
        for part in text_slices(batches, limit=SCORE_BYTES):
            names, sequence, ends = tokens_of(texts_of(part.column("text")))
            number, count, before = level1.look(names)
            base = base_log(count, shape)
            pairs = Pairs.read(sequence, ends, len(names))
            first, second = pairs.first, pairs.second
            value = np.log10(MU / (count[first] + MU)) + base[second]
            shard, place, weight = np.zeros(len(first), np.int64), np.full(len(first), -1, np.int64), np.zeros(len(first))
            real = np.flatnonzero((number[first] >= 0) & (number[second] >= 0))
            f, g = first[real], second[real]
            shard[real] = _pair_shard(before[f], count[f], number[g], shape)
            found, place[real] = level2.look(number[f], number[g], shard[real])
            value[real] = np.where(np.isnan(found), value[real], found)
            known = np.flatnonzero(place >= 0)
            weight[known] = level3.weights(shard[known], place[known])
            scored = value[pairs.of]
            scored[pairs.later] += weight[pairs.of[pairs.later - 1]]
            ask = pairs.later[(place[pairs.of[pairs.later - 1]] >= 0) & (number[sequence[pairs.later]] >= 0)]
            code, turn = np.unique(pairs.of[ask - 1] * len(names) + sequence[ask], return_inverse=True)
            pair, third = np.divmod(code, max(1, len(names)))
            own = level3.look(shard[pair], place[pair], number[third])[turn]
            there = ~np.isnan(own)
            scored[ask[there]] = np.log10(10 ** own[there] + 10 ** scored[ask[there]])
            out = (np.diff(ends), sums(count[sequence] > 0, ends), np.full(len(ends) - 1, shape.n), _added(base[sequence], ends), _added(scored, ends))
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c) for c in out[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _added(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums by text, each of its own values only, so that a score does not depend on its neighbours."""
    return np.add.reduceat(values, ends[:-1]) if len(ends) > 1 else np.zeros(0)
