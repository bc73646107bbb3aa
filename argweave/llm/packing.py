"""Best-fit packing of documents into sequences, improved by swaps.

Each document is its token ids and one end id. A document longer than a sequence is cut into pieces of full length from
its end backwards, so that only its first piece may be shorter; full pieces are sequences of their own. The other pieces
are dealt round-robin into groups of about `GROUP`, and each group is packed on its own: best fit in order of falling
length, then a local search over the underfull bins. From the fullest bin on, items of emptier bins move in, or are
exchanged one for one, one for two or two for one, wherever that fills the bin further; each step increases the sum of
squared fills, and the emptiest bins lose their items until they are gone. Passes repeat until none improves.

What a group loses is at most about one bin in `GROUP` pieces. A task holds one group's lengths, whatever the corpus;
texts are tokenised in slices and never shuffled. NULL text is the empty document (just the end id). doc_ids may repeat
or be NULL: pieces are rows, and each row of the input gives its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import store, text_slices, texts_of

LENGTH, END, GROUP = 2048, 0, 8192
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE vocabulary file. The merges run in tiktoken, several times faster than tokenizers and
    with the same ids; a text that holds a special token's string goes to tokenizers itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            known = json.load(source)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in token): k for token, k in known["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a very long run of white space is too deep for its pattern matcher
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in text_slices(batches):
            rows: list[tuple] = []
            owner = []
            for k, text in enumerate(texts_of(part.column("text")).to_pylist()):
                ids = np.append(encoder.ids(text).astype("<u4"), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                owner += [k] * (len(cuts) - 1)
                rows += [(j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            piece, start, size, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _lowest(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


class _Pool:
    """Items of the open bins by size; `mask` has a bit for each size there is."""

    def __init__(self) -> None:
        self.by_size: dict[int, set[int]] = {}
        self.mask = 0

    def add(self, size: int, item: int) -> None:
        self.by_size.setdefault(size, set()).add(item)
        self.mask |= 1 << size

    def drop(self, size: int, item: int) -> None:
        held = self.by_size[size]
        held.discard(item)
        if not held:
            self.mask &= ~(1 << size)

    def largest(self, least: int, most: int) -> int:
        """The largest size from `least` to `most`, or 0."""
        found = (self.mask & ((1 << (most + 1)) - 1)) >> least if most >= least else 0
        return found.bit_length() - 1 + least if found else 0

    def take(self, size: int) -> int:
        return next(iter(self.by_size[size]))


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: each item, the longest first, to the fullest bin that still has room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    mask = 0
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[item]
        fits = mask >> size
        if fits:
            left = _lowest(fits) + size
            held = room[left]
            which = held.pop()
            if not held:
                mask &= ~(1 << left)
            bins[which].append(item)
        else:
            left, which = length, len(bins)
            bins.append([item])
        left -= size
        if left:
            room.setdefault(left, []).append(which)
            mask |= 1 << left
    return bins


def _pass(sizes: list[int], bins: list[list[int]], length: int) -> bool:
    """One pass of moves and exchanges over the underfull bins, the fullest first; True if any was made."""
    fill = [sum(sizes[k] for k in b) for b in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < length), key=lambda k: (-fill[k], k))
    home, pool, changed = {}, _Pool(), False
    for which in order:
        for item in bins[which]:
            home[item] = which
            pool.add(sizes[item], item)

    def move(item: int, to: int) -> None:
        source = home[item]
        bins[source].remove(item)
        fill[source] -= sizes[item]
        bins[to].append(item)
        fill[to] += sizes[item]
        home[item] = to

    for a in order:
        if not bins[a]:
            continue
        for item in bins[a]:
            pool.drop(sizes[item], item)
        while fill[a] < length:
            gap = length - fill[a]
            best: tuple[int, list[int], list[int]] = (0, [], [])  # gain, items that leave, sizes that come
            if came := pool.largest(1, gap):
                best = (came, [], [came])
            leave = [(sizes[x], [x]) for x in bins[a]] + [(sizes[x] + sizes[y], [x, y]) for x, y in combinations(bins[a][:6], 2)]
            for out, items in leave:
                if best[0] == gap:
                    break
                came = pool.largest(out + 1, out + gap)
                if came and came - out > best[0]:
                    best = (came - out, items, [came])
                if len(items) == 1 and best[0] < gap:  # two come for one: try the larger of the two from the top
                    one = pool.largest(1, out + gap - 1)
                    for _ in range(8):
                        if not one or 2 * one < out:
                            break
                        two = pool.largest(1, min(one, out + gap - one))
                        if two == one and len(pool.by_size[one]) < 2:
                            two = pool.largest(1, one - 1)
                        if two and one + two - out > best[0]:
                            best = (one + two - out, items, [one, two])
                        one = pool.largest(1, one - 1)
            gain, items, sizes_in = best
            if not gain:
                break
            coming = []
            for size in sizes_in:
                item = pool.take(size)
                pool.drop(size, item)
                coming.append(item)
            b = home[coming[0]]  # what leaves goes where the first of what comes was
            after = {a: fill[a] + gain, b: fill[b] + sum(sizes[k] for k in items)}
            for item in coming:
                after[home[item]] = after.get(home[item], fill[home[item]]) - sizes[item]
            if after[b] > length or sum(f * f - fill[k] ** 2 for k, f in after.items()) <= 0:
                for item in coming:
                    pool.add(sizes[item], item)
                break
            for item in items:
                move(item, b)
                pool.add(sizes[item], item)
            for item in coming:
                move(item, a)
            changed = True
    bins[:] = [b for b in bins if b]
    return changed


def pack_group(sizes: list[int], length: int = LENGTH, passes: int = 12) -> list[list[int]]:
    """Bins of item numbers for one group: best fit, then the local search, and best fit again over the bins that are
    still underfull where that takes fewer."""
    bins = best_fit(sizes, length)
    for _ in range(passes):
        before = len(bins)
        changed = _pass(sizes, bins, length)
        fill = [sum(sizes[k] for k in b) for b in bins]
        loose = [k for b, f in zip(bins, fill, strict=True) if f < length for k in b]
        packed = best_fit([sizes[k] for k in loose], length)
        if len(packed) < sum(f < length for f in fill):
            bins = [b for b, f in zip(bins, fill, strict=True) if f == length] + [[loose[k] for k in b] for b in packed]
        if not changed and len(bins) == before:
            break
    return bins


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces, which should be stored, with sequence_id and offset."""
    short = cut.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows.column("length").to_pylist()
        number, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        first = 2 * (TaskContext.get().partitionId() << 32)
        for k, items in enumerate(pack_group(sizes, length)):
            at = 0
            for item in items:
                number[item], place[item] = first + 2 * k, at
                at += sizes[item]
        yield from rows.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(place)).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    packed = short.repartition(groups).mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    return pack(store(pieces(docs, vocabulary, length), "pieces"), length)
