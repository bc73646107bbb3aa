"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are escaped as the model asks (a dummy space, spaces as U+2581) and cut into units that no piece
crosses: spaces, then what follows up to the next space. The distinct units of the batch are concatenated and their
suffixes sorted (by as many code points as the longest piece has). Each piece of the vocabulary is found by binary search
as a range of suffixes; the ranges give the edges (place, length, piece), which are sorted by place into a table of what
spans what. The table is then relaxed: of all edges that span two neighbouring tokens of a unit the best one, and of
equal ones the first, makes them one token, in every unit at once, until no edge spans two tokens. These are the merges
of the model's own BPE encoder, so the ids are the library's. Code points that no token has become byte pieces.

The model file is read for its pieces; the encoder is not the library's. No shuffle; memory is a slice's. NULL and empty
texts have no ids and decode to empty. A model whose pieces have a space after another character is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from argweave.llm.common import text_slices, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

#: Code points that are indexed together.
GROUP = 1 << 20


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(k) for k in range(n)]
        special = {k for k in range(n) if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)}
        self.byte = np.zeros(256, np.int64)
        self.out: list[bytes] = []
        for k, t in enumerate(self.texts):
            if model.is_byte(k):
                self.byte[int(t[1:-1], 16)] = k
                self.out.append(bytes([int(t[1:-1], 16)]))
            else:
                self.out.append(b"" if k in special else t.replace(SPACE, " ").encode())
        self.ids = np.array([k for k in range(n) if k not in special])
        if any(SPACE in self.texts[k].lstrip(SPACE) for k in self.ids):
            raise ValueError("A piece has a space inside.")
        scores = np.array([model.get_score(int(k)) for k in self.ids])
        order = np.lexsort((self.ids, -scores))
        self.ids = self.ids[order]  # the best piece first: a piece's place is its rank
        self.codes = [_codes(self.texts[k]) for k in self.ids]
        self.longest = max(len(c) for c in self.codes)
        self.flat, self.starts = np.concatenate(self.codes), np.concatenate(([0], np.cumsum([len(c) for c in self.codes])))

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, rank) of every occurrence of a piece in `text`, by place."""
        alphabet, letters = np.unique(text, return_inverse=True)
        # A letter's number and one more for "none" and "all" each; there are fewer than 2^21 code points.
        bits = 8 if len(alphabet) < 255 else 16 if len(alphabet) < 65_535 else 32
        per = 64 // bits
        pads = -(-self.longest // per) * per
        own = np.concatenate([letters.astype(np.uint64) + np.uint64(1), np.zeros(pads, np.uint64)])
        columns = []
        for k in range(0, pads, per):
            packed = np.zeros(len(text), np.uint64)
            for j in range(k, k + per):
                packed = (packed << np.uint64(bits)) | own[j : j + len(text)]
            columns.append(packed)
        suffixes = np.lexsort(columns[::-1])
        ordered = [c[suffixes] for c in columns]
        at = np.searchsorted(alphabet, self.flat).clip(0, len(alphabet) - 1)
        there = np.logical_and.reduceat(alphabet[at] == self.flat, self.starts[:-1])  # pieces whose every letter the text has
        numbers = np.flatnonzero(there)
        starts, size = self.starts[:-1][there], np.diff(self.starts)[there]
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
        bounds = []
        for fill in (0, (1 << bits) - 1):
            grid = np.full((len(size), pads), fill, np.uint64)
            for k in range(self.longest):
                has = size > k
                grid[has, k] = at[starts[has] + k].astype(np.uint64) + np.uint64(1)
            want = [np.bitwise_or.reduce(grid[:, k : k + per] << shifts, axis=1) for k in range(0, pads, per)]
            low, high = np.zeros(len(size), np.int64), np.full(len(size), len(text), np.int64)
            while (low < high).any():
                going = low < high
                middle = np.minimum((low + high) // 2, max(0, len(text) - 1))
                less, equal = np.zeros(len(size), bool), np.ones(len(size), bool)
                for column, w in zip(ordered, want, strict=True):
                    value = column[middle]
                    less |= equal & (value < w)
                    equal &= value == w
                low = np.where(going & less, middle + 1, low)
                high = np.where(going & ~less, middle, high)
            bounds.append(low)
        count = bounds[1] - bounds[0]
        which = np.repeat(np.arange(len(size)), count)
        place = suffixes[np.repeat(bounds[0], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        order = np.argsort(place, kind="stable")
        which = which[order]
        return place[order], size[which], numbers[which]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in turn, and where each unit's begin. No piece crosses a unit, so units go in groups of about
        `GROUP` code points, which bounds the memory whatever the text; only a longer unit is a group of its own."""
        ids, ends, group, held = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [], 0
        for k, unit in enumerate(units):
            group.append(unit)
            held += len(unit)
            if held >= GROUP or k == len(units) - 1:
                own, places = self._encode_group(group)
                ids.append(own)
                ends.append(places[1:] + ends[-1][-1])
                group, held = [], 0
        return np.concatenate(ids), np.concatenate(ends)

    def _encode_group(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(u) for u in units])
        text = _codes("".join(units))
        unit_of = np.repeat(np.arange(len(units)), lengths)
        place, length, rank = self.edges(text)
        inside = unit_of[np.minimum(place + length, len(text)) - 1] == unit_of[place]
        best = np.full((len(text), self.longest), NONE, np.int32)
        best[place[inside], length[inside] - 1] = rank[inside]
        start, size = np.arange(len(text)), np.ones(len(text), np.int64)
        alive, done_start, done_size = unit_of, [], []
        while len(start):
            both = size[:-1] + size[1:]
            able = (alive[1:] == alive[:-1]) & (both <= self.longest)
            found = np.full(len(start), NONE, np.int32)
            found[:-1][able] = best[start[:-1][able], both[able] - 1]
            heads = np.flatnonzero(np.concatenate(([True], alive[1:] != alive[:-1])))
            least = np.minimum.reduceat(found, heads)
            spread = np.diff(np.append(heads, len(start)))
            going = np.repeat(least < NONE, spread)
            done_start.append(start[~going])
            done_size.append(size[~going])
            hit = np.flatnonzero(going & (found == np.repeat(least, spread)))
            first = hit[np.concatenate(([True], alive[hit[1:]] != alive[hit[:-1]]))] if len(hit) else hit
            size[first] += size[first + 1]
            going[first + 1] = False
            start, size, alive = start[going], size[going], alive[going]
        start, size = np.concatenate(done_start), np.concatenate(done_size)
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
        ranks = best[start, size - 1]
        known = ranks < NONE
        ids = np.where(known, self.ids[np.where(known, ranks, 0)], -1)
        owner = unit_of[start]
        if not known.all():
            reps, rows = np.ones(len(ids), np.int64), {}
            for k in np.flatnonzero(~known):
                rows[k] = self.byte[np.frombuffer(chr(text[start[k]]).encode("utf-8", "surrogatepass"), np.uint8)]
                reps[k] = len(rows[k])
            at = np.concatenate(([0], np.cumsum(reps)))
            ids, owner = np.repeat(ids, reps), np.repeat(owner, reps)
            for k, values in rows.items():
                ids[at[k] : at[k + 1]] = values
        return ids, np.searchsorted(owner, np.arange(len(units) + 1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's begin."""
        filled = pc.not_equal(pc.binary_length(texts), 0)
        lists = pc.split_pattern(pc.if_else(filled, texts, pa.scalar(None, texts.type)), " ")
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        words = lists.drop_null().flatten() if len(lists) else pa.array([], texts.type)
        coded = words.dictionary_encode()
        distinct, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        several: dict[str, int] = {}
        blank = np.flatnonzero(np.array([w == "" for w in distinct], bool))
        if len(blank):  # spaces in a row: the empty words join the next one of their text as leading spaces
            empty = ids == blank[0]
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            last = np.zeros(len(ids), bool)
            last[ends[1:][np.diff(ends) > 0] - 1] = True
            keep = ~empty | last
            turn = np.cumsum(empty)
            before = np.where(keep, turn - empty, 0)
            prior = np.concatenate(([0], np.maximum.accumulate(np.where(keep, turn, 0))[:-1]))
            more = np.where(keep, before - prior, 0)
            for k in np.flatnonzero(keep & ((more > 0) | empty)):
                unit = SPACE * int(more[k]) + SPACE + distinct[ids[k]]
                ids[k] = several.setdefault(unit, len(distinct) + len(several))
            ids, text = ids[keep], text[keep]
            ends = np.searchsorted(text, np.arange(len(ends)))
        units = [SPACE + w for w in distinct] + list(several)
        unit_ids, places = self.encode_units(units)
        size = np.diff(places)[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        out = unit_ids[np.repeat(places[:-1][ids] - total[:-1], size) + np.arange(total[-1])]
        return out, total[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the dummy space."""
        text = b"".join([self.out[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for part in text_slices(batches):
            ids, places = vocabulary.encode(texts_of(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
            decoded = [vocabulary.decode(ids[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip) of every document: the ids in short, and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for part in text_slices(batches):
            texts = texts_of(part.column("text"))
            ids, places = vocabulary.encode(texts)
            cuts = list(zip(places[:-1], places[1:], strict=True))
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in cuts]
            same = [vocabulary.decode(ids[a:b]) == t for (a, b), t in zip(cuts, texts.to_pylist(), strict=True)]
            columns = [part.column("doc_id"), pa.array(np.diff(places), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")
