"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

`judge` adds to every document the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its whole
text, `base_failed` (fewer than 50 words, or over half of the words in repeated 3-word windows), `content_share` (the
share of words in lines that Viterbi decoding marks as content) and `kept`: not base_failed, and a content share of at
least `LEAST_SHARE`. It is one pass over the texts without a shuffle; all texts of a slice are decoded together, one
line of each per step.

The field has two states, a weight for each line feature, and weights for the first state and for each transition. It
is fitted by gradient steps on the likelihood of line labels. Those begin as the label of the document (quality 1: all
lines content, 0: none) and then, for documents of label 0, are what the field itself decodes, twice over, as such
documents hold sound lines as well.

Bounds (only the fit is sampled): at most `SAMPLE` documents of each label, lowest digest of doc_id first, whose lines
are cut into runs of `RUN` for the fit alone. NULL and empty texts have no words and no lines, so they fail the base
rules; columns with the names above are replaced. Without labels of both kinds there is no field and every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import in_windows, one_text, owners, sums, text_slices, texts_of, within, words_of

SAMPLE, RUN = 1500, 64
#: Lines of the sampled texts together; a text whose lines do not fit in any more is left out of the fit.
FIT_LINES = 1_000_000
LEAST_WORDS, MOST_REPEATED, LEAST_SHARE = 50, 50, 0.5
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"

SPACE, SYMBOL, UPPER, DIGIT, BANG, MARK, LEAD, TAIL = range(1, 9)
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in (
    (LEAD, bytes(range(0xC0, 0x100))), (TAIL, bytes(range(0x80, 0xC0))), (UPPER, bytes(range(65, 91))), (DIGIT, b"0123456789"),
    (MARK, b".,;:?'\"()[]{}-_/\\@^`~+="), (BANG, b"!"), (SYMBOL, SYMBOLS), (SPACE, b"\x20\x09\x0a\x0b\x0c\x0d"),
):
    _KIND[list(_bytes)] = _kind


@dataclass
class Lines:
    """The texts of a slice: counts by text, and for each line its words and features; `ends` are lines by text."""

    counts: dict[str, np.ndarray]
    ends: np.ndarray
    words: np.ndarray
    features: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    lists = pc.split_pattern(texts, "\n")
    n, lines = len(texts), lists.values.slice(0)
    ends = lists.offsets.to_numpy().astype(np.int64) if n else np.zeros(1, np.int64)
    distinct, ids, line_ends = words_of(lines)
    words = np.diff(line_ends)
    size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(lines.to_pylist() if lines.type == pa.large_binary() else [x.encode() for x in lines.to_pylist()]), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(len(lines)) * 9, size) + _KIND[data], minlength=len(lines) * 9).reshape(-1, 9)
    points = size - kinds[:, TAIL]
    text_ends = line_ends[ends]
    inside = in_windows(ids, text_ends)
    same = np.zeros(len(ids), np.int64)
    same[1:] = ids[1:] == ids[:-1]
    coded = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = owners(ends)
    real = np.flatnonzero(words > 0)
    _, first = np.unique(text[real] * (len(lines) + 1) + coded[real], return_index=True)
    again = np.zeros(len(lines), bool)
    again[real] = True
    again[real[first]] = False
    counts = {
        "n_words": sums(words, ends), "word_chars": sums(points - kinds[:, SPACE], ends), "n_symbols": sums(kinds[:, SYMBOL], ends),
        "n_dup_lines": sums(again, ends), "n_repeat_words": sums(inside, text_ends),
    }
    per_point, per_word = np.maximum(points, 1), np.maximum(words, 1)
    letters = np.maximum(points - kinds[:, SPACE], 1)
    shares = [kinds[:, SYMBOL] / letters, kinds[:, UPPER] / letters, kinds[:, DIGIT] / letters, kinds[:, BANG] / letters, kinds[:, MARK] / letters, sums(inside, line_ends) / per_word, sums(same, line_ends) / per_word]
    shares += [(kinds[:, SYMBOL] + kinds[:, BANG]) / per_word]
    features = [np.ones(len(lines)), again, words == 0, np.minimum(words, 40) / 40, np.minimum(letters / per_word, 20) / 20, kinds[:, LEAD] / per_point]
    features += shares + [np.sqrt(np.minimum(s, 1)) for s in shares]
    return Lines(counts, ends, words, np.stack([np.asarray(f, float) for f in features], axis=1))


@dataclass
class Field:
    """Weights of the state "content" against "boilerplate": features, first state, transitions (from, to)."""

    weights: np.ndarray
    first: np.ndarray
    moves: np.ndarray


def _steps(ends: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of the sequences, longest first, and for each step how many sequences reach it."""
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    return ends[:-1][order], [int(k) for k in np.searchsorted(-size[order], -np.arange(longest), side="left")]


def decode(field: Field, features: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The likeliest states (True: content) of each sequence, by Viterbi; of equally likely ones, boilerplate."""
    gain = features @ field.weights
    starts, reach = _steps(ends)
    back = np.zeros((len(gain), 2), bool)
    best = np.zeros((len(starts), 2))
    last = np.zeros((len(starts), 2))
    for t, k in enumerate(reach):
        at = starts[:k] + t
        if t == 0:
            best[:k] = field.first
        else:
            ways = best[:k, :, None] + field.moves[None]
            back[at] = ways[:, 1, :] > ways[:, 0, :]
            best[:k] = ways.max(axis=1)
        best[:k, 1] += gain[at]
        last[:k] = best[:k]
    state = np.zeros(len(starts), np.int64)
    out = np.zeros(len(gain), bool)
    for t in range(len(reach) - 1, -1, -1):
        k = reach[t]
        at = starts[:k] + t
        after = reach[t + 1] if t + 1 < len(reach) else 0
        state[after:k] = last[after:k, 1] > last[after:k, 0]
        out[at] = state[:k] == 1
        state[:k] = back[at, state[:k]]
    return out


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(features: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Field:
    """Fit by the exact gradient of the likelihood (forward and backward sums), with Adam steps."""
    ends = np.unique(np.concatenate([ends, *(np.arange(a, b, RUN) for a, b in zip(ends[:-1], ends[1:], strict=True))]))
    n, width = features.shape
    starts, reach = _steps(ends)
    p = np.zeros(width + 6)
    m, v = np.zeros_like(p), np.zeros_like(p)
    y = labels.astype(np.int64)
    begins = ends[:-1][np.diff(ends) > 0]
    inner = np.ones(n, bool)
    inner[begins] = False
    pairs = np.flatnonzero(inner)
    seen = np.concatenate([features.T @ y, np.bincount(y[begins], minlength=2), np.bincount(2 * y[pairs - 1] + y[pairs], minlength=4)])
    for step in range(1, STEPS + 1):
        gain, first, moves = features @ p[:width], p[width : width + 2], p[width + 2 :].reshape(2, 2)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t, k in enumerate(reach):
            at = starts[:k] + t
            alpha[at] = first if t == 0 else _soft(alpha[at - 1][:, :, None] + moves[None], 1)
            alpha[at, 1] += gain[at]
        for t in range(len(reach) - 2, -1, -1):
            at = starts[: reach[t + 1]] + t
            after = beta[at + 1].copy()
            after[:, 1] += gain[at + 1]
            beta[at] = _soft(moves[None] + after[:, None, :], 2)
        joint = alpha + beta
        z = _soft(joint, 1)
        on = np.exp(joint[:, 1] - z)
        after = beta[pairs].copy()
        after[:, 1] += gain[pairs]
        both = np.exp(alpha[pairs - 1][:, :, None] + moves[None] + after[:, None, :] - z[pairs][:, None, None]).sum(axis=0)
        expected = np.concatenate([features.T @ on, [(1 - on[begins]).sum(), on[begins].sum()], both.ravel()])
        g = (expected - seen) / max(1, n) + RIDGE * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(p[:width], p[width : width + 2], p[width + 2 :].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Learn the field from `labels` (doc_id, quality 0 or 1), within the bounds above."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "y") for y in (0, 1)]
    sample = one_text(docs.select("doc_id", "text").join(chosen[0].unionByName(chosen[1]), "doc_id"), "doc_id", "y")
    sample = within(sample, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, FIT_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = lines_of(texts_of(part.column("text")))
            blobs = [found.features[a:b].astype(np.float32).tobytes() for a, b in zip(found.ends[:-1], found.ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "y": part.column("y"), "lines": pa.array(blobs, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"doc_id {kind}, y int, lines binary").orderBy("doc_id").toArrow()
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    width = lines_of(pa.array([""], pa.large_string())).features.shape[1]
    parts = [np.frombuffer(b, np.float32).reshape(-1, width) for b in rows.column("lines").to_pylist()]
    ends = np.cumsum([0, *(len(p) for p in parts)])
    features = np.concatenate(parts).astype(float)
    own = np.repeat(y, np.diff(ends)).astype(bool)
    field = train(features, ends, own)
    for _ in range(2):
        field = train(features, ends, own | decode(field, features, ends))
    return field


def judge(docs: DataFrame, field: Field | None, prefix: str = "") -> DataFrame:
    """`docs` with the counts, base_failed, content_share and kept, named with a prefix."""
    new = {**{n: F.lit(0).cast("long") for n in COUNTS}, "base_failed": F.lit(False), "content_share": F.lit(0.0), "kept": F.lit(False)}
    ready = docs.withColumns({prefix + n: c for n, c in new.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = lines_of(texts_of(part.column("text")))
            n_words = found.counts["n_words"]
            content = np.ones(len(found.words), bool) if field is None else decode(field, found.features, found.ends)
            share = sums(np.where(content, found.words, 0), found.ends) / np.maximum(n_words, 1)
            failed = (n_words < LEAST_WORDS) | (100 * found.counts["n_repeat_words"] > MOST_REPEATED * n_words)
            out = {**found.counts, "base_failed": failed, "content_share": share, "kept": ~failed & (share >= LEAST_SHARE)}
            added = {prefix + n: pa.array(v) for n, v in out.items()}
            yield pa.RecordBatch.from_arrays([added.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return ready.mapInArrow(run, ready.schema)
