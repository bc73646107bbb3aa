"""Quality classifier: histogram gradient-boosted trees over document statistics.

`statistics` computes `NAMES` for every whole text in numpy, a slice of texts at a time, and no shuffle. `fit` cuts each
statistic at the quantiles of the sample into at most `BINS` bins and boosts depth-limited trees on the logistic loss;
a level of a tree is built from two histograms (gradient, curvature) over (node, statistic, bin). Trees are flattened
into arrays (statistic, cut, leaf value by heap position), so that all rows go down a level of all trees by indexing.

Bounds: the fit takes at most `SAMPLE` labelled rows, lowest digest of doc_id first; nothing else is sampled. Labels of
a doc_id that has both values are left out. NULL and empty texts have statistics of 0 and are scored like others. With
no usable labels every score is 0.5; with one class only, its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import in_windows, owners, store, sums, text_slices, texts_of, words_of

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 64, 4, 60, 0.2, 10.0, 1.0
NAMES = (
    "words", "code_points", "mean_word", "long_words", "distinct_share", "top_word_share", "repeat_share", "stutter_share",
    "lines", "mean_line", "dup_line_share", "symbols", "marks", "bangs", "upper", "digits", "pipes", "non_ascii", "sentences",
)
SCHEMA = ", ".join(f"{n} double" for n in NAMES)

_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((b"#*$%&<>~^", b".,;:!?'\"()-", b"!", bytes(range(65, 91)), b"0123456789", b"|", bytes(range(128, 256)), b".?!"), 1):
    for _b in _set:
        _CLASSES[_b] |= 1 << _k


def text_statistics(texts: pa.Array) -> np.ndarray:
    """One row of `NAMES` for each text."""
    n = len(texts)
    strings = texts.to_pylist()
    distinct, ids, ends = words_of(texts)
    words = np.diff(ends)
    per = np.maximum(words, 1)
    size = np.array(pa.compute.utf8_length(distinct).to_numpy(zero_copy_only=False), np.int64)[ids] if len(ids) else ids
    letters = sums(size, ends)
    text = owners(ends)
    pairs, uses = np.unique(text * (len(distinct) + 1) + ids, return_counts=True)
    holder = pairs // (len(distinct) + 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, holder, uses)
    stutter = np.zeros(len(ids), np.int64)
    stutter[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    raw = np.array([np.bincount(_CLASSES[np.frombuffer(s.encode(), np.uint8)], minlength=512) for s in strings]).reshape(n, 512)
    kinds = {k: raw[:, (np.arange(512) >> k) & 1 == 1].sum(axis=1) for k in range(1, 9)}
    points = np.array([len(s) for s in strings])
    lines = np.zeros(n)
    dup = np.zeros(n)
    for k, s in enumerate(strings):
        own = [x for x in s.split("\n") if x.strip()]
        lines[k], dup[k] = len(own), len(own) - len(set(own))
    chars = np.maximum(points, 1)
    columns = (
        words, points, letters / per, sums(size > 12, ends) / per, np.bincount(holder, minlength=n) / per, top / per,
        sums(in_windows(ids, ends), ends) / per, sums(stutter, ends) / per, lines, words / np.maximum(lines, 1), dup / np.maximum(lines, 1),
        kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, kinds[6] / chars, kinds[7] / chars, kinds[8] / per,
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1).reshape(n, len(NAMES))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics), one row for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            table = text_statistics(texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in table.T)], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


@dataclass
class Trees:
    """Complete binary trees in heap order: statistic and cut of each inner node, value of each leaf."""

    statistic: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees on rows `x` with labels `y` of 0 and 1."""
    n, width = x.shape
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(width)], axis=1)  # bin b: cut b-1 < x <= cut b
    f = np.full(n, base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    statistic, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width_of = 2**level
            slot = ((node[:, None] * width + np.arange(width)) * BINS + binned).ravel()
            sums_g = np.bincount(slot, np.repeat(g, width), width_of * width * BINS).reshape(width_of, width, BINS)
            sums_h = np.bincount(slot, np.repeat(h, width), width_of * width * BINS).reshape(width_of, width, BINS)
            left_g, left_h = sums_g.cumsum(2), sums_h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST / 10) | (right_h < LEAST / 10)] = 0
            best = gain.reshape(width_of, -1).argmax(1)
            split = gain.reshape(width_of, -1).max(1) > 1e-9
            which, at = best // BINS, best % BINS
            for k in range(width_of):
                if split[k] and at[k] < len(cuts[which[k]]):
                    statistic[t, width_of - 1 + k], cut[t, width_of - 1 + k] = which[k], cuts[which[k]][at[k]]
            here = width_of - 1 + node
            node = 2 * node + (x[np.arange(n), statistic[t, here]] > cut[t, here])
        total_g, total_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -RATE * total_g / (total_h + RIDGE)
        f += leaf[t][node]
    return Trees(statistic, cut, leaf, base)


def probability(trees: Trees | None, x: np.ndarray) -> np.ndarray:
    """The chance of label 1 for each row: all trees go down one level at a time."""
    if trees is None:
        return np.full(len(x), 0.5)
    number = np.arange(len(trees.leaf))[None, :]
    node = np.zeros((len(x), len(trees.leaf)), np.int64)
    row = np.arange(len(x))[:, None]
    for level in range(DEPTH):
        here = 2**level - 1 + node
        node = 2 * node + (x[row, trees.statistic[number, here]] > trees.cut[number, here])
    return 1 / (1 + np.exp(-(trees.base + trees.leaf[number, node].sum(axis=1))))


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Trees | None:
    """Learn from `labels` (doc_id, label 0 or 1) where `usable` holds."""
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most"))
    known = known.where("y = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "y")
    one = stats.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*NAMES)).alias("row"))  # the same of repeated ids on each run
    rows = one.select("doc_id", "y", "row.*").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return None
    x = np.stack([rows.column(n).to_numpy() for n in NAMES], axis=1)
    return grow(x, rows.column("y").to_numpy().astype(float))


def score(stats: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, score, predicted) for each row of statistics; predicted is 1 from 0.5 on."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.stack([part.column(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1).reshape(-1, len(NAMES))
            p = np.concatenate([probability(trees, x[k : k + 2048]) for k in range(0, len(x), 2048)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Statistics once, fit on the labels that may be learned from, score every document."""
    stats = store(statistics(docs), "statistics")
    return score(stats, fit(stats, labels, usable))
