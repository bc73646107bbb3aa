"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, of unknown label, are the unlabelled. A linear model over words
and the beginnings of words is trained on the risk estimator

    prior * E_P[l(f)] + max(0, (1 - prior) / (1 - rest) * (E_U[l(-f)] - rest * E_P[l(-f)]))

with the sigmoid loss l(z) = 1 / (1 + exp(z)). The confirmed texts are no part of U, so toxic texts are rarer in it than
among all: of n texts with k confirmed, rest = (prior * n - k) / (n - k), at least 0. Where the bracket falls below zero the step climbs it again instead of descending. Small
weights are pulled to zero (a lasso step), so that the many words of a long clean text add nothing.

A text's features are its distinct words, lower-cased and without marks at the ends, and their first 3, 4 and 5 code
points, each counted once per distinct word. So a word's part in the score is one number, found once per batch for the
batch's distinct words, and scoring needs one pass over the texts and no shuffle.

Bounds (the only sampled part is the fit): at most `POSITIVES` toxic and `UNLABELLED` other texts, lowest digest of
doc_id first, so that the choice depends on neither order nor partitions, and of these as many as fit in `FIT_BYTES`
together, whole; of several texts of one doc_id the one of lowest digest. The prior is the share of toxic labels among
all labels that may be learned from. A text may occur more than once, under one doc_id or several; NULL and empty texts
have no features and get the score of the bias alone. Without any positive, or nothing unlabelled, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import one_text, owners, text_slices, texts_of, within, words_of

POSITIVES = 1500
UNLABELLED = 4500
FIT_BYTES = 128 << 20
#: A feature is learned if at least so many sampled positives have it and its share of them is so many times its
#: share of the unlabelled, and so many standard errors above it.
LEAST_TEXTS, LEAST_LIFT, LEAST_Z = 4, 2.5, 4.0
#: First code points of a word that are features besides the word.
HEADS = (3, 4, 5)
STEPS, RATE, PULL = 400, 0.05, 2e-4
MARKS = " \t.,;:!?\"'()[]{}<>|*#$%&_-/\\~^`=+@…“”„«»’‘–—¡¿"


@dataclass
class Model:
    words: pa.Array
    weights: np.ndarray
    heads: dict[int, tuple[pa.Array, np.ndarray]]
    bias: float


def _plain(distinct: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(distinct), MARKS)


def _features(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The feature of each kind that each word has; NULL where the word is no longer than the beginning."""
    yield 0, words
    size = pc.utf8_length(words)
    for n in HEADS:
        yield n, pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(words, 0, n), pa.scalar(None, words.type))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, distinct plain words) of each text."""
    for part in text_slices(batches):
        distinct, ids, ends = words_of(texts_of(part.column("text")))
        plain = _plain(distinct).dictionary_encode()
        codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[ids]
        names = plain.dictionary.to_pylist()
        sets = [[names[k] for k in np.unique(codes[a:b])] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"positive": part.column("positive"), "words": pa.array(sets, pa.list_(pa.string()))})


def slopes(f: np.ndarray, positive: np.ndarray, prior: float, rest: float) -> tuple[float, np.ndarray]:
    """The bracket of the risk (before it is cut at 0), and what each text's f is to be moved against."""
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # l(-f)
    down = up * (1 - up)
    negative = np.where(positive, -rest, 1.0) * share * (1 - prior) / (1 - rest)
    bracket = float((negative * up).sum())
    return bracket, (negative - np.where(positive, prior * share, 0)) * down if bracket >= 0 else -negative * down


def nnpu(positive: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int, prior: float, rest: float) -> tuple[np.ndarray, float]:
    """Weights and bias over texts given as (row, column) pairs of features, each once per distinct word that has it."""
    n = len(positive)
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        f = bias + np.bincount(rows, w[columns], n)
        slope = slopes(f, positive, prior, rest)[1]
        g = np.append(np.bincount(columns, slope[rows], width), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * PULL, 0)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """Learn from the rows of `labels` (doc_id, toxic) and `docs` for which `usable` holds, within the bounds above."""
    counts = labels.where(usable & F.col("toxic").isNotNull()).groupBy("toxic").count().collect()  # two rows
    seen = {row["toxic"]: row["count"] for row in counts}
    total = sum(seen.values())
    if not seen.get(1):
        return None
    prior = min(0.9, max(1e-3, seen[1] / total))
    digest = F.xxhash64("doc_id")
    known = labels.where(usable & (F.col("toxic") == 1)).select("doc_id").distinct()
    known = known.orderBy(digest, "doc_id").limit(POSITIVES).withColumn("positive", F.lit(True))
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    texts = docs.where(usable).select("doc_id").distinct().join(toxic.where(usable).withColumn("marked", F.lit(1)), "doc_id", "left")
    sizes = texts.agg(F.count("*").alias("n"), F.count("marked").alias("k")).head()
    rest = min(0.9, max(0.0, (prior * sizes["n"] - sizes["k"]) / max(1, sizes["n"] - sizes["k"])))
    other = texts.where("marked is null").select("doc_id")
    other = other.orderBy(digest, "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    sample = within(one_text(docs.select("doc_id", "text").join(known.unionByName(other), "doc_id"), "doc_id", "positive"), F.octet_length("text"), FIT_BYTES)
    rows = sample.select("positive", "text").mapInArrow(_word_sets, "positive boolean, words array<string>").toArrow()
    positive = rows.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    if not positive.any() or positive.all():
        return None
    lists = rows.column("words").combine_chunks()
    text = owners(lists.offsets.to_numpy().astype(np.int64))
    words = lists.values
    kinds, at_rows, at_columns, width = {}, [], [], 0
    for kind, values in _features(words):
        coded = values.dictionary_encode()
        real = values.is_valid().to_numpy(zero_copy_only=False)
        codes = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[real]
        owner = text[real]
        pairs = np.unique(owner * (len(coded.dictionary) + 1) + codes)
        has, code = np.divmod(pairs, len(coded.dictionary) + 1)
        hits = np.bincount(code, positive[has], len(coded.dictionary))
        misses = np.bincount(code, ~positive[has], len(coded.dictionary))
        lift = (hits / positive.sum()) / ((misses + 0.5) / (~positive).sum())
        both = (hits + misses) / len(positive)
        error = np.sqrt(both * (1 - both) * (1 / positive.sum() + 1 / (~positive).sum())) + 1e-12
        apart = (hits / positive.sum() - misses / (~positive).sum()) / error
        keep = (hits >= LEAST_TEXTS) & (lift >= LEAST_LIFT) & (apart >= LEAST_Z)
        number = np.full(len(coded.dictionary), -1)
        number[keep] = width + np.arange(keep.sum())
        kinds[kind] = (coded.dictionary.filter(pa.array(keep)), slice(width, width + int(keep.sum())))
        chosen = number[codes] >= 0
        at_rows.append(owner[chosen])
        at_columns.append(number[codes][chosen])
        width += int(keep.sum())
    w, bias = nnpu(positive, np.concatenate(at_rows), np.concatenate(at_columns), width, prior, rest)
    heads = {n: (kinds[n][0], w[kinds[n][1]]) for n in HEADS}
    return Model(kinds[0][0], w[kinds[0][1]], heads, bias)


def word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """Each word's part in the score of a text that has it."""
    out = np.zeros(len(words))
    known = {0: (model.words, model.weights), **model.heads}
    for kind, values in _features(words):
        names, weights = known[kind]
        if len(names):
            at = pc.fill_null(pc.index_in(values, names.cast(values.type)), -1).to_numpy(zero_copy_only=False)
            out += np.where(at >= 0, weights[at], 0)
    return out


def scores(model: Model | None, texts: pa.Array) -> np.ndarray:
    """A score from 0 to 1 for each text."""
    if model is None:
        return np.zeros(len(texts))
    distinct, ids, ends = words_of(texts)
    plain = _plain(distinct).dictionary_encode()
    part = word_scores(model, plain.dictionary)
    codes = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    telling = np.flatnonzero(part[codes])  # the rest adds nothing
    pairs = np.unique(owners(ends)[telling] * (len(part) + 1) + codes[telling])
    text, word = np.divmod(pairs, len(part) + 1)
    f = model.bias + np.bincount(text, part[word], len(texts))
    return 1 / (1 + np.exp(-np.clip(f, -700, 700)))


def score(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """`docs` with score and predicted (1 from 0.5 on), named with a prefix; columns of these names are replaced."""
    ready = docs.withColumns({f"{prefix}score": F.lit(0.0), f"{prefix}predicted": F.lit(0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            s = scores(model, texts_of(part.column("text")))
            new = {f"{prefix}score": pa.array(s), f"{prefix}predicted": pa.array((s >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return ready.mapInArrow(run, ready.schema)
