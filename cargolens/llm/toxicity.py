"""Toxicity by class-conditional Kneser-Ney models over characters.

Two interpolated Kneser-Ney models of order ``ORDER``, one of toxic and one of ordinary text, give
each character a log-likelihood ratio. Class counts come from a bounded sample of labelled texts;
the lower orders are continuation counts over all documents and shared by both classes, so that an
expression which the sample hardly has is smoothed by what the whole corpus shows. Characters are
mapped to 32 symbols, which bounds the tables at 32^ORDER entries: the ratio of every sequence is
worked out once, and a text is scored by lookups.

A text is compared by its length-normalised log-likelihoods, as a whole and within its words and
short windows, since a few words can make a long text toxic. A logistic curve fitted on sampled
texts that the class models have not seen turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import text as tx
from cargolens.llm.labelled import SAMPLE_ROWS, held_out, labelled_texts, training_labels
from cargolens.plans.staging import stage

ORDER = 5
SYMBOLS = 32
DISCOUNT = 0.75
#: One in so many sampled texts fits the logistic curve, the others the class models.
CURVE_FOLD = 4
#: Steps of a log-likelihood ratio in the packed table, and words of a window.
STEP, WINDOW = 1 / 12, 8

#: Symbol 0 ends words; 1-26 are letters without case, 27 digits, 28-31 bytes of other letters.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = 27
_SYMBOL[128:192] = 28 + np.arange(64) % 4
_LEAD = np.arange(256) >= 192


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each text between word ends, with one word end at a time."""
    buf, offsets = tx.utf8(texts)
    n = len(offsets) - 1
    keep = ~_LEAD[buf]
    before = np.concatenate([[0], np.cumsum(keep)])
    found = _SYMBOL[buf[keep]]
    found = np.insert(found, before[offsets[:-1]], 0)
    offsets = before[offsets] + np.arange(n + 1)
    found = np.append(found, np.uint8(0))
    double = np.zeros(len(found), bool)
    double[1:] = (found[1:] == 0) & (found[:-1] == 0)
    double[offsets[:-1]] = False
    before = np.concatenate([[0], np.cumsum(~double)])
    return found[~double], before[offsets]


def grams(found: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol but the text's first, the number of the last ORDER symbols; its text.

    Sequences do not reach into the text before: missing symbols count as word ends.
    """
    code = np.zeros(len(found), np.int32)
    place = np.arange(len(found))
    owner = np.searchsorted(offsets, place, "right") - 1
    place = place - offsets[owner]
    for back in range(ORDER):
        shifted = np.zeros(len(found), np.int32)
        shifted[back:] = found[: len(found) - back] if back else found
        shifted[place < back] = 0
        code += shifted << np.int32(5 * back)
    inner = (place > 0) & (owner < len(offsets) - 1)
    return code[inner], owner[inner]


def gram_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary, every): counts in the toxic and ordinary texts of ``sample`` (text, label),
    and in all texts of ``docs``.

    Each task counts its own grams first, at most 32^ORDER of them.
    """
    every = docs.select("text", F.lit(None).cast("double").alias("label"))
    rows = every.unionByName(sample.select("text", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None

        def add(grams_found: np.ndarray, numbers: np.ndarray) -> None:
            nonlocal held
            if held is not None:
                grams_found = np.concatenate([held[0], grams_found])
                numbers = np.concatenate([held[1], numbers])
            order = np.argsort(grams_found, kind="stable")
            grams_found, numbers = grams_found[order], numbers[order]
            first = np.flatnonzero(np.diff(grams_found, prepend=-1))
            held = grams_found[first], np.add.reduceat(numbers, first)

        for batch in tx.slices(batches, "text"):
            code, owner = grams(*symbols(batch.column("text")))
            label = batch.column("label").fill_null(2).to_numpy(zero_copy_only=False)
            kind = label.astype(np.int8)[owner]
            if len(code):
                order = np.argsort(code, kind="stable")
                code, kind = code[order], kind[order]
                first = np.flatnonzero(np.diff(code, prepend=-1))
                flags = np.stack([kind == 1, kind == 0, kind == 2], 1)
                add(code[first], np.add.reduceat(flags.astype(np.int64), first))
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0]), *(pa.array(c) for c in held[1].T.copy())],
                names=["gram", "toxic", "ordinary", "every"],
            )

    counted = rows.mapInArrow(run, "gram int, toxic long, ordinary long, every long")
    return counted.groupBy("gram").agg(
        *(F.sum(c).alias(c) for c in ("toxic", "ordinary", "every"))
    )


def _shared_backoff(seen: np.ndarray) -> np.ndarray:
    """P(last symbol | the ORDER - 2 before) from continuation counts of the distinct grams."""
    distinct = np.unique(seen)
    total = np.full(SYMBOLS, 1 / SYMBOLS)
    for width in range(1, ORDER):
        # continuation counts: how many symbols stand before each sequence of this width
        higher = np.unique(distinct & ((1 << 5 * (width + 1)) - 1))
        counts = np.bincount(higher & ((1 << 5 * width) - 1), minlength=1 << 5 * width)
        counts = counts.reshape(-1, SYMBOLS).astype(np.float64)
        sums = counts.sum(1, keepdims=True)
        kinds = (counts > 0).sum(1, keepdims=True)
        lower = np.tile(total.reshape(-1, SYMBOLS), (max(1, len(counts) // max(1, total.size // SYMBOLS)), 1))
        own = np.maximum(counts - DISCOUNT, 0) / np.maximum(sums, 1)
        total = own + np.where(sums > 0, DISCOUNT * kinds / np.maximum(sums, 1), 1.0) * lower
    return total


def ratio_table(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(symbol | context, toxic) - log P(symbol | context, ordinary) of every gram, in STEPs."""
    lower = _shared_backoff(gram)  # contexts of ORDER - 2 symbols
    table = np.zeros(SYMBOLS**ORDER, np.int8)
    order = np.argsort(gram)
    gram, toxic, ordinary = gram[order], toxic[order], ordinary[order]
    part = SYMBOLS ** (ORDER - 1)  # grams that share their first symbol
    for first in range(SYMBOLS):
        a, b = np.searchsorted(gram, [first * part, (first + 1) * part])
        logs = []
        for counts in (toxic, ordinary):
            dense = np.zeros(part)
            dense[gram[a:b] - first * part] = counts[a:b]
            dense = dense.reshape(-1, SYMBOLS)
            sums = dense.sum(1, keepdims=True)
            kinds = (dense > 0).sum(1, keepdims=True)
            own = np.maximum(dense - DISCOUNT, 0) / np.maximum(sums, 1)
            mass = np.where(sums > 0, DISCOUNT * kinds / np.maximum(sums, 1), 1.0)
            logs.append(np.log(own + mass * lower))
        steps = np.clip((logs[0] - logs[1]) / STEP, -127, 127)
        table[first * part : (first + 1) * part] = np.rint(steps).astype(np.int8).ravel()
    return table


FEATURES = 4


def features(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood ratios: of the text, its best word and window; its length."""
    found, offsets = symbols(texts)
    code, owner = grams(found, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(code):
        return out
    ratio = table[code].astype(np.float32) * np.float32(STEP)
    length = np.bincount(owner, minlength=n)
    out[:, 0] = np.bincount(owner, ratio, minlength=n) / np.maximum(length, 1)
    out[:, 3] = np.log1p(length)
    ends = (code & 31) == 0
    first = np.ones(len(code), bool)
    first[1:] = ends[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(code)))
    word = np.add.reduceat(ratio, begin)
    mine = owner[begin]
    present, at = np.unique(mine, return_index=True)
    out[present, 1] = np.maximum.reduceat(word / np.sqrt(size), at)
    total = np.concatenate([[0.0], np.cumsum(word, dtype=np.float64)])
    stop = np.minimum(np.arange(len(word)) + WINDOW, np.append(at, len(word))[np.searchsorted(present, mine) + 1])
    window = (total[stop] - total[:-1]) / WINDOW
    out[present, 2] = np.maximum.reduceat(window, at)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        x = (features(texts, self.table) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for a handful of weights."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - ridge * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most: int = SAMPLE_ROWS
) -> ToxicityModel:
    """The model for ``labels.toxic`` from at most ``most`` labelled texts outside the held-out fold."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = training_labels(labels, "toxic", folds, fold, most)
    curve = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CURVE_FOLD)) == 0
    local = sample.withColumn("curve", curve).toPandas()  # at most `most` short rows
    rows = list(local.itertuples(index=False, name=None))
    chosen = spark.createDataFrame(rows, "doc_id long, label double, curve boolean")
    chosen = stage(labelled_texts(docs, chosen), "labelled")
    counts = gram_counts(docs, chosen.filter("NOT curve")).toPandas()
    table = ratio_table(
        counts["gram"].to_numpy(np.int64),
        counts["toxic"].to_numpy(np.float64),
        counts["ordinary"].to_numpy(np.float64),
    )
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            found = features(batch.column("text"), shared.value)
            at = np.arange(len(found) + 1) * FEATURES
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), tx.list_column(found.ravel(), at, pa.float64())],
                names=["label", "x"],
            )

    fitted = chosen.filter("curve").orderBy("doc_id").select("text", "label")
    fitted = fitted.mapInArrow(run, "label double, x array<double>").toPandas()
    if len(fitted):
        x, y = np.vstack(fitted["x"].to_list()), fitted["label"].to_numpy(np.float64)
    else:
        x, y = np.zeros((0, FEATURES)), np.zeros(0)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        weights = np.array([np.log(share / (1 - share)), *[0.0] * FEATURES])
        return ToxicityModel(table, weights, np.zeros(FEATURES), np.ones(FEATURES))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return ToxicityModel(table, _logistic((x - centre) / scale, y), centre, scale)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Only text gives the score. Null and empty texts are scored as texts without characters; a null
    doc_id is scored and not held out; repeated rows stay. Without labels of both kinds every score
    is the same.
    """
    model = train(docs, labels, folds, fold)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            score = pa.array(shared.value.score(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
