"""A quality classifier: naive Bayes log-count ratios with a linear support vector machine.

A text becomes indicators of two kinds. Its shape: trigrams of character classes (small and
capital letters, digits, blanks, and each punctuation mark by itself), each at three levels of
how frequent it is in the text, how often a word equals one of the eight in front of it, and
how many passages of four words stood earlier. Its wording: one and two words and two to four
characters in a row, lower-cased, hashed to 2^20 numbers. The log ratio of an indicator's
counts in the two classes, over all labelled rows, scales it; a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent, each kind with a norm of 1. A
sigmoid turns its margin into a score. Only the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumisift.llm.shingles import chain, mix, word_hashes
from lumisift.plans.scratch import materialize

# At most so many labelled rows, those with the smallest hashes of their ids, are what the
# linear model is fitted to. The counts behind the ratios cover all labelled rows.
FIT_ROWS = 8_000
# And at most so many indicators of them all together, in the order of those hashes.
FIT_INDICATORS = 40_000_000
THRESHOLD = 0.3
# Labels of two numbers each that are broadcast, 32 MB of them.
BROADCAST_LABELS = 2_000_000

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[list(_MARKS)] = np.arange(5, 5 + len(_MARKS))
_KINDS = 5 + len(_MARKS)
_GRAMS = _KINDS**3

# Shares of a text's trigrams (and of its words) from which an indicator of the next level holds.
_LEVELS = (0.0, 0.01, 0.05)
_REPEATS = _GRAMS * len(_LEVELS)
_LAGS = 8
_REPEAT_LEVELS = (0.02, 0.1, 0.3, 0.6)
# Passages of so many words are compared with all earlier ones, at any distance.
_PASSAGE = 4
_PASSAGES = _REPEATS + _LAGS * len(_REPEAT_LEVELS)
SHAPES = _PASSAGES + len(_REPEAT_LEVELS)

_WORD_GRAMS = (1, 2)
_CHAR_GRAMS = (2, 3, 4)
_HASH_BITS = 20
FEATURES = SHAPES + (1 << _HASH_BITS)

# Items hashed at a time, and bytes of text whose indicators are held at a time.
_CHUNK = 1 << 19
SLICE_BYTES = 1 << 20

# An indicator that holds: the text's number, then the indicator's.
_Held = tuple[np.ndarray, np.ndarray]


def _runs(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose runs of ``size`` start in one chunk each."""
    for low in range(0, length - size + 1, _CHUNK):
        yield low, min(low + _CHUNK + size - 1, length)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct numbers and how often each stands there; sorting is much faster here than hashing."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def _at_levels(texts: np.ndarray, shares: np.ndarray, levels: tuple[float, ...], first: int) -> list[_Held]:
    return [(texts[shares > least], np.full(np.count_nonzero(shares > least), first + i)) for i, least in enumerate(levels)]


def shape_features(raw: np.ndarray, of: np.ndarray, sizes: np.ndarray, words: np.ndarray, word_of: np.ndarray, counts: np.ndarray) -> list[_Held]:
    """Shape indicators of texts, given as bytes and hashes of words, the text each is of, and how many each text has."""
    grams = [np.empty(0, np.int64)]
    kinds = _CLASS[raw]
    for low, high in _runs(3, len(raw)):
        part, text = kinds[low:high], of[low:high]
        inside = text[2:] == text[:-2]
        grams.append((text[:-2] * _GRAMS + part[:-2] * _KINDS**2 + part[1:-1] * _KINDS + part[2:])[inside])
    found, times = _distinct(np.concatenate(grams))
    text, gram = np.divmod(found, _GRAMS)
    share = times / (sizes[text] - 2)
    held = [(text[share >= least], gram[share >= least] * len(_LEVELS) + i) for i, least in enumerate(_LEVELS)]
    for lag in range(1, _LAGS + 1):
        equal = (words[lag:] == words[:-lag]) & (word_of[lag:] == word_of[:-lag])
        text = np.flatnonzero(counts > lag)
        share = np.bincount(word_of[lag:][equal], minlength=len(counts))[text] / (counts[text] - lag)
        held += _at_levels(text, share, _REPEAT_LEVELS, _REPEATS + (lag - 1) * len(_REPEAT_LEVELS))
    if len(words) > _PASSAGE:
        inside = word_of[_PASSAGE - 1:] == word_of[:len(words) - _PASSAGE + 1]
        start = word_of[:len(words) - _PASSAGE + 1][inside]
        _, one = np.unique(chain(words, _PASSAGE)[inside] ^ mix(start.astype(np.uint64) + np.uint64(1)), return_index=True)
        text = np.flatnonzero(counts > _PASSAGE)
        share = 1 - np.bincount(start[one], minlength=len(counts))[text] / (counts[text] - _PASSAGE + 1)
        held += _at_levels(text, share, _REPEAT_LEVELS, _PASSAGES)
    return held


def wording_features(kind: int, items: np.ndarray, of: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Wording indicators of texts, given as items and the text each is of; as one number with the text's in front."""
    found = []
    for size in lengths:
        salt = np.uint64(64 * kind + size)
        for low, high in _runs(size, len(items)):
            text = of[low:high]
            inside = text[size - 1:] == text[:high - low - size + 1]
            hashed = mix(chain(items[low:high].astype(np.uint64), size) + salt) >> np.uint64(64 - _HASH_BITS)
            found.append(_distinct(((text[:high - low - size + 1].astype(np.uint64) << np.uint64(_HASH_BITS)) | hashed)[inside])[0])
    return found


def batch_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indicators of all texts one after the other, and how many each has."""
    number = np.arange(len(texts))
    words, at = word_hashes(texts, fold=False)
    folded, _ = word_hashes(texts)
    counts = np.diff(at)
    word_of = np.repeat(number, counts)
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(whole).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(whole.to_pylist()), np.uint8)
    held = shape_features(raw, np.repeat(number, sizes), sizes, words, word_of, counts)
    letters = [(text or "").lower() for text in texts.to_pylist()]
    codes = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter_of = np.repeat(number, [len(text) for text in letters])
    wording = wording_features(0, folded, word_of, _WORD_GRAMS) + wording_features(1, codes, letter_of, _CHAR_GRAMS)
    if wording:
        found, _ = _distinct(np.concatenate(wording))
        held.append(((found >> np.uint64(_HASH_BITS)).astype(np.int64), (found & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64) + SHAPES))
    text, indicator = (np.concatenate(column) for column in zip(*held))
    order = np.argsort(text, kind="stable")
    return indicator[order].astype(np.int32), np.bincount(text, minlength=len(texts)).astype(np.int64)


def slices(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``SLICE_BYTES`` of text at a time."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield part.slice(low, high - low)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the column ``features`` in place of its text; a null or empty text has none."""
    chosen = docs.select(F.col(text).alias("text"), F.col(key).cast("bigint").alias("doc_id"), *[c for c in docs.columns if c not in (key, text)])
    schema = T.StructType([*chosen.schema.fields[1:], T.StructField("features", T.ArrayType(T.IntegerType()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in slices(part, 0):
                flat, lengths = batch_features(rows.column(0))
                sizes = np.concatenate([[0], np.cumsum(lengths)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], lists], schema.names)

    return chosen.mapInArrow(batches, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept out of all learning; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per class how many rows of ``labelled(text, quality)`` have each indicator, and how many rows there are.

    Tasks add up their rows first, so what is shuffled and collected has a size set by the number of
    indicators, not of rows.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES + 1), np.int64)
        for part in parts:
            for rows in slices(part, 0):
                quality = rows.column(1).to_numpy(zero_copy_only=False)
                flat, lengths = batch_features(rows.column(0))
                of = np.repeat(quality, lengths)
                for label in (0, 1):
                    counts[label, :-1] += np.bincount(flat[of == label], minlength=FEATURES)
                    counts[label, -1] += np.count_nonzero(quality == label)
        label, feature = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(feature), pa.array(counts[label, feature])], ["label", "feature", "n"])

    parts = labelled.select("text", "quality").mapInArrow(batches, "label bigint, feature bigint, n bigint")
    summed = parts.groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, FEATURES + 1), np.int64)
    counts[summed["label"].to_numpy(), summed["feature"].to_numpy()] = summed["n"].to_numpy()
    return counts[:, :-1], counts[:, -1]


def log_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of how much likelier each indicator is in class 1, each class's counts as shares of their sum."""
    good, bad = counts[1] + smooth, counts[0] + smooth
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def ratios(counts: np.ndarray, totals: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratios of all indicators. Those of the wording are mostly rare: there the classes share ``smooth`` rows by
    their sizes, so an indicator that no row has is 0 and one that few have is little from it."""
    added = smooth * np.maximum(totals, 1) / max(totals.sum(), 1)
    good, bad = ((counts[i, SHAPES:] + added[i]) / (max(totals[i], 1) + added[i]) for i in (1, 0))
    return np.concatenate([log_ratios(counts[:, :SHAPES]), np.where(counts[:, SHAPES:].any(axis=0), np.log(good / bad), 0.0)])


def row_values(row: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What a row has at its indicators: their scale, each kind divided by its norm."""
    values = scale[row]
    shape = row < SHAPES
    for kind in (shape, ~shape):
        values[kind] /= max(np.sqrt(np.sum(values[kind] ** 2)), 1e-9)
    return values


def fit_hinge(
    rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss, by dual coordinate descent.

    Row ``i`` has its :func:`row_values`, and 1 for the bias; ``signs`` are 1 and -1. One dual variable, between 0
    and ``cost``, is optimised at a time.
    """
    values = [row_values(r, scale).astype(np.float32) for r in rows]
    norms = np.array([np.sum(v**2, dtype=float) + 1.0 for v in values])
    weights, bias, dual = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        moved = 0.0
        for i in order:
            slope = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(dual[i] - slope / norms[i], 0.0), cost)
            step = (new - dual[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of a sigmoid from margin to probability, by Newton steps on smoothed targets."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    design = np.column_stack([margins, np.ones(len(margins))])
    at = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -35, 35)))
        slope = design.T @ (p - target) + 1e-3 * (at - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


@dataclass(frozen=True)
class QualityModel:
    """``weights`` has a number per indicator: the linear model's, times the log ratio."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Margins of rows whose indicators stand one after the other in ``flat``."""
        ends, scale = np.cumsum(lengths), self.scale[flat]
        dots, shape, total = self.weights[flat] * scale, flat < SHAPES, self.bias
        for kind in (shape, ~shape):
            sums = [np.concatenate([[0.0], np.cumsum(np.where(kind, v, 0.0))]) for v in (dots, scale**2)]
            of, squares = (s[ends] - s[ends - lengths] for s in sums)
            total = total + of / np.sqrt(np.maximum(squares, 1e-18))
        return total

    def scores(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, lengths) + self.shift, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit to the rows of ``docs`` that ``labels(doc_id, quality)`` marks and are not held out.

    A document with labels of both kinds, or none, is not learnt from. Without any the model scores all alike.
    """
    clear = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").cast("bigint").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    clear = materialize(clear.where(~held_out()), "quality-labels")
    # Counted: so few labels go to the texts. More of them, and the labelled texts are shuffled.
    if clear.count() <= BROADCAST_LABELS:
        clear = F.broadcast(clear)
    wanted = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(~held_out())
    # Stored as text: its indicators take several times the room.
    known = materialize(wanted.join(clear, "doc_id"), "quality-known")
    counts, totals = class_counts(known)
    scale = ratios(counts, totals)
    found, quality = _sample(known, rows)
    if not totals.all() or len(set(quality.tolist())) < 2:
        share = (totals[1] + 1) / (totals.sum() + 2)
        return QualityModel(scale, np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    # The last fifth is for the sigmoid, whose margins must not come from rows the model was fitted to.
    cut = max(1, len(found) * 4 // 5)
    weights, bias = fit_hinge(found[:cut], np.where(quality[:cut] == 1, 1.0, -1.0), scale)
    model = QualityModel(scale, weights, bias, 1.0, 0.0)
    rest = found[cut:] or found
    margins = np.concatenate([model.margins(f, np.array([len(f)])) for f in rest])
    slope, shift = fit_sigmoid(margins, quality[cut:] if found[cut:] else quality)
    return QualityModel(scale, weights, bias, slope, shift)


def _sample(known: DataFrame, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of the rows with the smallest hashes of their ids, in that order."""
    placed = known.select(F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id").alias("place"), "text", "quality")
    last = placed.select("place").orderBy("place").limit(rows).agg(F.max("place").alias("place")).first()["place"]
    if last is None:
        return [], np.empty(0, np.int64)
    # Only the places go through one task; the texts stay where they lie.
    chosen = placed.where(F.col("place") <= F.struct(F.lit(last["hash"]), F.lit(last["doc_id"]).cast("bigint")))
    stored = materialize(features(chosen.select("place.hash", "place.doc_id", "text", "quality")), "quality-sample")
    sizes = stored.select("hash", "doc_id", F.size("features").alias("n")).toArrow().combine_chunks()
    order = np.lexsort([sizes["doc_id"].to_numpy(), sizes["hash"].to_numpy()])
    fitting = max(1, int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()[order]), FIT_INDICATORS, side="right")))
    if fitting < len(order):
        end = order[fitting - 1]
        place = F.struct(F.lit(sizes["hash"][end].as_py()), F.lit(sizes["doc_id"][end].as_py()).cast("bigint"))
        stored = stored.where(F.struct("hash", "doc_id") <= place)
    sample = stored.toArrow().combine_chunks()
    order = np.lexsort([sample["doc_id"].to_numpy(), sample["hash"].to_numpy()])[:rows]
    lists = pa.concat_arrays(sample["features"].chunks)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    found = [flat[at[i]:at[i + 1]] for i in order]
    return found, sample["quality"].to_numpy()[order]


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, repeated ones too.

    ``score`` is the probability of label 1, ``predicted`` 1 from 0.3 on. A null or empty text has no
    indicators and the score of the bias alone.
    """
    model = train(docs, labels, rows, key, text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part, 1):
                scores = model.scores(*batch_features(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores)], ["doc_id", "score"])

    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scored = chosen.mapInArrow(batches, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that a model learnt from ``labels`` predicts to be good."""
    model = train(docs, labels, rows, key, text)
    place = docs.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part, place):
                yield some.filter(pa.array(model.scores(*batch_features(some.column(place))) >= THRESHOLD))

    return docs.mapInArrow(batches, docs.schema)
