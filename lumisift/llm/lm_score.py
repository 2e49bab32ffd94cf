"""Cross-entropy difference between two matched n-gram models.

A target and a background model count the word bigrams of their documents. They have the same order, smoothing and
vocabulary, all words of both; the background's counts are weighted to the target's number of words, so the losses of
a token differ by what the models have seen alone. A bigram's probability leans on that of its word, by ``PRIOR``
counts, and a word's on all words being alike, by ``SMOOTH`` counts. A document is scored by models that have not
seen it: its own counts are taken off first, so documents of the target score like others of their kind. The lower
the mean difference over its tokens, the likelier a document is under the target. A background of more text has met
more bigrams and predicts all documents somewhat better, so scores are to be ranked or held against those of labelled
documents, not against zero.

A row per document and bigram would make the shuffles several times the text. So documents go to packs by a hash of
their content. A pack asks once for each bigram and word it has, with its own counts, in one array per bucket of
keys; a bucket sums up over packs and answers with the counts of the others that are not zero, by place, without the
keys. Models grow with the corpus; no task has more than a pack or a bucket, and a frequent bigram is one entry per
pack. A word stands for the context it makes as well: each document ends in one more event, so that words and
contexts are as many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lumisift.llm.shingles import mix, word_hashes
from lumisift.plans.scratch import materialize

SMOOTH = 0.1
PRIOR = 4.0

# Text in a pack, and text whose keys fill a bucket.
PACK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20

_START = np.uint64(1)
_CONTEXT = np.uint64(0xA0761D6478BD642F)
# The last bit of a key tells words from bigrams.
_BIT = np.uint64(1)

_ANSWER = ("pack bigint, bucket bigint, words bigint, all_target bigint, everything bigint, "
           "at binary, target binary, background binary, marked array<bigint>")

# Bits of a key that are sent; its bucket tells the first ones.
_KEY_BYTES = 6


def _bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as wide as the largest needs, after a byte that tells how wide."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) >> 8 * w == 0)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _short(keys: np.ndarray) -> bytes:
    """The last bytes of each key; in a bucket, a range of hashes, they tell keys apart."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view("<u8").ravel().astype(np.uint64)


class _Pack:
    """The tokens of some texts: ``keys`` of distinct bigrams, of distinct words, and of the start of a text."""

    def __init__(self, texts: pa.Array):
        words, at = word_hashes(texts)
        self.sizes = np.diff(at)
        self.first = at[:-1][self.sizes > 0]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.first] = _START
        grams, place = np.unique(mix(before * np.uint64(3) + words) & ~_BIT, return_inverse=True)
        self.grams = place.astype(np.int32)
        named, place = np.unique(mix(words ^ _CONTEXT) | _BIT, return_inverse=True)
        start = mix(np.array([_START]) ^ _CONTEXT) | _BIT
        self.keys = np.concatenate([grams, named, start])
        self.words = (place + len(grams)).astype(np.int32)
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[self.first] = len(self.keys) - 1
        self.documents = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """How often each key stands in the texts, each text counted ``weights`` times."""
        each = weights.astype(float)[self.documents]
        total = np.bincount(self.grams, each, len(self.keys)) + np.bincount(self.words, each, len(self.keys))
        total[-1] += weights[self.sizes > 0].sum()
        return total.astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token how often its bigram, word and context stand in its text."""

        def times(place: np.ndarray) -> np.ndarray:
            pairs = self.documents.astype(np.int64) * len(self.keys) + place
            _, pair, n = np.unique(pairs, return_inverse=True, return_counts=True)
            return n.astype(np.int32)[pair]

        words = times(self.words)
        contexts = np.empty_like(words)
        contexts[1:] = words[:-1]
        contexts[self.first] = 1
        return times(self.grams), words, contexts


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _weights(table: pa.Table, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often each document counts for the target, and for both."""
    copies = table["copies"].to_numpy()
    return copies * pc.is_in(table["doc_id"], value_set=marked).to_numpy(), copies


def _order(keys: np.ndarray, target: np.ndarray, every: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """In which order a pack asks for its keys, and where each bucket's begin.

    A bucket is a range of hashes. Within it equal counts stand together, so that they shrink to little when shuffled.
    """
    bucket = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    return np.lexsort((target, every, bucket)), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def asked(packs: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, pack, keys, target, n)``: the keys of each pack, with its own counts; a row per bucket, also without keys.

    ``packs(pack, doc_id, text, copies)``; ``targets(pack, doc_id)`` tells which of them make the target model.
    """

    def ask(docs: pa.Table, marked: pa.Table) -> pa.Table:
        pack = _Pack(_column(docs, "text"))
        target, every = (pack.counts(w) for w in _weights(docs, _column(marked, "doc_id")))
        order, at = _order(pack.keys, target, every, buckets)
        parts = [order[low:high] for low, high in zip(at, at[1:])]
        return pa.table({
            "bucket": pa.array(np.arange(buckets)), "pack": pa.array(np.full(buckets, docs["pack"][0].as_py(), np.int64)),
            "keys": pa.array([_short(pack.keys[p]) for p in parts], pa.binary()),
            "target": pa.array([_bytes(target[p]) for p in parts], pa.binary()),
            "n": pa.array([_bytes(every[p]) for p in parts], pa.binary())})

    return packs.groupBy("pack").cogroup(targets.groupBy("pack")).applyInArrow(
        ask, "bucket bigint, pack bigint, keys binary, target binary, n binary")


def answered(requests: DataFrame) -> DataFrame:
    """Per request the counts of other packs, ``target`` and ``background``, where ``at`` has a bit that they are not both zero.

    ``words`` is how many distinct ones the bucket has, ``all_target`` and ``everything`` how often they stand in the
    target's documents and in all. ``marked`` is null.
    """

    def answer(table: pa.Table) -> pa.Table:
        sizes = [len(k.as_py()) // _KEY_BYTES for k in table["keys"]]
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        keys, place = np.unique(np.concatenate([_long(k.as_py()) for k in table["keys"]]), return_inverse=True)
        place = place.astype(np.int32)
        target, every = (np.concatenate([_numbers(n.as_py()) for n in table[c]]) for c in ("target", "n"))
        is_word = (keys & _BIT).astype(bool)
        sums = [np.bincount(place, own, len(keys)).astype(np.int64) for own in (target, every)]
        facts = [int(is_word.sum()), *(int(total[is_word].sum()) for total in sums)]
        others = sums[0][place] - target
        rest = sums[1][place] - every - others
        there = (others + rest) > 0
        parts = list(zip(starts, starts[1:]))
        same = {name: pa.array(np.full(len(table), value)) for name, value in zip(("words", "all_target", "everything"), facts)}

        def sent(values: np.ndarray) -> pa.Array:
            return pa.array([_bytes(values[a:b][there[a:b]]) for a, b in parts], pa.binary())

        return pa.table({
            "pack": table["pack"], "bucket": table["bucket"], **same,
            "at": pa.array([np.packbits(there[a:b]).tobytes() for a, b in parts], pa.binary()), "target": sent(others),
            "background": sent(rest), "marked": pa.nulls(len(table), pa.list_(pa.int64()))})

    return requests.groupBy("bucket").applyInArrow(answer, _ANSWER)


def scored(
    packs: DataFrame, targets: DataFrame, answers: DataFrame, buckets: int, smooth: float, prior: float
) -> DataFrame:
    """``(doc_id, n_tokens, score)`` of the documents of each pack, from the answers to what it asked."""
    ids = targets.groupBy("pack").agg(F.collect_list("doc_id").alias("marked"))
    # A pack's targets are no more than its documents.
    told = answers.unionByName(ids, allowMissingColumns=True)

    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        pack = _Pack(_column(docs, "text"))
        weights = _weights(docs, pa.array(_flat(told, "marked"), pa.int64()))
        target, every = (pack.counts(w) for w in weights)
        order, begins = _order(pack.keys, target, every, buckets)
        told = told.filter(pc.is_valid(told["bucket"]))
        background = every - target
        for n, bucket in enumerate(told["bucket"].to_pylist()):
            part = order[begins[bucket]:begins[bucket + 1]]
            there = np.unpackbits(np.frombuffer(told["at"][n].as_py(), np.uint8), count=len(part)).astype(bool)
            target[part[there]] += _numbers(told["target"][n].as_py())
            background[part[there]] += _numbers(told["background"][n].as_py())
        vocabulary, all_target, everything = (pc.sum(told[c]).as_py() or 0 for c in ("words", "all_target", "everything"))
        rest = everything - all_target
        weight = all_target / rest if all_target and rest else 1.0
        own, length = pack.own(), pack.sizes + 1
        losses = np.zeros(len(pack.grams))
        for sign, seen, whole, scale, counted in (
            (-1, target, all_target, 1.0, weights[0]), (1, background, rest, weight, weights[1] - weights[0])
        ):
            mine = counted[pack.documents]
            gram, word, context = (
                scale * (seen[at] - mine * n) for at, n in zip((pack.grams, pack.words, pack.contexts), own))
            words = scale * (whole - (counted * length)[pack.documents])
            alone = (word + smooth) / (words + smooth * vocabulary)
            losses += sign * np.log((gram + prior * alone) / (context + prior))
        means = np.zeros(len(pack.sizes))
        some = pack.sizes > 0
        if some.any():
            means[some] = np.add.reduceat(losses, pack.first) / pack.sizes[some]
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": pa.array(pack.sizes, pa.int64()), "score": pa.array(means)})

    return packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(
        score, "doc_id bigint, n_tokens bigint, score double")


def score_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", smooth: float = SMOOTH,
                    prior: float = PRIOR) -> DataFrame:
    """``(doc_id, n_tokens, score)`` for every key and text of ``docs``.

    Documents whose key is in ``target(doc_id)`` make the target model, the others the background. ``score`` is the
    mean over the tokens of the target's loss less the background's, each without what this document itself adds to
    them. A null or empty text has no tokens and the score 0; texts are taken whole, however long. Rows with the same
    key and text are one document and come back once; for others the models count each of them. Other columns are
    not looked at. Without target documents, or with no others, the models still differ by nothing but the counts.
    """
    wanted = target.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    content = F.xxhash64("doc_id", "text")
    facts = chosen.groupBy(content.alias("content")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).agg(
        F.max("n").alias("copies"), F.sum("size").alias("size")).first()
    size = facts["size"] or 0
    # Repeated rows would all fall into one pack: they become one row first.
    if (facts["copies"] or 0) > 1:
        rows = materialize(chosen.groupBy("doc_id", "text").agg(F.count("*").alias("copies")), "lm-rows")
    else:
        rows = chosen.withColumn("copies", F.lit(1).cast("bigint"))
    packs = rows.withColumn("pack", F.pmod(content, F.lit(-(-size // PACK_BYTES) or 1).cast("bigint")))
    targets = materialize(packs.select("doc_id", "pack").distinct().join(wanted, "doc_id", "left_semi"), "lm-targets")
    buckets = -(-size // BUCKET_BYTES) or 1
    return scored(packs, targets, answered(asked(packs, targets, buckets)), buckets, smooth, prior)
