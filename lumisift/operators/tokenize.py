"""Byte-pair encoding with a given vocabulary and merge list.

A merge joins two neighbouring tokens, so it can cross the border between two
characters only if some rule has a left side ending in the first and a right side
starting with the second. Text is cut at all other borders; the pieces are encoded
one by one, and pieces that return, such as words, are encoded once per task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lumisift.plans.size import spread

# Fixed values of the encoding.
WORD_MARK = "▁"
PAD_TOKEN, UNK_TOKEN = "<pad>", "<unk>"
PAD_DEFAULT, UNK_DEFAULT = 0, 3
MAX_TOKENS = 64

# A vocabulary or merge list is a model parameter that every task holds.
TABLE_ROWS = 4_000_000
_REMEMBERED = 200_000


def resolve_merges(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """``merges(rank, left, right)`` as ``(left_id, right_id, rank, merged_id)``.

    Rules with a side outside ``vocab(token, id)`` are dropped; of equal pairs the
    later wins. ``merged_id`` is null where the merged token is not in the vocabulary.
    """
    left = vocab.select(F.col("token").alias("left"), F.col("id").alias("left_id"))
    right = vocab.select(F.col("token").alias("right"), F.col("id").alias("right_id"))
    whole = vocab.select(F.col("token").alias("_whole"), F.col("id").alias("merged_id"))
    rules = (
        merges.join(left, "left").join(right, "right")
        .groupBy("left", "right", "left_id", "right_id").agg(F.max("rank").alias("rank"))
        .withColumn("_whole", F.concat("left", "right"))
    )
    return rules.join(whole, "_whole", "left").select("left_id", "right_id", "rank", "merged_id")


@dataclass
class Encoder:
    """The tables of one tokenizer, held by each task."""

    chars: dict[str, int]
    rules: dict[tuple[int, int], tuple[int, int]]
    crossings: np.ndarray | None
    pad: int
    unk: int
    seen: dict[str, list[int]] = field(default_factory=dict)

    def tables(self) -> tuple:
        """What another encoder is made of."""
        return self.chars, self.rules, self.crossings, self.pad, self.unk

    def pieces(self, text: str) -> Iterator[str]:
        """Cut ``text`` wherever no rule can join the neighbours."""
        if self.crossings is None:
            yield text
            return
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        joined = (codes[:-1] << 21) | codes[1:]
        cuts = np.flatnonzero(~np.isin(joined, self.crossings)) + 1
        start = 0
        for cut in cuts.tolist():
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        text = text.replace(" ", WORD_MARK)
        out: list[int] = []
        if not text:
            return out
        for piece in self.pieces(text):
            ids = self.seen.get(piece)
            if ids is None:
                ids = self.merge([self.chars.get(c, self.unk) for c in piece])
                if len(self.seen) < _REMEMBERED:
                    self.seen[piece] = ids
            out += ids
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until no rule applies."""
        size = len(ids)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < size:
                pair = (ids[at], ids[after[at]])
                rule = self.rules.get(pair)
                if rule is not None:
                    heapq.heappush(waiting, (rule[0], at, *pair))

        for at in range(size - 1):
            offer(at)
        while waiting:
            _, at, left, right = heapq.heappop(waiting)
            other = after[at]
            if ids[at] != left or other >= size or ids[other] != right:
                continue
            ids[at], ids[other] = self.rules[left, right][1], -1
            after[at] = after[other]
            if after[at] < size:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [i for i in ids if i >= 0]


def _bounded(df: DataFrame, what: str) -> pd.DataFrame:
    rows = df.limit(TABLE_ROWS + 1).toPandas()
    if len(rows) > TABLE_ROWS:
        raise ValueError(f"more than {TABLE_ROWS} rows in the {what}")
    return rows


def load_encoder(vocab: DataFrame, rules: DataFrame) -> Encoder:
    """Collect ``vocab(token, id)`` and resolved merges into the form that tasks use."""
    tokens = _bounded(vocab.select("token", "id"), "vocabulary")
    ids = dict(zip(tokens["token"], tokens["id"].astype(int).tolist()))
    text = {i: t for t, i in ids.items()}
    pad, unk = ids.get(PAD_TOKEN, PAD_DEFAULT), ids.get(UNK_TOKEN, UNK_DEFAULT)
    chars = {t: i for t, i in ids.items() if len(t) == 1}
    table: dict[tuple[int, int], tuple[int, int]] = {}
    crossings: set[int] = set()
    # A rule on the unknown token can join anything: then no border is safe.
    borders = len(text) == len(ids)
    columns = ["left_id", "right_id", "rank", "merged_id"]
    for left, right, rank, merged in _bounded(rules.select(*columns), "merge list").itertuples(index=False):
        left, right = int(left), int(right)
        table[left, right] = (int(rank), unk if pd.isna(merged) else int(merged))
        borders = borders and unk not in (left, right) and bool(text[left]) and bool(text[right])
        if borders:
            crossings.add((ord(text[left][-1]) << 21) | ord(text[right][0]))
    known = np.array(sorted(crossings), dtype=np.int64) if borders else None
    return Encoder(chars, table, known, pad, unk)


def bpe_encode(
    df: DataFrame,
    col: str,
    vocab: DataFrame,
    rules: DataFrame,
    max_len: int = MAX_TOKENS,
    out: str = "token_ids",
) -> DataFrame:
    """Add the token ids of ``col``, cut or right-padded to ``max_len``.

    The whole text is merged before the ids are cut.
    """
    tables = load_encoder(vocab, rules).tables()
    shared = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(*shared.value)
        for series in texts:
            yield series.map(lambda text: _fit(encoder.encode(text or ""), max_len, encoder.pad))

    # Not to be run again for a later filter on the ids.
    return spread(df).withColumn(out, encode.asNondeterministic()(F.col(col)))


def _fit(ids: list[int], length: int, pad: int) -> list[int]:
    return ids[:length] + [pad] * (length - len(ids))
