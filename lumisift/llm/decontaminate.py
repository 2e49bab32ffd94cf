"""Benchmark decontamination by pigeonhole edit matching.

A test item that stands in a document with at most k edits, cut into k + 1 pieces, has a
piece without any. All pieces of the items are found by one automaton over each document;
around every hit the whole item is searched with Myers' bit-parallel distance. Short items
are one piece, which must stand between word borders. The items
are the query set: they go to the tasks in blocks of bounded size, one scan of the
documents per block.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumisift.llm.edit_distance import search
from lumisift.plans.scratch import materialize

BLOCK_BYTES = 4 * 1024 * 1024

# Letters, digits and all beyond ASCII; what stands between, and case, does not count.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Scripts written without blanks: Thai and Lao, Tibetan, Burmese, Khmer, kana, Chinese characters and what goes with them.
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


@dataclass(frozen=True)
class Matching:
    """Up to ``edits`` edits per character of an item; those of fewer than ``shortest`` characters must stand there
    unchanged, between word borders."""

    edits: float = 0.06
    shortest: int = 24


def normal(text: str | None) -> str:
    """The lower-cased words of a text, one blank between them."""
    return " ".join(_WORD.findall((text or "").translate(_LOWER)))


def has_words(item: str, wanted: Matching) -> bool:
    """Whether a normalised item can be searched; a short one without a letter or digit would stand anywhere."""
    return len(item) >= wanted.shortest > 0 or any(c.isalnum() for c in item)


def _border(inside: str, outside: str) -> bool:
    """Whether a word may begin or end between two characters that stand side by side; ``outside`` is empty at an end."""
    return not outside or any(unicodedata.category(c)[0] not in "LNM" or _UNSPACED.match(c) for c in (inside, outside))


def pieces(pattern: str, count: int) -> list[tuple[int, str]]:
    """``pattern`` in ``count`` parts of about equal length, with their offsets."""
    cuts = [len(pattern) * i // count for i in range(count + 1)]
    return [(low, pattern[low:high]) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]


class Searcher:
    """Finds normalised items in normalised texts."""

    def __init__(self, items: Sequence[str], wanted: Matching) -> None:
        self.items = list(dict.fromkeys(items))
        self.short = [len(p) < wanted.shortest for p in self.items]
        self.limits = [0 if s else math.floor(len(p) * wanted.edits) for p, s in zip(self.items, self.short, strict=True)]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (item, limit) in enumerate(zip(self.items, self.limits, strict=True)):
            for offset, piece in pieces(item, limit + 1):
                found.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int] | None] = {}

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item in ``text`` its ``(distance, end)``, the closest and then the first."""
        best: dict[int, tuple[int, int]] = {}
        if not self.items:
            return best
        done: set[tuple[int, int]] = set()
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                start = last - length + 1 - offset
                item, limit = self.items[number], self.limits[number]
                if self.short[number]:
                    end = last + 1
                    if number not in best and _border(item[0], text[start - 1:start]) and _border(item[-1], text[end:end + 1]):
                        best[number] = 0, end
                    continue
                # Hits of one match differ in where they say it starts by no more than the edits.
                place = (number, start // (limit + 1))
                if place in done:
                    continue
                done.add(place)
                low = max(0, place[1] * (limit + 1) - limit)
                window = text[low:place[1] * (limit + 1) + len(item) + 2 * limit + 1]
                near = self._search(number, item, window, limit)
                if near is not None:
                    near = (near[0], low + near[1])
                    if number not in best or near < best[number]:
                        best[number] = near
        return best

    def _search(self, number: int, item: str, window: str, limit: int) -> tuple[int, int] | None:
        """:func:`search`, remembered for the windows that came last: common passages have the same one."""
        at = window.find(item)
        if at >= 0:
            return 0, at + len(item)
        key = (number, window)
        if key not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[key] = search(item, window, limit)
        return self.known[key]


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, list[int]]]]:
    """Items by text, each with its ids, in blocks of about ``BLOCK_BYTES``, one at a time in the driver."""
    stored = materialize(items.groupBy("item").agg(F.collect_set("item_id").alias("ids")), "benchmark-items")
    total = stored.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for block in range(count):
        rows = stored.where(F.pmod(F.xxhash64("item"), F.lit(count)) == block)
        yield [(row["item"], sorted(row["ids"])) for row in rows.toLocalIterator()]


def _normalised(benchmark: DataFrame, wanted: Matching) -> DataFrame:
    """``(item_id, text, item, searchable)`` of all rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = [normal(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(words, pa.string()), pa.array([has_words(w, wanted) for w in words], pa.bool_())],
                ["item_id", "text", "item", "searchable"])

    chosen = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return chosen.mapInArrow(batches, "item_id bigint, text string, item string, searchable boolean")


def unsearchable_items(benchmark: DataFrame, wanted: Matching = Matching()) -> DataFrame:
    """``(item_id, text)`` of the items that :func:`find_benchmark` cannot search: without words, or with a null id."""
    return _normalised(benchmark, wanted).where("item_id IS NULL OR NOT searchable").select("item_id", "text")


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, wanted: Matching = Matching(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, distance, end)`` for each document and test item that stands in it.

    Both are compared by their words alone: lower case, one blank between. ``distance`` counts edits, ``end`` is the
    position after the match in those words. An item in a document several times has its closest match, the first
    of equals. Null texts have no words; :func:`unsearchable_items` are left out; a repeated document has its rows
    again, a repeated item does not. Other columns are not looked at.
    """
    items = _normalised(benchmark, wanted).where("item_id IS NOT NULL AND searchable").select("item_id", "item")
    chosen = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, item_id bigint, distance bigint, end bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        found = found.unionByName(chosen.mapInArrow(_scan(block, wanted), schema))
    return found


def _scan(block: list[tuple[str, list[int]]], wanted: Matching):
    texts, ids = [t for t, _ in block], [i for _, i in block]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(texts, wanted)
        for part in parts:
            rows = [
                (doc, item, distance, end)
                for doc, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                for number, (distance, end) in sorted(searcher.find(normal(content)).items())
                for item in ids[number]
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end"])

    return batches


def clean_documents(docs: DataFrame, benchmark: DataFrame, wanted: Matching = Matching()) -> DataFrame:
    """The rows of ``docs`` in which no test item stands; a row with a null id is kept."""
    dirty = materialize(find_benchmark(docs, benchmark, wanted).select("doc_id").distinct(), "contaminated")
    dirty = dirty.select(F.col("doc_id").alias("__dirty"))
    return docs.join(dirty, F.col("doc_id").cast("bigint") == F.col("__dirty"), "left_anti")
