"""Line dedup: equal lines by their hash, nearly equal ones by a segment-partition edit join.

Lines are compared by their lower-cased words. Each distinct line of some length is cut into
``edits + 1`` segments, and indexed under each with its place and the line's length. If
another line is within ``edits`` edits, one segment stands in it unchanged, shifted by no
more than the edits before it: so a line probes the substrings at those places for its own
length and for each that is shorter by up to ``edits``. What meets is verified with a banded
bit-parallel edit distance.

A segment with a long list of lines is not joined pair by pair. Lists that overlap make
clusters, cut into blocks that tasks compare in memory, where counts of characters rule out
most pairs; a task puts out only lines to drop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumisift.llm.common import let, numbers_to
from lumisift.llm.components import in_blocks
from lumisift.llm.edit_distance import within
from lumisift.plans.scratch import materialize

# Longer lists are compared in blocks of so many lines.
LIST_ROWS = 32
BLOCK_LINES = 512

# A line's first place: document, hash of its text, number of the line.
_PLACE = ("doc", "text_hash", "pos")


@dataclass(frozen=True)
class LineRule:
    """Lines of fewer than ``shortest`` characters are near to no other: only equal ones count for them."""

    edits: int = 2
    shortest: int = 32

    def __post_init__(self) -> None:
        if self.shortest < self.edits * (self.edits + 2):
            raise ValueError("segments of the shortest lines must have at least as many characters as edits")


# Runs of blanks that are not a single space already.
_UNEVEN = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"


_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def normal_line(line: Column, blanks: str = _BLANK[1:]) -> Column:
    """Lower-cased words with a space between them; a look at the bytes spares most lines the expression.

    ``blanks`` other than the space may stand in it: each is a look at all its bytes.
    """
    uneven = reduce(Column.__or__, [line.contains(c) for c in ("  ", *blanks)])
    return F.trim(F.when(uneven, F.regexp_replace(F.lower(line), _UNEVEN, " ")).otherwise(F.lower(line)))


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(_BLANK)) != ""


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, pos, line)`` of every line with a word."""
    # Hashed and cut per document, before the lines are unfolded; blank lines go before the costly part.
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    # The outer form, as the plain one has Spark cut every text twice more to test for empty arrays.
    rows = rows.select("doc", "text_hash", F.posexplode_outer("lines").alias("pos", "line"))
    # A text cut at its line feeds has none left.
    return rows.where(has_word(F.col("line"))).withColumn("line", normal_line(F.col("line"), _BLANK[1:].replace("\n", "")))


def _ids(line: Column) -> list[Column]:
    """128 bits of a line."""
    return [F.xxhash64(line).alias("one"), F.xxhash64(F.lit(1), line).alias("two")]


def distinct_lines(found: DataFrame) -> DataFrame:
    """``(id, one, two, line, size, n, first)`` per distinct line, with the place where it stands first."""
    lines = found.select("line", F.struct(*_PLACE).alias("place"), *_ids(F.col("line")))
    grouped = lines.groupBy("one", "two").agg(
        F.first("line").alias("line"), F.count("*").alias("n"), F.min("place").alias("first"))
    return materialize(grouped.select(
        F.monotonically_increasing_id().alias("id"), "one", "two", "line", F.length("line").alias("size"), "n", "first"),
        "lines")


def _cut(size: Column, i: int, parts: int) -> Column:
    """Where segment ``i`` of a line of ``size`` characters begins, counted from 0."""
    return F.call_function("div", size * i, F.lit(parts)).cast("int")


def _piece(wide: Column, low: Column, length: Column) -> Column:
    """``length`` characters after the first ``low`` of a line in UTF-32, found without a walk through those before."""
    return F.substring(wide, low * 4 + 1, length * 4)


def index_keys(wide: Column, size: Column, edits: int) -> Column:
    """One key per segment of a line."""
    parts = edits + 1
    return F.array(*[
        F.xxhash64(size, F.lit(i), _piece(wide, _cut(size, i, parts), _cut(size, i + 1, parts) - _cut(size, i, parts)))
        for i in range(parts)])


def probe_keys(wide: Column, size: Column, edits: int, shorter: int) -> Column:
    """The keys under which a line finds lines that are shorter by ``shorter``.

    Segment i may be shifted by the edits that can precede it (i of them) while the rest can still be made up
    for behind it: to the left by i, to the right by i, and likewise seen from the end.
    """
    parts, other, keys = edits + 1, size - shorter, []
    for i in range(parts):
        low, length = _cut(other, i, parts), _cut(other, i + 1, parts) - _cut(other, i, parts)
        after = parts - 1 - i
        for shift in range(max(-i, shorter - after), min(i, shorter + after) + 1):
            keys.append(F.xxhash64(other, F.lit(i), _piece(wide, low + shift, length)))
    return F.array(*keys)


def _probes(lines: DataFrame, edits: int) -> DataFrame:
    """All probes of all lines, a scan per difference of length: code for all at once is too long for the JVM to compile."""
    each = [_exploded(lines, probe_keys(F.col("wide"), F.col("size"), edits, d)) for d in range(edits + 1)]
    return reduce(DataFrame.unionByName, each)


def _exploded(lines: DataFrame, keys: Column) -> DataFrame:
    wide = lines.select("id", "size", F.encode("line", "UTF-32").alias("wide"))
    return wide.select("id", "size", F.explode(keys).alias("key"))


def near_lines(lines: DataFrame, rule: LineRule) -> DataFrame:
    """``(id)`` of the distinct lines within ``rule.edits`` edits of a line that stands earlier."""
    if not rule.edits:
        return lines.select("id").limit(0)
    long = lines.where(F.col("size") >= rule.shortest)
    indexed = materialize(_exploded(long, index_keys(F.col("wide"), F.col("size"), rule.edits)), "segments")
    probes = _probes(long, rule.edits)
    hot = materialize(indexed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LIST_ROWS), "hot-segments")
    cold = indexed.join(hot.select("key"), "key", "left_anti").toDF("key", "a", "size_a")
    # A hot segment is one row without a line: it tells who is on its list, so one pass of probes does for both.
    lists = cold.unionByName(hot.select("key", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("int").alias("size_a")))
    other = (F.col("a") != F.col("id")) & ((F.col("size_a") < F.col("size")) | (F.col("a") < F.col("id")))
    met = probes.join(lists, "key").where(F.col("a").isNull() | other)
    met = met.select("a", F.col("id").alias("b"), F.when(F.col("a").isNull(), F.col("key")).alias("pair")).distinct()
    met = materialize(met, "line-pairs")
    pairs, listed = met.where("a IS NOT NULL").select("a", "b"), met.where("a IS NULL").select("pair", F.col("b").alias("rep"))
    return _verified(pairs, lines, rule).unionByName(_by_blocks(listed, lines, rule)).distinct()


def _verified(pairs: DataFrame, lines: DataFrame, rule: LineRule) -> DataFrame:
    """Of each pair that is near enough, the line that stands later."""
    text = lines.select("id", "line", "first")
    both = pairs.join(text.toDF("b", "lb", "fb"), "b").join(text.toDF("a", "la", "fa"), "a")
    later = F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = [within(x, y, rule.edits) is not None for x, y in zip(
                part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield part.select([0]).filter(pa.array(near, pa.bool_()))

    return both.select(later.alias("id"), "la", "lb").mapInArrow(batches, "id bigint")


def _by_blocks(listed: DataFrame, lines: DataFrame, rule: LineRule) -> DataFrame:
    """Lines of long lists that are near to an earlier one of the same cluster."""
    placed = materialize(in_blocks(listed, BLOCK_LINES), "line-blocks")
    text = lines.select(F.col("id").alias("rep"), "line", "size", *[F.col(f"first.{c}").alias(c) for c in _PLACE])
    rows = placed.join(text, "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": _later_lines(group, rule.edits)}, dtype="int64")

    return rows.groupBy("cluster", "low", "high").applyInPandas(compare, "id bigint")


def _later_lines(group: pd.DataFrame, edits: int) -> list[int]:
    """Lines of two blocks, or of one, with an earlier one near; each is compared until one is found."""
    # A null document stands before all others.
    group = group.sort_values(list(_PLACE), na_position="first", kind="stable")
    lines, sizes = group["line"].tolist(), group["size"].to_numpy()
    blocks, reps = group["block"].to_numpy(), group["rep"].to_numpy()
    within_one = group["low"].iloc[0] == group["high"].iloc[0]
    # An edit changes the counts of characters, by their code modulo 64, by two at most.
    counts = np.zeros((len(lines), 64), np.int32)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % 64
        counts[i] = np.bincount(codes, minlength=64)
    out = []
    for j in range(1, len(lines)):
        fits = (np.abs(sizes[:j] - sizes[j]) <= edits) & (within_one | (blocks[:j] != blocks[j]))
        earlier = np.flatnonzero(fits)
        earlier = earlier[np.abs(counts[earlier] - counts[j]).sum(axis=1) <= 2 * edits]
        if any(within(lines[i], lines[j], edits) is not None for i in earlier):
            out.append(int(reps[j]))
    return out


def dropped_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, pos, near)`` of the lines to drop; ``near`` tells those that are not just equal.

    Of equal lines the first stays, by document, hash of its text and line; a null document comes first. A distinct
    line near to one that stands earlier goes wherever it stands, also if that one goes too.
    """
    found = occurrences(docs, key, text)
    lines = distinct_lines(found)
    near = materialize(near_lines(lines, rule), "near-lines")
    marked = lines.join(near.withColumn("near", F.lit(True)), "id", "left").where("n > 1 OR near")
    marked = materialize(marked.select("one", "two", F.coalesce("near", F.lit(False)).alias("near"), "first"), "marked-lines")
    places = found.select(*_PLACE, *_ids(F.col("line")))
    same = F.struct(*_PLACE).eqNullSafe(F.col("first"))
    return places.join(marked, ["one", "two"]).where(F.col("near") | ~same).select(*_PLACE, "near")


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_lines, n_equal, n_near, text)`` for every row of ``docs``: its text without the lines dropped.

    Lines without a word always stay. Rows with the same key and text are one document and keep the same lines.
    ``n_lines`` counts lines with a word; a null text has none and stays null.
    """
    gone = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0)
    near, own = F.coalesce("near", F.lit(0)), F.col("row")[text]
    words = F.filter(F.split(own, "\n", -1), has_word)
    return _with_drops(docs.select(key, text), rule, key, text).select(
        F.col("row")[key].alias(key),
        F.when(own.isNull(), 0).otherwise(F.size(words)).cast("bigint").alias("n_lines"),
        (gone - near).cast("bigint").alias("n_equal"), near.cast("bigint").alias("n_near"), F.col("kept").alias(text))


def _with_drops(docs: DataFrame, rule: LineRule, key: str, text: str) -> DataFrame:
    """``(row, kept, gone, near)``: a row of ``docs`` as it was, its text without the lines dropped, those, and how many are near.

    The row is one value here, so that no name of its columns can clash.
    """
    drops = materialize(dropped_lines(docs, rule, key, text).groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_set("pos")).alias("gone"),
        F.count_distinct(F.when(F.col("near"), F.col("pos"))).alias("near")), "dropped-lines")
    rows, own = docs.select(F.struct("*").alias("row")), F.col("row")[text]
    same = F.col("row")[key].cast("bigint").eqNullSafe(F.col("doc")) & (F.xxhash64(own) == F.col("text_hash"))

    def without(lines: Column) -> Column:
        kept = F.array_except(numbers_to(F.size(lines)), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    rewritten = F.when(F.col("gone").isNull(), own).otherwise(let(F.split(own, "\n", -1), without))
    return rows.join(drops, same, "left").select("row", rewritten.alias("kept"), "gone", "near")


def without_repeated_lines(
    docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text", size: str = "n_chars"
) -> DataFrame:
    """``docs`` with all its columns, whatever their names, the text without the lines dropped and ``size`` to match.

    A document that had lines with words and has none left goes; one that had none stays as it is, and so does a null
    text. Texts of any length are cut into lines as a whole. An empty table gives an empty one.
    """
    rows = _with_drops(docs, rule, key, text)
    whole = F.col("gone").isNull()
    left = rows.where(whole | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))

    def column(name: str) -> Column:
        value = F.col("row")[name]
        if name == text:
            value = F.col("kept")
        elif name == size:
            value = F.when(whole, value).otherwise(F.length("kept")).cast(docs.schema[size].dataType)
        return value.alias(name)

    return left.select(*[column(name) for name in docs.columns])
