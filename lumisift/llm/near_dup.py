"""Near-duplicate documents through an inverted index of MinHash signatures.

A document is posted under every pair of a signature coordinate and its value. Two
documents of the wanted similarity agree in at least ``matches`` of all coordinates, but
for a chance of about one in a million. Ordered from the rarest pair to the most
frequent, they must then meet within the first ``coordinates - matches + 1`` pairs of
both, so only these are posted, and of them only pairs that occur twice. Passages that
many documents share are frequent and fall behind that prefix.

Lists are merged in two rounds. First each document is compared with one hub only, the
smallest document of its lists that it meets most often. Then the lists are merged
again, skipping all pairs whose documents are connected already: short lists pair by pair,
long ones as clusters, cut into blocks whose pairs a task compares in memory; it puts out
only links between what it hasn't connected yet. Every link is confirmed on the full
shingle sets. Copies with the same set are one class and never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumisift.llm.components import components, in_blocks
from lumisift.llm.shingles import fingerprint, overlap, shingle_sets
from lumisift.plans.scratch import materialize

_ROWS = 2048

# Longer lists are compared in blocks of so many documents.
LIST_ROWS = 48
BLOCK_DOCS = 512


@dataclass(frozen=True)
class Similarity:
    """Linked are sets with ``100 * intersection >= percent * union``; see the module on the rest."""

    words: int = 5
    percent: int = 75
    coordinates: int = 128
    matches: int = 72
    seed: int = 1

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


def signature(hashes: np.ndarray, wanted: Similarity) -> np.ndarray:
    """The smallest value of each coordinate's permutation of the set, its upper 32 bits."""
    random = np.random.Generator(np.random.PCG64(wanted.seed))
    flips = random.integers(0, 2**64, wanted.coordinates, dtype=np.uint64)
    factors = random.integers(0, 2**63, wanted.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(wanted.coordinates, np.uint64(2**64 - 1))
    for low in range(0, len(hashes), _ROWS):
        part = (hashes[low:low + _ROWS, None] ^ flips) * factors
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, wanted: Similarity, key: str, text: str) -> DataFrame:
    """``(doc, n_shingles, one, two, signature)``: set size, 128 bits of the set, and its signature."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, ones, twos, signs = [], [], [], []
            for hashes in shingle_sets(part.column(1), wanted.words):
                sizes.append(len(hashes))
                one, two = fingerprint(hashes)
                ones.append(one)
                twos.append(two)
                signs.append(signature(hashes, wanted) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()),
                 pa.array(twos, pa.int64()), pa.array(signs, pa.list_(pa.int32()))],
                ["doc", "n_shingles", "one", "two", "signature"])

    chosen = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return chosen.mapInArrow(batches, "doc bigint, n_shingles bigint, one bigint, two bigint, signature array<int>")


def postings(classes: DataFrame, wanted: Similarity) -> DataFrame:
    """``(pair, rep)`` for the prefix of each class in the order of how often a pair occurs."""
    posted = materialize(classes.select("rep", F.posexplode("signature").alias("c", "v")).select(
        "rep", (F.shiftleft(F.col("c").cast("bigint"), 32) + (F.col("v").cast("bigint") + F.lit(2**31))).alias("pair")),
        "postings")
    shared = materialize(posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    # A class has `coordinates` pairs, so its list is bounded; pairs of its own come first in the order.
    ordered = posted.join(shared, "pair").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("pairs"))
    left = F.lit(wanted.prefix) - (F.lit(wanted.coordinates) - F.size("pairs"))
    prefix = ordered.where(left > 0).select("rep", F.explode(F.slice("pairs", F.lit(1), left)).alias("p"))
    return materialize(prefix.select("p.pair", "rep"), "prefixes")


def agreeing(pairs: DataFrame, classes: DataFrame, wanted: Similarity) -> DataFrame:
    """The ``pairs`` ``(a, b)`` that agree in enough coordinates of their signatures."""
    signs = classes.select("rep", "signature")
    both = pairs.join(signs.toDF("b", "sb"), "b").join(signs.toDF("a", "sa"), "a")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return both.where(equal >= wanted.matches).select("a", "b")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, wanted: Similarity, key: str, text: str) -> DataFrame:
    """The ``pairs`` whose full sets are similar enough, as ``(u, v)``.

    A text counts for its class only if its set is that of the class, as a key may repeat with other texts.
    """
    facts = classes.select("rep", "one")
    asked = pairs.join(facts.toDF("a", "a1"), "a").join(facts.toDF("b", "b1"), "b")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"))
    asked = asked.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, ones = part.column(0).to_pylist(), part.column(2).to_pylist()
            held: tuple | None = None
            kept = []
            for i in range(part.num_rows):
                # The join leaves the rows of a hub together: its set is made once.
                if held is None or held[0] != (ids[i], ones[i]):
                    held = (ids[i], ones[i]), next(iter(shingle_sets(part.column(4).slice(i, 1), wanted.words)))
                left = held[1]
                right = next(iter(shingle_sets(part.column(5).slice(i, 1), wanted.words)))
                common = overlap(left, right)
                similar = 100 * common >= wanted.percent * (len(left) + len(right) - common)
                kept.append(similar and fingerprint(right)[0] == part.column(3)[i].as_py()
                            and fingerprint(left)[0] == ones[i])
            yield part.select([0, 1]).filter(pa.array(kept, pa.bool_())).rename_columns(["u", "v"])

    return asked.select("a", "b", "a1", "b1", "ta", "tb").mapInArrow(batches, "u bigint, v bigint")


def hub_pairs(prefixes: DataFrame) -> DataFrame:
    """``(a, b)``: for each class the hub that most of its lists have."""
    hubs = materialize(prefixes.groupBy("pair").agg(F.min("rep").alias("hub")), "hubs")
    met = prefixes.join(hubs, "pair").where("hub < rep").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(F.min(F.struct((-F.col("n")).alias("n"), "hub")).alias("best"))
    return best.select(F.col("best.hub").alias("a"), F.col("rep").alias("b"))


def open_lists(prefixes: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``(pair, rep, label, n_shingles, n)`` of the lists with more than one component; ``n`` is the list's length."""
    facts = classes.select("rep", "n_shingles").join(labels.toDF("rep", "label"), "rep", "left")
    known = materialize(facts.select("rep", F.coalesce("label", "rep").alias("label"), "n_shingles"), "labels")
    listed = materialize(prefixes.join(known, "rep"), "labelled")
    mixed = materialize(listed.groupBy("pair").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y").select("pair", "n"), "mixed")
    return materialize(listed.join(mixed, "pair"), "open")


def open_pairs(lists: DataFrame, wanted: Similarity) -> DataFrame:
    """Pairs ``(a, b)`` that meet in a short list, with other components and sizes that allow a link."""
    rest = lists.where(F.col("n") <= LIST_ROWS).drop("n")
    left = rest.toDF(*[f"{c}_a" for c in rest.columns])
    right = rest.toDF(*[f"{c}_b" for c in rest.columns])
    least, most = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    met = left.join(right, (F.col("pair_a") == F.col("pair_b")) & (F.col("rep_a") < F.col("rep_b"))
                    & (F.col("label_a") != F.col("label_b")) & (100 * least >= wanted.percent * most))
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def block_links(
    lists: DataFrame, classes: DataFrame, docs: DataFrame, wanted: Similarity, key: str, text: str
) -> DataFrame:
    """Links ``(u, v)`` among the documents of long lists, enough to connect all that are linked.

    Lists that overlap make a cluster. A cluster is cut into blocks by a hash, and each pair of blocks is one
    group of at most twice ``BLOCK_DOCS`` documents or so, whatever the size of the cluster.
    """
    long = materialize(lists.where(F.col("n") > LIST_ROWS), "long-lists")
    placed = materialize(in_blocks(long.select("pair", "rep"), BLOCK_DOCS), "blocks")
    facts = long.select("rep", "label", "n_shingles").distinct().join(classes.select("rep", "one", "signature"), "rep")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"))
    rows = facts.join(texts, "rep").join(placed, "rep")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _links(group, wanted)

    return rows.groupBy("cluster", "low", "high").applyInPandas(compare, "u bigint, v bigint")


def _links(group: pd.DataFrame, wanted: Similarity) -> pd.DataFrame:
    """Links between the documents of two blocks, or within one, that connect what isn't connected yet."""
    sets = list(shingle_sets(pa.array(group["text"], pa.large_string()), wanted.words))
    right = [i for i, (s, one) in enumerate(zip(sets, group["one"], strict=True)) if fingerprint(s)[0] == one]
    if len(right) < 2:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    group, sets = group.iloc[right], [sets[i] for i in right]
    signs = np.stack(group["signature"].to_numpy())
    sizes, blocks = group["n_shingles"].to_numpy(), group["block"].to_numpy()
    reps, labels = group["rep"].to_numpy(), group["label"].to_numpy()
    within = group["low"].iloc[0] == group["high"].iloc[0]
    parent = {label: label for label in labels.tolist()}

    def root(label: int) -> int:
        while parent[label] != label:
            parent[label] = label = parent[parent[label]]
        return label

    found = []
    for i in range(len(reps)):
        later = np.arange(i + 1, len(reps))
        later = later[(labels[later] != labels[i]) & (within | (blocks[later] != blocks[i]))]
        fits = 100 * np.minimum(sizes[later], sizes[i]) >= wanted.percent * np.maximum(sizes[later], sizes[i])
        later = later[fits]
        agree = np.zeros(len(later), np.int32) if not len(later) else (signs[later] == signs[i]).sum(axis=1)
        for j in later[agree >= wanted.matches][np.argsort(-agree[agree >= wanted.matches], kind="stable")]:
            one, two = root(int(labels[i])), root(int(labels[j]))
            if one == two:
                continue
            common = overlap(sets[i], sets[j])
            if 100 * common >= wanted.percent * (len(sets[i]) + len(sets[j]) - common):
                parent[max(one, two)] = min(one, two)
                found.append((reps[i], reps[j]))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def near_duplicates(
    docs: DataFrame, wanted: Similarity = Similarity(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    ``component_id`` is the smallest key that links reach, ``kept`` whether it is the row's own. Texts without
    words have no shingles and are linked with nothing. Rows that repeat a key are one document: they share
    all links. A row without a key has no component and is kept. Keys must be whole numbers; other columns
    are not looked at.
    """
    made = materialize(signatures(docs, wanted, key, text), "signatures")
    named = made.where("doc IS NOT NULL AND n_shingles > 0")
    classes = materialize(named.groupBy("one", "two", "n_shingles").agg(
        F.min("doc").alias("rep"), F.first("signature").alias("signature")), "classes")
    prefixes = postings(classes, wanted)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        likely = materialize(agreeing(pairs, classes, wanted), f"{name}-likely")
        return materialize(confirmed(likely, classes, docs, wanted, key, text), name)

    same = ["one", "two", "n_shingles"]
    member = materialize(named.select("doc", *same).distinct().join(classes.drop("signature"), same).select("doc", "rep"), "members")
    firsts = materialize(member.groupBy("doc").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    repeated = member.join(firsts, "doc").select(F.col("rep").alias("u"), F.col("first").alias("v"))

    near_hub = links(hub_pairs(prefixes), "hub-links").unionByName(repeated)
    labels = materialize(components(near_hub), "components")
    lists = open_lists(prefixes, labels, classes)
    others = links(open_pairs(lists, wanted), "other-links")
    blocks = materialize(block_links(lists, classes, docs, wanted, key, text), "block-links")
    joined = others.unionByName(blocks).unionByName(labels.where("node != label").toDF("u", "v"))
    labels = materialize(components(joined), "components")

    of_class = materialize(classes.drop("signature").join(labels.toDF("rep", "label"), "rep", "left").select(
        *same, F.coalesce("label", "rep").alias("label")), "class-labels")
    out = made.select("doc", *same).join(of_class, same, "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("label", "doc"))
    return out.select(
        F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, wanted: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are their component's smallest document."""
    found = near_duplicates(docs, wanted, key, text)
    others = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("__other")).distinct(), "other-copies")
    return docs.join(others, F.col(key).cast("bigint") == F.col("__other"), "left_anti")
