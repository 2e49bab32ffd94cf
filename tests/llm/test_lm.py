"""LM scores against a plain count of bigrams."""

import math
import re
import statistics
from collections import Counter

import pytest

from lumisift.llm import lm_score, query_mix

FOLDER = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, good, smooth=0.1, prior=4.0):
    grams = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        grams[doc] = list(zip([None, *words], words))
    pairs, words = (Counter(), Counter()), (Counter(), Counter())
    for doc, found in grams.items():
        pairs[doc in good].update(found)
        words[doc in good].update(word for _, word in found)
        words[doc in good][None] += bool(found)
    vocabulary = len(set(words[0]) | set(words[1]))
    totals = [sum(words[kind].values()) for kind in (0, 1)]
    scale = (totals[1] / totals[0] if all(totals) else 1.0, 1.0)
    out = {}
    for doc, found in grams.items():
        own_pairs, own_words = Counter(found), Counter(word for _, word in found)
        own_words[None] = 1

        def loss(kind, pair):
            mine = (doc in good) == kind
            (before, word), size = pair, totals[kind] - mine * (len(found) + 1)
            alone = (scale[kind] * (words[kind][word] - mine * own_words[word]) + smooth) / (scale[kind] * size + smooth * vocabulary)
            seen = scale[kind] * (pairs[kind][pair] - mine * own_pairs[pair])
            return -math.log((seen + prior * alone) / (scale[kind] * (words[kind][before] - mine * own_words[before]) + prior))

        out[doc] = sum(loss(1, g) - loss(0, g) for g in found) / max(len(found), 1)
    return out


@pytest.mark.parametrize("size", [None, 40_000])
def test_query(spark, monkeypatch, size):
    if size:
        # Several packs and buckets.
        monkeypatch.setattr(lm_score, "PACK_BYTES", size)
        monkeypatch.setattr(lm_score, "BUCKET_BYTES", 2 * size)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    want = brute(rows, good)
    got = {r.doc_id: r.score for r in query_mix.op2_lm_score(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b a", "x"), (3, "a b a", "x"), (None, "b a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([(1,), (3,), (3,), (None,)], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.score) for r in lm_score.score_documents(docs, target).collect()}
    assert {d: n for d, (n, _) in got.items()} == {1: 0, 2: 0, 3: 3, None: 2}
    assert got[1][1] == got[2][1] == 0.0
    assert lm_score.score_documents(docs.limit(0), target).count() == 0


def test_documents_are_scored_by_models_that_have_not_seen_them(spark):
    """Half of the good documents as target: the other half scores like them, and below the unlabelled ones."""
    folder = FOLDER.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = sorted(r.doc_id for r in labels.where("quality = 1").collect())
    inside, outside = set(good[::2]), set(good[1::2])
    labelled = {r.doc_id for r in labels.collect()}
    target = spark.createDataFrame([(d,) for d in inside], "doc_id long")
    scores = {r.doc_id: r.score for r in lm_score.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), target).collect()}

    def median(ids):
        return statistics.median(scores[d] for d in ids)

    near, far, bad = median(inside), median(outside), median(labelled - set(good))
    rest = median(set(scores) - labelled)
    assert near <= far <= rest < bad
    assert far - near < 0.1 * (bad - near)
