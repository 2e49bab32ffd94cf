import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumisift.catalog.files import png
from lumisift.operators.embed import embed, image_tensor, preprocess_images, shrink
from lumisift.operators.tokenize import bpe_encode, load_encoder, resolve_merges
from lumisift.sources.files import scan_images
from lumisift.sources.tokenizer import read_tokenizer

VOCAB = {"<pad>": 0, "<unk>": 3, "a": 1, "b": 2, "ab": 4, "▁": 5}


def write(path, vocab, merges):
    path.write_text(json.dumps({"version": "1.0", "model": {"type": "BPE", "vocab": vocab, "merges": merges}}))
    return str(path)


@pytest.mark.parametrize("merges", [[["a", "b"], ["\"", "["]], ["a b", "\" ["]])
def test_both_merge_encodings(spark, tmp_path, merges):
    vocab, rules = read_tokenizer(spark, write(tmp_path / "t.json", VOCAB, merges))
    assert {r.token: r.id for r in vocab.collect()} == VOCAB
    assert [(r.left, r.right) for r in rules.orderBy("rank").collect()] == [("a", "b"), ("\"", "[")]


def test_odd_merges(spark, tmp_path):
    _, rules = read_tokenizer(spark, write(tmp_path / "t.json", VOCAB, ["ab", "[ x", "a b c", "a b"]))
    assert [(r.left, r.right) for r in rules.orderBy("rank").collect()] == [("[", "x"), ("a", "b c"), ("a", "b")]


def test_empty_vocabulary(spark, tmp_path):
    with pytest.raises(ValueError, match="no vocabulary"):
        read_tokenizer(spark, write(tmp_path / "t.json", {}, []))


def tables(spark, vocab, merges):
    words = spark.createDataFrame(list(vocab.items()), "token string, id int")
    rules = spark.createDataFrame(
        [(i, l, r) for i, (l, r) in enumerate(merges)], "rank int, left string, right string")
    return words, resolve_merges(rules, words)


def encode(spark, texts, vocab, merges, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = bpe_encode(df, "text", *tables(spark, vocab, merges), **options).collect()
    return [r.token_ids for r in sorted(got, key=lambda r: r.id)]


def test_encode(spark):
    got = encode(spark, ["ab a", "", "aab", "x", None, "a" * 70], VOCAB, [("a", "b")], max_len=5)
    assert got == [[4, 5, 1, 0, 0], [0] * 5, [1, 4, 0, 0, 0], [3, 0, 0, 0, 0], [0] * 5, [1] * 5]
    assert len(encode(spark, ["a"], VOCAB, [])[0]) == 64


def test_resolve_merges(spark):
    _, rules = tables(spark, VOCAB, [("a", "b"), ("q", "a"), ("b", "a"), ("a", "b")])
    assert sorted(map(tuple, rules.collect())) == [(1, 2, 3, 4), (2, 1, 2, None)]


def naive(text, vocab, merges, pad=0):
    """The rule as it is stated: look for the lowest rank, leftmost, until there is none."""
    unk = vocab.get("<unk>", 3)
    by_id = {i: t for t, i in vocab.items()}
    ranks = {}
    for rank, (left, right) in enumerate(merges):
        if left in vocab and right in vocab:
            ranks[vocab[left], vocab[right]] = rank
    ids = [vocab.get(c, unk) for c in text.replace(" ", "▁")]
    while True:
        found = [(ranks[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        if not found:
            return ids
        _, i = min(found)
        ids[i:i + 2] = [vocab.get(by_id[ids[i]] + by_id[ids[i + 1]], unk)]


SETS = [
    (["ab", "bc", "abc", "aa", "ca"], [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "a"), ("c", "a"), ("aa", "aa")]),
    (["ab", "aba", "▁a"], [("ab", "a"), ("b", "a"), ("▁", "a"), ("a", "b")]),
    (["aa", "aaaa"], [("aa", "aa"), ("a", "a")]),
    (["ab"], [("a", "b"), ("<unk>", "a"), ("b", "<unk>")]),
    ([], []),
]


def built(words, merges):
    vocab = {"<pad>": 0, "<unk>": 3, "a": 10, "b": 11, "c": 12, "▁": 13}
    vocab.update({w: 20 + i for i, w in enumerate(words)})
    return vocab


class Rows:
    """Just enough of a table for load_encoder."""

    def __init__(self, frame):
        self.frame = frame

    def select(self, *columns):
        return Rows(self.frame[list(columns)])

    def limit(self, _):
        return self

    def toPandas(self):
        return self.frame


def plain_encoder(vocab, merges):
    import pandas as pd

    ranks = {}
    for rank, (left, right) in enumerate(merges):
        if left in vocab and right in vocab:
            ranks[left, right] = rank
    rules = pd.DataFrame(
        [(vocab[l], vocab[r], rank, vocab.get(l + r)) for (l, r), rank in ranks.items()],
        columns=["left_id", "right_id", "rank", "merged_id"])
    words = pd.DataFrame(list(vocab.items()), columns=["token", "id"])
    return load_encoder(Rows(words), Rows(rules))


@pytest.mark.parametrize("words, merges", SETS)
def test_rules_on_the_unknown_token_keep_the_text_whole(words, merges):
    encoder = plain_encoder(built(words, merges), merges)
    assert (encoder.crossings is None) == any("<unk>" in pair for pair in merges)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(SETS), st.text(alphabet="abc x\U0001f600", max_size=40))
def test_encode_property(case, text):
    words, merges = case
    vocab = built(words, merges)
    assert plain_encoder(vocab, merges).encode(text) == naive(text, vocab, merges)


def test_embed_normalises_and_rejects(spark):
    def model():
        return lambda texts: np.array([[len(t), 0.0, len(t)] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab",), ("",)], "text string")
    got = {r.text: r.embedding for r in embed(df, "text", model, 3).collect()}
    assert got["ab"] == pytest.approx([0.70710678, 0.0, 0.70710678])
    assert got[""] == [0, 0, 0]
    assert embed(df, "text", model, 4).count() == 0


def test_values_that_fail(spark):
    def model():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("bad")
            return np.ones((len(texts), 2), np.float32)
        return run

    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "text string").coalesce(1)
    assert sorted(r.text for r in embed(df, "text", model, 2, skip_failures=True).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="bad"):
        embed(df, "text", model, 2).collect()


def slow_tensor(pixels):
    """Triangle-filter resize of one RGB image, pixel by pixel."""
    height, width = pixels.shape[:2]

    def taps(source):
        ratio = source / 224
        reach = max(ratio, 1.0)
        out = []
        for o in range(224):
            middle = (o + 0.5) * ratio
            weights = [max(0.0, 1 - abs(i + 0.5 - middle) / reach) for i in range(source)]
            out.append([w / sum(weights) for w in weights])
        return out

    down, across = np.array(taps(height)), np.array(taps(width))
    out = np.zeros((3, 224, 224))
    for c in range(3):
        out[c] = down @ pixels[:, :, c].astype(float) @ across.T
    return (np.floor(np.clip(out, 0, 255) + 0.5) / 255 - 0.5) / 0.5


@pytest.mark.parametrize("size", [(5, 9), (224, 224), (300, 37)])
def test_tensor(size):
    pixels = np.random.default_rng(4).integers(0, 256, (*size, 3)).astype(np.uint8)
    got = image_tensor(pixels[:, :, ::-1].tobytes(), size[0], size[1], 3)
    assert got.shape == (3, 224, 224)
    # Sums in another order may land on the other side of a half.
    assert np.abs(got - slow_tensor(pixels)).max() <= 2 / 255 + 1e-6
    assert np.mean(np.abs(got - slow_tensor(pixels)) > 1e-6) < 0.001


def test_grey_and_alpha():
    grey = image_tensor(bytes([128]) * 4, 2, 2, 1)
    assert np.allclose(grey, (128 / 255 - 0.5) / 0.5)
    alpha = image_tensor(bytes([1, 2, 3, 255]) * 4, 2, 2, 4)
    assert np.allclose(alpha[:, 0, 0], (np.array([3, 2, 1]) / 255 - 0.5) / 0.5)


def test_shrink():
    pixels = np.zeros((2048, 1024, 3), np.uint8)
    pixels[::2] = 3
    small = shrink(pixels)
    assert small.shape == (1024, 512, 3) and (small == 2).all()
    assert shrink(np.zeros((1024, 3, 3), np.uint8)).shape == (1024, 3, 3)


def test_preprocess_images(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(png(6, 4, bytes([10 * i, 20, 30]) * 24))
    tensors = preprocess_images(scan_images(spark, str(tmp_path)))
    got = {r.path[-5]: r for r in tensors.select("path", F.size("pixels").alias("n"), F.col("pixels")[0].alias("red")).collect()}
    for i in range(5):
        assert got[str(i)].n == 150_528
        assert got[str(i)].red == pytest.approx((10 * i / 255 - 0.5) / 0.5, abs=1e-6)
    vectors = embed(tensors, "pixels", lambda: lambda x: x.mean(axis=(2, 3)), 3, tensor_shape=[3, 224, 224])
    assert vectors.count() == 5
