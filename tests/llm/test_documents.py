"""Operators on single documents against plain Python, and on odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumisift.llm import licenses, pii, quality_model, quality_rules, query_dups, query_mix, query_rules, url_filter

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, pii string, measures string"

# Nulls, empty and blank texts, a repeated row, and columns named as results are.
ODD = [
    (1, None, None, None, None, "x", "x", "x"),
    (2, "", "en", "", 0, "x", "x", "x"),
    (3, " \t\n\r ", "en", "a", 4, None, None, None),
    (4, "One two", "en", "a", 7, "x", "x", "x"),
    (4, "One two", "en", "a", 7, "x", "x", "x"),
    (None, "no id at all " * 30, "en", "b", 1, "x", "x", "x"),
    (6, "long é " * 60_000, "fr", "b", 1, "x", "x", "x"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()


# -- personal data ------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, pattern) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    "a@b.c_d@e.f x@y z@q.org. é ü@x.de mail me@host.example.com,you@host.example.com",
    "1.2.3.4.5 300.1.1.1 010.000.255.255 1.2.3 9.9.9.9x 1.2.3.4.5.6.7.8 0000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111 and 5500005555555559 7",
    "call +1 (499) 555-6503, +12 34, +44 20 7946 0958 x +1234567890123456 ++1 234 567 8901",
    "🙂 a@b.co 🙂 +1 499 555 6503 🙂🙂 10.0.0.1", "@ + . " * 50, "7 " * 3000, "1" * 5000, "a" * 5000 + "@b.c",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r.doc_id, r.text) for r in documents(spark)]
    df = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    base = F.filter("pii", lambda s: s["kind_no"] < 4)
    got = {r.doc_id: r.s for r in df.select("doc_id", pii.written(base).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_added_spans_need_checksum_or_context(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "DE89370400440532013001"), (3, "SSN: 078-05-1120"), (4, "id 078-05-1120")]
    df = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: [s.kind for s in r.pii] for r in df.collect()} == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}


def test_secrets_and_births_need_their_context(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [
        (f'token = "{token}"###', ["secret"]), (f"{token} is the secret", ["secret"]), (f"commit {token}", []), (token, []),
        ("token = " + "ab1" * 14, []), ("password " + "x" * 40, []), (f"token digest {token}", []),
        ("AKIA" + "ABCD1234" * 2, ["key"]), ("-----BEGIN RSA PRIVATE KEY-----", ["key"]), ("xAKIA" + "ABCD1234" * 2, []),
        ("born 1980-02-29", ["birth"]), ("1980-02-28 (date of birth)", ["birth"]), ("born 1981-02-29", []), ("on 1980-02-29", []),
        (f"token {token} {'x' * 70} {token}", ["secret"]), (f"token {token} {token}", ["secret", "secret"]),
        ("078-05-1120, as social security number", ["ssn"]), ("", []), (None, []), (f"token {token} " * 300, ["secret"] * 300)]
    df = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: r.pii for r in df.collect()}
    for i, (text, kinds) in enumerate(texts):
        assert [s.kind for s in got[i]] == kinds, text
        assert all(text[s.start:s.end] == s.value for s in got[i])


def test_entropy(spark):
    words = ["a", "abab", "abcd", "24be64439e3e49cf", "ééxx"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(pii.entropy(F.col("w"))).collect()
    for word, (bits,) in zip(words, got, strict=True):
        counts = [word.count(c) / len(word) for c in set(word)]
        assert bits == pytest.approx(-sum(p * math.log2(p) for p in counts))


def test_many_matches_keep_their_places(spark):
    text = "a@b.co " * 2000
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in row.pii] == [(7 * i, 7 * i + 6) for i in range(2000)]


def test_pii_query(spark):
    got = {r.doc_id: r for r in query_rules.op8_pii(spark, FOLDER).collect()}
    for doc in documents(spark):
        want = plain_spans(doc.text or "")
        assert got[doc.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[doc.doc_id].n_email == want.count("email:")
        assert got[doc.doc_id].n_found == len([x for x in got[doc.doc_id].spans.split(",") if x])
        assert (got[doc.doc_id].score > 0) == (got[doc.doc_id].n_found > 0)
        if re.search(r'token = "[0-9a-f]{40}"', doc.text or ""):
            assert "secret:" in got[doc.doc_id].spans


# -- quality rules ------------------------------------------------------------

def test_repeated_words(spark):
    rows = [(1, "a b c d e f g h " * 2), (2, "x " * 9), (3, "a b c d e f g h i j"), (4, "p q r s t u v w 1 p q r s t u v w 2")]
    df = quality_rules.with_measures(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.measures.n_repeat_words for r in df.collect()} == {1: 16, 2: 9, 3: 0, 4: 16}


def test_the_order_of_rules_changes_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = [*quality_rules.base_rules(), *quality_rules.more_rules()]
    there = [quality_rules.Estimate(r.name, 1.0, i) for i, r in enumerate(rules)]
    back = [quality_rules.Estimate(r.name, 1.0, -i) for i, r in enumerate(rules)]
    kept = [sorted(r.doc_id for r in quality_rules.apply_rules(docs, rules, estimates=e).where("kept").collect()) for e in (there, back)]
    assert kept[0] == kept[1] and kept[0]
    assert [r.name for r in quality_rules.in_order(rules, there)][0] == rules[-1].name


def test_a_rule_is_not_evaluated_for_what_an_earlier_one_rejects(spark):
    rows = [(1, "short"), (2, None), (3, "#" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fails = quality_rules.Rule("fails", F.raise_error(F.lit("evaluated")).cast("boolean"))
    short = quality_rules.base_rules()[0]
    first = [quality_rules.Estimate("few_words", 1.0, 1.0), quality_rules.Estimate("fails", 9.0, 1.0)]
    assert quality_rules.apply_rules(docs, [fails, short], estimates=first).where("kept").count() == 0
    last = [quality_rules.Estimate("few_words", 9.0, 1.0), quality_rules.Estimate("fails", 1.0, 1.0)]
    with pytest.raises(Exception, match="evaluated"):
        quality_rules.apply_rules(docs, [fails, short], estimates=last).collect()


def test_rules_are_measured_on_texts_from_the_whole_table(spark):
    """The first rows are all rejected and the rest are not, which a head of the table would hide."""
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "short").otherwise(good).alias("text"))
    (few,) = quality_rules.estimate(docs, quality_rules.base_rules()[:1])
    assert 0.15 < few.rejected < 0.35
    assert 300 < quality_rules.sample_of(docs).count() < 700
    assert quality_rules.sample_of(docs.limit(10)).count() == 10


def test_what_a_rule_works_out_counts_as_its_cost(spark):
    docs = spark.range(400).select(F.lit(0).alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("w"), i * (F.col("id") + 7)))).alias("text"))
    found = {e.name: e.seconds for e in quality_rules.estimate(docs, [*quality_rules.base_rules(), *quality_rules.more_rules()])}
    assert max(found, key=found.get) == "repeated_words"


# -- licenses -----------------------------------------------------------------

@pytest.mark.parametrize("text, parsed", [
    ("MIT", "mit"), ("MIT OR Apache-2.0 AND ISC", "mit apache-2.0 isc and or"),
    ("(MIT OR ISC) AND Zlib", "mit isc or zlib and"),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", "gpl-2.0 classpath-exception-2.0 with mit or"),
    ("MIT some prose", "mit"), ("MIT)", "mit"), ("(MIT", None), ("AND MIT", None), ("MIT OR", None), ("", None),
])
def test_expressions(text, parsed):
    assert licenses.postfix(text) == (parsed.split() if parsed else None)


def test_a_choice_is_allowed_and_a_sum_is_not():
    def met(expression):
        return licenses.evaluate(licenses.postfix(expression), licenses.ALLOWED)[1]
    assert met("MIT OR GPL-3.0") and not met("MIT AND GPL-3.0") and not met("GPL-2.0 WITH x OR GPL-3.0")


def test_license_query_base(spark):
    got = {r.doc_id: r for r in query_mix.op7_license_scan(spark, FOLDER).collect()}
    low = {c: c + 32 for c in range(65, 91)}
    for doc in documents(spark):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (doc.text or "").translate(low))
        at = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
        row = got[doc.doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(at))
        assert (row.first_word, row.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in at}))


def test_tags_add_labels():
    text = "// SPDX-License-Identifier: MIT OR GPL-3.0\nUnder the MIT-License, under the mit license"
    got = licenses.scan(text, licenses.BASE_PHRASES, licenses.MORE_PHRASES, licenses.ALLOWED)
    assert got["n_base"] == 2 and got["base_labels"] == "mit" and got["labels"] == "gpl-3.0,mit" and got["allowed"]


@pytest.mark.parametrize("tagged, labels, unknown", [
    ("MIT/Apache-2.0", "apache-2,mit", []), ("GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2.0+-with-classpath-exception-2.0", []),
    ("LicenseRef-Own AND MIT", "licenseref-own,mit", []), ("see the LICENSE file", "", ["see the LICENSE file"]),
    ("<name> here", "", ["<name> here"]), ("MIT OR nonsense", "", ["MIT OR nonsense"]), ("", "", [""]),
])
def test_only_known_names_become_labels(tagged, labels, unknown):
    for tag in ("SPDX-License-Identifier", "SPDX License Identifier"):
        got = licenses.scan(f"# {tag}: {tagged}\ncode", licenses.BASE_PHRASES, licenses.MORE_PHRASES, licenses.ALLOWED)
        assert (got["labels"], got["unknown"]) == (labels, unknown)
        assert bool(got["expressions"]) == bool(labels) and (got["score"] > 0) == bool(labels)


# -- URLs ---------------------------------------------------------------------

def test_entries_hold_from_their_day(spark):
    entries = spark.createDataFrame([
        ("bad.org", "spam", "add", "2024-01-10"), ("bad.org", "spam", "remove", "2024-02-10"), ("bad.org", "spam", "add", "2024-02-10"),
        ("bad.org", "spam", "remove", "2024-03-01"), ("ok.org/x", "path", "add", "2024-01-01"), (None, "spam", "add", "2024-01-01"),
        ("odd.org", "spam", "ban", "2024-01-01"), ("late.org", "spam", "add", None),
    ], "pattern string, category string, action string, listed_on string").withColumn("listed_on", F.to_date("listed_on"))
    rows = [
        (1, "http://www.BAD.org./a", "2024-01-09"), (2, "http://u:p@www.bad.org:80/a", "2024-01-10"), (3, "//bad.org", "2024-02-10"),
        (4, "https://bad.org", "2024-03-01"), (5, "http://notbad.org/", "2024-02-01"), (6, "http://ok.org//x/y?z", "2024-02-01"),
        (7, "http://ok.org/xy", "2024-02-01"), (8, None, "2024-02-01"), (9, "http://bad.org", None), (10, "nonsense", "2024-02-01"),
        (3, "//bad.org", "2024-02-10"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, day string").select(
        "page_id", "url", F.to_date("day").alias("fetched_on"), F.lit("x").alias("blocked"), F.lit(1).alias("n_matches"))
    got = url_filter.filter_urls(pages, entries)
    assert sorted(r.page_id for r in got.where("blocked").collect()) == [2, 3, 3, 6]
    assert got.count() == len(rows)
    assert url_filter.filter_urls(pages, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.filter_urls(pages.limit(0), entries).count() == 0


# -- quality model ------------------------------------------------------------

def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scores = query_dups.op3_quality_model(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = scores.where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def learnt(spark, texts):
    """Share of held-out texts whose label, that of their place, is predicted from the other texts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    rows = quality_model.score_quality(docs, labels).where("held_out").collect()
    assert len(rows) > 40
    return sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows) / len(rows)


@pytest.mark.parametrize("letters, gap", [("abcdefghijklmnop", " "), ("абвгдежзийклмноп", " "), ("的一是不了人我在有他这中大来上国", "")])
def test_words_alone_are_learnt(spark, letters, gap):
    draw = random.Random(5)
    words = ["".join(draw.choices(letters, k=5)) for _ in range(60)]
    texts = [gap.join(draw.choices(words[:40], k=40) + draw.choices(words[40 + i % 2 * 10:50 + i % 2 * 10], k=10)) for i in range(300)]
    assert learnt(spark, texts) >= 0.95


def test_passages_that_repeat_at_a_distance_are_learnt(spark):
    draw = random.Random(6)
    texts = []
    for i in range(300):
        words = ["".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(60)]
        texts.append(" ".join(words if i % 2 else words[:12] * 5))
    assert learnt(spark, texts) >= 0.95


def test_without_labels_all_score_alike(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_model.score_quality(odd, empty).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1


# -- odd rows -----------------------------------------------------------------

def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 1), (None, 1), (2, None)], "doc_id long, quality int")
    ids = sorted(str(r[0]) for r in ODD)
    measured = quality_rules.apply_rules(
        odd, [*quality_rules.base_rules(), *quality_rules.more_rules()])
    tables = [measured, pii.find_pii(odd), licenses.scan_licenses(odd), quality_model.score_quality(odd, labels)]
    for table in tables:
        assert sorted(str(r.doc_id) for r in table.collect()) == ids
    for table in (quality_rules.apply_rules(odd.limit(0), quality_rules.base_rules()), quality_rules.with_measures(odd.limit(0)), pii.find_pii(odd.limit(0)), licenses.scan_licenses(odd.limit(0)),
                  quality_model.score_quality(odd.limit(0), labels)):
        assert table.count() == 0
    assert {r.doc_id: r.n_words for r in licenses.scan_licenses(odd).collect() if r.doc_id} == {1: 0, 2: 0, 3: 0, 4: 2, 6: 120_000}


# -- the quality model's parts against plain ones ------------------------------------

TEXTS_OF_ALL_KINDS = [
    None, "", "a", "ab", "abc", " ", "x y", "ΑΣ ΑΣ." + " b" * 9, "One two three four " * 30, "AAA!!! ### $$$ " * 20,
    "long é 🙂 " * 3000, "same words same words same words", "The quick brown fox. " * 3 + "jumps",
]


def plain_shape(text):
    """Shape indicators by counting one by one."""
    raw = (text or "").encode()
    found = set()
    kinds = [int(quality_model._CLASS[b]) for b in raw]
    grams = [(a * quality_model._KINDS + b) * quality_model._KINDS + c for a, b, c in zip(kinds, kinds[1:], kinds[2:])]
    for gram in set(grams):
        for i, least in enumerate(quality_model._LEVELS):
            if grams.count(gram) / len(grams) >= least:
                found.add(gram * len(quality_model._LEVELS) + i)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def levels(share, first):
        found.update(first + i for i, least in enumerate(quality_model._REPEAT_LEVELS) if share > least)

    for lag in range(1, 9):
        if len(words) > lag:
            levels(sum(a == b for a, b in zip(words[lag:], words)) / (len(words) - lag), quality_model._REPEATS + 4 * (lag - 1))
    if len(words) > 4:
        passages = [tuple(words[i:i + 4]) for i in range(len(words) - 3)]
        levels(1 - len(set(passages)) / len(passages), quality_model._PASSAGES)
    return found


def by_text(texts):
    flat, lengths = quality_model.batch_features(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    return [flat[end - n:end].tolist() for end, n in zip(ends, lengths)]


@pytest.mark.parametrize("chunk", [1 << 19, 7])
def test_indicators(monkeypatch, chunk):
    monkeypatch.setattr(quality_model, "_CHUNK", chunk)
    texts = TEXTS_OF_ALL_KINDS if chunk > 7 else [t for t in TEXTS_OF_ALL_KINDS if len(t or "") < 1000]
    together = by_text(texts)
    for text, found in zip(texts, together):
        assert len(found) == len(set(found))
        assert sorted(found) == sorted(by_text([text])[0])
        assert {f for f in found if f < quality_model.SHAPES} == plain_shape(text)
        wording = [f for f in found if f >= quality_model.SHAPES]
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        letters = (text or "").lower()
        kinds = {("w", *words[i:i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}
        kinds |= {("c", letters[i:i + n]) for n in (2, 3, 4) for i in range(len(letters) - n + 1)}
        # Each run of words or characters is one number; two share one now and then.
        assert 0.99 * len(kinds) - 1 <= len(wording) <= len(kinds)


def test_class_counts(spark):
    rows = [(t, n % 2) for n, t in enumerate(TEXTS_OF_ALL_KINDS * 2)]
    counts, totals = quality_model.class_counts(spark.createDataFrame(rows, "text string, quality long").repartition(3))
    want = np.zeros_like(counts)
    for text, quality in rows:
        want[quality, by_text([text])[0]] += 1
    assert (counts == want).all() and totals.tolist() == [13, 13]


def test_ratios_by_hand():
    counts = np.zeros((2, quality_model.FEATURES), np.int64)
    counts[:, 0], counts[:, quality_model.SHAPES] = (1, 5), (3, 0)
    got = quality_model.ratios(counts, np.array([4, 6]))
    sums = [counts[i, :quality_model.SHAPES].sum() + quality_model.SHAPES for i in (0, 1)]
    assert got[0] == pytest.approx(np.log(6 / sums[1]) - np.log(2 / sums[0]))
    assert got[quality_model.SHAPES] == pytest.approx(np.log((0.6 / 6.6) / (3.4 / 4.4)))
    assert got[quality_model.SHAPES + 1] == 0


def test_hinge_against_a_plain_solver():
    """The same dual by projected gradient steps on the whole matrix of products."""
    rng = np.random.default_rng(3)
    scale = rng.normal(size=quality_model.FEATURES)
    rows = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(40)]
    signs = np.where(np.array([r.sum() + rng.normal(0, 40) for r in rows]) > 350, 1.0, -1.0)
    weights, bias = quality_model.fit_hinge(rows, signs, scale, rounds=3000)
    matrix = np.zeros((40, 61))
    for i, r in enumerate(rows):
        matrix[i, r], matrix[i, 60] = quality_model.row_values(r, scale), 1.0
    signed = matrix * signs[:, None]
    gram, dual = signed @ signed.T, np.zeros(40)
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(200_000):
        dual = np.clip(dual - step * (gram @ dual - 1), 0, 1)
    want = signed.T @ dual

    def cost(w):
        return 0.5 * w @ w + np.maximum(0, 1 - signed @ w).sum()

    assert cost(np.append(weights[:60], bias)) == pytest.approx(cost(want), rel=1e-2)


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"words of text number {i} and more") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    known = docs.join(labels, "doc_id").withColumn("quality", F.col("quality").cast("long"))
    whole, _ = quality_model._sample(known, 200)
    assert len(whole) == 200
    monkeypatch.setattr(quality_model, "FIT_INDICATORS", sum(len(f) for f in whole[:50]))
    some, _ = quality_model._sample(known, 200)
    assert [f.tolist() for f in some] == [f.tolist() for f in whole[:50]]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_few_and_many_labels_give_the_same_model(spark, monkeypatch, most):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    want = {r.doc_id: r.score for r in quality_model.score_quality(docs, labels).collect()}
    monkeypatch.setattr(quality_model, "BROADCAST_LABELS", most)
    got = {r.doc_id: r.score for r in quality_model.score_quality(docs, labels).collect()}
    assert got == pytest.approx(want)
