"""Quality rules as a cascade that rejects early.

A rule is a condition that rejects a document and works out from its text all it
needs. Its cost and how many documents it rejects are measured on a sample of the
texts; the cascade asks the rules in the order of rejections per cost, and a rule is
evaluated only for documents that no earlier one has rejected. The order decides how
long it takes and never what is kept.
Everything is SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lumisift.llm.common import BLANKS, let, numbers_to, text_of, words_of
from lumisift.plans.scratch import materialize

# Words of the windows whose repetition counts.
WINDOW = 8
SAMPLE_ROWS = 500
SAMPLE_SEED = 9


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for documents to leave out; null counts as false."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # Equal windows meet after sorting; each covers `window` words, less what the next one covers.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))
        spans = let(starts, lambda p: F.transform(
            p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))))
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def counted(w: Column) -> Column:
        each = F.transform(w, lambda word: F.xxhash64(word))
        hashes = let(each, lambda v: F.transform(
            numbers_to(F.size(v) - (window - 1)), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(window)])))
        return let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))

    return let(words, counted)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column) -> Column:
    """The figures of a text as one struct; a null or empty text has zeros.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (with a
    word), ``n_dup_lines`` (equal to an earlier one), ``n_repeat_words``.
    """

    def of(t: Column) -> Column:
        return let(words_of(t), lambda w: let(lines_with_words(t), lambda lines: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )))

    return let(F.coalesce(text, F.lit("")), of)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``measures``; a column of that name is replaced."""
    return docs.withColumn("measures", measures(F.col(text)))


def base_rules(text: str = "text") -> list[Rule]:
    t = text_of(text)
    return [
        Rule("few_words", F.size(words_of(t)) < 20),
        Rule("repeated_words", let(words_of(t), lambda w: 100 * repeated_words(w) > 30 * F.size(w))),
    ]


def more_rules(text: str = "text") -> list[Rule]:
    """Symbols, repeated lines, odd word lengths, shouting."""
    t = text_of(text)

    def mostly_repeated(lines: Column) -> Column:
        return (F.size(lines) >= 4) & (2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines))

    def odd_lengths(words: Column) -> Column:
        return let(F.length(F.array_join(words, "")), lambda n: (n > 15 * F.size(words)) | (n < 2 * F.size(words)))

    return [
        Rule("symbols", 10 * F.regexp_count(t, F.lit("[#*$%&|<>]")) > F.size(words_of(t))),
        Rule("repeated_lines", let(lines_with_words(t), mostly_repeated)),
        Rule("word_length", let(words_of(t), odd_lengths)),
        Rule("capitals", 2 * F.regexp_count(t, F.lit("[A-Z]")) > F.length(F.regexp_replace(t, BLANKS, ""))),
        Rule("exclamations", 2 * F.regexp_count(t, F.lit("!")) > F.size(words_of(t))),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, each with the same chance wherever it lies; all if there are no more."""
    count = docs.count()
    return docs if count <= rows else docs.sample(rows / count, seed=SAMPLE_SEED)


def estimate(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Seconds and share of rejections of each rule, measured on a stored sample of about ``rows`` rows of ``docs``.

    The sample holds the columns as they are, so a rule's time is that of all it works out from them. It
    steers the order alone. What a job takes for a rule that reads nothing is taken off.
    """
    sample = materialize(sample_of(docs, rows), "rules-sample")
    none = F.lit(False)

    def run(reject: Column) -> tuple[float, float]:
        asked = sample.agg(F.avg(F.coalesce(reject, none).cast("int")))
        asked.first()  # Compiles the expression.
        start = time.perf_counter()
        share = asked.first()[0]
        return time.perf_counter() - start, share or 0.0

    idle, _ = run(none)
    found = [(rule.name, *run(rule.reject)) for rule in rules]
    return [Estimate(name, max(seconds - idle, 1e-3), share) for name, seconds, share in found]


def in_order(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """By rejections per cost, largest first; equal ones as given."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda rule: -worth[rule.name])


def rejected(rules: Sequence[Rule]) -> Column:
    """True if a rule rejects; CASE asks one after the other and stops at the first."""
    cascade = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        cascade = cascade.when(F.coalesce(rule.reject, F.lit(False)), F.lit(True))
    return cascade.otherwise(F.lit(False))


def apply_rules(
    docs: DataFrame, rules: Sequence[Rule], name: str = "kept", estimates: Sequence[Estimate] | None = None
) -> DataFrame:
    """``docs`` with the boolean ``name``: false for documents that a rule rejects.

    All rows come back, repeated ones each for themselves; an empty table stays empty.
    Without ``estimates`` the rules are measured on a sample first, which scans ``docs`` once more.
    Null texts count as empty; long ones are read whole by each rule that they reach.
    """
    estimates = estimate(docs, rules) if estimates is None else estimates
    return docs.withColumn(name, ~rejected(in_order(rules, estimates)))
