"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

All of it is SQL functions on the row of a document; nothing is exploded or shuffled.
The text between the matches of a pattern and the matches themselves give the
positions, as running sums of their lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lumisift.llm.common import let, numbers_to, running_sums

CONTEXT_CHARS = 60
THRESHOLD = 0.5
# A token without a known prefix: characters at most, and bits per character at least.
SECRET_CHARS, SECRET_BITS = 512, 3.0


@dataclass(frozen=True)
class Kind:
    """``trigger`` is a cheap test that texts without any match fail.

    ``valid`` confirms a match. ``base`` kinds are kept as confirmed, others only with a
    score of at least the threshold. The words of ``near`` on either side of a match raise its
    score by 0.4, those of ``against`` lower it by 0.4.
    """

    name: str
    pattern: str
    trigger: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    near: str
    against: str = ""
    base: bool = True


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digit(digits: Column, i: Column) -> Column:
    return F.substring(digits, i + 1, F.lit(1)).cast("int")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""

    def term(d: Column, i: Column) -> Column:
        value = _digit(d, F.length(d) - 1 - i)
        twice = value * 2
        return F.when(i % 2 == 0, value).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return let(digits, lambda d: F.aggregate(
        F.transform(numbers_to(F.length(d)), lambda i: term(d, i)), F.lit(0), lambda acc, x: acc + x) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97, as IBANs do."""

    def step(acc: Column, code: Column) -> Column:
        letter = code >= 65
        return (acc * F.when(letter, 100).otherwise(10) + F.when(letter, code - 55).otherwise(code - 48)) % 97

    moved = F.concat(F.substring(account, 5, 34), F.substring(account, 1, 4))
    return let(moved, lambda m: F.aggregate(
        F.transform(numbers_to(F.length(m)), lambda i: F.ascii(F.substring(m, i + 1, F.lit(1)))),
        F.lit(0), step) == 1)


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _ip(match: Column) -> Column:
    # Without leading zeros a part of more than three digits is over 255.
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _iban(match: Column) -> Column:
    return let(F.replace(match, F.lit(" "), F.lit("")), lambda a: F.length(a).between(15, 34) & mod97(a))


def entropy(value: Column) -> Column:
    """Bits per character of a string that is not empty, from the counts of its characters."""

    def share(v: Column) -> Column:
        def term(char: Column) -> Column:
            count = F.length(v) - F.length(F.replace(v, char, F.lit("")))
            return count * F.log2(count.cast("double"))

        chars = F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))
        return F.log2(F.length(v).cast("double")) - F.aggregate(
            F.transform(chars, term), F.lit(0.0), lambda acc, x: acc + x) / F.length(v)

    return let(value, share)


def _random(match: Column) -> Column:
    """Letters and digits of a key's length, too evenly spread for a word or a number."""
    mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.when(mixed & (F.length(match) <= SECRET_CHARS), entropy(match) >= SECRET_BITS).otherwise(False)


def _day(match: Column) -> Column:
    return F.try_to_date(match, "yyyy-MM-dd").isNotNull()


def _always(match: Column) -> Column:
    return F.lit(True)


# A run of these characters can only match from its start, or from where the last match ended:
# the guard in front and the possessive quantifiers keep the search linear and off the stack.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), _always, 0.9, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, 0.6, "ip|host|server|address", "version|release"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+",
         lambda t: t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), _card, 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"),
         lambda m: F.length(_digits(m)).between(10, 15), 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _iban, 0.8, "iban|account|bank", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _always, 0.3, "ssn|social security", base=False),
    # Prefixes that issuers of keys publish, and the heads of key files.
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}"
         r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])"
         r"|-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----",
         lambda t: t.rlike("AKIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|PRIVATE KEY"), _always, 0.9, "key|token|secret", base=False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+", lambda t: t.rlike("[A-Za-z0-9+/_-]{20}"), _random, 0.3,
         "token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|passw|bearer|credential", "checksum|digest|commit", base=False),
    Kind("birth", r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])", lambda t: t.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"),
         _day, 0.2, "born|birth|dob", base=False),
)

_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string,score:double>>"


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.concat(F.right(before, F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(after, F.lit(CONTEXT_CHARS)))

    def score(context: Column) -> Column:
        value = F.lit(kind.score) + F.when(context.rlike(rf"(?i)\b(?:{kind.near})"), 0.4).otherwise(0.0)
        if kind.against:
            value = value - F.when(context.rlike(rf"(?i)\b(?:{kind.against})"), 0.4).otherwise(0.0)
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

    return let(near, score)


def spans_of(text: Column, kind: Kind, number: int) -> Column:
    """The confirmed spans of one kind in a text that is not null, in order.

    The context on each side reaches over one more match of the kind, as far as ``CONTEXT_CHARS``.
    """

    def part(values: Column, i: Column) -> Column:
        return F.coalesce(F.get(values, i), F.lit(""))

    def span(matches: Column, between: Column, i: Column, end: Column) -> Column:
        match = F.get(matches, i)
        before = F.concat(part(between, i - 1), part(matches, i - 1), F.get(between, i))
        after = F.concat(F.get(between, i + 1), part(matches, i + 1), part(between, i + 2))
        return F.struct(
            (end - F.length(match)).alias("start"), F.lit(number).alias("kind_no"), end.alias("end"),
            F.lit(kind.name).alias("kind"), match.alias("value"), _score(kind, before, after).alias("score"))

    def found(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda matches: let(
            F.split(t, kind.pattern, -1), lambda between: let(
                running_sums(F.transform(matches, lambda m, i: (
                    F.length(F.get(between, i)) + F.length(m)).cast("bigint"))),
                lambda ends: F.transform(
                    matches, lambda m, i: F.when(kind.valid(m), span(matches, between, i, F.get(ends, i)))))))

    confirmed = F.filter(found(text), lambda s: s.isNotNull())
    if not kind.base:
        confirmed = F.filter(confirmed, lambda s: s["score"] >= THRESHOLD)
    return F.when(kind.trigger(text), confirmed.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with an array of spans ``(start, kind_no, end, kind, value, score)`` by start and kind.

    Positions are code points, ends exclusive. A null or empty text has an empty array.
    Every row is looked at for itself, so repeated rows and ids do no harm.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(name, F.sort_array(F.concat(
        *[spans_of(whole, kind, i) for i, kind in enumerate(KINDS)])))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
