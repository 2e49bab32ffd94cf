"""License scans: an Aho-Corasick automaton over the words, and license expressions.

The automaton finds notice phrases and identifier tags in the words of a text. Behind a
tag stands an expression, which a shunting-yard parser turns into postfix order; it is
evaluated against the licenses that are allowed. Rows are looked at one by one inside
Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cache
from operator import and_, or_

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# The phrases whose places the contract counts.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices besides; labels are identifiers in lower case.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

# Identifiers and exceptions of the SPDX license list that expressions may name.
KNOWN = frozenset("""
0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0
artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0
cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1
cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.2 gfdl-1.3 gfdl-1.3-only
gfdl-1.3-or-later gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later
hpnd icu ijg ipl-1.0 isc lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libtiff lppl-1.3c mit mit-0
mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1
openssl osl-2.1 osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sspl-1.0
tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
EXCEPTIONS = frozenset("""
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception
ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 swift-exception u-boot-exception-2.0
""".split())

# Identifiers that have another label here.
SAME = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc"}

ALLOWED = frozenset({"mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0"})

TAG_CERTAINTY, BASE_CERTAINTY, MORE_CERTAINTY = 0.95, 0.9, 0.6

# A-Z to lower case; digits, letters and all beyond ASCII are parts of words, the rest parts them.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
_TAGGED = re.compile(r"(?i)spdx[-_ ]license[-_ ]identifier\s*:[ \t]*([^\n\r]*)")
_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+:_-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def postfix(expression: str) -> list[str] | None:
    """A license expression in postfix order; None if it is not well formed.

    WITH binds tightest, then AND, then OR; a slash is an older OR. Two licenses in a row end the
    expression, as prose may follow.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        token = "or" if token == "/" else token.lower()
        if operand != (token == "(" or (token not in _RANK and token != ")")):
            if operand or token in _RANK:
                return None
            break
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif token in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def known(name: str) -> bool:
    """Whether a lower-case name is a license or exception of the list, or a reference of the text's own."""
    return name.removesuffix("+") in KNOWN or name in EXCEPTIONS or name in SAME or name.startswith(("licenseref-", "documentref-"))


def evaluate(expression: Sequence[str], allowed: frozenset[str]) -> tuple[set[str], bool] | None:
    """The labels in a postfix expression, and whether it can be met with allowed licenses alone.

    An exception behind WITH only adds rights, so the license decides.
    """
    stack: list[tuple[set[str], bool]] = []
    steps: dict[str, Callable[[bool, bool], bool]] = {"and": and_, "or": or_}
    for token in expression:
        if token not in _RANK:
            label = SAME.get(token, token)
            stack.append(({label}, label in allowed))
            continue
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if token == "with":
            if len(left) != 1 or len(right) != 1:
                return None
            stack.append(({f"{next(iter(left))}-with-{next(iter(right))}"}, left_ok))
        else:
            stack.append((left | right, steps[token](left_ok, right_ok)))
    return stack[0]


@cache
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, label in phrases:
        automaton.add_word(f" {phrase} ", (phrase, label))
    automaton.add_word(f" {TAG} ", (TAG, ""))
    automaton.make_automaton()
    return automaton


def places(words: Sequence[bytes], phrases: Mapping[str, str]) -> list[tuple[int, str, str]]:
    """``(first word, phrase, label)`` of every place of a phrase or tag, in order."""
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = sorted(
        (end - len(phrase) - 1, phrase, label)
        for end, (phrase, label) in _automaton(tuple(phrases.items())).iter(line)
    )
    out, word, upto = [], 0, 0
    for start, phrase, label in found:
        word += line.count(" ", upto, start)
        upto = start
        out.append((word, phrase, label))
    return out


def scan(text: str | None, base: Mapping[str, str], more: Mapping[str, str], allowed: frozenset[str]) -> dict:
    """What one text says about its license; see :func:`scan_licenses`."""
    words = words_of(text)
    found = places(words, {**more, **base})
    of_base = [(word, label) for word, phrase, label in found if phrase in base]
    labels = {label for _, phrase, label in found if phrase != TAG}
    verdicts, expressions, unknown = [], [], []
    if any(phrase == TAG for _, phrase, _ in found):
        for tagged in _TAGGED.findall(text):
            parsed = postfix(tagged)
            strange = parsed is None or not all(token in _RANK or token in allowed or known(token) for token in parsed)
            met = None if strange else evaluate(parsed, allowed)
            if met:
                expressions.append(" ".join(parsed))
                labels |= met[0]
                verdicts.append(met[1])
            else:
                unknown.append(tagged.strip())
    doubt = (1 - TAG_CERTAINTY) ** bool(verdicts) * (1 - BASE_CERTAINTY) ** bool(of_base)
    doubt *= (1 - MORE_CERTAINTY) ** any(phrase in more for _, phrase, _ in found)
    stated = verdicts or [label in allowed for label in labels]
    return {
        "n_words": len(words),
        "n_base": len(of_base),
        "first_word": min((w for w, _ in of_base), default=None),
        "last_word": max((w for w, _ in of_base), default=None),
        "base_labels": ",".join(sorted({label for _, label in of_base})),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 - doubt,
        "expressions": expressions,
        "unknown": unknown,
        "allowed": all(stated) if stated else None,
        "places": [{"word": w, "phrase": p, "label": l} for w, p, l in found],
    }


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("unknown", T.ArrayType(T.StringType())),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("word", T.LongType()), T.StructField("phrase", T.StringType()),
        T.StructField("label", T.StringType())]))),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.string())), ("unknown", pa.list_(pa.string())), ("allowed", pa.bool_()),
    ("places", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())]))),
])


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    base: Mapping[str, str] = BASE_PHRASES, more: Mapping[str, str] = MORE_PHRASES,
    allowed: Iterable[str] = ALLOWED,
) -> DataFrame:
    """One row per document: ``key`` and what its text says about its license.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels`` of the phrases of ``base``;
    ``labels`` of all phrases and expressions; ``score``, the certainty that there is a license (0: nothing
    found); ``expressions`` in postfix order; ``unknown``, what stands behind tags and is no expression
    of known names (it gives no label); ``allowed``, null where nothing is stated, from the tags if
    there are any and else from the notices, all of which must be met; ``places`` of every phrase and tag.
    A null or empty text has no words. Repeated rows are kept, other columns are not looked at.
    """
    base, more, allowed = dict(base), dict(more), frozenset(allowed)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = pa.array([scan(t, base, more, allowed) for t in part.column(1).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([part.column(0), *rows.flatten()], [key, *_RESULT.names])

    wanted = docs.select(key, text)
    return wanted.mapInArrow(batches, T.StructType([wanted.schema[key], *_RESULT.fields]))
