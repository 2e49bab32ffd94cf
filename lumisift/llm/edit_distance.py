"""Bit-parallel edit distance, for whole strings within a limit and for a pattern anywhere in a text.

A column of the distance table is two numbers, in which bit i says whether the entry of
pattern character i is one more, or one less, than the one above. A few operations on whole
numbers move on by a character of the text.
"""

from __future__ import annotations


def _places(pattern: str) -> dict[str, int]:
    places: dict[str, int] = {}
    for i, char in enumerate(pattern):
        places[char] = places.get(char, 0) | 1 << i
    return places


def within(one: str, two: str, limit: int) -> int | None:
    """Edit distance of two strings if it is at most ``limit``, else None.

    Equal ends are cut off first; the column is a band of ``2 * limit + 1`` entries around the
    diagonal, which moves down by one with each character.
    """
    if abs(len(one) - len(two)) > limit:
        return None
    if one == two:
        return 0
    if len(one) > len(two):
        one, two = two, one
    low, short = 0, len(one)
    while low < short and one[low] == two[low]:
        low += 1
    high = 0
    while high < short - low and one[-1 - high] == two[-1 - high]:
        high += 1
    one, two = one[low:short - high], two[low:len(two) - high]
    if not one:
        return len(two)
    # Entry i of the band at text position j belongs to pattern position j - limit + i; those before it are 0.
    width = 2 * limit + 1
    full = (1 << width) - 1
    places = {char: bits << limit for char, bits in _places(one).items()}
    up, down = full >> limit << limit, 0
    score = min(limit, len(one))
    for j, char in enumerate(two):
        equal = (places.get(char, 0) >> j) & full
        step = (((equal & up) + up) ^ up) | equal | down
        more, less = down | ~(step | up) & full, step & up
        # The band's last entry: it moves along the diagonal while there is a pattern below, then to the right.
        bottom = limit + len(one) - 1 - j
        if bottom >= width - 1:
            score += not step >> (width - 1) & 1
        else:
            score += (more >> bottom & 1) - (less >> bottom & 1)
        if score > 3 * limit:
            return None
        shifted = step >> 1
        up = (less | ~(shifted | more) & full) & full
        down = shifted & more
    return score if score <= limit else None


def search(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the best match of a whole pattern anywhere in a text, if within ``limit``.

    The match may start anywhere; among equal distances the first end counts.
    """
    if not pattern:
        return 0, 0
    places, top = _places(pattern), 1 << len(pattern) - 1
    full = (1 << len(pattern)) - 1
    up, down, score = full, 0, len(pattern)
    best: tuple[int, int] | None = None
    for j, char in enumerate(text):
        equal = places.get(char, 0)
        step = (((equal & up) + up) ^ up) | equal | down
        more, less = down | ~(step | up) & full, step & up
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(step | more)) & full, step & more
        if score <= limit and (best is None or score < best[0]):
            best = score, j + 1
            if not score:
                break
    return best
