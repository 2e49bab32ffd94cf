"""Exact products of integer matrices out of float32 ones, by residue numbers.

Each prime gives one float32 product of the residues. With residues of at most ``h = (prime - 1) / 2`` either way,
sums of up to ``2**24 / h**2`` products are exact in float32, so columns are cut into parts of that many. The Chinese
remainder theorem then gives the integer, as digits of a mixed radix that are balanced around zero: sums of such digits
are the signed number itself, with no modulus to subtract.
"""

from __future__ import annotations

import numpy as np

EXACT = 2**24
LARGEST = 1021
SMALLEST = 127


def primes_for(bound: int) -> list[int]:
    """The largest primes up to ``LARGEST`` whose product tells all integers from ``-bound`` to ``bound`` apart."""
    found: list[int] = []
    product, n = 1, LARGEST
    while product <= 2 * bound:
        if n < SMALLEST:
            raise ValueError(f"integers up to {bound} need more primes than there are")
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)) and n % 2:
            found.append(n)
            product *= n
        n -= 1
    return found


def residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Entries of an int64 matrix modulo ``prime``, nearest to zero, in float32."""
    half = prime // 2
    return ((matrix + half) % prime - half).astype(np.float32)


def _centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Integers of at most 2**24 modulo ``prime``, near zero."""
    return values - np.float32(prime) * np.rint(values * np.float32(1.0 / prime))


def product_modulo(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """``left @ right.T`` modulo ``prime``, of matrices of ``residues``; integers near zero in float32."""
    part = EXACT // (prime // 2) ** 2
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], part):
        # What is centred is below 2 * prime, so it can be added up and centred again.
        total = _centred(total + _centred(left[:, at:at + part] @ right[:, at:at + part].T, prime), prime)
    return total


def reconstructed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The int64 matrix whose residues are ``parts``; exact where it lies within what ``primes`` can tell apart."""
    known = np.zeros(parts[0].shape, np.int64)
    radix, digits = 1, []
    for part, prime in zip(parts, primes):
        # The value of the digits so far, modulo this prime, is taken off; what is left is the next digit.
        rest, weight = part.astype(np.int64), 1
        for digit, earlier in zip(digits, primes):
            rest -= digit * weight
            weight = weight * earlier % prime
        half = prime // 2
        digit = (rest % prime * pow(radix, -1, prime) + half) % prime - half
        digits.append(digit)
        # Beyond 64 bits this wraps, and wraps back, as the sum itself fits.
        known += digit * np.int64((radix + 2**63) % 2**64 - 2**63)
        radix *= prime
    return known


class ResidueMatrix:
    """An int64 matrix with its residues, so that several products can be taken of it."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [residues(matrix, p) for p in primes]

    def __len__(self) -> int:
        return len(self.parts[0])

    def rows(self, low: int, high: int) -> "ResidueMatrix":
        some = object.__new__(ResidueMatrix)
        some.primes, some.parts = self.primes, [p[low:high] for p in self.parts]
        return some

    def scores(self, other: "ResidueMatrix") -> np.ndarray:
        """All inner products of the rows of the two, exact."""
        return reconstructed([product_modulo(a, b, p) for a, b, p in zip(self.parts, other.parts, self.primes)], self.primes)
