"""Fingerprints and checksums of file content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: bytes of the file head that enter the fingerprint.
HEAD_BYTES = 8192


def little_endian_long(value: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def content_fingerprint(content: Column | str, size: Column | str) -> Column:
    """SHA-256 of the file size and the first 8 KB. ``content`` may be the head only."""
    content = F.col(content) if isinstance(content, str) else content
    size = F.col(size) if isinstance(size, str) else size
    head = F.substring(content, 1, HEAD_BYTES)
    return F.sha2(F.concat(little_endian_long(size.cast("long")), head), 256)


def file_checksum(content: Column | str) -> Column:
    return F.sha2(content, 256)
