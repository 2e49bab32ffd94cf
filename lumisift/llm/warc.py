"""Web archives that hold each payload once, under its SHA-256.

A record is exact bytes: ``head`` (the WARC fields, their blank line, and the HTTP head of the block) and
``payload``. An archive is two tables in a folder:

``payloads``  ``(digest, payload, slices)``, one row per distinct payload
``heads``     ``(record_key, head, digest, type, refers_to, slice)``, one row per record

The original records come back by joining the two. A payload that very many records share is read into one slice
per ``SLICE_ROWS`` of them, so no task has to rebuild them all. Equal digests are held against a second,
independent hash of the bytes before anything is stored under them, and every payload is hashed again when it is read.

``write_warc`` and ``read_warc`` move records to and from ``.warc`` files, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumisift.plans.scratch import materialize

PAYLOADS = "digest string, payload binary, first_key long, records long, slices int"
HEADS = "record_key long, head binary, digest string, type string, refers_to long, slice int"

SLICE_ROWS = 4096
HOT_SHARE = 512

# Smaller payloads are cheaper to repeat than to refer to.
LEAST_REVISIT_BYTES = 100

# Parts of the file format.
VERSION = "WARC/1.1"
NEWLINE = "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(record_key, url, payload, digest)`` of pages: payload in UTF-8 (null: empty), digest in hex."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    return pages.select(
        F.col(key).cast("long").alias("record_key"), F.col(url).cast("string").alias("url"), body.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))


def stored_payloads(found: DataFrame) -> DataFrame:
    """``(digest, payload, first_key, records, same)`` per digest of ``(record_key, payload, digest)``.

    Copies are combined before they are shuffled, so each task sends a payload once. ``same`` is false where
    two different byte strings came under one digest.
    """
    second = F.xxhash64("payload")
    return found.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("record_key").alias("first_key"), F.count("*").alias("records"),
        ((F.min(second) == F.max(second)) & (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))).alias("same"))


def _record_id(key: Column, other: Column) -> Column:
    """A name from the key; from ``other`` for rows without one."""
    name = F.md5(F.coalesce(F.concat(F.lit("key "), key.cast("string")), other))
    parts = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """One field; none where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(NEWLINE)))


def _head(date: str) -> Column:
    """Fields and HTTP head of a record, from the columns of ``_typed``."""
    revisit = F.col("type") == "revisit"
    # A line break or a blank inside an address would end its field.
    address = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(RECORD_END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    fields = [
        F.lit(VERSION + NEWLINE), _line("WARC-Type", F.col("type")),
        _line("WARC-Record-ID", _record_id(F.col("record_key"), F.concat_ws(" ", "digest", "url"))),
        _line("WARC-Date", date), _line("WARC-Target-URI", address),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, _line("WARC-Profile", PROFILE)),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("refers_to"), F.lit("")))),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", length.cast("string")), F.lit(NEWLINE),
    ]
    return F.concat(F.concat_ws("", *fields), http).cast("binary")


def _typed(found: DataFrame, owners: DataFrame) -> DataFrame:
    """``found`` ``(record_key, url, digest, bytes)`` with type, the record a revisit refers to, and the payload's slice.

    Most payloads belong to one record and need no join. Digests with more than 1/512 of the records, fewer than
    512, are broadcast; the others are shuffled with the records, whose hot digests are out of the key by then.
    """
    shared = owners.where("records > 1").select("digest", "first_key", "records")
    total = found.count()
    hot = shared.where(F.col("records") * HOT_SHARE > total).select("digest", F.struct("first_key", "records").alias("hot"))
    cold = shared.where(F.col("records") * HOT_SHARE <= total).select(
        F.col("digest").alias("at"), F.struct("first_key", "records").alias("cold"))
    marked = found.join(F.broadcast(hot), "digest", "left")
    # Rows that are done take keys of their own, spread over all tasks.
    marked = marked.withColumn("at", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(
        F.concat(F.lit("done "), F.monotonically_increasing_id().cast("string"))))
    owned = marked.join(cold, "at", "left").withColumn("owner", F.coalesce("hot", "cold")).drop("at", "hot", "cold")
    first = F.col("owner.first_key")
    revisit = (F.col("bytes") >= LEAST_REVISIT_BYTES) & first.isNotNull() & ~first.eqNullSafe(F.col("record_key"))
    return owned.select(
        "record_key", "url", "digest", "bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("type"),
        F.when(revisit, first).alias("refers_to"),
        F.pmod(F.monotonically_increasing_id(), _slices(F.coalesce(F.col("owner.records"), F.lit(1)))).cast("int").alias("slice"))


def _slices(records: Column) -> Column:
    return F.ceil(records / F.lit(float(SLICE_ROWS))).cast("int")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive ``pages``, one record each, in ``folder``.

    Of records with equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes the one with the smallest key is a
    response and the others are revisits of it; all others are responses. Rows that repeat the smallest key are
    responses too; a row without a key is a revisit where a row with one has its payload. A null payload is
    empty, a null address leaves the field out; payloads are taken whole, however long, and other columns of
    ``pages``, whatever their names, are ignored. No pages give an empty archive.
    """
    found = captures(pages, key, url, payload)
    spark = pages.sparkSession
    once = stored_payloads(found)
    checked = once.withColumn("payload", F.when(F.col("same"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest"))).cast("binary")))
    checked.withColumn("slices", _slices(F.col("records"))).drop("same").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    owners = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select("digest", "first_key", "records")
    narrow = materialize(found.select("record_key", "url", "digest", F.octet_length("payload").alias("bytes")), "captures")
    typed = _typed(narrow, owners)
    typed.select("record_key", _head(date).alias("head"), "digest", "type", "refers_to", "slice").write.parquet(f"{folder}/heads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``(record_key, type, refers_to, head, digest, payload)`` of every record, payloads rebuilt by a join.

    Revisits come with the payload of the record they refer to. A payload whose bytes no longer have its digest
    fails the job; so does a record without a payload.
    """
    kept = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads").select(
        F.col("digest").alias("of"), "payload", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("in"))
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("missing or damaged payload "), F.col("digest"))).cast("binary"))
    heads = spark.read.schema(HEADS).parquet(f"{folder}/heads")
    joined = heads.join(kept, (F.col("digest") == F.col("of")) & (F.col("slice") == F.col("in")), "left")
    return joined.select("record_key", "type", "refers_to", "head", "digest", whole.alias("payload"))


def field(head: Column, name: str) -> Column:
    """The value of a WARC field of ``head``; null without one."""
    fields = F.substring_index(head.cast("string"), RECORD_END, 1)
    value = F.regexp_extract(fields, rf"(?i)\r\n{name}:[\x20\t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def record_bytes(type_: Column, head: Column, payload: Column) -> Column:
    """The record as it stands in a file, without the two line ends after it; revisits carry no payload."""
    return F.when(type_ == "revisit", head).otherwise(F.concat(head, payload))


def write_warc(records: DataFrame, folder: str, compressed: bool = True) -> None:
    """Write ``(type, head, payload)`` rows as ``.warc`` files, a record after the other, by Spark's text sink.

    The two line ends that close a record are the sink's line separator.
    """
    lines = records.select(record_bytes(F.col("type"), F.col("head"), F.col("payload")).cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip" if compressed else "none").text(folder)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, type, head, payload, broken)`` of the records in ``.warc`` or ``.warc.gz`` files.

    Files are split where a record's end meets the next one's first line, by Spark's text source, so large plain
    files are read by many tasks. ``broken`` marks a record whose length field disagrees with its bytes: a cut
    file, or a payload that holds a record end and a first line itself. ``head`` runs to the end of the HTTP head
    where the block has one. Every record is returned whole.
    """
    first = VERSION + NEWLINE
    raw = spark.read.option("lineSep", RECORD_END + first).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    # The separator took the first line of every record but a file's first; the last still has its end.
    begins = F.substring("value", 1, len(first)) == F.lit(first).cast("binary")
    raw = raw.withColumn("value", F.when(begins, F.col("value")).otherwise(F.concat(F.lit(first).cast("binary"), F.col("value"))))
    raw = raw.where(F.octet_length("value") > len(first))
    end = F.lit(RECORD_END).cast("binary")
    parts = raw.withColumn("fields_end", _bytes_to_end("value")).withColumn("stated", F.expr(
        "try_cast(regexp_extract(cast(substring(value, 1, fields_end) as string), '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)', 1) as int)"))
    block = F.expr("substring(value, fields_end + 1)")
    closed = (F.octet_length(block) == F.col("stated") + len(RECORD_END)) & (F.expr("substring(value, -4)") == end)
    there = parts.withColumn("block", F.when(closed, F.expr("substring(value, fields_end + 1, stated)")).otherwise(block))
    http = F.when(F.expr("substring(block, 1, 5)") == F.lit("HTTP/").cast("binary"), _bytes_to_end("block")).otherwise(0)
    head = F.expr("concat(substring(value, 1, fields_end), substring(block, 1, http_end))")
    return there.withColumn("http_end", http).select(
        "file", field(head, "WARC-Type").alias("type"), head.alias("head"), F.expr("substring(block, http_end + 1)").alias("payload"),
        (~(F.octet_length("block") == F.col("stated")).eqNullSafe(F.lit(True))).alias("broken"))


def _bytes_to_end(name: str) -> Column:
    """How many bytes of a binary column run to the end of its first blank line; 0 without one."""
    until = F.octet_length(F.substring_index(F.col(name).cast("string"), RECORD_END, 1))
    return F.when(until < F.octet_length(name), until + len(RECORD_END)).otherwise(0)
