"""Faults of conversations and their cheapest repair.

Rows are shuffled by conversation once and sorted inside the partitions; a conversation then streams through its task
in Arrow batches, so none is ever held whole. What stays of the rows gone by is a hash per distinct row, a letter per
stack of the parser, and the running hash of the repaired text, which like every SHA-256 has to be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumisift.llm.role_grammar import DELETE, INSERT, KEEP, REROLE, Grammar, Repair

BLANK_CHARACTERS = "\x20\x09\x0a\x0b\x0c\x0d"
OUT_ROWS = 2000
LEGAL = ("su", "ua", "au")

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string, roles string")
_ARROW = pa.schema([
    ("conv_id", pa.int64()), *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("repaired_sha256", pa.string()), ("roles", pa.string())])


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, lost)``: rows dropped (``lost``), emptied, repeated or changed by a hash of their place.

    A null role or text is one space, and so is a null in the hashed place.
    """
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(place.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(
        F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("lost"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    end = F.rtrim("text", F.lit(BLANK_CHARACTERS))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), lost.alias("lost"),
    ).withColumn("last", F.substring(end, -1, 1))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


class _Conversation:
    """One conversation while its rows pass."""

    def __init__(self, conv_id: int | None, grammar: Grammar):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.before = None
        self.seen: set[bytes] = set()
        self.repair = Repair(grammar)

    def add(self, turn: int | None, role: str, text: str, last: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        row = f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass")
        row = hashlib.blake2b(row, digest_size=16).digest()
        blank, duplicate = not last, row in self.seen
        truncated = not blank and not duplicate and last not in ".!?"
        self.seen.add(row)
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        cost, audit, roles, digest = self.repair.result()
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest, roles)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grammar, now, done = Grammar(), None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*done), _ARROW)], schema=_ARROW)

    for batch in batches:
        for conv_id, turn, role, text, lost, last in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                    if len(done) == OUT_ROWS:
                        yield out()
                        done.clear()
                now = _Conversation(conv_id, grammar)
            if not lost:
                now.add(turn, role, text, last)
    if now is not None:
        done.append(now.result())
        yield out()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, and the cheapest repair, of each conversation in ``rows`` ``(conv_id, turn, role, text)``.

    Rows go by turn, nulls first, equal turns by role and text. Each row's first fault counts: ``blank`` (no text but
    blanks), ``duplicate`` (role and text seen before), ``truncated`` (does not end in ``.!?``). ``gaps`` counts turns
    that are missing between the first and the last, ``illegal`` neighbours whose role initials never follow each other.
    ``audit`` has a letter per edit: K keep, R give role user or assistant, D delete (blank and duplicate rows have to
    go), I insert an empty row. The repaired roles are none, or pairs of user and assistant after an optional system
    row; ``roles`` are their initials, ``repaired_sha256`` hashes the ``role:text`` lines. Equal costs go by the least audit.

    A null role or text is one space; a role is known by its first character, so an empty one is never kept. A null
    ``conv_id`` is a conversation of its own; null turns come first and are in no gap. Repeated rows are duplicates. Rows
    marked in an optional column ``lost`` count for nothing, but their conversation is still returned. Texts are taken
    whole, other columns ignored, and no rows give no result.
    """
    ordered = _ordered(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return ordered.mapInArrow(_stream, RESULT)


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the repaired conversations, from ``repairs`` of the same ``rows``.

    ``place`` counts from 0; inserted rows have an empty text. Deleted rows are not there.
    """
    by_conv = "PARTITION BY conv_id"
    numbered = _ordered(rows).where("NOT lost").selectExpr(
        "conv_id AS of", "role AS old_role", "text", f"row_number() OVER ({by_conv} ORDER BY turn ASC NULLS FIRST, role, text) AS n")
    edits = repairs.where("audit != ''").select("conv_id", "roles", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit != ''")
    upto = f"OVER ({by_conv} ORDER BY at ROWS UNBOUNDED PRECEDING)"
    placed = edits.selectExpr(
        "conv_id", "edit", "roles", f"count_if(edit != '{INSERT[0]}') {upto} AS n", f"count_if(edit != '{DELETE[0]}') {upto} - 1 AS place"
    ).where(F.col("edit") != DELETE[0])
    met = placed.join(numbered, placed.conv_id.eqNullSafe(numbered.of) & (placed.n == numbered.n) & (placed.edit != INSERT[0]), "left")
    initial = F.expr("substring(roles, cast(place + 1 as int), 1)")
    role = F.when(F.col("edit") == KEEP[0], F.col("old_role")).when(initial == "u", "user").otherwise("assistant")
    return met.select("conv_id", "place", "edit", role.alias("role"), F.when(F.col("edit").isin(KEEP[0], REROLE[0]), F.col("text")).otherwise("").alias("text"))
