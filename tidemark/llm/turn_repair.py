"""Repair of a conversation's structure at the least cost, by Four-Russians block tables.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Rows may be kept (0), given the role
user or assistant (2), or deleted (3, the only choice for blank and repeated rows), rows without text may be
inserted (2), and a truncated row that is not deleted adds 1. For the rest of a conversation from some row on,
the costs from the four states of that pattern form a vector. Less its minimum it is one of few vectors, for no
state is worth much more than another. So a table holds, for each of these vectors and each block of ``BLOCK``
row symbols, the vector before the block and what the minimum grows by. A conversation is read from its end, one
lookup per block; rows that fill no block come first and take a table of one symbol.

The trace starts at the first row: each block is expanded backward from the vector behind it, and then the least
letter of D(elete), I(nsert), K(eep) and R(erole) that still reaches the least cost is taken. So of all cheapest
edits it gives those whose letters come first.

A conversation is judged in one ordered stream of its rows without their texts, about a hundred bytes in memory
for a row, and repaired in another one of whole rows that keeps its letters alone.

Defined results: NULL roles and texts are one space; a role with another initial, or none, cannot be kept; rows of
one turn lie in order of role and text hash, NULL turns first; rows without a conv_id are one conversation;
repeated rows beyond the first are faults; a conversation all of whose rows are gone has zeros and no letters; an
empty table gives an empty result; very long texts never lie in memory but one at a time; columns that are not
named stay unread.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}

#: States of the pattern: nothing yet, after s, after u, after ua. What is inserted there, and what follows it.
_ENDS = (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_PUT = ("u", "u", "a", "u")
#: A symbol: must go, or an initial (none that counts first) and whether the row is truncated.
_SYMBOLS: list[tuple[str, bool] | None] = [None, *itertools.product(("", "s", "u", "a"), (False, True))]
_CODES = {s: i for i, s in enumerate(_SYMBOLS)}
_NEVER = 1 << 20


def _options(state: int, symbol: tuple[str, bool] | None) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row."""
    ways = [("D", DELETE, state)]
    if symbol is not None:
        initial, short = symbol
        if (state, initial) in _NEXT:
            ways.append(("K", KEEP + TRUNCATED * short, _NEXT[state, initial]))
        if initial != _PUT[state]:
            ways.append(("R", REROLE + TRUNCATED * short, _NEXT[state, _PUT[state]]))
    return ways


def _closed(costs: list[int]) -> tuple[int, ...]:
    """With rows inserted wherever that is cheaper."""
    while True:
        better = [min(c, INSERT + costs[_NEXT[q, _PUT[q]]]) for q, c in enumerate(costs)]
        if better == costs:
            return tuple(costs)
        costs = better


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]  # costs from each state, less their minimum; the first is that of no rows
    one: np.ndarray  # vector before a symbol, by the vector behind it and the symbol
    one_grows: np.ndarray
    before: np.ndarray  # the same for a block, first symbol most significant
    grows: np.ndarray


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    """Every vector that can occur and the transitions of all blocks of symbols."""
    vectors = [_closed([0 if q in _ENDS else _NEVER for q in range(len(_PUT))])]
    known, one, grows = {vectors[0]: 0}, [], []
    for vector in vectors:  # grows while it is read
        ids, more = [], []
        for symbol in _SYMBOLS:
            costs = _closed([min(c + vector[to] for _, c, to in _options(q, symbol)) for q in range(len(_PUT))])
            least = min(costs)
            own = tuple(c - least for c in costs)
            if own not in known:
                known[own] = len(vectors)
                vectors.append(own)
            ids.append(known[own])
            more.append(least)
        one.append(ids)
        grows.append(more)
    single, step = np.array(one, np.int32), np.array(grows, np.int32)
    before, total = np.arange(len(vectors), dtype=np.int32)[:, None], np.zeros((len(vectors), 1), np.int32)
    for _ in range(block):  # put one more symbol in front
        total = (total[:, None, :] + step[before].transpose(0, 2, 1)).reshape(len(vectors), -1)
        before = single[before].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, single, step, before, total)


def cheapest(symbols: bytes | bytearray, block: int = BLOCK) -> tuple[int, str]:
    """The least cost of a conversation with these row symbols, and the first of its cheapest edits by letters."""
    t, n = tables(block), len(symbols)
    head = n % block
    codes = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, block).astype(np.int64) @ (len(_SYMBOLS) ** np.arange(block - 1, -1, -1, dtype=np.int64))
    behind, vector, cost = np.zeros(len(codes), np.int32), 0, 0  # the vector behind each block
    for i in range(len(codes) - 1, -1, -1):
        behind[i] = vector
        cost += int(t.grows[vector, codes[i]])
        vector = int(t.before[vector, codes[i]])
    letters, state = [], 0
    pieces = [(bytes(symbols[:head]), vector)] + [(bytes(symbols[head + i * block : head + (i + 1) * block]), int(v)) for i, v in enumerate(behind)]
    for k, (own, after) in enumerate(pieces):
        vectors, grown = [after], []
        for s in reversed(own):  # expand the block backward
            grown.append(int(t.one_grows[vectors[-1], s]))
            vectors.append(int(t.one[vectors[-1], s]))
        if k == 0:
            cost += sum(grown) + t.vectors[vectors[-1]][0]
        for i, s in enumerate(own):
            here, there, more = t.vectors[vectors[len(own) - i]], t.vectors[vectors[len(own) - i - 1]], grown[len(own) - i - 1]
            while True:
                ways = [w for w in _options(state, _SYMBOLS[s]) if w[1] + there[w[2]] == here[state] + more]
                put = _NEXT[state, _PUT[state]]
                letter, state = min([(w[0], w[2]) for w in ways] + [("I", put)] * (INSERT + here[put] == here[state]))
                letters.append(letter)
                if letter != "I":
                    break
    while t.vectors[0][state]:
        letters.append("I")
        state = _NEXT[state, _PUT[state]]
    return cost, "".join(letters)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``times`` (how often the row is there, 0 to 2) by a hash of conversation and turn."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the order that both streams of a conversation share."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    same = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), same.alias("same"), "times")


def _in_turn(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.asc_nulls_first("turn"), "role", "same")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Judge:
    """What is known of the conversation at hand while its rows pass by."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.symbols, self.seen = conv_id, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, initial: str, same: bytes, blank: bool, short: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        again = same in self.seen
        self.seen.add(same)
        if blank or again:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            self.symbols.append(_CODES[None])
            return
        self.truncated += short
        self.symbols.append(_CODES[initial if initial in ("s", "u", "a") else "", short])

    def result(self) -> tuple:
        cost, audit = cheapest(self.symbols)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation in ``rows``.

    ``rows`` has conv_id, turn, role, text and times; rows of no times only say that the conversation exists.
    """
    kind = rows.schema["conv_id"].dataType
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [arrow, *[pa.int64()] * len(_COUNTS), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv_id", *_COUNTS, "audit"])

        for batch in batches:
            for conv_id, turn, _, same, initial, blank, short, times in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Judge(conv_id)
                for _ in range(times):
                    now.add(turn, initial, same, blank, short)
            if done:
                yield made()
                done.clear()
        if now is not None:
            done.append(now.result())
            yield made()

    end = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = _keyed(rows).select(
        "conv_id", "turn", "role", "same", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("short"), "times")
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return _in_turn(narrow).mapInArrow(run, f"conv_id {kind.simpleString()}, {counts}, audit string")


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role and text of every row after the edits that ``judged`` (of ``audits``) names.

    The rows of a conversation lie in one partition, in order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, state, place, at = "", 0, 0, 0
        for batch in batches:
            out = []

            def put(role: str, text: str) -> None:
                nonlocal state, place
                state, place = _NEXT[state, role[0]], place + 1
                out.append((conv_id, place, role, text))

            def inserted() -> None:
                nonlocal at
                while at < len(letters) and letters[at] == "I":
                    put(ROLES[_PUT[state]], "")
                    at += 1

            for conv_id, audit, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times"))):
                if audit is not None:
                    letters, state, place, at = audit, 0, 0, 0
                    inserted()
                    continue
                for _ in range(times):
                    letter, at = letters[at], at + 1
                    if letter != "D":
                        put(role if letter == "K" else ROLES[_PUT[state]], text)
                    inserted()
            if out:
                columns = list(zip(*out))
                types = (arrow, pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text"])

    said = judged.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("binary").alias("same"), F.lit(0).alias("times"), "audit")
    all_rows = said.unionByName(_keyed(rows).withColumn("audit", F.lit(None).cast("string")))
    return _in_turn(all_rows, F.asc_nulls_last("audit")).mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the sha256 of ``role:text``, joined by newlines, of conversations as ``repaired`` returns them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, done = None, None, []

        def made() -> pa.RecordBatch:
            ids, texts = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(list(ids), arrow), pa.array(list(texts), pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 1:
                    if now is not None:
                        done.append((conv, now.hexdigest()))
                    now, conv = hashlib.sha256(), conv_id
                now.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            if done:
                yield made()
                done.clear()
        if now is not None:
            done.append((conv, now.hexdigest()))
            yield made()

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """The audit of every conversation with the digest of its repaired rows."""
    judged = audits(rows)
    hashed = digests(repaired(rows, judged)).withColumnRenamed("conv_id", "_conv")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return judged.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        *judged.columns, F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
