"""Packing token sequences into as few bins as it can: bin completion over the lengths of all pieces.

What must be decided depends on how many pieces there are of each length, and on nothing else. So the
pieces are made and counted on the cluster, the counts (at most one per length up to the capacity) are
packed on the driver, and the cluster gives every piece the place that its rank among the pieces of its
length has in that plan.

The search takes the largest piece left, lists the undominated sets of pieces that fill its bin, least
waste first, and packs one of them as often as the counts allow. It goes back where the waste so far rules
out a better end than the incumbent, which at first is the best-fit solution, and stops at the lower bound
or after ``NODES`` steps.

Defined results: a NULL text is empty, one piece of the end token; repeated rows are packed each; documents
without an id are packed like others; an empty table gives an empty result; columns that are not named
stay unread; a very long text is many pieces.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.llm.tokens import encoder, public_path
from tidemark.session import settle

CAPACITY = 2048
NODES = 5000
#: Fillings tried at a step of the first search, each later one tries four times as many; firsts of a triple
#: that are looked up before the table of sums is made, which has all fillings.
FILLINGS, FIRSTS = 3, 24

Counts = dict[int, int]
Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def lower_bound(counts: Counts, capacity: int) -> int:
    """Bins that any packing needs: by volume, and for each k where pieces over ``capacity - k`` bar those
    from k on."""
    c = np.zeros(capacity + 1, np.int64)
    for n, m in counts.items():
        c[n] = m
    n = np.arange(capacity + 1)
    number, volume = np.cumsum(c), np.cumsum(n * c)
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    alone = number[capacity] - number[capacity - k]
    big = number[capacity - k] - number[half]
    room = capacity * big - (volume[capacity - k] - volume[half])
    small = volume[half] - np.where(k > 0, volume[k - 1], 0)
    return max(-(-int(volume[capacity]) // capacity), int((alone + big + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit(counts: Counts, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest bin with room; bins with the same content move together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # by room
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, many: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append((pattern, many))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            room = rooms[i] if i < len(rooms) else None
            if room is None:
                each = min(capacity // n, left)
                whole_bins = left // each
                put(capacity - n * each, ((n, each),), whole_bins)
                left -= whole_bins * each
                continue
            pattern, many = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[i]
            each = min(room // n, left)
            used = min(many, left // each)
            if used < many:
                put(room, pattern, many - used)
            put(room - n * each, (*pattern, (n, each)), used)
            left -= used * each
    return [b for group in bins.values() for b in group]


def _pairs(now: np.ndarray, total: int, most: int) -> list[tuple[int, int]]:
    """Up to ``FILLINGS`` pairs (a, b) of this sum with most >= a >= b, longest a first."""
    low, high = (total + 1) // 2, min(total - 1, most)
    if high < low:
        return []
    a = np.arange(high, low - 1, -1)
    fits = (now[a] > 0) & (now[total - a] > (2 * a == total))
    return [(int(x), total - int(x)) for x in a[np.flatnonzero(fits)[:FILLINGS]]]


def _exact(now: np.ndarray, fit: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """Some pairs and triples that leave no waste, looked up without a table."""
    yield from _pairs(now, room, fit[0])
    for a in fit[:FIRSTS] if room > fit[-1] else ():
        now[a] -= 1
        pairs = _pairs(now, room - a, a)
        now[a] += 1
        yield from ((a, *pair) for pair in pairs)


def _sums(fit: list[int], copies: list[int], room: int) -> list[int]:
    """Bit s of entry i tells whether pieces of the i longest lengths, as many as there are, sum to s."""
    inside, reached = (1 << (room + 1)) - 1, [1]
    for n, c in zip(fit, copies):
        sums, c, k = reached[-1], min(c, room // n), 1
        while c:
            k = min(k, c)
            sums |= sums << n * k
            c -= k
            k *= 2
        reached.append(sums & inside)
    return reached


def fillings(now: np.ndarray, lengths: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """Every set of pieces for ``room`` that can take no more piece, least waste first, of any number of pieces.

    A single piece that leaves no waste dominates all else. Some pairs and triples without waste come
    first; all others are read back from a table of the sums that the pieces reach, for each waste those
    that do without the short pieces first. A waste at which a piece still fits is only met by sets that
    hold all pieces so short.
    """
    fit = lengths[bisect.bisect_left(lengths, -room, key=lambda n: -n) :]  # longest first
    if not fit:
        yield ()
        return
    if now[room]:
        yield (room,)
        return
    seen, copies = set(), now[fit].tolist()
    for filling in _exact(now, fit, room):
        if filling not in seen:
            seen.add(filling)
            yield filling
    reached = _sums(fit, copies, room)
    long, held = len(fit), 0  # lengths above the waste; sum of all pieces that are not
    for waste in range(room + 1):
        while long and fit[long - 1] <= waste:
            long -= 1
            held += fit[long] * copies[long]
        rest = room - waste - held
        if rest < 0:
            return
        if not reached[long] >> rest & 1:
            continue
        short = tuple(n for n, c in zip(fit[long:], copies[long:]) for _ in range(c))
        todo = [(long, rest, short)]
        while todo:
            i, rest, chosen = todo.pop()
            while rest and reached[i - 1] >> rest & 1 and not (fit[i - 1] <= rest and any(
                    reached[i - 1] >> rest - k * fit[i - 1] & 1 for k in range(1, min(copies[i - 1], rest // fit[i - 1]) + 1))):
                i -= 1
            if not rest:
                if chosen not in seen:
                    yield chosen
                continue
            n = fit[i - 1]
            for k in range(min(copies[i - 1], rest // n), -1, -1):
                if reached[i - 1] >> rest - k * n & 1:
                    todo.append((i - 1, rest - k * n, (n,) * k + chosen))


def complete(counts: Counts, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how many bins have each, covering all of ``counts``; the best of search and best fit."""
    counts = {n: c for n, c in counts.items() if c}
    incumbent = best_fit(counts, capacity)
    fewest, bound, total = sum(m for _, m in incumbent), lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    now = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        now[n] = c

    def options(width: int) -> Iterator[tuple[Pattern, int] | None]:
        """Ways to fill the bin of the longest piece left, then None if there are more than ``width``.

        Only called on while the counts are those of the first call. A table of sums is not kept in
        between: the search is thousands of bins deep.
        """
        lengths = np.flatnonzero(now)[::-1].tolist()
        first, done, until = lengths[0], 0, FILLINGS
        while True:
            now[first] -= 1
            sets = list(itertools.islice(fillings(now, lengths if now[first] else lengths[1:], capacity - first), done, until + 1))
            now[first] += 1
            for filling in sets[: until - done]:
                need = collections.Counter((first, *filling))
                yield tuple(sorted(need.items(), reverse=True)), min(int(now[n]) // k for n, k in need.items())
            if len(sets) <= until - done:
                return
            if until == width:
                yield None
                return
            done, until = until, min(2 * until, width)

    def take(way: tuple[Pattern, int], sign: int) -> None:
        for n, k in way[0]:
            now[n] -= sign * way[1] * k

    steps, width, more = 0, FILLINGS, True
    while more and counts and steps < nodes and fewest > bound:
        more, chosen, wasted, stack = False, [], [0], [options(width)]
        while stack and steps < nodes and fewest > bound:
            way = next(stack[-1], ())
            if way is None:
                more = True
                continue
            if not way:
                stack.pop()
                if chosen:
                    take(chosen.pop(), -1)
                    wasted.pop()
                continue
            steps += 1
            pattern, many = way
            waste = wasted[-1] + many * (capacity - sum(n * k for n, k in pattern))
            if waste > (fewest - 1) * capacity - total:
                continue
            take(way, 1)
            chosen.append(way)
            wasted.append(waste)
            if now.any():
                stack.append(options(width))
                continue
            incumbent, fewest = list(chosen), sum(m for _, m in chosen)
            take(chosen.pop(), -1)
            wasted.pop()
        width *= 4
    return incumbent


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32 (and ids, if asked), and the row's number among those of its
    length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, known = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            rows, out, held = [], [], []
            for i, ids in enumerate(known.documents(batch.column(batch.num_columns - 1))):
                for j, (start, length) in enumerate(_cut(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    rows.append(i)
                    out.append((j, start, length, zlib.crc32(own), part, seen[length]))
                    held += [own] if with_ids else []
                    seen[length] += 1
            taken = pa.array(rows, pa.int64())
            types = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            if with_ids:
                made.append(pa.array(held, pa.binary()))
            names = ["piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(taken) for k in range(batch.num_columns - 1)], *made], [*batch.schema.names[:-1], *names])

    kept = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], whole(text).alias("_text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    made = kept.mapInArrow(run, f"{types}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * with_ids)
    return made


def pack(
    docs: DataFrame, keep: list[str], tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text",
    with_ids: bool = False, nodes: int = NODES,
) -> DataFrame:
    """``keep``, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row of ``docs``."""
    spark = docs.sparkSession
    rows = settle(pieces(docs, keep, tokenizer or public_path(), capacity, text, with_ids), "pieces")
    per_part = settle(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table, sequence = [], 0
    first = dict.fromkeys(counts, 0)
    for pattern, many in complete(counts, capacity, nodes):
        at = 0
        for n, k in pattern:
            table.append((n, first[n], first[n] + many * k, k, sequence, at))
            first[n] += many * k
            at += n * k
        sequence += many
    # At most `capacity` patterns of at most sqrt(2 * capacity) lengths each, so the table's size is bounded.
    plan = spark.createDataFrame(table, "p_length bigint, low bigint, high bigint, copies bigint, sequence bigint, at bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(F.col("part").alias("o_part"), F.col("length").alias("o_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # A row per partition and length: no bound on its size, so it is not broadcast however small its files are.
    ranked = rows.join(offsets.hint("merge"), (F.col("part") == F.col("o_part")) & (F.col("length") == F.col("o_length")))
    rank = F.col("before") + F.col("nth")
    placed = ranked.withColumn("rank", rank).join(
        F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        (F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + F.pmod(F.col("rank") - F.col("low"), F.col("copies")) * F.col("length")).alias("offset"),
    )
