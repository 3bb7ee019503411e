"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five words; its weight in a text is its count there times ``ln(1 + N / df)``. The document
frequency is counted over all documents in a count-min sketch of fixed size, so it is never too low and
too high by a fixed share of N (0.2 % or so) at any corpus size; the sketch is the only thing that is
broadcast. The similarity of two texts is the weighted Jaccard measure of these weights. Each text gets
``BANDS * ROWS`` samples whose chance to agree between two texts is that similarity. Texts that agree
in all rows of a band are candidates, and a pair is linked only if its similarity itself is high enough.

Where a third of all documents are copies of one text, their common shingles weigh a quarter of an edit's,
so that the weights part what is nearly equal. On request (``plain``) a pair is also linked if the Jaccard measure of
its sets of shingles is that high, and each text gets as many bands again, of minimum hashes of its set.

Texts that are equal stand for one vertex. Every vertex is first compared with the one leader that it
shares most bands with. Where a bucket of a band then still holds more than one component, its members
of different components are compared too, in blocks, so no candidate pair that matters is left out and
none is written out; pairs inside a component need no comparison, for the classes are the components, and
the blocks of a bucket's largest component are not put against each other.

Defined results: a document without words (NULL or empty text too) is in a class of its own; a class is
named by its smallest doc_id, NULL if none of its documents has one; repeated rows are equal texts; an
empty table gives an empty result; very long texts are read whole; columns that are not named stay unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.llm.graph import components
from tidemark.llm.shingles import mixed, shingle_hashes
from tidemark.session import settle

SIMILARITY = 0.8
BANDS, ROWS = 14, 3
#: The sketch has DEPTH rows of 2^WIDTH_BITS cells, 4 MB as 32-bit counts.
DEPTH, WIDTH_BITS = 4, 18
_CELLS, _PIECE = DEPTH << WIDTH_BITS, 1 << 14
#: Members of a bucket that one task compares with each other or with another block.
BLOCK = 256

_rng = np.random.default_rng(20240807)
_SEEDS = _rng.integers(1, 1 << 63, DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_BITS = 16
_R = _rng.gamma(2.0, 1.0, 1 << _TABLE_BITS).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << _TABLE_BITS)).astype(np.float32)
_BETA = _rng.random(1 << _TABLE_BITS).astype(np.float32)
_DRAWS = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OVER_R = 1 / _R
#: Shingles that a signature looks at together, so that what it computes stays near the processor.
_TOGETHER = 1 << 11
#: Parts that the shingles of a text are summed in, for a bound of how alike two texts can be.
_PARTS = 10
_PLAIN_DRAWS = _rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _cells(hashes: np.ndarray) -> np.ndarray:
    """For each row of the sketch the cell of each hash."""
    inside = (hashes[None, :] * _SEEDS[:, None]) >> np.uint64(64 - WIDTH_BITS)
    return inside.astype(np.int64) + (np.arange(DEPTH, dtype=np.int64) << WIDTH_BITS)[:, None]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's texts -> its part of the sketch, cells that are not zero only; piece -1 counts documents."""
    counts, docs, some, held = np.zeros(_CELLS, np.int64), 0, [], 0

    def add() -> None:
        nonlocal held
        if some:
            counts[:] += np.bincount(_cells(np.concatenate(some)).ravel(), minlength=_CELLS)
            some.clear()
            held = 0

    for batch in batches:
        for hashes in shingle_hashes(batch.column(0)):
            if len(hashes):
                docs += 1
                some.append(np.unique(hashes))
                held += len(some[-1])
                if held > 1 << 19:
                    add()
    add()
    if docs:
        pieces, at, n = [-1], [np.zeros(1, np.uint16).tobytes()], [np.array([docs], np.int64).tobytes()]
        for p in range(_CELLS // _PIECE):
            own = counts[p * _PIECE : (p + 1) * _PIECE]
            filled = np.flatnonzero(own)
            if len(filled):
                pieces.append(p)
                at.append(filled.astype(np.uint16).tobytes())
                n.append(own[filled].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["piece", "at", "n"])


def _add_pieces(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_PIECE, np.int64)
    for part in batches:
        for at, n in zip(part["at"], part["n"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    yield pd.DataFrame({"piece": [key[0]], "n": [np.minimum(total, (1 << 62)).tobytes()]})


class Sketch:
    """Document frequencies of all shingles of a corpus and its number of documents with words."""

    def __init__(self, docs: int, counts: np.ndarray) -> None:
        self.docs, self.counts = docs, counts

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text") -> Sketch:
        """Counted over every partition of ``docs``; 8 MB reach the driver whatever the corpus holds."""
        parts = docs.select(whole(text).alias("text")).mapInArrow(_count_batches, "piece int, at binary, n binary")
        summed = parts.groupBy("piece").applyInPandas(_add_pieces, "piece int, n binary").collect()
        counts, n = np.zeros(_CELLS, np.int64), 0
        for piece, values in summed:
            values = np.frombuffer(values, np.int64)
            if piece < 0:
                n = int(values[0])
            else:
                counts[piece * _PIECE : (piece + 1) * _PIECE] = values
        return cls(n, counts)

    def weights(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of a text in ascending order and their TF-IDF weights."""
        found, tf = np.unique(hashes, return_counts=True)
        df = np.maximum(self.counts[_cells(found)].min(axis=0), 1)
        return found, (tf * np.log1p(self.docs / df)).astype(np.float32)


def signature(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The hash of each band of the text's weighted samples."""
    log_w, k = np.log(weights), np.arange(BANDS * ROWS)
    best = np.full(BANDS * ROWS, np.inf, np.float32)
    sample = np.zeros(BANDS * ROWS, np.uint64)
    for at in range(0, len(found), _TOGETHER):
        h, lw = found[at : at + _TOGETHER], log_w[at : at + _TOGETHER]
        draw = ((h[None, :] * _DRAWS[:, None]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        offset = _BETA.take(draw)
        t = lw * _OVER_R.take(draw)
        t += offset
        np.floor(t, out=t)
        steps = t - offset
        steps += 1
        steps *= _R.take(draw)
        log_a = _LOG_C.take(draw)
        log_a -= steps
        least = log_a.argmin(axis=1)
        value = log_a[k, least]
        better = value < best
        pair = mixed(h[least] + t[k, least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sample[better], best[better] = pair[better], value[better]
    return _banded(sample, 1)


def plain_signature(found: np.ndarray) -> np.ndarray:
    """The hash of each band of the minimum hashes of the text's set of shingles."""
    sample = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 13):
        np.minimum(sample, (_PLAIN_DRAWS[:, None] * found[None, at : at + (1 << 13)]).min(axis=1), out=sample)
    return _banded(sample, BANDS + 1)


def _banded(sample: np.ndarray, first: int) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS)
    band = np.arange(first, first + BANDS, dtype=np.uint64)
    for i in range(ROWS):
        band = mixed(band * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return band.astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], both: float | None = None) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingles and weights; ``both`` is the sum of all their weights."""
    if both is None:
        both = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64)
    return low / (both - low) if both > low else 0.0


def _in_parts(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weights of each text summed by the first bits of their shingles. Two texts share at most what the lesser sums say."""
    parts = np.zeros((len(rows), 1 << _PARTS), np.float32)
    for own, (found, weights) in zip(parts, rows):
        own += np.bincount((found >> np.uint64(64 - _PARTS)).astype(np.int64), weights, 1 << _PARTS)
    return parts


def _alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similar: float, plain: float | None, both: float | None = None) -> bool:
    """Whether two texts are linked, by their sets if ``plain`` is given, or by their weights."""
    if plain is not None and min(len(a[0]), len(b[0])) >= plain * max(len(a[0]), len(b[0])) - 1:
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        if both / (len(a[0]) + len(b[0]) - both) >= plain:
            return True
    return similarity(a, b, both) >= similar


def _with(docs: DataFrame, sketch, make: Callable, schema: str) -> DataFrame:
    """Apply ``make(found, weights)`` to the text (the last column) of each document; the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Sketch = sketch.value
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [make(*known.weights(h)) if len(h) else None for h in shingle_hashes(batch.column(batch.num_columns - 1))]
            fields = [x for x in zip(*[m if m is not None else [None] * len(new) for m in made])] if made else [[]] * len(new)
            columns += [pa.array(list(f), t) for f, (_, t) in zip(fields, new)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *[n for n, _ in new]])

    types = {"array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    new = [(n, types[t]) for n, t in (part.split() for part in schema.split(", "))]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kept}, {schema}")


def _bands(found: np.ndarray, weights: np.ndarray) -> list:
    return [signature(found, weights)]


def _all_bands(found: np.ndarray, weights: np.ndarray) -> list:
    return [np.concatenate([signature(found, weights), plain_signature(found)])]


def _payload(found: np.ndarray, weights: np.ndarray) -> list:
    return [found.tobytes(), weights.tobytes()]


def _read(found: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(found, np.uint64), np.frombuffer(weights, np.float32)


def _star_frames(similar: float, plain: float | None) -> Callable:
    """A leader and some of its members -> the links between them."""

    def run(leader: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        own = _read(leader["l_found"][0], leader["l_weights"][0])
        linked = [_alike(own, _read(f, w), similar, plain) for f, w in zip(members["found"], members["weights"])]
        return pd.DataFrame({"a": leader["l_leader"][0], "b": members["v"][linked]}).astype("int64")

    return run


def _verify_block(similar: float, plain: float | None) -> Callable:
    """Members of different components in one bucket (or two blocks of it) -> links that join components."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["side", "v"]).reset_index(drop=True)
        rows = [_read(f, w) for f, w in zip(part["found"], part["weights"])]
        total = np.array([w.sum(dtype=np.float64) for _, w in rows])
        component, v, side = part["component"].tolist(), part["v"].to_numpy(), part["side"].to_numpy()
        before = part["component"].to_numpy()
        parent = {c: c for c in component}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        parts = _in_parts(rows) if plain is None else None
        links, left, two = [], len(parent), len(set(side)) > 1
        for i in range(len(rows)):
            if left == 1:
                break
            later = np.arange(i + 1, len(rows))
            later = later[(before[later] != before[i]) & ((side[later] != side[i]) | (not two))]
            if plain is None:
                # Of the others only those whose bound allows the similarity, with room for rounding.
                later = later[np.minimum(total[i], total[later]) >= similar * np.maximum(total[i], total[later]) * 0.999]
                most = np.minimum(parts[i], parts[later]).sum(axis=1, dtype=np.float64)
                later = later[most >= similar * (total[i] + total[later] - most) * 0.999]
            for j in later.tolist():
                a, b = root(component[i]), root(component[j])
                if a != b and _alike(rows[i], rows[j], similar, plain, total[i] + total[j]):
                    parent[max(a, b)] = min(a, b)
                    left -= 1
                    links.append((v[i], v[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similar: float = SIMILARITY, plain: float | None = None) -> DataFrame:
    """One row per document: ``id``, ``text_md5`` (binary), ``wordless``, ``class`` and ``class_id``.

    ``class`` is NULL for wordless documents. Without ``plain`` only the weights count.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.unhex(F.md5(whole(text).cast("binary"))).alias("text_md5"), whole(text).alias("text"))
    sketch = spark.sparkContext.broadcast(Sketch.of(docs, text))
    signed = settle(_with(rows, sketch, _bands if plain is None else _all_bands, "bands array<bigint>"), "bands")
    worded = signed.where(F.col("bands").isNotNull())
    firsts = worded.groupBy("text_md5").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"))
    vertices = settle(firsts.withColumn("v", F.monotonically_increasing_id()), "vertices")

    entries = vertices.select("v", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("v").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(entries.join(buckets, "bucket").select("v", "bucket", "leader"), "shared")
    led = shared.where("v <> leader").groupBy("v", "leader").agg(F.count(F.lit(1)).alias("bands"))
    star = led.groupBy("v").agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("leader"))
    star = settle(star, "star")

    # Weights are made again, for the texts that are compared only; equal texts have equal weights.
    asked = shared.select("v").distinct().join(vertices.select("v", "text_md5", "first_id"), "v")
    chosen = rows.join(asked.withColumnRenamed("text_md5", "_md5"), (F.col("text_md5") == F.col("_md5")) & F.col("id").eqNullSafe(F.col("first_id")))
    weighed = _with(chosen.select("v", "text"), sketch, _payload, "found binary, weights binary")
    weighed = settle(weighed.dropDuplicates(["v"]), "weighed")

    # A leader of many members would be one group: its members are dealt over groups of bounded size.
    sizes = star.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups"))
    dealt = settle(star.join(sizes, "leader").select("leader", "v", F.pmod(F.xxhash64("v"), F.col("groups")).alias("salt")), "dealt")
    members = dealt.join(weighed, "v").select("leader", "salt", "v", "found", "weights")
    own = weighed.toDF("l_leader", "l_found", "l_weights")
    leaders = dealt.select(F.col("leader").alias("l_leader"), F.col("salt").alias("l_salt")).distinct().join(own, "l_leader")
    links = leaders.groupBy("l_leader", "l_salt").cogroup(members.groupBy("leader", "salt")).applyInPandas(
        _star_frames(similar, plain), "a bigint, b bigint")
    links = settle(links, "links")
    parts = components(links)

    # Buckets that still hold several components; the same members in another band are the same work.
    placed = shared.join(parts, "v", "left").select("v", "bucket", F.coalesce("component", "v").alias("component"))
    placed = settle(placed, "placed")
    held = placed.groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"), F.bit_xor(F.xxhash64("v")).alias("mark"))
    mixed_up = held.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max_by("component", F.struct("n", "component")).alias("main"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.bit_xor("mark").alias("mark")).where("n > n_main")
    tried = star.select(F.col("leader").alias("first"), F.col("v").alias("last"), F.lit(2).cast("long").alias("n"))
    mixed_up = mixed_up.join(tried, ["first", "last", "n"], "left_anti")
    mixed_up = settle(mixed_up.groupBy("n", "first", "last", "mark").agg(F.min(F.struct("bucket", "main", "n_main")).alias("b")).select("b.*", "n"), "mixed-up")
    # The members of the largest component meet those outside it only, and these each other too. So a member is
    # copied once for each block of those outside, and the few outside once for each block of the rest.
    mains, others = F.ceil(F.col("n_main") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")
    rest = placed.join(mixed_up, "bucket").select(
        "v", "bucket", "component", (F.col("component") == F.col("main")).alias("inside"), mains.alias("mains"), others.alias("others"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("v"), F.when(F.col("inside"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    outer, own = F.sequence(F.lit(0), F.col("others") - 1), F.col("mains") + F.col("own")

    def meets(one, two, side):
        return F.struct(one.alias("one"), two.alias("two"), side.cast("int").alias("side"))

    with_outer = F.transform(outer, lambda j: meets(F.col("own"), F.col("mains") + j, F.lit(0)))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: meets(i, own, F.lit(1)))
    with_each = F.transform(outer, lambda j: meets(F.col("mains") + F.least("own", j), F.col("mains") + F.greatest("own", j), F.col("own")))
    rest = rest.select("v", "bucket", "component", F.inline(F.when(F.col("inside"), with_outer).otherwise(F.concat(with_main, with_each))))
    more = rest.join(weighed, "v").groupBy("bucket", "one", "two").applyInPandas(_verify_block(similar, plain), "a bigint, b bigint")
    parts = components(settle(links.union(more), "all-links"))

    # A class is named from its distinct texts. Both sides of each join are written tables, so a class or a text that
    # many rows share can be split.
    named = vertices.select("v", "text_md5", "first_id").join(parts, "v", "left").select("text_md5", "first_id", F.coalesce("component", "v").alias("class"))
    named = settle(named, "named")
    ids = settle(named.groupBy("class").agg(F.min("first_id").alias("class_id")), "class-ids")
    named = settle(named.join(ids, "class").select("text_md5", "class", "class_id"), "classes")
    marked = signed.select("id", "text_md5", F.col("bands").isNull().alias("wordless"))
    return marked.join(named, "text_md5", "left").select(
        "id", "text_md5", "wordless", "class", F.when(F.col("wordless"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
