"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser ``m`` form a stratum. A stratum is cut into blocks of at most
``BLOCK_DOCS`` documents and about ``BLOCK_POSTINGS`` postings, so one that holds a third of all documents is
many blocks. A block has one posting list per term and tf: the numbers of its documents, which lie in
ascending order of their ids. In a block the contribution of a term depends on tf alone, so it is computed once
for each list and never for a document.

The bound of an item in a block is the sum of what its terms give at their largest tf there. Every item
visits its blocks by descending bound, a few in the first round and ``WIDER`` times as many in each later one;
after a round it drops the blocks whose bound is below its k-th best score so far. That is a proof, for a
document with an equal score may still win by its id. So the results are those of scoring everything.

A term is a run of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased.

Defined results: a NULL text has no terms; documents without terms are not counted and never found; every row
of the documents is a candidate and every row of the items a query of its own, repeated or not; a NULL doc_id
comes after all others among equal scores; items without terms or hits have no rows; an empty table gives an
empty result; very long texts are read whole, and a block may hold one such document alone; columns that are
not named stay unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.session import broadcast_if_small, settle

TOP = 20
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 19
#: Blocks that an item visits in the first round, how many times more in each later one, and items that are scored together.
VISITS, WIDER, ITEMS = 16, 16, 256
#: Query terms that are sent to all tasks; with more the join on terms shuffles.
SENT_TERMS, SENT_CHARS = 50_000, 256

_TERM_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: Lower case for A-Z, a space for every byte that is in no term.
_PLAIN = bytes(b if b in _TERM_BYTES else 32 for b in bytes(range(256)).lower())


def terms(text: str) -> Counter[bytes]:
    """The terms of a whole text, in UTF-8, with their counts."""
    return Counter(text.encode("utf-8", "replace").translate(_PLAIN).split())


class Index(NamedTuple):
    """``blocks``: block, m, ids (ascending, those that are not NULL), n. ``postings``: block, m, term, tf, docs (numbers in the block), n."""

    blocks: DataFrame
    postings: DataFrame
    documents: int  # with at least one term
    length: int  # all terms of these


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([c.total() for c in found], pa.int64()), pa.array([len(c) for c in found], pa.int64()),
                pa.array([b" ".join(c).decode() for c in found], pa.large_string()).cast(pa.string()),
                pa.array([np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in found], pa.binary()),
            ],
            ["id", "n", "held", "terms", "tfs"])


class _Block:
    """Documents of one share of a stratum until they become a block."""

    def __init__(self, m: int, share: int) -> None:
        self.m, self.share, self.ids, self.terms, self.tfs, self.postings = m, share, [], [], [], 0

    def add(self, doc_id: int | None, words: str, tfs: bytes) -> None:
        self.ids.append(doc_id)
        self.terms.append(words)
        self.tfs.append(np.frombuffer(tfs, "<u4"))
        self.postings += len(self.tfs[-1])

    def lists(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order, the term code and tf of each list, where it begins, all document numbers; and the terms."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        doc = np.repeat(np.arange(len(order), dtype=np.uint16), [len(self.tfs[i]) for i in order])
        tf = np.concatenate([self.tfs[i] for i in order]).astype(np.int64)
        split = pc.split_pattern(pa.array([self.terms[i] for i in order], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        by = np.lexsort((doc, tf, code))
        code, tf, doc = code[by], tf[by], doc[by]
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
        return pa.array([self.ids[i] for i in order if self.ids[i] is not None], pa.int64()), coded.dictionary.take(pa.array(code[starts])), tf[starts], starts, doc


def _blocks(block_docs: int, block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal made
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ids, words, tf, starts, doc = now.lists()
            ends, n = np.r_[starts[1:], len(doc)], len(starts) + 1
            offsets = np.r_[0, 2 * starts, 2 * len(doc)].astype(np.int32)  # the first row describes the block
            docs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(doc.astype("<u2").tobytes())])
            ids_only = pa.array([ids.to_pylist()] + [None] * (n - 1), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)), pa.array(np.full(n, now.m)), ids_only, pa.concat_arrays([pa.array([None], pa.string()), words.cast(pa.string())]),
                    pa.array(np.r_[0, tf]), docs, pa.array(np.r_[len(now.ids), ends - starts]),
                ],
                ["block", "m", "ids", "term", "tf", "docs", "n"])

        for batch in batches:
            for m, share, doc_id, words, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and ((now.m, now.share) != (m, share) or len(now.ids) == block_docs or now.postings >= block_postings):
                    yield flush()
                    now = None
                now = now or _Block(m, share)
                now.add(doc_id, words, tfs)
        if now is not None:
            yield flush()

    return run


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Index:
    """Index every row of ``docs``; texts are read once, in two settled tables."""
    if not 0 < block_docs <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 documents")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole(text).alias("text"))
    made = rows.mapInArrow(_forward, "id bigint, n bigint, held bigint, terms string, tfs binary").where("n > 0")
    forward = settle(made.withColumn("_row", F.monotonically_increasing_id()), "terms")
    size = forward.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    m = F.lit(75) + F.expr(f"(25 * n * {size.docs}L) div {max(size.length, 1)}L")
    rows = forward.select(m.alias("m"), "id", "terms", "tfs", "held", "_row")
    # A stratum is dealt over shares of about a block each, so a task's work follows what it holds, not its length.
    shares = F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("held") / block_postings))
    strata = broadcast_if_small(settle(rows.groupBy("m").agg(shares.alias("shares")), "strata"))
    dealt = rows.join(strata, "m").select("m", F.pmod(F.xxhash64("_row"), F.col("shares")).alias("share"), "id", "terms", "tfs", "_row")
    ordered = dealt.repartition("m", "share").sortWithinPartitions("m", "share", "_row")
    schema = "block bigint, m bigint, ids array<bigint>, term string, tf bigint, docs binary, n bigint"
    index = settle(ordered.drop("_row").mapInArrow(_blocks(block_docs, block_postings), schema), "lexical-index")
    return Index(
        index.where("term IS NULL").select("block", "m", "ids", "n"), index.where("term IS NOT NULL").select("block", "m", "term", "tf", "docs", "n"),
        size.docs, size.length)


def impact(tf: Column, m: Column, weight: Column) -> Column:
    """What a term of this weight gives a document with this tf and normaliser; whole numbers."""
    return weight * F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * m)


def _asked(index: Index, items: DataFrame, id_column: str, text: str) -> DataFrame:
    """item, item_id, crowd (items scored together), term, its count in the item and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t or "") for t in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            words = pa.array([w.decode() for c in found for w in c], pa.string())
            counts = pa.array([k for c in found for k in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), words, counts], ["item", "item_id", "term", "asked"])

    rows = settle(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_column).alias("item_id"), whole(text).alias("text")), "items")
    kind = rows.schema["item_id"].dataType.simpleString()
    words = settle(rows.mapInArrow(run, f"item bigint, item_id {kind}, term string, asked bigint"), "item-terms")
    known = _few(words.select("term").distinct())
    df = index.postings.join(known, "term").groupBy("term").agg(F.sum("n").alias("df"))
    share = (F.lit(2.0 * index.documents + 2.0)) / (2 * F.col("df") + 1).cast("double")
    weighed = words.join(df, "term").withColumn("weight", F.floor(1000 * F.log(share)).cast("long"))
    # Items are dealt over crowds of about ITEMS, so that what a task scores together stays bounded.
    crowds = max(-(-rows.count() // ITEMS), 1)
    return settle(weighed.withColumn("crowd", F.pmod(F.xxhash64("item"), F.lit(crowds)).cast("int")), "asked")


def _few(side: DataFrame) -> DataFrame:
    """A broadcast hint where the side has few and short terms; its size in bytes is bounded by both."""
    size = side.agg(F.count(F.lit(1)), F.max(F.octet_length("term"))).first()
    return F.broadcast(side) if size[0] <= SENT_TERMS and (size[1] or 0) <= SENT_CHARS else side


def _score(top: int):
    """The posting lists of a block that a crowd of items asks for, and these items -> their best documents there."""

    def run(lists: pd.DataFrame, visit: pd.DataFrame) -> pd.DataFrame:
        names = ["item", "block", "doc_id", "score"]
        if visit.empty or lists.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        block, ids, size, wanted = visit["block"][0], visit["ids"][0], visit["n"][0], set(visit["items"][0])
        scores: dict[int, np.ndarray] = {}
        for docs, gain, item, asked in zip(lists["docs"], lists["gain"], lists["item"], lists["asked"]):
            at = np.frombuffer(docs, "<u2")
            for i, times in zip(item, asked):
                if i in wanted:
                    if i not in scores:
                        scores[i] = np.zeros(size, np.int64)
                    scores[i][at] += gain * times
        out = []
        for i, s in scores.items():
            hit = np.flatnonzero(s)
            best = hit[np.lexsort((hit, -s[hit]))[:top]]  # numbers ascend with the ids
            out += [(i, block, ids[d] if d < len(ids) else None, s[d]) for d in best]
        found = pd.DataFrame(out, columns=names)
        return found.astype({"item": "int64", "block": "int64", "doc_id": "Int64", "score": "int64"})

    return run


def search(index: Index, items: DataFrame, top: int = TOP, id_column: str = "item_id", text: str = "text", visits: int = VISITS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every row of ``items``."""
    asked = _asked(index, items, id_column, text)
    # One row per term and crowd: its weight and the items that ask for it.
    wanted = settle(asked.groupBy("term", "crowd", "weight").agg(F.collect_list(F.struct("item", "asked")).alias("by")), "asked-terms")
    lists = index.postings.join(_few(wanted), "term").where("weight > 0").select(
        "block", "crowd", "term", "tf", "docs", impact(F.col("tf"), F.col("m"), F.col("weight")).alias("gain"), "by")
    lists = settle(lists.where("gain > 0"), "asked-lists")
    most = lists.groupBy("block", "crowd", "term").agg(F.max("gain").alias("gain"), F.first("by").alias("by"))
    bounds = most.select("block", "crowd", "gain", F.inline("by")).groupBy("item", "block", "crowd").agg(F.sum(F.col("gain") * F.col("asked")).alias("bound"))
    left = settle(bounds, "bounds")

    ranked = Window.partitionBy("item")
    better = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = lists.select("block", "crowd", "docs", "gain", F.col("by.item").alias("item"), F.col("by.asked").alias("asked"))
    best, wide = None, visits
    while True:
        ordered = left.withColumn("_visit", F.row_number().over(ranked.orderBy(F.desc("bound"), "block")))
        now = settle(ordered.where(F.col("_visit") <= wide).drop("_visit"), "visits")
        if now.isEmpty():
            break
        crowds = now.groupBy("block", "crowd").agg(F.collect_list("item").alias("items")).join(index.blocks.select("block", "ids", "n"), "block")
        here = rows.join(now.select("block", "crowd").distinct(), ["block", "crowd"], "left_semi")
        found = here.groupBy("block", "crowd").cogroup(crowds.groupBy("block", "crowd")).applyInPandas(
            _score(top), "item bigint, block bigint, doc_id bigint, score bigint")
        best = found if best is None else best.unionByName(found)
        best = settle(best.withColumn("_rank", F.row_number().over(ranked.orderBy(*better))).where(F.col("_rank") <= top).drop("_rank"), "best")
        # A block goes once it is visited, or where even its bound is below the k-th best score.
        floor = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).select("item", "least")
        left = left.join(now.select("item", "block"), ["item", "block"], "left_anti").join(floor, "item", "left")
        left = settle(left.where("least IS NULL OR bound >= least").drop("least"), "unvisited")
        wide *= WIDER
    kind = items.schema[id_column].dataType.simpleString()
    if best is None:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    rank = F.row_number().over(ranked.orderBy(*better)).cast("int")
    return best.withColumn("rank", rank).join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
