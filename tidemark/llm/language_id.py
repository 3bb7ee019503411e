"""Language of whole texts by hyperdimensional profiles of letter trigrams.

Every letter has a random vector of +1 and -1 that follows from its code point; the place in the trigram
is bound in by rotation, and the product of the three is the trigram's vector. A text's profile is the
sum over its trigrams, a language's prototype the sum over all texts that carry its label. The part that
all prototypes share is taken out, and the prototype with the highest cosine wins.

Text is put in lower case; runs of anything but letters count as one space, at both ends too. A trigram
of other characters than letters alone does not occur, so a text without a letter has no profile.

Defined results: a NULL text or one without a letter is ``und`` with score 0; ties go to the smaller
label; rows without a label teach nothing, nor do labels whose texts have no letter; without any label everything
is ``und``; repeated rows are
counted and returned each; an empty table gives an empty result; columns that are not named stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
#: A model of more languages than this is refused; the bound keeps what each task receives below 100 MB.
MOST_LANGUAGES = 10_000
#: Texts whose profiles are made by one matrix product, and characters at most (a longer text goes alone).
TEXTS, CHARS = 256, 1 << 20
#: Trigram vectors that a worker keeps.
KEPT = 60_000  # a byte per dimension
_SPACE = 0x20


def letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([7, code])).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


class Vectors:
    """Vectors of trigrams, made when first asked for."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, DIMENSIONS), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigrams, a row each."""
        if len(self.rows) + len(grams) > max(KEPT, len(grams)):
            self.rows.clear()
        for g in grams.tolist():
            if g not in self.rows:
                n = len(self.rows)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = (self._letter((g >> s) & 0x1FFFFF) for s in (42, 21, 0))
                self.table[n] = np.roll(a, 2) * np.roll(b, 1) * c
                self.rows[g] = n
        return self.table[[self.rows[g] for g in grams.tolist()]].astype(np.float32)


_LETTER: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text as packed code points, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter, codes, _SPACE).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first one stays
    codes = np.concatenate([[_SPACE], codes[keep], [_SPACE]])
    if not letter[-1]:
        codes = codes[:-1]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def _in_groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, chars = [], 0
    for text in texts:
        n = len(text or "")
        if group and (len(group) == TEXTS or chars + n > CHARS):
            yield group
            group, chars = [], 0
        group.append(text)
        chars += n
    if group:
        yield group


def _profiles(texts: list[str | None], vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """A profile per text, and which texts have a letter."""
    found = [trigrams(t) for t in texts]
    grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    counts = np.zeros((len(texts), len(grams)), np.float32)
    counts[np.repeat(np.arange(len(texts)), [len(g) for g, _ in found]), where] = np.concatenate([n for _, n in found])
    return counts @ vectors.of(grams), np.array([len(g) > 0 for g, _ in found])


def prototypes(docs: DataFrame, teaches: Column, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Labels in order and a vector each: sums over every row where ``teaches`` holds, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, n = trigrams(t)
                own = sums.setdefault(lang, {})
                for g, k in zip(grams.tolist(), n.tolist()):
                    own[g] = own.get(g, 0) + k
        vectors, rows = Vectors(), []
        for lang, own in sums.items():
            total = np.zeros(DIMENSIONS, np.float64)
            grams, n = np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float64, len(own))
            for at in range(0, len(grams), 8192):
                total += n[at : at + 8192] @ vectors.of(grams[at : at + 8192]).astype(np.float64)
            rows.append((lang, total.astype(np.int64).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["lang", "sum"])

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMENSIONS, np.int64)
        for part in parts:
            for s in part["sum"]:
                total += np.frombuffer(s, np.int64)
        yield pd.DataFrame({"lang": [key[0]], "sum": [total.tobytes()]})

    rows = docs.where(teaches & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    summed = rows.mapInArrow(run, "lang string, sum binary").groupBy("lang").applyInPandas(add, "lang string, sum binary")
    found = summed.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = [(r[0], np.frombuffer(r[1], np.int64).astype(np.float64)) for r in found]
    found = sorted((lang, v) for lang, v in sums if v.any())
    table = np.array([v for _, v in found]).reshape(len(found), DIMENSIONS)
    return [lang for lang, _ in found], table


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def predict(docs: DataFrame, keep: list[Column], labels: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (the best cosine, 0 if it is negative) for each row."""
    spark = docs.sparkSession
    units = _unit(table)
    common = units.mean(axis=0) if len(labels) > 1 else np.zeros(DIMENSIONS)
    model = spark.sparkContext.broadcast((labels, common.astype(np.float32), _unit(units - common).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared, own = model.value
        vectors = Vectors()
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for group in _in_groups(batch.column(batch.num_columns - 1).to_pylist()):
                profiles, some = _profiles(group, vectors)
                if not known:
                    some[:] = False
                    cosines = np.zeros((len(group), 1), np.float32)
                else:
                    cosines = _unit(_unit(profiles) - shared * some[:, None]) @ own.T
                best = cosines.argmax(axis=1)
                value = np.clip(cosines[np.arange(len(group)), best], 0.0, 1.0)
                langs += [known[b] if s else "und" for b, s in zip(best, some)]
                scores += [float(v) if s else 0.0 for v, s in zip(value, some)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{types}, lang_pred string, score double")
