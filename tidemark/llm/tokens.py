"""Token ids of whole texts with a public byte-level tokenizer, word by word.

The tokenizer splits a text before it merges bytes, and a single space between two characters that are
no white space always begins a new piece. So texts are split at such spaces, every distinct word is
encoded once per worker with the ``tokenizers`` library, and the ids of a text are gathered from these.
A text with other white space next to a space is encoded whole.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words a worker remembers, about 160 MB. Then it goes on with those that it met in several slices, the
#: half of them that it met last, so words that occur once do not drive out the others.
REMEMBERED = 800_000
#: Characters of text split at a time, and words that the tokenizer gets as one text.
SLICE, TOGETHER = 4 << 20, 128
#: White space that stands between such words, and what counts as white space here.
_BETWEEN = "\x0b"
_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = f"^$|^{_SPACES}|{_SPACES}$"


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; ``end`` is appended to each."""

    def __init__(self, path: str, end: int = 0) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        one, two, both = self._ids([" a", " b", f" a{_BETWEEN} b"])
        inner = both[len(one) : len(both) - len(two)]
        # The id that parts words of one text, if the tokenizer leaves them as they are.
        self.part = inner[0] if len(inner) == 1 and both == one + inner + two else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # words after a space, numbered as they came
        self.bare: dict[str, np.ndarray] = {}  # words that begin a text
        self.pool, self.used, self.slices = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.first, self.last = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)  # slices that a word was met in

    def _keep_frequent(self) -> None:
        n = len(self.known)
        again = np.flatnonzero(self.last[:n] > self.first[:n])
        kept = np.sort(again[np.argsort(self.last[again], kind="stable")][-(REMEMBERED // 2) :])
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(kept)}
        length = self.length[kept]
        ends = np.cumsum(length)
        self.pool = self.pool[np.repeat(self.start[kept] - (ends - length), length) + np.arange(length.sum())]
        self.used, self.start, self.length = len(self.pool), ends - length, length
        self.first, self.last = self.first[kept], self.last[kept]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words after a space, one after another, and how many each has."""
        if self.part is None or any(_BETWEEN in w for w in words):
            each = self._ids([f" {w}" for w in words])
            return np.fromiter((i for ids in each for i in ids), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        texts = [" " + f"{_BETWEEN} ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        parts = [np.array([*ids, self.part], np.uint32) for ids in self._ids(texts)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.part)
        return ids[ids != self.part], np.diff(ends, prepend=-1) - 1

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of some distinct words; numbers hold until the next call."""
        self.slices += 1

        def look_up() -> tuple[np.ndarray, np.ndarray]:
            found = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
            return found, np.flatnonzero(found < 0)

        numbers, unknown = look_up()
        if self.known and len(self.known) + len(unknown) > REMEMBERED:
            self._keep_frequent()
            numbers, unknown = look_up()
        self.last[numbers[numbers >= 0]] = self.slices
        new = [words[i] for i in unknown]
        ids, length = self._spaced(new)
        n, total = len(self.known), len(self.known) + len(new)
        if total > len(self.start):
            self.start, self.length, self.first, self.last = (np.resize(a, 2 * total) for a in (self.start, self.length, self.first, self.last))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n:total], self.length[n:total] = self.used + np.cumsum(length) - length, length
        self.first[n:total] = self.last[n:total] = self.slices
        self.known.update(zip(new, range(n, total)))
        self.used += len(ids)
        numbers[unknown] = np.arange(n, total)
        return numbers

    def _firsts(self, words: list[str]) -> list[np.ndarray]:
        """The ids of words without a space before them."""
        new = [w for w in dict.fromkeys(words) if w not in self.bare]
        made = dict(zip(new, (np.array(ids, np.uint32) for ids in self._ids(new))))
        if len(self.bare) < REMEMBERED // 20:
            self.bare.update(made)
        return [self.bare[w] if w in self.bare else made[w] for w in words]

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy()
        hit = np.concatenate([[0], np.cumsum(odd[codes])])
        alone = hit[offsets[1:]] > hit[offsets[:-1]]
        numbers = np.zeros(len(odd), np.int64)
        numbers[~odd] = self._numbers(coded.dictionary.filter(pa.array(~odd)).to_pylist())
        per_word = numbers[codes]
        length = self.length[per_word]
        length[offsets[:-1]] = 0  # a first word has no space before it
        length[odd[codes]] = 0
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.start[per_word] - ends[:-1], length) + np.arange(ends[-1])].astype("<u4")
        whole = iter(self._ids([texts[int(i)].as_py() for i in np.flatnonzero(alone)]))
        firsts = iter(self._firsts(coded.dictionary.take(pa.array(codes[offsets[:-1][~alone]])).to_pylist()))
        end, bounds = np.array([self.end], "<u4"), ends[offsets]
        for i in range(len(texts)):
            if alone[i]:
                yield np.append(np.array(next(whole), "<u4"), end)
            else:
                yield np.concatenate([next(firsts), ids[bounds[i] : bounds[i + 1]], end]).astype("<u4", copy=False)

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text its ids and the end id, as little-endian 32-bit numbers; NULL counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.utf8_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            yield from self._slice(texts.slice(at, end - at))
            at = end


def encoder(path: str, end: int = 0, made: dict[tuple[str, int], Encoder] = {}) -> Encoder:
    """One encoder per worker process."""
    if (path, end) not in made:
        made[path, end] = Encoder(path, end)
    return made[path, end]
