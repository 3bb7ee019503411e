"""The corpus operators' rules once more, row by row and without Spark, for small tables."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pyarrow as pa

WORD = re.compile("[^\x20\x09-\x0d]+")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def counts(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(grams)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}),
    }


def base_failed(text: str | None) -> bool:
    c = counts(text)
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Give by weight; whoever is above the brim is held there and the rest is given anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        given = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            return full | given
        full |= {s: most * sizes[s] for s in over}


def weighted_shingles(texts: list[str | None]) -> list[dict]:
    """TF-IDF weights with the operator's sketch of document frequencies, filled here text by text."""
    from tidemark.llm import near_dup
    from tidemark.llm.shingles import shingle_hashes

    hashes = list(shingle_hashes(pa.array(texts, pa.string())))
    cells = np.zeros(near_dup._CELLS, np.int64)
    for h in hashes:
        for x in set(h.tolist()):
            cells[near_dup._cells(np.array([x], np.uint64)).ravel()] += 1
    n = sum(len(h) > 0 for h in hashes)
    out = []
    for h in hashes:
        tf = collections.Counter(h.tolist())
        out.append({x: float(np.float32(k * math.log1p(n / max(cells[near_dup._cells(np.array([x], np.uint64)).ravel()].min(), 1)))) for x, k in tf.items()})
    return out


def near_classes(ids: list, texts: list[str | None], similar: float = 0.8) -> dict:
    """All pairs compared; id -> smallest id of its class."""
    weights = weighted_shingles(texts)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = weights[i], weights[j]
            low = sum(min(w, b[x]) for x, w in a.items() if x in b)
            high = sum(a.values()) + sum(b.values()) - low
            if a and b and low >= similar * high:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def top_k(vectors: dict[int, list[float]], every: int, k: int) -> set[tuple]:
    whole = {i: [math.floor(256 * float(np.float64(x))) for x in v] for i, v in vectors.items()}
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def spark_hash(*values) -> int:
    """Spark's xxhash64 of whole numbers (64 bits, or ``(n, 4)`` for 32) and texts, as a signed number; NULL leaves it as it is."""
    import xxhash

    seed = 42
    for v in values:
        if v is None:
            continue
        if isinstance(v, tuple):
            data = v[0].to_bytes(v[1], "little", signed=True)
        else:
            data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def shards(docs: list[tuple], count: int, seed: int = 11) -> set[tuple]:
    """(id, text, source) -> (id, size, crc32, shard, slot): ranks within sources, fractional ranks over all, cut."""
    import zlib

    rows = []
    for i, text, source in docs:
        data = (text or "").encode()
        rows.append((source or "", source is None, spark_hash((seed, 4), i), i, zlib.crc32(data), len(data) + 16))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[:2], []).append(r)
    placed = []
    for own in by_source.values():
        for rank, r in enumerate(sorted(own, key=lambda r: r[2:])):
            placed.append(((rank + 0.5) / len(own), *r))
    out = set()
    for place, (_, _, _, _, i, crc, size) in enumerate(sorted(placed)):
        shard = place * count // len(placed)
        out.add((i, size, crc, shard, place - -(-shard * len(placed) // count)))
    return out


def mixed(docs: list[tuple], group: int, seed: int = 17) -> dict:
    """(id, text, source) -> copies by id: pivotal rounding folded up the same tree of groups, for distinct ids."""
    import math

    rows = [(i, source, len(WORD.findall(text or "")), spark_hash(text or "")) for i, text, source in docs]
    sizes, many = {}, {}
    for _, source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
        many[source] = many.get(source, 0) + (size > 0)
    want, copies, levels = targets(sizes), {}, {}
    for i, source, size, mark in rows:
        wanted = want[source] / sizes[source] if size else 0.0
        base = math.floor(wanted)
        if wanted - base <= 0:
            copies[i] = base
        else:
            key = spark_hash((seed, 4), i, size, mark, 0)
            levels.setdefault((source, math.ceil(many[source] / group)), []).append([key, size, base, wanted - base, i])

    def unit(*values):
        return (spark_hash(*values) % (1 << 64) >> 11) / (1 << 53)

    def pair(a, b, s):
        room_a, room_b, has_a, has_b = (1 - a[3]) * a[1], (1 - b[3]) * b[1], a[3] * a[1], b[3] * b[1]
        up, down = min(room_a, has_b), min(has_a, room_b)
        inside = lambda x: min(max(x, 0.0), 1.0)
        if unit((s, 4), a[0], b[0]) * (up + down) < down:
            done, p, left, q = (a, 1.0, b, b[3] - room_a / b[1]) if room_a <= has_b else (b, 0.0, a, a[3] + has_b / a[1])
        else:
            done, p, left, q = (a, 0.0, b, b[3] + has_a / b[1]) if has_a <= room_b else (b, 1.0, a, a[3] - room_b / a[1])
        copies[done[4]] = done[2] + int(p)
        return [*left[:3], inside(q), left[4]]

    depth = 0
    while levels:
        after = {}
        for (source, groups), own in levels.items():
            dealt = {}
            for r in own:
                dealt.setdefault(spark_hash((seed + 1 + depth, 4), r[0], r[4]) % groups, []).append(r)
            for members in dealt.values():
                members.sort(key=lambda r: (-r[1], r[0]))
                left = members[0]
                for r in members[1:]:
                    left = pair(left, r, seed + depth)
                if groups > 1 and 0 < left[3] < 1:
                    after.setdefault((source, math.ceil(groups / group)), []).append(left)
                else:
                    copies[left[4]] = left[2] + (left[3] >= 0.5)
        levels, depth = after, depth + 1
    return copies


def languages(docs: list[tuple], letter_vector) -> dict:
    """(id, text, label) -> (held out, label, cosine) by id: trigram vectors bound and summed one at a time."""
    import zlib

    letters, known = {}, {}

    def letter(c: str) -> np.ndarray:
        if c not in letters:
            letters[c] = letter_vector(ord(c)).astype(np.int64)
        return letters[c]

    def profile(text: str | None) -> np.ndarray | None:
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            return None
        line, total = f" {' '.join(words)} ", np.zeros(len(letter("a")), np.int64)
        for gram, n in collections.Counter(line[i : i + 3] for i in range(len(line) - 2)).items():
            if gram not in known:
                known[gram] = np.roll(letter(gram[0]), 2) * np.roll(letter(gram[1]), 1) * letter(gram[2])
            total += n * known[gram]
        return total

    found = {i: profile(t) for i, t, _ in docs}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    sums = {}
    for i, _, label in docs:
        if not held[i] and label is not None and found[i] is not None:
            sums[label] = sums.get(label, 0) + found[i]
    unit = lambda v: v / (np.sqrt((v * v).sum()) or 1.0)
    labels = sorted(sums)
    units = {label: unit(sums[label].astype(float)) for label in labels}
    common = sum(units.values()) / len(labels) if len(labels) > 1 else 0.0
    centred = {label: unit(v - common) for label, v in units.items()}
    out = {}
    for i, v in found.items():
        if v is None:
            out[i] = (held[i], "und", 0.0)
        else:
            own = unit(unit(v.astype(float)) - common)
            best = max(labels, key=lambda label: (own @ centred[label], [-ord(c) for c in label]))
            out[i] = (held[i], best, max(0.0, float(own @ centred[best])))
    return out
