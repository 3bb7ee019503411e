"""Near-duplicates, packing, token files, languages, sharding, URL filter, top-k: against plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.test_native_operators import SCHEMA, documents

from tidemark.llm import exact_topk, graph, language_id, mixing, near_dup, packing, queries, sharding, token_files, tokens, url_filter
from tidemark.llm.shingles import shingle_hashes

SMALL = "/root/testdata/sf0.001"


def near_texts(seed=1):
    """Groups of edited copies at several rates, exact copies, short and empty texts."""
    chance = random.Random(seed)
    word = lambda: f"w{chance.randrange(4000)}"
    texts = [None, "", " \n", "a", "a", "b c d", "b  c\nd", "one two three four five", "one two three four five six"]
    for _ in range(25):
        base = [word() for _ in range(chance.randrange(20, 200))]
        for rate in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.2):
            texts.append(" ".join(w if chance.random() >= rate else word() for w in base))
    texts += [" ".join(word() for _ in range(80)) for _ in range(30)]
    return texts


def test_shingles_are_five_words():
    texts = [t for t in near_texts() if t is not None] + ["é 中\x0bx y z", "x" * 2_000_000 + " y z"]
    for text, hashes in zip(texts, shingle_hashes(pa.array(texts))):
        words = text.encode().split()
        want = [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []
        assert len(hashes) == len(want) and len(set(hashes.tolist())) == len(set(want))
    one, two = shingle_hashes(pa.array(["b c d", "b  c\nd"]))
    assert one.tolist() == two.tolist()


def test_samples_agree_as_often_as_texts_are_similar():
    chance = np.random.default_rng(4)
    near = 0
    found = chance.integers(1, 1 << 63, 400, np.uint64)
    found.sort()
    agree = []
    for i in range(60):
        a = chance.gamma(2.0, 2.0, 400).astype(np.float32)
        b = (a * chance.uniform(0.7, 1.3, 400)).astype(np.float32)
        near += near_dup.similarity((found, a), (found, b))
        same = near_dup.signature(found + np.uint64(i), a) == near_dup.signature(found + np.uint64(i), b)
        agree.append(same.mean())
    assert abs(np.mean(agree) - (near / 60) ** near_dup.ROWS) < 0.06


def test_near_classes_are_those_of_all_pairs(spark):
    texts = near_texts()
    docs = documents(spark, texts).withColumn("class", F.lit(0))
    got = {r["id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert got == plain.near_classes(list(range(len(texts))), texts)


def test_big_buckets_are_dealt_over_blocks(spark, monkeypatch):
    """One large group whose ends are apart: a chain of edits, with blocks of four."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    chance, texts = random.Random(2), []
    words = [f"w{i}" for i in range(150)]
    for _ in range(60):
        texts.append(" ".join(words))
        words[chance.randrange(150)] = f"x{chance.randrange(10_000)}"
    got = {r["id"]: r["class_id"] for r in near_dup.classes(documents(spark, texts)).collect()}
    assert got == plain.near_classes(list(range(60)), texts) and set(got.values()) == {0}


def test_many_copies_do_not_part_each_other(spark):
    """A third of all rows is one text with a word changed; by weight hardly any two of them reach 0.8."""
    chance, base = random.Random(6), [f"b{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in chance.sample(range(100), 60)]
    texts += [" ".join(f"r{chance.randrange(50_000)}" for _ in range(100)) for _ in range(120)]
    assert len(set(plain.near_classes(list(range(180)), texts).values())) > 170
    got = {r["id"]: r["class_id"] for r in near_dup.classes(documents(spark, texts), plain=0.8).collect()}
    assert sorted(set(got.values())) == [0, *range(60, 180)]


def test_plain_links_come_on_top_of_weighted_ones(spark):
    texts = near_texts(3)
    sets = [set(h.tolist()) for h in shingle_hashes(pa.array([t or "" for t in texts]))]
    root = plain.near_classes(list(range(len(texts))), texts)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {d: low if c == high else c for d, c in root.items()}
    got = {r["id"]: r["class_id"] for r in near_dup.classes(documents(spark, texts), plain=0.8).collect()}
    assert got == root != plain.near_classes(list(range(len(texts))), texts)


def test_plain_samples_agree_as_often_as_sets_are_alike():
    chance, agree = np.random.default_rng(5), []
    for _ in range(60):
        both, own = chance.integers(1, 1 << 63, 320, np.uint64), chance.integers(1, 1 << 63, (2, 40), np.uint64)
        agree.append((near_dup.plain_signature(np.append(both, own[0])) == near_dup.plain_signature(np.append(both, own[1]))).mean())
    assert abs(np.mean(agree) - 0.8**near_dup.ROWS) < 0.06


def test_near_classes_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "p q r s t u", None, None, None), (7, "p q r s t u", None, None, None), (7, "p q r s t u", None, None, None),
                                  (3, None, None, None, None), (3, "", None, None, None), (None, "lone words", None, None, None)], SCHEMA)
    rows = near_dup.classes(docs).collect()
    assert collections.Counter(r["class_id"] for r in rows) == {7: 3, 3: 2, None: 1}
    assert near_dup.classes(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (50, 50)] + [(500, 501 + i) for i in range(50)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and all(got[500 + i] == 500 for i in range(51)) and 50 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [None, "", " ", "a", "  a  b ", "a b\n c", "don't 'sx ''s", "tab\tnew\nline \r\n x", "<|endoftext|> y", "é中文 𝒳 ½ ４", "\x85 \u3000x \u00a0y", "x" * 5000, "a " * 3000]


def test_word_by_word_ids_are_the_tokenizers():
    made = tokens.Encoder(tokens.public_path())
    texts = ODD + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    want = [e.ids + [0] for e in made.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in made.documents(pa.array(texts))] == want
    assert [x.tolist() for x in made.documents(pa.array(texts).slice(3, 20))] == want[3:23]


def best_by_search(sizes, capacity):
    """Fewest bins, by trying everything."""
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                put(i + 1, bins)
                bins[k] -= sizes[i]
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_is_optimal_on_small_sets(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 20, 50, 100])
    sizes = sorted((chance.randint(1, capacity) for _ in range(chance.randint(1, 10))), reverse=True)
    counts = collections.Counter(sizes)
    packed = packing.complete(counts, capacity)
    used = collections.Counter()
    for pattern, many in packed:
        assert sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            used[n] += k * many
    assert used == counts
    best = best_by_search(sizes, capacity)
    assert packing.lower_bound(counts, capacity) <= best <= sum(m for _, m in packed) <= sum(m for _, m in packing.best_fit(counts, capacity))
    assert sum(m for _, m in packed) == best


def test_packing_nothing_and_alike():
    assert packing.complete({}) == []
    assert packing.complete({2048: 5}) == [(((2048, 1),), 5)]
    assert sum(m for _, m in packing.complete({1: 5000})) == 3


def test_search_beats_best_fit():
    """Best fit takes the 6 with the 4s apart; completion pairs them so that nothing is wasted."""
    counts = {44: 2, 24: 2, 22: 4, 21: 2, 17: 2, 8: 4, 6: 4}
    assert sum(m for _, m in packing.complete(counts, 61)) == -(-sum(n * c for n, c in counts.items()) // 61)


def test_search_fills_bins_with_many_short_pieces():
    """Five pieces and more fill a bin; best fit takes 1,095 bins where 1,000 are the bound."""
    chance = random.Random(5)
    counts = collections.Counter(chance.randint(350, 470) for _ in range(5000))
    packed = packing.complete(counts)
    used = collections.Counter()
    for pattern, many in packed:
        assert sum(n * k for n, k in pattern) <= packing.CAPACITY
        used.update({n: k * many for n, k in pattern})
    assert used == counts
    assert sum(m for _, m in packed) <= packing.lower_bound(counts, packing.CAPACITY) * 1.01 < sum(m for _, m in packing.best_fit(counts, packing.CAPACITY))


@pytest.mark.parametrize("seed", range(60))
def test_fillings_are_all_that_take_no_more(seed):
    chance = random.Random(seed)
    room, counts = chance.randint(0, 60), collections.Counter(chance.randint(1, 60) for _ in range(chance.randint(1, 9)))
    now, lengths = np.zeros(61, np.int64), sorted(counts, reverse=True)
    for n, k in counts.items():
        now[n] = k
    want = set()
    for copies in itertools.product(*[range(counts[n] + 1) for n in lengths]):
        left = room - sum(n * k for n, k in zip(lengths, copies))
        if left >= 0 and not any(n <= left and k < counts[n] for n, k in zip(lengths, copies)):
            want.add(tuple(n for n, k in zip(lengths, copies) for _ in range(k)))
    got = list(packing.fillings(now, lengths, room))
    assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True) and len(got) == len(set(got))
    assert got == [(room,)] if now[room] else set(got) == want


def check_packing(rows, texts, capacity=2048):
    made = tokens.Encoder(tokens.public_path())
    ids = [made.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    bins, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(own) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for d, parts in docs.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and all(n == capacity for _, _, n in parts[1:])
        assert [p[1] for p in parts] == [sum(x[2] for x in parts[:i]) for i in range(len(parts))] and sum(p[2] for p in parts) == len(ids[d])
        assert len(parts) == max(1, -(-len(ids[d]) // capacity))
    for content in bins.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))] and sum(n for _, n in content) <= capacity
    assert sorted(docs) == list(range(len(texts)))
    return len(bins), -(-sum(map(len, ids)) // capacity)


def test_packed_documents(spark):
    texts = ODD + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    docs = documents(spark, texts).withColumns({c: F.lit(0) for c in ("piece", "part", "nth", "offset", "length")})
    bins, bound = check_packing(packing.pack(docs.repartition(3), ["doc_id"]).collect(), texts)
    assert bins <= bound + 1
    with_ids = packing.pack(documents(spark, ODD), ["doc_id"], capacity=64, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in with_ids)
    check_packing(with_ids, ODD, 64)


def test_packing_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None)], SCHEMA)
    rows = packing.pack(docs, ["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 2), (1, 2)] and sorted(r["offset"] for r in rows)[0] == 0
    assert packing.pack(docs.limit(0), ["doc_id"]).count() == 0


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)  # several files
    texts = ODD + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    docs = documents(spark, texts).withColumns({c: F.lit(0) for c in ("start", "file", "ids")})
    got = {r["doc_id"]: r for r in token_files.round_trip(docs.repartition(3)).collect()}
    at = 0
    for i, ids in enumerate(tokens.Encoder(tokens.public_path()).documents(pa.array(texts))):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_one_document_is_read_by_its_index():
    docs = {None: [5, 6], 3: [1, 2, 3], 9: [], 12: list(range(40_000))}
    dictionary = token_files.train_dictionary([np.arange(i, i + 300, dtype="<u4").tobytes() for i in range(300)])
    assert dictionary
    writer = token_files.Writer(dictionary)
    for d, ids in docs.items():
        writer.add(d, np.array(ids, "<u4"))
    data = writer.finish()
    file = token_files.Reader(data, dictionary)
    assert file.ids(file.find(12)).tolist() == docs[12] and file.ids(file.find(3)).tolist() == [1, 2, 3] and file.find(4) is None
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Reader(data, b"")
    with pytest.raises(ValueError, match="whole"):
        token_files.Reader(data[:-1], dictionary)


def test_token_files_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "z", None, None, None), (5, "a", None, None, None), (5, "a", None, None, None), (-2, None, None, None, None)], SCHEMA)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.round_trip(docs).collect())
    assert rows == [(0, None, 2), (2, -2, 1), (3, 5, 2), (5, 5, 2)]
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit(0)).withColumn("lang_pred", F.lit("x"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels, model = language_id.prototypes(docs, ~held)
    assert labels == ["de", "en", "es", "fr"]
    rows = language_id.predict(docs.where(held), [F.col("lang")], labels, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_tables(spark):
    rows = [(1, "der die das und nicht", "de", None, None), (2, "the and of that", "en", None, None), (3, None, "en", None, None), (4, "12 !? \n", "xx", None, None),
            (5, "und", None, None, None), (6, "", None, None, None), (7, "THE THAT" * 50_000, None, None, None), (None, "of the", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels, model = language_id.prototypes(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, [F.col("doc_id")], labels, model).collect()}
    assert {d: g[0] for d, g in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "de", 6: "und", 7: "en", None: "en"}
    assert got[3][1] == 0.0 and len(got) == 8
    untaught = language_id.prototypes(docs.where("lang IS NULL"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, [F.col("doc_id")], *untaught).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), [F.col("doc_id")], labels, model).count() == 0


def test_language_profile_is_the_sum_of_bound_letters():
    """One text, by the definition: rotate, multiply, add."""
    letters = {c: language_id.letter_vector(ord(c)).astype(int) for c in " ab"}
    want = sum(np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z] for x, y, z in (" ab", "ab ", "b a", " aa", "aa "))
    got, some = language_id._profiles(["Ab--aa."], language_id.Vectors())
    assert some[0] and (got[0] == want).all()


def test_shards_match_the_mixture(spark):
    rows = [(i, "x" * (i % 50), "en", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}", 0) for i in range(1003)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("h", "s", "rank", "at", "shard", "slot", "group_rows")})
    got = sharding.shards(docs, 40, ["doc_id"]).collect()
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    total, by = collections.Counter(source.values()), collections.defaultdict(list)
    for r in got:
        assert r["size"] == 16 + len(text[r["doc_id"]]) and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(40)) and {len(v) for v in by.values()} == {25, 26}
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        share = collections.Counter(source[r["doc_id"]] for r in own)
        assert all(abs(share[s] - n / 40) < 2 for s, n in total.items())
    again = sharding.shards(docs.repartition(5), 40, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_shards_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "é", None, "", None), (1, "é", None, "", None)], SCHEMA)
    got = sharding.shards(docs, 40, ["doc_id"]).collect()
    assert sorted(r["size"] for r in got) == [16, 18, 18] and all(r["slot"] == 0 for r in got) and len({r["shard"] for r in got}) == 3
    assert sharding.shards(docs.limit(0), 40, ["doc_id"]).count() == 0


RULES = (url_filter.UrlRule("block", "net", "/"), url_filter.UrlRule("allow", "a.net", "/en/"))
URLS = {
    "http://x.net/": ("x.net", "/", "net/"), "http://x.net": ("x.net", "", None), "HTTP://B.A.NET/en/x?q#f": ("b.a.net", "/en/x", "a.net/en/"),
    "http://ba.net/en/": ("ba.net", "/en/", "net/"), "http://net/x": ("net", "/x", "net/"), "ftp://É.Net?x/y": ("É.net", "", None), "no scheme.net/": ("", "", None),
    None: ("", "", None), "": ("", "", None), "://a.net/en/#": ("a.net", "/en/", "a.net/en/"), "http://a.network/": ("a.network", "/", None),
    "x://h.net/a://b/c": ("h.net", "/a://b/c", "net/"), "http://a\nb.net/\n?": ("a\nb.net", "/\n", "net/"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "key", "rule", "listed", "b", "block")})
    none = spark.createDataFrame([], "entry string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none, RULES, ["page_id"]).collect()}
    for i, (host, path, rule) in enumerate(URLS.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == ("block" if rule == "net/" else "allow")
    assert url_filter.judge(pages.limit(0), none, RULES, ["page_id"]).count() == 0


def test_listed_urls_are_found_and_no_others(spark, monkeypatch):
    """With one block of bits nearly everything is a possible hit, and the join still decides."""
    listed = spark.createDataFrame([(f"http://www.H{i}.org:80/p/index.html?b=2&utm_source=z&a=1#f",) for i in range(0, 400, 2)] + [(None,), ("none",)], "url string")
    pages = spark.createDataFrame([(i, f"https://h{i}.org/p?a=1&b=2") for i in range(400)] * 2 + [(1000, None)], "page_id long, url string")
    for most in (1, 1 << 20):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
        got = url_filter.judge(pages, url_filter.entries_of(listed), RULES, ["page_id"]).collect()
        assert len(got) == 801 and all((r["verdict"] == "block") == (r["page_id"] < 400 and r["page_id"] % 2 == 0) == r["listed"] for r in got)


def test_top_k_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 100)
    monkeypatch.setattr(exact_topk, "QUERIES", 4)
    chance = np.random.default_rng(3)
    data = {i: chance.normal(0, 0.2, 16).astype(np.float32).tolist() for i in range(400)}
    data |= {i: data[7] for i in range(400, 460)}  # ties
    rows = [(i, v, 1) for i, v in data.items()]
    bad = [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 16, 1), (1150, [float("inf")] * 16, 1), (None, data[1], 1), (1200, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "block", "rank", "score")})
    got = {tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == plain.top_k(data, 50, 5)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_stops_before_the_end():
    """On vectors with a few strong components the bounds prove the best early."""
    import pandas as pd

    chance = np.random.default_rng(5)
    rows = chance.integers(-5, 5, (2000, 32))
    rows[np.arange(2000), chance.integers(0, 32, 2000)] += chance.integers(100, 4000, 2000)
    made = exact_topk._index(pd.DataFrame({"block": 0, "id": np.arange(2000), "times": 1, "vector": rows.tolist()})).iloc[0]
    index = exact_topk.BlockIndex(*[made[c] for c in ("width", "ids", "times", "rows", "segment", "least", "most")])
    for q, possible in zip(range(0, 2000, 100), index.possible(rows[::100], 6)):
        scores = rows @ rows[q]
        assert possible[scores >= np.sort(scores)[-6]].all() and possible.sum() < 400
    assert index.possible(rows[:2] * (1 << 50), 6).all()  # beyond exact doubles everything is scored


def test_copies_of_the_queries_are_not_broadcast(spark, monkeypatch):
    """Each block gets a copy of every query: these grow with the square of the rows, whatever Spark takes their size for."""
    for name, size in (("BLOCK", 50), ("QUERIES", 2), ("PARTS", 3)):
        monkeypatch.setattr(exact_topk, name, size)
    chance = np.random.default_rng(8)
    data = {i: chance.normal(0, 0.2, 8).astype(np.float32).tolist() for i in range(1000)}
    df = exact_topk.top_k(spark.createDataFrame(list(data.items()), "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5)
    assert {tuple(r) for r in df.collect()} == plain.top_k(data, 50, 5)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [3, 300, 1 << 20, 1 << 27])
def test_bounds_of_many_queries_hold_in_floats_and_doubles(size):
    import pandas as pd

    chance = np.random.default_rng(9)
    rows = chance.integers(-size, size + 1, (300, 16))
    made = exact_topk._index(pd.DataFrame({"block": 0, "id": np.arange(300), "times": 1, "vector": rows.tolist()})).iloc[0]
    index = exact_topk.BlockIndex(*[made[c] for c in ("width", "ids", "times", "rows", "segment", "least", "most")])
    asking = np.arange(0, 300, 7)
    for q, (ids, _, scores) in zip(asking, index.best(asking, rows[asking], 5)):
        want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5]
        assert list(zip(-scores, ids)) == want


def test_every_repeated_row_is_a_candidate(spark):
    chance = np.random.default_rng(6)
    rows = [(i, chance.integers(-4, 4, 4).astype(float).tolist()) for i in range(101)]
    rows += [rows[7]] * 2 + [rows[9]] * 3 + [rows[50]]
    got = {tuple(r) for r in exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).collect()}
    want = set()
    for q in (0, 50, 100):
        query = rows[q][1]
        scored = sorted((-sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(query, v)), i) for i, v in rows if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])}
    assert got == want


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, -0.001]), (1, [0.5, 0.5]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()} == {(0, 1, 1, 256 * 128 - 128)}


def test_sharding_query_is_that_of_plain_python(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in queries.op3_sharding(spark, SMALL).collect()}
    assert got == plain.shards(docs, 40) and len(got) == len(docs)


def test_mixing_query_is_that_of_plain_python(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain.mixed(docs, mixing.GROUP)
    got = {r.doc_id: (r.taken, r["size"]) for r in queries.op9_source_mixing(spark, SMALL).collect()}
    assert {i: taken for i, (taken, _) in got.items()} == {i: want[i] * size for i, (_, size) in got.items()}


def test_language_query_is_that_of_plain_python(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain.languages(docs, language_id.letter_vector)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op7_language_id(spark, SMALL).collect()}
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 1e-4 for i in want)


def test_forgotten_words_get_the_same_ids(monkeypatch):
    """A memory for a few words only: what is kept and what is made anew gives the ids of whole texts."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "SLICE", 200)
    chance = random.Random(9)
    texts = [" ".join(f"w{int(chance.paretovariate(0.7)) % 300}" for _ in range(30)) for _ in range(60)] + ["", "a\x0bb c", " x  y ", "é 中"]
    made = tokens.Encoder(tokens.public_path())
    got = [ids.tolist() for ids in made.documents(pa.array(texts))]
    assert got == [[*e.ids, 0] for e in made.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(made.known) < 100
