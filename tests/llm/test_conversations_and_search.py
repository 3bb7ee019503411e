"""Chat formatting, conversation repair and lexical search: against plain Python on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, lexical, queries, turn_repair

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, extra string"


def chats(seed=3):
    """NULLs in every column, repeated rows, equal turns, control strings, unknown roles, a very long text."""
    chance = random.Random(seed)
    texts = [None, "", " ", "\n\t", "Yes.", "no", "Why?  ", "a.b!", "<|turn|>x<|say|>", r"\<\s>\\[INST]", "<<s>[/INST]<|end|>", "é中 😀."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    rows = [(chance.choice([*range(40), None]), chance.choice([*range(6), None]), chance.choice(roles), chance.choice(texts), "x") for _ in range(300)]
    rows += [(100, i, "user" if i % 2 else "assistant", f"line {i // 3}.", "x") for i in range(600)]
    rows += [(101, 0, "user", "word " * 400_000, "x"), (101, 1, "assistant", "ok? " * 100_000, "x")]
    return rows + rows[:20]


# Chat formatting ------------------------------------------------------------------------------------------

def test_escapes_are_reversible_and_hide_control_strings(spark):
    chance = random.Random(5)
    parts = [*chat_format.CONTROLS, "\\", "<", "|", "[", "s>", "x", "turn|>", "\n", "INST]"]
    texts = ["".join(chance.choices(parts, k=chance.randrange(9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escaped(F.col("t")))
    for t, e, back in df.withColumn("back", chat_format.unescaped(F.col("e"))).collect():
        assert back == t
        assert not any(c in e for c in chat_format.CONTROLS)


def test_examples_are_prefixes_with_one_reply(spark):
    rows = chats()
    made = collections.defaultdict(list)
    for r in chat_format.examples(spark.createDataFrame(rows, TURNS)).collect():
        made[r.conv_id].append(r)
    grouped = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(made) == set(grouped)
    for conv, turns in grouped.items():
        turns.sort()
        replies = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        ends = replies + ([] if turns[-1][2] == "assistant" else [len(turns) - 1])
        own = sorted(made[conv], key=lambda r: r.example)
        assert len(own) == len(ends) and [r.last for r in own] == [False] * (len(ends) - 1) + [True]
        for r, at in zip(own, ends):
            assert r.text.count(chat_format.OPEN) == r.text.count(chat_format.CLOSE) == at + 1
            assert own[-1].text.startswith(r.text)
            assert (r.loss_start is None) == (at not in replies)
            if at in replies:
                assert r.text[r.loss_end :] == chat_format.CLOSE
                assert r.text[: r.loss_start].endswith(chat_format.OPEN + "assistant" + chat_format.SAY)


def test_read_back_gives_every_turn_and_reply_once(spark):
    rows = chats()
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(chat_format.planted(spark.createDataFrame(rows, TURNS)))).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]", ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "")]
    grouped = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(grouped)
    for conv, turns in grouped.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        told = hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), told)
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_python_in_chat_formatting(spark):
    plan = queries.op11_chat_formatting(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_empty_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.read_back(chat_format.examples(none)).count() == 0
    assert turn_repair.repair(turn_repair.damaged(none)).count() == 0


# Conversation repair --------------------------------------------------------------------------------------

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def all_cheapest(symbols):
    """By a plain table over rows and states: the least cost, and the least of all cheapest letters."""
    n, far = len(symbols), math.inf
    table = [[far] * 4 for _ in range(n + 1)]

    def ways(i, q):
        put = STEP[q, "a" if q == 2 else "u"]
        yield "I", 2, i, put
        if i < n:
            yield "D", 3, i + 1, q
            if symbols[i]:
                role, short = symbols[i]
                if (q, role) in STEP:
                    yield "K", int(short), i + 1, STEP[q, role]
                yield "R", 2 + short, i + 1, put

    table[n][0] = table[n][3] = 0
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                table[i][q] = min([table[i][q]] + [c + table[j][p] for _, c, j, p in ways(i, q)])
    letters, i, q = "", 0, 0
    while not (i == n and table[i][q] == 0):
        letter, i, q = min((w, j, p) for w, c, j, p in ways(i, q) if c + table[j][p] == table[i][q])
        letters += letter
    return table[0][0], letters


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_give_the_plain_tables_costs_and_letters(block):
    chance = random.Random(block)
    for n in [*range(9)] * 60 + [50, 203]:
        codes = bytes(chance.randrange(len(turn_repair._SYMBOLS)) for _ in range(n))
        assert turn_repair.cheapest(codes, block) == all_cheapest([turn_repair._SYMBOLS[c] for c in codes])


def plain_repair(rows):
    kept, names = collections.defaultdict(list), set()
    for conv, turn, role, text, *_ in rows:
        names.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        same = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        kept[conv] += [(turn is not None, turn or 0, role, same, text)] * {0: 0, 3: 2}.get(kind, 1)
    result = {}
    for conv in names:
        own, seen, symbols, count = sorted(kept[conv]), set(), [], collections.Counter()
        for _, _, role, _, text in own:
            end = text.rstrip(turn_repair.SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            symbols.append(None if fault in ("blank", "duplicate") else (role[:1], fault == "truncated"))
        cost, audit = all_cheapest(symbols)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[1] for r in own if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        lines, at, place = [], iter(own), len([x for x in audit if x != "D"]) % 2
        for letter in audit:
            row = next(at) if letter != "I" else None
            if letter == "D":
                continue
            own_role = ("assistant", "user")[(len(lines) + place + 1) % 2]
            lines.append(f"{row[2]}:{row[4]}" if letter == "K" else f"{own_role}:{row[4] if row else ''}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return result


def test_repair_is_that_of_plain_python(spark):
    rows = chats()
    got = turn_repair.repair(turn_repair.damaged(spark.createDataFrame(rows, TURNS))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repair_query_is_that_of_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op13_conversation_repair(spark, SMALL).collect()} == plain_repair(rows)


def test_repaired_roles_follow_the_pattern(spark):
    rows = turn_repair.damaged(spark.createDataFrame(chats(), TURNS))
    out = collections.defaultdict(list)
    for r in turn_repair.repaired(rows, turn_repair.audits(rows)).collect():
        out[r.conv_id].append((r.place, r.role))
    for own in out.values():
        assert [p for p, _ in sorted(own)] == list(range(1, len(own) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in sorted(own)))


# Lexical search -------------------------------------------------------------------------------------------

def corpus(seed=8):
    """Equal lengths, ties, equal texts, equal rows, NULL ids and texts, one very long text."""
    chance = random.Random(seed)
    word = lambda: f"w{int(chance.paretovariate(0.6)) % 60}"
    rows = [(chance.choice([*range(500), None]), " ".join(word() for _ in range(chance.choice([1, 3, 8, 8, 8, 40]))), "x") for _ in range(400)]
    rows += [(7, "Équipe W1-w2_W3", "x"), (8, "équipe w1 w2 w3", "x"), (9, None, "x"), (10, " ,.", "x"), (None, None, "x")]
    rows += [(1000 + i, "w1 w2 w2 same text", "x") for i in range(200)] + [(2000, "w4 w5", "x")] * 50
    rows.append((3000, "w1 long " * 200_000, "x"))
    return rows


def plain_search(docs, items, top):
    find = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    bags = [(d, collections.Counter(find.findall((t or "").translate(lower)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked = collections.Counter(find.findall((text or "").translate(lower)))
        scored = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n_docs // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w, k in asked.items() if w in b)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("block_docs,visits", [(8192, 16), (16, 1)])
def test_search_is_that_of_scoring_everything(spark, block_docs, visits):
    docs = corpus()
    items = [(1, "w1 w2"), (2, "W3 w3 equipe"), (3, None), (4, "nothing here"), (5, "w4 w5 w59 w7 w7 w7"), (5, "w1"), (5, "w1"), (None, "équipe same"), (6, "long " * 1000)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string, score string"), block_docs=block_docs)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 20, visits=visits).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_search([d[:2] for d in docs], items, 20), key=key)


def test_blocks_hold_every_document_once_and_one_length(spark):
    docs = [d for d in corpus() if d[1] and re.search(r"\w", d[1])]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string, score string"), block_docs=16)
    blocks = index.blocks.collect()
    assert sum(b.n for b in blocks) == index.documents == len(docs)
    assert collections.Counter(i for b in blocks for i in b.ids) == collections.Counter(d[0] for d in docs if d[0] is not None)
    assert max(b.n for b in blocks) == 16 and all(b.ids == sorted(b.ids) for b in blocks)
    hot = collections.Counter(b.m for b in blocks).most_common(1)[0][1]
    assert hot > 5  # one length, many blocks


def test_search_drops_blocks_by_proof(spark, monkeypatch):
    """A block whose bound is below the k-th best score is never scored."""
    rows, settle = {}, lexical.settle

    def counted(df, name):
        made = settle(df, name)
        rows[name] = rows.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(lexical, "settle", counted)
    docs = [(i, "needle hay") for i in range(40)] + [(1000 + i, "hay " * (30 + i)) for i in range(300)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"), block_docs=8)
    items = spark.createDataFrame([(1, "needle hay")], "item_id long, text string")
    assert [r.doc_id for r in lexical.search(index, items, 20, visits=5).orderBy("rank").collect()] == list(range(20))
    assert 0 < rows["visits"] < rows["bounds"] / 2


def test_search_of_nothing(spark):
    schema = "doc_id long, text string"
    some, items = spark.createDataFrame([(1, "a b")], schema), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(spark.createDataFrame([], schema)), items).count() == 0
    assert lexical.search(lexical.build(some), items.where("false")).count() == 0
