"""The conversation trie against brute force, on whole tables and on ranges so small that boundaries meet everywhere."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import rows
from stopclock.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, ids string, words int, key string, level int, shard int, side int, depth int, kind int"


def table(seed: int = 4) -> list[tuple]:
    rng, out = random.Random(seed), []
    pool = ["", "hello there", "a b  c", "what is this?", "x" * 40_000, "été\tÜber \x0b z", "one"]
    for c in range(120):
        if c % 17 == 5:
            continue
        size = rng.choice([1, 1, 2, 3, 5, 9, 20])
        hot = c % 3 == 0
        for t in range(3 if hot else size):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", "hot" if hot else rng.choice(pool)))
    out += [(200 + c, t, "user", "many turns" if t < 30 else f"{c % 4} {t}") for c in range(12) for t in range(40)]
    out += [(-40, 1, "user", "below zero"), (-41, None, None, None), (-41, 0, "user", None), (7, None, None, "first"), (9, 3, "user", "tie"), (9, 3, "bot", "tie"), (9, 3, "user", "tie")]
    out += [(None, 0, "user", "no conversation")] * 3
    rng.shuffle(out)
    return [(*r, 1, "i", 2, "k", 1, 1, 1, 1, 1) for r in out]


def brute(table: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text, *_ in table:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    plain = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in plain.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole[c] = plain.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
        ends[tuple(whole[c])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += tokens
            leaves[p[:d]] += not kids[p]
    return sorted(
        (
            (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=repr,
    )


@pytest.mark.parametrize("range_turns, fan", [(trie.RANGE_TURNS, trie.FAN), (60, 4), (15, 2), (3, 2)])
def test_equal_to_brute_force(spark, range_turns, fan):
    data = table()
    sequences = trie.branched(trie.turn_sequences(spark.createDataFrame(data, SCHEMA).repartition(5)))
    found = trie.prefix_trie(sequences, range_turns, fan)
    assert [f.dataType.simpleString() for f in found.schema if f.name != "ends_sha256"] == ["bigint"] * 7
    assert rows(found) == brute(data)


def test_conversations_without_turns_and_none_at_all(spark):
    # Conversation 23 (h = 1) has one turn and no base, so it is a member of the root alone.
    data = [(c, 0, "user", "x", 1, "i", 2, "k", 1, 1, 1, 1, 1) for c in (23, 29, 3)]
    found = trie.prefix_trie(trie.branched(trie.turn_sequences(spark.createDataFrame(data, SCHEMA))))
    assert rows(found) == brute(data)
    empty = trie.branched(trie.turn_sequences(spark.createDataFrame([], SCHEMA)))
    assert trie.prefix_trie(empty).count() == 0


def test_sorted_prefixes_of_random_sequences():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sequences = [[tuple(rng.integers(0, 2, 2).tolist()) for _ in range(rng.integers(0, 20))] for _ in range(40)]
        ids = rng.permutation(40)
        offsets = np.append(0, np.cumsum([len(s) for s in sequences]))
        turns = np.array([t for s in sequences for t in s], np.uint64).reshape(-1, 2)
        order, common = trie.sorted_prefixes(turns, offsets, ids)
        expected = sorted(range(40), key=lambda i: (sequences[i], ids[i]))
        assert order.tolist() == expected
        for k in range(1, 40):
            a, b = sequences[expected[k - 1]], sequences[expected[k]]
            shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == shared
