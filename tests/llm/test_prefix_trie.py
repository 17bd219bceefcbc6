from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tableview.llm import prefix_trie

CONVS = "conv_id long, turn long, role string, text string, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows):
    given = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, digest(role or "", text or ""))
            given[conv].append((key, (role or "", text or "")))
    return {conv: [turn for _, turn in sorted(turns)] for conv, turns in given.items()}


def rebuilt(given):
    made = {}
    for conv, turns in given.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        made[conv] = given.get(base, [])[:h] + turns[h:]
    return made


def brute(made):
    nodes = defaultdict(list)
    for conv, turns in made.items():
        for depth in range(len(turns) + 1):
            nodes[tuple(turns[:depth])].append(conv)
    children = defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    gain = {
        node: (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for node, convs in nodes.items()
    }
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in nodes:
        for depth in range(len(node) + 1):
            saved[node[:depth]] += gain[node]
            leaves[node[:depth]] += node not in children
    rows = []
    for node, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        rows.append(
            (min(convs), len(node), parent, len(convs), children.get(node, 0), leaves[node], saved[node])
            + (hashlib.sha256(ends.encode()).hexdigest(),)
        )
    return sorted(rows, key=str)


def cases(seed=1, convs=120, longest=14):
    rng = random.Random(seed)
    texts = ["yes", "no way", "", None, "a\tb  c", "ünï 中文", "x"]
    rows = []
    for conv in range(convs):
        if conv % 20 == 0 and conv % 60:
            continue
        size = rng.choice([1, 2, 3, 4, 5, 8, 9, longest])
        same = rng.random() < 0.6
        for turn in range(size):
            role = ["user", "assistant", None][turn % 2 if same else rng.randrange(3)]
            text = "common words" if same and turn < 6 else rng.choice(texts)
            rows.append((conv, turn * 3, role, text, "own"))
    rows += [(500, None, "a", "first", None), (500, None, None, "b", None), (500, 7, "", "", None)]
    rows += [(501, 1, "u", "twice", None)] * 2 + [(None, 0, "u", "lost", None)]
    rows += [(-7, 0, "u", "below", None), (-20, 0, "u", "low", None), (-20, 1, "u", "lower", None)]
    rows += [(at, 0, "user", "hot", None) for at in range(1000, 1040)]
    rng.shuffle(rows)
    return rows


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_against_brute_force(spark, block):
    made = sequences(cases(block))
    given = prefix_trie.turns(spark.createDataFrame(cases(block), CONVS).repartition(5))
    ids = given.select("conv_id").distinct()
    assert found(prefix_trie.trie(ids, given, block)) == brute(made)


def test_grafted_conversations_against_brute_force(spark):
    frame = prefix_trie.grafted_trie(spark.createDataFrame(cases(), CONVS))
    assert frame.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256",
    ]
    made = rebuilt(sequences(cases()))
    assert any(not turns for turns in made.values())
    assert found(frame) == brute(made)


def test_slots_and_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLOT", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    rows = cases(4) + [(3, turn, "u", f"long {turn}", None) for turn in range(100, 160)]
    frame = prefix_trie.grafted_trie(spark.createDataFrame(rows, CONVS))
    assert found(frame) == brute(rebuilt(sequences(rows)))


def test_only_a_root_where_no_conversation_has_turns(spark):
    # 25 takes its first turns from 20, which is not there; 1 of its own turns is replaced.
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, turn, "u", "gone", None) for turn in range(3)]
    frame = prefix_trie.grafted_trie(spark.createDataFrame(rows, CONVS))
    ends = hashlib.sha256(str(conv).encode()).hexdigest()
    assert found(frame) == [(conv, 0, None, 1, 0, 1, 0, ends)]


def test_empty_table(spark):
    assert found(prefix_trie.grafted_trie(spark.createDataFrame([], CONVS))) == []
