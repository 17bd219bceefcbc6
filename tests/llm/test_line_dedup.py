from __future__ import annotations

import math
import random
import re

import xxhash

from tableview.llm import line_dedup

DOCS = "doc_id long, text string, n_chars int, row string"


def normalised(line):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")


def simhash(line):
    hashes = [xxhash.xxh64_intdigest(word.encode(), seed=42) for word in set(line.split(" "))]
    counts = [sum(h >> bit & 1 for h in hashes) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(hashes))


def size_class(size):
    return sum(size >= 24 * 2**step for step in range(5))


def blocks(line):
    """(class, block, SimHash of its words) of a line."""
    found = set()
    for kind in {size_class(len(line)), size_class(math.floor(len(line) / 0.8))}:
        dealt = {}
        for word in set(line.split(" ")):
            at = (xxhash.xxh64_intdigest(word.encode(), seed=42) >> 7) % line_dedup.BLOCKS[kind]
            dealt.setdefault(at, []).append(word)
        found |= {
            (kind, at, simhash(" ".join(words)))
            for at, words in dealt.items()
            if len(words) >= line_dedup.BLOCK_WORDS[kind]
        }
    return found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def row_hash(doc, text):
    seed = 42
    for part in (None if doc is None else str(doc), text):
        if part is not None:
            seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def removed(docs, least=12):
    """(doc, text) -> places of the lines that go."""
    places = {}
    for doc, text, *_ in docs:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            kind = normalised(line)
            if len(kind) >= least:
                order = (doc is not None, doc or 0, row_hash(doc, text), at)
                places.setdefault(kind, set()).add((order, (doc, text), at))
    kinds = sorted(places)
    root = {kind: kind for kind in kinds}

    def find(kind):
        while root[kind] != kind:
            kind = root[kind]
        return kind

    sims = {kind: simhash(kind) for kind in kinds}
    keys = {kind: blocks(kind) for kind in kinds}
    for at, a in enumerate(kinds):
        for b in kinds[:at]:
            near = keys[a] & keys[b] and (sims[a] ^ sims[b]).bit_count() <= 24
            if near and find(a) != find(b):
                if distance(a, b) <= int(max(len(a), len(b)) * 0.2):
                    root[find(a)] = find(b)
    groups = {}
    for kind in kinds:
        groups.setdefault(find(kind), set()).update(places[kind])
    gone = {}
    for group in groups.values():
        first = min(group)[0]
        for order, key, at in group:
            if order != first:
                gone.setdefault(key, set()).add(at)
    return gone


def cases():
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(40)] + ["Ärger", "x", "7", "42"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.choice([4, 30, 60, 140]))) for _ in range(14)]
    texts = []
    for _ in range(40):
        own = []
        for line in rng.choices(lines, k=4):
            if rng.random() < 0.5:
                words = line.split(" ")
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                line = " ".join(words)
            own.append(rng.choice(["", "  "]) + line.upper() if rng.random() < 0.2 else line)
        texts.append("\n".join(own + rng.choices(["short", "", "}"], k=2)))
    texts += [None, "", "\n\n", "All rights reserved.\r\nAll rights  reserved. ", "tab\tand blank 1"]
    rows = [(i, text, None if text is None else len(text), "clash") for i, text in enumerate(texts)]
    return rows + [(None, texts[0], 5, None), (3, texts[3], 9, None), (3, texts[4], 9, None)]


def left(text, gone):
    return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)


def test_against_brute_force(spark, monkeypatch):
    docs = cases()
    gone = removed(docs)
    assert len(gone) > 20
    wanted = []
    for doc, text, *_ in docs:
        own = sorted(gone.get((doc, text), ()))
        size = 0 if text is None else text.count("\n") + 1
        wanted.append((doc, size, own, text if not own else left(text, own)))
    frame = spark.createDataFrame(docs, DOCS)
    found = [tuple(row) for row in line_dedup.summary(frame).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    monkeypatch.setattr(line_dedup, "MOST_SENT", 0)
    kept = line_dedup.deduplicated(frame)
    assert kept.columns == frame.columns
    texts = sorted(((row.doc_id, row.text) for row in kept.collect()), key=str)
    stay = [
        (doc, text)
        for (doc, _, own, text) in wanted
        if not own or any(normalised(line) for line in text.split("\n"))
    ]
    assert texts == sorted(stay, key=str)


def test_simhash_of_long_lines(spark):
    sizes = ((1, 1), (127, 9), (128, 50), (40_000, 40_000), (70_000, 70))
    lines = [(i, " ".join(f"w{at % m}" for at in range(n))) for i, (n, m) in enumerate(sizes)]
    frame = line_dedup.with_simhash(spark.createDataFrame(lines, "id long, line string"), ["id"])
    found = {row.id: row.sim % (1 << 64) for row in frame.collect()}
    assert found == {i: simhash(line) for i, line in lines}


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.summary(none).count() == line_dedup.deduplicated(none).count() == 0


def test_large_blocks_meet_in_parts_and_write_no_pairs_that_are_not_alike(spark, monkeypatch):
    """Lines that share a frequent word and a few that are alike without sharing their leader."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=5)) for _ in range(400)]
    lines = [" ".join(["the", *rng.sample(words, 6)]) for _ in range(120)]
    lines += [line.replace(line.split(" ")[3], "queen") for line in lines[:30]]
    docs = [(at, line, len(line), None) for at, line in enumerate(lines)]
    monkeypatch.setattr(line_dedup, "CELLS_AT_ONCE", 7, raising=False)
    rows_of = {}
    keep = line_dedup.written

    def counted(frame, label, *options, **named):
        found = keep(frame, label, *options, **named)
        rows_of.setdefault(label, []).append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "written", counted)
    found = line_dedup.summary(spark.createDataFrame(docs, DOCS)).collect()
    gone = {row.doc_id: set(row.removed) for row in found if row.removed}
    assert gone == {doc: at for (doc, _), at in removed(docs).items()} and len(gone) >= 30
    # Candidates are written against leaders only; crossing them writes what was verified.
    assert len(rows_of["pairs"]) == 1


def test_distances_of_lines_with_words_put_in_left_out_and_replaced(spark):
    rng = random.Random(6)
    words = ["a", "bc", "def", "ghij", "klmno", "äöüßx", "qrstuvwxyzqrstuvwxyz"]
    lines, pairs = [], []
    for at in range(300):
        one = rng.choices(words, k=rng.randrange(1, 12))
        other = list(one)
        for _ in range(rng.randrange(1, 4)):
            place = rng.randrange(len(other) + 1)
            other[place : place + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
        if one != other and other:
            lines += [(2 * at, " ".join(one)), (2 * at + 1, " ".join(other))]
            pairs.append((2 * at, 2 * at + 1))
    text = dict(lines)
    wanted = {
        (a, b) for a, b in pairs
        if distance(text[a], text[b]) <= math.floor(max(len(text[a]), len(text[b])) * 0.2)
    }
    near = line_dedup._verified(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(lines, "kind long, line string"), 0.8
    )
    assert {tuple(row) for row in near.collect()} == wanted
    assert 20 < len(wanted) < len(pairs) - 20


def test_normalised_texts_are_normalised_lines(spark):
    texts = ["A1\t\t b\n  x9  y \r\n\x0b\x0c\n", "1\t2", "", "\n", " Σ\nΑΣ 7\r", "a\u00a0 b", "a  b"]
    frame = spark.createDataFrame([(at, text, 0, "") for at, text in enumerate(texts)], DOCS)
    found = sorted(line_dedup._lines(frame, 0).select("doc", "pos", "line").collect())
    wanted = [(doc, at, normalised(line)) for doc, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    assert [tuple(row) for row in found] == wanted


def test_words_of_a_kind_are_counted_once_for_all_its_blocks(spark, monkeypatch):
    """No function runs over the words of a line for every block and field of a count."""
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (2, 3, 5, 9, 17, 40, 90, 200, 600, 1500)]
    kinds = spark.createDataFrame(list(enumerate(lines)), "kind long, line string")
    for least in (line_dedup.MOST_WORDS, 60):
        monkeypatch.setattr(line_dedup, "MOST_WORDS", least)
        frame = line_dedup.with_blocks(line_dedup.with_classes(kinds, 0.8))
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" in plan and plan.count("lambdafunction") < 8
        found = [tuple(row) for row in frame.collect()]
        long = {kind for key, kind in found if key is None}
        assert long == {at for at, line in enumerate(lines) if len(set(line.split(" "))) >= least}
        alone = line_dedup.with_classes(kinds, 0.8)
        one_by_one = {tuple(row) for row in line_dedup.with_long_blocks(alone).collect()}
        assert {row for row in found if row[0] is not None} == {row for row in one_by_one if row[1] not in long}
        assert len(one_by_one) == sum(len(blocks(line)) for line in lines)


def test_long_lines_are_as_in_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_WORDS", 20)
    docs = cases()
    gone = removed(docs)
    found = line_dedup.summary(spark.createDataFrame(docs, DOCS)).collect()
    wanted = [sorted(gone.get((doc, text), ())) for doc, text, *_ in docs]
    assert sorted(row.removed for row in found) == sorted(wanted)


def test_lines_with_words_put_in_and_left_out_cost_no_distance(spark):
    """Words on both sides of a long line part, so that no word is in the other's place."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=6)) for _ in range(500)]
    one = rng.choices(words, k=300)
    other = one[:20] + ["putin"] + one[20:150] + one[151:250] + ["more", "words"] + one[250:280] + ["x"] + one[281:]
    arrays = [(one, other), (other, one), (one, one), ([], one[:3]), (one[:3], []), (one[:2], one[5:9])]
    frame = spark.createDataFrame(arrays, "x array<string>, y array<string>")
    found = [row[0] for row in frame.selectExpr(line_dedup._aligned("x", "y")).collect()]
    # Lines that end in a blank each: a word goes with its own.
    true = [distance("".join(w + " " for w in x), "".join(w + " " for w in y)) for x, y in arrays]
    assert all(cost >= least for cost, least in zip(found, true))
    assert found[:5] == [6 + 7 + 5 + 6 + 6, 6 + 7 + 5 + 6 + 6, 0, 21, 21]
