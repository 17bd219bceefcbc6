from __future__ import annotations

import hashlib
import re

from tableview.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n_words string"
ITEMS = "item_id long, text string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(lowered)


def brute(docs, items, window=10):
    rows = []
    for doc in docs:
        have, hit, found = words(doc[1]), set(), set()
        for item, text in items:
            want = words(text)
            if item is None or not want:
                continue
            size = min(window, len(want))
            windows = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)}
            for i in range(len(have) - size + 1):
                if tuple(have[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc[0], len(have), len(hit), len(found), digest, bool(hit)))
    return sorted(rows, key=str)


def cases():
    docs = [
        (1, "before " + PASSAGE + " after", "en", "x"),
        (2, "Zero, " + PASSAGE.upper().replace(" ", "--") + "!", "en", None),
        (3, "one two three four five six seven eight nine eleven", None, None),
        (4, None, None, None),
        (5, "", None, None),
        (6, " ".join(["la"] * 40), None, None),
        (7, "a Élan vital b " * 3 + PASSAGE, None, None),
        (8, "filler " * 20_000 + PASSAGE, None, None),
        (None, PASSAGE, None, None),
        (1, "before " + PASSAGE + " after", "en", "x"),
        (9, "... !!! ---", None, None),
        (10, " ".join(PASSAGE.split()[3:]) + " x y z", None, None),
    ]
    items = [
        (1, PASSAGE),
        (2, PASSAGE + " thirteen"),
        (3, "élan VITAL"),
        (4, " ".join(["la"] * 12)),
        (5, None),
        (6, "?!"),
        (None, "filler filler"),
        (10, "before one"),
    ]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    wanted = brute(docs, items)
    for options in ({}, {"salts": 1}):
        found = decontaminate.summary(frame, bench, **options).collect()
        assert sorted((tuple(row) for row in found), key=str) == wanted


def test_benchmark_larger_than_the_documents_meets_them_in_a_shuffle(spark):
    docs, items = cases()
    items = items + [(100 + i, f"{PASSAGE} item {i} " + f"number{i} " * 12) for i in range(300)]
    docs = docs + [(500 + i, f"x{i} {PASSAGE} y number7 number7", None, None) for i in range(40)]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        found = decontaminate.summary(frame, bench).collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted((tuple(row) for row in found), key=str) == brute(docs, items)


def test_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = sorted((tuple(row) for row in decontaminate.summary(docs, bench).collect()), key=str)
    assert found == brute(docs.collect(), bench.collect())
    assert any(row[5] for row in found)


def test_clean_keeps_columns_and_clean_documents(spark):
    docs, items = cases()
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {row.doc_id for row in kept.collect()} == {
        row[0] for row in brute(docs, items) if not row[5]
    }


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.summary(none[0], none[1]).count() == 0
    assert not any(
        row.contaminated
        for row in decontaminate.summary(spark.createDataFrame(docs, DOCS), none[1]).collect()
    )
