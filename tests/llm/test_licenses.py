from __future__ import annotations

import random
import re

import pytest

from tableview.llm import licenses
from tableview.llm.license_rules import BASE, CONFIDENCE, RULES, SPAN

DOCS = "doc_id long, text string, lang string, labels string, n_words long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. See https://www.apache.org/licenses/LICENSE-2.0"
)
MIT = "The MIT License (MIT)\nPermission is hereby granted, free of charge, to any person obtaining a copy"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Every rule over the whole text, every pair of detections compared."""
    have = words(text)
    plain = " " + " ".join(have) + " "
    found = []
    for at, rule in enumerate(RULES):
        for match in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", plain):
            first = plain[: match.start()].count(" ") - 1
            found.append((first, first + match[0].count(" ") + 1, at))

    def beats(one, other):
        inside = one[0] <= other[0] and other[1] <= one[1]
        strong, weak = RULES[one[2]].priority, RULES[other[2]].priority
        if (one[0], one[1], strong) == (other[0], other[1], weak):
            return one[2] < other[2]
        return inside and strong <= weak

    left = [one for one in found if not any(beats(two, one) for two in found if two is not one)]
    base = sorted(
        (at, label)
        for phrase, label in BASE.items()
        for at in range(len(have))
        if have[at : at + len(phrase.split())] == phrase.split()
    )
    own = {label for _, label in base}
    return (
        len(have),
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted(own)),
        ",".join(sorted(own | {RULES[at].label for _, _, at in left})),
        max((CONFIDENCE[RULES[at].priority] for _, _, at in left), default=0.0),
        len(left),
    )


def sampled(pattern, rng):
    """A text that the pattern matches: of every choice one, of options some."""
    text = pattern
    while (group := re.search(r"\(\?:([^()]*)\)(\?|\{0,\d\})?", text)) is not None:
        chosen = rng.choice(group[1].split("|"))
        chosen = "" if group[2] and rng.random() < 0.5 else chosen
        text = text[: group.start()] + chosen + text[group.end() :]
    text = text.replace("[cs]", rng.choice("cs")).replace("[abc]", "b").replace("[234]", "3")
    text = text.replace("\\S+", "somebody")
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", text)


def test_there_are_hundreds_of_rules_and_each_is_found():
    assert len(RULES) >= 300
    scanner, rng = licenses.Scanner(), random.Random(3)
    for at, rule in enumerate(RULES):
        text = sampled(rule.pattern, rng).split()
        assert len(text) <= SPAN
        found = [one for one in scanner.search([w.encode() for w in text]) if one[2] == at]
        assert found, (rule, text)


def test_no_rule_is_longer_than_the_window():
    for rule in RULES:
        longest = re.sub(r"\{0,(\d)\}", lambda m: "x" * int(m[1]), rule.pattern)
        assert longest.count(" ") + 8 <= SPAN, rule


def cases(rng):
    pieces = [
        APACHE, MIT, "CC BY-NC 4.0", "cc by", "CC-BY", "gnu General-Public license", "GPL v3",
        "SPDX-License-Identifier: Apache-2.0", "mit", "license", "apache", "Mit der Lizenz",
        "GNU Lesser General Public License version 2.1", "GNU General Public License, version 3 or later",
        "Creative Commons Attribution-ShareAlike 4.0 International", "the BSD license", "BSD 3-Clause",
        "released under the MIT License", "https://opensource.org/licenses/MIT", "all rights reserved",
        "cc by cc by sa 4.0", "mit license mit license", "über ein élan 中文", "1 2 3", "...",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    texts = [None, "", " ", "?!", APACHE, MIT, *pieces]
    for _ in range(40):
        size = rng.randrange(1, 12)
        texts.append(" ".join(rng.choice(pieces + ["filler"] * 10) for _ in range(size)))
    texts.append("filler word " * 2_000 + APACHE + " filler" * 1_000 + " " + MIT)
    texts.append("license " * 300)
    return texts


def test_against_brute_force(spark):
    texts = cases(random.Random(5))
    rows = [(at, text, "en", "x", 1) for at, text in enumerate(texts)]
    rows += [(None, MIT, None, None, None), rows[4], rows[4]]
    found = licenses.summary(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    wanted = [(row[0], *brute(row[1])) for row in rows]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_a_better_detection_hides_those_inside_it(spark):
    rows = [(1, "Licensed under the GNU General Public License, version 3.", None, None, None)]
    found = licenses.summary(spark.createDataFrame(rows, DOCS)).first()
    assert (found.n_base, found.base_labels) == (1, "gpl")
    assert (found.labels, found.score, found.n_detections) == ("gpl,gpl-3.0", 0.95, 1)


def test_detections_have_their_places_and_the_columns_of_the_documents(spark):
    rows = [(1, "see the MIT license", "en", "own", 4), (2, "nothing", "en", "own", 4), (3, None, None, None, None)]
    found = licenses.detections(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "a.b"))
    assert found.columns == ["doc_id", "a.b", "labels", "n_words", "label", "first_word", "words", "priority"]
    assert [tuple(row)[:7] for row in found.collect()] == [(1, "en", "own", 4, "mit", 2, 2)]


@pytest.mark.parametrize("schema", [DOCS, "doc_id long, text string"])
def test_empty_table(spark, schema):
    assert licenses.summary(spark.createDataFrame([], schema)).collect() == []
