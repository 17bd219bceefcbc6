from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tableview.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, min_docs=30, smoothing=5, scale=10**9, top=50):
    groups, own, holding = {}, defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in docs:
        key = (lang or "", source or "")
        groups.setdefault(key, Counter()).update(terms(text))
        own[key[0]].update(terms(text))
        holding[key[0]].update(set(terms(text)))
    kept = {lang: {t for t, n in held.items() if n >= min_docs} for lang, held in holding.items()}

    def shares(counts, lang):
        words = kept[lang]
        below = sum(counts[t] for t in words) + smoothing * len(words)
        return {t: 1 + scale * (counts[t] + smoothing) // below for t in words}

    rows = []
    for (lang, source), counts in groups.items():
        p, q = shares(counts, lang), shares(own[lang], lang)
        pairs = []
        for (far, other), theirs in groups.items():
            if far == lang and other != source:
                r = shares(theirs, lang)
                pairs.append((sum(abs(p[t] - r[t]) for t in p), other))
        found = [(p[t] - q[t], t) for t in p if counts[t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            items.sort(key=lambda item: (-item[0], item[1].encode()))
            rows += [
                (lang, source, part, item, value, rank)
                for rank, (value, item) in enumerate(items[:most], 1)
            ]
    return sorted(rows)


def cases():
    rng = random.Random(11)
    words = ["the", "of", "Élan", "ÉLAN", "naïve", "x", "中文", "a", "to", "in", "it's", "re-do"]
    rows = []
    for at in range(150):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s2", "s3", "s4", "S5", "ß", None, ""])
        text = rng.choice(
            [None, "", "... 12 \x00\t", " ".join(rng.choice(words) for _ in range(rng.randrange(30)))]
        )
        rows.append((at, text, lang, source, "own"))
    rows += [(1, "lonely words", "xx", "s1", None), (2, None, "xx", "s2", None), (3, "", "yy", "s1", None)]
    rows += [(5, "the of the", "en", "s1", None)] * 4 + [(None, "to to in", "de", "s2", None)]
    rows.append((9, "long " * 30_000 + "the of", "en", "s9", None))
    return rows


def found(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("least, smoothing, top", [(30, 5, 50), (3, 1, 2), (1, 5, 50)])
def test_against_brute_force(spark, least, smoothing, top):
    docs = spark.createDataFrame(cases(), DOCS).repartition(3)
    result = divergence.audit(docs, min_docs=least, smoothing=smoothing, top=top)
    assert found(result) == brute(cases(), least, smoothing, top=top)


def test_blocks_of_sources_and_buckets_of_terms_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    docs = spark.createDataFrame(cases(), DOCS)
    groups, shown = divergence.shares(docs, min_docs=2, block=2, bucket=3)
    assert groups.agg({"blocks": "max"}).first()[0] > 2
    assert groups.agg({"buckets": "max"}).first()[0] > 2
    wanted = [(*row[:2], row[3], row[4]) for row in brute(cases(), 2) if row[2] == "pair"]
    assert sorted(map(tuple, divergence.pairs(groups, shown).collect())) == wanted


def test_shares_stay_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**17, 10**18, 3)], "n long, t long, v long")
    share = row.select(divergence._share("n", "t", "v", 5, 10**9)).first()[0]
    assert share == 1 + 10**9 * (9 * 10**17 + 5) // (10**18 + 15)


def test_empty_table(spark):
    assert found(divergence.audit(spark.createDataFrame([], DOCS))) == []
