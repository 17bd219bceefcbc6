from __future__ import annotations

import hashlib
import math
import random
import re

from tableview.llm import pii

DOCS = "doc_id long, text string, spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    text, found = text or "", []
    for rank, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for match in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", match[0])
            if rank == 1 and any(int(part) > 255 for part in match[0].split(".")):
                continue
            if rank == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if rank == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((match.start(), rank, match.end()))
    return sorted(found)


TEXTS = [
    "é mail a.b+c@x-y.co.uk, a@b.c@d.e@f.g and @x.y or z@localhost",
    "ip 10.0.0.255 300.1.1.1 1.2.3.4.5.6.7.8 001.2.3.4 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 0",
    "call +1 (555) 123-4567 or +49.30.1234567- and +12 or +1234567890123456",
    "+4111 1111 1111 1111 user@10.0.0.1",
    None,
    "",
    "no data at all",
    "a" * 200_000 + "@",
    "1" * 100_000 + ".1.1.1 " + "1 " * 50_000,
    "@" * 50_000 + "x@y.z",
]


def test_patterns_against_plain_regex(spark):
    rows = [(i, text, "clash") for i, text in enumerate(TEXTS)] + [(None, TEXTS[0], None)]
    for text in TEXTS[:8]:
        assert pii.pattern_spans(text or "") == brute(text)
    frame = spark.createDataFrame(rows, DOCS)
    found = {row.doc_id: row for row in pii.summary(frame).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows[:8]:
        own = brute(text)
        listed = ",".join(f"{pii.KINDS[rank]}:{start}:{end}" for start, rank, end in own)
        assert found[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert found[i].spans == listed
        counts = [sum(span[1] == rank for span in own) for rank in range(4)]
        assert [found[i][f"n_{kind}"] for kind in pii.KINDS[:4]] == counts
    assert found[8].n_email == found[9].n_card == 0
    assert found[10].n_email == 1


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {row.doc_id: row.base_sha256 for row in pii.summary(docs).collect()}
    for doc_id, text in docs.collect():
        listed = ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in brute(text))
        assert found[doc_id] == hashlib.sha256(listed.encode()).hexdigest()


def test_terms_that_reveal(spark):
    rows = [(i, f"note {i} of brigadier Zweig: mail ann@x.org today {i}", "") for i in range(6)]
    rows += [(100 + i, f"nothing of note here today {i}", "") for i in range(60)]
    copies = [(200 + i, "the secretkeeper wrote to bob@y.org once", "") for i in range(9)]
    frame = spark.createDataFrame(rows + copies, DOCS)
    found = {row.doc_id: row.spans for row in pii.summary(frame).collect()}
    first = rows[0][1]
    begin = first.index("brigadier")
    assert f"term_removed:{begin}:{begin + 9}" in found[0]
    assert "email:" in found[0] and ":" + str(first.index("note")) + ":" not in found[0]
    assert all(not found[100 + i] for i in range(60))
    assert "term" not in found[200]
    clean = {row.doc_id: row.text for row in pii.sanitised(frame).collect()}
    assert "[EMAIL]" in clean[0] and "brigadier" not in clean[0] and "today" in clean[0]
    assert clean[100] == rows[6][1]
    assert pii.sanitised(frame).columns == frame.columns


def test_term_far_from_the_entity_and_without_it(spark):
    filler = [f"word{i}" for i in range(3000)]
    far = [(i, f"ann@x.org {i} " + " ".join(filler[50 * i : 50 * i + 50]) + " Zweighaupt", "") for i in range(5)]
    alone = [(50, "the letter of Zweighaupt", "")]
    other = [(100 + i, f"plain text number {i}", "") for i in range(60)]
    frame = spark.createDataFrame(far + alone + other, DOCS)
    found = {row.doc_id: row.spans for row in pii.summary(frame).collect()}
    for doc_id, text, _ in far + alone:
        at = text.index("Zweighaupt")
        assert f"term_removed:{at}:{at + 10}" in found[doc_id]
    clean = [row.text for row in pii.sanitised(frame).collect()]
    assert not any("Zweighaupt" in text for text in clean)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_terms(rows, part, min_chars, support, removed, generalised):
    """All spans of all documents, by plain counting."""
    total, held, with_entity, with_term, together = len(rows), {}, {}, {}, {}
    for doc_id, text in rows:
        base = brute(text)
        words = [
            (m.start(), m.end(), folded(m[0]), at // part)
            for at, m in enumerate(re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text))
        ]
        for word in words:
            with_term.setdefault(word[2], set()).add(doc_id)
        words = [w for w in words if w[1] - w[0] >= min_chars]
        words = [w for w in words if all(w[1] <= s or e <= w[0] for s, _, e in base)]
        held[doc_id] = base, words
        for start, kind, end in base:
            value = text[start:end]
            entity = kind, folded(value) if kind < 2 else re.sub("[^0-9]", "", value)
            with_entity.setdefault(entity, set()).add(doc_id)
            before = len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text[:start]))
            for w in words:
                if abs(w[3] - before // part) <= 1:
                    together.setdefault((entity, w[2]), set()).add(doc_id)
    texts, ranks = dict(rows), {}
    for (entity, term), docs in together.items():
        n_entity, n_term = len(with_entity[entity]), len(with_term[term])
        if len({texts[doc] for doc in docs}) < support or n_entity == total:
            continue
        share = math.log2(len(docs) * total / (n_entity * n_term)) / -math.log2(n_entity / total)
        if share >= generalised:
            ranks[term] = min(ranks.get(term, 5), 4 if share >= removed else 5)
    return {
        doc: sorted(base + [(w[0], ranks[w[2]], w[1]) for w in words if w[2] in ranks])
        for doc, (base, words) in held.items()
    }


def test_terms_against_plain_counting(spark):
    for seed, part in ((1, 1000), (2, 8), (3, 3)):
        draw = random.Random(seed)
        vocabulary = [f"{a}{b}" for a in ("tom", "größe", "Ünder", "x1") for b in "abcdefghij"]
        entities = ["ann@x.org", "Bob@y.org", "10.0.0.1", "+1 555 123 4567"]
        rows = []
        for doc_id in range(80):
            words = draw.choices(vocabulary, k=draw.randint(0, 30))
            for place, entity in enumerate(entities):
                if draw.random() < 0.15:
                    words.insert(draw.randint(0, len(words)), entity)
                    words.insert(draw.randint(0, len(words)), f"Secret{place}")
                if draw.random() < 0.04:
                    words.append(f"secret{place}")
            rows.append((doc_id, " ".join(words)))
        rows += [(200 + i, rows[i % 3][1]) for i in range(9)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        expected = brute_terms(rows, part, 4, 3, 0.8, 0.5)
        kinds = {span[1] for spans in expected.values() for span in spans}
        assert 5 in kinds and (4 in kinds or part < 1000)
        found = pii.summary(frame, part=part, removed=0.8, generalised=0.5).collect()
        for row in found:
            own = expected[row.doc_id]
            assert row.spans == ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in own)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.summary(none).count() == pii.sanitised(none).count() == 0
