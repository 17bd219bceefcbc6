"""Fuzzy line deduplication over the whole corpus, in DataFrame operations only.

Lines end at a line feed. A line is normalised: lower case, digits as 0, white space as one blank,
none outside. Lines of fewer than `MIN_CHARS` normalised characters are left alone. Lines that are
equal so are one kind of line, known by a hash.

1. The words of a kind are dealt to blocks by their hashes. Every block has a SimHash of 64 bits of
   its own words, the kind one of all words. A changed word touches the bits of two blocks at the
   most, so by the pigeonhole principle two kinds of k blocks that differ in fewer than k / 2 words
   agree in all bits of some block.
2. `BLOCKS` gives more blocks to longer lines, by classes of their length. A kind has the blocks of
   its own class and of the class of the longest line that can be similar to it, so that any two
   similar lines share a class. Kinds that agree in a block of a class, of `BLOCK_WORDS` words or
   more, meet under it. Pairs of them
   are taken up if their lengths allow `SIMILARITY` and the SimHashes of all their words differ in
   at most `DISTANCE` of 64 bits (two unrelated lines: 32 on average).
3. A pair is verified: the edit distance must be at most (1 - `SIMILARITY`) of the longer line.
4. Connected kinds are a group. Of all its occurrences the first one stays, by doc_id and place.

Under each block every kind is compared with one leader first. Then only kinds that are not yet
connected are compared with each other, so a group of many variants costs as many comparisons as
it has members. Connection through kinds of other blocks counts; no link between groups is left out.
Kinds of a block that are not alike are compared in pairs, which grows with the square of a large
block: the block is dealt to parts of `CELLS_AT_ONCE` kinds, and only links are written.

Null texts stay null. Empty texts have no line to remove. Rows without doc_id come first in the
order. Rows with the same doc_id and text are one document and are treated alike.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableview.catalog import quoted
from tableview.llm.graph import components
from tableview.llm.tables import discard, written

MIN_CHARS = 12
SIMILARITY = 0.8
DISTANCE = 24
#: Blocks of a line by the class of its length: below 24 characters, 48, 96, and so on by doubling.
BLOCKS = (2, 3, 4, 5, 6, 8)
#: Words that a block of each class must have: fewer say too little of a long line.
BLOCK_WORDS = (1, 1, 1, 2, 3, 3)
#: Different words of a line from which on its blocks are not counted in fields of 16 bits.
MOST_WORDS = 1 << 15
#: Kinds sent to all tasks rather than joined by a shuffle.
MOST_SENT = 500_000

#: Kinds of a block that one task compares with all others of the block.
CELLS_AT_ONCE = 1000

#: White space other than the blank.
SPACES = "\t\x0b\x0c\r"


def normalised(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(line), "[1-9]", "0")
    return F.trim(F.regexp_replace(plain, f"[ {SPACES}]{{2,}}|[{SPACES}]", " "))


def _normalised_texts(docs: DataFrame) -> DataFrame:
    """The same for all lines of `text` at once, but for the blanks around a line. What is rarely
    needed is looked for first."""
    odd = [F.contains("text", F.lit(space)) for space in SPACES]
    blanks = F.translate("text", SPACES, " " * len(SPACES))
    single = F.regexp_replace("text", " {2,}", " ")
    docs = docs.withColumn("text", F.regexp_replace(F.lower("text"), "[1-9]", "0"))
    docs = docs.withColumn("text", F.when(reduce(or_, odd), blanks).otherwise(F.col("text")))
    return docs.withColumn("text", F.when(F.contains("text", F.lit("  ")), single).otherwise(F.col("text")))


def _ones(width: int, end: int = 64) -> int:
    return sum(1 << place for place in range(0, end, width))


def _counts(hashes: str, width: int) -> str:
    """For each of 64 bits how many of the hashes have it: an array of longs that hold 64 / width
    counts each, for fewer than 2 ** (width - 1) hashes."""
    sums = [
        f"aggregate({hashes}, 0L, (s, h) -> s + (shiftright(h, {k}) & {_ones(width)}L))" for k in range(width)
    ]
    return f"array({', '.join(sums)})"


def _majority(n: str, counts: list[str], width: int) -> str:
    """The SimHash of such counts: the bits that more than half of the n hashes have. A count that
    is larger carries into the highest bit of its field; the last field has no place for that."""
    last = 64 - width
    low = _ones(width, last)
    bits = []
    for k, count in enumerate(counts):
        carried = f"({count} & {(1 << last) - 1}L) + ({(1 << width - 1) - 1}L - {n} div 2) * {low}L"
        bits.append(f"shiftrightunsigned(({carried}) & {low << width - 1}L, {width - 1 - k})")
        bits.append(f"if(shiftrightunsigned({count}, {last}) > {n} div 2, shiftleft(1L, {last + k}), 0L)")
    return f"({' | '.join(bits)})"


def _counted(hashes: str) -> str:
    """Counts of any number of hashes: fields of 8 bits for fewer than 128, and so on."""
    n = f"size({hashes})"
    usual, many, most = (_counts(hashes, width) for width in (8, 16, 32))
    return f"if({n} < {1 << 7}, {usual}, if({n} < {1 << 15}, {many}, {most}))"


def _sim(n: str, counts: str) -> str:
    usual, many, most = (
        _majority(n, [f"element_at({counts}, {k + 1})" for k in range(width)], width) for width in (8, 16, 32)
    )
    return f"if({n} < {1 << 7}, {usual}, if({n} < {1 << 15}, {many}, {most}))"


#: The hashes of the different blank-separated words of `line`.
_HASHES = "array_distinct(transform(split(line, ' '), word -> xxhash64(word)))"


def _sims(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the lines, `n`, the number of their different words, and their SimHash."""
    hashed = lines.select(*keys, F.expr(_HASHES).alias("hashes"))
    counted = hashed.select(*keys, F.size("hashes").alias("n"), F.expr(_counted("hashes")).alias("counts"))
    return counted.select(*keys, "n", F.expr(_sim("n", "counts")).alias("sim"))


def with_simhash(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the lines with the SimHash of the different blank-separated words of `line`."""
    return _sims(lines, keys).drop("n")


def _at(values: tuple[int, ...]) -> str:
    """The value of the class, null for none."""
    return f"get(array({', '.join(map(str, values))}), class)"


def _key(sim: str) -> Column:
    return F.expr(f"xxhash64(class, block, {sim})").alias("key")


def with_blocks(kinds: DataFrame) -> DataFrame:
    """(key, kind) for each block that has words enough, of kinds with their line and classes.

    The kinds have one row each and lie by kind already: their words are counted where they are.
    A kind of more words than the counts hold has one row without a key, for `with_long_blocks`.
    """
    words = kinds.select("kind", "classes", F.expr(_HASHES).alias("hashes"))
    fits = F.size("hashes") < MOST_WORDS
    words = words.select(
        "kind",
        F.explode(F.when(fits, F.col("classes")).otherwise(F.array(F.lit(-1)))).alias("class"),
        F.when(fits, F.col("hashes")).otherwise(F.array(F.lit(0).cast("long"))).alias("hashes"),
    )
    words = words.select("kind", "class", F.explode("hashes").alias("h"))
    block = f"cast(pmod(shiftrightunsigned(h, 7), {_at(BLOCKS)}) AS int)"
    words = words.select("kind", "class", F.expr(block).alias("block"), "h")
    sums = [F.expr(f"sum(shiftright(h, {k}) & {_ones(16)}L)").alias(f"c{k}") for k in range(16)]
    counted = words.groupBy("kind", "class", "block").agg(F.count("*").alias("n"), *sums)
    counted = counted.where(f"class < 0 OR n >= {_at(BLOCK_WORDS)}")
    key = _key(_majority("n", [f"c{k}" for k in range(16)], 16))
    return counted.select(F.when(F.col("class") >= 0, key).alias("key"), "kind")


def with_long_blocks(kinds: DataFrame) -> DataFrame:
    """The same for kinds of any number of words, one by one."""
    dealt = kinds.select("kind", F.explode("classes").alias("class"), F.expr(_HASHES).alias("hashes"))
    dealt = dealt.select("*", F.expr(f"explode(sequence(0, {_at(BLOCKS)} - 1))").alias("block"))
    own = f"filter(hashes, h -> pmod(shiftrightunsigned(h, 7), {_at(BLOCKS)}) = block)"
    dealt = dealt.select("kind", "class", "block", F.expr(own).alias("own"))
    dealt = dealt.where(f"size(own) >= {_at(BLOCK_WORDS)}")
    dealt = dealt.select("*", F.size("own").alias("n"), F.expr(_counted("own")).alias("counts"))
    return dealt.select(_key(_sim("n", "counts")), "kind")


def _class(size: Column) -> Column:
    """The class of a line of so many characters."""
    steps = [F.when(size >= 24 << step, 1).otherwise(0) for step in range(len(BLOCKS) - 1)]
    return sum(steps[1:], steps[0])


def with_classes(lines: DataFrame, similarity: float) -> DataFrame:
    """The lines with their `size` and the `classes` that their blocks are made for."""
    size = F.char_length("line")
    longest = F.floor(size / F.lit(similarity))
    classes = F.array_distinct(F.array(_class(size), _class(longest)))
    return lines.withColumns({"size": size, "classes": classes})


def _lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc, row, pos, line (normalised) and its kind, of the lines long enough."""
    docs = documents.select(F.col("doc_id").alias("doc"), "text")
    docs = _normalised_texts(docs.select("doc", _row("doc", "text").alias("row"), "text"))
    lines = docs.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    lines = lines.where(F.char_length("line") >= min_chars)
    return lines.withColumn("kind", F.xxhash64("line"))


def _row(doc: str, text: str) -> Column:
    return F.xxhash64(F.col(doc).cast("string"), F.col(text))


def _texts(kinds: DataFrame, lines: DataFrame) -> DataFrame:
    """(kind, line) of the kinds."""
    kinds = written(kinds.distinct(), "kinds")
    if kinds.count() <= MOST_SENT:
        kinds = F.broadcast(kinds)
    return written(lines.select("kind", "line").join(kinds, "kind").dropDuplicates(["kind"]), "texts")


def _trimmed(pairs: DataFrame) -> DataFrame:
    """The pairs without the words that `x` and `y` begin with in common."""
    differ = "array_position(zip_with(x, y, (v, w) -> v <=> w), false)"
    pairs = pairs.withColumn("at", F.expr(f"greatest(cast({differ} AS int), 1)"))
    cut = [F.expr(f"slice({side}, at, size({side}))").alias(side) for side in ("x", "y")]
    return pairs.select("a", "b", "most", *cut)


def _reversed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"x": F.reverse("x"), "y": F.reverse("y")})


def _size(word: str) -> str:
    return f"char_length({word})"


def _aligned(x: str, y: str) -> str:
    """What it costs to make the words x the words y in the order they come: an edit distance or
    more. `j` is the place in y; a word left out or put in goes with one blank."""
    v, v1 = f"get({x}, i)", f"get({x}, i + 1)"
    w, w1, w2 = f"get({y}, s.j)", f"get({y}, s.j + 1)", f"get({y}, s.j + 2)"
    longest = f"greatest({_size(v)}, {_size(w)})"
    replaced = f"if({longest} <= 32, levenshtein({v}, {w}), {longest})"
    state = "named_struct('j', s.j + {}, 'cost', s.cost + {})".format
    steps = f"""CASE
        WHEN s.j >= size({y}) THEN {state(0, f"{_size(v)} + 1")}
        WHEN {v} <=> {w} THEN {state(1, 0)}
        WHEN {v1} = {w1} THEN {state(1, replaced)}
        WHEN {v} = {w1} THEN {state(2, f"{_size(w)} + 1")}
        WHEN {v1} = {w} THEN {state(0, f"{_size(v)} + 1")}
        WHEN {v} = {w2} THEN {state(3, f"{_size(w)} + {_size(w1)} + 2")}
        WHEN get({x}, i + 2) = {w} THEN {state(0, f"{_size(v)} + 1")}
        ELSE {state(1, replaced)} END"""
    rest = f"aggregate(slice({y}, s.j + 1, size({y})), s.cost, (cost, w) -> cost + char_length(w) + 1)"
    start = "named_struct('j', 0, 'cost', 0)"
    return f"aggregate(transform({x}, (v, i) -> i), {start}, (s, i) -> {steps}, s -> {rest})"


def _most(one: str, other: str, similarity: float) -> str:
    """The edit distance allowed to lines of such sizes."""
    longest = f"greatest({one}, {other})"
    return f"cast(floor({longest} * {1 - similarity:.6f}) AS int)"


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of kinds whose lines are near in edit distance.

    Words that both lines begin or end with do not change the distance. Putting the words between
    in the other's place one by one, or all at once, is one way to edit them: where that is near
    enough no distance has to be computed. Nor where it is near enough to follow the words of both
    and to leave out or put in those that the other line has a word or two further on.
    """
    pairs = written(pairs, "pairs")
    texts = _texts(pairs.select(F.col("a").alias("kind")).union(pairs.select("b")), lines)
    both = pairs.join(texts.toDF("a", "one"), "a").join(texts.toDF("b", "other"), "b")
    both = both.withColumn("most", F.expr(_most("char_length(one)", "char_length(other)", similarity)))
    both = both.select("a", "b", "most", F.split("one", " ").alias("x"), F.split("other", " ").alias("y"))
    both = _reversed(_trimmed(_reversed(_trimmed(both))))
    # A word on one side only goes with one blank.
    size = "coalesce(char_length({0}), -1)".format
    word = f"if(v <=> w, 0, greatest({size('v')}, {size('w')}) + if(v IS NULL OR w IS NULL, 1, 0))"
    in_place = f"aggregate(zip_with(p.x, p.y, (v, w) -> {word}), 0, (s, d) -> s + d)"
    one, other = "array_join(p.x, ' ')", "array_join(p.y, ' ')"
    gone = "size(p.x) = 0 OR size(p.y) = 0"
    at_once = f"greatest(char_length({one}), char_length({other})) + if({gone}, 1, 0)"
    steps = [f"{in_place} <= p.most", f"{at_once} <= p.most", f"NOT ({gone}) AND {_aligned('p.x', 'p.y')} <= p.most"]
    near = f"if({gone}, false, levenshtein({one}, {other}, p.most) >= 0)"
    for step in reversed(steps):
        near = f"if({step}, true, {near})"
    # As the variable of a function the words are made once, wherever the filter is moved to.
    near = f"exists(array(named_struct('x', x, 'y', y, 'most', most)), p -> {near})"
    links = written(both.where(near).select("a", "b"), "links")
    discard(pairs, texts)
    return links


def _near(similarity: float, distance: int) -> Column:
    """Whether (size, sim) and (other_size, other_sim) may belong to lines that are alike."""
    longest = F.greatest("size", "other_size")
    allowed = F.floor(longest * F.lit(1 - similarity))
    fits = longest - F.least("size", "other_size") <= allowed
    alike = F.coalesce(F.bit_count(F.col("sim").bitwiseXOR(F.col("other_sim"))) <= distance, F.lit(True))
    return fits & alike


def repeats(
    documents: DataFrame,
    min_chars: int = MIN_CHARS,
    similarity: float = SIMILARITY,
    distance: int = DISTANCE,
) -> DataFrame:
    """(doc, row, removed): the places of the lines that go, of the documents that lose any."""
    # The text goes with the lines: making it again costs more than keeping it for a while.
    lines = written(_lines(documents, min_chars), "lines", compression="zstd")
    placed = lines.select("doc", "row", "pos", "kind")
    firsts = placed.groupBy("kind").agg(F.min(F.struct("doc", "row", "pos")).alias("first"))
    kinds = lines.groupBy("kind").agg(F.any_value("line").alias("line"))
    sketched = written(with_blocks(with_classes(kinds, similarity)), "kinds")
    keyed = sketched.where("key IS NOT NULL")
    long = sketched.where("key IS NULL").select("kind")
    if not long.isEmpty():
        kinds = lines.select("kind", "line").join(long, "kind").dropDuplicates(["kind"])
        keyed = keyed.union(with_long_blocks(with_classes(kinds, similarity)))

    # Most blocks occur once. What is left of them takes one exchange: the counts are made and met
    # where the blocks of a key lie.
    keyed = keyed.repartition("key")
    again = keyed.groupBy("key").agg(F.min("kind").alias("lead"), F.count("*").alias("n"))
    again = again.where("n > 1").select("key", "lead")
    shared = written(keyed.join(again.hint("shuffle_hash"), "key"), "shared")
    discard(sketched)

    # Only the kinds that meet others are read again.
    texts = _texts(shared.select("kind"), lines)
    sims = _sims(texts.withColumn("size", F.char_length("line")), ["kind", "size", "line"])
    sims = sims.withColumn("sim", F.when(F.col("n") < 1 << 15, F.col("sim"))).drop("n")
    texts, given = written(sims, "sims"), texts
    discard(given)
    small = texts.select("kind", "size", "sim")

    near = _near(similarity, distance)
    stars = shared.where("kind <> lead").select("kind", "lead").distinct()
    stars = stars.join(small, "kind").join(small.toDF("lead", "other_size", "other_sim"), "lead").where(near)
    stars = stars.select(F.col("kind").alias("a"), F.col("lead").alias("b"))
    first = _verified(stars, texts, similarity)
    own = components(first).toDF("kind", "grp")
    cells = shared.drop("lead").join(own, "kind", "left").withColumn("grp", F.coalesce("grp", "kind"))
    cells = whole = written(cells, "cells")
    discard(shared)
    mixed = cells.groupBy("key").agg(
        F.min("grp").alias("least"), F.max("grp").alias("most"), F.count("*").alias("n")
    )
    mixed = mixed.where("least < most").select("key", F.ceil(F.col("n") / CELLS_AT_ONCE).alias("parts"))
    cells = held = written(cells.join(mixed, "key"), "mixed")
    cells = cells.join(texts, "kind")
    # The kinds of a large block are dealt to parts, and each part meets all of the block.
    one = cells.withColumn("part", F.pmod(F.xxhash64("kind"), "parts"))
    one = one.select("key", "part", F.col("kind").alias("a"), "size", "sim", "grp", "line")
    other = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other.select(
        "key",
        "part",
        F.col("kind").alias("b"),
        F.col("size").alias("other_size"),
        F.col("sim").alias("other_sim"),
        F.col("grp").alias("far"),
        F.col("line").alias("other_line"),
    )
    # Hardly any of them are alike: they are verified where they meet and not written first.
    most = _most("size", "other_size", similarity)
    alike = F.expr(f"levenshtein(line, other_line, {most}) >= 0")
    meets = (one["key"] == other["key"]) & (one["part"] == other["part"]) & (F.col("grp") < F.col("far"))
    crossed = one.join(other.hint("merge"), meets & near & alike).select("a", "b").distinct()
    links = first.union(written(crossed, "links"))
    discard(held, texts)
    discard(whole)

    groups = components(links).toDF("kind", "grp")
    grouped = firsts.join(groups, "kind", "left")
    grouped = grouped.withColumn("grp", F.coalesce("grp", "kind"))
    winners = grouped.groupBy("grp").agg(F.min("first").alias("winner"))
    winners = written(grouped.join(winners, "grp").select("kind", "winner"), "winners")
    place = F.struct("doc", "row", "pos")
    gone = placed.join(winners, "kind").where(~place.eqNullSafe(F.col("winner")))
    gone = gone.select("doc", "row", "pos").distinct()
    return gone.groupBy("doc", "row").agg(F.array_sort(F.collect_list("pos")).alias("removed"))


def _marked(documents: DataFrame, options: dict) -> DataFrame:
    """Each document as `given` with the places of its lines that go, if any."""
    gone = written(repeats(documents, **options), "repeats").select("row", "removed")
    docs = documents.select(
        _row("doc_id", "text").alias("row"), F.struct(*map(quoted, documents.columns)).alias("given")
    )
    return docs.join(gone.hint("shuffle_hash"), "row", "left")


def _ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _left(removed: str = "removed") -> Column:
    lines = F.split("given.text", "\n")
    kept = F.filter(lines, lambda line, at: ~F.array_contains(F.col(removed), at))
    return F.when(F.col(removed).isNull(), F.col("given.text")).otherwise(F.array_join(kept, "\n"))


def summary(documents: DataFrame, **options) -> DataFrame:
    """doc_id, the number of lines, the places of the lines removed, and what is left."""
    found = _marked(documents.select("doc_id", "text"), options)
    return found.select(
        "given.doc_id",
        F.coalesce(F.size(F.split("given.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        _left().alias("text"),
    )


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """The documents without the removed lines, with their own columns (`n_chars` follows). A
    document that lost lines and keeps none but blank ones goes."""
    found = _marked(documents, options).withColumn("left", _left())
    filled = F.exists(F.split("left", "\n"), lambda line: normalised(line) != "")
    found = found.where(F.col("removed").isNull() | filled)
    columns = []
    for field in documents.schema.fields:
        column = F.col("given." + _ticked(field.name))
        if field.name == "text":
            column = F.col("left")
        elif field.name == "n_chars":
            size = F.char_length("left").cast(field.dataType)
            column = F.when(F.col("removed").isNull(), column).otherwise(size)
        columns.append(column.alias(field.name))
    return found.select(*columns)
