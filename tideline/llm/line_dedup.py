"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

Lines with the same set of tokens form a class. The tokens of a class are put in order of
length, the longest first, as long words are mostly rare, and what is posted are pairs of
neighbours in that order, from the first on: the prefix of which any similar class must
share one. Postings meet by such pairs under length, positional and bitmap filters; what
passes is verified by its Jaccard similarity. Any order that is the same for all lines
gives right results, and this one asks for no count of the tokens before.
Most pairs stand in one class only, so postings are first dealt by their pair with nothing
but their class and place, and only those that meet get what the filters need.
A line goes if an earlier one is similar to it. Where many classes share a pair each tries
the earliest of them before all others, so that a group of near copies makes no rows for
all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.storage import dropped, materialize

THRESHOLD = 0.8
#: Words of so many bytes or more count as equally long; lengths fit into 7 bits.
LONGEST = 63
#: Classes with a token of which each asks all earlier ones at once; if more have it, each asks the earliest one first.
FEW = 16
#: Parts of the tokens whose postings, and of the documents whose lines, are dealt one after the other.
PARTS = 2
#: Classes of so many words or more are also compared by parities of more places, as with so many the 128 places of postings hardly tell sets apart.
LONG = 192
_KEY = "__tideline_key"


def _split(text: Column, others: str = "\t\r\x0b\x0c") -> Column:
    """Parts between single spaces or other white space, empty ones too."""
    found = F.lit(False)
    for c in others:
        found = found | F.contains(text, F.lit(c))
    # Translating every character of a text is slow, and few texts need it.
    return F.split(F.when(found, F.translate(text, others, " " * len(others))).otherwise(text), " ")


def _hashed(line: Column) -> Column:
    """Hashes of the distinct words of a line, what stands between white space; empty ones, between two spaces, go by their hash."""
    return F.array_remove(F.array_distinct(F.transform(_split(line), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _code(word: Column) -> Column:
    """Codes sort by how long words are in bytes, the longest first; below that are 56 bits of the word's hash."""
    short = F.lit(LONGEST) - F.least(F.octet_length(word), F.lit(LONGEST))
    return F.shiftleft(short.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 8))


def _lines(documents: DataFrame, *others: str) -> DataFrame:
    """key, others, doc_id, line_no, line of each line."""
    # The key goes below the explosion: beside it, each line would hash the whole text.
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("key"), *others, F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return keyed.select("key", *others, "doc_id", F.posexplode("lines").alias("line_no", "line"))


def _needed(n: Column, m: Column) -> Column:
    """Tokens that similar sets of n and m share; rounded so that exact thresholds count."""
    return F.ceil((n + m) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")


def postings(documents: DataFrame) -> DataFrame:
    """key, row, doc_id, line_no, class, n (tokens), bits, more, prefix (its first tokens by code) of each line; n is 0 without tokens.

    The prefix keeps the lower 32 bits of codes. bits has for each of 64 places the parity of the
    tokens there, and more that of half of them, by another bit of their codes: together the
    parities of 128 places, which differ in no more places than two sets do in tokens.
    """
    codes = F.array_remove(F.array_distinct(F.transform(_split(F.col("line")), _code)), _code(F.lit("")))
    coded = _lines(documents.withColumn("row", F.monotonically_increasing_id()), "row").select("key", "row", "doc_id", "line_no", F.sort_array(codes).alias("codes"))
    n = F.size("codes")
    # Sets of fewer than 4 tokens are similar to equal sets only. Sets of THRESHOLD as many tokens ask for the longest prefix.
    length = F.when(n < 4, F.lit(0)).otherwise(F.floor(n * (2 - 2 * THRESHOLD) + 1e-9).cast("int") + 2)
    prefix = F.transform(F.slice("codes", F.lit(1), length), lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int"))
    return coded.select("key", "row", "doc_id", "line_no", F.xxhash64("codes", F.size("codes")).alias("class"), n.alias("n"), _parity(lambda c: F.lit(1).cast("long")).alias("bits"), _parity(lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1))).alias("more"), prefix.alias("prefix"))


def _parity(counted: Callable[[Column], Column]) -> Column:
    """For each of 64 places the parity of the tokens of codes there for which counted is 1, not 0."""
    return F.aggregate("codes", F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", counted(c), c.bitwiseAND(F.lit(63)).cast("int"))))


def _apart(n: Column, m: Column) -> Column:
    """Tokens at most that stand in only one of two similar sets of n and m."""
    return n + m - _needed(n, m) * 2


def _alike(n: Column, m: Column, x: list[Column], y: list[Column]) -> Column:
    """Whether sets of n and m tokens with these parities (bits and more) may be similar."""
    bits, more = (a.bitwiseXOR(b) for a, b in zip(x, y, strict=True))
    # Sums over all 128 places, as in the 64 of one number sets of 160 tokens differ no more than similar ones may.
    differ = F.bit_count(bits.bitwiseXOR(more)) + F.bit_count(more)
    return (m >= n * THRESHOLD - 1e-9) & (n >= m * THRESHOLD - 1e-9) & (differ <= _apart(n, m))


def ordered_classes(posted: DataFrame) -> DataFrame:
    """class, first (its first line), lines (how many), id of each class; ids grow in the order of first lines."""
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "line_no", "row")
    return materialize(posted.groupBy("class").agg(F.min(at).alias("first"), F.count("*").alias("lines")).orderBy(F.col("first.doc_id").asc_nulls_last(), "first.key", "first.line_no", "first.row").withColumn("id", F.monotonically_increasing_id()))


def with_prefixes(order: DataFrame, posted: DataFrame) -> DataFrame:
    """id, n, bits, more, prefix of each class: prefixes are dealt once, and neither sorted nor aggregated, as a row is the first line of its class or goes."""
    firsts = order.select("id", "class", "first.row", "first.line_no").hint("shuffle_hash")
    return materialize(posted.select("class", "row", "line_no", "n", "bits", "more", "prefix").join(firsts, ["class", "row", "line_no"]).select("id", "n", "bits", "more", "prefix"))


def numbered_classes(posted: DataFrame) -> DataFrame:
    """class, first, lines, id, n, bits, more, prefix of each class."""
    order = ordered_classes(posted)
    classes = with_prefixes(order, posted)
    out = materialize(order.join(classes, "id"))
    dropped(order, classes)
    return out


def _joint(x: str, y: str) -> Column:
    """Two numbers of 32 bits as one."""
    return F.shiftleft(F.col(x).cast("long"), 32).bitwiseOR(F.col(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _neighbours(classes: DataFrame) -> DataFrame:
    """id, place, token (each pair of neighbours in a prefix as one number)."""
    pairs = F.arrays_zip(F.slice("prefix", F.lit(1), F.size("prefix") - 1).alias("x"), F.slice("prefix", F.lit(2), F.size("prefix")).alias("y"))
    each = classes.filter(F.size("prefix") > 1).select("id", F.posexplode(pairs).alias("place", "pair"))
    return each.select("id", "place", _joint("pair.x", "pair.y").alias("token"))


def shared_neighbours(classes: DataFrame) -> DataFrame:
    """id, n, bits, more, place, token, before (what comes before the pair), a, few, second, third: the postings whose token another class has, too; a is the earliest class with it, few whether FEW at most have it.

    second and third come before that, and are there for tokens of many classes only, so that they take little space.
    """
    same = Window.partitionBy("token")
    each = _neighbours(classes)
    # All postings are dealt, a part of the tokens at a time, so that the shuffle files of one part lie on disk at once.
    parts = [each.filter(F.pmod("token", F.lit(PARTS)) == k).select("*", F.min("id").over(same).alias("a"), F.max("id").over(same).alias("z"), (F.count("*").over(same) <= FEW).alias("few")) for k in range(PARTS)]
    met = [materialize(part.filter("a < z").drop("z")) for part in parts]
    before = F.when(F.col("place") > 0, F.get("prefix", F.col("place") - 1)).alias("before")
    earlier = [F.when(~F.col("few") & (F.col("place") >= k), F.get("prefix", F.col("place") - k)).alias(name) for k, name in ((2, "second"), (3, "third"))]
    known = classes.select("id", "n", "bits", "more", "prefix").hint("shuffle_hash")
    out = materialize(reduce(DataFrame.union, met).join(known, "id").select("id", "n", "bits", "more", "place", "token", before, "a", "few", *earlier))
    dropped(*met)
    return out


def candidates(earlier: DataFrame, later: DataFrame, once: bool = False) -> DataFrame:
    """a, b: pairs of a class of earlier and one after it of later (rows of shared neighbours) that pass the prefix, length, positional and bitmap filters.

    Sets of n and m tokens are similar if they share some number o, so n + m - 2 * o = d are
    in one only. Of the o - 1 neighbours among the shared ones d at most have another token
    between them in one of the sets: o - 1 - d are neighbours in both, and one of those is
    among the first n - o + d + 1 of one set and the first m - o + d + 1 of the other. Of a
    run of neighbours that two sets share only the first makes a row; with once also none after
    one token that stands in one of the sets, or one in each, if the neighbours before that make
    a row, here or among the shared neighbours of FEW classes at most.
    """
    # All is renamed on both sides alike, as Spark deals the rows of a join with itself once only if both sides are made in the same way.
    a = earlier.select(F.col("id").alias("a"), F.col("n").alias("l"), F.col("bits").alias("x0"), F.col("more").alias("x1"), F.col("place").alias("i"), F.col("before").alias("u"), *([_joint("second", "before").alias("u2"), _joint("third", "second").alias("u3")] if once else []), "token")
    b = later.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y0"), F.col("more").alias("y1"), F.col("place").alias("j"), F.col("before").alias("v"), *([_joint("second", "before").alias("v2"), _joint("third", "second").alias("v3")] if once else []), "token")
    n, m, i, j = F.col("l"), F.col("m"), F.col("i"), F.col("j")
    o = _needed(n, m)
    d = _apart(n, m)
    spread = F.abs(i - j) + F.abs((n - i) - (m - j))
    near = (i <= n - o + d) & (j <= m - o + d) & (i - j <= n - o) & (j - i <= m - o) & (spread <= d)
    starts = ~F.coalesce(F.col("u") == F.col("v"), F.lit(False))
    if once:
        # Neighbours before a token of the set in which the place is later have no larger spread, others one of 2 more at most. Last, as few pairs come so far.
        roomy = spread + 2 <= d
        near = near & ~F.coalesce((F.col("u3") == F.col("v3")) | (((i > j) | roomy) & (F.col("u3") == F.col("v2"))) | (((i < j) | roomy) & (F.col("u2") == F.col("v3"))), F.lit(False))
    return a.join(b, (a["token"] == b["token"]) & (F.col("a") < F.col("b")) & starts & _alike(n, m, [F.col("x0"), F.col("x1")], [F.col("y0"), F.col("y1")]) & near).select("a", "b")


def _class_lines(ids: DataFrame, classes: DataFrame, documents: DataFrame) -> list[DataFrame]:
    """Tables of id, words (64-bit hashes of the distinct ones) of these classes, each class in one of them."""
    places = classes.select("id", "first.key", "first.line_no").join(ids, "id")
    wanted = materialize(places.groupBy("key").agg(F.collect_list(F.struct("id", "line_no")).alias("wanted")))
    parts = []
    for k in range(PARTS):
        # All documents are dealt, a part at a time, so that the shuffle files of one part lie on disk at once.
        here = documents.select(F.xxhash64("doc_id", "text").alias("key"), "text").filter(F.pmod("key", F.lit(PARTS)) == k)
        found = here.join(wanted.filter(F.pmod("key", F.lit(PARTS)) == k).hint("shuffle_hash"), "key")
        # Split before the lines are taken apart, once a document.
        lines = found.select("wanted", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
        each = lines.select(F.inline(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get("lines", w["line_no"]).alias("line")))))
        # Documents of one key are copies of one another.
        parts.append(materialize(each.select("id", _hashed(F.col("line")).alias("words")).dropDuplicates(["id"])))
    dropped(wanted)
    return parts


def _parities(words: Column) -> Column:
    """Parities of words by their hashes, at 64 places in each number; of numbers there is a power of 2, one for 32 to 63 words."""
    numbers = F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.size(words))) - 6)
    place = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    here = lambda h, i: F.shiftright(h, 6).bitwiseAND(numbers - 1) == i
    return F.transform(F.sequence(F.lit(0), numbers - 1), lambda i: F.aggregate(words, F.lit(0).cast("long"), lambda acc, h: F.when(here(h, i), acc.bitwiseXOR(place(h))).otherwise(acc)))


def _differ(x: Column, y: Column) -> Column:
    """Places at which parities differ; the longer one is folded to the numbers of the other, which has half as many at least."""
    k = F.least(F.size(x), F.size(y))
    folded = lambda p: F.when(F.size(p) > k, F.zip_with(F.slice(p, F.lit(1), k), F.slice(p, k + 1, k), lambda s, t: s.bitwiseXOR(t))).otherwise(p)
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda acc, c: acc + c)


def likely(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b: the pairs without those of two classes of LONG words or more whose parities or numbers of words (of id, words) rule similarity out.

    Pairs of long lines that share a frequent pair of neighbours grow with the square of the
    input, so their words are not dealt to each of them.
    """
    long = lines.filter(F.size("words") >= LONG).select("id", F.size("words").alias("n"), _parities(F.col("words")).alias("parities"))
    a, b = long.toDF("a", "n", "x").hint("shuffle_hash"), long.toDF("b", "m", "y").hint("shuffle_hash")
    n, m = F.col("n"), F.col("m")
    near = (m >= n * THRESHOLD - 1e-9) & (n >= m * THRESHOLD - 1e-9)
    # Sizes within THRESHOLD of each other make numbers of which one is the other or half of it.
    may = F.when(n.isNull() | m.isNull(), True).when(~near, False).otherwise(_differ(F.col("x"), F.col("y")) <= _apart(n, m))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(may).select("a", "b")


def _similar(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """id: the b of those pairs whose lines are similar."""
    pairs = materialize(pairs)
    # A class may be in many pairs.
    ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct()
    parts = _class_lines(ids, classes, documents)
    lines = reduce(DataFrame.union, parts)
    # Hashed, as words are long to sort; what is held in memory is each class once, however many pairs it is in.
    both = likely(pairs, lines).join(lines.toDF("b", "y").hint("shuffle_hash"), "b").join(lines.toDF("a", "x").hint("shuffle_hash"), "a")
    near = both.select("b", F.size(F.array_intersect("x", "y")).alias("o"), F.size("x").alias("n"), F.size("y").alias("m")).filter(F.col("o") >= (F.col("n") + F.col("m") - F.col("o")) * THRESHOLD - 1e-9)
    out = materialize(near.select(F.col("b").alias("id")).distinct())
    dropped(pairs, *parts)
    return out


def removed_lines(documents: DataFrame) -> DataFrame:
    """key, lines (numbers, from 0) to remove of each document that has any.

    A class goes with one similar class before it, so most of a group of near copies go by
    a look at the earliest class with a token of theirs, and only what is left asks all
    earlier classes with the tokens of more than FEW.
    """
    posted = materialize(postings(documents))
    words = posted.filter("n > 0")
    order = ordered_classes(words)
    classes = with_prefixes(order, words)
    # Prefixes are most of what these tables hold, and go as soon as they have been dealt.
    lines = materialize(words.select("key", "line_no", "class"))
    dropped(posted)
    shared = shared_neighbours(classes)
    dropped(classes)
    few, many = shared.filter("few"), shared.filter("NOT few")
    # The earliest class with a token is a likely original of a group of near copies.
    first = _similar(candidates(few, few).union(candidates(many.filter("id = a"), many)).distinct(), order, documents)
    rest = _similar(candidates(many, many.join(first, "id", "left_anti"), once=True).distinct(), order, documents)
    dropped(shared)
    gone = first.union(rest).withColumn("gone", F.lit(True))
    info = order.join(gone, "id", "left").filter("gone OR lines > 1").select("class", F.col("first.key").alias("k"), F.col("first.line_no").alias("l"), F.coalesce("gone", F.lit(False)).alias("gone"))
    found = lines.join(info, "class").filter("gone OR key <> k OR line_no <> l")
    out = materialize(found.groupBy("key").agg(F.collect_set("line_no").alias("lines")))
    dropped(lines, order, first, rest)
    return out


def _without(documents: DataFrame, lines: str) -> DataFrame:
    """The documents, with text without the lines of that column (null: none), which goes."""
    parts = documents.withColumn("__tideline_parts", F.when(F.col(lines).isNotNull(), F.split("text", "\n")))
    # array_except works by a hash set, however many lines there are.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__tideline_parts") - 1), lines)
    text = F.array_join(F.transform(kept, lambda i: F.get("__tideline_parts", i)), "\n")
    return parts.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(text)).drop("__tideline_parts", lines)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, their text without the lines that an earlier line is similar to; n_chars, where it is there, anew.

    Lines end at \\n; their tokens are the words between white space. A line goes if a line
    before it, in this or another document, has a Jaccard similarity of THRESHOLD or more
    with it, that line itself removed or not. Documents come in order of doc_id (null last),
    then of a hash. Lines without tokens stay. All rows stay, with an empty text if all lines
    went, and null where text was null. Of rows that are equal in doc_id and text all lose
    what the earlier lines of others take from one; they count as one document.
    """
    keyed = documents.withColumn(_KEY, F.xxhash64("doc_id", "text"))
    out = keyed.join(removed_lines(documents).toDF(_KEY, "__tideline_lines").hint("shuffle_hash"), _KEY, "left")
    changed = F.col("__tideline_lines").isNotNull()
    out = _without(out.withColumn("__tideline_changed", changed), "__tideline_lines")
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tideline_changed"), F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is kept) of every document; see deduplicated."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    found = docs.join(removed_lines(docs).hint("shuffle_hash"), "key", "left")
    counted = found.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), "lines")
    return _without(counted, "lines").select("doc_id", "n_lines", "n_removed", "text")
