"""Fuzzy line dedup with DataFrame operations only.

Lines are normalised to their lower-cased words. Lines meet on keys, each made of a
few minima of salted hashes of their parts: their longer words, all words where few
are long, runs of three characters where a line has few words. Of those that meet, a
SimHash of the words rules out what is far apart, and the edit similarity decides.
Linked lines form connected groups, and of every group one occurrence, the first by
(doc_id, line), is kept.

Minima stand in for pigeonhole blocks of the SimHash: one replaced word turns some
8 to 13 of 64 bits of a line of 5 to 12 words, while lines without relation are 32
apart, so no choice of blocks both finds the former and spares the latter.
"""

from __future__ import annotations

import math
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.meeting import components_of, meetings
from quotemill.llm.scratch import discard, materialize

#: What stands between words: ASCII characters other than letters and digits, each by itself, which the pattern looks up in a table where it would try ranges in turn.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
SIMILARITY = 0.8
#: Bits of 64 that the SimHash of lines differs in that are compared first. Lines that share two thirds of their words differ in 13 to 17 on average, with a deviation of 3.
RADIUS = 25
#: Words of so many letters are long; runs have so many characters.
LETTERS, RUN = 4, 3
#: Lines of fewer words have no SimHash.
FEW_WORDS = 5
_MINIMA = 24
_SALTS = [Random(i).getrandbits(64) - (1 << 63) for i in range(_MINIMA)]
#: Bits by which a hash is turned before it is salted: salts alone leave the order of hashes to the same few leading bits.
_TURNS = [(8 * i + 3 * (i // 8)) % 64 for i in range(_MINIMA)]
#: Minima in a key and rounds of keys over all minima: for few long words, for many, for all words of a line, for runs. Lines with a number of long words between have the first two, so that like lines have one kind in common.
_KEYS = ((4, 3), (6, 3), (4, 4), (4, 4))
_FEW_UNTIL, _MANY_FROM = 11, 9
_LANES = 32  # each sum counts two bits, 32 bits wide
_MASK = 0x0000000100000001
_BITMAP, _CELL = 1 << 23, 1 << 15


def normalised(line: Column) -> Column:
    """The words of a line, lower-cased, a space between each two."""
    return F.trim(F.regexp_replace(F.lower(line), BETWEEN, " "))


def with_parts(lines: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of lines, and kind and parts: a line between two kinds of parts has a row for both."""
    # a generator hands its values on as columns, so they are computed once for a line
    words = lines.select(*keep, "norm", F.explode(F.array(F.array_distinct(F.split("norm", " ")))).alias("words"))
    long = words.select(*keep, "norm", "words", F.explode(F.array(F.filter("words", lambda w: F.length(w) >= LETTERS))).alias("long"))
    runs = F.regexp_extract_all(F.concat(F.lit("  "), F.col("norm"), F.lit("  ")), F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1))
    few = F.size("long") <= 8
    kinds = [(F.col("long"), F.size("long") >= 6), (F.col("words"), few & (F.size("words") >= 4)), (runs, few & (F.size("words") <= 4))]
    rows = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(i).alias("kind"), parts.alias("parts"))) for i, (parts, has) in enumerate(kinds)]))
    return long.select(*keep, F.inline(rows))


def simhash_of(sums: list[Column], n: Column) -> Column:
    """64-bit majority from packed counts; a bit is 1 if set in over half."""
    over = lambda count, k: F.shiftleft(F.shiftrightunsigned(n - count * 2, 63), k)  # noqa: E731  the sign of what is missing
    bits = [over(part, at) for k, s in enumerate(sums) for part, at in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftright(s, 32), k + 32))]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, which tells rows of one id apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def normalised_lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, row, line_no (from 0), norm, and its key of 128 bits (lid, lid2)."""
    lines = _identified(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    norms = lines.select("doc_id", "row", "line_no", F.explode(F.array(normalised(F.col("line")))).alias("norm")).where("norm <> ''")
    return norms.withColumn("lid", F.xxhash64("norm")).withColumn("lid2", F.xxhash64(F.lit(7), "norm"))


def meeting_keys(minima: list[Column], kind: Column, n: Column, length: Column) -> Column:
    """Keys on which lines of ``length`` characters with ``n`` parts of a kind meet; every round deals the minima anew.

    Keys of short lines hold a step of a scale of sizes as well, and each line has its
    own and the next one: like lines are a step apart at most.
    """
    families = []
    for size, rounds in _KEYS:
        keys = []
        for k in range(rounds):
            order = Random(f"{size} {k}").sample(range(_MINIMA), _MINIMA)
            for at in range(0, _MINIMA - size + 1, size):
                keys.append(F.xxhash64(F.lit(f"{size} {k} {at}"), kind, *[minima[i] for i in order[at : at + size]]))
        families.append(F.array(*keys))
    few, many, words, runs = families
    step = F.floor(F.log(length) / -math.log(SIMILARITY) + 1e-9)
    sized = lambda keys: F.concat(*[F.transform(keys, lambda x, i=i: F.xxhash64(x, step + i)) for i in (0, 1)])
    return F.when(kind == 1, sized(words)).when(kind == 2, sized(runs)).when(n < _MANY_FROM, few).when(n > _FEW_UNTIL, many).otherwise(F.concat(few, many))


def _turned(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def distinct_lines(seen: DataFrame) -> DataFrame:
    """Of normalised lines every distinct line, for each kind of its parts: lid, lid2, its first place (doc_id, line_no, row), times, meeting keys.

    Texts are shuffled once, by key; a line's parts are then summed up where it is.
    """
    place = F.min(F.struct("doc_id", "line_no", "row")).alias("first")
    lines = seen.groupBy("lid", "lid2").agg(place, F.count("*").alias("times"), F.first("norm").alias("norm"))
    own = ["lid", "lid2", "doc_id", "line_no", "row", "times", "size"]
    kinds = with_parts(lines.select("lid", "lid2", "first.*", "times", F.length("norm").alias("size"), "norm"), own)
    hashed = kinds.select(*own, "kind", F.explode("parts").alias("part")).select(*own, "kind", F.xxhash64("part").alias("h"))
    minima = [F.min(_turned(F.col("h"), _TURNS[i]).bitwiseXOR(F.lit(x))).alias(f"m{i}") for i, x in enumerate(_SALTS)]
    counted = hashed.groupBy(*own, "kind").agg(F.count("*").alias("n"), *minima)
    return counted.select(*own, meeting_keys([F.col(f"m{i}") for i in range(_MINIMA)], F.col("kind"), F.col("n"), F.col("size")).alias("keys"))


def with_simhash(texts: DataFrame) -> DataFrame:
    """``node`` and ``norm`` of each line with ``sig``, the SimHash of its words, of which long ones count twice; none for lines of few words."""
    words = texts.select("node", F.explode(F.split("norm", " ")).alias("word"))
    hashed = words.select("node", F.xxhash64("word").alias("h"), F.when(F.length("word") >= LETTERS, 2).otherwise(1).cast("long").alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_MASK)) * F.col("w")).alias(f"s{k}") for k in range(_LANES)]
    counted = hashed.groupBy("node").agg(F.count("*").alias("words"), F.sum("w").alias("n"), *sums).where(F.col("words") >= FEW_WORDS)
    return texts.join(counted.select("node", simhash_of([F.col(f"s{k}") for k in range(_LANES)], F.col("n")).alias("sig")), "node", "left")


def flagged(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with a column ``flag``: false only for rows whose ``column`` is certainly not among those of ``ids``.

    The ids are hashed into a bitmap of 1 MB, broadcast as its cells, whatever their number.
    """
    place = F.pmod(F.xxhash64(column), F.lit(_BITMAP))
    bitmaps = ids.select(place.alias("at")).groupBy(F.expr(f"cast(at div {_CELL} as int)").alias("cell")).agg(F.bitmap_construct_agg(F.col("at") % _CELL).alias("bitmap"))
    placed = df.withColumn("at", place).withColumn("cell", F.expr(f"cast(at div {_CELL} as int)"))
    byte = F.conv(F.hex(F.substr(F.col("bitmap"), F.expr(f"cast(at % {_CELL} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, cast(at % 8 as int)) & 1")
    joined = placed.join(F.broadcast(bitmaps), "cell", "left").withColumn("byte", byte)
    return joined.withColumn("flag", F.coalesce(bit == 1, F.lit(False))).drop("cell", "at", "bitmap", "byte")


def _letter(word: Column) -> Column:
    """One of some 55,000 characters, in hexadecimal UTF-16, for a word."""
    return F.lpad(F.hex(F.pmod(F.xxhash64(word), F.lit(0xD700 - 0x0100)) + 0x0100), 4, "0")


def spelt_by_words(norm: Column) -> Column:
    """A text of one character for each word."""
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), _letter), "")), "UTF-16BE")


def longest_word(norm: Column) -> Column:
    return F.array_max(F.transform(F.split(norm, " "), lambda w: F.length(w)))


def _allowed(m: Column, n: Column) -> Column:
    """Edits that leave lines of so many characters alike."""
    return F.floor(F.greatest(m, n) * (1 - SIMILARITY) + 1e-9).cast("int")


def _linked(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those of like lines. ``lines``: node, norm, spelt, longest.

    Word by word first: each of k edited words takes as many character edits as the
    longest word has letters, and one for its space, at most; few of them settle a
    pair. What is left is compared by characters, whatever its length.
    """
    x = lines.select(F.col("node").alias("a"), F.col("spelt").alias("va"), F.col("longest").alias("la"), F.col("norm").alias("x"))
    y = lines.select(F.col("node").alias("b"), F.col("spelt").alias("vb"), F.col("longest").alias("lb"), F.col("norm").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumns({"m": F.length("x"), "n": F.length("y")})
    both = both.withColumn("allowed", _allowed(F.col("m"), F.col("n"))).where(F.abs(F.col("m") - F.col("n")) <= F.col("allowed"))
    both = both.withColumn("sure", F.floor(F.col("allowed") / (F.greatest("la", "lb") + 1)).cast("int"))
    return both.where("levenshtein(va, vb, sure) >= 0 or levenshtein(x, y, allowed) >= 0").select("a", "b")


def _sized(a: str, b: str) -> Column:
    """Whether the lengths leave room for a link."""
    m, n = F.col(f"{a}.size"), F.col(f"{b}.size")
    return F.abs(m - n) <= _allowed(m, n)


def _near(a: str, b: str) -> Column:
    return F.coalesce(F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= RADIUS, F.lit(True))


_PASSES = (lambda a, b: _sized(a, b) & _near(a, b), lambda a, b: _sized(a, b) & ~_near(a, b))


def line_components(seen: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, component) over lids of all lines that are linked to others."""
    marks = lines.select(F.explode("keys").alias("key"), F.col("lid").alias("node"))
    met = meetings(marks, "line-met")
    wanted = met.select(F.col("node").alias("lid")).distinct()
    texts = flagged(seen.select("lid", "norm"), wanted, "lid").where("flag").join(wanted, "lid", "left_semi")
    texts = materialize(texts.select(F.col("lid").alias("node"), "norm").dropDuplicates(["node"]), "line-norms")
    norms = texts
    texts = with_simhash(norms).select("node", "sig", "norm", spelt_by_words(F.col("norm")).alias("spelt"), longest_word(F.col("norm")).alias("longest"))
    texts = materialize(texts, "line-texts")
    discard(norms)
    sigs = texts.select("node", F.struct(F.col("sig").alias("bits"), F.length("norm").alias("size")).alias("sig"))
    found = components_of(met, lambda pairs: _linked(pairs, texts), "line", sigs, _PASSES)
    discard(met, texts)
    return found


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, gone: the numbers of the lines whose group is kept elsewhere."""
    seen = materialize(normalised_lines(docs.where("doc_id is not null").select("doc_id", "text")), "line-seen")
    lines = materialize(distinct_lines(seen), "line-distinct")
    classes = line_components(seen, lines)
    joined = lines.select("lid", "lid2", F.struct("doc_id", "line_no", "row").alias("first"), "times").join(classes, F.col("lid") == F.col("node"), "left").where("times > 1 or component is not null")
    joined = materialize(joined.select("lid", "lid2", "first", "component").distinct(), "line-classes")
    discard(lines, classes)
    least = joined.where("component is not null").groupBy("component").agg(F.min("first").alias("group"))
    grouped = joined.where("component is null").select("lid", "lid2", F.col("first").alias("group")).unionAll(joined.join(least, "component").select("lid", "lid2", "group"))
    grouped = materialize(grouped.select("lid", "lid2", "group.*").withColumnsRenamed({"doc_id": "group_doc", "line_no": "group_line", "row": "group_row"}), "line-groups")
    some = flagged(seen.select("doc_id", "row", "line_no", "lid", "lid2"), grouped, "lid").where("flag")
    placed = some.join(grouped, ["lid", "lid2"])
    gone = placed.where("doc_id <> group_doc or line_no <> group_line or row <> group_row").groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    gone = materialize(gone, "line-gone")
    discard(joined, grouped, seen)
    return gone


def dedup_lines(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_removed, and the columns ``extra`` as they are.

    Every document without the lines whose group is kept elsewhere. Lines without a
    word stay. Null text: null, no lines. Rows without an id take part in no group and
    stay whole. Rows that share an id and differ in text are documents of their own;
    rows that share both lose the same lines. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    gone = removed_lines(docs)
    carried = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None)
    marked = flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried.alias("extra")), gone, "doc_id")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    out = ["doc_id", "text", "n_lines", "n_removed", "extra"]
    plain = marked.where("not flag").withColumns({"n_lines": lines, "n_removed": F.lit(0)}).select(*out)
    hit = marked.where("flag").withColumn("row", F.xxhash64("text")).join(gone, ["doc_id", "row"], "left").withColumn("n_lines", lines)
    # the generator splits a text once, not once for each line
    hit = hit.select("doc_id", "text", "n_lines", "extra", "gone", F.explode(F.array(F.split("text", "\n"))).alias("parts"))
    kept = F.array_except(F.sequence(F.lit(1), F.col("n_lines")), F.transform("gone", lambda i: i + 1))
    text = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("parts", i)), "\n"))
    hit = hit.withColumns({"n_removed": F.coalesce(F.array_size("gone"), F.lit(0)), "text": text}).select(*out)
    return plain.unionAll(hit).select("doc_id", "text", "n_lines", "n_removed", *[F.col(f"extra.{c}") for c in extra])
