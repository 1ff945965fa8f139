"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histograms of character classes and of its language's commonest words
are compared with references for that language by Jensen-Shannon distance. The
references are the pooled histograms of all documents of a language that are long
enough, so no row is sampled. Histograms of short texts are noisy: texts below a
minimum length are not compared, and for others the noise expected of a sample of
that size is added to the bound.

All counts of a document are made inside its row; only counts of words by language
are shuffled, combined before. The texts are read twice, for the references and for
the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.scratch import materialize

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = "\t\n\x0b\x0c\r"

#: Patterns taken off one after the other; ``CLASSES`` are what they take, by name.
_LOWER_AND_SPACE = r"[a-z\x20\x09-\x0D]+"
_REST = (("lower_other", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("symbol", r"[#*$%&|<>]+"), ("stop", r"[.,;:!?'\"()-]+"))
CLASSES = ("space", "lower", *(name for name, _ in _REST), "other")
COMMON = 32
_CODES = "_ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # the first stands for all other words
_SALT = 64

#: Bounds on the divergence (bits); ``NOISE`` bits over the number of words are allowed on top.
MAX_CLASSES = 0.05
MAX_WORDS = 0.18
NOISE = 8.0
#: A language with fewer words than this has no reference.
MIN_REFERENCE_WORDS = 2000


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, \\t, \\n, \\v, \\f and \\r; null: none."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACE:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def lowered(words: Column) -> Column:
    """The words in lower case; they hold no space, which ends a word for a final sigma too."""
    return F.split(F.lower(F.array_join(words, " ")), " ")


def word_codes(words: Column) -> Column:
    """For each lower-cased word its code among those of ``references``."""

    def code(w: Column) -> Column:
        size = F.octet_length(w)
        return F.coalesce(F.get(F.get("ref_codes", size), F.array_position(F.get("ref_sized", size), w).cast("int")), F.lit(_CODES[0]))

    return F.transform(words, code)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (base 2, 0 to 1) of two arrays of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda c: c / total)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words``, ``n_words``, ``word_chars`` and a column ``n_<class>`` for each class."""
    df = docs.withColumn("words", words_of(F.col("text")))
    df = df.select("*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"))
    df = df.select("*", (F.length(F.coalesce("text", F.lit(""))) - F.col("word_chars")).cast("long").alias("n_space"), F.regexp_replace(F.coalesce("text", F.lit("")), _LOWER_AND_SPACE, "").alias("rest"))
    df = df.withColumn("n_lower", (F.col("word_chars") - F.length("rest")).cast("long"))
    for name, pattern in _REST:
        df = df.withColumn("less", F.regexp_replace("rest", pattern, ""))
        df = df.withColumn(f"n_{name}", (F.length("rest") - F.length("less")).cast("long")).drop("rest").withColumnRenamed("less", "rest")
    return df.withColumn("n_other", F.length("rest").cast("long")).drop("rest")


def repeated_words(df: DataFrame) -> DataFrame:
    """``df`` with ``n_repeat_words``: words in 3-word windows that its ``words`` hold twice or more.

    Windows are told apart by 64-bit hashes and sorted with their places only in
    rows that hold some hash twice.
    """
    inner = F.greatest(F.size("words") - 2, F.lit(0))
    df = df.withColumn("keys", F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, inner))
    repeated = F.size(F.array_distinct("keys")) < F.size("keys")
    df = df.withColumn("sorted", F.when(repeated, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    hashes, m = F.col("sorted.k"), F.size("sorted")
    df = df.withColumn("same", F.zip_with(F.slice(hashes, 1, m - 1), F.slice(hashes, 2, m - 1), lambda a, b: a == b))
    no = F.array(F.lit(False))
    marked = F.arrays_zip(F.col("sorted.i").alias("i"), F.concat("same", no).alias("next"), F.concat(no, "same").alias("last"))
    df = df.withColumn("at", F.sort_array(F.filter(marked, lambda x: x["next"] | x["last"])["i"]))
    steps = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    cover = F.aggregate(steps, F.lit(3), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), cover).otherwise(0).cast("long")).drop("keys", "sorted", "same", "at")


def references(docs: DataFrame, *, common: int = COMMON) -> DataFrame:
    """One row per language: shares of classes, commonest words (also by size, with codes), shares of all other words and of these.

    Documents below the minimum length and rows without a language are left out;
    copies count as often as they occur. Ties between words go to the lesser one.
    A language of fewer than ``MIN_REFERENCE_WORDS`` words has no row.
    """
    df = _counted(docs.where("lang is not null and text is not null").select("lang", "text"))
    # words hold no space: names that begin with one carry the counts of classes through the same aggregate
    names = F.array(*[F.lit(f" {i}") for i in range(len(CLASSES))])
    rows = df.select("lang", "n_words", *[f"n_{c}" for c in CLASSES], F.explode(F.concat("words", names)).alias("w")).where(F.col("n_words") >= MIN_WORDS)
    n = F.lit(1).cast("long")
    for i, c in enumerate(CLASSES):
        n = F.when(F.col("w") == f" {i}", F.col(f"n_{c}")).otherwise(n)
    counts = materialize(rows.groupBy("lang", F.lower("w").alias("w")).agg(F.sum(n).alias("n")), "rule-words")
    is_class = F.col("w").startswith(" ")
    classes = counts.groupBy("lang").agg(
        F.sum(F.when(~is_class, F.col("n"))).alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("w") == f" {i}", F.col("n"))), F.lit(0)) for i in range(len(CLASSES))]).alias("classes"),
    ).where(F.col("total") >= MIN_REFERENCE_WORDS)
    order = [F.desc("n"), F.asc("w")]
    part = counts.where(~is_class).withColumn("salt", F.pmod(F.hash("w"), F.lit(_SALT)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= common)
    top = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    inside = F.aggregate(F.col("top.n"), F.lit(0).cast("long"), lambda s, x: s + x)
    # words by their length in bytes, so that a word is compared with those of its own only
    size = lambda w: F.octet_length(w)
    coded = F.transform("top.w", lambda w, i: F.struct(w.alias("w"), F.substr(F.lit(_CODES), i + 2, F.lit(1)).alias("code")))
    by_size = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("top.w", size))), lambda n: F.filter("coded", lambda x: size(x["w"]) == n))
    found = classes.join(top, "lang").withColumn("coded", coded).withColumn("by_size", by_size)
    return found.select(
        F.col("lang").alias("ref_lang"),
        shares(F.col("classes")).alias("ref_classes"),
        F.col("top.w").alias("ref_words"),
        F.transform("by_size", lambda x: x["w"]).alias("ref_sized"),
        F.transform("by_size", lambda x: F.concat(F.array(F.lit(_CODES[0])), x["code"])).alias("ref_codes"),
        shares(F.concat(F.array(F.col("total") - inside), F.col("top.n"))).alias("ref_shares"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: id, counts of the base rules, both divergences and the verdict ``kept``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_divergence, word_divergence, kept. Divergences are null, and
    the base rules decide alone, where the text is too short, the language is null or
    has no reference. Null and empty texts have no words and fail. Repeated rows are
    judged each; an empty table gives an empty result; columns other than doc_id,
    text and lang are ignored. The references are a row per language with words
    enough, written before they are joined, so that Spark knows their size and
    broadcasts them by it. The verdicts are written too: a filter on them must not
    be pushed below the expressions that make them.
    """
    docs = docs.select("doc_id", "text", "lang")
    known = materialize(references(docs), "rule-references")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.rtrim(F.ltrim(line, F.lit(" " + SPACE)), F.lit(" " + SPACE)) != "")
    df = _counted(docs.join(known, F.col("lang") == F.col("ref_lang"), "left")).withColumn("lines", lines)
    df = repeated_words(df.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("text", "lines"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    compared = ~F.col("base_failed") & F.col("ref_lang").isNotNull()
    df = df.withColumn("codes", F.when(compared, F.array_join(word_codes(lowered(F.col("words"))), "")))
    counts = F.array(*[(F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit("")))).cast("long") for c in _CODES[: COMMON + 1]])
    df = df.withColumn("counts", F.when(compared, F.slice(counts, F.lit(1), F.size("ref_words") + 1)))
    df = df.withColumn("class_divergence", F.when(compared, divergence(shares(F.array(*[F.col(f"n_{c}") for c in CLASSES])), F.col("ref_classes"))))
    df = df.withColumn("word_divergence", F.when(compared, divergence(shares(F.col("counts")), F.col("ref_shares"))))
    slack = NOISE / F.greatest("n_words", F.lit(1))
    far = (F.col("class_divergence") > MAX_CLASSES + slack) | (F.col("word_divergence") > MAX_WORDS + slack)
    verdicts = df.select(
        "doc_id", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )
    return materialize(verdicts, "rule-verdicts")
