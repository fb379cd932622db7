"""Quality rules by distribution divergence.

Every document gets the base measures (words, symbols, repeated lines and
repeated 8-word windows). Beyond these, its character-class histogram and its
common-word histogram are held against references of its language with the
Jensen-Shannon distance. The references are sums over all documents, so they
follow the corpus; a document with fewer words than the guard, or of a language
with too few words for a reference, is not judged by divergence.

Everything is a DataFrame expression. The texts are scanned three times: to
count words by language (summed before they are sent), to sum the character
classes by language, and to measure and judge each document. The references of
the words are those counts. No text is shuffled or stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, maybe_broadcast, packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Character classes told apart in what is left without lower-case ASCII letters and white space.
CLASSES = (("upper", r"[^A-Z]+"), ("digit", r"[^0-9]+"), ("stop", r"[^.,;:'\x22()?-]+"), ("mark", r"[^!#*$%&|<>@_~^=+\x5C/\x5B\x5D{}\x60]+"))
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
COMMON_WORDS = 30
GUARD_WORDS = 40
GUARD_REFERENCE_WORDS = 2000
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of 8 words: hashes of two, four and eight neighbours, each from the level before."""

    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.xxhash64(x, y)))

    eight = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return F.slice(eight, F.lit(1), F.size(words) - WINDOW + 1)


def repeated_words(words: Column) -> Column:
    """Words that stand in an 8-word window found twice or more in the text.

    Windows are compared by 64-bit hashes of their words. Texts without a
    repeated window stop after one pass with a hash set; the others sort their
    (hash, place) pairs, and the union of the repeated windows is summed from
    the gaps of their starts.
    """
    none = F.lit(0).cast("long")

    def covered(pairs: Column) -> Column:
        same = lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])
        starts = F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(same(p, i), F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)))), lambda p: p["i"]))
        gap = lambda s: F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW))))
        return let(starts, lambda s: F.aggregate(gap(s), none, lambda a, x: a + x.cast("long")))

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(pairs, covered))

    return F.when(F.size(words) <= WINDOW, none).otherwise(let(window_hashes(words), counted))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def word_counts(text: Column, pattern: Column, common: Column) -> Column:
    """How often each common word stands in a text (any case)."""
    hits = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), pattern, F.lit(0)), "  "), F.lit(" "))
    each = lambda h, w: (F.length(h) - F.length(F.replace(h, w, F.lit("")))) / F.length(w)
    return let(hits, lambda h: F.transform(common, lambda w: each(h, F.concat(F.lit(" "), w, F.lit(" ")))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, so 0 to 1) of two count arrays; null if either is null or sums to 0."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def measured(s: Column) -> Column:
        terms = F.zip_with(s["p"], s["q"], lambda x, y: part(x / s["tp"], y / s["tq"]) + part(y / s["tq"], x / s["tp"]))
        return F.when((s["tp"] > 0) & (s["tq"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))

    both = lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"), total(s["p"]).alias("tp"), total(s["q"]).alias("tq"))
    return let(F.struct(p.alias("p"), q.alias("q")), lambda s: let(both(s), measured))


def common_words(documents: DataFrame, size: int = COMMON_WORDS) -> DataFrame:
    """(ref_lang, ref_common, ref_pattern, ref_words): each language's most frequent words over all documents, ties by the word; their counts."""
    words = documents.select("lang", F.explode(words_of(F.lower("text"))).alias("word"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    quoted = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (
        words.groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= size)
        .groupBy(F.col("lang").alias("ref_lang"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
        .select("ref_lang", F.col("top.word").alias("ref_common"), F.transform("top.n", lambda n: n.cast("double")).alias("ref_words"))
        .withColumn("ref_pattern", F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(F.transform("ref_common", quoted), "|"), F.lit(r")(?![^\x20\x09-\x0D])")))
    )


def class_counts(text: Column, words: Column, body) -> Column:
    """``body`` of the text without lower-case letters and white space, the words' characters, and the character-class counts."""

    def filled(x: Column) -> Column:
        classes = [F.length(F.regexp_replace(x["odd"], pattern, "")).cast("double") for _, pattern in CLASSES]
        spaces, lower = (F.length(text) - x["chars"]).cast("double"), (F.length(text) - F.length(x["odd"])).cast("double")
        counts = F.array(*classes, spaces, lower - spaces, F.length(x["odd"]).cast("double"))
        # the last is what no class holds: other letters and signs
        rest = lambda c: F.concat(F.slice(c, 1, len(CLASSES) + 2), F.array(c[len(CLASSES) + 2] - total(F.slice(c, 1, len(CLASSES)))))
        return body(x, let(counts, rest))

    return let(F.struct(F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "").alias("odd"), F.length(F.array_join(words, "")).cast("long").alias("chars")), filled)


def measured(documents: DataFrame, reference: DataFrame, body=lambda rules: rules) -> DataFrame:
    """``documents`` with ``body`` of the base measures and both histograms, in ``rules``, and the references of their language."""
    joined = documents.join(reference, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))

    def measures(words: Column) -> Column:
        def filled(x: Column, classes: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                x["chars"].alias("word_chars"),
                F.length(F.regexp_replace(x["odd"], SYMBOLS, "")).cast("long").alias("n_symbols"),
                duplicate_lines(text).alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                classes.alias("classes"),
                let(word_counts(text, F.col("ref_pattern"), F.col("ref_common")), lambda c: F.concat(c, F.array(F.size(words) - total(c)))).alias("words"),
            )

        return class_counts(text, words, filled)

    # one expression: a filter on ``rules`` is pushed down with a copy of all that stands below for each use of a column
    return joined.withColumn("rules", let(let(words_of(text), measures), body)).drop("ref_lang", "ref_common", "ref_pattern")


def references(documents: DataFrame, common: DataFrame) -> DataFrame:
    """``common`` with ref_total, ref_classes and all of ref_words: the summed histograms of each language.

    The counts of the common words are known; what is left of a language's
    words is the last of ref_words.
    """
    n, text = len(CLASSES) + 3, F.coalesce(F.col("text"), F.lit(""))
    each = let(words_of(text), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), class_counts(text, words, lambda x, c: c).alias("classes")))
    summed = (
        documents.select(F.col("lang").alias("sum_lang"), each.alias("each"))
        .groupBy("sum_lang")
        .agg(F.sum("each.n_words").alias("ref_total"), *[F.sum(F.col("each.classes")[i]).alias(f"c{i}") for i in range(n)])
        .select("sum_lang", "ref_total", F.array(*[f"c{i}" for i in range(n)]).alias("ref_classes"))
    )
    words = F.concat("ref_words", F.array(F.col("ref_total") - total(F.col("ref_words"))))
    return common.join(summed, F.col("ref_lang").eqNullSafe(F.col("sum_lang"))).drop("sum_lang").withColumn("ref_words", words)


def quality_rules(
    documents: DataFrame,
    guard_words: int = GUARD_WORDS,
    guard_reference: int = GUARD_REFERENCE_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    common: int = COMMON_WORDS,
) -> DataFrame:
    """All columns of ``documents`` and the struct ``rules``.

    ``rules`` holds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), class_distance and word_distance (double, null
    where nothing is compared), base_failed and kept (boolean).

    A null text counts as empty: no words, base_failed. Rows are judged one by
    one, so repeated rows get equal results; a null ``lang`` is a language of
    its own. An empty table gives an empty result. Other columns stay as they
    are, whatever their names; one named ``rules`` is replaced.
    """
    keep = [c for c in documents.columns if c != "rules"]
    documents = documents.select(packed(keep), "lang", "text")
    known = materialize(common_words(documents, common))
    reference = maybe_broadcast(materialize(references(documents, known)))

    def judged(rules: Column) -> Column:
        apart = lambda name: F.when((rules["n_words"] >= guard_words) & (F.col("ref_total") >= guard_reference), jensen_shannon(rules[name], F.col(f"ref_{name}")))
        failed = (rules["n_words"] < MIN_WORDS) | (100 * rules["n_repeat_words"] > MAX_REPEATED_PERCENT * rules["n_words"])

        def decided(d: Column) -> Column:
            far = (F.coalesce(d["c"], F.lit(0.0)) > max_class_distance) | (F.coalesce(d["w"], F.lit(0.0)) > max_word_distance)
            base = [rules[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            return F.struct(*base, d["c"].alias("class_distance"), d["w"].alias("word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept"))

        return let(F.struct(apart("classes").alias("c"), apart("words").alias("w")), decided)

    return measured(documents, reference, judged).select(*unpacked(keep), "rules")
