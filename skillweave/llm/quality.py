"""Quality rules: base counts, and divergence of a document's histograms from its language's reference.

Native: DataFrame functions only, nothing leaves the JVM and no text is shuffled.  One pass over the texts makes narrow
features, which are stored; the references (mean histograms of all documents of a language that are long enough) are one
small aggregation over them.  A document is compared with the reference of its language in two histograms, character
classes and common words, by the Jensen-Shannon distance (base 2, 0 to 1).  Short documents get a wider limit, because
one address or number in them moves a histogram far.

A null text has no words (all counts 0, base_failed).  A language without a word list, or none, shares one group, judged
by character classes only.  Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.llm.shared import write_table

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
# Character classes, in the order in which they are taken out of a text.
CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", r"\p{L}+", "[.,;:?'\"()-]+", "!+", "[#*$%&|<>]+"]
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: Limits of the two distances for a long document; a document of n words gets SLACK / n more.
CHAR_LIMIT, WORD_LIMIT, SLACK = 0.13, 0.22, 10.0
#: Beyond this distance from the first means a document isn't part of the second.
FAR = 0.4


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that occurs at least twice."""

    def count(w: Column) -> Column:
        window = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def covered(h: Column) -> Column:
            by_window = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def twice(s: Column) -> Column:
                at = F.transform(s, lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"]))
                return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

            def total(p: Column) -> Column:
                gaps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
                return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(by_window, twice), total))

        return _let(window, covered)

    return _let(ws, count).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _group(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))


def features(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every document, without its text.  A missing ``lang`` column counts as null."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", _group(lang).alias("lang_group"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    step = base.select(
        "doc_id",
        "lang_group",
        words(F.col("body")).alias("ws"),
        duplicate_lines(F.col("body")).alias("n_dup_lines"),
        F.regexp_replace("body", SPACE, "").alias("s0"),
        F.concat(F.lit(" "), F.regexp_replace(F.lower("body"), r"[^\p{L}]+", "  "), F.lit(" ")).alias("letters"),
    )
    step = step.select("doc_id", "lang_group", F.size("ws").cast("long").alias("n_words"), repeated_words(F.col("ws")).alias("n_repeat_words"), "n_dup_lines", "s0", "letters")
    for k, kind in enumerate(CLASSES):
        step = step.withColumn(f"s{k + 1}", F.regexp_replace(f"s{k}", kind, ""))
    sizes = [F.length(f"s{k}") for k in range(len(CLASSES) + 1)]
    classes = [sizes[k] - sizes[k + 1] for k in range(len(CLASSES))] + [sizes[-1]]
    total = F.length("letters")

    def occurrences(word: str) -> Column:
        return (total - F.length(F.replace(F.col("letters"), F.lit(f" {word} "), F.lit("")))) / F.lit(len(word) + 2)

    common = F.when(F.lit(False), F.array().cast("array<double>"))
    for group, listed in COMMON_WORDS.items():
        common = common.when(F.col("lang_group") == group, F.array(*[occurrences(w) for w in listed]))
    letter_words = (total - F.length(F.replace(F.col("letters"), F.lit("  "), F.lit("")))) / F.lit(2) + F.lit(1)
    return step.select(
        "doc_id",
        "lang_group",
        "n_words",
        F.col("s0").alias("s0"),
        "n_dup_lines",
        "n_repeat_words",
        sizes[0].cast("long").alias("word_chars"),
        classes[-2].cast("long").alias("n_symbols"),
        F.array(*[c.cast("double") for c in classes]).alias("chars"),
        common.alias("common"),
        letter_words.alias("letter_words"),
    ).drop("s0")


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def histograms(measured: DataFrame) -> DataFrame:
    chars = _shares(F.col("chars"), F.col("word_chars").cast("double"))
    seen = F.aggregate("common", F.lit(0.0), lambda a, x: a + x)
    other = F.greatest(F.col("letter_words") - seen, F.lit(0.0))
    wordy = F.concat(F.col("common"), F.array(other))
    return measured.withColumn("p_chars", chars).withColumn("p_words", _shares(wordy, seen + other)).drop("chars", "common", "letter_words")


def references(shares: DataFrame) -> DataFrame:
    """Mean histograms of all documents of at least ``MIN_WORDS`` words, one row per language group.

    A second round leaves out what is far from the first round's means, so that junk doesn't shift its own yardstick.
    """
    first = _means(shares)
    near = _distances(shares, first).filter((F.col("char_distance") <= FAR) & (F.col("word_distance") <= FAR))
    second = _means(near.select(shares.columns))
    return first.select("lang_group", F.col("q_chars").alias("a"), F.col("q_words").alias("b")).join(second, "lang_group", "left").select(
        "lang_group", F.coalesce("q_chars", "a").alias("q_chars"), F.coalesce("q_words", "b").alias("q_words")
    )


def _distances(shares: DataFrame, q: DataFrame) -> DataFrame:
    """``q`` has at most one row per word list, and one more."""
    return shares.join(F.broadcast(q), "lang_group", "left").select(
        *shares.columns,
        F.coalesce(divergence(F.col("p_chars"), F.col("q_chars")), F.lit(0.0)).alias("char_distance"),
        F.coalesce(divergence(F.col("p_words"), F.col("q_words")), F.lit(0.0)).alias("word_distance"),
    )


def _means(shares: DataFrame) -> DataFrame:
    bins, common = len(CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    return (
        shares.filter(F.col("n_words") >= MIN_WORDS)
        .groupBy("lang_group")
        .agg(
            F.array(*[F.avg(F.get("p_chars", F.lit(k))) for k in range(bins)]).alias("q_chars"),
            F.array(*[F.avg(F.get("p_words", F.lit(k))) for k in range(common)]).alias("q_words"),
        )
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, base_failed, both distances and kept."""
    shares = write_table(histograms(features(docs)), "quality")
    measured = _distances(shares, references(shares))
    limit = F.lit(SLACK) / F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_distance", "word_distance", limit.alias("slack")
    )
    kept = ~F.col("base_failed") & (F.col("char_distance") <= CHAR_LIMIT + F.col("slack")) & (F.col("word_distance") <= WORD_LIMIT + F.col("slack"))
    return judged.withColumn("kept", kept).drop("slack")
