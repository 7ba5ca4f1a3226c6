"""Quality rules: how far a document's characters and common words are from those of its language.

Every text gets two histograms: character classes, and occurrences of the languages' most common words. The references are
the summed histograms of all documents of a language, so they follow the corpus. A document is compared with its own
language's reference (with every one, and the nearest counts, if its language has none) by the Jensen-Shannon
distance: the square root of the divergence to base 2, between 0 and 1. Short texts have chance histograms, so each
comparison needs a minimum length; the distance that n words have by chance falls with the square root of n, and so
does the limit for being far in both. Its numbers were fitted on the labelled documents of sf0.1 with an even doc_id and checked on the others. Beside them stand the base counts. All of it is DataFrame functions.

Null text has no words and fails the base rules like any text of fewer than ten words. Repeated rows are judged
each. Columns besides the text and the language are not read. No rows: no rows; a language without words has no reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.store import saved

#: Most common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
}
LEXICON = sorted({w for words in COMMON.values() for w in words})
CLASSES = ["lower", "upper", "digit", "symbol", "other_ascii", "white", "beyond_ascii"]

MIN_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
#: Characters a text needs for the first comparison, words for the second.
MIN_CHARS = 200
MIN_COMMON_WORDS = 10
#: Words a text needs to be rejected for the second alone.
MIN_ALONE_WORDS = 100
#: Farther than that in one of them is rejected.
MOST_CHARS_DISTANCE = 0.33
MOST_WORDS_DISTANCE = 0.40
#: And so is farther than that in both; of the words' limit this part is divided by the square root of their number.
BOTH_CHARS_DISTANCE = 0.11
BOTH_WORDS_DISTANCE = 0.10
BOTH_WORDS_SPREAD = 1.2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#*$%&|<>"
_DIGITS = "0123456789"
_WHITE = " \t\n\x0b\x0c\r"
_OTHER = "!\"'()+,-./:;=?@[\\]^_`{}~"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.filter(F.split(blank, " ", -1), lambda w: w != "")


def repeated_words(own: Column) -> Column:
    """Words inside windows of five words found twice or more in the text."""
    n = F.size(own) - WINDOW + 1

    def window(i):
        return F.xxhash64(*[F.get(own, i + k) for k in range(WINDOW)])

    def covered(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(x):
            same = lambda p, k: (F.get(x, k - 1)["h"] == p["h"]) | (F.get(x, k + 1)["h"] == p["h"])
            return F.sort_array(F.transform(F.filter(x, same), lambda p: p["i"]))

        def total(starts):
            step = lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
            return F.aggregate(F.transform(starts, step), F.lit(0), lambda a, x: a + x)

        return _let(_let(ordered, places), total)

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    hashes = F.transform(F.sequence(F.lit(0), n - 1), window)
    return F.when(n < 2, F.lit(0)).otherwise(_let(hashes, count))


#: Other spellings of the common words that count as well.
_SPELLINGS = sorted({x for w in LEXICON for x in (w, w.capitalize(), w.upper())})


def _occurrences(text: Column, part: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))


def features(text: Column) -> Column:
    """A struct of counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and common (arrays)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(own):
        common = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(own, lambda w: w.isin(_SPELLINGS)), "  ")), F.lit(" "))

        def by_word(c):
            return F.array(*[(_occurrences(c, f" {w} ") / (len(w) + 2)).cast("long") for w in LEXICON])

        # Most characters are in lower case; each of the others becomes the sign of its class.
        rest = F.regexp_replace(text, "[a-z]+", "")
        signs = F.translate(rest, _UPPER + _DIGITS + _SYMBOLS + _OTHER + _WHITE, "A" * 26 + "0" * 10 + "#" * 8 + "." * len(_OTHER) + " " * 6)

        def by_class(r):
            upper, digit, symbol, other, white = [_occurrences(r, c) for c in "A0#. "]
            beyond = F.length(F.regexp_replace(r, "[\\x00-\\x7F]+", ""))
            lower = F.length(text) - F.length(r)
            return F.array(*[x.cast("long") for x in (lower, upper, digit, symbol, other, white, beyond)])

        return F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.aggregate(own, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.size(F.array_distinct(lines)).alias("distinct_lines"),
            repeated_words(own).cast("long").alias("n_repeat_words"),
            _let(signs, by_class).alias("chars"),
            _let(common, by_word).alias("common"),
        )

    def finished(f):
        return F.struct(
            f.n_words.alias("n_words"), f.word_chars.alias("word_chars"), f.chars[CLASSES.index("symbol")].alias("n_symbols"),
            (F.size(lines) - f.distinct_lines).cast("long").alias("n_dup_lines"), f.n_repeat_words.alias("n_repeat_words"),
            f.chars.alias("chars"), f.common.alias("common"),
        )

    return _let(_let(words(text), of_words), finished)


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def histograms(f: Column) -> tuple[Column, Column]:
    """Shares of the character classes; shares of the common words among words, with those that are none."""
    n = F.aggregate(f.chars, F.lit(0).cast("long"), lambda a, x: a + x)
    rest = f.n_words - F.aggregate(f.common, F.lit(0).cast("long"), lambda a, x: a + x)
    return _shares(f.chars, n), _shares(F.concat(f.common, F.array(rest)), f.n_words)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(counted: DataFrame, lang: str, f: str) -> DataFrame:
    """One row: an array of language, chars and common for each known language that has words."""
    sums = [F.sum(F.col(f).chars[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.col(f).common[k]).alias(f"w{k}") for k in range(len(LEXICON))]
    by = counted.where(F.col(lang).isin(list(COMMON))).groupBy(F.col(lang).alias("lang"))
    summed = by.agg(F.sum(F.col(f).n_words).alias("n_words"), *sums).where("n_words > 0")
    whole = F.struct(
        F.col("lang"), F.col("n_words"), F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("chars"),
        F.array(*[f"w{k}" for k in range(len(LEXICON))]).alias("common"),
    )
    chars, common = histograms(F.col("s"))
    shares = summed.select(whole.alias("s")).select(F.struct(F.col("s").lang.alias("lang"), chars.alias("chars"), common.alias("common")).alias("r"))
    return shares.agg(F.sort_array(F.collect_list("r")).alias("references"))


def verdict(f: Column, lang: Column, known: Column) -> Column:
    """base_failed, chars_distance, words_distance (null where a guard or a missing reference forbids it), kept."""
    base = (f.n_words < MIN_WORDS) | (100 * f.n_repeat_words > MOST_REPEATED * f.n_words)
    chars, common = histograms(f)
    own = F.filter(known, lambda r: r.lang == lang)
    near = lambda rs, field, mine: F.array_min(F.transform(rs, lambda r: distance(mine, r[field])))

    def judged(rs):
        far_chars = F.when(f.word_chars >= MIN_CHARS, near(rs, "chars", chars))
        far_words = F.when(f.n_words >= MIN_COMMON_WORDS, near(rs, "common", common))
        far = F.coalesce(far_chars > MOST_CHARS_DISTANCE, F.lit(False)) | F.coalesce((f.n_words >= MIN_ALONE_WORDS) & (far_words > MOST_WORDS_DISTANCE), F.lit(False))
        limit = BOTH_WORDS_DISTANCE + BOTH_WORDS_SPREAD / F.sqrt(f.n_words)
        far = far | F.coalesce((far_chars > BOTH_CHARS_DISTANCE) & (far_words > limit), F.lit(False))
        return F.struct(
            base.alias("base_failed"), F.round(far_chars, 6).alias("chars_distance"), F.round(far_words, 6).alias("words_distance"),
            (~base & ~far).alias("kept"),
        )

    return _let(F.when(F.size(own) > 0, own).otherwise(known), judged)


def judge(docs: DataFrame, f: str, lang: str, reference: DataFrame, out: str) -> DataFrame:
    """With the verdict of each row in column `out`; the reference is one row of at most one entry a language."""
    whole = docs.join(F.broadcast(reference.withColumnRenamed("references", "__references")))
    return whole.withColumn(out, verdict(F.col(f), F.col(lang), F.col("__references"))).drop("__references")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    held = docs.withColumn("__features", features(F.col("text")))
    reference = saved(references(held.select("lang", "__features"), "lang", "__features"))
    return judge(held, "__features", "lang", reference, "__verdict").where("__verdict.kept").select(*docs.columns)


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = saved(docs.select("doc_id", "lang", features(F.col("text")).alias("f")))
    judged = judge(counted, "f", "lang", references(counted, "lang", "f"), "v")
    return judged.select(
        "doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
        "v.base_failed", "v.kept", "v.chars_distance", "v.words_distance",
    )
