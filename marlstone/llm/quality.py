"""Quality rules: text statistics and distribution divergence from language references (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP

SYMBOLS = "#*$%&|<>"

# The sixteen commonest words of each language in the order of their frequency, and
# the usual shares of ASCII letters and other plain characters, digits, punctuation, characters
# outside ASCII and white space in its prose.
LANGUAGES = {
    "de": (["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"], [0.820, 0.005, 0.025, 0.015, 0.135]),
    "en": (["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "be"], [0.805, 0.005, 0.025, 0.000, 0.165]),
    "es": (["de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "su"], [0.785, 0.005, 0.025, 0.020, 0.165]),
    "fr": (["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par"], [0.770, 0.005, 0.030, 0.035, 0.160]),
    "it": (["di", "e", "la", "il", "che", "in", "a", "un", "per", "del", "non", "una", "con", "della", "i", "le"], [0.805, 0.005, 0.025, 0.010, 0.155]),
    "nl": (["de", "het", "van", "een", "en", "in", "is", "dat", "op", "te", "zijn", "voor", "met", "die", "niet", "aan"], [0.805, 0.005, 0.025, 0.001, 0.164]),
    "pl": (["w", "i", "na", "z", "się", "do", "nie", "że", "to", "jest", "o", "a", "po", "jak", "od", "za"], [0.760, 0.005, 0.030, 0.060, 0.145]),
    "pt": (["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se"], [0.775, 0.005, 0.025, 0.035, 0.160]),
    "ru": (["и", "в", "не", "на", "что", "с", "он", "как", "по", "а", "но", "к", "из", "у", "это", "за"], [0.000, 0.005, 0.030, 0.815, 0.150]),
}
#: Characters of no script that the references are written in.
FOREIGN = r"[^\x00-\x7F\p{IsLatin}\p{IsCyrillic}]"
VOCABULARY = sorted({w for words, _ in LANGUAGES.values() for w in words})
#: Zipf's law for common words: the share of the word of rank r is FIRST / r ** EXPONENT.
FIRST, EXPONENT, RANKS = 0.063, 0.87, 16
WORD_SHARES = [round(FIRST / r**EXPONENT, 6) for r in range(1, RANKS + 1)]
WORD_SHARES.append(round(1 - sum(WORD_SHARES), 6))

#: A document is judged by divergence from this many words and code points.
MIN_WORDS, MIN_CHARS = 50, 200
#: Largest Jensen-Shannon distance (base 2, 0 to 1) to the language's reference; that of words after
#: its square is less by NOISE / words, the divergence that a sample of so many words has by chance.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.24
NOISE = round(RANKS / (8 * math.log(2)), 6)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array, first ones included.

    Windows are told apart by a 64-bit hash of their three words. Only texts with an equal pair of
    windows sort them; the sorted pairs (hash, position) that equal a neighbour are the repeats,
    and each adds the words up to the next one's start, three at most."""
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(marked: Column) -> Column:
        again = F.filter(marked, lambda x, i: (x["h"] == F.get(marked, i - 1)["h"]) | (x["h"] == F.get(marked, i + 1)["h"]))
        return _once(F.sort_array(F.transform(again, lambda x: x["i"])), lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return _once(
        hashes,
        lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(
            _once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_features(docs: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    """A row for each document: row (all its columns), base statistics, the character classes as an
    array of counts, and its common words, each between two spaces."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), t.alias("t"), F.filter(F.split(t, GAP), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.transform("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")))
    common = F.array_join(F.filter(bare, lambda w: w.isin(*VOCABULARY)), "  ")
    n_chars, white = F.char_length("t").cast("long"), _count(F.col("t"), r"[\x20\x09-\x0D]")
    digit, mark, wide = (_count(F.col("t"), p) for p in ("[0-9]", r"[!-/:-@\[-`{-~]", r"[^\x00-\x7F]"))
    # texts of a language with a reference are not looked at for their script
    foreign = F.when(F.col("lang").isin(*LANGUAGES), F.lit(0)).otherwise(_count(F.col("t"), FOREIGN)).cast("long")
    # a generator, so that no filter on the verdict moves these into itself and computes them over and over
    features = F.struct(
        F.size("words").cast("long").alias("n_words"),
        (n_chars - white).alias("word_chars"),
        _count(F.col("t"), f"[{SYMBOLS}]").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        n_chars.alias("n_chars"),
        (2 * foreign > n_chars - white).alias("foreign"),
        F.array(digit, mark, wide, white).alias("counts"),
        F.concat(F.lit(" "), common, F.lit(" ")).alias("common"),
    )
    df = df.select("row", "doc_id", "lang", F.explode(F.array(features)).alias("f")).select("row", "doc_id", "lang", "f.*")
    plain = F.col("n_chars") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("classes", F.concat(F.array(plain), "counts")).drop("counts")


def _common_counts(words: Column) -> Column:
    """How often each of the words is among the common ones, and the number of all other words."""
    size = lambda w: ((F.octet_length("common") - F.octet_length(F.replace("common", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long")
    return _once(F.transform(words, size), lambda n: F.concat(n, F.array(F.greatest(F.lit(0), F.col("n_words") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)))))


def _of_language(values: dict[str, Column]) -> Column:
    """An array of the language's own value, or of those of all languages where it is not known."""
    out = F.array(*values.values())
    for name, value in values.items():
        out = F.when(F.col("lang") == name, F.array(value)).otherwise(out)
    return out


def _shares(counts: Column) -> Column:
    total = lambda n: F.greatest(F.lit(1), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x))
    return _once(counts, lambda n: F.transform(n, lambda x: x / total(n)))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance with logarithms to base 2."""

    def half(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    with_row: bool = False,
) -> DataFrame:
    """A row for each document: doc_id, lang, the base statistics, class_distance, word_distance,
    base_failed and kept; with_row adds row, the document's own columns.

    Words are runs of characters other than ASCII white space. word_chars counts their code points,
    n_symbols the characters #*$%&|<>, n_dup_lines the lines with a word that equal an earlier line,
    n_repeat_words the words in 3-word windows that occur twice or more. base_failed: fewer than 50
    words, or more than half of them repeated.

    References are fixed and stand apart from the corpus: usual shares of five character classes,
    letters of either case alike, and Zipf's law over a language's commonest words in their order. A
    document is rejected if its Jensen-Shannon distance to its language's reference exceeds either
    limit, that of words less what chance adds in a text of its length; one of a language without a reference, or of none, is held against the nearest of all
    references, unless most of its characters are of scripts that no reference is written in: such a
    document, and those below MIN_WORDS or MIN_CHARS, are judged by the base rules alone. A verdict depends on the
    document's own text and language only, so no rows meet and equal rows have equal verdicts.

    A null text has no words, so it fails the base rules, as does an empty one; texts of any length are
    read whole; an empty table gives no rows. Other columns are ignored, whatever their names."""
    rows = text_features(docs, text, doc_id, lang)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    usable = ~failed & (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS) & ~F.col("foreign")
    lists = _of_language({k: F.array(*map(F.lit, words)) for k, (words, _) in LANGUAGES.items()})
    classes = _of_language({k: F.array(*map(F.lit, shares)) for k, (_, shares) in LANGUAGES.items()})
    zipf = F.array(*map(F.lit, WORD_SHARES))
    class_distance = _once(_shares(F.col("classes")), lambda p: F.array_min(F.transform(classes, lambda q: _distance(p, q))))
    word_distance = F.array_min(F.transform(lists, lambda words: _distance(_shares(_common_counts(words)), zipf)))
    rows = rows.withColumns({"base_failed": failed, "class_distance": F.when(usable, class_distance), "word_distance": F.when(usable, word_distance)})
    beyond = F.col("word_distance") * F.col("word_distance") - NOISE / F.col("n_words")
    far = F.coalesce((F.col("class_distance") > max_class) | (beyond > max_word * max_word), F.lit(False))
    names = ("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed")
    return rows.select(*names, (~F.col("base_failed") & ~far).alias("kept"), *(["row"] if with_row else []))
