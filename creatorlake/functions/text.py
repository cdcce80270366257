"""Text functions and transcript metrics, all on built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Plurals that follow no rule.
IRREGULAR_PLURALS = {
    "children": "child", "men": "man", "women": "woman", "people": "person",
    "teeth": "tooth", "feet": "foot", "mice": "mouse", "geese": "goose",
    "oxen": "ox", "lice": "louse", "cacti": "cactus", "fungi": "fungus",
    "alumni": "alumnus", "larvae": "larva", "vertebrae": "vertebra",
    "knives": "knife", "wives": "wife", "lives": "life", "wolves": "wolf",
    "halves": "half", "shelves": "shelf", "leaves": "leaf", "loaves": "loaf",
    "thieves": "thief", "scarves": "scarf",
}


def singular(word: Column) -> Column:
    """The singular in lower case: irregular plurals, short words in capitals but for their s, then suffixes. Words of two letters stay as they are."""
    low = F.lower(word)
    n = F.length(low)
    cut = lambda k: F.substring(low, F.lit(1), n - k)
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR_PLURALS.items() for x in pair])
    return (
        F.when(n <= 2, word)
        .when(low.isin(*IRREGULAR_PLURALS), F.try_element_at(known, low))
        .when((word == F.upper(word)) & (n <= 4), F.when(low.endswith("s"), cut(1)).otherwise(low))
        .when(low.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(low.rlike("(x|z|ch|sh|ss)es$"), cut(2))
        .when(low.endswith("ses") & (n > 4), cut(1))
        .when(low.endswith("s") & ~low.rlike("(ss|us|is)$"), cut(1))
        .otherwise(low)
    )


#: Spaces of any width, which a text may begin and end with.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\f\r]+", " "), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def normalised(text: Column) -> Column:
    """Lower case, without addresses; anything but a-z and 0-9 is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), "[^a-z0-9]+", " "))


def shingles(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by one space. The tokens stay outside of lambdas, where they would be made anew for each run."""
    runs = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, 1, runs)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, runs), lambda a, b: F.concat_ws(" ", a, b))
    return out


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of each phrase, added up."""
    out = F.lit(0)
    for p in phrases:
        out = out + (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    return out.cast("long")


def whole_word_count(text: Column, word: str) -> Column:
    """How often word stands in the text with no ASCII letter, digit or underscore next to it."""
    return F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")).cast("long")


def vocabulary_metrics(df: DataFrame, ident: str, text: str) -> DataFrame:
    """unique_word_ratio, hapax_legomena_ratio and vocabulary_richness_yule_k of each text with words.

    Words are counted by grouping: distinct elements of a long array would cost its length squared.
    """
    w = df.select(ident, F.explode(words(F.lower(text))).alias("__w")).groupBy(ident, "__w").agg(F.count(F.lit(1)).alias("__n"))
    sums = w.groupBy(ident).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("__n") == 1).alias("once"), F.sum(F.col("__n") * F.col("__n")).alias("squares"))
    return sums.select(ident, (F.col("kinds") / F.col("n")).alias("unique_word_ratio"), (F.col("once") / F.col("n")).alias("hapax_legomena_ratio"), (1e4 * (F.col("squares") - F.col("n")) / (F.col("n") * F.col("n"))).alias("vocabulary_richness_yule_k"))


def set_jaccard(left: DataFrame, right: DataFrame, ident: list[str], item: str) -> DataFrame:
    """Jaccard of the item sets that both sides have under the same ident; 0 where they share none."""
    a, b = left.select(*ident, item).distinct(), right.select(*ident, item).distinct()
    both = a.join(b, [*ident, item]).groupBy(*ident).agg(F.count(F.lit(1)).alias("__i"))
    size = lambda d, n: d.groupBy(*ident).agg(F.count(F.lit(1)).alias(n))
    out = size(a, "__a").join(size(b, "__b"), ident).join(both, ident, "left")
    shared = F.coalesce("__i", F.lit(0))
    return out.select(*ident, (shared / (F.col("__a") + F.col("__b") - shared)).alias("jaccard"))


def hash_fold(key: Column, k: int) -> Column:
    """First byte of the SHA-256 of the key, modulo k."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % k).cast("int")


def duration_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss, mm:ss or ss."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda s, x: s * 60 + x.cast("long"))


def leading_words(w: Column, seconds: float, duration: Column) -> Column:
    """The words of the first seconds, if they come evenly over the duration; all words where it is zero or null.

    A negative duration gives a negative number of words, which counts from the end as a slice does.
    """
    share = F.when(duration != 0, F.least(F.lit(1.0), F.lit(seconds) / duration)).otherwise(1.0)
    n = F.ceil(F.size(w) * share).cast("int")
    return F.slice(w, 1, F.when(n < 0, F.greatest(F.size(w) + n + 1, F.lit(0))).otherwise(n))


def mean_length(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / F.size(w))


def _share(w: Column, test) -> Column:
    """NaN where there are no words."""
    return F.when(F.size(w) > 0, F.size(F.filter(w, test)) / F.size(w)).otherwise(float("nan"))


def per_second(n: Column, duration: Column) -> Column:
    """Infinite over no time; NaN if nothing comes in no time."""
    return F.when(duration == 0, F.when(n > 0, float("inf")).otherwise(float("nan"))).otherwise(n / duration)


FIRST_PERSON, SECOND_PERSON = ("i", "me", "my", "we", "our"), ("you", "your", "yours")


def with_words(df: DataFrame, text: str, w: str = "__w") -> DataFrame:
    """df with its words as a column: many metrics read it, so it is made once, below them."""
    return df.withColumn(w, words(F.col(text)))


def transcript_metrics(text: Column, w: Column, duration: Column) -> dict[str, Column]:
    """Columns by metric name; w from with_words."""
    low, n = F.transform(w, F.lower), F.size(w)
    marks = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "transcript_word_count": n.cast("long"),
        "transcript_char_count": F.length(text).cast("long"),
        "transcript_number_count": F.regexp_count(text, F.lit("[0-9]+")).cast("long"),
        "speech_rate_wps": per_second(n, duration),
        "question_count": marks("?").cast("long"),
        "exclamation_count": marks("!").cast("long"),
        "sentence_count": F.regexp_count(text, F.lit("[.!?]")).cast("long"),
        "avg_word_length": mean_length(w),
        "uppercase_word_ratio": _share(w, lambda x: (F.length(x) >= 2) & (x == F.upper(x)) & (x != F.lower(x))),
        "short_word_ratio": _share(w, lambda x: F.length(x) <= 3),
        "long_word_ratio": _share(w, lambda x: F.length(x) >= 8),
        "first_person_ratio": _share(low, lambda x: x.isin(*FIRST_PERSON)),
        "second_person_ratio": _share(low, lambda x: x.isin(*SECOND_PERSON)),
    }


def title_metrics(title: Column, w: Column) -> dict[str, Column]:
    return {
        "title_char_count": F.length(title).cast("long"),
        "title_word_count": F.size(w).cast("long"),
        "title_question_flag": title.contains("?"),
        "title_exclamation_flag": title.contains("!"),
        "title_number_flag": title.rlike("[0-9]"),
        "title_all_caps_word_count": F.size(F.filter(w, lambda x: (F.length(x) >= 2) & (x == F.upper(x)) & (x != F.lower(x)))).cast("long"),
        "title_avg_word_length": mean_length(w),
        "title_uniqueness_score": F.size(F.filter(w, lambda x: F.length(x) > 6)).cast("long"),
        "title_compression_ratio": F.when(F.size(w) > 0, F.length(title) / F.size(w)),
    }
