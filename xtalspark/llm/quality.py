"""Quality rules: a threshold table compiled into one Spark projection.

The main path holds DataFrame functions only. A row's measures depend on that
row alone, so the plan is a scan and a projection: no exchange, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

WINDOW = 5

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with in is it for on as by this are "
    "le la les de des du et un une en que qui dans pour est par sur au il elle ou "
    "der die das und ist nicht ein eine mit von den zu auf für sich im dem "
    "el los las y que en un una por con para se no del es su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """measure (a key of ratios()) must lie within low and high; None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. A text must pass all rules.
RULES = (
    Rule("word_count", "n_words", low=10),
    Rule("repeated_words", "repeat_percent", high=20),
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("stop_words", "stop_word_share", low=0.02),
    Rule("duplicate_lines", "dup_line_share", high=0.5),
    Rule("bullet_lines", "bullet_line_share", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_share", high=0.3),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    def over(h: Column) -> Column:
        at = lambda i: xx(*(F.get(h, i + k) for k in range(WINDOW)))
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at)

    xx = F.xxhash64
    return F.when(F.size(words) >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), over)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, first included.

    Windows are compared by 64-bit hash. Texts without a repeated window, the
    usual case, end after one hash set; others sort (hash, position) once.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hits(p: Column) -> Column:
            equals = lambda x, j: F.coalesce(x["h"] == F.get(p, j)["h"], F.lit(False))
            hit = F.filter(p, lambda x, j: equals(x, j - 1) | equals(x, j + 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, hits), total)

    return let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """Counts over words, over lines, and of symbols, each read once from text."""
    t = F.coalesce(text, F.lit(""))
    n_symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    in_stops = lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS)))

    def from_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, in_stops)).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def from_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[ \t-\r]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[ \t-\r]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    return let(words_of(text), from_words), let(lines, from_lines), n_symbols.cast("long")


def measures(df: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """Append the struct column `out` of counts to df.

    Null and empty texts have zero everywhere. A column `out` of df is replaced.
    """
    w, lines, n_symbols = _parts(F.col(text))
    parts = df.select("*", w.alias("__w"), lines.alias("__l"), n_symbols.alias("__s"))
    m = F.struct("__w.*", "__l.*", F.col("__s").alias("n_symbols"))
    return parts.withColumn(out, m).drop("__w", "__l", "__s")


#: Counts by the part of a text they are read from.
PARTS = {
    "w": ("n_words", "word_chars", "n_stop_words", "n_repeat_words"),
    "l": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"),
}


def ratios(m) -> dict[str, Column]:
    """Measures by name, from the struct of counts or a dictionary of them."""
    words = F.greatest(m["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(m["n_lines"], F.lit(1)).cast("double")
    return {
        "n_words": m["n_words"].cast("double"),
        "repeat_percent": 100 * m["n_repeat_words"] / words,
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_word_share": m["n_stop_words"] / words,
        "dup_line_share": m["n_dup_lines"] / lines,
        "bullet_line_share": m["n_bullet_lines"] / lines,
        "ellipsis_line_share": m["n_ellipsis_lines"] / lines,
    }


def verdict(m, rules=RULES) -> tuple[Column, Column]:
    """Whether all rules hold, and the array of names of those that do not."""
    r = ratios(m)
    failed = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (r[rule.measure] < rule.low)
        if rule.high is not None:
            bad = bad | (r[rule.measure] > rule.high)
        failed.append(F.when(bad, F.lit(rule.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def score(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Append m (counts), failed_rules and kept, replacing such columns; every row
    of df stays, in repeats too. Null and empty texts break the word count rule."""
    kept, names = verdict(F.col("m"), rules)
    return measures(df, text).withColumn("failed_rules", names).withColumn("kept", kept)


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that pass all rules, with df's own columns.

    The counts are a variable of one expression: as a column they would be put
    anew, split and all, in place of each of the filter's references to them.
    """
    w, lines, n_symbols = _parts(F.col(text))

    def passes(p: Column) -> Column:
        flat = {name: p[part][name] for part, names in PARTS.items() for name in names}
        return verdict(flat | {"n_symbols": p["s"]}, rules)[0]

    return df.filter(let(F.struct(w.alias("w"), lines.alias("l"), n_symbols.alias("s")), passes))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
