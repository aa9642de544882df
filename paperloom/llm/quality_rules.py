"""Quality rules as one native projection: a threshold table over length, symbol, stop-word and line ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages the engine meets, without those that mean something else in another of them.
STOP_WORDS = "the of and to in is that was for on with as are this from by at be a der die das und ist von zu mit den dem ein eine nicht auf für sich im le la les de des et est un une dans que pour qui sur avec pas du au el los las y en por con se su una para del es".split()


@dataclass(frozen=True)
class Rule:
    """A text fails where the measure lies outside ``low`` to ``high``; null measures pass."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The method's thresholds.
RULES = [
    Rule("mean_word_chars", low=1.5, high=25),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("upper_ratio", high=0.7),
    Rule("distinct_word_ratio", low=0.02),
]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not again for every element that a lambda visits."""
    return F.transform(F.array(value), use)[0]


def text_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _covered(starts: Column, size: int) -> Column:
    """Places covered by windows of ``size`` at the sorted ``starts``."""
    step = lambda s: F.transform(s, lambda x, i: F.when(i + 1 < F.size(s), F.least(F.lit(size), F.get(s, i + 1) - x)).otherwise(size))
    return let(starts, lambda s: F.coalesce(F.aggregate(step(s), F.lit(0).cast("int"), lambda a, x: a + x), F.lit(0))).cast("long")


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words in windows of ``size`` words that are found twice or more in the text.

    Window hashes are compared as a set first; only texts with a repeat sort them.
    """

    def of_hashes(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        starts = let(marked, lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(starts, size)).otherwise(F.lit(0).cast("long"))

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(words) >= size, let(hashes(words), of_hashes)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of every whole text, in native expressions.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_lines and
    the ratios that the rules name.  A null or empty text has zero counts and null
    ratios.  Columns of ``df`` that bear the name of a measure are replaced, all others stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def per_words(w: Column) -> Column:
        lowered = F.transform(w, lambda x: F.lower(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(lowered, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    per_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    # two helper columns under names that the table does not have
    by_words, by_lines = (next(n for i in count() if (n := f"_{k}{i}") not in df.columns) for k in ("words", "lines"))
    m = F.col(by_words)
    letters = F.length(F.regexp_replace(t, r"[^A-Za-z]+", ""))
    added = {
        **{c: m[c] for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_distinct_words")},
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
        **{c: F.col(by_lines)[c] for c in ("n_lines", "n_dup_lines")},
        "n_letters": letters.cast("long"),
        "n_upper": F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long"),
    }
    return df.withColumns({by_words: let(text_words(F.col(text)), per_words), by_lines: let(lines, per_lines)}).withColumns(added).drop(by_words, by_lines)


def ratios() -> dict[str, Column]:
    """Ratios over the columns that ``measures`` adds; null where there is nothing to divide by."""
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "upper_ratio": ratio("n_upper", "n_letters"),
        "distinct_word_ratio": ratio("n_distinct_words", "n_words"),
    }


def compiled(rules: list[Rule]) -> Column:
    """The threshold table as one boolean expression."""
    by = ratios()

    def passes(r: Rule) -> Column:
        x = by.get(r.measure, F.col(r.measure))
        tests = [x >= r.low] if r.low is not None else []
        return reduce(lambda a, b: a & b, [*tests, *([x <= r.high] if r.high is not None else [])], F.lit(True))

    return reduce(lambda a, b: a & b, (F.coalesce(passes(r), F.lit(True)) for r in rules), F.lit(True))


def quality_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Adds the measures, base_failed and kept; every row stays and is judged by itself.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated``
    per cent of them in repeated windows.  ``kept``: not base_failed and no rule of
    the table broken.  A null or empty text has no words and so fails.  Columns that
    bear the name of a measure, base_failed or kept are replaced, all others stay.
    """
    low = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = measures(df, text).withColumn("base_failed", low)
    return out.withColumn("kept", ~F.col("base_failed") & compiled(RULES if rules is None else rules))
