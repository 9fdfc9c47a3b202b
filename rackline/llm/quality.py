"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackline.llm.text import let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the languages of the corpus.
STOP_WORDS = (
    # English
    "the of and to in is was that it for on with as at by from or are be this "
    # French
    "le la les de des et un une que qui en est par pour dans "
    # German
    "der die das und den von zu mit sich ist im nicht ein eine auf als auch für "
    # Spanish
    "el los las del y se no por con su una como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text whose metric lies within [low, high]; an open end is None."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_word_ratio", high=0.30),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_word_ratio", high=0.10),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.50),
    Rule("shouted_word_ratio", high=0.50),
)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_shouted_words")
_NO_GAPS = " \t\n\x0b\x0c\r"


def _long(value) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _covered(at: Column) -> Column:
    """Words inside the windows that start at the sorted positions ``at``, one at least."""
    others = F.size(at) - 1
    steps = F.zip_with(F.slice(at, 1, others), F.slice(at, 2, others), lambda a, b: F.least(b - a, _long(WINDOW)))
    return F.aggregate(steps, _long(WINDOW), lambda a, b: a + b)


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice, from the hashes of all windows in order.

    One long per window is sorted: the upper bits of its hash, and its position below
    them.  Windows with equal hashes are neighbours then.
    """
    bits = F.ceil(F.log2(F.size(hashes) + F.lit(1))).cast("int")

    def key(bits: Column):
        def of(h: Column, i: Column) -> Column:
            upper = F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits)
            return upper + i.cast("long")

        return of

    def positions(keys: Column, mask: Column) -> Column:
        def hash_at(i: Column) -> Column:
            return F.get(hashes, F.get(keys, i).bitwiseAND(mask).cast("int"))

        def again(k: Column, i: Column) -> Column:
            mine = F.get(hashes, k.bitwiseAND(mask).cast("int"))
            return F.coalesce(mine == hash_at(i - 1), F.lit(False)) | F.coalesce(mine == hash_at(i + 1), F.lit(False))

        return F.sort_array(F.transform(F.filter(keys, again), lambda k: k.bitwiseAND(mask)))

    def counted(bits: Column) -> Column:
        mask = F.call_function("shiftleft", _long(1), bits) - 1
        return let(
            F.sort_array(F.transform(hashes, key(bits))), lambda keys: let(positions(keys, mask), _covered)
        )

    return let(bits, counted)


def _word_counts(words_: Column) -> Column:
    both_cases = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    n = F.size(words_)
    windows = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(windows, lambda i: F.xxhash64(F.slice(words_, i, WINDOW)))
    repeated = let(
        hashes,
        # Most texts repeat nothing, and sort nothing.
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated_words(h)).otherwise(_long(0)),
    )
    return F.struct(
        _long(n).alias("n_words"),
        _long(F.size(F.filter(words_, lambda w: w.isin(both_cases)))).alias("n_stop_words"),
        repeated.alias("n_repeat_words"),
    )


def _line_counts(lines: Column) -> Column:
    return F.struct(
        _long(F.size(lines)).alias("n_lines"),
        _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of every text beside the columns in ``docs``.

    ``n_repeat_words`` counts the words inside 8-word windows that occur twice or more
    in their text.  Windows are compared by 64-bit hashes.  Everything is one expression
    over the single text, with intermediate arrays bound once, so that a filter on the
    counts may be pushed down without harm.

    Null and empty texts have zero of everything.  Columns of ``docs`` with the name of
    a count are replaced in the result.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: F.length(F.translate(line, _NO_GAPS, "")) > 0)
    shouted = F.regexp_count(value, F.lit(r"(^|[\x20\x09-\x0D])[A-ZÀ-Þ]{3}"))
    kept = [c for c in docs.columns if c == text or c not in COUNTS]
    counted = docs.select(
        *kept,
        let(words(value), _word_counts).alias("__words"),
        let(lines, _line_counts).alias("__lines"),
        _long(F.length(F.translate(value, _NO_GAPS, ""))).alias("word_chars"),
        _long(F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).alias("n_symbols"),
        _long(shouted).alias("n_shouted_words"),
    )
    return counted.select(*kept, "__words.*", "__lines.*", "word_chars", "n_symbols", "n_shouted_words")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def metrics() -> dict[str, Column]:
    """Rule metrics over the counts of ``measure``."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_word_ratio": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "shouted_word_ratio": _ratio("n_shouted_words", "n_words"),
    }


def compile_rules(rules=RULES) -> Column:
    """Names of the rules that a measured text breaks, as one array expression."""
    known = metrics()
    broken = []
    for rule in rules:
        value = known[rule.metric]
        outside = [value < rule.low] if rule.low is not None else []
        outside += [value > rule.high] if rule.high is not None else []
        broken.append(F.when(reduce(Column.__or__, outside, F.lit(False)), F.lit(rule.metric)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with its counts, ``broken`` (names of failed rules) and ``kept``.

    No row is added or lost: repeated rows are judged alike, an empty table stays empty.
    """
    measured = measure(docs, text)
    return measured.withColumn("broken", compile_rules(rules)).withColumn(
        "kept", F.size("broken") == 0
    )
