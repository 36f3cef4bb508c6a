"""Operator 8, quality rules: a threshold table compiled into one projection, without user functions.

Null and empty texts have no words and fail the base rule. Repeated rows are judged alike. Very long
texts cost n log n at most: only texts that have a repeated window are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Common words of the four languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with",
    "le", "la", "les", "de", "des", "et", "est", "que",
    "der", "die", "das", "und", "ist", "nicht", "von", "ein",
    "el", "los", "las", "del", "y", "en", "un", "por",
)
#: name, value (over the columns of ``metrics``), comparison that a kept text meets, bound; a null value meets it.
THRESHOLDS = (
    ("min_mean_word_chars", "word_chars / nullif(n_words, 0)", ">=", 2.0),
    ("max_mean_word_chars", "word_chars / nullif(n_words, 0)", "<=", 20.0),
    ("max_symbol_ratio", "n_symbols / nullif(n_words, 0)", "<=", 0.1),
    ("max_dup_line_ratio", "n_dup_lines / nullif(n_lines, 0)", "<=", 0.5),
    ("min_stop_word_ratio", "n_stop_words / nullif(n_words, 0)", ">=", 0.01),
)


def _let(value: str, name: str, body: str) -> str:
    """Binds ``value`` once for ``body``: an outer column in a lambda would be computed for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def metrics_sql(text: str) -> str:
    """One expression: a struct of counts over the whole text."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    # Hashes of runs of 1, 2, 4 and 8 words, each from two of the former.
    run = lambda n: f"transform(g, (x, i) -> xxhash64(x, get(g, i + {n})))"
    doubled = _let(_let(run(1), "g", run(2)), "g", run(4))
    hashed = _let("transform(w, x -> xxhash64(x))", "g", doubled)
    windows = f"if(size(w) < {WINDOW}, array(), slice({hashed}, 1, size(w) - {WINDOW - 1}))"
    same = "coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)"
    starts = f"array_sort(filter(transform(s, (x, i) -> if({same}, x.p, -1)), p -> p >= 0))"
    covered = f"aggregate(transform(d, (p, i) -> least({WINDOW}, coalesce(get(d, i + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)"
    repeats = _let("array_sort(transform(g, (h, p) -> struct(h as h, p as p)))", "s", _let(starts, "d", covered))
    repeats = _let(windows, "g", f"if(size(array_distinct(g)) = size(g), 0L, {repeats})")
    return _let(
        rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x <> '')",
        "w",
        "named_struct('n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), "
        f"'n_repeat_words', {repeats}, 'n_stop_words', cast(size(filter(w, x -> lower(x) in ({stop}))) as bigint))",
    )


def lines_sql(text: str) -> str:
    return _let(
        rf"filter(split({text}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
        "l",
        "named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint))",
    )


def verdict(thresholds=THRESHOLDS):
    """True where every threshold of the table is met; the base rule comes first."""
    out = ~F.col("base_failed")
    for _, value, how, bound in thresholds:
        out = out & F.expr(f"coalesce({value} {how} {bound}D, true)")
    return out


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with the columns of the counts, ``base_failed`` and ``kept``; one projection, no shuffle.

    Columns of ``docs`` whose names clash with those are replaced.
    """
    text = "coalesce(text, '')"
    m = F.expr(metrics_sql(text))
    counted = docs.withColumn("__m", m).withColumn("__l", F.expr(lines_sql(text))).withColumn("n_symbols", F.expr(f"cast(length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', '')) as bigint)"))
    for part, names in (("__m", ("n_words", "word_chars", "n_repeat_words", "n_stop_words")), ("__l", ("n_lines", "n_dup_lines"))):
        for name in names:
            counted = counted.withColumn(name, F.col(f"{part}.{name}"))
    counted = counted.drop("__m", "__l")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", verdict(thresholds))


def keep(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    return judge(packed, thresholds).where("kept").select("__row.*")
