"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures are SQL expressions of the text alone, so the plan is a scan and
a projection: no shuffle, no user function.

Null and empty texts have no words, every measure is 0 and they fail. Texts are
read whole, whatever their length. Repeated rows are judged alike, each by itself,
and an empty table gives no rows. Further columns pass through ``judge`` untouched,
but own columns named like a measure, ``base_failed`` or ``kept`` give way to it.
``keep`` returns the input's columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm import common

WHITE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "de la que el en y a los se del las un por con no una su para es al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= measure <= high``."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("mean_word_length", low=3.0, high=12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != F.lit(""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more.

    The windows are sorted with their places; equal neighbours are repeats,
    and each repeat adds the words up to the next one's start, three at most.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p")),
    )
    places = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"])),
            lambda x: x["p"],
        )
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


def _text_measures(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != F.lit(""))
    return {
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "_words": let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                repeated_words(w).cast("long").alias("rep"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop"),
            ),
        ),
    }


def _ratios(of: Callable[[str], Column]) -> dict[str, Column]:
    """The measures that rules may name, from the counts of a text."""
    words, lines = of("_words"), of("_lines")
    n = words["n"]
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    return {
        "n_words": n,
        "word_chars": of("word_chars"),
        "n_symbols": of("n_symbols"),
        "n_dup_lines": lines["dup"],
        "n_repeat_words": words["rep"],
        "mean_word_length": over(of("word_chars"), n),
        "symbol_ratio": over(of("n_symbols"), n),
        "stop_word_ratio": over(words["stop"], n),
        "dup_line_ratio": over(lines["dup"], lines["n"]),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures; own columns of their names give way to them."""
    value = F.coalesce(F.col(text), F.lit(""))
    measures = _text_measures(value)
    names = dict(zip(measures, common.fresh(docs.columns, *measures), strict=True))
    inner = docs.withColumns({names[k]: v for k, v in measures.items()})
    out = _ratios(lambda k: F.col(names[k]))
    return inner.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in out], *[v.alias(k) for k, v in out.items()])


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES, of: Callable[[str], Column] = F.col) -> Column:
    """The table of rules as one boolean expression over the measures."""
    keep = F.lit(True)
    for r in rules:
        if r.low is not None:
            keep = keep & (of(r.measure) >= F.lit(r.low))
        if r.high is not None:
            keep = keep & (of(r.measure) <= F.lit(r.high))
    return keep


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass. The filter is one expression that works
    out the measures of a text once."""
    counts = F.struct(*[v.alias(k) for k, v in _text_measures(F.coalesce(F.col(text), F.lit(""))).items()])

    def passes(m: Column) -> Column:
        ratios = _ratios(lambda k: m[k])
        return ~base_failed(ratios.__getitem__) & verdict(rules, ratios.__getitem__)

    return docs.where(let(counts, passes))
