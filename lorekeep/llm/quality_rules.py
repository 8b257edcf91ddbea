"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a boolean column over whole texts. ``plan_cascade`` measures, on a sample of whole texts from all parts of
the table, what each rule costs and what share of documents it rejects, and orders the rules by rejection per cost;
``cascade`` then nests them in one CASE, so that a document is tested until the first rule that rejects it and costly
rules see few documents. The order changes cost only: which documents are rejected does not depend on it. Drawing the
sample reads the table once more; that is its whole cost, since only the sample's rows go further.

The report needs every document's measures, so that its cascade has them for nothing, and spares only what is left.

Defined results: a null text has no words and fails the base rules like an empty one; a text of any length is read
whole; repeated rows are judged alike; an empty table gives an empty table; the filter passes extra columns through,
whatever their names; the report has its own columns only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Fixed values of the contract: word separators, symbol characters, base thresholds.
SEPARATORS = "\t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

#: Thresholds of the method's own rules (parameters of ``Rules``).
MAX_SYMBOLS_PER_WORD = 0.2
MAX_DUP_LINE_SHARE = 0.5
MIN_MEAN_WORD = 1.5
MAX_MEAN_WORD = 25.0
MAX_SHOUT_SHARE = 0.5
SAMPLE_ROWS = 400


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\x09-\\x0D; none for null."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(flat, " "), "")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def grams(w: Column) -> Column:
    """A 64-bit hash for each window of three words."""
    return F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, wherever the optimizer moves the expression. A mere column
    would be put in place of its name when a filter on the result moves below its projection, in lambdas for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(p: Column) -> Column:
    """Words that windows at the sorted positions ``p`` cover: three each less what the next one covers."""
    steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated(s: Column, key: str) -> Column:
    """Positions (``i``) of the sorted array's elements whose key a neighbour has too, in order."""
    at = lambda j: F.get(s, j)[key]
    # get() is null outside the array, and null | true is true, null | false is not kept
    return F.sort_array(F.transform(F.filter(s, lambda e, j: (at(j + 1) == e[key]) | (at(j - 1) == e[key])), lambda e: e["i"]))


def n_repeat_words(g: Column, w: Column) -> Column:
    """Words in windows that occur twice or more, counted once each; ``g`` is the array of window hashes, ``w`` the words.

    Sorted by hash, equal windows are neighbours. Where neighbours of equal hash differ in a word, hashes have collided,
    and the text's windows are sorted by their words.
    """
    word = lambda i, k: F.get(w, i + k)

    def collided(s: Column) -> Column:
        def differs(e: Column, j: Column) -> Column:
            other = F.get(s, j + 1)
            words = [word(e["i"], k) != word(other["i"], k) for k in range(WINDOW)]
            return (other["g"] == e["g"]) & (words[0] | words[1] | words[2])

        return F.size(F.filter(s, differs)) > 0

    def by_words() -> Column:
        rows = F.transform(g, lambda x, i: F.struct(F.struct(*(word(i, k).alias(f"w{k}") for k in range(WINDOW))).alias("k"), i.alias("i")))
        return let(F.sort_array(rows), lambda s: let(repeated(s, "k"), covered))

    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    found = let(pairs, lambda s: F.when(collided(s), by_words()).otherwise(let(repeated(s, "g"), covered)))
    return F.when(F.size(F.array_distinct(g)) < F.size(g), found).otherwise(F.lit(0).cast("long"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


class Facts:
    """What a rule may ask of a text. ``known`` has what is computed already; all else is computed where it is asked."""

    def __init__(self, text: Column, words: Column, known: dict[str, Column] | None = None):
        self.text, self.words, self.known = text, words, known or {}

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text, self.words)


def line_counts(text: Column) -> Column:
    return let(worded_lines(text), lambda x: F.struct(n_dup_lines(x).alias("n_dup"), F.size(x).cast("long").alias("n")))


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda text, w: n_symbols(text),
    "lines": lambda text, w: line_counts(text),
    "n_repeat_words": lambda text, w: let(grams(w), lambda g: n_repeat_words(g, w)),
}


def measure_of(name: str, text: Column) -> Callable[[Column], Column]:
    return lambda w: MEASURES[name](text, w)


@dataclass
class Rule:
    """``rejects`` takes the facts of a text."""

    name: str
    rejects: Callable[[Facts], Column]


def per_word(x: Column, n_words: Column) -> Column:
    return x / F.greatest(n_words, F.lit(1))


def shout_share(w: Column) -> Column:
    """Share of words with two or more A-Z letters and no a-z letter."""
    return per_word(F.size(F.filter(w, lambda x: x.rlike("^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"))), F.size(w))


def odd_length(mean: Column) -> Column:
    return (mean < MIN_MEAN_WORD) | (mean > MAX_MEAN_WORD)


#: The method's rules beside the base ones. None divides by zero; none rejects for language alone.
OWN_RULES = [
    Rule("symbols", lambda f: per_word(f["n_symbols"], f["n_words"]) > MAX_SYMBOLS_PER_WORD),
    Rule("word_length", lambda f: let(per_word(f["word_chars"], f["n_words"]), odd_length)),
    Rule("shouting", lambda f: shout_share(f.words) > MAX_SHOUT_SHARE),
    Rule("dup_lines", lambda f: let(f["lines"], lambda x: x["n_dup"] > MAX_DUP_LINE_SHARE * x["n"])),
]
BASE_RULES = [
    Rule("few_words", lambda f: f["n_words"] < MIN_WORDS),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]),
]


def plan_cascade(docs: DataFrame, text: str, rules: list[Rule], rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Rule]:
    """Order rules by rejected share per second on about ``rows`` whole texts, drawn alike from all parts of the table.
    The measures in ``known`` are there already when the cascade runs, and cost nothing."""
    n = docs.count()
    sample = docs.select(F.col(text).alias("text"))
    sample = sample.sample(False, rows / n, 7) if n > rows else sample
    w = words(F.col("text"))
    sample = sample.repartition(4).select("text", w.alias("w"), *(let(w, measure_of(m, F.col("text"))).alias(m) for m in known)).persist()
    try:
        total = sample.count()
        if not total:
            return list(rules)
        facts, gain = Facts(F.col("text"), F.col("w"), {m: F.col(m) for m in known}), {}
        for rule in rules:
            began = time.perf_counter()
            hit = sample.agg(F.sum(rule.rejects(facts).cast("int"))).first()[0] or 0
            gain[rule.name] = (hit / total) / max(time.perf_counter() - began, 1e-4)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(rules: list[Rule], text: Column, w: Column, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out, facts = F.lit(None).cast("string"), Facts(text, w, known)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(facts), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", out: str = "rejected_by", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``out``: the rule that rejects the document, null for documents that stay."""
    ordered = plan_cascade(docs, text, [*BASE_RULES, *OWN_RULES], sample_rows)
    return docs.withColumn(out, let(words(docs[text]), lambda w: cascade(ordered, docs[text], w)))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that no rule rejects, with their columns unchanged."""
    why = fresh(docs, "__rejected_by")
    return judge(docs, text, why).where(F.col(why).isNull()).drop(why)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures and the verdict of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = tuple(MEASURES)
    ordered = plan_cascade(rows, "text", OWN_RULES, known=names)
    t = F.col("text")

    def verdict(w: Column) -> Column:
        measured = F.struct(*(MEASURES[m](t, w).alias(m) for m in names))
        return let(measured, lambda m: F.struct(m.alias("m"), cascade(ordered, t, w, {name: m[name] for name in names}).isNull().alias("passed")))

    m = rows.select("doc_id", let(words(t), verdict).alias("v"))
    m = m.select("doc_id", *(F.col(f"v.m.{name}").alias(name) for name in names if name != "lines"), F.col("v.m.lines.n_dup").alias("n_dup_lines"), F.col("v.passed").alias("passed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("passed")).alias("kept"),
    )
