"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean Column over a text and its words that is true for a text to reject.  A rule
makes what it needs itself, so its cost is its own: cost and rejection of every rule are measured on
a sample, and the rules then form one CASE expression in order of rejection per cost.  A text that
an early, cheap rule rejects never has the windows, lines or letters of the later rules made.  The
order changes the work, not the verdict: a text is rejected if any rule is true.

Words are runs of `[^\\x20\\x09-\\x0D]+`.  Defined results: a null or empty text has no words and fails the
base rules; repeated rows and ties are judged each on its own; ids may be null; columns beyond those
named are kept by `apply_rules` and not read by `features`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample on which costs and rejections are measured, the longest text in it, and how
#: often each row is judged for a measurement, of which the best of TRIES counts.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 20
REPEATS, TRIES = 4, 2

#: Fewer words than this, or more than half of the words in repeated 3-word windows: base rule.
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Thresholds of the method's own rules.
SYMBOLS_PER_100_WORDS = 25
DUP_LINES_PERCENT = 50
MIN_WORD_CHARS = 2.0
MAX_WORD_CHARS = 14.0
UPPER_PERCENT = 60
LETTER_WORDS_PERCENT = 60

_SPACES = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject: true (not null) where the text is to go, over _text, _w (its words) and n_words."""

    name: str
    reject: Column


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, as the one element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_chars() -> Column:
    return F.length(F.translate("_text", " " + _SPACES, "")).cast("long")


def n_symbols() -> Column:
    return (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long")


def n_dup_lines() -> Column:
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words() -> Column:
    """Words inside 3-word windows that come twice: windows are hashed, and sorted only if two are equal."""
    windows = F.expr("transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))")

    def covered(s: Column) -> Column:  # (hash, place) in order: equal windows are neighbours
        at = F.array_compact(F.transform(s, lambda e, j: F.when((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"])))
        return let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))).cast("long"))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, covered)).otherwise(F.lit(0).cast("long"))

    return F.when(F.col("n_words") >= 3, let(windows, count)).otherwise(F.lit(0).cast("long"))


def prepared(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, _text, _w (words) and n_words."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    return df.withColumn("_w", words(F.col("_text"))).withColumn("n_words", F.size("_w").cast("long"))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, _text, _w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    more = {f.__name__: f() for f in (word_chars, n_symbols, n_dup_lines, n_repeat_words)}
    return prepared(docs, *keep).withColumns(more)


def base_failed() -> Column:
    """Over the columns of features()."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def default_rules(made: bool = False) -> list[Rule]:
    """The rules, the two base ones first; made: features() are columns already and are not made again."""
    n = F.col("n_words")

    def of(f: Callable[[], Column]) -> Column:
        return F.col(f.__name__) if made else f()

    def letters(counts: Callable[[Column, Column], Column]) -> Column:
        return counts(F.length(F.regexp_replace("_text", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("_text", r"[^\p{L}]", "")))

    letter_words = F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}")))
    lines = F.size(F.split(F.col("_text"), "\n"))
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("repeated_words", 100 * of(n_repeat_words) > REPEAT_PERCENT * n),
        Rule("symbols", 100 * of(n_symbols) > SYMBOLS_PER_100_WORDS * n),
        Rule("repeated_lines", 100 * of(n_dup_lines) > DUP_LINES_PERCENT * lines),
        Rule("word_length", let(of(word_chars), lambda c: (c < MIN_WORD_CHARS * n) | (c > MAX_WORD_CHARS * n))),
        Rule("capitals", letters(lambda upper, all_: 100 * upper > UPPER_PERCENT * all_)),
        Rule("letters", 100 * letter_words < LETTER_WORDS_PERCENT * n),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / self.seconds


def measure(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Each rule's seconds and share of rejected rows on a sample, best rejection per cost first.

    df: the columns that the rules read.  The sample is any sample_rows rows: it decides the order of
    rules alone, never a verdict.  take() reads as few partitions as it needs.
    """
    taken = df.where(F.octet_length("_text") <= SAMPLE_BYTES).take(sample_rows)
    sample = df.sparkSession.createDataFrame(taken, df.schema).coalesce(1).persist()
    try:
        rows = max(1, sample.count())
        again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def run(c: Column) -> tuple[float, float]:
            best, hits = float("inf"), 0
            for _ in range(TRIES):
                t = time.perf_counter()
                hits = again.agg(F.sum(F.when(c, 1).otherwise(0))).first()[0] or 0
                best = min(best, time.perf_counter() - t)
            return best, hits / (rows * REPEATS)

        idle = run(F.col("_text").isNull())[0]
        out = [Measured(r, max(1e-3, s - idle), share) for r in rules for s, share in [run(r.reject)]]
    finally:
        sample.unpersist()
    return sorted(out, key=lambda m: -m.rank)


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects; null if the text stays.  Later rules aren't evaluated."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        out = out.when(r.reject, F.lit(r.name))
    return out


def in_order(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, best rejection per measured cost first; every rule pays for what it makes of a text."""
    return [m.rule for m in measure(prepared(docs.select("text")), rules, sample_rows)]


def judge(docs: DataFrame, *keep: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """features() and kept: whether no rule rejects the text."""
    order = [r.name for r in in_order(docs, default_rules(), sample_rows)]
    made = {r.name: r for r in default_rules(made=True)}
    return features(docs, *keep).withColumn("kept", cascade([made[n] for n in order]).isNull())


def digest(docs: DataFrame) -> DataFrame:
    df = judge(docs, "doc_id")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")


def apply_rules(docs: DataFrame, *, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rejected rows, all columns as they were; no feature is made but those a text's rules come to.

    A filter on the verdict would be pushed down with the words inlined, and made again for every
    rule; unnesting one row or none stays above them.
    """
    order = in_order(docs, list(rules or default_rules()), sample_rows)
    packed = prepared(docs.select(F.struct(*docs.columns).alias("_row"), "text"), "_row")
    return packed.withColumn("_out", cascade(order)).select(F.inline(F.when(F.col("_out").isNull(), F.array("_row"))))
