"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results: a null text has no words; a document without words fails the base rules; ratios of a text
without words or lines are 0. Whole texts are read. Columns of the input other than ``doc_id`` and ``text``
are neither read nor returned by :func:`quality_report`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish, compared in lower case.
STOP_WORDS = tuple(
    "the of and to in a is that it for on was with as by be are this an or at from not have but which "
    "der die und das zu den mit von ist des auf für im ein eine nicht sich dem "
    "le la les de et en un une du que est pour qui dans par au sur el los las del se por con una su para como al lo y".split()
)


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: a document passes if low <= feature <= high (a missing bound holds).

    ``min_words``: the rule is applied to documents of at least so many words; ratios of a few words say little.
    """

    name: str
    feature: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Bounds chosen so that prose stays: they cut texts full of symbols, shouted, or of a few repeated lines.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0, 20),
    Rule("symbol_ratio", "symbol_ratio", high=0.10),
    Rule("stop_word_ratio", "stop_word_ratio", low=0.05, min_words=50),
    Rule("dup_line_ratio", "dup_line_ratio", high=0.50, min_words=50),
)


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("long")


def counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The column ``key`` and the counts the features are made of, by whole text."""
    none = F.array().cast("array<string>")
    split = docs.select(
        key,
        F.coalesce(F.array_remove(F.split(F.col("text"), SPACES), ""), none).alias("words"),
        F.coalesce(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), none).alias("lines"),
        F.coalesce(_count(SYMBOL), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.char_length("text") - _count(r"[\x20\x09-\x0D]"), F.lit(0)).cast("long").alias("word_chars"),
    )
    n = F.size("words")
    word = lambda i, k: F.get("words", i + k)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        key,
        "words",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("windows"),
    )
    # Only texts in which a window's hash occurs again are sorted; equal windows become neighbours, whose starts are the repeats.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(again, F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    with_order = counted.select(*[c for c in counted.columns if c != "windows"], ordered.alias("o"))
    m = F.size("o")
    shifted = F.slice("o", F.lit(2), F.greatest(m - 1, F.lit(0)))
    same = lambda p: (p["a"]["w"] == p["b"]["w"]) & (word(p["a"]["i"], 0) == word(p["b"]["i"], 0)) & (word(p["a"]["i"], 1) == word(p["b"]["i"], 1)) & (word(p["a"]["i"], 2) == word(p["b"]["i"], 2))
    # Two neighbours of equal words give both their starts.
    starts = F.array_sort(
        F.array_distinct(
            F.flatten(F.transform(F.filter(F.arrays_zip(F.slice("o", F.lit(1), F.greatest(m - 1, F.lit(0))).alias("a"), shifted.alias("b")), same), lambda p: F.array(p["a"]["i"], p["b"]["i"])))
        )
    )
    spread = with_order.select(*[c for c in with_order.columns if c not in ("o", "words")], F.when(F.col("o").isNotNull(), starts).alias("s"))
    # Sorted starts s: each covers 3 words, less what the next start covers again.
    covered = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return spread.select(*[c for c in spread.columns if c != "s"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """The features that rules can name, over the columns of :func:`counts`."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_length": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_word_ratio": _ratio("n_stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
    }


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a document breaks, as one array expression."""
    have, tests = features(), []
    for r in rules:
        x = have[r.feature]
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (x < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (x > F.lit(float(r.high)))
        tests.append(F.when(broken & (F.col("n_words") >= r.min_words), F.lit(r.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the names of the broken rules."""
    c = counts(docs)
    return c.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), compiled(rules).alias("broken")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), F.array_join("broken", ",").alias("broken")
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows and columns of docs that pass; judged where they are read, without a join."""
    judged = counts(docs.select(F.struct(*docs.columns).alias("own_row"), "text"), "own_row")
    # A condition that isn't deterministic stays where it is; pushed down, it would repeat the splitting of texts in each of its terms.
    passes = ~base_failed() & (F.size(compiled(rules)) == 0) & (F.spark_partition_id() >= 0)
    return judged.select("own_row", passes.alias("passes")).where("passes").select("own_row.*")


def sql(rules: Sequence[Rule] = RULES, table: str = "documents") -> str:
    """The same report as DuckDB SQL."""
    return f"""
    with base as (
      select doc_id, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
      from {table}
    ), starts as (
      select doc_id, unnest(range(1, len(words) - 1)) as i, words from base where len(words) >= 3
    ), windows as (
      select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from starts
    ), again as (
      select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1
    ), covered as (
      select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) as t(k) group by doc_id
    ), counted as (
      select b.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) as bigint) as n_lines,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(len(list_filter(words, lambda w: lower(w) in ({", ".join("'" + w + "'" for w in STOP_WORDS)}))) as bigint) as n_stop_words,
        cast(coalesce(c.n, 0) as bigint) as n_repeat_words
      from base b left join covered c on b.doc_id = c.doc_id
    ), judged as (
      select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
        array_to_string(list_filter([{", ".join(_sql_rule(r) for r in rules)}], lambda x: x is not null), ',') as broken
      from counted
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and broken = '') as kept, broken
    from judged"""


def _sql_rule(r: Rule) -> str:
    top, bottom = {"mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_word_ratio": ("n_repeat_words", "n_words"), "n_words": ("n_words", "1")}[r.feature]
    x = f"(case when {bottom} > 0 then cast({top} as double) / {bottom} else 0.0 end)"
    tests = [f"{x} {sign} {float(bound)}" for sign, bound in (("<", r.low), (">", r.high)) if bound is not None]
    return f"case when ({' or '.join(tests) or 'false'}) and n_words >= {r.min_words} then '{r.name}' end"
