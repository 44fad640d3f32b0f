"""Quality rules: a threshold table compiled into one native Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, put_back, set_aside

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Common function words of the corpus languages (en, de, fr, es), without punctuation.
STOP_WORDS = (
    "the of and to in is a that for it was on are as with be by this from at or an",
    "der die und das den von zu mit sich des auf ist im dem ein eine als auch für nicht",
    "de la le les et des en un une du est que pour dans au par avec elle sur il",
    "que y el los del se las por con para su una no lo es como más al",
)
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A document passes while numerator / denominator lies within [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The method's thresholds, applied after the base rules.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("shouting", "n_upper", "word_chars", high=0.5),
    Rule("exclaims", "n_exclaims", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def stop_words() -> list[str]:
    return sorted({w for line in STOP_WORDS for w in line.split()})


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice in ``words``.

    Windows are known by 64-bit hashes; a text whose hashes all differ has no repeat.  In
    others, O(n log n) in the row, hashes are sorted with their places, equal neighbours
    are the repeats, and their places in order give the words covered once each.
    """

    def covered_by(g: Column) -> Column:
        at = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))
        repeated = _let(
            F.sort_array(at),
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        F.get(s, j - 1)["g"].eqNullSafe(x["g"]) | F.get(s, j + 1)["g"].eqNullSafe(x["g"]), x["p"]
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        return _let(
            F.sort_array(repeated),
            lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
                F.aggregate(
                    F.transform(F.slice(p, 2, F.size(p)), lambda x, k: F.least(F.lit(3), x - F.get(p, k))),
                    F.lit(3),
                    lambda a, b: a + b,
                )
            ),
        )

    def within(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        found = _let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered_by(g)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(found)

    return _let(words, within)


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The columns that rules name, each a long."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(F.translate(s, SPACE, "")) > 0)
    dense = F.translate(text, SPACE, "")
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(dense),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": _let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))),
        "n_upper": F.length(dense) - F.length(F.regexp_replace(dense, "[A-Z]+", "")),
        "n_exclaims": F.length(text) - F.length(F.translate(text, "!", "")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words()))),
        "n_repeat_words": _repeat_words(words),
    }
    return {k: v.cast("long") for k, v in out.items()}


def quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds each measure, ``failed_rules``, ``base_failed`` and ``kept`` to every row of ``df``.

    One projection over the scan: no shuffle, no Python, rows stay where they are.
    A null or empty text has no words, so it fails the base rules.  Repeated rows are
    judged each on its own, and what equals a threshold passes; texts are judged whole; an empty table gives an empty result.  Columns of ``df`` that
    bear a measure's name are replaced.
    """
    df, own = set_aside(df)
    text_col = own.get(text_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    found = measures(text, F.col("__words"))
    counted = df.withColumn("__words", words).withColumns(found).drop("__words")
    checks = []
    for rule in rules:
        top, below = F.col(rule.numerator), F.col(rule.denominator)
        if rule.low is not None:
            checks.append(F.when(top < F.lit(rule.low) * below, F.lit(rule.name)))
        if rule.high is not None:
            checks.append(F.when(top > F.lit(rule.high) * below, F.lit(rule.name)))
    failed = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    base = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = counted.withColumn("failed_rules", failed).withColumn("base_failed", base)
    return put_back(judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)), own)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same measures and verdict as DuckDB SQL over ``documents``."""
    stops = ", ".join(f"'{w}'" for w in stop_words())
    bad = []
    for r in rules:
        if r.low is not None:
            bad.append(f"{r.numerator} < {r.low}::DOUBLE * {r.denominator}")
        if r.high is not None:
            bad.append(f"{r.numerator} > {r.high}::DOUBLE * {r.denominator}")
    verdict = " OR ".join(bad) or "false"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
      FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS x(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_kinds,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
    len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims,
    len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.rid = d.rid),
v AS (SELECT *, n_lines - n_kinds AS n_dup_lines FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words OR {verdict}) AS kept
FROM v"""
