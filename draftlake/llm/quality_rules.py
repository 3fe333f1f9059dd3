"""Quality rules, line first: bad lines go, then documents that lost too much text.

Row-local column expressions only: no shuffle, no Python on executors. Defined results: a null or empty text has no
words and fails the base rules; repeated rows each get their own row; an empty table gives an empty result; extra
columns of the input are ignored by ``signals`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is navigation with this many separators, at one for so many words or fewer.
NAV_MARKS, NAV_WORDS_PER_MARK = 3, 4
#: Percent of a line's characters (white space aside) that may be symbols, and of its words that may end in "!!".
SYMBOL_PERCENT, SHOUT_PERCENT = 10, 30
#: A line of so many words without any of .,;:!? is not prose.
UNPUNCTUATED_WORDS = 12
#: A document stays if its remaining lines hold at least so many percent of its word characters.
KEEP_PERCENT = 50
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
    r"|licensed under the|subscribe to our|click here|sign up now)"
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hash, positions sorted rather than paired: n log n in the text's length.
    """
    n = WINDOW

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def starts(s: Column) -> Column:
        twin = F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))
        return F.array_sort(F.transform(twin, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - v, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        order = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(order, lambda s: let(starts(s), covered))).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= n, let(let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, boilerplate, symbols, shouting or unpunctuated filler."""
    dense = _without(line, SPACE)
    words = F.size(_words(line))
    marks = F.length(line) - _without(line, "|»›")
    symbols = F.length(line) - _without(line, SYMBOLS)
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    return (
        ((marks >= NAV_MARKS) & (marks * NAV_WORDS_PER_MARK >= words))
        | (symbols * 100 > dense * SYMBOL_PERCENT)
        | (shouts * 100 > words * SHOUT_PERCENT)
        | ((words >= UNPUNCTUATED_WORDS) & (F.length(line) == _without(line, ".,;:!?")))
        | line.rlike(BOILERPLATE)
    )


def _measured(docs: DataFrame, carried: Column) -> DataFrame:
    """row (what is carried) and the measures of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = F.col("t")
    lines = docs.select(carried.alias("row"), text.alias("t")).select("*", _words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("l"))
    return lines.select(
        "row",
        "l",
        F.size("w").cast("long").alias("n_words"),
        _without(t, SPACE).cast("long").alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.filter(F.col("l"), lambda x: ~line_fails(x)).alias("good"),
    )


def _judged(docs: DataFrame, carried: Column) -> DataFrame:
    m = _measured(docs, carried).withColumn("kept_chars", _without(F.array_join("good", "\n"), SPACE).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("word_chars") * KEEP_PERCENT))


def signals(docs: DataFrame) -> DataFrame:
    """One row a document: base measures, lines removed, verdict."""
    return _judged(docs, F.col("doc_id")).select(
        F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        (F.size("l") - F.size("good")).cast("long").alias("n_lines_removed"), "kept_chars",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns, ``text`` without its removed lines."""
    j = _judged(docs, F.struct("*")).where("kept")
    return j.select(*[(F.array_join("good", "\n") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(table(spark, sf_dir, "documents"))


#: Patterns are joined into DuckDB SQL below; RE2 reads them as Java does.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t,
  list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM dup) GROUP BY r),
ln AS (SELECT r, x, length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS dense,
  len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS n,
  length(x) - length(translate(x, '|»›', '')) AS marks, length(x) - length(translate(x, '{SYMBOLS}', '')) AS syms,
  length(x) - length(replace(x, '!!', '!')) AS shouts, length(x) = length(translate(x, '.,;:!?', '')) AS bare,
  regexp_matches(x, '{BOILERPLATE}') AS boiler
  FROM (SELECT r, unnest(l) AS x FROM w)),
good AS (SELECT r, sum(CASE WHEN bad THEN 0 ELSE dense END) AS kept_chars, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS removed FROM
  (SELECT *, (marks >= {NAV_MARKS} AND marks * {NAV_WORDS_PER_MARK} >= n) OR syms * 100 > dense * {SYMBOL_PERCENT}
    OR shouts * 100 > n * {SHOUT_PERCENT} OR (n >= {UNPUNCTUATED_WORDS} AND bare) OR boiler AS bad FROM ln) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(good.removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(good.kept_chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN good USING (r))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND kept_chars * 100 >= word_chars * {KEEP_PERCENT} AS kept FROM m
"""
