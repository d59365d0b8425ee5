"""Quality rules, line first.

Every line is judged on its own: punctuation, navigation and boilerplate.  Lines
that fail are removed, then a document goes if too much of its text went with
them, or if it fails the base rules (too short, too repetitive).

Everything is a column expression over one row, so there is no shuffle and a
document is never split over tasks.  The work is linear in the text, but for
sorting the word windows of a document that repeats one.

Defined results: NULL and empty texts have no words and fail the base rules.
Lines without a word are neither judged nor counted.  Repeated rows are judged
alike, each on its own.  Other columns pass through, whatever their names; only
a column named like the result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE_CLASS, filled, words

# The symbols that the base counts and that the punctuation rule looks at.
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
SEPARATORS = "|»›•·→"
NAVIGATION = r"^\W*(home|menu|search|about( us)?|contact( us)?|log ?in|log ?out|sign ?in|sign ?up|register|next( page)?|previous( page)?|back to top|skip to (main )?content|read more|share|tweet|print|comments?|sitemap|site map|faq)\W*$"
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|terms and conditions|privacy policy|cookie (policy|settings|notice)"
    r"|(uses?|accept) (all )?cookies|javascript (is )?(disabled|required)|enable javascript|lorem ipsum"
    r"|subscribe to (our|the) newsletter|sign up for|click here|powered by|back to top|follow us on|share this"
)
# Of those, the ones that prose holds too.
EVERYDAY = r"privacy policy|sign up for|click here|powered by|follow us on|share this"
GAP = "\x01"  # stands where such a phrase was

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Limits; shares are of a line's or document's characters outside white space."""

    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    min_line_marks: int = 4
    max_symbol_percent: int = 15
    max_mark_percent: int = 10
    max_separator_percent: int = 6
    boilerplate_chars: int = 160
    max_lost_percent: int = 30


def count_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def line_measures(line: Column) -> Column:
    """A line with what its rules look at."""
    return F.struct(
        line.alias("line"),
        F.length(F.regexp_replace(line, SPACE_CLASS + "+", "")).alias("size"),
        count_of(line, SYMBOLS).alias("symbols"),
        count_of(line, MARKS).alias("marks"),
        count_of(line, SEPARATORS).alias("separators"),
    )


def line_fails(m: Column, rules: Rules = Rules()) -> Column:
    """Does a measured line fail the punctuation, navigation or boilerplate rule?  Lines without a word do not.

    Everyday phrases, which prose holds too, fail a line only where they make up half of it or more.
    """

    def heavy(n: Column, percent: int) -> Column:
        return (n >= rules.min_line_marks) & (n * 100 > m["size"] * percent)

    short = F.length(m["line"]) <= rules.boilerplate_chars
    rest = F.regexp_replace(F.lower(m["line"]), EVERYDAY, GAP)
    own = F.length(F.regexp_replace(rest, f"[{GAP}" + SPACE_CLASS[1:] + "+", ""))
    all_phrases = NAVIGATION + "|" + BOILERPLATE
    phrases = F.lower(m["line"]).rlike(all_phrases) & (rest.rlike(all_phrases) | (own * 2 <= m["size"]))
    return (m["size"] > 0) & (
        heavy(m["symbols"], rules.max_symbol_percent)
        | heavy(m["marks"], rules.max_mark_percent)
        | heavy(m["separators"], rules.max_separator_percent)
        | (short & phrases)
    )


def evaluate(docs: DataFrame, text_col: str = "text", into: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """Add a struct of counts and verdicts, with the text that is left in ``clean_text``."""
    w = rules.window
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != into]).alias("d"), filled(docs[text_col]).alias("t"))
    split = base.select(
        "d", "t", words(F.col("t")).alias("w"), F.transform(F.split("t", "\n"), line_measures).alias("measured")
    )
    hashed = _with_window_hashes(split.withColumn("n_words", F.size("w")), "w", w)
    # What a lambda needs of a line is in its struct: a column named inside it could be computed anew for every line.
    judged = hashed.select(
        "d", "t", "n_words", F.col("w").alias("windows"),
        F.transform("measured", lambda m: F.struct(m["line"], m["size"], m["symbols"], line_fails(m, rules).alias("bad"))).alias("lines"),
    )
    # Only windows of documents that repeat one are sorted.
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).otherwise(F.array().cast("array<bigint>"))
    placed = judged.select(
        "d", "t", "n_words", "lines",
        F.transform(F.filter("lines", lambda m: m["size"] > 0), lambda m: m["line"]).alias("full"),
        F.filter("lines", lambda m: ~m["bad"]).alias("left"),
        F.sort_array(F.transform(repeated, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("placed"),
    )
    at = placed.select(*[c for c in placed.columns if c != "placed"], _repeat_starts("placed").alias("starts"))
    left = at.select(
        "d", "n_words",
        (F.size("full") - F.size(F.array_distinct("full"))).alias("n_dup_lines"),
        _covered("starts", w).alias("n_repeat_words"),
        _total("lines", "size").alias("word_chars"),
        _total("lines", "symbols").alias("n_symbols"),
        _total("left", "size").alias("left_chars"),
        (F.size("lines") - F.size("left")).alias("n_failed_lines"),
        F.when(F.size("lines") == F.size("left"), F.col("t"))
        .otherwise(F.array_join(F.transform("left", lambda m: m["line"]), "\n"))
        .alias("clean_text"),
    )
    base_failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    lost_much = (F.col("word_chars") - F.col("left_chars")) * 100 > F.col("word_chars") * rules.max_lost_percent
    verdict = F.struct(
        *[F.col(c).cast("bigint").alias(c) for c in (*BASE, "n_failed_lines", "left_chars")],
        base_failed.alias("base_failed"),
        (~(base_failed | lost_much)).alias("kept"),
        "clean_text",
    )
    return left.select("d.*", verdict.alias(into))


def _neighbours(array: str | Column, merge, apart: int = 1) -> Column:
    """``merge(a, b)`` over every two elements that stand ``apart`` in an array."""
    n = F.greatest(F.size(array) - apart, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(1 + apart), n), merge)


def _with_window_hashes(df: DataFrame, words_col: str, width: int) -> DataFrame:
    """Replace a column of words by hashes of every window of ``width`` words, made of those of half the width.

    Each doubling is a projection of its own, so that no array is computed twice.
    """
    if width & (width - 1):
        raise ValueError("the window must be a power of two")
    out, span = df.withColumn(words_col, F.transform(words_col, lambda x: F.xxhash64(x))), 1
    while span < width:
        out, span = out.withColumn(words_col, _neighbours(words_col, lambda a, b: F.xxhash64(a, b), span)), 2 * span
    return out


def _total(measures: str, field: str) -> Column:
    return F.aggregate(measures, F.lit(0), lambda s, m: s + m[field])


def _repeat_starts(placed: str) -> Column:
    """Ascending starts of the windows that occur twice or more, from (hash, start) in order."""
    pairs = _neighbours(placed, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _covered(starts: str, width: int) -> Column:
    """Number of positions in windows of ``width`` at the ascending ``starts``."""
    steps = _neighbours(starts, lambda a, b: F.least(b - a, F.lit(width)))
    return F.when(F.size(starts) > 0, F.aggregate(steps, F.lit(width), lambda s, x: s + x)).otherwise(0)


def keep_clean(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(), observed: str = "quality rules") -> DataFrame:
    """Documents that pass, without the lines that fail.  An unchanged text stays as it was.

    The run reports, under the name ``observed``, how many were judged and how many
    pass.  What is observed also keeps the filter above the projections that it is
    made of; below them each would be written out as often as the next one uses it.
    """
    judged = evaluate(docs, text_col, "_quality", rules)
    own = [F.col("_quality.clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    marked = judged.select(F.struct(*own).alias("d"), F.col("_quality.kept").alias("kept"))
    seen = marked.observe(observed, F.count("kept").alias("judged"), F.count_if("kept").alias("kept"))
    return seen.where("kept").select("d.*")


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    judged = evaluate(docs.select("doc_id", "text"), "text", "q")
    return judged.select("doc_id", *[F.col(f"q.{c}") for c in (*BASE, "base_failed", "kept")])


def _sql() -> str:
    rules = Rules()
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def heavy(chars: str, percent: int) -> str:
        n = f"(length(l) - length(translate(l, '{chars}', '')))"
        return f"({n} >= {rules.min_line_marks} AND {n} * 100 > length(translate(l, {space}, '')) * {percent})"

    phrases = (NAVIGATION + "|" + BOILERPLATE).replace("'", "''")
    rest = f"regexp_replace(lower(l), '{EVERYDAY}', chr(1), 'g')"
    own = f"length(translate({rest}, {space} || chr(1), ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
pos AS (SELECT r, w, unnest(range(1, len(w) - {rules.window - 2})) AS i FROM w),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(list_slice(w, i, i + {rules.window - 1}), ' ')) AS n FROM pos),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {rules.window})) AS p FROM win WHERE n > 1) GROUP BY r),
line AS (SELECT r, unnest(lines) AS l FROM w),
bad AS (SELECT r, sum(length(translate(l, {space}, ''))) AS chars, count(*) AS n, count(DISTINCT l) AS nd,
  sum(CASE WHEN {heavy(SYMBOLS, rules.max_symbol_percent)} OR {heavy(MARKS, rules.max_mark_percent)}
    OR {heavy(SEPARATORS, rules.max_separator_percent)}
    OR (length(l) <= {rules.boilerplate_chars} AND regexp_matches(lower(l), '{phrases}')
      AND (regexp_matches({rest}, '{phrases}') OR {own} * 2 <= length(translate(l, {space}, ''))))
    THEN length(translate(l, {space}, '')) ELSE 0 END) AS lost
  FROM line WHERE length(translate(l, {space}, '')) > 0 GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(bad.n - bad.nd, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost
  FROM w LEFT JOIN hit USING (r) LEFT JOIN bad USING (r))
SELECT doc_id, {", ".join(BASE)},
  n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words
    OR lost * 100 > word_chars * {rules.max_lost_percent}) AS kept
FROM s"""


SQL = _sql()
