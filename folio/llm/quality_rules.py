"""Quality rules, line first, in DataFrame functions only.

Base figures describe the whole text. The verdict cleans by line: a line with a
word fails if no sentence ends in it (punctuation), if it looks like navigation
(three separators or more), holds a stock phrase in whatever case (boilerplate), is
symbol noise, or is shouted (exclamation marks, or capitals without any small
letter). A line that goes on after a finished sentence passes the punctuation rule,
since paragraphs are also cut short; a heading or menu entry has none. Lines
without a word stay. Failed lines are removed; a document that loses more than half
of its characters (newlines aside), or whose base figures fail, is rejected.

Everything is computed inside the row, without a shuffle: repeated three-word
windows are found by sorting the hashes of a document's own windows (64 bits;
two different windows of one document collide with odds of about n^2 / 2^65).

Edge cases: a null or empty text has no words and fails the base rule; rows
repeating a doc_id are judged each; a null doc_id is carried; other columns stay
in ``clean_lines``, save that its own three replace columns of their names, and are
ignored by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, word pattern and symbols of the base figures.
SPACE = " \t\n\u000b\f\r"
BREAKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rules of a line; percentages are of its word characters or words.
MAX_LINE_SYMBOL_PERCENT = 10
MAX_LINE_LOSS_PERCENT = 50
#: A sentence ends: a mark, closing quotes or brackets, then a blank or the line's end.
SENTENCE_END = "[…。！？]|[.!?][\\x22\\x27”’»)\\]]*(?:[\\x20\\x09-\\x0D]|\\z)"
WORD = "[^\\x20\\x09-\\x0D]"
NAVIGATION = "[|»•›][^|»•›]*[|»•›][^|»•›]*[|»•›]"
#: Stock phrases, found in any case of their letters.
PHRASES = (
    "cookie policy", "cookie settings", "use cookies", "privacy policy", "terms of use", "terms of service",
    "rights reserved", "click here", "enable javascript", "skip to content", "lorem ipsum",
)
BOILERPLATE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in phrase) for phrase in PHRASES)
#: Up to this many repeated windows are looked up one by one.
FEW = 32


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, ""))


def window_hashes(words: Column) -> Column:
    """Hash of every three-word window. ``words`` must be a plain column."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )


def repeated_hashes(ordered: Column) -> Column:
    """Distinct values that a sorted array holds twice or more."""
    return F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1)))


def looked_up(hashes: Column, repeated: Column) -> Column:
    """Places of the windows whose hash is among the repeated ones."""
    return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull())


def by_place(hashes: Column) -> Column:
    """Windows as (hash, place), sorted: equal hashes stand side by side."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def neighbours(ordered: Column) -> Column:
    """Places of the windows with an equal neighbour in sorted order."""
    same = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def covered(places: Column) -> Column:
    """Words covered by three-word windows at ascending places: three each, less
    what the window before has covered."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def line_fails(line: Column) -> Column:
    """Whether a line has no sentence, or is navigation, boilerplate, symbol noise
    or shouting."""
    unfinished = ~line.rlike(SENTENCE_END) & line.rlike(WORD)
    navigation = line.rlike(NAVIGATION)
    boilerplate = line.rlike(BOILERPLATE)
    symbols = F.length(line) - F.length(F.regexp_replace(line, f"[{SYMBOLS}]+", ""))
    noise = line.rlike(f"[{SYMBOLS}]") & (symbols * 100 > MAX_LINE_SYMBOL_PERCENT * F.length(line))
    marks = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    shouting = (marks * 100 > MAX_LINE_SYMBOL_PERCENT * F.length(line)) | (line.rlike("[A-Z]{4}") & ~line.rlike("[a-z]"))
    return unfinished | navigation | boilerplate | noise | shouting


def clean_lines(documents: DataFrame) -> DataFrame:
    """``documents`` plus kept_text, all_chars and lost_chars (characters of all
    lines and of the failed ones, without the newlines)."""
    added = ("kept_text", "all_chars", "lost_chars")
    others = [c for c in documents.columns if c.lower() not in added]
    own = F.struct(*[F.col(f"`{c}`") for c in others])
    text = F.coalesce(F.col("text"), F.lit(""))
    # the caller's columns travel in a struct, so none can clash with these
    parts = documents.select(own.alias("row"), text.alias("text"), F.split(text, "\n", -1).alias("lines"))
    judged = parts.withColumn("failed", F.filter("lines", line_fails))
    size = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + F.length(x))
    return judged.select(
        *[F.col("row")[c].alias(c) for c in others],
        F.when(F.size("failed") == 0, F.col("text"))
        .otherwise(F.array_join(F.filter("lines", lambda x: ~line_fails(x)), "\n")).alias("kept_text"),
        size("lines").alias("all_chars"),
        size("failed").alias("lost_chars"),
    )


def quality_rules(documents: DataFrame) -> DataFrame:
    """Base figures and verdict per row of ``documents`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # each step is its own projection: an array is built once, then read
    split = clean_lines(documents.select("doc_id", "text")).select(
        "doc_id",
        F.array_remove(F.split(text, BREAKS, -1), "").alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).alias("n_symbols"),
        word_chars(text).alias("word_chars"),
        lines.alias("lines"),
        "all_chars",
        "lost_chars",
    )
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("hashes"),
        "all_chars",
        "lost_chars",
    )
    found = hashed.withColumn("sorted", F.sort_array("hashes")).withColumn("repeated", repeated_hashes(F.col("sorted"))).drop("sorted")
    placed = found.withColumn("ordered", F.when(F.size("repeated") > FEW, by_place(F.col("hashes")))).withColumn(
        "places",
        F.when(F.size("repeated") == 0, F.array().cast("array<int>"))
        .when(F.size("repeated") <= FEW, looked_up(F.col("hashes"), F.col("repeated")))
        .otherwise(neighbours(F.col("ordered"))),
    )
    figures = placed.withColumn("n_repeat_words", covered(F.col("places")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return figures.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LINE_LOSS_PERCENT * F.col("all_chars"))).alias("kept"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bare = lambda c: f"length(translate({c}, {space}, ''))"
    less = lambda c, s: f"(length({c}) - length(translate({c}, '{s}', '')))"
    sym = "(length(line) - length(regexp_replace(line, '[#*$%&|<>]+', '', 'g')))"
    fails = (
        f"((NOT regexp_matches(line, '{SENTENCE_END}') AND regexp_matches(line, '{WORD}'))"
        f" OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}')"
        f" OR {sym} * 100 > {MAX_LINE_SYMBOL_PERCENT} * length(line)"
        f" OR (length(line) - length(replace(line, '!', ''))) * 100 > {MAX_LINE_SYMBOL_PERCENT} * length(line)"
        f" OR (regexp_matches(line, '[A-Z]{{4}}') AND NOT regexp_matches(line, '[a-z]')))"
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)
), n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM (
    SELECT r, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY r ORDER BY i))
  WHERE c IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM win WHERE k > 1) GROUP BY r
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), ln AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), lost AS (
  SELECT r, sum(length(line)) AS total, coalesce(sum(CASE WHEN {fails} THEN length(line) END), 0) AS lost FROM l GROUP BY r
), f AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST({bare('text')} AS BIGINT) AS word_chars,
         CAST({less('text', SYMBOLS)} AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
  FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * lost <= {MAX_LINE_LOSS_PERCENT} * total AS kept
FROM f
"""
