"""Quality rules: line-first cleaning, with DataFrame functions only.

Every line of a document is judged by itself: a line fails as symbols (many of
``#*$%&|<>`` for its words), as shouting (many ``!!``, or few lower-case
letters), as navigation (items between bars without any sentence, or three and
more link-like lines in a row: few words, no digit, no closing punctuation), by
its punctuation (a short line that closes with none in a document whose lines
do close: captions, teasers, cut ends), or as boilerplate (a known short notice,
or the repeat of an earlier line). The rules on closing punctuation know no
language; any character of Unicode's class P closes. Long open lines stay: they
are paragraphs that lack a full stop. The lines that pass are the cleaned text. A document is rejected
if its whole text fails a base rule or cleaning takes too much of its text.

Everything happens within a row: no shuffle, no Python. The heavy part of the
repeat count runs only for rows in which some window does repeat.

Defined cases: a null text counts as empty; a text without words fails the base
rule; ties and repeated rows are each judged by themselves; texts may be of any
length; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, own_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
#: A line fails at so many symbols, bars or ``!!`` per hundred words.
SYMBOLS_PER_100 = 30
SHOUTS_PER_100 = 30
#: A line with such a run and at least so many letters fails if fewer than this share of them, in per cent, are lower-case.
CAPITALS = r"\p{Lu}{3}"
LEAST_LETTERS = 20
LEAST_LOWER = 30
#: A document is rejected if its cleaned lines hold less than so many per cent of its word characters.
LEAST_LEFT = 50
#: Short lines (up to so many words) that hold one of these fail.
BOILERPLATE_WORDS = 12
BOILERPLATE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "skip to content", "click here to", "sign up for our",
               "subscribe to our", "javascript is disabled", "enable javascript", "share this", "read more", "lorem ipsum")
#: A line closes with punctuation, white space aside.
CLOSED = r"\p{P}[\x20\x09-\x0D]*\z"
#: Link-like lines: up to so many words and characters; that many in a row fail.
LINK_WORDS = 3
LINK_CHARS = 40
LINKS_IN_A_ROW = 3
#: An open line of so many words fails if at least CLOSED_LINES lines of OPEN_WORDS[0] words and more close and there are
#: CLOSED_FOR_OPEN times as many of them as open ones.
OPEN_WORDS = (5, 20)
CLOSED_LINES = 5
CLOSED_FOR_OPEN = 4


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def n_of(text: Column, chars: str) -> Column:
    """How many of the characters stand in the text."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(h: Column) -> Column:
    """A hash for each window of words. 64 bits: within one text two differing windows practically never meet."""
    return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])), 1, F.greatest(F.size(h) - WINDOW + 1, F.lit(0)))


def repeated_words(v: Column) -> Column:
    """Words in windows that stand twice or more: windows are sorted by hash, those with an equal
    neighbour sorted by position, and each adds the words that the one before didn't cover."""
    by_hash = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(s):
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        kept = F.filter(F.transform(s, lambda x, j: F.when(same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))), x["i"])), lambda x: x.isNotNull())
        return F.array_sort(kept)

    # transform over an array of one holds an intermediate array as a lambda's variable
    held = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    heavy = held(by_hash, lambda s: held(positions(s), covered))
    return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(heavy)


def n_line_words(line: Column) -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(line, SPACE + "+", " ")), " "))


def open_fails(lines: Column) -> Column:
    """The lines (each with a word) that fail by what stands around them: link-like lines in a row, and short
    open lines among closed ones. Null if no line is open, so that most texts pay one search a line."""
    least, most = OPEN_WORDS
    long = rf"\A{SPACE}*([^\x20\x09-\x0D]+{SPACE}+){{{least - 1}}}[^\x20\x09-\x0D]"
    n_open = F.transform(lines, lambda x: F.when(x.rlike(CLOSED), F.lit(0)).otherwise(n_line_words(x)))  # words of an open line

    def failing(n: Column) -> Column:
        link = F.transform(n, lambda k, i: k.between(1, LINK_WORDS) & (F.length(F.get(lines, i)) <= LINK_CHARS) & ~F.get(lines, i).rlike(r"\p{Nd}"))
        at = lambda a, i: F.when(i >= 0, F.get(a, F.greatest(i, F.lit(0)))).otherwise(F.lit(False))
        run = lambda a, i, first: all_of([F.coalesce(at(a, i + k), F.lit(False)) for k in range(first, first + LINKS_IN_A_ROW)])
        n_long = F.size(F.filter(n, lambda k: k >= least))
        n_closed = F.size(F.filter(lines, lambda x: x.rlike(CLOSED) & x.rlike(long)))
        among = F.when(F.exists(n, lambda k: k.between(least, most)), (n_closed >= CLOSED_LINES) & (n_closed >= CLOSED_FOR_OPEN * n_long)).otherwise(F.lit(False))

        def chosen(a: Column) -> Column:  # struct of both, worked out once
            in_a_row = lambda i: any_of([run(a["link"], i, first) for first in range(1 - LINKS_IN_A_ROW, 1)])
            return F.filter(lines, lambda x, i: in_a_row(i) | (a["among"] & F.get(n, i).between(least, most)))

        return F.get(F.transform(F.array(F.struct(link.alias("link"), among.alias("among"))), chosen), F.lit(0))

    return F.get(F.transform(F.array(n_open), lambda n: F.when(F.exists(n, lambda k: k > 0), failing(n))), F.lit(0))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def line_fails(line: Column, symbols: Column, shouts: Column, capitals: Column, notices: Column) -> Column:
    """Whether a line that has a word fails by itself. The other arguments say what its document has at
    all: a rule that can't apply to any line isn't worked out for each."""
    n_words = n_line_words(line)
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    lower = F.length(F.regexp_replace(line, r"[^\p{Ll}\p{Lo}]+", ""))
    return ((symbols & (100 * n_of(line, SYMBOLS) >= SYMBOLS_PER_100 * n_words))
            | (symbols & (n_of(line, "|") >= 2) & ~line.rlike(r"[.!?:;,。]"))
            | (shouts & line.contains("!!") & (100 * (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2 >= SHOUTS_PER_100 * n_words))
            | (capitals & line.rlike(CAPITALS) & (letters >= LEAST_LETTERS) & (100 * lower < LEAST_LOWER * letters))
            | (notices & has_notice(line) & (n_words <= BOILERPLATE_WORDS)))


def has_notice(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for b in BOILERPLATE:
        out = out | low.contains(b)
    return out


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "share_left", "cleaned", "kept")


def quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns of ``keep`` (doc_id by default) and those of ADDED, named with ``prefix``, for every
    row. Columns are worked out step by step, so that each array is made once."""
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    return judged(own).select("own.*", *[F.col(c).alias(prefix + c) for c in ADDED])


def judged(own: DataFrame) -> DataFrame:
    w = own.withColumn("w", words(F.col("t")))
    a = w.select(
        "own",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("t").contains("!!").alias("shouts"), F.col("t").rlike(CAPITALS).alias("capitals"), has_notice(F.col("t")).alias("notices"),
        F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        windows_of(F.col("w")).alias("v"),
    ).withColumn("once", F.array_distinct("lines")).withColumn("open", open_fails(F.col("lines")))
    symbols = F.col("n_symbols") > 0
    suspect = symbols | F.col("shouts") | F.col("capitals") | F.col("notices")
    b = a.select(
        "own", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size("once")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("v")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.when(suspect, F.filter("once", lambda x: ~line_fails(x, symbols, F.col("shouts"), F.col("capitals"), F.col("notices")))).otherwise(F.col("once")).alias("left"),
        "open",
    ).withColumn("left", F.when(F.size("open") > 0, F.array_except("left", "open")).otherwise(F.col("left"))).withColumn("cleaned", F.array_join("left", "\n"))
    left = F.when(F.size("left") == F.col("n_lines"), F.col("word_chars")).otherwise(F.length(F.regexp_replace("cleaned", SPACE + "+", "")))
    c = b.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    c = c.withColumn("share_left", F.when(F.col("word_chars") > 0, left / F.col("word_chars")).otherwise(F.lit(0.0)))
    return c.withColumn("kept", ~F.col("base_failed") & (F.col("share_left") * 100 >= LEAST_LEFT))


def windows_of(w: Column) -> Column:
    return F.get(F.transform(F.array(word_hashes(w)), windows), F.lit(0))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed and kept."""
    out = quality(own_columns(docs, "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB. ``pick`` is filled in with the columns wanted.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
v AS (SELECT r, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS v FROM w, unnest(range(1, len(w) - 3)) AS x(i) WHERE len(w) >= 5),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM v) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS y(k) GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k, row_number() OVER (PARTITION BY r ORDER BY i) AS p
      FROM (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT r, string_split(t, chr(10)) AS x FROM d))
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT r, line, k, p, NOT regexp_matches(line, '\pP[\x20\x09-\x0D]*\z') AS open, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
             length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS sym,
             (length(line) - length(replace(line, '!!', ''))) / 2 AS shout,
             length(line) - length(replace(line, '|', '')) AS bars,
             length(regexp_replace(line, '[^\pL]+', '', 'g')) AS letters,
             length(regexp_replace(line, '[^\p{Ll}\p{Lo}]+', '', 'g')) AS low FROM l),
near AS (SELECT r, line, p, open AND nw BETWEEN 5 AND 20 AS short, open AND nw <= 3 AND length(line) <= 40 AND NOT regexp_matches(line, '\p{Nd}') AS link,
                count(*) FILTER (NOT open AND nw >= 5) OVER (PARTITION BY r) AS n_closed, count(*) FILTER (open AND nw >= 5) OVER (PARTITION BY r) AS n_long FROM f),
links AS (SELECT *, min(link) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AND p >= 3 AS ends FROM near),
bad AS (SELECT DISTINCT r, line FROM (
          SELECT *, max(ends) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS in_a_row FROM links)
        WHERE in_a_row OR (short AND n_closed >= 5 AND n_closed >= 4 * n_long)),
g AS (SELECT r, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM f ANTI JOIN bad USING (r, line)
      WHERE k = 1 AND NOT (100 * sym >= 30 * nw OR 100 * shout >= 30 * nw OR (regexp_matches(line, '\p{Lu}{3}') AND letters >= 20 AND 100 * low < 30 * letters)
            OR (bars >= 2 AND NOT regexp_matches(line, '[.!?:;,\x{3002}]'))
            OR (nw <= 12 AND regexp_matches(lower(line), 'cookie policy|privacy policy|terms of use|terms of service|skip to content|click here to|sign up for our|subscribe to our|javascript is disabled|enable javascript|share this|read more|lorem ipsum')))
      GROUP BY r),
dup AS (SELECT r, count(*) AS n FROM l WHERE k > 1 GROUP BY r),
b AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(g.chars, 0) AS chars
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND chars * 100 >= 50 * word_chars) AS kept
FROM b
"""
