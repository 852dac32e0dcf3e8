"""Text scalar functions as Spark Column expressions.

All of them stay inside whole-stage codegen: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the whitespace class that Python's ``str.split()`` uses.
# Java regex and RE2 (DuckDB) both accept this exact string, so the same
# pattern is used on the Spark side and in the SQL oracle.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"

# fixed values: encoder input prefixes
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ws(text) -> Column:
    """Whitespace tokens, case kept, no empty tokens."""
    return F.array_remove(F.split(_col(text), WS_RUN), "")


def tokenize(text) -> Column:
    """Lower-case, split on (Unicode) whitespace, drop empty tokens."""
    return split_ws(F.lower(_col(text)))


def strip_ws(text) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of the T1 class."""
    return F.regexp_replace(_col(text), f"^{WS_RUN}|{WS_RUN}$", "")


def _bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` (a lambda binding), so a
    costly expression is not re-evaluated inside array lambdas."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def char_ngrams(text, n: int = 3) -> Column:
    """Distinct character n-grams of ``text`` (empty array when shorter than n).

    One regex pass with an overlapping look-ahead: linear in the text and
    code-point based (``substring`` by position would rescan UTF-8 from the
    start for every gram). A gram may not start on a lone surrogate: after a
    zero-length match Java advances one UTF-16 unit, which can land inside a
    character outside the Basic Multilingual Plane.
    """
    def grams(t):
        return F.when(
            F.length(t) >= n,
            F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?s)(?=(\P{Cs}.{%d}))" % (n - 1)), F.lit(1))),
        ).otherwise(F.array().cast("array<string>"))
    return _bind(_col(text), grams)


def packed_trigrams(text) -> Column:
    """Distinct character trigrams of the lower-cased, stripped text, each
    packed into one long (21 bits a code point, so no two share a value)."""
    grams = char_ngrams(F.lower(strip_ws(_col(text))))
    code = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("bigint")
    return F.transform(grams, lambda g: F.shiftleft(code(g, 1), 42) + F.shiftleft(code(g, 2), 21) + code(g, 3))


def set_jaccard(a, b) -> Column:
    """Jaccard of two arrays without repeats; 0.0 if either is empty or NULL."""
    def jac(i):
        return i / (F.size(a) + F.size(b) - i)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _bind(F.size(F.array_intersect(a, b)), jac)).otherwise(F.lit(0.0))


def trigram_jaccard(a, b) -> Column:
    """Jaccard of character trigrams of lower-cased, stripped texts.

    0.0 when either text is empty/NULL or shorter than three characters.
    """
    ga = char_ngrams(F.lower(strip_ws(_col(a))))
    gb = char_ngrams(F.lower(strip_ws(_col(b))))

    def jac(g):
        x, y = g["a"], g["b"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0),
                      F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))
    # both gram sets are computed once and bound to the lambda
    return _bind(F.struct(ga.alias("a"), gb.alias("b")), jac)


def doc_id_from_chunk(chunk_id) -> Column:
    """Drop the last ``_``-separated part; unchanged without ``_``."""
    return F.regexp_replace(_col(chunk_id), "_[^_]*$", "")


def query_hash(q) -> Column:
    """T4: first 12 hex characters of SHA-256 of the UTF-8 query."""
    return F.substring(F.sha2(_col(q), 256), 1, 12)


def detokenize(tokens) -> Column:
    """T5: text rebuilt from tokens."""
    return F.concat_ws(" ", _col(tokens))


def client_key(forwarded_for, host) -> Column:
    """First X-Forwarded-For entry, else host, else 'unknown'.

    An empty header counts as absent.
    """
    first = F.trim(F.split(_col(forwarded_for), ",").getItem(0))
    first = F.when(F.length(first) > 0, first)
    h = F.when(F.length(_col(host)) > 0, _col(host))
    return F.coalesce(first, h, F.lit("unknown"))


def cache_key(q, k, ef=None) -> Column:
    """SHA-256 of the normalised query, k and (optional) search breadth."""
    parts = [F.lower(strip_ws(_col(q))), _col(k).cast("string")]
    if ef is not None:
        parts.append(_col(ef).cast("string"))
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def with_prefix(text, kind: str = "query") -> Column:
    """Encoder prefix for queries or passages."""
    prefix = QUERY_PREFIX if kind == "query" else PASSAGE_PREFIX
    return F.concat(F.lit(prefix), _col(text))


def version_stamp(ts=None) -> Column:
    """Index/version stamp ``%Y%m%d-%H%M`` (session time zone) of ``ts``,
    by default the query's current timestamp."""
    t = F.current_timestamp() if ts is None else _col(ts)
    return F.date_format(t, "yyyyMMdd-HHmm")
