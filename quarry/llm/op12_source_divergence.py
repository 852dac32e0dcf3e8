"""Source divergence audit: how far the words of each source lie from its language's and from its other sources'.

Every (lang, source) group gives each kept term of its language the smoothed
share p (a long, in 1e-9), the language gives it q; a term's divergence is
``floor((p - q)^2 / (p + q))``. Part ``term`` lists the ten terms of a group
that stand out most above their language, part ``pair`` all other sources of the
language by the sum of the divergences over all kept terms.

Counting: tasks hold counters of the groups they meet, bounded in size and
handed on when full, so that a hot term or source is one row of each group and
task. Those are dealt by (lang, term); no key holds more rows than that.

Part ``term`` is a dominance skyband. Within a group the value grows with the
group's count of a term and falls with the language's. So a term ranks behind
every other that has at least its group count, at most its language count
and an earlier name, and behind ten of them it can't be listed. Partitions keep
the terms that fewer than ten others dominate; skybands are merged the same way
(a term that is left out is dominated by ten of those that stay, as dominance is
transitive), and what is left is ranked exactly.

Part ``pair``: a term that a source lacks has one share there, the same for all such
terms. So the sum over all kept terms is: for each source, the terms that it has
against the other's share of lacking ones, plus a correction for terms that both
have, plus all others at once. Corrections are summed per pair of sources in tiles
within tasks, so only sums leave a task.

All arithmetic is in longs, divisions by digits of base 1000: exact for up to 9e15
words a language.

Defined cases: null text, lang and source count as ''; a group without terms has its
pairs (0 if its language keeps no term) and no terms; a language of one source has no
pairs; ties go by the item's UTF-8; repeated rows are documents of their own;
texts may be of any length; extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, own_columns, small_batches

#: A language keeps the terms of so many of its documents.
LEAST_DOCUMENTS = 10
#: Terms listed for a group.
TERMS = 10
#: Entries that a task's counters hold before they are handed on.
HELD = 400_000
#: Bytes of a text that are split at once.
SLICE = 4 << 20
#: Sources on a side of a tile of sums, and tiles that a task holds before they are handed on.
TILE, TILES = 256, 64
#: Kept terms whose shares a task holds at once, times sources.
CELLS = 1 << 20

#: A-Z become a-z; bytes of ASCII that aren't letters become spaces; others stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, d long"


def slices(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes of it at a time."""
    b = text.encode().translate(LETTERS)
    at = 0
    while at < len(b):
        end = b.find(b" ", at + SLICE)
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to partial counts: occurrences and documents of each group's terms."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for k in range(0, len(terms), 65536):
                some = terms[k:k + 65536]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "d"])
        held.clear()

    entries = 0
    for b in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in b.columns]):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            once: set[bytes] = set()
            for words in slices(text):
                n.update(words)
                once.update(words)
            d.update(once)
            entries += len(n) - before
            if entries > HELD:
                yield from handed_on()
                entries = 0
    yield from handed_on()


def dominated(n: np.ndarray, m: np.ndarray, by_n: np.ndarray, by_m: np.ndarray) -> np.ndarray:
    """How many of (by_n, by_m) have at least the group count and at most the language count."""
    out = np.zeros(len(n), np.int64)
    for k in range(0, len(by_n), 1 << 15):
        out += ((by_n[None, k:k + (1 << 15)] >= n[:, None]) & (by_m[None, k:k + (1 << 15)] <= m[:, None])).sum(axis=1)
    return out


class Skyband:
    """Terms of one group, which come in the order of their names."""

    def __init__(self) -> None:
        self.n = self.m = np.zeros(0, np.int64)

    def keep(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which of the next terms fewer than TERMS others dominate. Those that were left out before needn't be
        asked: whatever they dominate, TERMS of the kept ones dominate too."""
        out = np.zeros(len(n), bool)
        for k in range(0, len(n), 256):
            a, b = n[k:k + 256], m[k:k + 256]
            inner = np.tril((a[None, :] >= a[:, None]) & (b[None, :] <= b[:, None]), -1).sum(axis=1)
            out[k:k + 256] = own = dominated(a, b, self.n, self.m) + inner < TERMS
            self.n, self.m = np.concatenate([self.n, a[own]]), np.concatenate([self.m, b[own]])
        return out


BAND = "lang string, source string, term string, n long, m long, p long, q long"


def skyband(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of BAND, sorted by lang, source and term, those that fewer than TERMS of the partition dominate."""
    group, band = None, Skyband()
    for b in batches:
        if not b.num_rows:
            continue
        lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
        n, m = b.column(3).to_numpy(), b.column(4).to_numpy()
        keep = np.zeros(len(n), bool)
        first = [0, *[k for k in range(1, len(lang)) if lang[k] != lang[k - 1] or source[k] != source[k - 1]], len(lang)]
        for s, e in zip(first, first[1:]):
            if (lang[s], source[s]) != group:
                group, band = (lang[s], source[s]), Skyband()
            keep[s:e] = band.keep(n[s:e], m[s:e])
        yield b.filter(pa.array(keep))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


SUMS = "lang string, source string, other string, value long"


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, sources, p, b), a row a term, with the shares p of the sources that have the term and b that they give
    to terms they lack, to sums over the terms that two sources share of
    f(p, p') - f(p, b') - f(b, p') + f(b, b'); source before other. The sum is 0 for terms that either lacks."""
    numbers: dict[str, dict[str, int]] = {}
    lacking: dict[str, list[int]] = {}
    tiles: dict[tuple[str, int, int], np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), t in tiles.items():
            names = list(numbers[lang])
            g, h = np.nonzero(t)
            if len(g):
                pairs = [sorted((names[i * TILE + x], names[j * TILE + y]), key=str.encode) for x, y in zip(g.tolist(), h.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string()),
                                                  pa.array(t[g, h], pa.int64())], names=["lang", "source", "other", "value"])
        tiles.clear()

    def add(lang: str, terms: list[tuple[list[int], list[int]]]) -> None:
        """Sums over some terms, each with the numbers of its sources and their shares."""
        base = np.array(lacking[lang], np.int64)
        used = np.unique(np.concatenate([np.array(s, np.int64) for s, _ in terms]))
        p = np.repeat(base[None, used], len(terms), axis=0)
        for row, (s, values) in enumerate(terms):
            p[row, np.searchsorted(used, s)] = values
        b = base[used]
        for x in range(len(used)):
            ps, bs, rest = p[:, x:x + 1], b[x], p[:, x + 1:]
            sums = (divergence(ps, rest) - divergence(ps, b[None, x + 1:]) - divergence(bs, rest) + divergence(bs, b[None, x + 1:])).sum(axis=0)
            i, own = divmod(int(used[x]), TILE)
            for j in np.unique(used[x + 1:] // TILE).tolist():
                of = used[x + 1:] // TILE == j
                tiles.setdefault((lang, i, j), np.zeros((TILE, TILE), np.int64))[own, used[x + 1:][of] % TILE] += sums[of]

    for batch in batches:
        open_: dict[str, list] = {}
        for lang, sources, p, b in zip(*[c.to_pylist() for c in batch.columns]):
            known, base = numbers.setdefault(lang, {}), lacking.setdefault(lang, [])
            for s, x in zip(sources, b):
                if s not in known:
                    known[s] = len(known)
                    base.append(x)
            mine = open_.setdefault(lang, [])
            mine.append(([known[s] for s in sources], p))
            if len(mine) * len(known) > CELLS:
                add(lang, mine)
                mine.clear()
                if len(tiles) > TILES:
                    yield from handed_on()
        for lang, mine in open_.items():
            if mine:
                add(lang, mine)
        if len(tiles) > TILES:
            yield from handed_on()
    yield from handed_on()


def share(count: str, total: str) -> str:
    """SQL for 1 + floor(1e9 * count / total), count <= total, by three digits of base 1000."""
    a = f"({count}) * 1000"
    b = f"({a} % ({total})) * 1000"
    c = f"({b} % ({total})) * 1000"
    return f"1 + ({a} div ({total})) * 1000000 + ({b} div ({total})) * 1000 + ({c} div ({total}))"


def f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def term_counts(own: DataFrame) -> DataFrame:
    """(lang, term, m, sources): the kept terms of each language with their counts in it and in its sources."""
    parts = own.select("lang", "source", "t").mapInArrow(count_terms, COUNTED).repartition("lang", "term")
    # dealt by (lang, term) once; both groupings go on within a partition
    per = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return (per.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("d").alias("df"), F.collect_list(F.struct("source", "n")).alias("sources"))
            .where(F.col("df") >= LEAST_DOCUMENTS).drop("df"))


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = own_columns(docs, "text", "lang", "source").select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("t"))
    scratch = Scratch(spark, "divergence")
    counts = scratch.table(term_counts(own), "counts")
    small_batches(spark, 4096)  # from here on rows are narrow
    of_source = counts.selectExpr("lang", "term", "m", "inline(sources)")
    langs = counts.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("m").alias("all_words"))
    groups = scratch.table(
        own.select("lang", "source").distinct()
        .join(of_source.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("has")), ["lang", "source"], "left").join(langs, "lang", "left")
        .selectExpr("lang", "source", "coalesce(words, 0) AS words", "coalesce(has, 0) AS has", "coalesce(kept, 0) AS kept", "coalesce(all_words, 0) AS all_words")
        .withColumn("b", F.expr(f"CASE WHEN kept > 0 THEN {share('2', 'words + 2 * kept')} END")), "groups")
    rows = (of_source.join(groups, ["lang", "source"])
            .select("lang", "source", "term", "n", "m", "has", "b", F.expr(share("n + 2", "words + 2 * kept")).alias("p"), F.expr(share("m + 2", "all_words + 2 * kept")).alias("q")))

    sort = ("lang", "source", "term")
    band = rows.where("p > q").select("lang", "source", "term", "n", "m", "p", "q").sortWithinPartitions(*sort).mapInArrow(skyband, BAND)
    band = band.repartition("lang", "source").sortWithinPartitions(*sort).mapInArrow(skyband, BAND)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(band.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))).where(F.col("rank") <= TERMS)

    both = (rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "b")).alias("s")).where(F.size("s") > 1).select("lang", "s.source", "s.p", "s.b")
            .mapInArrow(shared, SUMS).groupBy("lang", "source", "other").agg(F.sum("value").alias("both")))
    others = groups.select("lang", F.col("source").alias("other"), F.col("b").alias("c"), F.col("has").alias("other_has"))
    # the terms that a source has, by share, against what the others give to terms they lack
    alone = (rows.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).join(others, "lang").where(F.col("source") != F.col("other"))
             .groupBy("lang", "source", "other").agg(F.sum(F.expr(f"k * ({f('p', 'c')})")).alias("alone")))
    turned = lambda df, v, to: df.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col(v).alias(to))
    key = ["lang", "source", "other"]
    pairs = (groups.join(others, "lang").where(F.col("source") != F.col("other")).join(alone, key, "left").join(turned(alone, "alone", "back"), key, "left")
             .join(both.unionByName(turned(both, "both", "both")), key, "left")
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
                     F.expr(f"coalesce(alone, 0) + coalesce(back, 0) + coalesce(both, 0) + coalesce((kept - has - other_has) * ({f('b', 'c')}), 0)").alias("value")))
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS m FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
lv AS (SELECT lang, count(*) AS v, sum(m) AS total FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, l.m, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
p AS (SELECT f.lang, f.source, f.term, f.n, CAST(1 + 1000000000 * (f.n + 2) // (f.total + 2 * lv.v) AS HUGEINT) AS p,
             CAST(1 + 1000000000 * (f.m + 2) // (lv.total + 2 * lv.v) AS HUGEINT) AS q FROM f JOIN lv USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM x WHERE part = 'pair' OR rank <= 10
"""
