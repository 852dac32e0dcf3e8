"""Periodic runs: stretches of words that repeat with a smallest period, found by tiles of each scale.

A run with a period q in [P, 2P), P a power of two, is at least 4q words long.
So it covers one of the centres that stand every 2P words, together with the q
words after it. For every octave P a document is therefore exploded into the
tiles of 4P words to either side of each centre. A tile is solved by itself:
two Z-functions at its centre give, for every period up to 2P, how far the words
repeat to the right and to the left, hence the stretch of each period around
the centre, cut off at the tile's ends. Stretches inside one of a smaller
period aren't primitive and go. What is left of a tile are intervals; those of
one document and period that overlap by a period are parts of one run. They
are shuffled by (document, period) and stitched there.

Tiles that can't hold a run are left out before they are made. A run of 4q words
holds a multiple of P whose 2P words stand again q words later; a document without
any has no tiles in that octave. In the others, a centre in a run has P words at it, or
P words before it, that stand again q words later. Grams are compared by hashes,
built by doubling, so nothing is lost, and nothing is decided by a hash: tiles hold
exact word numbers.

Documents without any tile are finished where they are read. The text of the
others is written once, and meets its runs by a join.

Defined cases: a null text has no words; a null doc_id plants nothing; an empty
text gives the digests of the empty string; ties go by start, then period;
repeated rows each get a row; texts may be of any length (one text at a time is
held by a task); extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, own_columns

#: A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are tiled together. A longer text is tiled alone.
BLOCK = 1 << 20
#: Tiles in an Arrow batch, and words of tiles in it.
TILES, TILE_WORDS = 4096, 1 << 20

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def words_of(text: str | None) -> list[bytes]:
    """Bytes that ``split`` takes as white space are U+0020 and U+0009 to U+000D."""
    return text.encode().split() if text else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by the hash of its id, repeats its words from some place on."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    times = -(-(len(words) - a) // p)
    return words[:a] + (words[a:a + p] * times)[:len(words) - a]


class Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def longer(grams: np.ndarray, P: int) -> np.ndarray:
    """Hashes of 2P words from those of P words."""
    if len(grams) <= P:
        return grams[:0]
    mixed = grams[:-P] * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return (mixed + grams[P:]) * np.uint64(0x94D049BB133111EB)


def again(grams: np.ndarray, P: int) -> np.ndarray:
    """The multiples c of P whose gram stands again at c + P to c + 2P - 1."""
    g = np.zeros((-(-len(grams) // P) + 1, P), np.uint64)
    g.reshape(-1)[:len(grams)] = grams
    return np.flatnonzero((g[1:] == g[:-1, :1]).any(axis=1)) * P


def candidates(x: np.ndarray, longest: int, starts: np.ndarray = np.zeros(1, np.int64)) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave P, the centres (multiples of 2P) of x whose tile may hold part of a run. The texts of x begin
    at ``starts``; the numbers that stand between them differ from all others."""
    grams = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    P = 1
    while LEAST_PERIODS * P <= longest and len(grams):
        double = longer(grams, P)
        # a run holds a multiple of P whose 2P words (4 words, where a run of period 1 has 6) stand again a period later
        texts = np.unique(np.searchsorted(starts, again(longer(double, 2) if P == 1 else double, P), "right"))
        if len(texts):
            g = np.zeros((-(-len(grams) // (2 * P)), 2 * P), np.uint64)
            g.reshape(-1)[:len(grams)] = grams
            # P words at the centre stand again a period later, or P words before it do
            hit = (g[:, P:] == g[:, :1]).any(axis=1)
            hit[1:] |= (g[1:, :P] == g[:-1, P:P + 1]).any(axis=1)
            centres = np.flatnonzero(hit) * (2 * P)
            yield P, centres[np.isin(np.searchsorted(starts, centres, "right"), texts)]
        grams = double
        P *= 2


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many words from i on equal those from 0 on."""
    n = len(s)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > hi:
            lo, hi = i, i + k
        z[i] = k
    return z


def solve(tile: list[int], centre: int, P: int) -> list[tuple[int, int, int]]:
    """(period, start, end) within the tile: the primitive stretches with a period in [P, 2P) that hold the
    centre and the period after it, and at least two periods in all."""
    right, left = tile[centre:], tile[:centre]
    most = min(2 * P - 1, len(right))
    if most < P:
        return []
    d = np.arange(1, most + 1)
    forward = np.array((z_function(right) + [0])[1:most + 1], np.int64)
    # words before the centre against those before centre + d, both read backwards
    z = z_function(left[::-1] + [-1] + tile[:centre + most][::-1])
    back = np.array(z[len(left) + 1:len(left) + 1 + most][::-1], np.int64)
    start, end = centre - back, centre + d + forward
    open_ = end - start >= 2 * d
    found = []
    while open_.any():
        k = int(open_.argmax())
        s, e = int(start[k]), int(end[k])
        if k + 1 >= P:
            found.append((k + 1, s, e))
        # a stretch inside this one has a smaller period, this one's or a divisor of both
        open_ &= ~((start >= s) & (end <= e))
    return found


def merged(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts of one document and octave, those of a period that overlap by a period made one."""
    out: list[tuple[int, int, int]] = []
    for q, s, e in sorted(parts):
        if out and out[-1][0] == q and s <= out[-1][2] - q:
            out[-1] = (q, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((q, s, e))
    return out


def digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


EXPLODED = "key string, doc_id long, text string, plain string, octave long, lo long, centre long, words array<int>"
EMPTY = hashlib.sha256(b"").hexdigest()


def explode_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every document a row: with the digest of its words if it has no tile, else with its text. Of
    every tile that may hold a run a row."""
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("plain", pa.string()), ("octave", pa.int64()), ("lo", pa.int64()),
                        ("centre", pa.int64()), ("words", pa.list_(pa.int32()))])

    def block(docs: list[tuple[str, int | None, str | None, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        numbers, at, total = Numbers(), [], 0
        for *_, w in docs:
            at.append(total)
            total += len(w) + 1
        x = np.empty(total, np.int64)
        for k, (*_, w) in enumerate(docs):
            x[at[k]:at[k] + len(w)] = [numbers[i] for i in w]
            x[at[k] + len(w)] = -2 - k
        own = x.astype(np.int32)
        starts = np.array(at)
        with_tiles, rows, n = set(), [], 0
        for P, centres in candidates(x, max(len(w) for *_, w in docs), starts):
            of = np.searchsorted(starts, centres, "right") - 1
            for c, k in zip(centres.tolist(), of.tolist()):
                begin, size = at[k], len(docs[k][3])
                # the centre may stand in the gap behind a text, and a text may be too short for the octave
                if c >= begin + size or size < LEAST_PERIODS * P or size < LEAST_WORDS:
                    continue
                with_tiles.add(k)
                lo, hi = max(begin, c - 4 * P), min(begin + size, c + 4 * P)
                rows.append((docs[k][0], P, lo - begin, c - lo, own[lo:hi]))
                n += hi - lo
                if n > TILE_WORDS or len(rows) >= TILES:
                    yield tiles(rows)
                    rows, n = [], 0
        if rows:
            yield tiles(rows)
        yield pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in docs], pa.string()), pa.array([d[1] for d in docs], pa.int64()),
            pa.array([d[2] if k in with_tiles else None for k, d in enumerate(docs)], pa.string()),
            pa.array([None if k in with_tiles else hashlib.sha256(b" ".join(d[3])).hexdigest() for k, d in enumerate(docs)], pa.string()),
            *[pa.nulls(len(docs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))]], schema=schema)

    def tiles(rows: list) -> pa.RecordBatch:
        key, P, lo, centre, words = zip(*rows)
        values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32), pa.array(np.concatenate(words)))
        none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *none, *[pa.array(c, pa.int64()) for c in (P, lo, centre)], values], schema=schema)

    for b in batches:
        docs, n = [], 0
        for key, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            w = planted(words_of(text), doc_id)
            if docs and n + len(w) > BLOCK:
                yield from block(docs)
                docs, n = [], 0
            docs.append((key, doc_id, text, w))
            n += len(w)
        if docs:
            yield from block(docs)


SOLVED = "key string, doc_id long, text string, plain string, period long, start long, end long"


def solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles become intervals; rows of documents stay as they are."""
    schema = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("plain", pa.string()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    for b in batches:
        is_doc = pc.is_null(b.column(4))
        docs = b.filter(is_doc)
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([*docs.columns[:4], *[pa.nulls(docs.num_rows, pa.int64())] * 3], schema=schema)
        t = b.filter(pc.invert(is_doc))
        if not t.num_rows:
            continue
        found: dict[str, list] = {}
        columns = [t.column(k).to_pylist() for k in (0, 4, 5, 6)]
        for key, P, lo, centre, words in zip(*columns, t.column(7)):
            found.setdefault(key, []).extend((q, s + lo, e + lo) for q, s, e in solve(words.as_py(), centre, P))
        rows = [(key, *x) for key, parts in found.items() for x in merged(parts)]
        if rows:
            key, q, s, e = zip(*rows)
            none = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *none, *[pa.array(c, pa.int64()) for c in (q, s, e)]], schema=schema)


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, starts, lengths, periods) to the columns of the result."""
    schema = pa.schema([*[(c, pa.int64()) for c in COLUMNS[:6]], *[(c, pa.string()) for c in COLUMNS[6:]]])
    for b in batches:
        out = []
        for doc_id, text, *columns in zip(*[c.to_pylist() for c in b.columns]):
            runs = sorted(zip(*columns), key=lambda r: (r[0], r[2])) if columns[0] else []
            w = planted(words_of(text), doc_id)
            best = None
            for s, n, q in runs:
                if best is None or n * best[2] > best[1] * q:
                    best = (s, n, q)
            if runs:
                dropped = np.zeros(len(w) + 1, np.int64)
                for s, n, q in runs:
                    dropped[s + q] += 1
                    dropped[s + n] -= 1
                w = [x for x, k in zip(w, np.cumsum(dropped).tolist()) if not k]
            out.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(runs), hashlib.sha256(b" ".join(w)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)


def stitched(parts: DataFrame) -> DataFrame:
    """Runs (key, period, start, end) from the intervals of a document and period: one that overlaps
    the words before it by less than a period begins another run."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("start") <= before - F.col("period"), 0).otherwise(1)
    run = F.sum("first").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (parts.withColumn("first", first).withColumn("run", run).groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .where((F.col("end") - F.col("start") >= LEAST_PERIODS * F.col("period")) & (F.col("end") - F.col("start") >= LEAST_WORDS)))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The columns of COLUMNS for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # equal rows have equal runs, so one key may stand for both; texts of one id differ in 128 bits
    key = F.concat_ws("-", F.col("doc_id").cast("long"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))
    own = own_columns(docs, "doc_id", "text").select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    scratch = Scratch(spark, "runs")
    rows = scratch.table(own.mapInArrow(explode_tiles, EXPLODED).mapInArrow(solve_tiles, SOLVED), "solved")
    runs = stitched(rows.where("period IS NOT NULL").select("key", "period", "start", "end"))
    of_doc = runs.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")).alias("runs"))
    open_ = rows.where("text IS NOT NULL").select("key", "doc_id", "text").join(of_doc, "key", "left")
    with_runs = open_.select("doc_id", "text", *[F.col(f"runs.{c}").alias(c) for c in ("start", "length", "period")]).mapInArrow(collapse, RESULT)
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    plain = rows.where("plain IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *none, F.lit(EMPTY).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    return plain.unionByName(with_runs)
