"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every training passage by block-max WAND.

Passages are windows over a document's words, twice as long as the longest item
and a half-window apart, so every run of words as long as an item lies whole in one.
A passage is a query of its distinct words; all items whose score reaches their
threshold are retrieved. An item's threshold is its score for itself less the
largest weights that it may lose and still share 80 % of its five-word shingles,
so no passage that holds 80 % of an item's shingles is missed. Items whose shingles
are scattered over passages are found by looking every shingle of a longer document up
among those of the items. Verified are those with 80 % of the item's shingles in the
document; that alone decides. The shares of the words of the question (all but the last
sentence) and of the answer (the last sentence) that stand in the best passage are
reported only: the items mark neither part.

Scores are divided by thresholds, so that 1 is the threshold of every item.
A passage goes through three bounds, each above the true score:
the summed maxima of its rare words (one running sum for a whole document), the
block maxima, and then WAND's pivots with block maxima for those that are left.

Words: runs of letters, digits and characters from U+0080, lower-cased.

The index is dealt in blocks of items with a bounded number of words; every
block is broadcast by itself and asked with all passages. A worker makes a block's
index once, in a time that grows with the block's words. IDF and lengths are those
of all items.

Defined cases: null texts and texts without words match nothing; items under
five words are one shingle; items without words match nothing; items that repeat
an id, or that share a text, are each searched; repeated rows and ids give one
row for each pair of ids, that with the highest score (then the next columns);
empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, free, own_columns

K1, B = 1.2, 0.75
SHINGLE = 5
LEAST_SIMILAR = 0.8
#: Words of a block of items: bounds what is broadcast.
BLOCK_WORDS = 400_000
#: Items of a block of postings, for its maxima.
POSTINGS_BLOCK = 8
#: Words in at most this share of the items are rare.
RARE_SHARE = 0.05
SLACK = 1e-9

_DIVIDE = bytes(32 if b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))
FOUND = (("item_id", "bigint"), ("score", "double"), ("similarity", "double"), ("question_overlap", "double"), ("answer_overlap", "double"), ("start", "bigint"))
FOUND_NAMES = [n for n, _ in FOUND]


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_DIVIDE).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of an item of one sentence, the last third of its words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if words(p)]
    if len(parts) > 1:
        return words(" ".join(parts[:-1])), words(parts[-1])
    w = words(text)
    cut = len(w) - max(1, len(w) // 3) if len(w) > 1 else 0
    return w[:cut], w[cut:]


def shingles(w: list) -> set[tuple]:
    if not w:
        return set()
    n = min(SHINGLE, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


class Index:
    """An inverted index of a block of items. ``stats``: number of items in all, their mean length,
    and in how many of them each word of the block stands."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, df: dict[bytes, int]):
        self.items = [(i, w, t) for i, t in items if (w := words(t))]
        self.vocabulary: dict[bytes, int] = {}
        rows: list[dict[int, float]] = []
        names: list[bytes] = []
        self.sets, self.parts = [], []
        for _, w, t in self.items:
            tf: dict[int, int] = {}
            for x in w:
                k = self.vocabulary.setdefault(x, len(self.vocabulary))
                if k == len(names):
                    names.append(x)
                tf[k] = tf.get(k, 0) + 1
            long = K1 * (1 - B + B * len(w) / max(mean_words, 1e-9))
            rows.append({k: math.log(1 + (n_items - df[names[k]] + 0.5) / (df[names[k]] + 0.5)) * n * (K1 + 1) / (n + long) for k, n in tf.items()})
            self.sets.append(shingles(w))
            self.parts.append(question_and_answer(t))
        self.longest = max((len(w) for _, w, _ in self.items), default=0)
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        n_v, n_i = len(self.vocabulary), len(self.items)
        rare = [df[x] <= max(1, RARE_SHARE * n_items) for x in names]
        by_word: list[list[tuple[int, float]]] = [[] for _ in range(n_v)]
        self.rare_most = np.zeros(n_v + 1)
        for i, r in enumerate(rows):
            weights = sorted(r.values(), reverse=True)
            lost = sum(weights[:int((1 - LEAST_SIMILAR) * len(self.sets[i]) + 1e-9)])
            least = max(sum(weights) - lost, 1e-12)
            common = sum(v for k, v in r.items() if not rare[k])
            need = least - common  # what the rare words must bring
            for k, v in r.items():
                by_word[k].append((i, v / least))
                if rare[k]:
                    self.rare_most[k] = max(self.rare_most[k], v / need if need > 1e-12 else 2.0)
            if need <= 1e-12:
                self.rare_most[n_v] = 2.0  # an item that common words alone may match: every passage goes on
        self.blocks = max(-(-n_i // POSTINGS_BLOCK), 1)
        self.most = np.zeros(n_v)
        maxima: list[tuple[np.ndarray, np.ndarray]] = []  # of each word the blocks that it stands in, and its largest weight there
        for k, p in enumerate(by_word):
            ids = np.array([i for i, _ in p])
            ws = np.array([v for _, v in p])
            self.postings.append((ids, ws))
            first = np.flatnonzero(np.diff(ids // POSTINGS_BLOCK, prepend=-1))
            maxima.append((ids[first] // POSTINGS_BLOCK, np.maximum.reduceat(ws, first)))
            self.most[k] = ws.max()
        self.begin = np.cumsum([0, *[len(b) for b, _ in maxima]])
        self.block_of, self.block_most = (np.concatenate([np.zeros(0, kind), *[m[j] for m in maxima]]).astype(kind) for j, kind in ((0, np.int64), (1, np.float64)))
        self.lists = [(ids.tolist(), ws.tolist()) for ids, ws in self.postings]
        # the distinct shingles of each item as hashes of word numbers, for documents of several passages
        pairs = {(x, i) for i, (_, w, _) in enumerate(self.items) for x in self.hashes(self.numbers(w)).tolist()}
        self.shingle, self.holder = (np.array([p[k] for p in sorted(pairs)], np.int64) for k in (0, 1))
        self.distinct = np.bincount(self.holder, minlength=n_i)

    def numbers(self, w: list[bytes]) -> np.ndarray:
        get, none = self.vocabulary.get, len(self.vocabulary)
        return np.fromiter((get(x, none) for x in w), np.int32, len(w))

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        """Hashes of the runs of SHINGLE words. Equal runs have equal hashes; verification uses the words themselves."""
        n = len(ids) - SHINGLE + 1
        out = np.zeros(max(n, 0), np.int64)
        for k in range(SHINGLE if n > 0 else 0):
            out = (out ^ ids[k:k + n]) * np.int64(0x5851F42D4C957F2D)
            out ^= out >> 29
        return out

    def scattered(self, ids: np.ndarray) -> list[int]:
        """Items of which the document holds LEAST_SIMILAR of the shingles, wherever they stand."""
        here = self.hashes(ids)
        at = np.searchsorted(self.shingle, here)
        if not len(self.shingle):
            return []
        here = np.unique(here[self.shingle[np.minimum(at, len(self.shingle) - 1)] == here])
        a, b = np.searchsorted(self.shingle, here), np.searchsorted(self.shingle, here, "right")
        n = np.zeros(len(self.items), np.int64)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            n[self.holder[x:y]] += 1
        return np.flatnonzero((n > 0) & (n >= LEAST_SIMILAR * self.distinct - SLACK)).tolist()

    def best_passage(self, i: int, ids: np.ndarray) -> tuple[float, int]:
        """The highest score of an item in a passage, and the passage's begin."""
        own = {k: v for k in set(self.numbers(self.items[i][1]).tolist()) for j, v in zip(*self.lists[k], strict=True) if j == i}
        n, step = len(ids), self.longest
        scores = ((sum(own.get(k, 0.0) for k in set(ids[b:b + 2 * step].tolist())), -b) for b in range(0, max(1, n - step), step))
        s, b = max(scores)
        return s, -b

    def passages(self, ids: np.ndarray) -> list[int]:
        """Begins of the windows whose rare words could reach a threshold."""
        n, size, step = len(ids), 2 * self.longest, self.longest
        begins = np.arange(0, max(1, n - self.longest), step) if n > size else np.zeros(1, np.int64)
        run = np.concatenate(([0.0], np.cumsum(self.rare_most[ids])))
        bound = run[np.minimum(begins + size, n)] - run[begins]
        if self.rare_most[-1]:
            return begins.tolist()
        return begins[bound >= 1 - SLACK].tolist()

    def wand(self, query: np.ndarray) -> list[tuple[int, float]]:
        """All items with a score of 1 or more for the distinct words of a passage."""
        size = self.begin[query + 1] - self.begin[query]
        at = np.repeat(self.begin[query] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bounds = np.bincount(self.block_of[at], self.block_most[at], self.blocks)
        if bounds.max() < 1 - SLACK:
            return []
        live = bounds >= 1 - SLACK
        most, lists, block = self.most, self.lists, POSTINGS_BLOCK
        cursors = [[lists[k][0][0], 0, k] for k in query.tolist()]  # item, place in the list, word
        out = []

        def move(c, to: int) -> None:
            ids, at = lists[c[2]][0], c[1]
            while at < len(ids) and ids[at] < to:
                at += 1
            c[1] = at
            c[0] = ids[at] if at < len(ids) else 1 << 60

        while True:
            cursors.sort()
            total, pivot = 0.0, None
            for c in cursors:
                if c[0] == 1 << 60:
                    break
                total += most[c[2]]
                if total >= 1 - SLACK:
                    pivot = c[0]
                    break
            if pivot is None:
                return out
            if not live[pivot // block]:  # the block's maxima can't reach the threshold: go to the next block
                after = (pivot // block + 1) * block
                for c in cursors:
                    if c[0] < after:
                        move(c, after)
                continue
            score = 0.0
            for c in cursors:
                if c[0] > pivot:
                    break
                if c[0] < pivot:
                    move(c, pivot)
                if c[0] == pivot:
                    score += lists[c[2]][1][c[1]]
                    move(c, pivot + 1)
            if score >= 1 - SLACK:
                out.append((pivot, score))

    def search(self, w: list[bytes]) -> list[tuple[int, float, int]]:
        """(item, score, begin) of the best passage for each item that a passage retrieves."""
        if not self.items or not w:
            return []
        ids = self.numbers(w)
        none = len(self.vocabulary)
        best: dict[int, tuple[float, int]] = {}
        for b in self.passages(ids):
            q = np.unique(ids[b:b + 2 * self.longest])
            for i, s in self.wand(q[q != none]):
                if i not in best or s > best[i][0]:
                    best[i] = (s, b)
        if len(ids) > 2 * self.longest:
            for i in self.scattered(ids):
                if i not in best:
                    best[i] = self.best_passage(i, ids)
        return [(i, s, b) for i, (s, b) in best.items()]

    def verify(self, w: list[bytes], found: list[tuple[int, float, int]]) -> Iterator[tuple[int, float, float, float, float, int]]:
        """item_id, score, similarity, overlap of question and of answer, begin of the passage."""
        for i, s, b in found:
            item = self.sets[i]
            n = len(next(iter(item)))
            here = {g for j in range(len(w) - n + 1) if (g := tuple(w[j:j + n])) in item}
            similar = len(here) / len(item)
            if similar < LEAST_SIMILAR:
                continue
            near = set(w[b:b + 2 * self.longest])
            q, a = ((sum(x in near for x in p) / len(p) if p else 1.0) for p in self.parts[i])
            yield self.items[i][0], s, similar, q, a, b


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[tuple[int, str]], int, float, dict[bytes, int]]]:
    """Blocks of items of about ``block_words`` words, each with the statistics of all items."""
    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            ws = [words(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "text": b["text"], "n": [len(w) for w in ws], "ws": [sorted({x.decode("utf-8", "surrogatepass") for x in w}) for w in ws]})

    own = own_columns(items, "item_id", "text").select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.where("id IS NOT NULL").mapInPandas(split, "id long, text string, n long, ws array<string>").where("n > 0")
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not total["n"]:
        return
    blocks = -(-total["words"] // block_words)
    df = rows.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for k in range(blocks):
        mine = dealt.where(F.col("block") == k)
        texts = [(r["id"], r["text"]) for r in mine.select("id", "text").orderBy("id", "text").collect()]
        counts = mine.select(F.explode("ws").alias("w")).distinct().join(df, "w").collect()
        yield texts, total["n"], total["words"] / total["n"], {r["w"].encode("utf-8", "surrogatepass"): r["df"] for r in counts}


#: Blocks that one job asks one after another; tables are written between such jobs.
CHAIN = 4
#: Indexes that a worker keeps.
_MADE: dict[str, Index] = {}


def made(key: str, block: tuple) -> Index:
    """The index of a block, made once in a worker."""
    if key not in _MADE:
        while len(_MADE) >= 2:
            del _MADE[next(iter(_MADE))]
        _MADE[key] = Index(*block)
    return _MADE[key]


def mark(docs: DataFrame, items: DataFrame, out: str = "leaks", block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``out``, an array of what was found in each row. No shuffle: a row's verdict needs the row alone."""
    sc = docs.sparkSession.sparkContext
    one = "struct<" + ", ".join(f"{n}:{t}" for n, t in FOUND) + ">"
    types = pa.list_(pa.struct([(n, pa.int64() if t == "bigint" else pa.float64()) for n, t in FOUND]))
    names, at = docs.columns, docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scratch = Scratch(docs.sparkSession, "leaks")
    marked, extra = docs, []
    for k, block in enumerate(item_blocks(items, block_words)):
        if k and k % CHAIN == 0:  # so that a task has few workers, each with an index
            marked = scratch.table(marked, str(k))
            scratch.drop(str(k - CHAIN))
        sent, key = sc.broadcast(block), uuid.uuid4().hex
        extra.append(free(f"__{out}{k}", docs.columns))

        def run(it: Iterator[pa.RecordBatch], sent=sent, key=key, name=extra[-1]) -> Iterator[pa.RecordBatch]:
            index = None
            for b in it:
                index = index or made(key, sent.value)
                rows = []
                for t in b.column(at).to_pylist():
                    w = words(t)
                    found = index.search(w)
                    rows.append([dict(zip(FOUND_NAMES, r, strict=True)) for r in index.verify(w, found)] if found else [])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, types)], [*b.schema.names, name])

        marked = marked.mapInArrow(run, f"{fields}, " + ", ".join(f"`{x}` array<{one}>" for x in extra))
    all_found = F.concat(*extra) if extra else F.array().cast(f"array<{one}>")
    return marked.select(*[F.col(f"`{n}`") for n in names], all_found.alias(out))


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, similarity, question_overlap, answer_overlap and start (word) of every item that a document holds."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = mark(own, items, "leaks", block_words)
    each = found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
    rest = [n for n in FOUND_NAMES if n != "item_id"]
    return each.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("l")).select("doc_id", "item_id", "l.*")
