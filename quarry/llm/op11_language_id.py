"""Language by prediction by partial matching: the language whose statistics code a text's bytes shortest.

Each language has a tree of byte contexts of 0 to ORDER bytes with the counts of
the bytes that followed. A byte is coded in the longest context that the tree
knows; where it never followed there, an escape is coded and the context loses
its first byte; below the empty context all 256 bytes are alike. A context seen n
times before d different bytes gives a byte seen c times c / (n + d), the escape
d / (n + d). The statistics are frozen: coding changes no count. Code lengths are whole
numbers (2^-16 bits), so that sums are exact and the same in any partition.

As counts are frozen, what a byte costs depends on the ORDER bytes before it alone. The
tables hold, for every context and byte that some language saw, the cost in
each language with its escapes paid, and for every context the cost of its escape.
All positions of a block of texts are looked up at once, those not found in
the longest context again in the next.

Texts are put in lower case and runs of ASCII other than letters become one space, as
they tell nothing of a language. Nothing else is cut.

Learning: texts of the documents that ``learn`` allows and that have a language.
Up to TRAIN_TEXTS different texts of a language, the smallest hashes of their text
in a share of them, TRAIN_CHARS characters of each: the bound of the model, which is
broadcast (at most ORDER + 1 counts a byte learned). All else covers every document whole.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and so are
all texts if there is nothing to learn from; a null doc_id counts as not held out; a
null lang is not learned from; of equal code lengths the language that is first by UTF-8 wins;
repeated rows are each predicted; texts may be of any length; extra columns are ignored,
so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import own_columns
from quarry.operators.relational import broadcast_if_small, top_k_per_group

#: Bytes of the longest contexts. A context and its byte must fit in 64 bits.
ORDER = 4
#: Bounds of the labelled sample of each language.
TRAIN_TEXTS = 500
TRAIN_CHARS = 2000
#: A bit of code length.
BIT = 1 << 16
#: The score is the posterior after so many bytes at the text's own average rates (or after all, if it has fewer).
EVIDENCE = 24
#: Bytes that are looked up at once.
BLOCK = 1 << 18
UNKNOWN = "und"

#: ASCII other than letters becomes a space.
PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> bytes:
    b = np.frombuffer(text.lower().encode().translate(PLAIN), np.uint8)
    space = b == 32
    return b[~space | np.concatenate([[True], ~space[:-1]])].tobytes() if len(b) else b""


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER bytes before each byte with it, as one number (zeros before a text); and of each text
    where its bytes begin and end."""
    pad = bytes(ORDER)
    b = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    n = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(n + ORDER)
    g = np.zeros(len(b), np.int64)
    for k in range(ORDER + 1):
        g[k:] |= b[:len(b) - k] << (8 * k)
    return g, end - n, end


class Index:
    """Places of numbers in an array, by open addressing, many at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        open_, slot = np.arange(len(keys)), self.slots(keys)
        while len(open_):
            free = self.place[slot] < 0
            first = np.zeros(len(open_), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            first &= free
            self.keys[slot[first]], self.place[slot[first]] = keys[open_[first]], open_[first]
            open_, slot = open_[~first], (slot[~first] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each, -1 if there is none."""
        slot = self.slots(keys)
        out = self.place[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            s = slot[wrong]
            out[wrong] = self.place[s]
            wrong = wrong[(self.place[s] >= 0) & (self.keys[s] != keys[wrong])]
        return out


def bits(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * BIT).astype(np.int32)


class Trees:
    """Frozen statistics of all languages. counts: for each order (language number, gram, count) arrays,
    a gram being a context and the byte after it."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.langs = langs
        self.seen: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k, (lang, gram, n) in enumerate(counts):
            contexts, of = np.unique(gram >> 8, return_inverse=True)
            total = np.zeros((len(contexts), len(langs)))
            kinds = np.zeros_like(total)
            np.add.at(total, (of, lang), n)
            np.add.at(kinds, (of, lang), 1)
            escape = np.zeros(total.shape, np.int32)
            known = total > 0
            escape[known] = bits(kinds[known] / (total + kinds)[known])
            seen, row = np.unique(gram, return_inverse=True)
            context = np.searchsorted(contexts, seen >> 8)
            # first the price of escaping to the shorter context, then that of those who saw it here
            below = self.cost[-1][np.searchsorted(self.seen[-1], seen & ((1 << (8 * k)) - 1))] if k else np.int32(8 * BIT)
            cost = escape[context] + below
            cost[row, lang] = bits(n / (total + kinds)[of, lang])
            for name, a in (("seen", seen), ("cost", cost), ("contexts", contexts), ("escape", escape)):
                getattr(self, name).append(a)

    def ready(self) -> Trees:
        """With the indexes, which are made where they are used."""
        if not hasattr(self, "found"):
            self.found = [(Index(a), Index(c)) for a, c in zip(self.seen, self.contexts)]
        return self

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte in each language."""
        out = np.zeros((len(gram), len(self.langs)), np.int32)
        open_, g = np.arange(len(gram)), gram
        for k in range(ORDER, -1, -1):
            at = self.found[k][0].find(g)
            hit = at >= 0
            out[open_[hit]] += self.cost[k][at[hit]]
            open_, g = open_[~hit], g[~hit]
            if not len(open_):
                return out
            context = self.found[k][1].find(g >> 8)
            known = context >= 0
            out[open_[known]] += self.escape[k][context[known]]
            g = g & ((1 << (8 * k)) - 1)
        out[open_] += 8 * BIT
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        gram, begin, end = grams(texts)
        total = np.zeros((len(gram) + 1, len(self.langs)), np.int64)
        for k in range(0, len(gram), BLOCK):
            total[k + 1:k + 1 + BLOCK] = self.costs(gram[k:k + BLOCK])
        np.cumsum(total, axis=0, out=total)
        return total[end] - total[begin]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if self.langs else []
        at = 0
        while at < len(known):
            some, size = [], 0
            while at < len(known) and (not some or size + len(texts[known[at]]) <= 4 * BLOCK):
                some.append(known[at])
                size += len(texts[known[at]])
                at += 1
            coded = [plain(texts[k]) for k in some]
            lengths = self.lengths(coded)
            best = lengths.argmin(axis=1)
            more = (lengths - lengths.min(axis=1, keepdims=True)) / BIT
            n = np.array([len(c) for c in coded], np.float64)
            weight = 1 / np.exp2(-more * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]).sum(axis=1)
            for k, b, s in zip(some, best.tolist(), weight.tolist()):
                lang[k], score[k] = self.langs[b], s
        return lang, score


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal, modulo 3, is 1; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


COUNTS = "lang string, k int, gram long, n long"


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the counts of contexts of every order with the byte after them."""
    texts: dict[str, list[bytes]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.setdefault(lang, []).append(plain(text))
    for lang, some in texts.items():
        g, begin, end = grams(some)
        inside = np.zeros(len(g) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        g = g[np.cumsum(inside)[:-1] > 0]
        for k in range(ORDER + 1):
            gram, n = np.unique(g & ((1 << (8 * (k + 1))) - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))],
                                             names=["lang", "k", "gram", "n"])


def train(docs: DataFrame, learn: Column | None = None, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> Trees:
    """Statistics from documents (text, lang) that have a language and for which ``learn`` holds."""
    spark = docs.sparkSession
    own = own_columns(docs.where(F.lit(True) if learn is None else learn), "text", "lang").select(F.col("text").cast("string").alias("t"), F.col("lang").cast("string").alias("lang"))
    own = own.where("t IS NOT NULL AND lang IS NOT NULL")
    share = own.groupBy("lang").agg(F.count("*").alias("of")).select("lang", (F.lit(2 * texts * 1_000_000) / F.col("of")).alias("share"))
    some = (own.withColumn("h", F.xxhash64("t")).join(broadcast_if_small(share, 100_000), "lang").where(F.abs(F.col("h") % 1_000_000) < F.col("share"))
            .select("lang", "h", F.substring("t", 1, chars).alias("t")).dropDuplicates(["lang", "h"]))
    sample = top_k_per_group(some, ["lang"], [F.asc("h")], texts).select("lang", "t")
    counted = sample.mapInArrow(count_grams, COUNTS).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()), key=str.encode)
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in counted.column("lang").to_pylist()], np.int64)
    k, gram, n = (counted.column(c).to_numpy() for c in ("k", "gram", "n"))
    return Trees(langs, [(lang[k == i], gram[k == i], n[k == i]) for i in range(ORDER + 1)])


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    own = own_columns(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.ready()
        for b in batches:
            lang, score = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out, predicts all."""
    return predict(docs, train(docs, ~held_out()))
