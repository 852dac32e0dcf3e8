"""Lexical retrieval: BM25 Okapi as ordinary tables.

Documents are dealt to shards by the hash of their id and numbered within
their shard in corpus order. Index layout (all DataFrames):

* ``docs(shard, num, doc_id, pos, dl)``     every document, empty ones included
* ``terms(term, df, idf)``                  vocabulary with epsilon-floored idf
* ``postings(shard, term, docs, tfs, tops)``  one row per term and slice of a shard
  (whole blocks of it, inverted at once): the numbers of its documents, its counts
  there, and for each block of BLOCK numbers that holds the term the largest
  ``tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))``
* ``stats``                                 N, avgdl, avg_idf, k1, b, epsilon (scalars)

``docs`` and ``postings`` are tables bucketed by shard, so a search reads each
shard where it lies, without an exchange before its top-k.

Scoring (the public BM25 Okapi definition): ``idf = ln(N-df+0.5) - ln(df+0.5)``;
``avg_idf`` is the mean raw idf over the vocabulary (negatives included);
every negative idf is replaced by ``epsilon * avg_idf``. A query scores
``sum over its tokens (with repetition) of idf * the above`` for a document.

Search walks the blocks of a shard in the order of what a query could reach
there at most, and stops at the first block that can't reach the shard's k-th
score so far. No row per (query, document) is made: a task gives at most k
rows for each query and shard.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.config import DEFAULTS
from quarry.functions.text import detokenize, tokenize
from quarry.operators.relational import broadcast_if_small, top_k_per_group
from quarry.session import checkpoint_dir, drop_path

#: Documents of a block.
BLOCK = 128
#: Documents of a shard: what a task holds of an index at once.
SHARD_DOCS = 8192
#: Tokens of a slice of a shard on average, if a block has no more: what a task holds of texts when an index is built.
SLICE_TOKENS = 250_000
#: A small corpus is dealt to up to so many shards of at least so many documents, whatever the session's settings.
SHARDS, FEW_DOCS = 64, 512
#: Up to so many shards, each gets a bucket of its own.
LABELLED = 4096
#: (query, term) rows that a search sends to its tasks at once; more are searched in parts.
QUERY_ROWS = 500_000


@dataclass
class LexicalIndex:
    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    stats: dict
    tokens: DataFrame | None = None  # (doc_id, tokens) kept for T5
    owned: list[str] = field(default_factory=list)  # folders that close() deletes

    def close(self) -> None:
        """Delete what the index keeps in the scratch folder; saved indexes stay."""
        for path in self.owned:
            drop_path(self.docs.sparkSession, path)
        self.owned.clear()

    def shard(self) -> LexicalIndex:
        """The index itself: its tables are dealt by document."""
        return self

    def reweighted(self, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> LexicalIndex:
        """The same tables searched with other parameters. What blocks reach at most is then found in the search."""
        return replace(self, stats=self.stats | {"k1": k1, "b": b}, owned=[])

    @property
    def k1(self) -> float:
        return self.stats["k1"]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bucketed(spark: SparkSession, path: str, shards: int, fields: str) -> DataFrame:
    """The table at ``path``, which was written in buckets. The catalog only needs it until it is resolved."""
    name = f"quarry_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (shard) INTO {shards} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    df.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return df


def _write_bucketed(df: DataFrame, path: str, shards: int, mode: str = "errorifexists") -> dict:
    """Write ``df``, which is dealt by shard, with its fingerprint computed in the same job."""
    from pyspark.sql import Observation

    if mode == "overwrite":
        drop_path(df.sparkSession, path)
    obs, name = Observation(f"fp_{os.path.basename(path)}"), f"quarry_{uuid.uuid4().hex}"
    (df.observe(obs, *_fingerprint_exprs(df.columns)).write.format("parquet").option("path", path).bucketBy(shards, "shard").saveAsTable(name))
    df.sparkSession.sql(f"DROP TABLE {name}")
    return _fp_dict(obs.get)


def _shard_of(spark: SparkSession, id_col: str, shards: int) -> Column:
    """The shard of a document. Shards are numbers that Spark's bucketing puts into a bucket each (many shards
    need no such care), so that tasks get one each."""
    nth = F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).cast("int")
    if shards > LABELLED:
        return nth
    bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(shards))
    wide = spark.range(max(64, 32 * shards)).select(F.col("id").cast("int").alias("id"), bucket.alias("bucket"))
    label = {r["bucket"]: r["id"] for r in wide.groupBy("bucket").agg(F.min("id").alias("id")).collect()}
    return F.element_at(F.array(*[F.lit(label.get(k, k)).cast("int") for k in range(shards)]), nth + 1)


def build_lexical_index(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                        pos_col: str | None = None, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b,
                        epsilon: float = DEFAULTS.bm25_epsilon, keep_tokens: bool = True,
                        path: str | None = None) -> LexicalIndex:
    """L1 + L2: build the BM25 tables from a corpus DataFrame.

    ``pos_col`` is the corpus order used to break score ties (the reference
    keeps file order); it defaults to the id column. The tables are written: to
    ``path`` as a saved index (S7), else to the checkpoint folder, until ``close``.
    Token arrays are shuffled once, by shard; all else happens within shards.
    """
    spark = corpus.sparkSession
    n_docs = corpus.count()
    if n_docs == 0:
        raise ValueError("cannot build a lexical index over an empty corpus")
    shards = max(1, math.ceil(n_docs / SHARD_DOCS), min(SHARDS, math.ceil(n_docs / FEW_DOCS)))
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/quarry-lexical-{uuid.uuid4().hex}"
    root = path or scratch

    tok = corpus.select(F.col(id_col).alias("doc_id"), F.col(pos_col or id_col).alias("pos"),
                        tokenize(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tokens"))
    dealt = tok.withColumn("shard", _shard_of(spark, "doc_id", shards)).repartition(shards, "shard")
    in_order = F.row_number().over(Window.partitionBy("shard").orderBy("pos", "doc_id")) - 1
    dealt = dealt.select("shard", in_order.cast("int").alias("num"), "doc_id", "pos", F.size("tokens").cast("bigint").alias("dl"), "tokens")
    _write_bucketed(dealt, f"{scratch}/dealt", shards)
    dealt = _bucketed(spark, f"{scratch}/dealt", shards, _fields(dealt))
    avgdl = float(dealt.agg(F.sum("dl").alias("t")).first()["t"] or 0) / n_docs

    own = {"k1": k1, "b": b, "avgdl": avgdl, "block": BLOCK}
    width = BLOCK * max(1, int(SLICE_TOKENS / max(avgdl, 1.0) / BLOCK))
    slices = dealt.select("shard", F.floor(F.col("num") / width).alias("slice"), "num", "dl", "tokens").groupBy("shard", "slice")
    checks = {"postings": _write_bucketed(slices.applyInArrow(lambda t: _invert(t, own), POSTINGS), f"{root}/postings", shards, "overwrite" if path else "errorifexists")}
    postings = _bucketed(spark, f"{root}/postings", shards, POSTINGS)
    terms, avg_idf, vocabulary = term_stats(postings, n_docs, epsilon, F.sum(F.size("docs")).cast("bigint"))
    stats = {"N": n_docs, "avgdl": avgdl, "avg_idf": avg_idf, "k1": k1, "b": b, "epsilon": epsilon, "vocabulary": vocabulary,
             "shards": shards, "tops": [k1, b], "block": BLOCK}
    checks["terms"] = _write_observed(terms, f"{root}/terms", "overwrite")
    index = LexicalIndex(docs=dealt.drop("tokens"), terms=spark.read.parquet(f"{root}/terms"), postings=postings, stats=stats,
                         tokens=dealt.select("doc_id", "tokens") if keep_tokens else None, owned=[scratch])
    if path:
        _save(index, path, "overwrite", checks)
        index.close()
        return load_lexical_index(spark, path, verify=False)
    return index


POSTINGS = "shard int, term string, docs array<int>, tfs array<int>, tops array<double>"


def _factors(tf: np.ndarray, dl: np.ndarray, own: dict) -> np.ndarray:
    avgdl = own["avgdl"] if own["avgdl"] > 0 else 1.0
    return tf * (own["k1"] + 1) / (tf + own["k1"] * (1 - own["b"] + own["b"] * dl / avgdl))


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def _invert(docs: pa.Table, own: dict) -> pa.Table:
    """Postings of a slice of one shard's documents (shard, num, dl, tokens): numbers without a gap, whole blocks."""
    tokens = docs["tokens"].combine_chunks()
    terms = tokens.flatten().dictionary_encode()
    num = docs["num"].to_numpy()
    first = num.min()
    num = num - first
    dl = np.zeros(len(num), np.int64)
    dl[num] = docs["dl"].to_numpy()
    key, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(num) + np.repeat(num, docs["dl"].to_numpy()), return_counts=True)
    code, num = key // len(dl), key % len(dl)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    block = np.flatnonzero(np.diff(code * len(dl) + num // own["block"], prepend=-1))
    tops = np.maximum.reduceat(_factors(tf, dl[num], own), block) if len(block) else np.zeros(0)
    return pa.table([pa.array(np.full(len(starts), docs["shard"][0].as_py(), np.int32)), terms.dictionary.take(pa.array(code[starts])).cast(pa.string()),
                     _lists((num + first).astype(np.int32), starts, pa.int32()), _lists(tf.astype(np.int32), starts, pa.int32()),
                     _lists(tops, np.searchsorted(block, starts), pa.float64())], names=["shard", "term", "docs", "tfs", "tops"])


def term_stats(postings: DataFrame, n_docs: int, epsilon: float = DEFAULTS.bm25_epsilon, df: Column | None = None):
    """L2: document frequency and epsilon-floored idf per term.

    ``idf = ln(N - df + 0.5) - ln(df + 0.5)``; ``avg_idf`` is the mean raw idf
    over the vocabulary (one scalar aggregate); every negative idf becomes
    ``epsilon * avg_idf``. ``df`` is the aggregate that counts a term's documents, by
    default its rows. Returns ``(terms(term, df, idf), avg_idf, vocabulary)``.
    """
    raw_idf = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms_raw = postings.groupBy("term").agg((F.count("*") if df is None else df).alias("df")).withColumn("raw_idf", raw_idf)
    avg_row = terms_raw.agg(F.avg("raw_idf").alias("a"), F.count("*").alias("v")).first()
    avg_idf = float(avg_row["a"]) if avg_row["a"] is not None else 0.0
    floor = epsilon * avg_idf
    terms = terms_raw.select(
        "term", "df", F.when(F.col("raw_idf") < 0, F.lit(floor)).otherwise(F.col("raw_idf")).alias("idf"))
    return terms, avg_idf, int(avg_row["v"])


def query_terms(queries: DataFrame, query_id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """Query tokens with their multiplicity ``qtf`` (repetition counts)."""
    return (queries.select(F.col(query_id_col).alias("query_id"),
                           F.explode(tokenize(F.coalesce(F.col(query_col), F.lit("")))).alias("term"))
                   .groupBy("query_id", "term").agg(F.count("*").alias("qtf")))


class _Shard:
    """One shard's postings of the terms that a batch of queries asks for."""

    def __init__(self, postings: pa.Table, docs: pa.Table, own: dict):
        self.own, self.block = own, own.get("block", BLOCK)
        num = docs["num"].to_numpy()
        order = np.argsort(num, kind="stable")
        self.ids, self.pos = docs["doc_id"].take(pa.array(order)), docs["pos"].take(pa.array(order))
        self.dl = docs["dl"].to_numpy()[order]
        self.row: dict[str, int] = {}
        self.slices: list[list[int]] = []  # a term's rows
        for k, t in enumerate(postings["term"].to_pylist()):
            if self.row.setdefault(t, len(self.slices)) == len(self.slices):
                self.slices.append([])
            self.slices[self.row[t]].append(k)
        self.lists = [postings[c].combine_chunks() for c in ("docs", "tfs", "tops")] if postings.num_rows else []
        self.known: dict[int, tuple] = {}

    def term(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, counts, blocks, where each begins (and the end), and what each reaches at most."""
        if row not in self.known:
            slices = sorted(([x[k].values.to_numpy() for x in self.lists] for k in self.slices[row]), key=lambda s: s[0][0])
            docs, tfs, tops = (np.concatenate(x) for x in zip(*slices))
            starts = np.flatnonzero(np.diff(docs // self.block, prepend=-1))
            if not self.own["stored"]:
                tops = np.maximum.reduceat(_factors(tfs, self.dl[docs], self.own), starts)
            self.known[row] = docs, tfs, docs[starts] // self.block, np.append(starts, len(docs)), tops
        return self.known[row]

    def search(self, rows: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents with a term, best first, equal ones in corpus order."""
        blocks = -(-len(self.dl) // self.block)
        most, there = np.zeros(blocks), np.zeros(blocks, bool)
        terms = [self.term(r) for r in rows]
        for (_, _, b, _, tops), w in zip(terms, weights):
            there[b] = True
            if w > 0:
                most[b] += w * tops
        order = np.flatnonzero(there)
        order = order[np.argsort(-most[order], kind="stable")]
        num, score = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, max(4, 2 * k // self.block)
        while at < len(order):
            chunk = order[at:at + step]
            if len(num) >= k:  # sums differ in their last digits only
                chunk = chunk[most[chunk] >= score[-1] - 1e-8]
                if not len(chunk):
                    break
            at, step = at + step, 2 * step
            slot = np.full(blocks, -1)
            slot[chunk] = np.arange(len(chunk))
            total, hit = np.zeros(len(chunk) * self.block), np.zeros(len(chunk) * self.block, bool)
            for (docs, tfs, b, starts, _), w in zip(terms, weights):
                own = np.flatnonzero(slot[b] >= 0)
                size = starts[own + 1] - starts[own]
                i = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                d = docs[i]
                place = slot[d // self.block] * self.block + d % self.block
                total[place] += w * _factors(tfs[i], self.dl[d], self.own)
                hit[place] = True
            found = np.flatnonzero(hit)
            num = np.concatenate([num, chunk[found // self.block] * self.block + found % self.block])
            score = np.concatenate([score, total[found]])
            best = np.lexsort((num, -np.round(score, 9)))[:k]
            num, score = num[best], score[best]
        return num, score

    def padded(self, rows: list[int], num: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """With documents of score 0 that hold none of the terms, first ones first, where fewer than k score above 0."""
        if (score > 0).sum() >= k:
            return num, score
        other = np.ones(len(self.dl), bool)
        for r in rows:
            other[self.term(r)[0]] = False
        zeros = np.flatnonzero(other)[:k]
        return np.concatenate([num, zeros]), np.concatenate([score, np.zeros(len(zeros))])


def _search_part(index: LexicalIndex, qt: pa.Table, query_ids: pa.Array, k: int, pad_zero: bool) -> DataFrame:
    """Each shard's best for some queries: ``qt`` (query_id, term, weight)."""
    spark = index.docs.sparkSession
    qt = qt.sort_by([("query_id", "ascending"), ("term", "ascending")])
    asked = qt["term"].to_pylist()
    number = {q: n for n, q in enumerate(query_ids.to_pylist())}
    queries: list[tuple[list[str], list[float]]] = [([], []) for _ in number]
    for q, t, w in zip(qt["query_id"].to_pylist(), asked, qt["weight"].to_pylist()):
        queries[number[q]][0].append(t)
        queries[number[q]][1].append(w)
    shared = spark.sparkContext.broadcast((queries, query_ids))
    st = index.stats
    own = {"k1": st["k1"], "b": st["b"], "avgdl": st["avgdl"], "stored": st.get("tops") == [st["k1"], st["b"]], "block": st.get("block", BLOCK)}
    types = {"query_id": query_ids.type, "doc_id": to_arrow_type(index.docs.schema["doc_id"].dataType), "pos": to_arrow_type(index.docs.schema["pos"].dataType)}
    schema = pa.schema([*types.items(), ("score", pa.float64())])

    def run(postings: pa.Table, docs: pa.Table) -> pa.Table:
        queries, ids = shared.value
        shard, out = _Shard(postings, docs, own), []
        for n, (terms, weights) in enumerate(queries):
            known = [(shard.row[t], w) for t, w in zip(terms, weights) if t in shard.row]
            if not known and not pad_zero:
                continue
            rows, ws = [r for r, _ in known], [w for _, w in known]
            num, score = shard.search(rows, ws, k)
            if pad_zero:
                num, score = shard.padded(rows, num, score, k)
            out.append((np.full(len(num), n), num, score))
        if not out:
            return schema.empty_table()
        n, num, score = (np.concatenate(c) for c in zip(*out))
        return pa.table([ids.take(pa.array(n)).cast(types["query_id"]), shard.ids.take(pa.array(num)).cast(types["doc_id"]), shard.pos.take(pa.array(num)).cast(types["pos"]),
                         pa.array(score, pa.float64())], schema=schema)

    terms = spark.createDataFrame([(t,) for t in sorted(set(asked))], "term string")
    some = index.postings.join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "docs", "tfs", "tops")
    kinds = {c: index.docs.schema[c].dataType.simpleString() for c in ("doc_id", "pos")}
    return (some.groupBy("shard").cogroup(index.docs.select("shard", "num", "doc_id", "pos", "dl").groupBy("shard"))
            .applyInArrow(run, f"query_id {_simple(query_ids.type)}, doc_id {kinds['doc_id']}, pos {kinds['pos']}, score double"))


def _simple(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int = 100,
                query_id_col: str = "query_id", query_col: str = "query",
                pad_zero: bool = False, max_broadcast_rows: int = QUERY_ROWS) -> DataFrame:
    """Top-k documents per query -> ``run(query_id, doc_id, score, rank)``.

    Order: score desc (rounded to 9 decimals so summation order cannot flip
    ties), then corpus position asc.

    The queries' terms with their weights go to the tasks, at most ``max_broadcast_rows``
    of them at once; more queries are searched in parts. Each shard gives its k
    best for every query.

    Default (deviation, documented): only documents with at least one query
    term of non-zero idf are returned. ``pad_zero=True`` reproduces the
    reference, which always returns ``min(k, N)`` rows and fills with
    zero-score documents in corpus order; those, too, come from the shards.
    """
    if index is None:
        raise ValueError("index is not built or loaded")
    qt = query_terms(queries, query_id_col, query_col)
    qt = (index.terms.filter(F.col("idf") != 0).select("term", "idf").join(broadcast_if_small(qt, max_broadcast_rows), "term")
          .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    ids = queries.select(F.col(query_id_col).alias("query_id")).distinct()
    rows = qt.limit(max_broadcast_rows + 1).toArrow()
    if rows.num_rows <= max_broadcast_rows and (not pad_zero or ids.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows):
        known = ids.toArrow()["query_id"].combine_chunks() if pad_zero else rows["query_id"].combine_chunks().unique()
        out = _search_part(index, rows, known, k, pad_zero)
    else:
        n = math.ceil(2 * max(qt.count(), ids.count()) / max_broadcast_rows)
        part = F.pmod(F.xxhash64("query_id"), F.lit(n))
        out = None
        for i in range(n):
            rows = qt.where(part == i).toArrow()
            known = ids.where(part == i).toArrow()["query_id"].combine_chunks() if pad_zero else rows["query_id"].combine_chunks().unique()
            some = _search_part(index, rows, known, k, pad_zero)
            out = some if out is None else out.unionByName(some)
    top = top_k_per_group(out, ["query_id"], [F.desc(F.round("score", 9)), F.asc("pos")], k)
    return top.select("query_id", "doc_id", "score", "rank")


def doc_text(index: LexicalIndex, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """T5: text rebuilt from stored tokens; "" for unknown ids (left join)."""
    if index.tokens is None:
        raise ValueError("index was built without tokens")
    t = index.tokens.select(F.col("doc_id").alias(id_col), detokenize("tokens").alias("text"))
    return ids.join(t, id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


# ---------------------------------------------------------------- S7 / S8

def _fingerprint_exprs(cols: list[str]):
    h = F.xxhash64(*[F.col(c) for c in cols])
    h2 = F.xxhash64(F.lit("quarry"), *[F.col(c) for c in cols])
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h2).alias("x")]


def _fp_dict(row) -> dict:
    return {"n": int(row["n"]), "s": str(row["s"]), "x": int(row["x"] or 0)}


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> dict:
    """Order- and partition-independent fingerprint of a table.

    count, sum of 64-bit row hashes (as exact decimal) and xor of salted row
    hashes; computed in one distributed aggregate.
    """
    return _fp_dict(df.agg(*_fingerprint_exprs(cols or df.columns)).first())


def _write_observed(df: DataFrame, path: str, mode: str) -> dict:
    """Write ``df`` and compute its fingerprint in the same job
    (``DataFrame.observe``), so the written table is not scanned again."""
    from pyspark.sql import Observation

    obs = Observation(f"fp_{os.path.basename(path)}")
    df.observe(obs, *_fingerprint_exprs(df.columns)).write.mode(mode).parquet(path)
    return _fp_dict(obs.get)


def save_lexical_index(index: LexicalIndex, path: str, mode: str = "overwrite") -> None:
    """Write the index tables as Parquet plus a JSON with parameters
    and per-table fingerprints (computed while writing). Documents and postings
    stay dealt by shard, so neither saving nor loading shuffles them."""
    _save(index, path, mode, {})


def _save(index: LexicalIndex, path: str, mode: str, checks: dict) -> None:
    shards = index.stats["shards"]
    checks = dict(checks)
    checks["docs"] = _write_bucketed(index.docs, os.path.join(path, "docs"), shards, mode)
    if "postings" not in checks:
        checks["postings"] = _write_bucketed(index.postings, os.path.join(path, "postings"), shards, mode)
    if "terms" not in checks:
        checks["terms"] = _write_observed(index.terms, os.path.join(path, "terms"), mode)
    if index.tokens is not None:
        checks["tokens"] = _write_observed(index.tokens, os.path.join(path, "tokens"), mode)
    sp = index.docs.sparkSession
    meta = dict(index.stats)
    meta["checksums"] = checks
    meta["fields"] = {"docs": _fields(index.docs), "postings": _fields(index.postings)}
    # the metadata file is tiny; write it through Spark so any shared
    # filesystem the cluster uses works
    sp.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
      .write.mode(mode).text(os.path.join(path, "meta"))


def load_lexical_index(spark: SparkSession, path: str, verify: bool = True) -> LexicalIndex:
    """S7 + L6: reload; raise FileNotFoundError if absent and ValueError if a
    table's fingerprint differs from the stored one."""
    meta_path = os.path.join(path, "meta")
    try:
        meta = json.loads(spark.read.text(meta_path).first()["value"])
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no lexical index at {path}") from exc
    # the tables that were written are those that have a fingerprint
    kinds = meta["fields"]  # a table without rows has no files to tell
    tables = {n: (spark.read.schema(kinds[n]) if n in kinds else spark.read).parquet(os.path.join(path, n)) for n in meta["checksums"]}
    if verify:
        for name, df in tables.items():
            if fingerprint(df) != meta["checksums"][name]:
                raise ValueError(f"checksum mismatch for index table {name}")
    stats = {k: v for k, v in meta.items() if k not in ("checksums", "fields")}
    dealt = {n: _bucketed(spark, os.path.join(path, n), stats["shards"], kinds[n]) for n in ("docs", "postings")}
    return LexicalIndex(docs=dealt["docs"], terms=tables["terms"], postings=dealt["postings"],
                        stats=stats, tokens=tables.get("tokens"))


def idf_value(n_docs: int, df: int) -> float:
    """Raw idf (helper for tests)."""
    return math.log(n_docs - df + 0.5) - math.log(df + 0.5)
