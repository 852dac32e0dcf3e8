"""Dense retrieval and search.

Vectors are ``ARRAY<FLOAT>`` columns. Exact top-k (D3) never materialises
the query x corpus product as rows:

* small query sets (size-checked: rows and bytes) are broadcast as one NumPy
  matrix, larger ones in blocks of that size, one after another;
* every vector partition multiplies tiles of bounded bytes and keeps, over
  all its Arrow batches, each query's k best so far; a WindowGroupLimit
  merge picks the final k. Vectors are neither shuffled nor copied.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import _bind, packed_trigrams, set_jaccard, tokenize, trigram_jaccard
from quarry.operators.relational import top_k_per_group
from quarry.session import checkpoint_dir, drop_path

METRICS = ("ip", "cosine", "l2")


# ------------------------------------------------------------ expressions

def dot(a, b) -> Column:
    """Inner product of two array columns, accumulated in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(dot(a, a))


def l2_normalize(v) -> Column:
    """V / ||v||; a zero vector stays zero. Output ``ARRAY<FLOAT>``."""
    v = F.col(v) if isinstance(v, str) else v

    def scale(x):
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))
        return _bind(length, lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(F.lit(0.0)).cast("float")))
    return _bind(v, scale)


def pair_similarity(a, b, metric: str = "ip") -> Column:
    """Similarity where larger is better: ``ip``, ``cosine``, or
    ``l2`` (negated squared Euclidean distance)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        na, nb = norm(a), norm(b)
        return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
    if metric == "l2":
        a = F.col(a) if isinstance(a, str) else a
        b = F.col(b) if isinstance(b, str) else b
        return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
                            F.lit(0.0), lambda acc, x: acc + x)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


# --------------------------------------------------------------- encoders

class Encoder:
    """Plug-in contract: ``encode(df, id_col, text_col) -> (id, embedding)``.

    Model-backed encoders implement ``encode_batch(texts) -> np.ndarray`` and
    inherit the Arrow-batched ``mapInPandas`` driver below; the model is
    loaded lazily once per Python worker.
    """

    dim: int = 0

    def encode_batch(self, texts: list[str]) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError

    def encode(self, df: DataFrame, id_col: str = "id", text_col: str = "text",
               normalize: bool = True) -> DataFrame:
        enc = self
        id_type = df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                m = enc.encode_batch(["" if t is None else t for t in pdf["text"]])
                if normalize:
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                yield pd.DataFrame({"id": pdf["id"], "embedding": list(m.astype(np.float32))})

        src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return src.mapInPandas(run, f"id {id_type}, embedding array<float>")


class HashingEncoder(Encoder):
    """Signed feature hashing of T1 tokens, in SQL: the md5 of ``seed:token`` gives each
    token a place and a sign, which are added up within the row: no row is made for a
    token, and nothing is shuffled."""

    def __init__(self, dim: int = 384, seed: int = 0):
        self.dim = dim
        self.seed = seed

    def encode(self, df, id_col="id", text_col="text", normalize=True):
        # 60 bits of the hash: the lowest is the sign, the others give the place
        def code(token):
            h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{self.seed}:"), token)), 1, 15), 16, 10).cast("bigint")
            return (2 * F.pmod(F.shiftright(h, 1), F.lit(self.dim)) + F.pmod(h, F.lit(2))).cast("int")

        def places(codes):  # tokens added to a place less those subtracted: the others count on both sides
            return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: (F.size(F.array_remove(codes, 2 * i + 1)) - F.size(F.array_remove(codes, 2 * i))).cast("float"))

        tokens = tokenize(F.coalesce(F.col(text_col), F.lit("")))
        out = df.select(F.col(id_col).alias("id"), _bind(F.transform(tokens, code), places).alias("embedding"))
        return out.select("id", l2_normalize("embedding").alias("embedding")) if normalize else out


class LetterEncoder(Encoder):
    """Deterministic SQL stand-in: counts of the letters a-z in the
    lower-cased text (dim 26). Pure Spark SQL - no Python stage - and the
    same expression is reproducible in other SQL engines."""

    dim = 26

    def encode(self, df, id_col="id", text_col="text", normalize=True):
        t = F.lower(F.coalesce(F.col(text_col), F.lit("")))

        def counts(s):
            return F.transform(F.sequence(F.lit(97), F.lit(122)),
                               lambda c: (F.octet_length(s) - F.octet_length(F.replace(s, F.chr(c), F.lit("")))).cast("float"))  # a letter is a byte
        v = _bind(t, counts)
        if normalize:
            v = l2_normalize(v)
        return df.select(F.col(id_col).alias("id"), v.alias("embedding"))


def encode(df: DataFrame, encoder: Encoder, kind: str | None = "passage", normalize: bool = True,
           id_col: str = "id", text_col: str = "text") -> DataFrame:
    """D1 (+T8): encode texts with a plug-in encoder -> ``(id, embedding)``.

    ``kind`` adds the encoder's input prefix ("query: " / "passage: ");
    ``None`` encodes the raw text. Only the id and text columns reach the
    Python stage."""
    from quarry.functions.text import with_prefix
    t = F.col(text_col) if kind is None else with_prefix(F.coalesce(F.col(text_col), F.lit("")), kind)
    src = df.select(F.col(id_col).alias("id"), t.alias("text"))
    return encoder.encode(src, "id", "text", normalize=normalize)


# --------------------------------------------------------------- exact top-k

def _scores(Q: np.ndarray, V: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return Q @ V.T
    if metric == "cosine":
        qn = np.linalg.norm(Q, axis=1, keepdims=True)
        vn = np.linalg.norm(V, axis=1, keepdims=True)
        Qn = np.divide(Q, qn, out=np.zeros_like(Q), where=qn > 0)
        Vn = np.divide(V, vn, out=np.zeros_like(V), where=vn > 0)
        return Qn @ Vn.T
    if metric == "l2":
        return -(np.sum(Q * Q, axis=1)[:, None] - 2 * Q @ V.T + np.sum(V * V, axis=1)[None, :])
    raise ValueError(f"unknown metric {metric!r}")


#: Bytes of the largest matrix of scores that exists at once in a task.
TILE_BYTES = 32 << 20
#: Pairs of a query and an id left out that a block of queries brings along.
EXCLUDED = 2_000_000
#: Queries that one job of a search in blocks takes at most, unless a block is larger.
JOB_ROWS = 20_000
#: Rows of results that a group of an approximate search hands over at most.
RUN_ROWS = 1_000_000
#: Vectors and pairs of a group that re-scores candidates at most, and pairs that are worth a group of their own.
GRID_VECTORS, GRID_PAIRS, FEW_PAIRS = 200_000, 4_000_000, 100_000
#: Rows and bytes of a parcel at most.
PARCEL_ROWS, PARCEL_BYTES = 65_536, 4 << 20


def flat_search(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "ip",
                exclude_self: bool = False, query_id_col: str = "query_id",
                id_col: str = "id", vec_col: str = "embedding",
                max_query_rows: int = 200_000, max_query_bytes: int = 64 << 20,
                block_rows: int = 20_000, group_col: str | None = None,
                group_mode: str = "same", exclude: DataFrame | None = None) -> DataFrame:
    """D3: exact top-k per query -> ``(query_id, doc_id, score, rank)``.

    Ties: score desc (rounded to 9 decimals), then doc id asc.
    ``group_col`` (present on both sides) restricts candidates to vectors of
    the ``same`` group or to ``other`` groups; ``exclude`` (query_id, doc_id) names
    pairs that are left out. Both are masks inside the block product, so
    they never make rows and don't change how many candidates are kept.

    The queries, with what they keep, go to the tasks as one matrix if they
    have at most ``max_query_rows`` rows and ``max_query_bytes`` bytes; else in
    jobs of that size (JOB_ROWS or a block at most), one after another, whose
    results are written; a tile has ``block_rows`` of them at most. Vectors are never shuffled or copied: a task multiplies
    tiles of queries and vectors, no larger than TILE_BYTES, and keeps each
    query's k best so far. Null vectors take no part; a NaN in one is an error.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if group_mode not in ("same", "other"):
        raise ValueError("group_mode must be 'same' or 'other'")
    spark = queries.sparkSession
    gq = [F.col(group_col).alias("g")] if group_col else [F.lit(0).alias("g")]
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("qv"), *gq)
    v = vectors.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("v"), *gq)  # null vectors are left out where they are read: a filter would make vectors twice
    made = vectors.schema[vec_col].dataType.simpleString()
    mask = group_mode if group_col else None
    first = v.where("v IS NOT NULL").select(F.size("v").alias("d")).limit(1).collect()
    dim = first[0]["d"] if first else 0
    fits = max(1, max_query_bytes // (8 * max(dim, 1) + 24 * k))
    if exclude is not None:
        exclude = exclude.select("query_id", "doc_id").distinct()
    order = [F.desc(F.round("score", 9)), F.asc("doc_id")]
    if q.limit(min(max_query_rows, fits) + 1).count() <= min(max_query_rows, fits) and (exclude is None or exclude.limit(EXCLUDED + 1).count() <= EXCLUDED):
        found = _search_block(q, v, k, metric, exclude_self, dim, mask, exclude)
        return top_k_per_group(found, ["query_id"], order, k).select("query_id", "doc_id", "score", "rank")

    root = f"{checkpoint_dir(spark).rstrip('/')}/quarry-search-{uuid.uuid4().hex}"
    # the jobs read what is written once, whatever made the queries and vectors
    q.write.parquet(f"{root}/asked")
    q = spark.read.schema(q.schema).parquet(f"{root}/asked")
    blocks = math.ceil(max(q.count(), 1) / max(1, min(max(block_rows, JOB_ROWS), fits)))
    if exclude is not None:
        blocks = max(blocks, math.ceil(2 * exclude.count() / EXCLUDED))
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {v.schema['doc_id'].dataType.simpleString()}, score double, rank bigint"
    used = sorted(r["block"] for r in q.select(at).distinct().collect())
    if not used:
        return spark.createDataFrame([], kinds)
    if len(used) > 1:
        v.withColumn("v", F.col("v").cast(made)).write.parquet(f"{root}/vectors")
        v = spark.read.schema(f"doc_id {v.schema['doc_id'].dataType.simpleString()}, v {made}, g {v.schema['g'].dataType.simpleString()}").parquet(f"{root}/vectors").withColumn("v", F.col("v").cast("array<double>"))
    q.select("*", at).write.partitionBy("block").parquet(f"{root}/queries")
    drop_path(spark, f"{root}/asked")
    held = spark.read.schema(q.schema).option("basePath", f"{root}/queries")
    if exclude is not None:
        exclude_kinds = ", ".join(f"{c} {t}" for c, t in exclude.dtypes)
        exclude.select("*", at).write.partitionBy("block").parquet(f"{root}/exclude")
    for n in used:
        some = held.parquet(f"{root}/queries/block={n}").select(*q.columns)
        out = None if exclude is None else spark.read.schema(f"{exclude_kinds}, block int").parquet(f"{root}/exclude").where(F.col("block") == n).select("query_id", "doc_id")
        found = _search_block(some, v, k, metric, exclude_self, dim, mask, out, block_rows)
        top_k_per_group(found, ["query_id"], order, k).select("query_id", "doc_id", "score", "rank").write.mode("append").parquet(f"{root}/found")
    for x in ("queries", "vectors"):
        drop_path(spark, f"{root}/{x}")
    return spark.read.schema(kinds).parquet(f"{root}/found")


def _matrix(col: pa.Array, dim: int, what: str) -> np.ndarray:
    """Vectors of one dimension as rows."""
    if len(col) and pc.unique(col.value_lengths()).to_pylist() != [dim]:
        raise ValueError(f"{what}: dimension mismatch (expected {dim})")
    m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), dim)
    if np.isnan(m).any():
        raise ValueError(f"{what}: NaN")
    return m


def _ids(col: pa.Array) -> np.ndarray:
    """Ids as an array that NumPy can sort."""
    return col.to_numpy(zero_copy_only=False) if pa.types.is_integer(col.type) else np.array(col.to_pylist(), dtype=str)


class _Best:
    """The k best of each query among the vectors seen so far; the last place has the worst of them."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, np.full((queries, 0), -np.inf), None

    def hold(self, ids: np.ndarray, n: int) -> None:
        """Make room for ids of this kind."""
        if self.ids is None:
            self.score, self.ids = np.full((n, self.k), -np.inf), np.zeros((n, self.k), ids.dtype)
        if self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))

    def add(self, rows: slice, S: np.ndarray, ids: np.ndarray, n: int) -> None:
        """S: scores of some queries for vectors whose ids ascend; -inf where they are left out."""
        self.hold(ids, n)
        if not S.size:
            return
        # no vector below the k-th best so far, or below the k-th largest of the maxima of parts of the row, can be among the k best
        c, k = S.shape[1], self.k
        floor = np.round(self.score[rows, k - 1], 9)
        parts = min(c, 8 * k)
        if parts >= k:
            high = S[:, :c // parts * parts].reshape(len(S), -1, parts).max(axis=1)
            floor = np.maximum(floor, np.partition(high, parts - k, axis=1)[:, parts - k])
        take = S >= (floor - (2e-9 + 4e-16 * np.abs(floor)))[:, None]
        if not np.isfinite(floor).all():
            take &= S > -np.inf
        if np.count_nonzero(take) <= S.size // 8:
            self._merge_few(rows, S, ids, take)
        else:
            self._merge_all(rows, S, ids)

    def _merge_few(self, rows: slice, S: np.ndarray, ids: np.ndarray, take: np.ndarray) -> None:
        """With the marked ones, which are few."""
        at, col = np.nonzero(take)
        self.merge_pairs(rows.start, at, ids[col], S[at, col])

    def merge_pairs(self, first: int, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """With single scores: of the queries ``first + at``, for the vectors of these ids."""
        if not len(at):
            return
        n, k = int(at.max()) + 1, self.k
        count = np.bincount(at, minlength=n)
        wide = k + int(count.max())
        if n * wide > 4 * (len(at) + n * k):  # a few rows have most of them
            hit, at = np.unique(at, return_inverse=True)
            return self._merge_sorted(hit + first, at, ids, scores)
        held = slice(first, first + n)
        order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
        at = at[order]
        place = k + np.arange(len(at)) - (np.cumsum(count) - count)[at]
        score, own = np.full((n, wide), -np.inf), np.zeros((n, wide), self.ids.dtype)
        score[:, :k], own[:, :k] = self.score[held], self.ids[held]
        score[at, place], own[at, place] = scores[order], ids[order]
        R = np.round(score, 9)
        kth = np.partition(R, wide - k, axis=1)[:, wide - k][:, None]
        above, equal = R > kth, R == kth
        room = k - above.sum(axis=1)
        tied = np.flatnonzero((equal.sum(axis=1) > room) & (kth[:, 0] > -np.inf))
        cols = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room[:, None])))[1].reshape(n, k)
        if len(tied):  # of equals the smallest ids
            cols[tied] = np.lexsort((own[tied], -R[tied]), axis=1)[:, :k]
        worst = np.argmin(np.take_along_axis(R, cols, axis=1), axis=1)[:, None]
        last = cols[:, -1:].copy()
        cols[:, -1:] = np.take_along_axis(cols, worst, axis=1)
        np.put_along_axis(cols, worst, np.where(worst == k - 1, cols[:, -1:], last), axis=1)
        self.score[held], self.ids[held] = np.take_along_axis(score, cols, axis=1), np.take_along_axis(own, cols, axis=1)

    def _merge_sorted(self, held: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row = np.concatenate([np.repeat(np.arange(len(held)), self.k), at])
        score, own = np.concatenate([self.score[held].ravel(), scores]), np.concatenate([self.ids[held].ravel(), ids])
        order = np.lexsort((own, -np.round(score, 9), row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(held)))
        order = order[np.arange(len(row)) - first[row] < self.k].reshape(len(held), self.k)
        self.score[held], self.ids[held] = score[order], own[order]

    def _merge_all(self, rows: slice, S: np.ndarray, ids: np.ndarray) -> None:
        """With each row's k best of all columns."""
        R, c, k = np.round(S, 9), S.shape[1], self.k
        if c > k:  # above the k-th, and of its equals the smallest ids
            kth = np.partition(R, c - k, axis=1)[:, c - k][:, None]
            above, equal = R > kth, R == kth
            take = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            cols = np.nonzero(take)[1].reshape(len(S), k)
        else:
            cols = np.broadcast_to(np.arange(c), S.shape)
        score, own = np.take_along_axis(S, cols, axis=1), ids[cols]
        score, own = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.ids[rows], own], axis=1)
        order = np.lexsort((own, -np.round(score, 9)), axis=1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores."""
        q, j = np.nonzero(self.score > -np.inf)
        return q, self.ids[q, j] if self.ids is not None else np.zeros(0, np.int64), self.score[q, j]


class _Factors:
    """Vectors as factors of their scores: a query's score of a vector is the product of the two factors plus the query's ``base``.

    ``rough`` are the factors in single precision, or in double where numbers are too large for that. A product of them is off
    by at most ``unit`` times the lengths of both (the usual bound of a sum of products, in whatever order it is added up)."""

    def __init__(self, X: np.ndarray, metric: str, query: bool):
        self.base = np.zeros(len(X))
        if metric == "cosine":
            n = np.linalg.norm(X, axis=1, keepdims=True)
            X = np.divide(X, n, out=np.zeros_like(X), where=n > 0)
        elif metric == "l2":  # -|q - v|^2 = (2q, -1) . (v, |v|^2) - |q|^2
            square = np.sum(X * X, axis=1)
            X = np.column_stack([2 * X, np.full(len(X), -1.0)] if query else [X, square])
            self.base = -square if query else self.base
        self.exact = np.ascontiguousarray(X)
        self.length = np.sqrt(np.einsum("ij,ij->i", X, X))
        self.top = self.length.max(initial=0.0)
        self.single = bool(self.top < 1e15)
        self.rough = self.exact.astype(np.float32) if self.single else self.exact

    def slack(self, other: "_Factors", rows: slice) -> np.ndarray:
        unit = (self.exact.shape[1] + 8) * (2.0 ** -23 if self.single and other.single else 2.0 ** -51)
        return unit * self.length[rows] * other.top


#: Rows and columns of a tile of rough scores, so that it stays in a core's own cache, and pairs that are scored exactly at once.
ROUGH_ROWS, ROUGH_COLS, PAIRS = 256, 1024, 200_000
#: Bytes of the vectors that are gathered at once for single pairs: little enough for a core's own cache.
PAIR_BYTES = 512 << 10


def _marked(take: np.ndarray) -> np.ndarray:
    """The places of the few that are marked, looked for eight at a time."""
    n = len(take) // 8 * 8
    eight = np.flatnonzero(take[:n].view(np.uint64) != 0)
    at, j = np.nonzero(take[:n].reshape(-1, 8)[eight])
    return np.concatenate([8 * eight[at] + j, n + np.flatnonzero(take[n:])])


def _hiding(at_q: np.ndarray, at_v: np.ndarray):
    """hide(S, row, col) for ``_add_products``: the places (query, vector) in the order of the queries that are left out."""
    def hide(S, r, c):
        lo, hi = np.searchsorted(at_q, [r, r + len(S)])
        if lo < hi:
            col = at_v[lo:hi] - c
            here = (col >= 0) & (col < S.shape[1])
            S[at_q[lo:hi][here] - r, col[here]] = -np.inf

    return hide


def _add_products(best: _Best, first: int, A: _Factors, rows: slice, B: _Factors, cols: slice, ids: np.ndarray, hide, high: int = ROUGH_ROWS, before: int = 0) -> None:
    """Take the vectors ``cols`` of B, whose ids ascend, into the best of the queries ``rows`` of A, which are ``first``, ... in best.

    Tiles of rough scores only say which pairs may be among a query's k best: those whose rough score doesn't lie below its
    k-th best so far by more than rough scores are off. Only these few are scored in double precision, in which alone results are
    compared. As long as there is no k-th best a tile is wide enough for k to be few in it. ``before`` says about how many vectors
    best has seen already. hide(S, row, col) sets what is left out of a tile, whose first row and column are named, to -inf."""
    k, n = best.k, cols.stop - cols.start
    opening = max(1, min(n, TILE_BYTES // 8, max(4 * ROUGH_COLS, 40 * k)))
    high = max(1, min(rows.stop - rows.start, high, ROUGH_ROWS, TILE_BYTES // (8 * opening)))
    wide = max(1, min(n, ROUGH_ROWS * ROUGH_COLS // high, 16 * ROUGH_COLS, TILE_BYTES // (8 * high)))
    opening = max(opening, wide)
    single = A.single and B.single
    left, right = (A.rough, B.rough) if single else (A.exact, B.exact)
    space, marks = np.empty(high * opening, left.dtype), np.empty(high * opening, bool)
    few = max(1, PAIR_BYTES // (8 * max(1, A.exact.shape[1])))
    for r in range(rows.start, rows.stop, high):
        some = slice(r, min(r + high, rows.stop))
        at0, slack, base = first + r - rows.start, A.slack(B, some), A.base[some]
        held = slice(at0, at0 + some.stop - some.start)
        found, pairs, due, c = [], 0, cols.start, cols.start

        def merge():
            if not pairs:
                return
            at, col = (np.concatenate(x) for x in zip(*found))
            score = base[at]
            for i in range(0, len(at), few):
                j = slice(i, i + few)
                score[j] += np.einsum("ij,ij->i", A.exact[r + at[j]], B.exact[col[j]])
            take = score >= np.round(best.score[held, k - 1], 9)[at] - 2e-9
            best.merge_pairs(at0, at[take], ids[col[take]], score[take])

        def least_of(bound):
            least = np.nextafter(bound.astype(left.dtype), left.dtype.type(-np.inf))[:, None]
            return least, bool(np.isfinite(least).all())

        while c < cols.stop:
            if c >= due or pairs > PAIRS:  # after 1, 2, 4, ... tiles the k-th best has risen
                merge()
                found, pairs, due = [], 0, c + max(wide, before + c - cols.start)
                floor = np.round(best.score[held, k - 1], 9)
                opens = not np.isfinite(floor).all()
                floor = floor - base - 2e-9 - 1e-15 * (np.abs(floor) + np.abs(base)) - 2 * slack
                known = least_of(floor)
            own = slice(c, min(c + (opening if opens else wide), cols.stop))
            w = own.stop - c
            S = np.matmul(left[some], right[own].T, out=space[:len(slack) * w].reshape(len(slack), w))
            hide(S, r, c)
            take = marks[:S.size].reshape(S.shape)
            for tighten in (opens, True):
                least, finite = known
                if tighten:  # nor below the k-th largest of the maxima of parts of the row
                    parts, bound = min(w, 8 * k), floor
                    if parts >= k:
                        top = S[:, :w // parts * parts].reshape(len(S), -1, parts).max(axis=1)
                        bound = np.maximum(floor, np.partition(top, parts - k, axis=1)[:, parts - k] - 2e-9 - 2 * slack)
                    least, finite = least_of(bound)
                np.greater_equal(S, least, out=take)
                if not finite:
                    take &= S > -np.inf
                many = np.count_nonzero(take)
                if many <= S.size // 32:
                    break
            if many > S.size // 8:  # many equals, or as many as are wanted
                full = A.exact[some] @ B.exact[own].T + base[:, None]
                full[S == -np.inf] = -np.inf
                best.add(held, full, ids[own], len(best.score))
            elif many:
                at, col = np.divmod(_marked(take.ravel()), w)
                found.append((at, col + c))
                pairs += many
            c = own.stop
        merge()


def _left_out(qids: np.ndarray, ids: np.ndarray, exclude_self: bool, pairs: tuple[np.ndarray, np.ndarray] | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of a batch that are left out. pairs: query numbers and ids; rows: numbers of the queries."""
    who, what = [], []
    if exclude_self and qids.dtype.kind == ids.dtype.kind:
        who.append(rows)
        what.append(qids)
    if pairs is not None:
        who.append(pairs[0])
        what.append(pairs[1])
    at_q, at_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, x in zip(who, what):
        lo, hi = np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")
        n = hi - lo  # an id may have several vectors
        at_q.append(np.repeat(w, n))
        at_v.append(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
    at_q, at_v = np.concatenate(at_q), np.concatenate(at_v)
    order = np.argsort(at_q, kind="stable")
    return at_q[order], at_v[order]


def tile_shape(queries: int, vectors: int) -> tuple[int, int]:
    """Rows and columns of the tiles that a matrix of scores is made in: TILE_BYTES at most."""
    wide = min(max(vectors, 1), 4096, max(1, TILE_BYTES // 8))
    return min(max(queries, 1), max(1, TILE_BYTES // (8 * wide))), wide


def best_of_tiles(qids: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best vectors of each query: numbers of queries, ids and scores. tile(rows) -> (cols -> scores) gives the
    scores of some queries for some vectors, of which only a tile exists at once. Ties take the smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    high, wide = tile_shape(len(qids), len(ids))
    found = []
    for r in range(0, len(qids), high):
        who = qids[r:r + high]
        best, of, rows = _Best(len(who), k), tile(slice(r, r + high)), np.arange(len(who))
        for c in range(0, len(ids), wide):
            S, own = of(order[c:c + wide]), ids[c:c + wide]
            S[_left_out(who, own, exclude_self, None, rows)] = -np.inf
            best.add(slice(0, len(who)), S, own, len(who))
        n, own, score = best.rows()
        found.append((n + r, own, score))
    if not found:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def found_table(qids: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None, kinds: dict) -> pa.Table:
    """What ``best_of_tiles`` found as rows (query_id, doc_id, score); kinds: the Arrow types of the ids."""
    n, ids, score = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) if found is None else found
    own = pa.array(ids.tolist() if ids.dtype.kind == "U" else ids)
    return pa.table({"query_id": qids.take(pa.array(n)).cast(kinds["query_id"]), "doc_id": own.cast(kinds["doc_id"]), "score": pa.array(score)})


def ranked_table(qids: pa.Array, best: _Best, kinds: dict) -> pa.Table:
    """All that was found for some queries, ranked: (query_id, doc_id, score, rank)."""
    same = qids.dictionary_encode(null_encoding="encode")
    n, ids, score = best.rows()
    who = same.indices.to_numpy()[n]
    if len(same.dictionary) < len(qids):  # a query may be asked with several vectors
        order = np.argsort(who, kind="stable")
        n, ids, score, who = n[order], ids[order], score[order], who[order]
    order = _first(who, score, ids, best.k)
    who = who[order]
    begin = np.flatnonzero(np.append(True, np.diff(who) != 0)) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who)))) + 1
    return found_table(qids, (n[order], ids[order], score[order]), kinds).append_column("rank", pa.array(rank, pa.int64()))


def _search_block(q: DataFrame, v: DataFrame, k: int, metric: str, exclude_self: bool, dim: int,
                  mask: str | None, exclude: DataFrame | None, block_rows: int | None = None) -> DataFrame:
    """Each partition's k best for a block of queries, whose size was checked."""
    spark = q.sparkSession
    kinds = {"query_id": q.schema["query_id"].dataType, "doc_id": v.schema["doc_id"].dataType}
    ddl = f"query_id {kinds['query_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, score double"
    t = q.toArrow()
    t = t.filter(pc.is_valid(t["qv"])).combine_chunks()
    if not t.num_rows or not dim:
        return spark.createDataFrame([], ddl)
    known: dict = {}  # groups as numbers; the queries stand in their order
    group = np.array([known.setdefault(g, len(known)) if mask else 0 for g in t["g"].to_pylist()], dtype=np.int64)
    by_group = np.argsort(group, kind="stable")
    t, group = t.take(pa.array(by_group)).combine_chunks(), group[by_group]
    qid_col = t["query_id"].combine_chunks()
    Q, qids = _matrix(t["qv"].combine_chunks(), dim, "query vectors"), _ids(qid_col)
    pairs = None
    if exclude is not None:
        x = exclude.toArrow().combine_chunks()
        order = np.argsort(qids, kind="stable")
        who = _ids(x["query_id"].combine_chunks()) if x.num_rows else np.zeros(0, qids.dtype)
        lo, hi = np.searchsorted(qids[order], who, "left"), np.searchsorted(qids[order], who, "right")
        n = hi - lo
        at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] if len(who) else np.zeros(0, np.int64)
        pairs = (at, np.repeat(_ids(x["doc_id"].combine_chunks()), n) if len(who) else np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((qid_col, Q, qids, group, known, pairs))
    types = {c: to_arrow_type(x) for c, x in kinds.items()}

    def run(batches):
        qid_col, Q, qids, group, known, pairs = shared.value
        A, best, rows, before = _Factors(Q, metric, True), _Best(len(Q), k), np.arange(len(Q)), 0
        for b in _together(batches, max(1, TILE_BYTES // (16 * dim))):
            V, ids = _matrix(b.column("v"), dim, "corpus vectors"), _ids(b.column("doc_id"))
            vg = np.array([known.get(g, -1) for g in b.column("g").to_pylist()], dtype=np.int64) if mask else np.zeros(len(ids), np.int64)
            parts = np.unique(vg)
            mixed = mask == "other" and 256 * len(parts) > len(vg)  # too many small groups to take one by one
            order = np.lexsort((ids, np.zeros_like(vg) if mixed else vg))
            ids, vg = ids[order], vg[order]
            B = _Factors(V[order], metric, False)
            best.hold(ids, len(Q))
            for g in [None] if mixed else parts:
                cols = slice(0, len(ids)) if mixed else slice(*(int(x) for x in np.searchsorted(vg, [g, g + 1])))
                at_q, at_v = _left_out(qids, ids[cols], exclude_self, pairs, rows)

                left_out = _hiding(at_q, at_v + cols.start)

                def hide(S, r, c):
                    left_out(S, r, c)
                    if mixed:
                        np.putmask(S, np.equal.outer(group[r:r + len(S)], vg[c:c + S.shape[1]]), -np.inf)

                for some in _asked(group, None if mixed else g, mask):
                    _add_products(best, some.start, A, some, B, cols, ids, hide, block_rows or ROUGH_ROWS, before)
            before += 0 if mask else len(ids)
        n, ids, score = best.rows()
        for k0 in range(0, len(n), 1 << 16):
            at = slice(k0, k0 + (1 << 16))
            yield pa.RecordBatch.from_arrays([qid_col.take(pa.array(n[at])).cast(types["query_id"]), pa.array(ids[at].tolist() if ids.dtype.kind == "U" else ids[at], types["doc_id"]),
                                              pa.array(score[at])], names=["query_id", "doc_id", "score"])

    return v.select("doc_id", "v", "g").mapInArrow(run, ddl)


def _together(batches: Iterator[pa.RecordBatch], rows: int, column: str = "v") -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows with a vector."""
    held, n = [], 0
    for b in batches:
        b = b.filter(pc.is_valid(b.column(column)))
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _asked(group: np.ndarray, g: int | None, mask: str | None) -> list[slice]:
    """The queries, which stand by group, that take the vectors of group g."""
    lo, hi = (0, len(group)) if mask is None or g is None else (int(x) for x in np.searchsorted(group, [g, g + 1]))
    parts = [slice(0, lo), slice(hi, len(group))] if mask == "other" and g is not None else [slice(lo, hi)]
    return [x for x in parts if x.stop > x.start]


def parcels_of(batch: pa.RecordBatch, keys: list[np.ndarray], rows: int = PARCEL_ROWS) -> Iterator[tuple[list[int], bytes]]:
    """The rows that share keys, ``rows`` of them at most, in Arrow's own format: (keys, parcel)."""
    if not batch.num_rows:
        return
    order = np.lexsort(keys)
    batch, keys = batch.take(pa.array(order)), [x[order] for x in keys]
    ends = np.flatnonzero(np.append(np.any([np.diff(x) != 0 for x in keys], axis=0), True)) + 1
    for at, end in zip([0, *ends[:-1]], ends):
        for lo in range(at, end, rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(lo, min(rows, end - lo)))
            yield [int(x[lo]) for x in keys], sink.getvalue().to_pybytes()


def in_parcels(df: DataFrame, keys: list[str], rows: int = PARCEL_ROWS) -> DataFrame:
    """Rows put together by their keys (integers): (keys, parcel), so that what is dealt out or copied are few rows."""
    def run(batches):
        held, n = [], 0

        def packed():
            whole = pa.concat_batches(held)
            return [pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in own), pa.array([parcel], pa.binary())], names=[*keys, "parcel"])
                    for own, parcel in parcels_of(whole.select([c for c in whole.schema.names if c not in keys]), [whole.column(c).to_numpy() for c in keys], rows)]

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    return df.mapInArrow(run, ", ".join(f"{c} int" for c in keys) + ", parcel binary")


def opened(parcels: pa.ChunkedArray) -> pa.Table:
    """The rows of parcels, of which there is one at least."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in parcels]).combine_chunks()


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Dealt by the keys into more partitions than there are groups, so that few of them share one."""
    return df.repartition(min(8 * groups, 4096), *keys)


def rescore(run: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int,
            metric: str = "ip", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Exact re-scoring of fixed candidates, top-k.

    The candidates are written as pairs of ids and dealt, by the hashes of both, into a grid of blocks of queries and
    shards of vectors; a vector goes once to each block, a query's once to each shard, so that no vector
    is copied for a pair. Pairs and vectors go there in parcels. A group of the grid scores its pairs in slices and hands
    over its k best of each query. A null vector gives a null score (cosine: 0), which ranks last; a NaN in one is an error.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = run.sparkSession
    qv = query_vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL")
    dv = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL")
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-rescore-{uuid.uuid4().hex}"
    run.select("query_id", "doc_id").write.parquet(path)
    pairs = spark.read.schema(run.select("query_id", "doc_id").schema).parquet(path)
    kinds = {c: pairs.schema[c].dataType for c in ("query_id", "doc_id")}
    # ids are dealt by hashes, which need one type on both sides
    qv, dv = qv.withColumn("id", F.col("id").cast(kinds["query_id"])), dv.withColumn("id", F.col("id").cast(kinds["doc_id"]))
    n, nq, nv = pairs.count(), qv.count(), dv.count()
    shards = max(1, math.ceil(nv / GRID_VECTORS))
    blocks = max(1, math.ceil(nq * min(k, max(nv, 1)) / RUN_ROWS), math.ceil(n / (GRID_PAIRS * shards)), min(math.ceil(4 * spark.sparkContext.defaultParallelism / shards), n // FEW_PAIRS))

    def dealt(c, m):
        return F.pmod(F.xxhash64(c), F.lit(m)).cast("int")

    def everywhere(m):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    known = [next((x for x in made.select(F.size("v").alias("d")).where("d > 0").limit(1).collect()), None) for made in (qv, dv)]
    rows = max(1, min(PARCEL_ROWS, PARCEL_BYTES // (8 * max([x["d"] for x in known if x], default=1))))
    there = (in_parcels(qv.select(dealt("id", blocks).alias("b"), "id", "v"), ["b"], rows).select("b", everywhere(shards).alias("s"), F.lit(True).alias("asks"), "parcel")
             .unionByName(in_parcels(dv.select(dealt("id", shards).alias("s"), "id", "v"), ["s"], rows).select(everywhere(blocks).alias("b"), "s", F.lit(False).alias("asks"), "parcel")))
    types = {c: to_arrow_type(x) for c, x in kinds.items()}

    def score(pt: pa.Table, vt: pa.Table) -> pa.Table:
        sides = [opened(own["parcel"]).sort_by("id") for own in (vt.filter(vt["asks"]), vt.filter(pc.invert(vt["asks"]))) if own.num_rows]
        if len(sides) < 2 or not pt.num_rows:
            return found_table(pa.array([], types["query_id"]), None, types)
        (qcol, qids, Q), (_, vids, V) = ((own["id"].combine_chunks(), _ids(own["id"].combine_chunks()), own["v"].combine_chunks()) for own in sides)
        del sides
        named = opened(pt["parcel"])
        named, V, Q = _numbered(_ids(named["query_id"].combine_chunks()), _ids(named["doc_id"].combine_chunks()), qids, vids), _Rows(V), _Rows(Q)
        first, out = np.searchsorted(qids, qids, "left"), []
        step, at = max(1, min(len(named), RUN_ROWS // 2)), 0
        while at < len(named):  # whole queries
            end = len(named) if at + step >= len(named) else int(np.searchsorted(named, max(named[at + step] // len(vids), named[at] // len(vids) + 1) * len(vids)))
            while end < len(named) and qids[named[end] // len(vids)] == qids[named[end - 1] // len(vids)]:  # an id may have several vectors
                end += 1
            qi, vi = np.divmod(named[at:end], len(vids))
            S = _pair_scores(Q, V, qi, vi, metric)
            order = _first(first[qi], S, vids[vi], k)
            out.append((qi[order], vids[vi[order]], S[order]))
            at = end
        if not out:
            return found_table(qcol, None, types)
        qi, own, S = (np.concatenate(x) for x in zip(*out))
        return found_table(qcol, (qi, own, S), types).set_column(2, "score", pa.array(S, from_pandas=True))

    pairs = in_parcels(pairs.where("query_id IS NOT NULL AND doc_id IS NOT NULL").select(dealt("query_id", blocks).alias("b"), dealt("doc_id", shards).alias("s"), "query_id", "doc_id"), ["b", "s"])
    c = (spread(pairs, blocks * shards, "b", "s").groupBy("b", "s").cogroup(spread(there, blocks * shards, "b", "s").groupBy("b", "s"))
         .applyInArrow(score, f"query_id {kinds['query_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, score double"))
    return top_k_per_group(c, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)


def _numbered(who: np.ndarray, what: np.ndarray, qids: np.ndarray, vids: np.ndarray) -> np.ndarray:
    """Pairs of ids as numbers ``query row * vectors + vector row``, ascending and each once. The known ids are sorted; an id may
    have several rows, which all make pairs, and pairs of an unknown one are left out."""
    (ql, qh), (vl, vh) = ((np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")) for ids, x in ((qids, who), (vids, what)))
    qn, many = qh - ql, (qh - ql) * (vh - vl)
    if many.max(initial=0) > 1:
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        each = np.repeat(np.maximum(qn, 1), many)
        ql, vl = np.repeat(ql, many) + j % each, np.repeat(vl, many) + j // each
    else:
        ql, vl = ql[many > 0], vl[many > 0]
    key = np.sort(ql * len(vids) + vl)
    return key[np.append(True, np.diff(key) != 0)] if len(key) else key  # a pair may be named twice


def _first(group: np.ndarray, S: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each group (numbers that ascend), best first: score desc (rounded to 9 decimals), then id asc, NaN last."""
    R = np.where(np.isnan(S), -np.inf, np.round(S, 9))
    begin = np.append(True, np.diff(group) != 0) if len(group) else np.zeros(0, bool)
    row, start = np.cumsum(begin) - 1, np.flatnonzero(begin)
    wide = int(np.diff(np.append(start, len(group))).max(initial=0))
    at = np.arange(len(group))
    if wide > k and len(start) * wide <= 4 * len(group):  # those below the k-th of their group needn't be sorted
        M = np.full((len(start), wide), -np.inf)
        M[row, at - start[row]] = R
        at = np.flatnonzero(R >= np.partition(M, wide - k, axis=1)[:, wide - k][row])
    at = at[np.lexsort((ids[at], -R[at], row[at]))]
    held = row[at]
    return at[np.arange(len(at)) - np.searchsorted(held, held, "left") < k]


class _Rows:
    """Vectors as rows, as they are stored; null ones have no row."""

    def __init__(self, col: pa.Array):
        some = pc.drop_null(col)
        self.dim = len(some[0]) if len(some) else 0
        if len(some) and pc.unique(some.value_lengths()).to_pylist() != [self.dim]:
            raise ValueError(f"vectors: dimension mismatch (expected {self.dim})")
        self.X = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), self.dim)
        if np.isnan(self.X).any():
            raise ValueError("vectors: NaN")
        self.known = np.asarray(pc.is_valid(col))
        self.row = np.cumsum(self.known) - 1

    def lengths(self) -> np.ndarray:
        step = max(1, TILE_BYTES // (16 * max(1, self.dim)))
        return np.concatenate([np.zeros(0), *(np.linalg.norm(self.X[at:at + step].astype(np.float64), axis=1) for at in range(0, len(self.X), step))])


def _pair_scores(Q: _Rows, V: _Rows, qi: np.ndarray, vi: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows as ``pair_similarity`` has them: where a vector is null NaN, for cosine 0."""
    S = np.full(len(qi), 0.0 if metric == "cosine" else np.nan)
    if len(Q.X) and len(V.X) and Q.dim != V.dim:
        raise ValueError(f"vectors: dimension mismatch ({Q.dim} and {V.dim})")
    ok = np.flatnonzero(Q.known[qi] & V.known[vi])
    if metric == "cosine":
        na, nb = Q.lengths(), V.lengths()
    step = max(1, PAIR_BYTES // (8 * max(1, Q.dim)))
    for n in range(0, len(ok), step):
        some = ok[n:n + step]
        i, j = Q.row[qi[some]], V.row[vi[some]]
        a, b = Q.X[i].astype(np.float64, copy=False), V.X[j].astype(np.float64, copy=False)
        if metric == "l2":
            S[some] = -np.einsum("ij,ij->i", a - b, a - b)
            continue
        S[some] = np.einsum("ij,ij->i", a, b)
        if metric == "cosine":
            length = na[i] * nb[j]
            S[some] = np.divide(S[some], length, out=np.zeros(len(some)), where=length > 0)
    return S


def validate_recall(approx: DataFrame, exact: DataFrame, k: int = 10, threshold: float = 0.97) -> DataFrame:
    """Mean recall@k of an approximate run against the exact one."""
    a = approx.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    e = exact.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    hits = a.join(e, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    tot = e.groupBy("query_id").agg(F.count("*").alias("n"))
    per = tot.join(hits, "query_id", "left").select(
        "query_id", (F.coalesce(F.col("h"), F.lit(0)) / F.col("n")).alias("recall"))
    return per.agg(F.avg("recall").alias("recall"), F.count("*").alias("queries")).withColumn(
        "passed", F.col("recall") >= threshold)


# -------------------------------------------------------------- rerank etc.

class OverlapScorer:
    """Scorer stand-in: character-trigram Jaccard of query and passage text
    (T2), pure SQL; its value is already on the [0, 1] confidence scale.

    A text's trigrams don't depend on the other text, so ``features`` are made
    once for each query and document and only compared for each pair."""

    @staticmethod
    def features(text_col: str) -> Column:
        return packed_trigrams(text_col)

    @staticmethod
    def compare(a: Column, b: Column) -> Column:
        return set_jaccard(a, b)

    def score(self, pairs: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
        return pairs.withColumn("teacher_score", trigram_jaccard(query_col, text_col))

    @staticmethod
    def confidence(score: Column) -> Column:
        return score


class LogitScorer(OverlapScorer):
    """Wraps a logit-valued scorer; confidence is ``sigmoid(score)`` (our
    documented choice - the reference's formula is not available)."""

    @staticmethod
    def confidence(score: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-score))


def attach_text(run: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text lookup with "" for unknown ids."""
    t = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return run.join(t, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def score_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, scorer=None) -> DataFrame:
    """``teacher_score`` of (query_id, doc_id) pairs; unknown documents have
    the text "". A scorer with ``features`` and ``compare`` is given each
    candidate document and each query once; any other is given the texts."""
    scorer = scorer or OverlapScorer()
    q = queries.select("query_id", "query")
    if not hasattr(scorer, "features"):
        return scorer.score(attach_text(pairs, corpus).join(q, "query_id")).drop("text", "query")
    docs = corpus.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = docs.select("doc_id", scorer.features("text").alias("__df"))
    q = q.select("query_id", scorer.features("query").alias("__qf"))
    both = pairs.join(q, "query_id").join(docs, "doc_id", "left")
    return both.withColumn("teacher_score", scorer.compare(F.col("__qf"), F.coalesce("__df", F.array().cast("array<bigint>")))).drop("__qf", "__df")


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, scorer=None, k: int = 10,
           min_confidence: float | None = None) -> DataFrame:
    """Replace scores with the scorer's, re-sort and re-rank, cut to k.

    ``min_confidence`` (Q28, second meaning) drops results whose confidence
    is below it. Repartitioning by query keeps the scorer's input local.
    """
    scored = score_pairs(run.select("query_id", "doc_id"), queries, corpus, scorer).withColumn("score", F.col("teacher_score"))
    scorer = scorer or OverlapScorer()
    if min_confidence is not None:
        scored = scored.filter(scorer.confidence(F.col("teacher_score")) >= min_confidence)
    out = top_k_per_group(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)
    return out.select("query_id", "doc_id", "score", "rank")


def gated_rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, threshold: float = 0.6,
                 importance: DataFrame | None = None, scorer=None, k: int = 10) -> DataFrame:
    """Rerank a query's list when its best score is below ``threshold``;
    importance 'high' always reranks, 'low' never. Adds ``reason``."""
    best = run.groupBy("query_id").agg(F.max("score").alias("best"))
    if importance is not None:
        best = best.join(importance.select("query_id", "importance"), "query_id", "left")
    else:
        best = best.withColumn("importance", F.lit(None).cast("string"))
    reason = (F.when(F.col("importance") == "high", "importance_high")
               .when(F.col("importance") == "low", "importance_low")
               .when(F.col("best") < threshold, "low_confidence")
               .otherwise("confident"))
    decided = best.withColumn("reason", reason).withColumn(
        "do_rerank", F.col("reason").isin("importance_high", "low_confidence"))
    r = run.join(decided.select("query_id", "do_rerank", "reason"), "query_id")
    yes = r.filter("do_rerank").select("query_id", "doc_id", "score", "rank")
    no = r.filter(~F.col("do_rerank"))
    reranked = rerank(yes, queries, corpus, scorer, k).join(
        decided.select("query_id", "reason"), "query_id")
    kept = no.filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "reason")
    return reranked.unionByName(kept)


def fuse_rrf(runs: dict[str, DataFrame], k0: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion, ``sum 1/(k0 + rank)`` over the runs in
    which a document appears (a full outer combination done as union +
    aggregation)."""
    u = None
    for name, r in runs.items():
        part = r.select("query_id", "doc_id", (1.0 / (k0 + F.col("rank"))).alias("s"))
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    return top_k_per_group(fused, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)


def fuse_linear(runs: dict[str, DataFrame], weights: dict[str, float], k: int = 10,
                eps: float = 1e-8) -> DataFrame:
    """Weighted sum of per-query min-max normalised scores (our choice
    of normalisation); a document missing from a run contributes 0 there."""
    u = None
    for name, r in runs.items():
        st = r.groupBy("query_id").agg(F.min("score").alias("mn"), F.max("score").alias("mx"))
        part = r.join(st, "query_id").select(
            "query_id", "doc_id",
            (F.lit(float(weights[name])) * (F.col("score") - F.col("mn")) / (F.col("mx") - F.col("mn") + eps)).alias("s"))
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))
    return top_k_per_group(fused, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)


def search(requests: DataFrame, vectors: DataFrame | None, corpus: DataFrame | None = None,
           encoder: Encoder | None = None, metric: str = "ip", scorer=None,
           ivf: dict | None = None, nprobe: int = 8) -> DataFrame:
    """Batch search. Requests ``(query_id, query | embedding, k[, rerank,
    rerank_top_k])``.

    Encode (when an encoder is given); retrieve ``k`` - or ``rerank_top_k``
    when ``rerank`` is true - keep only ids present in the index, attach text
    ("" when unknown), rerank the flagged requests with ``scorer``, then cut
    to ``k`` (so ``rerank_top_k < k`` returns fewer rows, as the reference).
    One search at the largest requested depth serves every request: exact
    (D3) by default, or IVF (D4) when an ``ivf`` index is given.
    """
    req = requests
    if encoder is not None:
        enc = encoder.encode(req.select("query_id", "query"), id_col="query_id", text_col="query")
        req = req.join(enc.withColumnRenamed("id", "query_id"), "query_id")
    has_rr = "rerank" in req.columns
    want = (F.when(F.coalesce(F.col("rerank"), F.lit(False)), F.col("rerank_top_k")).otherwise(F.col("k"))
            if has_rr else F.col("k"))
    req = req.withColumn("__want", want).withColumn("__rr", F.col("rerank") if has_rr else F.lit(False))
    kmax = req.agg(F.max("__want").alias("m")).first()["m"] or 0
    if ivf is not None:
        from quarry.operators.ann import ivf_search
        cand = ivf_search(req, ivf, k=int(kmax), nprobe=nprobe, metric=metric)
    else:
        cand = flat_search(req, vectors, k=int(kmax), metric=metric)
    r = cand.join(req.select("query_id", "__want", "__rr", F.col("k").alias("__k")), "query_id")
    r = r.filter(F.col("rank") <= F.col("__want"))
    if corpus is not None:
        r = attach_text(r, corpus)
    if has_rr and scorer is not None and corpus is not None:
        flagged = r.filter("__rr")
        rr = rerank(flagged.select("query_id", "doc_id", "score", "rank"), req, corpus, scorer, k=int(kmax))
        rr = attach_text(rr, corpus).join(req.select("query_id", F.col("k").alias("__k")), "query_id")
        r = r.filter(~F.col("__rr")).select(rr.columns).unionByName(rr)
    r = r.filter(F.col("rank") <= F.col("__k"))
    cols = ["query_id", "doc_id", "score", "rank"] + (["text"] if corpus is not None else [])
    return r.select(*cols)


def search_distinct(requests: DataFrame, search_fn, key: Column) -> DataFrame:
    """Evaluate each distinct request once (batch meaning of the result
    cache). A key's representative is its smallest ``query_id``, so that every
    evaluation of the plan picks the same; search, join back."""
    keyed = requests.withColumn("__key", key)
    uniq = (keyed.groupBy("__key").agg(F.min_by(F.struct(*requests.columns), "query_id").alias("__r"))
                 .select("__r.*", "__key"))
    res = search_fn(uniq)
    m = keyed.select("query_id", "__key").join(uniq.select(F.col("query_id").alias("__rep"), "__key"), "__key")
    return (m.join(res.withColumnRenamed("query_id", "__rep"), "__rep")
             .drop("__rep", "__key"))
