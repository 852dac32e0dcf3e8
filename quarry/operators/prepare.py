"""Corpus preparation (P1-P11): explode passages, ids, titles, chunking,
counters, de-duplicated corpus, qrels and training tables.

Deviations from the reference, on purpose:
* passage ids are per-query ordinals ``q{query_id}_p{n}`` (n counts the
  non-empty passages of that query from 1) instead of a counter running over
  the whole file, which would need a global sequential pass;
* chunk text of a long document is the exact substring between the first
  and last token of the window when offsets are requested
  (``chunk_offsets``); the SQL-only form joins the window's tokens with one
  space (the reference's detokenised, lossy text);
* an overlap (``stride``) >= ``max_tokens`` raises instead of looping forever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import DEFAULTS
from quarry.functions.text import WS_CLASS, WS_RUN, split_ws

QA_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("passages", T.StructType([
        T.StructField("passage_text", T.ArrayType(T.StringType())),
        T.StructField("is_selected", T.ArrayType(T.IntegerType())),
    ])),
])

QA_SCHEMA_LIST = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("passage_text", T.StringType()),
        T.StructField("is_selected", T.IntegerType()),
    ]))),
])


def explode_passages(qa: DataFrame) -> DataFrame:
    """P1/P2 (+C7, P3): one row per non-empty passage.

    Accepts both layouts: a struct of parallel arrays (a missing label is 0)
    or an array of structs. Output ``(query_id, query, passage_idx, doc_id,
    text, is_relevant)``; ``doc_id`` = ``q{query_id}_p{n}`` with n the
    1-based ordinal among the query's non-empty passages.
    """
    ptype = qa.schema["passages"].dataType
    qid = F.coalesce(F.col("query_id").cast("string"), F.col("query"), F.lit(""))
    if isinstance(ptype, T.StructType):
        arr = F.arrays_zip(F.col("passages.passage_text").alias("t"), F.col("passages.is_selected").alias("s"))
        items = F.transform(arr, lambda x, i: F.struct(x["t"].alias("text"),
                                                       F.coalesce(x["s"], F.lit(0)).alias("sel"),
                                                       i.alias("idx")))
    else:
        items = F.transform(F.col("passages"), lambda x, i: F.struct(
            x["passage_text"].alias("text"), F.coalesce(x["is_selected"], F.lit(0)).alias("sel"),
            i.alias("idx")))
    # drop empty passages inside the record, then the explode position is
    # the ordinal among non-empty passages: no window, no shuffle
    kept = F.filter(items, lambda x: x["text"].isNotNull() & (F.length(x["text"]) > 0))
    rows = qa.select(qid.alias("query_id"), F.coalesce("query", F.lit("")).alias("query"),
                     F.posexplode(kept).alias("ord", "p"))
    return rows.select(
        "query_id", "query", F.col("p.idx").cast("bigint").alias("passage_idx"),
        F.concat(F.lit("q"), F.col("query_id"), F.lit("_p"), (F.col("ord") + 1).cast("string")).alias("doc_id"),
        F.col("p.text").alias("text"), F.col("p.sel").cast("int").alias("is_relevant"))


def combine_title(df: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """``title + "\\n" + text`` when the title is non-empty."""
    t = F.col(title_col)
    return df.withColumn(text_col, F.when(t.isNotNull() & (F.length(t) > 0),
                                          F.concat(t, F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))))
                                    .otherwise(F.col(text_col)))


def _check_chunk_args(max_tokens: int, stride: int):
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    if stride < 0 or stride >= max_tokens:
        raise ValueError("stride (overlap) must be in [0, max_tokens)")


def chunk_documents(df: DataFrame, max_tokens: int = DEFAULTS.chunk_max_tokens, stride: int = DEFAULTS.chunk_stride,
                    id_col: str | None = "doc_id", text_col: str = "text",
                    keep: tuple = (), order_col: str | None = None) -> DataFrame:
    """Token-window chunking in pure Spark SQL (no Python per row).

    One verbatim chunk when the text has at most ``max_tokens`` whitespace
    tokens; otherwise windows starting at 0 and advancing by
    ``max_tokens - stride``, stopping at the first window that reaches the
    end. Output ``(chunk_id, doc_id, chunk_index, text, tokens, start_token,
    end_token)``; ``chunk_id = {doc_id}_{i}`` (just ``i`` when the id is
    NULL or empty).
    """
    _check_chunk_args(max_tokens, stride)
    step = max_tokens - stride
    if id_col is None:
        # P6 default ids "0", "1", ... in the order of ``order_col``
        from quarry.operators.relational import global_row_number
        df = global_row_number(df, [order_col or text_col], "__rn").withColumn(
            "__did", (F.col("__rn") - 1).cast("string")).drop("__rn")
        id_col = "__did"
    toks = split_ws(F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(*keep, F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"),
                     toks.alias("__tok"))
    n = F.size("__tok")
    nwin = F.when(n <= max_tokens, F.lit(1)).otherwise(
        F.ceil((n - max_tokens) / F.lit(float(step))).cast("int") + 1)

    def window(i):
        start = i * step
        end = F.least(start + max_tokens, n)
        text = F.when(n <= max_tokens, F.coalesce(F.col("__text"), F.lit(""))).otherwise(
            F.concat_ws(" ", F.slice("__tok", start + 1, end - start)))
        return F.struct(i.cast("bigint").alias("chunk_index"), text.alias("text"), (end - start).cast("bigint").alias("tokens"),
                        start.cast("bigint").alias("start_token"), end.cast("bigint").alias("end_token"))

    # windows are cut before the explode, so that its rows carry neither the whole text nor all tokens
    ex = base.select(*keep, "doc_id", F.explode(F.transform(F.sequence(F.lit(0), nwin - 1), window)).alias("__w"))
    did = F.col("doc_id").cast("string")
    i = F.col("__w.chunk_index")
    cid = F.when(did.isNull() | (did == ""), i.cast("string")).otherwise(F.concat(did, F.lit("_"), i.cast("string")))
    return ex.select(*keep, cid.alias("chunk_id"), "doc_id", "__w.chunk_index", "__w.text", "__w.tokens", "__w.start_token", "__w.end_token")


def chunk_offsets(df: DataFrame, max_tokens: int = DEFAULTS.chunk_max_tokens, stride: int = DEFAULTS.chunk_stride,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """P5 with character offsets: the chunk text is the exact substring
    ``text[start_char:end_char]`` of the window (code-point offsets).

    The windows are those of ``chunk_documents``. The text is cut before every
    token; a window starts after the pieces in front of it, by their summed
    lengths, and ends where its last piece has its trailing white space. A
    text of one window is kept whole.
    """
    _check_chunk_args(max_tokens, stride)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a first piece of white space alone, and an empty last one, hold no token
    pieces = F.split(text, f"(?<={WS_CLASS})(?!{WS_CLASS})")
    src = df.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("__text"), pieces.alias("__all"))
    src = src.select("doc_id", "__text", F.transform("__all", lambda x: F.length(x)).alias("__len"),
                     F.transform("__all", lambda x: F.length(F.regexp_replace(x, f"{WS_RUN}$", ""))).alias("__bare"))
    tok = src.withColumn("__n", F.size(F.filter("__bare", lambda x: x > 0))).withColumn("__lead", (F.get("__bare", F.lit(0)) == 0).cast("int"))
    n = F.col("__n")
    step = max_tokens - stride
    n_windows = F.when(n <= max_tokens, F.lit(1)).otherwise(F.ceil((n - max_tokens) / F.lit(float(step))).cast("int") + 1)

    def before(piece):
        return F.aggregate(F.slice("__len", 1, piece), F.lit(0), lambda at, x: at + x)

    def window(i):
        whole = n <= max_tokens
        end = F.least(i * step + max_tokens, n)
        last = F.col("__lead") + end - 1
        return F.struct(i.alias("chunk_index"),
                        F.when(whole, n).otherwise(end - i * step).alias("tokens"),
                        F.when(whole, F.lit(0)).otherwise(before(F.col("__lead") + i * step)).alias("start_char"),
                        F.when(whole, F.length("__text")).otherwise(before(last) + F.get("__bare", last)).alias("end_char"))

    rows = tok.select("doc_id", "__text", F.transform(F.sequence(F.lit(0), n_windows - 1), window).alias("__w"))
    rows = rows.select("doc_id", F.explode(F.transform("__w", lambda x: F.struct(
        x.alias("w"), F.substring("__text", x["start_char"] + 1, x["end_char"] - x["start_char"]).alias("text")))).alias("c"))
    index = F.col("c.w.chunk_index")
    chunk_id = F.when(F.coalesce("doc_id", F.lit("")) == "", index.cast("string")).otherwise(F.concat_ws("_", "doc_id", index))
    return rows.select(chunk_id.alias("chunk_id"), "doc_id", index.cast("bigint").alias("chunk_index"), "c.text",
                       *[F.col(f"c.w.{x}").cast("bigint").alias(x) for x in ("tokens", "start_char", "end_char")])


def prep_summary(chunks: DataFrame) -> DataFrame:
    """Counters - chunks, queries, passages, distinct documents."""
    aggs = [F.count("*").alias("num_chunks")]
    if "query_id" in chunks.columns:
        aggs.append(F.count_distinct("query_id").alias("num_queries"))
    aggs.append(F.count_distinct("doc_id").alias("num_docs"))
    return chunks.agg(*aggs)


def unique_corpus(passages: DataFrame, order_cols=("query_ord", "passage_idx")) -> DataFrame:
    """Corpus de-duplicated by exact text; the first position keeps it.

    One aggregation by text (``min`` of the position struct); corpus ids
    are the dense rank of first positions.
    """
    pos = F.struct(*[F.col(c) for c in order_cols])
    firsts = passages.groupBy("text").agg(F.min(pos).alias("first_pos"))
    return firsts.select("text", "first_pos")


def build_qrels(passages: DataFrame, order_cols=("query_ord", "passage_idx")) -> DataFrame:
    """P10: per (query, text) the label of the *last* occurrence wins."""
    pos = F.struct(*[F.col(c) for c in order_cols])
    return passages.groupBy("query_id", "text").agg(F.max_by("is_relevant", pos).alias("rel"))


def extract_training_tables(passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries with at least one positive, their positives, and the
    corpus text table where positives overwrite and other passages are only
    added when absent (priority union keyed by doc id).
    """
    pos = passages.filter(F.col("is_relevant") == 1)
    queries = passages.select("query_id", "query").distinct().join(pos.select("query_id"), "query_id", "left_semi")
    positives = pos.select("query_id", "doc_id")
    prio = passages.select("doc_id", "text",
                           F.when(F.col("is_relevant") == 1, 0).otherwise(1).alias("__p"))
    texts = prio.groupBy("doc_id").agg(F.min_by("text", "__p").alias("text"))
    return queries, positives, texts


def qa_from_conversations(conversations: DataFrame) -> DataFrame:
    """Build QA records (struct-of-arrays layout) from conversation turns.

    For every user turn: passages = [the assistant turn right after it
    (selected), the assistant turn right before it (not selected)]. Both are
    equi-joins on (conv_id, turn +/- 1), so a huge conversation never forms
    all pairs of its turns.
    """
    c = conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("atext"))
    nxt = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("atext").alias("next_text"))
    prv = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("atext").alias("prev_text"))
    j = u.join(nxt, ["conv_id", "turn"], "left").join(prv, ["conv_id", "turn"], "left")
    texts = F.filter(F.array(F.col("next_text"), F.col("prev_text")), lambda x: x.isNotNull())
    sel = F.when(F.col("next_text").isNotNull(), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    return j.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"),
        "query",
        F.struct(texts.alias("passage_text"), F.slice(sel, 1, F.size(texts)).alias("is_selected")).alias("passages"))


def stamp(df: DataFrame, split: str) -> DataFrame:
    """Chunk-row bookkeeping columns of the prepared table."""
    return df.withColumn("split", F.lit(split)).withColumn("updated_at", F.current_timestamp())


def text_hash(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(c, 256)
