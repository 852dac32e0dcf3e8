"""Registered queries whose operators read or write files, and rows for the
remaining operators. Files are written from the given tables to a fresh folder
below the shared checkpoint folder and read back from there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.text import client_key
from quarry.operators import checks, lexical, mining, prepare
from quarry.plans import standins as st
from quarry.plans.registered import (
    CORPUS_SQL,
    ORACLE,
    QA_PASSAGES_SQL,
    QUERIES_A_SQL,
    R1_BURST,
    R1_IDLE,
    R1_RPM,
    R1_SQL,
    _chunk_sql,
    _two_models,
    _vecs,
    r6,
    register,
)
from quarry.plans.sqlparts import bm25_ctes, topk_cte, toks
from quarry.session import checkpoint_dir
from quarry.sources import readers, writers
from quarry.streaming import requests as rq


def fresh(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


def written_qa(spark, sf_dir) -> str:
    """The conversations as QA JSON lines."""
    path = fresh(spark, "qa")
    prepare.qa_from_conversations(st.table(spark, sf_dir, "conversations")).write.json(path)
    return path


@register("S1_read_qa_jsonl", QA_PASSAGES_SQL)
def q_read_qa(spark, sf_dir):
    return prepare.explode_passages(readers.read_qa_jsonl(spark, written_qa(spark, sf_dir)))


@register("S2_read_corpus_jsonl", "SELECT doc_id::VARCHAR AS doc_id, source AS title, sha256(text) AS th FROM documents")
def q_read_corpus_jsonl(spark, sf_dir):
    path = fresh(spark, "corpus")
    st.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("source").alias("title"), "text").write.json(path)
    return readers.read_corpus_jsonl(spark, path).select("doc_id", "title", F.sha2("text", 256).alias("th"))


@register("S4_write_chunks", f"""SELECT chunk_id, sha256(c.text) AS th, tokens, d.lang AS split
FROM ({_chunk_sql()}) c JOIN documents d USING (doc_id)""")
def q_write_chunks(spark, sf_dir):
    path = fresh(spark, "chunks")
    docs = st.table(spark, sf_dir, "documents")
    for r in docs.select("lang").distinct().collect():  # a split a write: each leaves the others
        lang = F.lit(r["lang"]).cast("string")
        d = docs.filter(F.col("lang").eqNullSafe(lang))
        writers.write_chunks(prepare.chunk_documents(d, 512, 80).withColumn("split", lang), path)
    return spark.read.parquet(path).select("chunk_id", F.sha2("text", 256).alias("th"), "tokens", "split")


@register("S5_write_splits", """SELECT 'documents' AS dataset, '1' AS version, lang AS split, count(*) AS num_samples,
  count(DISTINCT doc_id) AS n_read FROM documents GROUP BY lang""")
def q_write_splits(spark, sf_dir):
    path = fresh(spark, "splits")
    writers.write_splits(st.table(spark, sf_dir, "documents").withColumnRenamed("lang", "split"), path, "documents")
    read = spark.read.json(path + "/data").groupBy("split").agg(F.count_distinct("doc_id").alias("n_read"))
    return writers.read_manifest(spark, path).join(read, "split").select("dataset", "version", "split", "num_samples", "n_read")


@register("S7_reloaded_index_search", f"""WITH {bm25_ctes(CORPUS_SQL, QUERIES_A_SQL)},
{topk_cte('top', 'scored', 10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""")
def q_reloaded(spark, sf_dir):
    """Build, save with fingerprints, verify and reload, search."""
    path = fresh(spark, "index")
    idx = lexical.build_lexical_index(st.corpus(spark, sf_dir), "doc_id", "text")
    lexical.save_lexical_index(idx, path)
    idx.close()
    back = lexical.load_lexical_index(spark, path)
    return lexical.bm25_search(back, st.queries_a(spark, sf_dir), k=10).select("query_id", "doc_id", r6("score"), "rank")


@register("L6_index_errors", """SELECT 'absent' AS damaged, 'FileNotFoundError' AS error, count(*) AS documents FROM documents
UNION ALL SELECT t, 'ValueError: checksum mismatch for index table ' || t, count(*) FROM documents, (VALUES ('docs'), ('postings'), ('terms'), ('tokens')) x(t) GROUP BY t
UNION ALL SELECT 'none', '', count(*) FROM documents""")
def q_index_errors(spark, sf_dir):
    """An index of the documents is loaded as it is, then with a part of the rows of one table after another gone."""
    path, n = fresh(spark, "damaged"), st.corpus(spark, sf_dir).count()

    def load(where):
        try:
            return "" if lexical.load_lexical_index(spark, where).stats["N"] == n else "another index"
        except FileNotFoundError as e:
            return type(e).__name__
        except ValueError as e:
            return f"{type(e).__name__}: {e}"

    lexical.build_lexical_index(st.corpus(spark, sf_dir), "doc_id", "text", path=path)
    rows = [("absent", load(path + "-none"), n), ("none", load(path), n)]
    for name in ("tokens", "docs", "terms", "postings"):  # the tables that are checked last go first
        kept, t = fresh(spark, "kept"), spark.read.parquet(f"{path}/{name}")
        t.where(F.pmod(F.xxhash64(*t.columns), F.lit(5)) != 0).write.parquet(kept)
        spark.read.parquet(kept).write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, load(path), n))
    return spark.createDataFrame(rows, "damaged string, error string, documents long")


@register("L5_zero_padding", f"""WITH {bm25_ctes(CORPUS_SQL, "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[2:3], ' ') AS query FROM benchmark")},
every AS (SELECT q.item_id AS query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark q CROSS JOIN documents d
          LEFT JOIN scored s ON s.query_id = q.item_id AND s.doc_id = d.doc_id),
{topk_cte('top', 'every', 50)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""")
def q_padding(spark, sf_dir):
    idx = lexical.build_lexical_index(st.corpus(spark, sf_dir), "doc_id", "text")
    q = st.queries_a(spark, sf_dir).withColumn("query", F.array_join(F.slice(F.split("query", " "), 2, 2), " "))
    return lexical.bm25_search(idx, q, k=50, pad_zero=True).select("query_id", "doc_id", r6("score"), "rank")


@register("L5_padding_whole_items", f"""WITH {bm25_ctes(CORPUS_SQL, QUERIES_A_SQL)},
every AS (SELECT q.item_id AS query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark q CROSS JOIN documents d
          LEFT JOIN scored s ON s.query_id = q.item_id AND s.doc_id = d.doc_id),
{topk_cte('top', 'every', 900)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM top""")
def q_padding_whole(spark, sf_dir):
    """Whole items; 900 documents each are more than the items of a language match at sf0.01."""
    idx = lexical.build_lexical_index(st.corpus(spark, sf_dir), "doc_id", "text", keep_tokens=False)
    return lexical.bm25_search(idx, st.queries_a(spark, sf_dir), k=900, pad_zero=True).select("query_id", "doc_id", r6("score"), "rank")


@register("S10_load_embedding_table", "SELECT e.vec_id AS id, len(e.embedding) AS dim, sha256(d.text) AS th FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def q_load_vectors(spark, sf_dir):
    vec, text = fresh(spark, "vectors"), fresh(spark, "texts")
    _vecs(spark, sf_dir).select("id", "embedding").write.parquet(vec)
    st.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").write.parquet(text)
    return readers.load_embedding_table(spark, vec, text)[0].select("id", F.size("embedding").cast("bigint").alias("dim"), F.sha2("text", 256).alias("th"))


@register("S12_write_metrics", "SELECT 'lang_' || lang AS metric, count(*)::DOUBLE AS value FROM documents GROUP BY lang")
def q_write_metrics(spark, sf_dir):
    path = fresh(spark, "metrics")
    m = st.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("value"))
    writers.write_metrics(m.select(F.concat(F.lit("lang_"), "lang").alias("metric"), "value"), path)
    return spark.read.schema("metric string, value double").json(path)


@register("S14_catalog", "SELECT count(*) AS n FROM documents")
def q_catalog(spark, sf_dir):
    cat = readers.Catalog(root=sf_dir)
    cat.register("docs", {"all": "documents.parquet"})
    return cat.read(spark, "docs", "all").agg(F.count("*").alias("n"))


@register("P6_default_ids", _chunk_sql().replace("FROM documents)", "FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents))")
          .replace("AS chunk_id, doc_id,", "AS chunk_id, doc_id::VARCHAR AS doc_id,"))
def q_default_ids(spark, sf_dir):
    return prepare.chunk_documents(st.corpus(spark, sf_dir), 512, 80, id_col=None, order_col="doc_id")


PREPARED_SQL = f"""WITH p AS ({QA_PASSAGES_SQL}), c AS (
{_chunk_sql().replace("FROM documents)", "FROM p)")})
SELECT c.chunk_id, sha256(c.text) AS th, p.query_id, sha256(p.query) AS query_hash, p.is_relevant, 'train' AS split
FROM c JOIN p USING (doc_id)"""


def prepared(spark, path):
    return spark.read.parquet(path).select("chunk_id", F.sha2("text", 256).alias("th"), "query_id",
                                           F.sha2("query_text", 256).alias("query_hash"), "is_relevant", "split")


@register("P8_prepare_dataset", PREPARED_SQL)
def q_prepare(spark, sf_dir):
    out = fresh(spark, "prepared")
    writers.prepare_dataset(spark, written_qa(spark, sf_dir), out, "train")
    return prepared(spark, out + "/chunks")


@register("P12_prepare_stream", PREPARED_SQL)
def q_prepare_stream(spark, sf_dir):
    out = fresh(spark, "streamed")
    writers.prepare_stream(spark, written_qa(spark, sf_dir), out, fresh(spark, "state")).awaitTermination()
    return prepared(spark, out)


@register("T6_client_key", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id
  WHEN user_id % 3 = 1 THEN 'h' || user_id ELSE 'unknown' END AS client FROM events""")
def q_client(spark, sf_dir):
    u = F.col("user_id")
    header = F.when(u % 3 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 10.9.9.9"))).when(u % 3 == 1, F.lit(""))
    host = F.when(u % 3 == 1, F.concat(F.lit("h"), u))
    e = st.table(spark, sf_dir, "events").withColumn("f", header).withColumn("h", host)
    return e.select("event_id", client_key("f", "h").alias("client"))


@register("C6_integrity_summary", """WITH s AS (SELECT source AS dataset, lang AS split, count(*) > 25 AS enough, bool_and(n_chars >= 20) AS long
  FROM documents GROUP BY source, lang),
e AS (SELECT *, enough AND long AS passed, CASE WHEN enough AND long THEN NULL
        ELSE split || ':' || concat_ws(';', CASE WHEN NOT enough THEN 'count' END, CASE WHEN NOT long THEN 'length' END) END AS err FROM s)
SELECT dataset, count(*) FILTER (WHERE passed) AS splits_passed, count(*) FILTER (WHERE NOT passed) AS splits_failed,
       bool_and(passed) AS passed, coalesce(string_agg(err, ';' ORDER BY err), '') AS errors FROM e GROUP BY dataset""")
def q_summary(spark, sf_dir):
    s = st.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("split")).agg(
        (F.count("*") > 25).alias("enough"), F.bool_and(F.col("n_chars") >= 20).alias("long"))
    reports = s.selectExpr("dataset", "split", "stack(2, 'count', enough, 'length', long) AS (`check`, ok)")
    return checks.integrity_summary(reports)


@register("N10_remined_version", ORACLE["N3_mine_ance"])
def q_remine(spark, sf_dir):
    """Two snapshots of the vectors in one table; mining against the newer one equals N3 on it."""
    from quarry.operators import dense

    v = _vecs(spark, sf_dir)
    older = v.withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("version", F.lit(1))
    both = older.unionByName(v.withColumn("version", F.lit(2)))
    q, lab = v.withColumnRenamed("id", "query_id"), v.select("id", "label")
    knn = dense.flat_search(q, v, k=50, exclude_self=True)
    cands = (knn.join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
                .join(lab.select(F.col("id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")
                .filter(F.col("ql") != F.col("dl")).select("query_id", "doc_id"))
    best = dense.flat_search(q, v, k=1, exclude_self=True, group_col="label", group_mode="same")
    a = mining.mine_ance(cands, None, both, both, margin=0.1, k=5, version=2, max_pos=best.select("query_id", F.col("score").alias("max_pos")))
    return a.select("query_id", "doc_id", r6("student_score"), "ance_rank")


_QA_CHUNKS = _chunk_sql(1000, 160).replace("FROM documents)", "FROM p)")
_CORPUS_CHUNKS = _chunk_sql(1000, 160).replace(
    "FROM documents)", "FROM (SELECT doc_id, CASE WHEN length(source) > 0 THEN source || chr(10) || coalesce(text, '') ELSE text END AS text FROM documents) WHERE length(text) > 0)")
PREPARE_ALL_SQL = f"""WITH p AS ({QA_PASSAGES_SQL}), c AS ({_QA_CHUNKS}),
q AS (SELECT CASE WHEN split_part(p.query_id, '_', 1)::BIGINT % 5 = 0 THEN 'dev' ELSE 'train' END AS split, c.chunk_id, p.query_id, c.doc_id FROM c JOIN p USING (doc_id)),
k AS ({_CORPUS_CHUNKS})
SELECT 'talks' AS dataset, split, 'qa' AS kind, count(*) AS num_chunks, count(DISTINCT query_id) AS num_queries, count(DISTINCT doc_id) AS num_docs, 1000 AS max_tokens, 160 AS stride, true AS ok FROM q GROUP BY split
UNION ALL SELECT 'texts', 'corpus', 'corpus', count(*), NULL, count(DISTINCT doc_id), 1000, 160, true FROM k
UNION ALL SELECT 'texts', 'absent', 'corpus', NULL, NULL, NULL, 1000, 160, false"""


def _prepare_all(spark, sf_dir):
    talks, texts, out = fresh(spark, "talks"), fresh(spark, "texts"), fresh(spark, "all")
    qa = prepare.qa_from_conversations(st.table(spark, sf_dir, "conversations"))
    conv = F.substring_index("query_id", "_", 1).cast("long")
    qa.withColumn("part", F.when(conv % 5 == 0, "dev").otherwise("train")).write.partitionBy("part").json(talks)
    st.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.col("source").alias("title"), "text").write.json(texts)
    catalog = {"talks": {"kind": "qa", "splits": {"dev": f"{talks}/part=dev", "train": f"{talks}/part=train"}},
               "texts": {"kind": "corpus", "splits": {"absent": f"{texts}-absent", "corpus": texts}}}
    return writers.prepare_all(spark, catalog, out)


@register("P8_prepare_all", PREPARE_ALL_SQL)
def q_prepare_all(spark, sf_dir):
    """Two datasets, one of them with a split whose files don't exist."""
    m = _prepare_all(spark, sf_dir)
    return m.select("dataset", "split", "kind", "num_chunks", "num_queries", "num_docs", "max_tokens", "stride", F.col("error").isNull().alias("ok"))


@register("P8_prepared_summary", """SELECT 'talks' AS dataset, 2::BIGINT AS splits_passed, 0::BIGINT AS splits_failed, true AS passed, '' AS errors
UNION ALL SELECT 'texts', 1::BIGINT, 1::BIGINT, count(*) < 0, 'absent:chunks;prepare' FROM documents""")
def q_prepared_summary(spark, sf_dir):
    return checks.integrity_summary(writers.prepared_reports(_prepare_all(spark, sf_dir)))


def _hashed_sql(rows: str, dim: int) -> str:
    """(id, i, value) of the non-zero places of the hashed unit vectors of rows (id, text)."""
    return f"""t AS (SELECT id, unnest({toks('text')}) AS token FROM ({rows})),
h AS (SELECT id, ('0x' || md5('0:' || token)[1:15])::BIGINT AS h FROM t),
s AS (SELECT id, (h // 2) % {dim} AS i, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM s GROUP BY id)
SELECT id, i::INTEGER AS i, round((x / n.n)::FLOAT::DOUBLE, 6) AS value FROM s JOIN n USING (id) WHERE x <> 0"""


def _places(vectors):
    return vectors.select("id", F.posexplode("embedding").alias("i", "value")).where("value <> 0").select("id", "i", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("D1_hashing_encoder", "WITH " + _hashed_sql("SELECT item_id AS id, 'query: ' || text AS text FROM benchmark", 384))
def q_hashing(spark, sf_dir):
    from quarry.operators import dense

    q = st.queries_a(spark, sf_dir)
    return _places(dense.encode(q, dense.HashingEncoder(384), kind="query", id_col="query_id", text_col="query"))


@register("S9_embedding_places", "WITH " + _hashed_sql("SELECT doc_id AS id, text FROM documents", 64))
def q_embedded(spark, sf_dir):
    """The embedding table, written and read back, as its non-zero places."""
    from quarry.operators import dense

    return _places(writers.build_embedding_table(st.corpus(spark, sf_dir), dense.HashingEncoder(64), fresh(spark, "embedded")))


@register("C1_file_integrity", """WITH f AS (SELECT source, string_agg(doc_id::VARCHAR || chr(10), '' ORDER BY doc_id) AS body, count(*) AS num_lines FROM documents GROUP BY source),
l AS (SELECT source, i, sha256(substr(body, i * 100 + 1, 100)) AS h FROM f, LATERAL (SELECT unnest(range(0, (length(body) + 99) // 100)) AS i)),
n AS (SELECT source, i // 3 AS node, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS leaves FROM l GROUP BY 1, 2),
r AS (SELECT source, sha256(string_agg(h, '' ORDER BY node)) AS tree_sha256, sum(leaves)::BIGINT AS leaves FROM n GROUP BY source)
SELECT source, length(body) AS size_bytes, num_lines, sha256(body) AS sha256, tree_sha256, leaves FROM f JOIN r USING (source)""")
def q_integrity(spark, sf_dir):
    """A file of ids for each source: its hash, and the hash by ranges of 100 bytes, three to a node."""
    path = fresh(spark, "ids")
    d = st.table(spark, sf_dir, "documents").select("source", "doc_id")
    d.repartition(20, "source").sortWithinPartitions("source", "doc_id").select("source", F.col("doc_id").cast("string")).write.partitionBy("source").text(path)
    files = f"{path}/source=*/*.txt"
    whole, tree = checks.file_integrity(spark, files), checks.tree_hash(spark, files, 100, 3)
    source = F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")
    return whole.join(tree.drop("size_bytes"), "path").select(source, "size_bytes", "num_lines", "sha256", "tree_sha256", "leaves")


@register("M13_improvement_summary", ORACLE["M13_improvement"].replace("SELECT metric, k, round(base, 6)", ", i AS (SELECT metric, k, round(base, 6)", 1) + """)
SELECT (SELECT round(avg(improvement_pct), 4) FROM i WHERE metric = 'ndcg' AND k IN (1, 5, 10)) AS avg_improvement_pct,
  round(improvement_pct, 4) AS best_improvement_pct, metric || '@' || k AS best_metric FROM i ORDER BY improvement_pct DESC, metric, k LIMIT 1""")
def q_improvement_summary(spark, sf_dir):
    from quarry.operators import metrics

    m = metrics.compare_models(_two_models(spark, sf_dir), st.qrels_a(spark, sf_dir), (1, 5, 10, 20))
    i = metrics.improvement(m, "teacher", "student").withColumn("improvement_pct", F.round("improvement_pct", 6))
    r4 = lambda c: F.round(c, 4).alias(c)
    return metrics.improvement_summary(i).select(r4("avg_improvement_pct"), r4("best_improvement_pct"), "best_metric")


# ---------------------------------------------------------------- streams of files

R10_FILES, R10_DELAY = 8, 43200


def arrivals(spark, log, files: int) -> str:
    """The log as files that a stream takes one by one, in the order in which requests arrive: each comes
    ten minutes late for every unit of its latency. ``log`` has ``arrival``, in microseconds."""
    lo, hi = log.agg(F.min("arrival"), F.max("arrival")).first()
    path = fresh(spark, "arrivals")
    nth = F.least(F.floor((F.col("arrival") - F.lit(lo)) * files / F.lit(hi - lo)), F.lit(files - 1)).cast("int")
    log.withColumn("file", nth).drop("arrival").repartition(files, "file").write.partitionBy("file").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/file=*/*.parquet")):
        n = int(f.getPath().getParent().getName().split("=")[1])
        fs.setTimes(f.getPath(), 1_700_000_000_000 + n * 60_000, -1)  # the file source takes the oldest first
    return path


def run_stream(spark, stream, name: str):
    """Runs a stream over all that is there; the query, and its rows as a table."""
    out = fresh(spark, name)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", fresh(spark, f"{name}-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q, spark.read.schema(stream.schema).parquet(out)


_ARRIVAL_SQL = f"""a AS (SELECT event_id, user_id AS client, epoch_us(ts) AS us, epoch_us(ts) + value * 600000000.0 AS arrival FROM events),
f AS (SELECT a.*, least(floor((arrival - lo) * {R10_FILES} / (hi - lo)), {R10_FILES - 1})::INTEGER AS file
      FROM a, (SELECT min(arrival) AS lo, max(arrival) AS hi FROM a))"""


def _arriving(spark, sf_dir):
    log = st.requests(spark, sf_dir).withColumn("arrival", F.unix_micros("ts") + F.col("latency_ms") * 600000000.0)
    path = arrivals(spark, log, R10_FILES)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("R10_late_data", f"""WITH {_ARRIVAL_SQL},
m AS (SELECT file, max(us) // 1000 * 1000 - {R10_DELAY}000000 AS after FROM f GROUP BY file),
w AS (SELECT b.file, max(m.after) AS mark FROM m b LEFT JOIN m ON m.file < b.file - 1 GROUP BY b.file),
k AS (SELECT f.us // 86400000000 * 86400000000 AS d, coalesce(us <= mark, false) AS late FROM f JOIN w USING (file))
SELECT strftime(make_timestamp(d), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS dropped FROM k GROUP BY d""")
def q_late_data(spark, sf_dir):
    """A stream takes the log file by file. The watermark after the files before the last one decides what of a
    file is late. What the progress counts as dropped must be what is missing from the rows."""
    q, kept = run_stream(spark, rq.on_time(_arriving(spark, sf_dir), f"{R10_DELAY} seconds"), "late")
    day = lambda df: df.groupBy(F.date_trunc("day", "ts").alias("window_start"))
    log = st.requests(spark, sf_dir)
    dropped = sum(rq.dropped_by_watermark(q).values())
    if dropped != log.count() - kept.count():
        raise ValueError(f"the progress names {dropped} dropped rows")
    out = day(log).agg(F.count("*").alias("n")).join(day(kept).agg(F.count("*").alias("kept")), "window_start", "left").fillna(0, ["kept"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kept", (F.col("n") - F.col("kept")).alias("dropped"))


R2_DELAY = 86400


def _bucket_stream(spark, sf_dir, evictions: bool):
    log = st.requests(spark, sf_dir).withColumn("arrival", F.unix_micros("ts").cast("double"))
    path = arrivals(spark, log, 5)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run_stream(spark, rq.token_bucket_stream(stream, rpm=R1_RPM, burst=R1_BURST, idle_seconds=R1_IDLE, watermark=f"{R2_DELAY} seconds", evictions=evictions), "bucket")[1]


@register("R1_token_bucket_stream", R1_SQL + """
SELECT client, event_id, allowed, round(tokens, 6) AS tokens, round(retry_after, 6) AS retry_after FROM tb""")
def q_bucket_stream(spark, sf_dir):
    return _bucket_stream(spark, sf_dir, False).select("client", "event_id", "allowed", r6("tokens"), r6("retry_after"))


@register("R2_idle_eviction", f"""WITH e AS (SELECT user_id AS client, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS next,
  max(epoch_us(ts)) OVER () AS latest FROM events)
SELECT client, count(*) AS evictions, min((us + {R1_IDLE * 1e6:.0f}) // 1000000) AS first_at, max((us + {R1_IDLE * 1e6:.0f}) // 1000000) AS last_at FROM e
WHERE CASE WHEN next IS NULL THEN (us + {R1_IDLE * 1e6:.0f}) // 1000 + 1 <= latest // 1000 - {R2_DELAY}000 ELSE next - us > {R1_IDLE * 1e6:.0f} END GROUP BY client""")
def q_idle_eviction(spark, sf_dir):
    """Buckets that the stream drops: after a pause that the next request ends, or by the timer."""
    gone = _bucket_stream(spark, sf_dir, True).where("event_id IS NULL")
    at = F.unix_seconds("ts")
    return gone.groupBy("client").agg(F.count("*").alias("evictions"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
