"""Reusable DuckDB SQL fragments for the oracle side of the registered
queries. Written independently of the Spark code (windows and plain joins
where the Spark side uses closed forms or pre-aggregated tables)."""

from __future__ import annotations

from quarry.functions.text import WS_RUN


def toks(expr: str) -> str:
    """T1 in DuckDB: lower-case, split on the Python whitespace class."""
    return f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '{WS_RUN}'), lambda x: x <> '')"


def bm25_ctes(corpus_sql: str, queries_sql: str, prefix: str = "",
              k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> str:
    """CTEs ``{p}scored(query_id, doc_id, score)`` for BM25 Okapi.

    ``corpus_sql`` yields (doc_id, text); ``queries_sql`` yields (query_id, query).
    """
    p = prefix
    return f"""
{p}cdocs AS (SELECT doc_id, {toks('text')} AS toks FROM ({corpus_sql})),
{p}cst AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM {p}cdocs),
{p}post AS (SELECT term, doc_id, dl, count(*) AS tf
          FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}cdocs) GROUP BY ALL),
{p}traw AS (SELECT term, ln((SELECT n FROM {p}cst) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
          FROM {p}post GROUP BY term),
{p}tidf AS (SELECT term, CASE WHEN raw < 0 THEN {eps} * (SELECT avg(raw) FROM {p}traw) ELSE raw END AS idf
          FROM {p}traw),
{p}qt AS (SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({toks('query')}) AS term FROM ({queries_sql})) GROUP BY ALL),
{p}scored AS (
  SELECT q.query_id, po.doc_id,
         sum(q.qtf * i.idf * po.tf * {k1 + 1} / (po.tf + {k1} * (1 - {b} + {b} * po.dl / (SELECT avgdl FROM {p}cst)))) AS score
  FROM {p}qt q JOIN {p}tidf i ON q.term = i.term JOIN {p}post po ON po.term = q.term
  WHERE i.idf <> 0
  GROUP BY 1, 2)"""


def topk_cte(name: str, src: str, k: int, part: str = "query_id", tie: str = "doc_id") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part}
        ORDER BY round(score, 9) DESC, {tie}) AS rank FROM {src}) WHERE rank <= {k})"""


QRELS_A = """SELECT DISTINCT b.item_id AS query_id, d.doc_id, 1 AS rel
  FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0 WHERE length(b.text) > 0"""


def metrics_sql(run: str, qrels: str, queries: str, ks=(10, 50, 100)) -> str:
    """Mean nDCG/MRR/recall/precision per k, long form; window-based ideal DCG."""
    klist = ", ".join(str(k) for k in ks)
    return f"""
mq_rel AS (SELECT DISTINCT query_id, doc_id FROM ({qrels}) WHERE rel > 0),
mq_j AS (SELECT r.query_id, r.doc_id, r.rank, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel
         FROM {run} r LEFT JOIN mq_rel q ON r.query_id = q.query_id AND r.doc_id = q.doc_id),
mq_ks AS (SELECT unnest([{klist}]) AS k),
mq_jk AS (SELECT j.*, k, row_number() OVER (PARTITION BY query_id, k ORDER BY rel DESC, rank) AS ipos
          FROM mq_j j JOIN mq_ks ON j.rank <= mq_ks.k),
mq_pq AS (SELECT query_id, k, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ipos + 1)) AS idcg,
                 min(CASE WHEN rel > 0 THEN rank END) AS fr,
                 count(DISTINCT CASE WHEN rel > 0 THEN doc_id END) AS hits
          FROM mq_jk GROUP BY 1, 2),
mq_nrel AS (SELECT query_id, count(*) AS n_rel FROM mq_rel GROUP BY 1),
mq_allq AS (SELECT DISTINCT query_id, k FROM ({queries}) , mq_ks),
mq_per AS (SELECT a.query_id, a.k,
       CASE WHEN coalesce(p.idcg, 0) > 0 THEN p.dcg / p.idcg ELSE 0.0 END AS ndcg,
       CASE WHEN p.fr IS NOT NULL THEN 1.0 / p.fr ELSE 0.0 END AS mrr,
       CASE WHEN coalesce(n.n_rel, 0) > 0 THEN coalesce(p.hits, 0) / n.n_rel ELSE 0.0 END AS recall,
       coalesce(p.hits, 0) / a.k AS precision
  FROM mq_allq a LEFT JOIN mq_pq p ON a.query_id = p.query_id AND a.k = p.k
  LEFT JOIN mq_nrel n ON a.query_id = n.query_id),
mq_out AS (SELECT k, avg(ndcg) AS ndcg, avg(mrr) AS mrr, avg(recall) AS recall, avg(precision) AS precision
           FROM mq_per GROUP BY k)"""


METRICS_SELECT = """SELECT metric, k::BIGINT AS k, round(value, 6) AS value FROM (
  UNPIVOT mq_out ON ndcg, mrr, recall, precision INTO NAME metric VALUE value)"""


def norm_text(expr: str) -> str:
    """T2 normalisation in DuckDB: strip Python whitespace, lower-case."""
    return f"lower(regexp_replace({expr}, '^{WS_RUN}|{WS_RUN}$', '', 'g'))"


def grams_of(col: str) -> str:
    """Distinct character trigrams of an already normalised text column."""
    return (f"(CASE WHEN length({col}) >= 3 THEN list_distinct(list_transform(range(1, length({col}) - 1), "
            f"lambda i: substring({col}, i, 3))) ELSE []::VARCHAR[] END)")


def jaccard_of(g1: str, g2: str) -> str:
    return (f"(CASE WHEN len({g1}) > 0 AND len({g2}) > 0 THEN len(list_intersect({g1}, {g2})) "
            f"/ len(list_distinct(list_concat({g1}, {g2}))) ELSE 0.0 END)")
