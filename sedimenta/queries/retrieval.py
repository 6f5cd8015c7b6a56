"""Queries on search, ranking, merging and change streams. Queries are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import search as R
from sedimenta.operators.vector_index import VectorIndex
from sedimenta.streaming import changes as W


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _t(spark, d, "documents")


def _asked(spark, d):
    return _docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "text")


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _probes(spark, d):
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


def postings(spark, d):
    """Document frequency and occurrences of every term."""
    return R.postings(_docs(spark, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, d):
    return R.bm25_top_k(_docs(spark, d), _asked(spark, d), "doc_id", "text", 10).select("query", F.col("id").alias("doc_id"), "score", "rank")


def _dense(spark, d, k):
    return R.dense_top_k(_vectors(spark, d), _probes(spark, d), k)


def dense_topk(spark, d):
    return _dense(spark, d, 10).select("query", F.col("id").alias("vec_id"), "score", "rank")


def ann_topk(spark, d):
    """The same search through the index by cells, at a recall of 0.9 or more."""
    return VectorIndex(_vectors(spark, d)).search(_probes(spark, d), 10).select("query", F.col("id").alias("vec_id"), "score", "rank")


def cosine_pairs(spark, d):
    """The cosine of each vector and the one of the next id."""
    v = _vectors(spark, d)
    other = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next"))
    return v.join(other, "id").select("id", F.round(R.cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


def hybrid_rrf(spark, d):
    """Both kinds of search fused for documents that have a vector of their id."""
    lexical = R.bm25_top_k(_docs(spark, d), _asked(spark, d), "doc_id", "text", 30)
    fused = R.rrf([lexical, _dense(spark, d, 30)])
    return R.top_k(fused, ["query"], 10).select("query", F.col("id").alias("doc_id"), "score", "rank")


def _filtered(spark, d, condition):
    """Statistics come from all documents, scores only for those that pass."""
    hits = R.bm25_top_k(_docs(spark, d), _asked(spark, d), "doc_id", "text", 10, keep=F.expr(condition))
    return hits.select("query", F.col("id").alias("doc_id"), "score", "rank")


def search_file_filter(spark, d):
    return _filtered(spark, d, "rel_path like '%/%.md'")


def search_lang_filter(spark, d):
    return _filtered(spark, d, "lang = 'de'")


def artifact_search(spark, d):
    return _filtered(spark, d, "source = 'readme'")


def search_min_score(spark, d):
    """The threshold comes after the limit."""
    return R.at_least(_dense(spark, d, 10), 0.1).select("query", F.col("id").alias("vec_id"), "score")


def _lists(spark, d):
    hits = R.dense_top_k(_vectors(spark, d), _probes(spark, d), 20, by="label")
    return hits.withColumn("key", F.pmod("id", F.lit(25)))


def multi_collection_topk(spark, d):
    return R.top_k(_lists(spark, d).withColumn("rank", F.lit(0)).drop("rank"), ["query"], 10).select("query", "label", F.col("id").alias("vec_id"), "score", "rank")


def rrf_merge(spark, d):
    merged = R.rrf_merge(_lists(spark, d)).withColumn("tie", F.concat_ws(":", "label", F.lpad(F.col("key").cast("string"), 2, "0")))
    return R.top_k(merged, ["query"], 10, tie="tie").select("query", "label", "key", "score", F.col("id").alias("vec_id"), "rank")


def cosine_merge(spark, d):
    merged = R.cosine_merge(_lists(spark, d))
    return R.top_k(merged, ["query"], 10).select("query", "label", "key", "score", F.col("id").alias("vec_id"), "rank")


def hashed_embeddings(spark, d):
    e = R.hashed_embedding(_docs(spark, d), "doc_id", "text", 32)
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm2"))


def debounce_sessions(spark, d):
    return W.sessions(_t(spark, d, "file_changes").dropDuplicates(["change_id"]), "project", "ts", "1 hour").select("project", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def tumbling_counts(spark, d):
    return W.tumbling(_t(spark, d, "events"), "1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


def watched_changes(spark, d):
    """The last kind of change of each file in each burst, as a watcher would hand it on."""
    return W.last_changes(_t(spark, d, "file_changes").dropDuplicates(["change_id"])).select("project", "rel_path", "kind", F.unix_micros("ts").alias("ts_us"))


QUERIES = {f.__name__: f for f in (
    postings, bm25_topk, dense_topk, ann_topk, cosine_pairs, hybrid_rrf, search_file_filter, search_lang_filter, artifact_search, search_min_score, multi_collection_topk, rrf_merge, cosine_merge, hashed_embeddings,
    debounce_sessions, tumbling_counts, watched_changes,
)}

_B = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS t FROM documents), t1 AS (SELECT * FROM t WHERE len(t) > 0),
  st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM t1), p AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t1) GROUP BY ALL),
  q AS (SELECT DISTINCT doc_id AS query, unnest(t) AS term FROM t1 WHERE doc_id % 50 = 0), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  sc AS (SELECT q.query, p.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY q.query, p.doc_id)"""
_D = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), ds AS (SELECT q.vec_id AS query, x.vec_id, x.label, round(list_cosine_similarity(q.e, x.e), 6) + 0.0 AS score FROM v q, v x WHERE q.vec_id % 50 = 0)"""
_L = _D + """, ls AS (SELECT *, vec_id % 25 AS key FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rank FROM ds) WHERE rank <= 20)"""


def _top(rows: str, cols: str, k: int = 10, tie: str = "doc_id") -> str:
    return f"SELECT {cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {tie}) AS rank FROM ({rows})) WHERE rank <= {k}"


def _kept(condition: str) -> str:
    return f"WITH {_B} " + _top(f"SELECT * FROM sc WHERE doc_id IN (SELECT doc_id FROM documents WHERE {condition})", "query, doc_id, score")


SQL = {
    "postings": f"WITH {_B} SELECT term, count(*) AS df, sum(tf) AS cf FROM p GROUP BY term",
    "bm25_topk": f"WITH {_B} " + _top("SELECT * FROM sc", "query, doc_id, score"),
    "dense_topk": f"WITH {_D} " + _top("SELECT * FROM ds", "query, vec_id, score", tie="vec_id"),
    "cosine_pairs": f"WITH {_D} SELECT a.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "hybrid_rrf": f"""WITH {_B}, {_D}, a AS ({_top('SELECT * FROM sc', 'query, doc_id', 30)}), b AS ({_top('SELECT query, vec_id AS doc_id, score FROM ds', 'query, doc_id', 30)}),
        f AS (SELECT query, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) {_top('SELECT * FROM f', 'query, doc_id, score')}""",
    "search_file_filter": _kept("rel_path LIKE '%/%.md'"),
    "search_lang_filter": _kept("lang = 'de'"),
    "artifact_search": _kept("source = 'readme'"),
    "search_min_score": f"WITH {_D}, x AS ({_top('SELECT * FROM ds', 'query, vec_id, score', tie='vec_id')}) SELECT query, vec_id, score FROM x WHERE score >= 0.1",
    "multi_collection_topk": f"WITH {_L} " + _top("SELECT query, label::VARCHAR AS label, vec_id, score FROM ls", "query, label, vec_id, score", tie="vec_id"),
    "rrf_merge": f"""WITH {_L}, m AS (SELECT query, label::VARCHAR AS label, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(vec_id, rank) AS vec_id FROM ls GROUP BY ALL) {_top('SELECT * FROM m', 'query, label, key, score, vec_id', tie="label || ':' || lpad(key::VARCHAR, 2, '0')")}""",
    "cosine_merge": f"""WITH {_L}, m AS (SELECT query, label::VARCHAR AS label, key, score, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query, label, key ORDER BY score DESC, vec_id) AS n FROM ls) WHERE n = 1) {_top('SELECT * FROM m', 'query, label, key, score, vec_id', tie='vec_id')}""",
    "debounce_sessions": """WITH c AS (SELECT DISTINCT change_id, project, ts FROM file_changes), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY project ORDER BY ts, change_id)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY project ORDER BY ts, change_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT project, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY project, s.n""",
    "tumbling_counts": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "watched_changes": """WITH c AS (SELECT DISTINCT change_id, project, rel_path, kind, ts FROM file_changes), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 SECOND THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY project, rel_path ORDER BY ts, change_id)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY project, rel_path ORDER BY ts, change_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
        l AS (SELECT *, row_number() OVER (PARTITION BY project, rel_path, n ORDER BY ts DESC, change_id DESC) AS rn FROM s) SELECT project, rel_path, kind, epoch_us(ts) AS ts_us FROM l WHERE rn = 1""",
}
