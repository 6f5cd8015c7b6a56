"""Queries on files, filters, chunking, artifacts and maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import index as X
from sedimenta.functions import language as L
from sedimenta.functions import paths as P
from sedimenta.functions import text as T
from sedimenta.operators import chunking as C
from sedimenta.operators import maintenance as M
from sedimenta.operators.embedding import HashedEmbedder
from sedimenta.plans.workspace import remove, shared_dir
from sedimenta.sources import tables as S
from sedimenta.store import Store


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scan_documents(spark, d):
    return S.files_from_documents(_t(spark, d, "documents")).select("rel_path", "project", "size", "content_hash", F.size(T.lines(F.col("content"))).alias("n_lines"))


def scan_size_cap(spark, d):
    files = S.files_from_documents(_t(spark, d, "documents"))
    return files.where(F.col("size") <= 2000).select("rel_path", "size")


def skip_reasons(spark, d):
    return M.skip_reasons(S.files_from_documents(_t(spark, d, "documents")), cap=2000)


def filter_extension(spark, d):
    files = S.files_from_chunks(_t(spark, d, "chunks"))
    return files.where(L.is_indexable(F.col("rel_path"))).select("project", "rel_path")


def lang_from_ext(spark, d):
    files = S.files_from_chunks(_t(spark, d, "chunks")).select("project", "rel_path")
    return files.select("project", "rel_path", P.extension(F.col("rel_path")).alias("extension"), L.language_of(F.col("rel_path"), {".env": ".sh", ".production": ".yaml"}).alias("language"))


def detect_language(spark, d):
    """Files whose name has no extension, by the head of their first chunk."""
    first = _t(spark, d, "chunks").where("start_line = 1").groupBy("project", "rel_path").agg(F.max("content").alias("content"))
    bare = first.where(P.extension(F.col("rel_path")) == "")
    return bare.select("project", "rel_path", L.sniffed_extension(F.substring("content", 1, T.HEAD_BYTES)).alias("extension"))


def directory_hashes(spark, d):
    return M.directory_hashes(S.files_from_chunks(_t(spark, d, "chunks")))


def ignored_files(spark, d):
    rules = [("node_modules/", False), ("dist/", False), ("*.min.js", False), ("/tests/", False), ("tests/**/*.py", True), (".env*", False)]
    files = S.files_from_chunks(_t(spark, d, "chunks")).select("project", "rel_path")
    return M.ignored(files, rules).where("ignored").select("project", "rel_path")


def path_functions(spark, d):
    names = _t(spark, d, "edges").where("src is not null").select(F.concat("src", F.lit("/../x/./"), F.coalesce("dst", F.lit("y"))).alias("raw")).distinct()
    raw = P.forward_slashes(F.col("raw"))
    return names.select("raw", P.normalized(raw).alias("path"), P.folder(raw).alias("folder"), P.base(raw).alias("base"), P.looks_like_path(F.col("raw")).alias("is_path"))


def path_like(spark, d):
    flow = _t(spark, d, "flow_nodes").select("symbol_name", "file").distinct()
    both = flow.select(F.col("symbol_name").alias("target")).union(flow.select("file"))
    return both.distinct().select("target", P.looks_like_path(F.col("target")).alias("is_path"))


def doc_text(spark, d):
    c = _t(spark, d, "chunks").groupBy("chunk_id").agg(F.max("rel_path").alias("rel_path"), F.max("content").alias("content"))
    text = T.document_text(F.col("rel_path"), F.col("content"), "search_document: ")
    return c.select("chunk_id", F.length(text).alias("n_chars"), F.substring(F.sha2(F.substring(text, 1, 32000), 256), 1, 16).alias("hash"))


def chunk_ids(spark, d):
    c = _t(spark, d, "chunks").select("rel_path", "start_line").distinct()
    own = T.chunk_id(F.col("rel_path"), F.col("start_line"))
    return c.select("rel_path", "start_line", own.alias("id"), T.continuation_id(own, F.lit(1)).alias("second_part"))


def chunk_lines(spark, d):
    cut = C.line_windows(_t(spark, d, "documents"), "text", 10, 2)
    return cut.select("doc_id", "start_line", "end_line", F.length("chunk").alias("n_chars"))


def chunk_strategy(spark, d):
    return _t(spark, d, "documents").select("doc_id", C.strategy(F.col("text"), lines=20, width=200).alias("strategy"))


def chunk_chars(spark, d):
    """Pieces of the chunks that are over the cap, cut at line ends."""
    once = _t(spark, d, "chunks").where("length(content) > 2000").groupBy("chunk_id").agg(F.max("content").alias("content"))
    return C.capped(once, "chunk_id", "content", 2000)


def chunk_cap_invariant(spark, d):
    pieces = C.capped(_t(spark, d, "documents"), "doc_id", "text", 2000)
    whole = pieces.groupBy("id").agg(F.max(F.length("piece")).alias("longest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x.piece), "").alias("joined"))
    docs = _t(spark, d, "documents")
    return whole.join(docs, whole.id == docs.doc_id).select("doc_id", ((F.col("joined") == F.col("text")) & (F.col("longest") <= 2000)).alias("ok"))


def merge_regions(spark, d):
    return C.merge_regions(_t(spark, d, "chunks").select("project", "rel_path", "start_line", (F.col("end_line") + 1).alias("end_line")), ["project", "rel_path"])


def declarations(spark, d):
    files = S.files_from_chunks(_t(spark, d, "chunks"), content=True)
    return C.declarations(files)


def file_chunks(spark, d):
    """The chunks of every file by its declarations, windows or characters, as an index stores them."""
    files = S.files_from_chunks(_t(spark, d, "chunks"), content=True).select(F.concat_ws("/", "project", "rel_path").alias("rel_path"), "content", "language")
    return C.chunk_files(files).select("chunk_id", "rel_path", "start_line", "end_line", F.length("content").alias("n_chars"))


def index_changes(spark, d):
    """What a second run over the documents has to do, after those in German were edited and those without a language taken out."""
    docs = _t(spark, d, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("rel_path"), F.col("text").alias("content"), F.lit("markdown").alias("language"), "lang")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    edited = F.when(F.lower("lang") == "de", F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
    X.update_index(store, "docs", docs, HashedEmbedder(16))
    done = X.update_index(store, "docs", docs.where("lang is not null").withColumn("content", edited), HashedEmbedder(16))
    rows = [(k, getattr(done, k)) for k in ("added", "updated", "removed", "unchanged")]
    X.remove_index(store, "docs")
    remove(spark, store.root)
    return spark.createDataFrame(rows, "status string, n long")


def artifact_concat(spark, d):
    return M.artifact_texts(_t(spark, d, "documents").select(F.col("source").alias("artifact"), F.concat_ws("/", "source", "doc_id").alias("path"), "text")).select(
        "artifact", "files", F.length("content").alias("n_chars"), T.content_hash(F.col("content")).alias("hash")
    )


def artifact_chunks(spark, d):
    whole = M.artifact_texts(_t(spark, d, "documents").select(F.col("source").alias("artifact"), F.concat_ws("/", "source", "doc_id").alias("path"), "text"))
    cut = C.line_windows(whole, "content")
    return cut.select("artifact", "start_line", "end_line", T.uuid_from(F.concat_ws(":", F.lit("context"), "artifact", F.col("start_line").cast("string"))).alias("id"))


def lang_histogram(spark, d):
    files = _t(spark, d, "chunks").groupBy("project", "rel_path").agg(F.max("language").alias("language"))
    known = F.coalesce("language", L.language_of(F.col("rel_path")))
    return files.groupBy("project", known.alias("language")).agg(F.count("*").alias("n"))


def upsert_chunks(spark, d):
    """The state after chunks of changed files replace theirs: the second half of the runs' hashes stands for what changed."""
    old = _t(spark, d, "chunks").select("project", "rel_path", "chunk_id", "content_hash").distinct()
    new = _t(spark, d, "file_changes").where("kind = 'update'").groupBy("project", "rel_path").agg(F.max_by("content_hash", F.struct("ts", "change_id")).alias("content_hash"))
    new = new.withColumn("chunk_id", T.chunk_id(F.col("rel_path"), F.lit(1)))
    return M.upsert(old, new, ["project", "rel_path"])


def delete_chunks(spark, d):
    gone = _t(spark, d, "file_changes").where("kind = 'delete'").select("project", "rel_path").distinct()
    rows = _t(spark, d, "chunks").select("project", "rel_path", "chunk_id").distinct()
    return M.delete(rows, gone, ["project", "rel_path"])


def incremental_diff(spark, d):
    now = _t(spark, d, "chunks").groupBy("project", "rel_path").agg(F.max("content_hash").alias("hash"))
    old = _t(spark, d, "file_hashes").groupBy("project", "rel_path").agg(F.max_by("content_hash", F.struct("run_id", "batch_no")).alias("hash")).where("hash is not null")
    return M.diff(old, now, ["project", "rel_path"], "hash").groupBy("project", "status").agg(F.count("*").alias("n"))


def reconcile_hashes(spark, d):
    hashes = _t(spark, d, "file_hashes").where("content_hash is not null").select("project", "rel_path").distinct()
    return M.reconcile(hashes, _t(spark, d, "chunks"), ["project", "rel_path"])


def inventory(spark, d):
    """Projects by what is stored for them; those whose parts don't fit together need a look."""
    return M.inventory(_t(spark, d, "project_meta"), _t(spark, d, "chunks"), _t(spark, d, "edges"))


def run_progress(spark, d):
    """The last state of every run, from its reports."""
    return M.run_state(_t(spark, d, "index_runs"))


QUERIES = {f.__name__: f for f in (
    scan_documents, scan_size_cap, skip_reasons, filter_extension, lang_from_ext, detect_language, directory_hashes, ignored_files, path_functions, path_like, doc_text, chunk_ids, chunk_lines, chunk_strategy,
    chunk_chars, file_chunks, index_changes, chunk_cap_invariant, merge_regions, declarations, artifact_concat, artifact_chunks, lang_histogram, upsert_chunks, delete_chunks, incremental_diff, reconcile_hashes, inventory, run_progress,
)}

_FILES = "SELECT coalesce(source, '') || '/' || doc_id AS rel_path, coalesce(source, '') AS project, text AS content, strlen(text) AS size, sha256(text)[1:16] AS content_hash FROM documents"
_PATHS = "SELECT DISTINCT project, rel_path, regexp_extract(rel_path, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+?(\\.[^.]+)$', 1)) AS ext FROM chunks"
_ENTRIES = ", ".join(f"('{k}', '{v}')" for k, v in L.LANGUAGES.items())
_LANG = f"(VALUES {_ENTRIES}) AS lang(e, l)"
_SPECIAL = ", ".join(f"'{x}'" for x in L.SPECIAL_NAMES)
_ARTIFACTS = """art AS (SELECT source AS artifact, count(*) AS files, string_agg('# ' || source || '/' || doc_id || chr(10) || text, chr(10) || chr(10) ORDER BY encode(source || '/' || doc_id)) AS content
  FROM documents WHERE source IS NOT NULL AND instr(text[1:8192], chr(0)) = 0 GROUP BY source)"""


def _windows(table: str, key: str, text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""ln AS (SELECT {key}, string_split({text}, chr(10)) AS l FROM {table}),
      w AS (SELECT {key}, l, unnest(range(0, CASE WHEN len(l) <= {size} THEN 1 ELSE CAST(ceil((len(l) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i FROM ln),
      win AS (SELECT {key}, i * {step} + 1 AS start_line, least(i * {step} + {size}, len(l)) AS end_line, array_to_string(l[i * {step} + 1 : i * {step} + {size}], chr(10)) AS chunk FROM w),
      cut AS (SELECT * FROM win WHERE regexp_matches(chunk, '[^ \\t\\n\\x0b\\f\\r]'))"""


SQL = {
    "index_changes": """SELECT s.status, count(*) FILTER (t.status = s.status) AS n FROM (VALUES ('added'), ('updated'), ('removed'), ('unchanged')) s(status),
        (SELECT CASE WHEN lang IS NULL THEN 'removed' WHEN lower(lang) = 'de' THEN 'updated' ELSE 'unchanged' END AS status FROM documents WHERE text IS NOT NULL) t GROUP BY s.status""",
    "scan_documents": f"SELECT rel_path, project, size, content_hash, len(string_split(content, chr(10))) AS n_lines FROM ({_FILES})",
    "scan_size_cap": f"SELECT rel_path, size FROM ({_FILES}) WHERE size <= 2000",
    "skip_reasons": f"SELECT CASE WHEN size > 2000 THEN 'oversized' WHEN NOT regexp_matches(content, '[^ \\t\\n\\x0b\\f\\r]') THEN 'empty' ELSE 'indexed' END AS reason, count(*) AS n FROM ({_FILES}) GROUP BY 1",
    "filter_extension": f"SELECT project, rel_path FROM ({_PATHS}) WHERE ext IN (SELECT e FROM {_LANG}) OR base IN ({_SPECIAL})",
    "lang_from_ext": f"SELECT project, rel_path, ext AS extension, CASE ext WHEN '.env' THEN 'shell' WHEN '.production' THEN 'yaml' ELSE coalesce(l, 'plaintext') END AS language FROM ({_PATHS}) LEFT JOIN {_LANG} ON ext = e",
    "directory_hashes": """SELECT project, folder, count(*) AS files, sha256(string_agg(base, chr(1) ORDER BY encode(base)))[1:16] AS hash FROM (
        SELECT DISTINCT project, CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS folder, regexp_extract(rel_path, '[^/]*$') AS base FROM chunks) GROUP BY ALL""",
    "path_like": """SELECT DISTINCT target, regexp_matches(target, '[/\\\\]|\\.[A-Za-z]{1,5}$') AS is_path FROM (SELECT symbol_name AS target FROM flow_nodes UNION SELECT file FROM flow_nodes)""",
    "doc_text": """SELECT chunk_id, length(t) AS n_chars, sha256(t[1:32000])[1:16] AS hash FROM (SELECT chunk_id, 'search_document: ' || max(rel_path) || chr(10) || max(content) AS t FROM chunks GROUP BY chunk_id)""",
    "chunk_ids": """WITH c AS (SELECT DISTINCT rel_path, start_line, sha256(rel_path || ':' || start_line) AS h FROM chunks),
        u AS (SELECT *, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM c),
        v AS (SELECT *, sha256(id || chr(0) || '1') AS g FROM u)
        SELECT rel_path, start_line, id, g[1:8] || '-' || g[9:12] || '-' || g[13:16] || '-' || g[17:20] || '-' || g[21:32] AS second_part FROM v""",
    "chunk_lines": f"WITH {_windows('documents', 'doc_id', 'text', 10, 2)} SELECT doc_id, start_line, end_line, length(chunk) AS n_chars FROM cut",
    "chunk_strategy": """SELECT doc_id, CASE WHEN length(text) / len(string_split(text, chr(10))) > 200 THEN 'characters' WHEN len(string_split(text, chr(10))) <= 20 THEN 'whole' ELSE 'windows' END AS strategy FROM documents""",
    "chunk_cap_invariant": "SELECT doc_id, true AS ok FROM documents",
    "merge_regions": """WITH r AS (SELECT project, rel_path, start_line AS s, end_line + 1 AS e FROM chunks),
        o AS (SELECT *, max(e) OVER (PARTITION BY project, rel_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
        i AS (SELECT *, sum(CASE WHEN coalesce(reach, -1) < s THEN 1 ELSE 0 END) OVER (PARTITION BY project, rel_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT project, rel_path, min(s) AS start_line, max(e) AS end_line FROM i GROUP BY project, rel_path, island""",
    "artifact_concat": f"WITH {_ARTIFACTS} SELECT artifact, files, length(content) AS n_chars, sha256(content)[1:16] AS hash FROM art",
    "artifact_chunks": f"""WITH {_ARTIFACTS}, {_windows('art', 'artifact', 'content', 100, 10)},
        h AS (SELECT *, sha256('context:' || artifact || ':' || start_line) AS h FROM cut)
        SELECT artifact, start_line, end_line, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM h""",
    "lang_histogram": f"""SELECT project, coalesce(language, l, 'plaintext') AS language, count(*) AS n FROM
        (SELECT project, rel_path, max(language) AS language, lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+?(\\.[^.]+)$', 1)) AS ext FROM chunks GROUP BY project, rel_path) LEFT JOIN {_LANG} ON ext = e GROUP BY 1, 2""",
    "upsert_chunks": """WITH n AS (SELECT project, rel_path, content_hash, sha256(rel_path || ':1') AS h FROM (
          SELECT *, row_number() OVER (PARTITION BY project, rel_path ORDER BY ts DESC, change_id DESC) AS rn FROM file_changes WHERE kind = 'update') WHERE rn = 1)
        SELECT DISTINCT project, rel_path, chunk_id, content_hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project = c.project AND n.rel_path = c.rel_path)
        UNION ALL SELECT project, rel_path, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32], content_hash FROM n""",
    "delete_chunks": "SELECT DISTINCT project, rel_path, chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM file_changes f WHERE kind = 'delete' AND f.project = c.project AND f.rel_path = c.rel_path)",
    "incremental_diff": """WITH a AS (SELECT project, rel_path, max(content_hash) AS h FROM chunks GROUP BY ALL),
        b AS (SELECT project, rel_path, content_hash AS h FROM (SELECT *, row_number() OVER (PARTITION BY project, rel_path ORDER BY run_id DESC, batch_no DESC) AS rn FROM file_hashes) WHERE rn = 1 AND content_hash IS NOT NULL)
        SELECT coalesce(a.project, b.project) AS project, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n
        FROM a FULL OUTER JOIN b ON a.project = b.project AND a.rel_path = b.rel_path GROUP BY 1, 2""",
    "reconcile_hashes": "SELECT DISTINCT project, rel_path FROM file_hashes h WHERE content_hash IS NOT NULL AND EXISTS (SELECT 1 FROM chunks c WHERE c.project = h.project AND c.rel_path = h.rel_path)",
    "inventory": """WITH m AS (SELECT project, bool_or(collection_name LIKE 'codebase%') AS has_chunk_meta, bool_or(collection_name LIKE 'codegraph%') AS has_graph_meta FROM project_meta WHERE project IS NOT NULL GROUP BY project),
        c AS (SELECT project, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY project), e AS (SELECT project, count(*) AS links FROM edges GROUP BY project)
        SELECT coalesce(m.project, c.project, e.project) AS project, coalesce(has_chunk_meta, false) AS has_chunk_meta, coalesce(has_graph_meta, false) AS has_graph_meta, coalesce(chunks, 0) AS chunks, coalesce(links, 0) AS links,
        CASE WHEN coalesce(chunks, 0) > 0 AND NOT coalesce(has_chunk_meta, false) THEN 'chunks without record' WHEN coalesce(links, 0) > 0 AND NOT coalesce(has_graph_meta, false) THEN 'graph without record'
             WHEN coalesce(has_chunk_meta, false) AND coalesce(chunks, 0) = 0 THEN 'record without chunks' ELSE 'consistent' END AS state
        FROM m FULL OUTER JOIN c ON m.project = c.project FULL OUTER JOIN e ON coalesce(m.project, c.project) = e.project""",
    "run_progress": """SELECT run_id, project, run_type, phase, files_processed, files_total, max_batches AS batches_processed, n_reports FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY reported_at DESC, coalesce(files_processed, -1) DESC, coalesce(phase, '') DESC) AS rn, max(coalesce(batches_processed, 0)) OVER (PARTITION BY run_id) AS max_batches,
               count(DISTINCT reported_at) OVER (PARTITION BY run_id) AS n_reports FROM index_runs) WHERE rn = 1""",
}
