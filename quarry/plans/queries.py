"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import tokenizers
from quarry.operators import bm25, chunks, fusion, markdown, vectors
from quarry.sources.store import Store
from quarry.sources.tables import BM25Table, ChunkSchema, ChunkTable

TERMS = 5
TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}]+')"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").where("doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows  # a small file is one split only


_STORES: dict[tuple, Store] = {}


def _store(spark, sf_dir) -> Store:
    """A store of the session in the shared folder, with the keyword index over `documents`: built once, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        store = Store(spark, f"{base}/quarry-index-{uuid.uuid4().hex}")
        with store.transaction():
            table = BM25Table(store, "unicode_word", name="bm25")
            table.open()
            table.insert(_records(spark, sf_dir))
        _STORES[key] = store
    return _STORES[key]


def _table(spark, sf_dir, name: str = "bm25") -> BM25Table:
    """The index, or a clone of it under a name of its own."""
    store = _store(spark, sf_dir)
    if name != "bm25":
        with store.transaction():
            store.clone("bm25_docs", f"{name}_docs")
            store.clone("bm25_postings", f"{name}_postings")
    return BM25Table(store, "unicode_word", name=name)


def _toxic(spark, sf_dir):
    """The ids of the documents that `labels` calls toxic: the rows that deletions and replacements act on."""
    return _t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()


def _docs(spark, sf_dir):
    return bm25.docs_of(_records(spark, sf_dir), tokenizers.create("unicode_word"))


def _queries(spark, sf_dir):
    """Each benchmark item is a query, with its whole text."""
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("label"))


def _vector_queries(spark, sf_dir):
    """The rows whose id is divisible by 100 ask."""
    return _t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id, (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) + (length(regexp_replace(text, '[一-鿿]', '', 'g')) // 4))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_CLEAN = """WITH r AS (SELECT {id}, list_transform(string_split(regexp_replace({text}, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')) AS l FROM {table})
SELECT {id}, array_to_string(list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> ''), chr(10)) AS cleaned FROM r"""


@query(_CLEAN.format(id="doc_id", text="replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10))", table="documents"))
def clean_text(spark, sf_dir):
    """Documents with every sentence followed by spaces and blank lines, cleaned."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.clean(F.replace("text", F.lit(". "), F.lit(".  \n\n\n"))).alias("cleaned"))


_MARKED = "SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN repeat('#', (1 + (line_no // 3 * 5 + doc_id) % 6)::INT) || ' ' || line ELSE line END AS line FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def marked(spark, sf_dir):
    """Documents made Markdown by a fixed rule: every third line is a heading of level 1 + (5 * (line / 3) + id) mod 6."""
    rows = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (F.lit(1) + F.pmod(F.floor(i / 3) * 5 + F.col("doc_id"), F.lit(6))).cast("int")), F.lit(" "), x)).otherwise(x))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(rows, "\n").alias("text"))


@query(f"""WITH h AS (SELECT doc_id, line_no::BIGINT AS line_no, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) AS title FROM ({_MARKED}) WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.*)$'))
SELECT a.doc_id, a.line_no, a.level::INT AS level, a.title, string_agg(b.title, ' > ' ORDER BY b.line_no) AS breadcrumb FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.line_no <= a.line_no AND (b.line_no = a.line_no OR b.level < a.level)
WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level) GROUP BY ALL""")
def breadcrumbs(spark, sf_dir):
    return T.outline(marked(spark, sf_dir))


_LINES = "SELECT doc_id, i::BIGINT AS seq, x AS line, (length(x) // 4)::BIGINT AS tokens FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _line_chunks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.floor(F.length("line") / 4).cast("long").alias("tokens"), F.array("line").alias("segments"))


@query(f"""WITH g AS (SELECT *, greatest(1, sum((tokens >= 30)::INT) OVER (PARTITION BY doc_id ORDER BY seq)) AS g FROM ({_LINES}))
SELECT doc_id, g::BIGINT AS seq, sum(tokens)::BIGINT AS tokens, string_agg(line, chr(10) ORDER BY seq) AS body FROM g GROUP BY doc_id, g HAVING count(*) > 1 OR sum((tokens >= 30)::INT) > 0""")
def small_chunk_merge(spark, sf_dir):
    return chunks.merge_small(_line_chunks(spark, sf_dir), 30, "doc_id").select("doc_id", "seq", "tokens", F.array_join("segments", "\n").alias("body"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text)")
def dedup_keep_first(spark, sf_dir):
    return chunks.keep_first(_t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash")), "content_hash", "doc_id")


@query("SELECT conv_id::VARCHAR AS chunk_id, role AS path, min(turn) AS start_line, max(turn) AS end_line FROM conversations GROUP BY ALL")
def chunk_sources(spark, sf_dir):
    return chunks.provenance(_t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("chunk_id"), F.col("role").alias("path"), F.col("turn").alias("start_line"), F.col("turn").alias("end_line")))


_DOCS = f"docs AS (SELECT doc_id::VARCHAR AS chunk_id, {TOKENS} AS tokens, len({TOKENS})::BIGINT AS dl FROM documents), post AS (SELECT t AS term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, dl, unnest(tokens) AS t FROM docs) GROUP BY t, chunk_id)"


@query(f"WITH {_DOCS} SELECT term, chunk_id, tf, dl FROM post")
def postings(spark, sf_dir):
    return bm25.postings(_docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT chunk_id, dl FROM docs")
def doc_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select("chunk_id", "dl")


@query(f"WITH {_DOCS} SELECT count(*) AS n, sum(dl)::BIGINT AS total_dl FROM docs")
def corpus_stats(spark, sf_dir):
    return bm25.stats(_docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark, sf_dir):
    return bm25.postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


def _ranked(table: BM25Table, queries, k: int = 10, method: str = "own", **args):
    """A search of the stored index by any scorer."""
    state = table.store.state()
    docs, index = (table.store.read(f"{table.name}_{t}", state) for t in ("docs", "postings"))
    meta = state[f"{table.name}_docs"]["meta"]
    return bm25.search(docs, queries, table.tokenizer, k, method, index=index, totals=(meta["n"], meta["total_dl"]), **args)


def _search(spark, sf_dir, table: str = "bm25", **args):
    return _rounded(_ranked(_table(spark, sf_dir, table), _queries(spark, sf_dir), **args), "score")


def _bm25_sql(idf: str, part: str, docs: str = _DOCS, floor: str = "") -> str:
    return f"""WITH {docs}, q AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM docs), f AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w0 AS (SELECT term, {idf} AS idf FROM f, s), w AS ({floor or 'SELECT * FROM w0'}),
r AS (SELECT query_id, chunk_id, -sum({part}) AS score FROM post JOIN q USING (term) JOIN w USING (term), s GROUP BY query_id, chunk_id)
SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank FROM r) WHERE rank <= 10"""


_OWN_IDF = "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))"
_RAW = "(ln(n - df + 0.5e0) - ln(df + 0.5e0))"


def _own(k1, b):
    return f"idf * qtf * tf / (tf / ({k1}e0 + 1) + {k1}e0 / ({k1}e0 + 1) * (1 - {b}e0 + {b}e0 * dl / avgdl))"


def _classic(k1, b):
    return f"idf * qtf * tf * ({k1}e0 + 1) / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * dl / avgdl))"


@query(_bm25_sql(_OWN_IDF, _own(1.5, 0.75)))
def bm25_own(spark, sf_dir):
    return _search(spark, sf_dir)


@query(_bm25_sql(_RAW, _classic(1.5, 0.75), floor="SELECT term, CASE WHEN idf < 0 THEN (SELECT 0.25e0 * avg(idf) FROM w0) ELSE idf END AS idf FROM w0"))
def bm25_okapi(spark, sf_dir):
    return _search(spark, sf_dir, method="okapi")


@query(_bm25_sql(f"greatest(1e-6, {_RAW})", _classic(1.2, 0.75)))
def bm25_fulltext(spark, sf_dir):
    return _search(spark, sf_dir, method="fulltext")


@query(_bm25_sql(_OWN_IDF, _own(0.0, 0.75)))
def bm25_k1_zero(spark, sf_dir):
    return _search(spark, sf_dir, k1=0.0)


@query(_bm25_sql(_OWN_IDF, _own(2.0, 0.3)))
def bm25_tuned(spark, sf_dir):
    return _search(spark, sf_dir, k1=2.0, b=0.3)


_GONE = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@query(_bm25_sql(_OWN_IDF, _own(1.5, 0.75), _DOCS.replace("FROM documents)", f"FROM documents WHERE NOT {_GONE})")))
def bm25_after_delete(spark, sf_dir):
    """Search after the toxic documents were deleted from a clone of the index: postings and totals follow."""
    table = _table(spark, sf_dir, "after_delete")
    table.delete(_toxic(spark, sf_dir))
    return _rounded(_ranked(table, _queries(spark, sf_dir)), "score")


@query(_bm25_sql(_OWN_IDF, _own(1.5, 0.75), _DOCS.replace("FROM documents)", f"FROM (SELECT doc_id, CASE WHEN {_GONE} THEN 'replaced by ' || source ELSE text END AS text FROM documents))")))
def bm25_replace(spark, sf_dir):
    """Search after the toxic documents were replaced by a short text in a clone of the index."""
    table = _table(spark, sf_dir, "replaced")
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("replaced by "), "source").alias("text"))
    table.replace(rows.join(_toxic(spark, sf_dir), "chunk_id", "left_semi"))
    return _rounded(_ranked(table, _queries(spark, sf_dir)), "score")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_UNIT = f"SELECT vec_id, label, list_transform(embedding, lambda x: (x / {_NORM})::FLOAT) AS u FROM embeddings"


@query(f"SELECT vec_id::VARCHAR AS chunk_id, round(list_sum(list_transform(u, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS length2, round(u[1]::DOUBLE, 5) AS first FROM ({_UNIT})")
def vec_normalize(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("chunk_id", vectors.normalize(F.col("embedding"), 64).alias("u"))
    return v.select("chunk_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("length2"), F.round(F.col("u")[0].cast("double"), 5).alias("first"))


def _knn_sql(distance: str, where: str = "true", k: int = 10) -> str:
    return f"""WITH u AS ({_UNIT}), r AS (SELECT q.vec_id AS query_id, d.vec_id::VARCHAR AS chunk_id, {distance} AS distance FROM u d, u q WHERE q.vec_id % 100 = 0 AND {where})
SELECT query_id, rank::INT AS rank, chunk_id, round(abs(distance), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM r) WHERE rank <= {k}"""


_DOT = "list_sum(list_transform(list_zip(d.u, q.u), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_L2 = "sqrt(list_sum(list_transform(list_zip(d.u, q.u), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


def _shown(found):
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", F.round(F.abs("distance"), 4).alias("distance"))


def _knn(spark, sf_dir, **args):
    return _shown(vectors.knn(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10, filterable=("label",), **args))


@query(_knn_sql(f"1 - {_DOT}"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_knn_sql(_L2))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, metric="L2")


@query(_knn_sql(_L2, "d.label::VARCHAR >= '3' AND d.vec_id::VARCHAR < '7'"))
def knn_filtered(spark, sf_dir):
    """Filters compare text and hold before the top k."""
    return _knn(spark, sf_dir, metric="L2", where={"label": (">=", "3"), "chunk_id": ("<", "7")})


@query(_knn_sql(_L2, "d.vec_id IN (SELECT conv_id FROM conversations WHERE role = 'system')"))
def knn_semijoin(spark, sf_dir):
    """Nearest neighbours among the chunks of one path only."""
    ids = _t(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("chunk_id")).distinct()
    return _shown(vectors.knn(_vectors(spark, sf_dir).join(ids, "chunk_id", "left_semi"), _vector_queries(spark, sf_dir), 10, metric="L2"))


@query("SELECT event_id, event_type FROM events WHERE event_id::VARCHAR >= '18' AND event_type <= 'p'")
def where_string_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("chunk_id"), "event_type")
    return rows.where(vectors.predicate(vectors.conditions({"chunk_id": (">=", "18"), "event_type": ("<=", "p")}, ("event_type",)))).select("event_id", "event_type")


@query("SELECT DISTINCT conv_id::VARCHAR AS chunk_id FROM conversations WHERE role = 'system'")
def ids_by_path(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("chunk_id")).distinct()


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def delete_by_path(spark, sf_dir):
    """Chunks that touch a path go as a whole."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.join(rows.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn", "role")


def _hits(spark, sf_dir, coarse: int):
    """Two keyword retrievers and a vector retriever as ranked lists, 0 to 2. An item's vector is that of its id."""
    asked, table = _queries(spark, sf_dir), _table(spark, sf_dir)
    one = _ranked(table, asked, coarse).select("query_id", F.lit(0).alias("retriever_idx"), "rank", "chunk_id")
    two = _ranked(table, asked, coarse, "fulltext").select("query_id", F.lit(1).alias("retriever_idx"), "rank", "chunk_id")
    asked = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(asked.select("query_id"), "query_id", "left_semi")
    three = vectors.knn(_vectors(spark, sf_dir), asked, coarse).select("query_id", F.lit(2).alias("retriever_idx"), "rank", "chunk_id")
    return one.unionByName(two).unionByName(three)


_NEAR = f"""WITH u AS ({_UNIT}), r AS (SELECT q.vec_id AS query_id, d.vec_id::VARCHAR AS chunk_id, 1 - {_DOT} AS distance FROM u d, u q WHERE q.vec_id IN (SELECT item_id FROM benchmark))
SELECT query_id, rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) AS rank FROM r) WHERE rank <= 10"""
_LISTS = f"WITH a AS ({_bm25_sql(_OWN_IDF, _own(1.5, 0.75))}), b AS ({_bm25_sql(f'greatest(1e-6, {_RAW})', _classic(1.2, 0.75))}), v AS ({_NEAR}), h AS (SELECT query_id, 0 AS i, rank, chunk_id FROM a UNION ALL SELECT query_id, 1, rank, chunk_id FROM b UNION ALL SELECT query_id, 2, rank, chunk_id FROM v), f AS (SELECT query_id, chunk_id, sum(1e0 / (60 + rank)) AS score, min(i * 100000 + rank) AS first FROM h GROUP BY ALL), o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank, chunk_id, score FROM f)"


@query(f"{_LISTS} SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM o")
def rrf_fuse(spark, sf_dir):
    return _rounded(fusion.rrf(_hits(spark, sf_dir, 10)), "score")


def _stored(spark, sf_dir):
    """Documents as a content table."""
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("path"), F.lit(0).alias("start_line"), F.col("n_chars").alias("end_line"), F.col("text").alias("content"))


def _found(spark, sf_dir, content):
    got = fusion.with_content(fusion.rrf(_hits(spark, sf_dir, 10)), content, 5)
    return _rounded(got, "score").select("query_id", "rank", "chunk_id", "score", F.md5("content").alias("content_md5"), F.col("sources")[0]["path"].alias("path"))


_FOUND = f"{_LISTS} SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score, md5(text) AS content_md5, source AS path FROM o JOIN documents d ON d.doc_id::VARCHAR = chunk_id WHERE rank <= 5"


@query(_FOUND)
def hybrid_search(spark, sf_dir):
    """Recall by three retrievers, fusion, the best five, content."""
    return _found(spark, sf_dir, _stored(spark, sf_dir))


@query(f"{_FOUND} AND NOT {_GONE}")
def missing_content_dropped(spark, sf_dir):
    """The same where toxic documents have no content: what has none is dropped, not made up for."""
    return _found(spark, sf_dir, _stored(spark, sf_dir).join(_toxic(spark, sf_dir), "chunk_id", "left_anti"))


@query(f"{_LISTS} SELECT query_id, count(*) AS n FROM o WHERE rank <= 50 GROUP BY query_id")
def coarse_lt_k(spark, sf_dir):
    """With fewer candidates than k there are fewer results than k."""
    return fusion.rrf(_hits(spark, sf_dir, 10)).where("rank <= 50").groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS chunk_id, role AS path, min(turn)::INT AS start_line, max(turn)::INT AS end_line, 'conversation ' || conv_id AS content FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) GROUP BY ALL")
def chunk_get(spark, sf_dir):
    """All sources of one chunk, from a chunk table that holds every conversation (a path for each role)."""
    rows = _t(spark, sf_dir, "conversations").where("conv_id is not null and role is not null")
    places = rows.groupBy("conv_id", "role").agg(F.min("turn").cast("int").alias("a"), F.max("turn").cast("int").alias("b"))
    records = places.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("path"), F.col("a").alias("start_line"), F.col("b").alias("end_line"))).alias("sources"))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    table = ChunkTable(Store(spark, f"{base}/quarry-chunks-{uuid.uuid4().hex}"))
    table.create_table(ChunkSchema())
    table.insert(records.select(F.col("conv_id").cast("string").alias("chunk_id"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("content"), "sources"))
    first = rows.agg(F.min("conv_id").cast("string").alias("id")).first()["id"]
    return table.get(first).select("chunk_id", "path", "start_line", "end_line", "content")


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE regexp_matches(line, '\S'))
SELECT doc_id, 'text' AS kind, min(i)::BIGINT AS first, max(i)::BIGINT AS last FROM b GROUP BY doc_id, g""")
def line_blocks(spark, sf_dir):
    """Blocks of lines; `documents` hold neither code fences nor tables, so all are text."""
    return markdown.line_blocks(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def markdown_chunks(spark, sf_dir):
    """The cutter over documents made Markdown by `marked`; tests compare it with the cutter's rules."""
    cut = markdown.chunk(marked(spark, sf_dir), 256, key="doc_id")
    segment = lambda name: F.col("segments")[0][name]
    return cut.select("doc_id", "seq", "tokens", F.size("segments").alias("n_segments"), segment("pref").alias("breadcrumb"), segment("start_line").alias("start_line"), F.element_at("segments", -1)["end_line"].alias("end_line"), F.md5(T.render(F.col("segments"))).alias("content_md5"))


@query("SELECT doc_id, md5(source || chr(1) || md5(text)) AS chunk_id, md5(text) AS content_hash FROM documents")
def chunk_identity_md5(spark, sf_dir):
    """Content-addressed ids with md5 in place of the 128-bit default, so that SQL can follow."""
    one = F.array(F.struct(F.lit("").alias("pref"), F.col("text"), F.col("source").alias("file_path")))
    return chunks.identify(_t(spark, sf_dir, "documents").select("doc_id", one.alias("segments")), F.md5).select("doc_id", "chunk_id", "content_hash")


@query()
def chunk_identity(spark, sf_dir):
    one = F.array(F.struct(F.lit("").alias("pref"), F.col("text"), F.col("source").alias("file_path")))
    return chunks.identify(_t(spark, sf_dir, "documents").select("doc_id", one.alias("segments"))).select("doc_id", "chunk_id", "content_hash")
