"""Every query of the library over the driver's tables, with SQL of the same result where SQL can express it.

Corpus: documents, with the first line (80 characters) as name. Queries: benchmark. Pairs: a user's turn and the
assistant's next one. Gold: documents that contain a benchmark text.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from lexloom.functions import metrics, text
from lexloom.operators import cache, decode, evaluate, index, latent, prepare, rank, records, retrieve, store
from lexloom.sources import json_io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CONTEXT_CHARS = records.CONTEXT_CHARS


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, 80).alias("name"), body.alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, prediction, reference): the two turns share a conversation, so the join is on it and the turn."""
    return records.pairs_of_turns(table(spark, sf_dir, "conversations"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, answer, context): labelled documents as contexts, their name as question, their last line as answer."""
    docs = corpus(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("id"), F.col("name").alias("question"), F.element_at(F.split("text", "\n"), -1).alias("answer"), F.col("text").alias("context"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gold_by_text(corpus(spark, sf_dir), asked(spark, sf_dir))


_indexes: dict[tuple, index.Index] = {}


def indexed(spark: SparkSession, sf_dir: str, chars: int | None = None) -> index.Index:
    """The index of the corpus (of `chars` characters of each text), built once in a session for the files as they are."""
    files = cache.fingerprints(table(spark, sf_dir, "documents"))
    key = (spark.sparkContext.applicationId, store.cleared(spark), chars, cache.cache_key({"files": [{k: str(v) for k, v in f.items()} for f in files]}))
    if key not in _indexes:
        docs = corpus(spark, sf_dir)
        _indexes[key] = index.Index.build(docs) if chars is None else retrieve.dense_index(docs, chars)
    return _indexes[key]


def release(spark: SparkSession) -> None:
    """Gives up the indexes of this session and removes all that it has stored."""
    for key in [k for k in _indexes if k[0] == spark.sparkContext.applicationId]:
        del _indexes[key]
    store.clear(spark)


# ---- pieces of SQL

W = r"'[\p{L}\p{N}_]+'"
WM = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]'"
SP = r"'[\s\p{Z}\x0b\x1c-\x1f\x85]+'"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {W})"


def _marks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {WM})"


DOCS = "docs AS (SELECT doc_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS name, coalesce(text, '') AS text FROM documents)"
Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
PAIRS = "pairs AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS prediction, b.text AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
EXAMPLES = DOCS + ", examples AS (SELECT doc_id AS id, name AS question, split_part(text, chr(10), -1) AS answer, text AS context FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"


def _postings(source: str = "name || ' ' || text", p: str = "") -> str:
    """tok, dl, st, tf and df of a text of docs; p: a prefix of their names."""
    return f"""{p}tok AS (SELECT doc_id, {_words(source)} AS t FROM docs),
{p}dl AS (SELECT doc_id, len(t)::BIGINT AS dl FROM {p}tok),
{p}st AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM {p}dl),
{p}tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT term, count(*)::BIGINT AS df, ln(1 + ((SELECT n FROM {p}st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {p}tf GROUP BY term)"""


def _terms(source: str = "q", name: str = "qt") -> str:
    """qt (query_id, term, qtf, first_pos), first_pos being the place of a term's first occurrence."""
    return f"{name} AS (SELECT query_id, term, count(*)::BIGINT AS qtf, min(pos) AS first_pos FROM (SELECT query_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM (SELECT query_id, {_words('text')} AS w FROM {source})) GROUP BY ALL)"


def _bm25(name: str = "bm", terms: str = "qt", p: str = "") -> str:
    """bm (query_id, doc_id, score, first), first being the place of the first term that touches the document: it orders equal scores."""
    return f"""{name} AS (SELECT query_id, doc_id, min(first_pos) AS first, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
FROM {terms} JOIN {p}tf USING (term) JOIN {p}df USING (term) JOIN {p}dl USING (doc_id), {p}st GROUP BY ALL)"""


def _tfidf(source: str, terms: str = "qt", features: int = 100_000) -> str:
    """vec (doc_id, term, idf, weight) and cos (query_id, doc_id, score)."""
    return f"""vtok AS (SELECT doc_id, {_words(source)} AS t FROM docs),
vtf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM vtok) GROUP BY ALL),
vidf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)::DOUBLE) / (1 + count(*))) + 1 AS idf FROM vtf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {features}),
raw AS (SELECT doc_id, term, idf, (1 + ln(tf)) * idf AS w FROM vtf JOIN vidf USING (term)),
vnorm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
vec AS (SELECT doc_id, term, idf, w / norm AS weight FROM raw JOIN vnorm USING (doc_id)),
qnorm AS (SELECT query_id, sqrt(sum(pow((1 + ln(qtf)) * idf, 2))) AS norm FROM {terms} JOIN vidf USING (term) GROUP BY query_id),
cos AS (SELECT query_id, doc_id, sum(weight * (1 + ln(qtf)) * vec.idf) / any_value(norm) AS score FROM vec JOIN {terms} USING (term) JOIN qnorm USING (query_id) GROUP BY ALL)"""


def _ties(source: str) -> str:
    return "first, " if source in ("bm", "acc") else ""


def _top(source: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {_ties(source)}doc_id) AS rank FROM {source}) WHERE rank <= {k})"


def _fuse(maps: list[tuple[str, float]], name: str = "fused") -> str:
    n = len(maps)
    union = " UNION ALL ".join("SELECT query_id, doc_id, " + ", ".join(f"{'score' if i == j else 'NULL::DOUBLE'} AS s{j}" for j in range(n)) + f" FROM {m}" for i, (m, _) in enumerate(maps))
    total = " + ".join(f"{w}::DOUBLE * CASE WHEN max(s{i}) OVER w > min(s{i}) OVER w THEN (s{i} - min(s{i}) OVER w) / (max(s{i}) OVER w - min(s{i}) OVER w) ELSE 0 END" for i, (_, w) in enumerate(maps))
    return f"""u AS (SELECT query_id, doc_id, {", ".join(f"coalesce(sum(s{i}), 0) AS s{i}" for i in range(n))} FROM ({union}) GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, {total} AS score FROM u WINDOW w AS (PARTITION BY query_id))"""


def _ranked(source: str, k: int = 3) -> str:
    return f"SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {_ties(source)}doc_id) AS rank FROM {source}) WHERE rank <= {k}"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


BM25 = [DOCS, Q, _postings(), _terms(), _bm25()]
TITLED = "name || ' ' || left(text, 12000)"
NAMED = "name || ' ' || text"

# ---- text functions


@query(_with(DOCS, f"SELECT doc_id, {_words('text')} AS tokens FROM docs"))
def tokenize_words(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.words("text").alias("tokens"))


@query(_with(DOCS, f"SELECT doc_id, {_marks('text')} AS tokens FROM docs"))
def tokenize_wordpunct(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.words_and_marks("text").alias("tokens"))


@query(_with(DOCS, f"SELECT doc_id, trim(regexp_replace(text, {SP}, ' ', 'g')) AS cleaned FROM docs"))
def normalize_space(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.single_spaced("text").alias("cleaned"))


@query(
    _with(
        DOCS,
        f"cut AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, {SP}, ' ', 'g')), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM docs)",
        "SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '') AS sentences FROM cut",
    )
)
def sentence_split(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.sentences("text").alias("sentences"))


URLS = "SELECT * FROM VALUES (-1L, 'https://a.vn/van-ban/luat-dat-dai-2013.aspx?x=1'), (-2L, 'https://a.vn'), (-3L, ''), (-4L, 'https://a.vn/x/y.aspx#z') AS t(page_id, url)"


@query(
    r"""SELECT page_id, regexp_replace(list_extract(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), -1), '\.aspx$', '') AS slug
FROM (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES (-1, 'https://a.vn/van-ban/luat-dat-dai-2013.aspx?x=1'), (-2, 'https://a.vn'), (-3, ''), (-4, 'https://a.vn/x/y.aspx#z')) AS t(page_id, url))"""
)
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(spark.sql(URLS)).select("page_id", text.url_slug("url").alias("slug"))


@query(
    r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id ELSE regexp_replace(list_extract(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), -1), '\.aspx$', '') END AS key FROM pages"""
)
def context_key(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  page "), F.col("page_id").cast("string"))).otherwise(F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", text.document_key(name, F.col("url")).alias("key"))


#: Documents whose lines are made articles of a legal text, each third one lettered; what is asked names one of them, or none that is there.
LEGAL = [
    DOCS,
    r"""lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))), lambda x: x <> '') AS l FROM docs)""",
    "marked AS (SELECT doc_id, l, list_transform(l, lambda x, i: CASE WHEN i % 2 = 0 THEN 'Điều ' ELSE 'DIEU ' END || i || CASE WHEN i % 3 = 0 THEN 'a' ELSE '' END || '. ' || x) AS m FROM lines)",
    """legal AS (SELECT doc_id AS id, l, m, 'Mở đầu. ' || array_to_string(m, ' ') AS passage, doc_id % (len(l) + 2) + 1 AS n, CASE WHEN doc_id % 5 = 0 THEN (doc_id % (len(l) + 2) + 1)::VARCHAR END AS given,
CASE WHEN doc_id % 5 = 1 THEN 'Theo Điều  ' || (doc_id % (len(l) + 2) + 1) || '.' WHEN doc_id % 5 = 2 THEN 'không rõ' END AS answer, CASE WHEN doc_id % 5 < 4 THEN 'dieu ' || (doc_id % (len(l) + 2) + 1) || 'a nói gì' ELSE 'hỏi' END AS question FROM marked)""",
    # given and answer name the bare number, the question the lettered one
    "named AS (SELECT *, CASE WHEN doc_mod < 2 THEN n::VARCHAR WHEN doc_mod < 4 THEN n || 'a' END AS article FROM (SELECT *, id % 5 AS doc_mod FROM legal))",
]


def _legal(spark, sf_dir):
    """(id, passage, given, answer, question), as the SQL above says."""
    lines = F.filter(F.transform(F.split("text", "\n"), text.single_spaced), lambda x: x != "")
    own = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), lines.alias("l"))
    word = lambda i: F.when((i + 1) % 2 == 0, "Điều ").otherwise("DIEU ")
    letter = lambda i: F.when((i + 1) % 3 == 0, "a").otherwise("")
    marked = F.transform("l", lambda x, i: F.concat(word(i), (i + 1).cast("string"), letter(i), F.lit(". "), x))
    n, kind = (F.col("id") % (F.size("l") + 2) + 1).cast("string"), F.col("id") % 5
    return own.select(
        "id",
        F.concat(F.lit("Mở đầu. "), F.array_join(marked, " ")).alias("passage"),
        F.when(kind == 0, n).alias("given"),
        F.when(kind == 1, F.concat(F.lit("Theo Điều  "), n, F.lit("."))).when(kind == 2, "không rõ").alias("answer"),
        F.when(kind < 4, F.concat(F.lit("dieu "), n, F.lit("a nói gì"))).otherwise("hỏi").alias("question"),
    )


@query(_with(*LEGAL, "SELECT id, article FROM named"))
def infer_article(spark, sf_dir):
    return _legal(spark, sf_dir).select("id", text.article_number(F.col("given"), F.col("answer"), F.col("question")).alias("article"))


ARTICLE_WINDOW = f"CASE WHEN article IS NOT NULL AND n <= len(l) AND (article = n || 'a') = (n % 3 = 0) THEN left(trim(m[n]), {CONTEXT_CHARS}) ELSE left(passage, {CONTEXT_CHARS}) END"


@query(_with(*LEGAL, f"SELECT id, {ARTICLE_WINDOW} AS win FROM named"))
def article_window(spark, sf_dir):
    df = _legal(spark, sf_dir).withColumn("a", text.article_number(F.col("given"), F.col("answer"), F.col("question")))
    return df.select("id", text.article_window(F.col("passage"), F.col("a"), CONTEXT_CHARS).alias("win"))


@query(_with(*LEGAL, f"refs AS (SELECT id, unnest([0, 1]) AS pos, unnest([id, id + 1]) AS doc_id, article, n FROM named)", f"SELECT refs.id, pos::INTEGER AS pos, doc_id, {ARTICLE_WINDOW.replace('article', 'refs.article').replace('n <=', 'refs.n <=').replace('= n ||', '= refs.n ||').replace('(n %', '(refs.n %').replace('m[n]', 'm[refs.n]')} AS passage FROM refs JOIN named ON refs.doc_id = named.id"))
def article_context_lookup(spark, sf_dir):
    """Contexts of references that name articles: the article of a document, and of the next one."""
    legal = _legal(spark, sf_dir)
    article = text.article_number(F.col("given"), F.col("answer"), F.col("question"))
    refs = legal.select("id", article.alias("article"), F.posexplode(F.array("id", F.col("id") + 1)).alias("pos", "doc_id"))
    return records.context_lookup(refs, legal.select(F.col("id").alias("doc_id"), F.col("passage").alias("text")))


ASKED = "CASE item_id % 4 WHEN 0 THEN 'Nghị định và Luật: ' WHEN 1 THEN 'THÔNG TƯ ' WHEN 2 THEN 'luật ' ELSE '' END || text"


@query("SELECT id, q || ' ' || concat_ws(' ', " + ", ".join(f"CASE WHEN contains(lower(q), '{k}') THEN '{v}' END" for k, v in text.REWRITES) + f") AS rewritten FROM (SELECT item_id AS id, {ASKED} AS q FROM benchmark)")
def query_rewrite_rules(spark, sf_dir):
    kind = F.col("item_id") % 4
    opening = F.when(kind == 0, "Nghị định và Luật: ").when(kind == 1, "THÔNG TƯ ").when(kind == 2, "luật ").otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.rewritten(F.concat(opening, F.col("text"))).alias("rewritten"))


@query(f"SELECT item_id, 'câu hỏi: ' || text || ' ngữ cảnh: ' || left(text, {CONTEXT_CHARS}) AS prompt FROM benchmark")
def prompt_format(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", records.prompt("text", "text").alias("prompt"))


@query("SELECT item_id, left(sha256(text), 16) AS key FROM benchmark")
def cache_key_sha2(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 16).alias("key"))


@query("SELECT item_id, left(sha1(text), 16) AS key FROM benchmark")
def cache_key_sha1(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", cache.key_column("text").alias("key"))


# ---- index and scores


@query(_with(DOCS, _postings(), "SELECT doc_id, term, tf FROM tf"))
def term_freq(spark, sf_dir):
    return indexed(spark, sf_dir).postings.select("doc_id", "term", "tf")


@query(_with(DOCS, _postings(), "SELECT term, df, round(idf, 6) AS idf FROM df"))
def doc_freq_idf(spark, sf_dir):
    return indexed(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(_with(DOCS, _postings(), "SELECT n::BIGINT AS n, round(avgdl, 4) AS avgdl, (SELECT sum(dl)::BIGINT FROM dl) AS total FROM st"))
def doc_length_stats(spark, sf_dir):
    tokens = index.tokenized(corpus(spark, sf_dir))
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)), 4).alias("avgdl"), F.sum(F.size("tokens").cast("long")).alias("total"))


@query(_with(*BM25, "SELECT query_id, doc_id, round(score, 6) AS score FROM bm"))
def bm25_scores(spark, sf_dir):
    return index.bm25_scores(indexed(spark, sf_dir), index.query_terms(asked(spark, sf_dir))).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(_with(*BM25, _ranked("bm")))
def bm25_top3(spark, sf_dir):
    return retrieve.bm25(corpus(spark, sf_dir), asked(spark, sf_dir), index=indexed(spark, sf_dir))


@query(_with(DOCS, Q, _terms(), _tfidf(NAMED), "SELECT doc_id, term, round(weight, 6) AS weight FROM vec"))
def tfidf_vectors(spark, sf_dir):
    return index.tfidf_vectors(indexed(spark, sf_dir)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(_with(DOCS, Q, _terms(), _tfidf(TITLED), _ranked("cos")))
def tfidf_cosine_top3(spark, sf_dir):
    return retrieve.dense(corpus(spark, sf_dir), asked(spark, sf_dir), vectors=indexed(spark, sf_dir, 12_000))


VECS = "vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"), F.col("embedding").alias("v")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(_with(VECS, _ranked("vs")))
def vector_top3(spark, sf_dir):
    return rank.ranked(retrieve.vector_search(*_vectors(spark, sf_dir), 3), 3)


@query(_with(VECS, _top("vs", 100, "c"), _fuse([("c", 1.0)]), "SELECT query_id, doc_id, round(score, 5) AS score FROM fused"))
def vector_minmax(spark, sf_dir):
    best = rank.top_k(retrieve.vector_search(*_vectors(spark, sf_dir), 100), 100)
    return rank.fuse([(best, 1.0)]).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(_with(*BM25, _top("bm", 100, "c"), _fuse([("c", 1.0)]), "SELECT query_id, doc_id, round(score, 5) AS score FROM fused"))
def minmax_normalize(spark, sf_dir):
    scores = index.bm25_search(indexed(spark, sf_dir), index.query_terms(asked(spark, sf_dir)), 100)
    return rank.fuse([(rank.top_k(scores, 100), 1.0)]).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def _hybrid(source: str) -> list[str]:
    """fused (query_id, doc_id, score): BM25 and the vectors of a text of docs."""
    return [*BM25, _tfidf(source), _top("bm", 100, "c1"), _top("cos", 100, "c2"), _fuse([("c1", 0.5), ("c2", 0.5)])]


def _both(spark, sf_dir):
    return {"index": indexed(spark, sf_dir), "vectors": indexed(spark, sf_dir, 12_000)}


@query(_with(*_hybrid(NAMED), "SELECT query_id, doc_id, round(score, 5) AS score FROM fused"))
def weighted_fusion(spark, sf_dir):
    own = indexed(spark, sf_dir)
    sparse, near = retrieve.candidates_of(corpus(spark, sf_dir), asked(spark, sf_dir), 100, index=own, vectors=own)
    return rank.fuse([(sparse, 0.5), (near, 0.5)]).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query(_with(*_hybrid(TITLED), _ranked("fused")))
def hybrid_top3(spark, sf_dir):
    return retrieve.hybrid(corpus(spark, sf_dir), asked(spark, sf_dir), **_both(spark, sf_dir))


REWRITTEN = "q AS (SELECT item_id AS query_id, text || ' ' || concat_ws(' ', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in text.REWRITES) + ") AS text FROM benchmark)"


@query(_with(DOCS, REWRITTEN, _postings(), _terms(), _bm25(), _tfidf(NAMED), _top("bm", 120, "c1"), _top("cos", 120, "c2"), _fuse([("c1", 0.7), ("c2", 0.3)]), _ranked("fused")))
def rewrite_hybrid_top3(spark, sf_dir):
    own = indexed(spark, sf_dir)
    return retrieve.rewriting_hybrid(corpus(spark, sf_dir), asked(spark, sf_dir), index=own, vectors=own)


COMPACT = "docs AS (SELECT doc_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS name, left(coalesce(text, ''), 2500) AS text FROM documents)"


@query(_with(COMPACT, Q, _postings(), _terms(), _bm25(), _tfidf("name || ' ' || left(text, 2500)", features=40_000), _top("bm", 60, "c1"), _top("cos", 60, "c2"), _fuse([("c1", 0.65), ("c2", 0.35)]), _ranked("fused")))
def compact_hybrid_top3(spark, sf_dir):
    return retrieve.compact_hybrid(corpus(spark, sf_dir), asked(spark, sf_dir))


@query(
    _with(
        *BM25,
        _tfidf(TITLED),
        _top("bm", 80, "c1"),
        _top("cos", 80, "c2"),
        f"ov AS (SELECT query_id, doc_id, len(list_intersect({_words('q.text')}, {_words('name')}))::DOUBLE AS score FROM (SELECT query_id, doc_id FROM c1 UNION SELECT query_id, doc_id FROM c2) JOIN docs USING (doc_id) JOIN q USING (query_id))",
        "c3 AS (SELECT * FROM ov WHERE score > 0)",
        _fuse([("c1", 0.45), ("c2", 0.45), ("c3", 0.1)]),
        _ranked("fused"),
    )
)
def title_overlap_fusion_top3(spark, sf_dir):
    return retrieve.title_fusion(corpus(spark, sf_dir), asked(spark, sf_dir), **_both(spark, sf_dir))


def _expand(source: str) -> list[str]:
    """ex (query_id, term, weight, rank): what a query's seeds add to it from a text of docs."""
    return [
        *BM25,
        _top("bm", 5, "seed"),
        f"stok AS (SELECT query_id, rank, {_words(source)} AS t FROM seed JOIN docs USING (doc_id))",
        "sterm AS (SELECT query_id, rank, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM stok)",
        "scount AS (SELECT query_id, term, count(*) AS c, min(rank * 1000000 + pos) AS first FROM sterm WHERE length(term) > 2 AND (query_id, term) NOT IN (SELECT query_id, term FROM qt) GROUP BY ALL)",
        "ex AS (SELECT * FROM (SELECT query_id, term, c * idf AS weight, row_number() OVER (PARTITION BY query_id ORDER BY round(c * idf, 6) DESC, first) AS rank FROM scount JOIN df USING (term)) WHERE rank <= 8)",
    ]


@query(_with(*_expand("left(text, 6000)"), "SELECT query_id, term, round(weight, 6) AS weight, rank::INTEGER AS rank FROM ex"))
def expansion_terms(spark, sf_dir):
    own, terms = indexed(spark, sf_dir), index.query_terms(asked(spark, sf_dir))
    best = rank.top_k(index.bm25_search(own, terms, 5), 5)
    return retrieve.expansion_terms(corpus(spark, sf_dir), best, terms, own.terms.select("term", "idf")).select("query_id", "term", F.round("weight", 6).alias("weight"), "rank")


@query(
    _with(
        *_expand("text"),
        # queries without new terms stop
        "qt2 AS (SELECT * FROM qt WHERE query_id IN (SELECT query_id FROM ex) UNION ALL SELECT query_id, term, 1, 1000000 + rank FROM ex)",
        _bm25("bm2", "qt2"),
        "acc AS (SELECT query_id, doc_id, min(first) AS first, sum(s) AS score FROM (SELECT query_id, doc_id, first, score AS s FROM bm UNION ALL SELECT query_id, doc_id, first, score / 2 FROM bm2) GROUP BY ALL)",
        _ranked("acc"),
    )
)
def iterative_expansion_top3(spark, sf_dir):
    return retrieve.iterative_expansion(corpus(spark, sf_dir), asked(spark, sf_dir), index=indexed(spark, sf_dir))


SALIENT = [
    f"gtok AS (SELECT doc_id, {_words(chr(39).join(['name || ', ' ', ' || left(text, 8000)']))} AS t FROM docs)",
    "gterm AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM gtok)",
    "gcount AS (SELECT doc_id, term, count(*) AS c, min(pos) AS first FROM gterm WHERE length(term) > 2 GROUP BY ALL)",
    "edge AS (SELECT * FROM (SELECT doc_id, term, c * idf AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(c * idf, 6) DESC, first) AS rank FROM gcount JOIN df USING (term)) WHERE rank <= 40)",
]


@query(_with(DOCS, _postings(), *SALIENT, "SELECT doc_id, term, round(weight, 6) AS weight, rank::INTEGER AS rank FROM edge"))
def salient_terms(spark, sf_dir):
    return retrieve.salient_terms(corpus(spark, sf_dir), indexed(spark, sf_dir)).select("doc_id", "term", F.round("weight", 6).alias("weight"), "rank")


@query(
    _with(
        *BM25,
        *SALIENT,
        "deg AS (SELECT term, count(*) AS degree FROM edge GROUP BY term)",
        "near AS (SELECT * FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM edge) WHERE r <= 200)",
        _top("bm", 20, "seed"),
        "sized AS (SELECT doc_id, count(*) AS terms FROM edge GROUP BY doc_id)",
        "act AS (SELECT query_id, term, sum(a) AS a FROM (SELECT query_id, term, qtf * idf AS a FROM qt JOIN deg USING (term) JOIN df USING (term) UNION ALL SELECT query_id, term, 0.15::DOUBLE * score / greatest(terms, 1) FROM seed JOIN edge USING (doc_id) JOIN sized USING (doc_id)) GROUP BY ALL)",
        "ds AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, near.doc_id, a / sqrt(degree) AS s FROM act JOIN deg USING (term) JOIN near USING (term) UNION ALL SELECT query_id, doc_id, score FROM seed) GROUP BY ALL)",
        _fuse([("bm", 0.55), ("ds", 0.45)]),
        _ranked("fused"),
    )
)
def term_graph_propagation_top3(spark, sf_dir):
    return retrieve.graph_propagation(corpus(spark, sf_dir), asked(spark, sf_dir), index=indexed(spark, sf_dir))


CLUSTERS = [
        "cm AS (SELECT label AS cluster, i, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL)",
        "cn AS (SELECT cluster, i, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS x FROM cm)",
        "e AS (SELECT vec_id, label AS cluster, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        "cs AS (SELECT vec_id AS query_id, cn.cluster, round(sum(e.x * cn.x), 6) AS s FROM e JOIN cn USING (i) WHERE vec_id % 100 = 0 GROUP BY ALL)",
        "pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) AS r FROM cs) WHERE r <= 4)",
]


@query(
    _with(
        *CLUSTERS,
        "sc AS (SELECT query_id, b.vec_id AS doc_id, sum(a.x * b.x) AS score FROM pick JOIN e b USING (cluster) JOIN e a ON a.vec_id = query_id AND a.i = b.i WHERE b.vec_id <> query_id GROUP BY ALL)",
        _ranked("sc"),
    )
)
def cluster_pruned_top3(spark, sf_dir):
    return retrieve.cluster_pruned(*_vectors(spark, sf_dir))


def _kmeans(k: int, rounds: int = 4, source: str = "SELECT vec_id, embedding FROM embeddings") -> list[str]:
    """kv (vec_id, i, x) and, after the last round, km (vec_id, cluster)."""
    out = [
        f"kv AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM ({source}))",
        f"k0 AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cluster FROM ({source}) QUALIFY cluster < {k})",
        "c0 AS MATERIALIZED (SELECT cluster, i, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS x FROM k0 JOIN kv USING (vec_id))",
    ]
    for n in range(rounds):
        out.append(f"km{n} AS MATERIALIZED (SELECT vec_id, cluster FROM (SELECT vec_id, cluster, round(sum(kv.x * c{n}.x), 6) AS s FROM kv JOIN c{n} USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1)")
        out.append(f"m{n} AS (SELECT cluster, i, avg(x) AS x FROM km{n} JOIN kv USING (vec_id) GROUP BY ALL)")
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(u.x, c{n}.x) AS x FROM c{n} LEFT JOIN (SELECT cluster, i, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS x FROM m{n}) u USING (cluster, i))")
    return [*out, f"km AS (SELECT * FROM km{rounds - 1})"]


@query(_with(*_kmeans(16), "SELECT vec_id AS doc_id, cluster::INTEGER AS cluster FROM km"))
def kmeans_assign(spark, sf_dir):
    return retrieve.kmeans_assign(_vectors(spark, sf_dir)[0], 16)


@query()
def lsa_top3(spark, sf_dir):
    return retrieve.lsa(corpus(spark, sf_dir), asked(spark, sf_dir), latent=latent.Latent.fit(indexed(spark, sf_dir)))


VECTORED = "docs AS (SELECT doc_id, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS name, coalesce(text, '') AS text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"


@query(
    _with(
        VECTORED,
        "q AS (SELECT doc_id AS query_id, name AS text FROM docs WHERE doc_id % 100 = 0)",
        _postings(),
        _terms(),
        _bm25(),
        *CLUSTERS,
        "cand AS (SELECT query_id, b.vec_id AS doc_id, sum(a.x * b.x) AS score FROM pick JOIN e b USING (cluster) JOIN e a ON a.vec_id = query_id AND a.i = b.i GROUP BY ALL)",
        "scoped AS (SELECT query_id, doc_id, coalesce(bm.score, 0) AS score FROM cand LEFT JOIN bm USING (query_id, doc_id))",
        _fuse([("scoped", 0.5), ("cand", 0.5)]),
        _ranked("fused"),
    )
)
def cluster_fusion_top3(spark, sf_dir):
    """Cluster retrieval with the stored label as cluster: documents that have a vector, queries by every hundredth one's name."""
    vectors, q = _vectors(spark, sf_dir)
    docs = corpus(spark, sf_dir).join(index.small(vectors.select("doc_id")), "doc_id", "left_semi")
    asked_ = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("name").alias("text"))
    return retrieve.cluster_fusion(vectors, q, index.Index.build(docs), index.query_terms(asked_))


HELD = "SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)"


@query(
    _with(
        VECTORED,
        "q AS (SELECT doc_id AS query_id, name AS text FROM docs WHERE doc_id % 100 = 0)",
        _postings(),
        _terms(),
        _bm25(),
        *_kmeans(64, source=HELD),
        # centres of the last assignment
        "cn AS (SELECT cluster, i, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS x FROM (SELECT cluster, i, avg(x) AS x FROM km JOIN kv USING (vec_id) GROUP BY ALL))",
        "cs AS (SELECT vec_id AS query_id, cluster, round(sum(kv.x * cn.x), 6) AS s FROM kv JOIN cn USING (i) WHERE vec_id % 100 = 0 GROUP BY ALL)",
        "pick AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) <= 4)",
        "cand AS (SELECT query_id, km.vec_id AS doc_id, sum(a.x * b.x) AS score FROM pick JOIN km USING (cluster) JOIN kv b ON b.vec_id = km.vec_id JOIN kv a ON a.vec_id = query_id AND a.i = b.i GROUP BY ALL)",
        "scoped AS (SELECT query_id, doc_id, coalesce(bm.score, 0) AS score FROM cand LEFT JOIN bm USING (query_id, doc_id))",
        _fuse([("scoped", 0.5), ("cand", 0.5)]),
        _ranked("fused"),
    )
)
def cluster_retrieval_top3(spark, sf_dir):
    """Cluster retrieval whose clusters come from the vectors: documents that have one, queries by every hundredth one's name."""
    vectors, q = _vectors(spark, sf_dir)
    docs = corpus(spark, sf_dir).join(index.small(vectors.select("doc_id")), "doc_id", "left_semi")
    vectors = vectors.drop("cluster").join(docs.select("doc_id"), "doc_id", "left_semi")
    q = q.join(docs.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    asked_ = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("name").alias("text"))
    return retrieve.clustered(vectors, q, index.Index.build(docs), index.query_terms(asked_))


@query()
def latent_hybrid_top3(spark, sf_dir):
    """The reference's default: fusion of BM25 and latent vectors. The vectors are iterative, so there is no SQL."""
    both = indexed(spark, sf_dir), indexed(spark, sf_dir, 12_000)
    return retrieve.latent_hybrid(corpus(spark, sf_dir), asked(spark, sf_dir), index=both[0], latent=latent.Latent.fit(both[1]))


# ---- evaluation

GOLD = "gold AS (SELECT query_id, doc_id FROM docs JOIN q ON contains(docs.text, q.text))"
EVAL = [
    *BM25,
    GOLD,
    "res AS (" + _ranked("bm") + ")",
    "ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id)",
    "fd AS (SELECT query_id, count(*) AS n, sum((gold.doc_id IS NOT NULL)::INTEGER) AS hits, min(CASE WHEN gold.doc_id IS NOT NULL THEN rank END) AS first_hit_rank FROM res LEFT JOIN gold USING (query_id, doc_id) GROUP BY query_id)",
    "pr AS (SELECT query_id, coalesce(hits, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS p, coalesce(hits, 0) / n_gold::DOUBLE AS r, first_hit_rank FROM ng LEFT JOIN fd USING (query_id))",
    "per AS (SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, first_hit_rank::INTEGER AS first_hit_rank, coalesce((first_hit_rank = 1)::INTEGER, 0) AS hit_at_1, round(coalesce(1 / first_hit_rank::DOUBLE, 0), 6) AS rr FROM pr)",
]


@query(_with(*EVAL, "SELECT * FROM per"))
def retrieval_metrics_per_query(spark, sf_dir):
    return evaluate.per_query(bm25_top3(spark, sf_dir), gold(spark, sf_dir))


@query(_with(*EVAL, "SELECT count(*) AS queries, round(coalesce(avg(precision), 0), 5) AS precision, round(coalesce(avg(recall), 0), 5) AS recall, round(coalesce(avg(f1), 0), 5) AS f1, round(coalesce(avg(hit_at_1), 0), 5) AS hit_at_1, round(coalesce(avg(rr), 0), 5) AS mrr FROM per"))
def retrieval_metrics_mean(spark, sf_dir):
    return evaluate.means(retrieval_metrics_per_query(spark, sf_dir))


@query(_with(*EVAL, "SELECT query_id, len(list(doc_id))::INTEGER AS n, string_agg(doc_id || ':' || name, '|' ORDER BY rank) AS listed FROM res JOIN docs USING (doc_id) GROUP BY query_id"))
def ranked_results_nested(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = evaluate.nested(retrieve.bm25(docs, asked(spark, sf_dir), index=indexed(spark, sf_dir)), docs.select("doc_id", "name"))
    listed = F.array_join(F.transform("retrieved_contexts", lambda s: F.concat(s["doc_id"].cast("string"), F.lit(":"), s["name"])), "|")
    return rows.select("query_id", F.size("retrieved_contexts").alias("n"), listed.alias("listed"))


# ---- joins of preparation


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def referenced_corpus_semi(spark, sf_dir):
    refs = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(refs, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT 'src' || (vec_id % 5) FROM embeddings)")
def structured_corpus_semi(spark, sf_dir):
    keys = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")).alias("source")).distinct()
    return table(spark, sf_dir, "documents").join(keys, "source", "left_semi").select("doc_id", "source")


REFS = "refs AS (SELECT item_id AS id, unnest([item_id * 7, item_id * 3 + 1, 99999999]) AS doc_id, unnest([0, 1, 2]) AS pos FROM benchmark)"


def _references(spark, sf_dir):
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("id"), F.posexplode(F.array(i * 7, i * 3 + 1, F.lit(99999999).cast("long"))).alias("pos", "doc_id"))


FULL = f"full_refs AS (SELECT id, pos::INTEGER AS pos, doc_id, left(trim(regexp_replace(text, {SP}, ' ', 'g')), {CONTEXT_CHARS}) AS passage FROM refs JOIN docs USING (doc_id))"


@query(_with(DOCS, REFS, FULL, "SELECT * FROM full_refs WHERE passage <> ''"))
def gold_context_lookup(spark, sf_dir):
    return records.context_lookup(_references(spark, sf_dir), corpus(spark, sf_dir), CONTEXT_CHARS)


@query(_with(DOCS, REFS, FULL, "SELECT id, string_agg(passage, chr(10) || chr(10) ORDER BY pos) AS context FROM full_refs WHERE passage <> '' GROUP BY id"))
def context_concat(spark, sf_dir):
    return records.joined_contexts(gold_context_lookup(spark, sf_dir))


@query(_with(DOCS, "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN ' ' END), ''), CASE WHEN doc_id % 2 = 0 THEN 'field ' || doc_id END, nullif(trim(name), ''), 'lookup') AS context FROM docs"))
def field_coalesce(spark, sf_dir):
    fields = [F.when(F.col("doc_id") % 4 == 0, F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("field "), F.col("doc_id").cast("string"))), F.trim("name"), F.lit("lookup")]
    return corpus(spark, sf_dir).select("doc_id", F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields]).alias("context"))


# ---- chunks, vocabularies, spans

CHUNK = [
    EXAMPLES,
    f"ct AS (SELECT id, {_marks('context')} AS t, list_distinct({_marks('question')}) AS qs FROM examples)",
    "pos AS (SELECT id, unnest(range(len(t))) AS p, t, qs FROM ct)",
    "ch AS (SELECT id, p // 50 AS c, t[p + 1] AS tok, p, qs FROM pos)",
    "sc AS (SELECT id, c::INTEGER AS chunk, count(*)::INTEGER AS size, count(DISTINCT tok) AS nd, any_value(len(qs)) AS nq, count(DISTINCT CASE WHEN list_contains(qs, tok) THEN tok END) AS ov FROM ch GROUP BY id, c)",
    "sco AS (SELECT id, chunk, size, round(ov / greatest(nq, 1)::DOUBLE + ov / greatest(nd, 1)::DOUBLE, 9) AS score FROM sc)",
]


def _chunked(spark, sf_dir):
    return prepare.scored_chunks(examples(spark, sf_dir).select("id", F.col("question").alias("query"), "context"), 50)


@query(_with(*CHUNK[:4], "SELECT id, c::INTEGER AS chunk, list(tok ORDER BY p) AS tokens FROM ch GROUP BY id, c"))
def chunk_tokens(spark, sf_dir):
    return _chunked(spark, sf_dir).select("id", F.posexplode("parts").alias("chunk", "tokens")).filter("size(tokens) > 0")


@query(_with(*CHUNK, "SELECT id, chunk, round(score, 6) AS score FROM sco"))
def chunk_scores(spark, sf_dir):
    return _chunked(spark, sf_dir).select("id", F.explode("scored").alias("s")).filter(F.size("s.chunk") > 0).select("id", (-F.col("s.neg")).alias("chunk"), F.round("s.score", 6).alias("score"))


@query(
    _with(
        *CHUNK,
        "od AS (SELECT ch.id, tok, row_number() OVER (PARTITION BY ch.id ORDER BY score DESC, chunk, p) AS r FROM ch JOIN sco ON ch.id = sco.id AND ch.c = sco.chunk)",
        "SELECT id, string_agg(tok, ' ' ORDER BY r) AS selected FROM od WHERE r <= 1200 GROUP BY id",
    )
)
def chunk_budget_select(spark, sf_dir):
    df = examples(spark, sf_dir).select("id", F.col("question").alias("query"), "context")
    return prepare.select_within_budget(df, 50, 1200).select("id", "selected")


@query("SELECT event_id, (event_id % 20 + 1)::INTEGER AS epoch, round(greatest(0::DOUBLE, 0.8::DOUBLE - (event_id % 20) * 0.15::DOUBLE), 6) AS easy_ratio FROM events")
def curriculum_schedule(spark, sf_dir):
    """The share of easy queries in each event's epoch."""
    epochs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 20 + 1).cast("int").alias("epoch"))
    return epochs.withColumn("easy_ratio", F.round(prepare.easy_ratio("epoch", 0.8, 0.15), 6))


def _sequential_draws(seed: int, rows: int) -> str:
    """The draws of one generator in order of rows, as literal rows for DuckDB: the rule itself, row by row."""
    r = random.Random(seed)
    return ", ".join(f"({i}, {r.choice([50, 100, 200, 500])}, {r.random()!r}::DOUBLE)" for i in range(rows))


CURRICULUM = [
    EXAMPLES,
    f"drawn(row, size, u) AS (VALUES {_sequential_draws(23, 4096)})",
    f"ex AS (SELECT id, trim(regexp_replace(question, {SP}, ' ', 'g')) AS question, trim(regexp_replace(answer, {SP}, ' ', 'g')) AS answer, context, size, u < 0.5 AS easy FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row FROM examples) JOIN drawn USING (row))",
    f"ct AS (SELECT id, size, {_marks('context')} AS t, list_distinct(CASE WHEN easy THEN {_marks('answer')} ELSE {_marks('question')} END) AS qs FROM ex)",
    "pos AS (SELECT id, size, unnest(range(len(t))) AS p, t, qs FROM ct)",
    "ch AS (SELECT id, p // size AS c, t[p + 1] AS tok, p, qs FROM pos)",
    "sc AS (SELECT id, c, count(DISTINCT tok) AS nd, any_value(len(qs)) AS nq, count(DISTINCT CASE WHEN list_contains(qs, tok) THEN tok END) AS ov FROM ch GROUP BY id, c)",
    "sco AS (SELECT id, c, round(ov / greatest(nq, 1)::DOUBLE + ov / greatest(nd, 1)::DOUBLE, 9) AS score FROM sc)",
    "od AS (SELECT ch.id, tok, row_number() OVER (PARTITION BY ch.id ORDER BY score DESC, ch.c, p) AS r FROM ch JOIN sco ON ch.id = sco.id AND ch.c = sco.c)",
    "sel AS (SELECT id, string_agg(tok, ' ' ORDER BY r) AS context FROM od WHERE r <= 1200 GROUP BY id)",
    "SELECT id, question, sel.context AS context, answer, answer AS reference, size::INTEGER AS chunk_size, CASE WHEN easy THEN 'answer' ELSE 'question' END AS query_mode FROM ex JOIN sel USING (id) WHERE answer <> ''",
]


@query(_with(*CURRICULUM))
def curriculum_records(spark, sf_dir):
    return prepare.curriculum_records(examples(spark, sf_dir), [50, 100, 200, 500], 1200, 0.5)


VOCAB = [
    PAIRS,
    f"vt AS (SELECT id, 0 AS f, generate_subscripts(t, 1) AS p, unnest(t) AS token FROM (SELECT id, {_marks('prediction')} AS t FROM pairs) UNION ALL SELECT id, 1, generate_subscripts(t, 1), unnest(t) FROM (SELECT id, {_marks('reference')} AS t FROM pairs))",
    "vc AS (SELECT token, count(*) AS freq, min((id, f, p)) AS first FROM vt GROUP BY token HAVING count(*) >= 2)",
    "vocab AS (SELECT token, (row_number() OVER (ORDER BY freq DESC, first) + 3)::INTEGER AS idx, freq FROM vc UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<bos>', 2, 0), ('<eos>', 3, 0)) AS s(token, idx, freq))",
    "vocab30000 AS (SELECT * FROM vocab WHERE idx < 30000)",
]


@query(_with(*VOCAB, "SELECT token, idx, freq FROM vocab30000"))
def vocab_topn(spark, sf_dir):
    return prepare.vocabulary(pairs(spark, sf_dir), ["prediction", "reference"], 2, 30_000)


@query(
    _with(
        *VOCAB,
        f"e AS (SELECT id, generate_subscripts(t, 1) AS p, unnest(t) AS token FROM (SELECT id, {_marks('prediction')} AS t FROM pairs))",
        "l AS (SELECT id, list_concat([2], list_concat(list(coalesce(idx, 1) ORDER BY p), [3])) AS ids FROM e LEFT JOIN vocab30000 USING (token) GROUP BY id)",
        "SELECT id, list_transform(range(1, 1201), lambda i: coalesce(ids[i], 0)::INTEGER) AS ids FROM l",
    )
)
def encode_padded(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return prepare.encode(rows.select("id", text.words_and_marks("prediction").alias("tokens")), vocab_topn(spark, sf_dir), 1200, bos_eos=True)


@query(
    _with(
        EXAMPLES,
        f"cut AS (SELECT id, context, list_distinct({_marks('question')}) AS qs, string_split(regexp_replace(trim(regexp_replace(context, {SP}, ' ', 'g')), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM examples)",
        "ns AS (SELECT id, context, qs, list_filter(list_transform(s, lambda x: trim(x)), lambda x: x <> '') AS s FROM cut)",
        f"es AS (SELECT id, qs, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS sent FROM ns)",
        f"ed AS (SELECT id, i, sent, len(qs) AS nq, list_distinct({_marks('sent')}) AS st, len(list_intersect(qs, {_marks('sent')})) AS ov FROM es)",
        "er AS (SELECT *, round(ov / greatest(nq, 1)::DOUBLE + ov / greatest(len(st), 1)::DOUBLE, 9) AS score FROM ed)",
        "eb AS (SELECT id, sent, i, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM er WHERE score > 0) WHERE r = 1)",
        "SELECT id, coalesce(sent, left(context, 512)) AS evidence, coalesce(i, CASE WHEN context <> '' THEN 0 ELSE -1 END)::INTEGER AS evidence_idx, round(coalesce(score, 0), 6) AS evidence_score FROM examples LEFT JOIN eb USING (id)",
    )
)
def evidence_sentence(spark, sf_dir):
    # the nearest of the scaled number, as SQL rounds: round() takes a last digit of 5 from the printed number, which may lie beside it
    scaled = F.floor(F.col("evidence_score") * 1_000_000 + 0.5) / 1_000_000
    return prepare.evidence_sentence(examples(spark, sf_dir)).select("id", "evidence", "evidence_idx", scaled.alias("evidence_score"))


@query(
    _with(
        EXAMPLES,
        f"t AS (SELECT id, {_marks('context')} AS c, {_marks('answer')} AS n FROM examples)",
        "h AS (SELECT id, unnest(range(len(c) - len(n) + 1)) AS i, c, n FROM t WHERE len(n) > 0 AND len(n) <= len(c))",
        "f AS (SELECT id, min(i)::INTEGER AS start FROM h WHERE c[i + 1] = n[1] AND list_slice(c, i + 1, i + len(n)) = n GROUP BY id)",
        "SELECT id, start FROM examples LEFT JOIN f USING (id)",
    )
)
def subsequence_find(spark, sf_dir):
    df = examples(spark, sf_dir).select("id", text.words_and_marks("context").alias("c"), text.words_and_marks("answer").alias("n"))
    return df.select("id", prepare.find_run("c", "n").alias("start"))


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, {SP}, ' ', 'g'))"


#: Of ex (id, c, a: single-spaced context and answer), chars (id, s, e): the characters of the longest part that c holds.
CHARS = [
    r"""part AS (SELECT DISTINCT id, trim(unnest(list_concat([a], string_split(regexp_replace(a, '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)),
string_split(regexp_replace(a, '[;:。!?]', chr(1), 'g'), chr(1)), regexp_extract_all(a, '[“"]([^”"]+)[”"]', 1)))) AS p FROM ex)""",
    "held AS (SELECT id, c, p, strpos(lower(c), lower(p)) - 1 AS s FROM part JOIN ex USING (id) WHERE length(p) >= 12)",
    "longest AS (SELECT id, c, s, s + length(p) AS e FROM held WHERE s >= 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(p) DESC, p) = 1)",
    r"chars AS (SELECT id, s, e + CASE WHEN regexp_matches(substr(c, e, 1), '\p{Nd}') THEN length(regexp_extract(substr(c, e + 1), '^\.[\p{Nd}.]*')) ELSE 0 END AS e FROM longest)",
]

#: Of ot (id, t, a: tokens of a text and of an answer), best (id, s, e): the densest window; one that ends without a new hit is never best.
OVERLAP = [
    "sought AS (SELECT id, t, least(len(t), greatest(8, least(len(a), 160))) AS most, list_distinct(CASE WHEN len(list_filter(a, lambda x: length(x) > 1)) > 0 THEN list_filter(a, lambda x: length(x) > 1) ELSE a END) AS w FROM ot)",
    "each AS (SELECT id, w, most, unnest(range(len(t))) AS p, unnest(t) AS x FROM sought)",
    "hit AS (SELECT id, len(w) AS k, most, p, lag(p) OVER (PARTITION BY id, x ORDER BY p) AS prev FROM each WHERE list_contains(w, x))",
    "seen AS (SELECT a.id, a.k, a.p AS s, b.p AS e, sum(CASE WHEN b.prev IS NULL OR b.prev < a.p THEN 1 ELSE 0 END) OVER (PARTITION BY a.id, a.p ORDER BY b.p)::DOUBLE AS n FROM hit a JOIN hit b ON a.id = b.id AND b.p >= a.p AND b.p < a.p + a.most)",
    "best AS (SELECT id, s, e FROM seen QUALIFY row_number() OVER (PARTITION BY id ORDER BY n / k + n / (e - s + 1) DESC, s, e) = 1)",
]


@query(_with(EXAMPLES, f"ex AS (SELECT id, {_spaced('context')} AS c, {_spaced('answer')} AS a FROM examples)", *CHARS, 'SELECT id, s::INTEGER AS start, e::INTEGER AS "end" FROM ex LEFT JOIN chars USING (id)'))
def answer_span(spark, sf_dir):
    return examples(spark, sf_dir).withColumn("s", prepare.answer_span("context", "answer")).select("id", "s.start", "s.end")


@query(_with(PAIRS, f"ot AS (SELECT id, {_marks('reference')} AS t, {_marks('prediction')} AS a FROM pairs)", *OVERLAP, 'SELECT id, s::INTEGER AS start, e::INTEGER AS "end" FROM pairs LEFT JOIN best USING (id)'))
def best_overlap_span(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("s", prepare.best_overlap_span(text.words_and_marks("reference"), text.words_and_marks("prediction")))
    return df.select("id", "s.start", "s.end")


@query(
    _with(
        EXAMPLES,
        f"ex AS (SELECT id, question, {_spaced('answer')} AS a, left({_spaced('context')}, {CONTEXT_CHARS}) AS c FROM examples)",
        *CHARS,
        f"tok AS (SELECT id, {_marks('c')} AS t, {_marks('a')} AS a FROM ex)",
        # a token that a span's start cuts is counted before it, and belongs to it
        rf"exact AS (SELECT id, len({_marks('left(c, s)')}) - CASE WHEN s > 0 AND regexp_full_match(substr(c, s, 2), '[\p{{L}}\p{{N}}_]{{2}}') THEN 1 ELSE 0 END AS s, len({_marks('left(c, e)')}) - 1 AS e FROM chars JOIN ex USING (id))",
        "joined AS (SELECT id, len(a) AS n, chr(10) || array_to_string(t, chr(10)) || chr(10) AS x, chr(10) || array_to_string(a, chr(10)) || chr(10) AS y FROM tok WHERE len(a) > 0 AND id NOT IN (SELECT id FROM exact))",
        "run AS (SELECT id, len(string_split(left(x, strpos(x, y) - 1), chr(10))) - 1 AS s, s + n - 1 AS e FROM joined WHERE strpos(x, y) > 0)",
        "ot AS (SELECT id, t, a FROM tok WHERE id NOT IN (SELECT id FROM exact) AND id NOT IN (SELECT id FROM run))",
        *OVERLAP,
        "spans AS (SELECT * FROM exact UNION ALL SELECT * FROM run UNION ALL SELECT * FROM best)",
        f"""SELECT id, {_spaced('question')} AS question, array_to_string(list_slice(t, s + 1, e + 1), ' ') AS answer, array_to_string(list_slice(t, s + 1, e + 1), ' ') AS reference,
ex.a AS abstractive_reference, {_marks('question')} AS question_tokens, list_transform(range(least(6, ceil(len(t) / 256.0))::BIGINT), lambda k: list_slice(t, k * 256 + 1, k * 256 + 256)) AS passage_tokens,
s::INTEGER AS start, e::INTEGER AS "end" FROM spans JOIN tok USING (id) JOIN ex USING (id) WHERE e < 1536 AND trim(question) <> '' AND trim(ex.a) <> ''""",
    )
)
def extractive_records(spark, sf_dir):
    df = examples(spark, sf_dir).withColumn("answer_start", F.lit(None).cast("int")).withColumn("answer_end", F.lit(None).cast("int"))
    return prepare.extractive_records(df)


# a span of each labelled document: from its 40th character on, 1 to 60 characters; every seventh has none
SPANNED = EXAMPLES + ", spanned AS (SELECT id, context, CASE WHEN id % 7 > 0 THEN 40 + id % 100 END AS s, CASE WHEN id % 7 > 0 THEN 41 + id % 100 + id % 60 END AS e FROM examples)"


def _spanned(spark, sf_dir):
    i = F.col("id")
    df = examples(spark, sf_dir).withColumn("answer_start", F.when(i % 7 > 0, 40 + i % 100).cast("int"))
    return df.withColumn("answer_end", F.when(i % 7 > 0, 41 + i % 100 + i % 60).cast("int"))


# spans that are given: every seventh record has none; spans count in the cut and single-spaced context
GIVEN = f"ex AS (SELECT id, question, {_spaced('answer')} AS a, left({_spaced('context')}, {CONTEXT_CHARS}) AS c FROM examples)"


@query(
    _with(
        SPANNED,
        GIVEN,
        *CHARS[:-1],
        CHARS[-1].replace("chars AS", "sought_chars AS"),
        "chars AS (SELECT id, s, e FROM spanned JOIN ex USING (id) WHERE s IS NOT NULL AND e <= length(c) UNION ALL SELECT id, s, e FROM sought_chars WHERE id NOT IN (SELECT id FROM spanned WHERE s IS NOT NULL))",
        f"tok AS (SELECT id, {_marks('c')} AS t, {_marks('a')} AS a FROM ex)",
        rf"exact AS (SELECT id, len({_marks('left(c, s)')}) - CASE WHEN s > 0 AND regexp_full_match(substr(c, s, 2), '[\p{{L}}\p{{N}}_]{{2}}') THEN 1 ELSE 0 END AS s, len({_marks('left(c, e)')}) - 1 AS e FROM chars JOIN ex USING (id))",
        "found AS (SELECT * FROM exact WHERE s <= e)",
        "joined AS (SELECT id, len(a) AS n, chr(10) || array_to_string(t, chr(10)) || chr(10) AS x, chr(10) || array_to_string(a, chr(10)) || chr(10) AS y FROM tok WHERE len(a) > 0 AND id NOT IN (SELECT id FROM chars))",
        "run AS (SELECT id, len(string_split(left(x, strpos(x, y) - 1), chr(10))) - 1 AS s, s + n - 1 AS e FROM joined WHERE strpos(x, y) > 0)",
        "ot AS (SELECT id, t, a FROM tok WHERE id NOT IN (SELECT id FROM found) AND id NOT IN (SELECT id FROM run))",
        *OVERLAP,
        "spans AS (SELECT * FROM found UNION ALL SELECT * FROM run UNION ALL SELECT * FROM best)",
        """SELECT id, array_to_string(list_slice(t, s + 1, e + 1), ' ') AS answer, s::INTEGER AS start, e::INTEGER AS "end" FROM spans JOIN tok USING (id) JOIN ex USING (id) WHERE e < 1536 AND trim(question) <> '' AND trim(ex.a) <> ''""",
    )
)
def extractive_records_given(spark, sf_dir):
    """extractive_records where most examples come with the characters of their answer."""
    return prepare.extractive_records(_spanned(spark, sf_dir)).select("id", "answer", "start", "end")


@query(_with(EXAMPLES, f"s AS (SELECT id, {_spaced('question')} AS question, left({_spaced('context')}, {CONTEXT_CHARS}) AS context, {_spaced('answer')} AS answer FROM examples)", "SELECT * FROM s WHERE question <> '' AND context <> '' AND answer <> ''"))
def seq2seq_rows(spark, sf_dir):
    return records.seq2seq_rows(examples(spark, sf_dir))


@query(
    _with(
        "a AS (SELECT conv_id AS said_conv, turn AS said_turn, text AS prediction, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations WHERE role = 'user')",
        "b AS (SELECT conv_id AS reply_conv, turn AS reply_turn, text AS reference, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations WHERE role = 'assistant')",
        "SELECT * FROM a JOIN b USING (place)",
    )
)
def positional_zip(spark, sf_dir):
    """Predictions and references paired by their places alone: the n-th user turn with the n-th assistant turn."""
    turns = table(spark, sf_dir, "conversations")
    side = lambda role, conv, turn, name: turns.filter(F.col("role") == role).select(F.col("conv_id").alias(conv), F.col("turn").alias(turn), F.col("text").alias(name))
    said, reply = side("user", "said_conv", "said_turn", "prediction"), side("assistant", "reply_conv", "reply_turn", "reference")
    return records.zipped(said, [F.asc("said_conv"), F.asc("said_turn")], reply, [F.asc("reply_conv"), F.asc("reply_turn")])


# ---- sources and sinks, over files that are written from the given tables


def _folder(spark, name: str) -> str:
    return f"{store.scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _split_file(spark, sf_dir) -> str:
    """The labelled documents as one JSON object of records, in order of ids: keys k<id>, every third with an id of its own, contexts a map or a list."""
    i = F.col("id")
    refs = lambda x: F.struct(F.concat(F.lit("context_"), x.cast("string"), F.lit(".json")).alias("content"), (x % 9).cast("string").alias("điều"))
    common = ["question", "answer", F.when(i % 4 == 0, F.col("context")).alias("passage")]
    listed = F.to_json(F.struct(*common, F.array(refs(i), refs(i + 1)).alias("contexts"), F.when(i % 3 == 0, F.concat(F.lit("own"), i.cast("string"))).alias("id")))
    mapped = F.to_json(F.struct(*common, F.create_map(F.lit("a"), refs(i), F.lit("b"), refs(i + 1)).alias("contexts"), F.when(i % 3 == 0, F.concat(F.lit("own"), i.cast("string"))).alias("id")))
    rows = examples(spark, sf_dir).select("id", F.concat(F.lit('"k'), i.cast("string"), F.lit('": '), F.when(i % 2 == 0, listed).otherwise(mapped)).alias("value"))
    last = rows.agg(F.max("id")).first()[0]
    lines = rows.select("id", F.when(i < last, F.concat("value", F.lit(","))).otherwise(F.concat("value", F.lit("}"))).alias("value"))
    head = spark.createDataFrame([(-1, "{")], "id long, value string")
    path = _folder(spark, "split")
    # one file is what the format is; its rows are sorted by ranges before they are put into it
    lines.unionByName(head).orderBy("id").select("value").coalesce(1).write.text(path)
    return path


@query(
    _with(
        EXAMPLES,
        "SELECT CASE WHEN id % 3 = 0 THEN 'own' || id ELSE 'k' || id END AS id, question, answer, CASE WHEN id % 4 = 0 AND trim(context) <> '' THEN context END AS context, 'context_' || id || '.json' AS first_content, ((id + 1) % 9)::VARCHAR AS second_article, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS pos FROM examples",
    )
)
def split_scan(spark, sf_dir):
    """A split file of all labelled documents, written and read by many tasks."""
    rows = json_io.read_split(spark, _split_file(spark, sf_dir))
    return rows.select("id", "question", "answer", "context", F.col("contexts")[0]["content"].alias("first_content"), F.col("contexts")[1]["article"].alias("second_article"), "pos")


@query(_with(EXAMPLES, "SELECT DISTINCT 'context_' || unnest([id, id + 1]) || '.json' AS content FROM examples"))
def split_references(spark, sf_dir):
    """The context files that the records of a split file refer to, each once."""
    return json_io.context_references(json_io.read_split(spark, _split_file(spark, sf_dir)))


@query(_with(PAIRS, "SELECT id::VARCHAR AS id, reference, prediction, 'm' || id % 3 AS model FROM pairs"))
def predictions_scan(spark, sf_dir):
    """Predictions written as JSON lines, half of them with their reference as answer, and read again."""
    rows, path = pairs(spark, sf_dir), _folder(spark, "predictions")
    own = rows.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, F.col("reference")).alias("reference"), F.when(F.col("id") % 2 > 0, F.col("reference")).alias("answer"), "prediction", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"))
    json_io.write_json_lines(own, path)
    return json_io.read_predictions(spark, path).select("id", "reference", "prediction", "model")


@query(_with(*EVAL, "SELECT query_id, rank::INTEGER AS rank, doc_id, name FROM res JOIN docs USING (doc_id)"))
def ranked_sink(spark, sf_dir):
    """Ranked results written as nested JSON lines and read again."""
    docs, path = corpus(spark, sf_dir), _folder(spark, "ranked")
    evaluate.write_ranked(retrieve.bm25(docs, asked(spark, sf_dir), index=indexed(spark, sf_dir)), docs.select("doc_id", "name"), path)
    rows = spark.read.schema("query_id long, retrieved_contexts array<struct<rank:int,doc_id:long,name:string>>").json(path)
    return rows.select("query_id", F.inline("retrieved_contexts"))


@query(_with(EXAMPLES, f"t AS (SELECT id, {_marks('context')} AS c FROM examples)", "p AS (SELECT id, c, unnest(range(greatest(ceil(len(c) / 128.0)::INTEGER, 1))) AS k FROM t)", "SELECT id, k::INTEGER AS passage, list_slice(c, k * 128 + 1, k * 128 + 128) AS tokens FROM p"))
def passage_split(spark, sf_dir):
    return examples(spark, sf_dir).select("id", F.posexplode(prepare.chunks(text.words_and_marks("context"), 128)).alias("passage", "tokens"))


@query(_with(EXAMPLES, f"t AS (SELECT id, {_marks('context')} AS c FROM examples)", "p AS (SELECT id, c, unnest(range(greatest(ceil((len(c) - 200) / 136.0)::INTEGER, 0) + 1)) * 136 AS s FROM t WHERE len(c) > 0)", "SELECT id, s::INTEGER AS start, list_slice(c, s + 1, s + 200) AS tokens FROM p"))
def sliding_windows(spark, sf_dir):
    df = examples(spark, sf_dir).select("id", F.explode(prepare.windows(text.words_and_marks("context"), 200, 64)).alias("w"))
    return df.select("id", "w.start", "w.tokens")


@query("SELECT vec_id AS id, list_transform(range(40), lambda i: (i >= vec_id % 40 AND i <= vec_id % 40 + label)::INTEGER) AS content, list_transform(range(4), lambda i: (i = least(3, vec_id % 40 // 10))::INTEGER) AS passage FROM embeddings")
def span_labels(spark, sf_dir):
    """Labels of a span of label + 1 tokens of each vector's row."""
    start = (F.col("vec_id") % 40).cast("int")
    content, passage = prepare.span_labels(start, start + F.col("label"), 4, 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), content.alias("content"), passage.alias("passage"))


# a context's sentences with single spaces are looked for where white space is as they have it; others stand behind the one before
@query(
    _with(
        SPANNED.replace("SELECT id, context, CASE", f"SELECT id, trim(regexp_replace(context, {SP}, ' ', 'g')) AS context, CASE"),
        "cut AS (SELECT id, context, s, e, string_split(regexp_replace(context, '([.!?。！？]) ', '\\1' || chr(1) || ' ', 'g'), chr(1)) AS p FROM spanned)",
        "each AS (SELECT id, s, e, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM cut)",
        "placed AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM each)",
        "lab AS (SELECT id, i, before + length(part) - length(trim(part)) AS a, before + length(part) AS b, s, e FROM placed WHERE trim(part) <> '')",
        "SELECT id, list(CASE WHEN s IS NULL THEN NULL ELSE (a < e AND b > s)::INTEGER END ORDER BY i) AS evidence_labels FROM lab GROUP BY id",
    )
)
def sentence_labels(spark, sf_dir):
    """Which sentences of a labelled document a span touches; texts are single-spaced first."""
    df = _spanned(spark, sf_dir).withColumn("context", text.single_spaced("context"))
    return records.sentence_labels(df).filter("size(sentences) > 0").select("id", "evidence_labels")


@query(
    _with(
        SPANNED,
        f"tok AS (SELECT id, context, s, e, list_slice({_marks('context')}, 1, 800) AS t FROM spanned)",
        # the character before each token: what is left of the text is cut behind it
        rf"gap AS (SELECT id, s, e, length(context) AS n, list_slice(regexp_extract_all(lower(context), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85])'), 1, 800) AS g, t FROM tok)",
        "each AS (SELECT id, s, e, n, generate_subscripts(t, 1) AS i, unnest(t) AS tok, unnest(g) AS own FROM gap)",
        "ends AS (SELECT *, sum(length(own)) OVER (PARTITION BY id ORDER BY i) AS b FROM each)",
        "hit AS (SELECT id, min(i) AS a, max(i) AS z FROM ends WHERE s < e AND e <= n AND b > s AND b - length(tok) < e GROUP BY id)",
        "SELECT id, list_transform(range(1, 801), lambda i: coalesce(i = a, false)::INTEGER) AS start_flags, list_transform(range(1, 801), lambda i: coalesce(i = z, false)::INTEGER) AS end_flags FROM spanned LEFT JOIN hit USING (id)",
    )
)
def token_flags(spark, sf_dir):
    """The first and last of a document's 800 leading tokens, the length of an S-NET reader's context, that a span touches."""
    return records.token_flags(_spanned(spark, sf_dir), 800).select("id", "start_flags", "end_flags")


# ---- generation metrics

LCS = [
    PAIRS,
    f"pt AS (SELECT id, {_marks('prediction')} AS p, {_marks('reference')} AS r FROM pairs)",
    # one row of the table of lengths at a time: of each, the running maximum of "diagonal + 1" and the row above
    """lc AS (SELECT id, len(p) AS np, len(r) AS nr, list_extract(list_reduce(p, lambda row, tok: list_reduce(range(1, len(r) + 1), lambda cur, j: list_append(cur, CASE WHEN r[j] = tok THEN row[j] + 1 ELSE greatest(row[j + 1], list_extract(cur, -1)) END), [0::BIGINT]),
list_transform(range(len(r) + 1), lambda i: 0::BIGINT)), -1) AS lcs FROM (SELECT id, p, r FROM pt WHERE len(p) > 0 AND len(r) > 0))""",
]
METEOR = [
    PAIRS,
    f"pt AS (SELECT id, {_marks('prediction')} AS p, {_marks('reference')} AS r FROM pairs)",
    "pp AS (SELECT id, pos, tok, row_number() OVER (PARTITION BY id, tok ORDER BY pos) AS n FROM (SELECT id, generate_subscripts(p, 1) AS pos, unnest(p) AS tok FROM pt))",
    "rc AS (SELECT id, tok, count(*) AS c FROM (SELECT id, unnest(r) AS tok FROM pt) GROUP BY ALL)",
    "mt AS (SELECT id, pos, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS before FROM pp JOIN rc USING (id, tok) WHERE n <= c)",
    "mc AS (SELECT id, count(*)::DOUBLE AS m, sum((before IS NULL OR before <> pos - 1)::INTEGER)::DOUBLE AS ch FROM mt GROUP BY id)",
    "me AS (SELECT id, CASE WHEN m IS NULL THEN 0 ELSE 10 * (m / len(p)) * (m / len(r)) / (m / len(r) + 9 * (m / len(p))) * (1 - 0.5::DOUBLE * pow(ch / m, 3)) END AS meteor FROM pt LEFT JOIN mc USING (id))",
]


@query(_with(*LCS, "SELECT id, coalesce(lcs, 0)::INTEGER AS lcs_len FROM pairs LEFT JOIN lc USING (id)"))
def lcs_len(spark, sf_dir):
    return metrics.with_rouge_l(pairs(spark, sf_dir)).select("id", "lcs_len")


@query(_with(*LCS, "SELECT id, round(CASE WHEN coalesce(lcs, 0) = 0 THEN 0 ELSE 2 * (lcs / np::DOUBLE) * (lcs / nr::DOUBLE) / (lcs / np::DOUBLE + lcs / nr::DOUBLE) END, 6) AS rouge_l FROM pairs LEFT JOIN lc USING (id)"))
def rouge_l(spark, sf_dir):
    return metrics.with_rouge_l(pairs(spark, sf_dir)).select("id", F.round("rouge_l", 6).alias("rouge_l"))


@query(_with(*METEOR, "SELECT id, round(meteor, 6) AS meteor FROM me"))
def meteor(spark, sf_dir):
    return metrics.with_meteor(pairs(spark, sf_dir)).select("id", F.round("meteor", 6).alias("meteor"))


@query(
    _with(
        *LCS,
        *METEOR[2:],
        "rl AS (SELECT id, CASE WHEN coalesce(lcs, 0) = 0 THEN 0 ELSE 2 * (lcs / np::DOUBLE) * (lcs / nr::DOUBLE) / (lcs / np::DOUBLE + lcs / nr::DOUBLE) END AS rouge_l FROM pairs LEFT JOIN lc USING (id))",
        "SELECT round(coalesce(avg(rouge_l), 0), 6) AS rouge_l, round(coalesce(avg(meteor), 0), 6) AS meteor FROM rl JOIN me USING (id)",
    )
)
def textgen_metrics_mean(spark, sf_dir):
    return metrics.metric_means(metrics.with_meteor(metrics.with_rouge_l(pairs(spark, sf_dir))), ["rouge_l", "meteor"])


# ---- decoding

NAMES = ["<pad>", "<unk>", "<bos>", "<eos>", "điều", "luật", "khoản", "mục"]
#: A vector's 64 numbers as logits: of eight steps over eight tokens, or of the starts and ends of 32 places.
STEPS = "lg AS (SELECT vec_id AS id, list_transform(range(8), lambda i: embedding[i * 8 + 1:i * 8 + 8]) AS logits FROM embeddings)"
WINDOWS = "sr AS (SELECT vec_id // 4 AS id, (vec_id % 4)::INTEGER AS win, label % 5 AS off, 20 + label AS n_tokens, embedding[1:32] AS s, embedding[33:64] AS e, list_transform(range(24 + label % 8), lambda i: 't' || i) AS tokens FROM embeddings)"


@query(
    _with(
        STEPS,
        f"tk AS (SELECT id, list_transform(logits, lambda s: list_extract({NAMES}, list_position(s, list_max(s)))) AS t FROM lg)",
        "st AS (SELECT id, t, coalesce(list_position(t, '<eos>'), 0) AS stop FROM tk)",
        "SELECT id, array_to_string(list_filter(CASE WHEN stop > 0 THEN t[1:stop - 1] ELSE t END, lambda x: x NOT IN ('<pad>', '<bos>')), ' ') AS decoded FROM st",
    )
)
def greedy_decode(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in enumerate(NAMES) for x in pair])
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), decode.greedy_decode(logits, names).alias("decoded"))


def _windows(spark, sf_dir):
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("id"),
        (F.col("vec_id") % 4).cast("int").alias("window"),
        (label % 5).alias("offset"),
        (20 + label).alias("n_tokens"),
        F.slice("embedding", 1, 32).cast("array<double>").alias("start_logits"),
        F.slice("embedding", 33, 32).cast("array<double>").alias("end_logits"),
        F.transform(F.sequence(F.lit(0), 23 + label % 8), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"),
    )


@query(_with(WINDOWS, "ab AS (SELECT *, list_position(s, list_max(s)) AS a, list_position(e, list_max(e)) AS b FROM sr)", "SELECT id, win, array_to_string(tokens[a:least(greatest(a, b), len(tokens))], ' ') AS span FROM ab"))
def span_decode(spark, sf_dir):
    return _windows(spark, sf_dir).select("id", F.col("window").alias("win"), decode.span_decode("start_logits", "end_logits", "tokens").alias("span"))


@query(
    _with(
        WINDOWS,
        "st AS (SELECT id, win, off, n_tokens, generate_subscripts(s, 1) - 1 AS i, unnest(s)::DOUBLE AS x FROM sr)",
        "en AS (SELECT id, win, off, generate_subscripts(e, 1) - 1 AS i, unnest(e)::DOUBLE AS y FROM sr)",
        "s20 AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY id, win ORDER BY x DESC, i) <= 20)",
        "e20 AS (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY id, win ORDER BY y DESC, i) <= 20)",
        "pr AS (SELECT id, win, s20.i - s20.off AS a, e20.i - e20.off AS b, n_tokens, x, y FROM s20 JOIN e20 USING (id, win))",
        "ok AS (SELECT *, x + y AS score FROM pr WHERE a >= 0 AND b >= a AND b < n_tokens AND b - a + 1 <= 30)",
        "SELECT id, win, a::INTEGER AS span_start, b::INTEGER AS span_end, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, win, x DESC, a, y DESC, b) AS r FROM ok) WHERE r = 1",
    )
)
def best_span_pairs(spark, sf_dir):
    best = decode.best_span_pairs(_windows(spark, sf_dir).drop("tokens"))
    return best.select("id", F.col("window").alias("win"), F.col("start").cast("int").alias("span_start"), F.col("end").cast("int").alias("span_end"), F.round("score", 6).alias("score"))


BEFORE = "(PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    _with(
        "ep AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS score FROM events)",
        f"bt AS (SELECT *, coalesce(score > max(score) OVER {BEFORE}, true) AS better FROM ep)",
        "ls AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM bt)",
        f"sp AS (SELECT *, coalesce(max((epoch - last >= 3)::INTEGER) OVER {BEFORE}, 0) AS stopped FROM ls)",
        "SELECT run, max(epoch)::INTEGER AS stop_epoch, max(last)::INTEGER AS best_epoch, max(score)::DOUBLE AS best_score FROM sp WHERE stopped = 0 GROUP BY run",
    )
)
def early_stop_epoch(spark, sf_dir):
    """Each user's events as the epochs of a run, their values as its scores."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return decode.early_stopping(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), place.alias("epoch"), F.col("value").alias("score")), 3)


# a text is twelve vectors, eight of a prediction and four of its reference; labels are the tokens
TOKENS = [
    "tok AS (SELECT vec_id // 12 AS id, vec_id % 12 AS p, label, embedding AS v FROM embeddings)",
    "idf AS (SELECT label, ln(((SELECT count(DISTINCT id) FROM tok WHERE p >= 8) + 1) / (count(DISTINCT id) + 1)::DOUBLE) AS w FROM tok WHERE p >= 8 GROUP BY label)",
    "wt AS (SELECT id, p, v, coalesce(w, ln((SELECT count(DISTINCT id) FROM tok WHERE p >= 8) + 1)) AS w FROM tok LEFT JOIN idf USING (label))",
    "cos AS (SELECT a.id, a.p AS i, b.p AS j, a.w AS wa, b.w AS wb, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) / sqrt(list_dot_product(a.v::DOUBLE[], a.v::DOUBLE[]) * list_dot_product(b.v::DOUBLE[], b.v::DOUBLE[])) AS s FROM wt a JOIN wt b ON a.id = b.id AND a.p < 8 AND b.p >= 8)",
    "pre AS (SELECT id, CASE WHEN sum(w) = 0 THEN 0 ELSE sum(s * w) / sum(w) END AS p FROM (SELECT id, i, max(s) AS s, any_value(wa) AS w FROM cos GROUP BY id, i) GROUP BY id)",
    "rec AS (SELECT id, CASE WHEN sum(w) = 0 THEN 0 ELSE sum(s * w) / sum(w) END AS r FROM (SELECT id, j, max(s) AS s, any_value(wb) AS w FROM cos GROUP BY id, j) GROUP BY id)",
    "ids AS (SELECT DISTINCT id FROM tok)",
    "SELECT id, round(coalesce(p, 0), 5) AS precision, round(coalesce(r, 0), 5) AS recall, round(coalesce(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 0), 5) AS f1 FROM ids LEFT JOIN pre USING (id) LEFT JOIN rec USING (id)",
]


@query(_with(*TOKENS))
def bert_score(spark, sf_dir):
    """BERTScore with idf weights, the given vectors standing for a model's token vectors."""
    tokens = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("id"), (F.col("vec_id") % 12).alias("p"), "label", "embedding")
    references = tokens.filter("p >= 8")
    idf = metrics.token_idf(references, "id", "label")
    unknown = F.log(F.lit(references.select("id").distinct().count() + 1.0))  # a token that no reference has
    weighted = tokens.join(idf, "label", "left").withColumn("w", F.coalesce("idf", unknown))
    side = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("p", "embedding", "w"))))
    both = weighted.groupBy("id").agg(side(F.col("p") < 8).alias("a"), side(F.col("p") >= 8).alias("b"))
    scored = both.select("id", metrics.vector_match(F.col("a.embedding"), F.col("b.embedding"), F.col("a.w"), F.col("b.w")).alias("m"))
    return scored.select("id", *[F.round(f"m.{c}", 5).alias(c) for c in ("precision", "recall", "f1")])
