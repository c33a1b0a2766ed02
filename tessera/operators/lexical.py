"""Keyword retrieval: stored postings, corpus statistics, BM25 with phrases, and the best passage of each file.

The inverted index is a table in order of its terms, so that a search reads the
row groups of its terms and no text; what is tokenised is what is new.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import query_terms, tokens

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: Tokens of queries that are listed in the filter of the postings; more of them are joined.
MOST_TOKENS = 10_000


def tokenized(passages: DataFrame, *carry: str) -> DataFrame:
    """``chunk_id, tokens, dl`` (and other columns) of every passage with a text."""
    return passages.where(F.col("text").isNotNull()).select("chunk_id", *carry, tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(passages: DataFrame, *carry: str) -> DataFrame:
    """``term, chunk_id, dl, tf, positions`` (and other columns of the passage): the inverted index; ``dl`` is the passage's length in tokens."""
    return postings_of(tokenized(passages, *carry), *carry)


def postings_of(tokenized: DataFrame, *carry: str) -> DataFrame:
    at = tokenized.select("chunk_id", *carry, "dl", F.posexplode("tokens").alias("pos", "term"))
    return at.groupBy("term", "chunk_id", *carry, "dl").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def by_term(postings: DataFrame) -> DataFrame:
    """The postings in the order in which they are stored; a term with very many passages is spread over several files."""
    return postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def lengths(passages: DataFrame, *carry: str) -> DataFrame:
    """``chunk_id, dl`` (and other columns) of every passage with a text, also of those without any token."""
    return tokenized(passages, *carry).select("chunk_id", *carry, "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of passages, their mean length in tokens, and the number of tokens."""
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("tokens"))


def phrases(queries: DataFrame) -> DataFrame:
    """``qid, term, k, token, size``: the index tokens of every term of every query.

    A term that tokenising cuts into several tokens is a phrase; one without
    any token is left out here, and counted in ``wanted`` for queries that
    require all terms.
    """
    terms = queries.where("text is not null and qid is not null").select("qid", F.explode(query_terms(F.col("text"))).alias("term"))
    parts = terms.withColumn("parts", tokens(F.col("term"))).withColumn("size", F.size("parts"))
    return parts.select("qid", "term", "size", F.posexplode_outer("parts").alias("k", "token"))


def _listed(phrase_tokens: DataFrame) -> list | None:
    """The tokens of a stated set of queries on the driver; None if there are more than MOST_TOKENS."""
    rows = phrase_tokens.limit(MOST_TOKENS + 1).collect()
    return rows if len(rows) <= MOST_TOKENS else None


def term_frequencies(index: DataFrame, phrase_tokens: DataFrame, listed: list | None = None) -> DataFrame:
    """``term, chunk_id, dl, tf``: occurrences of every term as a phrase, from the postings of its tokens.

    The postings of a single token tell it at once.  Of a longer phrase, the
    token at position p that is the k-th of it votes for a start at p - k; a
    start with as many votes as the phrase has tokens is an occurrence.  Where
    the tokens are ``listed``, only their postings are read.
    """
    if listed is None:
        wanted = phrase_tokens.where("token is not null").select("term", "k", "token", "size").distinct()
    else:
        some = sorted({(r.term, r.k, r.token, r["size"]) for r in listed if r.token is not None})
        wanted = F.broadcast(index.sparkSession.createDataFrame(some, "term string, k int, token string, size int"))
        index = index.where(F.col("term").isin(sorted({token for _, _, token, _ in some})))
    met = index.withColumnRenamed("term", "token").join(wanted, "token")
    out = met.where("size = 1").select("term", "chunk_id", "dl", F.col("tf").cast("long").alias("tf"))
    if listed is not None and all(size == 1 for *_, size in some):
        return out
    at = met.where("size > 1").select("term", "size", "chunk_id", "dl", "k", F.explode("positions").alias("pos"))
    votes = at.groupBy("term", "size", "chunk_id", "dl", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("votes"))
    return out.unionByName(votes.where("votes = size").groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")))


def bm25(index: DataFrame, stats, queries: DataFrame, *, require_all: bool = False, digits: int = 10) -> DataFrame:
    """``qid, chunk_id, score``: BM25 of every passage that holds any (or all) of a query's terms.

    ``index`` has the postings and ``stats`` (n, avgdl) the figures of the
    whole corpus, whatever is filtered later; the idf has a floor; scores are
    rounded so that ties don't hang on the order of additions.  A query without
    a term finds nothing; a term of separators only is ignored, or prevents any
    result if all terms are required.
    """
    wanted = phrases(queries)
    listed = _listed(wanted)
    tf = term_frequencies(index, wanted, listed)
    n, avgdl = F.lit(stats.n), F.lit(stats.avgdl or 1.0)
    idf = F.greatest(F.log((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), F.lit(IDF_FLOOR))
    frequency = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + B * F.col("dl") / avgdl))
    if listed is None:
        asked = wanted.groupBy("qid", "term").agg(F.max("size").alias("size"))
        terms = asked.groupBy("qid").agg(F.count("*").alias("terms"))
        met = asked.where("size > 0").join(frequency, "term").join(tf, "term")
    else:
        pairs = sorted({(r.qid, r.term, r["size"]) for r in listed})
        terms = F.broadcast(index.sparkSession.createDataFrame(sorted(Counter(q for q, _, _ in pairs).items()), "qid long, terms long"))
        asked = index.sparkSession.createDataFrame([(q, t) for q, t, size in pairs if size > 0], "qid long, term string")
        # No more rows than the listed tokens, with the idf of their terms.
        known = index.sparkSession.createDataFrame(frequency.collect(), frequency.schema)
        met = tf.join(F.broadcast(asked.join(F.broadcast(known), "term")), "term")
    scored = met.groupBy("qid", "chunk_id").agg(F.round(F.sum(F.col("idf") * weight), digits).alias("score"), F.count("*").alias("matched"))
    if require_all:
        scored = scored.join(terms, "qid").where("matched = terms")
    return scored.select("qid", "chunk_id", "score")


def bm25_texts(passages: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The same of passages that have no stored postings."""
    return bm25(postings(passages), corpus_stats(lengths(passages)).first(), queries, **options)


def best_of_files(hits: DataFrame, passages: DataFrame, files: DataFrame, pool: int, *, group: str = "qid") -> DataFrame:
    """``<group>, chunk_id, path, kind, mtime, mime, score, rk``: of each file the best passage, and of those the best ``pool``.

    Of equal passages of a file the smaller chunk_id counts; files are ordered
    by score, then path; junk is left out.
    """
    owner = passages.select("chunk_id", "file_id").where("file_id is not null")
    kept = files.where(~paths.is_junk(F.col("path"))).select("file_id", "path", "kind", "mtime", "mime")
    # A path has one file_id, so the best passage of the file_id is that of the path; numbers sort faster than paths.
    best = Window.partitionBy(group, "file_id").orderBy(F.desc("score"), "chunk_id")
    order = Window.partitionBy(group).orderBy(F.desc("score"), "path")
    rows = hits.select(group, "chunk_id", "score").join(owner, "chunk_id").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    rows = rows.join(kept, "file_id").withColumn("rk", F.row_number().over(order))
    return rows.where(F.col("rk") <= pool).select(group, "chunk_id", "path", "kind", "mtime", "mime", "score", "rk")
