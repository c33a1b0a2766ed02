"""The registered queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read
from .leaks import Rule, leaks
from .near_duplicates import similar_groups, similar_pairs
from .nearest import nearest
from .packing import training_windows
from .quality import learnt_rules, statistics
from .quality_sql import STATISTICS
from .splitting import pieces
from .top_n import top_n

#: Units and thresholds of near-duplicate passages and paths in this project's data.
CHUNKS = {"threshold": 0.6, "unit": "word", "size": 3, "bands": 24, "rows": 3}
PATHS = {"threshold": 0.7, "unit": "char", "size": 4, "bands": 72, "rows": 7}
#: Passages that are near to 12 words, or to the whole of a shorter passage.
NEAR = Rule(window=12, stride=1, run=0, edits=1, sampled=9, recall=0.99, least=6)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate passages and of near-duplicate paths."""
    chunks = similar_pairs(read(spark, d, "chunks"), "chunk_id", "text", **CHUNKS)
    files = similar_pairs(read(spark, d, "files"), "file_id", "path", **PATHS)
    tag = lambda df, record: df.select(F.lit(record).alias("record"), "id_a", "id_b")
    return tag(chunks, "chunk").unionByName(tag(files, "file"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The class of near-duplicate passages of every passage, without spelling the pairs of copies out."""
    return similar_groups(read(spark, d, "chunks"), "chunk_id", "text", **CHUNKS).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every passage over 1,200 characters."""
    return pieces(read(spark, d, "chunks"), "chunk_id", "text").select(F.col("id").alias("chunk_id"), "piece", "start_char", "end_char")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The same passages cut at the strongest boundaries, with text, overlap and where they come from."""
    chunks = read(spark, d, "chunks")
    cut = pieces(chunks, "chunk_id", "text", order="kind", with_text=True)
    origin = chunks.where(F.length("text") > 1200).select("chunk_id", "file_id", "ordinal").dropDuplicates(["chunk_id"])
    sizes = read(spark, d, "files").where("file_id is not null").groupBy("file_id").agg(F.max_by("size", "indexed_at").alias("file_size"))
    return cut.withColumnRenamed("id", "chunk_id").join(origin, "chunk_id").join(sizes, "file_id", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Of every query and file the three best passages."""
    hits = read(spark, d, "chunks_fts").where("rank is not null and qid is not null").groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank"))
    owner = read(spark, d, "chunks").where("file_id is not null").select("chunk_id", "file_id").distinct()
    rows = hits.join(owner, "chunk_id").select(F.col("qid").alias("g1"), F.col("file_id").alias("g2"), F.col("rank").alias("score"), F.col("chunk_id").alias("item"))
    return top_n(rows, 3).select(F.col("g1").alias("qid"), F.col("g2").alias("file_id"), F.col("item").alias("chunk_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages with cosine 0.9 or more of which one is among the five most similar of the other."""
    near = nearest(read(spark, d, "chunks"), "chunk_id", "embedding", k=5, least=0.9, recall=0.999)
    return near.select(F.least("id", "near").alias("chunk_id_a"), F.greatest("id", "near").alias("chunk_id_b")).distinct()


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar passages of every passage whose id is divisible by 50, however similar they are."""
    near = nearest(read(spark, d, "chunks"), "chunk_id", "embedding", k=5, recall=0.93, every=50)
    return near.select(F.col("id").alias("chunk_id"), "place", F.col("near").alias("near_chunk_id"), "cosine")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """The training window of 2,048 tokens, of which 2,016 may bear loss, of every text or piece."""
    return training_windows(read(spark, d, "documents"), "doc_id", "text", loss_tokens=2016).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a question or target."""
    found = leaks(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "relevance_cases"), "case_id", ["question", "target"])
    return found.select("doc_id", "case_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 words of a question or target (all of it, if it has 6 to 11) up to one inserted, missing or other word."""
    return leaks(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "relevance_cases"), "case_id", ["question", "target"], NEAR).select("doc_id", "case_id", "edits")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document, with the common words of four languages and those that the corpus tells of others."""
    docs = read(spark, d, "documents")
    return statistics(docs, "doc_id", "text", learnt_rules(docs, "text", "lang")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that for the larger part aren't prose."""
    return p8_statistics(spark, d).where("not is_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_pieces, p4_found, p5_found, p5_nearest, p6_windows, p7_found, p7_near, p8_found, p8_statistics)}

_PLAIN = r"""list_filter(string_split_regex(strip_accents(lower(regexp_replace(regexp_replace({0}, '[\x{{AD}}\x{{34F}}\x{{61C}}\x{{180E}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'),
    '[-\x{{2010}}\x{{2011}}][^\S\n\r\x{{2028}}\x{{2029}}]*[\n\r\x{{2028}}\x{{2029}}]\s*', '', 'g'))), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 0)"""


def _similar(name: str, units: str, threshold: float) -> str:
    """Pairs by counting shared units."""
    return f"""{name}_u as (select distinct id, unit from ({units})), {name}_n as (select id, count(*) as n from {name}_u group by id),
        {name}_b as (select a.id as id_a, b.id as id_b, count(*) as c from {name}_u a join {name}_u b on a.unit = b.unit and a.id < b.id group by a.id, b.id),
        {name}_p as (select id_a, id_b from {name}_b join {name}_n x on x.id = id_a join {name}_n y on y.id = id_b where c / (x.n + y.n - c) >= {threshold}e0)"""


_CHUNK_UNITS = """select id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as unit from (select id, w, unnest(range(1, len(w) - 1)) as i from
    (select distinct chunk_id as id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) as w from chunks where chunk_id is not null and text is not null))"""
_FILE_UNITS = "select id, substr(p, i, 4) as unit from (select id, p, unnest(range(1, length(p) - 2)) as i from (select distinct file_id as id, lower(path) as p from files where file_id is not null and path is not null))"

#: All pairs, exactly; the operator may miss a few where it has more than one leaf.
_NEAR = """with u as (select chunk_id as id, any_value(cast(embedding as double[])) as v from chunks where chunk_id is not null and len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by chunk_id),
    n as (select id, list_transform(v, lambda x: x / l) as v from (select id, v, sqrt(list_inner_product(v, v)) as l from u)),
    c as (select a.id as a, b.id as b, round(list_inner_product(a.v, b.v), 6) as cosine from n a join n b on a.id <> b.id),
    r as (select a, b, cosine, row_number() over (partition by a order by cosine desc, b) as place from c)"""

SQL = {
    "p8_statistics": STATISTICS + " select * from st",
    "p8_found": STATISTICS + " select doc_id from st where not is_prose",
    "p1_found": "with " + _similar("chunk", _CHUNK_UNITS, 0.6) + ", " + _similar("file", _FILE_UNITS, 0.7) + " select 'chunk' as record, id_a, id_b from chunk_p union all select 'file', id_a, id_b from file_p",
    "p1_groups": "with recursive " + _similar("chunk", _CHUNK_UNITS, 0.6) + """, sets as (select id, list_sort(list(unit)) as fp from chunk_u group by id), c as (select fp, min(id) as rep, count(*) as copies from sets group by fp),
        l as (select id_a, id_b from chunk_p where id_a in (select rep from c) and id_b in (select rep from c)), e as (select id_a as a, id_b as b from l union all select id_b, id_a from l),
        reach(a, b) as (select rep, rep from c union select r.a, e.b from reach r join e on r.b = e.a), label as (select a as rep, min(b) as class_id from reach group by a)
        select id as chunk_id, class_id, copies, (select count(*) from e where e.a = c.rep) as links from sets join c using (fp) join label using (rep)""",
    "p7_found": f"""with d as (select distinct doc_id, {_PLAIN.format("text")} as w from documents where text is not null and doc_id is not null),
        c as (select distinct case_id, {_PLAIN.format("text")} as w from (select case_id, question as text from relevance_cases union all select case_id, target from relevance_cases) where text is not null and case_id is not null),
        dw as (select doc_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
        cw as (select distinct case_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select case_id, w, unnest(range(1, len(w) - 10)) as i from c))
        select distinct doc_id, case_id from dw join cw using (g)""",
    "p7_near": f"""with d as (select distinct doc_id, {_PLAIN.format("text")} as w from documents where text is not null and doc_id is not null),
        c as (select distinct case_id, {_PLAIN.format("text")} as w from (select case_id, question as text from relevance_cases union all select case_id, target from relevance_cases) where text is not null and case_id is not null),
        cw as (select distinct case_id, n, list_slice(w, i, i + n - 1) as g from (select case_id, w, least(12, len(w)) as n, unnest(range(1, greatest(1, len(w) - 10))) as i from c where len(w) >= 6)),
        dw as (select doc_id, n, e, list_slice(w, i, i + n + e - 1) as g from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), (select distinct n from cw), (values (-1), (0), (1)) v(e) where i + n + e - 1 <= len(w)),
        less as (select *, unnest(range(1, n + e + 1)) as j from dw),
        ck as (select case_id, n, 0 as e, 0 as j, 0 as edits, hash(g) as k from cw union all select case_id, n, 1, 0, 1, hash(g) from cw
            union all select case_id, n, e, case when e = 0 then j else 0 end, 1, hash(list_concat(list_slice(g, 1, j - 1), list_slice(g, j + 1, n))) from (select *, unnest(range(1, n + 1)) as j from cw), (values (0), (-1)) v(e)),
        dk as (select doc_id, n, e, 0 as j, hash(g) as k from dw where e <= 0 union all select doc_id, n, e, case when e = 0 then j else 0 end, hash(list_concat(list_slice(g, 1, j - 1), list_slice(g, j + 1, n + e))) from less where e >= 0)
        select doc_id, case_id, min(edits) as edits from dk join ck using (n, e, j, k) group by doc_id, case_id""",
    "p5_found": _NEAR + " select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from r where place <= 5 and cosine >= 0.9",
    "p5_nearest": _NEAR + " select a as chunk_id, place, b as near_chunk_id, cosine from r where place <= 5 and a % 50 = 0",
    "p3_found": r"""
        with recursive long_ones as (select distinct chunk_id, text, length(text) as n from chunks where length(text) > 1200 and chunk_id is not null),
        step(chunk_id, text, n, piece, start_char, end_char) as (
            select chunk_id, text, n, cast(-1 as bigint), cast(0 as bigint), cast(180 as bigint) from long_ones
            union all
            select chunk_id, text, n, piece + 1, end_char - 180, case when n <= end_char - 180 + 1200 then n else (
                select case when max(b) > 600 then end_char - 180 + max(b) + 1 else end_char - 180 + 1200 end from (
                    select 1200 - strpos(reverse(substr(text, end_char - 180 + 1, 1200)), reverse(sep)) + 1 - 2 as b, sep
                    from (values (chr(10) || chr(10)), ('. ')) v(sep)
                    where strpos(reverse(substr(text, end_char - 180 + 1, 1200)), reverse(sep)) > 0)) end
            from step where end_char < n)
        select chunk_id, piece, start_char, end_char from step where piece >= 0
    """,
    "p4_found": """
        with h as (select qid, chunk_id, min(rank) as rank from chunks_fts where rank is not null and qid is not null group by qid, chunk_id),
        o as (select distinct chunk_id, file_id from chunks where file_id is not null)
        select qid, file_id, chunk_id from (select qid, file_id, chunk_id, row_number() over (partition by qid, file_id order by rank, chunk_id) as nth from h join o using (chunk_id))
        where nth <= 3
    """,
}
