"""Queries on the differences between the catalogue and its replica."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.differences import canonical_number, differences
from ..runtime import read

FILE_FIELDS = ["root", "kind", "mime", "size", "mtime", "content_sig", "extractor", "content_hash", "source_device"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences of catalogue and state from their replicas."""
    labels = ("only_primary", "only_replica")
    files = differences(read(spark, d, "files"), read(spark, d, "replica_files"), F.col("path"), {c: F.col(c) for c in FILE_FIELDS}, version=F.col("indexed_at"), labels=labels)
    key = F.concat("index_name", F.lit("/"), "key")
    state = differences(read(spark, d, "index_state"), read(spark, d, "replica_index_state"), key, {"value": canonical_number(F.col("value"))}, labels=labels)
    tag = lambda df, name: df.select(F.lit(name).alias("copy_of"), "row_key", "field")
    return tag(files, "files").unionByName(tag(state, "index_state"))


_LATEST = """
    select * from (select *, row_number() over (partition by path order by indexed_at desc nulls last, root desc nulls last, kind desc nulls last,
        mime desc nulls last, size desc nulls last, mtime desc nulls last, content_sig desc nulls last, extractor desc nulls last) as nth
    from {0} where path is not null) where nth = 1"""

P2_SQL = f"""
with a as ({_LATEST.format("files")}), b as ({_LATEST.format("replica_files")}),
    s as (select distinct index_name || '/' || key as row_key, value from index_state where index_name is not null and key is not null),
    r as (select distinct index_name || '/' || key as row_key, value from replica_index_state where index_name is not null and key is not null)
select 'files' as copy_of, path as row_key, 'only_primary' as field from a where path not in (select path from b)
union all select 'files', path, 'only_replica' from b where path not in (select path from a)
""" + "".join(f"union all select 'files', a.path, '{c}' from a join b on a.path = b.path where a.{c} is distinct from b.{c}\n" for c in FILE_FIELDS) + r"""
union all select 'index_state', row_key, 'only_primary' from s where row_key not in (select row_key from r)
union all select 'index_state', row_key, 'only_replica' from r where row_key not in (select row_key from s)
union all select 'index_state', s.row_key, 'value' from s join r on s.row_key = r.row_key
where case when regexp_full_match(s.value, '-?[0-9]+(\.[0-9]+)?') and regexp_full_match(r.value, '-?[0-9]+(\.[0-9]+)?')
    then cast(s.value as decimal(38, 10)) <> cast(r.value as decimal(38, 10)) else s.value is distinct from r.value end
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
