"""Queries on the catalogue and the state of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog, ingest
from ..runtime import read
from .prepared import prepared

#: Named scopes of the queries; one root is the beginning of another's name, and one stays on its devices.
SCOPES = [
    {"name": "usb", "root": "/mnt/usb", "priority": 30},
    {"name": "src1", "root": "/corpus/src1", "priority": 10},
    {"name": "src10", "root": "/corpus/src10", "priority": 20, "one_filesystem": True, "devices": [1, 2]},
    {"name": "corpus", "root": "/corpus", "priority": 50},
]
AFTER, BEFORE = "2015-01-01", "2018-12-31"

#: The current catalogue and the passages in SQL; every other SQL text begins with them.
COMMON = """with catalog as (select * exclude (nth) from (select *, row_number() over (partition by path order by indexed_at desc nulls last, file_id) as nth from files where path is not null) where nth = 1),
passages as (select * exclude (nth) from (select *, row_number() over (partition by chunk_id order by ordinal) as nth from chunks where chunk_id is not null) where nth = 1)
"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAME = "split_part(lower({p}), '/', -1)"
EXT_SQL = "lower(regexp_extract(split_part({p}, '/', -1), '[^.](\\.[^.]+)$', 1))"
JUNK_SQL = f"""(list_has_any(list_slice(string_split(lower({{p}}), '/'), 1, len(string_split({{p}}, '/')) - 1), {_list(paths.JUNK_FOLDERS)})
 or list_contains({_list(paths.JUNK_NAMES)}, {_NAME}) or {" or ".join(f"ends_with({_NAME}, '{s}')" for s in paths.JUNK_SUFFIXES)})"""
_KIND_SQL = f"case when list_contains({_list(paths.IMAGE_EXTENSIONS)}, {EXT_SQL}) then 'image' when list_contains({_list([*paths.TEXT_EXTENSIONS, *paths.DOCUMENT_EXTENSIONS])}, {EXT_SQL}) then 'text' else 'file' end"
_MIME_SQL = "case " + EXT_SQL + " " + " ".join(f"when '{k}' then '{v}'" for k, v in paths.MIME_TYPES.items()) + " end"
RELATIVE_SQL = "case when starts_with(path, rtrim(root, '/') || '/') then substr(path, length(rtrim(root, '/')) + 2) else path end"


def scope_sql(s: dict, path: str = "path", device: str = "source_device") -> str:
    inside = f"({path} = '{s['root']}' or starts_with({path}, '{s['root']}/'))"
    return f"({inside} and coalesce({device} in ({', '.join(map(str, s['devices']))}), false))" if s.get("one_filesystem") else inside


_NAMED = {s["name"]: s for s in SCOPES}


def current_files(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d).files


def current_passages(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d).passages


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    return current_files(spark, d).select("file_id", "path", "root", "kind", "mime", "size", "mtime", "content_sig", "indexed_at", "extractor", "content_hash", "source_device")


def keyset_scan(spark: SparkSession, d: str) -> DataFrame:
    """A range of ids, as a resumed scan reads it."""
    return current_passages(spark, d).where("chunk_id >= 500").select("chunk_id", "file_id", "ordinal").orderBy("chunk_id").limit(1000)


def browse_page(spark: SparkSession, d: str) -> DataFrame:
    page = catalog.browse(catalog.scoped(current_files(spark, d), [_NAMED["corpus"]]), after="/corpus/src1/", contains="_", limit=100)
    return page.select("path", "kind", "size", "mtime")


def classify_kind(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return current_files(spark, d).select("file_id", paths.kind_of(p).alias("kind_by_name"), paths.mime_of(p).alias("mime_by_name"), paths.extension(p).alias("extension"))


def filter_kind_date(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(current_files(spark, d), kind="text", after=catalog.epoch(AFTER), before=catalog.epoch(BEFORE, end=True)).select("file_id", "path", "mtime")


def filter_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(current_files(spark, d), prefix="50%_Off").select("file_id", "path")


def filter_path_prefix_absolute(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered(current_files(spark, d), prefix="/CORPUS/src1").select("file_id", "path")


def scope_union(spark: SparkSession, d: str) -> DataFrame:
    return catalog.scoped(current_files(spark, d), [_NAMED["src1"], _NAMED["usb"]]).select("file_id", "path")


def scope_device(spark: SparkSession, d: str) -> DataFrame:
    return catalog.scoped(current_files(spark, d), [_NAMED["src10"]]).select("file_id", "path", "source_device")


def scope_membership(spark: SparkSession, d: str) -> DataFrame:
    f = current_files(spark, d)
    names = paths.scope_names(F.col("path"), F.col("source_device"), SCOPES)
    return f.select("path", F.array_join(names, ",").alias("scopes"), paths.scope_priority(F.col("path"), F.col("source_device"), SCOPES).alias("priority"))


def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    return current_files(spark, d).where(paths.is_junk(F.col("path"))).select("file_id", "path")


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    return current_files(spark, d).where("root is not null").select("file_id", paths.relative(F.col("path"), F.col("root")).alias("relative_path"))


def filename_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filename_hits(current_files(spark, d), read(spark, d, "queries_text").dropDuplicates(["qid"]), limit=180)


def filename_search_all(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, "src1 Plan .PY"), (2, "résumé"), (3, "- .")], "qid long, text string")
    return catalog.filename_hits(current_files(spark, d), q, limit=180, require_all=True)


def census_by_tree(spark: SparkSession, d: str) -> DataFrame:
    return catalog.census(current_files(spark, d), F.split("path", "/")[1], "tree")


def census_by_ext(spark: SparkSession, d: str) -> DataFrame:
    return catalog.census(current_files(spark, d), paths.extension(F.col("path")), "extension", 16)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    f, c = current_files(spark, d), current_passages(spark, d)
    files = f.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(paths.is_junk(F.col("path"))).alias("junk"), F.sum("size").alias("bytes"))
    chunks = c.agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("high_water"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    content = f.select("file_id").join(c.select("file_id").distinct(), "file_id").agg(F.countDistinct("file_id").alias("content_files"))
    parts = [x.select(F.expr("stack({}, {}) as (measure, value)".format(len(x.columns), ", ".join(f"'{n}', cast({n} as bigint)" for n in x.columns)))) for x in (files, chunks, content)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def index_health(spark: SparkSession, d: str) -> DataFrame:
    return catalog.health_flags(read(spark, d, "index_state"))


def state_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Types of the values under each key: the column holds integers, decimals, ids and nulls."""
    v = F.col("value")
    s = read(spark, d, "index_state").distinct()
    return s.groupBy("key").agg(F.count("*").alias("indexes"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v.rlike(r"^-?[0-9]+$")).alias("integers"), F.count_if(v.rlike(r"^-?[0-9]+\.[0-9]+$")).alias("decimals"), F.count_if(v.rlike("^[0-9a-f]{32}$")).alias("hex_ids"))


def truncated_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose first passage is missing, so that their signature has to be cleared."""
    late = current_passages(spark, d).where("file_id is not null").groupBy("file_id").agg(F.min("ordinal").alias("first_ordinal")).where("first_ordinal > 0")
    return current_files(spark, d).join(late, "file_id").select("file_id", "path", "first_ordinal")


def repair_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after their signatures have been cleared, by which the next update reads these files again."""
    return ingest.repaired(current_files(spark, d), current_passages(spark, d)).select("file_id", "path", "content_sig")


def inventory_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = current_files(spark, d).select("path"), catalog.current(read(spark, d, "replica_files")).select("path")
    both = a.withColumn("p", F.lit(1)).unionByName(b.withColumn("s", F.lit(1)), allowMissingColumns=True).groupBy("path").agg(F.max("p").alias("p"), F.max("s").alias("s"))
    count = lambda c, n: F.count_if(c).alias(n)
    p, s = F.col("p").isNotNull(), F.col("s").isNotNull()
    return both.agg(count(p, "primary_files"), count(s, "secondary_files"), count(p & s, "shared_paths"), count(p & ~s, "primary_only_paths"), count(s & ~p, "secondary_only_paths")).withColumn("inventories_equal", F.expr("primary_only_paths = 0 and secondary_only_paths = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_scan, keyset_scan, browse_page, classify_kind, filter_kind_date, filter_path_prefix, filter_path_prefix_absolute, scope_union, scope_device, scope_membership, junk_filter,
        relative_paths, filename_search, filename_search_all, census_by_tree, census_by_ext, status_counts, index_health, state_by_key, truncated_files, repair_truncated, inventory_compare,
    )
}

_UNDER = "(starts_with(lower(path), '/{0}/') or starts_with(lower(path), '{0}/') or starts_with(lower(" + RELATIVE_SQL + "), '{0}/'))"


def _names(queries: str, test: str) -> str:
    return COMMON + f""", q as ({queries}),
    t as (select qid, list_slice(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_.-]+')), 1, 32) as terms from q),
    h as (select qid, path, kind, mtime, mime, row_number() over (partition by qid order by path) as nth
        from catalog, t where len(terms) > 0 and {test})
    select qid, path, kind, mtime, mime, 1.0 as score from h where nth <= 180 and not {JUNK_SQL.format(p="path")}"""


_ANY = "len(list_filter(terms, lambda x: contains(lower(path), x))) > 0"
_ALL = "len(list_filter(terms, lambda x: contains(lower(path), x))) = len(terms)"
_STATE = "max(case when key = '{0}' then try_cast(value as double) end) as {0}"
_KEYS = ["chunk_high_water", "last_build_started", "last_build_finished", "last_build_errors", "last_build_walk_errors", "last_build_changed", "last_build_unchanged"]

SQL = {
    "catalog_scan": COMMON + "select * from catalog",
    "keyset_scan": COMMON + "select chunk_id, file_id, ordinal from passages where chunk_id >= 500 order by chunk_id limit 1000",
    "browse_page": COMMON + f"select path, kind, size, mtime from catalog where {scope_sql(_NAMED['corpus'])} and path > '/corpus/src1/' and contains(lower(path), '_') order by path limit 100",
    "classify_kind": COMMON + f"select file_id, {_KIND_SQL.format(p='path')} as kind_by_name, {_MIME_SQL.format(p='path')} as mime_by_name, {EXT_SQL.format(p='path')} as extension from catalog",
    "filter_kind_date": COMMON + "select file_id, path, mtime from catalog where kind = 'text' and mtime >= epoch(timestamp '2015-01-01') and mtime <= epoch(timestamp '2018-12-31') + 86399",
    "filter_path_prefix": COMMON + f"select file_id, path from catalog where {_UNDER.format('50%_off')}",
    "filter_path_prefix_absolute": COMMON + f"select file_id, path from catalog where {_UNDER.format('corpus/src1')}",
    "scope_union": COMMON + f"select file_id, path from catalog where {scope_sql(_NAMED['src1'])} or {scope_sql(_NAMED['usb'])}",
    "scope_device": COMMON + f"select file_id, path, source_device from catalog where {scope_sql(_NAMED['src10'])}",
    "scope_membership": COMMON + "select path, array_to_string(list_filter([" + ", ".join(f"case when {scope_sql(s)} then '{s['name']}' end" for s in SCOPES) + "], lambda x: x is not null), ',') as scopes, coalesce(least(" + ", ".join(f"case when {scope_sql(s)} then {s['priority']} end" for s in SCOPES) + "), 100) as priority from catalog",
    "junk_filter": COMMON + f"select file_id, path from catalog where {JUNK_SQL.format(p='path')}",
    "relative_paths": COMMON + f"select file_id, {RELATIVE_SQL} as relative_path from catalog where root is not null",
    "filename_search": _names("select distinct qid, text from queries_text where text is not null", _ANY),
    "filename_search_all": _names("select * from (values (1, 'src1 Plan .PY'), (2, 'résumé'), (3, '- .')) v(qid, text)", _ALL),
    "census_by_tree": COMMON + "select split_part(path, '/', 2) as tree, count(*) as files, sum(size) as bytes from catalog group by 1",
    "census_by_ext": COMMON + f"select {EXT_SQL.format(p='path')} as extension, count(*) as files, sum(size) as bytes from catalog group by 1 order by files desc, extension limit 16",
    "status_counts": COMMON + f"""select 'files' as measure, count(*) as value from catalog union all select 'images', count(*) from catalog where kind = 'image'
        union all select 'junk', count(*) from catalog where {JUNK_SQL.format(p="path")} union all select 'bytes', sum(size) from catalog
        union all select 'chunks', count(*) from passages union all select 'high_water', max(chunk_id) from passages
        union all select 'embedded', count(*) from passages where embedding is not null
        union all select 'content_files', count(distinct c.file_id) from catalog c join passages p on c.file_id = p.file_id""",
    "index_health": f"""with w as (select index_name, {", ".join(map(_STATE.format, _KEYS))} from index_state where index_name is not null group by index_name)
        select *, coalesce(last_build_started > coalesce(last_build_finished, 0), false) as update_incomplete,
        last_build_finished is not null and coalesce(last_build_errors, 0) + coalesce(last_build_walk_errors, 0) = 0 as coverage_complete from w""",
    "state_by_key": r"""select key, count(*) as indexes, count(*) filter (value is null) as nulls, count(*) filter (regexp_full_match(value, '-?[0-9]+')) as integers,
        count(*) filter (regexp_full_match(value, '-?[0-9]+\.[0-9]+')) as decimals, count(*) filter (regexp_full_match(value, '[0-9a-f]{32}')) as hex_ids from (select distinct * from index_state) group by key""",
    "repair_truncated": COMMON + "select file_id, path, case when (select min(ordinal) from passages p where p.file_id = catalog.file_id) > 0 then null else content_sig end as content_sig from catalog",
    "truncated_files": COMMON + "select c.file_id, c.path, p.first_ordinal from catalog c join (select file_id, min(ordinal) as first_ordinal from passages group by file_id having min(ordinal) > 0) p on c.file_id = p.file_id",
    "inventory_compare": COMMON + """, r as (select distinct path from replica_files where path is not null)
        select (select count(*) from catalog) as primary_files, (select count(*) from r) as secondary_files, (select count(*) from catalog join r using (path)) as shared_paths,
        (select count(*) from catalog where path not in (select path from r)) as primary_only_paths, (select count(*) from r where path not in (select path from catalog)) as secondary_only_paths,
        (select count(*) from catalog where path not in (select path from r)) + (select count(*) from r where path not in (select path from catalog)) = 0 as inventories_equal""",
}
