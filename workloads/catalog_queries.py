"""Queries over a fleet's catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.annotations import parse_annotations
from driftline.operators import catalog as cat
from driftline.operators.schema import map_types
from driftline.sources import admin_text as adm
from workloads import relations as rel
from workloads.registry import register
from workloads.relations import relation, text

# The annotation by JSON type, independent of how the operator finds it.
ANNOTATED = f"""
select c.*, annotated,
       case when annotated then coalesce(
         case json_type(e) when 'BOOLEAN' then cast(e as varchar) = 'true' when 'VARCHAR' then (e->>'$') <> ''
           when 'NULL' then false when 'ARRAY' then json_array_length(e) > 0 when 'OBJECT' then cast(e as varchar) <> '{{}}'
           else cast(e as double) <> 0 end, false) end as enabled,
       case when annotated then nullif(split_part(trim(q), '.', 1), '') end as target_schema,
       case when annotated then nullif(split_part(trim(q), '.', 2), '') end as target_table
from (select *, coalesce(json_type(j) = 'OBJECT' and (b is null or json_type(b) = 'OBJECT'), false) as annotated,
             b->'enabled' as e, b->>'bq' as q
      from (select *, j->'bootstrap' as b
            from (select *, try_cast(comment as json) as j from SOURCE s) p) r) c"""


def annotated(source: str) -> str:
    return "(" + ANNOTATED.replace("SOURCE", source) + ")"


@register(f"""
select datname from {text(rel.DATABASES)} d where not datistemplate and datname not in ('db1', 'db2', 'b3')""")
def databases_discover(spark, sf_dir):
    return cat.discover_databases(relation(spark, sf_dir, rel.DATABASES), "db1, db2,b3")


FOUND = f"""
select t.database, t.schema, t.tbl, c.comment
from {text(rel.TABLES)} t
join {text(rel.CLASSES)} c on c.tbl = t.tbl and c.database = t.database
join {text(rel.NAMESPACES)} n on n.namespace_oid = c.namespace_oid and n.schema = t.schema and n.database = t.database
where t.table_type = 'BASE TABLE' and t.schema not in ('information_schema', 'pg_catalog', 'pg_toast')
  and not (t.schema = 'public' and t.tbl = 'debezium_signal')"""


@register(FOUND)
def tables_discover(spark, sf_dir):
    parts = (relation(spark, sf_dir, r) for r in (rel.TABLES, rel.CLASSES, rel.NAMESPACES))
    return cat.discover_tables(*parts)


QUALIFIED = f"""
select n.database, n.schema, n.tbl, coalesce(list_contains(pk, 'id') and has_id, false) as qualifies,
       case when pk is null then 'no_primary_key' when not has_id then 'no_id_column'
            when not list_contains(pk, 'id') then 'id_not_in_key'
            when len(pk) = 1 then 'single' else 'composite' end as reason,
       array_to_string(pk, ',') as pk_columns
from (select *, exists (select 1 from {text(rel.COLUMNS)} k where k.database = s.database and k.schema = s.schema
                        and k.tbl = s.tbl and k.column_name = 'id') as has_id from {text(rel.CATALOG)} s) n
left join (select kc.database, kc.schema, kc.tbl, list(column_name order by ordinal_position) as pk
           from {text(rel.CONSTRAINTS)} tc
           join {text(rel.KEY_COLUMNS)} kc on kc.constraint_name = tc.constraint_name and kc.schema = tc.schema
                and kc.database = tc.database and kc.tbl = tc.tbl
           where constraint_type = 'PRIMARY KEY' group by kc.database, kc.schema, kc.tbl) p
  on p.database = n.database and p.schema = n.schema and p.tbl = n.tbl"""


@register(QUALIFIED)
def key_qualify(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.CATALOG).select("database", "schema", "tbl")
    parts = (relation(spark, sf_dir, r) for r in (rel.CONSTRAINTS, rel.KEY_COLUMNS, rel.COLUMNS))
    found = cat.qualify_keys(tables, *parts)
    return found.withColumn("pk_columns", F.array_join("pk_columns", ","))


@register(f"""
select c_custkey, annotated, enabled, target_schema, target_table from {annotated(text(rel.CATALOG))} a""")
def annotation_parse(spark, sf_dir):
    return parse_annotations(relation(spark, sf_dir, rel.CATALOG)).select(
        "c_custkey", F.col("annotation").isNotNull().alias("annotated"), "annotation.*"
    )


@register(f"""
select c_custkey, coalesce(enabled, false) as enabled from {annotated(text(rel.CATALOG))} a""")
def enabled_filter(spark, sf_dir):
    parsed = parse_annotations(relation(spark, sf_dir, rel.CATALOG))
    on = cat.enabled(parsed).select("c_custkey", F.lit(True).alias("enabled"))
    return on.unionByName(cat.not_enabled(parsed).select("c_custkey", F.lit(False).alias("enabled")))


IDENTIFIED = f"""
select n.*, (select min(table_id) from {text(rel.LISTING)} l
             where l.database = n.database and l.schema = n.schema and l.tbl = n.tbl) as table_id
from {text(rel.CATALOG)} n
where (select count(*) from {text(rel.LISTING)} l
       where l.database = n.database and l.schema = n.schema and l.tbl = n.tbl) = 1"""


@register(f"select database, schema, tbl, table_id from ({IDENTIFIED}) i")
def table_id_resolve(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.CATALOG).select("database", "schema", "tbl")
    return cat.resolve_table_ids(tables, relation(spark, sf_dir, rel.LISTING))


COVERED = f"""
select i.database, i.schema, i.tbl, i.table_id, s.stream_id
from ({IDENTIFIED}) i join {text(rel.STREAMS)} s on s.database = i.database
where (s.stream_id, i.table_id) in (select (stream_id, table_id) from {text(rel.STREAM_TABLES)} t)"""


@register(COVERED)
def stream_coverage(spark, sf_dir):
    return cat.covered_tables(
        table_id_resolve(spark, sf_dir), relation(spark, sf_dir, rel.STREAM_TABLES), relation(spark, sf_dir, rel.STREAMS)
    )


@register(f"""
select f.database, f.schema, f.tbl, f.comment, reason, pk_columns, enabled, target_schema, target_table,
       table_id, stream_id
from {annotated("(" + FOUND + ")")} f
join ({QUALIFIED}) q on q.database = f.database and q.schema = f.schema and q.tbl = f.tbl and q.qualifies
join ({COVERED}) v on v.database = f.database and v.schema = f.schema and v.tbl = f.tbl""")
def candidates_discover(spark, sf_dir):
    """The whole discovery as one plan."""
    parts = (
        relation(spark, sf_dir, r)
        for r in (
            rel.TABLES, rel.CLASSES, rel.NAMESPACES, rel.CONSTRAINTS, rel.KEY_COLUMNS, rel.COLUMNS,
            rel.LISTING, rel.STREAM_TABLES, rel.STREAMS,
        )
    )
    found = cat.discover_candidates(*parts)
    return found.select(
        "database", "schema", "tbl", "comment", "reason", F.array_join("pk_columns", ",").alias("pk_columns"),
        "annotation.*", "table_id", "stream_id",
    )


@register(f"""
select split_part(ltrim(split_part(trim(value), ' ', 1)), '.', 2) as database,
       regexp_extract(value, 'ysql_schema=([^]]*)', 1) as schema,
       split_part(split_part(trim(value), ' ', 1), '.', 3) as tbl,
       regexp_extract(value, '\\] \\[([0-9a-f]+)\\]', 1) as table_id
from {text(rel.LISTING_LINES)} l where trim(value) like 'ysql.%' and value like '%] [x]%'""")
def admin_report_parse(spark, sf_dir):
    return adm.parse_table_listing(relation(spark, sf_dir, rel.LISTING_LINES))


@register(f"""
select distinct stream_id, split_part(value, '"', 2) as table_id
from {text(rel.STREAM_LINES)} l where trim(value) like 'table_id:%'""")
def admin_stream_parse(spark, sf_dir):
    return adm.parse_stream_info(relation(spark, sf_dir, rel.STREAM_LINES))


def first_stream(source: str) -> str:
    return f"""
(select * from {source} s qualify row_number() over (partition by database order by created_at, stream_id) = 1)"""


@register(f"""
select * from {text(rel.REGISTERED)} r
union all
select * from {first_stream(text(rel.UNREGISTERED))} n
where not exists (select 1 from {text(rel.REGISTERED)} r where r.database = n.database)""")
def stream_registry_put(spark, sf_dir):
    return cat.register_streams(relation(spark, sf_dir, rel.REGISTERED), relation(spark, sf_dir, rel.UNREGISTERED))


@register(f"select database, stream_id from {first_stream(text(rel.REGISTERED))} f")
def stream_lookup(spark, sf_dir):
    return cat.lookup_stream(relation(spark, sf_dir, rel.REGISTERED))


@register(f"""
select database, schema, tbl, exists (
    select 1 from {text(rel.TARGETS)} t where t.database = c.database and t.schema = c.schema and t.tbl = c.tbl) as target_exists
from {text(rel.CATALOG)} c""")
def exists_check(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.CATALOG).select("database", "schema", "tbl")
    return cat.with_existence(tables, relation(spark, sf_dir, rel.TARGETS), "target_exists")


@register(f"""
select database, schema, tbl, string_agg(column_name || ':' || data_type, ',' order by column_name) as types
from {text(rel.COLUMNS)} c group by database, schema, tbl""")
def column_types(spark, sf_dir):
    types = cat.column_types(relation(spark, sf_dir, rel.COLUMNS))
    entries = F.array_sort(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return types.select("database", "schema", "tbl", F.array_join(entries, ",").alias("types"))


@register(f"""
select database, schema, tbl, column_name, data_type,
       case when data_type like '%(%,%)' then 'decimal' || lower(substr(data_type, 8)) when data_type = 'text[]' then 'array<string>'
            when data_type = '_int4' then 'array<int>' when data_type = 'integer' then 'int' when data_type = 'boolean' then 'boolean'
            when data_type = 'double precision' then 'double' when data_type like 'timestamp % time zone' then
                 case when contains(data_type, 'without') then 'timestamp_ntz' else 'timestamp' end else 'string' end as target_type
from {text(rel.COLUMNS)} c""")
def type_map(spark, sf_dir):
    return map_types(relation(spark, sf_dir, rel.COLUMNS)).drop("ordinal_position")
