"""Input relations as SQL over the given tables, in the dialect that Spark and DuckDB share.

``{name}`` stands for a given table. The relations play the parts a replication job meets: a change
log, a table with versions, a fleet's catalog with its companions, a count ledger and a signal log.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def fields(sql: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{name: given(spark, sf_dir, name) for name in fields(sql)})


_schemas: dict[str, T.StructType] = {}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once, not for every use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def text(sql: str) -> str:
    """The same relation as a parenthesised subquery for the counterpart."""
    return "(" + sql.format(**{name: name for name in fields(sql)}) + ")"


# -- change log ----------------------------------------------------------------------------------

CHANGES = """
select user_id, event_id as lsn, ts,
       case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op,
       event_type, value, props
from {events}"""

RAW_RECORDS = """
select event_id, case when event_id % 100 = 0 then '{{bad' else props end as body from {events}"""

# -- a table, its changes and its schema drift -----------------------------------------------------

ORDER_STATE = """
select o_orderkey, 'r' as op, cast(-1 as bigint) as lsn, o_custkey, o_orderstatus, o_totalprice from {orders}"""

# Orders in process change price, finished ones of low priority are deleted, urgent ones come in anew
# under a new key, and every delete of an order is preceded by an update of it.
ORDER_CHANGES = """
select o_orderkey, 'u' as op, cast(1 as bigint) as lsn, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice
from {orders} where o_orderstatus in ('P', 'F')
union all
select o_orderkey, 'd' as op, cast(2 as bigint) as lsn, cast(null as bigint) as o_custkey,
       cast(null as string) as o_orderstatus, cast(null as double) as o_totalprice
from {orders} where o_orderstatus = 'F' and o_orderpriority = '5-LOW'
union all
select -1 - o_orderkey as o_orderkey, 'c' as op, cast(3 as bigint) as lsn, o_custkey, 'O' as o_orderstatus, o_totalprice
from {orders} where o_orderpriority = '1-URGENT'"""

OLD_BATCH = """
select o_orderkey, cast(o_custkey as int) as o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       cast(o_orderkey % 90 as int) as reference
from {orders} where o_orderdate < cast('1998-01-01' as date)"""

NEW_BATCH = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       'R' || cast(o_orderkey % 90 as string) as reference, o_orderpriority
from {orders} where o_orderdate >= cast('1998-01-01' as date)"""

# -- catalog ---------------------------------------------------------------------------------------

CATALOG = """
select c_custkey, c_nationkey, c_acctbal, 'db' || cast(c_nationkey as string) as database,
       lower(c_mktsegment) as schema, 't' || cast(c_custkey as string) as tbl,
       case c_custkey % 12
         when 0 then cast(null as string) when 1 then '   ' when 2 then 'not json' when 3 then '[1]'
         when 4 then '{{"bootstrap":7}}' when 5 then '{{"other":1}}'
         when 6 then '{{"bootstrap":{{"enabled":"false","bq":"d.t"}}}}'
         when 7 then '{{"bootstrap":{{"enabled":0,"bq":"d.t"}}}}'
         when 8 then '{{"bootstrap":{{"enabled":true}}}}'
         when 9 then '{{"bootstrap":{{"enabled":true,"bq":"nodot"}}}}'
         when 10 then '{{"bootstrap":{{"enabled":true,"bq":" a.b.c "}}}}'
         else '{{"bootstrap":{{"enabled":true,"bq":"wh_' || cast(c_nationkey as string)
              || '.t' || cast(c_custkey as string) || '"}}}}' end as comment
from {customer}"""

DATABASES = """
select distinct 'db' || cast(c_nationkey as string) as datname, c_nationkey % 6 = 0 as datistemplate from {customer}"""

# Some tables lie in a system schema and some are the signal table.
_PLACED = """
select c_custkey, 'db' || cast(c_nationkey as string) as database,
       case when c_custkey % 29 = 0 then 'pg_catalog' when c_custkey % 31 = 0 then 'public'
            else lower(c_mktsegment) end as schema,
       case when c_custkey % 29 <> 0 and c_custkey % 31 = 0 then 'debezium_signal'
            else 't' || cast(c_custkey as string) end as tbl
from {customer}"""

TABLES = f"""
select database, schema, tbl, case when c_custkey % 13 = 0 then 'VIEW' else 'BASE TABLE' end as table_type
from ({_PLACED}) placed"""

CLASSES = f"""
select database, md5(schema) as namespace_oid, tbl, 'about ' || tbl as comment from ({_PLACED}) placed"""

NAMESPACES = f"""
select distinct database, md5(schema) as namespace_oid, schema from ({_PLACED}) placed"""

_NAMED = f"select c_custkey, c_nationkey, c_acctbal, database, schema, tbl from ({CATALOG}) catalog"

CONSTRAINTS = f"""
select database, schema, tbl, 'pk_' || tbl as constraint_name, 'PRIMARY KEY' as constraint_type
from ({_NAMED}) named where c_acctbal >= 0
union all
select database, schema, tbl, 'uq_' || tbl as constraint_name, 'UNIQUE' as constraint_type from ({_NAMED}) named"""

KEY_COLUMNS = f"""
select database, schema, tbl, 'pk_' || tbl as constraint_name,
       case when c_acctbal < 3000 then 'id' when c_acctbal < 6000 then 'tenant' else 'code' end as column_name, 1 as ordinal_position
from ({_NAMED}) named where c_acctbal >= 0
union all
select database, schema, tbl, 'pk_' || tbl as constraint_name, 'id' as column_name, 2 as ordinal_position
from ({_NAMED}) named where c_acctbal >= 3000 and c_acctbal < 6000
union all
select database, schema, tbl, 'uq_' || tbl as constraint_name, 'id' as column_name, 1 as ordinal_position
from ({_NAMED}) named"""

COLUMNS = f"""
select database, schema, tbl, 'id' as column_name, 'integer' as data_type, 1 as ordinal_position
from ({_NAMED}) named where c_acctbal < 8000
union all
select database, schema, tbl, 'tenant' as column_name, 'character varying' as data_type, 2 as ordinal_position
from ({_NAMED}) named
union all
select database, schema, tbl, 'code' as column_name, 'text' as data_type, 3 as ordinal_position
from ({_NAMED}) named
union all
select database, schema, tbl, 'payload' as column_name,
       case c_custkey % 10 when 0 then 'jsonb' when 1 then 'NUMERIC(12,2)' when 2 then 'timestamp with time zone'
         when 3 then 'timestamp without time zone' when 4 then 'text[]' when 5 then '_int4' when 6 then 'varchar(255)'
         when 7 then 'boolean' when 8 then 'double precision' else 'tsvector' end as data_type, 4 as ordinal_position
from ({_NAMED}) named"""

LISTING = f"""
select database, schema, tbl, md5(tbl) as table_id from ({_NAMED}) named
union all
select database, schema, tbl, md5('again' || tbl) as table_id from ({_NAMED}) named where c_acctbal >= 2000 and c_acctbal < 2500"""

STREAM_TABLES = f"""
select md5(database) as stream_id, md5(tbl) as table_id from ({_NAMED}) named where c_acctbal < 9000"""

STREAMS = f"""
select database, md5(database) as stream_id, count(*) as created_at from ({_NAMED}) named
where c_nationkey not in (0, 5, 10, 15, 20) group by database"""

LISTING_LINES = f"""
select case when c_custkey % 13 = 0 then 'ysql.' || database || '.' || tbl || ' [ysql_schema=' || schema || ']'
            when c_custkey % 17 = 0 then 'system.' || tbl || ' [ysql_schema=' || schema || '] [' || md5(tbl) || '] [x]'
            else '  ysql.' || database || '.' || tbl || '   [ysql_schema=' || schema || '] [' || md5(tbl) || '] [x] '
       end as value
from ({_NAMED}) named"""

STREAM_LINES = f"""
select md5(database) as stream_id,
       case when c_custkey % 11 = 0 then 'table_ids: "' || md5(tbl) || '"'
            else '  table_id: "' || md5(tbl) || '"' end as value
from ({_NAMED}) named"""

REGISTERED = """
select 'db' || cast(o_custkey as string) as database, md5(cast(o_orderkey as string)) as stream_id,
       o_orderdate as created_at
from {orders} where o_orderstatus = 'F'"""

UNREGISTERED = """
select 'db' || cast(o_custkey as string) as database, md5(cast(o_orderkey as string)) as stream_id,
       o_orderdate as created_at
from {orders} where o_orderstatus <> 'F'"""

# One feed of orders per nation and segment; those of five nations name no complete target.
FEEDS = """
select distinct 'db' || cast(c_nationkey as string) as database, lower(c_mktsegment) as schema, 'orders' as tbl,
       case when c_nationkey < 5 then '{{"bootstrap":{{"enabled":true,"bq":"wh"}}}}'
            else '{{"bootstrap":{{"enabled":true,"bq":"wh_' || cast(c_nationkey as string) || '.'
                 || lower(c_mktsegment) || '"}}}}' end as comment
from {customer}"""

FEED_ROWS = """
select 'db' || cast(c_nationkey as string) as database, lower(c_mktsegment) as schema, 'orders' as tbl,
       o_orderkey, o_totalprice
from {orders} join {customer} on o_custkey = c_custkey"""

# -- count ledger ----------------------------------------------------------------------------------

_CUSTOMER_TABLES = """
select 'db' || cast(o_custkey % 25 as string) as database, 'sales' as schema,
       't' || cast(o_custkey as string) as tbl, o_custkey, o_orderkey, o_orderdate, o_orderstatus
from {orders}"""

SOURCE_COUNTS = f"""
select database, schema, tbl, o_custkey, count(*) as row_count, max(o_orderdate) as last_order
from ({_CUSTOMER_TABLES}) rows group by database, schema, tbl, o_custkey"""

TARGET_ROWS = f"""
select database, schema, tbl from ({_CUSTOMER_TABLES}) rows
where o_orderdate < cast('2001-06-01' as date)
  and not exists (select 1 from {{customer}} where c_custkey = o_custkey and c_acctbal < -800)"""

# -- signal log ------------------------------------------------------------------------------------

SIGNAL_TABLES = """
select 'db' || cast(user_id % 25 as string) as database, event_type as schema,
       'u' || cast(user_id as string) as tbl, ts as created_at,
       case event_id % 10 when 0 then 'schema-change' when 1 then 'pause' else 'execute-snapshot' end as kind,
       cast(event_id % 4 * 3600 as int) as ttl_seconds
from {events}"""

SIGNAL_CATALOG = """
select distinct 'db' || cast(user_id % 25 as string) as database, event_type as schema,
       'u' || cast(user_id as string) as tbl
from {events} where event_type in ('purchase', 'view', 'error')"""

# -- planner inputs --------------------------------------------------------------------------------

PIPELINES = f"""
select database, schema, tbl, 'source' as kind from ({_NAMED}) named where c_acctbal > 3500
union all
select database, schema, tbl, 'sink' as kind from ({_NAMED}) named where schema not in ('furniture', 'building')"""

TARGETS = f"select database, schema, tbl from ({_NAMED}) named where c_nationkey < 13"

ORDER_COUNTS = f"""
select named.database, named.schema, named.tbl, count(*) as source_count
from ({_NAMED}) named join {{orders}} on o_custkey = c_custkey
group by named.database, named.schema, named.tbl"""

LAST_ORDERS = f"""
select named.database, named.schema, named.tbl, max(o_orderdate) as updated_at
from ({_NAMED}) named join {{orders}} on o_custkey = c_custkey
group by named.database, named.schema, named.tbl"""

TASKS = f"""
select c_custkey, database, schema, tbl,
       case when c_custkey % 9 = 0 then cast(null as string) when c_custkey % 6 = 0 then 'PAUSED' else 'RUNNING' end
         as connector_state,
       case when c_custkey % 4 = 0 then 'FAILED' when c_custkey % 7 = 0 then cast(null as string)
            else 'RUNNING' end as task_state,
       case c_custkey % 7 when 0 then 'BigQuery error' when 1 then 'bad Schema' when 2 then 'Quota hit'
         when 3 then 'bigquery lower' when 4 then 'boom' when 5 then 'AVRO id unknown' else 'Rate exceeded' end as trace
from ({_NAMED}) named"""

TOPICS = f"""
select 'yb_' || database || '_' || schema || '_' || tbl || '.' || schema || '.' || tbl as topic
from ({_NAMED}) named where c_nationkey <> 7"""

OLD_CATALOG = f"select database, schema, tbl, comment from ({CATALOG}) catalog where c_nationkey <> 3"

NEW_CATALOG = f"""
select database, schema, tbl,
       case when c_custkey % 23 = 0 and c_custkey % 12 >= 8 then '{{{{"bootstrap":{{{{"enabled":false}}}}}}}}'
            when c_custkey % 23 = 0 then '{{{{"bootstrap":{{{{"enabled":true,"bq":"n.t"}}}}}}}}'
            when c_custkey % 12 = 11 and c_custkey % 5 = 0 then '{{{{"bootstrap":{{{{"enabled":true,"bq":"moved.t"}}}}}}}}'
            else comment end as comment
from ({CATALOG}) catalog where c_nationkey <> 8"""
