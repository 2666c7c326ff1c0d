"""Queries that plan what to start, repair or retire."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.annotations import parse_annotations
from driftline.operators.catalog import with_existence
from driftline.operators.catalog import discover_tables
from driftline.plans import health, routes, state, sync
from driftline.sessions import workspace
from driftline.sources.changes import read_changes
from driftline.sources.fleet import for_all
from driftline.sources.live import relations
from driftline.streaming.apply import stream_route
from workloads import relations as rel
from workloads.catalog_queries import annotated
from workloads.registry import register
from workloads.relations import relation, text

TABLE = ["database", "schema", "tbl"]
PARSED = annotated(text(rel.CATALOG))
ON_TABLE = "{0}.database = c.database and {0}.schema = c.schema and {0}.tbl = c.tbl"


def on(alias: str) -> str:
    return ON_TABLE.format(alias)


def parsed(spark, sf_dir):
    return parse_annotations(relation(spark, sf_dir, rel.CATALOG)).select(*TABLE, "annotation")


# -- routes ----------------------------------------------------------------------------------------

ROUTES = f"""
select database, schema, tbl, 'yb_' || database || '_' || schema || '_' || tbl as server,
       'yb_' || database || '_' || schema || '_' || tbl || '.' || schema || '.' || tbl as topic,
       'yb-source-' || database || '-' || schema || '-' || tbl as source_pipeline,
       'bq-sink-' || database || '-' || tbl as sink_pipeline, target_schema, target_table,
       case when target_schema is null or target_table is null then 'target_incomplete' end as error,
       case when target_schema is null or target_table is null then 'failed' else 'ok' end as status
from {PARSED} p"""


@register(ROUTES)
def route_targets(spark, sf_dir):
    return routes.routes(parsed(spark, sf_dir))


MIXED = f"""
(select c.database, c.schema, c.tbl, o_orderkey, o_totalprice from {text(rel.CATALOG)} c join orders on o_custkey = c_custkey)"""


@register(f"""
select m.database, m.schema, m.tbl, o_orderkey, o_totalprice, topic, target_schema, target_table
from {MIXED} m join ({ROUTES}) c on {on("m")} where status = 'ok'""")
def route_changes(spark, sf_dir):
    """A stream mixed from all tables, split by target."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tables = relation(spark, sf_dir, rel.CATALOG)
    mixed = orders.join(tables, orders.o_custkey == tables.c_custkey).select(*TABLE, "o_orderkey", "o_totalprice")
    return routes.route(mixed, routes.routes(parsed(spark, sf_dir)))


ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string"
)


@register(f"""
select database, schema, tbl, o_orderkey, o_totalprice, 'wh_' || substr(database, 3) as target_schema,
       schema as target_table
from {text(rel.FEED_ROWS)} f where database not in ('db0', 'db1', 'db2', 'db3', 'db4')""")
def route_stream(spark, sf_dir):
    """A stream mixed from the feeds of all nations and segments, written to one folder per target."""
    orders = read_changes(spark, f"{sf_dir}/orders.parquet*", ORDERS_SCHEMA)
    mixed = spark.sql(rel.FEED_ROWS, orders=orders, customer=relation(spark, sf_dir, "select * from {customer}"))
    plan = routes.routes(parse_annotations(relation(spark, sf_dir, rel.FEEDS)))
    path = workspace(spark, "routed")
    stream_route(mixed, plan, path, every=None).awaitTermination()
    rows = f"{mixed.drop('tbl').schema.toDDL()}, tbl string, target_schema string, target_table string"
    return routes.read_routed(spark, path, rows)


@register(f"""
select 'bq-sink-' || database || '-t' || cast(c_custkey // 100 as varchar) as sink_pipeline, count(*) as n
from {text(rel.CATALOG)} c group by 1 having count(*) > 1""")
def name_collisions(spark, sf_dir):
    """Tables of equal name in several schemas of a database would share a pipeline."""
    tables = relation(spark, sf_dir, rel.CATALOG).withColumn("tbl", F.expr("'t' || cast(c_custkey div 100 as string)"))
    return routes.collisions(routes.routes(parse_annotations(tables)))


@register(f"""
select 'shop_' || schema as database, tbl, enabled, error, status
from (select c.*, e.enabled from ({ROUTES}) c join {PARSED} e on {on("e")}) r""")
def fleet_union(spark, sf_dir):
    """Catalogs kept per database, worked through as one; a bad table does not stop the others."""
    catalog = relation(spark, sf_dir, rel.CATALOG)
    segments = ("automobile", "building", "furniture", "household", "machinery")
    dumps = {f"shop_{s}": catalog.filter(F.col("schema") == s).drop("database") for s in segments}
    tables = parse_annotations(routes.for_all(dumps))
    plan = routes.routes(tables).select("database", "tbl", "error", "status")
    return plan.join(tables.select("database", "tbl", "annotation.enabled"), ["database", "tbl"])


# Of the feeds some cannot be read: their files are damaged, or they have none.
FEED_STATE = """
case when schema = 'furniture' and length(database) = 3 then 'damaged' when schema = 'building' and database > 'db2' then 'absent' else 'ok' end"""

FEED_SUMS = f"""
select database, schema, tbl, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents, max({FEED_STATE}) as state
from {text(rel.FEED_ROWS)} f group by database, schema, tbl"""


@register(f"""
select database, schema, tbl, case when state = 'ok' then cents end as cents, case when state = 'ok' then 'ok' else 'failed' end as status,
       case state when 'absent' then 'missing' when 'damaged' then 'read 0 of ' || n || ' rows' end as error
from ({FEED_SUMS}) s""")
def fleet_read(spark, sf_dir):
    """One job over the feeds of all databases, with the outcome of each; damaged and absent ones do not stop the rest."""
    feeds = relation(spark, sf_dir, rel.FEED_ROWS).withColumn("state", F.expr(FEED_STATE))
    inventory = feeds.groupBy(*TABLE).agg(F.count("*").alias("n"))
    path = workspace(spark, "feeds")
    feeds.filter("state = 'ok'").drop("state").repartition(*TABLE).write.partitionBy(*TABLE).parquet(path)
    damaged = feeds.filter("state = 'damaged'").select(*TABLE).distinct().withColumn("value", F.lit("no columns here"))
    damaged.coalesce(1).write.mode("append").partitionBy(*TABLE).text(path)
    databases = [r[0] for r in inventory.select("database").distinct().collect()]
    sums = lambda rows: rows.groupBy(*TABLE).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return for_all(spark, {d: f"{path}/database={d}" for d in databases}, inventory, "o_orderkey bigint, o_totalprice double", sums)


@register(f"""
select database as schema, schema as tbl, enabled, target_schema, target_table, 'BASE TABLE' as table_type
from {annotated(text(rel.FEEDS))} f where database <> 'db7'""")
def live_catalog(spark, sf_dir):
    """The feeds as tables of the session, with their annotations as comments: discovered from the session's catalog."""
    feeds = relation(spark, sf_dir, rel.FEEDS).collect()
    path = workspace(spark, "live")
    run = path.rpartition("-")[2][:12]
    try:
        for database in sorted({f.database for f in feeds}):
            spark.sql(f"create database live_{run}_{database} location '{path}/{database}'")
        for f in feeds:
            name = f"live_{run}_{f.database}.{f.schema}"
            if f.database == "db7":
                spark.sql(f"create view {name} comment {_quoted(f.comment)} as select 1 as id")
            else:
                spark.sql(f"create table {name} (id bigint, at timestamp) using parquet comment {_quoted(f.comment)}")
        found = relations(spark, [f"live_{run}_{d}" for d in sorted({f.database for f in feeds})])
        tables = parse_annotations(discover_tables(found.tables, found.classes, found.namespaces))
        kinds = found.tables.select(*TABLE, "table_type")
        named = tables.join(kinds, TABLE).select(F.regexp_replace("schema", "^live_[^_]*_", "").alias("schema"), "tbl", "annotation.*", "table_type")
        return named.select("schema", "tbl", "enabled", "target_schema", "target_table", "table_type")
    finally:
        for database in {f.database for f in feeds}:
            spark.sql(f"drop database if exists live_{run}_{database} cascade")


def _quoted(comment):
    return "'" + comment.replace("\\", "\\\\").replace("'", "\\'") + "'"


# -- pipelines -------------------------------------------------------------------------------------

STATUS = f"""
select c.*, exists (select 1 from {text(rel.PIPELINES)} p where {on("p")} and kind = 'source') as source_exists,
       exists (select 1 from {text(rel.PIPELINES)} p where {on("p")} and kind = 'sink') as sink_exists
from {PARSED} c"""

FLEET = f"""
select c.*, exists (select 1 from {text(rel.TARGETS)} t where {on("t")}) as target_exists,
       coalesce(source_count, 0) as source_count, updated_at
from ({STATUS}) c left join {text(rel.ORDER_COUNTS)} n on {on("n")} left join {text(rel.LAST_ORDERS)} u on {on("u")}"""


def status(spark, sf_dir):
    return sync.with_status(parsed(spark, sf_dir), relation(spark, sf_dir, rel.PIPELINES))


def fleet(spark, sf_dir):
    """Annotated tables with everything the planner looks at."""
    known = with_existence(status(spark, sf_dir), relation(spark, sf_dir, rel.TARGETS), "target_exists")
    return (
        known.join(relation(spark, sf_dir, rel.ORDER_COUNTS), TABLE, "left")
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
        .join(relation(spark, sf_dir, rel.LAST_ORDERS), TABLE, "left")
    )


@register(f"select database, schema, tbl, source_exists, sink_exists from ({STATUS}) s")
def connector_status(spark, sf_dir):
    return status(spark, sf_dir).drop("annotation")


PLAN = f"""
select *, action = 'full_setup' and target_exists as needs_backfill,
       action in ('full_setup', 'add_source') and source_count > 0 as needs_snapshot,
       action = 'full_setup' and source_count > 0 as capture_count,
       case when action not in ('skip', 'ok') and (target_schema is null or target_table is null)
            then 'target_incomplete' end as problem
from (select *, case when not coalesce(enabled, false) then 'skip'
                     when not source_exists and not sink_exists then 'full_setup'
                     when source_exists and not sink_exists then 'add_sink'
                     when sink_exists and not source_exists then 'add_source' else 'ok' end as action
      from ({FLEET}) f) a"""


@register(f"""
select database, schema, tbl, action, needs_backfill, needs_snapshot, capture_count, problem from ({PLAN}) p""")
def sync_plan(spark, sf_dir):
    plan = sync.sync_plan(fleet(spark, sf_dir))
    return plan.select(*TABLE, "action", "needs_backfill", "needs_snapshot", "capture_count", "problem")


@register(f"""
select count(*) as scanned, count(*) filter (where action = 'ok') as in_sync,
       count(*) filter (where action in ('full_setup', 'add_sink', 'add_source') and problem is null) as to_sync,
       count(problem) as errors, count(*) filter (where source_exists and sink_exists) as active
from ({PLAN}) p""")
def scan_counters(spark, sf_dir):
    return state.scan_counters(sync.sync_plan(fleet(spark, sf_dir)))


# Targets as they were named when the pipelines started; some annotations have vanished or moved since.
REMEMBERED = f"""
select database, schema, tbl, 'old_' || database as target_schema, tbl as target_table from {text(rel.TARGETS)} t where contains(database, '1')"""

RETIRED = f"""
select f.*, coalesce(r.target_schema || '.' || r.target_table, f.target_schema || '.' || f.target_table) as target,
       'yb-source-' || f.database || '-' || f.schema || '-' || f.tbl as source, 'bq-sink-' || f.database || '-' || f.tbl as sink
from ({FLEET}) f left join ({REMEMBERED}) r on r.database = f.database and r.schema = f.schema and r.tbl = f.tbl"""


@register(f"""
with fleet as ({RETIRED}), off as (select * from fleet where not coalesce(enabled, false)),
     kept as (select distinct sink from fleet where enabled)
select database, schema, tbl, 1 as step, 'target' as object, target as name, false as shared from off where target_exists
union all select database, schema, tbl, 2, 'source', source, false from off where source_exists
union all select database, schema, tbl, 3, 'sink', sink, sink in (select sink from kept) from off where sink_exists""")
def retire_plan(spark, sf_dir):
    remembered = relation(spark, sf_dir, rel.TARGETS).filter(F.contains("database", F.lit("1")))
    targets = remembered.select(*TABLE, F.concat(F.lit("old_"), "database").alias("target_schema"), F.col("tbl").alias("target_table"))
    return sync.retire_plan(fleet(spark, sf_dir), targets)


@register(f"""
with fleet as (select database, schema, case when k.custkey % 3 = 0 then 'shared' else tbl end as tbl, coalesce(enabled, false) as enabled
               from (select p.*, c.c_custkey as custkey from {PARSED} p join {text(rel.CATALOG)} c on {on("p")}) k),
     counted as (select database, schema, tbl, bool_or(enabled) as enabled from fleet group by all)
select database, schema, tbl, 'bq-sink-' || database || '-' || tbl as name,
       exists (select 1 from counted o where o.enabled and o.database = c.database and o.tbl = c.tbl) as shared
from counted c where not enabled""")
def retire_shared(spark, sf_dir):
    """Sinks to retire, and whether another table still writes through one of that name."""
    tables = parse_annotations(relation(spark, sf_dir, rel.CATALOG)).withColumn("tbl", F.when(F.col("c_custkey") % 3 == 0, "shared").otherwise(F.col("tbl")))
    on = F.bool_or(F.coalesce("annotation.enabled", F.lit(False)))
    fleet = tables.groupBy(*TABLE).agg(on.alias("_on"))
    flags = {"target_exists": F.lit(False), "source_exists": F.lit(False), "sink_exists": F.lit(True)}
    annotation = F.struct(F.col("_on").alias("enabled"), F.lit("w").alias("target_schema"), F.lit("t").alias("target_table"))
    plan = sync.retire_plan(fleet.withColumn("annotation", annotation).withColumns(flags))
    return plan.select(*TABLE, "name", "shared")


# -- health ----------------------------------------------------------------------------------------


def reports(spark, sf_dir):
    """One status report per table with two tasks; the first always runs."""
    tasks = relation(spark, sf_dir, rel.TASKS)
    task = lambda i, s, t: F.struct(
        F.lit(i).alias("id"), s.cast("string").alias("state"), t.cast("string").alias("trace")
    )
    return tasks.select(
        *TABLE,
        F.struct(F.col("connector_state").alias("state")).alias("connector"),
        F.array(
            task(0, F.lit("RUNNING"), F.lit(None)), task(1, F.col("task_state"), F.col("trace"))
        ).alias("tasks"),
    )


@register(f"""
select database, schema, tbl, 1 as task_id, trace,
       case when contains(trace, 'BigQuery') then 'bigquery' when regexp_matches(lower(trace), 'schema|avro') then 'schema'
            when regexp_matches(lower(trace), 'quota|rate') then 'quota' else 'general' end as failure
from {text(rel.TASKS)} t where task_state = 'FAILED'""")
def failure_classify(spark, sf_dir):
    return health.classify(reports(spark, sf_dir))


@register(f"""
select database, schema, tbl, coalesce(connector_state, 'UNKNOWN') as state, cast(2 as bigint) as tasks,
       cast(case when task_state = 'RUNNING' then 2 else 1 end as bigint) as running,
       cast(case when task_state = 'FAILED' then 1 else 0 end as bigint) as failed,
       cast(case when task_state is null then 1 else 0 end as bigint) as unknown
from {text(rel.TASKS)} t""")
def status_rollup(spark, sf_dir):
    return health.status_rollup(reports(spark, sf_dir))


@register(f"""
select c.database, c.schema, c.tbl, case when s.tbl is not null then coalesce(s.connector_state, 'UNKNOWN') end as state,
       case when s.tbl is null then 'create' when s.connector_state = 'RUNNING' then 'ok' else 'restart' end as action,
       'yb_' || c.database || '_' || c.schema || '_' || c.tbl || '.' || c.schema || '.' || c.tbl
         not in (select topic from {text(rel.TOPICS)} t) as topic_missing
from {text(rel.CATALOG)} c left join {text(rel.TASKS)} s on {on("s")}""")
def health_plan(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.CATALOG).select(*TABLE)
    running = relation(spark, sf_dir, rel.TASKS).select(*TABLE, F.col("connector_state").alias("state"))
    return health.health_plan(tables, running, relation(spark, sf_dir, rel.TOPICS))


# -- tracked state ---------------------------------------------------------------------------------


def hashed(source: str) -> str:
    return f"""
(select database, schema, tbl, coalesce(enabled, false) as is_on,
        sha256('{{"enabled":' || case when enabled then 'true' else 'false' end || ',"target_schema":"'
               || coalesce(target_schema, '') || '","target_table":"' || coalesce(target_table, '') || '"}}') as h
 from {annotated(text(source))} a)"""


@register(f"""
select coalesce(o.database, n.database) as database, coalesce(o.schema, n.schema) as schema,
       coalesce(o.tbl, n.tbl) as tbl, o.h as old_hash, n.h as new_hash,
       case when o.h is null then 'added' when n.h is null then 'removed' when o.h = n.h then 'same'
            when n.is_on and not o.is_on then 'enabled' when o.is_on and not n.is_on then 'disabled'
            else 'changed' end as change
from {hashed(rel.OLD_CATALOG)} o full join {hashed(rel.NEW_CATALOG)} n
  on n.database = o.database and n.schema = o.schema and n.tbl = o.tbl""")
def state_diff(spark, sf_dir):
    old, new = (parse_annotations(relation(spark, sf_dir, r)) for r in (rel.OLD_CATALOG, rel.NEW_CATALOG))
    return state.state_diff(old, new)


@register(f"""
select count(*) as tracked, count(*) filter (where enabled) as enabled,
       count(*) filter (where source_exists and sink_exists) as running,
       count(*) filter (where updated_at >= timestamp '2001-07-31') as recent, max(updated_at) as last_update
from ({FLEET}) f""")
def sync_summary(spark, sf_dir):
    return state.summary(fleet(spark, sf_dir), "2001-08-01")


@register(f"""
select database, schema, tbl, case when not annotated then 'none' when enabled then 'enabled' else 'disabled' end as config,
       case when target_schema is not null and target_table is not null then target_schema || '.' || target_table
            else coalesce(target_schema, target_table) end as target,
       case when source_exists and sink_exists then 'running' when source_exists or sink_exists then 'partial'
            else 'absent' end as pipeline, updated_at as last_update
from ({FLEET}) f""")
def table_report(spark, sf_dir):
    return state.report(fleet(spark, sf_dir))
