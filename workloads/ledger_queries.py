"""Queries over the count ledger and the signal log."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.names import TABLE, ledger_key
from driftline.operators import ledger as led
from driftline.operators import signals as sig
from driftline.sessions import workspace
from driftline.streaming.expiry import ORDER, expirations, stream_expirations
from driftline.streaming.target import KeyedTarget
from workloads import relations as rel
from workloads.change_queries import FLEET_LOG, FLEET_STATE, event_stream, fleet_log, fleet_target
from workloads.registry import register
from workloads.relations import relation, text

NOW = "2001-06-15 00:00:00"
TTL_DAYS = 90
DAY = 86_400

# -- ledger ----------------------------------------------------------------------------------------

LEDGER = f"""
(select database, schema, tbl, row_count, last_order as captured_at,
        case when o_custkey % 3 <> 0 then last_order + interval {TTL_DAYS} day end as expires_at
 from {text(rel.SOURCE_COUNTS)} c)"""

TARGET_COUNTS = f"(select database, schema, tbl, count(*) as n from {text(rel.TARGET_ROWS)} r group by all)"


def empty_ledger(spark):
    return spark.createDataFrame(
        [],
        "database string, schema string, tbl string, row_count bigint, captured_at timestamp_ntz, expires_at timestamp_ntz",
    )


def stored(spark, df, name):
    """The relation as a written table, as a ledger or log is between two jobs."""
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark, sf_dir, ledger):
    ttl = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(TTL_DAYS * DAY)
    return led.ledger_put(ledger, relation(spark, sf_dir, rel.SOURCE_COUNTS), F.col("last_order"), ttl)


def ledger(spark, sf_dir):
    return stored(spark, put(spark, sf_dir, empty_ledger(spark)), "ledger")


@register(f"select * from {LEDGER} l")
def ledger_put(spark, sf_dir):
    """Every table's count put over an older one."""
    older = ledger(spark, sf_dir).withColumns(
        {"row_count": F.col("row_count") - 1, "expires_at": F.lit(None).cast("timestamp_ntz")}
    )
    return put(spark, sf_dir, older)


@register(f"""
select 'cache:row_counts:table_sync:' || database || '.' || schema || '.' || tbl || ':yugabyte_count' as key,
       row_count, captured_at, expires_at
from {LEDGER} l where expires_at is null or expires_at > timestamp '{NOW}'""")
def ledger_get(spark, sf_dir):
    live = led.ledger_live(ledger(spark, sf_dir), NOW)
    return live.select(ledger_key("cache", "row_counts").alias("key"), "row_count", "captured_at", "expires_at")


RECONCILED = f"""
select l.database, l.schema, l.tbl, row_count as expected, n as actual,
       case when expires_at <= timestamp '{NOW}' then 'expired' when n is null then 'target_missing'
            when n = row_count then 'matched' else 'pending' end as status
from {LEDGER} l left join {TARGET_COUNTS} t on t.database = l.database and t.schema = l.schema and t.tbl = l.tbl"""


def reconciled(spark, sf_dir, counts):
    return led.reconcile(counts, led.row_counts_by_table(relation(spark, sf_dir, rel.TARGET_ROWS)), NOW)


@register(RECONCILED)
def reconcile_counts(spark, sf_dir):
    return reconciled(spark, sf_dir, ledger(spark, sf_dir))


@register(f"""
select e.database, e.schema, e.tbl, expected, n as actual,
       case when n is null then 'target_missing' when n = expected then 'matched' else 'pending' end as status
from (select database, schema, tbl, count(distinct user_id) as expected from ({FLEET_LOG}) f group by all) e
left join (select database, schema, tbl, count(*) as n from ({FLEET_STATE}) s group by all) t
  on t.database = e.database and t.schema = e.schema and t.tbl = e.tbl""")
def reconcile_fleet(spark, sf_dir):
    """Counts of all keys ever seen against the counts that a fleet's merges left; no row is read for them."""
    log = fleet_log(relation(spark, sf_dir, rel.CHANGES))
    seen = log.groupBy(*TABLE).agg(F.count_distinct("user_id").alias("row_count"))
    counts = led.ledger_put(empty_ledger(spark), seen, NOW, 0)
    return led.reconcile(counts, fleet_target(spark, sf_dir).counts(spark), NOW)


# One snapshot signal for each table of the ledger, raised when its count was captured.
LEDGER_SIGNALS = f"""
(select database, 'snap_' || schema || '_' || tbl || '_' || cast(floor(epoch(captured_at)) as bigint) as id,
        schema, tbl from {LEDGER} l)"""


def settled(spark, sf_dir):
    counts = ledger(spark, sf_dir)
    signals = sig.signals_for(counts, at="captured_at")
    return led.settle(counts, signals, reconciled(spark, sf_dir, counts))


@register(f"""
select l.* from {LEDGER} l join ({RECONCILED}) r on r.database = l.database and r.schema = l.schema and r.tbl = l.tbl
where r.status <> 'matched'""")
def settle(spark, sf_dir):
    return settled(spark, sf_dir)[0]


@register(f"""
select s.database, s.id from {LEDGER_SIGNALS} s
join ({RECONCILED}) r on r.database = s.database and r.schema = s.schema and r.tbl = s.tbl
where r.status <> 'matched'""")
def settle_signals(spark, sf_dir):
    return settled(spark, sf_dir)[1].select("database", "id")


# -- signals ---------------------------------------------------------------------------------------

SIGNAL_NOW = "2024-01-15 00:00:00"

LOG = f"""
(select database,
        'snap_' || schema || '_' || tbl
          || case when kind = 'execute-snapshot' then '_' || cast(floor(epoch(created_at)) as bigint) else '' end as id,
        kind as type,
        case kind when 'execute-snapshot' then '{{"data-collections":["' || schema || '.' || tbl || '"],"type":"incremental"}}'
                  when 'schema-change' then '{{"database":"' || database || '"}}' else '{{}}' end as data,
        created_at, schema, tbl, ttl_seconds
 from {text(rel.SIGNAL_TABLES)} t)"""

NAMING = f"(select *, schema || '.' || tbl as collection from {LOG} l where type = 'execute-snapshot')"


def signal_log(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.SIGNAL_TABLES)
    return sig.signals_for(tables, F.col("kind"))


@register(f"select database, id, type, data, created_at from {LOG} l")
def signal_append(spark, sf_dir):
    return signal_log(spark, sf_dir)


@register(f"""
select database, id, type, data, created_at from {LOG} l
qualify row_number() over (partition by database, id order by created_at, type, data) = 1""")
def signal_log_append(spark, sf_dir):
    """The log written in two parts; the second repeats a part of the first and has ids twice itself."""
    signals = signal_log(spark, sf_dir).select("database", "id", "type", "data", "created_at")
    early = signals.filter("created_at < timestamp '2024-01-10 00:00:00'")
    return sig.append(sig.append(signals.limit(0), early), signals)


@register(f"""
select database, id, type, data, created_at from {LOG} l where created_at >= timestamp '{SIGNAL_NOW}' - interval 24 hour""")
def signal_retention(spark, sf_dir):
    return sig.retain(signal_log(spark, sf_dir), SIGNAL_NOW)


@register(f"select id, type, data, created_at from {LOG} l order by created_at desc, id")
def signal_active(spark, sf_dir):
    return sig.active(signal_log(spark, sf_dir))


@register(f"""
select c.database, c.schema, c.tbl, count(distinct id) as signals, count(distinct id) > 0 as has_signal
from {text(rel.SIGNAL_CATALOG)} c
left join {NAMING} l on l.collection = c.schema || '.' || c.tbl and l.database = c.database
group by c.database, c.schema, c.tbl""")
def signal_exists(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.SIGNAL_CATALOG)
    return sig.has_signal(tables, signal_log(spark, sf_dir), on=("database", "collection"))


@register(f"""
select database, schema, tbl,
       exists (select 1 from {LOG} l where l.id = 'snap_' || c.schema || '_' || c.tbl and l.database = c.database) as listed
from {text(rel.SIGNAL_CATALOG)} c""")
def signal_id_exists(spark, sf_dir):
    return sig.signal_ids(relation(spark, sf_dir, rel.SIGNAL_CATALOG), signal_log(spark, sf_dir))


@register(f"select distinct database, collection from {NAMING} l")
def signal_collections(spark, sf_dir):
    return sig.collections(signal_log(spark, sf_dir))


@register(f"""
select database, id, type, data, created_at from {LOG} l
where not (type = 'execute-snapshot' and schema in ('purchase', 'view', 'error'))""")
def signal_remove(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.SIGNAL_CATALOG).withColumn("collection", F.concat_ws(".", "schema", "tbl"))
    return sig.remove(signal_log(spark, sf_dir), tables, on=("database", "collection"))


@register(f"""
select created_at, ttl_seconds, kind as type from {text(rel.SIGNAL_TABLES)} t
where ttl_seconds = 0 or created_at + ttl_seconds * interval 1 second > timestamp '{SIGNAL_NOW}'""")
def signal_expiry(spark, sf_dir):
    tables = relation(spark, sf_dir, rel.SIGNAL_TABLES)
    return sig.expire(tables, SIGNAL_NOW).select("created_at", "ttl_seconds", F.col("kind").alias("type"))


@register(f"""
select c.database, c.schema, c.tbl, max(created_at) as requested_at, count(distinct id) as requests
from {text(rel.SIGNAL_CATALOG)} c
join {NAMING} l on l.collection = c.schema || '.' || c.tbl and l.database = c.database
group by c.database, c.schema, c.tbl""")
def snapshot_requests(spark, sf_dir):
    return sig.snapshot_requests(signal_log(spark, sf_dir), relation(spark, sf_dir, rel.SIGNAL_CATALOG))


@register(f"""
with puts as (select database, schema, tbl, epoch_us(created_at) as s,
                     case when ttl_seconds > 0 then epoch_us(created_at) + ttl_seconds::bigint * 24 * 1000000 end as e
              from {text(rel.SIGNAL_TABLES)} t),
     turns as (select *, lead(s) over (partition by database, schema, tbl order by s, e nulls first) as following from puts)
select database, schema, tbl, 'd' as op, e as lsn, make_timestamp(e) as expired_at
from turns where e <= (select max(s) from puts) and (following is null or e < following)""")
def expiry_stream(spark, sf_dir):
    """Deletes of entries whose time to live runs out, from the stream that puts them; the last put decides."""
    puts = spark.sql(rel.SIGNAL_TABLES, events=event_stream(spark, sf_dir))
    target = KeyedTarget(workspace(spark, "entries"), TABLE, ORDER, buckets=16)
    path = workspace(spark, "expiry")
    stream_expirations(puts, target, path, "created_at", F.col("ttl_seconds") * 24).awaitTermination()
    ended = expirations(spark, path, TABLE)
    return ended.select(*TABLE, "op", "lsn", F.col("ts").cast("timestamp_ntz").alias("expired_at"))
