"""Queries over the change log and over a table with its changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.names import TABLE
from driftline.operators import changes as ch
from driftline.operators import schema as sch
from driftline.operators import signals as sig
from driftline.operators import snapshot as snap
from driftline.operators.ledger import row_counts
from driftline.sessions import workspace
from driftline.sources.changes import read_changes
from driftline.sources.tables import query, save_bucketed, scan
from driftline.streaming.apply import load_snapshot, stream_apply
from driftline.streaming.batch import append, backfill, current, replace_all
from driftline.streaming.quarantine import quarantine as split_bad
from driftline.streaming.resnapshot import request_chunks, resnapshot
from driftline.streaming.target import KeyedTarget
from workloads import relations as rel
from workloads.registry import register
from workloads.relations import relation, text

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

LATEST_CHANGE = f"""
select * from {text(rel.CHANGES)} c
qualify row_number() over (partition by user_id order by lsn desc) = 1"""

LATEST_STATE = f"select * from ({LATEST_CHANGE}) l where op <> 'd'"


def envelopes(spark, sf_dir):
    """The change log as keyed envelopes; a delete has no image."""
    image = F.struct("event_type", "value", "props")
    return relation(spark, sf_dir, rel.CHANGES).select(
        F.struct("user_id").alias("key"), "op", "lsn", "ts", F.when(F.col("op") != "d", image).alias("after")
    )


@register(LATEST_STATE)
def cdc_latest_state(spark, sf_dir):
    log = ch.unwrap(envelopes(spark, sf_dir))
    latest = ch.latest_per_key(log, ["user_id"], ["lsn"])
    return ch.drop_deleted(latest).select("user_id", "lsn", "ts", "op", "event_type", "value", "props")


@register(f"""
select user_id, op, lsn, ts, case when op <> 'd' then event_type end as event_type,
       case when op <> 'd' then value end as value, case when op <> 'd' then props end as props
from {text(rel.CHANGES)} c""")
def unwrap(spark, sf_dir):
    return ch.unwrap(envelopes(spark, sf_dir))


@register(f"select user_id, lsn, ts, op, event_type, value from {text(rel.CHANGES)} c")
def exclude_columns(spark, sf_dir):
    return ch.exclude_columns(relation(spark, sf_dir, rel.CHANGES), ["public.events.props"], "public.events")


@register(f"select user_id as id_user_id, lsn, op, event_type, value from {text(rel.CHANGES)} c")
def key_struct(spark, sf_dir):
    nested = ch.nest_key(relation(spark, sf_dir, rel.CHANGES), ["user_id"])
    return nested.select(F.col("id.user_id").alias("id_user_id"), "lsn", "op", "event_type", "value")


@register(f"select user_id as id, lsn, op, event_type, value from {text(rel.CHANGES)} c")
def key_flatten(spark, sf_dir):
    log = relation(spark, sf_dir, rel.CHANGES).withColumnRenamed("user_id", "id")
    return ch.flatten_key(ch.nest_key(log, ["id"])).select("id", "lsn", "op", "event_type", "value")


@register("""
select event_id as id, ts, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as detail,
       '{"k":' || (props->>'$.k') || '}' as props
from events""")
def normalise_values(spark, sf_dir):
    events = scan(spark, f"{sf_dir}/events.parquet")
    rows = events.select(
        F.struct(F.col("event_id").alias("id")).alias("id"),
        "ts",
        F.struct("event_type", "user_id").alias("detail"),
        F.from_json("props", "map<string,bigint>").alias("props"),
    )
    return ch.normalise(rows, {"detail": "jsonb", "props": "text"})


LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


@register(f"""
select * from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber
                           order by {", ".join(c + " desc" for c in LINE_ORDER)}) = 1""")
def latest_per_key(spark, sf_dir):
    return ch.latest_per_key(scan(spark, f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


@register(f"""
select * from {text(rel.CHANGES)} c
where user_id not in (select user_id from ({LATEST_CHANGE}) l where op = 'd')""")
def drop_deleted(spark, sf_dir):
    """Every change of the keys that are still alive."""
    log = relation(spark, sf_dir, rel.CHANGES)
    alive = ch.drop_deleted(ch.latest_per_key(log.select("user_id", "op", "lsn"), ["user_id"], ["lsn"]))
    return log.join(alive.select("user_id"), "user_id", "left_semi")


MERGED = f"""
select * from (select * from {text(rel.ORDER_STATE)} s union all select * from {text(rel.ORDER_CHANGES)} c) u
qualify row_number() over (partition by o_orderkey order by lsn desc) = 1"""


@register(f"select * from ({MERGED}) m where op <> 'd'")
def upsert_delete_apply(spark, sf_dir):
    state = relation(spark, sf_dir, rel.ORDER_STATE)
    return ch.drop_deleted(
        ch.apply_changes(state, relation(spark, sf_dir, rel.ORDER_CHANGES), ["o_orderkey"], ["lsn"])
    )


@register(f"select * from ({MERGED}) m where op <> 'd'")
def bucketed_apply(spark, sf_dir):
    """The same on a state that lies in buckets by its key, and stays there."""
    path = workspace(spark, "bucketed")
    state = save_bucketed(relation(spark, sf_dir, rel.ORDER_STATE), f"state_{path.rpartition('-')[2]}", path, ["o_orderkey"], 8)
    changes = relation(spark, sf_dir, rel.ORDER_CHANGES)
    return ch.drop_deleted(ch.apply_changes(state, changes, ["o_orderkey"], ["lsn"], whole_keys=True))


@register(f"select * from ({MERGED}) m where op <> 'd'")
def snapshot_stream_handoff(spark, sf_dir):
    rows = scan(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    handed = snap.handoff(rows, relation(spark, sf_dir, rel.ORDER_CHANGES), ["o_orderkey"])
    return handed.select("o_orderkey", "op", "lsn", "o_custkey", "o_orderstatus", "o_totalprice")


@register("""
select ch as chunk, min(k) as lo, max(k) as hi, count(*) as n
from (select o_orderkey as k, (row_number() over (order by o_orderkey) - 1) // 1000 as ch from orders) x group by ch""")
def snapshot_chunks(spark, sf_dir):
    return snap.snapshot_plan(scan(spark, f"{sf_dir}/orders.parquet"), "o_orderkey", 1000)


@register("""
select ch as chunk, min(k).o as lo_order, min(k).l as lo_line, max(k).o as hi_order, max(k).l as hi_line, count(*) as n
from (select {'o': l_orderkey, 'l': l_linenumber} as k,
             (row_number() over (order by l_orderkey, l_linenumber) - 1) // 5000 as ch from lineitem) x group by ch""")
def snapshot_chunks_composite(spark, sf_dir):
    plan = snap.snapshot_plan(scan(spark, f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], 5000)
    return plan.select(
        "chunk",
        F.col("lo.l_orderkey").alias("lo_order"),
        F.col("lo.l_linenumber").alias("lo_line"),
        F.col("hi.l_orderkey").alias("hi_order"),
        F.col("hi.l_linenumber").alias("hi_line"),
        "n",
    )


@register("select * from orders")
def full_scan(spark, sf_dir):
    return scan(spark, f"{sf_dir}/orders.parquet")


@register("""
select o_orderstatus, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint))::bigint as cents
from orders where o_orderdate >= timestamp '1997-01-01' group by o_orderstatus""")
def sql_query(spark, sf_dir):
    return query(
        spark,
        """select o_orderstatus, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents
           from {orders} where o_orderdate >= cast(:since as timestamp_ntz) group by o_orderstatus""",
        {"since": "1997-01-01"},
        orders=scan(spark, f"{sf_dir}/orders.parquet"),
    )


def event_stream(spark, sf_dir):
    return read_changes(spark, f"{sf_dir}/events.parquet*", EVENTS_SCHEMA)


def change_stream(spark, sf_dir):
    return spark.sql(rel.CHANGES, events=event_stream(spark, sf_dir))


def landed(spark, stream, name):
    """What an append-only stream gives for the data that is there."""
    path = workspace(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@register(f"select * from {text(rel.CHANGES)} c")
def cdc_stream_source(spark, sf_dir):
    """The change stream from the earliest record on, landed as it comes."""
    return landed(spark, change_stream(spark, sf_dir), "landing")


@register(LATEST_STATE)
def merge_cadence(spark, sf_dir):
    """The flagship result through the streaming target."""
    target = KeyedTarget(workspace(spark, "target"), ["user_id"], buckets=16)
    stream_apply(change_stream(spark, sf_dir), target, every=None).awaitTermination()
    return target.read(spark)


@register(f"select * from ({MERGED}) m where op <> 'd'")
def target_merge(spark, sf_dir):
    """A snapshot merged into buckets, then changes that are still buffered when the table is read."""
    target = KeyedTarget(workspace(spark, "target"), ["o_orderkey"], buckets=16)
    target.buffer(relation(spark, sf_dir, rel.ORDER_STATE), 0)
    target.merge(spark)
    target.buffer(relation(spark, sf_dir, rel.ORDER_CHANGES), 1)
    return target.read(spark)


@register(f"select * from ({MERGED}) m where op <> 'd'")
def snapshot_then_stream(spark, sf_dir):
    """Chunks of a snapshot, a stream of changes, and a second snapshot that lags behind it, into one target."""
    target = KeyedTarget(workspace(spark, "target"), ["o_orderkey"], buckets=16)
    orders = scan(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    high = orders.filter("o_totalprice >= 100000")
    load_snapshot(orders.filter("o_totalprice < 100000"), target, "snapshot-1", 0)
    landing = workspace(spark, "landing")
    changes = relation(spark, sf_dir, rel.ORDER_CHANGES)
    changes.repartition(4, "o_orderkey").write.parquet(landing)
    stream = read_changes(spark, landing, changes.schema, max_files=2)
    stream_apply(stream, target, every=None, merge_records=1 << 40).awaitTermination()
    load_snapshot(high, target, "snapshot-1", 1)
    target.merge(spark)
    load_snapshot(high, target, "snapshot-1", 1)
    load_snapshot(orders, target, "snapshot-2", 0)
    return target.read(spark)


FLEET_LOG = f"""
select 'db' || cast(user_id % 25 as varchar) as database, event_type as schema, 'u' || cast(user_id % 7 as varchar) as tbl,
       user_id, op, lsn, value from {text(rel.CHANGES)} c"""

FLEET_STATE = f"""
select * from (select * from ({FLEET_LOG}) f
               qualify row_number() over (partition by database, schema, tbl, user_id order by lsn desc) = 1) l where op <> 'd'"""


def fleet_log(changes):
    return changes.select(
        F.concat(F.lit("db"), (F.col("user_id") % 25).cast("string")).alias("database"),
        F.col("event_type").alias("schema"),
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("tbl"),
        "user_id", "op", "lsn", "value",
    )


def fleet_target(spark, sf_dir):
    """One mixed stream applied to the tables of a fleet: one target, whose key tells the table."""
    target = KeyedTarget(workspace(spark, "fleet"), [*TABLE, "user_id"], buckets=16, count_by=TABLE)
    stream_apply(fleet_log(change_stream(spark, sf_dir)), target, every=None).awaitTermination()
    return target


@register(FLEET_STATE)
def fleet_apply(spark, sf_dir):
    return fleet_target(spark, sf_dir).read(spark)


@register(f"select database, schema, tbl, count(*) as n from ({FLEET_STATE}) f group by all")
def fleet_counts(spark, sf_dir):
    """The rows of every table of a fleet, from what the merges counted."""
    return fleet_target(spark, sf_dir).counts(spark)


# Tables of users by hash, with their whole histories. What the target missed: the changes of the second quarter.
USER_LOG = f"""
select 'db' || cast(user_id % 5 as varchar) as database, 's' || cast(user_id % 3 as varchar) as schema,
       'u' || cast(user_id % 7 as varchar) as tbl, user_id, op, lsn, event_type, value from {text(rel.CHANGES)} c"""

ASKED = "schema = 's1' and database <> 'db4'"

REPAIRED = f"""
select database, schema, tbl, user_id, event_type, value from (
    select * from ({USER_LOG}) u, (select max(event_id) as last from events) m
    where ({ASKED}) or lsn <= last // 4 or lsn > last // 2
    qualify row_number() over (partition by user_id order by lsn desc) = 1) l where op <> 'd'"""


def user_log(changes):
    numbered = lambda letter, n: F.concat(F.lit(letter), (F.col("user_id") % n).cast("string"))
    return changes.select(
        numbered("db", 5).alias("database"), numbered("s", 3).alias("schema"), numbered("u", 7).alias("tbl"),
        "user_id", "op", "lsn", "event_type", "value",
    )


def state_at(log, position):
    known = ch.latest_per_key(log.filter(F.col("lsn") <= position), [*TABLE, "user_id"], ["lsn"])
    return ch.drop_deleted(known).drop("op", "lsn")


def snapshot_signals(log):
    """Signals that ask for tables again, as requests."""
    tables = log.select(*TABLE).distinct()
    raised = tables.filter(ASKED).withColumn("created_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return sig.snapshot_requests(sig.signals_for(raised), tables)


@register(REPAIRED)
def resnapshot_live(spark, sf_dir):
    """Tables that missed a part of their changes, read again by request while the stream and the source move on."""
    log = user_log(relation(spark, sf_dir, rel.CHANGES))
    last = log.agg(F.max("lsn")).first()[0]
    target = KeyedTarget(workspace(spark, "repaired"), [*TABLE, "user_id"], buckets=16)
    load_snapshot(state_at(log, last // 4), target, "initial")
    landing, at = workspace(spark, "landing"), [last // 2]

    def advance():
        """The source moves on by an eighth of the log, and the stream follows it."""
        if at[0] == last:
            return
        before, at[0] = at[0], min(last, at[0] + last // 8 + 1)
        log.filter((F.col("lsn") > before) & (F.col("lsn") <= at[0])).write.mode("append").parquet(landing)
        stream_apply(read_changes(spark, landing, log.schema), target, every=None, merge_records=1 << 40, merge_batches=3).awaitTermination()

    def source():
        """Rows are read some time after the mark before them, and the stream may be ahead of them by then."""
        advance()
        return state_at(log, at[0])

    resnapshot(snapshot_signals(log), source, lambda: at[0], target, "again", chunk_size=20, chunks_per_window=8)
    while at[0] < last:
        advance()
    return target.read(spark).select(*TABLE, "user_id", "event_type", "value")


@register(f"""
select database, schema, tbl, chunk, min(user_id) as lo, max(user_id) as hi, count(*) as n from (
    select *, (row_number() over (order by database, schema, tbl, user_id) - 1) // 20 as chunk from (
        select distinct database, schema, tbl, user_id from ({USER_LOG}) u where {ASKED}) k) c
group by all""")
def resnapshot_chunks(spark, sf_dir):
    """The chunks of all requested tables of a fleet, from their signals."""
    log = user_log(relation(spark, sf_dir, rel.CHANGES))
    rows = log.select(*TABLE, "user_id").distinct()
    plan = request_chunks(snapshot_signals(log), rows, ["user_id"], 20)
    return plan.select(*TABLE, "chunk", F.col("lo.user_id").alias("lo"), F.col("hi.user_id").alias("hi"), "n")


CORRECTED = """
select o_orderkey, cast(o_totalprice as decimal(12,2)) as amount, o_orderstatus from orders where o_orderstatus <> 'F'
union all select o_orderkey, cast(o_custkey % 100 as decimal(12,2)), null from orders where o_orderstatus = 'F'"""


@register(f"select o_orderkey, amount::double as amount, o_orderstatus from ({CORRECTED}) c")
def drift_of_numbers(spark, sf_dir):
    """Batches whose amounts are decimals, or integers, and whose keys are wider than the table's."""
    orders = scan(spark, f"{sf_dir}/orders.parquet")
    target = KeyedTarget(workspace(spark, "target"), ["o_orderkey"], buckets=16)
    head = ["o_orderkey", "'u' as op"]
    target.buffer(orders.selectExpr(*head, "0L as lsn", "o_custkey as amount", "o_orderstatus"), 0)
    target.merge(spark)
    wide = "cast(o_orderkey as double) as o_orderkey"
    target.buffer(orders.filter("o_orderstatus <> 'F'").selectExpr(wide, "'u' as op", "1L as lsn", "cast(o_totalprice as decimal(12,2)) as amount", "o_orderstatus"), 1)
    target.buffer(orders.filter("o_orderstatus = 'F'").selectExpr(*head, "1L as lsn", "cast(o_custkey % 100 as int) as amount"), 2)
    target.merge(spark)
    return target.read(spark).select("o_orderkey", F.col("amount").cast("double").alias("amount"), "o_orderstatus")


@register(f"""
select event_id, cast(body->>'$.k' as bigint) as k, cast(null as varchar) as bad_text
from (select * from {text(rel.RAW_RECORDS)} r where json_valid(body)) g
union all
select event_id, null, body from {text(rel.RAW_RECORDS)} r where not json_valid(body)""")
def quarantine(spark, sf_dir):
    schema = T.StructType.fromDDL("k bigint")
    good, bad = split_bad(relation(spark, sf_dir, rel.RAW_RECORDS), schema, "body")
    return good.withColumn("bad_text", F.lit(None).cast("string")).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.col("_corrupt").alias("bad_text"))
    )


@register("select o_orderkey, o_custkey, o_totalprice from orders")
def append_batch(spark, sf_dir):
    """Two appends with different column order, and an empty one."""
    orders = scan(spark, f"{sf_dir}/orders.parquet")
    path, columns = workspace(spark, "append"), ["o_orderkey", "o_custkey", "o_totalprice"]
    append(orders.filter("o_orderstatus = 'F'"), path, columns)
    append(orders.filter("o_orderstatus <> 'F'").select(*reversed(orders.columns)), path, columns)
    append(orders.filter("o_orderkey < 0"), path, columns)
    return scan(spark, path)


@register(
    "select o_orderkey, o_custkey, o_totalprice * 2 as o_totalprice from orders where o_orderstatus <> 'F'",
    name="replace_all",
)
def replace_rows(spark, sf_dir):
    """Every row replaced by a load that reads the table it replaces."""
    path = workspace(spark, "replace")
    replace_all(scan(spark, f"{sf_dir}/orders.parquet"), path)
    replace_all(
        current(spark, path)
        .filter("o_orderstatus <> 'F'")
        .select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice")),
        path,
    )
    return current(spark, path)


@register("""
select o_orderkey as id, o_custkey, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' as detail
from orders""")
def reverse_backfill(spark, sf_dir):
    """A source loaded back from its target, where the key is a record and a JSON column too."""
    path = workspace(spark, "backfill")
    orders = scan(spark, f"{sf_dir}/orders.parquet")
    replace_all(orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), path)
    detail = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    target = orders.select(
        detail.alias("detail"), "o_custkey", F.struct(F.col("o_orderkey").alias("id")).alias("id"), "o_orderdate"
    )
    backfill(target, path, {"detail": "jsonb"}, "id, o_custkey, detail")
    return current(spark, path)


EVOLVED = f"""
select o_orderkey, cast(o_custkey as bigint) as o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       cast(reference as varchar) as reference, cast(null as varchar) as o_orderpriority
from {text(rel.OLD_BATCH)} a
union all
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, reference, o_orderpriority
from {text(rel.NEW_BATCH)} b"""


@register(EVOLVED)
def schema_unionise(spark, sf_dir):
    return sch.evolve(relation(spark, sf_dir, rel.OLD_BATCH), relation(spark, sf_dir, rel.NEW_BATCH))


@register(f"""
select o_orderkey, coalesce(o_orderpriority, 'none') as o_orderpriority from ({EVOLVED}) e
union all select o_orderkey, null from {text(rel.OLD_BATCH)} a""")
def relax_required(spark, sf_dir):
    """A column that was required takes rows that lack it."""
    everything = schema_unionise(spark, sf_dir).select(
        "o_orderkey", F.coalesce("o_orderpriority", F.lit("none")).alias("o_orderpriority")
    )
    lacking = relation(spark, sf_dir, rel.OLD_BATCH).select("o_orderkey")
    return sch.relaxed(everything).unionByName(lacking, allowMissingColumns=True)


@register("select o_orderdate, o_orderkey, o_totalprice from orders")
def column_order(spark, sf_dir):
    return sch.ordered(scan(spark, f"{sf_dir}/orders.parquet"), "o_orderdate, o_orderkey,o_totalprice")


COUNTED = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@register(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in COUNTED))
def row_count(spark, sf_dir):
    return row_counts({t: scan(spark, f"{sf_dir}/{t}.parquet") for t in COUNTED})
