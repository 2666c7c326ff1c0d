"""Names and payloads that a table's pipeline goes by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns (database, schema, table) that existing pipelines are addressed by.
SERVER = "yb_{database}_{schema}_{tbl}"
TOPIC = "yb_{database}_{schema}_{tbl}.{schema}.{tbl}"
SOURCE_PIPELINE = "yb-source-{database}-{schema}-{tbl}"
SINK_PIPELINE = "bq-sink-{database}-{tbl}"
LEDGER_KEY = "table_sync:{database}.{schema}.{tbl}:yugabyte_count"
SIGNAL_ID = "snap_{schema}_{tbl}"
COLLECTION = "{schema}.{tbl}"
FULL_NAME = "{database}.{schema}.{tbl}"

TABLE = ("database", "schema", "tbl")


def named(pattern: str) -> Column:
    """The pattern filled in from the identity columns of each row."""
    parts, fields = [], []
    rest = pattern
    while "{" in rest:
        text, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        parts.append(text.replace("%", "%%"))
        fields.append(F.col(field))
    parts.append(rest.replace("%", "%%"))
    return F.format_string("%s".join(parts), *fields)


def ledger_key(prefix: str, namespace: str) -> Column:
    return F.concat(F.lit(f"{prefix}:{namespace}:"), named(LEDGER_KEY))
