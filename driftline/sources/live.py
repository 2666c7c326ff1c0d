"""The catalog relations of the tables that a Spark session knows.

The session's catalog has the part of the database, its databases that of the schemas. Comments are those of
``COMMENT`` clauses. Spark's own tables know no keys: a table names its primary key by the property
``primary_key``, as columns in order, set apart by commas.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

KEY_PROPERTY = "primary_key"


class Relations(NamedTuple):
    """What discovery reads, as ``operators.catalog`` names it."""

    databases: DataFrame
    tables: DataFrame
    classes: DataFrame
    namespaces: DataFrame
    columns: DataFrame
    constraints: DataFrame
    key_columns: DataFrame


def _described(spark: SparkSession, schemas: Sequence[str]) -> Iterator[tuple[str, str, dict]]:
    """Schema, name and description of every table; one that goes away meanwhile is left out."""
    for schema in schemas:
        for t in spark.catalog.listTables(schema):
            if t.isTemporary:
                continue
            name = ".".join("`" + part.replace("`", "``") + "`" for part in (schema, t.name))
            try:
                text = spark.sql(f"describe table extended {name} as json").first()[0]
            except AnalysisException as e:
                if e.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
                    raise
                continue
            yield schema, t.name, json.loads(text)


def relations(spark: SparkSession, schemas: Sequence[str] | None = None) -> Relations:
    """The session's tables, of some databases or of all, as they are now; views are tables of another type.

    The catalog answers on the driver, one table at a time; what comes of it is as large as the catalog.
    """
    catalog = spark.catalog.currentCatalog()
    wanted = list(schemas) if schemas is not None else [d.name for d in spark.catalog.listDatabases()]
    tables, classes, columns, constraints, keys = [], [], [], [], []
    for schema, name, about in _described(spark, wanted):
        tables.append((catalog, schema, name, "VIEW" if "VIEW" in about.get("type", "") else "BASE TABLE"))
        classes.append((catalog, schema, name, about.get("comment")))
        for i, c in enumerate(about["columns"], 1):
            columns.append((catalog, schema, name, c["name"], _name(c["type"]), i))
        key = (about.get("table_properties") or {}).get(KEY_PROPERTY)
        if key:
            constraints.append((catalog, schema, name, f"pk_{name}", "PRIMARY KEY"))
            for i, c in enumerate(key.split(","), 1):
                keys.append((catalog, schema, name, f"pk_{name}", c.strip(), i))
    table = "database string, schema string, tbl string"
    make = spark.createDataFrame
    return Relations(
        make([(catalog, False)], "datname string, datistemplate boolean"),
        make(tables, f"{table}, table_type string"),
        make(classes, "database string, namespace_oid string, tbl string, comment string"),
        make([(catalog, s, s) for s in wanted], "database string, namespace_oid string, schema string"),
        make(columns, f"{table}, column_name string, data_type string, ordinal_position int"),
        make(constraints, f"{table}, constraint_name string, constraint_type string"),
        make(keys, f"{table}, constraint_name string, column_name string, ordinal_position int"),
    )


def _name(kind: dict) -> str:
    """The name of a type of a JSON description."""
    name = kind["name"]
    if name in ("array", "map", "struct"):
        inner = {
            "array": lambda: _name(kind["element_type"]),
            "map": lambda: f"{_name(kind['key_type'])},{_name(kind['value_type'])}",
            "struct": lambda: ",".join(f"{f['name']}:{_name(f['type'])}" for f in kind["fields"]),
        }[name]()
        return f"{name}<{inner}>"
    if name == "decimal":
        return f"decimal({kind['precision']},{kind['scale']})"
    if name in ("char", "varchar") and "length" in kind:
        return f"{name}({kind['length']})"
    return name
