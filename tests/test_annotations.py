from __future__ import annotations

import json

import pytest

from driftline.functions.annotations import parse_annotations


def expected(comment):
    """The annotation by Python's own JSON reading and truthiness."""
    if comment is None or not comment.strip():
        return None
    try:
        data = json.loads(comment)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    boot = data.get("bootstrap", {})
    if not isinstance(boot, dict):
        return None
    target = boot.get("bq", "")
    parts = ("" if target is None else str(target)).strip().split(".")
    return (bool(boot.get("enabled", False)), parts[0] or None, (parts[1] or None) if len(parts) > 1 else None)


ENABLED = ["true", "false", '"false"', '""', '" "', "0", "0.0", "-0", "0e3", "1", "-2.5", "null", "[]", "[null]", "{}",
           '{"a":1}', "[0]", '"0"']
TARGETS = ['"d.t"', '" a.b.c "', '"nodot"', '".t"', '"d."', '""', "null", "5", "1.5", "true", '"\\t d . t \\n"', '"a..b"']

COMMENTS = (
    [f'{{"bootstrap":{{"enabled":{e},"bq":"d.t"}}}}' for e in ENABLED]
    + [f'{{"bootstrap":{{"enabled":true,"bq":{t}}}}}' for t in TARGETS]
    + [None, "", "   ", "\n\t", "no json", "[1]", "7", '"text"', "null", "true", "{}", '{"other":1}', '{"bootstrap":{}}',
       '{"bootstrap":null}', '{"bootstrap":7}', '{"bootstrap":[]}', '{"bootstrap":"x"}', '{"bootstrap":{"enabled":true}',
       ' {"bootstrap":{"enabled":true}} ', '{"Bootstrap":{"enabled":true}}']
)


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame(list(enumerate(COMMENTS)), "i int, comment string")
    return {r.i: r.annotation for r in parse_annotations(rows).collect()}


@pytest.mark.parametrize("i", range(len(COMMENTS)), ids=[repr(c) for c in COMMENTS])
def test_comment(i, parsed):
    got = parsed[i]
    assert (None if got is None else tuple(got)) == expected(COMMENTS[i])


def test_columns_are_kept(spark):
    rows = spark.createDataFrame([(1, "{}")], "id int, remark string")
    assert parse_annotations(rows, "remark").columns == ["id", "remark", "annotation"]
