"""Nested schema rules and leaves of JSON texts, against a walk over the parsed values."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from bitloom.functions import records, variants
from bitloom.functions.records import canonical

JSON_KINDS = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf"),
}


def json_rules(schema: dict):
    """A function (value, path) -> violations (path, rule)."""
    own = []
    if "const" in schema:
        own.append(("const", lambda x: x == schema["const"]))
    if "enum" in schema:
        own.append(("enum", lambda x: x in schema["enum"]))
    if "type" in schema:
        kinds = [JSON_KINDS[k] for k in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])]
        own.append(("type", lambda x: any(k(x) for k in kinds)))
    if "minLength" in schema:
        own.append(("minLength", lambda x: not isinstance(x, str) or len(x) >= schema["minLength"]))
    if "pattern" in schema:
        whole = re.compile(schema["pattern"])
        own.append(("pattern", lambda x: not isinstance(x, str) or whole.fullmatch(x) is not None))
    if "minimum" in schema:
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        own.append(("minimum", lambda x: not number(x) or x >= schema["minimum"]))
    if schema.get("uniqueItems"):
        own.append(("uniqueItems", lambda x: not isinstance(x, list) or len({canonical(i) for i in x}) == len(x)))
    inner = {k: json_rules(s) for k, s in schema.get("properties", {}).items()}
    items = json_rules(schema["items"]) if "items" in schema else None
    closed = schema.get("additionalProperties", True) is False

    def check(x, path: str = "$"):
        for rule, holds in own:
            if not holds(x):
                yield path, rule
        if isinstance(x, dict):
            for k in schema.get("required", ()):
                if k not in x:
                    yield f"{path}.{k}", "required"
            for k, v in x.items():
                if k in inner:
                    yield from inner[k](v, f"{path}.{k}")
                elif closed:
                    yield f"{path}.{k}", "unknown"
        elif isinstance(x, list) and items:
            for i, v in enumerate(x):
                yield from items(v, f"{path}[{i}]")

    return check



SCHEMA = {
    "type": "object",
    "required": ["a"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "array", "uniqueItems": True, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 3}, "s": {"type": "string", "pattern": "[a-z]+", "minLength": 2}}}},
        "b": {"const": 5},
        "c": {"enum": ["x", None, 2.5, [1, {"y": 2}]]},
        "d": {"type": ["number", "null"]},
        "e": {"type": ["boolean", "array"], "items": {"type": "array", "items": {"minimum": 0}}},
    },
}


def found(spark, texts, schema=SCHEMA):
    out = {i: [] for i in range(len(texts))}
    for r in variants.violations(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", schema).collect():
        out[r["k"]].append((r["path"], r["rule"]))
    return [sorted(out[i]) for i in range(len(texts))]


CASES = [
    ({"a": [{"k": 3, "s": "ab"}, {"k": 4}], "b": 5, "c": None, "d": 1.5}, []),
    ([], [("$", "type")]),
    ({}, [("$.a", "required")]),
    ({"a": [], "z": 1}, [("$.z", "unknown")]),
    ({"a": [{"k": 2}, {}]}, [("$.a[0].k", "minimum"), ("$.a[1].k", "required")]),
    ({"a": [{"k": True}]}, [("$.a[0].k", "type")]),
    ({"a": [{"k": 3, "s": "A"}]}, [("$.a[0].s", "minLength"), ("$.a[0].s", "pattern")]),
    ({"a": [{"k": 3, "s": "ab\\n"}]}, [("$.a[0].s", "pattern")]),
    ({"a": [{"k": 3}, {"k": 3}]}, [("$.a", "uniqueItems")]),
    ({"a": [], "b": 6, "c": "y", "d": "1"}, [("$.b", "const"), ("$.c", "enum"), ("$.d", "type")]),
    ({"a": [], "c": [1, {"y": 2}], "e": [[1, -1], 5, []]}, [("$.e[0][1]", "minimum"), ("$.e[1]", "type")]),
    ({"a": [], "d": None, "e": True}, []),
]


def test_each_rule_and_its_path(spark):
    assert found(spark, [json.dumps(x) for x, _ in CASES]) == [sorted(w) for _, w in CASES]
    assert found(spark, [None, "", "{", '{"a": [], "a": []}', "NaN", '{"a": [], "d": 1e400}']) == [[("$", "json")]] * 5 + [[("$.d", "type")]]
    assert found(spark, ["1", "null"], {}) == [[], []]


@pytest.mark.parametrize("seed", range(2))
def test_rules_against_a_walk(spark, seed):
    rng = random.Random(seed)

    def value(depth):
        pick = rng.randint(0, 9 if depth else 6)
        if pick > 6:
            return {rng.choice("abcdeksz"): value(depth - 1) for _ in range(rng.randint(0, 4))} if pick > 7 else [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, False, 5, 3, -2, 2.5, "x", "ab", "A", "é", ""])

    cases = [{rng.choice("abcdez"): value(3) for _ in range(rng.randint(0, 5))} for _ in range(300)]
    check = json_rules(SCHEMA)
    assert found(spark, [json.dumps(x) for x in cases]) == [sorted(check(x)) for x in cases]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "{}")], "k int, t string")
    for out in (variants.violations(df, "k", "t", SCHEMA), variants.leaves(df, "k", "t")):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_leaves(spark):
    texts = ['{"b": {"x": [1, [], {}, "é"]}, "a": null}', "7", "nope", None, "[[true]]"]
    got = sorted(tuple(r) for r in variants.leaves(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect())
    assert [r for r in got if r[0] == 0] == [(0, "$.a", "null", "null"), (0, "$.b.x[0]", "integer", "1"), (0, "$.b.x[1]", "array", "[]"), (0, "$.b.x[2]", "object", "{}"), (0, "$.b.x[3]", "string", '"é"')]
    assert got[5:] == [(1, "$", "integer", "7"), (2, "$", "invalid", None), (3, "$", "invalid", None), (4, "$[0][0]", "boolean", "true")]


def test_canonical_form(spark):
    rng = random.Random(3)

    def value(depth):
        return rng.choice([None, True, 5, -17, "a b", ""]) if not depth or rng.random() < 0.4 else ({rng.choice("zyxabc"): value(depth - 1) for _ in range(3)} if rng.random() < 0.6 else [value(depth - 1) for _ in range(rng.randint(0, 3))])

    values = [value(4) for _ in range(60)]
    texts = [json.dumps(v, indent=rng.choice([None, 1])) for v in values] + ["{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", variants.canonical(F.col("t")).alias("c"))
    assert [r["c"] for r in df.orderBy("i").collect()] == [canonical(v) for v in values] + [None, None]


def test_full_records_are_not_broadcast(spark):
    """By the size of its files a table of leaves looks small, whatever its rows need in memory."""
    full = variants.leaves(spark.createDataFrame([(i, f'{{"a": {i}}}') for i in range(50)], "k int, t string"), "k", "t")
    public = variants.leaves(spark.createDataFrame([(i, f'{{"a": {i + (i % 10 == 0)}}}') for i in range(50)], "k int, t string"), "k", "t")
    out = records.projected_differences(public, full, "k")
    assert sorted(r["k"] for r in out.collect()) == [0, 10, 20, 30, 40]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_is_many_tasks_and_values_are_opened_once(spark):
    out = variants.violations(spark.createDataFrame([(i, "{}") for i in range(99)], "k int, t string").coalesce(1), "k", "t", SCHEMA)
    assert out.rdd.getNumPartitions() > 1
    assert out.count() == 99
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant(") <= 11  # values that the schema names, at any depth
