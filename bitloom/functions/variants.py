"""JSON texts as variants: nested schema rules and leaves, all in the JVM.

Where a text is no JSON (null, malformed, a key twice in one object) it is said so, never dropped.  Numbers are taken by value: one
without a fraction is an integer, however it is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import Stage

TASKS_A_CORE = 3
FOUND = "array<struct<path: string, rule: string>>"


def _map(v: Column) -> Column:
    """An object's members, null for anything else."""
    return v.try_cast("map<string, variant>")


def _list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kind(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object."""

    def name(s: Column) -> Column:
        whole = (s == "BIGINT") | (s.startswith("DECIMAL") & s.endswith(",0)"))
        k = F.when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(whole, "integer")
        number = s.startswith("DECIMAL") | s.startswith("DOUBLE") | s.startswith("FLOAT")
        return k.when(number, "number").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")

    return _bind(F.schema_of_variant(v), name)


def _equals(v: Column, k: Column, value) -> Column:
    if value is None:
        return k == "null"
    if isinstance(value, bool):
        return (k == "boolean") & (v.try_cast("boolean") == value)
    if isinstance(value, (int, float)):
        return k.isin("integer", "number") & (v.try_cast("double") == float(value))
    if isinstance(value, str):
        return (k == "string") & (v.try_cast("string") == value)
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _is(v: Column, k: Column, name: str) -> Column:
    if name == "number":
        return (k == "integer") | ((k == "number") & (F.abs(v.try_cast("double")) < float("inf")))
    return k == name


def broken(v: Column, schema: dict, path: Column) -> Column:
    """(path, rule) of each rule of a nested schema that a variant breaks.

    Kinds of rules: const, enum, type, minLength, pattern (of the whole text), minimum, uniqueItems, required, unknown members where
    additionalProperties is false, and those of properties and items, at any depth of the schema.  Each value is taken out, cast and
    named its kind once, so the work grows with the schema, not with its depth times its rules.
    """
    return _bind(v, lambda v: _bind(F.struct(v.alias("v"), kind(v).alias("kind"), _map(v).alias("members")), lambda n: _broken(n, schema, path)))


def _broken(n: Column, schema: dict, path: Column) -> Column:
    v, k, members, rules = n["v"], n["kind"], n["members"], []
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    if "const" in schema:
        rules.append(("const", _equals(v, k, schema["const"])))
    if "enum" in schema:
        rules.append(("enum", any_of([_equals(v, k, x) for x in schema["enum"]])))
    if "type" in schema:
        rules.append(("type", any_of([_is(v, k, x) for x in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])])))
    if "minLength" in schema:
        rules.append(("minLength", (k != "string") | (F.length(v.try_cast("string")) >= schema["minLength"])))
    if "pattern" in schema:
        rules.append(("pattern", (k != "string") | v.try_cast("string").rlike(rf"\A(?:{schema['pattern']})\z")))
    if "minimum" in schema:
        rules.append(("minimum", ~k.isin("integer", "number") | (v.try_cast("double") >= schema["minimum"])))
    if schema.get("uniqueItems"):
        texts = F.transform(_list(v), lambda x: F.to_json(x))
        rules.append(("uniqueItems", (k != "array") | (F.size(F.array_distinct(texts)) == F.size(texts))))
    said = lambda at, rule: F.struct(at.alias("path"), F.lit(rule).alias("rule"))
    none = F.array().cast(FOUND)
    parts = [F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), said(path, rule)) for rule, ok in rules)))] if rules else []
    names = F.map_keys(members)
    inside = lambda name: F.concat(path, F.lit(f".{name}"))
    if schema.get("required"):
        parts.append(F.array_compact(F.array(*(F.when(~F.array_contains(names, n), said(inside(n), "required")) for n in schema["required"]))))
    for name, inner in schema.get("properties", {}).items():
        parts.append(F.when(F.array_contains(names, name), broken(F.element_at(members, name), inner, inside(name))))
    if schema.get("additionalProperties", True) is False:
        unknown = F.array_except(names, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
        parts.append(F.transform(unknown, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("unknown").alias("rule"))))
    if "items" in schema:
        parts.append(F.flatten(F.transform(_list(v), lambda x, i: broken(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    return F.concat(*(F.coalesce(p.cast(FOUND), none) for p in parts)) if parts else none


def violations(documents: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """(key, path, rule) for JSON texts against a nested schema; a text that isn't JSON breaks the rule 'json'."""
    tasks = TASKS_A_CORE * documents.sparkSession.sparkContext.defaultParallelism  # small files, but much work a row
    parsed = documents.select(key, text).repartition(tasks).select(key, F.try_parse_json(F.col(text)).alias("__v"))
    found = F.when(F.col("__v").isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(FOUND))
    found = found.otherwise(broken(F.col("__v"), schema, F.lit("$")))
    return parsed.select(key, F.explode(found).alias("__x")).select(key, "__x.path", "__x.rule")


def leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) for each leaf of JSON texts, empty objects and lists included; a text that isn't JSON is one leaf 'invalid'.

    One level of all documents opens at a time, until no object or list is left.
    """
    stage = Stage(documents.sparkSession, "leaves")
    level, out = documents.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v")), None
    while True:
        k = F.when(F.col("v").isNull(), "invalid").otherwise(kind(F.col("v")))
        filled = F.coalesce(F.size(_map(F.col("v"))) > 0, F.size(_list(F.col("v"))) > 0, F.lit(False))
        level = stage.write(level.select("key", "path", "v", k.alias("kind"), filled.alias("filled")), "level")
        done = level.where("not filled").select(F.col("key").alias(key), "path", "kind", F.to_json("v").alias("value"))
        out = done if out is None else out.unionByName(done)
        inner = level.where("filled")
        if inner.isEmpty():
            return out
        child = F.when(F.col("name").isNotNull(), F.concat("path", F.lit("."), "name")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        opened = inner.sparkSession.sql("SELECT d.key, d.path, x.pos, x.key AS name, x.value AS v FROM {d} AS d, LATERAL variant_explode(d.v) AS x", d=inner)
        level = opened.select("key", child.alias("path"), "v")


def canonical(text: Column) -> Column:
    """A JSON text with members sorted, no spaces, and numbers without needless digits; null where it is no JSON.

    Letters stay as they are (UTF-8), so for ASCII texts with whole numbers this is the canonical form of ``records.canonical``.
    """
    return F.to_json(F.try_parse_json(text))
