"""Records: canonical form, digests, guards and rule tables.  Validators return violations; none means valid."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, ASCII only, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null where a text isn't JSON."""

    def one(text):
        try:
            return hashlib.sha256(canonical(json.loads(text)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def blob_id(content: Column) -> Column:
    """The version-control identity of file content: SHA-1 of a header and the bytes."""
    header = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "US-ASCII"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(header, content))


def key_problems(keys: Column, required: list[str], optional: list[str] = ()) -> Column:
    """Missing and unknown keys of a record, sorted, as '-key' and '+key'."""
    need, known = F.array(*[F.lit(k) for k in required]), F.array(*[F.lit(k) for k in [*required, *optional]])
    missing = F.transform(F.array_except(need, keys), lambda k: F.concat(F.lit("-"), k))
    extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("+"), k))
    return F.array_sort(F.concat(missing, extra))


def safe_path(p: Column) -> Column:
    """Relative, without empty, current or parent parts, and without patterns."""
    parts = F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return ~parts & ~p.rlike(r"[*?\[\]\\]")


def hexadecimal(x: Column, digits: int) -> Column:
    return x.rlike(f"^[0-9a-f]{{{digits}}}$")


def aware_timestamp(x: Column) -> Column:
    """P20: null unless the text carries an offset."""
    return F.when(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(x))


def normalised(x: Column) -> Column:
    """Letters and digits, in lower case."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def utility(gap: Column, calls: Column, alternations: Column, dimension: Column) -> Column:
    """P22."""
    return gap / ((1.0 + calls) * (1.0 + alternations) * (1.0 + F.log2(1.0 + dimension)))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that doesn't hold; an unknown outcome is a violation.

    One pass: rules become one array expression, whatever their number.
    """
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def at_least(items: Column, least) -> Column:
    return F.forall(items, lambda x: x >= least)


def schema_rules(schema: dict, fields: dict[str, str], path: str = "") -> dict[str, Column]:
    """Rules for columns from a schema of the kinds const, enum, type, required, minLength, pattern, minimum, items, uniqueItems."""
    types = {"integer": ("tinyint", "smallint", "int", "bigint"), "number": ("tinyint", "smallint", "int", "bigint", "float", "double"), "string": ("string",), "boolean": ("boolean",), "array": ("array",), "null": ()}
    out: dict[str, Column] = {}
    for name in schema.get("required", []):
        out[f"{path}{name}:required"] = F.col(name).isNotNull() if name in fields else F.lit(False)
    if schema.get("additionalProperties", True) is False:
        for name in sorted(set(fields) - set(schema.get("properties", {}))):
            out[f"{path}{name}:unknown"] = F.lit(False)
    for name, s in schema.get("properties", {}).items():
        if name not in fields:
            continue
        c, label = F.col(name), f"{path}{name}"
        when = lambda ok, c=c: c.isNull() | ok
        if "type" in s:
            kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
            fits = any(fields[name].startswith(t) for k in kinds for t in types[k])
            out[f"{label}:type"] = when(F.lit(fits))  # an absent value is a matter of ``required``
        if "const" in s:
            out[f"{label}:const"] = when(c == s["const"])
        if "enum" in s:
            out[f"{label}:enum"] = when(c.isin(s["enum"]))
        if "minLength" in s:
            out[f"{label}:minLength"] = when(F.length(c) >= s["minLength"])
        if "pattern" in s:
            out[f"{label}:pattern"] = when(c.rlike(f"^(?:{s['pattern']})$"))
        if "minimum" in s:
            out[f"{label}:minimum"] = when(c >= s["minimum"])
        if s.get("uniqueItems"):
            out[f"{label}:uniqueItems"] = when(F.size(F.array_distinct(c)) == F.size(c))
        if "items" in s and "minimum" in s["items"]:
            out[f"{label}:items"] = when(at_least(c, s["items"]["minimum"]))
    return out


def projected_differences(public: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Leaves of the public record that the full one lacks or has otherwise; types count."""
    # by merging sorted rows: files of leaves are far smaller than their rows, so by their size the full records would be broadcast
    return public.hint("merge").join(full.hint("merge"), [key, "path", "kind", "value"], "left_anti")


def non_empty(x: Column) -> Column:
    """A text that isn't blank."""
    return F.length(F.trim(x)) > 0


def unique_texts(x: Column) -> Column:
    """At least one, none of them blank, none twice."""
    return (F.size(x) > 0) & F.forall(x, lambda i: F.coalesce(non_empty(i), F.lit(False))) & (F.size(F.array_distinct(x)) == F.size(x))


def in_order(start: Column, finish: Column) -> dict[str, Column]:
    """P20: rules for two texts that must be times with an offset, the second not before the first."""
    a, b = aware_timestamp(start), aware_timestamp(finish)
    return {"start": a.isNotNull(), "finish": b.isNotNull(), "order": a.isNull() | b.isNull() | (b >= a)}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
