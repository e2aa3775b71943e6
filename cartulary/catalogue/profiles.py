"""Game profiles: closed, recursive schemas of card attributes, and their validation.

A schema is a nested dictionary: {"kind": "string"}, "integer" (with "minimum",
0 by default), "boolean", "enum" (with "values"), "array" (with "items",
"unique", "min_items", "max_items") or "object" (with "fields"); "nullable" and
"required" stand beside the kind.  An object may have "when": {"field", "cases":
{value: {"required": [...], "absent": [...], "empty": {field: value}, "least":
{field: items}}}}.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.canon import canonical

#: Levels of nested records.
MOST_DEPTH = 8
RESULT = "value string, warnings array<string>, diagnostics array<string>"


def validate(value: Any, schema: dict, path: str = "$") -> tuple[Any, list[str], list[str]]:
    """The value as the schema admits it, warnings (what was dropped) and diagnostics (what blocks)."""
    warnings: list[str] = []
    bad: list[str] = []
    if value is None:
        if not schema.get("nullable"):
            bad.append(f"null_not_allowed:{path}")
        return None, warnings, bad
    kind = schema["kind"]
    if kind == "string":
        ok = isinstance(value, str) and len(value) >= schema.get("min_length", 0)
    elif kind == "integer":
        ok = isinstance(value, int) and not isinstance(value, bool) and schema.get("minimum", 0) <= value <= 2**53 - 1
    elif kind == "boolean":
        ok = isinstance(value, bool)
    elif kind == "enum":
        ok = isinstance(value, str)
        if ok and value not in schema["values"]:
            return None, [f"unknown_value:{path}"], bad
    elif kind == "array":
        ok = isinstance(value, list)
        if ok:
            made = []
            for i, x in enumerate(value):
                v, w, b = validate(x, schema["items"], f"{path}[{i}]")
                warnings += w
                bad += b
                if not (w and v is None):
                    made.append(v)
            if schema.get("unique"):
                made = [json.loads(x) for x in sorted({canonical(x) for x in made}, key=str.encode)]
            if not schema.get("min_items", 0) <= len(made) <= schema.get("max_items", 1 << 30):
                bad.append(f"wrong_length:{path}")
            value = made
    else:
        ok = isinstance(value, dict)
        if ok:
            fields, made = schema["fields"], {}
            for k in value:
                if k not in fields:
                    warnings.append(f"unknown_field:{path}.{k}")
            for k, sub in fields.items():
                if k in value:
                    v, w, b = validate(value[k], sub, f"{path}.{k}")
                    warnings += w
                    bad += b
                    if not (w and v is None):
                        made[k] = v
                    elif sub.get("required") and not b:  # nothing is left of what must be there
                        bad.append(f"unknown_value:{path}.{k}")
                elif sub.get("required"):
                    bad.append(f"missing_field:{path}.{k}")
            if rule := schema.get("when"):
                case = rule["cases"].get(made.get(rule["field"]), {})
                bad += [f"missing_field:{path}.{k}" for k in case.get("required", []) if k not in made]
                bad += [f"inapplicable_field:{path}.{k}" for k in case.get("absent", []) if k in made]
                bad += [f"inapplicable_field:{path}.{k}" for k, v in case.get("empty", {}).items() if made.get(k) != v]
                bad += [f"wrong_length:{path}.{k}" for k, n in case.get("least", {}).items() if len(made.get(k) or []) < n]
            value = made
    return (value, warnings, bad) if ok else (None, warnings, [*bad, f"wrong_type:{path}"])


def validated(attributes: Column, schema: dict) -> Column:
    """RESULT of JSON texts: the canonical admitted value, warnings, diagnostics."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                v, w, b = validate(None if t is None else json.loads(t), schema)
                rows.append((None if v is None else canonical(v), w, b))
            except ValueError:
                rows.append((None, [], ["not_json:$"]))
        return pd.DataFrame(rows, columns=["value", "warnings", "diagnostics"])

    return run(attributes)


def attribute_filter(schema: dict, attribute: str, raw: str, attributes: Column) -> Column:
    """Equality of an attribute (a dotted path) with a literal that the schema admits; arrays have it as a member."""
    at = schema
    for k in attribute.split("."):
        if at["kind"] != "object" or k not in at["fields"]:
            raise ValueError(f"no attribute {attribute}")
        at = at["fields"][k]
    found = F.get_json_object(attributes, f"$.{attribute}")
    if raw == "null":
        if not at.get("nullable"):
            raise ValueError(f"{attribute} is never null")
        return found.isNull()
    leaf = at["items"] if at["kind"] == "array" else at
    if leaf["kind"] == "object":
        raise ValueError(f"{attribute} is no leaf")
    value: Any = raw
    if leaf["kind"] == "integer":
        value = int(raw)
    elif leaf["kind"] == "boolean":
        if raw not in ("true", "false"):
            raise ValueError("true or false")
        value = raw == "true"
    if validate(value, leaf) != (value, [], []):
        raise ValueError(f"{attribute} has no value {raw}")
    literal = str(raw)
    return F.array_contains(F.from_json(found, "array<string>"), literal) if at["kind"] == "array" else F.coalesce(found == F.lit(literal), F.lit(False))


def leaves(df: DataFrame, keep: Sequence[str], attributes: str, indexes: bool = False, depth: int = MOST_DEPTH, distinct: bool = True) -> DataFrame:
    """keep, attribute, value: the distinct scalar leaves of the JSON records, by dotted path; arrays without indexes unless asked for.

    Records are dealt out by keep first, so several tasks open them, and one keeps
    the leaves of a partition of records, not of a whole file.  Not distinct, a leaf
    has a row for each time it stands in a record, and nothing is kept.

    A value is the JSON text of the leaf.  The records are parsed once, to
    VARIANT; each level is opened by Spark's own functions, scalars staying as
    they are, so the plan is as long as `depth` and holds no Python.  Fails on a
    record that is nested deeper, and on what is no JSON.  Null records, empty
    objects and empty arrays have no leaves.
    """

    def below(path: Column, v: Column) -> Column:
        """The children of an object or an array, else the value itself."""
        dotted = lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))
        numbered = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]")) if indexes else path
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(dotted(e["key"]).alias("attribute"), e["value"].alias("leaf")))
        members = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(numbered(i).alias("attribute"), x.alias("leaf")))
        return F.coalesce(fields, members, F.array(F.struct(path.alias("attribute"), v.alias("leaf"))))

    rows = df.repartition(*keep).where(F.col(attributes).isNotNull()).select(*keep, F.lit("").alias("attribute"), F.parse_json(attributes).alias("leaf"))
    for _ in range(depth):
        rows = rows.select(*keep, F.explode(below(F.col("attribute"), F.col("leaf"))).alias("at")).select(*keep, "at.*")
    nested = F.schema_of_variant("leaf").rlike("^(OBJECT|ARRAY)<")
    deep = F.raise_error(F.concat(F.lit("a record is nested too deep at "), F.col("attribute"))).cast("string")
    found = rows.select(*keep, "attribute", F.when(nested, deep).otherwise(F.to_json("leaf")).alias("value"))
    return found.distinct() if distinct else found


# Keys of records that consumers are not shown.
ADMINISTRATIVE = (
    "provenance", "curated_provenance", "disagreements", "evidence", "evidence_category", "source_lineage", "source_lineages",
    "source_observation_id", "source_observation_ids", "source_observation_pointer", "source_field_pointers", "relationship_evidence",
    "membership_evidence", "locator_evidence", "source_buckets", "source_freshness", "last_successful_checks", "confidence", "confirmation",
    "publisher_confirmation", "source_health", "admission", "admission_status", "legality", "legality_rules", "legality_status", "eligibility",
)


def consumer_content(record: Column) -> Column:
    """The JSON record without administrative keys at any depth, but for what game_data and schema hold."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def strip(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: v if k in ("game_data", "schema") else strip(v) for k, v in x.items() if k not in ADMINISTRATIVE}
            return [strip(y) for y in x] if isinstance(x, list) else x

        return texts.map(lambda t: None if t is None else canonical(strip(json.loads(t))))

    return run(record)
