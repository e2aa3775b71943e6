"""Curated revisions: reviewed changes of records and relationships, laid over what the sources say.

Each run starts from records without earlier curated values, compares every
revision with the source value that was reviewed, and applies all of a game's
revisions in their pinned order, or none if one of them has met another source
value or has led to a record that its schema doesn't admit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.catalogue.profiles import validate
from cartulary.functions.canon import canonical
from cartulary.operators.lineage import written

_PATCH = "official string, patched string, provenance string, changed array<string>, invalid array<string>"


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _steps(path: str) -> list[str]:
    """The keys of a JSON pointer."""
    if not path.startswith("/"):
        raise ValueError(f"no path to a field: {path}")
    return [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]


def value_at(record: Any, path: str) -> Any:
    """What stands at the path; None where nothing does."""
    for key in _steps(path):
        if isinstance(record, dict):
            record = record.get(key)
        elif isinstance(record, list) and key.isdecimal() and int(key) < len(record):
            record = record[int(key)]
        else:
            return None
    return record


def set_at(record: Any, path: str, value: Any) -> bool:
    """Put the value there; False if the path leads through something that is no object or list."""
    *way, last = _steps(path)
    for key in way:
        if isinstance(record, dict):
            record = record.setdefault(key, {})
        elif isinstance(record, list) and key.isdecimal() and int(key) < len(record):
            record = record[int(key)]
        else:
            return False
    if isinstance(record, dict):
        record[last] = value
    elif isinstance(record, list) and last.isdecimal() and int(last) < len(record):
        record[int(last)] = value
    else:
        return False
    return True


def patched(content: str, provenance: str | None, revisions: list[dict], schema: Mapping | None) -> tuple[str, str, str, list[str], list[str]]:
    """_PATCH of one record: revisions in order, each with id, path, value (JSON) and reviewed, the digest of the source value."""
    official = json.loads(content)
    for one in reversed(json.loads(provenance) if provenance else []):  # the last one has been laid on top
        set_at(official, one["path"], one["source"])
    source = canonical(official)
    changed = [r["id"] for r in revisions if digest(value_at(official, r["path"])) != r["reviewed"]]
    result, trace, invalid = json.loads(source), [], []
    for r in revisions:
        trace.append({"path": r["path"], "revision": r["id"], "source": value_at(official, r["path"])})
        if not set_at(result, r["path"], json.loads(r["value"])):
            invalid.append(f"no_such_path:{r['path']}")
    if schema is not None and revisions and not invalid:
        _, warnings, bad = validate(result, schema)
        invalid += bad + [w for w in warnings if w.startswith("unknown_value") and w not in bad]
    return source, canonical(result), canonical(trace), changed, invalid


def apply_fields(records: DataFrame, revisions: DataFrame, schema: Mapping | None = None) -> DataFrame:
    """game, id, content, provenance, state (official, patched or blocked), problems.

    records: game, id, content (JSON), provenance (JSON list of path, revision
    and source, of earlier runs, in order).  revisions: game, id (the record),
    ordinal, revision, path, value (JSON), reviewed.  Records without revisions
    and provenance don't go through Python.  A game is blocked as a whole: all
    of its records are then official; problems names the revisions of a record
    whose source value has changed, the paths that are not there, and what the
    schema refuses.
    """
    pinned = revisions.groupBy("game", "id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("revision").alias("id"), "path", "value", "reviewed"))).alias("revisions"))
    rows = records.join(written(pinned), ["game", "id"], "left")
    rows = rows.withColumn("revisions", F.coalesce("revisions", F.array().cast(pinned.schema["revisions"].dataType)))
    touched = (F.size("revisions") > 0) | (F.coalesce("provenance", F.lit("[]")) != "[]")

    @F.pandas_udf(_PATCH)
    def patch(content: pd.Series, provenance: pd.Series, own: pd.Series) -> pd.DataFrame:
        found = [patched(c, p, list(r), schema) for c, p, r in zip(content, provenance, own, strict=True)]
        return pd.DataFrame(found, columns=[x.split()[0] for x in _PATCH.split(", ")])

    plain = rows.where(~touched).select("game", "id", F.col("content").alias("official"), F.col("content").alias("patched"), F.lit("[]").alias("provenance"), *[F.array().cast("array<string>").alias(c) for c in ("changed", "invalid")], F.lit(False).alias("own"))
    made = rows.where(touched).withColumn("p", patch("content", "provenance", "revisions")).select("game", "id", "p.*", (F.size("revisions") > 0).alias("own"))
    both = written(plain.unionByName(made))
    problems = F.concat(F.transform("changed", lambda x: F.concat(F.lit("source_changed:"), x)), "invalid")
    # A row for each blocked game.
    blocked = both.where(F.size(problems) > 0).select("game").distinct().withColumn("blocked", F.lit(True))
    out = both.join(F.broadcast(blocked), "game", "left")
    stopped = F.coalesce("blocked", F.lit(False))
    state = F.when(stopped & F.col("own"), "blocked").when(F.col("own"), "patched").otherwise("official")
    done = F.col("own") & ~stopped
    return out.select("game", "id", F.when(done, F.col("patched")).otherwise(F.col("official")).alias("content"), F.when(done, F.col("provenance")).otherwise("[]").alias("provenance"), state.alias("state"), problems.alias("problems"))


def apply_relationships(edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """game, edge_id, observed, curated, conflict.

    edges: game, edge_id, observed, reviewed (present or absent, of an edge that
    an earlier run has curated), category.  revisions: game, edge_id, asserted
    and reviewed (present or absent).  Edges that only curation has made are
    left out first, others go back to what was reviewed; a revision whose
    reviewed presence is another one now is a conflict and blocks its game's.
    """
    official = edges.where("category is null or category <> 'curated'").select("game", "edge_id", F.when(F.col("reviewed").isNotNull(), F.col("reviewed") == "present").otherwise(F.col("observed")).alias("observed"))
    own = revisions.select("game", "edge_id", "asserted", F.col("reviewed").alias("seen"))
    rows = official.join(own, ["game", "edge_id"], "full")
    now = F.when(F.coalesce("observed", F.lit(False)), "present").otherwise("absent")
    rows = written(rows.withColumn("conflict", F.col("asserted").isNotNull() & (F.col("seen") != now)))
    blocked = rows.where("conflict").select("game").distinct().withColumn("blocked", F.lit(True))
    out = rows.join(F.broadcast(blocked), "game", "left").withColumn("curated", F.col("asserted").isNotNull() & F.col("blocked").isNull())
    out = out.where("curated or observed is not null")
    observed = F.when(F.col("curated"), F.col("asserted") == "present").otherwise(F.col("observed"))
    return out.select("game", "edge_id", observed.alias("observed"), "curated", "conflict")
