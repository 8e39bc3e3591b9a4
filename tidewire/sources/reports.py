"""Reports and checkpoints: CSV, JSON, HTML and plain tables of a result, resumable job states, an audit trail."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(rows: DataFrame, folder: str, title: str, most: int = 2000) -> dict[str, str]:
    """Writes a result as CSV (numbers to six places) and JSON lines, in parallel, and its first `most` rows as one HTML page; returns the paths.

    The rows are ordered by all their columns, so the files don't depend on partitioning. Texts are escaped for the page.
    """
    kinds = dict(rows.dtypes)
    plain = rows.select(
        *[
            F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in rows.columns
        ]
    )
    ordered = plain.orderBy(*plain.columns)
    paths = {"csv": f"{folder}/csv", "json": f"{folder}/json"}
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').csv(paths["csv"])
    ordered.write.mode("overwrite").json(paths["json"])
    head = "".join(f"<th>{html.escape(c)}</th>" for c in plain.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in ordered.limit(most).collect())  # a page of bounded length
    page = f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>'
    paths["html"] = f"{folder}/html"
    rows.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(paths["html"])
    return paths


def flat_methods(results: DataFrame) -> DataFrame:
    """A row for each source and method of probe results (source_id, status, methods map<string, struct<status, items, notes>>, notes); a method's own notes go before the source's."""
    e = results.select("source_id", "status", "notes", F.explode("methods").alias("method", "m"))
    return e.select(
        "source_id",
        "method",
        F.col("m.status").alias("method_status"),
        F.col("m.items").alias("items"),
        F.col("status").alias("technical_status"),
        F.coalesce(F.when(F.col("m.notes") != "", F.col("m.notes")), F.col("notes")).alias("notes")
    )


def save_checkpoint(path: str, job: dict) -> None:
    """Writes a job's state (of the driver: a few numbers and names) at once or not at all, readable by its owner only."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(job, f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)


def load_checkpoint(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def audit(trail: DataFrame, run_id: str, stage: str, counts: dict[str, int], at: str) -> DataFrame:
    """The trail (run_id, stage, at, counts) with one row for a stage of a run; writing a stage again replaces its row."""
    row = trail.sparkSession.createDataFrame([(run_id, stage, at, json.dumps(counts, sort_keys=True))], "run_id string, stage string, at string, counts string")
    return trail.join(row.select("run_id", "stage"), ["run_id", "stage"], "left_anti").unionByName(row)
