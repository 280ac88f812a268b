"""Sinks (SNK-01 .. SNK-08): parquet, CSV, JSON metadata and a plain HTML report of small tables."""

from __future__ import annotations

import base64
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, parquet: str | None = None, csv: str | None = None, partition_by: list[str] | None = None) -> None:
    """SNK-01 .. SNK-03: parquet in as many files as there are tasks; CSV as one file, for summaries."""
    if parquet:
        df.write.mode("overwrite").parquet(parquet, partitionBy=partition_by)
    if csv:
        df.coalesce(1).write.mode("overwrite").options(header=True, encoding="UTF-8").csv(csv)


def metadata(df: DataFrame) -> dict:
    """A one-row aggregate as a dictionary."""
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def save_metadata(payload: dict, path: str | Path) -> None:
    """SNK-06, SNK-07: indented JSON; what JSON does not know is written as text."""
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def html_table(df: DataFrame, title: str, limit: int = 50) -> str:
    """RPT-03: the first rows of a summary as an HTML table."""
    rows = df.limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def save_report(sections: list[str], path: str | Path, title: str = "Report") -> None:
    """SNK-08: a self-contained HTML page of the sections."""
    page = f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(sections)}</body></html>"
    Path(path).write_text(page, encoding="utf-8")


def save_quality_outputs(audited: DataFrame, summary: DataFrame, thresholds: DataFrame, counts: DataFrame, folder: str, sample_flag: str = "flag_use_market_analysis") -> dict[str, str]:
    """SNK-04: the five outputs of the quality stage below ``folder``: all audited rows, the sample for analysis (both
    parquet), yearly summary and thresholds (CSV), and the counts as JSON lines. Gives their places."""
    places = {part: f"{folder}/{part}" for part in ("audited", "sample", "summary", "thresholds", "metadata")}
    save_table(audited, parquet=places["audited"])
    # Read back, so that the stage is not computed twice.
    written = audited.sparkSession.read.parquet(places["audited"])
    save_table(written.where(F.coalesce(F.col(sample_flag), F.lit(False))), parquet=places["sample"])
    save_table(summary, csv=places["summary"])
    save_table(thresholds, csv=places["thresholds"])
    counts.coalesce(1).write.mode("overwrite").json(places["metadata"])
    return places


def save_manifest(files: list[dict], errors: list[dict], groups: list[str], path: str | Path, project: str, at: str) -> None:
    """SNK-07: what a collection of files holds; ``at`` is the time it was made, given by the caller."""
    save_metadata({"generated_at": at, "project": project, "groups": list(groups), "files": files, "errors": errors}, path)


def image_data_uri(content: bytes, kind: str = "image/png") -> str:
    """STR-13: an image as a data address for a page that stands alone."""
    return f"data:{kind};base64,{base64.b64encode(content).decode('ascii')}"
