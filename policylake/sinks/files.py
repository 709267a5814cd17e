"""Writers: result lines, documents, artifacts, explorer records, knowledge bases, and clearing a run."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, append: bool = True) -> None:
    """JSON lines, missing values written as null."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_document(one_row: DataFrame, path: str) -> None:
    """A one-row table as a readable JSON file."""
    text = one_row.select(F.to_json(F.struct(*one_row.columns), {"ignoreNullFields": "false", "pretty": "true"})).first()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write((text[0] if text else "{}") + "\n")


def write_artifacts(df: DataFrame, path: str) -> None:
    """``run_id, site, third_party, kind, content`` as parquet, a folder per run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def write_explorer(records: DataFrame, path: str) -> None:
    """Explorer records: JSON lines for a ``.jsonl`` path, else one JSON array in rank order, which passes through the driver part by part."""
    if path.endswith(".jsonl"):
        write_lines(records, path, append=False)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, (row,) in enumerate(records.orderBy("rank").select(F.to_json(F.struct(*records.columns))).toLocalIterator()):
            f.write((",\n" if n else "") + row)
        f.write("]\n")


def write_ranked_text(ranked: DataFrame, path: str) -> None:
    """Domains of a ranked list as text, in rank order."""
    ranked.orderBy("rank").select(F.col("site").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def skip_failed_homes(results: DataFrame) -> DataFrame:
    """Results that are written when failed home pages are to be skipped."""
    return results.where(~F.coalesce(F.col("status") == "home_fetch_failed", F.lit(False)))


def clear_run(root: str, names: list[str]) -> dict[str, list[str]]:
    """Remove files or folders below a root: what was removed, missing, or refused because it leads out of the root."""
    base, out = os.path.realpath(root), {"removed": [], "missing": [], "errors": []}
    for n in names:
        p = os.path.realpath(os.path.join(base, n))
        if p == base or os.path.commonpath([base, p]) != base:
            out["errors"].append(n)
        elif not os.path.lexists(p):
            out["missing"].append(n)
        else:
            shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)
            out["removed"].append(n)
    return out
