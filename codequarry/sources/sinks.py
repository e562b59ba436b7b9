"""Writers: tables, JSON results and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths at which titles and bodies are cut on writing (fixed values).
TITLE_CHARS, BODY_CHARS = 4096, 65_535
#: Rows of a report; a longer table is refused rather than gathered.
REPORT_ROWS = 1000


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; with a partition column only the partitions that occur are replaced."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines in parts; a finished part is not written again if the job restarts a task."""
    df.write.mode("overwrite").json(path)


def issue_rows(issues: DataFrame) -> DataFrame:
    """Issues as they are stored: title and body cut, the newest fetch of each id."""
    newest = F.max(F.struct("fetched_at", "state", "title", "body")).alias("r")
    one = issues.where("id IS NOT NULL").groupBy("id").agg(newest)
    return one.select("id", F.col("r.state").alias("state"), F.substring("r.title", 1, TITLE_CHARS).alias("title"), F.substring("r.body", 1, BODY_CHARS).alias("body"))


def report(df: DataFrame, title: str) -> str:
    """A small table as Markdown."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)
