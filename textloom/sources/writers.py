"""Writers of records, predictions, reports and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Line JSON; null columns of a row are left out of its line."""
    df.write.mode("append" if append else "overwrite").json(path)


def records(df: DataFrame, path: str) -> None:
    """By suffix: Parquet, CSV, or line JSON."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        table(df, path)
    else:
        lines(df, path)


def table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header and columns in this order; arrays, maps and structs as JSON."""
    own = df.select(columns or df.columns)
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in own.dtypes]
    own.select(flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def predictions(df: DataFrame, path: str, keep: tuple[str, ...] = ("domain", "generator", "source", "pair_id", "bucket")) -> None:
    rest = [c for c in df.columns if c in keep or c.startswith(("p_", "pred_"))]
    lines(df.select("id", "label", "prediction", F.col("probability").alias("prob_llm"), "probability", *rest), path)


def submission(df: DataFrame, path: str, order: str, minimal: bool = True) -> None:
    """A row of label and probability for each input, in input order, as files that sort in that order."""
    own = df.select(order, F.col("prediction").alias("label"), F.round("probability", 6).alias("probability"), *([] if minimal else ["id"]))
    own.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.mode("overwrite").json(path)


def ids(df: DataFrame, path: str, column: str = "task_id") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def matrix(df: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """A pivoted table, such as pairwise overlaps."""
    table(df.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row), path)


def report(parts: dict[str, DataFrame]) -> str:
    """A nested JSON object of small tables of aggregates, each a list of its rows."""
    rows = {k: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("j")).first()["j"] for k, df in parts.items()}
    return "{" + ", ".join(f'"{k}": {v}' for k, v in rows.items()) + "}"


def markdown(df: DataFrame) -> str:
    """A table of aggregates as Markdown, all of it; it goes through the driver, so it is for small ones."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(show(v) for v in r)} |" for r in df.toLocalIterator()])
