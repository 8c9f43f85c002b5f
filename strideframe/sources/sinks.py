"""Sinks that create or refuse, and keep sample data out of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.errors import SchemaError

# Report keys that would carry samples.
PAYLOAD_KEYS = frozenset({"signals", "windows", "raw_labels", "timestamps", "x_train", "y_train"})


def payload_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of fields in a schema that reports must not carry."""
    if isinstance(kind, T.ArrayType):
        return payload_paths(kind.elementType, at)
    if isinstance(kind, T.MapType):
        return payload_paths(kind.valueType, at)
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind:
        path = f"{at}.{f.name}" if at else f.name
        out += ([path] if f.name.lower() in PAYLOAD_KEYS else []) + payload_paths(f.dataType, path)
    return out


def require_report(df: DataFrame) -> None:
    """What no report may carry: sample payloads, and NaN in any number, nested ones too."""
    if found := payload_paths(df.schema):
        raise SchemaError(f"a report may not carry {found}")
    if (broken := [has_nan(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if may_have_nan(f.dataType)]) and not df.where(F.coalesce(*[F.when(b, True) for b in broken])).isEmpty():
        raise SchemaError("a report may not hold NaN")


def may_have_nan(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(may_have_nan(f.dataType) for f in kind)
    inner = getattr(kind, "elementType", getattr(kind, "valueType", None))
    return isinstance(kind, T.DoubleType | T.FloatType) or (inner is not None and may_have_nan(inner))


def has_nan(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.coalesce(*[F.when(has_nan(column[f.name], f.dataType), True) for f in kind if may_have_nan(f.dataType)], F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: has_nan(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.exists(F.map_values(column), lambda x: has_nan(x, kind.valueType))
    return F.isnan(column)


def write_report(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON lines; refuses sample payloads, NaN and, unless told, an existing path."""
    require_report(df)
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_windows(df: DataFrame, path: str, *, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
    """Windows or generated arrays as Parquet."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_trajectories(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Trajectories as JSON lines (signals are what they are for); refuses an existing path unless told."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_table_report(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A flat report as CSV with a header; the same refusals as ``write_report``."""
    require_report(df)
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; one of more than ``most`` rows is refused."""
    require_report(df)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise SchemaError(f"over {most} rows are no report to read")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines) + "\n"
