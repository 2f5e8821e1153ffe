"""Sinks. Data is written by tasks; small artifacts of known size by the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_json_artifact(value, path: str, sort_keys: bool = False) -> None:
    """A small object, indented, with a line end."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=sort_keys) + "\n", encoding="utf-8")


def write_corpus(df: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """One sentence a line, in order, in files that stand in order of their names. Rows are ranged, not gathered."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(text).alias("value")).write.text(path)


def write_corpus_file(df: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """The same as one local file without a last line end; rows pass one by one."""
    with open(path, "w", encoding="utf-8") as out:
        for k, r in enumerate(df.orderBy(*order).select(text).toLocalIterator()):
            out.write(("\n" if k else "") + r[0])


def write_csv(df: DataFrame, path: str, columns: list[str] | str | None = None, digits: int | None = None, mode: str = "error") -> None:
    """With a header; columns in the given order, in that of the rows ("rows"), else sorted by name; doubles rounded to `digits`."""
    columns = df.columns if columns == "rows" else columns or sorted(df.columns)
    kinds = dict(df.dtypes)
    df.select(*(F.round(c, digits).alias(c) if digits is not None and kinds[c] in ("double", "float") else c for c in columns)).write.mode(mode).option("header", True).csv(path)


def write_if_absent(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def replace_block(path: str, begin: str, end: str, text: str) -> None:
    """Put text between two marker lines of a file, or the markers and text at its end where they are absent."""
    file = Path(path)
    old = file.read_text(encoding="utf-8") if file.exists() else ""
    head, mark, rest = old.partition(begin)
    block = f"{begin}\n{text.strip()}\n{end}"
    tail = rest.partition(end)[2] if mark else ""
    if not mark:
        head = old.rstrip("\n") + ("\n\n" if old.strip() else "")
        tail = "\n"
    file.write_text(head + block + tail, encoding="utf-8")
