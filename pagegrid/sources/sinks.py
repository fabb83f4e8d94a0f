"""Render row tables as text lines and write them as one ordered file. Lines are made in parallel; nothing is gathered."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagegrid.functions.text import csv_cell, tsv_cell
from pagegrid.plans.lineage import scratch_path

BOM = "﻿"


def csv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(n)) for n in columns])


def tsv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws("\t", *[tsv_cell(F.col(n)) for n in columns])


def csv_header(columns: Sequence[str]) -> str:
    def cell(name: str) -> str:
        return '"' + name.replace('"', '""') + '"' if any(ch in name for ch in '",\r\n') else name

    return BOM + ",".join(cell(n) for n in columns)


def _append(spark: SparkSession, parts: str, path: str, head: str, between: str, tail: str) -> None:
    """One file of ``head``, the part files under ``parts`` in order without the last ``between``, and ``tail``.

    Parts are appended by the file system's streams, some kilobytes at a time. The file gets its name when it is complete.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    files = at(path).getFileSystem(conf)
    listed = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in at(parts).getFileSystem(conf).listStatus(at(parts)) if s.getPath().getName().startswith("part-") and s.getLen())
    unfinished = at(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(unfinished)
    out.write(bytearray((head if listed or not head.endswith("\n") else head[:-1]).encode()))
    for i, (_, size, part) in enumerate(listed):
        source = part.getFileSystem(conf).open(part)
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (len(between.encode()) if i == len(listed) - 1 else 0))
        source.close()
    out.write(bytearray(tail.encode()))
    out.close()
    files.delete(at(path), True)
    if not files.rename(unfinished, at(path)):
        raise OSError(f"cannot name the export {path}")


def write_lines(df: DataFrame, line: Column, path: str, head: str = "", between: str = "\n", tail: str = "") -> None:
    """One file: ``head``, the lines of ``df`` in its order with ``between`` between them, ``tail``.

    Lines are made and written in parallel, in parts that the commit protocol keeps whole; the parts are then appended.
    """
    parts = scratch_path(df.sparkSession, "export")
    df.select(line.alias("value")).write.option("lineSep", between).text(parts)
    _append(df.sparkSession, parts, path, head, between, tail)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    columns = list(columns or df.columns)
    write_lines(df, csv_line(columns), path, csv_header(columns) + "\n")


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    columns = list(columns or df.columns)
    write_lines(df, tsv_line(columns), path, "\t".join(" ".join(n.split("\t")) for n in columns) + "\n")


def write_json(df: DataFrame, path: str, data: str | None = None, columns: Sequence[str] | None = None) -> None:
    """An array with an object per row: a dynamic map column as is (own keys only), or typed columns."""
    body = F.to_json(F.col(data)) if data else F.to_json(F.struct(*(columns or df.columns)))
    write_lines(df, body, path, "[", ",\n", "]")


def export_table(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "csv", order: Sequence[Column] = (), limit: int | None = None, needle: str = "", column: str = "", value: str = "") -> DataFrame:
    """Limit (if given), then filter, then render; an unknown format falls back to CSV. Returns the rows written."""
    from pagegrid.operators.rows import column_contains, search

    limited = df.orderBy(*order) if order else df
    limited = limited.limit(max(1, int(limit))) if limit else limited
    rows = limited.filter(search(list(columns), needle) & column_contains(F.col(column) if column else None, value))
    kind = (fmt or "csv").strip().lower()
    if kind == "json":
        write_json(rows, path, columns=columns)
    elif kind == "tsv":
        write_tsv(rows, path, columns)
    else:
        write_csv(rows, path, columns)
    return rows


def export_name(table_id: str, stamp: str, extension: str) -> str:
    return f"table_{(table_id or 'table')[:8]}_{stamp.replace(':', '-').replace('.', '-')}.{extension}"


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to a row store partitioned by table, so a table scan reads only its own folder."""
    df.write.mode(mode).partitionBy("table_id").parquet(path)
