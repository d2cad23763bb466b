"""Sinks: sheets for reviewers, levels and splits, manifests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_sheet(rows: DataFrame, path: str, columns: list[str], blanks: list[str], keep_edits: bool = False) -> None:
    """A CSV sheet with empty columns for a reviewer. An existing one is an error, or stays as it is with keep_edits."""
    sheet = rows.select(*columns, *(F.lit("").alias(b) for b in blanks))
    sheet.coalesce(1).write.mode("ignore" if keep_edits else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def read_sheet(spark, path: str) -> DataFrame:
    """A sheet's rows, blanks as null."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns))


def write_levels(rows: DataFrame, path: str) -> DataFrame:
    """rows (with level and split) as JSON under level=/split=, and a manifest: level, split, n, digest of the rows' hashes.

    Digests are of contents, as files of a distributed writer differ from run to run.
    """
    rows.write.partitionBy("level", "split").json(path)
    line = F.sha2(F.to_json(F.struct(*(c for c in rows.columns if c not in ("level", "split")))), 256)
    parts = rows.select("level", "split", line.alias("h"), F.substring(line, 1, 3).alias("r")).groupBy("level", "split", "r").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return parts.groupBy("level", "split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def read_json_lines(spark, path: str, ddl: str, usable: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines; a line of another shape is an error, blank lines are not rows, and rows that aren't usable are dropped. A limit counts what is left."""
    rows = spark.read.schema(ddl).option("mode", "FAILFAST").json(path)
    rows = rows if usable is None else rows.where(F.coalesce(usable, F.lit(False)))
    return rows if limit is None else rows.limit(limit)


def validated(rows: DataFrame, checks: dict[str, Column], limit: int | None = None) -> DataFrame:
    """rows with the names of the checks that don't hold (reasons); a limit, of one row or more, counts rows before their checks."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is one row or more")
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()])))


def read_cases(spark, path: str, ddl: str) -> DataFrame:
    """Evaluation cases of a small YAML or JSON file (a list, or the list under `cases`), read by the driver. YAML needs PyYAML, which is optional."""
    raw = "\n".join(r.value for r in spark.read.text(path).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need PyYAML, which is not installed") from e
        body = yaml.safe_load(raw)
    else:
        body = json.loads(raw)
    cases = body if isinstance(body, list) else body["cases"]
    names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", ddl)]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in cases], ddl)
