"""Stand-in environmental tables over the driver tables, the same SQL in Spark and DuckDB (see FIXTURES.md)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events".split()
_TEXT = (Path(__file__).resolve().parents[2] / "FIXTURES.md").read_text()
BODIES = {name: body.strip() for name, body in re.findall(r"```sql (fx_\w+)\n(.*?)```", _TEXT, re.DOTALL)}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in view as a lazy DataFrame."""
    body = BODIES[name]
    used = [t for t in BASE if re.search(rf"\b(?:FROM|JOIN) {t}\b", body)]
    body = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], body)
    return spark.sql(body, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_fixtures(names: str, sql: str) -> str:
    """Oracle SQL with the stand-in views in front; ``sql`` goes on from the WITH clause: ``, x AS (...) SELECT ...``."""
    return "WITH " + ",\n".join(f"{n} AS (\n{BODIES[n]})" for n in names.split()) + "\n" + sql


#: DuckDB expression of a cleaned station name (see functions.scalar.clean_name), over a column ``name``.
CLEAN_NAME = r"""(SELECT array_to_string(list_concat([CASE WHEN p[1] LIKE '%.' THEN rtrim(left(p[1], length(p[1]) - 1)) ELSE p[1] END], p[2:]), ', ')
  FROM (SELECT list_filter(list_transform(string_split(name, ','), lambda q: trim(regexp_replace(q, '\s+', ' ', 'g'))),
    lambda q: q <> '' AND lower(q) NOT IN ('mobil', 'mobile')) AS p))"""
