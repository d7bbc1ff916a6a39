"""ARFF, delimited, sparse-matrix, term-matrix and hidden-Markov-model files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@dataclass(frozen=True)
class Attribute:
    """values: None for a real."""

    name: str
    values: tuple[str, ...] | None = None


def parse_attribute(line: str) -> Attribute:
    m = re.match(r"""(?i)@attribute\s+(?:'([^']*)'|"([^"]*)"|([^\s{]+))\s*(.*)$""", line.strip())
    if not m:
        raise ValueError(f"not an attribute: {line}")
    name, kind = m[1] or m[2] or m[3], m[4].strip()
    if kind.startswith("{"):
        return Attribute(name, tuple(v.strip().strip("'\"") for v in kind.strip("{}").split(",")))
    if kind.lower() in ("continuous", "integer", "numeric", "real"):
        return Attribute(name)
    raise ValueError(f"unknown type {kind}")


def _schema(attributes: list[Attribute]) -> StructType:
    return StructType([StructField(a.name, DoubleType() if a.values is None else StringType(), True, {"values": list(a.values)} if a.values else {}) for a in attributes])


def _typed(lines: DataFrame, attributes: list[Attribute], parts) -> DataFrame:
    """Columns out of an array of strings; wrong counts, numbers and values raise an error."""
    n = len(attributes)
    ok = F.assert_true(F.size(parts) == n, F.concat(F.lit(f"expected {n} values: "), F.col("value")))
    rows = lines.select(parts.alias("p"), "value", ok.alias("ok")).where(F.col("ok").isNull())
    cols = []
    for i, a in enumerate(attributes):
        cell = F.get("p", i)
        cell = F.when((cell != "") & (cell != "?"), cell)
        if a.values is None:
            number = cell.try_cast("double")
            cols.append(F.when(cell.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"not a number in {a.name}: "), cell)).cast("double")).otherwise(number).alias(a.name))
        else:
            names = F.array(*map(F.lit, a.values))
            found = F.get(names, (F.array_position(F.transform(names, F.lower), F.lower(cell)) - 1).cast("int"))
            bad = cell.isNotNull() & (F.array_position(F.transform(names, F.lower), F.lower(cell)) == 0)
            cols.append(F.when(bad, F.raise_error(F.concat(F.lit(f"unknown value in {a.name}: "), cell)).cast("string")).otherwise(F.when(cell.isNotNull(), found)).alias(a.name, metadata={"values": list(a.values)}))
    return rows.select(*cols)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Reals as doubles, nominals as strings with their values in the column's metadata; ? and empty cells are null. Only the header comes to the driver."""
    lines = spark.read.text(path)
    header, at = [], None
    for row in lines.toLocalIterator():
        line = row.value.strip()
        if line.lower().startswith("@attribute"):
            header.append(parse_attribute(line))
        if line.lower().startswith("@data"):
            at = True
            break
    if at is None:
        raise ValueError("no @DATA")
    body = lines.where(~F.trim("value").rlike(r"(?i)^(%|@relation|@attribute|@data)") & (F.trim("value") != ""))
    sep = F.when(F.col("value").contains(","), ",").otherwise("\t")
    return _typed(body, header, F.transform(F.split("value", sep), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")))


def write_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """One file, in the order of df."""
    header = [f"@RELATION {relation}", ""]
    for f in df.schema:
        values = f.metadata.get("values")
        if not isinstance(f.dataType, StringType):
            header.append(f"@ATTRIBUTE '{f.name}' real")
        else:
            values = values or sorted(r[0] for r in df.select(f.name).where(F.col(f.name).isNotNull()).distinct().collect())
            header.append(f"@ATTRIBUTE '{f.name}' {{{','.join(values)}}}")
    head = df.sparkSession.createDataFrame([("\n".join([*header, "", "@DATA"]),)], "value string")
    body = df.select(F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in df.columns)).alias("value"))
    head.unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def read_delimited(spark: SparkSession, path: str, separator: str | None = ",", header: bool = False, tolerant: bool = False) -> DataFrame:
    """A column is real if all its known cells are numbers, else nominal. separator None: any white space. tolerant fills short rows."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+") if separator is None else F.transform(F.split("value", re.escape(separator)), lambda x: F.trim(x))
    rows = lines.select("value", parts.alias("p"))
    names = None
    if header:
        first = rows.first()
        names = first.p
        rows = rows.where(F.col("value") != first.value)
    width = len(names) if names else rows.agg(F.max(F.size("p"))).first()[0] or 0
    names = names or [f"attr{i}" for i in range(width)]
    cells = [F.when((F.get("p", i) != "") & (F.get("p", i) != "?"), F.get("p", i)) for i in range(width)]
    checks = rows.agg(F.max(F.size("p")).alias("most"), F.min(F.size("p")).alias("least"), *(F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias(f"b{i}") for i, c in enumerate(cells))).first()
    if checks.most is not None and (checks.most > width or checks.least < width and not tolerant):
        raise ValueError(f"rows of {checks.least} to {checks.most} cells; {width} expected")
    return rows.select(*(c.try_cast("double").alias(n) if checks[f"b{i}"] == 0 else c.alias(n) for i, (c, n) in enumerate(zip(cells, names, strict=True))))


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=separator, nullValue="?", header=False)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """row, col, val. The first line, rows and columns with a comma or blank between, is not a row; blank lines are empty rows."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row", "line")).where("row > 0")
    cells = text.select((F.col("row") - 1).alias("row"), F.explode(F.regexp_extract_all("line", F.lit(r"[0-9]+\s*=\s*[^,\s]+"), F.lit(0))).alias("c"))
    pair = F.split("c", r"\s*=\s*")
    return cells.select("row", pair[0].cast("int").alias("col"), pair[1].cast("double").alias("val"))


def write_sparse(coo: DataFrame, path: str, rows: int, cols: int) -> None:
    spark = coo.sparkSession
    lines = coo.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "val"))), lambda c: F.concat(c["col"], F.lit("="), c["val"])), ",").alias("value"))
    every = spark.range(rows).select(F.col("id").cast("int").alias("row")).join(lines, "row", "left").select("row", F.coalesce("value", F.lit("")).alias("value"))
    head = spark.createDataFrame([(-1, f"{rows},{cols}")], "row int, value string")
    head.unionByName(every).sort("row").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_hmm(text: str) -> dict:
    """The model of a text M= N= A: B: pi: as lists."""
    n, m = int(re.search(r"N=\s*(\d+)", text)[1]), int(re.search(r"M=\s*(\d+)", text)[1])
    part = lambda key, rows, cols: [[float(x) for x in line.split()][:cols] for line in text.split(key, 1)[1].strip().splitlines()[:rows]]
    return {"initial": part("pi:", 1, n)[0], "transition": part("A:", n, n), "emission": part("B:", n, m)}


def write_hmm(model: dict) -> str:
    row = lambda v: " ".join(f"{x:f}" for x in v)
    a, b = model["transition"], model["emission"]
    return "\n".join([f"M= {len(b[0])}", f"N= {len(a)}", "A:", *map(row, a), "B:", *map(row, b), "pi:", row(model["initial"]), ""])


def read_symbols(text: str) -> list[int]:
    """The symbols, from 1, after a header T= or R= T=."""
    return [int(x) for x in text.split("T=", 1)[1].split()[1:]]


def write_symbols(symbols: list[int]) -> str:
    return f"T= {len(symbols)}\n" + " ".join(map(str, symbols)) + "\n"
