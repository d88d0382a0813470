"""Readers of register extracts: varying headers, wide statements, broken pipes, encodings.

Each takes raw rows or a path and gives typed rows plus what it could not use; the driver looks
at headers only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regspark.functions import cleaning

#: Account columns of a wide file and the form they mean; fewer than the least is no statement file.
FORM_BY_ACCOUNTS, LEAST_ACCOUNTS = {622: 1, 868: 2, 925: 3}, 50
HEADER_ROWS = 15
REGISTRY_FIELDS = 21


class UnusableFile(ValueError):
    """The file does not have the shape that its register needs."""


def header_key(name: str) -> str:
    """The key of a header: capitals without accents, anything else one underscore."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub(r"[^A-Z0-9]+", "_", plain.upper()).strip("_")


def read_aliased(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[str]]]:
    """Columns by their first matching alias, and a report of unknown and missing ones."""
    by_key: dict[str, str] = {}
    for c in df.columns:
        by_key.setdefault(header_key(c), c)
    found = {field: by_key[k] for field, names in aliases.items() for k in [next((k for k in map(header_key, names) if k in by_key), None)] if k}
    report = {"unknown": [c for c in df.columns if c not in found.values()], "missing": [f for f in aliases if f not in found]}
    if lost := [f for f in required if f not in found]:
        raise UnusableFile(f"required columns are missing: {', '.join(lost)}")
    return df.select(*(F.col(f"`{c}`").alias(f) for f, c in found.items())), report


def find_header(spark: SparkSession, path: str, labels: list[str], sep: str = ";") -> str:
    """The header line: of the first rows the first with all labels, else the one with most."""
    lines = [r[0] for r in spark.read.text(path).head(HEADER_ROWS)]
    wanted = set(map(header_key, labels))
    score = [len(wanted & set(map(header_key, line.split(sep)))) for line in lines]
    if not lines or max(score) == 0:
        raise UnusableFile("no header row found")
    return lines[score.index(max(score))]


def wide_statements(df: DataFrame, year: str, company: str, prefix: str = "CUENTA_") -> DataFrame:
    """year, form, company, account, value from a wide file; zero, empty and unreadable cells are absent
    (for the last see wide_statement_errors).

    The form follows from the number of account columns; an unknown plan or too few accounts
    refuse the file, as do several years in it.
    """
    long, form = _long_cells(df, year, company, prefix)
    return long.select(F.col(year).cast("int").alias("year"), F.lit(form).alias("form"), F.col(company).alias("company"), "account", cleaning.amount(F.col("cell")).alias("value")).where("value IS NOT NULL")


def wide_statement_errors(df: DataFrame, year: str, company: str, prefix: str = "CUENTA_") -> DataFrame:
    """year, company, account, raw, reason of the cells of a wide file that hold something but no amount."""
    long, _ = _long_cells(df, year, company, prefix)
    reason = cleaning.amount_error(F.col("cell"))
    return long.where(reason.isNotNull()).select(F.col(year).cast("int").alias("year"), F.col(company).alias("company"), "account", F.col("cell").alias("raw"), reason.alias("reason"))


def _long_cells(df: DataFrame, year: str, company: str, prefix: str) -> tuple[DataFrame, int]:
    accounts = [c for c in df.columns if c.startswith(prefix)]
    if len(accounts) < LEAST_ACCOUNTS:
        raise UnusableFile(f"{len(accounts)} account columns")
    if (form := FORM_BY_ACCOUNTS.get(len(accounts))) is None:
        raise UnusableFile(f"no form has {len(accounts)} accounts")
    if len(df.select(year).distinct().head(2)) > 1:
        raise UnusableFile("several years in one file")
    # One array of cells and one of names: hundreds of columns as an unpivot would be as many projections.
    long = df.select(year, company, F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in accounts))).alias("at", "cell")).where("cell IS NOT NULL")
    names = F.split(F.lit(",".join(c[len(prefix) :] for c in accounts)), ",")
    return long.select(year, company, F.get(names, F.col("at")).alias("account"), "cell"), form


def pipe_registry(lines: DataFrame, fields: int = REGISTRY_FIELDS, column: str = "value") -> DataFrame:
    """fields array<string>, reason: a plain split where the field count fits, else one that
    heeds quotes, else a reason and no fields."""
    plain = F.split(column, r"\|")
    schema = ", ".join(f"f{k} STRING" for k in range(fields + 1))
    parsed = F.from_csv(F.col(column), schema, {"sep": "|", "quote": '"', "escape": '"'})
    quoted = F.array(*(parsed[f"f{k}"] for k in range(fields)))
    fits = (F.size(plain) != fields) & parsed[f"f{fields - 1}"].isNotNull() & parsed[f"f{fields}"].isNull() & F.col(column).contains('"')
    return lines.select(F.when(F.size(plain) == fields, plain).when(fits, quoted).alias("fields"), F.when((F.size(plain) != fields) & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("fields:"), F.size(plain))).alias("reason"))


def staircase_codes(df: DataFrame, code: str, levels: list[str], order: str) -> DataFrame:
    """code, name, level: the right-most filled level column names the code; the last row of a code wins."""
    filled = [F.nullif(cleaning.sanitize(F.col(c)), F.lit("")) for c in levels]
    level = reduce(lambda rest, k: F.when(filled[k].isNotNull(), k + 1).otherwise(rest), range(len(levels)), F.lit(None).cast("int"))
    rows = df.select(cleaning.sanitize(F.col(code)).alias("code"), F.coalesce(*reversed(filled)).alias("name"), level.alias("level"), F.col(order).alias("_order")).where(F.col("code").rlike(r"^[A-Z]\d*$") & F.col("level").isNotNull())
    return rows.groupBy("code").agg(F.max_by(F.struct("name", "level"), "_order").alias("s")).select("code", "s.*")


def code_names(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """code, name from tab- or space-separated lines; numeric codes only; the last row of a code wins."""
    c = F.col(column)
    code, name = F.regexp_extract(c, r"^(\d+)\s+(.+)$", 1), F.trim(F.regexp_extract(c, r"^(\d+)\s+(.+)$", 2))
    rows = lines.select(code.alias("code"), name.alias("name"), F.col(order).alias("_order")).where("code <> ''")
    return rows.groupBy("code").agg(F.max_by("name", "_order").alias("name"))


def year_matrix(df: DataFrame, code: str, value: str = "coefficient") -> DataFrame:
    """code, year and value from one column a year; blank or non-positive cells are absent."""
    years = [c for c in df.columns if c.isdigit() and 2000 <= int(c) <= 2100]
    long = df.unpivot([code], years, "year", "cell")
    return long.select(F.col(code).alias("code"), F.col("year").cast("int").alias("year"), F.col("cell").try_cast("decimal(6,4)").alias(value)).where(F.col("code").rlike(r"^[A-Z]\d{3}$") & (F.col(value) > 0))


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, place, value: the lines of text files, each file read as UTF-8 if its first block is, else as Latin-1.

    Lines are judged whole and in bytes, so no character is cut, whatever the size of a file; a byte
    order mark is left out. `place` (block, number) orders the lines of a file. A file is read in
    splits like any other, and its verdict is one row.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number")).alias("place"), "value")
    judged = raw.where("place.block = 0").groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    text = F.when(F.col("utf8"), F.make_valid_utf8("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return raw.join(judged, "file").select("file", "place", F.regexp_replace(text, "^\ufeff", "").alias("value"))


def read_text_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of text files in UTF-8 or Latin-1, as `value`."""
    return text_lines(spark, paths).select("value")


def split_rejects(df: DataFrame, errors: Column, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Good rows, and at most `most` rejected ones (a report) with their reasons."""
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0).limit(most)


def write_directory(df: DataFrame, path: str, key: str, most: int = 10_000) -> None:
    """A `;`-separated report with all fields quoted, by key, of at most `most` rows."""
    df.orderBy(key).limit(most).write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"')


def write_segment(df: DataFrame, path: str, order: list[Column], most: int = 50_000) -> None:
    """A `;`-separated file for a spreadsheet: header, the first `most` rows by `order`, quoted only where
    needed, and a last line that says how many were left out, if any were.

    The bound on rows makes one file of it; only the number of those left out is counted.
    """
    options = {"sep": ";", "quote": '"', "escape": '"'}
    first = df.orderBy(*order).limit(most).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    lines = first.select(F.lit(1).alias("part"), F.col("_n").alias("n"), F.to_csv(F.struct(*df.columns), options).alias("line"))
    header = df.sparkSession.createDataFrame([(0, 0, ";".join(df.columns))], lines.schema)
    left = df.agg((F.count("*") - most).alias("left")).where("left > 0").select(F.lit(2).alias("part"), F.lit(0).alias("n"), F.concat(F.lit("# "), F.col("left"), F.lit(" rows left out")).alias("line"))
    lines.unionByName(header).unionByName(left).repartition(1).sortWithinPartitions("part", "n").select("line").write.mode("overwrite").text(path)
