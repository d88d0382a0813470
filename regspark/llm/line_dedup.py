"""Line deduplication by overlapping windows of three lines, in DataFrame expressions.

Windows of three consecutive lines (blank lines are passed over and always stay) are hashed;
a window seen before, in the order of (doc_id, text hash, position), marks its three lines,
and the marked lines of overlapping windows are removed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import WORD_BREAKS, fresh

WINDOW = 3


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, body, gone): for each text with lines to remove, their 0-based numbers, sorted.

    `doc` is the id and `body` the md5 of the text; together they name a row, so rows with one
    id and different texts are told apart, and rows equal in both are one occurrence.
    """
    lined = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.md5(F.col(text_col).cast("binary")).alias("body"),
        F.filter(
            F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(WORD_BREAKS)).alias("line"))),
            lambda x: x["line"] != "",
        ).alias("lines"),
    )
    # The outer form keeps Spark from testing the array's size further down, where the lines would be made again for each window.
    windows = lined.select(
        "doc",
        "body",
        F.explode_outer(F.expr(f"transform(CASE WHEN size(lines) < {window} THEN array() ELSE sequence(1, size(lines) - {window - 1}) END, k -> struct(md5(cast(array_join(transform(slice(lines, k, {window}), x -> x.line), '\\n') AS binary)) AS hash, transform(slice(lines, k, {window}), x -> x.i) AS covers))")).alias("w"),
    ).select("doc", "body", "w.hash", "w.covers").where("hash IS NOT NULL")
    place = F.struct("doc", "body", F.col("covers")[0].alias("at"))
    firsts = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    later = windows.join(firsts, "hash").where(place > F.col("first"))
    return later.groupBy("doc", "body").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """`docs` without the lines of windows that occurred before; all other columns unchanged.

    A null text stays null and texts of fewer than `window` non-blank lines stay as they are.
    Lines are compared without the white space around them. The first occurrence is the least
    by (id, md5 of the text, line number), a null id coming first; exact repeats of a row count
    as one occurrence, so they lose the same lines. Every row is returned, even when no line
    is left (its text is then empty). `removed_col` adds the number of lines removed, in place of
    a column of that name; no other column's name matters.

    The occurrences of a frequent window are reduced to the first on the map side, and the join
    back can be split by Spark where one window is very frequent.
    """
    doc, text_of, out = (fresh(docs, name) for name in ("_doc", "_body", "_gone"))
    gone = repeated_lines(docs, id_col, text_col, window).select(F.col("doc").alias(doc), F.col("body").alias(text_of), F.col("gone").alias(out))
    body = fresh(docs, "_text_md5")
    keyed = docs.withColumn(body, F.md5(F.col(text_col).cast("binary")))
    joined = keyed.join(gone, keyed[id_col].eqNullSafe(gone[doc]) & (keyed[body] == gone[text_of]), "left")
    if removed_col:
        joined = joined.withColumn(removed_col, F.coalesce(F.size(out), F.lit(0)).cast("long"))
    lines = fresh(docs, "_lines")
    joined = joined.withColumn(lines, F.when(F.col(out).isNotNull(), F.split(text_col, "\n")))
    left = F.expr(f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{out}`), i -> get(`{lines}`, i)), '\\n')")
    joined = joined.withColumn(text_col, F.when(F.col(out).isNull(), F.col(text_col)).otherwise(left))
    return joined.drop(body, lines, doc, text_of, out)


def oracle_ctes(source: str, prefix: str = "ld") -> str:
    """DuckDB common table expressions; the last, `{prefix}_out`, has doc_id, n_removed, text."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
{prefix}_l AS (SELECT doc_id, text, md5(text) AS body, string_split(text, chr(10)) AS parts, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {{'i': i, 'line': trim(x, {blank})}}), lambda x: x.line <> '') AS lines FROM {source} WHERE text IS NOT NULL),
{prefix}_w AS (SELECT doc_id, body, array_to_string(list_transform(lines[k:k + 2], lambda x: x.line), chr(10)) AS g, list_transform(lines[k:k + 2], lambda x: x.i) AS covers FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS k FROM {prefix}_l WHERE len(lines) >= 3)),
{prefix}_r AS (SELECT doc_id, body, covers FROM {prefix}_w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, body, covers[1]) > 1),
{prefix}_g AS (SELECT doc_id, body, list_distinct(flatten(list(covers))) AS gone FROM {prefix}_r GROUP BY ALL),
{prefix}_out AS (SELECT s.*, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
   CASE WHEN g.gone IS NULL THEN s.text ELSE array_to_string(list_filter(string_split(s.text, chr(10)), lambda x, i: NOT list_contains(g.gone, i)), chr(10)) END AS new_text
   FROM {source} s LEFT JOIN {prefix}_g g ON s.doc_id = g.doc_id AND md5(s.text) = g.body)"""


ORACLE_SQL = f"WITH {oracle_ctes('documents')} SELECT doc_id, n_removed, new_text AS text FROM ld_out"
