"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's rejection rate and time are measured on a bounded sample; the rules are then tried
in order of rejections per second, and a text that one rule rejects is not put to the next.
The order decides how much work is done, never which texts are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import WORD_BREAKS, dropped, fresh, stored, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT_WINDOW = 8
#: Rows of the sample on which rules are timed, one text in so many being taken, of at most so many characters; runs of each rule.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_CHARS, TIMINGS = 500, 16, 100_000, 3


@dataclass(frozen=True)
class Rule:
    """A rule rejects the texts for which `rejects`, SQL over the measured columns, is true."""

    name: str
    rejects: str


#: Thresholds as whole-number comparisons, so that any SQL engine agrees on them.
BASE_RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
)
VERDICT_RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "10 * n_capitals > 4 * word_chars"),
    Rule("exclaims", "5 * n_exclaims > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _line_list(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(WORD_BREAKS)) != "")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns that the rules read: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals, n_exclaims (all long).

    A null text counts as empty: every figure is 0. Columns of `docs` with one of these names
    are replaced. Windows of eight words are compared by their 64-bit hash within one text;
    they are sorted only in texts where a hash repeats, so the work is linear for others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, h, s, p = (fresh(docs, f"_{x}") for x in ("words", "hashes", "sorted", "starts"))
    step = docs.withColumn(w, words(F.col(text_col)))
    step = step.withColumn(h, F.expr(f"CASE WHEN size(`{w}`) < {REPEAT_WINDOW} THEN array() ELSE transform(sequence(1, size(`{w}`) - {REPEAT_WINDOW - 1}), i -> xxhash64(slice(`{w}`, i, {REPEAT_WINDOW}))) END"))
    step = step.withColumn(s, F.expr(f"CASE WHEN size(array_distinct(`{h}`)) = size(`{h}`) THEN array() ELSE array_sort(transform(`{h}`, (x, i) -> struct(x AS x, i AS i))) END"))
    step = step.withColumn(p, F.expr(f"array_sort(transform(filter(`{s}`, (e, k) -> (k > 0 AND get(`{s}`, k - 1).x = e.x) OR (k < size(`{s}`) - 1 AND get(`{s}`, k + 1).x = e.x)), e -> e.i))"))
    lines = _line_list(text)
    return step.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.translate(text, WORD_BREAKS, "")).cast("long"),
            "n_symbols": _count_of(text, SYMBOLS),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.expr(f"CAST(CASE WHEN size(`{p}`) = 0 THEN 0 ELSE aggregate(zip_with(slice(`{p}`, 2, size(`{p}`)), slice(`{p}`, 1, size(`{p}`) - 1), (b, a) -> least({REPEAT_WINDOW}, b - a)), {REPEAT_WINDOW}, (x, y) -> x + y) END AS long)"),
            "n_capitals": _count_of(text, CAPITALS),
            "n_exclaims": _count_of(text, "!"),
        }
    ).drop(w, h, s, p)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by measured rejections per second on at most `sample_rows` rows of `docs`.

    The sample is taken by a hash of the text. Each rule is timed on its raw texts, its own
    measurements included: the least of TIMINGS runs, less that of a rule that measures nothing.
    On an empty sample the given order stands; ties keep it too.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    few = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0).head(sample_rows) or texts.head(sample_rows)
    if not few:
        return rules
    sample = stored(docs.sparkSession.range(1).select(F.explode(F.lit([r["text"] for r in few])).alias("text")))

    def seconds(rejects: str) -> float:
        took = []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            measure(sample).agg(F.count_if(F.expr(rejects))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    rejected = measure(sample).agg(*(F.count_if(F.expr(r.rejects)).alias(r.name) for r in rules)).first()
    idle = min(seconds("false") for _ in range(2))  # what a job takes that measures nothing
    gain = {r: rejected[r.name] / len(few) / max(seconds(r.rejects) - idle, 1e-4) for r in rules}
    dropped(sample)
    return tuple(sorted(rules, key=lambda r: -gain[r]))


def cascade(measured: DataFrame, rules: tuple[Rule, ...], out: str = "failed_rule") -> DataFrame:
    """Add `out`: the name of the first of `rules` that rejects the row, null if none does.

    One CASE expression, so later rules are not evaluated for a row that an earlier one
    rejects. A rule that comes out null does not reject.
    """
    if not rules:
        return measured.withColumn(out, F.lit(None).cast("string"))
    chain = F.when(F.expr(rules[0].rejects), F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(F.expr(rule.rejects), F.lit(rule.name))
    return measured.withColumn(out, chain)


def apply_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measure every text and judge it: adds the columns of measure(), base_failed, kept.

    base_failed: a base rule rejects. kept: false if base_failed, else whether no verdict
    rule, tried in the estimated order, rejects. Empty and null texts fail `too_short`.
    Repeated rows are judged alike; an empty table stays empty; no shuffle takes place.
    """
    base = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    ordered = order_rules(docs, VERDICT_RULES, text_col, sample_rows)
    failed = fresh(docs, "failed_rule")
    judged = cascade(measure(docs, text_col).withColumn("base_failed", base), (Rule("base", "base_failed"), *ordered), failed)
    return judged.withColumn("kept", F.col(failed).isNull()).drop(failed)


#: DuckDB SQL for the query's rows.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 8) AS t(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, {" OR ".join(f"({r.rejects})" for r in BASE_RULES)} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(f"({r.rejects})" for r in VERDICT_RULES)}) AS kept
FROM b
"""
