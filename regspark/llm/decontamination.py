"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers, capitalised names and units become typed placeholders, so that a question asked again
with other parameters keeps its template. Windows of five template tokens of the benchmark are
joined by hash with those of the documents; then the slots of the matching windows are read
from the raw words, and one value of a benchmark slot must always meet the same document value,
in the whole document or in one occurrence of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import WORD_BREAK_PATTERN, durable, fresh

WINDOW = 5
#: Shares of an item's windows that must be found, and of slot uses that must be consistent.
MIN_SHARE = MIN_CONSISTENT = 0.8
#: Words inserted or left out may shift places within one occurrence by twice as many.
SHIFT = WINDOW - 1
#: Windows with fewer tokens that are not placeholders say too little and are not searched for.
MIN_LITERALS = 2
#: The benchmark's windows are broadcast only if its texts have at most so many characters.
BROADCAST_CHARS = 4_000_000
#: Units that count as such after a number.
UNITS = "km cm mm m kg mg g t lb oz l ml h hr hrs min s ms mph kmh mi ft in % € $ £ usd eur hours hour minutes minute seconds second days day weeks week months month years year miles mile meters meter metres metre kilometers kilometres pounds pound dollars dollar euros euro percent degrees".split()

_NAME = (r"(^|[^\p{L}])\p{Lu}\p{Ll}+", "<name>")
_NUMBER = r"[0-9][0-9.,:/]*"
_UNIT = "(" + "|".join(sorted((u.replace("$", r"\$") for u in UNITS), key=len, reverse=True)) + ")"
#: What joins neither a word nor a placeholder; white space stays, so words keep their places.
_OTHER = r"[^\p{L}\p{N}<>\x20\x09-\x0D]+"


def template(text: Column) -> Column:
    """The text with typed placeholders, lower case, without punctuation, word by word."""
    t = F.regexp_replace(text, r"[<>]", " ")
    t = F.regexp_replace(t, _NAME[0], f"$1{_NAME[1]}")
    t = F.regexp_replace(t, rf"({_NUMBER})([\x20\x09-\x0D]+){_UNIT}([^\p{{L}}\p{{N}}]|$)", "<num>$2<unit>$4")
    t = F.regexp_replace(t, rf"{_NUMBER}{_UNIT}([^\p{{L}}\p{{N}}]|$)", "<num><unit>$2")
    t = F.regexp_replace(t, _NUMBER, "<num>")
    return F.lower(F.regexp_replace(t, _OTHER, ""))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(template(text), WORD_BREAK_PATTERN), lambda w: w != "")


def _slots(text: Column) -> Column:
    """(token, raw) for each template token: its raw word in lower case, without punctuation."""
    raw = F.split(F.lower(F.regexp_replace(F.regexp_replace(text, r"[<>]", " "), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")), WORD_BREAK_PATTERN)
    pairs = F.zip_with(F.split(template(text), WORD_BREAK_PATTERN), raw, lambda t, r: F.struct(t.alias("token"), r.alias("raw")))
    return F.filter(pairs, lambda x: x["token"] != "")


def _windows(tokens: str, length: int) -> Column:
    return F.expr(f"CASE WHEN size(`{tokens}`) < {length} THEN array() ELSE transform(sequence(1, size(`{tokens}`) - {length - 1}), i -> xxhash64(slice(`{tokens}`, i, {length}))) END")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_share: float = MIN_SHARE,
    min_consistent: float = MIN_CONSISTENT,
) -> DataFrame:
    """(id, body, item, n_found, n_windows, consistent): the document-item pairs that leak.

    `body` is the md5 of the document's text and, with the id, names the row; equal rows give
    one pair. n_found of the n_windows distinct places of searched windows in the item occur in
    the document, a share of at least `min_share`; `consistent` is the share of slot uses whose
    document value is the usual one for the item's value, 1.0 without slots, and is at least
    `min_consistent`. A document that falls short as a whole is judged by each occurrence: the
    windows of one of the item's texts at places that differ by one distance, give or take SHIFT,
    which must hold `min_share` of that text's windows; `consistent` is then that of the best
    one. So an item that leaks twice with different values is found. An item of fewer than five
    tokens is one window. Null texts match nothing, nor do windows with fewer than MIN_LITERALS
    words that are not placeholders. Rows of the benchmark with one id are one item with all their windows.
    Either table may be empty (no pairs). Texts are searched whole, at any length.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.md5(F.col(item_text_col).cast("binary")).alias("item_body"), _slots(F.col(item_text_col)).alias("slots")).distinct()
    length = f"least(size(slots), {WINDOW})"
    items = items.select("item", "item_body", "slots", F.explode_outer(F.expr(f"CASE WHEN size(slots) = 0 THEN array() ELSE sequence(1, size(slots) - {length} + 1) END")).alias("at"))
    items = items.where("at IS NOT NULL").select("item", "item_body", "at", F.slice("slots", F.col("at"), F.expr(length)).alias("asked"))
    items = items.where(F.size(F.filter("asked", lambda x: ~x["token"].contains("<"))) >= MIN_LITERALS)
    items = items.withColumns({"hash": F.xxhash64(F.transform("asked", lambda x: x["token"])), "length": F.size("asked")})
    searched = items.select("item", "item_body", "at", "hash", "length")
    lengths = sorted((r[0] for r in items.select("length").distinct().collect()), reverse=True) or [WINDOW]  # at most WINDOW of them
    chars = benchmark.agg(F.sum(F.length(item_text_col))).first()[0] or 0
    near = F.broadcast if chars <= BROADCAST_CHARS else (lambda df: df)

    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokenised = keyed.select("id", F.md5(F.col("text").cast("binary")).alias("body"), _tokens(F.col("text")).alias("tokens"))
    hashed = tokenised.select("id", "body", F.concat(*(_windows("tokens", n) for n in lengths)).alias("hashes"), F.size("tokens").alias("size"))
    # The outer form keeps Spark from testing the array's size further down, where its tokens would be made again for each window.
    places = hashed.select("id", "body", "size", F.posexplode_outer("hashes").alias("pos", "hash"))
    ahead, skipped = F.lit(0), F.lit(0)  # windows of longer lengths stand before those of a shorter one
    for n in lengths:
        skipped = F.when(F.col("length") == n, ahead).otherwise(skipped)
        ahead = ahead + F.greatest(F.col("size") - (n - 1), F.lit(0))
    hits = places.join(near(searched), "hash").withColumn("pos", F.col("pos") - skipped)
    per_item = searched.groupBy("item").agg(F.count_distinct("item_body", "at").alias("n_windows"))
    found = hits.groupBy("id", "body", "item").agg(F.count_distinct("item_body", "at").alias("n_found"), F.collect_set(F.struct("item_body", "at", "pos")).alias("places"))
    found = found.join(near(per_item), found["item"].eqNullSafe(per_item["item"])).drop(per_item["item"]).where(F.col("n_found") >= min_share * F.col("n_windows"))

    with_slots = keyed.withColumn("body", F.md5(F.col("text").cast("binary")))
    again = found.join(with_slots, found["id"].eqNullSafe(with_slots["id"]) & (found["body"] == with_slots["body"])).drop(with_slots["id"], with_slots["body"])
    again = again.dropDuplicates(["id", "body", "item"]).withColumn("said", _slots(F.col("text")))
    again = again.select("id", "body", "item", "n_found", "n_windows", F.explode_outer("places").alias("p"), "said")
    again = again.select("id", "body", "item", "n_found", "n_windows", F.col("p.item_body").alias("item_body"), F.col("p.at").alias("at"), F.col("p.pos").alias("pos"), F.slice("said", F.col("p.pos") + 1, F.lit(WINDOW)).alias("said"))
    asked = items.select(F.col("item").alias("_item"), F.col("item_body").alias("_body"), F.col("at").alias("_at"), "asked")
    uses = again.join(near(asked), again["item"].eqNullSafe(asked["_item"]) & (again["item_body"] == asked["_body"]) & (again["at"] == asked["_at"]))
    uses = uses.withColumn("said", F.slice("said", F.lit(1), F.size("asked")))
    same = F.transform("asked", lambda x: x["token"]) == F.transform("said", lambda x: x["token"])
    slots = F.filter(F.zip_with("asked", "said", lambda a, s: F.struct(a["token"].alias("kind"), a["raw"].alias("asked"), s["raw"].alias("said"))), lambda x: x["kind"].contains("<"))
    group = ["id", "body", "item", "n_found", "n_windows"]
    uses = durable(uses.where(same).select(*group, "item_body", "at", "pos", slots.alias("slots")))
    judged = _consistency(uses, group)
    weak = judged.where(F.col("consistent") < min_consistent).select(*(F.col(c).alias(f"_{c}") for c in ("id", "body", "item")))
    unsettled = uses.join(weak, uses["id"].eqNullSafe(weak["_id"]) & (uses["body"] == weak["_body"]) & uses["item"].eqNullSafe(weak["_item"]), "left_semi")
    shift = F.expr(f"pos - at - {SHIFT}"), F.expr(f"pos - at + {SHIFT}")
    placed = unsettled.select(*group, "item_body", "at", "pos", "slots", F.explode(F.sequence(*shift)).alias("start"))
    nearest = placed.groupBy(*group, "item_body", "start", "at").agg(F.min(F.struct(F.abs(F.expr("pos - at - start")).alias("off"), "pos", "slots"))["slots"].alias("slots"))
    occurrences = nearest.groupBy(*group, "item_body", "start").agg(F.count("*").alias("n_at"), F.flatten(F.collect_list("slots")).alias("slots"))
    per_text = searched.groupBy(F.col("item").alias("_item"), F.col("item_body").alias("_body")).agg(F.count_distinct("at").alias("n_text"))
    occurrences = occurrences.join(near(per_text), occurrences["item"].eqNullSafe(per_text["_item"]) & (occurrences["item_body"] == per_text["_body"])).where(F.col("n_at") >= min_share * F.col("n_text"))
    best = _consistency(occurrences, [*group, "item_body", "start"]).groupBy(*group).agg(F.max("consistent").alias("consistent"))
    return judged.unionByName(best).where(F.col("consistent") >= min_consistent)


def _consistency(uses: DataFrame, group: list[str]) -> DataFrame:
    """The share of slot uses in a group whose document value is the usual one for the item's value; 1.0 without slots."""
    uses = uses.select(*group, F.explode_outer("slots").alias("slot"))
    by_value = uses.groupBy(*group, "slot").agg(F.count_if(F.col("slot").isNotNull()).alias("n"))
    by_slot = by_value.groupBy(*group, F.col("slot.kind").alias("kind"), F.col("slot.asked").alias("asked")).agg(F.max("n").alias("usual"), F.sum("n").alias("n"))
    return by_slot.groupBy(*group).agg(F.coalesce(F.try_divide(F.sum("usual"), F.sum("n")), F.lit(1.0)).alias("consistent"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that leak an item of `benchmark`; columns unchanged.

    Rows are matched by id (a null id too) and text; see contaminated() for the cases.
    """
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("id").alias("_id"), F.col("body").alias("_body")).distinct()
    body = fresh(docs, "_text_md5")
    keyed = docs.withColumn(body, F.md5(F.col(text_col).cast("binary")))
    return keyed.join(bad, keyed[id_col].eqNullSafe(bad["_id"]) & (keyed[body] == bad["_body"]), "left_anti").drop(body)


def oracle_ctes(source: str, prefix: str = "bd") -> str:
    """DuckDB common table expressions; the last, `{prefix}_out`, has the query's columns."""
    ws = "[\\x20\\x09-\\x0D]+"
    t = "regexp_replace(text, '[<>]', ' ', 'g')"
    t = f"regexp_replace({t}, '{_NAME[0]}', '\\1{_NAME[1]}', 'g')"
    t = f"regexp_replace({t}, '({_NUMBER})([\\x20\\x09-\\x0D]+){_UNIT}([^\\p{{L}}\\p{{N}}]|$)', '<num>\\2<unit>\\4', 'g')"
    t = f"regexp_replace({t}, '{_NUMBER}{_UNIT}([^\\p{{L}}\\p{{N}}]|$)', '<num><unit>\\2', 'g')"
    t = f"lower(regexp_replace(regexp_replace({t}, '{_NUMBER}', '<num>', 'g'), '{_OTHER}', '', 'g'))"
    raw = "lower(regexp_replace(regexp_replace(text, '[<>]', ' ', 'g'), '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', '', 'g'))"

    def read(name: str, key: str, src: str) -> str:
        return f"{prefix}_{name} AS (SELECT {key} AS k, md5(text) AS body, list_filter(list_zip(string_split_regex({t}, '{ws}'), string_split_regex({raw}, '{ws}')), lambda x: x[1] <> '') AS z FROM (SELECT DISTINCT {key}, text FROM {src} WHERE text IS NOT NULL))"

    def consistency(name: str, rows: str, group: str) -> str:
        return f"""{prefix}_{name} AS (SELECT {group}, coalesce(sum(usual) / sum(n), 1.0) AS consistent FROM (
  SELECT {group}, s[1][1] AS kind, s[1][2] AS asked, max(n) AS usual, sum(n) AS n FROM (SELECT {group}, s, count(s) AS n FROM (SELECT {group}, unnest(CASE WHEN len(slots) = 0 THEN [NULL] ELSE slots END) AS s FROM {rows}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""

    whole, one = "doc_id, body, item_id, n_found, n_windows", "doc_id, body, item_id, n_found, n_windows, ib, start"
    return f"""{read("dt", "doc_id", source)},
{read("it", "item_id", "benchmark")},
{prefix}_i AS (SELECT k, body, i, size, z[i:i + size - 1] AS z, list_transform(z[i:i + size - 1], lambda x: x[1]) AS g FROM (SELECT *, unnest(range(1, len(z) - size + 2)) AS i FROM (SELECT *, least(len(z), {WINDOW}) AS size FROM {prefix}_it WHERE len(z) > 0)) WHERE len(list_filter(g, lambda x: NOT contains(x, '<'))) >= {MIN_LITERALS}),
{prefix}_d AS (SELECT k, body, i, z[i:i + size - 1] AS z, list_transform(z[i:i + size - 1], lambda x: x[1]) AS g FROM (SELECT *, unnest(range(1, len(z) - size + 2)) AS i FROM {prefix}_dt JOIN (SELECT DISTINCT size FROM {prefix}_i) ON len(z) >= size)),
{prefix}_n AS (SELECT k, count(*) AS n_windows FROM {prefix}_i GROUP BY k),
{prefix}_m AS (SELECT k, body, count(*) AS n_text FROM {prefix}_i GROUP BY ALL),
{prefix}_h AS (SELECT d.k AS doc_id, d.body, i.k AS item_id, i.body AS ib, i.i AS spot, d.i AS pos, list_filter(list_zip(i.z, d.z), lambda s: contains(s[1][1], '<')) AS slots FROM {prefix}_d d JOIN {prefix}_i i ON d.g = i.g),
{prefix}_f AS (SELECT doc_id, h.body, item_id, count(DISTINCT (ib, spot)) AS n_found, any_value(n_windows) AS n_windows FROM {prefix}_h h JOIN {prefix}_n n ON h.item_id = n.k GROUP BY ALL HAVING count(DISTINCT (ib, spot)) >= {MIN_SHARE} * any_value(n_windows)),
{prefix}_u AS (SELECT h.*, n_found, n_windows FROM {prefix}_h h JOIN {prefix}_f f ON h.doc_id IS NOT DISTINCT FROM f.doc_id AND h.body = f.body AND h.item_id = f.item_id),
{consistency("w", f"{prefix}_u", whole)},
{prefix}_p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, body, item_id, ib, start, spot ORDER BY abs(pos - spot - start), pos) AS turn FROM (SELECT u.*, unnest(range(pos - spot - {SHIFT}, pos - spot + {SHIFT + 1})) AS start FROM {prefix}_u u SEMI JOIN (SELECT * FROM {prefix}_w WHERE consistent < {MIN_CONSISTENT}) w ON u.doc_id IS NOT DISTINCT FROM w.doc_id AND u.body = w.body AND u.item_id = w.item_id)),
{prefix}_q AS (SELECT {one}, flatten(list(slots)) AS slots, count(*) AS n_at FROM {prefix}_p WHERE turn = 1 GROUP BY ALL),
{prefix}_r AS (SELECT q.* FROM {prefix}_q q JOIN {prefix}_m m ON q.item_id = m.k AND q.ib = m.body WHERE n_at >= {MIN_SHARE} * n_text),
{consistency("o", f"{prefix}_r", one)},
{prefix}_out AS (SELECT {whole}, max(consistent) AS consistent FROM (SELECT {whole}, consistent FROM {prefix}_w UNION ALL SELECT {whole}, consistent FROM {prefix}_o) WHERE consistent >= {MIN_CONSISTENT} GROUP BY ALL)"""


ORACLE_SQL = f"WITH {oracle_ctes('documents')} SELECT doc_id, item_id, CAST(n_found AS BIGINT) AS n_found, CAST(n_windows AS BIGINT) AS n_windows, consistent FROM bd_out"
