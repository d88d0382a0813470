"""Registered queries over work in several steps: presence by evidence, review decisions, payloads, segment history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import cleaning
from regspark.operators import decisions, merge, presence, segments, sites
from regspark.plans.domain import COMPANIES_SQL, MONEY, companies, read
from regspark.sources import payload, scratch
from regspark.streaming import wrappers

# ---- presence ------------------------------------------------------------------------------


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers. Each takes its name from the title of the page of its number (of half
    of it, for suppliers), so that two owners may share a name; every fourth customer has an address
    at that page's host, others at a free provider. Owners beyond the pages keep their own name."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    titles = read(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", F.slice(F.split(title, " +"), 1, 3)).alias("title"), presence.host_of(F.col("url")).alias("host"))
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("own"), F.col("c_custkey").alias("page_id"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("own"), F.floor(F.col("s_suppkey") / 2).alias("page_id"))
    j = c.unionByName(s).join(titles, "page_id", "left")
    mail = F.when((F.col("kind") == "customer") & (F.col("id") % 4 == 0), F.concat(F.lit("info@"), F.col("host"))).otherwise(F.lit("info@gmail.com"))
    return j.select("kind", "id", F.concat_ws(" ", F.coalesce("title", "own"), F.lit("S.A.")).alias("name"), mail.alias("email"))


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.proposals(read(spark, sf_dir, "pages"), _owners(spark, sf_dir), ["kind", "id"])


def pl_propose_presence(spark, sf_dir):
    """The page proposed for each owner, by the host of its e-mail address or by a mention of its name."""
    return _proposed(spark, sf_dir)


def pl_review_queue(spark, sf_dir):
    """Proposals that are not in the table of channels yet, whatever their state there (a discarded one
    is not proposed again). The table has every seventh owner's site."""
    found = scratch.stored(_proposed(spark, sf_dir), "proposals")
    known = found.where("id % 7 = 0").select("kind", "id", "site", F.when(F.col("id") % 2 == 0, "discarded").otherwise("confirmed").alias("state"))
    new = found.select("kind", "id", "site", F.lit("proposed").alias("state"), (F.col("rule") == "mention").alias("mentions"))
    return merge.insert_if_absent(known.withColumn("mentions", F.lit(None).cast("boolean")), new, ["kind", "id", "site"]).where("state = 'proposed'").select("kind", "id", "site", "mentions")


# ---- decisions -----------------------------------------------------------------------------


def decision_log(events: DataFrame) -> DataFrame:
    """Events as decisions on a user's channel: subject, channel, ts, event_id, action, value, note."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = (
        F.when(F.col("event_type") == "signup", "propose").when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "error", "discard")
        .when(F.col("event_type") == "purchase", F.when(k % 2 == 0, "edit").otherwise("create")).when(k % 4 == 0, "delete").otherwise("propose")
    )
    return events.select(
        F.col("user_id").alias("subject"), (F.col("event_id") % 3).alias("channel"), "ts", "event_id", action.alias("action"),
        F.when(k % 5 != 0, F.concat(F.lit("v"), k)).alias("value"), F.when(k % 3 == 0, F.concat(F.lit("note "), k)).alias("note"),
    )


_DECIDED, _INORDER = ["subject", "channel"], ["ts", "event_id"]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.steps(decision_log(read(spark, sf_dir, "events")), _DECIDED, _INORDER, slice_=F.to_date("ts"))


def mg_apply_decisions(spark, sf_dir):
    """The channels that all decisions leave, applied in order."""
    return decisions.final_rows(_steps(spark, sf_dir), _DECIDED, _INORDER)


def mg_decision_audit(spark, sf_dir):
    """One audit event for each decision of a person that took effect, with the value before and after."""
    return decisions.audit(_steps(spark, sf_dir), _DECIDED, _INORDER)


def mg_decision_outcomes(spark, sf_dir):
    """How many decisions of each kind took effect, were ignored or refused."""
    return _steps(spark, sf_dir).groupBy("action", "outcome").agg(F.count("*").alias("n"))


# ---- streams -------------------------------------------------------------------------------


def ss_decision_log(spark, sf_dir):
    """The decisions as a stream with keyed state: the same rows as mg_apply_decisions."""
    path = scratch.new_folder(spark, "decisions")
    at = f"{sf_dir}/events.parquet*"  # a pattern: the source takes no path of a single file
    stream = decision_log(spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(at))
    wrappers.keep_decisions(stream, path, _DECIDED, "ts", "event_id", f"{path}-checkpoint").awaitTermination()
    return wrappers.current_decisions(spark, path, _DECIDED)


def ss_file_ingest(spark, sf_dir):
    """Two deliveries of orders merged as streams into one bucketed target: without every tenth order,
    then all but every eleventh, every seventh of them dearer; what the second lacks stays."""
    path = scratch.new_folder(spark, "orders")
    at = f"{sf_dir}/orders.parquet*"
    for job, (gone, dearer) in enumerate(((10, None), (11, 7)), 1):
        o = spark.readStream.schema(read(spark, sf_dir, "orders").schema).parquet(at).where(F.col("o_orderkey") % gone != 0)
        price = F.col("o_totalprice").cast(MONEY)
        rows = o.select(F.col("o_orderkey").alias("id"), (F.when(F.col("o_orderkey") % dearer == 0, price + 1).otherwise(price) if dearer else price).cast(MONEY).alias("price"), "o_orderdate")
        wrappers.ingest(rows, path, ["id"], ["price"], "o_orderdate", f"{path}-checkpoint-{job}", f"delivery-{job}", job).awaitTermination()
    return wrappers.read_target(spark, path).select("id", "price", "first_job", "last_job")


# ---- nested payloads -----------------------------------------------------------------------

_DOC = ["conv_id", "turn"]


def raw_payloads(turns: DataFrame) -> DataFrame:
    """Each turn of a conversation as a portal's JSON answer made of its words; every eleventh is cut off."""
    turns = turns.select(*_DOC, scratch.once(F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f]+"), lambda x: x != ""), 1, 20)).alias("w"))
    w = F.col("w")

    def part(first: int, n: int, made) -> Column:
        return F.transform(F.slice(w, first, n), made)

    doc = F.struct(
        F.struct(F.when(F.col("turn") % 5 != 0, F.concat(F.get(w, F.lit(0)), F.lit(" "))).alias("razonSocial"), F.get(w, F.lit(1)).alias("nombreComercial"), F.concat(F.lit("2020-01-0"), F.col("turn") % 9 + 1).alias("fechaInicioActividades")).alias("ruc"),
        part(4, 4, lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(x, F.lit("@mail.example"))).otherwise(F.concat(F.lit("+593 99 "), F.lpad(F.length(x).cast("string"), 3, "0"))).alias("contacto"), i.alias("tipo"))).alias("contacto"),
        part(8, 8, lambda x: F.struct(F.concat(x, F.lit(" ")).alias("dni"), F.concat(F.lit("$"), F.length(x), F.lit("00.5 USD")).alias("sueldo"), F.concat(F.lit("2021-02-"), F.lpad(F.length(x).cast("string"), 2, "0")).alias("fechaIngreso"))).alias("nomina"),
        F.struct(part(16, 3, lambda x: F.struct(x.alias("carRegistration"), (1900 + F.length(x) * 25).alias("year"))).alias("vehicle")).alias("carro"),
        F.struct(part(19, 2, lambda x: F.struct(x.alias("predio"))).alias("propiedades")).alias("propiedades"),
    )
    text = F.to_json(doc)
    cut = (F.col("conv_id") + F.col("turn")) % 11 == 0
    return turns.select(*_DOC, F.when(cut, text.substr(F.lit(1), F.length(text) - 3)).otherwise(text).alias("raw"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.items(raw_payloads(read(spark, sf_dir, "conversations")), _DOC)


def src_payload_company(spark, sf_dir):
    return payload.company_rows(_items(spark, sf_dir), _DOC).select(*_DOC, "name", "trade_name", F.col("started").cast("string").alias("started"), "employees", "wages")


def src_payload_contacts(spark, sf_dir):
    return payload.contacts(_items(spark, sf_dir), _DOC)


def src_payload_staff(spark, sf_dir):
    return payload.staff(_items(spark, sf_dir), _DOC).select(*_DOC, "person", "wage", F.col("since").cast("string").alias("since"))


def src_payload_vehicles(spark, sf_dir):
    return payload.vehicles(_items(spark, sf_dir), _DOC).select(*_DOC, "plate", "year")


def src_payload_properties(spark, sf_dir):
    return payload.properties(_items(spark, sf_dir), _DOC).select(*_DOC, "pos", F.get_json_object("content", "$.predio").alias("parcel"))


def src_payload_rejects(spark, sf_dir):
    return payload.rejects(_items(spark, sf_dir), _DOC).select(*_DOC, "reason")


# ---- segment history -----------------------------------------------------------------------

#: The first of every month of a year.
RUNS = [f"1997-{m:02d}-01" for m in range(1, 13)]
#: Segments of customers by their orders in so many days before a run: code, days, condition, least sum.
BY_ORDERS = (("active", 90, "true", 0), ("urgent", 30, "priority = '1-URGENT'", 0), ("big_spenders", 180, "true", 600_000), ("nobody_yet", 30, "price < 0", 0))
PRODUCTS = (("active", "newsletter", 3), ("big_spenders", "audit", 1), ("big_spenders", "newsletter", 3), ("urgent", "credit", 2), ("urgent", "audit", 2))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderpriority").alias("priority"))
    held = F.array(*(F.struct(F.lit(k).alias("run"), F.lit(d).cast("date").alias("on")) for k, d in enumerate(RUNS, 1)))
    members = None
    for code, days, rule, least in BY_ORDERS:
        hits = o.where(rule).select("id", "price", F.explode(F.filter(held, lambda x: (F.col("day") <= x["on"]) & (F.col("day") > F.date_sub(x["on"], days)))).alias("r"))  # noqa: B023
        some = hits.groupBy("id", F.col("r.run").alias("run")).agg(F.sum("price").alias("s")).where(F.col("s") >= least).select(F.lit(code).alias("segment"), F.lit("company").alias("kind"), "id", "run")
        members = some if members is None else members.unionByName(some)
    return segments.intervals(members, RUNS)


def _run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.run_rows(_spans(spark, sf_dir), [c for c, *_ in BY_ORDERS], RUNS)


def pl_segment_history(spark, sf_dir):
    """From when to when each customer was in each segment, over twelve monthly runs."""
    return _spans(spark, sf_dir).select("segment", "id", "entered", "left")


def pl_segment_runs(spark, sf_dir):
    """The row of every run: members, entries, exits, and events, of which first runs have none."""
    return _run_rows(spark, sf_dir)


def pl_segment_events(spark, sf_dir):
    return segments.events(_spans(spark, sf_dir), _run_rows(spark, sf_dir)).select("segment", "id", "run", "change")


def pl_segment_recent_members(spark, sf_dir):
    """Members on the 15th of June who entered within 30 days, with a contact, in one of two places, not
    handled yet (no purchase event), with their company's data."""
    c = companies(spark, sf_dir).where(F.col("section").isin("ASIA", "EUROPE", "R0", "R1", "R2") | (F.col("nation") % 2 == 0)).where("company % 3 <> 0").select(F.col("company").alias("id"), "name", "division")
    handled = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"))
    return segments.members_at(_spans(spark, sf_dir), "1997-06-15", 30).join(c, "id").join(handled, "id", "left_anti").select("segment", "id", "entered", "name", "division")


def jn_latest_run(spark, sf_dir):
    """Each segment with its last run, its members, the entries of the 30 days before and its products."""
    products = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(p).alias("product"), F.lit(k).alias("priority")) for s, p, k in PRODUCTS))))
    return segments.overview(_spans(spark, sf_dir), _run_rows(spark, sf_dir), products)


# ---- registry of sites ---------------------------------------------------------------------


def _sites(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """Two deliveries of a registry made of orders; the second lacks every seventeenth holder, has every
    order, and moves the sites of every seventh."""
    t, o = F.col("o_custkey") % 1400, F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").where(o % 10 != 0 if number == 1 else t % 17 != 0)
    place = F.when((o % 7 == 0) & F.lit(number == 2), F.lit("MOVED")).otherwise(F.col("o_orderpriority"))
    return rows.select(
        F.lpad(t.cast("string"), 13, "0").alias("tax_id"), F.when(t % 3 == 0, "PERSONA NATURAL").otherwise("SOCIEDAD").alias("taxpayer"), F.lpad((o % 40).cast("string"), 3, "0").alias("site"),
        F.concat(F.lit("Holder "), t).alias("name"), F.when(t % 5 == 0, "PASIVO").otherwise("ACTIVO").alias("state"), place.alias("province"), (t % 2 == 0).alias("keeps_books"), F.col("o_orderstatus").alias("site_state"), F.concat(F.lit("G"), o % 9).alias("activity"),
    )


def _site_merge(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    known = companies(spark, sf_dir).where("company % 4 < 2").select("company", "tax_id")
    first, second = (sites.staged(_sites(spark, sf_dir, n), known) for n in (1, 2))
    target = sites.merged(None, first, kind, 1).where("status = 'inserted'").drop("status")
    return sites.merged(target, second, kind, 2).select(*sites.KEYS[kind], *sites.VALUES[kind], "first_job", "last_job", "missing_since", "status")


def pl_site_persons(spark, sf_dir):
    return _site_merge(spark, sf_dir, "person")


def pl_site_unsupervised(spark, sf_dir):
    return _site_merge(spark, sf_dir, "unsupervised")


def pl_site_companies(spark, sf_dir):
    return _site_merge(spark, sf_dir, "company")


def pl_site_establishments(spark, sf_dir):
    return _site_merge(spark, sf_dir, "establishment")


_NORMAL = "regexp_replace(upper(replace(strip_accents({0}), 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g')"
_TEXT = "regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
_OUT = ", ".join(f"'{w}'" for w in [*presence.LEGAL_WORDS, *(w.upper() for w in presence.GENERIC_WORDS)])
_PRESENCE = f"""WITH title AS (SELECT page_id, array_to_string(string_split_regex(regexp_extract(html, '<title>([^<]*)</title>', 1), ' +')[1:3], ' ') AS title, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host FROM pages),
o AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS own, c_custkey AS page_id FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_suppkey // 2 FROM supplier),
owner AS (SELECT kind, id, coalesce(title, own) || ' S.A.' AS name, CASE WHEN kind = 'customer' AND id % 4 = 0 THEN host END AS domain FROM o LEFT JOIN title USING (page_id)),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split({_NORMAL.format('name')}, ' '), lambda x: length(x) >= 4 AND x NOT IN ({_OUT})))) AS words FROM owner),
p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, 'https://' || regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS site, ' ' || {_NORMAL.format(_TEXT)} || ' ' AS text FROM pages WHERE NOT ({" OR ".join(f"contains(lower(strip_accents({_TEXT})), '{x}')" for x in presence.PARKED)})),
hit AS (SELECT kind, id, w.words, page_id, host = domain AS own, site FROM w, p WHERE host = domain OR (len(words) > 0 AND len(list_filter(words, lambda x: NOT contains(text, ' ' || x || ' '))) = 0)),
proposed AS (SELECT kind, id, page_id, CASE WHEN own THEN 'email' ELSE 'mention' END AS rule, site, array_to_string(words, ' ') AS words FROM hit QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY coalesce(own, false) DESC, page_id) = 1)"""

_STEPS = """WITH RECURSIVE k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT user_id AS subject, event_id % 3 AS channel, ts, event_id, CASE event_type WHEN 'signup' THEN 'propose' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'discard' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'edit' ELSE 'create' END ELSE CASE WHEN k % 4 = 0 THEN 'delete' ELSE 'propose' END END AS action,
  CASE WHEN k % 5 <> 0 THEN 'v' || k END AS value, CASE WHEN k % 3 = 0 THEN 'note ' || k END AS note, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS i FROM k),
step AS (SELECT subject, channel, 0 AS i, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id, '' AS action, '' AS outcome, false AS was, false AS live, CAST(NULL AS VARCHAR) AS value_before, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS source FROM log WHERE i = 1
UNION ALL SELECT subject, channel, i, ts, event_id, action, outcome, was, CASE WHEN outcome <> 'applied' THEN was ELSE action <> 'delete' END, CASE WHEN was THEN old_value END,
  CASE WHEN outcome <> 'applied' THEN old_value WHEN action = 'delete' THEN NULL WHEN action IN ('propose', 'create', 'edit') THEN coalesce(new_value, old_value) ELSE old_value END,
  CASE WHEN outcome <> 'applied' THEN old_state WHEN action = 'delete' THEN NULL WHEN action = 'propose' THEN 'proposed' WHEN action = 'discard' THEN 'discarded' ELSE 'confirmed' END,
  CASE WHEN outcome <> 'applied' THEN old_note WHEN action = 'delete' THEN NULL ELSE coalesce(new_note, old_note) END,
  CASE WHEN outcome <> 'applied' THEN old_source WHEN action = 'delete' THEN NULL WHEN action = 'propose' THEN 'crawler' WHEN action IN ('create', 'edit') THEN 'manual' ELSE old_source END
  FROM (SELECT l.subject, l.channel, l.i, l.ts, l.event_id, l.action, s.live AS was, l.value AS new_value, l.note AS new_note, s.value AS old_value, s.state AS old_state, s.note AS old_note, s.source AS old_source,
    CASE WHEN l.action = 'propose' AND l.value IS NOT NULL AND s.live THEN 'ignored' WHEN l.action IN ('propose', 'create') AND l.value IS NOT NULL THEN 'applied' WHEN l.action IN ('confirm', 'discard', 'edit', 'delete') AND s.live THEN 'applied' ELSE 'refused' END AS outcome
    FROM step s JOIN log l ON l.subject = s.subject AND l.channel = s.channel AND l.i = s.i + 1))"""

_CLEAN = "trim(regexp_replace({0}, '[\\x00-\\x20\\x7f\\x{{a0}}\\x{{fffd}}]+', ' ', 'g'))"
_NULLIFY = f"CASE WHEN upper(strip_accents({_CLEAN})) NOT IN ({', '.join(repr(x) for x in cleaning.BLANKS)}) THEN {_CLEAN} END"
_WORDS = f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM conversations), d AS (SELECT * FROM w WHERE (conv_id + turn) % 11 <> 0),
c AS (SELECT conv_id, turn, i, CASE WHEN i % 2 = 0 THEN x || '@mail.example' ELSE '+593 99 ' || lpad(CAST(length(x) AS VARCHAR), 3, '0') END AS value FROM (SELECT conv_id, turn, unnest(w[4:7]) AS x, generate_subscripts(w[4:7], 1) - 1 AS i FROM d)),
contact AS (SELECT conv_id, turn, {_NULLIFY.format('value')} AS value, CASE WHEN regexp_full_match({_CLEAN.format('value')}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'email' WHEN i % 2 = 1 THEN 'phone' ELSE 'unknown' END AS kind, CAST(i AS VARCHAR) AS code FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn, {_NULLIFY.format('value')} ORDER BY i) = 1),
s AS (SELECT conv_id, turn, i, x, {_NULLIFY.format('x')} AS person FROM (SELECT conv_id, turn, unnest(w[8:15]) AS x, generate_subscripts(w[8:15], 1) AS i FROM d)),
staff AS (SELECT conv_id, turn, person, length(x) * 100 + 0.5::DOUBLE AS wage, CAST(TRY_CAST('2021-02-' || lpad(CAST(length(x) AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS since FROM s WHERE person IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn, person ORDER BY i) = 1),
v AS (SELECT conv_id, turn, i, x, {_NULLIFY.format('x')} AS plate FROM (SELECT conv_id, turn, unnest(w[16:18]) AS x, generate_subscripts(w[16:18], 1) AS i FROM d)),
vehicle AS (SELECT conv_id, turn, plate, CASE WHEN 1900 + length(x) * 25 <= 2100 THEN CAST(1900 + length(x) * 25 AS INTEGER) END AS year FROM v WHERE plate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn, plate ORDER BY i) = 1),
company AS (SELECT conv_id, turn, {_NULLIFY.format('w[1]')} AS name, {_NULLIFY.format('w[2]')} AS trade_name, '2020-01-0' || (turn % 9 + 1) AS started FROM d WHERE turn % 5 <> 0)"""
_HISTORY = "WITH runs(run, held_on) AS (VALUES " + ", ".join(f"({k}, DATE '{d}')" for k, d in enumerate(RUNS, 1)) + "), o AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS priority FROM orders), m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS segment, id, run FROM o JOIN runs ON day <= held_on AND day > held_on - {d} WHERE {r} GROUP BY id, run HAVING sum(price) >= {n}" for c, d, r, n in BY_ORDERS) + """),
i AS (SELECT *, run - row_number() OVER (PARTITION BY segment, id ORDER BY run) AS island FROM m),
span AS (SELECT segment, id, min(run) AS first_run, max(run) AS last_run FROM i GROUP BY segment, id, island),
history AS (SELECT segment, id, a.held_on AS entered, b.held_on AS \"left\", first_run, last_run FROM span JOIN runs a ON a.run = first_run LEFT JOIN runs b ON b.run = last_run + 1),
codes(segment) AS (VALUES """ + ", ".join(f"('{c}')" for c, *_ in BY_ORDERS) + """),
r AS (SELECT segment, run, held_on, (SELECT count(*) FROM m WHERE m.segment = codes.segment AND m.run = runs.run) AS total, (SELECT count(*) FROM span WHERE span.segment = codes.segment AND first_run = run) AS entries, (SELECT count(*) FROM span WHERE span.segment = codes.segment AND last_run + 1 = run) AS exits FROM codes, runs),
run_rows AS (SELECT *, CASE WHEN exits = 0 AND entries = total THEN 0 ELSE entries + exits END AS events FROM r)"""
_PRODUCTS = "products(segment, product, priority) AS (VALUES " + ", ".join(f"('{s}', '{p}', {k})" for s, p, k in PRODUCTS) + ")"


def _site_sql(kind: str) -> str:
    """The merge of both deliveries: each aggregated by itself, then compared column by column."""
    key, values = sites.KEYS[kind], sites.VALUES[kind]
    by = "tax_id, site" if kind == "establishment" else "tax_id"
    least = "(site, taxpayer, name, state, province, keeps_books, site_state, activity)"
    picked = ", ".join(f"arg_min({c}, {least}) AS {c}" for c in ("taxpayer", "name", "state", "province", "keeps_books", "site_state", "activity"))
    made = lambda n, rule, place: f"r{n} AS (SELECT lpad(CAST(o_custkey % 1400 AS VARCHAR), 13, '0') AS tax_id, CASE WHEN o_custkey % 1400 % 3 = 0 THEN 'PERSONA NATURAL' ELSE 'SOCIEDAD' END AS taxpayer, lpad(CAST(o_orderkey % 40 AS VARCHAR), 3, '0') AS site, 'Holder ' || (o_custkey % 1400) AS name, CASE WHEN o_custkey % 1400 % 5 = 0 THEN 'PASIVO' ELSE 'ACTIVO' END AS state, {place} AS province, o_custkey % 1400 % 2 = 0 AS keeps_books, o_orderstatus AS site_state, 'G' || (o_orderkey % 9) AS activity FROM orders WHERE {rule}), g{n} AS (SELECT {by}, {picked}, count(*) AS sites FROM r{n} GROUP BY ALL)"
    which = {"person": "taxpayer = 'PERSONA NATURAL'", "unsupervised": "taxpayer = 'SOCIEDAD' AND tax_id NOT IN (SELECT tax_id FROM known)", "company": "taxpayer = 'SOCIEDAD' AND tax_id IN (SELECT tax_id FROM single)", "establishment": "true"}[kind]
    shown = ", ".join({"class": "CASE WHEN keeps_books THEN 'natural_keeps_books' ELSE 'natural' END AS class", "company": "(SELECT company FROM single s WHERE s.tax_id = g.tax_id) AS company"}.get(v, v) for v in values)
    same = " AND ".join(f"a.{v} IS NOT DISTINCT FROM b.{v}" for v in values)
    on = " AND ".join(f"a.{k} = b.{k}" for k in key)
    back = ", ".join([*(f"coalesce(b.{k}, a.{k}) AS {k}" for k in key), *(f"CASE WHEN b.tax_id IS NULL THEN a.{v} ELSE b.{v} END AS {v}" for v in values)])
    return f"""WITH {COMPANIES_SQL}, known AS (SELECT company, tax_id FROM companies WHERE company % 4 < 2), single AS (SELECT tax_id, min(company) AS company FROM known GROUP BY 1 HAVING count(*) = 1),
{made(1, 'o_orderkey % 10 <> 0', 'o_orderpriority')}, {made(2, 'o_custkey % 1400 % 17 <> 0', "CASE WHEN o_orderkey % 7 = 0 THEN 'MOVED' ELSE o_orderpriority END")},
a AS (SELECT {by}, {shown} FROM g1 g WHERE {which}), b AS (SELECT {by}, {shown} FROM g2 g WHERE {which})
SELECT {back}, CASE WHEN a.tax_id IS NULL THEN 2 ELSE 1 END AS first_job, CASE WHEN b.tax_id IS NULL OR (a.tax_id IS NOT NULL AND {same}) THEN 1 ELSE 2 END AS last_job, CASE WHEN b.tax_id IS NULL THEN 2 END AS missing_since,
  CASE WHEN b.tax_id IS NULL THEN 'missing' WHEN a.tax_id IS NULL THEN 'inserted' WHEN {same} THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL JOIN b ON {on}"""


ORACLE_SQL = {
    "pl_site_persons": _site_sql("person"),
    "pl_site_unsupervised": _site_sql("unsupervised"),
    "pl_site_companies": _site_sql("company"),
    "pl_site_establishments": _site_sql("establishment"),
    "src_payload_company": _WORDS + " SELECT c.conv_id, c.turn, name, trade_name, started, coalesce(n, 0) AS employees, wages FROM company c LEFT JOIN (SELECT conv_id, turn, count(*) AS n, sum(wage) AS wages FROM staff GROUP BY ALL) s ON c.conv_id = s.conv_id AND c.turn = s.turn WHERE name IS NOT NULL",
    "src_payload_contacts": _WORDS + " SELECT * FROM contact WHERE value IS NOT NULL",
    "src_payload_staff": _WORDS + " SELECT * FROM staff",
    "src_payload_vehicles": _WORDS + " SELECT * FROM vehicle",
    "src_payload_properties": _WORDS + " SELECT conv_id, turn, CAST(generate_subscripts(w[19:20], 1) - 1 AS INTEGER) AS pos, unnest(w[19:20]) AS parcel FROM d",
    "src_payload_rejects": "SELECT conv_id, turn, 'not_json' AS reason FROM conversations WHERE (conv_id + turn) % 11 = 0",
    "pl_segment_history": _HISTORY + " SELECT segment, id, entered, \"left\" FROM history",
    "pl_segment_runs": _HISTORY + " SELECT * FROM run_rows",
    "pl_segment_events": _HISTORY + ", e AS (SELECT segment, id, first_run AS run, 'entry' AS change FROM span UNION ALL SELECT segment, id, last_run + 1, 'exit' FROM span) SELECT e.* FROM e JOIN run_rows r ON e.segment = r.segment AND e.run = r.run WHERE events > 0",
    "pl_segment_recent_members": _HISTORY + f", {COMPANIES_SQL} SELECT history.segment, id, entered, name, division FROM history JOIN companies ON id = company WHERE entered <= DATE '1997-06-15' AND (\"left\" IS NULL OR \"left\" > DATE '1997-06-15') AND entered > DATE '1997-06-15' - 30 AND (section IN ('ASIA', 'EUROPE', 'R0', 'R1', 'R2') OR nation % 2 = 0) AND company % 3 <> 0 AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "jn_latest_run": _HISTORY + f", {_PRODUCTS} SELECT r.segment, run AS last_run, held_on, total AS members, (SELECT CAST(sum(entries) AS BIGINT) FROM run_rows e WHERE e.segment = r.segment AND e.held_on > DATE '{RUNS[-1]}' - 30) AS entries, (SELECT string_agg(product, ',' ORDER BY priority, product) FROM products p WHERE p.segment = r.segment) AS products FROM run_rows r WHERE run = {len(RUNS)}",
    "mg_apply_decisions": _STEPS + " SELECT subject, channel, value, state, note, source, applied FROM (SELECT *, count(*) FILTER (WHERE outcome = 'applied') OVER (PARTITION BY subject, channel) AS applied FROM step QUALIFY row_number() OVER (PARTITION BY subject, channel ORDER BY i DESC) = 1) WHERE live",
    "ss_file_ingest": "WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) SELECT id, CAST(CASE WHEN id % 7 = 0 AND id % 11 <> 0 THEN price + 1 ELSE price END AS DECIMAL(18,2)) AS price, CASE WHEN id % 10 <> 0 THEN 1 ELSE 2 END AS first_job, CASE WHEN id % 11 <> 0 AND (id % 7 = 0 OR id % 10 = 0) THEN 2 ELSE 1 END AS last_job FROM o WHERE id % 10 <> 0 OR id % 11 <> 0",
    "mg_decision_audit": _STEPS + " SELECT subject, channel, ts, event_id, action, value_before, value AS value_after, coalesce(state, 'deleted') AS state FROM step WHERE outcome = 'applied' AND action <> 'propose'",
    "mg_decision_outcomes": _STEPS + " SELECT action, outcome, count(*) AS n FROM step WHERE i > 0 GROUP BY ALL",
    "pl_propose_presence": _PRESENCE + " SELECT * FROM proposed",
    "pl_review_queue": _PRESENCE + " SELECT kind, id, site, rule = 'mention' AS mentions FROM proposed WHERE id % 7 <> 0",
}
ORACLE_SQL["ss_decision_log"] = ORACLE_SQL["mg_apply_decisions"]

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
