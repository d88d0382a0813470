"""Review decisions applied in order: the rows that they leave, and what each one did.

A key has at most one row: value, state, note, source. Its decisions, in order:

    propose  inserts the value as proposed by the crawler, unless there is a row
    create   inserts or overwrites it as confirmed by hand
    confirm, discard   set the state of the row that is there
    edit     sets the value (if one is given) and confirms by hand
    delete   removes the row

A note replaces the one before; no note keeps it. What needs a row and finds none is refused, as is
a propose or create without a value; a propose that finds a row is ignored.

In batch this is carried forward by windows. What a decision finds depends on the last one before it
that made or removed a row, and then on the last ones that set each field, so two passes do. Each
pass looks back within a slice of the order (a day, say) and takes the rest from the slices before,
of which there is one row each: a key with a third of all decisions is worked on by as many tasks as
it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIONS = ("propose", "confirm", "discard", "edit", "create", "delete")
FIELDS = ("value", "state", "note", "source")


def carried(rows: DataFrame, key: list[str], slice_: str, order: list[str], columns: list[str]) -> DataFrame:
    """`rows` with `before_<c>` for each column: its last non-null value in an earlier row of the key.

    `slice_` must not fall as `order` rises. Rows of one slice share a task; slices only pass on one
    row each.
    """
    inside = Window.partitionBy(*key, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key, slice_).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_end_{c}") for c in columns))
    starts = ends.select(*(F.col(k).alias(f"_key_{k}") for k in [*key, slice_]), *(F.last(f"_end_{c}", True).over(across).alias(f"_start_{c}") for c in columns))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*key, slice_]]
    here = rows.withColumns({f"before_{c}": F.last(c, True).over(inside) for c in columns})
    joined = here.join(starts, same, "left")
    return joined.select(*rows.columns, *(F.coalesce(f"before_{c}", f"_start_{c}").alias(f"before_{c}") for c in columns))


def steps(log: DataFrame, key: list[str], order: list[str], action: str = "action", value: str = "value", note: str = "note", slice_: Column | None = None) -> DataFrame:
    """`key`, `order`, action, outcome (applied, ignored or refused), and `before` and `after`, each a
    struct of the row's fields or null where there is none; one row a decision.

    `order` must tell the decisions of a key apart. `slice_` is a column that does not fall as the
    order rises; without it a key is one slice. Unknown actions are refused.
    """
    act, given = F.col(action), F.col(value)
    named = log.select(*key, *order, act.alias("action"), given.alias("_value"), F.col(note).alias("_note"), (F.lit(0) if slice_ is None else slice_).alias("_slice"))
    births = F.col("action").isin("propose", "create") & F.col("_value").isNotNull()
    live = named.withColumn("_live", F.when(births, True).when(F.col("action") == "delete", False))
    seen = carried(live, key, "_slice", order, ["_live"]).withColumn("_was", F.coalesce("before__live", F.lit(False)))
    was = F.col("_was")
    outcome = F.when(births & (F.col("action") == "propose") & was, "ignored").when(births, "applied").when(F.col("action").isin("confirm", "discard", "edit", "delete") & was, "applied").otherwise("refused")
    judged = seen.drop("before__live", "_live").withColumn("outcome", outcome)
    a, applied = F.col("action"), F.col("outcome") == "applied"
    born = applied & a.isin("propose", "create")
    sets = {
        "value": F.when(born | (applied & (a == "edit") & F.col("_value").isNotNull()), F.col("_value")),
        "state": F.when(applied, F.when(a == "propose", "proposed").when(a == "discard", "discarded").when(a.isin("create", "confirm", "edit"), "confirmed")),
        # A row that is born has no note of an earlier row of its key, so its note is set even where it is null.
        "note": F.when(born & ~was, F.struct(F.col("_note").alias("n"))).when(applied & F.col("_note").isNotNull(), F.struct(F.col("_note").alias("n"))),
        "source": F.when(applied, F.when(a == "propose", "crawler").when(a.isin("create", "edit"), "manual")),
    }
    full = carried(judged.withColumns({f"_{f}_set": c for f, c in sets.items()}), key, "_slice", order, [f"_{f}_set" for f in FIELDS])

    def row(there: Column, pick) -> Column:
        return F.when(there, F.struct(*((pick(f)["n"] if f == "note" else pick(f)).alias(f) for f in FIELDS)))

    before = row(was, lambda f: F.col(f"before__{f}_set"))
    is_there = F.when(applied, a != "delete").otherwise(was)
    after = row(is_there, lambda f: F.coalesce(f"_{f}_set", f"before__{f}_set"))
    return full.select(*key, *order, "action", "outcome", before.alias("before"), after.alias("after"))


def final_rows(done: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that all steps leave: `key`, the fields, and how many decisions took effect."""
    last = done.groupBy(*key).agg(F.max_by("after", F.struct(*order)).alias("row"), F.count_if(F.col("outcome") == "applied").alias("applied"))
    return last.where("row IS NOT NULL").select(*key, "row.*", "applied")


def audit(done: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One event for each decision of a person that took effect: action, value before and after, note."""
    return done.where("outcome = 'applied' AND action <> 'propose'").select(*key, *order, "action", F.col("before.value").alias("value_before"), F.col("after.value").alias("value_after"), F.coalesce("after.state", F.lit("deleted")).alias("state"))


def apply_one(row: tuple | None, action: str, value: str | None, note: str | None) -> tuple[tuple | None, str]:
    """One decision on one row (value, state, note, source), for keyed state in a stream: the row after it and the outcome."""
    if action in ("propose", "create") and value is not None:
        if action == "propose":
            return (row, "ignored") if row else ((value, "proposed", note, "crawler"), "applied")
        return (value, "confirmed", note if note is not None or not row else row[2], "manual"), "applied"
    if row is None or action not in ("confirm", "discard", "edit", "delete"):
        return row, "refused"
    if action == "delete":
        return None, "applied"
    kept = note if note is not None else row[2]
    if action == "edit":
        return (row[0] if value is None else value, "confirmed", kept, "manual"), "applied"
    return (row[0], "confirmed" if action == "confirm" else "discarded", kept, row[3]), "applied"
