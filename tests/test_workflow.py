"""Decisions, streams, presence, payloads and segment history against brute force on small tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from regspark.operators import decisions, merge, presence, segments, sites
from regspark.sources import payload
from regspark.streaming import wrappers

KEY, ORDER = ["subject"], ["ts", "event_id"]


def random_log(n, seed, hot=0.34):
    """Decisions on few subjects, a third of them on one, with ties in time, null values and notes."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        subject = "hot" if r.random() < hot else f"s{r.randint(0, 9)}"
        rows.append((subject, r.randint(0, n // 2) * 60, i, r.choice([*decisions.ACTIONS, "propose", "create", "unheard"]), r.choice([None, "a", "b", "c"]), r.choice([None, None, "n1", "n2"])))
    return rows


def folded(rows):
    """Every decision one by one: steps by event id, and the rows at the end."""
    state, applied, steps = {}, {}, {}
    for subject, ts, i, action, value, note in sorted(rows, key=lambda x: (x[1], x[2])):
        before = state.get(subject)
        after, outcome = decisions.apply_one(before, action, value, note)
        state[subject] = after
        applied[subject] = applied.get(subject, 0) + (outcome == "applied")
        steps[i] = (outcome, before, after)
    return steps, {s: (*row, applied[s]) for s, row in state.items() if row}


def log_frame(spark, rows):
    return spark.createDataFrame(rows, "subject string, at long, event_id long, action string, value string, note string").withColumn("ts", F.timestamp_seconds("at")).drop("at")


@pytest.mark.parametrize("slice_", [None, "day", "minute"])
def test_decisions_against_one_by_one(spark, slice_):
    rows = random_log(900, 7) + [(None, 5, 10_000, "create", "x", None), (None, 6, 10_001, "discard", None, "why")]
    by = F.date_trunc(slice_, "ts") if slice_ else None
    done = decisions.steps(log_frame(spark, rows).repartition(7), KEY, ORDER, slice_=by)
    steps, final = folded(rows)
    got = {r["event_id"]: (r["outcome"], tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None) for r in done.collect()}
    assert got == steps
    assert {r["subject"]: tuple(r)[1:] for r in decisions.final_rows(done, KEY, ORDER).collect()} == final
    assert decisions.audit(done, KEY, ORDER).count() == sum(o == "applied" for i, (o, *_) in steps.items()) - sum(o == "applied" and a == "propose" for _, _, i, a, *_ in rows for o in [steps[i][0]])


def test_no_decisions(spark):
    done = decisions.steps(log_frame(spark, []), KEY, ORDER, slice_=F.to_date("ts"))
    assert done.count() == 0 and decisions.final_rows(done, KEY, ORDER).count() == 0


def test_decision_stream_equals_batch(spark, tmp_path):
    """File by file, with decisions out of order within the watermark, ids repeated, and a restart."""
    rows = sorted(random_log(400, 8), key=lambda x: (x[1], x[2]))
    parts = [rows[k : k + 100] for k in range(0, 400, 100)]
    for k in range(3):  # the last ones of a part come with the next
        parts[k], moved = parts[k][:-8], parts[k][-8:]
        parts[k + 1] = moved + parts[k + 1] + moved[:2]
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = log_frame(spark, []).schema
    for upto, part in enumerate(parts):
        log_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        if upto in (1, 3):  # two parts, then the query is started again from its checkpoint
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            wrappers.keep_decisions(stream, target, KEY, "ts", "event_id", checkpoint, "3 hours").awaitTermination()
    assert {r["subject"]: tuple(r)[1:] for r in wrappers.current_decisions(spark, target, KEY).collect()} == folded(rows)[1]
    assert len([d for d in os.listdir(target) if d.startswith("batch=")]) >= 4


def mtimes(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_ingest_touches_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = [(k, f"v{k}", 1) for k in range(400)]

    def batch(rows, n):
        return wrappers.publish(spark.createDataFrame(rows, "id int, x string, n int"), path, ["id"], ["x"], "n", n, buckets=16)

    assert batch(rows, 0) == list(range(16))
    before = mtimes(f"{path}/rows")
    assert batch([(3, "new", 2), (3, "newer", 3), (4, "v4", 2)], 1) and len(mtimes(f"{path}/rows")) == 16
    after = mtimes(f"{path}/rows")
    assert len(set(before.items()) - set(after.items())) == 1  # one bucket; that of the unchanged row stays as it was
    assert batch([(3, "other", 9)], 1) == [] and mtimes(f"{path}/rows") == after  # a committed batch is not read again
    assert batch([(3, "newer", 3), (900, "added", 1)], 2) and {r["x"] for r in wrappers.read_target(spark, path).where("id IN (3, 900)").collect()} == {"newer", "added"}


def test_ingest_after_a_crash_before_the_marker(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "target")
    df = spark.createDataFrame([(k, f"v{k}", 1) for k in range(50)], "id int, x string, n int")
    real = wrappers.scratch.remove

    def crash(*_):
        raise RuntimeError("lost")

    wrappers.publish(df, path, ["id"], ["x"], "n", 0, buckets=4)
    changed = df.withColumn("x", F.lit("again")).where("id < 5")
    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", crash)  # the marker is not written
        with pytest.raises(RuntimeError):
            wrappers.publish(changed, path, ["id"], ["x"], "n", 1, buckets=4)
    written = mtimes(f"{path}/rows")
    assert wrappers.publish(changed, path, ["id"], ["x"], "n", 1, buckets=4) == [] and mtimes(f"{path}/rows") == written
    assert wrappers.read_target(spark, path).where("x = 'again'").count() == 5 and wrappers.scratch.remove is real


def test_ingest_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "target")
    for part in ([(1, "b", 1), (2, "c", 2), (1, "d", 3)], [(2, "e", 1), (3, "f", 1)]):
        spark.createDataFrame(part, "id int, x string, n int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, x string, n int").parquet(source)
        wrappers.ingest(stream, path, ["id"], ["x"], "n", str(tmp_path / "c")).awaitTermination()
    assert {(r["id"], r["x"], r["first_job"]) for r in wrappers.read_target(spark, path).collect()} == {(1, "d", 1), (2, "e", 1), (3, "f", 2)}


def test_deduplicated_and_counted_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    log_frame(spark, [("a", 60, 1, "propose", "x", None), ("a", 60, 1, "propose", "x", None), ("b", 4000, 2, "discard", None, None)]).write.parquet(source)
    stream = wrappers.deduplicated(spark.readStream.schema(log_frame(spark, []).schema).parquet(source), "event_id", "ts")
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    counts = wrappers.windowed_counts(spark.readStream.schema(log_frame(spark, []).schema).parquet(source), "ts", "action")
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["action"], r["n"]) for r in spark.table("counted").collect()} == {("propose", 2), ("discard", 1)}


# ---- presence ------------------------------------------------------------------------------


def page(text, title="t"):
    return f"<html><title>{title}</title><script>var ACME = 1</script><body><p>{text}</p></body></html>"


def test_proposals_by_evidence(spark):
    pages = [(1, "https://www.one.ec/x", page("Bienvenidos a Tornillos Pacífico del sur")), (2, "http://two.ec", page("tornillos de acero")), (3, "https://mail.ec/a", page("nada")), (4, "https://mail.ec/b", page("dominio en venta")), (0, "https://parked.ec", page("Tornillos Pacifico: dominio en venta")), (9, None, None), (10, "https://three.ec", page("Zapatos Andes Quito Norte"))]
    owners = [(1, "Tornillos Pacífico S.A.", None), (2, "TORNILLOS PACIFICO CIA LTDA", "x@gmail.com"), (3, "Otra", "ventas@MAIL.ec "), (4, "Importadora S.A.", None), (5, None, None), (6, "Tornillos Ausentes", "a@parked.ec"), (7, "Zapatos Andes Quito Norte", None), (8, "Zapatos Andes Quito Oeste", "nobody")]
    got = presence.proposals(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(owners, "id long, name string, email string"), ["id"])
    assert {(r["id"], r["page_id"], r["rule"], r["site"]) for r in got.collect()} == {(1, 1, "mention", "https://one.ec"), (2, 1, "mention", "https://one.ec"), (3, 3, "email", "https://mail.ec"), (7, 10, "mention", "https://three.ec")}


def test_mentions_with_hot_words(spark):
    """A third of the pages hold one word of half the names: names meet them by their rarest word."""
    r = random.Random(2)
    words = [f"WORD{k}" for k in range(30)]
    page_words = {(p, w) for p in range(120) for w in r.sample(words, 6)} | {(p, "HOTWORD") for p in range(40)}
    owners = [(k, sorted({*r.sample(words, r.randint(0, 4)), *(["HOTWORD"] if k % 2 else [])})) for k in range(80)]
    got = presence.name_mentions(spark.createDataFrame(owners, "owner long, words array<string>"), spark.createDataFrame(sorted(page_words), "page long, word string"))
    expected = {(tuple(w), p) for _, w in owners if w for p in range(120) if all((p, x) in page_words for x in w)}
    assert {(tuple(x["name_key"]), x["page"]) for x in got.collect()} == expected


def test_insert_if_absent_keeps_what_is_there(spark):
    old = spark.createDataFrame([(1, "a", "discarded")], "id int, site string, state string")
    new = spark.createDataFrame([(1, "a", "proposed"), (1, "b", "proposed")], "id int, site string, state string")
    assert {tuple(r) for r in merge.insert_if_absent(old, new, ["id", "site"]).collect()} == {(1, "a", "discarded"), (1, "b", "proposed")}


# ---- nested payloads -----------------------------------------------------------------------


def test_payload_tables(spark):
    full = {
        "ruc": {"razonSocial": "ACME ", "telefono": 123, "fechaInicioActividades": "2020-01-05T00:00"},
        "contacto": [{"contacto": "a@b.ec", "tipo": 8}, {"contacto": "a@b.ec", "tipo": 3}, {"contacto": "+593 99 111", "tipo": 3}, {"contacto": "x"}, {"contacto": " - "}, 5],
        "nomina": [{"dni": "1 ", "sueldo": "1,200.5 USD"}, {"dni": "1", "sueldo": "7"}, {"dni": "2", "sueldo": None}, {"sueldo": 9}],
        "carro": {"vehicle": [{"carRegistration": "P1", "year": "2019.7", "cylinderCapacity": "9999999"}]},
        "propiedades": [{"predio": 1}, {"predio": 1}],
    }
    raw = [("a", json.dumps(full)), ("a", json.dumps(full)), ("b", "{bad"), ("c", None), ("d", "[1]"), ("e", '{"ruc": {}}'), ("f", "{}"), ("g", '{"carro": [{"carRegistration": "Q", "year": 1800}], "nomina": {"x": 1}}'), (None, '{"ruc": {"razonSocial": "No key"}}')]
    items = payload.items(spark.createDataFrame(raw, "id string, raw string").withColumns({"kind": F.lit("mine"), "item": F.lit("mine")}), ["id"])
    assert {tuple(r) for r in payload.contacts(items, ["id"]).collect()} == {("a", "a@b.ec", "email", "8"), ("a", "+593 99 111", "phone", "3"), ("a", "x", "unknown", None)}
    assert {(r["id"], r["person"], r["wage"]) for r in payload.staff(items, ["id"]).collect()} == {("a", "1", 1200.5), ("a", "2", None)}
    assert {(r["plate"], r["year"], r["engine"]) for r in payload.vehicles(items, ["id"]).collect()} == {("P1", 2019, None), ("Q", None, None)}
    assert {(r["id"], r["name"], r["employees"], r["wages"]) for r in payload.company_rows(items, ["id"]).collect()} == {("a", "ACME", 2, 1200.5), (None, "No key", 0, None)}
    assert {(r["id"], r["reason"]) for r in payload.rejects(items, ["id"]).collect()} == {("b", "not_json"), ("c", "empty"), ("d", "no_object")}
    assert payload.properties(items, ["id"]).count() == 4


def test_payload_is_parsed_in_one_scan(spark, tmp_path):
    """Written by kind, the tables come from one pass over the raw answers."""
    spark.createDataFrame([("a", '{"nomina": [{"dni": "1"}], "contacto": [{"contacto": "z@y.x"}]}')], "id string, raw string").write.parquet(f"{tmp_path}/raw")
    payload.items(spark.read.parquet(f"{tmp_path}/raw"), ["id"]).write.partitionBy("kind").parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    assert payload.staff(items, ["id"]).count() == 1 and payload.contacts(items, ["id"]).first()["value"] == "z@y.x"


# ---- segment history -----------------------------------------------------------------------


def test_history_against_run_by_run(spark):
    r = random.Random(6)
    dates = [f"2024-{m:02d}-01" for m in range(1, 9)]
    members = {("s", "k", i, run) for i in range(30) for run in range(1, 9) if r.random() < 0.6} | {("t", "k", i, run) for i in range(3) for run in (4, 5, 8)}
    spans = segments.intervals(spark.createDataFrame(sorted(members) * 2, "segment string, kind string, id long, run int"), dates)
    got = spans.collect()
    assert {(x["segment"], x["kind"], x["id"], run) for x in got for run in range(x["first_run"], x["last_run"] + 1)} == members
    assert all((x["segment"], "k", x["id"], x["first_run"] - 1) not in members and (x["segment"], "k", x["id"], x["last_run"] + 1) not in members for x in got)
    rows = {(x["segment"], x["run"]): (x["total"], x["entries"], x["exits"], x["events"]) for x in segments.run_rows(spans, ["s", "t", "empty"], dates).collect()}
    for s in ("s", "t", "empty"):
        for run in range(1, 9):
            now, before = ({i for g, _, i, k in members if (g, k) == (s, n)} for n in (run, run - 1))
            entries, exits = len(now - before), len(before - now)
            assert rows[s, run] == (len(now), entries, exits, 0 if exits == 0 and entries == len(now) else entries + exits)
    news = segments.events(spans, segments.run_rows(spans, ["s", "t"], dates))
    assert news.where("segment = 't'").count() == 3 and news.where("segment = 't' AND change = 'exit' AND run = 6").count() == 3
    for run, date in ((5, "2024-05-01"), (5, "2024-05-20")):
        assert {(x["segment"], x["id"]) for x in segments.members_at(spans, date).collect()} == {(g, i) for g, _, i, k in members if k == run}
    assert {x["id"] for x in segments.members_at(spans, "2024-04-20", 30).where("segment = 't'").collect()} == {0, 1, 2} and segments.members_at(spans, "2024-05-20", 30).where("segment = 't'").count() == 0


def test_inactive_segments_are_refused(spark):
    profile = spark.createDataFrame([("supplier", 1, True)], "kind string, id long, in_force boolean").withColumns({c: F.lit(None).cast("int") for c in ("first_year", "last_assets", "previous_assets")}).withColumns({"keeps_books": F.lit(True), "contact": F.lit("c")})
    assert {r["segment"] for r in segments.evaluate(profile, 2000, only=["reachable"]).collect()} == {"reachable"}
    for code in ("retired", "unheard"):
        with pytest.raises(segments.InactiveSegment):
            segments.evaluate(profile, 2000, only=["reachable", code])


# ---- registry of sites ---------------------------------------------------------------------


def test_sites_fan_out(spark):
    columns = "tax_id string, taxpayer string, site string, name string, state string, province string, keeps_books boolean, site_state string, activity string"
    rows = [("1", "PERSONA NATURAL", "002", "Ana", "A", "Loja", True, "open", "G1"), ("1", "PERSONA NATURAL", "001", "Ana", "A", " quito ", True, "shut", "G2"), ("2", "SOCIEDAD", "001", "Dos", "A", "Quito", None, "open", "G3"), ("3", "SOCIEDAD", "001", "Tres", "P", "Quito", False, "open", "G4"), ("4", "SOCIEDAD", "001", "Cuatro", "P", "Quito", False, "open", "G5"), (None, "SOCIEDAD", "001", "x", "A", "Quito", True, "open", "G6"), ("5", "OTRO", None, "Cinco", "A", "Loja", None, "open", None)]
    rows += [("6", "PERSONA NATURAL", f"{k:04d}", "Hot", "A", "Loja", None, "open", "G7") for k in range(40)] * 2
    companies = spark.createDataFrame([(10, "3"), (11, "4"), (12, "4"), (13, None)], "company long, tax_id string")
    stage = sites.staged(spark.createDataFrame(rows, columns).repartition(5), companies)
    got = {(r["kind"], r["tax_id"]): (r["class"], r["province"], r["sites"], r["company"]) for r in stage.where("kind <> 'establishment'").collect()}
    assert got == {("person", "1"): ("natural_keeps_books", " quito ", 2, None), ("person", "6"): ("natural", "Loja", 80, None), ("unsupervised", "2"): (None, "Quito", 1, None), ("company", "3"): (None, "Quito", 1, 10)}  # 4 belongs to two companies
    assert stage.where("kind = 'establishment'").count() == 2 + 3 + 1 + 40
    assert {r["tax_id"] for r in sites.staged(spark.createDataFrame(rows, columns), companies, "QUITO").where("kind <> 'establishment'").collect()} == {"1", "2", "3"}
    shown = stage._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Generate explode") == 1  # the rows are read once for all four


def test_sites_are_merged_under_their_own_fingerprints(spark):
    columns = "tax_id string, taxpayer string, site string, name string, state string, province string, keeps_books boolean, site_state string, activity string"
    companies = spark.createDataFrame([], "company long, tax_id string")
    one = [("1", "PERSONA NATURAL", s, "Ana", "A", "Loja", True, "open", "G1") for s in ("001", "002")]
    two = [one[0], ("1", "PERSONA NATURAL", "002", "Ana", "A", "Loja", True, "shut", "G1")]
    status = {}
    for kind in ("person", "establishment"):
        target = sites.merged(None, sites.staged(spark.createDataFrame(one, columns), companies), kind, 1).drop("status")
        status[kind] = sorted(r["status"] for r in sites.merged(target, sites.staged(spark.createDataFrame(two, columns), companies), kind, 2).collect())
    assert status == {"person": ["unchanged"], "establishment": ["unchanged", "updated"]}


def test_decision_state_is_held_by_shard(spark, tmp_path):
    """Many keys of two columns, one of them null at times, in few states: as few calls, and the same rows."""
    rows = [(f"s{k % 150}" if k % 7 else None, k % 3, 60 * (1 + k // 4), k, decisions.ACTIONS[k * k % 6], f"v{k % 5}", None if k % 2 else f"n{k}") for k in range(900)]
    frame = spark.createDataFrame(rows, "subject string, channel int, at long, event_id long, action string, value string, note string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    frame.coalesce(1).write.parquet(source)
    stream = wrappers.decision_states(spark.readStream.schema(frame.schema).parquet(source), ["subject", "channel"], "ts", "event_id", shards=5)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.parquet(f"{target}/batch={batch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 5  # states, where there was one a key
    _, final = folded([((s, c), *rest) for s, c, *rest in rows])
    assert {tuple(r)[:2]: tuple(r)[2:] for r in wrappers.current_decisions(spark, target, ["subject", "channel"]).collect()} == final
