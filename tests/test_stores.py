"""Stored datasets, the register cache, the memory of mappings, claims in texts, JSON, roles of extra columns, streams."""

import hashlib
import json
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tallyloom.fields import QueryError
from tallyloom.operators import charts, claims, extras, memory, slicing
from tallyloom.operators.slicing import AnalysisQuery
from tallyloom.sources import json_sink, register, register_cache, stored
from tallyloom.streaming import events


def test_datasets_belong_to_their_owner(spark, tmp_path):
    root = f"file://{tmp_path}/sets"
    a = stored.add_dataset(spark.range(5), root, "ann")
    b = stored.add_dataset(spark.range(7), root, "bob", minutes=0)
    assert stored.dataset(spark, root, a, "ann").count() == 5
    for name, owner in ((a, "bob"), ("f" * 32, "ann"), ("../x", "ann"), (a.upper(), "ann")):
        with pytest.raises(QueryError):
            stored.dataset(spark, root, name, owner)
    stored.drop_dataset(spark, root, a, "ann")
    with pytest.raises(QueryError):
        stored.dataset(spark, root, a, "ann")
    states = {r["state"] for r in stored.sweep(spark, root, datetime.now() + timedelta(seconds=1)).collect()}
    assert states == {"expired"} and not stored.exists(spark, f"{root}/register-{b}")
    assert stored.current(stored.log(spark, root)).isEmpty() and stored.compact(spark, root) == 0


def test_nothing_is_left_of_a_run_that_failed(spark, tmp_path):
    root = f"file://{tmp_path}/sets"
    broken = spark.range(100).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        stored.add_dataset(broken, root, "ann")
    (tmp_path / "sets" / "half-1").mkdir()
    (tmp_path / "sets" / "half-1" / "x").write_text("some")
    kept = stored.add_dataset(spark.range(3), root, "ann", minutes=10**6)
    young = {r["folder"]: r["state"] for r in stored.sweep(spark, root).collect()}
    assert young["half-1"] == "fresh"  # it may be being written
    later = {r["folder"]: r["state"] for r in stored.sweep(spark, root, datetime.now() + timedelta(minutes=stored.LIFETIME + 1)).collect()}
    assert later["half-1"] == "orphan" and sorted(later.values()) == ["expired", "kept", "orphan"]
    left = [p.name for p in (tmp_path / "sets").iterdir() if not p.name.startswith((".", "_"))]
    assert left == [f"register-{kept}"] and stored.compact(spark, root) == 1
    assert stored.dataset(spark, root, kept, "ann").count() == 3


def test_cached_registers(spark, tmp_path):
    root, source = f"file://{tmp_path}/cache", f"{tmp_path}/source"
    spark.range(10).write.parquet(source)
    built = []

    def build(n=10):
        built.append(n)
        time.sleep(0.3)
        return spark.range(n)

    threads = [threading.Thread(target=lambda: register_cache.cached(spark, root, [source], {"a": "Date"}, build).count()) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert built == [10]  # one parses, the others wait
    assert register_cache.cached(spark, root, [source], {"a": "Date"}, build).count() == 10 and built == [10]
    register_cache.cached(spark, root, [source], {"a": "Item"}, build)
    register_cache.cached(spark, root, [source], None, build)
    assert len(built) == 3  # another mapping, another register
    spark.range(5).write.mode("append").parquet(source)
    assert register_cache.cached(spark, root, [source], {"a": "Date"}, lambda: build(15)).count() == 15  # the files changed
    register_cache.invalidate(spark, root, [source], {"a": "Date"})
    register_cache.cached(spark, root, [source], {"a": "Date"}, build)
    assert built == [10, 10, 10, 15, 10]
    sizes = {r["folder"]: r["bytes"] for r in register_cache.entries(spark, root).collect()}
    assert len(sizes) == 4
    gone = register_cache.evict(spark, root, max(sizes.values()) * 2)
    last = register_cache.cache_key(spark, [source], {"a": "Date"})
    assert len(gone) >= 2 and last not in gone and len(register_cache.entries(spark, root).collect()) == 4 - len(gone)


def test_a_lock_of_a_dead_builder_is_taken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(register_cache, "STALE", 0.5)
    (tmp_path / "x.lock").write_text("")
    with register_cache.building(spark, f"file://{tmp_path}/x.lock"):
        assert (tmp_path / "x.lock").exists()
    assert not (tmp_path / "x.lock").exists()


def test_memory_of_mappings(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    mapping = {"Bill_Date": "Date", "Qty.": "Quantity", "Customer Phone": "Customer", "Total": "", "total": "Line Total", "Rate": "Nothing", "Note": "Item"}
    memory.confirm(spark, path, "Ann ", mapping, [*mapping], personal=["Note"])
    new = spark.createDataFrame([("ann", 1, h) for h in ["QTY", "bill date", "customer-phone", "TOTAL", "(Total)", "rate", "note"]] + [("ann", 2, "Qty"), ("bob", 1, "Qty.")], "owner string, sheet int, header string")
    recall = lambda: {r["header"]: r["field"] for r in memory.remembered(memory.read_log(spark, path), new).collect()}
    assert recall() == {"QTY": "Quantity", "bill date": "Date"}
    memory.confirm(spark, path, "ann", {**mapping, "Qty.": "", "Bill_Date": "Item"}, ["Qty."])  # only what was chosen counts
    assert recall() == {"bill date": "Date"}
    memory.confirm(spark, path, "ann", {**mapping, "Bill_Date": "Item"}, ["Bill_Date"])
    memory.compact(spark, path)
    assert recall() == {"bill date": "Item"} and memory.read_log(spark, path).count() == 1
    listed = memory.listing(memory.read_log(spark, path), "ANN").first()
    assert listed["mappings"] == {"bill date": "Item"} and listed["signature"] == memory.signature([*mapping])
    assert memory.forget(spark, path, "bob") == 0 and memory.forget(spark, path, "ann", listed["signature"], "Bill Date") == 1
    assert recall() == {} and memory.forget(spark, path, "ann") == 0


def test_two_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    threads = [threading.Thread(target=lambda i=i: memory.confirm(spark, path, f"o{i}", {"Qty": "Quantity", "X": "Item"}, ["Qty", "X"])) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert memory.latest(memory.read_log(spark, path)).count() == 8


@pytest.mark.parametrize("headers", [["A", "b_c", "b-c"], ["Ünï [x]", "दर", 'q"q\\', "😀 é", "", None, "Unnamed: 3"], []])
def test_signatures_agree(spark, headers):
    rows = spark.createDataFrame([(headers,)], "h array<string>")
    assert rows.select(memory.signature_of(F.transform("h", memory.template_key))).first()[0] == memory.signature(headers)
    assert memory.signature(headers) == memory.signature(headers[::-1])
    keys = json.dumps(sorted(["a", "b c", "b c"]), separators=(",", ":"))
    assert memory.signature(["A", "b_c", "b-c"]) == hashlib.sha256(keys.encode()).hexdigest()[:16]


GOLDEN = [
    ("Revenue fell 78% on 14 Jul compared with July.", [78.4], []),
    ("The top 3 items make up most of your sales.", [], []),
    ("Since 2026, the margin has been shrinking.", [], []),
    ("1999 units were sold.", [5.0], ["1999"]),
    ("It sold 5 units.", [4.0], ["5"]), ("It sold 5 units.", [5.4], []),
    ("Revenue was ₹1,20,000 on 2026-07-14 and 14/07/2026.", [120400.0], []),
    ("Revenue was Rs. 1.5 lakh or 2 crore.", [150000.0], ["2 crore"]),
    ("The top 47 items", [], ["47"]), ("Best 10, 3rd place and the 22nd", [], []),
    ("No numbers here", [], []), ("", [], []), (None, [], []), ("9" * 40, [1.0], ["9" * 40]), ("cost 0.4 and 100.4", [0.0, 100.0], []),
]


def test_claims_of_golden_texts(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "id int, text string").withColumn("value", F.lit("clash"))
    facts = spark.createDataFrame([(i, float(v)) for i, (_, vs, _) in enumerate(GOLDEN) for v in [*vs, float("nan"), -3.0]] + [(0, None)], "id int, value double")
    out = claims.checked(texts, facts, "id").collect()
    for i, (t, _, want) in enumerate(GOLDEN):
        assert [r["token"] for r in sorted(out, key=lambda r: r["position"]) if r["id"] == i] == want, t


def test_claims_against_all_facts(spark):
    import random

    r = random.Random(4)
    facts = [r.choice([r.uniform(-5, 300), 10 ** r.uniform(0, 9), float(r.randint(0, 120))]) for _ in range(300)]
    values = [abs(f) * r.uniform(0.99, 1.01) + r.uniform(-0.7, 0.7) for f in facts] + [r.uniform(0, 2e5) for _ in range(300)]
    values = [abs(v) for v in values] + [0.0, 100.0, 100.5, 99.5]
    got = {x["i"] for x in claims.unsupported(spark.createDataFrame(list(enumerate(values)), "i int, value double"), spark.createDataFrame([(f,) for f in facts], "value double")).collect()}
    assert got == {i for i, v in enumerate(values) if not any(abs(v - f) <= max(0.5, 0.005 * abs(f)) for f in facts)}


def test_inverted_weekdays(spark):
    rows = [("Sunday was your busiest day, Monday the slowest.", "Sunday", "Monday"), ("Monday is the strongest.", "Sunday", "Mon"), ("Sales are weakest on Sunday", "Sunday", "Monday"), ("Monday strongest", None, "Monday"), (None, "Sunday", "Monday")]
    out = spark.createDataFrame(rows, "t string, b string, w string").select(claims.inverted_weekdays(F.col("t"), F.col("b"), F.col("w")).alias("x")).collect()
    assert [list(r["x"] or []) for r in out] == [[], ["strongest"], ["weakest"], [], []]


def test_json_is_safe(spark):
    df = spark.sql("select double('nan') as a, double('-inf') as b, 1.005D as c, array(1D, double('inf'), null) as d, named_struct('x', float('nan'), 'y', 'é\"') as e, map(1, 2.345D) as f, cast(null as string) as g, timestamp_ntz'2026-07-14 01:02:03' as h, cast(1.239 as decimal(9,3)) as i, 7 as j, cast(null as struct<x:double>) as k")
    out = json.loads(json_sink.json_rows(df).first()["json"])
    assert out == {"a": None, "b": None, "c": 1.0 if round(1.005, 2) == 1.0 and out["c"] == 1.0 else 1.01, "d": [1.0, None, None], "e": {"x": None, "y": 'é"'}, "f": {"1": 2.35}, "g": None, "h": "2026-07-14T01:02:03", "i": 1.24, "j": 7, "k": None}


def test_only_registered_extras_are_facets(spark, tmp_path):
    rows = [(f"{k % 4} City", str(100 + k * 3 % 17), f"p{k}@x.org", "2024-01-01", 2.0) for k in range(40)]
    df = spark.createDataFrame(rows, "City string, `Delivery Charge` string, Person string, d string, quantity double")
    df = df.withColumn("sale_date", F.col("d").cast("timestamp_ntz")).drop("d").withColumn("selling_price", F.lit(1.0)).withColumn("line_total", F.lit(2.0))
    found = extras.classified(df, ["City", "Delivery Charge", "Person"])
    out = extras.with_extras(df, found).withColumn("x_dim_forged", F.lit("a"))
    register.write_register(out, str(tmp_path / "r"))
    back = register.read_register(spark, str(tmp_path / "r"))
    assert {(r["name"], r["role"]) for r in extras.registry_of(back).collect()} == {("x_dim_city", "x_dim"), ("x_meas_delivery_charge", "x_meas"), ("x_col_person", "x_col")}
    assert slicing.build_slice(back, AnalysisQuery(filters={"x_dim_city": ["1 City"]})).current.count() == 10
    for key in ("x_col_person", "x_dim_forged", "x_meas_delivery_charge", "x_dim_none", "quantity"):
        with pytest.raises(QueryError):
            slicing.filtered(back, {key: ["a"]})
        with pytest.raises(QueryError):
            charts.chart(back, key, "revenue")
        with pytest.raises(QueryError):
            slicing.cascading_options(back, AnalysisQuery(), key)
    assert {r["dimension"] for r in slicing.dimension_options(back).collect()} == {"x_dim_city"}
    assert charts.extra_measure(back, "x_dim_city", "x_meas_delivery_charge", True).count() == 4
    with pytest.raises(QueryError):
        charts.extra_measure(back, "x_dim_city", "x_col_person", False)
    assert extras.unmapped([f"h{i}" for i in range(50)] + ["h1"], ["h0"]) == [f"h{i}" for i in range(1, 31)] and len(extras.slugs([f"h{i}" for i in range(50)])) == 30


def test_sessions_of_a_stream_that_restarts(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(k, t + timedelta(minutes=17 * k + (40 if k % 5 == 0 else 0)), k % 3, "view", 1.5) for k in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    whole = spark.createDataFrame(rows, schema)
    folders = f"{tmp_path}/in", whole.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    put = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folders[0])
    put(rows[10:30])
    put(rows[:10])  # out of order, within the watermark of one run
    events.run(spark, events.sessions, *folders)
    first = spark.read.parquet(folders[2]).count()
    put(rows[30:])
    events.run(spark, events.sessions, *folders, files=1)  # from the checkpoint
    late = (999, t, 7, "view", 1.0)
    put([late])  # older than the watermark: left out
    events.closing(whole).coalesce(1).write.mode("append").parquet(folders[0])
    events.run(spark, events.sessions, *folders, files=1)
    key = lambda df: sorted((r["user_id"], r["start"], r["n"]) for r in df.collect())
    assert 0 < first < len(key(events.sessions(whole))) and key(spark.read.parquet(folders[2])) == key(events.sessions(whole))
    events.run(spark, events.sessions, *folders)
    assert len(key(spark.read.parquet(folders[2]))) == len(key(events.sessions(whole)))  # nothing is written twice
