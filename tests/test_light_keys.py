"""Work on light keys: one shuffle, nothing written but the list of heavy keys; same values as the plain fold."""
import random

import pytest
from pyspark.sql import functions as F

from checks import queries
from tallyscope.functions import entries, prefix
from tallyscope.operators import activity, features, peeling, structure
from tallyscope.plans import run as runs
from tallyscope.settings import DAY_US, Peeling


@pytest.fixture
def written(monkeypatch):
    rows = {}
    real = prefix.stage

    def counted(df, label):
        table = real(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(prefix, "stage", counted)
    return rows


def _shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_light_gaps_are_shuffled_once_and_not_written(spark, written):
    events = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 7), ("c", None), ("c", None), ("c", 2), ("c", 9)], "key string, at long")
    found = prefix.median_gap(events, ["key"])
    assert _shuffles(found) == 1 and not any(written.values())
    assert {r.key: r.median_gap_us for r in found.collect()} == {"a": 1.5, "c": 3.5}
    cut = prefix.median_gap(events, ["key"], heavy_rows=2)
    assert {r.key: r.median_gap_us for r in cut.collect()} == {"a": 1.5, "c": 3.5}


def test_light_peaks_are_shuffled_once_and_not_written(spark, written):
    spans = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 6, 7), ("b", 3, 3), ("c", None, None)], "key string, start_us long, end_us long")
    found = prefix.peak_overlap(spans, ["key"])
    assert _shuffles(found) == 1 and not any(written.values())
    want = {"a": (2, 5), "b": (1, 3), "c": (0, None)}
    assert {r.key: (r.peak, r.peak_us) for r in found.collect()} == want
    cut = prefix.peak_overlap(spans, ["key"], heavy_rows=2)
    assert {r.key: (r.peak, r.peak_us) for r in cut.collect()} == want


@pytest.mark.parametrize("band,floor", [(0, 2), (1, 3), (10, 3), (10, 1)])
def test_short_cut_of_equal_groups_agrees_with_the_fold(spark, band, floor):
    draw = random.Random(band * 10 + floor)
    values = [[draw.choice([None, *range(0, 60, 5), 11, 12]) for _ in range(draw.randrange(8))] for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v array<long>")
    got = df.select(
        entries.has_equal_group(F.col("v"), band, floor).alias("short"),
        (entries.equal_value_groups(F.col("v"), band, floor)["size"] >= floor).alias("fold")).collect()
    assert [r.short for r in got] == [r.fold for r in got]


def test_equal_outputs_are_decided_before_entries_become_rows(spark):
    entry = "array<struct<position:int,address:string,amount_sats:bigint>>"
    ledger = spark.createDataFrame(
        [("t1", 5, 1, 3, 0, [(0, "a", 30)], [(0, "b", 10), (1, "c", 10), (2, "a", 10)]),
         ("t2", 6, 1, 2, 0, [(0, None, 7)], [(0, "b", 5), (1, "d", 2)])],
        f"txid string, ts_us long, input_count int, output_count int, residual_sats long, inputs {entry}, outputs {entry}")
    found = activity.address_transactions(ledger)
    rows = {(r.address, r.txid): (r.received_sats, r.spent_sats, r.receives, r.spends, r.equal_outputs) for r in found.collect()}
    assert rows == {
        ("a", "t1"): (10, 30, True, True, True), ("b", "t1"): (10, 0, True, False, True), ("c", "t1"): (10, 0, True, False, True),
        (None, "t2"): (0, 7, False, True, False), ("b", "t2"): (5, 0, True, False, False), ("d", "t2"): (2, 0, True, False, False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("lambda" not in line for line in plan.split("Generate")[0].splitlines() if line.lstrip(" :+-").startswith("Project"))


def test_steps_without_neighbours_stay_out_of_the_rounds(spark, monkeypatch):
    hour = 3_600_000_000
    move = lambda name, at, payer, heir, other: (name, at * hour, 100, 100, 0, 1, 2, False, [(0, payer, 100)], [(0, heir, 90), (1, other, 10)])
    chain = [move(f"t{i}", i, f"a{i}", f"a{i + 1}", f"x{i}") for i in range(6)]
    alone = [move(f"z{i}", i, f"c{i}", f"d{i}", f"e{i}") for i in range(30)]
    entry = "array<struct<position:int,address:string,amount_sats:bigint>>"
    marked = spark.createDataFrame(
        chain + alone, "txid string, ts_us long, total_in_sats long, total_out_sats long, residual_sats long, input_count int, output_count int,"
        f" collaborative boolean, inputs {entry}, outputs {entry}")
    rows, real = {}, peeling.stage

    def counted(df, label):
        table = real(df, label)
        rows.setdefault(label, table.count())
        return table

    monkeypatch.setattr(peeling, "stage", counted)
    config = Peeling(min_dominant_share=0.5, max_gap_hours=24.0, min_chain_length=3)
    found = peeling.peel_chains(marked, activity.address_transactions(marked), config)
    assert sorted((r.chain, r.hop, r.txid) for r in found.collect()) == [("t0", i + 1, f"t{i}") for i in range(6)]
    assert rows["peel-steps"] == 36 and rows["peel-links"] == 6


def _address_tx(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([None, *range(0, 9 * DAY_US, DAY_US // 2)]), draw.randrange(90))
            for _ in range(200)] + [("once", 5, 1), ("undated", None, 1), ("undated twice", None, 1), ("undated twice", None, 2)]
    return spark.createDataFrame(rows, "address string, ts_us long, received_sats long").selectExpr(
        "*", "0L AS spent_sats", "true AS receives", "false AS spends", "1 AS input_count", "2 AS output_count", "false AS equal_outputs")


def test_profiles_shuffle_transactions_once_and_count_heavy_addresses_once(spark, written):
    seen = _address_tx(spark)
    marked = structure.mark_collaborative(spark.createDataFrame(
        [("t1", 1, 0, 2, 2, [(0, "a", 5), (1, "b", 5)], [(0, "c", 4), (1, "a", 6)]), ("t2", 2, 0, 2, 1, [(0, "b", 5), (1, "a", 5)], [(0, "c", 10)])],
        f"txid string, ts_us long, residual_sats long, input_count int, output_count int, inputs {entries.ENTRY_TYPE}, outputs {entries.ENTRY_TYPE}"))
    found = features.address_profiles(marked, seen)
    assert set(written) == {"profile-heavy"} and not any(written.values())
    assert _shuffles(features._own_profiles(seen)) == 1
    rows = {r.address: r.asDict() for r in found.collect()}
    assert {r.address: r.asDict() for r in features.address_profiles(marked, seen, heavy_rows=3).collect()} == rows
    gaps = {r.address: r.median_gap_us for r in features.inter_event_gaps(seen).collect() if r.address}
    peaks = {r.address: r.max_tx_in_24h for r in features.busiest_day(seen).collect() if r.address}
    assert {a: r["median_gap_us"] for a, r in rows.items() if r["median_gap_us"] is not None} == gaps
    assert {a: r["max_tx_in_24h"] for a, r in rows.items() if a} == peaks
    assert (rows["a"]["distinct_receivers"], rows["a"]["repeated_co_input_partners"]) == (1, 1)
    assert rows[None]["tx_count"] > 1 and rows[None]["max_tx_in_24h"] is None
    assert (rows["undated"]["max_tx_in_24h"], rows["undated"]["median_gap_us"], rows["undated twice"]["median_gap_us"]) == (0, None, 0)


def test_a_scored_run_makes_its_case_tables_once(spark, monkeypatch):
    labels, given = [], {}
    monkeypatch.setattr(runs, "stage", lambda df, label: labels.append(label) or df)
    monkeypatch.setattr(queries, "run_analysis", lambda ledger, *rest: given.update(made=rest[-1], ledger=ledger))
    monkeypatch.setattr(queries, "read_star_ledger", lambda *_: spark.createDataFrame(
        [("t1", 1, 0, 1, 1, [(0, "a", 5)], [(0, "b", 5)])],
        f"txid string, ts_us long, residual_sats long, input_count int, output_count int, inputs {entries.ENTRY_TYPE}, outputs {entries.ENTRY_TYPE}"))
    monkeypatch.setattr(queries, "read_star_observations", lambda *_: None)
    monkeypatch.setattr(queries.model, "freeze_scores", lambda scores: {r.address: r.anomaly_score for r in scores.collect()})
    queries._scored_run(spark, "")
    assert labels == ["ledger", "address-tx"] and given["ledger"] is given["made"][0]
    assert {r.address for r in given["made"][1].collect()} == {"a", "b"}
