"""What queries leave on disk while they run."""
import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.sieve import mark_possible
from tallyscope.functions.staging import release, stage, staged_here
from tallyscope.plans.case_import import import_ledger, load_ledger


@pytest.fixture()
def kept(tmp_path, monkeypatch):
    """The staged tables of a checkpoint folder of the test's own."""
    from checks import files
    from tallyscope.functions import staging

    for module in (files, staging):
        monkeypatch.setattr(module, "checkpoint_root", lambda spark: str(tmp_path / "kept"))
    return tmp_path / "kept" / "staged"


def _left(kept):
    return sorted(name.rsplit("-", 1)[0] for name in os.listdir(kept)) if kept.exists() else []


def _folder(spark, path, orders=60, again=()):
    rows = [(k, k % 7, datetime.date(2024, 1, 1)) for k in [*range(orders), *again]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{path}/orders.parquet")
    lines = [(k, n, n + 10, n + 20, 2.0 + n) for k in range(orders) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(
        f"{path}/lineitem.parquet")
    return str(path)


def test_shuffle_files_go_with_their_query(spark, kept):
    from tallyscope.session import prepare

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = lambda: {b for b in manager.getAllBlocks().mkString(" ").split(" ") if b.startswith("shuffle_")}
    before = blocks()
    stage(prepare(spark).range(10_000).groupBy((F.col("id") % 50).alias("k")).count(), "counted")
    assert blocks() <= before


def test_tables_of_a_block_are_known(spark, kept):
    with staged_here() as outer:
        stage(spark.range(3), "a")
        with staged_here() as inner:
            stage(spark.range(3), "b")
    stage(spark.range(3), "c")
    assert (len(outer), len(inner), _left(kept)) == (2, 1, ["a", "b", "c"])
    release(*outer, *inner)
    assert _left(kept) == ["c"]


@pytest.mark.parametrize("kind", ["csv", "json", "xml"])
def test_an_import_leaves_nothing_staged(spark, tmp_path, kept, kind):
    from checks.files import write_landing

    landing = write_landing(spark, _folder(spark, tmp_path), kind)
    import_ledger(spark, landing, str(tmp_path / "case"))
    assert set(_left(kept)) <= {"datasets", "text-keys"}
    ledger, sightings = load_ledger(spark, str(tmp_path / "case"))
    assert ledger.count() > 0 and sightings.count() >= ledger.count()


def test_rows_without_a_repeated_identifier_are_not_written_again(spark, tmp_path, kept):
    from tallyscope.operators.importing import import_rows
    from tests.scenarios import Book

    book = Book()
    for i in range(40):
        book.pay([("A", 100_000_000)], [("B", 99_900_000)], **({"txid": "f" * 64} if i in (4, 9) else {}))
    result = import_rows(book.frame(spark))
    assert result.source_rows.count() == 40 and result.observations.groupBy("txid").count().where("count = 2").count() == 1
    rows = {name.rsplit("-", 1)[0]: spark.read.parquet(str(kept / name)).count() for name in os.listdir(kept)}
    assert rows["normalized"] == 40 and "resolved" not in rows and 2 <= rows["repeated-rows"] < 10


def test_only_rows_without_a_match_are_told_apart(spark):
    members = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("m"))
    rows = spark.range(3000).select("id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("k"), "id")).alias("key"))
    marked = {r.id: r.p for r in mark_possible(rows, F.col("key"), stage(members, "members"), "m", "p").collect()}
    assert len(marked) == 3000 and all(marked[i] for i in range(0, 3000, 7) if i % 11) and not any(marked[i] for i in range(0, 3000, 11))
    assert sum(marked.values()) < 1.2 * 3000 / 7
    assert not any(r.p for r in mark_possible(rows, F.col("key"), stage(members.limit(0), "members"), "m", "p").collect())


def test_text_rows_keep_their_places_when_keys_repeat(spark, tmp_path):
    from checks.text_rows import placed_text_rows

    rows, places = placed_text_rows(spark, _folder(spark, tmp_path, 90, [0, 37, 37, 50]))
    found = rows.select("row_number", F.regexp_extract(F.col("raw")["src_ip"], r"10\.0\.(\d+)\.1", 1).cast("int").alias("k")).collect()
    keys = sorted([*range(90), 0, 37, 37, 50])
    want = [k for key in sorted(set(keys)) for copy in [0] + [1] * (key % 37 == 0) + [2] * (key % 41 == 0) for k in [key % 25] * keys.count(key)]
    assert [r.k for r in sorted(found)] == want and [r.row_number for r in sorted(found)] == list(range(1, len(want) + 1))
    assert places.agg(F.sum("n")).first()[0] == len(want)


def test_a_json_file_is_written_once_on_the_way(spark, tmp_path, kept):
    from tallyscope.sources.formats import read_rows

    records = [{"id": i, "note": "}{" * (i % 5), "deep": {"a": ["}"]}} for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "j").write_text(json.dumps(records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_rows(spark, str(tmp_path / "in"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.row_number, int(r.raw["id"])) for r in rows.collect()) == [(i + 1, i) for i in range(3000)]
    sizes = {}
    for name in os.listdir(kept):
        label = name.rsplit("-", 1)[0]
        if label.startswith("json"):
            sizes[label] = spark.read.parquet(str(kept / name)).count()
    assert set(sizes) == {"json-items", "json-joined"} and sizes["json-joined"] < 200


def test_packed_identifiers_come_back(spark):
    from tallyscope.functions.text import packed, unpacked

    odd = ["", "x", "ab" * 31, "A" * 64, "é" * 16, "\x00" * 32, "f" * 63, "f" * 65, "0" * 64 + "\n", "g" * 64, "y" * 31, "y" * 32, "z" * 33, "00" + "y" * 31]
    texts = [*odd, *(f"{i:064x}" for i in range(50)), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("p")).select("t", "p", unpacked(F.col("p")).alias("u"))
    found = rows.collect()
    assert all(r.t == r.u for r in found) and len({bytes(r.p) for r in found if r.p is not None}) == len(texts) - 1


def test_sightings_count_with_and_without_addresses(spark):
    from collections import Counter

    from tallyscope.operators.context import shared_ip
    from tallyscope.settings import SharedEndpoint

    rule = SharedEndpoint()
    entries = lambda names: [(i, n, 1) for i, n in enumerate(names)]
    ledger = [(f"t{i}", i, entries([f"p{i % 12}", f"p{i % 12}"]), entries([f"q{i % 9}"])) for i in range(120)] + [("bare", 500, [], []), ("t5", 900, [], entries(["p1"]))]
    kind = "array<struct<position:int,address:string,amount_sats:bigint>>"
    seen = [("1.1.1.1", f"t{i}") for i in range(120)] + [("1.1.1.1", "bare"), ("2.2.2.2", "t1"), (None, "t2"), ("3.3.3.3", "gone")]
    found = {r.endpoint: r for r in shared_ip(
        spark.createDataFrame(seen, "src_ip string, txid string"),
        spark.createDataFrame(ledger, f"txid string, ts_us bigint, inputs {kind}, outputs {kind}"), rule).collect()}
    hits = Counter(a for i in range(120) for a in {f"p{i % 12}", f"q{i % 9}"}) + Counter(["p1"])
    recur = sorted(a for a, n in hits.items() if n >= rule.min_observations_per_address)
    assert set(found) == {"1.1.1.1"}
    row = found["1.1.1.1"]
    assert (row.observation_count, row.start_us, row.end_us) == (122, 0, 900)
    assert (row.distinct_addresses_observed, row.addresses_seen_at_endpoint, row.subject_id) == (len(recur), len(hits), recur[0])


def test_a_run_keeps_no_table_that_nothing_reads(spark, kept):
    from tallyscope.operators.importing import import_rows
    from tallyscope.plans.run import run_analysis
    from tests.test_run import harbour

    result = import_rows(harbour().frame(spark))
    run = run_analysis(result.transactions, result.observations)
    assert run.alerts.count() > 0 and run.predictions.count() > 0
    run.evidence.collect()
    assert not {"payer-stretches", "best-window", "window-payments", "peel-steps", "peel-usable", "peel-links", "peel-live"} & set(_left(kept))


def test_payments_of_few_receivers_keep_every_column(spark):
    from tallyscope.operators.activity import payer_receiver_pairs

    entries = lambda names: [(i, n, 1) for i, n in enumerate(names)]
    kind = "array<struct<position:int,address:string,amount_sats:bigint>>"
    ids = ["a" * 64, "T" * 64, "short", "", None]
    ledger = spark.createDataFrame(
        [(t, i, 2, 2, r, entries(["p", f"p{i}"]), entries(["q", f"q{i}", "p"])) for i, t in enumerate(ids) for r in (0, 5, None)],
        f"txid string, ts_us bigint, input_count int, output_count int, residual_sats bigint, inputs {kind}, outputs {kind}")
    wanted = stage(spark.createDataFrame([("q",), ("p",)], "address string"), "wanted")
    order = lambda df: sorted(df.select("txid", "ts_us", "discrepancy", "payer", "receiver").collect(), key=repr)
    want = order(payer_receiver_pairs(ledger).where("receiver in ('p', 'q')"))
    assert len(want) == 45 and order(payer_receiver_pairs(ledger, wanted)) == want and order(payer_receiver_pairs(ledger, wanted, few=True)) == want
