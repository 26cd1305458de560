"""Data beyond the sizes at which earlier versions cut off."""
import datetime
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import entries
from tallyscope.operators import cocontrol, evidence, graph, model
from tallyscope.plans import case_queries, evaluate
from tallyscope.settings import FEATURE_ORDER, CommonControl


def _marked(spark, rows):
    shape = entries.ENTRY_TYPE
    return spark.createDataFrame(rows, f"txid string, ts_us bigint, residual_sats bigint, inputs {shape}, outputs {shape}").withColumns(
        {"input_count": F.size("inputs"), "output_count": F.size("outputs"), "collaborative": F.lit(False)})


def test_pairs_of_many_inputs(spark):
    names = [f"in{i:03d}" for i in range(150)]
    marked = _marked(spark, [("wide", 1, 0, [(i, n, 1) for i, n in enumerate(names + names[:9])], [(0, "out", 1)]),
                             ("small", 2, 0, [(0, "x", 1), (1, "y", 1)], [(0, "out", 1)])])
    got = [(r.a, r.b, r.txid) for r in cocontrol.co_input_pairs(marked).collect()]
    want = [(a, b, "wide") for i, a in enumerate(names) for b in names[i + 1:]] + [("x", "y", "small")]
    assert sorted(got) == sorted(want)


def test_clusters_of_any_size(spark):
    supported = spark.createDataFrame([(f"m{i:03d}", f"m{i + 1:03d}", 2) for i in range(260)] + [("p", "q", 3)],
                                      "a string, b string, shared_transaction_count bigint")
    pairs = supported.select("a", "b", F.concat("a", F.lit("t")).alias("txid"), F.lit(5).cast("bigint").alias("ts_us"), F.lit(False).alias("discrepancy"))
    members = cocontrol.clusters(supported, CommonControl())
    none = spark.createDataFrame([], "txid string, members array<string>, reason string")
    found = cocontrol.cluster_hypotheses(supported, cocontrol.cluster_support(pairs, supported, members), members, none)
    rows = {r.root: r for r in found.collect()}
    assert rows["m000"].member_count == 261 and rows["m000"].oversized and rows["m000"].members == [] and rows["m000"].inferred_edge_count == 260
    assert rows["p"].members == ["p", "q"] and not rows["p"].oversized
    assert cocontrol.cluster_edges(found, supported, members).count() == 261


@pytest.mark.parametrize("levels", [2, 11, 100])
def test_quantiles_of_all_rows(spark, levels):
    rng = random.Random(levels)
    rows = [(f"a{i}", *[float(rng.choice([0, 0, 1, rng.random() * (j + 1)])) for j in range(len(FEATURE_ORDER))]) for i in range(137)]
    frame = spark.createDataFrame(rows, "address string, " + ", ".join(f"{n} double" for n in FEATURE_ORDER))
    got = {(r.feature, r.level): r.value for r in model.feature_quantiles(frame, levels).collect()}
    assert len(got) == levels * len(FEATURE_ORDER)
    for j, name in enumerate(FEATURE_ORDER):
        own = sorted(r[j + 1] for r in rows)
        for level in range(levels):
            at = level * 136 / (levels - 1)
            low = int(at)
            want = own[low] + (at - low) * (own[min(low + 1, 136)] - own[low])
            assert got[name, level] == pytest.approx(want)


def test_evidence_and_endpoints_are_whole(spark):
    address_tx = spark.createDataFrame([("hot", f"t{i}", i) for i in range(120)], "address string, txid string, ts_us bigint")
    findings = spark.createDataFrame([("hot", "")], "subject_id string, context_id string")
    assert evidence.address_evidence(findings, "high_activity_context", address_tx).count() == 120
    ledger = _marked(spark, [(f"t{i}", i, 0, [(0, "hot", 1)], [(0, f"o{i}", 1)]) for i in range(40)])
    seen = spark.createDataFrame([(f"t{i}", f"10.0.0.{i}") for i in range(40)], "txid string, src_ip string")
    assert case_queries.top_endpoints(ledger, seen, "hot").count() == 40
    assert case_queries.top_endpoints(ledger, seen, "hot", limit=7).count() == 7


def test_deep_neighbourhood(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", f"k{i}", "spend") for i in range(12)], "source string, target string, key string, kind string")
    assert graph.neighbourhood(edges, ["n0"], hops=6, node_budget=5000).meta["nodes_returned"] == 7
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, ["n0"], hops=-1)


def test_blank_labels_count_as_negative(spark):
    predictions = spark.createDataFrame(
        [("a", ["peeling_sequence"], [], True, 1.0, 1.0, []), ("b", [], [], True, 0.0, 0.0, []), ("c", [], [], True, 2.0, 0.0, [])],
        "address string, patterns array<string>, transaction_patterns array<string>, scored boolean, anomaly_percentile double, "
        "review_priority double, roles array<string>")
    truth = spark.createDataFrame([("a", None, "x"), ("b", "", "x"), ("c", "1", "x")], "wallet_id string, is_suspicious string, pattern_type string")
    rows = evaluate.joined(predictions, truth)
    cells = evaluate.confusion(rows).first()
    assert (cells.tp, cells.fp, cells.fn, cells.tn) == (0, 1, 1, 1)
    ranked = {r.variant: r.pr_auc for r in evaluate.average_precision(evaluate.ranking_variants(rows)).collect()}
    assert ranked["model_only"] == statistics.mean([1.0])


def test_large_ledgers_land_in_more_files(spark, tmp_path, monkeypatch):
    from checks import files
    from tallyscope.sources.formats import read_rows

    orders = [(k, k % 7, datetime.date(2024, 1, 1)) for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, n, n + 10, n + 20, 2.0 + n) for k in range(60) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    want = Counter(r["raw"]["txid"] for r in files.star_text_rows(spark, str(tmp_path)).collect())
    for rows, count in ((10, 7), (1000, files.FILES)):
        monkeypatch.setattr(files, "FILE_ROWS", rows)
        for kind in ("csv", "json", "xml"):
            landed = read_rows(spark, files.write_landing(spark, str(tmp_path), kind)).collect()
            assert Counter(r["raw"]["txid"] for r in landed) == want
            assert len({r["file"] for r in landed}) == count
    few = files.write_landing(spark, str(tmp_path), "csv", 2)
    assert read_rows(spark, few).select("file").distinct().count() == 2


def test_indexed_rows_are_made_once(spark):
    from tallyscope.functions.prefix import dense_index

    made = spark.sparkContext.accumulator(0)

    def count(n):
        made.add(1)
        return n

    rows = spark.range(0, 3000, 1, 4).withColumn("n", F.lit(1))
    tagged = F.udf(count, "long")(F.col("id")).alias("tag")
    found = dense_index(rows, [F.desc("id")], "i", "made", [tagged]).collect()
    assert {r["tag"]: r["i"] for r in found} == {i: 2999 - i for i in range(3000)}
    assert made.value == 3000
