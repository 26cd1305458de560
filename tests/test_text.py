from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text
from tallyscope.functions.money import from_minor_units, to_minor_units


def _exact(value: str):
    try:
        scaled = Decimal(value) * 10**8
    except InvalidOperation:
        return None
    return int(scaled) if scaled.is_finite() and scaled == scaled.to_integral_value() else None


def test_amounts_are_exact(spark):
    values = ["0", "1", "0.00000001", "21000000", "0.1", "1e-8", "1E2", "+3.5", "-1", ".5", "5.", "1.000000001",
              "0.1234567890000000000000000", "1e-20", "0.0000000000000000001", "abc", "", "1,5", "NaN", "Infinity", "1_0"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", to_minor_units(F.col("v")).alias("u"))
    assert {r.v: r.u for r in got.collect()} == {v: _exact(v) for v in values}


def test_amounts_of_eight_decimals(spark):
    values = ["0.00000000", "0000000001.00000001", "9999999999.99999999", "12345678901.00000001", "92233720368.54775807", "92233720368.54775808",
              "-1.00000000", "1_0.00000000", "1.000000010"]
    got = spark.createDataFrame([(v,) for v in [*values, "1.00000000\n", None]], "v string").select("v", to_minor_units(F.col("v")).alias("u"))
    assert {r.v: r.u for r in got.collect()} == {v: _exact(v) for v in values} | {"92233720368.54775808": None, "1.00000000\n": 100_000_000, None: None}


def test_units_print_plainly(spark):
    rows = spark.createDataFrame([(0,), (1,), (123456789012,), (-5,)], "u bigint")
    assert [r[0] for r in rows.select(from_minor_units(F.col("u"))).collect()] == [
        "0.00000000", "0.00000001", "1234.56789012", "-0.00000005"]


def test_instants(spark):
    good = ["2027-03-01T12:00:00Z", "2027-03-01 12:00:00", "2027-03-01", "2027-03-01T12:00:00+01:30", "20270301T120000",
            "2027-03-01T12", "2027-03-01T12:00:00.25-0500", "2027-03-01T12:00:00,5", "2027-03-01T12:30:00.1234567z"]
    bad = ["", "soon", "2027-13-01T00:00:00Z", "2027-02-30", "2027-03-01T25:00:00", "2027-03-01T12:00:00+25:00", "1772366400"]

    def expected(v):
        parsed = datetime.fromisoformat(v[:-1] + "+00:00" if v[-1] in "zZ" else v)
        parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
        return round(parsed.timestamp() * 1e6)

    rows = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r.v: r.t for r in rows.select("v", F.unix_micros(text.parse_instant(F.col("v"))).alias("t")).collect()}
    assert got == {**{v: expected(v) for v in good}, **{v: None for v in bad}}


def test_endpoints_and_ports(spark):
    ips = {"10.0.0.1": "10.0.0.1", "010.0.0.1": None, "256.1.1.1": None, "2001:DB8::0:1": "2001:db8::1", "x:y": None, "": None}
    rows = spark.createDataFrame([(v,) for v in ips], "v string")
    assert {r.v: r.c for r in rows.select("v", text.canonical_ip(F.col("v")).alias("c")).collect()} == ips
    ports = {"0": 0, "65535": 65535, "65536": None, "-1": None, "8_0": 80, "+7": 7, "a": None, "1.0": None}
    rows = spark.createDataFrame([(v,) for v in ports], "v string")
    assert {r.v: r.c for r in rows.select("v", text.parse_port(F.col("v")).alias("c")).collect()} == ports


@pytest.mark.parametrize("address,ok", [
    ("1BoatSLRHtKNngkdXEeobR76b53LETtpyT", True), ("1BoatSLRHtKNngkdXEeobR76b53LETtpyU", False),
    ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True),
    ("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False),
    ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", True), ("COLLECTOR", False),
])
def test_checksums(spark, address, ok):
    row = spark.createDataFrame([([address],)], "a array<string>").select(text.unverified_addresses(F.col("a"))).first()
    assert row[0] == (0 if ok else 1)
