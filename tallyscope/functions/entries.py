"""Expressions over the nested input/output arrays of a ledger row."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY_TYPE = "array<struct<position:int,address:string,amount_sats:bigint>>"


def _field(entries: str | Column, name: str) -> Column:
    """One field of every entry; compiled, where a lambda would be interpreted entry by entry."""
    return (F.col(entries) if isinstance(entries, str) else entries).getField(name)


def addresses(entries: str | Column) -> Column:
    return _field(entries, "address")


def distinct_addresses(entries: str | Column) -> Column:
    return F.array_distinct(addresses(entries))


def amounts(entries: str | Column) -> Column:
    return _field(entries, "amount_sats")


def total(entries: str | Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + e["amount_sats"])


def dominant_output(outputs: str | Column = "outputs", total_out: str | Column = "total_out_sats") -> Column:
    """Largest output as struct(address, amount_sats, share); the lowest position wins ties."""
    total_out = F.col(total_out) if isinstance(total_out, str) else total_out
    top = F.array_max(
        F.transform(
            outputs,
            lambda e: F.struct(
                e["amount_sats"].alias("amount_sats"),
                (-e["position"]).alias("rank"),
                e["address"].alias("address"),
            ),
        )
    )
    return F.when(
        (total_out > 0) & top.isNotNull(),
        F.struct(
            top["address"].alias("address"),
            top["amount_sats"].alias("amount_sats"),
            (top["amount_sats"] / total_out).alias("share"),
        ),
    )


def equal_value_groups(values: Column, band: int, floor: int) -> Column:
    """Largest near-equal group of ``values`` in one sorted pass.

    A group is anchored at its smallest value and takes every value within ``band`` of the
    anchor. The fold keeps scalars only, so a transaction with very many outputs costs a sort
    and one scan. Returns struct(size, denomination, groups), where ``groups`` counts the
    groups of at least ``floor`` members.
    """
    start = F.struct(
        F.lit(None).cast("bigint").alias("anchor"),
        F.lit(0).alias("run"),
        F.lit(0).alias("size"),
        F.lit(None).cast("bigint").alias("denomination"),
        F.lit(0).alias("groups"),
    )

    def step(acc: Column, value: Column) -> Column:
        same = F.coalesce(value - acc["anchor"] <= F.lit(band), F.lit(False))
        anchor = F.when(same, acc["anchor"]).otherwise(value)
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            anchor.alias("anchor"),
            run.alias("run"),
            F.greatest(run, acc["size"]).alias("size"),
            F.when(run > acc["size"], anchor).otherwise(acc["denomination"]).alias("denomination"),
            (acc["groups"] + F.when(run == F.lit(floor), 1).otherwise(0)).alias("groups"),
        )

    return F.aggregate(
        F.array_sort(values),
        start,
        step,
        lambda acc: F.struct(acc["size"].alias("size"), acc["denomination"].alias("denomination"),
                             acc["groups"].alias("groups")),
    )


def has_equal_group(values: Column, band: int, floor: int) -> Column:
    """Whether the largest group of :func:`equal_value_groups` has ``floor`` members or more.

    The values of such a group are neighbours in sorted order, so the fold is left to the rows in which
    some value lies within ``band`` of the one ``floor - 1`` places before it.
    """
    exact = equal_value_groups(values, band, floor)["size"] >= floor
    if floor < 2:
        return exact
    ordered, n = F.sort_array(values), F.size(values)
    near = F.exists(
        F.zip_with(F.slice(ordered, F.lit(floor), n), F.slice(ordered, F.lit(1), n - F.lit(floor - 1)), lambda high, low: high - low),
        lambda gap: gap <= F.lit(band))
    return F.when(values.isNull(), F.lit(None).cast("boolean")).when(n < floor, F.lit(False)).when(
        ~F.coalesce(near, F.lit(False)), F.lit(False)).otherwise(exact)
