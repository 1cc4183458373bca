"""Many-to-one joins that stay safe when the dimension table is large or a key is hot."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .storage import materialize

BROADCAST_BYTES = 256 * 1024 * 1024
_ROW_OVERHEAD = 32
BLOCK_KEYS = 8_192
FEW_KEYS = 262_144  # a table of so many rows is looked up row by row
HEAVY_ROWS = 1_000_000  # a key with more facts is split into parts of about this size


def broadcast_budget(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.contactweave.broadcastBytes", str(BROADCAST_BYTES)))


def row_width(schema: T.StructType, string_bytes: int) -> int:
    wide = (T.StringType, T.BinaryType)
    return _ROW_OVERHEAD + sum(
        string_bytes + 8 if isinstance(f.dataType, wide) else 8 for f in schema.fields
    )


def fits_broadcast(df: DataFrame, n_rows: int, string_bytes: int = 64) -> bool:
    """``n_rows`` is a known row count, ``string_bytes`` a known longest string."""
    return n_rows * row_width(df.schema, string_bytes) <= broadcast_budget(df.sparkSession)


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    keys: dict[str, str],
    n_rows: int,
    how: str = "inner",
    string_bytes: int = 64,
) -> DataFrame:
    """Join ``facts`` to ``dimension`` on ``facts key -> dimension key``.

    The dimension is broadcast only if its counted rows fit the budget.  Past
    that both sides are shuffled, and the planner is told so: it would take a
    table that is made from few rows, or compressed well, for a small one.  Keys that hold more than ``HEAVY_ROWS``
    facts are counted first and split into as many parts as their count asks
    for, their dimension rows repeated once per part; all other keys are
    joined as they are.
    """
    renamed = {b: f"_key_{b}" for b in keys.values()}
    dim = dimension.withColumnsRenamed(renamed)
    pairs = [(a, renamed[b]) for a, b in keys.items()]
    if fits_broadcast(dimension, n_rows, string_bytes):
        joined = facts.join(F.broadcast(dim), [facts[a] == dim[b] for a, b in pairs], how)
    else:
        joined = _shuffled(facts, dim, pairs, how)
    return joined.drop(*renamed.values())


def _shuffled(facts: DataFrame, dim: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    fact_keys, dim_keys = [a for a, _ in pairs], [b for _, b in pairs]
    heavy = materialize(
        facts.groupBy(*fact_keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > HEAVY_ROWS)
        .select(
            *[F.col(k).alias(f"_heavy{i}") for i, k in enumerate(fact_keys)],
            F.expr(f"_n div {HEAVY_ROWS} + 1").alias("_parts"),
        ),
        "heavy",
    )
    n_heavy = heavy.count()
    if not n_heavy:
        return facts.join(dim.hint("merge"), [facts[a] == dim[b] for a, b in pairs], how)
    # as many rows as there are millions of facts at most; broadcast while that fits
    side = F.broadcast(heavy) if fits_broadcast(heavy, n_heavy, 256) else heavy

    def with_parts(df: DataFrame, keys: list[str]) -> DataFrame:
        same = [df[k] == side[f"_heavy{i}"] for i, k in enumerate(keys)]
        return df.join(side, same, "left").drop(*[f"_heavy{i}" for i in range(len(keys))])

    salted = with_parts(facts, fact_keys).withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))
    ).drop("_parts")
    dim = with_parts(dim, dim_keys).withColumn(
        "_dim_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    on = [salted[a] == dim[b] for a, b in pairs] + [salted["_salt"] == dim["_dim_salt"]]
    return salted.join(dim.hint("merge"), on, how).drop("_salt", "_dim_salt")


def block_keys(n_keys: int, most: int = BLOCK_KEYS) -> int:
    """Keys of a block: at most ``most``, fewer in a small table."""
    return max(1, min(most, math.ceil(n_keys / 8)))


def value_blocks(table: DataFrame, value: str, size: int, first: int = 0) -> DataFrame:
    """Values of consecutive bins as arrays: block, held.  ``table`` has one row for each bin_id from ``first`` on."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("bin_id", value))), lambda x: x[value])
    return table.groupBy(F.expr(f"(bin_id - {first}) div {size}").alias("block")).agg(inside.alias("held"))


def lookup_in_blocks(facts: DataFrame, blocks: DataFrame, key: str, out: str, size: int, first: int = 0) -> DataFrame:
    """Attach the value of bin ``key`` as ``out``; facts whose bin is in no block are dropped."""
    side = blocks.select(F.col("block").alias(f"_block_{out}"), F.col("held").alias(f"_held_{out}"))
    at = F.expr(f"cast((`{key}` - {first}) % {size} as int)")
    joined = facts.join(F.broadcast(side), F.expr(f"(`{key}` - {first}) div {size}") == F.col(f"_block_{out}"))
    known = joined.where((at >= 0) & (at < F.size(f"_held_{out}")))
    return known.withColumn(out, F.get(f"_held_{out}", at)).drop(f"_block_{out}", f"_held_{out}")


def lookup_value(facts: DataFrame, table: DataFrame, key: str, value: str, out: str, first: int, n_rows: int) -> DataFrame:
    """Attach ``value`` of bin ``key`` as ``out`` from ``table``, which has one row for each of ``n_rows`` bins from ``first`` on.

    As arrays by block a bin takes eight bytes, so a table far too large to be
    broadcast by rows still needs no shuffle of the facts.
    """
    if n_rows <= FEW_KEYS or n_rows * 8 > broadcast_budget(facts.sparkSession):
        side = table.select(F.col("bin_id").alias(f"_bin_{out}"), F.col(value).alias(out))
        return lookup(facts, side, {key: f"_bin_{out}"}, n_rows)
    size = block_keys(n_rows)
    return lookup_in_blocks(facts, value_blocks(table, value, size, first), key, out, size, first)


def column_blocks(table: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Columns of consecutive bins as an array each, with ``block``.  ``table`` has one row for each bin_id from 0 on."""
    rows = F.array_sort(F.collect_list(F.struct("bin_id", *columns))).alias("_rows")
    held = table.groupBy(F.expr(f"bin_id div {size}").alias("block")).agg(rows)
    return held.select("block", *[F.transform("_rows", lambda x: x[c]).alias(c) for c in columns])


def lookup_ends_in_blocks(
    pixels: DataFrame, blocks: DataFrame, columns: list[str], size: int, ends: tuple[str, str] = ("bin1_id", "bin2_id")
) -> DataFrame:
    """``lookup_ends`` from arrays by block, which are broadcast; the pixels are not shuffled."""
    out = pixels
    for suffix, end in zip("12", ends):
        side = blocks.select(F.col("block").alias("_block"), *[F.col(c).alias(f"_held_{c}") for c in columns])
        at = F.expr(f"cast(`{end}` % {size} as int)")
        joined = out.join(F.broadcast(side), F.expr(f"`{end}` div {size}") == F.col("_block"))
        known = joined.where((at >= 0) & (at < F.size(f"_held_{columns[0]}")))
        out = known.select(*out.columns, *[F.get(f"_held_{c}", at).alias(f"{c}{suffix}") for c in columns])
    return out


def lookup_ends(
    pixels: DataFrame,
    bins: DataFrame,
    columns: list[str],
    n_bins: int,
    ends: tuple[str, str] = ("bin1_id", "bin2_id"),
) -> DataFrame:
    """Attach ``columns`` of the bin table to both ends, suffixed 1 and 2.

    Pixels whose bin is missing from ``bins`` are dropped.
    """
    out = pixels
    for suffix, end in zip("12", ends):
        side = bins.select(
            F.col("bin_id").alias(f"_bin{suffix}"),
            *[F.col(c).alias(f"{c}{suffix}") for c in columns],
        )
        out = lookup(out, side, {end: f"_bin{suffix}"}, n_bins)
    return out
