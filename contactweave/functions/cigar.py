"""CIGAR column functions over ``array<struct<len: bigint, op: string>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Operations in code order, and what each consumes.
OPS = "MIDNSHP=X"
CONSUMES_QUERY = "MIS=X"
CONSUMES_REF = "MDN=X"
MATCH = "M=X"
INSERTION = "IS"
DELETION = "DN"
HARD = "HP"

CIGAR_TYPE = "array<struct<len:bigint,op:string>>"


def op_code(op: Column) -> Column:
    """0-8 by place in MIDNSHP=X; another letter is an error."""
    at = F.position(op, F.lit(OPS))
    bad = F.raise_error(F.concat(F.lit("unexpected CIGAR operation: "), op)).cast("int")
    return F.when((at > 0) & (F.length(op) == 1), at - 1).otherwise(bad)


def op_letter(code: Column) -> Column:
    """Letter of an operation code 0-8."""
    bad = F.raise_error(F.lit("unexpected CIGAR operation code"))
    return F.when(code.between(0, 8), F.substring(F.lit(OPS), code + 1, F.lit(1))).otherwise(bad)


def is_in(op: Column, letters: str) -> Column:
    return op.isin(*letters)


def op_class(op: Column) -> Column:
    """match, insertion, deletion or hard: operations grouped by what they consume."""
    return (
        F.when(is_in(op, MATCH), "match")
        .when(is_in(op, INSERTION), "insertion")
        .when(is_in(op, DELETION), "deletion")
        .when(is_in(op, HARD), "hard")
    )


def parse_cigar(text: str | Column) -> Column:
    """Operations of a CIGAR text; ``*`` is empty, anything malformed an error."""
    text = F.col(text) if isinstance(text, str) else text
    lens = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2))
    parsed = F.transform(
        F.arrays_zip(lens.alias("len"), ops.alias("op")),
        lambda e: F.struct(e["len"].cast("bigint").alias("len"), e["op"].alias("op")),
    )
    empty = F.array().cast(CIGAR_TYPE)
    whole = text.rlike("^([0-9]+[MIDNSHP=X])*$") & ~F.exists(parsed, lambda e: e["len"] == 0)
    bad = F.raise_error(F.concat(F.lit("malformed CIGAR: "), text)).cast(CIGAR_TYPE)
    return F.when(text == "*", empty).when(text.isNull() | whole, parsed).otherwise(bad)


def push(cigar: Column, length: Column, op: Column) -> Column:
    """The CIGAR with one more operation; nothing changes for length zero."""
    entry = F.array(F.struct(length.cast("bigint").alias("len"), op.alias("op")))
    return F.when(length > 0, F.concat(cigar, entry)).otherwise(cigar)


def at(cigar: Column, index: int) -> Column:
    """0-based operation."""
    return F.element_at(cigar, index + 1)


def to_raw(cigar: Column) -> Column:
    """Packed integers ``len * 16 + code``."""
    return F.transform(cigar, lambda e: e["len"] * 16 + op_code(e["op"]))


def from_raw(raw: Column) -> Column:
    return F.transform(
        raw,
        lambda v: F.struct(
            F.shiftright(v.cast("bigint"), 4).alias("len"),
            op_letter(v.bitwiseAND(F.lit(15)).cast("int")).alias("op"),
        ),
    )


def cigar_text(cigar: Column) -> Column:
    joined = F.array_join(F.transform(cigar, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")
    return F.when(F.size(cigar) == 0, "*").otherwise(joined)


def _length(cigar: Column, letters: str) -> Column:
    kept = F.filter(cigar, lambda e: is_in(e["op"], letters))
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda total, e: total + e["len"])


def ref_length(cigar: Column) -> Column:
    return _length(cigar, CONSUMES_REF)


def query_length(cigar: Column) -> Column:
    return _length(cigar, CONSUMES_QUERY)


def _leading(cigar: Column, skip: str, count: str) -> Column:
    """Summed lengths of ``count`` operations before the first one outside both sets."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("go"))
    step = lambda s, e: F.struct(
        (s["n"] + F.when(s["go"] & is_in(e["op"], count), e["len"]).otherwise(0)).alias("n"),
        (s["go"] & is_in(e["op"], skip + count)).alias("go"),
    )
    return F.aggregate(cigar, start, step, lambda s: s["n"])


def hard_clipping(cigar: Column, left: bool = True) -> Column:
    """Clipped length at one end made of operations that consume nothing."""
    return _leading(cigar if left else F.reverse(cigar), "", HARD)


def soft_clipping(cigar: Column, left: bool = True) -> Column:
    """Insertion-like length at one end, looking past hard clips."""
    return _leading(cigar if left else F.reverse(cigar), HARD, INSERTION)


_CHUNK = 1 << 16  # bases that one array holds


def _op_starts(df: DataFrame, cigar: str, ref_start: str | None) -> DataFrame:
    """One row per operation with the query and reference position it starts at.

    Positions are running sums over a read's operations, so the work is
    linear in their number.
    """
    first_ref = F.col(ref_start).cast("bigint") if ref_start else F.lit(0).cast("bigint")
    read = Window.partitionBy("_read").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)

    def used(letters: str):
        return F.coalesce(F.sum(F.when(is_in(F.col("_e.op"), letters), F.col("_e.len")).otherwise(0)).over(read), F.lit(0).cast("bigint"))

    each = df.withColumn("_read", F.monotonically_increasing_id()).select("*", F.posexplode(cigar).alias("_k", "_e"))
    placed = each.withColumns({"_q": used(CONSUMES_QUERY), "_r": first_ref + used(CONSUMES_REF)})
    op = F.struct(F.col("_e.len").alias("len"), F.col("_e.op").alias("op"), F.col("_q").alias("q"), F.col("_r").alias("r"))
    return placed.withColumn("_op", op).drop("_read", "_k", "_e", "_q", "_r")


def aligned_pairs(df: DataFrame, cigar: str, ref_start: str | None = None) -> DataFrame:
    """One row per aligned base: ``query_pos`` and ``ref_pos``, null on the side not consumed.

    Long operations are spread out in chunks, so no array grows with them.
    """
    ops = _op_starts(df, cigar, ref_start).where(~is_in(F.col("_op.op"), HARD) & (F.col("_op.len") > 0))
    first = F.sequence(F.lit(0).cast("bigint"), F.col("_op.len") - 1, F.lit(_CHUNK).cast("bigint"))
    chunks = ops.withColumn("_from", F.explode(first))
    last = F.least(F.col("_from") + _CHUNK, F.col("_op.len")) - 1
    op = F.col("_op.op")
    # what an operation consumes is looked up once a chunk; null on the other side stays null
    placed = chunks.select(
        *df.columns,
        F.when(is_in(op, CONSUMES_QUERY), F.col("_op.q")).alias("_q"),
        F.when(is_in(op, CONSUMES_REF), F.col("_op.r")).alias("_r"),
        F.sequence(F.col("_from"), last).alias("_places"),
    )
    bases = placed.select(*df.columns, "_q", "_r", F.explode("_places").alias("_k"))
    return bases.select(*df.columns, (F.col("_q") + F.col("_k")).alias("query_pos"), (F.col("_r") + F.col("_k")).alias("ref_pos"))


def matching_pairs(df: DataFrame, cigar: str, ref_start: str | None = None) -> DataFrame:
    """One row per matched base, without insertions and deletions."""
    return aligned_pairs(df, cigar, ref_start).where("query_pos is not null and ref_pos is not null")
