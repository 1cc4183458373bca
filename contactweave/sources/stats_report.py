"""Conversion counters as the fixed text report."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Report lines with the counter each one shows.
LINES = [
    ("Total number of good aligned reads", "reads"),
    ("Total number of good alignment records", "alignments"),
    ("Total number of saved HiC pairs", "pairs"),
    ("\nMapping Statistics", None),
    ("\tBoth reads in pair are unmapped", "unmapped_both"),
    ("\tOne of the reads in pair is unmapped", "unmapped_one"),
    ("\tBoth reads in pair are mapped", "mapped_both"),
    ("\nAlignment Type Statistics", None),
    ("\tPrimary alignments", "primary"),
    ("\tSupplementary alignments", "supplementary"),
    ("\tSecondary alignments", "secondary"),
    ("\nPair Alignment Statistics", None),
    ("\tBoth reads have non-unique mapping", "mapq0_both"),
    ("\tOne of the reads has non-unique mapping", "mapq0_one"),
    ("\tBoth reads have unique mapping", "mapq0_none"),
    ("\nHi-C Pair Statistics", None),
    ("\tIntra (cis-) tig interaction", "intra"),
    ("\tInter (trans-) tig interaction", "inter"),
    ("", None),
    ("\tUnique pairs", "pairs_unique"),
    ("\tSimple pairs", "pairs_simple"),
    ("\tvpairs", "pairs_complex"),
]


def stats_text(stats: DataFrame) -> str:
    row = stats.first().asDict()
    return "\n".join(label if key is None else f"{label} {row[key]}" for label, key in LINES) + "\n"


def write_stats(stats: DataFrame, path: str) -> None:
    """One text file in the folder ``path``; the counters are a single row."""
    text = stats_text(stats).rstrip("\n")
    line = stats.sparkSession.createDataFrame([(text,)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)
