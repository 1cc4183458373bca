"""Column layouts shared by sources, operators and sinks."""

PAIRS = (
    "read_name string, tig1 string, pos1 bigint, tig2 string, pos2 bigint, "
    "strand1 string, strand2 string"
)

LENGTHS = "tig_name string, length bigint"

ALIGNMENTS = (
    "qname string, mate int, ref_id int, ref_name string, start bigint, `end` bigint, "
    "mapq int, is_mapped boolean, is_reverse boolean, is_secondary boolean, "
    "is_supplementary boolean, ord bigint"
)

PAIR_TEXT_COLUMNS = ["read_name", "tig1", "tig2", "strand1", "strand2"]
PAIR_COLUMNS = ["read_name", "tig1", "pos1", "tig2", "pos2", "strand1", "strand2"]
