"""DuckDB SQL for every query, over the driver's table views."""

from __future__ import annotations

from ..sources.stats_report import LINES
from .queries import MASK_RES, RES, SOURCE_NODE, ZOOM_RES

_LENGTH = "cast(50000 + ((s_suppkey*7919) % 40)*5000 as bigint)"

_VIEWS = {
    "contigs": f"""
select concat('s', cast(s_suppkey as varchar)) as tig_name, {_LENGTH} as length,
  cast(s_suppkey as bigint) as ord from supplier""",
    "li": """
select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as ln,
  cast(l_quantity as bigint) as qty, l_returnflag as rf, l_linestatus as ls,
  cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_discount, l_tax, l_shipdate) as bigint) - 1 as ord from lineitem""",
    "nsup": "select cast(count(*) as bigint) as n from supplier",
    "pairs": """
select concat('r', cast(li.ord as varchar)) as read_name, a.tig_name as tig1,
  (li.l_partkey*9973 + li.ln*131) % a.length as pos1, b.tig_name as tig2,
  case when li.ln % 2 = 0
    then least((li.l_partkey*9973 + li.ln*131) % a.length + (li.l_orderkey*7907 + li.ln*17) % 30000, a.length)
    else (li.l_orderkey*7907 + li.ln*17) % b.length end as pos2,
  case when li.rf = 'R' then '-' else '+' end as strand1,
  case when li.ls = 'O' then '-' else '+' end as strand2, li.ord as ord
from li cross join nsup join contigs a on a.ord = li.l_suppkey
  join contigs b on b.ord = case when li.ln % 2 = 0 then li.l_suppkey
    else (li.l_orderkey*31 + li.l_partkey) % nsup.n end""",
    "alignments": """
select concat('q', cast(l_orderkey as varchar)) as qname, case when rk % 2 = 0 then 1 else 2 end as mate,
  case when qty = 13 then -1 else (l_orderkey + case when qty % 5 = 0 then 1 else 0 end) % nsup.n end as ref_id,
  (l_orderkey*97) % 40000 + (rk * 911) % 2600 as "start",
  (l_orderkey*97) % 40000 + (rk * 911) % 2600 + 50 + qty as "end",
  case when qty % 9 = 0 then 0 else qty end as mapq, qty <> 13 as is_mapped,
  (rk % 4) in (1, 2) as is_reverse, rk >= 2 and qty % 11 = 0 as is_secondary,
  rk >= 2 and qty % 11 <> 0 as is_supplementary, ord
from (select *, cast(row_number() over (partition by l_orderkey order by ord) as bigint) - 1 as rk from li) x
  cross join nsup""",
    "segments": f"""
select concat('s', cast(s_suppkey as varchar)) as name,
  case when s_suppkey % 7 = 3 then null
    else substr('ACGTNACGGTTACA', 1 + cast(s_suppkey % 5 as int), 8) end as seq,
  {_LENGTH} as ln from supplier""",
    "links": """
select concat('s', cast(s_suppkey as varchar)) as from_name,
  case when s_suppkey % 2 = 0 then '+' else '-' end as from_strand,
  concat('s', cast((s_suppkey*3 + 1) % (nsup.n + 2) as varchar)) as to_name,
  case when s_suppkey % 3 = 0 then '-' else '+' end as to_strand,
  concat(cast(10 + s_suppkey % 20 as varchar), 'M') as cigar from supplier cross join nsup""",
    "tigs": """
select cast(row_number() over (order by length, ord) as bigint) - 1 as tig_id, tig_name, length from contigs""",
}

_NEEDS = {
    "pairs": ["contigs", "li", "nsup"],
    "alignments": ["li", "nsup"],
    "links": ["nsup"],
    "tigs": ["contigs"],
}


def _with(views: list[str], ctes: list[tuple[str, str]], body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(view):
        for need in _NEEDS.get(view, []):
            add(need)
        if view not in order:
            order.append(view)

    for v in views:
        add(v)
    named = [(v, _VIEWS[v]) for v in order] + ctes
    # Plain rows only: a self-referencing CTE must not be materialized up front.
    text = ",\n".join(
        f"{n} as ({s})" if n.split("(")[0] in _RECURSIVE else f"{n} as materialized ({s})" for n, s in named
    )
    return f"with {'recursive ' if recursive else ''}{text}\n{body}"


_RECURSIVE = {"walk", "scan"}


def _offsets(res: int) -> tuple[str, str]:
    n = f"((length + {res} - 1) // {res})"
    return (
        f"offs{res}",
        f"select tig_id, tig_name, length, {n} as n_bins,"
        f" cast(coalesce(sum({n}) over (order by tig_id rows between unbounded preceding and 1 preceding), 0)"
        " as bigint) as chrom_offset from tigs",
    )


def _bins(res: int) -> list[tuple[str, str]]:
    return [
        _offsets(res),
        (
            f"bins{res}",
            f'select chrom_offset + k as bin_id, tig_id, k*{res} as "start", least((k+1)*{res}, length) as "end"'
            f" from (select *, unnest(range(n_bins)) as k from offs{res}) x",
        ),
        (f"nb{res}", f"select cast(count(*) as bigint) as n from bins{res}"),
    ]


def _pixels(res: int, strict: bool = False) -> tuple[str, str]:
    top = "{0}.length" if strict else "({0}.length - 1)"
    place = "{0}.chrom_offset + least(pos{1}, " + top + f") // {res}"
    return (
        f"px{res}",
        f"select least(b1, b2) as bin1_id, greatest(b1, b2) as bin2_id, cast(count(*) as bigint) as count from ("
        f"select {place.format('a', 1)} as b1, {place.format('b', 2)} as b2 from pairs"
        f" join offs{res} a on a.tig_name = tig1 join offs{res} b on b.tig_name = tig2) x group by all",
    )


def _matrix(res: int, strict: bool = False) -> list[tuple[str, str]]:
    return [*_bins(res), _pixels(res, strict)]


def _matrix_sql(body: str, ctes: list[tuple[str, str]] | None = None, res: int = RES, **kw) -> str:
    return _with(["pairs", "tigs"], _matrix(res, **kw) + (ctes or []), body)


ORACLE: dict[str, str] = {}

ORACLE["contig_order"] = _with(["tigs"], [], "select * from tigs")
ORACLE["contig_offsets"] = _with(
    ["tigs"],
    [_offsets(RES)],
    f"select tig_id, chrom_offset, n_bins from offs{RES} union all"
    f" select cast(count(*) as bigint), cast(sum(n_bins) as bigint), cast(0 as bigint) from offs{RES}",
)
ORACLE["bin_table"] = _with(["tigs"], _bins(RES), f"select * from bins{RES}")
ORACLE["contig_bin_range"] = _with(
    ["tigs"],
    _bins(RES),
    f"select tig_id, min(bin_id) as first_bin, max(bin_id) as last_bin from bins{RES} group by tig_id",
)
ORACLE["longest_contig"] = _with(
    ["tigs"], [], "select tig_name, length from tigs order by length desc, tig_name limit 1"
)

ORACLE["pixels_10k"] = _matrix_sql(f"select * from px{RES}")
ORACLE["pixels_10k_strict"] = _matrix_sql(f"select * from px{RES}", strict=True)
_INDEX = (
    "idx",
    f"select bin_id, cast(coalesce(sum(c) over (order by bin_id rows between unbounded preceding and 1 preceding), 0)"
    f" as bigint) as bin1_offset from (select bin_id, count(bin1_id) as c from bins{RES}"
    f" left join px{RES} on bin_id = bin1_id group by bin_id) x",
)
ORACLE["bin_offsets"] = _matrix_sql(
    f"select * from idx union all select (select n from nb{RES}), (select count(*) from px{RES})", [_INDEX]
)
ORACLE["pixel_slice"] = _matrix_sql(
    f"select * from (select *, cast(row_number() over (order by bin1_id, bin2_id) as bigint) - 1 as pos from px{RES}) x"
    f" where pos >= (select count(*) // 4 from px{RES}) and pos < (select count(*) // 2 from px{RES})"
)


def _zoom(target: int) -> str:
    place = f"{{0}}.chrom_offset + least(pos{{1}}, {{0}}.length - 1) // {target}"
    return (
        f"select least(b1, b2) as bin1_id, greatest(b1, b2) as bin2_id, cast(count(*) as bigint) as count from ("
        f"select {place.format('a', 1)} as b1, {place.format('b', 2)} as b2 from pairs"
        f" join offs{target} a on a.tig_name = tig1 join offs{target} b on b.tig_name = tig2) x group by 1, 2"
    )


ORACLE["zoom_20k_from_10k"] = _with(["pairs", "tigs"], [_offsets(20_000)], _zoom(20_000))
ORACLE["zoom_chain"] = _with(
    ["pairs", "tigs"],
    [_offsets(r) for r in ZOOM_RES],
    "\nunion all ".join(f"select *, cast({r} as bigint) as res from ({_zoom(r)}) z{r}" for r in ZOOM_RES),
)

ORACLE["pyramid_one_pass"] = ORACLE["zoom_chain"]
ORACLE["matrix_after_failed_build"] = _with(
    ["pairs", "tigs"], [_offsets(20_000)], f"select *, cast(1 as bigint) as n_levels from ({_zoom(20_000)}) z"
)


def _marginals(res: int) -> list[tuple[str, str]]:
    return [
        ("far", f"select * from px{res} where abs(bin1_id - bin2_id) >= 3"),
        (
            "marg",
            f"select bin_id, tig_id, cast(count(count) as bigint) as nnz, cast(coalesce(sum(count), 0) as bigint) as total"
            f" from bins{res} left join (select bin1_id as b, count from far union all select bin2_id, count from far) s"
            " on b = bin_id group by bin_id, tig_id",
        ),
    ]


ORACLE["nnz_marginal"] = _matrix_sql("select bin_id, nnz from marg", _marginals(RES))
ORACLE["count_marginal"] = _matrix_sql("select bin_id, total from marg", _marginals(RES))


def _masks(res: int) -> list[tuple[str, str]]:
    return [
        *_marginals(res),
        ("meds", "select tig_id, median(cast(total as double)) as m from marg where total > 0 group by tig_id"),
        (
            "scaled",
            "select bin_id, nnz, coalesce(total / m, 0.0) as scaled from marg left join meds using (tig_id)",
        ),
        ("logs", "select ln(scaled) as x from scaled where scaled <> 0"),
        ("mid", "select median(x) as med from logs"),
        ("cut", "select exp(any_value(med) - 5.0 * median(abs(x - med))) as cutoff from logs cross join mid"),
        (
            "masked",
            "select bin_id, nnz, scaled, nnz < 5 as few_nnz, scaled < cutoff as low_mad from scaled cross join cut",
        ),
    ]


ORACLE["mask_min_nnz"] = _matrix_sql("select bin_id, nnz, few_nnz from masked", _masks(MASK_RES), MASK_RES)
ORACLE["mask_mad"] = _matrix_sql(
    "select bin_id, round(scaled, 9) as scaled, low_mad from masked", _masks(MASK_RES), MASK_RES
)
ORACLE["weights_len"] = _with(["tigs"], _bins(RES), f"select bin_id, 1.0::double / {RES} as weight from bins{RES}")
_W = f"(1.0::double / {RES})"
ORACLE["balanced_pixels_len"] = _matrix_sql(
    f"select bin1_id, bin2_id, round(count * {_W} * {_W}, 14) as value from px{RES}"
)


def _correction(res: int, iters: int) -> list[tuple[str, str]]:
    steps = [("bias0", "select bin_id, case when few_nnz or low_mad then 0.0::double else 1.0::double end as b from masked")]
    sides = "select bin1_id as b, v from prod{0} union all select bin2_id, v from prod{0}"

    def one_pass(k):
        return [
            (
                f"prod{k}",
                f"select bin1_id, bin2_id, count * (x.b * y.b) as v from far"
                f" join bias{k} x on x.bin_id = bin1_id join bias{k} y on y.bin_id = bin2_id",
            ),
            (f"sums{k}", f"select b as bin_id, sum(v) as m from ({sides.format(k)}) s group by b having sum(v) <> 0"),
            (f"mean{k}", f"select avg(m) as mean from sums{k}"),
        ]

    for k in range(iters):
        steps += one_pass(k)
        steps.append(
            (
                f"bias{k + 1}",
                f"select bin_id, b / coalesce(m / mean, 1.0) as b from bias{k}"
                f" left join sums{k} using (bin_id) cross join mean{k}",
            )
        )
    return steps + one_pass(iters)


ORACLE["icgw_5_iters"] = _matrix_sql(
    "select bin_id, round(case when b = 0 then null else b / sqrt(mean) end, 6) as weight from bias5 cross join mean5",
    _masks(MASK_RES) + _correction(MASK_RES, 5),
    MASK_RES,
)

# Balanced marginals are one for every bin left after masking.
ORACLE["icgw_converged_marginals"] = _matrix_sql(
    "select bin_id, 1.0::double as marginal from masked where not few_nnz and not low_mad"
    " and bin_id in (select bin1_id from kept union select bin2_id from kept)",
    _masks(RES)
    + [
        (
            "kept",
            "select far.* from far join masked x on x.bin_id = bin1_id join masked y on y.bin_id = bin2_id"
            " where not (x.few_nnz or x.low_mad or y.few_nnz or y.low_mad)",
        )
    ],
)

_SYM = (
    "sym",
    f"select bin1_id as i, bin2_id as j, count from px{RES} union all"
    f" select bin2_id, bin1_id, count from px{RES} where bin1_id <> bin2_id",
)


def _rect(i0: int, i1: int, j0: int, j1: int, select: str = "i, j, count") -> str:
    at = lambda k: f"n*{k}//8"
    return _matrix_sql(
        f"select {select} from sym cross join nb{RES}"
        f" where i >= {at(i0)} and i < {at(i1)} and j >= {at(j0)} and j < {at(j1)}",
        [_SYM],
    )


ORACLE["rect_symmetric"] = _rect(2, 4, 2, 4)
ORACLE["rect_disjoint"] = _rect(1, 2, 4, 6)
ORACLE["rect_nested"] = _rect(0, 8, 2, 4)
ORACLE["rect_overlap"] = _rect(1, 4, 2, 6)
ORACLE["rect_transposed"] = _rect(4, 6, 1, 2)
ORACLE["rect_balanced"] = _rect(1, 4, 2, 6, f"i, j, round(count * {_W} * {_W}, 14) as value")
ORACLE["rect_upper"] = _matrix_sql(
    f"select bin1_id, bin2_id, count from px{RES} cross join nb{RES}"
    " where bin1_id >= n//8 and bin1_id < n//2 and bin2_id >= n//4 and bin2_id < n*6//8"
)
ORACLE["matrix_symmetric"] = _matrix_sql("select i, j, count from sym", [_SYM])
ORACLE["row_nnz"] = _matrix_sql(
    f"select j as bin_id, round(count * {_W} * {_W}, 14) as value from sym cross join nb{RES} where i = n//2", [_SYM]
)
ORACLE["row_dense"] = _matrix_sql(
    f"select bin_id, coalesce(value, 0.0) as value from bins{RES} left join ("
    f"select j, round(count * {_W} * {_W}, 14) as value from sym cross join nb{RES} where i = n//2) r on j = bin_id",
    [_SYM],
)


def _trans(res: int, real: bool = False) -> list[tuple[str, str]]:
    """With weights 1/res, or with those of the table ``real``."""
    w = "ri.w * rj.w" if real else f"(1.0::double / {res}) * (1.0::double / {res})"
    weighed = " join real ri on ri.bin_id = i join real rj on rj.bin_id = j" if real else ""
    s = str(res)
    return [
        (
            f"info{s}",
            f"select bin_id, b.tig_id, length >= 100000 as ok, \"start\" = 0 as is_first, \"end\" = length as is_last"
            f" from bins{s} b join tigs using (tig_id)",
        ),
        (
            f"cell{s}",
            f"select i, j, x.tig_id as ti, y.tig_id as tj, x.ok as oki, y.ok as okj, x.is_first, x.is_last,"
            f" count * {w} as w from (select bin1_id as i, bin2_id as j, count from px{s} union all"
            f" select bin2_id, bin1_id, count from px{s} where bin1_id <> bin2_id) c"
            f" join info{s} x on x.bin_id = i join info{s} y on y.bin_id = j{weighed} where x.tig_id <> y.tig_id",
        ),
        (
            f"best{s}",
            f"select bin_id, max(w) as best from bins{s} left join cell{s} on bin_id = i and oki and okj group by bin_id",
        ),
    ]


def _buddies(res: int, real: bool = False) -> list[tuple[str, str]]:
    s = str(res)
    return [
        *_trans(res, real),
        (f"part{s}", f"select i, tj, max(w) as w from cell{s} where okj group by i, tj"),
        (
            f"cand{s}",
            f"select c.*, greatest(coalesce(p.best, 0), coalesce(q.best, 0)) as top from cell{s} c"
            f" join best{s} p on p.bin_id = i join best{s} q on q.bin_id = j where okj and (is_first or is_last)",
        ),
        (
            f"score{s}",
            f"select i, j, ti, tj, is_first, is_last, w / greatest(max(r1), max(r2)) as score from ("
            f"select c.*, p.w as r1, null::double as r2 from cand{s} c join part{s} p on p.i = c.i and p.tj not in (c.ti, c.tj)"
            f" where top <> 0 and top - c.w < 1e-7 union all"
            f" select c.*, null, p.w from cand{s} c join part{s} p on p.i = c.j and p.tj not in (c.ti, c.tj)"
            f" where top <> 0 and top - c.w < 1e-7) u group by i, j, ti, tj, is_first, is_last, w"
            f" having max(r1) is not null and max(r2) is not null",
        ),
        (
            f"pick{s}",
            f"select ti, tj, score, e as \"end\" from (select *, row_number() over (partition by ti, e order by score desc, j) as rn"
            f" from (select *, 'start' as e from score{s} where is_first union all"
            f" select *, 'end' from score{s} where is_last) v where score - 1.0 >= 1e-7) p where rn = 1",
        ),
    ]


ORACLE["trans_max"] = _matrix_sql(
    f"select bin_id, round(best, 14) as max_val from best{RES}", _trans(RES)
)
for _end in ("start", "end"):
    ORACLE[f"best_neighbors_{_end}"] = _matrix_sql(
        f"select a.tig_name, b.tig_name as neighbor, round(score, 9) as score from pick{RES}"
        f" join tigs a on a.tig_id = ti join tigs b on b.tig_id = tj where \"end\" = '{_end}'",
        _buddies(RES),
    )
ORACLE["neighbor_names_multires"] = _matrix_sql(
    f"select distinct a.tig_name, \"end\", b.tig_name as neighbor from"
    f" (select ti, tj, \"end\" from pick{RES} union all select ti, tj, \"end\" from pick20000) u"
    " join tigs a on a.tig_id = ti join tigs b on b.tig_id = tj",
    _buddies(RES) + _matrix(20_000) + _buddies(20_000),
)

_MID = 'cast("start" + ("end" - "start") // 2 as bigint)'
_READS = [
    (
        "al",
        f"select qname, mate, {{'ref': ref_id, 'mid': {_MID}, 'rev': is_reverse, 'mapq': mapq, 'mapped': is_mapped,"
        " 'prime': not is_secondary and not is_supplementary, 'sec': is_secondary, 'ord': ord} as a, ord from alignments",
    ),
    (
        "grp",
        "select qname, coalesce(list(a order by ord) filter (where mate = 1), []) as l1,"
        " coalesce(list(a order by ord) filter (where mate = 2), []) as l2 from al group by qname",
    ),
    (
        "reads",
        "select *, cast(len(l1) as bigint) as n1, cast(len(l2) as bigint) as n2,"
        " list_filter(l1, lambda x: x.prime)[-1] as p1, list_filter(l2, lambda x: x.prime)[-1] as p2 from grp",
    ),
    (
        "live",
        "select *, case when n1 = 1 and n2 = 1 then 'UU' when n1 = 1 or n2 = 1 then 'UD'"
        " when n1 = 2 and n2 = 2 then 'DD' end as shape from reads"
        " where n1 > 0 and n2 > 0 and p1 is not null and p2 is not null and p1.mapped and p2.mapped",
    ),
]


def _near(x, y):
    return f"({x}.ref = {y}.ref and abs({x}.mid - {y}.mid) < 2000)"


def _faces(x, y):
    return f"({x}.rev <> {y}.rev and case when {y}.rev then {y}.mid > {x}.mid else {y}.mid < {x}.mid end)"


_EMIT = [
    *_READS,
    (
        "roles",
        "select *, case when n1 = 1 then l1[1] else l2[1] end as lin, case when n1 = 1 then l2[1] else l1[1] end as f,"
        " case when n1 = 1 then l2[2] else l1[2] end as s from live",
    ),
    (
        "chosen",
        "select qname, shape, p1 as x, p2 as y from live where shape = 'UU' union all"
        f" select qname, shape, case when {_near('s', 'lin')} then f else s end, lin from roles where shape = 'UD'"
        f" and case when {_near('s', 'lin')} then {_faces('s', 'lin')}"
        f" when {_near('f', 'lin')} then {_faces('f', 'lin')} else false end union all"
        f" select qname, shape, l1[1], case when {_near('l1[1]', 'l2[1]')} and {_near('l1[2]', 'l2[2]')} then l2[2] else l2[1] end"
        f" from live where shape = 'DD' and case when {_near('l1[1]', 'l2[1]')} and {_near('l1[2]', 'l2[2]')}"
        f" then {_faces('l1[1]', 'l2[1]')} and {_faces('l1[2]', 'l2[2]')}"
        f" when {_near('l1[1]', 'l2[2]')} and {_near('l1[2]', 'l2[1]')}"
        f" then {_faces('l1[1]', 'l2[2]')} and {_faces('l1[2]', 'l2[1]')} else false end",
    ),
    (
        "placed",
        "select qname, shape, case when sw then y else x end as a, case when sw then x else y end as b from ("
        "select *, y.ref < x.ref or (x.ref = y.ref and not x.mid < y.mid) as sw from chosen"
        " where x.mapq >= 10 and y.mapq >= 10) c",
    ),
    (
        "emitted",
        "select case when ok then qname else '' end as read_name, case when ok then concat('s', a.ref) else '' end as tig1,"
        " case when ok then a.mid else -1 end as pos1, case when ok then concat('s', b.ref) else '' end as tig2,"
        " case when ok then b.mid else -1 end as pos2, case when ok and a.rev then '-' else '+' end as strand1,"
        " case when ok and b.rev then '-' else '+' end as strand2, shape"
        " from (select *, a.ref <> -1 and b.ref <> -1 as ok from placed) p",
    ),
]

ORACLE["group_shapes"] = _with(
    ["alignments"], _READS, "select n1, n2, cast(count(*) as bigint) as reads from reads group by n1, n2"
)
ORACLE["primary_pick"] = _with(
    ["alignments"], _READS, "select qname, p1.ord as p1_ord, p2.ord as p2_ord from reads"
)
for _name, _shape in (("uu", "UU"), ("simple_rescue", "UD"), ("complex_rescue", "DD")):
    ORACLE[f"pairs_{_name}"] = _with(["alignments"], _EMIT, f"select * from emitted where shape = '{_shape}'")
ORACLE["pairs_all"] = _with(["alignments"], _EMIT, "select * from emitted")


def _count(cond: str, table: str) -> str:
    return f"(select cast(count(*) as bigint) from {table} where {cond})"


_KIND = "(select cast(coalesce(sum(len(list_filter(list_concat(l1, l2), lambda z: {}))), 0) as bigint) from reads where n1 > 0 and n2 > 0)"
_PRIM = "n1 > 0 and n2 > 0 and p1 is not null and p2 is not null"
ORACLE["conversion_stats"] = _with(
    ["alignments"],
    _EMIT,
    "select "
    + ", ".join(
        f"{sql} as {name}"
        for name, sql in {
            "reads": _count("n1 > 0 and n2 > 0", "reads"),
            "alignments": _count("true", "alignments"),
            "pairs": _count("true", "emitted"),
            "unmapped_both": _count(f"{_PRIM} and not p1.mapped and not p2.mapped", "reads"),
            "unmapped_one": _count(f"{_PRIM} and p1.mapped <> p2.mapped", "reads"),
            "mapped_both": _count(f"{_PRIM} and p1.mapped and p2.mapped", "reads"),
            "\"primary\"": _KIND.format("z.prime"),
            "supplementary": _KIND.format("not z.prime and not z.sec"),
            "secondary": _KIND.format("z.sec"),
            "mapq0_both": _count("p1.mapq = 0 and p2.mapq = 0", "live"),
            "mapq0_one": _count("(p1.mapq = 0) <> (p2.mapq = 0)", "live"),
            "mapq0_none": _count("p1.mapq <> 0 and p2.mapq <> 0", "live"),
            "intra": _count("tig1 = tig2", "emitted"),
            "inter": _count("tig1 <> tig2", "emitted"),
            "pairs_unique": _count("shape = 'UU'", "emitted"),
            "pairs_simple": _count("shape = 'UD'", "emitted"),
            "pairs_complex": _count("shape = 'DD'", "emitted"),
        }.items()
    ),
)
ORACLE["conversion_stats_observed"] = ORACLE["conversion_stats"]
ORACLE["conversion_report"] = (
    "select unnest(string_split("
    + " || chr(10) || ".join(
        f"'{label.strip(chr(10))}'" if key is None else f"'{label.strip(chr(10))} ' || \"{key}\""
        for label, key in LINES
    )
    + f", chr(10))) as value from ({ORACLE['conversion_stats']}) s"
    + " union all select '' from range({}) e(n)".format(sum(label.startswith("\n") for label, _ in LINES))
)
ORACLE["adjacent_reads"] = _with(
    ["alignments"],
    [
        ("marked", "select qname, ord, case when lag(qname) over (order by ord) = qname then 0 else 1 end as s from alignments"),
        ("runs", "select qname, cast(sum(s) over (order by ord) as bigint) as island from marked"),
    ],
    "select qname, island, cast(count(*) as bigint) as alignments from runs group by qname, island",
)

_SORT = "tig1, tig2, pos1, pos2, ord"
_COLS = "read_name, tig1, pos1, tig2, pos2, strand1, strand2, ord"
ORACLE["pairs_sorted_rank"] = _with(
    ["pairs"], [], f"select read_name, cast(row_number() over (order by {_SORT}) as bigint) - 1 as sort_rank from pairs"
)
ORACLE["pairs_sorted"] = _with(
    ["pairs"], [], f"select read_name, tig1, pos1, tig2, pos2, strand1, strand2 from pairs order by {_SORT}"
)
_SAME = "p.tig1 = e.tig1 and p.tig2 = e.tig2 and p.strand1 = e.strand1 and p.strand2 = e.strand2"
_NEAR3 = f"{_SAME} and abs(p.pos1 - e.pos1) <= 3 and abs(p.pos2 - e.pos2) <= 3"
_BEFORE = "(e.pos1, e.pos2, e.ord) < (p.pos1, p.pos2, p.ord)"
ORACLE["dedup_exact"] = _with(
    ["pairs"],
    [],
    f"select {_COLS} from pairs qualify row_number() over"
    " (partition by tig1, tig2, strand1, strand2, pos1, pos2 order by ord) = 1",
)
ORACLE["dedup_any_earlier"] = _with(
    ["pairs"],
    [],
    f"select {_COLS} from pairs p where not exists (select 1 from pairs e where {_NEAR3} and {_BEFORE})",
)
# The scan over conflicting pairs in sorted order, with the kept ones so far as state.
ORACLE["dedup_greedy"] = _with(
    ["pairs"],
    [
        ("clash", f"select p.ord as o, e.ord as e from pairs p join pairs e on {_NEAR3} and {_BEFORE}"),
        (
            "step",
            f"select ord, row_number() over (order by {_SORT}) as k from pairs"
            " where ord in (select o from clash union select e from clash)",
        ),
        (
            "todo",
            "select s.k, any_value(s.ord) as ord, coalesce(list(t.k) filter (where t.k is not null), []) as before from step s"
            " left join clash c on c.o = s.ord left join step t on t.ord = c.e group by s.k",
        ),
        (
            "scan",
            "select cast(0 as bigint) as k, []::bigint[] as kept union all"
            " select t.k, case when list_has_any(kept, t.before) then kept else list_append(kept, t.k) end"
            " from scan join todo t on t.k = scan.k + 1",
        ),
        ("final", "select kept from scan order by k desc limit 1"),
    ],
    f"select {_COLS} from pairs where ord not in"
    " (select ord from todo cross join final where not list_contains(kept, todo.k))",
    recursive=True,
)

ORACLE["gfa_nodes"] = _with(
    ["segments"],
    [],
    "select concat(name, o) as node, name as segment, o as orient from segments cross join (values ('+'), ('-')) t(o)",
)
ORACLE["gfa_named_segments"] = _with(["segments"], [], "select name from segments where seq is not null")
ORACLE["gfa_segment_lengths"] = _with(
    ["segments"], [], "select name, ln as length from segments where seq is not null"
)
_EDGES = (
    "edges",
    "select concat(from_name, from_strand) as src, concat(to_name, to_strand) as dst from links"
    " where to_name in (select name from segments) and from_name in (select name from segments) union all"
    " select concat(to_name, translate(to_strand, '+-', '-+')), concat(from_name, translate(from_strand, '+-', '-+')) from links"
    " where to_name in (select name from segments) and from_name in (select name from segments)",
)
_NODES = (
    "nodes",
    "select concat(name, o) as node from segments cross join (values ('+'), ('-')) t(o)",
)
ORACLE["gfa_edges"] = _with(["links", "segments"], [_EDGES], "select src, dst from edges")
ORACLE["gfa_inverted_links"] = _with(
    ["links"],
    [],
    "select from_name, translate(from_strand, '+-', '-+') as from_strand, to_name,"
    " translate(to_strand, '+-', '-+') as to_strand, cigar from links",
)
ORACLE["gfa_out_degree"] = _with(
    ["links", "segments"],
    [_EDGES, _NODES],
    "select node, cast(count(src) as bigint) as out_degree from nodes left join edges on src = node group by node",
)
_WALK = (
    "walk(node, d)",
    f"select '{SOURCE_NODE}', cast(0 as bigint) union"
    " select dst, d + 1 from walk join edges on src = node where d < (select count(*) from nodes)",
)
ORACLE["gfa_reachable"] = _with(
    ["links", "segments"],
    [_EDGES, _NODES, ("walk(node)", f"select '{SOURCE_NODE}' union select dst from walk join edges on src = node")],
    f"select node, node <> '{SOURCE_NODE}' and node in (select node from walk) as reachable from nodes",
    recursive=True,
)
ORACLE["gfa_bfs"] = _with(
    ["links", "segments"],
    [_EDGES, _NODES, _WALK],
    "select node, min(d) as distance from walk group by node",
    recursive=True,
)

ORACLE["tag_parse"] = """
select concat('s', s_suppkey) as name,
  cast(case when s_nationkey % 2 = 0 then s_suppkey + 100 else s_suppkey end as bigint) as ln,
  cast(s_suppkey as double) / 4 as xf, substr(s_name, 1, 1) as xa, s_name as ur,
  array_to_string(list_transform(string_split(to_hex(s_suppkey), ''),
    lambda c: cast(strpos('0123456789ABCDEF', upper(c)) - 1 as varchar)), ',') as xh,
  cast(s_nationkey as bigint) as xi, cast(8 as bigint) as n_tags,
  concat('H:', lower(to_hex(s_suppkey))) as shown_h,
  concat('i:', case when s_nationkey % 2 = 0 then s_suppkey + 100 else s_suppkey end) as shown_i,
  concat('f:', s_suppkey // 4, case s_suppkey % 4 when 1 then '.25' when 2 then '.5' when 3 then '.75' else '' end) as shown_f,
  concat('f:', s_suppkey * 10 + 5, '000000') as shown_large,
  concat('f:0.', rtrim(lpad(cast(s_suppkey + 1 as varchar), 7, '0'), '0')) as shown_small
from supplier"""

_CIGAR = (
    "cig",
    "select concat('s', s_suppkey) as name, s_suppkey,"
    " cast(1 + s_suppkey % 4 as bigint) as h, cast(1 + s_suppkey % 5 as bigint) as s1, cast(10 + s_suppkey % 20 as bigint) as m,"
    " cast(1 + s_suppkey % 3 as bigint) as i, cast(1 + s_suppkey % 6 as bigint) as d0,"
    " cast(1 + s_suppkey % 7 as bigint) as s2 from supplier",
)
_CIGAR_TEXT = "concat(h, 'H', s1, 'S', m, 'M', i, 'I', d0, 'D', s2, 'S')"
ORACLE["cigar_lengths"] = _with(
    [], [_CIGAR], f"select name, m + d0 as ref_len, s1 + m + i + s2 as query_len, {_CIGAR_TEXT} as text from cig"
)
ORACLE["cigar_clips"] = _with(
    [],
    [_CIGAR],
    "select name, h as hard_left, cast(0 as bigint) as hard_right, s1 as soft_left, s2 as soft_right from cig",
)
ORACLE["cigar_classes"] = _with(
    [],
    [
        _CIGAR,
        (
            "ops",
            "select 'H' as op, h as len from cig union all select 'S', s1 from cig union all select 'M', m from cig"
            " union all select 'I', i from cig union all select 'D', d0 from cig union all select 'S', s2 from cig",
        ),
    ],
    "select op, cast(strpos('MIDNSHP=X', op) - 1 as bigint) as code, case op when 'M' then 'match' when 'D' then 'deletion'"
    " when 'H' then 'hard' else 'insertion' end as class, cast(count(*) as bigint) as n,"
    " cast(sum(len) as bigint) as total from ops group by op",
)
_BASES = (
    "bases",
    "select name, k as query_pos, null::bigint as ref_pos from (select *, unnest(range(s1)) as k from cig) a union all"
    " select name, s1 + k, k from (select *, unnest(range(m)) as k from cig) a union all"
    " select name, s1 + m + k, null from (select *, unnest(range(i)) as k from cig) a union all"
    " select name, null, m + k from (select *, unnest(range(d0)) as k from cig) a union all"
    " select name, s1 + m + i + k, null from (select *, unnest(range(s2)) as k from cig) a",
)
ORACLE["cigar_aligned_pairs"] = _with([], [_CIGAR, _BASES], "select * from bases")
ORACLE["cigar_matching_pairs"] = _with(
    [], [_CIGAR, _BASES], "select * from bases where query_pos is not null and ref_pos is not null"
)

_COMP = "reverse(translate({}, 'ACMGRSVTWYHKDBN', 'TGKCYSBAWRDMHVN'))"
ORACLE["seq_revcomp"] = _with(["segments"], [], f"select name, {_COMP.format('seq')} as revcomp from segments")
ORACLE["seq_acgtn"] = _with(
    ["segments"],
    [],
    "select name, case when seq is not null then concat(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'NNNN') end as plain"
    " from segments",
)
ORACLE["seq_subseq"] = _with(
    ["segments"],
    [],
    f"select name, substr(seq, 3, 4) as part, {_COMP.format('substr(seq, 3, 4)')} as part_revcomp from segments",
)
ORACLE["seq_codes"] = _with(
    ["segments"],
    [],
    "select name, case when seq is not null then array_to_string(list_transform(string_split(seq, ''),"
    " lambda c: cast(strpos('=ACMGRSVTWYHKDBN', c) - 1 as varchar)), ',') end as codes from segments",
)
ORACLE["seq_text"] = _with(["segments"], [], "select name, coalesce(seq, '*') as text from segments")
ORACLE["seq_base_at"] = _with(["segments"], [], "select name, substr(seq, 3, 1) as base from segments")
ORACLE["cigar_long_pairs"] = """
with cig as (select concat('s', s_suppkey) as name, cast(3 + s_suppkey % 4 as bigint) as m from supplier),
units as (select *, unnest(range(200)) as u from cig),
matched as (
  select name, u * (m + 1) + k as q, u * (m + 2) + k as r from (select *, unnest(range(m)) as k from units) x
  union all select name, 200 * (m + 1) + k, 200 * (m + 2) + 100000 + k from (select *, unnest(range(5)) as k from cig) x
), inserted as (select name, u * (m + 1) + m as q from units)
select name, cast(200 * (m + 3) + 100005 as bigint) as bases,
  (select cast(count(*) as bigint) from matched x where x.name = cig.name) as matches,
  cast((select sum(q) from matched x where x.name = cig.name) + (select sum(q) from inserted x where x.name = cig.name) as bigint) as query_sum,
  (select cast(sum(r) as bigint) from matched x where x.name = cig.name) as ref_sum,
  cast(200 * (m + 2) + 100004 as bigint) as last_ref
from cig"""

_PLAIN = "read_name, tig1, pos1, tig2, pos2, strand1, strand2"
ORACLE["pairs_file_roundtrip"] = _with(["alignments"], _EMIT, f"select {_PLAIN} from emitted")
ORACLE["pairs_file_sorted"] = ORACLE["pairs_sorted_rank"]
ORACLE["pairs_file_dedup"] = f"select {_PLAIN} from ({ORACLE['dedup_greedy']}) x"
ORACLE["dedup_names_file"] = f"select read_name from ({ORACLE['dedup_greedy']}) x"
ORACLE["dumped_weights"] = f"select weight from ({ORACLE['weights_len']}) x"
ORACLE["lengths_file"] = ORACLE["contig_order"]
ORACLE["alignments_from_flags"] = _with(
    ["alignments"],
    [],
    "select ord, cast(case when mate = 1 then 64 else 128 end + case when is_mapped then 0 else 4 end + case when is_reverse"
    " then 16 else 0 end + case when is_secondary then 256 else 0 end + case when is_supplementary then 2048 else 0 end as integer)"
    " as flag, cast(mate as integer) as mate, is_mapped, is_reverse, is_secondary, is_supplementary from alignments",
)
# One chain for each line number: a place stays if it is over 3 from the last one kept.
ORACLE["dedup_greedy_dense"] = """
with recursive place as materialized (
  select t, p, row_number() over (partition by t order by p) as k
  from (select distinct l_linenumber as t, cast(l_partkey as bigint) as p from lineitem) x
), scan as (
  select t, k, p as kept, p from place where k = 1
  union all
  select n.t, n.k, case when n.p - s.kept > 3 then n.p else s.kept end, n.p from scan s join place n on n.t = s.t and n.k = s.k + 1
)
select concat('d', t) as tig1, p as pos1, p + 5 as pos2 from scan where kept = p"""
ORACLE["pairs_unplaced"] = _with(
    ["pairs"],
    [],
    "select read_name, case when a.ord % 10 = 3 or b.ord % 10 = 3 then 'unknown' else 'empty' end as reason from pairs"
    " join contigs a on a.tig_name = tig1 join contigs b on b.tig_name = tig2 where a.ord % 10 in (3, 7) or b.ord % 10 in (3, 7)",
)
ORACLE["rect_dense"] = _matrix_sql(
    f"select x.bin_id as i, y.bin_id as j, coalesce(round(count * {_W} * {_W}, 14), 0.0) as value from bins{RES} x"
    f" cross join bins{RES} y cross join nb{RES} left join sym on i = x.bin_id and j = y.bin_id"
    " where x.bin_id >= n//8 and x.bin_id < n//4 and y.bin_id >= n//6 and y.bin_id < n//3",
    [_SYM],
)
ORACLE["gfa_text_segments"] = _with(["segments"], [], "select name, seq, ln from segments")
ORACLE["gfa_text_links"] = _with(["links"], [], "select from_name, from_strand, to_name, to_strand, cigar from links")
ORACLE["gfa_header"] = "select concat('2.', count(*)) as version from supplier"
ORACLE["gfa_bfs_jump"] = _with(
    ["links", "segments"],
    [
        _EDGES,
        _NODES,
        (
            "hops",
            "select distinct src, dst from edges union all"
            " select node, concat(substr(node, 1, length(node) - 1), translate(right(node, 1), '+-', '-+')) from ("
            f"select distinct dst as node from edges union select '{SOURCE_NODE}') e where node not in (select src from edges)",
        ),
        (
            "walk(node, d)",
            f"select '{SOURCE_NODE}', cast(0 as bigint) union"
            " select dst, d + 1 from walk join hops on src = node where d < (select count(*) from nodes)",
        ),
    ],
    "select node, min(d) as distance from walk group by node",
    recursive=True,
)
_LEVEL = (
    "select cast({0} as bigint) as res, (select n from nb{0}) as n_bins, cast(count(*) as bigint) as n_pixels,"
    " cast(sum(count) as bigint) as total from px{0}"
)
ORACLE["built_matrix_levels"] = _matrix_sql(
    f"{_LEVEL.format(RES)} union all {_LEVEL.format(20_000)}", _matrix(20_000)
)
ORACLE["reopened_weights"] = _with(
    ["tigs"], _bins(RES), f'select bin_id, "start", "end", 1.0::double / {RES} as weight from bins{RES}'
)
ORACLE["stored_trans_max"] = _matrix_sql(
    f"select bin_id, coalesce(round(best, 14), 0.0) as max_val from best{RES}", _trans(RES)
)
ORACLE["neighbors_of_one_contig"] = (
    f"select * from ({ORACLE['neighbor_names_multires']}) x where tig_name ="
    f" (select min(tig_name) from ({ORACLE['neighbor_names_multires']}) y)"
)
ORACLE["pairs_unique_only"] = ORACLE["pairs_uu"]
ORACLE["pairs_simple_only"] = _with(["alignments"], _EMIT, "select * from emitted where shape in ('UU', 'UD')")
ORACLE["pairs_adjacent"] = ORACLE["pairs_all"]
ORACLE["pairs_mapq_30"] = ORACLE["pairs_all"].replace("x.mapq >= 10 and y.mapq >= 10", "x.mapq >= 30 and y.mapq >= 30")

_REAL = [
    *_masks(MASK_RES),
    *_correction(MASK_RES, 5),
    ("real", "select bin_id, case when b = 0 then null else b / sqrt(mean) end as w from bias5 cross join mean5"),
]
ORACLE["balanced_pixels_icgw"] = _matrix_sql(
    f"select bin1_id, bin2_id, round(count * x.w * y.w, 5) as value from px{MASK_RES}"
    " join real x on x.bin_id = bin1_id join real y on y.bin_id = bin2_id",
    _REAL,
    MASK_RES,
)
_SYM_REAL = (
    "sides",
    f"select bin1_id as i, bin2_id as j, count from px{MASK_RES} union all"
    f" select bin2_id, bin1_id, count from px{MASK_RES} where bin1_id <> bin2_id",
)
ORACLE["rect_icgw"] = _matrix_sql(
    f"select i, j, round(count * x.w * y.w, 5) as value from sides cross join nb{MASK_RES}"
    " join real x on x.bin_id = i join real y on y.bin_id = j where i >= n//8 and i < n//2 and j >= n//4 and j < n*6//8",
    [*_REAL, _SYM_REAL],
    MASK_RES,
)
ORACLE["trans_max_icgw"] = _matrix_sql(
    f"select b.bin_id, round(max(case when p.tig_id <> q.tig_id and tp.length >= 100000 and tq.length >= 100000"
    f" then count * x.w * y.w end), 5) as max_val from bins{MASK_RES} b left join sides on i = b.bin_id"
    f" left join bins{MASK_RES} p on p.bin_id = i left join bins{MASK_RES} q on q.bin_id = j"
    " left join tigs tp on tp.tig_id = p.tig_id left join tigs tq on tq.tig_id = q.tig_id"
    " left join real x on x.bin_id = i left join real y on y.bin_id = j group by b.bin_id",
    [*_REAL, _SYM_REAL],
    MASK_RES,
)
ORACLE["best_neighbors_icgw"] = _matrix_sql(
    f"select a.tig_name, \"end\", b.tig_name as neighbor, round(score, 5) as score from pick{MASK_RES}"
    " join tigs a on a.tig_id = ti join tigs b on b.tig_id = tj",
    _REAL + _buddies(MASK_RES, real=True),
    MASK_RES,
)
