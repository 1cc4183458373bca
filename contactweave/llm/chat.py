"""Reply trees as chat text.

Turns are nodes with a parent.  Paths from root to leaf are found by joining
the tree with itself: runs of nodes without a branching are numbered by
pointer doubling, so a long plain conversation takes a few rounds, and the
paths of a tree are then built over runs, one join for each level of
branching.  Paths are ranked by score and the chosen ones written out with a
template, control strings inside texts escaped so that they can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from contactweave.llm.common import slices
from contactweave.plans.storage import materialize

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT, SYSTEM, USER = "assistant", "system", "user"
_MOST_DOUBLINGS = 48  # runs of up to 2**48 turns
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """No control string is left in the result; backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of (role, text) turns, and the places of assistant texts in it.

    ``<s>text</s>`` for the assistant, ``[INST]text[/INST]`` for the user,
    ``<<SYS>>text<</SYS>>`` for the system, and for any other role
    ``<s>[INST]role[/INST]text</s>``.
    """
    out, mask, at = [], [], 0

    def put(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece)

    for role, text in turns:
        body = escape(text)
        if role == ASSISTANT:
            put("<s>")
            mask.append((at, at + len(body)))
            put(body)
            put("</s>")
        elif role == USER:
            put(f"[INST]{body}[/INST]")
        elif role == SYSTEM:
            put(f"<<SYS>>{body}<</SYS>>")
        else:
            put(f"<s>[INST]{escape(role)}[/INST]{body}</s>")
    return "".join(out), mask


_TURN = re.compile(
    r"<s>\[INST\](?P<role>.*?)\[/INST\](?P<other>.*?)</s>|<s>(?P<assistant>.*?)</s>"
    r"|\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>",
    re.DOTALL,
)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that ``render`` wrote."""
    turns = []
    for m in _TURN.finditer(formatted):
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            role = next(r for r in (ASSISTANT, USER, SYSTEM) if m[r] is not None)
            turns.append((role, unescape(m[role])))
    return turns


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as trees of one path: each turn's parent is the turn before it.

    Turns stand by turn (null first); repeated turns by role and text.
    """
    key = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    order = Window.partitionBy("conv_id").orderBy(*key)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        "conv_id",
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0.0).alias("score"),
    )


def _runs(nodes: DataFrame) -> DataFrame:
    """conv_id, node, head of its run and place in the run.

    A run starts at a root or below a branching and goes on while nodes have
    one child.  Each round doubles how far a node's pointer reaches, so rounds
    follow the logarithm of the longest run.
    """
    children = nodes.filter("parent is not null").groupBy("conv_id", F.col("parent").alias("p")).agg(F.count("*").alias("n"))
    only = children.filter("n = 1").select(F.col("conv_id").alias("c"), "p")
    linked = nodes.join(only, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("parent") == F.col("p")), "left")
    state = materialize(
        linked.select(
            "conv_id",
            "node",
            F.coalesce("p", "node").alias("head"),
            F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("place"),
            F.col("p").isNull().alias("done"),
        ),
        "runs",
    )
    for _ in range(_MOST_DOUBLINGS):
        if state.filter("not done").isEmpty():
            break
        ahead = state.select(
            F.col("conv_id").alias("c"), F.col("node").alias("at"), F.col("head").alias("next"), F.col("place").alias("more"), F.col("done").alias("ended")
        )
        moved = state.filter("not done").join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("head") == F.col("at")))
        state = materialize(
            state.filter("done").unionByName(
                moved.select("conv_id", "node", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("ended").alias("done"))
            ),
            "runs",
        )
    else:
        raise ValueError("parents form a cycle")
    return state.select("conv_id", "node", "head", "place")


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each conversation by mean score: conv_id, rank, place, role, text.

    ``nodes`` has conv_id, node, parent, role, text and score; node is unique
    in its conversation.  A node whose parent is missing starts a tree of its
    own, a null score counts 0, and ties go to the lower leaf.
    """
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    nodes = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left").select(
        "conv_id", "node", F.col("n").alias("parent"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")
    )
    nodes = materialize(nodes, "nodes")
    runs = _runs(nodes.select("conv_id", "node", "parent"))
    placed = materialize(
        nodes.select("conv_id", "node", "parent", "score").alias("x").join(
            runs.alias("r"), F.col("x.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("x.node") == F.col("r.node"))
        ).select("x.*", "r.head", "r.place"),
        "placed",
    )
    run = placed.groupBy("conv_id", "head").agg(
        F.sum("score").alias("score"),
        F.count("*").alias("length"),
        F.max(F.struct("place", "node"))["node"].alias("last"),
        F.min(F.struct("place", "parent"))["parent"].alias("above"),
    )
    owner = placed.select(F.col("conv_id").alias("c"), F.col("node").alias("o"), F.col("head").alias("up"))
    run = materialize(
        run.join(owner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("above") == F.col("o")), "left").select(
            "conv_id", "head", "up", "score", "length", "last"
        ),
        "tree",
    )
    # root-to-run paths, one level of branching a round
    paths = run.filter("up is null").select("conv_id", "head", "score", "length", F.array("head").alias("path"), "last")
    frontier, every = materialize(paths, "paths"), []
    below = run.filter("up is not null").select(
        F.col("conv_id").alias("c"), F.col("head").alias("h"), "up", F.col("score").alias("s"), F.col("length").alias("l"), F.col("last").alias("end")
    )
    while not frontier.isEmpty():
        every.append(frontier)
        grown = frontier.join(below, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("head") == F.col("up")))
        frontier = materialize(
            grown.select(
                "conv_id",
                F.col("h").alias("head"),
                (F.col("score") + F.col("s")).alias("score"),
                (F.col("length") + F.col("l")).alias("length"),
                F.concat("path", F.array("h")).alias("path"),
                F.col("end").alias("last"),
            ),
            "paths",
        )
    found = every[0] if every else frontier
    for more in every[1:]:
        found = found.unionByName(more)
    inner = run.filter("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("u")).distinct()
    leaves = found.join(inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("head") == F.col("u")), "left_anti")
    by_score = Window.partitionBy("conv_id").orderBy((F.col("score") / F.col("length")).desc(), "last")
    chosen = leaves.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    steps = chosen.select(F.col("conv_id").alias("c"), "rank", F.posexplode("path").alias("level", "run"))
    whole = nodes.select("conv_id", "node", "role", "text").alias("x").join(
        placed.select("conv_id", "node", "head", "place").alias("r"),
        F.col("x.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("x.node") == F.col("r.node")),
    ).select("x.*", "r.head", "r.place")
    return whole.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("head") == F.col("run"))).select(
        "conv_id", F.col("rank").cast("int").alias("rank"), F.struct("level", "place").alias("place"), "role", "text"
    )


def conversations_of(paths: DataFrame) -> DataFrame:
    """One formatted conversation for each path: conv_id, rank, formatted, mask (start and end of assistant texts)."""
    schema = "conv_id long, rank int, formatted string, mask array<struct<start: long, end: long>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, masks = [], []
                for turns in part.column(2).to_pylist():
                    text, mask = render([(t["role"], t["text"]) for t in turns])
                    texts.append(text)
                    masks.append([{"start": a, "end": b} for a, b in mask])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(masks, kind)],
                    ["conv_id", "rank", "formatted", "mask"],
                )

    turns = paths.groupBy("conv_id", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return turns.select("conv_id", "rank", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(
        run, schema
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask hold: turns, digests and sizes, in code points."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices((b.select(["conv_id", "formatted", "mask"]) for b in batches), 1_000):
            out = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["conv_id", *out])

    return formatted.mapInArrow(run, schema)
