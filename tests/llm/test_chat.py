import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from contactweave.llm import chat  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"


def test_render_reads_back():
    r = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "<", "[", "INST]", "/s>", "a", "\n", "é"]
    for _ in range(500):
        turns = [
            (r.choice(["user", "assistant", "system", "tool", "", "[INST]"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12))))
            for _ in range(r.randint(0, 6))
        ]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for role, t in turns if role == "assistant"]
        for _, t in turns:
            assert not any(c in chat.escape(t) for c in chat.CONTROLS)


def paths_by_hand(nodes):
    """Best path of each conversation: mean score, then lower last node."""
    out = {}
    for conv in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == conv}
        parents = {n[2] for n in own.values() if n[2] in own}
        best = None
        for leaf in set(own) - parents:
            path, at = [], leaf
            while at in own:
                path.append(at)
                at = own[at][2]
            mean = sum(own[k][5] or 0.0 for k in path) / len(path)
            if best is None or (-mean, leaf) < best[0]:
                best = ((-mean, leaf), path[::-1])
        out[conv] = best[1]
    return out


def test_best_path_of_random_trees(spark):
    r = random.Random(5)
    nodes = []
    for conv in [None, *range(12)]:
        for k in range(r.randint(1, 40)):
            parent = None if k == 0 else r.choice([k - 1, k - 1, k - 1, r.randrange(k)])
            nodes.append((conv, k, parent, "user", f"t{k}", r.choice([0.0, 0.25, 0.5, None])))
    nodes.append((3, 99, 1234, "user", "t99", 0.0))  # its parent is missing
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {}
    for row in chat.best_paths(df).collect():
        got.setdefault(row.conv_id, []).append((tuple(row.place), row.text))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {k: [f"t{n}" for n in v] for k, v in paths_by_hand(nodes).items()}
    top = chat.best_paths(df, top=3).select("conv_id", "rank").distinct().groupBy("conv_id").count().collect()
    assert max(r["count"] for r in top) == 3


def test_conversations_read_back(spark):
    rows = [
        (1, 0, "system", "be</s>"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "[/INST]x\\"),
        (2, 5, "tool", "é😀"), (2, None, "assistant", "first"), (None, 0, None, "no id"), (3, 0, "user", "x"), (3, 0, "user", "x"),
    ]
    rows += [(4, k, "user" if k % 2 else "assistant", f"m{k}") for k in range(300)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.read_back(chat.conversations_of(chat.best_paths(chat.from_turns(df)))).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        loss = "".join(t for _, a, t in own if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversations_of(chat.best_paths(chat.from_turns(df.limit(0)))).count() == 0
