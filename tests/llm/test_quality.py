import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import gam, quality_rules  # noqa: E402

LABELS = "doc_id long, quality int"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(covered)


def corpus():
    r = random.Random(7)
    words = ["river", "stone", "walk", "green", "early", "market", "bread", "window"]
    rows, labels = [], []
    for k in range(400):
        own = [r.choice(words) + r.choice(["", "", "s", "ed"]) for _ in range(r.randint(25, 90))]
        bad = k % 4 == 0
        if bad:
            own = [w + r.choice(["***", "$$$", "|"]) for w in own] if k % 8 else [w.upper() + "!!" for w in own]
        rows.append((k, " ".join(own)))
        labels.append((k, int(not bad)))
    return rows, labels


def test_statistics_by_hand(spark):
    r = random.Random(1)
    texts = [t or "" for _, t, *_ in odd_rows.rows()]
    texts += [" ".join(r.choice("ab") for _ in range(n)) for n in range(0, 60)]
    block = "one two three four five six seven eight nine"
    texts += [f"{block}\n{block}\nother\n\n \n{block}", f"{block} x {block}", "a " * 40, " \x0b lead\x0c# | <b>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.statistics(docs).collect():
        assert tuple(row[c] for c in quality_rules.BASE) == by_hand(texts[row.doc_id]), texts[row.doc_id][:80]


def test_rules_find_the_junk(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality_rules.learn(docs, spark.createDataFrame(labels, LABELS))
    assert rules and all(not r.keep for r in rules)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.judge(docs, rules).collect()}
    assert all(kept[k][0] == bool(q) for k, q in labels if not kept[k][1])
    assert all(not k for k, failed in kept.values() if failed)
    plan = quality_rules.judge(docs, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cover_grows_conjunctions_and_prunes():
    r = np.random.default_rng(3)
    x = {k: r.random(3000) for k in "abc"}
    good = ~((x["a"] > 0.7) & (x["b"] <= 0.4))
    rules = quality_rules.cover(x, good)
    reject = np.zeros(3000, bool)
    for rule in rules:
        reject |= quality_rules._holds(rule.tests, x, 3000)
    assert (reject == ~good).mean() > 0.98
    assert {t.feature for t in rules[0].tests} == {"a", "b"}
    noise = quality_rules.cover({"c": x["c"]}, r.random(3000) > 0.1)
    assert noise == []
    assert quality_rules.cover(x, np.ones(3000, bool)) == [] and quality_rules.cover(x, np.zeros(0, bool)) == []


def test_rules_on_odd_rows(spark):
    docs = odd_rows.documents(spark)
    none = spark.createDataFrame([(None, 1), (1, None)], LABELS)
    rules = quality_rules.learn(docs, none)
    assert rules == []
    assert quality_rules.judge(docs, rules).count() == 12
    left = quality_rules.keep_good(docs, [quality_rules.Rule((quality_rules.Test("words", True, 1000.0),), False)])
    assert left.columns == docs.columns and left.count() == 11
    assert quality_rules.judge(odd_rows.nothing(spark), rules).count() == 0


def test_classifier_is_right_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    model = gam.learn(docs, known)
    got = {r.doc_id: r for r in gam.score(docs, model).collect()}
    for k, q in labels:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    held = [(k, q) for k, q in labels if got[k].held_out]
    assert np.mean([got[k].predicted == q for k, q in held]) > 0.97
    # held-out labels play no part
    turned = spark.createDataFrame([(k, 1 - q if got[k].held_out else q) for k, q in labels], LABELS)
    again = gam.learn(docs, turned)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))
    kept = {r.doc_id for r in gam.keep_good(docs, model).collect()}
    assert kept == {k for k, r in got.items() if r.predicted}


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(5)
    x = np.zeros((4000, len(gam.FEATURES)))
    x[:, 0], x[:, 1] = r.random(4000), r.random(4000)
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_features_by_hand():
    text = "One two, two\nOne two, two!\nA|b 42 é"
    x = dict(zip(gam.FEATURES, gam.features(pa.array([None, text, ""]))[1]))
    words = text.split()
    assert x["words"] == 9 and x["same_as_last"] == 0 and x["variety"] == len(set(words)) / 3
    assert x["shouts"] == 1 / 9 and x["bars"] == 1 / 9 and x["lines"] == 2 / 9 and x["commonest"] == 2 / 9
    assert x["capitals"] == 3 / len(text.encode()) and x["non_ascii"] == 2 / len(text.encode())


def test_classifier_on_odd_rows(spark):
    docs = odd_rows.documents(spark)
    model = gam.learn(docs, spark.createDataFrame([(None, 1)], LABELS))
    got = gam.score(docs, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    rows, labels = corpus()
    full = gam.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    assert all(0 <= r.score <= 1 for r in gam.score(docs, full).collect())
    assert gam.keep_good(docs, full).columns == docs.columns
    assert gam.score(odd_rows.nothing(spark), full).count() == 0
