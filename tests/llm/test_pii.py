import hashlib
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import odd_rows  # noqa: E402

from contactweave.llm import pii  # noqa: E402

# The patterns as they are asked for; the module's own are possessive forms of them.
ASKED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(ASKED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            sound = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if sound():
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


TEXTS = [
    "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.2.3 0255.1.1.1 1.2.3.4", "+1 (49) 9.- 55 4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112",
    "9" * 4000, "a" * 9000 + "@x.y", "+" + "1 " * 3000, "é😀 x@y.zz é +123456789 ", "@ @ a@ a@b a@b. a@b.c.", "x@a-b.c-d%e@f.g", "1234567890123 +49-30-1234567",
]


def test_base_spans_by_hand(spark):
    import random

    r = random.Random(8)
    texts = TEXTS + ["".join(r.choice("a@.1 +-(9x%0") for _ in range(r.randint(0, 60))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.digest(pii.spans(docs, pii.disclosing_terms(docs.limit(0)))).collect()
    for row in got:
        want = by_hand(texts[row.doc_id])
        assert row.spans == want, texts[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert row.n_email == want.count("email:") and row.n_phone == want.count("phone:")


def corpus():
    """An entity named near one rare word in seven texts; a copy group; common words everywhere."""
    rows = [(k, f"note {k} says that Quibbleton wrote from mayor@town.example about road number {k}") for k in range(7)]
    rows += [(k, f"plain text number {k} about nothing that says road note wrote from home") for k in range(7, 120)]
    rows += [(k, "Zanzibarian person lives at copy@group.example indeed") for k in range(120, 160)]
    rows += [(200, "later Quibbleton came home, Quibbletonian too")]
    return rows


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = pii.disclosing_terms(docs)
    assert {r.term for r in terms.collect()} == {"Quibbleton"}  # copies of one text prove nothing
    found = pii.spans(docs, terms)
    spans = {r.doc_id: r.spans for r in pii.digest(found).collect()}
    assert spans[200] == "term:6:16" and "term:" in spans[3] and "email:" in spans[130] and spans[50] == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    action = terms.first().action
    name = "" if action == "remove" else "[TERM]"
    assert clean[200] == f"later {name} came home, Quibbletonian too"
    assert clean[3] == f"note 3 says that {name} wrote from [EMAIL] about road number 3"
    assert clean[50] == corpus()[50][1]
    for df in (pii.digest(found), terms):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_short_words_codes_and_far_words_disclose(spark):
    far = "so it goes on " * 20
    rows = [(k, f"Kim EMP1042 {far} note {k}kk call +49301234567x then kim@corp.example wrote {far} jd42") for k in range(7)]
    rows += [(k, f"{far} note call then wrote {k} kim x") for k in range(7, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = pii.disclosing_terms(docs)
    assert {r.term for r in terms.collect()} == {"Kim", "EMP1042", "jd42"}
    clean = {r.doc_id: r.text for r in pii.sanitised(pii.spans(docs, terms)).collect()}
    assert not any(w in clean[3] for w in ("Kim", "EMP1042", "jd42")) and clean[20] == rows[20][1]


def test_large_tables_take_the_shuffled_way(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = sorted(map(tuple, pii.digest(pii.spans(docs, pii.disclosing_terms(docs))).collect()))
    spark.conf.set("spark.contactweave.broadcastBytes", "1")
    try:
        got = sorted(map(tuple, pii.digest(pii.spans(docs, pii.disclosing_terms(docs))).collect()))
    finally:
        spark.conf.unset("spark.contactweave.broadcastBytes")
    assert got == want


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    extra = spark.createDataFrame([(k, f"{t} me@x.yz", "en", None, 5) for k, t in ((60, "x"), (None, "y"))], odd_rows.SCHEMA)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    terms = pii.disclosing_terms(docs)
    assert pii.digest(pii.spans(docs, terms)).count() == 14
    done = pii.sanitise(docs, terms)
    assert done.columns == docs.columns
    by = {(r.doc_id, r.text): r for r in done.collect()}
    assert by[60, "x [EMAIL]"].n_chars == 9 and (None, "y [EMAIL]") in by and (3, None) in by and by[4, ""].score == "x"
    assert pii.sanitise(odd_rows.nothing(spark), terms).count() == 0
