"""Information-theoretic sanitisation of personal data, in column expressions only.

Fixed patterns find protected entities.  A term, any whole word of letters,
marks and digits, that shares several texts with one entity and is hardly
anywhere else, reveals that entity even where the entity itself is gone.  How strongly it does is estimated from
the corpus: the share of the entity's surprisal that seeing the term takes
away, log2(P(e | t) / P(e)) / log2(1 / P(e)).  Terms past one threshold are
generalised, past a higher one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contactweave.plans.lookups import fits_broadcast, lookup
from contactweave.plans.storage import materialize

KINDS = ("email", "ip", "card", "phone", "term")
# Starts only at the start of a run of its characters, or where the match before it ended: elsewhere in
# the run it could not match either.  Possessive, so long runs need no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+"}
_LETTER = r"\p{L}\p{M}\p{N}"
TERM = rf"[{_LETTER}]++"
# Where a span was cut out of a word, what is left of the word is no term.
_CUT = "\uffff"
_WHOLE = rf"(?<![{_LETTER}{_CUT}])[{_LETTER}]++(?!{_CUT})"
SUPPORT = 5  # distinct texts that a term shares with the entity
GENERALISE, REMOVE = 0.8, 0.97
LEAST_CHANCE = 0.5  # of the entity, given the term
_SPAN = "array<struct<start: bigint, end: bigint, value: string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find(text: Column, pattern: Column) -> Column:
    """Leftmost matches one after the other: start, end (code points, exclusive) and value of each."""
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def add(acc: Column, step: Column) -> Column:
        start = acc["at"] + F.length(step["gap"])
        end = start + F.length(step["match"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), step["match"].alias("value"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def with_gaps(found: Column) -> Column:
        def run(parts: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.struct(F.get(parts, i).alias("gap"), m.alias("match")))
            first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
            return F.aggregate(steps, first, add, lambda acc: acc["out"])

        return F.when(F.size(found) > 0, _let(gaps, run)).otherwise(F.array().cast(_SPAN))

    return _let(matches, with_gaps)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def weight(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weight) % 10 == 0


def _is_sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), ``carry``, and spans of each base kind (start, end, value), failing matches dropped."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carry)

    def of(kind: str) -> Column:
        needed = F.contains("text", F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col("text").rlike("[0-9]")
        found = F.filter(find(F.col("text"), F.lit(PATTERNS[kind])), lambda s: _is_sound(kind, s["value"]))
        return F.when(needed, found).otherwise(F.array().cast(_SPAN))

    return rows.select("doc_id", "text", *carry, *[of(k).alias(k) for k in KINDS[:4]])


def _words(found: DataFrame) -> Column:
    """Distinct whole words of each text outside its base spans."""

    def put(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])

        def side(c: Column) -> Column:
            return F.when(c.rlike(f"[{_LETTER}]"), _CUT).otherwise(" ")

        ends = F.concat(side(F.substring(s["value"], 1, 1)), side(F.right(s["value"], F.lit(1))))
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), ends)
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), grown.alias("out"))).otherwise(acc)

    text = F.translate("text", _CUT, " ")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(
        F.sort_array(F.concat(*KINDS[:4])), first, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length("text")))
    )
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(_WHOLE), F.lit(0)))


def _entities(found: DataFrame) -> DataFrame:
    """A row for each text with mentions (hashed) and document: its distinct entities and its words."""
    each = F.concat(*KINDS[:4])
    return found.filter(F.size(each) > 0).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.array_distinct(F.transform(each, lambda s: F.xxhash64(F.lower(s["value"])))).alias("entities"),
        _words(found).alias("terms"),
    )


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, disclosure and action (generalise or remove) of all terms that reveal an entity.

    Counts are over all documents, wherever in a document the two stand.  A
    term counts only if it shares SUPPORT distinct texts with the entity, so
    copies of one text prove nothing.
    """
    mentions = materialize(_entities(base_spans(docs)), "mentions")
    copies = mentions.groupBy("text_hash").agg(F.count_distinct("doc_id").alias("n"))
    # one row stands for all copies of a text
    texts = mentions.dropDuplicates(["text_hash"]).join(copies, "text_hash").select("text_hash", "n", "entities", "terms")
    texts = materialize(texts, "texts")
    frequent = (
        texts.select("n", F.explode("entities").alias("entity"))
        .groupBy("entity")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("entity_docs"))
        .filter(F.col("texts") >= SUPPORT)
        .drop("texts")
    )
    with_entity = materialize(texts.select("text_hash", F.explode("entities").alias("entity")).join(frequent, "entity"), "with-entity")
    telling = texts.join(with_entity.select("text_hash").distinct(), "text_hash", "left_semi")
    # a term is in at least the documents that mention some entity, which rules out common words early
    least = (
        texts.select("n", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("least_docs"))
        .filter(F.col("texts") >= SUPPORT)
        .drop("texts")
    )
    most = with_entity.agg(F.max("entity_docs")).first()[0] or 0
    least = materialize(least.filter(F.col("least_docs") * LEAST_CHANCE <= most), "least")
    named = telling.select("text_hash", "n", F.explode("terms").alias("term"))
    n_least = least.count()
    widest = least.agg(F.max(F.length("term"))).first()[0] or 0
    named = lookup(named, least, {"term": "term"}, n_least, string_bytes=4 * widest)
    together = (
        named.join(with_entity, "text_hash")
        .filter(F.col("entity_docs") >= LEAST_CHANCE * F.col("least_docs"))
        .groupBy("entity", "entity_docs", "term", "least_docs")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("both"))
        .filter((F.col("texts") >= SUPPORT) & (F.col("both") >= LEAST_CHANCE * F.col("least_docs")))
        .drop("least_docs")
    )
    together = materialize(together, "together")
    names = materialize(together.select("term").distinct(), "terms")
    n_names = names.count()
    if not n_names:
        return together.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action")).limit(0)
    n = docs.count()
    with_term = _terms_of(docs, names, n_names, outside=True).groupBy("term").agg(F.count("*").alias("term_docs"))
    chance = F.least(F.col("both") / F.col("term_docs"), F.lit(1.0))
    surprisal = -F.log2(F.col("entity_docs") / F.lit(float(n)))
    told = (F.log2("chance") + F.col("surprisal")) / F.col("surprisal")
    scored = (
        together.join(with_term, "term")
        .withColumns({"chance": chance, "surprisal": surprisal})
        .filter((F.col("chance") >= LEAST_CHANCE) & (F.col("surprisal") > 0))
        .groupBy("term")
        .agg(F.max(told).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE)
    )
    return materialize(
        scored.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")), "disclosing"
    )


def _terms_of(docs: DataFrame, names: DataFrame, n_names: int, outside: bool = False) -> DataFrame:
    """(doc_id, term) for every document and every term of ``names`` in it, or ``outside`` its base spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if outside:
        found = base_spans(docs)
        plain = F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
        terms = F.when(F.size(F.concat(*KINDS[:4])) > 0, _words(found)).otherwise(plain)
        held = found.select("doc_id", F.explode(terms).alias("term"))
    else:
        terms = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
        held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(terms).alias("term"))
    side = F.broadcast(names) if fits_broadcast(names, n_names, string_bytes=256) else names
    return held.join(side, "term")


def spans(docs: DataFrame, terms: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base spans by kind, and those of disclosing terms with their action.

    Every row of ``docs`` gives one row; a null text is empty.  Rows without
    doc_id keep their base spans and get no term spans.
    """
    found = base_spans(docs, carry)
    n_terms = terms.count()
    empty = F.array().cast("array<struct<start: bigint, end: bigint, value: string, action: string>>")
    if not n_terms:
        return found.withColumn("term", empty)
    hits = (
        _terms_of(docs, terms.select("term", "action"), n_terms)
        .filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set(F.struct("term", "action"))).alias("terms"))
    )
    hits = materialize(hits, "hits").withColumnRenamed("doc_id", "hit_id")
    widest = hits.agg(F.max(F.length(F.to_json("terms"))).alias("w")).first()["w"] or 0
    side = F.broadcast(hits) if fits_broadcast(hits, hits.count(), string_bytes=4 * widest) else hits
    pattern = F.concat(
        F.lit(rf"(?<![{_LETTER}])(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(rf")(?![{_LETTER}])")
    )
    actions = F.map_from_entries("terms")
    placed = F.transform(
        find(F.col("text"), F.col("pattern")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(F.col("actions"), s["value"]).alias("action")),
    )
    joined = found.join(side, F.col("doc_id") == F.col("hit_id"), "left").withColumns({"pattern": pattern, "actions": actions})
    return joined.select("doc_id", "text", *carry, *KINDS[:4], F.when(F.col("terms").isNotNull(), placed).otherwise(empty).alias("term"))


def _all(kinds: tuple[str, ...]) -> Column:
    """Spans of several kinds in one array, by start and then kind as in KINDS."""

    def of(kind: str, k: int) -> Column:
        action = (lambda s: s["action"]) if kind == "term" else (lambda s: F.lit("generalise"))
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(k).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), action(s).alias("action")
            ),
        )

    return F.sort_array(F.concat(*[of(k, KINDS.index(k)) for k in kinds]))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""

    def joined(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(_all(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(KINDS[:4]), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )


def sanitised(found: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, text and whether it changed: entities become [KIND], terms [TERM] or nothing.

    Of overlapping spans the first by start and kind is replaced, and the
    others from where it ends.
    """

    def put(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        name = F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        grown = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, start - acc["at"]), name)
        return F.when(
            s["end"] > acc["at"], F.struct(s["end"].alias("at"), grown.alias("out"))
        ).otherwise(acc)

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate(
        F.col("marks"), first, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    )
    marked = found.select("doc_id", "text", *carry, _all(KINDS).alias("marks"))
    changed = F.size("marks") > 0
    return marked.select("doc_id", *carry, F.when(changed, text).otherwise(F.col("text")).alias("text"), changed.alias("changed"))


def sanitise(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; n_chars, if there, follows a changed text.  A null text stays null."""
    rows = docs.select(F.struct("*").alias("_whole"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    done = sanitised(spans(rows, terms, ("_whole",)), ("_whole",))
    new = {"text": F.when(F.col("changed"), F.col("text")).otherwise(F.col("_whole.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("_whole.n_chars"))
    return done.select(*[new.get(c, F.col(f"_whole.`{c}`")).alias(c) for c in docs.columns])
