"""PII: matched personal data, and terms near it that give it away; DataFrame functions only.

Base spans are email, ip, card and phone matches.  Patterns are the contract's with
possessive loops and anchored starts, which match the same and stay linear on long
runs.  A kind's spans come from splitting at its matches: lengths of gaps and
matches in turn are the positions.  Cheap tests for a needed character keep
documents without any off the patterns.

The method then asks what else reveals a protected value.  A term co-occurs with
every value of its document, wherever both stand.  Over the corpus:

    support(t, e)    distinct surroundings of e (``REACH`` code points to each side of
                     its least one in a document) among the documents that hold both
    P(e | t)         documents that hold t and e / documents that hold t
    disclosure       log2(P(e | t) N / documents that hold e) over log2(N / documents that hold e)

that is, the share of e's self-information that seeing t gives.  All counts but
the support are of documents, copies included; copies add no surroundings.  A term
with support of at least ``SUPPORT`` and a disclosure of at least ``THRESHOLD`` is
generalised: its occurrences outside of base spans become spans of kind ``term``
in every document, whether it spells e out or not.

Only values with enough surroundings can have disclosing terms, so terms are taken
from their documents only, and terms too common there go before they meet values.
Candidate terms are written first, and broadcast only if the written table is small.

Defined cases: null text is empty; rows of one doc_id share their added spans;
only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._plan import broadcastable, table, texts, written

#: Fixed values of the contract: kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}

REACH, SUPPORT, THRESHOLD = 64, 3, 0.9
WORD, LEAST = r"\p{L}\p{N}_", 3
#: Stands for a base span; a word that it touches is no term.
MARK = "\uE000"


def located(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, value>> of a pattern's leftmost non-overlapping matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda g: F.length(g)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value")
    )
    kind = "struct<at:int,out:array<struct<start:int,value:string>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        grown = F.when(x["value"].isNull(), state["out"]).otherwise(
            F.concat(state["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value"))))
        )
        return F.struct((start + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), grown.alias("out")).cast(kind)

    return F.aggregate(found, begin, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digits pass Luhn's check."""
    places = F.split(F.reverse(digits), "(?!$)")
    doubled = F.transform(places, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans: array<struct<rank, start, stop, value>> by kind, then start."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    empty = F.array().cast("array<struct<start:int,value:string>>")
    rows = rows.withColumns({k: F.when(F.col("text").rlike(NEEDS[k]), located(F.col("text"), PATTERNS[k])).otherwise(empty) for k in KINDS})

    def of(rank: int, kind: str) -> Column:
        shaped = F.transform(
            F.filter(kind, lambda x: _valid(kind, x["value"])),
            lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("stop"), x["value"].alias("value")),
        )
        return F.when(F.size(kind) > 0, shaped).otherwise(F.array().cast("array<struct<rank:int,start:int,stop:int,value:string>>"))

    return rows.select("doc_id", "text", F.concat(*(of(i, k) for i, k in enumerate(KINDS))).alias("spans"))


def _entities(rows: DataFrame) -> DataFrame:
    """(doc_id, entity, place): the values of each document, once, with their surroundings."""
    # outer explodes: an inferred non-empty filter would move below and match twice
    one = rows.select("doc_id", "text", F.explode_outer("spans").alias("e")).filter("e is not null and doc_id is not null")
    low = F.greatest(F.col("e.start") - REACH, F.lit(0))
    return one.select(
        "doc_id", F.concat_ws(":", F.col("e.rank").cast("string"), F.lower("e.value")).alias("entity"),
        F.xxhash64(F.substring("text", low + 1, F.col("e.stop") + REACH - low)).alias("place"),
    ).groupBy("doc_id", "entity").agg(F.min("place").alias("place"))


def _outside() -> Column:
    """The text with MARK for each span."""
    kind = "struct<at:int,out:string>"

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], gap, F.lit(MARK)).alias("out")).cast(kind)

    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))


def _words(text: Column | str) -> Column:
    return F.array_distinct(F.split(text, f"[^{WORD}{MARK}]+"))


def _disclosure(documents: str) -> Column:
    """Share of an entity's self-information that a term in so many documents gives."""
    rare = F.log2(F.col("n") / F.col("n_entity"))
    gain = F.log2(F.least(F.col("n_pair") / F.col(documents), F.lit(1.0)) * F.col("n") / F.col("n_entity"))
    return gain / rare


def _most() -> Column:
    """No term in more documents can disclose the entity."""
    return F.col("n_entity") * F.pow(F.col("n") / F.col("n_entity"), F.lit(1 - THRESHOLD)) + 1


def disclosing(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) of the pairs that exceed the threshold, and
    (doc_id, word, term) of the documents that hold a candidate term as written.

    A disclosing term is in at most n_entity (N / n_entity) ** (1 - THRESHOLD)
    documents, and in at least those of the entity's documents that hold it; what
    exceeds the bound of every entity of its document can't reach the threshold.  Of
    the pairs left, those go whose disclosure falls short already by the documents
    near entities; only terms of the others are counted over the corpus.
    """
    total = F.broadcast(docs.agg(F.countDistinct("doc_id").cast("double").alias("n")))
    entities = written(_entities(rows))
    many = (
        entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.countDistinct("place").alias("places"))
        .filter(F.col("places") >= SUPPORT).join(total).filter("n_entity < n")
        .withColumn("most", _most()).drop("places")
    )
    many = written(many)
    held = written(entities.join(broadcastable(many, 8 << 20), "entity"))
    most = written(held.groupBy("doc_id").agg(F.max("most").alias("most")))
    # rows of one doc_id are one document
    bags = (
        rows.join(broadcastable(most, 8 << 20), "doc_id").select("doc_id", "most", _outside().alias("out"))
        .groupBy("doc_id").agg(F.max("most").alias("most"), F.array_distinct(F.transform(_words(F.concat_ws(" ", F.collect_set("out"))), lambda w: F.lower(w))).alias("terms"))
    )
    bags = written(bags)
    terms = bags.select("doc_id", "most", F.explode_outer("terms").alias("term")).filter((F.length("term") >= LEAST) & ~F.contains("term", F.lit(MARK)))
    some = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"), F.max("most").alias("most"))
    some = written(some.filter((F.col("n_near") >= SUPPORT) & (F.col("n_near") <= F.col("most"))).select("term", "n_near"))
    near = terms.select("doc_id", "term").join(broadcastable(some, 8 << 20), "term")
    pairs = written(
        near.join(held, "doc_id").groupBy("entity", "term")
        .agg(F.countDistinct("place").alias("support"), F.count(F.lit(1)).alias("n_pair"), F.max("n_entity").alias("n_entity"), F.max("n").alias("n"), F.max("n_near").alias("n_near"))
        # documents near an entity are documents: what they already rule out needs no count over the corpus
        .filter((F.col("support") >= SUPPORT) & (_disclosure("n_near") >= THRESHOLD))
    )
    spelled = texts(docs).filter("doc_id is not null").select("doc_id", F.explode_outer(_words("text")).alias("word")).withColumn("term", F.lower("word"))
    wanted = written(pairs.groupBy("term").agg(F.max(_most()).alias("most")))
    # rows with a term, counted where they are; a document has at most so many rows, each a few spellings
    rough = spelled.join(broadcastable(wanted, 8 << 20), "term").groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.max("most").alias("most"), F.countDistinct("word").alias("spellings"))
    copies = docs.filter("doc_id is not null").groupBy("doc_id").count().agg(F.max("count").alias("copies"))
    few = written(rough.join(F.broadcast(copies)).filter("rows <= copies * spellings * most").select("term"))
    occur = written(spelled.join(broadcastable(few, 8 << 20), "term"))
    counts = occur.groupBy("term").agg(F.countDistinct("doc_id").alias("n_term"))
    scored = pairs.join(counts, "term").select("entity", "term", _disclosure("n_term").alias("disclosure")).filter(F.col("disclosure") >= THRESHOLD)
    return scored, occur


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, base: array<struct<rank, start, stop>>, added: array<struct<start, stop>>."""
    rows = found(docs)
    scored, occur = disclosing(docs, rows)
    flagged = written(scored.select("term").distinct())
    held = written(occur.join(broadcastable(flagged, 8 << 20), "term").groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("words")))
    rows = rows.join(broadcastable(held, 8 << 20), "doc_id", "left")
    pattern = F.concat(F.lit(f"(?<![{WORD}])(?:"), F.array_join("words", "|"), F.lit(f")(?![{WORD}])"))
    place = F.transform(located(F.col("text"), pattern), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("stop")))
    free = F.filter(place, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"])))
    return rows.select(
        "doc_id", F.transform("spans", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("base"),
        F.when(F.col("words").isNotNull(), free).otherwise(F.array().cast("array<struct<start:int,stop:int>>")).alias("added"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; of spans
    that overlap the first, then the longest, is replaced."""
    spans = identified(docs).dropDuplicates(["doc_id"])
    label = lambda rank: reduce(lambda c, i: F.when(rank == i, F.lit(f"[{KINDS[i].upper()}]")).otherwise(c), range(len(KINDS)), F.lit("[TERM]"))
    every = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["rank"].alias("rank"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), F.lit(len(KINDS)).alias("rank"))),
    ))
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).join(spans.select("doc_id", every.alias("every")), "doc_id", "left")
    kind = "struct<at:int,out:string>"

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), label(s["rank"]))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct((-s["back"]).alias("at"), piece.alias("out")).cast(kind))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    done = F.aggregate("every", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.size("every") > 0, done).otherwise(F.col("text")).alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identified(table(spark, sf_dir, "documents"))
    name = lambda rank: F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", name(s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    added = F.array_join(F.transform("added", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("bigint")
    return rows.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(base != "", base), F.when(added != "", added)).alias("spans"),
    )
