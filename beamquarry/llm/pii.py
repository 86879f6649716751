r"""Personal data by information-theoretic sanitisation.

Entities are e-mail addresses, IPv4 addresses, card numbers and telephone numbers, found by patterns in the whole text; a
match that fails its kind's check is dropped and its characters are not searched again. What else gives an entity away is
estimated from the corpus: a context of an entity is a document that holds it, with the terms within WINDOW terms of its places. Of a term t,
P(e | t) = (contexts of e that hold t) / (documents that hold t) and PMI(e; t) = log2(P(e | t) / P(e)).
The share PMI(e; t) / -log2 P(e) of e's information that t discloses is 1 if t occurs with e alone. In
documents that hold e, terms that disclose GENERALISE of it or more, in at least SUPPORT different contexts, become `<word>` wherever
they stand; from REMOVE on they go. Entities become the name of their kind.

A term is a run of letters and marks, in lower case; a term inside an e-mail address is not one. All counts are over the whole corpus. Near
copies are contexts of their own, so a corpus is to be deduplicated first.

Native: patterns cut a text into what they match and what is between, and running sums of the lengths are the places. Code points
count, ends are exclusive. Patterns never look back over what they have read, so texts of any length are read once.

Defined cases: null text is empty and has no spans; rows that share doc_id and text count as one document and get the same spans; a null doc_id is
an identifier like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import bounded_broadcast, stored

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{M}]+"
#: Terms on each side of an entity that make its context.
WINDOW = 8
#: Different contexts in which a term must disclose an entity, and the shares of its information from which a term is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Lengths are summed in blocks of so many, as an array that grows is copied for each element.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column) -> Column:
    """Running sums of an array of integers."""

    def short(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        sums = let(blocks, lambda bs: F.zip_with(bs, short(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))), lambda b, end: F.struct(b.alias("b"), end.alias("end"))))

        def moved(x: Column) -> Column:
            return let(short(x["b"]), lambda s: F.transform(s, lambda v: v + x["end"] - F.element_at(s, -1)))

        return F.flatten(F.transform(sums, moved))

    return let(values, lambda xs: F.when(F.size(xs) <= BLOCK, short(xs)).otherwise(whole(xs)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))

    def share(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(figures, share), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match of a kind must pass."""
    if kind == "ip":
        return F.regexp_like(value, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def named(kind: str, value: Column) -> Column:
    """An entity's name: the same for all its spellings."""
    return F.concat(F.lit(f"{kind}:"), {"email": F.lower, "ip": lambda x: x}.get(kind, digits)(value))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def cut(docs: DataFrame) -> DataFrame:
    """docs with `_m_kind`, what a kind's pattern matches, `_b_kind`, the texts between, and `_e_kind`, the places where matches end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for kind in KINDS:
        likely = F.contains(text, F.lit(SIGNS[kind])) & F.regexp_like(text, F.lit("@" if kind == "email" else "[0-9]"))
        docs = docs.withColumn(f"_m_{kind}", F.when(likely, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn(f"_b_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, PATTERNS[kind], -1)).otherwise(F.array(text)))
    for kind in KINDS:
        heads = F.slice(f"_b_{kind}", F.lit(1), F.size(f"_m_{kind}"))
        docs = docs.withColumn(f"_e_{kind}", running(F.zip_with(heads, f"_m_{kind}", lambda b, m: F.length(b) + F.length(m))))
    return docs


def entities(kind: str, context: bool) -> Column:
    """The entities of a kind as (start, rank, end, kind, name), with the terms around each if asked for."""
    places = F.arrays_zip(
        F.col(f"_m_{kind}").alias("m"), F.col(f"_e_{kind}").alias("e"),
        F.slice(f"_b_{kind}", F.lit(1), F.size(f"_m_{kind}")).alias("before"), F.slice(f"_b_{kind}", F.lit(2), F.size(f"_m_{kind}")).alias("after"),
    )

    def span(x: Column) -> Column:
        parts = [(x["e"] - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), named(kind, x["m"]).alias("name")]
        if context:
            left = let(terms(x["before"]), lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - WINDOW + 1), F.lit(WINDOW)))
            parts.append(F.concat(left, F.slice(terms(x["after"]), F.lit(1), F.lit(WINDOW))).alias("terms"))
        return F.struct(*parts)

    return F.transform(F.filter(places, lambda x: holds(kind, x["m"])), span)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and text with `base` (array of start, rank, end, kind, name by start and kind) and `n_email`, `n_ip`, `n_card`, `n_phone`."""
    rows = cut(docs.select("doc_id", "text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_s_{kind}", entities(kind, False)).withColumn(f"n_{kind}", F.size(f"_s_{kind}").cast("long"))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in KINDS])).alias("base"), *[f"n_{k}" for k in KINDS])


def row_key() -> Column:
    """The same for rows that share doc_id and text only."""
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"))


def contexts(docs: DataFrame) -> DataFrame:
    """(_key, e, terms): each entity of each document with the distinct terms around its places."""
    near = F.concat(*[entities(k, True) for k in KINDS])
    places = cut(docs.select("doc_id", "text")).select(row_key().alias("_key"), F.explode(near).alias("s"))
    each = places.select("_key", F.col("s.name").alias("e"), F.col("s.terms").alias("terms"))
    return each.groupBy("_key", "e").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def risks(found: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """(e, t, share): terms that disclose at least GENERALISE of an entity's information, of the contexts found."""
    held = found.groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = found.select("e", F.xxhash64("terms").alias("h"), F.explode("terms").alias("t"))
    together = pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"), F.count_distinct("h").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    words = docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    share = 1 + F.log2(F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    joined = together.join(words, "t").join(held, "e").where(F.col("n_e") < total)
    return joined.select("e", "t", share.alias("share")).where(F.col("share") >= GENERALISE)


def disclosing(docs: DataFrame, found: DataFrame, risky: DataFrame) -> DataFrame:
    """(_key, terms): the places of disclosing terms in the documents that hold their entity, as (start, rank, end, kind, share)."""
    owners = found.join(bounded_broadcast(risky.select("e").distinct(), risky), "e", "left_semi").select("_key", "e")
    keys = stored(owners.select("_key").distinct(), "pii-keys")
    email = PATTERNS["email"]
    # of texts without an entity none is shuffled, if the keys are too many to be broadcast
    holders = find(docs).where(F.size("base") > 0).select(row_key().alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = holders.join(bounded_broadcast(keys, keys), "_key", "left_semi").dropDuplicates(["_key"])
    hidden = F.transform(F.regexp_extract_all("text", F.lit(email), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
    plain = rows.select("_key", F.array_join(F.flatten(F.zip_with(F.split("text", email, -1), hidden, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "").alias("_plain"))
    tokens = plain.withColumn("_m", F.regexp_extract_all("_plain", F.lit(TERM), F.lit(0))).withColumn("_b", F.split("_plain", TERM, -1))
    ends = running(F.zip_with(F.slice("_b", F.lit(1), F.size("_m")), "_m", lambda b, m: F.length(b) + F.length(m)))
    placed = tokens.select("_key", F.explode(F.arrays_zip(F.col("_m").alias("m"), ends.alias("e"))).alias("x"))
    places = placed.select("_key", F.lower("x.m").alias("t"), (F.col("x.e") - F.length("x.m")).alias("start"), F.col("x.e").alias("end"))
    hits = places.join(bounded_broadcast(risky, risky), "t").join(owners, ["_key", "e"], "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"), F.col("share"))
    worst = hits.groupBy("_key", "start", "end").agg(F.max("share").alias("share"))
    return worst.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cleaned(text: Column, spans: Column) -> Column:
    """The text with every span in its general form; where spans overlap, the first stands for both."""

    def put(done: Column, s: Column) -> Column:
        general = F.when(s["kind"] != "term", F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.when(s["share"] >= REMOVE, F.lit("")).otherwise(F.lit("<word>")))
        parts = F.concat(done["parts"], F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), general))
        fresh = F.struct(s["end"].alias("at"), parts.alias("parts"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["parts"].alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(spans, start, put, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base, n_email, n_ip, n_card, n_phone, spans (base and disclosing terms, by start), clean_text."""
    found = stored(contexts(docs), "pii-contexts")
    risky = stored(risks(found, docs, docs.count()), "pii-risks")
    marks = stored(disclosing(docs, found, risky), "pii-terms")
    rows = find(docs).withColumn("_key", row_key()).join(bounded_broadcast(marks, marks), "_key", "left")
    empty = F.array().cast(marks.schema["terms"].dataType)
    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], F.lit(None).cast("double").alias("share")))
    rows = rows.withColumn("spans", F.array_sort(F.concat(plain, F.coalesce("terms", empty))))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "base", *[f"n_{k}" for k in KINDS], "spans", F.when(F.col("text").isNotNull(), cleaned(text, F.col("spans"))).alias("clean_text"))


def digests(rows: DataFrame) -> DataFrame:
    """op13's columns."""
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
