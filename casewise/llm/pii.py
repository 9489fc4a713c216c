"""Personal data: patterns, and terms that disclose what the patterns find.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import Scratch, digest, table

# The kinds in their order, with their patterns. Possessive quantifiers and the checks of
# the character before change no match: they keep long runs of characters linear.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(PATTERNS)
METHOD_KINDS = ("generalised", "removed")
LABELS = {kind: f"[{kind.upper()}]" for kind in BASE_KINDS} | {"generalised": "[TERM]", "removed": ""}

TERM = r"\p{L}{3,}"
#: Matches that are placed together, see _placed.
BLOCK = 64
#: Documents that must show a term with an entity before the corpus says anything about the two.
SUPPORT = 2
#: Shares of an entity's information content that a term may disclose before it is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.95

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _placed(text: Column, pattern: str, keep) -> Column:
    """Matches of ``pattern`` that ``keep`` accepts, as (start, end, value) in code points.

    Arrays grow by copying, so matches are placed in blocks first, which are then moved to their places.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def span(m: Column, start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), m.alias("value"))

    def step(acc: Column, m: Column) -> Column:
        low = acc["at"] + F.length(m["gap"])
        high = low + F.length(m["hit"])
        return F.struct(high.cast("int").alias("at"), F.concat(acc["found"], F.array(span(m["hit"], low, high))).alias("found"))

    def move(acc: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda m: span(m["value"], m["start"] + acc["at"], m["end"] + acc["at"]))
        return F.struct((acc["at"] + block["at"]).cast("int").alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def blocks(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda first: F.aggregate(F.slice(pairs, first, F.lit(BLOCK)), empty, step))

    # A transform over one element gives the pairs a name, so that they are made once.
    once = F.transform(F.array(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))), blocks)
    found = F.flatten(F.aggregate(F.get(once, F.lit(0)), none, move, lambda acc: acc["found"]))
    return F.filter(found, lambda m: keep(m["value"])) if keep else found


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    doubled = F.transform(
        F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).cast("int")
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _as_kind(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "value")])


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Emails, IP addresses, card numbers and phone numbers of a text: (kind, start, end, value), by kind and start."""
    text = F.coalesce(text, F.lit(""))
    checks = {"email": None, "ip": _is_ip, "card": _is_card, "phone": _is_phone}
    # A text without the kind's least sign is not searched.
    signs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    parts = []
    for kind, pattern in PATTERNS.items():
        named = F.transform(_placed(text, pattern, checks[kind]), _as_kind(kind))
        parts.append(F.when(signs[kind], named).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def _merged(spans: Column) -> Column:
    """Spans by start, with those that overlap joined to one that bears the first one's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind")])))
    kind = "array<struct<start:int,end:int,kind:string>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = F.coalesce(last["end"] > s["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast(kind), add)


def _values(text: Column, entities: Column) -> Column:
    """The distinct entities of a text, lowered."""
    return F.array_distinct(F.transform(entities, lambda e: F.lower(F.substr(text, e["start"] + 1, e["end"] - e["start"]))))


def _masked(text: Column, entities: Column) -> Column:
    """The text with a space for each code point of its entities: what is left stands where it stood."""

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(entities, i - 1)["end"]).otherwise(0)
        return F.concat(F.substr(text, before + 1, e["start"] - before), F.repeat(F.lit(" "), e["end"] - e["start"]))

    tail = F.substr(text, F.element_at(entities, -1)["end"] + 1, F.length(text))
    return F.when(F.size(entities) > 0, F.concat(F.array_join(F.transform(entities, piece), ""), tail)).otherwise(text)


def _terms(text: Column) -> Column:
    """The distinct whole words of a text, lowered."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosures(seen: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(entity, term, kind) of the terms that disclose an entity too strongly.

    A term t discloses of an entity e the share PMI(t; e) / IC(e) of its information content, where IC(e) = -log p(e)
    and PMI(t; e) = log(p(t, e) / (p(t) p(e))), with probabilities over whole documents. A share of 1 means that
    the term is found only in documents with the entity. ``seen`` (content, values, terms) are the documents with
    entities; their terms are those outside the entities.

    A share of g at least means n(t) <= n(t, e) (n / n(e))**(1 - g), and n(t, e) is at most n(e) and at most the
    count of t in ``seen``. Pairs beyond that bound, or of an entity or term without support, are not formed.
    """
    texts = seen.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"), F.first("terms").alias("terms"))
    texts = scratch.save(texts, "texts")
    whole = docs.agg(F.count(F.lit(1)).alias("n"))
    entities = texts.select(F.explode("values").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    entities = entities.where(F.col("n_entity") >= SUPPORT).crossJoin(F.broadcast(whole))  # one row
    reach = F.pow(F.col("n") / F.col("n_entity"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    entities = scratch.save(entities.withColumn("reach", reach), "entities")
    far = entities.agg(F.max("reach").alias("far"), F.max(F.col("n_entity") * F.col("reach")).alias("most"))
    near = texts.select(F.explode("terms").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("n_seen"))
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = near.where(F.col("n_seen") >= SUPPORT).join(counts, "term").crossJoin(F.broadcast(far))  # one row
    terms = terms.where((F.col("n_term") <= F.col("n_seen") * F.col("far")) & (F.col("n_term") <= F.col("most")))
    terms = scratch.save(terms.select("term", "n_term", "n_seen"), "terms")
    # Each join is written alone, so that Spark can split a term or an entity with many texts.
    holds = scratch.save(texts.select("content", F.explode("terms").alias("term")).join(terms, "term"), "holds")
    names = scratch.save(texts.select("content", "copies", F.explode("values").alias("entity")).join(entities, "entity"), "names")
    fits = F.col("n_term") <= F.least("n_entity", "n_seen") * F.col("reach")
    pairs = names.join(holds, "content").where(fits)
    together = pairs.groupBy("entity", "term", "n", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"))
    together = together.where(F.col("n_both") >= SUPPORT)
    content = F.log(F.col("n") / F.col("n_entity"))
    pmi = F.log(F.col("n") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(content > 0, pmi / content)
    kind = F.when(share >= REMOVE, "removed").when(share >= GENERALISE, "generalised")
    return together.select("entity", "term", kind.alias("kind")).where("kind IS NOT NULL")


def find_spans(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: (id, content, base, method): the patterns' spans and the spans of disclosing terms.

    ``base``: (kind, start, end, value) by kind and start. ``method``: (kind, start, end) of every occurrence of a term
    that discloses an entity, wherever it stands and in documents without the entity too: ``generalised`` or
    ``removed``, by kind and start; none overlaps a base span.
    Spans count in code points, end exclusive. A null text is empty and has null ``content``; null ids and
    repeated rows keep their rows; an empty table gives no rows; only ``id_column`` and ``text`` are read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.col(id_column).alias("id"), digest(F.col("text")).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("base", base_spans(F.col("text")))
    texts = texts.withColumn("entities", F.when(F.size("base") > 0, _merged(F.col("base"))))
    masked = F.when(F.size("base") > 0, _masked(F.col("text"), F.col("entities"))).otherwise(F.col("text"))
    values = F.when(F.size("base") > 0, _values(F.col("text"), F.col("entities")))
    terms = F.when(F.size("base") > 0, _terms(masked))
    rows = scratch.save(texts.select("id", "content", "base", values.alias("values"), terms.alias("terms")), "spans")
    strong = disclosures(rows.where("size(base) > 0"), docs.select("text"), scratch)
    strong = scratch.save(strong.groupBy("term").agg(F.max("kind").alias("kind")), "strong")  # removed wins
    places = texts.select("content", masked.alias("masked")).select("content", F.explode(_placed(F.col("masked"), TERM, None)).alias("m"))
    places = places.select("content", F.lower("m.value").alias("term"), "m.start", "m.end")
    found = scratch.save(places.join(strong, "term").select("content", "kind", "start", "end"), "found")
    method = found.groupBy("content").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("method"))
    method = scratch.save(method, "method")  # so that the join stands alone and Spark can split a text with many copies
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    joined = rows.select("id", "content", "base").join(method, "content", "left")
    return joined.select("id", "content", "base", F.coalesce("method", none).alias("method")).withColumnRenamed("id", id_column)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` (documents) with all spans of :func:`find_spans` replaced by labels, or by nothing if removed.

    Texts without spans, and null texts, stay as they are; ``n_chars``, where there is one, follows a changed text.
    """
    spans = find_spans(docs).where("size(base) > 0 OR size(method) > 0").dropDuplicates(["content"])
    base = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end")]))
    spans = spans.select("content", _merged(F.concat(base, "method")).alias("spans"))
    spans = Scratch(docs.sparkSession, "sanitise").save(spans, "spans")
    text = F.col("text")
    rows = docs.select(F.struct(F.col("*")).alias("row"), digest(text).alias("content")).join(spans, "content", "left")
    text, hit = F.col("row.text"), F.col("spans").isNotNull()

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
        label = F.coalesce(*[F.when(s["kind"] == kind, F.lit(name)) for kind, name in LABELS.items()])
        return F.concat(F.substr(text, before + 1, s["start"] - before), label)

    tail = F.substr(text, F.element_at("spans", -1)["end"] + 1, F.length(text))
    cleaned = rows.withColumn("clean", F.when(hit, F.concat(F.array_join(F.transform("spans", piece), ""), tail)).otherwise(text))
    length = F.length("clean").cast(dict(docs.dtypes).get("n_chars", "long"))
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, length).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that disclose it."""
    found = find_spans(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base, method = F.transform("base", line), F.transform("method", line)
    counts = [F.size(F.filter("base", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, method), ",").alias("spans"),
    )
