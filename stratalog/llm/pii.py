"""Personal data: patterns, and terms that disclose what the patterns protect.

Base entities are found by patterns (e-mail addresses, IP addresses, card and
phone numbers). Then the information-theoretic step: terms in a text with an
entity may reveal it even when it is masked. An entity counts as its exact value
and as groups that recur: its kind, an e-mail's domain and local part, an IP
address's first three numbers, a card's or phone's first digits. Over the whole
corpus we count in how many documents an entity stands, a term stands, and both
stand anywhere; the pointwise mutual information of term and entity, as a share
of the entity's own information, tells how much of the entity the term discloses.
Terms above the first threshold are generalised, above the second removed,
wherever they stand in the texts with that entity.

Everything is a DataFrame expression. Only texts with an entity are shuffled;
pairs of term and entity exist only in these, for entities in enough distinct
texts. A pair needs several distinct texts, so copies of one text don't make one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, let, materialize, maybe_broadcast, packed, unpacked

# The kinds in their order, and their patterns. The quantifiers
# are possessive and a match may only begin where a run begins or the last
# match ended, which finds the same matches without going back over long runs.
# A card needs 14 digits at least: shorter runs would be dropped, and the rest of
# a run that is too short is shorter still.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a text must hold before its pattern is tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Digits of a card or phone number that make a group; texts that must hold a pair; shares of the entity's information.
PREFIX, SUPPORT, GENERALISE, REMOVE = 6, 3, 0.85, 0.95
SPAN = "struct<start:int,rank:int,end:int,value:string>"


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Array of SPAN: all matches with code-point offsets.

    ``split`` gives what lies between the matches; offsets are running sums of
    both.
    """

    def located(s: Column) -> Column:
        step = lambda a, m: let(
            a["at"] + F.length(F.get(s["gaps"], F.size(a["spans"]))),
            lambda b: F.struct(
                (b + F.length(m)).alias("at"),
                F.array_append(a["spans"], F.struct(b.alias("start"), F.lit(rank).alias("rank"), (b + F.length(m)).alias("end"), m.alias("value"))).alias("spans"),
            ),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(s["found"], zero, step, lambda a: a["spans"])

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(parts, located)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of SPAN over all base kinds, by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")

    def found(rank: int, kind: str) -> Column:
        return F.when(text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind], rank), lambda s: valid(kind, s["value"]))).otherwise(none)

    return F.array_sort(F.concat(*[found(rank, kind) for rank, kind in enumerate(PATTERNS)]))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def groups(s: Column) -> Column:
    """Array of strings: what a base span's entity is counted as, from its kind to its exact value."""
    value = F.lower(s["value"])
    part = lambda name, x: F.concat_ws(":", s["rank"].cast("string"), F.lit(name), x)
    kind = lambda k: s["rank"] == list(PATTERNS).index(k)
    parts = (
        F.when(kind("email"), F.array(part("local", F.substring_index(value, "@", 1)), part("domain", F.substring_index(value, "@", -1))))
        .when(kind("ip"), F.array(part("net", F.substring_index(value, ".", 3))))
        .otherwise(F.array(part("prefix", F.substr(F.regexp_replace(value, "[^0-9]+", ""), F.lit(1), F.lit(PREFIX)))))
    )
    return F.concat(F.array(part("kind", F.lit("")), part("value", value)), parts)


def replaced(text: Column, spans: Column, replacement) -> Column:
    """The text with ``replacement(span)`` for each span; where spans overlap, the first one's stands for the union."""

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        piece = F.when(s["start"] >= a["at"], F.concat(gap, replacement(s))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["parts"], piece).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def term_spans(text: Column, base: Column, hits: Column) -> Column:
    """Array of SPAN: every place of the words in the map ``hits`` (word to span value), outside the base spans."""

    def located(s: Column) -> Column:
        def step(a: Column, m: Column) -> Column:
            def moved(b: Column) -> Column:
                end, value = b + F.length(m), F.try_element_at(hits, F.lower(m))
                covered = F.exists(base, lambda x: (x["start"] < end) & (b < x["end"]))
                span = F.struct(b.alias("start"), F.lit(len(KINDS) - 1).alias("rank"), end.alias("end"), value.alias("value"))
                more = F.when(value.isNull(), a["spans"]).when(covered, a["spans"]).otherwise(F.array_append(a["spans"], span))
                return F.struct((a["i"] + 1).alias("i"), end.alias("at"), more.alias("spans"))

            return let(a["at"] + F.length(F.get(s["gaps"], a["i"])), moved)

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
        return F.aggregate(s["found"], zero, step, lambda a: a["spans"])

    parts = F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("found"), F.split(text, WORD, -1).alias("gaps"))
    return let(parts, located)


def disclosing(rows: DataFrame, documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share): terms of texts with an entity that disclose at least ``generalise`` of it.

    ``rows`` has (text_key, copies, entities, terms), one row a distinct text
    with an entity; ``documents`` has (text), all of them. Frequencies count
    documents of the whole corpus, support counts distinct texts. An entity in
    fewer texts than ``support`` has no pair that passes and makes none.
    """
    each = rows.select("text_key", "copies", F.explode("entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    entities = maybe_broadcast(materialize(entities.select("entity", "with_entity")))
    held = each.join(entities, "entity").groupBy("text_key").agg(F.collect_list("entity").alias("held"))
    # words before entities: a row is a text's word, then one for each entity that recurs
    near = rows.select("text_key", "copies", "terms").join(held, "text_key").select("copies", "held", F.explode("terms").alias("term")).select("copies", "term", F.explode("held").alias("entity"))
    pairs = near.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    terms = documents.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    total = documents.agg(F.count("*").alias("total"))
    information = F.log(F.col("total") / F.col("with_entity"))
    mutual = F.log(F.col("both") * F.col("total") / (F.col("with_entity") * F.col("with_term")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    return (
        pairs.join(entities, "entity").join(terms, "term").join(F.broadcast(total)).select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    )


def personal_data(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all by default) and the struct ``pii``.

    ``pii`` holds base (array of start, rank, end, value: the base spans),
    added (the same for disclosing terms; value is "generalise" or "remove")
    and spans (both, by start, then kind). Offsets are code points.

    A null text counts as empty and has no spans. Rows with the same key and
    text get the same spans. An empty table gives an empty result. A column
    named ``pii`` is replaced.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c != "pii"]
    whole = F.coalesce(column(text), F.lit(""))
    based = documents.select(packed(keep), whole.alias("_text"), base_spans(whole).alias("_base"))
    # only texts with an entity can have disclosing terms: no other text is kept here
    held = lambda x: F.when(F.size("_base") > 0, x)
    rows = materialize(based.select("row", "_base", held(F.md5("_text")).alias("_key"), held(F.col("_text")).alias("_text")))
    found = rows.where(F.size("_base") > 0).groupBy(F.col("_key").alias("text_key")).agg(F.count("*").alias("copies"), F.first(F.struct("_base", "_text")).alias("f"))
    entities = F.array_distinct(F.flatten(F.transform("f._base", groups)))
    terms = words(replaced(F.col("f._text"), F.col("f._base"), lambda s: F.lit(" ")))
    found = materialize(found.select("text_key", "copies", entities.alias("entities"), terms.alias("terms")))
    hits = maybe_broadcast(materialize(disclosing(found, documents.select(column(text).alias("text")), support, generalise)))
    added = (
        found.select("text_key", "entities", F.explode("terms").alias("term"))
        .join(hits, "term")
        .where(F.array_contains("entities", F.col("entity")))
        .groupBy("text_key", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", F.when(F.col("share") >= remove, "remove").otherwise("generalise")))).alias("_hits"))
    )
    added = materialize(added.select(F.col("text_key").alias("_added_key"), "_hits"))
    nothing = F.array().cast(f"array<{SPAN}>")
    pii = lambda more: F.struct(F.col("_base").alias("base"), more.alias("added"), F.array_sort(F.concat("_base", more)).alias("spans")).alias("pii")
    plain = rows.where(F.size("_base") == 0).select(*unpacked(keep), pii(nothing))
    # two written tables: the engine splits the many copies of one text
    with_base = rows.where(F.size("_base") > 0).join(added, F.col("_key") == F.col("_added_key"), "left")
    with_terms = with_base.select("row", "_base", F.when(F.col("_hits").isNull(), nothing).otherwise(term_spans(F.col("_text"), F.col("_base"), F.col("_hits"))).alias("_added"))
    return plain.unionByName(with_terms.select(*unpacked(keep), pii(F.col("_added"))))


def sanitised(text: Column, pii: Column) -> Column:
    """The text with base entities as [KIND], generalised terms as [TERM] and removed terms left out.

    Where spans overlap, the first one's replacement stands for the union.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    replacement = lambda s: F.when(s["value"] == F.lit("remove"), F.when(s["rank"] == len(KINDS) - 1, F.lit("")).otherwise(F.element_at(names, s["rank"] + 1))).otherwise(F.element_at(names, s["rank"] + 1))
    return F.when(F.size(pii["spans"]) == 0, text).otherwise(replaced(text, pii["spans"], replacement))
