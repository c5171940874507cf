"""Information-theoretic sanitisation of personal data (operator 2), in DataFrame functions alone.

Patterns find the protected entities: addresses, numbers and their places. An entity is protected at two levels: its
exact value, and its class, which many values share (a mail domain, a network, a card issuer, a dialling area). Terms can
reveal an entity too: from counts over whole texts of the whole corpus, the share of an entity's information that a
term gives is their pointwise mutual information over the entity's information content. Terms above one threshold are
removed, those above a lower one are generalised, wherever they stand: beside a mention, far from it, and in texts that
don't name the entity.

Counts are smoothed by SMOOTH rows of the corpus's mean, so the estimated probability of an entity given a term is at
most (both + SMOOTH) / (n_term + SMOOTH); and a pair counts only if at least two different texts hold both, since what one
text has is no co-occurrence in a corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch, doc_texts, row_key

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)

# Patterns match what the plain ones of the contract match, but can't run for long or deep on long texts. A character
# that joins two parts (the dot of a domain, a card's space or dash) is first replaced by a mark of the same length, so
# that no group repeats; and a search starts only where a run of characters starts or the last match ended.
_DOT, _JOINT = "\x04", "\x01"
_LOCAL = r"A-Za-z0-9._%+\x04-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x04[A-Za-z0-9\x04-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x01]{11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"\p{L}+|\p{N}+"
SMOOTH = 0.5  # rows of the corpus's mean that are added to a term's rows
CHUNK = 128  # numbers of an array that are added up at a time
TEXT_CHUNK = 1024  # characters of a text that a replacement reads at least
FEW = 100_000  # terms, of 9 bytes each, that are sent to all executors; more are joined by a shuffle
HOT = 0.01  # share of rows beyond which a term's rows are kept out of shuffles if it can't disclose


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: what a lambda reads from outside is made anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array: what combine makes of 0 and all numbers before it; the array is as long as values and one more.

    In two levels, as an array that grows by one is copied each time: within chunks, then from chunk to chunk.
    """

    def scan(items: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))
        return F.aggregate(items, start, lambda s, x: F.struct(combine(s["at"], value(x)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def cut(longer: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(longer) - 1) / CHUNK).cast("int")), lambda k: F.slice(longer, k * CHUNK + 1, CHUNK))

    def raised(local: Column) -> Column:
        return F.flatten(F.zip_with(local, scan(local, lambda x: x["at"])["all"], lambda x, head: F.transform(x["all"], lambda v: combine(head, v))))

    return _let(F.concat(values, F.array(F.lit(0))), lambda longer: _let(F.transform(cut(longer), lambda c: scan(c, lambda x: x)), raised))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, as offsets in characters."""

    def placed(found: Column) -> Column:
        matches = found["matches"]
        gaps = F.transform(F.slice(found["pieces"], 1, F.size(matches)), lambda x: F.length(x))
        starts = _before(F.zip_with(gaps, matches, lambda gap, value: gap + F.length(value)), lambda a, b: a + b)
        starts = F.zip_with(F.slice(starts, 1, F.size(matches)), gaps, lambda a, b: a + b)
        return F.zip_with(starts, matches, lambda start, value: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))

    return _let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _mentions(text: Column, kind: str) -> Column:
    """Valid matches of one kind with their values."""
    possible = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][ -]?){11}[0-9]"), "phone": F.contains(text, F.lit("+"))}[kind]
    marked = text
    if kind == "email":
        marked = F.regexp_replace(F.translate(text, _DOT, "\x05"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    if kind == "card":
        marked = F.regexp_replace(F.translate(text, _JOINT, "\x03"), r"(?<=[0-9])[ -](?=[0-9])", _JOINT)

    def mention(p: Column) -> Column:
        # a match holds marks only where there were characters that join parts; for a card one stands for any
        value = F.translate(p["value"], _DOT + _JOINT, ". ") if kind in ("email", "card") else p["value"]
        return F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end"), value.alias("value"))

    none = F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int, value: string>>)")
    found = F.filter(F.transform(_places(marked, PATTERNS[kind]), mention), lambda m: _valid(kind, m["value"]))
    return F.when(possible, found).otherwise(none)


def _code(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def base_mentions(documents: DataFrame) -> DataFrame:
    """key, doc_id, text_hash, mentions (in order of start and kind) and codes (of its distinct words) of each row."""
    keyed = doc_texts(documents)
    found = keyed.select(
        row_key().alias("key"), "doc_id", F.xxhash64("text", F.length("text")).alias("text_hash"),
        F.array_sort(F.concat(*[_mentions(F.col("text"), kind) for kind in KINDS])).alias("mentions"),
        F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), _code)).alias("codes"),
    )
    return found


def entity_names(mention: Column) -> Column:
    """The exact value and the class of a mention: domain, first two parts of an address, first four digits of a number."""
    value = F.lower(mention["value"])
    digits = F.substring(_digits(value), 1, 4)
    kind = mention["kind"]
    wide = F.when(kind == 0, F.concat(F.lit("@"), F.substring_index(value, "@", -1))).when(kind == 1, F.concat(F.substring_index(value, ".", 2), F.lit(".*"))).otherwise(F.concat(digits, F.lit("*")))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws(":", kind, wide))


def disclosing_terms(mentions: DataFrame, scratch: Scratch, generalise: float, least_texts: int) -> DataFrame:
    """entity, code, disclosure: pairs of an entity and a term that reach a threshold and share at least least_texts different texts.

    Counts are of rows of the whole corpus: those that hold the term anywhere, those with the entity, those with both.
    Pairs are joined only where they can reach the threshold: both is n_entity at most, so n_term has a bound.
    """
    names = F.array_distinct(F.flatten(F.transform("mentions", entity_names)))
    texts = mentions.where(F.size("mentions") > 0).groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("mentions").alias("mentions"), F.first("codes").alias("codes"))
    texts = scratch.keep(texts, "texts")
    named = texts.select("text_hash", "copies", F.explode(names).alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("own")).where(F.col("own") >= least_texts)
    entities = scratch.keep(entities.select(F.col("entity").alias("of"), "n_entity"), "entities")
    n, most = mentions.count(), entities.agg(F.max("n_entity")).first()[0] or 1
    bound = lambda n_entity: n * (n_entity + SMOOTH) / n_entity * ((n_entity / (n + 1)) ** generalise) * (1 + 1e-9)
    counts = mentions.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= least_texts)
    counts = scratch.keep(counts, "counts")
    # at most 1 / HOT times the mean number of a row's words
    hot = F.broadcast(counts.where(F.col("n_term") > max(bound(most), HOT * n)).select("code"))
    named = named.join(entities, F.col("entity") == F.col("of")).select(F.col("text_hash").alias("named_hash"), "copies", "entity", "n_entity")
    words = texts.join(named.select("named_hash"), F.col("text_hash") == F.col("named_hash"), "left_semi").select("text_hash", F.explode("codes").alias("code"))
    words = words.join(hot, "code", "left_anti").join(counts.where(F.col("n_term") <= bound(most)), "code")
    pairs = words.join(named, (F.col("text_hash") == F.col("named_hash")) & (F.col("n_term") <= bound(F.col("n_entity"))))
    pairs = pairs.groupBy("entity", "code", "n_entity", "n_term").agg(F.sum("copies").cast("double").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= least_texts)
    mean = F.col("n_entity").cast("double") / n
    mutual = F.log((F.col("both") + SMOOTH * mean) / (F.col("n_term") + SMOOTH) / mean)
    content = F.log((n + 1.0) / F.col("n_entity"))
    return pairs.select("entity", "code", (mutual / content).alias("disclosure")).where(F.col("disclosure") >= generalise)


def _term_places(text: Column, flags: Column) -> Column:
    """array<struct<start, kind, end, removed>> of all words whose codes are keys of flags."""
    found = F.transform(_places(text, _WORD), lambda w: F.struct(w["start"].alias("start"), F.lit(TERM).alias("kind"), w["end"].alias("end"), F.try_element_at(flags, _code(w["value"])).alias("removed")))
    return F.filter(found, lambda w: w["removed"].isNotNull())


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """The characters of a text from start to end, from its chunks of TEXT_CHUNK characters: only those in reach are read."""
    first, last = F.floor(start / TEXT_CHUNK).cast("int"), F.floor(end / TEXT_CHUNK).cast("int")
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    within = F.substring(chunk(first), start % TEXT_CHUNK + 1, end - start)
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(chunk(first), start % TEXT_CHUNK + 1, F.lit(TEXT_CHUNK)), middle, F.substring(chunk(last), F.lit(1), end % TEXT_CHUNK))
    return F.when(first == last, within).otherwise(across)


def sanitised_spans(spark: SparkSession, documents: DataFrame, remove: float = 0.9, generalise: float = 0.75, least_texts: int = 2) -> DataFrame:
    """key, doc_id, mentions and terms of each row; terms is array<struct<start, kind, end, removed>>, null if there are none.

    A null text counts as empty. Repeated rows share their key and their spans. Words inside a mention go with it.
    """
    scratch = Scratch(spark)
    found = scratch.keep(base_mentions(documents), "found")
    disclosing = disclosing_terms(found, scratch, generalise, least_texts)
    disclosing = scratch.keep(disclosing.groupBy("code").agg((F.max("disclosure") >= remove).alias("removed")), "disclosing")
    scratch.drop("texts", "entities", "counts")
    told = F.broadcast(disclosing) if disclosing.count() <= FEW else disclosing
    hits = found.select("key", F.explode("codes").alias("code")).join(told, "code")
    hits = scratch.keep(hits.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("code", "removed"))).alias("flags")).withColumnRenamed("key", "hit_key"), "hits")
    # codes take more room than all else, and hits are the last to read them: they go before texts are shuffled
    mentions = scratch.keep(found.select("key", "doc_id", "mentions"), "mentions")
    scratch.drop("found", "disclosing")
    # hits grow with the table: they are dealt out like the texts at any size
    terms = doc_texts(documents).withColumn("key", row_key()).join(hits.hint("merge"), F.col("key") == F.col("hit_key")).select(F.col("key").alias("terms_key"), _term_places(F.col("text"), F.col("flags")).alias("terms"))
    terms = scratch.keep(terms.dropDuplicates(["terms_key"]), "terms")
    scratch.drop("hits")
    outside = F.filter("terms", lambda t: ~F.exists("mentions", lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"])))
    return mentions.join(terms, F.col("key") == F.col("terms_key"), "left").select("key", "doc_id", "mentions", outside.alias("terms"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def digest_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans for each row.

    A null text counts as empty, texts of any length are read whole, repeated rows get equal results. An empty table gives
    no rows; columns other than doc_id and text are left out. Without a term that reaches a threshold, spans are the base ones.
    """
    found = sanitised_spans(spark, documents)
    base = _plain(F.col("mentions"))
    count = lambda kind: F.size(F.filter("mentions", lambda m: m["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    everything = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, _plain(F.col("terms")))))
    return found.select("doc_id", *map(count, KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(everything).alias("spans"))


def sanitise(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents with every span replaced: an entity by its kind in brackets, a generalised term by [TERM], a removed one by nothing.

    Spans that overlap are replaced together, by what the first of them calls for. n_chars, if there, is counted anew.
    Null texts stay null, every row stays; other columns, whatever their names, go through unchanged.
    """
    found = sanitised_spans(spark, documents).where((F.size("mentions") > 0) | F.col("terms").isNotNull())
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.get(labels, m["kind"]).alias("put")))
    terms = F.transform(F.coalesce("terms", F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int, removed: boolean>>)")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    # struct order puts the earliest first, and of those the shortest
    spans = found.select(F.col("key").alias("spans_key"), F.array_sort(F.concat(base, terms)).alias("put_spans")).dropDuplicates(["spans_key"])
    text = F.col("row.text")
    keyed = documents.select(F.struct("*").alias("row")).withColumn("key", F.xxhash64(F.col("row.doc_id").cast("long"), F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))))
    joined = keyed.join(spans, F.col("key") == F.col("spans_key"), "left")

    # what a span replaces starts where all spans before it end; spans within that are replaced with it
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))
    ended = _before(F.transform("put_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def cleaned(known: Column) -> Column:
        told = F.zip_with("put_spans", F.slice(known["ended"], 1, F.size("put_spans")), lambda s, at: F.struct(s["start"].alias("start"), s["put"].alias("put"), at.alias("at")))
        leads = F.filter(told, lambda s: s["start"] >= s["at"])
        pieces = F.transform(leads, lambda s: F.concat(_part(known["chunks"], s["at"], s["start"]), s["put"]))
        return F.concat(F.array_join(pieces, ""), _part(known["chunks"], F.element_at(known["ended"], -1), known["size"]))

    clean = _let(F.struct(chunks.alias("chunks"), ended.alias("ended"), F.length(text).alias("size")), cleaned)
    out = joined.withColumn("new_text", F.when(F.col("put_spans").isNull(), text).otherwise(clean))
    columns = []
    for field in documents.schema:
        if field.name == "text":
            columns.append(F.col("new_text").alias("text"))
        elif field.name == "n_chars":
            columns.append(F.length("new_text").cast(field.dataType).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(field.name).alias(field.name))
    return out.select(*columns)
