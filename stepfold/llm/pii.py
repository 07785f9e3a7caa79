"""Personal data: fixed patterns, and terms that reveal who is meant by them, in DataFrame operations alone.

Base patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers. Their values are the
protected entities. The corpus tells how strongly a term reveals one: with P(e) the share of texts that hold the
entity and P(e | t) that of the texts with the term which hold both, wherever they stand, the disclosure of e by t is
1 + log P(e | t) / -log P(e): 1 if the term tells the entity for certain, 0 if it tells nothing. A term that at least
SUPPORT distinct texts hold along with the entity and that reaches DISCLOSURE is generalised wherever it stands; so
are the base spans.

Co-occurrence, the counts of terms and their total take every text; equal texts count once. Texts are told by 128 bits
of hashes, and so are sets of texts. Terms are counted over the corpus before they are joined with anything. Null text is empty and has no spans.
Repeated rows are rows of their own: rows in as rows out. With no base span anywhere there are no terms. Overlapping
spans of several kinds all stay in the report; in the sanitised text the first, then the longest, then the kind listed
first counts. Texts of any length are scanned whole. Columns are carried under other names, so theirs may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, columns, settled
from stepfold.llm.spans import SPANS, hits, in_blocks, located, once, only_if, text_of

#: Fixed patterns of the base scan, as Java regular expressions that never backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,}"
SUPPORT, DISCLOSURE = 3, 0.95
BROADCAST_ROWS, BUCKETS, BLOCK = 50_000, 256, 4096
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _card(value: Column, _: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def _phone(value: Column, _: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _hashes() -> tuple[Column, Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u")


def with_spans(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns, text, t and u (hashes of the text) and the base spans by kind: email, ip, card, phone."""
    text, digits = F.col("text"), F.col("text").rlike("[0-9]")
    rows = docs.select(*carried, *_hashes(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    patterns = {"email": (EMAIL, text.contains("@"), None), "ip": (IP, digits & text.contains("."), lambda x, _: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")), "card": (CARD, digits, _card), "phone": (PHONE, text.contains("+"), _phone)}
    for kind, (pattern, when, _) in patterns.items():
        rows = settled(rows, f"_{kind}", only_if(when, hits(text, pattern)))
    for kind, (pattern, _, keep) in patterns.items():
        rows = settled(rows, kind, located(text, pattern, F.col(f"_{kind}"), keep=keep))
    return rows.drop(*(f"_{k}" for k in patterns))


def _flat(rows_of: tuple[str, ...] = KINDS[:4]) -> Column:
    def typed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return F.concat(*map(typed, rows_of))


def mentions(rows: DataFrame) -> DataFrame:
    """t, u, entities, terms of each distinct text with entities: these as hashes, and all terms outside the base spans."""
    some = settled(rows, "all", _flat()).where(F.size("all") > 0)
    # overlay counts characters from the start, so a long text is blanked block by block
    some = settled(some, "blocks", hits(F.col("text"), f"(?s).{{1,{BLOCK}}}"))

    def blank(block: Column, i: Column) -> Column:
        first, end = i * BLOCK, (i + 1) * BLOCK

        def step(out: Column, x: Column) -> Column:
            start, n = F.greatest(x["start"] - first, F.lit(0)), F.least(x["end"], end) - F.greatest(x["start"], first)
            return F.overlay(out, F.repeat(F.lit(" "), n), start + 1, n)

        return F.aggregate(F.filter("all", lambda x: (x["start"] < end) & (x["end"] > first)), block, step)

    some = settled(some, "masked", F.array_join(F.transform("blocks", blank), ""))
    entities = F.array_distinct(F.transform("all", lambda x: F.xxhash64(x["kind"], F.lower(x["value"]))))
    return some.select("t", "u", entities.alias("entities"), F.array_distinct(hits(F.lower("masked"), TERM)).alias("terms")).dropDuplicates(["t", "u"])


def _each_term() -> Column:
    return F.explode(F.array_distinct(hits(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), TERM))).alias("term")


def _held(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """t, u, term of the documents that hold any of these terms."""
    words = docs.select(*_hashes(), _each_term())
    return words.join(F.broadcast(terms) if small else terms, "term")


def repeated_texts(docs: DataFrame) -> DataFrame:
    """t, u, m of each text that m > 1 rows hold."""
    return docs.select(*_hashes()).groupBy("t", "u").agg(F.count("*").alias("m")).where("m > 1")


def term_counts(docs: DataFrame, again: DataFrame) -> DataFrame:
    """term, n_term: the distinct texts that hold each term. Only texts that repeat (`again`: t, u) keep their hashes beside a term, so others add up before the shuffle."""
    marks = again.select("t", "u", F.col("t").alias("v"), F.col("u").alias("w"))
    words = docs.select("text", *_hashes()).join(marks, ["t", "u"], "left").select("v", "w", _each_term())
    each = words.groupBy("term", "v", "w").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(1)).alias("n_term"))


def _same_texts() -> tuple[Column, Column]:
    """128 bits of the set of texts of a group whose rows are distinct texts."""
    return F.bit_xor(F.xxhash64("t", "u")).alias("x"), F.bit_xor(F.xxhash64(F.lit("texts"), "t", "u")).alias("y")


def _needed(n_e: Column, total: int) -> Column:
    """The share of a term's texts that must hold an entity of n_e texts if the term is to reveal it."""
    return F.pow(F.least(n_e / F.lit(float(max(total, 2))), F.lit(0.5)), F.lit(1 - DISCLOSURE)) * (1 - 1e-9)


def revealing(spark: SparkSession, docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """term, disclosure of each term that reveals an entity.

    Entities of the same set of texts are one class, and so are terms of the same set and count, so that what some
    texts repeat meets once, however much it is. A term of n texts reveals an entity of n_e only if n * share <= n_e,
    and only if that share of its texts holds any entity at all; what fails this by its counts isn't paired.
    """
    held = scratch.write(mentions(rows), "mentions")
    again = scratch.write(repeated_texts(docs), "repeated")
    rows_again, texts_again = again.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    total = docs.count() - rows_again + texts_again
    counts = term_counts(docs, F.broadcast(again) if texts_again <= BROADCAST_ROWS else again)

    def by_text(each: DataFrame, key: str, classes: DataFrame, name: str) -> DataFrame:
        small = classes.count() <= BROADCAST_ROWS
        found = each.join(F.broadcast(classes) if small else classes, key)
        return found.groupBy("t", "u").agg(F.collect_set(F.struct(*(c for c in classes.columns if c != key))).alias(name))

    # an entity in fewer texts than SUPPORT has no term in as many
    each_e = held.select("t", "u", F.explode("entities").alias("e"))
    entities = each_e.groupBy("e").agg(F.count("*").alias("n_e"), *_same_texts()).where(F.col("n_e") >= SUPPORT)
    entities = scratch.write(entities.withColumn("most", F.col("n_e") / _needed(F.col("n_e"), total)), "entities")
    most = entities.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    least = F.lit(float(SUPPORT))
    each_t = held.select("t", "u", F.explode("terms").alias("term"))
    near = each_t.groupBy("term").agg(F.count("*").alias("n_held"), *_same_texts()).where(F.col("n_held") >= SUPPORT)
    terms = near.join(counts, "term").where((F.col("n_term") <= most) & (F.col("n_held") >= F.col("n_term") * _needed(least, total)))
    terms = scratch.write(terms.drop("n_held"), "near")
    pairs = by_text(each_e, "e", entities, "es").join(by_text(each_t, "term", terms, "ts"), ["t", "u"])
    pairs = pairs.select("es", F.explode("ts").alias("k")).select("k", F.explode(F.filter("es", lambda e: F.col("k.n_term") <= e["most"])).alias("e"))
    pairs = pairs.groupBy("k", "e").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    share = F.col("e.n_e") / F.lit(float(max(total, 2)))
    # a term beside an entity counts at least there
    disclosure = 1 + F.log(F.col("both") / F.greatest("k.n_term", "both")) / -F.log(F.least(share, F.lit(0.5)))
    told = pairs.select("k.*", disclosure.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE).groupBy("x", "y", "n_term").agg(F.max("disclosure").alias("disclosure"))
    told = scratch.write(told, "classes")
    out = terms.join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, ["x", "y", "n_term"])
    out = scratch.write(out.select("term", "disclosure"), "terms")
    scratch.drop(held, again, entities, terms, told)
    return out


def find(spark: SparkSession, docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns, text, t and the spans by kind (email, ip, card, phone, term) of each row."""
    scratch = Scratch(spark, "pii")
    rows = with_spans(docs, carried)
    terms = revealing(spark, docs, rows, scratch)
    held = _held(docs, terms.select("term"), terms.count() <= BROADCAST_ROWS).select("t", "u", "term", _bucket(F.col("term")).alias("b"))
    held = held.groupBy("t", "u", "b").agg(F.collect_set("term").alias("of")).groupBy("t", "u").agg(F.map_from_entries(F.collect_list(F.struct("b", "of"))).alias("terms"))
    held = scratch.write(held, "held")
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    told = rows.join(held, ["t", "u"], "left")
    text = F.col("text")
    told = settled(told, "_term", only_if(F.col("terms").isNotNull(), hits(text, TERM)))
    told = settled(told, "_terms", located(text, TERM, F.col("_term"), keep=lambda x, _: F.coalesce(F.array_contains(F.col("terms")[_bucket(F.lower(x))], F.lower(x)), F.lit(False))))
    told = settled(told, "_all", _apart_from(_flat()))
    return told.withColumnRenamed("_all", "term").drop("terms", "_term", "_terms")


def _bucket(term: Column) -> Column:
    """A text's revealing terms lie in buckets, so that a word is compared with few of them."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _apart_from(base: Column) -> Column:
    """The spans in _terms that overlap none in `base`, by one fold over both in the order of their starts."""
    def marked(spans: Column | str, own: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["value"].alias("value")))

    one = "struct<start:int,end:int,value:string,part:string>"
    nothing = F.lit(None).cast(one)

    def state(reach: Column, last: Column, out: Column) -> Column:
        return F.struct(reach.alias("reach"), last.alias("last"), out.alias("out"))

    def gathered(acc: Column) -> Column:
        return F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))

    # terms don't overlap, so a base span that starts within one starts within the last
    def step(acc: Column, x: Column) -> Column:
        term = F.struct(x["start"], x["end"], x["value"], F.lit(None).cast("string").alias("part")).cast(one)
        own = state(acc["reach"], F.when(x["start"] >= acc["reach"], term).otherwise(nothing), gathered(acc))
        return F.when(x["own"], own).otherwise(state(F.greatest(acc["reach"], x["end"]), F.when(acc["last"]["end"] > x["start"], nothing).otherwise(acc["last"]), acc["out"]))

    def block(acc: Column, some: Column) -> Column:
        return once(F.aggregate(some, state(acc["reach"], acc["last"], F.array().cast(SPANS)), step), lambda x: state(x["reach"], x["last"], F.concat(acc["out"], x["out"])))

    both = F.array_sort(F.concat(marked(base, False), marked("_terms", True)))
    zero = state(F.lit(0), nothing, F.array().cast(SPANS))
    found = once(both, lambda z: F.aggregate(in_blocks(z), zero, block, gathered))
    return F.when(F.size("_terms") > 0, found).otherwise(F.array().cast(SPANS))


def _joined(kinds: tuple[str, ...]) -> Column:
    def typed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: text_of(kind, x["start"], x["end"]))

    return F.array_join(F.concat(*map(typed, kinds)), ",")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans and n_term of each row."""
    rows = find(spark, docs, ["doc_id"])
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(KINDS[:4]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


def sanitised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with each span in text generalised to its kind in angle brackets; of overlapping spans the first, then the longest, counts. Other columns stay, null text too."""
    names = docs.columns
    carried = [f"_{i}" for i in range(len(names))]
    found = find(spark, docs.select(*(c.alias(x) for c, x in zip(columns(docs), carried, strict=True)), "text"), carried)
    spans = F.array_sort(_flat(KINDS), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, x: Column) -> Column:
        between = F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        cut = F.struct(x["end"].alias("at"), F.concat(acc["out"], between, F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"))
        return F.when(x["start"] >= acc["at"], cut).otherwise(acc)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("all", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = settled(found, "all", spans).withColumn("clean", F.when(F.size("all") > 0, clean).otherwise(F.col(f"_{names.index('text')}").cast("string")))
    return out.select(*(F.col("clean" if c == "text" else x).alias(c) for c, x in zip(names, carried, strict=True)))
