"""Personal data: base patterns, then information-theoretic sanitisation (DataFrame operations only).

A term discloses a protected entity when the corpus says so: with document frequencies df over all N
documents, PMI(e; t) = ln(N df(e, t) / (df(e) df(t))) is what t tells of e, IC(e) = ln(N / df(e)) is all
there is to tell, and their ratio is the share that t gives away. It is 1 if t occurs with e alone.
Frequencies are those of whole documents, base spans blanked, and a disclosing term is marked wherever
it stands, in documents without the entity too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty

#: The base kinds in order. Each pattern is the contract's with the same leftmost matches: runs are matched
#: possessively, and only begun where they begin or right after the match before, so that no start is
#: tried twice inside one run. Cards are whole chains of digits, so their length is part of the pattern.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|\z)){4}\z"
#: A term: a whole run of letters and their marks, of any length, lower-cased for comparison.
TERM = r"[\p{L}\p{M}]++"
#: Bits per disclosing term, and bits at most, of the filter that words pass before they are shuffled; it only saves work.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Disclosure from which a term is generalised, and removed; co-occurrences that make evidence.
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 2
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}
SPAN, MARK = "struct<s:int,e:int,m:string>", "struct<s:int,e:int,action:string>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of a pattern's matches: code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so their lengths give the places.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def step(a, x):
        s = a["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")).cast(f"struct<at:int,out:array<{SPAN}>>"), step, lambda a: a["out"])).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def value(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str):
    """The test that matches of a kind must pass; those that fail are dropped without another try."""

    def test(x: Column) -> Column:
        digits = F.regexp_replace(x["m"], "[^0-9]", "")
        return {"ip": x["m"].rlike(OCTETS), "card": luhn(digits), "phone": F.length(digits).between(10, 15)}.get(kind, F.lit(True))

    return test


def _kinded(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"))


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, m>> of all base kinds, by start and then kind as listed."""
    parts = []
    for k, kind in enumerate(KINDS):
        spans = located(text, PATTERNS[kind])
        spans = F.transform(F.filter(spans, _valid(kind)), _kinded(k))
        need = NEEDS[kind]
        parts.append(F.when(text.contains(need), spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")) if need else spans)
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def blanked(text: Column, base: Column) -> Column:
    """The text with base spans as spaces, so that places stay; spans may overlap."""

    def step(a, x):
        start, end = F.greatest(a["at"], x["s"]), F.greatest(a["at"], x["e"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, start - a["at"]), F.repeat(F.lit(" "), end - start)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(base) > 0, F.aggregate(base, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))).otherwise(text)


def terms_of(text: Column) -> Column:
    """The distinct terms of a blanked text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, base, entities) of every document, kept in the shared folder.

    text is blanked; an entity is a kind and a value, letters lower.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    got = src.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    entities = F.array_distinct(F.transform("base", lambda x: F.concat(x["k"].cast("string"), F.lit(":"), F.lower(x["m"]))))
    return materialize(got.select(F.monotonically_increasing_id().alias("row"), "doc_id", blanked(F.col("text"), F.col("base")).alias("text"), "base", entities.alias("entities")), "pii-base")


def disclosing(found: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of pairs from GENERALISE on, with frequencies over all documents.

    A pair is an entity with any term of a document that mentions it. Counts are combined on the map
    side by entity and term, so an entity of any frequency is spread over its terms. Entities of fewer
    than SUPPORT documents have no pair of that support and go first.
    """
    n = found.count()
    mention = found.select("row", F.explode("entities").alias("entity"))
    of_entity = mention.groupBy("entity").agg(F.count("*").alias("df_e")).where((F.col("df_e") >= SUPPORT) & (F.col("df_e") < n))
    shared = materialize(mention.join(of_entity, "entity"), "pii-mentions")
    words = found.where(F.size("entities") > 0).select("row", terms_of(F.col("text")).alias("terms"))
    pair = shared.join(words, "row").select("entity", "df_e", F.explode("terms").alias("term"))
    pairs = materialize(pair.groupBy("entity", "df_e", "term").agg(F.count("*").alias("df_et")).where(F.col("df_et") >= SUPPORT), "pii-pairs")
    of_term = found.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    both = pairs.join(of_term, "term")  # inner, since a semi-join would go below the counts and shuffle every word
    ic = F.log(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log(F.lit(float(n)) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    return both.select("entity", "term", (pmi / ic).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _maybe(bad: DataFrame) -> Column:
    """False for terms that are surely not in bad: a hashed bitmap, a value of MOST_BITS at most."""
    bits = 1 << 10
    want = FILTER_BITS * bad.count()
    while bits < min(want, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("term"), F.lit(bits))
    filled = bad.select(at.alias("h")).groupBy(F.shiftright("h", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b"))
    dense = bad.sparkSession.range(bits // 64).join(filled, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    bitmap = dense.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bitmap"))
    word = F.get(materialize(bitmap, "pii-filter").scalar(), F.shiftright(at, 6).cast("int"))
    return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1


def marked(text: Column, bad: Column) -> Column:
    """array<struct<s, e, action>> of the terms of a blanked text that bad, term to disclosure, holds."""
    found, pieces = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    words = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), F.element_at(bad, F.lower(m)).alias("d")))

    def step(a, x):
        s = a["at"] + x["gap"]
        e = s + x["n"]
        action = F.when(x["d"] >= REMOVE, F.lit("removed")).otherwise(F.lit("generalised"))
        hit = F.array(F.struct(s.alias("s"), e.alias("e"), action.alias("action")))
        return F.struct(e.alias("at"), F.when(x["d"].isNotNull(), F.concat(a["out"], hit)).otherwise(a["out"]).alias("out"))

    none = F.from_json(F.lit("[]"), f"array<{MARK}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out")).cast(f"struct<at:int,out:array<{MARK}>>")
    return F.when(bad.isNotNull(), F.aggregate(words, start, step, lambda a: a["out"])).otherwise(none)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, terms), a row per row of docs: base spans, and spans of disclosing terms outside them.

    terms: array<struct<s, e, action>> with action generalised or removed, of every occurrence in any
    document; a term that discloses several entities goes by the largest share. Null texts count as empty
    and have no spans, rows that repeat an id are annotated each, other columns are not read, so their names
    don't matter, and an empty table gives an empty result.
    """
    found = find(docs, id_col, text_col)
    bad = materialize(disclosing(found).groupBy("term").agg(F.max("disclosure").alias("d")), "pii-terms")
    words = found.select("row", F.explode(terms_of(F.col("text"))).alias("term")).where(_maybe(bad))
    hits = words.join(bad, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("bad"))  # a document's own terms at most
    out = found.join(hits, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "base", marked(F.col("text"), F.col("bad")).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans masked and disclosing terms generalised or removed; overlaps are masked once."""
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    names = F.array(*map(F.lit, KINDS))
    all_ = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(names, x["k"] + 1).alias("what"))), F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["action"].alias("what")))))

    def step(a, x):
        fresh = x["s"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), marks[x["what"]])).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(all_, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: personal data in every whole document."""
    a = annotate(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    slim = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("k"), x["e"].alias("e")))
    return a.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(slim(F.col("base")), terms))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
