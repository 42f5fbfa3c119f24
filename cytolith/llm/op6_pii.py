"""Personal data: base spans by pattern, then information-theoretic sanitisation of the documents that hold them.

Entities are the values of the base spans (kind and value). Over the whole corpus of N documents, how strongly a term
reveals an entity is their pointwise mutual information as a share of the entity's information content:

    disclosure(t, e) = log(p(e | t) / p(e)) / -log p(e) = 1 + log p(e | t) / -log p(e)

p(e) is the share of documents with the entity; p(e | t) that among the documents with the term, to which one is added
that is like the corpus: (n(t, e) + p(e)) / (n(t) + 1). Terms are the words (runs of letters, lower-cased) of a document,
but for those in its base spans; counts are of documents, n(t) of all of them. 1 means that the term alone gives the entity
away, 0 that it says nothing. In every document with an entity, a term whose disclosure of any of its entities is
GENERALISE or more is generalised to its word class, at REMOVE or more it is removed. Base spans are always replaced by
their kind. So rare names beside an entity are generalised, also where both stand in one document only, and terms that
come with it in several documents and hardly without it are removed.

Of an entity that is in one document n(t, e) is 1, and the disclosure follows from n(t). Entities that stand in the same
documents are one class, and a class of several documents is only met with terms that are rare enough to disclose it at
all, n(t) + 1 <= (n(e) + p(e)) p(e)^(GENERALISE - 1): others aren't listed.

DataFrame functions only. The text is read twice (spans; document frequencies of terms). Documents with an entity are
written, their base spans blanked; for the rest only terms, spans and counts are shuffled, every count is summed before
its shuffle, and prevalent terms and entities are dealt over several tasks.

Defined results: null text has no spans, as has an empty one. Repeated rows are separate documents. Extra columns are
ignored; an empty table gives an empty result. An entity in every document has no information, and nothing discloses it.
A very long text is read whole, in time that grows as n log n with its spans and terms; a document of very many entities
that each recur elsewhere is met with its rare terms once for each class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, merged, replaced, spans_of, spread_join

GENERALISE = 0.75
REMOVE = 0.95
TERM = r"\p{L}+"
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "A-Za-z0-9-"
#: The contract's patterns, in forms that Java matches without recursion or repeated backtracking over long runs: a
#: repeated group becomes one character at a time with a look at its neighbour, and a run is entered at its start only.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}](?:(?!\.(?![{_LABEL}]))[{_LABEL}.])*+"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPAN = "struct<start:int,end:int,kind:int,text:string>"
HIT = "struct<kind:int,start:int,end:int,name:string>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether all parts are at most 255."""
    bare = F.transform(F.split(text, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """Spans of all base kinds (SPAN), by kind, then start."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: int, may: Column, regex: str, check) -> Column:
        found = F.filter(spans_of(text, regex), lambda s: check(s["text"]))
        return F.when(may, F.transform(found, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), s["text"]))).otherwise(none)

    return F.concat(
        of(0, F.contains(text, F.lit("@")) & F.regexp_like(text, F.lit(EMAIL)), EMAIL, lambda m: F.lit(True)),
        of(1, F.regexp_like(text, F.lit(IP)), IP, _octets),
        of(2, F.regexp_like(text, F.lit(CARD)), CARD, lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m))),
        of(3, F.contains(text, F.lit("+")) & F.regexp_like(text, F.lit(PHONE)), PHONE, lambda m: F.length(_digits(m)).between(8, 15)),
    )


def entity_rows(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, mark (hash of the text), spans (SPAN, values in lower case), outside (the text with its base spans blanked; null if it has none), written."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    blank = replaced(F.col("text"), merged(F.array_sort(F.col("base"))), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    spans = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], F.lower(s["text"]).alias("value")))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), spans.alias("spans"), F.when(F.size("base") > 0, blank).alias("outside")), "pii")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n_docs over all documents."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    # outer: else a filter on the array's size is inferred, and the array is computed twice
    return docs.select(F.explode_outer(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_docs")).filter(F.col("term").isNotNull())


def term_places(rows: DataFrame) -> DataFrame:
    """row, term, start, end, capital of the terms outside of base spans, in the documents with an entity."""
    held = rows.filter(F.col("outside").isNotNull()).select("row", F.explode_outer(spans_of(F.col("outside"), TERM)).alias("t")).filter(F.col("t").isNotNull())
    return held.select("row", F.lower("t.text").alias("term"), "t.start", "t.end", F.regexp_like("t.text", F.lit(r"^\p{Lu}")).alias("capital"))


def _share(n_entity: Column, total: int) -> Column:
    return n_entity / F.lit(float(max(total, 1)))


def disclosure(n_both: Column, n_term: Column, n_entity: Column, total: int) -> Column:
    share = _share(n_entity, total)
    return F.when(share >= 1, 0.0).otherwise(1 + F.log((n_both + share) / (n_term + 1)) / -F.log(share))


def most_term_docs(n_entity: Column, total: int, generalise: float) -> Column:
    """In how many documents a term may stand to disclose an entity of so many."""
    share = _share(n_entity, total)
    return F.when(share >= 1, 0.0).otherwise((n_entity + share) * F.pow(share, F.lit(generalise - 1)) - 1)


def disclosures(rows: DataFrame, docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """row, term, disclosure (the largest, of the row's entities) where it is generalise or more; from counts over all of docs."""
    total = rows.count()
    held = rows.select("row", F.explode("spans").alias("s")).select("row", F.concat_ws(":", "s.kind", "s.value").alias("entity")).distinct()
    held = materialise(held, "entities")
    # entities of the same documents have the same hashes of them
    documents = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("row")).alias("h1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("h2"))
    classes = spread_join(held, documents, "entity").select("row", "n_entity", F.concat_ws(":", "n_entity", "h1", "h2").alias("class")).distinct()
    classes = materialise(classes, "classes")
    most = classes.agg(F.max(most_term_docs(F.col("n_entity"), total, generalise))).first()[0] or 0.0
    posts = materialise(term_places(rows).select("row", "term").distinct(), "posts")
    rare = spread_join(posts, document_frequencies(docs).filter(F.col("n_docs") <= most), "term")
    rarest = classes.groupBy("row").agg(F.min("n_entity").alias("n_entity"))
    # with its rarest entity a term shares one document at least
    alone = disclosure(F.lit(1), F.col("n_docs"), F.col("n_entity"), total)
    rare = materialise(rare.join(rarest, "row").select("row", "term", "n_docs", alone.alias("alone")), "rare")
    several = classes.filter("n_entity > 1")
    pairs = rare.select("row", "term", "n_docs").join(several, "row").filter(F.col("n_docs") <= most_term_docs(F.col("n_entity"), total, generalise))
    pairs = materialise(pairs.select("row", F.concat_ws(":", "class", "term").alias("pair"), "term", "n_docs", "n_entity"), "pairs")
    both = pairs.groupBy("pair", "n_docs", "n_entity").agg(F.count("*").alias("n_both")).select("pair", disclosure(F.col("n_both"), F.col("n_docs"), F.col("n_entity"), total).alias("disclosure"))
    together = spread_join(pairs.select("row", "term", "pair"), both.filter(F.col("disclosure") >= generalise), "pair").select("row", "term", "disclosure")
    return rare.filter(F.col("alone") >= generalise).select("row", "term", F.col("alone").alias("disclosure")).union(together).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def hits(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, mark, base and terms (HIT; kind 4: generalise, 5: remove) of each row of docs."""
    rows = entity_rows(docs)
    telling = disclosures(rows, docs, generalise)
    hit = F.struct(F.when(F.col("disclosure") >= remove, 5).otherwise(4).alias("kind"), "start", "end", F.when(F.col("capital"), "name").otherwise("term").alias("name"))
    found = term_places(rows).join(telling, ["row", "term"]).groupBy("row").agg(F.collect_list(hit).alias("terms"))
    names = F.array(*map(F.lit, KINDS))
    return rows.drop("outside").join(found, "row", "left").select(
        "doc_id", "mark",
        F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"], names[s["kind"]].alias("name"))).alias("base"),
        F.array_sort(F.coalesce("terms", F.array().cast(f"array<{HIT}>"))).alias("terms"),
    )


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, of each row of docs."""
    base = F.array_sort(F.col("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    # terms, generalised or removed, are one kind in the list
    terms = F.array_sort(F.transform("terms", lambda s: F.struct(F.lit(4).alias("kind"), s["start"], s["end"], F.lit("term").alias("name"))))
    return hits(docs).select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, terms)).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans replaced by [kind], terms that are to be generalised by [name] or [term], others removed.

    Of overlapping spans the first by start is named and all are covered. Rows are matched by id and text.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast(f"array<{HIT}>")
    id_, mark, spans = (fresh(docs, x) for x in ("id", "mark", "spans"))
    found = hits(docs).dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.concat("base", "terms").alias(spans))
    placed = F.array_sort(F.transform(F.coalesce(spans, none), lambda s: F.struct(s["start"], s["kind"], s["end"], s["name"])))
    done = replaced(text, placed, lambda s: F.when(s["kind"] <= 4, F.concat(F.lit("["), s["name"], F.lit("]"))).otherwise(""))
    new = F.when(F.col("text").isNotNull(), done)
    return docs.join(found, docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[mark]), "left").select(*(new.alias(c) if c == "text" else F.col(c) for c in docs.columns))
