"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units of a text become typed placeholders (<num>, <name>, <unit>); the rest is lower-cased and loses
punctuation after a word. Tokens keep their places, so a canonical window and its raw words line up. Windows of WINDOW
canonical tokens of every document are hashed and joined with those of the benchmark's items; equal windows give slots,
the pairs of benchmark word and document word under each placeholder. Within an occurrence each benchmark value must
stand for one document value, and each document value for one benchmark value: a question with other numbers or names
passes, a chance likeness does not. Windows of one
text at one offset from the item are an alignment. From each consistent alignment on, others that agree with what is
taken so far join it, the longest first, and so do all windows without slots (a copy with words put in has several
alignments). A document is contaminated by an item if one such union covers COVERED of the item's tokens; that of the
longest alignment is reported if it does, else the widest. Of an alignment that contradicts itself only the windows
without slots count.

Windows with fewer than LITERAL literal tokens say little by their shape: they match where the raw words are equal, in
lower case and without marks around them.

The items' hashes are broadcast if there are at most BROADCAST_WINDOWS of them (16 bytes each): then one pass over the
texts, without a shuffle, gives the matching windows, which are written. A larger benchmark is joined by shuffle, on
narrow rows (doc_id, position, hash), and the documents with a match are read again.

Defined results: null and empty texts, and those without a window, have no row; items likewise (an item shorter than
WINDOW is one window). Rows that share a doc_id are judged as one document, null ids too; likewise items. Extra columns
are ignored; an empty table on either side gives an empty result. A very long text is read whole, in time that grows with
its words; what is held of a document and an item are their alignments, one for each set of slot values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WRITTEN, discard, materialise

WINDOW = 8
#: Share of a window's tokens that are no placeholders, at least, for a match by template; else raw words must be equal.
LITERAL = 0.5
#: Share of an item's tokens that matching windows cover, at least.
COVERED = 0.4
BROADCAST_WINDOWS = 1_000_000
#: Items that a window may be in and still name them.
SHARED = 8
#: Units of measure and currency, as fixed words.
UNITS = "mm|cm|m|km|in|ft|mi|g|kg|mg|lb|oz|t|s|min|h|hr|hrs|ms|l|ml|kb|mb|gb|w|kw|v|a|hz|khz|mhz|%|usd|eur|gbp|dollars?|cents?|euros?|pounds?|miles?|meters?|metres?|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
NUMBER = r"[0-9][0-9.,:/]*"
SLOT = r"<(?:num|name|unit)>"


def raw_tokens(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def _canonical_text(text: Column) -> Column:
    """The text with placeholders. No replacement adds or removes white space or empties a word."""
    named = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "<>", "()"), r"(?<=[\p{L}\p{N},;] )\p{Lu}[\p{L}'-]*", "<name>")
    numbered = F.regexp_replace(F.lower(named), NUMBER, "<num>")
    measured = F.regexp_replace(numbered, rf"(?<=<num>[ -]?)(?:{UNITS})(?![\p{{L}}\p{{N}}<])", "<unit>")
    return F.regexp_replace(measured, r"(?<=[\p{L}>])[^\p{L}\p{N}<>\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)", "")


def canonical_tokens(text: Column) -> Column:
    """As many tokens as raw_tokens gives, canonical."""
    return F.filter(F.split(_canonical_text(text), rf"[{SPACE}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _bare(word: Column) -> Column:
    """A word without marks around it, in lower case: a slot's value."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _slotted(tokens: Column) -> Column:
    """How many canonical tokens hold placeholders, the only ones with angle brackets."""
    return F.size(F.filter(tokens, lambda w: F.contains(w, F.lit("<"))))


def _is_verbatim(window: Column, size: Column) -> Column:
    """Whether a canonical window has too few literal tokens to match by template."""
    return size - _slotted(window) < F.ceil(F.lit(LITERAL) * size)


def _hashes(tokens: Column, raw: Column, size: int) -> Column:
    """Hash of the window of so many tokens from each position on, of its bare raw words if it matches verbatim; null if there are fewer tokens."""
    places = F.sequence(F.lit(1), F.size(tokens) - size + 1)
    part = lambda words, i: F.slice(words, i, F.lit(size))
    either = lambda i: F.when(_is_verbatim(part(tokens, i), F.lit(size)), F.xxhash64(F.transform(part(raw, i), _bare))).otherwise(F.xxhash64(part(tokens, i)))
    # a text with few placeholders has no verbatim window
    few = ~_is_verbatim(tokens, F.lit(size))
    return F.when(F.size(tokens) >= size, F.when(few, F.transform(places, lambda i: F.xxhash64(part(tokens, i)))).otherwise(F.transform(places, either)))


def _matching(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, row (hash of the text), size, hash, d_pos, d_window, d_words of the documents' windows whose (h_size, h_hash) is listed, by broadcast.

    Exploding and probing are one generated loop: tokens and words go along by reference, and only matches are rows.
    """
    tokens = docs.select("doc_id", F.xxhash64("text").alias("row"), canonical_tokens(F.col("text")).alias("tokens"), raw_tokens(F.col("text")).alias("raw"))
    parts = []
    for size in sizes:
        # outer: else a filter on the array's size is inferred, and all hashes are computed twice
        placed = tokens.select("doc_id", "row", "tokens", "raw", _hashes(F.col("tokens"), F.col("raw"), size).alias("hashes")).select("doc_id", "row", "tokens", "raw", F.posexplode_outer("hashes").alias("pos", "hash"))
        hit = placed.join(F.broadcast(hashes.filter(F.col("h_size") == size)), F.col("hash") == F.col("h_hash"), "left_semi")
        parts.append(hit.select("doc_id", "row", F.lit(size).alias("size"), "hash", F.col("pos").alias("d_pos"), F.slice("tokens", F.col("pos") + 1, F.lit(size)).alias("d_window"), F.slice("raw", F.col("pos") + 1, F.lit(size)).alias("d_words")))
    return reduce(DataFrame.unionByName, parts)


def _matching_by_shuffle(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """As _matching, for a benchmark of any size: narrow rows (doc_id, position, hash) are joined, and texts met again."""
    parts = []
    for size in sizes:
        every = _let(F.struct(canonical_tokens(F.col("text")).alias("c"), raw_tokens(F.col("text")).alias("r")), lambda t: _hashes(t["c"], t["r"], size))  # noqa: B023
        parts.append(docs.select("doc_id", every.alias("hashes")).select("doc_id", F.lit(size).alias("size"), F.posexplode_outer("hashes").alias("pos", "hash")))
    mine = reduce(DataFrame.unionByName, parts)
    hit = mine.join(hashes, (mine["hash"] == hashes["h_hash"]) & (mine["size"] == hashes["h_size"]), "left_semi")
    places = materialise(hit.groupBy("doc_id").agg(F.collect_set(F.struct("size", "pos")).alias("places")), "places").withColumnRenamed("doc_id", "p_id")
    found = docs.join(places, docs["doc_id"].eqNullSafe(places["p_id"])).select("doc_id", F.xxhash64("text").alias("row"), F.explode_outer(_spelled(F.col("text"), F.col("places"))).alias("w"))
    return found.select("doc_id", "row", F.col("w.size").alias("size"), _hash_of(F.col("w")).alias("hash"), F.col("w.pos").alias("d_pos"), F.col("w.window").alias("d_window"), F.col("w.words").alias("d_words"))


def _spelled(text: Column, places: Column) -> Column:
    """For places (array of size and pos): the canonical window and its raw words."""
    return _let(
        F.struct(canonical_tokens(text).alias("c"), raw_tokens(text).alias("r")),
        lambda t: F.transform(places, lambda p: F.struct(p["size"].alias("size"), p["pos"].alias("pos"), F.slice(t["c"], p["pos"] + 1, p["size"]).alias("window"), F.slice(t["r"], p["pos"] + 1, p["size"]).alias("words"))),
    )


def _hash_of(w: Column) -> Column:
    """As _hashes, of one spelled window."""
    return F.when(_is_verbatim(w["window"], w["size"]), F.xxhash64(F.transform(w["words"], _bare))).otherwise(F.xxhash64(w["window"]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """item_id, n_tokens, size, i_pos, hash, i_window, i_words of the items' windows; the sizes in use (window of them at most)."""
    items = benchmark.select("item_id", "text", F.size(canonical_tokens(F.col("text"))).alias("n_tokens")).filter("n_tokens > 0")
    sizes = sorted(r[0] for r in items.select(F.least(F.lit(window), "n_tokens").alias("size")).distinct().collect())
    size = F.least(F.lit(window), F.col("n_tokens"))
    places = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - size), lambda p: F.struct(size.alias("size"), p.alias("pos")))
    out = items.select("item_id", "n_tokens", F.explode_outer(_spelled(F.col("text"), places)).alias("w"))
    return out.select("item_id", "n_tokens", "w.size", F.col("w.pos").alias("i_pos"), _hash_of(F.col("w")).alias("hash"), F.col("w.window").alias("i_window"), F.col("w.words").alias("i_words")), sizes


def _one_to_one(binds: Column) -> Column:
    """Whether distinct pairs of benchmark and document values (i, d) pair each value with one only."""
    of = lambda name: F.size(F.array_distinct(F.transform(binds, lambda b: b[name])))
    return (of("i") == F.size(binds)) & (of("d") == F.size(binds))


def _unions(units: Column, size: Column) -> Column:
    """Of a document's consistent alignments, the widest first: the union (covered, n, slots) from the first, or the widest from any."""
    kind = "struct<places:array<int>,binds:array<struct<i:string,d:string>>,n:bigint>"

    def joined(acc: Column, u: Column) -> Column:
        both = F.array_union(acc["binds"], u["binds"])
        agree = _one_to_one(both)
        return F.when(agree, F.struct(F.array_union(acc["places"], u["places"]).alias("places"), both.alias("binds"), (acc["n"] + u["n"]).alias("n")).cast(kind)).otherwise(acc)

    def union(seed: Column) -> Column:
        rest = F.filter(units, lambda u: u["binds"] != seed["binds"])
        start = F.struct(seed["places"].alias("places"), seed["binds"].alias("binds"), seed["n"].alias("n")).cast(kind)
        covered = lambda acc: F.size(F.array_distinct(F.flatten(F.transform(acc["places"], lambda p: F.sequence(p, p + size - 1)))))
        return F.aggregate(rest, start, joined, lambda acc: F.struct(covered(acc).cast("long").alias("covered"), acc["n"].alias("n"), F.size(acc["binds"]).cast("long").alias("slots")))

    return _let(union(units[0]), lambda first: F.when(first["covered"] >= F.col("least"), first).otherwise(F.array_max(F.transform(units, union))))


def _candidates(hit: DataFrame, of_items: DataFrame, covered: float) -> DataFrame:
    """c_doc, item_id, n_tokens of documents and items that may have enough in common.

    A window that more than SHARED items have names no item, unless such windows alone cover enough of it: every other
    contaminated document has one of the item's own windows. So a common phrase isn't met with all items that hold it.
    """
    held = of_items.groupBy("hash", "size").agg(F.count_distinct(F.struct("item_id")).alias("n_items"))
    marked = of_items.select("item_id", "n_tokens", "size", "hash", "i_pos").join(held, ["hash", "size"])
    places = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("n_items") > SHARED, F.sequence(F.col("i_pos"), F.col("i_pos") + F.col("size") - 1)))))
    reach = marked.groupBy("item_id", "n_tokens").agg((F.size(places) >= F.ceil(F.lit(covered) * F.col("n_tokens"))).alias("by_shared")).withColumnsRenamed({"item_id": "r_item", "n_tokens": "r_tokens"})
    seeds = marked.join(reach, F.col("item_id").eqNullSafe(F.col("r_item")) & (F.col("n_tokens") == F.col("r_tokens"))).filter((F.col("n_items") <= SHARED) | F.col("by_shared"))
    return hit.select(F.col("doc_id").alias("c_doc"), "hash", "size").distinct().join(seeds.select("item_id", "n_tokens", "hash", "size").distinct(), ["hash", "size"]).select("c_doc", "item_id", "n_tokens").distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, covered_tokens, item_tokens, n_slots of every contaminated document and its items."""
    of_items, sizes = benchmark_windows(benchmark, window)
    if not sizes:
        kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_windows long, covered_tokens long, item_tokens int, n_slots long"
        return docs.sparkSession.createDataFrame([], kinds)
    hashes = of_items.select(F.col("size").alias("h_size"), F.col("hash").alias("h_hash")).distinct()
    match = _matching if hashes.count() <= broadcast_windows else _matching_by_shuffle
    hit = materialise(match(docs.select("doc_id", "text"), hashes, sizes), "matches")
    alike = F.when(_is_verbatim(F.col("i_window"), F.col("i_size")), F.transform("d_words", _bare) == F.transform("i_words", _bare)).otherwise(F.lit(True))
    of_items = materialise(of_items, "windows")
    asked = _candidates(hit, of_items, covered).withColumnsRenamed({"item_id": "c_item", "n_tokens": "c_tokens"})
    of_pairs = asked.join(of_items.withColumnsRenamed({"size": "i_size", "hash": "i_hash"}), F.col("item_id").eqNullSafe(F.col("c_item")) & (F.col("n_tokens") == F.col("c_tokens")))
    both = of_pairs.join(hit, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("hash") == F.col("i_hash")) & (F.col("size") == F.col("i_size")) & (F.col("d_window") == F.col("i_window")) & alike)
    slots = F.filter(
        F.transform("i_window", lambda w, k: F.struct(F.regexp_like(w, F.lit(SLOT)).alias("slot"), _bare(F.col("i_words")[k]).alias("i"), _bare(F.col("d_words")[k]).alias("d"))),
        lambda s: s["slot"],
    )
    pair = ["__doc", "__item"]
    keyed = both.select(F.struct("doc_id").alias("__doc"), F.struct("item_id").alias("__item"), "n_tokens", "size", "i_pos", "row", (F.col("d_pos") - F.col("i_pos")).alias("offset"), slots.alias("slots"))
    keyed = keyed.select("*", F.transform("slots", lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"))).alias("said"))
    aligned = keyed.groupBy(*pair, "n_tokens", "size", "row", "offset", (F.size("said") > 0).alias("slotted")).agg(
        F.collect_set("i_pos").alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("binds"), F.count("*").alias("n")
    )
    aligned = aligned.filter(_one_to_one(F.col("binds")))
    # alignments of equal slot values agree, as do all windows without slots
    units = aligned.groupBy(*pair, "n_tokens", "size", "binds").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"), F.sum("n").alias("n"))
    listed = units.groupBy(*pair, "n_tokens", "size").agg(F.sort_array(F.collect_list(F.struct((F.size("binds") == 0).alias("plain"), F.size("places").alias("width"), "n", "places", "binds")), asc=False).alias("units"))
    widest = listed.withColumn("least", F.ceil(F.lit(covered) * F.col("n_tokens"))).withColumn("u", _unions(F.col("units"), F.col("size")))
    return widest.filter(F.col("u.covered") >= F.col("least")).select(
        F.col("__doc.doc_id").alias("doc_id"), F.col("__item.item_id").alias("item_id"), F.col("u.n").alias("n_windows"), F.col("u.covered").alias("covered_tokens"), F.col("n_tokens").alias("item_tokens"), F.col("u.slots").alias("n_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id no item contaminates.

    What goes is written first: Spark then knows its size, and broadcasts it or shuffles accordingly.
    """
    before = len(WRITTEN)
    gone = materialise(contaminations(docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    discard(docs.sparkSession, WRITTEN[before:-1])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
