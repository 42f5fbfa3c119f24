"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regex is parsed once on the driver into a Boolean query of trigrams that every match must contain
(a disjunction of conjunctions, lower-cased). The documents' postings of just these trigrams are built, intersected by
document and conjunction, and give the candidates of each rule; candidates are verified with the regex itself. A rule
without mandatory trigrams (a run of hex digits) scans every document.

Matches of a rule are leftmost and non-overlapping; a match that fails the rule's check is dropped. Positions are code
points, end exclusive.

Defined results: null text has no spans, as has an empty one. Rows that share a doc_id share candidates, and each is
verified on its own text; null ids are one id here. Extra columns are ignored; an empty table gives an empty result. A
very long text is read whole, in time that grows as n log n with its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

try:
    from re import _parser as sre  # the standard library's own parser of regexes
except ImportError:  # before Python 3.11
    import sre_parse as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, replaced, spans_of


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    #: Code points that this group has at least.
    least: int = 0


#: Fixed patterns. The first three are the base kinds; the others are public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("stripe", r"sk_(?:live|test)_[0-9A-Za-z]{24,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = 3
MOST_STRINGS = 64
MOST_CLASS = 8


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _least(query: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without conjunctions that another one implies; any document satisfies the empty conjunction."""
    return {q for q in query if not any(p < q for p in query)}


def _and(p: set[frozenset[str]], q: set[frozenset[str]]) -> set[frozenset[str]]:
    both = _least({a | b for a in p for b in q})
    return both if len(both) <= MOST_STRINGS else p


ANY = {frozenset()}


def _strings(node: tuple) -> set[str] | None:
    """All strings that a regex node matches, lower-cased, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST_CLASS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_CLASS else None
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] <= 5:
        inner = _sequence_strings(arg[2])
        if inner is None:
            return None
        found, now = ({""} if arg[0] == 0 else set()), {""}
        for k in range(1, arg[1] + 1):
            now = {a + b for a in now for b in inner}
            if len(now) > MOST_STRINGS:
                return None
            found |= now if k >= arg[0] else set()
        return found
    if op in ("ASSERT", "ASSERT_NOT", "AT"):
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _sequence_query(nodes) -> set[frozenset[str]]:
    """Trigrams that every match contains: of runs of nodes whose strings are few, and of the other nodes by themselves."""
    query, run = ANY, {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        query, run = _and(query, _least({_grams(s) for s in run})), {""}
        if more is not None:
            run = more
            continue
        op, arg = str(node[0]), node[1]
        if op == "SUBPATTERN":
            query = _and(query, _sequence_query(arg[3]))
        elif op == "BRANCH":
            query = _and(query, _least(set().union(*(_sequence_query(x) for x in arg[1]))))
        elif op in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            query = _and(query, _sequence_query(arg[2]))
    return _and(query, _least({_grams(s) for s in run}))


def trigram_query(regex: str) -> set[frozenset[str]]:
    """Conjunctions of lower-case trigrams; every text that the regex matches holds all trigrams of one of them."""
    return _least(_sequence_query(sre.parse(regex)))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index, for these trigrams: a row (gram, doc_id) if the text of doc_id has the trigram in either case."""
    low = docs.filter(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    # outer: else a filter on the array's size is inferred, and the array is computed twice
    return low.select("doc_id", held.alias("grams")).select("doc_id", F.explode_outer("grams").alias("gram")).filter(F.col("gram").isNotNull())


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and rules (bit k: the text of doc_id may match rule k), for the rules with mandatory trigrams."""
    terms = [(k, c) for k, r in enumerate(rules) for c in sorted(map(sorted, trigram_query(r.regex))) if c]
    trigrams = sorted({t for _, c in terms for t in c})
    # by trigram: the conjunctions it takes part in, and the bit it stands for there
    uses = [F.array(*[F.struct(F.lit(j).alias("term"), F.lit(1 << c.index(t)).cast("long").alias("bit")) for j, (_, c) in enumerate(terms) if t in c]) for t in trigrams]
    full = F.array(*[F.lit((1 << len(c)) - 1).cast("long") for _, c in terms])
    rule_of = F.array(*[F.lit(1 << k).cast("long") for k, _ in terms])
    by_gram = postings(docs, trigrams).select("doc_id", F.explode(F.coalesce(*[F.when(F.col("gram") == k, u) for k, u in enumerate(uses)])).alias("use"))
    return (
        by_gram.groupBy("doc_id", F.col("use.term").alias("term")).agg(F.bit_or("use.bit").alias("bits"))
        .filter(F.col("bits") == full[F.col("term")])
        .groupBy("doc_id").agg(F.bit_or(rule_of[F.col("term")]).alias("rules"))
    )


def _rule_spans(rule: Rule, order: int, text: Column, ask: Column) -> Column:
    """Checked spans of one rule as structs that sort by start, then by the rule's place."""
    found = spans_of(text, rule.regex)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_extract(s["text"], rule.regex, rule.group)) >= rule.least)
    shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rule"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(ask & F.regexp_like(text, F.lit(rule.regex)), shaped).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int,kind:string>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "found") -> DataFrame:
    """All columns of docs and out (array of start, rule, end, kind by start, then rule; of null text none) for each row.

    The candidates are written first: Spark then knows their size, and broadcasts or shuffles them accordingly.
    """
    queries = [trigram_query(r.regex) for r in rules]
    rows, may = docs, F.lit(0).cast("long")
    text = F.coalesce(docs["text"], F.lit(""))
    if any(frozenset() not in q for q in queries):
        asked = materialise(candidates(docs.select("doc_id", "text"), rules), "candidates")
        rows = docs.join(asked, docs["doc_id"].eqNullSafe(asked["doc_id"]), "left")
        may = F.coalesce(asked["rules"], F.lit(0).cast("long"))
    parts = [_rule_spans(r, k, text, F.lit(True) if frozenset() in q else may.bitwiseAND(F.lit(1 << k)) != 0) for k, (r, q) in enumerate(zip(rules, queries, strict=True))]
    return rows.select(*(docs[c] for c in docs.columns), F.array_sort(F.concat(*parts)).alias(out))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, of each row of docs."""
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda s: s["rule"] == k)).cast("long")
    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:BASE])),
        F.sha2(listed(F.filter(found, lambda s: s["rule"] < BASE)), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each span of its text replaced by [kind]; of overlapping spans the first one is named and all are covered."""
    text, found = F.col("text"), fresh(docs, "found")
    new = replaced(text, F.col(found), lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))
    return scan(docs, rules, found).select(*(new.alias(c) if c == "text" else F.col(c) for c in docs.columns))
