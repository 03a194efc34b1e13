"""Secret scan: rules over whole texts, narrowed by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (``trigrams.clauses``). The index
holds postings (trigram, row) for the trigrams of all queries; a rule's candidates are the rows in whose
postings all trigrams of one of its clauses meet. Only candidates are verified with the rule's expression. A
rule without a mandatory trigram (runs of hexadecimal digits) scans every text. Everything is DataFrame
operations on whole texts.

A match's position is found without a user function: the matches of an expression and the text between them
(``split`` by the same expression) alternate, so running sums of their lengths in code points are the spans.

Special cases: a null or empty text has no spans. Rows are told apart by 128 bits of key and text, so repeated
rows each get a result, null keys too. Extra columns are ignored, whatever their names. Rules may be any number,
and so may their trigrams and a text's matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.llm import trigrams
from tillgrain.llm.session import row_id, stored

#: Trigrams marked in one long number
MASK = 60


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: a match holds if this group (0: all of it) has so many characters; failing matches are dropped, not tried again
    group: int = 0
    least: int = 0


#: Fixed by contract, in the order of the output.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a maximal run of 16 or more is what [0-9a-f]+ finds and 16 characters leave
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


SPAN = "CAST(array() AS array<struct<start:int,order:int,end:int,kind:string>>)"


def trie(words: list[str]) -> str:
    """A regular expression for the words that reads a text once, however many there are: words branch character by
    character, and a node of many branches is halved by character classes."""
    kids: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        kids.setdefault(w[0], []).append(w[1:])

    def quoted(c: str) -> str:
        return f"\\x{{{ord(c):x}}}"

    def choice(chars: list[str]) -> str:
        if len(chars) > 4:
            left, right = chars[: len(chars) // 2], chars[len(chars) // 2 :]
            return "(?:" + "|".join(f"(?=[{''.join(map(quoted, half))}]){choice(half)}" for half in (left, right)) + ")"
        return "(?:" + "|".join(quoted(c) + (trie(kids[c]) if any(kids[c]) else "") for c in chars) + ")"

    return choice(sorted(kids))


def postings(docs: DataFrame, needed: list[str], *, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index for the given trigrams: (trigram, row), a row of it for each text that holds the trigram. One pass
    over a text finds all it holds."""
    low = docs.select(row_id(doc_key, text).alias("row"), F.lower(F.col(text)).alias("low"))
    held = F.array_distinct(F.regexp_extract_all("low", F.lit(f"(?=({trie(needed)}))"), F.lit(1)))
    return low.select(F.explode(held).alias("trigram"), "row")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(row, rules): the rows that a rule's query admits, with the rules. Postings are intersected by marking, for each clause,
    which of its trigrams a row has: in as many masks as the longest clause needs."""
    spark = index.sparkSession
    entries = [(rule, c, t, i // MASK, i % MASK, len(clause)) for rule, query in queries.items() for c, clause in enumerate(query) for i, t in enumerate(sorted(clause))]
    terms = spark.createDataFrame(entries, "rule int, clause int, trigram string, mask int, place int, need int")
    masks = 1 + max(e[3] for e in entries)
    seen = [F.bit_or(F.when(F.col("mask") == m, F.expr("shiftleft(1L, place)")).otherwise(F.lit(0).cast("long"))).alias(f"seen{m}") for m in range(masks)]
    met = index.join(F.broadcast(terms), "trigram").groupBy("row", "rule", "clause").agg(*seen, F.max("need").alias("need"))
    full = met.where(" + ".join(f"bit_count(seen{m})" for m in range(masks)) + " = need")
    return full.groupBy("row").agg(F.collect_set("rule").alias("rules"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(steps: Column) -> Column:
    """Of each place of an array of numbers, the sum before it. Sums run within pieces of about the root of the length, and
    over the pieces, as appending to an array copies it."""

    def running(items: Column, step: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("heads"))
        return F.aggregate(items, start, lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.concat(acc["heads"], F.array(acc["at"])).alias("heads")))

    def pieces(all_: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(all_))), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / wide).cast("int")), lambda i: running(F.slice(all_, i * wide + 1, wide), lambda x: x))
        return _let(cut, lambda parts: F.flatten(F.zip_with(parts, running(parts, lambda p: p["at"])["heads"], lambda p, head: F.transform(p["heads"], lambda h: h + head))))

    return _let(steps, lambda all_: F.when(F.size(all_) > 0, pieces(all_)).otherwise(F.expr("CAST(array() AS array<int>)")))


def found(text: Column, regex: Column, group: Column, least: Column, order: Column, kind: Column) -> Column:
    """A rule's spans in a text: array of (start, order, end, kind). The rule is data, so that the plan doesn't grow with the rules."""
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    none = F.transform(matches, lambda m: F.lit(0))
    sizes = F.when(least > 0, F.transform(F.regexp_extract_all(text, regex, group), F.length)).otherwise(none)
    gaps = F.transform(F.split(text, regex, F.lit(-1)), F.length)
    pairs = F.arrays_zip(F.transform(matches, F.length).alias("m"), sizes.alias("g"), F.slice(gaps, F.lit(1), F.size(matches)).alias("b"))

    def spans(all_: Column) -> Column:
        def span(x: Column, at: Column) -> Column:
            start = at + x["b"]
            return F.struct(start.alias("start"), order.alias("order"), (start + x["m"]).alias("end"), kind.alias("kind"), x["g"].alias("g"))

        held = F.filter(F.zip_with(all_, before(F.transform(all_, lambda x: x["b"] + x["m"])), span), lambda s: s["g"] >= least)
        return F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(F.regexp_like(text, regex), _let(pairs, spans)).otherwise(F.expr(SPAN))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and spans, an array of (start, order, end, kind) sorted by start, then the rules' order."""
    queries = {i: query for i, rule in enumerate(rules) if (query := trigrams.clauses(rule.regex)) is not None}
    narrow = docs.select(F.col(doc_key).alias(doc_key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    always = F.lit([i for i in range(len(rules)) if i not in queries]).cast("array<int>") if len(queries) < len(rules) else F.expr("CAST(array() AS array<int>)")
    if queries:
        needed = sorted({t for query in queries.values() for clause in query for t in clause})
        hits = stored(candidates(postings(narrow, needed, doc_key=doc_key, text="t"), queries))
        # candidates are few; Spark broadcasts them if the stored table is small and joins by shuffle if not
        narrow = narrow.withColumn("row", row_id(doc_key, "t")).join(hits, "row", "left")
        always = F.when(F.col("rules").isNull(), always).otherwise(F.concat("rules", always))

    def of_rule(i: Column) -> Column:
        regex, group, least, kind = (F.get(F.lit([getattr(r, name) for r in rules]), i) for name in ("regex", "group", "least", "kind"))
        return found(F.col("t"), regex, group, least, i, kind)

    return narrow.select(doc_key, F.array_sort(F.flatten(F.transform(always, of_rule))).alias("spans"))


def line(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
