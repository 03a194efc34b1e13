"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, then its first ``DEPTH`` tokens, in which tokens with a
digit are variable fields (``<*>``). A leaf gathers the lines with one path. Its template has, at each place,
the token (again with digits generalised) that more than half of the leaf's lines have there; other
places are variable. A line belongs to its leaf's template if the template has the line's tokens in
``SIMILAR`` of its places. The lines that a template leaves get one of their own in the same way. Where no line
belongs to the template, families of the same size hide each other: the lines are dealt out by the tokens of one
place (those that recur each to a node, the others to one node), and each node gets a template. So it goes on until
no node with enough unassigned lines can be split; a line that no template has is a template of its own.
Templates that enough different documents have are recurring, and their lines are dropped: ``MIN_DOCS``, but two
for lines of ``LONG`` tokens or more, which don't recur by chance.

A place deals out the lines of a path once at most, as after that it is constant or without a token that recurs; so rounds end.

Only leaves that enough documents reach can hold a recurring template, so the counts of paths come first
(two hashes a line) and all further steps see only lines of such leaves, each distinct generalised line
once. Everything is DataFrame operations; a leaf is never gathered, only counted. Whole texts are shuffled
twice at every size: lines to the leaves worth looking at, documents to their dropped lines. Both joins
are told to merge, as what they join with grows with the documents.

Special cases: a null text stays null with no lines; lines without a token are never dropped. Documents are
told apart by 128 bits of key and text: repeated rows count as one document, and each is in the result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrain.llm.session import row_id, stored

DEPTH = 3
SIMILAR = 0.6
MIN_DOCS = 3
LONG, LONG_MIN_DOCS = 50, 2
FIELD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def _general(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit("[0-9]")), F.lit(FIELD)).otherwise(token)


def enough(size: Column, min_docs: int) -> Column:
    """How many documents make a template of so many tokens recurring."""
    return F.when(size >= LONG, min(min_docs, LONG_MIN_DOCS)).otherwise(min_docs)


def _lines(docs: DataFrame, doc_key: str, text: str) -> DataFrame:
    """(row, at, line, tokens, leaf) of all lines with a token."""
    # the row's bits come first: beside the generator they would be computed from the whole text for each line
    rows = docs.where(F.col(text).isNotNull()).select(row_id(doc_key, text).alias("row"), F.col(text).alias("t"))
    split = rows.select("row", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    return _with_leaf(split)


def _with_leaf(lines: DataFrame) -> DataFrame:
    parts = lines.withColumn("tokens", tokens(F.col("line"))).where(F.size("tokens") > 0)
    lead = F.concat_ws(" ", *[_general(F.get("tokens", F.lit(i))) for i in range(DEPTH)])
    return parts.withColumn("leaf", F.xxhash64(F.size("tokens"), lead))


def _counts(kinds: DataFrame) -> DataFrame:
    """(node, place, token, n, enough): lines by node and token (hashed) of a place."""
    places = kinds.select("node", "n", "enough", F.posexplode(F.split("general", " ")).alias("place", "token"))
    return places.groupBy("node", "place", F.xxhash64("token").alias("token")).agg(F.sum("n").alias("n"), F.first("enough").alias("enough"))


def _fits(kinds: DataFrame, similar: float) -> DataFrame:
    """``kinds`` with fits: whether the template of the node has enough of the line's tokens."""
    # lines of a node that are all alike are its template: only nodes of different lines are counted, token by token
    several = kinds.groupBy("node").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("node", F.lit(True).alias("several"))
    told = kinds.join(several, "node", "left")
    counts = _counts(kinds.join(several.select("node"), "node", "left_semi"))
    # more than half: at most one token a place, so no ties. All lines of a node have all its places: a place's lines are the node's
    places = counts.groupBy("node", "place").agg(F.sum("n").alias("total"), F.max(F.struct("n", "token")).alias("top"))
    fixed = places.select("node", "place", "total", "top.*").where("2 * n > total")
    template = fixed.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("template"))
    hashes = F.transform(F.split("general", " "), lambda t: F.xxhash64(t))
    hits = F.size(F.filter(F.transform(hashes, lambda h, i: F.element_at(F.col("template"), i) == h), lambda x: x))
    fits = F.col("several").isNull() | (F.col("template").isNotNull() & (hits >= similar * F.size(hashes)))
    return told.join(template, "node", "left").select(*kinds.columns, fits.alias("fits"))


def _split(kinds: DataFrame) -> DataFrame:
    """``kinds`` of nodes whose template fits no line, dealt to smaller nodes by the tokens of one place; without nodes that have no such place."""
    # of a node all lines have one number of tokens, and so one number of documents that is enough
    counts = _counts(kinds)
    often = F.col("n") >= F.col("enough")
    places = counts.groupBy("node", "place").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).alias("cover"), F.count(F.when(often, 1)).alias("tokens")).where("top < total AND cover > 0")
    # tokens that recur tell families apart best where they cover most lines, and the fewer the better: fields have many
    best = places.groupBy("node").agg(F.max(F.struct("cover", -F.col("tokens"), -F.col("place"), "place")).getField("place").alias("place"))
    recur = counts.where(often).select("node", "place", "token", F.lit(True).alias("recurs"))
    at = kinds.join(best, "node").withColumn("token", F.xxhash64(F.get(F.split("general", " "), F.col("place"))))
    label = F.when(F.col("recurs"), F.col("token"))
    return at.join(recur, ["node", "place", "token"], "left").withColumn("node", F.xxhash64("node", "place", label, F.col("recurs").isNull())).select(*kinds.columns)


def _named(kinds: DataFrame, similar: float) -> DataFrame:
    """(leaf, line, name) of the distinct generalised lines that a template has, each leaf with as many templates as it takes."""
    todo, found = kinds.withColumn("node", F.col("leaf")), None
    while True:
        tried = stored(_fits(todo, similar))
        part = tried.where("fits").select("leaf", F.xxhash64("general").alias("line"), F.xxhash64("node").alias("name"))
        found = part if found is None else found.unionByName(part)
        rest = tried.groupBy("node").agg(F.coalesce(F.sum(F.when(~F.col("fits"), F.col("n"))), F.lit(0)).alias("rest"), F.max("fits").alias("some"), F.first("enough").alias("enough"))
        rest = stored(rest.where("rest >= enough").select("node", "some"))
        if rest.isEmpty():
            return found
        left = tried.where("NOT fits").drop("fits").join(rest, "node")
        # what a template leaves gets one of its own; a node without lines like its template is split
        peeled = left.where("some").withColumn("node", F.xxhash64("node", F.lit("rest"))).select(*todo.columns)
        todo = stored(peeled.unionByName(_split(left.where("NOT some").select(*todo.columns))))


def recurring_lines(docs: DataFrame, *, doc_key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(row, dropped): for each document with lines of recurring templates, their places (from 0)."""
    lines = _lines(docs, doc_key, text).withColumn("enough", enough(F.size("tokens"), min_docs))
    paths = lines.select("leaf", "enough", "row").distinct()
    busy = stored(paths.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.first("enough").alias("enough")).where("docs >= enough").select("leaf"))
    # the lines themselves are dealt, not their tokens, which would take several times the space
    general = F.array_join(F.transform(tokens(F.col("line")), _general), " ")
    found = stored(lines.select("row", "at", "leaf", "enough", "line").join(busy.hint("merge"), "leaf", "left_semi").select("row", "at", "leaf", "enough", general.alias("general")))

    kinds = stored(found.groupBy("leaf", "general").agg(F.count(F.lit(1)).alias("n"), F.first("enough").alias("enough")))
    named = _named(kinds, similar)
    line = F.xxhash64("general")
    own = F.coalesce("name", F.xxhash64("leaf", "line")).alias("name")
    placed = stored(found.select("row", "at", "leaf", "enough", line.alias("line")).join(named, ["leaf", "line"], "left").select("row", "at", "enough", own))
    # stored, so that the join below deals both sides anew and can split a template that very many documents have
    again = stored(placed.select("name", "enough", "row").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.first("enough").alias("enough")).where("docs >= enough").select("name"))
    return placed.join(again, "name").groupBy("row").agg(F.collect_set("at").alias("dropped"))


def dedup(docs: DataFrame, *, doc_key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, n_lines, n_dropped, and the text without the dropped lines."""
    drops = stored(recurring_lines(docs, doc_key=doc_key, text=text, **options))
    rows = docs.select(F.col(doc_key), F.col(text).alias("t"), row_id(doc_key, text).alias("row")).join(drops.hint("merge"), "row", "left")
    lines = F.split("t", "\n")

    def without(all_: Column) -> Column:
        # a hash set of places, not a search for each line; the lines are split once
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("dropped"))
        return F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n")

    rest = F.get(F.transform(F.array(lines), without), F.lit(0))
    return rows.select(
        F.col(doc_key),
        F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("t")).otherwise(rest).alias("text"),
    )
