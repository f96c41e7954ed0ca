"""Benchmark decontamination over a distributed positional inverted index.

Postings (document, position, term) are stored for those benchmark terms that are rarest in
the corpus: of each window of consecutive item words the two that the corpus holds least
often. Where a posting meets a term's place in an item, the offset-adjusted lists are
intersected on their alignment (document, item, document position minus item position).
An alignment on which two rare terms of an item meet is a candidate; its words are then
compared in place, one row for each alignment, which gives exact phrase matches, and within
a slop also proximity matches. Everything is DataFrame functions. The corpus is tokenised to
count the terms and to store the postings, the candidates once more, and all of it where
every document's number of words is asked for; only texts of candidates ever move.

A side is broadcast only if its measured bytes are within BROADCAST_BYTES; beyond that the
join shuffles. No group is collected but the distinct items of a document.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. An
item of fewer words than a window, but of some, is one window.

Defined cases: null texts have no words; an item without words is ignored; items that
share an id count once; items of equal text are each reported; a null document id is an
id like any other; documents that share an id are answered row by row; repeated rows are
searched once and each answered; a very long text is one row of words, and its alignments
are rows of their own; an empty table on either side gives no hits; other columns may have
any name: contamination() does not read them and clean() returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import Scratch, quoted

WINDOW = 13
#: Measured bytes of a side that is broadcast.
BROADCAST_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What names a document: its id and its text's hash, so that rows sharing an id stay apart.
NAME = ("key", "rid")


def words(text: Column) -> Column:
    """The words of a text. lower() is quicker than translate(), and the same for ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def weight(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    total: Column = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            total += F.coalesce(F.octet_length(F.array_join(f.name, " ")) + 16 * F.size(f.name), F.lit(0))
        else:
            total += F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16
    return total


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast side if its bytes are within BROADCAST_BYTES; else left to a shuffle join."""
    return F.broadcast(df) if (df.agg(F.sum(weight(df)).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES else df


def on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on NAME, null ids being equal; the left one's names are kept."""
    other = right.withColumnsRenamed({c: f"{c}_" for c in NAME})
    joined = left.join(other, F.col("key").eqNullSafe(F.col("key_")) & (F.col("rid") == F.col("rid_")), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("key_", "rid_")


class Postings:
    """The rare part of the inverted index of a corpus, for one benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, window: int) -> None:
        self.scratch = Scratch(docs.sparkSession)
        self.window = window
        self.rows = docs.select(quoted(key).alias("key"), rid(quoted(text)).alias("rid"), quoted(text).alias("text"), F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"))
        self.docs = self.rows.drop("row")
        listed = items.select(quoted(item).alias("item"), words(quoted(item_text)).alias("terms")).filter(F.size("terms") > 0).distinct()
        self.items = self.scratch.write(listed.withColumn("line", F.xxhash64("item", "terms")))
        self.places = self.items.select("line", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
        self.rare = self.scratch.write(self._rare())
        self.postings = self.scratch.write(self._postings())

    def _rare(self) -> DataFrame:
        """Places of the two rarest terms of each window: line, at, term."""
        vocabulary = bounded(self.places.select("term").distinct())
        tokens = self.docs.select(F.explode(words(F.col("text"))).alias("term"))
        counts = tokens.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
        counted = self.places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        # each place belongs to the windows that start at most window - 1 words before it
        first = F.greatest(F.lit(0), F.col("at") - (self.window - 1))
        last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - self.window))
        spread = counted.filter(first <= last).select("line", F.explode(F.sequence(first, last)).alias("start"), F.struct("n", "at", "term").alias("place"))
        both = spread.groupBy("line", "start").agg(F.slice(F.sort_array(F.collect_list("place")), 1, 2).alias("two"))
        return both.select("line", F.explode("two").alias("p")).select("line", F.col("p.at").alias("at"), F.col("p.term").alias("term")).distinct()

    def _postings(self) -> DataFrame:
        terms = bounded(self.rare.select("term").distinct())
        return self.docs.select(*NAME, F.posexplode(words(F.col("text"))).alias("position", "term")).join(terms, "term")

    def cell(self, slack: int) -> int:
        """More than the differences of two terms of a match can lie apart: places in the window and in the words around it."""
        return 2 * self.window + 2 * slack - 1

    def alignments(self, slack: int = 0) -> DataFrame:
        """(key, rid, line, low): document position minus item position, where two rare terms meet.

        With slack, low is the lower bound of a range of 2 * cell(slack) differences. Two places of
        one match differ by less than a cell, so they share the range of the lower one's cell.
        """
        placed = self.postings.join(bounded(self.rare), "term")
        low = F.col("position") - F.col("at")
        if slack:
            size = self.cell(slack)
            cell = F.floor(low / size).cast("int")
            placed = placed.withColumn("low", F.explode(F.array((cell - 1) * size, cell * size)))
        else:
            placed = placed.withColumn("low", low)
        # two different places suffice; their least and greatest tell, and combine before the shuffle
        met = placed.groupBy(*NAME, "line", "low").agg(F.min("at").alias("one"), F.max("at").alias("other"))
        single = self.items.filter(F.size("terms") == 1).select(F.col("line").alias("alone"))
        met = met.join(bounded(single), F.col("line") == F.col("alone"), "left")
        return met.filter((F.col("one") < F.col("other")) | F.col("alone").isNotNull()).select(*NAME, "line", "low")

    def matches(self, slack: int = 0) -> DataFrame:
        """(key, rid, item, found): the matching windows on each alignment that has some, found
        being an array of struct<start, end>. Exact phrases; with slack, windows of which all terms
        lie within the window's length and slack words to either side."""
        met = self.scratch.write(self.alignments(slack))
        who = met.select(*NAME).distinct()
        # each candidate's text once, however often its row is repeated; words before the join, which repeats them by reference
        texts = on(self.docs, bounded(who), "left_semi").groupBy(*NAME).agg(F.min("text").alias("text"))
        told = texts.select(*NAME, words(F.col("text")).alias("words"))
        lines = met.join(bounded(self.items), "line")
        compared = on(told, bounded(lines), "inner").select(*NAME, "item", self._compared(slack).alias("found"))
        return self.scratch.write(compared.filter(F.size("found") > 0))

    def _compared(self, slack: int) -> Column:
        terms, low = F.col("terms"), F.col("low")
        size = F.least(F.size(terms), F.lit(self.window))
        first = F.greatest(F.lit(0), -low) if not slack else F.lit(0)
        last = F.size(terms) - size

        def same(start: Column) -> Column:
            return F.slice("words", start + low + 1, size) == F.slice(terms, start + 1, size)

        def within(start: Column, begin: Column, end: Column) -> Column:
            begin = F.greatest(F.lit(0), begin)
            around = F.slice("words", begin + 1, F.greatest(F.lit(0), end - begin))
            return F.size(F.array_except(F.slice(terms, start + 1, size), around)) == 0

        def near(start: Column) -> Column:
            # every place of the words around the window that the range allows
            span = size + 2 * slack
            begin, end = start + low - span, start + low + 2 * self.cell(slack) + size
            anywhere = F.exists(F.sequence(begin, end), lambda at: within(start, at, at + span))
            return within(start, begin, end + span) & anywhere

        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.filter(starts, near if slack else same),
            lambda s: F.struct((s + low).cast("int").alias("start"), (s + low + size).cast("int").alias("end")),
        )


def rid(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _names(found: DataFrame) -> DataFrame:
    """(key, rid, items): the distinct items of each document, ascending as strings."""
    named = found.select(*NAME, F.col("item").cast("string").alias("item")).distinct()
    return named.groupBy(*NAME).agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """key, n_words, n_hit, items (distinct, ascending as strings), contaminated; a row for each row.

    contaminated: some word is hit, and a twentieth of the words at least.
    """
    index = Postings(docs, items, key, text, item, item_text, window)
    found = index.matches()
    hit = F.array_distinct(F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["end"] - 1))))
    hits = found.select(*NAME, F.explode(hit).alias("position")).distinct().groupBy(*NAME).agg(F.count("*").alias("n_hit"))
    told = on(hits, _names(found), "inner")
    whole = on(index.docs.select(*NAME, F.size(words(F.col("text"))).cast("long").alias("n_words")), bounded(told), "left")
    out = whole.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, in which no window of any item occurs, however
    long the text around it: what is trained on holds no benchmark passage."""
    index = Postings(docs, items, key, text, item, item_text, window)
    dirty = index.matches().select(*NAME).distinct()
    return on(index.rows, bounded(dirty), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def proximity(docs: DataFrame, items: DataFrame, slack: int, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """key and near: distinct items with a window whose terms all lie within its length and slack words to either side."""
    index = Postings(docs, items, key, text, item, item_text, window)
    near = index.matches(slack).groupBy(*NAME).agg(F.array_sort(F.collect_set("item")).alias("near"))
    whole = on(index.docs.select(*NAME), bounded(near), "left")
    return whole.select(F.col("key").alias(key), F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near"))
