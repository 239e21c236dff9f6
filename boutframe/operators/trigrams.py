"""Search by patterns (``ILIKE``) over an inverted table of character trigrams.

A text in lower case, with a mark at each end, is cut into trigrams; the table holds a row for each trigram and text that has
it, laid out by trigram, and how many texts each trigram has. A pattern's literal parts give trigrams that a hit must have; the
rarest few of them (by the counts) are looked up, texts that have all of these are candidates, and the real pattern decides. A
pattern without a part of three characters takes the trigrams that hold its longest part, any of which will do. Only a pattern
without literal characters looks at all texts.

So a lookup reads the postings of a few rare trigrams instead of all texts. Results equal ``ILIKE`` for every pattern,
wildcards and backslash escapes included.

Cases: null texts and null patterns match nothing; empty texts match patterns without literal characters; repeated ids are each
looked at; ids may be of any type that can be grouped by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutframe.session import materialize

RAREST = 3
START, END = "\u0002", "\u0003"


def grams(text: Column, size: int = 3) -> Column:
    """Distinct pieces of ``size`` characters."""
    last = F.char_length(text) - (size - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def literals(pattern: Column) -> Column:
    """The literal parts between wildcards, in lower case and without escapes."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:[^%_\\]|\\.)+)"), F.lit(1))
    return F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"(?s)\\(.)", "$1")))


class TrigramIndex:
    """``postings``: gram, id; ``counts``: gram, n; ``texts``: id, text."""

    def __init__(self, texts: DataFrame, postings: DataFrame, counts: DataFrame):
        self.texts, self.postings, self.counts = texts, postings, counts

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str) -> TrigramIndex:
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
        marked = F.concat(F.lit(START), F.lower("text"), F.lit(END))
        rows = texts.select(F.explode(grams(marked)).alias("gram"), "id").distinct()
        postings = materialize(rows.repartitionByRange("gram", "id").sortWithinPartitions("gram"), "postings")  # a file holds few trigrams, so lookups skip most of them; a frequent one is spread by id
        return cls(texts, postings, materialize(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "trigram-counts"))

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """``pattern, id`` of texts that may match, from distinct patterns that have a literal character."""
        cut = patterns.withColumn("parts", literals(F.col("pattern")))
        cut = cut.withColumns({"needed": F.array_distinct(F.flatten(F.transform("parts", lambda p: grams(p)))), "longest": F.array_max(F.transform("parts", lambda p: F.struct(F.char_length(p).alias("size"), p.alias("part"))))["part"]})
        wanted = cut.where(F.size("needed") > 0).select("pattern", F.explode("needed").alias("gram")).join(self.counts, "gram", "left")
        rank = F.row_number().over(Window.partitionBy("pattern").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        rare = wanted.withColumn("rank", rank).where(F.col("rank") <= RAREST)
        rare = rare.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("pattern"))).select("pattern", "gram", "of")
        every = rare.join(self.postings, "gram").groupBy("pattern", "id").agg(F.count(F.lit(1)).alias("met"), F.first("of").alias("of")).where("met = of").select("pattern", "id")
        holds = self.counts.select("gram", F.explode(F.array_union(grams(F.col("gram"), 1), grams(F.col("gram"), 2))).alias("longest"))
        short = cut.where(F.size("needed") == 0).select("pattern", "longest").join(holds, "longest").select("pattern", "gram")
        return every.unionByName(short.join(self.postings, "gram").select("pattern", "id").distinct())

    def search(self, patterns: DataFrame) -> DataFrame:
        """``pattern, id, text`` for every match of the patterns in the column ``pattern``."""
        patterns = patterns.select("pattern").where("pattern is not null").distinct()
        literal = F.size(literals(F.col("pattern"))) > 0
        hits = self.candidates(patterns.where(literal)).join(self.texts, "id").where(F.expr("text ilike pattern")).select("pattern", "id", "text")
        return hits.unionByName(self._by_length(patterns.where(~literal)))

    def _by_length(self, patterns: DataFrame) -> DataFrame:
        """Matches of patterns of wildcards only, which ask for a length or more; by equal lengths, so nothing is paired in vain."""
        sized = self.texts.withColumn("size", F.char_length("text"))
        longest = sized.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()["most"]
        least = F.char_length(F.replace(F.col("pattern"), F.lit("%"), F.lit("")))
        most = F.when(F.contains(F.col("pattern"), F.lit("%")), F.lit(longest)).otherwise(least)
        wanted = patterns.where(least <= longest).select("pattern", F.explode(F.sequence(least, most)).alias("size"))
        return wanted.join(sized, "size").select("pattern", "id", "text")
