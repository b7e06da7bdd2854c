"""Similarity joins of short texts by an index instead of a product: containment by rare grams, one edit by what is left
without a character, more edits by segments.

All joins work within groups (``keys``: a statement, say) on distinct texts. Work grows with the texts and with the pairs that
share an index entry, never with the product of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import shuffled

#: Characters of a gram, and of one of texts without separators. Shorter patterns are looked up by the shorter gram, or as a whole.
GRAM, LONG_GRAM = 4, 8


def _spread(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows over a fixed number of partitions: few texts can be many index entries, so sizes in bytes would undersell them."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(tasks, *columns).distinct()


def _grams(text: Column, size: Column) -> Column:
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def containing(texts: DataFrame, patterns: DataFrame, keys: list[str], gram: int = GRAM) -> DataFrame:
    """keys, text, pattern: distinct pairs of texts (keys, text) and non-empty patterns (keys, pattern) they contain.

    A pattern is indexed under one gram only, that of its grams which the fewest patterns of the group share; a text is looked up
    under all its grams, so it meets few patterns for each of them. Grams are cut only of sizes that a pattern of the group needs.
    """
    texts = _spread(texts.filter("text <> ''"), [*keys, "text"])
    size = F.when(F.length("pattern") >= gram, gram).otherwise(F.least(F.length("pattern"), F.lit(GRAM)))
    sized = _spread(patterns.filter("pattern <> ''"), [*keys, "pattern"]).withColumn("size", size)
    wanted = sized.select(*keys, "size").distinct()
    held = texts.join(wanted, keys).select(*keys, "size", "text", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram"))
    at = [*keys, "size", "gram"]
    asked = sized.select(*keys, "size", "pattern", F.explode(_grams(F.col("pattern"), F.col("size"))).alias("gram"))
    common = asked.groupBy(*at).agg(F.count("*").alias("patterns"))  # added up in the tasks, so all grams may be counted
    rarest = (asked.join(shuffled(common), at).groupBy(*keys, "size", "pattern").agg(F.min(F.struct("patterns", "gram")).alias("rarest"))
              .select(*keys, "size", "pattern", F.col("rarest.gram").alias("gram")))
    return held.join(rarest.hint("shuffle_hash"), at).filter(F.col("text").contains(F.col("pattern"))).select(*keys, "text", "pattern")


def _most_edits(longest: str, least: float) -> str:
    """Most edits that two texts, the longer one of this length, may need. A little more is looked up than is verified."""
    return f"cast(floor({1 - least!r}D * {longest} + 1e-6D) as int)"


def _similarity(edits: str) -> Column:
    return 1.0 - F.expr(edits) / F.greatest(F.length("a"), F.length("b"))


def one_edit(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, a, b, score: pairs of non-empty texts with at most one edit between them whose similarity is at least ``least``.

    Such texts are equal, or one without some character is the other, or both without one are equal; so they meet there alone,
    whatever they share with other texts.
    """
    def left_over(rows: DataFrame, name: str) -> DataFrame:
        without = f"transform(sequence(1, length({name})), i -> concat(substring({name}, 1, i - 1), substring({name}, i + 1)))"
        return rows.select(*keys, name, F.expr(f"explode(array_distinct(concat(array({name}), {without})))").alias("part"))

    left, right = (_spread(rows.filter(F.col(name) != ""), [*keys, name]) for rows, name in ((left, "a"), (right, "b")))
    pairs = left_over(left, "a").join(shuffled(left_over(right, "b")), [*keys, "part"]).select(*keys, "a", "b")
    score = _similarity("levenshtein(a, b, 1)").alias("score")  # -1 edits: more than one
    return pairs.select(*keys, "a", "b", score).filter((F.col("score") >= least) & (F.col("score") <= 1.0)).distinct()


def near(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """keys, a, b, score: pairs of non-empty texts of left (keys, a) and right (keys, b) whose edit similarity is at least ``least``.

    With at most k edits between them, one of k + 1 segments of b stands unchanged in a, and not far from its place: the
    j-th segment is preceded by at most j edits and followed by at most k - j. k follows from the longer length of the two, so
    b is cut once for each k that its partners can bring, and a is looked up only under lengths that occur in its group. Lengths
    that allow one edit at most go by ``one_edit``.
    """
    left = _spread(left.filter("a <> ''"), [*keys, "a"])
    right = _spread(right.filter("b <> ''"), [*keys, "b"])

    def one_allowed(name: str) -> Column:
        return F.expr(_most_edits(f"length({name})", least)) <= 1

    most = F.expr(_most_edits("greatest(length(a), length(b))", least))
    close = one_edit(left.filter(one_allowed("a")), right.filter(one_allowed("b")), keys, least).filter(most <= 1)
    lengths = right.groupBy(*keys).agg(F.collect_set(F.length("b")).alias("lengths"))  # bounded by the longest text
    short, long = f"{least!r}D * {{0}} - 1e-6D", f"{{0}} / {least!r}D + 1e-6D"
    cuts = f"""explode(flatten(transform(
      sequence({_most_edits('length(b)', least)}, {_most_edits('floor(' + long.format('length(b)') + ')', least)}),
      k -> transform(sequence(0, k), j -> struct(k, j, substring(b, cast(j * length(b) div (k + 1) as int) + 1,
        cast((j + 1) * length(b) div (k + 1) - j * length(b) div (k + 1) as int)) as part)))))"""
    index = right.withColumn("c", F.expr(cuts)).select(*keys, F.length("b").alias("size"), "c.*", "b").filter("part <> '' and k > 1")
    asked = (left.join(lengths, keys)
             .withColumn("size", F.expr(f"explode(filter(lengths, n -> n >= {short.format('length(a)')} and n <= {long.format('length(a)')}))"))
             .withColumn("k", F.expr(_most_edits("greatest(length(a), size)", least)))
             .filter("k > 1").withColumn("j", F.expr("explode(sequence(0, k))"))
             .withColumns({"begin": F.expr("cast(j * size div (k + 1) as int)"),
                           "width": F.expr("cast((j + 1) * size div (k + 1) - j * size div (k + 1) as int)"), "more": F.expr("length(a) - size")})
             .withColumns({"low": F.expr("greatest(0, begin - j, begin + more - (k - j))"),
                           "high": F.expr("least(length(a) - width, begin + j, begin + more + (k - j))")})
             .filter("width > 0 and low <= high")
             .select(*keys, "size", "k", "j", "a", F.expr(
                 "explode(array_distinct(transform(sequence(low, high), s -> substring(a, s + 1, width))))").alias("part")))
    score = _similarity("levenshtein(a, b, k)").alias("score")  # -1 edits: more than k
    return close.union(asked.join(shuffled(index), [*keys, "size", "k", "j", "part"])
                       .select(*keys, "a", "b", score).filter((F.col("score") >= least) & (F.col("score") <= 1.0)).distinct())
