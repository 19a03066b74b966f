"""Mixing sources to target weights by Pareto order sampling, all in SQL expressions.

A source's target is met in three steps.

1. Whole copies that every document is certain of: floor(target / size).
2. For the words that are left, each document gets an inclusion probability.
   Documents are classed by size, in powers of two; class g has the weight
   1 / (1 + g), as an extra copy of a long document repeats many words at
   once.  The probability is min(1, level * weight), with the level at which
   the expected words, sum of probability times size, are what is left.
   Probability 1 is a certain copy more.
3. All others are ranked by Pareto's variable (Rosen 1997): random odds
   u / (1 - u), divided by inclusion odds p / (1 - p).  The sample has a fixed
   size, counted in words: the ranking is cut where the words that are left
   are reached, at the nearest document end.

The cut is found without sorting a source in one task: ranks are dealt into
about sqrt(n) bins a source, bin sums give the one bin where the cut lies, and
only that bin's rows, about sqrt(n) again, are put in order.  Sources are put
in order by range partitions, so their number may grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.tables import cut_lineage, near, reduce_rows

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: Most sources that one task puts in order.
FEW_SOURCES = 50_000
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A non-null key that orders by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _uniform(tag: Column, seed: int) -> Column:
    """In (0, 1), from the md5 of seed and tag; the same in any engine."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), tag))
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _class(size: Column) -> Column:
    """0 for size 0, else the number of binary digits of the size, at most 64."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("int")


def _rank(seed: int) -> Column:
    """Pareto's variable q as q / (1 + q), for a probability p under 1."""
    u, p = _uniform(F.col("tag"), seed), F.col("p")
    q = u / (F.lit(1.0) - u) / (p / (F.lit(1.0) - p))
    return q / (F.lit(1.0) + q)


def _rows(doc_id: str, text: str, source: str) -> list[Column]:
    """What a row is known by: equal rows share a tag."""
    tag = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return [F.col(doc_id).alias("id"), tag.alias("tag"), _key(F.col(source)).alias("key"), word_count(F.col(text)).alias("size")]


def _prefix(rows: DataFrame, order: list[str], out: dict[str, str], few: bool) -> DataFrame:
    """``rows`` with, for each name of ``out``, the sum of its column over all rows before, in a total order.

    Few rows are ordered in one task.  More are dealt by ranges of the order;
    then the only step in one task runs over one row of sums a partition.
    """
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in out.items()})
    dealt = rows.repartitionByRange(reduce_rows(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sums = dealt.groupBy("part").agg(*[F.sum(c).alias(f"{name}_all") for name, c in out.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *[F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_all") for name in out])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(F.broadcast(sums), "part")
    for name, c in out.items():
        both = both.withColumn(name, F.col(f"{name}_all") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return both.drop("part", *[f"{name}_all" for name in out])


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(key, n, source_size, target) of each source of rows (key, size).

    Targets share ``share`` times all sizes by weight; none passes ``most``
    times its size.  Sharing the excess again until none is above has the
    closed form least(cap, level * weight), where level is the greatest of
    (total - caps of the first k) / (weights of the others) over the sources
    in order of cap / weight.
    """
    stats = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    few = stats.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    stats = _prefix(stats.withColumn("one", F.lit(1).cast("long")), ["key"], {"place": "one"}, few)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    stats = stats.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    stats = _prefix(stats.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "key"], {"caps": "cap", "weights": "weight"}, few)
    stats = cut_lineage(stats.drop("one", "place"))
    sums = stats.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if sums.weight is None:
        return stats.select("key", "n", "source_size", F.lit(0.0).alias("target"))
    level = stats.agg(F.max((F.lit(share) * F.lit(float(sums.size)) - F.col("caps")) / (F.lit(float(sums.weight)) - F.col("weights"))).alias("level")).first().level
    return stats.select("key", "n", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def inclusion(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, class, p): the inclusion probability of each size class of each source, over the words left by whole copies.

    The classes' probabilities times their words sum to ``left``: level is
    the greatest of (left - words of the first k classes) / (weighted words
    of the others), as in ``source_targets``; a source has 64 classes at most.
    """
    sums = rows.where("size > 0").groupBy("key", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    sums = sums.join(near(stats.select("key", "left")), "key").withColumn("w", F.lit(1.0) / (F.lit(1) + F.col("class")))
    own = Window.partitionBy("key").orderBy("class")
    first = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(F.col("words") * F.col("w")).over(own.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("level", (F.col("left") - first) / others).withColumn("level", F.max("level").over(Window.partitionBy("key")))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("level") * F.col("w")))
    return sums.select("key", "class", "words", p.alias("p"))


def source_cuts(rows: DataFrame, seed: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target, whole, bins, chances, cut_bin, cut, cut_rows) of each source of rows (tag, key, size).

    ``chances`` maps size classes to inclusion probabilities.  A document of
    rank z gets ``whole`` copies, and one more if its probability is 1, or if
    its bin is before ``cut_bin``, or is it and (z, tag) is at most ``cut``.
    Where only some of the equal rows at ``cut`` fit, ``cut_rows`` says how many.
    """
    stats = source_targets(rows, weights, share, most)
    stats = stats.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(F.lit(0)).cast("long"))
    stats = stats.withColumn("bins", F.ceil(F.sqrt("n")).cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    stats = cut_lineage(stats)
    chances = inclusion(rows, stats).groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "p")))).alias("chances"), F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("words"))), F.lit(0)).alias("sure")
    )
    stats = cut_lineage(stats.join(chances, "key", "left").withColumn("left", F.col("left") - F.coalesce("sure", F.lit(0))).drop("sure"))
    ranked = _ranked(rows, stats, seed).where("z IS NOT NULL")
    sums = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("before", upto - F.col("words")).join(near(stats.select("key", "left")), "key")
    edge = cut_lineage(sums.where("before <= left AND before + words > left").select("key", F.col("bin").alias("cut_bin"), "before", "left"))
    inside = ranked.select("key", "bin", "z", "tag", "size").join(near(edge).withColumnRenamed("cut_bin", "bin"), ["key", "bin"])
    # equal rows share a tag, so a document that is repeated any number of times is one row here, and some of its rows may be taken
    inside = inside.groupBy("key", "z", "tag", "before", "left").agg(F.sum("size").alias("size"), F.count("*").alias("times"))
    run = F.sum("size").over(Window.partitionBy("key").orderBy("z", "tag").rowsBetween(Window.unboundedPreceding, 0))
    room = (F.col("left") - F.col("before") - run + F.col("size")) / (F.col("size") / F.col("times"))
    taken = inside.withColumn("cut_rows", F.least(F.floor(room + 0.5), F.col("times"))).where("cut_rows > 0")
    last = taken.groupBy("key").agg(F.max(F.struct("z", "tag", "cut_rows", "times")).alias("cut"))
    last = last.select("key", F.struct("cut.z", "cut.tag").alias("cut"), F.when(F.col("cut.cut_rows") < F.col("cut.times"), F.col("cut.cut_rows")).alias("cut_rows"))
    return cut_lineage(stats.join(edge.select("key", "cut_bin"), "key", "left").join(last, "key", "left").drop("left", "n"))


def _ranked(rows: DataFrame, stats: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their source's numbers, p, and rank z and bin where p is between 0 and 1."""
    out = rows.join(near(stats), "key").withColumn("p", F.when(F.col("size") > 0, F.try_element_at("chances", _class(F.col("size")))).otherwise(F.lit(0.0)))
    out = out.withColumn("z", F.when((F.col("p") > 0) & (F.col("p") < 1), _rank(seed)))
    return out.withColumn("bin", F.least(F.floor(F.col("z") * F.col("bins")), F.col("bins") - 1))


def _copies(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    out = _ranked(rows, cuts, seed)
    within = F.coalesce(F.struct("z", "tag") <= F.col("cut"), F.lit(False))
    extra = F.coalesce((F.col("p") >= 1) | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & within), F.lit(False))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long"))
    if cuts.where("cut_rows IS NOT NULL").isEmpty():
        return out.drop("cut_rows")
    # rows repeated at the cut are written, so that they have places: each partition takes what those before it left
    split = F.coalesce((F.struct("z", "tag") == F.col("cut")) & F.col("cut_rows").isNotNull(), F.lit(False))
    some = cut_lineage(out.where(split)).withColumn("part", F.spark_partition_id())
    counts = some.groupBy("key", "part").agg(F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = some.join(near(cut_lineage(counts.select("key", "part", earlier.alias("earlier")))), ["key", "part"])
    number = F.col("earlier") + F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0)))
    fewer = placed.withColumn("number", number).withColumn("copies", F.col("copies") - (F.col("number") > F.col("cut_rows")).cast("long"))
    return out.where(~split).unionByName(fewer.select(*out.columns)).drop("cut_rows")


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(id, size, source_size, target, taken, copies) of every row.

    Null and wordless texts have size 0 and take nothing.  Rows of null
    source are one source, the last; one without words has target 0.  Rows of
    equal id, text and source share one rank; where the target falls among
    them, as many as fit are taken, whichever they are.
    Ties of rank go by id and text.  An empty table gives an empty result; no
    other column is read.
    """
    rows = cut_lineage(docs.select(*_rows(doc_id, text, source)))
    out = _copies(rows, source_cuts(rows, seed, weights, share), seed)
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows that the mix takes, once for each copy that ``mix_counts`` gives, with the columns they came with.

    Texts are not shuffled while the sources' few numbers can be broadcast:
    each row meets them and decides for itself.  Rows without words, which no
    target asks for, are not taken.
    """
    cuts = source_cuts(cut_lineage(docs.select(*_rows(doc_id, text, source))), seed, weights, share)
    whole = docs.select(*_rows(doc_id, text, source), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _copies(whole, cuts, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
