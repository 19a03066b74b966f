"""Line deduplication by a deletion-neighbourhood join, all in SQL expressions.

Two lines are alike if they are equal, or if both have at least ``LEAST_WORDS``
words and one turns into the other by changing, adding or removing one word
(word edit distance 1): one word in five, as a similarity of 0.8 allows, so a
shorter line has an edit bound of 0.  A line goes if a line before it, in order of document
and line number, is alike; the earliest stays.

Deletion neighbourhood (FastSS): a line emits its variants with one word left
out, as hashed keys.  Lines that differ in the word at place i share the
variant without that word, keyed with i and the number of words; a line and
one with a word more share the shorter line itself.  A key holds each word with
its place, so lines of one key are alike (but for 64-bit collisions) and a
group needs no pairs: the earliest line of a key is the partner of all others,
found by a partially aggregated minimum, and a line that thousands share costs
one row a task.

Only lines that can have a partner emit variants: of two alike lines the first
or the last half is the same.  Half keys are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import words
from quarrystone.operators import tables
from quarrystone.operators.tables import cut_lineage, free_names, join_hot, table_bytes

LEAST_WORDS = 5


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines that have a word, by place and hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("row"), F.posexplode(F.split(body, "\n")).alias("no", "line"))
    rows = rows.where(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "")
    return rows.select("doc", "row", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _keys(n: Column, w: str) -> list[Column]:
    """Half keys of a line of n words, for partners of n and of n - 1 or n + 1 words."""

    def halves(m: Column) -> list[Column]:
        p = F.floor(m / 2).cast("int")
        return [F.xxhash64(m, F.lit("a"), F.slice(w, 1, p)), F.xxhash64(m, F.lit("z"), F.slice(w, n - (m - p) + 1, m - p))]

    return [*halves(n), *halves(n - 1)]


def _place() -> Column:
    """Order of lines: by document, null ids last, rows of equal id by a hash of their text, then line number."""
    return F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "no")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, line_no, kept_id, kept_line_no, distance, row) of every line that goes.

    Line numbers begin at 0.  ``kept`` is the first line alike of distance 0,
    or of distance 1 if there is no equal line before.  Lines without a word
    always stay.  Null texts have none.  A null id comes last; rows of equal
    id are ordered by ``row``, a hash of the text, and rows of equal id and
    text are one document, whose lines go or stay in each.  Very long lines
    cost their number of words.  An empty table gives an empty result.  No
    other column is read.
    """
    lines = _lines(docs, doc_id, text)
    # numbers alone are grouped: a line's text is looked at again only if it is a candidate
    hashed = lines.withColumn("w", words(F.col("line"))).withColumn("n", F.size("w")).drop("line")
    long_enough = F.col("n") >= least_words
    hashed = hashed.select("doc", "row", "no", "h1", "h2", *[F.when(long_enough, k).alias(f"k{i}") for i, k in enumerate(_keys(F.col("n"), "w"))])
    known = hashed.groupBy("h1", "h2").agg(F.min(_place()).alias("at"), F.count("*").alias("times"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    known = cut_lineage(known)
    halves = known.where("k0 IS NOT NULL").select("h1", "h2", "at", "times", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = halves.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    able = cut_lineage(halves.join(shared, "k", "left_semi").select("h1", "h2", "at", "times").distinct())
    n_lines = known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    # one line of each kind is read again, so the others are left out before the words are looked at
    small = table_bytes(able) <= tables.BROADCAST_BYTES
    texts = lines.join(F.broadcast(able), ["h1", "h2"]) if small else join_hot(lines, able, ["h1", "h2"], "times", n_lines)
    texts = texts.where(_place() == F.col("at"))
    long = texts.select("h1", "h2", "at", F.transform(words(F.col("line")), lambda x: F.xxhash64(x)).alias("w")).dropDuplicates(["h1", "h2"])
    long = cut_lineage(long.withColumn("n", F.size("w")))
    # the parity sum of all words hashed with their places stands for a line, so that equal sums mean equal words in equal order;
    # words after the gap move up one place, and what that changes up to each gap is a running parity sum
    n = F.col("n")
    xor = lambda a, b: a.bitwiseXOR(b)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), xor)
    edged = long.withColumn("here", F.transform("w", lambda x, i: F.xxhash64(x, i))).withColumn("up", F.transform("w", lambda x, i: F.xxhash64(x, i - 1)))
    edged = edged.withColumn("run", _running(F.zip_with("here", "up", xor), n, xor))
    spots = F.zip_with("here", F.zip_with("here", "run", xor), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    edged = edged.select("h1", "h2", "at", "n", total("here").alias("all"), total("up").alias("moved"), spots.alias("spots"))
    gaps = edged.select("h1", "h2", "at", "n", "all", "moved", F.posexplode("spots").alias("i", "s"))
    gaps = gaps.withColumn("g", xor(F.col("all"), F.col("s.x"))).withColumn("d", xor(F.col("moved"), F.col("s.y")))
    # "same": the word at one place differs; "less": the key is a whole line, and lines of one word more hold it
    roles = F.array(F.struct(F.xxhash64(F.lit("same"), "i", "n", "g").alias("k"), F.lit(0).alias("role")), F.struct(F.xxhash64(F.lit("less"), F.col("n") - 1, "d").alias("k"), F.lit(1).alias("role")))
    gone = gaps.select("h1", "h2", "at", F.inline(roles))
    less = edged.select("h1", "h2", "at", F.xxhash64(F.lit("less"), "n", "all").alias("k"), F.lit(2).alias("role"))
    keyed = gone.unionAll(less)
    first = keyed.groupBy("k").agg(
        F.count("*").alias("c"),
        F.min(F.when(F.col("role") == 0, F.col("at"))).alias("s0"),
        F.min(F.when(F.col("role") == 1, F.col("at"))).alias("s1"),
        F.min(F.when(F.col("role") == 2, F.col("at"))).alias("s2"),
    ).where("c > 1").drop("c")
    met = keyed.join(first, "k")
    # a line of one word more looks to the whole line, and the whole line to those; they are not alike among themselves
    partner = F.when(F.col("role") == 0, F.col("s0")).when(F.col("role") == 1, F.col("s2")).otherwise(F.col("s1"))
    links = met.select("h1", "h2", "at", partner.alias("p")).where("p < at").groupBy("h1", "h2").agg(F.min("p").alias("near"))
    links = _verified(links, long)
    state = cut_lineage(known.select("h1", "h2", "at", "times").join(links, ["h1", "h2"], "left").where("times > 1 OR near IS NOT NULL"))
    out = join_hot(lines.select("doc", "row", "no", "h1", "h2"), state, ["h1", "h2"], "times", n_lines)
    mine = _place()
    exact = F.col("at") < mine
    kept = F.when(exact, F.col("at")).otherwise(F.col("near"))
    out = out.where(exact | F.col("near").isNotNull()).withColumn("kept", kept)
    return out.select(
        F.col("doc").alias(doc_id), F.col("no").cast("long").alias("line_no"), F.col("kept.doc").alias("kept_id"),
        F.col("kept.no").cast("long").alias("kept_line_no"), F.when(exact, 0).otherwise(1).alias("distance"), "row",
    )


def _running(values: Column, n: Column, add) -> Column:
    """Sums of the first 1, 2, ... of n values, in log2(n) steps that each double the reach."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)

    def step(sums: Column, k: Column) -> Column:
        before = F.array_repeat(F.lit(0).cast("long"), F.pow(F.lit(2), k).cast("int"))
        return F.zip_with(sums, F.slice(F.concat(before, sums), 1, n), add)

    return F.when(n > 1, F.aggregate(steps, values, step)).otherwise(values)


def _verified(links: DataFrame, long: DataFrame) -> DataFrame:
    """The links whose lines' word edit distance is 1: what the common start and end leave is at most one word each."""
    left = links.join(long.select("h1", "h2", F.col("w").alias("a")), ["h1", "h2"])
    both = left.join(long.select(F.col("at").alias("near"), F.col("w").alias("b")), "near")
    size = F.greatest(F.size("a"), F.size("b"))

    def start(a: Column, b: Column) -> Column:
        """Words up to the first that differs."""
        spot = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.when(spot == 0, size).otherwise(spot - 1)

    ends = start(F.col("a"), F.col("b")) + start(F.reverse("a"), F.reverse("b"))
    return both.where(ends >= size - 1).select("h1", "h2", "near")


def drop_repeated_lines(docs: DataFrame, repeats: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that ``repeated_lines`` gave left out of their texts; rows are known by id and ``row``, and null ids are equal.

    A row's line numbers are brought together, which is no more than the row
    itself holds.
    """
    name, row, gone = free_names(docs, "line_doc", "line_row", "lines_gone")
    listed = repeats.groupBy(F.col(doc_id).alias(name), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    body = F.col(f"`{text}`")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(name)) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col(row))
    joined = docs.join(listed, same, "left")
    kept = F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long")))
    return joined.withColumn(text, F.when(F.col(gone).isNull(), body).otherwise(F.array_join(kept, "\n"))).drop(name, row, gone)
