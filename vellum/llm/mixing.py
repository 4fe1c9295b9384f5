"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document's expected number of copies is its inclusion measure (a class
from 1 to 4 that grows with its length) times a factor of its source, at most ``MAX_COPIES``; the factor makes the
expected words meet the target. The whole part of the expectation is certain. The fraction p is an inclusion
probability, and documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a hash of the row taken as a uniform
number: random odds over inclusion odds. Each source takes the documents of least rank until its remaining words are
met, so the size of the sample is fixed and inclusion is unequal. Rows that are equal in all columns are numbered, and
number and row make the hash, so each of them is drawn for itself.

Scale: the texts are read once for their sizes; all else are aggregates over narrow rows. Equal rows are counted map-side, so
a row that fills a third of the table is one row until it is dealt out again, ``BLOCK`` at a time. The cut of a source is found
in three steps, so that a source with a third of all documents is never sorted in one task: words are summed by classes of the
rank, then by fine classes within the one that holds the cut, and only the fine class that holds it (a few millionths of the
source) is ordered row by row. What is joined back is one row for each source.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; repeated rows are
drawn each for itself (which of them is taken how often makes no difference); ties in rank are broken by the hash; an empty
table gives an empty result; other columns are carried along (:func:`mix`) or ignored (:func:`plan`) but for the hash, which
is of all columns (maps, which have no hash, apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import small, text_key, words
from vellum.session import cut_lineage

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)     # of the sources in order of code points, repeating
SEED = 20240607
CLASSES = 4
RANK_STEPS = 2048       # classes of the rank for each factor e, and fine classes of each
BLOCK = 4096            # equal rows that one row is dealt out to at a time


def _size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _measure(size: Column) -> Column:
    """Inclusion measure: 1 for under 10 words, then one more for each factor of ten, 4 at most."""
    return 1 + F.when(size >= 1000, 3).when(size >= 100, 2).when(size >= 10, 1).otherwise(0)


def _hash(docs: DataFrame) -> Column:
    """Hash of a whole row of ``docs``, the text by its key."""
    rest = [F.col(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(SEED).cast("long"), F.col("doc_id").cast("long"), text_key(F.col("text")), *rest)


def _numbered(rows: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, with a hash of hash ``h`` and number for all but the first."""
    few = rows.where(F.col(n) <= BLOCK).withColumn("from", F.lit(0).cast("long"))
    many = rows.where(F.col(n) > BLOCK).withColumn("from", F.explode(F.expr(f"sequence(0L, {n} - 1, {BLOCK}L)")))
    parts = few.unionByName(many.repartition("h", "from"))
    parts = parts.withColumn("j", F.explode(F.expr(f"sequence(from, least({n}, from + {BLOCK}) - 1)")))
    return parts.withColumn("h", F.when(F.col("j") == 0, F.col("h")).otherwise(F.xxhash64("h", "j"))).drop("from", "j", n)


def _rank(h: Column, p: Column) -> Column:
    """Logarithm of random odds over inclusion odds."""
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return F.log(u / (1 - u)) - F.log(p / (1 - p))


def _fill(shares: DataFrame, by: list[str], total: Column, order: list[str]) -> DataFrame:
    """Adds ``level``: total is dealt in proportion to ``weight``, no row above ``cap``, the excess dealt again.

    Rows in order of cap / weight are capped until the common level fits; running sums find it without a loop.
    """
    w = Window.partitionBy(*by).orderBy(F.expr("cap / weight"), *order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    cand = shares.withColumn("level", level).withColumn("ratio", F.expr("cap / weight"))
    # the first row in order that the level does not cap; among equal ratios the highest level is the first row's
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("minus")))
    return cand.withColumn("level", -F.min(fits).over(everything)["minus"]).drop("ratio")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): sources (one row each, so windows over them are narrow) share all words."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.select("source", "source_size", F.lit(0).alias("one"))
    place = F.row_number().over(Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MAX_COPIES * F.col("source_size").cast("double"))
    total = F.sum("source_size").over(Window.partitionBy("one")).cast("double")
    f = _fill(per, ["one"], total, ["source"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return f.select("source", "source_size", target.alias("target"))


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, n): the different rows of ``docs`` and how often each stands there."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size(F.col("text")).alias("size"), _hash(docs).alias("h"))
    return d.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))


def sized(counts: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, measure), one row for each document."""
    return _numbered(counts, "n").select("doc_id", "source", "size", "h", _measure(F.col("size")).alias("measure"))


def _class(rank: Column) -> Column:
    """Fine class of a rank; ``RANK_STEPS`` of them make a class."""
    return F.floor(rank * float(RANK_STEPS * RANK_STEPS))


def _edge(rows: DataFrame, kind: Column) -> DataFrame:
    """(s, edge, before): of rows (source, size, remaining, before), the class in which the remaining words of a source run
    out, and the words before it. Windows are over classes, not rows."""
    sums = rows.groupBy("source", kind.alias("class")).agg(F.sum("size").alias("words"), F.first("remaining").alias("remaining"),
                                                           F.first("before").alias("before"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("class"))
    found = sums.withColumn("upto", upto).where("upto >= remaining").groupBy("source")
    found = found.agg(F.min(F.struct("class", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    return found.select(F.col("source").alias("s"), F.col("x.class").alias("edge"), F.col("x.before").alias("before"))


def source_plan(sizes: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, copies (expected copies by measure, an array) and cut (the
    greatest rank that is taken, null if none is)."""
    targets = cut_lineage(source_targets(sizes))
    cells = sizes.groupBy("source", "measure").agg(F.sum("size").cast("double").alias("words")).where("words > 0")
    t = targets.select(F.col("source").alias("s"), "target")
    cells = cells.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("weight", F.col("words") * F.col("measure")).withColumn("cap", MAX_COPIES * F.col("words"))
    filled = _fill(cells, ["source"], F.col("target"), ["measure"])
    each = F.round(F.least(F.lit(float(MAX_COPIES)), F.coalesce(F.col("level") * F.col("measure"), F.lit(float(MAX_COPIES)))), 9)
    filled = cut_lineage(filled.select("source", "measure", "words", each.alias("e")))
    by_measure = [F.coalesce(F.max(F.when(F.col("measure") == m, F.col("e"))), F.lit(0.0)) for m in range(1, CLASSES + 1)]
    per = filled.groupBy("source").agg(F.array(*by_measure).alias("copies"),
                                       F.sum(F.col("words") * (F.col("e") - F.floor("e"))).alias("remaining"))
    per = small(cut_lineage(per.withColumnRenamed("source", "s")))
    ranked = sizes.where("size > 0").join(per, F.col("source").eqNullSafe(F.col("s")))
    p = F.element_at("copies", F.col("measure")) - F.floor(F.element_at("copies", F.col("measure")))
    ranked = ranked.withColumn("p", p).where("p > 0").withColumn("rank", _rank(F.col("h"), F.col("p")))
    ranked = ranked.select("source", "size", "h", "rank", "remaining", F.lit(0).cast("long").alias("before"), _class(F.col("rank")).alias("fine"))
    last = ranked.groupBy("source").agg(F.max("fine").alias("last")).withColumnRenamed("source", "l")
    for kind in (F.floor(F.col("fine") / RANK_STEPS), F.col("fine")):  # the class in which the words run out, then the fine class
        edge = small(cut_lineage(_edge(ranked, kind)))
        ranked = ranked.drop("before").join(edge, F.col("source").eqNullSafe(F.col("s")) & (kind == F.col("edge"))).drop("s", "edge")
    # rows of that fine class in order; a row is taken if more than half of it is still wanted
    order = Window.partitionBy("source").orderBy("rank", "h").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("upto", F.col("before") + F.sum("size").over(order))
    cut = (rows.where(F.col("upto") - F.col("size") / 2 <= F.col("remaining")).groupBy("source")
           .agg(F.max(F.struct("rank", "h")).alias("cut")).select(F.col("source").alias("c"), "cut"))
    out = targets.join(per.drop("remaining"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.join(edge.drop("before"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = out.join(last, F.col("source").eqNullSafe(F.col("l")), "left").drop("l")
    out = out.join(cut, F.col("source").eqNullSafe(F.col("c")), "left").drop("c")
    # fine classes below the edge are taken whole; without an edge the words end before the wanted ones do
    below = F.coalesce(F.col("edge"), F.col("last") + 1)
    return out.select("source", "source_size", "target", "copies", "cut", below.alias("below"))


def _copies(size: Column, measure: Column, h: Column) -> Column:
    """Copies of a row, given the columns of its source's plan."""
    e = F.element_at("copies", measure)
    p = e - F.floor(e)
    rank = _rank(h, p)
    extra = (p > 0) & ((_class(rank) < F.col("below"))
                       | F.coalesce(F.struct(rank.alias("rank"), h.alias("h")) <= F.col("cut"), F.lit(False)))
    return F.when(size > 0, F.floor(e).cast("int") + F.when(extra, 1).otherwise(0)).otherwise(0)


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each document."""
    sizes = cut_lineage(sized(counted(docs)))
    by_source = small(cut_lineage(source_plan(sizes).withColumnRenamed("source", "s")))
    j = sizes.join(by_source, F.col("source").eqNullSafe(F.col("s")))
    n = _copies(F.col("size"), F.col("measure"), F.col("h"))
    out = j.select("doc_id", "source", "size", "source_size", "target", n.alias("n"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("n").alias("copies"),
                      (F.col("size") * F.col("n")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay, none is added."""
    counts = cut_lineage(counted(docs))
    by_source = cut_lineage(source_plan(cut_lineage(sized(counts))))
    by_source = small(by_source.select(F.col("source").alias("k_source"), "copies", "cut", "below"))
    # sizes and hashes are columns of the join's input: what is filtered and repeated after it never computes them again
    rows = docs.select(F.struct(*docs.columns).alias("row"), _size(F.col("text")).alias("k_size"), _hash(docs).alias("h"))
    again = cut_lineage(counts.where("n > 1").select("h").distinct())
    if not again.isEmpty():  # equal rows are made one map-side, then numbered as in the plan
        again = small(again)
        same = rows.join(again, "h", "left_semi").groupBy("h").agg(F.first("row").alias("row"), F.first("k_size").alias("k_size"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(again, "h", "left_anti").unionByName(_numbered(same, "n"))
    j = rows.join(by_source, F.col("row.source").eqNullSafe(F.col("k_source")))
    n = _copies(F.col("k_size"), _measure(F.col("k_size")), F.col("h"))
    return j.select("row", n.alias("n")).select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*")
