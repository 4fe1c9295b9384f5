"""Source divergence audit: run-length columns.

Every language keeps the terms that stand in at least ``MIN_DOCS`` of its documents. A (language, source) group gives each
of them a smoothed, integer share p of its occurrences; two groups of a language differ by the sum over the terms of the
difference of their shares, and a group's own terms are those with a greater share than in the language as a whole.

Run-length columns: a group's counts are a column over the vocabulary. The vocabulary is put into an order that brings
equal counts together: terms with equal counts in every group are one row with a multiplicity, and the rows are sorted by
their (group, count) entries, groups with few occurrences first, since those have few different counts. The sorted rows are
cut into blocks; in a block each group's column is run-length encoded (value, length), a group without an entry being one
run of zeros. For a pair of groups the run boundaries of their columns are merged, and in each stretch between two
boundaries the difference of the two shares, constant there, is multiplied by the length of the stretch.

Scale: texts are read once, and counted in each task before anything is shuffled (tables of at most ``HELD`` terms); counts
of (language, source, term) are combined map-side, so a word in a third of all texts is a few rows. Blocks have at most
``BLOCK`` different rows and are dealt out by range, pairs of groups are compared in tiles of ``TILE`` x ``TILE`` columns of
one block, so a language or source with all the rows is still many tasks. The answer itself has a row for each ordered pair
of a language's sources, which is what the audit asks for; nothing else grows with pairs. All arithmetic is exact: counts
in 64-bit, products in decimals or Python integers.

Defined cases: null text, lang and source are empty strings, and '' is a language or source as any other; a row is a
document, repeated rows count as often as they occur; groups without terms stand with counts of zero; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import Rounds, cut_lineage

# Terms of the contract as UTF-8 bytes (every byte of a character beyond ASCII is 0x80 or more), the smoothing
# constants and the number of ranks of the part ``term``.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50

MIN_DOCS = 30
HELD = 200_000      # terms that a task counts before it hands them on
BLOCK = 8192        # rows of a block of the vocabulary
TILE = 32           # groups on a side of a tile of pairs
SPLITS = 64         # parts of what begins with the same entries


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and its documents there. Every group also has a
    row with the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, source, t, n, seen[lang, source][t]) for (lang, source), c in total.items() for t, n in c.items()]
            total.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                key = (lang, source)
                if key not in total:
                    total[key], seen[key] = Counter({b"": 0}), Counter()
                found = TERM.findall(text.as_py().lower())  # lower() of bytes changes A-Z alone
                held -= len(total[key])
                total[key].update(found)
                held += len(total[key])
                seen[key].update(set(found))
                if held > HELD:
                    yield out()
                    held = 0
        if total:
            yield out()

    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    parts = parts.withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, mass: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / mass), exact for any 64-bit count."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(SMOOTH).cast("decimal(2,0)"))
    return F.lit(1).cast("long") + F.call_function("div", product, mass.cast("decimal(20,0)"))


def shares(n: np.ndarray, mass: int) -> np.ndarray:
    """:func:`share` of many counts, in Python integers."""
    once, at = np.unique(n, return_inverse=True)
    return np.array([1 + SCALE * (int(x) + SMOOTH) // mass for x in once], dtype=np.int64)[at]


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, cells): the kept terms with their occurrences, in the language and by source."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return kept.where(F.col("docs") >= min_docs).drop("docs")


def group_table(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, source, idx, n_groups, n_terms, mass, lang_mass): the groups of each language, numbered by occurrences.
    A row for each group: the window over a language's groups is far smaller than the answer, which has its pairs."""
    groups = counts.where("term = ''").select("lang", "source")
    of_lang = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("total"))
    cells = vocab.select("lang", F.explode("cells").alias("c")).select("lang", "c.source", "c.n")
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    g = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "n_terms", "total"])
    w = Window.partitionBy("lang")
    smooth = SMOOTH * F.col("n_terms")
    return g.select("lang", "source", (F.row_number().over(w.orderBy("n", "source")) - 1).alias("idx"), F.count(F.lit(1)).over(w).alias("n_groups"),
                    "n_terms", (F.col("n") + smooth).alias("mass"), (F.col("total") + smooth).alias("lang_mass"))


def run_columns(vocab: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, block, size, idx, n, ends): the run-length columns of the groups that have an entry in a block. ``n`` are the
    counts of the runs, ``ends`` the number of terms of the block up to the end of each, ``size`` the terms of the block."""

    def encoded(lang: str, name: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        cells = t.column("vec").chunk(0)
        end = np.cumsum(t.column("times").to_numpy())
        row = np.repeat(np.arange(len(t)), np.diff(cells.offsets.to_numpy()))
        idx, n = (np.asarray(cells.flatten().field(k)) for k in ("idx", "n"))
        out = []
        for g in np.unique(idx):
            column = np.zeros(len(t), dtype=np.int64)
            column[row[idx == g]] = n[idx == g]
            last = np.append(np.flatnonzero(column[1:] != column[:-1]), len(t) - 1)
            out.append((lang, name, int(end[-1]), int(g), column[last], end[last]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        name = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        of = None
        for b in batches:
            langs = b.column("lang").to_pylist()
            at = 0
            while at < len(langs):
                have = sum(map(len, held))
                if held and (langs[at] != of or have >= block):
                    yield encoded(of, name, held)
                    name, held, have = name + 1, [], 0
                of = langs[at]
                end = at + 1
                while end < len(langs) and langs[end] == of and have + end - at < block:
                    end += 1
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield encoded(of, name, held)

    arrow = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("idx", pa.int32()),
                       ("n", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    cells = vocab.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    cells = cells.join(groups.select("lang", "source", "idx"), ["lang", "source"])
    rows = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("vec"))
    rows = rows.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("times"))
    # ranges go by the first entries alone: whole vectors as sampled keys would pass many megabytes through the driver
    rows = rows.repartitionByRange("lang", F.slice("vec", 1, 3), F.pmod(F.xxhash64("vec"), F.lit(SPLITS))).sortWithinPartitions("lang", "vec")
    return rows.mapInArrow(run, "lang string, block long, size long, idx int, n array<long>, ends array<long>")


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over the terms of a block of the difference of two columns (share of each run, end of each run)."""
    cuts = np.union1d(a[1], b[1])
    lengths = np.diff(cuts, prepend=0)
    return int(np.abs(a[0][np.searchsorted(a[1], cuts)] - b[0][np.searchsorted(b[1], cuts)]) @ lengths)


def group_pairs(columns: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value) for every pair of numbered groups a < b of a language that has kept terms."""

    def run(t: pa.Table) -> pa.Table:
        one, other = t.column("one")[0].as_py(), t.column("other")[0].as_py()
        held = []
        for idx, mass, n, ends in zip(*(t.column(c).to_pylist() for c in ("idx", "mass", "n", "ends")), strict=True):
            held.append((idx, (shares(np.array(n, dtype=np.int64), mass), np.array(ends, dtype=np.int64))))
        left, right = ([x for x in held if x[0] // tile == k] for k in (one, other))
        found = [(i, j, compare(x, y)) for i, x in left for j, y in right if i < j]
        a, b, v = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(found), pa.string()), "a": pa.array(a, pa.int32()),
                         "b": pa.array(b, pa.int32()), "value": pa.array(v, pa.int64())})

    blocks = columns.select("lang", "block", "size").distinct()
    grid = blocks.join(groups.select("lang", "idx", "mass", "n_groups"), "lang")
    grid = grid.join(columns.drop("size"), ["lang", "block", "idx"], "left")
    none = F.col("n").isNull()  # no entry of the group in the block: one run of zeros
    grid = grid.select("lang", "block", "idx", "mass", "n_groups", F.when(none, F.array(F.lit(0).cast("long"))).otherwise(F.col("n")).alias("n"),
                       F.when(none, F.array("size")).otherwise(F.col("ends")).alias("ends"))
    own = F.floor(F.col("idx") / tile).cast("int")
    tiles = F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / tile).cast("int"))
    grid = grid.withColumn("own", own).withColumn("with", F.explode(tiles))
    grid = grid.select("lang", "block", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "idx", "mass", "n", "ends")
    part = grid.groupBy("lang", "block", "one", "other").applyInArrow(run, "lang string, a int, b int, value long")
    return part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def group_terms(vocab: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the first terms of each group by how much its share exceeds the language's."""
    cells = vocab.select("lang", F.col("term").alias("item"), "total", F.explode("cells").alias("c")).select("lang", "item", "total", "c.source", "c.n")
    rows = cells.join(groups.select("lang", "source", "mass", "lang_mass"), ["lang", "source"])
    rows = rows.withColumn("value", share(F.col("n"), F.col("mass")) - share(F.col("total"), F.col("lang_mass"))).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", "item", "value", rank.alias("rank")).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources of the language, part ``term`` the first
    ``top`` terms; ranks from 1 in each group and part by value descending, then item."""
    spark = docs.sparkSession
    counts = Rounds(spark).cut(group_counts(docs))
    vocab = Rounds(spark).cut(vocabulary(counts, min_docs))
    groups = cut_lineage(group_table(counts, vocab))
    columns = Rounds(spark).cut(run_columns(vocab, groups, block))
    pairs = group_pairs(columns, groups, tile)
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda k, c: groups.select("lang", F.col("idx").alias(k), F.col("source").alias(c))
    named = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.where("n_terms = 0").select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pair = named.unionByName(zero.withColumn("value", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    term = group_terms(vocab, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.unionByName(term)
