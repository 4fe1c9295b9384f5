"""Structural fingerprints of tree-shaped content.

A fingerprint node is ``(weight, hash)``: weight = 1 + sum of child weights, hash = digest of the node kind
and the ordered child hashes (children of commutative nodes are ordered by (weight, hash) descending first).
Identifier names and literal values never enter a hash, only the node kinds.
After hashing, subtrees with weight <= 3 are trimmed (hashes keep their pre-trim values) and weights are
recomputed over the kept nodes.

Two forms:

* :func:`document_prints` - documents as fixed-depth trees (root -> line -> sentence -> word). Every step
  is a higher-order-function expression inside the document's own row: no shuffle at all.
* :func:`node_table_prints` - any tree given as a node table ``(doc_id, section, node_id, parent_id, depth,
  ord, kind, commutative)``; trees are folded whole, very large ones contracted in rounds that grow with the logarithm of
  their nodes (:mod:`vellum.operators.trees`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.arrays import explode_rows
from vellum.operators.trees import bottom_up

# ---------------------------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------------------------
TRIM_WEIGHT = 3  # subtrees with weight <= 3 are dropped after hashing
SENTENCE_GAP = r"(?<=[.!?])\s+"  # a sentence ends after . ! or ? followed by white space
WORD_SPLIT = r"\s+"

# Kinds of the document tree; a node hashes "<kind>:<child hashes joined by ','>" (a word's kind is the
# lower-cased word itself), the same text :func:`node_table_prints` hashes for :func:`document_nodes`.
KIND_SENTENCE, KIND_LINE, KIND_ROOT = "sentence:", "line:", "root:"


def _digest(text: Column) -> Column:
    """Digest of a node: all 128 bits, since equal digests are taken as equal subtrees across the whole corpus."""
    return F.md5(text)


def _words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, WORD_SPLIT, -1), lambda w: w != "")


def _sentences(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, SENTENCE_GAP, -1), _words), lambda ws: F.size(ws) > 0)


def document_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """P1-P6 for documents, one row per document:

    ``doc_id, root_hash, weight`` (untrimmed), ``total`` (kept nodes below the root = trimmed root weight - 1),
    ``lines``: kept lines as ``array<struct<h, w, sents: array<string>>>`` where ``w`` is the recomputed
    weight (1 + kept sentences) and ``sents`` the hashes of the kept sentences.

    Words are leaves (kind = lower-cased token), sentences and lines keep child order, the root is
    commutative (line order does not matter). ``keep``: input columns passed through unchanged.
    """
    keep = list(keep)
    text = F.col(text_col)
    # Stage 1: split into lines -> sentences -> words (array<array<array<string>>>).
    s1 = docs.select(F.col(id_col).alias("doc_id"), *keep, F.transform(F.split(text, "\n", -1), _sentences).alias("t"))
    # Stage 2: sentence prints (hash, weight) per line.
    s2 = s1.select(
        "doc_id",
        *keep,
        F.transform(
            "t",
            lambda line: F.transform(
                line,
                lambda ws: F.struct(
                    _digest(
                        F.concat(
                            F.lit(KIND_SENTENCE),
                            F.array_join(
                                F.transform(ws, lambda w: _digest(F.concat(F.lower(w), F.lit(":")))), ","
                            ),
                        )
                    ).alias("h"),
                    (F.size(ws) + 1).alias("w"),
                ),
            ),
        ).alias("t"),
    )
    # Stage 3: line prints.
    s3 = s2.select(
        "doc_id",
        *keep,
        F.transform(
            "t",
            lambda sents: F.struct(
                _digest(F.concat(F.lit(KIND_LINE), F.array_join(F.transform(sents, lambda s: s["h"]), ","))).alias(
                    "h"
                ),
                (F.aggregate(sents, F.lit(0), lambda acc, s: acc + s["w"]) + 1).alias("w0"),
                F.transform(F.filter(sents, lambda s: s["w"] > TRIM_WEIGHT), lambda s: s["h"]).alias("sents"),
            ),
        ).alias("t"),
    )
    # Stage 4: root print (commutative: children ordered by (weight, hash) descending) and trimmed lines.
    ordered = F.reverse(F.array_sort(F.transform("t", lambda ln: F.struct(ln["w0"].alias("w"), ln["h"].alias("h")))))
    kept = F.filter("t", lambda ln: ln["w0"] > TRIM_WEIGHT)
    s4 = s3.select(
        "doc_id",
        *keep,
        _digest(F.concat(F.lit(KIND_ROOT), F.array_join(F.transform(ordered, lambda x: x["h"]), ","))).alias(
            "root_hash"
        ),
        (F.aggregate("t", F.lit(0), lambda acc, ln: acc + ln["w0"]) + 1).cast("bigint").alias("weight"),
        F.transform(
            kept,
            lambda ln: F.struct(ln["h"].alias("h"), (F.size(ln["sents"]) + 1).alias("w"), ln["sents"].alias("sents")),
        ).alias("lines"),
    )
    return s4.withColumn("total", F.aggregate("lines", F.lit(0), lambda acc, ln: acc + ln["w"]).cast("bigint"))


def print_tokens(prints: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Kept nodes of every document as ``(doc_id, level, h, cnt, w, *carry)`` (level 1 = line, 2 = sentence),
    one row per distinct hash per document with its multiplicity ``cnt`` and recomputed weight ``w``.
    ``carry``: per-document columns kept on every row (grouped with the document id, no join needed later).

    One pass: every kept line yields itself and its kept sentences as tokens, then one aggregate."""
    keys = ["doc_id", *carry]
    per_doc = F.flatten(
        F.transform(
            "lines",
            lambda ln: F.concat(
                F.array(F.struct(F.lit(1).alias("level"), ln["h"].alias("h"), ln["w"].alias("w"))),
                F.transform(ln["sents"], lambda sh: F.struct(F.lit(2).alias("level"), sh.alias("h"), F.lit(1).alias("w"))),
            ),
        )
    )
    toks = explode_rows(prints, per_doc, "t", *keys)
    return toks.groupBy(*keys, F.col("t.level").alias("level"), F.col("t.h").alias("h")).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("t.w").cast("int").alias("w")
    ).select("doc_id", "level", "h", "cnt", "w", *carry)


def line_children(prints: DataFrame) -> DataFrame:
    """For every kept line hash: its kept sentence hashes with multiplicity ``(lh, sh, k)``.

    A line hash determines its subtree, so any one occurrence gives the children: one aggregate per line hash
    (``first``, combined map-side, so a line repeated in a third of the corpus is one row early), then the
    multiplicities are counted inside that row."""
    lines = explode_rows(prints, F.col("lines"), "ln").select(F.col("ln.h").alias("lh"), F.col("ln.sents").alias("sents"))
    per = lines.groupBy("lh").agg(F.first("sents").alias("sents"))
    counted = F.transform(
        F.array_distinct("sents"),
        lambda sh: F.struct(sh.alias("sh"), F.size(F.filter("sents", lambda x: x == sh)).cast("bigint").alias("k")),
    )
    return explode_rows(per, counted, "c", "lh").select("lh", F.col("c.sh").alias("sh"), F.col("c.k").alias("k"))


def count_hash(prints: DataFrame, h: str) -> DataFrame:
    """Per document, the number of kept nodes whose hash is ``h``."""
    toks = print_tokens(prints)
    return toks.where(F.col("h") == F.lit(h)).groupBy("doc_id").agg(F.sum("cnt").cast("bigint").alias("n"))


# ------------------------------------------------------------------------------------------------------------
# Generic node tables
# ------------------------------------------------------------------------------------------------------------
def node_table_prints(nodes: DataFrame, together: bool = False) -> DataFrame:
    """P4-P6 on a node table, bottom-up.

    Input columns: ``doc_id, section, node_id, parent_id, depth, ord, kind, commutative``.
    Output: the input plus ``weight`` (untrimmed), ``hash``, ``kept`` and ``tweight`` (weight after trim;
    null for trimmed nodes). A node's children are ordered by ``ord``, or by (weight, hash) descending when
    the node is commutative (T4). One shuffle for trees of usual size; see :mod:`vellum.operators.trees`. ``together``: none, if the
    nodes come from :func:`document_nodes` and the result is read once.
    """
    out = bottom_up(nodes, TRIM_WEIGHT, together=together)
    kept = (F.col("weight") > TRIM_WEIGHT) | F.col("parent_id").isNull()  # the root always stays
    return out.withColumn("kept", kept).withColumn("tweight", F.when(F.col("kept"), F.col("tweight")))


def subtree_weights(nodes: DataFrame) -> DataFrame:
    """Subtree weight of every node (1 + sum of child weights)."""
    return node_table_prints(nodes).select("doc_id", "section", "node_id", "weight")


def occurrence_rank(prints_nodes: DataFrame) -> DataFrame:
    """K-th occurrence of a hash within (doc, section), for 1:1 matching by rank.

    The window partition is one hash within one document, so it is bounded by the document size.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "section", "hash").orderBy("node_id")
    return prints_nodes.withColumn("occurrence", F.row_number().over(w))


def numbered_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lines, sents, words)``, a row for each document: its lines (arrays of sentences), its sentences
    ``struct<li, si, words>`` and its words ``struct<gi, li, si, wi, word>``, the latter two numbered through the document by
    their places; li, si, wi count within what is above, gi is the sentence's place."""
    lines = F.transform(F.split(F.col(text_col), "\n", -1), _sentences)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(lines, F.array().cast("array<array<array<string>>>")).alias("lines"))
    sents = F.flatten(F.transform("lines", lambda line, li: F.transform(
        line, lambda words, si: F.struct(li.alias("li"), si.alias("si"), words.alias("words")))))
    words = F.flatten(F.transform("sents", lambda s, gi: F.transform(s["words"], lambda w, wi: F.struct(
        gi.alias("gi"), s["li"].alias("li"), s["si"].alias("si"), wi.alias("wi"), w.alias("word")))))
    return base.select("doc_id", "lines", sents.alias("sents")).select("doc_id", "lines", "sents", words.alias("words"))


def node_number(place: Column, kind: int) -> Column:
    """Node id of the line (kind 1), sentence (2) or word (3) at a place of its document."""
    return place.cast("bigint") * 4 + kind


def document_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as a generic node table (section 'text'): root (depth 0) -> line -> sentence -> word.

    node ids are unique within a document whatever its size: the root is 0, and lines, sentences and words are numbered
    through the whole document, four apart, from 1, 2 and 3. Every text is split once; all its nodes come from one row.
    """
    def node(id_: Column, parent: Column, depth: int, ord_: Column, kind: Column, commutative: bool = False) -> Column:
        return F.struct(id_.cast("bigint").alias("node_id"), parent.cast("bigint").alias("parent_id"), F.lit(depth).alias("depth"),
                        ord_.cast("int").alias("ord"), kind.alias("kind"), F.lit(commutative).alias("commutative"))

    root = F.array(node(F.lit(0), F.lit(None), 0, F.lit(0), F.lit("root"), True))
    lines = F.transform("lines", lambda _, li: node(node_number(li, 1), F.lit(0), 1, li, F.lit("line")))
    sents = F.transform("sents", lambda s, gi: node(node_number(gi, 2), node_number(s["li"], 1), 2, s["si"], F.lit("sentence")))
    words = F.transform("words", lambda w, gw: node(node_number(gw, 3), node_number(w["gi"], 2), 3, w["wi"], F.lower(w["word"])))
    rows = explode_rows(numbered_words(docs, id_col, text_col), F.concat(root, lines, sents, words), "n", "doc_id")
    return rows.select("doc_id", F.lit("text").alias("section"), "n.*")
