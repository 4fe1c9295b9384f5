"""Quality rules: robust multivariate outliers (minimum covariance determinant per language and source).

DataFrame functions only. Each document gets a few counts (:func:`base_stats`) and from them a vector of transformed
statistics (:func:`vectors`). Documents of one language and source form a group. For each group the minimum
covariance determinant estimate is found by concentration steps: start from medians, keep the ``SUPPORT`` share of
documents nearest to the centre, take their mean and covariance, and repeat until the estimates of all groups stay. Every
step is two aggregates over narrow numeric rows, combined map-side, so a group of any size costs one row per task. The covariance is regularised towards
a diagonal target (as in the minimum regularised covariance determinant), since several statistics are zero for most
clean documents. A document is rejected if its squared Mahalanobis distance exceeds ``CUTOFF`` times the group's median.

Documents of a group with fewer than ``MIN_GROUP`` documents of at least ``MIN_WORDS`` words are judged by the estimate of their
whole language, and if that is smaller than ``MIN_GROUP`` too, by the estimate of all documents, however few there are: every
document that passes the base rules has a verdict.

Defined cases: a null text has no words and fails the base rule; null lang or source is a group value of its own;
repeated rows count as often as they occur and get equal verdicts; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BROADCAST_ROWS, drop_rows, small, text_key, words
from vellum.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

SUPPORT = 0.5           # share of a group that the estimate rests on: junk of one kind may fill nearly the rest
MIN_GROUP = 60          # documents for an estimate of its own
UNIT = 1000.0           # vectors are whole multiples of 1/UNIT: sums are exact in any order
SHRINK = 0.25           # weight of the diagonal target
CUTOFF = 60.0           # of the squared distance, in medians of the group
BINS = 200.0            # distance quantiles are read off logarithmic bins of this many steps a factor e

#: Standard deviations of the diagonal target, one for each statistic of :func:`vectors`.
TARGET_SD = (0.10, 0.04, 0.12, 0.12, 0.08)
DIMS = len(TARGET_SD)
X = [f"x{i}" for i in range(DIMS)]


def _window_hashes(w: Column) -> Column:
    """Hashes of the 5-word windows of an array of words, in order; none if there are fewer than two windows."""
    n = F.size(w) - WINDOW + 1
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(n >= 2, hashes).otherwise(F.array().cast("array<bigint>"))


def base_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` plus k_text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper and base_failed, one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c).alias(f"c_{c}") for c in keep]
    a = docs.select(*kept, text.alias("t"), text_key(F.col("text")).alias("k_text"))
    a = a.select("*", words(F.col("t")).alias("w"),
                 F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"))
    a = a.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        _window_hashes(F.col("w")).alias("h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper"]
    # Repeated windows: sort hashes with their positions; equal neighbours are repeats. The words they cover are the
    # sum of the gaps to the next repeated window, each at most WINDOW.
    pairs = F.array_sort(F.transform(F.col("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.select(*[c for c in a.columns if c.startswith("c_")], "k_text", *counts,
                 F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).alias("p"))
    same = lambda i, j: F.get(F.col("p"), i)["h"] == F.get(F.col("p"), j)["h"]
    at = F.array_sort(F.filter(
        F.transform(F.col("p"), lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False))
                                                    | F.coalesce(same(i, i + 1), F.lit(False)), x["i"])),
        lambda v: v.isNotNull()))
    a = a.select(*[c for c in a.columns if c != "p"], F.when(F.col("p").isNotNull(), at).alias("at"))
    gaps = F.transform(F.col("at"), lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, g: s + g), F.lit(0)).cast("long")
    a = a.select(*[c for c in a.columns if c != "at"], covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return a.select(*[F.col(f"c_{c}").alias(c) for c in keep], "k_text", *counts, "n_repeat_words", failed.alias("base_failed"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0..x4: transformed statistics in units of 1/UNIT.

    Shares are taken against a count plus a constant, so that a few words alone never make an extreme share, and
    their square roots even out the spread. Length itself is no statistic: a long document is no outlier.
    """
    c = F.col
    x = [
        F.log((c("word_chars") + 300.0) / (c("n_words") + 60.0)),
        F.sqrt(c("n_symbols") / (c("word_chars") + 300.0)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 20.0)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 100.0)),
        F.sqrt(c("n_upper") / (c("word_chars") + 300.0)),
    ]
    return stats.select("*", *[F.round(e * UNIT).alias(n) for e, n in zip(x, X, strict=True)])


def _factor(groups: DataFrame) -> DataFrame:
    """Cholesky factor l_ij of the shrunk covariance v_ij of each group, row by row."""
    for i in range(DIMS):
        for j in range(i + 1):
            shrunk = f"v{i}{j} * {1 - SHRINK}" + (f" + {(TARGET_SD[i] * UNIT) ** 2 * SHRINK}D" if i == j else "")
            v = " - ".join([shrunk, *(f"l{i}{k} * l{j}{k}" for k in range(j))])
            groups = groups.selectExpr("*", f"sqrt({v}) AS l{i}{j}" if i == j else f"({v}) / l{j}{j} AS l{i}{j}")
    return groups.select("g", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    m = [F.sum(X[i]) / n for i in range(DIMS)]
    cov = [(F.sum(F.col(X[i]) * F.col(X[j])) / n - m[i] * m[j]).alias(f"v{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return rows.groupBy("g").agg(*[e.alias(f"m{i}") for i, e in enumerate(m)], *cov)


def _whitened(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, given the columns x, m and l. One projection a step: otherwise the expressions double with each dimension."""
    for i in range(DIMS):
        s = " - ".join([f"x{i} - m{i}", *(f"l{i}{k} * z{k}" for k in range(i))])
        rows = rows.selectExpr("*", f"({s}) / l{i}{i} AS z{i}")
    return rows.selectExpr("*", " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + " AS d2")


def _distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the squared distance d2 by the group's estimate."""
    return _whitened(rows.join(groups, "g")).select(*rows.columns, "d2")


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * BINS)


def _unbin(b: Column) -> Column:
    return F.expm1((b + 1) / BINS)


def _quantile(rows: DataFrame, share: float, name: str) -> DataFrame:
    """Quantile of d2 in each group, exact to one bin; the state of the aggregate is bounded by the bins."""
    return rows.groupBy("g").agg(_unbin(F.floor(F.percentile(_bin(F.col("d2")), F.lit(share)))).alias(name))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of each group ``g`` by concentration steps over rows (g, x0..x4)."""
    rows = rows.select("g", *X)
    mid = rows.groupBy("g").agg(*[F.floor(F.percentile(X[i], F.lit(0.5))).alias(f"m{i}") for i in range(DIMS)])
    zero = [F.lit(0.0).alias(f"v{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    groups = cut_lineage(_factor(mid.select("*", *zero)))
    hint = F.broadcast if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x  # the groups stay the same
    seen = set()
    while (state := _state(groups)) not in seen:  # ends when the estimates stay, or come back to what they were
        seen.add(state)
        d = _distance(rows, hint(groups))
        near = d.join(hint(_quantile(d, SUPPORT, "edge")), "g").where("d2 <= edge")
        groups = cut_lineage(_factor(_moments(near)))
    return groups


def _state(groups: DataFrame) -> tuple:
    """A checksum of the estimates, to a thousandth of a unit."""
    return tuple(groups.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", *[F.round(c, 3) for c in groups.columns if c != "g"]))).first())


ALL = "{}"  # the group of all documents


def group_table(rows: DataFrame) -> DataFrame:
    """(lang, source, g, pools): for each language and source of ``rows`` the group whose estimate judges it, and the groups
    whose estimates its documents are part of."""
    own = F.to_json(F.struct(F.lit("s").alias("k"), F.col("lang").alias("l"), F.col("source").alias("s")))
    lang = F.to_json(F.struct(F.lit("l").alias("k"), F.col("lang").alias("l")))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n0")).select("lang", "source", "n0", own.alias("g0"), lang.alias("g1"))
    langs = sizes.groupBy("g1").agg(F.sum("n0").alias("n1"), F.min("n0").alias("least"))
    m = cut_lineage(sizes.join(langs, "g1"))
    few = F.col("n1") < MIN_GROUP
    everything = bool(m.where(few).limit(1).count())  # whether any document is judged by all
    g = F.when(F.col("n0") >= MIN_GROUP, F.col("g0")).when(~few, F.col("g1")).otherwise(F.lit(ALL))
    pools = F.array(F.when(F.col("n0") >= MIN_GROUP, F.col("g0")), F.when(~few & (F.col("least") < MIN_GROUP), F.col("g1")),
                    F.lit(ALL) if everything else F.lit(None).cast("string"))
    return m.select("lang", "source", g.alias("g"), F.filter(pools, lambda x: x.isNotNull()).alias("pools"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, lang, source, k_text, the counts, base_failed, distance (squared, in
    medians of the group; null without an estimate) and kept."""
    rows = cut_lineage(vectors(base_stats(docs, "doc_id", "lang", "source")))
    sound = rows.where(F.col("n_words") >= MIN_WORDS)
    table = small(cut_lineage(group_table(sound).select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), "g", "pools")))
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    part = cut_lineage(sound.join(table.drop("g"), same).select(F.explode("pools").alias("g"), *X))  # read by every step
    groups = estimates(part)
    cols = rows.columns
    rows = rows.join(table.drop("pools"), same, "left").select(*cols, "g")
    cols = [c for c in cols if c not in X]
    d = _distance(part, small(groups))
    groups = cut_lineage(groups.join(_quantile(d, 0.5, "mid"), "g"))
    left = _whitened(rows.join(small(groups), "g", "left"))
    # a group of near-equal documents has a median near 0: one target deviation is the least unit
    unit = F.greatest(F.col("mid"), F.lit(1.0))
    dist = F.col("d2") / unit
    out = left.select(*cols, dist.alias("distance"))
    return out.select("*", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    v = quality_verdicts(docs).where(~F.col("kept"))
    return drop_rows(docs, v.select(F.col("doc_id").alias("k_doc"), F.col("k_text")))
