"""Secret scans: patterns, and a battery of randomness tests under false-discovery control.

DataFrame functions only. Three kinds of span come from patterns (assignments, access keys, long hex runs). Further spans
come from candidates: runs of 20 or more characters that encodings use. For each candidate an encoding is inferred from
its characters, and its symbols (their places in that encoding's alphabet) go through three tests:

* chi-squared uniformity of the alphabet. The null hypothesis is "an ordinary string", whose symbols are as uneven as
  ``UNEVEN`` says; the statistic is then noncentral, with a noncentrality that grows with the length. A small value in
  its left tail speaks for random symbols, the more so the longer the string.
* runs above and below the middle of the alphabet, and
* serial correlation of neighbouring symbols: either one far from what random symbols give vetoes the candidate.

The p-values of all candidates of the corpus go through a weighted Benjamini-Hochberg procedure at ``FDR``: weights grow
with the length, since long strings carry more power, and have a mean of 1 over the candidates. Counting is by classes of
the weighted p-value, so the driver sees a bounded table (lengths by classes), never the candidates.

Scale: one pass over the texts; spans and candidates leave it in narrow rows without the text. Spans are found with one
pattern anchored to the end of the last match, so the search stays linear in the text.

Defined cases: a null or empty text has no spans; positions count code points; a candidate that overlaps a pattern's span
is left out (the pattern's stays); repeated rows count as often as they occur and get equal rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut_lineage

# The patterns of the kinds, in the order in which equal starts are listed, and the least lengths.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"      # at least 20 characters; longer runs are taken whole
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
FDR = 0.01
VETO = 3.5               # standard deviations of the runs and serial tests
CLASS_STEPS = 20.0       # classes of -log10 p for each factor of ten
MAX_CLASS = 400
LENGTH_CLASSES = 6       # 20-31, 32-47, 48-63, 64-127, 128-255, 256 and more

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by the first pattern that holds: name, pattern, alphabet.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base64", r"", UPPER + LOWER + DIGITS + "+/"),
)
#: Unevenness of ordinary strings in an encoding: size of the alphabet times the sum of squared shares, less 1.
UNEVEN = {"decimal": 1.5, "hex": 2.0, "base32": 1.5, "base36": 1.6, "base64": 2.5}


def _matches(text: Column, pattern: str, inner: int | None = None) -> Column:
    """Array of (gap, hit, n) of the leftmost non-overlapping matches: the lengths of what stands before each since the last one,
    of the match, and of group ``inner`` of the pattern (or the match). None where a plain search finds nothing."""
    whole = rf"\G(?s:(.*?))({pattern})"
    part = lambda g: F.regexp_extract_all(text, F.lit(whole), F.lit(g))
    zipped = F.arrays_zip(part(1).alias("gap"), part(2).alias("hit"), part(2 if inner is None else 2 + inner).alias("own"))
    lens = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), F.length(z["own"]).alias("n")))
    return F.when(text.rlike(pattern), lens).otherwise(F.array().cast("array<struct<gap:int,hit:int,n:int>>"))


CHUNK = 128  # matches that are added up one by one


def _running(lens: Column) -> Column:
    """(start, end, n) of matches from their (gap, hit, n), a column (an expression would be computed for each chunk). An array that grows in a fold is copied at every step, so matches are
    added up in chunks, and the chunks' lengths before that."""
    span = "array<struct<start:int,end:int,n:int>>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / CHUNK).cast("int")), lambda i: F.slice(lens, i * CHUNK + 1, CHUNK))
    length = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["hit"])
    before = F.aggregate(F.transform(chunks, length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                         lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["hit"]).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["hit"]).alias("end"), x["n"].alias("n")))).alias("out"))
    spans = F.zip_with(chunks, before, lambda c, at: F.aggregate(
        c, F.struct(at.alias("at"), F.array().cast(span).alias("out")), step, lambda s: s["out"]))
    return F.when(F.size(lens) > 0, F.flatten(spans)).otherwise(F.array().cast(span))


def scan(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, assign, access, hex, cands): spans by kind and candidates with their strings, for each row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", t.alias("t"))
    c = F.col("t")
    rows = rows.select("rid", "doc_id", "t", _matches(c, ASSIGN, 1).alias("m_assign"), _matches(c, ACCESS).alias("m_access"),
                       _matches(c, HEX).alias("m_hex"), _matches(c, CANDIDATE).alias("m_found"))
    rows = rows.select(
        "rid", "doc_id", "t", F.filter(_running(F.col("m_assign")), lambda x: x["n"] >= ASSIGN_CHARS).alias("assign"),
        _running(F.col("m_access")).alias("access"), _running(F.col("m_hex")).alias("hex"), _running(F.col("m_found")).alias("found"))
    cands = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                   F.substring(F.col("t"), x["start"] + 1, x["n"]).alias("s")))
    return rows.select("rid", "doc_id", "assign", "access", "hex", cands.alias("cands"))


def free_candidates(scanned: DataFrame) -> DataFrame:
    """(rid, start, end, s): candidates that overlap no pattern's span."""
    none = F.lit(None).cast("string")
    base = F.concat("assign", "access", "hex")
    spans = F.concat(
        F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), none.alias("s"), F.lit(True).alias("base"))),
        F.transform("cands", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), F.lit(False).alias("base"))))
    rows = scanned.where(F.size("cands") > 0).select("rid", F.explode(spans).alias("x")).select("rid", "x.*")
    w = Window.partitionBy("rid").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("before", before).withColumn("after", after).where(~F.col("base"))
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return rows.where(clear).select("rid", "start", "end", "s")


def _tail(z: Column) -> Column:
    """Left tail of the normal distribution (polynomial approximation, absolute error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    right = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z < 0, right).otherwise(1 - right)


def _by_encoding(f) -> Column:
    """The value of ``f(name, alphabet)`` for the row's encoding."""
    out = None
    for name, _, alphabet in ENCODINGS:
        hit = F.col("encoding") == name
        out = F.when(hit, f(name, alphabet)) if out is None else out.when(hit, f(name, alphabet))
    return out


def test_battery(cands: DataFrame) -> DataFrame:
    """Adds encoding, n, chi2, z_runs, z_serial and p to rows with a string ``s``."""
    enc = None
    for name, pattern, _ in ENCODINGS[:-1]:
        hit = F.col("s").rlike(pattern)
        enc = F.when(hit, name) if enc is None else enc.when(hit, name)
    rows = cands.withColumn("encoding", enc.otherwise(ENCODINGS[-1][0]))
    # symbols: padding dropped, one alphabet for both variants of base64, lower case where case carries nothing
    plain = F.regexp_replace(F.translate("s", "-_", "+/"), "=", "")
    sym = F.when(F.col("encoding").isin("hex", "base36"), F.lower("s")).otherwise(plain)
    rows = rows.withColumn("sym", sym).withColumn("n", F.length("sym")).where("n > 1")
    counts = lambda a: F.transform(F.array(*[F.lit(ch) for ch in a]),
                                   lambda ch: F.col("n") - F.length(F.replace(F.col("sym"), ch, F.lit(""))))
    squares = F.aggregate(_by_encoding(lambda _, a: counts(a)), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    k = _by_encoding(lambda _, a: F.lit(float(len(a))))
    uneven = _by_encoding(lambda name, _: F.lit(UNEVEN[name]))
    values = F.transform(F.split("sym", ""), lambda ch: _by_encoding(lambda _, a: F.instr(F.lit(a), ch)).cast("double"))
    bits = _by_encoding(lambda _, a: F.translate("sym", a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)))
    rows = rows.select("*", k.alias("k"), uneven.alias("uneven"), squares.alias("squares"), values.alias("v"), bits.alias("bits"))
    n = F.col("n").cast("double")
    chi2 = F.col("k") / n * F.col("squares") - n
    ones = F.length(F.replace(F.col("bits"), F.lit("0"), F.lit(""))).cast("double")
    runs = F.length(F.regexp_replace("bits", "0+|1+", "x")).cast("double")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("*", chi2.alias("chi2"), ones.alias("ones"), runs.alias("runs"), (total / n).alias("mean"))
    mean = 2 * F.col("ones") * (n - F.col("ones")) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(var > 0, (F.col("runs") - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(99.0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    cross = F.aggregate(F.zip_with(F.slice("v", 1, F.col("n") - 1), F.slice("v", 2, F.col("n") - 1),
                                   lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("*", z_runs.alias("z_runs"), square.alias("square"), cross.alias("cross"))
    z_serial = F.when(F.col("square") > 0, F.col("cross") / F.greatest(F.col("square"), F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(99.0))
    rows = rows.withColumn("z_serial", z_serial)
    shift = n * F.col("uneven")
    z = (F.col("chi2") - (F.col("k") - 1) - shift) / F.sqrt(2 * (F.col("k") - 1) + 4 * shift)
    sound = (F.abs("z_runs") <= VETO) & (F.abs("z_serial") <= VETO)
    rows = rows.withColumn("p", F.when(sound, _tail(z)).otherwise(F.lit(1.0)))
    return rows.select(*cands.columns, "encoding", "n", "chi2", "z_runs", "z_serial", "p")


def _length_class(n: Column) -> Column:
    return (F.when(n >= 256, 6).when(n >= 128, 5).when(n >= 64, 4).when(n >= 48, 3).when(n >= 32, 2).otherwise(1))


def _p_class(p: Column) -> Column:
    """Class of -log10 p, rounded down: a class stands for its greatest p."""
    return F.least(F.lit(MAX_CLASS), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * CLASS_STEPS))).cast("int")


def discoveries(tested: DataFrame) -> DataFrame:
    """Rows that the weighted Benjamini-Hochberg procedure takes as random."""
    # raw weights by length class; their mean over all candidates is brought to 1
    sizes = {r["c"]: r["n"] for r in tested.groupBy(_length_class(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    m = sum(sizes.values())
    if not m:
        return tested.limit(0)
    mean = sum(c * n for c, n in sizes.items()) / m
    weighted = F.least(F.lit(1.0), F.col("p") * mean / _length_class(F.col("n")))
    rows = tested.withColumn("class", _p_class(weighted))
    counts = sorted(((r["class"], r["n"]) for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, seen = MAX_CLASS + 1, 0
    for c, n in counts:  # the lowest class (greatest p) that still holds; the first class's p bounds its members
        seen += n
        if m * 10 ** (-c / CLASS_STEPS) <= FDR * seen:
            least = c
    return rows.where(F.col("class") >= least).drop("class")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random), one row for each input row: arrays of spans; those of ``random`` are
    (start, end, encoding)."""
    scanned = cut_lineage(scan(docs))
    tested = cut_lineage(test_battery(free_candidates(scanned)))
    found = discoveries(tested).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "encoding"))).alias("random"))
    out = scanned.select("rid", "doc_id", "assign", "access", "hex").join(found, "rid", "left")
    return out.select("doc_id", "assign", "access", "hex", F.coalesce("random", F.array().cast("array<struct<start:int,end:int,encoding:string>>")).alias("random"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, of an array of (start, rank, end, kind)."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def random_tagged() -> Column:
    return F.transform("random", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"),
                                                    F.concat(F.lit("random_"), x["encoding"]).alias("kind")))
