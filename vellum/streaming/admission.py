"""Admission of new items: accept an item only if no similar item was accepted before it (K1-K7, P11, U-1).

The reference drains a queue one item at a time. Sequential meaning, computed in parallel (K3):
build the similarity edges (earlier -> later) once, then repeat until every item is decided
(:func:`greedy_admission`). Rounds carry undecided items and the edges between them alone, chains of similar items are
contracted, and the outcome equals the one-by-one loop. The tables of a round are written to the shared checkpoint folder.

Exact structural copies that agree in everything a decision looks at (blocking keys, size, rule and, where results
count, the outcomes in every back end) never become edges: within such a group only the earliest member can be accepted
(all later ones are similar to whatever the earliest is similar to), so they are decided up front. Copies that differ
in any of these are compared like other items, and a tree without kept nodes is similar to nothing.

Streaming: ``readStream`` over a submissions folder -> ``foreachBatch``; each batch is compared with the
corpus stored by *earlier* batches only, and its outputs are written to ``batch_id=<n>`` folders with
overwrite, so a replayed batch rewrites the same result.
"""

from __future__ import annotations

import multiprocessing
import os
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.scalars import loc as loc_expr
from vellum.operators import similarity as SIM
from vellum.operators.fingerprint import document_prints
from vellum.session import Rounds, cut_lineage


# ------------------------------------------------------------------------------------------------
# K1 / K2: accepting and converting submissions
# ------------------------------------------------------------------------------------------------
def accept_submissions(raw: DataFrame, stamp: Column | None = None) -> DataFrame:
    """K1: stamp the arrival time and compute LOC (C1) for raw submissions ``(submission_id, program, ...)``."""
    stamp = F.current_timestamp().cast("timestamp_ntz") if stamp is None else stamp
    return raw.withColumn("submission_date", stamp).withColumn("loc", loc_expr("program"))


def queue_to_entities(queue: DataFrame, existing_entities: DataFrame, stamp: Column | None = None) -> DataFrame:
    """K2: queued submissions, oldest first (date, id), become entities with new dense ids after the
    largest existing id (S6); the accepted row gets a new time stamp (Q13), LOC is copied."""
    from vellum.operators.maintenance import with_new_ids

    stamp = F.current_timestamp().cast("timestamp_ntz") if stamp is None else stamp
    numbered = with_new_ids(existing_entities, queue, "entity_id", ["submission_date", "submission_id"])
    return numbered.withColumn("accepted_date", stamp)


# ------------------------------------------------------------------------------------------------
# K3: greedy sequential admission
# ------------------------------------------------------------------------------------------------
def similarity_edges(prints: DataFrame | SIM.PrintSet, threshold: float = SIM.DIRECT_MATCH_THRESHOLD,
                     block: list[str] | None = None, band: tuple[float, float] | None = None,
                     extra: Callable[[DataFrame], DataFrame] | None = None, direct: str | None = None) -> DataFrame:
    """Edges ``(e, l)``: earlier item ``e`` (smaller id = earlier arrival) is similar to later item ``l``.

    ``extra`` may further filter the scored pairs (K5: results of both back ends must agree too). ``direct``: docs
    column that says whether an item comes straight from a verifier; the later item's value picks the rule (P9).
    """
    ps, _ = SIM.with_shared(SIM.prepare(prints), block=block)
    cand = SIM.candidate_pairs(ps, threshold, block, band, rule="direct" if direct is None else "any")
    scored = _decided(SIM.matched_weight(cand, ps), ps, "b_id", threshold, direct)
    if extra is not None:
        scored = extra(scored)
    # Materialised once: every greedy round reads the edges again.
    return cut_lineage(scored.select(F.col("a_id").alias("e"), F.col("b_id").alias("l")))


def _decided(scored: DataFrame, ps: SIM.PrintSet, side: str, threshold: float, direct: str | None) -> DataFrame:
    """Pairs that match, by the rule of the newer item (``side``: the pair's column that names it)."""
    if direct is None:
        return SIM.with_decision(scored, threshold).where("is_match")
    rule = ps.docs.select(F.col("doc_id").alias(side), F.col(direct).alias("_direct"))
    return SIM.with_decision(scored.join(rule, side), threshold, F.col("_direct")).where("is_match").drop("_direct")


def greedy_admission(items: DataFrame, edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``(doc_id, accepted)`` for ``items`` given edges (earlier, later). ``stored`` items count as accepted.

    Only undecided items and the edges between them are carried from round to round. An edge is a literal: its earlier item
    (parity 0) or the opposite of it (parity 1); an item is accepted iff none of its literals holds. In a round

    * an item without literals is accepted, one with both literals of an item is rejected (one of them holds);
    * an item with one literal left is its opposite: it is contracted, so a chain goes in one round, its ends found by
      doubling, and the literals that name it name the end of the chain instead;
    * literals of decided items are put in: one that holds rejects its item, others are dropped.

    Contracted items get their decisions from the ends of their chains when all rounds are done.
    """
    spark = items.sparkSession
    rounds, links = Rounds(spark), Rounds(spark)
    nodes = edges.select(F.explode(F.array("e", "l")).alias("node")).distinct().withColumn("forced", F.lit(None).cast("int"))
    if stored is not None:
        held = stored.select(F.col("doc_id").alias("node"), F.lit(1).alias("fixed"))
        nodes = nodes.join(held, "node", "left").select("node", F.col("fixed").alias("forced"))
        edges = edges.join(held.select(F.col("node").alias("l")), "l", "left_anti").select("e", "l")
    nodes, live = rounds.cut(nodes), links.cut(edges.select("e", F.lit(0).alias("par"), "l").distinct())
    decided: list[DataFrame] = []
    contracted: list[DataFrame] = []
    while not nodes.isEmpty():
        done, waits, nodes, live = _admission_round(nodes, live, rounds, links)
        decided.append(done)
        contracted.append(waits)
    known = items.select(F.col("doc_id").alias("node"), F.lit(1).alias("s")).limit(0) if not decided else decided[-1]
    for done, waits in zip(decided[-2::-1], contracted[-2::-1], strict=True):
        # the ends of a round's open chains were decided in later rounds
        later = waits.join(known.select(F.col("node").alias("root"), "s"), "root").select("node", F.col("s").bitwiseXOR(F.col("q")).alias("s"))
        known = cut_lineage(known.unionByName(done).unionByName(later))
    out = items.join(known, F.col("doc_id") == F.col("node"), "left")  # an item without edges is like no other
    return out.select("doc_id", (F.coalesce("s", F.lit(1)) == 1).alias("accepted"))


def _admission_round(nodes: DataFrame, live: DataFrame, rounds: Rounds, links: Rounds) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over undecided ``nodes`` (node, forced: a decision to come into force) and ``live`` literals (e, par, l):
    decisions (node, s), items contracted to ends that are open (node, root, q: s = s of root XOR q), and what is left."""
    per = live.groupBy("l", "e").agg(F.min("par").alias("lo"), F.max("par").alias("hi")).groupBy(F.col("l").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("lo") < F.col("hi")).alias("both"), F.min("e").alias("e"), F.min("lo").alias("par"))
    j = nodes.join(per, "node", "left")
    s = F.when(F.col("forced").isNotNull(), F.col("forced")).when(F.col("n").isNull(), F.lit(1)).when(F.col("both"), F.lit(0))
    one = s.isNull() & (F.col("n") == 1)
    state = cut_lineage(j.select("node", s.alias("s"), F.when(one, F.col("e")).alias("root"), F.when(one, F.lit(1).bitwiseXOR(F.col("par"))).alias("q")))
    ptr, hops, open_ = state.where("root IS NOT NULL").select("node", "root", "q"), Rounds(nodes.sparkSession), True
    while open_:
        ahead = ptr.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("q").alias("more"))
        ptr = hops.cut(ptr.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"),
                                                              F.col("q").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("q"), F.col("next").isNotNull().alias("moved")))
        open_ = not ptr.where("moved").isEmpty()
        ptr = ptr.drop("moved")
    fixed = state.where("s IS NOT NULL").select("node", "s")
    ends = ptr.join(fixed.select(F.col("node").alias("root"), "s"), "root", "left")
    ends = cut_lineage(ends.select("node", "root", "q", F.col("s").bitwiseXOR(F.col("q")).alias("s")))
    done = fixed.unionByName(ends.where("s IS NOT NULL").select("node", "s"))
    waits = ends.where("s IS NULL").select("node", "root", "q")
    value = done.select(F.col("node").alias("e"), "s", F.lit(None).cast(dict(waits.dtypes)["root"]).alias("root"), F.lit(0).alias("q"))
    value = value.unionByName(waits.select(F.col("node").alias("e"), F.lit(None).cast("int").alias("s"), "root", "q"))
    waiting = state.where("s IS NULL AND root IS NULL").select("node")
    lits = live.join(waiting.select(F.col("node").alias("l")), "l", "left_semi").join(value, "e", "left")
    lits = cut_lineage(lits.select(F.coalesce("root", "e").alias("e"), F.col("par").bitwiseXOR(F.coalesce("q", F.lit(0))).alias("par"), "l",
                                   F.col("s").bitwiseXOR(F.col("par")).alias("holds")))
    hit = lits.where("holds = 1").select(F.col("l").alias("node"), F.lit(0).alias("forced")).distinct()
    left = rounds.cut(waiting.join(hit, "node", "left"))
    live = links.cut(lits.where("holds IS NULL").select("e", "par", "l").distinct().join(hit.select(F.col("node").alias("l")), "l", "left_anti").select("e", "par", "l"))
    return done, waits, left, live


def _union_sets(a: SIM.PrintSet | None, b: SIM.PrintSet) -> SIM.PrintSet:
    if a is None:
        return b
    if a.packed is not None and b.packed is not None:
        return replace(SIM.from_packed(a.packed.unionByName(b.packed)), docs=a.docs.unionByName(b.docs))
    return SIM.PrintSet(
        a.docs.unionByName(b.docs), a.sections.unionByName(b.sections), a.tokens.unionByName(b.tokens),
        a.kids.unionByName(b.kids).distinct(),
    )


def admit(batch_prints: DataFrame | SIM.PrintSet, stored_prints: DataFrame | SIM.PrintSet | None = None,
          threshold: float = SIM.DIRECT_MATCH_THRESHOLD, block: list[str] | None = None,
          band: tuple[float, float] | None = None, extra: Callable[[DataFrame], DataFrame] | None = None,
          chunk_rows: int | None = None, direct: str | None = None) -> DataFrame:
    """K3/K4/K5: ``(doc_id, accepted)`` for a batch (ids in arrival order, all after the stored ones).

    K4 = print similarity only (``block``/``band`` from J5); K5 = with ``extra`` result checks (P10), which may have a
    method ``key`` for (doc_id, result_key): equal non-null keys mean results that agree. ``direct``: see
    :func:`similarity_edges`.
    The stored corpus is only probed (two-sided candidates batch x corpus), never re-fingerprinted; items
    with an accepted similar stored item are rejected before any pairing inside the batch, and only the
    survivors are paired with each other.

    ``chunk_rows``: admit the batch in arrival-ordered chunks of about this many rows, each against everything
    accepted before it. Accepted items are pairwise dissimilar, so a near-copy meets only its leader; pairs
    inside one chunk are bounded by the chunk, which bounds the work of a huge near-copy cluster by
    ``N * chunk_rows`` instead of ``N**2``. The result is identical for every chunk size.
    """
    b = SIM.prepare(batch_prints)
    c = None if stored_prints is None else SIM.prepare(stored_prints)
    if chunk_rows is None:
        return _admit_one(b, c, threshold, block or [], band, extra, direct)
    from vellum.operators.sequences import dense_ids

    seq = dense_ids(b.docs.select("doc_id"), ["doc_id"], out="_seq")
    chunked = cut_lineage(seq.select("doc_id", ((F.col("_seq") - 1) / F.lit(chunk_rows)).cast("bigint").alias("chunk")))
    n_chunks = int(chunked.agg(F.max("chunk")).first()[0] or 0) + 1
    decided_parts: list[DataFrame] = []
    accepted = c
    for k in range(n_chunks):
        part = SIM.subset(b, chunked.where(F.col("chunk") == k))
        dec = cut_lineage(_admit_one(part, accepted, threshold, block or [], band, extra, direct))
        decided_parts.append(dec)
        accepted = _union_sets(accepted, SIM.subset(b, dec.where("accepted")))
    out = decided_parts[0]
    for d in decided_parts[1:]:
        out = out.unionByName(d)
    return out


def _copy_key(ps: SIM.PrintSet, block: list[str], band: tuple[float, float] | None,
              extra: Callable[[DataFrame], DataFrame] | None, direct: str | None) -> tuple[SIM.PrintSet, list[str]]:
    """The print set and the docs columns in which copies must agree to be decided together."""
    keys = [*block, *(["loc"] if band and "loc" not in block else []), *([direct] if direct and direct not in block else [])]
    if extra is None:
        return ps, keys
    ps, more = with_result_key(ps, extra)
    return ps, [*keys, *more]


def with_result_key(ps: SIM.PrintSet, results: Callable[[DataFrame], DataFrame]) -> tuple[SIM.PrintSet, list[str]]:
    """The print set with the docs column ``result_key`` of a result filter: equal keys mean results that agree."""
    keys = results.key().select(F.col("doc_id").alias("_r"), "result_key")
    # without results in every back end an item is similar to nothing: its id keeps it alone
    docs = ps.docs.join(keys, F.col("doc_id") == F.col("_r"), "left").select(
        *ps.docs.columns, F.coalesce("result_key", F.concat(F.lit("alone:"), F.col("doc_id").cast("string"))).alias("result_key"))
    return replace(ps, docs=cut_lineage(docs)), ["result_key"]


def _admit_one(b: SIM.PrintSet, c: SIM.PrintSet | None, threshold: float, block: list[str],
               band: tuple[float, float] | None, extra: Callable[[DataFrame], DataFrame] | None,
               direct: str | None = None) -> DataFrame:
    b, keys = _copy_key(b, block, band, extra, direct)
    groups = cut_lineage(SIM.copy_groups(b, keys))
    rejected = groups.where(F.col("doc_id") != F.col("rep_id")).select("doc_id")
    rep_ids = cut_lineage(groups.where(F.col("doc_id") == F.col("rep_id")).select("doc_id"))
    if c is not None:
        # a similar accepted stored item rejects an item whatever happens inside the batch
        reps, c = SIM.with_shared(SIM.subset(b, rep_ids), c, block)
        cand = SIM.candidate_pairs(reps, threshold, block, band, other=c, rule="direct" if direct is None else "any")
        scored = _decided(SIM.matched_weight(cand, reps, c), reps, "a_id", threshold, direct)
        if extra is not None:
            scored = extra(scored)
        hit = cut_lineage(scored.select(F.col("a_id").alias("doc_id")).distinct())
        # copies go with their representative: it is rejected, or they are copies of an accepted item
        rejected = rejected.unionByName(hit)
        rep_ids = cut_lineage(rep_ids.join(hit, "doc_id", "left_anti"))
    survivors = SIM.subset(b, rep_ids)
    edges = similarity_edges(survivors, threshold, block, band, extra, direct)
    decided = greedy_admission(rep_ids, edges)
    return decided.unionByName(rejected.select("doc_id", F.lit(False).alias("accepted")))


def sequential_admission_reference(ids: list[int], edges: set[tuple[int, int]]) -> dict[int, bool]:
    """Plain one-by-one loop (for tests): accept an item iff no similar already-accepted item exists."""
    accepted: list[int] = []
    out = {}
    for x in sorted(ids):
        ok = not any((a, x) in edges or (x, a) in edges for a in accepted)
        out[x] = ok
        if ok:
            accepted.append(x)
    return out


# ------------------------------------------------------------------------------------------------
# U-1: pluggable evaluator
# ------------------------------------------------------------------------------------------------
RESULT_SCHEMA = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("backend", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("did_timeout", T.BooleanType()),
    T.StructField("runtime", T.LongType()),
    T.StructField("error_ids", T.ArrayType(T.StringType())),
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
])


class _Evaluator:
    """A process of its own for the evaluator, forked from the task's, that can be ended while it works on a row."""

    def __init__(self, evaluator: Callable[[dict, list[str], int], dict]):
        self._evaluator, self._process = evaluator, None

    @staticmethod
    def _serve(evaluator, mine, theirs) -> None:
        theirs.close()  # otherwise the end of the task would not be seen here
        try:
            while True:
                rec, args, limit = mine.recv()
                try:
                    r = evaluator(rec, args, limit)
                    answer = (bool(r["success"]), bool(r.get("did_timeout", False)), int(r.get("runtime", 0)), list(r.get("error_ids", [])),
                              {str(k): str(v) for k, v in r.get("features", {}).items()})
                except Exception as exc:  # captured as data
                    answer = (False, False, 0, [f"evaluator:{type(exc).__name__}"], {})
                mine.send(answer)
        finally:
            os._exit(0)

    def __call__(self, rec: dict, args: list[str], limit: int) -> tuple:
        if self._process is None:
            fork = multiprocessing.get_context("fork")
            self._pipe, theirs = fork.Pipe()
            self._process = fork.Process(target=self._serve, args=(self._evaluator, theirs, self._pipe), daemon=True)
            self._process.start()
            theirs.close()
        try:
            self._pipe.send((rec, args, limit))
            if self._pipe.poll(limit if limit > 0 else None):
                return self._pipe.recv()
            answer = (False, True, limit * 1000, ["evaluator:timeout"], {})
        except (EOFError, OSError):
            answer = (False, False, 0, ["evaluator:ended"], {})
        self.close()
        return answer

    def close(self) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.join()
            self._pipe.close()
            self._process = None


def evaluate(entities: DataFrame, evaluator: Callable[[dict, list[str], int], dict], backend: str,
             timeout_col: str = "timeout_seconds") -> DataFrame:
    """U-1: run a user evaluator ``(entity row, args, timeout seconds) -> {success, did_timeout, runtime,
    error_ids, features}`` on every entity, in Arrow batches on the executors. An exception becomes an error row
    (``error_ids = ['evaluator:<type>']``), never a failed job.

    The time limit is enforced: the evaluator works in a process of its own, which is ended when a row's ``timeout_col`` (whole
    seconds; null, 0 or no such column: no limit) is over. That row is ``did_timeout`` with the limit as its run time in
    milliseconds; the next one gets a new process. A process that ends by itself gives an error row too."""

    def run(batches):
        worker = _Evaluator(evaluator)
        try:
            for pdf in batches:
                rows = []
                for rec in pdf.to_dict("records"):
                    raw, limit = rec.get("args"), rec.get(timeout_col)
                    args = [] if raw is None else [str(a) for a in raw]
                    rows.append((rec["entity_id"], backend, *worker(rec, args, 0 if limit is None or limit != limit else int(limit))))
                yield pd.DataFrame(rows, columns=[f.name for f in RESULT_SCHEMA.fields])
        finally:
            worker.close()

    return entities.mapInPandas(run, RESULT_SCHEMA)


def evaluated_features(results: DataFrame) -> DataFrame:
    """The feature rows (feature_name, ref_kind, ref_id, value) of evaluated entities; ``ref_kind`` is the back end."""
    rows = results.select("entity_id", "backend", F.explode("features").alias("feature_name", "value"))
    return rows.select("feature_name", F.col("backend").alias("ref_kind"), F.col("entity_id").alias("ref_id"), "value")


# ------------------------------------------------------------------------------------------------
# Streaming job (K1, K2, K3, K7)
# ------------------------------------------------------------------------------------------------
SUBMISSION_SCHEMA = T.StructType([
    T.StructField("submission_id", T.LongType()),
    T.StructField("program", T.StringType()),
    T.StructField("frontend", T.StringType()),
    T.StructField("original_verifier", T.StringType()),
])


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str,
                  threshold: float = SIM.DIRECT_MATCH_THRESHOLD, block: list[str] | None = None) -> None:
    """:func:`_process`, with a status row that names the error if the batch fails (the error is raised again, so the
    stream stops and the batch is taken up again at restart)."""
    try:
        _process(spark, batch, batch_id, out_dir, threshold, block)
    except Exception as e:
        failed = spark.createDataFrame([(0, 0, 0, "failed", f"{type(e).__name__}: {str(e)[:500]}")],
                                       "n_decided long, n_accepted long, n_quarantined long, stage string, error string")
        failed.write.mode("overwrite").parquet(os.path.join(out_dir, "status", f"batch_id={batch_id}"))
        raise


def _process(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str,
                  threshold: float = SIM.DIRECT_MATCH_THRESHOLD, block: list[str] | None = None) -> None:
    """One micro-batch: quarantine malformed rows (K7), fingerprint the batch, admit it against the items
    accepted by earlier batches (K3), and write under ``batch_id=<n>`` (overwrite, so replays are idempotent):
    the decisions, a status row, and the packed prints of the accepted items (which later batches are compared with; the
    corpus is never fingerprinted twice)."""
    block = block or []
    part = f"batch_id={batch_id}"
    stamped = accept_submissions(batch)
    bad = stamped.where(F.col("program").isNull() | F.col("submission_id").isNull())
    good = stamped.where(F.col("program").isNotNull() & F.col("submission_id").isNotNull())
    bad.write.mode("overwrite").parquet(os.path.join(out_dir, "quarantine", part))
    quarantined = bad.count()
    prints = document_prints(good, id_col="submission_id", text_col="program", keep=block)
    b = SIM.prepare(prints)
    stored = _earlier_batches(spark, os.path.join(out_dir, "corpus"), batch_id)
    decided = cut_lineage(admit(b, stored, threshold, block))
    accepted = decided.where("accepted").select("doc_id")
    b.packed.join(accepted, "doc_id", "left_semi").write.mode("overwrite").parquet(os.path.join(out_dir, "corpus", "prints", part))
    decided.write.mode("overwrite").parquet(os.path.join(out_dir, "decisions", part))
    status = decided.select(
        F.count(F.lit(1)).alias("n_decided"),
        F.count_if("accepted").cast("bigint").alias("n_accepted"),
    ).select("*", F.lit(quarantined).cast("bigint").alias("n_quarantined"), F.lit("done").alias("stage"),
             F.lit(None).cast("string").alias("error"))
    status.write.mode("overwrite").parquet(os.path.join(out_dir, "status", part))


def _earlier_batches(spark: SparkSession, corpus_path: str, batch_id: int) -> SIM.PrintSet | None:
    """Print set of the items accepted by batches before ``batch_id`` (None when nothing is stored yet).
    Asks Spark, so it works on any shared file system; a replayed batch never sees its own earlier output."""
    from pyspark.errors import AnalysisException

    try:
        t = spark.read.parquet(os.path.join(corpus_path, "prints"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND" and batch_id == 0:
            return None  # nothing was stored before the first batch; any other fault must show
        raise
    stored = t.where(F.col("batch_id") < F.lit(batch_id)).drop("batch_id")
    if stored.limit(1).count() == 0:
        return None
    return SIM.from_packed(stored)


def start_admission_stream(spark: SparkSession, submissions_dir: str, out_dir: str, checkpoint_location: str,
                           threshold: float = SIM.DIRECT_MATCH_THRESHOLD, block: list[str] | None = None,
                           max_files_per_trigger: int | None = None):
    """Structured Streaming job over parquet submission files; returns the started query.

    Uses ``availableNow`` (drain what is there, then stop); the checkpoint makes restarts resume.
    """
    reader = spark.readStream.schema(SUBMISSION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(submissions_dir)
    return (
        src.writeStream.foreachBatch(lambda df, bid: process_batch(spark, df, bid, out_dir, threshold, block))
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )


def recreate_prints(spark: SparkSession, docs: DataFrame, out_path: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Recompute the prints of the whole corpus and overwrite the prints snapshot; returns the read-back."""
    document_prints(docs, id_col=id_col, text_col=text_col).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


# ------------------------------------------------------------------------------------------------
# K1 as a stream: raw events -> stamped submissions appended to the queue table
# ------------------------------------------------------------------------------------------------
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def start_accept_stream(spark: SparkSession, source_dir: str, queue_dir: str, checkpoint_location: str,
                        glob: str = "*.parquet"):
    """K1 as Structured Streaming: new event files under ``source_dir`` become submissions (payload ``props``,
    arrival = event time, LOC computed) appended to the parquet queue at ``queue_dir``. The file sink and the
    checkpoint make the append exactly-once across restarts. Runs with ``availableNow``; returns the query."""
    src = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).parquet(source_dir)
    subs = accept_submissions(
        src.select(F.col("event_id").alias("submission_id"), F.col("props").alias("program"),
                   F.col("event_type").alias("frontend"), F.col("ts")),
        stamp=F.col("ts"),
    ).drop("ts")
    return (
        subs.writeStream.format("parquet").option("checkpointLocation", checkpoint_location)
        .outputMode("append").trigger(availableNow=True).start(queue_dir)
    )
