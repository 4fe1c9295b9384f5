"""Entry points as Python functions over a :class:`Corpus` of logical tables.

Each function returns a lazy DataFrame; ``as_json`` turns any answer into one JSON object per row (C16).

    corpus = Corpus.from_test_tables(spark, "/root/testdata/sf0.01")
    api.match_regex_detailed(corpus, r"while\\([^)]*\\)").show()
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import as_json as _json
from vellum.functions.scalars import millis_to_timestamp
from vellum.operators import counts, features, lookup, search, versions
from vellum.sources import tables as T
from vellum.streaming.admission import accept_submissions


@dataclass(frozen=True)
class Corpus:
    """The stored tables: accepted entities, results of back end A and B, feature entries, submission queue."""

    entities: DataFrame
    results_a: DataFrame
    results_b: DataFrame
    feature_entries: DataFrame
    submissions: DataFrame

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str) -> "Corpus":
        return cls(
            T.entities(spark, sf_dir),
            T.results_symbolic(spark, sf_dir, with_errors=True),
            T.results_vcgen(spark, sf_dir),
            T.feature_entries(spark, sf_dir),
            T.submissions(spark, sf_dir),
        )

    def results(self, backend: str) -> DataFrame:
        return {"symbolic": self.results_a, "vcgen": self.results_b}[backend]


def program_entries_by_metadata(c: Corpus, earliest_ms: int, latest_ms: int, min_loc: int, max_loc: int,
                                frontend: str | None = None, verifier: str | None = None,
                                parse_success: bool | None = None) -> DataFrame:
    """``/program-entries-by-meta-data``: F3 with epoch-millisecond bounds."""
    lo = F.lit(earliest_ms).cast("bigint")
    hi = F.lit(latest_ms).cast("bigint")
    return lookup.metadata_filter(
        c.entities.where(F.col("submission_date").between(millis_to_timestamp(lo), millis_to_timestamp(hi))),
        min_loc=min_loc, max_loc=max_loc, frontend=frontend, verifier=verifier, parse_success=parse_success,
    )


def program_entries_by_ids(c: Corpus, ids: list[int] | DataFrame) -> DataFrame:
    """``/program-entries-by-ids``: F2."""
    return lookup.by_ids(c.entities, ids)


def program_ids_by_feature_value(c: Corpus, feature: str, value: str) -> DataFrame:
    """``/program-ids-by-feature-value``: J1 (duplicates kept)."""
    return features.ids_with_feature_value(c.feature_entries, c.results_a, c.results_b, feature, value)


def program_ids_by_backend_data(c: Corpus, backend: str, success: bool, did_timeout: bool, min_runtime: int,
                                max_runtime: int) -> DataFrame:
    """``/program-ids-by-<backend>-data``: F6."""
    return lookup.entity_ids_by_result_data(c.results(backend), success, did_timeout, min_runtime, max_runtime)


def feature_values_by_program_id(c: Corpus, entity_id: int) -> DataFrame:
    """``/feature-values-by-program-id``: J2."""
    return features.features_of_entity(c.feature_entries, c.results_a, c.results_b, entity_id)


def results_by_ids(c: Corpus, backend: str, ids: list[int] | DataFrame) -> DataFrame:
    """``/<backend>-results-by-ids``: F2 on results."""
    return lookup.by_ids(c.results(backend), ids)


def benchmark_version(c: Corpus, backend: str, version_hash: str) -> DataFrame:
    """``/benchmark-<backend>-version``: the re-run backlog (J3 + K6); runs go through the U-1 evaluator."""
    return versions.rerun_backlog(c.entities, c.results(backend), version_hash)


def version_difference(c: Corpus, backend: str, v1: str, v2: str, time_factor: float = 1.5) -> DataFrame:
    """``/<backend>-version-difference``: A7 summary row."""
    return versions.version_diff_summary(c.results(backend), v1, v2, time_factor)


def version_difference_lists(c: Corpus, backend: str, v1: str, v2: str, time_factor: float = 1.5) -> DataFrame:
    """The id lists of A7 in long form (J6 + J7)."""
    shared = versions.shared_entities(c.results(backend), v1, v2).select(
        F.lit("shared").alias("kind"), "entity_id", F.lit(None).cast("bigint").alias("result_id")
    )
    return shared.unionByName(versions.version_diffs(c.results(backend), v1, v2, time_factor))


def frontend_count_by_ids(c: Corpus, ids: list[int] | DataFrame) -> DataFrame:
    """``/frontend-count-by-ids``: A5."""
    if not isinstance(ids, DataFrame):
        ids = c.entities.sparkSession.createDataFrame([(int(i),) for i in ids], "entity_id long")
    return counts.frontend_count_by_ids(c.entities, ids)


def match_regex_detailed(c: Corpus, pattern: str, flags: int = 0) -> DataFrame:
    """``/match-regex-detailed``: F9 ``(entity_id, lines)``."""
    return search.regex_lines(c.entities, pattern, flags)


def match_regex(c: Corpus, pattern: str, flags: int = 0) -> DataFrame:
    """``/match-regex``: F10 ids."""
    return search.regex_ids(c.entities, pattern, flags)


def submit_program(raw: DataFrame) -> DataFrame:
    """``/submit-program``: K1 for a frame of submissions ``(submission_id, program, frontend, args,
    original_verifier, success, runtime)``; append the result to the queue table (S5)."""
    return accept_submissions(raw)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row (column ``json``)."""
    return df.select(_json(*df.columns).alias("json"))
