"""The whole pipeline against brute-force versions of its stages, on a small table with every odd case."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import odd_rows, prose, table
from test_decontam import slow_matches
from test_quality import slow_counts
from test_simhash import slow_components, slow_fingerprint
from test_wavelet import Tokenizer_whole

import corpus_pipeline
from vellum.llm import mixing, quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(12)
    bench = [(i, prose(rng, 25, 10**6)) for i in range(5)]
    rows = odd_rows() + [(1000 + i, prose(rng, 100) + ("\n" + bench[i % 5][1] if i % 10 == 0 else ""), "en", "b") for i in range(80)]
    rows += [(2000 + i, rows[70 + i][1], "en", "b") for i in range(20)]
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def test_stages_against_brute_force(spark, sf_dir):
    folder, rows, bench = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, folder)
    verdicts = Counter((r.doc_id, r.n_words, r.kept) for r in quality.quality_verdicts(docs).collect())
    failed = {r[:2] for r in rows if slow_counts(r[1])[-1]}
    assert not failed & set(pairs(kept)) and kept.columns == columns
    assert sum(pairs(kept).values()) == sum(n for (_, _, k), n in verdicts.items() if k)

    one = stages["simhash_near_dedup"](spark, kept, folder)
    left = list(pairs(kept).elements())
    comps = slow_components([(d, slow_fingerprint(t)) for d, t in left])
    key = lambda x: (x is None, x)
    assert sorted((d for d, _ in pairs(one).elements()), key=key) == sorted(set(comps), key=key) and one.columns == columns

    clean = stages["benchmark_decontamination"](spark, one, folder)
    bad = {d for d, _ in slow_matches(pairs(one), bench)}
    assert bad and pairs(clean) == Counter({k: n for k, n in pairs(one).items() if k[0] not in bad}) and clean.columns == columns

    mixed = stages["mixing"](spark, clean, folder)
    plan = Counter({r.doc_id: r.copies for r in mixing.plan(clean).collect() if r.copies})
    assert Counter(d for d, _ in pairs(mixed).elements()) == plan and mixed.columns == columns

    out = stages["token_files"](spark, mixed, folder)
    want = Counter()
    for (d, t), n in pairs(mixed).items():
        ids = [*Tokenizer_whole(t or ""), 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    got = out.collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, got))


def test_empty_documents(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
