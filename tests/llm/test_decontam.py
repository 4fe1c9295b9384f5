import random

from llm_fixtures import odd_rows, prose, table

from vellum.llm import decontam
from vellum.llm.queries import QUERIES

ITEMS = "item_id long, text string, score double"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0.5) for i, t in rows], ITEMS)


def slow_scores(index, terms):
    total = {}
    for t in terms:
        for d, v in zip(*index.post[t], strict=True):
            total[d] = total.get(d, 0.0) + v
    return total


def test_wand_returns_exactly_the_items_at_or_above_the_threshold():
    rng = random.Random(2)
    few = [f"w{i}" for i in range(8)]  # few words: long posting lists, many blocks
    bench = [(i, " ".join(rng.choices(few, k=rng.randrange(5, 40)))) for i in range(400)]
    index = decontam.Index(bench)
    assert max(map(len, index.block_max)) > 1
    for theta in (0.05, 0.2, 0.4, 0.9):
        for _ in range(60):
            words = rng.choices(few, k=60) if rng.random() < 0.7 else decontam.tokens(rng.choice(bench)[1]) + rng.choices(few, k=9)
            terms = sorted(set(index.terms(words)[1].tolist()))
            want = {d: s for d, s in slow_scores(index, terms).items() if s >= theta - 1e-9}
            got = dict(index.search(terms, theta))
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)


def slow_matches(rows, bench):
    """Documents whose words hold all of an item's, in order."""
    out = set()
    for d, t, *_ in rows:
        w = " ".join(decontam.tokens(t))
        for i, b in bench:
            x = " ".join(decontam.tokens(b))
            if len(x.split()) >= 5 and f" {x} " in f" {w} ":
                out.add((d, i))
    return out


def test_planted_copies_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(4)
    bench = [(i, prose(rng, rng.randrange(15, 60), 10**6)) for i in range(30)]
    bench += [(50, "What is the capital of the small island state? It is the town of Porto Novo del Sur."), (51, "too short"), (52, None), (53, "")]
    rows = [(i, prose(rng, 150), "en", "a") for i in range(80)]
    for k in range(30):  # whole copies at any place, in other case and with other punctuation
        a, b = prose(rng, rng.randrange(0, 200)), prose(rng, rng.randrange(0, 200))
        text = bench[k][1] if k % 2 else bench[k][1].upper().replace(" ", ",  ")
        rows.append((1000 + k, f"{a}\n{text}. {b}", "en", "a"))
    rows += [(2000, "x " + bench[30][1].lower(), "en", "a"), (2001, bench[30][1].split("?")[0] + "? Nobody knows.", "en", "a"), *odd_rows(8)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, rows), items(spark, bench)).collect()}
    want = slow_matches(rows, [b for b in bench if b[1]])
    assert len(want) == 31 and got == want
    kept = decontam.decontaminate(table(spark, rows), items(spark, bench))
    assert kept.columns == table(spark, []).columns
    bad = {d for d, _ in want}
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r[0] for r in rows if r[0] not in bad), key=key)


def test_one_changed_word_is_still_found(spark):
    rng = random.Random(6)
    text = prose(rng, 40, 10**6)
    w = text.split()
    w[10] = "changed"
    got = decontam.contaminated(table(spark, [(1, prose(rng, 50) + " " + " ".join(w), "en", "a")]), items(spark, [(1, text)])).collect()
    assert len(got) == 1 and got[0].answer_overlap == 1.0 and 0.9 < got[0].question_overlap < 1.0


def test_short_answers_are_found_behind_labels_and_options():
    bench = [(1, "What is the capital of France? Paris"), (2, "What is the population of France? Some 68 million"),
             (3, "Who wrote it? The old clerk of the town hall in Porto Novo")]
    index = decontam.Index(bench + [(10 + i, f"What is the capital of w{i}? x{i}") for i in range(50)])
    found = lambda t: {m[0] for m in index.matches(t, decontam.THRESHOLD, decontam.MIN_OVERLAP)}
    fill, far = " ".join(f"f{i}" for i in range(60)), " ".join(f"g{i}" for i in range(1000))
    assert found(f"{fill} Question: What is the capital of France? Answer: Paris {fill}") == {1}
    assert found("What is the capital of France? A) Rome B) Lima C) Paris D) Bonn") == {1}
    assert found(f"What is the population of France? {fill[:100]} Answer: some 68 million.") == {2}
    assert found("Q: Who wrote it? A: the old clerk of the town hall in Porto Novo") == {3}
    assert found("What is the capital of w7? The answer is x7") == {17}
    assert found("What is the capital of France? Nobody knows.") == set()
    assert found(f"What is the capital of France? {far} Paris") == {1}  # a short answer counts wherever it stands
    assert found(f"What is the capital of France? {far}") == set()


def test_short_items_and_scripts_without_spaces():
    bench = [(1, "Capital of France? Paris"), (2, "法国的首都是哪里？巴黎"), (3, "ประเทศฝรั่งเศสมีเมืองหลวงชื่ออะไร? ปารีส"), (4, "word"), (5, "photosynthesis reaction")]
    index = decontam.Index(bench)
    found = lambda t: {m[0] for m in index.matches(t, decontam.THRESHOLD, decontam.MIN_OVERLAP)}
    assert found("x y capital of France: PARIS, z") == {1} and found("capital of France or Paris") == set()
    assert found("问题：法国的首都是哪里？答案：巴黎。") == {2} and found("法国的首都是哪里？不知道。") == set()
    assert found("ก ประเทศฝรั่งเศสมีเมืองหลวงชื่ออะไร? ปารีส ข") == {3}
    assert found("one word of the photosynthesis reaction") == {5} and found("a word and a reaction of photosynthesis") == set()


def test_blocks_of_items_give_the_same_matches(spark, monkeypatch):
    rng = random.Random(9)
    bench = [(i, prose(rng, 30, 10**6)) for i in range(20)]
    rows = [(i, prose(rng, 40) + " " + bench[i][1], "en", "a") for i in range(20)]
    whole = {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, rows), items(spark, bench)).collect()}
    monkeypatch.setattr(decontam, "INDEX_CHARS", 1000)
    assert len(decontam._blocks(items(spark, bench))) > 3
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, rows), items(spark, bench)).collect()} == whole == {(i, i) for i in range(20)}


def test_empty_tables(spark):
    assert decontam.contaminated(table(spark, []), items(spark, [(1, "a b c d e f g")])).count() == 0
    assert decontam.contaminated(table(spark, odd_rows()), items(spark, [])).count() == 0
    assert decontam.decontaminate(table(spark, odd_rows()), items(spark, [(None, None)])).count() == len(odd_rows())


def test_query_finds_the_copies_in_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, sf).collect()} == slow_matches(rows, bench)


def test_items_of_one_word_match_a_line_of_their_own(spark):
    docs = table(spark, [(1, "first line\n  Zanzibar! \nlast", "en", "a"), (2, "we went to Zanzibar and back", "en", "a"), (3, None, "en", "a"), (4, "ZANZIBAR", "en", "a")])
    items = spark.createDataFrame([(7, "Zanzibar"), (8, "a b c d e f g h i j"), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.passage_start for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 7): 2, (4, 7): 0}


def test_a_short_answer_far_from_its_question_is_found(spark):
    question = "Which of the seven northern rivers carries the least water in a dry summer?"
    far = " ".join(f"w{i}" for i in range(3000))
    docs = table(spark, [(1, f"{question} {far} Tornio", "en", "a"), (2, f"{question} {far}", "en", "a"), (3, f"Tornio {far} {question}", "en", "a")])
    items = spark.createDataFrame([(5, question + " Tornio")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 5), (3, 5)}
