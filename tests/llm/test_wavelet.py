import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import odd_rows, table
from tokenizers import Tokenizer

from vellum.llm import wavelet
from vellum.llm.queries import QUERIES

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def shard(tokens, starts=(0,), ids=(1,)):
    return wavelet.WaveletFile(wavelet.encode_shard(np.array(tokens, "<u4"), np.array(starts, "<u8"), list(ids)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5), min_size=1, max_size=200))
def test_access_rank_select_and_count(tokens):
    f = shard(tokens)
    assert f.tokens().tolist() == tokens
    assert [f.access(i) for i in range(len(tokens))] == tokens
    for t in {*tokens, 77}:
        at = [i for i, x in enumerate(tokens) if x == t]
        assert f.count(t) == len(at) and f.occurrences(t) == at
        assert all(f.rank(t, i) == sum(a < i for a in at) for i in range(0, len(tokens) + 1, 7))


def test_queries_across_blocks():
    rng = np.random.default_rng(3)
    tokens = np.minimum(rng.geometric(0.05, 200_000), 300)
    f = shard(tokens)
    assert np.array_equal(f.tokens(), tokens)
    for t in (1, 2, 50):
        at = np.flatnonzero(tokens == t)
        assert f.count(t) == len(at) and [f.select(t, k) for k in (0, len(at) // 2, len(at) - 1)] == [at[0], at[len(at) // 2], at[-1]]
        assert f.rank(t, 131_073) == np.count_nonzero(tokens[:131_073] == t)
    assert [f.access(i) for i in (0, 65_535, 65_536, 199_999)] == tokens[[0, 65_535, 65_536, 199_999]].tolist()
    with pytest.raises(IndexError):
        f.access(200_000)
    with pytest.raises(IndexError):
        f.select(77_777, 0)


def test_empty_shard_and_documents():
    f = shard([], [], [])
    assert f.n == f.docs == f.count(1) == 0 and f.tokens().tolist() == [] and f.doc_ids() == []
    f = shard([5, 1, 1, 9, 1], [0, 2, 3], [4, None, -7])
    assert [f.document(k) for k in range(3)] == [[5, 1], [1], [9, 1]] and f.doc_ids() == [4, None, -7]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["can't", "I'LL", "<|endoftext|>", "<|startoftext|>x", "é", "é", " ", "\n", "\t", "\x0b",
                                                       "\x1c", "\x85", "\xa0", " ", "中文", "12", "a", "ſ", "İ", "́"]), max_size=12).map("".join))
def test_parts_give_the_ids_of_the_whole_text(text):
    for texts in ([text], [text, None, "other words, here " + text]):
        ids, counts = wavelet.encoder(PATH).encode(pa.array(texts, pa.string()))
        for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == Tokenizer_whole(t or "")


def test_letters_that_the_normaliser_takes_apart(library):
    """Each before every final punctuation mark, alone, after a letter and before one."""
    def apart(c):
        return c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()
    letters = [c for c in map(chr, range(0x110000)) if apart(c)]
    assert "\u0130" in letters and "\u095c" in letters and len(letters) > 50
    words = [w for c in letters for w in (c, "KAD" + c, c + "x")]
    texts = [f"a {w}{p} b" for w in words for p in (*wavelet.PUNCTUATION, "?!", "")] + [f"{c}, {c.lower()}.{c}!" for c in letters]
    ids, counts = wavelet.Encoder(PATH).encode(pa.array(texts, pa.string()))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(categories=["L", "M", "Nd", "P"]), max_size=4) | st.sampled_from(list(wavelet.PUNCTUATION) + [" ", "\n", "\u0130", "\u093c", "\u0307"]), max_size=20).map("".join))
def test_random_unicode_gives_the_ids_of_the_library(text):
    ids, _ = wavelet.encoder(PATH).encode(pa.array([text], pa.string()))
    assert ids.tolist() == Tokenizer_whole(text)


def Tokenizer_whole(text, cache={}):
    t = cache.setdefault("t", Tokenizer.from_file(PATH))
    return t.encode(text, add_special_tokens=False).ids


def slow(library, rows):
    """(doc_id, n_tokens, crc) of each row and the total."""
    out = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("limit", [200, 1 << 22])
def test_files_of_odd_documents(spark, library, limit):
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    folder = wavelet.scratch_folder(spark)
    manifest = wavelet.write_shards(table(spark, rows), PATH, folder, partitions=3, shard_tokens=limit)
    got = wavelet.read_shards(spark, folder).orderBy("start").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(slow(library, rows), key=key)
    ids = [r.doc_id for r in got]
    assert ids == [None] * 2 + sorted(d for d in ids if d is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sum(r.tokens for r in manifest.collect()) == at


def test_a_file_written_again_is_the_same(spark):
    a, b = wavelet.scratch_folder(spark), wavelet.scratch_folder(spark)
    docs = table(spark, odd_rows())
    names = []
    for folder in (a, b):
        wavelet.write_shards(docs, PATH, folder, partitions=2)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(f"{folder}/files").collect()
        names.append({(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in files})
    assert names[0] == names[1]


def test_empty_table(spark):
    folder = wavelet.scratch_folder(spark)
    assert wavelet.write_shards(table(spark, []), PATH, folder).count() == 0
    assert wavelet.read_shards(spark, folder).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for d, n, crc in slow(library, rows):
        want.append((d, at, n, crc))
        at += n
    assert sorted(map(tuple, QUERIES["op2_token_files"](spark, sf).collect())) == want
