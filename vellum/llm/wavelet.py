"""Token-ID / binary output: one wavelet matrix file per shard.

A shard holds the token ids of consecutive documents (ascending doc_id, nulls first). Its file keeps

* the alphabet: the shard's different ids, most frequent first, so that a token becomes a small rank;
* one bit plane for each bit of the ranks, highest bit first, each stably sorted by the bits above (a wavelet matrix);
  planes are cut into blocks of 65,536 bits, zstd-compressed one by one, with the number of ones before each block;
* where each document starts, and the doc_ids.

:class:`WaveletFile` answers from the compressed bytes: ``access(i)``, ``rank(token, i)`` (occurrences before i),
``count(token)``, ``select(token, k)``, ``occurrences(token)``, ``document(k)`` and ``tokens()``. A point query
decompresses one block of each plane.

Writing: documents are range-partitioned by doc_id (ties by text, then by place, so that no single id can fill a
partition), tokenised in order, and a file is closed whenever it reaches ``SHARD_TOKENS``. A file is written under a
name of its attempt and renamed; its name and bytes depend on the data alone, so a task that runs again, after a lost
executor or as a speculative copy, leaves the same file. The manifest (one row for each file) is returned by Spark's own
committed writer, and readers open only files that it names. Memory in a task is bounded by a shard and a batch.

Tokenising: the vocabulary's normaliser and splitter never join across white space, so ids of a text are those of its
white-space separated parts; parts seen before come from a bounded dictionary, others from the tokenizers library.

Defined cases: a null or empty text holds the end id alone; rows that share a doc_id are documents of their own; an
empty table writes no file and reads back as an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import text_key
from vellum.session import checkpoint_dir

END_ID = 1
SHARD_TOKENS = 4 << 20
BLOCK_BITS = 1 << 16
PUNCTUATION = ".,;:!?"
CACHE_WORDS = 1 << 18      # of each of two generations
GROUP_BYTES = 8 << 20
DENSE_IDS = 1 << 20
MAGIC = b"WVM1"


# ---------------------------------------------------------------- the file

def encode_shard(tokens: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """Bytes of a wavelet matrix file of uint32 tokens; starts[k] is the first token of document k."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    if len(tokens) and int(tokens.max()) < DENSE_IDS:  # ids of a vocabulary: a table of counts
        counts = np.bincount(tokens)
        alphabet, ranks = np.flatnonzero(counts), tokens
        counts, size = counts[alphabet], len(counts)
    else:  # any 32-bit ids: sort
        alphabet, ranks, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        size = len(alphabet)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(size, dtype=np.uint16 if len(order) <= 1 << 16 else np.uint32)
    place[alphabet[order] if size > len(alphabet) else order] = np.arange(len(order))
    a = place[ranks]
    levels = max(int(len(order) - 1).bit_length(), 1) if len(order) else 0
    sections = {"alphabet": pack(alphabet[order].astype("<u4").tobytes()),
                "starts": pack(starts.astype("<u8").tobytes()),
                "ids": pack(np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()),
                "null_ids": pack(np.packbits([d is None for d in doc_ids]).tobytes() if doc_ids else b"")}
    zeros, body = [], io.BytesIO()
    for level in range(levels - 1, -1, -1):
        if level == 7:  # bits above are done with: bytes are faster to move
            a = a.astype(np.uint8)
        bits = (a & a.dtype.type(1 << level)).astype(bool)
        low, high = np.flatnonzero(~bits), np.flatnonzero(bits)  # unlike a mask, free of branches
        zeros.append(len(low))
        a = np.concatenate([a.take(low), a.take(high)])
        ends, ones = [], [0]
        blob = io.BytesIO()
        for at in range(0, len(bits), BLOCK_BITS):
            part = bits[at:at + BLOCK_BITS]
            blob.write(pack(np.packbits(part).tobytes()))
            ends.append(blob.tell())
            ones.append(ones[-1] + int(np.count_nonzero(part)))
        sections[f"ends{level}"] = np.array(ends, dtype="<u8").tobytes()
        sections[f"ones{level}"] = np.array(ones, dtype="<u8").tobytes()
        sections[f"plane{level}"] = blob.getvalue()
    where = {}
    for name, data in sections.items():
        where[name] = [body.tell(), len(data)]
        body.write(data)
    head = json.dumps({"n": len(tokens), "docs": len(doc_ids), "levels": levels, "zeros": zeros, "where": where}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body.getvalue()


class WaveletFile:
    """Queries on the bytes of one file."""

    def __init__(self, data: bytes):
        import zstandard

        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._data = memoryview(data)
        size = struct.unpack("<I", self._data[4:8])[0]
        head = json.loads(bytes(self._data[8:8 + size]))
        self._body, self._where = 8 + size, head["where"]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.n, self.docs, self.levels, self.zeros = head["n"], head["docs"], head["levels"], head["zeros"]
        self.alphabet = np.frombuffer(self._unpack(self._section("alphabet")), dtype="<u4") if self.n else np.zeros(0, "<u4")
        self.starts = np.frombuffer(self._unpack(self._section("starts")), dtype="<u8") if self.docs else np.zeros(0, "<u8")
        self._place = {int(t): k for k, t in enumerate(self.alphabet)}
        self._ends = [np.frombuffer(self._section(f"ends{b}"), dtype="<u8") for b in self._bits()]
        self._ones = [np.frombuffer(self._section(f"ones{b}"), dtype="<u8") for b in self._bits()]

    def _bits(self) -> range:
        return range(self.levels - 1, -1, -1)

    def _section(self, name: str) -> memoryview:
        at, size = self._where[name]
        return self._data[self._body + at:self._body + at + size]

    def _block(self, level: int, k: int) -> np.ndarray:
        """Bits of block k of a plane; level 0 is the highest bit."""
        ends = self._ends[level]
        plane = self._section(f"plane{self.levels - 1 - level}")
        raw = self._unpack(plane[int(ends[k - 1]) if k else 0:int(ends[k])])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK_BITS, self.n - k * BLOCK_BITS))

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, r = divmod(i, BLOCK_BITS)
        ones = int(self._ones[level][k])
        return ones + int(np.count_nonzero(self._block(level, k)[:r])) if r else ones

    def _select(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) one or zero of a plane."""
        ones = self._ones[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        k = int(np.searchsorted(before, j, side="right")) - 1
        return k * BLOCK_BITS + int(np.flatnonzero(self._block(level, k) == bit)[j - int(before[k])])

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        r = 0
        for level in range(self.levels):
            k, at = divmod(i, BLOCK_BITS)
            block = self._block(level, k)
            bit, ones = int(block[at]), int(self._ones[level][k]) + int(np.count_nonzero(block[:at]))
            r = r << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[r])

    def _range(self, token: int, i: int) -> tuple[int, int, int]:
        r, lo, hi = self._place[token], 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if r >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return r, lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        if token not in self._place:
            return 0
        _, lo, hi = self._range(token, max(0, min(i, self.n)))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        r, lo, _ = self._range(token, self.n)
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = r >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def doc_ids(self) -> list[int | None]:
        if not self.docs:
            return []
        ids = np.frombuffer(self._unpack(self._section("ids")), dtype="<i8").tolist()
        none = np.unpackbits(np.frombuffer(self._unpack(self._section("null_ids")), np.uint8), count=self.docs)
        return [None if x else d for d, x in zip(ids, none, strict=True)]

    def span(self, k: int) -> tuple[int, int]:
        return int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.docs else self.n

    def document(self, k: int) -> list[int]:
        lo, hi = self.span(k)
        return [self.access(i) for i in range(lo, hi)]

    def tokens(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest bit up."""
        a = np.zeros(self.n, dtype=np.uint8)  # wider as soon as a bit asks for it
        for level in range(self.levels - 1, -1, -1):
            if self.levels - 1 - level in (8, 16):
                a = a.astype(np.uint16 if self.levels - 1 - level == 8 else np.uint32)
            blocks = [self._block(level, k) for k in range(len(self._ends[level]))]
            bits = np.concatenate(blocks).view(bool) if blocks else np.zeros(0, dtype=bool)
            up, z = np.empty_like(a), self.zeros[level]
            up[np.flatnonzero(~bits)] = a[:z]
            up[np.flatnonzero(bits)] = a[z:] | a.dtype.type(1 << (self.levels - 1 - level))
            a = up
        return self.alphabet[a] if self.n else np.zeros(0, "<u4")


# ---------------------------------------------------------------- tokens

def _spread(table: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of a table that is cut into runs of ``sizes``, one after the other, and where each ends."""
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - lengths)
    return table[np.repeat(shift, lengths) + np.arange(total)], ends


@lru_cache(maxsize=1)
def taken_apart() -> frozenset[str]:
    """Letters of which composing and lower case make more than letters: a letter and a mark."""
    return frozenset(c for c in map(chr, range(0x20000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha())


def _all_letters(words: pa.Array) -> pa.Array:
    """Whether words are of letters before and after normalising (few words are beyond ASCII and looked at twice)."""
    plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(plain & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    if len(odd):
        apart = pc.match_substring_regex(words.take(pa.array(odd)), f"[{''.join(sorted(taken_apart()))}]")
        plain = plain.copy()
        plain[odd] = ~apart.to_numpy(zero_copy_only=False)
    return pa.array(plain)


class Encoder:
    """Whole texts to ids by a vocabulary file of the tokenizers library.

    Texts are cut at white space, and parts of letters with final punctuation into a word (A-Z in lower case, as the
    normaliser has it) and its punctuation, which the splitter keeps apart. A word in which the normaliser makes a mark of
    a letter goes to the library with its punctuation, since a mark joins what follows. What is left is different words, looked up
    among those seen before (two generations of at most ``CACHE_WORDS``: when the young one is full it becomes the old
    one, so frequent words stay); new ones go to the library together.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        ends = [t.endswith("</w>") for t, _ in sorted(self._tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self._ends = np.array(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of ids of each text (without the end id)."""
        whole = pc.fill_null(texts, "")
        for c in "\n\t\r":
            whole = pc.replace_substring(whole, c, " ")
        split = pc.split_pattern(whole, " ")
        counts = pc.list_value_length(split).to_numpy()
        parts = split.flatten().dictionary_encode()
        del whole, split
        different = parts.dictionary
        core = pc.utf8_rtrim(different, PUNCTUATION)
        plain = _all_letters(core)
        word = pc.if_else(plain, pc.ascii_lower(core), different)
        tail = pc.if_else(plain, pc.replace_substring_regex(different, f"^(?s:.*)[^{PUNCTUATION}]", ""), "")
        pieces = pa.concat_arrays([word, tail]).dictionary_encode()
        table, sizes = self._lookup(pieces.dictionary.to_pylist())
        each, ends = _spread(table, sizes, pieces.indices.to_numpy().reshape(2, -1).T.ravel())
        ids, last = _spread(each, np.diff(ends[1::2], prepend=0), parts.indices.to_numpy())
        return ids, np.diff(last[np.cumsum(counts) - 1], prepend=0)

    def _lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and the number of ids of each."""
        got = list(map(self._known.get, words))
        new = [k for k, ids in enumerate(got) if ids is None]
        if new:
            if len(self._known) > CACHE_WORDS:
                self._old, self._known = self._known, {}
            fresh = []
            for k in new:
                got[k] = self._old.get(words[k])
                if got[k] is None:
                    fresh.append(k)
            for k, ids in zip(fresh, self._learn([words[k] for k in fresh]), strict=True):
                got[k] = ids
            self._known.update((words[k], got[k]) for k in new)
        return np.frombuffer(b"".join(got), dtype="<u4"), np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words not seen before. Words of letters and runs of punctuation end with a word-end token each: they
        are encoded as one text and cut there."""
        apart = taken_apart()
        simple = [k for k, w in enumerate(words) if w.isalpha() and (w.isascii() or apart.isdisjoint(w)) or w and not w.strip(PUNCTUATION)]
        out = [b""] * len(words)
        ids = np.frombuffer(b"".join(self._library([" ".join([words[k] for k in simple])])), dtype="<u4")
        stops = (np.flatnonzero(self._ends[ids]) + 1) * 4
        if len(stops) == len(simple):
            raw, at = ids.tobytes(), 0
            for k, stop in zip(simple, stops.tolist(), strict=True):
                out[k] = raw[at:stop]
                at = stop
        else:  # a letter that the normaliser takes apart, or another kind of vocabulary
            simple = []
        done = set(simple)
        other = [k for k in range(len(words)) if k not in done]
        for k, found in zip(other, self._library([words[k] for k in other]), strict=True):
            out[k] = found
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- files of a table

def _put(folder: str, name: str, data: bytes) -> str:
    """Writes a file under a name of its own and renames it: no reader ever sees half a file."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{base}/{name}")
    return f"{folder}/{name}"


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about ``GROUP_BYTES`` together."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        end = max(int(np.searchsorted(sizes, done + GROUP_BYTES, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, partitions: int | None = None,
                 shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Writes the files below ``folder`` (a URI that driver and executors share) and returns the manifest:
    (part, shard, path, docs, tokens, before), ``before`` being the tokens of earlier files of the same part."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        shard, before, held = 0, 0, 0
        ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, before, held
            counts = np.concatenate(sizes)
            data = encode_shard(np.concatenate(tokens), np.cumsum(counts) - counts, ids)
            path = _put(f"{folder}/files", f"shard-{part:06d}-{shard:05d}.wvm", data)
            out = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "path": [path], "docs": [len(ids)],
                                              "tokens": [held], "before": [before]}, schema=arrow)
            shard, before, held = shard + 1, before + held, 0
            for x in (ids, sizes, tokens):
                x.clear()
            return out

        for b in batches:
            for group in _groups(b):
                found, counts = enc.encode(group.column("text"))
                found, counts = np.insert(found, np.cumsum(counts), end_id), counts + 1  # each document ends with it
                names, ends, at = group.column("doc_id").to_pylist(), np.cumsum(counts), 0
                while at < len(names):  # a shard ends with the document that fills it
                    done = int(ends[at - 1]) if at else 0
                    to = min(int(np.searchsorted(ends, done + shard_tokens - held)) + 1, len(names))
                    ids += names[at:to]
                    sizes.append(counts[at:to])
                    tokens.append(found[done:int(ends[to - 1])])
                    held += len(tokens[-1])
                    at = to
                    if held >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()),
                       ("tokens", pa.int64()), ("before", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("k"),
                       F.monotonically_increasing_id().alias("i"))
    ordered = rows.repartitionByRange(partitions, "doc_id", "k", "i").sortWithinPartitions("doc_id", "k", "i")
    manifest = ordered.select("doc_id", "text").mapInArrow(run, "part int, shard int, path string, docs long, tokens long, before long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Reads every file that the manifest below ``folder`` names: (part, shard, place, doc_id, start, n_tokens, ids_crc32), ``start`` counted
    over all files in order."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                f = WaveletFile(content.as_buffer().to_pybytes())
                part, shard = map(int, os.path.basename(path).removesuffix(".wvm").split("-")[1:])
                raw = memoryview(f.tokens().astype("<u4").tobytes())
                spans = [f.span(k) for k in range(f.docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * f.docs, pa.int32()), pa.array([shard] * f.docs, pa.int32()),
                     pa.array(range(f.docs), pa.int64()), pa.array(f.doc_ids(), pa.int64()),
                     pa.array([lo for lo, _ in spans], pa.int64()), pa.array([hi - lo for lo, hi in spans], pa.int64()),
                     pa.array([zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in spans], pa.int64())],
                    names=["part", "shard", "place", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "part int, shard int, place long, doc_id long, at long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        empty = spark.createDataFrame([], schema)
        return empty.select("part", "shard", "place", "doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wvm").load(f"{folder}/files")
             .select("path", "content").mapInArrow(run, schema))
    # tokens of the parts before: one row for each part
    per = manifest.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    parts = per.select(F.col("part").alias("p"), (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base"))
    where = manifest.join(parts, F.col("part") == F.col("p")).select(
        F.col("part").alias("p"), F.col("shard").alias("s"), (F.col("base") + F.col("before")).alias("base"))
    j = files.join(where, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return j.select("part", "shard", "place", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, as a URI."""
    base = checkpoint_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/wavelet-{uuid.uuid4().hex}"
