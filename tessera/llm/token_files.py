"""Token ids in byte-aligned files.

Ids are replaced by their rank in the corpus-wide frequency order, so that frequent ids take one
byte. A document's record holds control bits (one a value: one byte or two; for vocabularies over
65,536, two bits a value: one to four bytes) apart from the data bytes. Reading expands control
bytes through a table of value lengths and gathers all values of a record at once.

A shard is a file ``part-NNNNNN.ids``: the magic, then records in ascending document order, each
``known u8, doc_id i64, n_ids u32, n_data u32, control bytes, data bytes``. ``ranks.ids`` holds the
id of each rank as u32. Shards are written under a name of their own attempt and then renamed, so a
task that runs again leaves the same file.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.words import buffer_of, ragged, same_bytes, slices, word_edges, word_hashes
from tessera.plans.batches import bound_batches
from tessera.plans.scratch import new_path

MAGIC = b"TSRIDS01"
_HEAD = struct.Struct("<BqII")


_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)  # 0: a word with this byte goes to the library as it stands
_CLASS[0x21:0x7F] = _OTHER
_CLASS[ord("'")] = 0
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0xC3] = _CLASS[0x80:0xC0] = _LETTER  # the letters U+00C0..U+00FF; other uses of these bytes are found out below


def _segments(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut plain words where the tokenizer's own pattern does, and lower them.

    A plain word has printable ASCII without apostrophe and the letters of Latin-1 only, and no
    bracket of a special token. Returns the buffer with plain words lowered, the segments' edges,
    and which of them are plain; any other word is one segment.
    """
    if not len(s):
        return buf, s, e, np.zeros(0, bool)
    kind = _CLASS[buf]
    n = len(buf)
    prior = np.empty(n, np.uint8)
    prior[0] = 0
    prior[1:] = buf[:-1]
    tail = (buf >= 0x80) & (buf < 0xC0)
    bad = (kind == 0) | (tail & ((prior != 0xC3) | (buf == 0x97) | (buf == 0xB7))) | ((buf == ord("|")) & (prior == ord("<")))
    bad_upto = np.zeros(n + 1, np.int64)
    np.cumsum(bad, out=bad_upto[1:])
    plain = bad_upto[e] == bad_upto[s]
    inside = np.zeros(n, bool)
    inside[ragged(s[plain], (e - s)[plain])] = True
    lowered = np.where(inside & (buf >= 0x41) & (buf <= 0x5A), buf + 32, buf)
    lowered = np.where(inside & tail & (buf < 0x9F), lowered + 32, lowered).astype(np.uint8)
    cut = np.zeros(n, bool)
    cut[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    cut[s] = True
    starts = np.flatnonzero(cut & (inside | np.isin(np.arange(n), s[~plain], assume_unique=True)) if (~plain).any() else cut & inside)
    word = np.searchsorted(s, starts, side="right") - 1
    ends = np.minimum(e[word], np.append(starts[1:], n))
    return lowered, starts, ends, plain[word]


class WordTokenizer:
    """Ids of whole texts from a ``tokenizers`` file, segment by segment.

    The tokenizer's patterns never match across the six ASCII separators, so a text's ids are its
    words' ids in a row. Plain words are cut further, into the pieces that the tokenizer's pattern
    makes of them. Each distinct segment of a batch goes to the library once; plain ones, which are
    normalised already, go to the same model without its normaliser.
    """

    _made: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str, most: int = 1_500_000, most_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        self._forget()
        parts = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # fixed values: the pattern and normaliser for which cutting plain words is exact
        known = steps == ["Split", "ByteLevel"] and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        }
        lowers = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.cuts = known and lowers
        self.bare = Tokenizer.from_file(path)
        if self.cuts:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and per document the number of its first id (one more than documents)."""
        s, e, _ = word_edges(buf, offs)
        plain = np.zeros(len(s), bool)
        if self.cuts:
            buf, s, e, plain = _segments(buf, s, e)
        first = np.searchsorted(s, offs)
        # a plain and another segment of the same bytes are kept apart
        h, at, back = np.unique(word_hashes(buf, s, e) ^ plain.astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > self.most or len(self.spelled) > self.most_bytes:
            self._forget()
        where = np.searchsorted(self.keys, h)
        new = np.flatnonzero(self.keys[np.minimum(where, len(self.keys) - 1)] != h) if len(self.keys) else np.arange(len(h))
        if len(new):
            self._learn(h[new], where[new], buf, s[at[new]], e[at[new]], plain[at[new]])
            where = np.searchsorted(self.keys, h)
        known = where[back]
        same = (self.sizes[known] == e - s) & (self.plain[known] == plain)
        same[same] = same_bytes(buf, s[same], self.spelled, self.places[known[same]], (e - s)[same])
        starts, lengths, flat = self.starts[known], self.lengths[known], self.flat
        if not same.all():  # another segment has this hash: these go to the library as they are
            odd = np.flatnonzero(~same)
            ids = self._ids(buf, s[odd], e[odd], plain[odd])
            lengths[odd] = [len(x) for x in ids]
            starts[odd] = np.cumsum(lengths[odd]) - lengths[odd] + len(flat)
            flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
        ids = flat[ragged(starts, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return ids, upto[first]

    def _forget(self) -> None:
        """Known segments: sorted hashes, where each one's ids lie in ``flat`` and its bytes in ``spelled``."""
        self.keys, self.flat, self.spelled = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.starts = np.zeros(0, np.int64)
        self.lengths = self.places = self.sizes = np.zeros(0, np.int32)
        self.plain = np.zeros(0, bool)

    def _ids(self, buf: np.ndarray, s, e, plain) -> list[list[int]]:
        ids: list[list[int]] = [[]] * len(s)
        raw = [buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        for kind, tokenizer in ((True, self.bare), (False, self.whole)):
            some = np.flatnonzero(plain == kind)
            for part in range(0, len(some), 20_000):
                few = some[part : part + 20_000].tolist()
                for i, x in zip(few, tokenizer.encode_batch_fast([raw[i].decode() for i in few], add_special_tokens=False), strict=True):
                    ids[i] = x.ids
        return ids

    def _learn(self, keys, where, buf: np.ndarray, s, e, plain) -> None:
        ids = self._ids(buf, s, e, plain)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths + len(self.flat)
        places = np.cumsum(e - s) - (e - s) + len(self.spelled)
        self.flat = np.concatenate([self.flat, flat])
        self.spelled = np.concatenate([self.spelled, buf[ragged(s, e - s)]])
        put = lambda old, new: np.insert(old, where, new)
        self.keys, self.starts, self.lengths = put(self.keys, keys), put(self.starts, starts), put(self.lengths, lengths)
        self.places, self.sizes, self.plain = put(self.places, places), put(self.sizes, e - s), put(self.plain, plain)


def _lengths_table(bits: int) -> np.ndarray:
    """Per control byte the lengths of its values, in order."""
    codes = np.arange(256)[:, None] >> np.arange(0, 8, bits)[None, :]
    return ((codes & ((1 << bits) - 1)) + 1).astype(np.int64)


_TABLES = {bits: _lengths_table(bits) for bits in (1, 2)}


def pack_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes of one document's ranks."""
    ranks = ranks.astype(np.uint32)
    size = np.ones(len(ranks), np.int64)
    for edge in (1 << 8, 1 << 16, 1 << 24)[: (1 << bits) - 1]:
        size += ranks >= edge
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for b in range(1 << bits):
        some = size > b
        data[at[some] + b] = (ranks[some] >> np.uint32(8 * b)).astype(np.uint8)
    a_byte = 8 // bits
    codes = np.zeros(-(-len(ranks) // a_byte) * a_byte, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, a_byte) << np.arange(0, 8, bits, dtype=np.uint8)
    return np.bitwise_or.reduce(codes, axis=1).astype(np.uint8).tobytes() if len(ranks) else b"", data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int, bits: int) -> np.ndarray:
    size = _TABLES[bits][np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for b in range(1, 1 << bits):
        some = np.flatnonzero(size > b)
        out[some] |= raw[at[some] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def _tokenized(docs: DataFrame, tokenizer_file: str, end_id: int, wide: bool) -> DataFrame:
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = WordTokenizer.of(tokenizer_file)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = t.encode(*buffer_of(part.column(1)))
                ids = ids.astype(kind)
                end = np.array([end_id], kind).tobytes()
                blobs = [ids[a:b].tobytes() + end for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _counts(tokens: DataFrame, vocab: int, wide: bool) -> np.ndarray:
    """Occurrences of every id over all documents; a task sends one row per id it met."""
    kind = np.uint32 if wide else np.uint16

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            col = batch.column(0)
            for at in range(0, len(col), 500):
                total += np.bincount(np.frombuffer(b"".join(col.slice(at, 500).to_pylist()), kind), minlength=vocab)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocab, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 20_000
) -> DataFrame:
    """Write the ids of all texts of ``docs`` under ``path`` and return ``(shard, file, n_docs, n_ids)``.

    Documents stand in ascending identifier order, null identifiers first, rows with the same
    identifier by a hash of their ids. Shards are ranges of that order with about ``shard_docs``
    documents each, however many rows share an identifier. Each document ends with ``end_id``; a null text is empty and gives
    that id alone. An empty table gives no shard.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bound_batches(spark)
    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True), end_id + 1)
    wide = vocab > 1 << 16
    bits = 2 if wide else 1
    kind = np.uint32 if wide else np.uint16
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = new_path(spark, "tokens")
    _tokenized(rows, tokenizer_file, end_id, wide).write.option("compression", "zstd").parquet(kept)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(kept)
    counts = _counts(tokens, vocab, wide)
    id_of = np.argsort(-counts, kind="stable").astype(np.uint32)  # the vocabulary bounds both tables
    rank_of = np.empty(vocab, np.uint32)
    rank_of[id_of] = np.arange(vocab, dtype=np.uint32)
    _put(f"{path}/ranks.ids", id_of.tobytes())
    shards = max(1, -(-tokens.count() // shard_docs))
    ranks = spark.sparkContext.broadcast(rank_of)
    order = ["doc_id", F.xxhash64("ids")]  # nulls first
    dealt = tokens.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()).sortWithinPartitions(*order)

    def save(batches):
        out = _Shards(path)
        for batch in batches:
            for shard, ident, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                r = ranks.value[np.frombuffer(blob.as_buffer(), kind)]
                if (done := out.add(shard, ident, len(r), *pack_ranks(r, bits))) is not None:
                    yield done
        if (done := out.close()) is not None:
            yield done

    listed = dealt.select("shard", "doc_id", "ids").mapInArrow(save, "shard int, file string, n_docs long, n_ids long")
    table = new_path(spark, "shards")
    listed.write.parquet(table)
    return spark.read.schema("shard int, file string, n_docs long, n_ids long").parquet(table)


class _Shards:
    """Writes rows that come sorted by shard; one file is open at a time."""

    def __init__(self, path: str):
        self.path, self.shard, self.out = path, None, None

    def add(self, shard: int, ident: int | None, n: int, control: bytes, data: bytes):
        done = None
        if shard != self.shard:
            done = self.close()
            self.shard, self.docs, self.ids = shard, 0, 0
            self.fs, self.file = _open_fs(f"{self.path}/part-{shard:06d}.ids")
            self.temp = f"{self.file}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp)
            self.out.write(MAGIC)
        self.out.write(_HEAD.pack(ident is not None, ident or 0, n, len(data)))
        self.out.write(control)
        self.out.write(data)
        self.docs += 1
        self.ids += n
        return done

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temp, self.file)
        self.out = None
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([self.shard], pa.int32()), "file": [f"{self.path}/part-{self.shard:06d}.ids"], "n_docs": pa.array([self.docs], pa.int64()), "n_ids": pa.array([self.ids], pa.int64())}
        )


def _open_fs(uri: str):
    fs, at = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:/')}")
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs, at


def _put(uri: str, content: bytes) -> None:
    fs, at = _open_fs(uri)
    with fs.open_output_stream(at) as out:
        out.write(content)


def read_shard(uri: str, id_of: np.ndarray, bits: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document identifier and ids of each record of one file, in its order."""
    fs, at = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(at, buffer_size=1 << 20) as raw:
        if raw.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        while head := raw.read(_HEAD.size):
            known, ident, n, size = _HEAD.unpack(head)
            control = raw.read(-(-n * bits // 8))
            yield (ident if known else None), id_of[unpack_ranks(control, raw.read(size), n, bits)]


def read_token_files(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, shard)`` of every document in the files, read file by file."""
    fs, at = pafs.FileSystem.from_uri(f"{path}/ranks.ids")
    with fs.open_input_stream(at) as raw:
        id_of = np.frombuffer(raw.read(), np.uint32)
    bits = 2 if len(id_of) > 1 << 16 else 1
    table = spark.sparkContext.broadcast(id_of)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches):
        for batch in batches:
            for shard, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = []
                for ident, ids in read_shard(file, table.value, bits):
                    rows.append((ident, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    many = max(1, shards.count())
    return placed.repartition(many, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


__all__ = ["WordTokenizer", "pack_ranks", "read_shard", "read_token_files", "unpack_ranks", "write_token_files"]
