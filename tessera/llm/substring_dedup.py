"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are read in blocks of some tens of megabytes. Of each block an index is made: every run
of ``window`` consecutive words as a hash, with its reference, which is the place of the run in the
least document of the block that holds it. Indexes are sorted by hash, cut by hash range and sent as
packed arrays, so that a window costs about 10 bytes to move. Where the ranges of all blocks meet,
each block learns for which of its windows another block has a smaller document, and where.

Then every document is read again, whole, and parsed from left to right. A factor begins at the
first window that has a reference and goes on, word by word, as long as the reference does: the next
window's reference is the next place of the same document. Where it ends, the windows across the
boundary are looked up themselves, so the next factor may begin up to ``window`` - 1 words back or
go on elsewhere in another document; no repeated window is lost between two factors, as it would be
if a factor could begin only after the one before. A factor is at least ``window`` words long, and
the words of all factors are removed.

A textbook parse takes the longest match of all; this one takes the match in the least document of
the whole corpus, which needs one entry a distinct window and block instead of the reference's whole
text. The words that all factors cover are the same. Nothing is kept per document on the driver, and
the size of the index plays no part in it: a task holds one block, or one hash range of all blocks.
A passage that every document shares is one entry a block. Windows are compared by 64-bit hashes that
mix every block of their input, but have no secret key.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import buffer_of, ragged, slices, window_hashes, word_edges, word_hashes
from tessera.plans.batches import bound_batches

_LAST = np.iinfo(np.int64).max  # stands for a null identifier: no document is larger
_PACK = struct.Struct("<qIIBBBxq")
_AT_ONCE = 1 << 21  # windows that meet at a time


def pack_index(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Ascending distinct hashes as differences, with documents as places in a table and word numbers in them."""
    gaps = np.diff(h, prepend=h[:1])
    wide = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    table, place = np.unique(doc, return_inverse=True)
    kind, far = (1 if x < 1 << 8 else 2 if x < 1 << 16 else 4 for x in (len(table) - 1, int(pos.max())))
    body = b"".join(_planes(x, w) for x, w in ((gaps, wide), (place, kind), (pos, far), (table, 8)))
    return _PACK.pack(int(h[0].astype(np.int64)), len(h), len(table), wide, kind, far, 0) + body


def _planes(x: np.ndarray, wide: int) -> bytes:
    """The lowest bytes of all values, then the next: the mostly empty upper ones compress well in a shuffle."""
    return x.astype("<i8" if x.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _values(raw: bytes, at: int, n: int, wide: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T
    return out.view("<u8").ravel()


def unpack_index(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, n, docs, wide, kind, far, _ = _PACK.unpack_from(raw)
    at = _PACK.size
    h = np.cumsum(_values(raw, at, n, wide), dtype=np.uint64) + np.int64(first).astype(np.uint64)
    at += n * wide
    place = _values(raw, at, n, kind).astype(np.int32)
    at += n * kind
    pos = _values(raw, at, n, far).astype(np.int32)
    return h, _values(raw, at + n * far, docs, 8).view("<i8")[place], pos


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Block number and slices of texts; the same rows in the same order give the same blocks."""
    part, seq, held, size = 0, 0, [], 0
    for batch in batches:
        for piece in slices(batch, "text"):
            part = piece.column(2)[0].as_py()  # one task reads one partition
            held.append(piece)
            size += piece.nbytes
            if size >= block_bytes:
                yield (part << 24) + seq, held
                seq, held, size = seq + 1, [], 0
    if held:
        yield (part << 24) + seq, held


def _index(block: list[pa.RecordBatch], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes of a block, ascending, the least document of each, and the first word of it there."""
    hashes, docs, places = [], [], []
    for piece in block:
        buf, offs = buffer_of(piece.column(1))
        s, e, first = word_edges(buf, offs)
        h, at = window_hashes(word_hashes(buf, s, e), first, window)
        row = np.searchsorted(first, at, side="right") - 1
        hashes.append(h)
        docs.append(_ids(piece.column(0))[row])
        places.append((at - first[row]).astype(np.int32))
    h, d, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
    if not len(h):
        return h, d, p
    order = np.argsort(h)
    h, d, p = h[order], d[order], p[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(d, starts)
    p[d != least[np.cumsum(new) - 1]] = np.iinfo(np.int32).max
    return h[starts], least, np.minimum.reduceat(p, starts)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = 16 << 20, with_text: bool = False, with_factors: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, n_factors (and kept_text, factors).

    Removed is each word covered by ``window`` consecutive words that also start in a document with
    a smaller identifier; all is judged on the input. Words are parted by spaces and the five ASCII
    line and tab characters. ``n_factors`` counts the passages that are removed: factors that touch or
    overlap are one. ``factors`` has each one's first word, number of words, reference document and first
    word there. Rows with the same identifier don't count against each other; a null
    identifier is larger than any other. A null or empty text has no words; ``kept_sha256`` is then
    the hash of nothing. An empty table gives no rows.

    ``docs`` is read twice and has to give the same rows in the same order, as a table does; a
    block that differs raises ``ValueError``.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    ranges = max(4, 2 * source.rdd.getNumPartitions())

    def send(batches):
        for block, pieces in _blocks(batches, block_bytes):
            h, d, p = _index(pieces, window)
            cuts = np.searchsorted(h, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges))
            for r, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([block]), pa.array([pack_index(h[a:b], d[a:b], p[a:b])], pa.binary())], ["hash_range", "block", "pack"])

    packs = source.mapInArrow(send, "hash_range int, block long, pack binary").repartitionById(ranges, "hash_range").sortWithinPartitions("hash_range", "block")

    def meet(batches):
        last, held = None, []
        for batch in batches:
            for r, block, pack in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != last and held:
                    yield from _answers(held)
                    held = []
                last = r
                held.append((block, pack))
        if held:
            yield from _answers(held)

    answers = packs.mapInArrow(meet, "block long, nth int, payload binary")

    def texts(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for block, pieces in _blocks(batches, block_bytes):
            for nth, piece in enumerate(pieces):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([nth + 1], pa.int32()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], ["block", "nth", "payload"])

    both = answers.unionByName(source.mapInArrow(texts, answers.schema))
    # eight tasks a partition, each with a block of its own unless there are more; one without any costs next to nothing
    dealt = both.repartitionById(4 * ranges, F.expr("cast(8 * shiftright(block, 24) + (block & 16777215) as int)")).sortWithinPartitions("block", "nth")

    def parse(batches):
        last, known, held = None, [], []
        for batch in batches:
            for block, nth, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != last and held:
                    yield from _parsed(known, held, window, with_text, with_factors)
                    known, held = [], []
                elif block != last:
                    known = []
                last = block
                (held if nth else known).append(payload)
        if held:
            yield from _parsed(known, held, window, with_text, with_factors)

    kept = ", kept_text string" if with_text else ""
    found = ", factors array<struct<start: int, words: int, reference: long, reference_start: int>>" if with_factors else ""
    return dealt.mapInArrow(parse, f"doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long{kept}{found}")


def _answers(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Replies to the blocks that sent windows of one hash range, some two million windows at a time."""
    parts = [unpack_index(p) for _, p in held]
    count = 1 + sum(len(x[0]) for x in parts) // _AT_ONCE
    low, high = min(int(x[0][0]) for x in parts), max(int(x[0][-1]) for x in parts)
    inner = np.array([low + (high - low) * k // count for k in range(1, count)], np.uint64)
    marks = [[0, *np.searchsorted(x[0], inner).tolist(), len(x[0])] for x in parts]
    for k in range(count):
        some = [(block, [c[m[k] : m[k + 1]] for c in x]) for (block, _), x, m in zip(held, parts, marks, strict=True) if m[k + 1] > m[k]]
        if some:
            yield from _replies([block for block, _ in some], [x for _, x in some])


def _replies(blocks: list[int], parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Per block those of its hashes that start in a smaller document of another block, with their references.

    A reply begins with the number of hashes the block sent, by which its reader checks the block.
    """
    sizes = np.array([len(x[0]) for x in parts])
    h, d, pos = (np.concatenate([x[i] for x in parts]) for i in range(3))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    sorted_d = d[order]
    least = np.minimum.reduceat(sorted_d, starts)[group]
    source = np.minimum.reduceat(np.where(sorted_d == least, order, len(h)), starts)  # the entry that each group refers to
    some = np.flatnonzero(sorted_d > least)
    beaten, source = order[some], source[group[some]]
    arranged = np.lexsort((h[beaten], owner[beaten]))
    beaten, source = beaten[arranged], source[arranged]
    marks = np.searchsorted(owner[beaten], np.arange(len(blocks) + 1))
    for i, block in enumerate(blocks):
        mine, to = beaten[marks[i] : marks[i + 1]], source[marks[i] : marks[i + 1]]
        body = pack_index(h[mine], d[to], pos[to]) if len(mine) else b""
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.array([struct.pack("<q", int(sizes[i])) + body], pa.binary())], ["block", "nth", "payload"])


def _parsed(known: list[bytes], held: list[bytes], window: int, with_text: bool, with_factors: bool) -> Iterator[pa.RecordBatch]:
    grow = zstandard.ZstdDecompressor()
    pieces = [pa.ipc.open_stream(grow.decompress(p)).read_next_batch() for p in held]
    own, reference, reference_at = _index(pieces, window)
    if len(own) != sum(struct.unpack_from("<q", k)[0] for k in known):
        raise ValueError("the documents came in another order the second time; write them to a table first")
    for k in known:
        if len(k) > 8:
            h, d, p = unpack_index(k[8:])
            at = np.searchsorted(own, h)
            reference[at], reference_at[at] = d, p
    for piece in pieces:
        buf, offs = buffer_of(piece.column(1))
        s, e, first = word_edges(buf, offs)
        h, at = window_hashes(word_hashes(buf, s, e), first, window)
        ids = _ids(piece.column(0))
        doc = np.searchsorted(first, at, side="right") - 1
        place = np.searchsorted(own, h)
        hit = np.flatnonzero(reference[place] < ids[doc]) if len(h) else at
        at, doc, to, to_at = at[hit], doc[hit], reference[place[hit]], reference_at[place[hit]]
        # a factor goes on while the next window's reference is the next place of the same document
        begins = np.ones(len(at), bool)
        begins[1:] = (np.diff(at) != 1) | (np.diff(to) != 0) | (np.diff(to_at) != 1)
        f = np.flatnonzero(begins)
        words = np.diff(np.append(f, len(at))) - 1 + window
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, at[f], 1)
        np.subtract.at(cover, at[f] + words, 1)
        gone = np.cumsum(cover[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        passage = gone.copy()
        passage[1:] &= ~gone[:-1]
        passage[first[:-1][first[:-1] < len(s)]] |= gone[first[:-1][first[:-1] < len(s)]]
        passages = np.concatenate([[0], np.cumsum(passage)])
        stay = np.flatnonzero(~gone)
        length = e[stay] - s[stay] + 1  # each word with one space
        raw = np.append(buf, np.uint8(0x20))[ragged(s[stay], length)]
        raw[np.cumsum(length) - 1] = 0x20
        edge = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(stay, first)].tolist()
        text = raw.tobytes()
        texts = [text[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)]
        arrays = [
            piece.column(0),
            pa.array(np.diff(first)),
            pa.array(upto[first[1:]] - upto[first[:-1]]),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            pa.array(passages[first[1:]] - passages[first[:-1]]),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"]
        if with_text:
            arrays.append(pa.array([t.decode() for t in texts], pa.string()))
            names.append("kept_text")
        if with_factors:
            fields = [(at[f] - first[doc[f]]).astype(np.int32), words.astype(np.int32), to[f], to_at[f]]
            made = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "words", "reference", "reference_start"])
            arrays.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[f], np.arange(len(ids) + 1)).astype(np.int32)), made))
            names.append("factors")
        yield pa.RecordBatch.from_arrays(arrays, names)
