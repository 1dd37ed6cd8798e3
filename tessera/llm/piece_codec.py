"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A model file gives pieces and scores. A text's code points, with spaces turned into the space mark
and one mark put in front, are cut before every run of marks: no piece of the model holds a mark
after another character, which is checked when the model is read, so no best path crosses a cut.
Distinct segments of equal length advance together: at each position the hashes of all substrings
that end there are looked up among the sorted hashes of the pieces, the best step's length and
piece are kept for every segment at once, and the paths are read back together. A character that
no piece covers becomes its UTF-8 bytes, so that decoding gives every text back. A hash that hits is
followed by a comparison: of the code points for a piece, of the decoded text for known segments.

A segment of more than 64 code points is cut further between two neighbours that stand next to each
other in no piece; what is longer than 256 even so is read by itself, with the pieces in a
dictionary: the same recurrence, a few microseconds a character, whatever the length.

For a unigram model the best path has the greatest sum of scores, and of equal ones the longer last
piece. A BPE model's scores are merge priorities, not weights of a path: a path is right when no
two neighbours would have been merged otherwise. There the Viterbi step allows a piece only after
a piece with which it keeps, which leaves one path at every position, the one that merging gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import buffer_of, mix64, ragged, slices, word_hashes
from tessera.plans.batches import bound_batches

MARK = 0x2581
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = -1e300
_WIDE = 64  # a longer segment is looked through for places that no piece crosses
_ALONE = 256  # what is still longer then is read by itself
_LITERAL = 0x110000  # a space mark that stands in the text itself; it is spelled in bytes


class PieceModel:
    """Pieces of a SentencePiece model as arrays. The model is only read, never trained."""

    _made: dict[str, "PieceModel"] = {}

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, most: int = 2_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.merges = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        if spec.normalizer_spec.name != "identity" or not spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can give every text back")
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = np.full(256, -1, np.int64)
        usual = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usual.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so not every text could be given back")
        mark = chr(MARK)
        if any(a != mark and b == mark for i in usual for a, b in zip(pieces[i], pieces[i][1:])):
            raise ValueError("a piece holds a space mark inside")
        floor = min((s for s in scores[usual] if s > -1e8), default=0.0)
        self.unknown = float(floor - 10)  # score of a character that only its bytes cover
        self.first_new = n  # ids from here on stand for code points while paths are read back
        self.longest = max(len(pieces[i]) for i in usual)
        keys = np.array([self._key(np.array([ord(c) for c in pieces[i]], np.uint32)) for i in usual], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(usual)[order], scores[usual][order]
        self.table = np.zeros((len(order), self.longest), np.uint32)  # code points of each piece, in the order of the keys
        for k, i in enumerate(self.ids):
            self.table[k, : len(pieces[i])] = [ord(c) for c in pieces[i]]
        self.by_text = {pieces[i]: (i, float(scores[i])) for i in usual}
        self.spelling = {i: pieces[i] for i in usual}
        self.inside = np.unique(np.array([(ord(a) << 32) | ord(b) for i in usual for a, b in zip(pieces[i], pieces[i][1:])], np.uint64))
        self.kept_pairs: dict[tuple[int | None, int], bool] = {}
        self.marks = np.zeros(1 << 21, bool)  # leading hash bits of pieces: most substrings stop here
        self.marks[self.keys >> np.uint64(43)] = True
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.lengths = sorted({len(pieces[i]) for i in usual}, reverse=True)
        self.points = {i: np.array([ord(c) for c in pieces[i]], np.uint32) for i in usual}
        self.piece_len = np.array([len(self.points.get(i, ())) for i in range(n)])
        self.power = [np.uint64(pow(int(_BASE), i, 1 << 64)) for i in range(2 * self.longest + 1)]
        self.pairs, self.keeps = np.zeros(0, np.uint64), np.zeros(0, bool)
        text = [b"" for _ in range(n)]
        for i in usual:
            text[i] = pieces[i].replace(mark, " ").encode()
        for b, i in enumerate(self.byte_id):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_len = np.array([len(t) for t in text])
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.most = most
        self._forget()

    @staticmethod
    def _key(points: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in points:
                h = h * _BASE + np.uint64(c)
        return mix64(np.array([h ^ np.uint64(len(points) << 40)], np.uint64))[0]

    def _forget(self) -> None:
        self.known, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``points``, a matrix with one segment a row, and how many each row has."""
        rows, width = points.shape
        run = np.zeros((width + 1, rows), np.uint64)
        for j in range(width):
            run[j + 1] = run[j] * _BASE + points[:, j]
        power = self.power
        best = np.full((width + 1, rows), _NONE)
        best[0] = 0
        step = np.zeros((width + 1, rows), np.int32)
        piece = np.zeros((width + 1, rows), np.int32)
        for j in range(1, width + 1):
            alone = np.zeros(rows, bool)
            open_ = np.arange(rows)  # segments that may still get a step to this position
            for l in (x for x in self.lengths if x <= j):
                r, at = self._look_up((run[j, open_] - run[j - l, open_] * power[l]) ^ np.uint64(l << 40))
                r = open_[r]
                ok = (points[r, j - l : j] == self.table[at, :l]).all(axis=1)
                r, at = r[ok], at[ok]
                if l == 1:
                    alone[r] = True
                if self.merges:
                    ok = self._keeps(piece[j - l, r] if l < j else None, self.ids[at])
                    r, at = r[ok], at[ok]
                    best[j, r] = 0
                else:
                    score = best[j - l, r] + self.scores[at]
                    ok = score > best[j, r]
                    r, at = r[ok], at[ok]
                    best[j, r] = score[ok]
                step[j, r], piece[j, r] = l, self.ids[at]
                if self.merges and len(r):
                    open_ = open_[step[j, open_] == 0]
            score = best[j - 1] + self.unknown
            better = (score > best[j]) & ~alone  # a character that is a piece is never spelled
            best[j][better], step[j][better] = score[better], 1
            piece[j][better] = self.first_new + points[better, j - 1].astype(np.int32)
        out = np.zeros((rows, width), np.int32)
        count = np.zeros(rows, np.int64)
        at, every = np.full(rows, width), np.arange(rows)
        while (live := at > 0).any():
            r = every[live]
            out[r, count[r]] = piece[at[r], r]
            count[r] += 1
            at[r] -= step[at[r], r]
        back = ragged(np.arange(rows) * width, count)
        flipped = np.repeat(np.arange(rows) * 2 * width + count - 1, count) - back  # each row from its last entry to its first
        return out.ravel()[flipped], count

    def _look_up(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the substring hashes are pieces, and where those stand among the sorted keys."""
        h = mix64(raw)
        some = np.flatnonzero(self.marks[h >> np.uint64(43)])
        h = h[some]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return some[hit], at[hit]

    def _keeps(self, before: np.ndarray | None, after: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives these two pieces; ``None``: the piece alone."""
        if not len(after):
            return np.zeros(0, bool)
        left = np.full(len(after), self.first_new, np.int64) if before is None else np.minimum(before, self.first_new).astype(np.int64)
        pair = (left.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        new = np.unique(pair[self.pairs[at] != pair] if len(self.pairs) else pair)
        if len(new):
            if len(self.pairs) + len(new) > 2 * self.most:
                self.pairs, self.keeps, new = np.zeros(0, np.uint64), np.zeros(0, bool), np.unique(pair)
            known = self._merged((new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64))
            where = np.searchsorted(self.pairs, new)
            self.pairs, self.keeps = np.insert(self.pairs, where, new), np.insert(self.keeps, where, known)
            at = np.searchsorted(self.pairs, pair)
        return self.keeps[at]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge the characters of each pair, the best-scored neighbours first, and compare.

        A left side that is no piece (the start, or a character spelled in bytes) never merges.
        """
        out = np.zeros(len(left), bool)
        a = np.where(left < self.first_new, self.piece_len[np.minimum(left, self.first_new - 1)], 0)
        width = a + self.piece_len[right]
        for w in np.unique(width):
            for rows in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum()) * int(w) // 400_000)):
                points = np.zeros((len(rows), w), np.uint64)
                for i, r in enumerate(rows):
                    text = self.points[int(right[r])]
                    points[i, w - len(text) :] = text
                    if a[r]:
                        points[i, : a[r]] = self.points[int(left[r])]
                out[rows] = self._ends(points, a[rows])
        return out

    def _ends(self, points: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Whether merging each row leaves one piece on either side of its cut (one in all if it is 0).

        All rows are pairs of the model's own pieces, so that no text can bring about a collision here.
        """
        rows, width = points.shape
        run = np.zeros((rows, width + 1), np.uint64)
        for j in range(width):
            run[:, j + 1] = run[:, j] * _BASE + points[:, j]
        power = np.array(self.power[: width + 1], np.uint64)
        edges = np.tile(np.arange(width + 1), (rows, 1))  # token edges; unused places repeat the last one
        count = np.full(rows, width)
        live = np.arange(rows)
        while len(live):
            e = edges[live]
            m = int(count[live].max())
            if m < 2:
                break
            s, t = e[:, : m - 1], e[:, 2 : m + 1]
            real = np.arange(m - 1)[None, :] < (count[live] - 1)[:, None]
            raw = (run[live[:, None], t] - run[live[:, None], s] * power[t - s]) ^ ((t - s).astype(np.uint64) << np.uint64(40))
            some, at = self._look_up(raw.ravel())
            score = np.full(raw.size, -np.inf)
            score[some] = self.scores[at]
            score = np.where(real, score.reshape(raw.shape), -np.inf)
            pick = score.argmax(axis=1)
            go = score[np.arange(len(live)), pick] > -np.inf
            live, pick = live[go], pick[go]
            e = edges[live]
            moved = np.arange(width)[None, :] + (np.arange(width)[None, :] > pick[:, None])
            edges[live] = np.concatenate([np.take_along_axis(e, moved, axis=1), e[:, -1:]], axis=1)
            count[live] -= 1
        return np.where(cut > 0, (count == 2) & (edges[:, 1] == cut), count == 1)

    def _spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points that stand for themselves become byte ids."""
        if not (ids >= self.first_new).any():
            return ids, counts
        row = np.repeat(np.arange(len(counts)), counts)
        made, owner = [], []
        for i, r in zip(ids.tolist(), row.tolist(), strict=True):
            new = [i] if i < self.first_new else [int(self.byte_id[b]) for b in _char(i - self.first_new).encode()]
            made += new
            owner += [r] * len(new)
        return np.array(made, np.int32), np.bincount(owner, minlength=len(counts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and per text the number of its first id (one more than texts). Null counts as empty.

        Known segments are found by their hashes; a text that its ids do not give back holds one whose
        hash is another's, and is encoded again segment by segment.
        """
        buf, offs = buffer_of(texts)
        ids, first = self._encode(buf, offs, True)
        raw, o = buf.tobytes(), offs.tolist()
        wrong = [i for i, (t, a, b) in enumerate(zip(self.decode(ids, first), o[:-1], o[1:], strict=True)) if t != raw[a:b]]
        if not wrong:
            return ids, first
        runs = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for i in wrong:
            runs[i] = self._encode(buf[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i], False)[0]
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])

    def _encode(self, buf: np.ndarray, offs: np.ndarray, cached: bool) -> tuple[np.ndarray, np.ndarray]:
        filled = offs[1:] > offs[:-1]
        # in front of each text that has any, a mark
        raw = np.insert(buf, offs[:-1][filled], 0x20)
        starts = offs + np.concatenate([[0], np.cumsum(filled)])
        heads = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        upto = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(heads, dtype=np.int32, out=upto[1:])
        doc = upto[starts].astype(np.int64)
        del upto
        points[points == MARK] = _LITERAL
        points[points == 0x20] = MARK
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        mark = points == MARK
        cut = mark.copy()
        cut[1:] &= ~mark[:-1]
        cut[doc[:-1][filled]] = True
        s = np.flatnonzero(cut)
        length = np.diff(np.append(s, n))
        if (wide := length > _WIDE).any():
            at = ragged(s[wide] + 1, length[wide] - 1)
            cut[at] = ~self._crossed(points, at)
            s = np.flatnonzero(cut)
            length = np.diff(np.append(s, n))
        if not cached:
            ids, counts = self._paths(points, s, length)
            return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(s, doc)]
        u, at, back = np.unique(word_hashes(points.view(np.uint8), 4 * s, 4 * (s + length)), return_index=True, return_inverse=True)
        if len(self.known) + len(u) > self.most:
            self._forget()
        where = np.searchsorted(self.known, u)
        new = np.flatnonzero(self.known[np.minimum(where, len(self.known) - 1)] != u) if len(self.known) else np.arange(len(u))
        if len(new):
            self._learn(u[new], points, s[at[new]], length[at[new]])
            where = np.searchsorted(self.known, u)
        starts, counts, flat = self.starts[where][back], self.counts[where][back], self.flat
        ids = flat[ragged(starts, counts)]
        done = np.concatenate([[0], np.cumsum(counts)])
        return ids, done[np.searchsorted(s, doc)]

    def _crossed(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether some piece holds the code points before and at each place next to each other."""
        pair = (points[at - 1].astype(np.uint64) << np.uint64(32)) | points[at].astype(np.uint64)
        if not len(self.inside):
            return np.zeros(len(at), bool)
        return self.inside[np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)] == pair

    def _paths(self, points, s, length) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after another, and how many each has; equal lengths advance together."""
        counts = np.zeros(len(s), np.int64)
        order = np.argsort(length, kind="stable")
        width = length[order]
        found = []
        for a in np.flatnonzero(np.diff(width, prepend=-1)):
            w = int(width[a])
            rows = order[a : np.searchsorted(width, w, side="right")]
            for b in range(0, len(rows), max(1, 400_000 // w)):
                some = rows[b : b + max(1, 400_000 // w)]
                if w > _ALONE:
                    each = [self._alone(points[s[k] : s[k] + w]) for k in some]
                    ids, c = self._spell(np.concatenate(each), np.array([len(x) for x in each]))
                else:
                    ids, c = self._spell(*self.viterbi(points[s[some][:, None] + np.arange(w)[None, :]]))
                counts[some] = c
                found.append((some, ids))
        upto = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for some, ids in found:
            out[ragged(upto[some], counts[some])] = ids
        return out, counts

    def _alone(self, points: np.ndarray) -> np.ndarray:
        """The path of :meth:`viterbi` for one long segment, in time linear in its length."""
        text = points.astype("<u4").tobytes().decode("utf-32-le") if points.max() < _LITERAL else "".join(map(_char_or_none, points.tolist()))
        n = len(text)
        step, piece, best = [0] * (n + 1), [None] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            top = _NONE
            for l in self.lengths:
                if l > j or (found := self.by_text.get(text[j - l : j])) is None:
                    continue
                if self.merges:
                    if self._keeps_one(piece[j - l] if l < j else None, found[0]):
                        top, step[j], piece[j] = 0.0, l, found[0]
                        break
                elif (score := best[j - l] + found[1]) > top:
                    top, step[j], piece[j] = score, l, found[0]
            if text[j - 1] not in self.by_text and (score := best[j - 1] + self.unknown) > top:
                top, step[j], piece[j] = score, 1, self.first_new + int(points[j - 1])
            best[j] = top
        out, j = [], n
        while j:
            out.append(piece[j])
            j -= step[j]
        return np.array(out[::-1], np.int32)

    def _keeps_one(self, before: int | None, after: int) -> bool:
        before = before if before is None else min(before, self.first_new)
        key = (before, after)
        if key not in self.kept_pairs:
            if len(self.kept_pairs) > self.most:
                self.kept_pairs.clear()
            left, right = self.spelling.get(before, ""), self.spelling[after]
            self.kept_pairs[key] = self._merge(left + right) == ([left, right] if left else [right])
        return self.kept_pairs[key]

    def _merge(self, text: str) -> list[str]:
        """What is left of a short text when its best-scored neighbours are merged, the first of equal ones, until none is a piece."""
        tokens = list(text)
        while len(tokens) > 1:
            score, at = max((self.by_text.get(tokens[k] + tokens[k + 1], (0, -np.inf))[1], -k) for k in range(len(tokens) - 1))
            if score == -np.inf:
                break
            tokens[-at : 2 - at] = [tokens[-at] + tokens[1 - at]]
        return tokens

    def _learn(self, keys, points, s, length) -> None:
        ids, counts = self._paths(points, s, length)
        starts = np.cumsum(counts) - counts + len(self.flat)
        self.flat = np.concatenate([self.flat, ids]).astype(np.int32)
        where = np.searchsorted(self.known, keys)
        put = lambda old, new: np.insert(old, where, new)
        self.known, self.starts, self.counts = put(self.known, keys), put(self.starts, starts), put(self.counts, counts)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The text of each run of ids; ids without text (control and unknown pieces) give none."""
        out, at = [], 0
        while at + 1 < len(first):  # some texts at a time, for the memory
            to = max(at + 1, int(np.searchsorted(first, first[at] + 200_000, side="right")) - 1)
            some = ids[first[at] : first[to]]
            n = self.text_len[some]
            raw = self.text[ragged(self.text_at[some], n)].tobytes()
            upto = np.concatenate([[0], np.cumsum(n)])[first[at : to + 1] - first[at]].tolist()
            out += [raw[a + 1 : b] if b > a else b"" for a, b in zip(upto[:-1], upto[1:], strict=True)]
            at = to
        return out


def _char(point: int) -> str:
    return chr(MARK if point == _LITERAL else point)


def _char_or_none(point: int) -> str:
    """The character, or one that no piece holds for a space mark that stands in the text itself."""
    return "\ufffe" if point == _LITERAL else chr(point)


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again and return both.

    Columns: doc_id, n_pieces, piece_ids (array<int>), ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), n_byte_pieces (byte pieces used), round_trip (whether decoding
    gave the text back). With ``keep_columns`` all columns of ``docs`` come first, and new ones
    that clash with them get a leading underscore. A null or empty text has no pieces. Each row is
    encoded for itself, also one that repeats another's identifier or text; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    made = [("n_pieces", "long"), ("piece_ids", "array<int>"), ("ids_crc32", "long"), ("n_byte_pieces", "long"), ("round_trip", "boolean")]
    if keep_columns:
        source = docs
    else:
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = []
    for name, _ in made:
        while name in source.columns:
            name = f"_{name}"
        names.append(name)
    text_name = text_col if keep_columns else "text"
    schema = source.schema if keep_columns else source.schema["doc_id"]
    fields = list(schema.fields) if keep_columns else [schema]
    kinds = {"long": T.LongType(), "array<int>": T.ArrayType(T.IntegerType()), "boolean": T.BooleanType()}
    out_schema = T.StructType(fields + [T.StructField(n, kinds[k]) for n, (_, k) in zip(names, made, strict=True)])
    n_kept = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(model_file)
        is_byte = np.zeros(len(model.text_len), bool)
        is_byte[model.byte_id] = True
        for batch in batches:
            for part in slices(batch, text_name, 3 << 20):
                col = part.column(part.schema.get_field_index(text_name))
                ids, first = model.encode(col)
                texts = model.decode(ids, first)
                buf, offs = buffer_of(col)
                raw, o = buf.tobytes(), offs.tolist()
                same = [t == raw[a:b] for t, a, b in zip(texts, o[:-1], o[1:], strict=True)]
                bytes_upto = np.concatenate([[0], np.cumsum(is_byte[ids])])[first]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                arrays = [
                    pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())),
                    pa.array(crc, pa.int64()),
                    pa.array(np.diff(bytes_upto)),
                    pa.array(same),
                ]
                kept = [part.column(i) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays(kept + arrays, out_schema.names)

    return source.mapInArrow(run, out_schema)
