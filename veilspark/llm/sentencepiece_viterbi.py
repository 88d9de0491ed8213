"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

The vocabulary is read from a model file whose path is a parameter.  Texts get a dummy blank in front, blanks become U+2581, and are
cut before each run of blanks that follows another character (no piece crosses such a place; `Vocabulary` checks it).  Distinct words are encoded once for each run of about 256 kB,
and known words are remembered in a bounded table.  Words are cut again between two characters that no piece holds side by side: no merge and
no path crosses such a place, so long text without blanks (Chinese, base64) is many short strings too.  A word of one repeated character stays whole and takes a step for each.

Search: words of equal length form a matrix of code points and advance together.  For every end position and piece length the hash of
the substring probes the sorted hashes of the pieces; the vectorised maximum over lengths is the score of the prefix
and its argument the backpointer.  For a unigram model a step adds the piece's score.  For a BPE model additive scores would not give the
model's own segmentation, so a step is allowed only if its piece is one BPE keeps whole next to the piece before it; the
sequence whose neighbours are all compatible is unique and is the BPE encoding, so every prefix has one live predecessor.
Characters without a piece fall back to byte pieces (or to the unknown piece, if the model has none).

Defined results: null text has null ids, and empty text none; decode(encode(text)) is the text, but for U+2581, which becomes a blank,
and, where the model has no byte pieces, unknown characters; rows are independent; further columns pass through (`token_ids`, `decoded` are replaced).
Pieces and remembered words are told apart by 64-bit hashes alone: two words of a worker's table are taken for one with a probability of about 1e-9 for 200,000 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import shared
from veilspark.llm.shingle_kernel import RUN_BYTES, mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_SALT = 0x9E3779B97F4A7C15
_FAR = np.int64(1) << 60
#: Words remembered by a worker; beyond that it starts anew.
KNOWN_WORDS, KNOWN_TOKENS = 200_000, 2_000_000
#: Arrow batches are handled in parts of about so many bytes.
PART_BYTES = 1 << 20


class Vocabulary:
    """Arrays of a model's pieces.  Small (a few MB); made on the driver and sent to the tasks."""

    def __init__(self, path: str = MODEL, bpe: bool | None = None) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.unk = sp.vocab_size(), sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(self.size)]
        score = np.array([sp.get_score(i) for i in range(self.size)])
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(text[i][3:5], 16)] = i
        if any(BLANK in text[i].lstrip(BLANK) for i in normal):
            raise ValueError("a piece holds a blank after another character; words can't be encoded apart")
        # The scores of a BPE model are ranks (0, -1, -2, ...), those of a unigram model logarithms.
        self.bpe = bpe if bpe is not None else bool(np.all(score[normal] == np.round(score[normal])))
        self.score = score
        self.bytes = [bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else text[i].replace(BLANK, " ").encode() for i in range(self.size)]
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes])))
        self.data = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self._split(text, score, normal)
        neighbours = {ord(a) << 21 | ord(b) for i in self.usable for a, b in zip(text[i], text[i][1:], strict=False)}
        self.neighbours = np.array(sorted(neighbours), dtype=np.int64)  # characters that some piece holds side by side
        keys = np.array([_hash_of(text[i]) for i in self.usable], dtype=_U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(self.usable, dtype=np.int64)[order]
        self.longest = max(len(text[i]) for i in self.usable)
        self.salts = np.arange(self.longest + 1).astype(_U) * _U(_SALT)
        self._index()

    def _index(self) -> None:
        """Tables by the first bits of a hash, made where they are used."""
        slots = (self.keys >> _U(42)).astype(np.int64)
        self.seen = np.zeros(1 << 22, dtype=bool)  # most substrings stop here
        self.seen[slots] = True
        self.slot = np.zeros(1 << 22, dtype=np.int32)  # place of one of a slot's keys
        self.slot[slots] = np.arange(len(self.keys))
        self.shared_slot = np.isin(slots, slots[1:][slots[1:] == slots[:-1]])  # by key: whether others have its slot
        self.asked, self.answer = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "slot", "shared_slot", "asked", "answer")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def _split(self, text: list[str], score: np.ndarray, normal: list[int]) -> None:
        """BPE: by which last merge each piece is made, and at which rank; pieces that merges can't reach are left out."""
        self.left, self.right, self.rank = (np.full(self.size + 1, -1, dtype=np.int64) for _ in range(3))
        self.rank[:] = -2
        self.usable = normal
        if not self.bpe:
            return
        by_text = {text[i]: i for i in normal}
        ranked = {i: r for r, i in enumerate(sorted((i for i in normal if len(text[i]) > 1), key=lambda i: -score[i]))}
        self.usable = []
        for i in normal:
            symbols, last = list(text[i]), None
            while len(symbols) > 1:
                best = min(((ranked[j], k) for k in range(len(symbols) - 1) if (j := by_text.get(symbols[k] + symbols[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                last = (symbols[k], symbols[k + 1])
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            if len(symbols) == 1 and (last is None or (last[0] in by_text and last[1] in by_text)):
                self.usable.append(i)
                if last:
                    self.left[i], self.right[i], self.rank[i] = by_text[last[0]], by_text[last[1]], ranked[i]
        made = [i for i in self.usable if self.left[i] >= 0]
        pair = self.left[made] * (self.size + 1) + self.right[made]
        order = np.argsort(pair)
        self.pairs, self.pair_rank = pair[order], self.rank[made][order]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1 where there is none."""
        at = self.slot[(h >> _U(42)).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero((self.keys[at] != h) & self.shared_slot[at])
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.keys, h[miss]), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_compatible`, remembered in a direct-mapped table of answers."""
        pair = a * (self.size + 1) + b
        slot = ((pair.astype(_U) * _U(_SALT)) >> _U(44)).astype(np.int64)
        good = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != pair)
        if len(new):
            good[new] = self._compatible(a[new], b[new])
            self.asked[slot[new]] = -1  # of several pairs for a slot the last stays, with its own answer
            self.asked[slot[new]], self.answer[slot[new]] = pair[new], good[new]
        return good

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the pieces `a` and `b` whole when they stand side by side.

        The last merges of both are undone, later one first; in no state may the two symbols at the boundary merge before the
        merge just undone.  The id `size` stands for a character without a piece.
        """
        good = np.ones(len(a), dtype=bool)
        live = np.flatnonzero((a < self.size) & (b < self.size))
        x, y, limit = a[live], b[live], np.full(len(live), _FAR)
        while len(live):
            pair = x * (self.size + 1) + y
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            bad = (self.pairs[at] == pair) & (self.pair_rank[at] < limit)
            good[live[bad]] = False
            undo_x = self.rank[x] > self.rank[y]
            whole = (self.left[x] < 0) & (self.left[y] < 0)
            limit = np.where(undo_x, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            more = ~bad & ~whole
            live, x, y, limit = live[more], x[more], y[more], limit[more]
        return good

    def encode_words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words given as code points, U+2581 for blanks; words of equal length advance together."""
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        pair = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        words, offsets = offsets, np.union1d(offsets, np.flatnonzero(self.neighbours[at] != pair) + 1)
        ids, sizes = self._encode_strings(points, offsets)
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(offsets, words)])

    def _encode_strings(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(offsets)
        order, pieces, sizes = [], [], []
        for n in np.unique(lengths):
            group, step = np.flatnonzero(lengths == n), max(1, 100_000 // max(1, n))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                ids, count = self._viterbi(points[offsets[part][:, None] + np.arange(n)])
                order.append(part)
                pieces.append(ids)
                sizes.append(count)
        if not order:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, ids, count = np.concatenate(order), np.concatenate(pieces), np.concatenate(sizes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        out, count = ragged(ids, np.concatenate(([0], np.cumsum(count))), place)
        return out.astype(np.int32), count

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the rows of a matrix."""
        rows, n = chars.shape
        up = _powers(n + 1)
        sums = np.zeros((rows, n + 1), dtype=_U)
        for j in range(n):
            sums[:, j + 1] = sums[:, j] * _U(_BASE) + chars[:, j].astype(_U) + _U(1)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((rows, n + 1), self.size, dtype=np.int64)
        back = np.zeros((rows, n + 1), dtype=np.int64)
        every = np.arange(rows)
        for j in range(1, n + 1):
            sizes = np.arange(min(j, self.longest), 0, -1)
            starts = j - sizes
            h = sums[:, j : j + 1] - sums[:, starts] * up[sizes] + self.salts[sizes]
            r, c = np.nonzero(self.seen[(h >> _U(42)).astype(np.int64)])
            ids = self.lookup(h[r, c])
            hit = np.flatnonzero(ids >= 0)
            r, c, ids = r[hit], c[hit], ids[hit]
            known = np.zeros(rows, dtype=bool)
            known[r[sizes[c] == 1]] = True
            live = np.isfinite(best[r, starts[c]])
            if self.bpe:
                live &= self.compatible(last[r, starts[c]], ids)
            r, c, ids = r[live], c[live], ids[live]
            score = np.full((rows, len(sizes)), -np.inf)
            score[r, c] = best[r, starts[c]] + (0.0 if self.bpe else self.score[ids])
            piece = np.full((rows, len(sizes)), self.size, dtype=np.int64)
            piece[r, c] = ids
            top = score.argmax(axis=1)
            best[:, j], last[:, j], back[:, j] = score[every, top], piece[every, top], starts[top]
            lone = np.flatnonzero(~known & ~np.isfinite(best[:, j]))
            best[lone, j], last[lone, j], back[lone, j] = best[lone, j - 1] + (0.0 if self.bpe else self.score.min() - 10), self.size, j - 1
        at, steps = np.full(rows, n), []
        while at.any():  # all words follow their backpointers together
            on = at > 0
            lone = on & (last[every, at] == self.size)
            steps.append(np.where(on, np.where(lone, -2 - chars[every, np.maximum(at - 1, 0)].astype(np.int64), last[every, at]), -1))
            at = np.where(on, back[every, at], 0)
        if not steps:
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        ids = np.stack(steps[::-1], axis=1)
        count = (ids != -1).sum(axis=1)
        flat = ids[ids != -1]
        if (flat < 0).any():
            flat, width = self._bytes_of(flat)
            edges = np.concatenate(([0], np.cumsum(width)))
            ends = np.cumsum(count)
            count = edges[ends] - edges[ends - count]
        return flat, count

    def _bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with -2 - c, for a character c without a piece, replaced by its byte pieces, and how many each became."""
        lone = ids < 0
        if self.byte_ids[0] < 0:
            return np.where(lone, self.unk, ids), np.ones(len(ids), dtype=np.int64)
        chars = (-2 - ids[lone]).astype(np.uint32)
        raw = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = np.ones(len(ids), dtype=np.int64)
        width[lone] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        out = np.repeat(ids, width)
        out[np.repeat(lone, width)] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        return out, width


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    up = np.full(n, _U(_BASE))
    up[0] = 1
    return np.multiply.accumulate(up)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
    return (h + len(piece) * _SALT) & ((1 << 64) - 1)


def ragged(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated rows data[offsets[r]:offsets[r + 1]], and their lengths."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - sizes), sizes)
    return data[at], sizes


class Encoder:
    """Encodes Arrow string columns; remembers words by their 64-bit hashes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known, self.where = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        self.tokens, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """`hashes` ascend and are new."""
        raw, sizes = ragged(data, np.stack((starts, ends), axis=1).ravel(), np.arange(0, 2 * len(starts), 2))
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(points == 0x20, np.uint32(ord(BLANK)), points)
        ids, counts = self.vocabulary.encode_words(points, lead[np.concatenate(([0], np.cumsum(sizes)))])
        first = len(self.offsets) - 1
        self.tokens = np.concatenate((self.tokens, ids))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        at = np.searchsorted(self.known, hashes)
        self.known, self.where = np.insert(self.known, at, hashes), np.insert(self.where, at, np.arange(first, first + len(hashes)))

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); every text starts with the dummy blank."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        blank = data == 0x20
        cut = blank & ~np.concatenate(([True], blank[:-1]))
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        up, down = _both(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * down[:-1], out=sums[1:])
        h = mix64((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        fresh = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != distinct) if len(self.known) else np.ones(len(distinct), bool))
        if len(fresh):
            if len(self.known) + len(fresh) > KNOWN_WORDS or len(self.tokens) > KNOWN_TOKENS:
                self.forget()
                fresh = np.arange(len(distinct))
            self._learn(distinct[fresh], data, starts[first[fresh]], ends[first[fresh]])
        rows = self.where[np.searchsorted(self.known, distinct)][inverse]
        ids, sizes = ragged(self.tokens, self.offsets, rows)
        total = np.concatenate(([0], np.cumsum(sizes)))
        edges = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(edges)

    def encode(self, column: pa.Array) -> pa.Array:
        """list<int32> of the ids; null for null."""
        whole = pc.replace_substring(column.cast(pa.large_string()), BLANK, " ")
        first = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), whole, pa.scalar("", pa.large_string()))  # the dummy blank
        text = pc.if_else(pc.equal(pc.binary_length(whole), 0), whole, first)
        text = text.fill_null("")
        _, where, data = text.buffers()
        where = np.frombuffer(where, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        ids, sizes, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(where, where[i] + RUN_BYTES, side="right")) - 1)
            a, b = self._run(data[where[i] : where[j]], where[i : j + 1] - where[i])
            ids.append(a)
            sizes.append(b)
            i = j
        edges = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        mask = pc.is_null(column) if column.null_count else None
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.concatenate(ids)), mask=mask)

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of ids, without the dummy blank; null for null."""
        v = self.vocabulary
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        data, lengths = ragged(v.data, v.offsets, flat)
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out = [t[1:] if t[:1] == b" " else t for t in texts]
        nulls = pc.is_null(lists).to_pylist() if lists.null_count else [False] * len(out)
        return pa.array([None if n else t.decode("utf-8", "replace") for n, t in zip(nulls, out, strict=True)], pa.string())


_both_cache: list[tuple[np.ndarray, np.ndarray]] = []


def _both(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if not _both_cache or len(_both_cache[0][0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _U(_BASE)), np.full(size, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _both_cache[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _both_cache[0][0][:n], _both_cache[0][1][:n]


def _mapped(rows: DataFrame, vocabulary: Vocabulary, source: str, made: list[tuple[str, T.DataType]], make, keep: list[str] | None = None) -> DataFrame:
    """`rows` with the columns `made` by make(encoder, column) for each Arrow batch."""
    shared.ship(rows.sparkSession)
    names = {n for n, _ in made}
    fields = [f for f in rows.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.lean()
        encoder = Encoder(vocabulary)
        for whole in batches:
            step = max(1, int(whole.num_rows * PART_BYTES / max(1, whole.nbytes)))  # temporaries are many times a part's size
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields] + make(encoder, batch.column(batch.schema.get_field_index(source)))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def encode(rows: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`rows` with `token_ids` array<int>."""
    return _mapped(rows, vocabulary, text, [("token_ids", T.ArrayType(T.IntegerType()))], lambda e, c: [e.encode(c)], keep)


def decode(rows: DataFrame, vocabulary: Vocabulary, token_ids: str = "token_ids") -> DataFrame:
    """`rows` with `decoded`."""
    return _mapped(rows, vocabulary, token_ids, [("decoded", T.StringType())], lambda e, c: [e.decode(c)])


def digests(rows: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns with n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 and whether decoding gave the text."""

    def make(encoder: Encoder, column: pa.Array) -> list[pa.Array]:
        ids = encoder.encode(column)
        decoded = encoder.decode(ids)
        edges, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        by_ids = [sha(flat[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        texts = [sha((t or "").encode()) for t in decoded.to_pylist()]
        return [pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), pa.array(by_ids), pa.array(texts), pc.fill_null(pc.equal(decoded, column.cast(pa.string())), True)]

    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    return _mapped(rows, vocabulary, text, made, make, keep)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return digests(docs, Vocabulary(), keep=["doc_id"])
