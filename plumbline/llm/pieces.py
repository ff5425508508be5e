"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

The pieces and scores come from a model file.  A text gets a leading space, and spaces stand for the model's
word mark.  It is cut where no piece of the model can span the cut: before a space that follows another character, and around
characters that occur in no longer piece.  Words with equally many characters advance together: at each character, the hashes of
all substrings that end there probe the sorted hashes of the pieces, the best sum of scores is a maximum over
them, and its length is the backpointer.  Equal sums keep the longest last piece.  A character without a
piece of its own costs ``UNKNOWN`` less than the worst score and becomes byte pieces (or the unknown id).  Each distinct word is
searched once per worker.

That is the meaning of a model of the unigram kind.  In a model file of the BPE kind the scores are ranks of merges, and the best sum
of ranks is not what the model means (it agrees on 42 % of the distinct words of the test texts).  For such a file
the same batches and the same probes feed merges instead: in each step every word joins its adjacent pair of highest
score, the leftmost of equals.  Ids then equal the library's.  ``method`` chooses; by default the file's kind does.

Only identity normalisation is supported (what the public model has).  Cases: null gives null ids; an empty text
has no ids; repeated rows encode alike; a literal word mark U+2581 in a text is a space to the model, as in the library; long texts and
long words are whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import blocks as B

MARK = "▁"
UNKNOWN = 10.0
#: Words searched together.
TOGETHER = 8192
#: Bytes of texts encoded and decoded together where ids are kept: the working memory is some hundred bytes for each.
CODED_BYTES = 1 << 19
_MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
_models: dict[str, Coder] = {}


@dataclass
class Pieces:
    """What the model file holds: the bytes of each piece (spaces for marks), its score and its kind."""

    texts: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int
    kind: str = "unigram"
    prefix: bool = True

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = len(sp)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        fallback = all(sp.is_byte(int(i)) for i in byte_ids)
        texts = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        if fallback:
            for b, i in enumerate(byte_ids):
                texts[i] = bytes([b])
        normal = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        for i in np.flatnonzero(~normal):
            if sp.is_control(int(i)):
                texts[i] = b""
            elif sp.is_unknown(int(i)):
                texts[i] = " ⁇ ".encode()
        scores = np.array([sp.get_score(i) for i in range(n)])
        # ranks of merges are whole numbers, log probabilities are not
        ranks = bool((scores[normal] == np.round(scores[normal])).all())
        return Pieces(texts, scores, normal, byte_ids if fallback else None, sp.unk_id(), "bpe" if ranks else "unigram")


class Coder:
    def __init__(self, pieces: Pieces, method: str | None = None):
        self.pieces = pieces
        self.advance = self._merge if (method or pieces.kind) == "bpe" else self._advance
        ids = np.flatnonzero(pieces.normal)
        ids = ids[[len(pieces.texts[i]) > 0 for i in ids]]
        flat = b"".join(pieces.texts[i] for i in ids)
        ends = np.cumsum([len(pieces.texts[i]) for i in ids])
        starts = ends - [len(pieces.texts[i]) for i in ids]
        keys = B.span_hashes(np.frombuffer(flat, np.uint8), starts, ends)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        self.key_scores = pieces.scores[self.key_ids]
        self.worst = float(self.key_scores.min()) - UNKNOWN if len(ids) else -UNKNOWN
        words = [pieces.texts[i].decode() for i in ids]
        self.longest = max(map(len, words), default=1)
        joined = set("".join(w for w in words if len(w) > 1))
        #: ASCII characters in no piece of several characters
        self.alone = np.array([b < 128 and chr(b) not in joined for b in range(256)])
        self.memory = B.Memory()
        every = np.array([len(t) for t in pieces.texts])
        self.surface = np.frombuffer(b"".join(pieces.texts), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum(every)])

    def marked(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with a leading space for each text that is not empty, marks as spaces, and their bounds."""
        data, at = block.data, block.offsets
        if len(data) > 2:
            marks = np.flatnonzero((data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2]))
            if len(marks):
                keep = np.ones(len(data), bool)
                keep[marks + 1] = keep[marks + 2] = False
                data = data.copy()
                data[marks] = 0x20
                at = np.concatenate([[0], np.cumsum(keep)])[at]
                data = data[keep]
        real = (np.diff(at) > 0) & self.pieces.prefix
        data = np.insert(data, at[:-1][real], 0x20)
        return data, at + np.concatenate([[0], np.cumsum(real)])

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and their bounds."""
        data, at = self.marked(block)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        space = data == 0x20
        cut[1:-1] = space[1:] & ~space[:-1]
        alone = self.alone[data]
        cut[:-1] |= alone
        cut[1:] |= alone
        cut[at] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        sums = B.prefix_sums(data)
        ids, to = self.memory.spread(
            B.spans_of(sums, starts, ends), lambda first: self._search(data, sums, starts[first], ends[first]))
        return ids, to[np.searchsorted(starts, at)]

    def _search(self, data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word."""
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        low, high = np.searchsorted(heads, starts), np.searchsorted(heads, ends)
        heads = np.append(heads, len(data))
        size = high - low
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts):
            for k in range(0, len(group), TOGETHER):
                own = group[k:k + TOGETHER]
                self.advance(data, sums, heads, low[own], int(size[own[0]]), own, found)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.fromiter(map(len, found), np.int64, len(found))

    def _advance(self, data, sums, heads, low, n, own, found) -> None:
        width = len(own)
        rows = np.arange(width)
        best = np.zeros((width, n + 1))
        back = np.zeros((width, n + 1), np.int64)
        piece = np.zeros((width, n + 1), np.int64)
        for j in range(1, n + 1):
            k = np.arange(min(j, self.longest), 0, -1)
            begin = heads[low[:, None] + j - k]
            end = heads[low + j]
            ids, score = self._probe(sums, begin, np.broadcast_to(end[:, None], begin.shape))
            score[:, -1] = np.where(ids[:, -1] < 0, self.worst, score[:, -1])
            total = score + best[:, j - k]
            top = total.argmax(1)
            best[:, j], back[:, j], piece[:, j] = total[rows, top], k[top], ids[rows, top]
        steps = []
        place = np.full(width, n)
        while (place > 0).any():
            steps.append((np.where(place > 0, piece[rows, place], -2), place))
            place = place - np.where(place > 0, back[rows, place], 0)
        tokens = np.stack([s[0] for s in steps[::-1]], 1)
        where = np.stack([s[1] for s in steps[::-1]], 1)
        self._put(data, heads, low, own, tokens, where, found)

    def _probe(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the pieces at these byte spans."""
        h = B.spans_of(sums, begin.ravel(), end.ravel())
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        return (np.where(hit, self.key_ids[at], -1).reshape(begin.shape),
                np.where(hit, self.key_scores[at], -np.inf).reshape(begin.shape))

    def _merge(self, data, sums, heads, low, n, own, found) -> None:
        bounds = low[:, None] + np.arange(n + 1)  # symbols of each word, in characters
        pairs = self._probe(sums, heads[bounds[:, :-2]], heads[bounds[:, 2:]])[1]
        while len(own):
            width, m = bounds.shape[0], bounds.shape[1] - 1
            done = ~np.isfinite(pairs).any(1) if m > 1 else np.ones(width, bool)
            if done.any():
                b = bounds[done]
                ids = self._probe(sums, heads[b[:, :-1]], heads[b[:, 1:]])[0]
                self._put(data, heads, low[done], own[done], ids, b[:, 1:] - low[done][:, None], found)
                bounds, pairs, low, own = bounds[~done], pairs[~done], low[~done], own[~done]
                continue
            rows = np.arange(width)
            top = pairs.argmax(1)
            keep = np.ones(bounds.shape, bool)
            keep[rows, top + 1] = False
            bounds = bounds[keep].reshape(width, m)
            keep = np.ones(pairs.shape, bool)
            keep[rows, top] = False
            pairs = pairs[keep].reshape(width, m - 2)
            for place in (top - 1, top):  # the pairs to the left and right of the joined symbol
                ok = np.flatnonzero((place >= 0) & (place < m - 2))
                at = place[ok]
                pairs[ok, at] = self._probe(sums, heads[bounds[ok, at]], heads[bounds[ok, at + 2]])[1]

    def _put(self, data, heads, low, own, tokens, where, found) -> None:
        """Store each row's ids; ``where`` is the end of each in characters.  -2: no token, -1: a character without a piece."""
        plain = (tokens >= 0).all(1)
        for r, word in enumerate(own):
            if plain[r]:
                found[word] = tokens[r]
                continue
            real = tokens[r] != -2
            parts = []
            for i, p in zip(tokens[r][real], where[r][real]):
                span = data[heads[low[r] + p - 1]:heads[low[r] + p]]
                if i >= 0:
                    parts.append([i])
                else:
                    parts.append(self.pieces.byte_ids[span] if self.pieces.byte_ids is not None else [self.pieces.unknown])
            found[word] = np.concatenate(parts)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Bytes of each id sequence, without the leading space."""
        lengths = self.surface_at[ids + 1] - self.surface_at[ids]
        to = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.surface[np.repeat(self.surface_at[ids] - to[:-1], lengths) + np.arange(to[-1])].tobytes()
        spans = [flat[a:b] for a, b in zip(to[at[:-1]], to[at[1:]])]
        return [s[1:] if self.pieces.prefix and s[:1] == b" " else s for s in spans]


def coder(path: str) -> Coder:
    """The coder of this worker process, kept between tasks."""
    if path not in _models:
        _models[path] = Coder(Pieces.load(path))
    return _models[path]


def encode_udf(path: str):
    """Column function: text to ``array<int>``."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        got = [coder(path).encode(b) for b in B.blocks(texts)]
        counts = np.concatenate([np.diff(at) for _, at in got]) if got else np.zeros(0, np.int64)
        flat = np.concatenate([ids for ids, _ in got]) if got else np.zeros(0, np.uint32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int32)), mask=mask)

    return encode


def decode_udf(path: str):
    """Column function: ``array<int>`` to text; bytes that are no UTF-8 become replacement characters."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        rows = lists.to_pylist()
        ids = np.array([i for r in rows if r for i in r if i is not None], np.int64)
        at = np.concatenate([[0], np.cumsum([sum(i is not None for i in r or []) for r in rows])]).astype(np.int64)
        return pa.array([None if r is None else t.decode("utf-8", "replace")
                         for r, t in zip(rows, coder(path).decode(ids, at))], pa.string())

    return decode


def coded_udf(path: str):
    """Column function: text to ``ids`` and ``round_trip``, whether decoding them gives the text back (marks read as spaces); both
    null for a null text."""

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def coded(texts: pa.Array) -> pa.Array:
        own, flat, counts, same = coder(path), [], [], []
        for block in B.blocks(texts, CODED_BYTES):
            ids, at = own.encode(block)
            data = block.data.tobytes()
            flat.append(ids)
            counts.append(np.diff(at))
            same.extend(t == data[a:b].replace(MARK.encode(), b" ") for t, a, b in zip(
                own.decode(ids.astype(np.int64), at), block.offsets[:-1], block.offsets[1:]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], names=["ids", "round_trip"],
                                          mask=texts.is_null() if texts.null_count else None)

    return coded


def check_udf(path: str):
    """Column function: text to ``n_tokens, ids_crc32`` (ids as 32-bit little-endian) and ``round_trip``, whether the decoded ids give
    the text back."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_crc32:bigint,round_trip:boolean>")
    def check(texts: pa.Array) -> pa.Array:
        n, crc, same = [], [], []
        own = coder(path)
        for block in B.blocks(texts):
            ids, at = own.encode(block)
            raw, data = ids.astype("<u4"), block.data.tobytes()
            n.extend(np.diff(at).tolist())
            crc.extend(zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:]))
            same.extend(t == data[a:b].replace(MARK.encode(), b" ") for t, a, b in zip(
                own.decode(ids.astype(np.int64), at), block.offsets[:-1], block.offsets[1:]))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
            names=["n_tokens", "ids_crc32", "round_trip"])

    return check
