"""SentencePiece encoding and decoding by an Aho-Corasick automaton that drives a Viterbi pass.

The automaton holds all pieces. It reads a text once; at each position the output links name
every piece that ends there, and each relaxes the best score of the position by the best score
at its start plus its own. A character that no piece of its own covers falls back to its UTF-8
bytes' pieces, at ten below the least piece score. The path of the best total score is the
encoding; of equal ones, that whose last piece is longest.

Spaces are written as U+2581 and one is put before the text, as the model's normaliser does
(identity otherwise). A U+2581 that the text itself has falls back to bytes, so that decoding
restores every text exactly. No piece may hold a space after another character; so a text falls
into units, each some spaces and what follows them, that are encoded alone. The distinct units of
a batch are encoded once and together, a position of all of them a step; long ones each alone, cut
further between characters that are neighbours in no piece.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import adding, slices, with_columns

#: The public vocabulary that is used unless a function is given another's path.
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units of up to so many bytes are encoded together.
SHORT = 96
#: One more than the greatest code point.
_CODES = 0x110000
#: Models up to this many pieces are sent to executors; larger ones are refused.
MOST_PIECES = 1_000_000
#: Scores of pieces that only the normaliser's rules may use; they say nothing of how likely a piece is.
_NEVER = -1e8


@dataclass
class Pieces:
    """A vocabulary: the text of each id, its score, and which ids stand for bytes."""

    texts: list[str]
    scores: list[float]
    usable: list[bool]
    bytes_: list[int]  # id of each byte value

    @staticmethod
    def load(model: str | None = None) -> Pieces:
        """The vocabulary of a model file; by default that of MODEL, where the installed tokenizers have it."""
        import sentencepiece

        if model is None:
            import public_tokenizers

            model = public_tokenizers.path(MODEL)
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        if n > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        texts = [sp.id_to_piece(i) for i in range(n)]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        at = {texts[i]: i for i in range(n) if sp.is_byte(i)}
        bytes_ = [at.get(f"<0x{b:02X}>", -1) for b in range(256)]
        if min(bytes_) < 0:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in t.lstrip(SPACE) for t, u in zip(texts, usable, strict=True) if u):
            raise ValueError("a piece holds a space after another character")
        return Pieces(texts, [sp.get_score(i) for i in range(n)], usable, bytes_)


class Codec:
    """The automaton over a vocabulary, with encoding and decoding of texts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.byte_of = {i: b for b, i in enumerate(pieces.bytes_)}
        scores = [s for s, u in zip(pieces.scores, pieces.usable, strict=True) if u and s > _NEVER]
        self.fallback = min(scores, default=0.0) - 10
        #: neighbouring characters that some piece has; between others a unit can be cut
        self.joined = {t[k : k + 2] for t, u in zip(pieces.texts, pieces.usable, strict=True) if u for k in range(len(t) - 1)}
        # goto of (node, character) as one dict; ends: (length, score, id) of the piece that ends at a node
        self.goto: dict[int, int] = {}
        ends: list[tuple[int, float, int] | None] = [None]
        below: list[list[int]] = [[]]
        for i, text in enumerate(pieces.texts):
            if not pieces.usable[i] or not text:
                continue
            node = 0
            for c in map(ord, text):
                step = node * _CODES + c
                new = self.goto.get(step)
                if new is None:
                    new = self.goto[step] = len(ends)
                    ends.append(None)
                    below.append([])
                    below[node].append(c)
                node = new
            ends[node] = (len(text), pieces.scores[i], i)
        self.fail = [0] * len(ends)
        #: all pieces that end at a node: its own, then those along its output links, longest first
        self.outputs: list[tuple[tuple[int, float, int], ...]] = [()] * len(ends)
        line = [self.goto[c] for c in below[0]]
        for node in line:
            self.outputs[node] = (ends[node],) if ends[node] else ()
        for node in line:  # breadth first: the list grows as it is read
            for c in below[node]:
                new, back = self.goto[node * _CODES + c], self.fail[node]
                while back and back * _CODES + c not in self.goto:
                    back = self.fail[back]
                self.fail[new] = self.goto.get(back * _CODES + c, 0)
                own = (ends[new],) if ends[new] else ()
                self.outputs[new] = own + self.outputs[self.fail[new]]
                line.append(new)
        # the same as arrays: goto by sorted steps, each node's own piece, and the next node along its output links that has one
        self._steps = np.array(sorted(self.goto), np.int64)
        self._after = np.array([self.goto[k] for k in self._steps.tolist()], np.int32)
        self._fail = np.array(self.fail, np.int32)
        self._length, self._score, self._id = (np.array([e[k] if e else d for e in ends], kind) for k, d, kind in ((0, 0, np.int32), (1, 0.0, np.float64), (2, -1, np.int32)))
        link = [0] * len(ends)
        for node in line:
            back = self.fail[node]
            link[node] = back if ends[back] else link[back]
        self._link = np.array(link, np.int32)
        self._bytes = np.array(pieces.bytes_, np.int32)
        # what each id stands for; in the second half without the space that a text's first piece begins with
        plain = [
            bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() if u else b""
            for i, (t, u) in enumerate(zip(pieces.texts, pieces.usable, strict=True))
        ]
        self._surfaces = pa.array(plain + [t[1:] if t[:1] == b" " else t for t in plain], pa.binary())

    def viterbi(self, unit: str) -> list[int]:
        """Ids of a unit, in which spaces are U+2581 and a U+2581 of the text is _OWN."""
        goto, fail, outputs = self.goto, self.fail, self.outputs
        n, node = len(unit), 0
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for at, c in enumerate(map(ord, unit), 1):
            while node and node * _CODES + c not in goto:
                node = fail[node]
            node = goto.get(node * _CODES + c, 0)
            top, how, single = -1e300, (1, -1), False
            for length, score, i in outputs[node]:
                total = best[at - length] + score
                if total > top:
                    top, how = total, (length, i)
                single = single or length == 1
            if not single:
                total = best[at - 1] + self.fallback
                if total > top:
                    top, how = total, (1, -1)
            best[at], back[at] = top, how
        ids: list[int] = []
        at = n
        while at:
            length, i = back[at]
            if i < 0:
                c = SPACE if unit[at - 1] == _OWN else unit[at - 1]
                ids += [self.pieces.bytes_[b] for b in reversed(c.encode("utf-8", "surrogateescape"))]
            else:
                ids.append(i)
            at -= length
        return ids[::-1]

    def _go(self, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes after reading a character each, along failure links where there is no step."""
        new, at = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(at):
            step = node.astype(np.int64) * _CODES + codes
            found = np.searchsorted(self._steps, step)
            found[found == len(self._steps)] = 0
            hit = self._steps[found] == step
            new[at[hit]] = self._after[found[hit]]
            back = ~hit & (node > 0)  # at the root nothing is left to fall back to
            at, node, codes = at[back], self._fail[node[back]], codes[back]
        return new

    def viterbi_all(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``viterbi`` of many units at once, a position of all of them a step: (ids, how many each unit has).

        codes: the units' characters, one after another; size: characters of each unit.
        """
        order = np.argsort(-size, kind="stable")
        long = size[order]
        begin = (np.cumsum(size) - size)[order]
        slot = begin + order  # a unit of n characters has n + 1 places
        best = np.zeros(len(codes) + len(size))
        length, which = np.zeros(len(best), np.int32), np.zeros(len(best), np.int32)
        node = np.zeros(len(size), np.int32)
        for t in range(int(long[0]) if len(long) else 0):
            n = int(np.searchsorted(-long, -t))  # those that go on here
            node = self._go(node[:n], codes[begin[:n] + t])
            place = slot[:n] + t + 1
            top, how, piece, single = np.full(n, -1e300), np.ones(n, np.int32), np.full(n, -1, np.int32), np.zeros(n, bool)
            at = np.where(self._id[node] >= 0, node, self._link[node])
            some = np.flatnonzero(at)
            at = at[some]
            while len(some):
                reach = self._length[at]
                total = best[place[some] - reach] + self._score[at]
                single[some[reach == 1]] = True
                better = total > top[some]
                mine = some[better]
                top[mine], how[mine], piece[mine] = total[better], reach[better], self._id[at[better]]
                at = self._link[at]
                more = at > 0
                some, at = some[more], at[more]
            total = best[place - 1] + self.fallback
            better = ~single & (total > top)
            top[better], how[better], piece[better] = total[better], 1, -1
            best[place], length[place], which[place] = top, how, piece
        # the best path, from the end: what begins at a character is written there
        begins, ids = np.zeros(len(codes), bool), np.zeros(len(codes), np.int32)
        some, at = np.arange(len(size)), long.copy()
        some, at = some[at > 0], at[at > 0]
        while len(some):
            place = slot[some] + at
            at = at - length[place]
            begins[begin[some] + at], ids[begin[some] + at] = True, which[place]
            more = at > 0
            some, at = some[more], at[more]
        first = np.flatnonzero(begins)
        ids = ids[first]
        lost = np.flatnonzero(ids < 0)  # characters that fall back to their bytes
        code = codes[first[lost]]
        code = np.where(code == ord(_OWN), ord(SPACE), code)
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        times = np.ones(len(ids), np.int64)
        times[lost] = wide
        upto = np.concatenate([[0], np.cumsum(times)])
        out = np.repeat(ids, times)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            some = wide > k
            rest = code[some] >> 6 * (wide[some] - 1 - k)
            value = rest | lead[wide[some]] if k == 0 else rest & 0x3F | 0x80
            out[upto[lost[some]] + k] = self._bytes[value]
        ends = np.searchsorted(first, np.cumsum(size))
        return out, np.diff(upto[ends], prepend=0)

    def _long(self, raw: bytes) -> list[int]:
        """Ids of a unit alone, cut between characters that are neighbours in no piece."""
        unit = raw.decode("utf-8", "surrogateescape").replace(SPACE, _OWN).replace(" ", SPACE)
        ids, at = [], 0
        for cut in range(1, len(unit) + 1):
            if cut == len(unit) or unit[cut - 1 : cut + 1] not in self.joined:
                ids += self.viterbi(unit[at:cut])
                at = cut
        return ids

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each unit has, where they begin) of distinct units: the short ones together, the others one by one."""
        size = pc.binary_length(units).to_numpy()
        try:
            text = units.filter(pa.array(size <= SHORT))
            raw = b"".join(text.to_pylist()).decode()
            chars = pc.utf8_length(text.cast(pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        except (UnicodeDecodeError, pa.ArrowInvalid):  # not UTF-8
            size = np.full(len(size), SHORT + 1)
            raw, chars = "", np.empty(0, np.int64)
        codes = np.frombuffer(raw.encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(codes == ord(SPACE), ord(_OWN), np.where(codes == 32, ord(SPACE), codes))
        ids, short = self.viterbi_all(codes, chars)
        alone = [self._long(u) for u in units.filter(pa.array(size > SHORT)).to_pylist()]
        times = np.zeros(len(size), np.int64)
        times[size <= SHORT], times[size > SHORT] = short, [len(x) for x in alone]
        begin = np.zeros(len(size), np.int64)
        found = np.concatenate([ids, *(np.array(x, np.int32) for x in alone)]).astype(np.int32)
        begin[size <= SHORT] = np.cumsum(short) - short
        begin[size > SHORT] = len(ids) + np.cumsum(times[size > SHORT]) - times[size > SHORT]
        return found, times, begin

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts: null for null, none for an empty one.

        Units are cut out of all texts at once and each distinct one is encoded once; its ids are
        then gathered wherever it stands.
        """
        texts = texts.cast(pa.binary())
        spaced = pc.binary_join_element_wise(b" ", texts, b"")
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), b"", spaced).fill_null(b"")
        ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
        lists = np.zeros(len(texts) + 1, np.int32)
        values = np.empty(0, np.int32)
        if ends[-1] > ends[0]:
            raw = np.frombuffer(spaced.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            first = raw == 32
            first[1:] &= raw[:-1] != 32
            first[ends[:-1][np.diff(ends) > 0]] = True
            starts = np.flatnonzero(first).astype(np.int32)
            bounds = pa.py_buffer(np.append(starts, np.int32(len(raw))))
            units = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
            found, size, begin = self._units(units.dictionary)
            which = units.indices.to_numpy()
            upto = np.concatenate([[0], np.cumsum(size[which])])
            values = found[np.repeat(begin[which] - upto[:-1], size[which]) + np.arange(upto[-1])]
            lists = upto[np.searchsorted(starts, ends)].astype(np.int32)
        offsets = pa.array(lists, mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)) if texts.null_count else pa.array(lists)
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, null for null; the space put before a text is taken off. Ids that stand for no text give none."""
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int32)
        offsets = offsets - offsets[0]
        ids[offsets[:-1][np.diff(offsets) > 0]] += len(self.pieces.texts)
        said = self._surfaces.take(pa.array(ids))
        ends = np.frombuffer(said.buffers()[1], np.int32)[: len(ids) + 1][offsets] if len(ids) else np.zeros(len(offsets), np.int32)
        valid = None
        if lists.null_count:
            valid = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
        return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(ends.astype(np.int32)), said.buffers()[2] or pa.py_buffer(b"")])

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.encode_all(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary())).values.to_numpy()

    def decode(self, ids) -> str:
        return self.decode_all(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py().decode("utf-8", "replace")


#: Stands for a U+2581 of the text itself while it is encoded; Spark's texts are valid UTF-8, a lone surrogate can't be in them.
_OWN = "\ud800"
_codecs: dict[int, Codec] = {}


def _codec(shipped) -> Codec:
    """The worker's automaton for a broadcast vocabulary, built once."""
    if shipped.id not in _codecs:
        _codecs.clear()
        _codecs[shipped.id] = Codec(shipped.value)
    return _codecs[shipped.id]


@dataclass
class _Shipped:
    id: int
    cast: object = field(repr=False)

    @property
    def value(self):
        return self.cast.value


def _ship(frame: DataFrame, model: str) -> _Shipped:
    cast = frame.sparkSession.sparkContext.broadcast(Pieces.load(model))  # MOST_PIECES at most
    return _Shipped(id(cast), cast)


def _text(raw: pa.Array) -> pa.Array:
    """Bytes as strings; what isn't UTF-8 becomes U+FFFD."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _encode(batches, shipped, column: str):
    codec = _codec(shipped)
    for batch in slices(batches, column):
        yield with_columns(batch, {"ids": codec.encode_all(batch.column(column))})


def _decode(batches, shipped, column: str):
    codec = _codec(shipped)
    for batch in batches:
        yield with_columns(batch, {"decoded": _text(codec.decode_all(batch.column(column)))})


def _round_trip(batches, shipped):
    codec = _codec(shipped)
    for batch in slices(batches, "text"):
        texts = batch.column("text").cast(pa.binary())
        ids = codec.encode_all(texts)
        restored = pc.fill_null(pc.equal(codec.decode_all(ids), texts), True)  # null for a null text
        sizes = pc.cast(pc.fill_null(pc.list_value_length(ids), 0), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), sizes, ids, restored], ["doc_id", "n_chars", "n_pieces", "ids", "restored"])


def encode(frame: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """frame with ids, array<int>, of the whole of column text: null for a null text, empty for an empty one.

    A column ids that frame has already is replaced; others may have any names. An empty table gives no rows.
    """
    shipped = _ship(frame, model)
    return frame.mapInArrow(lambda it: _encode(it, shipped, text), adding(frame, [("ids", T.ArrayType(T.IntegerType()))]))


def decode(frame: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """frame with decoded, the text of column ids (null for null). What encode gave is restored exactly.

    A column decoded that frame has already is replaced. Ids must be those of pieces, none of them null.
    """
    shipped = _ship(frame, model)
    return frame.mapInArrow(lambda it: _decode(it, shipped, ids), adding(frame, [("decoded", T.StringType())]))


def encoded_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_chars, n_pieces, ids, restored (decoding gives the text's bytes again).

    Texts are encoded and their ids decoded in one pass. A null text has no ids (null), 0 characters
    and pieces, and counts as restored.
    """
    shipped = _ship(docs, model)
    rows = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(lambda it: _round_trip(it, shipped), "doc_id long, n_chars long, n_pieces long, ids array<int>, restored boolean")
