"""Offset-preserving SentencePiece encoding and decoding."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_MARK = MARK.encode()


class CharMap:
    """A model's compiled character map: a double array of byte prefixes and their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.text = np.empty(0, np.uint32), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4")
            self.text = blob[4 + n :]
        self.list = self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest entry that ``data`` has at ``at``; length 0: none."""
        units = self.list
        if not units:
            return 0, b""
        found, value = 0, 0
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return (found, self.text[value : self.text.index(b"\0", value)]) if found else (0, b"")


def _offset(unit: int) -> int:
    return unit >> 10 << (unit >> 6 & 8)


class Normalizer:
    """Normalises UTF-8 as a model asks for and keeps, for each byte, where in the source it comes from."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharMap(blob)
        self.dummy, self.squeeze, self.escape = dummy_prefix, squeeze, escape

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised, source): byte k of the result begins at source[k]; the last entry is the end."""
        if not self.map.list and not self.squeeze:
            return self._plain(data)
        space = _MARK if self.escape else b" "
        parts, source, at = [], [], 0
        pieces = []
        while at < len(data):
            n, to = self.map.longest(data, at)
            if not n:
                n = min(_width(data[at]), len(data) - at)
                to = data[at : at + n]
            pieces.append((at, to))
            at += n
        end = len(data)
        if self.squeeze:
            while pieces and pieces[0][1].strip(b" ") == b"":
                pieces.pop(0)
        if not pieces:
            return b"", np.zeros(1, np.int64)
        if self.dummy:
            parts.append(space)
            source += [pieces[0][0]] * len(space)
        spaced = self.squeeze
        for at, to in pieces:
            if spaced:
                to = to.lstrip(b" ")
            if not to:
                continue
            out = to.replace(b" ", space)
            parts.append(out)
            source += [at] * len(out)
            spaced = self.squeeze and to.endswith(b" ")
        text = b"".join(parts)
        while self.squeeze and text.endswith(space) and text:
            text = text[: -len(space)]
            end = source[len(text)]
        return text, np.array([*source[: len(text)], end], np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        space = _MARK if self.escape else b" "
        raw = np.frombuffer(data, np.uint8)
        source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(space), 1))
        source = np.r_[np.zeros(len(space) * self.dummy, np.int64), source, len(raw)]
        return space * self.dummy + data.replace(b" ", space), source


def _width(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Encoder:
    """Encodes as the sentencepiece library does, with the source bytes of each piece.

    Where a vocabulary has no piece that goes on over a space, a text's pieces are those of its words one
    after the other. Then the library encodes each distinct word once and its pieces are kept (at most
    ``keep`` words); texts with doubled, leading or trailing spaces or a literal space mark, and models with
    any other vocabulary, go through the library whole.
    """

    def __init__(self, model_file: str, keep: int = 700_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = pb.ModelProto.FromString(self.lib.serialized_model_proto())
        n = spec.normalizer_spec
        self.normal = Normalizer(n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)
        self.byte = spec.trainer_spec.byte_fallback
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        across = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        self.wordwise = plain and self.byte and not across and not any(p.type == 4 for p in spec.pieces)  # 4: user defined
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in spec.pieces], np.int32)  # 6: a byte
        self.marked = np.array([p.piece.startswith(MARK) for p in spec.pieces], bool)
        self.decimal = [str(k) for k in range(len(spec.pieces))]
        self.words: dict[str, bytes] = {}
        self.keep = keep

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of a whole text, as int32."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.wordwise and bool(t) and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        split = [t.split(" ") if p else [] for t, p in zip(texts, plain)]
        if len(self.words) > self.keep:
            self.words.clear()
        words = self.words
        self._learn(list({w for parts in split for w in parts if w not in words}))
        whole = iter(self.lib.encode([t for t, p in zip(texts, plain) if not p], num_threads=1))
        return [np.frombuffer(b"".join([words[w] for w in parts]), np.int32) if p else np.array(next(whole), np.int32) for parts, p in zip(split, plain)]

    def _learn(self, new: list[str]) -> None:
        """Encode words together, as one text: a word begins with the one piece that has a space mark. Where that does not part them, each goes alone."""
        for k in range(0, len(new), 512):
            some = new[k : k + 512]
            ids = np.array(self.lib.encode(" ".join(some)), np.int32)
            cut = [*np.flatnonzero(self.marked[ids]).tolist(), len(ids)]
            if len(cut) != len(some) + 1:
                self.words.update(zip(some, [np.array(x, np.int32).tobytes() for x in self.lib.encode(some, num_threads=1)]))
                continue
            for w, i, j in zip(some, cut, cut[1:]):
                self.words[w] = ids[i:j].tobytes()

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(pieces, 2): begin and end in the text's UTF-8 of each piece of ``ids``.

        The text is normalised with its alignment; pieces lie one after the other in the normalised text and are projected
        to the source. Should they not add up to it, the library's own offsets are taken.
        """
        if not len(ids):
            return np.empty((0, 2), np.int64)
        normal, source = self.normal(text.encode())
        size = self.size[ids]
        if not self.byte and (ids == self.lib.unk_id()).any():
            size = self._unknown(text, ids, len(normal))
        end = np.cumsum(size)
        if end[-1] != len(normal):
            return self._library_spans(text)
        return np.column_stack([source[end - size], source[end]])

    def _library_spans(self, text: str) -> np.ndarray:
        return np.array([[p.begin, p.end] for p in self.lib.encode(text, return_type="proto").pieces], np.int64).reshape(-1, 2)

    def _unknown(self, text: str, ids: np.ndarray, total: int) -> np.ndarray:
        got = self.lib.encode(text, out_type=str)  # an unknown piece is returned as its text
        return np.array([self.size[i] if i != self.lib.unk_id() else len(p.encode()) for i, p in zip(ids.tolist(), got)], np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def _encoded(e: Encoder, column):
    """(text, ids), encoded some hundred texts at a time."""
    for k in range(0, len(column), 200):
        texts = [t or "" for t in column.slice(k, 200).to_pylist()]
        yield from zip(texts, e.ids_of(texts))


_KEPT: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """The encoder of this process: loaded once, its words kept between tasks."""
    if model_file not in _KEPT:
        _KEPT[model_file] = Encoder(model_file)
    return _KEPT[model_file]


def encode(docs: DataFrame, model_file: str, with_arrays: bool = True) -> DataFrame:
    """Encode and decode each text of ``docs`` (doc_id, text); null counts as the empty text, which has no ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, covered (every source byte lies in a piece's span, in order), offsets_crc32 (of all
    begins, then all ends, as little-endian 64-bit integers) and, with
    ``with_arrays``, ids, begins and ends (UTF-8 offsets of each piece in the source) and decoded. Texts are
    never cut; an empty table gives an empty result; repeated rows each return; other columns are ignored. ``model_file`` must exist on executors.
    """

    def run(batches):
        e = encoder(model_file)
        for b in batches:
            rows = []
            for text, ids in _encoded(e, b.column(1)):
                spans = e.spans(text, ids)
                covered = bool(not len(spans) or (spans[0, 0] == 0 and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] <= spans[:-1, 1]).all()))
                listed = ids.tolist()
                decoded = e.decode(listed)
                row = [len(listed), hashlib.sha256(",".join([e.decimal[k] for k in listed]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest(), covered, zlib.crc32(spans.T.astype("<i8").tobytes())]
                rows.append(row + [listed, spans[:, 0], spans[:, 1], decoded] if with_arrays else row)
            cols = [b.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered", "offsets_crc32"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered boolean, offsets_crc32 long"
    if with_arrays:
        names += ["ids", "begins", "ends", "decoded"]
        kinds += [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        schema += ", ids array<int>, begins array<long>, ends array<long>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
