"""SentencePiece encoding and decoding that keeps every piece's place in the original text.

The text is normalised here, by the model's compiled character map: at each place the longest key of the map's trie
is replaced, any other character passes through; then spaces are handled as the model asks. Each byte of the normalised
text remembers the original byte where its replacement began. The merges are then done by the sentencepiece library
on the normalised text (a copy of the model whose normalizer does nothing), the pieces' lengths lay them over the
normalised bytes, and the alignment projects each piece to its span of original bytes.

The tokenizer file is a parameter, read on the driver and broadcast (half a megabyte); it is never trained.

Defined cases: null text is encoded as empty and gives no ids; texts are encoded whole, whatever their length; equal
texts give equal rows; an empty table gives no rows; extra columns are kept only if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteready.llm.tasks import map_slices
from siteready.llm.words import text_bytes

MARK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """Field number, wire type, value and byte range of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        start, key = at, varint()
        if key & 7 == 0:
            value: object = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = data[at:at + size]
            at += size
        yield key >> 3, key & 7, value, start, at


def _message(number: int, body: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3 | 2) + varint(len(body)) + body


class CharMap:
    """A compiled character map: the size of a double-array trie, the trie, then replacements ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], np.uint32).tolist() if blob else []
        self.replacements = blob[4 + size:]
        self.heads = bytes(b for b in range(256) if self.units and self._child(self._base(0), b) is not None)

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at a byte."""
        node, found, i = 0, None, at
        while i < len(data):
            node = self._child(self._base(node), data[i])
            if node is None:
                break
            i += 1
            if self.units[node] >> 8 & 1:
                start = self.units[self._base(node)] & 0x7FFFFFFF
                found = i - at, self.replacements[start:self.replacements.index(0, start)]
        return found


class Normalizer:
    """The normalizer of a model: character map, dummy prefix, removal of extra spaces, escaping of spaces."""

    def __init__(self, spec: bytes, suffix: bool = False):
        found = {f: v for f, _, v, _, _ in _fields(spec)}
        self.map = CharMap(bytes(found.get(2, b"")))
        self.prefix, self.squeeze, self.escape = (bool(found.get(f, 1)) for f in (3, 4, 5))
        self.suffix = suffix  # the model marks spaces after words
        self.heads = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in self.map.heads) + b"]") if self.map.heads else None

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes after the character map, and the original byte of each, with the end last."""
        if self.heads is None:
            return data, np.arange(len(data) + 1)
        out, origin, at = [], [], 0
        for match in self.heads.finditer(data):
            i = match.start()
            # Keys are looked up at the starts of characters that no earlier key has taken.
            if i < at or data[i] & 0xC0 == 0x80 or (found := self.map.longest(data, i)) is None:
                continue
            out += data[at:i], found[1]
            origin += np.arange(at, i), np.full(len(found[1]), i)
            at = i + found[0]
        out.append(data[at:])
        origin.append(np.arange(at, len(data) + 1))
        return b"".join(out), np.concatenate(origin)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each the original byte it comes from, with the end last."""
        done, origin = self._mapped(data)
        keep = np.ones(len(done), bool)
        space = np.frombuffer(done, np.uint8) == 32
        if self.squeeze and len(done):
            keep = ~(space & np.concatenate(([True], space[:-1])))
            last = np.flatnonzero(keep)
            if len(last) and space[last[-1]]:
                keep[last[-1]] = False
        if not keep.any():
            return b"", np.array([len(data)])
        done = np.frombuffer(done, np.uint8)[keep]
        # Where removed spaces end the text, the last piece ends before them.
        end = origin[np.flatnonzero(keep)[-1] + 1] if self.squeeze else origin[-1]
        origin = origin[:-1][keep]
        if self.prefix:
            done = np.concatenate((done, [32]) if self.suffix else ([32], done)).astype(np.uint8)
            origin = np.concatenate((origin, [end]) if self.suffix else (origin[:1], origin))
        if self.escape:
            mark = np.frombuffer(MARK.encode(), np.uint8)
            width = np.where(done == 32, len(mark), 1)
            start = np.cumsum(width) - width
            wide = np.repeat(done, width)
            for i, byte in enumerate(mark):
                wide[start[done == 32] + i] = byte
            done, origin = wide, np.repeat(origin, width)
        return done.tobytes(), np.append(origin, end)


class Pieces:
    """A model's pieces over normalised bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        plain, lengths, kinds, spec, suffix = [], [], [], b"", False
        for field, wire, value, start, end in _fields(model):
            if field == 3:
                spec = bytes(value)
                continue
            plain.append(model[start:end])
            if field == 1:
                piece = {f: v for f, _, v, _, _ in _fields(value)}
                kinds.append(piece.get(3, 1))
                lengths.append(1 if kinds[-1] == 6 else len(piece[1]))
            elif field == 2:
                suffix = bool({f: v for f, _, v, _, _ in _fields(value)}.get(24, 0))
        self.normalize = Normalizer(spec, suffix)
        # Name, no map, and no handling of spaces: this copy of the model takes its input as it is.
        plain.append(_message(3, _message(1, b"identity") + bytes([24, 0, 32, 0, 40, 0])))
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=b"".join(plain))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lengths = np.array(lengths, np.int64)
        self.unknown = self.plain.unk_id()

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, and where each piece begins and ends in the original bytes."""
        normal = [self.normalize(t) for t in texts]
        coded = self.plain.encode([n.decode() for n, _ in normal], num_threads=1)
        for (text, origin), found in zip(normal, coded):
            ids = np.array(found, np.int32)
            if self.unknown in found:
                ends = self._by_surface(text.decode())
            else:
                ends = np.cumsum(self.lengths[ids])
            starts = np.concatenate(([0], ends))[:-1].astype(np.int64)
            yield ids, origin[starts].astype(np.int32), origin[ends].astype(np.int32)

    def _by_surface(self, text: str) -> np.ndarray:
        """Ends of the pieces in bytes, for models whose unknown pieces have no length of their own."""
        widths = np.cumsum([0, *(len(c.encode()) for c in text)])
        return widths[[end for _, end in self.plain.encode(text, return_type="offset_mapping")["offsets"]]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids, num_threads=1)


def encode_decode(docs: DataFrame, model_file: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids, starts and ends (bytes of the original text, one pair for each id), decoded."""
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        pieces = Pieces(model.value)

        def code(column: pa.Array) -> list:
            data, bounds = text_bytes(column)
            found = list(pieces.encode([data[a:b - 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]))) for i in range(3)]
            return [*lists, pieces.decode([f[0].tolist() for f in found])]

        return code

    return map_slices(docs, "text", keep, "ids array<int>, starts array<int>, ends array<int>, decoded string", make)
