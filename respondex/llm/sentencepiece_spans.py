"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

The text is normalised the way the model's compiled character map asks for:
at each position the longest prefix the map knows is replaced, anything else
is kept, and every normalised byte remembers the original byte it came from.
Pieces tile the normalised text, so their lengths in bytes lead from piece to
normalised span and through the alignment to the span in the original text.
Ids come from the sentencepiece library, texts back from its ``decode``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from respondex.llm.base import slices

SPACE = "▁"
#: Segments remembered by a task; the memory is emptied when full, which changes no result.
CACHE_SEGMENTS = 150_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes whose values point into a pool of replacements."""

    def __init__(self, compiled: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.pool = compiled[4 + size :]

    def longest_prefix(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at ``start`` and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= _child(self.units[0])
        for at in range(start, len(data)):
            node ^= data[at]
            unit = self.units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= _child(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = at + 1 - start, self.pool[value : self.pool.index(b"\0", value)]
        return found


def _child(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class SpanEncoder:
    """Encoder and decoder of one model; ``model`` is the file's content."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        described = proto.ModelProto()
        described.ParseFromString(model)
        self.rules, kinds = described.normalizer_spec, proto.ModelProto.SentencePiece
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        if described.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that put the space after the word are not supported")
        self.user_symbols = sorted((p.piece.encode() for p in described.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in described.pieces], dtype=np.int64)
        self.unknown = self.library.unk_id()
        crosses = re.compile(f"[^{SPACE}]{SPACE}")
        #: No piece goes on over the start of a word, so words can be merged apart from each other.
        self.by_word = (
            described.trainer_spec.model_type == described.trainer_spec.BPE
            and not self.map.units and not self.user_symbols
            and self.rules.add_dummy_prefix and self.rules.escape_whitespaces and not self.rules.remove_extra_whitespaces
            and not any(crosses.search(p.piece) for p in described.pieces if p.type == kinds.NORMAL)
        )
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for the end the offset in the original bytes."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.user_symbols and self.rules.escape_whitespaces and not self.rules.remove_extra_whitespaces:
            raw = np.frombuffer(data, dtype=np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            prefix = SPACE.encode() if self.rules.add_dummy_prefix else b""
            return prefix + data.replace(b" ", SPACE.encode()), np.concatenate([np.zeros(len(prefix), dtype=np.int64), align, [len(raw)]])
        return self._normalise_by_map(data)

    def _normalise_by_map(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE.encode() if self.rules.escape_whitespaces else b" "
        parts: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(data):
            symbol = next((s for s in self.user_symbols if data.startswith(s, at)), None)
            if symbol is not None:
                parts.append((at, at + len(symbol), symbol))
            elif found := self.map.longest_prefix(data, at):
                parts.append((at, at + found[0], found[1]))
            else:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                parts.append((at, at + width, data[at : at + width]))
            at = parts[-1][1]
        out, align = bytearray(), []
        squeeze = self.rules.remove_extra_whitespaces
        if squeeze:
            while parts and parts[0][2].strip(b" ") == b"":
                parts.pop(0)
        if not parts:
            return b"", np.array([len(data)], dtype=np.int64)
        if self.rules.add_dummy_prefix:
            out += space
            align += [parts[0][0]] * len(space)
        after_space, end = squeeze, parts[0][0]
        for start, stop, piece in parts:
            if squeeze and after_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                cooked = space if byte == 32 else bytes([byte])
                out += cooked
                align += [start] * len(cooked)
            if piece:
                after_space = squeeze and piece.endswith(b" ")
            end = stop
        if squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = align[-1]
                del align[-len(space) :]
        return bytes(out), np.array([*align, end], dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        """The library's ids. Words seen before come from memory where that cannot change them."""
        if not self.by_word or SPACE in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return self.library.encode(text)
        words = text.split(" ")
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(fresh) > CACHE_SEGMENTS:
            known.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            known.update(zip(fresh, self.library.encode(fresh, num_threads=1)))
        out: list[int] = []
        for w in words:
            out += known[w]
        return out

    def offsets(self, text: str, ids: list[int]) -> np.ndarray:
        """n + 1 byte offsets: piece i stands for original bytes ``offsets[i]`` to ``offsets[i + 1]``."""
        normal, align = self.normalise(text)
        lengths = self.lengths[np.array(ids, dtype=np.int64)]
        if self.unknown in ids:
            shown = self.library.encode(text, return_type="proto").pieces
            lengths = np.array([1 if re.fullmatch("<0x[0-9A-F]{2}>", p.piece) else len(p.piece.encode()) for p in shown], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if ends[-1] != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        return align[ends]

    def decode(self, many: list[list[int]]) -> list[str]:
        return self.library.decode(many, num_threads=1)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, offsets, decoded`` for every row, over whole texts.

    ``offsets`` has one entry more than ``ids``: piece i stands for the UTF-8
    bytes from ``offsets[i]`` to ``offsets[i + 1]`` of the original text; the
    pieces of a byte-fallback character share it out byte by byte. Null and
    empty texts give no ids, offsets [0] and an empty decoded text. Rows keep
    null and repeated ids; other columns are ignored. The model is read on the
    driver (its file is a fixed input, about half a megabyte) and broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder(model.value)
        for part in slices(batches, text_col, 1 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = [encoder.ids(t) for t in texts]
            spans = [encoder.offsets(t, i) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists([np.array(i, dtype=np.int32) for i in ids]), _lists(spans), pa.array(encoder.decode(ids), pa.string())],
                names=[id_col, "ids", "offsets", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
