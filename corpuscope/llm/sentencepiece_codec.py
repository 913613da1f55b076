"""SentencePiece encoding with exact source offsets, and decoding.

The normaliser is the compiled character map of the model file: a double-array trie of prefixes and the strings that
replace them. At each place the longest prefix in the trie wins; what the trie doesn't know stays, one character at a time.
Every byte of the normalised text remembers the source byte it came from, so that every piece of the encoding projects to
a byte span of the original. All rows are made from such pieces: pieces must spell the normalised text byte by byte, and
the ids of pieces that were met word by word must be those of the sentencepiece library for the whole text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import slices

SPACE = "▁"
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
_CODECS: dict[str, Codec] = {}


class CharacterMap:
    """A compiled character map: 4 bytes of trie size, the trie's 32-bit units, then replacement strings that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[at:]`` and what replaces it."""
        if not self.units:
            return None
        found, units = None, self.units
        node = _jump(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= _jump(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


def _jump(unit: int) -> int:
    """Distance to a trie node's children: 22 bits, shifted by 8 more if bit 9 is set."""
    return unit >> 10 << ((unit & 1 << 9) >> 6)


@dataclass
class Codec:
    """One model: its normaliser settings, the library's processor, and ids of words met."""

    path: str
    known: dict[str, bytes | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        own = [p for p in proto.pieces if p.type == proto.SentencePiece.USER_DEFINED]
        self.user = sorted((p.piece.encode() for p in own), key=len, reverse=True)
        across = re.compile(f"[^{SPACE}]{SPACE}")
        # words may be encoded one by one if no piece reaches over the start of a word and spaces are kept as they are
        self.by_word = self.prefix and self.escape and not (self.trim or self.suffix or own or self.map.units or any(across.search(p.piece) for p in proto.pieces))
        self.spelled = [self._spelling(i) for i in range(self.sp.vocab_size())]
        self.widths = np.asarray([len(x) for x in self.spelled], np.int64)
        self.ends = np.asarray([self.sp.bos_id()], "<u4").tobytes(), np.asarray([self.sp.eos_id()], "<u4").tobytes()

    def _spelling(self, number: int) -> bytes:
        """The normalised bytes that a piece stands for; the unknown piece has none of its own."""
        if self.sp.is_byte(number):
            return bytes([int(self.sp.id_to_piece(number)[3:-1], 16)])
        if self.sp.is_control(number) or self.sp.is_unknown(number):
            return b""
        return self._written(self.sp.id_to_piece(number))

    def _written(self, piece: str) -> bytes:
        return (piece if self.escape else piece.replace(SPACE, " ")).encode()

    def normalise(self, text: str) -> tuple[bytes, Sequence[int]]:
        """Normalised bytes, and for each of them and the end the source byte where it begins."""
        raw, parts = text.encode(), []  # (replacement, where it came from)
        if raw and self.prefix and self.escape and not (self.user or self.map.units or self.trim or self.suffix):
            # nothing is replaced but spaces: the same alignment, for all bytes at once
            space, each = SPACE.encode(), np.frombuffer(raw, np.uint8)
            starts = np.arange(len(raw))
            if not text.isascii():
                starts = np.maximum.accumulate(np.where(each & 0xC0 == 0x80, 0, starts))
            source = np.repeat(starts, np.where(each == 0x20, len(space), 1))
            return space + raw.replace(b" ", space), np.concatenate([np.zeros(len(space), np.int64), source, [len(raw)]])
        at = 0
        while at < len(raw):
            user = next((u for u in self.user if raw.startswith(u, at)), None)
            hit = (len(user), user) if user else self.map.longest(raw, at)
            if hit is None:
                width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                hit = width, raw[at : at + width]
            parts.append((hit[1], at))
            at += hit[0]
        if self.trim:  # spaces at both ends go; of a run of spaces one stays
            while parts and not parts[0][0].strip(b" "):
                del parts[0]
            while parts and not parts[-1][0].strip(b" "):
                del parts[-1]
        space = SPACE.encode() if self.escape else b" "
        out, source, last_space = bytearray(), [], False
        if not parts:
            return b"", [len(raw)]

        def put(piece: bytes, where: int) -> None:
            out.extend(piece)
            source.extend([where] * len(piece))

        if self.prefix and not self.suffix:
            put(space, parts[0][1])
            last_space = True
        elif self.trim:
            last_space = True
        for piece, where in parts:
            if self.trim and last_space:
                piece = piece.lstrip(b" ")
            for i in range(len(piece)):
                put(space if piece[i] == 0x20 else piece[i : i + 1], where)
            last_space = piece.endswith(b" ") if piece else last_space
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            put(space, parts[-1][1])
        return bytes(out), [*source, len(raw)]

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(piece, id, begin, end) with byte offsets in the original text; begin and end ids are not among them."""
        ids = np.frombuffer(self.encode([text])[0], "<u4")[1:-1]
        at = self.align(text, ids).tolist()
        return [(p, int(i), *at[k : k + 2]) for k, (p, i) in enumerate(zip(self.sp.encode(text, out_type=str), ids, strict=True))]

    def align(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The byte of ``text`` where each piece begins, and the end of the text; pieces must spell the normalised text."""
        normal, source = self.normalise(text)
        if self.sp.unk_id() in ids:  # an unknown piece is as long as what it stands for
            surfaces = self.sp.encode(text, out_type=str)
            parts = [self.spelled[i] or self._written(p) for p, i in zip(surfaces, ids.tolist(), strict=True)]
            widths = np.asarray([len(p) for p in parts], np.int64)
        else:
            parts, widths = [self.spelled[i] for i in ids.tolist()], self.widths[ids]
        if b"".join(parts) != normal:
            raise ValueError(f"pieces do not spell the {len(normal)} normalised bytes")
        at = np.asarray(source)[np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)]
        at[-1] = len(text.encode()) if len(ids) == 0 else at[-1]
        return at.astype("<u4")

    def encode_aligned(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as in :meth:`encode`, and as little-endian uint32 where its pieces begin, then its length in bytes.

        Every text's pieces must spell it. Words are held against the library's encoding of a whole text when they are first
        met (see :meth:`encode`); a text that its words' pieces don't spell is encoded whole.
        """
        out = []
        for text, ids in zip(texts, self.encode(texts), strict=True):
            inner = np.frombuffer(ids, "<u4")[1:-1]
            try:
                out.append((ids, self.align(text, inner).tobytes()))
            except ValueError:
                whole = np.asarray(self.sp.encode(text), "<u4")
                out.append((self.ends[0] + whole.tobytes() + self.ends[1], self.align(text, whole).tobytes()))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text between the begin and end ids.

        Each new word is encoded once by itself and once among the others in one text. Should their pieces differ, the texts that
        hold any of these words are encoded whole.
        """
        split = [t.split(" ") if self.by_word and SPACE not in t else [] for t in texts]
        unseen = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(unseen) > REMEMBERED:
            self.known.clear()
            unseen = list({w for words in split for w in words})
        self.known[""] = None  # next to another space, or at an end: spaces may join
        unseen = [w for w in unseen if w]
        alone = self.sp.encode(unseen, num_threads=1)
        alike = self.sp.encode(" ".join(unseen)) == [i for word in alone for i in word]
        self.known.update(zip(unseen, (np.asarray(i, "<u4").tobytes() if alike else None for i in alone), strict=True))
        out = []
        for text, words in zip(texts, split, strict=True):
            parts = [self.known[w] for w in words]
            body = np.asarray(self.sp.encode(text), "<u4").tobytes() if not parts or None in parts else b"".join(parts)
            out.append(self.ends[0] + body + self.ends[1])
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1)


def codec(path: str) -> Codec:
    """The model at ``path``, loaded once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_spans(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``pieces``: an array of (piece, id, begin, end), begin and end as byte offsets in the UTF-8 text.

    A null or empty text has no pieces. Bytes that the normaliser drops lie in the span of the piece before them. Repeated rows
    and null ids are encoded like any other; other columns are not carried.
    """
    item = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    as_arrow = pa.list_(pa.struct([("piece", pa.string()), ("id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[dict(zip(("piece", "id", "begin", "end"), s, strict=True)) for s in codec(model).spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, as_arrow)], names=["doc_id", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("pieces", T.ArrayType(item))]))


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian uint32, begin and end ids included), ``offsets`` and ``decoded``, the library's decoding of the ids.

    offsets (binary, little-endian uint32): the byte of the text where each piece begins, then the text's length.
    A null text is an empty one. Repeated rows and null ids are encoded like any other, very long texts whole in their task; an
    empty table gives an empty one; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = codec(model).encode_aligned([t or "" for t in batch.column(1).to_pylist()])
            ids = [i for i, _ in pieces]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([o for _, o in pieces], pa.binary()), pa.array(codec(model).decode(ids), pa.string())], names=["doc_id", "ids", "offsets", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("offsets", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode_ids`; n_tokens counts the aligned pieces, the begin and the end."""
    return encode_ids(docs, model).select("doc_id", (F.octet_length("offsets") / 4 + 1).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
