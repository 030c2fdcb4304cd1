"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by longest-prefix match through the model's compiled
character map (a double-array trie); every normalised byte keeps the source
byte it came from. The pieces tile the normalised text, so each piece projects
to a span of source bytes. A piece that stands for one byte of a character
has an empty span, but for the character's last byte, which has it whole.

Cases: null text is an empty text (ids: begin and end only); other rows are
taken as they come; a very long text is encoded whole (some 60 bytes of memory
for each byte); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁".encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """A compiled character map: trie size, double-array units, then the NUL-ended replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` and their replacement, for the longest rule that matches."""
        node = self._offset(self.units[0])
        best = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]


def compile_map(rules: dict[str, str]) -> bytes:
    """Compile replacement rules into the form that ``CharMap`` reads."""
    texts, values = bytearray(), {}
    for key in sorted(rules, key=str.encode):
        values[key.encode()] = len(texts)
        texts += rules[key].encode() + b"\0"
    units: dict[int, int] = {}
    used: set[int] = {0}

    def build(node: int, prefix: bytes, label: int) -> None:
        below = sorted({k[len(prefix)] for k in values if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in values
        want = [0] * leaf + below
        base = 1
        while any(node ^ base ^ c in used for c in want) or base >= 1 << 21:
            base += 1
        used.update(node ^ base ^ c for c in want)
        units[node] = label | leaf << 8 | base << 10
        if leaf:
            units[node ^ base] = 1 << 31 | values[prefix]
        for c in below:
            build(node ^ base ^ c, prefix + bytes([c]), c)

    build(0, b"", 0)
    top = (max(units) | 255) + 1
    trie = struct.pack(f"<{top}I", *(units.get(i, 0) for i in range(top)))
    return struct.pack("<I", len(trie)) + trie + bytes(texts)


class SpanEncoder:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        norm = spec.normalizer_spec
        self.map = CharMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.prefix, self.collapse, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        kinds = pb.ModelProto.SentencePiece
        self.user = sorted((p.piece.encode() for p in spec.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        #: Normalised bytes under each id; -1 where only the text tells (an unknown piece).
        self.width = np.array([{kinds.BYTE: 1, kinds.CONTROL: 0, kinds.UNKNOWN: -1}.get(p.type, len(p.piece.encode())) for p in spec.pieces], np.int64)

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        if self.map is None and not self.collapse and not self.user and self.escape:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        at = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        align = np.repeat(at, np.where(raw == 0x20, len(SPACE), 1))
        head = len(SPACE) * self.prefix
        return SPACE * self.prefix + data.replace(b" ", SPACE), np.concatenate([np.zeros(head, np.int64), align, [len(data)]])

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.user:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if self.map is not None and (hit := self.map.longest(data, at)):
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE if self.escape else b" "
        out, align, at = bytearray(), [], 0
        if self.collapse:
            while at < len(data):
                n, new = self._step(data, at)
                if new != b" ":
                    break
                at += n
        if at == len(data):
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            out += mark
            align += [at] * len(mark)
        space = self.collapse
        while at < len(data):
            n, new = self._step(data, at)
            if space:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    piece = mark if byte == 0x20 else bytes([byte])
                    out += piece
                    align += [at] * len(piece)
                space = new.endswith(b" ")
            at += n
            space = space and self.collapse
        if self.collapse:
            while out.endswith(mark):
                at = align[-len(mark)]
                del out[-len(mark) :]
                del align[-len(mark) :]
        return bytes(out), np.array([*align, at], np.int64)

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte spans of a text's ids (no begin or end id among them)."""
        normal, align = self.normalize(data)
        width = self.width[ids]
        if (width < 0).any():  # an unknown piece takes what the next known piece leaves
            at = 0
            for i in np.flatnonzero(width < 0):
                at = int(width[:i].sum())
                rest = [self.lib.id_to_piece(int(x)).encode() for x in ids[i + 1 : i + 2]]
                stop = normal.find(rest[0], at) if rest and width[i + 1] > 0 else len(normal) - int(width[i + 1 :].clip(0).sum())
                width[i] = max(stop, at) - at
        ends = np.cumsum(width)
        if len(ends) and ends[-1] != len(normal):  # no projection: each piece stands for the whole text, and spans_tile is false
            return np.zeros(len(ids), np.int64), np.full(len(ids), len(data))
        return align[ends - width], align[ends]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """Encode every text with begin and end ids, project the pieces, decode.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, spans_tile (the
    pieces' spans follow each other and cover the text), n_span_bytes; with
    ``with_spans`` also ids, begins, ends (byte offsets; empty for the begin
    and end ids) and decoded.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        bos, eos = enc.lib.bos_id(), enc.lib.eos_id()
        for batch in batches:
            for b in common.slices(batch, limit=4 << 20):
                column = common.texts(b)
                raw, off = common.byte_view(column)
                data = raw.tobytes()
                cols: list[list] = [[] for _ in range(9)]
                lists = enc.lib.encode(column.to_pylist(), num_threads=1)
                for i, (ids, text) in enumerate(zip(lists, enc.lib.decode([[bos, *x, eos] for x in lists]), strict=True)):
                    full = np.array([bos, *ids, eos], "<u4")
                    source = data[off[i] : off[i + 1]]
                    lo, hi = enc.spans(source, full[1:-1])
                    tile = not len(lo) or bool(lo[0] == 0 and hi[-1] == len(source) and (lo[1:] == hi[:-1]).all())
                    row = (len(full), hashlib.sha256(full.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tile, int((hi - lo).sum()))
                    if with_spans:
                        row += (full.astype(np.int64), np.concatenate([[0], lo, [len(source)]]), np.concatenate([[0], hi, [len(source)]]), text)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_tile", "n_span_bytes", "ids", "begins", "ends", "decoded"]
                n = 9 if with_spans else 5
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False))], ["doc_id", *names[:n]])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_tile boolean, n_span_bytes long"
    schema += ", ids array<long>, begins array<long>, ends array<long>, decoded string" * with_spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(run), schema)
