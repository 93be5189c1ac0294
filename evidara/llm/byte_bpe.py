"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank vocabulary is serialised straight into a sentencepiece BPE model: every token becomes
a piece whose bytes are mapped to printable characters, scored by its negative rank, with
identity normalisation and no dummy prefix.  A piece of lower rank merges first, as in the rank
file, so encoding each pre-token gives the ranks' own result.  Ids decode by the inverse map.

Nulls are empty texts.  Extra columns pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidara.llm.common import process_cache, ship_by_value, tidy

CACHE_ENTRIES = 150_000  #: distinct pre-tokens remembered per worker; only memory, never results
BATCH_ROWS = 500  #: documents whose ids are held at once
UNK = "<unk>"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def byte_chars() -> list[str]:
    """One printable character for each byte: itself if visible, else from U+0100 upward."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """One protobuf field: int or bool as varint, float as 32 bits, bytes and str with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; piece id = position by rank + 1 (0 is the unknown piece)."""
    chars = byte_chars()
    pieces = [_field(1, UNK) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file; remembers pre-tokens it has met."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.find = regex.compile(pattern).findall
        self.chars = byte_chars()
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = [-1, *(r for _, r in by_rank)]
        back = {c: b for b, c in enumerate(self.chars)}
        self.bytes_of = {r: bytes(back[c] for c in self.model.id_to_piece(i)) for i, r in enumerate(self.rank_of_piece) if r >= 0}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        parts = self.find(text)
        known = self.known
        if fresh := list({p for p in parts if p not in known}):
            if len(known) + len(fresh) > CACHE_ENTRIES:
                known.clear()
                fresh = list(set(parts))
            mapped = ["".join([self.chars[b] for b in p.encode()]) for p in fresh]
            to_rank = self.rank_of_piece
            for p, ids in zip(fresh, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
                known[p] = [to_rank[i] for i in ids]
        out: list[int] = []
        for p in parts:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(rank_file: bytes, pattern: str) -> Codec:
    cache, key = process_cache(), ("byte_bpe", hash(rank_file), pattern)
    if key not in cache:
        cache[key] = Codec(rank_file, pattern)
    return cache[key]


def encode_decode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 and decodes_back; ``with_ids`` adds the ids as array<int>.

    Each text is encoded whole, one pre-token at a time; decoded bytes come from the ids alone.
    """
    made = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string()), ("decodes_back", T.BooleanType(), pa.bool_())]
    if with_ids:
        made.append(("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    names = [n for n, _, _ in made]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        sha = hashlib.sha256
        for b in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            rows = []
            for t in b.column(text):
                t = t.as_py() or ""
                ids = c.encode(t)
                back = c.decode(ids)
                row = (len(ids), sha(",".join(map(str, ids)).encode()).hexdigest(), sha(back).hexdigest(), back == t.encode())
                rows.append((*row, ids) if with_ids else row)
            cols = [pa.array(list(x), kind) for x, (_, _, kind) in zip(zip(*rows, strict=True), made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *cols], [*kept, *names])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(tidy(run), schema)


ship_by_value(__name__)
