"""Token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded in batches by the library itself.  Longer ones are
encoded as overlapping chunks with offsets; neighbours are spliced at a position that

* starts a token in both encodings,
* is provably a pre-token start whatever stands to the left: one plain space between a
  non-space and a letter or digit (no pattern of a byte-level pre-tokeniser spans it, and no
  added token holds a space), and
* is followed by the same token ids in both encodings.

When the overlap holds no such position it is doubled, up to the rest of the text, so the
count always equals that of the whole text.  Memory stays at a few chunks per document.  A
tokenizer outside this proof (see ``can_splice``) encodes every text whole.

Nulls count as empty texts (0 bytes, 0 tokens).  Extra columns pass through; columns named
like an output are replaced.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidara.llm.common import process_cache, ship_by_value, tidy

AGREE = 4  #: tokens that must agree after a splice
BATCH_CHARS = 2_000_000  #: characters given to the library at once


def load_tokenizer(spec: bytes):
    """A tokenizer from the bytes of its JSON file, once per worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache, key = process_cache(), ("tokenizer", hash(spec), len(spec))
    if key not in cache:
        tok = Tokenizer.from_buffer(spec)
        tok.no_truncation()
        tok.no_padding()
        cache[key] = tok
    return cache[key]


def can_splice(spec: bytes) -> bool:
    """Whether a tokenizer's JSON is of the kind for which ``is_stable`` is proved.

    No normaliser, the byte-level pre-tokeniser with its own pattern and no prefix space, and added
    tokens that hold no white space, take none from their surroundings and stand anywhere.
    """
    import json

    j = json.loads(spec)
    pre = j.get("pre_tokenizer") or {}
    tokens = j.get("added_tokens") or []
    plain = all(not any(c.isspace() for c in t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in tokens)
    return j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and plain


def is_stable(text: str, p: int) -> bool:
    """Whether a pre-token starts at ``p`` whatever the text to its left."""
    return 0 < p < len(text) - 1 and text[p] == " " and not text[p - 1].isspace() and text[p + 1].isalnum()


def _encode(tok, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Ids and token starts (in the whole text) of one chunk."""
    e = tok.encode(text[start:end], add_special_tokens=False)
    return e.ids, [start + a for a, _ in e.offsets]


def splice(text: str, left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], lo: int, hi: int) -> tuple[int, int] | None:
    """Indexes (in left, in right) of the first common stable boundary in [lo, hi)."""
    ids_l, at_l = left
    ids_r, at_r = right
    first_r: dict[int, int] = {}
    for j, p in enumerate(at_r):
        if p >= hi:
            break
        first_r.setdefault(p, j)
    for i, p in enumerate(at_l):
        if p <= lo or p not in first_r or (i and at_l[i - 1] == p) or not is_stable(text, p):
            continue
        j = first_r[p]
        n = min(AGREE, len(ids_l) - i - 1, len(ids_r) - j - 1)
        if n >= AGREE and ids_l[i : i + n] == ids_r[j : j + n]:
            return i, j
    return None


def count_long(tok, text: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of a long text; equal to ``len(tok.encode(text).ids)``."""
    n, total, start = len(text), 0, 0
    ids, at = _encode(tok, text, 0, min(n, chunk_chars + overlap_chars))
    end = min(n, chunk_chars + overlap_chars)
    while end < n:
        overlap = overlap_chars
        while True:
            lo = max(start + 1, end - overlap)
            right_end = min(n, lo + max(chunk_chars, overlap) + overlap_chars)
            right = _encode(tok, text, lo, right_end)
            hit = splice(text, (ids, at), right, lo, end)
            if hit or lo <= start + 1:
                break
            overlap *= 2
        if hit and right_end > end:
            i, j = hit
            total += i
            start, end = right[1][j], right_end
            ids, at = right[0][j:], right[1][j:]
        else:  # nothing to splice at: widen the left chunk, up to the whole rest
            end = min(n, end + max(end - start, chunk_chars))
            ids, at = _encode(tok, text, start, end)
    return total + len(ids)


def _lengths(tok, texts: list[str], chunk_chars: int, overlap_chars: int) -> list[int]:
    out = [0] * len(texts)
    batch: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for k, e in zip(batch, tok.encode_batch_fast([texts[k] for k in batch], add_special_tokens=False), strict=True):
            out[k] = len(e)
        batch.clear()
        size = 0

    for k, t in enumerate(texts):
        if len(t) > chunk_chars:
            out[k] = count_long(tok, t, chunk_chars, overlap_chars)
        elif t:
            batch.append(k)
            size += len(t)
            if size >= BATCH_CHARS:
                flush()
    if batch:
        flush()
    return out


def count_tokens(
    docs: DataFrame, tokenizer_json: bytes, text: str = "text", limit: int = 1024, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 11, keep: list[str] | None = None
) -> DataFrame:
    """Add n_bytes, n_tokens (long) and over_limit to ``docs``; ``keep`` names the columns kept.

    The tokenizer travels inside the task, so executors need no vocabulary file.
    """
    made = ["n_bytes", "n_tokens", "over_limit"]
    if not can_splice(tokenizer_json):
        chunk_chars = 1 << 62  # every text whole
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    source = docs.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_json)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            counts = _lengths(tok, texts, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [*kept, *made],
            )

    return source.mapInArrow(tidy(run), schema)


ship_by_value(__name__)
