"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside one token, since
every merge result is itself a vocabulary token. Each such pair in a pretoken is therefore a
certain cut: the fragments between cuts are encoded independently and concatenated.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regspark.llm.common import fresh

#: Fixed value: the published split pattern of byte-level BPE vocabularies.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens that a worker remembers before it starts afresh, and the longest it remembers (characters).
CACHE_ENTRIES, CACHE_CHARS = 800_000, 64
#: Fragments of up to so many bytes are merged by scanning, longer ones with a heap.
SCAN_BYTES = 48


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary with its certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        self.inside = bytearray(1 << 16)
        for token in ids:
            raw = [alphabet[c] for c in token]
            for a, b in zip(raw, raw[1:]):
                self.inside[a << 8 | b] = 1
        self.pattern = regex.compile(PRETOKEN_PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        """`raw` cut wherever two neighbouring bytes occur together in no vocabulary token."""
        inside = self.inside
        cuts = [0, *(k for k in range(1, len(raw)) if not inside[raw[k - 1] << 8 | raw[k]]), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, fragment: bytes) -> list[int]:
        """Token ids of one fragment: lowest-ranked merges first, from left to right."""
        ids = [self.byte_id[b] for b in fragment]
        return self._by_scan(ids) if len(ids) <= SCAN_BYTES else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        rank_of, made, never = self.ranks.get, self.made, len(self.made)
        ranks = [rank_of(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < never:
            k = ranks.index(rank)
            ids[k] = made[rank]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] << 32 | ids[k], never)
            if k < len(ranks):
                ranks[k] = rank_of(ids[k] << 32 | ids[k + 1], never)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        rank_of, made, n = self.ranks.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, ids[k], ids[k + 1]) for k in range(n - 1) if (rank := rank_of(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (rank := rank_of(ids[left] << 32 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (rank, left, ids[left], ids[after[left]]))
        return [x for x in ids if x >= 0]

    def _pretoken(self, pretoken: str) -> bytes:
        ids: list[int] = []
        for fragment in self.fragments(pretoken.encode()):
            ids += self.merge(fragment)
        packed = array("I", ids).tobytes()
        if len(pretoken) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[pretoken] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        pieces = self.special_pattern.split(text) if self.special_pattern and any(s in text for s in self.special) else [text]
        out: list[bytes] = []
        for piece in pieces:
            if piece in self.special:
                out.append(array("I", [self.special[piece]]).tobytes())
            else:
                known = self.cache.get
                out += [known(p) or self._pretoken(p) for p in self.pattern.findall(piece)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the token ids of each text and the text decoded from them.

    `vocabulary` is the path of a byte-level BPE file in the tokenizers JSON format, readable
    on every executor. `ids_col` is binary: ids as little-endian unsigned 32-bit integers;
    `decoded_col` is a string. A null text counts as empty: no ids, an empty decoded text.
    Whole texts are encoded whatever their length; special tokens found in a text get their
    own ids. Other columns pass through untouched; a column that already has one of the new
    names keeps it and the new column gets an underscore. Rows repeat as they came, and an
    empty table stays empty. No shuffle: each partition is encoded where it lies.
    """
    ids_col, decoded_col = fresh(docs, ids_col), fresh(docs, decoded_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(at).to_pylist()]
            text = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=[*batch.schema.names, ids_col, decoded_col])

    return docs.mapInArrow(run, schema)
