"""Byte-level BPE as a monoid: an encoding of a byte string is joined from the encodings of its halves.

The tree goes down to single bytes. Two neighbours join by encoding anew a window at their boundary. The window grows until the token on
either side of it and the window's own outer token are stable as a pair, that is, encoding the bytes of
the two gives just the two. A list of tokens is the encoding of its bytes exactly when all its adjacent
pairs are stable, so then no token outside the window can change. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession

from .common import table

NONE = 1 << 60
#: Windows of more bytes than this are merged with a heap.
WIDE = 192
#: Pre-tokens that a worker remembers in each of its cache's two generations, and code points of one at most.
CACHE, REMEMBERED = 200_000, 64
#: Inner nodes of the tree up to this many bytes are remembered, since words share their halves.
SHARED = 8
#: Pre-tokens that are encoded at a time: memory for a text beside its own ids stays within a block.
BLOCK = 4096
#: Texts of more code points than this are cut into pre-tokens one by one instead of all at once.
LONG = 1 << 18


def plain_pattern(pattern: str) -> re.Pattern:
    """The same pre-tokens by the faster `re`, for texts that plain() accepts: there \\w is L, N or _, and \\d is N."""
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))


def plain(text: str) -> bool:
    """All of Latin-1, but for numbers that are no digits and the controls that only `re` calls white space."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        if any(c in text for c in "²³¹¼½¾"):
            return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


class Splitter:
    """Pre-tokens of a text, exactly as the pattern gives them."""

    def __init__(self, pattern: str):
        import regex

        self.exact, self.fast = regex.compile(pattern).findall, plain_pattern(pattern).findall

        self.exact_each, self.fast_each = regex.compile(pattern).finditer, plain_pattern(pattern).finditer

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if plain(text) else self.exact(text)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The same, BLOCK at a time; of a long text no more than a block exists at once."""
        if len(text) <= LONG:
            pieces = self(text)
            for start in range(0, len(pieces), BLOCK):
                yield pieces[start : start + BLOCK]
        else:
            each = (self.fast_each if plain(text) else self.exact_each)(text)
            while block := [m.group() for m in islice(each, BLOCK)]:
                yield block


class Codec:
    """Encodes and decodes by a file of ranks (base64 token, rank a line)."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.nodes: dict[bytes, list[int]] = {}

    def window(self, piece: bytes) -> list[int]:
        """Encodes a boundary window anew: merges the pair of lowest rank, the leftmost of equals, until none has a rank."""
        if len(piece) > WIDE:
            return self.wide_window(piece)
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return [self.ranks[x] for x in parts]

    def wide_window(self, piece: bytes) -> list[int]:
        """The same by a heap, for windows that had to grow."""
        n, get = len(piece), self.ranks.get
        end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not live[i] or end[i] != j or j >= n or end[j] != stop:
                continue
            end[i], live[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if live[i]]

    def stable(self, a: int, b: int) -> bool:
        known = self.stable_pairs.get((a, b))
        if known is None:
            if len(self.stable_pairs) > CACHE:
                self.stable_pairs.clear()
            known = self.stable_pairs[a, b] = self.window(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two adjacent byte strings from the encodings of each."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        a, b, grow_a, grow_b = len(left) - 1, 1, 1, 1
        while True:
            middle = self.window(self.decode(left[a:] + right[:b]))
            left_holds = a == 0 or self.stable(left[a - 1], middle[0])
            right_holds = b == len(right) or self.stable(middle[-1], right[b])
            if left_holds and right_holds:
                return left[:a] + middle + right[b:]
            if not left_holds:
                a, grow_a = max(0, a - grow_a), 2 * grow_a
            if not right_holds:
                b, grow_b = min(len(right), b + grow_b), 2 * grow_b

    def tree(self, piece: bytes) -> list[int]:
        """The join of the encodings of the halves; a single byte is a leaf."""
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        known = self.nodes.get(piece)
        if known is None:
            half = len(piece) // 2
            known = self.join(self.tree(piece[:half]), self.tree(piece[half:]))
            if len(piece) <= SHARED:
                if len(self.nodes) >= CACHE:
                    self.nodes.clear()
                self.nodes[piece] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """One pre-token: itself if it is a token, else by the tree."""
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.tree(piece)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class TextCodec:
    """Whole texts. Pre-tokens are encoded apart, so between them the join is concatenation."""

    def __init__(self, ranks_path: str, pattern: str):
        self.codec, self.split = Codec(ranks_path), Splitter(pattern)
        self.digits = [str(i) for i in range(len(self.codec.token))]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.old.get(piece)
        if known is None:
            known = tuple(self.codec.encode_piece(piece.encode()))
        if len(piece) > REMEMBERED:
            return known
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = known
        return known

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, those of some thousand pre-tokens at a time."""
        miss = self.piece
        for pieces in self.split.blocks(text):
            get = self.young.get
            yield list(chain.from_iterable([get(x) or miss(x) for x in pieces]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode(self, ids: list[int]) -> bytes:
        return self.codec.decode(ids)


CODECS: dict[tuple[str, str], TextCodec] = {}


def codec_of(ranks_path: str, pattern: str) -> TextCodec:
    """The worker's codec: made once and kept over its tasks, with its cache."""
    if (ranks_path, pattern) not in CODECS:
        CODECS[ranks_path, pattern] = TextCodec(ranks_path, pattern)
    return CODECS[ranks_path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, and ids array<int> with decoded binary (the round trip), or digests of both.

    A null text counts as empty: no tokens, digests of no bytes. Repeated rows give repeated rows, an empty
    table no rows; a null id stays null; other columns aren't read. ranks_path must name a file that every
    executor has. Pre-tokens are encoded in blocks, so with digests a row needs little more than its own text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_name = id_col

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = codec_of(ranks_path, pattern)
        digit = codec.digits.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, first, second = [], [], []
                for value in part.column(1):
                    n, ids, ids_sha, text_sha = 0, [], hashlib.sha256(), hashlib.sha256()
                    for block in codec.blocks(value.as_py() or ""):
                        if digests:
                            ids_sha.update((("," if n else "") + ",".join(map(digit, block))).encode())
                            text_sha.update(codec.decode(block))
                        else:
                            ids += block
                        n += len(block)
                    counts.append(n)
                    first.append(ids_sha.hexdigest() if digests else ids)
                    second.append(text_sha.hexdigest() if digests else codec.decode(ids))
                types = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(first, types[0]), pa.array(second, types[1])], names)

    names = [id_name, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_name}` {kind}, n_tokens long, {rest}")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of `documents` by the tree of halves, their digest and that of what they decode to."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), os.fspath(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, digests=True)
