"""Operator 6, byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, one each, so that an Aho-Corasick automaton over characters
finds the longest token at a place of a piece. A piece is then encoded from left to right by the longest
tokens, backtracking to a token's longest prefix that is a token where two neighbours are not compatible. Two tokens are compatible if
merging their joined bytes by rank gives back the two, which their last merges tell; that answer is memoised, and a sequence whose
neighbours are all compatible is the one that the merges give. Each place is left for good once no
token from it can lead to the end, so that the work is linear in the piece.

Null text is encoded as empty. Empty text gives no ids. Very long pieces need memory in proportion to
their length. Repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each memo of a task; a memo is emptied when full, which changes no result.
MEMO = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NONE = 1 << 60
#: A space beside white space or at either end.
_CROWDED = re.compile(r"\s | \s|^ | $", re.MULTILINE)


def merge(data: bytes, ranks: dict[bytes, int], below: int = NONE) -> list[int]:
    """The definition: merge the neighbours of least rank, the first on ties, until none has a rank under ``below``."""
    get = ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    costs = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
    while costs:
        best = min(costs)
        if best >= below:
            break
        at = costs.index(best)
        joined = parts[at] = parts[at] + parts.pop(at + 1)
        del costs[at]
        if at:
            costs[at - 1] = get(parts[at - 1] + joined, NONE)
        if at < len(costs):
            costs[at] = get(joined + parts[at + 1], NONE)
    return [ranks[p] for p in parts]


class _Memo(dict):
    """Ids of pieces, as bytes; filled by what it lacks."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.make(piece)
        return out


class Encoder:
    """``splits``: of each token the two that its last merge joins, as ``last_merges`` finds them.

    ``spaced``: False for a pattern that can carry a piece over a lone space.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, splits=None, spaced: bool = True):
        self.spaced = spaced
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = [0] * (max(self.tokens) + 1)
        self.shorter = [-1] * len(self.lengths)  # the longest proper prefix that is a token, if any
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        self.splits = last_merges(ranks) if splits is None else splits
        reached = {i for t, i in ranks.items() if len(t) == 1 or i in self.splits}
        for token, i in ranks.items():
            self.lengths[i] = len(token)
            if i in reached:
                self.automaton.add_word(token.decode("latin-1"), i)
                found = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
                self.shorter[i] = next((f for f in found if f in reached), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self._piece)
        self.chunks = _Memo(self._chunk)
        ids = sorted(self.tokens)
        self.token_lengths = np.zeros(ids[-1] + 1, np.int64)
        self.token_lengths[ids] = [len(self.tokens[i]) for i in ids]
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens[i] for i in ids), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` followed by ``b`` as they are.

        Their merges are undone from the last to the first: the parts that then meet at the border must not join
        before the merge that was undone.
        """
        if len(self.fits) >= MEMO:
            self.fits.clear()
        x, y, bound = a, b, NONE
        tokens, ranks, splits, known = self.tokens, self.ranks, self.splits, True
        while True:
            joined = ranks.get(tokens[x] + tokens[y])
            if joined is not None and joined < bound:
                known = False
                break
            left, right = splits.get(x), splits.get(y)
            if left is not None and (right is None or x > y):
                x, bound = left[1], x  # on a tie of ranks the merge further left comes first
            elif right is not None:
                y, bound = right[0], y + 1
            else:
                break
        self.fits[a << 32 | b] = known
        return known

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, data: bytes) -> list[int]:
        if (known := self.ranks.get(data)) is not None:
            return [known]
        text, longest, fits, lengths, shorter = data.decode("latin-1"), self.automaton.iter_long, self.fits, self.lengths, self.shorter
        n, out, last, at = len(text), [], -1, 0
        dead = bytearray(n + 1)
        while at < n:
            end, token = next(longest(text, at), (-1, -1))
            if token < 0 or end + 1 - lengths[token] != at:
                raise ValueError("a byte of the text has no token")
            while True:
                while token >= 0:
                    if not dead[at + lengths[token]]:
                        if last < 0:
                            break
                        fit = fits.get(last << 32 | token)
                        if self.compatible(last, token) if fit is None else fit:
                            break
                    token = shorter[token]
                if token >= 0:
                    out.append(token)
                    at, last = at + lengths[token], token
                    break
                if not out:
                    raise ValueError("the merges give this text no tokens")
                dead[at] = 1  # no token from here leads to the end
                token = out.pop()
                at, last = at - lengths[token], out[-1] if out else -1
                token = shorter[token]
        return out

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``; a chunk of one piece is held by its own memo alone."""
        pieces = self.pieces.findall(" " + chunk)
        return self.memo.make(pieces[0]) if len(pieces) == 1 else b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        The pattern takes a lone space with what follows it and ends a piece before it, so that a text
        whose spaces all stand alone falls apart there into chunks, which repeat and are memoised.
        """
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(self.chunks) >= MEMO:
            self.chunks.clear()
        if self.spaced is False or _CROWDED.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        if not ends.size:
            return b""
        return self.token_bytes[np.repeat(self.token_starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that the last merge of a token's own bytes joins; none for single bytes, nor for tokens that
    merging their own bytes doesn't give."""
    out = {}
    for token, i in ranks.items():
        if len(token) > 1:
            parts = merge(token, ranks, below=i)
            if len(parts) == 2:
                out[i] = (parts[0], parts[1])
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    return _run(docs, ranks, pattern, id_column, "ids binary, decoded binary", lambda ids, data: (ids, data))


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def row(ids: bytes, data: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()

    return _run(docs, ranks, pattern, id_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _run(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str, columns: str, row) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, last_merges(ranks)))  # a vocabulary, of fixed size
    source = docs.select(F.col(id_column), F.col("text").cast("string"))
    names = [c.split()[0] for c in columns.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in columns.split(",")]

    def run(batches):
        ranks, splits = shared.value
        encoder = Encoder(ranks, pattern, splits)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    made = []
                    for text in part.column(1).to_pylist():
                        ids = encoder.encode(text or "")
                        made.append(row(ids, encoder.decode(ids)))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=[id_column, *names])
        finally:  # the worker lives on in other stages; the memos and the encoder hold each other
            del encoder
            gc.collect()

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, {columns}")
