"""Byte-level BPE by prefix dynamic programming.

A byte string has exactly one BPE encoding, and every prefix of a valid token sequence
is the valid encoding of the bytes it covers. So each byte prefix has one valid last
token, and a token t that ends at byte i is that token exactly if the pair (last token
of the prefix before t, t) is itself stable under the merge rules. ``PrefixTable`` keeps
the last token of every prefix of a string: bytes are appended without redoing anything,
and an edit re-encodes from the edited byte on. Over a corpus, new pre-tokens are met in
sorted order, so that each is an edit of the one before.

Null text counts as empty; an empty text has no tokens and the digests of empty input.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds on what a worker remembers; when one is met the memory is emptied, which changes no result.
MAX_PIECES = 400_000
MAX_PAIRS = 400_000
MAX_KEPT = 64
#: Characters of the texts whose pre-tokens and ids are held at once.
RUN = 1_000_000

# The White_Space characters of Unicode.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters, numbers and white space among the first 256 characters.
LATIN_L, LATIN_N, LATIN_S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \\x85\\xa0"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixTable:
    """The last tokens of all prefixes of one byte string, for one vocabulary of byte strings and ranks.

    ``lasts[i]`` is the id of the valid last token of the first i bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.stable: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self.data, self.lasts = b"", [-1]

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """What stands at one end of the token while it is merged, each with the rank of the merge that ends it."""
        if (token, right) not in self.edges:
            out, part, until = [], token, math.inf
            while True:
                out.append((part, until))
                if len(part) == 1:
                    break
                part, until = self._halves(part)[right], self.ranks[part]
            self.edges[token, right] = out
        return self.edges[token, right]

    def is_stable(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart: no merge across their border comes before the merges inside them.

        Of two equal merges the left one comes first.
        """
        get, known = self.ranks.get, True
        right = self._edge(self.tokens[b], False)
        for x, x_until in self._edge(self.tokens[a], True):
            for y, y_until in right:
                rank = get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    known = False
        if len(self.stable) >= MAX_PAIRS:
            self.stable.clear()
        self.stable[a << 32 | b] = known
        return known

    def append(self, more: bytes) -> None:
        """Extend the string; nothing of what is there is done again."""
        data = self.data = self.data + more
        lasts, get, stable, is_stable = self.lasts, self.ranks.get, self.stable.get, self.is_stable
        for i in range(len(lasts), len(data) + 1):
            for j in range(i - 1, -1, -1):  # only one token is valid, so the order is free; short ones are likelier
                token = get(data[j:i])
                if token is not None:
                    if not j:
                        break
                    before = lasts[j]
                    ok = stable(before << 32 | token)
                    if ok or ok is None and is_stable(before, token):
                        break
            lasts.append(token)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; nothing before the edit is done again."""
        rest = new + self.data[stop:]
        self.data = self.data[:start]
        del self.lasts[start + 1 :]
        self.append(rest)

    def become(self, data: bytes) -> None:
        """Turn into the table of another string, keeping what it has of the prefix that both share."""
        old, k = self.data, 0
        for x, y in zip(old, data):
            if x != y:
                break
            k += 1
        self.data = data[:k]
        del self.lasts[k + 1 :]
        self.append(data[k:])

    def ids(self) -> list[int]:
        out, n = [], len(self.data)
        while n:
            token = self.lasts[n]
            out.append(token)
            n -= self.size[token]
        out.reverse()
        return out


@lru_cache(maxsize=4)
def split_patterns(pattern: str):
    """The pre-tokeniser for texts of the first 256 characters, and the one for all others.

    The first says the same in classes that the standard library can compile.
    """
    import regex

    wide = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}\\p{{L}}\\p{{N}}]").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
    narrow = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_S}{LATIN_L}{LATIN_N}]").replace(r"\p{L}", f"[{LATIN_L}]").replace(r"\p{N}", f"[{LATIN_N}]").replace(r"\S", f"[^{LATIN_S}]").replace(r"\s", f"[{LATIN_S}]"))
    return narrow, wide, re.compile("[^\\x00-\\xff]")


class Codec:
    """Texts to ids and back. Ids are given as decimals joined by one space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.table = ranks, PrefixTable(ranks)
        self.narrow, self.wide, self.beyond = split_patterns(pattern)
        self.pieces: dict[str, str] = {}
        order = [self.table.tokens.get(r, b"") for r in range(max(ranks.values(), default=-1) + 1)]
        self.size = np.array([len(t) for t in order], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(order), np.uint8)

    def encode_all(self, texts: list[str]) -> list[str]:
        """The texts should be few enough for their pre-tokens to be held at once."""
        pieces, table, short = self.pieces, self.table, MAX_KEPT
        if len(pieces) >= MAX_PIECES:
            pieces.clear()
        found = [(self.wide if self.beyond.search(t) else self.narrow).findall(t) for t in texts]
        # In sorted order a pre-token shares most of its prefixes with the one before it.
        for data in sorted(p.encode() for p in set().union(*found).difference(pieces) if len(p) <= short):
            if data in self.ranks:
                pieces[data.decode()] = str(self.ranks[data])
            else:
                table.become(data)
                pieces[data.decode()] = " ".join(map(str, table.ids()))
        return [" ".join([pieces[p] if len(p) <= short else self._long(p.encode()) for p in f]) for f in found]

    def _long(self, data: bytes) -> str:
        if data in self.ranks:
            return str(self.ranks[data])
        self.table.become(data)
        ids = " ".join(map(str, self.table.ids()))
        self.table.become(b"")
        return ids

    def encode(self, text: str) -> str:
        return self.encode_all([text])[0]

    def decode(self, ids: str) -> bytes:
        """The bytes of the tokens, gathered from one blob of all tokens."""
        if not ids:
            return b""
        of = np.array(ids.split(" "), np.int64) if len(ids) < 200 else np.fromstring(ids, np.int64, sep=" ")
        size = self.size[of]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.start[of] - ends + size, size) + np.arange(ends[-1])].tobytes()


def groups(texts: Iterable[str], most: int = RUN) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; one longer text is a run of its own."""
    run, n = [], 0
    for text in texts:
        if run and n + len(text) > most:
            yield run
            run, n = [], 0
        run.append(text)
        n += len(text)
    if run:
        yield run


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-tokeniser pattern of an installed vocabulary, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encoded(batches: Iterable[pa.RecordBatch], own: Codec, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The rows of ``encode_documents`` for batches of doc_id and text.

    Texts become strings, and ids leave, a run at a time: a batch may be all that a task has.
    """
    for batch in batches:
        at = 0
        for texts in groups(t.as_py() or "" for t in batch["text"]):
            counts, first, second, lists = [], [], [], []
            for ids in own.encode_all(texts):
                counts.append(ids.count(" ") + 1 if ids else 0)
                first.append(hashlib.sha256(ids.encode()).hexdigest())
                second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(np.fromstring(ids, np.int32, sep=" "))
            out = {"doc_id": batch["doc_id"].slice(at, len(texts)), "n_tokens": counts, "ids_sha256": first, "decoded_sha256": second}
            if with_ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_pydict(out)
            at += len(texts)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and token_ids if asked for.

    One narrow pass: no shuffle, nothing on the driver. Rows stay apart, so repeated rows
    and ties give repeated results; columns other than doc_id and text are not looked at.
    """
    default = public_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default[0], pattern or default[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, codec(path, pattern), with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
