"""Ids of public tokenizers, computed fast for plain texts and by their own libraries for all others.

Each encoder here gives the very ids of its library. The three vocabularies are byte-pair merges, and the
library that merges by ranks is several times faster than the other two, so that what they do before merging is
said in its terms, for texts of the first 256 characters. It may stand in since
every token encodes to itself and ids come in the order of merges (the tests hold this for all tokens): then at
the time of a token's rank, what lies between its ends has been merged as in the token alone, so its
own merge is the only one that can make it, and merging by the rank of the result is merging by the rank of the pair.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from lodeframe.llm.bpe import LATIN_L, LATIN_N, LATIN_S

#: Texts of other characters go to a vocabulary's own library.
BEYOND = re.compile("[^\\x00-\\xff]")
#: What the library does not have to encode twice is kept for so many strings.
MAX_KEPT = 200_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary."""
    of = byte_alphabet()
    return bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()


def _ranked(name: str, pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _library(path: str, plain_specials: bool):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain_specials
    return own


class Spelling:
    """The bytes of ids; ``table`` has them by id."""

    table: dict[int, bytes]

    def ends(self, ids: np.ndarray, data: bytes) -> np.ndarray | None:
        """The offsets at which the tokens end, or None if they do not spell ``data``."""
        if not hasattr(self, "sizes"):
            self.sizes = np.zeros(max(self.table) + 1, np.int32)
            self.sizes[list(self.table)] = [len(t) for t in self.table.values()]
            self.blob = np.frombuffer(b"".join(self.table.get(i, b"") for i in range(len(self.sizes))), np.uint8)
            self.starts = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int32)
        if not len(ends) or ends[-1] != len(data):
            return None
        # All bytes of all tokens at once, from one string of all entries.
        spelled = self.blob[np.repeat(self.starts[ids] - ends + size, size) + np.arange(len(data))]
        return ends if spelled.tobytes() == data else None


class ByteEncoder(Spelling):
    """A byte-level vocabulary whose special tokens are ordinary text where a text has them."""

    def __init__(self, path: str, pattern: str):
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.own = _library(path, True)
        of = byte_alphabet()
        spelled = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if all(c in of for c in t)}
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        self.fast = _ranked("bytes", pattern, {t: i for t, i in spelled.items() if t.decode("utf-8", "replace") not in special})
        self.table = {i: t for t, i in spelled.items()}

    def encode(self, text: str) -> np.ndarray:
        if BEYOND.search(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


class PieceEncoder(Spelling):
    """A vocabulary of pieces that puts a space before each text and has bytes for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.table = {i: bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(n) if not own.is_control(i)}
        self.id_of: dict[int, int] = {}
        first, then = [], []
        for i, piece in self.table.items():
            if not own.is_byte(i) and not own.is_unknown(i):
                (first if len(piece.decode()) == 1 else then).append((piece, i))
        then.sort(key=lambda x: -own.get_score(x[1]))
        # All bytes, then characters, which merging makes of their bytes before anything else, then pieces by score.
        single = {p: i for p, i in first if len(p) == 1}
        ranks: dict[bytes, int] = {}
        order = [(bytes([b]), single.get(bytes([b]), own.piece_to_id(f"<0x{b:02X}>"))) for b in range(256)]
        order += [(p, i) for p, i in first if len(p) == 2] + [(p, i) for p, i in then if not BEYOND.search(p.decode())]
        for rank, (piece, _) in enumerate(order):
            ranks[piece] = rank
        self.ids = np.array([i for _, i in order], np.uint32)
        # No piece goes on after a space that follows something else, so texts may be cut before their spaces.
        self.cuts = not any(re.search("[^ ] ", p.decode("utf-8", "replace")) for p in ranks if len(p) > 1)
        self.fast = _ranked("pieces", " +[^ ]*|[^ ]+", ranks)

    def encode(self, text: str) -> np.ndarray:
        if not text or BEYOND.search(text) or not self.cuts:
            return np.array(self.own.encode(text), np.uint32)
        return self.ids[np.array(self.fast.encode_ordinary(" " + text), np.int64)]


class WordEncoder:
    """A vocabulary of lower-case words and their ends; white space is dropped.

    Merging starts from a word's last character with its end, which is written as a zero byte here: the ids of
    characters with an end come before all others. Texts that have a zero, or a special token, go to the library.
    """

    def __init__(self, path: str):
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.own = _library(path, False)
        self.special = re.compile("|".join(["\\x00", *(re.escape(t.content) for t in self.own.get_added_tokens_decoder().values())]))
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_L}]+|[{LATIN_N}]|[^{LATIN_S}{LATIN_L}{LATIN_N}]+")
        of, end = byte_alphabet(), "</w>"
        ranks = {}
        for token, i in vocabulary.items():
            bare, tail = (token[: -len(end)], b"\0") if token.endswith(end) and token != end else (token, b"")
            if all(c in of for c in bare):
                ranks[bytes(of[c] for c in bare) + tail] = i
        for token in self.own.get_added_tokens_decoder().values():
            ranks.pop(token.content.encode(), None)
        self.fast = _ranked("words", "[^\\x00]+\\x00", ranks)
        self.kept: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return self._library(text)
        if BEYOND.search(text):
            # No word crosses a space or a line's end.
            parts = [self._known(p) for p in text.replace("\n", " ").split(" ") if p]
            return np.concatenate(parts) if parts else np.array([], np.uint32)
        words = self.split.findall(text.lower())
        return np.array(self.fast.encode_ordinary("\0".join([*words, ""])), np.uint32)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def _known(self, part: str) -> np.ndarray:
        found = self.kept.get(part)
        if found is None:
            if len(self.kept) >= MAX_KEPT:
                self.kept.clear()
            found = self.kept[part] = self._library(part)
        return found


@lru_cache(maxsize=4)
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each vocabulary and worker process, as below."""
    return ByteEncoder(path, pattern)


@lru_cache(maxsize=4)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def public_vocabulary(name: str) -> str:
    """Path of an installed vocabulary, which every machine has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    """The pattern by which byte-level vocabularies split texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN
