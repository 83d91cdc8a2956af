"""Token ids of whole texts.

Texts of up to a million characters meet the tokenizer as they are: a call for each word that no cache has (every fourth word of
the given texts) took longer than the tokens. Longer ones are parted into chunks. A byte-level BPE never merges across the border between a visible character and the white space after it, so the ids of
a text are those of its chunks, one after the other. Chunks repeat, so their ids are kept in a cache of bounded size, and
no longer text meets the tokenizer as one string.

The vocabulary is read from the file of the `tokenizers` library. Texts and unknown chunks are encoded by `tiktoken` with that same
vocabulary, which gives the same ids in a third of the time (the tests hold them against `tokenizers`). A text is first
parted at the file's added tokens, as that library does: each is one id, wherever it stands.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .arrow import kept

#: White space and the visible run after it. The control characters 1C to 1F are white space for Python, not for the tokenizer.
CHUNK = re.compile(r"\s*\S+(?:[\x1c-\x1f]\s*\S*)*|\s+")
#: White space before a blank or a line end: such texts aren't split at single characters.
RUN = re.compile(r"\s[ \n]")
#: How the tokenizer splits a text before it merges bytes (fixed by the vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a worker's cache, about (an entry takes some 200 besides its characters), and the longest chunk that is kept in it.
CACHE_BYTES, CACHE_CHARS = 24 << 20, 32
#: Characters of the longest text that isn't parted.
WHOLE_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary spells bytes: visible Latin-1 ones for themselves, from 256 on for the rest."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers. A key with no line end before it stands for a blank and itself."""

    def __init__(self, tokenizer_path: str):
        import tiktoken

        super().__init__()
        with open(tokenizer_path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{tokenizer_path}: added tokens that take more than their own characters")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added}
        self.parting = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.room = CACHE_BYTES
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        ranks = {token: i for token, i in ranks.items() if i < len(ranks)}
        self.ranks = ranks
        #: Bytes of each id that the vocabulary or an added token has, and their number.
        self.spelled = {i: token for token, i in ranks.items()} | {t["id"]: t["content"].encode() for t in added}
        self.sizes = np.zeros(max(self.spelled) + 1, np.int64)
        self.sizes[list(self.spelled)] = [len(token) for token in self.spelled.values()]
        self.encode = tiktoken.Encoding("chunks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ids(chunk if chunk[:1] == "\n" else " " + chunk)
        if len(chunk) <= CACHE_CHARS:
            self.room -= 200 + 4 * len(chunk) + len(ids)
            if self.room < 0:
                self.clear()
                self.room = CACHE_BYTES
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def meet(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side inside a pre-token.

        Pairs merge by rank, the leftmost first, so a row of tokens is what its bytes are encoded as just when each two
        neighbours in it are.
        """
        a, b = self.spelled[left], self.spelled[right]
        if a not in self.ranks or b not in self.ranks:
            return False
        parts = [bytes([c]) for c in a + b]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == [a, b]


def chunk_ids(tokenizer_path: str) -> ChunkIds:
    """The cache of this worker for a tokenizer file."""
    return kept(("tokens", tokenizer_path), lambda: ChunkIds(tokenizer_path))


def encode(text: str | None, known: ChunkIds) -> bytes:
    """Ids of a whole text, four bytes each."""
    if not text:
        return b""
    if not any(t in text for t in known.added):
        return encode_part(text, known)
    out, last = [], 0
    for m in known.parting.finditer(text):
        out += encode_part(text[last : m.start()], known), known.added[m[0]]
        last = m.end()
    return b"".join([*out, encode_part(text[last:], known)])


def encode_part(text: str, known: ChunkIds) -> bytes:
    """Ids of a text without added tokens."""
    if not text:
        return b""
    if len(text) <= WHOLE_CHARS:
        return known.ids(text)
    if RUN.search(text):
        return b"".join([known[c[1:]] if c[0] == " " and c[1:2] != "\n" else known.ids(c) if c[0] != "\n" else known[c] for c in CHUNK.findall(text)])
    first, *rest = text.replace("\n", " \n").split(" ")
    return known.ids(first) + b"".join(map(known.__getitem__, rest))
