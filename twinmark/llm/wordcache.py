"""Whole texts to ids with the tokenizers library, one space-separated chunk at a time.

The library spends most of its time on alignment data that nobody reads here. Words repeat, so
each distinct chunk is given to the library once and its ids are kept, as the little-endian
unsigned 32-bit bytes that checksums and files want. The table of chunks is bounded: it is
emptied when it is full, which costs time but changes no result.

Why chunks are exact. byte-level BPE: its splitting pattern never crosses from a non-space into
an isolated single space, so " chunk" is always split from what stands before it; a text that has
any other kind of gap beside a space is given to the library whole. Word BPE that drops white
space: no token crosses white space, and normalisation acts on each side of it alone. A text that holds
the string of an added token is given to the library whole too, so such a string gets the id that the
library as loaded gives it; with as_text it is ordinary text.
"""

from __future__ import annotations

import os

import numpy as np
import regex

from twinmark.llm.common import kept

U4 = np.dtype("<u4")


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


SPLIT = {
    # The splitting patterns of the two tokenizers, as their files state them.
    True: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    False: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}


class ChunkEncoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids, as the library gives for the whole text.

    drops_space: the tokenizer removes white space and lowercases (else it is byte-level and keeps it).
    as_text: strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, drops_space: bool, limit: int = 850_000, as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = as_text
        self.added = [] if as_text else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.drops_space, self.limit = drops_space, limit
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tok.model
        self.split = regex.compile(SPLIT[drops_space])

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, U4).tobytes()

    def piece(self, piece: str) -> bytes:
        """ids of one piece of the splitting pattern, from the library's BPE model."""
        if (got := self.pieces.get(piece)) is None:
            bare = piece.removeprefix(" ")
            if bare.isascii() and bare.isalpha():
                letters = piece if bare is piece else f"{BYTE_LETTERS[32]}{bare}"
            else:
                letters = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(piece) < 4 and len(self.pieces) < 100_000:
                self.pieces[piece] = got
        return got

    def learn(self, chunks: list[str]) -> None:
        """Printable Latin-1 is split here, where all Unicode versions agree; the rest by the library."""
        lead, mixed, known, find, piece = "" if self.drops_space else " ", [], self.known, self.split.findall, self.piece
        for c in chunks:
            if c.isalpha() and c.isascii() and (lead or c.islower()):
                known[c] = piece(lead + c)
            elif c and max(c) < "\u0100" and c.replace("\n", "").isprintable() and (lead or c == c.lower()):
                known[c] = b"".join([known[w] if (w := p.removeprefix(lead)) in known and p.startswith(lead) else piece(p) for p in find(lead + c)])
            else:
                mixed.append(c)
        for c, e in zip(mixed, self.tok.encode_batch_fast([f"{lead}{c}" for c in mixed], add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, U4).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        given = text
        if self.drops_space:
            try:
                text.encode("latin-1")
                text = text.lower()  # precomposed letters only: lowering first changes nothing
            except UnicodeEncodeError:
                pass
        for a in self.added:
            if a in text:  # also where it is only once lowered: the library looks for it before it lowers
                return self.whole(given)
        if self.drops_space:
            chunks, head = text.replace("\n", " ").split(" "), b""
        else:
            first, *chunks = text.split(" ")
            if first.strip() != first or not first:
                return self.whole(text)
            head = self.whole(first) if chunks else None
            if head is None:
                return self.whole(text)
        known = self.known
        try:
            return head + b"".join([known[c] for c in chunks])
        except KeyError:
            new = list(set(chunks).difference(known))
            if not self.drops_space and any(not c or c.strip() != c for c in new):
                return self.whole(text)
            if len(known) + len(new) > self.limit:
                known.clear()
                new = list(set(chunks))
            self.learn(new)
            return head + b"".join([known[c] for c in chunks])


def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """One encoder per file and Python worker."""
    mine = kept("encoder")
    if (path, drops_space) not in mine:
        mine.clear()
        mine[path, drops_space] = ChunkEncoder(path, drops_space, 400_000 if drops_space else 850_000)  # lower case repeats more
    return mine[path, drops_space]
