"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words are merged many at a time in flat numpy arrays. A word is a run of escaped spaces and the
characters up to the next one; the vocabulary has no piece with a space after another character
(checked when it is loaded), so no merge crosses words. In each round every word finds its minimum
pair rank, all its leftmost pairs of that rank merge at once, the arrays are compacted, and words
without a pair drop out. Merging several pairs of one word at once is what the library does one by
one, unless the first merge makes a new pair that comes before the next one; then the word merges
only up to that place in this round. Words longer than LONG symbols go through a heap in the same
order of merges, since rounds over one endless word would be quadratic.

Symbols not in the vocabulary become byte pieces. Decoding joins pieces, turns byte pieces back
into UTF-8 and escaped spaces into spaces, and drops the space that encoding put in front.

Nulls are empty texts; the empty text has no ids. Rows are encoded one by one, also where ids or whole rows repeat; pairs of
equal rank merge leftmost first. A very long text is cut into words in a task, in slices of a few megabytes. An empty table gives no
rows. Columns other than doc_id and text aren't read, whatever their names. The model file is read without the sentencepiece
library's encoder: only its list of pieces and scores is taken from it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import kept, ship, slices

SPACE = "▁"
LONG = 2048
NONE = np.iinfo(np.int64).max


class PieceModel:
    """Pieces, merge ranks and a bounded table of words already encoded."""

    def __init__(self, path: str, limit: int = 800_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses words")
        self.id_of = {self.pieces[i]: i for i in plain}
        rank_of_score = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(n + 1, NONE)
        for i in plain:
            self.rank[i] = rank_of_score[sp.get_score(i)]
        self.char = -1 - np.arange(0x110000)  # id of each character, or -1 - its code point
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.shown = [str(i) for i in range(n)]
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        # every split of a piece into two pieces
        keys, made = [], []
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        self.pair = dict(zip(keys, made, strict=True))
        self.slots = max(1 << 12, 4 << len(keys).bit_length())
        self.table_key, self.table_made = np.full(self.slots, -1), np.full(self.slots, -1)
        for k, m in self.pair.items():
            at = int(self._slot(np.array([k]))[0])
            while self.table_key[at] >= 0:
                at = (at + 1) % self.slots
            self.table_key[at], self.table_made[at] = k, m
        self.limit = limit
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1, from an open-addressed table. Negative symbols make none."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        at = self._slot(key)
        found = self.table_key[at]
        out = np.where(found == key, self.table_made[at], -1)
        left = np.flatnonzero((found >= 0) & (found != key))
        while len(left):  # next slot, for those that met another key
            at[left] = (at[left] + 1) % self.slots
            found = self.table_key[at[left]]
            out[left] = np.where(found == key[left], self.table_made[at[left]], -1)
            left = left[(found >= 0) & (found != key[left])]
        return out

    def long_word(self, sym: list[int]) -> list[int]:
        """The same merges in the same order, by a heap: for one word of any length."""
        n = len(sym)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (m := self.pair.get(sym[i] << 32 | sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, m, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, m, a, b = heapq.heappop(heap)
            if not (alive[i] and alive[j] and right[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], alive[j], right[i] = m, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    def words(self, words: list[str]) -> list[list[int]]:
        """Final symbols of each word: ids, or -1 - code point of a character without a piece."""
        n = np.array([len(w) for w in words], np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), n)
        out: dict[int, list[int]] = {}
        if n.max(initial=0) > LONG:
            start = np.cumsum(n) - n
            for k in np.flatnonzero(n > LONG).tolist():
                out[k] = self.long_word(sym[start[k] : start[k] + n[k]].tolist())
            fits = (n <= LONG)[word]
            sym, word = sym[fits], word[fits]
        made = np.full(len(sym), -1)
        if len(sym):
            made[:-1] = np.where(word[:-1] == word[1:], self.merged(sym[:-1], sym[1:]), -1)
        rank = self.rank[made]  # of the pair that starts here; -1 finds the last entry, NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[:-1] != word[1:]]))
            low = np.minimum.reduceat(rank, first)
            per = np.repeat(low, np.diff(np.append(first, len(sym))))
            still = per != NONE
            if not still.all():
                done.append((word[~still], sym[~still]))
                sym, word, made, rank, per = (x[still] for x in (sym, word, made, rank, per))
                if not len(sym):
                    break
            # leftmost, not overlapping: of each run of neighbouring hits every second one, from its start
            at = np.flatnonzero(rank == per)
            start = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            at = self._safe(sym, word, made, rank, at)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, made, rank = (x[keep] for x in (sym, word, made, rank))
            at = at - np.arange(len(at))
            # only pairs that hold a new symbol change
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            left = np.flatnonzero(changed)
            right = np.minimum(left + 1, len(sym) - 1)
            one = (right > left) & (word[left] == word[right])
            made[left] = np.where(one, self.merged(sym[left], sym[right]), -1)
            rank[left] = self.rank[made[left]]
        w, s = (np.concatenate([x[i] for x in done] or [np.empty(0, np.int64)]) for i in (0, 1))
        order = np.argsort(w, kind="stable")
        ends = np.searchsorted(w[order], np.arange(len(words) + 1)).tolist()
        flat = s[order].tolist()
        return [out[k] if k in out else flat[i:j] for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    def _safe(self, sym, word, made, rank, at):
        """Of the merges at `at` (ascending), those up to each word's first that makes an earlier pair."""
        w = word[at]
        more = w[1:] == w[:-1]
        if not more.any():
            return at
        group = np.concatenate([more, [False]]) | np.concatenate([[False], more])  # several merges in one word
        kept, at = at[~group], at[group]
        w, new, n = word[at], made[at], len(sym)
        back = np.maximum(at - 1, 0)
        before = np.where((at > 0) & (word[back] == w), sym[back], -1)
        # the left neighbour may itself have just been merged
        joined = np.concatenate([[False], (at[1:] - at[:-1] == 2) & (w[1:] == w[:-1])])
        before = np.where(joined, np.concatenate([[0], new[:-1]]), before)
        nxt = np.minimum(at + 2, n - 1)
        after = np.where((at + 2 < n) & (word[nxt] == w), sym[nxt], -1)
        early = np.minimum(self.rank[self.merged(before, new)], self.rank[self.merged(new, after)]) <= rank[at]
        # count the early ones of the same word before each merge; keep those with none before
        total = np.cumsum(early) - early
        first = np.concatenate([[True], w[1:] != w[:-1]])
        base = np.maximum.accumulate(np.where(first, total, 0))
        return np.sort(np.concatenate([kept, at[total == base]]))

    def decode_raw(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, escaped spaces as spaces; broken byte sequences as the library shows them."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(bytes(held).decode("utf-8", "replace").encode())
                held.clear()
            out.append(self.raw[i])
        if held:
            out.append(bytes(held).decode("utf-8", "replace").encode())
        return b"".join(out)

    @staticmethod
    def split(text: str) -> list[str]:
        """Words of the escaped text, each with the spaces before it: one space a word, and what
        longer runs of spaces need is taken together."""
        text = SPACE + text.replace(" ", SPACE)
        parts = text.split(SPACE)  # parts[0] is empty
        out, k, n = [], 1, len(parts)
        if "" not in parts[1:]:
            return parts[1:]
        while k < n:
            j = k
            while j < n - 1 and not parts[j]:
                j += 1
            out.append(SPACE * (j - k) + parts[j])
            k = j + 1
        return out

    def learn(self, texts: list[str]) -> None:
        """Encode the words of these texts that aren't known yet, all in the same rounds."""
        new: set[str] = set()
        for t in texts:
            new.update(self.split(t))
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
        words = list(new)
        for w, syms in zip(words, self.words([SPACE + w for w in words]), strict=True):
            self.known[w] = self._entry(syms)

    def encode(self, text: str) -> tuple[int, str, bytes]:
        """(number of ids, decimal ids joined by commas, UTF-8 of the decoded text).

        Words are known without their first escaped space, which each of them has."""
        if not text:
            return 0, "", b""
        words = self.split(text)
        try:
            got = [self.known[w] for w in words]
        except KeyError:
            self.learn([text])
            got = [self.known[w] if w in self.known else self._entry(self.words([SPACE + w])[0]) for w in words]
        n, ids, raw = zip(*got, strict=True)
        return sum(n), ",".join(ids), b"".join(raw)[1:]

    def _entry(self, syms: list[int]) -> tuple[int, str, bytes]:
        if not syms or min(syms) >= 0:
            return len(syms), ",".join([self.shown[i] for i in syms]), b"".join([self.raw[i] for i in syms])
        ids: list[int] = []
        for s in syms:
            ids += [s] if s >= 0 else [self.bytes_at[b] for b in chr(-1 - s).encode()]
        return len(ids), ",".join([self.shown[i] for i in ids]), self.decode_raw(ids)


def model(path: str) -> PieceModel:
    mine = kept("pieces")
    if path not in mine:
        mine[path] = PieceModel(path)
    return mine[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; with_ids adds the ids and the
    decoded text themselves. Needs doc_id and text; other columns are not read."""
    ship(docs.sparkSession)
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for b in slices(whole, "text"):
                n, ids, raw, full = [], [], [], []
                texts = [t or "" for t in b.column("text").to_pylist()]
                m.learn([t for t in texts if t])
                for t in texts:
                    k, i, r = m.encode(t)
                    n.append(k)
                    ids.append(hashlib.sha256(i.encode()).hexdigest())
                    raw.append(hashlib.sha256(r).hexdigest())
                    if with_ids:
                        full.append(([int(x) for x in i.split(",")] if i else [], r.decode()))
                cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([x for x, _ in full], pa.list_(pa.int32())), pa.array([x for _, x in full])]
                    names += ["ids", "decoded"]
                yield pa.record_batch(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
