"""Token ids of many short words at once: byte-pair merging over arrays, for a vocabulary whose tokens never span a blank.

Words are rows of a matrix of symbols; each step merges the lowest-ranked adjacent pair of every row that has one.
Words over LONGEST bytes go to the library. Letters of ASCII and Latin-1 are lower-cased, and cut off before a sign, over one
array of all bytes, so that a word is known however it is written and whatever sign follows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .tokens import PairMerger

LONGEST, NONE, SLOTS = 32, 1 << 30, 19
WIDTHS = ((0, 4), (4, 6), (6, 8), (8, 10), (10, 13), (13, 16), (16, 22), (22, LONGEST))
CHUNK, END = 1 << 20, re.compile(rb"[\t-\r ]")
#: A random value for each byte.
MIXED = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


class BatchEncoder(PairMerger):
    """Ids (little-endian unsigned 32-bit) of pieces of text without blanks, with a bounded memo."""

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in self.letters], "i4")
        self.end = np.array([vocab[c + self.suffix] for c in self.letters], "i4")
        # an open-addressed table of the pairs, probed for whole arrays
        self.keys, self.rank_of = np.full((1 << SLOTS) + 64, -1, "i8"), np.full((1 << SLOTS) + 64, NONE, "i4")
        for rank, (a, b) in enumerate(self.ranks):
            key = vocab[a] << 20 | vocab[b]
            at = int(self.slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.rank_of[at] = key, rank
        self.made = np.array([vocab[a + b] for a, b in self.ranks], "i4")
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = {bytes([b]): self.by_library(chr(b)) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "<"}
        self.memo, self.limit = WordMemo(limit), limit
        self.up = self.down = np.empty(0, "u8")

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def reach(self, n: int) -> None:
        """Powers of an odd number, and of its inverse modulo 2 ** 64, for texts of n bytes."""
        if n >= len(self.up):
            odd = 0xC2B2AE3D27D4EB4F
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, np.uint64(p))], dtype="u8") for p in (odd, pow(odd, -1, 1 << 64)))

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype("i8")

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype("i8") << 20 | b
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.rank_of[at], np.int32(NONE))
        more = np.nonzero((found != key) & (found >= 0))
        while len(more[0]):
            at[more] += 1
            found = self.keys[at[more]]
            hit = found == key[more]
            out[tuple(m[hit] for m in more)] = self.rank_of[at[more]][hit]
            on = ~hit & (found >= 0)
            more = tuple(m[on] for m in more)
        return out

    def merge_all(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many they are; both words and ids are rows, of which the first n places count."""
        width, rows = raw.shape[1], np.arange(len(raw))
        symbols = self.first[raw]
        symbols[rows, n - 1] = self.end[raw[rows, n - 1]]
        symbols[np.arange(width)[None, :] >= n[:, None]] = (1 << 20) - 1  # no pair has it
        rank = self.ranked(symbols[:, :-1], symbols[:, 1:])
        ids, left_over = np.zeros(raw.shape, "<u4"), n.copy()
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), int)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                ids[rows[over], : symbols.shape[1]], left_over[rows[over]] = symbols[over], n[over]
                live = ~over
                rows, n, symbols, rank, at, best = rows[live], n[live], symbols[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
            w, each = symbols.shape[1] - 1, np.arange(len(rows))
            skip = np.arange(w)[None, :] > at[:, None]
            symbols = np.where(skip, symbols[:, 1:], symbols[:, :-1])
            symbols[each, at] = self.made[best]
            rank = np.where(skip[:, :-1], rank[:, 1:], rank[:, :-1])
            n = n - 1
            left, right = at > 0, at < w - 1
            rank[each[left], at[left] - 1] = self.ranked(symbols[each[left], at[left] - 1], symbols[each[left], at[left]])
            rank[each[right], at[right]] = self.ranked(symbols[each[right], at[right]], symbols[each[right], at[right] + 1])
        return ids, left_over

    def merged_rows(self, x: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of at most LONGEST bytes each, given by their places in x, one after another, and how many each has."""
        length, found = np.zeros(len(starts), "i8"), []
        for low, width in WIDTHS:
            where = np.flatnonzero((size > low) & (size <= width))
            for i in range(0, len(where), 8192):
                part = where[i : i + 8192]
                raw = x[np.minimum(starts[part][:, None] + np.arange(width), len(x) - 1)]
                raw[np.arange(width)[None, :] >= size[part][:, None]] = 0
                ids, length[part] = self.merge_all(raw, size[part])
                found.append((part, ids))
        first, out = np.cumsum(length) - length, np.empty(int(length.sum()), "<u4")
        for part, ids in found:
            own = np.arange(ids.shape[1])[None, :] < length[part][:, None]
            out[(first[part][:, None] + np.arange(ids.shape[1]))[own]] = ids[own]
        return out, length

    def made_of(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each of these pieces."""
        known: dict[bytes, bytes] = {}
        # letters with at most one other byte after them are one or two pre-tokens; the pattern cuts all others
        plain: list[bytes] = []
        bodies: list[bytes] = []
        tails: list[bytes] = []
        odd: list[tuple[bytes, list[bytes]]] = []
        for piece in pieces:
            low = piece.lower()
            if low.isalpha():
                plain.append(piece)
                bodies.append(low)
                tails.append(b"")
            elif low[:-1].isalpha() and low[-1:] in self.marks:
                plain.append(piece)
                bodies.append(low[:-1])
                tails.append(self.marks[low[-1:]])
            else:
                text = piece.decode("utf-8", "replace")
                if "<" in text:
                    known[piece] = self.by_library(text)
                    continue
                text = unicodedata.normalize("NFC", text)
                text = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
                if text.isalpha():
                    plain.append(piece)
                    bodies.append(text.encode())
                    tails.append(b"")
                elif text[:-1].isalpha() and low[-1:] in self.marks:
                    plain.append(piece)
                    bodies.append(text[:-1].encode())
                    tails.append(self.marks[low[-1:]])
                else:
                    odd.append((piece, [w.encode() for w in self.pattern.findall(text)]))
        known.update(zip(plain, map(bytes.__add__, self.merged_ids(bodies), tails)))  # noqa: B905
        known.update(self.rest(odd))
        return known

    def rest(self, odd: list[tuple[bytes, list[bytes]]]) -> dict[bytes, bytes]:
        ids = iter(self.merged_ids([w for _, found in odd for w in found]))
        return {piece: b"".join([next(ids) for _ in found]) for piece, found in odd}

    def merged_ids(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words], "i8")
        starts, short = np.cumsum(size) - size, np.flatnonzero(size <= LONGEST)
        ids, length = self.merged_rows(np.frombuffer(b"".join(words), np.uint8), starts[short], size[short])
        data, ends, out = ids.tobytes(), (4 * np.cumsum(length)).tolist(), [b""] * len(words)
        for k, low, high in zip(short.tolist(), [0, *ends], ends):  # noqa: B905
            out[k] = data[low:high]
        for k in np.flatnonzero(size > LONGEST).tolist():
            out[k] = self.by_library(words[k].decode("utf-8", "replace"))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Arrays stay small: texts go in groups of about CHUNK bytes, and longer ones in parts that end at a blank."""
        out: list[bytes] = []
        group: list[bytes] = []
        held = 0
        for t in texts:
            if held and held + len(t) > CHUNK:
                out += self.encode_group(group)
                group, held = [], 0
            if len(t) <= CHUNK:
                group.append(t)
                held += len(t)
                continue
            parts, at = [], 0
            while at < len(t):
                cut = END.search(t, at + CHUNK)
                to = cut.start() if cut else len(t)
                parts += self.encode_group([t[at:to]])
                at = to
            out.append(b"".join(parts))
        return out + self.encode_group(group) if group else out

    def folded(self, raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with letters of ASCII and of U+00C0 to U+00FF in lower case, which of them are letters' bytes, and which are signs right
        after a letter, where one pre-token always ends. Words with other bytes, whose composition may depend on the case, and words
        with "<", which may begin a special token, stay as they are, in one piece."""
        span = lambda x, low, high: x - np.uint8(low) <= np.uint8(high - low)  # noqa: E731  (comparing is faster than looking up)
        lead = raw == 0xC3
        latin = np.r_[False, lead[:-1]] & span(raw, 0x80, 0xBF)
        letters = latin & (raw != 0x97) & (raw != 0xB7)
        plain = span(raw | np.uint8(32), 97, 122)
        x = raw + ((span(raw, 65, 90) | letters & (raw < 0x9F)).view(np.uint8) << np.uint8(5))
        odd = np.flatnonzero((raw == 60) | (raw >= 128) & ~lead & ~latin | lead & ~np.r_[latin[1:], False])
        letters |= plain
        cut = np.r_[False, letters[:-1]] & span(raw, 33, 126) & ~plain & ~span(raw, 48, 57)
        letters |= lead & np.r_[letters[1:], False]
        if len(odd):
            edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
            word = np.unique(np.searchsorted(edge[::2], odd, "right") - 1)
            mark = np.zeros(len(raw) + 1, "i1")
            mark[edge[::2][word]], mark[edge[1::2][word]] = 1, -1
            as_is = np.cumsum(mark[:-1], dtype="i1").view(bool)
            x, letters, cut = np.where(as_is, raw, x), letters & ~as_is, cut & ~as_is
        return x, letters, cut

    def learn(self, x: np.ndarray, h: np.ndarray, starts: np.ndarray, size: np.ndarray, plain: np.ndarray) -> None:
        """Keep words that the memo lacks; plain ones are single pre-tokens of lower-case letters."""
        plain = plain & (size <= LONGEST)
        ids, length = self.merged_rows(x, starts[plain], size[plain])
        own = size[plain]
        at = np.repeat(starts[plain] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        self.memo.add(h[plain], x[at], own, ids, length)
        pieces = [x[s : s + n].tobytes() for s, n in zip(starts[~plain].tolist(), size[~plain].tolist(), strict=True)]
        made = self.made_of(pieces)
        self.memo.add(h[~plain], *joined(pieces), *joined([made[p] for p in pieces], "<u4"))

    def encode_group(self, texts: list[bytes]) -> list[bytes]:
        """Words are hashed (64 bits) over one array of all bytes, and only words whose hash is new are merged. What a hash finds is
        compared byte by byte."""
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = (raw != 32) & (raw - np.uint8(9) > 4)
        x, letters, cut = self.folded(raw, inside)
        before = np.r_[False, inside[:-1]]
        starts, ends = np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))
        if not len(starts):
            return [b""] * len(texts)
        # a polynomial of the bytes' random values, from prefix sums
        self.reach(len(x))
        total = np.r_[np.uint64(0), np.cumsum(MIXED[x] * self.up[: len(x)], dtype="u8")]
        h = (total[ends] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        size, number = ends - starts, self.memo.find(h)
        if (number < 0).any():
            others = np.r_[np.int32(0), np.cumsum(~letters, dtype="i4")]
            lost = np.flatnonzero(number < 0)
            fresh, first = np.unique(h[lost], return_index=True)
            where = lost[first]
            if self.memo.n + len(fresh) > self.limit:
                self.memo.reset()
                fresh, where = np.unique(h, return_index=True)
            self.learn(x, fresh, starts[where], size[where], others[ends[where]] == others[starts[where]])
            number = self.memo.find(h)
        wrong = self.memo.others(number, size, x[inside])
        if len(wrong):  # words that share their hash with another word
            pieces = [x[s:e].tobytes() for s, e in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)]
            made = self.made_of(list(dict.fromkeys(pieces)))
            place = {p: k for k, p in enumerate(made)}
            number[wrong] = self.memo.beside(made)[[place[p] for p in pieces]]
        first, length = self.memo.first[number], self.memo.length[number]
        after = np.cumsum(length)
        take = np.repeat(first - (after - length), length) + np.arange(int(after[-1]))
        ids = self.memo.pool[take]
        # texts end at the blank that joins them
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.r_[0, after][np.searchsorted(starts, text_ends)]
        data, out, low = ids.tobytes(), [], 0
        for high in (4 * upto).tolist():
            out.append(data[low:high])
            low = high
        return out


def joined(parts: list[bytes], kind: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """All parts as one array, and the length of each in it."""
    x = np.frombuffer(b"".join(parts), kind)
    return x, np.array([len(p) for p in parts], "i8") // x.itemsize


class WordMemo:
    """Ids of words by their 64-bit hash, in arrays: an open-addressed table, a pool of ids, and a pool of the words' bytes."""

    def __init__(self, limit: int):
        self.slots = 1 << max(12, (2 * limit - 1).bit_length())
        self.reset()

    def reset(self) -> None:
        self.n = self.used = 0
        self.key, self.number = np.zeros(self.slots, "u8"), np.full(self.slots, -1, "i4")
        self.first, self.length, self.pool = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "<u4")
        self.begin, self.size, self.bytes, self.held = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u1"), 0

    clear = reset

    def at(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (self.slots.bit_length() - 1))).astype("i8")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 where unknown."""
        at = self.at(h)
        out = np.where(self.key[at] == h, self.number[at], -1)
        more = np.flatnonzero((out < 0) & (self.number[at] >= 0))
        at = at[more]
        while len(more):
            at = (at + 1) & (self.slots - 1)
            number = self.number[at]
            hit = (number >= 0) & (self.key[at] == h[more])
            out[more[hit]] = number[hit]
            on = ~hit & (number >= 0)
            more, at = more[on], at[on]
        return out

    def others(self, number: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of the words, given by their sizes and all their bytes, that are not the words of these numbers."""
        ends, same = np.cumsum(size), self.size[number] == size
        at = np.repeat(self.begin[number] - (ends - size), size) + np.arange(len(data))
        if not same.all():
            np.minimum(at, self.held - 1, out=at)
        wrong = ~same
        wrong[np.searchsorted(ends, np.flatnonzero(self.bytes[at] != data), "right")] = True
        return np.flatnonzero(wrong)

    def beside(self, made: dict[bytes, bytes]) -> np.ndarray:
        """Numbers of words that no hash leads to."""
        self.keep(*joined(list(made)), *joined(list(made.values()), "<u4"))
        return np.arange(self.n - len(made), self.n)

    def add(self, h: np.ndarray, words: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Words whose hashes aren't there yet, each once: all their bytes and ids, and how many each has."""
        numbers, at, left = np.arange(self.n, self.n + len(h), dtype="i4"), self.at(h), np.arange(len(h))
        while len(left):
            free = self.number[at[left]] < 0
            slot, who = at[left[free]], left[free]
            self.number[slot] = numbers[who]  # of several for one slot the last stays
            won = self.number[slot] == numbers[who]
            self.key[slot[won]] = h[who[won]]
            left = np.concatenate([left[~free], who[~won]])
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.keep(words, size, ids, length)

    def keep(self, words: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        n, need, full = self.n + len(size), self.used + len(ids), self.held + len(words)
        for name, most in (("first", n), ("length", n), ("begin", n), ("size", n), ("pool", need), ("bytes", full)):
            x = getattr(self, name)
            if most > len(x):  # grows by doubling
                setattr(self, name, np.r_[x, np.empty(max(most, 1 << 16), x.dtype)])
        self.pool[self.used : need], self.bytes[self.held : full] = ids, words
        self.first[self.n : n], self.length[self.n : n] = self.used + np.cumsum(length) - length, length
        self.begin[self.n : n], self.size[self.n : n] = self.held + np.cumsum(size) - size, size
        self.used, self.held, self.n = need, full, n
