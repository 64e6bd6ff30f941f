"""Ids of whole texts by the tokenizers library, with a cache of words.

Both public vocabularies cut a text into words before they merge bytes, so the ids of a
text are the ids of its words. Texts are cut where that is certain, every distinct word is
encoded once by the library, and ids are put together in numpy. Texts of Latin letters,
ASCII and line feeds are cut as one byte array; their words are told apart by 64-bit
hashes of random byte values. Other texts are cut at single spaces, and tokenizers
of another make get whole texts. The result equals one `encode` call per text.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np

#: Letters that Unicode and Python agree on and that have no case rules of their own.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ſ"
#: Bytes of such texts in UTF-8, and what their bytes could also spell.
PLAIN_BYTES = bytes([10, *range(32, 127), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)])
NOT_PLAIN = [x.encode() for x in "×÷İıŉ"] + [b"<|"]
WORD = re.compile(f" [{LETTERS}]+")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Words are encoded together in texts of so many.
TOGETHER = 4000
#: The caches start anew beyond so many words, or so many characters of strings.
MOST_WORDS, MOST_CHARS = 600_000, 20_000_000
#: Longer texts are cut at single spaces, which takes no arrays of the text's size.
LONGEST = 16 << 20

_RANDOM = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_SPACE, _LINE, _QUOTE = 32, 10, 39


class Subwords:
    @staticmethod
    def of(path: str) -> Subwords:
        """The worker's own, kept for its next task; one at a time, to bound its memory."""
        held = sys.__dict__.setdefault("_repoloom_subwords", {})
        if path not in held:
            held.clear()
            held[path] = Subwords(path)
        return held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.vocab_size = self.tok.get_vocab_size()
        pre = json.dumps(made.get("pre_tokenizer"))
        names = json.dumps(made.get("normalizer"))
        if made["model"].get("end_of_word_suffix") and "Lowercase" in names and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre:
            self.kind = "word"
        elif made.get("normalizer") is None and '"type": "ByteLevel"' in pre and '"use_regex": true' in pre and '"add_prefix_space": false' in pre:
            self.kind = "byte"
        else:
            self.kind = "whole"
        edge = (lambda t: t.endswith("</w>")) if self.kind == "word" else (lambda t: t.startswith("Ġ"))
        self.edge = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for token, i in self.tok.get_vocab().items():
            self.edge[i] = edge(token)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}  # words of texts that are cut at spaces
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words of plain texts, and their slots
        self.slot = np.zeros(0, np.int64)
        self.chars = 0
        self.joined = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> np.ndarray:
        """Adds the words; returns their slots."""
        plain = [bool(self.kind != "whole" and WORD.fullmatch(w)) for w in words]
        together = [w for w, p in zip(words, plain) if p]
        rest = [w for w, p in zip(words, plain) if not p]
        ids, n = [self.joined], []
        for i in range(0, len(together), TOGETHER):
            part = together[i : i + TOGETHER]
            got = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.edge[got])
            sizes = np.diff(np.r_[-1, at]) if self.kind == "word" else np.diff(np.r_[at, len(got)])
            if len(sizes) != len(part):
                raise ValueError("words that were encoded together can't be told apart")
            ids.append(got)
            n.append(sizes)
        for e in self.tok.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            n.append(np.array([len(e.ids)]))
        slots, first, p = np.empty(len(words), np.int64), len(self.start) - 1, np.array(plain, bool)
        slots[p] = first + np.arange(len(together))
        slots[~p] = first + len(together) + np.arange(len(rest))
        self.joined = np.concatenate(ids)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(n or [np.zeros(0, np.int64)]))])
        return slots

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(slots of all words, number of words before each text and at the end)."""
        held = b"\0" + b"\0".join(texts) + b"\0"
        b = np.frombuffer(held, np.uint8)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size + 1) - size
        letter = _LETTER[b]
        turn = np.diff(letter.view(np.int8))
        s, e = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
        before, gap = b[s - 1], b[np.maximum(s - 2, 0)]
        # an apostrophe joins its neighbours (contractions), and so does white space of two or more
        own = (b[e] != _QUOTE) & (before != _QUOTE) & ~((before == _LINE) & ((gap == _LINE) | (gap == _SPACE)))
        s, e = s[own] - (before[own] == _SPACE), e[own]
        edge = np.zeros(len(b) + 1, bool)
        edge[s] = edge[e] = edge[begin] = edge[begin + size] = True
        start = np.flatnonzero(edge)
        end = np.r_[start[1:], len(b)]
        word = b[start] != 0  # else it is what parts two texts
        start, end = start[word], end[word]
        n = end - start
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        values = _RANDOM[b[np.repeat(start, n) + where]] * _POWERS[where & 4095] + (where >> 12).astype(np.uint64)
        hashes = np.add.reduceat(values, np.cumsum(n) - n) if len(n) else np.zeros(0, np.uint64)
        hashes ^= hashes >> np.uint64(29)
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + n.astype(np.uint64)
        words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != words
        if new.any():
            i = first[new]
            slots = self._encode([held[x:y].decode() for x, y in zip(start[i], end[i])])
            self.slot = np.insert(self.slot, at[new], slots)
            self.known = np.insert(self.known, at[new], words[new])
            at = np.searchsorted(self.known, words)
        return self.slot[at][back], np.searchsorted(start, np.r_[begin, len(b)])

    def _ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words side by side, and how many stand before each word and at the end."""
        n = self.start[slots + 1] - self.start[slots]
        before = np.r_[0, np.cumsum(n)]
        return self.joined[np.repeat(self.start[slots] - before[:-1], n) + np.arange(before[-1])], before

    def _spaced(self, text: str) -> np.ndarray:
        first, *rest = SINGLE.split(text) if self.kind != "whole" else [text]
        words = [first, *(" " + w for w in rest)]
        new = list(set(words) - self.at.keys())
        if new:
            self.at.update(zip(new, self._encode(new).tolist()))
            self.chars += sum(map(len, new))
        return self._ids(np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)))[0]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null is empty."""
        if len(self.start) > MOST_WORDS or self.chars > MOST_CHARS:
            self._clear()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        fast: list[int] = []
        held: list[bytes] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            raw = (t.lower() if self.kind == "word" else t).encode("utf-8", "surrogatepass")
            if self.kind == "whole" or len(raw) > LONGEST or raw.translate(None, PLAIN_BYTES) or any(x in raw for x in NOT_PLAIN):
                out[i] = self._spaced(t)
            else:
                fast.append(i)
                held.append(raw)
        if fast:
            slots, cut = self._plain(held)
            ids, before = self._ids(slots)
            for i, a, z in zip(fast, before[cut[:-1]], before[cut[1:]]):
                out[i] = ids[a:z]
        return out
