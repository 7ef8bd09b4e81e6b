"""Byte-level BPE by prefix-sharing trie traversal.

``encode_sorted`` takes the distinct words of a batch as a trie: in sorted order
the words *are* the depth-first walk of their trie, and the part a word shares
with the one before is the path that stays on the stack. Each node of the path
holds one state, the last token of the encoding of its prefix; a child's state
follows from the states of its ancestors, so a shared prefix is encoded once.

Why one state is enough: the BPE encoding of a prefix ends in exactly one token
``t``, what stands before ``t`` is the encoding of the shorter prefix, and a
candidate ``t`` is right exactly if BPE would not merge across the seam between
``t`` and the token before it. ``BpeModel.stays`` decides that by undoing the
merges of both sides.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex

#: Fixed value: the public pattern that splits text into words before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = regex.compile(WORD_PATTERN)
#: A space inside a longer run of white space: only there a cut before the space may part a word.
_UNSAFE = regex.compile(r"\s (?:\s|\Z)")

_models: dict[str, "BpeModel"] = {}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """Vocabulary and merges of one tokenizer file (the ``tokenizers`` JSON form)."""

    def __init__(self, file_bytes: bytes):
        model = json.loads(file_bytes)["model"]
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        pieces = {}
        for s, i in model["vocab"].items():
            if all(c in letters for c in s):
                pieces[to_bytes(s)] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        made = set()
        for order, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = pieces[to_bytes(left)], pieces[to_bytes(right)]
            whole = pieces[to_bytes(left) + to_bytes(right)]
            self.rank[a, b] = (order, whole)
            self.halves.setdefault(whole, (a, b))
            made.add(whole)
        # a piece no merge makes (a special token spelled in plain letters) is never produced
        self.ids = {p: i for p, i in pieces.items() if len(p) == 1 or i in made}
        self.order = {whole: order for (order, whole) in self.rank.values()}
        size = max(self.ids.values()) + 1
        self.length = [0] * size
        for p, i in self.ids.items():
            self.length[i] = len(p)
        longest = [1] * 256
        for p in self.ids:
            longest[p[-1]] = max(longest[p[-1]], len(p))
        self.longest = longest
        self._seams: dict[tuple[int, int], bool] = {}

    def stays(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b`` stay apart when BPE encodes their joined bytes."""
        known = self._seams.get((a, b))
        if known is None:
            if len(self._seams) > 2_000_000:
                self._seams.clear()
            known = self._seams[a, b] = self._stays(a, b)
        return known

    def _stays(self, a: int, b: int) -> bool:
        # Walk the merges of both sides backwards in time. A merge across the seam
        # is done if it comes before the merge that used up the token to the left
        # of it, and not after the one that used up the token to the right: of
        # equal merges BPE does the left one first.
        rank, halves, order = self.rank, self.halves, self.order
        before = 1 << 60
        while True:
            seam = rank.get((a, b))
            if seam is not None and seam[0] < before:
                return False
            when_a, when_b = order.get(a, -1), order.get(b, -1)
            if when_a > when_b:
                before, a = when_a, halves[a][1]
            elif when_b >= 0:
                before, b = when_b + 1, halves[b][0]
            else:
                return True


def load_model(file_bytes: bytes) -> BpeModel:
    """The model of a vocabulary file; one per Python worker and file."""
    key = hashlib.sha1(file_bytes).hexdigest()
    if key not in _models:
        _models[key] = BpeModel(file_bytes)
    return _models[key]


def encode_sorted(model: BpeModel, words: list[bytes]) -> list[list[int]]:
    """The token ids of each of the sorted, distinct, non-empty ``words``."""
    ids, longest, length, stays = model.ids, model.longest, model.length, model.stays
    out: list[list[int]] = []
    path: list[int] = []
    prev = b""
    for w in words:
        n = len(w)
        top = min(len(prev), n)
        shared = 0
        if prev[:top] == w[:top]:
            shared = top
        else:
            while prev[shared] == w[shared]:
                shared += 1
        del path[shared:]
        for end in range(shared + 1, n + 1):
            start = end - longest[w[end - 1]]
            for s in range(start if start > 0 else 0, end):
                t = ids.get(w[s:end])
                if t is not None and (s == 0 or stays(path[s - 1], t)):
                    path.append(t)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        tokens = []
        at = n
        while at:
            t = path[at - 1]
            tokens.append(t)
            at -= length[t]
        tokens.reverse()
        out.append(tokens)
        prev = w
    return out


class _Codes(dict):
    """Numbers strings as they are first asked for; ``new`` has those still to be encoded."""

    def __init__(self, owner: "TextEncoder", lead: str):
        super().__init__()
        self.owner, self.lead, self.new = owner, lead, []

    def __missing__(self, key: str) -> int:
        code = self[key] = self.owner.total
        self.owner.total += 1
        self.new.append((code, key))
        return code


class TextEncoder:
    """Encodes batches of texts, keeping the ids of chunks seen before.

    A text is cut before every single space; away from longer runs of white
    space such a cut never parts a word of the pattern, so the ids of the chunks
    in order are the ids of the text. Texts with longer runs are split by the
    pattern itself. The kept chunks are dropped when they exceed ``keep``, so
    memory is bounded; the ids never depend on what is kept.
    """

    def __init__(self, model: BpeModel, keep: int = 300_000):
        self.model, self.keep = model, keep
        self._reset()

    def _reset(self) -> None:
        self.total = 0
        self.bare, self.spaced = _Codes(self, ""), _Codes(self, " ")
        self.words: dict[str, list[int]] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, one after the other."""
        if self.total > self.keep:
            self._reset()
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        codes: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                if _UNSAFE.search(text):
                    codes.extend(map(bare, _WORDS.findall(text)))
                else:
                    chunks = text.split(" ")
                    if chunks[0]:
                        codes.append(bare(chunks[0]))
                    codes.extend(map(spaced, chunks[1:]))
            ends[k + 1] = len(codes)
        self._encode_new()
        at = np.array(codes, np.int64)
        counts = self.count[at]
        sums = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        ids = self.pool[np.repeat(self.start[at] - sums[:-1], counts) + np.arange(sums[-1])]
        return sums[ends], ids

    def _encode_new(self) -> None:
        split = [(code, _WORDS.findall(c.lead + key)) for c in (self.bare, self.spaced) for code, key in c.new]
        self.bare.new, self.spaced.new = [], []
        if not split:
            return
        known = self.words
        if len(known) > self.keep:
            known.clear()
        fresh = sorted({w.encode("utf-8", "surrogatepass"): w for _, ws in split for w in ws if w not in known}.items())
        for (_, w), ids in zip(fresh, encode_sorted(self.model, [b for b, _ in fresh])):
            known[w] = ids
        self.start = _grown(self.start, self.total)
        self.count = _grown(self.count, self.total)
        for code, ws in split:
            ids = [i for w in ws for i in known[w]]
            self.pool = _grown(self.pool, self.used + len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            self.start[code], self.count[code] = self.used, len(ids)
            self.used += len(ids)


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    if need <= len(a):
        return a
    b = np.empty(max(need, 2 * len(a)), a.dtype)
    b[: len(a)] = a
    return b


_encoders: dict[str, TextEncoder] = {}


def text_encoder(file_bytes: bytes) -> TextEncoder:
    """The worker's encoder for a vocabulary file."""
    key = hashlib.sha1(file_bytes).hexdigest()
    if key not in _encoders:
        _encoders[key] = TextEncoder(load_model(file_bytes))
    return _encoders[key]
