"""Token ids of whole texts, by the ``tokenizers`` library.

A tokenizer whose pre-tokens never cross white space (``word_bpe_49k.json``) is asked once for each
distinct word: a hash table of word hashes gives the ids of a block's words in a few array steps.
Any other tokenizer file is applied text by text. The ids are those of ``Tokenizer.encode`` with
``add_special_tokens=False`` in both cases.
"""

from __future__ import annotations

import json
import os

import numpy as np

from foliospark.llm import text_arrays as ta

_U = np.uint64
#: What the JSON of a tokenizer says if words between white space can be encoded one by one.
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Slots of the table of words, 16 bytes each; it is emptied when half of them are taken or when it holds STORED ids, so a worker's
#: memory stays bounded. Only while a single block has more new words than fit is it wider.
_BITS = 20
STORED = 1 << 25


def default_path() -> str:
    """The file that packing uses unless another is given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table:
    """Open addressing: word hash to a range of stored ids."""

    def __init__(self, bits: int = _BITS):
        self.least = bits
        self.clear()

    def clear(self) -> None:
        self._empty(self.least)
        self.store, self.stored, self.used = np.zeros(1 << 16, np.uint16), 0, 0

    def _empty(self, bits: int) -> None:
        self.bits, size = bits, 1 << bits
        self.keys, self.first, self.count = np.zeros(size, _U), np.zeros(size, np.int32), np.zeros(size, np.int32)

    def full(self) -> bool:
        return 2 * self.used > 1 << self.least or self.stored > STORED

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it is not there."""
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        at = self.keys[slot]
        left = np.flatnonzero((at != h) & (at != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            at[left] = self.keys[slot[left]]
            left = left[(at[left] != h[left]) & (at[left] != 0)]
        slot[at == 0] = -1
        return slot

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """h: distinct hashes that are not there yet."""
        flat = np.fromiter((i for x in ids for i in x), np.uint16)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.stored + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.stored : self.stored + len(flat)] = flat
        first = self.stored + np.cumsum(count) - count
        self.stored += len(flat)
        self.used += len(h)
        if 4 * self.used > 3 * len(self.keys):
            held = np.flatnonzero(self.keys)
            old = self.keys[held], self.first[held], self.count[held]
            self._empty((2 * self.used).bit_length())
            self._place(*old)
        self._place(h, first, count)

    def _place(self, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        slot, left = (h >> _U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]
            won = self.keys[slot[left]] == h[left]
            done = left[won]
            self.first[slot[done]], self.count[slot[done]] = first[done], count[done]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class WordEncoder:
    """Ids of texts whose words are encoded one by one."""

    def __init__(self, path: str, plain: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.model = self.whole.model
        self.table = _Table()
        self.letters = _byte_letters()
        self.known: dict[str, list[int]] = {}
        self.simple = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.split = regex.compile(_WORD_SPLIT)

    def word(self, raw: bytes) -> list[int]:
        s = raw.decode("utf-8", "replace")
        if "<|" in s or not self.simple.fullmatch(s):
            return self.whole.encode(s, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.split.findall(s.lower()):
            ids = self.known.get(part)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[part] = ids
            out += ids
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        special = b"<|" in raw
        words = ta.Words(buf, offsets, fold=not special)
        h = ta.mix(words.hashes ^ _U(77)) if special else words.hashes
        h[h == 0] = 1
        if self.table.full():
            self.table.clear()
        slot = self.table.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            at = new[first]
            self.table.add(fresh, [self.word(raw[a:b]) for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
            slot = self.table.find(h)  # all of them: the table may be wider now
        count = self.table.count[slot].astype(np.int64)
        ends = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=ends[1:])
        place = np.arange(ends[-1]) + np.repeat(self.table.first[slot] - ends[:-1], count)
        return self.table.store[place].astype(np.uint32), ends[words.bounds]


class TextEncoder:
    """Ids of texts encoded whole, for tokenizers that look across white space."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=bounds[1:])
        return np.fromiter((i for x in ids for i in x), np.uint32, int(bounds[-1])), bounds


_encoders: dict[tuple[str, bool], WordEncoder | TextEncoder] = {}


def encoder(path: str, plain: bool = False) -> WordEncoder | TextEncoder:
    """The encoder of a tokenizer file, one in each Python worker; ``plain``: special tokens' strings are ordinary text."""
    if (path, plain) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        vocabulary = len(kind["model"].get("vocab", ()))
        by_word = steps == _WORD_NORMALIZERS and splits[:1] == [_WORD_SPLIT] and vocabulary <= 1 << 16
        _encoders[path, plain] = (WordEncoder if by_word else TextEncoder)(path, plain)
    return _encoders[path, plain]
