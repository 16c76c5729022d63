"""Exact token ids by the tokenizers library, with the work shared between repeated words.

A byte-level BPE with the usual pre-tokenizer starts a new pre-token at every
single space between two characters that aren't white space, so the ids of a
text are the ids of its first chunk and then of each " chunk". Chunks repeat,
so each worker keeps the ids of those it has seen, in two generations of a
bounded size, and calls the library for the others, many at a time.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

#: A space where a chunk may start: no white space on either side. str.split and \\s agree with the tokenizer on these.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Chunks of one word, or of one word and a run of marks: two pre-tokens at most. Other chunks go through the whole tokenizer.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*|]*)")
_MARKS = frozenset(".,;:!?#$%&*|")
_coders: dict[tuple[str, int], "Coder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that a byte-level vocabulary writes for it: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in shown else next(free)) for b in range(256)}


class _Recent:
    """A map of at most about 2 * keep entries that forgets those not asked for lately."""

    def __init__(self, keep: int):
        self.keep, self.now, self.old = keep, {}, {}

    def lacking(self, keys: set) -> list:
        """Those of the keys that must be put into ``now``; the others are there until the next call."""
        if len(self.now) + len(keys) > self.keep:
            self.old, self.now = self.now, {}
        now, old, lack = self.now, self.old, []
        for k in keys.difference(now):  # quick for a plain dict only
            if k in old:
                now[k] = old[k]
            else:
                lack.append(k)
        return lack


class Coder:
    """Text -> ids as little-endian unsigned 32-bit bytes, for one tokenizer file.

    keep: bounds the cache of chunks to about twice as many entries, that of words to as many.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = Tokenizer(self.whole.model)  # for what is one pre-token already
        self.letters = _byte_letters()
        self.chunk_ids, self.word_ids = _Recent(keep), _Recent(keep // 2)

    @classmethod
    def of(cls, path: str, keep: int = 400_000) -> "Coder":
        if (path, keep) not in _coders:
            _coders[path, keep] = cls(path, keep)
        return _coders[path, keep]

    def learn(self, chunks: set[str]) -> set[str]:
        """Put the ids of " " + chunk for all these into the cache; returns those that a cut at each space shouldn't have made."""
        plain, other, words, odd = [], [], set(), set()
        for c in self.chunk_ids.lacking(chunks):
            if m := _PLAIN.fullmatch(c):
                w, marks = m.groups()
                plain.append((c, w, marks))
                words.add(w)
                if marks:
                    words.add(marks)
            elif not c or c[0].isspace() or c[-1].isspace():
                odd.add(c)
            else:
                other.append(c)
        new = self.word_ids.lacking(words)
        told = self.words.encode_batch_fast([w.encode().decode("latin-1").translate(self.letters) if w[0] in _MARKS else "\u0120" + w.encode().decode("latin-1").translate(self.letters) for w in new], add_special_tokens=False) if new else []
        for w, e in zip(new, told):
            self.word_ids.now[w] = array("I", e.ids).tobytes()
        told = self.whole.encode_batch_fast([" " + c for c in other], add_special_tokens=False) if other else []
        for c, e in zip(other, told):
            self.chunk_ids.now[c] = array("I", e.ids).tobytes()
        ids = self.word_ids.now
        for c, w, marks in plain:
            self.chunk_ids.now[c] = ids[w] + ids[marks] if marks else ids[w]
        return odd

    def alone(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], at_once: int = 128) -> list[bytes]:
        out = []
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk the caches
        try:
            for i in range(0, len(texts), at_once):
                cut = [t.split(" ") for t in texts[i : i + at_once]]
                odd = self.learn(set().union(*(c[1:] for c in cut)))
                for k, c in enumerate(cut):
                    bad = c[0][-1:].isspace() and len(c) > 1 or odd and not odd.isdisjoint(c[1:])
                    out.append(self._odd(texts[i + k]) if bad else self._joined(c))
        finally:
            if collects:
                gc.enable()
        return out

    def _joined(self, chunks: list[str]) -> bytes:
        return (self.alone(chunks[0]) if chunks[0] else b"") + b"".join(map(self.chunk_ids.now.__getitem__, chunks[1:]))

    def _odd(self, text: str) -> bytes:
        """A text with other white space beside a space, which stays in one chunk with what is around it."""
        chunks = _CUT.split(text)
        ends = [i for i, c in enumerate(chunks) if i and c != c.strip()]
        alone = {i: self.alone(" " + chunks[i]) for i in ends}
        self.learn({c for i, c in enumerate(chunks) if i not in alone})
        return (self.alone(chunks[0]) if chunks[0] else b"") + b"".join(alone[i] if i in alone else self.chunk_ids.now[c] for i, c in enumerate(chunks) if i)


#: Id 0 ends each document.
END = (0).to_bytes(4, "little")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
