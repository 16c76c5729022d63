"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A leaf of the tree is a run of chunks (see ``tokens``), or of pre-tokens where a
chunk is long; its token count doesn't depend on the leaves around it. Inner
nodes hold sums of code points and tokens. An edit re-encodes the leaves it
touches, with a neighbour where it comes near a leaf's edge, puts what becomes
of them in their place and then updates the sums above. What is re-encoded
depends on the edit and on the length of a leaf, not on that of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import in_arrow, in_bytes, ship_package
from gustline.llm.tokens import _CUT, Coder

#: Code points over which a leaf is cut at pre-tokens too, and the context that decides whether a cut stays one.
LONG, NEAR = 1024, 4
#: The pre-tokens of a byte-level vocabulary (a fixed value).
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def leaves_of(text: str, run: int) -> list[str]:
    """The text in runs of chunks, each but the first beginning with a space that starts a pre-token; long ones in runs of pre-tokens."""
    chunks = _CUT.split(text)
    out = []
    for i in range(0, len(chunks), run):
        leaf = (" " if i else "") + " ".join(chunks[i : i + run])
        out += [leaf] if len(leaf) <= LONG else _by_pre_token(leaf)
    return out


def _by_pre_token(text: str) -> list[str]:
    """The text in pieces of about half of ``LONG`` code points, cut where a pre-token ends in something other than white space: encoded alone they give the same ids. A single pre-token is never cut."""
    out, start = [], 0
    for m in _PRE_TOKEN.finditer(text):
        end = m.end()
        if end - start >= LONG // 2 and end < len(text) and not text[end - 1].isspace():
            out.append(text[start:end])
            start = end
    return [*out, text[start:]]


class CountTree:
    """Token counts of one text under edits; ``reencoded`` counts the code points that edits made it encode."""

    def __init__(self, leaves: list[str], tokens: list[int], coder: Coder, run: int = 64):
        self.coder, self.run, self.reencoded = coder, run, 0
        self._build(leaves, tokens)

    @classmethod
    def all_of(cls, texts: list[str], coder: Coder, run: int = 64) -> list["CountTree"]:
        """The trees of many texts, whose leaves are encoded together."""
        leaves = [leaves_of(t, run) for t in texts]
        counts = iter([len(x) // 4 for x in coder.encode([x for each in leaves for x in each], 4096)])
        return [cls(each, [next(counts) for _ in each], coder, run) for each in leaves]

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        """All sums anew, from counts that are known."""
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with code point ``at``, and where in it; past the end: the last leaf."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), at

    def _set(self, i: int, leaf: str, tokens: int) -> None:
        self.leaves[i] = leaf
        i += self.size
        self.chars[i], self.tokens[i] = len(leaf), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace ``remove`` code points from ``at`` on by ``insert``; both are clipped to the text."""
        at = max(0, min(at, self.n_chars))
        remove = max(0, min(remove, self.n_chars - at))
        low, within = self._find(at)
        start = at - within
        while low and (within < NEAR or not self.leaves[low]):  # the cut before this leaf may move: take in the leaf before
            low -= 1
            start -= len(self.leaves[low])
            within += len(self.leaves[low])
        high, end_in = self._find(at + remove)
        while high < len(self.leaves) - 1 and end_in > len(self.leaves[high]) - NEAR:
            end_in -= len(self.leaves[high])
            high += 1
        old = "".join(self.leaves[low : high + 1])
        new = leaves_of(old[: at - start] + insert + old[at - start + remove :], self.run)
        self.reencoded += sum(map(len, new))
        counts = [len(x) // 4 for x in self.coder.encode(new)]
        room = high + 1 - low
        if len(new) <= room:
            for i in range(room):
                self._set(low + i, *((new[i], counts[i]) if i < len(new) else ("", 0)))
        else:  # more leaves than there were: the others keep their counts and move
            tokens = self.tokens[self.size : self.size + len(self.leaves)]
            self._build([*self.leaves[:low], *new, *self.leaves[high + 1 :]], [*tokens[:low], *counts, *tokens[high + 1 :]])


_OUT = "doc_id long, n_chars long, n_tokens long, n_chars_after long, n_tokens_after long, n_edits int, n_reencoded long"


def _kernel(tokenizer: str, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(tokenizer)
        for b in in_bytes(batches, 1):
            rows = []
            docs, texts, edits_of = (c.to_pylist() for c in b.columns)
            trees = (t for i in range(0, len(texts), 256) for t in CountTree.all_of(texts[i : i + 256], coder, run))
            for doc, tree, edits in zip(docs, trees, edits_of):
                row = [doc, tree.n_chars, tree.n_tokens]
                for e in edits or []:
                    tree.edit(e["at"], e["remove"], e["insert"])
                rows.append((*row, tree.n_chars, tree.n_tokens, len(edits or []), tree.reencoded))
            kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=[x.split()[0] for x in _OUT.split(", ")])

    return go


def edit(at: Column, remove: Column, insert: Column) -> Column:
    return F.struct(F.coalesce(at.cast("long"), F.lit(0).cast("long")).alias("at"), F.coalesce(remove.cast("long"), F.lit(0).cast("long")).alias("remove"), F.coalesce(insert.cast("string"), F.lit("")).alias("insert"))


def count_with_edits(docs: DataFrame, edits: Column, tokenizer: str, run: int = 64) -> DataFrame:
    """Token counts of each document before and after its edits, in one pass and without a shuffle.

    edits: an array of ``edit(...)`` structs over the columns of ``docs``,
    applied in order, each at a code point of the text as it then is. n_tokens
    counts the library's ids without an end id; n_reencoded has the code points
    that the edits made it encode again. A null text is empty; a null array
    means no edits; rows with the same doc_id are counted each on their own;
    other columns are left out; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), edits.alias("edits"))
    return rows.transform(in_arrow, _kernel(tokenizer, run), _OUT)
