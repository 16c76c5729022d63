"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping windows of words. A
randomised SVD of the TF-IDF matrix of the windows of all documents, computed
by products that run on the executors, gives a latent space; every window of
every document is projected into it, and those whose cosine with a window of an
item is high are candidates. So is, whatever its weights, a passage that shares
enough runs of three words with an item. The longest common subsequence of words
confirms both, for looser matches together with the item's answer (its last
sentence). Whether a word is common shows outside such passages, so that copies
of an item, however many, don't make its words common.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import id_and_text, in_arrow, in_bytes, materialize, settle

BLOCK = 16  # words; a window is two blocks, and one begins at each block
RUN = 3  # words
SLICE = 1 << 14  # words that are multiplied at a time
DENSE = 32  # blocks whose windows are one dense matrix, windows x distinct words
_MARKS = b".,;:!?\"'()[]{}|*#%&$<>~-_"
_OUT = "doc_id long, item_id long, cosine double, matched int, item_words int"


def normal_words(text: str) -> list[bytes]:
    """Words in lower case (A-Z) without the marks around them."""
    return [w.strip(_MARKS) or w for w in text.encode("utf-8", "surrogatepass").lower().split()]


def bare_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text, word) of all words of ``normal_words``, in order."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    of, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end makes an empty one
    if not some.all():
        of, words = of[some], words.filter(pa.array(some))
    bare = pc.ascii_trim(words, _MARKS.decode())
    return of, pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare).cast(pa.binary())


class Terms:
    """Texts -> the numbers of their words in a vocabulary (-1: not in it)."""

    def __init__(self, vocabulary: list[bytes]):
        self.words = pa.array(vocabulary, pa.binary())

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        of, words = bare_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ids = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        return np.split(ids, np.cumsum(np.bincount(of, minlength=len(texts)))[:-1]) if len(texts) else []


def number(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id long, terms binary) of every row of docs: the numbers of all words of its text, as ``by_terms`` reads them."""
    docs = id_and_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most ``terms`` words, and a block of items
    kind = _kind(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(shared.value)
        for b in in_bytes(batches, 1, 1 << 21):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.astype(kind).tobytes() for t in of(b.column(1))], pa.binary())], names=["doc_id", "terms"])

    return docs.transform(in_arrow, run, "doc_id long, terms binary")


def _kind(terms: int) -> str:
    return "<i2" if terms < 1 << 15 else "<i4"


def by_terms(batches: Iterator[pa.RecordBatch], terms: int, words: int = 4 * SLICE) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, terms) of what ``number`` made with so many terms, in groups of about ``words`` words, or of one longer text."""
    for b in in_bytes(batches, 1, words * np.dtype(_kind(terms)).itemsize):
        yield b.column(0).to_pylist(), [np.frombuffer(x.as_buffer(), _kind(terms)) for x in b.column(1)]


def slices(terms: list[np.ndarray], words: int = SLICE) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(terms, text, first block) of pieces with ``words`` words together or little more: a longer text goes in pieces that share a block, so that each of its windows is in one."""
    some, of, at, size = [], [], [], 0
    step = max(1, words // BLOCK) * BLOCK
    for k, t in enumerate(terms):
        i = 0
        while True:
            some.append(t[i : i + step + BLOCK])
            of.append(k)
            at.append(i // BLOCK)
            size += len(some[-1])
            i += step
            if size >= words:
                yield some, np.array(of), np.array(at)
                some, of, at, size = [], [], [], 0
            if len(t) <= i + BLOCK:
                break
    if some:
        yield some, np.array(of), np.array(at)


class Windows:
    """Where the terms of some texts stand: block by block, a window being a block and the next.

    A text of n words has ceil(n / BLOCK) blocks, one at least, and a window at
    each but the last, or just one. A word that is no term is -1, the last place
    of any array by term.
    """

    def __init__(self, terms: list[np.ndarray]):
        blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in terms], int)
        first = np.concatenate([[0], np.cumsum(blocks)])
        self.where = np.concatenate([np.arange(len(t)) // BLOCK + f for t, f in zip(terms, first)]) if len(terms) else np.empty(0, int)
        self.ids = np.concatenate(terms) if len(terms) else np.empty(0, np.int32)
        self.n = int(first[-1])
        self.text = np.repeat(np.arange(len(terms)), blocks)
        self.block = np.arange(self.n) - first[self.text]
        self.last = np.zeros(self.n, bool)
        self.last[first[1:] - 1] = True
        self.is_window = ~self.last | np.repeat(blocks == 1, blocks)

    def sum_of(self, values: np.ndarray) -> np.ndarray:
        """For each block, the sum of the terms' values in its window."""
        out = np.bincount(self.where, values[self.ids], self.n)
        out[:-1] += np.where(self.last[:-1], 0, out[1:])
        return out

    def sums(self, rows: np.ndarray, usable: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For each of the windows, the sum of its usable terms' rows; no others are looked up."""
        need = np.zeros(self.n + 1, bool)
        need[windows] = True
        need[windows + 1] |= ~self.last[windows]
        place = np.cumsum(need) - 1
        out = np.zeros((int(need.sum()) + 1, rows.shape[1]), np.float32)  # the last is for what comes after a last block
        at = np.flatnonzero(need[self.where] & usable[self.ids])
        if len(at):
            where = place[self.where[at]]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            out[where[starts]] = np.add.reduceat(rows[self.ids[at]], starts)
        return out[place[windows]] + out[np.where(self.last[windows], len(out) - 1, place[windows + 1])]


class GramProduct:
    """(A'A)q for the rows A of texts' windows, TF-IDF, each of length one; n: how many windows there are. The windows at ``DENSE`` blocks are multiplied at a time, as a dense matrix of windows and the words in them."""

    def __init__(self, q: np.ndarray, idf: np.ndarray):
        self.idf, self.scaled, self.n, self.words = idf, q * idf[:, None], 0, 0
        self.part, self.total = np.zeros_like(q), np.zeros(q.shape)
        self.there, self.place = np.zeros(len(q), bool), np.zeros(len(q), int)
        self.energy = np.append(idf.astype(float) ** 2, 0.0)

    def add(self, terms: list[np.ndarray]) -> None:
        w = Windows(terms)
        self.n += int(w.is_window.sum())
        share = (w.is_window / np.maximum(w.sum_of(self.energy), 1e-9)).astype(np.float32)[:, None]
        known = np.flatnonzero(w.ids >= 0)
        ids, where = w.ids[known], w.where[known]
        first = np.searchsorted(where, np.arange(w.n + 1))
        for i in range(0, w.n, DENSE):
            end = min(i + DENSE, w.n)
            own = slice(first[i], first[min(end + 1, w.n)])  # and the block after
            if own.start == own.stop:
                continue
            self.there[ids[own]] = True
            kinds = np.flatnonzero(self.there)
            self.there[kinds] = False
            self.place[kinds] = np.arange(len(kinds))
            counts = np.bincount((where[own] - i) * len(kinds) + self.place[ids[own]], minlength=(end - i + 1) * len(kinds)).reshape(-1, len(kinds)).astype(np.float32)
            a = counts[:-1] + np.where(w.last[i:end, None], 0, counts[1:])
            self.part[kinds] += a.T @ (a @ self.scaled[kinds] * share[i:end])
        self.words += len(ids)
        if self.words >= 1 << 21:  # single precision for so many words, double for their sums
            self._sum()

    def _sum(self) -> None:
        self.total += self.part
        self.part[:], self.words = 0, 0

    def result(self) -> np.ndarray:
        self._sum()
        return (self.total * self.idf[:, None]).astype(np.float32)


def gram_product(terms: list[np.ndarray], q: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """(A'A)q of some texts, and how many windows they have."""
    out = GramProduct(q, idf)
    out.add(terms)
    return out.result(), out.n


# --- shared runs of words ---------------------------------------------------


class Runs:
    """Runs of ``RUN`` words of the items (of an item's whole text where it is shorter), to be found in texts."""

    def __init__(self, items: list[np.ndarray], terms: int):
        """items, and the texts searched later, are numbers below ``terms``; -1 is in no item."""
        self.base, self.lengths, self.words = terms + 1, np.array([len(t) for t in items], int), [np.unique(t) for t in items]
        self.known = np.zeros(terms + 1, bool)  # the last place is for words that are no term
        self.tables = []
        for size in range(1, RUN + 1):
            have = [k for k, t in enumerate(items) if len(t) and min(RUN, len(t)) == size]
            if not have:
                continue
            for k in have:
                self.known[items[k]] = True
            pairs = np.unique(np.concatenate([np.column_stack([self._codes(items[k], size), np.full(len(items[k]) - size + 1, k)]) for k in have]), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.tables.append((size, keys, np.append(first, len(pairs)), pairs[:, 1]))
        # a quarter of the words replaced, evenly, leaves a quarter of the runs
        self.least = np.maximum(1, np.ceil(0.15 * (self.lengths - RUN + 1))).astype(int)

    def _codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """One number for each run of ``size`` words: exact, terms ** 3 is below 2 ** 63."""
        ids = ids.astype(np.int64) + 1
        n = len(ids) - size + 1
        out = np.zeros(max(0, n), np.int64)
        for j in range(size):
            out = out * self.base + ids[j : j + n]
        return out

    def find(self, terms: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, first, end) of the passages, at most twice an item's length from first to last run, that share enough runs with it."""
        ids = np.concatenate(terms) if terms else np.empty(0, np.int32)
        ends = np.cumsum([len(t) for t in terms])
        at, items = [], []
        known = self.known[ids]
        for size, keys, first, of in self.tables:
            if len(ids) < size:
                continue
            there = known[: len(ids) - size + 1].copy()
            for j in range(1, size):
                there &= known[j : len(ids) - size + 1 + j]
            there = np.flatnonzero(there)
            there = there[np.searchsorted(ends, there, "right") == np.searchsorted(ends, there + size - 1, "right")]
            codes = np.zeros(len(there), np.int64)
            for j in range(size):
                codes = codes * self.base + ids[there + j] + 1
            k = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            hit = keys[k] == codes
            there, k = there[hit], k[hit]
            n = first[k + 1] - first[k]
            at.append(np.repeat(there, n))
            items.append(of[np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        if not at:
            return []
        at, items = np.concatenate(at), np.concatenate(items)
        text = np.searchsorted(ends, at, "right")
        order = np.lexsort((at, items, text))
        at, items, text = at[order], items[order], text[order]
        out: list[tuple[int, int, int, int]] = []
        last = np.arange(len(at)) + self.least[items] - 1  # the run that makes it enough, if it is near
        fits = last < len(at)
        i = np.flatnonzero(fits)
        j = last[i]
        good = (text[i] == text[j]) & (items[i] == items[j]) & (at[j] - at[i] <= 2 * self.lengths[items[i]])
        starts = ends - [len(t) for t in terms]
        for t, k, a, b in zip(*(x[good].tolist() for x in (text[i], items[i], at[i], at[j]))):
            a, b = a - int(starts[t]), b - int(starts[t]) + min(RUN, int(self.lengths[k]))
            if out and out[-1][:2] == (t, k) and a <= out[-1][3]:
                out[-1] = (t, k, out[-1][2], max(b, out[-1][3]))
            else:
                out.append((t, k, a, b))
        return out


# --- the latent space -------------------------------------------------------


def frequent_words(docs: DataFrame, most: int, at_once: int = 1_000_000) -> list[bytes]:
    """The ``most`` words that are in the most documents, in two at least; all words of all documents are counted. A task holds about ``at_once`` words, or one text, and lets Spark sum the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_bytes(batches, 1, 8 * at_once):
            of, words = bare_words(b.column(1))
            words = words.dictionary_encode()
            kinds = max(1, len(words.dictionary))
            pairs = np.sort(of.astype(np.int64) * kinds + words.indices.to_numpy())  # a word counts once a text
            n = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % kinds, minlength=len(words.dictionary))
            for i in range(0, len(n), 20_000):
                yield pa.RecordBatch.from_arrays([words.dictionary.slice(i, 20_000), pa.array(n[i : i + 20_000], pa.int64())], names=["w", "n"])

    rows = id_and_text(docs).transform(in_arrow, run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()
    return [bytes(r["w"]) for r in rows]


def vocabulary(frequent: list[bytes], items: list[str], terms: int) -> list[bytes]:
    """All words of the items, and the most frequent ones up to ``terms`` in total."""
    own = sorted({w for t in items for w in normal_words(t)})
    have = set(own)
    return own + [w for w in frequent if w not in have][: max(0, terms - len(own))]


def document_frequencies(docs: DataFrame, words: list[bytes], items: list[str], numbered: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """How many of all documents have each term; how many apart from an item's words in and beside passages that share runs with it; how many documents there are. numbered: what ``number`` made of docs, if there is such a table."""
    spark, size = docs.sparkSession, len(words)
    shared = spark.sparkContext.broadcast(Runs(Terms(words)(items), size))
    numbered = number(docs, words) if numbered is None else numbered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, n, df = shared.value, 0, np.zeros((2, size + 1), np.int64)
        for _, terms in by_terms(batches, size):
            for ids in terms:
                df[0, np.unique(ids)] += 1  # -1 counts in the last place
            copies = runs.find(terms)
            for t in {x[0] for x in copies}:
                df[1, np.unique(terms[t])] -= 1
            for t, k, a, b in copies:
                if not terms[t].flags.writeable:
                    terms[t] = terms[t].copy()
                near = terms[t][max(0, a - runs.lengths[k]) : b + runs.lengths[k]]
                near[np.isin(near, runs.words[k])] = -1  # with the item's words beside the runs, in edited copies
            for t in {x[0] for x in copies}:
                df[1, np.unique(terms[t])] += 1
            n += len(terms)
        df[1] += df[0]
        df[:, -1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(df.shape[1]), pa.int32()), pa.array(df[0], pa.int64()), pa.array(df[1], pa.int64())], names=["i", "n", "apart"])

    rows = numbered.transform(in_arrow, run, "i int, n long, apart long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart")).toArrow()
    df = np.zeros((2, len(words) + 1), np.int64)
    df[:, rows.column("i").to_numpy()] = rows.column("n").to_numpy(), rows.column("apart").to_numpy()
    return df[0, :-1], df[1, :-1], int(df[0, -1])


class Space:
    """The latent space: terms, their inverse frequencies, a terms x rank basis, and which terms the search projects."""

    def __init__(self, words: list[bytes], idf: np.ndarray, basis: np.ndarray, usable: np.ndarray):
        self.words, self.basis, self.usable = words, basis, usable
        self.energy = np.append(idf * idf, UNKNOWN**2)  # a word that is no term is a rare one

    def project(self, terms: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, text, block) of the windows whose part in the space is at least ``least`` of their length.

        A vector is the projection over the length of the whole window, so its
        product with a unit vector of the space is their cosine; windows left out
        can't reach ``least`` with any.
        """
        w = Windows(terms)
        length = np.sqrt(np.maximum(w.sum_of(self.energy), 1e-12))
        there = np.flatnonzero(w.is_window & (w.sum_of(self.energy * self.usable) >= (least * length) ** 2))  # the space can't hold more than its terms do
        vectors = w.sums(self.basis, self.usable, there) / length[there, None]
        near = np.einsum("ij,ij->i", vectors, vectors) >= least * least
        return vectors[near], w.text[there[near]], w.block[there[near]]


#: Inverse frequency of a word that is no term, and of one in too many documents.
UNKNOWN, COMMON = 6.0, 0.02


def latent_space(docs: DataFrame, items: list[str], words: list[bytes], idf: np.ndarray, rank: int = 256, rounds: int = 3, weight: float = 100.0, seed: int = 11, warm: int = 0, numbered: DataFrame | None = None) -> Space:
    """Randomised SVD of the TF-IDF windows of all documents and the items: a range finder with power iterations.

    Each round's product (A'A)Q is summed on the executors; a task leaves one
    terms x rank matrix in the shared folder, and there are no more tasks than
    run at once. The items' windows weigh ``weight`` times the documents', so
    that the space keeps what tells items apart before what tells languages
    apart. warm: rounds over the items' windows alone before those over all, on
    the driver; numbered: what ``number`` made of docs, if there is such a table.
    """
    spark, size = docs.sparkSession, len(words)
    numbered = (number(docs, words) if numbered is None else numbered).coalesce(spark.sparkContext.defaultParallelism)
    own = Terms(words)(items)
    rank = max(1, min(rank, size, int(Windows(own).is_window.sum())))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, rank)))[0].astype(np.float32)
    for _ in range(warm):
        z = gram_product(own, q, idf)[0].astype(np.float64)
        del q
        q = np.linalg.qr(z)[0].astype(np.float32)
        del z
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((q, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = GramProduct(*sent.value)
            for _, terms in by_terms(batches, size):
                total.add(terms)
            yield pa.RecordBatch.from_arrays([pa.array([total.result().tobytes()], pa.binary()), pa.array([total.n], pa.int64())], names=["z", "n"])

        z, n = np.zeros_like(q), 0
        for r in materialize(numbered.transform(in_arrow, run, "z binary, n long"), "products").toLocalIterator():
            z += np.frombuffer(r["z"], np.float32).reshape(z.shape)
            n += r["n"]
            del r
        mine, windows = gram_product(own, q, idf)
        del q
        sent.destroy()
        z *= np.float32(windows / max(n, 1))
        mine *= np.float32(weight)
        z += mine
        del mine
        z = z.astype(np.float64)
        q = np.linalg.qr(z)[0].astype(np.float32)
        del z
        settle(spark)  # the driver's share of the products, the round's broadcast
    usable = np.zeros(len(words) + 1, bool)  # other terms lie outside the items' windows
    for t in own:
        telling = t[idf[t] > COMMON]
        usable[telling if len(telling) else t] = True
    return Space(words, idf, np.ascontiguousarray(q * idf[:, None], np.float32), usable)


# --- confirmation -----------------------------------------------------------


def lcs(item: list, text: list) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if m := where.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Items:
    """Benchmark items with their words, answers and latent windows."""

    def __init__(self, rows: list[tuple[int, str]], space: Space):
        self.ids = [i for i, _ in rows]
        of = Terms(space.words)
        terms = of([t for _, t in rows])
        self.words = [t.tolist() for t in terms]
        self.runs = Runs(terms, len(space.words))
        self.answers = []
        for _, t in rows:
            parts = [p for p in re.split(r"[.!?\n]+", t) if len(p.split()) >= 2]
            self.answers.append(of([parts[-1] if parts else t])[0].tolist())
        sums, self.of, _ = space.project(terms, 0.0)
        self.vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)

    def confirmed(self, k: int, region: list[int], sure: float, likely: float) -> int:
        """The common subsequence's length if the region holds item k, else 0."""
        item = self.words[k]
        n = lcs(item, region)
        if n >= sure * len(item):
            return n
        answer = self.answers[k]
        return n if n >= likely * len(item) and lcs(answer, region) >= 0.5 * len(answer) else 0


def _by_cosine(space: Space, items: Items, terms: list[np.ndarray], cosine: float) -> Iterator[tuple[int, int, int, int, float | None]]:
    """(text, item, low, high, cosine): passages around windows near one of an item's, each with room for the item on either side."""
    for some, of, at in slices(terms):
        sums, text, block = space.project(some, cosine)
        step = max(1, 4_000_000 // max(1, len(items.vectors)))
        for a in range(0, len(sums), step):
            c = sums[a : a + step] @ items.vectors.T
            hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
            for w, v in np.argwhere(c >= cosine).tolist():
                t = int(text[a + w])
                hits.setdefault((int(of[t]), int(items.of[v])), []).append((int(block[a + w] + at[t]), float(c[w, v])))
            for (t, k), near in hits.items():
                reach, done = len(items.words[k]), -1
                for b, cos in sorted(near):
                    low, high = max(0, b * BLOCK - reach), (b + 2) * BLOCK + reach
                    if high > done:
                        done = high
                        yield t, k, low, high, cos


def _by_runs(items: Items, terms: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float | None]]:
    """The same for passages that share runs of words with an item; no cosine."""
    for t, k, a, b in items.runs.find(terms):
        reach = len(items.words[k])
        yield t, k, max(0, a - reach), b + reach, None


def _search_kernel(shared, cosine: float, sure: float, likely: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = shared.value
        for docs, terms in by_terms(batches, len(space.words)):
            found: dict[tuple[int, int], tuple[int, float | None]] = {}
            for t, k, low, high, cos in (*_by_cosine(space, items, terms, cosine), *_by_runs(items, terms)):
                n = items.confirmed(k, terms[t][low:high].tolist(), sure, likely)
                best = found.get((t, k), (0, None))
                if (n, cos or 0.0) > (best[0], best[1] or 0.0) and n:
                    found[t, k] = (n, best[1] if cos is None else cos)
            rows = [(docs[t], items.ids[k], cos, n, len(items.words[k])) for (t, k), (n, cos) in sorted(found.items(), key=lambda x: x[0])]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, sure: float = 0.75, likely: float = 0.6, rank: int = 256, terms: int = 8_000, max_share: float = 0.1, at_once: int = 16_000) -> DataFrame:
    """(doc_id, item_id, cosine, matched, item_words) of every document that holds a benchmark item.

    matched words of the item stand in the document in order: at least the share
    ``sure``, or ``likely`` with half of the answer. cosine is null where only
    shared runs of words led to the passage. The vocabulary is
    counted, the space is fitted and the search is done over every window of
    every document, the space with all items. Terms in over
    ``max_share`` of the documents carry no weight unless an item has no other.
    The space is that of the items' windows after eight rounds, turned by one
    round over all windows: nearer to the limit than three rounds from a random
    start. Items go in blocks of ``at_once`` distinct words, which bounds what is
    broadcast: one pass over the texts for all blocks, and one each that writes
    the words' numbers, which three more passes read. Null and
    empty texts match nothing; a document with several doc_id rows is searched
    row by row; other columns are left out; empty tables give no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator()
    out, block, kinds = None, [], set()

    def search(block: list[tuple[int, str]], out: DataFrame | None) -> DataFrame:
        nonlocal frequent
        if frequent is None:
            frequent = frequent_words(docs, terms)
        texts = [t for _, t in block]
        words = vocabulary(frequent, texts, terms)
        numbered = materialize(number(docs, words), "terms")
        df, apart, n = document_frequencies(docs, words, texts, numbered)
        df = np.where(df <= max(1, max_share * n), df, apart)
        idf = np.where(df <= max(1, max_share * n), np.log((n + 1) / (df + 1)), COMMON).astype(np.float32)
        space = latent_space(docs, texts, words, idf, rank, rounds=1, warm=8, numbered=numbered)
        shared = spark.sparkContext.broadcast((space, Items(block, space)))
        found = numbered.transform(in_arrow, _search_kernel(shared, cosine, sure, likely), _OUT)
        return found if out is None else out.union(found)

    frequent: list[bytes] | None = None
    for r in rows:
        if words := normal_words(r["t"]):
            block.append((r["i"], r["t"]))
            kinds.update(words)
        if len(kinds) >= at_once:
            out, block, kinds = search(block, out), [], set()
    if block:
        out = search(block, out)
    return out if out is not None else spark.createDataFrame([], _OUT)
