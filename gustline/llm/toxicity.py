"""Toxicity by noisy-channel deobfuscation.

1. A character language model: 4-gram counts of the words of all documents,
   folded to 26 letters, interpolated with its lower orders. It is a table of
   27 ** 4 numbers whatever the corpus.
2. A token that isn't plain letters or holds a letter three times in a row, and
   a run of single characters, becomes a lattice: each character as itself, as
   the letters it may stand for, or as nothing (marks, repeats), a space as
   nothing or as the end of a word. Viterbi finds the likeliest letters under
   channel and language model, whatever the length. Neighbouring words are joined
   where the model finds the space less likely than none.
3. Words of the restored text are scored by how much more often labelled toxic
   documents have them, at the lower end of the confidence interval.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import by_text, held_out, id_and_text, in_arrow, labelled, materialize

ORDER, SIZE = 4, 27
#: What a character may stand for, with the channel's cost of each reading (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i", "¥": "y", "#": "h", "%": "x", "&": "a",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "α": "a", "ο": "o", "ι": "i", "ν": "v", "τ": "t",
}
LEET_COST, DROP_MARK, DROP_LEET, DROP_REPEAT, ANY_COST = 0.7, 0.3, 4.0, 0.5, 2.5
#: Of a space in a run of single characters (dropped, kept), and of one put into a word.
DROP_SPACE, KEEP_SPACE, SPLIT_COST = 0.2, 1.5, 3.0
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ENDS = ".,!?;:\"'()[]{}|*#%&$~-_<>"
_PLAIN = re.compile(r"[a-z]+")
_RUN = re.compile(r"(.)\1\1")
_LETTER_RUN = re.compile(r"([a-z])\1\1")
_STOPS = frozenset(".,!?;:")
#: Tokens of plain letters, marks around them left out.
_PLAIN_TOKENS = re.compile(r"(?<!\S)[" + re.escape(".,!?;:\"'()[]{}|*#%&$~-_<>") + r"]*+([a-z]+)[" + re.escape(".,!?;:\"'()[]{}|*#%&$~-_<>") + r"]*+(?!\S)")
#: Three or more single characters with spaces or marks between them; no part can match in two ways.
_SPACED = re.compile(r"(?<![^\s(\[\"'])[^\s.\-_](?:[ \t\xa0.\-_]++[^\s.\-_](?![^\s.\-_,!?;:\"')\]])){2,}+")
_GAP = re.compile(r"[ \t\xa0.\-_]+")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_SUSPECT = re.compile(r"[^\W\d_]")
#: Marks that combine with the letter before (fixed values: Unicode's blocks of them).
_COMBINING = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    out = word.lower()
    for c, letters in _FOLDS.items():
        out = out.replace(c, letters)
    out = unicodedata.normalize("NFKD", out)
    return out if out.isascii() else _COMBINING.sub("", out)


# --- language model ---------------------------------------------------------


_LETTER_CODES = np.zeros(256, np.int64)
_LETTER_CODES[97:123] = np.arange(1, 27)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of the 4-grams of the texts' folded words of plain letters, three boundaries before and one after each."""
    out = np.zeros(SIZE**ORDER)
    words = [w for t in texts for w in _PLAIN_TOKENS.findall(fold(t))]
    if words:
        codes = _LETTER_CODES[np.frombuffer(("   " + "    ".join(words) + " ").encode(), np.uint8)]
        gram = ((codes[:-3] * SIZE + codes[1:-2]) * SIZE + codes[2:-1]) * SIZE + codes[3:]
        gram = gram[(codes[3:] > 0) | (codes[2:-1] > 0)]  # letters, and the boundary just after one
        out += np.bincount(gram, minlength=SIZE**ORDER)
    return out


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, some, size = np.zeros(SIZE**ORDER), [], 0
    for _, texts in by_text(batches):
        for t in texts:
            some.append(t)
            size += len(t)
            if size > 2_000_000:
                total += gram_counts(some)
                some, size = [], 0
    total += gram_counts(some)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64), pa.int64())], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | three before) over all documents, as a flat table of SIZE ** ORDER.

    Interpolated (Witten-Bell) from order 4 down to the uniform distribution.
    What reaches the driver is at most SIZE ** ORDER sums, however many documents.
    """
    rows = id_and_text(docs).transform(in_arrow, _count_kernel, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**ORDER)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    levels = [counts.reshape((SIZE,) * ORDER)]
    for _ in range(ORDER - 1):
        levels.append(levels[-1].sum(0))
    p = np.full(SIZE, 1 / SIZE)
    for c in reversed(levels):
        total = c.sum(-1, keepdims=True)
        kinds = (c > 0).sum(-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, c.shape))
    return np.log(np.maximum(p, 1e-9)).astype(np.float32).ravel()


# --- decoding ---------------------------------------------------------------


class Decoder:
    """Restores tokens under a language model; remembers those it has seen."""

    def __init__(self, model: np.ndarray, beam: int = 48, keep: int = 200_000):
        self.p, self.beam, self.keep, self.seen = model.tolist(), beam, keep, {}
        self.table = np.asarray(model, np.float64).reshape(SIZE, SIZE * SIZE, SIZE)
        end = -np.asarray(model, np.float64).reshape(SIZE**3, SIZE)[:, 0]
        #: The last three letters (all of a shorter word) after which few words end.
        self.open = {w for state in np.flatnonzero(end > SPLIT_COST).tolist() if (w := self._ending(state))}

    def readings(self, token: str, i: int) -> list[tuple[str, float]]:
        c = token[i]
        out = []
        if c == " ":
            return [("", DROP_SPACE), (" ", KEEP_SPACE)]
        if "a" <= c <= "z":
            out.append((c, 0.0))
            if i and (token[i - 1] == c or token[i - 2 : i] == c + " "):
                out.append(("", DROP_REPEAT))
        else:
            out += [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in "*#":
                out += [(x, ANY_COST) for x in _LETTERS]
            edge = i == 0 or i == len(token) - 1
            out.append(("", DROP_LEET if c in LEET and not edge else DROP_MARK + (1.5 if c in LEET else 0.0)))
        return out

    def viterbi(self, token: str) -> str:
        """The likeliest letters behind a folded token: paths are told apart by their last three letters, none is pruned."""
        paths = {0: (0.0, "")}  # the three letters before, as a number of base SIZE
        modulus = SIZE**3
        for i in range(len(token)):
            new: dict[int, tuple[float, str]] = {}
            choices = self.readings(token, i)
            for state, (cost, text) in paths.items():
                for letter, extra in choices:
                    if letter == " ":
                        if not state:
                            continue
                        to, value, said = 0, cost + extra - self.p[state * SIZE], text + " "
                    elif letter:
                        gram = state * SIZE + ord(letter) - 96
                        to, value, said = gram % modulus, cost + extra - self.p[gram], text + letter
                    else:
                        to, value, said = state, cost + extra, text
                    if to not in new or value < new[to][0]:
                        new[to] = (value, said)
            if len(new) > self.beam:
                return self.viterbi_by_table(token)
            paths = new
        return min((cost - self.p[state * SIZE], text) for state, (cost, text) in paths.items())[1]

    def _step(self, cost: np.ndarray, choices: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray, int]:
        """Costs of all states one character on; the letter that each leaves behind (SIZE: dropped, SIZE + 1: a word ended); the state of that word."""
        new, via, ended = np.full((SIZE * SIZE, SIZE), np.inf), np.zeros((SIZE * SIZE, SIZE), np.uint8), 0
        square, flat_new, flat_via = cost.reshape(SIZE, -1), new.ravel(), via.ravel()
        for letter, extra in choices:
            if letter == " ":
                word = cost + extra - self.table[:, :, 0].ravel()
                word[0] = np.inf
                ended = int(word.argmin())
                if word[ended] < flat_new[0]:
                    flat_new[0], flat_via[0] = word[ended], SIZE + 1
            elif letter:
                k = ord(letter) - 96
                value = square + extra - self.table[:, :, k]
                best, value = value.argmin(0), value.min(0)
                less = value < new[:, k]
                new[less, k], via[less, k] = value[less], best[less]
            else:
                less = cost + extra < flat_new
                flat_new[less], flat_via[less] = (cost + extra)[less], SIZE
        return flat_new, flat_via, ended

    def viterbi_by_table(self, token: str, piece: int = 128) -> str:
        """viterbi() over all SIZE ** 3 states at once; the way back is kept for ``piece`` characters at a time."""
        cost = np.full(SIZE**3, np.inf)
        cost[0] = 0.0
        starts = []
        for i in range(len(token)):
            if i % piece == 0:
                starts.append(cost)
            cost = self._step(cost, self.readings(token, i))[0]
        state, out = int((cost - self.table[:, :, 0].ravel()).argmin()), []
        for n in range(len(starts) - 1, -1, -1):
            ways, cost = [], starts[n]
            for i in range(n * piece, min(len(token), (n + 1) * piece)):
                cost, via, ended = self._step(cost, self.readings(token, i))
                ways.append((via, ended))
            for via, ended in reversed(ways):
                k = int(via[state])
                if k == SIZE + 1:
                    out.append(" ")
                    state = ended
                elif k < SIZE:
                    out.append(chr(96 + state % SIZE))
                    state = k * SIZE * SIZE + state // SIZE
        return "".join(reversed(out))

    @staticmethod
    def _ending(state: int) -> str:
        """The letters of a state, "" if a boundary stands after a letter in it."""
        codes = [state // SIZE**2, state // SIZE % SIZE, state % SIZE]
        letters = "".join(chr(96 + c) for c in codes if c)
        return letters if all(codes[3 - len(letters) :]) else ""

    def _state(self, word: str) -> int:
        state = 0
        for c in word[-3:]:
            state = state * SIZE + ord(c) - 96
        return state

    def _begin(self, state: int, word: str) -> float:
        """What the first letters of a word cost after a state; later ones don't know of it."""
        cost = 0.0
        for k in [ord(c) - 96 for c in word[:3]] + [0] * (len(word) < 3):
            gram = state * SIZE + k
            cost -= self.p[gram]
            state = gram % SIZE**3
        return cost

    def is_open(self, token: str) -> bool:
        """Whether a plain word ends as few words do."""
        return token[-3:] in self.open and token.isascii() and token.isalpha()

    def joined(self, tokens: list[str]) -> list[str]:
        """Words that a space was put into: where it is less likely than none."""
        out, ends = [], self.open
        for i in [i for i, t in enumerate(tokens) if t[-3:] in ends]:
            if not self.is_open(tokens[i]):
                continue
            word = tokens[i]
            for after in tokens[i + 1 : i + 8]:
                after = after.rstrip(_ENDS)
                state = self._state(word)
                if not _PLAIN.fullmatch(after) or SPLIT_COST + self._begin(state, after) >= self._begin(0, after) - self.p[state * SIZE]:
                    break
                word += after
                out.append(word)
        return out

    def spelt(self, run: str) -> list[str]:
        """The words behind a run of single characters."""
        got = self.seen.get(run)
        if got is None:
            chars = [fold(c) for c in _GAP.split(run)]
            chars = [c for k, c in enumerate(chars) if chars[k - 3 : k] != [c] * 3]
            got = " ".join(chars)
            ok = _SUSPECT.search(got) and all(c in LEET or "a" <= c <= "z" or c in _ENDS or not c.isalnum() for c in got)
            got = self.viterbi(got) if ok else "".join(chars)
            if len(self.seen) > self.keep:
                self.seen.clear()
            self.seen[run] = got
        return got.split()

    def restore(self, token: str) -> str:
        """A token as it is meant; plain words, and what holds no letters, stay as they are."""
        got = self.seen.get(token)
        if got is None:
            word = fold(token)
            core = word.rstrip(_ENDS) if len(word) - len(word.rstrip(_ENDS)) > 1 or word[-1:] in ".,!?;:" else word
            core = core.lstrip(_ENDS) if len(core) - len(core.lstrip(_ENDS)) > 1 or core[:1] in "\"'([{" else core
            core = _LONG_RUN.sub(r"\1\1\1", core)
            got = core
            if core and _SUSPECT.search(core) and (not _PLAIN.fullmatch(core) or _RUN.search(core)):
                if all(c in LEET or "a" <= c <= "z" or c in _ENDS or not c.isalnum() for c in core):
                    got = self.viterbi(core) or core
            if len(self.seen) > self.keep:
                self.seen.clear()
            self.seen[token] = got
        return got

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        text = text.lower()
        listed = text.split()
        tokens, seen = set(listed), self.seen
        runs = _LETTER_RUN.search(text) is not None
        out, foreign, other = set(), [], []
        for t in tokens:  # plain letters with at most a stop after them stand for themselves
            core = t[:-1] if t[-1] in _STOPS else t
            if core.isalpha() and not runs:
                if core.isascii():
                    out.add(core)
                else:
                    foreign.append(core)
            else:
                other.append(t)
        if foreign:
            for core, word in zip(foreign, fold("\n".join(foreign)).split("\n"), strict=True):
                if word.isascii() and word.isalpha() and not _RUN.search(word):
                    out.add(word)
                else:
                    other.append(core)
        out.update([seen.get(t) or self.restore(t) for t in other])
        out.update(self.joined(listed))
        for m in _SPACED.finditer(text):
            out.update(self.spelt(m.group()))
        out.discard("")
        return out

    def restored(self, text: str) -> str:
        """The text with its tokens restored, runs of single characters decoded."""
        text = _SPACED.sub(lambda m: " ".join(self.spelt(m.group())), text.lower())
        return " ".join(self.restore(t) for t in text.split())


# --- scoring ----------------------------------------------------------------


_STEMS = (4, 5, 6)


def stems(word: str) -> list[str]:
    """The word and its beginnings: compounds of an insult share no more than that."""
    return [word, *("^" + word[:k] for k in _STEMS if k < len(word))]


class Lexicon:
    """Words and stems with the log odds that they add."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.begins = {w.lstrip("^")[:4] for w in weights}  # of every word that has a weight

    def weight(self, word: str) -> float:
        return max(self.weights.get(x, 0.0) for x in stems(word))

    def evidence(self, words: set[str]) -> list[float]:
        """What a document's words say: the four largest weights, the sum of the next ones as a logarithm, and how many words there are, 50 at least."""
        begins = self.begins
        top = sorted((x for w in words if w[:4] in begins and (x := self.weight(w))), reverse=True)
        return [*(top + [0.0] * 4)[:4], math.log1p(sum(top[4:])), math.log(max(len(words), 50))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


_decoders: dict[str, Decoder] = {}


def _decoder(shared) -> Decoder:
    """The worker's decoder for this model, told apart from others by a hash of its numbers."""
    key, model = shared.value
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(model)
    return _decoders[key]


def _shared_model(sc, model: np.ndarray):
    return sc.broadcast((xxhash.xxh3_128_hexdigest(model.tobytes()), model))


def _df_kernel(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, counts = _decoder(shared), {}
        for b in batches:
            for half, text, y in zip(*(c.to_pylist() for c in b.columns)):
                counts.setdefault((half, y), Counter()).update({x for w in decoder.words(text) for x in stems(w)})
        for (fold_, y), c in counts.items():
            words = list(c)
            n = [c[w] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([fold_] * len(words), pa.int32()), pa.array(n if y else [0] * len(n), pa.int64()), pa.array([0] * len(n) if y else n, pa.int64())], names=["word", "fold", "toxic", "clean"])

    return run


def _evidence_kernel(shared, lexicons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, by = _decoder(shared), lexicons.value
        for b in batches:
            x = [by[1 - half].evidence(decoder.words(text)) for half, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["half", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, shared, most: int = 20_000) -> tuple[Lexicon, np.ndarray]:
    """A lexicon and the logistic regression on its evidence, from at most ``most`` labelled documents that aren't held out.

    A word's weight is the log ratio of its document frequencies less 1.64
    standard errors; those over 0.5 are kept, all of them: words of the ``most``
    documents only, two toxic ones at least. The regression
    learns from evidence under the lexicon of the other half of the documents,
    so that it doesn't trust words that only the training rows have. Without
    labels of both kinds every document scores the same.
    """
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int").alias("half")
    rows = materialize(labelled(docs, labels, "toxic", most).select(half, "text", "label"), "labelled")
    total = {(r["half"], r["label"]): r["count"] for r in rows.groupBy("half", "label").count().collect()}
    df = materialize(rows.transform(in_arrow, _df_kernel(shared), "word string, fold int, toxic long, clean long").groupBy("word").agg(*(F.sum(F.when(F.col("fold").isin(*f), F.col(c))).alias(f"{c}{i}") for i, f in enumerate(((0,), (1,), (0, 1))) for c in ("toxic", "clean"))), "frequencies")
    lexicons = []
    for i, folds in enumerate(((0,), (1,), (0, 1))):
        pos, neg = (sum(total.get((f, y), 0) for f in folds) for y in (1, 0))
        a, b = F.coalesce(f"toxic{i}", F.lit(0)) + 0.5, F.coalesce(f"clean{i}", F.lit(0)) + 0.5
        weight = F.log(a / b) - math.log((pos + 0.5) / (neg + 0.5)) - 1.64 * F.sqrt(1 / a + 1 / b)
        top = df.where(F.col(f"toxic{i}") >= 2).withColumn("w", weight).where("w > 0.5").select("word", "w").collect()
        lexicons.append(Lexicon({r["word"]: r["w"] for r in top}))
    halves = docs.sparkSession.sparkContext.broadcast(lexicons[:2])
    seen = rows.transform(in_arrow, _evidence_kernel(shared, halves), "half int, label int, x array<double>").toPandas()
    x, y = np.array(seen["x"].tolist(), float).reshape(len(seen), 6), seen["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # whatever order the rows came in
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        return lexicons[2], np.zeros(7)
    return lexicons[2], fit_logistic(x, y)


def _chances(evidence: list[list[float]], w: np.ndarray) -> np.ndarray:
    x = np.array(evidence, float).reshape(-1, len(w) - 1)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score as texts without any telling word; rows with the
    same doc_id are scored each on their own; other columns are left out; an
    empty table gives no rows. Broadcast: the language model (2 MB), and the
    lexicon, whose words are in two or more of the ``most`` labelled documents.
    """
    sc = docs.sparkSession.sparkContext
    shared = _shared_model(sc, language_model(docs))
    lexicon = sc.broadcast(train(docs, labels, shared, most))  # telling words of at most ``most`` documents, and 7 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, (words, w) = _decoder(shared), lexicon.value
        for ids, texts in by_text(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_chances([words.evidence(decoder.words(t)) for t in texts], w), pa.float64())], names=["doc_id", "score"])

    out = id_and_text(docs).transform(in_arrow, run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
