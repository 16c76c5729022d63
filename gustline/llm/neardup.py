"""Near-duplicates by HyperMinHash.

Shingle hashes fall into buckets; a bucket keeps the leading-zero count and ten
mantissa bits of its smallest hash, 16 bits in all, and an empty bucket takes
over the register of another, found by a fixed chain of probes. Bands of
registers give the candidates, a collision-corrected Jaccard estimate drops
hopeless ones, and the full shingle sets confirm the rest.

Equal sets are one class from the start, with its smallest doc_id standing for
it. Of a band's bucket only the pairs of each class with one pivot are checked
at first; what these links join counts as one component, and the later rounds
look only at buckets that still hold several components. Rows of a frequent key
are dealt over salts in every join (``_meet``). So a group of any size costs
rows in proportion to its size, and no task gets more of it than of others.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import by_text, id_and_text, in_arrow, materialize, settle

_SIG = "doc_id long, n_shingles long, fp string, sig binary"
_SET = "id long, n long, sig binary, shingles binary"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; remembers the hashes of recent words."""

    def __init__(self, size: int, keep: int = 100_000):
        self.size, self.keep, self.seen = size, keep, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                out = _mix(out * _ODD[0] + h[i : i + n] * _ODD[1 + i % 7])
        return np.unique(out)


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """m registers of 16 bits (a set that isn't empty): 6 bits of leading zeros, 10 of mantissa."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(m)
    rest = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1 << 9)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.intp), rest)
    full = np.zeros(m, bool)
    full[bucket.astype(np.intp)] = True
    zeros = 63 - np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 53)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(54)
    reg = (zeros.astype(np.uint64) << np.uint64(10) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    step = np.uint64(0)
    at = np.arange(m, dtype=np.uint64)
    while len(empty):
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            probe = (_mix(at[empty] * _ODD[3] + step * _ODD[4]) % np.uint64(m)).astype(np.intp)
        found = full[probe]
        reg[empty[found]] = reg[probe[found]] ^ np.uint16(0x2A5)  # marks it as taken over
        empty = empty[~found]
    return reg


@functools.lru_cache(4096)
def _chance(la: int, lb: int) -> float:
    """How likely two buckets of unrelated sets, 2 ** (l / 4) shingles a bucket, hold equal registers.

    The smallest of k uniform hashes lies beyond x with a chance of exp(-k x);
    summed over all registers, each the hashes with one leading-zero count and mantissa.
    """
    width = np.repeat(2.0 ** -np.arange(1, 54), 1024) / 1024
    low = np.repeat(2.0 ** -np.arange(1, 54), 1024) + np.tile(np.arange(1024), 53) * width
    one, two = (np.exp(-k * low) * -np.expm1(-k * width) / -np.expm1(-k) for k in (2.0 ** (la / 4), 2.0 ** (lb / 4)))
    return float(one @ two)


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard by the share of equal registers, less the share that sets of these sizes would have equal by chance."""
    chance = _chance(*(round(4 * math.log2(max(n, 1) / len(a))) for n in sorted((na, nb))))
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def _sign_kernel(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for docs, texts in by_text(batches):
            n, fp, sig = [], [], []
            for t in texts:
                s = shingle(t)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sig.append(registers(s, m).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.string()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])

    return run


def _set_kernel(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for docs, texts in by_text(batches):
            sets = [shingle(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s, m).astype("<u2").tobytes() if len(s) else b"" for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "sig", "shingles"])

    return run


def _check_kernel(percent: int, m: int):
    """Rows (a, b, na, nb, ga, gb, sa, sb) -> (a, b) of those linked."""
    least = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(0, batch.num_rows, 256):
                cols = [c.slice(i, 256).to_pylist() for c in batch.columns]
                for ia, ib, na, nb, ga, gb, sa, sb in zip(*cols):
                    if 100 * min(na, nb) < percent * max(na, nb):
                        continue
                    filled = m * -math.expm1(-min(na, nb) / m)  # registers that aren't taken over from others
                    if estimate(np.frombuffer(ga, "<u2"), np.frombuffer(gb, "<u2"), na, nb) < least - 8 * (2 * least * (1 - least) / filled) ** 0.5:
                        continue
                    both = len(np.intersect1d(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), assume_unique=True))
                    if 100 * both >= percent * (na + nb - both):
                        a.append(ia)
                        b.append(ib)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Hot keys, each with more than a ``HOT_KEYS``-th of a table's rows, are at most this many: what is broadcast of them is bounded.
HOT_KEYS = 20_000


def _hot(counts: DataFrame, key: str, total: int, least: int) -> DataFrame | None:
    """(key, __salts) of the keys with over ``least`` rows, or over a ``HOT_KEYS``-th of the total; None if there is none. counts: (key, n)."""
    share = max(least, total // HOT_KEYS)
    hot = materialize(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("__salts")).coalesce(1), "hot")
    return hot if hot.take(1) else None


def _hot_in(rows: DataFrame, key: str, least: int) -> DataFrame | None:
    """_hot() of a table that is written already."""
    return _hot(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, rows.count(), least)


def _meet(rows: DataFrame, side: DataFrame, key: str, spread: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with ``side``, which has one row a key at most: rows of a hot key are dealt by a hash of ``spread`` over its salts, and each salt gets the key's row of ``side``."""
    if hot is None:
        return rows.join(side, key, how)
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    salts = F.coalesce("__salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), spread), salts).cast("int")).drop("__salts")
    right = side.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def connected(edges: DataFrame, tag: str = "components", least: int = 1000) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the smallest id reachable.

    Each round takes the least of an id's label, those of its neighbours and
    the label of its label, so long chains shrink by halves; labels live in the
    shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{tag}-edges")
    hubs = _hot_in(both, "b", least)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("id"), F.least("a", "l").alias("label")), tag)
    while True:
        near = _meet(both, labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b", "a", hubs).groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        up = _meet(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "id", _hot_in(labels, "label", least))
        new = materialize(up.join(near, "id").select("id", F.least("label", "near", "up").alias("label"), F.col("label").alias("old")), tag)
        if new.where("label != old").limit(1).count() == 0:
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")


def _key(sig: Column, band: Column, rows: int) -> Column:
    return F.xxhash64(band, F.substring(sig, band * (2 * rows) + 1, F.lit(2 * rows)))


class _Links:
    """The links found so far and the components they make; checks candidate pairs against full sets."""

    def __init__(self, sets: DataFrame, percent: int, m: int, least: int):
        self.sets, self.percent, self.m, self.least, self.edges, self.components = sets, percent, m, least, None, None

    def check(self, pairs: DataFrame) -> None:
        """pairs: (a, b) with a != b; adds those that are linked."""
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        one = self.sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"), F.col("shingles").alias("sa"))
        two = self.sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"), F.col("shingles").alias("sb"))
        rows = _meet(_meet(pairs, one, "a", "b", _hot_in(pairs, "a", self.least)), two, "b", "a", _hot_in(pairs, "b", self.least))
        rows = rows.select("a", "b", "na", "nb", "ga", "gb", "sa", "sb")
        found = materialize(rows.transform(in_arrow, _check_kernel(self.percent, self.m), "a long, b long"), "links")
        self.edges = found if self.edges is None else self.edges.union(found)
        settle(pairs.sparkSession)
        self.components = connected(self.edges, least=self.least)
        settle(pairs.sparkSession)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with an id, and the component of that id."""
        c = self.components
        return rows.join(c, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 4, first: int = 4, small: int = 8, block: int = 1024, least: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of distinct word shingles (A-Z in lower case; a text of fewer words is
    one shingle). component_id is the smallest doc_id reachable by links, kept
    is doc_id = component_id. Texts that are null or without words have no set
    and are alone; a row without a doc_id is alone, its component_id null, and
    kept; rows with the same doc_id are one document with the links of each;
    other columns are left out; an empty table gives no rows.

    A pair at the threshold escapes every band with a chance of
    (1 - (percent / 100) ** rows) ** bands, 7e-10 as set; the estimate drops a
    pair that lies eight standard errors under the threshold, which one at the
    threshold does with a chance below 1e-12. first: the bands of the
    first round; small: buckets up to this size are compared pair by pair;
    block: larger ones that two rounds of pivots leave in several components are
    compared in blocks of this many documents, which emit links only. least: a
    key with more rows than this, and than a ``HOT_KEYS``-th of all, is dealt
    over several tasks.
    """
    m = bands * rows
    settle(docs.sparkSession)
    docs = id_and_text(docs)
    sigs = materialize(docs.transform(in_arrow, _sign_kernel(shingle, m), _SIG), "signatures")
    named = sigs.where("fp is not null and doc_id is not null")
    classes = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    total = named.count()
    known = _meet(named, classes.select("fp", "id"), "fp", "doc_id", _hot(classes, "fp", total, least))
    alone = sigs.where("fp is null or doc_id is null").withColumn("id", F.lit(None).cast("long"))
    members = materialize(known.unionByName(alone).select("doc_id", "n_shingles", "id", F.when(F.col("doc_id") == F.col("id"), F.col("sig")).alias("sig")), "members")
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), _key(F.col("sig"), b, rows).alias("key"))))
    keys = members.where("sig is not null").select("id", every.alias("k")).select("id", "k.band", "k.key")
    rank = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min(rank)["id"].alias("pivot")).where("n > 1"), "buckets")
    # the keys that two documents share at least: all later rounds read this table
    shared = materialize(_meet(keys, buckets, "key", "id", _hot(buckets, "key", total * bands, least)), "shared")
    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    sets = materialize(docs.join(wanted, "doc_id", "left_semi").transform(in_arrow, _set_kernel(shingle, m), _SET), "sets")
    links = _Links(sets, percent, m, least)
    settle(docs.sparkSession)
    links.check(shared.where(f"band < {first} and id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))

    # buckets that still hold several components: pairs in small ones, the best-linked member as pivot in others
    degree = links.edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    open_ = _several(links.of(shared.select("id", "key", "n")), least)
    open_ = materialize(open_.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "open")
    if open_.limit(1).count():
        few = open_.where(f"n <= {small}")
        other = few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
        pairs = few.join(other, "key").where("id < b and component != cb").select(F.col("id").alias("a"), "b")
        many = materialize(open_.where(f"n > {small}"), "many")
        best = many.groupBy("key").agg(F.max(F.struct("degree", "id"))["id"].alias("pivot"))
        stars = _meet(many, best, "key", "id", _hot_in(many, "key", least)).where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        links.check(pairs.union(stars))
        left = materialize(_several(links.of(many.select("id", "key", "n")), least), "left")
        if left.limit(1).count():
            links.edges = links.edges.union(_in_blocks(left, sets, percent, block, least))
            links.components = connected(links.edges, least=least)

    joined = _meet(members.where("id is not null"), links.components, "id", "doc_id", _hot(classes.select("id", "n"), "id", total, least), "left")
    out = joined.unionByName(members.where("id is null").withColumn("component", F.lit(None).cast("long")))
    out = out.withColumn("component_id", F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many shingles each set of ``one`` has in common with each of ``two``: products of 0/1 matrices, a band of shingles at a time."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    doc, column = doc[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(shared), width):
        low, high = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[doc[low:high], column[low:high] - at] = 1
        out += m[one] @ m[two].T
    return out


def _several(rows: DataFrame, least: int) -> DataFrame:
    """(id, key, n, component) rows of the keys with more than one component."""
    rows = materialize(rows.select("id", "key", "n", "component"), "rows")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return _meet(rows, mixed, "key", "id", _hot_in(rows, "key", least))


def _in_blocks(left: DataFrame, sets: DataFrame, percent: int, block: int, least: int) -> DataFrame:
    """Links between different components in buckets of any size: every two blocks of a bucket meet in one group.

    A group holds two blocks at most, whatever the bucket; nothing but links is emitted.
    """
    size = left.groupBy("key").agg(F.count("*").alias("size"))
    cut = _meet(left, size, "key", "id", _hot_in(left, "key", least)).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    dealt = cut.select("id", "key", "component", "block", meet.alias("m")).select("id", "key", "component", "block", "m.i", "m.j")
    dealt = dealt.join(sets.select("id", "shingles"), "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, blocks = (np.array(table.column(c).to_pylist()) for c in ("id", "component", "block"))
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        n = np.array([len(x) for x in sets_], float)
        both = _common(sets_, one, two)
        linked = (100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)) & (comps[one][:, None] != comps[two][None, :])
        home, a, b = {x: x for x in comps.tolist()}, [], []

        def top(x):
            while home[x] != x:
                home[x] = x = home[home[x]]
            return x

        for x, y in zip(*(k.tolist() for k in np.nonzero(linked))):
            x, y = int(one[x]), int(two[y])
            if (cx := top(int(comps[x]))) != (cy := top(int(comps[y]))):
                home[cx] = cy
                a.append(int(ids[x]))
                b.append(int(ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "links")
