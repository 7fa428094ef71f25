"""N-gram Jaccard join with parity sketches.

A document's set holds the hashes of its distinct ``shingle``-word runs. Hashes are cut into ``p`` ranges and the members of
each range are XOR-ed: a parity sketch. A range whose sketches differ holds at least one member of the symmetric
difference, so the number of differing ranges is a lower bound of its size. Two sets of sizes a and b with similarity t or
more differ in at most d = (a + b)(1 - t) / (1 + t) members; with more than d ranges that are not empty, some range that is
not empty must agree (pigeonhole). Documents meet per size band and per range sketch; bit sketches of whole sets prune what
is left by their Hamming distance, and the sets themselves decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.common import U64, components, frugal, mix, scratch_partitions, slices, store, text_bytes, word_hashes
from barlab.llm.exact_dedup import bit_segments, may_repeat, without_ids

#: Members of one block of a key group that is compared in place; larger groups are compared block against block.
GROUP_BLOCK = 1024
#: Smallest keys of a document that travel with it, by which a pair with several common keys is found once.
LOW_KEYS = 16
#: Bits of the filter of candidate documents that is broadcast (2 MiB).
FILTER_BITS = 1 << 24


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``shingle``: the whole sequence as one; none: empty."""
    raw, at = text_bytes(column)
    words, before, _ = word_hashes(raw, at)
    n = len(words)
    factors = mix(np.arange(1001, 1001 + shingle, dtype=U64)) | U64(1)
    runs = np.zeros(max(0, n - shingle + 1), U64)
    for k in range(shingle):
        runs += words[k:k + len(runs)] * factors[k]
    runs = mix(runs)
    out = []
    for i in range(len(at) - 1):
        s, e = before[i], before[i + 1]
        if e - s >= shingle:
            out.append(np.unique(runs[s:e - shingle + 1]))
        elif e > s:
            out.append(mix(mix((words[s:e] * factors[:e - s]).sum(dtype=U64, keepdims=True)) + U64(e - s)))
        else:
            out.append(np.zeros(0, U64))
    return out


class Bands:
    """Size bands [L, L / t): sets with similarity t lie in one band or in two neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.t = num / den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * den // num)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def joint(self, n: int) -> list[tuple[int, int, int]]:
        """(joint band, largest difference d, ranges p) of the two joints (k, k+1) and (k-1, k) a set of size n takes part in."""
        k, out = self.of(n), []
        for j in (k - 1, k):
            if j < 0:
                continue
            top = self.low[j + 2] - 1
            a = min(self.low[j + 1] - 1, top)
            d = (a + min(top, a * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)
            out.append((j, d, math.ceil(1.35 * (d + 1)) + 2))  # so many ranges that over d of them are hardly ever empty
        return out


def range_keys(members: np.ndarray, bands: Bands) -> np.ndarray:
    """Sketch keys of one set in its two joint bands. Empty ranges give no key unless too few others are left."""
    keys = []
    top = (members >> U64(32)).astype(U64)
    for j, d, p in bands.joint(len(members)):
        place = (top * U64(p)) >> U64(32)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sketch = np.bitwise_xor.reduceat(members, cut)
        seed = U64((j * 0x9E3779B97F4A7C15 + 12345) & (2**64 - 1))
        keys.append(mix(mix(sketch + seed) ^ (place[cut] * U64(0xD1342543DE82EF95))))
        if len(cut) <= d:
            gone = np.setdiff1d(np.arange(p, dtype=U64), place[cut])
            keys.append(mix(mix(np.full(len(gone), seed)) ^ (gone * U64(0xD1342543DE82EF95))))
    return np.concatenate(keys)


def bit_sketch(members: np.ndarray) -> bytes:
    """A parity bit sketch of 2^k >= max(64, 4 * size) bits; the halves of a longer one XOR to the shorter one."""
    bits = max(64, 1 << (4 * len(members) - 1).bit_length()) if len(members) else 64
    hits = np.bincount((members & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def sets_table(docs: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, n (set size), h1, h2 (a 128-bit digest of the set) and its bit sketch."""

    @frugal
    def scan(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            h1 = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets]
            h2 = [int(mix(s).sum(dtype=U64).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array([bit_sketch(s) for s in sets], pa.binary())], names=["doc_id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(scan, "doc_id long, n long, h1 long, h2 long, sketch binary")


def shared_keys(docs: DataFrame, shingle: int, bands: Bands, buckets: int) -> DataFrame:
    """(key, doc_id) for every sketch key that two or more documents have.

    A block of documents sends one sorted run of (key, ordinal) per bucket, 8 bytes a key.
    """

    @frugal
    def emit(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            chosen = [i for i, s in enumerate(sets) if len(s)]
            if not chosen:
                continue
            parts = [range_keys(sets[i], bands) for i in chosen]
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            keys, ordinal = np.concatenate(parts), np.repeat(np.arange(len(chosen), dtype=U64), lens)
            bucket = (keys % U64(buckets)).astype(np.int64)
            packed = (mix(keys) << U64(24)) | ordinal
            order = np.lexsort((packed, bucket))
            counts = np.bincount(bucket, minlength=buckets)
            hit = np.flatnonzero(counts)
            idb = ids[chosen].astype(np.int64)
            runs = np.split(packed[order], np.cumsum(counts[hit])[:-1])
            blobs, owners = [], []
            for run in runs:
                own, place = np.unique(run & U64((1 << 24) - 1), return_inverse=True)
                blobs.append(((run >> U64(24) << U64(24)) | place.astype(U64)).tobytes())
                owners.append(idb[own.astype(np.int64)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(blobs, pa.binary()), pa.array(owners, pa.binary())], names=["bucket", "keys", "owners"])

    @frugal
    def gather(key, group):
        owners = [np.frombuffer(b, np.int64) for b in group.column("owners").to_pylist()]
        base = np.concatenate([[0], np.cumsum([len(o) for o in owners])])
        ids = np.concatenate(owners)
        runs = [np.frombuffer(b, U64) for b in group.column("keys").to_pylist()]
        low = U64((1 << 24) - 1)
        keys = np.concatenate([r >> U64(24) for r in runs])
        own = np.concatenate([(r & low).astype(np.int64) + base[i] for i, r in enumerate(runs)])
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        same = keys[1:] == keys[:-1]
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        full = (keys[hit].astype(np.int64) << 20) | (int(key[0].as_py()) & 0xFFFFF)
        return pa.table([pa.array(full), pa.array(ids[own[hit]])], names=["key", "doc_id"])

    return docs.mapInArrow(emit, "bucket long, keys binary, owners binary").groupBy("bucket").applyInArrow(gather, "key long, doc_id long")


def candidate_sets(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, members) of the documents in ``pairs`` (a, b); a bit filter of fixed size keeps other texts out of the shuffle."""
    wanted = store(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    bits = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")).distinct()

    @frugal
    def scan(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "members"])

    maybe = may_repeat(docs, bit_segments(bits), F.xxhash64("doc_id"), FILTER_BITS).where("__repeats").select("doc_id", "text")
    return maybe.mapInArrow(scan, "doc_id long, members binary").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "members"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: den * intersection >= num * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")

    @frugal
    def decide(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ma", "mb").mapInArrow(decide, "a long, b long")


def near_enough(sa: np.ndarray, na: int, sb: np.ndarray, nb: int, num: int, den: int) -> bool:
    """Whether sizes and the Hamming distance of bit sketches allow the similarity; never wrong about a similar pair."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    size = min(len(sa), len(sb))
    far = int(np.bitwise_count(fold(sa, size) ^ fold(sb, size)).sum())
    return far * (num + den) <= (na + nb) * (den - num)


def plausible(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that pass ``near_enough``. ``info``: doc_id, n, sketch, one row per document."""
    both = pairs.join(info.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        info.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    ratio = F.least("na", "nb") * den >= F.greatest("na", "nb") * num

    @frugal
    def decide(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")]
            keep = [near_enough(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8), m, num, den) for x, n, y, m in zip(*cols)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.where(ratio).select("a", "b", "sa", "na", "sb", "nb").mapInArrow(decide, "a long, b long")


def crossing_pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share a key, lie in different components so far and pass the size and Hamming tests; a few come several times.

    ``groups``: key, doc_id, n, sketch, component, size (of the key's group). A group is cut into blocks of about
    ``GROUP_BLOCK`` members and each pair of blocks is a unit of its own, so no task holds a whole large group; members are
    compared in place and only survivors are emitted. Units are dealt to buckets, several to a call. A pair is left to a
    smaller key if both documents have that key among their ``LOW_KEYS`` smallest; its smallest common key never passes it on.
    """
    low = groups.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW_KEYS).alias("low"))
    cut = groups.join(low, "doc_id").withColumn("blocks", F.ceil(F.col("size") / GROUP_BLOCK).cast("int")).withColumn(
        "i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"))))
    units = cut.withColumn("unit", other).select(F.xxhash64("key", "unit.x", "unit.y").alias("u"), (F.col("i") == F.col("unit.x")).alias("left"),
                                                 (F.col("unit.x") == F.col("unit.y")).alias("own"), "doc_id", "n", "sketch", "component", "key", "low")
    units = units.withColumn("bucket", F.pmod("u", F.lit(4 * scratch_partitions(groups))))

    @frugal
    def compare(group):
        order = np.argsort(group.column("u").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        u, n, ids, comp, keys = (group.column(c).to_numpy() for c in ("u", "n", "doc_id", "component", "key"))
        lows = np.full((len(u), LOW_KEYS), np.iinfo(np.int64).max)
        for i, x in enumerate(group.column("low").to_pylist()):
            lows[i, :len(x)] = x
        is_left, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("left", "own"))
        raw = [np.frombuffer(s, np.uint8) for s in group.column("sketch").to_pylist()]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u))
        found = set()
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if comp[s:e].min() == comp[s:e].max():
                continue
            size = min(map(len, raw[s:e]))
            sk = np.stack([fold(x, size) for x in raw[s:e]])
            same = own[s]
            left = np.arange(e - s) if same else np.flatnonzero(is_left[s:e])
            right = left if same else np.flatnonzero(~is_left[s:e])
            m, k, d, low = n[s:e], comp[s:e], ids[s:e], lows[s:e]
            for a in left.tolist():
                r = right[right > a] if same else right
                r = r[(k[r] != k[a]) & (den * np.minimum(m[r], m[a]) >= num * np.maximum(m[r], m[a]))]
                if len(r):
                    far = np.bitwise_count(sk[r] ^ sk[a]).sum(axis=1, dtype=np.int64)
                    r = r[far * (num + den) <= (m[r] + m[a]) * (den - num)]
                    if len(r):
                        r = r[~np.isin(low[r], low[a][low[a] < keys[s]]).any(axis=1)]
                    found.update((int(min(d[a], d[b])), int(max(d[a], d[b]))) for b in r)
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return units.groupBy("bucket").applyInArrow(compare, "a long, b long")


def unsettled(keys: DataFrame, so_far: DataFrame) -> DataFrame:
    """(key, doc_id, component, size) of the keys whose members lie in several components; of keys with the same members one is enough."""
    placed = keys.join(so_far.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = placed.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.bit_xor(F.xxhash64("doc_id")).alias("s1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("s2")).where("lo < hi")
    split = split.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key", "size")
    return placed.join(split, "key").select("key", "doc_id", "component", "size")


def second_stars(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of unsettled keys with two others, chosen by hash, in other components.

    Where a key's smallest document is a stranger among near copies, none was linked to it; two other centres link them before
    pairs are formed. A key of two members is settled.
    """
    h = F.xxhash64("doc_id", F.lit(7))
    own = F.struct("doc_id", "component")
    centres = groups.where("size > 2").groupBy("key").agg(F.array(F.min_by(own, h), F.max_by(own, h)).alias("c"))
    pairs = groups.join(centres, "key").select("doc_id", "component", F.explode("c").alias("c")).where("component <> c.component")
    return pairs.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id per row of ``docs`` (doc_id, text; other columns are ignored).

    ``class_id`` is the smallest id with the same set. Null and empty texts and texts without words have an empty set and
    link with nothing. A null doc_id never links and has null component_id; rows that repeat a doc_id share its component.
    Links are verified on sets of 64-bit shingle hashes. First every key's members are verified against its smallest one, then
    against two others where they are still apart; then members of one key that are still in different components are compared with each other, so no link between
    components is lost and large groups of copies never form all their pairs.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = Bands(num, den)
    rows = store(sets_table(narrow, shingle), "sets")
    live = rows.where("n > 0 and doc_id is not null")
    firsts = live.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class_id"))
    members = store(live.join(firsts, ["n", "h1", "h2"]).groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.min(F.struct("class_id", "n", "sketch")).alias("own")).select("doc_id", "class_id", "own.n", "own.sketch"), "classes")
    info = members.select("doc_id", "n", "sketch")
    usable = narrow.where("doc_id is not null and text is not null")
    copies = members.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    usable = without_ids(usable, copies.select(F.col("a").alias("doc_id")))  # one document of each set
    keys = store(shared_keys(usable, shingle, bands, 2 * scratch_partitions(docs)), "keys")
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("a"))
    stars = keys.join(heads, "key").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = store(plausible(stars, info, num, den), "stars")
    links = store(verified(stars, store(candidate_sets(usable, stars, shingle), "members"), num, den), "links")
    groups = store(unsettled(keys, components(links, "first")), "unsettled")
    more = store(plausible(second_stars(groups).join(stars, ["a", "b"], "left_anti"), info, num, den), "stars")
    links = links.unionByName(store(verified(more, store(candidate_sets(usable, more, shingle), "members"), num, den), "links"))
    stars = stars.unionByName(more)
    groups = store(unsettled(keys, components(links, "second")), "unsettled").join(info, "doc_id")
    more = store(crossing_pairs(groups, num, den).distinct().join(stars, ["a", "b"], "left_anti"), "more")
    more = store(verified(more, candidate_sets(usable, more, shingle), num, den), "links")
    found = components(links.unionByName(more).unionByName(copies), "all").withColumnRenamed("node", "doc_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").join(members.select("doc_id", "class_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that of the smallest doc_id; unlinked rows and null ids stay."""
    gone = jaccard_components(docs, shingle, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, gone)
