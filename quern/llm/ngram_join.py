"""N-gram Jaccard self-join by PartEnum signatures, and the components of its links.

Sets of similar size (one band, sizes l to 2 l) use the same partitioning of the
feature domain: l // 6 first-level partitions by a hash, each split to the single
shingle at the second level.  Two sets of n and m shingles with Jaccard >= 3/4
differ in at most (n + m) / 7 shingles, so all but n // 3 of the first one's are
in both.  In one order of the whole domain, common to all sets, the first
n // 3 + 1 + g shingles of a set, g being the first-level partitions, therefore
hold the first g + 1 common ones, of which two fall in one first-level
partition.  So each set enumerates, within each first-level partition, the
subsets of two second-level partitions among those first shingles; similar sets
share such a signature.  The order puts frequent shingles last, by counts over
the whole corpus, so passages that many documents share seldom become
signatures.  A signature also carries how late it stands in its set: what comes
before it is hardly common, so a member of a signature's list is dropped when
even with the list's earliest member it would differ in too many shingles.

Equal sets are one class from the start.  Classes that share a signature form a
list; every member is compared exactly with the list's least member.  Lists that
then still lie in several components go to a task each (very long ones in blocks
of BLOCK members, so that a task's memory is bounded): sketches first narrow them
to groups that may hold a link, and each distinct group's sets are compared until
it is one component or no pair is left.  So no list is expanded into rows for all
its pairs, and no link between two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, mix64, numbered_rows, text_bytes, text_slices, united
from .components import components
from .shingles import shingle_sets

#: Slots of the table of shingle counts, one byte each.
COUNT_BITS = 22
#: Most bits (as a power of two) of the filter that spares documents which share no signature.
FILTER_BITS = 27
#: Signatures that a mapper holds before it deals them out, and those of one bucket (about).
HELD, BUCKET = 1 << 19, 400_000
#: Slack of positions in a signature's list is counted in this part of twice the first-level partitions.
SLACK = 64
_BLOCK = 1 << 16
#: Members of a list or group that one task compares with as many others.
BLOCK = 512
#: Chains of possible links of up to so many members are compared pair by pair.
FEW = 32


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
    for lo, hi in text_slices(column):
        yield from zip(ids[lo:hi], shingle_sets(*text_bytes(column.slice(lo, hi - lo))), strict=True)


def class_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(int(mix64(shingles ^ np.uint64(k)).sum(dtype=np.uint64)).to_bytes(8, "little") for k in (0x51ED270B, 0x2545F491))


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of how many shingles fall in each of 2 n to 4 n ranges of hashes, one bit each."""
    bits = max(6, (2 * len(shingles)).bit_length())
    odd = np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _fold(sketch: bytes, size: int) -> int:
    """A sketch with as many ranges as one of ``size`` bytes has."""
    x, n = int.from_bytes(sketch, "little"), len(sketch)
    while n > size:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return x


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their sketches."""
    size = min(len(a), len(b))
    return (_fold(a, size) ^ _fold(b, size)).bit_count()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then this task's counts of shingles in blocks."""
    names, kinds = ["doc_id", "n", "key", "sketch", "block", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    for batch in batches:
        rows = []
        for doc, s in _sets(batch):
            rows.append((doc, len(s), _key(class_of(s)) if len(s) else None, sketch(s) if len(s) else None, None, None))
            np.add.at(counts, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)], names=names)
    few = np.minimum(counts, 255).astype(np.uint8).reshape(-1, _BLOCK)
    rows = [(None, None, None, None, i, c.tobytes()) for i, c in enumerate(few) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds, strict=True)], names=names)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each block that reaches this task, one block's sum held for each."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(c, np.uint8 if len(c) == _BLOCK else np.uint32)
            held[block] = held.get(block, 0) + own.astype(np.int64)
    rows = [(b, int(c.sum()), np.minimum(c, (1 << 32) - 1).astype(np.uint32).tobytes()) for b, c in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "total", "counts"])


def heat_table(described: DataFrame) -> np.ndarray:
    """For each slot, how many half doublings its count lies above the mean (0: at most the mean)."""
    kind = "block int, total long, counts binary"
    parts = described.where("block is not null").select("block", "counts", F.floor(F.spark_partition_id() / 16).alias("part"))
    made = parts.repartition("block", "part").mapInArrow(_totals, kind)  # in two steps, as each task has counted every block
    made = Stored(made.repartition("block").mapInArrow(_totals, kind), "counts").df
    mean = max(1.0, (made.agg(F.sum("total")).collect()[0][0] or 0) / (1 << COUNT_BITS))
    heat = np.zeros(1 << COUNT_BITS, np.uint8)
    for row in made.toLocalIterator():
        counts = np.frombuffer(row["counts"], np.uint32)
        heat[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.clip(2 * np.log2(np.maximum(counts, 1) / mean), 0, 255)
    return heat


def bands_of(n: int) -> list[int]:
    """The least sizes of the bands of a set of n shingles: its own, and the next one if a partner may lie there.

    In bands below 4 only equal sets are similar.
    """
    own = 1 << (n.bit_length() - 1)
    return [low for low in ((own, 2 * own) if 4 * n >= 6 * own else (own,)) if low >= 4]


def signatures(shingles: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set for all its bands, and how late each stands in the set.

    For sets of n and m shingles with a common signature at positions i and j,
    and nothing else in common before, i + j <= (n + m) / 7 + 2 g must hold for
    g first-level partitions; with (7 i - n) / 14 g, in parts of 1 / SLACK and
    rounded down, the sum of both is then at most SLACK.
    """
    n, found, late = len(shingles), [], []
    mixed = mix64(shingles)
    rank = heat[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mixed >> np.uint64(8)
    for low in bands_of(n):
        groups = max(1, low // 6)
        need = n // 3 + 1 + groups
        first = np.sort(np.partition(rank, need - 1)[:need] if need < n else rank)
        group = (first & np.uint64((1 << 40) - 1)) % np.uint64(groups)
        place = np.argsort(group, kind="stable")
        group, own = group[place], first[place]
        for k in range(1, len(own)):
            i = np.flatnonzero(group[k:] == group[:-k])
            if not len(i):
                break
            found.append(mix64(own[i] * np.uint64(0xD1342543DE82EF95) + own[i + k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(low)))
            late.append(np.minimum((7 * place[i + k] - n) * SLACK // (14 * groups), 127).astype(np.int8))
    return (np.concatenate(found), np.concatenate(late)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int8))


def _deal(heat, buckets: int):
    """Signatures in blobs by bucket: 32 bits of each signature, then all their positions, then the classes' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, keys, found, late, held = np.frombuffer(heat.value, np.uint8), set(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            sig, at = np.concatenate(found), np.concatenate(late)
            key = np.repeat(np.array(keys, np.int64), [len(f) for f in found])
            bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sig, at, key, bucket = sig[order].astype(np.uint32), at[order], key[order], bucket[order]
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            blobs = [sig[a:b].tobytes() + at[a:b].tobytes() + key[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            out = pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            for x in (keys, found, late):
                x.clear()
            return out

        for batch in batches:
            for _, s in _sets(batch):
                if len(s) < 3:  # such sets are linked only when equal
                    continue
                key = _key(class_of(s))
                if key in seen:
                    continue
                if len(seen) >= 1 << 16:  # copies that this lets through fall together in their bucket
                    seen.clear()
                seen.add(key)
                keys.append(key)
                for x, y in zip((found, late), signatures(s, table), strict=True):
                    x.append(y)
                held += len(found[-1])
                if held >= HELD:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return run


def _bucket_lists(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(list, key, head) for each distinct list of two or more classes that share a signature of one bucket."""
    sizes = [len(x) // 13 for x in blobs]
    sig = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(blobs, sizes, strict=True)])
    order = np.argsort(sig)
    same = sig[order[1:]] == sig[order[:-1]]
    some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if not len(some):
        return
    late = np.concatenate([np.frombuffer(x, np.int8, n, 4 * n) for x, n in zip(blobs, sizes, strict=True)])[some].astype(np.int16)
    key = np.concatenate([np.frombuffer(x[5 * n :], np.int64, n) for x, n in zip(blobs, sizes, strict=True)])[some]
    sig = sig[some]
    order = np.lexsort((key, late, sig))
    sig, late, key = sig[order], late[order], key[order]
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
    sig, late, key = sig[fresh], late[fresh], key[fresh]
    begins, many = _runs_of(sig)
    if not many.any():
        return
    # Each list is sorted by position: the earliest other member of the first one is the second.
    earliest = np.repeat(late[begins], np.diff(np.append(begins, len(sig))))
    seconds = begins[many] + 1
    earliest[begins[many]] = late[seconds]
    fine = late + earliest <= SLACK
    fine &= np.repeat(many, np.diff(np.append(begins, len(sig))))
    sig, key = sig[fine], key[fine]
    if not len(sig):
        return
    begins, many = _runs_of(sig)
    sizes = np.diff(np.append(begins, len(sig)))
    names = mix64(np.add.reduceat(mix64(key.view(np.uint64)), begins) + sizes.astype(np.uint64))
    heads = np.minimum.reduceat(key, begins)
    _, one = np.unique(names[many], return_index=True)
    kept = np.flatnonzero(many)[one]
    for at in np.array_split(kept, max(1, int(sizes[kept].sum()) >> 16)):
        if len(at):
            rows = np.concatenate([key[begins[i] : begins[i] + sizes[i]] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at].view(np.int64), sizes[at])), pa.array(rows), pa.array(np.repeat(heads[at], sizes[at]))], names=["list", "key", "head"])


def _runs_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one value begin, and which of them are longer than one."""
    begins = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    return begins, np.diff(np.append(begins, len(sig))) > 1


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of bucket after bucket; rows come sorted by bucket, and one bucket is held at a time."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if bucket != now and held:
                yield from _bucket_lists(held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield from _bucket_lists(held)


def _slot(ids: pa.Array, bits: int) -> np.ndarray:
    """The slots of doc_ids in a filter; all null ones have one."""
    known = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
    return (mix64(known.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[_slot(batch.column("doc_id"), bits)] = True
        packed = np.packbits(table).reshape(-1, 4096)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    return run


def _wanted(table, bits: int):
    """Classes and shingle sets of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(np.frombuffer(table.value, np.uint8)).view(bool)
        for batch in batches:
            few = batch.filter(pa.array(passes[_slot(batch.column("doc_id"), bits)]))
            for lo in range(0, few.num_rows, 200):
                found = [s for _, s in _sets(few.slice(lo, 200)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(class_of(s)) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "shingles"])

    return run


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 75 in 100, counted exactly."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        mask = pa.array([similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])


def _sets_of(docs: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Shingle sets (key, shingles) of the classes named by ``keys``, None if there are none.

    A filter of bounded size spares most other documents; a join settles the rest.
    """
    wanted = Stored(keys.join(classes.select("key", F.col("rep").alias("doc_id")), "key"), "wanted").df
    count = wanted.count()
    if not count:
        return None
    bits = min(FILTER_BITS, max(16, (8 * count).bit_length()))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in united(wanted.select("doc_id").mapInArrow(_slots(bits), "block int, bits binary")).toLocalIterator():
        table[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    passed = docs.mapInArrow(_wanted(docs.sparkSession.sparkContext.broadcast(table.tobytes()), bits), "key long, shingles binary")
    return Stored(passed.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "shingles").df


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches do not rule out: similar sets differ in at most a seventh of both sizes."""
    for batch in batches:
        ok = [7 * least_difference(a, b) <= n for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n")), strict=True)]
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The true links among pairs (u, v) of classes, stored."""
    near = pairs.join(classes.select(F.col("key").alias("u"), F.col("sketch").alias("a"), F.col("n").alias("na")), "u")
    near = near.join(classes.select(F.col("key").alias("v"), F.col("sketch").alias("b"), F.col("n").alias("nb")), "v")
    near = near.where("100 * least(na, nb) >= 75 * greatest(na, nb)").select("u", "v", "a", "b", (F.col("na") + F.col("nb")).alias("n"))
    near = Stored(near.mapInArrow(_possible, "u long, v long"), "possible").df
    sets = _sets_of(docs, near.select(F.col("u").alias("key")).unionByName(near.select(F.col("v").alias("key"))).distinct(), classes)
    if sets is None:
        return near
    both = near.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b")), "v")
    return Stored(both.mapInArrow(_verify, "u long, v long"), "links").df


def _in_blocks(rows: DataFrame, of: str) -> DataFrame:
    """Rows for each two blocks of the members of a list or group, together in one task one after the other.

    One of up to BLOCK members has one block; a member of a longer one goes
    to as many tasks as it has blocks.
    """
    parts = Stored(rows.groupBy(of).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1"), "parts").df
    rows = rows.join(parts, of, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "parts")
    return rows.repartition(of, "i", "j").sortWithinPartitions(of, "i", "j", "key")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (key, i, j), whatever the batches' bounds."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in (key, "i", "j")])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            this = tuple(keys[:, a].tolist())
            if this != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at their least common resolution, one row of 64-bit words each."""
    size = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size), axis=0) for s in sketches])


def _maybe(x: np.ndarray, n: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Which of ``among`` the sizes and sketches do not rule out as similar to row i."""
    among = among[100 * np.minimum(n[among], n[i]) >= 75 * np.maximum(n[among], n[i])]
    return among[7 * np.bitwise_count(x[among] ^ x[i]).sum(axis=1, dtype=np.int64) <= n[among] + n[i]]


class _Union:
    def __init__(self, labels):
        first: dict = {}
        self.root = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.root))])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, key, component): members of a list that chains of possible links across components join."""
    for rows in _runs(batches, "list"):
        component, key, n = (rows.column(c).to_numpy() for c in ("component", "key", "n"))
        if len(np.unique(component)) < 2:
            continue
        x, joined, pairs = _folded(rows.column("sketch").to_pylist()), _Union(range(len(key))), []
        for i in range(len(key) - 1):
            rest = np.arange(i + 1, len(key))
            for j in _maybe(x, n, i, rest[component[rest] != component[i]]).tolist():
                joined.join(i, j)
                pairs.append((i, j))
        roots = joined.roots()
        sizes = np.bincount(roots)
        # Few members: each possible pair is a group, so that equal pairs of many lists are compared once.
        out = [np.array(p) for p in pairs if sizes[roots[p[0]]] <= FEW] + [np.flatnonzero(roots == r) for r in np.flatnonzero(sizes > FEW)]
        if out:
            names = [int(mix64(key[g].view(np.uint64)).sum(dtype=np.uint64).view(np.int64)) for g in out]
            at = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(g) for g in out])), pa.array(key[at]), pa.array(component[at])], names=["group", "key", "component"])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join a group's components: exact comparisons until no pair of different components is left."""
    for rows in _runs(batches, "group"):
        key, sets = rows.column("key").to_numpy(), [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        n, x, found = np.array([len(s) for s in sets]), _folded([sketch(s) for s in sets]), []
        joined = _Union(rows.column("component").to_pylist())
        for i in range(len(key) - 1):
            for j in _maybe(x, n, i, np.arange(i + 1, len(key))).tolist():
                if joined.find(i) != joined.find(j) and similar(sets[i], sets[j]):
                    joined.join(i, j)
                    found.append((int(key[i]), int(key[j])))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], names=["u", "v"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Links join documents whose sets of distinct 5-word shingles have a Jaccard
    similarity of 0.75 or more; component_id is the least doc_id that links
    reach.  Null texts are empty; documents without words have no shingle and
    stand alone.  Each row is a document: rows with equal texts are always
    linked, and rows that share a doc_id only where their texts are.  Null
    doc_ids count only where a component has no other (its id is then null).
    Texts are read whole at any length; links do not depend on the order of rows,
    so there are no ties to break.  Other columns are ignored and an empty table
    gives an empty result.  Shingles are compared as 64-bit hashes and classes
    are named by 64 bits of a sum of hashes, neither of which is checked further.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = Stored(docs.mapInArrow(_describe, "doc_id long, n long, key long, sketch binary, block int, counts binary"), "sets").df
    heat = spark.sparkContext.broadcast(heat_table(described).tobytes())  # 2**COUNT_BITS bytes at any size of input
    rows = described.where("block is null").select("doc_id", "n", "key")

    classes = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = Stored(classes, "classes").df

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, int(classes.agg(F.sum("n")).first()[0] or 0) * 5 // 4 // BUCKET)
    dealt = docs.mapInArrow(_deal(heat, buckets), "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    lists = Stored(dealt.mapInArrow(_lists, "list long, key long, head long"), "lists").df
    members = Stored(lists.distinct(), "members").df

    links = _links(docs, members.where("key <> head").select(F.col("head").alias("u"), F.col("key").alias("v")).distinct(), classes)
    known = Stored(components(links), "known").df.withColumnRenamed("u", "key")

    # Lists whose members lie in several components (the head was compared with all).
    told = members.where("key <> head").join(known, "key", "left").select("list", "key", F.coalesce("component", "key").alias("component"))
    told = Stored(told, "told").df
    split = Stored(told.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("list"), "split").df
    rows_of = told.join(split, "list").join(classes.select("key", "n", "sketch"), "key")
    groups = Stored(_in_blocks(rows_of.select("list", "key", "n", "component", "sketch"), "list").mapInArrow(_groups, "group long, key long, component long").distinct(), "groups").df
    sets = _sets_of(docs, groups.select("key").distinct(), classes)
    if sets is not None:
        full = groups.join(sets, "key").select("group", "key", "component", "shingles")
        more = Stored(_in_blocks(full, "group").mapInArrow(_link_groups, "u long, v long"), "links").df
        # Known components stand for their links: each member to its least one.
        stars = known.select(F.col("key").alias("u"), F.col("component").alias("v"))
        known = Stored(components(stars.unionByName(more)), "known").df.withColumnRenamed("u", "key")

    # The least doc_id of each component, then of each class that has a partner or a copy.
    linked = known.join(classes.select("key", "rep"), "key")
    least = Stored(linked.groupBy("component").agg(F.min("rep").alias("least")), "least").df
    lone = classes.where("copies > 1").join(known, "key", "left_anti").select("key", F.col("rep").alias("least"))
    label = Stored(linked.join(least, "component").select("key", "least").unionByName(lone).withColumn("told", F.lit(True)), "labels").df
    out = rows.join(label, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("told"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all columns.

    Rows are told apart by a number of their own: of a component the least
    doc_id stays (a null one only where there is no other), and of its rows one
    (a tie that the rows' numbers decide).  An empty table gives an empty one.
    """
    rows, row = numbered_rows(docs, "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), "component_id")
    own = rows.select(F.col(row).alias("_number"), F.col("doc_id").cast("long").alias("_id"))
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_of").alias("row")))
    keep = found.join(own, found["_of"] == own["_number"]).groupBy("component_id").agg(best.alias("best")).select(F.col("best.row").alias("_keep"))
    kept = rows.join(keep, rows[row] == keep["_keep"], "left_semi")
    return kept.select(*(kept[c] for c in docs.columns))
