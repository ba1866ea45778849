"""Near-duplicate records by token-combination prefixes.

A record is the set of its word shingles. Shingles have one global order, by rising frequency (any order is right, a good one is
fast), and three classes: rare shingles are indexed singly, frequent ones in pairs and very frequent ones in triples, each within hash
buckets of its class. The prefix of a record is extended until more shingles than a similar record may lack would have to vanish to
destroy all its combinations; two similar records then share at least one. Records too small for three classes use two, rare
shingles and pairs in one bucket; those that may meet such a record use both ways. Records that share a combination are verified
on the whole sets if their sizes and parity bitmaps allow it: two bitmaps differ in at most as many bits as the sets in
shingles, so this test loses nothing.

Frequencies are counted in `CELLS` cells that stay distributed; the driver and the workers hold one bit a cell (does any other record have the
shingle?) and the counts of the at most `HEAVY` fullest cells. The bounds of the classes follow the median count.

Disk holds packed words, from which each step makes the shingles anew. Signatures are dealt out in rounds by their value, each with the size and the bitmap of a set once a
task, and what a round wrote is deleted before the next; more rounds cost time and lose nothing.

Equal sets of a block are signed once and those of several blocks are one where they meet, so copies produce no candidates. A signature is compared within one task, in portions. Other joins
are merge joins, whose skewed partitions Spark's adaptive execution splits; Spark's size estimates behind arrays and Python decide nothing.

Defined cases: null name and text count as empty; a record with fewer words than a shingle is similar to none; repeated rows
count once; an id delivered with several texts takes part with each; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.runtime import cores, cut, merged, released, spread

#: Cells of the frequency count; cells whose counts travel; slots that hold them.
CELLS, HEAVY, SLOTS = 1 << 26, 1 << 19, 1 << 22
#: Words of a block of texts, beyond which another begins.
BLOCK = 1 << 20
#: Parts of the cells that are added up one at a time.
RANGES = 256
#: Signatures (or counts) that a task holds at a time; pairs that it compares at a time; sets of one block whose signatures are counted beforehand.
ENTRIES, PORTION, SAMPLE = 4_000_000, 1 << 17, 2000
#: A round of signatures writes at most about so many times the bytes of the blocks, or so many bytes, unless there would be more rounds than this.
ROUND, LEAST, MOST_ROUNDS = 4, 64 << 20, 64
#: (greatest count, shingles in a combination, hash buckets) of the classes, and those of small records.
CLASSES = ((256, 1, 1), (4096, 2, 16), (2**62, 3, 4))
SMALL_CLASSES = ((256, 1, 1), (2**62, 2, 1))
#: Bits of the parity bitmap that goes with each signature, in longs.
LONGS = 6
#: Sets of equal shingles with more members than this have their pairs dealt over `SALTS` tasks.
HOT, SALTS = 256, 32
_WORD = re.compile(r"[^\W_]+")
_HEAD = struct.Struct("<3sqq")
_A, _B, _SHIFT = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 29))


def _fold(columns: list[np.ndarray], tag: int) -> np.ndarray:
    """One 64-bit hash of each row of the columns."""
    h = np.full(len(columns[0]), tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for c in columns:
        h ^= c.view(np.uint64)
        h *= _A
        h += _B
        h ^= h >> _SHIFT
    return h.view(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed value. Bytes of the same weight lie together: the upper ones of small numbers are equal."""
    out = []
    for x in columns:
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(_HEAD.pack(x.dtype.str.encode(), len(raw), len(small)) + small)
    return b"".join(out)


def _unpacked(value: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(value):
        kind, raw, small = _HEAD.unpack_from(value, at)
        at += _HEAD.size + small
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(pa.decompress(value[at - small : at], raw, codec="zstd", asbytes=True) if raw else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype))
    return out


def _shingled(words: np.ndarray, held: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of 64-bit hashes of texts' runs of `width` words, one after the other, each ascending, and their sizes. words: their hashes, text after text; held: how many each has, `width` at least."""
    if not len(held):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    # runs of all texts at once, without those that reach into the next text
    runs = _fold([words[j : len(words) - width + 1 + j] for j in range(width)], width)
    ends = np.cumsum(held)
    across = (ends[:-1, None] - np.arange(1, width)).ravel()
    runs = np.delete(runs, across)
    sizes = held - width + 1
    ends = np.cumsum(sizes)
    for start, end in zip((ends - sizes).tolist(), ends.tolist()):
        runs[start:end].sort()
    first = np.concatenate(([True], runs[1:] != runs[:-1]))
    first[ends[:-1]] = True
    return runs[first], np.add.reduceat(first.astype(np.int64), ends - sizes)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words], dtype=np.int64)


def word_blocks(records: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """(keys, sids, words): a row for each batch, of about `BLOCK` words at most, of the texts that have a run of `width` words: their keys, the hashes of their sets of such runs, and, packed, the words of one text of
    each set. Words are the longest runs of letters and digits, in small letters. The blocks hold about half of the bytes of the texts' compressed table, where the hashes of the runs, which nothing compresses, hold three times as many."""

    def block(keys: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], dtype=np.uint32)
        held = np.array([len(words) for words in texts], dtype=np.int64)
        grams, sizes = _shingled(_hashes(list(known))[ids], held, width)
        ends = np.cumsum(sizes).tolist()
        sids = np.array([int.from_bytes(blake2b(grams[e - n : e].tobytes(), digest_size=8).digest(), "little", signed=True) for n, e in zip(sizes.tolist(), ends)], dtype=np.int64)
        one = np.zeros(len(sids), dtype=bool)
        one[np.unique(sids, return_index=True)[1]] = True
        names = np.frombuffer(" ".join(known).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        packed = _packed(sids[one], held[one].astype(np.uint32), ids[np.repeat(one, held)], names)
        offsets = pa.array([0, len(texts)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, pa.array(sids)), pa.array([packed], pa.binary())], names=["keys", "sids", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, total = [], [], 0
            for i, t in enumerate(b.column(1).to_pylist()):
                words = _WORD.findall((t or "").lower())
                if len(words) >= width:
                    at.append(i)
                    texts.append(words)
                    total += len(words)
                if total > BLOCK:
                    yield block(b.column(0).take(pa.array(at)), texts)
                    at, texts, total = [], [], 0
            if at:
                yield block(b.column(0).take(pa.array(at)), texts)

    kind = records.schema[key].dataType.simpleString()
    return spread(records.select(F.col(key).alias("key"), text.alias("words"))).mapInArrow(run, f"keys array<{kind}>, sids array<bigint>, words binary")


def _texts(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of the sets of a block: their hashes, the lengths of their texts, these as places in a list of words, and the list."""
    sids, held, ids, names = _unpacked(block)
    return sids, held.astype(np.int64), ids, names.tobytes().decode("utf-8", "surrogatepass").split(" ")


def block_sets(block: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a block: their hashes, their shingles one set after the other, each ascending, and their sizes."""
    sids, held, ids, names = _texts(block)
    return sids, *_shingled(_hashes(names)[ids], held, width)


def each_text(blocks: DataFrame) -> DataFrame:
    """(sid, words): the words of one text of each set of each block, with blanks between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                sids, held, ids, names = _texts(block)
                ids, ends = ids.tolist(), np.cumsum(held).tolist()
                texts = [" ".join([names[i] for i in ids[e - n : e]]) for n, e in zip(held.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(texts, pa.string())], names=["sid", "words"])

    return blocks.select("words").mapInArrow(run, "sid bigint, words string")


@lru_cache(maxsize=64)
def lacking(threshold: float, classes: tuple) -> int:
    """Sizes up to this may lack an extended prefix over the classes."""
    slack, n = sum((k - 1) * m for _, k, m in classes), 1
    while n - slack < n - math.ceil(threshold * n - 1e-9) + 1:
        n += 1
    return n - 1


@lru_cache(maxsize=512)
def _choose(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k).T


@lru_cache(maxsize=64)
def _bounds(classes: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    most, ks, ms = zip(*classes)
    return np.array(most, dtype=np.int64), np.array(ks), np.array(ms)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))


def _runs(x: np.ndarray) -> np.ndarray:
    """Each element's place in its run of equal values."""
    starts = _starts(x)
    return np.arange(len(x)) - np.repeat(starts[:-1], np.diff(starts)) if len(x) else np.empty(0, dtype=np.int64)


def _extended(tag: int, g: np.ndarray, c: np.ndarray, rec: np.ndarray, place: np.ndarray, missing: np.ndarray, classes: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashed combinations of the extended prefixes, and whose they are. g, c, rec, place: shingles in the global order, record by record, their counts, their record and their place in it; missing: by record.
    Shingles that occur in no other set (count 1) count in the prefix but need no entry."""
    singles = np.minimum(np.bincount(rec[c <= classes[0][0]], minlength=len(missing)), missing)
    single = (place < singles[rec]) & (c > 1)
    out = [(_fold([g[single]], tag), rec[single])]
    missing = missing - singles
    rest = (place >= singles[rec]) & (missing[rec] > 0)
    g, c, rec = g[rest], c[rest], rec[rest]
    if not len(g):
        return out
    most, ks, ms = _bounds(classes)
    kind = np.searchsorted(most, c)
    bucket = rec * 256 + kind * 64 + (g >> 17) % ms[kind]
    # a shingle adds to the prefix if its bucket holds k - 1 others before it
    order = np.argsort(bucket, kind="stable")
    among = np.empty(len(g), dtype=np.int64)
    among[order] = _runs(bucket[order])
    adds = among >= ks[kind] - 1
    before = np.cumsum(adds) - adds
    starts = _starts(rec)
    before -= np.repeat(before[starts[:-1]], np.diff(starts))
    order = order[(before < missing[rec])[order]]
    mixed, bucket, rec = _fold([g[order]], tag), bucket[order], rec[order]
    starts = _starts(bucket)
    starts, held = starts[:-1], np.diff(starts)
    wanted = ks[bucket[starts] % 256 // 64]
    for k, n in {*zip(wanted[held >= wanted].tolist(), held[held >= wanted].tolist())}:
        at, chosen = starts[(held == n) & (wanted == k)], _choose(n, k)
        # a sum does not depend on the order of its parts
        sums = sum(mixed[(at[:, None] + places).ravel()] for places in chosen)
        out.append((_fold([sums], tag + k), np.repeat(rec[at], chosen.shape[1])))
    return out


def all_signatures(grams: np.ndarray, sizes: np.ndarray, counts: np.ndarray, threshold: float, classes: tuple = CLASSES, small_classes: tuple = SMALL_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the combinations in the extended prefixes of sets, and the place of the set that each is from: by the classes for its size and, if it may meet a smaller one, by those for that.
    grams: the sets one after the other, each ascending."""
    limit, tiny = lacking(threshold, classes), lacking(threshold, small_classes)
    missing = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    rec = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort((rec << 33) + np.minimum(counts, 2**33 - 1), kind="stable")
    g, c = grams[order], counts[order]
    place = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    small = sizes * threshold <= tiny + 1e-9
    one = small[rec] & (place < missing[rec]) & (c > 1)
    out = [(_fold([g[one]], 1), rec[one])]
    for tag, these, by in ((16, (sizes > tiny) & (sizes * threshold <= limit + 1e-9), small_classes), (32, sizes > limit, classes)):
        if these.any():
            m = these[rec]
            out += _extended(tag, g[m], c[m], rec[m], place[m], missing, by)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def signatures(grams: np.ndarray, counts: np.ndarray, threshold: float, classes: tuple = CLASSES, small_classes: tuple = SMALL_CLASSES) -> np.ndarray:
    """The signatures of one set, its shingles in any order."""
    order = np.argsort(grams, kind="stable")
    return all_signatures(grams[order], np.array([len(grams)]), counts[order], threshold, classes, small_classes)[0]


def parity(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of 64 * LONGS hash bits occurs in each of the sets, modulo 2, as longs; a row for each set."""
    bits = 64 * LONGS
    at = np.repeat(np.arange(len(sizes)) * bits, sizes) + (grams >> 40) % bits
    odd = (np.bincount(at, minlength=bits * len(sizes)) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(-1, LONGS)


def _added(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cell, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    starts = _starts(cell[order])[:-1]
    return cell[order][starts], np.add.reduceat(n[order], starts)


class Frequency:
    """How often shingles occur in the blocks' sets: 1 for those of one set only, else 2, or the count of their cell if it is among the fullest. One bit a cell and at most HEAVY short rows reach the driver, whatever the
    input. A set that several blocks have counts in each, which changes the order, never the pairs."""

    def __init__(self, blocks: DataFrame, width: int) -> None:
        part = CELLS // RANGES

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, counts = [], []

            def out() -> pa.RecordBatch:
                cell, n = _added(cells, counts)
                starts = _starts(cell // part)
                packed = [_packed(np.diff(cell[a:b], prepend=cell[a] // part * part).astype(np.uint32), n[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                return pa.RecordBatch.from_arrays([pa.array((cell[starts[:-1]] // part).astype(np.int32)), pa.array(packed, pa.binary())], names=["range", "cells"])

            for b in batches:
                for block in b.column(0).to_pylist():
                    cell, n = np.unique(np.mod(block_sets(block, width)[1], CELLS), return_counts=True)
                    cells.append(cell)
                    counts.append(n)
                    if sum(map(len, cells)) > ENTRIES:
                        yield out()
                        cells.clear(), counts.clear()
            if cells:
                yield out()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[int, np.ndarray] = {}
            for b in batches:
                for r, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    steps, n = _unpacked(value)
                    whole.setdefault(r, np.zeros(part, dtype=np.int64))[np.cumsum(steps, dtype=np.int64)] += n
            for r, n in whole.items():
                cell = np.flatnonzero(n > 1)
                powers = np.bincount(np.log2(n[cell]).astype(np.int64), minlength=64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([powers.tolist()], pa.list_(pa.int64())), pa.array([_packed(np.packbits(n > 1, bitorder="little"))], pa.binary()), pa.array([_packed(cell.astype(np.uint32), n[cell])], pa.binary())],
                    names=["range", "powers", "bits", "cells"],
                )

        tasks = min(RANGES, 2 * cores(blocks.sparkSession))
        counted = blocks.select("words").mapInArrow(count, "range int, cells binary").repartitionById(tasks, F.col("range") % tasks)
        cells = cut(counted.mapInArrow(add, "range int, powers array<bigint>, bits binary, cells binary"))
        self.bits, powers = np.zeros(CELLS // 64, dtype=np.uint64), np.zeros(64, dtype=np.int64)
        for r in cells.select("range", "powers", "bits").toLocalIterator():
            powers += r.powers
            self.bits[r.range * part // 64 : (r.range + 1) * part // 64] = _unpacked(bytes(r.bits))[0].view(np.uint64)
        powers = [(p, k) for p, k in enumerate(powers.tolist()) if k]
        total, above, least, median = sum(k for _, k in powers), 0, 63, 1
        for p, k in reversed(powers):
            if above + k > HEAVY:
                break
            above, least = above + k, p
        seen = 0
        for p, k in powers:
            seen += k
            if 2 * seen >= total:
                median = 1 << p
                break
        rare, frequent = max(CLASSES[0][0], 4 * median), max(CLASSES[1][0], 128 * median)
        self.classes = ((rare, *CLASSES[0][1:]), (frequent, *CLASSES[1][1:]), CLASSES[2])
        self.small_classes = ((rare, *SMALL_CLASSES[0][1:]), SMALL_CLASSES[1])

        def fullest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    cell, n = _unpacked(value)
                    full = n >= 2**least
                    yield pa.RecordBatch.from_arrays([pa.array(cell[full].astype(np.int64) + r * part), pa.array(n[full])], names=["cell", "n"])

        full = cells.select("range", "cells").mapInArrow(fullest, "cell bigint, n bigint").toArrow()
        self.slots = np.zeros(SLOTS, dtype=np.uint32)
        np.maximum.at(self.slots, full.column("cell").to_numpy() % SLOTS, np.minimum(full.column("n").to_numpy(), 2**32 - 1).astype(np.uint32))

    def __getstate__(self) -> tuple:
        """Packed: each worker's machine gets a copy on its disk."""
        return self.classes, self.small_classes, _packed(self.bits, self.slots)

    def __setstate__(self, state: tuple) -> None:
        self.classes, self.small_classes, packed = state
        self.bits, self.slots = _unpacked(packed)

    def counts(self, grams: np.ndarray) -> np.ndarray:
        cell = np.mod(grams, CELLS)
        shared = (self.bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)
        return np.where(shared > 0, np.maximum(2, self.slots[cell % SLOTS].astype(np.int64)), 1)

    def signed(self, grams: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        return all_signatures(grams, sizes, self.counts(grams), threshold, self.classes, self.small_classes)


def rounds_and_ranges(entries: float, sets: int, held: int, tasks: int) -> tuple[int, int]:
    """In how many rounds the signatures are dealt out, and over how many tasks in each, so that no round writes much more than ROUND times the bytes that the blocks hold, or LEAST bytes, and no task
    gets much more than ENTRIES signatures. Only the cost hangs on it."""
    for rounds in range(1, MOST_ROUNDS + 1):
        each = entries / rounds
        ranges = max(1, math.ceil(each / ENTRIES), min(tasks, math.ceil(each / 100_000)))
        # a set's sketch goes once to each task that has a signature of it
        met = ranges * (1 - (1 - 1 / ranges) ** (each / max(1, sets))) if ranges > 1 else 1
        if sets * met * (12 + 8 * LONGS) + 5 * each <= max(LEAST, ROUND * held):
            break
    return rounds, ranges


def _met(starts: np.ndarray, held: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of `who`, in portions of at most about PORTION."""
    for n in np.unique(held).tolist():
        at = starts[held == n]
        if n * (n - 1) // 2 > PORTION:
            for s in at.tolist():
                step = max(1, PORTION // n)
                for i in range(0, n, step):
                    x, y = np.meshgrid(np.arange(i, min(n, i + step)), np.arange(i, n), indexing="ij")
                    yield who[s + x[x < y]], who[s + y[x < y]]
            continue
        x, y = np.triu_indices(n, 1)
        step = max(1, PORTION // len(x))
        for i in range(0, len(at), step):
            some = at[i : i + step, None]
            yield who[some + x].ravel(), who[some + y].ravel()


def candidates(blocks: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b), a < b: the pairs of sets that share a signature and that their sizes and bitmaps allow. Signatures are dealt out by their value in rounds, each of which makes those of its own values only and
    deletes what it wrote before the next."""
    spark = blocks.sparkSession
    f = Frequency(blocks, width)
    first = blocks.select("words").first()
    held, sets = blocks.agg(F.sum(F.length("words")), F.sum(F.size("sids"))).first()
    each = 0.0
    if first:
        _, grams, sizes = block_sets(bytes(first.words), width)
        sizes = sizes[:SAMPLE]
        each = len(f.signed(grams[: sizes.sum()], sizes, threshold)[0]) / len(sizes)
    rounds, ranges = rounds_and_ranges(each * (sets or 0), sets or 0, held or 0, cores(spark))
    frequency = spark.sparkContext.broadcast(f)
    share = (1 - threshold) / (1 + threshold)

    def sign(now: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in b.column(0).to_pylist():
                    sids, grams, sizes = block_sets(block, width)
                    longs = parity(grams, sizes)
                    sig, rec = frequency.value.signed(grams, sizes, threshold)
                    # 40 of the bits are kept: fewer never lose a pair
                    sig = sig.view(np.uint64) >> np.uint64(24)
                    mine = sig % rounds == now
                    sig, rec = sig[mine] // rounds, rec[mine]
                    order = np.argsort(sig, kind="stable")
                    sig, rec = sig[order], rec[order]
                    where = sig % ranges
                    for r in range(ranges):
                        there = where == r
                        if there.any():
                            who, local = np.unique(rec[there], return_inverse=True)
                            steps = np.diff(sig[there] // ranges, prepend=np.uint64(0))
                            packed = _packed(sids[who], sizes[who], longs[who].ravel(), steps, local.astype(np.uint16 if len(who) <= 1 << 16 else np.uint32))
                            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed], pa.binary())], names=["range", "signed"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = [], 0
        for b in batches:
            for value in b.column(1).to_pylist():
                sids, sizes, longs, steps, local = _unpacked(value)
                parts.append((sids, sizes, longs.reshape(-1, LONGS), np.cumsum(steps), local.astype(np.int32) + before))
                before += len(sids)
        if not parts:
            return
        sids, sizes, longs, sig, who = (np.concatenate(x) for x in zip(*parts))
        del parts
        # a set that several blocks have is one; the sets are numbered by size
        sids, one, same = np.unique(sids, return_index=True, return_inverse=True)
        rising = np.argsort(sizes[one], kind="stable")
        place = np.empty(len(sids), dtype=np.int64)
        place[rising] = np.arange(len(sids))
        sids, sizes, longs, who = sids[rising], sizes[one][rising], np.ascontiguousarray(longs[one][rising].T), place[same][who]
        if len(sids) < 1 << 24:  # both fit one number
            both = np.sort(sig << np.uint64(24) | who.astype(np.uint64))
            sig, who = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        else:
            order = np.lexsort((who, sig))
            sig, who = sig[order], who[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])))
        sig, who = sig[new], who[new]
        starts = _starts(sig)
        held = np.diff(starts)
        several = held > 1
        least = threshold * sizes - 1e-9
        found, total = [], 0
        for x, y in _met(starts[:-1][several], held[several], who):
            near = sizes[x] >= least[y]
            x, y = x[near], y[near]
            apart = np.zeros(len(x), dtype=np.int64)
            for k in range(LONGS):
                apart += np.bitwise_count(longs[k][x] ^ longs[k][y])
                if k in (LONGS // 2, LONGS - 1):
                    near = apart <= share * (sizes[x] + sizes[y]) + 1e-9
                    x, y, apart = x[near], y[near], apart[near]
            found.append(x * len(sids) + y)
            total += len(x)
            if total > ENTRIES:
                found = [np.unique(np.concatenate(found))]
                total = len(found[0]) // 2
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        for i in range(0, len(pairs), PORTION):
            x, y = sids[pairs[i : i + PORTION] // len(sids)], sids[pairs[i : i + PORTION] % len(sids)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    met = None
    for now in range(rounds):
        dealt = blocks.select("words").mapInArrow(sign(now), "range int, signed binary").repartitionById(ranges, F.col("range"))
        some = cut(dealt.mapInArrow(meet, "a bigint, b bigint").distinct())
        met = some if met is None else met.unionByName(some)
    return met.distinct()


def similar_sets(blocks: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b, similarity) of every two sets of the blocks at or over the threshold, a < b: the candidates whose words, joined to them a part of the candidates after the other, are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams(text: str) -> set[tuple[str, ...]]:
            words = text.split(" ")
            return {*zip(*(words[j:] for j in range(width)))}

        for b in batches:
            a, other, similarity, last, ga = [], [], [], None, set()
            for x, y, tx, ty in zip(*(c.to_pylist() for c in b.columns)):
                if x != last:  # rows come sorted by a
                    last, ga = x, grams(tx)
                gb = grams(ty)
                both = len(ga & gb)
                total = len(ga) + len(gb)
                if both >= threshold * (total - both) - 1e-9:
                    a.append(x)
                    other.append(y)
                    similarity.append(both / (total - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64()), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    pairs = cut(candidates(blocks, threshold, width))
    held, sets = blocks.agg(F.sum(F.length("words")), F.sum(F.size("sids"))).first()
    # a text weighs about twice as much in a shuffle as in its block
    parts = max(1, math.ceil(2 * pairs.count() * (held or 0) / (sets or 1) / max(LEAST, ROUND * (held or 0) / 2)))
    texts = each_text(blocks).groupBy("sid").agg(F.first("words").alias("words"))
    similar = None
    for now in range(parts):
        here = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == now if parts > 1 else F.lit(True)  # noqa: B023, E731
        with_b = pairs.where(here("a")).join(merged(texts.select(F.col("sid").alias("b"), F.col("words").alias("wb"))), "b")
        whole = with_b.join(merged(texts.where(here("sid")).select(F.col("sid").alias("a"), F.col("words").alias("wa"))), "a")
        some = cut(whole.select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint, similarity double"))
        similar = some if similar is None else similar.unionByName(some)
    return similar


def near_duplicates(records: DataFrame, key: str, text: Column, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership (key, sid): which set of shingles each record has; and the similar sets (a, b, similarity)."""
    with released(records.sparkSession):
        blocks = cut(word_blocks(records, key, text, width))
        members = blocks.select(F.explode(F.arrays_zip("keys", "sids")).alias("r")).select(F.col("r.keys").alias("key"), F.col("r.sids").alias("sid")).distinct()
        return cut(members), similar_sets(blocks, threshold, width)


def _name_and_text() -> Column:
    return F.concat(F.coalesce("entity_name", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


def near_duplicate_pairs(chunks: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """Each pair of different chunk ids whose name and text are similar, the smaller id first. The pairs within a large group of equal sets, which its
    size bounds from below, are dealt over tasks by salt."""
    members, similar = near_duplicates(chunks.where(F.col("chunk_id").isNotNull()), "chunk_id", _name_and_text(), threshold, width)
    often = members.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = members.join(merged(often), "sid")
    one, other = copies.select("sid", F.col("key").alias("x"), "n").select("sid", "x", salt.alias("salt")), copies.select("sid", F.col("key").alias("y"), F.explode(salts).alias("salt"))
    within = one.join(merged(other), ["sid", "salt"]).where("x < y").select("x", "y")
    left, right = members.select(F.col("key").alias("x"), F.col("sid").alias("a")), members.select(F.col("key").alias("y"), F.col("sid").alias("b"))
    across = similar.join(merged(left), "a").join(merged(right), "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return across.unionByName(within).distinct().select(F.col("x").alias("chunk_a"), F.col("y").alias("chunk_b"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the links (a, b) with the least node that links lead to. Links are turned in turn towards the least neighbour of
    their larger and of their smaller end, which takes about log(nodes) rounds; each round is written to the checkpoint folder and no node's links are gathered in one row."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low), "u")
        edges = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links do not settle; give more rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicate_groups(chunks: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """(chunk_id, classe, ligacoes): every chunk id, the least id of its group, and how many other ids it is similar to. Groups are what similar chunks
    connect; copies are counted by their set, never paired. A chunk that is similar to none is its own class."""
    rows = chunks.where(F.col("chunk_id").isNotNull())
    members, similar = near_duplicates(rows, "chunk_id", _name_and_text(), threshold, width)
    size = cut(members.groupBy("sid").agg(F.count("*").alias("n"), F.min("key").alias("least")))
    ways = similar.select(F.col("a").alias("sid"), F.col("b").alias("o")).unionByName(similar.select(F.col("b").alias("sid"), F.col("a").alias("o")))
    linked = ways.join(merged(size.select(F.col("sid").alias("o"), F.col("n").alias("k"))), "o").groupBy("sid").agg(F.sum("k").alias("k"))
    named = members.join(merged(size.join(merged(linked), "sid", "left").select("sid", "least", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("k"))), "sid")
    firsts = size.select("sid", "least")
    ends = similar.join(merged(firsts.select(F.col("sid").alias("a"), F.col("least").alias("x"))), "a").join(merged(firsts.select(F.col("sid").alias("b"), F.col("least").alias("y"))), "b")
    links = ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(named.select(F.col("key").alias("a"), F.col("least").alias("b")))
    group = components(links)
    return (
        rows.select("chunk_id").distinct()
        .join(merged(group.withColumnRenamed("node", "chunk_id")), "chunk_id", "left")
        .join(merged(named.groupBy(F.col("key").alias("chunk_id")).agg(F.sum("k").alias("k"))), "chunk_id", "left")
        .select("chunk_id", F.coalesce("root", "chunk_id").alias("classe"), F.coalesce("k", F.lit(0)).cast("bigint").alias("ligacoes"))
    )
