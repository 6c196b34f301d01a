"""Near-duplicate texts by a size-aware heavy-light join on sets of word shingles.

The similarity of two texts is the Jaccard coefficient of their sets of shingles. All sets are ordered by one global
order, rare shingles first (counts come from a fixed-size sketch over the whole collection; any total order keeps the
join complete, a good one keeps it cheap). Two sets of similarity ``t`` then share a shingle among the first
``n - ceil(t n) + 1`` of each, and two shingles among the first ``n - ceil(t n) + 2``.

* *light* (small) sets enumerate the pairs of shingles in that longer prefix: a pair is shared by hardly anything but
  near-duplicates. Pairs are first counted in a table of two bits each, and only those are listed that another set may
  have too;
* *heavy* (large) sets, whose pairs would be too many, scan the inverted lists of their prefix, against heavy and
  light sets alike. So do sets so small that one shared shingle is enough.

The boundary between them is where both cost the same, by the counts of the collection: a pair costs little more than
a candidate, so light sets pay where lists are long, and the boundary grows with the collection until their pairs fill half of the table. Lists are joined with
exact filters on size, position and a parity bitmap (its distance never exceeds that of the sets), so that hardly a
candidate is left that isn't a result, and every candidate is then checked on the full sets. Texts with equal words
are one class throughout; classes are linked, members never expanded. A list of more than ``GRID`` is joined as a grid
of blocks. Nothing is sampled, capped or dropped: shingles that occur in one set only are left out of the lists, as they
can't be shared. Texts are read once, into 32-bit hashes of their words, which are written and read by all later steps.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import connected_components
from brindle.session import cut_lineage, release_shuffles, written

WORD = re.compile(r"[^\W_]+")
#: Counters of the sketch: two rows of 2**BITS; their size, one byte each when broadcast, doesn't grow with the data.
BITS = 22
BLOCK = 1 << 16
#: Bytes of a shingle's hash that are sent for the final comparison: by chance alike once in 2**40 / (n * m).
PACKED = 5
#: Slots of the table that tells which pairs occur again: two bits each, whatever the collection.
PAIR_BITS = 24
#: Pairs of shingles that light sets may have in all: half of the table, so that few fall on one slot by chance.
MOST_PAIRS = 1 << (PAIR_BITS - 1)
#: Postings of a list that are joined as one block, by its count.
GRID = 4_096
#: Pairs that a task holds at once, of shingles as of candidates, and rows that it gives at once.
HELD, GIVEN = 500_000, 100_000
#: Words whose lists are made in one pass, and candidates that meet their wide bitmaps in one; more take more passes, so
#: that the disk doesn't hold all of them at once.
PASS_WORDS, PASS_PAIRS, MOST_PASSES = 60_000_000, 4_000_000, 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """32-bit hashes of words, kept up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFF
        return h


def _shingles(parts: list[int], words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each shingle, in order of the texts, with repeats."""
    n = np.array([len(w) for w in words])
    h = np.concatenate(words).astype(np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the end of the text
    at = np.flatnonzero(left >= width)
    s = np.array(parts, np.int64).astype(np.uint64)[text[at]]  # so that nothing is shared between collections
    with np.errstate(over="ignore"):
        for k in range(width):
            s = _mix(s + h[at + k] * _M2 + _M3)
    return text[at], s


def _once(text: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Which of sorted rows differ from the one before."""
    new = text[1:] != text[:-1]
    for x in rest:
        new |= x[1:] != x[:-1]
    return np.concatenate([np.ones(min(1, len(text)), bool), new])


def _texts(batches: Iterator[pa.RecordBatch], most_words: int = 500_000) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """(keys, parts, words) of the written texts, in blocks of about ``most_words``."""
    keys, parts, words, held = [], [], [], 0
    for batch in batches:
        for key, part, data in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "words"))):
            keys.append(key)
            parts.append(part)
            words.append(np.frombuffer(data, np.uint32))
            held += len(words[-1])
            if held > most_words:
                yield keys, parts, words
                keys, parts, words, held = [], [], [], 0
    if keys:
        yield keys, parts, words


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(64 - bits)) & low).astype(np.int64)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class _Counter:
    """Adds up hashes in two rows of counters; gives the non-zero blocks."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, np.zeros((2, 1 << bits), np.uint16)

    def add(self, h: np.ndarray) -> None:
        for row, at in zip(self.rows, _slots(h, self.bits)):
            at, n = np.unique(at, return_counts=True)
            row[at] = np.minimum(row[at].astype(np.int64) + n, 65535)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        flat = self.rows.reshape(-1)
        for no, start in enumerate(range(0, len(flat), BLOCK)):
            if flat[start : start + BLOCK].any():
                yield no, zlib.compress(flat[start : start + BLOCK].astype(np.uint32).tobytes(), 1)


class _Twice:
    """Whether a hash was met never, once or more often, in one table of fixed size; gives the blocks that aren't empty."""

    def __init__(self):
        self.table = np.zeros(1 << PAIR_BITS, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(_pair_slots(h), return_counts=True)
        self.table[at] = np.minimum(self.table[at] + n, 2)

    blocks = lambda self: _Counter.blocks(self)
    rows = property(lambda self: self.table)


def _pair_slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _sum_blocks(blocks: DataFrame, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, sums) of ``block, task, data`` over all tasks, summed as a tree: no group has more than 64 blocks."""

    def add(keys, pdf):
        import pandas as pd

        total = np.zeros(min(BLOCK, length), np.uint64)
        for data in pdf["data"]:
            total += np.frombuffer(zlib.decompress(data), np.uint32)
        return pd.DataFrame({"block": [keys[0]], "task": [keys[1]], "data": [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)]})

    tasks = (blocks.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        blocks = blocks.groupBy("block", F.expr("cast(task div 64 as int)").alias("task")).applyInPandas(add, "block int, task int, data binary")
        tasks = -(-tasks // 64)
        if tasks == 1:
            break
    for r in blocks.toLocalIterator():
        yield r.block * BLOCK, np.frombuffer(zlib.decompress(r.data), np.uint32)


def _merge_counters(blocks: DataFrame, bits: int) -> np.ndarray:
    """The counters over all tasks as codes of one byte (0, 1 exact; then 8 steps per doubling). Fixed size: 2**(bits+1) bytes."""
    out = np.zeros(2 << bits, np.uint8)
    for start, total in _sum_blocks(blocks, 2 << bits):
        out[start : start + len(total)] = np.where(total < 2, total, np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))))
    return out.reshape(2, 1 << bits)


def _merge_twice(blocks: DataFrame) -> np.ndarray:
    """One bit per slot: whether any two sets, of whatever tasks, have a pair there. Fixed size: 2**(PAIR_BITS-3) bytes."""
    out = np.zeros(1 << PAIR_BITS, bool)
    for start, total in _sum_blocks(blocks, 1 << PAIR_BITS):
        out[start : start + len(total)] = total > 1
    return np.packbits(out)


def _emitter(make) -> object:
    """A map of batches to the blocks of what ``make`` gives for them, with the number of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for no, data in make(batches).blocks():
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([task], pa.int32()), pa.array([data])], names=["block", "task", "data"])

    return run


_BLOCKS = "block int, task int, data binary"


def _codes(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _slots(h, bits)
    return np.minimum(table[0][a], table[1][b])


def _packed(s: np.ndarray) -> bytes:
    """The low bytes of the hashes: what is enough to tell the shingles of two texts apart."""
    return s.view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // PACKED, 8), np.uint8)
    out[:, :PACKED] = np.frombuffer(data, np.uint8).reshape(-1, PACKED)
    return out.view(np.uint64).reshape(-1)


def _prefix_length(n: int, t: Fraction) -> int:
    return n - -(-(n * t.numerator) // t.denominator) + 1


def choose_boundary(list_length: float, t: Fraction, pair_cost: float = 1.5) -> int:
    """The largest size of a light set.

    Enumerating costs ``pair_cost`` per pair of the longer prefix (to count it, and to list it if it occurs again), scanning a
    candidate for half the list of each shingle of the prefix.
    """
    size = 1
    while size < 100_000:
        p = _prefix_length(size + 1, t)
        if (p + 1) * p / 2 * pair_cost > p * list_length / 2:
            return size if size > 1 else 0
        size += 1
    return size


def bounded_by_pairs(boundary: int, sets: dict[int, int], t: Fraction, most: int = MOST_PAIRS) -> int:
    """The boundary, lowered so far that light sets have at most ``most`` pairs; ``sets``: how many there are, by size.

    In a full table every pair seems to occur again, and all of them, by the square of the prefix, would be listed.
    """
    for size in sorted(sets):
        p = max(0, _prefix_length(size, t))
        most -= sets[size] * (p + 1) * p // 2
        if most < 0:
            return max(0, min(boundary, size - 1))
    return boundary


def expected_list(table: np.ndarray, t: Fraction) -> float:
    """The mean length of the lists that prefixes meet, by the counts of all shingles.

    Prefixes hold the rarer part of each set's shingles, so the rarer part of all occurrences, of what occurs more than
    once. What other shingles add to a counter by chance is taken off.
    """
    c = np.exp2(table[0][table[0] > 0] / 8.0)
    met = np.sort(np.maximum(1.0, c - c.sum() / table.shape[1]))
    mass = np.cumsum(met)
    low = met[mass <= mass[-1] * float(1 - t)] if len(met) else met
    low = low[low > 1]
    return float((low * low).sum() / low.sum()) if len(low) else 1.0


def _ordered(codes: np.ndarray, parts: list[int], words: list[np.ndarray], width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, code) of the distinct shingles, per text in the global order: by count, then by hash."""
    text, h = _shingles(parts, words, width)
    code = _codes(codes, h, bits)
    order = np.lexsort((h, text * 256 + code))
    text, h, code = text[order], h[order], code[order]
    once = _once(text, h)
    return text[once], h[once], code[once]


def _expanded(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, later row): each row with each of the ``counts`` rows that follow it, in slices of about ``HELD``."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - counts[start] + HELD, "right")))
        n = counts[start:stop]
        row = np.repeat(np.arange(start, stop), n)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + row + 1
        start = stop


def _pairs_of(at: np.ndarray, text: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, second place, hash) of all pairs of the places ``at`` within each text, in slices of about ``HELD``."""
    own = text[at]
    for first, second in _expanded(np.searchsorted(own, own, "right") - np.arange(len(own)) - 1):
        with np.errstate(over="ignore"):
            yield at[first], at[second], _mix(_mix(h[at[first]]) + h[at[second]])


def _gridded(h: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): rows of long lists once for each cell of the grid that their block is in; any two blocks share one cell."""
    m = np.maximum(1, np.ceil(length / GRID)).astype(np.int64)
    row = np.repeat(np.arange(len(h)), m)
    if len(row) == len(h):
        return row, h
    other = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    mine = ((_mix(key) >> np.uint64(8)) % m.astype(np.uint64)).astype(np.int64)[row]
    cell = np.minimum(mine, other) * m[row] + np.maximum(mine, other)
    with np.errstate(over="ignore"):
        return row, np.where(m[row] > 1, _mix(h[row] + (cell.astype(np.uint64) + np.uint64(1)) * _M2), h[row])


def _bitmaps(text: np.ndarray, s: np.ndarray, n: int, width: int = 256) -> np.ndarray:
    """Per text, the parity of how many of its distinct shingles fall on each of ``width`` bits, as 64-bit numbers."""
    at = text * width + (s >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * width) & 1).astype(np.uint8)).view(np.int64).reshape(n, width // 64)


def _most_mapped(t: Fraction) -> int:
    """The largest set whose bitmap of 256 bits tells anything: in larger ones more may differ than the 128 that do by chance (160 at most)."""
    return 80 * (t.numerator + t.denominator) // (t.denominator - t.numerator) if t < 1 else 1 << 30


def _map_width(n: int) -> int:
    """Bits of the wide bitmap of a set of ``n`` shingles: at least three for each."""
    return max(1024, 1 << (3 * n - 1).bit_length())


def _map_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Distances of bitmaps, each pair at the narrower width: a parity bitmap is folded by adding its halves."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)])
    for pair in np.unique(sizes, axis=0) if len(a) else ():
        at = np.flatnonzero((sizes == pair).all(1))
        both = [np.frombuffer(b"".join(m[k] for k in at), np.uint64).reshape(len(at), -1) for m in (a, b)]
        least = min(x.shape[1] for x in both)
        for k, x in enumerate(both):
            while x.shape[1] > least:
                half = x.shape[1] // 2
                x = x[:, :half] ^ x[:, half:]
            both[k] = x
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(1)
    return out


def _near_in_lists(h: np.ndarray, key: np.ndarray, place: np.ndarray, maps: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller key, larger key) within the lists of sorted postings that the filters on size, position and bitmap leave."""
    num, den = t.numerator, t.denominator
    no = np.cumsum(_once(h)) << np.int64(32)
    size, kind = place >> np.int64(32), place & 3
    # a pair's place says nothing on what else is shared
    rest = np.where(kind == 2, size, size - (place >> np.int64(2) & (1 << 28) - 1))
    last = np.searchsorted(no | size, no | np.minimum(size * den // num, (1 << 32) - 1), "right")
    for a, b in _expanded(last - np.arange(len(h)) - 1):
        # pairs of light sets meet pairs only; two single shingles count unless both sets are light
        keep = ((kind[a] ^ kind[b]) & 2 == 0) & (kind[a] | kind[b] != 0) & (key[a] != key[b])
        both = size[a] + size[b]
        keep = np.flatnonzero(keep & ((num + den) * np.minimum(rest[a], rest[b]) >= num * both))
        a, b, both = a[keep], b[keep], both[keep]
        keep = (np.maximum(size[a], size[b]) > _most_mapped(t)) | ((num + den) * (both - np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)) >= 2 * num * both)
        a, b = key[a[keep]], key[b[keep]]
        if len(a):
            yield np.minimum(a, b), np.maximum(a, b)


def _candidate_pairs(postings: DataFrame, t: Fraction, partitions: int) -> DataFrame:
    """Scans the inverted lists; ``key_a, key_b`` of the pairs that the filters on size, position and bitmap leave."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, key, place, *maps = columns
            for a, b in _near_in_lists(h, key, place, np.stack(maps, 1).view(np.uint64), t):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["key_a", "key_b"])

        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            rows += batch.num_rows
            if rows >= GIVEN:
                columns = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
                yield from pairs([x[:whole] for x in columns])
                held, rows = [[x[whole:] for x in columns]], rows - whole
        if held:
            yield from pairs([np.concatenate(x) for x in zip(*held)])

    # a place begins with the size, so a list comes in the order of size
    listed = postings.repartition(partitions, "h").sortWithinPartitions("h", "place")
    return cut_lineage(listed.mapInArrow(scan, "key_a long, key_b long").distinct())


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, part_col: str | None = None, similarity: str = "0.8", width: int = 5, least_words: int = 30, boundary: int | None = None, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """``members (key, id)`` and ``links (key_a, key_b, n_shared, n_all)``, key_a < key_b.

    A class (key) holds the records whose words are the same, in order; links join classes whose sets of ``width``
    consecutive words (lower case, runs of letters and digits) have a Jaccard coefficient of at least ``similarity``.
    Records of different ``part_col`` (an int) are never linked. Null and empty texts, texts under ``least_words`` words
    and null ids have no class. Repeated rows give one member; an id with two texts is a member of two classes. An empty
    table gives no rows. Other columns aren't read. ``boundary`` overrides the size up to which sets are light (0: all
    heavy); it changes the cost, not the result.
    """
    t = Fraction(similarity)
    if not 0 < t <= 1:
        raise ValueError("similarity must be in (0, 1]")
    context = df.sparkSession.sparkContext
    part = F.coalesce(F.col(part_col).cast("int"), F.lit(0)) if part_col else F.lit(0)
    rows = df.select(part.alias("part"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # a text of n words has at least 2 n - 1 characters
    rows = rows.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text; its words go with the first text of a class that the task remembers."""
        known, seen = _Words(), set()
        for batch in batches:
            keys, parts, ids, data = [], [], [], []
            for p, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "text"))):
                words = WORD.findall(text.lower())
                if len(words) < least_words:
                    continue
                h = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                mark = xxhash.xxh3_64_intdigest(h.data, seed=p % (1 << 32))
                new = mark not in seen
                if new and len(seen) < 200_000:
                    seen.add(mark)
                for column, x in zip((keys, parts, ids, data), (mark, p, key, h.tobytes() if new else None)):
                    column.append(x)
            columns = [_as_long(np.array(keys, np.uint64)), parts, ids, data]
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(columns, types[3:])], names=names[3:])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, the first of a class keeps its words, whatever tasks have read others; its shingles are counted."""
        sketch, last = _Counter(bits), None
        for batch in batches:
            key = batch.column("key").to_numpy()
            first = _once(key)
            first[:1] = key[:1] != last
            last, first = key[-1] if len(key) else last, pa.array(first)
            for _, parts, words in _texts(iter([batch.filter(first)])):
                text, h = _shingles(parts, words, width)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                sketch.add(h[_once(text, h)])
            none = [pa.nulls(len(key), ty) for ty in types[:3]]
            words = pc.if_else(first, batch.column("words"), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*none, *(batch.column(c) for c in names[3:6]), words], names=names)
        task = TaskContext.get().partitionId()
        for no, block in sketch.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip((no, task, block, None, None, None, None), types)], names=names)

    names, types = ["block", "task", "data", "key", "part", "id", "words"], [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
    shape = "key long, part int, id string, words binary"
    classed = rows.mapInArrow(read, shape).repartition("key").sortWithinPartitions("key", F.col("words").isNull())
    table = written(classed.mapInArrow(count, f"{_BLOCKS}, {shape}"))
    del classed
    release_shuffles(df.sparkSession)
    members = table.filter("key is not null").select("key", "id").distinct()
    texts = table.filter("words is not null").select("key", "part", "words")
    # so many postings that a partition of them stays small, whatever the session's number of partitions
    n = F.expr("octet_length(words) div 4")
    lengths = texts.groupBy(F.least(n, F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("texts"), F.sum(n).alias("words")).collect()
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (words := sum(r.words for r in lengths)) // 600_000)
    counted = _merge_counters(table.filter("block is not null").select("block", "task", "data"), bits)
    if boundary is None:
        boundary = bounded_by_pairs(choose_boundary(expected_list(counted, t), t), {r.n - width + 1: r.texts for r in lengths}, t)
    lone = t.denominator // t.numerator  # up to this size one shared shingle may be enough, so pairs would miss it
    sent = context.broadcast(counted)

    def prefixes(keys: list[int], parts: list[int], words: list[np.ndarray]) -> tuple:
        """Ordered shingles, sizes, places, prefix lengths, which sets are light, and the places that their pairs are made of."""
        text, h, code = _ordered(sent.value, parts, words, width, bits)
        size = np.bincount(text, minlength=len(keys))
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        p = size - -(-(size * t.numerator) // t.denominator) + 1
        light = (size <= boundary) & (size > lone)
        # a count of one: no other set has it
        return text, h, code, size, place, p, light, np.flatnonzero((code > 1) & light[text] & (place < p[text] + 1))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> _Twice:
        out = _Twice()
        for keys, parts, words in _texts(batches):
            text, h, *_, at = prefixes(keys, parts, words)
            for *_, both in _pairs_of(at, text, h):
                out.add(both)
        return out

    again = None
    if boundary > lone:
        again = context.broadcast(_merge_twice(texts.mapInArrow(_emitter(count_pairs), _BLOCKS)))

    def lists(batches: Iterator[pa.RecordBatch], no: int, passes: int) -> Iterator[pa.RecordBatch]:
        """Postings of the lists of one pass."""
        names = ["h", "key", "place", "b1", "b2", "b3", "b4"]
        for keys, parts, words in _texts(batches):
            text, h, code, size, place, p, light, at = prefixes(keys, parts, words)
            marks, maps = np.array(keys, np.int64), _bitmaps(text, h, len(keys))
            maps[size > _most_mapped(t)] = 0  # so that they take no room

            def rows(who: np.ndarray, hash_: np.ndarray, at_: np.ndarray, kind: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
                if passes > 1:
                    mine = (hash_ >> np.uint64(8)) % np.uint64(passes) == no
                    who, hash_, at_, kind, length = who[mine], hash_[mine], at_[mine], kind[mine], length[mine]
                # size, then position, then kind (0 light, 1 heavy, 2 pair of a light set) in one number
                packed = (np.minimum(size[who], 1 << 30).astype(np.int64) << np.int64(32)) | (np.minimum(at_, (1 << 28) - 1).astype(np.int64) << np.int64(2)) | kind.astype(np.int64)
                row, hash_ = _gridded(hash_, np.exp2(length / 8.0), marks[who].view(np.uint64))
                for k in range(0, len(row), GIVEN):
                    r = row[k : k + GIVEN]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_as_long(hash_[k : k + GIVEN]), marks[who[r]], packed[r], *maps[who[r]].T)], names=names)

            single = (code > 1) & (place < p[text]) & (~light | (size * t.denominator >= boundary * t.numerator) | (size * t.numerator <= lone * t.denominator))[text]
            yield from rows(text[single], h[single], place[single], np.where(light, 0, 1)[text[single]], code[single])
            for first, second, both in _pairs_of(at, text, h) if again is not None else ():
                slot = _pair_slots(both)
                met = (again.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
                first, second, both = first[met], second[met], both[met]
                yield from rows(text[first], both, place[first], np.full(len(first), 2), np.minimum(code[first], code[second]))

    passes = 1 if words <= PASS_WORDS else 2
    found = []
    for no in range(passes):
        found.append(_candidate_pairs(texts.mapInArrow(functools.partial(lists, no=no, passes=passes), "h long, key long, place long, b1 long, b2 long, b3 long, b4 long"), t, partitions))
        release_shuffles(df.sparkSession)
    pairs = found[0] if passes == 1 else cut_lineage(functools.reduce(DataFrame.union, found).distinct())
    del found
    release_shuffles(df.sparkSession)

    def mark_keys(batches: Iterator[pa.RecordBatch]) -> _Counter:
        sketch = _Counter(bits)
        for batch in batches:
            sketch.add(_mix(batch.column("key").to_numpy().view(np.uint64)))
        return sketch

    keys = pairs.select(F.col("key_a").alias("key")).union(pairs.select("key_b"))
    wanted = context.broadcast(_merge_counters(keys.mapInArrow(_emitter(mark_keys), _BLOCKS), bits) > 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size, wide bitmap and full set of the classes that are candidates (and of a few that only look like it)."""
        for keys, parts, words in _texts(batches):
            asked = np.flatnonzero(_codes(wanted.value, _mix(np.array(keys, np.int64).view(np.uint64)), bits))
            if len(asked):
                text, h = _shingles([parts[k] for k in asked], [words[k] for k in asked], width)
                order = np.lexsort((h, text))
                once = _once(text[order], h[order])
                text, h = text[order][once], h[order][once]
                found = np.split(h, np.searchsorted(text, np.arange(1, len(asked))))
                maps = [_bitmaps(np.zeros(len(x), np.int64), x, 1, _map_width(len(x))).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.int64)[asked]), pa.array([len(x) for x in found], pa.int32()), pa.array(maps), pa.array([_packed(x) for x in found])],
                    names=["key", "n", "map", "s"],
                )

    full = cut_lineage(texts.mapInArrow(sets, "key long, n int, map binary, s binary").repartition(partitions, "key").dropDuplicates(["key"]))
    release_shuffles(df.sparkSession)
    maps = lambda x: full.select(F.col("key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"m_{x}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same bound as by the bitmaps in the lists, on wider ones: shared <= (n_a + n_b - distance) / 2."""
        for batch in batches:
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            apart = _map_distances(batch.column("m_a").to_pylist(), batch.column("m_b").to_pylist())
            keep = pa.array((t.numerator + t.denominator) * (n - apart) >= 2 * t.numerator * n)
            yield pa.RecordBatch.from_arrays([batch.column("key_a").filter(keep), batch.column("key_b").filter(keep)], names=["key_a", "key_b"])

    passes, found = min(MOST_PASSES, pairs.count() // PASS_PAIRS + 1), []
    for no in range(passes):
        some = pairs.filter(F.pmod(F.hash("key_a", "key_b"), F.lit(passes)) == no) if passes > 1 else pairs
        mapped = some.join(maps("a"), "key_a").join(maps("b"), "key_b").select("key_a", "key_b", "n_a", "n_b", "m_a", "m_b")
        found.append(cut_lineage(mapped.mapInArrow(near, "key_a long, key_b long")))
        del some, mapped
        release_shuffles(df.sparkSession)
    pairs = functools.reduce(DataFrame.union, found)
    both = pairs.join(full.select(F.col("key").alias("key_a"), F.col("s").alias("s_a")), "key_a").join(full.select(F.col("key").alias("key_b"), F.col("s").alias("s_b")), "key_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, whole = [], []
            for a, b in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist()):
                shared.append(len(np.intersect1d(_unpacked(a), _unpacked(b), assume_unique=True)))
                whole.append((len(a) + len(b)) // PACKED - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column("key_a"), batch.column("key_b"), pa.array(shared, pa.int64()), pa.array(whole, pa.int64())], names=["key_a", "key_b", "n_shared", "n_all"])

    links = both.select("key_a", "key_b", "s_a", "s_b").mapInArrow(compare, "key_a long, key_b long, n_shared long, n_all long")
    return members, links.filter(f"{t.denominator} * n_shared >= {t.numerator} * n_all")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a < id_b`` of all pairs of records in one class or in linked classes."""
    a = members.select(F.col("key").alias("key_a"), F.col("id").alias("x"))
    b = members.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    within = a.join(b.withColumnRenamed("key_b", "key_a"), "key_a").filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    across = links.select("key_a", "key_b").join(a, "key_a").join(b, "key_b").filter("x <> y")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.union(across).distinct()


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, group_id, n_links``: every record with a class; groups are connected classes, named by their smallest id."""
    parts = connected_components(links.select("key_a", "key_b"))
    degree = links.select(F.col("key_a").alias("key")).union(links.select("key_b")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    own = members.join(parts.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left").withColumn("part", F.coalesce("component", "key"))
    names = own.groupBy("part").agg(F.min("id").alias("group_id"))
    return own.join(names, "part").groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"))
