"""Near-duplicate join on word-shingle sets (Jaccard), exact.

Universe-partition pigeonhole.  Documents are grouped in size bands of ratio
1 / threshold, so that two linked sets lie in one band or in neighbouring
ones.  In the group of the larger set's band, the universe of shingle hashes
is cut into ``m`` segments.  Sets x, y (x the larger) that link differ in at
most ``H(x) = floor(2 |x| (1 - t) / (1 + t))`` shingles, so when x relies on
any H(x) + 1 segments, y equals x in one of them; a segment that x relies on
with weight two may instead differ by one shingle.

* Index: every non-empty segment subset of every set, hashed.  ``m`` has
  slack, so x can leave out its empty and its costly segments (cost: the
  length of the segment's list after linked documents are taken as one).
* Lists of at most ``LIST`` sets give all their pairs.  Longer lists first
  give a star.  Sets with too many shingles that no other set of the lists
  has are out; then come further stars between parts not linked yet.
* A set whose slack does not cover its costly segments takes one-deletion
  neighbourhoods of its cheapest other segments of two shingles or more; where
  these are too few or cost more, it meets the sets that share one of its rarest shingles (a link
  has at least one of the n - ceil(t n) + 1 rarest) at a place, rarest first, with room for the
  whole intersection behind it in either set.
* Every candidate pair is verified on the two whole shingle sets.

Sets that are equal are one class from the start, so groups of copies are
never paired.  Links are found between classes, and none between different
sets is lost other than inside one component.  Shingles are 64-bit hashes;
a class is the pair (set size, 64-bit set hash).

Null or empty texts have the empty set and link with nothing; rows that
repeat a doc_id are judged one by one, each with its own text; a null doc_id
gets the smallest other doc_id of its component, or null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITMAP_BITS, bitmap, marked
from .components import components
from .spark import PART_BYTES, extend_batches, fresh, map_batches, parts, releasing, stored
from .text import SET_SALT, mix, set_key, shingle_sets

LIST = 12
STARS = 1
SKETCH = 8
BUCKET_ENTRIES = 500_000
#: Texts whose shingles become rows are handled in parts of about this size: a row takes several times the bytes of its words.
ROW_BYTES = 1 << 20
#: Sets of more shingles have a second sketch, as wide as they are large: in the first their parities even out.
WIDE = 512
#: The first test of the sets of unresolved lists looks at one in so many shingles.
SHARE = 3
OWN, NEEDY = 1, 2
SEGMENT_SALT = np.uint64(0xA0761D6478BD642F)


class Bands:
    """Size bands, segment counts and difference bounds of a threshold (in percent)."""

    def __init__(self, percent: int):
        self.percent = percent

    def edges(self, upto: int) -> list[int]:
        out = [1]
        while out[-1] <= upto:
            out.append(max(out[-1] + 1, -(-out[-1] * 100 // self.percent)))
        return out

    def of(self, n: int) -> tuple[int, int]:
        """Band number of size n, and the largest size in that band."""
        low, k = 1, 0
        while True:
            high = max(low + 1, -(-low * 100 // self.percent))
            if n < high:
                return k, high - 1
            low, k = high, k + 1

    def above(self, largest: int) -> int:
        """The largest size of the band after the one that ends at ``largest``."""
        low = largest + 1
        return max(low + 1, -(-low * 100 // self.percent)) - 1

    def differ(self, n: int) -> int:
        return 2 * n * (100 - self.percent) // (100 + self.percent)

    def linkable(self, n):
        """Whether a set of size n can link with a different one, of its own size or a larger one."""
        return (self.differ(n) > 0) | (n * 100 // self.percent > n)

    def segments(self, largest):
        base = self.differ(largest) + 1
        return base + -(-base // 10) + 2

    def table(self, sizes: np.ndarray):
        """For each size: band number, largest size of the band and of the band above."""
        edges = np.array(self.edges(int(sizes.max(initial=1)) * 2 + 4))
        band = np.searchsorted(edges, np.maximum(sizes, 1), "right") - 1
        return band, edges[band + 1] - 1, edges[band + 2] - 1

    def number(self, n, edges: list[int]):
        """Band number of the column n; -1 for empty sets."""
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda low: low <= n)) - 1

    def close(self, n, m):
        """Whether sizes n and m allow a link."""
        return np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent


def cut(shingles: np.ndarray, group: int, m: int):
    """Segments of a set in a group: (segment numbers, member lists bounds, values in segment order)."""
    where = (mix(shingles + np.uint64(group)) >> np.uint64(33)) % np.uint64(m)
    order = np.argsort(where.astype(np.int32), kind="stable")
    where = where[order]
    heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return where[heads], heads, mix(shingles[order] ^ SEGMENT_SALT)


def keys(numbers, sums, group: int) -> np.ndarray:
    return mix(sums + mix(numbers * np.uint64(0x100000001B3) + np.uint64(group << 32)))


def _by_parts(df: DataFrame, function, ddl: str, size: int = PART_BYTES) -> DataFrame:
    return map_batches(df, lambda batch: map(function, parts(batch, size)), ddl)


def _sets(batch: pa.RecordBatch, size: int):
    for shingles in shingle_sets(batch.column(batch.schema.get_field_index("text")), size):
        yield shingles, len(shingles), set_key(shingles)


def _chunks(batch: pa.RecordBatch, size: int, entries: int = 200_000):
    """The batch's sets in chunks: members of all sets, set bounds, class keys."""
    held, count = [], 0

    def chunk():
        sizes = np.array([len(x) for x in held])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        members = np.concatenate(held)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members ^ SET_SALT), dtype=np.uint64)))
        keys_ = mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64)
        return members, bounds, np.where(sizes > 0, keys_, 0)

    for shingles in shingle_sets(batch.column(batch.schema.get_field_index("text")), size):
        held.append(shingles)
        count += len(shingles)
        if count >= entries:
            yield chunk()
            held, count = [], 0
    if held:
        yield chunk()


def _segments(members: np.ndarray, bounds: np.ndarray, group: np.ndarray, m: np.ndarray):
    """Of sets cut into m segments in their group: each filled segment's set, number and hash."""
    sizes = np.diff(bounds)
    first = np.cumsum(m) - m
    where = (mix(members + np.repeat(group.astype(np.uint64), sizes)) >> np.uint64(33)) % np.repeat(m.astype(np.uint64), sizes)
    slot = np.repeat(first, sizes) + where.astype(np.int64)
    value = mix(members ^ SEGMENT_SALT)
    total = int(m.sum())
    # 64-bit sums from two exact sums of 32-bit halves
    low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    kept = np.flatnonzero(np.bincount(slot, minlength=total))
    owner = np.repeat(np.arange(len(m)), m)[kept]
    number = (kept - first[owner]).astype(np.uint64)
    sums = (low + (high << np.uint64(32)))[kept]
    return owner, number, mix(sums + mix(number * np.uint64(0x100000001B3) + (group[owner].astype(np.uint64) << np.uint64(32))))


def _parities(members: np.ndarray, bounds: np.ndarray, block: int = 1024) -> np.ndarray:
    """SKETCH words for each set: one bit for each of SKETCH * 64 parts of the universe, the parity of the set's members in it.

    Two sets differ in at least as many shingles as bits, which rules out pairs without their texts.
    """
    bits, sizes = 64 * SKETCH, np.diff(bounds)
    where = (mix(members ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(bits)).astype(np.int64)
    out = []
    for first in range(0, len(sizes), block):
        some = sizes[first: first + block]
        slot = np.repeat(np.arange(len(some)) * bits, some) + where[bounds[first]: bounds[first + len(some)]]
        out.append(np.packbits((np.bincount(slot, minlength=len(some) * bits) & 1).astype(bool)).view(np.int64))
    return np.concatenate(out).reshape(-1, SKETCH)


def _wide(members: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """For each set of more than WIDE shingles the parities of as many parts of the universe as it has members, rounded up to a power of two."""
    at, out = mix(members ^ np.uint64(0x8EBC6AF09C88C6E3)), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        bits = 1 << int(b - a - 1).bit_length() if b - a > WIDE else 0
        part = (at[a:b] & np.uint64(max(0, bits - 1))).astype(np.int64)
        out.append(np.packbits((np.bincount(part, minlength=bits) & 1).astype(bool)).tobytes() if bits else None)
    return out


def _apart(x: bytes, y: bytes) -> int:
    """In how many shingles at least two sets with these wide sketches differ; the wider one is folded."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def classes(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(doc_id, n_shingles, cls, needy, wide, s0, s1, ...): needy marks sets with fewer filled segments than their bound asks for; the s are the sketch."""
    def run(batch):
        n, c, needy, sketch, wide = [], [], [], [], []
        for members, bounds, cls in _chunks(batch, size):
            sizes = np.diff(bounds)
            band, largest, _ = bands.table(sizes)
            m = np.where(bands.differ(sizes) > 0, bands.segments(largest), 1)
            where = (mix(members + np.repeat(band.astype(np.uint64), sizes)) >> np.uint64(33)) % np.repeat(m.astype(np.uint64), sizes)
            first = np.cumsum(m) - m
            hit = np.bincount(np.repeat(first, sizes) + where.astype(np.int64), minlength=int(m.sum())) > 0
            filled = np.add.reduceat(hit.astype(np.int64), first) if len(m) else m
            n.append(sizes), c.append(cls), needy.append((bands.differ(sizes) > 0) & (filled < bands.differ(sizes) + 1))
            sketch.append(_parities(members, bounds)), wide.extend(_wide(members, bounds))
        words = np.concatenate(sketch)
        return {"doc_id": batch.column(0), "n_shingles": np.concatenate(n), "cls": np.concatenate(c), "needy": np.concatenate(needy), "wide": wide} | {
            f"s{i}": words[:, i] for i in range(SKETCH)}

    return _by_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, n_shingles long, cls long, needy boolean, wide binary, " + ", ".join(f"s{i} long" for i in range(SKETCH)))


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: of small numbers the high bytes take next to nothing when compressed."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


class Buckets:
    """Which bucket holds a segment's key.  Every group of sets has buckets of its own, as many as its entries fill, so a set's entries lie in few.

    ``shingles``: how many there are in the sets of each band.
    """

    def __init__(self, shingles: dict[int, int], edges: list[int]):
        last = max(shingles, default=0) + 1
        # a set makes some 0.3 entries a shingle, small sets more, in its band and as many in the next
        made = [shingles.get(g, 0) * min(1, 0.3 + 2 / edges[g]) for g in range(last)]
        self.count = [max(1, math.ceil((x + y) / BUCKET_ENTRIES)) for x, y in zip([*made, 0], [0, *made], strict=True)]
        self.first = [sum(self.count[:g]) for g in range(last + 1)]

    def of(self, key: np.ndarray, group: np.ndarray) -> np.ndarray:
        return (np.array(self.first)[group] + ((key >> np.uint64(32)) % np.array(self.count, np.uint64)[group]).astype(np.int64)).astype(np.int32)

    def named(self, key, group):
        """The bucket and the low 32 bits of a key in one long, as ``candidates`` names a list: two keys that meet only make its list longer."""
        first, count = (F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), group + 1) for xs in (self.first, self.count))
        return F.shiftleft(first + F.shiftrightunsigned(key, 32) % count, 32).bitwiseOR(key.bitwiseAND(F.lit(0xFFFFFFFF)))


def entries(docs: DataFrame, size: int, bands: Bands, buckets: Buckets, needy_bands: frozenset[int]) -> DataFrame:
    """The index as rows of packed arrays: (bucket, sig, cls, n, role); each class once per task.

    Of a key, its high half deals out the buckets of the group and its low half is sig; a set's entries stand together.
    """
    salts = 16

    def voids(group, m, owner, number, needy, cls):
        """Entries of empty segments in the bands of needy sets: a needy set meets all others that lack the segment too."""
        out = []
        for i in np.flatnonzero(np.isin(group, list(needy_bands))):
            empty = np.setdiff1d(np.arange(m[i], dtype=np.uint64), number[owner == i])
            salt = np.arange(salts, dtype=np.uint64) if needy[i] else np.array([int(cls[i]) % salts], dtype=np.uint64)
            out.append((i, keys(np.repeat(empty, len(salt)), np.tile(salt, len(empty)) + np.uint64(7), int(group[i]))))
        return out

    @releasing
    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("cls", pa.binary()), ("n", pa.binary()),
                            ("role", pa.binary())])
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in parts(whole)):
            sig, cls, n, role, at = [], [], [], [], []
            for members, bounds, key in _chunks(batch, size):
                sizes = np.diff(bounds)
                new = np.array([able and (k := (int(c), int(s))) not in seen and not seen.add(k)
                                for c, s, able in zip(key, sizes, bands.linkable(sizes), strict=True)], dtype=bool)
                members, key, sizes = members[np.repeat(new, sizes)], key[new], sizes[new]
                if not len(sizes):
                    continue
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                band, largest, above = bands.table(sizes)
                sorts = []
                for group, top, own in ((band, largest, OWN), (band + 1, above, 0)):
                    m = bands.segments(top)
                    owner, number, found = _segments(members, bounds, group, m)
                    needy = (np.bincount(owner, minlength=len(m)) < bands.differ(sizes) + 1) & (own == OWN)
                    sorts.append((owner, found, np.full(len(found), own, np.int8), group[owner]))
                    if needy_bands:
                        sorts += [(np.full(len(x), i), x, np.full(len(x), 4 | own | (NEEDY if needy[i] else 0), np.int8), np.full(len(x), group[i]))
                                  for i, x in voids(group, m, owner, number, needy, key)]
                who, x, kind, groups = (np.concatenate(y) for y in zip(*sorts, strict=True))
                order = np.argsort(who, kind="stable")
                who = who[order]
                sig.append(x[order]), cls.append(key[who]), n.append(sizes[who].astype(np.int32)), role.append(kind[order])
                at.append(buckets.of(x, groups)[order])
            if not sig:
                continue
            columns = [np.concatenate(x) for x in (sig, cls, n, role)]
            bucket = np.concatenate(at)
            columns[0] = columns[0].astype(np.uint32)
            order = np.argsort(bucket.astype(np.int16) if bucket.max() < 1 << 15 else bucket, kind="stable")
            bucket, columns = bucket[order], [x[order] for x in columns]
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(heads[1:], len(bucket))
            for first in range(0, len(heads), 64):
                pick = range(first, min(first + 64, len(heads)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[heads[first: first + 64]], pa.int32())]
                    + [pa.array([pack(c[heads[i]: ends[i]]) for i in pick], pa.binary())
                       for c, pack in zip(columns, (np.ndarray.tobytes, np.ndarray.tobytes, planes, np.ndarray.tobytes), strict=True)],
                    schema=schema)

    return docs.select("text").mapInArrow(run, "bucket int, sig binary, cls binary, n binary, role binary")


def unpack(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def unplane(table: pa.Table, name: str, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1).T.copy().view(kind)[:, 0] for x in table.column(name).to_pylist()])


def runs(values: np.ndarray):
    """Start and length of each run of equal neighbours."""
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return heads, np.diff(np.append(heads, len(values)))


def candidates(index: DataFrame, bands: Bands) -> DataFrame:
    """Per bucket: pairs of short lists and of stars (sig null), and the entries of long lists (b null)."""
    ddl = "a long, na int, b long, nb int, sig long"

    @releasing
    def run(table: pa.Table) -> pa.Table:
        sig, cls = unpack(table, "sig", np.uint32), unpack(table, "cls", np.int64)
        n, role = unplane(table, "n", np.int32), unpack(table, "role", np.int8)
        order = np.argsort(sig)
        s = sig[order]
        same = s[1:] == s[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((role[order], n[order], cls[order], sig[order]))]
        sig, cls, n, role = sig[order], cls[order], n[order], role[order]
        if len(sig):
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]) | (n[1:] != n[:-1])))
            sig, cls, n, role = sig[new], cls[new], n[new], role[new]
        heads, length = runs(sig)
        where, place = np.repeat(np.arange(len(heads)), length), np.arange(len(sig)) - np.repeat(heads, length)
        size = np.repeat(length, length)
        void = (role & 4) > 0
        left, right = [], []
        for step in range(1, LIST):
            i = np.flatnonzero((place + step < size) & (size <= LIST))
            left.append(i)
            right.append(i + step)
        star = np.flatnonzero((size > LIST) & (place > 0) & ~void)
        left.append(heads[where[star]])
        right.append(star)
        for i in np.flatnonzero(((role & NEEDY) > 0) & (size > LIST)):
            right.append(np.arange(heads[where[i]], heads[where[i]] + size[i]))
            left.append(np.full(size[i], i))
        i, j = np.concatenate(left).astype(int), np.concatenate(right).astype(int)
        keep = bands.close(n[i].astype(np.int64), n[j].astype(np.int64)) & (((role[i] | role[j]) & OWN) > 0)
        keep &= (cls[i] != cls[j]) | (n[i] != n[j])
        keep &= ~void[i] | (((role[i] | role[j]) & NEEDY) > 0)
        i, j = i[keep], j[keep]
        swap = (cls[i] > cls[j]) | ((cls[i] == cls[j]) & (n[i] > n[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([cls[i], n[i], cls[j], n[j]], axis=1), axis=0) if len(i) else np.zeros((0, 4), np.int64)
        long = np.flatnonzero((size > LIST) & ~void)
        none, nothing = np.zeros(len(long), np.int64), np.zeros(len(pairs), np.int64)
        lists = sig[long].astype(np.int64) | (table.column("bucket")[0].as_py() << 32)
        return pa.table({
            "a": np.concatenate([pairs[:, 0], cls[long]]), "na": np.concatenate([pairs[:, 1], n[long]]).astype(np.int32),
            "b": pa.array(np.concatenate([pairs[:, 2], none]), mask=np.arange(len(pairs) + len(long)) >= len(pairs)),
            "nb": np.concatenate([pairs[:, 3], none]).astype(np.int32),
            "sig": pa.array(np.concatenate([nothing, lists]),
                            mask=np.arange(len(pairs) + len(long)) < len(pairs))})

    return index.groupBy("bucket").applyInArrow(run, ddl)


def class_texts(docs: DataFrame, wanted: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(cls, n, text): one text of each wanted class (cls, n); texts of a class differ at most in blanks and case.

    A bitmap of fixed size tells the tasks which classes may be wanted, so
    that few other texts travel; the join decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("cls").alias("h"))))

    @releasing
    def run(batches):
        seen: set[tuple[int, int]] = set()
        schema = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows, c, m = [], [], []
            for at, (_, count, key) in enumerate(_sets(batch, size)):
                if bands.linkable(count) and marked(sent.value, key) and (count, key) not in seen:
                    seen.add((count, key))
                    rows.append(at), c.append(key), m.append(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), pa.array(m, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.string())],
                schema=schema)

    found = docs.select("text").mapInArrow(run, "cls long, n int, text string")
    return found.join(wanted, ["cls", "n"], "left_semi").groupBy("cls", "n").agg(F.min("text").alias("text"))


def _some(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may be of the classes ``sets(cls, ...)``, by a bitmap: joins need not shuffle all others."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(sets.select(F.col("cls").alias("h"))))

    @releasing
    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                bit = batch.column(0).to_numpy() & ((1 << BITMAP_BITS) - 1)
                yield batch.filter(pa.array((sent.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return texts.select("cls", "n", "text").mapInArrow(run, "cls long, n int, text string")


def _possible(percent: int):
    """Whether the sketches of a and b leave room for a link."""
    differ = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(1, SKETCH)),
                 F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _named(x: str, *more: str):
    return [F.col("cls").alias(x), F.col("n").alias(f"n{x}"), *(F.col(f"s{i}").alias(f"s{i}{x}") for i in range(SKETCH)),
            *(F.col(c).alias(f"{c}_{x}") for c in more)]


def _likely(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, na, b, nb) whose sketches leave room for a link."""
    pairs = stored(pairs.join(sketches.select(*_named("a")), ["a", "na"]).join(sketches.select(*_named("b")), ["b", "nb"])
                   .where(_possible(bands.percent)).select("a", "na", "b", "nb"))
    large = F.least("na", "nb") > WIDE

    def side(x):
        return sketches.where("wide is not null").select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"wide_{x}"))

    def check(batch):
        column = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
        total = column["na"].to_numpy().astype(np.int64) + column["nb"].to_numpy()
        differ = np.array([_apart(x, y) for x, y in zip(column["wide_a"].to_pylist(), column["wide_b"].to_pylist(), strict=True)], dtype=np.int64)
        keep = pa.array(differ * (100 + bands.percent) <= total * (100 - bands.percent))
        return {x: column[x].filter(keep) for x in ("a", "na", "b", "nb")}

    near = _by_parts(pairs.where(large).join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])
                     .select("a", "na", "b", "nb", "wide_a", "wide_b"), check, "a long, na int, b long, nb int")
    return pairs.where(~large).select("a", "na", "b", "nb").union(near)


def verify(texts: DataFrame, pairs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The stored pairs (a, na, b, nb) whose whole sets link, with the size of their intersection; each side gets its own texts only."""
    def side(x):
        return _some(texts, pairs.select(F.col(x).alias("cls"))).select(
            F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("text").alias(f"text_{x}"))

    def check(batch):
        left, right = (shingle_sets(batch.column(batch.schema.get_field_index(f"text_{x}")), size) for x in "ab")
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
        name = batch.schema.get_field_index
        na, nb = (batch.column(name(x)).to_numpy().astype(np.int64) for x in ("na", "nb"))
        common = np.array(both, dtype=np.int64)
        keep = pa.array(100 * common >= bands.percent * (na + nb - common))
        return {x: batch.column(name(x)).filter(keep) for x in ("a", "na", "b", "nb")} | {
            "common": pa.array(common).filter(keep)}

    joined = (pairs.join(side("b"), ["b", "nb"]).join(side("a"), ["a", "na"])
              .select("a", "na", "b", "nb", "text_a", "text_b"))
    return _by_parts(joined, check, "a long, na int, b long, nb int, common long")


def _members(texts: DataFrame, size: int, share: int = 1) -> DataFrame:
    """(cls, n, g): the shingles of each class, or one in ``share`` of the universe."""
    def run(batch):
        c, n, g = [], [], []
        for shingles, count, key in _sets(batch, size):
            some = shingles[shingles % np.uint64(share) == 0] if share > 1 else shingles
            c.append(np.full(len(some), key)), n.append(np.full(len(some), count)), g.append(some.view(np.int64))
        return {"cls": np.concatenate(c), "n": np.concatenate(n), "g": np.concatenate(g)}

    return _by_parts(texts.select("text"), run, "cls long, n int, g long", ROW_BYTES)


def _shared(texts: DataFrame, entries: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The entries of unresolved lists without those of sets that cannot link any more.

    A link has at least percent of the larger set in common.  So a set of
    which too many shingles occur in no other set of these lists is out.
    Most are found by a part of the universe; the whole of it is for the rest.
    Sets that the bitmap lets in besides only keep others in.
    """
    for share in (SHARE, 1):
        sets = entries.select(F.col("a").alias("cls"))
        words = _members(_some(texts, sets), size, share)
        single = words.groupBy("g").agg(F.count("*").alias("k"), F.min("cls").alias("cls"), F.min("n").alias("n")).where("k = 1")
        out = (single.groupBy("cls", "n").agg(F.count("*").alias("own"))
               .where((F.col("n") - F.col("own")) * 100 < F.col("n") * bands.percent).select(F.col("cls").alias("a"), F.col("n").alias("na")))
        entries = stored(entries.join(out, ["a", "na"], "left_anti"))
    return entries


def _deletions(texts: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(key, kind, cls, n, number, larger) of the segment subsets (kind 0) and one-deletion neighbours (1) of the classes with these texts."""
    def run(batch):
        out = {k: [] for k in ("key", "kind", "cls", "n", "number", "larger")}

        def add(values, kind, key, count, numbers, role):
            out["key"].append(values.view(np.int64))
            out["number"].append(numbers.astype(np.int32))
            for k, v in (("kind", kind), ("cls", key), ("n", count), ("larger", role)):
                out[k].append(np.full(len(values), v))

        for shingles, count, key in _sets(batch, size):
            band, largest = bands.of(count)
            for group, top, role in ((band, largest, 1), (band + 1, bands.above(largest), 0)):
                numbers, heads, values = cut(shingles, group, bands.segments(top))
                sums = np.add.reduceat(values, heads)
                add(keys(numbers, sums, group), 0, key, count, numbers, role)
                each = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(values))))
                add(keys(numbers[each], sums[each] - values, group), 1, key, count, numbers[each], role)
        kinds = {"key": pa.int64(), "kind": pa.int8(), "cls": pa.int64(), "n": pa.int32(), "number": pa.int32(), "larger": pa.int8()}
        return {k: pa.array(np.concatenate(v) if v else [], kinds[k]) for k, v in out.items()}

    return _by_parts(texts.select("text"), run,
                     "key long, kind byte, cls long, n int, number int, larger byte", ROW_BYTES)


def _linked(links: DataFrame) -> DataFrame:
    """(cls, n, root): root is the text form of a class, so classes and roots are plain keys."""
    name = lambda c, n: F.concat_ws(":", c, n)
    return components(links.select(name("a", "na").alias("a"), name("b", "nb").alias("b")))


def _unresolved(long: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of long lists that hold more than one component, with each entry's root."""
    named = (long.withColumn("node", F.concat_ws(":", "a", "na")).join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    lists = (named.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("sig"))
    return named.join(lists, "sig", "left_semi")


def _fits(percent: int):
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def _order(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lower class first."""
    flip = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("na") > F.col("nb")))
    return pairs.select(*(F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x)
                          for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na")))).distinct()


def links(docs: DataFrame, size: int = 5, percent: int = 80, base: DataFrame | None = None) -> DataFrame:
    """Links (a, na, b, nb, common) between classes: every linked pair of different sets has a path of links."""
    bands = Bands(percent)
    if base is None:
        base = stored(classes(docs, size, bands))
    # sizes become band numbers in Spark, and there are some ten bands per factor of ten in size
    edges = bands.edges(base.agg(F.max("n_shingles")).first()[0] or 1)
    band = bands.number(F.col("n_shingles"), edges)
    facts = base.groupBy(band.alias("band")).agg(F.sum("n_shingles").alias("total"), F.max("needy").alias("needy")).collect()
    needy = frozenset(r["band"] for r in facts if r["needy"])
    buckets = Buckets({r["band"]: r["total"] for r in facts if r["band"] >= 0}, edges)
    found = stored(candidates(entries(docs, size, bands, buckets, needy), bands))
    wanted = stored(found.select(F.col("a").alias("cls"), F.col("na").alias("n"))
                    .union(found.where("b is not null").select("b", "nb")).distinct())
    sketches = stored(base.select("cls", F.col("n_shingles").cast("int").alias("n"), "wide", *(f"s{i}" for i in range(SKETCH)))
                      .join(wanted, ["cls", "n"], "left_semi").dropDuplicates(["cls", "n"]))
    # pairs that a sketch rules out need no texts
    tested = stored(_likely(found.where("sig is null").select("a", "na", "b", "nb").distinct(), sketches, bands))
    long = found.where("sig is not null").select("sig", "a", "na")
    wanted = (tested.select(F.col("a").alias("cls"), F.col("na").alias("n")).union(tested.select("b", "nb"))
              .union(long.select("a", "na")).distinct())
    texts = stored(class_texts(docs, stored(wanted), size, bands))
    known = stored(verify(texts, tested, size, bands))
    if long.isEmpty():
        return known
    roots = _linked(known)
    long = _shared(texts, stored(_unresolved(long, roots).select("sig", "a", "na")), size, bands)
    for turn in range(STARS):
        open_lists = stored(_unresolved(long, roots))
        if open_lists.isEmpty():
            return known
        # a star per list: every entry outside the list's main component meets a different member of it each turn
        pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("a").alias("b"), F.col("na").alias("nb")))
        sizes = open_lists.groupBy("sig", "root").agg(F.count("*").alias("k"), pick.alias("p"))
        main = sizes.groupBy("sig").agg(F.max(F.struct("k", "root", "p")).alias("m")).select("sig", "m.root", "m.p.b", "m.p.nb")
        pairs = (open_lists.join(main.withColumnRenamed("root", "main"), "sig").where("root <> main").where(_fits(percent))
                 .select("a", "na", "b", "nb"))
        pairs = stored(_likely(_order(pairs), sketches, bands).join(tested, ["a", "na", "b", "nb"], "left_anti"))
        tested = tested.union(pairs)
        known = stored(known.unionByName(verify(texts, pairs, size, bands)))
        roots = _linked(known)
        long = open_lists.select("sig", "a", "na")
    return _rest(texts, sketches, stored(_unresolved(long, roots)), known, tested, size, bands, edges, buckets)


def _prefix(part: int, whole: int):
    """How many of n shingles are sure to hold one of any ``n * part / whole`` of them."""
    return (F.col("n") - F.ceil(F.col("n") * part / whole) + 1).cast("int")


def _rest(texts: DataFrame, sketches: DataFrame, rest: DataFrame, known: DataFrame, tested: DataFrame, size: int, bands: Bands,
          edges: list[int], buckets: Buckets) -> DataFrame:
    """Cost-based allocation for sets that keep entries in unresolved long lists."""
    if rest.isEmpty():
        return known
    percent = bands.percent
    chosen = rest.select(F.col("a").alias("cls"), F.col("na").alias("n"), "root").distinct()

    text = stored(_some(texts, chosen).join(chosen, ["cls", "n"], "left_semi"))
    chosen = stored(chosen.join(sketches.drop("wide"), ["cls", "n"]))
    index = stored(_deletions(text, size, bands))
    cost = rest.groupBy("sig").agg(F.count("*").alias("cost"))
    own = (index.where("kind = 0 and larger = 1").join(cost, buckets.named(F.col("key"), bands.number(F.col("n"), edges)) == F.col("sig"), "left")
           .select("cls", "n", "number", F.coalesce("cost", F.lit(0)).alias("cost")))
    # what a deletion list would cost: entries of the other kind under the same key
    load = index.groupBy("key").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("plain"), F.count(F.when(F.col("kind") == 1, 1)).alias("less"))
    near = (index.where("larger = 1").join(load, "key").groupBy("cls", "n", "number")
            .agg(F.sum(F.when(F.col("kind") == 0, F.col("less")).otherwise(F.col("plain"))).alias("near"),
                 F.count(F.when(F.col("kind") == 1, 1)).alias("shingles")))
    bound = (F.floor(2 * F.col("n") * (100 - percent) / (100 + percent)) + 1).cast("long")
    free = own.where("cost = 0").join(near, ["cls", "n", "number"])
    # a segment of one shingle has no deletions: it would be empty, and empty segments have no key
    per = (free.groupBy("cls", "n").agg(F.count("*").alias("free"), F.sort_array(
        F.collect_list(F.when(F.col("shingles") > 1, F.struct("near", "number")))).alias("by")))
    per = (chosen.join(per, ["cls", "n"], "left").withColumn("free", F.coalesce("free", F.lit(0)))
           .withColumn("lack", bound - F.col("free")).withColumn("can", F.coalesce(F.size("by"), F.lit(0))))
    # the deletions of the `lack` cheapest segments, or the sets that share one of the rarest shingles: the cheaper way
    lacking = stored(per.where("lack > 0"))
    price = F.aggregate(F.slice("by", F.lit(1), F.col("lack").cast("int")), F.lit(0).cast("long"), lambda x, y: x + y["near"])
    # the shingles of each set in one order for all sets, the rarest first
    words = stored(_members(text, size))
    often = words.groupBy("g").agg(F.count("*").alias("df"))
    rare = stored(words.join(often, "g").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("rare"))
                  .withColumn("rare", F.slice("rare", F.lit(1), _prefix(percent, 100))))
    other_price = F.aggregate("rare", F.lit(0).cast("long"), lambda x, y: x + y["df"])
    plan = stored(lacking.join(rare, ["cls", "n"]).withColumn("delete", (F.col("lack") <= F.col("can")) & (price <= other_price)))
    possible = (F.col("root_a") != F.col("root_b")) & (F.col("nb") <= F.col("na")) & _fits(percent) & _possible(percent)
    steps = plan.where("delete").select(*chosen.columns, F.explode(F.slice("by", F.lit(1), F.col("lack").cast("int"))).alias("s"))
    steps = steps.withColumn("number", F.col("s.number"))
    probe = stored(index.where("larger = 1").select("cls", "n", "number", "key", "kind").join(steps, ["cls", "n", "number"])
                   .select("key", "kind", *_named("a", "root")))
    # only what a probe asks for travels with its sketch
    other = (index.select("cls", "n", "key", "kind").join(probe.select("key").distinct(), "key", "left_semi").join(chosen, ["cls", "n"])
             .select(F.col("key").alias("key_b"), F.col("kind").alias("kind_b"), *_named("b", "root")))
    by_delete = probe.join(other, (F.col("key") == F.col("key_b")) & (F.col("kind") + F.col("kind_b") == 1) & possible)
    # at the first shingle in that order which two sets have in common, what follows in either set has room for the whole intersection
    few = plan.where("not delete").select(*chosen.columns, F.posexplode("rare").alias("at", "s")).select(F.col("s.g").alias("g"), *_named("a", "root", "at"))
    held = (chosen.join(rare, ["cls", "n"]).withColumn("rare", F.slice("rare", F.lit(1), _prefix(2 * percent, 100 + percent)))
            .select(*chosen.columns, F.posexplode("rare").alias("at", "s")).select(F.col("s.g").alias("g_b"), *_named("b", "root", "at")))
    room = F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    by_rare = few.join(held, (F.col("g") == F.col("g_b")) & room & possible)
    pairs = by_delete.select("a", "na", "b", "nb").union(by_rare.select("a", "na", "b", "nb"))
    pairs = stored(_order(pairs).join(tested, ["a", "na", "b", "nb"], "left_anti"))
    return stored(known.unionByName(verify(texts, pairs, size, bands)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, keep_class: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, n_links, class_size.

    n_links counts the links of the row's class that were verified (in a large
    component not all pairs are compared); copies of the row are in class_size.  Further columns of ``docs`` are not read.
    """
    bands = Bands(percent)
    docs = docs.select("doc_id", "text")
    base = stored(classes(docs, size, bands))
    found = links(docs, size, percent, base)
    roots = _linked(found)
    degree = (found.select(F.concat_ws(":", "a", "na").alias("node")).union(found.select(F.concat_ws(":", "b", "nb")))
              .groupBy("node").agg(F.count("*").alias("n_links")))
    # one row per class: its smallest doc_id and its root
    kind = (base.where("n_shingles > 0").groupBy("cls", "n_shingles")
            .agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"))
            .withColumn("node", F.concat_ws(":", "cls", "n_shingles"))
            .join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node")))
    kind = stored(kind)
    least = kind.groupBy("root").agg(F.min("low").alias("component_id"))
    kind = kind.join(least, "root").select("cls", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_size")
    return (base.join(kind, ["cls", "n_shingles"], "left")
            .select("doc_id", "n_shingles", *(["cls"] if keep_class else []), F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that near-duplicate a row of lower doc_id; columns unchanged.

    Of each component the rows of its smallest doc_id stay.  Rows without words stay, and so do rows without doc_id.
    Only where a doc_id has rows of both kinds are the rows told apart by their texts.
    """
    columns = [f"`{c}`" for c in docs.columns]
    judged = stored(near_duplicates(docs, size, percent, keep_class=True).where("doc_id is not null")
                    .select(F.col("doc_id").alias("gone_id"), F.col("cls").alias("gone_cls"), F.col("n_shingles").alias("gone_size"),
                            (F.col("doc_id") != F.col("component_id")).alias("gone")))
    ids = stored(judged.groupBy("gone_id").agg(F.max("gone").alias("some"), F.min("gone").alias("each")).where("some"))
    mixed = ids.where("not each")
    gone = judged.where("gone").join(mixed.select("gone_id"), "gone_id", "left_semi")
    names = {c: fresh(docs, c) for c in ("cls", "size")}

    def key(batch):
        made = [(k, n) for _, n, k in _sets(batch, size)]
        return {names["cls"]: [k for k, _ in made], names["size"]: [n for _, n in made]}

    doc_id = F.col("doc_id").cast("long")
    keyed = extend_batches(docs.join(mixed, doc_id == mixed["gone_id"], "left_semi"), key, "`{}` long, `{}` long".format(*names.values()))
    left = [doc_id, F.col(f"`{names['cls']}`"), F.col(f"`{names['size']}`")]
    match = [a == gone[b] for a, b in zip(left, ("gone_id", "gone_cls", "gone_size"), strict=True)]
    return (docs.join(ids, doc_id == ids["gone_id"], "left_anti").select(*columns)
            .union(keyed.join(gone, match, "left_anti").select(*columns)))
