"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits by bit-sliced comparison.

1. A pass over the texts hashes every shingle (XXH64) and counts, for each bit, the hashes that have it set. Equal fingerprints are one from
   there on, with the smallest doc_id that has them.
2. Fingerprints within ``RADIUS`` bits agree on two at least of four quarters, so each goes to the six buckets that pairs of its quarters
   name. Buckets of more than ``LARGE`` fingerprints are dealt anew: their members agree on 32 bits, and two that are linked agree on two of four
   quarters of the other 32 as well. Such a bucket has 65,536 different fingerprints at most, whatever the input is.
3. A bucket's fingerprints are stored vertically, as 64 planes of one bit for each. Comparing adds up the differing bits of many pairs at once, in
   bitwise counters: four planes go through carry-save adders into ones, twos and fours. Blocks of 1,024 pairs of which
   none can be within the radius any more are dropped from further planes. In small buckets a pair is a place and the place d further on,
   for all buckets of a buffer together; in others some fingerprints are held against all that no link has reached yet, and those within the
   radius go on from there. So a bucket hands on a number of links that grows with its fingerprints, not with their pairs, and
   what is linked in it stays so.
4. Groups of links come by alternating large-star and small-star steps on tables.

Cases: a null or empty text, or one of white space alone, has fingerprint zero, linked like any other; a text of one or two words has one
shingle, the whole sequence; repeated rows share a fingerprint; long texts are hashed whole, in stretches; a null doc_id never names a
component unless alone in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.ngram_join import _runs, groups
from doclens.llm.words import pieces, released
from doclens.session import discard, materialise

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members beyond which a bucket is dealt anew, and those up to which all its places are compared with those further on.
LARGE, SMALL = 4096, 32
#: Words of 64 places that are kept or dropped together, and fingerprints held against a bucket at once.
WIDTH, ASKED = 16, 64
#: Hashes whose bits are counted at once, and words that are hashed at once.
COUNTED, STRETCH = 1 << 15, 1 << 16


def hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, a stretch at a time."""
    words = text.lower().split()  # bytes: A-Z alone, and the white space of ASCII alone
    if len(words) <= shingle:
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(words) - shingle + 1, STRETCH):
        some = words[low : low + STRETCH + shingle - 1]
        joined = b" ".join(some)
        ends = list(accumulate((len(w) + 1 for w in some)))
        yield np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])], np.uint64)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text."""
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    of: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = [len(h) for h in held]
            np.add.at(counts, of, np.add.reduceat(bits, [0, *accumulate(sizes[:-1])], axis=0, dtype=np.int64))
            np.add.at(n, of, sizes)
        held.clear()
        of.clear()

    waiting = 0
    for i, text in enumerate(texts.to_pylist()):
        for h in hashes(text or b"", shingle):
            held.append(h)
            of.append(i)
            waiting += len(h)
            if waiting >= COUNTED:
                count()
                waiting = 0
    count()
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_pass(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(fingerprints(piece["text"], shingle).view(np.int64))], ["doc_id", "fp"])

    return run


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Plane p has bit p of each fingerprint, in words of 64 places: 64 x blocks x ``WIDTH``."""
    padded = np.concatenate([prints, np.zeros(-len(prints) % (64 * WIDTH), np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64).reshape(64, -1, WIDTH)


def packed(flags: np.ndarray) -> np.ndarray:
    """Flags of places as words of 64, in blocks of ``WIDTH``."""
    padded = np.concatenate([flags, np.zeros(-len(flags) % (64 * WIDTH), bool)])
    return np.packbits(padded, bitorder="little").view(np.uint64).reshape(-1, WIDTH)


def places(words: np.ndarray) -> np.ndarray:
    """Places whose bit is set, of words in rows."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little"))


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of three bits at each place: its ones and its twos."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Places whose count, least significant plane first, is above the radius."""
    over, level = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for bit in reversed(range(len(counter))):
        if radius >> bit & 1:
            level &= counter[bit]
        else:
            over |= level & counter[bit]
            level &= ~counter[bit]
    return over


def within(differing: Callable[[int, np.ndarray], np.ndarray], alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places of ``alive`` (blocks x words) at which at most ``radius`` bits differ. ``differing`` gives a plane's differing bits in the blocks asked for."""
    out = np.zeros_like(alive)
    blocks = np.flatnonzero(alive.any(1))
    left = alive[blocks]
    counter = [np.zeros_like(left) for _ in range(max(2, (radius + 1).bit_length()))]
    for p in range(0, 64, 4):
        ones, low = carry_save(counter[0], differing(p, blocks), differing(p + 1, blocks))
        ones, high = carry_save(ones, differing(p + 2, blocks), differing(p + 3, blocks))
        twos, carry = carry_save(counter[1], low, high)
        counter[:2] = ones, twos
        for bit in range(2, len(counter)):
            counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry
        left &= ~(carry | above(counter, radius))
        some = left.any(1)
        if not some.all():
            blocks, left, counter = blocks[some], left[some], [c[some] for c in counter]
            if not len(blocks):
                break
    out[blocks] = left
    return out


def small_links(prints: np.ndarray, opens: np.ndarray, size: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (2 x n) in buckets of ``SMALL`` at most: each place with that d further on in its bucket. ``opens``: the bucket's first place."""
    some = np.flatnonzero((size > 1) & (size <= SMALL))
    prints, opens, size = prints[some], opens[some], size[some]
    links = [np.zeros((2, 0), np.uint64)]
    for d in range(1, int(size.max(initial=1))):
        if d > 1:  # buckets that have places so far apart
            prints, opens, size = (x[size > d] for x in (prints, opens, size))
        near = np.zeros(len(prints), bool)
        near[:-d] = opens[:-d] == opens[d:]
        planes = planes_of(prints)
        on = np.concatenate([planes.reshape(64, -1)[:, 1:], np.zeros((64, 1), np.uint64)], axis=1).reshape(planes.shape)
        right, left = np.uint64(d), np.uint64(64 - d)
        differing = lambda p, b: planes[p, b] ^ ((planes[p, b] >> right) | (on[p, b] << left))  # noqa: B023, E731
        i = places(within(differing, packed(near), radius))
        links.append(np.stack([prints[i], prints[i + d]]))
    return np.concatenate(links, axis=1)


def large_links(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (2 x n) of one bucket of different fingerprints: each that links reach, to the first of its group."""
    planes, left = planes_of(prints), np.ones(len(prints), bool)
    n_blocks = planes.shape[1]
    links = []
    for first in range(len(prints)):
        if not left[first]:
            continue
        left[first] = False
        waiting = np.array([first])
        while len(waiting):
            asked, waiting = waiting[:ASKED], waiting[ASKED:]
            bit = np.where(prints[asked][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), ~np.uint64(0), np.uint64(0))
            differing = lambda p, b: planes[p, b % n_blocks] ^ bit[b // n_blocks, p][:, None]  # noqa: B023, E731
            found = within(differing, np.tile(packed(left), (len(asked), 1)), radius)
            met = places(np.bitwise_or.reduce(found.reshape(len(asked), n_blocks, WIDTH), axis=0))
            left[met] = False
            links.append(np.stack([np.full(len(met), prints[first]), prints[met]]))
            waiting = np.concatenate([waiting, met])
    return np.concatenate([np.zeros((2, 0), np.uint64), *links], axis=1)


def _link_pass(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp in _runs(batches, ["bucket", "fp"], 1):
            prints = fp.astype(np.int64).view(np.uint64)
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            opens = np.flatnonzero(first)[np.cumsum(first) - 1]
            size = np.bincount(opens, minlength=len(opens))[opens]
            links = [small_links(prints, opens, size, radius)]
            for at in np.unique(opens[size > SMALL]).tolist():
                links.append(large_links(prints[at : at + size[at]], radius))
            a, b = np.unique(np.sort(np.concatenate(links, axis=1).view(np.int64), axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _quarters(value: Column, bits: int) -> Column:
    """For each two of the four quarters of a value's lowest ``bits``: which they are, the two as one number, and the others."""
    width = bits // 4
    part = lambda i: F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    two = lambda i, j: F.shiftleft(part(i), width).bitwiseOR(part(j))
    rows = []
    for which, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        rows.append(F.struct(F.lit(which).cast("long").alias("which"), two(i, j).alias("key"), two(k, m).alias("rest")))
    return F.explode(F.array(*rows))


def buckets(prints: DataFrame, large: int | None = None) -> DataFrame:
    """bucket, fp: every fingerprint (``prints``: fp, different ones) in the buckets that those linked to it share with it."""
    entries = prints.select("fp", _quarters(F.col("fp"), 64).alias("e")).select("fp", "e.*")
    entries = entries.withColumn("bucket", F.shiftleft("which", 51).bitwiseOR(F.shiftleft("key", 19))).drop("which", "key")
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > (LARGE if large is None else large)).select("bucket", F.lit(True).alias("crowded"))
    told = materialise(entries.join(crowded, "bucket", "left"), "simhash-buckets")
    anew = told.where("crowded").select("fp", "bucket", _quarters(F.col("rest"), 32).alias("e"))
    anew = anew.select(F.col("bucket").bitwiseOR(F.shiftleft(F.col("e.which") + 1, 16)).bitwiseOR(F.col("e.key")).alias("bucket"), "fp")
    return told.where("crowded is null").select("bucket", "fp").union(anew)


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    if not 0 <= radius <= 2:
        raise ValueError("buckets of two quarters find pairs of up to two differing bits")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    members = materialise(raw.mapInArrow(released(_fingerprint_pass(shingle)), "doc_id long, fp long"), "simhash-prints")
    lowest = materialise(members.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    dealt = buckets(lowest.select("fp")).repartition("bucket").sortWithinPartitions("bucket", "fp")
    links = materialise(dealt.mapInArrow(released(_link_pass(radius)), "a long, b long"), "simhash-links")
    grouped = groups(links).select(F.col("name").alias("fp"), "grp")
    named = lowest.join(grouped, "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    least = named.groupBy("grp").agg(F.min("low").alias("component_id"))
    component = materialise(named.join(least, "grp").select("fp", "component_id"), "simhash-components")
    for table in (links, lowest):
        discard(table)
    return members.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
