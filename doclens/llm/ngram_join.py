"""N-gram Jaccard join by set-relation skipping, and its groups of near copies.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; two are linked at a Jaccard similarity of at
least 3/4, exactly. Documents with equal sets are one set throughout.

1. One pass names each document's set and counts the shingles that tasks meet often. The order of shingles, the same for
   all sets, puts those last (by count), the others first by hash. It only steers speed: any order gives the same links.
2. A set enters the index lists of its first ``n - ceil(3n/4) + 1`` shingles, with its size and position there. Similar
   sets share a list. Lists stand sorted by size, and by position in the block of each size: a probe looks at the blocks of its size
   window, jumps over those whose least position is too far back for what is left of both sets to suffice, and leaves others where
   positions get there.
3. Short lists give all their pairs. In long lists each set is first paired only with its neighbour and with the sets
   whose own shingles take least of the order (of near copies, those least changed); pairs are verified and linked
   sets put in groups. Then only entries of different groups can give new links, so what a similar set's answers
   already settle is skipped, and the pairs left over are verified too.
4. Pairs are first held against small bitmaps of the sets, which bound the overlap from above, so texts are sent only where those
   leave it open. Within a task, a pair's overlap is first bounded from the computed answer of a highly similar set,
   ``o(t,b) - |t \\ a| <= o(a,b) <= o(t,b) + |a \\ t|``, and counted only if the bounds do not settle it.
5. Groups of links come by alternating large-star and small-star steps on tables.

Lists of shingles that very many sets hold are salted by set, and joined across salts in step 3, where a list of many entries is cut into
slices and each pair of slices is a task's work. Texts are sent only for sets that share a list, and in portions of bounded size.

Shingles and sets are told apart by 64-bit hashes of sums of random numbers: among 10**9 different sets, two share a name with a chance
of 3 in 100, and two texts are linked wrongly only if shingles of that very pair do too.

Cases: a null or empty text has no shingles, is linked with nothing and is its own component; a text of 1 to 4 words has
one shingle, the whole sequence; repeated rows share a component; a null doc_id never names a component unless alone in
it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.passes import map_texts
from doclens.llm.words import NOT_SPACE, mixed, pieces, released, spans_hash, text_bytes, words_of
from doclens.session import materialise

SHINGLE = 5
#: Shingles kept as frequent: counted so often in all, and no more of them than this (most frequent first).
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Lists of a shingle are split in salts of about so many sets.
SALT_ROWS = 4096
#: Lists up to this length give all pairs at once.
SHORT_LIST = 8
#: Sets of a longer list that all others are paired with first.
PIVOTS = 3
#: Pairs that are verified together, and shingles of their sets; a set with more pairs than that is dealt by so many salts.
PORTION, PORTION_SHINGLES, HOME_SALTS = 1024, 1 << 20, 64
#: Entries of a list beyond which its groups are crossed slice by slice.
SLICE = 1 << 15
#: Pairs that a task gathers before it hands them on.
FOUND = 1 << 18
BUFFER_ROWS = 1 << 17
#: Repeated shingles gathered before they are counted, and places of the table that tells them from new ones.
COUNT_ROWS, MET_PLACES = 1 << 19, 1 << 23


class Sets(NamedTuple):
    """Shingle sets of several rows."""

    row: np.ndarray
    hash: np.ndarray
    """Distinct shingles, sorted in each row."""
    first: np.ndarray
    """Where each row's set begins; one more entry at the end."""
    name: np.ndarray
    """64-bit name of each row's set."""

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def sets_of(column: pa.Array) -> Sets:
    n = len(column)
    words = words_of(*text_bytes(column), NOT_SPACE)
    counts, of = words.counts, words.row
    h = spans_hash(words.hash, SHINGLE)
    whole = np.flatnonzero(of[: len(h)] == of[SHINGLE - 1 : SHINGLE - 1 + len(h)])
    rows, hashes = [of[whole]], [h[whole]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(counts == k)
        if len(short):
            rows.append(short)
            hashes.append(spans_hash(words.hash, k)[words.first[short]] + np.uint64(k))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    first = np.searchsorted(row, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(0x51ED270B)), dtype=np.uint64)])
    return Sets(row, h, first, mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)))


def _fresh(sets: Sets, seen: set[int]) -> np.ndarray:
    """Rows whose set is not empty and did not come up before in this task."""
    out = []
    for i, (name, size) in enumerate(zip(sets.name.tolist(), sets.sizes.tolist(), strict=True)):
        if size and name not in seen:
            seen.add(name)
            out.append(i)
    return np.array(out, np.int64)


def _shingles(sets: Sets, rows: np.ndarray) -> np.ndarray:
    keep = np.zeros(len(sets.first) - 1, bool)
    keep[rows] = True
    return keep[sets.row]


def _name_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, name, size, bits), with the bitmap of sets not seen before in the task, and rows (shingle, count) of shingles met
    often. A table of flags by hash tells which shingles may have been met before; only those are gathered and counted, and what
    was their first time is added."""
    seen: set[int] = set()
    met: list[np.ndarray] = []
    flags, flagged = np.zeros(MET_PLACES, bool), 0
    columns = ["doc_id", "name", "size", "bits", "shingle", "n"]

    def often() -> pa.RecordBatch:
        distinct, n = np.unique(np.concatenate(met), return_counts=True)
        distinct, n = distinct[n > 1], n[n > 1]  # others may only share a place of the table
        met.clear()
        none = pa.nulls(len(distinct), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(distinct), pa.binary()), pa.array(distinct.view(np.int64)), pa.array(n + 1)], columns)

    for piece in pieces(batches, "text"):
        sets = sets_of(piece["text"])
        fresh = _fresh(sets, seen)
        shingles = sets.hash[_shingles(sets, fresh)]
        place = (shingles & np.uint64(MET_PLACES - 1)).astype(np.int64)
        before = flags[place]
        flags[place] = True
        flagged += len(place) - int(before.sum())
        met.append(shingles[before])
        if 2 * flagged > MET_PLACES:
            flags[:], flagged = False, 0
        none, bits = pa.nulls(piece.num_rows, pa.int64()), [None] * piece.num_rows
        for i in fresh.tolist():
            bits[i] = bitmap(sets.hash[sets.first[i] : sets.first[i + 1]]).tobytes()
        yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(sets.name.view(np.int64)), pa.array(sets.sizes), pa.array(bits, pa.binary()), none, none], columns)
        if sum(map(len, met)) > COUNT_ROWS:
            yield often()
    if met:
        yield often()


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of 2 to 4 times as many places as there are shingles are hit by one, as 64-bit words."""
    places = 64 << max(0, (2 * len(hashes) - 1).bit_length() - 6)
    hit = np.zeros(places, np.uint8)
    hit[(hashes & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(hit, bitorder="little").view(np.uint64)


def most_common(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """Upper bound on the overlap of two sets, from their bitmaps: places hit by both, and shingles that share a place."""
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    ones = lambda x: int(np.bitwise_count(x).sum())
    return ones(a & b) + min(n_a - ones(a), n_b - ones(b))


def _plausible_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)
        word = lambda x: np.frombuffer(x, np.uint64)
        keep = pa.array([7 * most_common(word(x), n, word(y), m) >= 3 * (n + m) for n, x, m, y in rows], pa.bool_())
        n = pc.add(batch["n_a"], batch["n_b"])
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], n], ["a", "b", "n"]).filter(keep)


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs that their bitmaps do not rule out, and n, the shingles of both. ``sketches``: name, size, bits."""
    of = lambda x: sketches.select(F.col("name").alias(x), F.col("size").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "n_a", "bits_a", "b", "n_b", "bits_b").mapInArrow(released(_plausible_pass), "a long, b long, n long")


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of sets of these sizes at similarity 3/4."""
    return -(-3 * (a + b) // 7)


def _list_pass(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = sent.value
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            sets = sets_of(piece["text"])
            use = np.flatnonzero(_shingles(sets, _fresh(sets, seen)))
            row, h = sets.row[use], sets.hash[use]
            weight = np.zeros(len(h), np.int64)
            if len(shingles):
                at = np.minimum(np.searchsorted(shingles, h), len(shingles) - 1)
                weight = np.where(shingles[at] == h, counts[at], 0)
                order = np.lexsort((h, weight, row))
                row, h, weight = row[order], h[order], weight[order]
            size = sets.sizes[row]
            position = np.arange(len(row)) - np.searchsorted(row, row)
            prefix = position <= size - (3 * size + 3) // 4
            row, h, size, position, weight = (x[prefix] for x in (row, h, size, position, weight))
            name = sets.name[row]
            salt = (name % np.maximum(1, weight // SALT_ROWS).astype(np.uint64)).astype(np.int32)
            salted = weight >= 2 * SALT_ROWS
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.where(salted, salt + 1, 0).astype(np.int32)), pa.array(name.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(position.astype(np.int32))], ["shingle", "salt", "name", "size", "position"])

    return run


LISTS = "shingle long, salt int, name long, size int, position int"


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, a buffer at a time; rows equal in the first ``by`` columns are never parted."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([np.asarray(batch[c]) for c in columns])
        rows += batch.num_rows
        if rows >= BUFFER_ROWS:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            same = np.ones(rows, bool)
            for c in whole[:by]:
                same &= c == c[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield [c[:cut] for c in whole]
            held, rows = [[c[cut:] for c in whole]], rows - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _fit(size: np.ndarray, position: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j of a list can be similar: sizes, and what is left from their positions on."""
    return (4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])) & (np.minimum(size[i] - position[i], size[j] - position[j]) >= need(size[i], size[j]))


def _pair_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of short lists, and of neighbours and pivots in long ones; entries of the long ones. Lists are sorted by size, position
    and name."""
    columns = ["a", "b", "shingle", "salt", "name", "size", "position"]
    for shingle, salt, name, size, position in _runs(batches, ["shingle", "salt", "name", "size", "position"], 2):
        new = np.ones(len(name), bool)  # copies of a set come from several tasks
        new[1:] = (name[1:] != name[:-1]) | (shingle[1:] != shingle[:-1])
        shingle, salt, name, size, position = (x[new] for x in (shingle, salt, name, size.astype(np.int64), position.astype(np.int64)))
        opens = np.ones(len(name), bool)
        opens[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
        of = np.cumsum(opens) - 1
        length = np.bincount(of)[of]
        pairs = []
        for d in range(1, SHORT_LIST):
            i = np.flatnonzero((of[:-d] == of[d:]) & ((length[:-d] <= SHORT_LIST) | (d == 1))) if len(of) > d else np.zeros(0, np.int64)
            i = i[_fit(size, position, i, i + d)]
            pairs.append(np.stack([np.minimum(name[i], name[i + d]), np.maximum(name[i], name[i + d])]))
        order = np.lexsort((name, position, of))
        opened = np.flatnonzero(opens)
        for nth in range(PIVOTS):
            i = np.flatnonzero(length > SHORT_LIST)
            j = order[opened[of[i]] + nth]
            i, j = i[i != j], j[i != j]
            fit = _fit(size, position, i, j)
            pairs.append(np.stack([np.minimum(name[i[fit]], name[j[fit]]), np.maximum(name[i[fit]], name[j[fit]])]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        long = np.flatnonzero((length > SHORT_LIST) | (salt > 0))
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none(len(a))] * 5], columns)
        yield pa.RecordBatch.from_arrays([none(len(long)), none(len(long)), *(pa.array(x[long].astype(np.int64)) for x in (shingle, salt, name, size, position))], columns)


def _cross_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list's cell whose entries are in different groups, and of different slices if the cell joins two. Entries of the cell's
    largest group are not probed with: each of their pairs across groups has another entry to probe with."""
    found: list[np.ndarray] = []
    rows = 0

    def pairs() -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for shingle, low_slice, high_slice, size, position, name, group, slice_ in _runs(batches, ["shingle", "low", "high", "size", "position", "name", "grp", "slice"], 3):
        new = (np.diff(shingle) != 0) | (np.diff(low_slice) != 0) | (np.diff(high_slice) != 0)
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(shingle)]])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            groups, which = np.unique(group[low:high], return_inverse=True)
            if len(groups) < 2:
                continue
            blocks = Blocks(size[low:high], position[low:high])
            n, part = name[low:high], slice_[low:high] if low_slice[low] != high_slice[low] else None
            for i in np.flatnonzero(which != np.bincount(which).argmax()).tolist():
                j = blocks.candidates(i)
                j = j[which[j] != which[i]] if part is None else j[(which[j] != which[i]) & (part[j] != part[i])]
                found.append(np.stack([np.minimum(n[i], n[j]), np.maximum(n[i], n[j])]))
                rows += len(j)
                if rows >= FOUND:
                    yield pairs()
                    rows = 0
    yield pairs()


class Blocks:
    """A list's entries, sorted by size and position: a block for each size."""

    STEP = 1 << 32

    def __init__(self, size: np.ndarray, position: np.ndarray):
        self.size, self.position = size, position
        self.key = size * self.STEP + position
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(size) != 0]))
        self.sizes = size[self.first]

    def candidates(self, i: int) -> np.ndarray:
        """Entries that can be similar to entry i: in blocks of its size window, up to the last position that leaves enough of both sets."""
        size, left = int(self.size[i]), int(self.size[i] - self.position[i])
        a, b = np.searchsorted(self.sizes, [-(-3 * size // 4), 4 * size // 3 + 1])
        least = need(size, self.sizes[a:b])
        open_ = np.flatnonzero(least <= left) + a  # blocks for which what is left of the probe suffices
        least = least[open_ - a]
        end = np.searchsorted(self.key, self.sizes[open_] * self.STEP + self.sizes[open_] - least, "right")
        n = np.maximum(0, end - self.first[open_])
        return np.arange(int(n.sum())) + np.repeat(self.first[open_] - (np.cumsum(n) - n), n)


class Portion:
    """Sets and pairs that are verified together."""

    def __init__(self) -> None:
        self.sets: dict[int, np.ndarray] = {}
        self.known: dict[tuple[int, int], int] = {}
        self.twin: dict[int, tuple[int, int]] = {}
        self.counted = 0

    def add(self, names: list[int], texts: pa.Array) -> None:
        sets = sets_of(texts)
        for i, name in enumerate(names):
            self.sets[name] = sets.hash[sets.first[i] : sets.first[i + 1]]

    def linked(self, a: int, b: int) -> bool:
        least = -(-3 * (len(self.sets[a]) + len(self.sets[b])) // 7)
        for x, y in ((a, b), (b, a)):
            if twin := self.twin.get(x):
                t, common = twin
                over = self.known.get((t, y) if t < y else (y, t))
                if over is not None:
                    if over - (len(self.sets[t]) - common) >= least:
                        return True
                    if over + len(self.sets[x]) - common < least:
                        return False
        over = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        self.counted += 1
        self.known[a, b] = over
        for x, y in ((a, b), (b, a)):
            if over >= least and over > self.twin.get(x, (0, 0))[1]:
                self.twin[x] = (y, over)
        return over >= least


def _verify_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, portion = None, Portion()
    for batch in batches:
        keys = np.stack([np.asarray(batch["home"]), np.asarray(batch["part"])])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
        links: list[tuple[int, int]] = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if key != (now := tuple(keys[:, low].tolist())):
                key, portion = now, Portion()
            rows = batch.slice(low, high - low)
            n_sets = int(rows["b"].null_count)  # sets come before pairs
            if n_sets:
                portion.add(rows["a"].slice(0, n_sets).to_pylist(), rows["text"].slice(0, n_sets))
            pairs = rows.slice(n_sets)
            links += [(a, b) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True) if portion.linked(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a < b, and n shingles of both) that are linked. ``texts``: name, text. Pairs go where their smaller
    set's smallest partner is at home, so that a set is sent to few places; the pairs of a home are dealt to as many portions as bound
    their number and shingles. Homes with several portions come to their pairs by salts, as one home may have very many pairs."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("home"))
    homes = pairs.join(least, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(HOME_SALTS)))
    parts = F.greatest(F.ceil(F.count("*") / PORTION), F.ceil(F.sum("n") / PORTION_SHINGLES))
    large = homes.groupBy("home").agg(parts.alias("parts")).where("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOME_SALTS - 1))))
    part = F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    placed = homes.join(large.withColumn("salt", F.col("salt").cast("long")), ["home", "salt"], "left").select("home", part.alias("part"), "a", "b")
    sets = placed.select("home", "part", F.explode(F.array("a", "b")).alias("a")).distinct().join(texts, F.col("a") == F.col("name"))
    rows = sets.select("home", "part", "a", F.lit(None).cast("long").alias("b"), "text").union(placed.select("home", "part", "a", "b", F.lit(None).cast("binary")))
    return rows.repartition("home", "part").sortWithinPartitions("home", "part", F.asc_nulls_first("b"), "a").mapInArrow(released(_verify_pass), "a long, b long")


def groups(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): name and grp, the smallest name of its group, for all names but that one."""
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "ngram-edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = materialise(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "ngram-edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return edges.select(F.col("u").alias("name"), F.col("v").alias("grp"))
        last = tuple(state)


def components(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    members, grouped = _components(docs)
    sets = members.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("low")).join(grouped, "name", "left").withColumn("grp", F.coalesce("grp", "name"))
    lowest = sets.groupBy("grp").agg(F.min("low").alias("component"))
    of_set = sets.join(lowest, "grp").select("name", "component")
    joined = members.join(of_set, "name", "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, name of the set and its size for each document, and name and grp for each set of a group but the one that names it."""
    spark = docs.sparkSession
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    named = materialise(raw.mapInArrow(released(_name_pass), "doc_id long, name long, size long, bits binary, shingle long, n long"), "ngram-names")
    members = named.where("size is not null").select("doc_id", "name", "size")
    sketches = named.where("bits is not null").select("name", "size", "bits").dropDuplicates(["name"])
    often = named.where("n is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = often.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    shingles = top["shingle"].to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    counts = top["n"].to_numpy() if top.num_rows else np.zeros(0, np.int64)
    order = np.argsort(shingles)
    sent = spark.sparkContext.broadcast((shingles[order], counts[order]))

    entries = raw.select("text").mapInArrow(released(_list_pass(sent)), LISTS)
    lists = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "size", "position", "name")
    found = materialise(lists.mapInArrow(released(_pair_pass), "a long, b long, shingle long, salt long, name long, size long, position long"), "ngram-lists")
    long = found.where("name is not null").select("shingle", "salt", "name", "size", "position")
    salted = long.where("salt > 0")
    # a row for each salted shingle, of which there are at most MOST_FREQUENT
    pivots = salted.groupBy("shingle").agg(F.min(F.struct("position", "name", "size")).alias("pivot"))
    mates = salted.join(F.broadcast(pivots), "shingle").where("name != pivot.name AND 4 * least(size, pivot.size) >= 3 * greatest(size, pivot.size)")
    across = mates.select(F.least("name", "pivot.name").alias("a"), F.greatest("name", "pivot.name").alias("b"))
    pairs = found.where("a is not null").select("a", "b").union(across).distinct()
    pairs = materialise(plausible(pairs, sketches), "ngram-pairs")

    crossing = materialise(_crossing(long, groups(pairs), sketches), "ngram-cross")
    asked = pairs.union(crossing).distinct()
    wanted = asked.select(F.explode(F.array("a", "b")).alias("name")).distinct().hint("merge")  # the same way at every size
    texts = raw.select("text").mapInArrow(released(_texts), "name long, text binary").join(wanted, "name", "left_semi").dropDuplicates(["name"])
    texts = materialise(texts, "ngram-texts")
    links = materialise(verified(asked, texts), "ngram-links")
    grouped = groups(links)

    # What is left are pairs inside a group of plausible pairs that links did not join; their texts are there.
    rest = _crossing(long, grouped, sketches).join(asked, ["a", "b"], "left_anti")
    more = materialise(verified(materialise(rest, "ngram-cross"), texts), "ngram-links")
    if not more.isEmpty():
        grouped = groups(grouped.select(F.col("name").alias("a"), F.col("grp").alias("b")).union(more))

    return members, grouped


def _crossing(long: DataFrame, grouped: DataFrame, sketches: DataFrame) -> DataFrame:
    """Plausible pairs of the long lists' entries that are in different groups. A list of one group has none."""
    placed = long.join(grouped, "name", "left").select("shingle", "salt", "name", "size", "position", F.coalesce("grp", "name").alias("grp"))
    placed = materialise(placed, "ngram-placed")
    salts = placed.groupBy("shingle", "salt").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n"))
    several = salts.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high")
    slices = salts.select("shingle", "salt").join(several.select("shingle", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), "shingle")
    dealt = placed.join(slices, ["shingle", "salt"]).withColumn("slice", F.pmod(F.xxhash64("name"), F.col("slices")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = cells.select("shingle", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "size", "position", "name", "grp", "slice")
    lists = cells.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "size", "position", "name")
    return plausible(lists.mapInArrow(released(_cross_pass), "a long, b long").distinct(), sketches)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for piece in pieces(batches, "text"):
        sets = sets_of(piece["text"])
        rows = _fresh(sets, seen)
        yield pa.RecordBatch.from_arrays([pa.array(sets.name[rows].view(np.int64)), piece["text"].take(pa.array(rows))], ["name", "text"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the row of the smallest doc_id, and of equal ones the first by set and text. Rows that
    are not linked all stay, whatever their doc_ids, as do rows without words and rows with a null doc_id. Columns may have any names."""
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    members, group_of = _components(docs)
    group = F.coalesce("grp", F.col("name"))
    first = F.min(F.struct("doc_id", "name"))
    kept = members.where("size > 0 AND doc_id IS NOT NULL").groupBy("name").agg(first.alias("f")).join(group_of, "name", "left").groupBy(group).agg(F.min("f").alias("f"))
    kept = kept.select(F.col("f.doc_id").alias("id"), F.col("f.name").alias("kept"))

    def sets(texts: pa.Array) -> list:
        found = sets_of(texts)
        return [pa.array(found.name.view(np.int64)), found.sizes]

    rows = map_texts(flat, flat.columns, text, sets, "name long, size long")
    stays = (F.col("size") == 0) | F.col(doc_id).isNull()
    linked = rows.where(~stays).join(kept, (F.col(doc_id).cast("long") == F.col("id")) & (F.col("name") == F.col("kept")), "left_semi")
    place = F.row_number().over(Window.partitionBy(doc_id, "name").orderBy(text))
    linked = linked.withColumn("place", place).where("place = 1").select(flat.columns)
    return linked.union(rows.where(stays).select(flat.columns)).toDF(*docs.columns)
