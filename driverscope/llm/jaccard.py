"""Similarity join of n-gram sets by prefix trees: all pairs with a Jaccard similarity of t or more.

Sets are sorted in one global order: shingles that look frequent in a sample of documents last, and
by hash within both parts. Any order gives the same result, so the sample only matters for speed.

1. Two similar sets share a shingle of their prefixes, ceil(t n) - 1 short of their lengths. Rows
   (shingle, set) of the prefixes meet by shingle.
2. The smallest hash of a set is its home; similar sets mostly have the same. A set asks to meet
   another home once for every prefix shingle that it shares with a set there, never once per pair. The requests are summed; those with fewer shared shingles than any similar set
   there would need are dropped.
3. Sets travel to the pairs of homes that are left. Each pair of homes is a unit: a prefix tree is
   built of its sets, and every set walks through it. Overlaps of shared paths are summed once, and
   subtrees that cannot reach the overlap with what is left of both sets are cut off.
4. A unit returns one row per set that has links: how many, and the smallest document among those it
   reaches there. The smallest documents are then followed across units.

Equal sets count as one with a number of copies. A home with very many sets is cut into blocks, so
a unit is bounded.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, arrow_rows, body, shingle_sets, stored
from .components import components

#: Documents whose hash leaves no remainder by this are the sample that tells frequent shingles.
SAMPLE = 16


def needed(a: int, b: int, t: Fraction) -> int:
    """Smallest overlap of sets of a and b items with a Jaccard similarity of t or more."""
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


def prefix_length(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1


def signature(items: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def ordered(items: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    bits = items & np.uint64(len(frequent) * 8 - 1)
    late = (frequent[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return np.concatenate([items[~late], items[late]])


def sets_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, content, n_shingles, sig) of every row; content is a short hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int32()), ("n_shingles", pa.int64()), ("sig", pa.int64())])

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            told = [(len(s), signature(s)) for s in shingle_sets(batch.column(1), width, hasher)]
            yield [batch.column(0), batch.column(2), *([x[k] for x in told] for k in (0, 1))]

    return docs.select("doc_id", body(), content()).mapInArrow(arrow_rows(run, schema), "doc_id long, content int, n_shingles long, sig long")


def content(text: str = "text") -> Column:
    """Tells texts of one doc_id apart; never compared across ids, so 32 bits are plenty and keep the lists of rows small."""
    return F.hash(body(text))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the low bits of the column ``h``, as bytes; the size is fixed by ``bits``."""
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    parts = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(1 << bits, np.uint8)
    for row in parts.collect():  # at most 2**bits / 32768 rows of 4 KB
        # bucket k holds the positions (k - 1) * 32768 + 1 to k * 32768, bucket 0 position 0 alone
        own = np.unpackbits(np.frombuffer(row.m, np.uint8), bitorder="little")
        start = (row.b - 1) * 32768 + 1 if row.b > 0 else 0
        take = own[: max(0, min(len(own), len(out) - start))]
        out[start : start + len(take)] |= take
    return np.packbits(out, bitorder="little")


def bits_for(count: int, most: int = 27) -> int:
    """Sixteen bits for each entry, up to 16 MB; a fuller bitmap only filters less."""
    return min(most, max(16, math.ceil(math.log2(16 * max(count, 1)))))


def frequent_shingles(docs: DataFrame, width: int, often: int) -> np.ndarray:
    """Bitmap of shingles that ``often`` or more of the sampled documents have."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(0)[start : start + 256], width, hasher))
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield [values.view(np.int64), counts]

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", body()), F.lit(SAMPLE)) == 0).select(body())
    counts = sample.mapInArrow(arrow_rows(run, schema), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = stored(counts.filter(F.col("n") >= often).select("h"), "join-frequent")
    return bitmap(found, bits_for(found.count()))


def home_of(least: np.uint64) -> int:
    """Bits of a set's smallest hash. Homes that fall together only make a unit larger."""
    return int(least >> np.uint64(24)) % (1 << 32) - (1 << 31)


def postings(docs: DataFrame, width: int, t: Fraction, frequent: np.ndarray) -> DataFrame:
    """(h, sig, home, n) for the prefix shingles; copies within a task are told once."""
    schema = pa.schema([("h", pa.int64()), ("sig", pa.int64()), ("home", pa.int32()), ("n", pa.int32())])

    def run(batches):
        hasher, told = WordHasher(), set()
        heads, rows, waiting = [], [], 0
        for batch in batches:
            for items in shingle_sets(batch.column(0), width, hasher):
                sig = signature(items)
                if not len(items) or sig in told:
                    continue
                told.add(sig)
                rows.append((sig, home_of(items[0]), len(items)))
                items = ordered(items, frequent)
                heads.append(items[: prefix_length(len(items), t)].copy())
                waiting += len(heads[-1])
                if waiting > 100_000:
                    yield columns(heads, rows)
                    heads, rows, waiting = [], [], 0
        if heads:
            yield columns(heads, rows)

    def columns(heads, rows):
        lengths = [len(x) for x in heads]
        return [np.concatenate(heads).view(np.int64)] + [np.repeat(np.array([r[k] for r in rows], kind), lengths) for k, kind in enumerate((np.int64, np.int32, np.int32))]

    return docs.select(body()).mapInArrow(arrow_rows(run, schema), "h long, sig long, home int, n int")


def requests(rows: DataFrame, t: Fraction) -> DataFrame:
    """(sig, n, home, other): a set asks to meet another home, or others in its own."""
    schema = pa.schema([("sig", pa.int64()), ("home", pa.int32()), ("other", pa.int32()), ("required", pa.int32())])

    def rest(n: int) -> int:
        return n - prefix_length(n, t)

    def group(sigs, homes, sizes, out):
        """Requests of the sets that share one prefix shingle; sizes ascend."""
        seen: dict[int, tuple[int, int]] = {}
        for s, o, n in zip(sigs, homes, sizes):
            seen.setdefault(s, (o, n))
        if len(seen) < 2:
            return
        # per home the lengths there, ascending: whether some fits follows by bisection
        by_home: dict[int, list[int]] = {}
        for o, n in seen.values():
            by_home.setdefault(o, []).append(n)
        for s, (o, n) in seen.items():
            low, high = -(-t.numerator * n // t.denominator), n * t.denominator // t.numerator
            for other, there in by_home.items():
                a = bisect_left(there, low)
                b = bisect_right(there, high, a)
                if b - a < (2 if other == o else 1):
                    continue
                # the overlap needed less the most that lies beyond the prefixes, for the shortest and the
                # longest partner: it grows with the partner's length up to n and falls beyond (but for rounding)
                m, k = there[a], there[b - 1]
                least = needed(n, m, t) - max(rest(n), rest(m))
                if k > n:
                    least = min(least, needed(n, k, t) - rest(k) - 1)
                out.append((s, o, other, max(1, least)))

    def run(batches):
        held = None
        for batch in batches:
            h = batch.column(0).to_numpy()
            columns = [batch.column(c).to_numpy() for c in (1, 2, 3)]
            if held is not None:
                h, columns = np.concatenate([held[0], h]), [np.concatenate([x, y]) for x, y in zip(held[1], columns)]
            if not len(h):
                continue
            # the last shingle may go on in the next batch
            end = int(np.searchsorted(h, h[-1], side="left"))
            held = (h[end:], [c[end:] for c in columns])
            yield from emit(h[:end], [c[:end] for c in columns])
        if held is not None:
            yield from emit(*held)

    def emit(h, columns):
        edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, int)
        shared = np.flatnonzero(np.diff(edges) > 1)
        out: list[tuple[int, int, int, int]] = []
        for k in shared:
            a, b = int(edges[k]), int(edges[k + 1])
            group(*(c[a:b].tolist() for c in columns), out)
            if len(out) > 50_000:
                yield [np.array(c) for c in zip(*out)]
                out = []
        if out:
            yield [np.array(c) for c in zip(*out)]

    met = rows.repartition("h").sortWithinPartitions("h", "n").mapInArrow(arrow_rows(run, schema), "sig long, home int, other int, required int")
    asked = met.groupBy("sig", "home", "other").agg(F.count(F.lit(1)).alias("shared"), F.min("required").alias("required"))
    return asked.filter("shared >= required").select("sig", "home", "other")


class Trie:
    """Prefix tree of sorted sets, as arrays: a node's own items, its parent, and bounds of what is below.

    Items are given as ranks of the unit's own items. A node begins where its set leaves the set before
    it in sorted order, so shared beginnings are stored and counted once.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        parent, items, depth = [-1], [np.empty(0, np.int64)], [0]
        path, before, self.leaf = [0], np.empty(0, np.int64), []

        def node(above: int, own: np.ndarray) -> int:
            parent.append(above)
            items.append(own)
            depth.append(depth[above] + len(own))
            path.append(len(parent) - 1)
            return path[-1]

        for k in self.order:
            own = sets[k]
            m = min(len(before), len(own))
            differs = np.flatnonzero(before[:m] != own[:m])
            common = int(differs[0]) if len(differs) else m
            last = -1
            while depth[path[-1]] > common:
                last = path.pop()
            above = path[-1]
            if depth[above] < common:
                # the path divides inside a node: its upper part becomes a node of its own
                cut = common - depth[above]
                above = node(above, items[last][:cut])
                items[last], parent[last] = items[last][cut:], above
            self.leaf.append(node(above, own[common:]) if len(own) > common else above)
            before = own
        self.parent, self.depth = np.array(parent), np.array(depth)
        self.length = np.array([len(x) for x in items])
        self.starts = np.cumsum(self.length) - self.length
        self.items = np.concatenate(items)
        level = np.zeros(len(parent), int)
        longest = np.zeros(len(parent), int)
        shortest = np.full(len(parent), np.iinfo(np.int64).max)
        for k, leaf in zip(self.order, self.leaf):
            longest[leaf], shortest[leaf] = max(longest[leaf], len(sets[k])), min(shortest[leaf], len(sets[k]))
        by_depth = np.argsort(self.depth, kind="stable")
        for node in by_depth[::-1]:
            if node:
                up = self.parent[node]
                longest[up], shortest[up] = max(longest[up], longest[node]), min(shortest[up], shortest[node])
        for node in by_depth:
            if node:
                level[node] = level[self.parent[node]] + 1
        self.longest, self.shortest = longest, shortest
        self.levels = [np.flatnonzero(level == k) for k in range(1, level.max() + 1)]
        self.last = np.zeros(len(parent), np.int64)
        full = self.length > 0
        self.last[full] = self.items[(self.starts + self.length - 1)[full]]
        self.leaf = np.array(self.leaf)

    def overlaps(self, own: np.ndarray, mark: np.ndarray, t: Fraction) -> np.ndarray:
        """Overlap of a set with every leaf's set, -1 where its subtree was cut off. mark[item]: in the set."""
        n = len(own)
        total = np.full(len(self.parent), -1, np.int64)
        total[0] = 0
        p, q = t.numerator, t.denominator
        for nodes in self.levels:
            nodes = nodes[total[self.parent[nodes]] >= 0]
            if not len(nodes):
                break
            # lengths that cannot be similar, whatever the overlap
            nodes = nodes[(q * self.longest[nodes] >= p * n) & (p * self.shortest[nodes] <= q * n)]
            if not len(nodes):
                break
            length = self.length[nodes]
            ends = np.cumsum(length)
            at = np.repeat(self.starts[nodes] - ends + length, length) + np.arange(int(ends[-1]))
            hits = np.concatenate([[0], np.cumsum(mark[self.items[at]])])
            found = total[self.parent[nodes]] + hits[ends] - hits[ends - length]
            # what is left of either set bounds what may still be added
            left = np.minimum(n - np.searchsorted(own, self.last[nodes], side="right"), self.longest[nodes] - self.depth[nodes])
            least = np.maximum(self.shortest[nodes], -(-p * n // q))
            keep = found + left >= -(-p * (n + least) // (p + q))
            total[nodes[keep]] = found[keep]
        return total[self.leaf]


def link(sets: list[np.ndarray], sides: list[int], copies: list[int], names: list[int], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(documents linked to each set, position of the smallest linked name it reaches; -1 without links).

    Sides: sets of side 0 meet those of side 1, sets of side 2 meet each other.
    """
    values = np.unique(np.concatenate(sets))
    ranks = [np.searchsorted(values, s) for s in sets]
    trie = Trie(ranks)
    order = np.array(trie.order)
    size, side = np.array([len(s) for s in sets])[order], np.array(sides)[order]
    weight, links = np.array(copies)[order], np.zeros(len(sets), np.int64)
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    mark = np.zeros(len(values), np.int64)
    p, q = t.numerator, t.denominator
    for k, own in enumerate(ranks):
        if sides[k] == 1:
            continue
        mark[own] = 1
        overlap = trie.overlaps(own, mark, t)
        mark[own] = 0
        near = (overlap >= 0) & ((p + q) * overlap >= p * (len(own) + size)) & (side != 0 if sides[k] == 0 else side == 2) & (order != k)
        found = order[near]
        links[k] += int(weight[near].sum())
        if sides[k] == 0:
            links[found] += copies[k]
        top = find(k)
        for other in found.tolist():
            other = find(other)
            if other != top:
                root[other] = top
    least: dict[int, int] = {}
    for k in range(len(sets)):
        r = find(k)
        if r not in least or names[k] < names[least[r]]:
            least[r] = k
    reach = np.array([least[find(k)] if links[k] else -1 for k in range(len(sets))])
    return links, reach


def similar_sets(docs: DataFrame, width: int = 5, threshold: Fraction | float = 0.8, often: int = 2, unit_sets: int = 2000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    n_links counts the other rows that are linked directly, copies included; component_id is the
    smallest doc_id reachable by links. A text of fewer words than the width is one shingle; null or
    wordless texts are empty sets, linked with nothing. Repeated rows are copies. A row without
    doc_id is linked and counted like others, but never gives a name: in a component of such rows
    alone component_id is null. Only doc_id and text are read. An empty table gives no rows.
    """
    return linked(docs, width, threshold, often, unit_sets).select("doc_id", "n_shingles", "component_id", "n_links")


def linked(docs: DataFrame, width: int = 5, threshold: Fraction | float = 0.8, often: int = 2, unit_sets: int = 2000) -> DataFrame:
    """``similar_sets`` with each row's text hash and ``root``, one number per group of linked rows, whatever their ids."""
    t = Fraction(threshold).limit_denominator(1000)
    table = stored(sets_table(docs, width), "join-sets")
    groups = table.filter("n_shingles > 0").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    frequent = frequent_shingles(docs, width, often)
    asked = stored(requests(postings(docs, width, t, frequent), t), "join-requests")
    # who travels: found by a fixed-size bitmap in the scan first, then exactly
    bits = bits_for(asked.count())
    travels = bitmap(asked.select(F.col("sig").alias("h")), bits)
    schema = pa.schema([("sig", pa.int64()), ("items", pa.binary())])

    def sets(batches):
        hasher, told, low = WordHasher(), set(), (1 << bits) - 1
        sigs, items, waiting = [], [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0), width, hasher):
                sig = signature(own)
                place = sig & low
                if len(own) and sig not in told and travels[place >> 3] >> (place & 7) & 1:
                    told.add(sig)
                    sigs.append(sig)
                    items.append(ordered(own, frequent).tobytes())
                    waiting += len(items[-1])
                    if waiting > 4 << 20:
                        yield [sigs, items]
                        sigs, items, waiting = [], [], 0
        yield [sigs, items]

    carried = docs.select(body()).mapInArrow(arrow_rows(sets, schema), "sig long, items binary")
    # a unit: the smaller home, the larger home, and a block of each
    unit = asked.join(groups, "sig").select("sig", "n", F.coalesce("name", F.lit((1 << 63) - 1)).alias("name"), "copies", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), (F.col("home") > F.col("other")).alias("right"))
    crowd = unit.groupBy("a", "b").agg(F.count(F.lit(1)).alias("all"), F.count_if("right").alias("r"))
    unit = unit.join(crowd, ["a", "b"]).filter("a = b AND all > 1 OR r > 0 AND r < all")
    split = lambda count: F.greatest(F.lit(1), F.ceil(count / F.lit(unit_sets))).cast("int")
    within = F.col("a") == F.col("b")
    here = F.when(F.col("right"), split(F.col("r"))).otherwise(split(F.col("all") - F.when(within, 0).otherwise(F.col("r"))))
    there = F.when(within, split(F.col("all"))).when(F.col("right"), split(F.col("all") - F.col("r"))).otherwise(split(F.col("r")))
    unit = unit.withColumn("own", F.pmod(F.xxhash64("sig"), here).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), there - 1)))
    # sides: 0 and 1 meet each other, 2 meets itself
    side = F.when(within & (F.col("own") == F.col("met")), 2).when(within, (F.col("own") > F.col("met")).cast("int")).otherwise(F.col("right").cast("int"))
    one = F.when(within, F.least("own", "met")).when(F.col("right"), F.col("met")).otherwise(F.col("own"))
    two = F.when(within, F.greatest("own", "met")).when(F.col("right"), F.col("own")).otherwise(F.col("met"))
    unit = unit.select("sig", "name", "copies", F.xxhash64("a", "b", one, two).alias("unit"), side.alias("side"))
    # copies of a set may travel from several tasks; one of them is enough
    carried = unit.join(carried.groupBy("sig").agg(F.first("items").alias("items")), "sig")
    out = pa.schema([("sig", pa.int64()), ("links", pa.int64()), ("reach", pa.int64())])

    def walk(batches):
        held, now = [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in zip(*(batch.column(c)[start : start + 256].to_pylist() for c in range(6))):
                    if row[0] != now and held:
                        yield from done(held)
                        held = []
                    now = row[0]
                    held.append(row)
        if held:
            yield from done(held)

    def done(rows):
        own = [np.frombuffer(r[5], "<u8") for r in rows]
        links, reach = link_in_order(own, [r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], t, frequent)
        at = np.flatnonzero(links > 0)
        if len(at):
            yield [[rows[k][1] for k in at], links[at], [rows[reach[k]][1] for k in at]]

    ready = carried.select("unit", "sig", "name", "copies", "side", "items").repartition("unit").sortWithinPartitions("unit")
    met = stored(ready.mapInArrow(arrow_rows(walk, out), "sig long, links long, reach long"), "join-links")
    counts = met.groupBy("sig").agg(F.sum("links").alias("links"))
    together = components(met.select(F.col("sig").alias("u"), F.col("reach").alias("v")))
    named = groups.join(counts, "sig", "left").join(together.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.select("sig", "name", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "sig").alias("root"))
    least = named.groupBy("root").agg(F.min("name").alias("component_id"))
    named = stored(named.join(least, "root").select(F.col("sig").alias("_sig"), "root", "component_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "join-named")
    result = table.join(named, (F.col("sig") == F.col("_sig")) & (F.col("n_shingles") > 0), "left")
    single = F.col("_sig").isNull()
    named = F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return result.select("doc_id", "content", "n_shingles", named, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def link_in_order(own: list[np.ndarray], sides, copies, names, t: Fraction, frequent: np.ndarray):
    """``link`` on sets in the global order: items become ranks in that order."""
    values = ordered(np.unique(np.concatenate(own)), frequent)
    place = np.argsort(values, kind="stable")
    return link([place[np.searchsorted(values, s, sorter=place)].astype(np.int64) for s in own], sides, copies, names, t)


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The documents less all but one of each group of linked documents: that of the smallest doc_id.

    All columns stay. Rows are told apart by id and a hash of the text, so an id that stands on several texts loses only those that
    are linked to a row that stays; of one group's rows of the smallest id the one with the smallest text hash stays, of
    repeated rows one. Empty and null texts stay, and so do rows without doc_id.
    """
    from pyspark.sql import Window as W

    found = linked(docs, **options).filter("n_links > 0 AND doc_id IS NOT NULL")
    rows = found.groupBy("root", "doc_id", "content").agg(F.count(F.lit(1)).alias("_rows"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("_first"))
    judged = rows.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), (F.col("_first") == F.struct("doc_id", "content")).alias("_stays"), "_rows")
    # rows that go, or of which one stays: few, so that the others need not be moved for them where the engine sees it
    judged = stored(judged.filter("NOT _stays OR _rows > 1"), "join-dropped")
    told = docs.select(F.struct("*").alias("_doc"))
    match = (F.col("_doc.doc_id") == F.col("_id")) & (content("_doc.text") == F.col("_content"))
    rest = told.join(judged.select("_id", "_content"), match, "left_anti").select("_doc.*")
    twins = told.join(judged.filter("_stays"), match).withColumn("_n", F.row_number().over(W.partitionBy("_id", "_content").orderBy(F.xxhash64("_doc"))))
    return rest.unionByName(twins.filter("_n = 1").select("_doc.*"))
