"""N-gram Jaccard join with signature trees.

A document is the set of its 5-word shingles, as 64-bit hashes with a key of the run. Two sets of similarity t or more
share k shingles among the first |x| - ceil(t |x|) + k of each, in any order that all sets keep to; frequent shingles come
last in ours, and k grows with the size. Sets that share fewer than that with all others together have no partner. The
least set of the others that share an early shingle names a group, and all that share one of its shingles
meet there; so two similar sets meet in some group, and copies count as one set. A group is searched with
a signature tree: leaves hold sets, nodes the OR of their token bitmaps and the range of their sizes. A dual
traversal from the root leaves out node pairs whose greatest possible overlap is too small, and pairs that are already
connected; the others are compared by their whole sets.

A group too large for a task is dealt into blocks, which are searched one by one. A few sets of each component that this
finds are then searched together, which joins the components of a group of near copies. Only sets outside of a group's
largest component still have unsearched partners in other blocks: they meet every block. So a group of near copies
costs its own size, and no link is lost.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import words as W
from strandmill.llm.bpe import pack, unpack
from strandmill.llm.shared import batches, drop, keep, numbered, skew_join, string_buffers

N = 5
PERCENT = 80
BATCH = 4 << 20
FREQUENT, SEEN = 1 << 16, 4  # how many frequent shingles come last; in how many sets of a batch one must be
GROUP, GROUP_WORDS, SPEAKERS = 128, 1 << 20, 4  # sets and shingles of a block; sets that stand for a component
SHARE = 20
FEW = 1 << 20  # rows of numbers, any group of which fits a task
FAN, LEAF = 8, 32
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, key: bytes, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, the text of each, and where each text's begin and end.

    A text with fewer words than n has one shingle of all of them; one without words has none.
    """
    data = W.lower(data)
    starts, ends, first = W.words(data, offsets)
    h = W.hashes(data, starts, ends, key)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    last = len(h) - n + 1
    if last > 0:
        total = np.full(last, n, np.uint64)
        for k in range(n):
            total += h[k : last + k] * _STEPS[k]
        whole = np.arange(last) + n <= first[1:][text[:last]]
        found, owner = [W.mixed(total[whole])], [text[:last][whole]]
    else:
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    short = np.flatnonzero((count > 0) & (count < n))
    for size in range(1, n):
        some = short[count[short] == size]
        total = np.full(len(some), size, np.uint64)
        for k in range(size):
            total += h[first[some] + k] * _STEPS[k]
        found.append(W.mixed(total))
        owner.append(some)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, owner, np.searchsorted(owner, np.arange(len(count) + 1))


def set_names(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that depends on its members alone; 0 for the empty set."""
    size = np.diff(begin)
    parts = []
    for salt in (0x51ED270B, 0xA24BAED4):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mixed(found ^ np.uint64(salt)), dtype=np.uint64)))
        parts.append(sums[begin[1:]] - sums[begin[:-1]])
    names = W.mixed(parts[0] ^ W.mixed(parts[1] + size.astype(np.uint64)))
    return np.where(size > 0, np.where(names == 0, np.uint64(1), names), np.uint64(0))


def shared_least(size):
    """How many early shingles two sets of the size, or one of them larger, must share."""
    return 1 + size // SHARE


NODES = ["uid", "doc_id", "n", "node", "hot", "seen"]


def _nodes(n: int, key: bytes):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            found, _, begin = shingle_sets(*string_buffers(batch.column("text")), key, n)
            names = set_names(found, begin)
            _, once = np.unique(names, return_index=True)
            of_once = np.concatenate([found[begin[i] : begin[i + 1]] for i in once]) if len(once) else found
            hot, seen = np.unique(of_once, return_counts=True)
            hot, seen = hot[seen >= SEEN], seen[seen >= SEEN]
            some = np.argsort(-seen, kind="stable")[:FREQUENT]
            more = len(batch) * [None]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(np.diff(begin)), pa.array(names.view(np.int64)), pa.array(more, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))], names=NODES)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 4 + [pa.array([hot[some].view(np.int64)]), pa.array([seen[some].astype(np.int64)])], names=NODES)

    return run


def _prefixes(n: int, percent: int, parts: int, hot: np.ndarray, key: bytes):
    """Early shingles with their sets, by the part that a shingle belongs to. What sets a frequent shingle is in needs
    no search, so these pairs are dealt by shingle and set, and no part holds all sets of one."""
    order = np.argsort(hot)
    ordered, rank = hot[order], order.astype(np.int64) + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH):
            found, owner, begin = shingle_sets(*string_buffers(batch.column("text")), key, n)
            names = set_names(found, begin)
            _, once = np.unique(names, return_index=True)
            late = np.zeros(len(found), np.int64)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
                late = np.where(ordered[at] == found, rank[at], 0)
            place = np.lexsort((found, late, owner))
            size = np.diff(begin)
            length = np.where(size > 0, size - (percent * size + 99) // 100 + shared_least(size), 0)
            keep_set = np.zeros(len(size), bool)
            keep_set[once] = True
            early = (np.arange(len(found)) - begin[owner] < length[owner]) & keep_set[owner]
            token, node = found[place[early]], names[owner[early]]
            often = late[place[early]] > 0
            part = (np.where(often, W.mixed(token ^ node), token) >> np.uint64(40)).astype(np.int64) * parts >> 24
            slot = 2 * part + often
            by = np.argsort(slot, kind="stable")
            full, at = np.unique(slot[by], return_index=True)
            cut = np.split(by, at[1:]) if len(full) else []
            yield pa.RecordBatch.from_arrays([pa.array((full >> 1).astype(np.int32)), pa.array(full % 2 == 1), pa.array([pack(token[c]) for c in cut], pa.binary()), pa.array([pack(node[c]) for c in cut], pa.binary())], names=["part", "often", "tokens", "nodes"])

    return run


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The early shingles that several sets have, with each of these; a task may hold several parts."""
    held: dict[tuple, list] = {}
    for batch in rows:
        for part, often, tokens, nodes in zip(*(batch.column(c).to_pylist() for c in ("part", "often", "tokens", "nodes"))):
            held.setdefault((part, often), []).append((unpack(tokens, np.uint64), unpack(nodes, np.uint64)))
    for (_, often), some in held.items():
        token, node = (np.concatenate(x) for x in zip(*some))
        by = np.lexsort((node, token))
        token, node = token[by], node[by]
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node = token[new].view(np.int64), node[new].view(np.int64)
        if not often:
            again = np.append(False, token[1:] == token[:-1])
            again[:-1] |= again[1:]
            token, node = token[again], node[again]
        for a in range(0, len(token), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(token[a : a + 100_000]), pa.array(node[a : a + 100_000])], names=["token", "node"])


class SignatureTree:
    """Sets in leaves; each node has the OR of their bitmaps, their least and greatest size, and the most members
    of one set that its bitmap doesn't show because they share bits."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        small = np.fromiter((s[0] for s in sets), np.uint64, len(sets))  # sets alike mostly have the same least member
        self.order = np.lexsort((size, small))
        self.size = size[self.order]
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, k in enumerate(self.order):
            bit = (sets[k] >> np.uint64(3)) % np.uint64(bits)
            np.bitwise_or.at(self.maps[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.hidden = self.size - np.bitwise_count(self.maps).sum(axis=1)
        self.levels = [self._level(self.maps, self.size, self.size, self.hidden, LEAF)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._level(*self.levels[-1], FAN))

    @staticmethod
    def _level(maps, low, high, hidden, fan):
        cut = np.arange(0, len(low), fan)
        return np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut)


def most_overlap(a, b, rows_a, rows_b) -> np.ndarray:
    """The greatest possible overlap of a set under each of rows_a of a with one under each of rows_b of b."""
    shown = np.bitwise_count(a[0][rows_a][:, None, :] & b[0][rows_b][None, :, :]).sum(axis=2, dtype=np.int64)
    hidden = np.minimum(a[3][rows_a][:, None], b[3][rows_b][None, :])
    return np.minimum(shown + hidden, np.minimum(a[2][rows_a][:, None], b[2][rows_b][None, :]))


def _may(a, b, rows_a, rows_b, percent: int) -> np.ndarray:
    """Where the greatest overlap is enough for the least sizes, and the ranges of sizes allow the similarity."""
    least = a[1][rows_a][:, None] + b[1][rows_b][None, :]
    enough = (100 + percent) * most_overlap(a, b, rows_a, rows_b) >= percent * least
    enough &= 100 * a[2][rows_a][:, None] >= percent * b[1][rows_b][None, :]
    return enough & (100 * b[2][rows_b][None, :] >= percent * a[1][rows_a][:, None])


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = k = parent[parent[k]]
    return k


def search(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all that is linked: pairs of places in left (and right, counted on after left's).

    A pair of sets is linked when 100 * overlap >= percent * union. With right None, pairs within left. Pairs that
    earlier links connect are left out, as are those of sets with the same known component. Sets are sorted arrays
    without repeats and not empty.
    """
    if not left or right is not None and not right:
        return []
    largest = max(len(s) for s in left + (right or []))
    bits = 1 << min(max(int(2 * largest).bit_length(), 8), 16)
    a = SignatureTree(left, bits)
    b, shift = (a, 0) if right is None else (SignatureTree(right, bits), len(left))
    everything = left + (right or [])
    first: dict[int, int] = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(known)] if known else list(range(len(everything)))
    links: list[tuple[int, int]] = []

    def leaves(i: int, j: int) -> None:
        rows_a, rows_b = np.arange(i * LEAF, min((i + 1) * LEAF, len(a.size))), np.arange(j * LEAF, min((j + 1) * LEAF, len(b.size)))
        names_a, names_b = a.order[rows_a].tolist(), (b.order[rows_b] + shift).tolist()
        root_a, root_b = np.array([_find(parent, k) for k in names_a]), np.array([_find(parent, k) for k in names_b])
        if len(set(root_a) | set(root_b)) == 1:
            return
        one = (a.maps, a.size, a.size, a.hidden)
        two = (b.maps, b.size, b.size, b.hidden)
        may = _may(one, two, rows_a, rows_b, percent) & (root_a[:, None] != root_b[None, :])
        for p, q in zip(*np.nonzero(may)):
            x, y = names_a[p], names_b[q]
            if _find(parent, x) == _find(parent, y):
                continue
            s, t = everything[x], everything[y]
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[_find(parent, x)] = _find(parent, y)
                links.append((x, y))

    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    todo = [(top_a, 0, top_b, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        if not la and not lb:
            leaves(i, j)
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        rows_a = np.arange(i * FAN, min((i + 1) * FAN, len(a.levels[la - 1][1]))) if down_a else np.array([i])
        rows_b = np.arange(j * FAN, min((j + 1) * FAN, len(b.levels[lb - 1][1]))) if down_b else np.array([j])
        la, lb = la - down_a, lb - down_b
        for p, q in zip(*np.nonzero(_may(a.levels[la], b.levels[lb], rows_a, rows_b, percent))):
            i2, j2 = int(rows_a[p]), int(rows_b[q])
            if right is not None or la != lb or i2 <= j2:
                todo.append((la, i2, lb, j2))
    return links


def _join(n: int, percent: int, key: bytes):
    """Links of a group of rows (right, node, root, text): within the rows that aren't right, or of these with those that are."""

    def run(group: pa.Table) -> pa.Table:
        sides: tuple[dict, dict] = {}, {}
        roots: dict[int, int] = {}
        for batch in batches(iter(group.combine_chunks().to_batches()), BATCH):
            found, _, begin = shingle_sets(*string_buffers(batch.column("text")), key, n)
            for k, (node, right, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "right", "root")))):
                sides[right][node] = found[begin[k] : begin[k + 1]].copy()
                roots[node] = root
        left, right = sides
        ids = [*left, *right]
        two = group.column("two")[0].as_py()
        links = search(list(left.values()), list(right.values()) if two else None, percent, [roots[i] for i in ids])
        return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})

    return run


def _met(rows: DataFrame, groups: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """rows (of numbers) joined to groups, as by skew_join; up to FEW rows, whose largest group fits a task, without its broadcasts."""
    return rows.join(groups.hint("merge"), on) if total <= FEW else skew_join(rows, groups, on, count, total)


def _round(pairs: DataFrame, total: int) -> DataFrame:
    """pairs with a node's larger neighbours, then its smaller ones, hung on the least of them.

    A node's own row in a round is its least neighbour, so rows of a node with very many neighbours are joined to it by skew_join.
    Up to FEW rows are shuffled by node instead, once for each step: what an exchange or a broadcast takes of the driver stays with it.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if total <= FEW:
        least = F.min("b").over(Window.partitionBy("a"))
        large = both.withColumn("m", F.least("a", least)).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        met = large.repartition("a").distinct().withColumn("m", least)
        moved = met.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        return keep(moved.where("a <> b").distinct(), "components")
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    large = skew_join(both, least, "a", "_n", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = keep(large, "components")
    least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    small = skew_join(large, least, "a", "_n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    after = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
    drop(large)
    return after


def components(links: DataFrame) -> DataFrame:
    """node and root of all nodes of links (a, b): the least node that links reach.

    The number of rounds grows with the logarithm of the longest chain.
    """
    pairs = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before, many = None, pairs.count()
    while True:
        last, pairs = pairs, _round(pairs, max(2 * many, 1))
        drop(last)
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, many = state, state[0]


def _blocks(size, words):
    """How many blocks a group of so many sets with so many shingles is dealt into."""
    return F.ceil(F.greatest(F.col(size) / GROUP, F.col(words) / GROUP_WORDS)).cast("int")


def _of(blocks, seed: int = 3):
    return F.pmod(F.xxhash64("node", F.lit(seed)), blocks).cast("int")


def _large_groups(members: DataFrame, links: DataFrame, texts: DataFrame, find, total: int) -> DataFrame:
    """The links of groups that were dealt into blocks, with those of their blocks.

    members: hub, node, n, block; texts: node, text; find: links of rows (hub, x, y, two, right, node, root, text).
    """

    def now(links: DataFrame) -> DataFrame:
        """members with the root of each node's component."""
        roots = components(links)
        return keep(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-members")

    found = now(links)
    while True:  # sets that stand for components, a block of a group at a time, until nothing joins
        order = Window.partitionBy("hub", "root").orderBy(F.xxhash64("node"), "node")
        few = found.groupBy("hub", "root", F.pmod(F.xxhash64("node"), F.lit(64)).alias("p")).agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n")).alias("s"))
        speakers = few.select("hub", "root", "s.node", "s.n").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SPEAKERS).drop("k")
        sizes = speakers.groupBy("hub").agg(F.count_distinct("root").alias("roots"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).where("roots > 1")
        met = _met(speakers, sizes, "hub", "size", total).withColumn("x", F.pmod(F.xxhash64("root"), _blocks("size", "words")).cast("int"))
        met = met.select("hub", "x", F.lit(0).alias("y"), F.lit(False).alias("two"), F.lit(False).alias("right"), "node", "root")
        more = keep(find(met.join(texts, "node")), "jaccard-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = now(links)

    counts = found.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("c"))
    per_hub = counts.groupBy("hub").agg(F.max(F.struct("c", F.col("root").alias("giant"))).alias("g"), F.sum("c").alias("size")).where("g.c < size")
    words = found.groupBy("hub").agg(F.max("block").alias("top"), F.sum("n").alias("words"))
    per_hub = keep(per_hub.join(words, "hub").select("hub", "size", "g.giant", (F.col("top") + 1).alias("blocks"), _blocks("size", "words").alias("most"), (F.col("size") - F.col("g.c")).alias("strays")), "jaccard-hubs")
    if per_hub.isEmpty():
        return links
    own = _met(found, per_hub, "hub", "size", total).withColumn("chunks", F.ceil(F.col("most") * F.col("strays") / F.col("size")).cast("int"))
    left = own.select("hub", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("y"), F.lit(True).alias("two"), F.lit(False).alias("right"), "node", "root")
    strays = own.where("root <> giant").withColumn("y", _of(F.col("chunks"), 5))
    right = strays.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "y", F.lit(True).alias("two"), F.lit(True).alias("right"), "node", "root")
    return links.unionByName(keep(find(left.unionByName(right).join(texts, "node")), "jaccard-links"))


def jaccard_links(rows: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The sets of rows (uid, doc_id, text), as uid, doc_id, n, node, and links a, b between nodes, which connect all that is linked.

    rows is a table whose uid is never repeated. Sets with equal members are one node, a 64-bit hash of them.
    """
    key = secrets.token_bytes(16)
    parts = max(rows.rdd.getNumPartitions(), 16)
    made = keep(rows.mapInArrow(_nodes(n, key), "uid long, doc_id long, n long, node long, hot array<long>, seen array<long>"), "jaccard-nodes")
    nodes = made.where("n IS NOT NULL").select("uid", "doc_id", "n", "node")
    each = made.where("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "seen")).alias("x")).select("x.hot", "x.seen")
    often = each.groupBy("hot").agg(F.sum("seen").alias("s")).orderBy(F.desc("s"), "hot").limit(FREQUENT).collect()  # FREQUENT rows at most
    hot = np.array([r["hot"] for r in reversed(often)], np.int64).view(np.uint64)

    early = rows.mapInArrow(_prefixes(n, percent, parts, hot, key), "part int, often boolean, tokens binary, nodes binary").repartitionById(parts, F.col("part"))
    pairs = keep(early.mapInArrow(_shared, "token long, node long"), "jaccard-shared")
    first = keep(nodes.where("n > 0").groupBy("node").agg(F.min("uid").alias("uid"), F.first("n").alias("n")), "jaccard-first")
    least = 1 + F.floor(F.floor(F.col("n") * percent / 100) / SHARE)
    able = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("s")).join(first, "node").where(F.col("s") >= least).select("node", "n")
    shared = keep(pairs.join(able, "node"), "jaccard-shared")
    drop(pairs)
    tokens = shared.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    total = max(shared.count(), 1)
    each = _met(shared, tokens, "token", "rows", total).groupBy("hub", "node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    # two similar sets share at least `least` shingles; if each leaves groups in which it has under half of that, one is left
    weak = F.sum("c").over(Window.partitionBy("node").orderBy("c", "hub").rowsBetween(Window.unboundedPreceding, 0))
    meet = keep(each.withColumn("weak", weak).where(F.col("weak") * 2 > least - 1).select("hub", "node", "n"), "jaccard-meetings")
    sizes = meet.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).where("size > 1")
    meet = _met(meet, sizes.withColumn("blocks", _blocks("size", "words")), "hub", "size", total)
    meet = keep(meet.select("hub", "node", "n", "blocks", _of(F.col("blocks")).alias("block")), "jaccard-groups")
    drop(shared)

    def find(met: DataFrame) -> DataFrame:
        return met.groupBy("hub", "x", "y").applyInArrow(_join(n, percent, key), "a long, b long")

    hubs = meet.groupBy("node").agg(F.collect_list(F.struct("hub", "block")).alias("hubs"))
    asked = first.select("node", "uid").join(hubs, "node")  # grows with the table, so it is never broadcast
    texts = rows.select("uid", "text").join(asked.hint("merge"), "uid").select("node", "text", F.explode("hubs").alias("h"))
    links = keep(find(texts.select("h.hub", F.col("h.block").alias("x"), F.lit(0).alias("y"), F.lit(False).alias("two"), F.lit(False).alias("right"), "node", F.col("node").alias("root"), "text")), "jaccard-links")
    large = meet.where("blocks > 1").drop("blocks")
    if not large.isEmpty():
        large = keep(large, "jaccard-large")
        asked = first.select("node", "uid").join(large.select("node").distinct(), "node")
        own = keep(rows.select("uid", "text").join(asked.hint("merge"), "uid").select("node", "text"), "jaccard-large-texts")
        links = _large_groups(large, links, own, find, total)
    return nodes, links


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """uid, doc_id, n, root of the rows with shingles."""
    full, total = nodes.where("n > 0"), max(nodes.count(), 1)
    each = full.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).join(components(links), "node", "left")
    each = each.select("node", "rows", F.coalesce("root", "node").alias("root"))
    return keep(_met(full, each, "node", "rows", total).drop("node", "rows"), "jaccard-roots")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Null and empty texts have no shingles and no links; their
    component is their own id. Rows that repeat an id are sets of their own, with the id in common. Rows without an id
    link as others do; the component is the smallest id that links reach, null if they reach none. An empty table gives no rows;
    further columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(slim.withColumn("uid", F.monotonically_increasing_id()), "jaccard-rows")
    nodes, links = jaccard_links(rows, n, percent)
    rooted = _rooted(nodes, links)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    out = _met(rooted, least, "root", "members", max(rooted.count(), 1)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(nodes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked to one that stays, directly or by others, with their columns.

    Of each group of linked rows the one with the smallest doc_id stays, null last; of several that have it, any. Rows
    whose texts are null or have no words are linked with nothing and all stay. Other columns may have any names.
    """
    rows, uid = numbered(docs)
    slim = rows.select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes, links = jaccard_links(slim, n, percent)
    rooted = _rooted(nodes, links)
    stay = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("s"))
    kept = stay.select(F.col("s.uid").alias(uid)).unionByName(nodes.where("n = 0").select(F.col("uid").alias(uid)))
    return rows.join(kept, uid, "left_semi").select(*docs.columns)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
