"""N-gram Jaccard join with a MinHash LSH forest.

A document is the set of its word shingles. Documents with equal sets are copies and go on as one representative.
Each tree of the forest is a trie of MinHash signatures, written once and sorted by prefix; two documents meet in a
tree if their signatures share a prefix. Matching starts at the deepest level. What meets is verified exactly on the
whole sets; the similarities of the links found tell how many more the forest is expected to hold, and how far the
matched prefixes have to be shortened to reach the target recall. Signatures aren't made again for that, and candidate
components that a shorter prefix doesn't change keep their results.

No pairs are written out. Documents that meet are tied to the smallest of their trie node, which makes candidate
components; a component is cut into blocks, bounded by documents and by shingles, of documents that share a node, and
all links of two blocks that have a node in common are found by counting shared shingles. Each block gives one row per
document: how many links, and the smallest document that they lead to. Where classes are asked for without counts of
links, blocks are paired with one block of each node first, and with others only where a node isn't of one class yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Sieve, doc_view, materialize, parts, texts

WORDS = 5
#: Similarity from which documents are linked, as a fraction.
SIMILAR = (4, 5)
TREES = 36
#: Levels of a trie at which matching starts and to which prefixes may be shortened.
DEEPEST, FLOOR = 10, 6
TARGET_RECALL = 0.9999
#: Documents and shingles of one block; a task sees two blocks. A document with more shingles is a block by itself.
BLOCK, SHINGLES = 256, 1 << 18
#: Cells of the incidence matrix that verification has in memory at once.
CELLS = 1 << 21
#: Words whose hashes a task remembers.
WORDS_KEPT = 100_000
#: Links are told apart by similarity, in percent from this on.
PERCENT = 100 * SIMILAR[0] // SIMILAR[1]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(31)


class Shingler:
    """Shingle sets of texts as sorted hashes; remembers the hashes of words."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        known = self.words
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : k + n]) * _FACTOR
            out ^= out >> _SHIFT
        return np.unique(out * _MIX)


def _permutations(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, trees * depth), dtype=np.uint64)
    return seeds[0], seeds[1] | np.uint64(1)


def paths(sets: list[np.ndarray], trees: int, floor: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (non-empty) set and tree: the hash of its signature down to the floor, and 8 bits of each level below
    that, the deepest last."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    xors, factors = _permutations(trees, deepest)
    work = np.empty_like(flat)
    nodes, below = np.empty((len(sets), trees), np.uint64), np.zeros((len(sets), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(sets), t + 1, np.uint64)
        for k in range(deepest):
            np.bitwise_xor(flat, xors[t * deepest + k], out=work)
            np.multiply(work, factors[t * deepest + k], out=work)
            least = np.minimum.reduceat(work, starts)
            if k < floor:
                key = (key ^ least) * _FACTOR
                key ^= key >> _SHIFT
            else:
                below[:, t] = below[:, t] << np.uint64(8) | least & np.uint64(255)
        nodes[:, t] = key
    return nodes, below


def signatures(docs: DataFrame, trees: int, floor: int, deepest: int) -> DataFrame:
    """For each row: id (doc_id, or NULL_ID), h1 and h2 (hash of the set), n (shingles), and paths() of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in parts(batches, 64):
            sets = list(map(shingler, texts(b)))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            own = [k for k, s in enumerate(sets) if len(s)]
            trie: list[list[list[int]]] = [[[] for _ in sets] for _ in range(2)]
            if own:
                for column, found in zip(trie, paths([sets[k] for k in own], trees, floor, deepest), strict=True):
                    for k, row in zip(own, found.view(np.int64).tolist(), strict=True):
                        column[k] = row
            ids = [NULL_ID if x is None else x for x in b.column(0).to_pylist()]
            columns = [pa.array(ids, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(map(len, sets), pa.int64())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in trie]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h1", "h2", "n", "nodes", "below"])

    return doc_view(docs).mapInArrow(run, "id bigint, h1 bigint, h2 bigint, n bigint, nodes array<bigint>, below array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """id, root for every id of the edges (a, b): root is the smallest id that it is connected with.

    Alternates large and small stars: each id hands the smallest of its neighbours to the others. Hubs are fine: what
    goes through the shuffle for an id is a minimum, and the join back is one that Spark can split.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))
        edges = materialize(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = state


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each shingle that two or more of the sets have, and the number of columns."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times > 1
    number = np.cumsum(keep) - 1
    stay = keep[column]
    return row[stay], number[column[stay]], int(keep.sum())


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets in left shares with each in right."""
    if len(sets) == 2:
        return np.array([[len(np.intersect1d(sets[a], sets[b], True)) for b in right] for a in left], np.float32)
    row, column, width = _shared(sets)
    total = np.zeros((len(left), len(right)), np.float32)
    step = max(1, CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), min(step, width - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        total += part[left] @ part[right].T
    return total


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n is connected with by the links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_LINKS = "id bigint, links bigint, root bigint, percents array<int>"
_LINKS_ARROW = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("percents", pa.list_(pa.int32()))])


def verify(members: DataFrame) -> DataFrame:
    """members: i, j (two blocks, or one twice), side (0: of i), id, shingles. For each id with links: how many, the
    smallest id that they lead to, and how many of those to larger ids there are of each percent of similarity."""
    up, down = SIMILAR

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        # Repeated rows of a document are one member.
        first = {(i, s.tobytes()): k for k, (i, s) in reversed(list(enumerate(zip(ids.tolist(), sets, strict=True))))}
        own = sorted(first.values(), key=lambda k: ids[k])
        ids, sets, side = ids[own], [sets[k] for k in own], table["side"].to_numpy()[own]
        within = table["i"][0].as_py() == table["j"][0].as_py()
        left = np.arange(len(own)) if within else np.flatnonzero(side == 0)
        right = left if within else np.flatnonzero(side == 1)
        if not len(left) or not len(right) or len(own) < 2:
            return _LINKS_ARROW.empty_table()
        sizes = np.array(list(map(len, sets)), np.float32)
        same = intersections(sets, left, right)
        both = sizes[left][:, None] + sizes[right][None, :]
        a, b = np.nonzero((up + down) * same >= up * both)
        percent = (100 * same[a, b] / (both[a, b] - same[a, b])).astype(np.int64) - PERCENT
        a, b = left[a], right[b]
        keep = (ids[a] != ids[b]) & ((a < b) if within else True)
        a, b, percent = a[keep], b[keep], percent[keep]
        if not len(a):
            return _LINKS_ARROW.empty_table()
        n = np.bincount(a, minlength=len(own)) + np.bincount(b, minlength=len(own))
        wide = 101 - PERCENT
        percents = np.bincount(a * wide + percent, minlength=len(own) * wide).reshape(-1, wide)
        root, linked = _roots(len(own), a, b), np.flatnonzero(n)
        columns = [ids[linked], n[linked], ids[root[linked]], percents[linked].astype(np.int32).tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, _LINKS_ARROW.types, strict=True)], schema=_LINKS_ARROW)

    return members.groupBy("i", "j").applyInArrow(run, _LINKS)


def recall(percents: list[int], trees: int, found_at: int, depth: int) -> float:
    """Of the links that the forest holds, the share expected to meet at a depth, estimated from those found at
    another, each standing for as many as its chance to be found tells."""
    s = (PERCENT + np.arange(len(percents))) / 100
    chance = lambda d: 1 - (1 - s**d) ** trees
    held = np.array(percents) / chance(found_at)
    return float((held * chance(depth)).sum() / held.sum()) if held.sum() else 1.0


def _at(depth: int, deepest: int) -> list[Column]:
    """The prefix of a path down to a depth."""
    return [F.col("node"), F.shiftrightunsigned("below", 8 * (deepest - depth)).alias("below")]


def _placed(candidates: DataFrame, matched: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """candidates: id, n, root; matched: id, node, below (a shared prefix). The block of each candidate (id, block),
    and of those in components of several blocks the nodes too (id, block, node).

    A component that fits in a block is one. Of a larger one, the documents of one node, the first of theirs, stay
    together, as a block or several, or in one of the blocks for small nodes.
    """
    fit = lambda docs, shingles: F.ceil(F.greatest(docs / F.lit(block), shingles / F.lit(SHINGLES))).cast("int")
    sums = (F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    size = candidates.groupBy("root").agg(*sums).select("root", fit(F.col("docs"), F.col("shingles")).alias("blocks"))
    sized = candidates.join(size, "root")
    one = sized.where("blocks = 1").select("id", F.col("root").alias("block"))
    large = sized.where("blocks > 1")
    nodes = matched.join(large.select("id"), "id", "left_semi").select("id", F.xxhash64("node", "below").alias("node"))
    home = large.join(nodes.groupBy("id").agg(F.min("node").alias("home")), "id")
    dealt = home.groupBy("root", "home").agg(*sums).select("root", "home", fit(F.col("docs"), F.col("shingles")).alias("own"))
    place = F.when(F.col("own") > 1, F.xxhash64("root", "home", F.pmod(F.xxhash64("id"), F.col("own")))).otherwise(
        F.xxhash64("root", F.pmod(F.xxhash64("home", F.lit(1)), 2 * F.col("blocks")))
    )
    many = home.join(dealt, ["root", "home"]).select("id", place.alias("block"))
    many = materialize(many)
    return materialize(one.unionAll(many)), nodes.join(many, "id")


def _alone(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("block").alias("i"), F.col("block").alias("j")).distinct()


def _links(docs: DataFrame, candidates: DataFrame, matched: DataFrame, block: int) -> DataFrame:
    """verify() of every block and of all pairs of blocks that have a node in common."""
    placed, shared = _placed(candidates, matched, block)
    met = shared.select("node", "block").distinct()
    pairs = met.withColumnRenamed("block", "i").join(met.withColumnRenamed("block", "j"), "node").where("i < j").select("i", "j").distinct()
    return verify(_members(docs, placed, materialize(_alone(placed).unionAll(pairs))))


def _ties(docs: DataFrame, candidates: DataFrame, matched: DataFrame, block: int) -> DataFrame:
    """verify() of as many pairs of blocks as the classes need: each block, and each block with the first of every node
    that it has; then, of nodes whose documents aren't of one class by then, the pairs of blocks that hold several. A
    group of near copies of one text is mostly one class after the first step, which grows with the group, not with its
    square; the links that are left out lie within a class."""
    placed, shared = _placed(candidates, matched, block)
    met = shared.select("node", "block").distinct()
    first = met.groupBy("node").agg(F.min("block").alias("i"))
    stars = met.join(first, "node").where("i < block").select("i", F.col("block").alias("j")).distinct()
    begun = materialize(_alone(placed).unionAll(stars))
    found = materialize(verify(_members(docs, placed, begun)))
    if begun.where("i < j").isEmpty():
        return found
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    root = F.coalesce("root", "id")
    held = shared.join(roots, "id", "left").groupBy("node", "block").agg(F.min(root).alias("lo"), F.max(root).alias("hi"))
    held = materialize(held)
    mixed = held.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("node")
    held = held.join(mixed, "node", "left_semi")
    i, j = (held.select("node", F.col("block").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in "ij")
    several = F.least("lo_i", "lo_j") < F.greatest("hi_i", "hi_j")
    pairs = i.join(j, "node").where((F.col("i") < F.col("j")) & several).select("i", "j").distinct()
    pairs = materialize(pairs.join(begun, ["i", "j"], "left_anti"))
    return found.unionAll(verify(_members(docs, placed, pairs)))


def _members(docs: DataFrame, placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The shingle sets of the candidates, once for each pair of blocks that they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in parts(batches):
            sets = [shingler(t).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 2)), pa.array(sets, pa.binary())], names=["id", "block", "shingles"])

    own = doc_view(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    own = Sieve(placed).part(own, F.col("id")).join(placed, "id").select("id", "text", "block")
    sets = own.mapInArrow(run, "id bigint, block bigint, shingles binary")
    asked = pairs.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side"))
    asked = asked.unionAll(pairs.where("i <> j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    return sets.join(asked, "block").select("i", "j", "side", "id", "shingles")


@dataclass
class Joined:
    """rows: id, h1, h2, n of each document. sets: h1, h2, rep of each different set. found: id, links, root, percents
    of verify(). depths: the levels that were tried."""

    rows: DataFrame
    sets: DataFrame
    found: DataFrame
    depths: list[int]


def join(docs: DataFrame, target: float = TARGET_RECALL, trees: int = TREES, deepest: int = DEEPEST, floor: int = FLOOR, block: int = BLOCK, count: bool = True) -> Joined:
    """The links between different sets; see similar_classes(). From deepest to floor there are 8 levels at most.
    count: find all links; otherwise those that make the classes, and links are only counted as far as met."""
    if not 0 < floor <= deepest <= floor + 8:
        raise ValueError("levels below the floor are 8 bits each of one bigint")
    rows = materialize(signatures(docs, trees, floor, deepest))
    sets = materialize(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value(F.struct("nodes", "below")).alias("trie")))
    tries = sets.select("rep", "n", F.explode(F.arrays_zip("trie.nodes", "trie.below")).alias("t")).select(F.col("t.nodes").alias("node"), F.col("t.below").alias("below"), F.col("rep").alias("id"), "n")
    shared = tries.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least != last")
    forest = materialize(tries.join(shared.select("node"), "node", "left_semi").sortWithinPartitions("node", "below"))
    depth, depths, before, found = deepest, [], None, None
    while True:
        depths.append(depth)
        prefix = forest.select("id", "n", *_at(depth, deepest))
        met = prefix.groupBy("node", "below").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least != last")
        matched = materialize(prefix.join(met.select("node", "below", "least"), ["node", "below"]))
        roots = components(matched.select(F.col("id").alias("a"), F.col("least").alias("b")))
        candidates = materialize(roots.join(matched.select("id", "n").distinct(), "id"))
        sums = (F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("check"))
        state = materialize(candidates.groupBy("root").agg(*sums))
        todo = candidates
        if before is not None:
            # Components of one block are verified in all pairs, so those that are as they were need no more.
            same = state.join(before, state.columns, "left_semi").where((F.col("docs") <= block) & (F.col("shingles") <= SHINGLES))
            old = candidates.join(same.select("root"), "root", "left_semi").select("id")
            found, todo = found.join(old, "id", "left_semi"), candidates.join(same.select("root"), "root", "left_anti")
        new = (_links if count else _ties)(docs, todo, matched, block)
        found, before = materialize(new if found is None else found.unionAll(new)), state
        percents = found.agg(*(F.coalesce(F.sum(F.get("percents", F.lit(k))), F.lit(0)) for k in range(101 - PERCENT))).first()
        if depth == floor or recall(percents, trees, depth, depth) >= target:
            return Joined(rows, sets, found, depths)
        depth = next((d for d in range(depth - 1, floor, -1) if recall(percents, trees, depth, d) >= target), floor)


def similar_classes(docs: DataFrame, **how) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, copy_id (the smallest doc_id with an equal set), class_id (the
    smallest copy_id that links lead to), n_links (copy_ids, other than its own, at a similarity of 0.8 or more).

    Shingles are five consecutive words, or all words of a shorter text; A-Z in lower case. Null, empty and blank
    texts have none and are copies of each other. Rows with the same doc_id are one document with the links of all of
    them; null doc_ids are one document, larger than all others, whose null stands in class_id and copy_id too. An
    empty table gives none. Further columns are left out. how: parameters of join().

    A component of candidates of more than ``block`` documents is verified in pairs of blocks, so a task holds two
    blocks at most; each of its documents is written once for each block that has a trie node in common with its own.
    """
    got = join(docs, **how)
    links = got.found.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    # A component that was one block has its final roots; those of others go through the roots of each block.
    more = got.found.select("id", "root").where("id <> root").distinct()
    more = materialize(more)
    if more.groupBy("id").count().where("count > 1").isEmpty() and more.join(more.select(F.col("id").alias("root")), "root", "left_semi").isEmpty():
        linked = links
    else:
        linked = links.drop("root").join(components(more.select(F.col("id").alias("a"), F.col("root").alias("b"))), "id", "left")
    classes = got.sets.select("h1", "h2", "rep").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    known = lambda c: F.when(c != NULL_ID, c)
    return got.rows.join(classes, ["h1", "h2"]).select(
        known(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        known(F.col("rep")).alias("copy_id"),
        known(F.coalesce("root", "rep")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their class: its smallest doc_id. Of repeated rows of
    that doc_id, the first by text stays. Only texts that may go are shuffled. With count=False links within a
    class are left out, and a large group of near copies takes no work in its square. See similar_classes()."""
    classes = similar_classes(docs, **how)
    id_ = F.coalesce("doc_id", F.lit(NULL_ID))
    ids = classes.groupBy(id_.alias("__id")).agg(F.count("*").alias("__rows"), F.min(F.coalesce("class_id", F.lit(NULL_ID))).alias("__class"))
    odd = materialize(ids.where("__id <> __class OR __rows > 1").select("__id", (F.col("__id") == F.col("__class")).alias("__stays")))
    own = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)))
    sieve = Sieve(odd, "__id")
    whole, some = sieve.part(own, F.col("__key"), False), sieve.part(own, F.col("__key"))
    once = whole.unionAll(some.join(odd, some["__key"] == odd["__id"], "left_anti")).select(docs.columns)
    again = odd.where("__stays")
    if again.isEmpty():
        return once
    first = Window.partitionBy("__key").orderBy("text")
    some = some.join(again, some["__key"] == again["__id"], "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.unionAll(some.select(docs.columns))
