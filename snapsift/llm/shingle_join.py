"""Operator 9: n-gram Jaccard join in prefix trees.

Documents are sets of hashed ``SHINGLE``-word shingles in one global order, that of the hashes.
Equal sets are one node. The join has three steps.

1. Candidates. If two sets differ in at most k shingles, one of k + 1 hash buckets is the same in
   both. Every set emits the hashes of its buckets (for its size class, and for the next one if a
   partner may lie there); sets with an equal bucket are hung on the smallest of them, first within
   a batch, then over the corpus. Nothing emits pairs within a bucket.
2. The candidate links make groups that can't be linked with each other. Only sets in groups are
   moved on, each once.
3. In each group, sets are stored in a trie and all sets traverse it together: overlaps are counted
   once along shared prefixes, and a set leaves a subtree when the remaining lengths can't reach
   the threshold. Groups of more than ``BLOCK`` sets are first
   compared with one of their sets; only the sets that don't link with it are joined, block by
   block, with the group.

Buckets of fewer than two shingles are not emitted, or frequent shingles would tie unrelated
texts; small sets are bucketed several times over to make up for it (see ``_salts``).

Defined results: a text of fewer words than ``SHINGLE`` is one shingle; null or wordless text is
the empty set, linked with nothing, and a component of its own; equal texts are linked; a null
doc_id is never the smallest; an empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import store
from ..functions.skew import small_side
from .components import connected_components
from .registry import query, table
from .words import SPACED, combine, lean, mix, pieces, slices, window_hashes

SHINGLE = 4
#: Percent of the union that the intersection of linked sets has at least.
PERCENT = 85
#: Sets of a group that are joined in one trie.
BLOCK = 512
#: Shingles of a block of a larger group, about: sets move once per block that they meet.
BLOCK_SHINGLES = 1 << 19


def _size_class(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """First and last size of the class of ``n``; a class ends where linked sizes differ thrice."""
    first = 1
    while True:
        last = max(6, first * 100**3 // percent**3)
        if n <= last:
            return first, last
        first = last + 1


def _classes(n: int, percent: int = PERCENT) -> list[int]:
    """Last sizes of the classes in which a set of ``n`` shingles has partners at least as large."""
    own = _size_class(n, percent)[1]
    largest = n * 100 // percent
    return [own] if largest <= own else [own, _size_class(own + 1, percent)[1]]


def _buckets(last: int, percent: int = PERCENT) -> int:
    """One more than the shingles in which linked sets of at most ``last`` can differ."""
    return 2 * last * (100 - percent) // (100 + percent) + 1


def _salts(n: int, percent: int = PERCENT) -> int:
    """Times that a set is bucketed: a borderline pair is lost with a chance of under about 1e-6.

    Below ``PERCENT``, sets of a few shingles have partners, with which they share buckets of two only by luck.
    """
    return 16 if n < 8 and percent < PERCENT else 8 if n < 24 else 4 if n < 80 else 2 if n < 300 else 1


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for piece in pieces(column, SPACED):
        hashes = piece.hashes(lower=True)
        windows = window_hashes(hashes, shingle)
        for low, high in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True):
            n = high - low
            if n >= shingle:
                yield np.unique(windows[low:high - shingle + 1])
            elif n:
                short = hashes[low:low + 1]
                for k in range(low + 1, high):
                    short = combine(short, hashes[k:k + 1])
                yield short ^ np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    total = mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(shingles))).view(np.int64)[0])


def bucket_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the set's buckets, for every class and salt."""
    n, out = len(shingles), []
    for last in _classes(n, percent):
        m = _buckets(last, percent)
        for salt in range(_salts(n, percent) if m > 1 else 1):
            value = mix(shingles + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64))
            bucket = ((value >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            start = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            sums = np.add.reduceat(mix(value[order]), start)
            size = np.diff(start, append=n)
            name = np.uint64(last) * np.uint64(1 << 24) + np.uint64(salt << 20) + bucket[order][start].astype(np.uint64)
            good = (size > 1) | (m == 1)
            out.append(combine(sums[good] + size[good].astype(np.uint64), mix(name[good])))
    return np.concatenate(out).view(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _first_of_each(group: np.ndarray, node: np.ndarray):
    """Rows sorted by group and node: which begin a group, and the first node of each row's group."""
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    return first, node[np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))]


def _emit(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Per batch: a row per document, a row per distinct bucket, and links within the batch."""
    for batch in slices(batches, 2):
        sets = list(shingle_sets(batch.column(2), shingle))
        n = np.array([len(s) for s in sets], np.int64)
        keys = [set_key(s) if len(s) else None for s in sets]
        none = lambda size: pa.nulls(size, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n), pa.array(keys, pa.int64()), none(len(sets)), none(len(sets))],
            ["doc_id", "text_hash", "n", "node", "bucket", "least"],
        )
        distinct = {k: s for k, s in zip(keys, sets, strict=True) if k is not None}
        if not distinct:
            continue
        buckets = [bucket_keys(s, percent) for s in distinct.values()]
        node = np.repeat(np.array(list(distinct), np.int64), [len(b) for b in buckets])
        bucket = np.concatenate(buckets)
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        first, least = _first_of_each(bucket, node)
        rows = int(first.sum())
        for at in range(0, rows, 100_000):
            part = slice(at, at + 100_000)
            size = min(rows - at, 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, batch.column(0).type), none(size), none(size), pa.array(node[first][part]), pa.array(bucket[first][part]), none(size)],
                ["doc_id", "text_hash", "n", "node", "bucket", "least"],
            )
        a, b = _pairs(node[~first], least[~first])
        a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(a), batch.column(0).type), none(len(a)), none(len(a)), pa.array(a), none(len(a)), pa.array(b)],
            ["doc_id", "text_hash", "n", "node", "bucket", "least"],
        )


def _hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and node: link every node of a bucket with its first."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        bucket, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first, least = _first_of_each(bucket, node)
        if last is not None and bucket[0] == last[0]:
            least = np.where(bucket == last[0], last[1], least)
        last = bucket[-1], least[-1]
        a, b = _pairs(node, least)
        apart = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])


class _Node:
    __slots__ = ("path", "children", "sets", "least_n", "rest")

    def __init__(self, path: np.ndarray):
        self.path, self.children, self.sets = path, {}, []
        self.least_n, self.rest = 1 << 62, 0


class Trie:
    """Ordered sets in a path-compressed trie."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.root = _Node(np.zeros(0, np.uint64))
        self.sizes: dict[int, int] = {}

    def insert(self, number: int, shingles: np.ndarray) -> None:
        node, at, n = self.root, 0, len(shingles)
        self.sizes[number] = n
        while True:
            node.least_n, node.rest = min(node.least_n, n), max(node.rest, n - at)
            if at == n:
                node.sets.append(number)
                return
            head = int(shingles[at])
            child = node.children.get(head)
            if child is None:
                child = node.children[head] = _Node(shingles[at:])
                at = n
            else:
                size = min(len(child.path), n - at)
                differ = np.flatnonzero(child.path[:size] != shingles[at:at + size])
                shared = int(differ[0]) if len(differ) else size
                if shared < len(child.path):
                    upper = _Node(child.path[:shared])
                    upper.children[int(child.path[shared])] = child
                    upper.least_n, upper.rest = child.least_n, child.rest + len(child.path) - shared
                    child.path = child.path[shared:]
                    node.children[head] = child = upper
                at += shared
            node = child

    def partners(self, probes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For each stored set, the positions of the probes that are linked with it, if any.

        All probes walk the trie together: a node adds its path's overlap to each probe that is
        still in reach, and those that can't reach the threshold any more stay behind.
        """
        n = np.array([len(s) for s in probes], np.int64)
        words, place = np.unique(np.concatenate(probes), return_inverse=True)
        holds = np.zeros((len(words), len(probes)), np.uint8)
        holds[place, np.repeat(np.arange(len(probes)), n)] = 1
        used_by = np.zeros((len(words) + 1, len(probes)), np.int32)
        np.cumsum(holds, axis=0, out=used_by[1:])
        stack = [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64))]
        while stack:
            node, alive, overlap, used = stack.pop()
            need = -(-self.percent * (n[alive] + node.least_n) // (100 + self.percent))
            near = overlap + np.minimum(n[alive] - used, node.rest + len(node.path)) >= need
            alive, overlap, need = alive[near], overlap[near], need[near]
            if not len(alive):
                continue
            if len(node.path):
                at = np.searchsorted(words, node.path)
                known = at < len(words)
                at = at[known][words[at[known]] == node.path[known]]
                overlap = overlap + holds[at][:, alive].sum(axis=0, dtype=np.int64)
                used = used_by[np.searchsorted(words, node.path[-1], "right"), alive]
                near = overlap + np.minimum(n[alive] - used, node.rest) >= need
                alive, overlap, used = alive[near], overlap[near], used[near]
                if not len(alive):
                    continue
            else:
                used = used[near]
            for number in node.sets:
                union = n[alive] + self.sizes[number] - overlap
                linked = alive[100 * overlap >= self.percent * union]
                if len(linked):
                    yield number, linked
            stack.extend((child, alive, overlap, used) for child in node.children.values())


#: Cells of the tables with which probes walk a trie; more probes walk in turns.
WALK_CELLS = 1 << 24


def trie_links(probes: list[np.ndarray], stored: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Positions (probe, stored) of linked sets."""
    trie = Trie(percent)
    for i, shingles in enumerate(stored):
        trie.insert(i, shingles)
    first = 0
    while first < len(probes):
        last, words = first, 0
        while last < len(probes) and (last == first or (words + len(probes[last])) * (last + 1 - first) <= WALK_CELLS):
            words += len(probes[last])
            last += 1
        for number, linked in trie.partners(probes[first:last]):
            for i in linked.tolist():
                yield first + i, number
        first = last


def spanning(links: Iterator[tuple[int, int]], size: int) -> list[int]:
    """For positions below ``size``, the smallest one that links connect each with."""
    root = list(range(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(size)]


def join_group(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The smallest member of each set's component, by position."""
    return spanning(trie_links(sets, sets, percent), len(sets))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Consecutive rows with equal keys (all but the last three columns), over batches."""
    name, rows = None, []
    for batch in batches:
        keys = list(zip(*[c.to_pylist() for c in batch.columns[:-3]], strict=True))
        sides, nodes = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
        sets = batch.column(batch.num_columns - 1)
        for i, key in enumerate(keys):
            if key != name:
                if rows:
                    yield name, rows
                name, rows = key, []
            rows.append((sides[i], nodes[i], sets[i].values.to_numpy().view(np.uint64)))
    if rows:
        yield name, rows


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*pairs, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _join_small(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches):
        distinct = {node: shingles for _, node, shingles in rows}
        nodes = list(distinct)
        yield _links([(nodes[i], nodes[r]) for i, r in enumerate(join_group(list(distinct.values()), percent)) if i != r])


def _join_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that connect the sets of a block that are left (side 0) and of a block of the group (side 1)."""
    for _, rows in _groups(batches):
        left = {node: s for side, node, s in rows if side == 0}
        right = {node: s for side, node, s in rows if side == 1}
        names = [*left, *right]
        found = ((i, len(left) + j) for i, j in trie_links(list(left.values()), list(right.values()), percent))
        yield _links([(names[i], names[r]) for i, r in enumerate(spanning(found, len(names))) if i != r])


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(root, node, shingles) of the wanted (doc_id, text_hash, node, root); a doc_id may be null."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), shingle))
            nodes = batch.column(1).to_pylist()
            good = [i for i, s in enumerate(sets) if len(s) and set_key(s) == nodes[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good, pa.int64())), pa.array([nodes[i] for i in good], pa.int64()), pa.array([sets[i].view(np.int64) for i in good], pa.list_(pa.int64()))],
                ["root", "node", "shingles"],
            )

    asked = small_side(wanted.withColumnsRenamed({"doc_id": "_id", "text_hash": "_of"}))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_of"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(asked, here).select("root", "node", "text")
    return rows.mapInArrow(lean(build), "root long, node long, shingles array<long>")


def _join_large(large: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the groups of more than ``BLOCK`` sets as all links would.

    The sets linked with the group's first one are connected; links are missing only from the
    others, which are joined with the whole group.
    """
    pivots = large.join(small_side(sizes.select("root", "pivot")), "root").filter("node = pivot").select("root", "pivot", F.col("shingles").alias("_pivot"))
    shared = F.size(F.array_intersect("shingles", "_pivot"))
    compared = large.join(small_side(store(pivots.dropDuplicates(["root"]))), "root").withColumn(
        "near", 100 * shared >= percent * (F.size("shingles") + F.size("_pivot") - shared)
    )
    compared = store(compared.drop("_pivot"))
    near = compared.filter("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    size = F.size("shingles")
    blocks = lambda total: F.greatest(F.ceil(total / BLOCK_SHINGLES), F.lit(1))
    counts = store(compared.groupBy("root").agg(F.sum(size).alias("n"), F.coalesce(F.sum(F.when(~F.col("near"), size)), F.lit(0)).alias("n_left")).filter("n_left > 0").select(
        "root", blocks(F.col("n")).alias("blocks"), blocks(F.col("n_left")).alias("left_blocks"),
    ))
    blocked = compared.join(small_side(counts), "root").withColumn("_draw", F.xxhash64("node"))
    left = blocked.filter(~F.col("near")).select(
        "root", F.pmod("_draw", "left_blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"),
        F.lit(0).alias("side"), "node", "shingles",
    )
    whole = blocked.select(
        "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)).alias("i"), F.pmod("_draw", "blocks").alias("j"),
        F.lit(1).alias("side"), "node", "shingles",
    )
    pairs = left.unionByName(whole).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "node")
    return near.union(pairs.mapInArrow(lean(partial(_join_blocks, percent=percent)), "a long, b long"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components by shingles of ``shingle`` words of which linked documents share ``percent``: doc_id, text_hash, n_shingles, node and component of every document, and its smallest member.

    ``text_hash`` is ``xxhash64`` of the text. ``component`` and ``first`` (doc_id, text_hash of the
    smallest member) are null for documents that are linked with none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    emitted = store(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(lean(partial(_emit, shingle=shingle, percent=percent)), f"doc_id {kind}, text_hash long, n long, node long, bucket long, least long")
    )
    rows = emitted.filter("n is not null").select("doc_id", "text_hash", "n", "node")
    hung = (
        emitted.filter("bucket is not null").select("bucket", "node").repartition("bucket")
        .sortWithinPartitions("bucket", "node").mapInArrow(lean(_hang), "a long, b long")
    )
    near = emitted.filter("least is not null").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = store(connected_components(hung.union(near)))
    # A set is fetched from the row with the smallest doc_id, or from one without any.
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("h")
    wanted = store(rows.groupBy("node").agg(holder).join(groups, "node").select("h.doc_id", "h.text_hash", "node", "root"))
    sets = store(_sets_of(docs, wanted, shingle))
    sizes = wanted.groupBy("root").agg(F.count(F.lit(1)).alias("n_sets"), F.min("node").alias("pivot"))
    big = store(sizes.filter(F.col("n_sets") > BLOCK))
    small = sets.join(small_side(big.select("root")), "root", "left_anti")
    found = small.select("root", F.lit(0).alias("side"), "node", "shingles").repartition("root").sortWithinPartitions("root", "node").mapInArrow(lean(partial(_join_small, percent=percent)), "a long, b long")
    if not big.isEmpty():
        found = found.union(_join_large(sets.join(small_side(big.select("root")), "root", "left_semi"), big, percent))
    linked = connected_components(found)
    rows = rows.join(linked.select("node", "root"), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    rows = store(rows)
    several = store(
        rows.filter("component is not null").groupBy("component")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first")).filter("_n > 1").drop("_n")
    )
    return rows.join(small_side(several), "component", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", F.when(F.col("first").isNotNull(), F.col("component")).alias("component"), "first",
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id, then text hash.

    Rows that repeat both doc_id and text are one document. Texts without a word all stay.
    """
    found = store(jaccard_components(docs, shingle, percent))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    lost = small_side(store(found.filter(F.col("first").isNotNull() & ~same).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of")).distinct()))
    again = small_side(store(
        found.filter("node is not null").groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"))
    ))
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    kept = keyed.join(lost, here, "left_anti")
    once = kept.join(again, here, "left_anti").select("_row.*")
    return once.union(kept.join(again, here, "left_semi").dropDuplicates(["doc_id", "_hash"]).select("_row.*"))


_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.a, l.y FROM r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON r.b = l.x)
  SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = d.doc_id
"""


@query("op9_jaccard_join", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked documents."""
    found = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
