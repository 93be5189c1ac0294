"""SimHash near-duplicates with BK-trees.

1. Fingerprints: 64-bit majority vote over the XXH64 hashes of a text's word shingles.
2. Distinct fingerprints are dealt into shards that two fingerprints within ``radius`` bits are
   sure to share: the 64 bits are cut into ``blocks`` parts, at most ``radius`` of which can
   differ, so each choice of ``blocks - radius`` parts is one shard key (pigeonhole; exact).  Only as
   many bits of a key are used as make shards of about ``shard_size`` fingerprints, whatever their
   number; where one block hasn't bits enough, there are more blocks.
3. Each shard grows a BK-tree whose children are keyed by integer Hamming distance to their
   parent; a search follows only the edges d - radius .. d + radius.  Links become a spanning
   forest of the shard, at most one edge for each fingerprint, never all pairs.
4. A shard of over ``tree_size`` fingerprints is dealt into several trees; every fingerprint of
   the shard is a query to each of them, so a hot shard becomes many tasks and loses no link.
5. Components over the forest edges; a document's component is the least doc_id in it.

A shard tree is not broadcast: the trees together hold all fingerprints, which mustn't pass through
the driver, so queries go to the tree's task.

Null and empty texts have fingerprint 0 and link like any other.  Null doc_ids are kept in the
result and are never a component's id unless the component has no other.  Repeated rows and equal
fingerprints are one node, each row in the result; very long texts are hashed whole, VOTE_ROWS
shingles at a time.  Only doc_id and text are read, so other columns can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import fitted, let, materialize, ship_by_value, tidy, words
from evidara.llm.components import connected_components
from evidara.llm.mixing import held, row_hash

SEED = 42
VOTE_ROWS = 1 << 15  #: hashes whose bits are summed at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes.lower() is A-Z only, split() the word rule
    if not w:
        return 0
    if len(w) < shingle:
        hashes = [xxh64_intdigest(b" ".join(w), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(shingle)), strict=False)]
    h = np.array(hashes, dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), VOTE_ROWS):
        part = h[i : i + VOTE_ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def add_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long, in one narrow pass over the texts."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), shingle) for t in b.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got, pa.int64())], [*kept, "fp"])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(tidy(run), schema)


class BKTree:
    """Fingerprints in a tree; an edge's key is the Hamming distance of child and parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.index: dict[int, int] = {}
        self.visited = 0  #: nodes that searches have looked at

    def search(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            node = todo.pop()
            self.visited += 1
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = children[node]
            if len(edges) <= 2 * radius:
                todo += [c for k, c in edges.items() if d - radius <= k <= d + radius]
            else:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found

    def add(self, value: int) -> int:
        """Index of the value; one that is there already isn't added again."""
        if value in self.index:
            return self.index[value]
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        self.index[value] = new
        while new:
            d = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = new
                break
            node = below
        return new


class Forest:
    """A BK-tree of (fingerprint, node) pairs with the components of its nodes so far."""

    def __init__(self, radius: int) -> None:
        self.tree, self.nodes, self.up, self.radius = BKTree(), [], [], radius

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _nearest(self, value: int) -> dict[int, int]:
        """Of each component within the radius its nearest node: root to index."""
        best: dict[int, tuple[int, int]] = {}
        for i in self.tree.search(value, self.radius):
            r, d = self.root(i), (self.tree.values[i] ^ value).bit_count()
            if r not in best or (d, i) < best[r]:
                best[r] = (d, i)
        return {r: i for r, (_, i) in best.items()}

    def ask(self, value: int) -> list:
        """One linked node of each component that has any; nothing is inserted."""
        return [self.nodes[i] for i in self._nearest(value).values()]

    def add(self, value: int, node) -> list:
        """Insert a node; one linked node of each component that it joins.

        A node of a value that is there already is linked to the first of that value alone.
        """
        if value in self.tree.index:
            return [self.nodes[self.tree.index[value]]]
        met = self._nearest(value)
        new = self.tree.add(value)
        self.nodes.append(node)
        self.up.append(new)
        for r in met:
            self.up[r] = new
        return [self.nodes[i] for i in met.values()]


def shard_masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` parts out of ``blocks``, of about ``bits`` bits each."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = -(-bits // (blocks - radius))
    parts = [((1 << min(hi, lo + each)) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def shard_plan(n: int, radius: int, shard_size: int) -> tuple[int, int]:
    """(blocks, bits of a key) that put about ``shard_size`` of ``n`` fingerprints into a shard."""
    bits = max(0, (max(1, n) // shard_size).bit_length())
    blocks = radius + 1
    while (blocks - radius) * (64 // blocks) < bits and blocks < 64:
        blocks += 1
    return blocks, bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, node: str = "fp", fingerprints: tuple[str, ...] = ("fp",), radius: int = 3, blocks: int | None = None, tree_size: int = 2000, shard_size: int = 256, rows: int | None = None) -> DataFrame:
    """(a, b): links that span each shard's components among the distinct rows of ``nodes``.

    Two nodes link if any one of their ``fingerprints`` (long columns, compared each with its
    like) differs in at most ``radius`` bits.  Every pair within the radius is joined by a path
    of the returned links, and every returned link is within the radius.  Without ``blocks`` the
    number of nodes (``rows``, if known) decides on the keys; given, keys use all bits of their parts.
    """
    bits = 64
    if blocks is None:
        blocks, bits = shard_plan(nodes.count() if rows is None else rows, radius, shard_size)
    if not 0 <= radius < blocks <= 64:
        raise ValueError("need 0 <= radius < blocks <= 64")
    masks = shard_masks(blocks, radius, bits)
    keys = [F.struct(F.lit(i * len(masks) + j).alias("mask"), F.col(c).bitwiseAND(F.lit(_signed(m))).alias("key"), F.col(c).alias("value")) for i, c in enumerate(fingerprints) for j, m in enumerate(masks)]
    dealt = nodes.select(F.col(node).alias("node"), F.explode(F.array(*keys)).alias("k")).select("node", "k.*")
    sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = dealt.join(sizes, ["mask", "key"])  # a node alone in its shard has nothing to meet
    trees = f"cast(ceil(n / {int(tree_size)}) as int)"
    placed = sized.withColumn("own", F.expr(f"cast(pmod(xxhash64(node, mask), {trees}) as int)")).withColumn("tree", F.explode(F.expr(f"sequence(own, {trees} - 1)")))
    placed = placed.select("mask", "key", "tree", (F.col("own") != F.col("tree")).alias("asks"), "value", "node")
    placed = placed.repartition("mask", "key", "tree").sortWithinPartitions("mask", "key", "tree", "asks", "value", "node")
    kind = nodes.schema[node].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest = None, None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for mask, key, tree, asks, value, own in zip(*cols, strict=True):
                if (mask, key, tree) != shard:
                    shard, forest = (mask, key, tree), Forest(radius)
                value &= 0xFFFFFFFFFFFFFFFF
                for other in forest.ask(value) if asks else forest.add(value, own):
                    a.append(own)
                    b.append(other)
            of = batch.schema.field(5).type
            yield pa.RecordBatch.from_arrays([pa.array(a, of), pa.array(b, of)], ["a", "b"])

    return placed.mapInArrow(tidy(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicate_components(rows: DataFrame, doc_id: str = "doc_id", radius: int = 3, blocks: int | None = None, tree_size: int = 2000) -> DataFrame:
    """Add ``component_id`` to rows of (doc_id, fp, ...): the least doc_id reachable by links."""
    n = rows.count()
    firsts = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("first_doc")), n)
    linked = connected_components(near_links(firsts, radius=radius, blocks=blocks, tree_size=tree_size, rows=n), "a", "b", n)
    named = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.where("component is not null").groupBy("root").agg(F.min("first_doc").alias("least_doc"))
    ids = named.join(least, "root", "left").select("fp", F.coalesce("least_doc", "first_doc").alias("component_id"))
    return fitted(rows.drop("component_id").join(ids, "fp", "left"), n)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int | None = None, tree_size: int = 2000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = materialize(add_fingerprint(docs, shingle=shingle, keep=["doc_id"]))
    out = near_duplicate_components(rows, radius=radius, blocks=blocks, tree_size=tree_size)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, 1024), dtype=np.uint64) | np.array([[0], [1]], np.uint64)  #: xor and odd factor of each order
MIX_ROWS = 1 << 11  #: hashes put into all orders at once
PROFILE_ROWS = 1000  #: documents whose profiles a Python worker holds at once
LOOK = 256  #: texts of a component that are compared at once
SET_ROOM = 4_000_000  #: shingles of one bucket, 32 MB


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key (signed) for each band: ``rows`` minhashes of the set, each under an order of its own."""
    from xxhash import xxh64_intdigest

    k = bands * rows
    least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), MIX_ROWS):
        np.minimum(least, ((hashes[None, i : i + MIX_ROWS] ^ MIX[0, :k, None]) * MIX[1, :k, None]).min(axis=1), out=least)
    return [_signed(xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b)) for b in range(bands)]


def text_profile(text: str | None, shingle: int, bins: int, bands: int = 0, rows: int = 4) -> tuple[int, bytes, list[int], int]:
    """SimHash of a text's word set, a one-permutation minhash of its shingles, their band keys, their number.

    The minhash has one byte a bin, 0 for an empty bin; a text of fewer words than ``shingle``
    is one shingle.  Case of A-Z doesn't count.
    """
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    seen = set(w)
    h = np.fromiter((xxh64_intdigest(x, 1) for x in seen), np.uint64, len(seen))
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), VOTE_ROWS):
        part = h[i : i + VOTE_ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])
    parts = {b" ".join(s) for s in zip(*(w[i:] for i in range(shingle)), strict=False)} if len(w) >= shingle else {b" ".join(w)}
    h = np.sort(np.fromiter((xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)))
    bin_of = (h >> np.uint64(40)) % np.uint64(bins)
    order = np.argsort(bin_of, kind="stable")  # h is sorted, so the first of each bin is its least
    where, first = np.unique(bin_of[order], return_index=True)
    sketch = np.zeros(bins, dtype=np.uint8)
    sketch[where.astype(np.int64)] = (h[order][first] % np.uint64(255)).astype(np.uint8) + 1
    return fp, sketch.tobytes(), band_keys(h, bands, rows), len(parts)


def estimates(sketches: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard indexes of many shingle sets and one by their sketches, and how far they may be off.

    Corrected for chance matches of one byte, and never above what the sets' sizes allow.  The
    second array has three standard errors at an index of 0.8: bins see ``used`` of the union's
    elements without replacement, so a set with far fewer elements than bins is known nearly exactly.
    """
    used = ((sketches | sketch) > 0).sum(axis=1)
    same = ((sketches == sketch) & (sketches > 0)).sum(axis=1)
    most = np.minimum(sizes, size) / np.maximum(np.maximum(sizes, size), 1)
    found = np.minimum(most, np.where(used == 0, 1.0, np.maximum(0.0, (same / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255))))
    used = np.maximum(used, 1)
    union = np.maximum(used, (sizes + size) / 1.8)
    return found, 3 * np.sqrt((0.16 * (1 - used / union) + 0.2 / 255) / used)


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Number of common elements of two sorted arrays of distinct ones."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


class Bucket:
    """Texts met so far, in components of those that are similar enough.

    A text is compared with the first text of every component and, where that one isn't similar
    enough, with the others of it.  By sketches alone a text is similar enough if it may be, and the
    link says whether it is so for sure.  With the shingle sets at hand these decide where the
    sketches leave it open.  Equal texts count once.
    """

    def __init__(self, similarity: float, bins: int, exact: bool = False) -> None:
        self.similarity, self.exact = similarity, exact
        self.nodes, self.groups, self.sets, self.same = [], [], [], {}
        self.sketches, self.sizes = np.zeros((16, bins), dtype=np.uint8), np.zeros(16, dtype=np.int64)

    def _similar(self, among: list[int], sketch: np.ndarray, size: int, parts) -> tuple[np.ndarray, np.ndarray]:
        """Which of the texts ``among`` are similar enough, and which for sure."""
        found, off = estimates(self.sketches[among], self.sizes[among], sketch, size)
        sure, may = found - off >= self.similarity, found + off >= self.similarity
        if self.exact:
            for j in np.nonzero(may & ~sure)[0].tolist():
                common = intersection(self.sets[among[j]], parts)
                may[j] = sure[j] = common >= self.similarity * (self.sizes[among[j]] + size - common)
        return may, sure

    def _met(self, sketch: bytes, size: int, parts) -> list[tuple[int, int, bool]]:
        """Of each component that the text is similar to, its number, the text that shows it, and whether for sure."""
        if not self.groups:
            return []
        s, met = np.frombuffer(sketch, np.uint8), []
        may, sure = self._similar([g[0] for g in self.groups], s, size, parts)
        for k, group in enumerate(self.groups):
            if may[k]:
                met.append((k, group[0], bool(sure[k])))
                continue
            for i in range(1, len(group), LOOK):
                ok, known = self._similar(group[i : i + LOOK], s, size, parts)
                if ok.any():
                    j = int(known.argmax() if known.any() else ok.argmax())
                    met.append((k, group[i + j], bool(known[j])))
                    break
        return met

    def ask(self, sketch: bytes, size: int, parts=None) -> list:
        """(text, sure) of each component that the text is similar to; nothing is inserted."""
        return [(self.nodes[i], sure) for _, i, sure in self._met(sketch, size, parts)]

    def add(self, sketch: bytes, size: int, node, parts=None) -> list:
        """The same, and the text is inserted."""
        twin = self.same.get((sketch, size))
        if twin is not None:
            if self.exact:
                if np.array_equal(self.sets[twin], parts):
                    return [(self.nodes[twin], True)]
            else:
                _, sure = self._similar([twin], np.frombuffer(sketch, np.uint8), size, None)
                return [(self.nodes[twin], bool(sure[0]))]
        met = self._met(sketch, size, parts)
        i = len(self.nodes)
        if i == len(self.sketches):
            self.sketches, self.sizes = np.concatenate([self.sketches, np.zeros_like(self.sketches)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sketches[i], self.sizes[i] = np.frombuffer(sketch, np.uint8), size
        self.nodes.append(node)
        self.sets.append(parts)
        self.same.setdefault((sketch, size), i)
        joined = {k for k, _, _ in met}
        merged = [j for k in sorted(joined) for j in self.groups[k]] + [i]
        self.groups = [g for k, g in enumerate(self.groups) if k not in joined] + [merged]
        return [(self.nodes[j], sure) for _, j, sure in met]


LINKS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("sure", T.BooleanType())])


def _links_in_buckets(sized: DataFrame, similarity: float, bins: int, exact: bool) -> DataFrame:
    """(a, b, sure) from rows of (key, trees, node, sketch, n) and, if ``exact``, the sorted set ``x``.

    The texts of a key are dealt into so many trees, each of which all texts of the key are compared with.
    """
    wide = ["node", "sketch", "n", *(["x"] if exact else [])]
    rows = sized.withColumn("own", F.expr("cast(pmod(xxhash64(node, key), trees) as int)")).withColumn("tree", F.explode(F.expr("sequence(own, cast(trees - 1 as int))")))
    rows = rows.select("key", "tree", (F.col("own") != F.col("tree")).alias("asks"), *wide)
    rows = rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "asks", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for batch in (whole.slice(i, PROFILE_ROWS) for whole in batches for i in range(0, whole.num_rows, PROFILE_ROWS)):
            a, b, c = [], [], []
            for k, (key, tree, asks, own, sketch, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)):
                if (key, tree) != at:
                    at, bucket = (key, tree), Bucket(similarity, bins, exact)
                parts = batch.column(6)[k].values.to_numpy().copy() if exact else None
                for other, sure in bucket.ask(sketch, n, parts) if asks else bucket.add(sketch, n, own, parts):
                    a.append(own)
                    b.append(other)
                    c.append(sure)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.bool_())], LINKS.names)

    return rows.mapInArrow(tidy(run), LINKS)


def similar_links(texts: DataFrame, similarity: float, bins: int, tree_size: int = 2000) -> DataFrame:
    """(a, b, sure): links that span, in each band, the components of texts that may be similar.

    Texts are rows of (node, bands, sketch, n).  Every two texts that share a band key and may be
    similar by their sketches are joined by a path of the returned links.  A band key of over
    ``tree_size`` texts is dealt into several buckets.
    """
    dealt = texts.select("node", F.explode("bands").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.expr(f"cast(ceil(m / {int(tree_size)}) as int)").alias("trees"))
    return _links_in_buckets(dealt.join(sizes, "key").join(texts.select("node", "sketch", "n"), "node"), similarity, bins, False)


def _tested(links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure): the links whose two texts are, or may be, similar enough by their sketches."""
    ends = lambda side: texts.select(F.col("node").alias(side), F.col("sketch").alias(f"s_{side}"), F.col("n").alias(f"n_{side}"))
    sides = links.join(ends("a"), "a").join(ends("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok, sure = [], []
            for x, y, m, n in zip(*(t.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b")), strict=True):
                found, off = estimates(np.frombuffer(x, np.uint8)[None], np.array([m]), np.frombuffer(y, np.uint8), n)
                ok.append(bool(found[0] + off[0] >= similarity))
                sure.append(bool(found[0] - off[0] >= similarity))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(sure, pa.bool_())], LINKS.names).filter(pa.array(ok, pa.bool_()))

    return sides.select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(tidy(run), LINKS)


def shingle_set(text, shingle: int):
    """Distinct hashes of a text's word shingles, as ``text_profile`` takes them."""
    from evidara.llm.url_filters import ascii_lower

    def of(w):
        each = F.transform(F.sequence(F.lit(1), F.size(w) - shingle + 1), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(shingle))))
        return F.when(F.size(w) < shingle, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array_distinct(each))

    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), of)


def _node(text: str = "text"):
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _exact_links(open_: DataFrame, docs: DataFrame, texts: DataFrame, similarity: float, bins: int, shingle: int, tree_size: int) -> DataFrame:
    """(a, b): links that span the components of similar texts inside each group of ``open_`` (node, root).

    A group of over ``tree_size`` texts, or of over SET_ROOM shingles, is dealt into several buckets.
    """
    some = materialize(open_.join(texts.select("node", "first_doc", "sketch", "n"), "node"))
    wanted = held(some.select(F.col("node").alias("w_node"), "first_doc"), "w_node")
    one = docs.select("doc_id", "text", _node().alias("t_node")).join(wanted, (F.col("t_node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    sets = one.groupBy("w_node").agg(F.first("text").alias("text")).select("w_node", F.sort_array(shingle_set(F.col("text"), shingle)).alias("x"))
    sizes = some.groupBy("root").agg(F.expr(f"cast(greatest(ceil(count(1) / {int(tree_size)}), ceil(sum(n) / {SET_ROOM})) as int)").alias("trees"))
    rows = some.join(sizes, "root").join(sets, F.col("node") == F.col("w_node")).withColumnRenamed("root", "key")
    return _links_in_buckets(rows, similarity, bins, True).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, tree_size: int = 2000, bins: int = 512, bands: int = 16, band_rows: int = 4) -> DataFrame:
    """(node, first_doc, root): the group of every distinct text; node is the text's MD5.

    Candidates: texts whose word sets' SimHashes differ in at most ``radius`` bits (BK-trees as
    above), and texts that share one of ``bands`` keys of ``band_rows`` minhashes of the shingles.
    The latter find a pair of Jaccard index J with a chance of 1 - (1 - J^band_rows)^bands, 0.9998
    at 0.8, whatever the edit.  One-permutation minhashes of ``bins`` bins tell which candidates are
    similar for sure and, within three standard errors of ``similarity``, which may be.  Components
    of both are groups; those that hold any open link are taken apart once more, by the shingle
    sets themselves.  So every candidate pair is decided, and no more than a forest of them is written.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        for b in (whole.slice(i, PROFILE_ROWS) for whole in batches for i in range(0, whole.num_rows, PROFILE_ROWS)):
            got = [text_profile(t.as_py(), shingle, bins, bands, band_rows) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds))], schema.names)

    rows = docs.select("doc_id", "text", _node().alias("node")).mapInArrow(tidy(run), schema)
    texts = materialize(rows.groupBy("node", "fp", "sketch", "bands", "n").agg(F.min("doc_id").alias("first_doc")))
    total = texts.count()
    links = _tested(near_links(texts, "node", radius=radius, tree_size=tree_size, rows=total).distinct(), texts, similarity)
    links = materialize(links.unionByName(similar_links(texts, similarity, bins, tree_size)).groupBy("a", "b").agg(F.max("sure").alias("sure")), total)
    groups = materialize(connected_components(links, "a", "b", total).withColumnRenamed("component", "root"), total)
    doubt = links.where("not sure").join(groups, F.col("a") == F.col("node")).select("root").distinct()
    open_ = materialize(groups.join(doubt, "root", "left_semi").select("node", "root"), total)
    if open_.limit(1).count():
        exact = connected_components(_exact_links(open_, docs, texts, similarity, bins, shingle, tree_size), "a", "b", total)
        again = open_.select("node").join(exact, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
        groups = groups.join(doubt, "root", "left_anti").select("node", "root").unionByName(again)
    return texts.join(groups, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, tree_size: int = 2000, bins: int = 512, bands: int = 16, band_rows: int = 4) -> DataFrame:
    """``docs`` without near-duplicates (see ``near_copies``): of each group its least doc_id stays, once.

    Of several texts with that doc_id the least MD5 stays, and of several rows with that text, too,
    the one of the least hash over all columns, so reruns agree.  Null texts are empty texts, and
    equal to texts of white space only; a null doc_id stays only if its group has no other.  Extra
    columns are carried and may have any name.  An empty table gives an empty result.

    The texts stay where they are unless the table of decisions is too large to broadcast.
    """
    named = materialize(near_copies(docs, shingle, similarity, radius, tree_size, bins, bands, band_rows))
    stay = named.groupBy("root").agg(F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "node")).alias("s")).select(F.col("s.node").alias("s_node"))
    won = named.join(stay, F.col("node") == F.col("s_node"), "left").select("node", "first_doc", F.col("s_node").isNotNull().alias("wins"))
    seen = docs.select("doc_id", _node().alias("t_node")).groupBy("t_node", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    rows_of = seen.groupBy("t_node").agg(F.sum("m").alias("m"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m")).alias("first"))
    both = won.join(rows_of, F.col("node") == F.col("t_node")).where("not wins or m > 1")
    decided = materialize(both.select(F.col("node").alias("d_node"), F.col("first_doc").alias("d_doc"), F.col("wins").alias("d_wins"), (F.col("wins") & (F.col("first.m") > 1)).alias("d_torn")))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", _node().alias("t_node"), row_hash(docs).alias("_hash"))
    joined = marked.join(held(decided, "d_node"), F.col("t_node") == F.col("d_node"), "left")
    kept = joined.where(F.col("d_node").isNull() | (F.col("d_wins") & F.col("doc_id").eqNullSafe(F.col("d_doc"))))
    out = kept.where(~F.coalesce("d_torn", F.lit(False))).select("_row.*")
    if not decided.where("d_torn").limit(1).count():
        return out
    return out.unionByName(kept.where("d_torn").groupBy("t_node").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*"))


ship_by_value(__name__)
