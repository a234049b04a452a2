"""Near-duplicates by the similarity of five-word shingles, found by ball hashing and verified.

Shingle fingerprints of similar texts are too far apart for a ball that can be hashed: at a similarity of 0.8 an
edited word changes five shingles. It changes one word. Each different text therefore has TABLES fingerprints of its
different words, which stay within the radius of a similar text's; these emit their balls (see simhash.py), and what
collides is a candidate. A 64-bit fingerprint of the shingles travels with each and drops what is far from similar.
Of a bucket's candidates a few spanning forests of the nearest pairs stay, and each text's pairs with the texts that
most others are near to, as edited copies of one text are closer to it than to each other; the sets of shingles then
decide. Texts of which a candidate did not stay are marked: where such texts of a bucket are not all connected by then,
every pair of them that is not connected is decided by its sets too, within a task that returns links only. A large
group so costs as much as its texts, but for the comparisons.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import RangeHashes, as_bytes, fresh, kept, map_batches, scratch, word_runs, written
from .graph import components
from .simhash import ball, ball_size, deal, weight

#: Words of a shingle.
SHINGLE = 5
#: Word fingerprints of a text, the bits of each, and the bits in which they may differ.
TABLES, PRINT_BITS, RADIUS = 2, 44, 4
#: Bits in which the shingle fingerprints of candidates may differ: 9.7 are expected at a similarity of 0.8, 32 by chance.
CHECK_RADIUS = 22
#: Of a bucket's candidates stay so many edge-disjoint spanning forests, and so many central texts of each.
FORESTS, HUBS = 2, 3
#: Bits of the shingle fingerprint within which a text counts as near to a central one.
HUB_RADIUS = 11
#: Candidate pairs in memory before all but the forests are dropped.
PAIRS_AT_ONCE = 1_000_000
#: Shingles of the texts that a task compares with each other; larger groups are cut into blocks, and each pair of blocks meets.
SHINGLES_AT_ONCE = 8_000_000


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that more than half of the rows of 64-bit hashes (rows, columns) have set, as one row."""
    n, columns = hashes.shape
    ones = np.zeros(columns * 64, np.int64)
    for k in range(0, n, 255):
        ones += np.unpackbits(hashes[k : k + 255].view(np.uint8).reshape(-1, columns * 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def shingle_sets(words: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The different shingle hashes of each list of words, sorted; a shorter list is one shingle, an empty one has none."""
    seen: dict[bytes, int] = {}
    for own in words:
        for w in own:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
    ranges = RangeHashes(np.fromiter((seen[w] for own in words for w in own), np.uint64, sum(map(len, words))))
    at = 0
    for own in words:
        first = np.arange(at, at + max(1, len(own) - SHINGLE + 1)) if own else np.empty(0, np.int64)
        yield np.unique(ranges(first, np.minimum(first + SHINGLE, at + len(own))))
        at += len(own)


def lowered(texts: list[bytes | None]) -> list[bytes]:
    """A-Z in lower case, words separated by single spaces."""
    return [b" ".join((t or b"").lower().split()) for t in texts]


def marks(docs: DataFrame) -> DataFrame:
    """(row, content, prints, check) for each row of docs (row, text): 128 bits of its words, word fingerprints (null without words), shingle fingerprint."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = lowered(as_bytes(batch.column(1)))
        content, prints, check = [hashlib.md5(t).hexdigest() for t in texts], [], []
        for _, _, words in word_runs(texts):
            for own, shingles in zip(words, shingle_sets(words)):
                if not own:
                    prints.append(None)
                    check.append(0)
                    continue
                hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, set(own))), np.uint64).reshape(-1, TABLES)
                prints.append((majority(hashed) & np.uint64((1 << PRINT_BITS) - 1)).view(np.int64).tolist())
                check.append(majority(shingles[:, None]).view(np.int64)[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content), pa.array(prints, pa.list_(pa.int64())), pa.array(check, pa.int64())], names=["row", "content", "prints", "check"])

    return map_batches(docs, step, f"row {docs.schema['row'].dataType.simpleString()}, content string, prints array<long>, check long")


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Whether each of the edges (a, b) of n nodes is in the spanning forest of least far, by joining components to their nearest."""
    chosen = np.zeros(len(a), bool)
    root = np.arange(n)
    order = far.astype(np.int64) * len(a) + np.arange(len(a))
    live = np.flatnonzero(a != b)
    while len(live):
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, root[a[live]], order[live])
        np.minimum.at(best, root[b[live]], order[live])
        own = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen[own] = True
        root = joined_roots(root, a[own], b[own])
        live = live[root[a[live]] != root[b[live]]]
    return chosen


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components after the edges (a, b), each named by its smallest node."""
    root = root.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(before, root):
            return root


class Kept:
    """The candidate pairs of n nodes that stay so far: FORESTS edge-disjoint forests and HUBS of each node, whatever the number of pairs; `cut` has the nodes of the others."""

    def __init__(self, check: np.ndarray):
        self.check, self.pairs, self.far, self.waiting = check, np.empty(0, np.int64), np.empty(0, np.int8), 0
        self.degree, self.cut = np.zeros(len(check), np.int64), np.zeros(len(check), bool)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        far = np.bitwise_count(self.check[a] ^ self.check[b])
        near = np.flatnonzero((far <= CHECK_RADIUS) & (a != b))
        a, b = a[near].astype(np.int64), b[near].astype(np.int64)
        central = far[near] <= HUB_RADIUS
        self.degree += np.bincount(a[central], minlength=len(self.degree)) + np.bincount(b[central], minlength=len(self.degree))
        self.new.append((np.minimum(a, b) * len(self.check) + np.maximum(a, b), far[near].astype(np.int8)))
        self.waiting += len(near)
        if self.waiting > PAIRS_AT_ONCE:
            self.thin()

    def thin(self) -> None:
        pairs, at = np.unique(np.concatenate([self.pairs, *(p for p, _ in self.new)]), return_index=True)
        far = np.concatenate([self.far, *(f for _, f in self.new)])[at]
        self.new, self.waiting = [], 0
        n, kept = len(self.check), np.zeros(len(pairs), bool)
        for _ in range(FORESTS):
            left = np.flatnonzero(~kept)
            kept[left[forest(pairs[left] // n, pairs[left] % n, far[left], n)]] = True
        own, other = np.concatenate([pairs // n, pairs % n]), np.concatenate([pairs % n, pairs // n])
        order = np.lexsort((-self.degree[other], own))
        place = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        kept[order[place < HUBS] % max(1, len(pairs))] = True
        self.cut[pairs[~kept] // n] = self.cut[pairs[~kept] % n] = True
        self.pairs, self.far = pairs[kept], far[kept]


def print_pairs(prints: np.ndarray, rests: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of different fingerprints that share a variant and are within the radius, in parts; a pair may come again.

    The variants of a bucket are sorted. If more pairs of variants collide than there are pairs of colliding
    fingerprints, these are compared in blocks instead.
    """
    keep = np.uint64((1 << low) - 1)
    variants, owners = [], []
    for rest in np.unique(rests).tolist():
        at = np.flatnonzero(rests == rest)
        masks = np.array([m for m, _ in ball(low, rest)], np.uint64)
        variants.append(((prints[at] & keep)[:, None] ^ masks).ravel())
        owners.append(np.repeat(at, len(masks)).astype(np.int32))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    first = np.concatenate([[True], variant[1:] != variant[:-1]])
    size = np.diff(np.append(np.flatnonzero(first), len(variant)))
    crowd = np.unique(owner[np.repeat(size > 1, size)])
    if (size.astype(float) * (size - 1)).sum() > float(len(crowd)) ** 2:
        rows = max(1, PAIRS_AT_ONCE // max(1, len(crowd)))
        for k in range(0, len(crowd), rows):
            own = crowd[k : k + rows]
            x, y = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[crowd[k:]]) <= RADIUS)
            x, y = own[x], crowd[k:][y]
            yield x[x != y], y[x != y]
        return
    end = np.repeat(np.cumsum(size), size)
    live, step = np.arange(len(variant)), 1
    while len(live := live[live + step < end[live]]):
        x, y = owner[live], owner[live + step]
        near = np.bitwise_count(prints[x] ^ prints[y]) <= RADIUS
        yield x[near], y[near]
        step += 1


def bucket_candidates(prints: np.ndarray, rests: np.ndarray, check: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the nearest candidates of one bucket, and the places that have candidates beside these."""
    order = np.lexsort((check, prints))
    own, start, size = np.unique(prints[order], return_index=True, return_counts=True)
    kept = Kept(check[order])
    for k in range(1, int(size.max())):  # texts of one fingerprint, each with the next, the one after it, ...
        some = np.flatnonzero(size > k)
        x = np.repeat(start[some], size[some] - k) + ramps(size[some] - k)
        kept.add(x, x + k)
        if k % 64 == 0:
            kept.thin()
            root = joined_roots(np.arange(len(order)), *(p[kept.far <= 3] for p in (kept.pairs // len(order), kept.pairs % len(order))))
            group = np.repeat(np.arange(len(size)), size)
            alone = np.zeros(len(size), bool)
            alone[group[root != root[start][group]]] = True
            kept.cut |= (~alone & (size > k))[group]
            size = np.where(alone, size, np.minimum(size, k))  # all of them are near each other already
    size = np.diff(np.append(start, len(order)))
    for x, y in print_pairs(own, rests[order][start], low):
        each = size[x] * size[y]
        for part in np.array_split(np.arange(len(x)), max(1, int(each.sum()) // PAIRS_AT_ONCE + 1)):
            if len(part):
                i = ramps(each[part])
                wide = np.repeat(size[y[part]], each[part])
                kept.add(np.repeat(start[x[part]], each[part]) + i // wide, np.repeat(start[y[part]], each[part]) + i % wide)
    kept.thin()
    return order[kept.pairs // len(order)], order[kept.pairs % len(order)], order[kept.cut]


def bucket_pairs(prints: np.ndarray, rests: np.ndarray, check: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest candidates of one bucket."""
    return bucket_candidates(prints, rests, check, low)[:2]


def ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of sizes, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def solved(rows: DataFrame, low: int) -> DataFrame:
    """(u, v, far) of the candidates in each bucket of rows (part, bucket, fp, rest, check, node); a node that has others beside these comes as u with its bucket."""

    def step(table: pa.Table) -> pa.Table:
        prints, check, node = (table.column(c).to_numpy() for c in ("fp", "check", "node"))
        check = check.view(np.uint64)
        x, y, cut = bucket_candidates(prints.view(np.uint64), table.column("rest").to_numpy(), check, low)
        u, v = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        pairs = pa.table({"u": u, "v": v, "far": np.bitwise_count(check[x] ^ check[y]).astype(np.int32), "bucket": pa.nulls(len(u), pa.string())})
        name = f"{table.column('part')[0].as_py()} {low} {table.column('bucket')[0].as_py()}"
        return pa.concat_tables([pairs, pa.table({"u": node[cut], "v": pa.nulls(len(cut), pa.int64()), "far": pa.nulls(len(cut), pa.int32()), "bucket": pa.array([name] * len(cut), pa.string())})])

    return rows.groupBy("part", "bucket").applyInArrow(step, "u long, v long, far int, bucket string")


def block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """rows of many blocks, whose number `blocks` has, with own, the block that `key` falls in, and block, each pair of blocks that own is in."""
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = rows.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")))
    pairs = F.transform(others, lambda k: F.greatest("own", k) * F.col("blocks") + F.least("own", k))
    return own.withColumn("block", F.explode(pairs))


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, far), u < v, each once: near pairs of texts (node, check, prints) whose balls meet; (node, bucket) of those with further ones.

    Buckets hold at most simhash.VARIANTS_MOST variants; larger ones are dealt out over more bits. What still has
    one variant and too many texts is cut by hash into blocks, and each pair of blocks is a bucket.
    """
    half = RADIUS // 2
    rows = texts.select("node", "check", F.posexplode("prints").alias("part", "fp"))
    n, depth = texts.count(), 4
    while depth < 30 and n * ball_size(PRINT_BITS, half) > simhash.VARIANTS_AIM << depth:
        depth += 1
    rows = deal(rows.withColumns({"bucket": F.lit(0).cast("long"), "rest": F.lit(half)}), 0, depth, half, PRINT_BITS)
    found, on = [], ["part", "bucket"]
    while True:
        low = PRINT_BITS - depth
        heavy = rows.groupBy(*on).agg(F.sum(weight(low, half)).alias("variants")).filter(F.col("variants") > simhash.VARIANTS_MOST)
        heavy = written(heavy, "heavy")
        if heavy.isEmpty():
            found.append(solved(rows, low))
            break
        found.append(solved(rows.join(heavy, on, "left_anti"), low))
        crowd = rows.join(heavy.select(*on), on, "left_semi")
        if low:
            more = min(simhash.DEEPER, low)
            rows = deal(crowd, depth, more, half, PRINT_BITS)
            depth += more
            continue
        blocks = F.ceil(F.col("variants") / (simhash.VARIANTS_MOST // 2)).cast("long")
        dealt = block_pairs(rows.join(heavy.withColumn("blocks", blocks), on), "node")
        found.append(solved(dealt.withColumn("bucket", F.xxhash64("bucket", "block")).select(rows.columns), low))
        break
    out = found[0]
    for more_found in found[1:]:
        out = out.unionByName(more_found)
    out = written(out, "found")
    return written(out.filter("v IS NOT NULL").select("u", "v", "far").distinct(), "candidates"), out.filter("v IS NULL").select(F.col("u").alias("node"), "bucket")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v), contents, of pairs (u, v) of nodes whose sets (node, content, shingles) have at least that Jaccard similarity."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("content").alias(f"content_{name}"), F.col("shingles").alias(f"shingles_{name}"))

    both = F.size(F.array_intersect("shingles_u", "shingles_v"))
    near = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    near = near.filter(both >= (F.size("shingles_u") + F.size("shingles_v") - both) * F.lit(similarity))
    return written(near.select(F.col("content_u").alias("u"), F.col("content_v").alias("v")), "similar")


def set_links(check: np.ndarray, root: np.ndarray, block: np.ndarray, size: np.ndarray, shingles: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of at least the similarity that connect nodes of different roots as all such links do; shingles has the sets one after the other.

    Nodes of two blocks are compared across these only.
    """
    n, start = len(size), np.cumsum(size) - size
    _, known, times = np.unique(shingles, return_inverse=True, return_counts=True)
    mark = np.zeros(len(times), bool)
    label, across = np.unique(root, return_inverse=True)[1], block.min() != block.max()
    u, v = [], []
    for k in range(n - 1):
        far = np.bitwise_count(check[k] ^ check[k + 1 :])
        small, large = np.minimum(size[k], size[k + 1 :]), np.maximum(size[k], size[k + 1 :])
        asked = (far <= CHECK_RADIUS) & (label[k + 1 :] != label[k]) & (small >= similarity * large)
        if across:
            asked &= block[k + 1 :] != block[k]
        others = np.flatnonzero(asked) + k + 1
        mark[known[start[k] : start[k] + size[k]]] = True
        for some in np.array_split(others, int(size[others].sum()) // PAIRS_AT_ONCE + 1) if len(others) else []:
            if len(some):
                hits = mark[known[np.repeat(start[some], size[some]) + ramps(size[some])]]
                both = np.add.reduceat(hits, np.cumsum(size[some]) - size[some], dtype=np.int64)
                near = some[both >= (size[k] + size[some] - both) * similarity]
                for at in near[np.unique(label[near], return_index=True)[1]]:
                    if label[at] != label[k]:
                        u.append(k)
                        v.append(at)
                        label[label == label[at]] = label[k]
        mark[known[start[k] : start[k] + size[k]]] = False
    return np.array(u, np.int64), np.array(v, np.int64)


def further_links(cut: DataFrame, roots: DataFrame, named: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of contents among the texts of cut (node, bucket) that are in one bucket and have different roots (own, root), by all pairs.

    Buckets that share texts are one group, so that a text is compared once; held has (node, content, shingles).
    """
    members = cut.join(roots, F.col("node") == F.col("own")).select("node", "bucket", "root")
    unsettled = members.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.min("node").alias("hub")).filter("first <> last")
    told = written(members.join(unsettled.select("bucket", "hub"), "bucket").select("node", "hub", "root").distinct(), "unsettled")
    group = components(told.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()).withColumnRenamed("root", "group")
    rows = told.select("node", "root").distinct().join(group, "node", "left").withColumn("group", F.coalesce("group", "node")).join(held, "node").join(named.select("node", "check"), "node")
    rows = written(rows.select("node", "group", "root", "content", "check", "shingles"), "members")
    sizes = rows.groupBy("group").agg(F.ceil(F.sum(F.size("shingles")) / F.lit(SHINGLES_AT_ONCE // 2)).cast("long").alias("blocks"))
    dealt = block_pairs(rows.join(sizes.withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1)), "group"), "node")

    def step(table: pa.Table) -> pa.Table:
        sets = table.column("shingles").combine_chunks()
        check, root, block = (table.column(c).to_numpy() for c in ("check", "root", "own"))
        x, y = set_links(check.view(np.uint64), root, block, sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy(), similarity)
        content = table.column("content")
        return pa.table({"u": content.take(pa.array(x)), "v": content.take(pa.array(y))})

    return written(dealt.groupBy("group", "block").applyInArrow(step, "u string, v string"), "further")


def similar_links(texts: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of contents of at least that similarity, which connect what the candidates connect.

    texts has (key, text), named has (key, content, node, check, prints), each content once. The nearest candidate of
    each text is verified first; of the others only those between texts that are not connected by then, and at last the
    pairs that are not among the candidates kept.
    """
    found, cut = candidates(named.filter("prints IS NOT NULL").select("node", "check", "prints"))
    asked = written(found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(named, "node").select("key", "content", "node"), "asked")

    def sets(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for first, past, words in word_runs(lowered(as_bytes(batch.column(2)))):
            own = [np.unique(s.astype(np.uint32)).view(np.int32) for s in shingle_sets(words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, past - first) for k in (0, 1)), pa.array(own, pa.list_(pa.int32()))], names=["node", "content", "shingles"])

    told = texts.join(asked, "key").dropDuplicates(["key"]).select("node", "content", "text")
    held = written(map_batches(told, sets, "node long, content string, shingles array<int>"), "shingles")
    either = found.select(F.explode(F.array(F.struct(F.col("u").alias("own"), F.col("v").alias("other")), F.struct(F.col("v").alias("own"), F.col("u").alias("other")))).alias("x"), "far").select("x.*", "far")
    nearest = either.groupBy("own").agg(F.min_by("other", F.struct("far", "other")).alias("other"))
    nearest = written(nearest.select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v")).distinct(), "nearest")
    links = verified(nearest, held, similarity)

    def named_roots(reached: DataFrame) -> DataFrame:
        return written(asked.join(reached.withColumnRenamed("node", "content"), "content", "left").select(F.col("node").alias("own"), F.coalesce("root", "content").alias("root")), "roots")

    roots = named_roots(components(links))
    rest = found.join(nearest, ["u", "v"], "left_anti")
    for side in ("u", "v"):
        rest = rest.join(roots.select(F.col("own").alias(side), F.col("root").alias(f"root_{side}")), side)
    rest = written(rest.filter("root_u <> root_v").select("u", "v").distinct(), "rest")
    links = links.unionByName(verified(rest, held, similarity))
    return links.unionByName(further_links(cut, named_roots(components(links)), named, held, similarity))


def representatives(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, that stay: one for each group that links connect, with the smallest id.

    Texts with the same words (A-Z in lower case) are copies; others are linked if the Jaccard similarity of their sets
    of five-word shingles is at least `similarity`: no link is below it, and at 0.8 balls find 0.98 or more of such pairs of
    the test tables.
    Shorter texts are one shingle; null and empty texts are copies of each other. A row with a null id stays only for
    a group without ids; of rows with equal ids the one with the smallest digest of its text stays, and of rows with
    equal ids and texts one. An empty table gives an empty one. Columns may have any names.
    """
    key = fresh(docs, "row_key")
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.withColumn(key, digest)
    texts = keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    with scratch():
        stays = kept(written(staying(keyed, texts, row, text_col, similarity).select(F.col("row.key").alias(key)).distinct(), "stays"))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).select([F.col(f"`{c}`") for c in docs.columns])


def staying(keyed: DataFrame, texts: DataFrame, row, text_col: str, similarity: float) -> DataFrame:
    """The least `row` of each group."""
    marked = written(marks(keyed.select(row.alias("row"), F.col(text_col).alias("text"))), "marks")
    least = marked.groupBy("content").agg(F.min("row").alias("row"), F.first("prints").alias("prints"), F.first("check").alias("check"))
    node = F.conv(F.substring("content", 1, 15), 16, 10).cast("long")
    named = written(least.select("content", "row", F.col("row.key").alias("key"), node.alias("node"), "prints", "check"), "named")
    roots = components(similar_links(texts, named, similarity)).withColumnRenamed("node", "content")
    return named.select("content", "row").join(roots, "content", "left").groupBy(F.coalesce("root", "content").alias("root")).agg(F.min("row").alias("row"))
