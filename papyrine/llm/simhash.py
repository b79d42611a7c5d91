"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance through a forest of BK-trees.

Two fingerprints within a radius agree in at least one of radius + 1 blocks of their bits. Each block value is a shard
with a BK-tree of its own, and a fingerprint only searches the trees it belongs to, so no link is lost and no tree has to
travel: the trees grow with the corpus and are not broadcast, the queries are dealt to them instead.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import batches_of, connected_components, discard, give_back, materialize, sample_docs

ROWS = 1 << 20  # of shards that a task builds and searches together; a larger shard is taken alone
FRONT = 2_000_000  # (query, node) pairs looked at together
SLOTS = 1 << 26  # bits of the map of rows
CLOSE = 3  # bits by which the fingerprints differ that blocks bring together
SPREAD, FEW = 22, 16  # bits by which fingerprints of near copies may differ; sets below FEW shingles are not told by them
HOT = 32  # rows of a group from which cells are compared, not pairs
CELL = 128, 512  # rows of a cell
WIDE = 2048  # shingles that the rows of a cell hold each, as a mean
COLUMNS = 4096  # shingles that a product takes together
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half of the hashes of the text's word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([_digest(r) for r in runs], dtype=">u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and `fp`, the fingerprint as a signed long, in one pass without a shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(0).to_pylist()]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(signed)], names=[*keep, "fp"])

    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(run, schema)


class Forest:
    """BK-trees of many shards at once, built and searched level by level in numpy.

    A node's children are keyed by their Hamming distance to it; the first value of a shard, or of a child's group, is
    the node and the others sink. Children of all nodes lie in one array sorted by (node, distance).
    """

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        """Rows must be sorted by shard; equal values of a shard stand below each other, so that many make a deep tree."""
        self.values = values
        n = len(values)
        new = np.ones(n, dtype=bool)
        new[1:] = shards[1:] != shards[:-1]
        firsts = np.flatnonzero(new)
        self.root = firsts[np.cumsum(new) - 1]
        parent, distance = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        rest, above = np.flatnonzero(~new), self.root[~new]
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[above]).astype(np.int64)
            order = np.lexsort((rest, d, above))
            rest, above, d = rest[order], above[order], d[order]
            head = np.ones(len(rest), dtype=bool)
            head[1:] = (above[1:] != above[:-1]) | (d[1:] != d[:-1])
            parent[rest[head]], distance[rest[head]] = above[head], d[head]
            group = rest[head][np.cumsum(head) - 1]
            rest, above = rest[~head], group[~head]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + distance[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def pairs(self, radius: int):
        """Arrays (query, node) of all pairs of a shard within the radius, each pair once, in chunks."""
        sizes = np.bincount(self.root, minlength=len(self.values))[self.root]
        edges = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + FRONT, FRONT))
        for lo, hi in zip(edges, np.append(edges[1:], len(sizes))):
            if lo >= hi:
                continue
            query = np.arange(lo, hi)
            node = self.root[lo:hi]
            while len(query):
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (d <= radius) & (query > node)
                if hit.any():
                    yield query[hit], node[hit]
                a = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), side="left")
                b = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
                count = np.maximum(b - a, 0)
                query = np.repeat(query, count)
                node = self.child[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def contract(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each points at a smaller or equal index of its set) after joining the sets of a[i] and b[i]."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels != (up := labels[labels])).any():
            labels = up


def shards(radius: int):
    """An array of the shards of a fingerprint `fp`: one for each of radius + 1 blocks of even width."""
    if not 0 <= radius < 64:
        raise ValueError(f"radius must be from 0 to 63, not {radius}")
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    whole = lambda a, b: F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long")
    values = [F.shiftrightunsigned("fp", a).bitwiseAND(whole(a, b)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(values)])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every set linked within a shard: a member and its smallest."""
    dealt = distinct.select("fp", F.explode(shards(radius)).alias("k")).select("k.block", "k.value", "fp")
    dealt = dealt.repartition("block", "value").sortWithinPartitions("block", "value", "fp")

    def linked(block: np.ndarray, value: np.ndarray, values: np.ndarray):
        new = np.ones(len(values), dtype=np.int64)
        new[1:] = (block[1:] != block[:-1]) | (value[1:] != value[:-1])
        labels = np.arange(len(values))
        for query, node in Forest(np.cumsum(new), values.view(np.uint64)).pairs(radius):
            labels = contract(labels, query, node)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        for at in range(0, len(moved), 100_000):
            some = moved[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(values[some]), pa.array(values[labels[some]])], names=["a", "b"])

    def run(batches):
        for columns in whole_shards(batches, 2):
            yield from linked(*columns)

    return dealt.mapInArrow(run, "a long, b long")


def whole_shards(batches, keys: int):
    """The columns of about ROWS sorted rows at a time; a shard, told by the first `keys` columns, is not cut."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) < ROWS:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in columns[:keys]])))  # the last shard may go on
        held = [[c[cut:] for c in columns]]
        if cut:
            yield [c[:cut] for c in columns]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def candidates(shard: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float):
    """Positions (i, j) of pairs of a shard that sizes and fingerprints do not rule out, found in its BK-tree; in chunks.

    Rows are sorted by shard. Sets below FEW shingles are not told by fingerprints: they have a tree of equal values.
    """
    few = np.flatnonzero(similarity * n <= FEW)
    at, tree, value = np.concatenate([np.arange(len(n)), few]), np.concatenate([2 * shard, 2 * shard[few] + 1]), np.concatenate([fp.view(np.uint64), np.zeros(len(few), np.uint64)])
    order = np.argsort(tree, kind="stable")
    at, tree = at[order], tree[order]
    for i, j in Forest(tree, value[order]).pairs(SPREAD):
        low, high = np.minimum(n[at[i]], n[at[j]]), np.maximum(n[at[i]], n[at[j]])
        held = (low >= similarity * high - 1e-9) & ((tree[i] & 1 == 0) | (low < FEW))
        yield at[i[held]], at[j[held]]


def bitmap(hashes: np.ndarray) -> bytes:
    """A set of hashes as a map of four to eight bits for each, a power of two in all."""
    size = 1 << max(6, (4 * len(hashes)).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """Members that two sets of n and m share at most, by their bitmaps: common bits, and what either has beyond its bits."""
    a, b = (folded(v, min(len(x), len(y))) for v in (x, y))
    return (a & b).bit_count() + min(n - a.bit_count(), m - b.bit_count())


def folded(raw: bytes, size: int) -> int:
    """A bitmap as a number, made as small as a map of so many bytes."""
    value, width = int.from_bytes(raw, "little"), 8 * len(raw)
    while width > 8 * size:
        width >>= 1
        value = value & ((1 << width) - 1) | value >> width
    return value


def reach(both: float, n: int, m: int, similarity: float) -> bool:
    """Two sets of n and m that share `both` have the Jaccard similarity."""
    return both >= similarity * (n + m - both) - 1e-9


def components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null or blank text has fingerprint 0 and is linked like any other. Exact copies share a fingerprint and count
    once in the search. Repeated rows stay repeated. A null doc_id keeps its row and is never a component's id unless
    all its members lack one (then null). Other columns are not read. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = materialize(classes(distinct, radius), "classes")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for distinct (fp, first): the smallest `first` of the fingerprints reachable."""
    found = materialize(links(distinct, radius), "links")
    linked = materialize(distinct.join(connected_components(found).withColumnRenamed("node", "fp"), "fp"), "linked")
    least = materialize(linked.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = materialize(linked.join(least, "component").select("fp", "component_id"), "named")
    discard(found, linked, least)
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The documents, their own columns kept, with one of each group of linked fingerprints: the smallest doc_id.

    Of rows that repeat that doc_id one stays; of a group without any doc_id one row stays.
    """
    own = docs.columns
    hidden = [f"_c{i}" for i in range(len(own))]  # whatever the columns are called
    renamed = docs.select(*[F.col(c).alias(h) for c, h in zip(own, hidden)], F.monotonically_increasing_id().alias("_row"))
    text = own.index("text")

    def run(batches):
        for batch in batches:
            signed = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed)], names=[*hidden, "_row", "fp"])

    stored = materialize(renamed.mapInArrow(run, T.StructType([*renamed.schema.fields, T.StructField("fp", T.LongType())])), "numbered")
    marked = stored.select(F.col(hidden[own.index("doc_id")]).alias("doc_id"), "_row", "fp")
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("best"))
    distinct = materialize(best.select("fp", F.col("best.row").alias("row"), F.col("best").alias("first")), "distinct")
    named = classes(distinct.select("fp", "first"), radius)
    chosen = materialize(named.select(F.col("component_id.row").alias("_row")).distinct(), "chosen")
    kept = stored.join(chosen.hint("shuffle_hash"), "_row", "left_semi")  # one plan at every size: rows are dealt, not broadcast
    return kept.select(*[F.col(h).alias(c) for c, h in zip(own, hidden)])


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the text's word shingles in order; a shorter text is one shingle, a blank one has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    runs = [b" ".join(words)] if 0 < len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.array([_digest(r) for r in runs], dtype=np.uint64))


def in_both(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many members the sets x[i], y[j] share, for all i and j, by products over the shingles both sides hold."""
    flat, owner = [np.concatenate(v) for v in (x, y)], []
    shared = np.intersect1d(*flat)
    for k, v in enumerate((x, y)):
        column = np.minimum(np.searchsorted(shared, flat[k]), max(len(shared) - 1, 0))
        held = np.flatnonzero(shared[column] == flat[k]) if len(shared) else np.empty(0, np.int64)
        held = held[np.argsort(column[held], kind="stable")]
        flat[k] = column[held]
        owner.append(np.repeat(np.arange(len(v)), [len(s) for s in v])[held])
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        sides = []
        for column, who, n in zip(flat, owner, both.shape):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            side = np.zeros((n, min(COLUMNS, len(shared) - at)), dtype=np.float32)
            side[who[lo:hi], column[lo:hi] - at] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return both


def alike(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Positions (i, j) of all sets x[i], y[j] of that Jaccard similarity."""
    both = in_both(x, y)
    sizes = [np.array([len(s) for s in v], dtype=np.float64) for v in (x, y)]
    return np.argwhere(both >= similarity * (sizes[0][:, None] + sizes[1] - both) - 1e-9)


class Copies:
    """Near-duplicate links between documents stored as (_row, _text) with one row for each distinct set of shingles.

    Fingerprints within CLOSE bits are linked through the forest of their blocks, as in links(). At similarity 0.8 some
    10 of 64 bits differ, with a deviation of 3; for SPREAD bits a block would be two or three bits wide. So for the rest
    a shard is not a block but a shingle: two sets of the wanted similarity share one of the first
    n - ceil(similarity * n) + 1 shingles of either in any one order of all shingles; here those that are frequent in a
    bounded sample come last, then by their hashes. Each row is compared with one row of each of its shards (another for
    each of eight classes of shards); that joins most of what belongs together. Then the BK-tree of each shard that holds
    several components gives the pairs of fingerprints within SPREAD bits. In large shards rows outside the largest
    component are dealt with all others to cells of bounded size, which have a tree each. So no link between components
    is lost, but for the one in 10^5 beyond SPREAD bits, and rows already linked are not paired again.

    Pairs are checked exactly by their sets. Before that bitmaps, a tenth of the size, rule out pairs that cannot share
    enough shingles; that loses none. A cell holds the sets, checks its pairs itself and gives one link for each
    component that it joins to another: pairs of a large group are neither stored nor joined.
    """

    def __init__(self, stored: DataFrame, distinct: DataFrame, similarity: float, shingle: int):
        self.stored, self.distinct, self.similarity, self.shingle = stored, distinct, similarity, shingle

    def texts(self, rows: DataFrame, task, schema: str) -> DataFrame:
        """task(rows, texts) over the batches of the stored documents in `rows`, and of few others.

        Rows are told by a bit of a map of fixed size; it changes the cost, not the result.
        """
        slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS))
        bits = np.zeros(SLOTS >> 6, dtype=np.uint64)
        words = rows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
        bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        sent = self.stored.sparkSession.sparkContext.broadcast(bits)

        def run(batches):
            for batch in batches:
                at = batch.column(2).to_numpy()
                held = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                if held.any():
                    yield from task(batch.filter(pa.array(held)))
            give_back()

        return self.stored.select(F.col("_row").alias("row"), "_text").select("row", "_text", slot.alias("s")).mapInArrow(run, schema)

    def sets(self, rows: DataFrame, form=np.ndarray.tobytes) -> DataFrame:
        """(row, set) of the rows, and of few others, in that form."""
        shingle = self.shingle

        def run(batch):
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([form(shingle_set(t, shingle)) for t in some.column(1).to_pylist()], pa.binary())], names=["row", "set"])

        return materialize(self.texts(rows, run, "row long, set binary"), "sets")

    def frequent(self, sample_rows: int = 5000, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Shingles that two or more of about `sample_rows` documents hold, the `most` frequent, and their counts."""
        shingle = self.shingle

        def run(batches):
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], names=["token"])

        found = sample_docs(self.stored, sample_rows, "_row").select("_text").mapInArrow(run, "token long").groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(most).toArrow()
        tokens, counts = found["token"].to_numpy().view(np.uint64), found["count"].to_numpy()
        order = np.argsort(tokens)
        return tokens[order], counts[order]

    def groups(self, named: DataFrame) -> DataFrame:
        """(token, row, n, fp, component) of the prefix shingles that two rows or more share; named: (row, component)."""
        similarity, shingle, (frequent, counts) = self.similarity, self.shingle, self.frequent()

        def prefixes(batch):
            rows, tokens, sizes = batch.column(0).to_numpy(), [], []
            for value in batch.column(1):
                s = shingle_set(value.as_py(), shingle)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    s = s[np.argsort(np.where(frequent[at] == s, counts[at], 0), kind="stable")]
                tokens.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0])
                sizes.append(len(tokens[-1]))
            flat, owner = np.concatenate(tokens).view(np.int64), np.repeat(rows, sizes)
            for at in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + 100_000]), pa.array(owner[at : at + 100_000])], names=["token", "row"])

        def shared(batches):
            last = np.empty(0, np.int64), np.empty(0, np.int64)
            open_group = False  # rows of the held token have been given out
            for batch in (b for b in batches if b.num_rows):
                token, row = (np.concatenate([h, c.to_numpy()]) for h, c in zip(last, batch.columns))
                same = np.zeros(len(token) + 1, dtype=bool)
                same[1:-1] = token[1:] == token[:-1]
                same[0] = open_group
                keep = same[:-1] | same[1:]
                open_group, last = bool(same[-2]) and bool(keep[-1]), (token[-1:], row[-1:])
                keep[-1] = False  # the last row waits for its successor
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(row[keep])], names=["token", "row"])
            if open_group:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["token", "row"])

        dealt = self.texts(self.distinct.select("row"), prefixes, "token long, row long").repartition("token").sortWithinPartitions("token")
        found = materialize(dealt.mapInArrow(shared, "token long, row long"), "groups")
        told = found.join(self.distinct.select("row", "n", "fp"), "row").join(named, "row", "left")
        told = materialize(told.select("token", "row", "n", "fp", F.coalesce("component", "row").alias("component")), "groups")
        discard(found)
        return told

    def may(self, a: str, b: str):
        """A pair that sizes and fingerprints do not rule out."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")))
        return (F.least(n, m) >= self.similarity * F.greatest(n, m) - 1e-9) & ((apart <= SPREAD) | (F.least(n, m) < FEW))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among candidate pairs, by their sets; first by bitmaps, of which far less is dealt."""
        similarity = self.similarity

        def mapped(batches):
            for batch in batches:
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([bitmap(x) for x in sets], pa.binary())], names=["row", "n", "bits"])

        def likely(batches):
            for batch in batches:
                hit = [reach(most_shared(x, n, y, m), n, m, similarity) for n, x, m, y in zip(*(c.to_pylist() for c in batch.columns[2:]))]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

        def compare(batches):
            for batch in batches:
                hit = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    hit.append(reach(both, len(x) // 8, len(y) // 8, similarity))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

        sets = self.sets(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))))
        x, y = (sets.select(F.col("row").alias(r), F.col("set").alias(f"set_{r}")) for r in ("a", "b"))
        with batches_of(pairs.sparkSession, 128):
            maps = sets.mapInArrow(mapped, "row long, n int, bits binary")
            p, q = (maps.select(F.col("row").alias(r), F.col("n").alias(f"n_{r}"), F.col("bits").alias(f"bits_{r}")) for r in ("a", "b"))
            left = materialize(pairs.join(p, "a").join(q, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(likely, "a long, b long"), "likely")
            found = materialize(left.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "links")
        discard(sets, left)
        return found

    def close(self) -> DataFrame:
        """Pairs (a, b) of rows that span what CLOSE bits of the fingerprints link."""
        prints = materialize(self.distinct.groupBy("fp").agg(F.min("row").alias("row")), "prints")
        found = materialize(links(prints.select("fp"), CLOSE), "links")
        a, b = (prints.select(F.col("fp").alias(x), F.col("row").alias(f"row_{x}")) for x in ("a", "b"))
        spanned = found.join(a, "a").join(b, "b").select("row_a", "row_b")
        equal = self.distinct.select("fp", "row").join(prints.select("fp", F.col("row").alias("least")), "fp").where("row <> least").select("least", "row")
        pairs = materialize(spanned.union(equal).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        discard(prints, found)
        return pairs

    def in_trees(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of rows of a shard (token) and of two components, from the shard's BK-tree."""
        similarity = self.similarity

        def run(batches):
            for token, row, n, fp, component in whole_shards(batches, 1):
                shard = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]), dtype=np.int64)
                for i, j in candidates(shard, n, fp, similarity):
                    apart = component[i] != component[j]
                    yield pa.RecordBatch.from_arrays([pa.array(f(row[i[apart]], row[j[apart]])) for f in (np.minimum, np.maximum)], names=["a", "b"])

        dealt = rows.select("token", "row", "n", "fp", "component").repartition("token").sortWithinPartitions("token")
        return dealt.mapInArrow(run, "a long, b long").distinct()

    def cells(self, units: DataFrame, sets: DataFrame, wide: int):
        """Rows of a unit (dom) outside its largest component, grouped with all others to cells of bounded size."""
        out = F.col("out").cast("long")
        parts = lambda rows, cell: F.ceil(F.greatest(F.sum(rows) / cell, F.sum(rows * F.col("n")) / (cell * wide))).cast("int")
        parts = units.groupBy("dom").agg(parts(out, CELL[0]).alias("down"), parts(F.lit(1), CELL[1]).alias("across"))
        held = units.join(parts, "dom").join(sets, "row")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        own = ["row", "n", "fp", "component", "set"]
        left = held.where("out").select("dom", mine("down").alias("i"), every("across").alias("j"), *own, F.lit(True).alias("left"))
        right = held.select("dom", every("down").alias("i"), mine("across").alias("j"), *own, F.lit(False).alias("left"))
        return left.union(right).groupBy("dom", "i", "j")

    def in_cells(self, units: DataFrame) -> DataFrame:
        """Links (a, b) that join the components which similar rows of a unit (dom) link, one of them outside its largest.

        Pairs come from the BK-trees of cells. First only bitmaps are dealt; rows without a pair that these leave go. The
        pairs of the others are checked in their cells by the sets. Of the links of a cell those stay that span them,
        between components, so that they grow with the components, not with the pairs.
        """
        similarity = self.similarity

        def read(cell: pa.Table):
            row, at = np.unique(cell["row"].to_numpy(), return_index=True)
            n, fp, component = (cell[c].to_numpy()[at] for c in ("n", "fp", "component"))
            sides = [np.isin(row, cell["row"].to_numpy()[cell["left"].to_numpy() == x]) for x in (True, False)]

            def pairs():  # of a row at the left and one at the right, of two components
                for i, j in candidates(np.zeros(len(row), np.int64), n, fp, similarity):
                    straight = sides[0][i] & sides[1][j]
                    asked = (component[i] != component[j]) & (straight | sides[0][j] & sides[1][i])
                    yield np.where(straight, i, j)[asked], np.where(straight, j, i)[asked]

            return row, n, component, cell["set"].take(pa.array(at)).to_pylist(), sides, pairs

        def sift(cell: pa.Table) -> pa.Table:
            row, n, _, bits, _, pairs = read(cell)
            left = np.zeros(len(row), dtype=bool)
            for i, j in pairs():
                for x, y in zip(i.tolist(), j.tolist()):
                    if not (left[x] and left[y]) and reach(most_shared(bits[x], int(n[x]), bits[y], int(n[y])), int(n[x]), int(n[y]), similarity):
                        left[x] = left[y] = True
            return pa.table([pa.array(np.full(int(left.sum()), cell["dom"][0].as_py(), np.int64)), pa.array(row[left])], names=["dom", "row"])

        def search(cell: pa.Table) -> pa.Table:
            row, n, component, sets, sides, pairs = read(cell)
            names, named = np.unique(component, return_inverse=True)
            labels = np.arange(len(names))
            if all(side.any() for side in sides):
                both = in_both(*([np.frombuffer(sets[k], np.uint64) for k in np.flatnonzero(side)] for side in sides))
                place = [np.cumsum(side) - 1 for side in sides]
                for i, j in pairs():
                    share = both[place[0][i], place[1][j]].astype(np.float64)
                    hit = share >= similarity * (n[i] + n[j] - share) - 1e-9
                    labels = contract(labels, named[i[hit]], named[j[hit]])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.table([pa.array(names[labels[moved]]), pa.array(names[moved])], names=["a", "b"])

        maps = self.sets(units.select("row"), bitmap)
        left = materialize(self.cells(units, maps, 8 * WIDE).applyInArrow(sift, "dom long, row long").distinct(), "sifted")
        discard(maps)
        few = materialize(units.join(left, ["dom", "row"], "left_semi"), "units")
        sets = self.sets(few.select("row"))
        found = materialize(self.cells(few, sets, WIDE).applyInArrow(search, "a long, b long").distinct(), "links")
        discard(left, few, sets)
        return found

    def links(self) -> DataFrame:
        """Links (a, b) that give the components of all pairs of the similarity."""
        ends = [F.least("a.row", "b.row").alias("a"), F.greatest("a.row", "b.row").alias("b")]
        pairs = self.close()
        near = self.compared(pairs)
        discard(pairs)
        span = lambda named: named.where("row <> component").select(F.col("component").alias("a"), F.col("row").alias("b"))
        named = connected_components(near).withColumnRenamed("node", "row")
        rows = self.groups(named)
        leader = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("row", F.col("token").bitwiseAND(F.lit(7).cast("long"))).alias("h"), "row", "n", "fp", "component")).alias("l")).select("token", "l.row", "l.n", "l.fp", "l.component")
        star = materialize(rows.alias("a").join(leader.alias("b"), F.expr("a.token = b.token and a.component <> b.component") & self.may("a", "b")).select(*ends).distinct(), "pairs")
        joined = self.compared(star)
        discard(star)
        both = materialize(span(named).union(joined), "links")
        discard(near, joined)
        named = connected_components(both).withColumnRenamed("node", "row")
        told = materialize(rows.drop("component").join(named, "row", "left").select("token", "row", "n", "fp", F.coalesce("component", "row").alias("component")), "told")
        discard(rows)
        counts = told.groupBy("token", "component").count().groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("held"), F.max(F.struct("count", "component")).alias("top"))
        mixed = counts.where("parts > 1").select("token", F.col("top.component").alias("dom"), "held")
        open_ = materialize(told.join(mixed, "token").withColumn("out", F.col("component") != F.col("dom")), "open")
        discard(told)
        cold = materialize(self.in_trees(open_.where(F.col("held") < HOT)), "pairs")
        units = materialize(open_.where(F.col("held") >= HOT).groupBy("dom", "row").agg(*[F.max(c).alias(c) for c in ("out", "n", "fp", "component")]), "units")
        discard(open_)
        hot = self.in_cells(units)
        discard(units)
        rest = self.compared(cold)
        every = materialize(span(named).union(rest).union(hot), "links")
        discard(cold, hot, both, rest)
        return every


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents with one of each group linked by a Jaccard similarity of word shingles: the smallest doc_id.

    Sets of distinct shingles of lower-cased words count; a text of fewer words is one shingle, a null or blank one has
    none and is like any other such. Of rows that repeat a doc_id one stays, of a group without any doc_id one row
    stays. Own columns are kept, whatever they are called. An empty table gives an empty result. See Copies for the
    method.
    """
    own = docs.columns
    hidden = [f"_c{i}" for i in range(len(own))]
    renamed = docs.select(*[F.col(c).alias(h) for c, h in zip(own, hidden)], F.monotonically_increasing_id().alias("_row"))
    text, names = own.index("text"), [*hidden, "_row", "n", "fp", "same"]

    def mark(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets, prints = zip(*(marks(t, shingle) for t in some.column(text).to_pylist()))
                extra = [pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], names=names)
        give_back()

    kinds = [T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("same", T.BinaryType())]
    stored = materialize(renamed.mapInArrow(mark, T.StructType([*renamed.schema.fields, *kinds])), "numbered")
    marked = stored.select(F.col(hidden[own.index("doc_id")]).alias("doc_id"), "_row", "n", "fp", "same")
    best = marked.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    distinct = materialize(best.select(F.col("first.row").alias("row"), "first", "n", "fp"), "distinct")
    links = Copies(stored.withColumnRenamed(hidden[text], "_text"), distinct, similarity, shingle).links()
    members = materialize(distinct.select("row", "first").join(connected_components(links).withColumnRenamed("node", "row"), "row"), "members")
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    losers = members.join(least, "component").where("first <> least").select("row")
    chosen = materialize(distinct.select("row").join(losers, "row", "left_anti").select(F.col("row").alias("_row")), "chosen")
    discard(links, members, distinct)
    kept = stored.join(chosen.hint("shuffle_hash"), "_row", "left_semi")  # one plan at every size: rows are dealt, not broadcast
    return kept.select(*[F.col(h).alias(c) for c, h in zip(own, hidden)])


def marks(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    """The set of shingles, and the fingerprint of that set."""
    hashes = shingle_set(text, shingle)
    if not len(hashes):
        return hashes, 0
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return hashes, int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")
