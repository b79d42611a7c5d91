"""Packing by lexical retrieval: a sharded BM25 inverted index returns unused neighbours that fill a seed's window.

Documents are tokenised and stored once; document frequencies and the mean length are those of the whole corpus. A tree
of hyperplanes, fitted on a bounded sample of weighted term vectors, puts all documents in an order in which like ones
stand together; the order is dealt to tasks in ranges of even work, and a task cuts its range into shards. Each shard has
an exact inverted index over all terms. A seed's unused neighbours of its shard follow it until the window is full; the
document that was cut there is the next seed. Work is linear in the corpus, and a document's neighbours are looked for
beside it in the order of content, wherever it is stored. What is left unfilled at the end of a range is cut into runs
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import give_back, materialize

WINDOW = 4096
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 1 << 14  # of one index, which a task builds and drops before the next
RANGE_COST = 10_000_000  # tokens of a range, a document counting DOC_COST more
DOC_COST = 256
MOST_RANGES = 20_000
SAMPLE = 1 << 14  # documents that fit the tree; 16 a range if that is more, for even ranges
DIMENSIONS = 64
DEPTH = 9  # of the tree
SIGNS = 16  # bits of the order within a leaf
DENSE = 1 << 24  # entries of the matrix that holds a shard's commonest terms
TERMS = 1 << 16
CACHE_WORDS = 500_000
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_LETTERS, _NUMBERS, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_match = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+").findall
_wide = re.compile("[^\\x00-\\xff]").search
_tokenizers: dict[str, "WordTokenizer"] = {}


class Aged:
    """A bounded cache of two generations: a full one ages, what is met again moves to the next."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, keys: set) -> set:
        """Of the keys those without a value; the others are in `now` until the next call."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        wanted = keys.difference(self.now)
        met = wanted.intersection(self.before)
        self.now.update((k, self.before[k]) for k in met)
        return wanted.difference(met)


class WordTokenizer:
    """Token ids of whole texts through a bounded cache of words.

    The tokenizer lower-cases, composes, drops white space and merges within the matches of its own pattern. For a text
    of Latin-1 characters, where lower case and composition are plain, the same matches are taken here, and only words
    that the cache lacks reach the tokenizer, many at a time. Other texts, and those that may hold one of its added
    tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), Aged(CACHE_WORDS)
        self.ends = np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def learn(self, fresh: set[str]) -> None:
        """Ids of new words: letters together, a word ends with the only id that carries the end mark; others alone."""
        now = self.words.now
        letters = [w for w in fresh if w.isalpha()]
        now.update((w, self.encode(w)) for w in fresh if not w.isalpha())
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u2")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                now.update((w, self.encode(w)) for w in part)
                continue
            raw = ids.tobytes()
            now.update((w, raw[2 * a : 2 * b]) for w, a, b in zip(part, [0, *cuts], cuts))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        split = [_match(t.lower()) if t and "<|" not in t and not _wide(t) else None for t in texts]
        self.learn(self.words.missing(set().union(*(s for s in split if s))))
        now, out = self.words.now, []
        for text, words in zip(texts, split):
            out.append(b"".join(map(now.__getitem__, words)) if words is not None else self.encode(text) if text else b"")
        return out


def tokenizer_for(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Always positive: what a hot group of documents shares still tells its members from others."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of one document and their counts."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


class Index:
    """Inverted index of a shard with BM25 weights; idf and mean length are the corpus's, or else the shard's own.

    The commonest terms are rows of a dense matrix, the others have posting lists; either is cheaper where it is used.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        n, sizes = len(ids), np.array([len(x) for x in ids])
        key = np.sort(np.concatenate(ids).astype(np.int64) | np.repeat(np.arange(n, dtype=np.int64) << 16, sizes))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, doc, term = np.diff(np.append(first, len(key))), key[first] >> 16, key[first] & (TERMS - 1)
        df = np.bincount(term, minlength=TERMS)
        idf = idf_of(df, n) if idf is None else idf
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if mean is None else mean))
        weight = (idf[term] * count * (K1 + 1) / (count + norm[doc])).astype(np.float32)
        self.n, self.forward, self.forward_ends = n, term, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        common = np.argsort(-df, kind="stable")[: DENSE // n]
        common = common[df[common] * 16 > n]
        self.place = np.full(TERMS, -1)
        self.place[common] = np.arange(len(common))
        at = self.place[term]
        self.dense = np.zeros((len(common), n), dtype=np.float32)
        self.dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.weight = doc[rare], weight[rare].astype(np.float64)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term[rare], minlength=TERMS))])

    def scores(self, seed: int) -> np.ndarray:
        terms = self.forward[self.forward_ends[seed] : self.forward_ends[seed + 1]]
        place = self.place[terms]
        total = self.dense[place[place >= 0]].sum(axis=0)
        rare = terms[place < 0]
        spans = [slice(a, b) for a, b in zip(self.ends[rare].tolist(), self.ends[rare + 1].tolist()) if b - a > 1]
        if spans:
            total = total + np.bincount(np.concatenate([self.doc[x] for x in spans]), weights=np.concatenate([self.weight[x] for x in spans]), minlength=self.n)
        return total


def best_first(scores: np.ndarray, some: int = 64):
    """Positions by falling score, ties in order, without those of score 0 or less; sorted as far as they are asked for."""
    if len(scores) > some:
        cut = np.partition(scores, -some)[-some]
        top = np.flatnonzero(scores >= max(cut, 1e-30))
        yield from top[np.argsort(-scores[top], kind="stable")].tolist()
        rest = np.flatnonzero((scores < cut) & (scores > 0))
    else:
        rest = np.flatnonzero(scores > 0)
    yield from rest[np.argsort(-scores[rest], kind="stable")].tolist()


class Packer:
    """Windows of WINDOW tokens; pieces come out as (document key, start, ids, document tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []
        self.filled = 0

    def close(self):
        at = 0
        for key, start, ids, total in self.open:
            yield key, start, ids, total, self.sequence, at
            at += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def add(self, key, ids):
        """Append a document, cut wherever a window is full."""
        start, total = 0, len(ids)
        while start < total:
            part = ids[start : start + self.window - self.filled]
            self.open.append((key, start, part, total))
            self.filled += len(part)
            start += len(part)
            if self.filled == self.window:
                yield from self.close()

    def block(self, keys: list, ids: list, index: Index | None = None):
        """Pack a shard: the best unused neighbours of the seed follow it until its window is full.

        The next seed is the document that was cut there, else the next unused one.
        """
        index, at, seed = index or Index(ids), 0, None
        unused = np.ones(len(ids), dtype=bool)
        while True:
            if seed is None:
                while at < len(ids) and not unused[at]:
                    at += 1
                if at == len(ids):
                    return
                seed, unused[at] = at, False
                yield from self.add(keys[at], ids[at])
                if not self.filled:
                    seed = None
                    continue
            seed_of_next = None
            for k in best_first(np.where(unused, index.scores(seed), 0)) if unused.any() else ():
                unused[k], before = False, self.sequence
                yield from self.add(keys[k], ids[k])
                if self.sequence != before:
                    seed_of_next = k if self.filled else None
                    break
            seed = seed_of_next

    def finish(self):
        """Cut the unfinished window into sequences whose lengths are powers of two, the longest first."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                key, start, ids, total = rest.pop(0)
                self.open.append((key, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (key, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self.close()


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, keep_words: bool = True) -> DataFrame:
    """row (task and position), doc_id and ids as little-endian unsigned 16-bit integers.

    A Python worker keeps its cache of words for its next task, or else drops it at the end of each: idle workers that
    have tokenised hold some 100 MB, which stages of other operators lack.
    """

    def run(batches):
        tokenizer, row = tokenizer_for(tokenizer_path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                raws = [raw + end for raw in tokenizer.encode_batch(some.column(1).to_pylist())]
                rows = np.arange(row, row + len(raws))
                row += len(raws)
                yield pa.RecordBatch.from_arrays([pa.array(rows), some.column(0), pa.array(raws, pa.binary())], names=["row", "doc_id", "ids"])
        if not keep_words:
            _tokenizers.clear()
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, ids binary")


def counted(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each term, documents and tokens of the whole corpus; tasks send sums by term."""

    def run(batches):
        df, docs, size = np.zeros(TERMS, dtype=np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                terms, counts = terms_of(np.frombuffer(raw, "<u2"))
                df[terms] += 1
                docs, size = docs + 1, size + int(counts.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), TERMS, TERMS + 1], pa.int64()), pa.array([*df[some].tolist(), docs, size], pa.int64())], names=["key", "n"])

    sums = dict(tokens.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n")).collect())
    df = np.zeros(TERMS, dtype=np.int64)
    for key in (k for k in sums if k < TERMS):
        df[key] = sums[key]
    return df, sums.get(TERMS, 0), sums.get(TERMS + 1, 0)


@cache
def directions(seed: int, rows: int) -> np.ndarray:
    """Random vectors, the same in every task."""
    return np.random.default_rng(seed).standard_normal((rows, DIMENSIONS), dtype=np.float32)


def vectors(raws: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of documents: random directions of their terms, weighted by idf and saturated counts."""
    out = np.empty((len(raws), DIMENSIONS), dtype=np.float32)
    for i, raw in enumerate(raws):
        terms, counts = terms_of(np.frombuffer(raw, "<u2"))
        out[i] = (idf[terms] * counts / (counts + K1)).astype(np.float32) @ directions(1, TERMS)[terms]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Hyperplanes that halve a sample along its widest direction, DEPTH times; leaves count from left to right."""

    def __init__(self, x: np.ndarray):
        self.way, self.cut = np.zeros((1 << DEPTH, DIMENSIONS), dtype=np.float32), np.zeros(1 << DEPTH, dtype=np.float32)
        held = {1: x}
        for node in range(1, 1 << DEPTH):
            own = held.pop(node, x[:0])
            if len(own) > 1:
                self.way[node] = np.linalg.eigh(np.cov(own.T))[1][:, -1]
                side = own @ self.way[node]
                self.cut[node] = np.median(side)
                held[2 * node], held[2 * node + 1] = own[side <= self.cut[node]], own[side > self.cut[node]]

    def places(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Longs by which like documents stand together: leaf, signs within it, and a salt that deals equal ones."""
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + ((x * self.way[node]).sum(axis=1) > self.cut[node])
        signs = (x @ directions(2, SIGNS).T > 0) @ (1 << np.arange(SIGNS, dtype=np.int64))
        salt = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 63 + DEPTH + SIGNS)
        return (node - (1 << DEPTH)) << (63 - DEPTH) | signs << (63 - DEPTH - SIGNS) | salt.astype(np.int64)


def dealt(tokens: DataFrame, idf: np.ndarray, docs: int, size: int) -> DataFrame:
    """place, row, doc_id and ids, in ranges of even cost by place, sorted within each."""
    ranges = min(MOST_RANGES, -(-(size + DOC_COST * docs) // RANGE_COST))
    step = max(1, docs // max(SAMPLE, 16 * ranges))

    def see(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 + DOC_COST for x in batch.column(1).to_pylist()], pa.int64()), pa.array([x.astype(np.float16).tobytes() for x in vectors(batch.column(1).to_pylist(), idf)], pa.binary())], names=["row", "cost", "x"])

    sample = tokens.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("row", "ids").mapInArrow(see, "row long, cost long, x binary").toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    tree = Tree(x[np.argsort(sample["row"].to_numpy())][:: max(1, len(x) // SAMPLE)])
    place = tree.places(x, sample["row"].to_numpy())
    order = np.argsort(place)
    cost = np.cumsum(sample["cost"].to_numpy()[order])
    bounds = place[order][np.searchsorted(cost, cost[-1] * np.arange(1, ranges) / ranges)] if len(x) else place

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                places = tree.places(vectors(batch.column(2).to_pylist(), idf), batch.column(0).to_numpy())
                part = np.searchsorted(bounds, places).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(places), *batch.columns], names=["part", "place", "row", "doc_id", "ids"])

    routed = tokens.mapInArrow(route, "part int, place long, row long, doc_id long, ids binary")
    return routed.repartitionById(ranges, "part").sortWithinPartitions("place", "row").select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, keep_words: bool = True) -> DataFrame:
    """Pieces of all documents packed into sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit integers; a document's ids end with `end_id`, a null or empty text has that
    one only. Every id lies in exactly one piece, repeated rows are packed as often as they occur, a null doc_id stays
    null, long texts are cut where a window is full; a document longer than a shard is a shard of its own. Equal
    documents are dealt by a salt, so that a hot group spreads over ranges. Sequence ids are unique; other columns are
    not read. An empty table gives an empty result. Tokens are stored, and the order of a range is fixed, so that a
    retried task gives the same rows. For keep_words see tokenised().
    """
    tokens = materialize(tokenised(docs, tokenizer_path, end_id, keep_words), "tokens")
    df, n, size = counted(tokens)
    names = SCHEMA.replace(" long", "").replace(" binary", "").split(", ")
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    idf, mean = idf_of(df, n), size / n

    def fill(batches):
        packer, keys, ids, held = Packer(TaskContext.get().partitionId() << 33, window), [], [], 0

        def emit(pieces):
            some = []
            for piece in pieces:
                some.append(piece)
                if len(some) == 4096:
                    yield table_of(some)
                    some = []
            if some:
                yield table_of(some)

        def table_of(some):
            columns = list(zip(*some))
            longs = [pa.array(columns[0], pa.int64()), *(pa.array(x, pa.int64()) for x in (columns[1], [len(x) for x in columns[2]], columns[3], columns[4], columns[5]))]
            return pa.RecordBatch.from_arrays([*longs, pa.array([x.astype("<u4").tobytes() for x in columns[2]], pa.binary())], names=names)

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (held + len(raw) // 2 > SHARD_TOKENS or len(keys) == SHARD_DOCS):
                    yield from emit(packer.block(keys, ids, Index(ids, idf, mean)))
                    keys, ids, held = [], [], 0
                keys.append(key)
                ids.append(np.frombuffer(raw, "<u2"))
                held += len(raw) // 2
        if keys:
            yield from emit(packer.block(keys, ids, Index(ids, idf, mean)))
        yield from emit(packer.finish())
        del packer, keys, ids
        give_back()

    return dealt(tokens, idf, n, size).mapInArrow(fill, SCHEMA)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
