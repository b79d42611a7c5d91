"""Byte-level BPE: ranked merges fold over the bytes of distinct words in Spark's higher-order functions.

The rank map is a literal: the pairs of tokens that merge, laid out by a perfect hash so that a look-up costs three array
accesses however many pairs there are. Texts are split in Arrow batches; a word of the bounded cache, itself made by the
fold, gives its ids there, and each distinct other word of a document goes through the fold once, as an array of its bytes. Decoding joins the
binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import discard, let, literal_of, materialize, sample_docs

ID_BITS = 17
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = ID_MASK
POS_BITS = 29
BUCKETS = 1 << 16
CACHE_WORDS = 1 << 19
FLAT = 256  # bytes of a word up to which the fold's state is one array
ROWS = 512  # of a batch that are split together


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's lines, base64 of the bytes and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def array_literal(spark: SparkSession, values, kind: pa.DataType, sql: str) -> Column:
    """A literal array of a driver-side list, in Spark's compact binary form."""
    return literal_of(spark.createDataFrame(pa.table({"v": pa.array([values], pa.list_(kind))})).select(F.col("v").cast(f"array<{sql}>")))


def hash_of(data: bytes) -> int:
    """Spark's xxhash64: of a string's bytes, or of a long as eight little-endian bytes."""
    return xxhash.xxh64_intdigest(data, seed=42)


def slot_of(value: Column, shift: Column, size: int) -> Column:
    """Where a perfect hash puts a value; the value stands twice, for interpreted expressions cost by their number."""
    h = F.xxhash64(value)
    return (F.shiftrightunsigned(h, 20) + F.get(shift, h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int"))).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")


def displaced(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A perfect hash of 64-bit hashes: displacements by hash modulo BUCKETS, the slot of each, the table's size.

    The size is a power of two. Full buckets choose first; each takes the first displacement that puts all its keys on
    free slots.
    """
    size = 1 << (2 * len(hashes)).bit_length()
    bucket, base = (hashes & np.uint64(BUCKETS - 1)).astype(int), ((hashes >> np.uint64(20)) & np.uint64(size - 1)).astype(int)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=BUCKETS)
    ends = np.cumsum(counts)
    free, shift, slots = np.ones(size, dtype=bool), np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    for b in np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]:
        own = order[ends[b] - counts[b] : ends[b]]
        d = 0
        while True:
            at = (base[own] + d) & (size - 1)
            if free[at].all() and len(set(at.tolist())) == len(at):
                break
            d += 1
            if d >= size:
                raise RuntimeError("no displacement fits; two keys share a hash")
        free[at], shift[b], slots[own] = False, d, at
    return shift, slots, size


class Vocabulary:
    """A rank file: literals of the ids of single bytes and of the merging pairs, and the bytes of each rank."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        if max(ranks.values()) >= NO_RANK:
            raise ValueError(f"ranks must stay below {NO_RANK}")
        pairs = [(ranks[k[:i]] << ID_BITS | ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        shift, slots, self.size = displaced(np.array([hash_of(struct.pack("<q", k)) for k, _ in pairs], dtype=np.uint64))
        entries = np.full(self.size, 1 << 62, dtype=np.int64)
        entries[slots] = [k << ID_BITS | r for k, r in pairs]
        self.shift = array_literal(spark, shift.astype(np.int32), pa.int32(), "int")
        self.entries = array_literal(spark, entries, pa.int64(), "bigint")
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for k, r in ranks.items():
            self.pieces[r] = k
        # crc32 tells the 256 bytes apart by eight of its bits; Spark has no function from a byte to its number.
        self.crc_shift = next(s for s in range(25) if len({zlib.crc32(bytes([b])) >> s & 255 for b in range(256)}) == 256)
        self.single_ids, single = [ranks[bytes([b])] for b in range(256)], [0] * 256
        for b in range(256):
            single[zlib.crc32(bytes([b])) >> self.crc_shift & 255] = ranks[bytes([b])]
        self.single = array_literal(spark, single, pa.int64(), "bigint")

    def rank(self, left: Column, right: Column) -> Column:
        """Rank of a pair of ids, which is the id of what they merge to; NO_RANK if they do not merge or one is null."""
        key = F.shiftleft(left, ID_BITS).bitwiseOR(right)
        # An entry is key and rank: what is left of its own key is the rank, of any other key more than NO_RANK.
        return let(key, lambda k: F.least(F.get(self.entries, slot_of(k, self.shift, self.size)).bitwiseXOR(F.shiftleft(k, ID_BITS)), F.lit(NO_RANK).cast("long")))

    def bytes_of(self, word: Column) -> Column:
        """The ids of the single bytes of a word."""
        raw = word.cast("binary")
        return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.get(self.single, F.shiftright(F.crc32(F.substring(raw, i, F.lit(1))), self.crc_shift).bitwiseAND(F.lit(255).cast("long")).cast("int")))

    def merged(self, ids: Column) -> Column:
        """Ids of one word: fold the merge of the adjacent pair of least rank, the leftmost on ties, until none is left.

        It starts from the ids of single bytes. The state is an array of longs, rank of the pair that starts here, then
        byte position, then id: its least element is the next merge. A merge makes one element of two and changes the
        rank of the one before. The state of a word over FLAT bytes is cut into blocks, of which a merge rebuilds three,
        so that a step costs about the square root of the word's length.
        """
        size = F.size(ids)
        mask = F.lit(ID_MASK).cast("long")
        low, rest = F.lit((1 << (POS_BITS + ID_BITS)) - 1).cast("long"), F.lit(((1 << POS_BITS) - 1) << ID_BITS).cast("long")
        top = POS_BITS + ID_BITS
        no_rank = F.lit(NO_RANK << top).cast("long")

        def made(rank: Column, where: Column) -> Column:
            return F.shiftleft(rank, top).bitwiseOR(where)

        start = F.transform(ids, lambda v, i: made(self.rank(v, F.get(ids, i + 1)), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(v)))

        def merge_at(s: Column, i: Column, new: Column) -> Column:
            """s with its elements i and i + 1 (from 1) made one, whose id is `new`."""
            before, after = F.get(s, i - 2), F.get(s, i + 1)
            own = F.get(s, i - 1).bitwiseAND(rest).bitwiseOR(new)
            ranked = made(self.rank(new, after.bitwiseAND(mask)), own)
            tail = F.slice(s, i + 2, F.size(s))
            return F.when(i > 1, F.concat(F.slice(s, 1, i - 2), F.array(made(self.rank(before.bitwiseAND(mask), new), before.bitwiseAND(low)), ranked), tail)).otherwise(F.concat(F.array(ranked), tail))

        def step(s: Column, _: Column) -> Column:
            return let(F.array_min(s), lambda m: F.when(m >= no_rank, s).otherwise(let(F.array_position(s, m).cast("int"), lambda i: merge_at(s, i, F.shiftright(m, top)))))

        def cut(x: Column, parts: Column) -> Column:
            """x in so many blocks of even size."""
            at = lambda p: (p.cast("long") * F.size(x) / parts).cast("int")
            return F.transform(F.sequence(F.lit(1), parts), lambda p: F.slice(x, at(p - 1) + 1, at(p) - at(p - 1)))

        # Blocks have two elements or more, else there is one block: a pair, the element before and the one after lie
        # in three neighbouring blocks.
        block = F.greatest(F.lit(64), F.sqrt(size).cast("int"))

        def state(blocks: Column, least: Column) -> Column:
            return F.struct(blocks.alias("b"), least.alias("m"))

        def rebuilt(s: Column, m: Column, k: Column) -> Column:
            first, last = F.greatest(k - 1, F.lit(1)), F.least(k + 1, F.size(s["b"]))
            near = F.flatten(F.slice(s["b"], first, last - first + 1))
            merged = let(near, lambda x: let(F.array_position(x, m).cast("int"), lambda i: merge_at(x, i, F.shiftright(m, top))))
            new = let(merged, lambda x: cut(x, F.greatest(F.lit(1), F.floor(F.size(x) / block).cast("int"))))
            around = lambda old, made_: F.concat(F.slice(old, 1, first - 1), made_, F.slice(old, last + 1, F.size(old)))
            return let(new, lambda x: state(around(s["b"], x), around(s["m"], F.transform(x, F.array_min))))

        def long_step(s: Column, _: Column) -> Column:
            return let(F.array_min(s["m"]), lambda m: F.when(m >= no_rank, s).otherwise(let(F.array_position(s["m"], m).cast("int"), lambda k: rebuilt(s, m, k))))

        begun = let(start, lambda x: let(cut(x, F.greatest(F.lit(1), F.floor(size / block).cast("int"))), lambda x: state(x, F.transform(x, F.array_min))))
        steps = F.sequence(F.lit(2), size)
        folded = F.when(size > FLAT, F.aggregate(steps, begun, long_step, lambda s: F.flatten(s["b"]))).otherwise(F.aggregate(steps, start, step))
        return F.transform(F.when(size > 1, folded).otherwise(start), lambda x: x.bitwiseAND(mask).cast("int"))


def narrowed(pattern: str) -> str | None:
    """The pattern with its Unicode classes spelt out for Latin-1, for a faster library; None if it uses others."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        m = re.compile(r"\\p\{\w+\}|\\.|.", re.S).match(pattern, at)
        part, at = m.group(), m.end()
        if re.match(r"\\(p|[sS]$)", part):
            kind = regex.compile(wide(part.lower() if part == "\\S" else part))
            own = "".join(f"\\x{c:02x}" for c in range(256) if kind.match(chr(c)))
            if inside and part == "\\S" or not own:
                return None
            part = own if inside else f"[^{own}]" if part == "\\S" else f"[{own}]"
        elif part[0] == "\\" and part[1].isalnum():
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return "".join(out)


def wide(pattern: str) -> str:
    """White space as Unicode has it."""
    return re.sub(r"\\S", r"\\P{White_Space}", re.sub(r"\\s", r"\\p{White_Space}", pattern))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Matches of the splitting pattern in a text, with Unicode classes as the pattern's own library has them."""
    whole = regex.compile(wide(pattern)).findall
    narrow, beyond = narrowed(pattern), re.compile("[^\\x00-\\xff]").search
    if narrow is None:
        return whole
    fast = re.compile(narrow).findall
    return lambda text: whole(text) if beyond(text) else fast(text)


def word_cache(docs: DataFrame, vocabulary: Vocabulary, pattern: str, sample_rows: int = 20_000, words: int = CACHE_WORDS) -> dict[str, bytes]:
    """Ids, as little-endian 32-bit integers, of the `words` most frequent words of about `sample_rows` documents.

    Both bounds hold at every size of the input; the cache changes the cost, never the result.
    """

    def count(batches):
        find = splitter(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                tally = Counter()
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    tally.update(find(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(tally, pa.string()), pa.array(tally.values(), pa.int64())], names=["k", "n"])

    counted = sample_docs(docs.select("doc_id", "text"), sample_rows, limit=False).select("text").mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    common = counted.where(F.octet_length("k") <= 64).orderBy(F.desc("n"), "k").limit(words).select("k")
    stored = materialize(common, "words")
    encoded = stored.repartition(48, "k").select("k", let(vocabulary.bytes_of(F.col("k")), vocabulary.merged).alias("ids")).toArrow()
    discard(stored)
    ids = encoded["ids"].combine_chunks()
    raw, ends = ids.flatten().to_numpy().astype("<i4").tobytes(), np.cumsum(ids.value_lengths().to_numpy()).tolist()
    return {k: raw[4 * a : 4 * b] for k, a, b in zip(encoded["k"].to_pylist(), [0, *ends], ends)}


def filled(codes: list[bytes], folds: pa.ListArray) -> list[bytes]:
    """Codes with -k replaced by the k-th fold of the row."""
    sizes, values = np.array([len(c) >> 2 for c in codes]), np.frombuffer(b"".join(codes), "<i4")
    inner = folds.flatten()
    each, made = inner.value_lengths().to_numpy().astype(np.int64), inner.flatten().to_numpy()
    first_fold = np.cumsum(folds.value_lengths().to_numpy()) - folds.value_lengths().to_numpy()
    row, gap = np.repeat(np.arange(len(sizes)), sizes), values < 0
    which = first_fold[row[gap]] - values[gap] - 1
    room = np.ones(len(values), dtype=np.int64)
    room[gap] = n = each[which]
    at = np.cumsum(room) - room
    out = np.empty(int(room.sum()), dtype="<i4")
    out[at[~gap]] = values[~gap]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at[gap], n) + within] = made[np.repeat((np.cumsum(each) - each)[which], n) + within]
    raw, ends = out.tobytes(), (4 * np.cumsum(np.bincount(row, weights=room, minlength=len(sizes)))).astype(np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def folded(docs: DataFrame, vocabulary: Vocabulary, pattern: str, keep: tuple[str, ...], cache: dict[str, bytes] | None = None) -> DataFrame:
    """The columns in `keep` as _in0, _in1 and so on, `codes`, ids of known words and gaps, and `folds`, which fill the gaps."""
    sent = docs.sparkSession.sparkContext.broadcast(word_cache(docs, vocabulary, pattern) if cache is None else cache)
    hidden = [f"_in{i}" for i in range(len(keep))]
    single_ids = vocabulary.single_ids
    kinds = [T.StructField(h, docs.schema[c].dataType) for c, h in zip(keep, hidden)]

    def split(batches):
        find, known = splitter(pattern), sent.value.get
        single = single_ids.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some, parts, rests = batch.slice(at, ROWS), [], []
                for text in some.column(0).to_pylist():
                    words = find(text) if text else []
                    ids, rest = list(map(known, words)), {}
                    if None in ids:
                        for i in [i for i, x in enumerate(ids) if x is None]:
                            ids[i] = struct.pack("<i", -rest.setdefault(words[i], len(rest) + 1))
                    parts.append(b"".join(ids))
                    rests.append([list(map(single, w.encode())) for w in rest])
                yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(parts, pa.binary()), pa.array(rests, pa.list_(pa.list_(pa.int64())))], names=[*hidden, "codes", "rest"])

    texts = docs.select(F.col("text").alias("_text"), *[F.col(c).alias(h) for c, h in zip(keep, hidden)])
    coded = texts.mapInArrow(split, T.StructType([*kinds, T.StructField("codes", T.BinaryType()), T.StructField("rest", T.ArrayType(T.ArrayType(T.LongType())))]))
    return coded.select(*hidden, "codes", F.transform("rest", vocabulary.merged).alias("folds"))


def ids_of(batches):
    """The kept columns and the ids of ROWS rows of folded() at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield some.columns[:-2], filled(some.column(some.num_columns - 2).to_pylist(), some.column(some.num_columns - 1))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, keep: tuple[str, ...] = ("doc_id",), cache: dict[str, bytes] | None = None) -> DataFrame:
    """The columns in `keep` and `ids`, the token ids of each whole text as little-endian 32-bit integers, in one pass.

    A null or empty text has no ids. Repeated rows stay repeated; an empty table gives an empty result; a kept column
    may have any name. A word of any length is folded.
    """
    coded = folded(docs, vocabulary, pattern, keep, cache)

    def fill(batches):
        for kept, ids in ids_of(batches):
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], names=[*(f"_in{i}" for i in range(len(kept))), "ids"])

    return coded.mapInArrow(fill, T.StructType([*coded.schema.fields[:-2], T.StructField("ids", T.BinaryType())])).toDF(*keep, "ids")


def decoded(ids: bytes, pieces: list[bytes]) -> bytes:
    """The binary pieces of token ids, joined."""
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<i4").tolist()))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with `decoded`, the bytes of their `ids`; null ids give null."""
    sent, names = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces), encoded.columns
    at = names.index("ids")

    def run(batches):
        for batch in batches:
            joined = [None if x is None else decoded(x, sent.value) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by a space and of the decoded bytes.

    A null or empty text has no tokens and the digests of nothing; repeated rows stay repeated.
    """
    sent, coded = docs.sparkSession.sparkContext.broadcast(vocabulary.pieces), folded(docs, vocabulary, pattern, ("doc_id",))

    # Ids are filled in and hashed in one Python process, so that they don't travel once more.
    def run(batches):
        pieces = sent.value
        decimal = list(map(str, range(len(pieces)))).__getitem__
        for kept, ids in ids_of(batches):
            text = [hashlib.sha256(" ".join(map(decimal, np.frombuffer(x, "<i4").tolist())).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(decoded(x, pieces)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(text, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.withColumn("_in0", F.col("_in0").cast("long")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
