"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans, the largest language wins."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import give_back, sample_docs

# Unicode ranges of the scripts told apart (first and last code point); letters elsewhere are "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF),),
}
NAMES = (*SCRIPTS, "other")
BUCKETS = 1 << 17
CACHE_WORDS = 200_000
TEXTS, CHARS = 1024, 3_000_000  # labelled together, one longer text alone
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans string, known double"


def script_of(word: str) -> int:
    """Index in NAMES of the script of the word's first letter; -1 without a letter."""
    for c in word:
        if c.isalpha():
            n = ord(c)
            for i, ranges in enumerate(SCRIPTS.values()):
                if any(a <= n <= b for a, b in ranges):
                    return i
            return len(SCRIPTS)
    return -1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, 1- to 4-grams with its borders and the word itself: (owner, bucket), vectorised."""
    marked = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 5):
        keep = len(codes) - n + 1
        if keep <= 0:
            break
        rolled = rolled[:keep] * np.uint64(1000003) + codes[n - 1 :] + np.uint64(1)
        whole = owner[:keep] == owner[n - 1 :]
        mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner[:keep][whole])
        buckets.append(((mixed >> np.uint64(40)) ^ np.uint64(n * 7919))[whole] % np.uint64(BUCKETS))
    ends = np.cumsum(sizes)
    whole_word = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    owners.append(np.arange(len(ends)))
    buckets.append(whole_word % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def portions(words: list[str], most: int = 1_000_000):
    """The words in lists of at most `most` characters, or of one longer word: what grams() takes at a time."""
    part, size = [], 0
    for w in words:
        if part and size + len(w) + 2 > most:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w) + 2
    if part:
        yield part


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Model:
    """Per-bucket log likelihood of each language, and the languages each script may stand for."""

    def __init__(self, langs: list[str], counts: np.ndarray, by_script: np.ndarray):
        self.langs = langs
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        logs = np.log(share)
        self.table = (logs - logs.mean(axis=0)).T.astype(np.float32).copy()  # bucket x language
        seen = (counts + 0.01) / (counts.sum(axis=1, keepdims=True) + 0.01 * BUCKETS)
        self.known = np.log(seen.max(axis=0) * BUCKETS).astype(np.float32)  # against a language of all features alike
        total = by_script.sum(axis=1, keepdims=True)
        may = by_script >= 0.001 * np.maximum(total, 1)
        may &= by_script > 0
        may[:, ~may.any(axis=0)] = True  # a script never seen narrows nothing
        self.may = may.T  # script x language

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of each word, at most 8 apart, and whether its features are those of a learned language.

        Zero without a letter; impossible languages by script far below.
        """
        familiar = np.zeros(len(words), dtype=bool)
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        scripts = np.array([script_of(w) for w in words])
        told = np.flatnonzero(scripts >= 0)
        if len(told):
            owner, bucket = grams([words[i] for i in told])
            for k in range(len(self.langs)):
                out[told, k] = np.bincount(owner, weights=self.table[bucket, k], minlength=len(told))
            out[told] = np.clip(out[told] - out[told].max(axis=1, keepdims=True), -8, 0)
            out[told] -= np.where(self.may[scripts[told]], 0, 20).astype(np.float32)
            familiar[told] = np.bincount(owner, weights=self.known[bucket], minlength=len(told)) > 0
        return out, familiar


def train(docs: DataFrame, sample_rows: int = 6000) -> Model:
    """Counts from about `sample_rows` (at most twice as many) documents with a lang whose crc32(doc_id) mod 5 is not 0.

    Texts are read whole; each task sends one row for each language and bucket, so the driver gets a bounded table.
    """
    rest = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = sample_docs(rest, sample_rows).select("text", "lang")

    def count(batches):
        tally: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in tally.items():
            letters = np.zeros(len(NAMES))
            sums = np.zeros(BUCKETS)
            for part in portions([w for w in words if script_of(w) >= 0]):
                owner, bucket = grams(part)
                times = np.array([words[w] for w in part], dtype=float)
                sums += np.bincount(bucket, weights=times[owner], minlength=BUCKETS)
                for w in part:
                    letters[script_of(w)] += len(w) * words[w]
            at = np.flatnonzero(sums)
            cells = [*at.tolist(), *(-1 - i for i in range(len(NAMES)))]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(cells), "cell": cells, "n": [*sums[at].tolist(), *letters.tolist()]}, schema=pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.float64())]))

    rows = chosen.mapInArrow(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist())) or ["und"]
    at = {k: i for i, k in enumerate(langs)}
    counts, by_script = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(NAMES)))
    which = np.array([at[x] for x in rows["lang"].to_pylist()], dtype=int)
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    inside = cell >= 0
    counts[which[inside], cell[inside]] = n[inside]
    by_script[which[~inside], -1 - cell[~inside]] = n[~inside]
    return Model(langs, counts, by_script)


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best path of each text over its words' log scores when every change of language costs `penalty`.

    All texts of the batch move together, word by word, the longest first; one that has ended leaves the front.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    k = scores[0].shape[1]
    flat = np.concatenate([scores[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    came = np.zeros(flat.shape, dtype=np.int16)
    best = np.zeros((len(order), k), dtype=np.float32)
    own = np.arange(k)
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    for t in range(longest):
        n = alive[t]
        at = starts[:n] + t
        if t:
            top = best[:n].argmax(axis=1)
            jump = best[np.arange(n), top] - penalty
            stay = best[:n] >= jump[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, best[:n], jump[:, None])
        best[:n] += flat[at]
    label = np.zeros(len(flat), dtype=np.int16)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        label[at] = now[:n]
        now[:n] = came[at, now[:n]]
    out: list[np.ndarray] = [label[:0]] * len(scores)
    for i, s, n in zip(order, starts, sizes):
        out[i] = label[s : s + n]
    return out


class Labeller:
    """Scores texts by batch; remembers the scores of up to CACHE_WORDS words between batches."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty, self.seen = model, penalty, {}
        self.matrix = np.zeros((0, len(model.langs)), dtype=np.float32)
        self.weight, self.familiar = np.zeros(0), np.zeros(0, dtype=bool)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.seen) > CACHE_WORDS:
            self.seen, self.matrix, self.weight, self.familiar = {}, self.matrix[:0], self.weight[:0], self.familiar[:0]
        fresh = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.seen]
        base = len(self.seen)
        self.seen.update((w, base + i) for i, w in enumerate(fresh))
        parts = [self.model.score(part) for part in portions(fresh)]
        self.matrix = np.concatenate([self.matrix, *(p[0] for p in parts)])
        self.familiar = np.concatenate([self.familiar, *(p[1] for p in parts)])
        self.weight = np.concatenate([self.weight, np.array([sum(map(str.isalpha, w)) for w in fresh], dtype=float)])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, str, float]]:
        """(language, its share of the letters, spans lang:first word:word after the last, share of familiar letters)."""
        split = [words_of(t) if t else [] for t in texts]
        self.learn(split)
        ids = [np.fromiter(map(self.seen.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
        told = [i for i, x in enumerate(ids) if len(x) and self.weight[x].sum() > 0]
        out = [("und", 0.0, "", 0.0)] * len(texts)
        if not told:
            return out
        for i, path in zip(told, viterbi([self.matrix[ids[i]] for i in told], self.penalty)):
            share = np.bincount(path, weights=self.weight[ids[i]], minlength=len(self.model.langs))
            cut = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cut.tolist(), len(path)]
            spans = ",".join(f"{self.model.langs[path[a]]}:{a}:{b}" for a, b in zip(edges, edges[1:]))
            k = int(share.argmax())
            known = float(self.weight[ids[i]] @ self.familiar[ids[i]] / self.weight[ids[i]].sum())
            out[i] = (self.model.langs[k], float(share[k] / share.sum()), spans, known)
        return out


def identify(docs: DataFrame, model: Model | None = None, penalty: float = 6.0) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans (lang:first:end in whitespace-split words), known.

    lang_pred is the language with most letters in the Viterbi spans (ties: first by name), score its share of letters.
    `known` is the share of letters in words whose features a learned language makes likelier than chance does.
    A text that is null or has no letter gets `und`, scores 0 and no spans. Repeated rows stay repeated; other columns are
    not read. An empty table gives an empty result. Texts are read whole.
    """
    model = model or train(docs)

    def run(batches):
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = []
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size < CHARS) and end - at < TEXTS:
                    size += len(texts[end] or "")
                    end += 1
                found += labeller.label(texts[at:end])
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.string()), pa.array([x[3] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "spans", "known"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None, penalty: float = 6.0, least: float = 0.3, least_known: float = 0.3) -> DataFrame:
    """The documents, their own columns kept, whose language covers `least` of their letters and is a learned one.

    At least `least_known` of the letters stand in words that look like a learned language: texts in a script or
    language never learned go, as do null texts and those without a letter. Repeated rows stay repeated, long texts are
    read whole, columns may have any name. An empty table gives an empty result.
    """
    model = model or train(docs)

    def run(batches):
        labeller = Labeller(model, penalty)
        for batch in batches:
            column, found = batch.column(batch.schema.get_field_index("text")), []
            for first in range(0, batch.num_rows, TEXTS):  # so many texts are Python's at once, not the whole batch
                texts, at = column.slice(first, TEXTS).to_pylist(), 0
                while at < len(texts):
                    size, end = 0, at
                    while end < len(texts) and (end == at or size < CHARS):
                        size += len(texts[end] or "")
                        end += 1
                    found += labeller.label(texts[at:end])
                    at = end
            yield batch.filter(pa.array([k != "und" and s >= least and known >= least_known for k, s, _, known in found], pa.bool_()))
        del labeller
        give_back()

    return docs.mapInArrow(run, docs.schema)
