"""Secret scans: a character convolutional network over every candidate and its context, besides base rules that stay."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import discard, materialize, sample_docs

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
CLASSES = ("letters", "mixed", "digits")  # of candidates; each has a threshold
LEFT, BODY, RIGHT = 24, 48, 24
WIDTH = LEFT + BODY + RIGHT
EMBED, FILTERS, KERNEL = 8, 24, 5
INSIDE = slice(LEFT, LEFT + BODY - KERNEL + 1)  # places of the convolution within the candidate
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string, n_extra long"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three base kinds, leftmost and non-overlapping per kind; matches that are too short are dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Every run of 12 or more key characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def class_of(run: str) -> int:
    """Index in CLASSES: without digits, with digits and letters, without letters."""
    if run.isalpha() or not any(map(str.isdigit, run)):
        return 0
    return 1 if any(map(str.isalpha, run)) else 2


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its context; a long one gives one window for each BODY characters of it."""
    out = []
    for at in range(start, end, BODY):
        body = text[at : min(end, at + BODY)]
        if at > start and len(body) < 8:
            continue
        left, right = text[max(0, at - LEFT) : at], text[at + len(body) : at + len(body) + RIGHT]
        out.append(left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0"))
    return out


def encode(texts: list[str]) -> np.ndarray:
    """Character classes: 0 padding, 1 to 95 printable ASCII, 96 line breaks, 97 anything else."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), WIDTH)
    out = np.full(codes.shape, 97, dtype=np.int64)
    printable = (codes >= 32) & (codes < 127)
    out[printable] = codes[printable] - 31
    out[codes == 0] = 0
    out[(codes == 10) | (codes == 13)] = 96
    return out


class CharCNN:
    """Embedding, one convolution, a maximum over the candidate and one over its context, logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (98, EMBED))
        self.conv = r.normal(0, 1 / np.sqrt(KERNEL * EMBED), (KERNEL * EMBED, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.2, 2 * FILTERS)
        self.shift = np.zeros(1)
        self.scale, self.offset, self.thresholds = 1.0, 0.0, np.full(len(CLASSES), np.inf)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def filtered(self, x: np.ndarray, dtype=np.float64):
        """Inputs of the convolution and its results at each place."""
        e = self.embed.astype(dtype)[x]
        wide = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBED)
        return wide, wide @ self.conv.astype(dtype) + self.bias.astype(dtype)

    def forward(self, x: np.ndarray):
        wide, h = self.filtered(x)
        inside = np.zeros(h.shape[1], dtype=bool)
        inside[INSIDE] = True
        hin, hout = np.where(inside[None, :, None], h, -1e9), np.where(inside[None, :, None], -1e9, h)
        pick = np.stack([hin.argmax(1), hout.argmax(1)], axis=1)
        top = np.concatenate([hin.max(1), hout.max(1)], axis=1)
        act = np.maximum(top, 0)
        return wide, pick, top, act, act @ self.out + self.shift[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """What forward() ends with, in single precision and without what training needs."""
        out = [np.zeros(0)]
        for at in range(0, len(x), 256):
            _, h = self.filtered(x[at : at + 256], np.float32)
            top = np.concatenate([h[:, INSIDE].max(1), np.maximum(h[:, : INSIDE.start].max(1), h[:, INSIDE.stop :].max(1))], axis=1)
            out.append(np.maximum(top, 0) @ self.out + self.shift[0])
        return np.concatenate(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -50, 50)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss, for each of parts()."""
        wide, pick, top, act, z = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(x)
        d_top = (d[:, None] * self.out) * (top > 0)
        g_conv, g_bias, g_embed = np.zeros_like(self.conv), np.zeros_like(self.bias), np.zeros_like(self.embed)
        rows = np.arange(len(x))
        for half in (0, 1):
            at, part = pick[:, half], d_top[:, half * FILTERS : (half + 1) * FILTERS]
            for f in range(FILTERS):
                g_conv[:, f] += wide[rows, at[:, f]].T @ part[:, f]
                g_bias[f] += part[:, f].sum()
                back = (part[:, f, None] * self.conv[:, f]).reshape(-1, EMBED)
                np.add.at(g_embed, x[rows[:, None], at[:, f, None] + np.arange(KERNEL)].ravel(), back)
        return [g_embed, g_conv, g_bias, act.T @ d, np.array([d.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, seed: int = 11) -> None:
        r, m, v, t = np.random.default_rng(seed), [np.zeros_like(p) for p in self.parts()], [np.zeros_like(p) for p in self.parts()], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                xb, yb = x[order[i : i + 128]], y[order[i : i + 128]]
                t += 1
                for p, g, a, b in zip(self.parts(), self.gradients(xb, yb), m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.99
                    b += 0.01 * g * g
                    p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings; then for each class the highest threshold that keeps the wanted recall.

        A class without a held-out finding adds none.
        """
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            a -= 0.05 * (((p - y) * z).mean() + 1e-3 * (a - 1))
            b -= 0.05 * (p - y).mean()
        self.scale, self.offset = float(max(a, 0.05)), float(b)
        for k in range(len(CLASSES)):
            own = np.sort(self.score(x[(y == 1) & (kinds == k)]))
            self.thresholds[k] = own[int((1 - recall) * len(own))] if len(own) else np.inf


ALPHABETS = {"letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "hex": "0123456789abcdef"}


def made_findings(n: int, texts: list[str], seed: int = 5) -> list[tuple[str, int]]:
    """(window, class) of random keys of common forms set into prose, as positive findings."""
    r, out = np.random.default_rng(seed), []
    heads = ("", "", "key: ", "auth=", "Bearer ", "export KEY=", "credential: ", "pwd=", "access ", '"')
    for _ in range(n):
        kind = list(ALPHABETS)[r.integers(len(ALPHABETS))]
        size = int(r.integers(12, 65))
        body = "".join(ALPHABETS[kind][k] for k in r.integers(0, len(ALPHABETS[kind]), size))
        prose = texts[r.integers(len(texts))] if texts else "some prose before and after the key"
        cut = int(r.integers(0, max(1, len(prose))))
        before = prose[max(0, cut - 40) : cut] + " " + heads[r.integers(len(heads))]
        text = before + body + " " + prose[cut : cut + 40]
        out.append((windows(text, len(before), len(before) + size)[0], class_of(body)))
    return out


def harmless(n: int, texts: list[str], seed: int = 6) -> list[tuple[str, int]]:
    """(window, class) of long words, numbered slugs, paths, dates and numbers, as negative findings besides real ones."""
    r, out = np.random.default_rng(seed), []
    for _ in range(n):
        words = (texts[r.integers(len(texts))] if texts else "plain words of some length follow here").split() or ["word"]
        pick = [re.sub(r"[^A-Za-z]", "", words[r.integers(len(words))]) or "word" for _ in range(4)]
        form = r.integers(6)
        body = (
            "-".join(pick[:3]) + "-" + str(r.integers(1, 9999)) if form == 0
            else "/" + "/".join(pick[:2]) + "/" + str(r.integers(1900, 2030)) + "/" + pick[2] if form == 1
            else f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(0, 24):02d}-{r.integers(0, 60):02d}-00Z" if form == 2
            else "_".join(pick) + str(r.integers(1, 99)) if form == 3
            else "".join(pick).lower() + str(r.integers(1, 9999)) if form == 4
            else "-".join(pick)
        )
        if len(body) >= 12:
            before = " ".join(pick) + " "
            out.append((windows(before + body + " " + " ".join(words[:6]), len(before), len(before) + len(body))[0], class_of(body)))
    return out


def train(docs: DataFrame, sample_rows: int = 2000, findings: int = 3000, recall: float = 0.95, per_document: int = 8) -> CharCNN:
    """Fit the network on the driver, and keep a fifth of all findings for calibration.

    Labelled findings: of about `sample_rows` documents at most `per_document` base findings (positive) and as many
    other candidates (negative) each; of either at most `findings`, by the hash of their windows, besides as many made
    keys and made harmless runs. The network's size is fixed. Null and empty texts give none.
    """

    def gather(batches):
        for batch in batches:
            kept: list[tuple[str, int, int]] = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                kept += [(w, 1, class_of(text[s:e])) for _, s, e in base[:per_document] for w in windows(text, s, e)[:1]]
                other = [c for c in candidates(text) if not any(s < c[1] and c[0] < e for _, s, e in base)]
                step = max(1, len(other) // per_document)
                kept += [(w, 0, class_of(text[s:e])) for s, e in other[::step][:per_document] for w in windows(text, s, e)[:1]]
                kept.append((text[len(text) // 2 : len(text) // 2 + WIDTH].ljust(WIDTH, "\0"), 2, 0))
            yield pa.RecordBatch.from_pydict({"w": [k[0] for k in kept], "y": [k[1] for k in kept], "kind": [k[2] for k in kept]}, schema=pa.schema([("w", pa.string()), ("y", pa.int32()), ("kind", pa.int32())]))

    found = materialize(sample_docs(docs.select("doc_id", "text"), sample_rows).select("text").mapInArrow(gather, "w string, y int, kind int"), "findings")
    negative, positive, prose = ([(r.w, r.kind) for r in found.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(findings).collect()] for y in range(3))
    discard(found)
    texts = [w.replace("\0", "") for w, _ in prose]
    positive, negative = positive + made_findings(findings, texts), negative + harmless(findings, texts)
    x, y = encode([w for w, _ in positive + negative]), np.array([1.0] * len(positive) + [0.0] * len(negative))
    kinds = np.array([k for _, k in positive + negative])
    order = np.random.default_rng(3).permutation(len(x))
    held = len(x) // 5
    model = CharCNN()
    model.fit(x[order[held:]], y[order[held:]])
    model.calibrate(x[order[:held]], y[order[:held]], kinds[order[:held]], recall)
    return model


def find(texts: list[str | None], model: CharCNN) -> list[list[tuple[str, int, int, float]]]:
    """All spans of each text with their scores: base spans, and others that the network takes for keys (kind `model`).

    Every candidate and every base span is scored; a span of the network's stands unless a base span covers it. A long
    run has the highest score of its windows.
    """
    queue, owner, at = [], [], {}
    for i, text in enumerate(texts):
        if not text:
            continue
        base = base_spans(text)
        for span in (*base, *(("model", *c) for c in candidates(text) if not any(s <= c[0] and c[1] <= e for _, s, e in base))):
            for w in windows(text, *span[1:]):
                queue.append(w)
                owner.append(at.setdefault((i, *span), len(at)))
    scores = np.zeros(len(at))
    for k in range(0, len(queue), 4096):
        np.maximum.at(scores, owner[k : k + 4096], model.score(encode(queue[k : k + 4096])))
    result: list[list] = [[] for _ in texts]
    for (i, kind, s, e), p in zip(at, scores.tolist()):
        if kind != "model" or p >= model.thresholds[class_of(texts[i][s:e])]:
            result[i].append((kind, s, e, p))
    order = {k: n for n, k in enumerate((*KINDS, "model"))}
    return [sorted(x, key=lambda s: (s[1], order[s[0]], s[2])) for x in result]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def scan_secrets(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """One row per document: counts and digest of base findings, all spans (code points, end exclusive), their scores.

    Null or empty texts have no finding; repeated rows stay repeated; other columns are not read. An empty table gives
    an empty result. Texts are read whole.
    """
    model = model or train(docs)

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_extra")}
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for spans in find(texts[at : at + 256], model):
                    base = [s for s in spans if s[0] != "model"]
                    for k in KINDS:
                        out[f"n_{k}"].append(sum(s[0] == k for s in base))
                    out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    out["spans"].append(joined(spans))
                    out["scores"].append(",".join(f"{s[3]:.3f}" for s in spans))
                    out["n_extra"].append(len(spans) - len(base))
            longs = [pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *longs, pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["scores"], pa.string()), pa.array(out["n_extra"], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_extra"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, model: CharCNN | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents, their own columns kept, with every found span of text replaced by a mark and n_chars counted anew.

    Overlapping spans give one mark. Null and empty texts stay, repeated rows stay repeated, long texts are read whole,
    an empty table gives an empty result.
    """
    model = model or train(docs)
    names, schema = docs.columns, docs.schema

    def redact(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            done = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                for text, spans in zip(part, find(part, model)):
                    if spans:
                        pieces, last = [], 0
                        for s, e in sorted(x[1:3] for x in spans):
                            if s >= last:
                                pieces += [text[last:s], mark]
                            last = max(last, e)
                        text = "".join(pieces) + text[last:]
                    done.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(done, batch.schema.field(at).type)
            if "n_chars" in names:
                k = batch.schema.get_field_index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in done], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, schema)
