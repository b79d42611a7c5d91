"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
# Words that speak for personal data when they stand near a span, by kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
REACH = 40
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: from each @ leftwards over local characters, rightwards over the domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest end of each match, at a space or its own, that passes mod-97; the search goes on there, else a word on.

    A match has at most ten words, so the time stays linear.
    """
    out, m = [], IBAN.search(text)
    while m:
        ends = [m.end(), *(m.start() + i for i in range(m.end() - m.start() - 1, 0, -1) if m.group()[i] == " ")]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            out.append((m.start(), end))
        m = IBAN.search(text, end or ends[-1])
    return out


def extra_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("iban", *x) for x in ibans(text)]
    found += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised where one of its context words stands within REACH characters."""
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    return min(1.0, PRIOR[kind] + (0.3 if any(w in near for w in CONTEXT[kind]) else 0.0))


def find(text: str | None, least: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[float]]:
    """Base spans, all spans (base ones always stay, others from score `least`, not overlapping base) and the scores."""
    if not text:
        return [], [], []
    order = {k: n for n, k in enumerate((*KINDS, *EXTRA))}
    base = sorted(base_spans(text), key=lambda s: (order[s[0]], s[1]))
    more = [x for x in extra_spans(text) if score(text, *x) >= least and not any(s < x[2] and x[1] < e for _, s, e in base)]
    spans = sorted(base + more, key=lambda s: (order[s[0]], s[1]))
    return base, spans, [score(text, *s) for s in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_pii(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: counts and digest of base findings, all spans (code points, end exclusive), their scores.

    Null or empty texts have no finding; repeated rows stay repeated; other columns are not read. An empty table gives
    an empty result. Texts are read whole, in time linear in their length.
    """

    def scan(batches):
        for batch in batches:
            counts, digest, spans_out, scores = {k: [] for k in KINDS}, [], [], []
            for text in batch.column(1).to_pylist():
                base, spans, values = find(text, least)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans_out.append(joined(spans))
                scores.append(",".join(f"{v:.2f}" for v in values))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS), *(pa.array(x, pa.string()) for x in (digest, spans_out, scores))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
