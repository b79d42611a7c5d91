"""Scalar text functions as Spark columns."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import constants as C

# Patterns of DOIs, years, affiliation marks, captions and equation tags.
DOI = r"10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+"
DOI_PAIR = rf"(?i)(?=10\.)(?:(?<=doi\.org/|doi:\s{{0,6}}|doi\s{{0,7}})({DOI})|({DOI}))"
YEAR_CONTEXT = r"(?s)\b((?:19|20)\d{2})\b(?<=(\A.{0,43}|.{44}))(?=(.{0,40}))"
AFFILIATION = r"(?:[\s,]*(?:\d+|[*†‡§¶]|(?<=[\s,])[a-z](?![a-z])))+\s*$"
WORD = "[A-Za-zÀ-ÿ]{2,}"
CAPTION = r"(?iu)^\s*(figure|fig\.?|scheme|table|таблица|рисунок|рис\.?|схема)\s*(S?\d+[a-z]?)"
TAG = r"(?:\s|~|\\quad|\\qquad|\\[ ,;!])+(\(\d+\)|\\tag\{\d+\})$"

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Text) -> Column:
    """Strip all Unicode white space, not only blanks."""
    return F.regexp_replace(col(x), r"(?U)\A\s+|\s+\z", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(x: Text) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(strip(x), r"(?U)\s+"), lambda w: w != "")


def starts_with_any(x: Column, starts) -> Column:
    """x, in lower case already, begins with one of the literals."""
    return F.lit(False) if not starts else _any([F.startswith(x, F.lit(s)) for s in starts])


def contains_any(x: Column, parts) -> Column:
    return _any([F.contains(x, F.lit(p)) for p in parts])


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def clean_text(x: Text) -> Column:
    """NBSP to blank, hyphenated line ends joined, lone line breaks to blanks, runs of blanks and tabs to one, stripped."""
    y = F.translate(col(x), " ", " ")
    for pattern, new in ((r"(?U)-\s*\n\s*", ""), (r"(?<!\n)\n(?!\n)", " "), (r"[ \t]+", " "), (r"(?U)\A\s+|\s+\z", "")):
        y = F.regexp_replace(y, pattern, new)
    return y


def _plain(s: str | None) -> str | None:
    return s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _decompose(values: pd.Series) -> pd.Series:
    return values.map(_plain)


@F.pandas_udf(T.ArrayType(T.StringType()))
def decompose_all(lists: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks of every text in a list."""
    return lists.map(lambda xs: None if xs is None else [_plain(x) for x in xs])


ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def normalize(x: Text, native: bool = False) -> Column:
    """Accents dropped, lower case, anything but a-z, 0-9 and white space to blanks, squeezed; null gives ''.

    native=True folds the Latin-1 letters by a table inside the JVM, exact for texts over that alphabet; else NFKD in
    an Arrow UDF.
    """
    y = F.coalesce(col(x).cast("string"), F.lit(""))
    y = F.lower(F.translate(y, ACCENTED, UNACCENTED) if native else _decompose(y))
    y = F.regexp_replace(y, r"(?U)[^a-z0-9\s]", " ")
    return strip(F.regexp_replace(y, r"(?U)\s+", " "))


def surname(author: Text, native: bool = False) -> Column:
    """Normalised surname: what stands before the comma, else the first word before a blank."""
    a = F.coalesce(col(author), F.lit(""))
    return normalize(F.when(F.contains(a, F.lit(",")), F.split_part(a, F.lit(","), F.lit(1))).otherwise(F.split_part(strip(a), F.lit(" "), F.lit(1))), native)


def scalar_match(predicted: Column, gold: Column, fuzzy: bool) -> Column:
    """Both normalised values non-empty and equal, or one within the other where fuzzy."""
    same = predicted == gold
    return (predicted != "") & (gold != "") & ((same | F.contains(predicted, gold) | F.contains(gold, predicted)) if fuzzy else same)


@F.pandas_udf(T.BooleanType())
def _ratio_reaches(predicted: pd.Series, gold: pd.Series, threshold: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, p, g).ratio() >= t for p, g, t in zip(predicted, gold, threshold)], dtype=bool)


def ratio_match(predicted: Column, gold: Column, threshold: float = C.RATIO_THRESHOLD) -> Column:
    """Matches as fuzzy text or by the sequence matcher's ratio, which only runs on the rest."""
    plain = scalar_match(predicted, gold, fuzzy=True)
    both = (predicted != "") & (gold != "")
    asked = lambda x: F.when(both & ~plain, x).otherwise(F.lit("?"))
    return plain | (both & _ratio_reaches(asked(predicted), asked(gold), F.lit(threshold)))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / total).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def placeholder_doi(doi: Text) -> Column:
    d = col(doi)
    tail = F.when(F.locate("/", d) > 0, F.substring(d, F.locate("/", d) + 1, F.length(d))).otherwise(d)
    return tail.rlike("0{5,}") | F.contains(tail, F.lit("xxxx"))


def doi_candidates(text: Text) -> Column:
    """Array of (pos, doi, anchored) in text order, placeholders left out."""
    x = F.coalesce(col(text), F.lit(""))
    near, bare = (F.regexp_extract_all(x, F.lit(DOI_PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(near.alias("near"), bare.alias("bare"))
    tidy = lambda d: F.lower(F.regexp_replace(d, r"""[.,;:)\]}>"']+$""", ""))
    found = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), tidy(F.when(p["near"] != "", p["near"]).otherwise(p["bare"])).alias("doi"), (p["near"] != "").alias("anchored")))
    return F.filter(found, lambda c: ~placeholder_doi(c["doi"]))


def find_doi(text: Text) -> Column:
    """The document's own DOI: among anchored ones, else all, the most frequent, the earliest on ties."""

    def best(all_found: Column) -> Column:
        pool = F.when(F.exists(all_found, lambda c: c["anchored"]), F.filter(all_found, lambda c: c["anchored"])).otherwise(all_found)
        return let(pool, lambda p: F.get(F.sort_array(F.transform(p, lambda c: F.struct((-F.size(F.filter(p, lambda d: d["doi"] == c["doi"]))).alias("n"), c["pos"].alias("pos"), c["doi"].alias("doi")))), F.lit(0))["doi"])

    return let(doi_candidates(text), best)


def guess_year(text: Text, as_of_year: int) -> Column:
    """Latest plausible year beside a publication phrase, else the latest plausible one; as_of_year stands for today."""
    x = F.coalesce(col(text), F.lit(""))
    year, upto, after = (F.regexp_extract_all(x, F.lit(YEAR_CONTEXT), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(year.alias("y"), upto.alias("u"), after.alias("a"))
    told = F.transform(zipped, lambda z: F.struct(z["y"].cast("int").alias("year"), contains_any(F.lower(F.concat(z["u"], z["a"])), C.YEAR_ANCHORS).alias("anchored")))
    plausible = F.filter(told, lambda t: t["year"].between(1900, as_of_year + 1))
    return let(plausible, lambda p: F.coalesce(F.array_max(F.transform(F.filter(p, lambda t: t["anchored"]), lambda t: t["year"])), F.array_max(F.transform(p, lambda t: t["year"]))))


def normalize_author(name: Text) -> Column:
    """'Last, First': affiliation marks cut from the end; a name with a comma or of one word stays."""
    cleaned = strip(F.regexp_replace(strip(name), AFFILIATION, ""))
    parts = words(cleaned)
    turned = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))
    return F.when(F.contains(cleaned, F.lit(",")) | (F.size(parts) < 2), cleaned).otherwise(turned)


def parse_byline(text: Text) -> Column:
    """Authors of a byline in order, each once."""
    pieces = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"(?i)\s*(?:,|;|·|\band\b|&)\s*"), lambda p: strip(p))
    named = F.transform(F.filter(pieces, lambda p: p.rlike(WORD)), lambda p: normalize_author(p))
    return F.array_distinct(F.filter(named, lambda n: n.rlike(WORD)))


def is_junk(text: Text) -> Column:
    return contains_any(F.lower(col(text)), C.JUNK)


def is_masthead(text: Text, top: Text) -> Column:
    """High on the page, and short or with a journal word."""
    x = strip(F.coalesce(col(text), F.lit("")))
    w = words(x)
    bare = F.transform(w, lambda t: F.lower(F.regexp_replace(t, r"^[.,:]+|[.,:]+$", "")))
    journal = F.arrays_overlap(bare, F.array(*[F.lit(j) for j in C.JOURNAL_WORDS]))
    return (col(top) <= 150) & (((F.size(w) <= 4) & (F.length(x) < 40)) | ((F.size(w) <= 6) & journal))


def is_person(name: Text) -> Column:
    """One to five words, all capitalised but for particles and initials' punctuation, none of them junk."""
    tokens = F.filter(F.split(F.translate(col(name), ",", " "), r"(?U)\s+"), lambda t: t != "")
    cores = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    passed = lambda c: (c == "") | F.lower(c).isin(*C.PARTICLES)
    upper = lambda c: c.rlike(r"^\p{Lu}")
    return ~is_junk(name) & F.size(tokens).between(1, 5) & F.forall(cores, lambda c: passed(c) | upper(c)) & F.exists(cores, lambda c: ~passed(c) & upper(c))


ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "#x27": "'", "nbsp": " ", "middot": "·", "copy": "©", "ndash": "–", "mdash": "—", "amp": "&"}


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _unescape_ended_in(text: str) -> str:
    return re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


@F.pandas_udf(T.StringType())
def _unescape_ended(values: pd.Series) -> pd.Series:
    return values.map(_unescape_ended_in, na_action="ignore")


def clean_markup(x: Text, ended: bool = False) -> Column:
    """Tags dropped, entities decoded, white space squeezed; what is left empty becomes null, '' stays ''.

    Texts that hold none but common entities are decoded by replacement, only others go to a library of all of them.
    That library, as browsers do, also decodes some names that lack their semicolon; ended=True leaves these.
    """
    bare = F.regexp_replace(col(x), "<[^>]+>", "")
    y = bare
    for entity, char in ENTITIES.items():
        y = F.replace(y, F.lit(f"&{entity};"), F.lit(char))
    other = bare.rlike(rf"&(?!(?:{'|'.join(ENTITIES)});)(?:#|[A-Za-z])")
    y = F.coalesce((_unescape_ended if ended else _unescape)(F.when(other, bare)), y)
    y = strip(F.regexp_replace(y, r"(?U)\s+", " "))
    return F.when(col(x) == "", F.lit("")).otherwise(F.nullif(y, F.lit("")))


def caption_kind(text: Text) -> Column:
    label = F.rtrim(F.lower(F.regexp_extract(col(text), CAPTION, 1)), F.lit("."))
    pairs = [F.lit(x) for kv in C.CAPTION_KINDS.items() for x in kv]
    return F.when(label != "", F.element_at(F.create_map(*pairs), label))


def caption_id(text: Text) -> Column:
    return F.concat(caption_kind(text), F.lit(" "), F.upper(F.regexp_extract(col(text), CAPTION, 2)))


def clean_latex(x: Text) -> Column:
    return strip(F.regexp_replace(col(x), TAG, " $1"))


def latex_id(x: Text) -> Column:
    n = F.regexp_extract(strip(x), r"(?:\((\d+)\)|\\tag\{(\d+)\})$", 1)
    m = F.regexp_extract(strip(x), r"(?:\((\d+)\)|\\tag\{(\d+)\})$", 2)
    digits = F.when(n != "", n).otherwise(m)
    return F.when(digits != "", F.concat(F.lit("("), digits, F.lit(")")))


def repair_table(reply: Text) -> Column:
    """Table cells of a model's JSON reply: fences cut, flat lists wrapped row by row, scalars as one cell, else none."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(reply), r"^`+|`+$", ""), r"^json", ""))
    data = F.get_json_object(body, "$.data")
    rows = F.from_json(data, "array<string>")
    row = lambda r: F.when(F.startswith(r, F.lit("[")), F.from_json(r, "array<string>")).otherwise(F.array(r))
    none = F.array().cast("array<array<string>>")
    flat = ~F.startswith(F.get(rows, F.lit(0)), F.lit("["))
    listed = F.when(F.size(rows) == 0, none).when(flat, F.transform(rows, lambda r: F.array(r))).otherwise(F.transform(rows, row))
    return F.when(data.isNull(), none).when(F.startswith(data, F.lit("[")), F.coalesce(listed, none)).otherwise(F.array(F.array(data)))


def is_empty_text(x: Text) -> Column:
    return F.coalesce(col(x), F.lit("")) == ""
