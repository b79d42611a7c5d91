"""Bibliographic metadata of documents from blocks, full text and look-up tables.

Blocks are rows (doc_id, page_no, pos, text, font, bold, top, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import constants as C
from papyrine.functions.text import clean_markup, find_doi, guess_year, is_junk, is_masthead, is_person, normalize_author, parse_byline, starts_with_any, strip

CROSSREF = (
    "struct<title:array<string>,author:array<struct<given:string,family:string,name:string>>,`container-title`:array<string>,"
    "issued:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,"
    "`published-online`:struct<`date-parts`:array<array<int>>>,abstract:string,subject:array<string>>"
)


def text_blocks(blocks: DataFrame, *pages: int) -> DataFrame:
    return blocks.where((F.col("kind") == "text") & (F.col("text") != "") & F.col("page_no").isin(*pages))


def front(blocks: DataFrame) -> DataFrame:
    """(doc_id, title, title_top, title_pos, abstract, authors, page_text) from the text blocks of pages 1 and 2, gathered once.

    Title: the largest block of page 1 that is neither junk nor masthead, else the largest. Abstract: the rest of the
    first block that opens with the word, else the block after it. Authors: persons of the first block below the title,
    before the abstract, that names any. page_text: page 1.
    """
    row = F.struct("page_no", "pos", "text", "top", F.coalesce("font", F.lit(0.0)).alias("font"), F.col("bold").cast("int").alias("bold"), (~is_junk("text") & ~is_masthead("text", "top")).cast("int").alias("plain"))
    gathered = text_blocks(blocks, 1, 2).groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("_b"))
    paged = gathered.select("doc_id", "_b", F.filter("_b", lambda x: x["page_no"] == 1).alias("_p"))
    ranked = F.transform("_p", lambda x: F.struct(x["plain"], x["font"], x["bold"], -x["top"], -x["pos"], x["text"].alias("text"), x["top"].alias("top"), x["pos"].alias("pos")))
    titled = paged.withColumn("_t", F.array_max(ranked))
    opens = lambda x: F.startswith(F.lower(strip(x["text"])), F.lit("abstract"))
    rest = lambda x: F.nullif(strip(F.regexp_replace(strip(x["text"]), r"(?iU)^abstract[\s:.\-—]*", "")), F.lit(""))
    abstract = F.get(F.array_compact(F.transform("_b", lambda x, i: F.when(opens(x), F.coalesce(rest(x), F.get("_b", i + 1)["text"])))), F.lit(0))
    below = F.sort_array(F.transform(F.filter("_p", lambda x: x["top"] > F.col("_t.top")), lambda x: F.struct(x["top"].alias("top"), x["pos"].alias("pos"), strip(x["text"]).alias("text"))))
    stop = F.array_position(F.transform("_below", lambda x: starts_with_any(F.lower(x["text"]), C.BYLINE_STOPS)), F.lit(True))
    before = F.when(F.col("_stop") == 0, F.col("_below")).otherwise(F.slice("_below", F.lit(1), F.greatest(F.col("_stop") - 1, F.lit(0)).cast("int")))
    names = F.transform(F.filter("_before", lambda x: ~is_junk(x["text"])), lambda x: F.filter(parse_byline(x["text"]), lambda n: is_person(n)))
    told = titled.withColumn("_below", below).withColumn("_stop", stop).withColumn("_before", before)
    return told.select(
        "doc_id", strip("_t.text").alias("title"), F.col("_t.top").alias("title_top"), F.col("_t.pos").alias("title_pos"), abstract.alias("abstract"),
        F.get(F.filter(names, lambda n: F.size(n) > 0), F.lit(0)).alias("authors"), F.array_join(F.transform("_p", lambda x: x["text"]), "\n").alias("page_text"),
    )


def titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, title, title_top, title_pos) of documents with text on page 1."""
    return front(text_blocks(blocks, 1)).select("doc_id", "title", "title_top", "title_pos")


def abstracts(blocks: DataFrame) -> DataFrame:
    """(doc_id, abstract) of documents that have one."""
    return front(blocks).where("abstract is not null").select("doc_id", "abstract")


def bylines(blocks: DataFrame) -> DataFrame:
    """(doc_id, authors) of documents that name any."""
    return front(text_blocks(blocks, 1)).where("authors is not null").select("doc_id", "authors")


def first_text(values: Column) -> Column:
    head = F.get(values, F.lit(0))
    return F.when(strip(head) != "", head)


def crossref_fields(message: Column) -> dict[str, Column]:
    """Metadata of a look-up record, given as the struct CROSSREF."""
    author = lambda a: (
        F.when((strip(F.coalesce(a["family"], F.lit(""))) != "") & (strip(F.coalesce(a["given"], F.lit(""))) != ""), F.concat(strip(a["family"]), F.lit(", "), strip(a["given"])))
        .when(strip(F.coalesce(a["family"], F.lit(""))) != "", strip(a["family"]))
        .when(F.coalesce(a["name"], F.lit("")) != "", normalize_author(a["name"]))
    )
    year = lambda k: F.get(F.get(message[k]["date-parts"], F.lit(0)), F.lit(0))
    none = F.array().cast("array<string>")
    return {
        "title": F.coalesce(clean_markup(first_text(message["title"])), F.lit("")),
        "authors": F.coalesce(F.filter(F.transform(message["author"], author), lambda a: a.isNotNull()), none),
        "abstract": F.when(strip(message["abstract"]) != "", clean_markup(message["abstract"])),
        "keywords": F.coalesce(F.filter(message["subject"], lambda s: s.isNotNull()), none),
        "journal": clean_markup(first_text(message["container-title"])),
        "year": F.coalesce(*[year(k) for k in ("issued", "published", "published-print", "published-online")]),
    }


def parse_crossref(records: DataFrame) -> DataFrame:
    """(doi, title, authors, abstract, keywords, journal, year) of look-up records (doi, message JSON); unreadable ones go."""
    parsed = records.select("doi", F.from_json("message", CROSSREF).alias("_m")).where("_m is not null")
    return parsed.select("doi", *[c.alias(k) for k, c in crossref_fields(F.col("_m")).items()])


def metadata(
    blocks: DataFrame, texts: DataFrame, as_of_year: int, crossref: DataFrame | None = None, llm=None, offline: bool = False
) -> DataFrame:
    """Metadata by a cascade: a look-up record replaces everything; else heuristics, whose gaps a language model may fill.

    texts: (doc_id, full_text). crossref: parse_crossref()'s table, or None. llm: a function from (doc_id, page_text) rows
    of the documents that need it to (doc_id, title, authors, abstract), or None. Only documents that the look-up misses
    reach the model. Neither runs where its argument is None; offline switches the look-up off.
    """
    told = texts.select("doc_id", find_doi("full_text").alias("doi"), guess_year("full_text", as_of_year).alias("year"))
    own = told.join(front(blocks), "doc_id", "left")
    none = F.array().cast("array<string>")
    own = own.select("doc_id", "doi", "year", F.coalesce("title", F.lit("")).alias("title"), "abstract", F.coalesce("authors", none).alias("authors"), "page_text")
    if crossref is not None and not offline:
        looked = crossref.select("doi", *[F.col(c).alias(f"c_{c}") for c in ("title", "authors", "abstract", "keywords", "journal", "year")], F.lit(True).alias("c_hit"))
        own = own.join(looked, "doi", "left")
    else:
        own = own.select("*", *[F.lit(None).cast(t).alias(f"c_{c}") for c, t in (("title", "string"), ("authors", "array<string>"), ("abstract", "string"), ("keywords", "array<string>"), ("journal", "string"), ("year", "int"), ("hit", "boolean"))])
    weak = F.length("title") < C.SHORT_TITLE
    if llm is not None:
        wanting = F.col("c_hit").isNull() & (weak | F.col("abstract").isNull() | (F.size("authors") == 0)) & F.col("page_text").isNotNull()
        page = own.where(wanting).select("doc_id", "page_text")
        answers = llm(page).select("doc_id", F.nullif(F.col("title"), F.lit("")).alias("l_title"), F.nullif(F.col("abstract"), F.lit("")).alias("l_abstract"), F.filter(F.transform("authors", lambda a: normalize_author(a)), lambda a: is_person(a)).alias("l_authors"))
        own = own.join(answers, "doc_id", "left")
    else:
        own = own.select("*", F.lit(None).cast("string").alias("l_title"), F.lit(None).cast("string").alias("l_abstract"), F.lit(None).cast("array<string>").alias("l_authors"))
    use_title = weak & F.col("l_title").isNotNull()
    use_abstract = F.col("abstract").isNull() & F.col("l_abstract").isNotNull()
    use_authors = (F.size("authors") == 0) & (F.coalesce(F.size("l_authors"), F.lit(0)) > 0)
    used, hit = use_title | use_abstract | use_authors, F.col("c_hit").isNotNull()
    return own.select(
        "doc_id",
        F.when(hit, F.col("c_title")).when(use_title, strip("l_title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.col("c_authors")).when(use_authors, F.col("l_authors")).otherwise(F.col("authors")).alias("authors"),
        F.when(hit, F.col("c_abstract")).when(use_abstract, F.col("l_abstract")).otherwise(F.col("abstract")).alias("abstract"),
        F.when(hit, F.col("c_keywords")).otherwise(none).alias("keywords"),
        "doi",
        F.when(hit, F.col("c_journal")).alias("journal"),
        F.when(hit, F.col("c_year")).otherwise(F.col("year")).alias("year"),
        F.when(hit, "crossref").when(used, "hybrid").otherwise("pdf").alias("metadata_source"),
        F.when(hit, C.CONFIDENCE["crossref"]).when(used, C.CONFIDENCE["hybrid"]).when(F.col("title") != "", C.CONFIDENCE["pdf"]).otherwise(C.CONFIDENCE["none"]).alias("metadata_confidence"),
    )
