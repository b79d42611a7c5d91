"""Test tables seen as layout, metadata and evaluation inputs, by formulas that Spark and the SQL oracles share.

Texts enter whole: every line of every document is a block, and headings are rows beside the lines they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = """lines AS (
  SELECT doc_id, unnest(range(len(l)))::INT AS n, unnest(l) AS txt
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
)"""

RAW = LINES + """, raw AS (
  SELECT doc_id, n // 8 + 1 AS page_no, n AS seq, 600.0::DOUBLE AS page_w, 800.0::DOUBLE AS page_h,
    CASE WHEN (doc_id + n) % 23 = 0 THEN 1 ELSE 0 END AS type,
    (CASE WHEN n % 8 = 0 OR n % 2 = 1 THEN 50 ELSE 320 END)::DOUBLE AS x0,
    (CASE WHEN n % 8 = 0 THEN 560 WHEN n % 2 = 1 THEN 280 ELSE 550 END)::DOUBLE AS x1,
    (CASE WHEN (doc_id + n) % 17 = 0 THEN 30 ELSE 60 + 85 * ((n % 8 + 1) // 2) END)::DOUBLE AS y0,
    (CASE WHEN (doc_id + n) % 17 = 0 THEN 50 ELSE 80 + 85 * ((n % 8 + 1) // 2) END)::DOUBLE AS y1,
    txt, (CASE WHEN n = 0 THEN 18.0 WHEN n % 5 = 0 THEN 12.0 ELSE 10.0 END)::DOUBLE AS font, n % 5 = 0 AS bold
  FROM lines
)"""

ZONED = RAW + """, kept AS (
  SELECT * FROM raw WHERE type IN (0, 1) AND NOT (type = 0 AND (y0 < 50 OR y1 > page_h - 50))
), wide AS (
  SELECT *, (x1 - x0) > 0.7 * page_w AS spanning FROM kept
), zoned AS (
  SELECT *, 2 * sum(spanning::INT) OVER (PARTITION BY doc_id, page_no ORDER BY y0, seq ROWS UNBOUNDED PRECEDING) - spanning::INT AS zone FROM wide
), reach AS (
  SELECT *, max(x1) OVER (PARTITION BY doc_id, page_no, zone ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM zoned
), islands AS (
  SELECT *, sum(CASE WHEN x0 > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, zone ORDER BY x0, seq ROWS UNBOUNDED PRECEDING) AS col FROM reach
), cols AS (
  SELECT doc_id, page_no, zone, col, min(x0) AS "left", max(x1) AS "right" FROM islands GROUP BY ALL
), ordered AS (
  SELECT z.*, c.col, row_number() OVER (PARTITION BY z.doc_id, z.page_no ORDER BY z.zone, c.col, z.y0, z.seq) AS pos
  FROM zoned z JOIN (
    SELECT z.doc_id, z.seq, coalesce(min(c.col), 0) AS col FROM zoned z
    LEFT JOIN cols c ON c.doc_id = z.doc_id AND c.page_no = z.page_no AND c.zone = z.zone AND z.x0 BETWEEN c."left" - 10 AND c."right" + 10
    GROUP BY ALL
  ) c ON c.doc_id = z.doc_id AND c.seq = z.seq
)"""

FIRST_WORDS = "rtrim(array_to_string(string_split(txt, ' ')[1:{k}], ' '), ' .,')"
BLOCKS = LINES + f""", blocks AS (
  SELECT doc_id, 2 * n AS pos,
    CASE WHEN n = 0 THEN txt WHEN n = 7 THEN 'Introduction' WHEN n = 9 THEN 'Acknowledgements' WHEN n = 12 THEN 'References'
      WHEN n % 5 = 0 THEN (n // 5 + 1)::VARCHAR || '. ' || {FIRST_WORDS.format(k=5)} ELSE {FIRST_WORDS.format(k=3)} END AS text,
    (CASE WHEN n = 0 THEN 18.0 WHEN n % 5 = 0 THEN 12.0 WHEN n % 5 = 3 THEN 10.0 + 0.8 * ((doc_id + n) % 4) ELSE 10.0 END)::DOUBLE AS font,
    TRUE AS bold
  FROM lines WHERE n % 5 IN (0, 3) OR n IN (7, 9, 12)
  UNION ALL
  SELECT doc_id, 2 * n + 1, txt, 10.0::DOUBLE, FALSE FROM lines WHERE n > 0
)"""

FRONT = r"""front AS (
  SELECT doc_id, concat('Received 20', lpad((doc_id % 25)::VARCHAR, 2, '0'), ' https://doi.org/10.', 1000 + doc_id % 9000, '/j.', doc_id % 50, '. ',
    text, ' ref 10.', 2000 + doc_id % 100, '/c.', doc_id % 7, ' 19', 50 + doc_id % 50) AS txt
  FROM documents WHERE text IS NOT NULL
)"""

NAMES = """named AS (
  SELECT doc_id, text, list_transform(list_filter(string_split(replace(replace(replace(text, chr(10), ' '), 'ß', 's'), '|', ''), ' '), lambda w: length(w) >= 3),
    lambda w: upper(substr(w, 1, 1)) || lower(rtrim(substr(w, 2), '.,#*$%&!'))) AS w
  FROM documents WHERE text IS NOT NULL
), bylines AS (
  SELECT doc_id, text, concat(coalesce(w[1], 'Ann'), ' ', coalesce(w[2], 'Lee'), '1,2, ', coalesce(w[3], 'Bo'), ' ', coalesce(w[4], 'Day'), ' a,* and ',
    coalesce(w[5], 'Cy'), ' ', coalesce(w[6], 'Fox'), '; ', lower(coalesce(w[7], 'dee')), ' ', coalesce(w[1], 'Ann'), ' · ', coalesce(w[1], 'Ann'), ' ', coalesce(w[2], 'Lee')) AS byline
  FROM named
)"""

PAGES = NAMES + """, fb AS (
  SELECT doc_id, unnest([
    {'page_no': 1, 'pos': 0, 'text': 'Journal of ' || substr(byline, 1, strpos(byline, ' ') - 1), 'font': 20.0::DOUBLE, 'bold': FALSE, 'top': 40.0::DOUBLE},
    {'page_no': 1, 'pos': 1, 'text': 'www.example.org/' || doc_id, 'font': 30.0, 'bold': FALSE, 'top': 60.0},
    {'page_no': 1, 'pos': 2, 'text': string_split(text, chr(10))[1], 'font': 18.0, 'bold': TRUE, 'top': 100.0 + 40 * (doc_id % 3)},
    {'page_no': 1, 'pos': 3, 'text': CASE WHEN doc_id % 5 = 0 THEN 'Article published on the web' ELSE byline END, 'font': 10.0, 'bold': FALSE, 'top': 240.0},
    {'page_no': 1, 'pos': 4, 'text': CASE WHEN doc_id % 7 = 0 THEN 'Keywords: none' ELSE byline END, 'font': 10.0, 'bold': FALSE, 'top': 260.0},
    {'page_no': 1, 'pos': 5, 'text': CASE doc_id % 4 WHEN 0 THEN 'Abstract: ' || text WHEN 1 THEN 'ABSTRACT' WHEN 2 THEN 'Abstract' ELSE 'Summary' END, 'font': 10.0, 'bold': FALSE, 'top': 300.0},
    {'page_no': 2, 'pos': 6, 'text': text, 'font': 10.0, 'bold': FALSE, 'top': 60.0}
  ], recursive := true) FROM bylines
)"""

SCORES = NAMES + """, gold AS (
  SELECT doc_id AS stem, string_split(text, chr(10))[1] AS title, '10.' || (1000 + doc_id % 9000) || '/J.' || doc_id AS doi, (2000 + doc_id % 25)::BIGINT AS year,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Journal of É ' || (doc_id % 9) END AS journal,
    [coalesce(w[1], 'Ann') || ', ' || coalesce(w[2], 'Lee'), coalesce(w[3], 'Bo') || ' ' || coalesce(w[4], 'Day')] AS authors,
    CASE WHEN doc_id % 6 = 0 THEN []::VARCHAR[] ELSE list_distinct(w[1:5]) END AS keywords,
    (doc_id % 5)::BIGINT AS figures, (doc_id % 2)::BIGINT AS tables
  FROM named WHERE doc_id IN (SELECT doc_id FROM labels)
), pred AS (
  SELECT doc_id AS stem, CASE doc_id % 4 WHEN 0 THEN upper(replace(string_split(text, chr(10))[1], 'ß', '')) WHEN 1 THEN NULL WHEN 2 THEN 'x ' || string_split(text, chr(10))[1] ELSE 'another title' END AS title,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.' || (1000 + doc_id % 9000) || '/j.' || doc_id END AS doi, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 1999 ELSE 2000 + doc_id % 25 END::BIGINT AS year,
    CASE WHEN doc_id % 2 = 0 THEN 'journal of e ' || (doc_id % 9) END AS journal,
    CASE WHEN doc_id % 8 = 0 THEN []::VARCHAR[] ELSE [coalesce(w[1], 'Ann') || ', X', coalesce(w[5], 'Cy') || ' Z'] END AS authors,
    list_distinct(w[2:6]) AS keywords, (doc_id % 4)::BIGINT AS figures, (doc_id % 3)::BIGINT AS tables
  FROM named
)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "txt"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks with txt, font and bold instead of lines."""
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "int(n div 8 + 1) page_no", "n seq", "600.0D page_w", "800.0D page_h", "if((doc_id + n) % 23 = 0, 1, 0) type",
        "if(n % 8 = 0 or n % 2 = 1, 50.0D, 320.0D) x0", "case when n % 8 = 0 then 560.0D when n % 2 = 1 then 280.0D else 550.0D end x1",
        "double(if((doc_id + n) % 17 = 0, 30, 60 + 85 * ((n % 8 + 1) div 2))) y0", "double(if((doc_id + n) % 17 = 0, 50, 80 + 85 * ((n % 8 + 1) div 2))) y1",
        "txt", "case when n = 0 then 18.0D when n % 5 = 0 then 12.0D else 10.0D end font", "n % 5 = 0 bold",
    )


def spans():
    """A line's words as spans whose gaps are 3 or 6 points wide."""
    return F.expr("transform(split(txt, ' '), (w, i) -> struct(w as text, font as size, double(10 * i + i % 3) as x0, double(10 * i + i % 3 + 5) as x1, if(bold, 16, 0) as flags, 'Serif' as font))")


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks in the engine's own form, a line in each text block."""
    line = F.array(F.struct("x0", "y0", "x1", "y1", spans().alias("spans")))
    return raw(spark, sf_dir).select("doc_id", "page_no", "seq", "page_w", "page_h", "type", "x0", "y0", "x1", "y1", F.when(F.col("type") == 0, line).alias("lines"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with headings among the lines, for the section operators."""
    first = "trim(trailing ' .,' from array_join(slice(split(txt, ' '), 1, {k}), ' '))"
    x = lines(spark, sf_dir)
    heads = x.where("n % 5 in (0, 3) or n in (7, 9, 12)").selectExpr(
        "doc_id", "2 * n pos",
        f"case when n = 0 then txt when n = 7 then 'Introduction' when n = 9 then 'Acknowledgements' when n = 12 then 'References' when n % 5 = 0 then concat(n div 5 + 1, '. ', {first.format(k=5)}) else {first.format(k=3)} end text",
        "case when n = 0 then 18.0D when n % 5 = 0 then 12.0D when n % 5 = 3 then double(10.0 + 0.8 * ((doc_id + n) % 4)) else 10.0D end font", "true bold",
    )
    return heads.unionByName(x.where("n > 0").selectExpr("doc_id", "2 * n + 1 pos", "txt text", "10.0D font", "false bold")).withColumn("kind", F.lit("text"))


def front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).selectExpr(
        "doc_id",
        "concat('Received 20', lpad(string(doc_id % 25), 2, '0'), ' https://doi.org/10.', 1000 + doc_id % 9000, '/j.', doc_id % 50, '. ', text, ' ref 10.', 2000 + doc_id % 100, '/c.', doc_id % 7, ' 19', 50 + doc_id % 50) txt",
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).selectExpr(
        "doc_id", "text",
        r"transform(filter(split(translate(text, '\nß|', ' s'), ' '), w -> length(w) >= 3), w -> concat(upper(substr(w, 1, 1)), lower(trim(trailing '.,#*$%&!' from substr(w, 2))))) w",
    )


def bylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda i, d: f"coalesce(get(w, {i - 1}), '{d}')"
    return named(spark, sf_dir).selectExpr(
        "doc_id", "text",
        f"concat({w(1, 'Ann')}, ' ', {w(2, 'Lee')}, '1,2, ', {w(3, 'Bo')}, ' ', {w(4, 'Day')}, ' a,* and ', {w(5, 'Cy')}, ' ', {w(6, 'Fox')}, '; ', lower({w(7, 'dee')}), ' ', {w(1, 'Ann')}, ' · ', {w(1, 'Ann')}, ' ', {w(2, 'Lee')}) byline",
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a title page and the page behind it."""
    block = lambda page, pos, text, font, bold, top: f"named_struct('page_no', {page}, 'pos', {pos}, 'text', {text}, 'font', {font}, 'bold', {bold}, 'top', {top})"
    rows = "array(" + ", ".join([
        block(1, 0, "concat('Journal of ', substring_index(byline, ' ', 1))", "20.0D", "false", "40.0D"),
        block(1, 1, "concat('www.example.org/', doc_id)", "30.0D", "false", "60.0D"),
        block(1, 2, r"get(split(text, '\n'), 0)", "18.0D", "true", "100.0D + 40 * (doc_id % 3)"),
        block(1, 3, "if(doc_id % 5 = 0, 'Article published on the web', byline)", "10.0D", "false", "240.0D"),
        block(1, 4, "if(doc_id % 7 = 0, 'Keywords: none', byline)", "10.0D", "false", "260.0D"),
        block(1, 5, "case doc_id % 4 when 0 then concat('Abstract: ', text) when 1 then 'ABSTRACT' when 2 then 'Abstract' else 'Summary' end", "10.0D", "false", "300.0D"),
        block(2, 6, "text", "10.0D", "false", "60.0D"),
    ]) + ")"
    return bylines(spark, sf_dir).selectExpr("doc_id", f"inline({rows})").withColumn("kind", F.lit("text"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    return named(spark, sf_dir).join(labelled, "doc_id", "left_semi").selectExpr(
        "doc_id stem", r"get(split(text, '\n'), 0) title", "concat('10.', 1000 + doc_id % 9000, '/J.', doc_id) doi", "bigint(2000 + doc_id % 25) year",
        "if(doc_id % 3 = 0, null, concat('Journal of É ', doc_id % 9)) journal",
        "array(concat(coalesce(get(w, 0), 'Ann'), ', ', coalesce(get(w, 1), 'Lee')), concat(coalesce(get(w, 2), 'Bo'), ' ', coalesce(get(w, 3), 'Day'))) authors",
        "if(doc_id % 6 = 0, cast(array() as array<string>), array_distinct(slice(w, 1, 5))) keywords", "bigint(doc_id % 5) figures", "bigint(doc_id % 2) tables",
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).selectExpr(
        "doc_id stem", r"case doc_id % 4 when 0 then upper(replace(get(split(text, '\n'), 0), 'ß', '')) when 1 then null when 2 then concat('x ', get(split(text, '\n'), 0)) else 'another title' end title",
        "if(doc_id % 5 = 0, '', concat('10.', 1000 + doc_id % 9000, '/j.', doc_id)) doi", "bigint(case when doc_id % 7 = 0 then null when doc_id % 11 = 0 then 1999 else 2000 + doc_id % 25 end) year",
        "if(doc_id % 2 = 0, concat('journal of e ', doc_id % 9), null) journal",
        "if(doc_id % 8 = 0, cast(array() as array<string>), array(concat(coalesce(get(w, 0), 'Ann'), ', X'), concat(coalesce(get(w, 4), 'Cy'), ' Z'))) authors",
        "array_distinct(slice(w, 2, 5)) keywords", "bigint(doc_id % 4) figures", "bigint(doc_id % 3) tables",
    )
