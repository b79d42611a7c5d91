"""HTML pages as text blocks, by patterns: pages need not be well formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import clean_markup

HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
ELEMENT = r"(?is)<(h1|p|li|title)(?:\s[^>]*)?>(.*?)</"


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text) of title, h1, p and li elements, scripts, styles and comments left out."""
    shown = F.regexp_replace("html", HIDDEN, "")
    pairs = F.arrays_zip(F.regexp_extract_all(shown, F.lit(ELEMENT), F.lit(1)).alias("tag"), F.regexp_extract_all(shown, F.lit(ELEMENT), F.lit(2)).alias("body"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "e")).select("page_id", "pos", F.lower("e.tag").alias("tag"), clean_markup("e.body").alias("text"))
