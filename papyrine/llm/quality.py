"""Quality rules, line first: failing lines go, and a document that loses too much text goes with them. Native only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
# Phrases of lines that are notices or navigation, matched in lower case; English, French, German, Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
    "licensed under", "permission is hereby granted", "click here", "subscribe to our newsletter", "sign up now",
    "javascript is disabled", "skip to content", "powered by",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies",
    "cliquez ici", "abonnez-vous à notre", "inscrivez-vous", "aller au contenu", "mentions légales",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies",
    "hier klicken", "klicken sie hier", "newsletter abonnieren", "jetzt anmelden", "zum inhalt springen",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utilizamos cookies",
    "haga clic aquí", "suscríbase a nuestro", "regístrese ahora", "saltar al contenido", "aviso legal",
)
NAVIGATION = r"\|[^|\n]*\||(^|\s)[»›•→]\s.*(^|\s)[»›•→]\s|^\s*(Home|Accueil|Startseite|Inicio)\s*([|»›•→·/]|$)"
SENTENCE_END = r"[.!?…:;][\"')”»’]*(\s|$)"
LONG_LINE = 8  # words from which a line must hold the end of a sentence


def words_in(text):
    """Words of a text as an array, without empty strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def length_without(text, pattern: str):
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line):
    """Punctuation (half as many symbols and exclamation marks as words, or long and no end of a sentence), navigation, or boilerplate."""
    words = F.size(F.array_remove(F.split(line, SPACE), ""))
    marks = F.length(line) - F.length(F.regexp_replace(line, "[#*$%&|<>!]+", ""))
    return (marks * 2 > words) & (words > 1) | (words >= LONG_LINE) & ~line.rlike(SENTENCE_END) | line.rlike(NAVIGATION) | F.lower(line).rlike("|".join(BOILERPLATE))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_lost: float = 0.6, cleaned: bool = False) -> DataFrame:
    """The columns in `keep`, the base counts, the verdict of the line rules, and with `cleaned` the text they leave.

    A null text has no words and fails the base rules. Repeated rows stay repeated; ties do not arise. An empty table
    gives an empty result. Texts are read whole, and work grows as n log n of a text's words. Only built-in
    expressions run; 8-word windows are compared by 64-bit hashes of their words. The document keeps its place if it
    passes the base rules and failing lines hold at most `most_lost` of its word characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.col(c).alias(f"_in_{c}") for c in keep]
    one = docs.select(*own, text.alias("_text"), words_in(F.col("text")).alias("_words"), F.split(text, "\n").alias("_all"))
    # The rules are evaluated once a line, in a step of their own.
    one = one.withColumn("_lines", F.filter("_all", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).withColumn("_fails", F.transform("_all", line_fails))
    two = one.select(
        *[F.col(f"_in_{c}") for c in keep],
        "_all", "_fails",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        length_without(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    # Equal hashes stand together once sorted: a window is repeated if its hash equals a neighbour's.
    three = two.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.col("_sorted.h"))
    after = F.concat(F.slice(F.col("_sorted.h"), 2, F.greatest(F.size("_sorted"), F.lit(1))), F.array(F.lit(None).cast("bigint")))
    four = three.withColumn("_near", F.arrays_zip(F.col("_sorted").alias("s"), before.alias("b"), after.alias("a")))
    five = four.withColumn(
        "_at",
        F.sort_array(F.transform(F.filter("_near", lambda x: F.coalesce(x["s"]["h"] == x["b"], F.lit(False)) | F.coalesce(x["s"]["h"] == x["a"], F.lit(False))), lambda x: x["s"]["i"])),
    )
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("n")),
        lambda s: s["n"],
    )
    fails = lambda x, i: F.get("_fails", i)
    left = [F.array_join(F.filter("_all", lambda x, i: ~fails(x, i)), "\n").alias("_cleaned")] if cleaned else []
    six = five.select(
        *[F.col(f"_in_{c}") for c in keep],
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"),
        F.length(F.regexp_replace(F.array_join(F.filter("_all", fails), ""), SPACE, "")).cast("long").alias("lost_chars"),
        F.size(F.filter("_fails", lambda x: x)).cast("long").alias("n_failed_lines"),
        *left,
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return six.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") <= most_lost * F.col("word_chars"))).alias("kept"),
        "n_failed_lines", "lost_chars", *(["_cleaned"] if cleaned else []),
    )


def keep_good(docs: DataFrame, most_lost: float = 0.6) -> DataFrame:
    """The documents, their own columns kept, that pass; their texts without the failing lines, n_chars counted anew.

    Null, empty and short texts go, repeated rows stay repeated, columns may have any name. An empty table gives an
    empty result. Texts are read whole.
    """
    own = docs.columns
    hidden = [f"_c{i}" for i in range(len(own))]  # whatever the columns are called
    keyed = docs.select("text", *[F.col(c).alias(h) for c, h in zip(own, hidden) if c != "text"])
    kept = tuple(h for c, h in zip(own, hidden) if c != "text")
    # A filter does not pass a projection with a row number; else the optimizer would repeat the whole measure in it.
    good = measure(keyed, kept, most_lost, cleaned=True).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    cleaned = good.select(*[F.col("_cleaned" if c == "text" else h).alias(c) for c, h in zip(own, hidden)])
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in own else cleaned
