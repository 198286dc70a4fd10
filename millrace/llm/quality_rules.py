"""Quality rules, line first (native expressions only).

Each line is judged on its own by punctuation, navigation and boilerplate rules; wordings
of page furniture are those of four languages, and count in lines of at most
``FURNITURE_WORDS`` words, as a paragraph may well speak of a privacy policy.  Failing
lines are removed, and a document that loses too much of its text, or fails a base rule,
is rejected.  Everything is a row-local expression over one
scan: no shuffle, no Python.

Defined cases: a null text has no words; a text without words fails the base rule
(fewer than ``MIN_WORDS`` words); very long texts and lines are judged whole (sorting the
word windows of one text is the only step that is not linear; windows of one text are told
apart by 64-bit hashes); repeated rows and null ids are
judged alike; an empty table gives an empty result; extra columns pass through and
lose to a result column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when more than this percentage of its word characters goes.
MAX_LOST_PERCENT = 40

# Classes of single characters, for counting.
_SYMBOLS = r"[#*$%&|<>]"
_SEPARATORS = r"[|»›·•]"
_PUNCTUATION = r"[!?;:=/\\_~^+\"`@.,()\[\]{}#*$%&|<>-]"
_HAS_WORD = r"[^\x20\x09-\x0D]"
_GAP = r"[\x20\x09-\x0D]"
#: Lines with fewer words are headings or labels when they lack final punctuation.
SHORT_LINE = 4
#: Boilerplate comes in lines of at most so many words.
FURNITURE_WORDS = 30

# Wordings of page furniture in English, French, German and Spanish, matched
# on lower-cased lines.
_NAVIGATION_WORDS = (
    "home", "menu", "log ?in", "sign ?(in|up)", "next( page)?", "previous( page)?", "back to top", "skip to (main )?content",
    "read more", "share (this|on) .*", "search", "contact( us)?", "about( us)?",
    "accueil", "connexion", "se connecter", "s'inscrire", "page suivante", "page précédente", "retour en haut", "aller au contenu",
    "lire la suite", "partager sur .*", "rechercher", "nous contacter", "à propos( de nous)?",
    "startseite", "anmelden", "registrieren", "nächste seite", "vorherige seite", "nach oben", "zum inhalt springen",
    "weiterlesen", "teilen auf .*", "suche", "kontakt", "über uns", "impressum",
    "inicio", "menú", "iniciar sesión", "registrarse", "página siguiente", "página anterior", "volver arriba", "ir al contenido",
    "leer más", "compartir en .*", "buscar", "contacto", "sobre nosotros",
)
_BOILERPLATE_WORDS = (
    "all rights reserved", "(accept|use[sd]?) (of )?cookies", "enable javascript", "terms of (use|service)", "privacy policy",
    "subscribe to our", "click here to", "lorem ipsum",
    "tous droits réservés", "utilis(e|ation) (de|des) cookies", "activer javascript", "conditions d'utilisation",
    "politique de confidentialité", "abonnez-vous à", "cliquez ici pour",
    "alle rechte vorbehalten", "(verwendet|verwendung von) cookies", "javascript aktivieren", "nutzungsbedingungen",
    "datenschutzerklärung", "abonnieren sie unseren", "klicken sie hier",
    "todos los derechos reservados", "uso de cookies", "activar javascript", "términos (de uso|y condiciones)",
    "política de privacidad", "suscríbete a", "haga clic aquí",
)
_NAVIGATION = f"^({'|'.join(_NAVIGATION_WORDS)})\\W*$"
_BOILERPLATE = "|".join(_BOILERPLATE_WORDS)


def _count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind))


def _chars(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(text) - _count(text, _GAP)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _let(value: Column, body) -> Column:
    """Bind *value* once for *body* (a lambda variable is not evaluated again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_fails(line: Column) -> Column:
    """True for a line that has words and breaks a rule; cheap tests come first."""
    low = F.lower(F.trim(line))

    def breaks(sizes: Column) -> Column:
        words, chars = sizes["words"], sizes["chars"]
        no_end = (words < SHORT_LINE) & ~line.rlike("[.!?…:;。！？][\"'”’»)\\]]*\\s*$")
        navigation = _let(_count(line, _SEPARATORS), lambda n: (n >= 3) & (n * 5 > words)) | low.rlike(_NAVIGATION)
        boilerplate = (words <= FURNITURE_WORDS) & low.rlike(_BOILERPLATE)
        odd = (words > SHORT_LINE) & (_count(line, _PUNCTUATION) * 4 > chars) | (_count(line, _SYMBOLS) * 10 > chars)
        return (chars > 0) & (no_end | navigation | boilerplate | odd)

    return _let(F.struct(F.size(_words(line)).alias("words"), _chars(line).alias("chars")), breaks)


def _n_repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are hashed to 64 bits; if any hash repeats they are sorted by hash and
    position, and equal neighbours are repeats.  Of the sorted repeat positions
    p1 < p2 < … the union of [p, p+2] has the sum of min(3, gap to the next) words, 3
    for the last.
    """

    def hit_positions(ws: Column) -> Column:
        return F.array_sort(
            F.filter(
                F.transform(
                    ws,
                    lambda x, i: F.when(
                        (x["h"] == F.get(ws, i - 1)["h"]) | (x["h"] == F.get(ws, i + 1)["h"]), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        )

    def covered(ps: Column) -> Column:
        return F.aggregate(
            F.transform(ps, lambda p, i: F.coalesce(F.least(F.get(ps, i + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0),
            lambda a, b: a + b,
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def count(hs: Column) -> Column:
        placed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeats = _let(F.sort_array(placed), lambda ws: _let(hit_positions(ws), covered))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), repeats).otherwise(0)

    return F.when(F.size(words) >= 3, _let(hashes, count)).otherwise(0)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of *docs* with the base measures, the verdict and the cleaned text."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    own = [c for c in docs.columns if c not in made]
    text = text_or_empty(text_col)
    lines = F.split(text, "\n")
    df = docs.select(
        *own,
        text.alias("_text"),
        _words(text).alias("_words"),
        lines.alias("_lines"),
    )
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), _SYMBOLS).cast("long").alias("n_symbols"),
        F.filter("_lines", lambda x: x.rlike(_HAS_WORD)).alias("_full"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_good"),
        _n_repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
    clean = F.array_join("_good", "\n")
    df = df.select(
        "*",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        clean.alias("clean_text"),
        (_chars(clean) * 100 < F.col("word_chars") * (100 - MAX_LOST_PERCENT)).alias("_lost"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias(
            "base_failed"
        ),
    )
    return df.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.col("_lost")).alias("kept"),
        "clean_text",
    )
