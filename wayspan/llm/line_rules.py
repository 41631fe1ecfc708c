"""Quality rules, lines first: every line with a word is judged, failing lines are removed, and a document is rejected if
that takes too much of its text, or if it fails as a whole.

A line fails, by the first of these that holds:

- ``navigation``: a list of short items, that is at least three separators standing alone and one for every four words
  (separators counted), or a line that is nothing but a label such as "Read more";
- ``boilerplate``: at most ``SHORT`` words with a phrase of licences, notices or calls to subscribe; a longer line holds
  prose besides it;
- ``symbols``: over 10 % of its characters are of ``#*$%&|<>``;
- ``punctuation``: it doesn't end in a mark that closes a sentence (quotes and brackets may follow) and is no longer than
  ``SHORT`` words or has no such mark at the end of any word, or over half of its words end in an exclamation or question
  mark.

A document fails as a whole with fewer than ``LEAST_WORDS`` words, or where over ``MOST_REPEATED`` % of its words lie in
runs of eight words found twice or more in it. Otherwise it is kept unless its failing lines hold over ``MOST_LOST`` % of
the characters of its words.

Everything is one narrow pass of column expressions: no shuffle, each row by itself, so long, hot and repeated texts cost
what their length costs. Runs of words are compared by 64-bit hashes.

Nulls: a null or empty text has no words, all its counts are 0 and it isn't kept; its cleaned text is null or empty as it
was. Repeated rows and null keys are judged like any others. Blank lines stay. An empty table gives no rows. Input columns
are carried over; one that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import ascii_lower, words
from wayspan.llm.winnowing import _doubled

LEAST_WORDS, MOST_REPEATED, RUN = 20, 30, 8
MOST_LOST, SHORT, MOST_SYMBOLS = 50, 30, 10
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Separators between items, marks that close a sentence, what may follow them, labels and phrases.
SEPARATORS = ("|", "||", "»", "›", "·", "•", ">", ">>", "/", "::")
CLOSING = ".!?…:;。！？؟।"
AFTER = "\"'”’»)]}›"
LABELS = (
    "home", "menu", "search", "next", "previous", "back", "top", "back to top", "skip to content", "read more", "more", "log in", "login", "sign in", "sign up", "register", "subscribe", "share", "contact", "contact us", "about", "about us", "site map", "sitemap", "help", "faq",
    "startseite", "suche", "weiter", "weiterlesen", "anmelden", "kontakt", "impressum", "accueil", "suivant", "lire la suite", "connexion", "contactez-nous", "inicio", "buscar", "siguiente", "leer más", "iniciar sesión", "contacto",
)
PHRASES = (
    "all rights reserved", "cookie policy", "uses cookies", "use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions", "enable javascript", "javascript is disabled", "lorem ipsum", "licensed under", "released under the", "newsletter", "follow us on", "share this", "click here", "powered by", "copyright ©", "©",
    "alle rechte vorbehalten", "datenschutz", "tous droits réservés", "politique de confidentialité", "todos los derechos reservados", "política de privacidad",
)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _rule(line: Column, ws: Column) -> Column:
    """Name of the rule that a line with words breaks, else null."""
    n, plain = F.size(ws), ascii_lower(line)
    separators = F.size(F.filter(ws, lambda w: w.isin(*SEPARATORS)))
    shouted = F.size(F.filter(ws, lambda w: F.substring(w, -1, 1).isin("!", "?")))
    ended = F.substring(F.rtrim(line, F.lit(AFTER + BLANKS)), -1, 1).isin(*CLOSING)
    prose = (n > SHORT) & F.exists(ws, lambda w: F.substring(w, -1, 1).isin(*CLOSING))
    return (
        F.when((separators >= 3) & (4 * separators >= n) | F.trim(F.translate(plain, ".:>»…›|" + BLANKS[1:], "")).isin(*LABELS), "navigation")
        .when((n <= SHORT) & plain.rlike("|".join(PHRASES)), "boilerplate")
        .when(100 * _count(line, SYMBOLS) > MOST_SYMBOLS * F.length(F.translate(line, BLANKS, "")), "symbols")
        .when(~(ended | prose) | (2 * shouted > n), "punctuation")
    )


def _repeated(d: DataFrame, col: str, run: int) -> DataFrame:
    """Array ``col`` of words turned into the number of words in runs that occur twice or more."""
    others = [c for c in d.columns if c != col]
    d = d.select(*others, F.transform(col, lambda w: F.xxhash64(w)).alias(col))
    d = _doubled(d, col, run, lambda a, b, n: F.xxhash64(a, b))
    twice = F.size(F.array_distinct(col)) < F.size(col)
    # Few texts repeat anything, so only those are sorted: by hash, then the places whose neighbour has the same one.
    placed = F.when(twice, F.sort_array(F.transform(col, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select(*others, placed.alias("__s"))
    same = F.filter(F.transform("__s", lambda x, i: F.when((F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull())
    d = d.select(*others, F.sort_array(same).alias("__p"))
    covered = F.aggregate(F.transform("__p", lambda p, i: F.coalesce(F.least(F.get("__p", i + 1) - p, F.lit(run)), F.lit(run))), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*others, F.coalesce(covered, F.lit(0).cast("long")).alias(col))


def judge(df: DataFrame, text: str = "text", cleaned: str = "cleaned") -> DataFrame:
    """``df`` with the cleaned text, the whole document's counts, its lines by rule, and whether it is kept."""
    made = [cleaned, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "n_navigation", "n_boilerplate", "n_symbol_lines", "n_punctuation", "kept"]
    carried = [c for c in df.columns if c not in made or c == text]
    back = [c for c in carried if c not in made]
    d = df.select(*carried, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("ws"))).alias("__l"))
    d = d.select(*carried, F.transform("__l", lambda x: F.struct(x["line"], x["ws"], F.length(F.translate(x["line"], BLANKS, "")).cast("long").alias("chars"), F.when(F.size(x["ws"]) > 0, _rule(x["line"], x["ws"])).alias("rule"))).alias("__l"))
    full = F.filter("__l", lambda x: F.size(x["ws"]) > 0)["line"]
    total = lambda a: F.aggregate(a["chars"], F.lit(0).cast("long"), lambda s, x: s + x)
    of = lambda rule: F.size(F.filter("__l", lambda x: x["rule"] == rule)).cast("long")
    t = F.coalesce(F.col(text), F.lit(""))
    d = d.select(
        *carried,
        F.flatten(F.col("__l")["ws"]).alias("__w"),
        F.when(F.col(text).isNotNull(), F.array_join(F.filter("__l", lambda x: x["rule"].isNull())["line"], "\n")).alias("__cleaned"),
        total(F.col("__l")).alias("__chars"),
        _count(t, SYMBOLS).cast("long").alias("__marks"),
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("__dup"),
        total(F.filter("__l", lambda x: x["rule"].isNotNull())).alias("__lost"),
        *(of(r).alias(f"__{r}") for r in ("navigation", "boilerplate", "symbols", "punctuation")),
    )
    d = _repeated(d.withColumn("__n", F.size("__w").cast("long")), "__w", RUN)
    failed = (F.col("__n") < LEAST_WORDS) | (100 * F.col("__w") > MOST_REPEATED * F.col("__n"))
    return d.select(
        *back,
        F.col("__cleaned").alias(cleaned),
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__marks").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__w").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("__lost").alias("lost_chars"),
        *(F.col(f"__{r}").alias(c) for r, c in (("navigation", "n_navigation"), ("boilerplate", "n_boilerplate"), ("symbols", "n_symbol_lines"), ("punctuation", "n_punctuation"))),
        (~failed & (100 * F.col("__lost") <= MOST_LOST * F.col("__chars"))).alias("kept"),
    )
