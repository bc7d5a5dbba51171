"""Line-first cleaning: rules drop lines, then documents that lose too much text are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A document is kept if so large a share of its words' characters stays.
KEPT_SHARE = 0.5
#: A line's share of symbols beyond which it is no prose.
SYMBOL_SHARE = 0.1
#: Words by which short lines are taken for navigation, and phrases of boilerplate, in lower case: English, German, French, Spanish.
NAVIGATION = (
    r"^(home|menu|next|previous|back|login|log in|sign in|sign up|search|share|read more|skip to|contact us|about us|"
    r"startseite|menü|weiter|zurück|anmelden|registrieren|suche|teilen|mehr lesen|weiterlesen|zum inhalt|kontakt|über uns|"
    r"accueil|suivant|précédent|retour|connexion|se connecter|s'inscrire|rechercher|partager|lire la suite|aller au contenu|"
    r"contactez-nous|à propos|"
    r"inicio|menú|siguiente|anterior|volver|iniciar sesión|registrarse|buscar|compartir|leer más|ir al contenido|contacto|"
    r"sobre nosotros)([^a-zà-ÿ]|$)"
)
#: A phrase begins where a word does, which also spares a look at every letter.
BOILERPLATE = (
    r"(?:^|[^a-zà-ÿ])(?:all rights reserved|terms of (use|service)|privacy policy|use of cookies|cookie policy|enable javascript|"
    r"javascript is (disabled|required)|lorem ipsum|subscribe to our newsletter|click here|"
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|verwendet cookies|verwendung von cookies|javascript aktivieren|"
    r"newsletter abonnieren|klicken sie hier|"
    r"tous droits réservés|conditions d'utilisation|politique de confidentialité|utilise des cookies|utilisation de cookies|"
    r"activer javascript|abonnez-vous à notre|cliquez ici|"
    r"todos los derechos reservados|condiciones de uso|términos de uso|política de privacidad|utiliza cookies|uso de cookies|"
    r"activar javascript|suscríbete a nuestr|haga clic aquí)"
)
#: The end of a finished line, and two signs that part the items of a menu.
CLOSED = r"""[.!?:;,…。！？"'”’»)\]]\z"""
CRUMBS = r"[|»›>·][^|»›>·]+[|»›>·]"
SHORT_LINE = 5
#: A repeated run of so many words counts against a text.
RUN = 3
LEAST_WORDS = 50


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _parts_of(line: Column) -> Column:
    """What the rules look at, worked out once a line: the line itself, without white space at its ends, that in lower case, its words."""
    bare = F.btrim(line, F.lit(_SPACE_CHARS))
    return F.struct(line.alias("line"), bare.alias("bare"), F.lower(bare).alias("lower"), F.size(F.split(bare, SPACE)).alias("words"))


def line_fails(line: Column) -> Column:
    """Whether a line (as ``_parts_of`` gives it) breaks a rule: no closing punctuation on a short line, navigation, boilerplate, or symbols.

    White space at both ends doesn't count, so lines that end in a carriage return are judged like others.
    """
    bare, lower, words = line["bare"], line["lower"], line["words"]
    unfinished = (words < SHORT_LINE) & ~bare.rlike(CLOSED)
    navigation = (words < 2 * SHORT_LINE) & (lower.rlike(NAVIGATION) | bare.rlike(CRUMBS))
    symbols = F.char_length(bare) - F.char_length(_without(bare, SYMBOLS))
    return unfinished | navigation | (symbols > SYMBOL_SHARE * F.char_length(bare)) | lower.rlike(BOILERPLATE)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (as a struct ``doc``) with counts, the kept lines and how many word characters they hold.

    All of it is array work within the row, without a shuffle.  Repeated runs of words are found by sorting the
    hashes of a text's runs, so cost follows the text's length also where one run fills it.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("t"))
    rows = rows.select(
        "doc",
        "t",
        F.transform(F.array_remove(F.split("t", SPACE), ""), lambda w: F.xxhash64(w)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - RUN, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(RUN)]),
    )
    rows = rows.withColumn("runs", F.when(F.size("w") >= RUN, runs).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    ordered = F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(repeats, ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter(
        "sorted",
        lambda x, j: F.coalesce(F.get("sorted", j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("sorted", j + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(RUN)])))
    good = F.transform(F.filter(F.transform("lines", _parts_of), lambda x: ~line_fails(x)), lambda x: x["line"])
    rows = rows.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).withColumn("good", good)
    chars = lambda t: F.char_length(_without(t, _SPACE_CHARS)).cast("long")
    return rows.select(
        "doc",
        "n_words",
        chars(F.col("t")).alias("word_chars"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        chars(F.array_join("good", "\n")).alias("kept_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]


def line_first(docs: DataFrame, text_col: str = "text", kept_share: float = KEPT_SHARE) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``clean_text`` (the lines that pass all rules).

    ``base_failed``: under LEAST_WORDS words, or more than half of them in repeated runs.  ``kept``: not base_failed, and the
    passing lines hold at least ``kept_share`` of the word characters.  A null or empty text has zero counts and fails.
    Every row gives one row; input columns with the names of results are replaced.
    """
    rows = measured(docs, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~failed & (F.col("kept_chars") >= kept_share * F.col("word_chars")))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in _OUT], *_OUT)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RULES_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - {RUN} + 2)) AS i FROM parts WHERE len(w) >= {RUN}
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE n > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(translate(t, {_SQL_SPACES}, '')) AS word_chars,
    length(t) - length(translate(t, {_quoted(SYMBOLS)}, '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    list_sum(list_transform(list_filter(list_transform(lines, lambda y: trim(y, {_SQL_SPACES})), lambda x: NOT (
      (len(regexp_split_to_array(x, '{SPACE}')) < {SHORT_LINE} AND NOT regexp_matches(x, {_quoted(CLOSED)}))
      OR (len(regexp_split_to_array(x, '{SPACE}')) < {2 * SHORT_LINE}
          AND (regexp_matches(lower(x), {_quoted(NAVIGATION)}) OR regexp_matches(x, {_quoted(CRUMBS)})))
      OR regexp_matches(lower(x), {_quoted(BOILERPLATE)})
      OR length(x) - length(translate(x, {_quoted(SYMBOLS)}, '')) > {SYMBOL_SHARE}::DOUBLE * length(x)
    )), lambda x: length(translate(x, {_SQL_SPACES}, '')))) AS kept_chars
  FROM parts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(kept_chars, 0) >= {KEPT_SHARE}::DOUBLE * word_chars AS kept FROM judged
"""
