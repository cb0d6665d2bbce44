"""Text functions as Spark Column expressions (no UDF, whole-stage codegen).

Every function takes and returns ``pyspark.sql.Column`` so that it can be used
inside ``select``/``withColumn`` and in array lambdas.  The cleaning chain
(X1..X5) follows the reference's order exactly: transliterate, lower, strip,
quotes to space, newlines to space, whitespace split, short-word filter,
single-space join.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Characters Python's str.split()/str.strip() treat as
# whitespace on ASCII text (space, \t \n \v \f \r and the separators
# \x1c-\x1f).  Used as one regex character class in both Spark and DuckDB.
WS_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]"
WS_RUN = WS_CLASS + "+"
# a token of white-space split text, and a word that cleaning keeps: two or more characters, or one digit
# (character by character: Java looks such a class up in one table)
TOKEN_RE = "[^\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F ]+"
KEPT_WORD_RE = "[^\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \"']{2,}|[0-9]"

# Transliterations that are not a base letter plus accents.
FOLD_MULTI = [
    ("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
    ("þ", "th"), ("Þ", "Th"), ("ĳ", "ij"), ("Ĳ", "IJ"),
]
FOLD_SINGLE_EXTRA = [
    ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"),
    ("ð", "d"), ("Ð", "D"), ("ı", "i"), ("ħ", "h"), ("Ħ", "H"), ("ŧ", "t"), ("Ŧ", "T"),
]


def _build_fold_table() -> tuple[str, str]:
    """Single-character fold table built from a rule: every Latin-1 and
    Latin Extended-A/B letter whose compatibility decomposition is one ASCII
    letter plus combining marks maps to that letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    for s, d in FOLD_SINGLE_EXTRA:
        if s not in src:
            src.append(s)
            dst.append(d)
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _build_fold_table()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _folded(c: Column) -> Column:
    folded = c
    for s, d in FOLD_MULTI:
        folded = F.replace(folded, F.lit(s), F.lit(d))
    folded = F.translate(folded, FOLD_SRC, FOLD_DST)
    # pure ASCII (as many characters as bytes) needs no work
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(folded)


def fold_word(c) -> Column:
    """``fold_accents`` of a single word."""
    return _folded(_c(c))


def fold_accents(c) -> Column:
    """Transliterate Latin letters to ASCII (the subset of unidecode that
    concerns Latin script).  Of a text with other letters only the words that
    hold one are looked up, the rest is put back as it was."""
    c = _c(c)
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.array_join(F.transform(F.split(c, " "), _folded), " "))


# the same whitespace as a character set, for trim
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (a plain
    character-set trim, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def normalize(c) -> Column:
    """Transliterate, lower, strip, then ``"`` and ``'`` to space."""
    c = strip_ws(F.lower(fold_accents(c)))
    c = F.replace(c, F.lit('"'), F.lit(" "))
    return F.replace(c, F.lit("'"), F.lit(" "))


def merge_lines(c) -> Column:
    """Newline to space."""
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


def ws_split(c) -> Column:
    """Python ``str.split()`` without arguments (empty tokens removed)."""
    # a split by a regex compiles it anew for every row, this does not
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_RE), 0)


def filter_words(arr, threshold: int = 3, numbers: bool = True) -> Column:
    """Keep digit-only words (when ``numbers``) and words longer than
    ``threshold``."""
    if numbers:
        # length first: the digit test only runs on short words
        return F.filter(_c(arr), lambda w: (F.length(w) > threshold) | w.rlike("^[0-9]+$"))
    return F.filter(_c(arr), lambda w: F.length(w) > threshold)


def filter_text(c, threshold: int = 3, numbers: bool = True) -> Column:
    """Whitespace split, X3, single-space join."""
    return F.array_join(filter_words(ws_split(c), threshold, numbers), " ")


def clean(c) -> Column:
    """X5 without its number words: normalize -> merge lines -> filter words
    (threshold 1).  ``clean_full`` adds the number words (X6).

    Quotes and line breaks only separate words here, and a kept word is one of
    two or more characters or a digit, so one regex finds the kept words."""
    return F.array_join(F.regexp_extract_all(F.lower(fold_accents(c)), F.lit(KEPT_WORD_RE), 0), " ")


# ---------------------------------------------------------------------------
# Sentence splits
def split_sentences(c) -> Column:
    """Split on '.', drop empty parts (whitespace-only parts are kept)."""
    return F.filter(F.split(_c(c), "\\."), lambda s: s != "")


def rule_sentences(c) -> Column:
    """Drop commas, split on '.', re-add '.' to every part (so a text
    ending with '.' yields a final '.' sentence)."""
    parts = F.split(F.replace(_c(c), F.lit(","), F.lit("")), "\\.")
    return F.transform(parts, lambda s: F.concat(s, F.lit(".")))


def rule_sentence_bodies(c) -> Column:
    """X10 without the re-added '.', i.e. the strings durations and concepts
    are searched in."""
    return F.split(F.replace(_c(c), F.lit(","), F.lit("")), "\\.")


def lstrip_ws(c) -> Column:
    return F.ltrim(_c(c), F.lit(WS_CHARS))


def annotation_split(c) -> Column:
    """X11: title = first line; newlines to space; split on '.'; title removed
    from the first part; every part but the last gets '.' back and is
    stripped; whitespace-only parts are dropped (empty ones are kept).
    Returns ``struct(title, parts)``."""
    c = _c(c)
    title = F.split(c, "\n").getItem(0)
    parts = F.split(F.replace(c, F.lit("\n"), F.lit(" ")), "\\.")
    n = F.size(parts)
    parts = F.concat(F.array(F.replace(parts.getItem(0), title, F.lit(""))), F.slice(parts, F.lit(2), n))
    body = F.transform(F.slice(parts, F.lit(1), n - 1), lambda s: F.concat(lstrip_ws(s), F.lit(".")))
    out = F.concat(body, F.array(F.element_at(parts, -1)))
    out = F.filter(out, lambda s: (s == "") | (strip_ws(s) != ""))
    return F.struct(title.alias("title"), out.alias("parts"))


# ---------------------------------------------------------------------------
# Values, units, durations
VALUE_UNIT_RE = "([0-9]+)" + WS_RUN + "([\\p{L}\\p{N}_]+)"

# Duration vocabularies (accent-folded) and their day factor.
DAY_TERMS = ["jour", "day", "journee"]
MONTH_TERMS = ["mois", "month"]
YEAR_TERMS = ["an", "annee", "year"]
UNIT_FACTORS = [(DAY_TERMS, 1), (MONTH_TERMS, 30), (YEAR_TERMS, 365)]


def value_units(c) -> Column:
    """Every ``<digits><whitespace><word>`` as ``array<struct<value,unit>>``."""
    # one pass over the text finds the pairs, each is then cut by itself
    return F.transform(
        F.regexp_extract_all(_c(c), F.lit(VALUE_UNIT_RE), 0),
        lambda m: F.struct(F.regexp_extract(m, VALUE_UNIT_RE, 1).try_cast("bigint").alias("value"), F.regexp_extract(m, VALUE_UNIT_RE, 2).alias("unit")))


def _factor_map() -> Column:
    return F.create_map(*[x for terms, f in UNIT_FACTORS for t in terms for x in (F.lit(t), F.lit(f))])


def durations_days(c) -> Column:
    """Durations in days found in a text, in order of appearance.  The
    unit is folded once per match, then looked up (as is, or without a
    final 's') in the unit table."""
    folded = F.transform(value_units(c), lambda vu: F.struct(
        vu["value"].alias("v"), fold_word(vu["unit"]).alias("u")))
    factors = _factor_map()
    days = F.transform(folded, lambda x: x["v"] * F.coalesce(
        F.try_element_at(factors, x["u"]),
        F.when(x["u"].endswith("s"), F.try_element_at(factors, F.substring(x["u"], F.lit(1), F.length(x["u"]) - 1)))))
    return F.filter(days, lambda d: d.isNotNull())


# ---------------------------------------------------------------------------
# Tokens and n-grams
def pack_words(c, nb_pack: int = 0) -> Column:
    """Single-space split, empty tokens kept (``str.split(' ')``).  With
    ``nb_pack > 0`` the words form ``nb_pack`` packs of ``floor(n / nb_pack)``
    consecutive words (at least one), the remainder going to the last pack;
    each pack is returned as its words joined by one space."""
    words = F.split(_c(c), " ")
    if nb_pack <= 0:
        return words
    n = F.size(words)
    per = F.greatest(F.floor(n / F.lit(nb_pack)), F.lit(1)).cast("int")
    packs = F.least(F.lit(nb_pack), n)
    starts = F.sequence(F.lit(0), packs - 1)
    return F.transform(starts, lambda k: F.array_join(F.slice(
        words, k * per + 1, F.when(k == packs - 1, n - k * per).otherwise(per)), " "))


def _gram_re(n: int) -> str:
    """A regex for the n-grams that begin at each place of a text whose words
    have a space of their own at both sides: no gram holds two spaces in a row.
    A low surrogate is no place: a find without width stops there as well."""
    grams = {1: "[^ ]| (?=[^ ])|(?<=[^ ]) ", 2: "(?!  ).."}
    return "(?s)(?![\\x{DC00}-\\x{DFFF}])(?=(" + grams.get(n, f".[^ ]{{{n - 2}}}.") + "))"


def char_wb_grams(c, min_n: int = 4, max_n: int = 5) -> Column:
    """Character n-grams inside word boundaries (lowercased), the
    analyzer ``char_wb`` of the reference's count vectorizer, by n.  A padded
    word not longer than ``n`` is emitted once and longer n are then skipped."""
    # a regex for each n finds its grams in one pass over the text; a lambda
    # would be interpreted for every gram
    padded = F.concat(F.lit(" "), F.array_join(ws_split(F.lower(_c(c))), "  "), F.lit(" "))
    parts = [F.regexp_extract_all(padded, F.lit(_gram_re(n)), 1) for n in range(min_n, max_n + 1)]
    if min_n > 3:
        # words that are shorter than the shortest gram, with their padding
        parts.insert(0, F.regexp_extract_all(padded, F.lit(f" [^ ]{{1,{min_n - 3}}} "), 0))
    return F.concat(*parts)


def word_tokens(c) -> Column:
    """Tokens of two or more word characters (``(?u)\\b\\w\\w+\\b``) on
    lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit("[\\p{L}\\p{N}_]{2,}"), 0)


def strip_cell(c) -> Column:
    """Cell strip."""
    return strip_ws(c)


def title_commas(c) -> Column:
    """Commas in a title become spaces."""
    return F.replace(_c(c), F.lit(","), F.lit(" "))


# ---------------------------------------------------------------------------
# Number words to digits (cardinals 0 - 999 999 in French, English, Spanish)
# Number words and their values, on accent-folded lower case.
FR_NUMBER_WORDS = [
    ("zero", 0), ("une", 1), ("un", 1), ("deux", 2), ("trois", 3), ("quatre", 4), ("cinq", 5), ("six", 6),
    ("sept", 7), ("huit", 8), ("neuf", 9), ("dix", 10), ("onze", 11), ("douze", 12), ("treize", 13),
    ("quatorze", 14), ("quinze", 15), ("seize", 16), ("vingts", 20), ("vingt", 20), ("trente", 30),
    ("quarante", 40), ("cinquante", 50), ("soixante", 60), ("septante", 70), ("huitante", 80),
    ("octante", 80), ("nonante", 90), ("cents", 100), ("cent", 100), ("mille", 1000),
]
EN_NUMBER_WORDS = [
    ("zero", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8),
    ("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12), ("thirteen", 13), ("fourteen", 14), ("fifteen", 15),
    ("sixteen", 16), ("seventeen", 17), ("eighteen", 18), ("nineteen", 19), ("twenty", 20), ("thirty", 30), ("forty", 40),
    ("fifty", 50), ("sixty", 60), ("seventy", 70), ("eighty", 80), ("ninety", 90), ("hundred", 100), ("thousand", 1000),
]
ES_NUMBER_WORDS = [
    ("cero", 0), ("uno", 1), ("una", 1), ("un", 1), ("dos", 2), ("tres", 3), ("cuatro", 4), ("cinco", 5), ("seis", 6), ("siete", 7),
    ("ocho", 8), ("nueve", 9), ("diez", 10), ("once", 11), ("doce", 12), ("trece", 13), ("catorce", 14), ("quince", 15),
    ("dieciseis", 16), ("diecisiete", 17), ("dieciocho", 18), ("diecinueve", 19), ("veinte", 20), ("veintiuno", 21),
    ("veintiuna", 21), ("veintiun", 21), ("veintidos", 22), ("veintitres", 23), ("veinticuatro", 24), ("veinticinco", 25),
    ("veintiseis", 26), ("veintisiete", 27), ("veintiocho", 28), ("veintinueve", 29), ("treinta", 30), ("cuarenta", 40),
    ("cincuenta", 50), ("sesenta", 60), ("setenta", 70), ("ochenta", 80), ("noventa", 90), ("cien", 100), ("ciento", 100),
    ("doscientos", 200), ("doscientas", 200), ("trescientos", 300), ("trescientas", 300), ("cuatrocientos", 400),
    ("cuatrocientas", 400), ("quinientos", 500), ("quinientas", 500), ("seiscientos", 600), ("seiscientas", 600),
    ("setecientos", 700), ("setecientas", 700), ("ochocientos", 800), ("ochocientas", 800), ("novecientos", 900),
    ("novecientas", 900), ("mil", 1000),
]


def _one_of(words: list[str]) -> str:
    """A regex for one of the words, by common beginnings: a text's word is
    given up at its first letter that no word of the list has there."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    # the end of a word comes last, so that none hides behind its beginning
    parts = [h + (_one_of(rest) if rest != [""] else "") for h, rest in heads.items() if h]
    return "(?:" + "|".join([*parts, *([""] if "" in heads else [])]) + ")"


class NumberWords:
    """A language's number words and how they combine.

    ``articles`` are words that are no number when alone; ``link`` may stand
    between two words.  A run is folded with g, the value below a thousand, and
    t, the thousands so far: ``goes_on(g, t, v, word)`` tells whether the word
    of value v continues the number, ``link_ok(g, t)`` whether the link may
    follow, ``after_link(v, word)`` what may follow the link, and ``add(g, v,
    word)`` gives the new g for v below 1000.
    """

    def __init__(self, words, articles, link, goes_on, link_ok, after_link, add):
        self.words, self.articles, self.link = words, articles, link
        self.goes_on, self.link_ok, self.after_link, self.add = goes_on, link_ok, after_link, add
        alt = _one_of([w for w, _ in words])
        # a run of whole tokens made of number words, joined by spaces or
        # hyphens, with an optional link between two of them, and the space
        # before it: a regex that begins with a fixed character is found fast.
        # A word ends where its piece ends and a run goes on from token to
        # token, so nothing is ever given back and the loops are possessive:
        # others take stack for each word, and a long run has thousands
        word = f"{alt}(?![^ -])"
        token = f"{word}(?:-(?:{link}[ -])?{word})*+(?![^ ])"
        self.run = f" ({token}(?: (?:{link}[ -])?{token})*+)"
        # a text can only change if it holds a number word that is no article
        # (read with a space before the text)
        plain = _one_of([w for w, _ in words if w not in articles])
        self.hint = f"[ -]{plain}(?:[ -]|\\z)"


def _fr_twenty(g, w):
    return w.startswith("vingt") & (g % 100 == 4)


NUMBER_WORDS = {
    "fr": NumberWords(
        FR_NUMBER_WORDS, ["un", "une"], "et",
        lambda g, t, v, w: (
            F.when(v == 0, False)
            .when(v < 10, (g % 10 == 0) & ((g % 100 != 10) | (v >= 7)))
            .when(v < 20, (g % 100 == 0) | (g % 100 == 60) | (g % 100 == 80))
            .when(v < 100, _fr_twenty(g, w) | (g % 100 == 0))
            .when(v == 100, g < 10)
            .otherwise((t == 0) & (g > 0))),
        lambda g, t: (g % 10 == 0) & (g % 100 >= 20) & (g % 100 <= 60),
        lambda v, w: w.isin("un", "une", "onze"),
        lambda g, v, w: F.when(_fr_twenty(g, w), g - 4 + 80).when(v == 100, F.greatest(g, F.lit(1)) * 100).otherwise(g + v)),
    "en": NumberWords(
        EN_NUMBER_WORDS, [], "and",
        lambda g, t, v, w: (
            F.when(v == 0, False)
            .when(v < 10, (g % 10 == 0) & ((g % 100 == 0) | (g % 100 >= 20)))
            .when(v < 100, g % 100 == 0)
            .when(v == 100, (g > 0) & (g < 10))
            .otherwise((t == 0) & (g > 0))),
        lambda g, t: (g % 100 == 0) & ((g > 0) | (t > 0)),
        lambda v, w: (v > 0) & (v < 100),
        lambda g, v, w: F.when(v == 100, F.greatest(g, F.lit(1)) * 100).otherwise(g + v)),
    # the link "y" is one letter: cleaning drops it, so tens and units may meet
    "es": NumberWords(
        ES_NUMBER_WORDS, ["un", "una", "uno"], "y",
        lambda g, t, v, w: (
            F.when(v == 0, False)
            .when(v < 10, (g % 10 == 0) & ((g % 100 == 0) | (g % 100 >= 30)))
            .when(v < 100, g % 100 == 0)
            .when(v < 1000, (g == 0) & (t > 0))
            .otherwise((t == 0) & (g > 0))),
        lambda g, t: (g % 10 == 0) & (g % 100 >= 30),
        lambda v, w: (v > 0) & (v < 10),
        lambda g, v, w: g + v),
}
FR_ARTICLES = NUMBER_WORDS["fr"].articles
NUMBER_RUN_RE, NUMBER_HINT_RE = NUMBER_WORDS["fr"].run, NUMBER_WORDS["fr"].hint


def _number_fold(words: Column, lang: NumberWords) -> Column:
    """Fold one run of number words into digit strings (a run that is not
    one number, e.g. ``deux trois``, gives several)."""
    vals = F.create_map(*[x for w, v in lang.words for x in (F.lit(w), F.lit(v).cast("long"))])
    # the fold reads a value many times, so it is looked up before
    valued = F.transform(words, lambda w: F.struct(w.alias("w"), F.try_element_at(vals, w).alias("v")))
    none = F.array().cast("array<string>")

    def state(out, g, t, on, ws, link):
        return F.struct(out.alias("out"), g.cast("long").alias("g"), t.cast("long").alias("t"), on.alias("on"), ws.alias("ws"), link.alias("link"))

    init = state(none, F.lit(0), F.lit(0), F.lit(False), none, F.lit(False))

    def flushed(acc):
        art = (F.size(acc["ws"]) == 1) & acc["ws"].getItem(0).isin(lang.articles) if lang.articles else F.lit(False)
        num = F.when(art, acc["ws"].getItem(0)).otherwise((acc["t"] + acc["g"]).cast("string"))
        out = F.when(acc["on"], F.concat(acc["out"], F.array(num))).otherwise(acc["out"])
        return F.when(acc["link"], F.concat(out, F.array(F.lit(lang.link)))).otherwise(out)

    def step(acc, x):
        g, t, w, v = acc["g"], acc["t"], x["w"], x["v"]
        goes_on = acc["on"] & lang.goes_on(g, t, v, w) & (~acc["link"] | lang.after_link(v, w))
        on_link = F.when(acc["on"] & ~acc["link"] & lang.link_ok(g, t), state(acc["out"], g, t, F.lit(True), acc["ws"], F.lit(True))).otherwise(
            state(F.concat(flushed(acc), F.array(F.lit(lang.link))), F.lit(0), F.lit(0), F.lit(False), none, F.lit(False)))
        thousand = v == 1000
        on_cont = state(
            acc["out"], F.when(thousand, F.lit(0)).otherwise(lang.add(g, v, w)), F.when(thousand, F.greatest(g, F.lit(1)) * 1000).otherwise(t),
            F.lit(True), F.concat(acc["ws"], F.array(w)), F.lit(False))
        on_new = state(
            flushed(acc), F.when(thousand, F.lit(0)).otherwise(v), F.when(thousand, F.lit(1000)).otherwise(F.lit(0)),
            F.lit(True), F.array(w), F.lit(False))
        return F.when(w == lang.link, on_link).when(goes_on, on_cont).otherwise(on_new)

    return F.aggregate(valued, init, step, lambda acc: F.array_join(flushed(acc), " "))


def _number_run(r: Column, lang: NumberWords) -> Column:
    """A run of one word is its value or an article; longer ones are folded."""
    alone = F.create_map(*[x for w, v in lang.words for x in (F.lit(w), F.lit(w if w in lang.articles else str(v)))])
    return F.when(~r.contains(" ") & ~r.contains("-"), F.try_element_at(alone, r)).otherwise(_number_fold(F.split(F.replace(r, F.lit("-"), F.lit(" ")), " "), lang))


def _number_words(c: Column, lang: NumberWords) -> Column:
    """X6 on cleaned (lower-case, single-spaced) text: every run of number
    words becomes digits; a lone article stays a word.  Runs are found by one
    regex, folded one by one (each run is a few words), and put back between
    the untouched segments."""
    padded = F.concat(F.lit(" "), c)
    runs = F.regexp_extract_all(padded, F.lit(lang.run), 1)
    # split by a single character: a regex would be compiled for every text.
    # Cleaned text has no line breaks, so they can mark the runs
    segs = F.when(c.contains("\n"), F.split(padded, lang.run)).otherwise(F.split(F.regexp_replace(padded, lang.run, "\n"), "\n"))
    conv = F.transform(runs, lambda r: _number_run(r, lang))
    parts = F.transform(F.arrays_zip(F.slice(segs, 1, F.size(runs)).alias("s"), conv.alias("n")),
                        lambda z: F.concat(z["s"], F.lit(" "), z["n"]))
    return F.substr(F.concat(F.array_join(parts, ""), F.element_at(segs, -1)), F.lit(2))


def number_words(c, lang: str = "fr") -> Column:
    """X6 in French, English (``en``) or Spanish (``es``); texts whose only
    number words are lone articles pay one regex test only."""
    c, words = _c(c), NUMBER_WORDS[lang]
    return F.when(F.concat(F.lit(" "), c).rlike(words.hint), _number_words(c, words)).otherwise(c)


def clean_full(c, lang: str = "fr") -> Column:
    """X5 with the number-word step (X6).  ``number_words`` reads its input
    several times: on a DataFrame prefer ``with_clean_full``, which projects
    the cleaned text first."""
    return number_words(clean(c), lang)


def with_clean_full(df, src: str, dst: str, lang: str = "fr"):
    """Add ``dst`` = X5 + X6 of ``src`` in two projections (cleaned text is
    computed once, then read by the number-word step)."""
    tmp = f"__clean_{dst}"
    return df.withColumn(tmp, clean(F.col(src))).withColumn(dst, number_words(F.col(tmp), lang)).drop(tmp)
