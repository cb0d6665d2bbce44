"""DuckDB SQL fragments mirroring the Column builders in
``clausefold.functions``.  Used only to write the oracle SQL that checks the
Spark queries; the engine itself never runs this SQL.  Patterns, folds, units,
vocabularies and rules are stated here once more, so a wrong one in the engine
shows."""

from __future__ import annotations

# White space, a value with its unit, and duration units
WS_RUN = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]+"
VALUE_UNIT_RE = "([0-9]+)" + WS_RUN + "([\\p{L}\\p{N}_]+)"
DAY_TERMS, MONTH_TERMS, YEAR_TERMS = ["day", "jour", "journee"], ["month", "mois"], ["year", "an", "annee"]
# Letters that fold to more than one
LIGATURES = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")]

# Types and concepts with their terms, types last
TYPE_TERMS = [
    ("indemnisation", ["indemnite", "indemnisation"]), ("non_concurrence", ["concurrence"]),
    ("non_sollicitation", ["debauchage", "sollicitation"]),
    ("paiement", ["prix", "paiement", "finance", "financier", "financieres", "remuneration", "facturation"]),
    ("resiliation", ["resiliation"]),
]
CONCEPT_TERMS = [
    ("cheque", ["cheque"]), ("client", ["client"]), ("convenance", ["convenance"]), ("fournisseur", ["prestataire", "fournisseur"]),
    ("partenaire", ["associe", "partenaire", "intermediaire"]), ("preavis", ["delai", "preavis"]),
    ("remuneration", ["indemnite", "remuneration"]), ("virement", ["transfert", "virement"]), *TYPE_TERMS,
]

# The policy rules as SQL rows (place, policy, type, concepts a
# clause needs, concepts it must not have, concepts of the sentence, duration
# test, days, scope)
RULE_ROWS = """
(0, 'R2', 'non_sollicitation', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '<', 365, 'sentence'),
(1, 'R3', 'non_sollicitation', ['partenaire'], ['client'], []::VARCHAR[], NULL, NULL, 'clause'),
(2, 'R4', 'non_sollicitation', []::VARCHAR[], []::VARCHAR[], ['remuneration'], '<', 360, 'sentence'),
(3, 'R4', 'non_sollicitation', []::VARCHAR[], ['remuneration'], []::VARCHAR[], NULL, NULL, 'clause'),
(4, 'R5', 'non_sollicitation', ['fournisseur'], ['client'], []::VARCHAR[], NULL, NULL, 'clause'),
(5, 'R7', 'resiliation', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '>', 60, 'sentence'),
(6, 'R7', 'resiliation', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '<', 30, 'sentence'),
(7, 'R8', 'resiliation', ['fournisseur'], ['client'], []::VARCHAR[], NULL, NULL, 'clause'),
(8, 'R9', 'resiliation', []::VARCHAR[], ['preavis'], []::VARCHAR[], NULL, NULL, 'clause'),
(9, 'R10', 'resiliation', ['preavis', 'fournisseur'], ['client'], []::VARCHAR[], NULL, NULL, 'clause'),
(10, 'R11', 'paiement', []::VARCHAR[], []::VARCHAR[], ['cheque'], NULL, NULL, 'sentence'),
(11, 'R11', 'paiement', []::VARCHAR[], ['virement'], []::VARCHAR[], NULL, NULL, 'clause'),
(12, 'R12', 'paiement', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '>', 45, 'sentence'),
(13, 'R13', 'indemnisation', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], NULL, NULL, 'clause'),
(14, 'R15', 'non_concurrence', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], '>', 365, 'sentence')"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def zfill(x: str, w: int) -> str:
    return f"(CASE WHEN length(CAST({x} AS VARCHAR)) >= {w} THEN CAST({x} AS VARCHAR) ELSE lpad(CAST({x} AS VARCHAR), {w}, '0') END)"


def fold(x: str) -> str:
    for s, d in LIGATURES:
        x = f"replace({x}, {q(s)}, {q(d)})"
    return f"strip_accents({x})"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def normalize(x: str) -> str:
    y = strip_ws(f"lower({fold(x)})")
    return f"replace(replace({y}, '\"', ' '), '''', ' ')"


def merge_lines(x: str) -> str:
    return f"replace({x}, chr(10), ' ')"


def ws_split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS_RUN)}), lambda w: w <> '')"


def filter_words(arr: str, threshold: int = 3, numbers: bool = True) -> str:
    if numbers:
        return f"list_filter({arr}, lambda w: regexp_full_match(w, '[0-9]+') OR length(w) > {threshold})"
    return f"list_filter({arr}, lambda w: length(w) > {threshold})"


def filter_text(x: str, threshold: int = 3, numbers: bool = True) -> str:
    return f"array_to_string({filter_words(ws_split(x), threshold, numbers)}, ' ')"


def clean(x: str) -> str:
    return filter_text(merge_lines(normalize(x)), 1, True)


def split_sentences(x: str) -> str:
    return f"list_filter(string_split({x}, '.'), lambda s: s <> '')"


def rule_sentence_bodies(x: str) -> str:
    return f"string_split(replace({x}, ',', ''), '.')"


def value_units(x: str) -> str:
    """list of struct(value, unit)."""
    pat = q(VALUE_UNIT_RE)
    return (f"list_transform(list_zip(regexp_extract_all({x}, {pat}, 1), regexp_extract_all({x}, {pat}, 2)), "
            f"lambda z: {{'value': TRY_CAST(z[1] AS BIGINT), 'unit': z[2]}})")


def _unit_factor(u: str) -> str:
    fu = fold(u)
    parts = []
    for terms, factor in ((DAY_TERMS, 1), (MONTH_TERMS, 30), (YEAR_TERMS, 365)):
        lst = ", ".join(q(t) for t in terms)
        parts.append(f"WHEN {fu} IN ({lst}) OR (suffix({fu}, 's') AND regexp_replace({fu}, 's$', '') IN ({lst})) THEN {factor}")
    return "(CASE " + " ".join(parts) + " END)"


def durations_days(x: str) -> str:
    return (f"list_filter(list_transform({value_units(x)}, lambda vu: vu.value * {_unit_factor('vu.unit')}), "
            f"lambda d: d IS NOT NULL)")


def char_wb_grams(x: str, min_n: int = 4, max_n: int = 5) -> str:
    """list of grams (see the Column version)."""
    words = ws_split(f"lower({x})")
    pad = "(' ' || w || ' ')"
    sized = []
    for n in range(min_n, max_n + 1):
        g = f"list_transform(range(0, length({pad}) - {n} + 1), lambda i: substring({pad}, i + 1, {n}))"
        sized.append(g if n == min_n else f"(CASE WHEN length({pad}) >= {n} THEN {g} ELSE []::VARCHAR[] END)")
    body = sized[0] if len(sized) == 1 else "list_concat(" + ", ".join(sized) + ")"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN length({pad}) <= {min_n} THEN [{pad}] ELSE {body} END))"
