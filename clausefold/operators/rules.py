"""Vocabularies, concepts and policy rules (J5-J8, A13, A14, C13, §2.12).

The vocabularies and rule sets are small fixed tables (13 concepts, 15 policy
rules).  They are applied as array literals inside one projection, so each
clause is evaluated where it lies: no join, no shuffle and no pairing of
clauses with concepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.functions import text as X

# ---------------------------------------------------------------------------
# Concept and clause-type vocabularies (name, terms).
CONCEPTS = [
    ("cheque", ["cheque"]),
    ("client", ["client"]),
    ("convenance", ["convenance"]),
    ("fournisseur", ["fournisseur", "prestataire"]),
    ("partenaire", ["partenaire", "associe", "intermediaire"]),
    ("preavis", ["preavis", "delai"]),
    ("remuneration", ["remuneration", "indemnite"]),
    ("virement", ["virement", "transfert"]),
]
TYPES = [
    ("indemnisation", ["indemnisation", "indemnite"]),
    ("non_concurrence", ["concurrence"]),
    ("non_sollicitation", ["sollicitation", "debauchage"]),
    ("paiement", ["paiement", "finance", "financier", "remuneration", "financieres", "prix", "facturation"]),
    ("resiliation", ["resiliation"]),
]
# Label classes per column, in file order.
INVALIDITY_CLASSES = ["None", "False", "Missing", "Imprecise"]
POLICY_CLASSES = ["None"] + [f"R{i}" for i in range(1, 21)]
TYPE_CLASSES = ["objet", "general", "duree", "lieu", "obligations", "paiement", "resiliation",
                "non_sollicitation", "non_concurrence", "confidentialite", "responsabilites",
                "indemnisation", "prop_intel", "legal", "autres"]

# Policy rules checked on clauses (§2.12).  scope 'sentence'
# means "some sentence meets the duration test and holds sent_need"; the
# clause needs clause_need and none of clause_forbid.
POLICY_RULES = [
    # policy, rule_no, type, clause_need, clause_forbid, sent_need, dur_op, dur_days, scope
    ("R2", 1, "non_sollicitation", [], [], [], "<", 365, "sentence"),
    ("R3", 1, "non_sollicitation", ["partenaire"], ["client"], [], None, None, "clause"),
    ("R4", 1, "non_sollicitation", [], [], ["remuneration"], "<", 360, "sentence"),
    ("R4", 2, "non_sollicitation", [], ["remuneration"], [], None, None, "clause"),
    ("R5", 1, "non_sollicitation", ["fournisseur"], ["client"], [], None, None, "clause"),
    ("R7", 1, "resiliation", [], [], [], ">", 60, "sentence"),
    ("R7", 2, "resiliation", [], [], [], "<", 30, "sentence"),
    ("R8", 1, "resiliation", ["fournisseur"], ["client"], [], None, None, "clause"),
    ("R9", 1, "resiliation", [], ["preavis"], [], None, None, "clause"),
    ("R10", 1, "resiliation", ["preavis", "fournisseur"], ["client"], [], None, None, "clause"),
    ("R11", 1, "paiement", [], [], ["cheque"], None, None, "sentence"),
    ("R11", 2, "paiement", [], ["virement"], [], None, None, "clause"),
    ("R12", 1, "paiement", [], [], [], ">", 45, "sentence"),
    ("R13", 1, "indemnisation", [], [], [], None, None, "clause"),
    ("R15", 1, "non_concurrence", [], [], [], ">", 365, "sentence"),
]
POLICIES = list(dict.fromkeys(r[0] for r in POLICY_RULES))

# Rule predicates usable on one sentence, and those that need
# the whole clause.
SENTENCE_COMPATIBLE = ["greaterThan", "lessThan", "contains"]
SENTENCE_INCOMPATIBLE = ["notContains", "hasSubject"]


def _str_array(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def vocab_literal(vocab) -> Column:
    """``array<struct<name string, terms array<string>>>`` literal."""
    return F.array(*[F.struct(F.lit(n).alias("name"), _str_array(t).alias("terms")) for n, t in vocab])


ALL_CONCEPTS = CONCEPTS + TYPES  # types are concepts too


# ---------------------------------------------------------------------------
# J5 / U4
# Lambdas below never reference a column of the row: a column captured by a
# lambda is re-evaluated at every call once Catalyst inlines it, so the
# per-row work is spelled out term by term instead.
def _names_where(hits: list[tuple[str, Column]]) -> Column:
    arr = F.array(*[F.when(c, F.lit(n)) for n, c in hits])
    return F.filter(arr, lambda x: x.isNotNull())


def _any_contains(s: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(s, F.lit(t))
    return out


def concepts_in(text, vocab=ALL_CONCEPTS, lowered: bool = False) -> Column:
    """Names of concepts with a term contained in lower(text), in
    vocabulary order.  Pass a column (not a costly expression): it is read
    once per term."""
    low = X._c(text) if lowered else F.lower(X._c(text))
    return _names_where([(n, _any_contains(low, terms)) for n, terms in vocab])


def concepts_not_in(text, vocab=ALL_CONCEPTS, lowered: bool = False) -> Column:
    """U4: the complement of ``concepts_in``."""
    return F.array_except(_str_array([n for n, _ in vocab]), concepts_in(text, vocab, lowered))


# ---------------------------------------------------------------------------
# J6 / J7 / W7
def title_type_token(title, mapping: list[str] = TYPE_CLASSES, vocab=TYPES) -> Column:
    """First type, in mapping order, with a vocabulary term equal to a
    whitespace token of the (uncleaned) title; its code = mapping position.
    Returns ``struct(type, code)`` (nulls when nothing matches)."""
    terms = dict(vocab)
    tokens = X.ws_split(X._c(title))
    name, code = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(mapping))):
        if not terms.get(n):
            continue
        hit = F.arrays_overlap(tokens, _str_array(terms[n]))
        name = F.when(hit, F.lit(n)).otherwise(name)
        code = F.when(hit, F.lit(i)).otherwise(code)
    return F.struct(name.alias("type"), code.alias("code"))


def title_type_candidates(title, vocab=TYPES) -> Column:
    """Every type with a term contained in the title."""
    t = X._c(title)
    return _names_where([(n, _any_contains(t, terms)) for n, terms in vocab])


# ---------------------------------------------------------------------------
# Rule-based clause analysis
#: Rules that one mask of bits holds.
MASK = 62


def _mask(tests: list[Column]) -> Column:
    """A number with a bit for each test that holds."""
    out = F.lit(0).cast("bigint")
    for i, t in enumerate(tests):
        out = out + F.when(t, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return out


def _masks(tests: list[Column]) -> list[Column]:
    return [_mask(tests[i:i + MASK]) for i in range(0, len(tests), MASK)]


def _bit(masks: list[Column], i: int) -> Column:
    return masks[i // MASK].bitwiseAND(F.lit(1 << i % MASK).cast("bigint")) != 0


def _sent_hit(s: Column, rule) -> Column:
    """The test of a sentence, ``struct(text, durs, has_<concept>...)``."""
    _, _, _, _, _, sent_need, op, days, _ = rule
    ok = F.lit(True)
    # some duration is below or above the bound; null without a duration
    if op == "<":
        ok = F.array_min(s["durs"]) < F.lit(days)
    elif op == ">":
        ok = F.array_max(s["durs"]) > F.lit(days)
    for c in sent_need:
        ok = ok & s[f"has_{c}"]
    return ok


def _clause_ok(rule) -> Column:
    _, _, ty, need, forbid, _, _, _, _ = rule
    ok = F.array_contains(F.col("type_candidates"), F.lit(ty))
    for c in need:
        ok = ok & F.col(f"__has_{c}")
    for c in forbid:
        ok = ok & ~F.col(f"__has_{c}")
    return ok


def analyze_clauses(clauses: DataFrame, id_col: str, title_col: str, text_col: str,
                    rules=POLICY_RULES, given_type_col: str | None = None,
                    keep_cols: list[str] | None = None, clean_col: str | None = None) -> DataFrame:
    """``(id, type, type_candidates, valid, policies, notable)``.

    Title and text are cleaned (X5 with number words, X6); the type candidates are the types whose term
    the title contains (the reported type is the first by name); commas are
    removed from the body; clause concepts are searched in the body,
    sentences are the body split on '.', each with its durations (days) and
    concepts.  A rule fires when the clause has its type and clause
    concepts and, for sentence rules, some sentence meets the duration test
    and holds the sentence concepts; such sentences (with '.' re-added) are
    notable.  Valid = no violated policy.  Rules are unrolled into one
    projection (15 fixed rules), so every clause is checked in place.  A text
    that the caller has cleaned (X5 and X6) is named by ``clean_col``.
    """
    # cleaned title and body first, in their own projections: both are read
    # by many terms below (cleaned text is already lower case)
    keep = list(keep_cols or [])
    given = [F.col(given_type_col).alias("__given")] if given_type_col else []
    titled = clauses.select(
        F.col(id_col).alias(id_col), *keep, *given,
        X.clean(F.col(title_col)).alias("__t0"), F.col(clean_col or text_col).alias("__text"))
    titled = titled.select(id_col, *keep, *(["__given"] if given_type_col else []), X.number_words(F.col("__t0")).alias("__title"), "__text")
    found = title_type_candidates(F.col("__title"))
    if given_type_col:
        # a request that names its type is checked against that type only
        cands = F.when(F.coalesce(F.col("__given"), F.lit("")) != "", F.array(F.col("__given"))).otherwise(found)
        extra, extra_names = [F.array_min(found).alias("type_found")], ["type_found"]
    else:
        cands, extra, extra_names = found, [], []
    typed = titled.select(id_col, *keep, *extra, cands.alias("type_candidates"), "__text")
    # a body is read if a rule of the clause's types asks for it; no rule
    # looks at any other body
    reading = sorted({r[2] for r in rules if r[8] == "sentence" or r[3] or r[4]})
    read = F.arrays_overlap("type_candidates", _str_array(reading))
    text = F.col("__text") if clean_col else X.clean(F.col("__text"))
    pre = typed.select(id_col, *keep, *extra_names, "type_candidates",
                       F.when(read, text).when(F.col("__text").isNotNull(), F.lit("")).alias("__b0"))
    body = F.col("__b0") if clean_col else X.number_words(F.col("__b0"))
    cleaned = pre.select(id_col, *keep, *extra_names, "type_candidates", F.replace(body, F.lit(","), F.lit("")).alias("__body"))
    # only what the rules ask for is searched
    terms = dict(ALL_CONCEPTS)
    in_sentence = sorted({c for r in rules for c in r[5]})
    in_clause = sorted({c for r in rules for c in [*r[3], *r[4]]})
    sents = F.transform(F.split(F.col("__body"), "\\."), lambda s: F.struct(
        s.alias("text"), X.durations_days(s).alias("durs"), *[_any_contains(s, terms.get(c, [])).alias(f"has_{c}") for c in in_sentence]))
    base = cleaned.select(
        id_col, *keep, *extra_names,
        "type_candidates",
        *[_any_contains(F.col("__body"), terms.get(c, [])).alias(f"__has_{c}") for c in in_clause],
        sents.alias("sentences"),
    )
    # a mask of the clause-level tests, and for sentence rules one of the
    # per-sentence tests
    sent_rules = [i for i, r in enumerate(rules) if r[8] == "sentence"]
    no = F.lit(0).cast("bigint")
    ok = _masks([_clause_ok(r) for r in rules])
    asked = _masks([_clause_ok(rules[i]) for i in sent_rules])
    oks, askeds = [f"__ok{i}" for i in range(len(ok))], [f"__asked{i}" for i in range(len(asked))]

    def marked(s):
        return F.struct(s["text"].alias("text"), *[m.alias(f"m{i}") for i, m in enumerate(_masks([_sent_hit(s, rules[i]) for i in sent_rules]))])

    step = base.select(id_col, *keep, *extra_names, "type_candidates", F.transform("sentences", marked).alias("flags"),
                       *[m.alias(n) for m, n in zip(ok, oks, strict=True)], *[m.alias(n) for m, n in zip(asked, askeds, strict=True)])

    def any_sentence(i: int) -> Column:
        return F.aggregate("flags", no, lambda acc, s: acc.bitwiseOR(s[f"m{i}"]))

    met = step.select("*", *[any_sentence(i).alias(f"__met{i}") for i in range(len(askeds))])
    met_masks, ok_masks = [F.col(f"__met{i}") for i in range(len(askeds))], [F.col(n) for n in oks]
    fired = []
    for i, r in enumerate(rules):
        c = _bit(ok_masks, i)
        if r[8] == "sentence":
            c = c & _bit(met_masks, sent_rules.index(i))
        fired.append((r[0], c))

    def is_notable(s):
        # a sentence is notable when a sentence rule whose clause test holds
        # also holds on it; the masks are columns of the row by now
        out = F.lit(False)
        for i, n in enumerate(askeds):
            out = out | (s[f"m{i}"].bitwiseAND(F.col(n)) != 0)
        return out

    notable = F.transform(F.filter("flags", is_notable), lambda s: F.concat(s["text"], F.lit(".")))
    done = met.select(id_col, *keep, *extra_names, "type_candidates", F.array_distinct(_names_where(fired)).alias("policies"), notable.alias("notable"))
    return done.select(
        id_col, *keep, *extra_names,
        F.array_min("type_candidates").alias("type"),
        "type_candidates",
        (F.size("policies") == 0).alias("valid"),
        "policies",
        "notable",
    )


# ---------------------------------------------------------------------------
# Rule text -> rule table; A13, J8, A14 on it
RULE_SCHEMA = T.StructType([
    T.StructField("policy", T.StringType()), T.StructField("rule_no", T.IntegerType()),
    T.StructField("antecedents", T.ArrayType(T.StringType())), T.StructField("consequent", T.StringType()),
])


def parse_rules(lines: DataFrame, line_col: str = "value", pos_col: str = "pos") -> DataFrame:
    """Skip blank and ``#`` lines; ``key: a ^ b ^ c -> consequent``;
    several rules per policy id numbered in line order.  ``lines`` carries an
    explicit line position ``pos_col``."""
    t = F.col(line_col)
    keep = lines.where((X.strip_ws(t) != "") & ~X.strip_ws(t).startswith("#"))
    key = F.split(t, ":").getItem(0)
    rest = F.regexp_replace(t, "^[^:]*:", "")
    ante = F.split(rest, "->").getItem(0)
    cons = X.strip_ws(F.try_element_at(F.split(rest, "->"), F.lit(2)))
    parsed = keep.select(key.alias("policy"), F.col(pos_col).alias("pos"),
                         F.split(ante, "\\^").alias("antecedents"), cons.alias("consequent"))
    from pyspark.sql import Window
    w = Window.partitionBy("policy").orderBy("pos")
    return parsed.withColumn("rule_no", F.row_number().over(w)).select(
        "policy", "rule_no", "antecedents", "consequent", "pos")


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """S4 from a text file (line positions from a whole-text read, so the
    order is exact; a rule file is a configuration file)."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return parse_rules(lines)


def rule_types(rules: DataFrame) -> DataFrame:
    """Clause types quoted in predicates that mention ``type``, ordered by
    first appearance ``(type, first_pos)``."""
    e = rules.select("pos", "rule_no", F.posexplode("antecedents").alias("apos", "pred"))
    e = e.where(F.col("pred").contains("type"))
    e = e.select("pos", "apos", F.explode(F.regexp_extract_all("pred", F.lit('"([^"]*)"'), 1)).alias("type"))
    return e.groupBy("type").agg(F.min(F.struct("pos", "apos")).alias("first")).select(
        "type", F.col("first.pos").alias("first_pos"), F.col("first.apos").alias("first_apos"))


def policies_of_type(rules: DataFrame) -> DataFrame:
    """``(type, policy, first_pos)``: the policies whose rules name the
    type in a ``type`` predicate."""
    e = rules.select("policy", "pos", F.explode("antecedents").alias("pred")).where(F.col("pred").contains("type"))
    e = e.select("policy", "pos", F.explode(F.regexp_extract_all("pred", F.lit('"([^"]*)"'), 1)).alias("type"))
    return e.groupBy("type", "policy").agg(F.min("pos").alias("first_pos"))


def policy_applies_to_sentence(rules: DataFrame) -> DataFrame:
    """``(policy, applies)``: false if any predicate needs the whole
    clause, else true if any predicate can be checked on one sentence, else
    false."""
    e = rules.select("policy", F.explode("antecedents").alias("pred"))
    name = X.strip_ws(F.split("pred", "\\(").getItem(0))
    e = e.withColumn("name", name)
    return e.groupBy("policy").agg(
        (~F.bool_or(F.col("name").isin(SENTENCE_INCOMPATIBLE))
         & F.bool_or(F.col("name").isin(SENTENCE_COMPATIBLE))).alias("applies"))


def parse_vocab_files(spark: SparkSession, directory: str, is_type: bool) -> DataFrame:
    """Every file of a vocabulary directory (with or without extension):
    name = file name minus extension, terms = whitespace-split content.
    Files of a ``name=<concept>`` folder, as ``write_vocab`` lays them out,
    belong to that concept, in any number of parts."""
    df = spark.read.text(directory, wholetext=True, recursiveFileLookup=True).select(
        F.col("value"), F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_path", "/name=([^/]*)/[^/]*$", 1).alias("part"))
    name = F.when(F.col("part") != "", F.url_decode("part")).otherwise(F.regexp_replace("file", "\\.[^.]*$", ""))
    rows = df.select(name.alias("name"), X.ws_split(F.col("value")).alias("terms"))
    return rows.groupBy("name").agg(F.flatten(F.collect_list("terms")).alias("terms")).select("name", "terms", F.lit(is_type).alias("is_type"))


def write_vocab(vocab: DataFrame, directory: str) -> None:
    """Vocabulary ``(name, terms)`` as a directory that S6 reads: a folder for
    each concept, written by the tasks that hold its terms."""
    vocab.select("name", F.array_join("terms", " ").alias("value")).write.mode("overwrite").partitionBy("name").text(directory)


def class_files(spark: SparkSession, directory: str) -> DataFrame:
    """One class per line, one file per label column ->
    ``(domain, pos, name)``.  A file of a ``domain=<column>`` folder belongs to
    that column."""
    df = spark.read.text(directory, wholetext=True, recursiveFileLookup=True).select(
        F.col("value"), F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_path", "/domain=([^/]*)/[^/]*$", 1).alias("part"))
    domain = F.when(F.col("part") != "", F.url_decode("part")).otherwise(F.regexp_replace("file", "\\.[^.]*$", ""))
    lines = F.filter(F.transform(F.split("value", "\n"), X.strip_ws), lambda x: x != "")
    return df.select(domain.alias("domain"), F.posexplode(lines).alias("pos", "name"))
