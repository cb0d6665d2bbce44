"""Views of the given tables in the engine's data model.

* conversations -> two-level granules: clause ``zfill(conv_id,6)``, sentence
  ``<clause>_zfill(turn,3)``; sentence labels (role, size), clause labels
  (first role, turn-count band).
* documents + labels -> one-level segments with label columns.
* orders + lineitem -> contract clauses: one clause per order (title from
  the order priority), one sentence per line item (a fixed sentence template
  chosen by return flag and line status, numbers from the line).
* orders (+ clauses) -> clause requests for routing / streaming.

All views are lazy DataFrames over the parquet scans, so their cost grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausefold.functions import ids as I
from clausefold.sources.tables import table

CONV_CLAUSE_W, CONV_SENT_W = 6, 3


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, size, text) one row per turn."""
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select(
        I.make_id((F.col("conv_id"), CONV_CLAUSE_W), (F.col("turn"), CONV_SENT_W)).alias("id"),
        F.col("role"),
        F.when(F.length("text") < 200, "short").otherwise("long").alias("size"),
        F.col("text"),
    )


def conversation_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, first_role, band) one row per conversation."""
    c = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    return c.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.count(F.lit(1)).alias("n")
    ).select(
        I.zfill(F.col("conv_id"), CONV_CLAUSE_W).alias("id"),
        "first_role",
        F.when(F.col("n") >= 4, "long").otherwise("short").alias("band"),
    )


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, lang, source) one row per document."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source")


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, source, quality, toxic) for labelled documents; the label
    columns are strings, as label files are."""
    d = table(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return d.join(lab, "doc_id", "inner").select(
        F.col("doc_id").cast("string").alias("id"), "lang", "source",
        F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))


# Clause titles per order priority and sentence templates per
# (return flag, line status); {q} = quantity, {w} = quantity in words,
# {n} = line number, {p} = floor of the extended price.
CLAUSE_TITLES = [
    ("1-URGENT", "Résiliation du contrat"),
    ("2-HIGH", "Conditions de paiement"),
    ("3-MEDIUM", "Non-sollicitation du personnel"),
    ("4-NOT SPECIFIED", "Clause de non-concurrence"),
    ("5-LOW", "Indemnisation et responsabilité"),
]
PENDING_TITLE_SUFFIX = " et facturation"
SENTENCE_TEMPLATES = [
    ("R", "F", "Le fournisseur peut résilier avec un préavis de {q} jours."),
    ("R", "O", "Le client peut résilier le contrat sous {w} jours, sans indemnité."),
    ("A", "F", "Le client paie par virement sous {q} jours."),
    ("A", "O", "Le paiement par chèque est accepté dans un délai de {n} mois."),
    ("N", "F", "Le partenaire s'interdit de solliciter le personnel pendant {n} ans, contre une rémunération de {p} euros."),
    ("N", "O", "Le prestataire ne fera pas concurrence au client pendant {q} mois."),
]


def french_name(n: int) -> str:
    """The French cardinal of 0 to 99, written with hyphens and ``et``."""
    # The names that the others are made of
    low = ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize "
           "dix-sept dix-huit dix-neuf").split()
    tens = {2: "vingt", 3: "trente", 4: "quarante", 5: "cinquante", 6: "soixante", 7: "soixante", 8: "quatre-vingt", 9: "quatre-vingt"}
    if n < 20:
        return low[n]
    ten, rest = divmod(n, 10)
    if ten in (7, 9):
        rest += 10
    if rest == 0:
        return tens[ten] + ("s" if ten == 8 else "")
    return tens[ten] + (" et " if rest in (1, 11) and ten < 8 else "-") + low[rest]


def french_name_999(n: int) -> str:
    """The French cardinal of 0 to 999."""
    hundreds, rest = divmod(n, 100)
    if not hundreds:
        return french_name(n)
    head = "cent" if hundreds == 1 else f"{french_name(hundreds)} cent" + ("" if rest else "s")
    return head + (f" {french_name(rest)}" if rest else "")


def english_name(n: int) -> str:
    """The English cardinal of 0 to 999."""
    # The names that the others are made of
    low = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    if n < 20:
        return low[n]
    if n < 100:
        return tens[n // 10 - 2] + (f"-{low[n % 10]}" if n % 10 else "")
    return f"{low[n // 100]} hundred" + (f" and {english_name(n % 100)}" if n % 100 else "")


def spanish_name(n: int) -> str:
    """The Spanish cardinal of 0 to 999."""
    # The names that the others are made of
    low = ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte "
           "veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve").split()
    tens = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
    hundreds = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()
    if n < 30:
        return low[n]
    if n < 100:
        return tens[n // 10 - 3] + (f" y {low[n % 10]}" if n % 10 else "")
    return "cien" if n == 100 else hundreds[n // 100 - 1] + (f" {spanish_name(n % 100)}" if n % 100 else "")


NAMES = {"fr": french_name_999, "en": english_name, "es": spanish_name}


def numbers_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, lang, n, text) one sentence per line item
    with a number below a million in words, in one of three languages."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    n = (F.floor(F.col("l_extendedprice") * 100) + F.col("l_orderkey")) % 1_000_000
    rows = li.select("l_orderkey", "l_linenumber", F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("lang"), n.alias("n"))
    rows = rows.withColumn("high", F.floor(F.col("n") / 1000)).withColumn("low", F.col("n") % 1000)
    # three thousand rows, whatever the tables
    names = spark.createDataFrame([(lang, k, name(k)) for lang, name in NAMES.items() for k in range(1000)], "lang string, k long, name string")
    rows = rows.join(F.broadcast(names.select("lang", F.col("k").alias("high"), F.col("name").alias("many"))), ["lang", "high"])
    rows = rows.join(F.broadcast(names.select("lang", F.col("k").alias("low"), F.col("name").alias("rest"))), ["lang", "low"])
    lang, one = F.col("lang"), F.col("high") == 1
    # before "mille" the plural of cents and vingts goes
    french = F.when(one, F.lit("mille")).otherwise(F.concat(F.regexp_replace("many", "(cent|vingt)s$", "$1"), F.lit(" mille")))
    thousands = F.when(lang == "fr", french).when(lang == "en", F.concat("many", F.lit(" thousand"))).otherwise(F.when(one, F.lit("mil")).otherwise(F.concat("many", F.lit(" mil"))))
    joint = F.when((lang == "en") & (F.col("low") < 100), F.lit(" and ")).otherwise(F.lit(" "))
    words = F.when(F.col("high") == 0, F.col("rest")).when(F.col("low") == 0, thousands).otherwise(F.concat(thousands, joint, "rest"))
    return rows.select("l_orderkey", "l_linenumber", "lang", "n", F.concat(F.lit("Article "), words, F.lit(" du contrat")).alias("text"))


def _template(tpl: str):
    parts = []
    rest = tpl
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i > 0:
            parts.append(F.lit(rest[:i]))
        key = rest[i + 1]
        parts.append({
            "q": F.col("l_quantity").cast("int").cast("string"),
            "w": F.element_at(F.array(*[F.lit(french_name(k)) for k in range(100)]), F.col("l_quantity").cast("int") % 100 + 1),
            "n": F.col("l_linenumber").cast("string"),
            "p": F.floor("l_extendedprice").cast("string"),
        }[key])
        rest = rest[i + 3:]
    return F.concat(*parts)


def clause_title(priority_col: str = "o_orderpriority", status_col: str = "o_orderstatus"):
    t = F.lit(None).cast("string")
    for pr, title in reversed(CLAUSE_TITLES):
        t = F.when(F.col(priority_col) == pr, F.lit(title)).otherwise(t)
    return F.when(F.col(status_col) == "P", F.concat(t, F.lit(PENDING_TITLE_SUFFIX))).otherwise(t)


def contract_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clause_id, n, text) one sentence per line item."""
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"])
    txt = F.lit(None).cast("string")
    for rf, ls, tpl in reversed(SENTENCE_TEMPLATES):
        txt = F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), _template(tpl)).otherwise(txt)
    return li.select(F.col("l_orderkey").alias("clause_id"), F.col("l_linenumber").alias("n"), txt.alias("text"))


def contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clause_id, contract_id, title, text, priority): text = the clause's
    sentences in line order joined by one space; orders without lines have no
    clause here."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"])
    s = contract_sentences(spark, sf_dir)
    body = s.groupBy("clause_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    return o.join(body, o.o_orderkey == body.clause_id, "inner").select(
        "clause_id", F.col("o_custkey").alias("contract_id"), clause_title().alias("title"), "text",
        F.col("o_orderpriority").alias("priority"))


def order_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, clause_id, title) of every order, with or without lines."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"])
    return o.select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("clause_id"), clause_title().alias("title"))


def requests_from_orders(orders: DataFrame, bodies: DataFrame) -> DataFrame:
    """Requests (request_id, title, text, domain, type, anomalous, o_orderdate)
    from order rows and clause bodies (clause_id, text); orders without lines
    get a null text (invalid)."""
    typ = F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ["resiliation", "paiement", "non_sollicitation", "non_concurrence", "indemnisation"]]),
                     F.substring("o_orderpriority", 1, 1).cast("int")))
    anom = (F.when(F.col("o_orderstatus") != "P", F.lit(""))
            .when(F.col("o_totalprice") < 50000, F.lit("True"))
            .when(F.col("o_totalprice") < 100000, F.lit("1"))
            .when(F.col("o_totalprice") < 150000, F.lit("true"))
            .otherwise(F.lit("False")))
    return orders.join(bodies, orders.o_orderkey == bodies.clause_id, "left").select(
        F.col("o_orderkey").alias("request_id"), clause_title().alias("title"), F.col("text"),
        F.lit("services").alias("domain"), typ.alias("type"), anom.alias("anomalous"), F.col("o_orderdate"))


def clause_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = contract_sentences(spark, sf_dir)
    return s.groupBy("clause_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))


def clause_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (request_id, title, text, domain, type, anomalous): every
    order is a request; orders without lines have a null text (invalid)."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return requests_from_orders(o, clause_bodies(spark, sf_dir)).drop("o_orderdate")
