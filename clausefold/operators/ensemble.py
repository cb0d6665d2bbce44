"""Sub-model ballots, ensemble votes and the ensemble search (A7, A8, M6,
C4, C5-C7 selection, W8).

Every distinct sub-model predicts once, and a row holds all its ballots: the
sentences' votes (A7), the members' votes of every ensemble (A8) and so the
answers are worked out in the row.  One aggregation scores all ensembles, and
the best one is picked (W8).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausefold.functions import text as X
from clausefold.functions.arrays import explode_rows
from clausefold.operators import metrics as M
from clausefold.operators import vote as V

# Language classes (code = position) and three keyword
# sub-models used as stand-ins for trained classifiers on the document table.
LANG_MAPPING = ["de", "en", "es", "fr"]
KEYWORD_MODELS = [
    ("kw1", [("de", ["und", "der", "nicht"]), ("en", ["the", "and", "of"]),
             ("es", ["los", "el", "del"]), ("fr", ["les", "des", "une"])]),
    ("kw2", [("de", ["sich", "mit", "ist"]), ("en", ["that", "with", "is"]),
             ("es", ["para", "con", "una"]), ("fr", ["dans", "pour", "est"])]),
    ("kw3", [("de", ["von", "das", "auf"]), ("en", ["was", "this", "are"]),
             ("es", ["por", "las", "que"]), ("fr", ["qui", "sur", "avec"])]),
]


def keyword_predict(tokens: Column, vocab) -> Column:
    """Code of the first class (mapping order) with a keyword among the
    tokens, else -1.  ``arrays_overlap`` keeps the tokens out of any lambda,
    so they are computed once per row."""
    out = F.lit(-1)
    for n, terms in reversed(vocab):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms])), F.lit(LANG_MAPPING.index(n))).otherwise(out)
    return out


def keyword_all(tokens: Column, vocab) -> Column:
    """Names of every class with a keyword among the tokens (mapping order)."""
    hits = F.array(*[F.when(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms])), F.lit(n))
                     for n, terms in vocab])
    return F.filter(hits, lambda x: x.isNotNull())


def sub_models() -> list[tuple[str, str, int]]:
    """(model, keyword model, granularity 0 = document, 1 = sentence)."""
    return [(f"{m}_g{g}", m, g) for g in (0, 1) for m, _ in KEYWORD_MODELS]


def ensembles(sizes=(2, 3)) -> list[tuple[int, str, int]]:
    """Ensemble members ``(ensemble_no, model, pos)``: every combination of
    the given sizes, numbered in generation order."""
    names = [m for m, _, _ in sub_models()]
    out, no = [], 0
    for k in sizes:
        for combo in combinations(names, k):
            no += 1
            out += [(no, m, i) for i, m in enumerate(combo)]
    return out


def ballot_rows(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """M6 / A7 inside the row: ``(keep..., y)`` with one ballot per sub-model
    in the order of ``sub_models``.  Sentences of a document are an array of
    it, so their votes need neither rows nor a shuffle."""
    vocab = [v for _, v in KEYWORD_MODELS]
    # cleaned text, then tokens: each in a projection of its own
    clean = docs.select(*keep, X.clean(F.col(text_col)).alias("clean"))
    tok = clean.select(*keep, X.ws_split(F.col("clean")).alias("tok"),
                       F.transform(X.split_sentences(F.col("clean")), lambda s: X.ws_split(s)).alias("sents"))
    codes = F.transform("sents", lambda t: F.struct(*[keyword_predict(t, v).alias(f"m{i}") for i, v in enumerate(vocab)]))
    coded = tok.select(*keep, F.array(*[keyword_predict(F.col("tok"), v) for v in vocab]).alias("doc"), codes.alias("codes"))

    def of_model(i: int) -> Column:
        return F.transform("codes", lambda c: c[f"m{i}"])

    split = coded.select(*keep, "doc", *[of_model(i).alias(f"s{i}") for i in range(len(vocab))])
    return split.select(*keep, F.concat("doc", F.array(*[V.vote_arrays(F.col(f"s{i}")) for i in range(len(vocab))])).alias("y"))


def search_rows(ballots: DataFrame, group_cols: list[str], expected_col: str = "expected") -> DataFrame:
    """A8 + A11 + W8 on rows that hold all ballots: every ensemble votes in
    the row, the confusion of all ensembles is one aggregation."""
    names = [m for m, _, _ in sub_models()]
    members: dict[int, list[int]] = {}
    for no, model, _ in ensembles():
        members.setdefault(no, []).append(names.index(model))
    picks = F.array(*[F.struct(F.lit(no).alias("ensemble_no"), F.array(*[F.col("y")[k] for k in own]).alias("b")) for no, own in members.items()])
    votes = explode_rows(ballots, [*group_cols, F.col(expected_col).alias("expected")], picks, "p")
    # a document without sentences has no sentence ballot: null ballots don't vote
    votes = votes.select(*group_cols, "expected", "p.ensemble_no", F.filter("p.b", lambda v: v.isNotNull()).alias("b"))
    voted = votes.select(*group_cols, "expected", "ensemble_no", V.vote_arrays(F.col("b")).alias("y")).where(F.col("y").isNotNull())
    return best_ensemble(M.confusion(voted, "expected", "y", group_cols + ["ensemble_no"]), group_cols)


def best_ensemble(conf: DataFrame, group_cols: list[str]) -> DataFrame:
    """W8 on the confusion of (group, ensemble)."""
    scores = M.macro_scores(conf, group_cols + ["ensemble_no"])
    # scores equal up to float summation order are ties: the first wins
    w = Window.partitionBy(*group_cols).orderBy(F.round("macro_f1", 12).desc(), F.col("ensemble_no").asc())
    return scores.withColumn("rk", F.row_number().over(w)).where("rk = 1").select(
        *group_cols, "ensemble_no", "macro_f1")
