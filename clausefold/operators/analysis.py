"""Ensemble searches and the phased clause analysis.

A *configuration* is a list of sub-models and a clause vote.  The three
searches differ in their configuration tables, which follow from the policy
rules, and share everything else: each distinct sub-model predicts once, the
ballots of a clause are a map in its row, all configurations vote there, one
aggregation gives the confusion of all of them, and the best macro F1 wins
(the earlier configuration on ties).

The analysis runs in phases:

* alpha: the clause type, by the type sub-models and the title keyword, whose
  ballot comes first and wins ties;
* beta: anomalous or not, by the ensemble of the clause's type, or the
  ``default`` ensemble if the type is unknown or has none;
* gamma: the ranked list of violated policies, by the ensemble of the type or
  the ``default``; a type with a single policy names that policy.

Every phase scores only the rows that reach it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausefold.functions.arrays import explode_rows
from clausefold.operators import learn as L
from clausefold.operators import metrics as M
from clausefold.operators import rules as R
from clausefold.operators import vote as V

TRANSFORMERS = ("count", "tfidf", "hash")
NONE, DEFAULT = "None", "default"


# ---------------------------------------------------------------------------
# what the rules say of a type
def types_of_rules(rules=R.POLICY_RULES) -> list[str]:
    """A13 on the rule table: types in order of first appearance."""
    return list(dict.fromkeys(r[2] for r in rules))


def policies_of(ctype: str, rules=R.POLICY_RULES) -> list[str]:
    """J8 on the rule table."""
    return list(dict.fromkeys(r[0] for r in rules if r[2] == ctype))


def applies_to_sentence(policy: str, rules=R.POLICY_RULES) -> bool:
    """A14 on the rule table: all rules of the policy look at one sentence."""
    return all(r[8] == "sentence" for r in rules if r[0] == policy)


# ---------------------------------------------------------------------------
# configuration tables
@dataclass(frozen=True)
class Member:
    """A sub-model of a search: what it predicts (``type``, ``anomalous`` or
    ``policy``), at which granularity, from which clauses."""

    target: str
    granularity: int
    transformer: str
    oversample: bool = False
    only_type: str | None = None
    only_policies: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        parts = (self.target, f"g{self.granularity}", self.transformer, "os" if self.oversample else "", self.only_type or "", "+".join(self.only_policies))
        return "|".join(parts)


@dataclass(frozen=True)
class Config:
    """One candidate of a search; sentence ballots are voted ``ato`` if
    ``sentence_default`` is given, else ``std``."""

    number: int
    members: tuple[Member, ...]
    mode: str = "std"
    default: int | None = None
    sentence_default: int | None = None


def alpha_configs() -> list[Config]:
    """A clause model and a sentence model, each with three transformers,
    with and without oversampling: 36 ensembles of 12 sub-models."""
    out = []
    for t1 in TRANSFORMERS:
        for t2 in TRANSFORMERS:
            for o1 in (True, False):
                for o2 in (True, False):
                    out.append(Config(len(out) + 1, (Member("type", 0, t1, o1), Member("type", 1, t2, o2))))
    return out


def _masked(target: str, ctype: str, mask: int, transformer: str, of_type: tuple[str, ...], sentence_too: bool) -> tuple[Member, ...]:
    members = [Member(target, 0, transformer, only_type=ctype, only_policies=of_type)]
    if mask & 1:
        members.append(Member(target, 1, transformer, only_type=ctype, only_policies=of_type))
    if mask & 2:
        for policy in policies_of(ctype):
            members.append(Member(target, 0, transformer, only_type=ctype, only_policies=(policy, NONE)))
            if sentence_too and applies_to_sentence(policy):
                members.append(Member(target, 1, transformer, only_type=ctype, only_policies=(policy, NONE)))
    if mask & 4:
        members.append(Member(target, 0, transformer, only_policies=of_type))
    return tuple(members)


def beta_configs(ctype: str | None) -> list[Config]:
    """C6 for a type: the clause model, and by bits a sentence model, one
    model for each policy, a model of all clauses; three transformers, votes
    ``std`` and at-least-one.  Without a type: the ``default`` ensemble."""
    out: list[Config] = []
    if ctype is None:
        return [Config(i + 1, (Member("anomalous", 0, t),), sentence_default=1) for i, t in enumerate(TRANSFORMERS)]
    for mask in range(8):
        for t in TRANSFORMERS:
            for mode, default in (("std", None), ("ato", 1)):
                out.append(Config(len(out) + 1, _masked("anomalous", ctype, mask, t, (), False), mode, default, sentence_default=1))
    return out


def gamma_configs(ctype: str | None) -> list[Config]:
    """C7 for a type of two or more policies: as beta, with a sentence model
    for policies that apply to one, and the vote ``not`` with default 0.  A
    type with fewer has no configuration; without a type, the ``default``."""
    if ctype is None:
        every = tuple(p for p in R.POLICY_CLASSES if p != NONE)
        return [Config(i + 1, (Member("policy", 0, t, only_policies=every),), sentence_default=1) for i, t in enumerate(TRANSFORMERS)]
    policies = tuple(policies_of(ctype))
    if len(policies) < 2:
        return []
    out: list[Config] = []
    for mask in range(8):
        for t in TRANSFORMERS:
            out.append(Config(len(out) + 1, _masked("policy", ctype, mask, t, policies, True), "not", 0))
    return out


def distinct_members(configs: list[Config]) -> list[tuple[Member, int | None]]:
    """Each sub-model once, with the default of its sentence vote."""
    return list({m.key: (m, c.sentence_default) for c in configs for m in c.members}.values())


# ---------------------------------------------------------------------------
# votes and selection on rows that hold all ballots
def vote_row(values: Column, mode: str, default: int | None) -> Column:
    """A8 inside the row; null ballots don't vote, no winner is -1."""
    v = F.filter(values, lambda x: x.isNotNull())
    if mode == "ato":
        win = F.when(F.array_contains(v, F.lit(default)), F.lit(default))
    elif mode == "not":
        others = F.filter(v, lambda x: x != F.lit(default))
        win = F.when(F.size(others) > 0, V.vote_arrays(others)).when(F.size(v) > 0, F.lit(default))
    else:
        win = V.vote_arrays(v)
    return F.coalesce(win.cast("int"), F.lit(-1))


def vote_configs(rows: DataFrame, configs: list[Config], keep: list[str]) -> DataFrame:
    """``(keep..., config, y)``: every configuration's answer for every row of
    ``rows``, whose ``ballots`` maps sub-model keys to codes."""
    answers = F.array(*[F.struct(
        F.lit(c.number).alias("config"),
        F.array(*[F.element_at("ballots", m.key) for m in c.members]).alias("b"),
        F.lit(c.mode).alias("mode"), F.lit(c.default).cast("int").alias("default")) for c in configs])
    e = explode_rows(rows, keep, answers, "a").select(*keep, "a.config", "a.b", "a.mode", "a.default")
    modes = sorted({(c.mode, c.default) for c in configs}, key=str)
    win = reduce(lambda otherwise, md: F.when((F.col("mode") == md[0]) & F.col("default").eqNullSafe(F.lit(md[1])), vote_row(F.col("b"), *md)).otherwise(otherwise),
                 modes, F.lit(-1))
    return e.select(*keep, "config", win.alias("y"))


def best_configs(answers: DataFrame, group_cols: list[str], count_col: str | None = None) -> DataFrame:
    """A11 + W8: ``(group..., config, macro_f1)`` of the best configuration; an
    answer stands for as many rows as its ``count_col`` says, if given."""
    scores = M.macro_scores(M.confusion(answers, "expected", "y", [*group_cols, "config"], count_col), [*group_cols, "config"])
    # scores equal up to float summation order are ties: the first wins
    w = Window.partitionBy(*group_cols).orderBy(F.round("macro_f1", 12).desc(), F.col("config").asc())
    return scores.withColumn("rk", F.row_number().over(w)).where("rk = 1").select(*group_cols, "config", "macro_f1")


def expected_codes(target: str, types: list[str], label: str = "type", policy: str = "policy") -> Column:
    """J11 in the searches: labels outside the mapping count as 1."""
    if target == "type":
        code = M.label_to_val(F.col(label), types)
    elif target == "anomalous":
        return (F.col(policy) != NONE).cast("int")
    else:
        code = M.label_to_val(F.col(policy), R.POLICY_CLASSES)
    return F.when(code >= 0, code).otherwise(F.lit(1))


def best_on_ballots(rows: DataFrame, configs: list[Config]) -> DataFrame:
    """``(config, macro_f1)`` of the best configuration on rows ``(expected,
    ballots)``.  An answer follows from the codes of the sub-models alone, so
    rows are counted by them first and the configurations vote once for each
    combination, of which there are never more than rows."""
    keys = [m.key for m, _ in distinct_members(configs)]
    codes = F.array(*[F.element_at("ballots", k) for k in keys])
    counted = rows.select("expected", codes.alias("codes")).groupBy("expected", "codes").agg(F.count(F.lit(1)).alias("n"))
    ballots = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.col("codes"))
    answers = vote_configs(counted.select("expected", "n", ballots.alias("ballots")), configs, ["expected", "n"])
    return best_configs(answers, [], "n")


# ---------------------------------------------------------------------------
# fitted sub-models
def sub_model(member: Member, types: list[str], sentence_default: int | None = None, classifier: str = "svm") -> L.SubModel:
    """The learner of a search member."""
    classes = {"type": types, "anomalous": ["0", "1"], "policy": R.POLICY_CLASSES}[member.target]
    return L.SubModel(
        0, classes, granularity=member.granularity, transformer=member.transformer, oversample=member.oversample, classifier=classifier,
        vote_mode="std" if sentence_default is None else "ato", vote_default=sentence_default)


def member_rows(labelled: DataFrame, member: Member) -> DataFrame:
    """The clauses ``(id, text, label)`` that a member learns from, out of
    ``(id, title, text, type, policy)``."""
    d = labelled
    if member.only_type:
        d = d.where(F.col("type") == member.only_type)
    if member.only_policies:
        d = d.where(F.col("policy").isin(*member.only_policies))
    known = [L.CLEAN] if L.CLEAN in labelled.columns else []
    return d.select("id", "text", member_label(member).alias("label"), *known)


def member_label(member: Member) -> Column:
    return {"type": F.col("type"), "anomalous": F.when(F.col("policy") == NONE, "0").otherwise("1"), "policy": F.col("policy")}[member.target]


def fit_words(labelled: DataFrame, members: list[Member], types: list[str]) -> list[tuple]:
    """``fit_member`` of many members by word tables: what a member learns
    from a clause follows from its type and policy, so the words of all
    clauses, and of all sentences, are counted by these once.  ``labelled``
    has cleaned texts."""
    from clausefold.operators import bayes as B

    def code(m: Member, cfg: L.SubModel) -> Column:
        own = F.lit(True)
        if m.only_type:
            own = own & (F.col("type") == m.only_type)
        if m.only_policies:
            own = own & F.col("policy").isin(*m.only_policies)
        return F.when(own, M.label_to_val(member_label(m), cfg.classes))

    cell, out = ["type", "policy"], {}
    for granularity in sorted({m.granularity for m in members}):
        rows = labelled.select(*cell, F.col(L.CLEAN).alias("text"))
        if granularity >= 1:
            rows = L.sentence_rows(labelled).join(labelled.select("id", *cell), "id").select(*cell, "text")
        own = [(m, sub_model(m, types, classifier="words")) for m in members if m.granularity == granularity]
        models = B.fit_cells(rows, cell, "text", [code(m, cfg) for m, cfg in own])
        out |= {m.key: (cfg, model) for (m, cfg), model in zip(own, models, strict=True)}
    return [out[m.key] for m in members]


def fit_member(labelled: DataFrame, member: Member, types: list[str], sentence_default: int | None = None, classifier: str = "svm"):
    cfg = sub_model(member, types, sentence_default, classifier)
    return cfg, L.fit(L.training_rows(member_rows(labelled, member), cfg), cfg)


def ballot_maps(models: dict[str, tuple], clauses: DataFrame) -> DataFrame:
    """``(id, ballots)``: what each fitted sub-model says of each clause.  The
    predictions are a handful of rows per clause, gathered by id."""
    parts = [L.predict_ballots(model, clauses, cfg).select("id", F.lit(key).alias("key"), "y") for key, (cfg, model) in models.items()]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "y"))).alias("ballots"))


def search(train: DataFrame, test: DataFrame, configs: list[Config], types: list[str], classifier: str = "svm",
           only_type: str | None = None) -> DataFrame:
    """C5-C7 with fitted models: ``(config, macro_f1)`` of the best
    configuration on ``test``.  Both tables are ``(id, title, text, type,
    policy)``; every distinct sub-model is fitted once."""
    models = {m.key: fit_member(train, m, types, d, classifier) for m, d in distinct_members(configs)}
    kept = test.where(F.col("type") == only_type) if only_type else test
    truth = kept.select("id", expected_codes(configs[0].members[0].target, types).alias("expected"))
    rows = ballot_maps(models, kept).join(truth, "id")
    return best_on_ballots(rows, configs)


def search_words(train: DataFrame, test: DataFrame, searches: dict[str | None, list[Config]], types: list[str]) -> DataFrame:
    """C5-C7 over word-table models: ``(type, config, macro_f1)`` of the best
    configuration of each search.  ``searches`` has a type's configurations,
    or under None those for all clauses; both tables are (id, title, text,
    type, policy).

    All sub-models of all searches are fitted in one pass over the training
    rows and answer in one pass over the test rows; a sub-model answers for
    the rows of the searches that use it.
    """
    from clausefold.operators import bayes as B
    members: dict[str, tuple[Member, int | None]] = {}
    askers: dict[str, set[str | None]] = {}
    for ctype, configs in searches.items():
        for m, default in distinct_members(configs):
            members[m.key] = m, default
            askers.setdefault(m.key, set()).add(ctype)

    def facts(m: Member) -> list[Column]:
        return [F.lit(m.key).alias("member"), F.lit(m.granularity).alias("g"), F.lit(m.transformer).alias("kind"), F.lit(m.oversample).alias("balanced")]

    def learns(m: Member) -> Column:
        own = F.lit(True)
        if m.only_type:
            own = own & (F.col("type") == m.only_type)
        if m.only_policies:
            own = own & F.col("policy").isin(*m.only_policies)
        y = {"type": M.label_to_val("type", types), "anomalous": (F.col("policy") != NONE).cast("int"), "policy": M.label_to_val("policy", R.POLICY_CLASSES)}[m.target]
        return F.when(own & (y >= 0), F.struct(*facts(m), y.alias("y")))

    def asks(m: Member) -> Column:
        own = F.lit(None in askers[m.key])
        for t in askers[m.key] - {None}:
            own = own | (F.col("type") == t)
        return F.when(own, F.struct(*facts(m)))

    def spread(rows: DataFrame, parts: list[Column]) -> DataFrame:
        e = explode_rows(rows, ["id"], F.filter(F.array(*parts), lambda x: x.isNotNull()), "x")
        return e.select("id", "x.*")

    def cleaned(rows: DataFrame) -> DataFrame:
        return L.cleaned(rows).select("id", F.col(L.CLEAN).alias("text"))

    weights, bias = B.fit_many(spread(train, [learns(m) for m, _ in members.values()]), cleaned(train))
    said = B.predict_many(weights, bias, spread(test, [asks(m) for m, _ in members.values()]).drop("balanced"), cleaned(test))
    votes = said.groupBy("id", "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("sno", "y"))), lambda x: x["y"]).alias("v"))
    least = {k: d for k, (m, d) in members.items() if m.granularity and d is not None}
    y = reduce(lambda other, k: F.when(F.col("member") == k, F.when(F.array_contains("v", least[k]), F.lit(least[k]))).otherwise(other), least, V.vote_arrays(F.col("v")))
    ballots = votes.select("id", "member", y.cast("int").alias("y")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("member", "y"))).alias("ballots"))
    rows = cut(test.select("id", "type", "policy").join(ballots, "id"))
    out = []
    for ctype, configs in searches.items():
        kept = rows.where(F.col("type") == ctype) if ctype else rows
        d = kept.select(expected_codes(configs[0].members[0].target, types).alias("expected"), "ballots")
        best = best_on_ballots(d, configs)
        out.append(best.select(F.lit(ctype or DEFAULT).alias("type"), "config", "macro_f1"))
    return reduce(lambda a, b: a.unionByName(b), out)


# ---------------------------------------------------------------------------
# phased analysis
@dataclass
class Ensemble:
    """The chosen sub-models of a phase and type, and their vote; with
    ``only_policy``, the answer of a type that needs no model."""

    models: list[tuple]
    mode: str = "std"
    default: int | None = None
    only_policy: str | None = None


@dataclass
class PhaseModels:
    """``beta`` and ``gamma`` by type; the key ``default`` serves the rest."""

    types: list[str]
    alpha: Ensemble
    beta: dict[str, Ensemble]
    gamma: dict[str, Ensemble]


def _ballots(ensemble: Ensemble, clauses: DataFrame) -> DataFrame:
    parts = [L.predict_ballots(model, clauses, cfg).withColumn("pos", F.lit(i + 1)) for i, (cfg, model) in enumerate(ensemble.models)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def title_ballot(clauses: DataFrame, types: list[str]) -> DataFrame:
    """The title keyword ballot in the codes of alpha, at position 0."""
    t = R.title_type_token(F.col("title"))
    code = F.array_position(F.array(*[F.lit(x) for x in types]), t["type"]) - 1
    b = clauses.select("id", code.cast("int").alias("y"))
    return b.where(F.col("y") >= 0).select("id", "y", F.lit(0).alias("model_no"), F.lit(0).alias("pos"))


def phase_alpha(pm: PhaseModels, clauses: DataFrame) -> DataFrame:
    """``(id, type)``; null if no ballot wins."""
    ballots = _ballots(pm.alpha, clauses).unionByName(title_ballot(clauses, pm.types))
    v = L.ensemble_vote(ballots, mode="std", priority="first")
    names = F.element_at(F.array(*[F.lit(x) for x in pm.types]), F.greatest(F.col("y"), F.lit(0)) + 1)
    return v.select("id", F.when(F.col("y") >= 0, names).alias("type"))


def _by_type(ensembles: dict[str, Ensemble], clauses: DataFrame, type_col: str) -> list[tuple[Ensemble, DataFrame]]:
    """Each ensemble with the clauses it answers for."""
    named = [k for k in ensembles if k != DEFAULT]
    known = F.coalesce(F.col(type_col).isin(*named), F.lit(False))
    parts = [(ensembles[k], clauses.where(F.col(type_col) == k)) for k in named]
    return [*parts, (ensembles[DEFAULT], clauses.where(~known))]


def phase_beta(pm: PhaseModels, clauses: DataFrame, type_col: str = "type") -> DataFrame:
    """C10 on (id, text, type): ``(id, anomalous)``, true iff the vote is 1."""
    parts = [L.ensemble_vote(_ballots(e, rows), mode=e.mode, default=e.default, priority="first") for e, rows in _by_type(pm.beta, clauses, type_col)]
    return reduce(lambda a, b: a.unionByName(b), parts).select("id", (F.col("y") == 1).alias("anomalous"))


def phase_gamma(pm: PhaseModels, clauses: DataFrame, type_col: str = "type") -> DataFrame:
    """C11 on (id, text, type): ``(id, anomaly)``, the violated policies by the
    ``not`` vote (default 0), best first."""
    names = F.element_at(F.array(*[F.lit(x) for x in R.POLICY_CLASSES]), F.col("value") + 1)
    out = []
    for e, rows in _by_type(pm.gamma, clauses, type_col):
        if e.only_policy:
            out.append(rows.select("id", F.array(F.lit(e.only_policy)).alias("anomaly")))
            continue
        ballots = _ballots(e, rows).where(F.col("y").isNotNull())
        ful = V.elect(ballots, ["id"], "y", ["pos"], mode="not", default=0, priority="first", level="ful")
        named = ful.where(F.col("value") > 0).select("id", "rank", names.alias("policy"))
        out.append(named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "policy"))), lambda x: x["policy"]).alias("anomaly")))
    none = F.array().cast("array<string>")
    found = reduce(lambda a, b: a.unionByName(b), out)
    return clauses.select("id").join(found, "id", "left").select("id", F.coalesce("anomaly", none).alias("anomaly"))


def cut(rows: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder: a phase's answers are read
    once for each type of the next, not worked out again."""
    from clausefold.session import written_table
    return written_table(rows, "phase")


def phase_beta_gamma(pm: PhaseModels, clauses: DataFrame, type_col: str = "type") -> DataFrame:
    """C12, the slice beta + gamma: ``(id, anomalous, anomaly)``; gamma only
    runs on the clauses that beta finds anomalous, the others have none."""
    flagged = cut(clauses.join(phase_beta(pm, clauses, type_col), "id"))
    g = phase_gamma(pm, flagged.where("anomalous"), type_col)
    return flagged.select("id", "anomalous").join(g, "id", "left")


def analyze(pm: PhaseModels, clauses: DataFrame) -> DataFrame:
    """C12 in full on (id, title, text): ``(id, type, anomalous, anomaly)``."""
    # cleaned once for the models of all phases
    if L.CLEAN not in clauses.columns:
        clauses = cut(L.cleaned(clauses))
    clauses = clauses.select("id", "title", L.CLEAN)
    typed = cut(clauses.join(phase_alpha(pm, clauses), "id"))
    return typed.select("id", "type").join(phase_beta_gamma(pm, typed), "id")


def answer(pm: PhaseModels, requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """C18 with models, dynamic kind: each valid request (id, title, text,
    domain, type, anomalous) runs the phases that its route asks for (P11)."""
    from clausefold.operators import requests as RQ
    rows = RQ.routed(requests).withColumnRenamed(id_col, "id")
    # the requests are read by each route, and their texts by each model
    given = cut(L.cleaned(rows.select("id", "title", "text", "type", "route")))
    text = F.coalesce("type", F.lit(NONE))
    full = analyze(pm, given.where("route = 'full'").select("id", "title", "text", L.CLEAN)).withColumn("type", text)
    bg_rows = given.where("route = 'beta_gamma'")
    bg = phase_beta_gamma(pm, bg_rows).join(bg_rows.select("id", "type"), "id")
    g_rows = given.where("route = 'gamma'")
    g = phase_gamma(pm, g_rows).join(g_rows.select("id", "type"), "id").withColumn("anomalous", F.lit(True))
    none = given.where("route = 'none'").select("id", "type", F.lit(False).alias("anomalous"), F.lit(None).cast("array<string>").alias("anomaly"))
    answers = full.unionByName(bg).unionByName(g).unionByName(none)
    return answers.join(given.select("id", "title", "route"), "id").select(
        F.col("id").alias(id_col), "title", "route", "type", F.initcap(F.col("anomalous").cast("string")).alias("anomalous"), "anomaly")


def answer_alpha(pm: PhaseModels, requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """C18, alpha-only kind: ``(id, title, type)``."""
    from clausefold.operators import requests as RQ
    valid, _ = RQ.validate(requests, RQ.FULL_FIELDS)
    rows = valid.select(F.col(id_col).alias("id"), "title", "text")
    return rows.select("id", "title").join(phase_alpha(pm, rows), "id").select(
        F.col("id").alias(id_col), "title", F.coalesce("type", F.lit(NONE)).alias("type"))


def train_phases(train: DataFrame, types: list[str] | None = None, classifier: str = "svm", transformer: str = "tfidf") -> PhaseModels:
    """Fit an analysis from labelled clauses ``(id, title, text, type,
    policy)``: for each phase and type the plain clause model, for alpha also
    the sentence model, and the ``default`` ensembles.  A type without a
    training clause leaves its phase to the default."""
    types = types or types_of_rules()
    # cleaned once for all models
    if L.CLEAN not in train.columns:
        train = cut(L.cleaned(train))
    train = train.select("id", "text", "type", "policy", L.CLEAN)
    # types that have clauses at all, a handful of names
    seen = {r["type"] for r in train.where(F.col("type").isin(*types)).select("type").distinct().collect()}

    asked: list[Member] = []

    def one(target: str, ctype: str | None = None, policies: tuple[str, ...] = (), granularity: int = 0):
        asked.append(Member(target, granularity, transformer, only_type=ctype, only_policies=policies))
        return asked[-1]

    every = tuple(p for p in R.POLICY_CLASSES if p != NONE)
    beta = {DEFAULT: Ensemble([one("anomalous")])} | {t: Ensemble([one("anomalous", t)]) for t in types if t in seen}
    gamma = {DEFAULT: Ensemble([one("policy", None, every)], "not", 0)}
    for t in types:
        policies = policies_of(t)
        if len(policies) == 1:
            gamma[t] = Ensemble([], only_policy=policies[0])
        elif t in seen and policies:
            gamma[t] = Ensemble([one("policy", t, tuple(policies))], "not", 0)
    alpha = Ensemble([one("type"), one("type", granularity=1)])
    if classifier == "words":
        fitted = fit_words(train, asked, types)
    else:
        fitted = [fit_member(train, m, types, classifier=classifier) for m in asked]
    made = {m.key: x for m, x in zip(asked, fitted, strict=True)}
    for e in [alpha, *beta.values(), *gamma.values()]:
        e.models = [made[m.key] for m in e.models]
    return PhaseModels(types, alpha, beta, gamma)


def rule_labels(clauses: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels for training from the rule analysis (C13): ``(id, title, text,
    type, invalid, policy)`` with the first violated policy (``None`` if the
    clause is valid)."""
    a = R.analyze_clauses(clauses, id_col, "title", "text", keep_cols=["title", "text"])
    return a.select(F.col(id_col).alias("id"), "title", "text", "type", (~F.col("valid")).alias("invalid"),
                    F.coalesce(F.try_element_at(F.col("policies"), F.lit(1)), F.lit(NONE)).alias("policy"))


# ---------------------------------------------------------------------------
# C14: evaluation of all phases on a test set
def evaluate_phases(answers: DataFrame, truth: DataFrame, types: list[str], policies: list[str]) -> DataFrame:
    """Reports ``(report, label, precision, recall, f1, support)`` of answers
    ``(id, type, anomalous, anomaly)`` against ``(id, type, policy)``: the
    type, validity (1 = the policy is one of ``policies``), and the policy, by
    the first answer and by the best (A20)."""
    t = truth.select("id", M.label_to_val("type", types).alias("e_type"), F.col("policy").isin(*policies).cast("int").alias("e_valid"),
                     M.label_to_val("policy", policies).alias("e_policy"))
    codes = F.coalesce(F.transform("anomaly", lambda p: M.label_to_val(p, policies)), F.array().cast("array<int>"))
    codes = F.when(F.size(codes) == 0, F.array(F.lit(-1))).otherwise(codes)
    a = answers.select("id", F.coalesce(M.label_to_val("type", types), F.lit(-1)).alias("p_type"),
                       F.col("anomalous").cast("boolean").cast("int").alias("p_valid"), codes.alias("codes"))
    j = t.join(a, "id")
    j = j.withColumn("p_first", F.col("codes")[0]).withColumn("p_best", M.best_or_first("e_policy", "codes"))
    pairs = (("type", "e_type", "p_type"), ("validity", "e_valid", "p_valid"), ("policy_first", "e_policy", "p_first"), ("policy_best", "e_policy", "p_best"))
    cells = explode_rows(j, [], F.array(*[F.struct(F.lit(n).alias("report"), F.col(e).alias("expected"), F.col(p).alias("predicted")) for n, e, p in pairs]), "c")
    conf = M.confusion(cells.select("c.*"), "expected", "predicted", ["report"])
    return M.grouped_report(conf, ["report"])


# ---------------------------------------------------------------------------
# A trained analysis as a registry of artefacts
def save_phases(spark: SparkSession, pm: PhaseModels, folder: str) -> DataFrame:
    """Write every sub-model below ``folder`` and the registry table that
    ``load_phases`` reads; returns the registry."""
    rows = []
    parts = [("alpha", DEFAULT, pm.alpha), *(("beta", t, e) for t, e in pm.beta.items()), *(("gamma", t, e) for t, e in pm.gamma.items())]
    for phase, ctype, e in parts:
        for i, (cfg, model) in enumerate(e.models):
            path = f"{folder}/{phase}/{ctype}/model{i + 1}"
            L.save_model(model, path)
            rows.append((phase, ctype, i + 1, path, cfg.granularity, e.mode, e.default, None, cfg.classes, cfg.vote_mode, cfg.vote_default))
        if e.only_policy:
            rows.append((phase, ctype, 0, None, 0, e.mode, e.default, e.only_policy, [], "std", None))
    registry = spark.createDataFrame([(*r, pm.types) for r in rows], L.REGISTRY)
    registry.write.mode("overwrite").parquet(f"{folder}/registry")
    return spark.read.schema(L.REGISTRY).parquet(f"{folder}/registry")


def load_phases(spark: SparkSession, folder: str) -> PhaseModels:
    """The analysis that ``save_phases`` wrote; the registry has one row a
    sub-model."""
    rows = spark.read.schema(L.REGISTRY).parquet(f"{folder}/registry").orderBy("phase", "type", "model_no").collect()
    out: dict[tuple[str, str], Ensemble] = {}
    for r in rows:
        e = out.setdefault((r["phase"], r["type"]), Ensemble([], r["vote_mode"], r["vote_default"], r["only_policy"]))
        if r["path"]:
            cfg = L.SubModel(r["model_no"], list(r["classes"]), granularity=r["granularity"], vote_mode=r["sentence_mode"], vote_default=r["sentence_default"])
            e.models.append((cfg, L.load_model(spark, r["path"])))
    return PhaseModels(list(rows[0]["types"]), out["alpha", DEFAULT], {t: e for (p, t), e in out.items() if p == "beta"},
                       {t: e for (p, t), e in out.items() if p == "gamma"})

