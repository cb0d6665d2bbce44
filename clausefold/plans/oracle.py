"""Oracle SQL (DuckDB) for the driver queries in ``catalog``.

Each string runs on DuckDB with the given tables registered as views and
must return the same columns (names and values) as the Spark query.
"""

from __future__ import annotations

from clausefold.plans import corpora as C
from clausefold.plans import sqlfrag as X
from clausefold.plans.sqlfrag import q

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------
# Derived views as CTE text
CONV_SENT = f"""conv_sent AS (
  SELECT {X.zfill('conv_id', 6)} || '_' || {X.zfill('turn', 3)} AS id,
         {X.zfill('conv_id', 6)} AS pid, turn, role,
         CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS size, text
  FROM conversations)"""
CONV_CLAUSE = f"""conv_clause AS (
  SELECT {X.zfill('conv_id', 6)} AS id, arg_min(role, turn) AS first_role,
         CASE WHEN count(*) >= 4 THEN 'long' ELSE 'short' END AS band
  FROM conversations GROUP BY conv_id)"""
DOC_LABELS = """doc_labels AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang, d.source,
         CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _french_99() -> list[str]:
    """French names of 0 to 99, written for the check alone."""
    ones = ["", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize",
            "quatorze", "quinze", "seize", "dix-sept", "dix-huit", "dix-neuf"]
    out = ["zéro", *ones[1:]]
    for base, start, stop in (("vingt", 20, 30), ("trente", 30, 40), ("quarante", 40, 50), ("cinquante", 50, 60), ("soixante", 60, 80)):
        out += [base if n == start else f"{base} et {ones[n - start]}" if (n - start) in (1, 11) else f"{base}-{ones[n - start]}" for n in range(start, stop)]
    return out + ["quatre-vingts", *[f"quatre-vingt-{ones[n]}" for n in range(1, 20)]]


# the quantity in words, and as X6 reads it: a lone "un" stays a word
_WORDS = "[" + ", ".join(q(w) for w in _french_99()) + "][CAST(l_quantity AS INTEGER) % 100 + 1]"
_READ = "(CASE WHEN CAST(l_quantity AS INTEGER) % 100 = 1 THEN 'un' ELSE CAST(CAST(l_quantity AS INTEGER) % 100 AS VARCHAR) END)"


def _template_sql(tpl: str, words: str = _WORDS) -> str:
    out, rest = [], tpl
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(q(rest))
            break
        if i > 0:
            out.append(q(rest[:i]))
        out.append({"q": "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)", "w": words,
                    "n": "CAST(l_linenumber AS VARCHAR)",
                    "p": "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)"}[rest[i + 1]])
        rest = rest[i + 3:]
    return " || ".join(out)


def _sent_case(words: str) -> str:
    return "CASE " + " ".join(
        f"WHEN l_returnflag = {q(rf)} AND l_linestatus = {q(ls)} THEN {_template_sql(t, words)}"
        for rf, ls, t in C.SENTENCE_TEMPLATES) + " END"



_TITLE_CASE = "(CASE " + " ".join(f"WHEN o_orderpriority = {q(p)} THEN {q(t)}" for p, t in C.CLAUSE_TITLES) + " END)"
TITLE = f"(CASE WHEN o_orderstatus = 'P' THEN {_TITLE_CASE} || {q(C.PENDING_TITLE_SUFFIX)} ELSE {_TITLE_CASE} END)"

CONTRACT_SENT = f"""contract_sent AS (
  SELECT l_orderkey AS clause_id, l_linenumber AS n, {_sent_case(_WORDS)} AS text, {_sent_case(_READ)} AS dtext FROM lineitem)"""
CONTRACT_BODY = """contract_body AS (
  SELECT clause_id, string_agg(text, ' ' ORDER BY n, text) AS text, string_agg(dtext, ' ' ORDER BY n, text) AS dtext
  FROM contract_sent GROUP BY clause_id)"""
CONTRACT_CLAUSE = f"""contract_clause AS (
  SELECT b.clause_id, o.o_custkey AS contract_id, {TITLE} AS title, b.text, b.dtext
  FROM orders o JOIN contract_body b ON o.o_orderkey = b.clause_id)"""
CONTRACT = ",\n".join([CONTRACT_SENT, CONTRACT_BODY, CONTRACT_CLAUSE])


def sql(name):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


# ---------------------------------------------------------------------------
@sql("flagship")
def _():
    return f"""WITH {CONV_SENT}, {CONV_CLAUSE},
psel AS (SELECT id FROM conv_clause WHERE first_role IN ('user')),
csel AS (SELECT * FROM conv_sent WHERE role IN ('user', 'assistant') AND pid IN (SELECT id FROM psel)),
merged AS (SELECT pid AS id, string_agg(text || ' ', '' ORDER BY id) AS text FROM csel GROUP BY pid),
cand AS (SELECT pid, role, count(*) AS cnt, min(id) AS first_seen FROM csel GROUP BY pid, role),
ranked AS (SELECT pid, role, row_number() OVER (PARTITION BY pid ORDER BY cnt DESC, (role IS NULL) DESC, first_seen) AS rk FROM cand)
SELECT m.id, r.role AS majority_role, {X.clean('m.text')} AS text
FROM merged m JOIN ranked r ON r.pid = m.id AND r.rk = 1"""


@sql("label_filter")
def _():
    return f"""WITH {DOC_LABELS}
SELECT * FROM doc_labels WHERE lang IN ('fr', 'en', 'de') AND quality IN ('1') AND toxic IN ('0')"""


@sql("parent_semi_join")
def _():
    return f"""WITH {CONV_SENT}, {CONV_CLAUSE}
SELECT id, role, size FROM conv_sent
WHERE role IN ('user', 'assistant') AND pid IN (SELECT id FROM conv_clause WHERE first_role IN ('user'))"""


@sql("orphans")
def _():
    return """SELECT CAST(doc_id AS VARCHAR) AS id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


@sql("merge_granules")
def _():
    return f"""WITH {CONV_SENT}
SELECT pid AS id, string_agg(text || ' ', '' ORDER BY id) AS text FROM conv_sent GROUP BY pid"""


@sql("propagate_labels")
def _():
    return f"""WITH {CONV_SENT}, {CONV_CLAUSE}
SELECT s.id, c.first_role FROM conv_sent s JOIN conv_clause c ON s.pid = c.id WHERE c.band = 'long'"""


@sql("clean_text")
def _():
    return f"""SELECT doc_id, md5({X.clean('text')}) AS clean_md5, CAST(length({X.clean('text')}) AS INTEGER) AS clean_len FROM documents"""


@sql("word_filter")
def _():
    w = X.filter_words(X.ws_split("text"), 3, True)
    return f"""SELECT doc_id, CAST(len({w}) AS INTEGER) AS n_words, md5(array_to_string({w}, ' ')) AS kept_md5 FROM documents"""


@sql("sentences")
def _():
    return f"""WITH s AS (SELECT doc_id, {X.split_sentences(X.clean('text'))} AS arr FROM documents)
SELECT doc_id, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos, unnest(arr) AS sentence FROM s"""


@sql("rule_sentences")
def _():
    return f"""WITH {CONTRACT},
s AS (SELECT clause_id, list_transform({X.rule_sentence_bodies(X.clean('text'))}, lambda x: x || '.') AS arr FROM contract_clause)
SELECT clause_id, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos, unnest(arr) AS sentence FROM s"""


@sql("char_grams")
def _():
    return f"""WITH g AS (SELECT doc_id, unnest({X.char_wb_grams(X.clean('text'))}) AS gram FROM documents)
SELECT gram, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM g GROUP BY gram"""


@sql("value_units")
def _():
    return f"""WITH {CONTRACT_SENT},
s AS (SELECT clause_id, n, {X.value_units(X.clean('text'))} AS arr FROM contract_sent),
u AS (SELECT clause_id, n, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos, unnest(arr) AS vu FROM s)
SELECT clause_id, n, pos, vu.value AS value, vu.unit AS unit FROM u"""


@sql("durations")
def _():
    return f"""WITH {CONTRACT_SENT},
s AS (SELECT clause_id, n, {X.durations_days(X.clean('text'))} AS arr FROM contract_sent)
SELECT clause_id, n, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos, unnest(arr) AS days FROM s"""


@sql("durations_documents")
def _():
    return f"""WITH {CONTRACT},
s AS (SELECT clause_id, {X.durations_days(X.clean('dtext'))} AS arr FROM contract_clause)
SELECT clause_id, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos, unnest(arr) AS days FROM s"""


# ---------------------------------------------------------------------------
# votes
def _vote_sql(mode: str, default, priority, level: str, weight: str | None = None) -> str:
    d = "NULL" if default is None else q(default)
    if mode == "std":
        cand = """SELECT user_id, event_type AS value, count(*) AS cnt, CAST(count(*) AS DOUBLE) AS pcount,
  min((ts, event_id)) AS first_seen FROM events GROUP BY user_id, event_type"""
    elif mode == "ato":
        cand = f"""SELECT user_id, event_type AS value, count(*) AS cnt, CAST(count(*) AS DOUBLE) AS pcount,
  min((ts, event_id)) AS first_seen FROM events WHERE event_type IS NOT DISTINCT FROM {d} GROUP BY user_id, event_type"""
    elif mode == "pnd":
        if weight:
            wexpr = f"CAST({weight} AS DOUBLE)"
            src = "events"
        else:
            wexpr = "CAST(n - pos + 1 AS DOUBLE)" if priority == "first" else "CAST(pos AS DOUBLE)"
            src = """(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
                      count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
        cand = f"""SELECT user_id, event_type AS value, count(*) AS cnt, sum({wexpr}) AS pcount,
  min((ts, event_id)) AS first_seen FROM {src} GROUP BY user_id, event_type"""
    else:  # not
        cand = f"""SELECT user_id, event_type AS value, count(*) AS cnt, CAST(count(*) AS DOUBLE) AS pcount,
  min((ts, event_id)) AS first_seen FROM events WHERE event_type IS DISTINCT FROM {d} GROUP BY user_id, event_type
UNION ALL
SELECT user_id, {d} AS value, count(*) FILTER (WHERE event_type IS NOT DISTINCT FROM {d}) AS cnt,
  CAST(count(*) FILTER (WHERE event_type IS NOT DISTINCT FROM {d}) AS DOUBLE) AS pcount, min((ts, event_id)) AS first_seen
FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IS DISTINCT FROM {d}) = 0"""
    if priority == "last":
        order = "pcount DESC, cnt DESC, first_seen DESC"
    else:
        order = f"pcount DESC, cnt DESC, (value IS NOT DISTINCT FROM {d}) DESC, first_seen ASC"
    ranked = f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS INTEGER) AS rank FROM cand)"""
    head = f"WITH cand AS ({cand}), {ranked}\n"
    if level == "ful":
        return head + "SELECT user_id, rank, value, pcount FROM ranked"
    if level == "ele":
        return head + """SELECT user_id, value, pcount FROM
  (SELECT *, max(pcount) OVER (PARTITION BY user_id) AS top FROM ranked) WHERE pcount >= top"""
    return head + """SELECT g.user_id, r.value AS winner FROM (SELECT DISTINCT user_id FROM events) g
  LEFT JOIN ranked r ON r.user_id = g.user_id AND r.rank = 1"""


SQL["vote_std"] = _vote_sql("std", "view", None, "min")
SQL["vote_ato"] = _vote_sql("ato", "error", None, "min")
SQL["vote_pnd_first"] = _vote_sql("pnd", "click", "first", "ful")
SQL["vote_pnd_last"] = _vote_sql("pnd", "click", "last", "ful")
SQL["vote_pnd_weighted"] = _vote_sql("pnd", "click", None, "min", weight="value")
SQL["vote_not"] = _vote_sql("not", "view", "last", "min")
SQL["vote_ele"] = _vote_sql("std", "purchase", None, "ele")
SQL["vote_ful"] = _vote_sql("std", "purchase", None, "ful")


# ---------------------------------------------------------------------------
# Metrics and keyword sub-models on documents
from clausefold.operators import ensemble as E  # noqa: E402
from clausefold.operators import rules as R  # noqa: E402


def _lang_code(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {q(l)} THEN {i}" for i, l in enumerate(E.LANG_MAPPING)) + " ELSE -1 END)"


def _kw_predict(tokens: str, model: str) -> str:
    vocab = dict(E.KEYWORD_MODELS)[model]
    whens = " ".join(
        f"WHEN list_has_any({tokens}, [{', '.join(q(t) for t in terms)}]) THEN {E.LANG_MAPPING.index(n)}"
        for n, terms in vocab)
    return f"(CASE {whens} ELSE -1 END)"


def _kw_all(tokens: str, model: str) -> str:
    vocab = dict(E.KEYWORD_MODELS)[model]
    items = ", ".join(f"CASE WHEN list_has_any({tokens}, [{', '.join(q(t) for t in terms)}]) THEN {q(n)} END"
                      for n, terms in vocab)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


DOCS_CLEAN = f"""dc AS (SELECT doc_id, source, lang, {X.ws_split(X.clean('text'))} AS tok FROM documents)"""
KW1 = f"""{DOCS_CLEAN},
preds AS (SELECT doc_id, source, {_lang_code('lang')} AS expected, {_kw_predict('tok', 'kw1')} AS predicted FROM dc),
conf AS (SELECT expected, predicted, count(*) AS cnt FROM preds GROUP BY expected, predicted)"""


def _per_label(conf: str, groups: list[str]) -> str:
    g = "".join(f"{c}, " for c in groups)
    return f"""(SELECT {g}label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
    CAST(tp + fn AS BIGINT) AS support,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM (SELECT {g}label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
      SELECT {g}expected AS label, CASE WHEN expected = predicted THEN cnt ELSE 0 END AS tp, 0 AS fp,
             CASE WHEN expected = predicted THEN 0 ELSE cnt END AS fn FROM {conf}
      UNION ALL
      SELECT {g}predicted AS label, 0 AS tp, cnt AS fp, 0 AS fn FROM {conf} WHERE expected <> predicted)
    GROUP BY {g}label))"""


def _macro(pl: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    sel = f"{g}, " if groups else ""
    grp = f" GROUP BY {g}" if groups else ""
    return f"""SELECT {sel}sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision,
  avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1
FROM {pl} pl{grp}"""


SQL["label_codes_binary"] = "SELECT doc_id, CASE WHEN lang = 'en' THEN -1 ELSE 1 END AS code FROM documents"
SQL["label_codes_ref"] = "SELECT doc_id, CASE WHEN lang = 'fr' THEN 1 WHEN lang = 'de' THEN 2 ELSE -1 END AS code FROM documents"
SQL["label_codes_index"] = f"SELECT doc_id, {_lang_code('lang')} AS code FROM documents"
SQL["inverse_codes"] = f"""WITH {KW1},
maps AS (
  SELECT 1 AS model_no, name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source AS name FROM documents)
  UNION ALL
  SELECT 2 AS model_no, name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang AS name FROM documents))
SELECT p.doc_id, p.predicted, arg_max(m.name, m.model_no * 1000000 + m.code) AS name
FROM preds p LEFT JOIN maps m ON m.code = p.predicted AND p.predicted <> -1
GROUP BY p.doc_id, p.predicted"""
SQL["class_ratio"] = """SELECT lang AS label, count(*) AS cnt, max(count(*)) OVER () / count(*) AS ratio FROM documents GROUP BY lang"""
SQL["confusion"] = f"WITH {KW1} SELECT * FROM conf"
SQL["macro_f1"] = f"WITH {KW1} " + _macro(_per_label("conf", []), [])
SQL["class_report"] = f"""WITH {KW1}, pl AS {_per_label('conf', [])}
SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM pl
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pl
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pl
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pl"""
SQL["melt_metric"] = f"""WITH rep AS ({SQL['class_report']})
SELECT label, 'precision' AS metric, precision AS value FROM rep
UNION ALL SELECT label, 'recall', recall FROM rep
UNION ALL SELECT label, 'f1', f1 FROM rep
UNION ALL SELECT label, 'support', CAST(support AS DOUBLE) FROM rep"""

_MODEL_PREDS = " UNION ALL ".join(
    f"SELECT doc_id, source, {_lang_code('lang')} AS expected, {i + 1} AS cfg_no, {q(m)} AS model, {_kw_predict('tok', m)} AS y FROM dc"
    for i, (m, _) in enumerate(E.KEYWORD_MODELS))
MODEL_SCORES = f"""{DOCS_CLEAN},
mp AS ({_MODEL_PREDS}),
mconf AS (SELECT source, cfg_no, model, expected, y AS predicted, count(*) AS cnt FROM mp GROUP BY ALL),
scores AS ({_macro(_per_label('mconf', ['source', 'cfg_no', 'model']), ['source', 'cfg_no', 'model'])})"""
SQL["best_config"] = f"""WITH {MODEL_SCORES}
SELECT source, cfg_no, model, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(macro_f1, 12) DESC, cfg_no) AS rk FROM scores) WHERE rk = 1"""
SQL["pivot_metric"] = f"""WITH {MODEL_SCORES}
SELECT source, {', '.join(f"max(macro_f1) FILTER (WHERE model = {q(m)}) AS {m}" for m, _ in E.KEYWORD_MODELS)}
FROM scores GROUP BY source"""
SQL["best_or_first"] = f"""WITH {DOCS_CLEAN}, f AS (SELECT doc_id, lang, {_kw_all('tok', 'kw1')} AS found FROM dc)
SELECT doc_id, lang AS expected, CASE WHEN list_contains(found, lang) THEN lang ELSE found[1] END AS chosen FROM f"""

_members = ", ".join(f"({e}, {q(m)}, {p})" for e, m, p in E.ensembles())
_doc_preds = " UNION ALL ".join(f"SELECT id, '{m}_g0' AS model, {_kw_predict('tok', m)} AS y FROM d" for m, _ in E.KEYWORD_MODELS)
_sent_preds = " UNION ALL ".join(
    f"SELECT id, sno, '{m}_g1' AS model, {_kw_predict(X.ws_split('s'), m)} AS y FROM sents" for m, _ in E.KEYWORD_MODELS)
SQL["ensemble_search"] = f"""WITH d AS (SELECT doc_id AS id, source, lang, {X.clean('text')} AS clean,
    {X.ws_split(X.clean('text'))} AS tok FROM documents),
sa AS (SELECT id, {X.split_sentences('clean')} AS arr FROM d),
sents AS (SELECT id, unnest(range(0, len(arr))) AS sno, unnest(arr) AS s FROM sa),
sent_preds AS ({_sent_preds}),
sent_cand AS (SELECT id, model, y, count(*) AS cnt, min(sno) AS first_seen FROM sent_preds GROUP BY ALL),
sent_vote AS (SELECT id, model, y FROM (SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY cnt DESC, first_seen) AS rk FROM sent_cand) WHERE rk = 1),
preds AS ({_doc_preds} UNION ALL SELECT * FROM sent_vote),
members(ensemble_no, model, pos) AS (VALUES {_members}),
j AS (SELECT p.id, m.ensemble_no, p.y, m.pos FROM preds p JOIN members m ON p.model = m.model),
ens_cand AS (SELECT id, ensemble_no, y, count(*) AS cnt, min(pos) AS first_seen FROM j GROUP BY ALL),
ans AS (SELECT id, ensemble_no, y FROM (SELECT *, row_number() OVER (PARTITION BY id, ensemble_no ORDER BY cnt DESC, first_seen) AS rk FROM ens_cand) WHERE rk = 1),
truth AS (SELECT id, source, {_lang_code('lang')} AS expected FROM d),
econf AS (SELECT t.source, a.ensemble_no, t.expected, a.y AS predicted, count(*) AS cnt FROM ans a JOIN truth t ON a.id = t.id GROUP BY ALL),
scores AS ({_macro(_per_label('econf', ['source', 'ensemble_no']), ['source', 'ensemble_no'])})
SELECT source, ensemble_no, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(macro_f1, 12) DESC, ensemble_no) AS rk FROM scores) WHERE rk = 1"""


# ---------------------------------------------------------------------------
# Concepts, typing and policies on contract clauses
def _concepts(x: str, vocab=X.CONCEPT_TERMS) -> str:
    items = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + f" THEN {q(n)} END"
        for n, terms in vocab)
    return f"list_filter([{items}], lambda c: c IS NOT NULL)"


_ALL_NAMES = "[" + ", ".join(q(n) for n, _ in X.CONCEPT_TERMS) + "]"
BODY = f"replace({X.clean('text')}, ',', '')"
SQL["concept_in"] = f"""WITH {CONTRACT}, b AS (SELECT clause_id, {BODY} AS body FROM contract_clause)
SELECT clause_id, unnest({_concepts('lower(body)')}) AS concept FROM b"""
SQL["concept_not_in"] = f"""WITH {CONTRACT}, b AS (SELECT clause_id, {_concepts('lower(' + BODY + ')')} AS found FROM contract_clause)
SELECT clause_id, unnest(list_filter({_ALL_NAMES}, lambda n: NOT list_contains(found, n))) AS concept FROM b"""

_tt = dict(X.TYPE_TERMS)
_tok_whens = [(n, i) for i, n in enumerate(R.TYPE_CLASSES) if n in _tt]
_TT_TYPE = "(CASE " + " ".join(
    f"WHEN list_has_any(tok, [{', '.join(q(t) for t in _tt[n])}]) THEN {q(n)}" for n, i in _tok_whens) + " END)"
_TT_CODE = "(CASE " + " ".join(
    f"WHEN list_has_any(tok, [{', '.join(q(t) for t in _tt[n])}]) THEN {i}" for n, i in _tok_whens) + " END)"
SQL["title_type_token"] = f"""WITH {CONTRACT}, t AS (SELECT clause_id, {X.ws_split('title')} AS tok FROM contract_clause)
SELECT clause_id, {_TT_TYPE} AS type, {_TT_CODE} AS code FROM t"""
SQL["title_type_contains"] = f"""WITH {CONTRACT}, t AS (SELECT clause_id, {X.clean('title')} AS t FROM contract_clause)
SELECT clause_id, unnest({_concepts('t', X.TYPE_TERMS)}) AS type FROM t"""


def _arr(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


_rules_values = X.RULE_ROWS
_SENT_HIT = ("((r.dur_op IS NULL OR (r.dur_op = '<' AND len(list_filter(s.durs, lambda d: d < r.dur_days)) > 0)"
             " OR (r.dur_op = '>' AND len(list_filter(s.durs, lambda d: d > r.dur_days)) > 0))"
             " AND list_has_all(s.concepts, r.sent_need))")
ANALYSIS = f"""{CONTRACT},
a AS (SELECT clause_id, {X.clean('title')} AS t, replace({X.clean('dtext')}, ',', '') AS body FROM contract_clause),
b AS (SELECT clause_id, {_concepts('t', X.TYPE_TERMS)} AS cands, {_concepts('lower(body)')} AS concepts,
        list_transform(string_split(body, '.'), lambda s: {{'text': s || '.', 'durs': {X.durations_days('s')},
          'concepts': {_concepts('lower(s)')}}}) AS sents FROM a),
rules(idx, policy, type, clause_need, clause_forbid, sent_need, dur_op, dur_days, scope) AS (VALUES {_rules_values}),
fired AS (SELECT b.clause_id, r.* FROM b, rules r
  WHERE list_contains(b.cands, r.type) AND list_has_all(b.concepts, r.clause_need)
    AND NOT list_has_any(b.concepts, r.clause_forbid)
    AND (r.scope = 'clause' OR len(list_filter(b.sents, lambda s: {_SENT_HIT})) > 0)),
pol AS (SELECT clause_id, string_agg(policy, ',' ORDER BY first_idx) AS policies FROM
  (SELECT clause_id, policy, min(idx) AS first_idx FROM fired GROUP BY ALL) GROUP BY clause_id),
sx AS (SELECT clause_id, unnest(range(0, len(sents))) AS sidx, unnest(sents) AS s FROM b),
notable AS (SELECT DISTINCT sx.clause_id, sx.sidx, sx.s.text AS text FROM sx JOIN fired r ON r.clause_id = sx.clause_id
  WHERE r.scope = 'sentence' AND {_SENT_HIT})"""
SQL["policy_all"] = f"""WITH {ANALYSIS}
SELECT b.clause_id, list_min(b.cands) AS type, pol.policies IS NULL AS valid, coalesce(pol.policies, '') AS policies,
  CAST((SELECT count(*) FROM notable n WHERE n.clause_id = b.clause_id) AS INTEGER) AS n_notable
FROM b LEFT JOIN pol ON pol.clause_id = b.clause_id"""
SQL["notable_sentences"] = f"""WITH {ANALYSIS}
SELECT clause_id, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY sidx) - 1 AS INTEGER) AS pos, text AS sentence FROM notable"""
for _pid in R.POLICIES:
    SQL[f"policy_{_pid}"] = f"""WITH {ANALYSIS}
SELECT DISTINCT b.clause_id, list_min(b.cands) AS type FROM b JOIN fired f ON f.clause_id = b.clause_id WHERE f.policy = {q(_pid)}"""


# ---------------------------------------------------------------------------
# Documents
SQL["char_offsets"] = f"""WITH {CONTRACT_SENT}
SELECT clause_id, n, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY clause_id ORDER BY n, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS offset FROM contract_sent"""
SQL["prefix_run"] = f"""WITH {CONTRACT_SENT}
SELECT clause_id, n, text FROM (SELECT *, dense_rank() OVER (PARTITION BY clause_id ORDER BY n) AS dr FROM contract_sent) WHERE n = dr"""
NESTED = f"""{CONTRACT},
off AS (SELECT clause_id, n, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY clause_id ORDER BY n, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS position FROM contract_sent
  WHERE text IS NOT NULL AND text <> ''),
sp AS (SELECT *, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY n, text, position) - 1 AS INTEGER) AS sentence_pos FROM off),
cp AS (SELECT o_orderkey AS clause_id, CAST(o_custkey AS VARCHAR) AS contract, {TITLE} AS title,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS clause_pos FROM orders)"""
SQL["contract_nest"] = f"""WITH {NESTED}
SELECT cp.contract, 0 AS instance, cp.clause_pos, cp.title, sp.sentence_pos, sp.position, sp.text
FROM cp LEFT JOIN sp ON sp.clause_id = cp.clause_id"""
SQL["contract_summary"] = f"""WITH {NESTED}
SELECT cp.contract AS title, count(DISTINCT cp.clause_id) AS n_clauses, count(sp.text) AS n_sentences
FROM cp LEFT JOIN sp ON sp.clause_id = cp.clause_id GROUP BY cp.contract"""
SQL["acquired_documents"] = f"""SELECT {X.zfill('conv_id', 6)} AS parentDocument, '1' AS level,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx,
  {X.zfill('conv_id', 6)} || '_' || {X.zfill('turn', 3)} AS _id, CAST(turn AS INTEGER) AS position, role
FROM conversations"""

# ---------------------------------------------------------------------------
# Requests
_TYPES5 = "['resiliation', 'paiement', 'non_sollicitation', 'non_concurrence', 'indemnisation']"
REQUESTS = f"""{CONTRACT_SENT}, {CONTRACT_BODY},
requests AS (SELECT o.o_orderkey AS request_id, {TITLE} AS title, b.text, 'services' AS domain,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE {_TYPES5}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] END AS type,
  CASE WHEN o_orderstatus <> 'P' THEN '' WHEN o_totalprice < 50000 THEN 'True' WHEN o_totalprice < 100000 THEN '1'
       WHEN o_totalprice < 150000 THEN 'true' ELSE 'False' END AS anomalous
  FROM orders o LEFT JOIN contract_body b ON o.o_orderkey = b.clause_id)"""
_FIELDS = ["text", "title", "domain", "type", "anomalous"]
SQL["validate_requests"] = f"""WITH {REQUESTS}
SELECT request_id, concat_ws(',', {', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in _FIELDS)}) AS missing
FROM requests WHERE {' OR '.join(f'{f} IS NULL' for f in _FIELDS)}"""
SQL["route_requests"] = f"""WITH {REQUESTS}
SELECT request_id, CASE WHEN type = '' THEN 'full' WHEN anomalous = '' THEN 'beta_gamma'
  WHEN anomalous IN ('True', '1', 'true') THEN 'gamma' ELSE 'none' END AS route
FROM requests WHERE {' AND '.join(f'{f} IS NOT NULL' for f in _FIELDS)}"""
SQL["reasoning_answers"] = f"""WITH {ANALYSIS}
SELECT b.clause_id AS request_id, list_min(b.cands) AS type,
  CASE WHEN pol.policies IS NULL THEN 'False' ELSE 'True' END AS anomalous, coalesce(pol.policies, '') AS anomaly,
  CAST((SELECT count(*) FROM notable n WHERE n.clause_id = b.clause_id) AS INTEGER) AS n_sentences
FROM b LEFT JOIN pol ON pol.clause_id = b.clause_id"""

# a request that names its type is checked against that type only
_ANSWERS = ANALYSIS.replace("a AS (SELECT clause_id, ", "a AS (SELECT clause_id, given, ").replace(
    "FROM contract_clause),\nb AS (SELECT clause_id, ", "FROM asked),\nb AS (SELECT clause_id, given, ").replace(
    f"{_concepts('t', X.TYPE_TERMS)} AS cands", f"{_concepts('t', X.TYPE_TERMS)} AS found, CASE WHEN given <> '' THEN [given] ELSE {_concepts('t', X.TYPE_TERMS)} END AS cands")
_ANSWERS = _ANSWERS.replace(CONTRACT + ",", f"""{REQUESTS.replace("b.text, 'services'", "b.text, b.dtext, 'services'")},
routed AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in _FIELDS)}) AS missing,
  CASE WHEN type = '' THEN 'full' WHEN anomalous = '' THEN 'beta_gamma'
    WHEN anomalous IN ('True', '1', 'true') THEN 'gamma' ELSE 'none' END AS way FROM requests),
asked AS (SELECT request_id AS clause_id, title, dtext, type AS given FROM routed WHERE missing = '' AND way <> 'none'),""")
SQL["batch_scoring"] = f"""WITH {_ANSWERS}
SELECT r.request_id, CASE WHEN r.missing = '' THEN 'answered' ELSE 'quarantined' END AS status,
  CASE WHEN r.missing = '' THEN way END AS route,
  CASE WHEN r.missing <> '' THEN NULL WHEN way = 'full' THEN list_min(b.found) ELSE r.type END AS type,
  CASE WHEN r.missing <> '' THEN NULL WHEN way = 'gamma' THEN 'True' WHEN way = 'none' THEN 'False'
    WHEN pol.policies IS NULL THEN 'False' ELSE 'True' END AS anomalous,
  CASE WHEN r.missing = '' AND way <> 'none' THEN coalesce(pol.policies, '') END AS anomaly,
  CASE WHEN r.missing <> '' THEN r.missing END AS missing
FROM routed r LEFT JOIN b ON b.clause_id = r.request_id AND r.missing = '' AND way <> 'none' LEFT JOIN pol ON pol.clause_id = b.clause_id"""
SQL["stream_scoring"] = SQL["batch_scoring"]

# ---------------------------------------------------------------------------
# Features
CLEAN_DOCS = f"cd AS (SELECT doc_id, {X.clean('text')} AS text FROM documents)"
TFIDF = f"""{CLEAN_DOCS},
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM cd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + nd.n) / (1 + dfq.df)) + 1) AS raw FROM tf JOIN dfq ON tf.term = dfq.term, nd),
tfidf AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w)"""
SQL["tfidf"] = f"WITH {TFIDF} SELECT * FROM tfidf"
SQL["term_scores"] = f"WITH {TFIDF} SELECT term, sum(weight) AS score FROM tfidf GROUP BY term"
SQL["char_bag"] = f"""WITH {CLEAN_DOCS},
g AS (SELECT doc_id, unnest({X.char_wb_grams('text')}) AS gram FROM cd),
c AS (SELECT doc_id, gram, count(*) AS cnt FROM g GROUP BY ALL)
SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_grams, count(*) AS n_distinct, max(cnt) AS max_cnt FROM c GROUP BY doc_id"""


def _h60(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT)"


def _h32(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT)"


SQL["split_25"] = f"""WITH d AS (SELECT doc_id, lang, {_h32("'1'", 'CAST(doc_id AS VARCHAR)')} AS h FROM documents)
SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) <= (SELECT ceil(count(*) * 0.25) FROM documents) AS is_test FROM d"""

# ---------------------------------------------------------------------------
# Balancing
DOC_POS = """d AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents),
sz AS (SELECT lang, n, max(n) OVER () AS mx FROM (SELECT DISTINCT lang, n FROM d))"""
SQL["random_oversample"] = f"""WITH {DOC_POS},
k AS (SELECT lang, n, unnest(range(1, mx - n + 1)) AS k FROM sz WHERE mx > n),
pick AS (SELECT lang, k, ({_h60("'1'", 'lang', 'CAST(k AS VARCHAR)')} % n) + 1 AS rn FROM k)
SELECT doc_id, lang, CAST(0 AS BIGINT) AS copy FROM d
UNION ALL SELECT d.doc_id, d.lang, p.k FROM pick p JOIN d ON d.lang = p.lang AND d.rn = p.rn"""
PAIRS = f"""{DOC_POS},
kk AS (SELECT lang, CAST(floor((mx / n) / 2) + 1 AS INTEGER) AS K FROM sz),
a AS (SELECT d.lang, d.rn AS a_rn, CAST(unnest(range(1, kk.K + 1)) AS INTEGER) AS off FROM d JOIN kk ON d.lang = kk.lang),
pairs AS (SELECT a.lang, a.a_rn, b.rn AS b_rn, a.off FROM a JOIN d b ON b.lang = a.lang AND b.rn = a.a_rn + a.off)"""
SQL["genetic_pairs"] = f"WITH {PAIRS} SELECT * FROM pairs"


def _coin(tag: str, idx: str) -> str:
    return f"({_h32(chr(39) + '1' + chr(39), 'ka', 'kb', q(tag), f'CAST({idx} AS VARCHAR)')} / 4294967296.0 < 0.25)"


SQL["genetic_children"] = f"""WITH {PAIRS},
j AS (SELECT p.lang, a.doc_id AS a_id, b.doc_id AS b_id, a.text AS ta, b.text AS tb,
        CAST(a.doc_id AS VARCHAR) AS ka, CAST(b.doc_id AS VARCHAR) AS kb
      FROM pairs p JOIN d a ON a.lang = p.lang AND a.rn = p.a_rn JOIN d b ON b.lang = p.lang AND b.rn = p.b_rn),
s1 AS (SELECT *, CASE WHEN len(string_split(ta, ' ')) > len(string_split(tb, ' ')) THEN string_split(tb, ' ') ELSE string_split(ta, ' ') END AS A,
                 CASE WHEN len(string_split(ta, ' ')) > len(string_split(tb, ' ')) THEN string_split(ta, ' ') ELSE string_split(tb, ' ') END AS B FROM j),
s2 AS (SELECT *, len(A) AS nA, list_sort(list_transform(B, lambda w, j: {{'k': md5(concat_ws('|', '1', ka, kb, 'p', CAST(j - 1 AS VARCHAR))), 'j': j - 1, 'w': w}})) AS perm FROM s1),
s3 AS (SELECT *, list_transform(perm[1:nA], lambda x: x.w) AS picks,
                 list_sort(list_transform(perm[nA + 1:], lambda x: {{'j': x.j, 'w': x.w}})) AS lft FROM s2),
s4 AS (SELECT lang, a_id, b_id,
  array_to_string(list_concat(list_transform(A, lambda w, i: CASE WHEN {_coin('a', 'i - 1')} THEN picks[i] ELSE w END),
                              list_transform(list_filter(lft, lambda x: {_coin('b', 'x.j')}), lambda x: x.w)), ' ') AS child_a,
  array_to_string(list_concat(list_transform(A, lambda w, i: CASE WHEN {_coin('a', 'i - 1')} THEN w ELSE picks[i] END),
                              list_transform(list_filter(lft, lambda x: NOT {_coin('b', 'x.j')}), lambda x: x.w)), ' ') AS child_b
  FROM s3)
SELECT lang, a_id, b_id, md5(child_a) AS md5_a, md5(child_b) AS md5_b,
  CAST(len(string_split(child_a, ' ')) AS INTEGER) AS words_a, CAST(len(string_split(child_b, ' ')) AS INTEGER) AS words_b FROM s4"""


def _law(m: str, ratio: str) -> str:
    k = f"(CAST(floor(({ratio}) / 2) + 1 AS BIGINT))"
    return (f"({m} + 2 * (CASE WHEN {m} - 1 <= {k} THEN ({m} - 1) * {m} // 2 "
            f"ELSE {k} * ({k} + 1) // 2 + ({m} - 1 - {k}) * {k} END))")


SQL["genetic_sizes"] = f"""WITH r0 AS (SELECT role, count(*) AS m FROM conversations GROUP BY role),
r1 AS (SELECT role, {_law('m', 'max(m) OVER () / m')} AS m FROM r0),
r2 AS (SELECT role, {_law('m', 'max(m) OVER () / m')} AS m FROM r1),
r3 AS (SELECT role, {_law('m', 'max(m) OVER () / m')} AS m FROM r2)
SELECT role, m AS n FROM r3"""

# ---------------------------------------------------------------------------
# Subsets and sources
_KW = ["license", "token", "@"]
SQL["keyword_subset"] = f"""SELECT doc_id, lang FROM documents WHERE {' OR '.join(f'contains(lower(text), {q(k)})' for k in _KW)}"""
SQL["keyword_subset_first_line"] = f"""SELECT doc_id, lang FROM documents
WHERE {' OR '.join(f"contains(split_part(lower(text), chr(10), 1), {q(k)})" for k in _KW)}"""
SQL["class_filter"] = """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source, CAST(l.quality AS VARCHAR) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1"""
SQL["union_documents"] = f"""WITH s AS (SELECT source, dense_rank() OVER (ORDER BY source) AS docno FROM (SELECT DISTINCT source FROM documents))
SELECT {X.zfill('s.docno', 5)} || '_' || {X.zfill('d.doc_id', 4)} AS id, d.source, d.doc_id FROM documents d JOIN s ON d.source = s.source"""
_LSTRIP = "regexp_replace(s, " + q("^" + X.WS_RUN) + ", '')"
SQL["annotation_split"] = f"""WITH c AS (SELECT conv_id, turn, text, split_part(text, chr(10), 1) AS title FROM conversations),
p AS (SELECT conv_id, turn, title, string_split(replace(text, chr(10), ' '), '.') AS parts FROM c),
p1 AS (SELECT conv_id, turn, title, list_concat([replace(parts[1], title, '')], parts[2:]) AS parts FROM p),
p2 AS (SELECT conv_id, turn, title, list_filter(list_concat(list_transform(parts[1:len(parts) - 1], lambda s: {_LSTRIP} || '.'),
         [parts[len(parts)]]), lambda s: s = '' OR {X.strip_ws('s')} <> '') AS parts FROM p1)
SELECT conv_id, turn, title, CAST(unnest(range(0, len(parts))) AS INTEGER) AS pos, unnest(parts) AS part FROM p2"""


SQL["preparation_report"] = f"""WITH d AS (SELECT doc_id, lang, {_h32("'1'", 'CAST(doc_id AS VARCHAR)')} AS h FROM documents),
s AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) <= (SELECT ceil(count(*) * 0.25) FROM documents) AS is_test FROM d),
tr AS (SELECT lang, count(*) AS n FROM s WHERE NOT is_test GROUP BY lang)
SELECT 'size' AS section, 'rows_in' AS key, count(*) AS value FROM s
UNION ALL SELECT 'size', 'train', count(*) FILTER (WHERE NOT is_test) FROM s
UNION ALL SELECT 'size', 'test', count(*) FILTER (WHERE is_test) FROM s
UNION ALL SELECT 'size', 'train_balanced', count(*) * max(n) FROM tr
UNION ALL SELECT 'mapping', key, value FROM (VALUES {', '.join(f"({q(n)}, {i})" for i, n in enumerate(E.LANG_MAPPING))}) m(key, value)"""

_EXP = "['resiliation', 'paiement', 'non_sollicitation', 'non_concurrence', 'indemnisation']"
SQL["kb_evaluation"] = f"""WITH {ANALYSIS},
ev AS (SELECT {_EXP}[CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)] AS expected,
              coalesce(list_min(b.cands), 'None') AS predicted
       FROM b JOIN orders o ON o.o_orderkey = b.clause_id JOIN contract_clause c ON c.clause_id = b.clause_id
       WHERE {X.strip_ws('c.text')} <> ''),
conf AS (SELECT expected, predicted, count(*) AS cnt FROM ev GROUP BY ALL),
pl AS {_per_label('conf', [])}
SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM pl
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pl
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pl
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pl"""


# ---------------------------------------------------------------------------
# Searches over stand-in sub-models
from clausefold.operators import analysis as AN  # noqa: E402

_LABELLED = f"""{ANALYSIS},
lab AS (SELECT c.clause_id AS id, {_EXP}[CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)] AS type,
    coalesce(f.policy, 'None') AS policy, {X.clean('c.dtext')} AS body
  FROM contract_clause c JOIN orders o ON o.o_orderkey = c.clause_id
  LEFT JOIN (SELECT clause_id, arg_min(policy, idx) AS policy FROM fired GROUP BY clause_id) f ON f.clause_id = c.clause_id),
sent AS (SELECT id, type, unnest(range(0, len(arr))) AS sno, unnest(arr) AS s FROM (SELECT id, type, {X.split_sentences('body')} AS arr FROM lab))"""


def _stand_in_sql(member, x: str) -> str:
    from clausefold.plans.catalog import stand_in_else, stand_in_hints
    whens = " ".join(f"WHEN contains({x}, {q(w)}) THEN {c}" for c, w in stand_in_hints(member))
    return f"(CASE {whens} ELSE {stand_in_else(member)} END)"


def _search_sql(configs, ctype, n: int, lab: str = "lab", voted: str | None = None) -> str:
    """CTEs and the final SELECT of one search; ``n`` keeps names apart.
    ``voted`` (id, key, y) has the ballots of all sub-models, if they are not
    stand-ins."""
    from clausefold.plans.catalog import SEARCH_TYPES
    only = f" WHERE type = {q(ctype)}" if ctype else ""
    preds = [f"SELECT v.id, v.key, v.y FROM {voted} v JOIN (SELECT id FROM {lab}{only}) o ON o.id = v.id"] if voted else []
    for m, d in AN.distinct_members(configs) if not voted else []:
        if m.granularity == 0:
            preds.append(f"SELECT id, {q(m.key)} AS key, {_stand_in_sql(m, 'body')} AS y FROM lab{only}")
        elif d is None:
            preds.append(f"""SELECT id, {q(m.key)} AS key, y FROM (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(sno)) AS rk
  FROM (SELECT id, sno, {_stand_in_sql(m, 's')} AS y FROM sent{only}) GROUP BY id, y) WHERE rk = 1""")
        else:
            preds.append(f"SELECT id, {q(m.key)} AS key, CASE WHEN bool_or({_stand_in_sql(m, 's')} = {d}) THEN {d} END AS y FROM sent{only} GROUP BY id")
    members = ", ".join(f"({c.number}, {i}, {q(m.key)}, {q(c.mode)}, {c.default if c.default is not None else 'NULL'})" for c in configs for i, m in enumerate(c.members))
    target = configs[0].members[0].target
    code = {"type": "CASE " + " ".join(f"WHEN type = {q(t)} THEN {i}" for i, t in enumerate(SEARCH_TYPES)) + " ELSE 1 END",
            "anomalous": "CAST(policy <> 'None' AS INTEGER)",
            "policy": "CASE " + " ".join(f"WHEN policy = {q(p)} THEN {i}" for i, p in enumerate(R.POLICY_CLASSES)) + " ELSE 1 END"}[target]
    return f"""p{n} AS ({' UNION ALL '.join(preds)}),
m{n}(config, pos, key, mode, def) AS (VALUES {members}),
j{n} AS (SELECT p.id, m.config, m.pos, m.mode, m.def, p.y FROM p{n} p JOIN m{n} m ON m.key = p.key WHERE p.y IS NOT NULL),
c{n} AS (SELECT id, config, mode, def, y, count(*) AS cnt, min(pos) AS fs FROM j{n} GROUP BY ALL),
a{n} AS (SELECT *, count(*) FILTER (WHERE y <> def) OVER (PARTITION BY id, config) AS others FROM c{n}),
w{n} AS (SELECT id, config, y FROM (SELECT *, row_number() OVER (PARTITION BY id, config ORDER BY cnt DESC, fs) AS rk FROM a{n}
  WHERE mode = 'std' OR (mode = 'ato' AND y = def) OR (mode = 'not' AND (y <> def OR others = 0))) WHERE rk = 1),
e{n} AS (SELECT x.config, x.expected, coalesce(w.y, -1) AS predicted, count(*) AS cnt
  FROM (SELECT id, {code} AS expected, g.config FROM {lab}, (SELECT DISTINCT config FROM m{n}) g{only}) x
  LEFT JOIN w{n} w ON w.id = x.id AND w.config = x.config GROUP BY ALL),
s{n} AS ({_macro(_per_label(f'e{n}', ['config']), ['config'])}),
b{n} AS (SELECT {q(ctype or 'default')} AS type, config, macro_f1 FROM
  (SELECT *, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, config) AS rk FROM s{n}) WHERE rk = 1)"""


def _searches(configs_of, types) -> str:
    parts = [(configs, t) for t in types if (configs := configs_of(t))]
    ctes = ",\n".join(_search_sql(c, t, i) for i, (c, t) in enumerate(parts))
    return f"WITH {_LABELLED},\n{ctes}\n" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(len(parts)))


SQL["search_alpha"] = _searches(lambda t: AN.alpha_configs(), [None])
SQL["search_beta"] = _searches(AN.beta_configs, [*AN.types_of_rules(), None])
SQL["search_gamma"] = _searches(AN.gamma_configs, [*AN.types_of_rules(), None])


def _case_code(x: str, names: list[str]) -> str:
    return "(CASE " + " ".join(f"WHEN {x} = {q(n)} THEN {i}" for i, n in enumerate(names)) + " ELSE -1 END)"


_POL = "[" + ", ".join(q(p) for p in R.POLICIES) + "]"
SQL["rule_phase_evaluation"] = f"""WITH {_LABELLED},
ans AS (SELECT lab.id, lab.type, lab.policy, list_min(b.cands) AS p_type, pol.policies,
    list_transform(string_split(pol.policies, ','), lambda p: list_position({_POL}, p) - 1) AS codes
  FROM lab JOIN b ON b.clause_id = lab.id LEFT JOIN pol ON pol.clause_id = lab.id),
cell AS (
  SELECT 'type' AS report, {_case_code('type', AN.types_of_rules())} AS expected, {_case_code('p_type', AN.types_of_rules())} AS predicted FROM ans
  UNION ALL SELECT 'validity', CAST(policy IN ({', '.join(q(p) for p in R.POLICIES)}) AS INTEGER), CAST(policies IS NOT NULL AS INTEGER) FROM ans
  UNION ALL SELECT 'policy_first', {_case_code('policy', R.POLICIES)}, coalesce(codes[1], -1) FROM ans
  UNION ALL SELECT 'policy_best', {_case_code('policy', R.POLICIES)},
    CASE WHEN list_contains(codes, {_case_code('policy', R.POLICIES)}) THEN {_case_code('policy', R.POLICIES)} ELSE coalesce(codes[1], -1) END FROM ans),
conf AS (SELECT report, expected, predicted, count(*) AS cnt FROM cell GROUP BY ALL),
pl AS {_per_label('conf', ['report'])}
SELECT report, CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM pl
UNION ALL SELECT report, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pl GROUP BY report
UNION ALL SELECT report, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pl GROUP BY report
UNION ALL SELECT report, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pl GROUP BY report"""


# ---------------------------------------------------------------------------
# File formats
SQL["labels_roundtrip"] = """SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(d.lang, '') AS lang,
  coalesce(CAST(l.quality AS VARCHAR), '') AS quality, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
SQL["attach_text"] = """SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(l.quality AS VARCHAR) AS label, md5(d.text) AS text_md5
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
SQL["labels_or_empty"] = """SELECT d.doc_id, d.source, coalesce(CAST(l.quality AS VARCHAR), '') AS quality, coalesce(CAST(l.toxic AS VARCHAR), '') AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
SQL["contracts_json"] = f"""WITH {CONTRACT_SENT},
body AS (SELECT clause_id, string_agg(text || ' ', '' ORDER BY n, text) AS text FROM contract_sent WHERE text <> '' GROUP BY clause_id)
SELECT {TITLE} AS title, md5(coalesce(b.text, '')) AS text_md5, 'None' AS invalidity, 'None' AS policies, '' AS type
FROM orders o LEFT JOIN body b ON b.clause_id = o.o_orderkey"""
SQL["annotations"] = f"""WITH {CONTRACT},
c AS (SELECT {X.zfill('clause_id', 4)} AS id, CAST(contract_id AS VARCHAR) AS contract, title, o_orderpriority AS priority
  FROM contract_clause JOIN orders ON o_orderkey = clause_id),
s AS (SELECT {X.zfill('l_orderkey', 4)} || '_' || {X.zfill('l_linenumber', 3)} AS id, l_linestatus AS label, l_returnflag || l_linestatus AS text
  FROM lineitem WHERE l_returnflag <> 'R')
SELECT 'clause_props' AS output, id, contract || '|' || replace(title || ', ' || priority, ',', ' ') AS cells FROM c
UNION ALL SELECT 'clause_labels', id, priority FROM c
UNION ALL SELECT 'sentence_labels', id, label FROM s
UNION ALL SELECT 'sentence_texts', id, text FROM s"""
# the rules as a table: place in the rule file, policy, type, whether a
# sentence tells (a policy that also looks at the whole clause does not)
SQL["rule_table"] = f"""WITH {CONTRACT},
rules(pos, policy, type, sentence, whole) AS (VALUES
  (2, 'R2', 'non_sollicitation', true, false), (3, 'R3', 'non_sollicitation', false, true), (4, 'R4', 'non_sollicitation', true, false),
  (5, 'R4', 'non_sollicitation', false, true), (6, 'R5', 'non_sollicitation', false, true), (7, 'R7', 'resiliation', true, false),
  (8, 'R7', 'resiliation', true, false), (9, 'R8', 'resiliation', false, true), (10, 'R9', 'resiliation', false, true),
  (11, 'R10', 'resiliation', false, true), (12, 'R11', 'paiement', true, false), (13, 'R11', 'paiement', false, true),
  (14, 'R12', 'paiement', true, false), (15, 'R13', 'indemnisation', false, false), (16, 'R15', 'non_concurrence', true, false)),
n AS (SELECT {_EXP}[CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)] AS type, count(*) AS n_clauses
  FROM contract_clause c JOIN orders o ON o.o_orderkey = c.clause_id GROUP BY 1),
t AS (SELECT type, CAST(min(pos) AS INTEGER) AS first_pos FROM rules GROUP BY type),
p AS (SELECT policy, bool_or(sentence) AND NOT bool_or(whole) AS applies FROM rules GROUP BY policy)
SELECT DISTINCT n.type, t.first_pos, r.policy, p.applies, n.n_clauses
FROM n JOIN t ON t.type = n.type JOIN rules r ON r.type = n.type JOIN p ON p.policy = r.policy"""
SQL["encoding_repair"] = "SELECT doc_id, md5(text || '’€') AS text_md5, doc_id % 2 = 1 AS repaired FROM documents"
SQL["document_store"] = """SELECT md5(concat_ws('|', source, CAST(doc_id AS VARCHAR))) AS _id, doc_id, coalesce(lang, 'none') AS domain, source, n_chars FROM documents"""

_ROUND = SQL["genetic_children"].split("SELECT lang, a_id, b_id, md5(child_a)")[0].replace("SELECT p.lang, a.doc_id AS a_id", "SELECT p.lang, p.off, a.doc_id AS a_id").replace(
    "s4 AS (SELECT lang, a_id", "s4 AS (SELECT lang, off, a_id")
SQL["genetic_round_texts"] = f"""{_ROUND}
SELECT lang, CAST(doc_id AS VARCHAR) || '.0' AS key, md5(text) AS text_md5 FROM d
UNION ALL SELECT lang, CAST(a_id AS VARCHAR) || '.' || CAST(2 * off - 1 AS VARCHAR), md5(child_a) FROM s4
UNION ALL SELECT lang, CAST(a_id AS VARCHAR) || '.' || CAST(2 * off AS VARCHAR), md5(child_b) FROM s4"""
SQL["prepared_sizes"] = f"""WITH s AS (SELECT lang, row_number() OVER (ORDER BY {_h32("'1'", 'CAST(doc_id AS VARCHAR)')}, doc_id) <=
    (SELECT ceil(count(*) * 0.25) FROM documents) AS is_test FROM documents),
n AS (SELECT lang AS label, count(*) AS n_rows, count(*) FILTER (WHERE NOT is_test) AS m FROM s GROUP BY lang),
g AS (SELECT label, n_rows, m AS n_train, CAST({_law('m', 'max(m) OVER () / m')} AS BIGINT) AS n_genetic FROM n)
SELECT label, n_rows, n_train, n_genetic, max(n_genetic) OVER () AS n_prepared FROM g"""
_ORDERED = ", ".join(f"({i}, {q(m)})" for i, (m, _, _) in enumerate(E.sub_models()))
SQL["composite_predictions"] = SQL["ensemble_search"].split("members(ensemble_no")[0] + f"""names(pos, model) AS (VALUES {_ORDERED})
SELECT d.id AS doc_id, string_agg(coalesce(CAST(p.y AS VARCHAR), '-'), ',' ORDER BY n.pos) AS codes
FROM d CROSS JOIN names n LEFT JOIN preds p ON p.id = d.id AND p.model = n.model GROUP BY d.id"""

# ---------------------------------------------------------------------------
# Rules and vocabularies from files
SQL["policy_rule_file"] = SQL["policy_all"]
SQL["rule_file_sentences"] = SQL["notable_sentences"]
_MANY = "(CASE WHEN {0} < 8 THEN [['cheque', 'client', 'convenance', 'fournisseur', 'partenaire', 'preavis', 'remuneration', 'virement'][{0} + 1]] ELSE []::VARCHAR[] END)"


def _digit(i: int) -> str:
    return f"(instr('0123456789abcdef', substr(h, {i}, 1)) - 1)"


_MANY_RULES = f"""rules AS (SELECT row_number() OVER (ORDER BY k) AS idx, 'G' || substr(h, 7, 2) AS policy,
    ['indemnisation', 'non_concurrence', 'non_sollicitation', 'paiement', 'resiliation'][{_digit(1)} % 5 + 1] AS type,
    {_MANY.format(_digit(2))} AS clause_need, {_MANY.format(_digit(3))} AS clause_forbid, {_MANY.format(_digit(4))} AS sent_need,
    CASE WHEN {_digit(5)} < 4 THEN '<' WHEN {_digit(5)} < 8 THEN '>' END AS dur_op, ({_digit(6)} + 1) * 30 AS dur_days,
    CASE WHEN {_digit(5)} < 8 OR {_digit(4)} < 8 THEN 'sentence' ELSE 'clause' END AS scope
  FROM (SELECT k, md5(k) AS h FROM (SELECT DISTINCT p_type || '|' || p_size || '|' || (p_partkey % 4) AS k FROM part))),
fired AS"""
SQL["policy_many_rules"] = SQL["policy_all"].replace(f"rules(idx, policy, type, clause_need, clause_forbid, sent_need, dur_op, dur_days, scope) AS (VALUES {_rules_values}),\nfired AS", _MANY_RULES).replace(
    "coalesce(pol.policies, '') AS policies", "coalesce(len(string_split(pol.policies, ',')), 0)::INTEGER AS n_policies, md5(coalesce(pol.policies, '')) AS policies_md5")
SQL["concept_table"] = f"""WITH token AS (SELECT DISTINCT unnest({X.ws_split('lower(text)')}) AS t FROM documents),
term AS (SELECT DISTINCT substr(t, 2, length(t) - 2) AS term FROM token WHERE length(t) BETWEEN 5 AND 30 AND md5(t)[1] IN ('0', '1'))
SELECT doc_id, 'k' || md5(term)[1:2] AS name, count(*) AS n_terms
FROM (SELECT doc_id, lower(text) AS low FROM documents) d JOIN term ON contains(d.low, term.term) GROUP BY ALL"""
SQL["nonblank_of_types"] = f"""WITH {CONTRACT_SENT}, {CONTRACT_BODY}, c AS (SELECT o_orderkey AS clause_id, {TITLE} AS title FROM orders)
SELECT c.clause_id, c.title FROM c JOIN contract_body b ON b.clause_id = c.clause_id
WHERE {X.strip_ws('b.text')} <> '' AND c.title IN ('Résiliation du contrat', 'Conditions de paiement', 'Non-sollicitation du personnel', 'Clause de non-concurrence')"""

# ---------------------------------------------------------------------------
# T5
_SHARES = ", ".join(f"CAST(floor(1000 * (length(low) - length(replace(low, '{c}', ''))) / n) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz")
_KNN = f"""WITH d AS (SELECT doc_id, lang, [{_SHARES}] AS v FROM
  (SELECT *, greatest(length(low), 1) AS n FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS low FROM documents))),
p AS (SELECT a.doc_id AS query_id, b.doc_id, b.lang, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS distance
  FROM d a JOIN d b ON a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM p QUALIFY rank <= 50)"""
SQL["knn_l1"] = f"""{_KNN}
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, distance FROM n"""
SQL["knn_language"] = f"""{_KNN},
v AS (SELECT query_id, lang, count(*) FILTER (WHERE distance = 0) AS same, coalesce(sum(1.0 / distance) FILTER (WHERE distance > 0), 0) AS weight
  FROM n WHERE lang IS NOT NULL GROUP BY ALL)
SELECT w.query_id, d.lang AS expected, w.lang AS predicted
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, round(weight, 9) DESC, lang) AS r FROM v) w
JOIN d ON d.doc_id = w.query_id WHERE r = 1"""

# ---------------------------------------------------------------------------
# M3, X6, files by id, run log
SQL["anova_selected"] = f"""WITH {CLEAN_DOCS},
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM cd),
x AS (SELECT t.doc_id, t.term, d.lang, count(*) AS x FROM tok t JOIN documents d ON d.doc_id = t.doc_id WHERE d.lang IS NOT NULL GROUP BY ALL),
size AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang),
whole AS (SELECT sum(n) AS n, count(*) AS k FROM size),
c AS (SELECT x.term, x.lang, sum(x.x) AS s, sum(x.x * x.x) AS q FROM x GROUP BY ALL),
t AS (SELECT c.term, sum(c.s * c.s / size.n) AS means, sum(c.s) AS s, sum(c.q) AS q FROM c JOIN size ON size.lang = c.lang GROUP BY c.term),
v AS (SELECT term, greatest(0, means - s * s / n) AS between_, CASE WHEN q - means > 1e-12 * q THEN q - means ELSE 0 END AS within_, q, n, k FROM t, whole),
f AS (SELECT term, CASE WHEN within_ > 0 THEN (between_ / (k - 1)) / (within_ / (n - k)) WHEN between_ > 1e-12 * q THEN 'inf'::DOUBLE END AS f FROM v),
r AS (SELECT term, f, row_number() OVER (ORDER BY round(coalesce(least(f, 1e300), -1), 9) DESC, {_h32("'1'", 'term')}, term) AS r, count(*) OVER () AS n FROM f)
SELECT term, f, r <= floor(0.45 * n) AS selected FROM r"""
SQL["number_names"] = """SELECT l_orderkey, l_linenumber, lang, 'article ' || CASE WHEN n = 1 AND lang = 'fr' THEN 'un' WHEN n = 1 AND lang = 'es' THEN 'uno' ELSE CAST(n AS VARCHAR) END || ' du contrat' AS text
FROM (SELECT l_orderkey, l_linenumber, ['fr', 'en', 'es'][l_linenumber % 3 + 1] AS lang, (CAST(floor(l_extendedprice * 100) AS BIGINT) + l_orderkey) % 1000000 AS n FROM lineitem)"""
_TREE = """d AS (SELECT coalesce(source, 'none') AS dataset, CAST(doc_id AS VARCHAR) AS id, text, coalesce(lang, '') AS lang,
    text IS NOT NULL AND doc_id % 17 <> 0 AS written, doc_id % 10 <> 0 AS labelled FROM documents)"""
SQL["file_tree"] = f"""WITH {_TREE}, n AS (SELECT dataset, dense_rank() OVER (ORDER BY dataset) AS docno FROM (SELECT DISTINCT dataset FROM d WHERE labelled))
SELECT {X.zfill('docno', 5)} || '_' || id AS id, d.dataset, md5(text) AS text_md5, lang FROM d JOIN n ON n.dataset = d.dataset WHERE written AND labelled"""
SQL["file_tree_mismatches"] = f"""WITH {_TREE} SELECT dataset, id, CASE WHEN written THEN 'text_only' ELSE 'label_only' END AS side FROM d WHERE written <> labelled"""
SQL["file_listing"] = f"""SELECT {X.zfill('conv_id', 6)} AS dataset, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM conversations GROUP BY ALL"""
_RUN = "md5('model=' || coalesce(chr(39) || model || chr(39), 'null') || ';source=' || coalesce(chr(39) || source || chr(39), 'null'))"
SQL["run_log"] = f"""WITH {MODEL_SCORES}
SELECT run, source, model, metric, value FROM (SELECT {_RUN} AS run, source, model, accuracy, macro_precision, macro_recall, macro_f1 FROM scores)
UNPIVOT (value FOR metric IN (accuracy, macro_precision, macro_recall, macro_f1))"""
SQL["run_log_wide"] = f"WITH {MODEL_SCORES} SELECT {_RUN} AS run, source, model, accuracy, macro_f1 FROM scores"

# ---------------------------------------------------------------------------
# Fitted analyses over word tables
_WORD_LIST = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"


def _bayes(name: str, train: str, rows: str) -> str:
    """CTEs of a Bernoulli naive Bayes model: ``train`` selects (y, text),
    ``rows`` (id, sno, text); ``name`` holds (id, sno, y)."""
    return f"""{name}_t AS ({train}),
{name}_n AS (SELECT y, count(*) AS n FROM {name}_t GROUP BY y),
{name}_c AS (SELECT term, y, count(*) AS c FROM (SELECT y, unnest({_WORD_LIST.format('text')}) AS term FROM {name}_t) GROUP BY ALL),
{name}_p AS (SELECT v.term, n.y, (coalesce(c.c, 0) + 1) / (n.n + 2.0) AS p FROM (SELECT DISTINCT term FROM {name}_c) v CROSS JOIN {name}_n n
  LEFT JOIN {name}_c c ON c.term = v.term AND c.y = n.y),
{name}_b AS (SELECT n.y, ln(n.n / (SELECT sum(n) FROM {name}_n)) + coalesce(a.s, 0) AS bias FROM {name}_n n
  LEFT JOIN (SELECT y, sum(ln(1 - p)) AS s FROM {name}_p GROUP BY y) a ON a.y = n.y),
{name}_r AS (SELECT row_number() OVER () AS rid, * FROM ({rows})),
{name}_s AS (SELECT w.rid, p.y, sum(ln(p) - ln(1 - p)) AS s FROM (SELECT rid, unnest({_WORD_LIST.format('text')}) AS term FROM {name}_r) w JOIN {name}_p p ON p.term = w.term GROUP BY ALL),
{name} AS (SELECT id, sno, y FROM (
  SELECT r.id, r.sno, b.y, row_number() OVER (PARTITION BY r.rid ORDER BY round(b.bias + coalesce(s.s, 0), 9) DESC, b.y) AS k
  FROM {name}_r r CROSS JOIN {name}_b b LEFT JOIN {name}_s s ON s.rid = r.rid AND s.y = b.y) WHERE k = 1)"""


_TYPES_OF_RULES = AN.types_of_rules()
_MULTI = [t for t in _TYPES_OF_RULES if len(AN.policies_of(t)) > 1]
_SPLIT = f"""{_LABELLED},
sp AS (SELECT lab.*, c.title, row_number() OVER (ORDER BY {_h32("'1'", 'CAST(lab.id AS VARCHAR)')}, lab.id) <= ceil(count(*) OVER () * 0.25) AS is_test
  FROM lab JOIN contract_clause c ON c.clause_id = lab.id)"""


def _sentences_sql(rows: str, extra: str = "") -> str:
    return f"SELECT id, unnest(range(0, len(a))) AS sno, unnest(a) AS text{extra} FROM (SELECT *, {X.split_sentences('body')} AS a FROM ({rows}))"


def _phases_sql(targets: str) -> str:
    """CTEs of the phased analysis; ``targets`` selects (id, title, body,
    given, stage).  ``answered`` has (id, stage, type, anomalous, anomaly)."""
    type_code, policy_code = _case_code("type", _TYPES_OF_RULES), _case_code("policy", R.POLICY_CLASSES)
    names = "[" + ", ".join(q(t) for t in _TYPES_OF_RULES) + "]"
    classes = "[" + ", ".join(q(p) for p in R.POLICY_CLASSES) + "]"
    known = "', '".join(_TYPES_OF_RULES)
    other = f"(type IS NULL OR type NOT IN ('{known}'))"
    best = "row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min({0})) AS k"
    parts = [
        f"tgt AS ({targets})",
        _bayes("am", f"SELECT {type_code} AS y, body AS text FROM sp WHERE NOT is_test AND {type_code} >= 0", "SELECT id, 0 AS sno, body AS text FROM tgt"),
        _bayes("asm", f"SELECT {type_code} AS y, text FROM ({_sentences_sql('SELECT * FROM sp WHERE NOT is_test', ', type')}) WHERE {type_code} >= 0", _sentences_sql("SELECT * FROM tgt")),
        f"asv AS (SELECT id, y FROM (SELECT id, y, {best.format('sno')} FROM asm GROUP BY id, y) WHERE k = 1)",
        f"tt AS (SELECT id, {_case_code(_TT_TYPE, _TYPES_OF_RULES)} AS y FROM (SELECT id, {X.ws_split('title')} AS tok FROM tgt))",
        "ab AS (SELECT id, y, 0 AS pos FROM tt WHERE y >= 0 UNION ALL SELECT id, y, 1 FROM am UNION ALL SELECT id, y, 2 FROM asv)",
        f"av AS (SELECT id, {names}[y + 1] AS type FROM (SELECT id, y, {best.format('pos')} FROM ab GROUP BY id, y) WHERE k = 1)",
        "typed AS (SELECT t.id, t.body, t.stage, CASE WHEN stage = 'full' THEN av.type ELSE given END AS type FROM tgt t LEFT JOIN av ON av.id = t.id)",
    ]
    bad = "SELECT CASE WHEN policy = 'None' THEN 0 ELSE 1 END AS y, body AS text FROM sp WHERE NOT is_test"
    asked = "SELECT id, 0 AS sno, body AS text FROM typed WHERE stage <> 'gamma' AND "
    for i, t in enumerate(_TYPES_OF_RULES):
        parts.append(_bayes(f"b{i}m", f"{bad} AND type = {q(t)}", f"{asked} type = {q(t)}"))
    parts.append(_bayes("bdm", bad, asked + other))
    beta = " UNION ALL ".join(f"SELECT id, y FROM {n}" for n in [*(f"b{i}m" for i in range(len(_TYPES_OF_RULES))), "bdm"])
    parts.append(f"flagged AS (SELECT t.*, t.stage = 'gamma' OR coalesce(b.y = 1, false) AS anomalous FROM typed t LEFT JOIN ({beta}) b ON b.id = t.id)")
    violated = "SELECT id, 0 AS sno, body AS text FROM flagged WHERE anomalous AND "
    coded = f"SELECT {policy_code} AS y, body AS text FROM sp WHERE NOT is_test AND "
    for i, t in enumerate(_MULTI):
        own = ", ".join(q(p) for p in AN.policies_of(t))
        parts.append(_bayes(f"g{i}m", f"{coded} type = {q(t)} AND policy IN ({own})", f"{violated} type = {q(t)}"))
    parts.append(_bayes("gdm", f"{coded} policy <> 'None'", violated + other))
    single = " ".join(f"WHEN f.type = {q(t)} THEN {q(AN.policies_of(t)[0])}" for t in _TYPES_OF_RULES if t not in _MULTI)
    gamma = " UNION ALL ".join(f"SELECT id, {classes}[y + 1] AS policy FROM {n} WHERE y > 0" for n in [*(f"g{i}m" for i in range(len(_MULTI))), "gdm"])
    parts.append(f"""answered AS (SELECT f.id, f.stage, f.type, f.anomalous,
    CASE WHEN f.anomalous THEN CASE {single} ELSE coalesce(g.policy, '') END END AS anomaly FROM flagged f LEFT JOIN ({gamma}) g ON g.id = f.id)""")
    return ",\n".join(parts)


_TEST_SIDE = "SELECT id, title, body, NULL::VARCHAR AS given, 'full' AS stage FROM sp WHERE is_test"
_TEST_PHASES = f"{_SPLIT},\n{_phases_sql(_TEST_SIDE)}"
SQL["phased_words"] = f"WITH {_TEST_PHASES} SELECT id, type, anomalous, anomaly FROM answered"
_REPORTS = SQL["rule_phase_evaluation"].split("cell AS (", 1)[1]
SQL["phased_words_evaluation"] = f"""WITH {_TEST_PHASES},
ans AS (SELECT sp.id, sp.type, sp.policy, a.type AS p_type, CASE WHEN a.anomalous THEN 1 END AS policies,
    CASE WHEN coalesce(a.anomaly, '') <> '' THEN [{_case_code('a.anomaly', R.POLICIES)}] END AS codes FROM sp JOIN answered a ON a.id = sp.id),
cell AS ({_REPORTS}"""
_WAY = """CASE WHEN r.type = '' THEN 'full' WHEN r.anomalous = '' THEN 'beta_gamma' WHEN r.anomalous IN ('True', '1', 'true') THEN 'gamma' ELSE 'none' END"""
_ASKED = REQUESTS.split("requests AS (", 1)[1]
_ROUTED = f"""requests AS ({_ASKED},
way AS (SELECT r.*, {_WAY} AS route FROM requests r WHERE {' AND '.join(f'r.{f} IS NOT NULL' for f in _FIELDS)})"""
_REQUESTED = "SELECT w.request_id AS id, w.title, sp.body, w.type AS given, w.route AS stage FROM way w JOIN sp ON sp.id = w.request_id WHERE w.route <> 'none'"
SQL["model_answers"] = f"""WITH {_SPLIT},
{_ROUTED},
{_phases_sql(_REQUESTED)}
SELECT w.request_id, w.route, CASE WHEN w.route = 'full' THEN coalesce(a.type, 'None') ELSE w.type END AS type,
  CASE WHEN coalesce(a.anomalous, false) THEN 'True' ELSE 'False' END AS anomalous, a.anomaly
FROM way w LEFT JOIN answered a ON a.id = w.request_id"""
_TYPE_CODE = _case_code("type", _TYPES_OF_RULES)
SQL["folder_classification"] = f"""WITH {_SPLIT},
{_bayes('fm', f"SELECT {_TYPE_CODE} AS y, body AS text FROM sp WHERE NOT is_test AND {_TYPE_CODE} >= 0", "SELECT id, 0 AS sno, body AS text FROM sp")}
SELECT CAST(id AS VARCHAR) AS id, [{', '.join(q(t) for t in _TYPES_OF_RULES)}][y + 1] AS type FROM fm"""
SQL["label_classes"] = """WITH l AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL)),
s AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL))
SELECT doc_id, CAST(coalesce(l.pos, -1) AS INTEGER) AS lang_code, CAST(coalesce(s.pos, -1) AS INTEGER) AS source_code
FROM documents d LEFT JOIN l ON l.name = d.lang LEFT JOIN s ON s.name = d.source"""


def _fitted_searches(configs_of, ctypes) -> str:
    searches = [(t, configs) for t in ctypes if (configs := configs_of(t))]
    members, askers = {}, {}
    for t, configs in searches:
        for m, d in AN.distinct_members(configs):
            members[m.key] = m, d
            askers.setdefault(m.key, set()).add(t)
    y_of = {"type": _TYPE_CODE, "anomalous": "CAST(policy <> 'None' AS INTEGER)", "policy": _case_code("policy", R.POLICY_CLASSES)}
    learn, ask, votes = [], [], []
    for key, (m, d) in members.items():
        cond = ["NOT is_test", f"{y_of[m.target]} >= 0"]
        if m.only_type:
            cond.append(f"type = {q(m.only_type)}")
        if m.only_policies:
            cond.append(f"policy IN ({', '.join(q(p) for p in m.only_policies)})")
        own = f"{q(key)} AS key, {m.granularity} AS g, {q(m.transformer)} AS kind"
        learn.append(f"SELECT id, {own}, {str(m.oversample).lower()} AS balanced, {y_of[m.target]} AS y FROM sp WHERE {' AND '.join(cond)}")
        only = "" if None in askers[key] else f" AND type IN ({', '.join(q(t) for t in sorted(askers[key]))})"
        ask.append(f"SELECT id, {own} FROM sp WHERE is_test{only}")
        if m.granularity and d is not None:
            votes.append(f"WHEN key = {q(key)} THEN {d}")
    least = f"CASE {' '.join(votes)} END" if votes else "NULL::INTEGER"
    words = _WORD_LIST.format("text")
    ctes = ",\n".join(_search_sql(configs, t, i, "lt", "voted") for i, (t, configs) in enumerate(searches))
    return f"""WITH {_SPLIT},
lt AS (SELECT * FROM sp WHERE is_test),
units AS (SELECT id, 0 AS g, -1 AS sno, body AS text FROM sp UNION ALL SELECT id, 1, sno, text FROM ({_sentences_sql('SELECT * FROM sp')})),
terms AS (SELECT id, g, sno, 'tfidf' AS kind, unnest({words}) AS term FROM units
  UNION ALL SELECT id, g, sno, 'hash', unnest(list_distinct(list_transform({words}, lambda w: md5(w)[1:3]))) FROM units
  UNION ALL SELECT id, g, sno, 'count', unnest(list_distinct({X.char_wb_grams('text')})) FROM units),
mem AS ({' UNION ALL '.join(learn)}),
asked AS ({' UNION ALL '.join(ask)}),
sizes AS (SELECT m.key, m.balanced, m.y, count(*) AS n FROM mem m JOIN units u ON u.id = m.id AND u.g = m.g GROUP BY ALL),
scaled AS (SELECT key, y, n, CASE WHEN balanced THEN max(n) OVER (PARTITION BY key) / n ELSE 1.0 END AS scale FROM sizes),
sz AS (SELECT key, y, scale, n * scale AS size, ln(n * scale / sum(n * scale) OVER (PARTITION BY key)) AS prior FROM scaled),
cnt AS (SELECT m.key, t.term, m.y, count(*) AS c FROM mem m JOIN terms t ON t.id = m.id AND t.g = m.g AND t.kind = m.kind GROUP BY ALL),
grid AS (SELECT t.key, t.term, sz.y, (coalesce(c.c, 0) * sz.scale + 1) / (sz.size + 2) AS p FROM (SELECT DISTINCT key, term FROM cnt) t JOIN sz ON sz.key = t.key
  LEFT JOIN cnt c ON c.key = t.key AND c.term = t.term AND c.y = sz.y),
absent AS (SELECT key, y, sum(ln(1 - p)) AS s FROM grid GROUP BY ALL),
sums AS (SELECT a.id, t.sno, a.key, g.y, sum(ln(g.p) - ln(1 - g.p)) AS s FROM asked a JOIN terms t ON t.id = a.id AND t.g = a.g AND t.kind = a.kind
  JOIN grid g ON g.key = a.key AND g.term = t.term GROUP BY ALL),
said AS (SELECT id, sno, key, y FROM (SELECT a.id, u.sno, a.key, sz.y, row_number() OVER (PARTITION BY a.id, u.sno, a.key
    ORDER BY round(sz.prior + coalesce(absent.s, 0) + coalesce(sums.s, 0), 9) DESC, sz.y) AS k
  FROM asked a JOIN units u ON u.id = a.id AND u.g = a.g JOIN sz ON sz.key = a.key LEFT JOIN absent ON absent.key = sz.key AND absent.y = sz.y
  LEFT JOIN sums ON sums.id = a.id AND sums.sno = u.sno AND sums.key = a.key AND sums.y = sz.y) WHERE k = 1),
counted AS (SELECT id, key, y, row_number() OVER (PARTITION BY id, key ORDER BY count(*) DESC, min(sno)) AS k, {least} AS least,
  max(CAST(y = {least} AS INTEGER)) OVER (PARTITION BY id, key) AS met FROM said GROUP BY id, key, y),
voted AS (SELECT id, key, CASE WHEN least IS NULL THEN y WHEN met = 1 THEN least END AS y FROM counted WHERE k = 1),
{ctes}
""" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(len(searches)))


SQL["search_alpha_fitted"] = _fitted_searches(lambda t: AN.alpha_configs(), [None])
SQL["search_beta_fitted"] = _fitted_searches(AN.beta_configs, [*_TYPES_OF_RULES, None])
SQL["search_gamma_fitted"] = _fitted_searches(AN.gamma_configs, [*_TYPES_OF_RULES, None])
