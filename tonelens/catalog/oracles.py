"""The named queries as SQL over the same tables, written independently of the operators' plans.

Only word lists and fixed texts are shared with the library; ranks are plain windows, thresholds are plain CASEs.
"""

from __future__ import annotations

from tonelens.catalog.lexicons import CONVERSATIONS, DOCUMENTS, GUIDANCE, STOP_WORDS
from tonelens.operators.lexicon import LABELS, Lexicon

ORACLES: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _r6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr}"


BLANKS = " || ".join(f"chr({ord(c)})" for c in map(chr, range(0x3001)) if c.isspace())
TRIM = "trim(text, (" + BLANKS + "))"
CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'http\\S+|www\\S+', '', 'g'), '[^a-z\\s'']', ' ', 'g'),"
    " '\\s+', ' ', 'g'))"
)

# -- shared CTEs ------------------------------------------------------------------------------------------------

LABELLED = """labelled AS (
  SELECT d.doc_id AS row_id, d.text, l.toxic AS label
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL)"""

PREPARED = LABELLED + f""", cleaned AS (SELECT row_id, {CLEAN.format('text')} AS text, label FROM labelled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS rn FROM cleaned),
corpus AS (SELECT row_id, text, label FROM ranked WHERE rn = 1 AND length(text) > 0)"""

_SHORT = {"Gaslighting": "gl", "Passive-Aggressive": "pa", "Sarcastic": "sa", "Sincere": "si"}


def _evidence(lexicon: Lexicon) -> str:
    parts = []
    for label in ("Gaslighting", "Passive-Aggressive", "Sarcastic"):
        ps = lexicon.patterns[label]
        hits = " + ".join(f"CAST(regexp_matches(t, {_q(p)}) AS INT)" for p in ps)
        parts.append(f"CAST({hits} AS DOUBLE) / {len(ps)} AS {_SHORT[label]}_pattern")
    for label, short in _SHORT.items():
        hits = " + ".join(f"CAST(contains(t, {_q(k)}) AS INT)" for k in lexicon.keywords[label])
        parts.append(f"CAST({hits} AS BIGINT) AS {short}_keywords")
    return ", ".join(parts)


def _scored(source: str, lexicon: Lexicon, prob: str | None = None) -> str:
    """CTEs ending in ``scored``: everything of ``source`` (with a ``text``) plus evidence, scores, label, severity."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    gl, pa, sa = (f"({s}_keywords + {s}_pattern * 5)" for s in ("gl", "pa", "sa"))
    rules = {
        "si": f"greatest({d('0.1')}, si_keywords * {d('0.4')} + CASE WHEN {gl} + {pa} + {sa} = 0 THEN {d('0.5')} ELSE 0 END)",
        "sa": f"{sa} * {d('0.4')}",
        "pa": f"{pa} * {d('0.4')}",
        "gl": f"{gl} * {d('0.4')}",
    }
    if prob is None:
        method, raw = "'rules'", rules
    else:
        p = prob
        method = (
            f"CASE WHEN {p} IS NULL THEN 'rules' WHEN gl_pattern > {d('0.15')} THEN 'gaslighting' "
            f"WHEN pa_pattern > {d('0.1')} THEN 'passive' ELSE 'model' END"
        )
        fused = {
            "si": ("(1 - {p}) * 0.15", "(1 - {p}) * 0.15", "(1 - {p}) * 0.85"),
            "sa": ("{p} * 0.15", "{p} * 0.2", "{p} * 0.85"),
            "pa": ("pa_pattern * 0.2", "0.4 + pa_pattern * 0.3 + {p} * 0.15", "pa_pattern * 0.1"),
            "gl": ("0.5 + gl_pattern * 0.3 + {p} * 0.1", "gl_pattern * 0.1", "gl_pattern * 0.05"),
        }
        raw = {
            k: f"CASE method WHEN 'rules' THEN {rules[k]} WHEN 'gaslighting' THEN {a} WHEN 'passive' THEN {b} ELSE {c} END".replace("{p}", p)
            for k, (a, b, c) in fused.items()
        }
    total = "(raw_si + raw_sa + raw_pa + raw_gl)"
    unit = ", ".join(
        f"round(raw_{s} / CASE WHEN {total} = 0 THEN 1 ELSE {total} END, 4) AS {name}"
        for s, name in (("si", "score_sincere"), ("sa", "score_sarcastic"), ("pa", "score_passive"), ("gl", "score_gaslighting"))
    )
    best = "greatest(score_sincere, score_sarcastic, score_passive, score_gaslighting)"
    orders = {
        "rules": ["Sincere", "Sarcastic", "Passive-Aggressive", "Gaslighting"],
        "gaslighting": ["Gaslighting", "Sarcastic", "Passive-Aggressive", "Sincere"],
        "passive": ["Passive-Aggressive", "Sarcastic", "Gaslighting", "Sincere"],
        "model": ["Sarcastic", "Sincere", "Passive-Aggressive", "Gaslighting"],
    }
    cols = {"Sincere": "score_sincere", "Sarcastic": "score_sarcastic", "Passive-Aggressive": "score_passive", "Gaslighting": "score_gaslighting"}
    label = "CASE " + " ".join(
        f"WHEN method = '{m}' AND {cols[l]} = {best} THEN '{l}'" for m, order in orders.items() for l in order
    ) + " END"
    return f"""lowered AS (SELECT *, lower(text) AS t FROM {source}),
evidence AS (SELECT *, {_evidence(lexicon)} FROM lowered),
chosen AS (SELECT *, {method} AS method FROM evidence),
rawscores AS (SELECT *, {raw['si']} AS raw_si, {raw['sa']} AS raw_sa, {raw['pa']} AS raw_pa, {raw['gl']} AS raw_gl FROM chosen),
unit AS (SELECT *, {unit} FROM rawscores),
named AS (SELECT *, {label} AS label, {best} AS confidence FROM unit),
scored AS (SELECT *, CASE WHEN label = 'Sincere' THEN 'low' WHEN confidence >= 0.70 THEN 'high'
  WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM named)"""


def _highlights(lexicon: Lexicon) -> str:
    found = ", ".join(
        f"CASE WHEN regexp_matches(t, {_q(p)}) THEN regexp_extract(t, {_q(p)}, 0) END"
        for l in ("Gaslighting", "Passive-Aggressive", "Sarcastic")
        for p in lexicon.patterns[l]
    )
    hits = f"list_filter([{found}], lambda x: x IS NOT NULL)"
    return f"array_to_string(list_filter({hits}, lambda x, i: list_position({hits}, x) = i)[1:5], '|')"


GUIDE = "guide(label, sanity_check, coping, responses) AS (VALUES " + ", ".join(
    f"({_q(l)}, {_q(GUIDANCE[l][0])}, {_q('|'.join(GUIDANCE[l][1]))}, {_q('|'.join(GUIDANCE[l][2]))})" for l in LABELS
) + ")"

# -- preparation ------------------------------------------------------------------------------------------------

ORACLES["clean_corpus"] = f"""WITH {PREPARED}
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM corpus), 6) AS share FROM corpus GROUP BY label"""

ORACLES["prepared_corpus"] = f"WITH {PREPARED} SELECT row_id, text, label FROM corpus"

ORACLES["clean_urls"] = f"""WITH both_parts AS (
  SELECT 'url' AS part, url AS text FROM pages UNION ALL SELECT 'html', html FROM pages),
cleaned AS (SELECT part, {CLEAN.format('text')} AS text FROM both_parts)
SELECT part, count(*) AS n, count(DISTINCT text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM cleaned WHERE length(text) > 0 GROUP BY part"""

ORACLES["clean_documents"] = f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents"

# -- profile ----------------------------------------------------------------------------------------------------

ORACLES["class_balance"] = f"""WITH {LABELLED}
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled), 6) AS share FROM labelled GROUP BY label"""

WORDS = "len(regexp_extract_all(text, '[^\\s\\x{0B}\\x{85}\\x{A0}\\p{Z}]+'))"

ORACLES["corpus_summary"] = f"""WITH {LABELLED}
SELECT label, count(*) AS n, {_r6(f'avg({WORDS})', 'mean_words')},
  (SELECT count(*) FROM labelled) AS total,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 6) AS percent,
  (SELECT count(*) - count(DISTINCT text) FROM labelled) AS duplicates
FROM labelled GROUP BY label"""

ORACLES["duplicate_count"] = """SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct,
  count(*) - count(DISTINCT text) AS n_duplicates FROM documents"""

ORACLES["length_stats"] = f"""WITH {LABELLED}
SELECT label, {_r6(f'avg({WORDS})', 'mean_words')}, {_r6('avg(length(text))', 'mean_chars')} FROM labelled GROUP BY label"""

ORACLES["length_histogram"] = f"""WITH {LABELLED},
lengths AS (
  SELECT label, 'words' AS measure, CAST({WORDS} AS DOUBLE) AS x FROM labelled
  UNION ALL SELECT label, 'chars', CAST(length(text) AS DOUBLE) FROM labelled),
ranges AS (SELECT label, measure, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS w FROM lengths GROUP BY ALL),
bins AS (SELECT *, i AS bin, lo + i * w AS bin_start, lo + (i + 1) * w AS bin_end FROM ranges, range(30) AS t(i))
SELECT b.label, b.measure, CAST(b.bin AS INT) AS bin, {_r6('b.bin_start', 'bin_start')}, {_r6('b.bin_end', 'bin_end')}, count(l.x) AS n
FROM bins b LEFT JOIN lengths l
  ON l.label = b.label AND l.measure = b.measure AND l.x >= b.bin_start AND (l.x < b.bin_end OR b.bin = 29)
GROUP BY b.label, b.measure, b.bin, b.bin_start, b.bin_end"""

_STOP = "(" + ", ".join(_q(w) for w in STOP_WORDS) + ")"
_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}'), lambda w: w NOT IN " + _STOP + ")"

ORACLES["top_unigrams"] = f"""WITH {LABELLED},
terms AS (SELECT label, unnest({_TOKENS}) AS term FROM labelled),
counts AS (SELECT label, term, count(*) AS n FROM terms GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INT) AS rank FROM counts)
SELECT label, term, n, rank FROM ranked WHERE rank <= 20"""

ORACLES["top_bigrams"] = f"""WITH {LABELLED},
toks AS (SELECT label, {_TOKENS} AS k FROM labelled),
terms AS (SELECT label, k[i] || ' ' || k[i + 1] AS term FROM toks, range(1, len(k)) AS t(i)),
counts AS (SELECT label, term, count(*) AS n FROM terms GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INT) AS rank FROM counts)
SELECT label, term, n, rank FROM ranked WHERE rank <= 15"""

ORACLES["term_frequency"] = f"""WITH terms AS (SELECT unnest({_TOKENS}) AS term FROM documents)
SELECT term, count(*) AS n FROM terms GROUP BY term"""

# -- splits and samples -----------------------------------------------------------------------------------------


def _quotas(name: str, counts: str, draws: str) -> str:
    """CTE ``name(c, q)``: largest-remainder shares of ``draws`` over ``counts(c, n)``."""
    return f"""{name}_x AS (SELECT c, n, n * ({draws}) / (SELECT sum(n) FROM {counts})::DOUBLE AS e FROM {counts}),
{name}_r AS (SELECT c, n, floor(e) AS f, row_number() OVER (ORDER BY e - floor(e) DESC, c) AS k FROM {name}_x),
{name} AS (SELECT c, n, CAST(f + CASE WHEN k <= ({draws}) - (SELECT sum(f) FROM {name}_r) THEN 1 ELSE 0 END AS BIGINT) AS q FROM {name}_r)"""


def _ranked(source: str, key: str, label: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || {key})) AS rn FROM {source}"""


def _three_way(source: str, key: str, label: str) -> str:
    return f"""WITH counts AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
{_quotas('test', 'counts', 'SELECT ceil(0.15::DOUBLE * sum(n)) FROM counts')},
rest AS (SELECT c, n - q AS n FROM test),
{_quotas('val', 'rest', 'SELECT ceil((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * sum(n)) FROM rest')},
ranked AS ({_ranked(source, key, label)})
SELECT r.{key}, r.{label}, CASE WHEN rn <= t.q THEN 'test' WHEN rn <= t.q + v.q THEN 'val' ELSE 'train' END AS split
FROM ranked r JOIN test t ON t.c = r.{label} JOIN val v ON v.c = r.{label}"""


ORACLES["stratified_split"] = _three_way("labels", "doc_id", "toxic")
ORACLES["document_split"] = _three_way("documents", "doc_id", "lang")

ORACLES["stratified_subsample"] = f"""WITH counts AS (SELECT toxic AS c, count(*) AS n FROM labels GROUP BY 1),
{_quotas('sub', 'counts', 'SELECT ceil(0.3::DOUBLE * sum(n)) FROM counts')},
ranked AS ({_ranked('labels', 'doc_id', 'toxic')})
SELECT r.doc_id, r.toxic FROM ranked r JOIN sub s ON s.c = r.toxic WHERE rn <= s.q"""

ORACLES["kfold_assignment"] = f"""WITH sorted AS (SELECT toxic, row_number() OVER (ORDER BY toxic) - 1 AS pos FROM labels),
alloc AS (SELECT toxic, pos % 5 AS fold, count(*) AS n FROM sorted GROUP BY ALL),
edges AS (SELECT toxic, fold, sum(n) OVER (PARTITION BY toxic ORDER BY fold) AS hi, sum(n) OVER (PARTITION BY toxic ORDER BY fold) - n AS lo FROM alloc),
ranked AS ({_ranked('labels', 'doc_id', 'toxic')})
SELECT r.doc_id, r.toxic, CAST(e.fold AS INT) AS fold
FROM ranked r JOIN edges e ON e.toxic = r.toxic AND r.rn > e.lo AND r.rn <= e.hi"""

FOUR_LABEL = """four AS (
  SELECT 'd' || d.doc_id AS row_id, CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, CASE WHEN role = 'user' THEN 2 ELSE 3 END FROM conversations)"""

ORACLES["balanced_cap"] = f"""WITH {FOUR_LABEL},
cap AS (SELECT least(max(n), 1200) AS cap FROM (SELECT count(*) AS n FROM four GROUP BY label)),
ranked AS ({_ranked('four', 'row_id', 'label')})
SELECT row_id, label FROM ranked, cap WHERE rn <= cap"""

ORACLES["trial_rows"] = f"""WITH {FOUR_LABEL} SELECT row_id, label FROM four ORDER BY md5('42|' || row_id) LIMIT 64"""

# -- leakage ----------------------------------------------------------------------------------------------------


def _shingles(name: str, source: str, key: str) -> str:
    return f"""{name}_t AS (SELECT {key}, string_split({CLEAN.format('text')}, ' ') AS k FROM {source}),
{name} AS (SELECT DISTINCT {key}, array_to_string(k[i:i + 7], ' ') AS s FROM {name}_t, range(1, len(k) - 6) AS r(i))"""


_BOTH = _shingles("ds", "documents", "doc_id") + ", " + _shingles("bs", "benchmark", "item_id")

ORACLES["leakage_audit"] = f"""WITH {_BOTH}, seen AS (SELECT DISTINCT s FROM ds)
SELECT item_id, count(bs.s) AS n_shingles, count(seen.s) AS n_leaked, CASE WHEN count(bs.s) > 0 THEN count(seen.s) > 0 END AS leaked
FROM (SELECT item_id FROM benchmark) b LEFT JOIN bs USING (item_id) LEFT JOIN seen ON seen.s = bs.s GROUP BY item_id"""

ORACLES["leakage_by_document"] = f"""WITH {_BOTH}
SELECT doc_id, count(*) AS n_shared FROM ds WHERE s IN (SELECT s FROM bs) GROUP BY doc_id"""

ORACLES["leakage_free"] = f"""WITH {_BOTH}
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ds WHERE s IN (SELECT s FROM bs))"""

_HELD_OUT = f"""WITH counts AS (SELECT lang AS c, count(*) AS n FROM documents GROUP BY 1),
{_quotas('ho', 'counts', 'SELECT ceil(0.15::DOUBLE * sum(n)) FROM counts')},
ranked AS ({_ranked('documents', 'doc_id', 'lang')}),
parts AS (SELECT r.doc_id, r.lang, {CLEAN.format('r.text')} AS c, rn <= ho.q AS held FROM ranked r JOIN ho ON ho.c = r.lang)"""

ORACLES["leakage_exact"] = _HELD_OUT + """
SELECT doc_id, lang FROM parts WHERE held AND c IN (SELECT c FROM parts WHERE NOT held)"""
ORACLES["leakage_exact_clean"] = _HELD_OUT + """
SELECT doc_id, lang FROM parts WHERE held AND c NOT IN (SELECT c FROM parts WHERE NOT held)"""

# -- features ---------------------------------------------------------------------------------------------------


def _tfidf(max_features: int) -> str:
    return f"""toks AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS k FROM documents),
grams AS (SELECT doc_id, unnest(k) AS term FROM toks
  UNION ALL SELECT doc_id, k[i] || ' ' || k[i + 1] FROM toks, range(1, len(k)) AS r(i)),
tf AS (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL),
freq AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
top AS (SELECT * FROM freq ORDER BY tf DESC, term LIMIT {max_features}),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, tf, df,
  ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1 AS idf FROM top)"""


ORACLES["tfidf_vocabulary_capped"] = f"WITH {_tfidf(500)} SELECT term, idx, tf, df, {_r6('idf')} FROM vocab"

ORACLES["tfidf_vocabulary"] = f"WITH {_tfidf(50_000)} SELECT term, idx, tf, df, {_r6('idf')} FROM vocab"

ORACLES["tfidf_weights"] = f"""WITH {_tfidf(50_000)},
w AS (SELECT t.doc_id, t.term, (1 + ln(t.n)) * v.idf AS w FROM tf t JOIN vocab v ON v.term = t.term),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, {_r6('w.w / norm.l', 'weight')} FROM w JOIN norm ON norm.doc_id = w.doc_id"""

# -- evaluation -------------------------------------------------------------------------------------------------

BINARY = f"""{LABELLED}, src AS (SELECT row_id, text, label AS truth FROM labelled), {_scored('src', DOCUMENTS)},
bin AS (SELECT row_id, text, truth AS label, round(1.0 - score_sincere, 4) AS prob,
  CASE WHEN round(1.0 - score_sincere, 4) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)"""


def _metrics(source: str) -> str:
    """accuracy, precision, recall, f1 and auc of ``source(label, prediction, prob)`` as select items."""
    tp = "count(*) FILTER (WHERE label = 1 AND prediction = 1)"
    pp = "count(*) FILTER (WHERE prediction = 1)"
    ap = "count(*) FILTER (WHERE label = 1)"
    auc = f"""(SELECT (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
      / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1), 0)
    FROM (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS rk FROM {source}))"""
    return {
        "accuracy": f"count(*) FILTER (WHERE label = prediction) / count(*)",
        "precision": f"coalesce({tp} / nullif({pp}, 0), 0)",
        "recall": f"coalesce({tp} / nullif({ap}, 0), 0)",
        "f1": f"coalesce(2 * {tp} / nullif({pp} + {ap}, 0), 0)",
        "auc": auc,
    }


_M = _metrics("bin")
ORACLES["binary_metrics"] = f"""WITH {BINARY}
SELECT count(*) AS n, {', '.join(_r6(_M[m], m) for m in ('accuracy', 'precision', 'recall', 'f1'))} FROM bin"""
ORACLES["roc_auc"] = f"WITH {BINARY} SELECT {_r6(_M['auc'], 'auc')}"
ORACLES["roc_auc_events"] = f"""WITH ev AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, value AS prob FROM events)
SELECT {_r6(_metrics('ev')['auc'], 'auc')}"""

_MB = _metrics("base")
ORACLES["majority_baseline"] = f"""WITH top AS (SELECT toxic AS majority FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1),
base AS (SELECT toxic AS label, majority AS prediction, CASE WHEN majority = 1 THEN 1.0 ELSE 0.0 END AS prob FROM labels, top)
SELECT (SELECT majority FROM top) AS majority, count(*) AS n, {', '.join(_r6(e, m) for m, e in _MB.items())} FROM base"""

ORACLES["class_weights"] = """SELECT toxic, count(*) AS n,
  round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY toxic"""

FOUR = f"""src AS (SELECT d.doc_id, d.text, CASE WHEN toxic = 1 AND quality = 0 THEN 'Gaslighting' WHEN toxic = 1 THEN 'Passive-Aggressive'
  WHEN quality = 0 THEN 'Sarcastic' ELSE 'Sincere' END AS truth FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
{_scored('src', DOCUMENTS)},
names(label_no, name) AS (VALUES (0, 'Sincere'), (1, 'Sarcastic'), (2, 'Passive-Aggressive'), (3, 'Gaslighting'))"""

ORACLES["confusion_matrix"] = f"""WITH {FOUR}
SELECT CAST(label_no AS BIGINT) AS label_no, name AS true_label,
  count(*) FILTER (WHERE label = 'Sincere') AS pred_sincere,
  count(*) FILTER (WHERE label = 'Sarcastic') AS pred_sarcastic,
  count(*) FILTER (WHERE label = 'Passive-Aggressive') AS pred_passive,
  count(*) FILTER (WHERE label = 'Gaslighting') AS pred_gaslighting
FROM names LEFT JOIN scored ON truth = name GROUP BY label_no, name"""

_REPORT = f"""{FOUR},
report AS (SELECT name AS label,
  coalesce((SELECT count(*) FROM scored WHERE label = name AND truth = name) / nullif((SELECT count(*) FROM scored WHERE label = name), 0), 0) AS precision,
  coalesce((SELECT count(*) FROM scored WHERE label = name AND truth = name) / nullif((SELECT count(*) FROM scored WHERE truth = name), 0), 0) AS recall,
  coalesce(2 * (SELECT count(*) FROM scored WHERE label = name AND truth = name)
    / nullif((SELECT count(*) FROM scored WHERE truth = name) + (SELECT count(*) FROM scored WHERE label = name), 0), 0) AS f1,
  (SELECT count(*) FROM scored WHERE truth = name) AS support FROM names)"""

ORACLES["per_class_report"] = f"""WITH {_REPORT}
SELECT label, {_r6('precision')}, {_r6('recall')}, {_r6('f1')}, support, f1 < 0.4 AS weak FROM report"""

ORACLES["report_summary"] = f"""WITH {_REPORT}
SELECT (SELECT round(avg(CASE WHEN label = truth THEN 1.0 ELSE 0.0 END), 6) FROM scored) AS accuracy,
  {_r6('avg(precision)', 'macro_precision')}, {_r6('avg(recall)', 'macro_recall')}, {_r6('avg(f1)', 'macro_f1')},
  CAST(sum(support) AS BIGINT) AS support FROM report"""

ORACLES["per_example"] = f"""WITH {FOUR}
SELECT text, truth AS true_label, label AS pred_label, confidence, truth = label AS correct FROM scored"""

ORACLES["error_table"] = f"""WITH {BINARY}
SELECT row_id, text, label AS true_label, prediction AS predicted_label, {_r6('prob', 'confidence')} FROM bin
WHERE label <> prediction ORDER BY CASE WHEN prediction = 1 THEN prob ELSE 1 - prob END DESC, row_id LIMIT 5"""

_EXPECT = f"""own AS (SELECT d.text, CASE WHEN toxic = 1 AND quality = 0 THEN 'Gaslighting' WHEN toxic = 1 THEN 'Passive-Aggressive'
  WHEN quality = 0 THEN 'Sarcastic' ELSE 'Sincere' END AS expected FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL SELECT text, 'Sincere' FROM conversations), {_scored('own', DOCUMENTS)}"""

ORACLES["stress_eval"] = f"""WITH {_EXPECT},
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = expected) AS correct FROM scored)
SELECT total, correct, round(correct / total, 4) AS accuracy, CASE WHEN round(correct / total, 4) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a"""

ORACLES["stress_results"] = f"""WITH {_EXPECT}
SELECT expected, label AS predicted, expected = label AS passed, count(*) AS n, {_r6('avg(confidence)', 'mean_confidence')}
FROM scored GROUP BY expected, label"""

_SETS = {
    "majority": "maj AS (SELECT label, (SELECT label FROM bin GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS prediction, "
    "CASE WHEN (SELECT label FROM bin GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) = 1 THEN 1.0 ELSE 0.0 END AS prob FROM bin)",
    "length": "len_ AS (SELECT label, CASE WHEN length(text) / 5000.0 >= 0.5 THEN 1 ELSE 0 END AS prediction, least(length(text) / 5000.0::DOUBLE, 1) AS prob FROM bin)",
}


def _row(name: str, source: str) -> str:
    items = ", ".join(f"round(CAST({e} AS DOUBLE), 4) AS {m}" for m, e in _metrics(source).items())
    return f"SELECT '{name}' AS model, {items} FROM {source}"


ORACLES["model_comparison"] = f"""WITH {BINARY}, {_SETS['majority']}, {_SETS['length']}
{_row('majority', 'maj')} UNION ALL {_row('lexicon', 'bin')} UNION ALL {_row('length', 'len_')}"""

# -- lexicon scoring --------------------------------------------------------------------------------------------

DOC_SCORED = _scored("documents", DOCUMENTS)
_SCORES = "score_sincere, score_sarcastic, score_passive, score_gaslighting"
_KEYS = "gl_keywords, pa_keywords, sa_keywords, si_keywords"

ORACLES["pattern_scores"] = f"""WITH {DOC_SCORED}
SELECT doc_id, {_r6('gl_pattern')}, {_r6('pa_pattern')}, {_r6('sa_pattern')} FROM scored"""
ORACLES["keyword_scores"] = f"WITH {DOC_SCORED} SELECT doc_id, {_KEYS}, {_SCORES} FROM scored"
ORACLES["keyword_scores_indexed"] = f"WITH {DOC_SCORED} SELECT doc_id, {_KEYS} FROM scored"

_WITH_P = "src AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN (n_chars % 97) / 96.0::DOUBLE END AS p FROM documents)"
_WORD = r"regexp_extract_all(lower(text), '[a-z]+')"
ORACLES["keyword_scores_large"] = f"""WITH words AS (
  SELECT w, 1 + (count(*) % 3) AS side FROM (SELECT unnest(list_distinct({_WORD})) AS w FROM documents) WHERE length(w) > 5 GROUP BY w),
lex AS (SELECT w, side FROM words ORDER BY md5(w), w LIMIT 5000),
t AS (SELECT doc_id, lower(text) AS t FROM documents),
hits AS (SELECT doc_id, side, count(*) AS n FROM t JOIN lex ON contains(t, w) GROUP BY ALL)
SELECT doc_id, coalesce(max(n) FILTER (side = 1), 0) AS gl_keywords, coalesce(max(n) FILTER (side = 2), 0) AS pa_keywords,
  coalesce(max(n) FILTER (side = 3), 0) AS sa_keywords FROM t LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""

ORACLES["pattern_scores_table"] = f"""WITH words AS (
  SELECT w, 1 + (count(*) % 3) AS side FROM (SELECT unnest(list_distinct({_WORD})) AS w FROM documents) WHERE length(w) > 5 GROUP BY w),
lex AS (SELECT w, side FROM words ORDER BY md5(w), w LIMIT 5000),
sizes AS (SELECT side, count(*) AS all_of FROM lex GROUP BY side),
t AS (SELECT doc_id, lower(text) AS t FROM documents),
runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[a-z]+')) AS run FROM t),
hits AS (
  SELECT doc_id, side, count(DISTINCT w) AS n FROM runs JOIN lex ON run IN (w, w || 's', w || 'ed') GROUP BY ALL)
SELECT doc_id, {", ".join(f"round(coalesce(max(n / all_of) FILTER (side = {i}), 0), 6) AS {c}_pattern" for i, c in ((1, "gl"), (2, "pa"), (3, "sa")))}
FROM t LEFT JOIN (hits JOIN sizes USING (side)) USING (doc_id) GROUP BY doc_id"""

ORACLES["fused_scores"] = f"""WITH {_WITH_P}, {_scored('src', DOCUMENTS, 'p')}
SELECT doc_id, method, {_SCORES}, label, confidence, severity FROM scored"""

ORACLES["ranked_scores"] = f"""WITH {DOC_SCORED},
each AS (SELECT doc_id, 0 AS o, 'Sincere' AS label, score_sincere AS score FROM scored
  UNION ALL SELECT doc_id, 1, 'Sarcastic', score_sarcastic FROM scored
  UNION ALL SELECT doc_id, 2, 'Passive-Aggressive', score_passive FROM scored
  UNION ALL SELECT doc_id, 3, 'Gaslighting', score_gaslighting FROM scored)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS rank, label, score FROM each"""

_OUTCOME = f"""CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 2000 THEN 'too_long'
  WHEN length({TRIM}) < 1 THEN 'blank' ELSE 'ok' END"""
_ADMITTED = f"admitted AS (SELECT doc_id, {TRIM} AS text FROM documents WHERE {_OUTCOME} = 'ok')"

ORACLES["message_analysis"] = f"""WITH {GUIDE}, {_ADMITTED}, {_scored('admitted', DOCUMENTS)}
SELECT doc_id, s.label, confidence, severity, {_SCORES}, {_highlights(DOCUMENTS)} AS highlights, sanity_check, coping, responses
FROM scored s JOIN guide g ON g.label = s.label"""

ORACLES["request_quarantine"] = f"""SELECT {_OUTCOME} AS outcome, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY 1"""

ORACLES["conversation_requests"] = f"""WITH m AS (SELECT source AS conv_id, text FROM documents
  UNION ALL SELECT 'c' || conv_id, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_messages, count(*) FILTER (WHERE length({TRIM}) > 0) AS n_valid FROM m GROUP BY conv_id)
SELECT *, CASE WHEN n_messages > 20 THEN 'too_many' WHEN n_valid = 0 THEN 'blank' END AS reject_reason FROM c"""

ORACLES["prediction_display"] = f"""WITH {_WITH_P}, {DOC_SCORED},
best AS (SELECT s.doc_id, coalesce(p, round(1.0 - score_sincere, 4)) AS prob, CASE WHEN p IS NULL THEN 'lexicon' ELSE 'model' END AS model_used
  FROM scored s JOIN src USING (doc_id))
SELECT doc_id, model_used, CASE WHEN prob >= 0.5 THEN 'SARCASTIC' ELSE 'NOT SARCASTIC' END AS polarity,
  {_r6('CASE WHEN prob >= 0.5 THEN prob ELSE 1 - prob END', 'confidence')},
  printf('%.1f%%', round_even((CASE WHEN prob >= 0.5 THEN prob ELSE 1 - prob END) * 100, 1)) AS confidence_text, round(prob, 4) AS prob_4
FROM best"""

# -- conversations ----------------------------------------------------------------------------------------------

_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE label = '{l}'){{0}} AS {n}"
    for l, n in (("Sincere", "n_sincere"), ("Sarcastic", "n_sarcastic"), ("Passive-Aggressive", "n_passive"), ("Gaslighting", "n_gaslighting"))
)
_POINTS = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _verdict(source: str) -> str:
    """CTEs ending in ``verdict`` from window counts in ``source``."""
    return f"""v1 AS (SELECT *, n_sarcastic + n_passive + n_gaslighting AS n_toxic FROM {source}),
v2 AS (SELECT *, n_toxic >= 2 AS pattern_detected, n_window >= 3 AND n_recent >= 2 AS escalation_detected,
  CASE WHEN n_toxic = 0 THEN 'Sincere' WHEN n_sarcastic >= n_passive AND n_sarcastic >= n_gaslighting THEN 'Sarcastic'
    WHEN n_passive >= n_gaslighting THEN 'Passive-Aggressive' ELSE 'Gaslighting' END AS dominant_pattern,
  CASE WHEN points >= 2.5 THEN 'high' WHEN points >= 1.5 THEN 'medium' ELSE 'low' END AS overall_severity FROM v1),
verdict AS (SELECT *, CASE WHEN pattern_detected THEN n_toxic || ' of the last ' || n_window || ' messages are hostile, mostly ' || dominant_pattern || '. '
    || CASE WHEN escalation_detected THEN 'The most recent messages show it escalating.' ELSE 'It persists across the window.' END
  ELSE 'No recurring hostile pattern in this window.' END AS context_note,
  CASE WHEN escalation_detected THEN 'escalating' WHEN pattern_detected THEN 'pattern' ELSE 'none' END AS banner FROM v2)"""


_VERDICT = """n_sincere, n_sarcastic, n_passive, n_gaslighting, n_window, n_toxic, pattern_detected, dominant_pattern,
  escalation_detected, overall_severity, context_note, banner"""

_WINDOW5 = f"""sizes AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
spoken AS (SELECT c.conv_id, c.turn, {TRIM} AS text FROM conversations c JOIN sizes s ON s.conv_id = c.conv_id AND s.n <= 20
  WHERE length({TRIM}) > 0),
last5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM spoken) WHERE rn <= 5),
{_scored('last5', CONVERSATIONS)}"""

ORACLES["conversation_audit"] = f"""WITH {GUIDE}, {_WINDOW5},
counts AS (SELECT conv_id, {_COUNTS.format('')}, count(*) AS n_window,
  count(*) FILTER (WHERE rn <= 3 AND label <> 'Sincere') AS n_recent, avg({_POINTS}) AS points FROM scored GROUP BY conv_id),
{_verdict('counts')}
SELECT conv_id, {_VERDICT}, g.sanity_check FROM verdict JOIN guide g ON g.label = dominant_pattern"""

ORACLES["conversation_results"] = f"""WITH {_WINDOW5}
SELECT conv_id, turn, text AS message, label, confidence, score_gaslighting, severity, {_highlights(CONVERSATIONS)} AS highlights FROM scored"""


def _rolling(source: str, lexicon: Lexicon) -> str:
    five = " OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    three = " OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""WITH spoken AS (SELECT conv_id, turn, {TRIM} AS text FROM {source} WHERE length({TRIM}) > 0),
{_scored('spoken', lexicon)},
counts AS (SELECT conv_id, turn, label, {_COUNTS.format(five)}, count(*){five} AS n_window,
  count(*) FILTER (WHERE label <> 'Sincere'){three} AS n_recent, avg({_POINTS}){five} AS points FROM scored),
{_verdict('counts')}
SELECT conv_id, turn, label, {_VERDICT} FROM verdict"""


ORACLES["rolling_audit"] = _rolling("conversations", CONVERSATIONS)
ORACLES["rolling_audit_by_source"] = _rolling("(SELECT source AS conv_id, doc_id AS turn, text FROM documents)", DOCUMENTS)

# -- vectors ----------------------------------------------------------------------------------------------------

ORACLES["softmax_argmax"] = """WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding)),
s AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT vec_id, arg_max(i, x) - 1 AS top, round(max(p), 6) AS top_prob, round(max(p) FILTER (WHERE i = 1), 6) AS first_prob FROM s GROUP BY vec_id"""

ORACLES["batch_model_scores"] = """SELECT doc_id, round(1 / (1 + exp(-(length(text) - 1500) / 1000.0::DOUBLE)), 6) AS prob FROM documents"""

ORACLES["logit_scores"] = """WITH x AS (SELECT doc_id, length(text) / 1000.0::DOUBLE AS n FROM documents),
l AS (SELECT doc_id, [2.0 - n, n, 3.0 * n - 4.0] AS v FROM x),
e AS (SELECT doc_id, v, list_max(v) AS m, list_transform(v, lambda y: exp(y - list_max(v))) AS e FROM l)
SELECT doc_id, (list_position(v, m) - 1)::BIGINT AS top, round(1 / list_sum(e), 6) AS top_prob FROM e"""

# -- learning: what holds for any fit ----------------------------------------------------------------------------

ORACLES["lr_round_trip"] = f"""SELECT p.penalty, count(*) AS n_rows, count(*) AS n_same
FROM (VALUES ('l1'), ('l2')) p(penalty), ({ORACLES['prepared_corpus']}) c GROUP BY 1"""

# -- streams: the tables they end in ----------------------------------------------------------------------------

ORACLES["stream_message_scores"] = f"""WITH {_ADMITTED}, {_scored('admitted', DOCUMENTS)}
SELECT doc_id, 'ok' AS outcome, label, confidence FROM scored
UNION ALL SELECT doc_id, {_OUTCOME}, NULL, NULL FROM documents WHERE {_OUTCOME} <> 'ok'"""

ORACLES["stream_accounts"] = f"""WITH o AS (SELECT {_OUTCOME} AS outcome, count(*) AS n FROM documents GROUP BY 1),
names AS (SELECT unnest(['admitted', 'missing', 'empty', 'too_long', 'blank']) AS outcome)
SELECT names.outcome, coalesce(o.n, 0) AS n FROM names LEFT JOIN o ON o.outcome = CASE names.outcome WHEN 'admitted' THEN 'ok' ELSE names.outcome END
UNION ALL SELECT 'input', count(*) FROM documents UNION ALL SELECT 'late', 0"""

ORACLES["stream_conversation_audit"] = ORACLES["rolling_audit"]

# -- sources and sinks ------------------------------------------------------------------------------------------

ORACLES["io_jsonl"] = f"WITH {LABELLED} SELECT text AS headline, label AS is_sarcastic, row_id::VARCHAR AS article_link FROM labelled"

ORACLES["io_splits"] = f"""WITH {PREPARED}
SELECT text, label, CASE row_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM corpus"""

ORACLES["io_features"] = f"""WITH {_tfidf(500)},
w AS (SELECT t.doc_id, t.term, (1 + ln(t.n)) * v.idf AS w FROM tf t JOIN vocab v ON v.term = t.term),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, {_r6('w.w / norm.l', 'weight')} FROM w JOIN norm ON norm.doc_id = w.doc_id"""

ORACLES["io_comparison"] = ORACLES["model_comparison"]
ORACLES["io_report"] = ORACLES["per_class_report"]
ORACLES["io_errors"] = ORACLES["error_table"]

ORACLES["io_majority"] = """WITH top AS (SELECT toxic AS majority FROM labels GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1)
SELECT doc_id, toxic AS label, majority AS prediction, (CASE WHEN majority = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS prob FROM labels, top"""

ORACLES["missing_texts"] = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN length(text) ELSE 0 END AS n FROM documents"

ORACLES["top_coefficients"] = f"""WITH {LABELLED},
t AS (SELECT label, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS term FROM labelled),
n AS (SELECT (count(*) FILTER (label = 1))::DOUBLE AS nt, (count(*) FILTER (label <> 1))::DOUBLE AS other FROM labelled),
c AS (SELECT term, round((count(*) FILTER (label = 1)) / any_value(nt) - (count(*) FILTER (label <> 1)) / any_value(other), 6) AS coefficient
  FROM t, n GROUP BY term),
up AS (SELECT row_number() OVER (ORDER BY coefficient DESC, term) AS rank, term AS positive_term, coefficient AS positive_coefficient FROM c),
down AS (SELECT row_number() OVER (ORDER BY coefficient, term) AS rank, term AS negative_term, coefficient AS negative_coefficient FROM c)
SELECT * FROM up JOIN down USING (rank) WHERE rank <= 20"""

ORACLES["sql_functions"] = f"""WITH {DOC_SCORED}
SELECT doc_id, {CLEAN.format('text')} AS cleaned, {_r6('pa_pattern')}, si_keywords, score_sincere, score_gaslighting, 'medium' AS mid FROM scored"""

_GAPPY = f"""{BINARY}, gap AS (SELECT label, CASE WHEN row_id % 3 <> 0 THEN prob END AS prob, CASE WHEN row_id % 3 <> 0 THEN prediction END AS prediction FROM bin),
cells AS (SELECT count(*) AS n, count(prediction) AS n_scored, count(*) FILTER (label = prediction) AS hit,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (prediction = 1) AS pp, count(*) FILTER (label = 1) AS ap FROM gap),
auc AS (SELECT sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM gap a, gap b WHERE a.label = 1 AND b.label = 0 AND a.prob IS NOT NULL AND b.prob IS NOT NULL)"""
_OF_CELLS = f"""n, n_scored, {_r6('hit / n', 'accuracy')}, {_r6('CASE WHEN pp = 0 THEN 0 ELSE tp / pp END', 'precision')},
  {_r6('CASE WHEN ap = 0 THEN 0 ELSE tp / ap END', 'recall')}, {_r6('CASE WHEN pp + ap = 0 THEN 0 ELSE 2 * tp / (pp + ap) END', 'f1')}"""
ORACLES["gappy_metrics"] = f"WITH {_GAPPY} SELECT {_OF_CELLS}, {_r6('auc')} FROM cells, auc"

ORACLES["external_model"] = f"""WITH {LABELLED},
p AS (SELECT label, CASE WHEN row_id % 3 <> 0 THEN CASE WHEN least(length(text) / 5000.0, 1.0) >= 0.5 THEN 1 ELSE 0 END END AS prediction FROM labelled),
cells AS (SELECT count(*) AS n, count(prediction) AS n_scored, count(*) FILTER (label = prediction) AS hit,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (prediction = 1) AS pp, count(*) FILTER (label = 1) AS ap FROM p)
SELECT {_OF_CELLS} FROM cells"""

ORACLES["stream_audit_by_source"] = ORACLES["rolling_audit_by_source"]

_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_FMT = "'%Y-%m-%d %H:%M:%S'"

ORACLES["stream_label_windows"] = f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type AS label FROM events)
SELECT strftime(s, {_FMT}) AS window_start, strftime(s + INTERVAL 6 HOUR, {_FMT}) AS window_end, label, count(*) AS n
FROM w WHERE s + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY s, label"""

ORACLES["stream_sliding_windows"] = f"""WITH w AS (
  SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS s, event_type AS label FROM events, range(3) AS r(k))
SELECT strftime(s, {_FMT}) AS window_start, strftime(s + INTERVAL 6 HOUR, {_FMT}) AS window_end, label, count(*) AS n
FROM w WHERE s + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY s, label"""

ORACLES["stream_session_windows"] = f"""WITH g AS (SELECT user_id, event_type AS label, ts,
    CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, label ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), {_FMT}) AS window_start, label, count(*) AS n
FROM s GROUP BY user_id, label, sid HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED}"""
