"""The registered queries' equivalents in the SQL of DuckDB, over the same tables."""

from __future__ import annotations

from braidflow.operators.hybrid import PROFILES, Profile
from braidflow.operators.registry import COMPARED, ORDER
from braidflow.operators.taxonomy import HOLDOUT, NAMES, PAIRS, TRAINED
from braidflow.operators.clustering import TOLERANCE
from braidflow.operators.training import CLASS_WEIGHTS
from braidflow.plans.queries import CYCLE, DURATIONS, EPOCHS, KERNEL_THRESHOLD, LINE, LOG, METRIC_LOG, MODELS, RADII, VERTICAL_SUMMARY, WIDE_SUMMARY, mixed_profile

_IDS = ", ".join(map(str, TRAINED))
_HELD = ", ".join(map(str, HOLDOUT))
_PAIRS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(PAIRS))
_SHUFFLED = "(row_id * 2654435761 + 42) % 4294967296, row_id"


def _literal(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


def _values(rows, columns: str, name: str = "v") -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) {name}({columns})"


def name_of(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in NAMES.items()) + f" ELSE concat('Class ', {c}) END"


ROWS = f"""e AS (SELECT vec_id AS row_id, CAST(label AS INT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label BETWEEN 0 AND 6),
t AS (SELECT * FROM e WHERE label IN ({_IDS}))"""
MODEL = f"""{ROWS},
places AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM t),
mom AS (SELECT label, f, avg(v) AS m, var_pop(v) AS s FROM places GROUP BY label, f),
p AS (SELECT * FROM (VALUES {_PAIRS}) p(pair, pos, neg)),
lda AS (SELECT pair, pos, neg, list(w ORDER BY f) AS w, -sum(w * c) / 2 AS b FROM (SELECT pair, pos, neg, i.f, (i.m - j.m) / (i.s + j.s) AS w, i.m + j.m AS c FROM p JOIN mom i ON i.label = pos JOIN mom j ON j.label = neg AND j.f = i.f) GROUP BY pair, pos, neg)"""
SCORES = f"""{MODEL},
s AS (SELECT row_id, label, pair, pos, neg, list_dot_product(x, w) + b AS s FROM e, lda),
sc AS (SELECT row_id, label, list(s ORDER BY pair) AS scores FROM s GROUP BY row_id, label)"""


_CYCLE = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in CYCLE) + "][pair + 1]"
MIXED_SCORES = SCORES.replace(
    "list_dot_product(x, w) + b AS s",
    f"(list_dot_product(x, w) + b) * CASE WHEN label NOT IN ({_IDS}) THEN 1.5 WHEN row_id % 4 = 0 THEN 0.25 WHEN row_id % 4 = 1 THEN 0.2 ELSE 0.5 END + CASE WHEN label IN ({_IDS}) AND row_id % 4 = 1 THEN {_CYCLE} ELSE 0.0 END AS s",
)


def ballots(zero_first: bool = True, scores: str = SCORES) -> str:
    win = "s >= 0" if zero_first else "s > 0"
    votes = ", ".join(f"count(*) FILTER (win = {c})" for c in TRAINED)
    margins = ", ".join(f"coalesce(sum(abs(s)) FILTER (win = {c}), 0.0)" for c in TRAINED)
    return f"""{scores},
wins AS (SELECT *, CASE WHEN {win} THEN pos ELSE neg END AS win FROM s),
bal AS (SELECT row_id, label, list(s ORDER BY pair) AS scores, [{votes}] AS votes, [{margins}] AS margins FROM wins GROUP BY row_id, label)"""


def best(rule: str) -> str:
    """The place of the winner in votes, from 1."""
    if rule == "votes":
        return "list_position(votes, list_max(votes))"
    if rule == "vote_margin":
        keys = "[" + ", ".join(f"{{'v': votes[{k}], 'm': margins[{k}]}}" for k in range(1, 5)) + "]"
    else:
        keys = "[" + ", ".join(f"votes[{k}] * 1000.0 + margins[{k}]" for k in range(1, 5)) + "]"
    return f"list_position({keys}, list_max({keys}))"


def conf(kind: str, at: str) -> str:
    return {"votes": f"votes[{at}] / 3.0", "six": f"votes[{at}] / 6.0", "margin": f"margins[{at}] / greatest(votes[{at}], 1)"}[kind]


def judged(p: Profile, scores: str = SCORES) -> str:
    return f"""{ballots(p.at_zero_first, scores)},
j0 AS (SELECT *, {best(p.rule)} AS place FROM bal),
judged AS (SELECT *, CAST(place + {TRAINED[0] - 1} AS INT) AS pred, {conf(p.confidence, 'place')} AS conf FROM j0)"""


def routed(p: Profile, scores: str = SCORES) -> str:
    bypass = "WHEN pred = 4 THEN 'normal'" if p.normal_bypass else ""
    return f"""{judged(p, scores)},
routed AS (SELECT *, CASE WHEN label IN ({_HELD}) THEN 'holdout' WHEN conf >= {p.threshold} THEN 'confident' {bypass} ELSE 'uncertain' END AS route FROM judged)"""


def pool(p: Profile, scores: str = SCORES) -> str:
    order = _SHUFFLED if p.random_cap else "row_id"
    space = {"scores": "scores", "votes": "CAST(votes AS DOUBLE[])", "margins": "margins"}[p.space]
    return f"""{routed(p, scores)},
pool AS (SELECT row_id, label, pred, true AS anchor, row_id AS id, {space} AS v FROM routed WHERE route = 'holdout'
  UNION ALL SELECT row_id, label, pred, false, row_id + 2305843009213693952, {space} FROM (SELECT * FROM routed WHERE route = 'uncertain' ORDER BY {order} LIMIT {p.cap}))"""


def sqdist(a: str, b: str, dims: int) -> str:
    return "(" + " + ".join(f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in range(1, dims + 1)) + ")"


def clusters(pts: str, eps: str, least: str, dims: int, strict: bool = False, own: bool = True) -> str:
    """Of pts (id, v): nb, core, cl (id, cid), and placed (id, cluster_id, core)."""
    return f"""nb AS (SELECT a.id AS a, b.id AS b FROM {pts} a, {pts} b WHERE {sqdist('a.v', 'b.v', dims)} {'<' if strict else '<='} ({eps}) * ({eps}) * {1 - TOLERANCE if strict else 1 + TOLERANCE!r}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) - {0 if own else 1} >= {least}),
reach AS (SELECT id, id AS root FROM core UNION SELECT nb.b, reach.root FROM reach JOIN nb ON nb.a = reach.id JOIN core ON core.id = nb.b),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
cl AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM comp),
placed AS (SELECT q.id, CAST(coalesce(c.cid, (SELECT min(k.cid) FROM nb JOIN cl k ON k.id = nb.b WHERE nb.a = q.id), -1) AS INT) AS cluster_id, c.cid IS NOT NULL AS core FROM {pts} q LEFT JOIN cl c ON c.id = q.id)"""


def knee(pts: str, least: int, dims: int) -> str:
    """kd (id, kdist) and knee (eps)."""
    return f"""dist AS (SELECT a.id, sqrt({sqdist('a.v', 'b.v', dims)}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {sqdist('a.v', 'b.v', dims)}) AS rn FROM {pts} a, {pts} b),
kd AS (SELECT id, d AS kdist FROM dist WHERE rn = least({least}, greatest(1, (SELECT count(*) FROM {pts}) - 1))),
ranked AS (SELECT kdist, row_number() OVER (ORDER BY kdist) - 1 AS i, count(*) OVER () AS n, min(kdist) OVER () AS v0 FROM kd),
clip AS (SELECT *, greatest(4, CAST(floor(n * 0.9) AS INT)) AS clip FROM ranked),
dev AS (SELECT c.*, i / (clip - 1.0) - (kdist - v0) / ((SELECT kdist FROM clip WHERE i = clip - 1) - v0 + 1e-9) AS dev FROM clip c WHERE i < clip),
place AS (SELECT greatest(floor(any_value(n) / 10), least(arg_max(i, {{'d': dev, 'i': -i}}), floor(any_value(n) * 0.87))) AS spot FROM dev),
knee AS (SELECT kdist AS eps FROM ranked, place WHERE i = spot)"""


def clustered(p: Profile, scores: str = SCORES) -> str:
    radius = p.eps if scores is not SCORES else RADII[p.name] or p.eps
    dims = p.dims
    before = "" if radius else knee("pool", p.min_samples, dims) + ","
    eps = str(radius) if radius else "(SELECT eps FROM knee)"
    mean = lambda c: "[" + ", ".join(f"avg({c}[{k}])" for k in range(1, dims + 1)) + "]"
    space = {"scores": "scores", "votes": "votes", "margins": "margins"}[p.space]
    if p.centroid_from == "true":
        normal = f"SELECT {mean(space)} AS c FROM routed WHERE label = 4 HAVING count(*) > 0"
    else:
        normal = f"SELECT {mean('v')} AS c FROM pool WHERE NOT anchor AND (pred = 4 OR NOT EXISTS (SELECT 1 FROM pool WHERE NOT anchor AND pred = 4)) HAVING count(*) > 0"
    near = f"coalesce((SELECT {sqdist('m.centroid', 'c', dims)} FROM normal) < {p.near_normal**2}, false)"
    if p.unanchored == "distance":
        other = f"CASE WHEN {near} THEN 4 ELSE -2 END"
    elif p.unanchored == "votes_and_distance":
        won = "[" + ", ".join(" + ".join(f"CASE WHEN m.centroid[{k + 1}] {'>=' if c == a else '<'} 0 THEN 1 ELSE 0 END" for k, (a, b) in enumerate(PAIRS) if c in (a, b)) for c in TRAINED) + "]"
        sim = f"list_position({won}, list_max({won})) + {TRAINED[0] - 1}"
        other = f"CASE WHEN {sim} = 4 AND {near} THEN 4 ELSE {sim} END"
    else:
        other = f"CASE WHEN list_position(m.centroid, list_max(m.centroid)) + {TRAINED[0] - 1} = 4 AND {near} THEN 4 ELSE -2 END"
    return f"""{pool(p, scores)}, {before}
{clusters('pool', eps, p.min_samples, dims, p.strict, p.count_self)},
normal AS ({normal}),
members AS (SELECT pool.*, placed.cluster_id FROM pool JOIN placed ON placed.id = pool.id),
maj AS (SELECT cluster_id, arg_max(label, {{'n': n, 'l': -label}}) AS majority FROM (SELECT cluster_id, label, count(*) AS n FROM members WHERE anchor AND cluster_id >= 0 GROUP BY cluster_id, label) GROUP BY cluster_id),
m AS (SELECT cluster_id, count(*) AS size, count(*) FILTER (anchor) AS anchors, {mean('v')} AS centroid FROM members WHERE cluster_id >= 0 GROUP BY cluster_id),
labels_of AS (SELECT m.cluster_id, m.size, m.anchors, CAST(coalesce(maj.majority, {other}) AS INT) AS cluster_label FROM m LEFT JOIN maj ON maj.cluster_id = m.cluster_id)"""


def final(p: Profile, scores: str = SCORES) -> str:
    noise = "CASE WHEN r.route = 'uncertain' THEN r.pred ELSE -1 END" if p.noise_keeps else "-1"
    labelled = "CASE WHEN r.route = 'uncertain' AND l.cluster_label = -2 THEN r.pred ELSE l.cluster_label END" if p.unknown_keeps else "l.cluster_label"
    return f"""{clustered(p, scores)},
final AS (SELECT r.row_id, r.label, r.pred, r.conf, r.route, m2.cluster_id, CAST(CASE WHEN r.route = 'confident' THEN r.pred WHEN r.route = 'normal' THEN 4 WHEN m2.cluster_id IS NULL THEN {'-1' if p.overflow_novel else 'r.pred'}
  WHEN m2.cluster_id < 0 THEN {noise} ELSE {labelled} END AS INT) AS final
  FROM routed r LEFT JOIN members m2 ON m2.row_id = r.row_id LEFT JOIN labels_of l ON l.cluster_id = m2.cluster_id)"""


def prf(variant: str, digits: bool = True) -> str:
    keep = {"all": "true", "trained": f"label IN ({_IDS})", "restricted": f"label IN ({_IDS}) AND final IN ({_IDS})"}[variant]
    return f"""{final(PROFILES['thread'])},
counts AS (SELECT c.class_id, count(*) FILTER (label = class_id AND final = class_id) AS tp, count(*) FILTER (label <> class_id AND final = class_id) AS fp, count(*) FILTER (label = class_id AND final <> class_id) AS fn
  FROM (SELECT unnest([{_IDS}]) AS class_id) c, (SELECT * FROM final WHERE {keep}) GROUP BY c.class_id),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS rc FROM counts),
prf AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0) AS f1 FROM pr)"""


def rates(p: Profile) -> str:
    share = lambda a, b: f"round(coalesce(count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0), 0.0), 6)"
    trained, held = f"label IN ({_IDS})", f"label IN ({_HELD})"
    alarm = "final IN (-1, -2)" if p.name == "thread" else "final = -1"
    return f"""WITH RECURSIVE {final(p)} SELECT {share(f'{trained} AND label = final', trained)} AS accuracy_strict, {share(f'{trained} AND label = final', f'{trained} AND final IN ({_IDS})')} AS accuracy_restricted,
{share(f'{held} AND final = -1', held)} AS detection_novelty, {share(f'{held} AND label = final', held)} AS detection_identification, {share(f'label = 4 AND {alarm}', 'label = 4')} AS false_alarm FROM final"""


#: The pool of the thread profile in score space.
POINTS = f"{pool(PROFILES['thread'])}, pts AS (SELECT pool.id, sc.scores AS v FROM pool JOIN sc ON sc.row_id = pool.row_id)"
_DIRTY = """d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_orderkey % 83 = 0 THEN CAST('-inf' AS DOUBLE) ELSE l_extendedprice END AS price, l_quantity, l_returnflag AS label FROM lineitem),
c AS (SELECT * FROM d WHERE isfinite(price))"""
_SPLIT = f"""{ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SHUFFLED}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM e),
sp AS (SELECT row_id, label, CASE WHEN rn <= round(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r)"""


def _rank(where: str) -> str:
    return f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SHUFFLED}) AS rn FROM e) SELECT row_id, label FROM r WHERE {where}"


def _verdicts(scores: str = SCORES, kind: str = "margin", rule: str = "vote_margin", zero_first: bool = False, threshold: float = 0.5) -> str:
    """Verdicts of serving; margin verdicts with a score of zero for the second class are what most queries use."""
    return f"""{ballots(zero_first, scores)},
q0 AS (SELECT *, {best(rule)} AS place FROM bal),
q AS (SELECT row_id, scores, margins, CAST(place + {TRAINED[0] - 1} AS INT) AS pc, {conf(kind, 'place')} AS conf FROM q0),
qq AS (SELECT *, NOT conf > {threshold} AND pc <> 4 AS unsure, {name_of('pc')} AS name FROM q)"""


_SIM = "[" + ", ".join(" + ".join(f"CASE WHEN c[{k + 1}] {'>=' if t == a else '<'} 0 THEN 1 ELSE 0 END" for k, (a, b) in enumerate(PAIRS) if t in (a, b)) for t in TRAINED) + "]"


def p30(pts: str, dims: int, default: float) -> str:
    return f"radius AS (SELECT greatest(coalesce(quantile_cont(sqrt({sqdist('a.v', 'b.v', dims)}), 0.3), {default}), 1e-6) AS eps FROM {pts} a, {pts} b WHERE a.id < b.id)"


def online(verdicts: str, space: str = "scores") -> str:
    dims = 6 if space == "scores" else 4
    place = f"list_position({_SIM}, list_max({_SIM}))" if dims == 6 else "list_position(c, list_max(c))"
    return f"""{verdicts},
pts AS (SELECT row_id AS id, {space} AS v FROM qq WHERE unsure),
{p30('pts', dims, 0.5)},
{clusters('pts', '(SELECT eps FROM radius)', 'greatest(2, least(3, (SELECT count(*) FROM pts)))', dims)},
cen AS (SELECT cluster_id, [{', '.join(f'avg(v[{k}])' for k in range(1, dims + 1))}] AS c FROM pts JOIN placed USING (id) WHERE cluster_id >= 0 GROUP BY cluster_id),
named AS (SELECT cluster_id, {name_of(f'({place} + {TRAINED[0] - 1})')} AS cname FROM cen),
online AS (SELECT qq.row_id, qq.pc, CASE WHEN p.cluster_id >= 0 THEN concat(cname, ' (Cluster)') WHEN p.cluster_id < 0 THEN concat(name, ' (Outlier)') ELSE name END AS predicted_label, unsure AS is_uncertain, coalesce(p.cluster_id >= 0, false) AS is_novel, p.cluster_id
  FROM qq LEFT JOIN placed p ON p.id = qq.row_id LEFT JOIN named n ON n.cluster_id = p.cluster_id)"""


ONLINE = online(_verdicts())
#: Pair scores of the kernel model with a number of first rows of each class as support vectors.
def kernel(per_class: int) -> str:
    return f"""{MODEL}, sv AS (SELECT * FROM (SELECT label, x AS v, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM t) WHERE rn <= {per_class}), n AS (SELECT label, count(*) AS n FROM sv GROUP BY label),
s AS (SELECT e.row_id, any_value(e.label) AS label, p.pair, any_value(p.pos) AS pos, any_value(p.neg) AS neg, sum(CASE WHEN sv.label = p.pos THEN 1.0 ELSE -1.0 END / n.n * exp(-0.1 * pow(list_distance(e.x, sv.v), 2))) AS s FROM e, p JOIN sv ON sv.label IN (p.pos, p.neg) JOIN n ON n.label = sv.label GROUP BY e.row_id, p.pair),
sc AS (SELECT row_id, label, list(s ORDER BY pair) AS scores FROM s GROUP BY row_id, label)"""


PRETRAINED = f"""{_verdicts()},
model AS (SELECT label AS k, [{', '.join(f'avg(scores[{k}])' for k in range(1, 7))}] AS c FROM sc WHERE label IN ({_HELD}) GROUP BY label),
dd AS (SELECT row_id, sqrt({sqdist('scores', 'c', 6)}) AS d, k FROM qq, model WHERE unsure),
nn AS (SELECT row_id, min(d) AS d, arg_min(k, {{'d': d, 'k': k}}) AS k FROM dd GROUP BY row_id),
bound AS (SELECT median(d) AS m FROM nn),
pre AS (SELECT qq.row_id, CASE WHEN nn.d IS NULL THEN name WHEN nn.d <= m THEN concat(name, ' (Cluster)') ELSE concat(name, ' (Outlier)') END AS predicted_label, coalesce(nn.d > m, false) AS is_uncertain, coalesce(nn.d > m, false) AS is_novel,
  CAST(CASE WHEN nn.d <= m THEN nn.k WHEN nn.d > m THEN -1 END AS INT) AS cluster_id, round(nn.d, 6) AS distance FROM qq LEFT JOIN nn ON nn.row_id = qq.row_id, bound)"""
_REQUEST = """raw AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pl AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM raw),
ms AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM pl GROUP BY f),
pts AS (SELECT id, list((pl.v - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY f) AS v FROM pl JOIN ms USING (f) GROUP BY id)"""
PURE = f"""{_REQUEST}, {p30('pts', 64, 1.0)},
{clusters('pts', '(SELECT eps FROM radius)', 'greatest(2, least(5, (SELECT count(*) // 20 FROM pts)))', 64)},
cen AS (SELECT cluster_id, [{', '.join(f'avg(v[{k}])' for k in range(1, 65))}] AS c FROM pts JOIN placed USING (id) WHERE cluster_id >= 0 GROUP BY cluster_id),
far AS (SELECT pts.id, p.cluster_id, sqrt({sqdist('pts.v', 'c', 64)}) AS d FROM pts JOIN placed p USING (id) LEFT JOIN cen USING (cluster_id)),
pure AS (SELECT id AS row_id, CASE WHEN cluster_id < 0 THEN 'Unknown (Outlier)' ELSE 'Unknown (Cluster)' END AS predicted_label, cluster_id, cluster_id < 0 AS is_outlier,
  round(CASE WHEN cluster_id < 0 THEN 0.0 ELSE 1 - least(d / (max(d) OVER (PARTITION BY cluster_id) + 1e-6), 1.0) END, 6) AS confidence FROM far)"""

#: All vectors, by the discriminant with the cycle in its biases.
_UPLOADED = SCORES.replace("list_dot_product(x, w) + b AS s FROM e, lda", f"list_dot_product(x, w) + (b + {_CYCLE}) AS s FROM (SELECT vec_id + 1 AS row_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) u, lda")


def upload_parts() -> str:
    pct = lambda c: f"round(100 * count(*) FILTER ({c}) / count(*), 2)"
    parts = {"confident_predictions": "NOT is_uncertain", "uncertain_normal": "is_uncertain AND NOT is_novel AND contains(predicted_label, 'Normal')", "dbscan_verified_attacks": "contains(predicted_label, 'DBSCAN verified')", "novel_unknown_attacks": "is_novel"}
    rows = " UNION ALL ".join(f"SELECT 'part', '{k}', count(*) FILTER ({c}), {pct(c)} FROM online" for k, c in parts.items())
    return f"WITH RECURSIVE {online(_verdicts(_UPLOADED, 'votes', 'votes', False, 0.8))} SELECT 'class' AS kind, predicted_label AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS pct FROM online GROUP BY predicted_label UNION ALL {rows}"


#: Lines of text as rows, n from 0.
def text_lines(*values: str) -> str:
    return _values(list(enumerate(values)), "n, x")


def _logged(model: str, text: str) -> str:
    """The run log's fields, each by a pattern of its own."""
    number = lambda name, unit="": f"TRY_CAST(replace(regexp_extract(t, '(?:^|[^A-Za-z]){name}(?: \\([^)]*\\))?[:=] *([0-9][0-9,.]*){unit}', 1, 'i'), ',', '') AS DOUBLE)"
    times = {"train_ms": ("Train", "SVM training"), "predict_ms": ("Predict", "SVM prediction"), "dbscan_ms": ("DBSCAN", "DBSCAN"), "total_ms": ("Total", "Time")}
    short = {c: number("(?:Timing: )?" + a, " ms") for c, (a, _) in times.items()}
    cols = [f"TRY_CAST(regexp_extract(t, 'Accuracy: *([0-9.]+)%', 1) AS DOUBLE) AS accuracy", f"TRY_CAST(regexp_extract(t, 'Train Accuracy: *([0-9.]+)%', 1) AS DOUBLE) AS train_accuracy", "nullif(trim(regexp_extract(t, 'Technique:([^\n]*)', 1)), '') AS technique"]
    cols += [f"CAST({number(a, '(?:[^0-9,. ]| [^m]|$)')} AS BIGINT) AS {c}" for c, a in (("n_train", "Train"), ("n_test", "Test"), ("n_features", "Features"), ("n_classes", "Classes"))]
    cols += [f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in short.values())} THEN {short[c]} ELSE {number(b, ' ms')} END AS {c}" for c, (_, b) in times.items()]
    cols += [f"{number('GFLOPS')} AS gflops", *(f"CAST({number(a)} AS BIGINT) AS {c}" for c, a in (("flops", "FLOP Count"), ("confident", "Confident"), ("uncertain", "Uncertain"), ("clusters", "Clusters"), ("noise", "Noise")))]
    return f"SELECT {_literal(model)} AS model, {', '.join(cols)} FROM (SELECT {_literal(text)} AS t)"


_MODELS = f"models AS (SELECT * FROM {_values(MODELS, 'model, accuracy, total_ms, train_ms, predict_ms, gflops')})"
_LOG = f"lg AS (SELECT model, n, metric, TRY_CAST(value AS DOUBLE) AS v FROM {_values([(m, k, n, v) for k, (m, n, v) in enumerate(METRIC_LOG)], 'model, n, metric, value')} WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)"
_last = lambda *names: "arg_max(v, n) FILTER (metric IN (" + ", ".join(f"'{x}'" for x in names) + "))"

ORACLES = {
    "class_distribution": f"WITH {ROWS} SELECT label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM e GROUP BY label",
    "rare_class_filter": "SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) >= 150",
    "label_encode": "SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events",
    "clean_nonfinite": f"WITH {_DIRTY} SELECT label, count(*) AS n, round(sum(price), 2) AS total, sum(l_quantity) AS quantity FROM c GROUP BY label",
    "ingest": f"WITH {_DIRTY} SELECT label, count(*) AS n, round(max(price), 2) AS most, CAST(max(l_linenumber) AS DOUBLE) AS lines FROM c GROUP BY label",
    "feature_variance_mask": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance, var_pop({c}) > 1e-10 AS kept FROM lineitem" for c in LINE) + " UNION ALL SELECT 'constant', 0.0, false)",
    "standardize": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER ()), 6) AS {c}" for c in LINE) + " FROM lineitem",
    "class_weights": f"WITH {ROWS} SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM t GROUP BY label",
    "stratified_split": f"WITH {_SPLIT} SELECT * FROM sp",
    "undersample": _rank("rn <= CASE label WHEN 2 THEN 10 WHEN 3 THEN 15 WHEN 4 THEN 30 ELSE 2147483647 END"),
    "balanced_pair_sample": f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SHUFFLED}) AS rn FROM e WHERE label IN (2, 5)) SELECT row_id, label, CASE WHEN label = 2 THEN 1 ELSE -1 END AS y FROM r WHERE rn <= least(40, (SELECT count(*) FROM e WHERE label = 2), (SELECT count(*) FROM e WHERE label = 5))",
    "class_subsample": _rank("rn <= 20"),
    "first_n_cap": f"WITH {ROWS} SELECT row_id, label FROM e ORDER BY row_id LIMIT 100",
    "random_cap": f"WITH {ROWS} SELECT row_id, label FROM e ORDER BY {_SHUFFLED} LIMIT 100",
    "holdout_spill": f"WITH {_SPLIT} SELECT row_id, label, CASE WHEN label IN ({_HELD}) THEN 'test' ELSE split END AS part FROM sp",
    "remap_classes": f"WITH {ROWS} SELECT row_id, label, label - 2 AS internal_id FROM t",
    "class_names": f"SELECT vec_id AS row_id, {name_of('label')} AS name FROM embeddings",
    "pair_models_centroid": f"WITH {MODEL}, cen AS (SELECT pair, pos, neg, list(round(i.m - j.m, 6) ORDER BY i.f) AS w, round(-(sum(i.m * i.m) - sum(j.m * j.m)) / 2, 6) AS b FROM p JOIN mom i ON i.label = pos JOIN mom j ON j.label = neg AND j.f = i.f GROUP BY pair, pos, neg) SELECT * FROM cen",
    "pair_models_lda": f"WITH {MODEL} SELECT pair, pos, neg, list_transform(w, lambda x: round(x, 6)) AS w, round(b, 6) AS b FROM lda",
    "pair_scores": f"WITH {SCORES} SELECT row_id, pair, round(s, 6) AS score FROM s",
    "ovo_votes": f"WITH {ballots()} SELECT row_id, " + ", ".join(f"CAST(votes[{k + 1}] AS INT) AS v{c}" for k, c in enumerate(TRAINED)) + " FROM bal",
    "ovo_margins": f"WITH {ballots()} SELECT row_id, " + ", ".join(f"round(margins[{k + 1}], 6) AS m{c}" for k, c in enumerate(TRAINED)) + " FROM bal",
    "ovo_predict": f"WITH {ballots()} SELECT row_id, " + ", ".join(f"CAST({best(r)} + 1 AS INT) AS by_{r}" for r in ("votes", "vote_margin", "weighted")) + " FROM bal",
    "confidences": f"WITH {judged(PROFILES['openmp'])} SELECT row_id, " + ", ".join(f"round({conf(k, 'place')}, 6) AS by_{k}" for k in ("votes", "six", "margin")) + " FROM judged",
    "one_vs_all": f"WITH {SCORES} SELECT row_id, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS place, round(list_max(scores), 6) AS best FROM sc",
    "score_maps": f"WITH {ballots()} " + " UNION ALL ".join(f"SELECT row_id, '{NAMES[c]}' AS name, round(margins[{k + 1}], 6) AS margin FROM bal" for k, c in enumerate(TRAINED)),
    "rbf_scores": f"""WITH {MODEL}, sv AS (SELECT * FROM (SELECT label, x AS v, row_number() OVER (PARTITION BY label ORDER BY row_id) AS rn FROM t) WHERE rn <= 5), n AS (SELECT label, count(*) AS n FROM sv GROUP BY label)
SELECT e.row_id, p.pair, round(sum(CASE WHEN sv.label = pos THEN 1.0 ELSE -1.0 END / n.n * exp(-0.1 * pow(list_distance(e.x, sv.v), 2))), 6) AS score FROM e, p JOIN sv ON sv.label IN (pos, neg) JOIN n ON n.label = sv.label GROUP BY e.row_id, p.pair""",
    "rff_map": f"WITH {ROWS} SELECT row_id, CAST(j AS INT) AS j, round(sqrt(2 / 8.0) * cos(list_dot_product(x, list_transform(range(64), lambda f: sin(1.0 + 3 * j + 7 * f))) + 1.0 + sin(5.0 * j)), 6) AS z FROM e, range(8) r(j)",
    "fourier_model_files": f"WITH {ROWS} SELECT row_id, CAST(j AS INT) AS j, round(sqrt(2 / 8.0) * cos(list_dot_product(x, list_transform(range(64), lambda f: sin(1.0 + 3 * j + 7 * f))) + 1.0 + sin(5.0 * j)), 6) AS z FROM e, range(8) r(j)",
    "route_rows": f"WITH {routed(PROFILES['thread'])} SELECT row_id, pred, route FROM routed",
    "confusion_matrix": f"WITH RECURSIVE {final(PROFILES['mpi'])} SELECT label, final, count(*) AS n FROM final GROUP BY label, final",
    **{f"per_class_prf_{v}": f"WITH RECURSIVE {prf(v)} SELECT class_id, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM prf" for v in ("all", "trained", "restricted")},
    "macro_f1": f"WITH RECURSIVE {prf('trained')} SELECT round(avg(f1), 6) AS macro_f1 FROM prf",
    **{f"hybrid_final_{p.name}": f"WITH RECURSIVE {final(p)} SELECT row_id, label, pred, route, cluster_id, final FROM final" for p in PROFILES.values()},
    **{f"hybrid_rates_{p.name}": rates(p) for p in PROFILES.values()},
    "detection_by_class": f"WITH RECURSIVE {final(PROFILES['thread'])} SELECT label AS class_id, count(*) AS n, count(*) FILTER (label_ = final) AS identified, count(*) FILTER (final = -1) AS novel FROM (SELECT *, label AS label_ FROM final WHERE label IN ({_HELD})) GROUP BY ROLLUP (label)",
    "pool_breakdown": f"WITH RECURSIVE {final(PROFILES['thread'])} SELECT count(*) AS n, count(*) FILTER (label = final) AS n_right, count(*) FILTER (final IN ({_IDS}) AND label <> final) AS n_wrong, count(*) FILTER (final = 4) AS n_normal, count(*) FILTER (final = -1) AS n_novel, count(*) FILTER (final = -2) AS n_unknown FROM final WHERE route = 'uncertain'",
    "mean_confidence": f"WITH {judged(PROFILES['thread'])} SELECT round(avg(conf), 6) AS mean_confidence FROM judged",
    "quality_as_truth": "WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM labels) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall FROM c",
    "neighbour_counts": f"WITH {POINTS}, u AS (SELECT v, min(id) AS id, count(*) AS m FROM pts GROUP BY v) SELECT u.id, u.m, CAST(sum(w.m) AS BIGINT) AS n FROM u, u w WHERE {sqdist('u.v', 'w.v', 6)} <= 1.0 GROUP BY u.id, u.m",
    "dbscan_clusters": f"WITH RECURSIVE {POINTS}, {clusters('pts', '0.7', '5', 6)} SELECT * FROM placed",
    "dbscan_strict": f"WITH RECURSIVE {POINTS}, {clusters('pts', '0.7', '5', 6, True, False)} SELECT * FROM placed",
    "kth_distance": f"WITH {POINTS}, {knee('pts', 8, 6)} SELECT id, round(kdist, 6) AS kdist FROM kd",
    "knee_radius": f"WITH {POINTS}, {knee('pts', 8, 6)} SELECT round(eps, 6) AS eps FROM knee",
    "percentile_radius": f"WITH {POINTS}, {p30('pts', 6, 1.0)} SELECT round(eps, 6) AS eps FROM radius",
    "cluster_centroids": f"WITH RECURSIVE {POINTS}, {clusters('pts', '0.7', '5', 6)}, g AS (SELECT cluster_id, count(*) AS size, [{', '.join(f'avg(v[{k}])' for k in range(1, 7))}] AS c FROM pts JOIN placed USING (id) WHERE cluster_id >= 0 GROUP BY cluster_id) SELECT cluster_id, size, CAST(k AS INT) AS place, round(c[k + 1], 6) AS mean FROM g, range(6) r(k)",
    "nearest_centroid": f"WITH {MODEL}, cen AS (SELECT label, list(m ORDER BY f) AS c FROM mom GROUP BY label), d AS (SELECT row_id AS id, label, list_distance(x, c) AS d FROM (SELECT row_id, x FROM e), cen) SELECT id, arg_min(label, {{'d': d, 'l': label}}) AS cluster_id, round(min(d), 6) AS distance FROM d GROUP BY id",
    "cluster_labels": f"WITH RECURSIVE {clustered(PROFILES['thread'])} SELECT * FROM labels_of",
    "serve_plain": f"WITH {ballots(False)}, q AS (SELECT row_id, {best('votes')} AS place, votes FROM bal) SELECT row_id, CAST(place + 1 AS INT) AS predicted_class, {name_of('(place + 1)')} AS predicted_label, round(votes[place] / 3.0, 6) AS confidence FROM q",
    "serve_hybrid_online": f"WITH RECURSIVE {ONLINE} SELECT * EXCLUDE (pc) FROM online",
    "serve_hybrid_pretrained": f"WITH {PRETRAINED} SELECT * FROM pre",
    "serve_summary": f"""WITH RECURSIVE {ONLINE} SELECT count(*) AS n, count(*) FILTER (is_uncertain) AS n_uncertain, count(*) FILTER (is_novel) AS n_novel, count(*) FILTER (contains(predicted_label, 'DBSCAN verified')) AS n_verified, count(*) FILTER (contains(predicted_label, '(Cluster)')) AS n_clustered,
count(*) FILTER (contains(predicted_label, '(Outlier)')) AS n_outlier, count(*) FILTER (contains(predicted_label, 'Normal') AND is_uncertain AND NOT is_novel) AS n_uncertain_normal, round(100 * count(*) FILTER (contains(predicted_label, 'Normal')) / count(*), 2) AS pct_normal FROM online""",
    "serve_pure": f"WITH RECURSIVE {PURE} SELECT * FROM pure",
    "parse_config": f"""WITH l AS (SELECT trim(x) AS x, n FROM {text_lines("# run", "", "holdout_class_ids=0,1,6", "svm_class_ids = 2, 3,4,5", "n_test=756226", "note=a=b")} WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#') AND contains(x, '=')),
k AS (SELECT trim(split_part(x, '=', 1)) AS key, trim(substr(x, position('=' IN x) + 1)) AS value FROM l)
SELECT key, value, CASE WHEN ends_with(key, '_ids') THEN array_to_string(list_transform(string_split(value, ','), lambda v: trim(v)), ' ') END AS ids FROM k""",
    "parse_label_map": f"""WITH l AS (SELECT TRY_CAST(trim(split_part(x, ':', 1)) AS INT) AS id, trim(substr(x, position(':' IN x) + 1)) AS nm FROM {text_lines("0:Bots [HOLDOUT]", "2: DDoS", "x:none", "4:Normal:Traffic")} WHERE contains(x, ':'))
SELECT id AS class_id, trim(replace(nm, '[HOLDOUT]', '')) AS name, contains(nm, '[HOLDOUT]') AS holdout FROM l WHERE id IS NOT NULL""",
    "parse_upload": f"""WITH l AS (SELECT n, trim(x) AS x FROM {text_lines("", "a,b,c", "1,2,3,4", " 5 , 6,7", "8,9", "x,1,2")} WHERE trim(x) <> ''),
v AS (SELECT n, list_transform(string_split(x, ','), lambda y: TRY_CAST(trim(y) AS DOUBLE)) AS v FROM l)
SELECT CAST(n AS BIGINT) AS line_no, v[1] + v[2] + v[3] AS total FROM v WHERE NOT (n = (SELECT min(n) FROM l) AND list_count(v[1:5]) < len(v[1:5])) AND len(v) >= 3 AND list_count(v[1:3]) = 3""",
    "parse_pasted": f"""WITH l AS (SELECT n, trim(x) AS x FROM {text_lines("# block", "1, 2, x, 3", "", "4,5", "6,7,8,9")} WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#')),
v AS (SELECT n, list_filter(list_transform(string_split(x, ','), lambda y: TRY_CAST(trim(y) AS DOUBLE)), lambda y: y IS NOT NULL) AS v FROM l)
SELECT CAST(n AS BIGINT) AS line_no, v[1] + v[2] + v[3] AS total FROM v WHERE len(v) >= 3""",
    "parse_section": f"""WITH l AS (SELECT * FROM {text_lines("top", "== PortScan ==", "1,2", "end")})
SELECT CAST(n AS BIGINT) AS line_no, x AS value FROM l WHERE n >= coalesce((SELECT min(n) FROM l WHERE contains(x, 'PortScan')), 0)""",
    "parse_json_features": """WITH r AS (SELECT json_extract(body, '$.features') AS f FROM (VALUES ('{"model": "mpi", "features": [[1, 2.5], [3, 4]]}'), ('{"features": [5, 6]}')) v(body)),
w AS (SELECT CASE WHEN json_type(f, '$[0]') = 'ARRAY' THEN CAST(f AS DOUBLE[][]) ELSE [CAST(f AS DOUBLE[])] END AS x FROM r),
e AS (SELECT unnest(x) AS x, generate_subscripts(x, 1) - 1 AS i FROM w)
SELECT CAST(i AS INT) AS row_id, x[1] AS a, x[2] AS b FROM e""",
    "parse_metric_log": f"""WITH {_LOG}, f AS (SELECT model, {_last('accuracy_hybrid', 'accuracy')} AS a, arg_min(v, n) FILTER (metric IN ('macro_f1_hybrid', 'macro_f1', 'svm_confident_acc') AND v <> 0) AS b, coalesce({_last('macro_f1_hybrid', 'macro_f1')}, 0.0) AS m, coalesce({_last('n_test')}, 0) AS nt, coalesce({_last('n_clusters')}, 0) AS nc, {_last('holdout_detection_rate')} AS dr,
coalesce({_last('train_ms')}, 0.0) AS tr, coalesce({_last('predict_ms')}, 0.0) AS pr, coalesce({_last('dbscan_ms')}, 0.0) AS db, coalesce({_last('total_ms', 'total_time_ms')}, 0.0) AS tt, coalesce(sum(v) FILTER (metric IN ('gflops', 'svm_gflops', 'predict_gflops', 'dbscan_gflops')), 0.0) AS g FROM lg GROUP BY model)
SELECT model, round(100 * coalesce(nullif(a, 0), b, 0), 6) AS accuracy, round(m, 6) AS macro_f1, CAST(nt AS BIGINT) AS n_test, CAST(nc AS BIGINT) AS n_clusters, round(100 * dr, 6) AS detection_rate, round(tr, 6) AS train_ms, round(pr, 6) AS predict_ms, round(db, 6) AS dbscan_ms, round(tt, 6) AS total_ms, round(g, 6) AS gflops FROM f""",
    "best_epoch": f"SELECT epoch, train_loss, val_macro_f1 FROM {_values([tuple(map(float, e)) for e in EPOCHS], 'epoch, lr, train_loss, val_macro_f1')} WHERE val_macro_f1 > 0 ORDER BY val_macro_f1 DESC, epoch LIMIT 1",
    "registry_overview": f"WITH {_MODELS} SELECT count(*) AS n_models, round(avg(accuracy), 6) AS avg_accuracy, arg_max(model, accuracy) AS best_accuracy_model, arg_min(model, total_ms) FILTER (total_ms > 0) AS fastest_model, arg_max(model, gflops) AS best_gflops_model FROM models",
    "registry_comparison": f"WITH {_MODELS} SELECT list_position([{', '.join(repr(x) for x in ORDER)}], model) AS position, model, accuracy, round(train_ms / 1000, 6) AS train_s, round(predict_ms / 1000, 6) AS predict_s, round(total_ms / 1000, 6) AS total_s, gflops FROM models",
    "speedups": f"WITH {_MODELS}, b AS (SELECT l.model AS left_model, r.model AS right_model, l.total_ms AS lt, r.total_ms AS rt, l.gflops AS lg, r.gflops AS rg FROM {_values(COMPARED, 'a, b', 'c')} JOIN models l ON l.model = c.a JOIN models r ON r.model = c.b) SELECT left_model, right_model, 'total_ms' AS metric, lt AS left_value, rt AS right_value, round(greatest(lt, rt) / least(lt, rt), 6) AS ratio, CASE WHEN lt <= rt THEN left_model ELSE right_model END AS winner FROM b UNION ALL SELECT left_model, right_model, 'gflops', lg, rg, round(greatest(lg, rg) / least(lg, rg), 6), CASE WHEN lg >= rg THEN left_model ELSE right_model END FROM b",
    "cosine_rate": "SELECT CAST(e AS INT) AS epoch, round(0.001 + 0.5 * (0.05 - 0.001) * (1 + cos(pi() * e / 200)), 9) AS rate FROM range(200) r(e)",
    "prediction_distribution": f"WITH {judged(PROFILES['mpi'])} SELECT pred AS class_id, {name_of('pred')} AS name, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM judged GROUP BY pred",
    "epoch_errors": f"""WITH l AS (SELECT list_transform(string_split(x, ','), lambda y: TRY_CAST(trim(y) AS INT)) AS v FROM {text_lines("class_a,class_b,epoch,train_errors,n_train,val_errors,n_val", "2,3,0,10,100,5,20", "2,3,1,4,100,x,20", "2,4,0,0,0,1,4")})
SELECT v[1] AS class_a, v[2] AS class_b, v[3] AS epoch, v[4] AS train_errors, v[5] AS n_train, v[6] AS val_errors, v[7] AS n_val, coalesce(v[4] / nullif(v[5], 0), 0.0) AS train_error, coalesce(v[6] / nullif(v[7], 0), 0.0) AS val_error FROM l WHERE len(v) = 7 AND list_count(v) = 7""",
    "accuracy_csv": f"""WITH l AS (SELECT n, list_transform(string_split(x, ','), lambda y: TRY_CAST(trim(y) AS DOUBLE)) AS v FROM {text_lines("train,test", "0.93,0.91", "1,1")})
SELECT v[1] AS train_accuracy, v[2] AS test_accuracy FROM l WHERE len(v) = 2 AND list_count(v) = 2 ORDER BY n LIMIT 1""",
    "stream_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "parse_run_log": f"{_logged('a', LOG)} UNION ALL {_logged('b', 'Timing: Train=1.5 ms Predict=2 ms DBSCAN=3 ms Total=6.5 ms')}",
    "early_stopping": f"""WITH RECURSIVE e AS (SELECT epoch, f1, row_number() OVER (ORDER BY epoch) AS i FROM {_values([(e, float(f)) for e, _, _, f in EPOCHS], 'epoch, f1')}),
w AS (SELECT i, epoch, f1, f1 AS best, 0 AS since, false AS stopped FROM e WHERE i = 1
  UNION ALL SELECT e.i, e.epoch, e.f1, CASE WHEN NOT w.stopped AND e.f1 > w.best + 1e-4 THEN e.f1 ELSE w.best END, CASE WHEN w.stopped THEN w.since WHEN e.f1 > w.best + 1e-4 THEN 0 ELSE w.since + 1 END, w.stopped OR (e.f1 <= w.best + 1e-4 AND w.since + 1 >= 3) FROM w JOIN e ON e.i = w.i + 1)
SELECT CAST(epoch AS INT) AS epoch, f1, best, since, stopped FROM w""",
    "shown_labels": f"""WITH l AS (SELECT k, label, k % 2 = 0 AS unsure, k % 3 = 0 AS novel, 0.1 * k + 0.2 AS conf FROM {_values(list(enumerate(("Novel: DoS (Cluster 12)", "Cluster 3", "PortScan (Outlier)", "NormalTraffic", "Unknown (Outlier)", "DoS (Unverified)"))), 'k, label')})
SELECT k, CASE WHEN regexp_full_match(label, 'Cluster [0-9]+') THEN 'Unknown (Cluster)' ELSE regexp_replace(regexp_replace(label, '^Novel: ', ''), ' [(]Cluster [0-9]+[)]', ' (Cluster)') END AS shown,
replace(replace(label, ' (Unverified)', ''), ' (DBSCAN verified)', '') AS base,
CASE WHEN contains(label, 'Unknown') THEN 'unknown' WHEN contains(label, 'Unverified') OR (unsure AND NOT novel) THEN 'unverified' WHEN novel THEN 'novel' WHEN contains(label, 'Normal') AND conf < 0.5 THEN 'low-normal' WHEN contains(label, 'Normal') THEN 'normal' ELSE 'attack' END AS verdict FROM l""",
    **{f"hybrid_mixed_{p}": f"WITH RECURSIVE {final(mixed_profile(p), MIXED_SCORES)} SELECT row_id, label, pred, route, cluster_id, final FROM final" for p in PROFILES},
    "cluster_labels_mixed": f"WITH RECURSIVE {clustered(mixed_profile('thread'), MIXED_SCORES)} SELECT * FROM labels_of",
    "serve_kernel": f"WITH RECURSIVE {online(_verdicts(kernel(5), 'margin', 'weighted', True, KERNEL_THRESHOLD), 'margins')} SELECT row_id, pc AS predicted_class, predicted_label, is_uncertain, is_novel, cluster_id FROM online",
    "serve_csv": upload_parts(),
    "validation_clusters": f"WITH RECURSIVE {judged(PROFILES['cuda'], MIXED_SCORES)}, pts AS (SELECT row_id AS id, scores AS v FROM judged WHERE conf < 0.5 ORDER BY row_id LIMIT 35000), {clusters('pts', '0.35', '8', 6, True, False)} SELECT count(*) AS n_uncertain, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters, count(*) FILTER (cluster_id < 0) AS n_noise FROM placed",
    "cluster_counts": f"WITH RECURSIVE {POINTS}, {clusters('pts', '0.7', '5', 6)} SELECT count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS n_clusters, count(*) FILTER (cluster_id < 0) AS n_noise FROM placed",
    "gradient_sums": f"""WITH {SCORES}, h AS (SELECT s.*, e.x, CASE WHEN s.label = pos THEN 1 ELSE -1 END AS y, CASE s.label {' '.join(f'WHEN {c} THEN {w}' for c, w in CLASS_WEIGHTS['mpi'].items())} END AS cw FROM s JOIN e ON e.row_id = s.row_id WHERE s.label IN (pos, neg)),
g AS (SELECT pair, row_id, -cw * y AS pull, list_append(x, 1.0) AS x FROM h WHERE 1 - y * s > 0), f AS (SELECT pair, pull, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS place FROM g)
SELECT CAST(pair AS INT) AS pair, CAST(place AS INT) AS place, round(sum(pull * v), 4) AS gradient FROM f GROUP BY pair, place""",
    "rbf_scores_wide": f"WITH {kernel(30)} SELECT row_id, pair, round(s, 6) AS score FROM s",
    "feature_files": f"WITH {ROWS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, label, round(list_sum(list_transform(x, lambda v: round(v, 8))), 5) AS total FROM e",
    "prediction_files": f"WITH RECURSIVE {final(PROFILES['thread'])}, f AS (SELECT label, final FROM final) SELECT 0 AS format, CAST(NULL AS INT) AS original, final AS predicted, count(*) AS n FROM f GROUP BY final UNION ALL SELECT k, label, final, count(*) FROM f, range(1, 3) r(k) GROUP BY k, label, final",
    "metric_files": rates(PROFILES["thread"]),
    "linear_model_files": f"WITH {SCORES} SELECT row_id, pair, round(s, 6) AS score FROM s",
    "kernel_model_files": f"WITH {kernel(5)} SELECT row_id, pair, round(s, 6) AS score FROM s",
    "cluster_model_files": f"WITH {SCORES}, cen AS (SELECT label, [{', '.join(f'avg(scores[{k}])' for k in range(1, 7))}] AS c FROM sc WHERE label IN ({_IDS}) GROUP BY label), d AS (SELECT row_id AS id, cen.label AS k, sqrt({sqdist('scores', 'c', 6)}) AS d FROM sc, cen) SELECT id, arg_min(k, {{'d': d, 'k': k}}) AS cluster_id, round(min(d), 6) AS distance FROM d GROUP BY id",
    "scaler_state": " UNION ALL ".join(f"SELECT {k} AS position, '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS scale FROM lineitem" for k, c in enumerate(LINE)),
    "weight_lines": f"WITH {ROWS} SELECT printf('class_%d_weight=%.6f', label, sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS value FROM t GROUP BY label",
    "config_lines": f"WITH {ROWS}, l AS (SELECT * FROM {_values([('names', k, c) for k, c in enumerate(LINE)] + [('config', 0, 'holdout_class_ids=0,1,6'), ('config', 1, 'holdout_class_names=Bots,BruteForce,WebAttacks'), ('config', 2, 'svm_class_ids=2,3,4,5'), ('config', 3, 'svm_class_names=DDoS,DoS,NormalTraffic,PortScan'), ('config', 4, 'n_classes_total=7')], 'file, line_no, value')}) SELECT * FROM l UNION ALL SELECT 'config', 5, concat('n_test=', count(*)) FROM e",
    "epoch_log_lines": f"SELECT 0 AS line_no, 'epoch,lr,train_loss,val_macro_f1' AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY epoch) AS INT), concat_ws(',', epoch, lr, train_loss, val_macro_f1) FROM {_values([(e, *map(str, r)) for e, *r in EPOCHS], 'epoch, lr, train_loss, val_macro_f1')} UNION ALL SELECT {len(EPOCHS) + 1}, 'best_f1,0.81052'",
    "epoch_trailer": f"SELECT split_part(x, ',', 1) AS key, CAST(split_part(x, ',', 2) AS DOUBLE) AS value FROM {text_lines('epoch,lr,train_loss,val_macro_f1', '0,0.05,0.61,0.7', 'best_f1,0.81052')} WHERE len(string_split(x, ',')) = 2 AND TRY_CAST(split_part(x, ',', 2) AS DOUBLE) IS NOT NULL",
    "json_responses": f"""WITH {ballots(False)}, q AS (SELECT row_id, {best('votes')} AS place, votes FROM bal) SELECT row_id, concat('{{"row_id":', row_id, ',"predicted_class":', place + 1, ',"predicted_label":"', {name_of('(place + 1)')}, '"}}') AS body FROM q""",
    "served_models": f"SELECT m AS model, kind, threshold, m = 'mpi' AS loadable FROM {_values([('cuda', 'RFF-SVM', 0.5), ('mpi', 'Linear SVM', 0.8), ('openmp', 'Linear SVM', 0.6), ('thread', 'Kernel SVM', 1.0), ('pyspark', 'Kernel SVM', 0.5)], 'm, kind, threshold')}",
    "model_info": "SELECT 'mpi' AS model, 'Linear SVM' AS kind, CAST(len(any_value(embedding)) AS INT) AS n_features, CAST(count(DISTINCT label) FILTER (label BETWEEN 2 AND 5) AS INT) AS n_classes, 6 AS n_pairs, ['DDoS', 'DoS', 'NormalTraffic', 'PortScan'] AS classes, CAST(0.8 AS DOUBLE) AS threshold FROM embeddings",
    "latest_log": f"WITH l AS (SELECT * FROM {_values([('a/train_10.out', 'Total Train Time : 5 ms'), ('a/train_9.out', 'Total Train Time : 22,658.62 ms Effective GFLOPS : 63.085'), ('a/train_8.out', 'x')], 'path, t')}), m AS (SELECT * FROM l ORDER BY path DESC LIMIT 1) SELECT path, coalesce(TRY_CAST(replace(regexp_extract(t, 'Total Train Time : ([0-9.,]+) ms', 1), ',', '') AS DOUBLE), 0.0) AS total_ms, coalesce(TRY_CAST(regexp_extract(t, 'GFLOPS : ([0-9.]+)', 1) AS DOUBLE), 0.0) AS gflops FROM m",
    "wide_summary": f"WITH l AS (SELECT n, string_split(x, ',') AS v FROM {text_lines(*WIDE_SUMMARY.splitlines())}) SELECT v[1] AS technique, CAST(v[2] AS BIGINT) AS n_train, CAST(v[3] AS BIGINT) AS n_test, CAST(v[4] AS DOUBLE) AS accuracy, CAST(v[5] AS DOUBLE) AS total_ms FROM l WHERE n > 0 ORDER BY n DESC LIMIT 1",
    "vertical_summary": f"SELECT 'thread' AS model, key, TRY_CAST(value AS DOUBLE) AS value FROM {_values(VERTICAL_SUMMARY, 'key, value')}",
    "flop_models": "WITH n AS (SELECT count(*) AS n FROM embeddings), f AS (SELECT 'linear' AS what, n * 2 * 6 * 52 AS flops, n FROM n UNION ALL SELECT 'kernel', n * 600 * (3 * 52 + 2), n FROM n UNION ALL SELECT 'pairwise', n * n * 18, n FROM n) SELECT what, flops, round(flops / (250 * 1e6), 6) AS gflops, round(n * 1000.0 / 250, 6) AS rows_per_s FROM f",
    "shown_durations": f"SELECT k, CASE WHEN ms IS NULL OR ms = 0 THEN '\u2014' WHEN ms < 1000 THEN printf('%.0f ms', ms) WHEN ms < 60000 THEN printf('%.1f s', ms / 1000) ELSE printf('%.1f min', ms / 60000) END AS duration, CASE WHEN ms IS NULL THEN '\u2014' ELSE concat(format('{{:,}}', CAST(trunc(ms) AS BIGINT)), rtrim(rtrim(substr(printf('%.3f', ms - trunc(ms)), 2), '0'), '.')) END AS number FROM {_values(list(enumerate(DURATIONS)), 'k, ms')}",
    "legacy_bypass": f"WITH RECURSIVE {online(_verdicts().replace('AND pc <> 4 AS unsure', 'AS unsure'))} SELECT pc AS predicted_class, is_uncertain AND pc <> 4 AS is_uncertain, count(*) AS n FROM online GROUP BY ALL",
}
