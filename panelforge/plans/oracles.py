"""DuckDB SQL of the queries that SQL can express; independent of the Spark plans."""

from __future__ import annotations

TRACK = """track AS (
  SELECT l_partkey AS chr, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos, count(*) AS n,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS sw,
         CAST(sum(CAST(round(l_quantity) AS BIGINT) * (CAST(round(l_discount * 100) AS BIGINT) - 5)) AS BIGINT) AS swb
  FROM lineitem GROUP BY 1, 2)"""
GAPS = TRACK + """, gaps AS (SELECT *, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS gap FROM track),
clustered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps),
clusters AS (SELECT chr, CAST(cluster AS BIGINT) AS cluster, min(pos) AS "start", max(pos) AS "end", max(pos) - min(pos) + 1 AS width, count(*) AS n_probes, CAST(sum(sw) AS BIGINT) AS sw, CAST(sum(swb) AS BIGINT) AS swb FROM clustered GROUP BY 1, 2)"""
EVENTS = """ev AS (SELECT user_id AS chr, epoch_us(ts) // 1000000 AS pos, event_id AS probe, event_type FROM events)"""


def _spells(name: str, gap: int) -> str:
    return f"""{name}0 AS (SELECT *, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, probe) AS gap FROM ev),
{name}1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS cluster FROM {name}0),
{name} AS (SELECT chr, CAST(cluster AS BIGINT) AS id, min(pos) AS s, max(pos) AS e, count(*) AS n_probes FROM {name}1 GROUP BY 1, 2)"""


STEPPED = GAPS + """, sized AS (SELECT *, count(*) OVER (PARTITION BY chr, cluster) AS size, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS i, CAST((pos // 60) % 3 AS DOUBLE) AS theta FROM clustered),
keyed AS (SELECT *, CASE WHEN size >= 2 THEN cluster ELSE -i - 1 END AS k FROM sized),
breaks AS (SELECT *, CASE WHEN lag(theta) OVER w IS NULL OR abs(theta - lag(theta) OVER w) > 1e-6 OR k <> lag(k) OVER w THEN 1 ELSE 0 END AS b FROM keyed WINDOW w AS (PARTITION BY chr ORDER BY pos)),
runs AS (SELECT *, sum(b) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM breaks),
regions AS (SELECT chr, min(pos) AS "start", max(pos) AS "end", max(pos) - min(pos) + 1 AS width, count(*) AS n_probes, CAST(sum(swb) AS DOUBLE) / sum(sw) AS effect, sqrt(1.0 / sum(sw)) AS se, avg(theta) AS theta, min(i) AS probe_start, max(i) AS probe_end
  FROM runs GROUP BY chr, segment HAVING count(*) >= 2 AND sum(sw) > 0 AND abs(CAST(sum(swb) AS DOUBLE) / sum(sw)) >= 0.05)"""
ORDERS = """po AS (SELECT o_orderkey AS sample, o_custkey AS subject,
  (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - min(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) OVER (PARTITION BY o_custkey)) / 100.0 AS exposure,
  log2(o_totalprice) AS y, c_mktsegment AS platform FROM orders JOIN customer ON o_custkey = c_custkey)"""
PANEL = """emb AS (SELECT vec_id AS probe, CAST(label + 1 AS INTEGER) AS chr, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding FROM embeddings),
panel AS (SELECT probe, chr, CAST(r * 200 + (r // 8) * 5000 AS BIGINT) AS pos, embedding FROM emb)"""
LONG = PANEL + """, long AS (SELECT probe, chr, pos, CAST(i - 1 AS INTEGER) AS sample, (i - 1) // 4 AS subject, CAST((i - 1) % 4 AS DOUBLE) AS exposure, CASE WHEN i <= 40 THEN '450K' ELSE 'EPIC' END AS platform, CAST(embedding[i] AS DOUBLE) AS value FROM panel, range(1, 65) t(i))"""


def _fit(source: str, by: str, value: str, extra: str = "") -> str:
    keys = by.split(", ")
    return f"""dem AS (SELECT {by}, subject, exposure - avg(exposure) OVER (PARTITION BY {by}, subject) AS x, {value} - avg({value}) OVER (PARTITION BY {by}, subject) AS v FROM {source}{extra}),
g AS (SELECT {by}, count(*) AS n, count(DISTINCT subject) AS s, sum(x * x) AS xx, sum(x * v) AS xy, sum(v * v) AS yy, max(abs(x)) AS m FROM dem GROUP BY {', '.join(str(k + 1) for k in range(len(keys)))}),
f0 AS (SELECT {by}, n, s, n - s - 1 AS df, xy / xx AS beta, sqrt(greatest(yy - xy * xy / xx, 0) / (n - s - 1) / xx) AS se FROM g WHERE m > 1e-9 AND n - s - 1 > 0),
fits AS (SELECT *, CASE WHEN se > 0 THEN beta / se ELSE 0 END AS z FROM f0)"""


RESID = LONG + """, dm AS (SELECT probe, chr, pos, sample, value - avg(value) OVER (PARTITION BY probe, subject) AS v FROM long),
res AS (SELECT probe, chr, pos, list(v ORDER BY sample) AS r FROM dm GROUP BY 1, 2, 3),
adj AS (SELECT *, pos - lag(pos) OVER w AS gap, lag(r) OVER w AS p FROM res WINDOW w AS (PARTITION BY chr ORDER BY pos, probe)),
rho AS (SELECT probe, chr, pos, gap, CASE WHEN gap <= 1000 THEN CASE WHEN list_dot_product(r, r) * list_dot_product(p, p) > 0 THEN list_dot_product(r, p) / sqrt(list_dot_product(r, r) * list_dot_product(p, p)) ELSE 0 END END AS rho FROM adj)"""
COMETH = RESID + """, link AS (SELECT *, sum(CASE WHEN rho IS NULL OR rho < 0.20 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS run FROM rho),
sz AS (SELECT *, count(*) OVER (PARTITION BY chr, run) AS size FROM link),
ids AS (SELECT chr, run, row_number() OVER (ORDER BY chr, run) - 1 AS cluster FROM (SELECT DISTINCT chr, run FROM sz WHERE size >= 2)),
comethylated AS (SELECT sz.probe, sz.chr, sz.pos, coalesce(ids.cluster, -1) AS cluster FROM sz LEFT JOIN ids ON sz.chr = ids.chr AND sz.run = ids.run)"""
BETA = """gm AS (SELECT vec_id AS probe, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings),
geno AS (SELECT probe, CAST(i - 1 AS INTEGER) AS sample, (m[i] - list_min(m)) / (list_max(m) - list_min(m)) AS beta FROM gm, range(1, 65) t(i) WHERE list_max(m) > list_min(m)),
geno9 AS (SELECT probe, sample, round(beta, 9) AS beta FROM geno)"""
GROUPS = BETA + """, steps AS (SELECT *, beta - lag(beta) OVER (PARTITION BY probe ORDER BY beta, sample) AS step FROM geno9),
grouped AS (SELECT probe, sample, beta, CAST(sum(CASE WHEN step > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY probe ORDER BY beta, sample ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp, sample // 4 AS subject, CASE WHEN sample < 40 THEN '450K' ELSE 'EPIC' END AS platform FROM steps)"""
MANIFESTS = """pm AS (SELECT p_partkey AS probe, p_type AS design, p_brand || ';' || split_part(p_name, ' ', 1) AS gene, CAST(p_partkey % 24 + 1 AS VARCHAR) AS chr, p_partkey * 137 % 100000 AS pos FROM part),
ma AS (SELECT * FROM pm WHERE probe % 5 <> 0),
mb AS (SELECT probe, CASE WHEN probe % 11 = 0 THEN 'other' ELSE design END AS design, gene, chr, pos + CASE WHEN probe % 13 = 0 THEN 1 ELSE 0 END AS pos FROM pm WHERE probe % 7 <> 0)"""


def _digamma(x: str) -> str:
    """Digamma of an expression: the recurrence up to x + 12, then the asymptotic series."""
    y = f"({x} + 12)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) - {' - '.join(f'1 / ({x} + {k})' for k in range(12))})"


def _trigamma(x: str) -> str:
    y = f"({x} + 12)"
    return f"(1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9)) + {' + '.join(f'1 / pow({x} + {k}, 2)' for k in range(12))})"


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


TWO_ARRAYS = """lq AS (SELECT l_suppkey AS sample, l_partkey AS probe, round(l_quantity) AS q, CASE WHEN l_linenumber % 2 = 1 THEN 'Grn' ELSE 'Red' END AS side FROM lineitem),
scans AS (SELECT sample, probe, sum(q) * 1000 AS meth, sum(q) * 500 + 7 AS unmeth FROM lq GROUP BY 1, 2),
mids AS (SELECT sample, side, quantile_cont(q * 12, 0.5) AS mid FROM lq GROUP BY 1, 2),
sds AS (SELECT sample, side, mid, 1.4826 * quantile_cont(abs(q * 12 - mid), 0.5) AS sd FROM lq JOIN mids USING (sample, side) GROUP BY 1, 2, 3),
sides AS (SELECT sample, max(CASE WHEN side = 'Grn' THEN mid END) AS gm, max(CASE WHEN side = 'Grn' THEN sd END) AS gs, max(CASE WHEN side = 'Red' THEN mid END) AS rm, max(CASE WHEN side = 'Red' THEN sd END) AS rs FROM sds GROUP BY 1),
zs AS (SELECT scans.*, CASE probe % 3 WHEN 0 THEN (meth + unmeth - gm - rm) / (gs + rs) WHEN 1 THEN (meth + unmeth - 2 * gm) / (2 * gs) ELSE (meth + unmeth - 2 * rm) / (2 * rs) END AS z FROM scans JOIN sides USING (sample)),
ts AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zs),
us AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM ts),
det AS (SELECT sample, probe, meth, unmeth, CASE WHEN z >= 0 THEN u ELSE 1 - u END AS detp FROM us),
med AS (SELECT sample, (quantile_cont(log2(meth), 0.5) + quantile_cont(log2(unmeth), 0.5)) / 2 AS qc_mean, avg(CASE WHEN detp > 0.005 THEN 1.0 ELSE 0 END) AS frac_failed FROM det GROUP BY 1),
cn AS (SELECT sample, quantile_cont(CASE WHEN p_size % 24 = 23 THEN log2(meth + unmeth) END, 0.5) - quantile_cont(CASE WHEN p_size % 24 = 22 THEN log2(meth + unmeth) END, 0.5) AS yx FROM det JOIN part ON p_partkey = probe WHERE p_size % 24 >= 22 GROUP BY 1),
qc AS (SELECT med.*, qc_mean < 10.5 OR frac_failed > 0.025 AS sample_fail, CASE WHEN cn.sample IS NULL THEN NULL WHEN yx < 0.01 THEN 'F' ELSE 'M' END AS sex FROM med LEFT JOIN cn USING (sample)),
common AS (SELECT probe FROM scans GROUP BY 1 HAVING count(DISTINCT sample % 2) = 2),
good AS (SELECT det.* FROM det JOIN qc USING (sample) JOIN common USING (probe) WHERE NOT sample_fail)"""


ORACLES = {
    "gap_clusters_fixed": f'WITH {GAPS} SELECT chr, cluster, "start", "end", width, n_probes, {_r("CAST(swb AS DOUBLE) / sw", "effect")}, {_r("sqrt(1.0 / sw)", "se")} FROM clusters',
    "legacy_fixed_collapse": f'WITH {GAPS} SELECT count(*) AS n_clusters, {_r("quantile_cont(width, 0.5)", "median_width")}, {_r("quantile_cont(n_probes, 0.5)", "median_probes")} FROM clusters WHERE n_probes >= 2 AND width <= 120',
    "spacing_summary": f"""WITH {GAPS}, {EVENTS}, {_spells("sp", 21600)},
      a AS (SELECT 'lineitem' AS track, gap, 30 AS m FROM gaps WHERE gap IS NOT NULL UNION ALL SELECT 'events', gap, 21600 FROM (SELECT pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS gap FROM ev) WHERE gap IS NOT NULL),
      e2 AS (SELECT chr, count(*) AS n_probes FROM (SELECT chr, sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) AS gap FROM ev)) GROUP BY chr, c),
      c AS (SELECT 'lineitem' AS track, count(*) AS n_clusters, avg(CASE WHEN n_probes = 1 THEN 100.0 ELSE 0 END) AS s FROM clusters UNION ALL SELECT 'events', count(*), avg(CASE WHEN n_probes = 1 THEN 100.0 ELSE 0 END) FROM e2)
      SELECT a.track, count(*) AS n_gaps, {_r("quantile_cont(gap, 0.25)", "gap_q25")}, {_r("quantile_cont(gap, 0.5)", "gap_q50")}, {_r("quantile_cont(gap, 0.75)", "gap_q75")}, {_r("sum(CASE WHEN gap > m THEN 100.0 ELSE 0 END) / count(*)", "pct_beyond")}, any_value(n_clusters) AS n_clusters, {_r("any_value(s)", "pct_single")}
      FROM a JOIN c ON a.track = c.track GROUP BY a.track""",
    "gap_size_classes": f"WITH {GAPS} SELECT CASE WHEN n_probes >= 3 THEN '3+' ELSE CAST(n_probes AS VARCHAR) END AS size_class, count(*) AS clusters, CAST(sum(n_probes) AS BIGINT) AS probes FROM clusters GROUP BY 1",
    "distance_penalty": f"WITH {GAPS}, sc AS (SELECT chr, quantile_cont(CAST(sw AS DOUBLE), 0.5) AS s FROM gaps WHERE sw > 0 GROUP BY chr) SELECT gaps.chr, pos, gap, {_r('greatest(0.5 * s * exp(-gap / 60.0), 0.01)', 'lam')} FROM gaps JOIN sc ON gaps.chr = sc.chr WHERE gap IS NOT NULL",
    "region_calls_sql": f'WITH {STEPPED} SELECT chr, "start", "end", width, n_probes, {_r("effect", "effect")}, {_r("se", "se")}, {_r("effect / se", "z")}, theta, CAST(probe_start AS BIGINT) AS probe_start, CAST(probe_end AS BIGINT) AS probe_end FROM regions',
    "block_runs": f"""WITH {TRACK}, st AS (SELECT chr, pos AS s, pos + 1 AS e, CASE WHEN CAST(swb AS DOUBLE) / sw <= -1 THEN 0 WHEN CAST(swb AS DOUBLE) / sw >= 1 THEN 2 ELSE 1 END AS state FROM track),
      br AS (SELECT *, CASE WHEN lag(state) OVER w IS NULL OR state <> lag(state) OVER w THEN 1 ELSE 0 END AS b FROM st WINDOW w AS (PARTITION BY chr ORDER BY s)),
      rn AS (SELECT *, sum(b) OVER (PARTITION BY chr ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM br)
      SELECT chr, min(s) AS "start", max(e) AS "end", max(e) - min(s) + 1 AS width, count(*) AS n_clusters, CASE WHEN state = 2 THEN 'hyper' ELSE 'hypo' END AS direction, 0.875::DOUBLE AS posterior FROM rn WHERE state <> 1 GROUP BY chr, run, state HAVING count(*) >= 2""",
    "interval_overlap": f"""WITH {EVENTS}, {_spells("a", 86400)}, b AS (SELECT DISTINCT chr, pos // 604800 AS id FROM ev)
      SELECT a.chr, a.id AS a_id, b.id AS b_id, a.s AS a_start, a.e AS a_end, b.id * 604800 AS b_start, b.id * 604800 + 302400 AS b_end FROM a JOIN b ON a.chr = b.chr AND a.s <= b.id * 604800 + 302400 AND b.id * 604800 <= a.e""",
    "interval_containment": f"WITH {EVENTS}, {_spells('a', 21600)}, {_spells('b', 86400)} SELECT a.chr, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.chr = b.chr AND a.s >= b.s AND a.e <= b.e",
    "point_in_interval": f'WITH {EVENTS}, {_spells("b", 21600)} SELECT b.chr, b.id AS b_id, count(*) AS points, min(pos) AS "first", max(pos) AS "last" FROM ev JOIN b ON ev.chr = b.chr AND pos BETWEEN b.s AND b.e GROUP BY 1, 2',
    "region_ivw_effect": f"WITH {GAPS} SELECT chr || ':' || cluster AS region, {_r('CAST(swb AS DOUBLE) / sw', 'effect')}, {_r('sqrt(1.0 / sw)', 'se')}, n_probes AS n FROM clusters WHERE n_probes >= 2",
    "nearest_feature": f"""WITH {EVENTS}, q AS (SELECT chr, pos, probe AS q_id FROM ev WHERE event_type = 'purchase'), f AS (SELECT chr, pos AS fp FROM ev WHERE event_type = 'click'),
      j AS (SELECT q.chr, q_id, fp, abs(fp - pos) AS dd, row_number() OVER (PARTITION BY q_id ORDER BY abs(fp - pos), fp) AS k, sum(CASE WHEN abs(fp - pos) <= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id) AS w FROM q LEFT JOIN f ON q.chr = f.chr)
      SELECT chr, q_id, fp AS nearest_pos, dd AS distance, CAST(w AS BIGINT) AS within_near, coalesce(dd <= 3600, false) AS "close" FROM j WHERE k = 1""",
    "within_transform": f"WITH {ORDERS} SELECT sample, {_r('exposure - avg(exposure) OVER (PARTITION BY subject)', 'exposure_within')}, {_r('y - avg(y) OVER (PARTITION BY subject)', 'y_within')} FROM po",
    "identification_df": f"WITH {ORDERS}, x AS (SELECT *, exposure - avg(exposure) OVER (PARTITION BY platform, subject) AS xw FROM po) SELECT platform, count(*) AS n_samples, count(DISTINCT subject) AS n_subjects, CAST(CASE WHEN max(abs(xw)) > 1e-9 THEN count(*) - count(DISTINCT subject) - 1 ELSE 0 END AS BIGINT) AS df FROM x GROUP BY 1",
    "within_fit_orders": f"WITH {ORDERS}, {_fit('po', 'platform', 'y')} SELECT platform, {_r('beta', 'beta')}, {_r('se', 'se')}, {_r('z', 'z')}, df, n AS n_samples, s AS n_subjects FROM fits",
    "within_fit_simple": f"WITH {LONG}, {_fit('long', 'probe', 'value')} SELECT probe, {_r('beta', 'beta')}, {_r('se', 'se')}, {_r('z', 'z')}, df FROM fits",
    "adjacent_correlation": f"WITH {RESID} SELECT probe, chr, gap, {_r('rho', 'rho')} FROM rho WHERE rho IS NOT NULL",
    "comethylation_clusters": f"WITH {COMETH} SELECT probe, chr, pos, cluster FROM comethylated",
    "cluster_collapse": f"""WITH {COMETH} SELECT c.cluster, any_value(c.chr) AS chr, min(c.pos) AS "start", max(c.pos) AS "end", (min(c.pos) + max(c.pos)) / 2 AS mid, count(*) AS n_probes, {_r('avg(CAST(embedding[1] AS DOUBLE))', 'first_sample')}, {_r('avg(CAST(embedding[64] AS DOUBLE))', 'last_sample')} FROM comethylated c JOIN embeddings ON vec_id = c.probe WHERE c.cluster >= 0 GROUP BY 1""",
    "fold_assignment": """WITH s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject FROM orders),
      h AS (SELECT subject, list_reduce(list_transform(range(1, length('1:' || subject) + 1), lambda i: CAST(ascii(substr('1:' || subject, i, 1)) AS BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM s)
      SELECT subject, ntile(5) OVER (ORDER BY h, subject) - 1 AS fold FROM h""",
    "subject_hash": """SELECT CAST(c_custkey AS VARCHAR) AS subject, list_reduce(list_transform(range(1, length('1:' || c_custkey) + 1), lambda i: CAST(ascii(substr('1:' || c_custkey, i, 1)) AS BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM customer""",
    "permutation_within": f"""WITH {ORDERS}, r AS (SELECT sample, subject, exposure, row_number() OVER (PARTITION BY subject ORDER BY sample) AS place, row_number() OVER (PARTITION BY subject ORDER BY md5('7:0:' || sample), sample) AS dealt FROM po)
      SELECT t.sample, t.subject, {_r("g.exposure", "permuted")} FROM r t JOIN r g ON t.subject = g.subject AND t.place = g.dealt""",
    "permutation_naive": f"""WITH {ORDERS}, r AS (SELECT sample, subject, exposure, row_number() OVER (ORDER BY md5('7:place:' || sample), sample) AS place, row_number() OVER (ORDER BY md5('7:0:' || sample), sample) AS dealt FROM po)
      SELECT t.subject, count(*) AS n, {_r("sum(g.exposure)", "total")}, {_r("max(g.exposure)", "most")} FROM r t JOIN r g ON t.place = g.dealt GROUP BY 1""",
    "permutation_naive_all": f"""WITH {ORDERS}, r AS (SELECT sample, exposure, row_number() OVER (ORDER BY md5('7:place:' || sample), sample) AS place, row_number() OVER (ORDER BY md5('7:0:' || sample), sample) AS dealt FROM po)
      SELECT t.sample, {_r("t.exposure", "exposure")}, {_r("g.exposure", "permuted")} FROM r t JOIN r g ON t.place = g.dealt""",
    "subject_subsample": """WITH s AS (SELECT DISTINCT c_custkey AS subject FROM customer), k AS (SELECT CAST(r AS INTEGER) AS rep, subject, row_number() OVER (PARTITION BY r ORDER BY md5('1:' || r || ':' || subject), subject) AS k FROM s, range(10) t(r))
      SELECT rep, subject FROM k WHERE k <= (SELECT greatest(2, count(*) // 2) FROM s)""",
    "within_fit_covariates": f"""WITH {LONG}, dm AS (SELECT probe, exposure - avg(exposure) OVER w AS a, exposure * exposure - avg(exposure * exposure) OVER w AS b, value - avg(value) OVER w AS v FROM long WINDOW w AS (PARTITION BY probe, subject)),
      s AS (SELECT probe, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * v) AS av, sum(b * v) AS bv, sum(v * v) AS vv FROM dm GROUP BY 1),
      f AS (SELECT probe, (bb * av - ab * bv) / (aa * bb - ab * ab) AS beta, (aa * bv - ab * av) / (aa * bb - ab * ab) AS second, bb / (aa * bb - ab * ab) AS unit, av, bv, vv FROM s),
      e AS (SELECT probe, beta, sqrt(greatest(vv - beta * av - second * bv, 0) / 46 * unit) AS se FROM f)
      SELECT probe, {_r("beta", "beta")}, {_r("se", "se")}, {_r("beta / se", "z")}, CAST(46 AS BIGINT) AS df FROM e""",
    "moderated_variance": f"""WITH RECURSIVE {LONG}, {_fit("long", "probe", "value")},
      v AS (SELECT probe, beta, se * se * 80 AS s2 FROM fits),
      m AS (SELECT avg(ln(s2)) AS mean, var_samp(ln(s2)) AS var FROM v WHERE s2 > 0),
      t AS (SELECT mean - {_digamma("23.5")} + ln(23.5) AS e, var - {_trigamma("23.5")} AS target FROM m),
      h(k, lo, hi) AS (SELECT 0, ln(1e-3), ln(1e9) UNION ALL SELECT k + 1, CASE WHEN {_trigamma("exp((lo + hi) / 2)")} > (SELECT target FROM t) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_trigamma("exp((lo + hi) / 2)")} > (SELECT target FROM t) THEN hi ELSE (lo + hi) / 2 END FROM h WHERE k < 70),
      d AS (SELECT exp((lo + hi) / 2) AS half FROM h WHERE k = 70),
      p AS (SELECT target, 2 * half AS d0, CASE WHEN target <= 0 THEN exp(e) ELSE exp(e + {_digamma("half")} - ln(half)) END AS s0 FROM t, d),
      q AS (SELECT probe, beta, s2, CASE WHEN target <= 0 THEN s0 ELSE (d0 * s0 + 47 * s2) / (d0 + 47) END AS post FROM v, p)
      SELECT probe, {_r("s2", "s2")}, {_r("post", "s2_post")}, {_r("CASE WHEN post > 0 THEN beta / sqrt(post / 80) ELSE 0 END", "z")} FROM q""",
    "hwe_tail": f"""WITH a AS (SELECT p_partkey AS probe, p_partkey % 20 AS k, 2 * (p_size / 500.0) - (p_size / 500.0) * (p_size / 500.0) AS p FROM part),
      s AS (SELECT probe, sum(exp(lgamma(127) - lgamma(i + 1) - lgamma(127 - i) + i * ln(p) + (126 - i) * ln(1 - p))) AS t FROM a, range(0, 127) r(i) WHERE i >= k GROUP BY 1)
      SELECT a.probe, {_r("CASE WHEN k <= 0 THEN 1.0 ELSE least(1.0, t) END", "tail")} FROM a JOIN s ON a.probe = s.probe""",
    "fisher_group_array": f"""WITH {GROUPS}, k AS (SELECT probe, grp, count(*) AS n FROM grouped GROUP BY 1, 2), mn AS (SELECT probe, arg_min(grp, n * 1000 + grp) AS minor FROM k GROUP BY 1),
      c AS (SELECT g.probe, count(*) FILTER (grp = minor AND platform = '450K') AS a, count(*) FILTER (grp = minor AND platform = 'EPIC') AS b, count(*) FILTER (grp <> minor AND platform = '450K') AS c, count(*) FILTER (grp <> minor AND platform = 'EPIC') AS d FROM grouped g JOIN mn ON g.probe = mn.probe GROUP BY 1),
      l AS (SELECT probe, a, i, -(lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1)) AS lp FROM c, range(0, 65) r(i) WHERE i >= greatest(0, a - d) AND i <= least(a + b, a + c)),
      w AS (SELECT probe, i = a AS own, exp(lp - max(lp) OVER (PARTITION BY probe)) AS p FROM l),
      o AS (SELECT probe, max(p) FILTER (own) AS mine FROM w GROUP BY 1)
      SELECT w.probe, {_r("least(1.0, sum(CASE WHEN p <= mine * (1 + 1e-7) THEN p ELSE 0 END) / sum(p))", "p")} FROM w JOIN o ON w.probe = o.probe GROUP BY 1""",
    "residual_correlation": f"""WITH {LONG}, dm AS (SELECT probe, chr, pos, sample, exposure - avg(exposure) OVER w AS x, value - avg(value) OVER w AS v FROM long WINDOW w AS (PARTITION BY probe, subject)),
      fx AS (SELECT *, v - x * (sum(x * v) OVER (PARTITION BY probe) / sum(x * x) OVER (PARTITION BY probe)) AS e FROM dm),
      res AS (SELECT probe, chr, pos, list(e ORDER BY sample) AS r FROM fx GROUP BY 1, 2, 3),
      adj AS (SELECT *, pos - lag(pos) OVER w AS gap, lag(r) OVER w AS p FROM res WINDOW w AS (PARTITION BY chr ORDER BY pos, probe))
      SELECT probe, chr, gap, {_r("list_dot_product(r, p) / sqrt(list_dot_product(r, r) * list_dot_product(p, p))", "rho")} FROM adj WHERE gap <= 1000""",
    "documented_variants": "SELECT p_partkey AS probe, CAST(p_size % 24 AS VARCHAR) AS chr, p_partkey AS pos, p_size > 40 OR p_size < 5 AS documented_snp FROM part",
    "fwer_pvalues": f'WITH {STEPPED}, nl AS (SELECT k / 10 AS s FROM range(200) t(k)), p AS (SELECT chr, "start", (1 + (SELECT count(*) FROM nl WHERE s >= abs(round(effect / se, 3)))) / 201 AS p FROM regions) SELECT chr, "start", {_r("p", "p_fwer")}, {_r("sqrt(p * (1 - p) / 200)", "p_fwer_mcse")} FROM p',
    "fwer_borderline": f'WITH {STEPPED}, nl AS (SELECT k / 10 AS s FROM range(199) t(k)), p AS (SELECT (1 + (SELECT count(*) FROM nl WHERE s >= abs(round(effect / se, 3)))) / 200 AS p FROM regions), m AS (SELECT p, 2 * sqrt(p * (1 - p) / 199) AS e FROM p) SELECT CAST(sum(CASE WHEN p - e < 0.05 AND p + e > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS borderline FROM m',
    "bh_fdr": f"""WITH {TRACK}, p AS (SELECT chr, pos, 1000 / (1000 + abs(swb)) AS p FROM track), k AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p DESC) AS unused, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p),
      f AS (SELECT chr, pos, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM k) SELECT chr, pos, {_r("fdr", "fdr")} FROM f""",
    "cross_array_agreement": f"WITH {LONG}, {_fit('long', 'probe, chr, pos, platform', 'value')}, w AS (SELECT probe, max(CASE WHEN platform = '450K' THEN round(beta, 9) END) AS a, max(CASE WHEN platform = 'EPIC' THEN round(beta, 9) END) AS b FROM fits GROUP BY 1) SELECT count(*) AS n, {_r('corr(a, b)', 'r')}, {_r('avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0 END)', 'sign_concordance')} FROM w WHERE a IS NOT NULL AND b IS NOT NULL",
    "correlation_ci": f"""WITH {LONG}, {_fit('long', 'probe, chr, pos, platform', 'value')}, w AS (SELECT probe, chr, max(CASE WHEN platform = '450K' THEN round(beta, 9) END) AS a, max(CASE WHEN platform = 'EPIC' THEN round(beta, 9) END) AS b FROM fits GROUP BY 1, 2),
      g1 AS (SELECT chr, count(*) AS n, corr(a, b) AS r, avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0 END) AS s, 1.959963984540054 AS q FROM w GROUP BY 1)
      SELECT chr, n, {_r('r', 'r')}, {_r('tanh(atanh(r) - q / sqrt(n - 3))', 'r_lo')}, {_r('tanh(atanh(r) + q / sqrt(n - 3))', 'r_hi')},
        {_r('(s + q * q / (2 * n)) / (1 + q * q / n) - q * sqrt(s * (1 - s) / n + q * q / (4 * n * n)) / (1 + q * q / n)', 'sign_lo')}, {_r('(s + q * q / (2 * n)) / (1 + q * q / n) + q * sqrt(s * (1 - s) / n + q * q / (4 * n * n)) / (1 + q * q / n)', 'sign_hi')} FROM g1""",
    "common_footing": f"""WITH {LONG}, {_fit('long', 'probe, chr, pos, platform', 'value')}, f9 AS (SELECT probe, chr, pos, platform, round(beta, 9) AS beta, round(se, 9) AS se FROM fits),
      pg AS (SELECT probe, chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, probe) AS gap FROM panel), pc AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS c FROM pg),
      e AS (SELECT pc.chr, c, platform, sum(beta / (se * se)) / sum(1 / (se * se)) AS effect FROM pc JOIN f9 ON pc.probe = f9.probe WHERE se > 0 GROUP BY 1, 2, 3),
      w AS (SELECT max(CASE WHEN platform = '450K' THEN effect END) AS a, max(CASE WHEN platform = 'EPIC' THEN effect END) AS b FROM e GROUP BY chr, c)
      SELECT count(*) AS n, {_r('corr(a, b)', 'r')}, {_r('avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0 END)', 'sign_concordance')} FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
    "method_comparison": f"""WITH {STEPPED} SELECT 'gap' AS method, count(*) AS n, {_r('quantile_cont(width, 0.5)', 'median_width')}, CAST(sum(width) AS BIGINT) AS total_bp, {_r('quantile_cont(n_probes, 0.5)', 'median_probes')}, CAST(NULL AS BIGINT) AS n_fwer05 FROM clusters
      UNION ALL SELECT 'regions', count(*), round(quantile_cont(width, 0.5), 6), CAST(sum(width) AS BIGINT), round(quantile_cont(n_probes, 0.5), 6), CAST(sum(CASE WHEN abs(effect / se) > 10 THEN 1 ELSE 0 END) AS BIGINT) FROM regions""",
    "beta_to_m": f"WITH {BETA}, c AS (SELECT probe, sample, least(greatest(beta, 1e-6), 1 - 1e-6) AS b FROM geno) SELECT probe, sample, {_r('log2(b / (1 - b))', 'm')} FROM c",
    "exposure_coding": f"SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS DOUBLE) AS coded, {_r('avg(ln(1 + round(o_totalprice, 2)))', 'log1p_mean')}, {_r('avg(round(o_totalprice, 2) / 100)', 'scaled_mean')} FROM orders GROUP BY 1",
    "sample_qc": f"""WITH g AS (SELECT l_suppkey AS sample, quantile_cont(log2(l_extendedprice + 1), 0.5) AS m, quantile_cont(log2(l_quantity * 1000), 0.5) AS u, avg(CASE WHEN l_tax > 0.07 THEN 1.0 ELSE 0 END) AS f FROM lineitem GROUP BY 1)
      SELECT sample, {_r('m', 'm_med')}, {_r('u', 'u_med')}, {_r('f', 'frac_failed')}, {_r('(m + u) / 2', 'qc_mean')}, (m + u) / 2 < 14.3 OR f > 0.15 AS sample_fail FROM g""",
    "probe_filter_audit": """WITH fl AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax / 4 > 0.0199), a AS (SELECT p_partkey AS probe, l_partkey IS NOT NULL AS fail_detp, p_size % 10 IN (0, 1) AS is_sex, p_name LIKE '%bolt%' AS is_crossreactive, coalesce(p_size > 25 AND p_size / 1000 >= 0.045, false) AS dropped_snp FROM part LEFT JOIN fl ON p_partkey = l_partkey)
      SELECT *, NOT (fail_detp OR is_sex OR is_crossreactive OR dropped_snp) AS kept FROM a""",
    "probe_intersection": f"WITH {MANIFESTS} SELECT probe FROM ma INTERSECT SELECT probe FROM mb",
    "manifest_concordance": f"""WITH {MANIFESTS}, j AS (SELECT ma.design <> mb.design AS d, ma.gene <> mb.gene AS g, ma.chr <> mb.chr AS c, ma.pos <> mb.pos AS p FROM ma JOIN mb USING (probe)),
      s AS (SELECT count(*) AS n, sum(CAST(d AS INT)) AS d, sum(CAST(g AS INT)) AS g, sum(CAST(c AS INT)) AS c, sum(CAST(p AS INT)) AS p, sum(CAST(d OR g OR c OR p AS INT)) AS a FROM j)
      SELECT attribute, CAST(v AS BIGINT) AS discordant, {_r('v * 100.0 / n', 'pct')} FROM s, LATERAL (VALUES ('design', d), ('gene', g), ('chr', c), ('pos', p), ('any', a)) t(attribute, v)""",
    "annotate_left": f"WITH {MANIFESTS} SELECT ma.probe, ma.chr, CAST(ma.chr AS INTEGER) AS chr_num, ma.pos FROM ma JOIN mb USING (probe) WHERE mb.pos % 2 <> 0 AND CAST(ma.chr AS INTEGER) <= 22",
    "dropped_probes": f"WITH {MANIFESTS} SELECT probe, design FROM ma WHERE probe NOT IN (SELECT probe FROM mb)",
    "subject_semi": f"WITH {ORDERS} SELECT sample, subject FROM po WHERE subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "gene_filter": f"WITH {MANIFESTS}, x AS (SELECT probe, unnest(string_split(gene, ';')) AS g FROM ma WHERE regexp_matches(gene, '(^|;)Brand#1')) SELECT g, count(*) AS n, count(DISTINCT probe) AS probes FROM x GROUP BY 1",
    "manifest_sets": f"WITH {MANIFESTS}, u AS (SELECT 'union' AS part, probe FROM (SELECT probe FROM ma UNION SELECT probe FROM mb) UNION ALL SELECT 'only_a', probe FROM ma WHERE probe NOT IN (SELECT probe FROM mb) UNION ALL SELECT 'only_b', probe FROM mb WHERE probe NOT IN (SELECT probe FROM ma) UNION ALL SELECT 'both', probe FROM ma WHERE probe IN (SELECT probe FROM mb)) SELECT count(*) AS n, CAST(sum(probe) AS BIGINT) AS total, part FROM u GROUP BY part",
    "top_regions": f'WITH {STEPPED} SELECT chr, "start", {_r("round(abs(effect / se), 3)", "abs_z")} FROM regions ORDER BY abs_z DESC, chr, "start" LIMIT 10',
    "genotype_calls": f"WITH {BETA} SELECT probe, CAST(sum(CASE WHEN beta < 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS aa, CAST(sum(CASE WHEN beta BETWEEN 0.25 AND 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS ab, CAST(sum(CASE WHEN beta > 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS bb FROM geno9 GROUP BY 1",
    "pair_concordance": f"WITH {BETA}, c AS (SELECT probe, sample, CASE WHEN beta < 0.25 THEN 0 WHEN beta > 0.75 THEN 2 ELSE 1 END AS g FROM geno9) SELECT x.sample AS a, y.sample AS b, count(*) AS n, {_r('avg(CASE WHEN x.g = y.g THEN 1.0 ELSE 0 END)', 'concordance')} FROM c x JOIN c y ON x.probe = y.probe AND x.sample < y.sample GROUP BY 1, 2",
    "gap_partition": f"WITH {GROUPS} SELECT probe, grp, count(*) AS n, {_r('min(beta)', 'least')}, {_r('max(beta)', 'most')} FROM grouped GROUP BY 1, 2",
    "gaphunter": f"WITH {GROUPS}, k AS (SELECT probe, grp, count(*) AS n FROM grouped GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY probe) AS total FROM k) SELECT probe, count(*) AS n_groups, max(n) AS largest, CAST(any_value(total) AS BIGINT) AS n_samples FROM t WHERE n >= total * 0.03 GROUP BY 1 HAVING count(*) >= 2",
    "minor_group_profile": f"""WITH {GROUPS}, k AS (SELECT probe, grp, count(*) AS n FROM grouped GROUP BY 1, 2), mn AS (SELECT probe, arg_min(grp, n * 1000 + grp) AS minor, min(n) AS n_minor, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_samples FROM k GROUP BY 1),
      s AS (SELECT g.probe, subject, sum(CAST(grp = minor AS INT)) AS k, count(*) AS n FROM grouped g JOIN mn ON g.probe = mn.probe GROUP BY 1, 2),
      ss AS (SELECT probe, count(*) AS n_subjects, count(*) FILTER (k > 0) AS minor_subjects, count(*) FILTER (k > 0 AND k < n) AS straddlers, string_agg(lpad(CAST(subject AS VARCHAR), 4, '0') || ': ' || k || ' of ' || n, '; ' ORDER BY subject) FILTER (k > 0) AS summary FROM s GROUP BY 1),
      tp AS (SELECT probe, {_r('CAST(max(n) AS DOUBLE) / sum(n)', 'top_share')} FROM (SELECT g.probe, platform, count(*) AS n FROM grouped g JOIN mn ON g.probe = mn.probe AND grp = minor GROUP BY 1, 2) GROUP BY 1)
      SELECT mn.probe, n_minor, n_groups, n_samples, n_subjects, minor_subjects, straddlers, summary, top_share FROM mn JOIN ss ON mn.probe = ss.probe JOIN tp ON mn.probe = tp.probe""",
    "variance_explained": f"""WITH {BETA}, d AS (SELECT probe, beta - avg(beta) OVER (PARTITION BY probe, sample // 4) AS a, beta - avg(beta) OVER (PARTITION BY probe, sample < 40) AS b, beta - avg(beta) OVER (PARTITION BY probe) AS t FROM geno)
      SELECT probe, {_r('1 - sum(a * a) / sum(t * t)', 'r2_subject')}, {_r('1 - sum(b * b) / sum(t * t)', 'r2_array')} FROM d GROUP BY 1""",
    "group_chip_chi2": f"""WITH {GROUPS}, o AS (SELECT probe, grp, platform, count(*) AS o FROM grouped GROUP BY 1, 2, 3), r AS (SELECT probe, grp, sum(o) AS r FROM o GROUP BY 1, 2), c AS (SELECT probe, platform, sum(o) AS c FROM o GROUP BY 1, 2), n AS (SELECT probe, sum(o) AS n FROM o GROUP BY 1),
      x AS (SELECT r.probe, r.grp, c.platform, coalesce(o, 0) AS o, CAST(r AS DOUBLE) * c / n AS e, n FROM r JOIN c ON r.probe = c.probe JOIN n ON r.probe = n.probe LEFT JOIN o ON o.probe = r.probe AND o.grp = r.grp AND o.platform = c.platform)
      SELECT probe, CAST(any_value(n) AS BIGINT) AS n, {_r('sum((o - e) * (o - e) / e)', 'chi2')}, (count(DISTINCT grp) - 1) * (count(DISTINCT platform) - 1) AS dof FROM x GROUP BY 1""",
    "hwe_expected": f"WITH a AS (SELECT p_partkey AS probe, p_size / 100.0 AS m FROM part) SELECT probe, {_r('2 * m - m * m', 'carriers')}, {_r('126 * (2 * m - m * m)', 'expected')} FROM a",
    "f64_roundtrip": f"SELECT vec_id AS probe, row_number() OVER (ORDER BY vec_id) - 1 AS row, {_r('list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))', 'total')}, CAST(len(embedding) AS INTEGER) AS samples FROM embeddings",
    "strict_json": """SELECT '{"s_suppkey":' || s_suppkey || ',"v":' || CASE WHEN s_suppkey % 3 = 2 THEN '0.5' ELSE 'null' END || '}' AS json FROM supplier""",
    "event_sessions": f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, round(value, 2) AS value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n, {_r('sum(value)', 'total')} FROM c GROUP BY user_id, k""",
    "gap_histogram": f"WITH {GAPS} SELECT CASE WHEN gap <= 10 THEN '<=10' WHEN gap <= 30 THEN '<=30' WHEN gap <= 100 THEN '<=100' WHEN gap <= 300 THEN '<=300' WHEN gap <= 1000 THEN '<=1000' WHEN gap <= 3000 THEN '<=3000' ELSE '>3000' END AS gap_class, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY 1",
    "first_rows": f"WITH {TRACK} SELECT chr, pos, n FROM track WHERE chr IN (SELECT p_partkey FROM part WHERE p_size < 10) ORDER BY pos, chr LIMIT 2000",
    "harmonised_panel": f"""WITH li AS (SELECT l_suppkey AS sample, l_partkey AS probe, sum(round(l_quantity)) * 1000 AS meth, sum(round(l_quantity)) * 500 + 7 AS unmeth, min(l_tax) / 4 AS detp FROM lineitem GROUP BY 1, 2),
      q AS (SELECT sample, (quantile_cont(log2(meth), 0.5) + quantile_cont(log2(unmeth), 0.5)) / 2 AS m, avg(CASE WHEN detp > 0.0199 THEN 1.0 ELSE 0 END) AS f FROM li GROUP BY 1),
      k AS (SELECT li.* FROM li JOIN q ON li.sample = q.sample WHERE NOT (m < 10.5 OR f > 0.5)), bad AS (SELECT DISTINCT probe FROM k WHERE detp > 0.0199),
      b AS (SELECT probe, least(greatest(meth / (meth + unmeth + 100), 1e-6), 1 - 1e-6) AS b FROM k WHERE probe NOT IN (SELECT probe FROM bad))
      SELECT b.probe, CAST(p_size % 24 AS VARCHAR) AS chr, CAST(count(*) AS INTEGER) AS samples, {_r("avg(log2(b / (1 - b)))", "mean_m")} FROM b JOIN part ON p_partkey = b.probe GROUP BY 1, 2""",
    "harmonised_arrays": f"""WITH {TWO_ARRAYS}, b AS (SELECT probe, least(greatest(meth / (meth + unmeth + 100), 1e-6), 1 - 1e-6) AS b FROM good WHERE probe NOT IN (SELECT probe FROM good WHERE detp > 0.005))
      SELECT probe, 'chr' || CAST(p_size % 24 AS VARCHAR) AS chr, CAST(count(*) AS INTEGER) AS samples, {_r("avg(log2(b / (1 - b)))", "mean_m")} FROM b JOIN part ON p_partkey = probe WHERE p_size % 24 < 22 GROUP BY 1, 2""",
    "harmonised_samples": f"""WITH {TWO_ARRAYS} SELECT sample, CASE WHEN sample % 2 = 0 THEN '450K' ELSE 'EPIC' END AS "array", {_r("qc_mean", "qc_mean")}, {_r("frac_failed", "frac_failed")}, sample_fail, sex AS predicted_sex,
      sex <> CASE WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex_mismatch FROM qc LEFT JOIN supplier ON s_suppkey = sample""",
    "group_audit": f"""WITH {GROUPS}, c AS (SELECT probe, grp, count(*) AS n FROM grouped GROUP BY 1, 2),
      m AS (SELECT probe, arg_min(grp, n * 1000 + grp) AS minor, min(n) AS n_minor, count(*) AS n_groups FROM c GROUP BY 1),
      e AS (SELECT g.probe, subject, any_value(n_minor) AS n_minor, any_value(n_groups) AS n_groups, count(*) AS n, count(*) FILTER (grp = minor) AS k FROM grouped g JOIN m ON m.probe = g.probe GROUP BY 1, 2),
      a AS (SELECT probe, any_value(n_groups) AS n_groups, any_value(n_minor) AS n_minor, count(*) AS n_subjects, count(*) FILTER (k > 0) AS ms, count(*) FILTER (k > 0 AND k < n) AS st FROM e GROUP BY 1),
      h AS (SELECT *, CASE WHEN n_groups >= 3 THEN pow((probe % 45 + 1) / 100.0, 2) ELSE 2 * ((probe % 45 + 1) / 100.0) - pow((probe % 45 + 1) / 100.0, 2) END AS p FROM a),
      t AS (SELECT h.probe, sum(CASE WHEN i >= ms THEN exp(lgamma(n_subjects + 1) - lgamma(i + 1) - lgamma(n_subjects - i + 1) + i * ln(p) + (n_subjects - i) * ln(1 - p)) ELSE 0 END) AS up,
             sum(CASE WHEN i <= ms THEN exp(lgamma(n_subjects + 1) - lgamma(i + 1) - lgamma(n_subjects - i + 1) + i * ln(p) + (n_subjects - i) * ln(1 - p)) ELSE 0 END) AS down FROM h, range(0, 17) r(i) WHERE i <= n_subjects GROUP BY 1),
      f AS (SELECT h.*, n_groups >= 2 AND n_minor >= 2 AS flagged, least(1.0, 2 * least(up, down)) AS pf FROM h JOIN t ON t.probe = h.probe)
      SELECT probe, n_groups, n_minor, n_subjects, ms AS minor_subjects, st AS straddlers, flagged, CASE WHEN flagged THEN st = 0 END AS invariant, CASE WHEN flagged THEN {_r('pf', 'x').replace(' AS x', '')} END AS p_freq, CASE WHEN flagged THEN pf >= 0.05 END AS freq_ok FROM f""",
    "method_agreement": f"""WITH {LONG}, {_fit('long', 'probe, chr, pos, platform', 'value')}, f9 AS (SELECT probe, chr, pos, platform, round(beta, 9) AS beta, round(se, 9) AS se FROM fits),
      pg AS (SELECT probe, chr, pos, pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos, probe) AS gap FROM panel), pc AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) AS c FROM pg),
      reg AS (SELECT chr, c, max(pos) - min(pos) + 1 AS width, count(*) AS n FROM pc GROUP BY 1, 2),
      own AS (SELECT pc.chr, c, avg(CASE WHEN platform = '450K' THEN beta END) AS a, avg(CASE WHEN platform = 'EPIC' THEN beta END) AS b FROM pc JOIN f9 ON pc.probe = f9.probe GROUP BY 1, 2),
      e AS (SELECT pc.chr, c, platform, sum(beta / (se * se)) / sum(1 / (se * se)) AS effect FROM pc JOIN f9 ON pc.probe = f9.probe WHERE se > 0 GROUP BY 1, 2, 3),
      w AS (SELECT max(CASE WHEN platform = '450K' THEN effect END) AS a, max(CASE WHEN platform = 'EPIC' THEN effect END) AS b FROM e GROUP BY chr, c),
      one AS (SELECT count(*) AS n_regions, count(*) FILTER (n >= 8) AS n_fwer05, count(*) FILTER (reg.c % 2 = 0) AS naive, quantile_cont(width, 0.5) AS mw, quantile_cont(n, 0.5) AS mp, sum(width) AS bp, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS nx, corr(a, b) AS r, avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0 END) AS s FROM reg JOIN own ON reg.chr = own.chr AND reg.c = own.c),
      two AS (SELECT count(*) AS nc, corr(a, b) AS rc, avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0 END) AS sc FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
      SELECT 'gap' AS method, 'region' AS level, n_regions, n_fwer05, {_r('mw', 'median_width_bp')}, {_r('mp', 'median_n_probes')}, {_r('rc', 'cross_array_r_common')}, {_r('sc', 'sign_concordance_common')}, {_r('r', 'cross_array_r')}, {_r('s', 'sign_concordance')},
        CAST(19.0 AS DOUBLE) AS null_q95_max_abs_z, CAST(bp AS DOUBLE) AS total_bp, nx AS n_cross_array, CAST(NULL AS DOUBLE) AS runtime_s, CAST(NULL AS BIGINT) AS n_clusters, nc AS n_cross_array_common, naive AS n_fwer05_naive_perm, CAST(9.5 AS DOUBLE) AS null_q95_naive_perm FROM one, two""",
}
