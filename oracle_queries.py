"""SQL that states the expected result of every named query, for an independent engine."""

from __future__ import annotations

import re
import zlib

from incidentlake.functions import vocab
from incidentlake.schema import SEVERITY_INDEX

INCIDENTS = """
base AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS cust, o.o_orderpriority AS priority, o.o_orderdate AS day,
    n.n_name, r.r_name, d.text AS doc_text, e.label AS emb_label,
    CASE WHEN o.o_orderkey % 53 = 0 THEN NULL ELSE CAST(year(o.o_orderdate) - o.o_orderkey % 90 AS INTEGER) END AS year,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL WHEN o.o_orderkey % 31 = 0 THEN 0.0e0
         ELSE CAST(1 + o.o_custkey % 200 AS DOUBLE) END AS aboard
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
  LEFT JOIN embeddings e ON e.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings)),
f AS (SELECT *, CASE WHEN id % 23 = 0 THEN NULL
        ELSE CAST(floor(aboard * (CAST(id % 11 AS DOUBLE) / 10.0e0)) AS DOUBLE) END AS fatalities FROM base),
g AS (SELECT *, CASE WHEN aboard > 0 THEN fatalities / aboard END AS fatality_rate FROM f),
incidents AS (
  SELECT id,
    CASE WHEN year IS NULL THEN NULL ELSE CAST(year AS VARCHAR) || substr(CAST(CAST(day AS DATE) AS VARCHAR), 5) END AS date,
    n_name AS location,
    CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 0 THEN ''
         WHEN priority = '1-URGENT' THEN 'Military - ' || n_name
         WHEN priority = '2-HIGH' THEN 'Private Charter ' || n_name ELSE 'Airline ' || n_name END AS operator,
    CASE WHEN id % 3 = 0 THEN NULL ELSE r_name || ' - ' || n_name END AS route,
    CASE cust % 8 WHEN 0 THEN 'Boeing 747-206B' WHEN 1 THEN 'Cessna 208B' WHEN 2 THEN 'Bell 206'
         WHEN 3 THEN 'ATR 72-500' WHEN 4 THEN 'Douglas DC-3' WHEN 5 THEN 'Beech 1900D' WHEN 6 THEN '' END AS aircraft_type,
    aboard, fatalities, CASE WHEN id % 17 = 0 THEN 3.0e0 ELSE 0.0e0 END AS ground, year, fatality_rate,
    CASE WHEN fatality_rate IS NULL THEN 'Unknown' WHEN fatalities = 0 THEN 'Minor'
         WHEN fatality_rate < 0.1e0 THEN 'Moderate' WHEN fatality_rate < 0.5e0 THEN 'Severe' ELSE 'Fatal' END AS severity_label,
    CAST(CASE WHEN emb_label >= 8 THEN -1 ELSE emb_label END AS INTEGER) AS cluster_id,
    CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 101 AS DOUBLE) / 7.0e0 END AS proj_x,
    CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(id % 89 AS DOUBLE) / 7.0e0 END AS proj_y,
    CASE id % 7 WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'Weather|Fire' WHEN 2 THEN 'Human Error' WHEN 3 THEN 'Unknown'
         WHEN 4 THEN 'Navigation' END AS extracted_cause_category,
    CASE id % 7 WHEN 0 THEN 'Takeoff' WHEN 1 THEN 'Landing | Approach' WHEN 2 THEN 'Cruise' WHEN 3 THEN 'Unknown'
         WHEN 4 THEN 'Descent' END AS extracted_phase_of_flight,
    CASE WHEN id % 19 = 0 THEN NULL ELSE doc_text || ' ' ||
      CASE id % 16 WHEN 0 THEN 'All 12 passengers were killed.' WHEN 1 THEN 'There were no survivors.'
        WHEN 2 THEN 'Engine failure on takeoff.' WHEN 3 THEN 'Crashed into a mountain in fog.'
        WHEN 4 THEN 'The crew survived and escaped.' WHEN 5 THEN 'Inflight fire.' WHEN 6 THEN 'Wing separated, broke apart.'
        WHEN 7 THEN 'No fatalities.' WHEN 8 THEN 'Minor injuries only.' WHEN 9 THEN 'Written off.' ELSE '' END END AS summary
  FROM g)"""

ALL = (
    "id, date, location, operator, route, aircraft_type, aboard, fatalities, ground, year, fatality_rate, severity_label,"
    " cluster_id, proj_x, proj_y, extracted_cause_category, extracted_phase_of_flight, summary"
)
LISTED = "id, date, location, operator, aircraft_type, fatalities, severity_label, cluster_id, aboard, summary"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return ", ".join(q(v) for v in values)


def words(preset: str, side: int, column: str) -> str:
    return "regexp_matches(lower(coalesce(%s, '')), %s)" % (column, q("|".join(vocab.OPERATOR_WORDS[preset][side])))


def category(preset: str) -> str:
    return (
        f"CASE WHEN {words(preset, 0, 'operator')} THEN 'Military' WHEN {words(preset, 1, 'operator')} THEN 'Private'"
        " ELSE 'Commercial' END"
    )


def found(column: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({column}, '')), {q(pattern)})"


def summary_flag(name: str) -> str:
    return found("summary", vocab.SUMMARY_PATTERNS[name])


RATE = "sum(fatalities) / nullif(sum(aboard), 0)"
SUM_FAT = "coalesce(sum(fatalities), 0.0e0)"
SUM_ABOARD = "coalesce(sum(aboard), 0.0e0)"


# --- clusters --------------------------------------------------------------------

def ranked(value: str, name: str) -> str:
    return f"""
{name}_n AS (SELECT cluster_id, {value} AS v, count(*) AS n FROM incidents WHERE {value} IS NOT NULL GROUP BY 1, 2),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, v) AS rk FROM {name}_n),
{name} AS (SELECT cluster_id, string_agg(v, '; ' ORDER BY rk) AS names FROM {name}_r WHERE rk <= 5 GROUP BY 1)"""


STATS = f"""{ranked('operator', 'ops')}, {ranked('aircraft_type', 'crafts')}, {ranked('severity_label', 'sev')},
stats AS (
  SELECT c.cluster_id AS cluster_label, c.incident_count, c.avg_fatality_rate, c.avg_fatalities,
    s.v AS dominant_severity, coalesce(o.names, '') AS top_operators, coalesce(a.names, '') AS top_aircraft_types,
    c.year_range_start, c.year_range_end
  FROM (SELECT cluster_id, count(*) AS incident_count, round(avg(fatality_rate), 4) AS avg_fatality_rate,
          round(avg(fatalities), 2) AS avg_fatalities, min(year) AS year_range_start, max(year) AS year_range_end
        FROM incidents GROUP BY 1) c
  LEFT JOIN sev_r s ON s.cluster_id = c.cluster_id AND s.rk = 1
  LEFT JOIN ops o ON o.cluster_id = c.cluster_id LEFT JOIN crafts a ON a.cluster_id = c.cluster_id)"""

YEAR_RANGE = "coalesce(CAST(year_range_start AS VARCHAR), 'None') || '–' || coalesce(CAST(year_range_end AS VARCHAR), 'None')"

DENSITY = """
located AS (SELECT id, CAST(floor(proj_x / 0.2e0) AS BIGINT) AS a, CAST(floor(proj_y / 0.2e0) AS BIGINT) AS b FROM incidents),
cells AS (SELECT a, b, count(*) AS n FROM located WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
dense AS (SELECT * FROM cells WHERE n >= 5),
reach AS (
  SELECT a AS ra, b AS rb, a, b FROM dense
  UNION
  SELECT reach.ra, reach.rb, d.a, d.b FROM reach JOIN dense d
    ON d.a BETWEEN reach.a - 1 AND reach.a + 1 AND d.b BETWEEN reach.b - 1 AND reach.b + 1),
root AS (SELECT a, b, min((ra, rb)) AS root FROM reach GROUP BY 1, 2),
side AS (
  SELECT c.a, c.b, d.a AS da, d.b AS db, row_number() OVER (PARTITION BY c.a, c.b ORDER BY d.n DESC, d.a, d.b) AS rk
  FROM cells c JOIN dense d ON d.a BETWEEN c.a - 1 AND c.a + 1 AND d.b BETWEEN c.b - 1 AND c.b + 1 WHERE c.n < 5),
member AS (
  SELECT a, b, root FROM root
  UNION ALL SELECT s.a, s.b, r.root FROM side s JOIN root r ON s.da = r.a AND s.db = r.b WHERE s.rk = 1),
rows_in AS (SELECT l.id, m.root FROM located l LEFT JOIN member m ON l.a = m.a AND l.b = m.b),
sized AS (SELECT root, count(*) AS size, min(id) AS low FROM rows_in WHERE root IS NOT NULL GROUP BY 1 HAVING count(*) >= 15),
numbered AS (SELECT root, row_number() OVER (ORDER BY size DESC, low) - 1 AS label FROM sized),
labels AS (SELECT r.id, CAST(coalesce(n.label, -1) AS INTEGER) AS cluster_id FROM rows_in r LEFT JOIN numbered n ON r.root = n.root)"""


# --- evaluation -------------------------------------------------------------------

def predicted(order: tuple[str, ...]) -> str:
    value = {
        "kw_no_fatalities": "Minor", "kw_no_survivors": "Fatal", "kw_all_killed": "Fatal",
        "kw_survived": "Moderate", "kw_engine": "Severe",
    }
    return "CASE " + " ".join(f"WHEN {summary_flag(k)} THEN {q(value[k])}" for k in order) + " ELSE 'Fatal' END"


RULES = ("kw_no_fatalities", "kw_no_survivors", "kw_all_killed", "kw_survived", "kw_engine")


def cm(name: str, order: tuple[str, ...]) -> str:
    return f"""
{name}_p AS (SELECT severity_label AS actual, {predicted(order)} AS predicted FROM incidents),
{name} AS (
  SELECT a.c AS actual, p.c AS predicted,
    (SELECT count(*) FROM {name}_p x WHERE x.actual = a.c AND x.predicted = p.c) AS n
  FROM (SELECT unnest([{lst(SEVERITY_INDEX)}]) AS c) a, (SELECT unnest([{lst(SEVERITY_INDEX)}]) AS c) p),
{name}_r AS (
  SELECT label, hits, support, claimed, coalesce(hits / nullif(claimed, 0), 0) AS prec, coalesce(hits / nullif(support, 0), 0) AS rec,
    coalesce(2.0e0 * hits / nullif(support + claimed, 0), 0) AS f1
  FROM (SELECT actual AS label, max(n) FILTER (WHERE actual = predicted) AS hits, CAST(sum(n) AS BIGINT) AS support,
          (SELECT CAST(sum(n) AS BIGINT) FROM {name} y WHERE y.predicted = z.actual) AS claimed
        FROM {name} z GROUP BY actual) t),
{name}_m AS (
  SELECT round(coalesce(sum(hits) / nullif(sum(support), 0), 0), 4) AS accuracy,
    round(sum(prec * support) / sum(support), 4) AS precision_weighted,
    round(sum(rec * support) / sum(support), 4) AS recall_weighted,
    round(sum(f1 * support) / sum(support), 4) AS f1_weighted,
    round(avg(CASE WHEN support > 0 OR claimed > 0 THEN f1 END), 4) AS f1_macro,
    CAST(sum(support) AS BIGINT) AS test_samples FROM {name}_r)"""


CM = cm("cm", RULES)
CM2 = cm("cm2", RULES[::-1])
RUNS = f"""{CM}, {CM2},
runs AS (
  SELECT CAST(1 AS BIGINT) AS run_id, * FROM cm_m UNION ALL SELECT CAST(2 AS BIGINT), * FROM cm2_m)"""


# --- statistics ----------------------------------------------------------------------

def corr_rows(cols, complete: bool) -> str:
    if complete:
        source = "(SELECT * FROM nums WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"
    else:
        source = "nums"
    cells = []
    for a in cols:
        for b in cols:
            # Adding 0 turns a rounded -0.0 into the 0.0 it equals.
            r = "1.0e0" if a == b else f"(SELECT round(corr({a}, {b}), 4) + 0.0e0 FROM {source})"
            cells.append(f"SELECT {q(a)} AS var1, {q(b)} AS var2, {r} AS r")
    return " UNION ALL ".join(cells)


NUMS = """nums AS (SELECT aboard, fatalities, ground, CAST(year AS DOUBLE) AS year, fatality_rate,
  aboard - fatalities AS survival_count FROM incidents)"""
SIX = ("aboard", "fatalities", "ground", "year", "fatality_rate", "survival_count")


def chi(name: str, source: str, column: str) -> str:
    return f"""
{name}_c AS (SELECT severity_label AS a, {column} AS b, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1, 2),
{name}_g AS (
  SELECT ra.a, cb.b, coalesce(c.n, 0) AS o, ra.t * cb.t / CAST((SELECT sum(n) FROM {name}_c) AS DOUBLE) AS e
  FROM (SELECT a, CAST(sum(n) AS DOUBLE) AS t FROM {name}_c GROUP BY 1) ra
  CROSS JOIN (SELECT b, CAST(sum(n) AS DOUBLE) AS t FROM {name}_c GROUP BY 1) cb
  LEFT JOIN {name}_c c ON c.a = ra.a AND c.b = cb.b),
{name} AS (SELECT sum((o - e) * (o - e) / e) AS x, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM {name}_g),
{name}_p AS (
  SELECT x, dof, list_sum(list_transform(range(0, dof // 2), lambda i: exp(i * ln(x / 2) - x / 2 - lgamma(i + 1)))) AS p FROM {name})"""


def chi_row(name: str, title: str, column: str) -> str:
    return f"""SELECT {q(title)} AS test, round(x, 4) AS chi2, round(p, 6) AS p_value, dof, p < 0.05 AS significant,
  CASE WHEN p < 0.05 THEN 'Significant' ELSE 'No significant' END || ' association between severity_label and {column} (p='
    || printf('%.4f', p) || ')' AS interpretation FROM {name}_p"""


CHI_ROWS = f"""
marked AS (SELECT severity_label, operator, {category('short')} AS operator_category,
  CASE WHEN year IS NOT NULL THEN CAST(year - year % 10 AS VARCHAR) || 's' END AS decade FROM incidents),
top10 AS (SELECT operator FROM marked WHERE operator IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, operator LIMIT 10),
in_top AS (SELECT * FROM marked WHERE operator IN (SELECT operator FROM top10))"""


# --- features -------------------------------------------------------------------------

def num(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0e0 ELSE 0.0e0 END"


def first_part(column: str) -> str:
    return f"trim(split_part(coalesce({column}, 'Unknown'), '|', 1))"


def feature_sql() -> str:
    cat = category("full")
    cols = {
        "year": "CAST(year AS DOUBLE)", "aboard": "aboard", "log_aboard": "round(ln(1 + coalesce(aboard, 0)), 10)",
        "ground": "ground", "ground_flag": num("ground > 0"), "cluster_id": "CAST(coalesce(cluster_id, -1) AS DOUBLE)",
        "decade": "CAST(year - year % 10 AS DOUBLE)",
        "month": "CAST(coalesce(month(try_cast(date AS DATE)), 6) AS DOUBLE)",
        "has_route": num(f"trim(coalesce(route, ''), {WHITE}) <> ''"), "is_military": num(f"{cat} = 'Military'"),
        "is_private": num(f"{cat} = 'Private'"), "has_summary": num("coalesce(summary, '') <> ''"),
        "aircraft_era": "CASE WHEN year IS NULL THEN 2.0e0 WHEN year < 1940 THEN 0.0e0 WHEN year < 1958 THEN 1.0e0"
                        " WHEN year < 1970 THEN 2.0e0 WHEN year < 1990 THEN 3.0e0 ELSE 4.0e0 END",
        "aboard_severity_bin": "CASE WHEN coalesce(aboard, 1) <= 4 THEN 3.0e0 WHEN aboard <= 19 THEN 2.0e0"
                               " WHEN aboard <= 99 THEN 1.0e0 ELSE 0.0e0 END",
        "is_solo": num("coalesce(aboard, 0) = 1"),
    }
    for name, pattern in vocab.AIRCRAFT_PATTERNS.items():
        cols[name] = num(found("aircraft_type", pattern))
    for v in vocab.CAUSE_FEATURES:
        cols["cause_" + v.lower().replace(" ", "_")] = num(f"{first_part('extracted_cause_category')} = {q(v)}")
    for v in vocab.PHASE_FEATURES:
        cols["phase_" + v.lower()] = num(f"{first_part('extracted_phase_of_flight')} = {q(v)}")
    for name in vocab.SUMMARY_PATTERNS:
        cols[name] = num(summary_flag(name))
    cols["has_cause_extracted"] = num("coalesce(extracted_cause_category, 'Unknown') <> 'Unknown'")
    cols["has_phase_extracted"] = num("coalesce(extracted_phase_of_flight, 'Unknown') <> 'Unknown'")
    signal = " + ".join(f"{n} * {w}.0e0" for n, w in vocab.DEATH_SIGNAL_WEIGHTS.items())
    inner = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    return f"SELECT *, greatest({signal}, 0.0e0) AS death_signal_score FROM (SELECT id AS incident, {inner} FROM incidents) x"


SPLIT = f"""
order_in AS (
  SELECT *, row_number() OVER (PARTITION BY severity_label ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS rn,
    count(*) OVER (PARTITION BY severity_label) AS total FROM incidents WHERE severity_label IN ({lst(SEVERITY_INDEX)})),
cut1 AS (SELECT *, CAST(floor(total * 0.2e0 + 0.5e0) AS BIGINT) AS t FROM order_in),
split AS (SELECT *, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + CAST(floor((total - t) * 0.15e0 + 0.5e0) AS BIGINT) THEN 'val'
  ELSE 'train' END AS split FROM cut1)"""

# --- text -------------------------------------------------------------------------------

TFIDF = f"""
toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: NOT list_contains([{lst(vocab.STOP_WORDS)}], w)) AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(w) AS term FROM toks
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
vocabulary AS (
  SELECT term, count(*) AS document_count, CAST(sum(tf) AS BIGINT) AS frequency,
    ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY 3 DESC, 1 LIMIT 600),
raw_w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_w)"""


# --- vectors ---------------------------------------------------------------------------

def components_sql(count: int) -> str:
    """Principal components of the unit vectors: power iteration by squaring the covariance, deflated after each one."""
    last = "step = 20"  # the matrix to the power of 2 ** 20
    return f"""
u AS (
  SELECT vec_id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)),
part AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
mean AS (SELECT i, avg(x) AS m FROM part GROUP BY i),
off AS (SELECT vec_id, i, x - m AS x FROM part JOIN mean USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM u) AS v FROM off a JOIN off b USING (vec_id) GROUP BY ALL),
line AS (SELECT i, list(v ORDER BY j) AS line FROM cov GROUP BY i),
power(k, step, a, b, v) AS (
  SELECT 0, 0, a, a, CAST(NULL AS DOUBLE[]) FROM (SELECT list(line ORDER BY i) AS a FROM line)
  UNION ALL
  SELECT CASE WHEN {last} THEN k + 1 ELSE k END, CASE WHEN {last} THEN 0 ELSE step + 1 END,
    CASE WHEN {last} THEN rest ELSE a END, CASE WHEN {last} THEN rest ELSE squared END, CASE WHEN {last} THEN w END
  FROM (
    SELECT *, CASE WHEN {last} THEN [[a[i][j] - size * w[i] * w[j] FOR j IN range(1, len(w) + 1)] FOR i IN range(1, len(w) + 1)] END AS rest
    FROM (
      SELECT *, CASE WHEN {last} THEN list_inner_product(w, [list_inner_product(x, w) FOR x IN a]) END AS size,
        CASE WHEN NOT {last} THEN [[list_inner_product(x, y) / (trace * trace) FOR y IN b] FOR x IN b] END AS squared
      FROM (
        SELECT *, [x / sqrt(list_inner_product(top, top)) FOR x IN top] AS w FROM (
          SELECT *, b[list_position(diagonal, list_max(diagonal))] AS top, list_sum(diagonal) AS trace FROM (
            SELECT *, [b[i][i] FOR i IN range(1, len(b) + 1)] AS diagonal FROM power WHERE k < {count})))))),
axis AS (
  SELECT CAST(k - 1 AS INT) AS idx, [x * sign(v[list_position([abs(y) FOR y IN v], list_max([abs(y) FOR y IN v]))]) FOR x IN v] AS w
  FROM power WHERE v IS NOT NULL),
placed AS (SELECT vec_id, idx, round(list_inner_product(v, w), 4) AS r FROM u, axis),
reduced AS (SELECT vec_id, idx, CASE WHEN r = 0 THEN 0.0e0 ELSE r END AS value FROM placed)"""


SIGNS = [[1 if zlib.crc32(f"{j}:{i}".encode()) & 1 else -1 for i in range(64)] for j in range(12)]
VECTOR_CLUSTERS = f"""
signed AS (SELECT vec_id, [CAST(floor(list_inner_product(CAST(embedding AS DOUBLE[]), s) / {{width}} + 0.5e0) AS BIGINT)
    FOR s IN CAST({SIGNS} AS DOUBLE[][])] AS cell FROM embeddings WHERE len(embedding) = 64),
cells AS (SELECT cell, count(*) AS n, min(vec_id) AS low FROM signed GROUP BY cell),
bands AS (SELECT low, n, g, list_concat(cell[1:g * 4], cell[g * 4 + 5:]) AS rest FROM cells, range(0, 3) AS t(g)),
hubs AS (SELECT g, rest, min((-n, low)) AS best FROM bands WHERE n >= 5 GROUP BY g, rest),
near AS (SELECT b.low, b.n, h.best, h.best[2] AS hub FROM bands b JOIN hubs h USING (g, rest)),
both_ways AS (SELECT low AS a, hub AS b FROM near WHERE n >= 5 UNION SELECT hub, low FROM near WHERE n >= 5),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
roots AS (SELECT a AS low, min(b) AS root FROM reach GROUP BY a),
via AS (SELECT low, min(best)[2] AS hub FROM near WHERE n < 5 GROUP BY low),
member AS (SELECT low, root FROM roots UNION ALL SELECT v.low, r.root FROM via v JOIN roots r ON r.low = v.hub),
sizes AS (SELECT root, sum(n) AS size, min(low) AS first FROM member JOIN cells USING (low) GROUP BY root HAVING sum(n) >= 15),
named AS (SELECT root, row_number() OVER (ORDER BY size DESC, first) - 1 AS label FROM sizes),
labelled AS (SELECT cell, label FROM cells JOIN member USING (low) JOIN named USING (root))"""


# --- prompts ---------------------------------------------------------------------------

def fill(template: str, **values: str) -> str:
    parts = re.split("(" + "|".join("\\{%s\\}" % n for n in values) + ")", template)
    return " || ".join(values[p[1:-1]] if p[1:-1] in values and p.startswith("{") else q(p) for p in parts if p)


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)"


def names_text(column: str, chars: int) -> str:
    return f"CASE WHEN {column} = '' THEN 'Various' ELSE substr(replace({column}, '; ', ', '), 1, {chars}) END"


def cluster_texts(chars: int) -> str:
    return f"""
texts AS (
  SELECT cluster_id, summary, row_number() OVER (PARTITION BY cluster_id ORDER BY fatalities DESC NULLS LAST, id) AS rk
  FROM incidents WHERE summary IS NOT NULL AND cluster_id <> -1),
best AS (
  SELECT cluster_id, string_agg('[' || rk || '] ' || substr(trim(summary, {WHITE}), 1, {chars})
    || CASE WHEN length(summary) > {chars} THEN '...' ELSE '' END, chr(10) || chr(10) ORDER BY rk) AS summaries
  FROM texts WHERE rk <= {vocab.SAMPLES_PER_CLUSTER} GROUP BY 1)"""


def filled_prompt(chars: int) -> str:
    return fill(
        vocab.CLUSTER_PROMPT, count="CAST(incident_count AS VARCHAR)", year_start="CAST(year_range_start AS VARCHAR)",
        year_end="CAST(year_range_end AS VARCHAR)", severity="dominant_severity",
        fatality_rate="printf('%.1f%%', coalesce(avg_fatality_rate, 0) * 100)", operators=names_text("top_operators", chars),
        aircraft=names_text("top_aircraft_types", chars), summaries="summaries",
    )


EXPECTED_CAUSE = """CASE id % 7 WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'Weather' WHEN 2 THEN 'Human Error' WHEN 4 THEN 'Navigation' ELSE 'Unknown' END"""
EXPECTED_PHASE = """CASE id % 7 WHEN 0 THEN 'Takeoff' WHEN 1 THEN 'Landing' WHEN 2 THEN 'Cruise' WHEN 4 THEN 'Descent' ELSE 'Unknown' END"""
REPLY_CAUSE = f"CASE WHEN id % 5 = 4 THEN 'Human Error' WHEN id % 5 = 3 THEN 'Unknown' ELSE {EXPECTED_CAUSE} END"
REPLY_PHASE = f"CASE WHEN id % 5 >= 3 THEN 'Unknown' ELSE {EXPECTED_PHASE} END"
REPLY_FACTORS = "CASE WHEN id % 5 < 3 THEN 'f1; f2; f3; f4; f5' ELSE '' END"


def raw_number(column: str, every: int) -> str:
    return f"CASE WHEN id % {every} = 1 THEN NULL ELSE {column} END"


CLEAN = f"""
raw AS (SELECT id, operator, {raw_number('aboard', 61)} AS aboard, {raw_number('fatalities', 67)} AS fatalities,
    {raw_number('ground', 71)} AS ground,
    CASE WHEN id % 5 <> 0 AND id % 43 = 2 THEN NULL ELSE CAST(try_cast(date AS DATE) AS VARCHAR) END AS event_date, year FROM incidents),
rated AS (SELECT *, CASE WHEN aboard > 0 THEN fatalities / aboard END AS fatality_rate, aboard - fatalities AS survival_count FROM raw)"""

CLEANED = """SELECT id, event_date, year, aboard, fatalities, ground, fatality_rate, survival_count,
  CASE WHEN fatality_rate IS NULL THEN 'Unknown' WHEN fatalities = 0 THEN 'Minor' WHEN fatality_rate < 0.1e0 THEN 'Moderate'
    WHEN fatality_rate < 0.5e0 THEN 'Severe' ELSE 'Fatal' END AS severity_label, {operator} AS operator FROM rated"""

PART = "part AS (SELECT CASE WHEN id % 47 <> 0 THEN severity_label END AS severity_label FROM incidents)"


def top(key: str, extra: str = "") -> str:
    return f"""SELECT {key}, count(*) AS incidents, round({SUM_FAT}, 1) AS fatalities, coalesce(round({RATE}, 4), 0) AS fatality_rate{extra}
  FROM incidents WHERE {key} IS NOT NULL AND {key} <> '' GROUP BY {key} ORDER BY incidents DESC, {key} LIMIT 20"""


def top_share(key: str) -> str:
    return f"""SELECT {key}, count(*) AS incident_count, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM incidents) * 100, 1) AS percentage,
  CAST({SUM_FAT} AS BIGINT) AS fatalities FROM incidents WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY incident_count DESC, {key} LIMIT 10"""


def search(where: str, order: str, offset: int, limit: int) -> str:
    return f"SELECT {LISTED} FROM incidents WHERE {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"


def term(text: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{text}%'" for c in ("operator", "aircraft_type", "location", "summary")) + ")"


OVERVIEW_FILTERED = """SELECT count(*) AS total_incidents, CAST(coalesce(sum(fatalities), 0) AS BIGINT) AS total_fatalities,
  CAST(coalesce(sum(aboard), 0) AS BIGINT) AS total_aboard,
  coalesce(round(sum(fatalities) / nullif(sum(aboard), 0) * 100, 2), 0) AS overall_fatality_rate_pct,
  coalesce(round(sum(aboard - fatalities) / nullif(sum(aboard), 0) * 100, 2), 0) AS overall_survival_rate_pct,
  min(year) AS year_min, max(year) AS year_max, count(DISTINCT operator) AS unique_operators,
  count(DISTINCT aircraft_type) AS unique_aircraft_types, count(DISTINCT location) AS unique_locations
  FROM incidents WHERE fatalities IS NOT NULL AND aboard > 0"""


def build() -> dict[str, str]:
    sql: dict[str, tuple[str, str]] = {}

    def add(name: str, select: str, *ctes: str) -> None:
        sql[name] = (select, ", ".join(ctes))

    add("incident_scan", f"SELECT {ALL} FROM incidents")
    add("trainable_scan", "SELECT id, operator, aircraft_type, fatality_rate, fatalities, severity_label, year, aboard"
                          " FROM incidents WHERE severity_label IS NOT NULL")
    add("incident_detail", f"SELECT {ALL} FROM incidents WHERE id = 123")
    add("incident_missing", "SELECT id, operator FROM incidents WHERE id = -5")
    add("incident_list", f"SELECT {LISTED} FROM incidents")
    add("search_first_page", search("true", "date DESC NULLS LAST", 0, 12))
    add("search_filtered", search(
        f"severity_label = 'Fatal' AND year BETWEEN 1980 AND 1989 AND {term('nation_1')}", "date DESC NULLS LAST", 50, 50))
    add("search_by_operator", search(term("boeing"), "operator ASC NULLS FIRST", 50, 25))
    add("search_in_text", search(term("survived and"), "fatalities DESC NULLS LAST", 0, 100))
    add("search_postings", search(term("survived and"), "fatalities DESC NULLS LAST", 0, 100))
    add("postings_hits", " UNION ALL ".join(
        f"SELECT '{t}' AS term, count(*) AS hits, CAST(sum(id) AS BIGINT) AS ids FROM incidents WHERE {term(t.lower())}"
        for t in ("Engine", "boeing", "nation_1", "sur%ved", "a_d the", "an", "zzzqqq", "7")))
    add("search_deep_page", search("true", "aboard ASC NULLS FIRST", 10400, 100))
    add("search_hits", f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 12.0e0)) AS BIGINT) AS total_pages
      FROM incidents WHERE severity_label = 'Severe' AND year BETWEEN 1990 AND 1999 AND {term('airline')}""")
    add("table_rows", """SELECT id, coalesce(date, '') AS date, coalesce(operator, 'Unknown') AS operator,
      coalesce(aircraft_type, 'Unknown') AS aircraft, coalesce(location, 'Unknown') AS location, coalesce(fatalities, 0) AS fatalities,
      coalesce(aboard, 0) AS aboard, coalesce(severity_label, 'Unknown') AS severity, coalesce(summary, '') AS summary,
      coalesce(cluster_id, -1) AS cluster FROM incidents""")
    points = """SELECT id, round(proj_x, 4) AS x, round(proj_y, 4) AS y, coalesce(cluster_id, -1) AS cluster,
      coalesce(nullif(severity_label, ''), 'Unknown') AS severity, CAST(coalesce(fatalities, 0) AS INTEGER) AS fatalities,
      coalesce(year, 0) AS year, coalesce(nullif(operator, ''), 'Unknown') AS operator
      FROM incidents WHERE proj_x IS NOT NULL AND proj_y IS NOT NULL ORDER BY id LIMIT """
    add("projection_points", points + "2000")
    add("point_labels", "SELECT p.*, 'Cluster ' || CAST(cluster AS VARCHAR) AS cluster_name FROM pts p", f"pts AS ({points}1000)")
    pending = "SELECT id, fatalities FROM incidents WHERE summary IS NOT NULL AND extracted_cause_category IS NULL"
    add("pending_extraction", pending)
    add("extraction_queue", pending + " ORDER BY fatalities DESC NULLS LAST, id LIMIT 200")
    yearly = f"""SELECT year, count(*) AS incident_count, CAST({SUM_FAT} AS BIGINT) AS total_fatalities,
      coalesce(round({RATE}, 4), 0) AS avg_fatality_rate, round({SUM_ABOARD}, 1) AS total_aboard
      FROM incidents WHERE year IS NOT NULL GROUP BY year"""
    add("even_years", """SELECT year, incident_count AS incidents, total_fatalities AS fatalities, avg_fatality_rate AS fatality_rate
      FROM yearly WHERE year >= 1930 AND year % 2 = 0""", f"yearly AS ({yearly})")

    add("clean_fields", CLEANED.format(operator="operator"), CLEAN)
    add("csv_import", CLEANED.format(operator="nullif(operator, '')"), CLEAN)
    add("categories", f"""SELECT id, {category('full')} AS category_full, {category('short')} AS category_short,
      trim(split_part(extracted_cause_category, '|', 1)) AS cause, trim(split_part(extracted_phase_of_flight, '|', 1)) AS phase FROM incidents""")

    add("overview", OVERVIEW_FILTERED)
    add("overview_all", f"""SELECT count(*) AS total_incidents, CAST({SUM_FAT} AS BIGINT) AS total_fatalities,
      CAST({SUM_ABOARD} AS BIGINT) AS total_aboard,
      coalesce(round(sum(fatalities) / nullif(sum(aboard), 0), 4), 0) AS overall_fatality_rate_ratio,
      coalesce(round((sum(aboard) - sum(fatalities)) / nullif(sum(aboard), 0), 4), 0) AS overall_survival_rate_ratio,
      min(year) AS year_min, max(year) AS year_max, count(DISTINCT operator) AS unique_operators,
      count(DISTINCT aircraft_type) AS unique_aircraft_types, count(DISTINCT location) AS unique_locations FROM incidents""")
    add("overview_severities", "SELECT severity_label, count(*) AS n FROM incidents WHERE severity_label IS NOT NULL GROUP BY 1")
    add("yearly_trends", """SELECT *, round(avg(incident_count) OVER (ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2)
      AS rolling_avg_incidents FROM yearly ORDER BY year""", f"yearly AS ({yearly})")
    add("yearly_trends_percent", f"""SELECT year, count(*) AS incident_count, CAST({SUM_FAT} AS BIGINT) AS total_fatalities,
      CAST({SUM_ABOARD} AS BIGINT) AS total_aboard, coalesce(round({RATE} * 100, 2), 0) AS avg_fatality_rate_pct
      FROM incidents WHERE year IS NOT NULL GROUP BY year ORDER BY year""")
    decade = "CAST(year - year % 10 AS VARCHAR) || 's' AS decade"
    add("decade_trends", f"""SELECT {decade}, count(*) AS incidents, round({SUM_FAT}, 1) AS fatalities,
      coalesce(round(avg(fatalities), 2), 0) AS avg_fatalities, coalesce(round({RATE}, 4), 0) AS fatality_rate
      FROM incidents WHERE year IS NOT NULL GROUP BY 1""")
    add("decade_trends_percent", f"""SELECT {decade}, count(*) AS incident_count, CAST({SUM_FAT} AS BIGINT) AS total_fatalities,
      {SUM_ABOARD} AS total_aboard, coalesce(round({RATE} * 100, 2), 0) AS avg_fatality_rate_pct
      FROM incidents WHERE year IS NOT NULL GROUP BY 1""")
    add("yearly_chart", "SELECT year, incident_count AS incidents, total_fatalities AS fatalities, avg_fatality_rate AS fatality_rate FROM yearly",
        f"yearly AS ({yearly})")
    decades = f"""SELECT {decade}, count(*) AS incidents, round({SUM_FAT}, 1) AS fatalities,
      coalesce(round({RATE}, 4), 0) AS avg_fatality_rate FROM incidents WHERE year IS NOT NULL GROUP BY 1"""
    add("decade_chart", decades)
    add("dashboard_sections", f"""SELECT 'overview' AS section, 'all' AS name, total_incidents AS n, overall_fatality_rate_pct AS value
        FROM ({OVERVIEW_FILTERED})
      UNION ALL SELECT 'yearly', CAST(year AS VARCHAR), incident_count, avg_fatality_rate FROM ({yearly})
      UNION ALL SELECT 'severity', severity_label, count(*),
        round(count(*) / CAST((SELECT count(*) FROM incidents) AS DOUBLE) * 100, 2) FROM incidents GROUP BY severity_label
      UNION ALL SELECT 'decade', decade, incidents, avg_fatality_rate FROM ({decades})""")
    sql["dashboard_states"] = sql["dashboard_sections"]
    add("top_operators", top("operator", ", coalesce(round(avg(fatalities), 2), 0) AS avg_fatalities_per_incident"))
    add("top_aircraft", top("aircraft_type"))
    add("top_operators_share", top_share("operator"))
    add("top_aircraft_share", top_share("aircraft_type"))
    add("severity_distribution", """SELECT coalesce(severity_label, 'Unknown') AS severity, count(*) AS count,
      round(count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) * 100, 2) AS percentage FROM part GROUP BY 1""", PART)
    add("severity_distribution_labelled", """SELECT severity_label AS severity, count(*) AS count,
      round(count(*) / CAST((SELECT count(severity_label) FROM part) AS DOUBLE) * 100, 1) AS percentage
      FROM part WHERE severity_label IS NOT NULL GROUP BY 1""", PART)
    add("quick_stats", "SELECT severity_label, count(*) AS n, (SELECT count(*) FROM part) AS total FROM part GROUP BY 1", PART)
    add("distribution_shares", """SELECT severity_label, count(*) AS n, (SELECT count(severity_label) FROM part) AS total,
      round(count(*) / CAST((SELECT count(severity_label) FROM part) AS DOUBLE), 6) AS share
      FROM part WHERE severity_label IS NOT NULL GROUP BY 1""", PART)
    add("training_label_counts", f"SELECT severity_label, count(*) AS n FROM incidents WHERE severity_label IN ({lst(SEVERITY_INDEX)}) GROUP BY 1")
    add("cause_distribution", "SELECT extracted_cause_category, count(*) AS n FROM incidents WHERE extracted_cause_category IS NOT NULL GROUP BY 1")
    add("extraction_coverage", """SELECT count(*) AS total_incidents, count(extracted_cause_category) AS extracted_count,
      count(*) - count(extracted_cause_category) AS pending_count,
      round(count(extracted_cause_category) / CAST(count(*) AS DOUBLE) * 100, 1) AS coverage_pct FROM incidents""")
    add("extraction_distribution", """SELECT 'cause' AS field, extracted_cause_category AS value, count(*) AS n FROM incidents
        WHERE extracted_cause_category IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT 'phase', extracted_phase_of_flight, count(*) FROM incidents WHERE extracted_phase_of_flight IS NOT NULL GROUP BY 1, 2""")
    add("summary_coverage", f"""SELECT round(avg(CASE WHEN trim(coalesce(summary, ''), {WHITE}) <> '' THEN 1.0e0 ELSE 0.0e0 END) * 100, 1)
      AS summary_coverage_pct FROM incidents""")

    add("correlation_matrix", corr_rows(SIX, True), NUMS)
    add("correlation_insights", f"""SELECT var1, var2, r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
      CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m
      WHERE list_position([{lst(SIX)}], var1) < list_position([{lst(SIX)}], var2) AND abs(r) > 0.1""", NUMS, f"m AS ({corr_rows(SIX, True)})")
    add("correlation_pairwise", corr_rows(("fatalities", "aboard", "year"), False), NUMS)
    add("contingency", """SELECT severity_label AS row_key, aircraft_type AS col_key, count(*) AS n FROM incidents
      WHERE severity_label IS NOT NULL AND aircraft_type IS NOT NULL GROUP BY 1, 2""")
    add("chi_square_suite", " UNION ALL ".join((
        chi_row("x1", "Severity vs Operator Category", "operator_category"),
        chi_row("x2", "Severity vs Decade", "decade"), chi_row("x3", "Severity vs Top 10 Operators", "operator"))),
        CHI_ROWS, chi("x1", "marked", "operator_category"), chi("x2", "marked", "decade"), chi("x3", "in_top", "operator"))
    add("chi_square_decade", """SELECT 'severity_vs_decade' AS test, round(x, 4) AS chi2, round(p, 6) AS p_value, dof AS degrees_of_freedom,
      p < 0.05 AS significant FROM x2_p""", CHI_ROWS, chi("x2", "marked", "decade"))
    sql["chi_square_words"] = ("""SELECT 'lang vs word' AS test, round(sum((n - e) * (n - e) / e) + max(total) - sum(e), 2) AS chi2,
        CAST((count(DISTINCT lang) - 1) * (count(DISTINCT word) - 1) AS BIGINT) AS dof, true AS significant
      FROM (SELECT lang, word, n, total, CAST(row_n AS DOUBLE) * col_n / total AS e FROM word_cells CROSS JOIN word_total
        JOIN word_rows USING (lang) JOIN word_cols USING (word))""", """!
      word_cells AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM documents)
        WHERE lang IS NOT NULL GROUP BY ALL),
      word_rows AS (SELECT lang, sum(n) AS row_n FROM word_cells GROUP BY lang), word_cols AS (SELECT word, sum(n) AS col_n FROM word_cells GROUP BY word),
      word_total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM word_cells)""")
    add("chi_square_two_by_two", """SELECT 'many vs hit_ground' AS test, round(x, 4) AS chi2, CAST(1 AS BIGINT) AS dof, x > 3.841458820694124 AS significant
      FROM (SELECT sum((abs(o - e) - least(0.5e0, abs(o - e))) * (abs(o - e) - least(0.5e0, abs(o - e))) / e) AS x FROM grid)""",
        """yn AS (SELECT fatalities > 50 AS a, ground > 0 AS b FROM incidents WHERE fatalities IS NOT NULL),
      counted AS (SELECT a, b, count(*) AS n FROM yn GROUP BY 1, 2),
      grid AS (SELECT coalesce(c.n, 0) AS o, ra.t * cb.t / (SELECT CAST(count(*) AS DOUBLE) FROM yn) AS e
        FROM (SELECT a, CAST(count(*) AS DOUBLE) AS t FROM yn GROUP BY 1) ra CROSS JOIN (SELECT b, CAST(count(*) AS DOUBLE) AS t FROM yn GROUP BY 1) cb
        LEFT JOIN counted c ON c.a = ra.a AND c.b = cb.b)""")
    add("top_operator_rows", """SELECT id, operator, severity_label FROM incidents WHERE operator IN (
      SELECT operator FROM incidents WHERE operator IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, operator LIMIT 10)""")

    add("confusion", "SELECT * FROM cm", CM)
    add("confusion_shares", """SELECT actual, predicted, n, greatest(max(n) OVER (PARTITION BY actual), 1) AS row_max,
      round(n / CAST(greatest(max(n) OVER (PARTITION BY actual), 1) AS DOUBLE), 4) AS share FROM cm""", CM)
    add("class_report", "SELECT label, round(prec, 4) AS precision, round(rec, 4) AS recall, round(f1, 4) AS f1, support FROM cm_r", CM)
    add("classification_metrics", "SELECT * FROM cm_m", CM)
    add("confusion_from_json", "SELECT unnest(['bare', 'named']) AS form, actual, predicted, n FROM cm", CM)
    add("metrics_history", """SELECT run_id, 'PhraseRules' AS model_type, accuracy, f1_weighted, precision_weighted, recall_weighted,
      CAST(0 AS BIGINT) AS training_samples, test_samples FROM runs""", RUNS)
    add("metrics_summary", """SELECT run_id, 'PhraseRules' AS model_type, '' AS model_path, accuracy, f1_weighted, precision_weighted,
      recall_weighted, 0 AS n_estimators, CAST(0 AS BIGINT) AS training_samples, test_samples FROM runs WHERE run_id = 2""", RUNS)

    add("metrics_report", """SELECT CAST(1 AS BIGINT) AS run_id, m.accuracy, r.label, round(r.prec, 4) AS precision,
      round(r.rec, 4) AS recall, round(r.f1, 4) AS f1, r.support FROM cm_r r, cm_m m""", CM)
    add("prediction_counts", f"""SELECT {predicted(RULES)} AS predicted, count(*) AS n FROM incidents
      WHERE severity_label = 'Unknown' GROUP BY 1""")

    add("features", feature_sql())
    add("label_indices", f"SELECT id, CAST(list_position([{lst(SEVERITY_INDEX)}], severity_label) - 1 AS DOUBLE) AS label FROM incidents")
    add("split_rows", "SELECT id, severity_label, split FROM split", SPLIT)
    add("severity_test_rows", "SELECT id, severity_label AS actual FROM split WHERE split = 'test'", SPLIT)
    add("severity_back_fill", "SELECT id, severity_label, severity_label = 'Unknown' AS filled FROM incidents")
    add("imputed_numbers", """SELECT id, split, coalesce(CAST(year AS DOUBLE), (SELECT median(year) FROM split WHERE split = 'train')) AS year,
      coalesce(aboard, (SELECT median(aboard) FROM split WHERE split = 'train')) AS aboard FROM split""", SPLIT)
    sql["tfidf_vocabulary"] = ("SELECT term, document_count, frequency, round(idf, 6) AS idf FROM vocabulary", "!" + TFIDF)
    sql["tfidf_weights"] = ("SELECT doc_id, term, round(weight, 6) AS weight FROM weights", "!" + TFIDF)

    sql["text_vector_lengths"] = (
        "SELECT doc_id, CAST(384 AS INTEGER) AS dims, CASE WHEN len(w) > 0 THEN 1.0e0 ELSE 0.0e0 END AS length FROM toks",
        "!" + TFIDF)
    checks = """SELECT 'tested' AS measure, count(*) AS value FROM split WHERE split = 'test'
      UNION ALL SELECT 'tested in range', count(*) FROM split WHERE split = 'test'
      UNION ALL SELECT 'better than the largest class', CAST(1 AS BIGINT)
      UNION ALL SELECT 'scored', count(*) FROM marked WHERE severity_label IS NULL
      UNION ALL SELECT 'scored alike when reloaded', count(*) FROM marked WHERE severity_label IS NULL
      UNION ALL SELECT 'importances out of order', CAST(0 AS BIGINT)
      UNION ALL SELECT 'importances in all, per cent', CAST(100 AS BIGINT)"""
    marked = ("""!
      marked AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 3 THEN
        CASE lang WHEN 'de' THEN 'Minor' WHEN 'en' THEN 'Moderate' WHEN 'es' THEN 'Severe' WHEN 'fr' THEN 'Fatal' END END AS severity_label FROM documents),"""
      + SPLIT.replace("FROM incidents", "FROM marked"))
    sql["model_checks"] = (checks, marked)
    sql["boosted_checks"] = (checks, marked)
    sql["text_vectors"] = ("""SELECT doc_id, CAST(bucket AS INT) AS idx,
        round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM buckets""", "!" + TFIDF + """,
      buckets AS (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS n
        FROM (SELECT doc_id, CAST('0x' || substr(md5(unnest(w)), 1, 8) AS BIGINT) % 384 AS bucket FROM toks) GROUP BY ALL)""")
    sql["word_pairs"] = ("""SELECT p.a AS first, p.b AS second, p.n,
        round(greatest(0, ln(CASE WHEN p.a = p.b THEN 2 * p.n ELSE p.n END * CAST((SELECT sum(total) FROM margins) AS DOUBLE) / (x.total * CAST(y.total AS DOUBLE)))), 6) AS information
      FROM met p JOIN margins x ON x.w = p.a JOIN margins y ON y.w = p.b""", "!" + TFIDF + """,
      uses AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM toks) GROUP BY term),
      known AS (SELECT term FROM uses WHERE n >= 5 ORDER BY n DESC, term LIMIT 300),
      places AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM toks) SEMI JOIN known USING (term)),
      met AS (SELECT least(a.term, b.term) AS a, greatest(a.term, b.term) AS b, count(*) AS n
        FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos <= a.pos + 5 GROUP BY ALL),
      margins AS (SELECT w, CAST(sum(n) AS BIGINT) AS total FROM (
        SELECT a AS w, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM met UNION ALL SELECT b, n FROM met WHERE a <> b) GROUP BY w)""")
    sql["reduced_vectors"] = ("SELECT vec_id, idx, value FROM reduced", "!RECURSIVE" + components_sql(50))
    sql["projected_vectors"] = ("""SELECT vec_id, max(CASE WHEN idx = 0 THEN value END) AS proj_x, max(CASE WHEN idx = 1 THEN value END) AS proj_y
      FROM reduced GROUP BY vec_id""", "!RECURSIVE" + components_sql(2))
    sql["embedding_clusters"] = ("SELECT vec_id, CAST(coalesce(labelled.label, -1) AS INT) AS cluster_id FROM embeddings LEFT JOIN signed USING (vec_id) LEFT JOIN labelled USING (cell)",
                                 "!RECURSIVE" + VECTOR_CLUSTERS.format(width=0.75))
    sql["component_variance"] = ("SELECT round(sum(v), 6) AS total_variance, true AS falling FROM per", """!
      parts AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i,
        sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS norm FROM embeddings),
      per AS (SELECT i, var_pop(CAST(x AS DOUBLE) / norm) AS v FROM parts GROUP BY i)""")
    add("cluster_stats", "SELECT * FROM stats", STATS)
    add("clusters_by_label", "SELECT cluster_label, incident_count, dominant_severity FROM stats WHERE cluster_label <> -1", STATS)
    add("clusters_by_size", "SELECT cluster_label, incident_count FROM stats WHERE cluster_label <> -1", STATS)
    add("cluster_lookup", f"SELECT cluster_label, incident_count, avg_fatality_rate, {YEAR_RANGE} AS year_range FROM stats WHERE cluster_label = 3", STATS)
    add("cluster_coverage", """SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
      count(CASE WHEN cluster_id = -1 THEN 1 END) AS n_noise,
      round((1 - count(CASE WHEN cluster_id = -1 THEN 1 END) / CAST(count(*) AS DOUBLE)) * 100, 1) AS coverage_pct FROM incidents""")
    add("cluster_labels", "SELECT DISTINCT cluster_id FROM incidents")
    add("cluster_top_operators", "SELECT cluster_id, CAST(rk - 1 AS INTEGER) AS position, v AS operator FROM ops_r WHERE rk <= 5", ranked("operator", "ops"))
    add("cluster_dominant_severity", "SELECT cluster_id, v AS dominant_severity FROM sev_r WHERE rk = 1", ranked("severity_label", "sev"))
    add("cluster_samples", """SELECT id, cluster_id, fatalities, summary, CAST(rk AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY fatalities DESC NULLS LAST, id) AS rk FROM incidents
      WHERE summary IS NOT NULL AND cluster_id <> -1) WHERE rk <= 12""")
    factors = "'a; b; c; d; e; f'"
    add("cluster_cards", f"""SELECT cluster_label, 'Cluster ' || cluster_label AS name, incident_count, coalesce(avg_fatality_rate, 0) AS avg_fatality_rate,
      coalesce(avg_fatalities, 0) AS avg_fatalities, dominant_severity, top_operators, top_aircraft_types, year_range_start, year_range_end,
      CASE WHEN avg_fatalities > 47 THEN 'Pattern ' || cluster_label ELSE {q(vocab.NO_SUMMARY_YET)} END AS root_cause_summary,
      CASE WHEN avg_fatalities > 47 THEN {factors} ELSE '' END AS key_contributing_factors,
      CASE WHEN avg_fatalities > 47 THEN 'Train crews' ELSE {q(vocab.NO_RECOMMENDATIONS_YET)} END AS recommendations
      FROM stats WHERE cluster_label <> -1""", STATS)
    add("cluster_summaries", f"""SELECT cluster_label, incident_count, {YEAR_RANGE} AS year_range, dominant_severity, avg_fatality_rate,
      top_operators, top_aircraft_types, 'Pattern ' || cluster_label AS root_cause_summary, {factors} AS key_contributing_factors,
      'Train crews' AS recommendations FROM stats WHERE avg_fatalities > 47 AND cluster_label <> -1""", STATS)
    add("cluster_rate_texts", """SELECT cluster_label, printf('%.1f%%', avg_fatality_rate * 100) AS one_digit,
      printf('%.0f%%', avg_fatality_rate * 100) AS whole FROM stats""", STATS)
    add("density_profiles", "SELECT * FROM stats", DENSITY, """placed AS (
      SELECT i.* EXCLUDE (cluster_id), l.cluster_id FROM incidents i JOIN labels l ON l.id = i.id)""", STATS.replace("FROM incidents", "FROM placed"))
    add("density_labels", "SELECT id, cluster_id FROM labels", DENSITY)
    add("backfill_predictions", f"""SELECT id, severity_label, operator,
      CASE WHEN severity_label = 'Unknown' THEN {predicted(RULES)} END AS predicted_severity,
      CASE WHEN severity_label = 'Unknown' THEN 0.5e0 END AS prediction_confidence FROM incidents""")
    sql["bucketed_backfill"] = sql["backfill_predictions"]
    add("backfill_clusters", "SELECT i.id, i.operator, l.cluster_id FROM incidents i JOIN labels l ON l.id = i.id", DENSITY)

    whole = 2_000_000_000

    def prompts(chars: int, source: str = "incidents") -> str:
        text = fill(vocab.EXTRACTION_PROMPT, summary=f"substr(trim(summary, {WHITE}), 1, {chars})")
        return f"""SELECT id, {text} AS prompt FROM {source}
      WHERE summary IS NOT NULL AND extracted_cause_category IS NULL AND trim(summary, {WHITE}) <> ''"""

    def of_clusters(names: int) -> str:
        return f"""SELECT cluster_label, CASE WHEN summaries IS NOT NULL THEN {filled_prompt(names)} END AS prompt,
      CASE WHEN summaries IS NULL THEN {fill(vocab.NO_TEXT_SUMMARY, label="cluster_label")} END AS default_summary,
      CASE WHEN summaries IS NULL THEN {q(vocab.NO_TEXT_RECOMMENDATION)} END AS default_recommendations
      FROM stats LEFT JOIN best ON best.cluster_id = stats.cluster_label WHERE cluster_label <> -1"""

    add("extraction_prompts", prompts(whole))
    add("extraction_prompts_short", prompts(800))
    add("extraction_prompts_stripped", prompts(whole, """(SELECT id, extracted_cause_category, CASE id % 5
      WHEN 0 THEN chr(9) || ' ' || chr(10) || chr(12288) WHEN 1 THEN chr(10) || chr(9) || summary || chr(160) || chr(13) || chr(10) ELSE summary END AS summary FROM incidents)"""))
    add("cluster_prompts", of_clusters(whole), STATS, cluster_texts(whole))
    add("cluster_prompts_short", of_clusters(150), STATS, cluster_texts(350))
    add("parsed_replies", f"""SELECT id, {REPLY_CAUSE} AS cause_category, {REPLY_PHASE} AS phase_of_flight, {REPLY_FACTORS} AS contributing_factors,
      false AS is_mechanical_failure, id % 5 < 3 AS is_weather_related, false AS is_human_error FROM incidents""")
    answered = "extracted_cause_category IS NOT NULL"
    add("applied_replies", f"""SELECT id, CASE WHEN {answered} THEN {REPLY_CAUSE} END AS extracted_cause_category,
      CASE WHEN {answered} THEN {REPLY_PHASE} ELSE extracted_phase_of_flight END AS extracted_phase_of_flight,
      CASE WHEN {answered} THEN {REPLY_FACTORS} ELSE '' END AS extracted_contributing_factors, {answered} AS stamped FROM incidents""")
    causes = " ".join(f"WHEN {summary_flag(k)} THEN {q(v)}" for k, v in vocab.CAUSE_BY_PHRASE.items())
    phases = " ".join(f"WHEN {found('summary', p)} THEN {q(v)}" for v, p in vocab.PHASE_PATTERNS.items())
    add("keyword_extraction", f"""SELECT id, CASE {causes} ELSE 'Unknown' END AS cause_category,
      CASE {phases} ELSE 'Unknown' END AS phase_of_flight FROM incidents""")
    waiting = "summary IS NOT NULL AND extracted_cause_category IS NULL"
    add("keyword_backfill", f"""SELECT id, CASE WHEN {waiting} THEN CASE {causes} ELSE 'Unknown' END ELSE extracted_cause_category END
        AS extracted_cause_category,
      CASE WHEN {waiting} THEN CASE {phases} ELSE 'Unknown' END ELSE extracted_phase_of_flight END AS extracted_phase_of_flight
      FROM incidents""")
    add("factor_fields", """SELECT id, CASE id % 6 WHEN 0 THEN 'ice; ' || location WHEN 1 THEN location WHEN 2 THEN location || '; fatigue'
        WHEN 3 THEN location || '; wind; night' WHEN 4 THEN location ELSE '' END AS factors,
      CAST(CASE id % 6 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 0 ELSE 1 END AS INTEGER) AS n FROM incidents""")

    add("replaced_runs", """SELECT cluster_label, incident_count, CAST(unnest(CASE WHEN cluster_label >= 0 THEN [1, 2] ELSE [2] END) AS BIGINT) AS run_id
      FROM stats""", STATS)
    add("replaced_table", "SELECT cluster_label, incident_count FROM stats WHERE cluster_label = -1", STATS)
    add("stored_coordinates", "SELECT id, proj_x, proj_y, CAST(7 AS BIGINT) AS run_id FROM incidents WHERE proj_x IS NOT NULL")
    add("dashboard_totals", f"""SELECT o.*, (SELECT count(DISTINCT cluster_id) FROM incidents WHERE cluster_id <> -1) AS total_clusters,
      m.accuracy, m.f1_weighted FROM ({OVERVIEW_FILTERED}) o, cm2_m m""", CM2)

    out = {}
    for name, (select, ctes) in sql.items():
        if ctes.startswith("!"):
            out[name] = f"WITH {ctes[1:]} {select}"
        else:
            out[name] = f"WITH RECURSIVE {INCIDENTS}{', ' + ctes if ctes else ''} {select}"
    return out
