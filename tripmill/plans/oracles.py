"""The registered queries as ANSI SQL for another engine, over the same tables."""

from __future__ import annotations

from tripmill.operators.report import CHART_ROWS, PREVIEW_ROWS, REPORTS, TABLE_ROWS, TAIL_ROWS
from tripmill.schema import FEATURES, PROFILE_COLUMNS

# Rounded means are nudged (+ 1e-9): an exact half must not depend on the order of a sum.
Z = [f"z_{name}" for name in FEATURES]
FLOAT_LIMIT = "3.4028234663852886e38"


def _list(items, joiner: str = ", ") -> str:
    return joiner.join(items)


TRIPS = """trips AS (
  SELECT event_id AS row_id, ts AS tpep_pickup_datetime,
    CASE WHEN event_id % 101 = 1 THEN NULL ELSE ts + INTERVAL 1 SECOND * CAST(
      30 + (event_id * 7919 + user_id * 104729) % 5400
      + CASE WHEN event_id % 97 = 5 THEN 10800 ELSE 0 END AS INTEGER) END AS tpep_dropoff_datetime,
    CASE WHEN event_id % 89 = 3 THEN 0e0 WHEN event_id % 251 = 7 THEN 1e-100
      ELSE value / 10e0 END AS trip_distance,
    CASE WHEN event_id % 103 = 2 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 107 = 4 THEN NULL
      WHEN event_id % 83 = 6 THEN -1e0 ELSE 3e0 + 3e-1 * value END AS fare_amount,
    CASE WHEN event_id % 109 = 8 THEN 2000e0 ELSE 12e0 + 3e-1 * value END AS total_amount
  FROM events
), timed AS (
  SELECT *, CAST((epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) // 1000
      AS DOUBLE) / 60000e0 AS duration_minutes,
    CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour
  FROM trips
), engineered AS (
  SELECT *,
    CASE WHEN duration_minutes <> 0 THEN trip_distance * 60e0 / duration_minutes END AS speed_mph,
    CASE WHEN trip_distance <> 0 THEN fare_amount / trip_distance END AS fare_per_mile,
    sin(pickup_hour * 0.2617993877991494e0) AS hour_sin,
    cos(pickup_hour * 0.2617993877991494e0) AS hour_cos
  FROM timed
)"""


LINE_TRIPS = """trips AS (
  SELECT *, 3e0 + l_extendedprice / 1000e0 AS fare_amount,
    (3e0 + l_extendedprice / 1000e0) * (1e0 + l_tax) AS total_amount,
    tpep_pickup_datetime + INTERVAL 1 SECOND * CAST(60
      + (l_partkey * 104729 + l_suppkey * 7919 + l_linenumber) % 7200 AS INTEGER)
      AS tpep_dropoff_datetime
  FROM (
    SELECT *, 3e-1 + l_quantity * (1e0 + l_discount) / 5e0 AS trip_distance,
      l_shipdate + INTERVAL 1 SECOND * CAST((l_orderkey * 7919 + l_partkey) % 86400 AS INTEGER)
        AS tpep_pickup_datetime
    FROM lineitem)
)"""


def _not_finite(name: str) -> str:
    return f"({name} IS NULL OR isnan({name}) OR isinf({name}))"


def _too_large(name: str) -> str:
    return f"({name} IS NULL OR isnan({name}) OR abs({name}) > {FLOAT_LIMIT})"


CLASSIFIED = f"""{TRIPS}, classified AS (
  SELECT *, CASE
    WHEN tpep_pickup_datetime IS NULL OR tpep_dropoff_datetime IS NULL THEN 'invalid_timestamp'
    WHEN {_list([_not_finite(n) for n in ("trip_distance", "fare_amount", "total_amount")], " OR ")}
      THEN 'missing_or_nonfinite_amount_distance'
    WHEN duration_minutes < 1 OR duration_minutes > 180 THEN 'duration_out_of_range'
    WHEN trip_distance <= 0 OR trip_distance > 150 THEN 'distance_out_of_range'
    WHEN fare_amount <= 0 OR fare_amount > 1000 OR total_amount <= 0 OR total_amount > 1500
      THEN 'charge_out_of_range'
    WHEN speed_mph > 100 THEN 'speed_out_of_range'
    WHEN {_list([_too_large(n) for n in FEATURES], " OR ")} THEN 'nonfinite_features'
    END AS rejection_reason
  FROM engineered
), good AS (SELECT * FROM classified WHERE rejection_reason IS NULL)"""

LINE_CLASSIFIED = LINE_TRIPS + CLASSIFIED[CLASSIFIED.index(", timed AS") :]
MOMENTS = _list([f"avg({n}) AS mean_{n}, stddev_pop({n}) AS scale_{n}" for n in FEATURES])
SCALED = f"""{CLASSIFIED}, moments AS (SELECT {MOMENTS} FROM good), scaled AS (
  SELECT good.*, {_list([f"({n} - mean_{n}) / scale_{n} AS z_{n}" for n in FEATURES])}
  FROM good CROSS JOIN moments
)"""


def priority(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT)"


def drawn(k: int, seed: int = 42, name: str = "centers") -> str:
    return f"""{name} AS (
  SELECT CAST(row_number() OVER (ORDER BY p, row_id) - 1 AS INTEGER) AS cluster, {_list(Z)} FROM (
    SELECT {priority("row_id", seed)} AS p, row_id, {_list(Z)} FROM scaled
  ) ORDER BY p, row_id LIMIT {k}
)"""


def squares(row: str, center: str, names=Z) -> str:
    return " + ".join(f"({row}.{n} - {center}.{n}) * ({row}.{n} - {center}.{n})" for n in names)


def nearest(source: str, centers: str, name: str) -> str:
    """Rows of a table with their closest center; ties go to the lowest cluster."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT s.*, c.cluster, {squares("s", "c")} AS squared_distance,
      row_number() OVER (PARTITION BY s.row_id ORDER BY {squares("s", "c")}, c.cluster) AS place
    FROM {source} s CROSS JOIN {centers} c
  ) WHERE place = 1
)"""


LABELED = f"{SCALED}, {drawn(3)}, {nearest('scaled', 'centers', 'labeled')}"
FLAGGED = f"""{LABELED}, measured AS (
  SELECT *, sqrt(squared_distance) AS centroid_distance FROM labeled
), cut AS (
  SELECT quantile_cont(centroid_distance, 0.99) AS threshold FROM measured
), flagged AS (
  SELECT *, centroid_distance / greatest(threshold, 1e-12) AS anomaly_ratio,
    centroid_distance > threshold AS distance_outlier
  FROM measured CROSS JOIN cut
)"""


def means(names, digits: int = 5) -> str:
    return _list([f"round(avg({n}) + 1e-9, {digits}) AS {n}" for n in names])


def rounds(names, digits: int) -> str:
    return _list([f"round({n} + 1e-9, {digits}) AS {n}" for n in names])


def _statistics(source: str = CLASSIFIED) -> str:
    parts = [
        f"""SELECT '{n}' AS feature, count({n}) AS "count", count(*) - count({n}) AS null_count,
  round(avg({n}) + 1e-9, 5) AS mean, round(stddev_samp({n}) + 1e-9, 5) AS std, round(min({n}) + 1e-9, 5) AS "min",
  round(quantile_cont({n}, 0.25) + 1e-9, 5) AS q25, round(quantile_cont({n}, 0.5) + 1e-9, 5) AS q50,
  round(quantile_cont({n}, 0.75) + 1e-9, 5) AS q75, round(max({n}) + 1e-9, 5) AS "max" FROM good"""
        for n in FEATURES
    ]
    return f"WITH {source} " + " UNION ALL ".join(parts)


def _batch_view() -> str:
    """Drawn models stand for batch sizes; one run failed and one is of another K."""
    sizes = (100, 500, 1_000, 5_000, 10_000)
    parts = [f"{drawn(3, 50 + i, f'c{i}')}, {nearest('scaled', f'c{i}', f'n{i}')}" for i in range(len(sizes))]
    rows = [
        f"SELECT CAST({size} AS INTEGER) AS batch_size, {abs(size - 900) / 1000.0}e0 AS fit_seconds,"
        f" (SELECT avg(squared_distance) FROM n{i}) AS error"
        for i, size in enumerate(sizes)
        if size not in (500, 5_000)
    ]
    return f"""WITH {SCALED}, {_list(parts)}, runs AS ({_list(rows, " UNION ALL ")})
SELECT batch_size, round(fit_seconds + 1e-9, 5) AS fit_seconds, round(error + 1e-9, 5) AS normalized_inertia,
  round(1 / (1 + error) + 1e-9, 5) AS silhouette, fit_seconds = min(fit_seconds) OVER () AS fastest,
  error = min(error) OVER () AS best FROM runs"""


def _display_views() -> str:
    views = {
        "preview": ("row_id", PREVIEW_ROWS),
        "table": ("centroid_distance DESC, row_id", TABLE_ROWS),
        "chart": ("centroid_distance DESC, row_id", CHART_ROWS),
        "tail": ("row_id DESC", TAIL_ROWS),
    }
    parts = [
        f"""SELECT '{name}' AS "view", count(*) AS "rows", CAST(sum(row_id) AS BIGINT) AS ids,
  round(sum(centroid_distance) + 1e-9, 3) AS distance
  FROM (SELECT row_id, centroid_distance FROM flagged ORDER BY {order} LIMIT {rows})"""
        for name, (order, rows) in views.items()
    ]
    return f"WITH {FLAGGED} " + " UNION ALL ".join(parts)


def _report_tables(found: dict[str, str]) -> str:
    """The same long form over the SQL of the queries that the report is made of."""
    pairs = f"""SELECT * FROM ({found["combine_results"]}) WHERE NOT streaming AND environment = 'local'"""
    parts = {
        "counts": found["row_accounting"],
        "exclusions": found["reject_reasons"],
        "statistics": found["feature_statistics"],
        "selection": found["k_scores"],
        "performance": pairs,
        "quality": pairs,
        "batch": found["batch_view"],
        "profiles": found["cluster_profiles"],
        "anomalies": found["anomaly_by_cluster"],
        "holdout": f"""SELECT s.* FROM ({found["score_rows"]}) s SEMI JOIN ({found["holdout_rows"]}) h USING (row_id)""",
    }
    lines = []
    for name, (keys, values) in REPORTS.items():
        item = "concat_ws('/', " + _list([f'CAST("{k}" AS VARCHAR)' for k in keys]) + ")" if keys else "'all'"
        for value in values:
            lines.append(f"""SELECT '{name}' AS report, {item} AS item, '{value}' AS metric,
  CAST("{value}" AS DOUBLE) AS value FROM ({parts[name]})""")
    return " UNION ALL ".join(lines)


def _stream_fit(files: int = 4, shards: int = 3) -> str:
    """The updates of every shard, file by file: assign with the centers so far, then take means."""
    numbers = _list([str(i) for i in range(shards)])
    steps = []
    for i in range(files):
        moved = [
            f"CASE WHEN n > 0 THEN (c.{z} * c.weight + s_{z}) / (c.weight + n) ELSE c.{z} END AS {z}" for z in Z
        ]
        own = [f"s.{z}" for z in Z]
        steps.append(f"""labels{i} AS (
  SELECT s.row_id, c.shard, c.cluster, {_list(own)},
    row_number() OVER (PARTITION BY s.row_id ORDER BY {squares("s", "c")}, c.cluster) AS place
  FROM scaled s JOIN state{i} c ON c.shard = s.row_id % {shards} WHERE s.row_id % {files} = {i}
), sums{i} AS (
  SELECT shard, cluster, count(*) AS n, {_list([f"sum({z}) AS s_{z}" for z in Z])}
  FROM labels{i} WHERE place = 1 GROUP BY shard, cluster
), state{i + 1} AS (
  SELECT c.shard, c.cluster, c.weight + coalesce(n, 0) AS weight, {_list(moved)}
  FROM state{i} c LEFT JOIN sums{i} u ON u.shard = c.shard AND u.cluster = c.cluster
)""")
    joined = [f"round(coalesce(sum(weight * {z}) / nullif(sum(weight), 0), any_value({z})) + 1e-9, 5) AS {z}" for z in Z]
    return f"""WITH {SCALED}, {drawn(3)}, state0 AS (
  SELECT shard, cluster, 0e0 AS weight, {_list(Z)} FROM centers CROSS JOIN (SELECT unnest([{numbers}]) AS shard)
), {_list(steps)}
SELECT cluster, CAST({files} AS BIGINT) AS steps, CAST(sum(weight) AS BIGINT) AS rows_applied, {_list(joined)}
FROM state{files} GROUP BY cluster"""


def _scaler() -> str:
    parts = [
        f"""SELECT CAST({i} AS INTEGER) AS position, '{n}' AS feature, round(avg({n}) + 1e-9, 5) AS mean,
  round(sqrt(var_pop({n})) + 1e-9, 5) AS scale, round(var_pop({n}) + 1e-9, 5) AS variance,
  count(*) AS samples_seen FROM good"""
        for i, n in enumerate(FEATURES)
    ]
    return f"WITH {CLASSIFIED} " + " UNION ALL ".join(parts)


def _prefixes() -> str:
    parts = [
        f"""SELECT CAST({parts} AS INTEGER) AS parts, count(*) AS "rows", max(p) AS last_priority,
  round(sum(o_totalprice) + 1e-9, 2) AS total FROM ranked WHERE place <= n // {parts}"""
        for parts in (8, 4, 2, 1)
    ]
    return f"""WITH ranked AS (
  SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS place, count(*) OVER () AS n FROM (
    SELECT o_orderkey, o_totalprice, {priority("o_orderkey")} AS p FROM orders)
) """ + " UNION ALL ".join(parts)


def ranked(source: str, columns: str, name: str = "ranked") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (ORDER BY p, row_id) AS place
  FROM (SELECT {columns}, {priority("row_id")} AS p FROM {source})
)"""


def step(labeled: str, name: str) -> str:
    return f"""{name} AS (
  SELECT cluster, count(*) AS size, {_list([f"avg({n}) AS {n}" for n in Z])}
  FROM {labeled} GROUP BY cluster
)"""


def rand_index(cells: str, by: str = "") -> str:
    """Adjusted agreement from a table of cells (by.., a, b, n)."""
    group = f"GROUP BY {by}" if by else ""
    first = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""cells_sum AS (SELECT {first}sum(n) AS total, sum(n * (n - 1) / 2e0) AS together
  FROM {cells} {group}
), a_sum AS (SELECT {first}sum(n * (n - 1) / 2e0) AS a_pairs
  FROM (SELECT {first}a, sum(n) AS n FROM {cells} GROUP BY {first}a) {group}
), b_sum AS (SELECT {first}sum(n * (n - 1) / 2e0) AS b_pairs
  FROM (SELECT {first}b, sum(n) AS n FROM {cells} GROUP BY {first}b) {group}
), agreement AS (SELECT {first}CAST(total AS BIGINT) AS "rows",
    (together - a_pairs * b_pairs / (total * (total - 1) / 2e0))
    / ((a_pairs + b_pairs) / 2e0 - a_pairs * b_pairs / (total * (total - 1) / 2e0)) AS ari
  FROM cells_sum JOIN a_sum {join} JOIN b_sum {join}
)"""


def silhouette(pairs: str, members: str, by: str = "") -> str:
    """Mean silhouette from pair distances (i, j, d) and labels (by.., i, label)."""
    first = f"{by}, " if by else ""
    same = f"AND m.{by} = o.{by}" if by else ""
    keep = f"m.{by} AS {by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""sizes AS (SELECT {first}label, count(*) AS n FROM {members} GROUP BY {first}label
), reach AS (
  SELECT {keep}m.i AS i, m.label AS own, o.label AS other, sum(p.d) AS total
  FROM {pairs} p JOIN {members} m ON p.i = m.i JOIN {members} o ON p.j = o.i {same}
  GROUP BY ALL
), scored AS (
  SELECT {"r." + by + ", " if by else ""}r.i,
    max(CASE WHEN r.other = r.own AND s.n > 1 THEN r.total / (s.n - 1) END) AS inner_mean,
    min(CASE WHEN r.other <> r.own THEN r.total / s.n END) AS outer_mean,
    max(CASE WHEN r.other = r.own THEN s.n END) AS own_size
  FROM reach r JOIN sizes s ON r.other = s.label {f"AND r.{by} = s.{by}" if by else ""}
  GROUP BY ALL
), widths AS (
  SELECT {first}count(*) AS "rows", avg(CASE WHEN own_size = 1 THEN 0e0
    WHEN greatest(inner_mean, outer_mean) = 0 THEN 0e0
    ELSE (outer_mean - inner_mean) / greatest(inner_mean, outer_mean) END) AS silhouette
  FROM scored {group}
)"""


def _study() -> str:
    """Scores of K = 2..10 where the K centers are the first K drawn rows."""
    near = []
    for seed, name in ((42, "first"), (43, "second")):
        near.append(drawn(10, seed, f"{name}_centers"))
        near.append(
            f"""{name}_distances AS (
  SELECT s.row_id, c.cluster, {squares("s", "c")} AS d FROM scaled s CROSS JOIN {name}_centers c
), {name} AS (
  SELECT row_id, k, cluster, d FROM (
    SELECT x.row_id, ks.k, x.cluster, x.d,
      row_number() OVER (PARTITION BY x.row_id, ks.k ORDER BY x.d, x.cluster) AS place
    FROM {name}_distances x JOIN ks ON x.cluster < ks.k
  ) WHERE place = 1
)"""
        )
    return f"""{SCALED}, ks AS (SELECT CAST(unnest(range(2, 11)) AS INTEGER) AS k), {", ".join(near)},
filled AS (
  SELECT e.k, e.cluster, coalesce(f.n, 0) AS n
  FROM (SELECT k, CAST(unnest(range(0, k)) AS INTEGER) AS cluster FROM ks) e
  LEFT JOIN (SELECT k, cluster, count(*) AS n FROM first GROUP BY ALL) f USING (k, cluster)
), shares AS (
  SELECT k, CAST(sum(n) AS BIGINT) AS "rows", min(n) / sum(n) AS min_cluster_share,
    max(n) / sum(n) AS max_cluster_share,
    '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY cluster) || ']' AS cluster_sizes
  FROM filled GROUP BY k
), errors AS (SELECT k, avg(d) AS normalized_inertia FROM first GROUP BY k
), cells AS (
  SELECT f.k, f.cluster AS a, s.cluster AS b, count(*) AS n
  FROM first f JOIN second s USING (row_id, k) GROUP BY ALL
), {rand_index("cells", "k")}, {ranked("scaled", "row_id, " + _list(Z))},
metric AS (SELECT * FROM ranked WHERE place <= 2000),
pairs AS (
  SELECT x.row_id AS i, y.row_id AS j, sqrt({squares("x", "y")}) AS d FROM metric x CROSS JOIN metric y
), members AS (SELECT f.k, f.row_id AS i, f.cluster AS label FROM first f JOIN metric USING (row_id)),
{silhouette("pairs", "members", "k")},
scores AS (
  SELECT k, shares."rows", normalized_inertia, silhouette, ari AS stability_ari,
    min_cluster_share, max_cluster_share, cluster_sizes
  FROM shares JOIN errors USING (k) JOIN agreement USING (k) JOIN widths USING (k)
), ends AS (
  SELECT min(k) AS k0, max(k) AS k1, min_by(normalized_inertia, k) AS i0,
    max_by(normalized_inertia, k) AS i1 FROM scores
), elbow AS (
  SELECT scores.*, 1 - (k - k0) / CAST(k1 - k0 AS DOUBLE)
    - (normalized_inertia - i1) / (i0 - i1) AS elbow_strength,
    min_cluster_share >= 0.06 AS share_ok, silhouette >= 0.15 AND stability_ari >= 0.15 AS tight,
    min_cluster_share >= 0.06 AND silhouette >= 0.15 AND stability_ari >= 0.15 AS eligible
  FROM scores CROSS JOIN ends
)"""


def results(name: str, seeds, environment: str) -> str:
    """Result rows of two drawn models on four nested prefixes."""
    first, second = seeds
    return f"""{drawn(3, first, name + "_ca")}, {drawn(3, second, name + "_cb")},
{nearest("scaled", name + "_ca", name + "_a")}, {nearest("scaled", name + "_cb", name + "_b")},
{name}_ranked AS (
  SELECT a.squared_distance AS da, b.squared_distance AS db, count(*) OVER () AS total,
    row_number() OVER (ORDER BY {priority("a.row_id")}, a.row_id) AS place
  FROM {name}_a a JOIN {name}_b b USING (row_id)
), {name}_prefix AS (
  SELECT count(*) AS "rows", avg(da) AS a, avg(db) AS b
  FROM {name}_ranked JOIN (SELECT unnest([8, 4, 2, 1]) AS parts) ON place <= total // parts
  GROUP BY parts
), {name} AS (
  SELECT "rows", algorithm, normalized_inertia, "rows" / CAST(100000 AS DOUBLE) AS fit_seconds,
    1 / (1 + normalized_inertia) AS silhouette, streaming, CAST(42 AS INTEGER) AS seed,
    CAST(3 AS INTEGER) AS k, CAST(6 AS INTEGER) AS feature_count, 'ok' AS status,
    '{environment}' AS environment, 'drawn' AS experiment_id
  FROM (SELECT "rows", 'KMeans' AS algorithm, a AS normalized_inertia, false AS streaming
    FROM {name}_prefix
    UNION ALL SELECT "rows", 'MiniBatchKMeans', b, false FROM {name}_prefix
    UNION ALL SELECT max("rows"), 'MiniBatchKMeans', max_by(b, "rows"), true FROM {name}_prefix)
)"""
METRICS = ("fit_seconds", "normalized_inertia", "silhouette")


LOCAL = f"{SCALED}, {results('local_rows', (42, 43), 'local')}"
BOTH = f"{LOCAL}, {results('remote_rows', (44, 45), 'colab')}"
PAIRED = (
    'SELECT "rows", environment, '
    + ", ".join(
        f"round(max(CASE WHEN algorithm = '{name}' THEN {m} END) + 1e-9, 5) AS {tag}_{m}"
        for name, tag in (("KMeans", "kmeans"), ("MiniBatchKMeans", "minibatch"))
        for m in METRICS
    )
    + ' FROM {source} WHERE NOT streaming GROUP BY "rows", environment'
)

DESCRIPTION = """printf('%.1f mi · %d min · %d mph average', avg(trip_distance),
    CAST(round_even(avg(duration_minutes), 0) AS BIGINT),
    CAST(round_even(avg(speed_mph), 0) AS BIGINT)) ||
  CASE WHEN sqrt(avg(hour_sin) * avg(hour_sin) + avg(hour_cos) * avg(hour_cos)) >= 0.4
    THEN printf(' · pickup around %02d:00', CAST(round_even({hour}, 0) AS BIGINT) % 24)
    ELSE ' · mixed pickup hours' END"""
HOUR = """CASE WHEN atan2(avg(hour_sin), avg(hour_cos)) < 0
  THEN atan2(avg(hour_sin), avg(hour_cos)) * 12e0 / pi() + 24
  ELSE atan2(avg(hour_sin), avg(hour_cos)) * 12e0 / pi() END"""

CLOCK = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
CENTS = "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"


def oracle_sql() -> dict[str, str]:
    found = _own_sql()
    return found | {"report_tables": _report_tables(found)}


def _own_sql() -> dict[str, str]:
    checked = f"WITH {CLASSIFIED} SELECT"
    labeled = f"WITH {LABELED} SELECT"
    flagged = f"WITH {FLAGGED} SELECT"
    study = f"WITH {_study()} SELECT"
    scored_columns = """row_id, cluster, round(centroid_distance + 1e-9, 5) AS centroid_distance,
  round(anomaly_ratio + 1e-9, 5) AS anomaly_ratio, distance_outlier"""
    vector_pairs = """pairs AS (
  SELECT x.vec_id AS i, y.vec_id AS j,
    sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
  FROM metric x CROSS JOIN metric y
)"""
    second = f"""{LABELED}, {step("labeled", "moved")}, {nearest("scaled", "moved_centers", "relabeled")},
{step("relabeled", "again")}""".replace(
        "relabeled AS (", f"moved_centers AS (SELECT cluster, {_list(Z)} FROM moved), relabeled AS (", 1
    )
    return {
        "trip_features": f"{checked} row_id, pickup_hour, {rounds(FEATURES, 6)} FROM good",
        "trip_rejects": f"""{checked} row_id, rejection_reason, tpep_pickup_datetime,
  tpep_dropoff_datetime, trip_distance, total_amount FROM classified
  WHERE rejection_reason IS NOT NULL""",
        "reject_reasons": f"""{checked} rejection_reason, count(*) AS "rows" FROM classified
  WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason""",
        "row_accounting": f"""{checked} count(*) AS raw_rows,
  count(*) FILTER (WHERE rejection_reason IS NULL) AS accepted_rows,
  count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS rejected_rows FROM classified""",
        "line_reasons": f"""WITH {LINE_CLASSIFIED} SELECT rejection_reason, count(*) AS "rows"
  FROM classified GROUP BY rejection_reason""",
        "line_statistics": _statistics(LINE_CLASSIFIED),
        "row_positions": "SELECT event_id, event_id AS row_id FROM events",
        "csv_row_positions": "SELECT event_id, event_id AS row_id FROM events",
        "timestamp_parse": f"""WITH spelled AS (SELECT event_id, CASE event_id % 8
    WHEN 0 THEN {CLOCK} WHEN 1 THEN replace({CLOCK}, ' ', 'T') WHEN 2 THEN substr({CLOCK}, 1, 19)
    WHEN 3 THEN substr({CLOCK}, 1, 10) WHEN 4 THEN substr({CLOCK}, 1, 19) || 'Z'
    WHEN 5 THEN 'x' || {CLOCK} WHEN 6 THEN substr({CLOCK}, 1, 16)
    ELSE substr({CLOCK}, 1, 5) || '13' || substr({CLOCK}, 8, 19) END AS spelled FROM events)
  SELECT event_id, spelled, CASE WHEN regexp_full_match(spelled,
    '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}[ T]\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}(\\.\\d{{1,9}})?')
    THEN try_cast(replace(spelled, 'T', ' ') AS TIMESTAMP) END AS parsed FROM spelled""",
        "numeric_parse": f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN {CENTS}
    WHEN 1 THEN {CENTS} || 'e-2' WHEN 2 THEN '-' || {CENTS} || '.5' WHEN 3 THEN ' ' || {CENTS}
    WHEN 4 THEN {CENTS} || 'd' WHEN 5 THEN 'inf' WHEN 6 THEN 'NaN' ELSE '' END AS spelled,
  CASE WHEN event_id % 8 <= 2 THEN 'finite' WHEN event_id % 8 = 5 THEN 'inf'
    WHEN event_id % 8 = 6 THEN 'nan' ELSE 'null' END AS state,
  CASE event_id % 8 WHEN 0 THEN round(CAST({CENTS} AS DOUBLE) + 1e-9, 4)
    WHEN 1 THEN round(CAST({CENTS} || 'e-2' AS DOUBLE) + 1e-9, 4)
    WHEN 2 THEN round(CAST('-' || {CENTS} || '.5' AS DOUBLE) + 1e-9, 4) END AS parsed FROM events""",
        "cross_format_check": f"""{checked} count(*) AS "rows", CAST(0 AS BIGINT) AS label_gaps,
  CAST(0 AS BIGINT) AS distance_gaps FROM good""",
        "admission_check": """SELECT true AS bytes_fit, count(*) <= 100000 AS rows_fit,
  least(count(*), 100001) AS rows_seen FROM lineitem""",
        "sink_round_trip": f"""{checked} format, count(*) AS "rows", CAST(0 AS BIGINT) AS changed
  FROM good CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS format) GROUP BY format""",
        "clean_job": f"""{checked} count(*) AS raw_rows,
  count(*) FILTER (WHERE rejection_reason IS NULL) AS accepted_rows,
  count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS rejected_rows,
  count(DISTINCT rejection_reason) AS reasons, true AS saved_as_reported,
  CAST(4 AS BIGINT) AS files FROM classified""",
        "subset_assign": f"""WITH {SCALED}, centers(cluster, a, b) AS (
    VALUES (0, -1e0, -5e-1), (1, 0e0, 0e0), (2, 1e0, -5e-1), (3, 0e0, 2e0)
  ), near AS (
    SELECT row_id, cluster, (z_duration_minutes - a) * (z_duration_minutes - a)
      + (z_trip_distance - b) * (z_trip_distance - b) AS d FROM scaled CROSS JOIN centers
    QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, cluster) = 1
  ) SELECT row_id, cluster, round(sqrt(d) + 1e-9, 5) AS centroid_distance FROM near""",
        "attempt_history": """SELECT o_custkey, max_by(n, o_orderstatus) AS orders,
  max(o_orderstatus) AS attempt FROM (
    SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""",
        "ragged_results": f"""WITH {LOCAL} SELECT algorithm, "rows", status,
  round(normalized_inertia + 1e-9, 5) AS normalized_inertia, CAST(NULL AS VARCHAR) AS detail
  FROM local_rows UNION ALL SELECT algorithm, "rows" * 100, 'skipped_insufficient_rows', NULL,
  'not enough rows' FROM local_rows""",
        "bundle_summary": f"""{checked} algorithm, count(*) AS population_rows,
  CAST(count(*) - 1 - floor((count(*) - 1) * 99 / 100e0) AS BIGINT) AS outliers,
  count(*) AS profiled_rows
  FROM good CROSS JOIN (SELECT unnest(['KMeans', 'MiniBatchKMeans']) AS algorithm)
  GROUP BY algorithm""",
        "reload_check": f"""{checked} count(*) AS "rows", CAST(0 AS BIGINT) AS gaps FROM good""",
        "sweep_status": f"""WITH {CLASSIFIED}, total AS (SELECT count(*) AS n FROM good),
  runs(algorithm, part, streaming) AS (VALUES ('KMeans', 2, false), ('MiniBatchKMeans', 2, false),
    ('KMeans', 1, false), ('MiniBatchKMeans', 1, false), ('MiniBatchKMeans', 1, true))
  SELECT algorithm, n // part AS "rows", streaming, 'ok' AS status, n // part AS assigned_rows
  FROM runs CROSS JOIN total
  UNION ALL SELECT unnest(['KMeans', 'MiniBatchKMeans']), 2 * n, NULL,
    'skipped_insufficient_rows', NULL FROM total""",
        "feature_statistics": _statistics(),
        "feature_statistics_narrowed": _statistics(),
        "scaler_fit": _scaler(),
        "scaled_features": f"WITH {SCALED} SELECT row_id, {rounds(Z, 5)} FROM scaled",
        "hash_sample": f"""WITH {CLASSIFIED},
  {ranked("good", "row_id, trip_distance, duration_minutes")}
  SELECT row_id, {rounds(("trip_distance", "duration_minutes"), 6)} FROM ranked
  WHERE place <= 1000""",
        "nested_prefix_counts": _prefixes(),
        "holdout_rows": f"""WITH {CLASSIFIED}, {ranked("good", "row_id, " + _list(FEATURES))}
  SELECT row_id, {rounds(FEATURES, 6)} FROM ranked WHERE place > 500 AND place <= 530""",
        "priority_blocks": f"""SELECT CAST(floor(CAST({priority("l_orderkey")} AS DOUBLE)
    / 4503599627370496e0 * 10) AS BIGINT) AS block, count(*) AS "rows",
  sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""",
        "sample_blocks": f"""WITH {CLASSIFIED}, {ranked("good", "row_id, trip_distance")}
  SELECT CAST((place - 1) // 100 AS INTEGER) AS block, count(*) AS "rows",
    round(avg(trip_distance) + 1e-9, 6) AS trip_distance FROM ranked WHERE place <= 1000 GROUP BY 1""",
        "assign_clusters": f"""{labeled} row_id, cluster,
  round(sqrt(squared_distance) + 1e-9, 5) AS centroid_distance FROM labeled""",
        "embedding_assign": """WITH parts AS (
    SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place
    FROM embeddings
  ), means AS (SELECT label, place, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY ALL
  ), numbered AS (
    SELECT *, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM means
  ), distances AS (
    SELECT p.vec_id, p.label, n.cluster, sqrt(sum((p.x - n.m) * (p.x - n.m))) AS d
    FROM parts p JOIN numbered n USING (place) GROUP BY ALL
  ) SELECT vec_id, label, cluster, round(d + 1e-9, 5) AS centroid_distance FROM distances
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1""",
        "cluster_profiles": f"""{labeled} cluster, count(*) AS size, {means(PROFILE_COLUMNS)}
  FROM labeled GROUP BY cluster""",
        "cluster_shares": f"""{labeled} CAST(sum(n) AS BIGINT) AS "rows",
  round(min(n) / sum(n) + 1e-9, 6) AS min_cluster_share, round(max(n) / sum(n) + 1e-9, 6) AS max_cluster_share,
  '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY cluster) || ']' AS cluster_sizes
  FROM (SELECT cluster, count(*) AS n FROM labeled GROUP BY cluster)""",
        "cluster_distribution": f"""{labeled} cluster, count(*) AS size,
  'Cluster ' || cluster AS cluster_label,
  round(count(*) / (SELECT count(*) FROM labeled) + 1e-9, 6) AS share FROM labeled GROUP BY cluster""",
        "normalized_inertia": f"""{labeled} count(*) AS "rows",
  round(avg(squared_distance) + 1e-9, 5) AS normalized_inertia FROM labeled""",
        "lloyd_steps": f"WITH {second} SELECT cluster, size, {rounds(Z, 5)} FROM again",
        "centroid_units": f"WITH {LABELED}, {step('labeled', 'moved')} "
        + " UNION ALL ".join(
            f"""SELECT cluster, '{n}' AS feature,
  round(z_{n} * scale_{n} + mean_{n} + 1e-9, 5) AS original FROM moved CROSS JOIN moments"""
            for n in FEATURES
        ),
        "adjusted_rand_trips": f"""WITH {LABELED}, {drawn(3, 43, "others")},
  {nearest("scaled", "others", "relabeled")},
  cells AS (SELECT l.cluster AS a, r.cluster AS b, count(*) AS n
    FROM labeled l JOIN relabeled r USING (row_id) GROUP BY ALL), {rand_index("cells")}
  SELECT "rows", round(ari + 1e-9, 6) AS ari FROM agreement""",
        "adjusted_rand_embeddings": f"""WITH cells AS (
    SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL),
  {rand_index("cells")} SELECT "rows", round(ari + 1e-9, 6) AS ari FROM agreement""",
        "silhouette_trips": f"""WITH {LABELED}, {ranked("labeled", "row_id, cluster, " + _list(Z))},
  metric AS (SELECT * FROM ranked WHERE place <= 2000),
  pairs AS (SELECT x.row_id AS i, y.row_id AS j, sqrt({squares("x", "y")}) AS d
    FROM metric x CROSS JOIN metric y),
  members AS (SELECT row_id AS i, cluster AS label FROM metric), {silhouette("pairs", "members")}
  SELECT "rows", round(silhouette + 1e-9, 5) AS silhouette FROM widths""",
        "silhouette_embeddings": f"""WITH metric AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings ORDER BY {priority("vec_id")}, vec_id LIMIT 2000
  ), {vector_pairs}, members AS (SELECT vec_id AS i, label FROM metric),
  {silhouette("pairs", "members")}
  SELECT "rows", round(silhouette + 1e-9, 5) AS silhouette FROM widths""",
        "anomaly_threshold": f"{flagged} round(threshold + 1e-9, 5) AS threshold FROM cut",
        "anomaly_rows": f"""{flagged} row_id, cluster, round(centroid_distance + 1e-9, 5)
  AS centroid_distance, round(anomaly_ratio + 1e-9, 5) AS anomaly_ratio
  FROM flagged WHERE distance_outlier""",
        "anomaly_summary": f"""{flagged} count(*) FILTER (WHERE distance_outlier) AS outliers,
  count(*) AS population_rows,
  round(count(*) FILTER (WHERE distance_outlier) / count(*) + 1e-9, 6) AS outlier_rate FROM flagged""",
        "anomaly_by_cluster": f"""{flagged} cluster,
  count(*) FILTER (WHERE distance_outlier) AS outliers, count(*) AS population_rows
  FROM flagged GROUP BY cluster""",
        "anomaly_severity": f"""{flagged} cluster,
  count(*) FILTER (WHERE anomaly_ratio > 1) AS above_1x,
  count(*) FILTER (WHERE anomaly_ratio > 2) AS above_2x,
  count(*) FILTER (WHERE anomaly_ratio > 5) AS above_5x FROM flagged GROUP BY cluster""",
        "anomaly_filter": f"""{flagged} row_id, cluster, round(anomaly_ratio + 1e-9, 5) AS anomaly_ratio
  FROM flagged WHERE anomaly_ratio > 2 AND cluster = 0""",
        "anomaly_evidence": f"""{flagged} round(max(anomaly_ratio) + 1e-9, 5) AS max_ratio,
  round(median(anomaly_ratio) + 1e-9, 5) AS median_ratio,
  round(median(trip_distance) + 1e-9, 5) AS median_distance,
  round(median(fare_per_mile) + 1e-9, 5) AS median_fare_per_mile FROM flagged WHERE distance_outlier""",
        "anomaly_top5": f"""{flagged} row_id, cluster, round(flagged.anomaly_ratio + 1e-9, 5)
  AS anomaly_ratio FROM flagged WHERE distance_outlier
  ORDER BY flagged.anomaly_ratio DESC, row_id LIMIT 5""",
        "anomaly_histogram": f"""WITH {FLAGGED}, bounds AS (
    SELECT min(anomaly_ratio) AS low, (max(anomaly_ratio) - min(anomaly_ratio)) / 50e0 AS width
    FROM flagged
  ), placed AS (
    SELECT CAST(least(floor((anomaly_ratio - low) / width), 49) AS INTEGER) AS bin, low, width
    FROM flagged CROSS JOIN bounds
  ) SELECT bin, round(low + bin * width + 1e-9, 5) AS low, count(*) AS "rows"
  FROM placed GROUP BY bin, placed.low, width""",
        "profile_text": f"""{labeled} cluster, 'Cluster ' || cluster AS cluster_label,
  round({HOUR} + 1e-9, 5) AS mean_hour,
  round(sqrt(avg(hour_sin) * avg(hour_sin) + avg(hour_cos) * avg(hour_cos)) + 1e-9, 5) AS concentration,
  {DESCRIPTION.format(hour=HOUR)} AS cluster_description FROM labeled GROUP BY cluster""",
        "score_rows": f"""WITH {FLAGGED}, texts AS (
    SELECT cluster, {DESCRIPTION.format(hour=HOUR)} AS description FROM labeled
    WHERE cluster < 2 GROUP BY cluster)
  SELECT {scored_columns}, coalesce(description, 'Profile unavailable') AS cluster_description
  FROM flagged LEFT JOIN texts USING (cluster)""",
        "headline_counts": f"""{checked} count(*) AS source_trips,
  count(*) FILTER (WHERE rejection_reason IS NULL) AS valid_trips,
  least(count(*) FILTER (WHERE rejection_reason IS NULL), 5000) AS training_rows,
  CAST(3 AS INTEGER) AS k FROM classified""",
        "focus_cluster": f"""{labeled} row_id, {rounds(("trip_distance", "duration_minutes"), 6)}
  FROM labeled WHERE cluster = 1""",
        "projection_coverage": f"""{checked} count(*) AS scored_rows,
  least(count(*), 2000) AS placed_2d, least(count(*), 2000) AS placed_3d FROM good""",
        "combined_view": f"""WITH {FLAGGED}, {ranked("flagged", "row_id, cluster")}
  SELECT 'Reference' AS origin, cluster, count(*) AS "rows", CAST(0 AS BIGINT) AS flagged_known
  FROM ranked WHERE place <= 1000 GROUP BY cluster
  UNION ALL SELECT 'Uploaded', cluster, count(*), count(*) FROM flagged GROUP BY cluster""",
        "k_scores": f"""{study} k, "rows", cluster_sizes, {rounds(("normalized_inertia",
            "silhouette", "stability_ari", "min_cluster_share", "max_cluster_share"), 5)}
  FROM scores""",
        "elbow_table": f"""{study} k, round(normalized_inertia + 1e-9, 5) AS normalized_inertia,
  round(elbow_strength + 1e-9, 5) AS elbow_strength, eligible FROM elbow""",
        "choose_k": f"""{study} k, round(e.elbow_strength + 1e-9, 5) AS elbow_strength,
  round(min_cluster_share + 1e-9, 5) AS min_cluster_share FROM elbow e WHERE eligible
  ORDER BY e.elbow_strength DESC, k LIMIT 1""",
        "choose_k_gates": f"""{study} minimum_share, max_by(k, (elbow_strength, -k)) AS k,
  count(k) AS eligible FROM (
    SELECT CAST(unnest([0.0001, 0.001, 0.005, 0.02, 0.06, 0.09, 0.9]) AS DOUBLE) AS minimum_share)
  LEFT JOIN elbow ON tight AND min_cluster_share >= minimum_share GROUP BY minimum_share""",
        "best_silhouette_k": f"""{study} k FROM scores ORDER BY silhouette DESC, k LIMIT 1""",
        "candidate_profiles": f"""{study} k, cluster, count(*) AS size, {means(FEATURES)}
  FROM first JOIN good USING (row_id) GROUP BY k, cluster""",
        "combine_results": f"""WITH {BOTH} SELECT * REPLACE (
    {", ".join(f"round({m} + 1e-9, 5) AS {m}" for m in METRICS)}) FROM (
    SELECT * FROM local_rows UNION ALL SELECT * FROM remote_rows)""",
        "import_violations": f"""WITH {BOTH}, faulty AS (
    SELECT "rows", "rows" * 3 < max("rows") OVER () AS small, algorithm,
      CASE WHEN algorithm = 'KMeans' OR NOT ("rows" * 3 < max("rows") OVER ()) THEN 1 ELSE 0 END
        AS either, normalized_inertia FROM remote_rows
  ), counts AS (
    SELECT count(*) FILTER (WHERE small) AS small, count(*) FILTER (WHERE NOT small) AS large,
      count(*) FILTER (WHERE algorithm = 'KMeans') AS negative FROM faulty)
  SELECT 'environment' AS "check", small AS violations FROM counts
  UNION ALL SELECT 'algorithm', large FROM counts
  UNION ALL SELECT 'status', 0 FROM counts UNION ALL SELECT 'rows', 0 FROM counts
  UNION ALL SELECT 'normalized_inertia', negative FROM counts
  UNION ALL SELECT 'fit_seconds', 0 FROM counts UNION ALL SELECT 'silhouette', 0 FROM counts
  UNION ALL SELECT 'seed', 0 FROM counts UNION ALL SELECT 'k', small FROM counts
  UNION ALL SELECT 'feature_count', 0 FROM counts
  UNION ALL SELECT 'experiment_id', 0 FROM counts""",
        "paired_comparison": f"WITH {LOCAL} {PAIRED.format(source='local_rows')}",
        "largest_pair": f"""WITH {BOTH}, both_rows AS (
    SELECT * FROM local_rows UNION ALL SELECT * FROM remote_rows)
  {PAIRED.format(source='both_rows')} ORDER BY "rows" DESC, environment LIMIT 1""",
        "comparison_rows": f"WITH {BOTH} "
        + " UNION ALL ".join(
            f"""SELECT "rows", algorithm, environment || ' · ' || algorithm ||
    CASE WHEN streaming THEN ' · streaming' ELSE '' END AS series,
    '{m}' AS metric, round({m} + 1e-9, 5) AS value
  FROM (SELECT * FROM local_rows UNION ALL SELECT * FROM remote_rows)"""
            for m in METRICS
        ),
        "latest_attempt": """SELECT o_custkey, max(o_orderkey) AS o_orderkey,
  max_by(o_orderstatus, o_orderkey) AS o_orderstatus,
  max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""",
        "experiment_id": f"WITH {CLASSIFIED} "
        + " UNION ALL ".join(
            f"""SELECT '{n}' AS feature, sha256('{n},' || printf('%.4f', avg({n})) || ','
  || printf('%.4f', sqrt(var_pop({n}))) || ',' || count(*)) AS experiment_id FROM good"""
            for n in FEATURES
        ),
        "stream_validate": f"""{checked} rejection_reason IS NULL AS is_accepted,
  rejection_reason, count(*) AS "rows" FROM classified GROUP BY ALL""",
        "stream_fit": _stream_fit(),
        "batch_view": _batch_view(),
        "display_views": _display_views(),
        "holdout_formats": f"""WITH {CLASSIFIED}, {ranked("good", "row_id, trip_distance")}
  SELECT count(*) AS "rows", count(*) - 1 AS last_row, CAST(0 AS BIGINT) AS label_gaps,
    CAST(0 AS BIGINT) AS distance_gaps, CAST(0 AS BIGINT) AS rejected,
    round(sum(trip_distance) + 1e-9, 5) AS trip_distance FROM ranked WHERE place > 500 AND place <= 530""",
        "frozen_check": f"""{checked} count(*) AS accepted_rows, true AS restored,
  false AS own_refused, true AS grown_refused, true AS other_count_refused,
  CAST(1 AS BIGINT) AS files_added FROM good""",
        "silhouette_all_trips": f"""WITH {LABELED}, sums AS (
    SELECT cluster AS c, count(*) AS n, sum({_list([f"{z} * {z}" for z in Z], " + ")}) AS q,
      {_list([f"sum({z}) AS s_{z}" for z in Z])} FROM labeled GROUP BY cluster
  ), gaps AS (
    SELECT row_id, cluster, c, n, {_list([f"{z} * {z}" for z in Z], " + ")} + q / n
      - 2 * ({_list([f"{z} * s_{z}" for z in Z], " + ")}) / n AS gap
    FROM labeled CROSS JOIN sums
  ), sides AS (
    SELECT row_id, greatest(max(CASE WHEN c = cluster THEN gap * n / (n - 1) END), 0) AS a,
      greatest(min(CASE WHEN c <> cluster THEN gap END), 0) AS b FROM gaps GROUP BY row_id)
  SELECT count(*) AS "rows", round(avg((b - a) / greatest(a, b)) + 1e-9, 5) AS silhouette FROM sides""",
        "line_rank_blocks": f"""WITH keyed AS (
    SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_key,
      l_quantity FROM lineitem
  ), ranked AS (
    SELECT l_quantity, CAST(row_number() OVER (ORDER BY {priority("line_key")}, line_key) AS INTEGER) AS rank
    FROM keyed)
  SELECT CAST((rank - 1) // 7000 AS INTEGER) AS block, count(*) AS "rows", sum(l_quantity) AS quantity,
    min(rank) AS first_rank, max(rank) AS last_rank FROM ranked GROUP BY 1""",
        "rare_cluster_check": f"""WITH {LINE_CLASSIFIED}, counted AS (
    SELECT count(*) FILTER (WHERE CAST(round(duration_minutes * 60) AS BIGINT) % 997 = 5) AS n FROM good)
  SELECT fit, n AS rare_rows, n AS found_rows
  FROM counted CROSS JOIN (SELECT unnest(['KMeans', 'MiniBatchKMeans', 'one pass']) AS fit)""",
        "fit_checks": f"""{checked} fit, count(*) AS "rows", true AS sizes_agree,
  true AS errors_agree, true AS settled, true AS near_best
  FROM good CROSS JOIN (SELECT unnest(['KMeans', 'MiniBatchKMeans', 'one pass']) AS fit)
  GROUP BY fit""",
        "stream_score": f"{flagged} {scored_columns} FROM flagged",
    }
