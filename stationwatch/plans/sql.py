"""The same results in standard SQL, built from named parts, for comparison on another engine."""

from __future__ import annotations

from ..config import MAD_FACTOR, VARIABLES, ReconstructionConfig, SpatialConfig, StatisticalConfig
from ..operators.diagnosis import CONFIDENCE, PRECEDENCE
from ..operators.evaluate import BUFFER, DIAGNOSIS_OF
from ..operators.inject import FALLBACK_SCALES, SEVERITY_SHARES, STRENGTHS, TYPE_SHARES, InjectionConfig

V = VARIABLES
Part = list[tuple[str, str]]
STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"


def with_(*parts: Part) -> str:
    """WITH and the parts in order, each name once."""
    seen: dict[str, str] = {}
    for part in parts:
        for name, body in part:
            seen.setdefault(name, body)
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in seen.items()) + "\n"


def join(items, sep: str = ", ") -> str:
    return sep.join(items)


def b(condition: str) -> str:
    return f"coalesce({condition}, false)"


def _units(v: str) -> str:
    return f"CAST(round({v} * 1e6) AS HUGEINT)"


def mean6(v: str) -> str:
    return f"floor((2 * CAST(sum({_units(v)}) AS DOUBLE) + count({v})) / nullif(2 * count({v}), 0)) / 1e6"


EVENTS: Part = [("ev", f"""SELECT event_type AS station_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, {mean6('value')} AS temperature,
    CAST(count(*) AS DOUBLE) AS humidity, round(max(value), 6) AS pressure FROM events GROUP BY 1, 2""")]
LINES: Part = [("ln", f"""SELECT l_returnflag || l_linestatus AS station_id, CAST(l_shipdate AS TIMESTAMP) AS timestamp, {mean6('l_quantity')} AS temperature,
    {mean6('l_discount')} AS humidity, {mean6('l_extendedprice')} AS pressure FROM lineitem GROUP BY 1, 2""")]


def history(obs: str, cut: str) -> Part:
    return [(f"{obs}_hist", f"SELECT * FROM {obs} WHERE timestamp < TIMESTAMP '{cut}'")]


# ----------------------------------------------------------------- statistical


def hourly(hist: str, name: str, config: StatisticalConfig) -> Part:
    steps = join(f"abs({v} - lag({v}) OVER (PARTITION BY station_id ORDER BY timestamp)) AS d_{v}" for v in V)
    mean = lambda v: f"floor((2 * CAST(sum({_units(v)}) AS DOUBLE) + 100 * count({v})) / nullif(200 * count({v}), 0)) / 1e4"
    columns = join(f"{mean(v)} AS {v}_baseline, round(quantile_cont(d_{v}, {config.roc_quantile}), 6) AS {v}_roc_limit" for v in V)
    return [(f"{name}_steps", f"SELECT station_id, hour(timestamp) AS hour, {join(V)}, {steps} FROM {hist}"), (name, f"SELECT station_id, hour, {columns} FROM {name}_steps GROUP BY 1, 2")]


def statistical(obs: str, hours: str, name: str, config: StatisticalConfig) -> Part:
    w = "OVER (PARTITION BY station_id ORDER BY timestamp"
    joined = f"""SELECT o.*, {join(f'h.{v}_roc_limit, round(o.{v} - h.{v}_baseline, 6) AS {v}_hourly_residual' for v in V)}
        FROM {obs} o LEFT JOIN {hours} h ON o.station_id = h.station_id AND hour(o.timestamp) = h.hour"""
    windows = [f"round(abs({v} - lag({v}) {w})), 6) AS {v}_rate_of_change" for v in V]
    n = config.persistence_rows
    for v in V:
        recent = f"{w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        windows += [f"sum({_units(v)}) {recent} AS {v}_ps, sum({_units(v)} * {_units(v)}) {recent} AS {v}_pq, count({v}) {recent} AS {v}_pn"]
        for k in config.windows:
            frame = f"{w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
            units = _units(f"{v}_hourly_residual")
            windows += [f"sum({units}) {frame} AS {v}_{k}_s", f"sum({units} * {units}) {frame} AS {v}_{k}_q", f"count({v}_hourly_residual) {frame} AS {v}_{k}_n"]
    flags = []
    for v in V:
        low, high = config.ranges[v]
        flags += [f"{b(f'{v} < {low} OR {v} > {high}')} AS {v}_range_anomaly", f"{b(f'{v}_rate_of_change > {v}_roc_limit')} AS {v}_roc_anomaly",
                  f"{b(f'{v}_pn >= {n} AND CAST({v}_pn * {v}_pq - {v}_ps * {v}_ps AS DOUBLE) < {(config.persistence_tolerance * 1e6) ** 2!r}::DOUBLE * {v}_pn * ({v}_pn - 1)')} AS {v}_persistence_anomaly"]
        for k in config.windows:
            seen, total = (f"CAST({v}_{k}_{a} AS DOUBLE)" for a in "ns")
            spread = f"CAST({v}_{k}_n * {v}_{k}_q - {v}_{k}_s * {v}_{k}_s AS DOUBLE)"
            flags += [f"CASE WHEN {v}_{k}_n >= {max(2, min(config.least_rows, k))} AND {spread} >= 0.5 THEN round(abs(round({v}_hourly_residual * 1e6) - {total} / {seen}) / sqrt(greatest({spread}, 0.5) / ({seen} * ({seen} - 1))), 6) END AS {v}_zscore_{k}h"]
    z = join(f"{b(f'{v}_zscore_{k}h > {config.z_limit}')} AS {v}_zscore_{k}h_anomaly" for v in V for k in config.windows)
    family = {"range": [f"{v}_range_anomaly" for v in V], "roc": [f"{v}_roc_anomaly" for v in V],
              "level": [f"{v}_zscore_{k}h_anomaly" for v in V for k in config.windows], "persistence": [f"{v}_persistence_anomaly" for v in V]}
    evidence = join(f"({join(c, ' OR ')}) AS evidence_{f}" for f, c in family.items())
    count = join((f"CAST({c} AS INTEGER)" for columns in family.values() for c in columns), " + ")
    families = join((f"CAST(evidence_{f} AS INTEGER)" for f in family), " + ")
    return [
        (f"{name}_j", joined), (f"{name}_w", f"SELECT *, {join(windows)} FROM {name}_j"), (f"{name}_f", f"SELECT *, {join(flags)} FROM {name}_w"), (f"{name}_z", f"SELECT *, {z} FROM {name}_f"),
        (f"{name}_e", f"SELECT *, {evidence}, {count} AS statistical_flag_count FROM {name}_z"),
        (f"{name}_c", f"SELECT *, {families} AS statistical_family_count FROM {name}_e"),
        (name, f"""SELECT *, statistical_flag_count > 0 AS statistical_raw_alert, CASE WHEN evidence_range THEN 'critical' WHEN evidence_persistence THEN 'anomaly'
            WHEN statistical_family_count >= 2 THEN 'anomaly' WHEN statistical_family_count = 1 THEN 'suspicious' ELSE 'normal' END AS statistical_severity_label,
            CASE WHEN evidence_range THEN 1.0 WHEN evidence_persistence OR statistical_family_count >= 2 THEN 0.67 WHEN statistical_family_count = 1 THEN 0.33 ELSE 0.0 END::DOUBLE AS statistical_severity,
            evidence_range OR evidence_persistence OR statistical_family_count >= 2 AS statistical_alert FROM {name}_c"""),
    ]


# --------------------------------------------------------------------- spatial


def places(obs: str, name: str) -> Part:
    degree = lambda what, low: f"round({low} + {_u('station_id', chr(39) + what + chr(39))}, 6)"
    return [(name, f"SELECT station_id, {degree('latitude', 28)} AS latitude, {degree('longitude', 77)} AS longitude FROM (SELECT DISTINCT station_id FROM {obs})")]


def graph(obs: str, name: str, config: SpatialConfig) -> Part:
    return [
        *places(obs, f"{name}_s"),
        (f"{name}_d", f"""SELECT a.station_id, o.station_id AS neighbor_id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(o.latitude - a.latitude) / 2), 2)
            + cos(radians(a.latitude)) * cos(radians(o.latitude)) * pow(sin(radians(o.longitude - a.longitude) / 2), 2))), 6) AS distance_km FROM {name}_s a JOIN {name}_s o ON a.station_id <> o.station_id"""),
        (f"{name}_r", f"SELECT *, CAST(row_number() OVER (PARTITION BY station_id ORDER BY distance_km, neighbor_id) AS INTEGER) AS rank FROM {name}_d"),
        (name, f"""SELECT station_id, neighbor_id, rank, distance_km, (1 / pow(greatest(distance_km, 1e-6), {config.power})) / sum(1 / pow(greatest(distance_km, 1e-6), {config.power}))
            OVER (PARTITION BY station_id) AS weight FROM {name}_r WHERE rank <= {config.neighbours}"""),
    ]


def residuals(obs: str, g: str, name: str, config: SpatialConfig) -> Part:
    out: Part = []
    for v in V:
        out += [
            (f"{name}_{v}_p", f"SELECT o.timestamp, g.station_id, g.weight AS w, o.x FROM (SELECT timestamp, station_id, avg({v}) AS x FROM {obs} WHERE isfinite({v}) GROUP BY 1, 2) o JOIN {g} g ON o.station_id = g.neighbor_id"),
            (f"{name}_{v}_m", f"SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY timestamp, station_id) AS med, count(*) OVER (PARTITION BY timestamp, station_id) AS n FROM {name}_{v}_p"),
            (f"{name}_{v}_s", f"SELECT *, {MAD_FACTOR} * quantile_cont(abs(x - med), 0.5) OVER (PARTITION BY timestamp, station_id) AS scale FROM {name}_{v}_m"),
            (f"{name}_{v}_k", f"""SELECT *, CASE WHEN n < 3 THEN true WHEN scale > {config.least_scale} THEN abs(x - med) / scale <= {config.robust_limit}
                ELSE abs(x - med) <= greatest(1e-6, abs(med) * 1e-6) END AS kept FROM {name}_{v}_s"""),
            (f"{name}_{v}", f"""SELECT timestamp, station_id, round(sum(x * w) FILTER (kept) / sum(w) FILTER (kept), 6) AS e, CAST(count(*) FILTER (kept) AS INTEGER) AS c, round(max(scale), 6) AS m
                FROM {name}_{v}_k GROUP BY 1, 2"""),
        ]
    columns = join(f"{v}.e AS {v}_spatial_expected, coalesce({v}.c, 0) AS {v}_spatial_neighbor_count, {v}.m AS {v}_spatial_neighbor_mad, round(o.{v} - {v}.e, 6) AS {v}_spatial_residual" for v in V)
    joins = " ".join(f"LEFT JOIN {name}_{v} {v} ON o.station_id = {v}.station_id AND o.timestamp = {v}.timestamp" for v in V)
    return [*out, (name, f"SELECT o.*, {columns} FROM {obs} o {joins}")]


def spatial_limits(rows: str, name: str, config: SpatialConfig) -> Part:
    columns = []
    for v in V:
        usable = f"{v}_spatial_neighbor_count >= {config.least_neighbours}"
        for tier, q in zip(("suspicious", "anomaly"), config.humidity_quantiles if v == "humidity" else config.quantiles, strict=True):
            columns.append(f"CASE WHEN count(*) FILTER ({usable}) >= {config.least_calibration_rows} THEN round(quantile_cont(abs({v}_spatial_residual), {q}) FILTER ({usable}), 6) END AS {v}_{tier}_limit")
    return [(name, f"SELECT station_id, {join(columns)} FROM {rows} GROUP BY 1")]


def spatial(rows: str, limits: str, name: str, config: SpatialConfig) -> Part:
    flags = join(f"{b(f'r.{v}_spatial_neighbor_count >= {config.least_neighbours} AND abs(r.{v}_spatial_residual) > l.{v}_{t}_limit')} AS {v}_spatial_{t}" for v in V for t in ("suspicious", "anomaly"))
    return [
        (f"{name}_f", f"SELECT r.*, {flags} FROM {rows} r LEFT JOIN {limits} l ON r.station_id = l.station_id"),
        (name, f"""SELECT *, {join((f'CAST({v}_spatial_suspicious AS INTEGER)' for v in V), ' + ')} AS spatial_family_count,
            CASE WHEN temperature_spatial_anomaly OR pressure_spatial_anomaly THEN 'anomaly' WHEN temperature_spatial_suspicious OR pressure_spatial_suspicious THEN 'suspicious' ELSE 'normal' END AS spatial_severity_level,
            temperature_spatial_anomaly OR pressure_spatial_anomaly AS spatial_alert FROM {name}_f"""),
    ]


# -------------------------------------------------------------- reconstruction


def normalisation(hist: str, name: str, config: ReconstructionConfig) -> Part:
    """The training part, its statistics, and the cutoff."""
    columns = join(f"coalesce(round(avg({v}), 6), 0.0) AS {v}_mean, CASE WHEN round(stddev_pop({v}), 6) > 1e-6 THEN round(stddev_pop({v}), 6) ELSE 1.0 END AS {v}_std" for v in config.variables)
    keep = 1 - config.validation_share
    return [
        (f"{name}_cut", f"SELECT make_timestamp(CAST(round(min(epoch_us(timestamp)) + (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) * {keep}) AS BIGINT)) AS cutoff FROM {hist}"),
        (f"{name}_train", f"SELECT * FROM {hist} WHERE timestamp < (SELECT cutoff FROM {name}_cut)"), (f"{name}_held", f"SELECT * FROM {hist} WHERE timestamp >= (SELECT cutoff FROM {name}_cut)"),
        (name, f"SELECT station_id, count(*) AS n, {columns} FROM {name}_train GROUP BY 1 HAVING count(*) >= {config.own_statistics_rows} UNION ALL SELECT '__global__', count(*), {columns} FROM {name}_train"),
    ]


def windows(obs: str, stats: str, name: str, config: ReconstructionConfig) -> Part:
    vs, size, half = config.variables, config.window, config.fill_run
    use = join(f"coalesce(s.{v}_{k}, g.{v}_{k}) AS {v}_{k}" for v in vs for k in ("mean", "std"))
    z = join(f"CASE WHEN {v} IS NOT NULL THEN round(least(greatest(({v} - {v}_mean) / {v}_std, -{config.clip}), {config.clip}), 6) END AS {v}_z" for v in vs)
    frame = f"(PARTITION BY station_id, segment ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    lists = join([f"list(timestamp) OVER {frame} AS times", *(f"list({v}_z) OVER {frame} AS {v}_l" for v in vs)])
    valid = join((f"len(list_filter({v}_l, lambda x: x IS NOT NULL))" for v in vs), " + ")
    ahead = lambda c: f"list_transform({c}, lambda x, i: coalesce(x, {join(f'CASE WHEN i > {k} THEN {c}[i - {k}] END' for k in range(1, half + 1))}))"
    back = lambda c: f"list_transform({c}, lambda x, i: coalesce(x, {join(f'{c}[i + {k}]' for k in range(1, half + 1))}))"
    whole = join((f"len(list_filter({v}_cells, lambda x: x IS NULL)) = 0" for v in vs), " AND ")
    gap = "epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY station_id ORDER BY timestamp)"
    return [
        (f"{name}_n0", f"SELECT o.*, {use} FROM {obs} o LEFT JOIN {stats} s ON o.station_id = s.station_id CROSS JOIN (SELECT * FROM {stats} WHERE station_id = '__global__') g"),
        (f"{name}_n", f"SELECT *, {z} FROM {name}_n0"), (f"{name}_gaps", f"SELECT station_id, timestamp, CAST({gap} AS BIGINT) AS gap FROM {obs}"),
        (f"{name}_step", f"""SELECT s.station_id, coalesce(t.gap, 3600) AS step FROM (SELECT DISTINCT station_id FROM {obs}) s LEFT JOIN (SELECT station_id, gap, row_number() OVER (PARTITION BY station_id
            ORDER BY count(*) DESC, min(timestamp)) AS rn FROM {name}_gaps WHERE gap IS NOT NULL GROUP BY 1, 2) t ON s.station_id = t.station_id AND t.rn = 1"""),
        (f"{name}_o", f"SELECT n.*, CASE WHEN {gap.replace('timestamp', 'n.timestamp').replace('station_id', 'n.station_id')} > t.step * {config.gap_tolerance} THEN 1 ELSE 0 END AS opens FROM {name}_n n JOIN {name}_step t ON n.station_id = t.station_id"),
        (f"{name}_g", f"SELECT *, CAST(sum(opens) OVER (PARTITION BY station_id ORDER BY timestamp) AS BIGINT) AS segment FROM {name}_o"),
        (f"{name}_s", f"SELECT *, CAST(row_number() OVER (PARTITION BY station_id, segment ORDER BY timestamp) - 1 AS INTEGER) AS pos FROM {name}_g"),
        (f"{name}_l", f"SELECT station_id, segment, pos AS start, {lists} FROM {name}_s"),
        (f"{name}_v", f"SELECT * FROM {name}_l WHERE len(times) = {size} AND start % {config.stride} = 0 AND ({valid}) / {size * len(vs)}.0 >= {config.least_valid}"),
        (f"{name}_a", f"SELECT *, {join(f'{ahead(f'{v}_l')} AS {v}_a' for v in vs)} FROM {name}_v"),
        (f"{name}_b", f"SELECT station_id, segment, start, times, {join(f'{back(f'{v}_a')} AS {v}_cells' for v in vs)} FROM {name}_a"),
        (name, f"SELECT * FROM {name}_b WHERE {whole}"),
    ]


def mean_scores(win: str, name: str, config: ReconstructionConfig) -> Part:
    vs = config.variables
    cells = join(f"unnest({v}_cells) AS {v}_c, list_aggregate({v}_cells, 'avg') AS {v}_r" for v in vs)
    errors = join([f"round(avg(pow({v}_c - {v}_r, 2)), 6) AS {v}_lstm_ae_error" for v in vs] + [f"avg({v}_r) AS {v}_rebuilt" for v in vs])
    total = join((f"{v}_lstm_ae_error" for v in vs), " + ")
    return [
        (f"{name}_c", f"SELECT station_id, unnest(times) AS timestamp, {cells} FROM {win}"), (f"{name}_e", f"SELECT station_id, timestamp, count(*) AS coverage, {errors} FROM {name}_c GROUP BY 1, 2"),
        (name, f"SELECT *, round(({total}) / {len(vs)}, 6) AS score FROM {name}_e"),
    ]


def score_limits(scores: str, name: str, config: ReconstructionConfig) -> Part:
    low, high = config.quantiles
    columns = {"": "score"} | {f"{v}_": f"{v}_lstm_ae_error" for v in config.variables}
    return [(name, "SELECT " + join(f"round(quantile_cont({c}, {q}), 6) AS {k}{p}" for k, c in columns.items() for p, q in (("p95", low), ("p99", high))) + f" FROM {scores}")]


def reconstruction(win: str, scores: str, bounds: str, name: str, config: ReconstructionConfig) -> Part:
    vs = config.variables
    top = " ".join(f"WHEN {v}_lstm_ae_error >= greatest({join(f'{x}_lstm_ae_error' for x in vs)}) THEN '{v}'" for v in vs)
    expected = join(f"round({v}_rebuilt * {v}_std + {v}_mean, 6) AS {v}_lstm_ae_expected" for v in vs)
    return [
        (f"{name}_j", f"SELECT n.*, s.* EXCLUDE (station_id, timestamp), l.p95, l.p99, s.coverage IS NOT NULL AS lstm_ae_scored FROM {win}_n n LEFT JOIN {scores} s ON n.station_id = s.station_id AND n.timestamp = s.timestamp CROSS JOIN {bounds} l"),
        (f"{name}_x", f"SELECT *, {expected} FROM {name}_j"),
        (name, f"""SELECT *, coalesce(coverage, 0) AS lstm_ae_coverage, score AS lstm_ae_score, CASE WHEN NOT lstm_ae_scored THEN 'unscored' WHEN score > p99 THEN 'anomaly' WHEN score > p95 THEN 'suspicious' ELSE 'normal' END AS lstm_ae_severity_label,
            {b('score > p95')} AS lstm_ae_suspicious, {b('score > p99')} AS lstm_ae_alert, CASE {top} END AS lstm_ae_top_contributor,
            round(CASE WHEN score IS NULL THEN 0.0 WHEN score <= p95 THEN least(greatest(0.33 * score / greatest(p95, 1e-9), 0.0), 0.33) WHEN score <= p99 THEN 0.33 + 0.34 * (score - p95) / greatest(p99 - p95, 1e-9)
            ELSE least(greatest(0.67 + 0.33 * (score - p99) / greatest(p99 - p95, 1e-9), 0.67), 1.0) END, 6) AS lstm_ae_severity_score, {join(f'round({v} - {v}_lstm_ae_expected, 6) AS {v}_lstm_ae_residual' for v in vs)} FROM {name}_x"""),
    ]


# ---------------------------------------------------------------------- fusion


def fused(stat: str, spat: str, recon: str, name: str, extra: str = "") -> Part:
    alerts = ("statistical_alert", "spatial_alert", "lstm_ae_alert")
    return [
        (f"{name}_j", f"""SELECT s.station_id, s.timestamp, {join(f's.{v}' for v in V)}{extra}, s.statistical_severity_label, s.statistical_severity, s.statistical_family_count, p.spatial_severity_level, p.spatial_family_count,
            r.lstm_ae_severity_label, r.lstm_ae_score, r.lstm_ae_severity_score, r.lstm_ae_scored, {b('s.statistical_alert')} AS statistical_alert, {b('p.spatial_alert')} AS spatial_alert, {b('r.lstm_ae_alert')} AS lstm_ae_alert
            FROM {stat} s LEFT JOIN {spat} p ON s.station_id = p.station_id AND s.timestamp = p.timestamp LEFT JOIN {recon} r ON s.station_id = r.station_id AND s.timestamp = r.timestamp"""),
        (f"{name}_v", f"SELECT *, {join((f'CAST({a} AS INTEGER)' for a in alerts), ' + ')} AS detector_votes FROM {name}_j"),
        (name, f"SELECT *, detector_votes >= 2 AS final_alert, ['normal', 'suspicious', 'anomaly', 'critical'][detector_votes + 1] AS final_severity, round(detector_votes / 3.0, 6)::DOUBLE AS final_confidence FROM {name}_v"),
    ]


# ------------------------------------------------------------------- injection


def _u(*key: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {join(key)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _choice(u: str, shares) -> str:
    total, out = 0.0, "CASE"
    for name, share in shares[:-1]:
        total += share
        out += f" WHEN {u} < {round(total, 10)} THEN '{name}'"
    return f"{out} ELSE '{shares[-1][0]}' END"


def injection(obs: str, name: str, config: InjectionConfig) -> Part:
    """{name}_events (plan), {name}_scaled (with local scales), {name}_rows (rows of faults), {name} (observations with faults), {name}_log."""
    seed, slot = f"'{config.seed}'", config.slot
    u = lambda what: _u(seed, "station_id", "variable", "CAST(slot AS VARCHAR)", f"'{what}'")
    band = " ".join(f"WHEN anomaly_type = '{k}' AND severity = '{s}' THEN {lo} + ({hi} - {lo}) * {u('strength')}" for k, levels in STRENGTHS.items() for s, (lo, hi) in levels.items())
    value = "CASE " + " ".join(f"WHEN e.variable = '{v}' THEN n.{v}" for v in V) + " END"
    fallback = "CASE " + " ".join(f"WHEN variable = '{v}' THEN {FALLBACK_SCALES[v]}" for v in V) + " END::DOUBLE"
    robust = lambda p: f"greatest(coalesce(CASE WHEN {MAD_FACTOR} * {p}_mad > 1e-12 THEN {MAD_FACTOR} * {p}_mad END, CASE WHEN {p}_sd > 1e-12 THEN {p}_sd END, {fallback}), greatest({fallback} * 0.1, 1e-6))"
    wobble = f"(2 * {_u(seed, 'event_id', 'CAST(k AS VARCHAR)', chr(39) + 'noise' + chr(39))} - 1)"
    packed = join(f"string_agg({c}, '|' ORDER BY variable) AS {a}" for c, a in (("event_id", "anomaly_id"), ("anomaly_type", "anomaly_type"), ("variable", "anomaly_variable"), ("severity", "anomaly_severity")))
    news = join(f"max(new) FILTER (variable = '{v}') AS {v}_new, coalesce(bool_or(variable = '{v}'), false) AS {v}_hit" for v in V)
    return [
        (f"{name}_pos", f"SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY timestamp) - 1 AS pos FROM {obs}"),
        (f"{name}_slots", f"""SELECT station_id, variable, slot FROM (SELECT station_id, count(*) AS n, unnest(range(1, CAST(greatest(1, floor(count(*) / {slot}) - 1) AS BIGINT) + 1)) AS slot FROM {name}_pos GROUP BY 1)
            CROSS JOIN (VALUES {join(f"('{v}')" for v in V)}) t(variable) WHERE (slot + 1) * {slot} <= n"""),
        (f"{name}_kinds", f"SELECT *, {_choice(u('type'), TYPE_SHARES)} AS anomaly_type, {_choice(u('severity'), SEVERITY_SHARES)} AS severity FROM {name}_slots WHERE {u('place')} < {config.chance!r}"),
        (f"{name}_long", f"SELECT *, CASE WHEN anomaly_type = 'spike' THEN 1 ELSE 2 + CAST(floor({u('length')} * {config.longest - 1}) AS INTEGER) END AS duration FROM {name}_kinds"),
        (f"{name}_events", f"""SELECT concat_ws('-', 'event', station_id, variable, lpad(CAST(slot AS VARCHAR), 6, '0')) AS event_id, station_id, variable, anomaly_type, severity,
            CAST(slot * {slot} + floor({u('start')} * ({slot} - duration + 1)) AS BIGINT) AS first_pos, CAST(slot * {slot} + floor({u('start')} * ({slot} - duration + 1)) + duration - 1 AS BIGINT) AS last_pos,
            round(CASE {band} ELSE 0.0 END, 6) AS strength, CASE WHEN {u('sign')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM {name}_long"""),
        (f"{name}_before", f"""SELECT e.event_id, n.pos, {value} AS x FROM (SELECT *, unnest(range(greatest(0, first_pos - {config.context}), first_pos)) AS p FROM {name}_events) e
            JOIN {name}_pos n ON e.station_id = n.station_id AND e.p = n.pos"""),
        (f"{name}_d", f"SELECT *, x - lag(x) OVER (PARTITION BY event_id ORDER BY pos) AS d FROM {name}_before WHERE isfinite(x)"),
        (f"{name}_m", f"SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY event_id) AS mx, quantile_cont(d, 0.5) OVER (PARTITION BY event_id) AS md FROM {name}_d"),
        (f"{name}_q", f"""SELECT event_id, count(x) AS nx, count(d) AS nd, quantile_cont(abs(x - mx), 0.5) AS x_mad, stddev_pop(x) AS x_sd, quantile_cont(abs(d - md), 0.5) AS d_mad, stddev_pop(d) AS d_sd,
            quantile_cont(abs(d), 0.95) AS q95 FROM {name}_m GROUP BY 1"""),
        (f"{name}_scaled", f"""SELECT e.*, round(CASE WHEN coalesce(nx, 0) > 0 THEN {robust('x')} ELSE {fallback} END, 6) AS local_scale,
            round(CASE WHEN coalesce(nd, 0) > 0 THEN greatest(CASE WHEN q95 > 1e-12 THEN q95 ELSE {fallback} END, greatest({fallback} * 0.1, 1e-6)) ELSE {fallback} END, 6) AS local_delta_scale,
            round(CASE WHEN coalesce(nd, 0) >= 2 THEN {robust('d')} ELSE {fallback} END, 6) AS local_noise_scale FROM {name}_events e LEFT JOIN {name}_q q ON e.event_id = q.event_id"""),
        (f"{name}_r", f"SELECT e.*, n.pos, n.timestamp, {value} AS x, n.pos - e.first_pos AS k FROM (SELECT *, unnest(range(first_pos, last_pos + 1)) AS p FROM {name}_scaled) e JOIN {name}_pos n ON e.station_id = n.station_id AND e.p = n.pos"),
        (f"{name}_t", f"SELECT *, max(x) OVER (PARTITION BY event_id) - min(x) OVER (PARTITION BY event_id) AS spread, first(x ORDER BY pos) OVER (PARTITION BY event_id) AS x0 FROM {name}_r"),
        (f"{name}_rows", f"""SELECT *, round(CASE anomaly_type WHEN 'spike' THEN x + sign * strength * local_delta_scale WHEN 'offset' THEN x + sign * strength * local_scale
            WHEN 'drift' THEN x + sign * strength * local_delta_scale * k WHEN 'rate_change' THEN x + sign * strength * local_delta_scale * k WHEN 'stuck' THEN x0
            WHEN 'noise' THEN x + strength * local_noise_scale * sqrt(3.0) * {wobble} END, 6) AS new FROM {name}_t WHERE anomaly_type <> 'stuck' OR spread >= greatest(0.5 * local_scale, 1e-6)"""),
        (f"{name}_hit", f"SELECT station_id, pos, {packed}, {news} FROM {name}_rows GROUP BY 1, 2"),
        (name, f"""SELECT n.station_id, n.timestamp, {join(f'CASE WHEN h.{v}_hit THEN h.{v}_new ELSE n.{v} END AS {v}, n.{v} AS {v}_original' for v in V)}, h.pos IS NOT NULL AS is_anomaly,
            h.anomaly_id, h.anomaly_type, h.anomaly_variable, h.anomaly_severity FROM {name}_pos n LEFT JOIN {name}_hit h ON n.station_id = h.station_id AND n.pos = h.pos"""),
        (f"{name}_log", f"""SELECT event_id, anomaly_type, severity, station_id, variable, min(timestamp) AS start_time, max(timestamp) AS end_time, CAST(count(*) AS INTEGER) AS duration_rows, any_value(strength) AS normalized_strength,
            any_value(local_scale) AS local_scale, any_value(local_delta_scale) AS local_delta_scale, round(coalesce(max(abs(new - x)), 0.0), 6) AS total_displacement FROM {name}_rows GROUP BY 1, 2, 3, 4, 5"""),
    ]


# ------------------------------------------------------------------ evaluation


def confusion(p: str, t: str = "is_anomaly") -> str:
    return f"count(*) FILTER ({p} AND {t}) AS tp, count(*) FILTER ({p} AND NOT {t}) AS fp, count(*) FILTER (NOT {p} AND {t}) AS fn, count(*) FILTER (NOT {p} AND NOT {t}) AS tn"


def ratio(a: str, c: str) -> str:
    return f"coalesce(({a}) / nullif(CAST({c} AS DOUBLE), 0), 0.0)"


def metric_columns() -> str:
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return f"tp, fp, fn, tn, round({p}, 6) AS precision, round({r}, 6) AS recall, round({ratio(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1, round({ratio('fp', 'fp + tn')}, 6) AS fpr, tp + fp AS alerts, round({ratio('tp + fp', 'tp + fp + fn + tn')}, 6) AS alert_rate"


def distance(rows: str, name: str) -> Part:
    w = "OVER (PARTITION BY station_id ORDER BY timestamp"
    return [
        (f"{name}_p", f"SELECT *, row_number() {w}) AS rn FROM {rows}"),
        (f"{name}_a", f"SELECT *, CASE WHEN is_anomaly THEN rn END AS here FROM {name}_p"),
        (name, f"SELECT *, least(rn - last_value(here IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(here IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - rn) AS anomaly_distance FROM {name}_a"),
    ]


CLEAR = f"NOT is_anomaly AND coalesce(anomaly_distance, {1 << 30}) > {BUFFER}"


# ------------------------------------------------------------------- diagnosis


def reference(rows: str, name: str) -> Part:
    """From residual rows of the history."""
    step = "epoch(timestamp) - lag(epoch(timestamp)) OVER (PARTITION BY station_id ORDER BY timestamp)"
    parts = [(f"{name}_s", f"SELECT station_id, timestamp, {step} AS step, {join(f'CASE WHEN {v}_spatial_neighbor_count >= 2 THEN {v} - {v}_spatial_expected END AS {v}' for v in V)} FROM {rows}")]
    long = " UNION ALL ".join(f"SELECT station_id, '{v}' AS variable, {v} AS r, CASE WHEN step = 3600 THEN {v} - lag({v}) OVER (PARTITION BY station_id ORDER BY timestamp) END AS d FROM {name}_s" for v in V)
    return [*parts, (f"{name}_l", long), (name, f"""SELECT station_id, variable, round(avg(r), 6) AS residual_center, round(stddev_samp(r), 6) AS residual_scale, round(avg(d), 6) AS rate_center,
        round(stddev_samp(d), 6) AS rate_scale, 3.0::DOUBLE AS rate_threshold FROM {name}_l GROUP BY 1, 2 HAVING count(r) >= 30 AND count(d) >= 30 AND round(stddev_samp(r), 6) > 0 AND round(stddev_samp(d), 6) > 0""")]


def diagnosis(rows: str, ref: str, name: str) -> Part:
    """From rows with readings, spatial expectations and final_alert."""
    w = "OVER (PARTITION BY station_id ORDER BY timestamp"
    last = lambda n: f"{w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    lag = lambda c, k=1: f"lag({c}, {k}) {w})"
    joins = " ".join(f"LEFT JOIN {ref} p_{v} ON r.station_id = p_{v}.station_id AND p_{v}.variable = '{v}'" for v in V)
    first = join(f"""p_{v}.residual_center AS {v}_rc, p_{v}.residual_scale AS {v}_rs, p_{v}.rate_center AS {v}_tc, p_{v}.rate_scale AS {v}_ts, p_{v}.rate_threshold AS {v}_tt,
        CASE WHEN p_{v}.station_id IS NOT NULL AND isfinite(r.{v}) THEN r.{v} END AS {v}_x, CASE WHEN p_{v}.station_id IS NOT NULL THEN r.{v}_spatial_neighbor_count END AS {v}_n,
        CASE WHEN p_{v}.station_id IS NOT NULL AND r.{v}_spatial_neighbor_count >= 2 THEN r.{v}_spatial_expected END AS {v}_peer""" for v in V)
    second = join(f"round(({v}_x - {v}_peer - {v}_rc) / {v}_rs, 6) AS {v}_z" for v in V)
    step = lambda c: f"CASE WHEN contiguous THEN round({c} - {lag(c)}, 6) END"
    third = join(f"""{step(f'{v}_x')} AS {v}_dx, {step(f'{v}_peer')} AS {v}_dp, {step(f'{v}_z')} AS {v}_dz, CASE WHEN contiguous THEN round((({v}_x - {v}_peer) - {lag(f'({v}_x - {v}_peer)')} - {v}_tc) / {v}_ts, 6) END AS {v}_rate,
        {lag(f'{v}_z')} AS {v}_z1, {lag(f'{v}_z', 2)} AS {v}_z2, lead({v}_z) {w}) AS {v}_zn""" for v in V)
    fourth = join(f"coalesce({v}_dz * {lag(f'{v}_dz')} < 0, false) AS {v}_turn" for v in V)
    share = lambda c, n: f"CASE WHEN count(*) {last(n)} = {n} THEN avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) {last(n)} END"
    whole = lambda c, n, e: f"CASE WHEN count({c}) {last(n)} = {n} THEN {e} END"
    fifth = join(f"""{whole(f'{v}_peer', 6, f'round(max({v}_peer) {last(6)} - min({v}_peer) {last(6)}, 6)')} AS {v}_pspan, {whole(f'{v}_x', 6, f'round(max({v}_x) {last(6)} - min({v}_x) {last(6)}, 6)')} AS {v}_span,
        {whole(f'{v}_z', 6, f'list({v}_z) {last(6)}')} AS {v}_zs, {whole(f'{v}_dz', 5, f'list({v}_dz) {last(5)}')} AS {v}_dzs, {whole(f'{v}_rate', 5, f'list({v}_rate) {last(5)}')} AS {v}_rates,
        greatest({share(f'{v}_z > 0', 6)}, {share(f'{v}_z < 0', 6)}) AS {v}_same, greatest({share(f'{v}_dz > 0', 5)}, {share(f'{v}_dz < 0', 5)}) AS {v}_mono, {share(f'{v}_turn', 4)} AS {v}_rev,
        coalesce(abs({v}_z) >= 3 AND abs({v}_z1) < 2 AND abs({v}_z2) < 2 AND abs({v}_zn) < 2 AND contiguous AND c_last AND c_next, false) AS {v}_spike,
        coalesce(count({v}_z) {last(6)} = 6 AND c5 = 5, false) AS {v}_ready""" for v in V)
    med = lambda c: f"list_aggregate({c}, 'median')"
    spread = lambda c: f"list_aggregate(list_transform({c}, lambda x: abs(x - {med(c)})), 'median')"
    sixth = join(f"round({med(f'{v}_zs')}, 6) AS {v}_med, round({spread(f'{v}_zs')}, 6) AS {v}_mad, round({med(f'{v}_dzs')}, 6) AS {v}_slope, round({spread(f'{v}_rates')}, 6) AS {v}_noise, coalesce(abs({v}_z) < 2 AND isfinite({v}), false) AS {v}_calm" for v in V)
    kind = lambda v: f"""CASE WHEN {v} IS NULL OR NOT isfinite({v}) THEN 'DATA_DROPOUT' WHEN {v}_ready AND {v}_span <= 0.05 AND {v}_pspan >= 0.2 AND {v}_pspan >= 4 * {v}_span THEN 'STUCK_SENSOR'
        WHEN {v}_ready AND {v}_noise >= 3 AND {v}_rev >= 0.6 THEN 'NOISY_SENSOR' WHEN {v}_spike THEN 'SPIKE' WHEN {v}_ready AND abs({v}_med) >= 3 AND {v}_same >= 0.8 AND abs({v}_slope) > 0.25 AND {v}_mono >= 0.8 THEN 'SENSOR_DRIFT'
        WHEN {v}_ready AND abs({v}_med) >= 3 AND {v}_same >= 0.8 AND abs({v}_slope) <= 0.25 AND {v}_mad <= 1 THEN 'SENSOR_OFFSET' WHEN abs({v}_rate) >= {v}_tt THEN 'RATE_CHANGE' END"""  # noqa: E731
    seventh = join(f"{kind(v)} AS {v}_kind, CAST(sum(CAST({v}_calm AS INTEGER)) OVER (PARTITION BY timestamp) AS INTEGER) - CAST({v}_calm AS INTEGER) AS {v}_normal, list({v}_dx) OVER (PARTITION BY timestamp) AS {v}_steps" for v in V)
    order = "['" + "', '".join(PRECEDENCE) + "']"
    alike = lambda v: f"(len(list_filter({v}_steps, lambda d: d * {v}_dx > 0 AND abs(d) >= 0.75 * abs({v}_dx) AND abs(d) <= 1.25 * abs({v}_dx))) - 1)"
    moves = join((f"coalesce(abs({v}_dx) > 0.05 AND abs({v}_z) < 2 AND {v}_n >= 2 AND abs({v}_dx) / {v}_ts >= 3 AND {alike(v)} >= 2 AND abs({v}_dp - {v}_dx) <= 0.25 * abs({v}_dx), false)" for v in V), " OR ")
    candidates = " UNION ALL ".join(
        f"SELECT station_id, timestamp, list_position({order}, {v}_kind) AS ord, -coalesce(abs({v}_z), 0.0) AS weaker, {i} AS place, {v}_kind AS kind, '{v}' AS variable, {v}_z AS z, coalesce({v}_n, 0) AS n, {v}_normal AS normal FROM {name}_7 WHERE {v}_kind IS NOT NULL AND final_alert"
        for i, v in enumerate(V))
    fault = "coalesce(abs(c.z) >= 3 AND c.n >= 2 AND c.normal >= 2, false)"
    kind_ = "coalesce(c.kind, 'UNCLASSIFIED_ANOMALY')"
    confidence = "CASE " + " ".join(f"WHEN {kind_} = '{k}' THEN {x}" for k, x in CONFIDENCE.items()) + " END::DOUBLE"
    return [
        (f"{name}_1", f"SELECT r.*, {first}, coalesce(epoch(r.timestamp) - lag(epoch(r.timestamp)) OVER (PARTITION BY r.station_id ORDER BY r.timestamp) = 3600, false) AS contiguous FROM {rows} r {joins}"),
        (f"{name}_2", f"SELECT *, {second} FROM {name}_1"),
        (f"{name}_3", f"SELECT *, {third}, coalesce({lag('contiguous')}, false) AS c_last, coalesce(lead(contiguous) {w}), false) AS c_next, sum(CAST(contiguous AS INTEGER)) {last(5)} AS c5 FROM {name}_2"),
        (f"{name}_4", f"SELECT *, {fourth} FROM {name}_3"), (f"{name}_5", f"SELECT *, {fifth} FROM {name}_4"), (f"{name}_6", f"SELECT *, {sixth} FROM {name}_5"),
        (f"{name}_7", f"SELECT *, {seventh} FROM {name}_6"), (f"{name}_8", f"SELECT *, ({moves}) AS moves FROM {name}_7"),
        (f"{name}_c", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, timestamp ORDER BY ord, weaker, place) AS rn FROM ({candidates})) WHERE rn = 1"),
        (name, f"""SELECT r.*, CASE WHEN r.final_alert THEN {kind_} END AS diagnosis, CASE WHEN r.final_alert THEN c.variable END AS diagnosis_variable, CASE WHEN r.final_alert THEN {confidence} END AS diagnosis_confidence,
            CASE WHEN r.final_alert AND {fault} THEN 'SENSOR_FAULT' WHEN r.final_alert AND {kind_} <> 'DATA_DROPOUT' AND r.moves THEN 'POSSIBLE_ENVIRONMENTAL_EVENT' ELSE 'UNCERTAIN' END AS operational_class
            FROM {name}_8 r LEFT JOIN {name}_c c ON r.station_id = c.station_id AND r.timestamp = c.timestamp"""),
    ]


def expected_diagnosis() -> str:
    return "CASE anomaly_type " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in DIAGNOSIS_OF.items()) + " END"
