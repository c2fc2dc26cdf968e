"""DuckDB SQL for every registered query, over the given tables.

Written apart from the Spark side: statuses are a UNION ALL of row sets, grains are grouping sets over
rows, and positions are plain windows.
"""

from __future__ import annotations

from scanlytics.registry.queries import CAPACITY, EVENT_CAPACITY, GROUP, PATTERNS, YEARS

_EVENTS = """
raw AS (
  SELECT 'instance_' || CAST(user_id % 3 AS VARCHAR) || '.csv' AS source_file,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts,
         event_id AS codeLocationId,
         'loc_' || CAST(event_id AS VARCHAR) AS codeLocationName,
         'v' || CAST(event_id % 4 AS VARCHAR) AS versionName,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'project_' || CAST(user_id AS VARCHAR) END AS projectName,
         CAST(1 + event_id % 5 AS BIGINT) AS scanCount,
         CASE event_type WHEN 'click' THEN 'SIGNATURE' WHEN 'view' THEN 'SNIPPET'
              WHEN 'purchase' THEN 'BINARY_ANALYSIS' WHEN 'signup' THEN 'package_manager'
              ELSE 'Snippet_Scan' END AS scanType,
         CAST(round(value * 100) AS BIGINT) AS totalScanSize,
         CAST(round(value * 100) AS BIGINT) % 10000 AS maxScanSize,
         CASE WHEN event_id % 97 = 0 THEN NULL
              ELSE CASE (event_id * 7 + user_id) % 10 WHEN 6 THEN 'success' WHEN 7 THEN 'FAILED'
                   WHEN 8 THEN 'Cancelled' WHEN 9 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END
         END AS state,
         event_type AS transitionReason
  FROM events)"""

_ORDERS = """
raw AS (
  SELECT lower(r_name) || '.csv' AS source_file,
         CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS hour_ts,
         l_orderkey AS codeLocationId,
         'order_' || CAST(l_orderkey AS VARCHAR) AS codeLocationName,
         'v' || CAST(l_linenumber AS VARCHAR) AS versionName,
         c_name AS projectName,
         CAST(l_quantity AS BIGINT) AS scanCount,
         CASE l_returnflag WHEN 'A' THEN 'SIGNATURE' WHEN 'N' THEN 'SNIPPET' ELSE 'binary_analysis' END AS scanType,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS totalScanSize,
         CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS maxScanSize,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'ERROR' ELSE 'IN_PROGRESS' END AS state,
         o_orderpriority AS transitionReason
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_COMMON = """,
act AS (
  SELECT *, CAST(year(hour_ts) AS VARCHAR) AS year, strftime(hour_ts, '%Y-%m-%d') AS scan_date,
         hour(hour_ts) // 3 * 3 AS block,
         coalesce(upper(state) IN ('COMPLETED', 'SUCCESS', 'COMPLETE'), false) AS won,
         coalesce(upper(state) IN ('ERROR', 'FAILED', 'FAILURE', 'CANCELLED'), false) AS lost
  FROM raw),
st AS (
  SELECT *, 'all' AS status FROM act
  UNION ALL SELECT *, 'success' FROM act WHERE won
  UNION ALL SELECT *, 'failed' FROM act WHERE lost)"""

_TREE = """
tree AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS pid, r_name AS name,
         false AS isProject FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name, false FROM nation
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), c_name, true FROM customer),
walk AS (
  SELECT id, name, isProject FROM tree WHERE name = '{group}'
  UNION ALL SELECT t.id, t.name, t.isProject FROM tree t JOIN walk w ON t.pid = w.id),
closure AS (SELECT DISTINCT name AS projectName FROM walk WHERE isProject)""".format(group=GROUP)


def _events(body: str, *ctes: str) -> str:
    return "WITH" + _EVENTS + _COMMON + "".join(",\n" + c for c in ctes) + "\n" + body


def _orders(body: str, *ctes: str) -> str:
    return "WITH" + _ORDERS + _COMMON + "".join(",\n" + c for c in ctes) + "\n" + body


def _pct(part: str, whole: str) -> str:
    whole = f"nullif({whole}, 0)"
    return f"CAST((2000 * ({part}) + {whole}) // (2 * {whole}) AS DOUBLE) / 10"


def _sum(expr: str, name: str, where: str = "") -> str:
    keep = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(CAST(sum({expr}){keep} AS BIGINT), 0) AS {name}"


_COUNTS = ", ".join(
    [
        "count(*) AS total_rows",
        "count(DISTINCT projectName) AS unique_projects",
        _sum("scanCount", "total_scans"),
        _sum("scanCount", "successful_scans", "won"),
        _sum("scanCount", "failed_scans", "lost"),
    ]
)
_RATE = _pct("successful_scans", "total_scans") + " AS success_rate"

_GRAINS = {
    "global": [],
    "year": ["year"],
    "project": ["projectName"],
    "year_project": ["year", "projectName"],
    "file": ["source_file"],
    "file_year": ["source_file", "year"],
    "file_project": ["source_file", "projectName"],
    "file_year_project": ["source_file", "year", "projectName"],
}


def _by_grain(source: str, aggregates: str, grains=None, also: str = "", where: str = "true") -> str:
    """One SELECT per grain, glued together."""
    parts = []
    for grain in grains or _GRAINS:
        keys = _GRAINS[grain]
        shown = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in ("source_file", "year", "projectName"))
        group = ", ".join([*keys, *([also] if also else [])])
        filters = " AND ".join([where, *[f"{k} IS NOT NULL" for k in keys]])
        extra = f", {also}" if also else ""
        tail = f" GROUP BY {group}" if group else ""
        parts.append(f"SELECT '{grain}' AS grain, {shown}{extra}, {aggregates} FROM {source} WHERE {filters}{tail}")
    return "\nUNION ALL ".join(parts)


def _totals(source: str, grains=None) -> str:
    one = "CASE WHEN source_file IS NOT NULL THEN CAST(1 AS BIGINT) END AS total_files"
    return f"SELECT *, {_RATE}, {one} FROM ({_by_grain(source, _COUNTS, grains)})"


def _scan_types(grains=None) -> str:
    return _by_grain("st", _sum("scanCount", "scans"), grains, "scanType, status", "scanType IS NOT NULL")


_LABEL = "printf('%02d-%02d', block, (block + 3) % 24)"
_BLOCK_GRAINS = ["global", "year", "file", "file_year", "file_project", "file_year_project"]


def _profiles(measure: str, grains) -> str:
    """CTE ``prof``: count per grain key, status and block, zeros included."""
    aggregate = f"CAST({measure} AS BIGINT) AS n"
    dated = "hour_ts IS NOT NULL"
    return (
        f"hit AS ({_by_grain('st', aggregate, grains, 'status, block', dated)}),\n"
        "groups AS (SELECT grain, source_file, year, projectName, status, CAST(sum(n) AS BIGINT) AS total FROM hit GROUP BY ALL),\n"
        "prof AS (SELECT g.*, b.block, coalesce(h.n, 0) AS n\n"
        "  FROM groups g CROSS JOIN (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 21]) AS block) b\n"
        "  LEFT JOIN hit h ON h.grain = g.grain AND h.status = g.status AND h.block = b.block\n"
        "    AND h.source_file IS NOT DISTINCT FROM g.source_file AND h.year IS NOT DISTINCT FROM g.year\n"
        "    AND h.projectName IS NOT DISTINCT FROM g.projectName)"
    )


_BLOCKS = (
    "SELECT grain, source_file, year, projectName, status, CAST((block + 18) % 24 // 3 AS BIGINT) AS block_order, "
    f"{_LABEL} AS time_block, CAST(block AS BIGINT) AS block_start, CAST((block + 3) % 24 AS BIGINT) AS block_end, "
    f'n AS "count", {_pct("n", "total")} AS percentage FROM prof'
)


def _extreme(name: str, column: str) -> str:
    return (
        f"CAST({column}.block AS BIGINT) AS {name}_hour, CAST(({column}.block + 3) % 24 AS BIGINT) AS {name}_hour_end, "
        f"{column}.n AS {name}_count, {_pct(column + '.n', column + '.total')} AS {name}_percentage"
    )


_PEAKS = (
    "SELECT hi.grain, hi.source_file, hi.year, hi.projectName, hi.status, "
    + _extreme("busiest", "hi") + ", " + _extreme("quietest", "lo")
    + " FROM (SELECT *, row_number() OVER (PARTITION BY grain, source_file, year, projectName, status"
    " ORDER BY n DESC, block) AS r FROM prof WHERE n > 0) hi"
    " JOIN (SELECT *, row_number() OVER (PARTITION BY grain, source_file, year, projectName, status"
    " ORDER BY n, block) AS r FROM prof WHERE n > 0) lo"
    " ON hi.r = 1 AND lo.r = 1 AND hi.grain = lo.grain AND hi.status = lo.status"
    " AND hi.source_file IS NOT DISTINCT FROM lo.source_file AND hi.year IS NOT DISTINCT FROM lo.year"
    " AND hi.projectName IS NOT DISTINCT FROM lo.projectName"
)


def _top(*by: str, k: int = 15) -> str:
    shown = [f"{_LABEL} AS time_block" if b == "time_block" else b for b in by]
    real = ["block" if b == "time_block" else b for b in by]
    keys = ", ".join([*real, "status", "projectName"])
    part = ", ".join([*real, "status"])
    filters = " AND ".join(f"{c} IS NOT NULL" for c in [*real, "projectName"])
    return (
        f"SELECT {', '.join([*shown, 'status'])}, r AS rank, projectName, scans FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY scans DESC, projectName) AS r FROM ("
        f"SELECT {keys}, {_sum('scanCount', 'scans')} FROM st WHERE {filters} GROUP BY {keys})) WHERE r <= {k}"
    )


_CHOSEN = (
    "chosen AS (SELECT projectName, CAST(sum(scanCount) AS BIGINT) AS scans FROM act WHERE projectName IS NOT NULL "
    "GROUP BY projectName HAVING sum(scanCount) >= 10 ORDER BY scans DESC, projectName LIMIT 1000)"
)


def _series(*by: str, measure: str = "CAST(sum(scanCount) AS BIGINT)", size=True, all_only=False, chosen=False) -> str:
    keys = ", ".join([*by, "status", "hour_ts"])
    part = ", ".join([*by, "status"])
    filters = " AND ".join(f"{c} IS NOT NULL" for c in [*by, "hour_ts"])
    if all_only:
        filters += " AND status = 'all'"
    if chosen:
        filters += " AND projectName IN (SELECT projectName FROM chosen)"
    sized = ", CAST(sum(totalScanSize) AS BIGINT) AS size" if size else ""
    return f'SELECT {part}, {_ISO_HOUR}, {measure} AS "count"{sized} FROM st WHERE {filters} GROUP BY {keys}'


def _sampled(full: str, part: str, points: int) -> str:
    return (
        "SELECT * EXCLUDE (pos, n) FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY {part} ORDER BY hour_ts) - 1 AS pos, count(*) OVER (PARTITION BY {part}) AS n FROM ({full})) "
        f"WHERE pos % greatest(1, n // {points}) = 0"
    )


_ISO_HOUR = "strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts"
_HOURLY = (
    "sph AS (SELECT hour_ts, CAST(sum(scanCount) AS BIGINT) AS sph,"
    " CAST(sum(scanCount) FILTER (WHERE contains(upper(scanType), 'SNIPPET')) AS BIGINT) AS snip"
    " FROM act WHERE hour_ts IS NOT NULL GROUP BY hour_ts)"
)
_WARN = CAPACITY * 80 // 100
_ISO = "strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts"
_STATUS = f"CASE WHEN sph >= {CAPACITY} THEN 'BREACH' ELSE 'WARNING' END AS status"
_SNIPPET = (
    f"{_pct('snip', 'sph')} AS snippet_pct, CASE WHEN snip IS NULL THEN 'none'"
    f" WHEN {_pct('snip', 'sph')} >= 50 THEN 'red' WHEN {_pct('snip', 'sph')} >= 25 THEN 'amber' ELSE 'green' END AS snippet_severity"
)
# an empty log has peak 0
_PEAK = "coalesce(CAST(max(sph) AS BIGINT), 0)"
_SPH = (
    f"{_PEAK} AS peak_sph, count(*) FILTER (WHERE sph >= {CAPACITY}) AS breach_count,"
    f" count(*) FILTER (WHERE sph >= {_WARN} AND sph < {CAPACITY}) AS warning_count,"
    f" CAST({CAPACITY} AS BIGINT) AS capacity_sph, CAST(80 AS BIGINT) AS warning_pct,"
    f" CAST({_WARN} AS BIGINT) AS warning_threshold, {_pct(_PEAK, str(CAPACITY))} AS peak_pct"
)
_WHO = (
    "part AS (SELECT hour_ts, coalesce(projectName, versionName, '(Unknown project)') AS project,"
    " CAST(sum(scanCount) AS BIGINT) AS scans FROM act WHERE hour_ts IS NOT NULL GROUP BY ALL)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY hour_ts ORDER BY scans DESC, project) AS r,"
    " count(*) OVER (PARTITION BY hour_ts) AS n, CAST(sum(scans) OVER (PARTITION BY hour_ts) AS BIGINT) AS sph FROM part)",
    "head AS (SELECT hour_ts, CAST(sum(scans) AS BIGINT) AS top3 FROM ranked WHERE r <= 3 GROUP BY hour_ts)",
)

_DAILY = (
    "daily AS (SELECT projectName, scanType, scan_date, CAST(sum(scanCount) AS BIGINT) AS scans FROM act"
    " WHERE projectName IS NOT NULL AND scanType IS NOT NULL AND scan_date IS NOT NULL GROUP BY ALL)"
)
_TYPES = (
    "types AS (SELECT projectName, scanType, CAST(sum(scanCount) AS BIGINT) AS scans FROM act"
    " WHERE projectName IS NOT NULL AND scanType IS NOT NULL GROUP BY ALL)"
)

_LISTS = "\nUNION ".join(
    f"SELECT '{name}' AS list, {owner} AS owner, {value} AS value FROM act WHERE {value} IS NOT NULL"
    for name, owner, value in [
        ("years", "''", "year"),
        ("dates", "''", "scan_date"),
        ("projects", "''", "projectName"),
        ("files", "''", "source_file"),
        ("file_years", "source_file", "year"),
        ("file_projects", "source_file", "projectName"),
    ]
)

_NUMERIC = ["codeLocationId", "scanCount", "totalScanSize", "maxScanSize"]
_TEXTS = ["hour", "codeLocationName", "versionName", "projectName", "scanType", "state", "transitionReason"]
_STATS = {
    "count": "CAST(count(v) AS DOUBLE)",
    "mean": "avg(v)",
    "std": "round(stddev_samp(v), 4)",
    "min": "min(v)",
    "25%": "quantile_cont(v, 0.25)",
    "50%": "quantile_cont(v, 0.5)",
    "75%": "quantile_cont(v, 0.75)",
    "max": "max(v)",
}


def _numeric() -> str:
    long = " UNION ALL ".join(f"SELECT source_file, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM act" for c in _NUMERIC)
    return " UNION ALL ".join(
        f"SELECT source_file, col AS \"column\", '{stat}' AS stat, {expr} AS value FROM ({long}) GROUP BY source_file, col"
        for stat, expr in _STATS.items()
    )


def _top_values() -> str:
    def text(c):
        return "strftime(hour_ts, '%Y-%m-%d %H:%M:%S')" if c == "hour" else c

    long = " UNION ALL ".join(f"SELECT source_file, '{c}' AS col, {text(c)} AS v FROM act" for c in _TEXTS)
    return (
        'SELECT source_file, col AS "column", r AS rank, v AS value, n AS "rows" FROM ('
        "SELECT *, row_number() OVER (PARTITION BY source_file, col ORDER BY n DESC, v) AS r FROM ("
        f"SELECT source_file, col, v, count(*) AS n FROM ({long}) WHERE v IS NOT NULL GROUP BY ALL)) WHERE r <= 10"
    )


_POSITION = "row_number() OVER (PARTITION BY source_file ORDER BY codeLocationId) - 1 AS row_no"
_WHOLE = ["codeLocationId", "scanCount", "totalScanSize", "maxScanSize"]
_ALL_COLUMNS = [
    "hour", "codeLocationId", "codeLocationName", "versionName", "projectName", "scanCount", "scanType",
    "totalScanSize", "maxScanSize", "state", "transitionReason",
]


def _trends() -> str:
    return " UNION ALL ".join(
        f"SELECT source_file, row_no, '{c}' AS \"column\", {c} AS value FROM placed"
        for c in ("scanCount", "totalScanSize", "maxScanSize")
    )


def _documents() -> str:
    grains = ["global", "file", "project"]
    keys = "grain, source_file, year, projectName"
    fields = ["total_rows", "total_scans", "successful_scans", "failed_scans", "unique_projects"]
    body = " || ',' || ".join(f"'\"{f}\":' || CAST({f} AS VARCHAR)" for f in fields)
    return (
        f"SELECT 'totals' AS section, {keys}, '{{' || {body} || '}}' AS body FROM ({_totals('act', grains)}) "
        f"UNION ALL SELECT 'scan_types', {keys}, '{{' || string_agg('\"' || status || '\":{{' || inner_map || '}}', ',' ORDER BY status) || '}}' "
        f"FROM (SELECT {keys}, status, string_agg('\"' || scanType || '\":' || CAST(scans AS VARCHAR), ',' ORDER BY scanType) AS inner_map "
        f"FROM ({_scan_types(grains)}) GROUP BY {keys}, status) GROUP BY {keys}"
    )


def _object(*fields: str, text: str = "") -> str:
    """JSON text of the columns, ``text`` ones quoted; one that is null is left out by the caller's choice of rows."""
    shown = [f"'\"{f}\":' || " + (f"CAST(to_json({f}) AS VARCHAR)" if f in text.split() else f"CAST(\"{f}\" AS VARCHAR)") for f in fields]
    return "'{' || " + " || ',' || ".join(shown) + " || '}'"


def _section(name: str, path: str, body: str, source: str) -> str:
    return f"SELECT '{name}' AS section, {path} AS path, {body} AS body FROM ({source})"


def _sections() -> dict[str, str]:
    tops = {
        "top_projects_by_block": ("time_block", _top("time_block", k=10)),
        "top_projects_by_date": ("scan_date", _top("scan_date")),
        "top_projects_by_type": ("scanType", _top("scanType")),
        "top_projects_by_type_date": ("scanType || '/' || scan_date", _top("scanType", "scan_date")),
        "top_projects_by_year_block": ("year || '/' || time_block", _top("year", "time_block", k=10)),
    }
    ranked = "lpad(CAST(rank AS VARCHAR), 12, '0')"
    out = {
        name: _section(name, f"{by} || '/' || status || '/' || {ranked}", _object("projectName", "scans", text="projectName"), source)
        for name, (by, source) in tops.items()
    }
    summary = ("total_files", "total_rows", "total_scans", "successful_scans", "failed_scans", "unique_projects")
    out["summary"] = _section("summary", "''", _object(*summary), f"SELECT count(DISTINCT source_file) AS total_files, {_COUNTS} FROM act")
    out["scan_type_rows"] = _section("scan_type_rows", "scanType", 'CAST("rows" AS VARCHAR)', 'SELECT scanType, count(*) AS "rows" FROM act WHERE scanType IS NOT NULL GROUP BY scanType')
    out["states"] = _section("states", "state", 'CAST("rows" AS VARCHAR)', 'SELECT state, count(*) AS "rows" FROM act WHERE state IS NOT NULL GROUP BY state')
    out["project_summary"] = _section(
        "project_summary", "projectName", _object("scanCount", "totalScanSize", "codeLocationName"),
        "SELECT projectName, CAST(sum(scanCount) AS BIGINT) AS scanCount, CAST(sum(totalScanSize) AS BIGINT) AS totalScanSize,"
        " count(codeLocationName) AS codeLocationName FROM act WHERE projectName IS NOT NULL GROUP BY projectName",
    )
    values = {"years": "year", "dates": "scan_date", "projects": "projectName", "files": "source_file"}
    listed = " UNION ".join(f"SELECT '{name}' AS list, {c} AS value FROM act WHERE {c} IS NOT NULL" for name, c in values.items())
    out["lists"] = _section("lists", "list || '/' || value", "CAST(to_json(value) AS VARCHAR)", listed)
    of_files = {"file_years": "year", "file_projects": "projectName"}
    listed = " UNION ".join(f"SELECT '{name}' AS list, source_file AS owner, {c} AS value FROM act WHERE {c} IS NOT NULL" for name, c in of_files.items())
    out["file_lists"] = _section("file_lists", "list || '/' || owner || '/' || value", "CAST(to_json(value) AS VARCHAR)", listed)
    out["file_profile"] = _section(
        "file_profile", "source_file", _object("rows", "column_count"),
        f'SELECT source_file, count(*) AS "rows", {len(_ALL_COLUMNS)} AS column_count FROM act GROUP BY source_file',
    )
    out["file_top_values"] = _section("file_top_values", f"source_file || '/' || \"column\" || '/' || {ranked}", _object("value", "rows", text="value"), _top_values())
    return {f"document_{name}": _events(sql) for name, sql in out.items()}


def _cube() -> str:
    sums = []
    for status, where in (("all", ""), ("success", "won"), ("failed", "lost")):
        keep = f" FILTER (WHERE {where})" if where else ""
        sums.append(f"count(*){keep} AS rows_{status}")
        sums.append(_sum("scanCount", f"scans_{status}", where))
        sums.append(_sum("totalScanSize", f"size_{status}", where))
    return (
        f"SELECT source_file, year, scan_date, {_ISO}, projectName, true AS has_project_column, true AS has_hour_column, project_label, scanType, {', '.join(sums)} FROM "
        "(SELECT *, coalesce(projectName, versionName, '(Unknown project)') AS project_label FROM act) "
        "GROUP BY source_file, year, scan_date, hour_ts, projectName, project_label, scanType"
    )


def oracle_sql() -> dict[str, str]:
    years = f"CAST(year AS INTEGER) BETWEEN {YEARS[0]} AND {YEARS[1]}"
    kept = f"kept AS (SELECT * FROM act WHERE {years})"
    rows, size_off = "count(*)", dict(size=False)
    exported = (
        "text AS (SELECT projectName, string_agg(scanType || ': ' || CAST(scans AS VARCHAR), '; '"
        " ORDER BY scans DESC, scanType) AS breakdown FROM types GROUP BY projectName)"
    )
    return {
        "summary_totals": _events(
            f"SELECT *, {_RATE} FROM (SELECT count(DISTINCT source_file) AS total_files, {_COUNTS} FROM act)"
        ),
        "run_summary": _events("SELECT count(DISTINCT source_file) AS total_files, count(*) AS total_rows FROM act"),
        "totals_by_grain": _orders(_totals("act")),
        "scan_types_by_status": _events(
            f"SELECT scanType, status, {_sum('scanCount', 'scans')} FROM st WHERE scanType IS NOT NULL GROUP BY scanType, status"
        ),
        "scan_types_by_grain": _orders(_scan_types()),
        "scan_type_rows": _events('SELECT scanType, count(*) AS "rows" FROM act WHERE scanType IS NOT NULL GROUP BY scanType'),
        "state_distribution": _events('SELECT state, count(*) AS "rows" FROM act WHERE state IS NOT NULL GROUP BY state'),
        "unique_projects_slice": _orders(
            "SELECT year, count(DISTINCT projectName) AS unique_projects FROM act WHERE source_file IN ('america.csv', 'asia.csv')"
            " AND year BETWEEN '1994' AND '1996' GROUP BY GROUPING SETS ((), (year))"
        ),
        "unique_projects_by_grain": _events(
            "SELECT source_file, year, count(DISTINCT projectName) AS unique_projects FROM act WHERE projectName IS NOT NULL"
            " GROUP BY GROUPING SETS ((), (source_file), (source_file, year))"
        ),
        "project_summary": _orders(
            "SELECT projectName, CAST(sum(scanCount) AS BIGINT) AS scanCount, CAST(sum(totalScanSize) AS BIGINT) AS totalScanSize,"
            " count(codeLocationName) AS codeLocationName FROM act WHERE projectName IS NOT NULL GROUP BY projectName"
        ),
        "distinct_lists": _orders(_LISTS),
        "available_dates": _events("SELECT DISTINCT scan_date FROM act WHERE scan_date IS NOT NULL"),
        "activity_cube": _events(_cube()),
        "time_blocks": _events(_BLOCKS, _profiles("count(*)", ["global"])),
        "time_blocks_scans": _events(_BLOCKS, _profiles("sum(scanCount)", ["global"])),
        "time_blocks_by_grain": _orders(_BLOCKS, _profiles("count(*)", _BLOCK_GRAINS)),
        "busiest_quietest": _events(_PEAKS, _profiles("count(*)", ["global"])),
        "busiest_quietest_by_grain": _orders(_PEAKS, _profiles("count(*)", _BLOCK_GRAINS)),
        "top_projects": _orders(_top()),
        "top_projects_by_year": _orders(_top("year")),
        "top_projects_by_file": _orders(_top("source_file")),
        "top_projects_by_file_year": _orders(_top("source_file", "year")),
        "top_projects_by_block": _events(_top("time_block", k=10)),
        "top_projects_by_year_block": _orders(_top("year", "time_block", k=10)),
        "top_projects_by_date": _events(_top("scan_date")),
        "top_projects_by_type": _orders(_top("scanType")),
        "top_projects_by_type_date": _events(_top("scanType", "scan_date")),
        "eligible_projects": _orders("SELECT * FROM chosen", _CHOSEN),
        "series_hourly": _events(_series()),
        "series_by_year": _orders(_series("year")),
        "series_by_project": _orders(_series("projectName", **size_off)),
        "series_by_year_project": _orders(
            _series("year", "projectName", all_only=True, **size_off)
        ),
        "series_by_file": _events(_series("source_file", measure=rows, all_only=True)),
        "evolution_global": _orders(_series("scanType", **size_off)),
        "evolution_by_year": _orders(_series("year", "scanType", **size_off)),
        "evolution_by_project": _orders(_series("projectName", "scanType", **size_off)),
        "evolution_by_year_project": _orders(
            _series("year", "projectName", "scanType", all_only=True, **size_off)
        ),
        "evolution_by_file": _events(
            _series("source_file", "scanType", measure=rows, all_only=True, **size_off)
        ),
        "series_sampled": _orders(_sampled(_series("year"), "year, status", 100)),
        "series_eligible_projects": _orders(_series("projectName", chosen=True, **size_off), _CHOSEN),
        "daily_series": _orders(
            "SELECT strftime(min(hour_ts), '%Y-%m-%d %H:%M:%S') AS hour_ts, CAST(sum(scanCount) AS BIGINT) AS \"count\","
            " CAST(sum(totalScanSize) AS BIGINT) AS size FROM act WHERE hour_ts IS NOT NULL GROUP BY CAST(hour_ts AS DATE)"
        ),
        "column_trends": _events(_trends(), f"placed AS (SELECT *, {_POSITION} FROM act)"),
        "sph_hourly": _events(f"SELECT {_ISO}, sph FROM sph", _HOURLY),
        "sph_summary": _events(f"SELECT {_SPH} FROM sph", _HOURLY),
        "sph_by_year": _orders(f"SELECT CAST(year(hour_ts) AS VARCHAR) AS year, {_SPH} FROM sph GROUP BY year(hour_ts)", _HOURLY),
        "sph_flagged_hours": _orders(
            f"SELECT {_ISO}, sph, {_pct('sph', str(CAPACITY))} AS pct, {_STATUS}, {_SNIPPET} FROM sph WHERE sph >= {_WARN}",
            _HOURLY,
        ),
        "sph_contributors": _events(
            "SELECT strftime(ranked.hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts, r AS rank, project, scans, sph, "
            f"{_STATUS}, n AS total_project_count, {_pct('top3', 'sph')} AS top3_pct "
            f"FROM ranked JOIN head ON ranked.hour_ts = head.hour_ts WHERE r <= 10 AND sph >= {_WARN}",
            *_WHO,
        ),
        "sph_flagged_report": _events(
            f"SELECT strftime(s.hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts, s.sph, {_pct('s.sph', str(CAPACITY))} AS pct,"
            f" CASE WHEN s.sph >= {CAPACITY} THEN 'BREACH' ELSE 'WARNING' END AS status, {_SNIPPET.replace('sph', 's.sph')},"
            f" projects, s.sph - shown AS rest_scans, total_project_count, {_pct('top3', 's.sph')} AS top3_pct"
            " FROM sph s JOIN head ON s.hour_ts = head.hour_ts JOIN (SELECT hour_ts, max(n) AS total_project_count, CAST(sum(scans) AS BIGINT) AS shown,"
            " string_agg(project || '=' || CAST(scans AS VARCHAR), ';' ORDER BY r) AS projects"
            f" FROM ranked WHERE r <= 10 GROUP BY hour_ts) w ON s.hour_ts = w.hour_ts WHERE s.sph >= {_WARN}",
            _HOURLY,
            *_WHO,
        ),
        "sph_classified_hours": _orders(
            f"SELECT {_ISO}, sph, CASE WHEN sph >= {CAPACITY} THEN 'breach' WHEN sph >= {_WARN} THEN 'warning' ELSE 'normal' END AS class FROM sph",
            _HOURLY,
        ),
        "sph_display_series": _orders(
            f"SELECT {_ISO}, sph, CASE WHEN sph >= {CAPACITY} THEN 'breach' WHEN sph >= {_WARN} THEN 'warning' ELSE 'normal' END AS class"
            " FROM (SELECT *, row_number() OVER (ORDER BY hour_ts) - 1 AS pos, count(*) OVER () AS n FROM sph)"
            f" WHERE pos % greatest(1, n // 500) = 0 OR sph >= {_WARN}",
            _HOURLY,
        ),
        "project_scans_daily": _orders("SELECT * FROM daily", _DAILY),
        "project_scans_breakdown": _orders(
            "SELECT projectName, row_number() OVER (PARTITION BY projectName ORDER BY scans DESC, scanType) - 1 AS position,"
            " scanType, scans FROM types",
            _TYPES,
        ),
        "project_scans_totals": _orders(
            "SELECT projectName, CAST(sum(scans) AS BIGINT) AS scans FROM daily WHERE contains(lower(projectName), 'er#00000001')"
            " AND scan_date BETWEEN '1996-06-01' AND '1999-12-31' GROUP BY projectName",
            _DAILY,
        ),
        "project_scans_page": _orders(
            "SELECT projectName, CAST(sum(scans) AS BIGINT) AS scans FROM daily WHERE scanType = 'SNIPPET'"
            " GROUP BY projectName ORDER BY scans DESC, projectName LIMIT 20 OFFSET 40",
            _DAILY,
        ),
        "project_scans_seek": _orders(
            "SELECT projectName, CAST(sum(scans) AS BIGINT) AS scans FROM daily WHERE scanType = 'SNIPPET'"
            " GROUP BY projectName ORDER BY scans DESC, projectName LIMIT 20 OFFSET 40",
            _DAILY,
        ),
        "project_scans_per_type": _orders(
            "SELECT * FROM daily WHERE scanType = 'SIGNATURE' AND scan_date BETWEEN '1997-01-01' AND '1997-12-31'", _DAILY
        ),
        "project_scans_date_range": _orders("SELECT min(scan_date) AS min_date, max(scan_date) AS max_date FROM daily", _DAILY),
        "profile_files": _events(
            f"SELECT source_file, count(*) AS \"rows\", '{','.join(_ALL_COLUMNS)}' AS \"columns\","
            f" CAST({len(_ALL_COLUMNS)} AS BIGINT) AS column_count FROM act GROUP BY source_file"
        ),
        "profile_preview": _events(
            "SELECT source_file, row_no, projectName, scanType, state, strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS hour, scanCount"
            " FROM placed WHERE row_no < 5",
            f"placed AS (SELECT *, {_POSITION} FROM act)",
        ),
        "profile_numeric": _events(_numeric()),
        "profile_top_values": _events(_top_values()),
        "year_bounded_summary": _orders(
            f"SELECT *, {_RATE} FROM (SELECT (SELECT count(DISTINCT source_file) FROM act) AS total_files, {_COUNTS} FROM kept)", kept
        ),
        "year_bounded_lists": _orders(
            f"SELECT * FROM ({_LISTS.replace('FROM act', 'FROM kept')}) WHERE list NOT LIKE 'file%'"
            f" UNION ALL SELECT * FROM ({_LISTS}) WHERE list LIKE 'file%'",
            kept,
        ),
        "year_range": _orders(_totals("kept", ["global", "year", "file"]), kept),
        "year_retention": _orders(
            f"SELECT *, {_pct('rows_after', 'rows_before')} AS kept_pct FROM (SELECT source_file, count(*) AS rows_before,"
            f" count(*) FILTER (WHERE {years}) AS rows_after FROM act GROUP BY source_file)"
        ),
        "group_closure": "WITH RECURSIVE" + _TREE + "\nSELECT projectName FROM closure",
        "stored_group_closure": "WITH RECURSIVE" + _TREE + "\nSELECT projectName FROM closure",
        "group_filtered_totals": "WITH RECURSIVE" + _TREE + "," + _ORDERS + _COMMON
        + ",\nmine AS (SELECT * FROM act WHERE projectName IN (SELECT projectName FROM closure))\n"
        + _totals("mine", ["global", "year"]),
        "group_retention": "WITH RECURSIVE" + _TREE + "," + _ORDERS + _COMMON
        + f"\nSELECT *, {_pct('rows_after', 'rows_before')} AS kept_pct FROM (SELECT count(*) AS rows_before,"
        " count(*) FILTER (WHERE projectName IN (SELECT projectName FROM closure)) AS rows_after FROM act)",
        "safe_group_names": "WITH RECURSIVE" + _TREE
        + "\nSELECT DISTINCT name, regexp_replace(name, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_name FROM tree",
        "slice_dashboard": _orders(
            f"SELECT * FROM ({_scan_types(['file_year'])}) WHERE source_file = 'america.csv' AND year = '1997'"
        ),
        "stored_slice": _orders(f"SELECT * FROM ({_totals('act', ['file_year'])}) WHERE source_file = 'america.csv' AND year = '1997'"),
        "searched_names": _orders(
            "SELECT DISTINCT pattern, projectName FROM act, (SELECT unnest(["
            + ", ".join(f"'{p}'" for p in PATTERNS)
            + "]) AS pattern) WHERE contains(lower(projectName), lower(pattern))"
        ),
        "zip_roundtrip": _events(
            f"SELECT source_file, codeLocationId, {_ISO}, codeLocationName, versionName, projectName, scanCount, scanType,"
            " totalScanSize, maxScanSize, state, transitionReason FROM act"
        ),
        "zip_quality": _events(
            "SELECT 'logs/' || source_file AS source_file, count(*) AS total_rows, "
            + ", ".join(f"CAST(0 AS BIGINT) AS bad_{n}_rows" for n in ("hour", "scan_count", "total_size", "max_size"))
            + " FROM act GROUP BY source_file"
        ),
        "zip_storage_roundtrip": _events(
            "SELECT 'archive-' || CAST(codeLocationId // 400 AS VARCHAR) || '.zip/logs/' || source_file AS source_file, count(*) AS total_rows,"
            " CAST(sum(scanCount) AS BIGINT) AS total_scans, count(*) - 1 AS last_row, first_location FROM (SELECT *,"
            " first_value(codeLocationId) OVER (PARTITION BY codeLocationId // 400, source_file ORDER BY codeLocationId) AS first_location FROM act)"
            " GROUP BY codeLocationId // 400, source_file, first_location"
        ),
        "zip_empty_files": _events(
            f"SELECT *, {_RATE} FROM (SELECT count(DISTINCT concat(codeLocationId // 400, source_file)) + 1 AS total_files, {_COUNTS} FROM act)"
        ),
        "zip_log_types": _events(
            "SELECT DISTINCT 'logs/' || source_file AS source_file, c.name AS \"column\", c.kind AS log_type FROM act, (SELECT unnest(["
            + ", ".join(f"{{'name': '{c}', 'kind': '{'int64' if c in _WHOLE else 'object'}'}}" for c in _ALL_COLUMNS)
            + "]) AS c)"
        ),
        "zip_incremental_landing": _events(
            "SELECT source_file, landed_rows, landed_scans, landed_size, landed_rows AS cube_rows, landed_scans AS cube_scans, landed_size AS cube_size FROM ("
            "SELECT 'archive-' || CAST(codeLocationId // 400 AS VARCHAR) || '.zip/logs/' || source_file AS source_file, count(*) AS landed_rows,"
            " CAST(sum(scanCount) AS BIGINT) AS landed_scans, CAST(sum(CASE WHEN lost THEN totalScanSize ELSE 0 END) AS BIGINT) AS landed_size"
            " FROM act WHERE codeLocationId >= 400 OR codeLocationId % 2 = 0 GROUP BY codeLocationId // 400, source_file)"
        ),
        "csv_storage_roundtrip": _events(
            "SELECT 'Unknown' AS scanType, projectName, count(*) FILTER (WHERE won) AS won, CAST(sum(scanCount) AS BIGINT) AS scans FROM act GROUP BY projectName"
        ),
        "bare_log_report": _events(
            "SELECT projectName, 'Unknown' AS scanType, 'Unknown' AS scan_date, count(*) AS scans FROM act WHERE projectName IS NOT NULL GROUP BY projectName"
        ),
        "landed_roundtrip": _orders(_totals("kept", ["year", "file_year"]), kept),
        "series_sink": _orders(
            f"SELECT *, 'year' AS grain, 'series' AS metric FROM ({_series('year')})"
        ),
        "export_sink": _orders(
            "SELECT daily.*, coalesce(breakdown, '') AS breakdown FROM daily LEFT JOIN text USING (projectName)", _DAILY, _TYPES, exported
        ),
        "analysis_documents": _events(_documents()),
        **_sections(),
        "document_sph_flagged_hours": _events(
            "SELECT 'sph_flagged_hours' AS section, h AS path, '{\"hour_ts\":\"' || h || '\",\"sph\":' || CAST(sph AS VARCHAR) || ',\"status\":\"' || level || '\"}' AS body"
            " FROM (SELECT strftime(hour_ts, '%Y-%m-%d %H:%M:%S') AS h, CAST(sum(scanCount) AS BIGINT) AS sph,"
            f" CASE WHEN sum(scanCount) >= {EVENT_CAPACITY} THEN 'BREACH' ELSE 'WARNING' END AS level FROM act WHERE hour_ts IS NOT NULL"
            f" GROUP BY hour_ts HAVING sum(scanCount) >= {int(EVENT_CAPACITY * 0.8)})"
        ),
        "whole_document": _events(
            "SELECT total_rows, total_scans, state, \"rows\" FROM (SELECT count(*) AS total_rows, CAST(coalesce(sum(scanCount), 0) AS BIGINT) AS total_scans FROM act)"
            " LEFT JOIN (SELECT state, count(*) AS \"rows\" FROM act WHERE state IS NOT NULL GROUP BY state) ON true"
        ),
    }
