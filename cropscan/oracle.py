"""DuckDB SQL for the registered queries, written independently of the Spark plans.

Every text is self-contained: the shared views are common table expressions.
"""

from __future__ import annotations

BANDS = [f"B{k:02d}" for k in range(1, 13)]
KEYS = "tile_x, tile_y, x, y, CAST(date AS VARCHAR) AS date"
SCENE = "tile_x, tile_y, CAST(date AS VARCHAR) AS date"
LABELS = ("click", "purchase", "view")


def _band_sql() -> str:
    return ",\n".join(
        f"CAST(300 + (pk*{7 * k + 3} + sk*{11 * k + 5} + p*{13 * k + 1} + d*{101 * k + 17}) % 3900"
        f" AS INTEGER) AS {b}"
        for k, b in enumerate(BANDS, start=1)
    )


def _colour_sql(name: str, a: int, b: int, c: int) -> str:
    return (
        f"CAST(CASE WHEN p//4096 = 0 AND d = 3 THEN 240 WHEN (p+d) % 11 = 0 THEN 200 + p % 56 ELSE (p*{a} + d*{b} + q*{c}) % 256 END"
        f" AS INTEGER) AS {name}"
    )


CELL = """cell AS (
  SELECT *, CAST(7680 + 512*((p//4096) % 16) AS INTEGER) AS tile_x,
    CAST(10240 + 512*((p//4096)//16) AS INTEGER) AS tile_y,
    CAST(p % 64 AS INTEGER) AS x, CAST((p//64) % 64 AS INTEGER) AS y
  FROM (SELECT CAST(l_orderkey AS BIGINT)*8 + l_linenumber AS p, min(l_partkey) AS pk,
          min(l_suppkey) AS sk, CAST(min(l_quantity) AS BIGINT) AS q
        FROM lineitem GROUP BY 1))"""

PIXELS = f"""{CELL},
pixel_obs AS (
  SELECT tile_x, tile_y, x, y, CAST(DATE '2016-12-22' + CAST(10*d AS INTEGER) AS DATE) AS date,
    CAST(CASE WHEN (x-32)*(x-32) + (y-32)*(y-32) <= 784 THEN 0 ELSE 1 END AS INTEGER) AS mask,
    {_colour_sql('red', 31, 57, 3)},
    {_colour_sql('green', 17, 91, 5)},
    {_colour_sql('blue', 13, 29, 7)},
    {_band_sql()}
  FROM cell CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS d))"""


def _ratio(scale: float, high: str, low: str) -> str:
    return f"{scale:.1f}e0*(CAST({high} AS DOUBLE)-{low})/(CAST({high} AS DOUBLE)+{low})"


INDEX_SQL = {
    "NDVI": _ratio(10000, "B08", "B04"),
    "GNDVI": _ratio(10000, "B08", "B03"),
    "RDVI": "20000.0e0*(CAST(B08 AS DOUBLE)-B04)/sqrt(CAST(B08 AS DOUBLE)+B04)",
    "RBNDVI": "10000.0e0*(2*CAST(B08 AS DOUBLE)-B04-B02)/(2*CAST(B08 AS DOUBLE)+B04+B02)",
    "LCI": _ratio(100, "B08", "B05"),
    "LAI": _ratio(10000, "B05", "B04"),
    "SCI": _ratio(10000, "B11", "B08"),
    "NDMI": _ratio(10000, "B08", "B11"),
    "GLI": _ratio(10000, "B05", "B04"),
}
INDEX_COLUMNS = ",\n".join(f"CAST(trunc({e}) AS INTEGER) AS {n}" for n, e in INDEX_SQL.items())

INDEXED = f"{PIXELS},\nindexed AS (SELECT *, {INDEX_COLUMNS} FROM pixel_obs)"
CLEAR = f"{INDEXED},\nclear AS (SELECT * FROM indexed WHERE red < 225 AND green < 225 AND blue < 225)"

SOURCES = {
    "NIR": "B08", "RED": "B04", "GRN": "B03", "NDVI": "NDVI",
    "LCI": "LCI", "LAI": "LAI", "SCI": "SCI", "GNDVI": "GNDVI",
}


def _scaled_sql(window: str) -> str:
    return ",\n".join(
        f"CASE WHEN max({c}) OVER {window} = min({c}) OVER {window} THEN 0.0e0 ELSE "
        f"CAST({c} - min({c}) OVER {window} AS DOUBLE) / "
        f"CAST(max({c}) OVER {window} - min({c}) OVER {window} AS DOUBLE) END AS Scaled_{n}"
        for n, c in SOURCES.items()
    )


SCALED_NAMES = ", ".join(f"Scaled_{n}" for n in SOURCES)
BY_SCENE = f"{CLEAR},\nscaled AS (SELECT *, {_scaled_sql('(PARTITION BY tile_x, tile_y, date)')} FROM clear)"
BY_TABLE = f"{CLEAR},\nscaled AS (SELECT *, {_scaled_sql('()')} FROM clear)"

FEATURES = ("Scaled_NDVI", "Scaled_LCI", "Scaled_LAI", "Scaled_GNDVI", "Scaled_SCI")
CENTRES = ((0.3, 0.3, 0.5, 0.3, 0.7), (0.5, 0.5, 0.5, 0.5, 0.5), (0.7, 0.7, 0.5, 0.7, 0.3))


def _distance_sql(centre: tuple[float, ...]) -> str:
    gaps = [f"({f}-CAST({v} AS DOUBLE))" for f, v in zip(FEATURES, centre)]
    return " + ".join(f"{g}*{g}" for g in gaps)


SCORED = f"""{BY_SCENE},
measured AS (SELECT *, {", ".join(f"{_distance_sql(c)} AS d{i}" for i, c in enumerate(CENTRES))}
  FROM scaled WHERE mask = 0),
scored AS (SELECT *, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END
  AS INTEGER) AS prediction FROM measured)"""

PEAKS = ", ".join(f"max({b}) AS {b}" for b in BANDS)
CATALOGUE = f"""{PIXELS},
peaks AS (SELECT tile_x, tile_y, date, {PEAKS} FROM pixel_obs GROUP BY ALL),
catalogue AS (
  SELECT tile_x, tile_y, date, 'TCI' AS band FROM peaks
  {" ".join(f"UNION ALL SELECT tile_x, tile_y, date, '{b}' FROM peaks WHERE {b} >= 4190" for b in BANDS)}),
keyed AS (
  SELECT *, tile_x || '-' || tile_y || '-' || band || '-' || CAST(date AS VARCHAR) || '.png' AS key
  FROM catalogue)"""

TABLE_KEY = "'image_values_' || tile_x || '_' || tile_y || '_' || CAST(date AS VARCHAR) || '.snappy.parquet'"
HANDLES = f"""{CATALOGUE},
handles AS (
  SELECT 's3.ObjectSummary(bucket_name=''scenes'', key=''' || entry || ''')' AS key FROM (
    SELECT unnest(['img512/' || {TABLE_KEY}, 'img32/' || {TABLE_KEY}, 'img512/']) AS entry
    FROM (SELECT DISTINCT tile_x, tile_y, date FROM peaks)))"""

FACTS = """facts AS (
  SELECT o_custkey AS SEGPAR, CAST(year(o_orderdate) AS INTEGER) AS year,
    count(*) AS sale_price_count, max(CAST(floor(o_totalprice) AS BIGINT)) AS sale_price_mean,
    min(CAST(floor(o_totalprice) AS BIGINT)) AS min_income
  FROM orders GROUP BY 1, 2)"""

# The display fields as in operators/lots.py.
DISPLAY = """fields(field, format, verbage) AS (VALUES
  ('harverst_count', '0,0', 'Number of Harverst'),
  ('sale_price_mean', '$0,0', 'Average Sales Price'),
  ('sale_price_median', '$0,0', 'Median Sales Price'),
  ('sf_mean', '0,0', 'Average Square Footage'),
  ('price_sf_mean', '$0,0', 'Average Price Per Square Foot'),
  ('min_income', '$0,0', 'Minimum Income Required'))"""

# The cluster colours, and the spread palette for three clusters.
PALETTE = {
    name: f"CASE prediction WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {name} END"
    for name, a, b, c in (("red", 16, 0, 255), ("green", 173, 38, 0), ("blue", 0, 164, 0))
}
# Clusters 0, 1, 2 of the spread palette for three clusters.
SPREAD = {
    name: f"CASE prediction WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {name} END"
    for name, a, b, c in (("red", 0, 170, 170), ("green", 0, 85, 170), ("blue", 255, 170, 85))
}


def _painted_sql(colours: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in colours.items())


# One pass: extremes of the clear pixels of the scene, then the nearest centre of clear field pixels.
_CLEAR = "red < 225 AND green < 225 AND blue < 225"
_SCENE_WINDOW = "OVER (PARTITION BY tile_x, tile_y, date)"


def _in_place_sql(name: str, column: str) -> str:
    low, high = (f"{f}(CASE WHEN {_CLEAR} THEN {column} END) {_SCENE_WINDOW}" for f in ("min", "max"))
    return (f"CASE WHEN {high} = {low} THEN 0.0e0 ELSE CAST({column} - {low} AS DOUBLE) / "
            f"CAST({high} - {low} AS DOUBLE) END AS {name}")


PAINTED = f"""{INDEXED},
placed AS (SELECT *, {", ".join(_in_place_sql(f, SOURCES[f.removeprefix("Scaled_")]) for f in FEATURES)}
  FROM indexed),
ranked AS (SELECT *, {", ".join(f"{_distance_sql(c)} AS d{i}" for i, c in enumerate(CENTRES))} FROM placed),
cells AS (SELECT *, CASE WHEN NOT ({_CLEAR} AND mask = 0) THEN NULL WHEN d0 <= d1 AND d0 <= d2 THEN 0
  WHEN d1 <= d2 THEN 1 ELSE 2 END AS prediction FROM ranked)"""

SOIL = f"""{INDEXED},
soil AS (
  SELECT tile_x, tile_y, date, count(*) FILTER (WHERE {_CLEAR} AND mask = 0) AS clear_pixels,
    count(*) FILTER (WHERE {_CLEAR} AND mask = 0 AND red > green) AS harvested_pixels
  FROM indexed GROUP BY ALL)"""

YIELD = (
    "CAST(harvested_pixels AS DOUBLE)*97.7e0 AS cane, "
    "CAST(harvested_pixels AS DOUBLE)*97.7e0/6.2e0 AS sugar, "
    "CAST(harvested_pixels AS DOUBLE)*97.7e0/6.2e0*0.42e0 AS value"
)

DAILY = "daily AS (SELECT CAST(ts AS DATE) AS date, * EXCLUDE (ts) FROM events)"
# Some values are no numbers there.
MEASURED = """daily AS (SELECT CAST(ts AS DATE) AS date,
  * EXCLUDE (ts) REPLACE (CASE WHEN event_id % 97 <> 0 THEN value END AS value) FROM events)"""
LABEL_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{n}') AS {n}" for n in LABELS)
_LISTED = ", ".join(f"'{n}'" for n in LABELS)
LABEL_TABLE = f"""{DAILY}, tally AS (SELECT date, {LABEL_COUNTS}, count(*) AS "Total",
  count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ({_LISTED})) AS "Other"
  FROM daily GROUP BY 1)"""

OVERLAY_SQL = f"WITH {PAINTED} SELECT {KEYS}, {_painted_sql(PALETTE)} FROM cells"


def _silhouette_sql() -> str:
    """Squared distances to whole clusters from their sizes, sums and sums of squares."""
    norm = " + ".join(f"{f}*{f}" for f in FEATURES)
    sums = ", ".join(f"sum({f}) AS y{i}" for i, f in enumerate(FEATURES))
    dot = " + ".join(f"p.{f}*c.y{i}" for i, f in enumerate(FEATURES))
    return f"""WITH {SCORED},
points AS (SELECT *, row_number() OVER () AS id, {norm} AS norm FROM scored),
clusters AS (SELECT prediction, CAST(count(*) AS DOUBLE) AS n, sum(norm) AS psi, {sums}
  FROM points GROUP BY 1),
gaps AS (SELECT p.id, p.prediction = c.prediction AS own, c.n,
    p.norm + c.psi/c.n - 2*({dot})/c.n AS gap FROM points p, clusters c),
sides AS (SELECT id, max(CASE WHEN own THEN n END) AS n,
    max(CASE WHEN own THEN gap*n/(n-1) END) AS a, min(CASE WHEN NOT own THEN gap END) AS b
  FROM gaps GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 OR a = b THEN 0 WHEN a < b THEN 1 - a/b ELSE b/a - 1 END), 6)
  AS silhouette FROM sides"""


# Images of B07 are missing in every third column of tiles.
_NO_B07 = "CASE WHEN tile_x//512 % 3 <> 0 THEN B07 END AS B07"

_MOVED = f"""WITH {SCORED},
step1 AS (SELECT prediction AS c, {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM scored GROUP BY 1),
gaps1 AS (SELECT s.*, s1.c, {" + ".join(f"(s.{f}-s1.{f})*(s.{f}-s1.{f})" for f in FEATURES)} AS gap
  FROM scored s, step1 s1),
near1 AS (SELECT arg_min(c, (gap, c)) AS c, {", ".join(f"any_value({f}) AS {f}" for f in FEATURES)}
  FROM gaps1 GROUP BY tile_x, tile_y, x, y, date)"""


def _audit_sql() -> str:
    return f"""WITH {PIXELS} SELECT {SCENE}, count(*) AS pixels, CAST(0 AS BIGINT) AS unlabelled,
  CAST(0 AS BIGINT) AS misplaced FROM pixel_obs WHERE {_CLEAR} GROUP BY tile_x, tile_y, pixel_obs.date"""


# The starts of several fits, as in the fixtures.
STARTS = (
    CENTRES,
    ((0.1, 0.1, 0.1, 0.1, 0.9), (0.9, 0.9, 0.9, 0.9, 0.1), (9.0, 9.0, 9.0, 9.0, 9.0)),
    ((0.2, 0.8, 0.5, 0.5, 0.5), (0.8, 0.2, 0.5, 0.5, 0.5), (0.5, 0.5, 0.2, 0.8, 0.5)),
)


def _restarts_sql(steps: int = 2) -> str:
    """Each start on its own: nearest centre of every pixel, then means, twice; then the cost."""
    listed = ", ".join(
        f"({i}, {c}, {', '.join(f'CAST({v} AS DOUBLE)' for v in centre)})"
        for i, start in enumerate(STARTS) for c, centre in enumerate(start))
    gap = " + ".join(f"(p.{f}-m.{f})*(p.{f}-m.{f})" for f in FEATURES)
    names = ", ".join(FEATURES)
    parts = [f"points AS (SELECT row_number() OVER () AS id, {names} FROM scored)", f"m0(start, c, {names}) AS (VALUES {listed})"]
    for k in range(steps):
        parts += [
            f"n{k} AS (SELECT start, id, min(struct_pack(d := {gap}, c := c)).c AS c FROM points p, m{k} m GROUP BY start, id)",
            f"a{k} AS (SELECT start, c, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM n{k} JOIN points USING (id) GROUP BY start, c)",
            f"m{k + 1} AS (SELECT start, c, {', '.join(f'coalesce(a.{f}, m.{f}) AS {f}' for f in FEATURES)} FROM m{k} m LEFT JOIN a{k} a USING (start, c))",
        ]
    parts.append(
        f"costs AS (SELECT start, sum(d) AS cost FROM (SELECT start, id, min({gap}) AS d FROM points p, m{steps} m GROUP BY start, id) GROUP BY start)")
    return f"""WITH {SCORED}, {", ".join(parts)}
SELECT CAST(start AS INTEGER) AS start, CAST(c AS INTEGER) AS prediction,
  {", ".join(f"round({f}, 5) AS {f}" for f in FEATURES)}, round(cost, 5) AS cost FROM m{steps} JOIN costs USING (start)"""


def _describe_sql(source: str, by: str, shown: str, columns: tuple[str, ...]) -> str:
    figures = ", ".join(f"round({e}, 5) AS {n}" for n, e in (
        ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("p25", "quantile_cont(v, 0.25)"),
        ("p50", "quantile_cont(v, 0.5)"), ("p75", "quantile_cont(v, 0.75)"), ("max", "max(v)")))
    long = " UNION ALL ".join(f"SELECT {by} AS g, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {source}" for c in columns)
    return f"SELECT {shown}, col AS \"column\", count(v) AS count, {figures} FROM ({long}) WHERE g IS NOT NULL GROUP BY g, col"


ORACLE: dict[str, str] = {
    "harvest_report": f"""WITH {PAINTED}, stats AS (
  SELECT tile_x, tile_y, date, count(prediction) AS clear_pixels,
    count(*) FILTER (WHERE prediction = 0) AS harvested_pixels FROM cells GROUP BY ALL)
SELECT {SCENE}, clear_pixels, harvested_pixels,
  CAST(harvested_pixels AS DOUBLE)/nullif(CAST(clear_pixels AS DOUBLE), 0) AS percentage, {YIELD} FROM stats""",
    "trained_report": f"""WITH {PIXELS} SELECT {SCENE},
  count(*) FILTER (WHERE {_CLEAR} AND mask = 0) AS clear_pixels,
  TRUE AS harvested_is_lowest, TRUE AS value_is_theirs
FROM pixel_obs GROUP BY tile_x, tile_y, pixel_obs.date""",
    "score_increment": f"""WITH {SCORED} SELECT {KEYS}, CASE WHEN date <> DATE '2017-01-01' THEN prediction
  WHEN d2 <= d1 AND d2 <= d0 THEN 0 WHEN d1 <= d0 THEN 1 ELSE 2 END AS prediction FROM scored""",
    "score_second_run": f"""WITH {PAINTED}, stats AS (
  SELECT CASE WHEN date < DATE '2017-01-21' THEN 0 ELSE 1 END AS run, tile_x, tile_y, date,
    count(prediction) AS clear_pixels, count(*) FILTER (WHERE prediction = 0) AS harvested_pixels
  FROM cells GROUP BY ALL)
SELECT run, count(*) AS scenes, CAST(sum(clear_pixels) AS BIGINT) AS clear_pixels,
  CAST(sum(harvested_pixels) AS BIGINT) AS harvested_pixels FROM stats GROUP BY run""",
    "scene_list": f"""WITH {CATALOGUE} SELECT key, {SCENE}, band,
  CAST(row_number() OVER (PARTITION BY tile_x, tile_y, band ORDER BY date) - 1 AS INTEGER) AS position
FROM keyed""",
    "object_keys_clean": f"WITH {CATALOGUE} SELECT DISTINCT {TABLE_KEY} AS key FROM peaks",
    "pixel_scan": f"WITH {PIXELS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM pixel_obs",
    "csv_roundtrip": """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
  o_custkey AS SEGPAR, o_totalprice AS price, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority
FROM orders""",
    "geojson_features": """SELECT c_custkey AS SEGPAR, c_name AS PLAN,
  CASE WHEN c_custkey % 7 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS shape,
  5 AS corners, CAST(c_custkey % 360 AS DOUBLE) AS west, CAST(c_custkey // 360 AS DOUBLE) AS south,
  CAST(c_custkey % 360 + 1 AS DOUBLE) AS east, CAST(c_custkey // 360 + 1 AS DOUBLE) AS north
FROM customer""",
    "geojson_parts": """SELECT 'Feature' AS type, c_custkey AS SEGPAR, c_name AS PLAN,
  CAST(c_custkey % 360 + 1 AS DOUBLE) AS east, 1 AS rings FROM customer""",
    "geojson_export": f"""WITH {FACTS}, merged AS (
  SELECT c_custkey AS k, c_name AS plan, c_nationkey AS nid, CASE WHEN s_acctbal >= 0 THEN s_name END AS address,
    coalesce(f.sale_price_count, 0) AS n, coalesce(f.sale_price_mean, 0) AS price,
    coalesce(f.min_income, 0) AS income, c_custkey % 360 AS w, c_custkey // 360 AS s
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
  LEFT JOIN (SELECT * FROM facts WHERE year = 1998) f ON f.SEGPAR = c_custkey)
SELECT '{{"type":"Feature","properties":{{"SEGPAR":' || k || ',"PLAN":"' || plan || '","nid":' || nid
  || ',"ADDRESS":' || coalesce('"' || address || '"', 'null') || ',"year":1998,"sale_price_count":' || n
  || ',"sale_price_mean":' || price || ',"min_income":' || income
  || '}},"geometry":{{"type":"Polygon","coordinates":[['
  || '[' || w || '.0,' || s || '.0],[' || (w+1) || '.0,' || s || '.0],[' || (w+1) || '.0,' || (s+1)
  || '.0],[' || w || '.0,' || (s+1) || '.0],[' || w || '.0,' || s || '.0]]]}}}}' AS feature
FROM merged""",
    "choropleth_export": f"""WITH {FACTS} SELECT c_custkey AS SEGPAR, c_name AS PLAN, 1998 AS year,
  coalesce(min_income, 0) AS min_income, CAST(least(greatest(
    floor((coalesce(min_income, 0) - 50000)*8/550000.0e0), 0), 7) AS INTEGER) AS colour_class
FROM customer LEFT JOIN facts ON c_custkey = SEGPAR AND year = 1998""",
    "scene_cloud_cover": f"""WITH {PIXELS}, scenes AS (
  SELECT tile_x, tile_y, date, CAST(sum(red) AS BIGINT) AS seed FROM pixel_obs GROUP BY ALL)
SELECT {SCENE}, CASE WHEN seed % 5 <> 0 THEN CAST(seed % 101 AS DOUBLE) END AS cloud_cover FROM scenes""",
    "image_folder": f"WITH {CATALOGUE} SELECT key, {SCENE}, band FROM keyed",
    "predictions_roundtrip": f"WITH {SCORED} SELECT {KEYS}, prediction FROM scored",
    "json_field": """SELECT event_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS cloud_cover FROM events""",
    "raster_explode": f"WITH {PIXELS} SELECT {KEYS}, mask, red, green, blue FROM pixel_obs",
    "parquet_roundtrip": f"WITH {PIXELS} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM pixel_obs",
    "sql_scan": "SELECT * FROM customer",
    "model_roundtrip": f"""WITH {CLEAR}
SELECT {SCENE}, count(*) AS pixels, count(*) AS same FROM clear GROUP BY tile_x, tile_y, clear.date""",
    "project_subset": f"WITH {SCORED} SELECT {KEYS}, prediction FROM scored",
    "rename_cols": """SELECT c_custkey AS SEGPAR, c_name AS neighborhood_name,
  c_nationkey AS subdist_no FROM customer""",
    "composite_key": f"""WITH {PIXELS} SELECT tile_x || ' ' || tile_y AS tile, x || ' ' || y AS pixel,
  CAST(date AS VARCHAR) AS date FROM pixel_obs""",
    "bright_filter": f"""WITH {PIXELS} SELECT {KEYS}, red, green, blue FROM pixel_obs
WHERE greatest(red, green, blue) < 225""",
    "quality_flags": f"""WITH {PIXELS} SELECT {KEYS}, red = green AND green = blue AS clouds,
  red > green AS havested FROM pixel_obs""",
    "tile_select": f"""WITH {PIXELS} SELECT {KEYS} FROM pixel_obs
WHERE tile_x || ' ' || tile_y IN ('7680 10240', '8192 10240')""",
    "lot_year_fill": f"""WITH {FACTS} SELECT c_custkey AS SEGPAR, c_name AS PLAN, c_nationkey AS nid,
  1998 AS year, coalesce(sale_price_count, 0) AS sale_price_count,
  coalesce(sale_price_mean, 0) AS sale_price_mean, coalesce(min_income, 0) AS min_income
FROM customer LEFT JOIN facts ON c_custkey = SEGPAR AND year = 1998""",
    "cluster_filter": f"WITH {SCORED} SELECT {KEYS} FROM scored WHERE prediction = 0",
    "crop_window": f"""WITH {PIXELS} SELECT tile_x, tile_y, x-16 AS x, y-8 AS y,
  CAST(date AS VARCHAR) AS date, red, green, blue FROM pixel_obs
WHERE x BETWEEN 16 AND 47 AND y BETWEEN 8 AND 39""",
    "mask_pixels": f"""WITH {CELL} SELECT tile_x, tile_y, x, y FROM cell
WHERE (x-32)*(x-32) + (y-32)*(y-32) <= 784""",
    "scene_slice": f"""WITH {PIXELS}, placed AS (SELECT *,
    CAST(dense_rank() OVER (PARTITION BY tile_x, tile_y ORDER BY date) - 1 AS INTEGER) AS day_no
  FROM pixel_obs)
SELECT {KEYS}, day_no FROM placed WHERE day_no IN (1, 2)""",
    "mask_semijoin": f"WITH {PIXELS} SELECT {KEYS} FROM pixel_obs WHERE mask = 0",
    "lot_address_join": """SELECT c_custkey AS SEGPAR, c_name AS PLAN, c_nationkey AS nid,
  CASE WHEN s_acctbal >= 0 THEN s_name END AS ADDRESS
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "minmax_sql": f"""WITH {INDEXED}, m AS (
  SELECT {", ".join(f"min({c}) AS lo_{n}, max({c}) AS hi_{n}" for n, c in SOURCES.items())} FROM indexed)
SELECT {KEYS}, {", ".join(f"CAST({c}-lo_{n} AS DOUBLE)/nullif(hi_{n}-lo_{n}, 0) AS {n}_scaled"
    for n, c in SOURCES.items())} FROM indexed CROSS JOIN m""",
    "band_pivot": f"""WITH {PIXELS}, seen AS (SELECT * REPLACE ({_NO_B07}) FROM pixel_obs)
SELECT {KEYS}, {', '.join(BANDS)} FROM seen""",
    "image_ingest": f"""WITH {PIXELS}
SELECT * REPLACE (CAST(date AS VARCHAR) AS date, {_NO_B07}) FROM pixel_obs""",
    "image_sizes": f"""WITH {PIXELS} SELECT {SCENE},
  CAST(12 - (tile_x//512 % 3 = 0)::INTEGER + (tile_x//512 % 2 = 1)::INTEGER AS BIGINT) AS images,
  64 AS width, 64 AS height, tile_x//512 % 2 = 0 AS same_size
FROM (SELECT DISTINCT tile_x, tile_y, date FROM pixel_obs)""",
    "scene_pairing": f"""WITH {CATALOGUE} SELECT {SCENE},
  {", ".join(f"max(CASE WHEN band = '{b}' THEN key END) AS {b}" for b in ["TCI", *BANDS])}
FROM keyed GROUP BY tile_x, tile_y, keyed.date""",
    "display_lookup": f"""WITH {FACTS}, {DISPLAY}, long AS (
  UNPIVOT facts ON sale_price_count, sale_price_mean, min_income INTO NAME field VALUE value)
SELECT SEGPAR, year, long.field AS field, value,
  CASE format WHEN '0,0' THEN format('{{:,}}', value) WHEN '$0,0' THEN '$' || format('{{:,}}', value)
  END AS shown, verbage
FROM long LEFT JOIN fields ON fields.field = long.field""",
    "display_by_label": f"""WITH {FACTS}, {DISPLAY}, long AS (
  UNPIVOT facts ON sale_price_mean, min_income INTO NAME field VALUE value)
SELECT SEGPAR, year, verbage, long.field AS field, value, '$' || format('{{:,}}', value) AS shown
FROM long JOIN fields ON fields.field = long.field""",
    "overlay": OVERLAY_SQL,
    "overlay_join": OVERLAY_SQL,
    "cluster_counts": f"""WITH {SCORED} SELECT {SCENE}, prediction, count(*) AS pixels
FROM scored GROUP BY tile_x, tile_y, scored.date, prediction""",
    "cluster_profile": f"""WITH {SCORED}, profile AS (
  SELECT prediction, count(*) AS pixels, avg(NDVI) AS mean FROM scored GROUP BY 1)
SELECT prediction, pixels, round(mean, 6) AS mean_ndvi,
  row_number() OVER (ORDER BY mean, prediction) = 1 AS harvested FROM profile""",
    "harvest_pct": f"""WITH {SOIL} SELECT {SCENE}, clear_pixels, harvested_pixels,
  CAST(harvested_pixels AS DOUBLE)/nullif(CAST(clear_pixels AS DOUBLE), 0) AS percentage FROM soil""",
    "yield_estimate": f"WITH {SOIL} SELECT {SCENE}, {YIELD} FROM soil",
    "distinct_dates": f"WITH {PIXELS} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM pixel_obs",
    "tile_count": f"""WITH {PIXELS} SELECT count(*) AS tiles FROM (
  SELECT DISTINCT tile_x, tile_y FROM pixel_obs)""",
    "tile_dedup": f"""WITH {PIXELS} SELECT DISTINCT tile_x, tile_y, tile_x || ' ' || tile_y AS tile
FROM pixel_obs""",
    "filter_audit": f"""WITH {PIXELS}, flags AS (
  SELECT *, red < 225 AND green < 225 AND blue < 225 AS ok FROM pixel_obs)
SELECT {SCENE}, count(*) AS all_pixels, count(*) FILTER (WHERE ok) AS clear_pixels,
  count(*) FILTER (WHERE mask = 0) AS mask_pixels,
  count(*) FILTER (WHERE ok AND mask = 0) AS clear_mask_pixels
FROM flags GROUP BY tile_x, tile_y, flags.date""",
    "ts_describe": f"""WITH {MEASURED} SELECT CAST(date AS VARCHAR) AS date, count(value) AS count,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM daily GROUP BY daily.date""",
    "ts_describe_all": f"WITH {MEASURED} " + _describe_sql("daily", "date", "CAST(g AS VARCHAR) AS date", ("event_id", "user_id", "value")),
    "describe_groups": _describe_sql(
        "lineitem", "l_returnflag", "g AS l_returnflag", ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")),
    "ts_group_sum": f"""WITH {MEASURED} SELECT CAST(date AS VARCHAR) AS date,
  round(avg(value)*count(value), 4) AS total FROM daily GROUP BY daily.date""",
    "label_table_found": f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date,
  {", ".join(f"count(*) FILTER (WHERE event_type = '{n}') AS {n}" for n in ("click", "error", "purchase", "signup", "view"))},
  count(*) FILTER (WHERE event_type IS NULL) AS "Other" FROM daily GROUP BY daily.date""",
    "tally_documents": f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date, event_type AS label, count(*) AS count
FROM daily WHERE user_id % 3 = 0 GROUP BY daily.date, 2""",
    "scene_metadata": f"""WITH {PIXELS}, scenes AS (
  SELECT tile_x, tile_y, date, CAST(sum(red) AS BIGINT) AS seed FROM pixel_obs GROUP BY ALL)
SELECT {SCENE}, CASE WHEN seed % 5 <> 0 THEN seed % 101 END AS "cloud-cover", 'L1C' AS level FROM scenes""",
    "scored_audit": f"""WITH {PAINTED} SELECT count(*) AS all_pixels, count(*) FILTER (WHERE {_CLEAR}) AS clear_pixels,
  count(*) FILTER (WHERE mask = 0) AS mask_pixels, count(*) FILTER (WHERE {_CLEAR} AND mask = 0) AS clear_mask_pixels,
  count(prediction) AS scored_pixels, count(*) FILTER (WHERE prediction = 0) AS harvested_pixels FROM cells""",
    "label_precision": f"""WITH {LABEL_TABLE} SELECT CAST(date AS VARCHAR) AS date,
  {", ".join(LABELS)}, "Other", "Total",
  round_even(CAST(view AS DOUBLE)/CAST("Total" AS DOUBLE)*100.0e0, 0)/100.0e0 AS "Precision"
FROM tally""",
    "label_pivot": f"""WITH {LABEL_TABLE} SELECT CAST(date AS VARCHAR) AS date,
  {", ".join(LABELS)}, "Other" FROM tally""",
    "scene_completeness": f"""WITH {CATALOGUE}, bands AS (SELECT unnest({BANDS}) AS band),
tiles AS (SELECT tile_x, tile_y, count(DISTINCT date) AS colour_dates FROM catalogue
  WHERE band = 'TCI' GROUP BY 1, 2),
counted AS (SELECT tile_x, tile_y, colour_dates, band,
    (SELECT count(DISTINCT date) FROM catalogue c WHERE c.tile_x = t.tile_x
      AND c.tile_y = t.tile_y AND c.band = b.band) AS band_dates FROM tiles t, bands b)
SELECT * FROM counted WHERE colour_dates <> band_dates""",
    "latest_scene": f"""WITH {CATALOGUE} SELECT tile_x, tile_y, band,
  CAST(max(date) AS VARCHAR) AS date, arg_max(key, date) AS key FROM keyed GROUP BY 1, 2, 3""",
    "ts_sorted": f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date, event_id, value FROM daily
ORDER BY 1, 2""",
    "ts_head": f"""WITH {DAILY} SELECT CAST(date AS VARCHAR) AS date, event_id, value FROM daily
ORDER BY 1, 2 LIMIT 5""",
    "scene_union": f"""WITH {PIXELS} SELECT tile_x, tile_y, x, y,
  CASE WHEN tile_y % 1024 = 0 OR x <> 0 THEN CAST(date AS VARCHAR) END AS date, red, green, blue FROM pixel_obs""",
    "hstack": f"""WITH {PAINTED} SELECT {KEYS}, {_painted_sql(SPREAD)} FROM cells
UNION ALL SELECT tile_x, tile_y, x + 64, y, CAST(date AS VARCHAR), red, green, blue FROM pixel_obs""",
    "veg_indices": f"WITH {INDEXED} SELECT {KEYS}, {', '.join(INDEX_SQL)} FROM indexed",
    **{
        f"index_{n.lower()}": f"WITH {PIXELS} SELECT {KEYS}, CAST(trunc({e}) AS INTEGER) AS {n} FROM pixel_obs"
        for n, e in INDEX_SQL.items()
    },
    "scene_parse": f"""WITH {CATALOGUE} SELECT key, {SCENE}, band FROM keyed
UNION ALL SELECT 'old-copy-B01.png', NULL, NULL, NULL, 'B01.png'""",
    "last_date": f"""WITH {HANDLES}, all_keys AS (
  SELECT key FROM handles UNION ALL SELECT key FROM keyed)
SELECT key, regexp_extract_all(key, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')[-1] AS last_date FROM all_keys""",
    "scene_keys_build": f"WITH {CATALOGUE} SELECT key AS image, {TABLE_KEY} AS \"table\" FROM keyed",
    "minmax_global": f"WITH {BY_TABLE} SELECT {KEYS}, {SCALED_NAMES} FROM scaled",
    "minmax_scene": f"WITH {BY_SCENE} SELECT {KEYS}, {SCALED_NAMES} FROM scaled",
    "standard_scale": f"""WITH {CLEAR} SELECT {KEYS}, {", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS Standard_{c}"
        for c in ("B08", "B04", "B03"))} FROM clear""",
    "kmeans_fit": _audit_sql(),
    "kmeans_standardised": _audit_sql(),
    "kmeans_best_of": """SELECT CAST(seed AS INTEGER) AS seed, TRUE AS below_one_cluster, TRUE AS chosen_by_cost
FROM range(10) t(seed) WHERE EXISTS (SELECT 1 FROM lineitem)""",
    "pipeline_roundtrip": f"""WITH {PIXELS} SELECT {SCENE}, count(*) AS pixels, count(*) AS same FROM pixel_obs
WHERE {_CLEAR} AND mask = 0 AND date = DATE '2017-01-21' GROUP BY tile_x, tile_y, pixel_obs.date""",
    "kmeans_given_start": f"""{_MOVED} SELECT c AS prediction,
  {", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES)} FROM near1 GROUP BY 1""",
    "kmeans_given_starts": _restarts_sql(),
    "cluster_centers": """SELECT CAST(c AS INTEGER) AS prediction, TRUE AS has_members, TRUE AS is_mean
FROM range(5) t(c) WHERE EXISTS (SELECT 1 FROM lineitem)""",
    "kmeans_assign": f"WITH {SCORED} SELECT {KEYS}, NDVI, prediction FROM scored",
    "kmeans_lloyd_step": f"""WITH {SCORED} SELECT prediction, count(*) AS pixels,
  {", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES)} FROM scored GROUP BY 1""",
    "silhouette": _silhouette_sql(),
    "choropleth_bins": f"""WITH {FACTS}, long AS (
  UNPIVOT facts ON sale_price_mean, min_income INTO NAME field VALUE value)
SELECT SEGPAR, year, field, value, CAST(least(greatest(floor(CASE field
  WHEN 'sale_price_mean' THEN (value - 500000)*8/3500000.0e0 ELSE (value - 50000)*8/550000.0e0 END), 0), 7)
  AS INTEGER) AS colour_class
FROM (SELECT SEGPAR, year, field, value FROM long)""",
}
# The map colours, lowest class first.
ORACLE["choropleth_colours"] = f"""WITH {FACTS}, placed AS (
  SELECT c_custkey AS SEGPAR, 'sale_price_mean' AS field, sale_price_mean AS value,
    CASE WHEN sale_price_mean IS NOT NULL THEN
      CAST(least(greatest(floor((sale_price_mean - 500000)*8/3500000.0e0), 0), 7) AS INTEGER) END AS colour_class
  FROM customer LEFT JOIN facts ON c_custkey = SEGPAR AND year = 1998)
SELECT *, coalesce(['#f7fbff', '#deebf7', '#c6dbef', '#9ecae1', '#6baed6', '#4292c6', '#2171b5', '#084594'][colour_class + 1], 'gray')
  AS fill_color FROM placed"""
# The same results from other layouts.
ORACLE["harvest_report_clustered"] = ORACLE["report_from_files"] = ORACLE["harvest_report"]
ORACLE["scene_slice_clustered"] = ORACLE["scene_slice_dates"] = ORACLE["scene_slice"]
ORACLE["overlay_clustered"] = ORACLE["overlay_join"]
