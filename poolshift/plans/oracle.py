"""Oracle SQL (DuckDB) for every registered query that SQL can express.

Written from the semantics in the survey, not from the Spark plans: set
operations and ``QUALIFY`` where the Spark side uses aggregates and
``max_by``/``min_by``. The base tables are DuckDB views; the inventory is a
CTE over them (the fixture view of the test data).
"""

from __future__ import annotations

INVENTORY_SQL = """
SELECT 'svc.' || CAST(p.p_partkey AS STRING) AS psm,
       c.c_mktsegment AS idc,
       CASE WHEN l.l_linestatus = 'O' THEN 'default' ELSE 'canary' END AS cluster_name,
       'c' || CAST(l.l_suppkey AS STRING) AS cluster_id,
       CASE WHEN l.l_linenumber IN (2, 4) THEN NULL WHEN l.l_linenumber = 3 THEN '' ELSE p.p_brand END AS package,
       replace(r.r_name, ' ', '-') AS physical_cluster,
       CASE l.l_returnflag WHEN 'N' THEN 'default' WHEN 'A' THEN 'gpu' ELSE 'spot' END AS iaas_cluster,
       CASE l.l_linenumber WHEN 7 THEN 'n/a' WHEN 6 THEN NULL
            WHEN 5 THEN chr(9) || CAST(l.l_quantity AS STRING) || chr(10)
            WHEN 4 THEN CAST(l.l_quantity + 0.5 AS STRING)
            ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS instance_num,
       l.l_quantity * 4 AS cpu_limit,
       CAST(p.p_size AS DOUBLE) AS cpu_request,
       l.l_quantity * 8 + p.p_size AS mem_limit,
       CASE l.l_linenumber WHEN 1 THEN '  ' WHEN 2 THEN 'nan'
            WHEN 3 THEN CAST(l.l_quantity - p.p_size - 0.5 AS STRING)
            ELSE CAST(l.l_quantity - p.p_size AS STRING) END AS save_cores,
       CASE WHEN l.l_linenumber = 1 THEN '' ELSE CAST(CAST(round(l.l_discount * 100) AS INT) AS STRING) || '%' END AS cpu_util_max_1days,
       CAST(CAST(round(l.l_tax * 100) AS INT) AS STRING) || '%' AS cpu_util_max_7days,
       CAST(NULL AS STRING) AS mem_util_max_7days,
       p.p_type AS dept_level1,
       '/' || p.p_name || '/' AS dept_level2,
       o.o_orderpriority AS host_type,
       (l.l_orderkey * 10 + l.l_linenumber) * 1000 + row_number() OVER (
           PARTITION BY l.l_orderkey, l.l_linenumber ORDER BY l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS row_ord
FROM lineitem l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
"""


# Space and the control characters 9 to 13.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def num(x: str) -> str:
    """Text -> double the way a forgiving parser reads it (bad/blank/nan -> NULL)."""
    s = f"trim({x}, {BLANKS})"
    v = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN {v} END)")


NINV_SQL = f"""
SELECT psm, idc, cluster_name, cluster_id, package, physical_cluster, iaas_cluster,
       {num('instance_num')} AS instance_num,
       CAST(cpu_limit AS DOUBLE) AS cpu_limit,
       CAST(cpu_request AS DOUBLE) AS cpu_request,
       CAST(mem_limit AS DOUBLE) AS mem_limit,
       {num('save_cores')} AS save_cores,
       cpu_util_max_1days, cpu_util_max_7days, mem_util_max_7days,
       dept_level1, dept_level2, host_type, row_ord
FROM inv
"""

PK = "(coalesce(physical_cluster, 'nan') || '/' || coalesce(iaas_cluster, 'nan'))"
CNT = "CAST(trunc(coalesce(instance_num, 0)) AS BIGINT)"


def _with(*ctes: str) -> str:
    base = [f"inv AS ({INVENTORY_SQL})", f"ninv AS ({NINV_SQL})"]
    return "WITH " + ",\n".join(base + list(ctes)) + "\n"


# ---- migration (EUROPE/default -> ASIA/default, sites BUILDING, MACHINERY) ----
MIG_CTES = (
    f"""mrows AS (SELECT *, {PK} AS pool_identifier FROM ninv
        WHERE idc IN ('BUILDING', 'MACHINERY') AND cluster_name = 'default'
          AND {PK} IN ('EUROPE/default', 'ASIA/default'))""",
    """both_svc AS (SELECT psm FROM mrows WHERE pool_identifier = 'EUROPE/default' AND psm IS NOT NULL
        INTERSECT SELECT psm FROM mrows WHERE pool_identifier = 'ASIA/default')""",
    f"""lender_last AS (SELECT psm, {CNT} AS sort_key FROM mrows
        WHERE pool_identifier = 'EUROPE/default'
        QUALIFY row_number() OVER (PARTITION BY psm ORDER BY row_ord DESC) = 1)""",
    """matched AS (SELECT r.*, l.sort_key FROM mrows r JOIN both_svc b ON r.psm = b.psm
        JOIN lender_last l ON l.psm = r.psm)""",
)
MIG = _with(*MIG_CTES)

DETAIL_SELECT = f"""psm, pool_identifier, package, physical_cluster, iaas_cluster,
    {CNT} AS instance_num, cpu_limit, mem_limit, cluster_name, dept_level1, dept_level2,
    host_type, idc, sort_key"""

SUMMARY_SUMS = """sum(coalesce(instance_num, 0)) AS instance_num,
    sum(coalesce(cpu_limit, 0)) AS cpu_limit, sum(coalesce(mem_limit, 0)) AS mem_limit,
    max(sort_key) AS sort_key"""

# ---- scale-down (site BUILDING, pool EUROPE/default) ----
POOL_ROWS = """prows AS (SELECT * FROM ninv WHERE idc = 'BUILDING'
    AND physical_cluster = 'EUROPE' AND iaas_cluster = 'default')"""


def recommend_sql(min_cores: int, source: str = "prows") -> str:
    return f"""SELECT psm, cluster_id, package, cpu_limit, mem_limit,
      CAST(trunc(save_cores) AS BIGINT) AS save_cores,
      cpu_util_max_1days, cpu_util_max_7days, mem_util_max_7days,
      coalesce(dept_level1, '') || '/' || regexp_replace(coalesce(dept_level2, ''), '^/+|/+$', '', 'g') AS business_line,
      CAST(trunc(save_cores) AS BIGINT) > 10 AS priority
    FROM {source} WHERE save_cores IS NOT NULL AND CAST(trunc(save_cores) AS BIGINT) >= {min_cores}"""


REC = _with(POOL_ROWS, f"rec AS ({recommend_sql(0)})")

# ---- migratable (site BUILDING, pool EUROPE/default) ----
MS_CTES = (
    """drows AS (SELECT * FROM ninv WHERE idc = 'BUILDING' AND cluster_name = 'default' AND psm IS NOT NULL)""",
    """targets AS (SELECT psm, min(row_ord) AS first_seen FROM drows
        WHERE physical_cluster = 'EUROPE' GROUP BY psm)""",
    f"""others AS (SELECT d.psm, {PK} AS pk, min(d.row_ord) AS o, count(*) AS n FROM drows d
        JOIN targets t ON t.psm = d.psm
        WHERE d.physical_cluster IS DISTINCT FROM 'EUROPE' GROUP BY d.psm, {PK})""",
    """other_lists AS (SELECT psm, string_agg(pk, ', ' ORDER BY o) AS other_pools,
        CAST(sum(n) AS BIGINT) AS other_pool_cluster_count FROM others GROUP BY psm)""",
    """main_first AS (SELECT psm, instance_num, cpu_limit, mem_limit, dept_level1, dept_level2,
        package, cluster_id FROM drows WHERE physical_cluster = 'EUROPE' AND iaas_cluster = 'default'
        QUALIFY row_number() OVER (PARTITION BY psm ORDER BY row_ord) = 1)""",
    """ms AS (SELECT t.psm,
        CASE WHEN ol.psm IS NOT NULL THEN '多资源池' ELSE '单资源池' END AS deployment_status,
        coalesce(ol.other_pools, '') AS other_pools,
        coalesce(ol.other_pool_cluster_count, 0) AS other_pool_cluster_count,
        'BUILDING' AS idc, 'EUROPE/default' AS pool,
        m.instance_num, m.cpu_limit, m.mem_limit, m.dept_level1, m.dept_level2, m.package,
        m.cluster_id, t.first_seen
      FROM targets t LEFT JOIN other_lists ol ON ol.psm = t.psm
      LEFT JOIN main_first m ON m.psm = t.psm)""",
)
MS = _with(*MS_CTES)
MS_COLS = """psm, deployment_status, other_pools, other_pool_cluster_count, idc, pool,
    instance_num, cpu_limit, mem_limit, dept_level1, dept_level2, package, cluster_id"""

# ---- requests derived from nation/region ----
REQ_CTE = """req AS (
  SELECT 'r' || lpad(CAST(n.n_nationkey AS STRING), 2, '0') AS request_id,
    CASE n.n_nationkey % 4 WHEN 0 THEN 'BUILDING,MACHINERY' WHEN 1 THEN 'AUTOMOBILE'
         WHEN 2 THEN '' ELSE ' HOUSEHOLD , FURNITURE ' END AS idc,
    CASE WHEN n.n_nationkey = 11 THEN ' ' ELSE replace(r1.r_name, ' ', '-') || '/default' END AS pool1,
    CASE WHEN n.n_nationkey = 7 THEN replace(r1.r_name, ' ', '-') || '/default'
         WHEN n.n_nationkey = 13 THEN replace(r2.r_name, ' ', '-')
         ELSE replace(r2.r_name, ' ', '-') || '/' || CASE n.n_nationkey % 3 WHEN 0 THEN 'default'
              WHEN 1 THEN 'gpu' ELSE 'spot' END END AS pool2,
    replace(r1.r_name, ' ', '-') || '/default' AS pool,
    CAST(n.n_nationkey % 4 * 5 AS STRING) AS min_save_cores,
    replace(r1.r_name, ' ', '-') || '/default' AS target_pool,
    (replace(r2.r_name, ' ', '-') || '/' || CASE n.n_nationkey % 3 WHEN 0 THEN 'default'
         WHEN 1 THEN 'gpu' ELSE 'spot' END) || ', ,' || replace(r1.r_name, ' ', '-') || '/default' || ','
      || (replace(r2.r_name, ' ', '-') || '/' || CASE n.n_nationkey % 3 WHEN 0 THEN 'default'
         WHEN 1 THEN 'gpu' ELSE 'spot' END) || ',' || replace(r2.r_name, ' ', '-') || ' / default '
      AS candidate_pools
  FROM nation n JOIN region r1 ON r1.r_regionkey = n.n_regionkey
  JOIN region r2 ON r2.r_regionkey = (n.n_regionkey + 1) % 5)"""

BATCH_CTES = (
    REQ_CTE,
    """vreq AS (SELECT request_id,
        trim(split_part(trim(pool1), '/', 1)) || '/' || trim(split_part(trim(pool1), '/', 2)) AS k1,
        trim(split_part(trim(pool2), '/', 1)) || '/' || trim(split_part(trim(pool2), '/', 2)) AS k2,
        CASE WHEN trim(coalesce(idc, '')) = '' THEN NULL
             ELSE list_transform(string_split(idc, ','), lambda x: trim(x)) END AS sites
      FROM req
      WHERE trim(pool1) <> trim(pool2) AND length(trim(pool1)) - length(replace(trim(pool1), '/', '')) = 1
        AND length(trim(pool2)) - length(replace(trim(pool2), '/', '')) = 1)""",
    f"""brows AS (SELECT v.request_id, v.k1, v.k2, d.*, {PK} AS pool_identifier
      FROM ninv d JOIN vreq v ON {PK} IN (v.k1, v.k2)
      WHERE d.cluster_name = 'default' AND (v.sites IS NULL OR list_contains(v.sites, d.idc)))""",
    """bboth AS (SELECT request_id, psm FROM brows WHERE pool_identifier = k1 AND psm IS NOT NULL
       INTERSECT SELECT request_id, psm FROM brows WHERE pool_identifier = k2)""",
    f"""blast AS (SELECT request_id, psm, {CNT} AS sort_key FROM brows WHERE pool_identifier = k1
       QUALIFY row_number() OVER (PARTITION BY request_id, psm ORDER BY row_ord DESC) = 1)""",
    """bmatched AS (SELECT r.*, l.sort_key FROM brows r
       JOIN bboth b ON b.request_id = r.request_id AND b.psm = r.psm
       JOIN blast l ON l.request_id = r.request_id AND l.psm = r.psm)""",
    """bgate AS (SELECT request_id, bool_or(package IS NOT NULL AND package <> '') AS pkg
       FROM bmatched GROUP BY request_id)""",
)
BATCH = _with(*BATCH_CTES)

CAND_CTES = (
    """cands AS (SELECT * FROM (VALUES ('ASIA/default'), ('AFRICA/gpu'), ('AMERICA/spot'),
        ('NOWHERE/default')) t(candidate_pool))""",
    f"""crows AS (SELECT *, {PK} AS pool_identifier FROM ninv
        WHERE idc IN ('BUILDING', 'MACHINERY') AND cluster_name = 'default')""",
    """cboth AS (SELECT DISTINCT c.candidate_pool, r.psm FROM crows r
        JOIN cands c ON r.pool_identifier = c.candidate_pool
        WHERE r.psm IN (SELECT psm FROM crows WHERE pool_identifier = 'EUROPE/default'))""",
    f"""clast AS (SELECT psm, {CNT} AS sort_key FROM crows WHERE pool_identifier = 'EUROPE/default'
        QUALIFY row_number() OVER (PARTITION BY psm ORDER BY row_ord DESC) = 1)""",
    """cmatched AS (SELECT b.candidate_pool, r.*, l.sort_key FROM cboth b
        JOIN crows r ON r.psm = b.psm AND r.pool_identifier IN ('EUROPE/default', b.candidate_pool)
        JOIN clast l ON l.psm = b.psm)""",
    """cgate AS (SELECT candidate_pool, bool_or(package IS NOT NULL AND package <> '') AS pkg
        FROM cmatched GROUP BY candidate_pool)""",
    """pstats AS (SELECT pool_identifier, count(DISTINCT psm) AS psm_count,
        sum(coalesce(instance_num, 0)) AS total_instances, sum(coalesce(cpu_limit, 0)) AS total_cpu,
        sum(coalesce(mem_limit, 0)) AS total_memory FROM crows
        WHERE pool_identifier IN (SELECT candidate_pool FROM cands) OR pool_identifier = 'EUROPE/default'
        GROUP BY pool_identifier)""",
    """overview AS (SELECT c.candidate_pool,
        coalesce(m.n, 0) > 0 AS has_matches, CAST(coalesce(m.n, 0) AS BIGINT) AS matching_psm_count,
        CAST(coalesce(p.psm_count, 0) AS BIGINT) AS psm_count,
        coalesce(p.total_instances, 0.0) AS total_instances, coalesce(p.total_cpu, 0.0) AS total_cpu,
        coalesce(p.total_memory, 0.0) AS total_memory
      FROM cands c LEFT JOIN (SELECT candidate_pool, count(*) AS n FROM cboth GROUP BY candidate_pool) m
        ON m.candidate_pool = c.candidate_pool
      LEFT JOIN pstats p ON p.pool_identifier = c.candidate_pool)""",
)
CAND = _with(*CAND_CTES)

_REORDERED = """SELECT idc, mem_limit, psm, cpu_request, cluster_name, physical_cluster, {package} AS package,
    iaas_cluster, instance_num, cpu_limit, cluster_name AS cluster_id, cpu_limit - cpu_request AS save_cores,
    CAST(NULL AS VARCHAR) AS host_type FROM ninv"""

# Fixed display rule: 1,234.50 / 999 / 1.2K / 3.4M / %.1f (rounding half away from zero).
def _fmt(c: str) -> str:
    return (f"format('{{:,.2f}}', {c}) AS {c}_fmt, "
            f"CASE WHEN {c} >= 1e6 THEN printf('%.1f', round({c} / 1e6, 1)) || 'M' "
            f"WHEN {c} >= 1e3 THEN printf('%.1f', round({c} / 1e3, 1)) || 'K' "
            f"WHEN {c} = trunc({c}) THEN CAST(CAST({c} AS BIGINT) AS STRING) ELSE CAST({c} AS STRING) END AS {c}_short, "
            f"printf('%.1f', round({c}, 1)) AS {c}_1f")


RQ_CTE = """rq AS (SELECT request_id, idc AS req_idc, pool AS req_pool,
    NULLIF(coalesce(idc, ''), '') AS site,
    len(string_split(trim(pool), '/')) = 2 AS pair,
    CASE WHEN len(string_split(trim(pool), '/')) = 2 THEN trim(string_split(trim(pool), '/')[1])
         ELSE trim(pool) END AS phys,
    CASE WHEN len(string_split(trim(pool), '/')) = 2 THEN trim(string_split(trim(pool), '/')[2]) END AS part2,
    CASE WHEN regexp_full_match(trim(min_save_cores), '[+-]?[0-9]+')
         THEN CAST(trim(min_save_cores) AS INTEGER) ELSE 0 END AS min_cores
  FROM req)"""

RECOMMEND_BATCH = _with(REQ_CTE, RQ_CTE) + """SELECT q.request_id, d.psm, d.cluster_id, d.package,
    d.cpu_limit, d.mem_limit, CAST(trunc(d.save_cores) AS BIGINT) AS save_cores,
    d.cpu_util_max_1days, d.cpu_util_max_7days, d.mem_util_max_7days,
    coalesce(d.dept_level1, '') || '/' || regexp_replace(coalesce(d.dept_level2, ''), '^/+|/+$', '', 'g') AS business_line,
    CAST(trunc(d.save_cores) AS BIGINT) > 10 AS priority
  FROM ninv d JOIN rq q ON d.physical_cluster = q.phys
    AND d.iaas_cluster = (CASE WHEN q.pair THEN q.part2 ELSE 'default' END)
    AND (q.site IS NULL OR d.idc = q.site)
  WHERE d.save_cores IS NOT NULL AND CAST(trunc(d.save_cores) AS BIGINT) >= q.min_cores"""

MIGRATABLE_BATCH = _with(REQ_CTE, RQ_CTE,
    """rrows AS (SELECT q.request_id, q.phys, CASE WHEN q.pair AND q.part2 <> '' THEN q.part2 END AS want_iaas, d.*
      FROM ninv d JOIN rq q ON (q.site IS NULL OR d.idc = q.site)
      WHERE d.cluster_name = 'default' AND d.psm IS NOT NULL)""",
    """targets AS (SELECT request_id, psm, min(row_ord) AS first_seen FROM rrows
      WHERE physical_cluster = phys GROUP BY request_id, psm)""",
    f"""others AS (SELECT r.request_id, r.psm, {PK} AS pk, min(r.row_ord) AS o, count(*) AS n
      FROM rrows r JOIN targets t ON t.request_id = r.request_id AND t.psm = r.psm
      WHERE r.physical_cluster IS DISTINCT FROM r.phys GROUP BY r.request_id, r.psm, {PK})""",
    """other_lists AS (SELECT request_id, psm, string_agg(pk, ', ' ORDER BY o) AS other_pools,
      CAST(sum(n) AS BIGINT) AS cnt FROM others GROUP BY request_id, psm)""",
    """main_first AS (SELECT request_id, psm, instance_num, cpu_limit, mem_limit, dept_level1,
      dept_level2, package, cluster_id FROM rrows
      WHERE physical_cluster = phys AND (want_iaas IS NULL OR iaas_cluster = want_iaas)
      QUALIFY row_number() OVER (PARTITION BY request_id, psm ORDER BY row_ord) = 1)""") + """
SELECT t.request_id, t.psm,
  CASE WHEN ol.psm IS NOT NULL THEN '多资源池' ELSE '单资源池' END AS deployment_status,
  coalesce(ol.other_pools, '') AS other_pools, coalesce(ol.cnt, 0) AS other_pool_cluster_count,
  q.req_idc AS idc, q.req_pool AS pool, m.instance_num, m.cpu_limit, m.mem_limit, m.dept_level1,
  m.dept_level2, m.package, m.cluster_id, t.first_seen
FROM targets t JOIN rq q ON q.request_id = t.request_id
LEFT JOIN other_lists ol ON ol.request_id = t.request_id AND ol.psm = t.psm
LEFT JOIN main_first m ON m.request_id = t.request_id AND m.psm = t.psm"""

RL_CTE = """rl AS (SELECT request_id, trim(target_pool) AS target,
        CASE WHEN trim(coalesce(idc, '')) = '' THEN NULL
             ELSE list_transform(string_split(idc, ','), lambda x: trim(x)) END AS sites,
        list_filter(list_transform(string_split(coalesce(candidate_pools, ''), ','),
            lambda x: trim(regexp_replace(x, '^([^/]*?) */ *([^/]*)$', '\\1/\\2'))), lambda x: x <> '') AS l
      FROM req WHERE len(string_split(trim(target_pool), '/')) = 2)"""
CANDIDATE_CTES = (
    """rc AS (SELECT request_id, target, sites, candidate_pool, CAST(pos - 1 AS INTEGER) AS position
      FROM (SELECT request_id, target, sites,
                   unnest(dl) AS candidate_pool, generate_subscripts(dl, 1) AS pos
            FROM (SELECT *, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i),
                                        lambda x: x <> target) AS dl FROM rl)))""",
    f"""rrows AS (SELECT c.request_id, c.candidate_pool, c.target, d.psm, {PK} AS pk,
        d.instance_num, d.cpu_limit, d.mem_limit
      FROM rc c JOIN ninv d ON {PK} IN (c.target, c.candidate_pool)
      WHERE d.cluster_name = 'default' AND (c.sites IS NULL OR list_contains(c.sites, d.idc)))""",
    """bm AS (SELECT request_id, candidate_pool, count(*) AS n FROM (
        SELECT request_id, candidate_pool, psm FROM rrows WHERE pk = target AND psm IS NOT NULL
        INTERSECT SELECT request_id, candidate_pool, psm FROM rrows WHERE pk = candidate_pool)
      GROUP BY request_id, candidate_pool)""",
    """bp AS (SELECT request_id, candidate_pool, count(DISTINCT psm) AS psm_count,
        sum(coalesce(instance_num, 0)) AS total_instances, sum(coalesce(cpu_limit, 0)) AS total_cpu,
        sum(coalesce(mem_limit, 0)) AS total_memory
      FROM rrows WHERE pk = candidate_pool GROUP BY request_id, candidate_pool)""")
CANDIDATE_SELECT = """
SELECT c.request_id, c.candidate_pool, c.position,
  coalesce(m.n, 0) > 0 AS has_matches, CAST(coalesce(m.n, 0) AS BIGINT) AS matching_psm_count,
  CAST(coalesce(p.psm_count, 0) AS BIGINT) AS psm_count,
  coalesce(p.total_instances, 0.0) AS total_instances, coalesce(p.total_cpu, 0.0) AS total_cpu,
  coalesce(p.total_memory, 0.0) AS total_memory
FROM rc c
LEFT JOIN bm m ON m.request_id = c.request_id AND m.candidate_pool = c.candidate_pool
LEFT JOIN bp p ON p.request_id = c.request_id AND p.candidate_pool = c.candidate_pool"""
CANDIDATE_BATCH = _with(REQ_CTE, RL_CTE, *CANDIDATE_CTES) + CANDIDATE_SELECT

# Bodies of every shape, one per customer, and what can be read of them.
MIXED_CTES = (
    """mtext AS (SELECT c.c_custkey, c.c_custkey % 8 AS shape,
        '{' || CASE WHEN c.c_custkey % 48 = 8 THEN '"request_id": "same", ' WHEN c.c_custkey % 8 = 5 THEN ''
               ELSE '"request_id": "c' || c.c_custkey || '", ' END
        || '"idc": ' || CASE c.c_custkey % 8 WHEN 1 THEN '["' || c.c_mktsegment || ' ", null, "MACHINERY"]' WHEN 2 THEN '7'
               ELSE '" ' || c.c_mktsegment || ' , MACHINERY"' END
        || ', "target_pool": "' || replace(r1.r_name, ' ', '-') || '/default", "candidate_pools": '
        || CASE c.c_custkey % 8 WHEN 1 THEN '["' || p.pool || '", "AFRICA / gpu"]' WHEN 3 THEN '["' || p.pool || '", 3]'
               ELSE '"' || p.pool || ' ,, AFRICA / gpu"' END || '}' AS full_body
      FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r1 ON r1.r_regionkey = n.n_regionkey
      JOIN region r2 ON r2.r_regionkey = (n.n_regionkey + 1) % 5,
      LATERAL (SELECT replace(r2.r_name, ' ', '-') || '/' || ['default', 'gpu', 'spot'][c.c_custkey % 3 + 1] AS pool) p)""",
    """mbody AS (SELECT c_custkey, CASE shape WHEN 4 THEN left(full_body, 30) WHEN 6 THEN NULL WHEN 7 THEN '[1]' ELSE full_body END AS body FROM mtext)""",
    """mjson AS (SELECT c_custkey, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM mbody)""",
    """mfield AS (SELECT c_custkey, j, json_type(j) = 'OBJECT' AS object, json_extract_string(j, '$.request_id') AS request_id,
        json_extract_string(j, '$.target_pool') AS target_pool,
        json_type(j, '$.idc') AS idc_type, json_type(j, '$.candidate_pools') AS pools_type,
        CASE json_type(j, '$.idc') WHEN 'VARCHAR' THEN string_split(json_extract_string(j, '$.idc'), ',')
             WHEN 'ARRAY' THEN list_filter(json_extract_string(j, '$.idc[*]'), lambda x: x IS NOT NULL) ELSE [] END AS idc_items,
        CASE json_type(j, '$.candidate_pools') WHEN 'VARCHAR' THEN string_split(json_extract_string(j, '$.candidate_pools'), ',')
             WHEN 'ARRAY' THEN json_extract_string(j, '$.candidate_pools[*]') ELSE [] END AS pool_items,
        json_type(j, '$.candidate_pools') = 'ARRAY' AND len(list_filter(json_extract(j, '$.candidate_pools[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 AS bad_item
      FROM mjson)""",
    """mreq AS (SELECT c_custkey, request_id, target_pool, object,
        CASE WHEN idc_type IN ('VARCHAR', 'ARRAY') THEN list_transform(idc_items, lambda x: trim(x)) ELSE [] END AS sites,
        CASE WHEN bad_item THEN [] ELSE list_transform(pool_items, lambda x: trim(x)) END AS candidates,
        CASE WHEN j IS NULL THEN ['body is not JSON'] WHEN NOT object THEN ['body is not an object'] ELSE list_filter([
          CASE WHEN idc_type NOT IN ('VARCHAR', 'ARRAY') THEN 'idc is neither text nor a list of texts' END,
          CASE WHEN bad_item THEN 'candidate_pools is neither text nor a list of texts' END,
          CASE WHEN request_id IS NULL THEN 'missing request_id' END], lambda x: x IS NOT NULL) END AS faults,
        request_id IS NOT NULL AND count(*) OVER (PARTITION BY request_id) > 1 AS again
      FROM mfield)""",
    """mlist AS (SELECT *, list_filter(list_transform(candidates,
            lambda x: regexp_replace(x, '^([^/]*?) */ *([^/]*)$', '\\1/\\2')), lambda x: x <> '') AS l FROM mreq)""",
)
TYPED_REQUESTS = _with(*MIXED_CTES) + """SELECT c_custkey, request_id, array_to_string(sites, '|') AS sites, array_to_string(candidates, '|') AS candidates,
    array_to_string(list_concat(e, CASE WHEN again THEN ['repeated request_id'] ELSE [] END), '; ') AS errors,
    len(e) = 0 AND NOT again AS valid
  FROM (SELECT *, CASE WHEN len(faults) > 0 THEN faults ELSE list_filter([
      CASE WHEN len(l) = 0 THEN 'no candidate pools' END,
      CASE WHEN len(list_distinct(l)) <> len(l) THEN 'duplicate candidate pools' END,
      CASE WHEN list_contains(l, target_pool) THEN 'target among candidates' END], lambda x: x IS NOT NULL) END AS e FROM mlist)"""
TYPED_CTES = (*MIXED_CTES,
    """rl AS (SELECT request_id, target_pool AS target, CASE WHEN len(sites) > 0 THEN sites END AS sites, l
        FROM mlist WHERE len(faults) = 0 AND NOT again)""", *CANDIDATE_CTES)
CANDIDATE_BATCH_TYPED = _with(*TYPED_CTES) + CANDIDATE_SELECT
CANDIDATE_OVERLAP = _with(*TYPED_CTES, """tp AS (SELECT request_id, candidate_pool, count(DISTINCT psm) AS n
        FROM rrows WHERE pk = target GROUP BY request_id, candidate_pool)""") + """
SELECT c.request_id, c.candidate_pool, c.position, CAST(coalesce(t.n, 0) AS BIGINT) AS target_psm_count,
  CAST(coalesce(p.psm_count, 0) AS BIGINT) AS psm_count, CAST(coalesce(m.n, 0) AS BIGINT) AS matching_psm_count
FROM rc c
LEFT JOIN bm m ON m.request_id = c.request_id AND m.candidate_pool = c.candidate_pool
LEFT JOIN bp p ON p.request_id = c.request_id AND p.candidate_pool = c.candidate_pool
LEFT JOIN tp t ON t.request_id = c.request_id AND t.candidate_pool = c.candidate_pool"""
ORACLE: dict[str, str] = {
    "candidate_batch": CANDIDATE_BATCH,
    "candidate_batch_typed": CANDIDATE_BATCH_TYPED,
    "candidate_overlap": CANDIDATE_OVERLAP,
    "typed_requests": TYPED_REQUESTS,
    "recommend_batch": RECOMMEND_BATCH,
    "migratable_batch": MIGRATABLE_BATCH,
    "pool_key": _with() + f"SELECT {PK} AS pool_key, count(*) AS row_count FROM ninv GROUP BY 1",
    "filter_by_idc": _with() + """SELECT row_ord, psm, idc, physical_cluster, iaas_cluster
        FROM ninv WHERE idc IN ('BUILDING', 'MACHINERY')""",
    "filter_default": _with() + """SELECT row_ord, psm, idc, cluster_name FROM ninv
        WHERE cluster_name = 'default'""",
    "services_in_both_pools": MIG + "SELECT psm FROM both_svc",
    "lender_rank": MIG + "SELECT b.psm, l.sort_key FROM both_svc b JOIN lender_last l ON l.psm = b.psm",
    "migration_detail": MIG + f"SELECT {DETAIL_SELECT} FROM matched",
    "coerce_numbers": _with() + f"""SELECT row_ord, instance_num AS raw_instance_num,
        {num('instance_num')} AS instance_num,
        coalesce({num('instance_num')}, 0.0) AS instance_num_or_zero,
        CAST(trunc(coalesce({num('instance_num')}, 0)) AS BIGINT) AS instance_count,
        {num('save_cores')} AS save_cores FROM inv""",
    "package_present": MIG + """SELECT coalesce(bool_or(package IS NOT NULL AND package <> ''), false)
        AS package_present FROM matched""",
    "migration_summary": MIG + f"""SELECT psm, pool_identifier, package, {SUMMARY_SUMS}
        FROM matched WHERE package IS NOT NULL GROUP BY psm, pool_identifier, package""",
    "migration_summary_no_package": MIG + f"""SELECT psm, pool_identifier, {SUMMARY_SUMS}
        FROM matched GROUP BY psm, pool_identifier""",
    "migration_stats": MIG + """SELECT 'EUROPE/default' AS pool1, 'ASIA/default' AS pool2,
        count(DISTINCT psm) AS psm_count FROM matched""",
    "migration_stats_full": MIG + """SELECT 'EUROPE/default' AS pool1, 'ASIA/default' AS pool2,
        count(DISTINCT psm) AS psm_count,
        coalesce(sum(coalesce(instance_num, 0)), 0.0) AS total_instances,
        coalesce(sum(coalesce(cpu_limit, 0)), 0.0) AS total_cpu,
        coalesce(sum(coalesce(mem_limit, 0)), 0.0) AS total_memory FROM matched""",
    "migration_totals": MIG + """SELECT
        coalesce(sum(CASE WHEN pool_identifier = 'EUROPE/default' THEN coalesce(cpu_limit, 0) END), 0.0) AS movable_cpu,
        coalesce(sum(CASE WHEN pool_identifier = 'EUROPE/default' THEN coalesce(mem_limit, 0) END), 0.0) AS movable_mem,
        count(DISTINCT psm) AS service_count FROM matched""",
    "migration_role": MIG + f"""SELECT {DETAIL_SELECT},
        CASE WHEN pool_identifier = 'EUROPE/default' THEN 'lender'
             WHEN pool_identifier = 'ASIA/default' THEN 'receiver' END AS role FROM matched""",
    "top_movable_services": MIG + """SELECT b.psm, l.sort_key FROM both_svc b
        JOIN lender_last l ON l.psm = b.psm ORDER BY l.sort_key DESC, b.psm LIMIT 20""",
    "filter_pool": _with(POOL_ROWS) + """SELECT row_ord, psm, cluster_id, physical_cluster,
        iaas_cluster FROM prows""",
    "save_cores_clean": _with(POOL_ROWS) + """SELECT row_ord, psm,
        CAST(trunc(save_cores) AS BIGINT) AS save_cores FROM prows WHERE save_cores IS NOT NULL""",
    "save_cores_derived": _with("""drv AS (SELECT * REPLACE (cpu_limit - cpu_request AS save_cores)
        FROM ninv WHERE idc = 'BUILDING' AND physical_cluster = 'EUROPE' AND iaas_cluster = 'default')""")
        + recommend_sql(0, "drv"),
    "recommend_scale_down": REC + "SELECT * FROM rec",
    "recommend_min_cores": _with(POOL_ROWS) + recommend_sql(10),
    "recommend_display": REC + """SELECT psm,
        CASE WHEN coalesce(cluster_id, '') = '' THEN '-' ELSE cluster_id END AS cluster_id,
        CASE WHEN coalesce(package, '') = '' THEN '-' ELSE package END AS package,
        cpu_limit, mem_limit, save_cores,
        CASE WHEN coalesce(cpu_util_max_1days, '') = '' THEN '-' ELSE cpu_util_max_1days END AS cpu_util_max_1days,
        CASE WHEN coalesce(cpu_util_max_7days, '') = '' THEN '-' ELSE cpu_util_max_7days END AS cpu_util_max_7days,
        CASE WHEN coalesce(mem_util_max_7days, '') = '' THEN '-' ELSE mem_util_max_7days END AS mem_util_max_7days,
        CASE WHEN coalesce(business_line, '') = '' THEN '-' ELSE business_line END AS business_line,
        priority FROM rec""",
    "recommend_stats": REC + """SELECT CAST(coalesce(sum(save_cores), 0) AS BIGINT) AS total_cpu,
        count(*) AS total_clusters, count(*) FILTER (WHERE save_cores > 10) AS clusters_over_10 FROM rec""",
    "business_line": _with() + """SELECT row_ord,
        coalesce(dept_level1, '') || '/' || regexp_replace(coalesce(dept_level2, ''), '^/+|/+$', '', 'g')
        AS business_line FROM ninv""",
    "migratable_services": MS + f"SELECT {MS_COLS}, first_seen FROM ms",
    "migratable_flat": MS + f"SELECT {MS_COLS} FROM ms",
    "migratable_stats": MS + """SELECT count(*) AS total_psm,
        count(*) FILTER (WHERE deployment_status = '多资源池') AS migratable_psm,
        CAST(coalesce(sum(other_pool_cluster_count), 0) + count(*) AS BIGINT) AS total_clusters FROM ms""",
    "available_pools": MS + "SELECT DISTINCT pk AS pool FROM others",
    "migratable_top": MS + f"SELECT {MS_COLS}, first_seen FROM ms ORDER BY first_seen LIMIT 500",
    "filter_other_pools": MS + f"""SELECT {MS_COLS}, first_seen FROM ms
        WHERE contains(lower(other_pools), 'asia')""",
    "parse_candidates": _with(REQ_CTE, """items AS (SELECT request_id, target_pool, candidate_pools,
          list_filter(list_transform(string_split(coalesce(candidate_pools, ''), ','),
            lambda x: trim(regexp_replace(x, '^([^/]*?) */ *([^/]*)$', '\\1/\\2'))), lambda x: x <> '') AS l
        FROM req)""") + """SELECT request_id, target_pool,
        array_to_string(list_filter(list_distinct_ordered, lambda x: x <> trim(target_pool)), ',') AS candidates,
        CAST(len(list_filter(list_distinct_ordered, lambda x: x <> trim(target_pool))) AS INTEGER) AS candidate_count,
        CAST(CASE WHEN trim(coalesce(candidate_pools, '')) = '' THEN 0
             ELSE len(string_split(candidate_pools, ',')) END AS INTEGER) AS listed_count,
        len(l) <> len(list_distinct_ordered) AS had_duplicates,
        list_contains(l, trim(target_pool)) AS target_listed
      FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM items)""",
    "pool_stats": CAND + """SELECT pool_identifier, CAST(psm_count AS BIGINT) AS psm_count, total_instances,
        total_cpu, total_memory,
        CASE WHEN pool_identifier = 'EUROPE/default' THEN 'target' ELSE 'candidate' END AS role FROM pstats""",
    "candidate_matches": CAND + """SELECT b.candidate_pool, b.psm, l.sort_key FROM cboth b
        JOIN clast l ON l.psm = b.psm""",
    "candidate_overview": CAND + "SELECT * FROM overview",
    "candidate_summary": CAND + f"""SELECT m.candidate_pool, psm, pool_identifier,
        CASE WHEN g.pkg THEN package END AS package, {SUMMARY_SUMS}
        FROM cmatched m JOIN cgate g ON g.candidate_pool = m.candidate_pool
        WHERE NOT g.pkg OR package IS NOT NULL GROUP BY ALL""",
    "candidate_detail": CAND + f"SELECT candidate_pool, {DETAIL_SELECT} FROM cmatched",
    "candidate_detail_top": CAND + f"""SELECT candidate_pool, {DETAIL_SELECT},
        CAST(row_number() OVER (PARTITION BY candidate_pool ORDER BY sort_key DESC, psm, pool_identifier, row_ord) AS INTEGER) AS rank
        FROM cmatched QUALIFY rank <= 10""",
    "candidate_counts": CAND + """SELECT count(*) AS candidates, count(*) FILTER (WHERE has_matches) AS matched,
        count(*) FILTER (WHERE NOT has_matches) AS unmatched FROM overview""",
    "parse_requests": _with(REQ_CTE) + "SELECT * FROM req",
    "parse_pool": _with(REQ_CTE) + """SELECT request_id, pool2,
        len(string_split(trim(pool2), '/')) = 2 AS is_pair,
        CASE WHEN len(string_split(trim(pool2), '/')) = 2 THEN trim(string_split(trim(pool2), '/')[1]) END AS physical,
        CASE WHEN len(string_split(trim(pool2), '/')) = 2 THEN trim(string_split(trim(pool2), '/')[2]) END AS iaas
      FROM req""",
    "validate_pools": _with(REQ_CTE) + """SELECT request_id,
        coalesce(regexp_full_match(trim(pool1), '[A-Za-z0-9_-]+/[A-Za-z0-9_-]+'), false) AS pool1_ok,
        coalesce(regexp_full_match(trim(pool2), '[A-Za-z0-9_-]+/[A-Za-z0-9_-]+'), false) AS pool2_ok
      FROM req""",
    "validate_requests": _with(REQ_CTE) + """SELECT request_id,
        array_to_string(list_filter([
          CASE WHEN trim(coalesce(pool1, '')) = '' OR trim(coalesce(pool2, '')) = '' THEN 'missing pool' END,
          CASE WHEN trim(coalesce(pool1, '')) <> '' AND len(string_split(trim(pool1), '/')) <> 2 THEN 'pool1 is not physical/iaas' END,
          CASE WHEN trim(coalesce(pool2, '')) <> '' AND len(string_split(trim(pool2), '/')) <> 2 THEN 'pool2 is not physical/iaas' END,
          CASE WHEN trim(coalesce(pool1, '')) <> '' AND trim(coalesce(pool2, '')) <> '' AND trim(pool1) = trim(pool2) THEN 'pool1 equals pool2' END
        ], lambda x: x IS NOT NULL), '; ') AS errors,
        (trim(coalesce(pool1, '')) <> '' AND trim(coalesce(pool2, '')) <> ''
         AND len(string_split(trim(pool1), '/')) = 2 AND len(string_split(trim(pool2), '/')) = 2
         AND trim(pool1) <> trim(pool2)) AS valid
      FROM req""",
    "migration_batch": BATCH + f"SELECT request_id, {DETAIL_SELECT} FROM bmatched",
    "migration_batch_stream": BATCH + f"SELECT request_id, {DETAIL_SELECT} FROM bmatched",
    "migration_batch_summary": BATCH + f"""SELECT m.request_id, psm, pool_identifier,
        CASE WHEN g.pkg THEN package END AS package, {SUMMARY_SUMS}
        FROM bmatched m JOIN bgate g ON g.request_id = m.request_id
        WHERE NOT g.pkg OR package IS NOT NULL GROUP BY ALL""",
    "read_inventory": _with() + """SELECT psm, idc, cluster_name, cluster_id, NULLIF(package, '') AS package,
        physical_cluster, iaas_cluster, instance_num, cpu_limit, cpu_request, mem_limit, save_cores,
        NULLIF(cpu_util_max_1days, '') AS cpu_util_max_1days, cpu_util_max_7days, mem_util_max_7days,
        dept_level1, dept_level2, host_type FROM ninv""",
    "read_inventory_reordered": _with() + _REORDERED.format(package="NULLIF(package, '')"),
    "read_inventory_json": _with() + _REORDERED.format(package="NULLIF(package, '')"),
    "validate_requests_scale_down": _with(REQ_CTE) + """SELECT request_id,
        CASE WHEN trim(coalesce(idc, '')) = '' OR trim(coalesce(pool, '')) = '' THEN 'missing site or pool' ELSE '' END AS errors,
        NOT (trim(coalesce(idc, '')) = '' OR trim(coalesce(pool, '')) = '') AS valid FROM req""",
    "validate_requests_candidates": _with(REQ_CTE, """citems AS (SELECT request_id, target_pool,
          list_filter(list_transform(string_split(coalesce(candidate_pools, ''), ','),
            lambda x: trim(regexp_replace(x, '^([^/]*?) */ *([^/]*)$', '\\1/\\2'))), lambda x: x <> '') AS l FROM req)""",
        """cerrors AS (SELECT request_id, list_filter([
          CASE WHEN trim(coalesce(target_pool, '')) = '' THEN 'missing target pool' END,
          CASE WHEN len(l) = 0 THEN 'no candidate pools' END,
          CASE WHEN len(list_distinct(l)) <> len(l) THEN 'duplicate candidate pools' END,
          CASE WHEN list_contains(l, trim(target_pool)) THEN 'target among candidates' END,
          CASE WHEN len(list_filter(l, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9_-]+/[A-Za-z0-9_-]+'))) > 0 THEN 'candidate pool format' END
        ], lambda x: x IS NOT NULL) AS e FROM citems)""") + """SELECT request_id, array_to_string(e, '; ') AS errors,
        len(e) = 0 AS valid FROM cerrors""",
    "normalised_inventory": _with() + "SELECT * FROM ninv",
    "read_inventory_mixed": _with() + """SELECT psm, idc, cluster_name, CASE WHEN ln <= 2 THEN cluster_name ELSE cluster_id END AS cluster_id,
        NULLIF(package, '') AS package, physical_cluster, iaas_cluster, instance_num, cpu_limit, cpu_request, mem_limit,
        CASE WHEN ln <= 2 THEN cpu_limit - cpu_request ELSE save_cores END AS save_cores,
        CASE WHEN ln > 2 THEN NULLIF(cpu_util_max_1days, '') END AS cpu_util_max_1days,
        CASE WHEN ln > 2 THEN cpu_util_max_7days END AS cpu_util_max_7days, mem_util_max_7days,
        CASE WHEN ln > 2 THEN dept_level1 END AS dept_level1, CASE WHEN ln IN (3, 4) THEN dept_level2 END AS dept_level2,
        CASE WHEN ln > 2 THEN host_type END AS host_type FROM (SELECT *, row_ord // 1000 % 10 AS ln FROM ninv)""",
    "search_inventory": _with() + """SELECT row_ord, psm, cluster_id, idc, physical_cluster, iaas_cluster FROM ninv
        WHERE contains(lower(coalesce(psm, '') || ' ' || coalesce(cluster_id, '') || ' ' || coalesce(idc, '')), 'svc.77')
        AND contains(lower(coalesce(psm, '') || ' ' || coalesce(cluster_id, '') || ' ' || coalesce(idc, '')), 'build')""",
    "search_rows": MIG + f"""SELECT * FROM (SELECT {DETAIL_SELECT} FROM matched) d
        WHERE contains(lower(concat_ws(' ', coalesce(psm, ''), coalesce(pool_identifier, ''), coalesce(package, ''),
          coalesce(physical_cluster, ''), coalesce(iaas_cluster, ''), coalesce(CAST(instance_num AS STRING), ''),
          coalesce(CAST(cpu_limit AS STRING), ''), coalesce(CAST(mem_limit AS STRING), ''),
          coalesce(cluster_name, ''), coalesce(dept_level1, ''), coalesce(dept_level2, ''),
          coalesce(host_type, ''), coalesce(idc, ''), coalesce(CAST(sort_key AS STRING), ''))), 'brand#1')
        AND contains(lower(concat_ws(' ', coalesce(psm, ''), coalesce(pool_identifier, ''), coalesce(package, ''),
          coalesce(physical_cluster, ''), coalesce(iaas_cluster, ''), coalesce(CAST(instance_num AS STRING), ''),
          coalesce(CAST(cpu_limit AS STRING), ''), coalesce(CAST(mem_limit AS STRING), ''),
          coalesce(cluster_name, ''), coalesce(dept_level1, ''), coalesce(dept_level2, ''),
          coalesce(host_type, ''), coalesce(idc, ''), coalesce(CAST(sort_key AS STRING), ''))), 'europe')""",
    "page_rows": _with(POOL_ROWS) + """SELECT row_ord, psm, cluster_id, cpu_limit FROM prows
        ORDER BY cpu_limit DESC NULLS LAST, row_ord LIMIT 25 OFFSET 25""",
    "page_rows_middle": _with() + """SELECT row_ord, psm, cluster_id, cpu_limit, page_rank FROM (
        SELECT *, row_number() OVER (ORDER BY cpu_limit DESC NULLS LAST, row_ord) - 1 AS page_rank, count(*) OVER () AS n FROM ninv)
        WHERE page_rank // 25 = n // 2 // 25""",
    "format_numbers": MIG + f"""SELECT psm, pool_identifier, package, sort_key,
        {_fmt('instance_num')}, {_fmt('cpu_limit')}, {_fmt('mem_limit')}
      FROM (SELECT psm, pool_identifier, package, {SUMMARY_SUMS}
            FROM matched WHERE package IS NOT NULL GROUP BY psm, pool_identifier, package)""",
    "pad_rows": _with(POOL_ROWS) + """SELECT row_ord, CAST(i AS INTEGER) AS pad_index,
        CASE WHEN i = 0 THEN psm END AS psm, CASE WHEN i = 0 THEN cluster_id END AS cluster_id,
        CASE WHEN i = 0 THEN cpu_limit END AS cpu_limit
      FROM prows, range(0, 3) t(i)""",
    "records_json": REC + """SELECT to_json({'psm': psm, 'package': package, 'save_cores': save_cores,
        'mem_util_max_7days': mem_util_max_7days}) AS record FROM rec""",
    "csv_export": REC + """SELECT psm,
        CASE WHEN coalesce(cluster_id, '') = '' THEN '-' ELSE cluster_id END AS cluster_id,
        CASE WHEN coalesce(package, '') = '' THEN '-' ELSE package END AS package,
        CAST(cpu_limit AS STRING) AS cpu_limit, CAST(mem_limit AS STRING) AS mem_limit,
        CAST(save_cores AS STRING) AS save_cores,
        CASE WHEN coalesce(cpu_util_max_1days, '') = '' THEN '-' ELSE cpu_util_max_1days END AS cpu_util_max_1days,
        CASE WHEN coalesce(cpu_util_max_7days, '') = '' THEN '-' ELSE cpu_util_max_7days END AS cpu_util_max_7days,
        CASE WHEN coalesce(mem_util_max_7days, '') = '' THEN '-' ELSE mem_util_max_7days END AS mem_util_max_7days,
        CASE WHEN coalesce(business_line, '') = '' THEN '-' ELSE business_line END AS business_line,
        CAST(priority AS STRING) AS priority FROM rec""",
    "report_tables": MIG + """SELECT 'summary' AS table_name, count(*) AS row_count FROM
          (SELECT 1 FROM matched WHERE package IS NOT NULL GROUP BY psm, pool_identifier, package)
        UNION ALL SELECT 'detail', count(*) FROM matched
        UNION ALL SELECT 'stats', 1""",
    "published_report": MIG + """SELECT table_name, row_count, row_count AS listed_count FROM (SELECT 'summary' AS table_name, count(*) AS row_count FROM
          (SELECT 1 FROM matched WHERE package IS NOT NULL GROUP BY psm, pool_identifier, package)
        UNION ALL SELECT 'detail', count(*) FROM matched
        UNION ALL SELECT 'stats', 1)""",
    "candidate_report": CAND + f"""SELECT 'summary' AS table_name, candidate_pool, count(*) AS row_count
        FROM (SELECT m.candidate_pool, psm, pool_identifier, CASE WHEN g.pkg THEN package END AS package
              FROM cmatched m JOIN cgate g ON g.candidate_pool = m.candidate_pool
              WHERE NOT g.pkg OR package IS NOT NULL GROUP BY ALL) GROUP BY candidate_pool
        UNION ALL SELECT 'detail', candidate_pool, count(*) FROM cmatched GROUP BY candidate_pool""",
    "report_notes": REC + """SELECT * FROM (VALUES ('analysis_time', '2024-01-01 00:00:00'),
          ('idc', 'BUILDING'), ('pool', 'EUROPE/default')) t(item, value)
        UNION ALL SELECT 'total_cpu', CAST(CAST(coalesce(sum(save_cores), 0) AS BIGINT) AS STRING) FROM rec
        UNION ALL SELECT 'total_clusters', CAST(count(*) AS STRING) FROM rec
        UNION ALL SELECT 'clusters_over_10', CAST(count(*) FILTER (WHERE save_cores > 10) AS STRING) FROM rec""",
}
ORACLE["search_indexed"] = ORACLE["search_rows"]
