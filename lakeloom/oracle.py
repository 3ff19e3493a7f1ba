"""The registered queries' results as DuckDB SQL over the parquet tables.

Each entry mirrors ``lakeloom.queries``: the stand-in derivations of
``lakeloom.standins`` (envelopes, lookups, tree, grant log) are written again
here as CTEs, and the staged runs' fixed clocks appear as constants.
"""

from __future__ import annotations

# Stand-in envelopes of the events table (see standins.envelopes).
_ENV = r"""
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
env AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, ts, user_id, event_type, value, k,
         CASE WHEN event_type = 'purchase' THEN 'aws.s3' ELSE 'aws.datazone' END AS source,
         CASE WHEN event_type IN ('view', 'click') THEN 'Asset Added To Catalog'
              WHEN event_type = 'signup' THEN 'Metadata Generation Accepted'
              WHEN event_type = 'purchase' THEN 'Object Created'
              ELSE 'Asset Removed' END AS detail_type,
         'user-' || user_id AS md_user,
         'asset-' || (k // 20) AS md_id,
         CASE WHEN k < 90 THEN 'dzd-home' ELSE 'dzd-far' END AS domain,
         'prj-' || user_id AS owning_project,
         CASE WHEN event_type <> 'error' THEN 'asset-' || (4 - k // 20) END AS data_asset,
         CASE WHEN event_type <> 'error' THEN 'user-' || (user_id + 1000) END AS data_user,
         CASE WHEN event_type = 'purchase'
              THEN CASE WHEN value > 50 THEN 'landing-raw' ELSE 'landing-other' END END AS bucket
  FROM base
),
ext AS (
  SELECT *,
         CASE detail_type WHEN 'Asset Added To Catalog' THEN md_user
                          WHEN 'Metadata Generation Accepted' THEN data_user END AS user_id_x,
         CASE detail_type WHEN 'Asset Added To Catalog' THEN data_asset
                          WHEN 'Metadata Generation Accepted' THEN md_id END AS asset_id,
         detail_type IN ('Asset Added To Catalog', 'Metadata Generation Accepted') AS known
  FROM env
)"""

# Lookups (see standins.projects / units / domains / assets).
_LOOKUPS = r"""
projects AS (SELECT 'dzd-home' AS domain_id, 'prj-' || c_custkey AS id, c_name AS name,
                    'unit-' || c_nationkey AS unit_id FROM customer),
units AS (SELECT 'dzd-home' AS domain_id, 'unit-' || n_nationkey AS id, n_name AS name FROM nation),
domains AS (SELECT 'dzd-home' AS id, 'Home Domain' AS name),
assets AS (SELECT 'dzd-home' AS domain_id, 'asset-' || r_regionkey AS id, r_name AS name,
                  '1' AS revision, r_regionkey FROM region),
enriched AS (
  SELECT x.*, p.name AS project_name, u.name AS domain_unit_name, d.name AS domain_name,
         a.name AS asset_name, a.revision AS asset_revision, a.r_regionkey,
         concat_ws(',', CASE WHEN p.id IS NULL THEN 'project' END,
                        CASE WHEN u.id IS NULL THEN 'domain_unit' END,
                        CASE WHEN d.id IS NULL THEN 'domain' END,
                        CASE WHEN a.id IS NULL THEN 'asset' END) AS missing
  FROM (SELECT * FROM ext WHERE source = 'aws.datazone' AND domain = 'dzd-home') x
  LEFT JOIN projects p ON x.domain = p.domain_id AND x.owning_project = p.id
  LEFT JOIN units u ON x.domain = u.domain_id AND p.unit_id = u.id
  LEFT JOIN domains d ON x.domain = d.id
  LEFT JOIN assets a ON x.domain = a.domain_id AND x.asset_id = a.id
),
good AS (SELECT * FROM enriched WHERE known AND missing = '')"""

# Unit tree (see standins.tree_edges) and its closure.
_TREE = r"""
edges AS (
  SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
),
walk(node, ancestor, depth) AS (
  SELECT node, node, 0 FROM edges
  UNION ALL
  SELECT w.node, e.parent, w.depth + 1 FROM walk w JOIN edges e ON w.ancestor = e.node
  WHERE e.parent IS NOT NULL
)"""

# Numbers of a tour that takes a node before its children, leaves first.
_INTERVALS = r"""
sizes AS (SELECT ancestor AS node, count(*) AS size FROM walk GROUP BY ancestor),
kids AS (
  SELECT node, size, coalesce(sum(size) OVER (PARTITION BY parent ORDER BY size > 1, node
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM edges JOIN sizes USING (node)
),
iv AS (
  SELECT w.node, CAST(sum(k.earlier) + max(w.depth) AS BIGINT) AS lo
  FROM walk w JOIN kids k ON k.node = w.ancestor GROUP BY w.node
),
intervals AS (SELECT node, lo, lo + size AS hi FROM iv JOIN sizes USING (node))"""

# Grant change log (see standins.grant_requests) folded to the current state.
_GRANTS = r"""
greq AS (
  SELECT e.event_id AS request_id, e.ts,
         CASE WHEN e.event_type = 'error' THEN 'Delete'
              WHEN e.event_type = 'view' THEN 'Update' ELSE 'Create' END AS RequestType,
         'dzd-home' AS DomainIdentifier,
         CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) >= 70
              THEN 'r' || n.n_regionkey ELSE 'n' || c.c_nationkey END AS EntityIdentifier,
         'DOMAIN_UNIT' AS EntityType,
         CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) >= 95 THEN 'MANAGE_EVERYTHING'
              WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) < 35 THEN 'CREATE_PROJECT'
              ELSE 'ADD_TO_PROJECT_MEMBER_POOL' END AS PolicyType,
         CASE WHEN e.event_type = 'signup' THEN 'IAM_GROUP' ELSE 'IAM_ROLE' END AS PrincipalType,
         'role-' || (e.user_id // 10) AS PrincipalArn,
         CASE WHEN e.value >= 50 THEN 'true' ELSE 'false' END AS IncludeChildDomainUnits
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
gkind AS (
  SELECT *,
         CASE WHEN PrincipalType IN ('IAM_USER', 'IAM_ROLE') AND PolicyType <> 'CREATE_ENVIRONMENT_PROFILE'
                THEN 'user'
              WHEN PrincipalType = 'IAM_GROUP' THEN 'group'
              WHEN PrincipalType = 'root' THEN 'all_users'
              WHEN PolicyType IN ('CREATE_ENVIRONMENT_PROFILE', 'CREATE_ENVIRONMENT') THEN 'project'
         END AS principal_kind
  FROM greq
),
gvalid AS (
  SELECT *, RequestType IN ('Create', 'Update', 'Delete')
            AND PolicyType IN ('CREATE_PROJECT', 'ADD_TO_PROJECT_MEMBER_POOL', 'CREATE_GLOSSARY',
                               'CREATE_FORM_TYPE', 'CREATE_ASSET_TYPE', 'CREATE_ENVIRONMENT_PROFILE',
                               'CREATE_ENVIRONMENT', 'CREATE_ENVIRONMENT_FROM_BLUEPRINT',
                               'CREATE_PROJECT_FROM_PROJECT_PROFILE')
            AND principal_kind IS NOT NULL AS valid
  FROM gkind
),
granked AS (
  SELECT *, row_number() OVER (
    PARTITION BY DomainIdentifier, EntityIdentifier, EntityType, PolicyType, principal_kind, PrincipalArn
    ORDER BY ts DESC, request_id DESC) AS rn
  FROM gvalid WHERE valid
),
grants AS (
  SELECT DomainIdentifier, EntityIdentifier, EntityType, PolicyType, principal_kind, PrincipalArn,
         request_id, RequestType, IncludeChildDomainUnits = 'true' AS include_child
  FROM granked WHERE rn = 1 AND RequestType <> 'Delete'
)"""

_DROP_DAY = "CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 5 ELSE 6 END"

ORACLE = {
    "status_revenue": """
SELECT o_orderstatus AS status, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY o_orderstatus""",

    "ingest_stamp": """
SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       '2024-03-05 07:08:09' AS upload_time, 2024 AS year, 3 AS month, 5 AS day
FROM orders""",

    "ingest_incremental": f"""
SELECT o_orderkey, {_DROP_DAY} AS day FROM orders""",

    "ingest_modified": """
SELECT s_suppkey, s_name, 5 AS day FROM supplier
UNION ALL
SELECT s_suppkey, s_name || '-v2', 6 FROM supplier WHERE s_nationkey >= 12""",

    "ingest_retry": """
SELECT s_suppkey, s_name, CAST(1709622489 AS BIGINT) AS batch_id, 5 AS day FROM supplier""",

    "ingest_header_drift": """
SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey >= 12 THEN s_acctbal END AS s_acctbal
FROM supplier""",

    "ingest_chunks": """
SELECT s_suppkey, s_name, true AS in_call FROM supplier""",

    "ingest_retry_rewritten": """
SELECT s_suppkey, CASE WHEN s_nationkey >= 12 THEN s_name || '-v2' ELSE s_name END AS s_name,
       CASE WHEN s_nationkey >= 12 THEN 6 ELSE 5 END AS day FROM supplier""",

    "ingest_source_deleted": """
SELECT s_suppkey, s_name, 5 AS day FROM supplier WHERE s_nationkey < 12""",

    "ingest_header_rules": """
SELECT s_suppkey, s_name, CASE WHEN s_nationkey >= 12 THEN s_nationkey END AS s_nationkey, 2024 AS year FROM supplier""",

    "ingest_two_writers": """
SELECT s_suppkey, s_name, CAST(1709622489 AS BIGINT) AS batch_id, TRUE AS fenced, CAST(2 AS BIGINT) AS first_token,
       CAST(2 AS BIGINT) AS last_token, CAST(3 AS BIGINT) AS n_commits FROM supplier""",

    "deliver_chunked": """
SELECT s_suppkey AS supplier_id, s_name AS supplier FROM supplier""",

    "deliver_after_retry": """
SELECT s_suppkey AS supplier_id, s_name AS supplier, '2024-03-06' AS run_date FROM supplier""",

    "stream_ingest_manifest": """
SELECT s_suppkey, s_name, CASE WHEN s_nationkey >= 12 THEN 6 ELSE 5 END AS day FROM supplier""",

    "stream_deliver": """
SELECT s_suppkey AS supplier_id, s_name AS supplier, unnest(['2024-03-05', '2024-03-06']) AS run_date FROM supplier""",

    "date_parts": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(day(o_orderdate) AS INTEGER) AS day, count(*) AS n_orders
FROM orders GROUP BY 1, 2, 3""",

    "mapper_project": """
SELECT c_custkey AS customer_id, c_name, c_mktsegment AS segment, c_acctbal AS balance FROM customer""",

    "asset_discovery": r"""
SELECT 'sql_asset' AS kind, lower(regexp_replace(n_name, '\s+', '', 'g')) AS project,
       lower(s_name) AS entity
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'mapper', lower(regexp_replace(n_name, '\s+', '_', 'g')), CAST(NULL AS VARCHAR) FROM nation""",

    "sql_asset_run": """
SELECT r.r_name AS region, count(*) AS n_customers, round(sum(c.c_acctbal), 2) AS total_sales,
       sum(CASE WHEN c.c_mktsegment <> 'NONE' THEN 1 ELSE 0 END) AS n_segmented
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name""",

    "register_table": f"""
SELECT 2024 AS year, 3 AS month, {_DROP_DAY} AS day, count(*) AS n_orders,
       count(DISTINCT o_custkey) AS n_customers, 'bigint' AS key_type, 'double' AS price_type, 'string' AS status_type
FROM orders GROUP BY 1, 2, 3""",

    "register_mixed": """
SELECT 'f0' AS family, s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS extra,
       CASE WHEN s_nationkey >= 12 THEN s_acctbal END AS balance, CASE WHEN s_nationkey >= 12 THEN 6 ELSE 5 END AS day FROM supplier
UNION ALL
SELECT 'f1', c_custkey, c_name, c_mktsegment, NULL, 5 FROM customer""",

    "register_types": """
WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1998-01-01' AS second FROM orders)
SELECT o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS zip, '9000000000' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS long_id,
       '+34600' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS phone, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on,
       CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END AS flag, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price,
       o_custkey || CASE WHEN second THEN '.5' ELSE '.0' END AS amount,
       CASE WHEN second THEN 'n' ELSE '' END || o_custkey AS later_text, o_orderpriority AS note,
       'bigint,string,decimal(38,0),string,date,boolean,decimal(38,2),double,string,string' AS kinds
FROM o""",

    "event_match": f"""
WITH {_ENV}
SELECT id, detail_type, domain FROM env
WHERE source = 'aws.datazone'
  AND detail_type IN ('Asset Added To Catalog', 'Metadata Generation Accepted')
  AND domain = 'dzd-home'""",

    "event_route": f"""
WITH {_ENV}
SELECT id, 'asset-metadata' AS rule_name, 'Lambda' AS service, 'invokeLambdaFunction' AS action,
       TRUE AS supported
FROM env WHERE source = 'aws.datazone'
  AND detail_type IN ('Asset Added To Catalog', 'Metadata Generation Accepted') AND domain = 'dzd-home'
UNION ALL
SELECT id, 'sql-asset-landing', 'Glue', 'startWorkflowRun', TRUE
FROM env WHERE source = 'aws.s3' AND detail_type = 'Object Created' AND bucket = 'landing-raw'
UNION ALL
SELECT id, 'sql-asset-landing', 'SNS', 'publish', FALSE
FROM env WHERE source = 'aws.s3' AND detail_type = 'Object Created' AND bucket = 'landing-raw'
UNION ALL
SELECT id, 'other-landing', 'Glue', 'startWorkflowRun', TRUE
FROM env WHERE source = 'aws.s3' AND detail_type = 'Object Created' AND bucket = 'landing-other'""",

    "event_route_many": f"""
WITH {_ENV}
SELECT id, 'domain-' || c_custkey AS rule_name, 'fn-' || c_nationkey AS target
FROM env JOIN customer ON user_id = c_custkey
WHERE source = 'aws.datazone' AND c_custkey % 7 <> 0
  AND (detail_type = 'Asset Added To Catalog' OR (detail_type = 'Metadata Generation Accepted' AND c_custkey % 2 = 1))
UNION ALL
SELECT id, 'bucket-' || c_custkey, 'fn-' || c_nationkey FROM env JOIN customer ON user_id = c_custkey
WHERE source = 'aws.s3' AND c_custkey % 5 = 0
UNION ALL
SELECT id, 'every-' || c_custkey, 'fn-' || c_nationkey FROM env JOIN customer ON c_custkey IN (100, 200, 300)
WHERE source = 'aws.s3' AND detail_type = 'Object Created'""",

    "event_extract": f"""
WITH {_ENV}
SELECT id, detail_type, user_id_x AS user_id, asset_id, owning_project AS project_id, known FROM ext""",

    "asset_enrich": f"""
WITH {_ENV}, {_LOOKUPS}
SELECT id, project_name, domain_unit_name, domain_name, asset_name, asset_revision, missing
FROM enriched""",

    "dictionary_rows": """
SELECT DISTINCT 'Part ' || p_partkey AS asset_name, 'shipped_' || year(l_shipdate) AS column_name,
       'Shipped in ' || year(l_shipdate) AS description
FROM part JOIN lineitem ON l_partkey = p_partkey""",

    "latest_export": """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""",

    "notification_rows": f"""
WITH {_ENV}, {_LOOKUPS}
SELECT id AS event_id, 'Asset Metadata Download Notification' AS subject,
       'dictionary-exports' AS bucket,
       'dictionary/domain_name=' || replace(domain_name, '#', '%23') || '/domain_unit_name=' || replace(domain_unit_name, '#', '%23')
         || '/project_name=' || replace(project_name, '#', '%23') || '/asset_name=' || replace(asset_name, '#', '%23') || '/' AS key,
       strftime(ts + INTERVAL 86400 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS expires_at
FROM good""",

    "member_resolve": """
WITH m AS (
  SELECT c_custkey AS member, 'prj-' || c_nationkey AS project,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'PROJECT_OWNER'
              ELSE 'PROJECT_CONTRIBUTOR' END AS designation,
         CASE WHEN c_acctbal >= 5000 THEN 'key-' || c_nationkey END AS pk,
         CASE WHEN c_acctbal >= 0 THEN 'user-' || c_custkey END AS uid,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'group-' || c_nationkey END AS groupIdentifier
  FROM customer),
u AS (SELECT 'key-' || n_nationkey AS user_key, 'uid-' || n_name AS user_id
      FROM nation WHERE n_regionkey <> 0),
r AS (
  SELECT m.*, CASE WHEN pk IS NOT NULL THEN u.user_id ELSE uid END AS resolved_user,
         (pk IS NOT NULL AND u.user_id IS NULL) AS unknown_key
  FROM m LEFT JOIN u ON m.pk = u.user_key)
SELECT member, project, designation, resolved_user, groupIdentifier, unknown_key FROM r
WHERE resolved_user IS NOT NULL OR groupIdentifier IS NOT NULL""",

    "entity_fan_out": r"""
WITH e AS (
  SELECT n.n_name AS parent_unit, c.c_name AS unit, c.c_name || ' data feed' AS project,
         s.kind AS entity_type, 'source-' || lower(c.c_name) || '-' || s.kind AS source_bucket
  FROM (SELECT DISTINCT o_custkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g')) AS kind FROM orders) s
  JOIN customer c ON s.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT parent_unit, unit, project, entity_type, source_bucket, 'cron(30 3 * * ? *)' AS schedule,
       lower(regexp_replace(parent_unit, '\s+', '', 'g')) || '/' ||
         lower(regexp_replace(unit, '\s+', '', 'g')) || '/' || entity_type AS entity_path,
       lower(regexp_replace('target-' || source_bucket, 'source-', '')) AS target_bucket,
       lower(regexp_replace(project, '\s+', '', 'g')) || '_pub_db' AS database,
       entity_type || '_' AS table_prefix,
       lower(regexp_replace(project, '\s+', '_', 'g')) AS project_key
FROM e""",

    "hierarchy_closure": f"""
WITH RECURSIVE {_TREE}
SELECT node, ancestor, depth FROM walk""",

    "grant_fan_out": """
SELECT 'unit-' || c_custkey AS unit_id, r.principal, r.policy_type, r.include_child
FROM customer CROSS JOIN (VALUES
  ('role-admin', 'CREATE_PROJECT', TRUE),
  ('role-admin', 'ADD_TO_PROJECT_MEMBER_POOL', FALSE),
  ('role-analyst', 'ADD_TO_PROJECT_MEMBER_POOL', FALSE),
  ('role-steward', 'ADD_TO_PROJECT_MEMBER_POOL', FALSE)) AS r(principal, policy_type, include_child)""",

    "grant_state": f"""
WITH {_GRANTS.strip()}
SELECT * FROM grants""",

    "grant_effective": f"""
WITH RECURSIVE {_TREE}, {_GRANTS.strip()}
SELECT w.node, g.PolicyType, g.principal_kind, count(*) AS n_grants, count(*) FILTER (w.depth = 0) AS n_direct
FROM walk w JOIN grants g ON w.ancestor = g.EntityIdentifier
WHERE g.include_child OR w.depth = 0
GROUP BY w.node, g.PolicyType, g.principal_kind""",

    "grant_listing": f"""
WITH RECURSIVE {_TREE}, {_INTERVALS.strip()}, {_GRANTS.strip()}
SELECT 'node' AS kind, node AS entity, NULL AS PolicyType, NULL AS principal_kind, NULL AS PrincipalArn,
       CAST(NULL AS BOOLEAN) AS include_child, lo, hi FROM intervals
UNION ALL
SELECT 'grant', EntityIdentifier, PolicyType, principal_kind, PrincipalArn, include_child, lo,
       CASE WHEN include_child THEN hi ELSE lo + 1 END
FROM grants JOIN intervals ON node = EntityIdentifier""",

    "grant_lookup": f"""
WITH RECURSIVE {_TREE}, {_GRANTS.strip()},
asked AS (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation
          UNION ALL SELECT 'c' || min(c_custkey) FROM customer GROUP BY c_nationkey)
SELECT node, g.EntityIdentifier AS entity, g.PolicyType, g.principal_kind, g.PrincipalArn, g.include_child
FROM walk w JOIN asked USING (node) JOIN grants g ON w.ancestor = g.EntityIdentifier
WHERE g.include_child OR w.depth = 0""",

    "hierarchy_deep": """
WITH RECURSIVE edges AS (
  SELECT 'c' || c_custkey AS node, CASE WHEN c_custkey > 5 THEN 'c' || (c_custkey - 5) END AS parent FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
),
down(node, root, depth) AS (
  SELECT node, node, 0 FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.node, d.root, d.depth + 1 FROM down d JOIN edges e ON e.parent = d.node
)
SELECT node, root, depth FROM down""",

    "grant_rejects": f"""
WITH {_GRANTS.strip()}
SELECT request_id, PolicyType, PrincipalType FROM gvalid WHERE NOT valid""",

    "retention_keep": """
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - INTERVAL 90 DAY""",

    "retention_rows": """
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY""",

    "deliver_entity": """
SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total_price,
       CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN '2024-03-05' ELSE '2024-03-06' END AS run_date
FROM orders""",

    "names": r"""
SELECT 'part' AS kind, p_partkey AS id,
       lower(regexp_replace(p_name, '\s+', '_', 'g')) AS snake,
       lower(regexp_replace(p_name, '\s+', '', 'g')) AS squash,
       lower(regexp_replace(p_brand, '\s+', '', 'g')) || '_pub_db' AS database,
       lower(regexp_replace('target-source-' || p_type || '-source-' || p_name, 'source-', '')) AS target,
       split_part(p_brand || '|' || p_type, '|', 2) AS second
FROM part
UNION ALL
SELECT 'supplier', s_suppkey,
       lower(regexp_replace(s_name, '\s+', '_', 'g')),
       lower(regexp_replace(s_name, '\s+', '', 'g')),
       lower(regexp_replace(s_name, '\s+', '', 'g')) || '_pub_db',
       lower(regexp_replace('target-' || s_name, 'source-', '')),
       split_part(s_name || '|' || CAST(s_nationkey AS VARCHAR), '|', 2)
FROM supplier""",

    "object_path": """
SELECT page_id, split_part(url, '/', 3) AS bucket,
       array_to_string(string_split(url, '/')[4:], '/') AS key
FROM pages""",

    "ingest_rejects": """
SELECT s_suppkey, s_name, 5 AS n_fields FROM supplier WHERE s_nationkey >= 20""",

    "asset_rejects": f"""
WITH {_ENV}, {_LOOKUPS}
SELECT id AS event_id,
       CASE WHEN NOT known THEN 'unknown type: ' || detail_type
            WHEN missing <> '' THEN 'missing: ' || missing END AS reject_reason
FROM enriched WHERE NOT known OR missing <> ''""",

    "stream_ingest": """
SELECT o_orderkey, o_orderstatus, '2024-03-05 07:08:09' AS upload_time FROM orders""",

    "stream_assets": f"""
WITH {_ENV}, {_LOOKUPS},
keys AS (SELECT DISTINCT domain_name, domain_unit_name, project_name, asset_name, r_regionkey FROM good)
SELECT k.domain_name, k.domain_unit_name, k.project_name, k.asset_name, n.n_name AS column_name,
       'Nation ' || n.n_nationkey AS description
FROM keys k JOIN nation n ON n.n_regionkey = k.r_regionkey""",

    "stream_assets_late": f"""
WITH {_ENV}, {_LOOKUPS}
SELECT domain_name, domain_unit_name, project_name, asset_name, id AS event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
       CAST((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS INTEGER) AS n_columns
FROM (SELECT *, row_number() OVER (PARTITION BY domain_name, domain_unit_name, project_name, asset_name
                                   ORDER BY ts DESC, id DESC) AS rn FROM good) WHERE rn = 1""",
}
