"""The queries as plain SQL over the given tables, for comparison with another engine."""

from __future__ import annotations

from argweave.plans.defects import CYCLE

COMMERCE = """
lines AS (
  SELECT l_orderkey AS okey, l_linenumber AS line, l_suppkey AS supp, l_returnflag = 'R' AS returned,
         CASE WHEN l_returnflag = 'R' THEN 'O' ELSE 'E' END AS side,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, o_custkey AS cust
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
),
deliveries AS (
  SELECT okey, line, supp, side, cust, sum(cents) AS part FROM lines GROUP BY okey, line, supp, side, cust
),
order_lines AS (SELECT okey, line, cust, sum(part) AS part FROM deliveries GROUP BY okey, line, cust),
order_sums AS (SELECT okey, cust, sum(part) AS part FROM order_lines GROUP BY okey, cust),
customer_sums AS (SELECT cust, sum(part) AS part FROM order_sums GROUP BY cust),
graphs AS (
  SELECT CAST(c_custkey AS INTEGER) AS id, 'customer-' || c_custkey AS slug, c_name AS title,
         c_mktsegment AS description
  FROM customer
),
nodes AS (
  SELECT 'R' || c_custkey AS id, CAST(c_custkey AS INTEGER) AS graph_id, 'root' AS kind, c_name AS title,
         c_mktsegment AS body_text, CAST(NULL AS VARCHAR) AS category, [c_mktsegment, 'root'] AS tags,
         CAST(c_custkey % 101 / 100.0 AS DECIMAL(6,5)) AS prior, CAST(NULL AS DECIMAL(6,5)) AS weight,
         CAST(NULL AS DECIMAL(6,5)) AS confidence, CAST(1 AS DECIMAL(6,5)) AS importance,
         CAST(NULL AS VARCHAR) AS evidence_type, CAST(NULL AS DOUBLE) AS evidence_score,
         CAST(NULL AS VARCHAR) AS evidence_rationale
  FROM customer
  UNION ALL
  SELECT 'C' || o_orderkey, CAST(o_custkey AS INTEGER), 'claim', 'Order ' || o_orderkey, o_orderpriority,
         o_orderpriority, [o_orderstatus], CAST(o_orderkey % 101 / 100.0 AS DECIMAL(6,5)), NULL, NULL,
         CAST(o_orderkey % 97 / 100.0 AS DECIMAL(6,5)), NULL, NULL, NULL
  FROM orders
  UNION ALL
  SELECT 'P' || okey || '-' || line, CAST(cust AS INTEGER), 'premise', 'Line ' || line || ' of order ' || okey,
         'Line ' || line || ' of order ' || okey, NULL, [], CAST((okey + line) % 101 / 100.0 AS DECIMAL(6,5)), NULL,
         CAST((okey * 7 + line) % 101 / 100.0 AS DECIMAL(6,5)), NULL, NULL, NULL, NULL
  FROM order_lines
  UNION ALL
  SELECT side || cust || '-' || supp, CAST(cust AS INTEGER), CASE WHEN side = 'E' THEN 'evidence' ELSE 'counter' END,
         'Deliveries by supplier ' || supp || ' to customer ' || cust,
         'Deliveries by supplier ' || supp || ' to customer ' || cust, NULL, [],
         CAST(supp % 101 / 100.0 AS DECIMAL(6,5)), NULL,
         CASE WHEN side = 'O' THEN CAST(supp % 101 / 100.0 AS DECIMAL(6,5)) END, NULL,
         CASE WHEN side = 'E' THEN 'observational' END, CASE WHEN side = 'E' THEN supp % 101 / 100.0 END, NULL
  FROM (SELECT DISTINCT side, cust, supp FROM deliveries)
),
edges AS (
  SELECT 'E-' || okey AS id, CAST(cust AS INTEGER) AS graph_id, 'C' || okey AS from_node_id,
         'R' || cust AS to_node_id, 'support' AS kind,
         CAST(o.part * 100000 // c.part / 100000.0 AS DECIMAL(6,5)) AS weight,
         CAST(NULL AS DECIMAL(6,5)) AS confidence, CAST(1 AS SMALLINT) AS polarity,
         CAST(NULL AS VARCHAR) AS rationale
  FROM order_sums o JOIN customer_sums c USING (cust)
  UNION ALL
  SELECT 'E-' || okey || '-' || line, CAST(l.cust AS INTEGER), 'P' || okey || '-' || line, 'C' || okey, 'support',
         CAST(l.part * 100000 // o.part / 100000.0 AS DECIMAL(6,5)), NULL, CAST(1 AS SMALLINT), NULL
  FROM order_lines l JOIN order_sums o USING (okey)
  UNION ALL
  SELECT 'E-' || okey || '-' || line || '-' || side || supp, CAST(d.cust AS INTEGER),
         side || d.cust || '-' || supp, 'P' || okey || '-' || line,
         CASE WHEN side = 'O' THEN 'rebut' ELSE 'support' END,
         CAST(d.part * 100000 // l.part / 100000.0 AS DECIMAL(6,5)), NULL,
         CAST(CASE WHEN side = 'O' THEN -1 ELSE 1 END AS SMALLINT), NULL
  FROM deliveries d JOIN order_lines l USING (okey, line)
)
"""

DIALOGUE = """
graphs AS (
  SELECT DISTINCT CAST(conv_id AS INTEGER) AS id, 'conv-' || conv_id AS slug, 'Conversation ' || conv_id AS title,
         CAST(NULL AS VARCHAR) AS description
  FROM conversations
),
nodes AS (
  SELECT 'T' || conv_id || '-' || turn AS id, CAST(conv_id AS INTEGER) AS graph_id,
         CASE WHEN turn = 0 THEN 'root' WHEN role = 'user' THEN 'counter' ELSE 'premise' END AS kind, text AS title,
         text AS body_text, CAST(NULL AS VARCHAR) AS category, [role] AS tags, CAST(NULL AS DECIMAL(6,5)) AS prior,
         CAST(NULL AS DECIMAL(6,5)) AS weight, CAST(NULL AS DECIMAL(6,5)) AS confidence,
         CAST(NULL AS DECIMAL(6,5)) AS importance, CAST(NULL AS VARCHAR) AS evidence_type,
         CAST(NULL AS DOUBLE) AS evidence_score, CAST(NULL AS VARCHAR) AS evidence_rationale
  FROM conversations
),
edges AS (
  SELECT 'E-' || conv_id || '-' || turn AS id, CAST(conv_id AS INTEGER) AS graph_id,
         'T' || conv_id || '-' || turn AS from_node_id, 'T' || conv_id || '-' || (turn - 1) AS to_node_id,
         CASE WHEN role = 'user' THEN 'rebut' ELSE 'support' END AS kind, CAST(1 AS DECIMAL(6,5)) AS weight,
         CAST(NULL AS DECIMAL(6,5)) AS confidence,
         CAST(CASE WHEN role = 'user' THEN -1 ELSE 1 END AS SMALLINT) AS polarity, CAST(NULL AS VARCHAR) AS rationale
  FROM conversations WHERE turn > 0
)
"""

REQUESTS = """
requests AS (
  SELECT 'customer-' || o_custkey AS slug FROM orders UNION SELECT 'supplier-' || s_suppkey FROM supplier
)
"""

SELECTION = """
selection AS (
  SELECT CAST(o_custkey AS INTEGER) AS graph_id, 'C' || max(o_orderkey) AS node_id FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT CAST(s_suppkey AS INTEGER), 'S' || s_suppkey FROM supplier
)
"""

DEFECTS = f"""
bad_edges AS (
  SELECT id,
         CASE WHEN top AND g = 8 THEN -1 - graph_id ELSE graph_id END AS graph_id,
         CASE WHEN top AND g = 6 THEN 'missing-' || id ELSE from_node_id END AS from_node_id,
         CASE WHEN top AND g = 4 THEN from_node_id WHEN top AND g = 7 THEN 'missing-' || id ELSE to_node_id END
           AS to_node_id,
         CASE WHEN top AND g = 3 THEN 'unknown' WHEN top AND g = 11 THEN NULL ELSE kind END AS kind,
         CASE WHEN top AND g = 2 THEN CAST(2 AS DECIMAL(6,5)) WHEN top AND g = 10 THEN NULL ELSE weight END AS weight,
         CASE WHEN top AND g = 1 THEN CAST(1.5 AS DECIMAL(6,5)) ELSE confidence END AS confidence,
         CASE WHEN top AND g = 5 THEN 0 WHEN top AND g = 10 THEN NULL ELSE polarity END AS polarity
  FROM (
    SELECT *, to_node_id LIKE 'R%' AS top, graph_id % {CYCLE} AS g FROM edges
    UNION ALL
    SELECT *, true, 9 FROM edges WHERE to_node_id LIKE 'R%' AND graph_id % {CYCLE} = 9
  )
),
bad_nodes AS (
  SELECT id,
         CASE WHEN claim AND g = 18 THEN -1 - graph_id ELSE graph_id END AS graph_id,
         CASE WHEN claim AND g = 17 THEN 'opinion' ELSE kind END AS kind,
         CASE WHEN claim AND g = 16 THEN NULL ELSE title END AS title,
         CASE WHEN claim AND g = 12 THEN CAST(1.2 AS DECIMAL(6,5)) ELSE prior END AS prior,
         CASE WHEN claim AND g = 14 THEN CAST(3 AS DECIMAL(6,5)) ELSE weight END AS weight,
         CASE WHEN claim AND g = 13 THEN CAST(-0.1 AS DECIMAL(6,5)) ELSE confidence END AS confidence,
         CASE WHEN claim AND g = 15 THEN CAST(1.5 AS DECIMAL(6,5)) ELSE importance END AS importance
  FROM (
    SELECT *, kind = 'claim' AS claim, graph_id % {CYCLE} AS g FROM nodes
    UNION ALL
    SELECT *, true, 19 FROM nodes WHERE kind = 'claim' AND graph_id % {CYCLE} = 19
  )
),
bad_graphs AS (
  SELECT id, CASE WHEN g = 21 THEN 'duplicate' ELSE slug END AS slug, CASE WHEN g = 20 THEN NULL ELSE title END AS title
  FROM (
    SELECT *, id % {CYCLE} AS g FROM graphs UNION ALL SELECT *, 22 FROM graphs WHERE id % {CYCLE} = 22
  )
)
"""

RULES = {
    "ck_edges_confidence": ("edges", "confidence NOT BETWEEN 0 AND 1", "confidence"),
    "ck_edges_weight": ("edges", "weight NOT BETWEEN 0 AND 1", "weight"),
    "ck_edges_kind": ("edges", "kind NOT IN ('support', 'rebut')", "kind"),
    "ck_edges_not_self": ("edges", "from_node_id = to_node_id", "from_node_id"),
    "ck_edges_polarity": ("edges", "polarity NOT IN (-1, 1)", "polarity"),
    "ck_nodes_prior": ("nodes", "prior NOT BETWEEN 0 AND 1", "prior"),
    "ck_nodes_weight": ("nodes", "weight NOT BETWEEN 0 AND 1", "weight"),
    "ck_nodes_confidence": ("nodes", "confidence NOT BETWEEN 0 AND 1", "confidence"),
    "ck_nodes_importance": ("nodes", "importance NOT BETWEEN 0 AND 1", "importance"),
    "ck_nodes_kind": ("nodes", "kind NOT IN ('root', 'claim', 'premise', 'counter', 'evidence')", "kind"),
}
REQUIRED = {
    "graphs": ("id", "slug", "title"),
    "nodes": ("id", "graph_id", "kind", "title"),
    "edges": ("id", "graph_id", "from_node_id", "to_node_id", "kind"),
}


def _check(rule: str) -> str:
    table, broken, detail = RULES[rule]
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS \"table\", CAST(id AS VARCHAR) AS key, "
        f"CAST({detail} AS VARCHAR) AS detail FROM bad_{table} WHERE {broken}"
    )


def _not_null() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}_not_null' AS rule, '{table}' AS \"table\", CAST(id AS VARCHAR) AS key, "
        f"'{column}' AS detail FROM bad_{table} WHERE {column} IS NULL"
        for table, columns in REQUIRED.items()
        for column in columns
    )


def _duplicates(table: str, column: str, rule: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{table}' AS \"table\", CAST({column} AS VARCHAR) AS key, "
        f"CAST(count(*) AS VARCHAR) AS detail FROM bad_{table} GROUP BY {column} HAVING count(*) > 1"
    )


def _primary_keys() -> str:
    return "\nUNION ALL\n".join(_duplicates(table, "id", f"{table}_pkey") for table in REQUIRED)


def _slugs() -> str:
    return _duplicates("graphs", "slug", "graphs_slug_key")


def _dangling(table: str, column: str, parent: str) -> str:
    return (
        f"SELECT '{table}_{column}_fkey' AS rule, '{table}' AS \"table\", id AS key, "
        f"CAST({column} AS VARCHAR) AS detail FROM bad_{table} child WHERE {column} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM bad_{parent} parent WHERE parent.id = child.{column})"
    )


def _all_rules() -> str:
    return "\nUNION ALL\n".join(
        [
            *(_check(rule) for rule in RULES),
            _not_null(),
            _primary_keys(),
            _slugs(),
            _dangling("edges", "from_node_id", "nodes"),
            _dangling("edges", "to_node_id", "nodes"),
            _dangling("edges", "graph_id", "graphs"),
            _dangling("nodes", "graph_id", "graphs"),
        ]
    )


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)}\n"


SUMMARY = f'SELECT rule, "table", count(*) AS violations FROM ({_all_rules()}) GROUP BY rule, "table"'

# Counts per rule with zeros, from the names of all rules.
COUNTS = f"""
SELECT names.rule, names."table", count(found.rule) AS violations
FROM (VALUES
    ('ck_nodes_prior', 'nodes'), ('ck_nodes_weight', 'nodes'), ('ck_nodes_confidence', 'nodes'), ('ck_nodes_importance', 'nodes'),
    ('ck_nodes_kind', 'nodes'), ('ck_edges_confidence', 'edges'), ('ck_edges_weight', 'edges'), ('ck_edges_kind', 'edges'),
    ('ck_edges_not_self', 'edges'), ('ck_edges_polarity', 'edges'), ('graphs_not_null', 'graphs'), ('nodes_not_null', 'nodes'),
    ('edges_not_null', 'edges'), ('graphs_pkey', 'graphs'), ('nodes_pkey', 'nodes'), ('edges_pkey', 'edges'),
    ('graphs_slug_key', 'graphs'), ('edges_from_node_id_fkey', 'edges'), ('edges_to_node_id_fkey', 'edges'),
    ('edges_graph_id_fkey', 'edges'), ('nodes_graph_id_fkey', 'nodes')
) names(rule, "table") LEFT JOIN ({_all_rules()}) found ON found.rule = names.rule AND found."table" = names."table"
GROUP BY ALL
"""

FLAT_NODES = """
id, graph_id, kind, title, body_text, category, array_to_string(tags, '|') AS tags, CAST(prior AS DOUBLE) AS prior,
CAST(weight AS DOUBLE) AS weight, CAST(confidence AS DOUBLE) AS confidence, CAST(importance AS DOUBLE) AS importance,
evidence_type, CAST(evidence_score AS DOUBLE) AS evidence_score, evidence_rationale
"""

FLAT_EDGES = """
id, graph_id, from_node_id, to_node_id, kind, CAST(weight AS DOUBLE) AS weight,
CAST(confidence AS DOUBLE) AS confidence, polarity, rationale
"""

KIND_LABEL = "upper(substring(kind, 1, 1)) || substring(kind, 2)"

SYMBOL = """
CASE kind WHEN 'root' THEN '🌍' WHEN 'claim' THEN '🌿' WHEN 'premise' THEN '🌱' WHEN 'evidence' THEN '🔬' ELSE '⚠️' END
"""

DISPLAY_TITLE = "CASE WHEN length(title) <= 33 THEN title ELSE substring(title, 1, 30) || '...' END"

METRIC_LABEL = """
CASE WHEN kind IN ('root', 'claim') THEN 'Importance' WHEN kind IN ('premise', 'counter') THEN 'Confidence'
     WHEN kind = 'evidence' THEN 'Score' END
"""


def _fixed(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(6,2)) AS VARCHAR)"


METRIC_VALUE = f"""
CASE WHEN kind IN ('root', 'claim') THEN {_fixed('importance')}
     WHEN kind IN ('premise', 'counter') THEN {_fixed('confidence')}
     WHEN kind = 'evidence' THEN {_fixed('evidence_score')} END
"""

FLOW_NODES = f"""
SELECT graph_id, id, 'default' AS type, title, {DISPLAY_TITLE} AS "displayTitle", body_text AS "bodyText",
       {KIND_LABEL} AS kind, {SYMBOL} AS symbol, {METRIC_LABEL} AS "metricLabel", {METRIC_VALUE} AS "metricValue",
       'graph-node graph-node--' || kind AS "className", 0 AS x, 0 AS y
FROM nodes
"""

ENTRIES = [
    ("Category", "CASE WHEN category <> '' THEN category END"),
    ("Tags", "CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') END"),
    ("Prior", _fixed("prior")),
    ("Confidence", _fixed("confidence")),
    ("Weight", _fixed("weight")),
    ("Importance", _fixed("importance")),
    ("Evidence", "evidence_type"),
    ("Score", _fixed("evidence_score")),
    ("Rationale", "CASE WHEN evidence_rationale <> '' THEN evidence_rationale END"),
]

DETAILS = "\nUNION ALL\n".join(
    f"SELECT graph_id, id, {ord} AS ord, '{label}' AS label, {value} AS value FROM nodes WHERE {value} IS NOT NULL"
    for ord, (label, value) in enumerate(ENTRIES, start=1)
)

NARROW_NODE = "concat_ws(':', id, kind, title, body_text)"
NARROW_EDGE = "concat_ws(':', id, from_node_id, to_node_id, kind)"
FULL_NODE = (
    "concat_ws(':', id, coalesce(category, '-'), array_to_string(tags, ','), "
    + ", ".join(f"coalesce({_fixed(c)}, '-')" for c in ("prior", "confidence", "importance", "evidence_score"))
    + ")"
)
FULL_EDGE = "concat_ws(':', id, from_node_id, to_node_id, CAST(weight * 100000 AS BIGINT))"


def _documents(node: str, edge: str) -> str:
    return f"""
    SELECT slug, 0 AS part, title, description, CAST(coalesce(node_count, 0) AS INTEGER) AS node_count,
           CAST(coalesce(edge_count, 0) AS INTEGER) AS edge_count, coalesce(node_list, '') AS node_list,
           coalesce(edge_list, '') AS edge_list
    FROM graphs g
    LEFT JOIN (SELECT graph_id, count(*) AS node_count, string_agg({node}, '|' ORDER BY id) AS node_list
               FROM nodes GROUP BY graph_id) n ON n.graph_id = g.id
    LEFT JOIN (SELECT graph_id, count(*) AS edge_count, string_agg({edge}, '|' ORDER BY id) AS edge_list
               FROM edges GROUP BY graph_id) e ON e.graph_id = g.id
    """


# Pages of 16 nodes and 16 edges.
PAGES = f"""
SELECT slug, coalesce(p.part, 0) AS part, title, description, CAST(coalesce(node_count, 0) AS INTEGER) AS node_count,
       CAST(coalesce(edge_count, 0) AS INTEGER) AS edge_count, coalesce(node_list, '') AS node_list,
       coalesce(edge_list, '') AS edge_list
FROM graphs g
LEFT JOIN (
  SELECT * FROM (
    SELECT graph_id, part, count(*) AS node_count, string_agg({NARROW_NODE}, '|' ORDER BY id) AS node_list
    FROM (SELECT *, CAST((row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1) // 16 AS INTEGER) AS part FROM nodes)
    GROUP BY graph_id, part
  ) FULL JOIN (
    SELECT graph_id, part, count(*) AS edge_count, string_agg({NARROW_EDGE}, '|' ORDER BY id) AS edge_list
    FROM (SELECT *, CAST((row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1) // 16 AS INTEGER) AS part FROM edges)
    GROUP BY graph_id, part
  ) USING (graph_id, part)
) p ON p.graph_id = g.id
"""

OVERVIEW = """
SELECT title, description, coalesce(n.node_count, 0) AS node_count, coalesce(e.edge_count, 0) AS edge_count, slug
FROM graphs g
LEFT JOIN (SELECT graph_id, count(*) AS node_count FROM nodes GROUP BY graph_id) n ON n.graph_id = g.id
LEFT JOIN (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY graph_id) e ON e.graph_id = g.id
"""

# Longest path to a sink: start at the sinks and keep the last step at which a node is reached. Graphs have no cycles.
WALK = """
walk AS (
  SELECT id, 0 AS step FROM nodes WHERE id NOT IN (SELECT from_node_id FROM edges)
  UNION
  SELECT from_node_id, step + 1 FROM walk JOIN edges ON to_node_id = walk.id
),
layers AS (
  SELECT graph_id, id, step AS layer FROM nodes JOIN (SELECT id, max(step) AS step FROM walk GROUP BY id) USING (id)
)
"""

# Components by mutual reach, then the longest path over components.
TANGLED = """
links AS (
  SELECT from_node_id AS a, to_node_id AS b FROM edges
  UNION SELECT 'T' || conv_id || '-2', 'T' || conv_id || '-4' FROM conversations WHERE turn = 4
),
reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
heads AS (
  SELECT r.a AS id, min(r.b) AS head FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a
),
steps AS (
  SELECT DISTINCT x.head AS a, y.head AS b
  FROM links JOIN heads x ON x.id = links.a JOIN heads y ON y.id = links.b WHERE x.head <> y.head
),
strides AS (
  SELECT DISTINCT head AS id, 0 AS step FROM heads WHERE head NOT IN (SELECT a FROM steps)
  UNION SELECT steps.a, step + 1 FROM strides JOIN steps ON steps.b = strides.id
)
"""

POSITIONS = """
SELECT graph_id, id, layer, CAST(slot AS BIGINT) AS slot, 24 + layer * 330 AS x,
       CAST(24 + slot * 142 AS BIGINT) AS y, 'left' AS "sourcePosition", 'right' AS "targetPosition"
FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, layer ORDER BY id) - 1 AS slot FROM layers)
"""

# Steps as in the operator: three towards layer 0, three away from it, odd and even layers in turn.
STEPS = 6


def _step(number: int) -> str:
    near, far, up = ("low", "up", 1) if number < 3 else ("up", "low", 0)
    return f"""
p{number + 1} AS MATERIALIZED (
  SELECT graph_id, layer, id, via,
         row_number() OVER (
           PARTITION BY graph_id, layer
           ORDER BY CASE WHEN layer % 2 = {(number + 1) % 2} THEN coalesce(mean, slot) ELSE slot END, id, via
         ) - 1 AS slot
  FROM p{number} LEFT JOIN (
    SELECT s.graph_id, s.layer + {up} AS layer, {far}_id AS id, {far}_via AS via,
           CAST(sum(slot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
    FROM segments s JOIN p{number} q
      ON q.graph_id = s.graph_id AND q.layer = s.layer + {1 - up} AND q.id = {near}_id AND q.via = {near}_via
    GROUP BY ALL
  ) USING (graph_id, layer, id, via)
)
"""


ORDERED = (
    """
segments AS MATERIALIZED (
  SELECT graph_id, layer, a AS up_id, CASE WHEN layer + 1 = top THEN '' ELSE '>' || b END AS up_via,
         CASE WHEN layer = bottom THEN b ELSE a END AS low_id, CASE WHEN layer = bottom THEN '' ELSE '>' || b END AS low_via
  FROM (
    SELECT s.graph_id, a, b, s.layer AS top, t.layer AS bottom,
           CAST(unnest(range(t.layer, s.layer)) AS INTEGER) AS layer
    FROM links JOIN layers s ON s.id = a JOIN layers t ON t.id = b AND t.graph_id = s.graph_id WHERE s.layer > t.layer
  )
),
p0 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY graph_id, layer ORDER BY id, via) - 1 AS slot
  FROM (
    SELECT graph_id, layer, id, '' AS via FROM layers
    UNION ALL SELECT graph_id, layer, low_id, low_via FROM segments WHERE low_via <> ''
  )
),
"""
    + ",".join(map(_step, range(STEPS)))
    + ", orders AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT {n} AS n, * FROM p{n}" for n in range(STEPS + 1))
    + """),
spans AS MATERIALIZED (
  SELECT u.n, s.graph_id, s.layer, u.slot AS u, l.slot AS l
  FROM segments s
  JOIN orders u ON u.graph_id = s.graph_id AND u.layer = s.layer + 1 AND u.id = up_id AND u.via = up_via
  JOIN orders l ON l.graph_id = s.graph_id AND l.layer = s.layer AND l.id = low_id AND l.via = low_via AND l.n = u.n
),
crossings AS (
  SELECT n, graph_id, coalesce(crossed, 0) AS crossed
  FROM (SELECT DISTINCT n, graph_id FROM spans) LEFT JOIN (
    SELECT a.n, a.graph_id, count(*) AS crossed
    FROM spans a JOIN spans b ON b.n = a.n AND b.graph_id = a.graph_id AND b.layer = a.layer AND a.u < b.u AND a.l > b.l
    GROUP BY ALL
  ) USING (n, graph_id)
),
chosen AS MATERIALIZED (
  SELECT graph_id, min(crossed) FILTER (n = 0) AS by_id, min(crossed) AS ordered,
         CAST(arg_min(n, crossed * 100 + n) AS BIGINT) AS step
  FROM crossings GROUP BY graph_id
)
"""
)

LINKS = "links AS (SELECT DISTINCT from_node_id AS a, to_node_id AS b FROM edges)"

# Document nodes and edges with their place; graphs are numbered from 1 in slug order.
NUMBERED = "numbered AS (SELECT id AS old_id, row_number() OVER (ORDER BY slug) AS new_id FROM graphs)"


def _survivors(graphs: str, nodes: str, edges: str) -> str:
    return f"""
    SELECT 'graphs' AS "table", CAST(id AS VARCHAR) AS id FROM graphs WHERE {graphs}
    UNION ALL SELECT 'nodes', id FROM nodes WHERE {nodes}
    UNION ALL SELECT 'edges', id FROM edges WHERE {edges}
    """


DOOMED = "SELECT id FROM graphs WHERE description = 'BUILDING'"

ORACLE: dict[str, str] = {
    "graphs_scan": _with(COMMERCE) + "SELECT id, slug, title, description FROM graphs",
    "nodes_scan": _with(COMMERCE) + 'SELECT graph_id, id, kind, title, body_text AS "bodyText" FROM nodes',
    "edges_scan": _with(COMMERCE)
    + 'SELECT graph_id, id, from_node_id AS "from", to_node_id AS "to", kind FROM edges',
    "nodes_full_scan": _with(COMMERCE) + f"SELECT {FLAT_NODES} FROM nodes",
    "edges_full_scan": _with(COMMERCE) + f"SELECT {FLAT_EDGES} FROM edges",
    "dialogue_graphs_scan": _with(DIALOGUE) + "SELECT id, slug, title, description FROM graphs",
    "dialogue_nodes_scan": _with(DIALOGUE) + f"SELECT {FLAT_NODES} FROM nodes",
    "dialogue_edges_scan": _with(DIALOGUE) + f"SELECT {FLAT_EDGES} FROM edges",
    "graph_by_slug": _with(COMMERCE, REQUESTS)
    + "SELECT id, slug, title, description FROM graphs WHERE slug IN (SELECT slug FROM requests)",
    "graph_nodes": _with(COMMERCE, REQUESTS)
    + """
    SELECT graph_id, id, kind, title, body_text AS "bodyText" FROM nodes
    WHERE graph_id IN (SELECT id FROM graphs WHERE slug IN (SELECT slug FROM requests))
    """,
    "graph_edges": _with(COMMERCE, REQUESTS)
    + """
    SELECT graph_id, id, from_node_id AS "from", to_node_id AS "to", kind FROM edges
    WHERE graph_id IN (SELECT id FROM graphs WHERE slug IN (SELECT slug FROM requests))
    """,
    "single_graph_per_slug": _with(COMMERCE) + "SELECT id, slug, title, description FROM graphs",
    "batch_lookup": _with(COMMERCE, REQUESTS)
    + f"""
    SELECT r.slug, o.title, o.description, o.node_count, o.edge_count, o.slug IS NOT NULL AS found
    FROM requests r LEFT JOIN ({OVERVIEW}) o ON o.slug = r.slug
    """,
    "strict_lookup": _with(COMMERCE)
    + """
    SELECT r.slug, title, description FROM (SELECT DISTINCT 'customer-' || o_custkey AS slug FROM orders) r
    LEFT JOIN graphs g ON g.slug = r.slug
    """,
    "node_by_id": _with(COMMERCE, SELECTION)
    + """
    SELECT n.graph_id, n.id, n.kind, n.title FROM nodes n
    WHERE EXISTS (SELECT 1 FROM selection s WHERE s.graph_id = n.graph_id AND s.node_id = n.id)
    """,
    "graph_documents": _with(COMMERCE) + _documents(NARROW_NODE, NARROW_EDGE),
    "document_pages": _with(COMMERCE) + PAGES,
    "requested_documents": _with(COMMERCE, REQUESTS)
    + f"""
    SELECT r.slug, coalesce(part, 0) AS part, title, description, node_count, edge_count, node_list, edge_list,
           d.slug IS NOT NULL AS found
    FROM (SELECT DISTINCT slug FROM requests) r
    LEFT JOIN ({_documents(NARROW_NODE, NARROW_EDGE)}) d ON d.slug = r.slug
    """,
    "graph_documents_full": _with(COMMERCE) + _documents(FULL_NODE, FULL_EDGE),
    "dialogue_documents": _with(DIALOGUE) + _documents(NARROW_NODE, NARROW_EDGE),
    "document_nodes_roundtrip": _with(COMMERCE, NUMBERED)
    + f"""
    SELECT * EXCLUDE (old_id, new_id) REPLACE (CAST(new_id AS INTEGER) AS graph_id) FROM (
      SELECT {FLAT_NODES}, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS INTEGER) AS pos FROM nodes
    ) JOIN numbered ON old_id = graph_id
    """,
    "document_edges_roundtrip": _with(COMMERCE, NUMBERED)
    + """
    SELECT id, CAST(new_id AS INTEGER) AS graph_id, from_node_id, to_node_id, kind, CAST(weight AS DOUBLE) AS weight,
           CAST(row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS INTEGER) AS pos
    FROM edges JOIN numbered ON old_id = graph_id
    """,
    "document_defects": _with(DIALOGUE)
    + """
    SELECT 'document_json' AS rule, 'documents' AS "table", count(*) AS violations FROM graphs HAVING count(*) > 0
    UNION ALL SELECT 'graphs_slug_key', 'graphs', count(*) FROM graphs HAVING count(*) > 0
    UNION ALL SELECT 'nodes_pkey', 'nodes', count(*) FROM nodes HAVING count(*) > 0
    """,
    "document_json": _with(DIALOGUE) + _documents(NARROW_NODE, NARROW_EDGE),
    "node_counts": _with(COMMERCE) + "SELECT graph_id, count(*) AS node_count FROM nodes GROUP BY graph_id",
    "edge_counts": _with(COMMERCE) + "SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY graph_id",
    "graph_overview": _with(COMMERCE) + OVERVIEW,
    "dialogue_overview": _with(DIALOGUE) + OVERVIEW,
    "kind_labels": _with(COMMERCE)
    + f"SELECT id, {KIND_LABEL} AS label FROM (SELECT id, kind FROM nodes UNION ALL SELECT id, kind FROM edges)",
    "node_symbols": _with(COMMERCE) + f"SELECT id, {SYMBOL} AS symbol FROM nodes",
    "display_titles": f"{_with(COMMERCE)} SELECT id, {DISPLAY_TITLE} AS display_title FROM nodes UNION ALL ("
    + f"{_with(DIALOGUE)} SELECT id, {DISPLAY_TITLE} AS display_title FROM nodes)",
    "node_metrics": _with(COMMERCE)
    + f"SELECT id, {METRIC_LABEL} AS metric_label, {METRIC_VALUE} AS metric_value FROM nodes",
    # printf rounds the exact binary value too, but takes exact ties to even; those are lifted off the tie first.
    "price_metrics": """
    SELECT CASE WHEN v * 8 = floor(v * 8) AND CAST(v * 8 AS BIGINT) % 2 = 1 THEN printf('%.2f', v + 0.001)
                ELSE printf('%.2f', v) END AS metric, count(*) AS lines
    FROM (SELECT l_extendedprice / 10 AS v FROM lineitem) GROUP BY 1
    """,
    "class_names": _with(COMMERCE)
    + """
    SELECT id, 'graph-node graph-node--' || kind AS class_name FROM nodes
    UNION ALL SELECT id, 'graph-edge graph-edge--' || kind FROM edges
    """,
    "evidence_fields": _with(COMMERCE)
    + """
    SELECT id, evidence_type AS type, CAST(evidence_score AS DOUBLE) AS score, evidence_rationale AS rationale
    FROM nodes
    """,
    "column_defaults": _with(COMMERCE)
    + """
    SELECT id, CAST(len(tags) AS INTEGER) AS tag_count, '{}' AS attributes, true AS created_now, true AS updated_now
    FROM nodes
    """,
    "offset_timestamps": "SELECT o_orderkey, epoch_us(o_orderdate) + 14400000000 AS epoch_us FROM orders",
    "flow_nodes": _with(COMMERCE) + FLOW_NODES,
    "flow_edges": _with(COMMERCE)
    + f"""
    SELECT graph_id, id, from_node_id AS source, to_node_id AS target, {KIND_LABEL} AS label, 'arrowclosed' AS marker,
           'graph-edge graph-edge--' || kind AS "className", 11 AS "fontSize", 700 AS "fontWeight"
    FROM edges
    """,
    "dialogue_flow_nodes": _with(DIALOGUE) + FLOW_NODES,
    "selected_nodes": _with(COMMERCE, SELECTION)
    + """
    SELECT graph_id, id, EXISTS (
      SELECT 1 FROM selection s WHERE s.graph_id = nodes.graph_id AND s.node_id = nodes.id
    ) AS selected FROM nodes
    """,
    "node_cards": _with(COMMERCE)
    + f"""
    SELECT graph_id, id, symbol || ' ' || "displayTitle" AS heading, "metricLabel" || ': ' || "metricValue" AS metric,
           "bodyText" AS tooltip
    FROM ({FLOW_NODES})
    """,
    "node_headers": _with(COMMERCE) + 'SELECT graph_id, id, title, kind, body_text AS "bodyText" FROM nodes',
    "node_tags": _with(COMMERCE)
    + """
    SELECT graph_id, id, CAST(place - 1 AS INTEGER) AS pos, tags[place] AS tag
    FROM (SELECT graph_id, id, tags, unnest(range(1, len(tags) + 1)) AS place FROM nodes)
    """,
    "node_details": _with(COMMERCE) + DETAILS,
    "dialogue_node_details": _with(DIALOGUE) + DETAILS,
    "attribute_presence": _with(COMMERCE)
    + f"SELECT graph_id, label, count(*) AS nodes FROM ({DETAILS}) GROUP BY graph_id, label",
    "violations_edge_confidence": _with(COMMERCE, DEFECTS) + _check("ck_edges_confidence"),
    "violations_edge_weight": _with(COMMERCE, DEFECTS) + _check("ck_edges_weight"),
    "violations_edge_kind": _with(COMMERCE, DEFECTS) + _check("ck_edges_kind"),
    "violations_self_loop": _with(COMMERCE, DEFECTS) + _check("ck_edges_not_self"),
    "violations_polarity": _with(COMMERCE, DEFECTS) + _check("ck_edges_polarity"),
    "violations_node_range": _with(COMMERCE, DEFECTS)
    + "\nUNION ALL\n".join(_check(f"ck_nodes_{c}") for c in ("prior", "weight", "confidence", "importance")),
    "violations_node_kind": _with(COMMERCE, DEFECTS) + _check("ck_nodes_kind"),
    "violations_not_null": _with(COMMERCE, DEFECTS) + _not_null(),
    "violations_primary_key": _with(COMMERCE, DEFECTS) + _primary_keys(),
    "violations_slug": _with(COMMERCE, DEFECTS) + _slugs(),
    "violations_edge_from": _with(COMMERCE, DEFECTS) + _dangling("edges", "from_node_id", "nodes"),
    "violations_edge_to": _with(COMMERCE, DEFECTS) + _dangling("edges", "to_node_id", "nodes"),
    "violations_edge_graph": _with(COMMERCE, DEFECTS) + _dangling("edges", "graph_id", "graphs"),
    "violations_node_graph": _with(COMMERCE, DEFECTS) + _dangling("nodes", "graph_id", "graphs"),
    "violations_summary": _with(COMMERCE, DEFECTS) + SUMMARY,
    "violations_clean": _with(
        DIALOGUE,
        "bad_graphs AS (SELECT * FROM graphs), bad_nodes AS (SELECT * FROM nodes), bad_edges AS (SELECT * FROM edges)",
    )
    + _all_rules(),
    "violations_clean_counts": _with(
        DIALOGUE,
        "bad_graphs AS (SELECT * FROM graphs), bad_nodes AS (SELECT * FROM nodes), bad_edges AS (SELECT * FROM edges)",
    )
    + COUNTS,
    "violations_counts": _with(COMMERCE, DEFECTS) + COUNTS,
    "cascade_delete_graphs": _with(COMMERCE)
    + _survivors(
        f"id NOT IN ({DOOMED})",
        f"graph_id NOT IN ({DOOMED})",
        f"graph_id NOT IN ({DOOMED})"
        + "".join(
            f" AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = edges.{end} AND n.graph_id IN ({DOOMED}))"
            for end in ("from_node_id", "to_node_id")
        ),
    ),
    "cascade_delete_nodes": _with(COMMERCE)
    + _survivors(
        "true",
        "kind <> 'counter'",
        " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = edges.{end} AND n.kind = 'counter')"
            for end in ("from_node_id", "to_node_id")
        ),
    ),
    "bulk_load": _with(COMMERCE, DEFECTS) + SUMMARY,
    "loaded_overview": _with(DIALOGUE) + OVERVIEW,
    "typed_nodes": _with(COMMERCE) + f"SELECT {FLAT_NODES} FROM nodes",
    "typed_misfits": _with(COMMERCE)
    + """
    SELECT 'nodes_type' AS rule, 'nodes' AS "table", id AS key, detail
    FROM nodes CROSS JOIN (VALUES
        ('graph_id: one'), ('tags: abc'), ('prior: high'), ('weight: -10.5'), ('confidence: ?'), ('importance: 10.5'),
        ('evidence: {"type": "video", "score": "high"}'), ('attributes: not json'), ('created_at: garbage'),
        ('updated_at: 2024-13-01')
    ) bad(detail)
    WHERE kind = 'root'
    """,
    "layer_assignment": _with(COMMERCE, WALK, recursive=True) + "SELECT graph_id, id, layer FROM layers",
    "layout_positions": _with(COMMERCE, WALK, recursive=True) + POSITIONS,
    "layer_crossings": _with(COMMERCE, WALK, LINKS, ORDERED, recursive=True) + "SELECT * FROM chosen",
    "ordered_positions": _with(COMMERCE, WALK, LINKS, ORDERED, recursive=True)
    + POSITIONS.replace("BY id", "BY rank").replace(
        "FROM layers",
        """FROM (
          SELECT o.graph_id, id, layer, slot AS rank FROM orders o LEFT JOIN chosen c ON c.graph_id = o.graph_id
          WHERE via = '' AND n = coalesce(step, 0)
        )""",
    ).replace("SELECT *, row_number", "SELECT graph_id, id, layer, row_number"),
    "answer_crossings": _with(
        DIALOGUE,
        WALK,
        LINKS.replace(
            "FROM edges",
            "FROM edges UNION SELECT 'T' || conv_id || '-' || turn, 'T' || conv_id || '-' || (turn // 2) FROM conversations WHERE turn > 0",
        ),
        ORDERED,
        recursive=True,
    )
    + "SELECT * FROM chosen",
    "dialogue_layout": _with(DIALOGUE, WALK, recursive=True) + POSITIONS,
    "flow_layout": _with(DIALOGUE, WALK, recursive=True)
    + f"""
    SELECT f.* EXCLUDE (x, y), p.x, p.y, p."sourcePosition", p."targetPosition"
    FROM ({FLOW_NODES}) f JOIN ({POSITIONS}) p ON p.graph_id = f.graph_id AND p.id = f.id
    """,
    "drawn_documents": _with(COMMERCE, WALK, NUMBERED, recursive=True)
    + f"""
    SELECT * EXCLUDE (old_id, new_id) REPLACE (CAST(new_id AS INTEGER) AS graph_id) FROM (
      SELECT 'node' AS element, f.* EXCLUDE (x, y), p.x, p.y, p."sourcePosition", p."targetPosition"
      FROM ({FLOW_NODES}) f JOIN ({POSITIONS}) p ON p.graph_id = f.graph_id AND p.id = f.id
      UNION ALL BY NAME
      SELECT 'edge' AS element, graph_id, id, from_node_id AS source, to_node_id AS target, {KIND_LABEL} AS label,
             'arrowclosed' AS marker, 'graph-edge graph-edge--' || kind AS "className", 11 AS "fontSize", 700 AS "fontWeight"
      FROM edges
    ) JOIN numbered ON old_id = graph_id
    """,
    "cyclic_positions": _with(DIALOGUE, "layers AS (SELECT graph_id, id, 0 AS layer FROM nodes)") + POSITIONS,
    # Every turn of a conversation with several turns lies on the ring, which is one sink; a single turn is a sink too.
    "cyclic_layers": _with(DIALOGUE) + "SELECT graph_id, id, 0 AS layer FROM nodes",
    "tangled_layers": _with(DIALOGUE, TANGLED, recursive=True)
    + """
    SELECT graph_id, nodes.id, max(step) AS layer
    FROM nodes JOIN heads USING (id) JOIN strides ON strides.id = heads.head GROUP BY graph_id, nodes.id
    """,
    "appended_batches": _with(DIALOGUE)
    + """
    , sizes AS (
      SELECT 'graphs' AS rule, id AS graph_id, count(*) AS n FROM graphs GROUP BY id
      UNION ALL SELECT 'nodes', graph_id, count(*) FROM nodes GROUP BY graph_id
      UNION ALL SELECT 'edges', graph_id, count(*) FROM edges GROUP BY graph_id
    ), tables(rule) AS (VALUES ('graphs'), ('nodes'), ('edges')),
    batches(batch, accepted, whole) AS (VALUES ('1 odd', true, false), ('2 again', false, false), ('3 lost', false, false), ('4 even', true, true)),
    taken AS (
      SELECT batch, accepted, rule, CAST(coalesce(sum(n) FILTER (WHERE whole OR graph_id % 2 = 1), 0) AS BIGINT) AS rows
      FROM batches CROSS JOIN tables LEFT JOIN sizes USING (rule) GROUP BY ALL
    ), refused AS (
      SELECT '2 again' AS batch, unnest(CASE rule WHEN 'graphs' THEN ['graphs_pkey', 'graphs_slug_key'] ELSE [rule || '_pkey'] END) AS rule, n
      FROM sizes WHERE graph_id % 10 = 5
      UNION ALL
      SELECT '3 lost', 'edges_to_node_id_fkey', count(*) FROM edges WHERE graph_id % 5 = 0 AND id LIKE '%-1'
      UNION ALL
      SELECT '3 lost', unnest(['edges_from_node_id_fkey', 'edges_graph_id_fkey']), count(*) FROM edges WHERE graph_id % 10 = 0 AND id LIKE '%-1'
    )
    SELECT * FROM taken
    UNION ALL
    SELECT batch, false, rule, CAST(sum(n) AS BIGINT) FROM refused GROUP BY batch, rule HAVING sum(n) > 0
    """,
    "multiline_roundtrip": _with(DIALOGUE)
    + """
    SELECT slug, nodes.id, kind, nodes.title, body_text AS "bodyText",
           CAST(row_number() OVER (PARTITION BY graph_id ORDER BY nodes.id) - 1 AS INTEGER) AS pos
    FROM nodes JOIN graphs ON graphs.id = graph_id
    """,
    "bucketed_overview": _with(COMMERCE) + OVERVIEW,
    "point_lookup": _with(COMMERCE)
    + """
    SELECT 'graphs' AS "table", CAST(id AS VARCHAR) AS id FROM graphs WHERE slug = 'customer-7'
    UNION ALL SELECT 'nodes', id FROM nodes WHERE id IN ('R7', 'C7', 'P7-1', 'none')
    UNION ALL SELECT 'edges', id FROM edges WHERE id IN ('E-7', 'E-7-1')
    """,
}
