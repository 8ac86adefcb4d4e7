"""SQL of the hierarchies in JSON payloads, for the twins of queries over nested records."""

from __future__ import annotations

from dossierflow.plans.sqltext import ustrip

NODE_KEYS = "('rules_hierarchy', 'children', 'node', 'attributes', 'extracted_images', 'element_type')"


def _field(x: str, key: str) -> str:
    """A value under a key that may hold any character but a quote."""
    return f"""json_extract({x}, '$."' || {key} || '"')"""


def parsed(x: str) -> str:
    """A JSON value; one given as JSON text is read again."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END ELSE {x} END)"


def nodes_in(x: str) -> str:
    """The list of node objects that a value holds: in a list, under keys of their own, or as it stands."""
    values = f"list_transform(json_keys({x}), lambda k: {_field(x, 'k')})"
    named = f"(len(json_keys({x})) > 0 AND len(list_filter({values}, lambda v: json_type(v) <> 'OBJECT')) = 0 AND len(list_filter(json_keys({x}), lambda k: k IN {NODE_KEYS})) = 0)"
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN list_filter(CAST({x} AS JSON[]), lambda y: json_type(y) = 'OBJECT') WHEN 'OBJECT' THEN CASE WHEN {named} THEN {values} ELSE [{x}] END ELSE CAST([] AS JSON[]) END)"


def text_of(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'VARCHAR' THEN {x} ->> '$' WHEN 'NULL' THEN NULL ELSE {x}::VARCHAR END)"


#: nodes: record_id, p (positions from the top), node; ordinal in document order. attrs: record_id, p, k, v, n.
TREE = f"""payloads AS (SELECT record_id, payload::JSON AS j FROM structured_json WHERE payload IS NOT NULL AND json_valid(payload)),
tops AS (SELECT record_id, {parsed('x')} AS x FROM (SELECT record_id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN j -> 'rules_hierarchy' END AS x FROM payloads)),
walk AS (SELECT record_id, [i] AS p, node FROM (SELECT record_id, unnest({nodes_in('x')}) AS node, generate_subscripts({nodes_in('x')}, 1) AS i FROM tops)
  UNION ALL SELECT record_id, list_append(p, i), node FROM (SELECT record_id, p, unnest({nodes_in('c')}) AS node, generate_subscripts({nodes_in('c')}, 1) AS i FROM (SELECT record_id, p, {parsed("(node -> 'children')")} AS c FROM walk))),
nodes AS (SELECT record_id, p, array_to_string(p, '.') AS path, len(p)::INTEGER AS depth, node, (row_number() OVER (PARTITION BY record_id ORDER BY p) - 1)::INTEGER AS ordinal FROM walk),
held AS (SELECT record_id, p, node -> 'attributes' AS a FROM nodes),
entries AS (SELECT record_id, p, e, n FROM (SELECT record_id, p, unnest(CAST(a AS JSON[])) AS e, generate_subscripts(CAST(a AS JSON[]), 1) AS n FROM held WHERE json_type(a) = 'ARRAY') WHERE json_type(e) = 'OBJECT' UNION ALL SELECT record_id, p, a, 1 FROM held WHERE json_type(a) = 'OBJECT'),
pairs AS (SELECT record_id, p, e ->> 'name' AS k, e -> 'value' AS v, n, 0 AS m FROM entries JOIN held USING (record_id, p) WHERE json_exists(e, '$.name') AND (json_type(a) = 'ARRAY' OR (len(json_keys(e)) = 2 AND json_exists(e, '$.value') AND json_type(e -> 'value') NOT IN ('OBJECT', 'ARRAY')))
  UNION ALL SELECT record_id, p, k, {_field('e', 'k')}, n, m FROM (SELECT record_id, p, e, n, unnest(json_keys(e)) AS k, generate_subscripts(json_keys(e), 1) AS m FROM entries JOIN held USING (record_id, p) WHERE NOT (json_exists(e, '$.name') AND (json_type(a) = 'ARRAY' OR (len(json_keys(e)) = 2 AND json_exists(e, '$.value') AND json_type(e -> 'value') NOT IN ('OBJECT', 'ARRAY')))))),
attrs AS (SELECT record_id, p, k, {text_of('v')} AS v, n, m FROM pairs),
dict AS (SELECT record_id, p, k, arg_max(CASE WHEN v IS NULL THEN '' ELSE v END, (n, m)) AS v FROM attrs WHERE k <> '' GROUP BY 1, 2, 3),
named AS (SELECT n.*, max(v) FILTER (k = 'sdt-id') AS sdt_id, nullif(max(v) FILTER (k = 'source-title'), '') AS source_title, nullif(max(v) FILTER (k = 'title'), '') AS title, max(v) FILTER (k = 'Domain') AS domain, max(v) FILTER (k = 'TypeOfContent') AS content
  FROM nodes n LEFT JOIN dict USING (record_id, p) GROUP BY ALL),
images AS (SELECT record_id, p, unnest(CASE json_type(x) WHEN 'ARRAY' THEN list_filter(CAST(x AS JSON[]), lambda y: json_type(y) <> 'NULL') WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [x] END) AS i FROM (SELECT record_id, p, node -> 'extracted_images' AS x FROM nodes) WHERE x IS NOT NULL)"""

KIND = text_of("(node -> 'element_type')")
TEXT = "CASE WHEN json_type(node -> 'text_content') = 'VARCHAR' THEN node ->> 'text_content' ELSE '' END"
CHILDREN = f"len({nodes_in(parsed(chr(40) + 'node -> ' + chr(39) + 'children' + chr(39) + chr(41)))})"
IMAGES = "(SELECT count(*) FROM images i WHERE i.record_id = named.record_id AND i.p = named.p)::INTEGER"
LINKS = "(CASE WHEN json_type(node -> 'hyperlinks') = 'ARRAY' THEN json_array_length(node -> 'hyperlinks') ELSE 0 END)::INTEGER"

INDEX = f"""idx AS (SELECT record_id, ordinal, path, depth, sdt_id, coalesce({KIND}, '') AS element_type, coalesce(source_title, title, {KIND}, '') AS title, length({TEXT})::INTEGER AS text_length, {LINKS} AS n_links, {IMAGES} AS n_images, {CHILDREN}::INTEGER AS n_children, replace(substr({TEXT}, 1, 200), chr(10), ' ') AS preview FROM named)"""

SECTIONS = f"""ids AS (SELECT *, coalesce(nullif({text_of("(node -> 'node_id')")}, ''), nullif({text_of("(node -> 'id')")}, ''), nullif(sdt_id, ''), 'node_' || ordinal) AS own FROM named),
sect AS (SELECT a.record_id, a.ordinal, a.own AS node_id, b.own AS parent_node_id, a.depth AS level, coalesce(a.source_title, a.title, nullif({KIND.replace('node ->', 'a.node ->')}, ''), '') AS heading, {TEXT.replace('node ->', 'a.node ->')} AS text, (SELECT count(*) FROM images i WHERE i.record_id = a.record_id AND i.p = a.p)::INTEGER AS n_images
  FROM ids a LEFT JOIN ids b ON a.record_id = b.record_id AND b.p = a.p[1:len(a.p) - 1])"""

IMAGE_NAME = f"(CASE json_type(i) WHEN 'OBJECT' THEN coalesce({', '.join(f'''CASE WHEN json_type(i -> '{k}') = 'VARCHAR' THEN i ->> '{k}' END''' for k in ('file', 'name', 'path', 'src', 'filename', 'image_path'))}) ELSE {text_of('i')} END)"

FOUND = f"""SELECT DISTINCT record_id, path AS node_path, 'node' AS row_kind, coalesce(sdt_id, '') AS item_key FROM named
UNION SELECT DISTINCT record_id, array_to_string(p, '.'), 'attribute', k FROM attrs WHERE {ustrip('v')} <> ''
UNION SELECT DISTINCT record_id, array_to_string(p, '.'), 'image', {IMAGE_NAME} FROM images WHERE {ustrip(IMAGE_NAME)} <> ''"""

LINK = lambda f: ustrip(f"coalesce({text_of(f'(l -> {chr(39)}{f}{chr(39)})')}, '')")
#: topics of a record by key (its first place, its last content), their links, and what each link matches: the longest title that holds it or is held by it.
GRAPH = f"""keyed AS (SELECT *, {ustrip("coalesce(source_title, '')")} AS t, coalesce(nullif(sdt_id, ''), {text_of("(node -> 'id')")}) AS key FROM named),
topics AS (SELECT record_id, key, min(ordinal) AS pos, arg_max(t, ordinal) AS title, arg_max(trim(coalesce(nullif(domain, ''), 'Unknown'), '; '), ordinal) AS domain, arg_max(trim(coalesce(nullif(content, ''), 'General'), '; '), ordinal) AS content_type, arg_max({TEXT}, ordinal) AS body, arg_max(coalesce(node -> 'hyperlinks', 'null'::JSON), ordinal) AS hl FROM keyed WHERE t <> '' AND key <> '' GROUP BY 1, 2),
links AS (SELECT record_id, title AS source, {LINK('text')} AS text, {ustrip(f"coalesce({text_of('(l -> ' + chr(39) + 'target' + chr(39) + ')')}, 'Unknown Target')")} AS target FROM (SELECT record_id, title, unnest(CASE WHEN json_type(hl) = 'ARRAY' THEN CAST(hl AS JSON[]) ELSE CAST([] AS JSON[]) END) AS l FROM topics) WHERE json_type(l) = 'OBJECT'),
titles AS (SELECT record_id, title, min(pos) AS pos FROM topics GROUP BY 1, 2),
matched AS (SELECT l.record_id, l.source, l.text, l.target, arg_max(t.title, (length(t.title), -t.pos)) AS hit FROM (SELECT DISTINCT * FROM links WHERE text <> '') l LEFT JOIN titles t ON l.record_id = t.record_id AND t.title <> l.source AND (contains(lower(t.title), lower(l.text)) OR contains(lower(l.text), lower(t.title))) GROUP BY 1, 2, 3, 4),
ext AS (SELECT DISTINCT record_id, text FROM matched m WHERE hit IS NULL AND NOT EXISTS (SELECT 1 FROM titles t WHERE t.record_id = m.record_id AND t.title = m.text))"""
GRAPH_ROWS = """SELECT record_id, 'topic' AS kind, title AS node_id, NULL::VARCHAR AS other, NULL::VARCHAR AS relation, domain, content_type, length(body)::INTEGER AS text_size FROM topics
UNION ALL SELECT record_id, 'external', text, NULL, NULL, 'External Reference', 'Hyperlink Fragment', 0 FROM ext
UNION ALL SELECT DISTINCT record_id, 'edge', source, coalesce(hit, text), target, NULL, NULL, NULL::INTEGER FROM matched"""
