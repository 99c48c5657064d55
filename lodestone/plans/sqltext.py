"""Pieces of DuckDB SQL that say what the column functions compute."""


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(trim({x}), '\s+'), lambda w: w <> '')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def plain(x: str) -> str:
    return rf"regexp_replace(replace(replace(translate(lower({x}), '-_’', '  '''), '''s ', ' '), '''', ''), '[^a-z0-9+#\s]', ' ', 'g')"


def singular(w: str) -> str:
    return (
        f"CASE WHEN {w} = 'vertices' THEN 'vertex' WHEN {w} = 'indices' THEN 'index' WHEN {w} = 'matrices' THEN 'matrix' WHEN {w} = 'children' THEN 'child' "
        f"WHEN length({w}) <= 3 OR regexp_matches({w}, '(ss|us|is)$') THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y' "
        f"WHEN regexp_matches({w}, '(ches|shes|xes|sses)$') THEN {w}[:-3] WHEN {w} LIKE '%s' THEN {w}[:-2] ELSE {w} END"
    )


def tokens(x: str) -> str:
    return f"list_transform({words(plain(x))}, lambda t: {singular('t')})"


def normalized(source: str, name: str) -> str:
    """CTEs that end in normal(name, norm) for the distinct names of a FROM clause."""
    return rf"""n0 AS (SELECT DISTINCT {name} AS name FROM {source}),
n1 AS (SELECT name, list_filter(string_split(regexp_replace({collapse(plain('name'))}, '^(the|a|an)\s+', ''), ' '), lambda w: w <> '') AS w FROM n0),
n2 AS (SELECT name, CASE WHEN len(w) > 1 AND w[-1] IN ('operation', 'operations') THEN w[:-2] ELSE w END AS w FROM n1),
normal AS (SELECT name, CASE WHEN len(w) > 0 THEN array_to_string(list_append(w[:-2], {singular('w[-1]')}), ' ') ELSE '' END AS norm FROM n2)"""
