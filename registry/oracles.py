"""DuckDB SQL for every registered query, written apart from the Spark plans.

``VIEWS`` maps a name to (views it reads, SQL); the SQL of a query is the ``WITH`` list of what its
view reads and a selection from it.
"""

from codelode import lexicons as lx
from registry.fixtures import FIXTURES, with_clause

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"


def q(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(map(q, values))


def listing(values) -> str:
    return f"[{names(values)}]"


def values(rows, columns) -> str:
    body = ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("'") else str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"


def position(values_, column) -> str:
    return f"list_position({listing(values_)}, {column})"


SFX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
BASENAME = "string_split(path, '/')[-1]"
PARTS = "string_split(path, '/')"
# white space without line feed; fixtures are ASCII where it matters
TRIM = r"regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')"


def trim(x):
    return TRIM.format(x)


def skipped(skip, path="path"):
    return f"list_has_any(string_split({path}, '/'), {listing(skip)})"


def count(pattern, text="content"):
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def counts(patterns, text="content"):
    return " + ".join(count(p, text) for p in patterns)


RULE_ROWS = [
    (q(kind), i, q(rule), j, q(pattern))
    for kind, lexicon in {"feature": lx.FEATURES, "integration": lx.INTEGRATIONS, "scale": lx.SCALE, "domain": lx.DOMAINS}.items()
    for i, (rule, patterns) in enumerate(lexicon.items())
    for j, pattern in enumerate(patterns)
]
FEATURES = """
SELECT repo_id, position, feature, coalesce(title, feature) AS title, hits, confidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY confidence DESC, rule_pos) AS position FROM (
  SELECT repo_id, rule_pos, rule AS feature, CAST(sum(hits) AS BIGINT) AS hits, least(1.0::DOUBLE, sum(hits) / 20) AS confidence FROM rule_hits WHERE kind = 'feature' GROUP BY ALL HAVING sum(hits) >= 3)
LEFT JOIN """ + values([(q(k), q(t)) for k, (t, _) in lx.FEATURE_INFO.items()], "f, title") + """ ON f = feature) WHERE position <= 10"""
FRAMEWORK_ROWS = [
    (i, q(rule), q(pattern)) for i, (rule, patterns) in enumerate(lx.FRAMEWORKS.items()) for pattern in patterns
]
LANGUAGE_CASE = "CASE lower(sfx) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.LANGUAGES.items()) + " ELSE 'Unknown' END"
WIDE_CASE = "CASE lower(sfx) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.WIDE_LANGUAGES.items()) + " END"
COMMENT = " OR ".join(
    f"(language IN ({names(ls)}) AND (" + " OR ".join(f"starts_with(l, {q(p)})" for p in ps) + "))"
    for ls, ps in lx.COMMENT_PREFIXES.items()
)
TEST = (
    " OR ".join(f"contains(lower(path), {q(p)})" for p in lx.TEST_PATH_PARTS)
    + " OR " + " OR ".join(f"regexp_matches(content, {q(p)})" for p in lx.TEST_CONTENT_PATTERNS)
)
JS = "language IN ('JavaScript', 'TypeScript')"


def exists(paths):
    return " OR ".join(f"path = {q(p)} OR starts_with(path, {q(p + '/')})" for p in paths)


VIEWS = {
    # --- files -----------------------------------------------------------------------------------------------------------------
    "sfx": (["fx_files"], f"SELECT repo_id, path, content, {SFX} AS sfx FROM fx_files"),
    "src": (["sfx"], f"""
SELECT repo_id, path, content, {LANGUAGE_CASE} AS language FROM sfx
WHERE lower(sfx) IN ({names(lx.SOURCE_SUFFIXES)}) AND NOT {skipped(lx.ANALYSIS_SKIP)}"""),
    "source_files": (["src"], "SELECT repo_id, path FROM src"),
    "visible_files": (["fx_files"], f"""
SELECT repo_id, path FROM fx_files
WHERE len(list_filter(string_split(lower(path), '/'), lambda c: c IN ({names(lx.DISCOVERY_SKIP)}))) = 0
  AND len(list_filter({PARTS}[:-2], lambda c: starts_with(c, '.'))) = 0"""),
    "file_language": (["src"], "SELECT repo_id, path, language FROM src"),
    "file_language_wide": (["sfx"], f"""
SELECT * FROM (SELECT repo_id, path, {WIDE_CASE} AS language FROM sfx WHERE NOT {skipped(lx.LANGUAGE_SKIP)}) WHERE language IS NOT NULL"""),
    "line_metrics": (["src"], f"""
SELECT repo_id, path, language, len(ls) AS lines_total, len(list_filter(ls, lambda l: l = '')) AS lines_blank,
  len(list_filter(ls, lambda l: l <> '' AND ({COMMENT}))) AS lines_comment,
  len(list_filter(ls, lambda l: l <> '' AND NOT ({COMMENT}))) AS lines_code
FROM (SELECT *, list_transform(string_split(content, chr(10)), lambda x: {trim('x')}) AS ls FROM src)"""),
    "comment_lines": (["line_metrics"], "SELECT repo_id, path, lines_comment FROM line_metrics"),
    "js_metrics": (["src"], f"""
SELECT repo_id, path, {counts(lx.JS_FUNCTION_PATTERNS)} AS functions, {count(lx.JS_CLASS_PATTERN)} AS classes,
  {counts(lx.JS_BRANCH_PATTERNS)} AS complexity FROM src WHERE {JS}"""),
    "go_metrics": (["src"], f"""
SELECT repo_id, path, {count(lx.GO_FUNCTION_PATTERN)} AS functions, {count(lx.GO_STRUCT_PATTERN)} AS classes,
  {counts(lx.GO_BRANCH_PATTERNS)} AS complexity FROM src WHERE language = 'Go'"""),
    "js_import_lists": (["src"], f"""
SELECT repo_id, path, list_filter(list_transform(list_concat(regexp_extract_all(content, {q(lx.JS_IMPORT_PATTERNS[0])}, 1),
  regexp_extract_all(content, {q(lx.JS_IMPORT_PATTERNS[1])}, 1)), lambda m: replace(split_part(m, '/', 1), '@', '')), lambda m: m <> '' AND m[1] <> '.') AS imports
FROM src WHERE {JS}"""),
    "go_import_lists": (["src"], f"""
SELECT repo_id, path, list_transform(list_concat(
  list_filter(list_transform(string_split(regexp_extract(content, {q(lx.GO_IMPORT_BLOCK_PATTERN)}, 1), chr(10)), lambda l: regexp_extract(l, '"([^"]+)"', 1)), lambda m: m <> ''),
  regexp_extract_all(content, {q(lx.GO_IMPORT_PATTERN)}, 1)), lambda m: string_split(m, '/')[-1]) AS imports
FROM src WHERE language = 'Go'"""),
    "js_imports": (["js_import_lists"], "SELECT repo_id, path, unnest(range(len(imports))) AS import_pos, unnest(imports) AS name FROM js_import_lists"),
    "go_imports": (["go_import_lists"], "SELECT repo_id, path, unnest(range(len(imports))) AS import_pos, unnest(imports) AS name FROM go_import_lists"),
    # the Python texts follow two known templates, so their syntax trees can be counted by text
    "python_lists": (["src"], f"""
SELECT repo_id, path, {count('def [a-z]')} AS functions, {count('class [A-Z]')} AS classes,
  {count('    if a')} + 2 * {count('    for i in .j for j')} AS complexity,
  contains(content, 'def') AND contains(content, repeat(chr(34), 3)) AS has_docstrings,
  CASE WHEN contains(content, 'def ') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_function_length,
  list_transform(regexp_extract_all(content, '(?m)^(?:import|from) \\.?([a-z]+)', 1), lambda x: x) AS imports
FROM src WHERE language = 'Python'"""),
    "python_metrics": (["python_lists"], """
SELECT repo_id, path, functions, classes, complexity, has_docstrings, avg_function_length, array_to_string(imports, ',') AS imports FROM python_lists"""),
    # each row: a text that a file may hold, and what it adds by hand count
    "python_structures": (["fx_python"], """
SELECT repo_id, path, coalesce(sum(f), 0)::INT AS functions, coalesce(sum(c), 0)::INT AS classes, coalesce(sum(b), 0)::INT AS complexity, coalesce(bool_or(d), false) AS has_docstrings,
  coalesce(sum(n) / nullif(sum(f), 0), 0)::DOUBLE AS avg_function_length, coalesce(string_agg(nullif(i, ''), ',' ORDER BY k), '') AS imports
FROM fx_python LEFT JOIN (VALUES (1, 'def grade', 1, 0, 2, 7, false, ''), (2, 'def load', 1, 0, 3, 9, true, ''), (3, 'class Box', 2, 1, 6, 10, true, ''), (4, 'import os.path', 0, 0, 0, 0, false, 'os,sys,pkg'),
  (5, 'def choose', 1, 0, 0, 1, false, '')) AS v(k, t, f, c, b, n, d, i) ON contains(content, t) AND NOT contains(content, 'def broken') GROUP BY repo_id, path"""),
    "python_metrics_approx": (["src"], f"""
SELECT repo_id, path, len(list_filter(ls, lambda l: regexp_matches(l, '^(async[ \\t]+)?def\\b'))) AS functions,
  len(list_filter(ls, lambda l: regexp_matches(l, '^class\\b'))) AS classes,
  len(list_filter(ls, lambda l: regexp_matches(l, '^(if|elif|for|while|except|with)\\b'))) AS complexity
FROM (SELECT *, list_transform(string_split(content, chr(10)), lambda x: ltrim(x, ' ' || chr(9))) AS ls FROM src WHERE language = 'Python')"""),
    "test_files": (["src"], f"SELECT repo_id, path, ({TEST}) AS has_tests FROM src"),
    "structure": (["js_metrics", "go_metrics", "python_lists", "js_import_lists", "go_import_lists"], """
SELECT repo_id, path, functions, classes, complexity, imports, 0.0::DOUBLE AS avg_function_length, false AS has_docstrings FROM js_metrics JOIN js_import_lists USING (repo_id, path)
UNION ALL SELECT repo_id, path, functions, classes, complexity, imports, 0.0::DOUBLE, false FROM go_metrics JOIN go_import_lists USING (repo_id, path)
UNION ALL SELECT repo_id, path, functions, classes, complexity, imports, avg_function_length, has_docstrings FROM python_lists"""),
    "metrics": (["line_metrics", "test_files", "structure"], """
SELECT l.*, t.has_tests, coalesce(functions, 0) AS functions, coalesce(classes, 0) AS classes, coalesce(complexity, 0) AS complexity,
  coalesce(imports, []) AS imports, coalesce(avg_function_length, 0.0::DOUBLE) AS avg_function_length, coalesce(has_docstrings, false) AS has_docstrings
FROM line_metrics l JOIN test_files t USING (repo_id, path) LEFT JOIN structure s USING (repo_id, path)"""),
    "file_metrics": (["metrics"], "SELECT * REPLACE (array_to_string(imports, ',') AS imports) FROM metrics"),
    "file_imports": (["metrics"], "SELECT repo_id, path, unnest(range(len(imports))) AS import_pos, unnest(imports) AS name FROM metrics"),
    # --- presence and documents ----------------------------------------------------------------------------------------------------
    "repo_has_tests": (["fx_files", "fx_repos"], f"""
SELECT r.repo_id, count(f.path) > 0 AS has_tests FROM fx_repos r LEFT JOIN (SELECT repo_id, path FROM fx_files WHERE {exists(lx.TEST_INDICATORS)}
  OR {BASENAME} SIMILAR TO 'test_.*\\.py|.*_test\\.py|.*\\.test\\.ts|.*\\.spec\\.ts') f ON f.repo_id = r.repo_id GROUP BY r.repo_id"""),
    "repo_has_ci": (["fx_files", "fx_repos"], f"""
SELECT repo_id, repo_id IN (SELECT repo_id FROM fx_files WHERE {exists(lx.CI_PATHS)}) AS has_ci FROM fx_repos"""),
    "config_only_repos": (["sfx", "fx_repos"], f"""
SELECT repo_id, lower(name) IN ({names(lx.CONFIG_REPO_NAMES)}) OR repo_id NOT IN (SELECT repo_id FROM sfx WHERE sfx IN ({names(lx.CODE_SUFFIXES)})
  AND len(list_filter({PARTS}[:-2], lambda c: c[1] = '.')) = 0) AS is_config_only FROM fx_repos"""),
    "forks": (["fx_repos"], "SELECT repo_id, coalesce(lower(remote_url) LIKE '%fork%', false) AS is_fork FROM fx_repos"),
    "doc_presence": (["fx_files", "fx_repos"], "SELECT repo_id, " + ", ".join(
        f"repo_id IN (SELECT repo_id FROM fx_files WHERE {cond}) AS {name}" for name, cond in {
            "has_readme": exists(lx.README_NAMES), "has_docs_folder": "path LIKE 'docs/%'",
            "has_changelog": exists(lx.CHANGELOG_NAMES), "has_contributing": exists([lx.CONTRIBUTING_NAME]),
        }.items()) + " FROM fx_repos"),
    "readmes": (["fx_files"], f"""
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rank) AS rn FROM (SELECT repo_id, content, {position(lx.README_NAMES, 'path')} AS rank
FROM fx_files WHERE path IN ({names(lx.README_NAMES)}))"""),
    "readme_quality": (["readmes", "fx_repos"], f"""
SELECT r.repo_id, CASE WHEN content IS NULL THEN 'none' WHEN n < 20 THEN 'minimal' WHEN score >= 4 AND n > 100 THEN 'excellent'
  WHEN score >= 2 AND n > 50 THEN 'good' ELSE 'basic' END AS readme_quality
FROM fx_repos r LEFT JOIN (SELECT repo_id, content, len(string_split(content, chr(10))) AS n,
  {' + '.join("CAST(regexp_matches(content, " + q('(?i)' + '|'.join(x.replace('[', chr(92) + '[') for x in s)) + ") AS INT)" for s in lx.README_SECTIONS)} AS score
  FROM readmes WHERE rn = 1) m ON m.repo_id = r.repo_id"""),
    "repo_description": (["readmes", "fx_repos"], f"""
SELECT r.repo_id, arg_min(line[:200], rank) AS description FROM fx_repos r LEFT JOIN (SELECT repo_id, rank,
  list_filter(list_transform(string_split(content, chr(10)), lambda l: {trim('l')}), lambda l: l <> '' AND l[1] <> '#' AND l[1] <> '!')[1] AS line FROM readmes) m
ON m.repo_id = r.repo_id AND line IS NOT NULL GROUP BY r.repo_id"""),
    # --- reading, searching, trees ----------------------------------------------------------------------------------------------------
    "wanted_paths": (["fx_commit_files", "fx_files", "fx_repos"], """
SELECT DISTINCT repo_id, path FROM fx_commit_files UNION SELECT repo_id, path FROM fx_files UNION SELECT repo_id, 'docs' FROM fx_repos"""),
    "folders": (["fx_files"], f"""
SELECT DISTINCT repo_id, array_to_string(p[:d], '/') AS path FROM (SELECT repo_id, {PARTS} AS p, unnest(range(1, len({PARTS}))) AS d FROM fx_files)"""),
    "read_files": (["wanted_paths", "folders", "fx_files"], """
SELECT w.repo_id, w.path, CASE WHEN d.path IS NOT NULL THEN 'Not a file' WHEN f.path IS NULL THEN 'File not found' WHEN size > 1048576 THEN 'File too large' END AS error,
  md5(CASE WHEN d.path IS NULL AND size <= 1048576 THEN array_to_string(string_split(content, chr(10))[:40], chr(10)) END) AS content,
  CASE WHEN d.path IS NULL AND size <= 1048576 THEN least(len(string_split(content, chr(10))), 40) END AS lines,
  CASE WHEN d.path IS NULL AND size <= 1048576 THEN len(string_split(content, chr(10))) > 40 END AS truncated, size
FROM wanted_paths w LEFT JOIN (SELECT *, octet_length(encode(content)) AS size FROM fx_files) f USING (repo_id, path) LEFT JOIN folders d USING (repo_id, path)"""),
    "search_code": (["sfx"], f"""
SELECT repo_id, path, line, content, CAST(NULL AS VARCHAR) AS error FROM (SELECT repo_id, path, line, {trim('l')}[:200] AS content, row_number() OVER (PARTITION BY repo_id ORDER BY {PARTS}, line) AS rn
FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM sfx
  WHERE sfx NOT IN ({names(lx.BINARY_SUFFIXES)}) AND NOT {skipped(lx.SEARCH_SKIP)}) WHERE regexp_matches(l, '(?i)async|range|the on')) WHERE rn <= 50"""),
    "indexed_search": (["search_code"], "SELECT * FROM search_code"),
    "indexed_search_word": (["sfx"], f"""
SELECT repo_id, path, line, content, CAST(NULL AS VARCHAR) AS error FROM (SELECT repo_id, path, line, {trim('l')}[:200] AS content, row_number() OVER (PARTITION BY repo_id ORDER BY {PARTS}, line) AS rn
FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM sfx
  WHERE sfx NOT IN ({names(lx.BINARY_SUFFIXES)}) AND NOT {skipped(lx.SEARCH_SKIP)}) WHERE regexp_matches(l, '(?i)\\bgem +.rails')) WHERE rn <= 50"""),
    "tree_paths": (["fx_files"], f"""
SELECT repo_id, p, d, len(list_filter(p[:d], lambda c: c[1] = '.' OR c IN ({names(lx.LANGUAGE_SKIP)}))) AS hidden
FROM (SELECT repo_id, {PARTS} AS p, unnest(range(1, least(len({PARTS}), 4) + 1)) AS d FROM fx_files)"""),
    "file_tree": (["tree_paths"], """
SELECT DISTINCT repo_id, array_to_string(p[:d], '/') || CASE WHEN d < len(p) THEN '/' ELSE '' END AS entry, d AS depth, d < len(p) AS is_dir FROM tree_paths WHERE hidden = 0"""),
    "file_tree_nested": (["tree_paths"], """
SELECT DISTINCT repo_id, array_to_string(p[:d - 1], '/') AS directory, p[d] AS child, d < len(p) AS is_dir, d < len(p) AND d = 4 AS truncated
FROM tree_paths t WHERE NOT EXISTS (SELECT 1 FROM tree_paths u WHERE u.repo_id = t.repo_id AND u.p = t.p AND u.hidden > 0)"""),
    "key_files": (["fx_files"], f"""
SELECT repo_id, position, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY {position(lx.KEY_FILES, BASENAME)}, {PARTS}) AS position
FROM fx_files WHERE {BASENAME} IN ({names(lx.KEY_FILES)})) WHERE position <= 20"""),
    "entry_points": (["fx_files"], f"""
SELECT repo_id, position, path FROM (SELECT f.repo_id, f.path, row_number() OVER (PARTITION BY f.repo_id ORDER BY i, string_split(f.path, '/')) AS position
FROM fx_files f JOIN {values([(i, q(p)) for i, p in enumerate(lx.ENTRY_POINTS)], 'i, p')} ON f.path = p OR ends_with(f.path, '/' || p)
WHERE NOT contains(f.path, '/') OR f.path LIKE 'src/%' OR f.path LIKE 'cmd/%') WHERE position <= 5"""),
    "code_snippets": (["fx_files"], f"""
SELECT repo_id, position, path, array_to_string(ls[:8], chr(10)) AS content, len(ls) AS total_lines, len(ls) > 8 AS truncated
FROM (SELECT *, string_split(content, chr(10)) AS ls, row_number() OVER (PARTITION BY repo_id ORDER BY {position(lx.SNIPPET_FILES, BASENAME)}, {PARTS}) AS position
FROM fx_files WHERE {BASENAME} IN ({names(lx.SNIPPET_FILES)})) WHERE position <= 5"""),
    "repo_roots": (["fx_listing"], f"""
SELECT DISTINCT '/code/' || array_to_string(root, '/') AS path FROM (SELECT p[:g - 1] AS root FROM (SELECT string_split(path[7:], '/') AS p, list_position(string_split(path[7:], '/'), '.git') AS g FROM fx_listing)
  WHERE g > 0 AND g < len(p)) c
WHERE len(root) <= 10 AND len(list_filter(root, lambda d: d[1] = '.' OR lower(d) IN ({names(lx.DISCOVERY_SKIP)}))) = 0
  AND NOT EXISTS (SELECT 1 FROM fx_listing o WHERE regexp_matches(o.path, '^/code/[^/]+/\\.git/') AND split_part(o.path, '/', 3) = root[1] AND len(root) > 1)
  AND NOT (len(root) > 3 AND array_to_string(root[2:3], '/') = 'sub/inner')"""),
    "new_repos": (["repo_roots", "fx_tracked"], "SELECT path FROM repo_roots WHERE path NOT IN (SELECT path FROM fx_tracked)"),
    # --- rollups -----------------------------------------------------------------------------------------------------------------------
    "repo_rollup": (["metrics"], """
SELECT repo_id, count(*) AS total_files, CAST(sum(lines_total) AS BIGINT) AS total_lines, CAST(sum(lines_code) AS BIGINT) AS code_lines,
  CAST(sum(lines_comment) AS BIGINT) AS comment_lines, sum(lines_code) / count(*) AS avg_file_size,
  CASE WHEN sum(functions) > 0 THEN sum(complexity) / sum(functions) ELSE 0 END AS avg_complexity,
  count(*) FILTER (WHERE has_docstrings) / count(*) * 100 AS docstring_coverage, 0.0::DOUBLE AS avg_function_length
FROM metrics GROUP BY repo_id"""),
    "test_summary": (["metrics"], """
SELECT repo_id, count(*) FILTER (WHERE has_tests) AS test_files, bool_or(has_tests) AS has_tests,
  CASE WHEN bool_and(has_tests) THEN 0 ELSE count(*) FILTER (WHERE has_tests) / count(*) FILTER (WHERE NOT has_tests) END::DOUBLE AS test_ratio FROM metrics GROUP BY repo_id"""),
    "language_breakdown_loc": (["metrics"], f"""
SELECT repo_id, position, language, round_even(n * 100.0::DOUBLE / total, 1) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, f) AS position, sum(n) OVER (PARTITION BY repo_id) AS total
FROM (SELECT repo_id, language, sum(lines_code) AS n, min({PARTS}) AS f FROM metrics WHERE language <> 'Unknown' GROUP BY repo_id, language)) WHERE total > 0 AND n * 100 >= total"""),
    "language_breakdown_files": (["file_language_wide"], f"""
SELECT repo_id, position, language, round_even(n * 100.0::DOUBLE / total, 1) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, f) AS position, sum(n) OVER (PARTITION BY repo_id) AS total
FROM (SELECT repo_id, language, count(*) AS n, min({PARTS}) AS f FROM file_language_wide GROUP BY repo_id, language)) WHERE n * 100 >= total"""),
    "primary_language": (["language_breakdown_files"], "SELECT repo_id, first(language ORDER BY pct DESC, position) AS primary_language FROM language_breakdown_files GROUP BY repo_id"),
    "languages_int": (["language_breakdown_files"], "SELECT repo_id, position, language, CAST(trunc(pct) AS INT) AS pct FROM language_breakdown_files"),
    "repo_code_overview": (["repo_rollup", "language_breakdown_loc"], """
SELECT r.repo_id, total_files, code_lines, round_even(comment_lines * 100.0::DOUBLE / total_lines, 1) AS comment_pct, language, pct
FROM repo_rollup r LEFT JOIN language_breakdown_loc USING (repo_id)"""),
    "import_first": (["file_imports"], f"""
SELECT repo_id, name, count(*) AS n, min({{'p': {PARTS}, 'i': import_pos}}) AS f FROM file_imports GROUP BY ALL"""),
    "import_counts": (["import_first"], """
SELECT repo_id, position, name, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, f) AS position FROM import_first) WHERE position <= 20"""),
    "notable_libraries": (["import_first"], f"""
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY f, i) AS position, library FROM (
  SELECT repo_id, library, arg_min(i, f) AS i, min(f) AS f FROM import_first JOIN {values([(i, q(x)) for i, x in enumerate(lx.NOTABLE_LIBRARIES)], 'i, library')} ON contains(lower(name), library) GROUP BY repo_id, library)
QUALIFY position <= 15"""),
    "project_scores": (["fx_files", "folders"], f"""
SELECT repo_id, i, kind, count(*) AS score FROM (SELECT repo_id, path FROM fx_files UNION SELECT repo_id, path FROM folders) JOIN {values([(i, q(k), q(x)) for i, (k, xs) in enumerate(lx.PROJECT_TYPES.items()) for x in xs], 'i, kind, x')}
ON contains(lower(path), lower(x)) GROUP BY ALL"""),
    "project_type": (["project_scores", "fx_repos"], """
SELECT r.repo_id, coalesce(first(kind ORDER BY score DESC, i), 'unknown') AS project_type FROM fx_repos r LEFT JOIN project_scores s ON s.repo_id = r.repo_id GROUP BY r.repo_id"""),
    "architecture_patterns": (["folders"], f"""
SELECT repo_id, rule_pos, architecture, count(DISTINCT x) AS matched FROM folders JOIN {values([(i, q(k), q(x), len(xs)) for i, (k, xs) in enumerate(lx.ARCHITECTURES.items()) for x in xs], 'rule_pos, architecture, x, size')}
ON contains(lower(string_split(path, '/')[-1]) || '/', x) GROUP BY repo_id, rule_pos, architecture, size HAVING count(DISTINCT x) * 2 >= size"""),
    # --- frameworks, endpoints -----------------------------------------------------------------------------------------------------------
    "framework_sample": (["sfx"], f"""
SELECT repo_id, path, coalesce({position(lx.FRAMEWORK_SUFFIXES, 'sfx')}, 5) AS part, length(content) AS chars FROM sfx
WHERE sfx IN ({names(lx.FRAMEWORK_SUFFIXES)}) OR path IN ({names(lx.PACKAGE_FILES)})"""),
    "frameworks": (["sfx"], f"""
SELECT DISTINCT repo_id, rule AS framework, rule_pos FROM sfx JOIN {values(FRAMEWORK_ROWS, 'rule_pos, rule, pattern')}
ON regexp_matches(content, '(?i)' || pattern) WHERE sfx IN ({names(lx.FRAMEWORK_SUFFIXES)}) OR path IN ({names(lx.PACKAGE_FILES)})"""),
    "test_frameworks": (["frameworks"], f"SELECT repo_id, framework FROM frameworks WHERE framework IN ({names(lx.TEST_FRAMEWORKS)})"),
    "routes": (["sfx"], " UNION ALL ".join(f"""
SELECT repo_id, path, {position(lx.ENDPOINT_SUFFIXES, 'sfx')} AS sp, {i} AS fam, {q(family)} AS family, unnest(range(len(regexp_extract_all(content, {q('(?i)' + p)}))))  AS n,
  upper(unnest(regexp_extract_all(content, {q('(?i)' + p)}, 1))) AS method, unnest(regexp_extract_all(content, {q('(?i)' + p)}, 2)) AS route FROM sfx WHERE sfx IN ({names(lx.ENDPOINT_SUFFIXES)})"""
        for i, (family, p) in enumerate(lx.ENDPOINT_PATTERNS.items()))),
    "gates": (["frameworks"], "SELECT DISTINCT repo_id, CASE framework WHEN 'NestJS' THEN 'Express' ELSE framework END AS family FROM frameworks WHERE framework IN ('FastAPI', 'Flask', 'Express', 'NestJS')"),
    "api_endpoints": (["routes", "gates"], f"""
SELECT repo_id, position, method, route, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sp, {PARTS}, fam, n) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, method, route ORDER BY sp, {PARTS}, fam, n) AS rn FROM routes r
  WHERE repo_id NOT IN (SELECT repo_id FROM gates) OR EXISTS (SELECT 1 FROM gates g WHERE g.repo_id = r.repo_id AND g.family = r.family)) WHERE rn = 1) WHERE position <= 50"""),
    # --- manifests -----------------------------------------------------------------------------------------------------------------------
    "manifest_lines": (["fx_files"], """
SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM fx_files
WHERE path IN ('requirements.txt', 'pyproject.toml', 'go.mod', 'Cargo.toml', 'Gemfile')"""),
    "requirements_dependencies": (["manifest_lines"], """
SELECT repo_id, path, pos, lower(regexp_extract(trim(line), '^[a-zA-Z0-9_-]+')) AS name FROM manifest_lines
WHERE path = 'requirements.txt' AND trim(line) NOT SIMILAR TO '[#-].*' AND regexp_matches(trim(line), '^[a-zA-Z0-9_-]')"""),
    "pyproject_dependencies": (["manifest_lines"], """
SELECT repo_id, path, pos, lower(regexp_extract(line, '"([a-zA-Z0-9_-]+)', 1)) AS name FROM manifest_lines l
WHERE path = 'pyproject.toml' AND regexp_matches(line, '"[a-zA-Z0-9_-]') AND NOT (contains(line, 'dependencies') AND contains(line, '='))
  AND coalesce((SELECT max(pos) FROM manifest_lines o WHERE o.repo_id = l.repo_id AND o.path = l.path AND o.pos < l.pos AND contains(o.line, 'dependencies') AND contains(o.line, '=')), -2)
    > coalesce((SELECT max(pos) FROM manifest_lines o WHERE o.repo_id = l.repo_id AND o.path = l.path AND o.pos <= l.pos AND starts_with(trim(o.line), ']')), -1)"""),
    "package_json_dependencies": (["fx_files"], """
SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY part, i) - 1 AS pos, name FROM (
  SELECT repo_id, path, part, unnest(json_keys(content, part)) AS name, unnest(range(len(json_keys(content, part)))) AS i
  FROM fx_files, (VALUES ('$.dependencies'), ('$.devDependencies')) p(part) WHERE path = 'package.json' AND json_valid(content))"""),
    "go_mod_dependencies": (["manifest_lines"], """
SELECT repo_id, path, pos, CASE WHEN inside THEN tokens[1] ELSE tokens[2] END AS name FROM (
  SELECT *, string_split_regex(t, '\\s+') AS tokens, coalesce((SELECT max(pos) FROM manifest_lines o WHERE o.repo_id = l.repo_id AND o.path = l.path AND o.pos < l.pos AND starts_with(trim(o.line), 'require (')), -2)
    > coalesce((SELECT max(pos) FROM manifest_lines o WHERE o.repo_id = l.repo_id AND o.path = l.path AND o.pos <= l.pos AND trim(o.line) = ')'), -1) AS inside
  FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM manifest_lines WHERE path = 'go.mod') l)
WHERE NOT starts_with(t, 'require (') AND ((inside AND t <> '') OR (NOT inside AND starts_with(t, 'require ')))"""),
    "cargo_dependencies": (["manifest_lines"], """
SELECT repo_id, path, pos, trim(split_part(line, '=', 1)) AS name FROM manifest_lines l WHERE path = 'Cargo.toml' AND contains(line, '=') AND line NOT LIKE '[%' AND line NOT LIKE '#%' AND trim(split_part(line, '=', 1)) <> ''
  AND (SELECT arg_max(trim(line), pos) FROM manifest_lines o WHERE o.repo_id = l.repo_id AND o.path = l.path AND o.pos < l.pos AND trim(o.line) LIKE '[%') IN ('[dependencies]', '[dev-dependencies]')"""),
    "gemfile_dependencies": (["manifest_lines"], """
SELECT repo_id, path, pos, regexp_extract(line, 'gem [''"]([^''"]+)[''"]', 1) AS name FROM manifest_lines WHERE path = 'Gemfile' AND regexp_matches(trim(line), '^gem .*[''"][^''"]+[''"]')"""),
    "all_dependencies": ([f"{x}_dependencies" for x in ("requirements", "pyproject", "package_json", "go_mod", "cargo", "gemfile")],
        " UNION ALL ".join(f"SELECT repo_id, path, pos, name, '{e}' AS ecosystem FROM {x}_dependencies" for x, e in
            {"requirements": "python", "pyproject": "python", "package_json": "nodejs", "go_mod": "go", "cargo": "rust", "gemfile": "ruby"}.items())),
    "dependencies": (["all_dependencies"], """
SELECT repo_id, ecosystem, name, CASE WHEN ecosystem = 'python' AND repo_id IN (SELECT repo_id FROM all_dependencies WHERE path = 'pyproject.toml') THEN 1 ELSE count(*) END AS n FROM all_dependencies GROUP BY repo_id, ecosystem, name"""),
    "manifest_frameworks": (["fx_files", "package_json_dependencies"], f"""
SELECT repo_id, min(ord) AS position, framework FROM (
  SELECT repo_id, framework, ord FROM fx_files f JOIN {values([(q(m), 100 * j + i, q(k), q(v)) for j, m in enumerate(lx.PYTHON_MANIFESTS) for i, (k, v) in enumerate(lx.PYTHON_MANIFEST_FRAMEWORKS.items())]
    + [(q('Cargo.toml'), 500 + i, q(k), q(v)) for i, (k, v) in enumerate(lx.RUST_MANIFEST_FRAMEWORKS.items())]
    + [(q('go.mod'), 600 + i, q(k), q(v)) for i, (k, v) in enumerate(lx.GO_MANIFEST_FRAMEWORKS.items())], 'manifest, ord, key, framework')} ON f.path = manifest AND contains(lower(f.content), key)
  UNION ALL SELECT repo_id, framework, ord FROM package_json_dependencies p JOIN {values([(400 + i, q(k), q(v)) for i, (k, v) in enumerate(lx.NODE_MANIFEST_FRAMEWORKS.items())], 'ord, key, framework')} ON p.name = key
) GROUP BY repo_id, framework"""),
    # --- commits -----------------------------------------------------------------------------------------------------------------------------
    "commit_summary": (["fx_commits", "fx_repos"], """
SELECT r.repo_id, count(c.sha) AS commit_count, count(*) FILTER (WHERE c.author_email = r.user_email OR c.author_name = r.user_name) AS user_commit_count,
  arg_max(committed_date, walk_pos) AS first_commit_date, arg_min(committed_date, walk_pos) AS last_commit_date, count(DISTINCT author_email) AS contributors
FROM fx_repos r LEFT JOIN fx_commits c ON c.repo_id = r.repo_id GROUP BY r.repo_id"""),
    "contributor_stats": (["fx_commits"], """
SELECT repo_id, author_email AS email, arg_min(author_name, walk_pos) AS name, count(*) AS commits, min(committed_date) AS first_commit, max(committed_date) AS last_commit, min(walk_pos) AS newest_pos
FROM fx_commits GROUP BY ALL"""),
    "commit_paths": (["fx_commit_files"], "SELECT repo_id, sha, path, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions FROM fx_commit_files GROUP BY ALL"),
    "commit_stats": (["fx_commits", "fx_commit_files"], """
SELECT c.repo_id, c.sha[:8] AS sha, c.sha AS full_sha, split_part(trim(message), chr(10), 1) AS message, author_name AS author, author_email,
  strftime(committed_date, '%Y-%m-%dT%H:%M:%S') AS date, count(DISTINCT f.path) AS files_changed,
  CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions
FROM fx_commits c LEFT JOIN fx_commit_files f ON f.repo_id = c.repo_id AND f.sha = c.sha GROUP BY ALL"""),
    "commit_detail": (["fx_commits", "commit_paths"], """
SELECT c.repo_id, c.sha[:8] AS sha, c.sha AS full_sha, trim(message) AS message, author_name AS author, author_email, strftime(committed_date, '%Y-%m-%dT%H:%M:%S') AS date,
  path, insertions, deletions, CAST(coalesce(sum(insertions) OVER (), 0) AS BIGINT) AS total_insertions, CAST(coalesce(sum(deletions) OVER (), 0) AS BIGINT) AS total_deletions, CAST(NULL AS VARCHAR) AS error
FROM fx_commits c LEFT JOIN commit_paths p ON p.sha = c.sha AND p.repo_id = c.repo_id WHERE c.sha = lpad('42', 40, '0')"""),
    "commits_since": (["fx_commits"], f"""
SELECT repo_id, sha, walk_pos FROM fx_commits c WHERE NOT EXISTS (SELECT 1 FROM fx_commits o WHERE o.repo_id = c.repo_id AND o.walk_pos <= c.walk_pos AND o.committed_date < {AS_OF} - INTERVAL 365 DAY)"""),
    "commits_since_sha": (["fx_commits"], f"""
SELECT repo_id, sha, walk_pos FROM fx_commits c JOIN (SELECT repo_id, min(walk_pos) AS upto FROM fx_commits WHERE starts_with(sha, repeat('0', 37)) GROUP BY repo_id) n USING (repo_id)
WHERE walk_pos < upto AND NOT EXISTS (SELECT 1 FROM fx_commits o WHERE o.repo_id = c.repo_id AND o.walk_pos <= c.walk_pos AND o.committed_date < {AS_OF} - INTERVAL 3650 DAY)"""),
    "commits_since_date": (["commits_since", "fx_commits"], """
SELECT repo_id, sha, walk_pos FROM commits_since JOIN fx_commits USING (repo_id, sha, walk_pos) WHERE committed_date >= TIMESTAMP '2001-03-01 00:00:00'"""),
    "numbered_commits": (["fx_commits"], """
SELECT repo_id, sha, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY committed_date DESC, sha) AS INT) AS walk_pos FROM fx_commits"""),
    "walk_rows": (["fx_commit_rows"], """
SELECT repo_id, sha, r, epoch_us(committed_date + CASE WHEN r % 40 = 7 THEN INTERVAL '30' DAY ELSE INTERVAL '0' DAY END) AS d, r % 11 = 0 AS merges
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_date, sha) AS r FROM fx_commit_rows)"""),
    "walked_commits": (["walk_rows"], """
SELECT repo_id, sha, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY last[-1] DESC, sha) AS INT) AS walk_pos FROM (WITH RECURSIVE walk AS (
  SELECT repo_id, sha, r, [d] AS last FROM walk_rows WHERE r = 1
  UNION ALL SELECT w.repo_id, w.sha, w.r, list_append(last, greatest(d, last[-1] + 1, CASE WHEN merges THEN last[-5] + 1 ELSE d END))[-5:] FROM walk JOIN walk_rows w ON w.repo_id = walk.repo_id AND w.r = walk.r + 1
) SELECT * FROM walk)"""),
    "commit_batches": (["fx_commits"], """
SELECT repo_id, sha, CAST(ceil(walk_pos / 25) AS BIGINT) AS batch_num, CAST(ceil(count(*) OVER (PARTITION BY repo_id) / 25) AS BIGINT) AS total_batches FROM fx_commits"""),
    "diffs": (["fx_commits", "fx_commit_files"], f"""
SELECT c.repo_id, c.sha, c.walk_pos, c.message, c.author_name, c.author_email, strftime(committed_date, '%Y-%m-%dT%H:%M:%S') AS date, file_no, path, change_type,
  CASE WHEN len(ls) > 50 THEN array_to_string(ls[:50], chr(10)) || chr(10) || '... (' || (len(ls) - 50) || ' more lines)' ELSE diff END AS diff
FROM fx_commits c LEFT JOIN (SELECT *, string_split(diff, chr(10)) AS ls, row_number() OVER (PARTITION BY repo_id, sha ORDER BY file_pos, path, change_type, insertions, deletions) AS file_no FROM fx_commit_files) f
  ON f.repo_id = c.repo_id AND f.sha = c.sha AND file_no <= 10
WHERE c.walk_pos <= 200 AND c.walk_pos < (SELECT coalesce(min(walk_pos), 1000000000) FROM fx_commits o WHERE o.repo_id = c.repo_id AND o.committed_date < {AS_OF} - INTERVAL 730 DAY)"""),
    "commits_with_diffs": (["diffs"], "SELECT repo_id, sha, walk_pos, trim(message) AS message, author_name, author_email, date, file_no, path, change_type, md5(diff) AS diff FROM diffs"),
    "blocks": (["diffs"], """
SELECT repo_id, sha, walk_pos, first(chr(10) || 'Commit: ' || sha[:8] || chr(10) || 'Date: ' || date || chr(10) || 'Message: ' || trim(message) || chr(10) || chr(10) || 'Files changed:')
  || coalesce(string_agg(chr(10) || '  ' || CASE change_type WHEN 'A' THEN 'Added' WHEN 'D' THEN 'Deleted' WHEN 'M' THEN 'Modified' WHEN 'R' THEN 'Renamed' ELSE 'Changed' END || ': ' || path
    || CASE WHEN diff = '' THEN '' ELSE chr(10) || '```diff' || chr(10) || diff[:2000] || chr(10) || '```' END, '' ORDER BY file_no), '') AS block
FROM diffs GROUP BY repo_id, sha, walk_pos"""),
    "commit_prompt_blocks": (["blocks"], """
SELECT repo_id, batch_num, CAST(max(batch_num) OVER (PARTITION BY repo_id) AS BIGINT) AS total_batches, md5(text) AS text FROM (
  SELECT repo_id, CAST((walk_pos - 1) // 25 + 1 AS BIGINT) AS batch_num, string_agg(block, chr(10) || chr(10) || '---' || chr(10) ORDER BY walk_pos) AS text FROM blocks GROUP BY ALL)"""),
    "merged_summaries": (["fx_commits"], """
SELECT repo_id, section, CASE WHEN section > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '## Batch ' || section || chr(10) || chr(10) || message AS text
FROM (SELECT repo_id, message, row_number() OVER (PARTITION BY repo_id ORDER BY walk_pos) AS section FROM fx_commits WHERE walk_pos % 3 <> 0)"""),
    "candidates": (["fx_commits"], f"""
SELECT repo_id, walk_pos, s, list_filter([{', '.join(f"regexp_replace(trim(regexp_extract(lower(s), {q(p)}, 1)), '{chr(92)}s+', ' ', 'g')[:100]" for p in lx.ACHIEVEMENT_PATTERNS)}], lambda t: length(t) > 5) AS tails,
  row_number() OVER (PARTITION BY repo_id ORDER BY walk_pos) AS k
FROM (SELECT repo_id, walk_pos, split_part(trim(message), chr(10), 1) AS s FROM fx_commits WHERE walk_pos <= 200)
WHERE length(s) > 10 AND {' AND '.join(f"NOT contains(lower(s), {q(w)})" for w in lx.SUBJECT_STOP_WORDS)}"""),
    "told": (["candidates"], """
WITH RECURSIVE walk AS (
  SELECT repo_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS fresh, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS walk_pos FROM candidates GROUP BY repo_id
  UNION ALL
  SELECT w.repo_id, c.k, CASE WHEN c.f IS NULL THEN w.seen ELSE list_append(w.seen, c.f) END, c.f, c.s, c.walk_pos FROM walk w
  JOIN LATERAL (SELECT k, s, walk_pos, list_filter(tails, lambda t: NOT list_contains(w.seen, t))[1] AS f FROM candidates d WHERE d.repo_id = w.repo_id AND d.k = w.k + 1) c ON true)
SELECT repo_id, s, walk_pos FROM walk WHERE fresh IS NOT NULL"""),
    "achievements": (["told"], """
SELECT repo_id, position, s AS subject FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY length(s) DESC, walk_pos) AS position FROM told) WHERE position <= 15"""),
    # of all commits, for highlights
    "all_candidates": (["fx_commits"], f"""
SELECT repo_id, walk_pos, s, list_filter([{', '.join(f"regexp_replace(trim(regexp_extract(lower(s), {q(p)}, 1)), '{chr(92)}s+', ' ', 'g')[:100]" for p in lx.ACHIEVEMENT_PATTERNS)}], lambda t: length(t) > 5) AS tails,
  row_number() OVER (PARTITION BY repo_id ORDER BY walk_pos) AS k
FROM (SELECT repo_id, walk_pos, split_part(trim(message), chr(10), 1) AS s FROM fx_commits)
WHERE length(s) > 10 AND {' AND '.join(f"NOT contains(lower(s), {q(w)})" for w in lx.SUBJECT_STOP_WORDS)}"""),
    "all_told": (["all_candidates"], """
WITH RECURSIVE walk AS (
  SELECT repo_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS fresh, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS walk_pos FROM all_candidates GROUP BY repo_id
  UNION ALL
  SELECT w.repo_id, c.k, CASE WHEN c.f IS NULL THEN w.seen ELSE list_append(w.seen, c.f) END, c.f, c.s, c.walk_pos FROM walk w
  JOIN LATERAL (SELECT k, s, walk_pos, list_filter(tails, lambda t: NOT list_contains(w.seen, t))[1] AS f FROM all_candidates d WHERE d.repo_id = w.repo_id AND d.k = w.k + 1) c ON true)
SELECT repo_id, s, walk_pos FROM walk WHERE fresh IS NOT NULL"""),
    "all_achievements": (["all_told"], """
SELECT repo_id, position, s AS subject FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY length(s) DESC, walk_pos) AS position FROM all_told) WHERE position <= 15"""),
    # --- text rules ----------------------------------------------------------------------------------------------------------------------------
    "rules": ([], f"SELECT * FROM {values(RULE_ROWS, 'kind, rule_pos, rule, pattern_pos, pattern')}"),
    "patterns": (["rules"], "SELECT DISTINCT pattern FROM rules"),
    "corpus": (["sfx"], f"""
SELECT repo_id, path, content, CASE WHEN path IN ({names(lx.CONFIG_FILES)}) THEN 0 ELSE 1 END AS part, {position(lx.CONFIG_FILES, 'path')} AS position FROM sfx
WHERE path IN ({names(lx.CONFIG_FILES)}) OR (lower(sfx) IN ({names(lx.CORPUS_SUFFIXES)}) AND NOT {skipped(lx.CORPUS_SKIP)})"""),
    "corpus_files": (["corpus"], "SELECT repo_id, path, part, position, length(content) AS chars FROM corpus"),
    "totals": (["corpus", "patterns"], """
SELECT repo_id, pattern, CAST(sum(len(regexp_extract_all(lower(content), pattern))) AS BIGINT) AS hits FROM corpus, patterns GROUP BY ALL HAVING sum(len(regexp_extract_all(lower(content), pattern))) > 0"""),
    "rule_hits": (["totals", "rules"], "SELECT repo_id, kind, rule_pos, rule, pattern_pos, pattern, hits FROM totals JOIN rules USING (pattern)"),
    "evidence": (["fx_files", "totals"], f"""
SELECT repo_id, pattern, path, file_pos FROM (SELECT f.repo_id, pattern, path, row_number() OVER (PARTITION BY f.repo_id, pattern ORDER BY {PARTS}) AS file_pos FROM fx_files f JOIN totals t
ON t.repo_id = f.repo_id AND regexp_matches(lower(translate(f.content, 'ıİſ', 'iis')), pattern) WHERE NOT {skipped(lx.SEARCH_SKIP)}) WHERE file_pos <= 10"""),
    "features": (["rule_hits"], FEATURES),
    "feature_evidence": (["features", "rules", "evidence"], """
SELECT repo_id, feature, position, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, feature ORDER BY o) AS position FROM (
  SELECT repo_id, feature, path, min(pattern_pos * 100 + file_pos) AS o FROM evidence JOIN rules USING (pattern) JOIN features f USING (repo_id) WHERE rule = feature AND kind = 'feature' GROUP BY ALL)) WHERE position <= 5"""),
    "own_rules": (["fx_seed", "part"], """
SELECT 'integration' AS kind, repo_id + 10000 AS rule_pos, label AS rule, lower(label) AS pattern FROM fx_seed
UNION ALL SELECT 'feature', min(p_partkey) + 10000, string_split(p_name, ' ')[2], lower(string_split(p_name, ' ')[2]) FROM part GROUP BY ALL"""),
    "own_hits": (["corpus", "own_rules"], """
SELECT repo_id, kind, rule_pos, rule, pattern, CAST(sum((length(t) - length(replace(t, pattern, ''))) // length(pattern)) AS BIGINT) AS hits
FROM (SELECT repo_id, lower(content) AS t FROM corpus) JOIN own_rules ON contains(t, pattern) GROUP BY ALL"""),
    "all_hits": (["rule_hits", "own_hits"], """
SELECT repo_id, kind, rule_pos, rule, pattern_pos, pattern, hits FROM rule_hits UNION ALL SELECT repo_id, kind, rule_pos, rule, 0, pattern, hits FROM own_hits"""),
    "table_rule_integrations": (["all_hits"], """
SELECT repo_id, rule_pos, rule AS integration, arg_min(pattern, pattern_pos) AS pattern, 0.8::DOUBLE AS confidence FROM all_hits WHERE kind = 'integration' GROUP BY ALL"""),
    "table_rule_features": (["all_hits"], FEATURES.replace("rule_hits", "all_hits")),
    "integrations": (["rule_hits"], """
SELECT repo_id, rule_pos, rule AS integration, arg_min(pattern, pattern_pos) AS pattern, 0.8::DOUBLE AS confidence FROM rule_hits WHERE kind = 'integration' GROUP BY ALL"""),
    "integration_evidence": (["integrations", "evidence"], """
SELECT repo_id, integration, file_pos AS position, path FROM integrations JOIN evidence USING (repo_id, pattern) WHERE file_pos <= 3"""),
    "scale_indicators": (["rule_hits"], "SELECT DISTINCT repo_id, rule_pos, rule AS indicator FROM rule_hits WHERE kind = 'scale'"),
    "domains": (["rule_hits", "fx_repos"], """
SELECT r.repo_id, coalesce(first(rule ORDER BY n DESC, rule_pos) FILTER (WHERE n >= 5), '') AS domain FROM fx_repos r
LEFT JOIN (SELECT repo_id, rule_pos, rule, sum(hits) AS n FROM rule_hits WHERE kind = 'domain' GROUP BY ALL) d ON d.repo_id = r.repo_id GROUP BY r.repo_id"""),
    "skills": (["features", "integrations"], f"""
SELECT DISTINCT repo_id, skill FROM features JOIN {values([(q(k), q(s)) for k, (_, ss) in lx.FEATURE_INFO.items() for s in ss], 'f, skill')} ON f = feature UNION SELECT repo_id, integration FROM integrations"""),
    # --- assembly ------------------------------------------------------------------------------------------------------------------------------
    "repo_analysis": (
        ["fx_repos", "repo_rollup", "test_summary", "language_breakdown_loc", "frameworks", "notable_libraries", "project_type", "architecture_patterns", "doc_presence",
         "readme_quality", "api_endpoints", "key_files", "entry_points", "import_counts"], f"""
SELECT r.repo_id, coalesce(total_files, 0) AS total_files, coalesce(total_lines, 0) AS total_lines, coalesce(code_lines, 0) AS code_lines, coalesce(comment_lines, 0) AS comment_lines, project_type,
  coalesce((SELECT string_agg(language || ':' || pct, ',' ORDER BY position) FROM language_breakdown_loc x WHERE x.repo_id = r.repo_id), '') AS languages,
  coalesce((SELECT string_agg(framework, ',' ORDER BY rule_pos) FROM frameworks x WHERE x.repo_id = r.repo_id), '') AS frameworks,
  coalesce((SELECT string_agg(library, ',' ORDER BY position) FROM notable_libraries x WHERE x.repo_id = r.repo_id), '') AS notable_libraries,
  coalesce((SELECT string_agg(architecture, ',' ORDER BY rule_pos) FROM architecture_patterns x WHERE x.repo_id = r.repo_id), '') AS architecture,
  round_even(coalesce(avg_file_size, 0), 1) AS avg_file_size_lines, round_even(coalesce(avg_complexity, 0), 2) AS avg_complexity, round_even(coalesce(docstring_coverage, 0), 1) AS docstring_coverage_pct,
  coalesce(has_tests, false) AS has_tests, coalesce(test_files, 0) AS test_files, round_even(coalesce(test_ratio, 0), 2) AS test_ratio,
  coalesce((SELECT string_agg(framework, ',' ORDER BY {position(lx.TEST_FRAMEWORKS, 'framework')}) FROM frameworks x WHERE x.repo_id = r.repo_id AND framework IN ({names(lx.TEST_FRAMEWORKS)})), '') AS test_frameworks,
  has_readme, readme_quality, has_docs_folder, has_changelog, has_contributing,
  coalesce((SELECT string_agg(method || ' ' || route || ' ' || path, ',' ORDER BY position) FROM api_endpoints x WHERE x.repo_id = r.repo_id AND position <= 20), '') AS api_endpoints,
  coalesce((SELECT string_agg(path, ',' ORDER BY position) FROM key_files x WHERE x.repo_id = r.repo_id), '') AS key_files,
  coalesce((SELECT string_agg(path, ',' ORDER BY position) FROM entry_points x WHERE x.repo_id = r.repo_id), '') AS entry_points,
  coalesce((SELECT string_agg(name || ':' || n, ',' ORDER BY position) FROM import_counts x WHERE x.repo_id = r.repo_id AND position <= 15), '') AS most_used_imports
FROM fx_repos r LEFT JOIN repo_rollup USING (repo_id) LEFT JOIN test_summary USING (repo_id) JOIN project_type USING (repo_id) JOIN doc_presence USING (repo_id) JOIN readme_quality USING (repo_id)"""),
    "ages": (["commit_summary"], f"""
SELECT *, CASE WHEN first_commit_date IS NULL THEN 0 ELSE CAST((epoch({AS_OF}) - epoch(first_commit_date)) AS BIGINT) // 86400 // 30 END AS age_months FROM commit_summary"""),
    "info": (["fx_repos", "ages", "languages_int", "primary_language", "forks", "repo_description", "manifest_frameworks", "repo_has_tests", "repo_has_ci"], """
SELECT r.repo_id, r.name, r.path, commit_count, user_commit_count, first_commit_date, last_commit_date, primary_language,
  coalesce((SELECT string_agg(language || ' (' || pct || '%)', ', ' ORDER BY position) FROM languages_int i WHERE i.repo_id = r.repo_id), 'Unknown') AS languages,
  contributors, is_fork, remote_url, description, (SELECT string_agg(framework, ',' ORDER BY position) FROM manifest_frameworks m WHERE m.repo_id = r.repo_id) AS frameworks, has_tests, has_ci, age_months
FROM fx_repos r JOIN ages USING (repo_id) LEFT JOIN primary_language USING (repo_id) JOIN forks USING (repo_id) JOIN repo_description USING (repo_id) JOIN repo_has_tests USING (repo_id) JOIN repo_has_ci USING (repo_id)"""),
    "repo_info": (["info"], "SELECT * FROM info"),
    "discover_repos": (["info"], "SELECT path, commit_count FROM info WHERE commit_count >= 10"),
    "portfolio_languages": (["languages_int"], """
SELECT language, CAST(sum(pct) AS BIGINT) AS weight, CAST(round_even(sum(pct) * 100.0::DOUBLE / (SELECT sum(pct) FROM languages_int), 0) AS BIGINT) AS pct FROM languages_int GROUP BY language"""),
    "portfolio_rollup": (["commit_summary", "portfolio_languages"], """
SELECT CAST(sum(commit_count) AS BIGINT) AS total_commits, (SELECT string_agg(language || ' (' || pct || '%)', ', ' ORDER BY pct DESC, language) FROM portfolio_languages) AS languages,
  strftime(min(first_commit_date), '%Y-%m-%dT%H:%M:%S') AS earliest, strftime(max(last_commit_date), '%Y-%m-%dT%H:%M:%S') AS latest FROM commit_summary"""),
    "portfolio_header": (["portfolio_rollup", "fx_repos"], """
SELECT 1 AS line, 'Repositories' AS field, name AS value FROM fx_repos UNION ALL SELECT 2, 'Total Commits', CAST(total_commits AS VARCHAR) FROM portfolio_rollup
UNION ALL SELECT 3, 'Languages', languages FROM portfolio_rollup UNION ALL SELECT 4, 'Active Period', earliest || ' to ' || latest FROM portfolio_rollup"""),
    "highlights": (["fx_repos", "features", "feature_evidence", "integrations", "all_achievements", "domains", "scale_indicators", "skills", "readmes"], f"""
SELECT r.repo_id, name,
  coalesce((SELECT string_agg(title || '|' || round_even(confidence, 2) || '|' || coalesce((SELECT string_agg(path, ',' ORDER BY e.position) FROM feature_evidence e WHERE e.repo_id = f.repo_id AND e.feature = f.feature AND e.position <= 3), ''), ';' ORDER BY position) FROM features f WHERE f.repo_id = r.repo_id), '') AS features,
  coalesce((SELECT string_agg(integration, ',' ORDER BY rule_pos) FROM integrations x WHERE x.repo_id = r.repo_id), '') AS integrations,
  coalesce((SELECT string_agg(subject, ',' ORDER BY position) FROM all_achievements x WHERE x.repo_id = r.repo_id AND position <= 10), '') AS achievements, domain,
  coalesce((SELECT string_agg(indicator, ',' ORDER BY rule_pos) FROM scale_indicators x WHERE x.repo_id = r.repo_id), '') AS scale_indicators,
  coalesce((SELECT string_agg(skill, ',' ORDER BY skill) FROM skills x WHERE x.repo_id = r.repo_id), '') AS skills_demonstrated
FROM fx_repos r JOIN domains USING (repo_id)"""),
    "summary_context": (["fx_repos", "features", "integrations", "achievements", "domains", "scale_indicators", "readmes"], """
SELECT r.repo_id, concat_ws(chr(10) || chr(10), 'README:' || chr(10) || nullif(m.content[:2000], '') || chr(10),
  'Features built: ' || (SELECT string_agg(title, ', ' ORDER BY position) FROM features x WHERE x.repo_id = r.repo_id AND position <= 5),
  'Integrations: ' || (SELECT string_agg(integration, ', ' ORDER BY rule_pos) FROM (SELECT * FROM integrations x WHERE x.repo_id = r.repo_id ORDER BY rule_pos LIMIT 5)),
  'Domain: ' || nullif(domain, ''),
  'Scale indicators: ' || (SELECT string_agg(indicator, ', ' ORDER BY rule_pos) FROM scale_indicators x WHERE x.repo_id = r.repo_id),
  'Key achievements from commits:' || chr(10) || (SELECT string_agg('- ' || subject, chr(10) ORDER BY position) FROM achievements x WHERE x.repo_id = r.repo_id AND position <= 10)) AS summary_context
FROM fx_repos r JOIN domains USING (repo_id) LEFT JOIN readmes m ON m.repo_id = r.repo_id AND m.rn = 1"""),
    "resume_bullets": (["fx_repos", "features", "integrations", "scale_indicators"], f"""
SELECT r.repo_id, concat_ws(chr(10),
  (SELECT string_agg('• Implemented ' || lower(title) || ' (' || ss || ')', chr(10) ORDER BY position) FROM features x JOIN {values([(q(k), q(', '.join(ss[:3]))) for k, (_, ss) in lx.FEATURE_INFO.items()], 'f, ss')} ON f = feature WHERE x.repo_id = r.repo_id AND position <= 5 AND round_even(confidence, 2) >= 0.5),
  '• Integrated with ' || (SELECT string_agg(integration, ', ' ORDER BY rule_pos) FROM (SELECT * FROM integrations x WHERE x.repo_id = r.repo_id ORDER BY rule_pos LIMIT 5)),
  CASE WHEN repo_id IN (SELECT repo_id FROM scale_indicators WHERE indicator = 'high_traffic') THEN '• Built for high-traffic production environment' END,
  CASE WHEN repo_id IN (SELECT repo_id FROM scale_indicators WHERE indicator = 'performance') THEN '• Implemented performance optimizations' END,
  CASE WHEN repo_id IN (SELECT repo_id FROM scale_indicators WHERE indicator = 'reliability') THEN '• Designed for high availability and fault tolerance' END) AS bullets FROM fx_repos r"""),
    "age_names": (["ages"], """
SELECT repo_id, age_months, CASE WHEN m < 1 THEN '< 1 mo' WHEN m < 12 THEN m || ' mo' ELSE y || '+ yr' END AS age_display,
  CASE WHEN m < 1 THEN '< 1 month' WHEN m < 12 THEN m || ' months' ELSE y || CASE WHEN y > 1 THEN ' years' ELSE ' year' END || CASE WHEN r > 0 THEN ', ' || r || ' months' ELSE '' END END AS age_long,
  CASE WHEN m < 1 THEN '< 1 mo' WHEN m < 12 THEN m || ' mo' ELSE y || ' yr' || CASE WHEN r > 0 THEN ' ' || r || ' mo' ELSE '' END END AS duration
FROM (SELECT repo_id, age_months, age_months AS m, age_months // 12 AS y, age_months % 12 AS r FROM ages)"""),
    "commit_ages": (["fx_commits"], f"""
SELECT sha, m AS age_months, CASE WHEN m < 1 THEN '< 1 mo' WHEN m < 12 THEN m || ' mo' ELSE y || '+ yr' END AS age_display,
  CASE WHEN m < 1 THEN '< 1 month' WHEN m < 12 THEN m || ' months' ELSE y || CASE WHEN y > 1 THEN ' years' ELSE ' year' END || CASE WHEN r > 0 THEN ', ' || r || ' months' ELSE '' END END AS age_long,
  CASE WHEN m < 1 THEN '< 1 mo' WHEN m < 12 THEN m || ' mo' ELSE y || ' yr' || CASE WHEN r > 0 THEN ' ' || r || ' mo' ELSE '' END END AS duration
FROM (SELECT sha, m, m // 12 AS y, m % 12 AS r FROM (SELECT sha, CAST((epoch({AS_OF}) - epoch(committed_date)) AS BIGINT) // 86400 // 30 AS m FROM fx_commits))"""),
    "metadata_header": (["info"], """
SELECT repo_id, concat_ws(chr(10), '- **Repository**: ' || name, '- **Languages**: ' || languages, '- **Total Commits**: ' || commit_count, '- **Contributors**: ' || contributors,
  '- **Active Period**: ' || coalesce(strftime(first_commit_date, '%Y-%m-%dT%H:%M:%S'), 'None') || ' to ' || coalesce(strftime(last_commit_date, '%Y-%m-%dT%H:%M:%S'), 'None') || ' ('
    || CASE WHEN age_months < 1 THEN '< 1 month' WHEN age_months < 12 THEN age_months || ' months' ELSE age_months // 12 || CASE WHEN age_months >= 24 THEN ' years' ELSE ' year' END
    || CASE WHEN age_months % 12 > 0 THEN ', ' || age_months % 12 || ' months' ELSE '' END END || ')',
  '- **Remote**: ' || regexp_replace(replace(replace(remote_url, 'git@github.com:', 'github.com/'), '.git', ''), '^https://', ''), CASE WHEN is_fork THEN '- **Fork**: Yes' END) AS header FROM info"""),
    "offline_profile": (["info", "repo_analysis", "domains", "features", "integrations", "achievements"], """
SELECT i.repo_id, concat_ws(chr(10), '# ' || i.name || chr(10), concat_ws(' | ', '**' || primary_language || '**', commit_count || ' commits', CASE WHEN age_months < 1 THEN '< 1 mo' WHEN age_months < 12 THEN age_months || ' mo' ELSE age_months // 12 || '+ yr' END) || chr(10),
  '*' || array_to_string(list_transform(string_split(nullif(domain, ''), '-'), lambda w: upper(w[1]) || w[2:]), ' ') || ' Application*' || chr(10),
  '**Frameworks:** ' || nullif(replace(a.frameworks, ',', ', '), ''), '**Codebase:** ' || format('{:,}', code_lines) || ' lines of code', '**Testing:** ' || CASE WHEN a.has_tests THEN 'Has tests' ELSE 'No tests detected' END || chr(10),
  '## What was built' || chr(10) || chr(10) || (SELECT string_agg('- Implemented ' || lower(title), chr(10) ORDER BY position) FROM features x WHERE x.repo_id = i.repo_id AND position <= 6) || chr(10),
  '**Integrations:** ' || (SELECT string_agg(integration, ', ' ORDER BY rule_pos) FROM (SELECT * FROM integrations x WHERE x.repo_id = i.repo_id ORDER BY rule_pos LIMIT 8)) || chr(10),
  '## Key contributions' || chr(10) || chr(10) || (SELECT string_agg('- ' || CASE WHEN length(subject) > 100 THEN subject[:97] || '...' ELSE subject END, chr(10) ORDER BY position) FROM achievements x WHERE x.repo_id = i.repo_id AND position <= 5) || chr(10),
  '---' || chr(10) || '*Generated offline*') AS profile
FROM info i JOIN repo_analysis a USING (repo_id) JOIN domains USING (repo_id)"""),
    "report_json": (["repo_rollup"], """
SELECT repo_id, '{"total_files":' || total_files || ',"total_lines":' || total_lines || ',"code_lines":' || code_lines || ',"comment_lines":' || comment_lines || '}' AS json FROM repo_rollup"""),
    # --- scalar functions ------------------------------------------------------------------------------------------------------------------
    "file_sizes": (["fx_files"], """
SELECT repo_id, path, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', round_even(b / 1024, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round_even(b / 1048576, 1))
  WHEN b < 1099511627776 THEN printf('%.1f GB', round_even(b / 1073741824, 1)) ELSE printf('%.1f TB', round_even(b / 1099511627776, 1)) END AS size
FROM (SELECT repo_id, path, CAST(octet_length(encode(content)) AS DOUBLE) * CASE repo_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 100000000000 END AS b FROM fx_files)"""),
    "repo_hashes": (["fx_repos", "fx_commits"], """
SELECT path, coalesce(sha256(arg_min(sha, walk_pos) || ':' || count(sha))[:16], '') AS hash FROM fx_repos r LEFT JOIN fx_commits c ON c.repo_id = r.repo_id GROUP BY path"""),
    "content_hashes": (["fx_files"], "SELECT repo_id, path, sha256(content) AS hash FROM fx_files"),
    "remote_names": (["fx_repos"], "SELECT repo_id, regexp_replace(replace(replace(remote_url, 'git@github.com:', 'github.com/'), '.git', ''), '^https://', '') AS remote FROM fx_repos"),
    "commit_labels": (["fx_commits", "fx_commit_files"], """
SELECT c.sha[-8:] AS tail, c.sha[:8] AS sha8, split_part(trim(message), chr(10), 1) AS subject, file_pos, path, CASE change_type WHEN 'A' THEN 'Added' WHEN 'D' THEN 'Deleted' WHEN 'M' THEN 'Modified' WHEN 'R' THEN 'Renamed' ELSE 'Changed' END AS label,
  md5(CASE WHEN len(string_split(diff, chr(10))) > 20 THEN array_to_string(string_split(diff, chr(10))[:20], chr(10)) || chr(10) || '... (' || (len(string_split(diff, chr(10))) - 20) || ' more lines)' ELSE diff END) AS diff
FROM fx_commits c JOIN fx_commit_files f ON f.sha = c.sha AND f.repo_id = c.repo_id"""),
    "short_documents": (["fx_files"], "SELECT repo_id, path, CASE WHEN length(content) > 100 THEN content[:97] || '...' ELSE content END AS short FROM fx_files"),
    "story_dates": (["fx_commits"], """
SELECT sha, CASE walk_pos % 4 WHEN 3 THEN 'unknown' WHEN 2 THEN 'no date at' ELSE strftime(committed_date, '%Y-%m-%d') END AS date FROM fx_commits"""),
    "domain_titles": (["domains"], "SELECT repo_id, array_to_string(list_transform(string_split(domain, '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM domains"),
    # --- profiles, stories, state --------------------------------------------------------------------------------------------------------------
    "list_profiles": (["fx_profiles"], """
SELECT name, octet_length(encode(content)) AS size, modified, greatest(len(regexp_extract_all(content, '## ')) - 1, 0) AS project_count, name = 'en_7' AS synced, repo_count, has_metadata FROM fx_profiles"""),
    "latest_profile": (["fx_profiles"], "SELECT name, modified FROM fx_profiles ORDER BY modified DESC, name DESC LIMIT 1"),
    "status_summary": (["fx_profiles"], "SELECT count(*) AS profiles_count, max(modified) AS last_analyze, bool_or(name <> 'en_7') AS pending_sync FROM fx_profiles"),
    "profiles_to_push": (["fx_profiles"], "SELECT name, CASE WHEN has_metadata THEN 'pushed' ELSE 'failed' END AS status FROM fx_profiles WHERE name <> 'en_7'"),
    "push_summary": (["profiles_to_push"], "SELECT status, CAST(NULL AS VARCHAR) AS reason, count(*) AS n FROM profiles_to_push GROUP BY status"),
    "saved_names": (["documents"], """
SELECT lang AS repo_name, doc_id AS ord, CASE WHEN slot = 0 THEN lang || '_2001-08-02' ELSE lang || '_2001-08-02-' || slot END AS name FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS j FROM documents) d
JOIN (SELECT lang, slot, row_number() OVER (PARTITION BY lang ORDER BY slot) AS j FROM (
  SELECT lang, unnest(range(0, 3 * count(*) + 10)) AS slot FROM documents GROUP BY lang) s
  WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = s.lang AND e.doc_id % 7 = 0 AND e.doc_id // 5 = s.slot)) free USING (lang, j)"""),
    "stories_page": (["fx_stories"], """
SELECT story_id, repo_name, files_changed, lines_added, lines_removed, last_commit_at, (SELECT count(*) FROM fx_stories WHERE list_has_any(list_transform(technologies, lambda t: lower(t)), ['python', 'sql']) AND last_commit_at >= TIMESTAMP '1998-01-01 00:00:00') AS total
FROM fx_stories WHERE list_has_any(list_transform(technologies, lambda t: lower(t)), ['python', 'sql']) AND last_commit_at >= TIMESTAMP '1998-01-01 00:00:00' ORDER BY last_commit_at DESC, story_id LIMIT 50 OFFSET 20"""),
    "known_files": (["fx_files"], "SELECT repo_id, path, CASE WHEN length(path) % 17 = 1 THEN 'old' ELSE md5(content) END AS stamp FROM fx_files WHERE length(path) % 13 <> 3"),
    "current_files": (["fx_files"], "SELECT repo_id, path, md5(content) AS stamp FROM fx_files WHERE length(path) % 13 <> 5"),
    "changed_files": (["known_files", "current_files"], """
SELECT repo_id, path, stamp, 'changed' AS kind FROM current_files c WHERE NOT EXISTS (SELECT 1 FROM known_files k WHERE k.repo_id = c.repo_id AND k.path = c.path AND k.stamp = c.stamp)
UNION ALL SELECT repo_id, path, NULL, 'gone' FROM known_files k WHERE NOT EXISTS (SELECT 1 FROM current_files c WHERE k.repo_id = c.repo_id AND k.path = c.path)"""),
    "committed_profiles": (["documents"], """
SELECT lang || '_2001-08-02' || CASE WHEN j = 1 THEN '' ELSE '-' || (j - 1) END AS name, lang AS repo_name, md5(text) AS content, source AS metadata, '2001-08-02' AS saved_on
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 2, doc_id) AS j FROM documents)"""),
    "story_cards": (["fx_stories"], """
SELECT story_id, summary, array_to_string(technologies[:5], ' ') AS technologies, repo_name || ' • ' || files_changed || ' files • +' || lines_added || ' -' || lines_removed || ' • ' || strftime(last_commit_at, '%Y-%m-%d') AS details FROM fx_stories"""),
    "stored": (["repo_hashes", "fx_repos"], """
SELECT path, CASE WHEN repo_id % 2 = 0 THEN 'stale' ELSE hash END AS hash FROM repo_hashes JOIN fx_repos USING (path) WHERE repo_id % 5 <> 4 UNION ALL SELECT path || '-old', 'gone' FROM fx_repos WHERE repo_id % 5 = 4"""),
    "changed_repos": (["repo_hashes", "stored"], "SELECT path, c.hash FROM repo_hashes c LEFT JOIN stored s USING (path) WHERE s.hash IS NULL OR s.hash <> c.hash"),
    "next_state": (["repo_hashes", "stored"], "SELECT path, hash FROM repo_hashes UNION ALL SELECT path, hash FROM stored WHERE path NOT IN (SELECT path FROM repo_hashes)"),
    "tracked_status": (["fx_tracked", "fx_repos"], "SELECT path, string_split(path, '/')[-1] AS name, last_sync, path IN (SELECT path FROM fx_repos) AS exists FROM fx_tracked"),
    "sync_plan": (["fx_tracked", "fx_repos", "fx_commits"], """
SELECT t.path, CASE WHEN reason IS NULL THEN 'sync' ELSE 'skipped' END AS status, reason FROM (SELECT t.path, CASE WHEN r.repo_id IS NULL THEN 'not_found'
  WHEN last_sync IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_commits c WHERE c.repo_id = r.repo_id AND c.committed_date > t.last_sync) THEN 'unchanged' END AS reason FROM fx_tracked t LEFT JOIN fx_repos r USING (path)) t"""),
    "sync_summary": (["sync_plan"], "SELECT status, reason, count(*) AS n FROM sync_plan GROUP BY ALL"),
    "streamed_contributors": (["fx_commits"], """
SELECT repo_id, author_email AS email, max({'d': committed_date, 's': sha, 'n': author_name}).n AS name, count(*) AS commits,
  min(committed_date) AS first_commit, max(committed_date) AS last_commit, max({'d': committed_date, 's': sha}).s AS newest_sha
FROM fx_commits GROUP BY repo_id, author_email"""),
}


def oracle(name: str) -> str:
    return f"{with_clause([name], views={**FIXTURES, **VIEWS})}\nSELECT * FROM {name}"
