"""DuckDB statements that must return what the registered queries return.

They use the patterns as written in the packs, none of the cheaper spellings or
gates, and DuckDB's own linear-time regex engine.
"""

from __future__ import annotations

from textsentry.functions import regex
from textsentry.functions.text import CLEAN_CUTSET, WHITE_SPACE, keywords
from textsentry.operators.rules import DEFAULT_CONTEXT
from textsentry.plans import queries as q
from textsentry.plans.catalogue import CATALOGUE_SQL
from textsentry.sources.packs import pack_document

# Unicode classes spelled out; DuckDB's \w, \d and \s are ASCII only. In the
# packs \w and \s only occur inside brackets.
_UNICODE = [
    (r"\w", r"\p{L}\p{Mn}\p{Nd}\p{Pc}"),
    (r"\d", r"\p{Nd}"),
    (r"\s", r"\s\x{0B}\x{85}\p{Z}"),
]


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _unicode(pattern: str) -> str:
    for short, spelled in _UNICODE:
        pattern = pattern.replace(short, spelled)
    return pattern


def _rules(names: list[str] | None, extended: bool = True, sensitive: bool = False) -> list[dict]:
    wanted = keywords(names)
    out = []
    for entry in pack_document(extended)["rules"]:
        for rule in entry["rule"]:
            if wanted and not any(w in rule["name"].lower() for w in wanted):
                continue
            if sensitive and not rule["sensitive"]:
                continue
            width = rule["context_left"]
            if rule["sensitive"] and width <= 0:
                width = DEFAULT_CONTEXT
            out.append({**rule, "group": entry["group"], "width": width})
    return out


def _hits(rules: list[dict], source: str) -> str:
    selects = []
    for r in rules:
        pattern = _unicode(r["f_regex"]) if r["engine"] == "nfa" else r["f_regex"]
        selects.append(
            f"""SELECT *, {s(r['group'])} AS "group", {s(r['name'])} AS rule_name,
            {r['width']} AS w, {str(r['sensitive']).lower()} AS sensitive,
            unnest(regexp_extract_all(txt, {s('(?mi)' + pattern)})) AS match FROM {source}"""
        )
    return " UNION ALL ".join(selects)


def findings_cte(
    source_sql: str, ids: list[str], rules: list[dict], offsets: tuple[str, str] = ("0", "1")
) -> str:
    """CTEs up to ``findings`` over a source with the ids and a column ``txt``."""
    cols = ", ".join(ids)
    offset, line = offsets
    longest_left = (
        "coalesce(list_max(list_filter(range(0, w + 1), lambda k: strlen(right(pre, k)) <= w)), 0)"
    )
    longest_right = (
        "coalesce(list_max(list_filter(range(0, w + 1), lambda k: strlen(left(post, k)) <= w)), 0)"
    )
    return f"""
    src AS ({source_sql}),
    hits AS ({_hits(rules, 'src')}),
    cut AS (SELECT *, substr(txt, 1, instr(txt, match) - 1) AS pre FROM hits
            WHERE strlen(trim(match, {s(WHITE_SPACE)})) > 5),
    around AS (SELECT *, substr(txt, length(pre) + length(match) + 1) AS post FROM cut),
    edges AS (SELECT *, right(pre, {longest_left}) AS lc, left(post, {longest_right}) AS rc
              FROM around),
    findings AS (
      SELECT {cols}, "group", rule_name, match,
        repeat(chr(65533), CAST(least(w, strlen(pre)) - strlen(lc) AS BIGINT)) || lc || match || rc
          || CASE WHEN least(w, strlen(post)) > strlen(rc) THEN chr(65533) ELSE '' END AS context,
        CAST({offset} + strlen(pre) AS BIGINT) AS position,
        CAST({line} + length(pre) - length(replace(pre, chr(10), '')) AS BIGINT) AS line_number,
        sensitive
      FROM edges)"""


def _scan(source_sql: str, ids: list[str], rules: list[dict], tail: str = "SELECT * FROM findings"):
    return f"WITH {findings_cte(source_sql, ids, rules)} {tail}"


_DOCS = "SELECT doc_id, text AS txt FROM documents"
_PAGES = "SELECT page_id, html AS txt FROM pages"


def _doc_full(tail: str = "SELECT * FROM findings") -> str:
    return _scan(_DOCS, ["doc_id"], _rules(None), tail)


def _doc_core(tail: str = "SELECT * FROM findings") -> str:
    return _scan(_DOCS, ["doc_id"], _rules(None), tail)


def _page_core(tail: str = "SELECT * FROM findings") -> str:
    return _scan(_PAGES, ["page_id"], _rules(None), tail)


def _blocked() -> str:
    return "(" + " OR ".join(f"contains(match, {s(w)})" for w in q.BLOCK_WORDS) + ")"


def _cleaned(column: str) -> str:
    return f"replace(trim({column}, {s(CLEAN_CUTSET)}), '\\/', '/') AS \"{column.strip(chr(34))}\""


def _any_keyword(column: str, words: list[str]) -> str:
    return " OR ".join(f"contains(lower({column}), {s(w)})" for w in keywords(words))


_CAT = f"WITH cat AS ({CATALOGUE_SQL})"
_USABLE = "loaded AND name <> '' AND f_regex <> ''"
# Lookaround, atomic and conditional groups, backreferences, \\u escapes, possessive repeats.
_NON_LINEAR = s(r"\(\?[=!>(]|\(\?<[=!]|\\[1-9ku]|[*+?}]\+")
_ENGINE = f"""CASE WHEN engine IN ('nfa', 'dfa', 'java') THEN 'java' WHEN engine = 'go' THEN 'go'
  WHEN engine = '' THEN CASE WHEN regexp_matches(f_regex, {_NON_LINEAR}) THEN 'java' ELSE 'go' END END"""

_PROBED = f"""{_CAT}, probed AS (
  SELECT *, TRY(regexp_matches('', f_regex)) IS NOT NULL AS compiles,
         TRY(regexp_matches(sample_code, f_regex)) AS hit FROM cat WHERE loaded)"""
_VALIDATED = f"""{_PROBED}, validated AS (
  SELECT group_ord, rule_ord, "group", name,
    CASE WHEN name = '' THEN 'missing_name' WHEN f_regex = '' THEN 'missing_regex'
      WHEN NOT compiles THEN 'compile_error' WHEN sample_code = '' THEN 'no_sample'
      WHEN hit THEN 'ok' ELSE 'sample_mismatch' END AS status FROM probed)"""
_TESTED = f"""{_PROBED}, tested AS (
  SELECT "group", name,
    CASE WHEN NOT compiles THEN 'compile_error' WHEN sample_code = '' THEN 'no_sample'
      WHEN hit THEN 'valid' ELSE 'compile_error' END AS status,
    CASE WHEN NOT compiles THEN 'pattern does not compile' WHEN sample_code = '' THEN 'no sample'
      WHEN hit THEN '' ELSE 'sample does not match' END AS reason FROM probed)"""

_COUNT = "CAST(count(*) AS BIGINT)"


def _last_group(source: str) -> str:
    return (
        f'SELECT * FROM {source} QUALIFY group_ord = max(group_ord) OVER (PARTITION BY "group")'
    )


# Walks each pattern part by part with a stack of the rounds inside its open groups.
_VERDICT = f"""{_CAT.replace("WITH", "WITH RECURSIVE", 1)},
  looped AS (SELECT * REPLACE (({q.LOOPED_PATTERN}) AS f_regex) FROM cat),
  c AS (SELECT *, {_ENGINE} AS engine_resolved, TRY(regexp_matches('', f_regex)) IS NOT NULL AS compiles
    FROM looped WHERE {_USABLE}),
  parts AS (SELECT rule_ord, list_filter(regexp_extract_all(f_regex,
      '\\\\Q.*?\\\\E|\\\\.|\\[[^\\]]*\\]|\\)(?:[*+?]|\\{{[0-9]+,?[0-9]*\\}})?[+?]?|.'), lambda x: x[1] IN ('(', ')')) AS p FROM c),
  walk AS (SELECT rule_ord, p, 1 AS i, [0.0::DOUBLE] AS inside FROM parts
    UNION ALL
    SELECT rule_ord, p, i + 1, CASE WHEN p[i] = '(' THEN list_prepend(0.0::DOUBLE, inside)
      WHEN len(inside) < 2 THEN inside
      ELSE list_prepend(inside[2] + CASE
        WHEN regexp_matches(p[i], '^.[*+?{{].*\\+$') AND len(p[i]) > 2 THEN inside[1] + 1
        WHEN regexp_matches(p[i], '^.([*+]|\\{{[0-9]+,\\}})') THEN 1e9 * (inside[1] + 1)
        WHEN p[i][2] = '{{' AND regexp_extract(p[i], '([0-9]+)\\}}', 1)::DOUBLE > 0
          THEN regexp_extract(p[i], '([0-9]+)\\}}', 1)::DOUBLE * (inside[1] + 1)
        ELSE inside[1] END, inside[3:]) END
    FROM walk WHERE i <= len(p)),
  rounds AS (SELECT rule_ord, list_sum(inside) AS n FROM walk WHERE i = len(p) + 1)
SELECT rule_ord, CASE WHEN engine_resolved IS NULL THEN 'unsupported engine' WHEN NOT compiles THEN 'does not compile'
  WHEN n > 64 THEN 'unsafe loop' ELSE 'ok' END AS verdict FROM c JOIN rounds USING (rule_ord)"""


def _chunked() -> str:
    """Every match of the whole text at its own place; where the text was cut must not show."""
    mark = "chr(64976)"
    selects = []
    for r in [*_rules(None), {**q.TILE, "group": "Layout", "width": 0}]:
        pattern = _unicode(r["f_regex"]) if r["engine"] == "nfa" else r["f_regex"]
        cut = f"string_split(regexp_replace(text, {s('(?mi)' + pattern)}, {mark} || '\\0' || {mark}, 'g'), {mark})"
        selects.append(
            f"""SELECT doc_id, text, {s(r['group'])} AS "group", {s(r['name'])} AS rule_name,
            {r['width']} AS w, {str(r['sensitive']).lower()} AS sensitive, {cut} AS parts FROM documents"""
        )
    ctes = findings_cte("SELECT 0 AS doc_id, '' AS txt", ["doc_id"], _rules(None)[:1])
    edges = ctes[ctes.index("edges AS") :]
    return f"""WITH cuts AS ({' UNION ALL '.join(selects)}),
      places AS (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM cuts WHERE len(parts) > 1),
      around AS (SELECT * EXCLUDE (parts, text, i), parts[i] AS match,
          array_to_string(parts[1:i - 1], '') AS pre, array_to_string(parts[i + 1:], '') AS post FROM places
          WHERE strlen(trim(parts[i], {s(WHITE_SPACE)})) > 5),
      {edges} SELECT * FROM findings"""


def _histories() -> str:
    """Matches split at what lies between the captures."""
    pieces = {
        "labels": "string_split(match[2:], '.')[:-2]",
        "numbers": "string_split(match, '.')[:-2]",
        "hyphens": "string_split(match, '-')[2:]",
    }
    return " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, match, array_to_string({cut}, ',') AS captures FROM (
          SELECT doc_id, unnest(regexp_extract_all(text, {s('(?mi)' + q.HISTORIES[kind][0])})) AS match FROM documents)"""
        for kind, cut in pieces.items()
    )


def _union() -> str:
    return """SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, text AS txt FROM documents
      UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
      UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations"""


_PHONE = {
    "group": "Contact Numbers",
    "name": "Phone",
    "f_regex": q.UNCONDITIONAL,
    "engine": "",
    "width": 0,
    "sensitive": False,
}
_EXT = "lower(regexp_extract({c}, '(\\.[^./]+)$', 1))"
_EMAIL = s("(?mi)" + q.CAPTURE_EMAIL)
_TRIMMED = f"strlen(trim(match, {s(WHITE_SPACE)})) > 5"


def _scalar() -> str:
    newlines = "length(text) - length(replace(text, chr(10), ''))"
    stem = "regexp_replace(name, '\\.[^./]*$', '')"
    return f"""WITH d AS (SELECT *, source || '/' || doc_id || '.' || lang AS name FROM documents)
      SELECT doc_id, strlen(text) AS bytes, {newlines} AS newlines,
        strlen(trim(text, {s(WHITE_SPACE)})) AS trimmed,
        CASE WHEN strlen({stem}) > 10 THEN substr({stem}, 1, 7) || '...' ELSE {stem} END AS stem,
        {_EXT.format(c='name')} AS extension,
        round(100.0 * CAST({newlines} AS DOUBLE) / strlen(text), 2) AS newline_pct,
        CAST(greatest(0, least(n_chars, 1000)) AS BIGINT) AS clamped,
        contains(lower(text), 'licensed') OR contains(lower(text), 'token') AS has_word FROM d"""


def _clean() -> str:
    kept = "page_id, position, line_number, sensitive"
    text_columns = ", ".join(_cleaned(c) for c in ("match", "context", '"group"', "rule_name"))
    return _page_core(f"SELECT {kept}, {text_columns} FROM findings")


def _pack_values(rules: list[dict]) -> str:
    rows = ", ".join(
        f"({s(r['group'])}, {s(r['name'])}, {s(r['f_regex'])}, {str(r['sensitive']).lower()})"
        for r in rules
    )
    return f'(VALUES {rows}) AS pack("group", name, f_regex, sensitive)'


def statements() -> dict[str, str]:
    default = _rules(None, extended=False)
    fields = '"group", name, f_regex, loaded, engine, sensitive, context_left, context_right'
    texts = "sample_code, s_regex, format, color, scope"
    bare = "sensitive AND context_left <= 0 AND context_right <= 0"
    by_group, by_name = _any_keyword('"group"', q.GROUP_WORDS), _any_keyword("name", q.NAME_WORDS)
    context = f"""CAST(CASE WHEN {bare} THEN 50 ELSE context_left END AS INT) AS context_left,
      CAST(CASE WHEN {bare} THEN 50 ELSE context_right END AS INT) AS context_right"""
    limit = int(q.SIZE_LIMIT_MB * 1024 * 1024)
    excluded = ", ".join(s("." + e.lstrip(".").lower()) for e in q.EXCLUDED_EXTENSIONS)
    paths = " AND ".join(f"NOT contains(url, {s(p)})" for p in q.EXCLUDED_PATHS)
    pct = "round(100.0 * {c} / nullif(total_rules, 0), 2) AS {c}_pct"
    return {
        "scan_documents": _doc_full(),
        "scan_pages": _scan(_PAGES, ["page_id"], _rules(None)),
        "scan_conversations": _scan(
            "SELECT conv_id, turn, text AS txt FROM conversations", ["conv_id", "turn"], _rules(None)
        ),
        "scan_sensitive": _scan(_DOCS, ["doc_id"], _rules(None, False, True)),
        "scan_joined": _doc_core(),
        "scan_fallback": _scan(_DOCS, ["doc_id"], [_PHONE]),
        "scan_union": _scan(_union(), ["source", "id"], _rules(None)),
        "scan_sql": _doc_full(),
        "chunked_scan": _chunked(),
        "match_any": f"SELECT doc_id, regexp_matches(text, {_EMAIL}) AS hit FROM documents",
        "match_first": f"""WITH m AS (SELECT doc_id, text, regexp_extract(text, {_EMAIL}) AS match
            FROM documents WHERE regexp_matches(text, {_EMAIL}))
          SELECT doc_id, match, strlen(substr(text, 1, instr(text, match) - 1)) AS position FROM m""",
        "match_all_n": f"""WITH m AS (SELECT doc_id, regexp_extract_all(text,
              '(?mi)[\\p{{L}}\\p{{Mn}}]{{12,}}')[1:{q.FIRST_N}] AS ms FROM documents)
          SELECT doc_id, CAST(unnest(range(0, len(ms))) AS INT) AS n, unnest(ms) AS match FROM m""",
        "match_groups": "SELECT doc_id, "
        + ", ".join(f"unnest(regexp_extract_all(text, {_EMAIL}, {i})) AS g{i}" for i in range(4))
        + " FROM documents",
        "match_history": f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text,
              {s('(?mi)' + q.DOMAIN)})) AS match FROM documents),
            l AS (SELECT *, string_split(substr(match, 2), '.') AS parts FROM m)
          SELECT doc_id, match, array_to_string(parts[1:len(parts) - 1], ',') AS labels FROM l""",
        "capture_history": _histories(),
        "findings_min_len": f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text,
              '(?mi)[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]\\p{{Nd}}+[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]')) AS match
              FROM documents)
          SELECT * FROM m WHERE {_TRIMMED}""",
        "rules_flatten": f"{_CAT} SELECT {fields}, {texts} FROM cat",
        "rules_ordinals": f"""{_CAT} SELECT
            CAST(dense_rank() OVER (PARTITION BY rule_ord // 100 ORDER BY "group") - 1 AS INT) AS group_ord,
            CAST(row_number() OVER (PARTITION BY rule_ord // 100, "group" ORDER BY rule_ord) - 1 AS INT) AS rule_ord,
            "group", name, f_regex FROM cat""",
        "rules_default": _scan(
            _DOCS,
            ["doc_id"],
            default,
            f"""SELECT pack."group", pack.name, f_regex, pack.sensitive,
              CAST(count(rule_name) AS BIGINT) AS n FROM {_pack_values(default)}
              LEFT JOIN findings ON findings."group" = pack."group" AND rule_name = pack.name
              GROUP BY ALL""",
        ),
        "rules_usable": f"{_CAT} SELECT * FROM cat WHERE {_USABLE}",
        "rules_by_group": f"{_CAT} SELECT * FROM cat WHERE {by_group}",
        "rules_by_name": f"{_CAT} SELECT * FROM cat WHERE {by_name}",
        "rules_sensitive": f"{_CAT} SELECT * FROM cat WHERE sensitive",
        "rules_context": f"{_CAT} SELECT rule_ord, sensitive, {context} FROM cat",
        "rules_group_last": f"{_CAT}, u AS (SELECT * FROM cat WHERE {_USABLE}) {_last_group('u')}",
        "rules_selected": f"""{_CAT}, u AS (SELECT * REPLACE (
              CAST(CASE WHEN {bare} THEN 50 ELSE context_left END AS INT) AS context_left,
              CAST(CASE WHEN {bare} THEN 50 ELSE context_right END AS INT) AS context_right)
            FROM cat WHERE {_USABLE} AND ({by_group}) AND ({by_name}) AND sensitive)
          {_last_group('u')}""",
        "rules_engine": f"""{_CAT} SELECT rule_ord, engine, coalesce({_ENGINE}, 'error')
          AS engine_resolved FROM cat""",
        "rules_compiled": f"""{_CAT}, e AS (SELECT *, {_ENGINE} AS engine_resolved FROM cat
            WHERE {_USABLE})
          SELECT rule_ord, engine_resolved,
            CASE WHEN engine_resolved = 'go' THEN {s(regex.GO_FLAGS)} ELSE {s(regex.JAVA_FLAGS)} END
              || replace(f_regex, '(?P<', '(?<') AS pattern,
            TRY(regexp_matches('', f_regex)) IS NOT NULL AS compile_ok FROM e""",
        "rules_listing": f"""{_CAT} SELECT "group", name, "group" || ': ' || name || ': ' ||
          CASE WHEN strlen(f_regex) > 50 THEN substr(f_regex, 1, 47) || '...' ELSE f_regex END AS line
          FROM cat""",
        "rules_count": f"""{_CAT} SELECT {_COUNT} AS rules,
          CAST(count(DISTINCT "group") AS BIGINT) AS groups FROM cat WHERE {_USABLE}""",
        "rules_validate": f"""{_VALIDATED} SELECT *, status IN ('ok', 'no_sample') AS valid
          FROM validated""",
        "rules_validate_summary": f"""{_VALIDATED} SELECT {_COUNT} AS checked,
          count(*) FILTER (status IN ('ok', 'no_sample')) AS valid,
          count(*) FILTER (status NOT IN ('ok', 'no_sample')) AS invalid,
          count(*) FILTER (status = 'no_sample') AS warnings FROM validated""",
        "rule_test_status": f"{_TESTED} SELECT * FROM tested",
        "rule_test_summary": f"""{_TESTED}, n AS (SELECT {_COUNT} AS total_rules,
            count(*) FILTER (status = 'valid') AS valid,
            count(*) FILTER (status = 'no_sample') AS no_sample,
            count(*) FILTER (status = 'compile_error') AS compile_error FROM tested)
          SELECT *, {', '.join(pct.format(c=c) for c in ('valid', 'no_sample', 'compile_error'))},
            CASE WHEN valid = total_rules THEN 'passed'
              WHEN valid > compile_error + no_sample THEN 'mostly passed' ELSE 'failed' END AS verdict
          FROM n""",
        "file_scan": _scan(
            f"""SELECT page_id // {q.PAGES_PER_FILE} AS folder,
              string_agg(html || chr(10), '' ORDER BY page_id) AS txt FROM pages GROUP BY 1""",
            ["folder"],
            _rules(None),
        ),
        "decode_text": """SELECT doc_id, CASE WHEN lang = 'es' THEN 'UTF-16LE' WHEN lang = 'fr' THEN 'UTF-16BE'
          WHEN lang = 'en' OR strlen(text) = length(text) THEN 'UTF-8' ELSE 'GB18030' END AS charset,
          md5(text) AS md5 FROM documents""",
        "scan_errors": """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'cannot be decoded'
          ELSE 'is empty' END AS error FROM documents WHERE lang = 'fr' OR strlen(text) = 0""",
        "decode_unmarked": """SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'UTF-8' WHEN lang = 'es' THEN 'UTF-16LE'
          WHEN lang = 'fr' THEN 'UTF-16BE' WHEN lang <> 'de' OR strlen(text) = length(text) THEN 'UTF-8'
          ELSE 'ISO-8859-1' END AS charset, md5(text) AS md5 FROM documents""",
        "errors_by_kind": """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'cannot be decoded'
          ELSE 'is empty' END AS error FROM documents WHERE lang IN ('fr', 'de') OR strlen(text) = 0""",
        "docs_skipped": f"""SELECT doc_id, 'is above the size limit' AS error FROM documents
          WHERE strlen(text) > {limit}""",
        "rules_verdict": _VERDICT,
        "files_by_ext": f"""SELECT page_id, url FROM pages
          WHERE {_EXT.format(c='url')} NOT IN ({excluded})""",
        "files_by_path": f"SELECT page_id, url FROM pages WHERE {paths}",
        "docs_by_size": f"""SELECT doc_id, strlen(text) AS bytes FROM documents
          WHERE strlen(text) <= {limit}""",
        "findings_position": _page_core("SELECT page_id, rule_name, match, position FROM findings"),
        "findings_line": _doc_core("SELECT doc_id, rule_name, match, line_number FROM findings"),
        "findings_context": _doc_core("SELECT doc_id, rule_name, match, context FROM findings"),
        "findings_clean": _clean(),
        "findings_block": _page_core(f"SELECT * FROM findings WHERE NOT {_blocked()}"),
        "block_counts": _page_core(
            f"""SELECT {_COUNT} AS before, count(*) FILTER (NOT {_blocked()}) AS after
            FROM findings"""
        ),
        "findings_keys": _page_core("SELECT rule_name, page_id, match FROM findings"),
        "findings_grouped": _page_core(
            f"SELECT rule_name AS bucket, match, {_COUNT} AS n FROM findings GROUP BY ALL"
        ),
        "sink_json": _page_core(),
        "sink_csv": _page_core(),
        "sink_by_group": _page_core(),
        "stats_overview": _doc_full(
            f"""SELECT {_COUNT} AS total, count(*) FILTER (sensitive) AS sensitive,
            count(DISTINCT doc_id) AS files, count(DISTINCT "group") AS groups FROM findings"""
        ),
        "stats_by_group": _doc_full(f'SELECT "group", {_COUNT} AS n FROM findings GROUP BY ALL'),
        "stats_by_rule": _doc_full(f"SELECT rule_name, {_COUNT} AS n FROM findings GROUP BY ALL"),
        "stats_rules_sorted": _doc_full(
            f"SELECT rule_name, {_COUNT} AS n FROM findings GROUP BY ALL ORDER BY n DESC, rule_name"
        ),
        "stats_top_rules": _doc_full(
            f"""SELECT rule_name, {_COUNT} AS n FROM findings GROUP BY ALL
            ORDER BY n DESC, rule_name LIMIT 5"""
        ),
        "files_with_findings": _doc_full("SELECT DISTINCT doc_id FROM findings"),
        "resume_scan": _doc_core(),
        "resume_files": _doc_core(),
        "stream_scan": _doc_core(),
        "stream_store": _doc_core(),
        "scalar_text": _scalar(),
    }
