"""DuckDB SQL for the queries that SQL can express, written from the rules and not from the Spark plans."""

from __future__ import annotations

#: White space in a character class, in the dialect of linear-time patterns.
_S = r"\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_DIRTY = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ', ', ',  ') WHEN 1 THEN replace(text, '. ', '.' || chr(8203) || '  ')
  WHEN 2 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE chr(65279) || replace(text, 'e ', 'e ' || chr(9) || ' ') END AS t FROM documents)"""
_HIDDEN = r"len(regexp_extract_all(t, '[\x{200b}\x{2060}\x{feff}\x{00ad}]'))"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(t, '\r\n?|[\x{2028}\x{2029}]', chr(10), 'g'), '[\x{200b}\x{2060}\x{feff}\x{00ad}]', '', 'g'), '[\x{00a0}\x{2007}\x{202f}\x{2009}\x{200a}\x{3000}]', ' ', 'g')"
_RUNS = rf"len(regexp_extract_all({_CLEAN}, '[ \t]{{2,}}'))"
_STRONG = [r"\*\*[^*\n]+\*\*", r"__[^_\n]+__", rf"\[[^\]\n]+\]\((?:https?:|mailto:|www\.)[^){_S}]+\)", rf"(?m)^#{{1,6}}[ \t]+[^{_S}]", r"(?m)^```", r"(?m)^\|.+\|[ \t]*\n\|?[ \t]*:?-{3,}"]
_WEAK = [
    rf"(?m)(^|[{_S}])\*[^{_S}*][^*\n]*\*([{_S}]|[.,;:!?]|$)", rf"(?m)(^|[{_S}])_[^{_S}_][^_\n]*_([{_S}]|[.,;:!?]|$)", r"`[^`\n]+`",
    rf"(?m)^>[ \t]+[^{_S}]", rf"(?m)^[ \t]*[-*+][ \t]+[^{_S}]", rf"(?m)^[ \t]*[0-9]{{1,3}}\.[ \t]+[^{_S}]",
]
_IS_STRONG = "(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in _STRONG) + ")"
_WEAK_COUNT = "(" + " + ".join(f"regexp_matches(text, '{p}')::BIGINT" for p in _WEAK) + ")"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_END = r"""[.!?:;"”’)\]]$"""


def _wrap_test(x: str) -> str:
    return f"""(len({x}) >= 2 AND list_max(list_transform({x}, lambda y: length(y))) >= 40
  AND len(list_filter({x}[1:-2], lambda y: length(y) >= 0.6 * list_max(list_transform({x}, lambda z: length(z))))) / greatest(len({x}) - 1, 1) >= 0.6
  AND len(list_filter({x}[1:-2], lambda y: NOT regexp_matches(y, '{_END}'))) > 0)"""


_SOURCE = f"""(SELECT doc_id, lang, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^{_S}]') THEN 'empty' WHEN {_IS_STRONG} OR {_WEAK_COUNT} >= 3 THEN 'markdown' ELSE 'text' END AS kind,
  CASE WHEN len(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^{_S}]\\t+[^{_S}]'))) >= 2 THEN 'Spreadsheet'
    WHEN len(list_filter(list_transform(string_split_regex(text, '\\n[{_S}]*\\n'), lambda c: list_transform(string_split(c, chr(10)), lambda y: {_trim("y")})), lambda l: len(l) >= 3 AND {_wrap_test("l")})) > 0 THEN 'PDF text'
    ELSE 'Plain text' END AS plain FROM documents)"""
_LABEL = "CASE kind WHEN 'empty' THEN 'Nothing' WHEN 'markdown' THEN 'Markdown' ELSE plain END"
_WRAPPED = """(SELECT conv_id || '-' || turn AS id, list_transform(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE (len(w) - 1) // 11 + 1 END), lambda i: array_to_string(w[i * 11 + 1 : i * 11 + 11], ' ')) AS l
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM conversations))"""
_LINE = f"""(SELECT *, lead(t) OVER (PARTITION BY id ORDER BY n) AS nx, max(length(t)) OVER (PARTITION BY id) AS mx FROM (
  SELECT id, n, {_trim("line")} AS t FROM (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM {_WRAPPED})) WHERE t <> '')"""
_HOSTS = """(SELECT DISTINCT lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages UNION ALL
  SELECT unnest(['docs.google.com', 'mail.google.com', 'app.slack.com', 'team.slack.com', 'www.notion.so', 'x.notion.site', 'www.example.org', '']))"""
_SITE = """CASE WHEN regexp_matches(host, '^docs\\.google\\.com$') THEN '{0}' WHEN host = 'mail.google.com' THEN '{1}' WHEN regexp_matches(host, '(^|\\.)slack\\.com$') THEN '{2}'
  WHEN regexp_matches(host, '(^|\\.)notion\\.so$|\\.notion\\.site$') THEN '{3}' ELSE {4} END"""
_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
_SUPPLIERS = """(SELECT s_suppkey // 50 AS page, list(CAST(s_suppkey AS VARCHAR) ORDER BY s_suppkey) AS k, list(s_name ORDER BY s_suppkey) AS v,
  CAST(greatest(3, max(length(CAST(s_suppkey AS VARCHAR)))) AS INT) AS wk, CAST(greatest(4, max(length(s_name))) AS INT) AS wv FROM supplier GROUP BY 1)"""
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_ALIGNED = "rpad('Key', wk, ' ') || '  Name' || chr(10) || repeat('-', wk) || '  ' || repeat('-', wv) || chr(10) || array_to_string(list_transform(range(1, len(k) + 1), lambda i: rpad(k[i], wk, ' ') || '  ' || v[i]), chr(10))"
_DROP = r"(?is)<!--.*?-->|<!doctype[^>]*>|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "head", "title"))
_BLOCK = "'" + "','".join("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()) + "'"
_DECODED = "token"
for _name, _value in (("nbsp", " "), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_name};', '{_value}')"
_ROLE = """CASE WHEN (length(line) % 5 = 0 OR (upper(line) = line AND lower(line) <> line)) AND len(string_split_regex(trim(line), '\\s+')) <= 6 AND length(line) <= 60 AND NOT regexp_matches(line, '[.;]$') AND NOT contains(line, chr(9)) THEN 'heading'
  WHEN length(line) % 3 = 0 AND length(line) % 5 <> 0 AND length(line) <= 220 THEN 'entry' ELSE 'body' END"""

def _letters() -> str:
    """What the letters of ``q_letters`` become for each destination."""
    line = "'Is <strong>' || S || '</strong> and *not* <code>**' || P || '**</code>, see <a href=\"https://x.org/_o_/' || K || '\">it</a>.'"
    table = "<thead><tr><th>Key</th><th>Status</th></tr></thead><tbody><tr><td>' || K || '</td><td>' || S || '</td></tr></tbody></table>'"
    items = "'<ul><li>first<ul><li>deep ' || K || '</li></ul></li><li>last</li></ul>'"
    rich = f"'<h1>Order ' || K || '</h1><p>' || {line} || '</p>' || {items} || '<blockquote><p>quoted</p></blockquote><table>{table}"
    gap = "'<div><br></div>'"
    gmail = f"""'<div><strong>Order ' || K || '</strong></div>' || {gap} || '<div>' || {line} || '</div>' || {gap} || {items} || {gap} || '<blockquote><p>quoted</p></blockquote>' || {gap} || '<table border="1" cellpadding="6" cellspacing="0" style="border-collapse:collapse">{table}"""
    clean = r"'Order ' || K || E'\n\nIs ' || S || ' and *not* **' || P || '**, see it (https://x.org/_o_/' || K || E').\n\n• first\n  ◦ deep ' || K || E'\n• last\n\n> quoted\n\nKey\tStatus\n' || K || E'\t' || S"
    plain = r"'# Order ' || K || E'\n\nIs **' || S || '** and *not* `**' || P || '**`, see [it](https://x.org/_o_/' || K || E').\n\n- first\n  - deep ' || K || E'\n- last\n\n> quoted\n\n| Key | Status |\n| --- | --- |\n| ' || K || ' | ' || S || ' |'"
    marks = "md-lists:3,md-headings:1,md-emphasis:2,md-links:1"
    each = (
        ("rich", rich, clean, f"{marks},blank-lines:1,links:1"), ("gmail", gmail, clean, f"{marks},headings-flattened:1,email-spacing:1,blank-lines:1,links:1"), ("plain", "NULL", plain, "kept-markdown:1,blank-lines:1,links:1"),
    )
    source = "(SELECT CAST(o_orderkey AS VARCHAR) AS K, o_orderstatus AS S, o_orderpriority AS P FROM orders)"
    return " UNION ALL ".join(f"SELECT K AS id, '{d}' AS destination, {html} AS html, {text} AS text, '{notes}' AS notes FROM {source}" for d, html, text, notes in each)


ORACLE_SQL: dict[str, str] = {
    "q_clean_text": rf"SELECT doc_id, regexp_replace({_CLEAN}, '[ \t]{{2,}}', ' ', 'g') AS clean, {_HIDDEN} AS hidden, {_RUNS} AS runs FROM {_DIRTY}",
    "q_blank_lines": rf"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n, len(s) AS m FROM (SELECT doc_id, string_split(chr(10) || replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(10)) || chr(10) || ' ' || chr(10), chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
        g AS (SELECT *, NOT regexp_matches(line, '[^{_S}]') AS b, sum(CASE WHEN regexp_matches(line, '[^{_S}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l),
        r AS (SELECT doc_id, i, sum(b::INT) AS run, max(i) OVER (PARTITION BY doc_id) AS last FROM g GROUP BY doc_id, i)
        SELECT doc_id, CAST(sum(CASE WHEN i = 0 OR i = last THEN run ELSE greatest(run - 1, 0) END) AS BIGINT) AS blank_lines FROM r GROUP BY doc_id""",
    "q_detect_source": f"SELECT doc_id, kind, {_LABEL} AS label FROM {_SOURCE}",
    "q_markdown_signs": f"SELECT conv_id, turn, {_IS_STRONG} AS strong, {_WEAK_COUNT} AS weak, ({_IS_STRONG} OR {_WEAK_COUNT} >= 3) AS markdown FROM conversations",
    "q_hard_wrap": f"SELECT id, greatest(len(l), 1) AS n_lines, coalesce(list_max(list_transform(l, lambda y: length(y))), 0) AS longest, {_wrap_test('l')} AS wrapped FROM {_WRAPPED}",
    "q_reflow": f"""WITH a AS (SELECT *, count(nx) OVER (PARTITION BY id) AS body, sum((nx IS NOT NULL AND length(t) >= 0.6 * mx)::INT) OVER (PARTITION BY id) AS long,
          sum((nx IS NOT NULL AND NOT regexp_matches(t, '{_END}'))::INT) OVER (PARTITION BY id) AS open FROM {_LINE}),
        b AS (SELECT *, body >= 1 AND mx >= 40 AND long / body >= 0.6 AND open > 0 AS wrapped FROM a),
        c AS (SELECT *, (wrapped AND nx IS NOT NULL AND ((length(t) < 0.7 * mx AND NOT regexp_matches(t, '[,-]$')) OR (regexp_matches(t, '{_END}') AND length(nx) < 0.7 * mx AND regexp_matches(nx, '^[A-Z0-9]'))))::INT AS e FROM b),
        d AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para FROM c)
        SELECT id, 1::BIGINT AS block, para::BIGINT AS para, CASE WHEN wrapped THEN string_agg(t, ' ' ORDER BY n) ELSE string_agg(t, chr(10) ORDER BY n) END AS text, count(*) AS n_lines FROM d GROUP BY id, para, wrapped""",
    "q_fingerprints": r"""WITH c AS (SELECT doc_id, substring(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), 1, 400) AS core FROM documents),
        h AS (SELECT doc_id, core, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(core, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: (a * 33 + b) % 4294967296) AS h FROM c WHERE length(core) >= 3)
        SELECT concat(length(core), ':', lower(to_base(h, 36))) AS fp, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY 1 HAVING count(*) > 1""",
    "q_escape_html": f"SELECT page_id, {_ESC.format('html')} AS escaped FROM pages",
    "q_page_links": r"""SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE regexp_matches(href, '(?i)^(https?:/*[^/?#]+|mailto:|tel:|www\.)')) AS n_safe, min(href) AS first_href
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
    "q_page_blocks": rf"""WITH k AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{_DROP}', '', 'g'), '<[^>]*>|[^<]+') AS s FROM pages),
        t AS (SELECT page_id, unnest(s) AS token, generate_subscripts(s, 1) AS n FROM k),
        g AS (SELECT *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM t),
        b AS (SELECT *, sum((tag IN ({_BLOCK}))::INT) OVER w AS block, last_value(CASE WHEN tag IN ({_BLOCK}) THEN CASE WHEN token LIKE '</%' THEN 'p' ELSE tag END END IGNORE NULLS) OVER w AS owner FROM g WINDOW w AS (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        x AS (SELECT *, CASE WHEN tag = 'br' THEN chr(10) WHEN tag = '' THEN (SELECT {_DECODED} FROM (SELECT regexp_replace(b.token, '[{_S}]+', ' ', 'g') AS token)) END AS v FROM b),
        j AS (SELECT page_id, block, any_value(owner) AS tag, string_agg(v, '' ORDER BY n) AS v FROM x WHERE v IS NOT NULL GROUP BY page_id, block),
        f AS (SELECT 'p' || page_id AS id, block::BIGINT AS block, coalesce(tag, 'p') AS tag, regexp_replace(regexp_replace(regexp_replace(v, '[ \t]*\n[ \t]*', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM j)
        SELECT * FROM f WHERE text <> ''""",
    "q_page_audit": rf"""SELECT page_id, regexp_matches(html, '(?i)<(?:script|iframe|object|embed)\b|<[^>]+\son[a-z]+\s*=|href\s*=\s*["'']?\s*(?:javascript|data|vbscript):') AS unsafe,
        regexp_matches(html, '(?i)<(?:style|font)\b|<[^>]+\s(?:style|class|face|color|bgcolor)\s*=') AS styles, regexp_matches(html, '(?i)<o:p|mso-|urn:schemas-microsoft-com') AS office,
        CASE WHEN regexp_matches(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&nbsp;', ''), '[^{_S}]') THEN 'html' ELSE 'empty' END AS kind FROM pages""",
    "q_routing": f"""SELECT host, kind, CASE WHEN kind = 'code' THEN NULL WHEN host = 'www.example.org' THEN 'slack' WHEN kind <> 'rich' THEN 'plain' ELSE {_SITE.format("google-docs", "gmail", "slack", "notion", "'rich'")} END AS destination,
        {_SITE.format("Google Docs", "Gmail", "Slack", "Notion", "CASE WHEN host = '' THEN 'Unknown' ELSE regexp_replace(host, '^www[.]', '') END")} AS site FROM {_HOSTS}, (SELECT unnest(['rich', 'text', 'code']) AS kind)""",
    "q_paste_modes": """SELECT destination, empty, learned, CASE WHEN destination IN ('plain', 'slack') THEN 'adapt' WHEN learned THEN 'match-style' WHEN empty = false THEN 'adapt' ELSE 'preserve' END AS mode,
        CASE WHEN destination = 'plain' OR NOT learned THEN 'insert-text' WHEN destination = 'google-docs' THEN 'editor-only' ELSE 'insert-rich' END AS delivery
        FROM (SELECT unnest(['rich', 'notion', 'google-docs', 'gmail', 'slack', 'plain']) AS destination), (VALUES (true), (false), (NULL)) e(empty), (VALUES (true), (false)) l(learned)""",
    "q_style_scope": r"""SELECT url, CASE WHEN h = 'docs.google.com' AND d <> '' THEN 'gdoc:' || d WHEN h <> '' THEN 'site:' || h END AS scope FROM (SELECT url, lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) AS h, regexp_extract(url, '(?i)^https?://[^/?#]+/document/(?:u/[0-9]+/)?d/([A-Za-z0-9_-]{10,})', 1) AS d
        FROM (SELECT url FROM pages UNION ALL SELECT unnest(['https://docs.google.com/document/d/abcdefghijk/edit', 'https://docs.google.com/document/u/0/d/abcdefghijk', 'ftp://x.org', 'https://'])))""",
    "q_skip_reason": f"""SELECT event_id, CASE WHEN k % 7 = 0 THEN 'disabled' WHEN k * 100 < 1000 THEN 'plain-paste-shortcut' WHEN event_type = 'view' THEN 'not-editable' WHEN event_type = 'error' THEN 'code-editor' WHEN k % 5 = 0 THEN 'no-data'
        WHEN k % 3 > 0 AND k % 2 <> 0 THEN 'files' WHEN k % 11 = 0 THEN 'already-cleaned' WHEN event_type = 'signup' THEN 'transform-failed' WHEN k % 13 = 0 THEN 'nothing-to-fix' WHEN NOT value > 10 THEN 'not-delivered' END AS reason FROM {_EVENTS}""",
    "q_active_users": """WITH s AS (SELECT user_id, CASE WHEN value > 20 THEN value > 50 END AS enabled FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM s WHERE NOT coalesce(enabled, true)) GROUP BY user_id""",
    "q_attribution": """WITH e AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) + to_minutes(CAST(event_id % 60 AS INT)) AS ts, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 2 AS VARCHAR) AS fp FROM events),
        u AS (SELECT user_id, ts, 0 AS o, NULL AS paste_id, fp, {'ts': ts, 'fp': fp, 'site': 'site' || event_id % 7} AS c FROM e WHERE event_type = 'click' UNION ALL SELECT user_id, ts, 1, event_id, fp, NULL FROM e WHERE event_type = 'view'),
        l AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, o, c.fp, c.site ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM u)
        SELECT paste_id, user_id, CASE WHEN k.fp = fp AND k.ts >= ts - INTERVAL 30 MINUTE THEN k.site END AS origin FROM l WHERE o = 1""",
    "q_recent_activity": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 5",
    "q_recent_by_user": "SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "q_last_outcomes": "SELECT user_id AS site, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "q_profile_merge": "SELECT user_id, " + ", ".join(f'arg_max(value, (ts, event_id)) FILTER (WHERE event_type = \'{r}\' AND value IS NOT NULL) AS "{r}"' for r in ("view", "click", "error")) + " FROM events GROUP BY user_id",
    "q_link_changes": """SELECT l_orderkey, CAST(sum((href IS NOT NULL AND (p IS NULL OR p <> href))::INT) AS BIGINT) AS n_links FROM (SELECT *, lag(href) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, href) AS p
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS href FROM lineitem)) GROUP BY l_orderkey""",
    "q_line_roles": f"""WITH r AS (SELECT *, {_ROLE} AS role FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE regexp_matches(line, '[^{_S}]'))
        SELECT doc_id, arg_min(line, n) FILTER (WHERE role = 'heading') AS first_heading, arg_min(line, n) FILTER (WHERE role = 'entry') AS first_entry, first(line ORDER BY length(line) DESC, n) FILTER (WHERE role = 'body') AS longest_body,
        count(*) FILTER (WHERE role = 'heading') AS n_heading, count(*) FILTER (WHERE role = 'entry') AS n_entry, count(*) FILTER (WHERE role = 'body') AS n_body FROM r GROUP BY doc_id""",
    "q_css": """SELECT v, family, size, length, line_height, color, round(1.05 / (0.05 + lum), 6) AS contrast FROM (VALUES ('12pt', '12pt', '12pt', '12pt', '12pt', NULL, NULL), ('4px', '4px', NULL, '4px', '4px', NULL, NULL),
        ('96.5pt', NULL, NULL, '96.5pt', '96.5pt', NULL, NULL), ('97pt', '97pt', NULL, '97pt', '97pt', NULL, NULL), ('0', '0', NULL, '0pt', '0', NULL, NULL), ('1.5', NULL, NULL, NULL, '1.5', NULL, NULL),
        ('#AbC', NULL, NULL, NULL, NULL, '#aabbcc', 0.2126 * pow((170 / 255 + 0.055) / 1.055, 2.4) + 0.7152 * pow((187 / 255 + 0.055) / 1.055, 2.4) + 0.0722 * pow((204 / 255 + 0.055) / 1.055, 2.4)),
        ('#a1b2c3', NULL, NULL, NULL, NULL, '#a1b2c3', 0.2126 * pow((161 / 255 + 0.055) / 1.055, 2.4) + 0.7152 * pow((178 / 255 + 0.055) / 1.055, 2.4) + 0.0722 * pow((195 / 255 + 0.055) / 1.055, 2.4)),
        ('rgb(300, 4, 5)', '4', NULL, NULL, NULL, '#ff0405', 0.2126 + 0.7152 * 4 / 255 / 12.92 + 0.0722 * 5 / 255 / 12.92), ('rgba(1,2,3,0)', '2, 3', NULL, NULL, NULL, NULL, NULL),
        ('rgba(1,2,3,.5)', '2, 3', NULL, NULL, NULL, '#010203', (0.2126 + 0.7152 * 2 + 0.0722 * 3) / 255 / 12.92), ('red', 'red', NULL, NULL, NULL, NULL, NULL), ('Arial, ''Times New Roman'', x{}', 'Arial, ''Times New Roman''', NULL, NULL, NULL, NULL, NULL),
        ('a,b,c,d,e', 'a, b, c, d', NULL, NULL, NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL, NULL, NULL), ('-3px', '-3px', NULL, '-3px', '-3px', NULL, NULL)) t(v, family, size, length, line_height, color, lum)""",
    "q_trailing_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Order ' || o_orderkey ELSE 'Order ' || o_orderkey || ' Mar ' || year(o_orderdate) || CASE WHEN o_orderkey % 2 = 0 THEN ' - present' ELSE '' END END AS main,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Mar ' || year(o_orderdate) || CASE WHEN o_orderkey % 2 = 0 THEN ' - present' ELSE '' END END AS date FROM orders""",
    "q_ago": """WITH m AS (SELECT event_id, CAST(floor((1706745600000 - epoch_ms(ts)) / 60000 + 0.5) AS BIGINT) AS m FROM events), h AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM m)
        SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN h < 24 THEN h || 'h' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd' END AS age FROM h""",
    "q_tables": f"""SELECT page, true AS head, 'Key' || chr(9) || 'Name' || chr(10) || array_to_string(list_transform(range(1, len(k) + 1), lambda i: k[i] || chr(9) || v[i]), chr(10)) AS tsv,
        '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(range(1, len(k) + 1), lambda i: '| ' || k[i] || ' | ' || v[i] || ' |'), chr(10)) AS pipes, {_ALIGNED} AS aligned,
        '<table><thead><tr><th>Key</th><th>Name</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(k) + 1), lambda i: '<tr><td>' || k[i] || '</td><td>' || v[i] || '</td></tr>'), '') || '</tbody></table>' AS html FROM {_SUPPLIERS}""",
    "q_table_styles": f"""SELECT page, '<table border="1" cellpadding="6" cellspacing="0" style="border-collapse:collapse"><thead><tr><th>Key</th><th>Name</th></tr></thead><tbody>' || array_to_string(list_transform(range(1, len(k) + 1), lambda i: '<tr><td>' || k[i] || '</td><td>' || v[i] || '</td></tr>'), '') || '</tbody></table>' AS email,
        '<pre>' || {_ALIGNED} || '</pre>' AS pre FROM {_SUPPLIERS}""",
    "q_line_blocks": """SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey ORDER BY b.pos) AS block, b.kind, b.n AS n_rows FROM orders,
        (VALUES (1, 'heading', 1::BIGINT, NULL), (2, 'list', 3, NULL), (3, 'text', 1, NULL), (4, 'code', 1, 0), (4, 'code', 1, 1), (4, 'code', 1, 3), (5, 'table', 4, 0), (5, 'table', 4, 1), (5, 'table', 4, 2), (6, 'table', 4, 0), (6, 'table', 4, 1), (6, 'table', 4, 2), (7, 'text', 1, 0), (7, 'text', 1, 1), (7, 'text', 1, 2)) b(pos, kind, n, k)
        WHERE b.k IS NULL OR b.k = o_orderkey % 4""",
    "q_inline": """SELECT c_custkey, '<strong>' || c_name || '</strong> &amp; <code>x&lt;y</code> see <a href="https://x.org/' || c_custkey || '">the site</a>' AS html, c_name || ' & x<y see the site (https://x.org/' || c_custkey || ')' AS text FROM customer""",
    "q_lists": """SELECT p_partkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1 + (coalesce(last_value(CASE WHEN k < 2 THEN k END IGNORE NULLS) OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey), 0) = 1)::INT END::BIGINT AS depth,
        CASE k WHEN 0 THEN 'disc' WHEN 1 THEN 'circle' ELSE 'square' END AS class FROM (SELECT p_partkey, p_partkey * 7 % 11 % 3 AS k FROM part)""",
    "q_notes_matrix": f"SELECT flaw, CAST(sum(h) AS BIGINT) AS hidden, CAST(sum(r) AS BIGINT) AS runs FROM (SELECT doc_id % 4 AS flaw, {_HIDDEN} AS h, {_RUNS} AS r FROM {_DIRTY}) GROUP BY flaw",
    "q_sources_cube": f"SELECT lang, label, count(*) AS n, grouping(lang, label)::BIGINT AS level FROM (SELECT lang, {_LABEL} AS label FROM {_SOURCE}) GROUP BY CUBE (lang, label)",
    "q_quality_of_changes": f"SELECT doc_id, quality, hidden, rank FROM (SELECT d.doc_id, quality, {_HIDDEN} AS hidden, dense_rank() OVER (PARTITION BY quality ORDER BY {_HIDDEN} DESC) AS rank FROM {_DIRTY} d JOIN labels USING (doc_id) WHERE quality IS NOT NULL) WHERE rank <= 3",
    "q_letters": _letters(),
    "q_pages": """SELECT p_partkey::VARCHAR AS id, '<h3>' || p_name || '</h3><p>a &lt;é&gt; <strong>' || p_partkey || '</strong><a href="https://x.org/' || p_partkey || '">go</a> on</p><ol start="' || (p_partkey % 7 + 2) || '"><li>x<ul><li>y</li></ul></li><li>z</li></ol><table><thead><tr><th>H</th><th></th></tr></thead><tbody><tr><td>'
        || p_partkey || '</td><td>' || p_name || '</td></tr></tbody></table><img src="https://x.org/i.png" alt="' || p_partkey || '"><p>one</p><p>two<br>three</p>' AS html,
        p_name || E'\\n\\na <é> ' || p_partkey || 'go (https://x.org/' || p_partkey || E') on\\n\\n' || (p_partkey % 7 + 2) || E'. x\\n   ◦ y\\n' || (p_partkey % 7 + 3) || E'. z\\n\\nH\\t\\n' || p_partkey || E'\\t' || p_name || E'\\n\\none\\n\\ntwo\\nthree' AS text FROM part""",
    "q_targets": """WITH f AS (SELECT event_id, ['input', 'textarea', 'div', 'input', 'div'][k % 5 + 1] AS tag, ['', 'password', 'email'][k % 3 + 1] AS type, ['docs.google.com', 'x.org', 'y.org'][k % 3 + 1] AS host FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
        g AS (SELECT *, CASE WHEN tag = 'div' THEN CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 5 = 0 THEN 'plaintext-editable' ELSE 'rich' END END WHEN event_id % 4 = 0 THEN NULL WHEN tag = 'textarea' THEN tag WHEN type <> 'password' THEN tag END AS kind FROM f)
        SELECT event_id, kind, CASE WHEN kind IS NOT NULL THEN kind = 'input' END AS single_line, CASE WHEN kind IS NOT NULL AND tag = 'div' AND host <> 'docs.google.com' AND event_id % 50 >= 4 THEN event_id % 2 = 0 END AS empty FROM g""",
    "q_settings_store": "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_styles": """SELECT c_custkey, '#1f3a8a' AS heading_color, true AS caps, true AS dates_right, true AS date_italic, '10pt' AS body_size, '#333333' AS body_color, '9pt' AS bullet_size,
        'Learned headings (all caps, coloured), entries with dates on the right and bullets.' AS said FROM customer""",
}
ORACLE_SQL["q_feedback"] = f"""SELECT event_id, CASE reason WHEN 'not-delivered' THEN 'warning' WHEN 'already-cleaned' THEN 'cleaned' WHEN 'code-editor' THEN NULL WHEN 'disabled' THEN NULL WHEN 'not-editable' THEN NULL WHEN 'no-data' THEN NULL ELSE 'normal' END AS tone,
        CASE reason WHEN 'not-delivered' THEN 'Not cleaned' WHEN 'already-cleaned' THEN 'Pasted the cleaned version' WHEN 'plain-paste-shortcut' THEN 'Pasted as plain text' WHEN 'files' THEN 'Pasted normally' WHEN 'nothing-to-fix' THEN 'Pasted normally' WHEN 'transform-failed' THEN 'Pasted normally' END AS title,
        CASE WHEN reason IN ('not-delivered', 'already-cleaned', 'nothing-to-fix', 'transform-failed') AND event_id % 2 = 0 THEN 'Gmail' END AS meta,
        CASE reason WHEN 'not-delivered' THEN CASE WHEN event_id % 2 = 0 THEN 'Gmail' ELSE 'This editor' END || ' didn’t accept the cleaned version, so this was a normal paste.' WHEN 'already-cleaned' THEN 'This was cleaned before it was pasted.' WHEN 'plain-paste-shortcut' THEN 'That shortcut is the browser’s own plain paste, which is left alone.'
        WHEN 'files' THEN 'Images and files pass through untouched.' WHEN 'nothing-to-fix' THEN 'Already clean: nothing to fix.' WHEN 'transform-failed' THEN 'Nothing here could be improved.' END AS lines FROM ({ORACLE_SQL["q_skip_reason"]}) WHERE reason IS NOT NULL"""

def paragraphs(source: str, key: str) -> str:
    """Lines of ``t`` of a table by ``key`` as paragraphs ``blk, para`` with their ``text``, number of lines and whether they were wrapped."""
    return f"""WITH l AS (SELECT {key}, n, {_trim("line")} AS raw FROM (SELECT {key}, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT {key}, string_split(t, chr(10)) AS s FROM {source}))),
        g AS (SELECT *, sum((raw = '')::INT) OVER (PARTITION BY {key} ORDER BY n) AS blk FROM l),
        x AS (SELECT *, lead(raw) OVER w AS nx, max(length(raw)) OVER (PARTITION BY {key}, blk) AS mx FROM g WHERE raw <> '' WINDOW w AS (PARTITION BY {key}, blk ORDER BY n)),
        a AS (SELECT *, count(nx) OVER (PARTITION BY {key}, blk) AS body, sum((nx IS NOT NULL AND length(raw) >= 0.6 * mx)::INT) OVER (PARTITION BY {key}, blk) AS long, sum((nx IS NOT NULL AND NOT regexp_matches(raw, '{_END}'))::INT) OVER (PARTITION BY {key}, blk) AS open FROM x),
        b AS (SELECT *, body >= 1 AND mx >= 40 AND long / body >= 0.6 AND open > 0 AS wrapped FROM a),
        c AS (SELECT *, (wrapped AND nx IS NOT NULL AND ((length(raw) < 0.7 * mx AND NOT regexp_matches(raw, '[,-]$')) OR (regexp_matches(raw, '{_END}') AND length(nx) < 0.7 * mx AND regexp_matches(nx, '^[A-Z0-9]'))))::INT AS e FROM b),
        d AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY {key}, blk ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para, regexp_replace(raw, '[ \t]{{2,}}', ' ', 'g') AS tidy FROM c),
        p AS (SELECT {key}, blk, para, wrapped, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(raw, '[ \t]{{2,}}'))) AS BIGINT) AS runs, CASE WHEN wrapped THEN string_agg(tidy, ' ' ORDER BY n) ELSE string_agg(tidy, chr(10) ORDER BY n) END AS text FROM d GROUP BY {key}, blk, para, wrapped)"""


ORACLE_SQL["q_transform_plain"] = f"""{paragraphs("(SELECT doc_id, text AS t FROM documents)", "doc_id")}, w AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY blk, para) AS text FROM p GROUP BY doc_id)
    SELECT 'd' || s.doc_id AS id, w.text IS NOT NULL AS ok, kind, {_LABEL} AS label, w.text FROM {_SOURCE} s LEFT JOIN w USING (doc_id)"""
ORACLE_SQL["q_dirty_notes"] = f"""{paragraphs(f"(SELECT doc_id, {_CLEAN} AS t FROM {_DIRTY})", "doc_id")},
    w AS (SELECT doc_id, CAST(sum(runs) AS BIGINT) AS whitespace, CAST(sum((wrapped AND n_lines > 1)::INT) AS BIGINT) AS reflow, count(DISTINCT blk) AS blocks FROM p GROUP BY doc_id),
    e AS (SELECT doc_id, count(*) FILTER (WHERE raw = '') AS blanks FROM l GROUP BY doc_id)
    SELECT h.doc_id, {_HIDDEN}::BIGINT AS hidden, whitespace, reflow, (blanks - greatest(blocks - 1, 0))::BIGINT AS blank_lines FROM {_DIRTY} h JOIN w USING (doc_id) JOIN e USING (doc_id)"""
