"""DuckDB views the oracle statements share, as named common table expressions."""

from __future__ import annotations

import re

from webcairn import limits as L
from webcairn.catalog import views

WS = r"[\s\x0B\p{Z}\x{FEFF}]"
SAFE = r"[!#-;=?-\]_a-z|~]"
UNSAFE = r"[^!#-;=?-\]_a-z|~]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def truncate(x: str, n: int) -> str:
    c = f"nullif({collapse(x)}, '')"
    return f"(CASE WHEN length({c}) > {n} THEN left({c}, {n - 1}) || '…' ELSE {c} END)"


def segments(path: str) -> str:
    return f"CAST(len(list_filter(string_split({path}, '/'), lambda s: s <> '')) AS BIGINT)"


def form_encode(x: str) -> str:
    return (
        f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"
    )


def canon(source: str, href: str, base: str | None = None, out: str = "url", drop: str = "") -> str:
    """SELECT adding ``out``, ``out_origin`` and ``out_path`` to ``source``."""
    tracking = lit(L.TRACKING_PARAM)
    based = base is not None
    base_sql = base or "'https://none/'"
    relative = "u_scheme0 = ''" if based else "false"
    stages = [
        {
            "u_raw": f"regexp_replace(regexp_replace({href}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g')",
            "u_base": base_sql,
        },
        {"u_nofrag": "split_part(u_raw, '#', 1)"},
        {
            "u_head": "replace(split_part(u_nofrag, '?', 1), '\\', '/')",
            "u_q0": "CASE WHEN contains(u_nofrag, '?') THEN substr(u_nofrag, instr(u_nofrag, '?') + 1) END",
            "u_bp": "regexp_extract(u_base, '^[^:]+://[^/?#]*([^?#]*)', 1)",
        },
        {"u_scheme0": "lower(regexp_extract(u_head, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"},
        {"u_rest": "CASE WHEN u_scheme0 <> '' THEN substr(u_head, length(u_scheme0) + 2) ELSE u_head END"},
        {"u_abs": "starts_with(u_rest, '//')"},
        {"u_auth0": "CASE WHEN u_abs THEN split_part(substr(u_rest, 3), '/', 1) END"},
        {"u_p0": "CASE WHEN u_abs THEN substr(u_rest, 3 + length(u_auth0)) ELSE u_rest END"},
        {
            "u_scheme": f"CASE WHEN u_scheme0 <> '' THEN u_scheme0 WHEN {relative} THEN regexp_extract(u_base, '^([a-z]+):', 1) END",
            "u_auth": f"CASE WHEN u_abs THEN u_auth0 WHEN {relative} THEN regexp_extract(u_base, '^[^:]+://([^/?#]*)', 1) END",
            "u_query": "CASE WHEN u_abs OR u_p0 <> '' OR u_q0 IS NOT NULL THEN u_q0 ELSE regexp_extract(u_base, '[?]([^#]*)', 1) END",
            "u_p1": """CASE WHEN u_abs AND u_p0 = '' THEN '/'
       WHEN u_abs OR starts_with(u_p0, '/') THEN u_p0
       WHEN u_p0 = '' THEN CASE WHEN u_bp = '' THEN '/' ELSE u_bp END
       ELSE CASE WHEN u_bp = '' THEN '/' ELSE regexp_extract(u_bp, '^(.*/)', 1) END || u_p0 END""",
        },
        {"u_segs": "string_split(substr(u_p1, 2), '/')", "u_hp": "regexp_extract(u_auth, '([^@]*)$', 1)"},
        {
            "u_last": "replace(lower(u_segs[-1]), '%2e', '.')",
            "u_user": "left(u_auth, length(u_auth) - length(u_hp))",
            "u_host": "lower(regexp_extract(u_hp, '^(\\[[^\\]]*\\]|[^:]*)', 1))",
        },
        {
            "u_port": "substr(u_hp, length(u_host) + 1)",
            "u_p2": """CASE WHEN regexp_matches(u_p1, '(?i)(^|/)(\\.|%2e){1,2}(/|$)') THEN
    '/' || array_to_string(
      list_reduce(
        list_prepend(CAST([] AS VARCHAR[]), list_transform(u_segs, lambda s: [s])),
        lambda a, b: CASE WHEN replace(lower(b[1]), '%2e', '.') = '..' THEN a[:-2]
                          WHEN replace(lower(b[1]), '%2e', '.') = '.' THEN a ELSE list_concat(a, b) END)
      || CASE WHEN u_last IN ('.', '..') THEN [''] ELSE [] END, '/')
  ELSE u_p1 END""",
        },
        {
            "u_pn": "try_cast(substr(u_port, 2) AS INT)",
            "u_p3": f"""array_to_string(list_transform(regexp_extract_all(u_p2, {lit(SAFE + '+|' + UNSAFE + '+')}),
    lambda r: CASE WHEN regexp_matches(r, {lit('^' + SAFE)}) THEN r ELSE url_encode(r) END), '')""",
            "u_query2": f"""array_to_string(list_transform(
    list_filter(string_split(coalesce(u_query, ''), '&'), lambda p: p <> '' AND NOT regexp_matches(
      url_decode(replace(split_part(p, '=', 1), '+', ' ')), {tracking})),
    lambda p: {form_encode("url_decode(replace(split_part(p, '=', 1), '+', ' '))")} || '=' ||
      {form_encode("url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END, '+', ' '))")}
  ), '&')""",
        },
        {
            "u_path": "CASE WHEN length(u_p3) > 1 AND ends_with(u_p3, '/') THEN u_p3[:-2] ELSE u_p3 END",
            "u_valid": """u_scheme IN ('http', 'https') AND regexp_matches(u_host, '^(\\[[0-9a-f:.]+\\]|[^\\s\\x00-\\x20<>\\\\^|%#?@:/\\[\\]]+)$')
    AND regexp_matches(u_port, '^(:\\d*)?$') AND coalesce(u_pn, 0) <= 65535""",
            "u_site": """u_host || CASE WHEN u_pn IS NOT NULL AND u_pn <> CASE WHEN u_scheme = 'https' THEN 443 ELSE 80 END
    THEN ':' || u_pn ELSE '' END""",
        },
    ]
    sql = f"SELECT * FROM {source}"
    drop = "".join(f", {c}" for c in drop.split())
    for stage in stages:
        cols = ", ".join(f"{v} AS {k}" for k, v in stage.items())
        sql = f"SELECT *, {cols} FROM ({sql})"
    temps = ", ".join(k for stage in stages for k in stage)
    return f"""
SELECT * EXCLUDE ({temps}{drop}),
  CASE WHEN u_valid THEN u_scheme || '://' || u_user || u_site || u_path
    || CASE WHEN u_query2 <> '' THEN '?' || u_query2 ELSE '' END END AS {out},
  CASE WHEN u_valid THEN u_scheme || '://' || u_site END AS {out}_origin,
  CASE WHEN u_valid THEN u_path END AS {out}_path
FROM ({sql})"""


HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"


def attr(tag: str, name: str) -> str:
    pattern = rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    return f"trim(regexp_extract({tag}, {lit(pattern)}, 1), {lit(chr(34) + chr(39))})"


def section(path: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({path}, {lit(p)}) THEN {lit(s)}" for p, s in L.SECTION_RULES)
    return f"(CASE {whens} ELSE {lit(L.DEFAULT_SECTION)} END)"


def section_rank(name: str) -> str:
    whens = " ".join(f"WHEN {lit(s)} THEN {i}" for i, s in enumerate(L.SECTION_ORDER, 1))
    return f"CAST(CASE {name} {whens} WHEN 'Optional' THEN 99 ELSE {len(L.SECTION_ORDER) + 1} END AS BIGINT)"


_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    _CTES[name] = (needs, sql.strip())


def again(prefix: str, names: tuple[str, ...], **swaps: str) -> None:
    """Views ``names`` once more under a prefix, over each other and over other tables in place of theirs."""
    new = {name: prefix + name for name in names} | swaps
    for name in names:
        needs, sql = _CTES[name]
        for old, other in new.items():
            sql = re.sub(rf"\b{old}\b", other, sql)
        define(prefix + name, tuple(new.get(n, n) for n in needs), sql)


def amend(name: str, *changes: tuple[str, str]) -> None:
    """Change a view's text where it says the first of each pair."""
    needs, sql = _CTES[name]
    for old, other in changes:
        if old not in sql:
            raise ValueError(f"{name} does not say {old}")
        sql = sql.replace(old, other)
    define(name, needs, sql)


def oracle(select: str, *needs: str) -> str:
    """The statement with every view it needs, in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        done.append(name)

    for name in needs:
        visit(name)
    heads = ",\n".join(f"{n} AS (\n{_CTES[n][1]}\n)" for n in done)
    return (f"WITH {heads}\n" if done else "") + select.strip()


define("timed", (), "SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events")
define("landed", (), views.LANDED.format(pages="pages"))
define("checks", ("timed",), views.CHECKS.format(timed="timed"))
define("crawl_events", ("timed",), views.CRAWL_EVENTS.format(timed="timed"))
define("doc_lines", (), views.DOC_LINES.replace("{nl}", "\n").format(documents="documents"))
define(
    "web",
    ("landed",),
    canon("landed", "url", drop="url html"),
)
define(
    "meta",
    ("landed",),
    f"""
SELECT * EXCLUDE (html, og_title, og_description, raw_title, metas, paragraphs, shown, own_description),
  coalesce(nullif(raw_title, ''), og_title) AS title,
  coalesce(own_description, og_description) AS description,
  nullif({collapse("regexp_extract(list_filter(list_transform(regexp_extract_all(shown, '(?is)<h1' || chr(92) || 'b[^>]*>(.*?)</h1[ ]*>', 1), lambda b: regexp_extract(b, '(?s)^(?:<[^>]*>)*([^<]*)', 1)), lambda t: t <> '')[1], '(?s)(.*)', 1)")}, '') AS h1,
  left(list_filter(paragraphs, lambda t: length(t) >= {L.MIN_SNIPPET_CHARS})[1], {L.MAX_SNIPPET_CHARS}) AS snippet,
  sha256(concat_ws(chr(10), coalesce(title, ''), coalesce(description, ''), coalesce(h1, ''), coalesce(snippet, ''))) AS content_hash
FROM (
  SELECT *, {collapse("regexp_extract(shown, '(?is)<title[^>]*>([^<]+)', 1)")} AS raw_title,
    list_filter(metas, lambda m: m.property = 'og:title')[1].content AS og_title,
    list_filter(metas, lambda m: m.property = 'og:description')[1].content AS og_description,
    list_filter(metas, lambda m: m.name = 'description')[1].content AS own_description
  FROM (
    SELECT *, list_filter(list_transform(regexp_extract_all(shown, {lit(r"(?is)<meta(?:\s[^>]*)?>")}),
        lambda t: {{'name': lower({attr('t', 'name')}), 'property': lower({attr('t', 'property')}),
                    'content': {attr('t', 'content')}}}), lambda m: m.content <> '') AS metas,
      list_transform(regexp_extract_all(shown, {lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>")}, 1), lambda b:
        {collapse("regexp_replace(regexp_replace(b, '(?is)^.*<p(?:[ ][^>]*)?>', ''), '(?s)<[^>]*>', '', 'g')")}) AS paragraphs
    FROM (SELECT *, regexp_replace(html, {lit(HIDDEN)}, '', 'g') AS shown FROM landed)
  )
)""",
)
define(
    "page_rows",
    ("meta",),
    f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY page_id) AS rn FROM (
    SELECT page_id, site_id, origin, etag, last_modified, lastmod, title, description, h1, snippet,
      content_hash, url FROM ({canon(
        "(SELECT * FROM meta WHERE status = 200 AND regexp_matches(content_type, '(?i)text/html|application/xhtml'))",
        "url", drop="url")})
  )
) WHERE rn = 1""",
)
