"""URL columns.

``canonical`` resolves and canonicalises one link; the other helpers take canonical
URLs and are plain Column expressions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L

# Visible ASCII that a path keeps as it is; everything else is percent-encoded.
PATH_SAFE = r"[!#-;=?-\]_a-z|~]"
PATH_UNSAFE = r"[^!#-;=?-\]_a-z|~]"
DOT_SEGMENT = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"
HOST_SHAPE = r"^(\[[0-9a-f:.]+\]|[^\s\x00-\x20<>\\^|%#?@:/\[\]]+)$"
MAX_DEPTH_VALUE = 9_007_199_254_740_991


def _after(text: Column, found: Column, skip: int) -> Column:
    return F.substr(text, found + F.lit(skip))


def _scheme_of(head: Column) -> Column:
    return F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _resolve_dots(path: Column) -> Column:
    segments = F.split(F.substr(path, F.lit(2)), "/")

    def step(done: Column, seg: Column) -> Column:
        plain = F.replace(F.lower(seg), F.lit("%2e"), F.lit("."))
        return (
            F.when(plain == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(plain == ".", done)
            .otherwise(F.array_append(done, seg))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.replace(F.lower(F.element_at(segments, -1)), F.lit("%2e"), F.lit("."))
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _encode_path(path: Column) -> Column:
    runs = F.regexp_extract_all(path, F.lit(f"{PATH_SAFE}+|{PATH_UNSAFE}+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^" + PATH_SAFE), r).otherwise(
                F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )


def _form_decode(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def param_name(pair: Column) -> Column:
    return _form_decode(F.substring_index(pair, "=", 1))


def is_tracking(name: Column) -> Column:
    return name.rlike(L.TRACKING_PARAM)


def query_pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _clean_query(query: Column) -> Column:
    kept = F.filter(query_pairs(query), lambda p: ~is_tracking(param_name(p)))

    def encode(pair: Column) -> Column:
        value = F.when(
            F.instr(pair, "=") > 0, F.substr(pair, F.instr(pair, "=") + F.lit(1))
        ).otherwise("")
        return F.concat(
            F.url_encode(param_name(pair)), F.lit("="), F.url_encode(_form_decode(value))
        )

    return F.array_join(F.transform(kept, encode), "&")


def _bound(env: dict[str, Column], steps: list, result) -> Column:
    """Evaluate ``steps`` in turn, each naming its values once, then ``result``.

    Names are lambda variables over one-element arrays, so later steps use them
    freely without the expression, or a filter pushed into it, growing.
    """
    if not steps:
        return result(env)
    named = steps[0](env)
    row = F.struct(*[value.alias(name) for name, value in named.items()])
    return F.get(
        F.transform(
            F.array(row),
            lambda s: _bound({**env, **{k: s[k] for k in named}}, steps[1:], result),
        ),
        F.lit(0),
    )


def _split_link(e: dict) -> dict:
    head = e["head"]
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
    absolute = head.rlike(scheme + "//")
    return {
        "own_scheme": _scheme_of(head),
        "absolute": absolute,
        "own_auth": F.when(absolute, F.regexp_extract(head, scheme + "//([^/]*)", 1)),
        "own_path": F.regexp_replace(head, scheme + "(?://[^/]*)?", ""),
    }


def _resolve(e: dict) -> dict:
    """Scheme, authority, path and query, taken from the base where the link has none."""
    base = e["base"]
    base_path = F.coalesce(
        F.nullif(F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")
    )
    base_scheme = _scheme_of(base)
    # "https:x" under an https base is relative, any other scheme without "//" is not
    relative = ~e["absolute"] & e["own_scheme"].isin("", base_scheme)
    empty = e["own_path"] == ""
    return {
        "scheme": F.when(e["own_scheme"] != "", e["own_scheme"]).otherwise(base_scheme),
        "auth": F.when(e["absolute"], e["own_auth"]).when(
            relative, F.regexp_extract(base, r"^[^:]+://([^/?#]*)", 1)
        ),
        "query": F.when(
            ~e["absolute"] & empty & e["given_query"].isNull(),
            F.regexp_extract(base, r"(\?[^#]*)", 1),
        ).otherwise(e["given_query"]),
        "full_path": F.when(e["absolute"] & empty, "/")
        .when(e["absolute"] | e["own_path"].startswith("/"), e["own_path"])
        .when(empty, base_path)
        .otherwise(F.concat(F.regexp_extract(base_path, r"^(.*/)", 1), e["own_path"])),
    }


def _split_host(e: dict) -> dict:
    hostport = F.substring_index(e["auth"], "@", -1)
    host = F.lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1))
    return {
        "userinfo": F.substr(e["auth"], F.lit(1), F.length(e["auth"]) - F.length(hostport)),
        "host": host,
        "port": _after(hostport, F.length(host), 1),
        "flat_path": F.when(
            e["full_path"].rlike(DOT_SEGMENT), _resolve_dots(e["full_path"])
        ).otherwise(e["full_path"]),
    }


def _encode_parts(e: dict) -> dict:
    return {
        "port_no": F.regexp_extract(e["port"], r"^:0*(\d{1,5})$", 1).try_cast("int"),
        "safe_path": F.when(
            e["flat_path"].rlike(PATH_UNSAFE), _encode_path(e["flat_path"])
        ).otherwise(e["flat_path"]),
        "clean_query": F.when(
            F.length(e["query"]) > 1, _clean_query(F.substr(e["query"], F.lit(2)))
        ),
    }


def _canonical(e: dict) -> Column:
    default_port = F.when(e["scheme"] == "https", 443).otherwise(80)
    port = F.when(
        e["port_no"].isNotNull() & (e["port_no"] != default_port),
        F.concat(F.lit(":"), e["port_no"].cast("string")),
    ).otherwise("")
    path = F.when(
        (F.length(e["safe_path"]) > 1) & e["safe_path"].endswith("/"),
        F.substr(e["safe_path"], F.lit(1), F.length(e["safe_path"]) - 1),
    ).otherwise(e["safe_path"])
    valid = (
        e["scheme"].isin("http", "https")
        & e["host"].rlike(HOST_SHAPE)
        & e["port"].rlike(r"^(:0*\d{0,5})?$")
        & (F.coalesce(e["port_no"], F.lit(0)) <= 65535)
    )
    query = F.when(e["clean_query"] != "", F.concat(F.lit("?"), e["clean_query"])).otherwise("")
    prefix = F.concat(e["scheme"], F.lit("://"))
    return F.when(
        valid,
        F.struct(
            F.concat(prefix, e["userinfo"], e["host"], port, path, query).alias("url"),
            F.concat(prefix, e["host"], port).alias("origin"),
            path.alias("path"),
        ),
    )


def canonical(href: Column, base: Column | None = None) -> Column:
    """Struct of canonical ``url``, ``origin`` and ``path``; null unless an http(s) URL.

    ``href`` is resolved against the absolute ``base``; fragment and tracking
    parameters are dropped, the host is lower-cased, the query is re-serialised
    and one trailing slash is removed.
    """
    edges = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
    bare = F.substring_index(F.regexp_replace(href, edges, ""), "#", 1)
    steps = [
        lambda e: {
            "head": F.translate(F.substring_index(bare, "?", 1), "\\", "/"),
            "given_query": F.nullif(F.regexp_extract(bare, r"(?s)(\?.*)$", 1), F.lit("")),
            "base": F.lit("") if base is None else base,
        },
        _split_link,
        _resolve,
        _split_host,
        _encode_parts,
    ]
    return F.when(href.isNotNull(), _bound({}, steps, _canonical))


@lru_cache(maxsize=64)
def _named_canonical(jvm: int, href: str, base: str | None) -> Column:
    """The expression over named columns, built once per JVM: it has some hundred nodes."""
    return canonical(F.col(href), None if base is None else F.col(base))


def canonical_urls(
    df: DataFrame,
    href: str,
    base: str | None = None,
    out: str = "url",
    parts: bool = False,
) -> DataFrame:
    """Add ``out``, the canonical form of ``href``; ``parts`` also adds origin and path.

    The form comes out of a generator, which filters and join conditions are not pushed
    through: each of them would work it out anew.
    """
    made = _named_canonical(id(df.sparkSession._jvm), href, base)
    added = {out: "url"}
    if parts:
        added |= {f"{out}_origin": "origin", f"{out}_path": "path"}
    kept = [c for c in df.columns if c not in added]
    return df.select("*", F.explode(F.array(made)).alias("__url")).select(
        *kept, *[F.col("__url")[field].alias(name) for name, field in added.items()]
    )


def origin_of(url: Column) -> Column:
    """Scheme, host and non-default port of a canonical URL, null for other text."""
    scheme = F.regexp_extract(url, r"^(https?://)", 1)
    authority = F.substring_index(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), "@", -1)
    return F.when(authority != "", F.concat(scheme, authority))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)


def site_origins(df: DataFrame, text: str, out: str = "origin") -> DataFrame:
    """Add the canonical site origin of free text; null when invalid or on a blocked host."""
    d = canonical_urls(df, text, out="__site", parts=True)
    return d.withColumn(
        out, F.when(public_host(F.col("__site_origin")).isNotNull(), F.col("__site_origin"))
    ).drop("__site", "__site_origin", "__site_path")


def path_of(url: Column) -> Column:
    """Path of a URL; text that is no URL is its own path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), path).otherwise(url)


def segment_count(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("bigint")


def path_depth(url: Column) -> Column:
    """Non-empty path segments; text that is no URL sorts last."""
    return F.when(
        url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"), segment_count(path_of(url))
    ).otherwise(F.lit(MAX_DEPTH_VALUE))


def is_homepage(url: Column, origin: Column) -> Column:
    return path_of(url).isin("/", "") & F.startswith(url, origin)


def is_crawlable_path(path: Column) -> Column:
    return ~path.rlike(L.PATH_BLOCKLIST) & ~path.rlike(L.NON_HTML_EXTENSION)


def is_disallowed(path: Column, disallow: Column) -> Column:
    prefixes = F.coalesce(disallow, F.array().cast("array<string>"))
    return F.exists(prefixes, lambda d: F.startswith(path, d))


def _quad(value: Column) -> Column:
    byte = [(F.shiftright(value, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *byte)


def dotted_quad(host: Column) -> Column:
    """Dotted form of integer, octal and hex hosts and of IPv4-mapped IPv6; else the host."""
    high = F.conv(F.regexp_extract(host, r"^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}$", 1), 16, 10)
    low = F.conv(F.regexp_extract(host, r"^::ffff:[0-9a-f]{1,4}:([0-9a-f]{1,4})$", 1), 16, 10)
    mapped_hex = high.try_cast("bigint") * 65536 + low.try_cast("bigint")
    number = (
        F.when(host.rlike(r"^0x0*[0-9a-f]{1,8}$"), F.conv(F.regexp_extract(host, r"^0x0*([0-9a-f]{1,8})$", 1), 16, 10))
        .when(host.rlike(r"^00*[0-7]{1,11}$"), F.conv(F.regexp_extract(host, r"^00*([0-7]{1,11})$", 1), 8, 10))
        .when(host.rlike(r"^(0|[1-9]\d{0,9})$"), host)
    ).try_cast("bigint")
    return (
        F.when(host.rlike(r"^::ffff:\d+\.\d+\.\d+\.\d+$"), F.substr(host, F.lit(8)))
        .when(host.rlike(r"^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), _quad(mapped_hex))
        .when(number.between(0, 4294967295), _quad(number))
        .otherwise(host)
    )


def is_blocked_host(host: Column) -> Column:
    """Loopback, private and link-local hosts, in any of their spellings."""
    steps = [
        lambda e: {"plain": F.lower(F.regexp_replace(host, r"^\[(.*)\]$", "$1"))},
        lambda e: {"quad": dotted_quad(e["plain"])},
    ]
    return _bound(
        {},
        steps,
        lambda e: (e["plain"] == "localhost")
        | e["plain"].endswith(".localhost")
        | e["plain"].isin("::1", "::")
        | e["plain"].rlike(r"^fe[89ab][0-9a-f]:|^f[cd][0-9a-f]{2}:")
        | e["quad"].rlike(L.PRIVATE_IPV4),
    )


def public_host(origin: Column) -> Column:
    """Host of a canonical origin, null where it is blocked."""
    return _bound(
        {},
        [lambda e: {"host": host_of(origin)}],
        lambda e: F.when(~is_blocked_host(e["host"]), e["host"]),
    )
