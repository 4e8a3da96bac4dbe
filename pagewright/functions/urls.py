"""URL columns: split, normalize, resolve, redact and the per-URL predicates.

Two readings of a URL are supported where the answers differ:

``gateway``  strict reading: control characters, broken escapes, bad ports and bad host
             characters make a URL unparseable; the path is percent-decoded.
``router``   lenient reading: tabs and newlines are dropped, ``;params`` leave the path,
             only broken ``[...]`` hosts are unparseable.
"""

from __future__ import annotations

from pagewright.functions.sql import Expr as Column, fn as F

from pagewright.functions.addresses import ipv6_hex
from pagewright.functions.text import (
    HOST_SAFE,
    PATH_SAFE,
    USER_SAFE,
    bad_escape,
    form_decode,
    let,
    percent_decode,
    percent_reencode,
)

GATEWAY, ROUTER, BROWSER = "gateway", "router", "browser"

_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):"


def decoded_host(raw_host: Column) -> Column:
    """Host name or address without brackets."""
    return percent_decode(F.regexp_replace(raw_host, r"^\[|\]\z", ""))


def _after(c: Column, head: Column, skip: int = 0) -> Column:
    return F.substring(c, F.length(head) + 1 + skip, 1 << 30)


def _before_last_at(authority: Column) -> Column:
    return F.regexp_extract(authority, r"(?s)^(.*)@", 1)


def _split_gateway(url: Column, request: bool = False) -> Column:
    """Gateway parts, bound stage by stage. A ``request`` target has no fragment: "#" is a plain character."""

    def fields(s: Column) -> Column:
        bracketed = s["hostport"].startswith("[")
        raw_host = F.when(bracketed, F.regexp_extract(s["hostport"], r"(?s)^(\[.*\])", 1)).otherwise(
            F.regexp_extract(s["hostport"], r"(?s)^(.*?)(?::[0-9]*)?\z", 1)
        )
        port_ok = F.when(bracketed, s["hostport"].rlike(r"(?s)^\[.*\](?::[0-9]*)?\z")).otherwise(
            s["hostport"].rlike(r"(?s)^(?:[^:]*|.*:[0-9]*)\z")
        )
        host_ok = ~s["hostport"].rlike(r"[ #\\^`{|}]") & ~F.when(bracketed, bad_escape(s["hostport"])).otherwise(
            s["hostport"].rlike("%(?![89A-Fa-f][0-9A-Fa-f])")
        )
        user_ok = ~s["userinfo"].rlike(r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]") & ~bad_escape(s["userinfo"])
        no_scheme_colon = (s["scheme"] == "") & ~s["rest"].startswith("/") & F.substring_index(s["rest"], "/", 1).contains(":")
        ok = (
            ~s["url"].rlike(r"[\x00-\x1f\x7f]")
            & ~s["url"].startswith(":")
            & ~no_scheme_colon
            & port_ok
            & host_ok
            & user_ok
            & ~bad_escape(s["raw_path"])
            & ~bad_escape(s["fragment"])
        )
        return F.struct(
            ok.alias("ok"),
            s["scheme"].alias("scheme"),
            s["opaque"].alias("opaque"),
            s["has_user"].alias("has_user"),
            s["userinfo"].alias("userinfo"),
            raw_host.alias("raw_host"),
            decoded_host(raw_host).alias("host"),
            F.regexp_extract(s["hostport"], r":([0-9]*)\z", 1).alias("port"),
            _after(s["hostport"], raw_host).alias("port_text"),
            s["raw_path"].alias("raw_path"),
            percent_decode(s["raw_path"]).alias("path"),
            s["has_query"].alias("has_query"),
            s["query"].alias("query"),
            s["fragment"].alias("fragment"),
        )

    def authority(s: Column) -> Column:
        has_authority = s["rest"].startswith("//") & ((s["scheme"] != "") | ~s["rest"].startswith("///"))
        auth = F.when(has_authority, F.regexp_extract(s["rest"], r"(?s)^//([^/]*)", 1)).otherwise(F.lit(""))
        opaque = F.when((s["scheme"] != "") & ~s["rest"].startswith("/"), s["rest"]).otherwise(F.lit(""))
        return F.struct(
            s["url"].alias("url"), s["scheme"].alias("scheme"), s["rest"].alias("rest"), s["has_query"].alias("has_query"),
            s["query"].alias("query"), s["fragment"].alias("fragment"), opaque.alias("opaque"),
            auth.contains("@").alias("has_user"),
            _before_last_at(auth).alias("userinfo"),
            F.regexp_replace(auth, r"(?s)^.*@", "").alias("hostport"),
            F.when(opaque != "", F.lit("")).when(has_authority, _after(s["rest"], auth, 2)).otherwise(s["rest"]).alias("raw_path"),
        )

    def query(s: Column) -> Column:
        scheme = F.regexp_extract(s["no_frag"], _SCHEME, 1)
        after = F.when(scheme != "", _after(s["no_frag"], scheme, 1)).otherwise(s["no_frag"])
        return let(
            F.struct(scheme.alias("scheme"), after.alias("after")),
            lambda t: F.struct(
                s["url"].alias("url"),
                s["fragment"].alias("fragment"),
                F.lower(t["scheme"]).alias("scheme"),
                F.substring_index(t["after"], "?", 1).alias("rest"),
                t["after"].contains("?").alias("has_query"),
                _after(t["after"], F.substring_index(t["after"], "?", 1), 1).alias("query"),
            ),
        )

    no_frag = url if request else F.substring_index(url, "#", 1)
    first = F.struct(url.alias("url"), no_frag.alias("no_frag"), _after(url, no_frag, 1).alias("fragment"))
    return let(first, lambda a: let(query(a), lambda b: let(authority(b), fields)))


def _split_router(url: Column) -> Column:
    def fields(s: Column) -> Column:
        hostport = F.regexp_replace(s["netloc"], r"(?s)^.*@", "")
        # The check looks at the first bracket of the whole authority, the host at that of its last part.
        checked = F.regexp_extract(s["netloc"], r"(?s)^[^\[]*\[([^\]]*)", 1)
        address = checked.rlike("(?s)^[^%]*(?:%[^%]+)?\\z") & ipv6_hex(F.substring_index(checked, "%", 1)).isNotNull()
        future = checked.rlike(r"^v[a-fA-F0-9]+\..+\z")
        brackets = s["netloc"].rlike(r"[\[\]]")
        ok = ~brackets | (s["netloc"].contains("[") & s["netloc"].contains("]") & (future | (~checked.startswith("v") & address)))
        host = F.when(hostport.contains("["), F.regexp_extract(hostport, r"(?s)^[^\[]*\[([^\]]*)", 1)).otherwise(
            F.substring_index(hostport, ":", 1)
        )
        has_params = s["scheme"].isin("", "ftp", "hdl", "http", "https", "imap", "mms", "prospero", "rtsp", "rtspu", "sftp", "shttp", "sip", "sips", "tel")
        path = F.when(
            has_params,
            F.when(s["path"].contains("/"), F.regexp_replace(s["path"], r"(?s)(/[^/;]*);[^/]*\z", "$1")).otherwise(
                F.substring_index(s["path"], ";", 1)
            ),
        ).otherwise(s["path"])
        return F.struct(
            ok.alias("ok"),
            s["scheme"].alias("scheme"),
            F.lower(host).alias("host"),
            path.alias("path"),
            s["query"].alias("query"),
            s["fragment"].alias("fragment"),
        )

    def rest(s: Column) -> Column:
        scheme = F.regexp_extract(s, _SCHEME, 1)
        after = F.when(scheme != "", _after(s, scheme, 1)).otherwise(s)
        return let(
            F.struct(F.lower(scheme).alias("scheme"), after.alias("after")),
            lambda t: let(
                F.struct(
                    t["scheme"].alias("scheme"),
                    F.regexp_extract(t["after"], r"(?s)^//([^/?#]*)", 1).alias("netloc"),
                    F.regexp_replace(t["after"], r"(?s)^//[^/?#]*", "").alias("tail"),
                ),
                lambda v: let(
                    F.substring_index(v["tail"], "#", 1),
                    lambda nf: F.struct(
                        v["scheme"].alias("scheme"),
                        v["netloc"].alias("netloc"),
                        F.substring_index(nf, "?", 1).alias("path"),
                        _after(nf, F.substring_index(nf, "?", 1), 1).alias("query"),
                        _after(v["tail"], nf, 1).alias("fragment"),
                    ),
                ),
            ),
        )

    cleaned = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "[\\t\\r\\n]", "")
    return let(cleaned, lambda c: let(rest(c), fields))


def request_parts(url: Column) -> Column:
    """U1 for a request target: it must be absolute or rooted."""

    def require_root(p: Column) -> Column:
        rooted = p["ok"] & (url != "") & ((p["scheme"] != "") | url.startswith("/"))
        return F.struct(rooted.alias("ok"), p["scheme"].alias("scheme"), p["host"].alias("host"))

    return let(_split_gateway(url, request=True), require_root)


def url_parts(url: Column, dialect: str = GATEWAY) -> Column:
    """Struct of URL parts with ``ok`` false where the URL is unparseable in the dialect."""
    return _split_gateway(url) if dialect == GATEWAY else _split_router(url)


# ---- writing a URL back ------------------------------------------------------------------------


def _encoded_path(raw: Column) -> Column:
    clean = ~raw.rlike(r"[^A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]")
    return F.when(clean, raw).otherwise(percent_reencode(raw, PATH_SAFE))


def _encoded_host(raw: Column) -> Column:
    return F.when(raw.rlike(r"[^\x00-\x7f]|%"), percent_reencode(raw, HOST_SAFE)).otherwise(raw)


def _encoded_user(p: Column) -> Column:
    name = F.substring_index(p["userinfo"], ":", 1)
    secret = F.when(p["userinfo"].contains(":"), F.concat(F.lit(":"), percent_reencode(_after(p["userinfo"], name, 1), USER_SAFE)))
    return F.when(p["has_user"], F.concat(percent_reencode(name, USER_SAFE), F.coalesce(secret, F.lit("")), F.lit("@"))).otherwise(F.lit(""))


def _write(p: Column, user: bool = True, query: bool = True) -> Column:
    """Serialize bound parts whose ``path`` is already encoded; the fragment is left out."""
    has_host = p["raw_host"] != ""
    slashes = (p["scheme"] != "") & (p["path"] != "") | has_host
    if user:
        slashes = slashes | p["has_user"]
    rooted = (p["path"] == "") | p["path"].startswith("/") | ~has_host
    parts = [
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(F.lit("")),
        F.when(slashes, F.lit("//")).otherwise(F.lit("")),
        _encoded_user(p) if user else F.lit(""),
        _encoded_host(p["raw_host"]),
        p["port_text"],
        F.when(rooted, F.lit("")).otherwise(F.lit("/")),
        p["path"],
    ]
    head = F.when(p["opaque"] != "", F.concat(p["scheme"], F.lit(":"), p["opaque"])).otherwise(F.concat(*parts))
    # A bare trailing "?" is not part of the query text and survives when the query is dropped.
    shown = p["has_query"] if query else p["has_query"] & (p["query"] == "")
    return F.when(shown, F.concat(head, F.lit("?"), p["query"])).otherwise(head)


_WRITTEN = ("scheme", "opaque", "has_user", "userinfo", "raw_host", "port_text", "has_query", "query")


def _fields(p: Column, **changes: Column) -> Column:
    return F.struct(*[(changes[n] if n in changes else p[n]).alias(n) for n in (*_WRITTEN, "path")])


def write_url(p: Column, user: bool = True, query: bool = True) -> Column:
    """Serialize gateway parts without the fragment."""
    return let(_fields(p, path=_encoded_path(p["raw_path"])), lambda w: _write(w, user, query))


def normalize_url(url: Column) -> Column:
    """Drop the fragment, re-encode the path, trim every trailing slash."""
    return let(
        _split_gateway(url),
        lambda p: F.when(p["ok"], F.regexp_replace(write_url(p), r"/+\z", "")).otherwise(url),
    )


def merge_paths(base: Column, ref: Column) -> Column:
    """RFC 3986 merge plus dot-segment removal; both sides percent-encoded."""
    full = (
        F.when(ref == "", base)
        .when(ref.startswith("/"), ref)
        .otherwise(F.concat(F.regexp_extract(base, r"(?s)^(.*/)", 1), ref))
    )

    def walk(f: Column) -> Column:
        stack = F.aggregate(
            F.split(f, "/"),
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((seg == ".") & (F.size(acc) > 0), acc)
            .when(seg == ".", F.array(F.lit("")))
            .otherwise(F.array_append(acc, seg)),
        )
        tail = F.when(f.rlike(r"(?:^|/)\.{1,2}\z"), F.lit("/")).otherwise(F.lit(""))
        dotted = F.regexp_replace(F.concat(F.lit("/"), F.array_join(stack, "/"), tail), "^//", "/")
        plain = F.when(f.startswith("/"), f).otherwise(F.concat(F.lit("/"), f))
        return F.when(f == "", f).when(f.rlike(r"(?:^|/)\.{1,2}(?:/|\z)"), dotted).otherwise(plain)

    return let(full, walk)


def base_parts(url: Column) -> Column:
    """Gateway parts of a base URL with the path encoded, ready for ``resolve_url``."""
    return let(
        _split_gateway(url),
        lambda p: F.struct(p["ok"].alias("ok"), *[p[n].alias(n) for n in _WRITTEN], _encoded_path(p["raw_path"]).alias("path")),
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base_parts``; NULL where ``ref`` is unparseable."""
    return let(resolved_parts(base, ref), lambda w: F.when(w.isNotNull(), _write(w)))


def written_url(parts: Column) -> Column:
    """The URL of ``resolved_parts``."""
    return _write(parts)


def resolved_parts(base: Column, ref: Column) -> Column:
    """U3 before serialization: the parts of the resolved URL, path encoded; NULL where ``ref`` is unparseable."""

    def merged(r: Column) -> Column:
        own = (r["scheme"] != "") | (r["raw_host"] != "") | r["has_user"]
        bare = (r["raw_path"] == "") & ~r["has_query"]
        pick = lambda name: F.when(own, r[name]).otherwise(base[name])
        changes = dict(
            scheme=F.when(r["scheme"] != "", r["scheme"]).otherwise(base["scheme"]),
            opaque=F.when(own, r["opaque"]).when(r["raw_path"] == "", base["opaque"]).otherwise(F.lit("")),
            has_user=pick("has_user"),
            userinfo=pick("userinfo"),
            raw_host=pick("raw_host"),
            port_text=pick("port_text"),
            has_query=F.when(own | ~bare, r["has_query"]).otherwise(base["has_query"] & (base["query"] != "")),
            query=F.when(own | ~bare, r["query"]).otherwise(base["query"]),
            path=let(
                _encoded_path(r["raw_path"]),
                lambda path: merge_paths(F.when(own, path).otherwise(base["path"]), F.when(own, F.lit("")).otherwise(path)),
            ),
        )
        return F.when(r["ok"], _fields(r, **changes))

    return let(_split_gateway(ref), merged)


def redact_url(url: Column, dialect: str = GATEWAY) -> Column:
    """U4: drop user info, query and fragment."""
    if dialect == GATEWAY:

        def gateway(p: Column) -> Column:
            return F.when(~p["ok"], url).otherwise(write_url(p, user=False, query=False))

        return let(_split_gateway(url), gateway)

    def browser(t: Column) -> Column:
        scheme = F.lower(F.regexp_extract(t, _SCHEME, 1))
        web = scheme.isin("http", "https")
        rest = F.regexp_replace(_after(t, scheme, 1), r"(?s)[?#].*\z", "")
        slashed = F.translate(rest, "\\", "/")
        authority = F.regexp_extract(slashed, r"(?s)^/*([^/]*)", 1)
        hostport = F.lower(F.regexp_replace(authority, r"(?s)^.*@", ""))
        default_port = F.when(scheme == "http", F.regexp_replace(hostport, r":(?:0*80)?\z", "")).otherwise(
            F.regexp_replace(hostport, r":(?:0*443)?\z", "")
        )
        valid_host = hostport.rlike(r"^(?:\[[0-9a-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|]+)(?::[0-9]*)?\z")
        path = F.regexp_replace(slashed, r"(?s)^/*[^/]*", "")
        clean = merge_paths(F.lit("/"), F.when(path == "", F.lit("/")).otherwise(path))
        encoded = F.when(clean.rlike(r"[^\x21-\x7e]|[\"<>`{}^]"), _percent_encode_controls(clean)).otherwise(clean)
        other = F.regexp_replace(t, r"(?s)[?#].*\z", "")
        return (
            F.when(scheme == "", F.lit("<invalid-url>"))
            .when(web & ~valid_host, F.lit("<invalid-url>"))
            .when(web, F.concat(scheme, F.lit("://"), default_port, encoded))
            .otherwise(F.concat(scheme, _after(other, scheme)))
        )

    cleaned = F.regexp_replace(F.btrim(url, F.lit("".join(map(chr, range(0x21))))), "[\\t\\r\\n]", "")
    return let(cleaned, browser)


def _percent_encode_controls(c: Column) -> Column:
    units = F.split(c, "")
    return F.array_join(
        F.transform(
            units,
            lambda u: F.when(
                u.rlike(r"[^\x21-\x7e]|[\"<>`{}^]"),
                F.regexp_replace(F.hex(F.encode(u, "UTF-8")), "(..)", "%$1"),
            ).otherwise(u),
        ),
        "",
    )


# ---- predicates --------------------------------------------------------------------------------

# Extensions the crawl filter drops.
CRAWL_SKIP_EXTENSIONS = (
    "pdf", "zip", "tar", "gz", "exe", "dmg", "pkg", "deb", "rpm", "iso", "img", "png", "jpg", "jpeg", "gif", "svg",
    "webp", "ico", "bmp", "tiff", "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm", "ogg", "wav", "css", "js", "woff",
    "woff2", "ttf", "eot", "otf", "map",
)

# Extensions the router skips.
ROUTER_SKIP_EXTENSIONS = (
    "pdf", "zip", "tar", "gz", "bz2", "xz", "rar", "7z", "exe", "msi", "dmg", "pkg", "deb", "rpm", "png", "jpg",
    "jpeg", "gif", "svg", "ico", "bmp", "webp", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "doc", "docx",
    "xls", "xlsx", "ppt", "pptx", "iso", "img", "bin", "apk", "ipa", "woff", "woff2", "ttf", "eot", "css", "js",
    "map",
)

# Junk path segments and their labels, in order of precedence.
JUNK_SEGMENTS = {
    "cart": "shopping cart",
    "login": "login page",
    "signin": "sign-in page",
    "signup": "signup page",
    "register": "registration page",
    "account": "account page",
    "checkout": "checkout page",
    "wp-admin": "WordPress admin",
    "feed": "feed endpoint",
    "rss": "RSS feed",
    "print": "print view",
    "share": "share page",
    "unsubscribe": "unsubscribe page",
    "password[-_]?reset": "password reset",
}

MAX_QUERY_KEYS = 5


def is_web_scheme(scheme: Column) -> Column:
    """U5."""
    return scheme.isin("http", "https")


def is_crawl_asset(path: Column) -> Column:
    """The path ends in an extension the crawl never follows."""
    return path.rlike(r"(?i)\.(?:" + "|".join(CRAWL_SKIP_EXTENSIONS) + r")\z")


def router_skip_extension(path: Column) -> Column:
    """U8: the skipped extension of a lower-cased path, or NULL."""
    found = F.regexp_extract(path, r"(\.(?:" + "|".join(ROUTER_SKIP_EXTENSIONS) + r"))\z", 1)
    return F.nullif(found, F.lit(""))


def matches_any(text: Column, patterns: Column) -> Column:
    """Some pattern is a substring."""
    return F.exists(patterns, lambda p: F.contains(text, p))


def passes_patterns(text: Column, include: Column, exclude: Column) -> Column:
    """Include only if given, exclude wins after it."""
    return (F.coalesce(F.size(include), F.lit(0)).isin(0, -1) | matches_any(text, include)) & ~F.coalesce(
        matches_any(text, exclude), F.lit(False)
    )


def junk_label(path: Column) -> Column:
    """Label of the first junk pattern in the path, or NULL."""
    chain = F.when(F.lit(False), F.lit(""))
    for segment, label in JUNK_SEGMENTS.items():
        chain = chain.when(path.rlike(rf"(?i)/{segment}(?:/|\z|\?)"), F.lit(label))
    return F.when(path.rlike(r"(?i)/(?:" + "|".join(JUNK_SEGMENTS) + r")(?:/|\z|\?)"), chain)


def query_key_count(query: Column) -> Column:
    """Distinct decoded keys that have a non-blank value."""
    with_value = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    keys = F.transform(with_value, lambda p: form_decode(F.substring_index(p, "=", 1)))
    return F.when(query == "", F.lit(0)).otherwise(F.size(F.array_distinct(keys)))


def skip_decision(url: Column) -> Column:
    """STRUCT<skip, reason>; an unparseable URL is kept."""

    def decide(s: Column) -> Column:
        reason = (
            F.when(~s["ok"], F.lit(""))
            .when(s["ext"].isNotNull(), F.concat(F.lit("binary/non-HTML file extension: "), s["ext"]))
            .when(s["junk"].isNotNull(), F.concat(F.lit("junk URL pattern: "), s["junk"]))
            .when(s["keys"] > MAX_QUERY_KEYS, F.concat(F.lit("excessive query parameters: "), s["keys"].cast("string")))
            .otherwise(F.lit(""))
        )
        return let(reason, lambda r: F.struct((r != "").alias("skip"), r.alias("reason")))

    def probe(p: Column) -> Column:
        path = F.lower(p["path"])
        return F.struct(
            p["ok"].alias("ok"),
            router_skip_extension(path).alias("ext"),
            junk_label(path).alias("junk"),
            query_key_count(p["query"]).alias("keys"),
        )

    return let(_split_router(url), lambda p: let(probe(p), decide))
