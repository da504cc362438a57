"""URL keys: what makes two addresses the same host, page or path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HTTP = r"(?i)^https?://"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host_key(value: Column | str) -> Column:
    """Lower-cased host without one leading www., one trailing dot, port or path; of a bare host, a URL or sc-domain:."""
    v = F.regexp_replace(F.trim(_c(value)), r"(?i)^(sc-domain:|https?://)", "")
    host = F.lower(F.regexp_extract(v, r"^([^/?#:\s]+)(?:[:/?#]|$)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", "")
    return F.when(host.rlike(r"^[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+$|^localhost$"), host)


def _path(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def url_key(url: Column | str, keep_query: bool = True) -> Column:
    """host[:port]path[?query] of an http address: scheme, default port, trailing slashes and fragment dropped; else null."""
    u = F.trim(_c(url))
    port = F.regexp_extract(u, r"(?i)^https?://[^/?#:]+:(\d+)", 1)
    default = (u.rlike(r"(?i)^https:") & (port == "443")) | (u.rlike(r"(?i)^http:") & (port == "80"))
    shown = F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port))
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1) if keep_query else F.lit("")
    return F.when(u.rlike(_HTTP), F.concat(host_key(u), shown, _path(u), query))


def decode_uri(path: Column) -> Column:
    """Percent escapes decoded but those of / ? # & + and their like; what can't be decoded stays."""
    kept = F.regexp_replace(path, r"(?i)%(2F|3F|23|26|2B|3B|2C|3A|40|3D|24)", "%25$1")
    return F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), path)


def path_key(value: Column | str) -> Column:
    """The path of a URL or /path without query, fragment and trailing slash; anything else is null."""
    v = F.trim(_c(value))
    own = F.regexp_replace(F.regexp_extract(v, r"^(/[^?#]*)", 1), "/+$", "")
    return F.when(v.rlike(_HTTP), decode_uri(_path(v))).when(v.startswith("/"), decode_uri(F.when(own == "", "/").otherwise(own)))


def landing_url(origin: Column | str, landing: Column | str) -> Column:
    o = F.lit(origin) if isinstance(origin, str) else origin
    return F.when(_c(landing).startswith("/"), F.concat(o, _c(landing)))


def same_url(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(url_key(a) == url_key(b), F.lit(False))


def property_domain(prop: Column | str) -> Column:
    return F.when(_c(prop).startswith("sc-domain:"), F.substring_index(_c(prop), "sc-domain:", -1))


def in_property(url: Column | str, prop: Column | str) -> Column:
    """A domain property covers its subdomains under both schemes; a prefix property what begins with it."""
    host, domain = host_key(url), host_key(property_domain(prop))
    covers = (host == domain) | host.endswith(F.concat(F.lit("."), domain))
    return F.coalesce(F.when(domain.isNotNull(), covers).otherwise(_c(url).startswith(_c(prop))), F.lit(False))
