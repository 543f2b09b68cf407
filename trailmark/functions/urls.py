"""URL functions on columns. All stay in the JVM, except resolving a relative reference."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Parameters, words, hosts and file endings that results depend on.
TRACKING = r"(?i)^(utm_.*|_ga|_gl|fbclid|igshid|mc_cid|mc_eid|ref_src)$"
AD_CLICK = r"(?i)^(gclid|gclsrc|dclid|gad_source|gad_campaignid|gbraid|wbraid|msclkid|twclid|yclid|li_fat_id)$"
ACTION = r"(?i)(logout|log_out|signout|sign_out|delete|remove|unsubscribe|/edit\b)"
SLIDES = r"\.(pptx?|key)$"
VIDEO = r"\.(mp4|mov|webm|m4v)$"
VIDEO_HOST = r"(youtube\.com|youtu\.be|panopto|vimeo)"
FILE = r"\.(docx?|xlsx?|zip|tar|gz|txt|md|ipynb|py|java|go|c|h|cpp|rs|png|jpe?g|gif|svg)$"
OPAQUE = r"(?i)^([0-9a-f]{12,}|[0-9a-f-]{32,36})$"
TERM_LIKE = r"(?i)^(\d+[a-z]{0,2}|[a-z]?\d+|[0-9a-f-]{12,})$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def path_key(url: Column) -> Column:
    return F.concat(origin(url), path(url))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def directory(url: Column) -> Column:
    """The path up to its last slash."""
    return F.coalesce(F.nullif(F.regexp_extract(path(url), r"^(.*/)", 1), F.lit("")), F.lit("/"))


def _decoded(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def _encoded(s: Column) -> Column:
    """As form encoders do, apart from * and ~."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquoted(s: Column) -> Column:
    """Percent escapes decoded; a plus stays one."""
    return _decoded(F.replace(s, F.lit("+"), F.lit("%2B")))


def normalize(url: Column) -> Column:
    """Absolute http(s) URL in one form, without fragment, user, default port and tracking parameters, or with no
    parameter at all if an advertisement led there; null if it is not one."""
    url = F.trim(url)
    port = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    is_default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443")) | (port == "")
    where = F.concat(host(url), F.when(is_default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise(F.lit("")).alias("v"),
        ),
    )
    ad = F.exists(pairs, lambda p: p["k"].rlike(AD_CLICK))
    kept = F.filter(pairs, lambda p: ~ad & ~p["k"].rlike(TRACKING))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    full = F.concat(
        scheme(url), F.lit("://"), where, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit(""))
    )
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), full)


@F.pandas_udf(T.StringType())
def resolve(reference: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute form of a reference found on the page `base`; null if it has none."""

    def one(r, b):
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(r, b) if r is not None and b is not None else None for r, b in zip(reference, base)])


def kind(url: Column) -> Column:
    p, h = F.lower(path(url)), host(url)
    return (
        F.when(p.endswith(".pdf"), "pdf")
        .when(p.rlike(SLIDES) | ((h == "docs.google.com") & p.startswith("/presentation")), "slides")
        .when(p.rlike(VIDEO) | h.rlike(VIDEO_HOST), "video")
        .when(p.rlike(FILE), "file")
        .otherwise("html")
    )


def _blank_numbers(s: Column) -> Column:
    return F.when(s.rlike(OPAQUE), F.lit("{id}")).otherwise(F.regexp_replace(s, r"\d+", "{n}"))


def template(url: Column) -> Column:
    """host/path with numbers and opaque ids blanked."""
    return F.concat(host(url), F.lit("/"), F.array_join(F.transform(segments(url), _blank_numbers), "/"))


def segment_shape(s: Column) -> Column:
    """As in template(), and short ids that mix letters and digits are blanked too."""
    mixed = s.rlike(r"^[A-Za-z0-9_-]{5,}$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return F.when(mixed, F.lit("{id}")).otherwise(_blank_numbers(s))


def lookalike_key(url: Column) -> Column:
    return F.regexp_replace(template(url), r"^www\.", "")


def in_scope(url: Column, scope_origin: Column, prefix: Column) -> Column:
    return (origin(url) == scope_origin) & F.startswith(F.concat(F.regexp_replace(path(url), "/+$", ""), F.lit("/")), prefix)


def relation(from_url: Column, to_url: Column, scope_origin: Column, prefix: Column) -> Column:
    """outside the scope, deeper (below the linking page's directory) or sideways."""
    below = F.startswith(path(to_url), directory(from_url)) & (path(to_url) != path(from_url))
    return F.when(~in_scope(to_url, scope_origin, prefix), "outside").when(below, "deeper").otherwise("sideways")


def is_action(url: Column) -> Column:
    return url.rlike(ACTION)


def words(url: Column) -> Column:
    """Searchable words of host and path, runs of letters and of digits apart."""
    text = F.concat_ws(" ", host(url), path(url))
    text = F.regexp_replace(F.regexp_replace(text, "([a-zA-Z])([0-9])", "$1 $2"), "([0-9])([a-zA-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def alias(scope_origin: Column, prefix: Column) -> Column:
    """A place's short name: its last telling path segment, else its site's name."""
    named = F.filter(F.transform(F.filter(F.split(prefix, "/"), lambda s: s != ""), unquoted), lambda s: (F.length(s) > 1) & ~s.rlike(TERM_LIKE))
    labels = F.filter(F.split(host(F.concat(scope_origin, F.lit("/"))), r"\."), lambda x: x != "www")
    n = F.size(labels)
    two_level = (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    site = F.when(two_level, F.try_element_at(labels, F.lit(-3))).when(n >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.try_element_at(labels, F.lit(1)))
    return F.coalesce(F.left(F.lower(F.try_element_at(named, F.lit(-1))), F.lit(40)), site)


def short(url: Column) -> Column:
    """Host and path for display, 60 characters at most."""
    text = F.concat(bare_host(url), F.regexp_replace(path(url), "/$", ""))
    return F.when(F.length(text) > 60, F.concat(F.left(text, F.lit(57)), F.lit("…"))).otherwise(text)
