"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host without port and without one leading www."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(found, r"^www[.]", "")


def domain(url: Column) -> Column:
    """Last two labels of the host."""
    return F.array_join(F.slice(F.split(host(url), "[.]"), F.greatest(F.size(F.split(host(url), "[.]")) - 1, F.lit(1)), F.lit(2)), ".")


def page_key(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def path_key(url: Column) -> Column:
    """Host and path only."""
    return F.concat(host(url), F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", ""))


def source_unit(url: Column) -> Column:
    """What a URL counts as when sources are counted: a DOI, a preprint, a record, a repository, else its host."""
    low = F.lower(url)
    doi = F.regexp_extract(low, r"doi[.]org/(10[.][0-9]{4,9}/[^?#]+)", 1)
    preprint = F.regexp_extract(low, r"arxiv[.]org/(?:abs|pdf)/([0-9]{4}[.][0-9]{4,5})", 1)
    work = F.regexp_extract(low, r"openalex[.]org/(w[0-9]+)", 1)
    repo = F.regexp_extract(low, r"github[.]com/([^/?#]+/[^/?#]+)", 1)
    return (
        F.when(doi != "", F.concat(F.lit("doi:"), doi))
        .when(preprint != "", F.concat(F.lit("arxiv:"), preprint))
        .when(work != "", F.concat(F.lit("openalex:"), work))
        .when(repo != "", F.concat(F.lit("github:"), repo))
        .otherwise(F.concat(F.lit("host:"), host(url)))
    )


def layer(url: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """Name of the first rule (name, pattern of the host) that fits."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(host(url).rlike(pattern), name).otherwise(out)
    return out


def trust(url: Column, high: list[str], low: list[str]) -> Column:
    """high, low or medium by lists of domains; a host is of a domain if equal or below it."""
    h = host(url)
    of = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
    return F.when(of(high), "high").when(of(low), "low").otherwise("medium")


def allowed(url: Column) -> Column:
    """http or https, a host with a dot that is no bare address, no user part, port 80 or 443 if any."""
    authority = F.regexp_extract(F.lower(url), r"^https?://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    name = F.regexp_replace(authority, r":[0-9]*$", "")
    return F.coalesce((authority != "") & ~authority.contains("@") & port.isin("", "80", "443") & name.contains(".") & ~name.rlike(r"^[0-9.]+$") & ~name.rlike(r"(?:^|[.])(?:localhost|local|internal)$"), F.lit(False))
