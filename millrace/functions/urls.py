"""URL parts and dataset-page classification as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import any_of

URL_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*:)?"
NETLOC = URL_HEAD + r"//([^/?#]*)"
PATH = URL_HEAD + r"(//[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def host(url: Column) -> Column:
    """Network location; empty without ``//``."""
    return F.regexp_extract(url, NETLOC, 2)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 3), r";[^/]*$", "")


def dataset_url_reason(url: Column, exact_domain: bool = False) -> Column:
    """Why a URL is kept or not, tests in order: trusted domain, file suffix, junk words, path keywords.

    The domain test is a substring test unless ``exact_domain`` (the domain itself or a subdomain).
    """
    lowered = F.lower(url)
    domain = F.replace(host(lowered), F.lit("www."), F.lit(""))
    where = path(lowered)
    if exact_domain:
        names = "|".join(re.escape(d) for d in fixed.TRUSTED_DOMAINS)
        trusted = domain.rlike(rf"(^|\.)({names})(:\d+)?$")
    else:
        trusted = any_of([domain.contains(d) for d in fixed.TRUSTED_DOMAINS])
    suffix = any_of([where.endswith(s) for s in fixed.DATASET_SUFFIXES])
    junk = lowered.rlike("|".join(fixed.JUNK_PATTERNS))
    keyword = any_of([where.contains(k) for k in fixed.PATH_KEYWORDS])
    broken = domain.contains("[") != domain.contains("]")
    return (
        F.when(url.isNull() | broken, "invalid")
        .when(trusted, "trusted_domain")
        .when(suffix, "file_suffix")
        .when(junk, "junk")
        .when(keyword, "path_keyword")
        .otherwise("no_signal")
    )


def is_kept(reason: Column) -> Column:
    return reason.isin("trusted_domain", "file_suffix", "path_keyword")
