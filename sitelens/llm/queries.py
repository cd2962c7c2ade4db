"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, decontaminate, divergence, html_extract, language_id, license_scan, near_dup, packing, sharding, suffix_dedup, token_align, toxicity, url_filter

_MODULES = [html_extract, license_scan, packing, suffix_dedup, ann, near_dup, url_filter, toxicity, decontaminate, language_id, sharding, divergence, token_align]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
