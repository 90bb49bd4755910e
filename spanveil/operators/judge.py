"""Heuristic judge: labels of entities (test, business, personal; null: abstains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.validators import is_secret_kind

# Fixed values.
CONFIDENCE = 0.95
TEST_DOMAINS = ("example.com", "example.org", "example.net")
TEST_SUFFIXES = (".invalid", ".test", ".example")
ROLES = ("support", "billing", "sales", "info", "admin", "noreply", "no-reply", "security", "help", "contact")


def email_label(value: Column) -> Column:
    domain = F.lower(F.regexp_replace(F.substring_index(value, "@", -1), r"\.+\z", ""))
    local = F.lower(F.regexp_replace(value, r"@[^@]*\z", ""))
    suffix = F.lit(False)
    for s in TEST_SUFFIXES:
        suffix = suffix | (F.endswith(domain, F.lit(s)) & (F.length(domain) > len(s)))
    return F.when(domain.isin(*TEST_DOMAINS) | suffix | (domain == "localhost"), "test").when(local.isin(*ROLES), "business").otherwise("personal")


def label(kind: Column, value: Column) -> Column:
    return F.when(is_secret_kind(kind), F.lit(None).cast("string")).when(F.contains(value, F.lit("@")), email_label(value)).when(kind.isin("email", "phone", "iban"), "personal")
