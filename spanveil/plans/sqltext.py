"""DuckDB SQL for the same rows, made from the same tables of patterns."""

from __future__ import annotations

from ..functions.patterns import SECRET_KINDS, SECRET_PARTS, SPECS
from ..functions.validators import PREFIX, REDACTED
from ..operators.judge import ROLES, TEST_DOMAINS, TEST_SUFFIXES


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def candidates(table: str, key: str, text: str, extra: str = "") -> str:
    """SELECT of every kind's matches: key, kind, start, end, cp_start, cp_end, value, confidence, ord."""
    parts = []
    for o, s in enumerate(SPECS):
        p = q(s.pattern)
        parts.append(f"""SELECT {key}{extra}, {q(s.kind)} AS kind, {s.confidence}::DOUBLE AS confidence, {o} AS ord, i, m[i] AS value,
            CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS INT) AS start,
            CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS cp_start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}{extra}, regexp_extract_all({text}, {p}, 0) AS m, regexp_split_to_array({text}, {p}) AS g FROM {table} WHERE regexp_matches({text}, {p})))""")
    return "SELECT *, CAST(start + strlen(value) AS INT) AS \"end\", CAST(cp_start + length(value) AS INT) AS cp_end FROM (" + " UNION ALL ".join(parts) + ")"


LUHN = """(list_sum(list_transform(list_reverse(string_split(translate(value, ' -', ''), '')), lambda c, k: CASE WHEN k % 2 = 0 THEN CASE WHEN 2 * CAST(c AS INT) > 9 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END ELSE CAST(c AS INT) END)) % 10 = 0)"""
ABA = "((" + " + ".join(f"CAST(value[{i + 1}] AS INT) * {w}" for i, w in enumerate((3, 7, 1) * 3)) + ") % 10 = 0)"
IPV4 = "(list_max(list_transform(string_split(value, '.'), lambda p: CAST(p AS INT))) <= 255)"
IBAN = """(strlen(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(replace(value, ' ', '')[5:] || replace(value, ' ', '')[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END), lambda r, d: CASE WHEN d > 9 THEN (r * 100 + d) % 97 ELSE (r * 10 + d) % 97 END, 0) = 1)"""
IPV6 = "((strlen(value) - strlen(replace(value, ':', '')) >= 2 OR contains(value, '.')) AND regexp_matches(value, '[0-9A-Fa-f]'))"
CHECKED = f"CASE kind WHEN 'credit_card' THEN {LUHN} WHEN 'us_bank_routing' THEN {ABA} WHEN 'ipv4' THEN {IPV4} WHEN 'iban' THEN {IBAN} WHEN 'ipv6' THEN {IPV6} ELSE true END"


def entities(table: str, key: str, text: str, extra: str = "") -> str:
    """CTEs up to ``ent``: the entities that checksums and overlaps leave."""
    names = key + extra
    return f"""WITH RECURSIVE cand AS MATERIALIZED ({candidates(table, key, text, extra)}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY "end" - start DESC, ord, start) AS r FROM cand WHERE {CHECKED}),
greedy AS (SELECT {key}, r, [{{'s': start, 'e': "end", 'r': r}}] AS kept FROM ranked WHERE r = 1
    UNION ALL SELECT n.{key}, n.r, CASE WHEN len(list_filter(g.kept, lambda k: n.start < k.e AND k.s < n."end")) > 0 THEN g.kept ELSE list_append(g.kept, {{'s': n.start, 'e': n."end", 'r': n.r}}) END
    FROM greedy g JOIN ranked n ON n.{key} = g.{key} AND n.r = g.r + 1),
final AS (SELECT {key}, unnest(list_transform(max_by(kept, r), lambda k: k.r)) AS r FROM greedy GROUP BY {key}),
ent AS MATERIALIZED (SELECT ranked.* FROM ranked JOIN final USING ({key}, r))"""


SECRET = "(" + " OR ".join(f"kind LIKE '%{p}%'" for p in SECRET_PARTS) + f" OR kind IN ({', '.join(map(q, SECRET_KINDS))}))"
_DOMAIN = "lower(rtrim(regexp_extract(value, '@([^@]*)$', 1), '.'))"
LABEL = f"""CASE WHEN {SECRET} THEN NULL WHEN contains(value, '@') THEN CASE WHEN {_DOMAIN} IN ({', '.join(map(q, (*TEST_DOMAINS, 'localhost')))}) OR {' OR '.join(f"({_DOMAIN} LIKE '_%{s}')" for s in TEST_SUFFIXES)} THEN 'test'
    WHEN lower(regexp_replace(value, '@[^@]*$', '')) IN ({', '.join(map(q, ROLES))}) THEN 'business' ELSE 'personal' END WHEN kind IN ('email', 'phone', 'iban') THEN 'personal' END"""


def default_action(reason: bool = False, label: str = "NULL::VARCHAR") -> str:
    """CASE over columns kind, recipient, data_category, jurisdiction."""
    pick = lambda a, r: q(r if reason else a)
    return f"""CASE WHEN {SECRET} THEN {pick('redact', 'secret_kind')} WHEN {label} = 'secret' THEN {pick('redact', 'judge_secret')}
    WHEN data_category = 'special_category' AND recipient IN ('external', 'unknown') THEN {pick('block', 'special_category_blocked')}
    WHEN data_category = 'special_category' AND recipient = 'trusted' AND NOT coalesce(regexp_full_match(jurisdiction, '[A-Za-z]{{2}}'), false) THEN {pick('block', 'jurisdiction_required_blocked')}
    WHEN recipient = 'unknown' AND data_category <> 'non_personal' THEN {pick('block', 'unknown_recipient_blocked')}
    WHEN {label} IN ('test', 'business') THEN {pick('keep', 'judge_keep')} WHEN recipient = 'local' THEN {pick('keep', 'local_recipient_keep')} ELSE {pick('pseudonymize', 'default_pseudonymize')} END"""


MASKED = "CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE repeat('*', length(value) - 4) || right(value, 4) END"
GENERAL = f"'{PREFIX}' || upper(kind) || '__'"


def sanitized(table: str, key: str, text: str, pseudonym: str, join: str = "") -> str:
    """CTEs up to ``done`` (key, status, clean_text) for external recipients of personal data: secrets are redacted, the rest replaced."""
    return entities(table, key, text, ", source" if join else "") + f""",
rep AS (SELECT ent.*, CASE WHEN {SECRET.replace('kind', 'ent.kind')} THEN '{REDACTED}' ELSE {pseudonym} END AS new, coalesce(lag(cp_end) OVER (PARTITION BY ent.{key} ORDER BY ent.start), 0) AS before FROM ent {join}),
built AS (SELECT d.{key}, any_value(d.{text}) AS old, string_agg(substr(d.{text}, before + 1, cp_start - before) || new, '' ORDER BY start) || substr(any_value(d.{text}), max(cp_end) + 1) AS new, list(value) AS gone FROM rep JOIN {table} d ON d.{key} = rep.{key} GROUP BY d.{key}),
done AS (SELECT d.{key}, CASE WHEN len(list_filter(coalesce(b.gone, []), lambda v: contains(b.new, v))) > 0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN len(list_filter(coalesce(b.gone, []), lambda v: contains(b.new, v))) > 0 THEN NULL ELSE coalesce(b.new, d.{text}) END AS clean_text FROM {table} d LEFT JOIN built b ON b.{key} = d.{key})"""
