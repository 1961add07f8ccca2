"""What SQL can say of operators whose whole result it can't: the columns that fixed rules decide, taken from the operators' own results, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, pii, secret_scan, url_filter


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: the digest of the decoded bytes, which is that of the text's."""
    return bpe.op3_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256", (F.col("n_tokens") > 0).alias("has_tokens"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: host, path, rule, and the verdict where a rule gives it."""
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return url_filter.op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruled"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6: number and digest of the base spans."""
    return secret_scan.op6_secrets(spark, sf_dir).drop("spans")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: number and digest of the base spans."""
    return pii.op9_pii(spark, sf_dir).drop("spans")


def any_case(words: str) -> str:
    """The pattern for words in either case of a to z alone, whatever else an engine folds."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


ASSIGN = any_case("(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
DIGITS = "regexp_replace(piece, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({DIGITS})[k] AS INT) ELSE CAST(reverse({DIGITS})[k] AS INT) * 2 - CASE WHEN reverse({DIGITS})[k] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
OCTETS = "list_bool_and(list_transform(string_split(piece, '.'), lambda x: length(ltrim(x, '0')) < 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255'))"
#: name, pattern, what a match must hold
SECRET_KINDS = (("assign", ASSIGN, f"length(regexp_extract(piece, '{ASSIGN}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(piece) >= 20"), ("hex", "[0-9a-f]+", "length(piece) >= 24"))
PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", OCTETS),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN {LUHN} ELSE false END"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15"),
)


def spans_sql(kinds: tuple, order: str) -> str:
    """SQL for doc_id, n_<kind> and base_sha256: matches are put between marks, so every other piece between marks is one, and running lengths give positions."""
    pieces = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS v FROM d" for k, (_, pattern, _) in enumerate(kinds))
    keep = " OR ".join(f"kind = {k} AND {test}" for k, (_, _, test) in enumerate(kinds))
    names = ", ".join(f"'{name}'" for name, _, _ in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, (name, _, _) in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
p AS (SELECT doc_id, kind, unnest(v) AS piece, generate_subscripts(v, 1) AS i FROM ({pieces})),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS till FROM p),
m AS (SELECT doc_id, kind, CAST(till - length(piece) AS BIGINT) AS since, CAST(till AS BIGINT) AS till FROM (SELECT * FROM e WHERE i % 2 = 0) WHERE {keep}),
s AS (SELECT doc_id, {counts}, string_agg(concat([{names}][kind + 1], ':', since, ':', till), ',' ORDER BY {order}) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in kinds)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def url_sql(rules: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules)
    return rf"""
WITH r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM (VALUES {values}) AS t(verdict, rule)),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path
"""


QUERIES = {"bpe_round_trip": bpe_round_trip, "url_rules": url_rules, "secret_base": secret_base, "pii_base": pii_base}
ORACLE_SQL = {
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, coalesce(text, '') <> '' AS has_tokens FROM documents",
    "url_rules": url_sql(url_filter.RULES),
    "secret_base": spans_sql(SECRET_KINDS, "since, kind"),
    "pii_base": spans_sql(PII_KINDS, "kind, since"),
}
