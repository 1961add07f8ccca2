"""Registered queries on the provided tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import documents, text, values
from tessella.operators import metric_index, pages, reconcile, retrieval, review, substring, vector
from tessella.session import shared_path, stored
from tessella.sources import tables
from tessella.sources.tables import table
from tessella.sources.versioned import Keyed
from tessella.streaming import frames, inbox, machine, progress

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB's strip_accents as a name key; the sharp s and a few letters without a decomposition stay out of both.
KEY = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- projections and filters


@query("SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(regexp_replace(c_name, '[^0-9]', '', 'g'), '42') AND o_orderstatus = 'F'")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    customers = review.search_results(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "c_name", "no. 42")
    orders = review.search_results(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", "o_orderstatus", wanted="F")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_size >= 10 AND p_size <= 20")
def text_and_range_filter(spark, d):
    return table(spark, d, "part").filter(review.text_filter("p_name", "RING") & review.range_filter("p_size", 10, 20)).select("p_partkey", "p_name")


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE CAST(o_orderkey AS VARCHAR) END AS identifier, CASE WHEN o_orderkey % 3 = 0 THEN 'no name' ELSE o_orderpriority END AS name,
CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 7 END AS missing, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS extra, o_orderkey % 4 <> 0 AS done FROM orders""")
def result_rows(spark, d):
    k = F.col("o_orderkey")
    result = F.when(k % 4 != 0, F.struct((k % 7).alias("missing"), F.when(k % 2 != 0, F.lit(1).cast("long")).alias("extra")))
    rows = table(spark, d, "orders").select(F.when(k % 5 != 0, k.cast("string")).alias("id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("who"), result.alias("r"))
    return review.result_row(rows, "id", "who", "r").select("identifier", "name", "result.counts.missing", "result.counts.extra", "result.done")


# --- text


@query("SELECT doc_id, md5(trim(upper(replace(strip_accents(text), 'ß', 'ss')))) AS digest FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_upper(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({KEY.format('text')}) AS digest FROM documents")
def normalize_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT c_custkey, 'x CE/' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') || ' y ' || lpad(CAST(c_custkey * 7 AS VARCHAR), 11, '0') AS t FROM customer)
SELECT c_custkey, regexp_extract(t, '[A-Z]{2}/([0-9]{11})', 1) AS first_id, CASE WHEN c_custkey = 0 THEN '' ELSE lpad(CAST(c_custkey * 7 AS VARCHAR), 11, '0') END AS other_ids FROM t""")
def extract_ids(spark, d):
    key = lambda c: F.lpad(c.cast("string"), 11, "0")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("x CE/"), key(F.col("c_custkey")), F.lit(" y "), key(F.col("c_custkey") * 7)).alias("t"))
    first = text.first_identifier(F.col("t"))
    return rows.select("c_custkey", first.alias("first_id"), F.array_join(text.all_identifiers(F.col("t"), first), ",").alias("other_ids"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'), ',') AS emails, array_to_string(regexp_extract_all(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+'), ',') AS ips FROM documents")
def extract_emails_ips(spark, d):
    every = lambda p: F.array_join(F.regexp_extract_all("text", F.lit(p), 0), ",")
    return table(spark, d, "documents").select("doc_id", every(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("emails"), every(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").alias("ips"))


@query("""WITH t AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS t FROM customer)
SELECT c_custkey, regexp_replace(t, '([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})', '\\1.\\2.\\3-\\4') AS shown, left(t, 3) || '***' AS masked FROM t""")
def format_mask_id(spark, d):
    t = F.lpad(F.col("c_custkey").cast("string"), 11, "0")
    return table(spark, d, "customer").select("c_custkey", text.format_identifier(t).alias("shown"), text.mask_identifier(t).alias("masked"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, md5(regexp_extract(html, '(?s)<article>.*')) AS section FROM pages")
def page_title_section(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.md5(F.regexp_extract("html", "(?s)<article>.*", 0).cast("binary")).alias("section"))


@query("SELECT c_custkey, c_name AS name, 'A ' || c_mktsegment || ',GLICEMIA' AS items FROM customer")
def guide_pages(spark, d):
    page = F.concat(
        F.lit("Nome / Name: "), "c_name", F.lit("\tIdentidade / ID Number: 1\n4. Exames / Exams:\n4.1 Realizados / Performed:\nA "), "c_mktsegment",
        F.lit(" * / X *\tGLICEMIA * / GLUCOSE *\nObrigatório * / Mandatory *\n5. Observações / Notice:\nRealizar higienização / Clean\n"),
    )
    rows = table(spark, d, "customer").select("c_custkey", page.alias("page"))
    return rows.select("c_custkey", text.person_name(F.col("page")).alias("name"), F.array_join(text.item_names(F.col("page")), ",").alias("items"))


@query("SELECT p_partkey, upper(p_name) || ',' || upper(p_type) AS items FROM part")
def heading_items(spark, d):
    markdown = F.concat(F.lit("## "), "p_name", F.lit("\ntext\n"), "p_type", F.lit(" - 01/02/2025\n## "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.heading_items(markdown), ",").alias("items"))


@query("""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, md5(line) AS line FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM a)""")
def chunk_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.nonblank_lines(F.col("text"))).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("line"))


# --- vectors

_KNN = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, label, pow(list_distance(qe, embedding::DOUBLE[]), 2) AS x FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), vec_id) AS rank FROM d)"""


def _knn(spark, d):
    e = table(spark, d, "embeddings")
    return vector.nearest(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 64)


@query(f"{_KNN} SELECT query_id, vec_id, round(x, 6) AS dist2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_top5(spark, d):
    return _knn(spark, d).select("query_id", "vec_id", F.round("dist2", 6).alias("dist2"), "rank")


@query(f"{_KNN} SELECT query_id, vec_id, round(x, 6) AS dist2, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_indexed(spark, d):
    """As knn_top5, by an index on disk whose parts are left out where the triangle inequality allows."""
    e, path = table(spark, d, "embeddings"), shared_path(spark, "index")
    metric_index.build(e.select("vec_id", "embedding"), path, 64, 32)
    found = metric_index.search(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), path, 64)
    return found.select("query_id", "vec_id", F.round("dist2", 6).alias("dist2"), "rank")


@query(f"{_KNN} SELECT query_id, vec_id, label FROM r WHERE rank <= 5 AND x < 1.35")
def knn_threshold(spark, d):
    return vector.with_metadata(vector.within(_knn(spark, d), 1.35), table(spark, d, "embeddings").select("vec_id", "label")).select("query_id", "vec_id", "label")


@query(f"{_KNN} SELECT query_id, string_agg(DISTINCT s, ', ' ORDER BY s) AS expanded FROM (SELECT query_id, 'label ' || label AS s FROM r WHERE rank <= 5 UNION ALL SELECT query_id, 'query ' || query_id FROM q) GROUP BY query_id")
def synonym_expand(spark, d):
    e = table(spark, d, "embeddings")
    names = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("query "), "vec_id").alias("name"))
    return vector.expand(names, _knn(spark, d), e.select("vec_id", F.concat(F.lit("label "), "label").alias("synonym")))


@query("SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS least_dimension, CAST(max(len(embedding)) AS INTEGER) AS most_dimension FROM embeddings")
def inspect_index(spark, d):
    return vector.describe_index(table(spark, d, "embeddings"))


# --- reconciliation: parts of odd lines of an order are required, those of even lines received

_ALIASES = {"ring": ["small ring", "red ring"], "round": ["red ring", "blue anvil", "small widget"], "tools": ["blue anvil", "red widget"]}
_ALIAS_ROWS = ", ".join(f"({g}, {m}, '{n}')" for g, (k, a) in enumerate(_ALIASES.items()) for m, n in enumerate([k, *a]))
_RULES = [("ECONOMY", "STANDARD"), ("ECONOMY", "PROMO"), ("SMALL", "LARGE")]
_RULE_ROWS = ", ".join(f"('{g}', '{s}')" for g, s in _RULES)


def _lines(spark, d, column: str):
    """Required and received (doc_id, pos, name) of orders."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, d, "part").select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min(column).alias("name"))
    return rows.filter("pos % 2 = 1"), rows.filter("pos % 2 = 0")


_LINES = "l AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min({0}) AS name, lower(min({0})) AS key FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), rq AS (SELECT * FROM l WHERE pos % 2 = 1), rc AS (SELECT * FROM l WHERE pos % 2 = 0)"
_FULL = f"WITH {_LINES.format('p_type')}, f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'faltante' WHEN a.key IS NULL THEN 'extra_no_ocr' ELSE 'encontrado' END AS status FROM (SELECT DISTINCT doc_id, key FROM rq) a FULL OUTER JOIN (SELECT DISTINCT doc_id, key FROM rc) b ON a.doc_id = b.doc_id AND a.key = b.key)"


@query(f"{_FULL} SELECT doc_id, key, status FROM f")
def reconcile_status(spark, d):
    return reconcile.full_outer(*_lines(spark, d, "p_type"))


@query(f"""{_FULL}, v AS (SELECT doc_id, count(*) FILTER (status = 'encontrado') AS found, count(*) FILTER (status = 'faltante') AS missing, count(*) FILTER (status = 'extra_no_ocr') AS extra FROM f GROUP BY doc_id)
SELECT o_orderkey AS doc_id, coalesce(found, 0) + coalesce(missing, 0) AS required, coalesce(found, 0) AS found, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(missing, 0) = 0 AS released,
CASE WHEN coalesce(found + missing, 0) > 0 THEN found * 100.0::DOUBLE / (found + missing) END AS percent FROM orders LEFT JOIN v ON o_orderkey = doc_id""")
def verdict_per_doc(spark, d):
    """Orders without lines stay: nothing required, so released."""
    return reconcile.verdicts(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), reconcile.full_outer(*_lines(spark, d, "p_type")))


@query(f"""WITH {_LINES.format('p_name')}, g(group_ord, member_ord, name) AS (VALUES {_ALIAS_ROWS}),
m AS (SELECT a.doc_id, a.pos, a.name, b.pos AS match_pos, b.name AS match, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY ga.group_ord, b.pos) AS n
FROM rq a JOIN g ga ON a.key = ga.name JOIN g gb ON ga.group_ord = gb.group_ord JOIN rc b ON b.doc_id = a.doc_id AND b.key = gb.name)
SELECT doc_id, pos, name, match_pos, match FROM m WHERE n = 1""")
def alias_match(spark, d):
    required, received = map(reconcile.keyed, _lines(spark, d, "p_name"))
    return reconcile.alias_match(required, received, reconcile.alias_table(spark, _ALIASES)).drop("key")


@query(f"""WITH {_LINES.format('p_name')}, t AS (SELECT doc_id, pos, string_split(name, ' ')[2] AS name FROM rq)
SELECT t.doc_id, t.pos, t.name, min(rc.pos) AS match_pos, arg_min(rc.name, rc.pos) AS match FROM t JOIN rc ON t.doc_id = rc.doc_id AND (contains(rc.key, t.name) OR contains(t.name, rc.key)) GROUP BY 1, 2, 3""")
def containment_join(spark, d):
    required, received = _lines(spark, d, "p_name")
    required = required.withColumn("name", F.split("name", " ").getItem(1))
    return reconcile.containment_match(reconcile.keyed(required), reconcile.keyed(received)).drop("key")


_WORDS = "SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark UNION SELECT lower(p_name) FROM part UNION SELECT unnest(string_split(lower(p_name), ' ')) FROM part"


@query(f"SELECT doc_id, count(*) AS n_names, md5(string_agg(name, ' ' ORDER BY name)) AS names FROM documents JOIN ({_WORDS}) n ON name <> '' AND contains(lower(text), name) GROUP BY doc_id")
def catalogue_names(spark, d):
    """The names of a catalogue (words of benchmark texts, names of parts and their words) that stand anywhere in each document's text."""
    parts = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    words = lambda df, c: df.select(F.explode(F.split(F.lower(c), " ")).alias("name"))
    names = stored(words(table(spark, d, "benchmark"), "text").union(parts).union(words(parts, "name")).filter("name <> ''").distinct(), "catalogue")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    found = substring.names_of(texts, names).select(F.col("text_id").alias("doc_id"), F.sort_array("names").alias("a"))
    return found.select("doc_id", F.size("a").cast("long").alias("n_names"), F.md5(F.array_join("a", " ").cast("binary")).alias("names"))


@query(f"""WITH {_LINES.format('p_type')}, u(general, specific) AS (VALUES {_RULE_ROWS}), n AS (SELECT lower(general) AS general, count(*) AS parts FROM u GROUP BY 1),
h AS (SELECT doc_id, lower(general) AS general, count(DISTINCT specific) AS found FROM rc JOIN u ON rc.key = lower(specific) GROUP BY 1, 2)
SELECT rq.doc_id, rq.pos FROM rq JOIN h ON rq.doc_id = h.doc_id AND rq.key = h.general JOIN n ON n.general = h.general WHERE found = parts""")
def coverage_rule(spark, d):
    required, received = map(reconcile.keyed, _lines(spark, d, "p_type"))
    return reconcile.covered(required, received, reconcile.rule_table(spark, _RULES))


def _compare_sql(lines: str, aliases: str, rules: str) -> str:
    key = lambda c: KEY.format(c)
    return f"""WITH {lines}, g AS (SELECT DISTINCT group_ord, {key('name')} AS name FROM (VALUES {aliases}) v(group_ord, member_ord, name)),
u AS (SELECT DISTINCT {key('general')} AS general, {key('specific')} AS specific FROM (VALUES {rules}) v(general, specific)),
eq AS (SELECT rq.doc_id, rq.pos, rq.name, arg_min(rc.name, rc.pos) AS match FROM rq JOIN rc ON rq.doc_id = rc.doc_id AND rq.key = rc.key GROUP BY 1, 2, 3),
r1 AS (SELECT * FROM rq WHERE (doc_id, pos) NOT IN (SELECT doc_id, pos FROM eq)),
al AS (SELECT doc_id, pos, name, match FROM (SELECT a.doc_id, a.pos, a.name, b.name AS match, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY ga.group_ord, b.pos) AS n
  FROM r1 a JOIN g ga ON a.key = ga.name JOIN g gb ON ga.group_ord = gb.group_ord JOIN rc b ON b.doc_id = a.doc_id AND b.key = gb.name) WHERE n = 1),
r2 AS (SELECT * FROM r1 WHERE (doc_id, pos) NOT IN (SELECT doc_id, pos FROM al)),
co AS (SELECT r2.doc_id, r2.pos, r2.name, arg_min(rc.name, rc.pos) AS match FROM r2 JOIN rc ON r2.doc_id = rc.doc_id AND (contains(rc.key, r2.key) OR contains(r2.key, rc.key)) GROUP BY 1, 2, 3),
r3 AS (SELECT * FROM r2 WHERE (doc_id, pos) NOT IN (SELECT doc_id, pos FROM co)),
n AS (SELECT general, count(*) AS parts FROM u GROUP BY 1),
h AS (SELECT doc_id, u.general, count(DISTINCT specific) AS found FROM rc JOIN u ON rc.key = specific GROUP BY 1, 2),
cv AS (SELECT r3.doc_id, r3.pos, r3.name, r3.key FROM r3 JOIN h ON r3.doc_id = h.doc_id AND r3.key = h.general JOIN n ON n.general = h.general WHERE found = parts),
m AS (SELECT *, 'equal' AS rule FROM eq UNION ALL SELECT *, 'alias' FROM al UNION ALL SELECT *, 'containment' FROM co),
used AS (SELECT doc_id, {key('match')} AS key FROM m UNION SELECT doc_id, specific FROM cv JOIN u ON u.general = cv.key),
ex AS (SELECT doc_id, min(pos) AS pos, arg_min(name, pos) AS name FROM rc WHERE (doc_id, key) NOT IN (SELECT doc_id, key FROM used) GROUP BY doc_id, key)
SELECT doc_id, 'required' AS side, pos, name, 'encontrado' AS status, rule, match FROM m
UNION ALL SELECT doc_id, 'required', pos, name, 'encontrado', 'coverage', NULL FROM cv
UNION ALL SELECT doc_id, 'required', pos, name, 'faltante', NULL, NULL FROM r3 WHERE (doc_id, pos) NOT IN (SELECT doc_id, pos FROM cv)
UNION ALL SELECT doc_id, 'received', pos, name, 'extra_no_ocr', NULL, NULL FROM ex"""


@query(_compare_sql(_LINES.format("p_name"), _ALIAS_ROWS, _RULE_ROWS))
def compare_items(spark, d):
    """All rules in order over part names, which have no coverage rule."""
    return reconcile.compare(*_lines(spark, d, "p_name"), reconcile.alias_table(spark, _ALIASES), reconcile.rule_table(spark, _RULES))


_EXAMS = ("Hemograma", "HC", "Glicemia de Jejum", "GLICEMIA", "Perfil Lipídico", "HDL", "Avaliação Renal", "Creatinina", "Uréia", "TSH", "T4L", "E.A.S.", "Audiometria", "Audiometria Tonal")
_EXAM_RULES = [("avaliacao renal", "creatinina"), ("avaliacao renal", "ureia"), ("perfil tireoidiano", "tsh")]
_EXAM = f"{list(_EXAMS)}[(l_partkey + 5 * l_linenumber) % 14 + 1]"
_EXAM_LINES = f"l AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min({_EXAM}) AS name FROM lineitem GROUP BY 1, 2), k AS (SELECT *, {KEY.format('name')} AS key FROM l), rq AS (SELECT * FROM k WHERE pos % 2 = 1), rc AS (SELECT * FROM k WHERE pos % 2 = 0)"
_ALL_ALIASES = ", ".join(f"({g}, {m}, '{n}')" for g, (k, a) in enumerate(reconcile.ALIASES.items()) for m, n in enumerate([k, *a]))


@query(_compare_sql(_EXAM_LINES, _ALL_ALIASES, ", ".join(f"('{g}', '{x}')" for g, x in _EXAM_RULES)))
def compare_exams(spark, d):
    """All rules in order over names of exams, with all alias groups; each rule has matches."""
    exam = F.get(F.array(*map(F.lit, _EXAMS)), ((F.col("l_partkey") + 5 * F.col("l_linenumber")) % 14).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min(exam).alias("name"))
    return reconcile.compare(rows.filter("pos % 2 = 1"), rows.filter("pos % 2 = 0"), reconcile.alias_table(spark), reconcile.rule_table(spark, _EXAM_RULES))


@query("""WITH g AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0)
SELECT o_orderkey, CAST(coalesce(a.c_custkey, b.c_custkey) AS VARCHAR) AS identifier, CASE WHEN a.c_custkey IS NULL THEN b.c_mktsegment ELSE a.c_mktsegment END AS items, CASE WHEN a.c_custkey IS NULL AND b.c_custkey IS NULL THEN 'falha' ELSE 'ok' END AS status
FROM orders LEFT JOIN g a ON a.c_custkey = o_custkey LEFT JOIN g b ON b.c_custkey = o_custkey + 4 AND o_orderkey % 2 = 0""")
def required_lookup(spark, d):
    """The first candidate identifier with a guide; the first is never known."""
    k = F.col("o_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.array(k + 10_000_000, k, F.when(F.col("o_orderkey") % 2 == 0, k + 4)).alias("candidates"))
    guides = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select("c_custkey", "c_mktsegment")
    found = reconcile.required_items(orders, guides, "o_orderkey", "candidates", "c_custkey", "c_mktsegment")
    return found.withColumn("identifier", F.col("identifier").cast("string"))


@query(ORACLE_SQL["required_lookup"])
def required_rounds(spark, d):
    """As required_lookup, candidate by candidate: later ones are asked only for orders without a hit."""
    k = F.col("o_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.array(k + 10_000_000, k, F.when(F.col("o_orderkey") % 2 == 0, k + 4)).alias("candidates"))
    guides = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("identifier"), F.col("c_mktsegment").alias("items"))
    found = reconcile.required_in_rounds(orders, lambda asked: asked.join(guides, "identifier"), "o_orderkey", "candidates")
    return found.withColumn("identifier", F.col("identifier").cast("string"))


# --- joins and sets


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_extras(spark, d):
    return review.without(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT p_partkey, p_name, p_size FROM part p WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_name = p.p_name AND q.p_size = p.p_size)")
def anti_dupes(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return review.without(parts.filter("p_partkey % 2 = 1"), parts.filter("p_partkey % 2 = 0"), ["p_name", "p_size"]).select("p_partkey", "p_name", "p_size")


@query("SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3")
def union_append(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).filter("key <> 3")
    return review.appended(regions, nations)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 20 = 0 THEN 'late' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def keyed_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changes = orders.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 20 == 0, "late").alias("o_orderpriority"))
    return review.updated(orders, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH l AS (SELECT l_orderkey, coalesce(list(DISTINCT p_type) FILTER (l_linenumber % 2 = 1), []) AS a, coalesce(list(DISTINCT p_type) FILTER (l_linenumber % 2 = 0), []) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_sides, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_required,
array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_received, array_to_string(list_sort(list_distinct(a || b)), ',') AS either FROM l""")
def set_operations(spark, d):
    """Required against received types of every order, also of those with one side only."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    side = lambda odd: F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col("p_type")))
    sets = rows.groupBy("l_orderkey").agg(side(1).alias("a"), side(0).alias("b"))
    shown = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select(
        "l_orderkey", shown(F.array_intersect("a", "b")).alias("both_sides"), shown(F.array_except("a", "b")).alias("only_required"), shown(F.array_except("b", "a")).alias("only_received"), shown(F.array_union("a", "b")).alias("either")
    )


# --- aggregates and windows


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n_all, CASE WHEN n_f = 0 THEN n_all || ' documents processed' WHEN n_f = n_all THEN 'all documents failed' ELSE (n_all - n_f) || ' processed, ' || n_f || ' failed' END AS message FROM orders GROUP BY 1")
def status_counts(spark, d):
    out = review.state_counts(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"], ["o_custkey"])
    return out.withColumn("message", review.batch_message(F.col("n_all"), F.col("n_f")))


@query("SELECT user_id, CAST(floor(avg(least(value, 100)) + 0.5) AS BIGINT) AS progress FROM events GROUP BY 1")
def avg_progress_round(spark, d):
    return review.mean_progress(table(spark, d, "events").select("user_id", "event_id", F.least("value", F.lit(100.0)).alias("p")), "p", ["user_id"], "event_id")


@query("SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'P')) AS all_complete, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS n_done, count(*) AS n_all FROM orders GROUP BY 1")
def all_complete(spark, d):
    return review.all_complete(table(spark, d, "orders"), F.col("o_orderstatus").isin("F", "P"), ["o_custkey"])


@query("SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facets(spark, d):
    return review.facets(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


_FILTERED = {"o_orderstatus": "o_orderstatus IN ('F', 'P')", "o_orderpriority": "o_orderpriority <> '1-URGENT'", "o_totalprice": "o_totalprice BETWEEN 50000 AND 200000"}
_FACETS = ["o_orderstatus", "o_orderpriority", "year"]


def _facet_sql(facet: str) -> str:
    rest = " AND ".join(c for k, c in _FILTERED.items() if k != facet)
    return f"SELECT '{facet}' AS facet, CAST({facet} AS VARCHAR) AS value, count(*) AS n FROM (SELECT *, year(o_orderdate) AS year FROM orders) WHERE {rest} GROUP BY 2"


@query(" UNION ALL ".join(map(_facet_sql, _FACETS)))
def filtered_facets(spark, d):
    """Facets under three filters, each without its own; one of the filters is on no facet and one facet has no filter."""
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return review.facets_under(rows, {c: F.expr(e) for c, e in _FILTERED.items()}, _FACETS)


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def facet_range(spark, d):
    return review.value_range(table(spark, d, "orders"), "o_totalprice")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def sorted_distinct(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(text.joined(F.array_sort(F.collect_set("p_type")), "none").alias("types"), F.count_distinct("p_name").alias("n_names"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey) AS INTEGER) AS place FROM orders")
def rank_sort(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "encontrado").when(F.col("o_orderstatus") == "O", "faltante").otherwise("extra_no_ocr")
    return review.ranked(table(spark, d, "orders").withColumn("s", state), "s", "o_orderkey", ["o_custkey"]).select("o_orderkey", "place")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def page_slice(spark, d):
    return review.page_of(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS place, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, place FROM r WHERE place // 10 IN (0, (n - 1) // 20, (n - 1) // 10)""")
def deep_pages(spark, d):
    """The first page, the one in the middle and the last one of all order lines, by an index of pages."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    order = [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    index = pages.build(rows, order, shared_path(spark, "pages"), 32)
    out = index.page(1)
    for page in sorted({(index.rows() - 1) // 20 + 1, index.pages()} - {0, 1}):
        out = out.unionByName(index.page(page))
    return out


@query("SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM orders")
def page_count(spark, d):
    return review.page_count(table(spark, d, "orders"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 100")
def retention(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return review.retained(events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))), "ts", "event_id", F.col("now"), 7).select("event_id")


@query("SELECT CASE WHEN date_trunc('day', ts) = (SELECT date_trunc('day', max(ts)) FROM events) THEN 'today' ELSE 'earlier' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def today_split(spark, d):
    events = table(spark, d, "events").select("ts")
    both = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return both.groupBy(review.day_bucket(F.col("ts"), F.col("now")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_first(spark, d):
    return review.first_of(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def distinct_in_order(spark, d):
    return review.distinct_in_order(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 3")
def last_n_turns(spark, d):
    return retrieval.last_turns(table(spark, d, "conversations"), "conv_id", "turn", 3, ["user", "assistant"]).select("conv_id", "turn", "role")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def first_success(spark, d):
    orders = table(spark, d, "orders").withColumn("ord", F.col("o_orderkey"))
    return review.first_where(orders, ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderkey", "ord")


_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@query(_LATEST)
def latest_state(spark, d):
    return review.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query(_LATEST)
def stream_progress(spark, d):
    """The latest state by a stream over the events, run over all there is and then read."""
    source = table(spark, d, "events")
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parquet*")
    states = progress.latest_states(events, "user_id", "ts", "event_id", ["event_id", "event_type", "value"])
    return progress.run_to_table(states, "latest", "user_id")


_KINDS = {"purchase": "start", "signup": "complete", "error": "fail"}
_KEPT = 43_200.0


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'start' WHEN 'signup' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'update' END AS kind,
  'p' || event_id % 2 AS pid, CAST(event_id % 100 AS INTEGER) AS told, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0 AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, false AS taken, NULL::VARCHAR AS pid, NULL::VARCHAR AS status, NULL::INTEGER AS progress, []::BIGINT[] AS timers FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, seq, kind, ok, CASE WHEN ok AND kind = 'start' THEN new_pid ELSE pid END,
    CASE WHEN NOT ok OR kind = 'update' THEN status WHEN kind = 'start' THEN 'processing' WHEN kind = 'complete' THEN 'completed' ELSE 'error' END,
    CASE WHEN NOT ok OR kind = 'fail' THEN progress WHEN kind = 'start' THEN 0 WHEN kind = 'complete' THEN 100 ELSE told END,
    CASE WHEN ok AND kind IN ('complete', 'fail') THEN list_append(left_over, us + {int(_KEPT)}000000) ELSE left_over END
  FROM (SELECT *, coalesce(kind = 'start' OR new_pid = pid, false) AS ok FROM
    (SELECT s.user_id, c.i, c.seq, c.kind, c.us, c.told, c.pid AS new_pid, list_filter(timers, lambda t: t > c.us) AS left_over, len(list_filter(timers, lambda t: t <= c.us)) > 0 AS fired,
       CASE WHEN fired THEN NULL ELSE s.pid END AS pid, CASE WHEN fired THEN NULL ELSE s.status END AS status, CASE WHEN fired THEN NULL ELSE s.progress END AS progress FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1)))
SELECT user_id, seq, kind, taken, pid AS process_id, status, coalesce(progress, -1) AS progress, CASE WHEN progress = 0 THEN 'upload' WHEN progress < 30 THEN 'ocr' WHEN progress < 60 THEN 'brnet' WHEN progress < 100 THEN 'validation' WHEN progress = 100 THEN 'completed' END AS stage FROM s WHERE i > 0""")
def process_display(spark, d):
    """The process machine as a stream over all events, each a command: what its session shows after it."""
    source = table(spark, d, "events")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")], F.lit("update"))
    commands = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.concat(F.lit("p"), F.col("event_id") % 2).alias("process_id"), (F.col("event_id") % 100).cast("int").alias("progress"),
    )
    rows = progress.run_to_rows(machine.displays(commands, _KEPT), "displays").filter("kind <> 'clear'")
    return rows.select(F.col("session").cast("long").alias("user_id"), "seq", "kind", "taken", "process_id", "status", F.coalesce("progress", F.lit(-1)).alias("progress"), "stage")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) WHERE n <= 20""")
def inbox_stream(spark, d):
    """What each user keeps of seven days, at most twenty, by a stream with a list of entries as state and event-time timers."""
    source = table(spark, d, "events")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    kept = inbox.current(progress.run_to_rows(inbox.changes(events, 7, 20), "inbox"))
    return kept.select(F.col("user").cast("long").alias("user_id"), F.col("seq").alias("event_id"))


_FRAMES = """WITH a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)
SELECT doc_id, CAST(i AS BIGINT) AS position, CAST(i AS BIGINT) AS seq, md5(line) AS message FROM (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM a)"""


def _frame_chunks(spark, d):
    """Each document's lines as events of one connection, its bytes cut into chunks of some hundred, wherever that falls."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" ")) != "")
    event = lambda x, i: F.concat(F.lit("data: "), F.to_json(F.struct(i.alias("seq"), x.alias("message"))), F.lit("\r\n\r\n"))
    rows = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, event), "").alias("body"))
    return frames.cut_in_chunks(rows, "doc_id", "body", F.col("doc_id") % 101 + 500)


def _frame_events(framed: DataFrame) -> DataFrame:
    parsed = F.from_json(F.substr("frame", F.lit(7)), "seq bigint, message string")
    return framed.filter(F.startswith("frame", F.lit("data: "))).select(F.col("connection").cast("long").alias("doc_id"), "position", parsed.alias("e")).select("doc_id", "position", "e.seq", F.md5(F.col("e.message").cast("binary")).alias("message"))


@query(_FRAMES)
def framed_events(spark, d):
    """Events of byte chunks cut anywhere, of a table."""
    return _frame_events(frames.framed(_frame_chunks(spark, d)))


@query(_FRAMES)
def framed_stream(spark, d):
    """The same by a stream of four batches that each have every fourth chunk, so most chunks wait for others. One run goes through all: its state stays where it is between batches."""
    path, state, written = shared_path(spark, "chunks"), shared_path(spark, "frames"), [0]
    every = _frame_chunks(spark, d)
    for k in range(4):
        every.filter(F.col("number") % 4 == 3 - k).write.mode("append").parquet(path)
        written.append(len(spark.read.schema(every.schema).parquet(path).inputFiles()))
    quarter = max(1, *(b - a for a, b in zip(written, written[1:])))
    chunks = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", quarter).parquet(path)
    out = progress.run_to_rows(frames.framed_stream(chunks), "frames", state)
    return _frame_events(out)


@query("""SELECT o_orderkey, CASE WHEN o_orderdate >= '1998-01-01' AND o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 50 = 0 THEN 'approved' ELSE o_orderstatus END AS state,
CASE WHEN o_orderdate >= '1998-01-01' AND o_orderkey % 3 = 0 THEN o_orderpriority END AS reason FROM orders UNION ALL SELECT -o_orderkey, 'new', NULL FROM orders WHERE o_orderkey % 1000 = 1""")
def keyed_upsert(spark, d):
    """Approvals, then rejections with a reason, then new rows change a keyed table in place; the approvals come twice."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.lit(None).cast("string").alias("reason"), "o_orderdate", "o_orderpriority")
    shown = lambda rows, state: rows.select("o_orderkey", F.lit(state).alias("state"), F.lit(None).cast("string").alias("reason"))
    keyed = Keyed(spark, shared_path(spark, "reviews"), orders.select("o_orderkey", "state", "reason").schema, "o_orderkey", 16)
    changed = lambda old, new: review.updated(old, new, "o_orderkey", ["state", "reason"]).unionByName(new.join(old, "o_orderkey", "left_anti"))
    approved = shown(orders.filter("o_orderkey % 50 = 0"), "approved")
    rejected = orders.filter("o_orderdate >= '1998-01-01' AND o_orderkey % 3 = 0").select("o_orderkey", F.lit("rejected").alias("state"), F.col("o_orderpriority").alias("reason"))
    added = shown(orders.filter("o_orderkey % 1000 = 1").withColumn("o_orderkey", -F.col("o_orderkey")), "new")
    for batch, rows in ((0, orders.select("o_orderkey", "state", "reason")), (1, approved), (2, rejected), (1, approved), (3, added)):
        keyed.change(stored(rows, "changes"), changed, "review", batch)
    return keyed.read()


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_events(spark, d):
    return progress.daily(table(spark, d, "events"), "ts")


# --- values


@query("""SELECT event_id, CASE WHEN p < 0 THEN NULL WHEN p = 0 THEN 'upload' WHEN p < 30 THEN 'ocr' WHEN p < 60 THEN 'brnet' WHEN p < 100 THEN 'validation' ELSE 'completed' END AS stage,
CASE WHEN p < 30 AND p > 0 THEN 2 WHEN p <= 0 THEN 1 WHEN p < 60 THEN 3 WHEN p < 100 THEN 4 ELSE 5 END AS place, CASE WHEN p < 0 THEN 'error' WHEN p >= 100 THEN 'completed' WHEN p > 0 THEN 'processing' ELSE 'pending' END AS state,
CASE WHEN p < 0 THEN 'rejected' WHEN p >= 60 THEN 'approved' ELSE 'pending_review' END AS result, CASE WHEN p < 0 THEN 'Rejeitado' WHEN p >= 60 THEN 'Aprovado' ELSE 'Pendente' END AS label, CASE WHEN p >= 80 THEN 'high' WHEN p >= 50 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN -1 ELSE CAST(floor(least(value, 100)) AS BIGINT) END AS p FROM events)""")
def stage_map(spark, d):
    p = F.when(F.col("event_id") % 29 == 0, -1).otherwise(F.floor(values.clamp(F.col("value"), 0.0, 100.0)))
    rows = table(spark, d, "events").select("event_id", p.alias("p")).withColumns({"stage": values.stage_of(F.col("p")), "result": values.result_state(F.col("p") == -1, F.col("p") >= 60)})
    return rows.select("event_id", "stage", values.stage_position(F.col("stage")).alias("place"), values.document_state(F.col("p") == -1, F.col("p")).alias("state"), "result", values.state_label(F.col("result")).alias("label"), values.share_band(F.col("p")).alias("band"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.nothing') IS NULL AS missing FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", documents.field(F.col("props"), "$.k", "bigint").alias("k"), F.isnotnull(documents.items_or_error(F.col("props"), "nothing")["error"]).alias("missing"))


@query("""WITH t AS (SELECT doc_id, n_chars * n_chars AS n FROM documents), k AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', floor(n / pow(1024, k) * 100 + 0.5) / 100), '0+$', ''), '[.]$', '') || ['Bytes', 'KB', 'MB', 'GB', 'TB'][k + 1] END AS shown, printf('%.2f', floor(n / 1048576 * 100 + 0.5) / 100) || 'MB' AS megabytes FROM k""")
def format_bytes(spark, d):
    n = F.col("n_chars") * F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", values.format_bytes(n).alias("shown"), values.megabytes(n).alias("megabytes"))


_ENDS = ("", ".pdf", ".docx", ".rar", ".XLS", ".xlsx", ".a.b")
_MIMES = ("application/x", "image/png", "video/mp4", "audio/ogg", "application/zip", "application/msword", "excel/x")


@query(f"""WITH p AS (SELECT page_id, url || {list(_ENDS)}[page_id % 7 + 1] AS name, {list(_MIMES)}[page_id // 7 % 7 + 1] AS mime, length(html) AS n FROM pages)
SELECT page_id, CASE WHEN contains(mime, 'word') OR name LIKE '%.pdf' OR name LIKE '%.docx' THEN 'document' WHEN contains(mime, 'zip') OR name LIKE '%.rar' THEN 'archive' WHEN contains(mime, 'excel') OR name LIKE '%.xlsx' THEN 'spreadsheet'
WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'image/%' THEN 'image' ELSE 'other' END AS kind, regexp_extract(name, '[.][^.]*$') AS ending,
n <= 1500 AND (lower(name) LIKE '%.xls' OR mime LIKE 'image/%' OR mime = 'application/zip') AS taken FROM p""")
def file_kind(spark, d):
    one = lambda options, k: F.get(F.array(*map(F.lit, options)), k.cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.concat("url", one(_ENDS, F.col("page_id") % 7)).alias("name"), one(_MIMES, F.floor(F.col("page_id") / 7) % 7).alias("mime"), F.length("html").alias("n"))
    taken = values.accepted(F.col("mime"), F.col("name"), F.col("n"), [".XLS", "image/*", "application/zip"], 1500)
    return rows.select("page_id", values.file_kind(F.col("mime"), F.col("name")).alias("kind"), values.extension(F.col("name")).alias("ending"), taken.alias("taken"))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%d/%m/%Y') AS day, CASE WHEN event_id % 2 = 0 THEN ts END AS revived FROM events")
def date_formats(spark, d):
    return table(spark, d, "events").select("event_id", values.local_minute(F.col("ts")).alias("shown"), values.file_stamp(F.col("ts")).alias("stamp"), values.local_date(F.col("ts")).alias("day"), values.iso_timestamp(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("20 May 2024")).cast("timestamp_ntz").alias("revived"))


# --- retrieval


@query("""SELECT conv_id, string_agg('Pergunta: ' || role || chr(10) || 'Resposta: ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1""")
def build_context(spark, d):
    return retrieval.context_block(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))


@query("""SELECT conv_id, 'system: rules' || chr(10) || CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'system: context ' || conv_id || chr(10) END
|| coalesce(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) FILTER (role IN ('user', 'assistant')), '') || 'user: question' AS messages FROM conversations GROUP BY 1""")
def message_lists(spark, d):
    history = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    turns = F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    context = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("context "), "conv_id"))
    listed = retrieval.message_list("rules", context, turns, F.lit("question"))
    return history.select("conv_id", F.array_join(F.transform(listed, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@query("""WITH a AS (SELECT item_id, ['Q' || item_id] || list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM benchmark)
SELECT item_id, CAST(i AS INTEGER) AS chunk_no, chunk FROM (SELECT item_id, unnest(range(len(a))) AS i, unnest(a) AS chunk FROM a)""")
def faq_chunks(spark, d):
    return retrieval.chunks(table(spark, d, "benchmark").withColumn("q", F.concat(F.lit("Q"), "item_id")), "item_id", "q", "text")


# --- notifications, uploads, small values


@query("SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_id % 3 <> 0")
def unread(spark, d):
    read = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0)
    return review.unread(table(spark, d, "events").select("event_id", read.alias("read"))).select("event_id")


@query("SELECT o_orderkey, 'batch' AS found_by FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey, 'id' FROM orders WHERE o_orderkey = 33")
def rows_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    of = lambda df, how: df.select("o_orderkey", F.lit(how).alias("found_by"))
    return of(review.with_value(orders, "o_custkey", 7), "batch").union(of(review.with_value(orders, "o_orderkey", 33, 1), "id"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE l_linenumber % 2 = 1 AND n <= 4")
def batch_cap(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return review.within_cap(lines.filter("l_linenumber % 2 = 1"), lines.filter("l_linenumber % 2 = 0"), "l_orderkey", 4)


@query("SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AS may_enter FROM customer")
def email_domain(spark, d):
    k = F.col("c_custkey")
    email = F.when(k % 5 != 0, F.concat(F.lit("u"), k, F.when(k % 2 == 0, "@clinic.example").otherwise("@notclinic.example")))
    return table(spark, d, "customer").select("c_custkey", text.has_domain(email, "clinic.example").alias("may_enter"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_type, 'ring')")
def mentions(spark, d):
    return table(spark, d, "part").filter(review.mentions(["p_name", "p_type"], "ring")).select("p_partkey")


@query("SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AS complete, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 3 = 0 THEN 0 ELSE 2 END AS n_items FROM customer WHERE c_custkey % 11 <> 0")
def complete_rows(spark, d):
    k = F.col("c_custkey")
    items = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = table(spark, d, "customer").select("c_custkey", items.alias("items"), F.when(k % 4 == 0, "").otherwise("x").alias("identifier"), F.when(k % 11 != 0, "done").alias("result"))
    return review.succeeded(rows, "result").select("c_custkey", review.complete(rows, ["items", "identifier"]).alias("complete"), values.size_or_zero(F.col("items")).alias("n_items"))


@query("SELECT role, CAST(sum(CASE WHEN turn % 4 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_usage(spark, d):
    rows = table(spark, d, "conversations").select("role", F.when(F.col("turn") % 4 != 0, F.length("text")).alias("usage"))
    return retrieval.token_total(rows, "usage", ["role"])


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_match, max(event_id) AS last_id FROM events GROUP BY 1")
def any_match(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("any_match"), F.max("event_id").alias("last_id"))


@query("SELECT p_partkey, 'Exame: ' || upper(p_name) || '. Similares: ' || upper(p_type) || ', ' || upper(p_brand) AS shown FROM part")
def embedding_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.embedding_text(F.col("p_name"), F.concat_ws(",", "p_type", "p_brand")).alias("shown"))


@query("SELECT event_id, printf('%.4f', value) AS score, left(sha256(user_id || chr(31) || event_id), 16) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events")
def scores_ids_turns(spark, d):
    rows = progress.display_order(table(spark, d, "events"), "user_id", "ts", "event_id")
    return rows.select("event_id", values.score_shown(F.col("value")).alias("score"), values.stable_id(F.col("user_id"), F.col("event_id")).alias("id"), F.col("turn").cast("long").alias("turn"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS a, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(value * 60000000 AS BIGINT) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, i, a AS start, a + d AS "end" FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, greatest(e.a, s."end"), greatest(e.a, s."end") + e.d FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, start, "end" FROM s""")
def display_queue(spark, d):
    """When each user's notifications are shown, one at a time, each for as many minutes as its value says; errors take no time."""
    duration = F.when(F.col("event_type") == "error", 0).otherwise(F.round(F.col("value") * 60_000_000).cast("long"))
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), duration.alias("lasts"))
    return progress.display_times(rows, "user_id", "at", "event_id", "lasts").select("user_id", "event_id", "start", "end")


@query("""WITH t AS (SELECT c_custkey, ['', '-', 'abc', '12.5', '-3', '250', '7x', '.5'][c_custkey % 8 + 1] AS t FROM customer)
SELECT c_custkey, t IN ('', '-', '12.5', '-3', '250', '.5') AS numeric, CASE WHEN t IN ('', '-') THEN 0 WHEN t = 'abc' THEN 42 ELSE least(greatest(least(CASE t WHEN '12.5' THEN 12.5 WHEN '-3' THEN -3 WHEN '250' THEN 250 WHEN '7x' THEN 7 ELSE 0.5 END, 100), 0), 60) END::DOUBLE AS low,
CASE WHEN t IN ('', '-') THEN 0 WHEN t = 'abc' THEN 42 ELSE greatest(least(greatest(CASE t WHEN '12.5' THEN 12.5 WHEN '-3' THEN -3 WHEN '250' THEN 250 WHEN '7x' THEN 7 ELSE 0.5 END, 0), 100), 10) END::DOUBLE AS high FROM t""")
def slider_values(spark, d):
    t = F.get(F.array(*map(F.lit, ("", "-", "abc", "12.5", "-3", "250", "7x", ".5"))), (F.col("c_custkey") % 8).cast("int"))
    entered = lambda **k: values.entered_value(t, F.lit(42.0), 0.0, 100.0, **k)
    return table(spark, d, "customer").select("c_custkey", values.looks_numeric(t).alias("numeric"), entered(at_most=F.lit(60.0)).alias("low"), entered(at_least=F.lit(10.0)).alias("high"))


@query("""SELECT c_custkey, c_custkey % 4 < 2 AS is_table, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS first_name FROM customer""")
def table_messages(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.lit('[{"exame": "'), "c_name", F.lit('", "status": "ok"}]'))
    message = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n``` "))).when(k % 4 == 2, F.lit('[{"other": 1}]')).otherwise("[not json]")
    rows = table(spark, d, "customer").select("c_custkey", text.table_rows(message, "exame", "struct<exame:string,status:string>").alias("rows"))
    return rows.select("c_custkey", F.isnotnull("rows").alias("is_table"), F.get("rows", 0)["exame"].alias("first_name"))


@query("SELECT c_custkey AS seq, CAST(c_custkey % 101 AS INTEGER) AS progress, c_name AS message FROM customer UNION ALL SELECT c_custkey + 1000000, 100, 'end' FROM customer WHERE c_custkey % 3 <> 0")
def event_frames(spark, d):
    """Two events a text: one over several lines, one on one line or broken."""
    k = F.col("c_custkey")
    first = F.concat(F.lit('event: x\ndata: {"seq": '), k, F.lit(',\ndata: "progress": '), k % 101, F.lit(', "message": "'), "c_name", F.lit('"}\r\n\r\n: note\n\n'))
    second = F.when(k % 3 != 0, F.concat(F.lit('data: {"seq": '), k + 1_000_000, F.lit(', "progress": 100, "message": "end"}'))).otherwise(F.lit('data: {"seq": 1,'))
    frames = tables.event_frames(table(spark, d, "customer").select(F.concat(first, second).alias("value")))
    return frames.select("seq", "progress", "message")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id END AS id, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts FROM events")
def saved_values(spark, d):
    """Values saved as JSON, some of them lost or broken."""
    saved = F.when(F.col("event_id") % 8 == 0, F.lit("{broken")).when(F.col("event_id") % 4 != 0, tables.as_json("event_id", "ts"))
    default = F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("timestamp").alias("ts"))
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).select("event_id", tables.loaded(saved, "event_id long, ts timestamp", default).alias("v"))
    return rows.select("event_id", F.col("v.event_id").alias("id"), F.col("v.ts").cast("timestamp_ntz").alias("ts"))


@query("""SELECT conv_id, turn, left(text, 50) AS preview, length(trim(text)) > 3 AS asks, CASE WHEN turn % 2 = 0 THEN '* ' || text ELSE text END AS answer, '- ' || role || chr(10) || '- x' AS bullets, CASE WHEN turn % 3 = 0 THEN role ELSE text END AS first_text FROM conversations""")
def small_texts(spark, d):
    turn, body = F.col("turn"), F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", text.preview(body).alias("preview"), retrieval.worth_asking(body).alias("asks"), retrieval.marked_answer(body, turn % 2 == 0).alias("answer"), text.bullet_lines(F.array(F.col("role"), F.lit("x"))).alias("bullets"),
        text.first_nonempty(F.when(turn % 3 == 0, "").otherwise(body), F.col("role")).alias("first_text"),
    )


@query("SELECT 'tags' AS facet, t AS value, count(*) AS n FROM (SELECT unnest([event_type, 'u' || user_id % 3]) AS t FROM events) GROUP BY 2")
def array_facets(spark, d):
    rows = table(spark, d, "events").select(F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 3)).alias("tags"))
    return review.facets(rows, ["tags"])


@query("""WITH e AS (SELECT user_id AS process_id, event_id AS seq, CASE WHEN event_id % 47 = 0 THEN -1 ELSE CAST(event_id % 103 AS INTEGER) END AS p FROM events),
t AS (SELECT process_id, min(seq) FILTER (p = -1 OR p >= 100) AS last, count(*) AS n_events FROM e GROUP BY 1),
r AS (SELECT e.process_id, greatest(max(p), 0) AS progress, arg_max(p, seq) AS p, max(n_events) AS n_events FROM e JOIN t ON e.process_id = t.process_id WHERE last IS NULL OR seq <= last GROUP BY 1)
SELECT process_id, CASE WHEN p = -1 THEN 'error' WHEN p >= 100 THEN 'completed' ELSE 'processing' END AS status, progress, CASE WHEN progress = 0 THEN 'upload' WHEN progress < 30 THEN 'ocr' WHEN progress < 60 THEN 'brnet' WHEN progress < 100 THEN 'validation' ELSE 'completed' END AS stage, n_events FROM r""")
def process_states(spark, d):
    told = F.when(F.col("event_id") % 47 == 0, -1).otherwise(F.col("event_id") % 103).cast("int")
    return progress.process_states(table(spark, d, "events").select(F.col("user_id").alias("process_id"), F.col("event_id").alias("seq"), told.alias("progress")))
