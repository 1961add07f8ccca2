"""Required against received items, and the verdict for each document.

A required item is matched by the first rule that holds: equal keys; a common alias group (lowest group, then
earliest received item); one key inside the other (earliest received item, both keys non-empty); a coverage rule
whose specific items were all received. Each rule only sees what the ones before left, so the costly containment
join gets few rows. A received item may serve several required ones. Extras are received items that serve none, one
for each key, the first in order. Joins are on the document and a key; containment compares all keys
of a document only where they are few, and goes by signatures (``substring``) elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import normalize_key
from tessella.functions.values import share_percent
from tessella.operators import substring
from tessella.session import stored

#: Names that mean the same, each with its other names (fixed values; a name can stand in several groups).
ALIASES = {
    "hemograma completo com plaquetas": ["hemograma completo", "exame de sangue", "hemograma", "hc", "hemograma c/ plaquetas"],
    "hemograma completo": ["hemograma completo com plaquetas", "exame de sangue", "hemograma", "hc"],
    "exame de sangue": ["hemograma completo com plaquetas", "hemograma completo", "hemograma", "hc"],
    "glicemia de jejum": ["glicemia", "glicemia em jejum", "glicose de jejum"],
    "glicemia": ["glicemia de jejum", "glicose", "teste de glicose"],
    "colesterol total": ["colesterol total e fracoes", "perfil lipidico", "lipidograma"],
    "colesterol total e fracoes": ["colesterol total", "perfil lipidico", "lipidograma"],
    "perfil lipidico": ["colesterol total", "colesterol total e fracoes", "lipidograma", "hdl", "ldl", "triglicerideos"],
    "triglicerideos": ["perfil lipidico", "lipidograma"],
    "tsh": ["hormonio estimulante da tireoide", "exame de tireoide", "tsh basal", "tsh ultra sensível"],
    "t4 livre": ["tiroxina livre", "exame de tireoide", "t4l"],
    "funcao tireoidiana": ["tsh", "t4 livre", "painel tireoidiano"],
    "acido urico": ["uricemia", "exame de acido urico"],
    "creatinina": ["creatinina serica", "exame de creatinina"],
    "ureia": ["ureia serica", "exame de ureia"],
    "exame de urina tipo i": ["eas", "urina tipo 1", "urina rotina", "sumario de urina"],
    "eas": ["exame de urina tipo i", "urina tipo 1", "urina rotina", "sumario de urina"],
    "papanicolau": ["citologia oncologica", "preventivo", "exame preventivo"],
    "citologia oncologica": ["papanicolau", "preventivo", "exame preventivo"],
    "psa": ["antigeno prostatico especifico", "psa total"],
    "antigeno prostatico especifico": ["psa", "psa total"],
    "radiografia de torax": ["raio x de torax", "rx de torax", "radiografia toracica"],
    "raio x de torax": ["radiografia de torax", "rx de torax", "radiografia toracica"],
    "ecografia abdominal": ["ultrassom abdominal", "usg abdominal", "ultrassonografia abdominal"],
    "ultrassom abdominal": ["ecografia abdominal", "usg abdominal", "ultrassonografia abdominal"],
    "ressonancia magnetica do joelho": ["rm joelho", "ressonancia joelho", "rm de joelho"],
    "clinico ocupacional": ["consulta clinica ocupacional", "exame ocupacional", "medicina ocupacional"],
    "consulta clinica ocupacional": ["clinico ocupacional", "exame ocupacional", "medicina ocupacional"],
}


#: Pairs of keys up to which a document's containment is found by comparing all.
FEW_PAIRS = 4096


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(group_ord, member_ord, name); member 0 is the group's own name."""
    groups = (ALIASES if aliases is None else aliases).items()
    rows = [(g, m, name) for g, (own, others) in enumerate(groups) for m, name in enumerate([own, *others])]
    return inline_table(spark, rows, ("group_ord", "member_ord", "name"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(general, specific) of coverage rules."""
    return inline_table(spark, rules, ("general", "specific"))


def inline_table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A small fixed table that is part of the plan."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.inline(cells))


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(group_ord, key), distinct; a few rows for each group."""
    return aliases.select("group_ord", normalize_key(F.col("name")).alias("key")).filter("key <> ''").distinct()


def keyed(items: DataFrame, doc: str = "doc_id", pos: str = "pos", name: str = "name") -> DataFrame:
    return items.select(F.col(doc).alias("doc_id"), F.col(pos).alias("pos"), F.col(name).alias("name"), normalize_key(F.col(name)).alias("key"))


def alias_match(required: DataFrame, received: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, pos, name, key, match_pos, match) of keyed items; the first by (group, received position)."""
    groups = alias_keys(aliases)
    left = required.join(groups, "key")
    right = received.select("doc_id", F.col("pos").alias("match_pos"), F.col("name").alias("match"), "key").join(groups, "key").drop("key")
    first = Window.partitionBy("doc_id", "pos").orderBy("group_ord", "match_pos")
    return left.join(right, ["doc_id", "group_ord"]).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "group_ord")


def containment_match(required: DataFrame, received: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """As alias_match: one key inside the other, both non-empty, earliest received item.

    Keys of a document count once on each side. A document with up to ``few`` pairs of keys compares them; a larger one finds
    its pairs by signatures, so its rows are those that match and not the product of its sides.
    """
    earliest = F.min(F.struct(F.col("pos").alias("match_pos"), F.col("name").alias("match"))).alias("m")
    right = received.filter("key <> ''").groupBy("doc_id", F.col("key").alias("other")).agg(earliest)
    left = required.filter("key <> ''").select("doc_id", "key").distinct()
    size = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    large = stored(size(left, "a").join(size(right, "b"), "doc_id").filter(F.col("a") * F.col("b") > few).select("doc_id"), "large")
    inside = F.contains("key", F.col("other")) | F.contains(F.col("other"), F.col("key"))
    pairs = left.join(large, "doc_id", "left_anti").join(right.drop("m"), "doc_id").filter(inside)
    if not large.isEmpty():
        keys, others = stored(left.join(large, "doc_id", "left_semi"), "keys"), stored(right.join(large, "doc_id", "left_semi").drop("m"), "others")
        within = lambda outer, o, inner, i: substring.inside(outer.select("doc_id", F.col(o).alias("text_id"), F.col(o).alias("text")), inner.select("doc_id", F.col(i).alias("name")), ["doc_id"]).withColumnsRenamed({"text_id": o, "name": i})
        pairs = pairs.unionByName(within(keys, "key", others, "other")).unionByName(within(others, "other", keys, "key"))
    best = pairs.join(right, ["doc_id", "other"]).groupBy("doc_id", "key").agg(F.min("m").alias("m"))
    return required.join(best, ["doc_id", "key"]).select("doc_id", "pos", "name", "key", "m.match_pos", "m.match")


def covered(required: DataFrame, received: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, pos) of required items all of whose specific items under rules (general, specific) were received."""
    keys = rules.select(normalize_key(F.col("general")).alias("general"), normalize_key(F.col("specific")).alias("specific")).distinct()
    sizes = keys.groupBy("general").agg(F.count("*").alias("parts"))
    has = received.select("doc_id", F.col("key").alias("specific")).distinct().join(keys, "specific").groupBy("doc_id", "general").agg(F.count("*").alias("found"))
    whole = has.join(sizes, "general").filter("found = parts").select("doc_id", F.col("general").alias("key"))
    return required.join(whole, ["doc_id", "key"], "left_semi").select("doc_id", "pos")


def compare(required: DataFrame, received: DataFrame, aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, side, pos, name, status, rule, match): a row for each required item and each extra; inputs are (doc_id, pos, name)."""
    # read several times below: stored once, with their keys
    required, received = stored(keyed(required), "required"), stored(keyed(received), "received")
    first = Window.partitionBy("doc_id", "key").orderBy("pos")
    unique = received.filter("key <> ''").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    equal = required.join(unique.select("doc_id", "key", F.col("pos").alias("match_pos"), F.col("name").alias("match")), ["doc_id", "key"]).select("doc_id", "pos", "name", "key", "match_pos", "match")
    equal = stored(equal, "equal")
    rest = required.join(equal, ["doc_id", "pos"], "left_anti")
    alias = stored(alias_match(rest, received, aliases).select(*equal.columns), "alias")
    rest = rest.join(alias, ["doc_id", "pos"], "left_anti")
    inside = stored(containment_match(rest, received).select(*equal.columns), "inside")
    rest = rest.join(inside, ["doc_id", "pos"], "left_anti")
    whole = covered(rest, received, rules).withColumn("coverage", F.lit(True))
    tagged = [d.withColumn("rule", F.lit(r)) for d, r in ((equal, "equal"), (alias, "alias"), (inside, "containment"))]
    matched = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    rest = rest.join(whole, ["doc_id", "pos"], "left")
    rest = rest.select("doc_id", "pos", "name", F.when(F.col("coverage"), "coverage").alias("rule"), F.lit(None).cast("string").alias("match"))
    rows = matched.select("doc_id", "pos", "name", "rule", "match").unionByName(rest)
    rows = rows.select("doc_id", F.lit("required").alias("side"), "pos", "name", F.when(F.col("rule").isNull(), "faltante").otherwise("encontrado").alias("status"), "rule", "match")

    parts = rules.select(normalize_key(F.col("general")).alias("general"), normalize_key(F.col("specific")).alias("key"))
    used = matched.select("doc_id", normalize_key(F.col("match")).alias("key"))
    used_parts = rest.filter("rule = 'coverage'").select("doc_id", normalize_key(F.col("name")).alias("general")).join(parts, "general").select("doc_id", "key")
    extra = unique.join(used.union(used_parts).distinct(), ["doc_id", "key"], "left_anti")
    extra = extra.select("doc_id", F.lit("received").alias("side"), "pos", "name", F.lit("extra_no_ocr").alias("status"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("match"))
    return rows.unionByName(extra)


def verdicts(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """For each document: required, found, missing, extra, released and percent found; released if nothing is missing, also where nothing is required."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = rows.groupBy("doc_id").agg(n("encontrado").alias("found"), n("faltante").alias("missing"), n("extra_no_ocr").alias("extra"))
    out = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["found", "missing", "extra"])
    required = F.col("found") + F.col("missing")
    return out.select("doc_id", required.alias("required"), "found", "missing", "extra", (F.col("missing") == 0).alias("released"), share_percent(F.col("found"), required).alias("percent"))


def full_outer(required: DataFrame, received: DataFrame) -> DataFrame:
    """(doc_id, key, status) of the distinct keys of two (doc_id, name) tables."""
    side = lambda df, flag: df.select("doc_id", normalize_key(F.col("name")).alias("key")).filter("key <> ''").distinct().withColumn(flag, F.lit(True))
    both = side(required, "wanted").join(side(received, "given"), ["doc_id", "key"], "full_outer")
    return both.select("doc_id", "key", F.when(F.col("given").isNull(), "faltante").when(F.col("wanted").isNull(), "extra_no_ocr").otherwise("encontrado").alias("status"))


def required_items(documents: DataFrame, guides: DataFrame, by: str, candidates: str, identifier: str, items: str) -> DataFrame:
    """(by, identifier, items, status) for each document: the guide of the first of its candidate identifiers, in order, that has one; status "falha" where none has."""
    tried = documents.select(by, F.posexplode(candidates).alias("_pos", "_candidate"))
    hits = tried.join(guides.select(F.col(identifier).alias("_candidate"), F.col(items).alias("_items")), "_candidate")
    first = hits.groupBy(by).agg(F.min_by(F.struct("_candidate", "_items"), "_pos").alias("_hit"))
    out = documents.select(by).join(first, by, "left")
    return out.select(by, F.col("_hit._candidate").alias("identifier"), F.col("_hit._items").alias("items"), F.when(F.col("_hit").isNull(), "falha").otherwise("ok").alias("status"))


def required_in_rounds(documents: DataFrame, lookup: Callable[[DataFrame], DataFrame], by: str, candidates: str) -> DataFrame:
    """As required_items, for a lookup that is costly: round k asks for the k-th candidates of documents that no earlier round solved, and of them only for
    identifiers that weren't asked for before; no round comes after all are solved. lookup gets (identifier) rows, each once, and returns (identifier, items), a
    row for each that it knows. Rounds are as many as the longest list of candidates; each is stored, so no lookup is repeated, and the driver sees only
    whether anything is left. Null candidates are skipped; a document with a null or empty list is a ``falha``; rows with the same ``by`` are one document, that of the longest list."""
    tried = documents.filter(F.size(candidates) > 0).groupBy(by).agg(F.max_by(candidates, F.size(candidates)).alias("_c"))
    left, answers, asked, solved = stored(tried, "unsolved"), [], None, []
    place = 0
    while not left.isEmpty():
        wanted = left.select(by, F.get("_c", F.lit(place)).alias("identifier"))
        new = wanted.select("identifier").filter("identifier is not null").distinct()
        new = stored(new if asked is None else new.join(asked, "identifier", "left_anti"), "asked")
        asked = new if asked is None else asked.union(new)
        answers.append(stored(lookup(new).select("identifier", "items"), "answers"))
        known = answers[0]
        for a in answers[1:]:
            known = known.union(a)
        solved.append(stored(wanted.join(known, "identifier").select(by, "identifier", "items"), "solved"))
        place += 1
        left = stored(left.join(solved[-1], by, "left_anti").filter(F.size("_c") > place), "unsolved")
    everyone = documents.select(by).distinct()
    if not solved:
        return everyone.withColumns({"identifier": F.lit(None).cast(_element(documents, candidates)), "items": F.lit(None).cast("string"), "status": F.lit("falha")})
    found = solved[0]
    for s in solved[1:]:
        found = found.union(s)
    out = everyone.join(found.withColumn("_hit", F.lit(True)), by, "left")
    return out.select(by, "identifier", "items", F.when(F.col("_hit"), "ok").otherwise("falha").alias("status"))


def _element(df: DataFrame, column: str):
    return df.schema[column].dataType.elementType
