"""Column functions on names, identifiers and page texts.

All are null in, null out, and JVM-side. Regular expressions use explicit ASCII classes, as Java, Python and RE2 differ
in what \\d, \\w and \\b mean beyond ASCII.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_letters() -> tuple[str, str]:
    """Letters up to U+024F that NFKD takes to a single ASCII letter and marks, and those letters."""
    accented, plain = "", ""
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            accented, plain = accented + chr(code), plain + base
    return accented, plain


ACCENTED, PLAIN = _latin_letters()
MARKS = "".join(chr(c) for c in range(0x300, 0x370))


def strip_accents(text: Column) -> Column:
    """Latin letters without diacritics; combining marks go."""
    return F.translate(text, ACCENTED + MARKS, PLAIN)


def normalize_upper(text: Column) -> Column:
    """Without diacritics, upper case, trimmed; other characters stay."""
    return F.trim(F.upper(strip_accents(text)))


def normalize_key(text: Column) -> Column:
    """Without diacritics, lower case, every run of other characters than a-z and 0-9 as one space, trimmed: the key that names are matched by."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def state_identifier(text: Column) -> Column:
    """Eleven digits after two capital letters and a slash, first match, or null."""
    return F.nullif(F.regexp_extract(text, "(?<![A-Za-z0-9_])[A-Z]{2}/([0-9]{11})(?![A-Za-z0-9_])", 1), F.lit(""))


PLAIN_IDENTIFIER = "(?<![A-Za-z0-9_])([0-9]{3}[.]?[0-9]{3}[.]?[0-9]{3}-?[0-9]{2})(?![A-Za-z0-9_])"


def first_identifier(text: Column) -> Column:
    """The state-prefixed identifier if there is one, else the first plain one, punctuated or not, as digits; else null."""
    return F.coalesce(state_identifier(text), F.nullif(digits(F.regexp_extract(text, PLAIN_IDENTIFIER, 1)), F.lit("")))


def all_identifiers(text: Column, but: Column | None = None) -> Column:
    """Distinct identifiers as digits in order of appearance, without one of them if given."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PLAIN_IDENTIFIER), 1), digits))
    return found if but is None else F.filter(found, lambda x: ~x.eqNullSafe(but))


def format_identifier(text: Column) -> Column:
    """Eleven digits as 3.3.3-2; anything else unchanged."""
    d = digits(text)
    return F.when(F.length(d) == 11, F.regexp_replace(d, "([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})", "$1.$2.$3-$4")).otherwise(text)


def mask_identifier(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(3)), F.lit("***"))


def preview(text: Column, chars: int = 50) -> Column:
    return F.left(text, F.lit(chars))


def person_name(page: Column) -> Column:
    """What follows the name label, up to a tab, two spaces, the identity label or the line's end; null without a label."""
    found = F.regexp_extract(page, r"Nome / Name:[ ]*([^\n]*)", 1)
    name = F.trim(F.split(found, "\t|  |Identidade / ID Number:").getItem(0))
    return F.nullif(name, F.lit(""))


def exam_section(page: Column) -> Column:
    """Text after the line of section 4 up to that of section 5 or the end; empty without it."""
    return F.regexp_extract(page, r"(?s)4\. Exames / Exams:(.*?)(?:\n[ \t]*5\. |\z)", 1)


#: Lines of a page that name no item: lower-case phrases anywhere, and starts (fixed values).
NOT_ITEMS = ("não requer preparo prévio", "horas antes do exame", "evitar", "não ingerir", "manter dieta", "informar os medicamentos", "caso faça uso de óculos", "não se expor a sons fortes", "voltar imprimir", "copyright")
NOT_STARTS = ("4.", "obrigatório")


def item_names(page: Column) -> Column:
    """Distinct item names of a page's section 4, in order: cells between tabs, each cut at a slash or asterisk; subsection titles and blocklisted lines name none."""
    lines = F.split(exam_section(page), "\n")
    bare = lambda x: F.lower(F.trim(x))

    def wanted(x: Column) -> Column:
        out = bare(x) != ""
        for phrase in NOT_ITEMS:
            out = out & ~F.contains(bare(x), F.lit(phrase))
        for start in NOT_STARTS:
            out = out & ~F.startswith(bare(x), F.lit(start))
        return out

    cells = F.flatten(F.transform(F.filter(lines, wanted), lambda x: F.split(x, "\t")))
    names = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"(?s)[/*].*", "")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def heading_items(markdown: Column) -> Column:
    """Items of an extracted document: first- or second-level headings and lines ``NAME - dd/mm/yyyy``, in upper case, distinct, in order."""
    lines = F.split(markdown, "\n")
    heading, dated = "^#{1,2} +(.+)$", "^(.+?) +- +[0-9]{2}/[0-9]{2}/[0-9]{4}$"
    name = lambda x: F.when(x.rlike(heading), F.regexp_extract(x, heading, 1)).when(x.rlike(dated), F.regexp_extract(x, dated, 1))
    return F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: name(F.trim(x))), lambda x: x.isNotNull()), lambda x: F.upper(F.trim(x))))


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def strip_fences(text: Column) -> Column:
    """Without a leading and trailing code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


def bullet_lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def joined(items: Column, empty: str) -> Column:
    """Comma-joined, or a default where there are none."""
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(empty))


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def embedding_text(name: Column, similar: Column) -> Column:
    """What a name and its comma-separated synonyms are embedded as."""
    names = F.transform(F.split(F.coalesce(similar, F.lit("nan")), ","), normalize_upper)
    return F.concat(F.lit("Exame: "), normalize_upper(name), F.lit(". Similares: "), F.array_join(names, ", "))


def has_domain(email: Column, domain: str) -> Column:
    """Whether an address ends in @domain; false for none."""
    return F.coalesce(F.endswith(email, F.lit(f"@{domain}")), F.lit(False))


def table_rows(message: Column, key: str, schema: str) -> Column:
    """The rows of a message that is a JSON list, in code fences or not, whose first element has key; null for any other message."""
    trimmed = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    bare = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(message), "(?i)^```json", ""), "^```", ""), "```$", ""))
    rows = F.from_json(bare, f"array<{schema}>")
    first = F.try_variant_get(F.try_parse_json(bare), f"$[0].{key}", "string")
    return F.when(bare.startswith("[") & bare.endswith("]") & (F.coalesce(first, F.lit("")) != ""), rows)
