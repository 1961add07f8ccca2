"""Column functions on numbers, times, states and file metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages in order, and the progress at which each begins.
STAGES = ("upload", "ocr", "brnet", "validation", "completed")
FIRST_PROGRESS = (0, 1, 30, 60, 100)


def round_half_up(x: Column) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def stage_of(progress: Column) -> Column:
    """Stage by progress; null for an error (-1), which leaves the stage as it was."""
    return F.when(progress == 0, STAGES[0]).when((progress > 0) & (progress < 30), STAGES[1]).when((progress >= 30) & (progress < 60), STAGES[2]).when((progress >= 60) & (progress < 100), STAGES[3]).when(progress >= 100, STAGES[4])


def stage_position(stage: Column) -> Column:
    """1-based place of a stage; 1 for an unknown one."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0)), F.lit(1)).cast("int")


def document_state(failed: Column, progress: Column) -> Column:
    return F.when(failed, "error").when(progress >= 100, "completed").when(progress > 0, "processing").otherwise("pending")


def result_state(failed: Column, released: Column) -> Column:
    return F.when(failed, "rejected").when(released, "approved").otherwise("pending_review")


def share_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where whole is 0."""
    return F.try_divide(part * 100.0, whole)


def share_band(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").when(percent.isNotNull(), "low")


def format_bytes(n: Column) -> Column:
    """Base 1024, up to two decimals without trailing zeros, unit right after; "0 Bytes" for none."""
    units = F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB", "TB", "PB")))
    k = F.when(n < 1024, 0)
    for power in range(1, 6):
        k = k.when(n < F.lit(1024.0) ** (power + 1), power)
    k = k.otherwise(5)
    value = F.format_string("%.2f", round_half_up(n / F.pow(F.lit(1024.0), k) * 100) / 100)
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(F.regexp_replace(F.regexp_replace(value, "0+$", ""), "[.]$", ""), F.get(units, k)))


def megabytes(n: Column) -> Column:
    return F.concat(F.format_string("%.2f", round_half_up(n / 1048576 * 100) / 100), F.lit("MB"))


def extension(name: Column) -> Column:
    return F.regexp_extract(name, "[.][^.]*$", 0)


#: Kinds in the order in which they are tried: parts of a MIME type, ends of a name.
FILE_KINDS = (
    ("document", ("pdf", "word"), (".pdf", ".doc", ".docx")),
    ("archive", ("zip", "archive"), (".zip", ".rar")),
    ("spreadsheet", ("excel",), (".xls", ".xlsx")),
    ("video", ("video/",), ()),
    ("audio", ("audio/",), ()),
    ("image", ("image/",), ()),
)


def file_kind(mime: Column, name: Column) -> Column:
    out, mime = F.lit("other"), F.coalesce(mime, F.lit(""))
    for kind, parts, ends in reversed(FILE_KINDS):
        fits = F.lit(False)
        for p in parts:
            fits = fits | F.contains(mime, F.lit(p))
        for e in ends:
            fits = fits | F.endswith(name, F.lit(e))
        out = F.when(fits, kind).otherwise(out)
    return out


def accepted(mime: Column, name: Column, size: Column, accept: list[str], max_size: int) -> Column:
    """Size up to the limit, and an exact type, a ``type/*`` or, in any case, a ``.extension`` from the list."""
    fits = F.lit(not accept)
    for a in accept:
        fits = fits | (F.endswith(F.lower(name), F.lit(a.lower())) if a.startswith(".") else F.startswith(mime, F.lit(a[:-1])) if a.endswith("/*") else mime == a)
    return (size <= max_size) & F.coalesce(fits, F.lit(False))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def local_date(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def local_minute(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_timestamp(text: Column) -> Column:
    """A timestamp from text that begins like one, else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}"), F.try_to_timestamp(text))


def ago(ts: Column, now: Column) -> Column:
    """Elapsed time in words, by its largest unit."""
    s = F.timestamp_diff("SECOND", ts, now)
    unit = lambda n, name: counted(F.floor(s / n), f"{name} ago", f"{name}s ago")
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "minute")).when(s < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


#: What a result's state is called.
STATE_LABELS = {"approved": "Aprovado", "rejected": "Rejeitado"}


def state_label(state: Column) -> Column:
    out = F.lit("Pendente")
    for name, label in STATE_LABELS.items():
        out = F.when(state == name, label).otherwise(out)
    return out


def looks_numeric(text: Column) -> Column:
    """Empty, or a number as it is being typed."""
    return (text == "") | text.rlike(r"^-?\d*\.?\d*$")


def entered_value(text: Column, was: Column, low: float, high: float, at_least: Column | None = None, at_most: Column | None = None) -> Column:
    """A typed slider value: 0 for a blank or a lone minus, the value before for what is no number, else within the limits and the other thumb."""
    number = F.get(F.transform(F.array(text), lambda t: F.regexp_extract(t, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")), 0)
    value = clamp(number, low, high)
    if at_most is not None:
        value = F.least(value, at_most)
    if at_least is not None:
        value = F.greatest(value, at_least)
    return F.when(text.isin("", "-"), 0.0).when(number.isNull(), was).otherwise(value)


def score_shown(score: Column) -> Column:
    return F.format_string("%.4f", score.cast("double"))


def size_or_zero(items: Column) -> Column:
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0))


def stable_id(*parts: Column) -> Column:
    """An identifier that the same parts always give."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), F.lit(16))
