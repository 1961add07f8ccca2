"""Secret scan: fixed patterns, then a battery of randomness tests.

Base kinds, leftmost and without overlap within a kind: ``assign`` (a name such as password or token, a sign and a
value of six characters or more), ``access`` (AKIA keys of 20 characters or more), ``hex`` (24 or more digits).

Method: runs of ``least_chars`` or more characters of ``A-Za-z0-9+/_=-``, outside base spans, are candidates; the
parts of a run beside a base span are runs of their own. Those of fewer than ``LONG`` characters are candidates only if they have
digits and letters, or small letters and a capital that isn't the first character: of random base-64 keys of ten characters
one in some thousands has neither, while nearly all long words have neither. Nine in ten random keys of
ten characters are found, 97 in a hundred of 16; a short name that changes its case often (iPhone15ProMax) may be taken for one.
The encoding is inferred (hexadecimal, base 32, else base 64) and the characters become numbers of its alphabet.
Three tests must not reject that they are random: chi-squared for uniform use of the alphabet (Wilson-Hilferty),
number of runs above and below the middle, and serial correlation, together at ``alpha`` (Bonferroni). Against
this stands a model of names and words (letter frequencies, characters keep their class with chance 0.9): the
likelihood ratio of random to natural text bounds the chance that natural text looks so, and falls with the
length. Benjamini-Hochberg at rate ``q``, weighted by length, picks what is reported as kind ``random``. The family
over which false discoveries are controlled is one document's candidates: of what is reported in a document, a share
of ``q`` is expected to be natural text, whatever else the corpus holds, so a document's result doesn't depend on others.

Every step reads a text or a list a fixed number of times, so a scan takes time in proportion to the text.

Positions are code points, end exclusive. Everything is built from SQL functions.

Edge cases: null text counts as empty and has no spans; whole texts are searched; repeated rows and a null id pass
through. The private-use character U+E000 marks matches inside an expression; where a text has it, it is read as
U+E001, which no pattern uses, so positions stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import let, running, table, text_or_empty

MARK, OTHER = "\ue000", "\ue001"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the pattern's characters is one match, so a bound on its length drops the same matches as a look at each.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
RUN = "A-Za-z0-9+/_=-"
LEAST_CHARS, LONG, ALPHA, Q = 10, 16, 0.001, 0.001
#: Shares of a to z in English text, in percent.
LETTERS = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)
SPANS = "array<struct<start:int,end:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; text has no MARK."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)  # every other one is a match

    def spans(v: Column, end: Column) -> Column:
        span = lambda k: F.struct(F.get(end, 2 * k).cast("int").alias("start"), F.get(end, 2 * k + 1).cast("int").alias("end"), F.get(v, 2 * k + 1).alias("found"))
        return F.when(F.size(v) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), span)).otherwise(F.array().cast(SPANS))

    return let(pieces, lambda v: let(running(F.transform(v, F.length), lambda a, b: a + b), lambda end: spans(v, end)))


def matches_if(condition: Column, text: Column, pattern: str) -> Column:
    return F.when(condition, matches(text, pattern)).otherwise(F.array().cast(SPANS))


def rebuilt(text: Column, spans: Column, cover) -> Column:
    """text with each span (start, ..., end; by start), or union of overlapping spans, replaced by cover(its length)."""

    def unions(s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda i, g: F.struct(F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, g + 1), F.size(s)) - 1).cast("int").alias("end"))))

    def joined(chars: Column, u: Column) -> Column:
        before = lambda g: F.coalesce(F.get(u, g - 1)["end"], F.lit(0))
        until = lambda g: F.coalesce(F.get(u, g)["start"], F.size(chars))
        gap = lambda g: F.array_join(F.slice(chars, before(g) + 1, F.greatest(until(g) - before(g), F.lit(0))), "")
        covered = lambda g: F.coalesce(cover(F.get(u, g)["end"] - F.get(u, g)["start"]), F.lit(""))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(u)), lambda g: F.concat(gap(g), F.when(g < F.size(u), covered(g)).otherwise(F.lit("")))), "")

    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest)
    done = let(spans, lambda s: let(let(reach(s), lambda r: unions(s, r)), lambda u: let(F.split(text, ""), lambda chars: joined(chars, u))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def tail(z: Column) -> Column:
    """Chance of a standard normal above z >= 0 (Abramowitz and Stegun 26.2.17)."""
    sum_of = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return let(z.cast("double"), lambda x: F.exp(-x * x / 2) * 0.3989422804 * let(1 / (1 + 0.2316419 * x), sum_of))


def mean(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers)


def p_random(codes: Column, alphabet: Column) -> Column:
    """Of the three tests together, for an array of numbers below alphabet."""
    n, a = F.size(codes).cast("double"), alphabet.cast("double")
    squares = F.aggregate(F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    free = a - 1
    z = (F.pow(F.greatest(a / n * squares - n, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    uniform = let(z, lambda x: F.when(x <= 0, 0.5).otherwise(tail(x)))

    runs = 1.0 + F.size(F.filter(F.sequence(F.lit(1), F.size(codes) - 1), lambda i: (F.get(codes, i) >= alphabet / 2) != (F.get(codes, i - 1) >= alphabet / 2)))

    def of_runs(high: Column) -> Column:
        expected = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        return F.when((high == 0) | (high == n), 0.0).otherwise(2 * tail(F.abs(runs - expected) / spread))

    by_runs = let(F.size(F.filter(codes, lambda c: c >= alphabet / 2)).cast("double"), of_runs)

    middle = let(mean(codes), lambda m: F.transform(codes, lambda c: c - m))
    product = lambda m: F.aggregate(F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.get(m, i) * F.get(m, i - 1)), F.lit(0.0), lambda s, x: s + x)
    serial = let(middle, lambda m: product(m) / F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x), F.lit(1e-9)) * F.sqrt(n))
    by_serial = 2 * tail(F.abs(serial))
    return F.least(F.lit(1.0), 3 * F.least(uniform, by_runs, by_serial))


def log_ratio(points: Column, alphabet: Column) -> Column:
    """Log-likelihood of uniform characters less that of natural text, for an array of ASCII codes."""
    share = F.array(*[F.lit(float(x) / 100) for x in LETTERS])
    kind = lambda c: F.when(c.between(48, 57), 0).when(c.between(65, 90), 1).when(c.between(97, 122), 2).otherwise(3)
    within = lambda c: F.when(c.between(48, 57), 0.1).when(c.between(65, 90), F.get(share, c - 65)).when(c.between(97, 122), F.get(share, c - 97)).otherwise(0.2)
    moves = lambda c, i: F.when(i == 0, 0.25).when(kind(c) == kind(F.get(points, i - 1)), 0.9).otherwise(0.1 / 3)
    natural = F.aggregate(F.transform(points, lambda c, i: F.log(within(c)) + F.log(moves(c, i))), F.lit(0.0), lambda s, x: s + x)
    return -F.size(points) * F.log(alphabet.cast("double")) - natural


def tested(candidates: Column, average: Column, alpha: float) -> Column:
    """array<struct<start, end, p>>: the candidates that look random, with the bound of chance that natural text does, divided by length weight; average is their mean length."""

    def tests(c: Column, v: Column, size: Column) -> Column:
        in_hex = lambda x: F.when(x <= 57, x - 48).when(x <= 90, x - 55).otherwise(x - 87)
        in_32 = lambda x: F.when(x >= 65, x - 65).otherwise(x - 24)
        in_64 = lambda x: F.when(x.between(65, 90), x - 65).when(x.between(97, 122), x - 71).when(x.between(48, 57), x + 4).when(x.isin(43, 45), 62).otherwise(63)
        number = lambda x: F.when(size == 16, in_hex(x)).when(size == 32, in_32(x)).otherwise(in_64(x)).cast("double")
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            (F.exp(-F.greatest(log_ratio(v, size), F.lit(0.0))) * average / (c["end"] - c["start"])).alias("p"),
            let(F.transform(v, number), lambda codes: p_random(codes, size)).alias("random"),
        )

    def judge(c: Column) -> Column:
        size = lambda body: F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        points = lambda body: F.transform(F.split(body, ""), F.ascii)
        return let(F.rtrim(c["found"], F.lit("=")), lambda body: let(points(body), lambda v: let(size(body), lambda n: tests(c, v, n))))

    return F.filter(F.transform(candidates, judge), lambda c: c["random"] >= alpha)


def candidates_of(least: int) -> str:
    """The pattern of runs that are tested."""
    mixed = rf"(?=[{RUN}]*[0-9])(?=[{RUN}]*[A-Za-z])|(?=[{RUN}]+[A-Z])(?=[{RUN}]*[a-z])"
    short = rf"|(?<![{RUN}])(?:{mixed})[{RUN}]{{{least},{LONG - 1}}}(?![{RUN}])" if least < LONG else ""
    return rf"[{RUN}]{{{max(least, LONG)},}}{short}"


def scan(df: DataFrame, text: str = "text", out: str = "secrets", least_chars: int = LEAST_CHARS, alpha: float = ALPHA, q: float = Q) -> DataFrame:
    """df with out: array<struct<start, rank, end>> by start, then kind; rank is the kind's place in KINDS."""
    others = [c for c in df.columns if c != out]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.replace(text_or_empty(text), F.lit(MARK), F.lit(OTHER)).alias("_t"))
    t, low = F.col("_t"), F.lower("_t")
    named = (t.contains("=") | t.contains(":")) & (low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api"))
    df = df.withColumns({
        "_assign": matches_if(named, t, ASSIGN),
        "_access": matches_if(t.contains("AKIA"), t, ACCESS),
        "_hex": matches_if(t.rlike(HEX), t, HEX),
    })
    kept = lambda name, rank, keep: F.transform(F.filter(name, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6
    df = df.withColumn("_base", F.array_sort(F.concat(kept("_assign", 0, value), kept("_access", 1, lambda m: F.lit(True)), kept("_hex", 2, lambda m: F.lit(True)))))
    run = candidates_of(least_chars)
    rest = lambda: rebuilt(t, F.col("_base"), lambda n: F.repeat(F.lit(OTHER), n))
    df = df.withColumn("_rest", F.when(t.rlike(run), rest()))
    found = F.filter(matches(F.col("_rest"), run), lambda m: F.length(F.rtrim(m["found"], F.lit("="))) >= least_chars)
    df = df.withColumn("_run", F.when(F.col("_rest").rlike(run), found).otherwise(F.array().cast(SPANS)))
    average = mean(F.transform("_run", lambda c: (c["end"] - c["start"]).cast("double")))
    df = df.withColumn("_average", F.when(F.size("_run") > 0, average)).withColumn("_tested", F.when(F.size("_run") > 0, tested(F.col("_run"), F.col("_average"), alpha)))
    ps = F.array_sort(F.transform("_tested", lambda c: c["p"]))
    cut = let(ps, lambda v: F.array_max(F.transform(v, lambda p, k: F.when(p <= q * (k + 1) / F.size("_run"), p))))
    df = df.withColumn("_cut", F.when(F.size("_tested") > 0, cut))
    more = F.transform(F.filter("_tested", lambda c: c["p"] <= F.col("_cut")), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end")))
    df = df.withColumn(out, F.array_sort(F.concat("_base", F.coalesce(more, F.array().cast("array<struct<start:int,rank:int,end:int>>")))))
    return df.select(*[F.col(f"_row.`{c}`") for c in others], out)


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, cover: str = "[SECRET]") -> Column:
    """text with each span, or union of overlapping spans, replaced."""
    return rebuilt(text, spans, lambda n: F.lit(cover))


def without_secrets(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """df with every found secret in text covered, and the text's length in the column n_chars, if named, where a text changes; a null text stays null."""
    found = scan(df.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    redacted = redact(F.col("text"), F.col("secrets"))

    def column(name: str) -> Column:
        if name == text:
            return redacted
        was = F.col(f"row.`{name}`")
        return F.when(F.size("secrets") > 0, F.length(redacted).cast(df.schema[name].dataType)).otherwise(was) if name == n_chars else was

    return found.select(*[column(c).alias(c) for c in df.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")
    base = span_string(F.filter("secrets", lambda s: s["rank"] < 3))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_string(F.col("secrets")).alias("spans"))
