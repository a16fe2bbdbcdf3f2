"""Secret scans in built-in Spark expressions: patterns, and a randomness test battery.

Spans of a pattern are found with their offsets by cutting the text at its matches:
the lengths of the pieces between them and of the matches add up to the positions.

The battery looks at runs of [A-Za-z0-9+/_-] of 20 characters or more. Each gets the
narrowest encoding that holds it (decimal, hexadecimal, base 32, base 62, base 64); a run
that is in none, such as a path or a long word, is no candidate. A candidate gets
three tests of the claim that its symbols are drawn at random: chi-squared uniformity
over the alphabet, number of runs of neighbours above and below the middle symbol, and
correlation of neighbours. Their normal deviates are combined into one; a candidate
whose combined deviate is too large is ordinary text. What survives may still be
ordinary text that looks random by chance: the chance is bounded by a quantity that
falls exponentially with length and with the bits of the alphabet, and the step-up
rule of false-discovery control over the candidates of the document, with these
bounds as p-values, decides which are reported.

Everything is one projection without shuffle: a document is judged alone. Null text
counts as empty and has no span. Repeated rows give repeated rows. Offsets count code
points, ends are exclusive. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group that is measured, its least length. For `access` and `hex`
#: the least length is in the pattern: a shorter run holds no longer match.
BASE_KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
)
RANDOM = ("random", r"([A-Za-z0-9+/_-]{20,})", 1, 20)
#: What a text must hold for a kind to be searched in it.
HINTS = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_-]{20}",
}

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in their order, narrow before wide.
ALPHABETS = (
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    UPPER + "234567",
    DIGITS + UPPER + LOWER,
    UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + "-_",
)
#: Sum of three squared deviates that random symbols exceed once in a thousand (chi-squared, 3 degrees).
LIMIT = 16.27
#: Share of false reports that is borne, and alphabet bits for which the chance of ordinary text halves.
FALSE_SHARE = 0.01
BITS_TO_HALVE = 12
SPAN = "array<struct<start:int,order:int,kind:string,stop:int,value:string>>"


def spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches whose group has at least `least` characters: leftmost, not overlapping, in order."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Piece, match, piece, match, ..., piece: the last has no match behind it.
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), value.alias("value"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["before"])
        stop = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        found = F.when(F.length(x["value"]) >= least, F.concat(done["found"], F.array(span))).otherwise(done["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    none = F.array().cast(SPAN)
    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda done: done["found"])
    return F.when(text.rlike(HINTS[kind]), walked).otherwise(none)


def alphabet_of(value: Column) -> Column:
    """The narrowest alphabet that holds the value; null if none does, or if it has no use for it.

    Digits alone are decimal. Letters alone are base 32 if all are upper case, and base 62 or 64 if either case makes up
    more than an eighth of them, which random letters miss less than once in a thousand; words and names in one case are in none.
    """

    def narrowest(alphabets: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for alphabet in reversed(alphabets):
            out = F.when(value.rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), F.lit(alphabet)).otherwise(out)
        return out

    digits, letters = value.rlike("[0-9]"), value.rlike("[A-Za-z]")
    upper, lower = (F.length(F.regexp_replace(value, f"[^{x}]", "")) for x in ("A-Z", "a-z"))
    mixed = 8 * F.least(upper, lower) > upper + lower
    return (
        F.when(digits & letters, narrowest(ALPHABETS))
        .when(value.rlike("^[0-9]+$"), F.lit(DIGITS))
        .when(value.rlike("^[A-Z]+$"), F.lit(UPPER + "234567"))
        .when(~digits & mixed, narrowest(ALPHABETS[4:]))
    )


def deviation(places: Column, n: Column, size: Column) -> Column:
    """Sum of the squared deviates of the three tests, for symbols given as places in an alphabet."""
    zero = F.lit(0.0)
    squares = F.aggregate(
        F.array_distinct(places), zero, lambda done, c: done + F.pow(F.size(F.filter(places, lambda x: x == c)).cast("double"), F.lit(2.0))
    )
    uniform = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1))
    neighbours = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    middle = (size - 1) / 2
    changes = F.size(F.filter(neighbours, lambda x: (x["a"] > middle) != (x["b"] > middle)))
    runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    products = F.aggregate(neighbours, zero, lambda done, x: done + (x["a"] - middle) * (x["b"] - middle))
    serial = products / ((size * size - 1) / 12) / F.sqrt(n - 1)
    return F.pow(uniform, F.lit(2.0)) + F.pow(runs, F.lit(2.0)) + F.pow(serial, F.lit(2.0))


def chance(value: Column, alphabet: Column) -> Column:
    """Bound on the chance that ordinary text gives such a value; 1 for one that does not look random, null without alphabet."""
    n, size = F.length(value).cast("double"), F.length(alphabet).cast("double")
    places = F.transform(F.split(value, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    bound = F.pow(F.lit(2.0), -n * F.log2(size) / BITS_TO_HALVE)
    return F.when(alphabet.isNotNull(), F.when(deviation(places, n, size) <= LIMIT, bound).otherwise(1.0))


def discovered(tested: Column) -> Column:
    """Candidates that pass the step-up rule over the candidates of the document."""
    chances = F.sort_array(F.transform(tested, lambda x: x["p"]))
    passing = F.filter(chances, lambda p, i: p <= (i + 1) * FALSE_SHARE / F.size(tested))
    cut = F.coalesce(F.array_max(passing), F.lit(-1.0))
    return F.filter(tested, lambda x: x["p"] <= cut)


def scan(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """`keep`, base and added spans as arrays of (start, order, kind, stop, value), in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(keep, text.alias("_text"))
    rows = rows.select(
        "*",
        *[spans(F.col("_text"), i, *kind).alias(kind[0]) for i, kind in enumerate(BASE_KINDS)],
        spans(F.col("_text"), len(BASE_KINDS), *RANDOM).alias("_runs"),
    ).drop("_text")
    rows = rows.withColumn("base", F.sort_array(F.concat(*[F.col(kind[0]) for kind in BASE_KINDS])))
    tested = F.transform("_runs", lambda x: F.struct(chance(x["value"], alphabet_of(x["value"])).alias("p"), x.alias("span")))
    # Runs in no encoding were not tested: they count neither as candidates nor as tests.
    tested = F.filter(tested, lambda x: x["p"].isNotNull())
    rows = rows.withColumn("_tested", tested).withColumn("_found", F.transform(discovered(F.col("_tested")), lambda x: x["span"]))
    apart = F.filter("_found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return rows.withColumn("added", apart).drop("_runs", "_tested", "_found")


def listed(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    rows = scan(docs)
    return rows.select(
        "doc_id",
        *[F.size(kind[0]).cast("long").alias(f"n_{kind[0]}") for kind in BASE_KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def masked(docs: DataFrame, mark: str = "*") -> DataFrame:
    """The documents with every span of their texts replaced by as many marks; all other columns stay.

    A null text stays null. Spans that overlap are masked as one.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    found = scan(docs.select(row.alias("_row"), "text"), keep="_row")
    cut = F.aggregate(
        F.sort_array(F.concat("base", "added")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, x: F.struct(
            F.greatest(done["at"], x["stop"]).alias("at"),
            F.concat(
                done["out"],
                F.col("_row")["text"].substr(done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0))),
                F.repeat(F.lit(mark), F.greatest(x["stop"] - F.greatest(x["start"], done["at"]), F.lit(0))),
            ).alias("out"),
        ),
        lambda done: F.concat(done["out"], F.col("_row")["text"].substr(done["at"] + 1, F.length(F.col("_row")["text"]))),
    )
    text = F.when(F.size("base") + F.size("added") == 0, F.col("_row")["text"]).otherwise(cut)
    return found.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])
