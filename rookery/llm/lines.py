"""Line deduplication with a tree of log templates.

A line is parsed to a fixed depth: number of tokens, then its first tokens, with
tokens that hold digits as variable fields. The different lines that reach one leaf are
generalised: a token is constant at its place if several documents have it there and it
stands in more than a share of the leaf's lines; all others are variable fields. The bar
is a share, so at most ``1 / RARE`` tokens of a place are constant however many lines a
leaf has. Lines that are equal but for digits recur if their constant tokens are many
enough, identical lines always. Lines whose remaining constant tokens are many enough and
equal share a template; a template that recurs is kept in its first document and
dropped from all others. Documents with the same whole text count as one here, so
copies keep their lines and are left to the deduplication of documents. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators.joins import split_join
from rookery.session import materialise

#: Leading tokens of a leaf.
DEPTH = 3
#: Share of a template's tokens that must be constant.
CONSTANT = 0.7
#: Percentage of a leaf's lines above which a token is constant at its place.
RARE = 5
#: Lines with fewer tokens keep only digits as variable fields.
LEAST_TOKENS = 6
FIELD = "<*>"
#: Words of 64 bits in the filter of look-ups: two megabytes in all whatever the data.
FILTER_WORDS = 1 << 17
_SPACES = r"[ \t]{2,}|\t"
# Whole tokens with a digit, each tried at its start only.
_FIELDS = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
_LINE = ["line", "check"]
_ROW = ["id", "hash"]


def _single(text: str) -> Column:
    """The text with single blanks for runs of blanks and tabs."""
    given = F.col(text)
    return F.when(given.contains("  ") | given.contains("\t"), F.regexp_replace(given, _SPACES, " ")).otherwise(given)


def _without(text: Column, part: str) -> Column:
    """The number of bytes that the text loses without ``part``."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))


def _filled(line: Column) -> Column:
    """Whether a line holds more than blanks and tabs; the pattern runs where a tab comes first."""
    trimmed = F.trim(line)
    return (trimmed != "") & (~trimmed.startswith("\t") | trimmed.rlike(r"[^ \t]"))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines that are not blank, as hashes: ``id, hash, line_no``, ``line, check`` (96 bits by
    which lines are equal: of the line with its fields masked if enough of its tokens are
    constant, of the line itself if not) and the ``leaf`` that parsing reaches (null if the
    line is too short for a template or has too few constant tokens)."""
    # On whole texts, before they are cut: one call of the patterns for each document.
    single = rows.select(*_ROW, _single("text").alias("single"))
    masked = single.select(*_ROW, "single", F.regexp_replace("single", _FIELDS, FIELD).alias("masked"))
    both = F.arrays_zip(F.split("single", "\n").alias("single"), F.split("masked", "\n").alias("masked"))
    cut = masked.select(*_ROW, F.posexplode(both).alias("line_no", "cut")).select(
        *_ROW, "line_no", F.trim("cut.single").alias("single"), F.trim("cut.masked").alias("masked")
    )
    tokens = _without(F.col("masked"), " ") + 1
    padded = F.concat(F.lit(" "), F.replace("masked", F.lit(" "), F.lit("  ")), F.lit(" "))
    fields = _without(padded, f" {FIELD} ") / (len(FIELD) + 2)
    counted = cut.filter("masked <> ''").withColumn("tokens", tokens)
    few = F.col("masked").contains(FIELD) & ((F.col("tokens") - fields) / F.col("tokens") < CONSTANT)
    keyed = counted.withColumn("few", few)
    key = F.when(F.col("few"), F.col("single")).otherwise(F.col("masked"))
    leaf = F.xxhash64("tokens", F.substring_index("masked", " ", DEPTH))
    return keyed.select(
        *_ROW,
        "line_no",
        F.xxhash64(key).alias("line"),
        F.hash(key).alias("check"),
        F.when(~F.col("few") & (F.col("tokens") >= LEAST_TOKENS), leaf).alias("leaf"),
    )


def recurring(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``line, check, first``: every line (as ``_lines`` names it) that several documents hold
    or whose template they share, and the first of these documents (``id, hash, line_no``).

    ``rows`` has ``id, hash`` (an order of the documents) and ``text``; ``lines`` are theirs.
    """
    # Per distinct line its first place and the range of text hashes it occurs in, which
    # is a single value if no other text has it; summed before the shuffle.
    each = materialise(
        lines.groupBy(*_LINE, "leaf").agg(
            F.min(F.struct(*_ROW, "line_no")).alias("first"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
        ),
        "lines",
    )
    equal = each.filter("low < high").select(*_LINE, "first")
    # Leaves that hold different lines of different documents, with the number of lines.
    parsed = each.filter(F.col("leaf").isNotNull())
    mixed = (
        parsed.groupBy("leaf")
        .agg(F.count("*").alias("n_lines"), *_range())
        .filter("n_lines > 1 and low < high")
        .select("leaf", "n_lines")
    )
    asked = materialise(split_join(parsed, mixed, ["leaf"]), "leaves")
    placed = materialise(_placed(rows, asked), "tokens")
    constant = (
        placed.filter(F.col("spot").isNotNull())
        .groupBy("spot")
        .agg(F.count("*").alias("n"), F.max("n_lines").alias("n_lines"), *_range())
        .filter(f"low < high and 100 * n > {RARE} * n_lines")
        .select("spot")
    )
    shapes = (
        split_join(placed.select(*_LINE, "tokens", "spot"), constant, ["spot"])
        .groupBy(*_LINE, "tokens")
        .agg(F.count("*").alias("n_constant"), F.bit_xor("spot").alias("template"))
        .filter(F.col("n_constant") >= CONSTANT * F.col("tokens"))
        .drop("tokens")
    )
    templates = asked.join(shapes, _LINE)
    template = ["leaf", "template", "n_constant"]
    shared = (
        templates.groupBy(*template)
        .agg(F.min("first").alias("first"), *_range())
        .filter("low < high")
        .select(*template, "first")
    )
    like = split_join(templates.select(*template, *_LINE), shared, template)
    found = equal.unionByName(like.select(*_LINE, "first"))
    return found.groupBy(*_LINE).agg(F.min("first").alias("first"))


def _placed(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Tokens of the ``asked`` lines: ``line, check, n_lines, tokens, low, high`` and ``spot``,
    the hash of leaf, place and token, null for a variable field."""
    place = [*_ROW, "line_no"]
    at = F.xxhash64(*place).alias("at")
    wanted = asked.select("*", *(F.col(f"first.{c}") for c in place)).drop("first")
    cut = rows.select(*_ROW, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    # Lines at these places only; most others are left out before the shuffle. Rows with one
    # id and one text have the same lines.
    found = _likely(cut.select("*", at), wanted.select(at), "at").select(*place, "text").dropDuplicates(place)
    masked = F.regexp_replace(F.trim(_single("text")), _FIELDS, FIELD)
    tokens = wanted.join(found, place).withColumn("words", F.split(masked, " "))
    exploded = tokens.select(
        *_LINE, "leaf", "n_lines", "low", "high",
        F.size("words").alias("tokens"), F.posexplode("words").alias("place", "token"),
    )
    spot = F.when(F.col("token") != FIELD, F.xxhash64("leaf", "place", "token"))
    return exploded.select(*_LINE, "n_lines", "low", "high", "tokens", spot.alias("spot"))


def _likely(lines: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of ``lines`` whose hash ``key`` may be among those ``asked``.

    The asked hashes set bits of at most ``FILTER_WORDS`` words, which may be sent to every
    task. Whoever shares a bit stays in; the join after this decides.
    """
    word = F.pmod(F.col(key), F.lit(FILTER_WORDS)).alias("_word")
    bit = F.shiftrightunsigned(key, 20).bitwiseAND(F.lit(63)).cast("int").alias("_bit")
    words = (
        asked.select(word, bit)
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    )
    kept = lines.select("*", word, bit).join(F.broadcast(words), "_word")
    return kept.filter(F.expr("bit_get(_bits, _bit) = 1")).select(*lines.columns)


def _range() -> list[Column]:
    return [F.min("low").alias("low"), F.max("high").alias("high")]


def kept_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of each row of ``docs``.

    ``n_lines`` counts lines that hold more than blanks and tabs; ``text`` has the others joined again
    and is null where it was null. The first document of a template is the one with
    the least ``doc_id`` (null last, rows with one id by the text's hash); rows with the
    same text are one document and keep the same lines. Blank lines stay. Other columns are not
    looked at; no rows give no rows.
    """
    found = _judged(docs.select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", "text")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``kept_lines``, ``n_chars`` (if there is one) counted
    anew. Documents whose lines are all dropped go; all other columns stay."""
    found = _judged(docs)
    texts = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    changed = F.col("n_dropped") > 0
    kept = [
        F.when(changed, texts[c]).otherwise(F.col(f"doc.{c}")).alias(c)
        if c in texts
        else F.col(f"doc.`{c}`")
        for c in docs.columns
    ]
    return found.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines"))).select(*kept)


def _judged(docs: DataFrame) -> DataFrame:
    """``doc`` (the given row), ``text`` after dropping, ``n_lines`` and ``n_dropped``."""
    last = F.lit((1 << 63) - 1).cast("long")
    row = [F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64("text").alias("hash")]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *row)
    keyed = docs.select(*row, "text")
    lines = materialise(_lines(keyed), "line-hashes")
    drop = materialise(recurring(keyed, lines).select(*_LINE, F.col("first.hash").alias("kept_in")), "recurring")
    found = split_join(_likely(lines.drop("leaf"), drop, "line"), drop, _LINE).filter("hash <> kept_in")
    # The numbers of a document's own dropped lines.
    dropped = found.groupBy(*_ROW).agg(F.collect_set("line_no").alias("numbers"))
    text = F.col("doc.text")
    cut = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("numbers"))
    joined = F.array_join(F.transform(kept, lambda k: F.get(cut, k)), "\n")
    filled = F.size(F.filter(cut, _filled))
    return packed.join(dropped, _ROW, "left").select(
        "doc",
        F.when(text.isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(text.isNull() | F.col("numbers").isNull(), text).otherwise(joined).alias("text"),
    )
