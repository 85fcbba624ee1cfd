"""Secret scans: known forms, and a battery of randomness tests on opaque tokens.

Known forms are assignments, access keys and long hex numbers. Beyond these, every run of
20 or more token characters is a candidate. Its encoding is inferred from its characters
(hex, upper-case base 32, letters and digits, base 64), and within that alphabet

* a chi-squared test of uniform use of the alphabet,
* a runs test about the middle of the alphabet, and
* a test of the correlation of neighbouring characters

combine by Fisher's method into the chance that a random string looks no more regular.
Candidates where that chance is below ``REGULAR`` are no random strings.

Of the rest, the chance that ordinary text looks so random is bounded from the alphabet's
share of ordinary letters, the number of equal pairs of characters, and the number of
changes between lower case, upper case and digits. These chances are held against a
false-discovery rate separately by class of length, since what a short string can prove is
less than what a long one can. The thresholds come from a histogram of the chances of all
candidates, a few thousand rows whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, joined_sha256, let, staged, whole_text

# Fixed patterns of the contract; the letters of a key word are in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ["assign", "access", "hex", "random"]
# A candidate of the method: a whole run of token characters.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
# Whole runs that are long enough: the same matches as the pattern above after failing ones are dropped.
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"

# Alphabet, its size, and the share of the letters of ordinary text that lie in it.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 0.27),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    "base64": ("^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1.0),
}
TEXT_PAIRS = 0.06  # chance that two letters of ordinary text are equal
TEXT_CHANGES = 0.05  # chance that ordinary text goes from one class of character to another
REGULAR = 1e-4
DISCOVERY = 1e-3  # of the candidates called secret, the share that may be ordinary
LENGTHS = [24, 32, 48, 64, 128]  # classes of length, by upper limit
STEPS, MOST = 10, 400  # histogram of chances: steps a decade, and the last step


def _upper_tail(z: Column) -> Column:
    """Chance that a normal variable is above z (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def token_chances(token: Column) -> Column:
    """For a candidate: encoding, chance under randomness, and chance under ordinary text."""
    return let(F.regexp_replace(token, "=+$", ""), _of_bare)


def _of_bare(bare: Column) -> Column:
    encoding = F.when(bare.rlike("^[0-9]+$"), "decimal")
    for name, (pattern, _, _) in ENCODINGS.items():
        encoding = encoding.when(bare.rlike(pattern), name)

    def of_encoding(name: Column) -> Column:
        alphabet = F.when(F.lit(False), "")
        share = F.when(F.lit(False), 0.0)
        for own, (_, letters, part) in ENCODINGS.items():
            alphabet, share = alphabet.when(name == own, letters), share.when(name == own, part)
        text = F.when(name == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
        known = F.struct(
            alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("size"), share.alias("share"),
            text.alias("text"), F.split(text, "").alias("letters"), F.length(text).cast("double").alias("n"),
        )
        return let(known, lambda k: let(_statistics(bare, k), lambda x: _chances(name, k, x)))

    return let(encoding, of_encoding)


def _statistics(bare: Column, k: Column) -> Column:
    """Squares of the counts, ranks in the alphabet about its middle, and changes of class."""
    n, text = k["n"], k["text"]
    counts = F.transform(
        F.array_distinct(k["letters"]), lambda c: n - F.length(F.replace(text, c, F.lit("")))
    )
    rank = F.transform(k["letters"], lambda c: F.instr(k["alphabet"], c) - (k["size"] + 1) / 2)
    classes = F.regexp_replace(bare, "[+/_-]", "")
    for pattern, sign in (("[0-9]", "0"), ("[A-Z]", "A"), ("[a-z]", "a")):
        classes = F.regexp_replace(classes, pattern, sign)
    changes = F.greatest(F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1, F.lit(0)) / (n - 1)
    return F.struct(
        _sum(F.transform(counts, lambda c: c * c)).alias("squares"),
        F.filter(rank, lambda x: x.isNotNull()).alias("rank"),
        changes.alias("changes"),
    )


def _chances(encoding: Column, k: Column, x: Column) -> Column:
    n, size, squares, rank = k["n"], k["size"], x["squares"], x["rank"]
    # Uniform use of the alphabet: Wilson and Hilferty's normal form of chi-squared.
    free = size - 1
    chi = size / n * squares - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    steps = F.greatest(F.size(rank) - 1, F.lit(0))
    leading, following = F.slice(rank, F.lit(1), steps), F.slice(rank, F.lit(2), steps)
    crossings = _sum(F.zip_with(leading, following, lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0)))
    z_runs = F.abs(crossings - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    power = F.greatest(_sum(F.transform(rank, lambda a: a * a)), F.lit(1e-9))
    serial = _sum(F.zip_with(leading, following, lambda a, b: a * b)) / power
    z_serial = F.abs(serial) * F.sqrt(n)
    two_sided = lambda z: F.least(2 * let(z, _upper_tail), F.lit(1.0))
    half = -(F.ln(let(z_chi, _upper_tail)) + F.ln(two_sided(z_runs)) + F.ln(two_sided(z_serial)))
    random = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    # Ordinary text: inside the alphabet, with so many changes of class and, given any, so few
    # equal pairs; letters of one case alone may be a run of words.
    pairs, equal = n * (n - 1) / 2, (squares - n) / 2
    p_pairs = let((pairs * TEXT_PAIRS - equal - 0.5) / F.sqrt(pairs * TEXT_PAIRS), _upper_tail)
    p_pairs = F.when(x["changes"] > 0, p_pairs).otherwise(1.0)
    excess = F.greatest(x["changes"], F.lit(TEXT_CHANGES))
    rest = F.when(excess < 1, (1 - excess) * F.ln((1 - excess) / (1 - TEXT_CHANGES))).otherwise(0.0)
    distance = excess * F.ln(excess / TEXT_CHANGES) + rest
    ordinary = F.greatest(n * F.ln(k["share"]) + F.ln(p_pairs) - (n - 1) * distance, F.lit(-600.0))
    return F.struct(encoding.alias("encoding"), random.alias("random"), F.exp(ordinary).alias("ordinary"))


def _length_class(token: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, limit in reversed(list(enumerate(LENGTHS))):
        out = F.when(F.length(token) <= limit, i).otherwise(out)
    return out


def _step(chance: Column) -> Column:
    """The step of a chance: at most 10 ** (-step / STEPS)."""
    return F.least(F.floor(-F.log10(F.greatest(chance, F.lit(1e-300))) * STEPS), F.lit(MOST)).cast("int")


def discovery_steps(tokens: DataFrame, token: str = "value") -> dict[int, int]:
    """By class of length, the smallest step at which a chance is a discovery (Benjamini and Hochberg)."""
    chances = token_chances(F.col(token))
    steps = (
        tokens.select(_length_class(F.col(token)).alias("length"), chances.alias("p"))
        .where(F.col("p.encoding") != "decimal")
        .groupBy("length", _step(F.col("p.ordinary")).alias("step"))
        .count()
        .collect()  # at most (len(LENGTHS) + 1) * (MOST + 1) rows
    )
    out = {}
    for length in {r["length"] for r in steps}:
        own = sorted(((r["step"], r["count"]) for r in steps if r["length"] == length), reverse=True)
        total, below = sum(c for _, c in own), 0
        for step, count in own:
            below += count
            if 10 ** (-step / STEPS) <= DISCOVERY * below / total:
                out[length] = step
    return out


def is_secret(token: Column, steps: dict[int, int]) -> Column:
    """Whether the battery and the thresholds call a candidate a secret."""
    if not steps:
        return F.lit(False)
    least = F.try_element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), _length_class(token))
    secret = lambda p: (p["encoding"] != "decimal") & (p["random"] >= REGULAR) & (_step(p["ordinary"]) >= least)
    return F.coalesce(let(token_chances(token), secret), F.lit(False))


def _matches(text: Column, kind: int, pattern: str, keep: int, group: int = 0) -> Column:
    """The matches of a pattern with the text before each, as (kind, gap, length, long enough, value)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value")
    )
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("kind"), F.length(m["before"]).cast("long").alias("gap"),
            F.length(m["whole"]).cast("long").alias("length"), (F.length(m["value"]) >= keep).alias("kept"),
            F.when(F.lit(kind == 3), m["value"]).alias("value"),
        ),
    )


def _candidates(text: Column) -> Column:
    """All matches of all kinds in a text; texts without a sign of a kind skip it."""
    none = F.array().cast("array<struct<kind:int,gap:bigint,length:bigint,kept:boolean,value:string>>")
    sign = {
        0: (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN),
        1: F.contains(text, F.lit("AKIA")),
        2: text.rlike(LONG_HEX),
        3: text.rlike(TOKEN),
    }
    found = [
        _matches(text, 0, ASSIGN, VALUE, 2),
        _matches(text, 1, LONG_ACCESS, ACCESS_LENGTH),
        _matches(text, 2, LONG_HEX, HEX_LENGTH),
        _matches(text, 3, TOKEN, 1),
    ]
    return F.concat(*[F.when(sign[i], m).otherwise(none) for i, m in enumerate(found)])


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``key`` and ``spans``, an array of (start, kind, end, value) in order.

    Kinds are 0 assign, 1 access, 2 hex and 3 random; places count code points, the end is
    exclusive. ``value`` is the token of a random span, null for the others. Spans of
    different kinds may overlap.

    A null or empty text has no spans. Rows are told apart by their place in the scan, so
    repeated rows, repeated and null keys each keep a row. Other columns are not looked
    at. An empty table gives no rows.
    """
    row = fresh("row")
    found = docs.select(
        F.monotonically_increasing_id().alias(row), F.col(key).alias("key"), whole_text(text).alias("text")
    ).select(row, "key", _candidates(F.col("text")).alias("found"))
    one = found.select(row, "key", F.posexplode_outer("found").alias("nth", "m"))
    before = Window.partitionBy(row, "m.kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(before)
    placed = one.select(
        row, "key", F.col("m.kind").alias("kind"), (end - F.col("m.length")).alias("start"), end.alias("end"),
        F.coalesce(F.col("m.kept"), F.lit(False)).alias("kept"), F.col("m.value").alias("value"),
    )
    placed = staged(placed, "secret-candidates")
    steps = discovery_steps(placed.where("kind = 3"))
    kept = F.when(F.col("kind") == 3, is_secret(F.col("value"), steps)).otherwise(F.col("kept"))
    span = F.when(kept, F.struct("start", "kind", "end", "value"))
    out = placed.groupBy(row, "key").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select(F.col("key").alias(key), "spans")


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of the values of all secrets; other columns stay.

    Thresholds come from all candidates of the table. Values of assignments go first, then
    access keys, hex numbers and random tokens of what is left. A null text stays null; a
    text without secrets stays as it is; an empty table stays empty.
    """
    t = whole_text(text)
    tokens = docs.select(t.alias("t")).where(F.col("t").rlike(TOKEN))
    tokens = tokens.select(F.explode(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))).alias("value"))
    steps = discovery_steps(tokens)

    def replaced(column: Column, pattern: str, new, group: int = 0) -> Column:
        whole = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(column, F.lit(pattern), F.lit(group)) if group else whole
        pieces = F.split(column, pattern, -1)
        marked = F.concat(F.zip_with(whole, value, new), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, marked, lambda p, m: F.concat(p, m)), "")

    out, step = docs, fresh("text")
    out = out.withColumn(step, F.col(text).cast("string"))
    c = F.col(step)
    signed = (F.contains(c, F.lit("=")) | F.contains(c, F.lit(":"))) & c.rlike(ASSIGN)
    value = lambda m, v: F.when(
        F.length(v) >= VALUE, F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), F.lit(mark))
    ).otherwise(m)
    out = out.withColumn(step, F.when(signed, replaced(c, ASSIGN, value, 2)).otherwise(c))
    for pattern in (LONG_ACCESS, LONG_HEX):
        out = out.withColumn(step, F.when(c.rlike(pattern), F.regexp_replace(c, pattern, F.lit(mark))).otherwise(c))
    token = lambda m, v: F.when(is_secret(m, steps), F.lit(mark)).otherwise(m)
    out = out.withColumn(step, F.when(c.rlike(TOKEN), replaced(c, TOKEN, token)).otherwise(c))
    return out.withColumn(text, c).drop(step)


def op5_secret_scan(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs.select("doc_id", "text"))
    name = F.array(*map(F.lit, KINDS))
    shown = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        joined_sha256(F.transform(base, shown)).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"), count(3).alias("n_random"),
    )
