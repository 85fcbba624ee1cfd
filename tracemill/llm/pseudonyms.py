"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their check are written as a pair (a, b) with a below A and b
below B, so that all valid values are the A * B pairs. A round adds a keyed hash of one to
the other, modulo its bound; ten rounds permute the pairs. So the pseudonym has the same
format and is valid, equal values have equal pseudonyms in all documents, and different
values different ones.

| Kind | Check | Permuted |
| --- | --- | --- |
| card | 13 to 19 digits, Luhn | all digits but the last, which is made to fit |
| phone | three, three and four digits, with or without country code | the ten digits |
| ssn | area 001-899 but 666, group and serial not zero | among the valid ones |
| date | a day of the calendar, year-month-day or day/month/year | within its 400 years of 146,097 days |
| ip | four numbers up to 255 | all 32 bits |
| email | name and domain | both become keyed hashes, not a permutation |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, let

KEY = "tracemill-demo-key"  # pass your own
ROUNDS = 10

# Fixed patterns of what may be personal data. A repeated group is possessive or bounded: any other recurses by turn.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ANY = "|".join([EMAIL, DATE, SSN, CARD, PHONE, IP])

# The same with their checks, so that what fails one consumes no text.
LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
MONTH_DAY = "(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
DAY_MONTH = "(?:(?:0[1-9]|[12][0-9]|3[01])/(?:0[13578]|1[02])|(?:0[1-9]|[12][0-9]|30)/(?:0[469]|11)|(?:0[1-9]|1[0-9]|2[0-8])/02)"
VALID_DATE = (
    f"(?<![0-9-])(?:[0-9]{{4}}-{MONTH_DAY}|{LEAP}-02-29)(?![0-9-])"
    f"|(?<![0-9/])(?:{DAY_MONTH}/[0-9]{{4}}|29/02/{LEAP})(?![0-9/])"
)
VALID_SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
NUMBER = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
VALID_IP = rf"(?<![0-9.]){NUMBER}(?:\.{NUMBER}){{3}}(?![0-9]|\.[0-9])"
# Cards as they are written, and any groups of digits; each from every group on, up to 19 of them.
WRITTEN = [
    "[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}"
    "|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}"
]
GROUPED = [f"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in (16, 15, 14, 13, 17, 18, 19)]  # most cards have 16 digits
MOST_GROUPS = 19
LETTERS = "abcdefghijklmnopqrst"  # the number of groups, from 0 on
CYCLE = 146_097  # days in 400 years
DAYS = (189, 773)  # their product is CYCLE


def _hashed(*parts: Column) -> Column:
    """60 bits that follow from the parts."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, bound_a: Column, bound_b: Column, tweak: Column) -> Column:
    """The pair (a, b) permuted among all pairs below the bounds; bounds up to 10^18."""

    def round_(s: Column, r: Column) -> Column:
        part = lambda x: _hashed(tweak, r.cast("string"), x.cast("string"))
        left = F.struct(F.pmod(s["a"] + F.pmod(part(s["b"]), bound_a), bound_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(part(s["a"]), bound_b), bound_b).alias("b"))
        return F.when(r % 2 == 0, left).otherwise(right)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, tweak: Column) -> Column:
    """A string of up to 36 digits permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    a = F.coalesce(F.substring(digits, F.lit(1), left).try_cast("long"), F.lit(0))  # none of one digit
    b = F.substring(digits, left + 1, n - left)
    pair = feistel(a, b, power(left), power(n - left), F.concat_ws("|", tweak, n.cast("string")))
    return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0")))


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, the last one counting once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _in_format(shape: Column, digits: Column) -> Column:
    """The digits at the places where ``shape`` has digits."""
    before = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i)))
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), put), "")


def _card(m: Column, key: Column) -> Column:
    def permuted(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), F.concat_ws("|", key, F.lit("card")))
        check = lambda p: F.pmod(10 - F.pmod(_luhn(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10))
        whole = let(body, lambda p: F.concat(p, check(p).cast("string")))
        return F.when(_luhn(d) % 10 == 0, _in_format(m, whole))

    return let(_digits(m), permuted)


def _phone(m: Column, key: Column) -> Column:
    def permuted(d: Column) -> Column:
        code = F.substring(d, F.lit(1), F.length(d) - 10)
        own = permute_digits(F.right(d, F.lit(10)), F.concat_ws("|", key, F.lit("phone")))
        return let(F.concat(code, own), lambda whole: _in_format(m, whole))

    return let(_digits(m), permuted)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    nth = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(nth * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.concat_ws("|", key, F.lit("ssn")))

    def shown(p: Column) -> Column:
        n = F.floor(p["a"] / 99)
        number = n + 1 + F.when(n >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", number, F.pmod(p["a"], F.lit(99)) + 1, p["b"] + 1)

    return F.when(valid, let(pair, shown))


def _date(m: Column, key: Column) -> Column:
    iso = F.contains(m, F.lit("-"))
    written = F.when(iso, m).otherwise(F.concat_ws("-", F.right(m, F.lit(4)), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.expr("0") + F.datediff(written.try_cast("date"), F.to_date(F.lit("1800-01-01")))

    def permuted(n: Column) -> Column:
        at = F.pmod(n, F.lit(CYCLE))
        a, b = (F.lit(x) for x in DAYS)
        pair = feistel(F.floor(at / DAYS[1]), F.pmod(at, b), a, b, F.concat_ws("|", key, F.lit("date")))
        moved = let(pair, lambda p: (n - at + p["a"] * DAYS[1] + p["b"]).cast("int"))
        out = F.date_add(F.to_date(F.lit("1800-01-01")), moved)
        return F.when(iso, F.date_format(out, "yyyy-MM-dd")).otherwise(F.date_format(out, "dd/MM/yyyy"))

    return let(day, lambda n: F.when(n.isNotNull(), permuted(n)))


def _ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def permuted(p: Column) -> Column:
        valid = F.forall(p, lambda x: x <= 255)
        bound = F.lit(65536)
        pair = feistel(F.get(p, 0) * 256 + F.get(p, 1), F.get(p, 2) * 256 + F.get(p, 3), bound, bound, F.concat_ws("|", key, F.lit("ip")))
        shown = lambda q: F.concat_ws(".", *[x.cast("string") for v in (q["a"], q["b"]) for x in (F.floor(v / 256), F.pmod(v, F.lit(256)))])
        return F.when(valid, let(pair, shown))

    return let(parts, permuted)


def _email(m: Column, key: Column) -> Column:
    name, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    hashed = lambda *p: F.sha2(F.concat_ws("|", key, *p), 256)
    user = F.substring(hashed(F.lit("name"), F.lower(name), domain), 1, 12)
    host = F.substring(hashed(F.lit("domain"), domain), 1, 8)
    return F.concat(F.lit("u"), user, F.lit("@d"), host, F.lit(".example"))


def _groups_of_card(ahead: Column, bodies: list[str]) -> Column:
    """How many groups of digits make a card that passes its check at the beginning; 0 if none do."""
    found = F.lit(0)
    for p in reversed(bodies):
        m = F.regexp_extract(ahead, f"^({p})(?![0-9])", 1)
        found = F.when((m != "") & (_luhn(_digits(m)) % 10 == 0), F.size(F.split(m, "[ -]"))).otherwise(found)
    return F.when(ahead.rlike("^[0-9](?:[ -]?[0-9]){12}"), found).otherwise(0)


def _around_cards(text: Column, bodies: list[str]) -> Column:
    """A text cut around its cards that pass their check: what is between them at even places, cards at odd ones.

    From left to right, at every group of digits, the first of the bodies that passes consumes its groups."""

    def consumed(groups: Column) -> Column:
        # A letter for each group: a where no card begins, else the number of its groups. One search
        # then takes the letters from left to right, each with the groups it consumes.
        first = F.transform(groups, lambda g: F.regexp_extract(g, "^[0-9]{0,20}", 0))
        short = F.zip_with(first, groups, lambda d, g: F.concat(d, F.when(g.rlike("^[0-9]+[ -]$"), F.right(g, F.lit(1))).otherwise("#")))
        ahead = lambda s, i: F.array_join(F.slice(s, i + 1, F.lit(MOST_GROUPS)), "")
        letter = lambda k: F.substring(F.lit(LETTERS), k + 1, F.lit(1))
        letters = let(short, lambda s: F.array_join(F.transform(s, lambda _, i: letter(_groups_of_card(ahead(s, i), bodies))), ""))
        taken = F.regexp_extract_all(letters, F.lit("|".join(f"{c}.{{{max(k - 1, 0)}}}" for k, c in enumerate(LETTERS))), F.lit(0))
        return F.split(F.array_join(F.transform(taken, lambda t: F.concat(F.left(t, F.lit(1)), F.repeat(F.lit("."), F.length(t) - 1))), ""), "")

    def cut(groups: Column, flags: Column, sign: Column) -> Column:
        def shown(g: Column, i: Column) -> Column:
            flag = F.get(flags, i)

            def card(k: Column) -> Column:
                last = F.get(groups, i + k - 1)
                digits = F.regexp_extract(last, "^[0-9]+", 0)
                whole = F.concat(F.array_join(F.slice(groups, i + 1, k - 1), ""), digits)
                return F.concat(sign, whole, sign, F.substr(last, F.length(digits) + 1))

            return F.when(flag == "a", g).when(flag == ".", "").otherwise(let(F.instr(F.lit(LETTERS), flag) - 1, card))

        return F.split(F.array_join(F.transform(groups, shown), ""), sign, -1)

    # No text has a longer run of U+0002 than its own longest.
    runs = F.transform(F.regexp_extract_all(text, F.lit("\x02++"), F.lit(0)), F.length)
    sign = F.concat(F.lit("\x01"), F.repeat(F.lit("\x02"), F.coalesce(F.array_max(runs), F.lit(0)) + 1), F.lit("\x01"))
    groups = F.split(text, "(?<![0-9])(?=[0-9])", -1)
    return let(groups, lambda g: let(consumed(g), lambda f: let(sign, lambda s: cut(g, f, s))))


# In this order; each consumes what passes its check and leaves the rest to the next.
KINDS = [
    ("email", EMAIL, _email), ("date", VALID_DATE, _date), ("ssn", VALID_SSN, _ssn), ("ip", VALID_IP, _ip),
    ("card", WRITTEN, _card), ("phone", PHONE, _phone), ("card", GROUPED, _card),
]


def _replaced(pieces: Column, kind: str, pattern: str | list[str], make, key: Column) -> Column:
    """Pieces of a text, (kind, shown), with a kind cut out of those that have none yet."""
    piece = lambda shown, name: F.struct(name.cast("string").alias("kind"), shown.alias("shown"))

    def cut(text: Column, own: Column) -> Column:
        made = F.transform(F.regexp_extract_all(text, own, F.lit(0)), lambda m: let(make(m, key), lambda v: piece(
            F.coalesce(v, m), F.when(v.isNotNull(), F.lit(kind)))))
        between = F.transform(F.split(text, own, -1), lambda b: piece(b, F.lit(None)))
        pairs = F.zip_with(between, made, lambda b, m: F.filter(F.array(b, m), lambda x: x.isNotNull()))
        return F.flatten(pairs)

    def each(p: Column) -> Column:
        text, same = p["shown"], F.array(p)
        if isinstance(pattern, str):
            return F.when(p["kind"].isNull() & text.rlike(pattern), cut(text, F.lit(pattern))).otherwise(same)
        card = lambda m: let(make(m, key), lambda v: piece(F.coalesce(v, m), F.when(v.isNotNull(), F.lit(kind))))
        parts = F.transform(_around_cards(text, pattern), lambda x, i: F.when(i % 2 == 0, piece(x, F.lit(None))).otherwise(card(x)))
        return F.when(p["kind"].isNull() & text.rlike(CARD), parts).otherwise(same)

    return F.flatten(F.transform(pieces, each))


def pseudonymize(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``pii``: the kinds replaced, in order.

    What fails its check stays: a number without a Luhn sum, a 31st of June; what lies within
    or across it is looked for all the same. Cards are tried from every group of digits on,
    those written in the usual groups first, then all lengths, 16 digits first. Each row is
    judged by itself, so repeated rows and ids stay; other columns stay, a column named
    ``pii`` is replaced. A null text stays null and has no kinds, an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "pii"]
    t, pieces = F.col(text), fresh("pieces")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("kind"), t.alias("shown")))
    out = docs.select(*kept, F.when(t.rlike("[0-9@]") & t.rlike(ANY), whole).alias(pieces))
    for kind, pattern, make in KINDS:
        out = out.withColumn(pieces, _replaced(F.col(pieces), kind, pattern, make, F.lit(key)))
    kinds = F.filter(F.transform(pieces, lambda p: p["kind"]), lambda k: k.isNotNull())
    out = out.withColumn("pii", F.coalesce(kinds, F.array().cast("array<string>")))
    joined = F.array_join(F.transform(pieces, lambda p: p["shown"]), "")
    return out.withColumn(text, F.when(F.col(pieces).isNotNull(), joined).otherwise(t)).select(*kept, "pii")


def op9_pii_pseudonyms(docs: DataFrame) -> DataFrame:
    out = pseudonymize(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("pii")), ",").alias("kinds"))
