"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; each is validated: card numbers by their check
digit, addresses by their octets, dates by the calendar, telephone numbers and
e-mail addresses by form. Digits in a row of groups are one candidate up to
the next value of another kind, and cards are searched in it: first in the
groupings cards are printed in, from every group on, then in what is left in
any grouping of 13 to 19 digits, from left to right without overlap. A valid
one is replaced by a keyed permutation of its own format, the same in every
document, so equal values stay linked and different ones stay different:

* cards: a Feistel network over the digits before the check digit, and the
  check digit of the result; separators stay;
* telephone numbers: over the ten digits, separators and country code stay;
* IPv4: 16 by 16 bits;
* dates from 1900-01-01 for 73,000 days: 250 by 292 days, printed in the
  format found; one that is only valid with the month first goes on to the
  next such date, so that it meets no date with the day first;
* e-mail: over the letters and digits of the local part, each within its class.

Round values are SHA-256 of key, kind, round and the other half. Who has the
key can undo the permutations: the query takes it from KEY_SETTING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import escaped, marked, pieces, unescaped

KINDS = ("card", "phone", "ip", "date", "email")
CARD = r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+1[ -.]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_OTHER = f"{EMAIL}|{PHONE}|{IP}|{DATE}"
_GROUP = f"(?!{_OTHER})[0-9]++(?![A-Za-z])"
#: Groups of digits up to the next other value; possessive, as a long run must not recurse.
RUN = f"(?<![0-9A-Za-z.])(?=[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?:[ -]{_GROUP})*+"
PATTERN = f"{_OTHER}|{RUN}"
#: Groupings cards are printed in, the longer first; none has over five groups.
GROUPED = (r"^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}(?![0-9])", r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{8}[ -][0-9]{8}|[0-9]{6}[ -][0-9]{13})(?![0-9])")
ROUNDS = 8
#: Session setting with the secret key; DEMO_KEY, which is public, only where it is unset.
KEY_SETTING, DEMO_KEY = "spark.voxelframe.pii.key", "voxelframe"
FIRST_DAY, DAYS = "1900-01-01", (250, 292)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _value(key: str, kind: str, turn: int, half: Column, modulus: int) -> Column:
    """A number below modulus that key, kind, round and half decide."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(modulus))


def _feistel_numbers(key: str, kind: str, left: Column, right: Column, sizes: tuple[int, int]) -> Column:
    """struct(l, r): a permutation of the pairs below sizes."""
    def round_(turn):
        if turn % 2 == 0:
            return lambda s: F.struct(F.pmod(s["l"] + _value(key, kind, turn, s["r"], sizes[0]), F.lit(sizes[0])).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _value(key, kind, turn, s["l"], sizes[1]), F.lit(sizes[1])).alias("r"))

    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for turn in range(ROUNDS):
        state = _bind(state, round_(turn))
    return state


def _bind(value: Column, body) -> Column:
    """body(value) with value worked out once, so that rounds don't double the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _shift(text: Column, key: str, kind: str, turn: int, other: Column) -> Column:
    """text with each digit and letter moved on within its class, as key, round and other decide."""

    def one(c, i, digest):
        move = F.conv(F.substring(F.sha2(F.concat(digest, i.cast("string")), 256), 1, 8), 16, 10).cast("long")
        return F.coalesce(
            *[F.when(F.contains(F.lit(a), c) & (F.length(c) == 1), F.substr(F.lit(a), (F.pmod(F.position(c, F.lit(a)) - 1 + move, F.lit(len(a))) + 1).cast("int"), F.lit(1))) for a in (_DIGITS, _LOWER, _UPPER)],
            c,
        )

    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), other), 256)
    return _bind(digest, lambda d: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, d)), ""))


def _feistel_text(text: Column, key: str, kind: str) -> Column:
    """A permutation of the texts of one length and character classes."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def round_(turn):
        if turn % 2 == 0:
            return lambda s: F.struct(_shift(s["l"], key, kind, turn, s["r"]).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), _shift(s["r"], key, kind, turn, s["l"]).alias("r"))

    for turn in range(ROUNDS):
        state = _bind(state, round_(turn))
    return _bind(state, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum over digits whose last one is the check digit."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("k"))
    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["out"])


def _card(match: Column, key: str) -> Column:
    def with_check(body):
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    def new(digits):
        body = F.substr(digits, F.lit(1), F.length(digits) - 1)
        return _bind(_feistel_text(body, key, "card"), with_check)

    return _bind(_bind(_digits(match), new), lambda d: _refill(match, d))


def _phone(match: Column, key: str) -> Column:
    head = F.when(F.startswith(match, F.lit("+1")), F.substr(match, F.lit(1), F.lit(2))).otherwise(F.lit(""))
    tail = F.substr(match, F.length(head) + 1, F.length(match))
    return _bind(tail, lambda t: F.concat(head, _bind(_feistel_text(_digits(t), key, "phone"), lambda d: _refill(t, d))))


def _ip(match: Column, key: str) -> Column:
    o = lambda k: F.split_part(match, F.lit("."), F.lit(k)).cast("long")
    mixed = _feistel_numbers(key, "ip", o(1) * 256 + o(2), o(3) * 256 + o(4), (65536, 65536))
    return _bind(mixed, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), F.pmod(s[h], F.lit(256)))]))


def _days(date: Column) -> Column:
    """Days since FIRST_DAY, or null outside of the range."""
    day = F.date_diff(date, F.lit(FIRST_DAY).cast("date"))
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), day)


def _date_value(match: Column) -> Column:
    """struct(day, month_first): days since FIRST_DAY or null; the month is first only where the day cannot be."""
    part = lambda k, n: F.substr(match, F.lit(k), F.lit(n)).cast("int")
    iso = F.substr(match, F.lit(5), F.lit(1)) == "-"
    month_first = ~iso & (part(4, 2) > 12)
    date = F.when(iso, _safe_date(part(1, 4), part(6, 2), part(9, 2))).when(month_first, _safe_date(part(7, 4), part(1, 2), part(4, 2))).otherwise(_safe_date(part(7, 4), part(4, 2), part(1, 2)))
    return F.struct(_days(date).alias("day"), month_first.alias("month_first"))


def _safe_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def _at_day(day: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))


def _date(match: Column, key: str) -> Column:
    def mixed(day):
        return _bind(_feistel_numbers(key, "date", F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), DAYS), lambda s: s["l"] * DAYS[1] + s["r"])

    def walked(day):
        # the cycle comes back to the date itself; a step stays at a day up to 12 in two of five cases
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), day, lambda acc, _: F.when(F.dayofmonth(_at_day(acc)) > 12, acc).otherwise(mixed(acc)))

    mark = F.substr(match, F.lit(3), F.lit(1))

    def printed(date, month_first):
        two = lambda form: F.date_format(date, form)
        return F.when(F.substr(match, F.lit(5), F.lit(1)) == "-", F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.when(month_first, two("MM")).otherwise(two("dd")), mark, F.when(month_first, two("dd")).otherwise(two("MM")), mark, F.date_format(date, "yyyy")))

    def new(value):
        return _bind(_bind(mixed(value["day"]), lambda d: F.when(value["month_first"], walked(d)).otherwise(d)), lambda d: printed(_at_day(d), value["month_first"]))

    return _bind(_date_value(match), new)


def _email(match: Column, key: str) -> Column:
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    return F.concat(_feistel_text(local, key, "email"), F.lit("@"), domain)


def _kind(match: Column) -> Column:
    """Number of the kind in KINDS, or null for a candidate that is not valid; runs of digits aside."""
    octets = F.forall(F.split(match, r"\."), lambda o: (o.cast("int") <= 255) & (~o.rlike("^0[0-9]")))
    whole = lambda p: match.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(match, F.lit("@")), 4)
        .when(whole(PHONE), 1)
        .when(whole(IP), F.when(octets, 2))
        .when(whole(DATE), F.when(_date_value(match)["day"].isNotNull(), 3))
    )


def _is_card(match: Column) -> Column:
    return F.pmod(_luhn_sum(_digits(match)), F.lit(10)) == 0


def _grouped(run: Column) -> Column:
    """run with the valid cards in a grouping of GROUPED between marks, leftmost first."""

    def size(window):
        return F.coalesce(*[_bind(F.regexp_extract(window, p, 0), lambda m: F.when((m != "") & _is_card(m), F.length(m))) for p in GROUPED], F.lit(0))

    def sized(groups):
        return F.transform(groups, lambda g, i: F.struct(g.alias("g"), _bind(F.array_join(F.slice(groups, i + 1, F.lit(5)), ""), size).alias("n")))

    def step(acc, s):
        left = F.when(acc["left"] > 0, acc["left"]).otherwise(s["n"])
        out = F.concat(acc["out"], F.when((acc["left"] == 0) & (s["n"] > 0), "\x01").otherwise(""))
        here = F.when((left > 0) & (F.length(s["g"]) >= left), F.concat(F.substr(s["g"], F.lit(1), left), F.lit("\x02"), F.substr(s["g"], left + 1, F.length(s["g"])))).otherwise(s["g"])
        return F.struct(F.greatest(left - F.length(s["g"]), F.lit(0)).alias("left"), F.concat(out, here).alias("out"))

    start = F.struct(F.lit(0).alias("left"), F.lit("").alias("out"))
    walk = lambda found: F.when(F.exists(found, lambda s: s["n"] > 0), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(run)
    return _bind(_bind(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), sized), walk)


def _of_run(run: Column) -> Column:
    """Array of (p, kind) for a run of digits: the grouped cards, and those of any grouping in what is left."""
    part = lambda p, kind: F.struct(p.alias("p"), kind.alias("kind"))
    rest = lambda text: F.transform(pieces(marked(text, CARD)), lambda q, j: part(q, F.when((j % 2 == 1) & _is_card(q), 0)))
    return F.flatten(F.transform(pieces(_grouped(run)), lambda p, i: F.when(i % 2 == 1, F.array(part(p, F.lit(0)))).otherwise(rest(p))))


def _parts(match: Column) -> Column:
    return F.when(match.rlike("^[0-9](?:[ -]?[0-9]){12}[0-9 -]*$"), _of_run(match)).otherwise(F.array(F.struct(match.alias("p"), _kind(match).alias("kind"))))


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_card, n_phone, n_ip, n_date, n_email, n_found) for every row of docs.

    text is the whole text with each valid value replaced and every other
    character kept; a null text stays null and has no values; an empty one
    stays empty. key: by default the session's KEY_SETTING. Each row stands
    alone, so repeated rows give equal results. Other columns are ignored.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEMO_KEY)
    rows = docs.select("doc_id", F.col(text_col).isNull().alias("none"), marked(escaped(F.col(text_col)), PATTERN).alias("marked"))
    replace = lambda p, kind: F.when(kind == 0, _card(p, key)).when(kind == 1, _phone(p, key)).when(kind == 2, _ip(p, key)).when(kind == 3, _date(p, key)).when(kind == 4, _email(p, key)).otherwise(p)
    kinds = F.flatten(F.transform(pieces(F.col("marked")), lambda p, i: F.when(i % 2 == 1, _parts(p)).otherwise(F.array(F.struct(p.alias("p"), F.lit(None).cast("int").alias("kind"))))))
    rows = rows.select("doc_id", "none", "marked", F.when(F.contains("marked", F.lit("\x01")), kinds).alias("parts"))
    text = F.when(F.col("parts").isNull(), F.col("marked")).otherwise(F.array_join(F.transform("parts", lambda s: F.when(s["kind"].isNull(), s["p"]).otherwise(replace(s["p"], s["kind"]))), ""))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.coalesce(F.size(F.filter("parts", of_kind(k))), F.lit(0)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    out = rows.select("doc_id", F.when(~F.col("none"), unescaped(text)).alias("text"), *counts)
    return out.withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")))
