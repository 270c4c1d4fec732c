"""Format-preserving pseudonyms for personal data.

E-mail local parts, IPv4 addresses, dates, social security numbers, payment
card numbers and North American phone numbers are found by one pattern and
validated.  A keyed Feistel network permutes each within its own format: equal
values get equal pseudonyms in all documents, different values different ones,
and separators and check digits stay valid.  Everything is Catalyst
expressions; the round function is SHA-256 of key, kind, round and half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates of these days (from 1900-01-01; 250 x 292 of them) are permuted among themselves.
DAYS, DAYS_A, DAYS_B = 73_000, 250, 292
#: So are the dates before this one whose day is the 13th or later (28 x 1579 of them), where a slash date has the day first.
LATE_END, LATE_A, LATE_B = "2099-11-01", 28, 1579

_AFTER = r"(?![0-9A-Za-z])"
#: Local parts of at most 64 characters and domains of at most 127 labels, as mail allows; a repeated group without a bound would recurse in Java for each label.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
_IP = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})" + _AFTER
_SSN = r"\d{3}-\d{2}-\d{4}" + _AFTER
_CARD = r"\d(?:[ -]?\d){12,18}" + _AFTER
_PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}" + _AFTER
PATTERN = rf"{_EMAIL}|(?<![0-9A-Za-z])(?=[0-9+(])(?:{_IP}|{_DATE}|{_SSN}|{_CARD}|{_PHONE})"


def _feistel(value: str, a: str, b: str, kind: str) -> str:
    """A keyed permutation of the numbers below a * b."""

    def half(modulus: str, other: str) -> str:
        return f"cast(conv(substring(sha2(concat_ws('|', __q_key, '{kind}', i, {modulus}, {other}), 256), 1, 15), 16, 10) as bigint) % {modulus}"

    return f"""transform(array(named_struct('v', cast({value} as bigint), 'a', cast({a} as bigint), 'b', cast({b} as bigint))), f ->
        aggregate(sequence(1, {ROUNDS}), named_struct('x', f.v div f.b, 'y', f.v % f.b),
          (s, i) -> if(i % 2 = 1, named_struct('x', (s.x + {half('f.a', 's.y')}) % f.a, 'y', s.y),
                                  named_struct('x', s.x, 'y', (s.y + {half('f.b', 's.x')}) % f.b)),
          s -> s.x * f.b + s.y))[0]"""


def _refilled(match: str, digits: str) -> str:
    """`match` with its digits replaced, in order, by those of the string `digits`."""
    return f"""array_join(transform(sequence(1, length({match})), p -> if(substring({match}, p, 1) rlike '[0-9]',
        substring({digits}, length(regexp_replace(substring({match}, 1, p), '[^0-9]', '')), 1), substring({match}, p, 1))), '')"""


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _run(chars: str, radix: int, alphabet: str, kind: str) -> str:
    """A string over `alphabet`, permuted in pieces of at most 12 characters."""
    to_number = f"aggregate(sequence(1, length(c)), 0L, (n, k) -> n * {radix}L + instr('{alphabet}', substring(c, k, 1)) - 1)"
    power = f"aggregate(slice(sequence(0, 12), 1, {{n}}), 1L, (n, k) -> n * {radix}L)"
    number = _feistel(to_number, power.format(n="length(c) div 2"), power.format(n="length(c) - length(c) div 2"), kind)
    to_chars = f"array_join(transform(reverse(sequence(0, length(c) - 1)), k -> substring('{alphabet}', cast(n div {power.format(n='k')} % {radix} as int) + 1, 1)), '')".replace("(n, k) -> n *", "(m, j) -> m *")
    return f"""if({chars} = '', '', array_join(transform(sequence(0, (length({chars}) - 1) div 12), at ->
        {_let('c', f'substring({chars}, at * 12 + 1, 12)', _let('n', number, to_chars))}), ''))"""


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _email() -> str:
    local = "substring_index(m, '@', 1)"
    letters = _run("l.letters", 26, _LETTERS, "letters")
    digits = _run("l.digits", 10, "0123456789", "digits")
    char = """CASE WHEN substring(r.text, p, 1) rlike '[a-z]' THEN substring(r.letters, length(regexp_replace(lower(substring(r.text, 1, p)), '[^a-z]', '')), 1)
        WHEN substring(r.text, p, 1) rlike '[A-Z]' THEN upper(substring(r.letters, length(regexp_replace(lower(substring(r.text, 1, p)), '[^a-z]', '')), 1))
        WHEN substring(r.text, p, 1) rlike '[0-9]' THEN substring(r.digits, length(regexp_replace(substring(r.text, 1, p), '[^0-9]', '')), 1)
        ELSE substring(r.text, p, 1) END"""
    rebuilt = _let("r", f"named_struct('text', l.text, 'letters', {letters}, 'digits', {digits})", f"array_join(transform(sequence(1, length(r.text)), p -> {char}), '')")
    parts = f"named_struct('text', {local}, 'letters', regexp_replace(lower({local}), '[^a-z]', ''), 'digits', regexp_replace({local}, '[^0-9]', ''))"
    return f"concat({_let('l', parts, rebuilt)}, substring(m, instr(m, '@')))"


def _ip() -> str:
    octets = "transform(split(m, '[.]'), o -> cast(o as bigint))"
    value = "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]"
    back = "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)"
    return _let("o", octets, f"if(exists(o, x -> x > 255), m, {_let('v', _feistel(value, '65536', '65536', 'ip'), back)})")


_BASE = "date'1900-01-01'"


def _date() -> str:
    """Slash dates are month first where they can be, and in another space where only the day can come first: both stay what they are."""
    day = """CASE WHEN m like '____-%' THEN try_to_date(m, 'yyyy-MM-dd') WHEN m like '%/%' THEN try_to_date(m, 'M/d/yyyy') ELSE try_to_date(m, 'd.M.yyyy') END"""
    moved = f"date_format(date_add({_BASE}, cast({_feistel(f'datediff(d, {_BASE})', str(DAYS_A), str(DAYS_B), 'date')} as int)), f)"
    form = """CASE WHEN m like '____-%' THEN 'yyyy-MM-dd' WHEN m rlike '^[0-9]/|/[0-9]/' THEN 'M/d/yyyy' WHEN m like '%/%' THEN 'MM/dd/yyyy' WHEN m rlike '^[0-9][.]|[.][0-9][.]' THEN 'd.M.yyyy' ELSE 'dd.MM.yyyy' END"""
    any_day = f"if(d IS NULL OR d < {_BASE} OR datediff(d, {_BASE}) >= {DAYS}, m, {_let('f', form, moved)})"
    # Days from the 13th on are numbered: g(k) of them lie before the k-th month since 1900.
    g = lambda k: f"(datediff(add_months({_BASE}, {k}), {_BASE}) - 12 * {k})"
    number = f"datediff(d, {_BASE}) - 12 * (cast(months_between(trunc(d, 'MM'), {_BASE}) as int) + 1)"
    month = f"array_max(filter(sequence(cast(i / 18.437 as int) - 2, cast(i / 18.437 as int) + 2), k -> k >= 0 AND {g('k')} <= i))"
    back = _let("k", month, f"date_format(date_add(add_months({_BASE}, k), cast(12 + i - {g('k')} as int)), if(m rlike '/[0-9]/', 'd/M/yyyy', 'dd/MM/yyyy'))")
    late_day = f"if(d IS NULL OR d < {_BASE} OR d >= date'{LATE_END}', m, {_let('i', _feistel(number, str(LATE_A), str(LATE_B), 'late'), back)})"
    day_first = "m like '%/%' AND try_to_date(m, 'M/d/yyyy') IS NULL"
    return f"if({day_first}, {_let('d', 'try_to_date(m, ' + chr(39) + 'd/M/yyyy' + chr(39) + ')', late_day)}, {_let('d', day, any_day)})"


def _ssn() -> str:
    area, group, serial = "cast(substring(m, 1, 3) as int)", "cast(substring(m, 5, 2) as int)", "cast(substring(m, 8, 4) as int)"
    valid = f"{area} between 1 and 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    value = f"cast({area} - if({area} > 666, 2, 1) as bigint) * 989901 + ({group} - 1) * 9999 + {serial} - 1"
    back = "concat_ws('-', lpad(cast(v div 989901 + if(v div 989901 >= 665, 2, 1) as string), 3, '0'), lpad(cast(v % 989901 div 9999 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0'))"
    back = back.replace("v % 9999 + 1", "v % 989901 % 9999 + 1")
    return f"if({valid}, {_let('v', _feistel(value, '898', '989901', 'ssn'), back)}, m)"


def _card() -> str:
    power = "cast(pow(10, {n}) as bigint)"
    number = _feistel("substring(d, 1, length(d) - 1)", power.format(n="(length(d) - 1) div 2"), power.format(n="length(d) - 1 - (length(d) - 1) div 2"), "card")
    checked = "concat(w, filter(sequence(0, 9), c -> luhn_check(concat(w, c)))[0])"
    digits = _let("w", f"lpad(cast({number} as string), length(d) - 1, '0')", _let("z", checked, _refilled("m", "z")))
    return f"if(luhn_check(d), {digits}, m)"


def _phone() -> str:
    ten = "substring(d, length(d) - 9, 10)"
    value = f"((cast(substring({ten}, 1, 3) as bigint) - 200) * 800 + cast(substring({ten}, 4, 3) as bigint) - 200) * 10000 + cast(substring({ten}, 7, 4) as bigint)"
    back = "concat(substring(d, 1, length(d) - 10), cast(v div 8000000 + 200 as string), cast(v div 10000 % 800 + 200 as string), lpad(cast(v % 10000 as string), 4, '0'))"
    return _let("v", _feistel(value, "640000", "10000", "phone"), _let("z", back, _refilled("m", "z")))


def _pseudonym() -> str:
    """The pseudonym of a match m; m itself where it isn't valid."""
    cases = f"""CASE WHEN m like '%@%' THEN {_email()}
        WHEN m rlike r'^{_IP}$' THEN {_ip()}
        WHEN m rlike r'^{_DATE}$' THEN {_date()}
        WHEN m rlike r'^{_SSN}$' THEN {_ssn()}
        WHEN m rlike r'^{_PHONE}$' THEN {_let('d', "regexp_replace(m, '[^0-9]', '')", _phone())}
        ELSE {_let('d', "regexp_replace(m, '[^0-9]', '')", _card())} END"""
    return f"transform(__q_hits, m -> {cases})"


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with pseudonyms in `text`, and n_pii: how many values were replaced.

    Values that look like one of the kinds but aren't valid (a card number that
    fails its check digit, an octet over 255, a 31st of June) stay.  A null
    text stays null with n_pii 0.  Rows are independent, so repeated rows stay
    alike.  Columns named n_pii are replaced, others stay.  A date without
    leading zeros comes back without them, so it may become a digit longer or
    shorter; a slash date is month first unless only the day can be, and the
    same day written in that way has a pseudonym of its own.  Dates before 1900
    and from 13 November 2099 on (1 November, day first) stay.  An address whose local part has over 64
    characters is none; of one with over 127 labels the first 127 count.  The
    key is a literal of the plan: where plans are logged, name it in
    spark.sql.redaction.string.regex.
    """
    found = docs.withColumns({"__q_key": F.lit(key), "__q_hits": F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)))})
    found = found.withColumn("__q_new", F.when(F.size("__q_hits") > 0, F.expr(_pseudonym())))
    parts = F.split(F.col(text), PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(parts, "__q_new", lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("__q_hits", "__q_new", lambda a, b: a != b), lambda x: x))
    found = found.withColumns({"n_pii": F.when(F.col("__q_new").isNull(), 0).otherwise(changed).cast("long"), "__q_text": F.when(F.col("__q_new").isNull(), F.col(text)).otherwise(rebuilt)})
    return found.withColumn(text, F.col("__q_text")).drop("__q_key", "__q_hits", "__q_new", "__q_text")
