"""Format-preserving pseudonyms: validated numbers and dates permuted within their format by a keyed Feistel network.

Built-in SQL functions only: every step below is an expression of the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import free_name, table

ROUNDS = 8
#: Days of the 400 years from 1800-01-01; as 27 x 5411 it needs no walking of cycles.
FIRST_DAY, DAYS, DAY_LEFT, DAY_RIGHT = "1800-01-01", 146_097, 27, 5411
KINDS = ("email", "secret", "ip", "ssn", "phone", "date", "card")

# The kinds' shapes.  What stands next to a match must not belong to it.  The matcher recurses once a label of a domain, which uses up
# a task's stack on long ones, so what has more labels than the name system allows, 127, is looked for by its letters alone.
_SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?!(?:[A-Za-z0-9-]++\.){128})(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}"
    r"|(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=(?:[A-Za-z0-9-]++\.){128})[A-Za-z0-9.-]++",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<![\p{L}\d(-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d|[./-]\d)",
    "card": r"(?<![\p{L}\p{N}.])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?![\p{L}\p{N}])",
}
SHAPE = "|".join(_SHAPES[k] for k in ("email", "secret", "ip", "phone", "ssn", "date", "card"))
#: What every match holds; an address needs no digit, nor does a secret.
MAYBE = "[0-9@]|[a-fA-F]{32}"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(key: str, kind: str, size: str, i: str, x: str) -> str:
    """60 keyed bits of one half, for round i."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {size}, {i}, {x}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, size: str, left: str, right: str, left_mod: str, right_mod: str) -> str:
    """SQL of a struct (a, b): the pair (left, right) permuted within Z_left_mod x Z_right_mod.

    Even rounds add a keyed function of the right half to the left one, odd rounds the reverse, so each is undone by a
    subtraction and the whole is a permutation, whatever the two moduli are.
    """
    even = f"named_struct('a', pmod(s.a + {_round(key, kind, size, 'i', 's.b')}, {left_mod}), 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', pmod(s.b + {_round(key, kind, size, 'i', 's.a')}, {right_mod}))"
    start = f"named_struct('a', cast({left} as bigint), 'b', cast({right} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def _digits_permuted(key: str, kind: str, d: str) -> str:
    """SQL: the digit string d permuted among the digit strings of its length (two digits at least)."""
    n, half = f"length({d})", f"length({d}) div 2"
    ten = lambda k: f"cast(pow(10, {k}) as bigint)"
    pair = feistel(key, kind, n, f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", ten(half), ten(f"{n} - {half}"))
    return f"transform(array({pair}), p -> concat(lpad(cast(p.a as string), {half}, '0'), lpad(cast(p.b as string), {n} - {half}, '0')))[0]"


def _luhn_sum(d: str, odd: str) -> str:
    """SQL: Luhn's sum of digit string d, doubling the digits whose distance from the right end has this parity."""
    digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + if(i % 2 = {odd}, {digit} * 2 - if({digit} > 4, 9, 0), {digit}))"


def _laid_out(h: str, d: str) -> str:
    """SQL: h with its digits replaced, in order, by those of d."""
    at = f"length(regexp_replace(substr({h}, 1, i), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({h})), i -> if(substr({h}, i, 1) between '0' and '9', substr({d}, {at}, 1), substr({h}, i, 1))), '')"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym(key: str) -> str:
    """SQL of a struct (kind, out) for the matched text h: kind is null and out is h if h isn't valid."""
    digits = "regexp_replace(h, '[^0-9]', '')"
    made = lambda kind, out: f"named_struct('kind', '{kind}', 'out', {out})"
    kept = "named_struct('kind', cast(null as string), 'out', h)"
    letters = f"translate(sha2(concat_ws('|', {key}, 'email', lower(h)), 256), '0123456789', 'ghijklmnop')"
    email = f"concat(rpad(substr({letters}, 1, length(substring_index(h, '@', 1))), length(substring_index(h, '@', 1)), {letters}), '@', substring_index(h, '@', -1))"
    secret = f"substr(sha2(concat_ws('|', {key}, 'secret', lower(h)), 256), 1, length(h))"
    octets = "transform(split(h, '[.]'), x -> cast(x as int))"
    ip_valid = f"forall({octets}, x -> x <= 255)"
    ip_pair = feistel(key, "ip", "4", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536")
    ip = _let(octets, "o", _let(ip_pair, "p", "concat_ws('.', p.a div 256, p.a % 256, p.b div 256, p.b % 256)"))
    ssn_valid = f"substr({digits}, 1, 3) not in ('000', '666') and substr({digits}, 1, 1) <> '9' and substr({digits}, 4, 2) <> '00' and substr({digits}, 6) <> '0000'"
    # areas 001-899 without 666, groups 01-99, serials 0001-9999, each by its rank: 898 x 99 and 9999 values
    ssn_left = "(cast(substr(d, 1, 3) as int) - if(substr(d, 1, 3) > '666', 2, 1)) * 99 + cast(substr(d, 4, 2) as int) - 1"
    ssn_pair = feistel(key, "ssn", "9", ssn_left, "cast(substr(d, 6) as int) - 1", "898 * 99", "9999")
    ssn = _let(digits, "d", _let(ssn_pair, "p", "concat_ws('-', lpad(p.a div 99 + if(p.a div 99 >= 665, 2, 1), 3, '0'), lpad(p.a % 99 + 1, 2, '0'), lpad(p.b + 1, 4, '0'))"))
    phone = _let(digits, "d", _laid_out("h", f"concat(substr(d, 1, length(d) - 10), {_digits_permuted(key, 'phone', 'right(d, 10)')})"))
    card_valid = f"{_let(digits, 'd', _luhn_sum('d', '1'))} % 10 = 0"
    payload = _digits_permuted(key, "card", "substr(d, 1, length(d) - 1)")
    card = _let(digits, "d", _let(payload, "q", _laid_out("h", f"concat(q, cast(pmod(-{_luhn_sum('q', '0')}, 10) as string))")))
    pattern = "case when h like '____-%' then 'yyyy-MM-dd' when h like '__/%' then 'MM/dd/yyyy' else 'dd.MM.yyyy' end"
    day = f"datediff(cast(coalesce(try_to_timestamp(h, 'yyyy-MM-dd'), try_to_timestamp(h, 'MM/dd/yyyy'), try_to_timestamp(h, 'dd.MM.yyyy')) as date), date'{FIRST_DAY}')"
    day_pair = feistel(key, "date", "0", f"n div {DAY_RIGHT}", f"n % {DAY_RIGHT}", str(DAY_LEFT), str(DAY_RIGHT))
    date = _let(day, "n", f"if(n between 0 and {DAYS - 1}, {made('date', _let(day_pair, 'p', f"date_format(date_add(date'{FIRST_DAY}', cast(p.a * {DAY_RIGHT} + p.b as int)), {pattern})"))}, {kept})")
    n = f"length({digits})"
    return (
        f"case when h like '%@%' then {made('email', email)}"
        f" when length(h) >= 32 then {made('secret', secret)}"
        f" when h rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if({ip_valid}, {made('ip', ip)}, {kept})"
        f" when h rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({ssn_valid}, {made('ssn', ssn)}, {kept})"
        f" when length(h) = 10 and {n} = 8 then {date}"
        f" when {n} >= 13 and left(h, 1) <> '+' then if({card_valid}, {made('card', card)}, {kept})"
        f" when {n} between 10 and 13 then {made('phone', phone)}"
        f" else {kept} end"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: str = "found") -> DataFrame:
    """docs with the text's private values replaced, and a column <counts>: the kinds of what was replaced, in order.

    Permuted within their format: card numbers whose check digit holds (the new one's holds too), IPv4 addresses,
    +country and national phone numbers (the country stays), US social security numbers, and dates from 1800 to 2199 as
    yyyy-MM-dd, MM/dd/yyyy or dd.MM.yyyy.  Equal values get equal pseudonyms in all documents, different values different
    ones.  Numbers that don't validate stay, as do dates that the calendar lacks.  E-mail names and long hexadecimal secrets,
    which are no numbers, become keyed digests of the same length: equal ones stay equal, but names of a few letters may
    meet, and a domain stays readable, however many labels it has.  A secret has 32 to 64 digits; longer runs, as of dumps, stay.
    Null and empty texts stay as they are; rows that repeat are treated alike; an empty table gives an empty one.  If docs has a column <counts>, underscores go in front of the new one's.

    All is done within the scan's stage: no shuffle, no join.
    """
    text = f"cast(`{text_col}` as string)"
    k = _text(key)
    gaps, hits, counts = free_name(docs, "gaps"), free_name(docs, "hits"), free_name(docs, counts)
    shape = _text(SHAPE)
    touched = f"{text} rlike '{MAYBE}'"
    out = docs.withColumns(
        {
            hits: F.expr(f"if({touched}, transform(regexp_extract_all({text}, {shape}, 0), h -> {pseudonym(k)}), cast(array() as array<struct<kind:string,out:string>>))"),
            gaps: F.expr(f"if({touched}, split({text}, {shape}, -1), array({text}))"),
        }
    )
    joined = f"if(size({hits}) = 0, {text}, array_join(zip_with({gaps}, {hits}, (g, h) -> concat(g, coalesce(h.out, ''))), ''))"
    return out.withColumns({text_col: F.expr(joined), counts: F.expr(f"transform(filter({hits}, h -> h.kind is not null), h -> h.kind)")}).drop(gaps, hits)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "op4")
    return out.select("doc_id", "text", *[F.expr(f"size(filter(found, x -> x = '{kind}'))").alias(f"n_{kind}") for kind in KINDS])
