"""Checksum validators as Column expressions over fixed digit positions.

Each validator cleans its input of separators, tests the shape, and computes the check in plain
arithmetic, so that it stays inside generated code. Null input gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def compact(value: Column, drop: str = r"[\s.\-/]") -> Column:
    """Upper case without separators."""
    return F.upper(F.regexp_replace(value, drop, ""))


def at(value: Column, i: int, alphabet: str = DIGITS) -> Column:
    """Position of the i-th character (from 0) in `alphabet`; -1 if it is none of it."""
    c = F.substring(value, i + 1, 1)
    return F.ascii(c) - ord("0") if alphabet == DIGITS else F.instr(F.lit(alphabet), c) - 1


def weighted(value: Column, weights: Sequence[int], alphabet: str = DIGITS) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + at(value, i, alphabet) * w
    return total


def _shaped(value: Column, pattern: str, good: Callable[[Column], Column], drop: str = r"[\s.\-/]") -> Column:
    check = lambda v: F.when(v.rlike(f"^(?:{pattern})$"), good(v)).otherwise(False)
    once = F.get(F.transform(F.array(compact(value, drop)), check), F.lit(0))  # cleaned once, whatever the terms
    return F.when(value.isNotNull(), once)


def luhn(value: Column, low: int = 2, high: int = 32) -> Column:
    return _shaped(value, rf"[0-9]{{{low},{high}}}", lambda v: F.call_function("luhn_check", v))


def card(value: Column) -> Column:
    """13 to 19 digits with a Luhn check, other than repeats of one digit."""
    return _shaped(value, "[0-9]{13,19}", lambda v: F.call_function("luhn_check", v) & ~v.rlike("^(.)\\1*$"))


# Brands by what a number begins with (a range of prefixes of equal length), and lengths. First match decides.
BRANDS: tuple[tuple[str, tuple[tuple[int, int], ...], tuple[int, ...]], ...] = (
    ("visa", ((4, 4),), (13, 16, 19)),
    ("mastercard", ((51, 55), (2221, 2720)), (16,)),
    ("amex", ((34, 34), (37, 37)), (15,)),
    ("discover", ((6011, 6011), (644, 649), (65, 65)), (16,)),
    ("diners", ((300, 305), (36, 36), (38, 38)), (14,)),
    ("jcb", ((3528, 3589),), (16,)),
    ("verve", ((506099, 506198), (650002, 650027)), (16, 17, 18, 19)),
    ("unionpay", ((62, 62),), (16, 17, 18, 19)),
    ("maestro", ((5018, 5018), (5020, 5020), (5038, 5038), (5893, 5893), (6304, 6304), (6759, 6759), (6761, 6763)), (12, 13, 14, 15, 16, 17, 18, 19)),
    ("rupay", ((60, 60), (82, 82), (508, 508)), (16,)),
)
TEST_CARDS = ("4111111111111111", "5555555555554444", "340000000000009", "6011000000000004", "4242424242424242", "4000000000000002")


def card_brand(value: Column) -> Column:
    """The first brand, in order, one of whose prefixes the digits begin with; null if none or below six digits."""
    v = compact(value)
    out = F.lit(None).cast("string")
    for name, ranges, _ in reversed(BRANDS):
        begins = F.lit(False)
        for low, high in ranges:
            begins = begins | F.substring(v, 1, len(str(low))).between(str(low), str(high))
        out = F.when(begins, name).otherwise(out)
    return F.when(v.rlike("^[0-9]{6,}$"), out)


def brand_length(digits: Column, brand: Column) -> Column:
    """Whether a number has a length of its brand."""
    out = F.lit(False)
    for name, _, lengths in BRANDS:
        out = out | ((brand == name) & F.length(digits).isin(*lengths))
    return F.coalesce(out, F.lit(False))


def runs(digits: Column) -> Column:
    """Whether five digits in a row each equal the one before or follow it by one."""
    steps = F.transform(F.sequence(F.lit(2), F.greatest(F.length(digits), F.lit(2))), lambda i: (F.ascii(F.substring(digits, i, F.lit(1))) - F.ascii(F.substring(digits, i - 1, F.lit(1)))).isin(0, 1).cast("int").cast("string"))
    return F.array_join(steps, "").contains("11111")


def aba(value: Column) -> Column:
    """Routing number: 3-7-1 weights, and a first pair of a reserve district, thrift or electronic range."""
    pair = lambda v: F.substring(v, 1, 2).cast("int")
    in_range = lambda p: p.between(0, 12) | p.between(21, 32) | p.between(61, 72) | (p == 80)
    return _shaped(value, "[0-9]{9}", lambda v: (weighted(v, (3, 7, 1) * 3) % 10 == 0) & in_range(pair(v)) & (v != "000000000"))


# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}


def mod97(value: Column) -> Column:
    """Remainder of the rearranged account number, letters as 10 to 35, digit by digit."""
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def iban(value: Column) -> Column:
    lengths = F.create_map(*[x for k, n in IBAN_LENGTHS.items() for x in (F.lit(k), F.lit(n))])
    return _shaped(value, "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", lambda v: F.coalesce(F.length(v) == F.element_at(lengths, F.substring(v, 1, 2)), F.lit(False)) & (mod97(v) == 1))


def ssn(value: Column) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000, and none of the published samples."""
    part = lambda v, i, n: F.substring(v, i, n)
    return _shaped(value, "[0-9]{9}", lambda v: ~part(v, 1, 3).isin("000", "666") & ~v.startswith("9") & (part(v, 4, 2) != "00") & (part(v, 6, 4) != "0000") & ~v.isin("123456789", "078051120", "219099999"))


def itin(value: Column) -> Column:
    return _shaped(value, "9[0-9]{2}(?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[02]|9[4-9])[0-9]{4}", lambda v: F.lit(True))


def ein(value: Column) -> Column:
    """By its prefix: all but those that no office gives out."""
    return _shaped(value, "(?:0[1-6]|1[0-6]|2[0-7]|3[0-9]|4[0-8]|5[0-9]|6[0-8]|7[0-9]|8[0-8]|9[0-9])[0-9]{7}", lambda v: F.lit(True))


def npi(value: Column) -> Column:
    return _shaped(value, "[12][0-9]{9}", lambda v: F.call_function("luhn_check", F.concat(F.lit("80840"), v)))


def dea(value: Column) -> Column:
    return _shaped(value, "[A-Z]{2}[0-9]{7}", lambda v: weighted(v, (0, 0, 1, 2, 1, 2, 1, 2)) % 10 == at(v, 8))


VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_FROM, VIN_TO = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"


def vin(value: Column) -> Column:
    check = lambda v: weighted(F.translate(v, VIN_FROM, VIN_TO), VIN_WEIGHTS) % 11
    return _shaped(value, "[A-HJ-NPR-Z0-9]{17}", lambda v: F.substring(v, 9, 1) == F.when(check(v) == 10, "X").otherwise(check(v).cast("string")))


def verhoeff(value: Column) -> Column:
    """Remainder 0 in the dihedral group of order ten: tables are made from its rules."""
    d = [[(a + b) % 5 if a < 5 and b < 5 else (a + b) % 5 + 5 if a < 5 else (a - b) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([turn[x] for x in powers[-1]])
    times, moved = F.array(*[F.lit(x) for row in d for x in row]), F.array(*[F.lit(x) for row in powers for x in row])
    digits = F.transform(F.split(F.reverse(value), ""), lambda c, i: F.struct((F.ascii(c) - 48).alias("d"), (i % 8).alias("p")))
    step = lambda acc, x: F.get(times, acc * 10 + F.get(moved, x["p"] * 10 + x["d"]))
    return F.aggregate(digits, F.lit(0), step) == 0


def aadhaar(value: Column) -> Column:
    return _shaped(value, "[2-9][0-9]{11}", verhoeff)


def pan_india(value: Column) -> Column:
    return _shaped(value, "[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", lambda v: F.lit(True))


def gstin(value: Column) -> Column:
    def check(v: Column) -> Column:
        total = F.lit(0)
        for i in range(14):
            p = at(v, i, BASE36) * (1 + i % 2)
            total = total + F.floor(p / 36).cast("int") + p % 36
        return (36 - total % 36) % 36 == at(v, 14, BASE36)

    return _shaped(value, "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", check)


def tfn(value: Column) -> Column:
    return _shaped(value, "[0-9]{9}", lambda v: weighted(v, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0)


def abn(value: Column) -> Column:
    return _shaped(value, "[0-9]{11}", lambda v: (weighted(v, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)) - 10) % 89 == 0)


def medicare(value: Column) -> Column:
    return _shaped(value, "[2-6][0-9]{9,10}", lambda v: weighted(v, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == at(v, 8))


def acn(value: Column) -> Column:
    return _shaped(value, "[0-9]{9}", lambda v: (10 - weighted(v, (8, 7, 6, 5, 4, 3, 2, 1)) % 10) % 10 == at(v, 8))


def _two_elevens(v: Column, first: Sequence[int], second: Sequence[int]) -> Column:
    n = len(first)
    digit = lambda w: F.when(weighted(v, w) % 11 < 2, 0).otherwise(11 - weighted(v, w) % 11)
    return (digit(first) == at(v, n)) & (digit(second) == at(v, n + 1)) & ~v.rlike("^(.)\\1*$")


def cpf(value: Column) -> Column:
    return _shaped(value, "[0-9]{11}", lambda v: _two_elevens(v, range(10, 1, -1), range(11, 1, -1)))


def cnpj(value: Column) -> Column:
    return _shaped(value, "[0-9]{14}", lambda v: _two_elevens(v, (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)))


KOREA = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def rrn(value: Column) -> Column:
    return _shaped(value, "[0-9]{6}[1-4][0-9]{6}", lambda v: (11 - weighted(v, KOREA) % 11) % 10 == at(v, 12))


def frn(value: Column) -> Column:
    return _shaped(value, "[0-9]{6}[5-8][0-9]{6}", lambda v: (13 - weighted(v, KOREA) % 11) % 10 == at(v, 12))


def brn(value: Column) -> Column:
    return _shaped(value, "[0-9]{10}", lambda v: (10 - (weighted(v, (1, 3, 7, 1, 3, 7, 1, 3, 5)) + F.floor(at(v, 8) * 5 / 10).cast("int")) % 10) % 10 == at(v, 9))


CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"


def curp(value: Column) -> Column:
    return _shaped(value, "[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]", lambda v: (10 - weighted(v, range(18, 1, -1), CURP_ALPHABET) % 10) % 10 == at(v, 17))


def pesel(value: Column) -> Column:
    return _shaped(value, "[0-9]{11}", lambda v: (10 - weighted(v, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == at(v, 10))


HETU_LETTERS = "0123456789ABCDEFHJKLMNPRSTUVWXY"


def hetu(value: Column) -> Column:
    number = lambda v: F.concat(F.substring(v, 1, 6), F.substring(v, 8, 3)).cast("long")
    good = lambda v: F.substring(F.lit(HETU_LETTERS), (number(v) % 31 + 1).cast("int"), F.lit(1)) == F.substring(v, 11, 1)
    return _shaped(value, "[0-9]{6}[-+A][0-9]{3}[0-9A-Y]", good, drop=r"\s")


def tnin(value: Column) -> Column:
    return _shaped(value, "[0-9]{13}", lambda v: (11 - weighted(v, range(13, 1, -1)) % 11) % 10 == at(v, 12))


def tckn(value: Column) -> Column:
    odd, even, ten = (1, 0) * 4 + (1,), (0, 1) * 4 + (0,), (1,) * 10
    return _shaped(value, "[1-9][0-9]{10}", lambda v: (F.pmod(weighted(v, odd) * 7 - weighted(v, even), F.lit(10)) == at(v, 9)) & (weighted(v, ten) % 10 == at(v, 10)))


NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _nif_letter(number: Column) -> Column:
    return F.substring(F.lit(NIF_LETTERS), (number.cast("int") % 23 + 1).cast("int"), F.lit(1))


def nif(value: Column) -> Column:
    return _shaped(value, "[0-9]{8}[A-Z]", lambda v: _nif_letter(F.substring(v, 1, 8)) == F.substring(v, 9, 1))


def nie(value: Column) -> Column:
    return _shaped(value, "[XYZ][0-9]{7}[A-Z]", lambda v: _nif_letter(F.translate(F.substring(v, 1, 8), "XYZ", "012")) == F.substring(v, 9, 1))


#: Odd positions of the Italian fiscal code, for 0-9 and A-Z (digits count as A-J).
ITALY_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def fiscal_code(value: Column) -> Column:
    odd = F.array(*[F.lit(x) for x in ITALY_ODD])

    def good(v: Column) -> Column:
        total = F.lit(0)
        for i in range(15):
            c = at(v, i, BASE36)
            place = F.when(c >= 10, c - 10).otherwise(c)
            total = total + (place if i % 2 else F.get(odd, place))
        return total % 26 + 10 == at(v, 15, BASE36)

    return _shaped(value, "[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]", good)


def vat_italy(value: Column) -> Column:
    return _shaped(value, "[0-9]{11}", lambda v: F.call_function("luhn_check", v))


def nric(value: Column) -> Column:
    def good(v: Column) -> Column:
        first = F.substring(v, 1, 1)
        total = weighted(v, (0, 2, 7, 6, 5, 4, 3, 2)) + F.when(first.isin("T", "G"), 4).when(first == "M", 3).otherwise(0)
        letters = F.when(first.isin("S", "T"), "JZIHGFEDCBA").when(first == "M", "KLJNPQRTUWX").otherwise("XWUTRQPNMLK")
        place = F.when(first == "M", 10 - total % 11).otherwise(total % 11)
        return F.substring(letters, (place + 1).cast("int"), F.lit(1)) == F.substring(v, 9, 1)

    return _shaped(value, "[STFGM][0-9]{7}[A-Z]", good)


def nhs(value: Column) -> Column:
    rest = lambda v: (11 - weighted(v, range(10, 1, -1)) % 11) % 11
    return _shaped(value, "[0-9]{10}", lambda v: (rest(v) != 10) & (rest(v) == at(v, 9)))


def personnummer(value: Column) -> Column:
    return _shaped(value, "[0-9]{10}|[0-9]{12}", lambda v: F.call_function("luhn_check", F.right(v, F.lit(10))), drop=r"[\s+\-]")


def sin_canada(value: Column) -> Column:
    return _shaped(value, "[1-79][0-9]{8}", lambda v: F.call_function("luhn_check", v))


LICENSES = {"CA": "[A-Z][0-9]{7}", "FL": "[A-Z][0-9]{12}", "NE": "[A-Z][0-9]{6,8}", "WA": "[A-Z*]{5}[A-Z0-9*]{7}"}


def driver_license(value: Column, state: Column) -> Column:
    """By the state's format; null for states without one."""
    out = F.lit(None).cast("boolean")
    for code, pattern in LICENSES.items():
        out = F.when(state == code, compact(value).rlike(f"^{pattern}$")).otherwise(out)
    return out


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn, "card": card, "aba": aba, "iban": iban, "ssn": ssn, "itin": itin, "ein": ein, "npi": npi, "dea": dea, "vin": vin, "aadhaar": aadhaar,
    "pan_india": pan_india, "gstin": gstin, "tfn": tfn, "abn": abn, "medicare": medicare, "acn": acn, "cpf": cpf, "cnpj": cnpj, "rrn": rrn, "frn": frn,
    "brn": brn, "curp": curp, "pesel": pesel, "hetu": hetu, "tnin": tnin, "tckn": tckn, "nif": nif, "nie": nie, "fiscal_code": fiscal_code,
    "vat_italy": vat_italy, "nric": nric, "nhs": nhs, "personnummer": personnummer, "sin_canada": sin_canada,
}
