"""Confidence from context: keywords near a span raise its score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import TEST_CARDS, brand_length, card_brand, runs
from .arrays import bind

BASE, BOOST, CAP, WINDOW = 0.5, 0.35, 0.95, 100
# Words that speak for a type, as they stand in lower-cased text.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "ssn": ("social security", "ssn", "ss#", "social security number", "tax id", "taxpayer", "itin", "individual taxpayer"),
    "credit_card": ("credit card", "card number", "card no", "card #", "cc#", "cc number", "debit card", "visa", "mastercard", "amex", "american express", "payment card", "pan"),
    "email": ("email", "e-mail", "mail", "email address", "contact", "send to", "reply to"),
    "phone": ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "phone number", "contact number"),
    "bank_account": ("bank account", "account number", "account no", "acct", "iban", "routing", "aba", "swift", "bic", "checking", "savings"),
    "driver_license": ("driver license", "driver's license", "driving license", "dl", "dl#", "license number", "licence"),
    "passport": ("passport", "passport number", "passport no", "travel document"),
    "birthdate": ("date of birth", "dob", "birth date", "birthday", "born", "birth"),
    "ip_address": ("ip address", "ip addr", "ip", "source ip", "destination ip", "client ip", "server ip", "remote addr", "host"),
    "api_key": (
        "api key", "api_key", "apikey", "api token", "api secret", "access key", "secret key", "auth token", "authorization", "apiキー", "認証", "トークン", "秘密鍵", "api密钥", "认证", "令牌", "密钥",
        "api密鑰", "認證", "密鑰", "api키", "인증", "토큰", "비밀키", "مفتاح api", "رمز", "مصادقة", "एपीआई कुंजी", "टोकन", "प्रमाणीकरण",
    ),
    "aws_access_key": ("aws", "aws_access_key", "aws_secret", "access key id", "secret access key", "iam", "amazon web services"),
    "name": ("name", "full name", "first name", "last name", "surname", "given name", "family name", "patient name", "customer name"),
    "routing_number": ("routing", "routing number", "aba", "transit number", "bank routing"),
    "named_location": (
        "live in", "lives in", "lived in", "from", "visiting", "visit to", "located in", "located at", "located near", "address", "addressed to", "near", "traveled to", "travelled to", "flew to",
        "flying to", "moving to", "moved to", "city of", "country of", "town of", "village of", "hometown", "birthplace", "born in", "residing in", "resides in", "based in", "headquartered in",
        "stationed in",
    ),
}
CARD_WORDS = "(?i)card|credit|debit|payment|visa|mastercard|amex|discover|jcb|diners|unionpay|maestro|verve|rupay"


def around(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The text within `window` characters of a span, lower case."""
    low = F.greatest(start - window, F.lit(0))
    return F.lower(F.substring(text, low + 1, end + window - low))


def has_keyword(text: Column, start: Column, end: Column, kind: str, window: int = WINDOW) -> Column:
    """Whether a keyword of the type occurs in the window around a span, as part of a word too."""
    out = F.lit(False)
    if not KEYWORDS.get(kind):
        return out

    def any_in(low: Column) -> Column:
        hit = out
        for w in KEYWORDS[kind]:
            hit = hit | low.contains(w)
        return hit

    return bind(around(text, start, end, window), any_in)


def score(text: Column, start: Column, end: Column, kind: str, base: float = BASE, boost: float = BOOST, cap: float = CAP, window: int = WINDOW) -> Column:
    """`base`, or base and boost (at most `cap`) with a keyword of the type nearby."""
    return F.when(has_keyword(text, start, end, kind, window), min(cap, base + boost)).otherwise(base)


def confidence(value: Column) -> Column:
    """Label of a score: high from 0.7, medium from 0.4, low from 0.2, else null."""
    return F.when(value >= 0.7, "high").when(value >= 0.4, "medium").when(value >= 0.2, "low")


def card_score(value: Column, context: Column) -> Column:
    """Evidence of a card, of 13 to 19 digits: shape +0.2, Luhn +0.3 or -0.5, a brand +0.2 and its length +0.1, a
    published test card -0.3, a keyword in `context` (text or null) +0.2, digits without long runs +0.1, else -0.2. Null for
    other values; `confidence` gives its label."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def total(d: Column) -> Column:
        brand = card_brand(d)
        return (
            F.lit(0.2) + F.when(F.call_function("luhn_check", d), 0.3).otherwise(-0.5) + F.when(brand.isNotNull(), 0.2).otherwise(0.0)
            + F.when(brand_length(d, brand), 0.1).otherwise(0.0) - F.when(d.isin(*TEST_CARDS), 0.3).otherwise(0.0)
            + F.when(context.rlike(CARD_WORDS), 0.2).otherwise(0.0) + F.when(runs(d), -0.2).otherwise(0.1)
        )

    return bind(digits, lambda d: F.when(F.length(d).between(13, 19), F.round(total(d), 6)))
