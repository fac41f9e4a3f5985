"""Text to values: numbers, percentages, labels, ratings, currencies, symbols, markup."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = {"t": 1e12, "b": 1e9, "m": 1e6, "k": 1e3}
RATINGS = ("buy", "overweight", "hold", "underweight", "sell")
#: White space of any kind, no-break blanks included.
SPACES = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Names that stand for characters without a final semicolon, longest first: a name may begin another.
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Exchange suffixes with their market prefix and the width numeric codes are padded to.
MARKETS = {".HK": ("HK.", 5), ".T": ("JP.", 0), ".SS": ("SH.", 0), ".SZ": ("SZ.", 0), ".AX": ("AU.", 0), ".TO": ("CA.", 0), ".SI": ("SG.", 0), ".KL": ("MY.", 0)}
#: Suffixes of exchanges without a market prefix.
UNCOVERED = (".L", ".NS", ".BO")
#: Coins and currencies that make pairs.
CRYPTO = ("BTC", "ETH", "SOL", "XRP", "ADA", "DOGE", "LTC", "BCH", "DOT", "AVAX", "LINK")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD")


def norm(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def first_number(c: Column) -> Column:
    """The first number of a formatted value: a sign in front, thousands commas, an exponent, and a final
    K, M, B or T; null without digits."""
    text = F.trim(c)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(text, r"^[-+]+", "")
    last = F.lower(F.right(body, F.lit(1)))
    scale = F.lit(1.0)
    for letter, value in SUFFIX.items():
        scale = F.when(last == letter, value).otherwise(scale)
    body = F.when(last.isin(*SUFFIX), F.regexp_replace(body, r".$", "")).otherwise(body)
    digits = F.replace(F.regexp_extract(body, r"[-+]?[0-9][0-9,]*(\.[0-9]+)?([eE][-+]?[0-9]+)?", 0), F.lit(","), F.lit(""))
    return sign * scale * digits.try_cast("double")


def percent_fraction(c: Column) -> Column:
    """'12.3%' as 0.123; '--', 'n/a' and what is no number as null."""
    raw = F.regexp_replace(F.trim(c), "%+$", "")
    return F.when(raw.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"), raw.try_cast("double")) / 100.0


def currency(c: Column) -> Column:
    """The statement currency that a payload names, in upper case; empty where none."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"(?i)currency:\s*([A-Za-z]{3})", r"(?i)Financial\s+Currency:\s*([A-Za-z]{3})", r"(?i)\"reportedCurrency\"\s*:\s*\"([A-Za-z]{3})\"")]
    return F.upper(F.coalesce(*found, F.lit("")))


def rating(c: Column, default: str = "Hold") -> Column:
    """A five-tier rating from prose: the first line with a "rating: X" label, else the first rating word."""
    text = F.coalesce(c, F.lit(""))
    words = "|".join(RATINGS)
    labels = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.regexp_extract(line, r"(?i)rating.*?[:\-][\s*]*(\w+)", 1))
    label = F.try_element_at(F.filter(labels, lambda w: F.lower(w).isin(*RATINGS)), F.lit(1))
    word = F.try_element_at(F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[*:.,]+|[*:.,]+$", "")), lambda w: w.isin(*RATINGS)), F.lit(1))
    few = F.when(F.regexp_like(text, F.lit(f"(?i){words}")), F.coalesce(F.initcap(label), F.initcap(word)))
    return F.coalesce(few, F.lit(default))


def strip_html(c: Column) -> Column:
    """Visible text: what stands between feed markers if there are any, tags as blanks, entities as
    characters, white space collapsed."""
    text = F.coalesce(c, F.lit(""))
    has = text.contains("<!-- SC_OFF -->") & text.contains("<!-- SC_ON -->")
    inner = F.split_part(F.split_part(text, F.lit("<!-- SC_OFF -->"), F.lit(2)), F.lit("<!-- SC_ON -->"), F.lit(1))
    text = F.regexp_replace(F.when(has, inner).otherwise(text), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape_html(text), SPACES, " "))


def _character(code: Column) -> Column:
    """The character that a numeric reference means: code points of the old Windows page as that page has them,
    those that are no characters as U+FFFD, controls as nothing."""
    page = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    old = F.element_at(F.array(*(F.lit(page[n]) for n in range(0x80, 0xA0))), (code - 0x7F).cast("int"))
    out = F.when(code.between(0x80, 0x9F), old).when(code == 0, "\ufffd").when(code == 13, "\r")
    return out.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(control, "").otherwise(plain)


def unescape_html(c: Column) -> Column:
    """Every HTML5 character reference as its character, once: names with or without a semicolon, decimal and
    hexadecimal numbers. What is none stays as it stands."""
    table = lambda held: F.map_from_arrays(F.array(*map(F.lit, held)), F.array(*map(F.lit, held.values())))
    groups: dict[str, dict[str, str]] = {}  # by two letters: maps are searched from their start
    for known, char in html5.items():
        if known.endswith(";"):
            groups.setdefault(known[:2], {})[known] = char
    names = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*map(table, groups.values())))
    bare = table({n: html5[n] for n in BARE_NAMES})
    number = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"

    def read(part: Column) -> Column:
        digits, hexes = F.regexp_extract(part, "^#([0-9]+)", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+)", 1)
        code = F.when(digits != "", F.coalesce(digits.try_cast("long"), F.lit(0x110000))).otherwise(F.when(F.length(F.ltrim(hexes, F.lit("0"))) > 8, 0x110000).otherwise(F.conv(hexes, 16, 10).try_cast("long")))
        code = F.when(code > 0x10FFFF, 0x110000).otherwise(code)
        name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        start = F.regexp_extract(name, "^(?:" + "|".join(BARE_NAMES) + ")", 0)
        found = F.when(name.endswith(";"), F.try_element_at(F.try_element_at(names, F.left(name, F.lit(2))), name))
        short = F.try_element_at(bare, start)
        rest = lambda said: F.substring(part, F.length(said) + 1, 2**30)
        out = F.when(part.rlike(number), F.concat(_character(code), rest(F.regexp_extract(part, number, 0))))
        out = out.when(found.isNotNull(), F.concat(found, rest(name))).when(start != "", F.concat(short, rest(start)))
        return out.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    return F.when(c.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 2**30), read), ""))).otherwise(c)


def json_list(c: Column) -> Column:
    """A JSON array of strings kept in a string; null where it is none."""
    return F.from_json(c, "array<string>")


def crypto_base(symbol: Column) -> Column:
    """BTC of BTC-USD, BTCUSDT and the like; null for other symbols."""
    compact = F.replace(F.rtrim(F.upper(F.trim(symbol)), F.lit("+")), F.lit("-"), F.lit(""))
    base = F.regexp_extract(compact, r"^(.*?)(?:USDT|USDC|USD)$", 1)
    return F.when(base.isin(*CRYPTO), base)


def normalize_symbol(symbol: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias, then crypto pair, then currency pair (=X), else the upper-cased symbol without trailing plus signs."""
    s = F.regexp_replace(F.upper(F.trim(symbol)), r"\++$", "")
    pair = (F.length(s) == 6) & F.substring(s, 1, 3).isin(*CURRENCIES) & F.substring(s, 4, 3).isin(*CURRENCIES)
    named = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[s] if aliases else F.lit(None).cast("string")
    return F.when(F.trim(symbol) == "", symbol).otherwise(F.coalesce(named, F.concat(crypto_base(s), F.lit("-USD")), F.when(pair, F.concat(s, F.lit("=X"))), s))


def market_code(symbol: Column) -> Column:
    """Market-prefixed code of a symbol with an exchange suffix (US without one); null for indices and for
    exchanges that no market covers."""
    s = F.upper(F.trim(symbol))
    out = F.when(s.startswith("^"), F.lit(None).cast("string")).when(crypto_base(s).isNotNull(), F.concat(F.lit("CC."), crypto_base(s), F.lit("USD")))
    for suffix, (prefix, width) in MARKETS.items():
        code = F.left(s, F.length(s) - len(suffix))
        padded = F.when(code.rlike("^[0-9]+$"), F.lpad(code.try_cast("long").cast("string"), width, "0")).otherwise(code) if width else code
        out = out.when(s.endswith(suffix), F.concat(F.lit(prefix), padded))
    for suffix in UNCOVERED:
        out = out.when(s.endswith(suffix), F.lit(None).cast("string"))
    return out.otherwise(F.concat(F.lit("US."), s))


def safe_path_part(c: Column, longest: int = 32) -> Column:
    """Whether a ticker may stand in a path: allowed characters, not too long, not only dots."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._\-\^=+]+$") & (F.length(c) <= longest) & ~c.rlike(r"^\.+$"), F.lit(False))


def excerpt(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)
