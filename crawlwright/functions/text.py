"""Text columns: whitespace, lengths, tokens and Arabic folding.  All JVM-side expressions."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlwright import constants as K

# White space as the rules understand it: ASCII plus the Unicode space characters.
SPACE = (r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
ARABIC = r"[\x{0600}-\x{06FF}]"
SPACE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Classes spelled out character by character are one table lookup in Java, ranges and \s a test each.
_ONE_SPACE = "".join(rf"\x{{{ord(c):X}}}" for c in SPACE_CHARS if c != " " and ord(c) < 256)
_WIDE_SPACE = r"[\x{1680}-\x{3000}&&[" + "".join(rf"\x{{{ord(c):X}}}" for c in SPACE_CHARS if ord(c) > 255) + "]]"
# White space that squeezing changes: one plain blank alone stays as it is.
LOOSE_SPACE = rf"[ {_ONE_SPACE}{_WIDE_SPACE}]{{2,}}|[{_ONE_SPACE}{_WIDE_SPACE}]"
TOKEN_SPLIT = r"[\s\-_/|،,.:؛…]+"
TOKEN_DROP = r"[^0-9a-z\x{0600}-\x{06FF}]"
# The same rules for a whole text at once: what is neither kept nor between tokens goes, then every run of two kept ones is a token.
# Runs that stay are found and joined: Java is slow at searching a text for what is not in a class.
_KEPT = "0123456789abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r" \t\n\x{0B}\f\r\-_/|,.:…"
TOKEN_STAY = rf"[{_KEPT}{_BETWEEN}\x{{0600}}-\x{{06FF}}]+"
TOKEN_RUN = rf"[{_KEPT}\x{{0600}}-\x{{060B}}\x{{060D}}-\x{{061A}}\x{{061C}}-\x{{06FF}}]{{2,}}"
ARABIC_MARKS = r"[\x{064B}-\x{0652}\x{0670}]"
ARABIC_MARK_CHARS = "".join(map(chr, (*range(0x064B, 0x0653), 0x0670)))
NO_LETTERS = r"^[^\p{L}\p{Nl}\p{No}]+$"
_LEFT_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_RIGHT_EDGE = r"(?:$|[^\p{L}\p{N}_])"


def edges(pattern: str) -> str:
    """Spell out word edges, so that they mean the same for every script and regex engine."""
    out, rest = "", pattern
    while r"\b" in rest:
        head, rest = rest.split(r"\b", 1)
        out += head
        opening = out == "" or out.endswith(("|", "(", "(?i)"))
        out += _LEFT_EDGE if opening else _RIGHT_EDGE
    return out + rest


def any_pattern(patterns) -> str:
    return "|".join(f"(?:{edges(p)})" for p in patterns)


def let(c: Column, body) -> Column:
    """Evaluate ``c`` once and use it many times inside ``body``: keeps long column rules small."""
    return F.element_at(F.transform(F.array(c), body), 1)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text(c), LOOSE_SPACE, " "))


def strip(c: Column) -> Column:
    return F.trim(text(c), F.lit(SPACE_CHARS))


def text_length(c: Column) -> Column:
    return F.length(squeeze(c))


def has_arabic(c: Column) -> Column:
    return text(c).rlike(ARABIC)


def fold_arabic(token: Column) -> Column:
    """Fold spelling variants of one Arabic token and drop one leading particle."""
    t = F.trim(token, F.lit(".,،؛:!?()[]"))
    # letters become others and marks go in one step
    t = F.translate(t, "أإآىة" + ARABIC_MARK_CHARS, "ااايه")
    return F.regexp_replace(t, "^(?:" + "|".join(K.ARABIC_PREFIXES) + ")(..)", "$1")


def fold(token: Column) -> Column:
    return F.when(token.rlike(ARABIC), fold_arabic(token)).otherwise(token)


def tokens(c: Column) -> Column:
    """Ordered tokens of a text: lower-case Latin letters and digits, or folded Arabic words."""
    stay = F.array_join(F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN_STAY), F.lit(0)), "")
    found = F.regexp_extract_all(stay, F.lit(TOKEN_RUN), F.lit(0))
    # texts without Arabic letters skip the folding of every token
    return let(found,
               lambda ts: F.when(has_arabic(c), F.transform(ts, fold)).otherwise(ts))


def has_tokens(c: Column) -> Column:
    """Has a text any token?  Two kept characters in a row, but for what is dropped between them."""
    one = TOKEN_RUN.removesuffix("{2,}")
    return F.lower(text(c)).rlike(f"{one}(?:{TOKEN_STAY.replace('[', '[^', 1)})?{one}")


def word_tokens(c: Column) -> Column:
    """Distinct tokens without the purely numeric ones."""
    return F.array_distinct(F.filter(tokens(c), lambda t: ~t.rlike(r"^\p{Nd}+$")))


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^0-9A-Za-z\x{0600}-\x{06FF}]+", "")


def has_letters_or_digits(c: Column) -> Column:
    """Is anything left by ``letters_and_digits``?"""
    return text(c).rlike(r"[0-9A-Za-z\x{0600}-\x{06FF}]")


def script_of(c: Column) -> Column:
    """'ar', 'la' or '' by the majority of letters; ties go to Arabic."""
    counts = F.struct(F.length(F.regexp_replace(text(c), r"[^\x{0600}-\x{06FF}]", "")).alias("ar"),
                      F.length(F.regexp_replace(text(c), "[^A-Za-z]", "")).alias("la"))
    return let(counts, lambda n: F.when((n["ar"] == 0) & (n["la"] == 0), "").when(n["ar"] >= n["la"], "ar")
               .otherwise("la"))


def western_digits(c: Column) -> Column:
    return F.translate(text(c), K.EASTERN_DIGITS, K.WESTERN_DIGITS)


_ENTITIES = json.dumps({name: " " if code == 160 else chr(code) for name, code in sorted((name2codepoint | {"apos": 39}).items())})


def decode_entities(c: Column) -> Column:
    """Named (HTML 4 and ``&apos;``) and numeric entities in one pass; unknown ones stay as they are.

    ``&nbsp;`` becomes a plain space.  Text between ampersands is looked up piece by piece, so ``&amp;lt;`` gives ``&lt;``.
    """
    # one literal, folded into a map when the query is planned
    named = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.when(F.substring(name, 2, 1).isin("x", "X"), F.substring(name, 3, 8)).otherwise(F.conv(F.substring(name, 2, 9), 10, 16))
        code = F.lpad(hexed, 8, "0")
        valid = (code > "00000000") & (F.upper(code) <= "0010FFFF") & ~F.upper(code).between("0000D800", "0000DFFF")
        char = F.when(name.startswith("#") & valid, F.decode(F.unhex(code), "UTF-32")).when(~name.startswith("#"), F.try_element_at(named, name))
        char = F.when(char == "\u00a0", " ").otherwise(char)
        return F.coalesce(F.when(name != "", F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece)))), F.concat(F.lit("&"), piece))

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&")
        decoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), ""))
        return F.when(F.contains(t, F.lit("&")), decoded).otherwise(t)

    return let(c, whole)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def folded_set(values) -> tuple[str, ...]:
    """Python-side folding of a fixed word list, so that queries compare with literals only."""
    import re

    out = []
    for w in values:
        t = w.strip(".,،؛:!?()[]")
        if re.search("[؀-ۿ]", t):
            t = re.sub("[ً-ْٰ]", "", t).translate(str.maketrans("أإآىة", "ااايه"))
            t = re.sub("^(?:" + "|".join(K.ARABIC_PREFIXES) + ")(..)", r"\1", t)
        if t not in out:
            out.append(t)
    return tuple(out)


def lookup(c: Column, pairs, default=None) -> Column:
    """Small fixed code -> value table as a CASE expression."""
    out = None
    for code, value in pairs:
        out = F.when(c == code, F.lit(value)) if out is None else out.when(c == code, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))
