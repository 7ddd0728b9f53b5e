"""Text primitives: normal form, tokens and scripts, foldings, romanisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .spans import quoted

# Scripts in the order in which they are tried.
SCRIPTS = (
    "Latin Cyrillic Greek Arabic Hebrew Devanagari Hangul Bengali Tamil Telugu Gujarati Kannada Malayalam Oriya Armenian"
    " Georgian Gurmukhi Thai Han"
).split()
BICAMERAL = frozenset("Latin Cyrillic Greek Armenian".split())
CASELESS = frozenset(SCRIPTS) - BICAMERAL - {"Han"}
_SCRIPT = regex.compile("|".join(rf"(?P<{s}>\p{{Script={s}}})" for s in SCRIPTS))
_FIRST = regex.compile(r"[^\p{M}]")
#: A word, in a form that Java and Python read alike.
WORD = r"[\p{L}\p{M}]++(?:[-'’][\p{L}\p{M}]++)*+"
_WORD = regex.compile(WORD)
#: The end of a word that is cut off.
OWNED = "['’][sS]$"
_MARKS = regex.compile(r"[̀-ͯ]+")
#: Letters that no decomposition reaches; fixed values.
LETTERS = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i", "đ": "d", "Đ": "D"}
_LETTERS = str.maketrans(LETTERS)
_GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"})


class Token(NamedTuple):
    text: str
    start: int
    end: int
    script: str


def detect_script(word: str) -> str:
    """The script of the first character that is not a mark."""
    m = _FIRST.search(word)
    while m:
        c = m[0]
        s = _SCRIPT.match(c)
        if s:
            return s.lastgroup
        if c.isalpha():
            return "Other"
        m = _FIRST.search(word, m.end())
    return "Other"


def tokenize(text: str) -> list[Token]:
    """Words of letters and marks, inner hyphens and apostrophes kept, a final 's cut off."""
    out = []
    for m in _WORD.finditer(text):
        word = m[0]
        if word[-1] in "sS" and len(word) >= 4 and word[-2] in "'’":
            word = word[:-2]
        script = "Latin" if word[0].isascii() else detect_script(word)
        out.append(Token(word, m.start(), m.start() + len(word), script))
    return out


def latin_fold(text: str) -> str:
    """Without diacritics; case stays."""
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFD", text)).translate(_LETTERS)


def norm_name(text: str) -> str:
    """Lower case, German letters written out, then without diacritics."""
    low = unicodedata.normalize("NFC", text).lower().translate(_GERMAN)
    return low if low.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", low))


def is_capitalized(word: str) -> bool:
    return bool(word) and word[0] != word[0].lower() and word[0] == word[0].upper()


def strip_digits(text: str) -> str:
    return text.strip("0123456789")


# Romanised jamo, in code order; fixed values.
_LEADS = "g kk n d tt r m b pp s ss _ j jj ch k t p h".split()
_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
_TAILS = "_ k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split()


def romanize_hangul(text: str) -> str:
    """Revised Romanisation syllable by syllable, lower case; other characters unchanged."""
    out = []
    for c in text:
        n = ord(c) - 0xAC00
        if 0 <= n < 11172:
            parts = _LEADS[n // 588], _VOWELS[n % 588 // 28], _TAILS[n % 28]
            out.append("".join(p for p in parts if p != "_"))
        else:
            out.append(c)
    return "".join(out).lower()


# Usual spellings of Korean surnames that romanisation by syllables does not give; fixed values.
SURNAMES = """
김 kim, 이 lee yi rhee, 박 park bak, 최 choi choe, 정 jung jeong chung, 강 kang, 조 cho jo, 윤 yoon yun, 장 jang chang,
임 lim im, 한 han, 오 oh o, 서 seo suh, 신 shin sin, 권 kwon, 황 hwang, 안 ahn an, 송 song, 전 jeon jun chun, 홍 hong,
유 yoo yu, 고 ko go koh, 문 moon mun, 양 yang, 손 son sohn, 배 bae, 백 baek paik baik, 허 heo hur huh, 남 nam, 심 shim sim,
노 noh no roh, 하 ha, 곽 kwak gwak, 성 sung seong, 차 cha, 주 joo ju, 우 woo, 구 koo ku goo, 민 min, 류 ryu yoo lyu,
나 na ra, 진 jin chin, 지 ji jee, 엄 eom um, 변 byun byeon, 원 won, 천 cheon chun, 방 bang pang, 공 kong gong,
현 hyun hyeon, 함 ham, 염 yeom yum, 여 yeo, 추 chu choo, 도 do doh, 소 so soh, 석 seok suk, 선 sun seon, 설 seol sul,
마 ma, 길 gil kil, 연 yeon youn, 위 wi wee, 표 pyo, 명 myung myeong, 기 ki gi, 반 ban pan, 왕 wang, 금 keum geum, 옥 ok,
육 yook yuk, 인 in, 맹 maeng, 제 je, 모 mo, 탁 tak tark, 국 kook guk, 은 eun, 편 pyeon pyun, 용 yong, 예 ye,
경 kyung gyeong, 봉 bong, 사 sa, 부 boo bu
"""
SURNAME_SPELLINGS = {w[0]: tuple(w[1:]) for w in (part.split() for part in SURNAMES.split(","))}


def hangul_spellings(name: str) -> list[str]:
    """The romanisation of a Hangul name and the usual spellings of a surname."""
    return [romanize_hangul(name), *SURNAME_SPELLINGS.get(name, ())]


def utf16_offset(text: str, offset: int) -> int:
    """The offset in UTF-16 units of a code point offset."""
    return offset + sum(1 for c in text[:offset] if ord(c) > 0xFFFF)


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(latin_fold, na_action="ignore")


def normalize(col: Column) -> Column:
    """Normal form C.  Texts of characters below U+0300 are in it and stay in the JVM."""
    return F.when(col.rlike(r"[^\x{0000}-\x{02FF}]"), _nfc(col)).otherwise(col)


def fold(col: Column) -> Column:
    """latin_fold of a column; ASCII texts stay in the JVM."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), _fold(col)).otherwise(col)


def line_of(text: Column, pos: Column) -> Column:
    """How many line feeds stand before pos."""
    before = F.substring(text, F.lit(1), pos)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def is_loopback_url(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & host.isin("localhost", "127.0.0.1", "[::1]"), F.lit(False))


def words(text_col: str) -> Column:
    """Array of the words of a text, in order; JVM only.  A null text has none."""
    own = f"w -> if(length(w) >= 4 and w rlike {quoted(OWNED)}, left(w, length(w) - 2), w)"
    return F.expr(f"transform(coalesce(regexp_extract_all(`{text_col}`, {quoted(WORD)}, 0), cast(array() as array<string>)), {own})")


def script_of(word: str) -> Column:
    """The script of the first character of a word that is no mark; JVM only."""
    out = F.when(F.col(word).rlike("^[A-Za-z]"), "Latin")
    for s in SCRIPTS:
        out = out.when(F.col(word).rlike(rf"^\p{{M}}*+\p{{Is{s}}}"), s)
    return out.otherwise("Other")
