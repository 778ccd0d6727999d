"""Text functions as Column expressions; number reading, which needs callbacks, as an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Phrases that decide a mode or forbid captions, and words that aren't keywords.
EDIT_PINS = ("음성 없이", "목소리 없이", "내레이션 없이", "나레이션 없이", "무음으로", "소리 없이", "자막만")
VOICE_PINS = ("내레이션", "나레이션", "tts", "목소리", "음성", "보이스", "읽어줘", "읽어 줘", "대본", "멘트", "성우", "말해줘", "말해 줘")
NO_CAPTION_PINS = ("자막 없이", "자막없이", "텍스트 없이", "텍스트없이", "글자 없이", "글자없이", "자막은 빼", "자막 빼")
NOT_KEYWORDS = ("all", "dynamic", "static", "foster", "full", "none", "cut", "xfade", "fast", "calm", "gradual", "묘기")

CER_GATE = 0.20
READ_CPS, MIN_SHOW, DWELL, TITLE_DWELL = 12.0, 1.5, 2.0, 3.0


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_in(text: Column, phrases) -> Column:
    """Whether a text, lower-cased, holds one of the phrases; null holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def pin_mode(request: Column, edit=EDIT_PINS, voice=VOICE_PINS) -> Column:
    """edit, narration or null by fixed phrases; refusals are looked for first, as they contain the others."""
    return F.when(any_in(request, edit), "edit").when(any_in(request, voice), "narration")


def voice_allowed(mode: Column, auto_routed: Column, request: Column) -> Column:
    """Whether a voice may be added unasked: an edit that nobody chose and a request that says nothing of voices."""
    return (mode == "edit") & auto_routed & pin_mode(request).isNull()


def caption_forbidden(request: Column) -> Column:
    return any_in(request, NO_CAPTION_PINS)


def letters(text: Column) -> Column:
    """Only Hangul syllables, ASCII letters and digits."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^가-힣a-zA-Z0-9]", "")


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length, both as :func:`letters`; 0 for an empty reference."""
    r, h = letters(ref), letters(hyp)
    return F.when(F.length(r) > 0, F.levenshtein(r, h) / F.length(r)).otherwise(F.lit(0.0))


def speech_fails(raw: Column, read: Column, heard: Column) -> Column:
    """Whether what was heard is too far from the phrase, as written and as read out."""
    return F.least(cer(raw, heard), cer(read, heard)) > CER_GATE


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def clean_keywords(words: Column) -> Column:
    """Of an array: stripped entries of 1 to 10 letters, digits or blanks that aren't reserved words."""
    w = F.transform(words, lambda k: F.trim(k))
    return F.filter(w, lambda k: k.rlike(r"\A[가-힣a-zA-Z0-9 ]{1,10}\z") & ~F.lower(k).isin(*NOT_KEYWORDS))


EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]"


def clean_text(text: Column, request: Column) -> Column:
    """A written text without emoji and without a verbatim copy of the request; what is left is trimmed of
    punctuation, and empty if no letter or digit is left."""
    req = F.trim(F.coalesce(request, F.lit("")))

    def without(t):
        echo = (F.length(t) > 0) & (F.length(req) > 0) & F.contains(t, req)
        rest = F.btrim(F.replace(t, req, F.lit("")), F.lit(" ()[]{}·—–-,:;'\""))
        return F.when(~echo, t).otherwise(let(rest, lambda r: F.when(r.rlike("[가-힣a-zA-Z0-9]"), r).otherwise("")))

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), EMOJI, "")), without)


def is_echo(text: Column, request: Column) -> Column:
    req = F.trim(F.coalesce(request, F.lit("")))
    return (F.length(req) > 0) & F.contains(F.coalesce(text, F.lit("")), req)


def required_secs(text: Column) -> Column:
    """Seconds a text must show to be read."""
    return F.greatest(F.lit(MIN_SHOW), F.length(F.trim(F.coalesce(text, F.lit("")))) / READ_CPS)


# Korean numerals. Counters after which native numerals are read; units that are written short.
DIGITS = ("", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구")
PLACES = ("", "십", "백", "천")
GROUPS = ("", "만", "억", "조")
NATIVE_ONES = ("", "한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉")
NATIVE_TENS = ("", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔")
COUNTERS = "시간|살|마리|개(?![월국])|번(?![지호])|명|사람|시(?!간)|가지|군데|송이"
UNITS = {"kg": "킬로그램", "km": "킬로미터", "cm": "센티미터", "mm": "밀리미터", "g": "그램", "%": "퍼센트"}
ZERO, POINT = "영", "점"

LONGEST_NUMBER = len(PLACES) * len(GROUPS)
_UNIT = "|".join(re.escape(u) + ("(?![a-z])" if u == "g" else "") for u in UNITS)
#: A number with its fraction, then the unit or, after a whole number, the counter that it belongs to.
NUMBER = re.compile(rf"(?P<whole>\d+)(?:\.(?P<part>\d+))?(?:(?P<stop>\.?)\s*(?P<unit>{_UNIT})|(?(part)(?!)|\s*(?P<counter>{COUNTERS})))?|(?<=\.)\s*(?P<alone>{_UNIT})")


def spelled(digits: str) -> list[str]:
    return [DIGITS[int(d)] or ZERO for d in digits]


def read_sino(n: int) -> str:
    """A number read in Sino-Korean: each digit before the name of its place, each four digits before the name of their
    group; a one before a place name is silent. Numbers too long for the group names are read digit by digit."""
    digits = str(n)
    if len(digits) > LONGEST_NUMBER:
        return "".join(spelled(digits))
    out, said = [], False
    for left, d in zip(range(len(digits) - 1, -1, -1), digits):
        group, place = divmod(left, len(PLACES))
        if d != "0":
            out.append(PLACES[place] if d == "1" and place else DIGITS[int(d)] + PLACES[place])
            said = True
        if not place and said:
            out.append(GROUPS[group])
            said = False
    return "".join(out) or ZERO


def read_native(n: int) -> str:
    """1 to 99 in native numerals as they stand before a counter; anything else as :func:`read_sino`."""
    if not 0 < n < 100:
        return read_sino(n)
    tens, ones = divmod(n, 10)
    return NATIVE_TENS[tens] + NATIVE_ONES[ones]


def _said(m: re.Match) -> str:
    if m["alone"]:
        return f" {UNITS[m['alone']]}"
    n = int(m["whole"])
    if m["counter"]:
        return f"{read_native(n)} {m['counter']}"
    words = [read_sino(n), *([POINT, *spelled(m["part"])] if m["part"] else [])]
    return " ".join(words) + (f"{m['stop']} {UNITS[m['unit']]}" if m["unit"] else "")


def read_numbers(text: str) -> str:
    """A text with its numbers written as they are read, in one pass: what follows a number decides on the numerals."""
    return re.sub(" {2,}", " ", NUMBER.sub(_said, text))


@F.pandas_udf(StringType())
def read_numbers_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else read_numbers(t))


def wrap(text: str, width, limit: float) -> list[str]:
    """Lines of a text no wider than ``limit``: at blanks first, and inside a word only where the word alone is too
    wide. ``width`` measures a string."""
    lines: list[str] = []
    for word in text.split(" "):
        if lines and lines[-1] and width(f"{lines[-1]} {word}".strip()) > limit:
            lines.append(word)
        elif lines:
            lines[-1] = f"{lines[-1]} {word}".strip()
        else:
            lines.append(word)
    out = []
    for line in lines:
        while len(line) > 1 and width(line) > limit:
            fits = next((k for k in range(len(line) - 1, 1, -1) if width(line[:k]) <= limit), 1)
            out.append(line[:fits])
            line = line[fits:]
        if line:
            out.append(line)
    return out


def fixed_width(advance: float):
    """A stand-in for font metrics: every character is equally wide."""
    return lambda s: advance * len(s)


#: Characters that stripping takes away.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text_width(s: Column, advance: float, classes: dict[str, float] | None = None) -> Column:
    """Width of a text from a table of advances: ``classes`` has one for each class of characters (a pattern of one
    character; no two share one), the others are ``advance`` wide."""
    out = F.length(s) * F.lit(float(advance))
    for pattern, own in (classes or {}).items():
        out = out + (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))) * F.lit(float(own - advance))
    return out


def _wrapped(text: str, limit: float, advance: float, more: list) -> list[str]:
    """:func:`wrap` in time that is linear in the text: of a line that one word makes too wide, characters are counted.
    ``more`` has a pattern of one character for each class, and by how much it is wider than ``advance``."""

    def width(s: str) -> float:
        return advance * len(s) + sum(len(p.findall(s)) * w for p, w in more)

    words = text.split(" ")
    lines, line = [], words[0]
    for w in words[1:]:
        longer = f"{line} {w}".strip(STRIPPED)
        if line and width(longer) > limit:
            lines.append(line)
            line = w
        else:
            line = longer
    out = []
    for line in [*lines, line]:
        if width(line) > limit:
            at, held = 0, [0] * (1 + len(more))
            for i, c in enumerate(line):
                own = [1, *(int(bool(p.match(c))) for p, _ in more)]
                held = [x + y for x, y in zip(held, own)]
                if i > at and advance * held[0] + sum(k * w for k, (_, w) in zip(held[1:], more)) > limit:
                    out.append(line[at:i])
                    at, held = i, own
            line = line[at:]
        if line:
            out.append(line)
    return out


def wrap_lines(text: Column, limit: float, advance: float, classes: dict[str, float] | None = None) -> Column:
    """Lines (an array) of a text no wider than ``limit`` as :func:`wrap` makes them, inside a word by counting its characters
    (see :func:`text_width`). Null and empty texts have no lines."""
    more = [(re.compile(p), float(w - advance)) for p, w in (classes or {}).items()]

    @F.pandas_udf(ArrayType(StringType()))
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _wrapped(t or "", limit, advance, more))

    return lines(text)
