"""Sentence units in any language, script and layout (problem 8).

The sentence-break rules of the Unicode text-segmentation annex, read for running text: the terminators of all scripts,
taken from the property Sentence_Break, end a unit together with the closing quotes and brackets behind them, unless the
period is a decimal, an initial, an ordinal or an abbreviation of the passage's language, or what follows can't begin a
sentence. The language is the document's, unless the function words around the period speak for another; where neither
tells, the lists of the script are pooled. Quotations and brackets are taken as wholes. Line ends are classed as wraps or
as ends of headings, list items, table rows and sentences without a mark. Thai, which has no terminators, is cut at
blanks that no number, abbreviation or continuing word explains.

The texts are walked once, event by event, in Arrow batches, and no event looks back farther than its own line; offsets
are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import ship

#: The line width that wrapped texts are assumed to have where their own lines allow it.
WRAP = 62
#: The least number of lines that show another width.
SURE = 5
#: The most characters that a heading has before its last line.
HEADING = 80

# Abbreviations that don't end a sentence, by language, in lower case, without the last period.
TITLES = {
    "en": "mr mrs ms dr prof st rev hon gen col capt lt sgt messrs jr sr fr gov sen rep pres dept univ assoc asst supt",
    "de": "hr fr frl dipl ing dr-ing apl prof st z u d ggf bzw vgl inkl exkl evtl sog zzgl tel str bes geb gest verh gem abs allg dt engl frz ehem jr kath ev",
    "fr": "m mm mme mmes mlle mlles mgr me pr dr st ste env cf c.-à-d tél adr av boul chap éd fig",
    "es": "ee sr sra sres srta srtas d dña dr dra dras prof profa ud uds vd vds lic ing arq aprox avda pág págs núm núms dpto depto gral excmo ilmo",
    "it": "sig sigg sig.ra sig.na dott dott.ssa dr prof prof.ssa ing arch avv geom rag cfr sen en egr gent spett ing avv art",
    "nl": "dhr mevr mw drs ir ing mr dr prof ca bijv blz nl",
    "pl": "dr prof hab inż mgr ul św tzw tj np",
    "nord": "dr prof ca bl a dvs f ev hr fr nr s st t",
    "ru": "проф акад доц канд докт инж им фам ул пр пер д стр п пп ок тыс млн млрд руб корп кв обл р рис табл см ср напр т и н э о с гл ред изд тел каб",
    "el": "κ κκ καθ δρ αν επ βλ σελ αρ περ στ γεν δεσπ πρβλ δηλ τηλ",
    "hi": "प्रो डॉ डा श्री पं कु कि मी कि.मी से.मी पीएच.डी सं",
    "ar": "د أ م أ.د ا.د ص ج ه ط ت",
    "th": "ดร ศ รศ ผศ นพ พญ ม.ร.ว พ.ศ ค.ศ กม ซม กก",
    "any": "env inkl exkl dr-ing dr prof mr mrs ms st e.g i.e cf vs viz al resp approx ca lat lon lit incl excl z.b u.a d.h p.ej c.-à-d a.d o.ä v.a",
}
# Abbreviations that a number follows, by language.
NUMBERED = {
    "en": "no nos p pp pg fig figs sec sect art arts vol ch chap eq eqs tab app col par para ex v ver vs s pt ed max min op ref rev item",
    "de": "nr nrn s abs art bd kap anm abb tab fig abschn ziff",
    "fr": "no n p pp art arts vol chap fig tab éd",
    "es": "no n pág págs núm núms p pp art arts cap fig vol tab",
    "it": "no n pag pagg p pp art artt cap vol fig tab",
    "nl": "nr nrs p pp blz art hfst fig tab",
    "pl": "nr s str art rozdz rys tab ust",
    "nord": "nr s kap art fig tab avsn",
    "ru": "стр с п пп гл рис табл ст р д кв",
    "el": "σελ αρ τ κεφ άρθρ πίν",
    "any": "n° nº § №",
}
# Abbreviations that may also end a sentence.
MAY_END = "etc usw ecc inc ltd corp co bros plc gmbh ag sa jr sr ph.d m.d b.a m.a u.s u.k u.n e.u eu a.m p.m d.c uu ee.uu ff f al д г в п.χ κ.λπ κλπ κ.ά osv itd itp enz m.m bl.a км др пр н.э"
# Function words by which a passage in Latin letters shows its language.
FUNCTION_WORDS = {
    "en": "the of and to was she he they it that is for with not are were an his her",
    "de": "der die das des und ist hat nicht mit von den dem ein eine auf für wird zum im zu",
    "fr": "le la les et de des est une un dans du que pour pas sur au qui par",
    "es": "el la los las y de del que en un una por con no para se su es al",
    "it": "il la di che è un una per non sono della dei nel del con gli si le",
    "nl": "de het een van en is niet zijn op te dat voor met werd aan door",
    "pl": "w i na z nie się jest do że oraz od przez jak ale był dla",
    "nord": "och att det en på som är av til og er ikke med den for ett",
}
# Months, which make a day of the number before them.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember january february march may june july october december janvier février mars avril juin juillet août septembre octobre novembre décembre januari februari maart mei augustus tammikuuta helmikuuta desember marts"
# Words before a German or Nordic ordinal.
ORDINAL_LEADS = "im am zum vom beim ins der die das dem den des ein eine einer einem einen jede jeder jedem jeden dieser diesem zur seit ab bis på den det en ett et"
# Words that don't end a sentence, so that a line that ends with one goes on.
OPEN_ENDS = (
    "the a an of to by from with and or nor as which who was were been has had have into between "
    "der die das dem den des eine einer einem einen und oder von vom zum zur im am beim für ist sind "
    "le la les un une des du de et ou au aux sur pour par avec qui est sont "
    "el los las una uno y del al con por que es "
    "il lo gli una di da del della dei delle nel nella al alla che è sono "
    "и в во на с со к ко у о об от до из за по что или для при "
    "και η το οι τα του της των τον την στο στη στον στην από με για "
    "van ten ter te upon institut university académie tu st san sankt saint"
)
# Thai words that go on with the clause before the blank; words after which a blank goes on; titles.
THAI_GOES_ON = "และ หรือ ซึ่ง ที่ แต่ เมื่อ จาก เป็น ต่อ ของ ใน โดย เพื่อ แล้ว ก่อน หลัง รวม ซ้ำ ย้าย คน ปี ปีนี้ ปีที่ เดือน วัน บาท ครั้ง แห่ง ฉบับ ชื่อ จึง ก็ ถึง จน ว่า กับ แก่ ตาม ด้วย อีก เท่านั้น กล่าว บอก นั้น นี้ ได้ ไม่ถูก มี อยู่ ไป มา ให้ เพราะ เนื่องจาก"
THAI_OPEN = "ที่ ว่า กับ ของ จาก ใน โดย คือ และ หรือ ถึง ต่อ เป็น รัศมี หมายเลข วันที่ ปี เมื่อปี ก่อนวันที่ ทั้งหมด เพียง ประมาณ"
THAI_TITLES = "ดร. ศ. รศ. ผศ. นพ. พญ. ม.ร.ว."

_words = lambda s: frozenset(s.split())
_BY_LANG = [{k: _words(v) | _words(table["any"]) for k, v in table.items()} for table in (TITLES, NUMBERED)]
_TITLES, _NUMBERED = (frozenset().union(*t.values()) for t in _BY_LANG)
_MAY_END, _MONTHS, _LEADS, _OPEN_ENDS = map(_words, (MAY_END, MONTHS, ORDINAL_LEADS, OPEN_ENDS))
_SPEAKS: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _SPEAKS.setdefault(_w, []).append(_lang)
_NORDIC = frozenset("sv da no nb nn fi is".split())
_GOES_ON, _THAI_OPEN, _THAI_TITLES = tuple(THAI_GOES_ON.split()), tuple(THAI_OPEN.split()), tuple(THAI_TITLES.split())

_SIGNS = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
_property = lambda p: "".join(regex.findall(p, _SIGNS))
_FULL = "".join(c for c in _property(r"[\p{SB=STerm}\p{SB=ATerm}]") if unicodedata.east_asian_width(c) in "WFH")  # wide terminators, which need no blank behind them
_STRONG = _property(r"\p{SB=STerm}") + "⁇‼⁈⁉՞" + _FULL
_PERIODS = "".join(c for c in _property(r"\p{SB=ATerm}") if c not in _FULL)
_CLOSERS = "\"'" + _property(r"(?V1)[[\p{Pe}\p{Pf}]&&\p{SB=Close}]")
del _SIGNS
_STOPS, _CLOSE = re.escape(_STRONG), re.escape(_CLOSERS)
_EVENT = re.compile(
    r"(?P<url>(?<![^\W_])(?:https?://|ftp://|www\.)[^\s<>“”«»「」『』，。、）؟،]+)"
    r"|(?P<quote>„[^„“”\n]*(?:\n[^„“”\n]+)*[“”]|“[^“”„\n]*(?:\n[^“”„\n]+)*”|«[^«»\n]*(?:\n[^«»\n]+)*»|「[^「」\n]*(?:\n[^「」\n]+)*」|『[^『』]*』|‹[^‹›\n]*›|\"[^\"\n]*(?:\n[^\"\n]+)?\")"
    r"|(?P<paren>\([^()\n]*(?:\n[^()\n]+)*\)|（[^（）\n]*）|\[[^\[\]\n]*\])"
    rf"|(?P<stop>(?:[{_PERIODS}{_STOPS}…]|(?<=[Ͱ-Ͽἀ-῿”»]);|;)[{_PERIODS}{_STOPS}…;]*(?:[   ]?[»](?!\w))?[{_CLOSE}]*)"
    r"|(?P<line>(?<![ \t　])[ \t　]*(?:\r\n?|[\n\v\f\x85  ])\s*)"
    r"|(?P<gap>(?<=[^\s])[  ]+(?=\S))"
)
_EVENT_NO_GAP = re.compile(_EVENT.pattern.rpartition("|")[0])
_THAI = re.compile("[ก-๛]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_BREAKS = re.compile(r"\r\n?|[\n\v\f\x85  ]")
_ENUM = re.compile(r"(?:[-*•–—■]\s*)?(?:\(?\d[\d.,]*|[A-Za-z]|[IVXLC]{1,5})[.)]?$")
_ITEM = re.compile(r"\s*(?:[-*•‣◦▪■●–—]\s|\|)")
_NUMBER_ITEM = re.compile(r"\s*(?:\d{1,3}(?:,\d{3})*|[a-zA-Z])[.)]\s+\S|\s*[一二三四五六七八九十]+、")
_HEADING = re.compile(r"\s*(?:\d[\d.,]*[.)]\s+\S[^.!?]{0,60}|#{1,6}\s.*|[A-ZÀ-ÝА-ЯΑ-Ω\d .,:'’№#-]{4,})$")
_LAST_TOKEN = re.compile(r"[^\s(\[{“„«‹\"「『]+$")
_FIRST_WORD = re.compile(r"\S+")
_SAID = re.compile(r"[^。！？…“”\n]{1,24}(?:说|說|道|表示|指出|问|問|回答|称|稱|写道|寫道|认为|認為|强调|补充)[。！？…]")
_STARTS_LOW = re.compile(r"(?:e\.g\.|i\.e\.|z\. ?B\.)\s")
_WRAPPED = re.compile(r"[^\W\d_][,)”»]?\n(?!e\.g\.|i\.e\.|[a-z]{1,2}[A-Z])[a-zß-öø-ÿа-яёα-ώ]")
_LOWER_TO = re.compile(r"[a-z]{1,2}[A-Z]")
_WORD = re.compile(r"[^\W\d_]+")
_TONGUES = (("ru", re.compile("[Ѐ-ӿ]")), ("el", _GREEK), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("th", _THAI))


def _wide(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힣" or "豈" <= c <= "﫿" or "＀" <= c <= "￯" or c >= "\U00020000"


def _may_begin(text: str, at: int) -> bool:
    """Whether a sentence can begin here as letters go: not with a lower-case letter, but iX and e.g. do."""
    c = text[at]
    if c.islower():
        return bool(_LOWER_TO.match(text, at) or _STARTS_LOW.match(text, at))
    return True


def _after(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _begin_letter(text: str, at: int, end: int) -> int:
    """The first letter or digit behind opening marks."""
    while at < end and text[at] in "\"'“„«‹(‘[「『（¿¡":
        at += 1
    return min(at, end - 1)


def _tongues(text: str, start: int, at: int, token: str, lang: str | None) -> list[str]:
    """The languages the passage around the token before at may be in: by the token's script, and for Latin letters by
    the function words of the unit so far, which count double, and shortly after it, with a vote for the document's language: those with at
    least half of the most votes. None where nothing tells."""
    for tongue, script in _TONGUES:
        if script.search(token):
            return [tongue]
    votes: Counter = Counter()
    for part, weight in ((text[max(start, at - 160) : at], 2), (text[at : at + 60], 1)):
        for w in _WORD.findall(part.lower()):
            for x in _SPEAKS.get(w, ()):
                votes[x] += weight
    if lang in FUNCTION_WORDS:
        votes[lang] += 2
    return [x for x, n in votes.items() if 2 * n >= max(votes.values())]


def _listed(low: str, kind: int, text: str, start: int, i: int, token: str, lang: str | None) -> bool:
    """Whether low is an abbreviation of the passage's language: kind 0 a title or the like, 1 one before a number."""
    if low not in (_TITLES, _NUMBERED)[kind]:
        return False
    own = _BY_LANG[kind]
    if low in own["any"]:
        return True
    tongues = _tongues(text, start, i, token, lang)
    return not tongues or any(low in own.get(x, ()) for x in tongues)


def _ordinals(text: str, start: int, i: int, token: str, lang: str | None) -> bool:
    """Whether the passage may be in a language whose ordinals are written with a period."""
    tongues = _tongues(text, start, i, token, lang)
    return not tongues or "de" in tongues or "nord" in tongues


def _period_ends(text: str, i: int, start: int, j: int, nxt: int, end: int, lang: str | None) -> bool:
    """Whether the lone period at i (its closers end at j) ends the unit that began at start; nxt is the next sign."""
    c = text[nxt]
    spaced = nxt > j
    m = _LAST_TOKEN.search(text, max(start, i - 40), i)
    token = m.group() if m else ""
    first = _begin_letter(text, nxt, end)
    lead = text[first]
    prev = text[i - 1] if i > start else " "
    if not spaced:
        if _wide(c):
            return not _wide(prev) or c not in "、，"
        if c in ",;:)/-–—%'’" or c.isdigit():
            return False
        # a lost blank: a lower-case word, the period, a capitalised word
        if prev.isalpha() and lead.isalpha():
            if lead.isupper() and len(token) > 2 and token[-2:].islower() and "." not in token and not _listed(token.lower(), 0, text, start, i, token, lang) and first + 1 < end and (text[first + 1].islower() or text[first + 1] in " .'’"):
                return True
            both = prev.isascii() and not lead.isascii() and not lead.islower() and not lead.isupper()
            return both and len(token) > 1
        if (prev.isdigit() or prev in ")”»%") and lead.isupper() and first + 1 < end and text[first + 1].islower():
            return True
        return False
    if c in ",;:)]}/%،؛、" or (c in "–—-" and not (nxt + 1 < end and text[nxt + 1] == " " and c == "-")):
        return False
    if lead.islower() and not _may_begin(text, first):
        return False
    if j > i + 1:  # closing marks stand between: the period was inside or the bracket ended the sentence
        return True
    low = token.lower().strip("'’*").lstrip("-–—|")
    for cutter in ("'", "’"):
        if cutter in low:
            low = low.rpartition(cutter)[2]
    if not low:
        return True
    if _ENUM.fullmatch(token) and i - len(token) - start <= 12 and not text[start : i - len(token)].strip(" -*•–—■|"):
        return False  # an enumerator opens its own unit
    if low.replace(",", "").replace(".", "").isdigit():
        if len(low) <= 2 and lead.isupper() and _ordinals(text, start, i, token, lang):
            word = _FIRST_WORD.match(text, first, end).group().strip(".,;:!?)”“»").lower()
            if word in _MONTHS:
                return False
            before = text[max(start, i - len(token) - 24) : i - len(token)].split()
            return not (before and before[-1].lower() in _LEADS and before[-1].lower() not in ("seit", "ab", "bis") and not lead.isdigit())
        return True
    if low in _MAY_END:
        if low in ("г", "д", "al", "jr", "sr", "co", "в", "f"):
            digits = text[max(start, i - 10) : i].rstrip(low).rstrip()
            return low == "г" and digits[-1:].isdigit() or low == "д" and text[max(start, i - 4) : i].startswith("т.")
        if low == "uu":
            return lead.isupper()
        return not lead.isdigit()
    if (lead.isdigit() or lead in "§№") and _listed(low, 1, text, start, i, token, lang):
        return False
    bare = low.rpartition("-")[2]
    if _listed(low, 0, text, start, i, token, lang) or len(bare) > 1 and bare != low and _listed(bare, 0, text, start, i, token, lang):
        return False
    if "." in low and all(x.isalpha() and len(x) <= 3 for x in low.split(".")):
        return False  # several short parts: an abbreviation
    letters = [x for x in low if x.isalpha()]
    if len(letters) == 1 and len(low) <= 2:
        return False  # an initial
    if low in ("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "okt", "nov", "dec", "dez", "janv", "févr", "avr", "juil", "ene", "abr", "ago", "dic", "gen", "mag", "giu", "lug", "ott") and lead.isdigit():
        return False
    if _THAI.match(prev) or "ऀ" <= prev <= "ॿ":
        return len(low) > 6
    return True


def _line_ends(text: str, start: int, own: int, at: int, nxt: int, end: int, width: int, thai: bool, lang: str | None) -> bool:
    """Whether the line end at `at` ends the unit that began at start and whose last line began at own, where no
    terminator stands before it."""
    line = text[own:at].strip()
    if not line:
        return False
    if _ITEM.match(text, nxt, end) or _ITEM.match(text, start, at) or at - start <= HEADING + len(line) and _HEADING.fullmatch(text[start:at].strip()):
        return True
    c, last = text[nxt], line[-1]
    if thai and (_THAI.match(last) or _THAI.match(c)) and not c.islower():
        return _thai_ends(text, start, at, nxt, end)
    if _wide(c) or _wide(last):
        return last not in "、，；："
    word = _FIRST_WORD.match(text, nxt, end).group()
    overflow = len(line) <= width < len(line) + 1 + len(word)
    if _STARTS_LOW.match(text, nxt) or _LOWER_TO.match(text, nxt):
        return not overflow
    if c.islower() or c in ",;:)»”" or c == "(" and text[min(nxt + 1, end - 1)].islower():
        return False
    if last in ",;—–(" or overflow:
        return False
    m = _LAST_TOKEN.search(line)
    token = (m.group() if m else line).lower()
    if token.endswith(".") or _NUMBER_ITEM.match(text, nxt, end) and not _listed(token.rstrip("."), 1, text, start, at, token, lang):
        return not token.endswith(".") or not (_listed(token[:-1], 0, text, start, at, token, lang) or _listed(token[:-1], 1, text, start, at, token, lang))
    return not (token in _OPEN_ENDS and len(line) > 30)


def _thai_ends(text: str, start: int, at: int, nxt: int, end: int) -> bool:
    """Whether the blank or line end from at to nxt lies between two Thai clauses."""
    c, prev = text[nxt], text[at - 1]
    if prev in ",;:、(“„«-–—/" or c in ",;:)”»-–—/%&|.…!?" or not (_THAI.match(prev) or _THAI.match(c)):
        return False
    before = text[max(start, at - 30) : at]
    token = _FIRST_WORD.match(text, nxt, end).group()
    if prev == ".":
        m = _LAST_TOKEN.search(before)
        if m and (_THAI.search(m.group()) or m.group()[:-1].lower() in _TITLES or m.group()[:-1].lower() in _NUMBERED):
            return False
        return True
    if c.isdigit():
        return False
    if token.startswith(_THAI_TITLES):
        return True
    if _THAI.match(c):
        if token.startswith(_GOES_ON):
            return False
        if prev.isdigit() and re.match(r"(?:[ก-ฮ]{1,3}\.)+", token):
            return False
        if _THAI.match(prev):
            own = before.rpartition(" ")[2]
            if own.endswith(_THAI_OPEN) and own in _THAI_OPEN:
                return False
        return True
    if c in "“„«(‘\"'":
        return False
    own = before.rpartition(" ")[2]
    return c.isupper() and not own.endswith(_THAI_OPEN) and not token.startswith(("http", "www"))


def wrap_width(text: str, wrap: int = WRAP) -> int:
    """The width at which the text is wrapped, 0 if no line shows it.

    A line that goes on in small letters was wrapped: its last sentence fits the width, and with the next word it
    doesn't. The width that most such lines allow is taken where at least SURE of them do, and twice as many as allow
    `wrap`; else it is wrap.
    """
    spans = []
    for m in _WRAPPED.finditer(text):
        at = m.end() - 2
        line = text.rfind("\n", 0, at) + 1
        line = max(line, *(text.rfind(x, line, at) + 2 for x in (". ", "! ", "? ")))
        spans.append((at - line, at - line + _FIRST_WORD.match(text, at + 1).end() - at - 1))
    if not spans:
        return 0
    changes = sorted([(a, 1) for a, _ in spans] + [(b + 1, -1) for _, b in spans])
    level, best, out = 0, 0, wrap
    for x, step in changes:
        level += step
        if level > best:
            best, out = level, x
    return out if best >= SURE and best > 2 * sum(a <= wrap <= b for a, b in spans) else wrap


def sentence_spans(text: str | None, lang: str | None = None, wrap: int = WRAP) -> list[tuple[int, int]]:
    """The (start, end) code-point spans of the units of one text, without outer white space.

    lang is a two-letter code; None, 'und' and codes without lists leave the language to the passage. None and blank
    texts have no units. Every character that isn't white space lies in exactly one unit.
    """
    if not text or text.isspace():
        return []
    end = len(text)
    lang = (lang or "").lower().replace("_", "-").partition("-")[0]
    lang = "nord" if lang in _NORDIC else lang
    thai = bool(_THAI.search(text))
    wrap = wrap_width(text, wrap)
    search = (_EVENT if thai else _EVENT_NO_GAP).search
    out: list[tuple[int, int]] = []
    start = _after(text, 0, end)
    pos = own = start  # own: where the unit's last line began

    def close(at: int) -> None:
        nonlocal start, own
        stop = at
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            out.append((start, stop))
        start = own = _after(text, at, end)

    while pos < end:
        m = search(text, pos)
        if m is None:
            break
        kind, a, b = m.lastgroup, m.start(), m.end()
        pos = b
        if kind == "url":
            while b > a and text[b - 1] in ".,;:!?)'\"":
                b -= 1
            pos = max(b, a + 1)
            continue
        if kind == "quote" or kind == "paren":
            if len(_BREAKS.findall(m.group())) and "\n\n" in m.group():
                pos = a + 1  # no paragraph ends inside a quotation; its mark was unpaired
                continue
            own = max(own, text.rfind("\n", a, b) + 1)
            if kind == "paren":
                continue
            inner = m.group()[1:-1].rstrip()
            if not inner or inner[-1] not in ".…" + _STRONG and not (inner[-1] == ";" and _GREEK.match(inner[0])):
                continue
            nxt = _after(text, b, end)
            if nxt == end:
                continue
            c = text[nxt]
            listed = c == "-" and nxt > b and re.match(r"- \S", text[nxt : nxt + 3])
            if c in ",;:.)）]–—-،؛、，。!?；：…" and not listed or c in "\r\n":
                continue
            begins = _begin_letter(text, nxt, end)
            if text[begins].islower() or _BREAKS.search(text, b, nxt):
                continue
            if _wide(c) and text[a] in "“「『" and (_SAID.match(text, nxt) or text.startswith(("と", "って", "の", "は", "が", "を", "に", "も", "など", "という"), nxt)):
                continue
            if inner[-1] == "." and inner.rpartition(" ")[2][:-1].lower() in _TITLES:
                continue
            close(b)
            pos = max(pos, start)
            continue
        if kind == "gap":
            if start < a and _thai_ends(text, start, a, b, end):
                close(b)
            continue
        if kind == "line":
            if a <= start:
                start = own = max(start, _after(text, a, end))
                pos = max(pos, start)
                continue
            blank = len(_BREAKS.findall(m.group())) > 1
            if blank or b >= end or _line_breaks(text, start, own, a, b, end, wrap, thai, lang):
                close(b)
                pos = max(pos, start)
            own = max(own, b)
            continue
        # a terminator
        signs = m.group().rstrip(_CLOSERS + "   ")
        nxt = _after(text, b, end)
        if nxt == end:
            break
        if _BREAKS.search(text, b, nxt):
            pos = b
            continue  # the line end decides
        if _decides(text, signs, a, start, b, nxt, end, lang):
            close(b)
            pos = max(pos, start)
    if start < end:
        close(end)
    return out


def _decides(text: str, signs: str, a: int, start: int, b: int, nxt: int, end: int, lang: str | None) -> bool:
    c = text[nxt]
    spaced = nxt > b
    if ";" in signs:
        if signs != ";" and any(x in signs for x in ".!?"):
            pass
        elif a > start and _GREEK.match(text[a - 1]) and spaced:
            return not text[_begin_letter(text, nxt, end)].islower()
        else:
            return False
    if any(x in _FULL for x in signs):
        return c not in "、，；：)）」』”"
    strong = any(x in _STRONG for x in signs)
    dots = sum(map(signs.count, _PERIODS)) + 3 * signs.count("…")
    if strong:
        if c in ",;:)]،؛、，–—" or c in "-" and not text.startswith("- ", nxt):
            return False
        lead = text[_begin_letter(text, nxt, end)]
        return spaced or _wide(c) or lead.isupper() or (lead.isalpha() and not lead.islower())
    if dots >= 2:
        if c in ",;:)]?!،、，" or a == start:
            return False
        lead = text[_begin_letter(text, nxt, end)]
        return not lead.islower() if spaced else (_wide(c) or lead.isupper())
    return _period_ends(text, a, start, b, nxt, end, lang)


def _line_breaks(text: str, start: int, own: int, a: int, b: int, end: int, wrap: int, thai: bool, lang: str | None) -> bool:
    """Whether a single line end closes the unit: after a terminator as for a blank, else by the layout."""
    stop = a
    while stop > start and text[stop - 1] in "\"'”“’»)]}」』）":
        stop -= 1
    inner = text[stop - 1] if stop > start else " "
    while stop > start and text[stop - 1].isspace():
        stop -= 1
        inner = text[stop - 1]
    if _ITEM.match(text, start, a) or _ITEM.match(text, b, end):
        return True
    if inner in _STRONG or inner == "…" or (inner == ";" and stop - 2 >= start and _GREEK.match(text[stop - 2])):
        if stop < a and text[b].islower():
            return False
        if inner in "?!" and text[b].islower():
            return True
        return True
    if inner in _PERIODS:
        if text[stop - 3 : stop] == "...":
            return not text[b].islower()
        if stop < a and text[b].islower():
            return False
        return _period_ends(text, stop - 1, start, a, b, end, lang) if not _ENUM.fullmatch(text[own:a].strip()) else False
    return _line_ends(text, start, own, a, b, end, wrap, thai, lang)


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", wrap: int = WRAP) -> DataFrame:
    """(key, start_char, end_char) of every unit of every text; null and blank texts give no rows.

    The lang column, if there is one, chooses the abbreviations. Other columns are ignored, repeated keys give the units
    of each of their rows.
    """
    ship(docs.sparkSession)
    docs = docs if lang in docs.columns else docs.withColumn(lang, F.lit(None).cast("string"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [sentence_spans(t, x, wrap) for t, x in zip(b[text], b[lang], strict=True)]
            counts = np.fromiter(map(len, spans), dtype=np.int64, count=len(spans))
            flat = np.array([x for s in spans for x in s], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), counts), "start_char": flat[:, 0], "end_char": flat[:, 1]})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text, lang).mapInPandas(walk, f"`{key}` {kind}, start_char bigint, end_char bigint")
