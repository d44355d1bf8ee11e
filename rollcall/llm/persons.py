"""What records of people show, made comparable: names, places, identifiers; and how two names compare.

Names are bags of plain tokens without particles, titles and remarks, so that order, case, accents, look-alike letters
and wrong encodings don't matter. Places are the distinctive words of affiliations and of homepage hosts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.normalize import LOOKALIKES, PLAIN_LETTERS

# Name particles, titles and remarks, which are no part of a name.
PARTICLES = frozenset("van vander vanden vande von der den de del della di da du la le ten ter te zu zum el al bin ibn".split())
HONORIFICS = frozenset("prof professor dr phd ph d ing dipl msc bsc mr mrs ms frau herr sir dame emeritus em hc habil di mag mlle mme sig dott dottssa on leave retired since part time".split())
# Short forms of given names, by folded full form.
SHORT_FORMS = """
benjamin ben|edward ted ned ed eddie|elizabeth beth liz lisa betty|alexandra alex sasha|alexander alex sasha|christopher chris kit|margaret meg maggie peggy
|robert bob rob bobby|william bill will liam|samantha sam|samuel sam|victoria vicky tori|thomas tom|richard dick rick|michael mike mick|katherine kate kathy|catherine cathy kate
|agnieszka aga agusia|malgorzata gosia malgosia|katarzyna kasia|joanna asia|zbigniew zbyszek|wladyslaw wladek|pawel pawelek|bozena bozenka
|francisco fran paco pancho curro|jose pepe|dolores lola|concepcion concha conchita|mercedes merche|guadalupe lupe|inmaculada inma|joaquin quino ximo|begona bego|ignacio nacho|inigo inaki|ruben rube
|wilhelmina mina willemijn mien|margriet griet|cornelis cor kees|hendrik henk|pieternella nel petra|liesbeth lies liesje|maarten maart|marijke rijke|sjoerd sjo|johannes hans johan hannes|sebastian basti seb bastian|matthias matze matt|maximilian max|wolfgang wolf|friedrich fritz fred|hildegard hilde|katharina kathi katrin kate kathe|stanislaw staszek stas|theresa resi|elisabeth elli lisl sissi|guenther gunter|gunther gunter|gudrun guri|andreas andi|ruediger rudi|rudiger rudi|sabine bine|annelise anne lise
|nataliya natasha natalia nataliia|tatyana tanya tatiana|yekaterina katya ekaterina katia|aleksei alexey alexei alyosha lyosha|dmitri dima mitya dmitry dmitrii|mikhail misha|sergei seryozha sergey|yuliya yulia julia iuliia juliya|kseniya ksyusha ksenia xenia|yuri yura yury iurii|nikolai kolya
|panagiotis panos takis|konstantinos kostas dinos|georgios giorgos yorgos george|dimitrios dimitris mitsos|eleftheria ria|paraskevi voula vivi evi|vasiliki vasso vaso vicky|aikaterini katerina
|giovanni gianni nanni|giuseppina pina giusi|francesca franca|alessandro sandro ale|antonella anto nella|vincenzo enzo|niccolo nico|matteo teo|ludovica ludo|chiara chiaretta
|guillaume gui|sebastien seb|francois fanfan|benoit ben|oceane oce|aurelie lilie|mathilde thilde tilde|thibault thib tibo|jean-luc jl
|torstein tor|oyvind oivind|bjorn bear|hakon haakon|ragnhild ragna|ingebjorg inge|magnus mags|kjersti kjerst|mehmet memo|aysegul ayse|ozlem ozi|raghunath raghu|rajendra raj|subramaniam subbu mani|elisabetta betta elisa lisa|lakshmi laxmi|meenakshi meena|priyanka priya
"""
_GENERIC = """university universitat universitaet universite universita universidad college academy academie institute institut instituto centre center department dept faculty school research group campus
for of the and de des du la le van der den von upon learning systems visual computing computation speech processing machine perception autonomous robotics neural cognitive decision sciences statistical language
technology science main site univ inst acad coll cntr austria belgium switzerland czechia denmark germany spain finland france greece italy netherlands norway poland sweden united kingdom people staff example http https"""
GENERIC = frozenset(_GENERIC.split())

_SHORT: dict[str, set[str]] = {}
for _line in SHORT_FORMS.replace("\n", " ").split("|"):
    _full, *_forms = _line.split()
    for _f in _forms:
        _SHORT.setdefault(_f, set()).add(_full)
_LOOK = str.maketrans(LOOKALIKES)
_PLAIN = str.maketrans(PLAIN_LETTERS)
_DIGIT = str.maketrans("015", "ols")
_LETTER_DIGIT = re.compile(r"(?<=[^\W\d_])[015]|[015](?=[^\W\d_])")
_GLUED = re.compile(r"\b((?:van|von|de|der|den|ten|ter|la|le|di|del|della)+)(?=[^\W\d_a-zà-ÿ])")
_SPLIT = re.compile(r"[^\w]+")
_SUFFIX = re.compile(r"\s(\d{4})$")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_LATIN, _OTHER = re.compile("[a-zA-ZÀ-ɏ]"), re.compile("[Ͱ-ӿ]")
_DOUBLES = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("aa", "a"))


def mend(text: str) -> str:
    """Undoes UTF-8 read as code page 1252 or Latin-1."""
    if _MOJIBAKE.search(text):
        raw = b""
        try:
            for c in text:
                raw += c.encode("cp1252") if c not in "\x81\x8d\x8f\x90\x9d" and not "\x80" <= c <= "\x9f" else c.encode("latin-1")
            return raw.decode("utf-8")
        except UnicodeError:
            return text
    return text


def fold(text: str) -> str:
    """Plain lower-case letters, look-alikes of other scripts put right in mixed words, double letters for umlauts read as one."""
    text = mend(text).lower()
    if _OTHER.search(text) and _LATIN.search(text):
        text = text.translate(_LOOK)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_PLAIN)
    for pair, one in _DOUBLES:
        text = text.replace(pair, one)
    return text


@lru_cache(maxsize=200_000)
def name_key(text: str) -> str:
    """'token token|0002': the normal form of one spelling; '' for nothing usable.

    A token that was cut short with a period keeps it.
    """
    text = mend(unicodedata.normalize("NFC", text)).replace(" ", " ").strip()
    text = re.sub(r"\s+[–—*].*$|\s*\([^)]*\)|\*+$", "", text)
    text = re.sub(r"[*]+", " ", text).strip()
    text = re.sub(r",?\s*\b(?:[MB]\.\s?(?:Sc|A|Eng)|Ph\.\s?D|Dr\.\s?(?:rer|phil|med|h)\.[\w. ]*)\.?$", "", text)
    text = _GLUED.sub(r"\1 ", text)
    number = ""
    m = _SUFFIX.search(text)
    if m:
        number, text = m.group(1), text[: m.start()]
    folded = fold(_LETTER_DIGIT.sub(lambda x: x.group().translate(_DIGIT), text))
    tokens: list[str] = []
    small: list[tuple[int, str]] = []
    for part in re.findall(r"[^\W\d_]+\.?", folded.replace("'", "").replace("’", "")):
        bare = part.rstrip(".")
        if bare in PARTICLES and part == bare:
            small.append((len(tokens), part))
            continue
        if bare in PARTICLES or bare in HONORIFICS and not (len(bare) <= 2 and part.endswith(".") and bare not in ("dr",)):
            continue
        tokens.append(part if part.endswith(".") and len(bare) > 1 else bare)
    if "," in text:  # surname first
        head = len([t for t in re.findall(r"[^\W\d_]+\.?", fold(text.split(",")[0])) if t.rstrip(".") not in PARTICLES | HONORIFICS])
        tokens = tokens[head:] + tokens[:head]
    if len(tokens) == 1 and len(small) == 1:  # what looks like a particle is half of the name
        tokens.insert(small[0][0], small[0][1])
    return " ".join(tokens) + "|" + number if tokens else ""


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


#: What the longest-common-subsequence ratio of two tokens counts at most where it rests on an initial, on a token cut
#: short, on a short form of a name or on rn for m.
INITIAL, CUT, SHORT = 0.6, 0.8, 0.95


@lru_cache(maxsize=500_000)
def token_match(a: str, b: str) -> tuple[float, bool]:
    """(ratio, slip): twice the longest common subsequence of two tokens over their lengths, 0 where it leaves out more
    than one letter of either; slip tells that it leaves out one.

    Of an initial, or a token cut short, only the letters it gives are compared; short forms compare as the full form.
    """
    if a == b:
        return 1.0, False
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if len(x) == 1:
        return INITIAL * lcs(x, y[0]), False
    if x == y:
        return 1.0, False
    if x.replace("rn", "m") == y.replace("rn", "m") or y in _SHORT.get(x, ()) or x in _SHORT.get(y, ()) or _SHORT.get(x, set()) & _SHORT.get(y, set()):
        return SHORT, False
    if a.endswith(".") and y.startswith(x):
        return CUT, False
    common = lcs(x, y) if len(x) >= 4 and len(y) - len(x) <= 1 else 0
    if len(x) + len(y) - 2 * common <= 2:
        return 2 * common / (len(x) + len(y)), True
    return 0.0, False


def name_match(a: str, b: str) -> tuple[float, bool]:
    """(ratio, slip) of two name keys; 0 if they can't be one name.

    Every token of the shorter name must find its own in the longer; at least one pair must be of full words of four
    letters that no initial explains, unless all tokens are equal words of two letters or more and none is left over. The
    ratio is the mean longest-common-subsequence ratio of the aligned tokens, less a little for tokens left over. slip
    tells that some token only agrees but for a slip.
    """
    ta, _, na = a.partition("|")
    tb, _, nb = b.partition("|")
    if na and nb and na != nb:
        return 0.0, False
    x, y = ta.split(), tb.split()
    if len(x) > len(y):
        x, y = y, x
    if len(x) < 2:
        return (1.0, False) if x == y and len(x) and len(x[0]) > 3 else (0.0, False)
    free, total, solid, slips, bare, equal = list(y), 0.0, 0, 0, False, True
    for t in sorted(x, key=len, reverse=True):
        best, slip, at, top = 0.0, False, -1, 0.0
        for i, u in enumerate(free):
            m, s = token_match(t, u)
            if m and (rank := 0.9 if s else m) > top:
                best, slip, at, top = m, s, i, rank
        if at < 0:
            return 0.0, False
        u = free.pop(at)
        total += best
        slips += slip
        whole = slip or best >= SHORT
        solid += whole and min(len(t.rstrip(".")), len(u.rstrip("."))) >= 4
        equal = equal and best == 1 and len(t) > 1
        bare = bare or best == INITIAL and len(t) >= 4
    if not solid and not (equal and not free) or slips > 2 or slips == 2 and min(map(len, x)) < 5:
        return 0.0, False
    if bare and y[-1] in free:
        return 0.0, False  # a whole word went with an initial while the family name is left over
    return total / len(x) - 0.02 * len(free), slips > 0


_ORCID = re.compile(r"(?<!\d)(\d{4})[^0-9A-Za-z]{0,3}(\d{4})[^0-9A-Za-z]{0,3}(\d{4})[^0-9A-Za-z]{0,3}(\d{3}[0-9Xx])(?!\d)")


def clean_orcid(text: str | None) -> str:
    """The sixteen signs of an identifier, however they are parted; '' for placeholders and other texts."""
    m = _ORCID.search(text or "")
    s = "".join(m.groups()).upper() if m else ""
    return s if len(set(s)) > 2 else ""


def homepage_key(text: str | None) -> tuple[str, str]:
    """(host without www and people, user without digits at the end) of a personal page; '' where there is none."""
    m = re.match(r"\s*(?:https?:)?//([^/\s]+)/?(?:[^\s]*?/)?~?([^/\s?#]*)", (text or "").strip().lower().replace("/index.html", "").rstrip("/"))
    if not m or not m.group(2):
        return "", ""
    host = re.sub(r"^(?:www\.|people\.|ai\.)+", "", m.group(1))
    return host, m.group(2).lstrip("~").rstrip("0123456789").strip("-")


def place_words(texts: list[str], host: str = "") -> list[str]:
    """The distinctive folded words of affiliations, and of the host of a homepage."""
    out = set()
    for t in texts:
        out.update(w for w in _SPLIT.split(fold(t)) if len(w) >= 4 and w not in GENERIC and not w.isdigit())
    out.update(w for w in _SPLIT.split(fold(host.partition(".")[0])) if len(w) >= 4 and w not in GENERIC and not w.isdigit())
    return sorted(out)


FEATURES = "key string, kind string, spellings array<string>, names array<string>, places array<string>, orcid string, host string, user string"


def describe(records: DataFrame) -> DataFrame:
    """The features of raw records (key, kind, spellings array, affiliations array, orcid, homepage).

    Null and blank spellings are left out; a record without a usable name keeps an empty list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, kind, spellings, affiliations, orcid, homepage in b[["key", "kind", "spellings", "affiliations", "orcid", "homepage"]].itertuples(index=False):
                own = [s for s in spellings if s and s.strip()] if spellings is not None else []
                host, user = homepage_key(homepage)
                names = sorted({k for k in map(name_key, own) if k})
                rows.append((key, kind, own, names, place_words([a for a in affiliations if a] if affiliations is not None else [], host), clean_orcid(orcid), host, user))
            yield pd.DataFrame(rows, columns=["key", "kind", "spellings", "names", "places", "orcid", "host", "user"])

    return records.mapInPandas(run, FEATURES)


def mark_wide_places(features: DataFrame, towns: DataFrame | None = None, share: float = 0.001, least: int = 30, most_towns: int = 50_000) -> DataFrame:
    """Features with ~ before place words that name a town rather than an institution.

    towns (name) lists the names of towns; at most most_towns of them are sent along, a longer list is an error.
    Without a list the words count that more than `share` of the records, and more than `least`, have: there are at
    most 1 / share times the mean number of words of a record, whatever the number of records.
    """
    if towns is not None:
        names = [r[0] for r in towns.select("name").filter("name <> ''").distinct().limit(most_towns + 1).collect()]
        if len(names) > most_towns:
            raise ValueError(f"more than {most_towns} towns")
        wide = place_words(names)
    else:
        most = max(least, int(features.count() * share))
        wide = [r["w"] for r in features.select(F.explode("places").alias("w")).groupBy("w").count().filter(F.col("count") > most).select("w").collect()]
    if not wide:
        return features
    listed = features.sparkSession.sparkContext.broadcast(frozenset(wide))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(places=[["~" + w if w in listed.value else w for w in ws] for ws in b["places"]])

    return features.mapInPandas(run, FEATURES)


def _pipe(c: str) -> Column:
    return F.split(F.coalesce(F.col(c), F.lit("")), r"\|")


def candidate_records(candidates: DataFrame, with_orcid: bool = True) -> DataFrame:
    """Raw records of the candidates; key is c and cand_id."""
    return candidates.select(
        F.concat(F.lit("c"), F.col("cand_id")).alias("key"), F.lit("c").alias("kind"), F.array("name").alias("spellings"), F.array("affiliation").alias("affiliations"),
        (F.col("orcid") if with_orcid else F.lit("")).alias("orcid"), F.col("homepage").alias("homepage"),
    )


def person_records(persons: DataFrame) -> DataFrame:
    """Raw records of the person index; key is d and pid."""
    return persons.select(
        F.concat(F.lit("d"), F.col("pid")).alias("key"), F.lit("d").alias("kind"), F.concat(F.array("primary_name"), _pipe("aliases")).alias("spellings"),
        F.concat(_pipe("affiliations_current"), _pipe("affiliations_former"), _pipe("affiliations_phd")).alias("affiliations"), F.col("orcid").alias("orcid"), F.col("homepage").alias("homepage"),
    )


def town_names(cities: DataFrame) -> DataFrame:
    """(name) of the cities of a list, their other names included."""
    return cities.select(F.explode(F.concat(F.array("city"), _pipe("alt_names"))).alias("name")).filter("name <> ''")


def checked_records(checked: DataFrame, institutions: DataFrame) -> DataFrame:
    """Raw records of the checked rosters that carry a dblp_name; key is k and check_id. The institution is looked up."""
    home = institutions.filter("inst_id is not null").select("inst_id", F.array("name", "homepage").alias("affiliations")).dropDuplicates(["inst_id"])
    own = checked.filter(F.length(F.trim(F.coalesce("dblp_name", F.lit("")))) > 0).join(home, "inst_id", "left")
    return own.select(F.concat(F.lit("k"), F.col("check_id")).alias("key"), F.lit("k").alias("kind"), F.array("dblp_name").alias("spellings"), "affiliations", F.lit("").alias("orcid"), F.lit("").alias("homepage"))
