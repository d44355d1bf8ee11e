"""Mapping free-entered values to a canonical list (problem 4).

Values and entries become sets of letter pairs. Titles are also read with their words spelled out, by rule, from the words of
the list. The join orders tokens by their rarity over all rows, meets sets only
on the rare tokens of their prefixes, drops pairs by length and by position, verifies the Jaccard similarity exactly
and keeps the best entry of each value. Values are joined once per distinct spelling and group.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.normalize import PLAIN_LETTERS
from rollcall.llm.persons import lcs, mend
from rollcall.session import cut

# Official abbreviations of titles that no rule gives, by the folded local title.
TITLE_FORMS = {
    "juniorprofessor": "jprof", "ausserplanmassiger professor": "apl prof", "privatdozent": "pd|priv doz", "akademischer oberrat": "aor", "wissenschaftlicher mitarbeiter": "wiss ma",
    "ordentlicher professor": "o prof", "maitre de conferences": "mcf", "directeur de recherche": "dr2", "ricercatore a tempo determinato": "rtd a|rtd b", "profesor titular de universidad": "tu",
    "universitair hoofddocent": "uhd", "universitair docent": "ud", "forsteamanuensis": "1 amanuensis", "postdoctoral researcher": "postdoc", "profesor zwyczajny": "prof zw",
}
# Small words, which abbreviations leave out.
SMALL_WORDS = frozenset("a al the of for in de des du d di da del della la le el y der die das und van voor i s et and at to no".split())
# What people write around a place.
PLACE_DECOR = r"^(?:greater|region|lower|upper|inner|outer|metropolitan area of|metro|city of|area of|gemeinde|comune di) | (?:cedex(?: \d+)?|building \d+|campus [a-z]+|main site|science park|harbour site|region|area)$"
# Country names that follow a place.
COUNTRY_NAMES = "austria belgium switzerland czechia denmark germany spain finland france greece italy netherlands norway poland sweden|united kingdom"
# Short forms at the beginning of place names.
PLACE_FORMS = (("st ", "saint "), ("st ", "sankt "), ("s ", "san "), ("ste ", "sainte "))


def letter_pairs(c: Column) -> Column:
    """The distinct padded letter pairs of each word of folded text, whatever the order of the words."""
    words = F.filter(F.split(c, " "), lambda w: w != "")

    def pairs(w: Column) -> Column:
        padded = F.concat(F.lit("^"), w, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))

    return F.array_distinct(F.flatten(F.transform(words, pairs)))


def similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def _ranked(sets: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """(grp, id, n, token, pos): the prefix of each set in order of global rarity."""
    each = sets.select("grp", "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(rarity, "token")
    ordered = each.groupBy("grp", "id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    return ordered.select("grp", "id", "n", F.posexplode(F.slice("o", 1, keep)).alias("pos", "t")).select("grp", "id", "n", "pos", F.col("t.token").alias("token"))


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(grp, left_id, right_id, jaccard) of all pairs of one group with Jaccard similarity of at least threshold.

    left and right hold (grp, id, tokens array<string>), each (grp, id) once and tokens distinct. Empty sets and null
    groups or ids match nothing. The result is complete; nothing is capped.
    """
    left, right = (x.filter(F.col("grp").isNotNull() & F.col("id").isNotNull() & (F.size("tokens") > 0)) for x in (left, right))
    rarity = left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("seen"))
    a = _ranked(left, rarity, threshold).select("grp", "token", F.col("id").alias("left_id"), F.col("n").alias("na"), F.col("pos").alias("i"))
    b = _ranked(right, rarity, threshold).select("grp", "token", F.col("id").alias("right_id"), F.col("n").alias("nb"), F.col("pos").alias("j"))
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    length = (F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("na") >= F.col("nb") * threshold - 1e-9)
    position = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= need - F.least("i", "j")
    met = a.join(b, ["grp", "token"]).filter(length & position).select("grp", "left_id", "right_id").distinct()
    full = met.join(left.select("grp", F.col("id").alias("left_id"), F.col("tokens").alias("ta")), ["grp", "left_id"])
    full = full.join(right.select("grp", F.col("id").alias("right_id"), F.col("tokens").alias("tb")), ["grp", "right_id"])
    return full.withColumn("jaccard", similarity(F.col("ta"), F.col("tb"))).filter(F.col("jaccard") >= threshold).select("grp", "left_id", "right_id", "jaccard")


def map_values(values: DataFrame, entries: DataFrame, threshold: float, accept: float, whole: float = 0.6, spelled: float = 0.85) -> DataFrame:
    """(grp, value, canon_id, score): the best entry of each distinct (grp, value); canon_id 0 where none is near enough.

    values: (grp, value, folded, full, variants array<string>), variants being folded readings of the value, the whole one
    included, full the whole one spelled out, which counts `spelled` of the whole one. entries: (grp, canon_id, form), form folded; an entry may have several forms and groups. The score is a
    mean of the best variant's Jaccard similarity and the whole value's, whole being the latter's weight; the
    entry with the largest sum of score and edit similarity is kept, at a tie the one with the smaller canon_id. threshold is the least Jaccard similarity at which a reading and an entry meet, accept the least score.
    """
    readings = values.select("grp", "value", "folded", "full", F.explode("variants").alias("id")).filter("id <> ''").distinct()
    left = cut(readings.select("grp", "id").distinct().withColumn("tokens", letter_pairs(F.col("id"))))
    right = cut(entries.select("grp", F.col("form").alias("id")).filter("form <> ''").distinct().withColumn("tokens", letter_pairs(F.col("id"))))
    near = cut(set_similarity_join(left, right, threshold))
    found = readings.join(near.withColumnRenamed("left_id", "id"), ["grp", "id"]).join(entries.withColumnRenamed("form", "right_id"), ["grp", "right_id"])
    form, folded = F.col("right_id"), F.col("folded")
    entire = F.greatest(similarity(letter_pairs(folded), letter_pairs(form)), spelled * similarity(letter_pairs(F.col("full")), letter_pairs(form)))
    found = found.withColumn("score", (1 - whole) * F.col("jaccard") + whole * F.greatest(entire, F.when(F.col("id") == folded, F.col("jaccard")).otherwise(0.0)))
    edits = lambda c: 1 - F.levenshtein(c, form) / F.greatest(F.length(c), F.length(form), F.lit(1))
    in_order = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    swapped = 1 - F.levenshtein(in_order(F.col("full")), in_order(form)) / F.greatest(F.length("full"), F.length(form), F.lit(1))
    near_by_edits = F.greatest(edits(folded), edits(F.col("full")), swapped)
    best = found.groupBy("grp", "value").agg(F.max_by(F.struct("canon_id", "score"), F.struct(F.round(F.col("score") + near_by_edits, 9), -F.col("canon_id"))).alias("b"))
    out = values.select("grp", "value").distinct().join(best, ["grp", "value"], "left")
    good = F.coalesce(F.col("b.score") >= accept, F.lit(False))
    return out.select("grp", "value", F.when(good, F.col("b.canon_id")).otherwise(F.lit(0)).cast("long").alias("canon_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def fold_words(text: str) -> str:
    """Lower-case words of plain letters and digits, one blank between them."""
    text = mend(text).lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_PLAIN)
    return " ".join(_WORDS.findall(text))


def stands_for(short: str, word: str) -> int:
    """How well a typed word stands for one of the list's: 5 equal, 4 a slip, 3 its beginning, 2 another ending, 1 two letters
    of it or a contraction (first and last letter, the others in order), 0 not."""
    if short == word:
        return 5
    common = lcs(short, word)
    least = min(len(short), len(word))
    if least >= 4 and len(short) + len(word) - 2 * common <= 2:
        return 4
    if len(short) >= 3 and word.startswith(short):
        return 3
    if least >= 5 and abs(len(short) - len(word)) <= 3 and common >= least - 2 and short[: common - 2] == word[: common - 2]:
        return 2
    if 2 <= len(short) < len(word) and (word.startswith(short) or short[0] == word[0] and short[-1] == word[-1] and common == len(short)):
        return 1
    return 0


def title_variants(value: str, words: tuple[str, ...] = ()) -> tuple[str, str, list[str]]:
    """(folded whole, whole spelled out, readings) of a typed title, given the words of the entries it may be.

    Readings are the whole, the parts between marks, and of each what stands for words of the list, in their full form;
    words that stand for none are left out of those.
    """

    def clean(text: str) -> str:
        return re.sub(r"^(\d+ )?(?=[a-z]{3})", "", fold_words(text)) if not re.match(r"\s*1\W+[aA]", text) else fold_words(text)

    def spelled_out(text: str) -> str:
        out = []
        for t in text.split():
            rank, best = max(((stands_for(t, w), -len(w), w) for w in words), default=(0, 0, ""))[::2]
            if rank:
                out.append(best)
        return " ".join(out)

    whole = clean(value)
    parts = [whole, *(clean(x) for x in re.split(r"[,/()&–—;:|]| - |^\s*\*| in | of | for ", mend(value)))]
    full = [spelled_out(p) for p in parts]
    return whole, full[0], list(dict.fromkeys([whole, fold_words(value), whole.replace(" ", ""), *(x for x in [*parts, *full] if len(x) >= 2)]))


def place_fold(text: str) -> str:
    """Folded place without numbers; double letters for umlauts and rings are read as one."""
    t = re.sub(r"\b\d[\d ]*\b", " ", fold_words(text))
    for pair, one in _DOUBLES:
        t = t.replace(pair, one)
    return " ".join(t.split())


_PLAIN = str.maketrans(PLAIN_LETTERS)
_WORDS = re.compile(r"[^\W_]+")
_DOUBLES = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("aa", "a"))
_COUNTRY = re.compile(" (?:" + "|".join(place_fold(c) for c in [*COUNTRY_NAMES.split("|")[0].split(), *COUNTRY_NAMES.split("|")[1:]]) + ")$")
_PLACE_DECOR = re.compile(PLACE_DECOR)


def place_variants(value: str) -> tuple[str, str, list[str]]:
    """(folded whole, the same, readings) of a typed place: without country, number and decoration, and with long forms."""

    def strip(t: str) -> str:
        return _PLACE_DECOR.sub("", _COUNTRY.sub("", t)).strip()

    whole = place_fold(value)
    bare = strip(strip(whole))
    long = [b + bare[len(a) :] for a, b in PLACE_FORMS if bare.startswith(a)]
    parts = [strip(place_fold(x)) for x in re.split(r"[,/()–—;:|]| - ", mend(value))]
    return bare, bare, list(dict.fromkeys([bare, whole, *long, *(x for x in parts if len(x) >= 4)]))


def readings_of(distinct: DataFrame, entries: DataFrame) -> DataFrame:
    """(grp, value, folded, full, variants) of distinct (grp, value); groups that begin with t hold titles, others places.

    entries (grp, form) gives the words that titles of a group are made of.
    """
    words = entries.filter("grp like 't:%'").select("grp", F.explode(F.split("form", " ")).alias("w")).filter(F.length("w") > 3).groupBy("grp").agg(F.array_sort(F.collect_set("w")).alias("words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [title_variants(v, () if w is None else tuple(w)) if g.startswith("t") else place_variants(v) for g, v, w in zip(b["grp"], b["value"], b["words"], strict=True)]
            yield pd.DataFrame({"grp": b["grp"], "value": b["value"], "folded": [x[0] for x in both], "full": [x[1] for x in both], "variants": [x[2] for x in both]})

    return distinct.join(words, "grp", "left").select("grp", "value", "words").mapInPandas(run, "grp string, value string, folded string, full string, variants array<string>")


def title_entries(titles: DataFrame, countries: DataFrame, forms: dict[str, str] = TITLE_FORMS) -> DataFrame:
    """(grp, canon_id, form) of the list of titles; entries of XX belong to every country of `countries` (grp).

    "any professor" in title_en describes an entry and isn't a form of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for country, i, local, english in b[["country", "title_id", "title_local", "title_en"]].itertuples(index=False):
                own = fold_words(local or "")
                other = fold_words(re.sub(r"\([^)]*\)", "", english or ""))
                names = {own, "" if other.startswith("any ") else other}
                initials = {"".join(w[0] for w in x.split() if w not in SMALL_WORDS) for x in names}
                rows += [((country or "").lower(), i, f) for f in {*names, *forms.get(own, "").split("|"), *(x for x in initials if len(x) > 2 or len(x) == 2 and x not in ("dr", "mr", "ms"))} if f]
            yield pd.DataFrame(rows, columns=["grp", "canon_id", "form"])

    every = titles.mapInPandas(run, "grp string, canon_id bigint, form string")
    own = every.filter("grp <> 'xx'").withColumn("grp", F.concat(F.lit("t:"), "grp"))
    # Each group of the values takes up the shared entries; both sides are keyed, so that neither is sent along whole.
    shared = every.filter("grp = 'xx'").select(F.col("grp").alias("pool"), "canon_id", "form")
    shared = countries.select("grp", F.lit("xx").alias("pool")).distinct().join(shared, "pool").select("grp", "canon_id", "form")
    return own.unionByName(shared).distinct()


def place_entries(cities: DataFrame) -> DataFrame:
    """(grp, canon_id, form) of the list of cities, under their names and known other names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [("p:" + (c or "").lower(), i, place_fold(n)) for c, i, city, alt in b[["country", "city_id", "city", "alt_names"]].itertuples(index=False) for n in [city or "", *(alt or "").split("|")]]
            yield pd.DataFrame(rows, columns=["grp", "canon_id", "form"])

    return cities.mapInPandas(run, "grp string, canon_id bigint, form string").filter("form <> ''").distinct()


#: Least Jaccard similarity at which a reading and an entry meet, and least score at which the best entry is taken.
TITLE_LIMITS = (0.4, 0.48)
PLACE_LIMITS = (0.3, 0.4)


def map_titles_and_places(roster: DataFrame, institutions: DataFrame, titles: DataFrame, cities: DataFrame, forms: dict[str, str] = TITLE_FORMS) -> DataFrame:
    """(field_name, row_key, canon_id, score) for roster.title_verbatim and institutions' city_expected and ror_city.

    Non-blank values that are spelled exactly like an entry need no mapping and give no row; null and blank values give
    none either. The entries of a row are those of its country; a row without a country meets only the shared titles.
    """
    country = F.lower(F.trim(F.coalesce("country", F.lit(""))))
    home = institutions.filter("inst_id is not null").select("inst_id", country.alias("c")).dropDuplicates(["inst_id"])
    people = roster.select(F.col("roster_id").alias("row_key"), "inst_id", F.col("title_verbatim").alias("value")).join(home, "inst_id", "left")
    people = people.select(F.lit("title_verbatim").alias("field_name"), "row_key", F.concat(F.lit("t:"), F.coalesce("c", F.lower(F.substring_index("inst_id", "-", 1)), F.lit(""))).alias("grp"), "value")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("city_expected", "ror_city")])).alias("f")
    places = institutions.select(F.col("inst_key").alias("row_key"), F.concat(F.lit("p:"), country).alias("grp"), fields).select("f.field_name", "row_key", "grp", "f.value")
    exact_title = titles.select(F.explode(F.array("title_local", "title_en")).alias("value")).filter("value is not null").distinct()
    exact_place = cities.select(F.concat(F.lit("p:"), F.lower("country")).alias("grp"), F.col("city").alias("value")).distinct()
    full = F.length(F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)\s+", "")) > 0
    typed = people.filter(full).join(exact_title, "value", "left_anti").unionByName(places.filter(full).join(exact_place, ["grp", "value"], "left_anti"))
    typed = cut(typed)
    entries = cut(title_entries(titles, typed.filter("grp like 't:%'").select("grp").distinct(), forms).unionByName(place_entries(cities)))
    values = cut(readings_of(typed.select("grp", "value").distinct(), entries))
    kinds = [(lambda df, k=k: df.filter(F.col("grp").startswith(k)), limits) for k, limits in (("t:", TITLE_LIMITS), ("p:", PLACE_LIMITS))]
    one, two = (map_values(own(values), own(entries), *limits) for own, limits in kinds)
    mapped = one.unionByName(two)
    return typed.join(mapped, ["grp", "value"], "left").select("field_name", "row_key", F.coalesce("canon_id", F.lit(0)).cast("long").alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
