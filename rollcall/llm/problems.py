"""The subpackage's pN_ queries, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.canonical import map_titles_and_places
from rollcall.llm.linkage import link_candidates
from rollcall.llm.mixing import fit_mix, mix_documents, mix_report
from rollcall.llm.packing import fill_report, pack_documents
from rollcall.llm.persons import candidate_records, checked_records, person_records, town_names
from rollcall.llm.sentences import split_sentences
from rollcall.llm.variants import linked_variants
from rollcall.session import cut, table


def p1_scored(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without a sure match, with the indexed person found and the confidence."""
    return link_candidates(table(spark, d, "candidates_csrankings"), table(spark, d, "dblp_persons"), town_names(table(spark, d, "city_list")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without a sure match, with the indexed person found."""
    return p1_scored(spark, d).select("cand_id", "pid")


def p4_scored(spark: SparkSession, d: str) -> DataFrame:
    """Typed titles and cities with their entry and score."""
    return map_titles_and_places(*(table(spark, d, t) for t in ("roster", "institutions_geocoded", "titles", "city_list")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed titles and cities with their entry, 0 where they name none."""
    return p4_scored(spark, d).select("field_name", "row_key", "canon_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of one person under different spellings."""
    people, index, checked, places = (table(spark, d, t) for t in ("candidates_csrankings", "dblp_persons", "roster_checked", "institutions_geocoded"))
    return linked_variants(candidate_records(people).unionByName(person_records(index)).unionByName(checked_records(checked, places)), town_names(table(spark, d, "city_list")))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Where every piece of every document lies, for each capacity."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p6_packed(spark, d), table(spark, d, "pack_capacities"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches, by label and by posterior."""
    targets = table(spark, d, "mix_targets")
    return mix_report(cut(fit_mix(table(spark, d, "documents"), targets)), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return split_sentences(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_scored": p1_scored, "p5_found": p5_found, "p4_found": p4_found, "p4_scored": p4_scored, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
