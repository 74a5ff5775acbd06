"""Surveillance files → samples: the rows that haplotypes are built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.functions import columns as C
from lineax.operators import aggs, filters, joins

# Nations counted as one country, and the rows that a country must exceed.
UK_NATIONS = ["England", "Scotland", "Wales"]
MIN_COUNTRY = 100_000


def surveillance_samples(calls: DataFrame, quality: DataFrame, records: DataFrame, date_max: str, host: str = "Human", virus: str = "hCoV-19",
                         min_country: int = MIN_COUNTRY, nations: Sequence[str] = tuple(UK_NATIONS), max_n_frac: float = 0.01) -> DataFrame:
    """Samples with seqName, country, name, collection_date and the other columns of ``calls``.

    ``calls``: one row per called sequence, named by its full header (seqName: virus/country/name/time, time:
    year|collection date|submission date); ``quality``: name (the header), length, count_n and count_stop;
    ``records``: virus_name (virus/country/name/year) and host.

    In order: quality filter; one row per header; header pieces; full dates up to ``date_max`` of ``virus`` only; records
    of ``host`` by name (each matching record gives a row); nations recoded; countries of more than ``min_country`` rows.
    """
    good = filters.quality_filter(quality, max_n_frac, 1).select(F.col("name").alias("seqName"))
    rows = joins.inner_join_keep_multiplicity(calls, good, "seqName")
    rows = aggs.dedupe_keep_first(rows, "seqName", [c for c in rows.columns if c != "seqName"])
    rows = C.split_header(rows, "seqName", "/", ["virus", "country", "name", "time"])
    rows = C.split_header(rows, "time", r"\|", ["year", "collection", "submission"]).where(F.col("virus") == virus)
    rows = C.parse_full_date(rows, "collection", date_max, "collection_date")
    hosts = C.split_header(filters.keep_equal(records, "host", host), "virus_name", "/", ["v", "c", "name", "y"]).select("name").where("name is not null")
    rows = joins.skew_join(rows, hosts, ["name"])
    rows = C.recode_members(rows, "country", list(nations), "UK")
    big = aggs.count_having(rows, "country", min_country, strict=True).select("country").where("country is not null")
    return joins.keys_filter(rows, big, "country").drop("time", "year", "collection", "submission", "virus")
