"""Surveillance records → haplotypes → per-country growth → fitness table (#90–92, #82).

One lazy DAG per stage; the only driver round-trips are scalar statistics
(first/last day, reference haplotype id, country list) and fitted coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.functions.columns import day_index_and_bin
from lineax.operators import aggs, filters, growth, joins, windows
from lineax.operators.ordinal import with_global_ordinal
from lineax.session import materialize


def sample_mutations(samples: DataFrame, muts: DataFrame, gene: str = "S:", name: str = "seq_name") -> DataFrame:
    """One row per sample name: copies (its sample rows) and muts (its distinct mutations of ``gene``
    with their numbers of rows; empty without any).

    The only pass over the mutation table: equal rows are counted before the shuffle, so an
    array is bounded by a sample's distinct mutations.  Written once.
    """
    m = filters.keep_gene(muts, "mut", gene).groupBy(name, "mut").agg(F.count(F.lit(1)).alias("n"))
    m = m.groupBy(name).agg(F.collect_list(F.struct("mut", "n")).alias("muts"))
    copies = samples.groupBy(name).agg(F.count(F.lit(1)).alias("copies"))
    none = F.array().cast("array<struct<mut:string,n:bigint>>")
    both = copies.join(m, name, "left").select(name, "copies", F.coalesce("muts", none).alias("muts"))
    return materialize(both, "sample_mutations")


# 90
def build_haplotypes(samples: DataFrame, muts: DataFrame, min_mut: int = 100, min_hap: int = 20,
                     gene: str = "S:", name: str = "seq_name", country: str = "country",
                     per_sample: DataFrame | None = None) -> DataFrame:
    """(seq_name, haplotype, hap_id, country) from frequent mutations.

    * mutations of ``gene`` only; samples without any get a NULL mutation (right join);
    * a mutation is frequent with > ``min_mut`` rows — the NULL "no mutation" group
      included, and it is matched NULL-safely, so unmutated samples become ``NA``
      only when there are enough of them;
    * a sample whose mutations are all rare disappears;
    * haplotype ids ``hap_<n>`` number the distinct strings from 1 in sorted order;
    * a haplotype is kept if it has >= ``min_hap`` samples in any one country.
    Duplicate sample rows multiply the counts before de-duplication, as upstream.
    ``per_sample`` is the table of ``sample_mutations``, when it is there already.
    """
    per = sample_mutations(samples, muts, gene, name) if per_sample is None else per_sample
    each = per.select(name, "copies", F.explode_outer("muts").alias("m")).select(name, "copies", "m.mut", "m.n")
    counts = each.groupBy("mut").agg(F.sum(F.col("copies") * F.coalesce("n", F.lit(1))).alias("rows"))
    frequent = counts.where(F.col("rows") > min_mut).select("mut")
    kept = _frequent_sets(per, frequent, name)
    hap = _with_ids(kept, "haplotype", "hap_id", "hap_").select(name, "haplotype", "hap_id")
    hap = joins.inner_join_keep_multiplicity(hap, samples.select(name, country), name)
    common = aggs.count_having(hap, ["hap_id", country], min_hap).select("hap_id").distinct()
    return joins.keys_filter(hap, common, "hap_id")


# 91
def build_all_mutation_haplotypes(samples: DataFrame, muts: DataFrame, gene: str = "S:", name: str = "seq_name",
                                  per_sample: DataFrame | None = None) -> DataFrame:
    """(seq_name, haplotype_all, hap_all_id) without any frequency filter.

    ``samples`` are usually those that kept a haplotype: ids number their strings only.
    ``per_sample`` is a table of ``sample_mutations`` over at least these samples.
    """
    if per_sample is None:
        per = sample_mutations(samples, muts, gene, name)
    else:
        per = joins.semi_join(per_sample, samples.select(name), name)
    sets = per.select(name, F.transform("muts", lambda m: m["mut"]).alias("set"))
    return _with_ids(sets, "haplotype_all", "hap_all_id", "hap_all_").select(name, "haplotype_all", "hap_all_id")


def _frequent_sets(per: DataFrame, frequent: DataFrame, name: str, max_literal: int = 10_000) -> DataFrame:
    """(name, set) of the samples that have a frequent mutation, or none at all if that is frequent.

    Few enough frequent mutations are literals, and each sample's array is filtered where it is, without a shuffle.
    """
    few = joins.few_keys(frequent, max_literal)
    if few is None:
        each = per.select(name, F.explode_outer(F.transform("muts", lambda m: m["mut"])).alias("mut"))
        kept = joins.keys_filter(each, frequent, "mut", null_safe=True, max_literal=0)
        return kept.groupBy(name).agg(F.collect_list("mut").alias("set"))
    values = [v for v in few if v is not None]
    own = F.transform("muts", lambda m: m["mut"])
    sets = per.select(name, "muts", (F.filter(own, lambda m: m.isin(values)) if values else F.array().cast("array<string>")).alias("set"))
    bare = (F.size("muts") == 0) if len(values) < len(few) else F.lit(False)
    return sets.where((F.size("set") > 0) | bare).select(name, "set")


def _with_ids(sets: DataFrame, text: str, ident: str, prefix: str) -> DataFrame:
    """``sets`` (with an array ``set``) with the set's canonical string and its id, 1.. in the strings' order.

    Rows are told apart by set digests; strings are made and sorted for distinct sets only.
    """
    coded = sets.select("*", *aggs.set_digest(F.col("set")))
    named = with_global_ordinal(aggs.set_dictionary(coded, "set", text), [text], "_n", salt=False)
    named = named.select(*aggs.DIGEST_SALTS, text, F.concat(F.lit(prefix), (F.col("_n") + 1).cast("string")).alias(ident))
    return joins.lookup_join(coded.drop("set"), named, list(aggs.DIGEST_SALTS))


@dataclass
class Stage:
    """Samples with haplotype and day bin (``rows``), written once and reused by the fit and the report;
    ``mutations`` is the table of ``sample_mutations``."""

    rows: DataFrame
    haplotypes: DataFrame
    max_bin: int
    ref_hap: str | None
    mutations: DataFrame


def prepare(samples: DataFrame, muts: DataFrame, ref_clade: str, min_mut: int = 100, min_hap: int = 20,
            bin_size: int = 1) -> Stage:
    per_sample = sample_mutations(samples, muts)
    haps = build_haplotypes(samples, muts, min_mut, min_hap, per_sample=per_sample)
    rows = samples.join(haps.select("seq_name", "hap_id"), "seq_name", "inner")
    rows = aggs.dedupe_keep_first(rows, "seq_name", ["sample_id"])
    rows = materialize(rows.where(F.col("collection_date").isNotNull()), "samples_with_haplotype")
    lo, hi = rows.agg(F.min("collection_date"), F.max("collection_date")).first()
    rows = day_index_and_bin(rows, "collection_date", bin_size, bounds=(lo, hi))
    ref = aggs.reference_haplotype(rows, ref_clade, "country", "hap_id", "clade").first()
    if bin_size == 1:  # the last day is the last bin
        max_bin = (hi - lo).days + 1 if hi else 0
    else:
        max_bin = rows.agg(F.max("day_bin")).first()[0] or 0
    return Stage(rows, haps, int(max_bin), ref["hap_id"] if ref else None, per_sample)


def growth_table(stage: Stage, min_total: int = 20, bin_size: int = 1, gen_time: float = 2.1,
                 max_iter: int = 100, tol: float = 1e-10):
    """(relative_re per country and haplotype, design, coefficients)."""
    return growth.lineage_growth(stage.rows, stage.ref_hap, stage.max_bin, min_total=min_total, bin_size=bin_size, gen_time=gen_time, max_iter=max_iter, tol=tol)


# 92
def representative_table(stage: Stage, all_haps: DataFrame, coef_table: DataFrame, seed: int = 42) -> DataFrame:
    """One representative sample per haplotype (from its commonest full haplotype), joined to
    the fitted relative_re and the robust first-seen date, sorted by relative_re.
    """
    rows = stage.rows.join(all_haps.select("seq_name", "hap_all_id"), "seq_name", "inner")
    # Read by three aggregations and the pick.
    rows = materialize(rows.select("seq_name", "hap_id", "hap_all_id", "collection_date", "clade", "pango"), "rows_with_full_haplotype")
    first = aggs.first_seen_quantile(rows, "hap_id", "collection_date", 0.01, "date_first")
    pair_counts = rows.groupBy("hap_id", "hap_all_id").agg(F.count(F.lit(1)).alias("n"))
    major = windows.top_one_per_group(pair_counts, "hap_id", "n", "hap_all_id").select("hap_id", "hap_all_id")
    cand = joins.lookup_join(rows, major, ["hap_id", "hap_all_id"])
    rep = windows.sample_one_per_group(cand.select("hap_id", "seq_name", "clade", "pango"), "hap_id", "seq_name", seed)
    info = stage.haplotypes.select("hap_id", "haplotype").distinct()
    rep = rep.join(info, "hap_id", "inner")
    merged = coef_table.select("hap_id", "relative_re", "country", "converged").join(rep, "hap_id", "inner")
    merged = merged.join(first, "hap_id", "left")
    return merged.select("hap_id", "relative_re", "country", "seq_name", "clade", "pango", "haplotype",
                         "date_first", "converged").orderBy(F.desc("relative_re"), "country", "hap_id")
