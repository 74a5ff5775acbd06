"""Multi-task training table (#97–99) and its per-sequence label vectors (#71, #81)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.functions import columns as C
from lineax.operators import aggs, filters, joins, models, setops, windows
from lineax.operators.features import task_vectors
from lineax.operators.sequences import base_table, edit_facts, edit_gap_counts, edit_ids, with_facts, with_texts
from lineax.session import materialize, materialize_parts, read_alone, written_alone

# Fixed values of the reference runs.
NEGATIVE_SOURCES = ["SARS convalescents", "WT-engineered"]
BA286_PANGO = ["BA.2.86", "BA.2.86.1", "JN.1", "JN.2"]
VARIANTS = {
    "oct24": dict(cutoff="2024-10-07", thresh="2024-10-07", target="D614G", exclude_clades=(),
                  fitness_mult=2.0, recent_mult=1.0),
    "all_span": dict(cutoff="2023-11-01", thresh="2019-11-01", target="D614G", exclude_clades=("recombinant",),
                     fitness_mult=1.0, recent_mult=2.0),
    "sliding": dict(cutoff=None, thresh="2022-01-01", target="BA.2", exclude_clades=("recombinant",),
                    fitness_mult=1.0, recent_mult=2.0),
}


# 97
def escape_task_edits(escape: DataFrame, targets: Sequence[str] | None = None,
                      negative_sources: Sequence[str] = NEGATIVE_SOURCES, ic50_max: float = 10.0,
                      q: float = 0.95) -> DataFrame:
    """(group, data_group, outcome, base, position, mutant) from antibody-escape measurements.

    Filters come before scaling: source exclusion (NULL sources kept), IC50 < max,
    target list.  Outcome = log10(escape * potency + 1) scaled per epitope group
    by (x - min) / (p95 - min), clipped to [0, 1].  The sequence is an edit of
    its target's backbone (``operators.sequences``).  Rows that the filters leave
    are written before the scaling, which reads them several times.
    """
    e = filters.exclude_members(escape, "source", negative_sources)
    e = filters.threshold_filter(e, "ic50", "<", ic50_max)
    e = C.rename_select(e, {"target_virus": "target", "mutation": "mutant", "site": "position"})
    if targets is not None:
        e = filters.keep_members(e, "target", targets)
    e = C.compose_key(e, ["target", "group"], "_", "group")
    e = C.compose_key(e, ["target", "condition"], "_", "data_group")
    e = C.potency_weighted_escape(e, "mut_escape", "neg_log_ic50", "mut_escape_w")
    e = C.log_transform(e, "mut_escape_w", "outcome_pre", base=10, pseudo=1.0)
    e = materialize(e.select("group", "data_group", "outcome_pre", "target", "position", "mutant"), "escape_values")
    e = windows.scale_within_group(e, "group", "outcome_pre", q, "outcome")
    return e.select("group", "data_group", "outcome", F.col("target").alias("base"), "position", "mutant")


def escape_task_table(escape: DataFrame, refs: DataFrame, targets: Sequence[str] | None = None,
                      negative_sources: Sequence[str] = NEGATIVE_SOURCES, ic50_max: float = 10.0,
                      q: float = 0.95) -> DataFrame:
    """(group, data_group, outcome, seq): the rows of ``escape_task_edits`` with the mutant residue
    substituted at the (gapped) site of the target's backbone."""
    e = escape_task_edits(escape, targets, negative_sources, ic50_max, q).withColumnRenamed("base", "target")
    e = joins.backbone_join(e, refs.select("target", "seq"), "target")
    e = C.apply_substitution(e, "seq", "position", "mutant")
    return e.select("group", "data_group", "outcome", "seq")


def escape_task_counts(escape: DataFrame, refs: DataFrame, targets: Sequence[str] | None = None,
                       negative_sources: Sequence[str] = NEGATIVE_SOURCES, ic50_max: float = 10.0,
                       q: float = 0.95) -> DataFrame:
    """(group, data_group, outcome, count_x, count_hyphen): the rows of ``escape_task_table`` with the gap counts
    of their sequence, which is not built."""
    e = escape_task_edits(escape, targets, negative_sources, ic50_max, q)
    backbones = C.gap_counts(refs.select(F.col("target").alias("base"), "seq"), "seq").withColumn("size", F.length("seq"))
    e = joins.backbone_join(e, materialize(backbones, "backbones"), "base")
    return edit_gap_counts(e).select("group", "data_group", "outcome", "count_x", "count_hyphen")


# 98
def fitness_task_table(fitness: DataFrame, min_country: int = 300, pango_members: Sequence[str] = BA286_PANGO,
                       new_clade: str = "BA.2.86", lo: float = 0.001, hi: float = 0.999, seq: str = "seq") -> DataFrame:
    """(group, data_group, outcome, seq, date_first, clade, country) from per-country fitness rows;
    ``seq`` names the column of the sequence, or of its name.

    Countries with fewer than ``min_country`` rows go first; the global
    quantiles of ln(relative_re) are taken after that filter.
    """
    f = aggs.filter_groups_by_size(fitness, "country", min_country)
    f = C.recode_members(f, "clade", pango_members, new_clade, key="pango")
    f = C.log_transform(f, "relative_re", "relative_re_log")
    f = windows.quantile_normalise(f, "relative_re_log", lo, hi, "outcome")
    f = C.tag_source(f, "group", "fitness")
    f = f.withColumn("data_group", F.concat(F.lit("fitness_"), F.col("country")))
    return f.select("group", "data_group", "outcome", seq, F.col("date_first").cast("date").alias("date_first"),
                    "clade", "country")


# 99
def training_table(escape_edits: DataFrame, fitness_refs: DataFrame, texts: DataFrame, cutoff: str, thresh: str,
                   fitness_mult: float = 2.0, recent_mult: float = 1.0, exclude_clades: Sequence[str] = (),
                   k: int = 5, fold_id: int = 0, seed: int = 13, max_x: int = 5, max_gap: int = 30) -> DataFrame:
    """Combined task rows with row_id, task_id, seq_id, weight, split_class and split.

    ``escape_edits``: rows of ``escape_task_edits``; ``fitness_refs``: rows of
    ``fitness_task_table(seq="base")``; ``texts``: (base, seq), the backbones and
    sequences that they name.

    Order of steps: union → seeded numbering → gap filter → ids → weights →
    split class → cutoff split → clade exclusion (past rows only) → stratified folds
    (test = fold ``fold_id`` of ``k``; the rest re-split in 4, first = val).
    Rows on/after the cutoff are labelled ``future``.

    Task rows travel with a name and an edit, never the text: texts are built
    once per distinct edit, for digests and gap counts, and attached at the end.
    """
    return _training_table(lambda: setops.union_by_name_fill(fitness_refs, escape_edits), texts, cutoff, thresh, fitness_mult, recent_mult,
                           exclude_clades, k, fold_id, seed, max_x, max_gap)


def _training_table(union: Callable[[], DataFrame], texts: DataFrame, cutoff: str, thresh: str, fitness_mult: float, recent_mult: float,
                    exclude_clades: Sequence[str], k: int, fold_id: int, seed: int, max_x: int, max_gap: int) -> DataFrame:
    """The steps of ``training_table``; each step's tables go when the next one has its own."""
    cols = ["group", "data_group", "outcome", "date_first", "clade", "country"]
    bases = base_table(texts)

    def numbered_rows() -> DataFrame:
        narrow = read_alone(permuted).select(*cols, "row_id", F.inline("ids"))
        return windows.dense_ids(narrow, "data_group", "task_id")

    def permuted() -> DataFrame:
        narrow = written_alone(with_sequences, "task_sequences")
        keys = ["group", "data_group", "outcome", "z1", "z2", "date_first", "clade", "country"]
        return windows.shuffle_and_number(narrow, keys, seed, "row_id", written=True, keep=[*cols, "ids"], halvings=1)

    def with_sequences() -> DataFrame:
        rows = written_alone(lambda: union().select(*cols, "base", "position", "mutant"), "task_edits")
        facts = edit_facts(rows, bases)
        ids = edit_ids(facts, bases, max_x, max_gap)
        # All that a row gets to know of its sequence, by its digest; no ids where the gap filter drops it.
        known = ids.groupBy("z1", "z2").agg(F.collect_list(F.struct("seq_id", "count_x", "count_hyphen", "bid", "position", "mutant")).alias("ids"))
        told = materialize(facts.select("base", "position", "mutant", "z1", "z2").join(known, ["z1", "z2"], "left"), "edit_sequences")
        return with_facts(rows, told).drop("base", "position", "mutant")

    def split_rows() -> DataFrame:
        # Half of the rows at a time meets its labels, so half is shuffled at a time.
        rows = labelled_rows()
        return materialize_parts([rows.where(F.col("row_id") % 2 == i) for i in range(2)], "split_rows")

    def labelled_rows() -> DataFrame:
        # Weights (one scalar aggregation) and the fold keys read these rows:
        # write them once instead of recomputing the ids.
        numbered = written_alone(numbered_rows, "task_rows")
        narrow = models.loss_weights(numbered, cutoff, thresh, fitness_mult, recent_mult)
        cls = F.when(F.col("major_group") == "fitness", F.concat(F.col("data_group"), F.lit("_"), F.col("clade"))) \
            .otherwise(F.col("data_group"))
        narrow = narrow.withColumn("split_class", cls)
        past, future = filters.split_by_cutoff(narrow, "date_first", cutoff)
        if exclude_clades:
            past = filters.exclude_members(past, "clade", exclude_clades)
        past = windows.fold_split(past, fold_id, "split_class", ["row_id"], k, 4, seed, "split", written=True)
        return past.unionByName(future.withColumn("split", F.lit("future")))

    return with_texts(read_alone(split_rows), bases).drop("bid", "position", "mutant")


def training_variant(name: str, escape: DataFrame, fitness: DataFrame, texts: DataFrame, negative_sources: Sequence[str] = NEGATIVE_SOURCES,
                     min_country: int = 300, pango_members: Sequence[str] = BA286_PANGO, k: int = 5, fold_id: int = 0, seed: int = 13,
                     max_x: int = 5, max_gap: int = 30, **changes) -> DataFrame:
    """The training table of a reference run (``VARIANTS``), from escape measurements, fitness rows that
    name their sequence in ``base``, and the texts; ``changes`` replace settings of the run."""
    run = VARIANTS[name] | changes

    def union() -> DataFrame:
        refs = fitness_task_table(materialize(fitness, "measured"), min_country, pango_members, seq="base")
        return setops.union_by_name_fill(refs, escape_task_edits(escape, [run["target"]] if run["target"] else None, negative_sources))

    return _training_table(union, texts, run["cutoff"], run["thresh"], run["fitness_mult"], run["recent_mult"], run["exclude_clades"],
                           k, fold_id, seed, max_x, max_gap)


def dedupe_cells(rows: DataFrame) -> DataFrame:
    """One label per (seq_id, task_id): the highest row id wins (last write)."""
    return aggs.dedupe_keep_first(rows, ["seq_id", "task_id"], [F.col("row_id")], keep="last")


def chunked_task_vectors(rows: DataFrame, n: int = 10, seed: int = 13) -> DataFrame:
    """(seq_id, chunk, labels): each sequence's labels in disjoint chunks of at most ``n``."""
    cells = dedupe_cells(rows.select("seq_id", "task_id", "outcome", "weight", "row_id"))
    cells = windows.task_chunks(cells, "seq_id", "task_id", n, seed, "chunk")
    return task_vectors(cells, by=("chunk",))


def prediction_table(vectors: DataFrame, make_scorer, input_col: str, n_tasks: int, width: int, batch_size: int = 4,
                     labels: str = "labels", keep: Sequence[str] = ("seq_id",)) -> DataFrame:
    """One row per labelled cell with its predicted_outcome, for test or future sequences.

    ``vectors``: sequences with their encoding and label vector (``task_vectors``, whose ``carry``
    columns stand for the columns of the label rows).  Each sequence is scored once, and its labels pick
    their task's score where they are: unlabelled tasks give no row, and nothing is joined or shuffled.
    """
    scored = models.score_batch(vectors, make_scorer, input_col, n_tasks, width, batch_size, "__scores")
    fields = vectors.schema[labels].dataType.elementType.names
    cells = F.transform(labels, lambda x: F.struct(*[x[f].alias(f) for f in fields], F.get("__scores", x["task_id"].cast("int")).alias("predicted_outcome")))
    return scored.select(*keep, F.inline(cells))
