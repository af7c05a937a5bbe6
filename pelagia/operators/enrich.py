"""Joins that attach membership, genome, sample, depth and evidence to targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.geo import depth_zone
from pelagia.functions.text import depth_in_metres, genome_of_member, strip_stop_and_unknown
from pelagia.operators.ordering import ordered_index

# Sample accessions that stand for "no accession".
UNRESOLVABLE_SAMPLES = ["", "unknown_biosample", "not applicable", "na", "none"]


def wanted_only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the id list.  The list is deduplicated; Spark broadcasts it only while it is small."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def capped_target_genomes(membership: DataFrame, wanted: DataFrame, cap: int | None = None) -> DataFrame:
    """Per wanted target: member count, true genome count and its genomes in order, the first ``cap`` if given.

    The semi join runs on the first field before any member list is split.
    """
    rows = wanted_only(membership, wanted, "target_id")
    members = F.split("members", ";")
    genomes = F.array_sort(F.array_distinct(F.transform(members, lambda m: genome_of_member(m, "error"))))
    return rows.select(
        "target_id",
        F.col("size").cast("int").alias("n_members"),
        F.size(genomes).alias("n_genomes_total"),
        (genomes if cap is None else F.slice(genomes, 1, cap)).alias("genomes"),
    )


def all_target_genomes(membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every distinct (target, genome) pair of the wanted targets; malformed members are dropped."""
    rows = wanted_only(membership, wanted, "target_id")
    exploded = rows.select("target_id", F.explode(F.split("members", ";")).alias("member"))
    return exploded.select("target_id", genome_of_member(F.col("member")).alias("genome")).where("genome <> ''").distinct()


def enrich_targets(targets: DataFrame, capped: DataFrame, genomes: DataFrame, samples: DataFrame) -> DataFrame:
    """Target → cluster genomes → genome metadata → sample metadata, all kept with found flags.

    A target without genomes keeps one row; ``genome_index`` numbers genomes from 1.
    """
    opened = targets.join(capped, "target_id", "left").select(
        *targets.columns,
        "n_members",
        "n_genomes_total",
        F.when(F.col("genomes").isNull(), 0).otherwise(F.size("genomes")).alias("n_genomes_shown"),
        F.posexplode_outer("genomes").alias("_pos", "genome"),
    )
    opened = opened.withColumn("genome_index", F.col("_pos") + 1).drop("_pos")
    with_genome = opened.join(genomes.withColumn("_g", F.lit(True)), "genome", "left")
    with_sample = with_genome.join(samples.withColumn("_s", F.lit(True)), "sample_id", "left")
    return (
        with_sample.withColumn("genome_metadata_found", F.col("_g").isNotNull())
        .withColumn("sample_metadata_found", F.col("_s").isNotNull())
        .drop("_g", "_s")
    )


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    """Coverage counts of :func:`enrich_targets` in one pass.

    Each row gives its target, genome and sample, with whether they were found. Equal ones are merged map-side, so
    that all counts of different values are plain counts; several distinct counts would copy every row once for each.
    """
    parts = {"target": ("target_id", F.col("genome").isNotNull()), "genome": ("genome", F.col("genome_metadata_found")), "sample": ("sample_id", F.col("sample_metadata_found"))}
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"), flag.cast("int").alias("found")) for k, (c, flag) in parts.items()])
    merged = enriched.select(F.inline(entries)).groupBy("kind", "value").agg(F.max("found").alias("found"), F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    is_kind = lambda k: F.col("kind") == k
    return merged.agg(
        F.coalesce(F.sum(F.when(is_kind("target"), F.col("n"))), F.lit(0)).alias("n_output_rows"),
        F.count_if(known & is_kind("target")).alias("n_target_ids"),
        F.count_if(known & is_kind("target") & (F.col("found") == 1)).alias("n_targets_matched"),
        F.count_if(known & is_kind("genome")).alias("n_genomes_needed"),
        F.count_if(known & is_kind("genome") & (F.col("found") == 1)).alias("n_genomes_resolved"),
        F.count_if(known & is_kind("sample") & (F.col("found") == 1)).alias("n_samples_resolved"),
    )


def enrich_depth(rows: DataFrame, depths: DataFrame, key: str = "biosample") -> DataFrame:
    """Depth text, metres and zone by sample accession; placeholder accessions never match."""
    usable = F.when(~F.lower(F.trim(F.col(key))).isin(UNRESOLVABLE_SAMPLES), F.col(key))
    looked_up = depths.select(F.col(key).alias("_key"), F.col("depth_raw").alias("_raw"))
    joined = rows.withColumn("_usable", usable).join(looked_up, F.col("_usable") == F.col("_key"), "left")
    metres = depth_in_metres(F.col("_raw"))
    return joined.select(
        *rows.columns,
        F.coalesce("_raw", F.lit("")).alias("depth_raw"),
        metres.alias("depth_m"),
        depth_zone(metres).alias("depth_zone"),
    )


def first_row_lookup_chain(
    predictions: DataFrame, metadata: DataFrame, climate: DataFrame, manifest: DataFrame, meta_cols: Sequence[str]
) -> DataFrame:
    """Predictions with the first metadata row per target, the climate of its genome and the manifest row."""
    first = metadata.groupBy("target_id").agg(F.min_by(F.struct(*meta_cols), "ord").alias("_m"))
    with_meta = predictions.join(first.select("target_id", "_m.*"), "target_id", "left")
    return with_meta.join(climate, "genome", "left").join(manifest, "target_id", "left")


def detect_id_column(columns: Sequence[str]) -> str:
    """First column with a customary id name, else the first column."""
    # Header names that hold the sequence id.
    known = ["protein", "protein_id", "seq", "sequence", "fasta_header", "id", "header"]
    return next((c for c in columns if c.lower() in known), columns[0])


def candidate_verdicts(candidates: DataFrame, targets: DataFrame, bad_targets: DataFrame, carriers: DataFrame) -> DataFrame:
    """new / known_qc_removed / known_qc_passing by exact normalized sequence, with a genome flag.

    The join key is a hash of the sequence with the sequence itself compared again, so
    long strings are not shuffled as sort keys.
    """
    known = targets.select(F.col("target_id"), strip_stop_and_unknown(F.col("sequence")).alias("_seq"))
    known = known.groupBy("_seq").agg(F.min("target_id").alias("matched_target"))
    known = known.withColumn("_hash", F.xxhash64("_seq"))
    mine = candidates.withColumn("_cseq", strip_stop_and_unknown(F.col("sequence"))).withColumn("_chash", F.xxhash64("_cseq"))
    same = (F.col("_chash") == F.col("_hash")) & (F.col("_cseq") == F.col("_seq"))
    matched = mine.join(known, same, "left")
    bad = bad_targets.select(F.col("target_id").alias("matched_target"), F.lit(True).alias("_bad")).distinct()
    positive = carriers.select("genome", F.lit(True).alias("_has")).distinct()
    out = matched.join(bad, "matched_target", "left").join(positive, "genome", "left")
    verdict = (
        F.when(F.col("matched_target").isNull(), "new")
        .when(F.col("_bad"), "known_qc_removed")
        .otherwise("known_qc_passing")
    )
    return out.select(
        "gene_id",
        "genome",
        F.coalesce("matched_target", F.lit("")).alias("matched_target"),
        verdict.alias("verdict"),
        F.coalesce("_has", F.lit(False)).alias("genome_has_qc_passing"),
    )


SIGNED = 256  # genomes up to which a member is signed


def shared_genome_pairs(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits whose two members occur in one genome, once per shared genome; self hits left out.

    The hits are the pair list, so nothing is paired that was not aligned. A pair of members is opened by the genomes
    of the member that has fewer, and the other is asked for each, so a member of many genomes multiplies nothing; hits
    that repeat a pair come in again at the end. Members without genomes drop out before. So do pairs whose signatures,
    16 bits a genome, have nothing in common; a member of more than ``SIGNED`` genomes has none and keeps its pairs.
    """
    links = links.select("target", "genome").distinct()
    sizes = links.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.collect_set(F.shiftright(F.xxhash64("genome"), 48).cast("smallint")).alias("_s"))
    sizes = sizes.withColumn("_s", F.when(F.col("_n") <= SIGNED, F.col("_s")))
    named = hits.where(F.col("query") != F.col("target")).select("query", "target").distinct()
    sized = named.join(sizes.select(F.col("target").alias("query"), F.col("_n").alias("_nq"), F.col("_s").alias("_sq")), "query").join(sizes.withColumnsRenamed({"_n": "_nt", "_s": "_st"}), "target")
    sized = sized.where(F.coalesce(F.arrays_overlap("_sq", "_st"), F.lit(True)))
    fewer = F.col("_nq") <= F.col("_nt")
    sides = sized.select("query", "target", F.when(fewer, F.col("query")).otherwise(F.col("target")).alias("_few"), F.when(fewer, F.col("target")).otherwise(F.col("query")).alias("_many"))
    opened = sides.join(links.select(F.col("target").alias("_few"), "genome"), "_few")
    met = opened.join(links.select(F.col("target").alias("_many"), "genome"), ["_many", "genome"]).select("query", "target", "genome")
    return hits.join(met, ["query", "target"])


def near_duplicate_share(pairs: DataFrame, by: Sequence[str] = ("genome",), cut: float = 95.0) -> DataFrame:
    """Comparable pairs per group and how many are near duplicates."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("pident") >= cut).alias("n_near_duplicate"),
        (F.count_if(F.col("pident") >= cut) * 100 / F.count(F.lit(1))).alias("pct_near_duplicate"),
    )


def chord_counts(copies: DataFrame) -> DataFrame:
    """Chords of every copy: copies of its cluster in other genomes, from counts instead of pairs.

    For a copy in genome g of cluster c the number of partners is size(c) − size(c, g);
    listing the pairs themselves would grow with the square of a cluster.
    """
    per_genome = copies.groupBy("cluster_id", "genome").agg(F.count(F.lit(1)).alias("n_copies"))
    per_cluster = per_genome.groupBy("cluster_id").agg(F.sum("n_copies").alias("n_cluster_copies"))
    joined = per_genome.join(per_cluster, "cluster_id")
    return joined.withColumn("n_chords", F.col("n_copies") * (F.col("n_cluster_copies") - F.col("n_copies")))


def cluster_chord_totals(copies: DataFrame) -> DataFrame:
    """Chords per cluster: every pair of copies in different genomes counted once."""
    return chord_counts(copies).groupBy("cluster_id").agg(
        F.max("n_cluster_copies").alias("n_copies"), (F.expr("sum(n_chords) DIV 2")).alias("n_chords")
    )


def genome_chords(copies: DataFrame, genome: str) -> DataFrame:
    """Chords from the copies of one named genome to the copies of its clusters elsewhere."""
    mine = copies.where(F.col("genome") == genome).select("cluster_id", F.col("target_id").alias("target_a"))
    others = copies.where(F.col("genome") != genome).select("cluster_id", "genome", F.col("target_id").alias("target_b"))
    return others.join(mine, "cluster_id")


def agreeing_single_copy(matrix: DataFrame, links: DataFrame, count_col: str) -> DataFrame:
    """Genomes that are single-copy in the matrix and in the membership list, with a status per genome."""
    a = matrix.where(F.col(count_col) == 1).select("genome", F.lit(True).alias("_a"))
    b = links.groupBy("genome").agg(F.count_distinct("target").alias("_n")).where("_n = 1")
    joined = a.join(b.select("genome", F.lit(True).alias("_b")), "genome", "full_outer")
    status = (
        F.when(F.col("_a") & F.col("_b"), "both")
        .when(F.col("_a"), "matrix_only")
        .otherwise("membership_only")
    )
    return joined.select("genome", F.coalesce(status, F.lit("membership_only")).alias("status"))


def hybrid_flag(ids: DataFrame, structural: DataFrame, aligned: DataFrame, key: str = "target_id") -> DataFrame:
    """Structural result where there is one, else the alignment flag, else false; with its origin."""
    s = structural.select(key, F.col("flag").alias("_s"))
    a = aligned.select(key, F.col("flag").alias("_a"))
    joined = ids.select(key).distinct().join(s, key, "left").join(a, key, "left")
    origin = F.when(F.col("_s").isNotNull(), "structural").when(F.col("_a").isNotNull(), "alignment").otherwise("none")
    return joined.select(key, F.coalesce("_s", "_a", F.lit(False)).alias("flag"), origin.alias("origin"))


def disambiguate(
    entries: DataFrame, text: Column, families: Sequence[tuple[str, Sequence[str]]], note: str
) -> DataFrame:
    """Rows of a shared gene name assigned to one of two families by its terms, or to both for review."""
    (first, first_terms), (second, second_terms) = families

    def has(terms: Sequence[str]) -> Column:
        blob = F.lower(F.coalesce(text, F.lit("")))
        return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(blob, t))

    marked = entries.withColumn("_f", has(first_terms)).withColumn("_s", has(second_terms))
    one = F.when(F.col("_f") & ~F.col("_s"), F.array(F.lit(first))).when(
        F.col("_s") & ~F.col("_f"), F.array(F.lit(second))
    )
    ambiguous = F.col("_f") == F.col("_s")
    return marked.select(
        *entries.columns,
        F.explode(F.coalesce(one, F.array(F.lit(first), F.lit(second)))).alias("family"),
        ambiguous.alias("needs_manual_review"),
        F.when(ambiguous, F.lit(note)).alias("confidence_notes"),
    )


def representative_table(
    reps: DataFrame, identity: DataFrame, structure: DataFrame, flags: DataFrame, clusters: DataFrame, sizes: DataFrame
) -> DataFrame:
    """Representatives that have both scores, with triad flag (default false) and cluster size (default 1)."""
    scored = reps.join(identity, "target_id").join(structure, "target_id")
    named = clusters.select(F.col("member").alias("target_id"), F.col("rep").alias("cluster_id"))
    out = scored.join(flags, "target_id", "left").join(named, "target_id", "left").join(sizes, "cluster_id", "left")
    return out.select(
        "target_id",
        "pident",
        "structure_score",
        F.coalesce("flag", F.lit(False)).alias("triad_complete"),
        "cluster_id",
        F.coalesce("n_genomes", F.lit(1)).alias("n_genomes_in_cluster"),
    )


def catalogue_with_samples(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per genome with sample columns and a yes/no found flag: the denominator table."""
    one = catalogue.dropDuplicates(["genome"])
    joined = one.join(samples.withColumn("_s", F.lit(True)), "sample_id", "left")
    return joined.withColumn("sample_found", F.when(F.col("_s"), "yes").otherwise("no")).drop("_s")


def download_manifest(qualifying: DataFrame, catalogue: DataFrame, url_prefix: str, url_suffix: str) -> DataFrame:
    """(genome, address) for qualifying genomes that are in the catalogue."""
    kept = catalogue.join(qualifying.select("genome").distinct(), "genome", "left_semi")
    address = F.concat(F.lit(url_prefix), F.url_encode("genome"), F.lit(url_suffix))
    return kept.select("genome", address.alias("address"))


def anchor_rows(qualifying: DataFrame, families: dict[str, DataFrame], searched: str = "phaC") -> DataFrame:
    """(genome, family, target) of other families in qualifying genomes; the searched family is an error."""
    if searched in families:
        raise ValueError(f"{searched} is the family being searched for and cannot be an anchor")
    out = None
    for name, rows in families.items():
        part = rows.select("genome", F.lit(name).alias("family"), "target_id")
        out = part if out is None else out.unionByName(part)
    return out.join(qualifying.select("genome").distinct(), "genome", "left_semi")


def chunk_of_ids(ids: DataFrame, key: str, size: int, bucket: Column) -> DataFrame:
    """Sorted distinct ids with the index of their lookup chunk of ``size``."""
    indexed = ordered_index(ids.select(key).distinct(), [], bucket, [key], "_i")
    return indexed.select(key, (F.expr(f"_i DIV {size}")).alias("chunk"))


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Exact left lookup against a landed dimension table; ids with no row stay absent (NULL)."""
    return rows.join(dimension, key, "left")
