"""Sequence operators: k-mer composition, k-mer clustering and search, pair identity, triads, model classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.text import AMINO_ACIDS, kmers, motif_at
from pelagia.session import cut_lineage


# ---- composition and projection --------------------------------------------------------


def kmer_composition(sequences: DataFrame, key: str, k: int, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """Share of each k-mer among the k-mers of a sequence; k-mers with other letters are skipped."""
    opened = sequences.select(key, F.explode(kmers(F.col("sequence"), k)).alias("kmer"))
    known = opened.where(F.col("kmer").rlike(f"^[{alphabet}]{{{k}}}$"))
    counts = known.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("_t"))
    return counts.join(totals, key).select(key, "kmer", (F.col("n") / F.col("_t")).alias("share"))


def composition_vectors(sequences: DataFrame, key: str, k: int, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """Dense vectors of :func:`kmer_composition`, one per sequence; zero without any known k-mer.

    The vector length is fixed by the alphabet and k, whatever the data.
    """
    shares = kmer_composition(sequences, key, k, alphabet)
    size = len(alphabet) ** k
    letters = F.array(*[F.lit(c) for c in alphabet])
    slot = F.lit(0)
    for j in range(k):
        slot = slot * len(alphabet) + (F.array_position(letters, F.substring("kmer", j + 1, 1)) - 1)
    filled = shares.withColumn("_s", slot.cast("int")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_s", "share"))).alias("_m"))
    every = sequences.select(key).join(filled, key, "left")
    value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return every.select(key, value.alias("features"))


def project_two(vectors: DataFrame, key: str, features: str = "features") -> DataFrame:
    """First two principal components of centred vectors; axis signs follow the largest loading."""
    as_vector = vectors.select(key, array_to_vector(features).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(as_vector)
    loadings = model.pc.toArray()
    mean = vectors.select(F.posexplode(features).alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("_m"))
    centre = [r["_m"] for r in mean.orderBy("_i").collect()]
    signs = [1.0 if loadings[abs(loadings[:, c]).argmax(), c] >= 0 else -1.0 for c in range(2)]
    shift = [float(sum(m * w for m, w in zip(centre, loadings[:, c]))) for c in range(2)]
    projected = model.transform(as_vector).withColumn("_p", vector_to_array("_p"))
    return projected.select(key, *[((F.col("_p")[c] - shift[c]) * signs[c]).alias(f"pc{c + 1}") for c in range(2)])


# ---- k-mer clustering and search -------------------------------------------------------


def kmer_sets(sequences: DataFrame, key: str, k: int) -> DataFrame:
    """(key, length, distinct hashed k-mers sorted)."""
    hashed = F.array_sort(F.array_distinct(F.transform(kmers(F.col("sequence"), k), lambda m: F.xxhash64(m))))
    return sequences.select(key, F.length("sequence").alias("length"), hashed.alias("kmers"))


def kmer_search(
    queries: DataFrame, targets: DataFrame, k: int = 8, min_containment: float = 0.2
) -> DataFrame:
    """Targets that hold at least a share of a query's k-mers.

    Exact prefix filter: a target with the wanted share must hold at least one of the
    query's n − ⌈share·n⌉ + 1 rarest k-mers, so common k-mers never generate candidates,
    and every candidate is verified on the full k-mer sets.
    """
    q = kmer_sets(queries.select(F.col("query").alias("id"), "sequence"), "id", k).where(F.size("kmers") > 0)
    opened = q.select("id", F.explode("kmers").alias("_k"))
    sets = kmer_sets(targets.select(F.col("target").alias("id"), "sequence"), "id", k)
    posted = sets.select(F.col("id").alias("target"), F.size("kmers").alias("_tn"), F.explode("kmers").alias("_k"))
    # Only postings of query k-mers survive; they are counted, joined and verified, so they are written once.
    wanted = cut_lineage(posted.join(opened.select("_k").distinct(), "_k", "left_semi"))
    frequency = wanted.groupBy("_k").agg(F.count(F.lit(1)).alias("_df"))
    ranked = opened.join(frequency, "_k", "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_k").alias("k")))).alias("_r")
    )
    keep = F.size("_r") - F.ceil(F.size("_r") * F.lit(min_containment)).cast("int") + 1
    prefix = ranked.select("id", F.explode(F.slice("_r", F.lit(1), keep)).alias("_e")).select("id", F.col("_e.k").alias("_k"))
    candidates = wanted.join(prefix, "_k").select(F.col("id").alias("query"), "target").distinct()
    # A target's list holds query k-mers only, at most its own length.
    held = wanted.groupBy("target").agg(F.collect_list("_k").alias("_tk"), F.max("_tn").alias("_tn"))
    verified = candidates.join(held, "target").join(q.select(F.col("id").alias("query"), F.col("kmers").alias("_qk")), "query")
    counted = verified.select(
        "query", "target", F.size(F.array_intersect("_qk", "_tk")).alias("bits"), F.size("_qk").alias("_qn"), "_tn"
    )
    return counted.where(F.col("bits") / F.col("_qn") >= min_containment).select(
        "query", "target", "bits", (F.col("bits") / F.col("_qn")).alias("qcov"), (F.col("bits") / F.col("_tn")).alias("tcov")
    )


def pair_identity(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Edit-distance identity of listed pairs: 100·(1 − distance / longer length).

    Pairs come from a hit list or a chosen small set; they are not generated here.
    """
    a = sequences.select(F.col("id").alias("a"), F.col("sequence").alias("_sa"))
    b = sequences.select(F.col("id").alias("b"), F.col("sequence").alias("_sb"))
    joined = pairs.join(a, "a").join(b, "b")
    longer = F.greatest(F.length("_sa"), F.length("_sb"))
    identity = F.when(longer > 0, 100.0 * (1 - F.levenshtein("_sa", "_sb") / longer))
    return joined.select(*pairs.columns, identity.alias("identity"))


# ---- structural triads -----------------------------------------------------------------

# Side-chain atoms that take part in a triad, by one-letter residue.
TRIAD_ATOMS = {"C": ["SG"], "S": ["OG"], "T": ["OG1"], "H": ["NE2", "ND1"], "D": ["OD1", "OD2"]}


def triad_residues(atoms: DataFrame) -> DataFrame:
    """(structure, position, residue, acting, ca): the acting side-chain atoms and the CA atoms of a residue."""
    acting = None
    for residue, names in TRIAD_ATOMS.items():
        acting = (F if acting is None else acting).when(F.col("residue") == residue, F.col("atom").isin(names))
    acting = acting.otherwise(F.lit(False))
    point = F.struct("x", "y", "z")
    return atoms.where(F.col("residue").isin(list(TRIAD_ATOMS))).groupBy("structure", "position", "residue").agg(
        F.array_sort(F.collect_list(F.when(acting, point))).alias("acting"),
        F.array_sort(F.collect_list(F.when(F.col("atom") == "CA", point))).alias("ca"),
    )


def triad_points(atoms: DataFrame) -> DataFrame:
    """(structure, position, residue, acts, acting, x, y, z): a row for each acting or CA atom; ``acts`` of the residue."""
    entry = lambda kind: lambda p: F.struct(F.lit(kind).alias("acting"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))
    opened = F.inline(F.concat(F.transform("acting", entry(True)), F.transform("ca", entry(False))))
    return triad_residues(atoms).select("structure", "position", "residue", (F.size("acting") > 0).alias("acts"), opened)


def _side(points: DataFrame, name: str) -> DataFrame:
    return points.select("structure", *[F.col(c).alias(f"{c}_{name}") for c in points.columns if c != "structure"])


def _gap(a: str, b: str) -> tuple[Column, Column]:
    """Whether two atoms count for the gap of their residues, and their distance.

    Acting atoms meet acting atoms; CA meets CA if either residue lacks its acting atom.
    """
    both = F.col(f"acts_{a}") & F.col(f"acts_{b}")
    counts = (F.col(f"acting_{a}") == F.col(f"acting_{b}")) & (F.col(f"acting_{a}") == both)
    off = [F.col(f"{c}_{a}") - F.col(f"{c}_{b}") for c in "xyz"]
    return counts, F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


TRIAD_COLUMNS = ["nucleophile", "his", "asp", "nuc_his", "his_asp", "nuc_asp", "score", "in_order", "tight"]


def best_triads(atoms: DataFrame, kinds: dict[str, Sequence[str]], tight: float) -> DataFrame:
    """(structure, kind, triad): the best triad of every structure for each kind of nucleophile (kind -> residues).

    The sum splits at the histidine, so each histidine only needs its least distance to a nucleophile and to an
    aspartate: one join of a structure's histidines with its other residues, whose rows go straight into a hash
    aggregate of least distances. Only for the best histidine are the partners looked up, by that distance.
    """
    points = cut_lineage(triad_points(atoms))  # met four times
    his = _side(points.where("residue = 'H' AND position IS NOT NULL"), "h")
    others = points.where("residue <> 'H'")
    counts, gap = _gap("h", "o")
    met = his.join(_side(others, "o"), "structure").where(counts)
    of = lambda letters, side: F.col(f"residue_{side}").isin(list(letters))
    near = met.groupBy("structure", F.col("position_h").alias("his")).agg(
        F.min(F.when(of("D", "o"), gap)).alias("his_asp"),
        *[F.min(F.when(of(letters, "o"), gap)).alias(f"_{kind}") for kind, letters in kinds.items()],
    )
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("nuc_his")) for kind in kinds])
    scored = near.select("structure", "his", "his_asp", F.inline(each)).withColumn("score", F.col("nuc_his") + F.col("his_asp"))
    best = F.min(F.struct("score", "his", "nuc_his", "his_asp")).alias("_b")
    best = scored.where("score IS NOT NULL").groupBy("structure", "kind").agg(best).select("structure", "kind", "_b.*")
    best = cut_lineage(best)  # a row per structure and kind

    def nucleophile(side: str) -> Column:
        return F.array_contains(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])[F.col("kind")], F.col(f"residue_{side}"))

    chosen = best.join(his, "structure").where("position_h = his").join(_side(others, "o"), "structure").where(counts)
    partners = chosen.groupBy("structure", "kind").agg(
        F.min(F.when(nucleophile("o") & (gap == F.col("nuc_his")), F.col("position_o"))).alias("nucleophile"),
        F.min(F.when(of("D", "o") & (gap == F.col("his_asp")), F.col("position_o"))).alias("asp"),
    )
    third_counts, third = _gap("n", "d")
    ends = partners.join(_side(others, "n"), "structure").where((F.col("position_n") == F.col("nucleophile")) & nucleophile("n"))
    ends = ends.join(_side(others, "d"), "structure").where((F.col("position_d") == F.col("asp")) & of("D", "d") & third_counts)
    thirds = ends.groupBy("structure", "kind").agg(F.min(third).alias("nuc_asp"))
    full = best.join(partners, ["structure", "kind"]).join(thirds, ["structure", "kind"], "left").select(
        "*",
        ((F.col("nucleophile") < F.col("asp")) & (F.col("asp") < F.col("his"))).alias("in_order"),
        ((F.col("nuc_his") <= tight) & (F.col("his_asp") <= tight)).alias("tight"),
    )
    return full.select("structure", "kind", F.struct(*TRIAD_COLUMNS).alias("triad"))


def structural_triads(atoms: DataFrame, nucleophiles: Sequence[str] = ("C",), tight: float = 4.5) -> DataFrame:
    """Best (nucleophile, His, Asp) of every structure by the sum of its two distances.

    ``nuc_asp`` is the third distance; ``in_order`` tells whether the three follow in the
    order nucleophile, Asp, His.
    """
    return best_triads(atoms, {"nuc": nucleophiles}, tight).select("structure", "triad.*")


def triad_with_fallback(atoms: DataFrame, tight: float = 4.5) -> DataFrame:
    """Cysteine triad where it is tight, else a tight serine one, else a tight threonine one, else the cysteine result."""
    found = best_triads(atoms, {r: [r] for r in "CST"}, tight)
    is_c, is_tight = F.col("kind") == "C", F.col("triad.tight")
    turn = F.when(is_c & is_tight, 1).when((F.col("kind") == "S") & is_tight, 2).when((F.col("kind") == "T") & is_tight, 3).when(is_c, 4)
    label = F.when(is_c, "C").otherwise("S/T").alias("kind")
    ranked = found.withColumn("turn", turn).where("turn IS NOT NULL")
    picked = ranked.groupBy("structure").agg(F.min_by(F.struct(label, "triad"), "turn").alias("_p"))
    return picked.select("structure", "_p.kind", "_p.triad.*")


def triad_details(
    triads: DataFrame, atoms: DataFrame, proteins: DataFrame, nucleophile: str = "C", sequence: Column | str = "sequence"
) -> DataFrame:
    """``triads`` with ``nuc_in_motif`` and the model confidence of each of its three residues.

    ``nuc_in_motif``: the nucleophile is the middle of a ``G.x.G`` match in the protein's ``sequence`` (matches left to
    right, none overlapping another); NULL without a sequence. ``sequence`` is a column of ``proteins`` or an expression
    over them, which is worked out where the motif is looked for. A confidence is that of the residue's CA atom (the
    greatest, if it is listed twice), NULL if there is none. One join serves the three residues.
    """
    triads = cut_lineage(triads)  # a row per structure, met three times
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    inside_motif = motif_at(F.col("sequence"), f"G.[{nucleophile}].G", 5, F.col("nucleophile"), 2).alias("nuc_in_motif")
    # Settled beside the sequence, so that no list of matches is sent anywhere; dealt by number, since a small file of
    # long sequences would be one task.
    parts = int(triads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = proteins.repartition(parts, "structure").join(triads.select("structure", "nucleophile"), "structure")
    inside = inside.select("structure", "nucleophile", sequence.alias("sequence"))
    known = triads.join(inside.select("structure", inside_motif), "structure", "left")
    roles = {"nuc": "nucleophile", "asp": "asp", "his": "his"}
    parts = F.array(*[F.struct(F.lit(role).alias("role"), F.col(column).alias("position")) for role, column in roles.items()])
    levels = atoms.where("atom = 'CA'").groupBy("structure", "position").agg(F.max("confidence").alias("confidence"))
    found = triads.select("structure", F.inline(parts)).join(levels, ["structure", "position"])
    sides = found.groupBy("structure").agg(*[F.max(F.when(F.col("role") == role, F.col("confidence"))).alias(f"{role}_confidence") for role in roles])
    return known.join(sides, "structure", "left")


# ---- model scores ----------------------------------------------------------------------


def hits_over_threshold(hits: DataFrame, models: DataFrame) -> DataFrame:
    """Hits whose score reaches their model's threshold; each model names the score it is judged on."""
    joined = hits.join(models, "model")
    used = F.when(F.lower("score_type") == "domain", F.col("domain_score")).otherwise(F.col("full_score"))
    return joined.withColumn("used_score", used).where(F.col("used_score") >= F.col("threshold")).drop("score_type")


def best_class(scores: DataFrame, cutoffs: DataFrame, key: str = "gene_id", floor: float | None = None) -> DataFrame:
    """Best-scoring class per gene and whether it reaches that class's cutoff (or a common floor)."""
    best = scores.groupBy(key).agg(F.min_by(F.struct("class", "score"), F.struct(-F.col("score"), "class")).alias("_b"))
    out = best.select(key, "_b.*")
    if floor is not None:
        return out.withColumn("confident", F.col("score") >= floor)
    named = out.join(cutoffs, "class", "left")
    return named.withColumn("confident", F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False))).drop("cutoff")
