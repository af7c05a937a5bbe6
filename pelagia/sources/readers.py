"""Readers for the text, FASTA, JSON, XML and fixed-width inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions.text import from_hybrid36
from pelagia.session import cut_lineage
from pelagia.sources import checksums
from pelagia.sources.json_split import json_records
from pelagia.sources.schemas import ENTRY_SCHEMA, ENZYME_RECORD, SAMPLE_XML_SCHEMA

# The script assignment that holds a page's record, and the quality fields read from it.
EMBEDDED_JSON_PATTERN = r"(?s)JSON\.parse\(`(.+?)`\);"
QUALITY_FIELDS = [
    "genus", "species", "is_mag", "completeness", "contamination", "checkm_completeness", "checkm_contamination",
    "anvio_completion", "anvio_contamination", "genome_size", "n50", "no_scaffolds", "bioproject",
    "public_sample_link", "publication",
]


def file_order() -> Column:
    """A value that grows along a file: path, block start, then the row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_tsv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, pattern: str | None = None,
    skip_prefix: str | None = None, ordered: bool = False, sep: str = "\t",
) -> DataFrame:
    """Headered table, every column text; missing columns and cells read as the empty string.

    ``pattern`` filters file names, ``skip_prefix`` leaves out files named that way (for
    instance a job's own earlier output), ``ordered`` adds the file order as ``ord``.
    """
    reader = spark.read.options(sep=sep, header=True, inferSchema=False, escape='"')
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.csv(list(paths) if not isinstance(paths, str) else paths)
    if skip_prefix:
        # A table lands as a file or as a folder of part files; either may carry the name.
        names = F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2)
        raw = raw.where(~F.exists(names, lambda n: F.startswith(n, F.lit(skip_prefix))))
    names = list(columns) if columns is not None else raw.columns
    wanted = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in names]
    return raw.select(*wanted, *([file_order().alias("ord")] if ordered else []))


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (representative, member) table → one row per member; the last row wins."""
    raw = spark.read.csv(path, sep="\t", schema="rep string, member string", quote="")
    rows = raw.where("member IS NOT NULL").withColumn("_o", file_order())
    return rows.groupBy("member").agg(F.max_by("rep", "_o").alias("rep"))


def read_membership(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Wide membership table (cluster, length, size, representative, ``;`` separated members).

    A gz file is one split, so rows are spread right after reading; convert once with
    :func:`convert_membership` when the table is read more than once.
    """
    raw = spark.read.options(sep="\t", header=True, inferSchema=False, quote="").csv(path)
    rows = raw.toDF(*[c.lower() for c in raw.columns]).withColumnRenamed("cluster", "target_id")
    rows = rows.select("target_id", F.col("length").cast("int"), F.col("size").cast("int"), "representative", "members")
    return rows.repartition(partitions) if partitions else rows.repartition("target_id")


def convert_membership(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The membership table as Parquet sorted by target, so later id filters prune row groups."""
    rows = read_membership(spark, path).sortWithinPartitions("target_id")
    rows.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False, ordered: bool = False) -> DataFrame:
    """(id, header, sequence) records; the id is the first word of the header."""
    raw = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace("value", "^>", "")
    parts = F.split(record, "\n", 2)
    header = F.regexp_replace(parts[0], "\r$", "")
    name = header if whole_header else F.regexp_extract(header, r"^\s*(\S*)", 1)
    sequence = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    columns = [name.alias("id"), header.alias("header"), sequence.alias("sequence")]
    if ordered:
        columns.append(file_order().alias("ord"))
    return raw.where(F.length(F.trim("value")) > 0).select(*columns)


def count_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Number of FASTA records, one row per file."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit(">")))
    return lines.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_records"))


def read_enzyme_json(spark: SparkSession, path: str, ec_numbers: Sequence[str] | None = None) -> DataFrame:
    """(release, ec, record) of the wanted EC numbers (all, if none are named) of a one-object enzyme file.

    The file is read by byte ranges and cut into its records; each record is parsed on its own.
    """
    records, around = json_records(spark, path, "data")
    release = around.agg(F.max(F.nullif(F.regexp_extract("text", r'"release"\s*:\s*"([^"]*)"', 1), F.lit(""))).alias("release"))
    opened = records.select(F.explode(F.from_json("record", f"map<string,{ENZYME_RECORD}>")).alias("ec", "record"))
    named = opened if ec_numbers is None else opened.where(F.col("ec").isin(list(ec_numbers)))
    return named.withColumn("release", release.scalar()).select("release", "ec", "record")


def enzyme_proteins(records: DataFrame) -> DataFrame:
    """One row per (EC, local protein id)."""
    opened = records.select("release", "ec", F.explode("record.protein").alias("local_id", "_p"))
    return opened.select("release", "ec", "local_id", "_p.*")


def enzyme_statements(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per statement of the named fields, with its literature ids resolved."""

    def tag(name: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"record.{name}"), F.array()), lambda e: F.struct(F.lit(name).alias("field"), e.alias("e"))
        )

    tagged = [tag(name) for name in fields]
    opened = records.select("ec", F.col("record.reference").alias("_refs"), F.explode(F.concat(*tagged)).alias("_s"))
    cited = F.transform(F.coalesce("_s.e.references", F.array().cast("array<string>")), lambda r: F.col("_refs")[r])
    return opened.select(
        "ec",
        F.col("_s.field").alias("field"),
        F.concat_ws(" ", "_s.e.value", "_s.e.comment").alias("text"),
        F.col("_s.e.proteins").alias("proteins"),
        F.array_compact(F.transform(cited, lambda r: r["pmid"])).alias("pmids"),
        F.array_compact(F.transform(cited, lambda r: r["doi"])).alias("dois"),
    )


def _present(values: Column) -> Column:
    """Non-NULL items of an array, and an empty array for a NULL one."""
    return F.array_compact(F.coalesce(values, F.array().cast("array<string>")))


def _values(items: Column) -> Column:
    return _present(F.transform(items, lambda e: e["value"]))


def parse_entries(rows: DataFrame, column: str = "entry") -> DataFrame:
    """Nested protein entries (JSON text) as flat rows with array columns."""
    parsed = rows.withColumn("e", F.from_json(column, ENTRY_SCHEMA))
    empty = F.array().cast("array<string>")
    description, recommended = F.col("e.proteinDescription"), F.col("e.proteinDescription.recommendedName")
    recommended_name = F.nullif(recommended["fullName"]["value"], F.lit(""))
    submitted = F.get(
        F.filter(F.col("e.proteinDescription.submissionNames"), lambda n: F.coalesce(n["fullName"]["value"], F.lit("")) != ""),
        F.lit(0),
    )
    comments = F.col("e.comments")

    def texts(kind: str) -> Column:
        mine = F.filter(comments, lambda c: c["commentType"] == kind)
        said = F.flatten(F.transform(mine, lambda c: _values(c["texts"])))
        return F.nullif(F.array_join(F.filter(said, lambda t: t != ""), " "), F.lit(""))

    reactions = F.transform(F.filter(comments, lambda c: c["commentType"] == "CATALYTIC ACTIVITY"), lambda c: c["reaction"])

    def references(database: str) -> Column:
        per = F.transform(
            F.col("e.references"),
            lambda r: F.transform(
                F.filter(r["citation"]["citationCrossReferences"], lambda x: x["database"] == database), lambda x: x["id"]
            ),
        )
        return F.array_distinct(_present(F.flatten(F.array_compact(per))))

    alternatives = F.col("e.proteinDescription.alternativeNames")
    ec_of_alternatives = F.flatten(F.transform(F.coalesce(alternatives, F.array()), lambda a: _values(a["ecNumbers"])))
    ec_numbers = F.concat(
        _values(recommended["ecNumbers"]),
        F.coalesce(ec_of_alternatives, empty),
        F.when(recommended_name.isNull(), _values(submitted["ecNumbers"])).otherwise(empty),
        _present(F.transform(reactions, lambda r: r["ecNumber"])),
    )
    rhea = F.flatten(
        F.transform(
            F.coalesce(reactions, F.array()),
            lambda r: _present(
                F.transform(F.filter(r["reactionCrossReferences"], lambda x: x["database"] == "Rhea"), lambda x: x["id"])
            ),
        )
    )
    sites = F.transform(
        F.filter(F.col("e.features"), lambda f: f["type"] == "Active site"),
        lambda f: F.regexp_replace(
            F.concat(F.coalesce(f["location"]["start"]["value"].cast("string"), F.lit("None")), F.lit(":"), F.coalesce(f["description"], F.lit(""))),
            "^:+|:+$",
            "",
        ),
    )
    genes = F.col("e.genes")
    return parsed.select(
        *[c for c in rows.columns if c != column],
        F.col("e.primaryAccession").alias("accession"),
        _present(F.col("e.secondaryAccessions")).alias("secondary_accessions"),
        F.coalesce(F.startswith("e.entryType", F.lit("UniProtKB reviewed")), F.lit(False)).alias("reviewed"),
        F.col("e.annotationScore").alias("annotation_score"),
        F.coalesce(recommended_name, submitted["fullName"]["value"]).alias("protein_name"),
        F.array_distinct(_present(F.transform(description["alternativeNames"], lambda a: a["fullName"]["value"]))).alias(
            "alternative_protein_names"
        ),
        F.get(genes, F.lit(0))["geneName"]["value"].alias("gene_name"),
        F.array_distinct(F.coalesce(F.flatten(F.transform(genes, lambda g: _values(g["synonyms"]))), empty)).alias("gene_synonyms"),
        F.col("e.organism.scientificName").alias("organism"),
        F.col("e.organism.taxonId").cast("string").alias("ncbi_taxid"),
        _present(F.col("e.organism.lineage")).alias("taxonomic_lineage"),
        F.get(F.filter(F.col("e.organism.strains"), lambda s: F.coalesce(s["name"], F.lit("")) != ""), F.lit(0))["name"].alias("strain"),
        F.col("e.sequence.value").alias("sequence"),
        F.col("e.sequence.length").alias("sequence_length"),
        F.when(F.col("e.sequence.value") != "", F.sha2("e.sequence.value", 256)).alias("sequence_sha256"),
        F.array_distinct(ec_numbers).alias("ec_numbers"),
        F.array_distinct(F.coalesce(rhea, empty)).alias("rhea_ids"),
        texts("FUNCTION").alias("function_text"),
        F.nullif(F.array_join(_present(F.transform(reactions, lambda r: r["name"])), "; "), F.lit("")).alias("catalytic_activity_text"),
        texts("PATHWAY").alias("pathway_text"),
        F.nullif(F.array_join(F.filter(_present(sites), lambda s: s != ""), "|"), F.lit("")).alias("active_sites_text"),
        references("PubMed").alias("literature_pmids"),
        references("DOI").alias("literature_dois"),
    )


def read_sample_depths(spark: SparkSession, path: str) -> DataFrame:
    """(accession, depth_raw) of sample records: the harmonized depth attribute, else one named depth."""
    raw = spark.read.format("xml").option("rowTag", "BioSample").schema(SAMPLE_XML_SCHEMA).load(path)
    attributes = F.coalesce(F.col("Attributes.Attribute"), F.array())

    def text(test) -> Column:
        return F.trim(F.coalesce(F.get(F.filter(attributes, test), F.lit(0))["_VALUE"], F.lit("")))

    harmonized = lambda a: a["_harmonized_name"] == "depth"
    named = lambda a: F.lower(F.trim(a["_attribute_name"])) == "depth"
    depth = F.when(F.exists(attributes, harmonized), text(harmonized)).when(F.exists(attributes, named), text(named))
    return raw.where("_accession IS NOT NULL").select(F.col("_accession").alias("accession"), depth.alias("depth_raw"))


def read_domain_table(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, profile, model, scores) of whitespace-separated domain tables; the profile is the file stem."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+", 23)
    return lines.select(
        f[0].alias("gene_id"),
        F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("profile"),
        f[3].alias("model"),
        f[6].try_cast("double").alias("full_evalue"),
        f[7].try_cast("double").alias("full_score"),
        f[12].try_cast("double").alias("evalue"),
        f[13].try_cast("double").alias("score"),
    )


def read_marker_hits(spark: SparkSession, path: str, markers: DataFrame) -> DataFrame:
    """Rows of a KO annotation table whose KO is in the (marker, ko) dimension."""
    rows = read_tsv(spark, path, ["QUERY", "KO", "DESCRIPTION", "MODULE", "PATHWAY"])
    rows = rows.toDF(*[c.lower() for c in rows.columns]).where("ko <> 'NA'")
    return rows.join(markers, "ko")


def read_detail_hits(spark: SparkSession, path: str, markers: DataFrame) -> DataFrame:
    """Significant (starred) lines of a KO detail table, with the KO found anywhere on the line."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit("*")))
    tabbed = F.regexp_replace("value", r"^\*+", "")
    fields = F.when(F.contains(tabbed, F.lit("\t")), F.split(tabbed, "\t")).otherwise(F.split(F.trim(tabbed), r"\s+"))
    # "* <tab> gene": the star is alone in its field, so the gene is in the next one.
    gene = F.get(F.filter(F.transform(fields, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    hits = lines.select(gene.alias("query"), F.regexp_extract("value", r"K\d{5}", 0).alias("ko"))
    return hits.where("ko <> ''").join(markers, "ko")


def read_climate_grid(spark: SparkSession, path: str) -> DataFrame:
    """Long (cell_lat, cell_lon, depth, value) rows of a gridded table whose header line carries the depths."""
    lines = spark.read.text(path)
    header = lines.where(F.startswith("value", F.lit("#COMMA SEPARATED")))
    axis = F.transform(
        F.split(F.substring_index("value", "DEPTHS (M):", -1), ","), lambda d: F.trim(d).try_cast("double")
    )
    depths = header.agg(F.first(axis).alias("_axis"))
    body = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", ",").alias("_f"))
    body = body.where(F.size("_f") >= 3).withColumn("_axis", depths.scalar())
    opened = body.select(
        F.round(F.col("_f")[0].try_cast("double"), 3).alias("cell_lat"),
        F.round(F.col("_f")[1].try_cast("double"), 3).alias("cell_lon"),
        F.inline(F.arrays_zip(F.col("_axis").alias("depth"), F.slice("_f", 3, F.size("_f")).alias("text"))),
    )
    value = F.trim("text").try_cast("double")
    return opened.where("depth IS NOT NULL").select("cell_lat", "cell_lon", "depth", value.alias("value")).where("value IS NOT NULL")


def embedded_json(pages: DataFrame, html: str = "html", fields: Sequence[str] = QUALITY_FIELDS) -> DataFrame:
    """Fields of the JSON object a page assigns in a script; pages without one keep NULL fields."""
    text = F.regexp_extract(html, EMBEDDED_JSON_PATTERN, 1)
    keep = [c for c in pages.columns if c != html]
    found = pages.withColumn("_j", F.nullif(text, F.lit("")))
    sample = F.substring_index(F.get_json_object("_j", "$.public_sample_link"), "/", -1)
    return found.select(
        *keep,
        F.col("_j").isNotNull().alias("has_json"),
        *[F.get_json_object("_j", f"$.{name}").alias(name) for name in fields],
        sample.alias("biosample"),
    )


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atom lines of fixed-width structure files: residue, atom, coordinates and confidence.

    Residue numbers from 10,000 on are read in the hybrid base-36 form that keeps them four characters wide.
    """
    lines = spark.read.text(path).where(F.startswith("value", F.lit("ATOM")))

    def cut(start: int, length: int) -> Column:
        return F.trim(F.substring("value", start, length))

    return lines.select(
        F.regexp_replace("_metadata.file_name", r"\.pdb$", "").alias("structure"),
        cut(18, 3).alias("resn"),
        from_hybrid36(cut(23, 4), 4).cast("int").alias("position"),
        cut(13, 4).alias("atom"),
        *[cut(s, 8).try_cast("double").alias(n) for n, s in (("x", 31), ("y", 39), ("z", 47))],
        cut(61, 6).try_cast("double").alias("confidence"),
    )


def family_dimension(spark: SparkSession, definitions: Sequence[dict]) -> DataFrame:
    """Family config rows, checked for repeated ids."""
    from pelagia.sources.schemas import FAMILY_DEFINITION

    ids = [d["family"] for d in definitions]
    repeated = sorted({i for i in ids if ids.count(i) > 1})
    if repeated:
        raise ValueError(f"duplicate family ids: {', '.join(repeated)}")
    schema = FAMILY_DEFINITION
    rows = [tuple(d.get(f.name, [] if f.dataType.typeName() == "array" else None) for f in schema) for d in definitions]
    return spark.createDataFrame(rows, schema)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, size_bytes, md5, sha256) of landed files; empty files have no row.

    Files of more than ``checksums.BLOCK`` bytes are hashed by blocks in rounds, so no task reads one whole; between
    two line feeds they have less than 2 GiB. Compressed files by their name are read whole, up to 2 GiB each.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("file", F.xxhash64("_metadata.file_path"))
    name, size = F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes")
    apart = checksums.hashed_apart()
    whole = files.where(~apart).select(name, size, F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    large = cut_lineage(files.where(apart).select("file", name, size))
    if large.isEmpty():
        return whole
    chained = checksums.chained_digests(spark, path, large.select("file", F.col("size_bytes").alias("size")))
    return whole.unionByName(large.join(chained, "file").drop("file"))


def download_status(checksums: DataFrame, published: DataFrame) -> DataFrame:
    """Files against published hashes: verified, mismatch, or computed where none is published."""
    joined = checksums.join(published.select("file_name", "algorithm", "expected"), "file_name", "left")
    actual = F.when(F.col("algorithm") == "md5", F.col("md5")).otherwise(F.col("sha256"))
    status = (
        F.when(F.col("expected").isNull(), "computed_no_published_hash")
        .when(F.lower("expected") == actual, "verified_against_published")
        .otherwise("mismatch")
    )
    return joined.select("file_name", "size_bytes", actual.alias("checksum"), status.alias("checksum_status"))
