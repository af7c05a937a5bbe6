"""Registered queries: column functions over the tables."""

from __future__ import annotations

from pelagia.functions import evidence, text
from pelagia.operators import sequences
from pelagia.plans.common import FAMILY_ORDER, F, rel, table
from pelagia.plans.registry import query

TOKENS = "event_type || '|' || CAST(event_id % 3 AS STRING) || '||' || event_type || '|x|' || CAST(event_id % 3 AS STRING)"


def _dedupe_sql(column: str) -> str:
    """Ordered distinct non-blank tokens of a pipe-joined text."""
    return f"""(SELECT string_agg(t, '|' ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(string_split({column}, '|')) AS t,
        unnest(range(len(string_split({column}, '|')))) AS p) WHERE t <> '' GROUP BY t))"""


@query(
    "f1_token_dedupe_and_union",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '' ELSE {TOKENS.replace('STRING', 'VARCHAR')} END AS v FROM events)
        SELECT event_id, CASE WHEN v IS NULL OR v = '' THEN v ELSE {_dedupe_sql('v')} END AS deduped,
               {_dedupe_sql("(coalesce(v, '') || '|new|x')")} AS merged FROM e""",
)
def f1(spark, sf):
    value = f"CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN '' ELSE {TOKENS} END AS v"
    rows = table(spark, sf, "events").selectExpr("event_id", value)
    merged = text.union_tokens(F.col("v"), F.array(F.lit("new"), F.lit("x")))
    return rows.select("event_id", text.dedupe_tokens(F.col("v")).alias("deduped"), merged.alias("merged"))


MEMBER = "CASE WHEN event_id % 9 = 0 THEN 'plain' || CAST(event_id AS STRING) ELSE 'G-' || CAST(user_id AS STRING) || '-scaffold_' || CAST(event_id % 40 AS STRING) || '_' || CAST(event_id % 7 AS STRING) END"


@query(
    "f2_genome_of_member",
    f"""WITH e AS (SELECT event_id, {MEMBER.replace('STRING', 'VARCHAR')} AS m FROM events)
        SELECT event_id, CASE WHEN contains(m, '-scaffold_') THEN split_part(m, '-scaffold_', 1) END AS or_null,
               CASE WHEN contains(m, '-scaffold_') THEN split_part(m, '-scaffold_', 1) ELSE '' END AS or_blank, split_part(m, '-scaffold_', 1) AS or_whole FROM e""",
)
def f2(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{MEMBER} AS m")
    member = F.col("m")
    return rows.select(
        "event_id",
        text.genome_of_member(member).alias("or_null"),
        text.genome_of_member(member, "blank").alias("or_blank"),
        text.genome_of_member(member, "whole").alias("or_whole"),
    )


@query(
    "f3_scaffold_and_gene_number",
    f"""WITH e AS (SELECT event_id, {MEMBER.replace('STRING', 'VARCHAR')} AS m FROM events)
        SELECT event_id, regexp_extract(m, '^(.*)_([^_]*)$', 1) AS scaffold, TRY_CAST(nullif(regexp_extract(m, '^(.*)_(\\d+)$', 2), '') AS INT) AS gene FROM e""",
)
def f3(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", f"{MEMBER} AS m")
    return rows.select("event_id", text.scaffold_of_gene(F.col("m")).alias("scaffold"), text.gene_number(F.col("m")).alias("gene"))


@query(
    "f9_family_short_codes",
    f"""WITH f AS (SELECT DISTINCT family FROM hits) SELECT family, CASE WHEN contains(family, '_') THEN regexp_extract(family, '^pha([^_]*)_', 1) ||
        upper(substr(split_part(family, '_', 2), 1, 1)) || lower(substr(split_part(family, '_', 2), 2, 2)) ELSE substr(family, 4) END AS code FROM f""",
    ("hits",),
)
def f9(spark, sf):
    return rel(spark, sf, "hits").select("family").distinct().withColumn("code", text.short_code_column(F.col("family")))


@query(
    "f10_label_to_codes",
    """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'RReg' ELSE '' END AS label FROM orders)
       SELECT o_orderkey, label, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'A' END, CASE WHEN o_orderkey % 3 = 0 THEN 'C' END, CASE WHEN o_orderkey % 5 = 0 THEN 'RReg' END) AS codes FROM l""",
)
def f10(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'RReg' ELSE '' END AS label",
    )
    return rows.withColumn("codes", F.array_join(text.label_codes(F.col("label"), FAMILY_ORDER), ","))


@query(
    "f11_architecture_label",
    """SELECT l_orderkey, CASE WHEN sum((l_linenumber = 1)::INT) > 0 THEN 'A' ELSE '' END || CASE WHEN sum((l_linenumber = 2)::INT) > 0 THEN 'B' ELSE '' END || CASE WHEN sum((l_linenumber = 7)::INT) > 0 THEN 'RReg' ELSE '' END AS label FROM lineitem GROUP BY 1""",
)
def f11(spark, sf):
    picks = {"phaA": 1, "phaB": 2, "phaR_regulator": 7}
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_linenumber") == n).alias(f) for f, n in picks.items()])
    return counts.select("l_orderkey", text.architecture_label({f: F.col(f) for f in picks}, list(picks)).alias("label"))


LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def letters():
    """Document text as an upper-case letter sequence."""
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))


AA = "[^ACDEFGHIKLMNPQRSTVWY]"


@query(
    "f12_sequence_cleanup",
    f"""WITH d AS (SELECT doc_id, {LETTERS} || repeat('X', CAST(doc_id % 4 AS INT)) AS s FROM documents), t AS (SELECT *, regexp_replace(s, 'X+$', '') AS r FROM d)
        SELECT doc_id, md5(regexp_replace(r, '{AA}', 'X', 'g')) AS clean, length(s) AS raw_length, length(r) AS clean_length, length(s) - length(r) AS n_terminal_x,
               length(regexp_replace(r, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) AS n_noncanonical, md5(regexp_replace(s, '[*X]$', '')) AS one_stripped FROM t""",
)
def f12(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat(letters(), F.expr("repeat('X', CAST(doc_id % 4 AS INT))")).alias("s"))
    cleaned = rows.withColumn("c", text.clean_sequence(F.col("s")))
    return cleaned.select(
        "doc_id", F.md5("c.clean").alias("clean"), "c.raw_length", "c.clean_length", "c.n_terminal_x", "c.n_noncanonical",
        F.md5(text.strip_terminal(F.col("s"))).alias("one_stripped"),
    )


@query("f13_sequence_hash_and_length", "SELECT doc_id, sha256(text) AS sha, length(text) AS n FROM documents")
def f13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


VOCAB = {"DEF": ["the", "la"], "IN": ["in", "of the", "de la"], "ON": ["on(", "ouan"]}


def _codes_sql(column: str) -> str:
    ordered = [("IN", "of the"), ("IN", "de la"), ("ON", "ouan"), ("DEF", "the"), ("ON", r"on\("), ("DEF", "la"), ("IN", "in")]
    first: dict[str, list[str]] = {}
    for code, phrase in ordered:
        first.setdefault(code, []).append(phrase)
    order_cases = ", ".join(
        f"CASE WHEN regexp_matches({column}, '(?i)(^|[^A-Za-z0-9]){phrase}($|[^A-Za-z0-9])') THEN '{code}' END" for code, phrase in ordered
    )
    joined = f"concat_ws('|', {order_cases})"
    return f"coalesce({_dedupe_sql(joined)}, '')"


@query("f14_vocabulary_codes", f"SELECT doc_id, {_codes_sql('text')} AS codes FROM documents")
def f14(spark, sf):
    codes = text.vocabulary_codes(F.col("text"), VOCAB)
    return table(spark, sf, "documents").select("doc_id", F.array_join(codes, "|").alias("codes"))


LEVEL = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'experimental_literature' WHEN 1 THEN 'curated_specific_function' WHEN 2 THEN 'generic_reaction_annotation' ELSE 'inferred_annotation' END"


@query(
    "f15_gated_phenotype",
    f"""SELECT doc_id, {LEVEL} AS phenotype_evidence_level, CASE WHEN doc_id % 4 < 2 THEN nullif({_codes_sql('text')}, '') END AS demonstrated_monomers,
        regexp_matches(text, '(?i)\\bmol ?%|\\bmol\\.?%|\\bcomposition\\b|\\bmonomer\\b') AS is_composition FROM documents""",
)
def f15(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.expr(LEVEL).alias("level"))
    norm = evidence.normalized_phenotype(F.col("text"), F.col("level"), VOCAB, {"P": ["nothing here"]})
    return rows.withColumn("n", norm).select(
        "doc_id", "n.phenotype_evidence_level", "n.demonstrated_monomers", F.col("n.composition_text").isNotNull().alias("is_composition")
    )


@query(
    "f16_evidence_levels",
    f"""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'experimental_literature' ELSE 'generic_reaction_annotation' END AS field_level,
        CASE WHEN {_codes_sql('text')} <> '' THEN 'curated_specific_function' ELSE 'generic_reaction_annotation' END AS text_level FROM documents""",
)
def f16(spark, sf):
    field = F.when(F.col("source") == "src1", "substrates_products").when(F.col("source") == "src2", "general_information").otherwise("reaction")
    return table(spark, sf, "documents").select(
        "doc_id",
        evidence.field_evidence_level(field).alias("field_level"),
        evidence.function_evidence_level(F.col("text"), VOCAB, {}).alias("text_level"),
    )


@query("f17_context_keywords", "SELECT doc_id, contains(lower(text || ' ' || source), 'ouan') OR contains(lower(text || ' ' || source), ' src7') AS has_context FROM documents")
def f17(spark, sf):
    test = text.mentions_any([F.col("text"), F.col("source")], ["ouan", " src7"])
    return table(spark, sf, "documents").select("doc_id", test.alias("has_context"))


REASON = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'uniprot_reviewed_gene_name' WHEN 1 THEN 'uniprot_unreviewed_gene_name' WHEN 2 THEN 'uniprot_reviewed_protein_name' WHEN 3 THEN 'uniprot_unreviewed_ec' WHEN 4 THEN 'uniprot_reviewed_ec' ELSE 'other' END"


@query(
    "f18_tier_policy",
    f"""WITH o AS (SELECT o_orderkey, {REASON} AS reason, o_orderstatus = 'F' AS reviewed, o_orderpriority = '1-URGENT' AS specific FROM orders),
        t AS (SELECT *, CASE WHEN specific THEN 'GOLD_EXPERIMENTAL' WHEN reason LIKE '%\\_ec' ESCAPE '\\' THEN 'CANDIDATE_AMBIGUOUS' WHEN (reason LIKE '%gene\\_name' ESCAPE '\\' OR reason LIKE '%protein\\_name' ESCAPE '\\') AND reviewed THEN 'CURATED_REVIEWED'
               WHEN reason LIKE '%gene\\_name' ESCAPE '\\' OR reason LIKE '%protein\\_name' ESCAPE '\\' THEN 'ANNOTATED_UNREVIEWED' ELSE 'CANDIDATE_AMBIGUOUS' END AS tier FROM o)
        SELECT o_orderkey, tier, tier = 'CANDIDATE_AMBIGUOUS' AS needs_manual_review, CASE WHEN tier IN ('CURATED_REVIEWED', 'GOLD_EXPERIMENTAL') THEN tier ELSE 'ANNOTATED_UNREVIEWED' END AS better FROM t""",
)
def f18(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr(REASON).alias("reason"), (F.col("o_orderstatus") == "F").alias("reviewed"), (F.col("o_orderpriority") == "1-URGENT").alias("specific")
    )
    rows = rows.withColumn("t", evidence.tier_for_reason(F.col("reason"), F.col("reviewed"), F.col("specific")))
    return rows.select("o_orderkey", "t.*", evidence.better_tier(F.col("t.tier"), F.lit("ANNOTATED_UNREVIEWED")).alias("better"))


@query(
    "f19_label_maps",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 82.5 WHEN '2-HIGH' THEN 37.5 WHEN '3-MEDIUM' THEN 62.5 END::DOUBLE AS midpoint,
       CASE o_orderstatus WHEN 'F' THEN 'Marine sponge (Porifera) tissue' ELSE o_orderstatus END AS habitat FROM orders""",
)
def f19(spark, sf):
    label = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '80<=' WHEN '2-HIGH' THEN '<40' WHEN '3-MEDIUM' THEN '[60-65)' ELSE 'none' END")
    habitat = F.when(F.col("o_orderstatus") == "F", "Marine Porifera tissue").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", evidence.mapped(label, evidence.THERMAL_MIDPOINTS).alias("midpoint"), evidence.habitat_label(habitat).alias("habitat")
    )


@query(
    "f20_hit_tier",
    """SELECT ord, query, target, CASE WHEN qcov >= 0.8 AND tcov >= 0.8 THEN CASE WHEN pident >= 50 THEN 'A' WHEN pident >= 30 THEN 'B' ELSE 'C' END WHEN tcov >= 0.8 THEN 'D' ELSE 'E' END AS tier
       FROM (SELECT * REPLACE (qcov - CASE WHEN ord % 3 = 0 THEN 0.2 ELSE 0 END AS qcov) FROM hits)""",
    ("hits",),
)
def f20(spark, sf):
    rows = rel(spark, sf, "hits").withColumn("qcov", F.col("qcov") - F.when(F.col("ord") % 3 == 0, F.lit(0.2)).otherwise(F.lit(0.0)))
    return rows.select("ord", "query", "target", evidence.hit_tier(F.col("pident"), F.col("qcov"), F.col("tcov")).alias("tier"))


FOLD = ["CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 500000 END AS tm", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS cov",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS tight"]


@query(
    "f21_fold_verdict",
    f"""SELECT o_orderkey, CASE WHEN tm IS NULL THEN 'no fold evidence' WHEN tm < 0.5 THEN 'fold does not match a synthase' WHEN NOT coalesce(tight, true) THEN 'synthase fold, no closed active site'
        WHEN coalesce(cov, 1) < 0.75 THEN 'synthase fold, partial coverage of reference' WHEN tight IS NULL THEN 'complete synthase fold (active site not measured)' ELSE 'complete synthase, closed active site' END AS verdict
        FROM (SELECT o_orderkey, {', '.join(FOLD)} FROM orders)""",
)
def f21(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", *FOLD)
    return rows.select("o_orderkey", evidence.fold_verdict(F.col("tm"), F.col("cov"), F.col("tight")).alias("verdict"))


NUMBER = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE CAST(value AS STRING) END"


@query(
    "f22_safe_numbers",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN value END AS strict, event_id % 5 = 2 AS loose_is_nan FROM events""",
)
def f22(spark, sf):
    raw = F.expr(NUMBER)
    loose = F.coalesce(F.isnan(text.safe_number(raw)), F.lit(False))
    return table(spark, sf, "events").select("event_id", text.safe_number(raw, keep_nan=False).alias("strict"), loose.alias("loose_is_nan"))


@query(
    "f23_motif_positions",
    f"""WITH d AS (SELECT doc_id, regexp_split_to_array({LETTERS}, 'E.T.[AEIO]') AS p FROM documents),
        q AS (SELECT doc_id, unnest(range(1, len(p))) AS i, p FROM d)
        SELECT doc_id, count(*) AS n_motifs, CAST(min(length(array_to_string(p[1:i], '')) + (i - 1) * 5 + 3) AS INT) AS first_at,
               CAST(max(length(array_to_string(p[1:i], '')) + (i - 1) * 5 + 3) AS INT) AS last_at FROM q GROUP BY doc_id""",
)
def f23(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.motif_positions(letters(), "E.T.[AEIO]", 5, 2).alias("m"))
    return rows.where(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("n_motifs"), F.array_min("m").alias("first_at"), F.array_max("m").alias("last_at"))


COLS = "substr('CSTDH-GA', CAST(1 + {e} % 8 AS INT), 1)"


@query(
    "f24_aligned_triad",
    f"""WITH e AS (SELECT event_id, {COLS.format(e='event_id')} AS c, {COLS.format(e='user_id')} AS d, {COLS.format(e='(event_id + user_id)')} AS h, {COLS.format(e='(user_id * 3)')} AS b4, {COLS.format(e='(event_id * 5)')} AS af FROM events)
        SELECT event_id, c = 'C' AS cys_ok, d = 'D' AS asp_ok, h = 'H' AS his_ok, c = 'C' AND d = 'D' AND h = 'H' AS triad_complete, c IN ('S', 'T') AS ser_thr_at_nucleophile,
               b4 = 'G' AND c = 'C' AND af = 'G' AS lipase_box_match, c <> '-' AND d <> '-' AND h <> '-' AS fully_covered FROM e""",
)
def f24(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", *[f"{COLS.format(e=e)} AS {n}" for e, n in (("event_id", "c"), ("user_id", "d"), ("(event_id + user_id)", "h"), ("(user_id * 3)", "b4"), ("(event_id * 5)", "af"))]
    )
    call = evidence.aligned_triad(F.col("c"), F.col("d"), F.col("h"), F.col("b4"), F.col("af"))
    return rows.withColumn("t", call).select("event_id", "t.*")


@query(
    "f25_domain_reaudit",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'UNCLEAR' WHEN 'view' THEN 'ON_TARGET' WHEN 'error' THEN 'WRONG_SPECIFIC' WHEN 'signup' THEN 'WRONG_GENE' ELSE 'ON_TARGET-x' END AS cls,
          CASE CAST(user_id % 4 AS INT) WHEN 0 THEN ['D1', 'D9'] WHEN 1 THEN ['D2'] WHEN 2 THEN []::VARCHAR[] ELSE ['D3', 'D2'] END AS dom FROM events),
       f AS (SELECT *, list_has_any(dom, ['D9']) AS bad, list_has_any(dom, ['D2']) AS good FROM e)
       SELECT event_id, CASE WHEN bad AND cls NOT LIKE 'WRONG%' THEN 'WRONG_GENE-domain_audit' WHEN NOT bad AND good AND (cls LIKE 'UNCLEAR%' OR cls LIKE 'WRONG_SPECIFIC%') THEN 'ON_TARGET-domain_audit'
              WHEN NOT bad AND cls LIKE 'ON_TARGET%' AND len(dom) > 0 AND NOT good THEN 'WRONG_GENE-domain_audit_no_marker' ELSE cls END AS revised FROM f""",
)
def f25(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN 'UNCLEAR' WHEN 'view' THEN 'ON_TARGET' WHEN 'error' THEN 'WRONG_SPECIFIC' WHEN 'signup' THEN 'WRONG_GENE' ELSE 'ON_TARGET-x' END AS cls",
        "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN array('D1', 'D9') WHEN 1 THEN array('D2') WHEN 2 THEN CAST(array() AS ARRAY<STRING>) ELSE array('D3', 'D2') END AS dom",
    )
    revised = evidence.revised_audit_class(F.col("cls"), F.col("dom"), F.array(F.lit("D9")), F.array(F.lit("D2")))
    return rows.select("event_id", revised.alias("revised"))


@query(
    "f26_score_thresholds",
    """SELECT event_id, event_type AS model, CASE WHEN event_type IN ('click', 'view') THEN value / 2 ELSE value END AS used_score FROM events
       WHERE event_type <> 'error' AND CASE WHEN event_type IN ('click', 'view') THEN value / 2 ELSE value END >= length(event_type) * 10""",
)
def f26(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "event_type AS model", "value AS full_score", "value / 2 AS domain_score")
    models = rows.where("model <> 'error'").select("model").distinct().selectExpr(
        "model", "CASE WHEN model IN ('click', 'view') THEN 'Domain' ELSE 'full' END AS score_type", "length(model) * 10 AS threshold"
    )
    return sequences.hits_over_threshold(rows, models).select("event_id", "model", "used_score")


@query(
    "f27_best_class",
    """WITH s AS (SELECT user_id AS gene_id, event_type AS class, max(value) AS score FROM events GROUP BY ALL),
       b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene_id ORDER BY score DESC, class) AS rn FROM s)
       SELECT gene_id, class, score, CASE class WHEN 'click' THEN score >= 300 WHEN 'view' THEN score >= 200 WHEN 'error' THEN score >= 250 ELSE false END AS confident FROM b WHERE rn = 1""",
)
def f27(spark, sf):
    events = table(spark, sf, "events")
    scores = events.groupBy(F.col("user_id").alias("gene_id"), F.col("event_type").alias("class")).agg(F.max("value").alias("score"))
    cut = F.expr("CASE class WHEN 'click' THEN 300 WHEN 'view' THEN 200 WHEN 'error' THEN 250 END")
    cutoffs = scores.select("class").distinct().withColumn("cutoff", cut).where("cutoff IS NOT NULL")
    return sequences.best_class(scores, cutoffs).select("gene_id", "class", "score", "confident")
