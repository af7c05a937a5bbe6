import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pelagia.sources import checksums, readers, writers


def test_tsv_blanks_and_missing_columns(spark, tmp_path):
    (tmp_path / "a_targets.tsv").write_text("x\ty\n1\t\n2\tb\n")
    (tmp_path / "all_families_targets.tsv").write_text("x\ty\n9\tz\n")
    out = readers.read_tsv(spark, str(tmp_path), ["x", "y", "z"], pattern="*_targets.tsv", skip_prefix="all_families_")
    assert sorted(tuple(r) for r in out.collect()) == [("1", "", ""), ("2", "b", "")]


def test_cluster_map_last_row_wins(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("R1\tm1\nR2\tm2\nshort\nR3\tm1\n")
    assert sorted(tuple(r) for r in readers.read_cluster_map(spark, str(path)).collect()) == [("m1", "R3"), ("m2", "R2")]


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "in.faa"
    path.write_text(">a first\nMK\nTT\n>b\n\n>c x y\nAAA")
    rows = {r["id"]: (r["header"], r["sequence"]) for r in readers.read_fasta(spark, str(path)).collect()}
    assert rows == {"a": ("a first", "MKTT"), "b": ("b", ""), "c": ("c x y", "AAA")}
    assert readers.count_fasta(spark, str(path)).first()["n_records"] == 3
    out = str(tmp_path / "out.faa")
    df = spark.createDataFrame([("p", "G" * 130, None, "E. coli")], "id string, sequence string, gene string, organism string")
    writers.write_fasta(df, out, "id", [("gene", "gene"), ("organism", "organism")])
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert lines == [">p organism=E. coli", "G" * 60, "G" * 60, "G" * 10]


def test_entry_parser(spark):
    entry = {
        "primaryAccession": "P1", "entryType": "UniProtKB unreviewed (TrEMBL)",
        "proteinDescription": {"submissionNames": [{"fullName": {"value": "sub"}, "ecNumbers": [{"value": "1.1.1.1"}]}], "alternativeNames": [{"fullName": {"value": "alt"}}, {"fullName": {"value": "alt"}}]},
        "genes": [{"geneName": {"value": "phaC"}, "synonyms": [{"value": "s"}]}], "organism": {"scientificName": "O", "taxonId": 5, "lineage": ["A", "B"]},
        "sequence": {"value": "MK", "length": 2}, "comments": [{"commentType": "FUNCTION", "texts": [{"value": "one"}]}, {"commentType": "FUNCTION", "texts": [{"value": "two"}]}],
    }
    df = spark.createDataFrame([(json.dumps(entry),), (json.dumps({"primaryAccession": "P2"}),)], "entry string")
    a, b = readers.parse_entries(df).orderBy("accession").collect()
    assert (a["protein_name"], a["reviewed"], a["function_text"], a["ec_numbers"]) == ("sub", False, "one two", ["1.1.1.1"])
    assert (a["alternative_protein_names"], a["gene_synonyms"], a["taxonomic_lineage"]) == (["alt"], ["s"], ["A", "B"])
    assert (b["protein_name"], b["ec_numbers"], b["sequence_sha256"], b["active_sites_text"]) == (None, [], None, None)


def test_enzyme_json(spark, tmp_path):
    path = tmp_path / "e.json"
    record = {"protein": {"1": {"organism": "O", "accessions": ["A1"]}}, "reference": {"7": {"pmid": 11}}, "general_information": [{"value": "v", "proteins": ["1"], "references": ["7", "8"]}]}
    path.write_text(json.dumps({"release": "r", "data": {"2.3.1.9": record, "9.9.9.9": record}}, indent=1))
    records = readers.read_enzyme_json(spark, str(path), ["2.3.1.9"])
    assert [r["ec"] for r in records.collect()] == ["2.3.1.9"]
    row = readers.enzyme_statements(records, ["general_information"]).first()
    assert (row["field"], row["text"], row["pmids"], row["proteins"]) == ("general_information", "v", ["11"], ["1"])
    assert readers.enzyme_proteins(records).first()["accessions"] == ["A1"]


def test_enzyme_json_over_many_byte_ranges(spark, tmp_path):
    rnd = random.Random(3)
    awkward = ["a}b", '{"', "\\\\", '\\"}', "}{", ",", 'x "data": {"', "é\u2028}", "", "\n}\n"]
    text = lambda: "".join(rnd.choices(awkward, k=rnd.randint(0, 5)))
    data = {
        f"{i}.1": {"general_information": [{"value": text(), "comment": text(), "proteins": ["1"], "references": []} for _ in range(rnd.randint(0, 4))], "recommended_name": text()}
        for i in range(120)
    }
    before = {"release": "2024.1", "note": {"a": {"b": {}}, "c}": "}"}}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for n, (indent, ascii_) in enumerate(((None, True), (1, False))):
            path = tmp_path / f"e{n}.json"
            path.write_text(json.dumps({**before, "data": data, "version": {"v": {"x": 1}}}, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
            got = {r["ec"]: r for r in readers.read_enzyme_json(spark, str(path)).collect()}
            assert set(got) == set(data) and {r["release"] for r in got.values()} == {"2024.1"}
            for ec, record in data.items():
                found = got[ec]["record"]
                assert found["recommended_name"] == record["recommended_name"]
                assert [(s["value"], s["comment"]) for s in found["general_information"]] == [(s["value"], s["comment"]) for s in record["general_information"]]
            assert [r["ec"] for r in readers.read_enzyme_json(spark, str(path), ["7.1"]).collect()] == ["7.1"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_own_output_is_left_out(spark, tmp_path):
    for name in ("a_targets.tsv", "all_families_targets.tsv"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.csv").write_text(f"x\n{name}\n")
    (tmp_path / "all_families_b_targets.tsv").write_text("x\nfile\n")
    (tmp_path / "c_targets.tsv").write_text("x\nc\n")
    out = readers.read_tsv(spark, f"{tmp_path}/*_targets.tsv", ["x"], skip_prefix="all_families_")
    assert sorted(r.x for r in out.collect()) == ["a_targets.tsv", "c"]


def test_stale_checksums_are_a_mismatch(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"xyz")
    (tmp_path / "c").write_bytes(b"c")
    landed = readers.file_checksums(spark, str(tmp_path))
    published = spark.createDataFrame([("a", "md5", hashlib.md5(b"abc").hexdigest().upper()), ("b", "sha256", "0" * 64)], "file_name string, algorithm string, expected string")
    got = {r.file_name: (r.checksum_status, r.checksum) for r in readers.download_status(landed, published).collect()}
    assert got["a"] == ("verified_against_published", hashlib.md5(b"abc").hexdigest()) and got["b"][0] == "mismatch"
    assert got["c"] == ("computed_no_published_hash", hashlib.sha256(b"c").hexdigest())


def test_sample_xml(spark, tmp_path):
    path = tmp_path / "s.xml"
    path.write_text('<BioSampleSet><BioSample accession="S1"><Attributes><Attribute attribute_name="Depth">9 m</Attribute><Attribute harmonized_name="depth" attribute_name="d"> 0 m </Attribute></Attributes></BioSample>'
                    '<BioSample accession="S2"><Attributes><Attribute attribute_name="x">1</Attribute><Attribute attribute_name="y">2</Attribute></Attributes></BioSample></BioSampleSet>')
    assert sorted(tuple(r) for r in readers.read_sample_depths(spark, str(path)).collect()) == [("S1", "0 m"), ("S2", None)]


def test_climate_and_atoms_and_status(spark, tmp_path):
    grid = tmp_path / "g.csv"
    grid.write_text("#t\n#COMMA SEPARATED LATITUDE, LONGITUDE, AND VALUES AT DEPTHS (M):0,5,10\n0.5,1.5,3.0,,4.0\n1.5,1.5,2.0\n1.5\n")
    assert sorted(tuple(r) for r in readers.read_climate_grid(spark, str(grid)).collect()) == [(0.5, 1.5, 0.0, 3.0), (0.5, 1.5, 10.0, 4.0), (1.5, 1.5, 0.0, 2.0)]
    pdb = tmp_path / "m.pdb"
    pdb.write_text("HEADER\nATOM      1  CA  CYS A  12      11.104   6.134  -6.504  1.00 88.50           C\n")
    row = readers.read_atoms(spark, str(pdb)).first()
    assert tuple(row) == ("m", "CYS", 12, "CA", 11.104, 6.134, -6.504, 88.5)
    sums = readers.file_checksums(spark, str(grid))
    assert readers.download_status(sums, spark.createDataFrame([("g.csv", "md5", "00")], "file_name string, algorithm string, expected string")).first()["checksum_status"] == "mismatch"


def test_duplicate_family_is_refused(spark):
    with pytest.raises(ValueError):
        readers.family_dimension(spark, [{"family": "a"}, {"family": "a"}])
    assert readers.family_dimension(spark, [{"family": "a", "genes": ["x"]}]).first()["genes"] == ["x"]


def test_reports_are_text(spark):
    df = spark.createDataFrame([(1.23456, None, True)], "a double, b string, c boolean")
    assert tuple(writers.formatted(df, {"a": "%.4f"}).first()) == ("1.2346", "", "True")
    assert df.select(F.lit(1)).count() == 1


def test_enzyme_json_over_several_files(spark, tmp_path):
    entry = lambda i: f'"{i}.1":' + json.dumps({"general_information": [{"value": f"v{i}}}\"", "comment": "{", "proteins": ["1"], "references": []}]})
    (tmp_path / "part-00000").write_text('{"release":"r1","note":{"x":{}},"data":{' + entry(0))
    for n in range(1, 9):
        (tmp_path / f"part-{n:05}").write_text("".join("," + entry(i) for i in range(n * 1000, n * 1000 + 3 * n)))
    (tmp_path / "part-00009").write_text("}}\n")
    got = readers.read_enzyme_json(spark, str(tmp_path)).collect()
    assert sorted(r.ec for r in got) == sorted(f"{i}.1" for i in [0, *[n * 1000 + k for n in range(1, 9) for k in range(3 * n)]])
    assert {r.release for r in got} == {"r1"}
    assert all(r.record["general_information"][0]["value"] == f'v{r.ec[:-2]}}}"' for r in got)


def test_large_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checksums, "BLOCK", 10_000)
    rnd = random.Random(4)
    files = {
        "random name.bin": rnd.randbytes(95_000), "ends.bin": rnd.randbytes(41_000) + b"\n", "mark.txt": b"\xef\xbb\xbf" + rnd.randbytes(30_000),
        "both.txt": b"\xef\xbb\xbf" + b"a\r\n" * 9000, "feeds.bin": b"\n" * 20_001, "one.bin": b"x" * 50_000, "small.bin": b"\r\n\x00", "z.gz": gzip.compress(rnd.randbytes(20_000)),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
    try:
        landed = readers.file_checksums(spark, str(tmp_path))
        got = {r.file_name: (r.size_bytes, r.md5, r.sha256) for r in landed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
