import pytest
from fixtures import PROFILE, STB, rows

from locusforge import cli, schemas
from locusforge.operators.registry import ComparisonConfig, ComparisonDatabase, ProfileDatabase
from locusforge.sources import io

CONFIG = {"gene_db_id": "gene_ref_1", "reference_id": "ref_1", "scope": "all", "min_cov": 5, "min_gene_compare_len": 100}


@pytest.fixture()
def files(tmp_path):
    out = {}
    for n in ("profile_1", "profile_2", "profile_3"):
        for kind in ("parquet", "scaffolds"):
            p = tmp_path / f"{n}.{kind}"
            p.write_text("chr1\n")
            out[n, kind] = str(p)
    return out


def values(files, n):
    return {"profile_name": n, "profile_location": files[n, "parquet"], "scaffold_location": files[n, "scaffolds"], "reference_db_id": "ref", "gene_db_id": "gene"}


def database(spark, files, *names):
    db = ProfileDatabase(spark)
    for n in names:
        db.add_profile(**values(files, n))
    return db


def test_profiles_are_added_once_and_checked(spark, files):
    db = database(spark, files)
    assert db.df.isEmpty() and db.df.columns == schemas.REGISTRY.names
    db = database(spark, files, "profile_1", "profile_2", "profile_1")
    assert db.df.count() == 2
    good = values(files, "profile_3")
    for bad in (good | {"more": "x"}, good | {"profile_location": "/none"}, good | {"scaffold_location": "/none"}, good | {"reference_db_id": ""}, good | {"gene_db_id": ""}, {k: v for k, v in good.items() if k != "profile_name"}):
        with pytest.raises(ValueError, match="The profile data provided is not valid"):
            db.add_profile(**bad)


def test_profiles_through_csv_files_and_merges(spark, files, tmp_path):
    db = database(spark, files, "profile_1", "profile_2")
    db.to_csv(str(tmp_path / "csv"))
    again = ProfileDatabase.from_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, db.df.collect()))
    again.add_database(database(spark, files, "profile_2", "profile_3"))
    assert again.df.count() == 3
    place = str(tmp_path / "db")
    again.save_as_new_database(place)
    with pytest.raises(ValueError):
        again.save_as_new_database(place)
    opened = ProfileDatabase(spark, place)
    opened.df = opened.df.where("profile_name <> 'profile_3'")
    opened.update_database()
    assert ProfileDatabase(spark, place).df.count() == 2
    with pytest.raises(ValueError):
        ProfileDatabase(spark).update_database()
    (tmp_path / "bad.csv").write_text("profile_name\nx\n")
    with pytest.raises(ValueError):
        ProfileDatabase.from_csv(spark, str(tmp_path / "bad.csv"))


def test_configurations(tmp_path):
    c = ComparisonConfig.from_dict(CONFIG)
    for bad in (CONFIG | {"more": 1}, CONFIG | {"gene_db_id": ""}, CONFIG | {"min_cov": -1}, {"scope": "all"}):
        with pytest.raises(ValueError):
            ComparisonConfig.from_dict(bad)
    c.to_json(str(tmp_path / "c.json"))
    assert ComparisonConfig.from_json(str(tmp_path / "c.json")) == c
    some, other = (ComparisonConfig.from_dict(CONFIG | {"scope": s}) for s in ("g1,g2,g3", "g3,g2,g9"))
    assert c.common_scope(some).scope == "g1,g2,g3" and some.common_scope(c).scope == "g1,g2,g3" and some.common_scope(other).scope == "g2,g3"
    assert not some.is_compatible(ComparisonConfig.from_dict(CONFIG | {"scope": "g7"})) and not c.is_compatible(ComparisonConfig.from_dict(CONFIG | {"min_cov": 6}))
    with pytest.raises(ValueError):
        some.common_scope(ComparisonConfig.from_dict(CONFIG | {"scope": "g7"}))


def comps(spark, *pairs):
    return spark.createDataFrame([("g", 1, 1, 0.9, 1, 1, 1, 1.0, a, b) for a, b in pairs], schemas.COMPARISON)


def test_comparisons_remaining_merged_and_reloaded(spark, files, tmp_path):
    profiles = database(spark, files, "profile_1", "profile_2", "profile_3")
    db = ComparisonDatabase(profiles, ComparisonConfig.from_dict(CONFIG))
    assert db.df.isEmpty() and not db.is_complete()
    pairs = [tuple(r) for r in db.remaining_pairs().collect()]
    assert pairs == [("profile_1", "profile_2"), ("profile_1", "profile_3"), ("profile_2", "profile_3")]
    db.df = comps(spark, ("profile_2", "profile_1"))
    assert [tuple(r) for r in db.remaining_pairs().collect()] == pairs[1:] and db.all_profile_names() == {"profile_1", "profile_2"}
    other = ComparisonDatabase(profiles, ComparisonConfig.from_dict(CONFIG | {"scope": "g"}))
    other.df = comps(spark, ("profile_1", "profile_3"), ("profile_2", "profile_3"), ("profile_2", "profile_1"))
    db.add_comp_database(other)
    assert db.df.count() == 3 and db.config.scope == "g" and db.is_complete()
    assert [c for c in db.to_complete_input_table().columns] == ["sample_name_1", "sample_name_2", "profile_location_1", "profile_location_2", "scaffold_location_1", "scaffold_location_2"]
    with pytest.raises(ValueError):
        db.dump(str(tmp_path / "x.json"))
    profiles.save_as_new_database(str(tmp_path / "p"))
    db.save_new_compare_database(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        db.save_new_compare_database(str(tmp_path / "c"))
    db.dump(str(tmp_path / "db.json"))
    again = ComparisonDatabase.load(spark, str(tmp_path / "db.json"))
    assert again.config == db.config and again.df.count() == 3
    again.df = again.df.limit(1)
    again.update_compare_database()
    assert ComparisonDatabase.load(spark, str(tmp_path / "db.json")).df.count() == 1
    bad = ComparisonDatabase(profiles, db.config)
    bad.df = comps(spark, ("profile_1", "stranger"))
    with pytest.raises(ValueError):
        db.add_comp_database(bad)
    bad.df = comps(spark, ("profile_1", "profile_2")).drop("identical_gene_count")
    assert bad.remaining_pairs().count() == 2
    with pytest.raises(ValueError):
        db.add_comp_database(bad)


def test_command_line_from_text_to_comparisons(spark, tmp_path):
    t = lambda n: str(tmp_path / n)
    (tmp_path / "stb.tsv").write_text("".join(f"{s}\t{g}\n" for s, g in STB))
    (tmp_path / "ref.fa").write_text("".join(f">{c}\n{'ACGTA' * (n // 5)}\n" for c, n in (("chr1", 10), ("chr2", 20), ("chr3", 30))))
    (tmp_path / "genes.fa").write_text(">chr1_1 # 2 # 5 # 1 # x\nACGT\n>chr3_1 # 3 # 6 # 1 # x\nACGT\n")
    (tmp_path / "scaffolds").write_text("chr1\n\n")
    for name, seed, chroms in (("p1", 1, ("chr1", "chr2")), ("p2", 1, ("chr1", "chr2", "chr3"))):
        lines = [f"{c}\t{pos}\tN\t9\t{'A' * a}{'c' * x}{'G' * g}{'t' * u}\tI" for _, c, pos, _, a, x, g, u in rows(name, seed, chroms)]
        (tmp_path / f"{name}.pileup").write_text("\n".join(lines))
    run = lambda *a: cli.main(list(a))
    run("test")
    run("utilities", "build-null-model", "--max-total-reads", "50", "--output", t("model"))
    run("utilities", "make_bed", "--fasta", t("ref.fa"), "--max-scaffold-length", "15", "--output", t("bed"))
    run("utilities", "get_genome_lengths", "--stb", t("stb.tsv"), "--bed", t("bed"), "--output", t("lengths"))
    assert {r.genome: r.genome_length for r in spark.read.parquet(t("lengths")).collect()} == {"genome1": 30, "genome2": 30}
    run("gene_tools", "gene-range-table", "--gene-fasta", t("genes.fa"), "--output", t("ranges"))
    run("gene_tools", "gene-loc-table", "--gene-fasta", t("genes.fa"), "--scaffolds", t("scaffolds"), "--output", t("loc"))
    assert spark.read.parquet(t("loc")).count() == 4
    run("profile", "prepare_profiling", "--fasta", t("ref.fa"), "--gene-fasta", t("genes.fa"), "--stb", t("stb.tsv"), "--output", t("prep"))
    for p in ("p1", "p2"):
        run("profile", "profile-single", "--pileup", t(f"{p}.pileup"), "--gene-range-table", t("ranges"), "--bed", t("bed"), "--output", t(f"{p}.parquet"))
        run("utilities", "genome_breadth_matrix", "--profile", t(f"{p}.parquet"), "--stb", t("stb.tsv"), "--genome-lengths", t("lengths"), "--output", t(f"{p}.breadth"))
    run("utilities", "process_mpileup", "--pileup", t("p1.pileup"), "--output", t("raw"))
    assert spark.read.parquet(t("raw")).count() == 30
    run("utilities", "collect_breadth_tables", "--tables", t("p1.breadth"), t("p2.breadth"), "--output", t("breadth"))
    assert {r.genome: r.p1 is None for r in spark.read.parquet(t("breadth")).collect()} == {"genome1": False, "genome2": True}
    run("utilities", "strain_heterogeneity", "--profile", t("p2.parquet"), "--stb", t("stb.tsv"), "--output", t("het"))
    assert spark.read.parquet(t("het")).count() == 2
    run("compare", "single_compare_genome", "--profile-1", t("p1.parquet"), "--profile-2", t("p2.parquet"), "--stb", t("stb.tsv"), "--null-model", t("model"), "--min-cov", "1", "--min-gene-compare-len", "1", "--output", t("comp"))
    out = {r.genome: r for r in spark.read.parquet(t("comp")).collect()}
    assert set(out) == {"genome1", "genome2"} and out["genome1"].genome_pop_ani == 100 and out["genome2"].total_positions == 0 and (out["genome1"].sample_1, out["genome1"].sample_2) == ("p1", "p2")
    (tmp_path / "db.csv").write_text("profile_name,profile_location,scaffold_location,reference_db_id,gene_db_id\n" + "".join(f"{p},{t(p + '.parquet')},{t(p + '.parquet.scaffolds')},r,g\n" for p in ("p1", "p2")))
    run("utilities", "build-profile-db", "--csv", t("db.csv"), "--output", t("pdb"))
    run("utilities", "build-comparison-config", "--profile-db", t("pdb"), "--comp-db", t("cdb"), "--gene-db-id", "g", "--reference-db-id", "r", "--min-cov", "1", "--min-gene-compare-len", "1", "--stb", t("stb.tsv"), "--output", t("config.json"))
    run("utilities", "to-complete-table", "--database", t("config.json"), "--output", t("todo"))
    assert io.read_csv(spark, t("todo"), schemas._of(sample_name_1="s", sample_name_2="s")).count() == 1
    for _ in range(2):
        run("run", "compare_genomes", "--database", t("config.json"))
    done = spark.read.parquet(t("cdb")).collect()
    assert [(r.genome, r.sample_1, r.sample_2) for r in done] == [("genome1", "p1", "p2")]
    run("utilities", "merge_parquet", "--input-dir", t("cdb"), "--output", t("merged"))
    assert spark.read.parquet(t("merged")).count() == 1
    (tmp_path / "samples.csv").write_text("sample_name,pileup\n" + "".join(f"{p},{t(p + '.pileup')}\n" for p in ("p1", "p2")))
    table = ("--stb-file", t("stb.tsv"), "--gene-range-table", t("ranges"), "--bed-file", t("bed"), "--genome-length-file", t("lengths"), "--run-dir", t("run"))
    run("run", "profile", "--input-table", t("samples.csv"), *table)
    both = spark.read.parquet(t("run") + "/profiles")
    for p in ("p1", "p2"):
        assert sorted(map(tuple, both.where(f"sample = '{p}'").select(*schemas.PROFILE.names).collect())) == sorted(map(tuple, spark.read.parquet(t(f"{p}.parquet")).select(*schemas.PROFILE.names).collect()))
    assert {(r["sample"], r.genome) for r in spark.read.parquet(t("run") + "/breadth").collect()} == {("p1", "genome1"), ("p2", "genome1"), ("p2", "genome2")}
    (tmp_path / "bad.csv").write_text("sample_name,bam\nx,y\n")
    (tmp_path / "gone.csv").write_text(f"sample_name,pileup\nx,{t('none')}\n")
    with pytest.raises(ValueError, match="pileup"):
        run("run", "profile", "--input-table", t("bad.csv"), *table)
    with pytest.raises(FileNotFoundError):
        run("run", "profile", "--input-table", t("gone.csv"), *table)
    ComparisonConfig.from_dict(CONFIG | {"min_cov": 1, "min_gene_compare_len": 1, "stb_file_loc": t("stb.tsv")}).to_json(t("plain.json"))
    new = ("run", "build-comp-database", "--profile-db-dir", t("pdb"), "--config-file", t("plain.json"))
    with pytest.raises(FileNotFoundError):
        run(*new, "--comp-db-file", t("none"), "--output-dir", t("built"))
    run(*new, "--comp-db-file", t("cdb"), "--output-dir", t("built"))
    assert ComparisonDatabase.load(spark, t("built") + "/database.json").is_complete()
    run(*new, "--output-dir", t("fresh"))
    run("run", "compare_genomes", "--database", t("fresh") + "/database.json")
    assert sorted(map(tuple, spark.read.parquet(t("fresh") + "/comparisons").collect())) == sorted(map(tuple, done))
    assert cli.setup_problems(spark) == []
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        run("utilities", "merge_parquet", "--input-dir", t("empty"), "--output", t("no"))


def test_missing_files_are_found_by_folder(spark, tmp_path):
    for n in ("a", "b c"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "x").write_text("1")
    paths = [f"{tmp_path}/{p}" for p in ("a", "a/x", "b c/x", "b c/y", "no/x")]
    assert io.missing(spark, [*paths, None, ""]) == [None, "", *sorted(paths[3:])]
    assert io.missing(spark, ["file://" + p for p in paths[:3]]) == [] and io.missing(spark, []) == []
    rows = io.by_file(spark.read.text([paths[1], paths[2]]), [(paths[1], "one"), (paths[1], "two"), (f"{tmp_path}/b c", "three")], "name")
    assert sorted(map(tuple, rows.collect())) == [("1", "one"), ("1", "three"), ("1", "two")]


def test_json_and_replacement_through_the_file_system(spark, tmp_path):
    path = f"file:{tmp_path}/x.json"
    io.write_json({"a": "ü"}, path)
    assert io.read_json(path) == io.read_json(f"{tmp_path}/x.json") == {"a": "ü"}
    place = str(tmp_path / "t")
    io.write_parquet(spark.range(3), place)
    with pytest.raises(Exception, match="division|DIVIDE"):
        io.replace_parquet(spark.range(2).selectExpr("1 / (id - 1) as id", "assert_true(id > 5) as x", "cast(raise_error('division') as int) as y"), place)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t")] == ["t"] and spark.read.parquet(place).count() == 3
    assert io.replace_parquet(spark.read.parquet(place).where("id > 0"), place).count() == 2
