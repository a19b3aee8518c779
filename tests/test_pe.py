import math
import os

import pytest
from pyspark.sql import functions as F

from peltrane.functions import sql, tokens
from peltrane.operators import pe_features, vocabulary
from peltrane.plans.config import Config
from peltrane.plans.pipeline import Family, Pipeline
from peltrane.sources import disassembly, pe, samples
from peltrane.sources.pe_writer import build
from peltrane.streaming import extraction



def frame(spark, files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "sha256 string, content binary").withColumn("pe", pe.parse_pe(F.col("content")))


def rows(frame):
    return {r["sha256"]: r for r in frame.collect()}


def test_headers(spark):
    files = {"narrow": build(flags=0xFFFF), "wide": build(plus=True, machine=0x8664, base=0x140000000, flags=0), "junk": b"MZ" + bytes(100), "empty": b""}
    got = rows(frame(spark, files).select("sha256", *pe_features.header_features(F.col("pe")), "pe.error"))
    r = got["narrow"].asDict()
    assert (r["header_ImageBase"], r["header_BaseOfData"], r["header_AddressOfEntryPoint"], r["header_SizeOfCode"]) == (0x400000, 0x2000, 0x1010, 1024)
    assert (r["header_SizeOfInitializedData"], r["header_SizeOfUninitializedData"], r["header_SectionAlignment"], r["header_FileAlignment"]) == (512, 256, 0x1000, 512)
    assert (r["header_NumberOfSections"], r["header_SizeOfOptionalHeader"], r["header_SizeOfHeaders"]) == (1, 224, 512)
    assert all(r[f"header_characteristics_bit{k}"] for k in range(16))
    r = got["wide"].asDict()
    assert (r["header_ImageBase"], r["header_BaseOfData"], r["header_SizeOfOptionalHeader"]) == (0x140000000, 0, 240)
    assert not any(r[f"header_characteristics_bit{k}"] for k in range(16))
    assert got["junk"].error and got["empty"].error and got["junk"].header_ImageBase == 0


def test_sections_entry_point_and_padding(spark):
    many = [(f".s{k}".encode(), bytes([k]) * 100, 0x1000 * (k + 1)) for k in range(17)]
    over = [(b".one", b"a" * 512, 0x1000, 0x3000), (b".two", b"ab" * 256, 0x2000)]
    files = {
        "many": build(many, entry=0x2005),
        "over": build(over, entry=0x2100),
        "none": build(entry=0x90),
        "odd": build([(b"\xff\xfe", b"", 0x1000, 0x100), (b".CRT", b"x" * 10, 0x2000), (b".crt", b"x" * 10, 0x3000)], entry=0x1001),
    }
    out = pe_features.section_features(frame(spark, files))
    assert len([c for c in out.columns if c.startswith("pesection")]) == 713
    got = rows(out)
    r = got["many"].asDict()
    assert r["pesection_1_name"] == ".s0" and r["pesection_16_name"] == ".s15" and "pesection_17_name" not in r
    assert r["pesectionProcessed_entrypointSection_name"] == ".s1" and r["section_error"] is None
    assert r["pesection_2_virtualSize"] == r["pesection_2_physicalAddress"] == 100 and r["pesection_2_size"] == 512
    assert r["pesection_2_pointerToRelocations"] == 7 and r["pesection_2_numberOfRelocations"] == 3
    assert r["pesection_1_characteristics_bit5"] and r["pesection_1_characteristics_bit30"] and not r["pesection_1_characteristics_bit0"]
    assert r["pesectionProcessed_sectionsMeanSize"] == 512.0 and r["pesectionProcessed_sectionsMaxVirtualSize"] == 100
    r = got["over"].asDict()
    assert r["pesectionProcessed_entrypointSection_name"] == ".two"  # the last match
    assert math.isclose(r["pesection_2_entropy"], 1.0) and r["pesection_1_entropy"] == 0.0
    assert math.isclose(r["pesectionProcessed_sectionsMeanEntropy"], 2 / 3)  # the entry point's section counts twice
    assert r["pesectionProcessed_sectionsMinEntropy"] == 0.0 and r["pesectionProcessed_sectionsMaxEntropy"] == 1.0
    assert math.isclose(r["pesectionProcessed_sectionsMeanVirtualSize"], (0x3000 + 512 + 512) / 3)
    assert r["pesection_3_name"] == "none" and r["pesection_3_size"] == 0
    r = got["none"].asDict()
    assert r["section_error"] and r["pesection_1_name"] == "none" and r["pesection_1_characteristics_bit5"] is False
    r = got["odd"].asDict()
    assert r["pesection_1_name"] == str(b"\xff\xfe".ljust(8, b"\0")) and r["pesection_1_entropy"] == 0.0
    flags = rows(pe_features.enriched(out))["odd"].asDict()
    assert [flags[f"pesection_{k}_isStandard"] for k in (1, 2, 3, 4)] == [False, False, True, False]
    assert [flags[f"pesection_{k}_exists"] for k in (1, 2, 3, 4)] == [True, True, True, False]
    assert "pesection_1_name" not in flags and flags["pesectionProcessed_entrypointSection_name"] != "none"


def test_section_count(spark):
    got = rows(frame(spark, {"a": build(), "b": build(plus=True, machine=0x8664)}).select("sha256", pe_features.section_count(F.col("pe")).alias("n")))
    assert (got["a"].n, got["b"].n) == (1, -1)


@pytest.mark.parametrize("plus", [False, True])
def test_imports(spark, plus):
    listed = [("KERNEL32.DLL", ["CreateFileA", "ReadFile", "ReadFile"]), ("a.drv", [None, "Go"]), ("b.dll.x", []), ("KERNEL32.dll", ["ReadFile"])]
    files = {"mix": build(imports=listed, plus=plus), "none": build(plus=plus), "junk": b"junk"}
    got = rows(frame(spark, files).select("sha256", pe_features.import_lists(F.col("pe")).alias("x")).select("sha256", "x.*"))
    assert got["mix"].dlls == ["kernel32.dll", "a.drv.dll", "b.dll", "kernel32.dll"]
    assert got["mix"].imps == ["imp_createfilea", "imp_readfile", "imp_readfile", "imp_go", "imp_readfile"] and got["mix"].error is None
    assert got["none"].dlls == [] and got["none"].imps == [] and got["none"].error is None
    assert got["junk"].dlls == [] and got["junk"].error


def test_resources(spark):
    files = {"three": build(resources=[b"ab" * 50, b"a" * 10, bytes(range(256))]), "none": build()}
    got = rows(pe_features.section_features(frame(spark, files)))
    r = got["three"].asDict()
    assert r["pesectionProcessed_resources_nb"] == 3
    assert math.isclose(r["pesectionProcessed_resourcesMeanEntropy"], 3.0) and r["pesectionProcessed_resourcesMaxEntropy"] == 8.0
    assert (r["pesectionProcessed_resourcesMinSize"], r["pesectionProcessed_resourcesMaxSize"]) == (10, 256)
    assert math.isclose(r["pesectionProcessed_resourcesMeanSize"], 366 / 3)
    assert got["none"].pesectionProcessed_resources_nb == 0 and got["none"].pesectionProcessed_resourcesMeanSize == 0.0


def test_truncated_files_never_crash():
    whole = build(imports=[("a.dll", ["x"])], resources=[b"abc"])
    for n in range(0, len(whole), 7):
        pe.parsed(whole[:n])
    for n in range(64, 700):
        pe.parsed(whole[:n] + b"\xff" * 40 + whole[n + 40 :])


def fake_decoder(machine, code, address):
    """Each byte of code is an instruction; not real mnemonics, for tests only."""
    return [f"i{c}" for c in code[:20].rstrip(b"\0")]


def test_disassembly(spark):
    files = {"x86": build([(b".text", bytes([1, 2, 3, 1, 2]), 0x1000)], entry=0x1000), "unknown": build(machine=0), "other": build(machine=0x1C0), "junk": b"", "none": build(entry=0x90)}
    parsed = frame(spark, files)
    got = rows(parsed.select("sha256", disassembly.disassemble(F.col("pe"), fake_decoder).alias("x")).select("sha256", "x.*"))
    assert got["x86"]["items"] == ["i1", "i2", "i3", "i1", "i2"]
    assert all(got[k]["error"] and got[k]["items"] is None for k in ("unknown", "other", "junk", "none"))
    try:
        import capstone  # noqa: F401
    except ImportError:
        real = rows(parsed.select("sha256", disassembly.disassemble(F.col("pe")).alias("x")).select("sha256", "x.*"))
        assert real["x86"]["error"] == "no disassembler" and real["x86"]["items"] is None
    grams = tokens.sequence_ngrams(parsed.select("sha256", disassembly.disassemble(F.col("pe"), fake_decoder).alias("x")).select("sha256", "x.items"), sample="sha256", items="items")
    assert {(r.token, r.tf) for r in grams.collect()} == {("i1", 2), ("i2", 1), ("i3", 1), ("i1 i2", 1), ("i2 i3", 1), ("i3 i1", 1), ("i1 i2 i3", 1), ("i2 i3 i1", 1)}


@pytest.fixture
def corpus(spark, tmp_path):
    """Two families of files on disk, and a split."""
    split = []
    for k in range(24):
        family = "cat" if k % 2 else "dog"
        code = (bytes([10, 11, 12]) if k % 2 else bytes([20, 21])) * 4 + bytes([k + 30]) * 3
        listed = [("kernel32.dll", ["ReadFile", "Meow" if k % 2 else "Bark"]), ("only.dll", ["Rare"])] if k % 4 else [("user32.drv", ["ReadFile"])]
        data = build([(b".text", code, 0x1000), (b".data", f"shared string {family} number {k}".encode(), 0x2000)], entry=0x1000, imports=listed)
        name = f"{k:064x}"
        (tmp_path / "files" / family).mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / family / name).write_bytes(data)
        split.append((name, family, "train" if k < 16 else "test"))
    for s in ("train", "test"):
        spark.createDataFrame([(x[0], "2020") for x in split if x[2] == s], "sha256 string, day string").write.parquet(f"file://{tmp_path}/split/X_{s}")
        spark.createDataFrame([(x[0], x[1]) for x in split if x[2] == s], "sha256 string, family string").write.parquet(f"file://{tmp_path}/split/y_{s}")
    return tmp_path, split


def test_pipeline_end_to_end(spark, corpus):
    path, split = corpus
    config = Config(files=f"file://{path}/files", split=f"file://{path}/split", import_percent=5.0, string_share=0.2, ig_threshold=0.5)
    names = Family("sections", lambda f: f.select("sha256", F.explode("pe.sections.name").alias("token")).distinct(), lambda t, n: vocabulary.prevalent(vocabulary.document_frequency(t), (0, n)))
    p = Pipeline(spark, config, f"file://{path}/experiment", decoder=fake_decoder, families=(names,))
    out = p.run()
    known = spark.read.parquet(f"file://{path}/experiment/vocabulary")
    kinds = {k: {bytes(r["token"]) for r in known.where(F.col("kind") == k).collect()} for k in ("dll", "import", "string", "byte", "opcode")}
    assert kinds["dll"] == {b"kernel32.dll", b"only.dll", b"user32.drv.dll"}
    assert {b"imp_meow", b"imp_bark"} <= kinds["import"] and b"imp_readfile" not in kinds["import"]  # in each training file
    assert b"i10" in kinds["opcode"] and any(b"cat" in t for t in kinds["byte"])
    got = rows(out)
    assert set(got) == {x[0] for x in split}
    assert "family" not in out.columns and "split" not in out.columns
    words = sorted(t.decode() for t in kinds["import"])
    for name, family, _ in split:
        r = got[name]
        k = int(name, 16)
        assert r.generic_fileSize == os.path.getsize(path / "files" / family / name) and 0 < r.generic_fileEntropy < 8
        assert r.imports[words.index("imp_meow")] == (k % 2 == 1 and k % 4 != 0)
        assert len(r.ngrams) == len(kinds["byte"]) and len(r.opcodes) == len(kinds["opcode"]) and len(r.dlls) == 3
    df = {bytes(r["token"]).decode(): r["df"] for r in known.where("kind = 'opcode'").collect()}
    assert df["i10"] == 12  # from train and test
    train = spark.read.parquet(f"file://{path}/experiment/parsed").where("split = 'train'")
    gains = {r.token: r.ig for r in p.import_gains(train).collect()}
    assert gains["imp_meow"] > gains["imp_rare"] >= 0.0
    assert "sections" not in out.columns  # each name is in all files of train, so none is selected
    words = sorted(df)
    cat = got[f"{1:064x}"]
    assert math.isclose(cat.opcodes[words.index("i10")], math.log(5) * math.log(24 / 13))
    assert got[f"{2:064x}"].opcodes[words.index("i10")] == 0.0
    wide = p.wide()
    assert len(wide.columns) == len({c.lower() for c in wide.columns}) > len(out.columns)
    assert wide.count() == 24


def test_command_line_without_a_disassembler(spark, corpus, monkeypatch):
    from peltrane.__main__ import main

    path, split = corpus
    monkeypatch.setenv("MALWARE_DIR_PATH", f"file://{path}/files")
    monkeypatch.setenv("SPLITTED_DATASET_PATH", f"file://{path}/split")
    monkeypatch.setenv("FINAL_DATASET_DIR", "final")
    monkeypatch.setattr(disassembly.capstone_decoder, "__code__", (lambda machine, code, address: __import__("no_such_disassembler")).__code__)
    main(["--experiment", f"file://{path}/cli", "--other", "ignored"])
    out = spark.read.parquet(f"file://{path}/cli/final")
    assert out.count() == len(split) and "opcodes" not in out.columns and "ngrams" in out.columns
    errors = spark.read.parquet(f"file://{path}/cli/parsed").select("ops.error").distinct().collect()
    assert [r.error for r in errors] == ["no disassembler"]


def test_files_and_stream_agree(spark, corpus):
    path, split = corpus
    files = samples.read_files(spark, f"file://{path}/files")
    assert {(r.sha256, r.family) for r in files.select("sha256", "family").collect()} == {x[:2] for x in split}
    stream = extraction.stream_files(spark, f"file://{path}/files", per_trigger=10)
    assert stream.isStreaming
    query = extraction.start(stream, f"file://{path}/out", f"file://{path}/checkpoint")
    assert query.awaitTermination(120)
    once = spark.read.parquet(f"file://{path}/out")
    batch = extraction.file_features(files)
    assert once.columns == batch.columns
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in batch.collect()}


def test_sql_functions(spark):
    sql.register(spark, fake_decoder)
    spark.createDataFrame([("a", bytearray(build([(b".text", bytes([1, 2]), 0x1000)], entry=0x1000)))], "sha256 string, content binary").createOrReplaceTempView("files")
    r = spark.sql("WITH p AS (SELECT parse_pe(content) AS pe, byte_entropy(content) AS e FROM files) SELECT pe.machine, e, disassemble(pe.machine, pe.code, pe.code_address, pe.code_error).items AS items FROM p").first()
    assert r.machine == 0x14C and r.e > 0 and r["items"] == ["i1", "i2"]


def test_reports_schema_and_config(spark, tmp_path):
    (tmp_path / "r.jsons").write_text('{"sha256": "a", "family": "f", "first_submission_date": 86400, "x": 1}\n{"sha256": "b"}\n')
    got = [tuple(map(str, r)) for r in samples.read_reports(spark, f"file://{tmp_path}/r.jsons").orderBy("sha256").collect()]
    assert got == [("a", "f", "1970-01-02 00:00:00"), ("b", "None", "None")]
    schema = pe_features.section_schema()
    (tmp_path / "s.list").write_text("".join(f"{n}\t{k}\n" for n, k in schema))
    assert samples.read_section_schema(spark, f"file://{tmp_path}/s.list") == schema
    assert len(schema) == len(set(schema)) == 713
    with pytest.raises(ValueError):
        Config.from_env({})
    assert Config.from_env({"MALWARE_DIR_PATH": "m", "SPLITTED_DATASET_PATH": "s", "FINAL_DATASET_DIR": "d"}).dataset == "d"
