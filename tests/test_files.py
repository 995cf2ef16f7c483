"""Readers and writers on tiny files."""

import gzip
import json
import random
import zipfile
import zlib

import pytest

from lociforge.sources import readers as R
from lociforge.sources import sinks as S

VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t10\t.\tA\tT,G\t.\t.\t.\tDP:GT\t3:0/1\t4:./.\n2\t20\t.\tC\tG\t.\t.\t.\tDP\t1\t2\n"


def test_vcf(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    got = sorted((r.variant_id, r.alleles, r.sample_id, r.call) for r in R.read_vcf(spark, str(tmp_path / "a.vcf.gz")).collect())
    assert got == [("1:10", ["A", "T", "G"], "S1", "0/1"), ("1:10", ["A", "T", "G"], "S2", "./."), ("2:20", ["C", "G"], "S1", None), ("2:20", ["C", "G"], "S2", None)]
    (tmp_path / "b.vcf").write_text("1\t2\n")
    with pytest.raises(Exception, match="no #CHROM line in"):
        R.read_vcf(spark, str(tmp_path / "b.vcf")).collect()


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\th\tgene\t5\t9\t.\t+\t.\tgene_id "G1"; tag "a"; tag "b"; level 2;\nchr2\th\tgene\t1\t2\t.\t-\t.\tgene_name "N";\n')
    df = R.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert df.columns[-4:] == ["gene_id", "gene_name", "level", "tag"]
    assert [(r.start, r.gene_id, r.tag, r.level, r.gene_name) for r in df.orderBy("chromosome").collect()] == [(5, "G1", "b", None, None), (1, None, None, None, "N")]
    assert R.read_gtf(spark, str(tmp_path / "a.gtf"), ["gene_id"], ["chr1"]).count() == 1


def test_gmt_and_json_sets(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S1\thttp\tA\tB\t\nS2\t-\n")
    assert sorted(tuple(r) for r in R.read_gmt(spark, str(tmp_path / "a.gmt")).collect()) == [("S1", ["A", "B"]), ("S2", [])]
    (tmp_path / "a.json").write_text(json.dumps({"X": ["a", "b"], "Y": []}, indent=1))
    assert sorted(tuple(r) for r in R.read_gene_set_json(spark, str(tmp_path / "a.json")).collect()) == [("X", ["a", "b"]), ("Y", [])]


def test_split_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"columns": ["x", "name"], "index": [0, 1], "data": [[1.5, "a"], [None, "b"]]}))
    (tmp_path / "b.json").write_text(json.dumps({"columns": ["name", "x"], "index": [0], "data": [["c", 2]]}))
    got = R.read_split_json(spark, str(tmp_path / "*.json"), "name string, x double, z int").collect()
    assert sorted((r.name, r.x, r.z) for r in got) == [("a", 1.5, None), ("b", None, None), ("c", 2.0, None)]


def test_tables_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\nx,1\n")
    (tmp_path / "a.tsv").write_text("id\tn\ny\t2\n")
    assert R.read_table(spark, str(tmp_path / "a.csv")).first().n == 1 and R.read_table(spark, str(tmp_path / "a.tsv")).first().id == "y"
    with pytest.raises(ValueError):
        R.read_table(spark, "a.doc")
    for b, m in ((1, "svm"), (2, "mlp")):
        d = tmp_path / f"boot/{b}/{m}"
        d.mkdir(parents=True)
        (d / "r.csv").write_text(f"id,p\nq{b},0.5\n")
    got = R.read_by_folder(spark, str(tmp_path / "boot/*/*/*.csv"), "id string, p double", bootstrap=r"/(\d+)/[^/]+/r\.csv", model=r"/([^/]+)/r\.csv").collect()
    assert sorted((r.id, r.bootstrap, r.model) for r in got) == [("q1", "1", "svm"), ("q2", "2", "mlp")]


def test_xlsx(spark, tmp_path):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>id</t></si><si><t>age</t></si><si><t>s1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>41</v></c></row></sheetData></worksheet>')
    df = R.read_table(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["id", "column_1", "age"] and [tuple(x) for x in df.collect()] == [("s1", None, "41")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0)], "run_id int, v string, outer_iteration int")
    S.write_artifact(df, str(tmp_path / "art"))
    S.write_artifact(df, str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2
    done = S.write_summaries({"model": df, "features_summary": {"svm": df}}, str(tmp_path / "sum"))
    assert sorted(tuple(r) for r in done.collect()) == [("features_summary_svm", 1, 3), ("model_summary", 1, 3)]
    built = []
    for _ in range(2):
        assert S.read_or_build(spark, str(tmp_path / "rb"), lambda: built.append(1) or df).count() == 1
    assert len(built) == 1


def test_vcf_with_other_samples_is_an_error(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    assert R.read_vcf(spark, str(tmp_path / "a.vcf"), partitions=3).count() == 4
    (tmp_path / "b.vcf").write_text(VCF + "3\t30\t.\tA\tT\t.\t.\t.\tGT\t0/0\n")
    with pytest.raises(Exception, match="a line of 1 samples where the header names 2"):
        R.read_vcf(spark, str(tmp_path / "b.vcf")).collect()


def test_synonyms_and_feature_count(spark, tmp_path):
    (tmp_path / "names.tsv").write_text("id\tname\nE1\tB\nE1\tA\nE1\tA\nE2\t\n\tC\n")
    assert sorted(tuple(r) for r in R.read_synonyms(spark, str(tmp_path / "names.tsv"), "id", "name").collect()) == [("E1", ["A", "B"]), ("E2", [])]
    S.write_matrix(spark.createDataFrame([("s", 1, 0)], "sample_id string, g1 int, g2 int"), str(tmp_path / "m"))
    assert R.feature_count(spark, str(tmp_path / "m")) == 2


def vcf(samples, rows, contig="1", info=3):
    head = "##fileformat=VCFv4.2\n" + "".join(f"##INFO=<ID={k}>\n" for k in range(info)) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT" + "".join(f"\t{s}" for s in samples) + "\n"
    return head + "".join(f"{contig}\t{p}\t.\tA\tT\t.\t.\t.\tGT:DP" + "".join(f"\t{(p + k) % 2}/1:{p}" for k in range(len(samples))) + "\n" for p in rows)


def block_gzip(text, sizes, end=True):
    """Text in gzip members that tell their sizes, of so many text bytes each in turn, with an empty last one."""
    data, out, at, k = text.encode(), b"", 0, 0
    while at < len(data) or k < 0:
        part = data[at : at + sizes[k % len(sizes)]]
        at, k = at + len(part), k + 1
        out += _member(part)
    return out + (_member(b"") if end else b"")


def _member(part):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(part) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")
    return head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")


def calls(df):
    return sorted((r.contig, r.pos, r.sample_id, r.call) for r in df.collect())


@pytest.mark.parametrize("ending", ["vcf", "vcf.gz"])
def test_vcf_files_keep_their_own_samples(spark, tmp_path, ending):
    for name, samples in (("a", ["A1", "A2"]), ("b", ["B1", "B2"]), ("c", ["C1"])):
        text = vcf(samples, [5, 6], name)
        (tmp_path / f"{name}.{ending}").write_bytes(gzip.compress(text.encode()) if ending.endswith("gz") else text.encode())
    got = calls(R.read_vcf(spark, str(tmp_path)))
    assert got == sorted((n, p, f"{n.upper()}{k + 1}", f"{(p + k) % 2}/1") for n, m in (("a", 2), ("b", 2), ("c", 1)) for p in (5, 6) for k in range(m))


@pytest.mark.parametrize("sizes, split", [([60_000], 500), ([700, 1, 65_280, 33], 2_000), ([113], 97), ([1], 4_000), ([65_280], 10**9)])
def test_block_gzip_is_read_in_ranges(spark, tmp_path, sizes, split):
    rows = range(1, 40 if sizes == [1] else 400)
    texts = {"a": vcf(["A1", "A2", "A3"], rows, "1", 60), "b": vcf(["B1", "B2", "B3"], rows, "2"), "none": vcf(["X"], [])}
    for name, text in texts.items():
        (tmp_path / f"{name}.bgz").write_bytes(block_gzip(text, sizes))
        (tmp_path / f"{name}.vcf").write_text(text)
    want = calls(R.read_vcf(spark, str(tmp_path / "*.vcf")))
    df = R.read_vcf(spark, str(tmp_path / "*.bgz"), split_bytes=split)
    assert calls(df) == want and len(want) == 2 * 3 * len(rows)
    lines = R.block_gzip_lines(spark, str(tmp_path / "a.bgz"), split)
    assert sorted(r.line for r in lines.collect()) == sorted(texts["a"].split("\n")[:-1])
    if split < 1000:
        assert lines.rdd.getNumPartitions() > 3
    assert [r.line for r in R.block_gzip_lines(spark, str(tmp_path / "a.bgz"), header="#CHROM").collect()] == [x for x in texts["a"].split("\n") if x.startswith("#CHROM")]


def test_block_gzip_lines_of_any_shape(spark, tmp_path):
    rng = random.Random(6)
    for k in range(6):
        text = "".join(rng.choice(["", "x", "y" * 300, "\r", "é"]) + rng.choice(["\n", "\n", "\r\n", ""]) for _ in range(300))
        (tmp_path / f"{k}.gz").write_bytes(block_gzip(text, [rng.randrange(1, 400) for _ in range(9)], end=k % 2 == 0))
        want = [x.removesuffix("\r") for x in (text if text.endswith("\n") else text + "\n").split("\n")[:-1]]
        for split in (40, 333, 1000):
            assert sorted(r.line for r in R.block_gzip_lines(spark, str(tmp_path / f"{k}.gz"), split).collect()) == sorted(want)


def test_block_gzip_that_is_none(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(vcf(["A"], [1]).encode()))
    with pytest.raises(Exception, match="not a block-gzipped file"):
        R.read_vcf(spark, str(tmp_path / "a.gz"), block_gzip=True).collect()
