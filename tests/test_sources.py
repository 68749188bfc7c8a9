import json

import pytest

from spotweave.sources import matrix, sinks, visium, xenium
from spotweave.streaming import binning


def test_transcript_chunk(spark):
    t = spark.createDataFrame(list(zip([30.0, 10.0, 40.0, 30.0], [0, 1, 2, 0], [0.1, 0.2, 0.8, 1.2], [0.1, 0.2, 0.8, 1.2], [b"a", b"a", b"b", b"b"], strict=True)), "qv double, codeword_index int, x double, y double, cell_id binary")
    words = spark.createDataFrame([(0, "A"), (1, "B"), (2, "UnassignedCodeword_2")], "codeword_index int, name string")
    grid = xenium.Grid.over(0, 1, 0, 1, 1.0)
    assert [tuple(r) for r in xenium.bin_transcripts(t, xenium.assigned(words), grid).collect()] == [(0, 0, 0, 1.0)]
    cells = spark.createDataFrame([("a", 1), ("c", 2)], "cell_id string, area int")
    counts, known = xenium.cell_codewords(t, words, cells)
    assert [tuple(r) for r in counts.collect()] == [("a", 0, 1.0)] and known.count() == 2
    meta = spark.createDataFrame([("a", 9, "k")], "cell_id string, area int, kind string")
    assert xenium.with_cell_meta(cells, meta).columns == ["cell_id", "area", "area_meta", "kind"]
    both = xenium.bin_all(t, words, (0, 2, 0, 2), [1.0, 2.5])
    assert set(both) == {"square_001um", "square_2p5um"} and both["square_001um"][1].count() == 4
    assert both["square_001um"][1].orderBy("row", "col").first().barcode == "s_001um_00000_00000-1"


def test_stream_equals_batch(spark, tmp_path):
    t = spark.createDataFrame([(30.0, i % 3, float(i % 7), float(i % 5)) for i in range(200)], "qv double, codeword_index int, x double, y double")
    t.repartition(5).write.parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([(0, "A"), (1, "B")], "codeword_index int, name string")
    grid = xenium.Grid.over(0, 7, 0, 5, 2.0)
    stream = binning.transcript_stream(spark, str(tmp_path / "in"), "qv double, codeword_index int, x double, y double", 2)
    q = binning.start(binning.streaming_bins(stream, words, grid), "bins_seen", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bins_seen").collect())) == sorted(map(tuple, xenium.bin_transcripts(t, words, grid).collect()))


def test_mapping(spark):
    counts = spark.createDataFrame([("b1", "p", 1.0), ("b2", "p", 2.0), ("b2", "q", 1.0), ("b3", "p", 3.0), ("b4", "p", 4.0), ("b4", "q", 1.0)], "barcode string, feature string, n double")
    m = spark.createDataFrame([("b1", "s1", "S", "c1"), ("b2", "s1", "S", None), ("b3", "s2", "S", "c1"), ("b3", "s2", "S", "c1"), ("gone", "s9", "S", None)], "square_002um string, square_008um string, square_016um string, cell_id string")
    out = visium.load_bins(counts, m, [2, "8", "square_016um"], cells=True)
    assert sorted(map(tuple, out["square_008um"][0].collect())) == [("s1", "p", 3.0), ("s1", "q", 1.0), ("s2", "p", 3.0)]
    assert sorted(r[0] for r in out["square_008um"][1].collect()) == ["s1", "s2", "s9"]
    assert sorted(map(tuple, out["cell_id"][0].collect())) == [("c1", "p", 4.0)]
    for name in ("none", 2.5, "2p5um"):
        with pytest.raises(ValueError):
            visium.bin_name(name)
    assert {visium.bin_name(x) for x in (8, 8.0, "8", "8um", "square_008um")} == {"square_008um"}
    template = spark.createDataFrame([("b1",), ("b3",), ("bare",)], "barcode string")
    fine, bins = visium.load_bins(counts, m, [2], templates={"square_002um": template})["square_002um"]
    assert sorted(map(tuple, fine.collect())) == [("b1", "p", 1.0), ("b3", "p", 3.0)]
    assert sorted(r[0] for r in bins.collect()) == ["b1", "b3", "bare"]


def test_a_grid_around_all_points(spark):
    p = spark.createDataFrame([(2.0, 5.0), (18.0, 21.0)], "x double, y double")
    g = xenium.Grid.around(p, 8.0)
    assert (g.x0, g.y0, g.n_rows, g.n_cols) == (2.0, 5.0, 3, 3)
    assert xenium.Grid.around(p.limit(0), 8.0).n_rows == 1


def test_positions_and_probes(spark, tmp_path):
    (tmp_path / "tissue_positions_list.csv").write_text("b1,1,0,0,10,20\nb2,0,0,1,11,21\n")
    (tmp_path / "scalefactors_json.json").write_text(json.dumps({"spot_diameter_fullres": 8.5}))
    pos = visium.read_positions(spark, str(tmp_path))
    raw = spark.createDataFrame([("b1", "p", 1.0), ("b9", "p", 1.0)], "barcode string, feature string, n double")
    counts, spots = visium.load_probes(raw, spark.createDataFrame([("b1",), ("b2",)], "barcode string"), pos)
    assert counts.count() == 1 and {(r.barcode, r.x, r.y) for r in spots.collect()} == {("b1", 20.0, 10.0), ("b2", 21.0, 11.0)}
    assert visium.in_tissue(raw, pos).count() == 1
    assert visium.scale_factors(spark, str(tmp_path))["spot_diameter_fullres"] == 8.5
    with pytest.raises(FileNotFoundError):
        visium.read_positions(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        xenium.outs_folder(spark, str(tmp_path))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% c\n2 3 3\n1 1 5\n2 3 7\n2 1 1\n")
    (tmp_path / "f.tsv").write_text("t1\tT1\nt2\tT2\n")
    (tmp_path / "b.tsv").write_text("AA\nx/BB-1\nCC\n")
    counts, feats, codes = matrix.read_mtx(spark, *(str(tmp_path / f) for f in ("m.mtx", "f.tsv", "b.tsv")))
    assert sorted(map(tuple, counts.collect())) == [("AA-1", "t1", 5.0), ("AA-1", "t2", 1.0), ("CC-1", "t2", 7.0)]
    assert feats.count() == 2 and codes.count() == 3
    (tmp_path / "g.gtf").write_text('#h\nc\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "G"; transcript_id "t1"; gene_name "N";\nc\ts\texon\t1\t2\t.\t+\t.\tgene_id "G"; transcript_id "t1";\nc\ts\ttranscript\t1\t2\t.\t+\t.\tgene_id "G"; transcript_id "t2";\n')
    genes = matrix.gff_genes(spark, str(tmp_path / "g.gtf"))
    assert sorted(map(tuple, genes.collect())) == [("t1", "G", "N"), ("t2", "G", "G")]
    held, iso = matrix.transcript_counts(counts, genes)
    assert held.count() == 3 and [r.ord for r in iso.orderBy("iso_id").collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    res = spark.createDataFrame([("g1", 1.0), ("g2", 2.0)], "gene_id string, statistic double")
    iso = spark.createDataFrame([("a", "g1", "Same"), ("b", "g1", "Same"), ("c", "g2", "Same")], "iso_id string, gene_id string, gene_name string")
    out = sinks.formatted(res, iso)
    assert out.count() == 2 and out.columns == ["gene", "statistic"]
    sinks.save(out, str(tmp_path / "r"))
    assert sinks.load(spark, str(tmp_path / "r")).count() == 2
