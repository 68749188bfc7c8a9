import duckdb
import pytest

from spotweave.llm import oracles
from spotweave.llm.line_dedup import html_text, line_dedup, url_host
from spotweave.llm.mixing import mix_sources
from pyspark.sql import functions as F

EDGE = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "x " * 2000, "s3"), (4, "x " * 2000, "s3"), (None, "w w", None), (5, "q", None), (6, "one two", "S1"), (7, "a\tb\nc", "é")]


def mixed(spark, rows):
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    return mix_sources(df)


def by_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(oracles.OP2).fetchall(), key=str)


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], [], [(i, "w " * (i % 37), f"s{i % 5}") for i in range(300)]])
def test_mixture_equals_sql(spark, rows):
    out = mixed(spark, rows)
    got = sorted((tuple(r) for r in out.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    want = by_sql(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    assert set(out.columns) == {"doc_id", "text", "source", "size", "source_size", "target", "taken"}


def test_a_source_comes_near_its_target_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * i % 50), f"s{i % 4}") for i in range(2000)]
    a, b = (mixed(spark, rows).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).orderBy("source").collect() for _ in range(2))
    assert a == b
    assert all(abs(r.t - r.g) <= 25 for r in a)


def test_lines(spark):
    rows = [(i, f"own line {i}\n  menu \n\nfooter", "h") for i in range(8)] + [(8, "own\nmenu", "g"), (9, None, "h"), (10, "", "h"), (11, "menu\nmenu", "h"), (12, "a\nb", None), (13, "x\n" * 9000, "h")]
    df = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, source string, n_lines string")
    got = {r.doc_id: r for r in line_dedup(df, ratio=0.5, min_pages=3).collect()}
    assert got[0].text == "own line 0\n" and (got[0].n_lines, got[0].n_dropped) == (3, 2)
    assert got[8].text == "own\nmenu" and got[12].text == "a\nb"
    assert got[9].text is None and (got[9].n_lines, got[9].n_dropped) == (0, 0)
    assert got[10].text == "" and got[11].text == "" and got[11].n_dropped == 2
    assert got[13].text == "x\n" * 9000 and got[13].n_lines == 9000
    assert line_dedup(df.limit(0)).count() == 0
    assert line_dedup(df, ratio=0.5, min_pages=3, counts=False).columns == df.columns


def test_html_and_hosts(spark):
    df = spark.createDataFrame([("http://U:p@Www.X.com:80/a?b", "<head><title>t</title></head><p>a<b>b</b></p><!-- <p>no</p> --><script>x<y</script><li>c"), (None, None), ("junk", "plain")], "url string, html string")
    got = df.select(url_host(F.col("url")), html_text(F.col("html"))).collect()
    assert [r[0] for r in got] == ["www.x.com", None, ""]
    assert got[0][1].split() == ["ab", "c"] and got[1][1] is None and got[2][1] == "plain"
