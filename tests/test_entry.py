import __spark_entry__ as entry
from tests.conftest import SF


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_columns(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    for name in ("ratios_clr", "du_t_fisher", "fdr_by", "gene_summary", "bin_table"):
        assert q[name](spark, SF).limit(1).count() <= 1
