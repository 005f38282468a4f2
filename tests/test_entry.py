import __spark_entry__ as entry


def test_entry_runs_and_has_rows(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["ItemDescrip", "Supplier", "OrderCode"]


def test_queries_take_session_and_dir(spark):
    q = entry.queries()["active_items"]
    assert q(spark, "/root/testdata/sf0.001").count() >= 0


def test_command_line_builds_each_report(spark):
    from larder.__main__ import _parser, build
    from larder.sources import Catalog
    c = Catalog.derived(spark, "/root/testdata/sf0.001")
    common = ["--source", "/root/testdata/sf0.001", "--store", "2"]
    period = ["--start", "1999-01-01", "--end", "1999-12-31"]
    for argv in (["ledger", *common, *period], ["usage", *common, *period],
                 ["picksheet", *common, "--as-of", "2001-07-31 00:00:00"], ["search", *common, "--item", "ring"]):
        df = build(_parser().parse_args(argv), c)
        assert df.count() > 0, argv


def test_domain_views_answer_sql(spark):
    """The domain tables as SQL views: a Spark SQL statement of the period
    purchases gives the same rows as the operator."""
    from larder.operators.movements import period_purchases
    from larder.params import Period
    from larder.sources import Catalog
    c = Catalog.derived(spark, "/root/testdata/sf0.001")
    views = c.register_views(prefix="t_")
    assert "t_InvoiceItem" in views and len(views) == 30
    sql = spark.sql("""
        SELECT ii.Item, inv.Store,
               CAST(SUM(ii.StockQty - COALESCE(rfc.StockQty, 0)) AS DECIMAL(18,3)) AS InvoiceSum,
               CAST(SUM(ii.AdjustedTotal) AS DECIMAL(18,4)) AS InvoiceValue
        FROM t_InvoiceItem ii
        JOIN t_Invoice inv ON inv.InvoiceId = ii.Invoice
             AND inv.InvoiceDate BETWEEN TIMESTAMP_NTZ '1999-01-01 00:00:00' AND TIMESTAMP_NTZ '1999-12-31 00:00:00'
        LEFT JOIN t_InvoiceRFC rfc ON rfc.InvoiceItem = ii.InvoiceLineId
        WHERE inv.Store = 2
        GROUP BY ii.Item, inv.Store""")
    op = period_purchases(c, Period(2, "1999-01-01 00:00:00", "1999-12-31 00:00:00"))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, op.collect()))
    assert sql.count() > 0


def test_cluster_settings_are_known_spark_settings(spark):
    """Every intended cluster setting is a real, runtime-settable SQL config
    (a typo would be silently ignored by Spark)."""
    from larder.session import CLUSTER_CONF
    known = {r.key for r in spark.sql("SET -v").collect()}
    for key, value in CLUSTER_CONF.items():
        assert key in known, key
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        assert spark.conf.get(key) == value
        spark.conf.set(key, old)


def test_checkpoint_folder_comes_from_the_session(spark):
    from larder.session import ensure_checkpoint_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured and ensure_checkpoint_dir(spark) == configured
