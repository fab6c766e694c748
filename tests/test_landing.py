"""Raw tables are landed when a query first asks for them, and orders are made of the order facts."""

import datetime

from plumbline.sources.driver_tables import raw_table
from plumbline.suite import common

AT = datetime.datetime(1995, 3, 1)
ORDERS = [(1, 7, "F"), (503, 8, "O"), (610, 9, "P"), (71, None, "F"), (71, 5, "O"), (None, 4, "F"), (None, 3, None)]
LINES = [(1, 2.0, 20.0, "R", 1), (1, 1.0, 7.5, "R", 1), (503, 3.0, 10.0, "N", 1), (71, 1.0, 9.0, "R", 2), (None, 1.0, 4.0, "R", 1), (99, 1.0, 4.0, "R", 1)]


def source(spark, folder):
    orders = spark.createDataFrame([(k, c, st, AT) for k, c, st in ORDERS], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    lines = spark.createDataFrame([(k, q, p, flag, n) for k, q, p, flag, n in LINES],
                                  "l_orderkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linenumber int")
    orders.write.parquet(f"{folder}/orders.parquet")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(3, 7, "view", AT)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_only_what_is_asked_for(spark, tmp_path):
    folder = source(spark, tmp_path)
    bed = common.Bed(spark, folder)
    # The other driver tables are not there: landing them would fail.
    assert bed.stg("tickets").count() == 1
    assert common._LANDED[spark.sparkContext.applicationId, folder][1] == {"tickets"}
    assert bed.stg("payments").count() == len(ORDERS)
    assert common._LANDED[spark.sparkContext.applicationId, folder][1] == {"tickets", "order_facts", "payments"}


def test_orders_of_landed_facts(spark, tmp_path):
    folder = source(spark, tmp_path)
    rows = common.Bed(spark, folder).keyed("orders").collect()
    assert sorted(map(str, rows)) == sorted(map(str, raw_table(spark, folder, "orders", keep=("case_key",)).collect()))
    got = sorted((str(r.order_id), float(r.subtotal_amount), float(r.discount_amount), float(r.total_amount), r.order_status, (r._loaded_at - AT).seconds // 3600) for r in rows)
    assert got == [("None", 0.0, 0.0, 12.0, "DELIVERED", 1), ("None", 0.0, 0.0, 12.0, "Shipped", 1), ("O1", 27.0, 0.0, 39.0, "DELIVERED", 1),
                   ("O503", 9.0, 0.0, 21.0, "placed", 1), ("O503", 9.0, 0.0, 21.0, "placed", 3), ("O610", 1.0, 100.0, -87.0, "Shipped", 1),
                   ("O71", 9.0, 0.0, 21.37, "DELIVERED", 1), ("O71", 9.0, 0.0, 21.37, "placed", 1)]
