from thicket.sources.engine import Engine
from thicket.streaming import each_batch


def test_nested_batches_of_a_stream(spark, tmp_path):
    orders = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "order_id int, user int")
    engine = Engine(spark, {"orders": orders})
    spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cy")], "id int, name string").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []

    def query(batch):
        return engine.select_as("user", batch, "id").left_join_many("orders", lambda qs: qs(engine.tables["orders"], "order_id"), "orders.user", "user.id")

    stream = spark.readStream.schema("id int, name string").parquet(f"{tmp_path}/in")
    writer = each_batch(stream, query, lambda df, number: got.extend((number, r.id, [o.order_id for o in r.orders]) for r in df.collect()))
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(0, 1, [10, 11]), (0, 2, [12]), (0, 3, [])]
