import random

from tessera.streaming import sessions


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_the_table_and_repeats_nothing(spark, tmp_path):
    rnd = random.Random(3)
    turns = [(c, t, rnd.choice([None, 0, 3, 40])) for c in range(12) for t in range(rnd.randint(1, 9))] + [(None, 1, 5), (3, None, 5)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, tokens long")
    put = lambda df, k: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: sessions.follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 50, files=1).awaitTermination()
    out = lambda: rows_of(spark.read.schema(sessions.OUT).parquet(str(tmp_path / "out")))
    for k, part in enumerate(("turn < 3 OR turn IS NULL", "turn BETWEEN 3 AND 5", "turn > 5")):
        put(table.where(part), k)
        go()
    want = rows_of(sessions.sessions(table, 50))
    assert out() == want and sum(r[5] for r in want) > 0
    go()  # nothing is new
    assert out() == want
    put(table.where("turn < 4"), 3)  # turns that come again change nothing
    put(spark.createDataFrame([(0, 100, 7), (0, 101, 60), (0, 101, 60)], "conv_id long, turn long, tokens long"), 4)
    go()
    new = sorted(set(out()) - set(want))
    last = max(r[3] for r in want if r[0] == 0)
    assert [(r[1], r[3]) for r in new] == [(100, last + 7), (101, last + 67)] and len(out()) == len(want) + 2
