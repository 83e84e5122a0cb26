import numpy as np

from terravane.streaming import selector, windows
from terravane.streaming.selector import FRAME, Rules, select_batch, select_stream, step


def frames(n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        t = np.cumsum(rng.uniform(0.2, 0.6, n))
        x = np.cumsum(rng.uniform(0, 3, n))
        rows += [(s, int(k), float(t[k]), float(rng.uniform(20, 100)), float(x[k]), 0.0, float(rng.uniform(0.4, 1))) for k in range(n)]
    return rows


def test_rules():
    state, out = step(selector.START, (1, 0.0, 50.0, 0.0, 0.0, 1.0), Rules())
    assert out[:3] == (1, 0.0, "first")
    state, out = step(state, (2, 1.0, 40.0, 1.0, 0.0, 1.0), Rules())
    assert out is None
    state, out = step(state, (3, 2.0, 30.0, 20.0, 0.0, 1.0), Rules())
    assert out[0] == 2 and out[2] == "moved"  # the sharpest frame of the window
    state, out = step(state, (4, 3.0, 30.0, 20.0, 0.0, 0.1), Rules())
    assert out[2] in ("moved", "lost")


def test_stream_equals_table(spark, tmp_path):
    rows = frames()
    df = spark.createDataFrame(rows, FRAME)
    batch = {tuple(r) for r in select_batch(df).collect()}
    for k in range(3):  # three files in order, one batch each
        df.where(f"frame_no >= {40 * k} AND frame_no < {40 * (k + 1)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streamed = {tuple(r) for r in windows.run_to_end(select_stream(source)).collect()}
    assert streamed == batch and len(batch) > 20


def test_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], FRAME).write.parquet(f"{tmp_path}/none")
    source = spark.readStream.schema(FRAME).parquet(f"{tmp_path}/none")
    assert windows.run_to_end(select_stream(source)).count() == 0


def test_empty_table(spark):
    assert select_batch(spark.createDataFrame([], FRAME)).count() == 0
