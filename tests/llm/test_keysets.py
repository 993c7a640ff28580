import numpy as np

from wavemill.llm.keysets import KeySet, key_set, thinned


def test_membership_and_thinning(spark):
    keys = [-(1 << 63), -5, 0, 7, (1 << 63) - 1, 7]
    folder, bits = key_set(spark.createDataFrame([(k,) for k in keys], "h long"), "h")
    asked = np.array([-(1 << 63), -6, 0, 8, (1 << 63) - 1], np.int64).view(np.uint64)
    assert KeySet(folder, bits).known(asked).tolist() == [True, False, True, False, True]
    rows = [(7, "a", None), (8, "b", 1), (None, "c", 2), (0, None, 3), (7, "a", None)]
    df = spark.createDataFrame(rows, "fp long, text string, x int")
    got = thinned(df, "fp", folder, bits)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    assert thinned(df.limit(0), "fp", folder, bits).collect() == []


def test_empty_set(spark):
    folder, bits = key_set(spark.createDataFrame([], "h long"), "h")
    assert thinned(spark.createDataFrame([(1,)], "fp long"), "fp", folder, bits).collect() == []
