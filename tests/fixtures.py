"""Small tables with known answers."""

PAIRS = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3, 4], 4: [5, 6], 5: [5, 6], 6: [4, 5, 6], 7: [2, 6], 8: []}


def up(spark):
    return spark.createDataFrame([(u, p) for u, ps in PAIRS.items() for p in ps], "user_id long, permission_id long")


def users(spark):
    return spark.createDataFrame([(u,) for u in PAIRS], "user_id long")


def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, -1), (8, -1)], "user_id long, label long")
