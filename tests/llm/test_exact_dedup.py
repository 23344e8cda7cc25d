from pyspark.sql import functions as F

from rasterloom.llm.exact_dedup import OP1_SQL, exact_dedup, keep_first, op1_exact_dedup

SCHEMA = "doc_id long, text string, file int"
ROWS = [(3, "a b", 1), (1, "a\tb", 2), (2, "c", 3), (None, "c", 4), (None, "z", 5), (None, "z", 6), (5, None, 7), (6, "", 8), (1, "a\tb", 9), (7, "x" * 500_000, 1), (8, "x" * 500_000, 2)]


def plain(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(" ".join((t or "").split()), []).append(i)
    return groups


def test_equals_sql(against_sql):
    against_sql(op1_exact_dedup, OP1_SQL)


def test_defined_cases(spark):
    for digest in ({}, {"digest": lambda n: F.unhex(F.lit("00"))}):  # a digest that always collides changes nothing
        found = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), **digest).collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in found) == sorted((i or 0, min((x for x in g if x is not None), default=0), len(g)) for t, g in plain(ROWS).items() for i in g)
        assert sum(r.kept for r in found) == len(plain(ROWS))


def test_state_is_kept_for_later_batches(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = exact_dedup(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"), state=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first) == [(5, 5, 1, True), (6, 6, 1, True)]
    later = exact_dedup(spark.createDataFrame([(7, "a  b"), (4, "c"), (8, "d"), (8, "d"), (6, "c")], "doc_id long, text string"), state=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in later) == [(4, 4, 3, True), (6, 4, 3, False), (7, 5, 2, False), (8, 8, 2, False), (8, 8, 2, True)]


def test_keep_first(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert keep_first(df.filter("false")).count() == 0
    assert exact_dedup(df.filter("false")).count() == 0


def test_texts_that_are_not_their_files(spark, tmp_path):
    """A file's own text column, or none, beside renamed and changed texts; files of one table in one and in many parts."""
    rows = [(1, "A  b", "x y"), (2, "a b", "x y"), (3, "z", "q"), (4, "a\tB", "r")]
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, body string, text string").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    shown = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    lowered = [(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 1, 3, False)]
    assert shown(exact_dedup(table)) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)]
    assert shown(exact_dedup(table.select("doc_id", F.lower("body").alias("text")))) == lowered
    assert shown(exact_dedup(table.withColumn("text", F.lower("body")))) == lowered
    renamed = table.drop("text").withColumnRenamed("body", "text")
    assert shown(exact_dedup(renamed, digest=lambda n: F.unhex(F.lit("00")))) == [(i, i, 1, True) for i in (1, 2, 3)] + [(4, 4, 1, True)]
    assert shown(exact_dedup(table.filter("doc_id > 1"))) == [(i, i, 1, True) for i in (2, 3, 4)]
    assert sorted(r.doc_id for r in keep_first(table.withColumn("text", F.lower("body"))).collect()) == [1, 3]
    state = f"file://{tmp_path}/state"
    assert shown(exact_dedup(table.withColumn("text", F.lower("body")), state=state)) == lowered
    assert shown(exact_dedup(spark.createDataFrame([(0, "A b"), (9, "a b")], "doc_id long, body string").withColumnRenamed("body", "text"), state=state)) == [(0, 0, 1, True), (9, 1, 4, False)]


def test_tables_as_they_are_read_are_not_copied(spark, tmp_path):
    from rasterloom.llm.exact_dedup import _as_read

    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "doc_id long, text string, n int")
    df.repartition(2).write.parquet(path)
    table = spark.read.parquet(path)
    assert _as_read(table) and _as_read(spark.read.schema(table.schema).parquet(f"{tmp_path}/t"))
    assert _as_read(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert not _as_read(df) and not _as_read(table.filter("n > 1")) and not _as_read(table.withColumnRenamed("text", "body"))
