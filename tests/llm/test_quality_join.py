"""How trusted ids meet the documents."""

from sleevenotes.llm import quality_rules


def plan(spark, docs, trusted):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = quality_rules.marked(docs, trusted)
        found = sorted((r.doc_id is None, r.doc_id or 0, r.trusted) for r in rows.collect())
        return found, rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay_where_they_are_until_the_ids_are_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id long, text string")
    trusted = spark.createDataFrame([(2,), (2,), (3,), (None,)], "doc_id int")
    few, sent = plan(spark, docs, trusted)
    assert few == [(False, 1, None), (False, 2, 1), (False, 2, 1), (True, 0, None)]
    assert "BroadcastHashJoin" in sent and "SortMergeJoin" not in sent
    monkeypatch.setattr(quality_rules, "IDS_IN_MEMORY", 1)
    many, dealt = plan(spark, docs, trusted)
    assert many == few and "BroadcastHashJoin" not in dealt
