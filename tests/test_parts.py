"""Tables written anew keep as many parts as their size asks for."""

from siftline.plans import relational_queries as rq


def test_moved_documents_are_written_in_parts_that_grow(spark, monkeypatch):
    seen = {}
    plain = rq.written

    def written(df, name):
        seen[name] = df.rdd.getNumPartitions()
        return plain(df, name)

    monkeypatch.setattr(rq, "written", written)
    monkeypatch.setattr(rq, "parts_for", lambda df: 13)
    assert {r.change: r.same_as_before for r in rq.agg15(spark, "/root/testdata/sf0.001").collect()} == {"moved": True, "vectors lost": False, "text edited": False}
    assert seen["documents"] == 13
