from recoflux.llm import common as C


def test_lean_passes_rows_on():
    assert list(C.lean(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]


def test_checkpoints_let_go_of_what_is_unused(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(C.gc, "collect", lambda *a: calls.append(a))
    assert C.checkpointed(spark.range(3)).count() == 3 and calls
