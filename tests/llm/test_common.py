"""What Python workers keep between tasks."""

from panelspark.llm import common


def test_a_worker_keeps_one_module_s_table_at_a_time(monkeypatch):
    monkeypatch.setattr(common, "_TABLES", {})
    made = []

    def first(x):
        made.append(x)
        return [x]

    def second(x):
        return first(x)

    first.__module__, second.__module__ = "one", "two"
    a, b = common.worker_table(first), common.worker_table(second)
    assert a(1) is a(1) and made == [1]
    common._give_up_tables("one")
    assert a(1) and made == [1]
    b(2)
    common._give_up_tables("two")  # a task of the second module
    assert b(2) and made == [1, 2]
    assert a(1) and made == [1, 2, 1]
