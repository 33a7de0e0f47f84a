from waypoint.llm import common


def test_what_a_worker_holds_goes_when_another_step_begins():
    loads = []

    def asking(batches):
        held = common.holding("a", lambda: loads.append(1) or [7])
        yield from (held[0] + b for b in batches)

    assert list(common.lean(asking)([1, 2])) == [8, 9]
    assert list(common.lean(asking)([3])) == [10]
    assert loads == [1] and common._held == {"a": [7]}
    assert list(common.lean(iter)([1])) == [1]
    assert common._held == {}
    assert list(common.lean(asking)([4])) == [11] and loads == [1, 1]
    common._held.clear()


def test_freed_memory_is_handed_back_at_the_end_of_a_task(monkeypatch):
    ends = []
    monkeypatch.setattr(common, "give_back", lambda: ends.append(1))
    task = common.lean(lambda batches: (b for b in batches))
    rows = task([1, 2])
    assert next(rows) == 1 and not ends
    rows.close()  # a limit above it ends a task early
    assert ends == [1]
